"""Documents with every odd case: nulls, empty and long texts, ties, repeated rows, extra columns with clashing names."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, n_words string, uid string, id string, key string, k string, label string"
LONG = " ".join(f"word{i % 977}x{i}" for i in range(30_000))
RUN = " ".join(f"run{i}" for i in range(60))
EXTRA = ("e",) * 7


def documents(spark, empty=False):
    texts = [(1, None), (2, ""), (3, " \n\t "), (4, LONG), (5, f"{RUN}\nsecond line of it"), (5, f"{RUN}\nsecond line of it"), (6, f"before {RUN} after"), (None, f"{RUN}\nsecond line of it"), (None, None), (7, "one"), (8, "The MIT License"), (9, "é Ünï 日本語 \x1c\x85 <|endoftext|>")]
    rows = [] if empty else [(i, t, None if i == 7 else "en", "s", len(t or ""), *EXTRA) for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA)
