from datetime import UTC, date, datetime

from pyspark.sql import functions as F

from tidemark.functions import dates, text, urls


def one(spark, value, *columns):
    df = spark.createDataFrame([(value,)], "v string")
    return df.select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


def test_german_ranges(spark):
    cases = {
        "am 3.4.2026": (date(2026, 4, 3), date(2026, 4, 4)), "1.5. - 3.5.2026": (date(2026, 5, 3), date(2026, 5, 4)), "1.5.2026 - 3.5.": (date(2026, 5, 1), date(2026, 5, 4)),
        "29. Mai + 1. Juni 2026": (date(2026, 5, 29), date(2026, 6, 2)), "5. - 7. März 2026": (date(2026, 3, 5), date(2026, 3, 8)), "5. Maerz 2026": (date(2026, 3, 5), date(2026, 3, 6)),
        "12.Mai 2026": (date(2026, 5, 12), date(2026, 5, 13)), "112.4.2026": None, "3.4.20261": None,
        "31.2.2026": None, "5. Foo 2026": None, "3.4.1999": None, "": None,
    }
    df = spark.createDataFrame(list(enumerate(cases)), "i int, t string").select("i", dates.german_range(F.col("t")).alias("r")).orderBy("i").collect()
    assert [r.r and (r.r.first, r.r.end) for r in df] == list(cases.values())


def test_times(spark):
    r = one(spark, "um 19.30 Uhr", dates.german_time(F.col("v")), dates.german_time(F.lit("25:00")), dates.german_time(F.lit("x")))
    assert tuple(r) == (19 * 60 + 30, None, None)
    t = F.lit(datetime(2026, 3, 29, 0, 30, tzinfo=UTC)).cast("timestamp")
    assert one(spark, "", dates.iso_berlin(t))[0] == "2026-03-29T01:30:00+01:00"
    assert one(spark, "", dates.iso_utc(t))[0] == "2026-03-29T00:30:00+00:00"
    r = one(spark, "12", dates.retry_after(F.col("v"), t), dates.retry_after(F.lit("Sun, 29 Mar 2026 00:31:00 GMT"), t), dates.retry_after(F.lit("soon"), t))
    assert tuple(r) == (12.0, 60.0, 0.0)


def test_text(spark):
    assert one(spark, "  Grüße, _Welt_!  ", text.normal_title(F.col("v")))[0] == "grüße _welt_"
    assert one(spark, "Straße & Fest", text.slug(F.col("v")))[0] == "strasse-fest"
    assert one(spark, r"a\;b,c" + "\nd", text.unescaped(text.escaped(F.col("v"))))[0] == r"a\;b,c" + "\nd"
    assert one(spark, "/a/token/abc/x.y.z", text.redacted_path(F.col("v")))[0] == "/a/<redacted>/<redacted>/x.y.z"
    secret = ["/api/bearer/abc", "/x/%74oken/abc", "/x/tokens/abc", "/a/my-Key.x/b/c"]
    got = spark.createDataFrame(list(enumerate(secret)), "i int, p string").orderBy("i").select(text.redacted_path(F.col("p")).alias("r")).collect()
    assert [r.r for r in got] == ["/api/<redacted>/<redacted>", "/x/<redacted>/<redacted>", "/x/tokens/abc", "/a/<redacted>/<redacted>/c"]
    assert one(spark, "https://u:p@Host.example:8080/" + "a/" * 200 + "?token=1", text.endpoint(F.col("v")))[0] == "host=host.example:8080 path=/" + "a/" * 88 + "..."
    assert one(spark, "https://host.example", text.endpoint(F.col("v")), text.endpoint(F.lit("nothing")))[:] == ("host=host.example path=/", "host=<unknown-host> path=/")
    many = F.transform(F.sequence(F.lit(1), F.lit(12)), lambda i: F.repeat(F.lit("x"), F.lit(400)))
    told = one(spark, "", text.bounded(many))[0]
    assert told.endswith("omitted=6") and len(told) < 2100


def test_robots_patterns(spark):
    cases = [("/a*b$", "/axxb", True), ("/a*b$", "/axxbc", False), ("/a.b", "/axb", False), ("/a", "/abc", True), ("/q?x", "/q?xy", True)]
    df = spark.createDataFrame(cases, "p string, u string, want boolean")
    assert df.filter(F.regexp_like("u", urls.rule_regex(F.col("p"))) != F.col("want")).count() == 0


def test_robots_path_has_the_query_and_is_unquoted(spark):
    cases = [("https://h.example/a%20b?print=1%26x", "/a b?print=1&x"), ("https://h.example", "/"), ("https://h.example?q", "/?q"), ("https://h.example/a+b#f", "/a+b"), ("https://h.example/%zz", "/%zz")]
    df = spark.createDataFrame(cases, "u string, want string")
    assert [r for r in df.select("u", "want", urls.robots_path(F.col("u")).alias("got")).collect() if r.want != r.got] == []


def test_slugs_of_any_text(spark):
    cases = {"„Fest“ – Straße €5": "fest-strasse-5", "ПРИВЕТ": "", "漢字 a😀b": "a-b", "ẞ": "ss", "ÄÖÜ é": "äöü"}
    df = spark.createDataFrame([(k, v) for k, v in cases.items()], "t string, want string")
    assert [r for r in df.select("t", "want", text.slug(F.col("t")).alias("got")).collect() if r.want != r.got] == []


def test_a_text_is_searched_once_for_its_dates(spark):
    df = spark.range(3).selectExpr("concat('1. Mai - 3.', char(160), 'Juni  203', id) as t").select(dates.german_range(F.col("t")).alias("r"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") == 1 and "regexp_extract" not in plan and "format_string" not in plan
    assert [(str(r.first), str(r.end)) for (r,) in df.collect()] == [(f"203{i}-05-01", f"203{i}-06-04") for i in range(3)]
