"""The conversation trie, lexical search and language identification beside brute force, their SQL and held-out accuracy."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict
from hashlib import md5, sha256

import numpy as np
import pytest
from compare import DATA, same

from tidemark.llm import language_id, lexical, prefix_trie

TURNS = "conv_id long, turn long, role string, text string, node string, depth string"


def nodes_of(rows):
    """What the trie of (conv_id, turn, role, text, ...) has, by dictionaries of prefixes."""
    own = defaultdict(list)
    for c, t, r, x, *_ in rows:
        if c is not None:
            r, x = r or "", x or ""
            own[c].append(((t is not None, t or 0), md5(f"{len(r.encode())}:{r}{x}".encode()).hexdigest(), r, x))
    own = {c: [v[2:] for v in sorted(v)] for c, v in own.items()}
    members, ends, kids, leaves, saved = defaultdict(list), defaultdict(list), Counter(), Counter(), Counter()
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        v = own.get(c - int(math.fmod(c, 100)), [])[:h] + v[h:]
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
        ends[tuple(v)].append(c)
    for p in members:
        if p:
            kids[p[:-1]] += 1
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += kids[p] == 0
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()) for p, m in members.items())


def turns(rng, n):
    out = []
    for c in range(-150, n):
        for t in range(rng.randint(0, 9) if rng.random() < 0.95 else 30):
            out.append((c if rng.random() < 0.99 else None, t if rng.random() < 0.97 else None, rng.choice(["u", "a", None, ""]), rng.choice(["a", "ä" * 9, "", None, "b"]) if rng.random() < 0.99 else "long " * 20_000, "x", "y"))
    return out


@pytest.mark.parametrize("cells,least", [(40, 4), (3000, 16)])
def test_op11_nodes_are_those_of_brute_force_over_many_blocks(spark, monkeypatch, cells, least):
    monkeypatch.setattr(prefix_trie, "CELLS", cells)
    monkeypatch.setattr(prefix_trie, "LEAST", least)
    monkeypatch.setattr(prefix_trie, "IDS", 3)
    monkeypatch.setattr(prefix_trie, "BROADCAST", cells)
    rows = turns(random.Random(cells), 250)
    rows += [(1000 + i, 0, "u", "the same", "x", "y") for i in range(400)] + [(1000 + i, 1, "a", f"{i % 2}", "x", "y") for i in range(200)]
    got = prefix_trie.trie(spark.createDataFrame(rows, TURNS))
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(nodes_of(rows), key=str)


def test_op11_odd_tables(spark):
    empty = spark.createDataFrame([], TURNS)
    assert prefix_trie.trie(empty).count() == 0
    assert prefix_trie.trie(spark.createDataFrame([(None, 1, "u", "x", "", "")], TURNS)).count() == 0
    rows = [(5, None, None, None, "", ""), (5, None, None, None, "", ""), (7, 3, "u", "x", "", "")]
    assert sorted(map(tuple, prefix_trie.trie(spark.createDataFrame(rows, TURNS)).collect()), key=str) == sorted(nodes_of(rows), key=str)


def test_op11_same_as_sql(spark):
    same(prefix_trie.op11_prefix_trie(spark, DATA), prefix_trie.ORACLE)


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def ranking(docs, items, k):
    terms = lambda t: TERM.findall((t or "").translate({i: i + 32 for i in range(65, 91)}))
    held = [(i, Counter(w)) for i, t in docs if (w := terms(t))]
    total, length, df = len(held), sum(sum(c.values()) for _, c in held), Counter(t for _, c in held for t in c)
    out = []
    for item, text in set(items):
        found = []
        for i, c in held:
            m = 100 - 50 + (50 * sum(c.values()) * total) // length
            score = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if c[t])
            if score > 0:
                found.append((-score, i is None, i or 0))
        out += [(item, n + 1, None if null else i, -s) for n, (s, null, i) in enumerate(sorted(found)[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("trees", [(40, 100_000, 4), (4096, 300, 3)])
def test_op12_ranks_are_those_of_brute_force(spark, monkeypatch, trees):
    for name, value in zip(("DOCS", "ENTRIES", "LEAF"), trees):
        monkeypatch.setattr(lexical, name, value)
    monkeypatch.setattr(lexical, "QUERY_BYTES", 500)
    rng = random.Random(5)
    word = lambda: rng.choice(["Éa", "日本", "x1", "THE", "the", "a_b", "ß"]) if rng.random() < 0.5 else f"w{int(rng.paretovariate(0.5)) % 400}"
    text = lambda n: rng.choice([" ", "-", "_", "\n"]).join(word() for _ in range(n))
    docs = [(i, text(rng.randint(0, 60)), "e") for i in range(400)] + [(i, None, "e") for i in (401, None)] + [(None, "the x1 w1 w2", "e"), (3, "the x1", "e"), (3, "the x1", "e"), (9, "", "e"), (10, "\x00 -", "e"), (11, text(40_000), "e")]
    items = [(i, text(rng.randint(1, 30))) for i in range(20)] + [(1, "the w1"), (1, "the w1"), (2, None), (None, "w1 w2 w3"), (4, ""), (5, "nothing holds this1")]
    got = lexical.search(spark.createDataFrame(docs, "doc_id long, text string, score string"), spark.createDataFrame(items, "item_id long, text string"), k=7)
    want = ranking([d[:2] for d in docs], items, 7)
    assert sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in got.collect()), key=str) == want
    none = spark.createDataFrame([], "doc_id long, text string")
    assert lexical.search(none, spark.createDataFrame(items, "item_id long, text string")).count() == 0
    assert lexical.search(spark.createDataFrame(docs, "doc_id long, text string, score string"), spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_op12_bounds_hold_and_prune():
    rng = np.random.default_rng(4)
    sizes = rng.integers(1, 30, 3000)
    terms = np.concatenate([np.sort(rng.choice(40, n, replace=False)) + 40 * int(topic) for n, topic in zip(sizes, rng.integers(0, 12, 3000))])
    first = np.concatenate([[0], np.cumsum(sizes)])
    impacts, weights = rng.integers(1, 10**6, len(terms)), rng.integers(0, 8000, 500)
    tree = lexical.Tree(first, terms, impacts, weights, 16)
    total = np.add.reduceat  # of a document's cells
    scored = 0
    for _ in range(30):
        query = np.unique(rng.choice(40, 6)) + 40 * int(rng.integers(0, 12))
        mine = np.zeros(500, np.int64)
        mine[query] = weights[query]
        scores = total(mine[tree.terms] * tree.impacts, tree.first[:-1])
        for node, (*_, lo, hi, _, _) in enumerate(tree.nodes):
            assert tree.bound(node, query) >= scores[lo:hi].max()
        best = lexical.Best(3)
        scored += tree.search(query, mine, best, np.arange(len(sizes)), np.zeros(len(sizes), bool))
        assert best.scores.tolist() == [s for s in np.sort(scores)[::-1][:3].tolist() if s > 0]
    assert scored < 30 * sum(left < 0 for *_, left, _ in tree.nodes)


def test_op12_same_as_sql(spark):
    same(lexical.op12_lexical(spark, DATA), lexical.ORACLE)


def test_op13_accuracy_on_held_out_rows(spark):
    sf = DATA.replace("0.001", "0.01")
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = language_id.op13_language_id(spark, sf).collect()
    assert len(got) == len(truth) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) >= 0.97
    sure = [r for r in held if r.accepted]
    assert len(sure) >= 0.95 * len(held) and sum(r.lang_pred == truth[r.doc_id] for r in sure) / len(sure) >= 0.99


def test_op13_is_the_smallest_of_compressed_texts(spark):
    rng = random.Random(8)
    bag = {"aa": ["alba", "oru", "mento", "sil"], "bb": ["krag", "thum", "wex", "zod"]}
    rows = [(i, " ".join(rng.choices(bag[x], k=rng.randint(1, 3000))), x, "e", "e") for i, x in enumerate(["aa", "bb"] * 20)]
    odd = [(None, None, None, "e", "e"), (100, None, "aa", "e", "e"), (101, "", "bb", "e", "e"), (102, "12 !? \n", "aa", "e", "e"), (103, "KRAG!! 99 Thum", None, "e", "e"), (103, "KRAG!! 99 Thum", None, "e", "e")]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, score string, Accepted string")
    model = language_id.train(docs)
    assert [x for x, _ in model] == ["aa", "bb"] and all(0 < len(d) <= language_id.DICTIONARY for _, d in model)
    out = language_id.identify(docs, model)
    assert out.columns == ["doc_id", "text", "lang", "lang_pred", "score", "accepted"] and out.count() == len(rows + odd)
    for r in out.collect():
        letters = " ".join(re.findall(r"[^\W\d_]+", (r.text or "").lower()))
        if not letters:
            assert (r.lang_pred, r.score, r.accepted) == ("und", 0.0, False)
        else:
            sizes = language_id.sizes(letters.encode(), tuple(d for _, d in model))
            assert r.lang_pred == model[int(np.argmin(sizes))][0] and 0 < r.score <= 1
            assert r.doc_id < 100 and r.lang_pred == r.lang or r.doc_id == 103 and r.lang_pred == "bb"
    assert language_id.identify(docs, []).filter("lang_pred <> 'und' or score <> 0").count() == 0
    assert language_id.train(docs.limit(0)) == [] and language_id.identify(docs.limit(0), model).count() == 0
    one = language_id.identify(docs, model[:1]).filter("lang_pred <> 'und'")
    assert one.filter("lang_pred <> 'aa' or score <> 1.0 or not accepted").count() == 0
