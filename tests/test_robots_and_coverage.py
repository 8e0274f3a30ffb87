from tidemark.operators import coverage, robots

ROBOTS = """User-agent: other
Disallow: /

User-agent: tide
User-agent: *
Disallow: /private # no
Allow: /private/open
Crawl-delay: 3
Crawl-delay: -1
User-agent: *
Disallow: /all
"""


def test_groups_and_longest_match(spark):
    rules = robots.parse(spark.createDataFrame([("o", ROBOTS)], "origin string, text string"), "tidemark/1 (x)")
    assert {(r.pattern, r.is_allow, r.crawl_delay) for r in rules.collect()} == {("/private", False, 3.0), ("/private/open", True, 3.0)}
    asked = spark.createDataFrame([("o", p) for p in ("/", "/private/x", "/private/open/y", "/all")] + [("other", "/private")], "origin string, path string")
    got = {(r.origin, r.path): r.allowed for r in robots.decide(asked, rules, ["origin", "path"]).collect()}
    assert got == {("o", "/"): True, ("o", "/private/x"): False, ("o", "/private/open/y"): True, ("o", "/all"): True, ("other", "/private"): True}


def test_coverage(spark):
    schema = "source_id string, ok boolean, not_modified boolean, urls array<string>, explicit_empty boolean"
    outcomes = spark.createDataFrame([("a", True, False, ["x"], False), ("b", True, True, [], False), ("c", True, True, [], False), ("c", True, False, ["y"], False), ("d", True, False, [], True), ("e", True, False, [], False), ("f", False, False, [], False)], schema)
    sources = spark.createDataFrame([(x,) for x in "abcdefg"], "source_id string")
    got = {r.source_id: r.coverage for r in coverage.discovery(outcomes, sources).collect()}
    assert got == {"a": "COMPLETE", "b": "UNCHANGED", "c": "PARTIAL", "d": "COMPLETE", "e": "PARTIAL", "f": "PARTIAL", "g": "PARTIAL"}
    failed = spark.createDataFrame([("a",), ("b",)], "source_id string")
    lower = {r.source_id: r.coverage for r in coverage.downgrade(coverage.discovery(outcomes, sources), failed).collect()}
    assert lower["a"] == "PARTIAL" and lower["b"] == "UNCHANGED" and lower["d"] == "COMPLETE"
