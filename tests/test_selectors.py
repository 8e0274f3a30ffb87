"""Selectors against a plain walk over a tree, their cost on a large page, and the parsers that use them."""

import json
import random
import time
from datetime import datetime

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.functions import dates
from tidemark.sources import detail, html_nodes, jsonld, profiles, selectors


def page(spark, body, url="https://x/p"):
    return spark.createDataFrame([("s", url, body)], "source_id string, url string, body string")


def matches(rows, scope, selector):
    """(scope, element) by looking at each pair of elements."""
    parent, open_ = {}, []
    for r in rows:
        while open_ and open_[-1].last < r.n:
            open_.pop()
        parent[r.n] = open_[-1].n if open_ else -1
        if r.tag != "#text":
            open_.append(r)
    by = {r.n: r for r in rows}

    def fulfils(n, steps, top):
        r = by[n]
        if not steps[-1].holds(r.tag, dict(r.attrs)):
            return False
        if len(steps) == 1:
            return parent[n] == top if steps[0].child else True
        up = parent[n]
        while up != top and up != -1:
            if fulfils(up, steps[:-1], top):
                return True
            if steps[-1].child:
                return False
            up = parent[up]
        return False

    elements = [r for r in rows if r.tag != "#text"]
    tops = [-1] if not scope else [r.n for r in elements if any(fulfils(r.n, s, -1) for s in selectors.compiled(scope))]
    inside = lambda n, top: top == -1 or by[top].n < n <= by[top].last
    return sorted((t, r.n) for t in tops for r in elements if inside(r.n, t) and any(fulfils(r.n, s, t) for s in selectors.compiled(selector)))


def test_selectors_find_what_a_walk_finds(spark):
    rng = random.Random(7)

    def tree(depth):
        inner = "".join(tree(depth - 1) if rng.random() < 0.8 else "t " for _ in range(rng.randint(0, 4))) if depth else "x"
        tag = rng.choice(["div", "p", "ul"])
        return f'<{tag} class="{" ".join(rng.sample(["a", "b", "c"], rng.randint(0, 2)))}"{rng.choice(["", " id=k", " href=/A1"])}>{inner}</{tag}>'

    nodes = html_nodes.nodes(page(spark, "<br>top" + "".join(tree(6) for _ in range(4)))).cache()
    rows = nodes.orderBy("n").collect()
    fields = {"a": ".a", "child": ":scope > .b", "deep": "div .a > p", "list": "ul.a.b, p[href]", "three": ".a .b .c", "part": '[href*="a"] *', "id": "#k > #k"}
    for scope in ("", ".a", "div > .b", "p .c"):
        got = selectors.within(nodes, scope, fields).collect()
        for name, css in fields.items():
            assert sorted({(r.row, r.n) for r in got if r.field == name}) == sorted(set(matches(rows, scope, css))), (scope, name)
        texts = {r.n: r.text for r in rows if r.tag == "#text"}
        for r in got:
            assert [(p.n, p.t) for p in r.pieces] == [(n, texts[n]) for n in range(r.n, r.last + 1) if n in texts]
    for bad in ("", "a >", "> >", "a:first-child", "a, ", "b :scope"):
        with pytest.raises(ValueError):
            selectors.compiled(bad)


def test_rows_out_of_order_are_noticed(spark):
    nodes = html_nodes.nodes(page(spark, "<p>a</p><p>b</p>")).orderBy(F.desc("n"))
    with pytest.raises(Exception, match="in order"):
        selectors.within(nodes, "", {"p": "p"}).count()


def test_time_grows_with_the_rows_of_a_page(spark):
    def taken(n):
        body = "<table class='ce-table'>" + "<tr><td>1.5.2030</td><td>10:00</td><td>T</td></tr>" * n + "</table>"
        matcher, tree = selectors.Page("s", "u", "table.ce-table tr", ["cell"], ["td"]), html_nodes.Nodes()
        tree.feed(body)
        tree.close()
        at = time.process_time()
        for i in range(len(tree.last)):
            matcher.node(i, tree.last[i], tree.depth[i], tree.tag[i], dict(tree.attrs[i]), tree.text[i])
        matcher.end()
        assert len(matcher.done) == 3 * n
        return time.process_time() - at

    assert taken(10_000) < 12 * max(taken(2_000), 0.02)
    deep = "<div>" * 3000 + "x" + "</div>" * 3000
    assert selectors.within(html_nodes.nodes(page(spark, deep)), "", {"d": "div div"}).count() == 2999


def test_detail_page(spark):
    body = """<h1 class="d1i-head__title">Weekend</h1><div id="descriptionText"><div class="toujou-text-clamper__content">15.08.2026-16.08.2026. Beginn ist jeweils um 10 Uhr und Ende gegen 19 Uhr.</div></div>
    <section id="d1iAddressesSection"><address class="d1i-address"><p class="d1i-address__info">Field</p><p class="d1i-address__info">1 Town</p></address>
    <address class="d1i-address"><h4 class="d1i-section__subtitle">Kontakt</h4><p class="d1i-address__info">Nobody</p><h4 class="d1i-section__subtitle">VERANSTALTER</h4><p class="d1i-address__info">Club</p></address></section>"""
    pages = page(spark, body, "https://x/fair-12/?a=1")
    r = detail.parse(pages, html_nodes.nodes(pages)).first()
    assert (r.title, r.start, r.end, r.all_day) == ("Weekend", datetime(2026, 8, 15, 8), datetime(2026, 8, 16, 17), False)
    assert (r.location, r.organizer, r.event_url, r.source_x_id) == ("Field, 1 Town", "Club", "https://x/fair-12/?a=1", "detail:12:2026-08-15T10:00:00+02:00")
    for without in (body.replace("Weekend", " "), body.replace("2026", "later"), ""):
        assert detail.parse(page(spark, without), html_nodes.nodes(page(spark, without))).count() == 0


def test_jsonld_odd_pages(spark):
    script = lambda t: f'<script type="application/ld+json">{t}</script>'
    event = '{"@type":"Event","name":"N","startDate":"2026-05-01","eventStatus":"%s"}'
    body = script("[" * 200_000) + script("{") + script("7") + script(event % "x/EventRescheduled") + script(event.replace('"N"', '["A","B","A"]') % "eventcancelled")
    got = {r.title: r.status for r in jsonld.parse(page(spark, body)).collect()}
    assert got == {"N": "TENTATIVE", "A, B": "CANCELLED"}
    said = json.dumps({"@type": "Event", "name": "N", "startDate": "2026-05-01", "description": "<p>Bread &amp; wine</p><style>x</style> 2 &lt; 3<br>end"})
    assert jsonld.parse(page(spark, script(said))).first().description == "Bread & wine 2 < 3 end"


def test_markup_is_recognised_by_the_profile(spark):
    pages = spark.createDataFrame([("a", "u1", "<main><div class='wrapper-inner'><a title='Impressum'>x</a></div></main>", "cards"), ("a", "u2", "<div class='veranstaltungen'><p><b class='entryBody'></b></p></div>", "dated-list"), ("a", "u3", "<b class='entryBody'></b>", "dated-list"), ("a", "u4", "<table class='ce-table'>", "table-rows")], "source_id string, url string, body string, profile string")
    assert {r.url for r in profiles.recognised(pages, html_nodes.nodes).collect()} == {"u2", "u4"}


def test_plain_markup_is_read_as_the_parser_reads_it():
    rng = random.Random(3)
    bits = ["<p>", "</p>", '<P Class="a b">', '<div id="x" class>', "</DIV>", "<br>", "<br/>", "<a href=x>", '<a href="?a=1&amp;b">', "</a>", "t ", "\n", "a &amp; b", "&lt", "< b", "</", "</p >", "<!-- c -->", "<script>x<y</script>", "<title>a<b></title>", "<nav>", "</nav>", '<img src="a" src="b">', '<p class="a"id="b">', "<?x?>"]
    plain = 0
    for _ in range(5000):
        body = "".join(rng.choice(bits) for _ in range(rng.randint(0, 8)))
        one, two = html_nodes.Nodes(), html_nodes.Nodes()
        one.feed(body)
        one.close()
        two.read(body)
        plain += sum(map(len, html_nodes.PLAIN.findall(body))) == len(body)
        assert [one.last, one.depth, one.tag, one.attrs, one.text] == [two.last, two.depth, two.tag, two.attrs, two.text], body
    assert 500 < plain < 4500


def test_pages_are_gathered_without_a_shuffle(spark):
    body = "<main><div class='wrapper-inner'><h2 class='ce_headline'>T</h2><div class='ce_text'><p><strong>1.5.2030</strong>: much</p></div><a href='/e' title='Zur Veranstaltung'>x</a></div></main>"
    pages = page(spark, body).unionByName(page(spark, "", "https://x/q"))
    for name in ("cards", "listing", "table-rows"):
        assert "Exchange" not in profiles.parse(pages, pages, name)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in detail.parse(pages, pages)._jdf.queryExecution().executedPlan().toString()
    once, rows = profiles.parse(pages, pages, "cards").collect(), profiles.parse(pages, html_nodes.nodes(pages), "cards").collect()
    assert once == rows and [r.description for r in once] == ["much"]


def test_jsonld_pages_share_a_batch():
    event = '{"@type":"Event","name":"%s","startDate":"2030-01-01"}'
    said = lambda names: f'<script type="application/ld+json">[{",".join(event % n for n in names)},7,"x"]</script>'
    pages = [[f"p{i}-{k}" for k in range(i % 4)] for i in range(900)] + [[f"many-{k}" for k in range(2 * jsonld.ROWS)], ["last"]]
    bodies = [None, "<p>none</p>", *map(said, filter(None, pages))]
    given = pa.RecordBatch.from_arrays([pa.array(c) for c in (["s"] * len(bodies), [f"u{i}" for i in range(len(bodies))], ["h"] * len(bodies), bodies)], ["source_id", "url", "raw_content_hash", "body"])
    got = list(jsonld._read(iter([given])))
    assert len(got) == 2
    rows = [(r["row"], r["name"]) for b in got for r in b.to_pylist()]
    assert rows == [(k, n) for names in pages for k, n in enumerate(names)]


def by_fields(body, searches, attrs):
    """What gathered gives for a page, from the parser's tree, one field at a time."""
    tree, out = html_nodes.Nodes(), {}
    tree.feed(body)
    tree.close()
    for name, (scope, fields) in searches.items():
        found = selectors.Page("", "", scope, list(fields), list(fields.values())).all(tree)
        out[name] = [
            {"row": row} | {f: [{"n": m[4], "t": " ".join(t for _, t in m[8]) or None} | {a: dict(m[7]).get(a) for a in attrs.get(f, ())} for m in sorted(found, key=lambda m: m[4]) if m[2:4] == (row, f)] for f in fields}
            for row in sorted({m[2] for m in found})
        ]
    return out


SEARCHES = {"page": ("", {"title": "p > b", "link": "a[href]"}), "box": ("div.box", {"p": "p, b", "other": "p:not(.a)", "deep": ":scope > * .a"})}
BITS = ["<p>", "</p>", '<P Class="a b">', '<p class="ab">', '<div class="box">', "</DIV>", "<br>", "<br/>", "<b>", "</b>", '<a href="/%d">', '<a href="?a=1&amp;b">', "<a href=x%d>", "<a>", "</a>", "t%d ", " \n", "a &amp; b", "1 > 0", ">", "< b", "</", "<>", "<!-- c -->", "<script>x<y</script>", "<nav>", "</nav>"]


def test_pages_of_a_shape_give_what_the_parser_gives():
    rng = random.Random(5)
    shapes = selectors.Shapes(SEARCHES, {"link": ("href", "class")})
    for k in range(6000):
        body = "".join(rng.choice(BITS) for _ in range(rng.randint(0, 9))).replace("%d", str(k))
        page = pa.RecordBatch.from_arrays([pa.array([body])], ["body"])
        got = selectors._with_found(page, [shapes.find(body)], SEARCHES, {"link": ("href", "class")}).to_pylist()
        assert got == [by_fields(body, SEARCHES, {"link": ("href", "class")})], body


def test_a_shape_is_searched_once(monkeypatch):
    searched = []
    whole = selectors.Page.all
    monkeypatch.setattr(selectors.Page, "all", lambda self, tree: searched.append(1) or whole(self, tree))
    shapes = selectors.Shapes(SEARCHES, {"link": ("href",)})
    for k in range(300):
        shape, texts, links = shapes.find(f'<div class="box"><p id="n{k}">one {k}</p><a href="/{k}">x</a></div>')
        assert (texts, links) == (["x", f"one {k}", f"one {k}"], [f"/{k}"])
    assert len(searched) == len(SEARCHES)
    shapes.find('<div class="box"><p>one</p><a href="/"> </a></div>')  # no text in the link: a shape of its own
    assert len(searched) == 2 * len(SEARCHES) and len(shapes.known) == 2


def test_what_shapes_remember_is_bounded(monkeypatch):
    monkeypatch.setattr(selectors, "MOST", 20)
    monkeypatch.setattr(selectors, "MOST_IN_SHAPES", 50)
    shapes = selectors.Shapes(SEARCHES, {})
    for k in range(200):
        body = f'<x{k}><div class="box">' + f'<p id="{k}">t</p>' * (k % 9)
        assert selectors._with_found(pa.RecordBatch.from_arrays([pa.array([body])], ["body"]), [shapes.find(body)], SEARCHES, {}).to_pylist() == [by_fields(body, SEARCHES, {})]
        assert shapes.size <= 50 and len(shapes.kinds) <= 20 and len(shapes.names) <= 30


def test_a_class_that_is_lacking(spark):
    nodes = html_nodes.nodes(page(spark, '<p class="a b">1</p><p class="a">2</p><p class="ab a">3</p><p>4</p>'))
    found = selectors.within(nodes, "", {"a": ".a:not(.b)", "p": "p:not(.a)"}).collect()
    assert sorted((r.field, r.pieces[0].t) for r in found) == [("a", "2"), ("a", "3"), ("p", "4")]


def test_detail_addresses_are_governed_by_labels(spark):
    rng = random.Random(11)
    kinds = [("line", "d1i-address__info"), ("linked", "d1i-address__info d1i-address__info--with-link"), ("label", "d1i-section__subtitle")]
    bodies, want = {}, {}
    for k in range(60):
        blocks, location, organizer = [], None, None
        for b in range(rng.randint(0, 3)):
            label, lines, mine, inside = None, [], None, ""
            for i in range(rng.randint(0, 5)):
                kind, css = rng.choice(kinds)
                t = rng.choice(["", "VERANSTALTER", "Kontakt"] if kind == "label" else ["", f"L{i}", "Town"])
                inside += f'<p class="{css}">{t}</p>'
                if t and kind == "label":
                    label = t.lower()
                elif t:
                    lines += [t] if kind == "line" else []
                    mine = mine or (t if label == "veranstalter" else None)
            blocks.append(f'<address class="d1i-address">{inside}</address>')
            # a block in which nothing is selected isn't one
            if location is None and inside:
                location = ", ".join(dict.fromkeys(lines)) or ""
            organizer = organizer or mine
        bodies[f"https://x/fair-{k}"] = f'<h1 class="d1i-head__title">T</h1><div id="descriptionText"><div class="toujou-text-clamper__content">1.5.2030</div></div><section id="d1iAddressesSection">{"".join(blocks)}</section>'
        want[f"https://x/fair-{k}"] = (location or None, organizer)
    pages = spark.createDataFrame([("s", u, b) for u, b in bodies.items()], "source_id string, url string, body string")
    for nodes in (pages, html_nodes.nodes(pages)):
        assert {r.url: (r.location, r.organizer) for r in detail.parse(pages, nodes).collect()} == want


def test_dates_of_detail_pages_are_read_once(spark):
    pages = page(spark, "")
    assert detail.parse(pages, pages)._jdf.queryExecution().executedPlan().toString().count(dates._SPAN) == 1
