import random
import re

import pytest
from pyspark.sql import functions as F

from quire import schema as S
from quire.operators import blocks as B
from quire.operators import columns as C
from quire.operators import furniture as U
from quire.operators import grid as D
from quire.operators import lines as L
from quire.operators import metrics as M
from quire.operators import pages as P
from quire.operators import routing as R


def lines(spark, rows):
    return spark.createDataFrame([(1, i, t) for i, t in enumerate(rows)], "doc_id int, n int, line string")


def regions(spark, rows, page=1):
    return spark.createDataFrame([(page, i, *map(float, r[:4]), r[4]) for i, r in enumerate(rows)], "p int, region_idx int, x_min double, x_max double, y_min double, y_max double, text string")


def out(df, order, col="line"):
    return [r[col] for r in df.orderBy(order).collect()]


@pytest.mark.parametrize("rows,want", [(["mainten-", "ance done", "hello"], ["maintenance done", "hello"]), (["well-", "Known"], ["well-", "Known"]), (["a- ", " b-", "c"], ["abc"]), ([], [])])
def test_hyphens(spark, rows, want):
    assert out(L.merge_hyphens(lines(spark, rows), ["doc_id"], "n"), "n") == want


@pytest.mark.parametrize("ys,rows,want", [([100, 110, 120, 200], ["a", "b", "c", "d"], ["abc", "d"]), ([100, 110], ["1 head", "body"], ["1 head", "body"]), ([5], ["x"], ["x"])])
def test_paragraphs(spark, ys, rows, want):
    d = spark.createDataFrame([(1, i, float(y), t) for i, (y, t) in enumerate(zip(ys, rows))], "doc_id int, n int, y double, line string")
    assert out(L.paragraphs(d, ["doc_id"], "n", "y"), "n") == want


@pytest.mark.parametrize("rows,want", [(["b)", "x"], ["b) x"]), (["b)", "# t"], ["b)", "# t"]), (["a)", "b)", "x"], ["a)", "b) x"]), (["c)", "52", " x"], ["52", "c) x"]), (["c)", "52"], ["52", "c)"]), (["x", "c)"], ["x", "c)"])])
def test_markers(spark, rows, want):
    assert out(L.pair_markers(lines(spark, rows), ["doc_id"], "n"), "pos") == want


def test_furniture(spark):
    rows = [("d", p, "Header", 1.0) for p in range(1, 6)] + [("d", 6, "body", 5.0)] + [("d", p, f"text {p}", 9.0) for p in range(1, 7)] + [("e", 1, "Header", 1.0), ("e", 2, "Header", 1.0)]
    d = spark.createDataFrame(rows, "doc string, page int, text string, y double")
    left = U.strip_furniture(d, "doc", "page", "text", ["y"])
    assert left.where("text = 'Header'").count() == 2 and left.count() == 9


TWO = [(50, 450, y, y + 10, f"L{i}") for i, y in enumerate((100, 200, 300))] + [(550, 950, y, y + 10, f"R{i}") for i, y in enumerate((100, 200, 300))]


@pytest.mark.parametrize(
    "rows,want",
    [
        (TWO, ["L0", "L1", "L2", "R0", "R1", "R2"]),
        ([(0, 1000, 20, 30, "head"), *TWO, (0, 1000, 400, 410, "foot")], ["head", "L0", "L1", "L2", "R0", "R1", "R2", "foot"]),
        ([(0, 700, -300, -290, "a"), (0, 90, -100, -90, "c"), (0, 500, -200, -190, "b")], ["a", "b", "c"]),
    ],
)
def test_reading_order(spark, rows, want):
    assert out(C.reading_order(regions(spark, rows), ["p"]), "pos", "text") == want
    moved = [(a + 7, b + 7, *r) for a, b, *r in rows]
    assert out(C.reading_order(regions(spark, moved).repartition(3), ["p"]), "pos", "text") == want


def test_vertical(spark):
    rows = [(900, 920, 0, 200, "r1"), (900, 920, 210, 400, "r2"), (800, 820, 0, 200, "l"), (0, 700, 500, 520, "flat")]
    got = C.vertical_paragraphs(regions(spark, rows), ["p"]).orderBy("col_no").collect()
    assert [r["text"] for r in got] == ["r1\nr2", "l"]


def test_gutter(spark):
    rows = [(1, n, i, x, 150.0) for n in range(4) for i, x in enumerate((25.0, 230.0))]
    d = spark.createDataFrame(rows, "p int, line_no int, item_idx int, x double, width double")
    assert C.gutter(d, ["p"]).first()["gutter"] == 202.5
    assert C.gutter(d.where("line_no < 2"), ["p"]).first()["gutter"] is None


def test_blocks(spark):
    r = regions(spark, [(10, 90, 10, 20, "one"), (10, 90, 110, 120, "two"), (10, 90, 300, 310, "left"), (10, 90, 400, 410, "foot")])
    e = spark.createDataFrame([(1, 0, "text", 2, 0.0, 100.0, 0.0, 50.0), (1, 1, "text", 1, 0.0, 100.0, 100.0, 150.0), (1, 2, "footer", None, 0.0, 100.0, 390.0, 410.0)], "p int, el_idx int, element_type string, order_index int, x_min double, x_max double, y_min double, y_max double")
    got = B.assemble(r, e, ["p"]).orderBy("block_rank", "pos").collect()
    assert [x["text"] for x in got] == ["two", "one", "left"]


GRID = [(x, x + 50, y, y + 10, t) for y, row in ((0, ("ID", "Name")), (20, ("1", "first long name")), (40, ("2", "second long name"))) for x, t in zip((0, 300), row)]


def test_grid(spark):
    g = D.reconstruct(regions(spark, GRID), ["p"])
    r = g.withColumn("html", D.to_html(g)).first()
    assert r["cols"] == 2 and [c["text"] for c in r["header"]] == ["ID", "Name"] and len(r["rows"]) == 2
    assert re.findall("<td>(.*?)</td>", r["html"]) == ["ID", "Name", "1", "first long name", "2", "second long name"]
    assert [len(re.findall("<tr>", p)) for p in r["html"].split("</thead>")] == [1, 2] and r["html"].endswith("</tbody></table>")


def test_no_grid(spark):
    ragged = [(x, x + 100, y, y + 10, "t") for y, xs in ((0, (0, 300)), (20, (0, 420)), (40, (90, 260))) for x in xs]
    assert D.reconstruct(regions(spark, ragged), ["p"]).count() == 0
    assert D.reconstruct(regions(spark, [(0, 50, y, y + 10, "t") for y in range(0, 100, 20)]), ["p"]).count() == 0
    assert D.reconstruct(regions(spark, GRID[:3]), ["p"]).count() == 0


def test_spans():
    c = lambda t, y=0.0, h=10.0: {"text": t, "x": 0.0, "y": y, "h": h}
    html = D._html([c("a"), c("")], [[c("tall", 20, 40), c("x", 20)], [c("", 40), c("y", 40)], [c("z", 60), c("", 60)]], 2)
    assert 'rowspan="2"' in html and html.startswith('<table><thead><tr><td colspan="2">a</td></tr>') and '<td colspan="2">z</td>' in html


def test_false_positive_tables(spark):
    t = spark.createDataFrame([(i,) for i in range(4)], "t int")
    long = "a cell of far more than fifteen"
    cells = [(0, r, c, long) for r in (0, 1) for c in (0, 1)] + [(1, r, c, "s") for r in (0, 1) for c in (0, 1)] + [(2, 0, 0, "x"), (2, 1, 0, "x")]
    d = spark.createDataFrame(cells, "t int, row int, col int, text string")
    assert [r[1] for r in D.false_positive(t, d, ["t"]).orderBy("t").collect()] == [True, False, True, True]


def test_merge_tables(spark):
    cell = lambda t: {"text": t, "x": 0.0, "y": 0.0, "h": 0.0}
    row = lambda *v: [cell(t) for t in v]
    kind = "array<struct<text:string,x:float,y:float,h:float>>"
    g = [("d", 0, 2, True, row("A", "B"), [row("1", "2")]), ("d", 1, 2, True, row("q", "q"), [row("A", "B"), row("3", "4")]), ("d", 2, 3, False, row("a", "b", "c"), [row("5", "6", "7")]), ("d", 4, 3, False, row("a", "b", "c"), [])]
    d = spark.createDataFrame(g, f"doc_id string, page_pos int, cols int, has_header boolean, header {kind}, rows array<{kind}>")
    p = spark.createDataFrame([("d", i) for i in range(5)], "doc_id string, page_pos int")
    got = P.merge_tables(d, p).orderBy("page_pos").collect()
    assert [(r["page_pos"], [[c["text"] for c in x] for x in r["rows"]]) for r in got] == [(0, [["1", "2"], ["3", "4"]]), (2, [["5", "6", "7"]]), (4, [])]


def test_render(spark):
    rows = [("d", 1, "pdf", "body", 0, "# h"), ("d", 1, "pdf", "body", 1, "a"), ("d", 1, "pdf", "body", 2, "## k"), ("d", 1, "pdf", "body", 3, "## m"), ("d", 2, "ofd", "body", 0, "x"), ("d", 2, "ofd", "body", 1, "y"), ("d", 3, "ocr", "body", 0, "t"), ("d", 3, "ocr", "table_html", 0, "<table></table>"), ("d", 4, "pdf", "grid", 0, "<g>"), ("d", 5, "pdf", "body", 0, "  ")]
    d = spark.createDataFrame(rows, "doc string, page int, source string, kind string, pos int, text string")
    s = P.render_pages(d, ["doc", "page"]).withColumn("pos", F.lit(0))
    assert {r["page"]: r["segment"] for r in s.collect()} == {1: "# h\n\na\n\n## k\n\n## m\n\n", 2: "x\ny", 3: "t\n\n\n<table></table>", 4: "<g>\n\n", 5: "  \n"}
    assert P.render_documents(s, "doc", "page", "pos").first()["markdown"] == "# h\n\na\n\n## k\n\n## m\n\nx\ny\n\nt\n\n\n<table></table>\n\n<g>"


def test_decide(spark):
    d = spark.createDataFrame([(e, s, g, b, i, c) for e in (0, 1) for s in (0, 1) for g in (0, 1) for b in (0, 1) for i in (0, 1) for c in ("page", "doc")], "e int, s int, g int, b int, i int, c string")
    for r in d.select("*", R.decide(*[F.col(k) == 1 for k in "esgbi"], F.col("c")).alias("r")).collect():
        assert r["r"] == (("ocr_page" if r["c"] == "page" else "ocr_doc") if r["e"] or r["s"] or r["g"] or (r["b"] and r["i"]) else "text_layer")


def test_confidence(spark):
    v = [[0.95, 0.9, 0.88], [0.3, 0.2, 0.4], [None, None], [0.9, 0.1], [0.9, 0.7]]
    d = spark.createDataFrame([(i, c) for i, cs in enumerate(v) for c in cs], "p int, confidence double")
    assert [r["needs_upgrade"] for r in R.page_quality(d, ["p"]).orderBy("p").collect()] == [False, True, True, True, False]


def test_percentiles(spark):
    d = spark.createDataFrame([(1, float(i)) for i in range(1, 11)] + [(2, 42.0)], "k int, v double")
    assert [tuple(r) for r in M.percentiles(d, ["k"], "v").orderBy("k").collect()] == [(1, 10, 6.0, 10.0, 10.0), (2, 1, 42.0, 42.0, 42.0)]


def test_sequence_scores(spark):
    d = spark.createDataFrame([("abcd", "abxd"), ("", ""), ("abc", "abc")], "a string, b string")
    got = [r[0] for r in d.select(M.sequence_scores(F.col("a"), F.col("b"))).collect()]
    assert got[0]["cer"] == 0.25 and got[0]["ratio"] == 0.75 and got[2]["f1"] == 1.0 and got[1]["recall"] == 1.0


def test_sequence_scores_plain(spark):
    """Ratio and recall against all common runs tried in turn, on texts too short for any letter to be common."""

    def same(a, b):
        n, i, j = max(((n, -i, -j) for i in range(len(a)) for j in range(len(b)) for n in range(1, min(len(a) - i, len(b) - j) + 1) if a[i : i + n] == b[j : j + n]), default=(0, 0, 0))
        return n and n + same(a[:-i], b[:-j]) + same(a[-i + n :], b[-j + n :])

    r = random.Random(4)
    pairs = [tuple("".join(r.choices("abc ", k=r.randrange(12))) for _ in "xy") for _ in range(60)]
    d = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string")
    for i, s in d.select("i", M.sequence_scores(F.col("a"), F.col("b"))).collect():
        a, b = pairs[i]
        m = same(a, b)
        assert s["ratio"] == pytest.approx(2 * m / (len(a) + len(b)) if a or b else 1.0)
        assert s["ratio"] == 1.0 or s["cer"] * max(1, len(a)) >= max(len(a), len(b)) - m - 1e-9


def test_errors(spark):
    d = spark.createDataFrame([("render", 3, "runtime", "x"), ("render", None, "odd", "x")], "s string, p int, k string, d string")
    rows = d.where("k = 'runtime'").select(R.error_text(F.col("s"), F.col("p"), F.col("k"), F.col("d")).alias("t")).collect()
    assert rows[0]["t"] == "[render:page3] runtime: x"
    assert d.where("k = 'odd'").select(R.error_hint(F.col("k")).alias("h")).first()["h"] == S.NO_HINT
