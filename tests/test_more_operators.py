import os

import pytest
from pyspark.sql import functions as F

from quire.operators import blocks as B
from quire.operators import grid as D
from quire.operators import pages as P
from quire.operators import routing as R


def box(spark, rows):
    return spark.createDataFrame([(1, i, k, *map(float, r)) for i, (k, *r) in enumerate(rows)], "p int, el_idx int, element_type string, x_min double, x_max double, y_min double, y_max double")


CELLS = [(x, x + 60, y, y + 10, t) for y, row in ((10, ("ID", "Name")), (40, ("1", "first")), (70, ("2", "second"))) for x, t in zip((10, 300), row)]


def regions(spark, rows):
    return spark.createDataFrame([(1, i, *map(float, r[:4]), r[4]) for i, r in enumerate(rows)], "p int, region_idx int, x_min double, x_max double, y_min double, y_max double, text string")


def test_image_tables(spark):
    r = regions(spark, [*CELLS, (10, 380, 400, 410, "below")])
    image, page = ("image", 0, 400, 0, 100), ("text", 0, 400, 390, 420)
    g = D.image_tables(r, box(spark, [image, page]), ["p"]).first()
    assert g["cols"] == 2 and [c["text"] for c in g["header"]] == ["ID", "Name"] and len(g["rows"]) == 2
    figure = ("figure_title", 0, 400, 100, 110)
    assert D.image_tables(r, box(spark, [image, page, figure]), ["p"]).count() == 0
    assert D.image_tables(r, box(spark, [image, page, figure, ("table_title", 0, 400, 0, 5)]), ["p"]).count() == 1
    assert D.image_tables(r.where("text = 'below'"), box(spark, [image, page]), ["p"]).count() == 0


def test_structure_grid(spark):
    c = spark.createDataFrame([(1, 0, 0, "a"), (1, 0, 1, "b"), (1, 1, 1, None), (2, 0, 0, "x")], "p int, row int, col int, text string")
    g = D.from_structure(c, ["p"]).collect()
    assert [([x["text"] for x in r["header"]], [[x["text"] for x in v] for v in r["rows"]]) for r in g] == [(["a", "b"], [["", ""]])]
    box = [(1, r, k, x0, x1, 10.0 * r, 10.0 * r + 5, t) for r, k, x0, x1, t in ((1, 0, 5.0, 15.0, "No"), (1, 1, 20.0, 40.0, "Name"), (2, 0, 5.0, 15.0, None), (2, 1, 20.0, 40.0, ""))]
    c = spark.createDataFrame(box, "p int, row int, col int, x_min double, x_max double, y_min double, y_max double, text string").withColumn("row", F.col("row") - 1)
    g = D.from_structure(c, ["p"], regions(spark, [(5, 15, 20, 25, "7"), (20, 40, 20, 25, "x"), (20, 40, 20, 25, "later"), (300, 310, 20, 25, "far")])).first()
    assert [x["text"] for x in g["rows"][0]] == ["7", "x"] and g["cols"] == 2


def test_fallback_elements(spark):
    e = box(spark, [("text", 0, 9, 0, 9), ("text", 0, 9, 10, 19), ("text", 0, 9, 20, 29)]).withColumn("order_index", F.lit(None).cast("int"))
    b = spark.createDataFrame([(1, 0, 2, [0]), (1, 1, 1, [2, 1]), (1, 2, None, [0])], "p int, rb_idx int, order_index int, element_indices array<int>")
    assert [r["el_idx"] for r in B.fallback_elements(b, e, ["p"]).orderBy("block_rank").collect()] == [1, 2, 0]


def test_precedence_and_errors(spark):
    d = spark.createDataFrame([("g", "t", "b"), (None, "t", "b"), (None, None, "b")], "g string, t string, b string")
    assert [r[0] for r in d.select(P.precedence(F.col("g"), F.col("t"), F.col("b"))).collect()] == ["g", "t", "b"]
    e = spark.createDataFrame([("a", None, "x"), ("b", 1, "y")], "doc_id string, page int, error string")
    assert [tuple(r) for r in R.document_errors(e).collect()] == [("a", "x")]


# grids in plain loops ------------------------------------------------------------------------------------------------


def plain_rows(items, tol, gap):
    rows = []
    for r in sorted(items, key=lambda r: (r["y_min"], r["region_idx"])):
        if rows and abs(rows[-1][0]["y_min"] - r["y_min"]) <= tol:
            rows[-1].append(r)
        else:
            rows.append([r])
    out = []
    for row in rows:
        cells = []
        for r in sorted(row, key=lambda r: (r["x_min"], r["region_idx"])):
            if cells and r["x_min"] - cells[-1][-1]["x_max"] <= gap:
                cells[-1].append(r)
            else:
                cells.append([r])
        made = []
        for c in cells:
            text = ""
            for r in c:
                text += (" " if text[-1:].isalnum() and text[-1:].isascii() and r["text"][:1].isalnum() and r["text"][:1].isascii() else "") + r["text"].strip()
            made.append({"text": text, "x": c[0]["x_min"], "y": c[0]["y_min"], "h": max(r["y_max"] - r["y_min"] for r in c)})
        out.append(made)
    return out


def upper(v, default):
    v = sorted(v)
    return v[len(v) // 2] if v else default


def plain_grid(items, page_w, tolerant):
    if len(items) < 4:
        return None
    coarse = plain_rows(items, max(upper([r["y_max"] - r["y_min"] for r in items], 10.0) * 0.8, 2.0), 0.012 * page_w)
    mid = [sum(c["y"] for c in r) / len(r) for r in coarse]
    pitch = upper([abs(a - b) for a, b in zip(mid, mid[1:])], 12.0)
    rows = plain_rows(items, min(max(pitch * 0.5, 4.0), max(page_w * 0.3, 4.0)), 0.012 * page_w)
    rows = [r for r in rows if len(r) >= 2]
    cols = max((k for k in {len(r) for r in rows} if sum(len(r) == k for r in rows) >= 2), default=0)
    if cols < 2:
        return None
    centers = [upper([r[c]["x"] for r in rows if len(r) == cols], 0) for c in range(cols)]
    placed = []
    for r in rows:
        a = [None] * cols
        for cell in r:
            k = min(range(cols), key=lambda c: (abs(cell["x"] - centers[c]), c))
            if a[k] is None or not a[k]["text"] or cell["x"] < a[k]["x"]:
                a[k] = cell
        placed.append(a)
    tol = max(0.02 * page_w, 10.0)
    for c in range(cols):
        xs = [r[c]["x"] for r in placed[1:] if r[c] and r[c]["text"]]
        if len(xs) >= 2:
            if tolerant and sum(abs(x - upper(xs, 0)) > tol for x in xs) * 100 > len(xs) * 30 or not tolerant and max(xs) - min(xs) > tol:
                return None
    return [[c["text"] if c else "" for c in r] for r in placed]


SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("image", [False, True])
def test_grids_plain(spark, image):
    from quire.plans import adapters as A
    from quire.plans import catalog

    pages = {}
    for r in A.regions(spark, SF).collect():
        pages.setdefault(r["doc_id"], []).append(r.asDict())
    want = {}
    for doc, items in pages.items():
        page_w = max(max(r["x_max"] for r in items), 0.0)
        if image:
            if doc % 7 == 0:
                continue
            tw, th, lw, lh = page_w, max(r["y_max"] for r in items), 400.0 if doc % 3 == 0 else 1200.0, 160.0
            items = [r for r in items if 0 <= (r["x_min"] + r["x_max"]) / 2 / tw <= 1 and 0 <= (r["y_min"] + r["y_max"]) / 2 / th <= 160.0 / lh and lw]
        g = plain_grid(items, page_w, image)
        if g is None:
            continue
        some = [t for r in g for t in r if t]
        if image and (len(some) * 100 < len(g) * len(g[0]) * 50 or len(g[0]) == 2 and sum(len(t) >= 15 for t in some) * 10 > len(some) * 6):
            continue
        want[doc] = (len(g[0]), len(g) - 1)
    name = "image_tables" if image else "grid_reconstruct"
    got = {r["doc_id"]: (r["cols"], r["n_rows"]) for r in catalog.QUERIES[name](spark, SF).collect()}
    assert got == want and len(want) > 20


def plain_html(header, rows, cols):
    """Cells written where nothing covers them, from a matrix of owners."""
    esc = lambda t: t.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    tops = [[c[1] for c in r if c[0]][0] for r in [header, *rows] if any(c[0] for c in r)]
    pitch = max(upper([abs(a - b) for a, b in zip(tops, tops[1:])], 12.0), 4.0) if len(tops) > 1 else 12.0
    covered = [[False] * cols for _ in rows]
    down = [[1] * cols for _ in rows]
    for i, r in enumerate(rows):
        for k, (t, _, h) in enumerate(r):
            if t and h > pitch * 1.5:
                down[i][k] = max(1, min(int(h / pitch + 0.5), len(rows) - i))
                for u in range(i + 1, i + down[i][k]):
                    covered[u][k] |= not rows[u][k][0]

    def line(texts, hidden, downs):
        owner = []
        for k, t in enumerate(texts):
            owner.append(None if hidden[k] else k if t or k == 0 or hidden[k - 1] else owner[-1])
        return "".join(f"<td{f' colspan={chr(34)}{owner.count(k)}{chr(34)}' * (owner.count(k) > 1)}{f' rowspan={chr(34)}{downs[k]}{chr(34)}' * (downs[k] > 1)}>{esc(texts[k])}</td>" for k in sorted({o for o in owner if o is not None}))

    flat = [False] * cols
    out = line([c[0] for c in header], flat, [1] * cols)
    return f"<table><thead><tr>{out}</tr></thead><tbody>" + "".join(f"<tr>{line([c[0] for c in r], covered[i], down[i])}</tr>" for i, r in enumerate(rows)) + "</tbody></table>"


def test_html_plain(spark):
    import random

    rng = random.Random(4)
    grids = []
    for n in range(150):
        cols, height = rng.randrange(2, 6), rng.randrange(0, 7)
        cell = lambda i: (rng.choice(["", "", "a", "b<", "c & d"]), float(20 * i + rng.randrange(3)), float(rng.choice([8, 10, 25, 45, 70])))
        grids.append((n, cols, [cell(0) for _ in range(cols)], [[cell(i + 1) for _ in range(cols)] for i in range(height)]))
    c = "struct<text:string,y:float,h:float>"
    d = spark.createDataFrame(grids, f"n int, cols int, header array<{c}>, rows array<array<{c}>>")
    got = {r["n"]: r["html"] for r in d.select("n", D.to_html(d).alias("html")).collect()}
    for n, cols, header, rows in grids:
        assert got[n] == plain_html(header, rows, cols), n
    assert sum("rowspan" in h for h in got.values()) > 30
