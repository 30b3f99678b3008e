"""Neighbouring lines and their n-grams against plain versions."""

from pyspark.sql import functions as F

from quire.operators import lines as L
from quire.operators import metrics as M


def test_line_pairs(spark):
    d = spark.createDataFrame([(1, "a\n\nb"), (2, "one"), (3, ""), (4, None), (5, "x\n")], "doc_id int, text string")
    p = L.line_pairs(d)
    assert "Exchange" not in p._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, p.collect())) == [(1, 0, "a", ""), (1, 1, "", "b"), (5, 0, "x", "")]


def test_ngram_recalls(spark):
    some = ["", "a", "abc", "kitten", "sitting", "é😀b", "😀", "ab" * 70, "ba" * 64 + "c"]
    rows = [(x, y) for x in some for y in some]
    d = spark.createDataFrame([*rows, (None, "a"), ("a", None)], "a string, b string").coalesce(1)
    got = d.select("a", "b", M.ngram_recalls(F.col("a"), F.col("b"), 3).alias("r")).collect()
    assert len(got) == len(rows) + 2
    for a, b, r in got:
        if a is None or b is None:
            assert r == [None] * 3
            continue
        grams = lambda t, n: {t[i : i + n] for i in range(len(t) - n + 1)}
        assert r == [len(grams(a, n) & grams(b, n)) / max(1, len(grams(a, n))) for n in (1, 2, 3)]
