import pytest
from pyspark.sql import functions as F

from quire.functions import geometry as G
from quire.functions import text as X


def values(spark, f, rows):
    d = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string")
    return [r["v"] for r in d.select("i", f(F.col("t")).alias("v")).orderBy("i").collect()]


@pytest.mark.parametrize(
    "f,rows,want",
    [
        (X.title_level, ["1 Introduction", "2.1 Method", "2.1.1 x", "一、引言", "（1）xx", "ABSTRACT", "这是正文句子。", "一) 术语和定义", "1.2.3.4.5.6.7 x", "12", "", "　3　x"], [2, 3, 4, 2, 2, 2, None, 2, 6, None, None, 2]),
        (X.title_prefixed, ["一、总则", "1.1 适用范围", "# x", "word", "1 " + "x" * 60], ["## 一、总则", "### 1.1 适用范围", "# x", "word", "1 " + "x" * 60]),
        (X.half_width, ["第１期（总第５７７期）ＡＢＣａｂｃ"], ["第1期（总第577期）ABCabc"]),
        (X.is_page_number, ["52", " 7 ", "", "52a", "12345"], [True, True, False, False, False]),
        (X.is_noise_fragment, ["馆", "", "a)", "-", "# 标题", "52", "#"], [True, False, False, False, False, False, False]),
        (X.is_isolated_marker, ["b)", "c.", "A、", "（十二）", "-", "（1）", "1.", "4.2", "# x", "abcdefg", "- abc", "（）"], [True] * 6 + [False] * 4 + [True, False]),
        (X.table_html, ["<html><table><tr></table></html>", "<table>x</table tail", "none "], ["<table><tr></table>", "<table>x</table>", "none"]),
        (X.escape_html, ["a&b<c>"], ["a&amp;b&lt;c&gt;"]),
        (X.strip, ["　a b\t\n", " "], ["a b", ""]),
        (X.snapshot_name, ["a b/ü.pdf"], ["a_b__.pdf"]),
        (lambda c: F.array_sort(X.ngrams(c, 2)), ["abab", "a", ""], [["ab", "ba"], [], []]),
        (X.plain_line, ["![x](y)", "# t", "| a | b |", "12", "---", "- x"], [None, "t", "a   b", None, None, "x"]),
    ],
)
def test_lines(spark, f, rows, want):
    assert values(spark, f, rows) == want


def test_garbled(spark):
    rows = ["�" * 60, "�" * 10, "a" * 60 + "" * 10, "a" * 30 + "�" * 30]
    assert values(spark, lambda c: X.is_garbled(F.length(c), X.garbled(c)), rows) == [True, False, False, True]


def test_full_width_box(spark):
    d = spark.createDataFrame([(0.0, 1000.0), (50.0, 450.0), (0.0, 800.0), (100.0, 1020.0)], "a double, b double")
    assert [r[0] for r in d.select(G.is_full_width(F.col("a"), F.col("b"), F.lit(1000.0))).collect()] == [True, False, False, False]


def test_watermark(spark):
    import math

    rows = [([math.cos(math.radians(a)), math.sin(math.radians(a)), -math.sin(math.radians(a)), math.cos(math.radians(a)), 0.0, 0.0],) for a in (0, 90, 180, 270, 12, 348, 30, 45, 13, 347)] + [([1.0],), (None,)]
    d = spark.createDataFrame(rows, "m array<double>")
    assert [r[0] for r in d.select(G.off_axis(F.col("m"))).collect()] == [False] * 6 + [True] * 4 + [False] * 2
