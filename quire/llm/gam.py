"""Quality classifier: a generalised additive model with pairwise interactions.

Boosting goes round the features in turn; each step fits a tree of a few leaves
on one feature's bins to the current residuals and adds it, shrunken, to that
feature's lookup table. Then the most useful pairs of features get tables of
their own in the same way. A document is scored by looking its bins up and
adding: ``bias + sum table[f][bin f] + sum table[f, g][bin f, bin g]``.

Features are shares of kinds of characters and statistics of words and lines,
taken from the whole text's bytes in a few numpy passes; no string is made.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .shared import Frame, arrow, only

FEATURES = ("log_bytes", "log_words", "word_length", "long_words", "upper", "digit", "sign", "space", "sign_ends", "distinct_words", "repeated_next", "log_line_words", "exclaims", "bars")
#: At most about so many labelled documents are fitted on.
SAMPLE = 20_000


def features(arr: pa.Array) -> np.ndarray:
    """(texts x features); zeros for a text without bytes."""
    out = np.zeros((len(arr), len(FEATURES)), np.float32)
    buf, offs = words.raw(arr)
    upper, digit, space, sign = (np.zeros(256, np.uint8) for _ in range(4))
    upper[65:91], digit[48:58] = 1, 1
    space[[9, 10, 11, 12, 13, 32]] = 1
    for a, b in ((33, 48), (58, 65), (91, 97), (123, 127)):
        sign[a:b] = 1
    for i, j in words.runs(offs, 4 << 20):
        b, o = buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        n = np.diff(o)
        if not len(b):
            continue

        def per_row(flags):
            c = np.zeros(len(flags) + 1, np.int64)
            np.cumsum(flags, out=c[1:])
            return c[o[1:]] - c[o[:-1]]

        s, e, first = words.split(b, o)
        k = np.diff(first)
        h = words.hashes(b, s, e)
        row = np.repeat(np.arange(j - i), k)
        length = e - s
        fold = lambda v: np.bincount(row, weights=v, minlength=j - i)
        nxt = np.zeros(len(h), bool)
        nxt[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
        key = np.sort((row.astype(np.uint64) << np.uint64(44)) | (h >> np.uint64(20)))
        new = np.r_[True, key[1:] != key[:-1]] if len(key) else np.zeros(0, bool)
        distinct = np.bincount((key[new] >> np.uint64(44)).astype(np.int64), minlength=j - i)
        is_sign = sign[b]
        after = np.zeros(len(b) + 2, np.uint8)
        after[: len(b)] = is_sign
        two = (after[e] == 1) & (after[e + 1] == 1)
        lines = per_row(b == 10) + 1
        m, w = np.maximum(n, 1), np.maximum(k, 1)
        cols = (np.log1p(n), np.log1p(k), fold(length) / w, fold(length > 12) / w, per_row(upper[b]) / m, per_row(digit[b]) / m, per_row(is_sign) / m, per_row(space[b]) / m, fold(two) / w, distinct / w, fold(nxt) / w, np.log1p(k / lines), per_row(b == 33) / w, per_row(b == 124) / w)
        out[i:j] = np.stack(cols, axis=1)
    return out


@dataclass
class Gam:
    edges: list[np.ndarray]
    bias: float = 0.0
    tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(self.edges)], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of good quality."""
        b = self.bins(x)
        s = np.full(len(x), self.bias)
        for f, t in enumerate(self.tables):
            s += t[b[:, f]]
        for (f, g), t in zip(self.pairs, self.pair_tables):
            s += t[self.coarse[f][b[:, f]], self.coarse[g][b[:, g]]]
        return s


def _tree(g: np.ndarray, h: np.ndarray, leaves: int, ridge: float) -> np.ndarray:
    """Values by bin of the tree that greedily splits the bins' order into ``leaves`` ranges, Newton steps at the leaves."""
    cg, ch = np.r_[0.0, np.cumsum(g)], np.r_[0.0, np.cumsum(h)]
    cuts = [0, len(g)]
    gain = lambda a, b: (cg[b] - cg[a]) ** 2 / (ch[b] - ch[a] + ridge)
    for _ in range(leaves - 1):
        best = (1e-12, None)
        for a, b in zip(cuts, cuts[1:]):
            if b - a < 2:
                continue
            m = np.arange(a + 1, b)
            v = gain(a, m) + gain(m, b) - gain(a, b)
            k = int(v.argmax())
            if v[k] > best[0]:
                best = (float(v[k]), int(m[k]))
        if best[1] is None:
            break
        cuts = sorted([*cuts, best[1]])
    out = np.zeros(len(g))
    for a, b in zip(cuts, cuts[1:]):
        out[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + ridge)
    return out


def _tree2(g: np.ndarray, h: np.ndarray, ridge: float) -> np.ndarray:
    """The same over two features' bins: one cut of the first, and one of the second on either side of it."""
    def line(gg, hh):
        cg, ch = np.cumsum(gg)[:-1], np.cumsum(hh)[:-1]
        G, H = gg.sum(), hh.sum()
        v = cg**2 / (ch + ridge) + (G - cg) ** 2 / (H - ch + ridge)
        k = int(v.argmax())
        return float(v[k]), k + 1

    best = (-1.0, 0, 0, 0)
    for a in range(1, len(g)):
        (u, p), (v, q) = line(g[:a].sum(0), h[:a].sum(0)), line(g[a:].sum(0), h[a:].sum(0))
        if u + v > best[0]:
            best = (u + v, a, p, q)
    _, a, p, q = best
    out = np.zeros(g.shape)
    for rows, c in ((slice(None, a), p), (slice(a, None), q)):
        for cols in (slice(None, c), slice(c, None)):
            out[rows, cols] = g[rows, cols].sum() / (h[rows, cols].sum() + ridge)
    return out


def train(x: np.ndarray, y: np.ndarray, n_bins: int = 64, rounds: int = 120, rate: float = 0.1, leaves: int = 3, n_pairs: int = 6, pair_rounds: int = 40, pair_bins: int = 8, ridge: float = 1.0) -> Gam:
    """Cyclic boosting of shallow trees on logistic loss."""
    n, d = x.shape
    edges = [np.unique(np.quantile(x[:, f], np.arange(1, n_bins) / n_bins)).astype(np.float32) if n else np.zeros(0, np.float32) for f in range(d)]
    m = Gam(edges, tables=[np.zeros(len(e) + 1) for e in edges])
    m.coarse = [np.minimum(np.arange(len(e) + 1) * pair_bins // (len(e) + 1), pair_bins - 1) for e in edges]
    if not n:
        return m
    p = (y.sum() + 1.0) / (n + 2.0)
    m.bias = float(np.log(p / (1 - p)))
    b = m.bins(x)
    s = np.full(n, m.bias)

    def slopes():
        q = 1 / (1 + np.exp(-s))
        return y - q, np.maximum(q * (1 - q), 1e-6)

    for _ in range(rounds):
        for f in range(d):
            g, h = slopes()
            k = len(m.tables[f])
            step = rate * _tree(np.bincount(b[:, f], g, k), np.bincount(b[:, f], h, k), leaves, ridge)
            m.tables[f] += step
            s += step[b[:, f]]
    c = np.stack([m.coarse[f][b[:, f]] for f in range(d)], axis=1)

    def grid(f, g2, v):
        return np.bincount(c[:, f] * pair_bins + c[:, g2], v, pair_bins * pair_bins).reshape(pair_bins, pair_bins)

    g, h = slopes()
    use = []
    for f in range(d):
        for f2 in range(f + 1, d):
            gg, hh = grid(f, f2, g), grid(f, f2, h)
            t = _tree2(gg, hh, ridge)
            use.append((float((t * gg).sum() - 0.5 * (t * t * hh).sum()), f, f2))
    m.pairs = [(f, f2) for _, f, f2 in sorted(use, key=lambda u: (-u[0], u[1], u[2]))[:n_pairs]]
    m.pair_tables = [np.zeros((pair_bins, pair_bins)) for _ in m.pairs]
    for _ in range(pair_rounds):
        for k, (f, f2) in enumerate(m.pairs):
            g, h = slopes()
            step = rate * _tree2(grid(f, f2, g), grid(f, f2, h), ridge)
            m.pair_tables[k] += step
            s += step[c[:, f], c[:, f2]]
    return m


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE, **options) -> Gam:
    """Fits on labelled documents, about ``sample`` of them at most, taken by a hash of the id.

    Null ids, texts and labels aren't used; an id that is labelled twice counts
    once, with its least label. Without any label all documents score 0.
    """
    lab = only(labels, id_col, label_col).toDF("id", "y").where("id is not null and y is not null").groupBy("id").agg(F.min(F.col("y").cast("double")).alias("y"))
    n = lab.count()
    if n > sample:
        lab = lab.where(F.pmod(F.xxhash64("id"), F.lit(1 << 40)) < int((1 << 40) * (sample / n)))
        n = lab.count()
    if n <= 2 * sample:  # as good as always: the documents themselves aren't shuffled
        lab = F.broadcast(lab)
    d = only(docs, id_col, text_col).toDF("id", "text").where("id is not null and text is not null")
    got = d.join(lab, "id").select("id", "y", arrow(_lists, "array<float>")(F.col("text")).alias("x")).toPandas().sort_values("id", kind="stable")
    x = np.stack(got["x"].to_numpy()).astype(np.float32) if len(got) else np.zeros((0, len(FEATURES)), np.float32)
    return train(x, (got["y"].to_numpy(dtype=float) > 0.5).astype(float), **options)


def _lists(arr: pa.Array) -> pa.Array:
    x = features(arr)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(FEATURES)), pa.array(x.ravel()))


def accept(docs: DataFrame, model: Gam, text_col: str = "text", least: float = 0.5, out: bool = True) -> DataFrame:
    """The documents whose probability of good quality is ``least`` or more.

    Null texts have no score (null ``quality_score``) and stay; an empty text
    is scored as one of no bytes. Repeated rows are judged alike. Adds
    ``quality_score``, the probability, if ``out``; an input column of that
    name gives way, all others stay whatever they are called. An empty table
    stays empty.
    """
    def run(arr: pa.Array) -> pa.Array:
        p = 1 / (1 + np.exp(-np.clip(model.score(features(arr)), -500, 500)))
        return pa.array(p, mask=np.asarray(arr.is_null()))

    fr = Frame(docs)
    d = fr.df.select("*", arrow(run, "double")(fr[text_col]).alias("q")).where(F.coalesce(F.col("q"), F.lit(1.0)) >= least)
    return fr.close(d, quality_score=F.col("q")) if out else fr.close(d)
