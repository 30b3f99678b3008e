"""Benchmark decontamination with suffix arrays of the training text.

Each Arrow batch of documents is cut into shards of about ``shard_bytes`` of
text, a document never split. A shard's word-level suffix array is built by
prefix doubling, in which only groups that still tie are sorted again, down to
the length of the longest test item, which is as far as any search looks.
Every suffix of every test item is then looked up by binary search in all
shards, all suffixes at once, a word deeper each time; its interval at the
threshold has every place that holds the passage, and those places are
extended to the longest verbatim match.

No step shuffles: only the text column goes to Python, and a list of matches
comes back. The test items are sent to the executors in pieces of at most
``piece_words`` words; a larger set of tests takes one pass for each piece,
each over what the former ones kept, and only one piece at a time is held.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words
from .shared import Frame, arrow, cut, drop, only

MATCH = "array<struct<item_id:{},n_words:int,doc_word:int,item_word:int>>"


class Tests:
    """Word hashes of test items, end to end, each item ended by a zero."""

    def __init__(self, ids: pa.Array, texts: list[str], min_words: int, least: int):
        hs = [np.concatenate([h, np.zeros(0, np.uint64)]) for h in _items(texts)]
        use = [k for k, h in enumerate(hs) if len(h) >= max(1, least)]
        self.ids = ids.take(pa.array(use, pa.int64()))
        hs = [hs[k] for k in use]
        size = np.array([len(h) for h in hs], np.int64)
        self.depth = int(size.max()) if len(size) else 0
        self.symbols = np.concatenate([np.r_[h, np.uint64(0)] for h in hs] + [np.zeros(self.depth + 1, np.uint64)])
        start = np.r_[0, np.cumsum(size + 1)[:-1]].astype(np.int64) if len(size) else np.zeros(0, np.int64)
        item = np.repeat(np.arange(len(size)), size)
        self.word = np.arange(len(item)) - np.repeat(np.cumsum(size) - size, size)
        self.item, self.at = item, start[item] + self.word
        self.need = np.minimum(min_words, size)
        on = size[item] - self.word >= self.need[item]
        self.item, self.word, self.at = self.item[on], self.word[on], self.at[on]


def _items(texts: list[str]) -> Iterator[np.ndarray]:
    for _, _, h, first in words.hashed(pa.array([(t or "").lower() for t in texts], pa.large_string())):
        for k in range(len(first) - 1):
            yield h[first[k] : first[k + 1]]


def suffix_array(t: np.ndarray, depth: int) -> np.ndarray:
    """Positions of the symbols other than 0, ordered by the suffixes' first ``depth`` symbols at least (to the next power of two)."""
    pos = np.flatnonzero(t)
    n = len(pos)
    if n == 0:
        return pos
    order = np.argsort(t[pos])
    sa = pos[order]
    v = t[sa]
    rank = np.full(len(t) + 1, -1, np.int64)
    head = np.r_[True, v[1:] != v[:-1]]
    begin = np.flatnonzero(head)
    size = np.diff(np.r_[begin, n])
    rank[sa] = np.repeat(begin, size)
    slots = np.flatnonzero(np.repeat(size, size) > 1)
    k = 1
    while k < depth and len(slots):
        p = sa[slots]
        key = (rank[p] << 32) | (rank[np.minimum(p + k, len(t))] + 1)
        o = np.argsort(key)
        key, p = key[o], p[o]
        sa[slots] = p
        begin = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        size = np.diff(np.r_[begin, len(p)])
        rank[p] = np.repeat(slots[begin], size)
        slots = slots[np.repeat(size, size) > 1]
        k *= 2
    return sa


def search(t: np.ndarray, sa: np.ndarray, tests: Tests) -> tuple[np.ndarray, np.ndarray]:
    """(test suffix, position in ``t``) of all matches as long as the item's threshold."""
    m = len(tests.at)
    lo, hi = np.zeros(m, np.int64), np.full(m, len(sa), np.int64)
    need = tests.need[tests.item]
    on = np.arange(m)
    done = []
    d = 0
    end = len(t)
    padded = np.r_[t, np.uint64(0)]
    while len(on):
        q = tests.symbols[tests.at[on] + d]
        found = []
        for upper in (False, True):
            x, y = lo[on], hi[on]
            act = np.flatnonzero(x < y)
            while len(act):
                mid = (x[act] + y[act]) >> 1
                s = padded[np.minimum(sa[mid] + d, end)]
                right = s <= q[act] if upper else s < q[act]
                x[act[right]] = mid[right] + 1
                y[act[~right]] = mid[~right]
                act = act[x[act] < y[act]]
            found.append(x)
        lo[on], hi[on] = found
        d += 1
        on = on[found[0] < found[1]]
        full = need[on] == d
        done.append(on[full])
        on = on[~full]
    hit = np.concatenate(done) if done else on
    count = hi[hit] - lo[hit]
    which = np.repeat(hit, count)
    place = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
    return which, sa[lo[which] + place]


def shard_matches(t: np.ndarray, tests: Tests) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(test suffix, position, words) of the matches that can't be extended to the left, with their full length."""
    if not len(tests.at):
        z = np.zeros(0, np.int64)
        return z, z, z
    sa = suffix_array(t, tests.depth)
    s, p = search(t, sa, tests)
    before_t = np.where(p > 0, t[p - 1], 0)
    before_q = np.where(tests.word[s] > 0, tests.symbols[tests.at[s] - 1], 0)
    on = (before_t != before_q) | (before_t == 0)
    s, p = s[on], p[on]
    n = tests.need[tests.item[s]].copy()
    more = np.arange(len(s))
    padded = np.r_[t, np.uint64(0)]
    while len(more):
        a = padded[np.minimum(p[more] + n[more], len(t))]
        more = more[(a == tests.symbols[tests.at[s[more]] + n[more]]) & (a != 0)]
        n[more] += 1
    return s, p, n


def _matcher(tests: Tests, shard_bytes: int):
    def run(text: pa.Array) -> pa.Array:
        rows, out = [], []
        for i, j, h, first in words.hashed(text, shard_bytes):
            size = np.diff(first)
            t = np.zeros(len(h) + (j - i), np.uint64)
            doc = np.repeat(np.arange(j - i), size)
            t[np.arange(len(h)) + doc] = h
            begin = first[:-1] + np.arange(j - i)
            s, p, n = shard_matches(t, tests)
            if len(s):
                d = np.searchsorted(begin, p, side="right") - 1
                item = tests.item[s]
                o = np.lexsort((tests.word[s], p, -n, item, d))
                o = o[np.r_[True, (d[o][1:] != d[o][:-1]) | (item[o][1:] != item[o][:-1])]]
                rows.append(i + d[o])
                out.append((item[o], n[o], p[o] - begin[d[o]], tests.word[s[o]]))
        at = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        cols = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 4
        offsets = np.searchsorted(at, np.arange(len(text) + 1)).astype(np.int32)
        s = pa.StructArray.from_arrays([tests.ids.take(pa.array(cols[0], pa.int64())), *[pa.array(c.astype(np.int32)) for c in cols[1:]]], names=["item_id", "n_words", "doc_word", "item_word"])
        return pa.ListArray.from_arrays(pa.array(offsets), s)

    return run


def _pieces(tests: DataFrame, id_col: str, text_col: str, piece_words: int) -> Iterator[tuple[pa.Array, list[str]]]:
    from pyspark.sql.pandas.types import to_arrow_type

    t = only(tests, id_col, text_col).toDF("id", "text").where("id is not null and text is not null")
    kind = to_arrow_type(t.schema["id"].dataType)
    ids, texts, size = [], [], 0
    for r in t.orderBy("id", "text").toLocalIterator():
        k = len(r["text"]) // 2 + 1
        if ids and size + k > piece_words:
            yield pa.array(ids, kind), texts
            ids, texts, size = [], [], 0
        ids.append(r["id"])
        texts.append(r["text"])
        size += k
    if ids:
        yield pa.array(ids, kind), texts


def _columns(tests: DataFrame, text: Column, id_col: str = "item_id", text_col: str = "text", min_words: int = 13, least: int = 1, shard_bytes: int = 4 << 20, piece_words: int = 4_000_000) -> Iterator[Column]:
    """For each piece of the tests, a column with the longest match of each item in the text (first place in the text on a tie)."""
    kind = MATCH.format(Frame(tests).df.schema[Frame(tests).at(id_col)].dataType.simpleString())
    for ids, texts in _pieces(tests, id_col, text_col, piece_words):
        yield arrow(_matcher(Tests(ids, texts, min_words, least), shard_bytes), kind)(F.lower(text))


def matches(docs: DataFrame, tests: DataFrame, doc_id: str = "doc_id", doc_text: str = "text", **options) -> DataFrame:
    """(doc_id, item_id, n_words, doc_word, item_word): the longest verbatim match of each item in each document that holds one.

    Documents and items count as in ``decontaminate``; ids may be of any type.
    Matches of more than one piece of the tests are staged piece by piece.
    """
    fr, ft = Frame(docs), Frame(tests)
    d = fr.df.select(fr[doc_id].alias("doc_id"), fr[doc_text].alias("text"))
    item = ft.df.schema[ft.at(options.get("id_col", "item_id"))].dataType
    out = None
    for c in _columns(tests, F.col("text"), **options):
        m = d.select("doc_id", F.explode(c).alias("m")).select("doc_id", "m.*")
        out = m if out is None else cut(out)[0].unionByName(m)
    return d.select("doc_id", *[F.lit(None).cast(k).alias(c) for c, k in (("item_id", item), ("n_words", "int"), ("doc_word", "int"), ("item_word", "int"))]).where("false") if out is None else out


def decontaminate(docs: DataFrame, tests: DataFrame, doc_text: str = "text", **options) -> DataFrame:
    """The documents that share no passage with a test item, all columns as they were.

    A shared passage is a run of ``min_words`` words (13), or the whole of an
    item that is shorter, down to ``least`` words (1: every item counts; a set
    of tests with very short items may want more). Words are compared in lower
    case, without signs between them. Null and empty texts match nothing and
    stay; repeated rows stand or fall alike; items with a null id or text, items
    without a word and an empty set of tests remove nothing; an empty table
    stays empty. Other columns may have any names, item ids any type.
    """
    fr = Frame(docs)
    out, path, first = fr.df, None, True
    for c in _columns(tests, fr[doc_text], **options):
        if not first:
            out, new = cut(out)
            if path:
                drop(docs.sparkSession, path)
            path = new
        out, first = out.select("*", F.size(c).alias("n")).where("n = 0").drop("n"), False
    return fr.close(out)


def sql(docs: str = "documents", tests: str = "benchmark", min_words: int = 13) -> str:
    """The same for DuckDB, by all runs of words of the documents, for small tables with the columns of ``documents``."""
    word = r"[0-9a-z\x{c0}-\x{1fff}\x{2080}-\x{2fff}\x{3040}-\x{10ffff}]+"
    ws = lambda t, i: f"select {i} as id, regexp_extract_all(lower(text), '{word}') as w from {t} where text is not null"
    runs = lambda w, n: f"unnest(list_transform(range(1, len({w}) - {n} + 2), lambda i: array_to_string({w}[i:i + {n} - 1], ' ')))"
    return f"""with q as ({ws(tests, 'item_id')}), d as ({ws(docs, 'doc_id')}),
    g as (select distinct n, {runs('w', 'n')} as run from (select w, least(len(w), {min_words}) as n from q where id is not null and len(w) > 0)),
    h as (select distinct id, n, {runs('w', 'n')} as run from d, (select distinct n from g) where len(w) >= n)
    select * from {docs} where doc_id not in (select h.id from h join g on h.n = g.n and h.run = g.run where h.id is not null)"""
