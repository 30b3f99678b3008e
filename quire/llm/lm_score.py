"""Language-model scoring: marginal probability of documents under a unigram model of subword pieces.

The vocabulary is a public tokenizer's. Its file holds merge ranks and no
probabilities, so the unigram scores are taken from the corpus: the tokenizer
segments every distinct word of all documents, and a piece's score is the log
of its share of all pieces, with one occurrence added to each piece. Documents
are then scored by summing over all segmentations, not by the one that the
tokenizer prefers.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lattice import VOCABULARY, Lattice, Scorer, count_pieces, log_probabilities, slices, vocabulary
from .shared import Frame, arrow

_lattices: dict[str, Lattice] = {}


def word_counts(docs: DataFrame, text: Column, keys: dict[str, Column] | None = None) -> DataFrame:
    """(keys, word, n): how often each word (run between white space) occurs in all texts.

    A task counts before the shuffle and hands its counts on when it holds
    200,000 words or 16 million characters of them; long texts are taken in
    slices, so its memory is bounded.
    """
    by = keys or {}
    keys = list(by)

    def run(batches):
        held: dict = {}
        size = chars = 0

        def out():
            for k, c in held.items():
                yield pa.RecordBatch.from_arrays([*[pa.array([v] * len(c), pa.string()) for v in k], pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())], names=[*keys, "word", "n"])

        for b in batches:
            ks = list(zip(*[b.column(i).to_pylist() for i in range(len(keys))])) if keys else [()] * b.num_rows
            texts = b.column(len(keys))
            for i, k in enumerate(ks):
                for part in slices(texts[i].as_py()):
                    if not part:
                        continue
                    c = held.setdefault(k, Counter())
                    size -= len(c)
                    c.update(part.split())
                    size += len(c)
                    chars += len(part)
                    if size > 200_000 or chars > 16 << 20 and sum(len(w) for c in held.values() for w in c) > 16 << 20:
                        yield from out()
                        held, size, chars = {}, 0, 0
                    elif chars > 16 << 20:
                        chars = 0
        yield from out()

    d = docs.select(*[v.cast("string").alias(k) for k, v in by.items()], text.alias("text"))
    schema = "".join(f"`{k}` string, " for k in keys) + "word string, n bigint"
    return d.mapInArrow(run, schema).groupBy(*keys, "word").agg(F.sum("n").alias("n"))


def piece_counts(counted: DataFrame, path: str, keys: tuple[str, ...] = ()) -> dict[tuple, np.ndarray]:
    """Counts of all pieces for each key. What the driver gets is bounded by the vocabulary and the number of keys."""

    def run(batches):
        held: dict = {}
        for b in batches:
            ks = list(zip(*[b.column(i).to_pylist() for i in range(len(keys))])) if keys else [()] * b.num_rows
            words, n = b.column(len(keys)).to_pylist(), b.column(len(keys) + 1).to_numpy()
            by: dict = {}
            for i, k in enumerate(ks):
                by.setdefault(k, []).append(i)
            for k, at in by.items():
                c = count_pieces(path, [words[i] for i in at], n[at])
                held[k] = held[k] + c if k in held else c
        for k, c in held.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([*[pa.array([v] * len(at), pa.string()) for v in k], pa.array(at, pa.int64()), pa.array(c[at], pa.int64())], names=[*keys, "piece", "n"])

    schema = "".join(f"`{k}` string, " for k in keys) + "piece bigint, n bigint"
    rows = counted.select(*keys, "word", "n").mapInArrow(run, schema).groupBy(*keys, "piece").agg(F.sum("n").alias("n")).toPandas()
    size = len(vocabulary(path)[0])
    out: dict[tuple, np.ndarray] = {}
    for k, part in rows.groupby(list(keys)) if keys else [((), rows)]:
        c = out[k if isinstance(k, tuple) else (k,)] = np.zeros(size, np.int64)
        c[part["piece"].to_numpy()] = part["n"].to_numpy()
    return out


def lattice_column(name: str, spark, scores: np.ndarray, text: Column, path: str, after, kind: str, *more: Column) -> Column:
    """``after(log-probabilities, words, *more)`` as a column; a worker builds the lattice of the model ``name`` once."""
    sent = spark.sparkContext.broadcast(scores)
    mine: list[Scorer] = []  # a task's own copy, so that its memory of words ends with it

    def run(arr: pa.Array, *rest: pa.Array) -> pa.Array:
        if name not in _lattices:
            while len(_lattices) > 7:
                _lattices.pop(next(iter(_lattices)))
            _, used, byte_ids = vocabulary(path)
            _lattices[name] = Lattice(used, sent.value, byte_ids)
        if not mine:
            mine.append(Scorer(_lattices[name]))
        s = mine[0]
        parts = []
        for i in range(0, len(arr), 1000):
            parts.append(s.texts(arr.slice(i, 1000).to_pylist()))
        if not parts:
            return after(np.zeros((0, s.lattice.n_models)), np.zeros(0, np.int64), *rest)
        return after(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), *rest)

    return arrow(run, kind)(text, *more)


def score(docs: DataFrame, text_col: str = "text", vocabulary_path: str = VOCABULARY, smooth: float = 1.0) -> DataFrame:
    """The documents with ``logprob`` (natural log of the marginal probability), ``n_words`` and ``logprob_per_word``.

    Null texts and those without words have log-probability 0 of no words, and
    null per word. Input columns of these names give way, all others stay
    whatever they are called. Repeated rows score alike (and count each time in
    the statistics). An empty table gives an empty one.
    """
    import uuid

    fr = Frame(docs)
    counts = piece_counts(word_counts(fr.df, fr[text_col]), vocabulary_path)
    c = counts.get((), np.zeros(len(vocabulary(vocabulary_path)[0]), np.int64))
    scores = log_probabilities(c, smooth)

    def after(v, n):
        return pa.StructArray.from_arrays([pa.array(v[:, 0]), pa.array(n)], names=["v", "n"])

    s = lattice_column(uuid.uuid4().hex, docs.sparkSession, scores, fr[text_col], vocabulary_path, after, "struct<v:double,n:bigint>")
    d = fr.df.select("*", s.alias("s"))
    return fr.close(d, logprob=F.col("s.v"), n_words=F.col("s.n"), logprob_per_word=F.when(F.col("s.n") > 0, F.col("s.v") / F.col("s.n")))
