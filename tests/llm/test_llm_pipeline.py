"""The pipeline against a brute-force version, its stages on odd tables, and life without the subpackage."""

from __future__ import annotations

import math
import os
import shutil
import subprocess
import sys
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from quire.llm import gam, langid, lattice, packing, simhash, tokens, words

SF = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def brute(docs, labels, bench):
    """The same decisions, a document after the other, in one process."""
    y = {r["doc_id"]: r["quality"] for r in labels}
    lab = sorted((d for d in docs if d["doc_id"] in y), key=lambda d: d["doc_id"])
    m = gam.train(gam.features(pa.array([d["text"] for d in lab])), np.array([float(y[d["doc_id"]]) for d in lab]))
    docs = [d for d in docs if m.score(gam.features(pa.array([d["text"]])))[0] >= 0]
    counts = {}
    for d in docs:
        counts.setdefault(d["lang"], Counter()).update(d["text"].split())
    langs = sorted(counts)
    logp = lattice.log_probabilities(np.stack([lattice.count_pieces(lattice.VOCABULARY, list(counts[k]), list(counts[k].values())) for k in langs]), 0.5)
    _, used, byte_ids = lattice.vocabulary(lattice.VOCABULARY)
    lat = lattice.Lattice(used, logp, byte_ids)
    kept = []
    for d in docs:
        ws = d["text"].split()
        s = lat.score_words(ws).sum(axis=0) if ws else np.zeros(len(langs))
        gap = s.max() - s[langs.index(d["lang"])]
        if not (gap > 20 and gap > 3 * len(ws)):
            kept.append(d)
    docs = kept
    fp = [simhash._fingerprints(pa.array([d["text"].lower()])) for d in docs]
    label = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            if fp[i][1][0] and fp[j][1][0] and int(np.bitwise_count(fp[i][0] ^ fp[j][0]).sum()) <= 18:
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    first = {}
    for k, d in zip(label, docs):
        first[k] = min(first.get(k, d["doc_id"]), d["doc_id"])
    docs = [d for k, d in zip(label, docs) if first[k] == d["doc_id"]]
    grams = set()
    for r in bench:
        w = words.plain(r["text"])
        n = min(13, len(w))
        grams |= {(n, *w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()
    sizes = {g[0] for g in grams}
    docs = [d for d in docs if not any((n, *w[i : i + n]) in grams for w in [words.plain(d["text"])] for n in sizes for i in range(len(w) - n + 1))]
    pieces = []
    for d in docs:
        n = len(tokens.encode(d["text"]))
        pieces += [(d["doc_id"], k, min(2048, n - 2048 * k)) for k in range(max(1, math.ceil(n / 2048)))]
    have = np.bincount([p[2] for p in pieces], minlength=2049)
    return docs, pieces, packing.plan(have).n_bins


@needs_data
def test_run_is_brute_force(spark):
    t = lambda n: pq.read_table(f"{SF}/{n}.parquet").to_pylist()
    docs, pieces, n_bins = brute(t("documents"), t("labels"), t("benchmark"))
    got = corpus_pipeline.run(spark, SF).collect()
    assert sorted((r["doc_id"], r["piece"], r["length"]) for r in got) == sorted(pieces)
    assert len({r["sequence"] for r in got if r["length"]}) == n_bins
    fill = Counter()
    for r in got:
        fill[r["sequence"]] += r["length"]
    assert max(fill.values()) <= 2048 and 0 < len(docs) < 200


@needs_data
def test_stages_on_odd_tables(spark):
    from pyspark.sql import functions as F

    rows = [(1, "some words here", "en", "a", 15), (1, "some words here", "en", "a", 15), (None, None, None, None, None), (3, "", "en", "b", 0), (4, "word " * 40_000, "en", "b", 200_000)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").withColumn("Quality", F.lit("clash"))
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, d.limit(0), SF).count() == 0
        out = stage(spark, d, SF)
        if name != "pack":
            assert out.columns == d.columns
            ids = {r["doc_id"] for r in out.collect()}
            assert None in ids and 3 in ids
        else:
            assert {r["doc_id"] for r in out.collect()} == {1, None, 3, 4}


def test_library_without_the_subpackage(tmp_path):
    """Entry still imports and has its other queries when this folder and the pipeline are gone."""
    shutil.copytree(os.path.join(ROOT, "quire"), tmp_path / "quire", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), tmp_path)
    r = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q = e.queries(); assert len(q) > 50 and not any(k.startswith('op') for k in q) and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"], cwd=tmp_path, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": ""})
    assert r.returncode == 0, r.stderr


def test_queries_are_registered():
    import __spark_entry__ as e

    names = [k for k in e.queries() if k.startswith("op")]
    assert sorted(int(k[2:].split("_")[0]) for k in names) == list(range(1, 11)) and "pipeline" in e.queries()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "language", "near_dedup", "decontaminate", "pack"]


@needs_data
def test_hilbert_oracle(spark):
    import duckdb

    import __spark_entry__ as e

    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    r = c.sql(e.oracle_sql()["op1_hilbert_shards"])
    df = e.queries()["op1_hilbert_shards"](spark, SF)
    cols = sorted(df.columns)
    assert sorted(r.columns) == cols
    at = [r.columns.index(k) for k in cols]
    assert sorted(repr(tuple(x[i] for i in at)) for x in r.fetchall()) == sorted(repr(tuple(x[k] for k in cols)) for x in df.collect())
    assert langid.PER_LANGUAGE and gam.SAMPLE
