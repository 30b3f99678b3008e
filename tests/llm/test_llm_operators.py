"""The operators against brute force, round trips and held-out accuracy, and on odd tables."""

from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quire.llm import components, decontaminate, embed_dedup, gam, hilbert, langid, lattice, lm_score, packing, pfor, simhash, token_count, tokens, words

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG = "word another third " * 6000 + "x" * 40_000
ODD = [(1, "same words here and there again", "en", "a", 31), (1, "same words here and there again", "en", "a", 31), (2, None, None, None, None), (None, "no id but some words", "en", "a", 20), (None, None, "en", "a", None), (3, "", "en", "", 0), (4, "!!! ---", "en", "b", 7), (5, LONG, "en", "b", len(LONG)), (6, "same words here and there again", "xx", "b", -5), (7, "日本語 🙂 ünï", "en", "b", 9)]


def odd(spark):
    """Nulls everywhere, repeated rows, an empty and a very long text, and columns whose names clash."""
    d = spark.createDataFrame(ODD, DOCS)
    return d.select("*", *[F.lit("x").alias(c) for c in ("shard", "Simhash", "group_size", "quality_score", "lang_found", "logprob", "n_words", "hilbert", "x0", "hi", "id", "n", "key")])


def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_words_match_plain():
    rng = random.Random(0)
    texts = ["".join(rng.choice("ab9 .-é“ 日\n") for _ in range(rng.randrange(60))) for _ in range(300)] + ["", None, LONG]
    arr = pa.array(texts, pa.string())
    seen: dict[bytes, int] = {}
    for limit in (50, 1 << 20):
        for i, j, h, first in words.hashed(arr, limit):
            for k in range(i, j):
                ws = words.plain(texts[k])
                got = h[first[k - i] : first[k - i + 1]].tolist()
                assert len(got) == len(ws)
                assert all(seen.setdefault(w, g) == g for w, g in zip(ws, got))
    assert len(set(seen.values())) == len(seen)


# 1 -------------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("n,bits", [(2, 4), (3, 3), (4, 2)])
def test_hilbert_is_a_curve(spark, n, bits):
    d = spark.range(1 << (n * bits)).select(*[F.expr(f"shiftright(id, {i * bits}) & {(1 << bits) - 1}").alias(f"c{i}") for i in range(n)])
    rows = sorted((r["h"], tuple(r)[:n]) for r in d.select("*", F.expr(hilbert.hilbert_index([f"c{i}" for i in range(n)], bits)).alias("h")).collect())
    assert [h for h, _ in rows] == list(range(1 << (n * bits)))
    assert all(sum(abs(a - b) for a, b in zip(p, q)) == 1 for (_, p), (_, q) in zip(rows, rows[1:]))


def test_shards_prune(spark, tmp_path):
    rng = random.Random(1)
    d = spark.createDataFrame([(i, "", rng.choice("abcd"), f"s{rng.randrange(8)}", int(rng.lognormvariate(7, 1))) for i in range(4000)], DOCS)
    s = hilbert.shard(d, target=200_000).cache()
    rows = s.orderBy("curve_start").collect()
    assert len(rows) == 4000 and sum(max(r["n_chars"], 0) + 64 for r in rows[:-1]) == rows[-1]["curve_start"]
    assert all(a["hilbert"] <= b["hilbert"] for a, b in zip(rows, rows[1:])) and all(r["shard"] == r["curve_start"] // 200_000 for r in rows)
    n = rows[-1]["shard"] + 1
    hit = {r["shard"] for r in rows if r["source"] == "s3" and 500 < r["n_chars"] < 1500}
    assert len(hit) < 0.6 * n  # any order of ids would touch all
    hilbert.write_shards(s, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4000


def test_shard_odd(spark):
    s = hilbert.shard(odd(spark)).collect()
    assert len(s) == len(ODD) and "x0" in s[0].asDict() and all(isinstance(r["shard"], int) for r in s)
    assert hilbert.shard(empty(spark)).count() == 0


# 2 -------------------------------------------------------------------------------------------------------------------


def _texts(n, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9)))
    out = []
    for _ in range(n):
        ws = [word() for _ in range(rng.randrange(5, 60))]
        bad = rng.random() < 0.3
        kind = rng.randrange(3)
        t = " ".join(ws) if not bad else " ".join(w + rng.choice(["###", "&&&"]) for w in ws) if kind == 0 else " ".join(w.upper() + "!!" for w in ws) if kind == 1 else " ".join([ws[0]] * len(ws))
        out.append((t, int(not bad)))
    return out


def test_gam_held_out():
    a, b = _texts(1500, 1), _texts(800, 2)
    x = lambda v: gam.features(pa.array([t for t, _ in v]))
    y = lambda v: np.array([k for _, k in v], float)
    m = gam.train(x(a), y(a))
    assert ((m.score(x(b)) > 0) == (y(b) > 0.5)).mean() > 0.97 and len(m.pairs) == 6
    # tables: scoring is nothing but additions of looked-up bins
    bins = m.bins(x(b[:5]))
    by_hand = [m.bias + sum(t[bins[i, f]] for f, t in enumerate(m.tables)) + sum(t[m.coarse[f][bins[i, f]], m.coarse[g][bins[i, g]]] for (f, g), t in zip(m.pairs, m.pair_tables)) for i in range(5)]
    assert np.allclose(by_hand, m.score(x(b[:5])))
    # an interaction that no sum of single features has
    rng = np.random.default_rng(0)
    z = rng.random((4000, 3)).astype(np.float32)
    xor = ((z[:, 0] > 0.5) ^ (z[:, 1] > 0.5)).astype(float)
    k = gam.train(z[:3000], xor[:3000], n_pairs=1)
    assert k.pairs == [(0, 1)] and ((k.score(z[3000:]) > 0) == (xor[3000:] > 0.5)).mean() > 0.95


def test_gam_spark(spark):
    rows = [(i, t, q) for i, (t, q) in enumerate(_texts(600, 3))]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, y int")
    lab = d.select("doc_id", F.col("y").alias("quality")).where("doc_id % 2 = 0")
    m = gam.fit(d, lab.unionByName(lab.limit(3)))
    kept = {r["doc_id"] for r in gam.accept(d, m).collect()}
    assert sum((i in kept) != bool(q) for i, _, q in rows) < 12
    got = gam.accept(odd(spark), m, least=0.0).collect()
    assert len(got) == len(ODD) and {r["quality_score"] is None for r in got if r["text"] is None} == {True}
    none = gam.fit(empty(spark), spark.createDataFrame([], "doc_id bigint, quality int"))
    assert gam.accept(empty(spark), none).count() == 0 and gam.accept(odd(spark), none).count() == len(ODD)


# 3 -------------------------------------------------------------------------------------------------------------------


def _brute_exact(have):
    """Combinations by trying all of them, to tell what could be filled exactly."""
    cap = len(have) - 1
    some = [x for x in range(1, cap + 1) if have[x]]
    for x in some:
        for n in range(4):
            for c in __import__("itertools").combinations_with_replacement(some, n):
                if x + sum(c) == cap and all(have[v] >= k for v, k in Counter((x, *c)).items()):
                    yield x
                    break


@pytest.mark.parametrize("seed", range(6))
def test_exact_phase_leaves_nothing_fillable(seed):
    rng = np.random.default_rng(seed)
    h = rng.integers(0, 3, 25) * (rng.random(25) < 0.4)
    h[0] = 0
    left = h.copy()
    made = packing.exact(left)
    used = Counter()
    for combo, n in made:
        assert sum(combo) == 24 and len(combo) <= 4
        for v in combo:
            used[v] += n
    assert all(used[x] + left[x] == h[x] for x in range(25)) and not list(_brute_exact(left))


def test_best_fit_is_sequential():
    rng = np.random.default_rng(5)
    for _ in range(100):
        cap = int(rng.integers(5, 40))
        h = rng.integers(0, 6, cap + 1)
        h[0] = 0
        bins: list[int] = []
        for x in range(cap, 0, -1):
            for _ in range(h[x]):
                fit = [(cap - b, k) for k, b in enumerate(bins) if cap - b >= x]
                if fit:
                    bins[min(fit)[1]] += x
                else:
                    bins.append(x)
        got = Counter()
        for c, n in packing.best_fit(h.copy()):
            got[sum(c)] += n
        assert got == Counter(bins)


def test_sum_index():
    rng = np.random.default_rng(2)
    h = rng.integers(0, 2, 60)
    h[0] = 0
    ix = packing.SumIndex(h)
    for x in np.flatnonzero(h)[::2]:
        h[x] = 0
        ix.remove(int(x))
        f = packing.SumIndex(h)
        assert (f.two == ix.two).all() and (f.three == ix.three).all()


def test_pack(spark):
    rng = random.Random(4)
    n = {i: rng.choice([0, 1, 7, 64, 65, 200, rng.randrange(1, 64)]) for i in range(500)}
    d = spark.createDataFrame([(i, v) for i, v in n.items()], "doc_id bigint, n int")
    rows = packing.pack(d, text_col="n", capacity=64, length=F.col("n")).collect()
    total = defaultdict(list)
    bins = defaultdict(list)
    for r in rows:
        total[r["doc_id"]].append((r["start"], r["length"]))
        if r["length"]:
            bins[r["sequence"]].append((r["position"], r["length"]))
        else:
            assert r["sequence"] is None
    for i, v in n.items():
        at = 0
        for s, k in sorted(total[i]):
            assert s == at
            at += k
        assert at == v
    for v in bins.values():
        at = 0
        for p, k in sorted(v):
            assert p == at
            at += k
        assert at <= 64
    assert sorted(bins) == list(range(len(bins))) and len(bins) <= 1.02 * sum(n.values()) / 64 + 2
    again = packing.pack(d.repartition(7), text_col="n", capacity=64, length=F.col("n")).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))


def test_pack_odd(spark):
    rows = packing.pack(odd(spark)).collect()
    assert sum(r["length"] for r in rows) == sum(len(tokens.encode(t[1])) for t in ODD if t[1])
    assert packing.pack(empty(spark)).count() == 0


# 4 -------------------------------------------------------------------------------------------------------------------


def _longest(doc: list, item: list) -> int:
    best, row = 0, [0] * (len(item) + 1)
    for a in doc:
        row = [0] + [row[k] + 1 if a == b else 0 for k, b in enumerate(item)]
        best = max(best, *row)
    return best


def _corpus(seed, n=60):
    rng = random.Random(seed)
    v = [f"w{i}" for i in range(12)]
    say = lambda k: [rng.choice(v) for _ in range(k)]
    items = [(i, " ".join(say(rng.randrange(4, 30)))) for i in range(15)]
    docs = []
    for i in range(n):
        t = say(rng.randrange(0, 120))
        if i % 3 == 0:
            w = items[i % 15][1].split()
            k = rng.randrange(len(w))
            at = rng.randrange(len(t) + 1)
            t[at:at] = [x.upper() for x in w[: k + 1]]
        docs.append((i, ", ".join(t)))
    return docs, items


@pytest.mark.parametrize("shard", [200, 8 << 20])
def test_decontaminate(spark, shard):
    docs, items = _corpus(1)
    d, b = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    want = {}
    for i, t in docs:
        for k, q in items:
            w = words.plain(q)
            n = _longest(words.plain(t), w)
            if w and n >= min(6, len(w)):
                want[i, k] = n
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.matches(d, b, min_words=6, shard_bytes=shard).collect()}
    assert {k: r["n_words"] for k, r in got.items()} == want
    text = dict(docs), dict(items)
    for (i, k), r in got.items():
        n = r["n_words"]
        assert words.plain(text[0][i])[r["doc_word"] : r["doc_word"] + n] == words.plain(text[1][k])[r["item_word"] : r["item_word"] + n]
    kept = {r["doc_id"] for r in decontaminate.decontaminate(d, b, min_words=6, shard_bytes=shard, piece_words=40).collect()}
    assert kept == {i for i, _ in docs} - {i for i, _ in want}


def test_suffix_array():
    rng = np.random.default_rng(1)
    t = rng.integers(0, 4, 2000).astype(np.uint64)
    sa = decontaminate.suffix_array(t, 16)
    lst = t.tolist() + [0] * 20
    key = lambda p: [x for x in lst[p : (lst.index(0, p))]][:16]
    ks = [key(p) for p in sa.tolist()]
    assert len(sa) == (t != 0).sum() and ks == sorted(ks)


def test_decontaminate_odd(spark):
    b = spark.createDataFrame([(1, "same words here and there again"), (1, None), (None, "no id but some words"), (2, "")], "item_id bigint, text string")
    got = decontaminate.decontaminate(odd(spark), b)
    assert got.columns == odd(spark).columns and got.count() == len(ODD) - 3
    assert decontaminate.decontaminate(odd(spark), b.limit(0)).count() == len(ODD)
    assert decontaminate.decontaminate(empty(spark), b).count() == 0 and decontaminate.matches(empty(spark), b.limit(0)).count() == 0


# 5 -------------------------------------------------------------------------------------------------------------------


def test_trie_join_is_exact():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2**63, size=(150, 2), dtype=np.uint64)
    fp = [base]
    for _ in range(5):
        x = base.copy()
        for r in range(len(x)):
            for bit in rng.choice(128, rng.integers(0, 24), replace=False):
                x[r, bit // 64] ^= np.uint64(1 << int(bit % 64))
        fp.append(x)
    fp = np.unique(np.concatenate(fp), axis=0)
    want = set()
    for i in range(len(fp)):
        want |= {(i, i + 1 + j) for j in np.flatnonzero(np.bitwise_count(fp[i + 1 :] ^ fp[i]).sum(axis=1) <= 17).tolist()}
    for count in (3, 150_000, 1 << 24, 1 << 33):  # other sizes, other blocks, the same pairs
        found = set()
        blocks = simhash.blocks_for(count, 17)
        assert sum(t + 1 for _, _, t in blocks) == 18 and sum(w for _, w, _ in blocks) == 128
        for r, w, bound in blocks:
            t = simhash._turn(fp[:, 0], fp[:, 1], r)
            o = np.lexsort((t[:, 1], t[:, 0]))
            simhash.trie_join(t[o], 0, 17, w, bound, lambda i, j: found.update((min(a, b), max(a, b)) for a, b in zip(o[i].tolist(), o[j].tolist())), leaf=4)
        assert found == want and len(want) > 300


def test_work_by_size():
    """Pairs to compare stay far from the square of the corpus."""
    for n in (10**6, 10**8, 10**10):
        share = sum(sum(math.comb(w, k) for k in range(t + 1)) / 2**w for _, w, t in simhash.blocks_for(n, 18))
        assert share * n < 40 * n**0.5


def _copies(seed=3, n=120):
    rng = random.Random(seed)
    v = ["".join(rng.choice("abcdefghijk") for _ in range(6)) for _ in range(3000)]
    docs, group = [], {}
    for i in range(n):
        w = [rng.choice(v) for _ in range(rng.randrange(60, 150))]
        for c in range(rng.choice([1, 1, 2, 5])):
            x = [rng.choice(v) if c and rng.random() < 0.03 else y for y in w]
            group[len(docs)] = i
            docs.append((len(docs), " ".join(x)))
    return docs, group


def test_simhash_dedup(spark):
    docs, group = _copies()
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    # brute force over all pairs of fingerprints
    fp, _ = simhash._fingerprints(pa.array([t for _, t in docs]))
    label = list(range(len(docs)))
    for i in range(len(docs)):
        for j in np.flatnonzero(np.bitwise_count(fp[i + 1 :] ^ fp[i]).sum(axis=1) <= 18) + i + 1:
            a, b = label[i], label[j]
            label = [min(a, b) if x in (a, b) else x for x in label]
    want = {min(k for k in range(len(docs)) if label[k] == r) for r in set(label)}
    for size in (1 << 19, 16):
        got = simhash.dedup(d, trie_size=size).collect()
        assert {r["doc_id"] for r in got} == want and sum(r["group_size"] for r in got) == len(docs)
    kept = Counter(group[i] for i in want)
    copies = len(docs) - 120
    assert len(kept) == 120 and len(docs) - len(want) >= 0.95 * copies  # all groups live on, and the copies go


def test_simhash_odd(spark):
    got = simhash.dedup(odd(spark)).collect()
    assert Counter(r["doc_id"] for r in got) == Counter([1, 2, None, None, 3, 4, 5, 7])
    assert simhash.dedup(empty(spark)).count() == 0
    assert simhash.dedup(odd(spark), out_simhash=None, out_size=None).columns == odd(spark).columns


def test_components(spark):
    rng = random.Random(7)
    e = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(400, 460)] + [(1, 1), (None, 2), (500, 501), (500, 501)]
    label = {}
    for a, b in e:
        if a is not None and a != b:
            x, y = label.get(a, a), label.get(b, b)
            label.setdefault(a, a), label.setdefault(b, b)
            label = {k: min(x, y) if v in (x, y) else v for k, v in label.items()}
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(e, "a int, b int")).collect()}
    assert got == label
    assert components.components(spark.createDataFrame([], "a int, b int")).count() == 0


# 6 and 10 ------------------------------------------------------------------------------------------------------------


def _marginal(word, used, logp, byte_ids):
    """All segmentations, one by one."""
    w = lattice.MARK + word

    def go(i):
        if i == len(w):
            yield 0.0
            return
        arcs = [(j, logp[used[w[i:j]]]) for j in range(i + 1, len(w) + 1) if w[i:j] in used]
        if w[i] not in used:
            arcs.append((i + 1, sum(logp[byte_ids[b]] for b in w[i].encode())))
        for j, s in arcs:
            for rest in go(j):
                yield s + rest

    v = list(go(0))
    return max(v) + math.log(sum(math.exp(x - max(v)) for x in v))


def test_lattice_sums_all_segmentations():
    _, used, byte_ids = lattice.vocabulary(lattice.VOCABULARY)
    rng = np.random.default_rng(0)
    logp = lattice.log_probabilities(rng.integers(0, 50, (2, 32000)))
    lat = lattice.Lattice(used, logp, byte_ids)
    ws = ["the", "internation", "ñandú", "日本🙂", "x", "a#b", "unbelieva"]
    got = lat.score_words(ws)
    for k in (0, 1):
        assert np.allclose(got[:, k], [_marginal(w, used, logp[k], byte_ids) for w in ws])
    long = "abc" * 40
    assert np.allclose(lat.score_words([long, long[:40]])[1], lat._one(lattice.MARK + long[:40])) and np.isfinite(lat.score_words([long])).all()
    total, n = lattice.Scorer(lat, most=2).texts(["the x the", None, "", "a#b\nx"], at_once=5)
    assert np.allclose(total[0], got[0] * 2 + got[4]) and n.tolist() == [3, 0, 0, 2] and np.allclose(total[3], got[5] + got[4])


def test_lm_score(spark):
    d = odd(spark)
    rows = {str(r["text"])[:20] + str(r["doc_id"]): r for r in lm_score.score(d).collect()}
    c = Counter(w for t in ODD if t[1] for w in t[1].split())
    logp = lattice.log_probabilities(lattice.count_pieces(lattice.VOCABULARY, list(c), list(c.values())))
    _, used, byte_ids = lattice.vocabulary(lattice.VOCABULARY)
    r = rows["same words here and 1"]
    assert r["n_words"] == 6 and math.isclose(r["logprob"], sum(_marginal(w, used, logp[0], byte_ids) for w in "same words here and there again".split()), rel_tol=1e-9)
    assert len([1 for x in lm_score.score(d).collect()]) == len(ODD) and rows["None2"]["logprob"] == 0 and rows["None2"]["logprob_per_word"] is None
    assert lm_score.score(empty(spark)).count() == 0


EN = "the of and to in that is was for on with as his they be at one have this from or had by hot word but what some we can out other were all there when up use your how said an each she".split()
FR = "le de un être et à il avoir ne je son que se qui ce dans en du elle au pour pas sur mais nous comme ou si leur y dire devoir avant deux même prendre aussi celui donner bien encore".split()


def test_langid(spark):
    rng = random.Random(0)
    say = lambda v: " ".join(rng.choice(v) for _ in range(rng.randrange(15, 40)))
    d = spark.createDataFrame([(i, say(EN if i % 2 else FR), "en" if i % 2 else "fr") for i in range(400)] + [(1000, say(EN), "fr"), (1001, say(FR), "en"), (1002, say(FR), None), (1003, None, "en"), (1004, "le", "en"), (1005, say(FR), "xx")], "doc_id int, text string, lang string")
    m = langid.fit(d.where("doc_id < 200"))
    rows = {r["doc_id"]: r for r in langid.accept(d, m).collect()}
    assert m.languages == ["en", "fr"] and set(rows) == set(range(400)) | {1002, 1003, 1004, 1005}
    assert all(rows[i]["lang_found"] == rows[i]["lang"] for i in range(200, 400)) and rows[1003]["lang_found"] is None and rows[1005]["lang_found"] == "fr"


def test_langid_odd(spark):
    m = langid.fit(odd(spark))
    assert langid.accept(odd(spark), m).count() == len(ODD)
    none = langid.fit(empty(spark))
    assert langid.accept(empty(spark), none).count() == 0 and langid.accept(odd(spark), none, out=False).columns == odd(spark).columns


# 7 -------------------------------------------------------------------------------------------------------------------


def test_embeddings(spark):
    rng = np.random.default_rng(0)
    base = rng.standard_normal((400, 32))
    near = base[:200] + rng.standard_normal((200, 32)) * 0.12
    x = np.concatenate([base, near, base[:5]]).astype(np.float32)
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>")
    u = x.astype(float) / np.linalg.norm(x, axis=1, keepdims=True)
    g = np.triu(u @ u.T, 1) >= 0.95
    pairs = embed_dedup.near_pairs(d.select(F.col("vec_id").alias("h1"), F.lit(0).cast("bigint").alias("h2"), F.col("embedding").alias("v")), 0.95, 0.98).collect()
    want = set(zip(*map(np.ndarray.tolist, np.nonzero(g))))
    got = {(r["a"]["h1"], r["b"]["h1"]) for r in pairs}
    assert got <= want and len(got) >= 0.95 * len(want) and len(want) > 100
    kept = {r["vec_id"] for r in embed_dedup.dedup(d).collect()}
    label = np.arange(len(x))
    for a, b in want:
        label[label == label[b]] = label[a]
    assert abs(len(kept) - len(set(label.tolist()))) <= 0.03 * len(x)


def test_embeddings_hot_bucket(spark, monkeypatch):
    monkeypatch.setattr(embed_dedup, "BLOCK", 7)
    v = np.ones((40, 8), np.float32) + np.random.default_rng(1).standard_normal((40, 8)).astype(np.float32) * 0.01
    d = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(v)], "vec_id bigint, embedding array<float>")
    got = embed_dedup.dedup(d).collect()
    assert [(r["vec_id"], r["group_size"]) for r in got] == [(0, 40)]


def test_embeddings_odd(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [float("nan"), 1.0]), (None, [0.0, 1.0]), (7, [0.0, 3.0]), (8, [1.0, 0.0, 0.0]), (9, [None, 1.0])]
    d = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumn("Group_Size", F.lit(1))
    got = Counter(r["vec_id"] for r in embed_dedup.dedup(d).collect())
    assert got == Counter([1, 3, 4, 5, 6, 7, 8, 9])
    assert embed_dedup.dedup(d.limit(0)).count() == 0


# 8 and 9 -------------------------------------------------------------------------------------------------------------

BIG = ["a b" * 9000, "x" * 7000 + " y " + "z" * 3000, "   " * 3000, "it's naïve — \n\n 日本語 🙂 " * 900, "word " * 5000 + "q" * 5000, "", "\n \n" * 2000]


@pytest.mark.parametrize("chunk,overlap", [(1000, 20), (3000, 8), (512, 100)])
def test_resynchronised_counts(chunk, overlap):
    for t in BIG:
        assert token_count.count_text(t, chunk=chunk, overlap=overlap) == len(tokens.encode(t))


def test_token_counts(spark):
    d = spark.createDataFrame([(i % 5, t) for i, t in enumerate(BIG + ["short text", None] + BIG[:1])], "doc_id bigint, text string")
    got = token_count.token_counts(d, chunk=1000, overlap=20)
    want = [(i % 5, len(tokens.encode(t or ""))) for i, t in enumerate(BIG + ["short text", None] + BIG[:1])]
    assert Counter((r["doc_id"], r["n_tokens"]) for r in got.collect()) == Counter(want)
    o = token_count.token_counts(odd(spark)).collect()
    assert Counter((r["doc_id"], r["n_tokens"]) for r in o) == Counter((t[0], len(tokens.encode(t[1] or ""))) for t in ODD)
    assert token_count.token_counts(empty(spark)).count() == 0


def test_blocks_round_trip():
    rng = np.random.default_rng(0)
    for _ in range(60):
        n = rng.integers(0, 400, 5)
        ids = np.where(rng.random(n.sum()) < 0.1, rng.integers(0, 2**32, n.sum()), rng.integers(0, 300, n.sum())).astype(np.uint32)
        data, start, first = pfor.encode(ids, n)
        b, at = data.tobytes(), 0
        for k in range(5):
            assert (pfor.decode(b, start[first[k] : first[k + 1]].tolist()) == ids[at : at + n[k]]).all()
            at += n[k]


def test_token_blocks(spark):
    rows = pfor.token_blocks(odd(spark)).collect()
    assert Counter((r["doc_id"], r["n_tokens"]) for r in rows) == Counter((t[0], len(tokens.encode(t[1] or ""))) for t in ODD)
    text = {t[0]: t[1] for t in ODD if t[0]}
    for r in rows:
        if r["doc_id"]:
            ids = tokens.encode(text[r["doc_id"]] or "")
            assert pfor.decode(bytes(r["payload"]), r["block_starts"]).tolist() == ids and len(r["block_starts"]) == -(-len(ids) // 128)
            if len(ids) > 300:
                assert pfor.decode_block(bytes(r["payload"]), r["block_starts"][2]).tolist() == ids[256:384]
    assert pfor.token_blocks(empty(spark)).count() == 0
