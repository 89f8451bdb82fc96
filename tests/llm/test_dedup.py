"""The dedup operators against brute force, on texts with copies, ties, nulls, empty and very long rows."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from spanloom.llm.common import Scratch
from spanloom.llm.minhash import minhash_dedup
from spanloom.llm.rlz import rlz_dedup
from spanloom.llm.sorted_projection import embedding_dedup

DOCS = "doc_id long, text string, component_id string, kept int"


def corpus(seed: int = 1) -> list[tuple]:
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    texts = []
    for _ in range(30):
        base = [rng.choice(vocab) for _ in range(rng.choice((5, 40, 120)))]
        texts.append(" ".join(base))
        for _ in range(rng.choice((0, 1, 3))):
            copy = list(base)
            for _ in range(rng.choice((0, 1, 2, 6))):
                copy[rng.randrange(len(copy))] = rng.choice(vocab)
            texts.append("  ".join(copy).upper() if rng.random() < 0.2 else " ".join(copy))
    passage = " ".join(rng.choice(vocab) for _ in range(30))
    texts += [f"{t} {passage} tail{i}" for i, t in enumerate(texts[:8])]
    texts += ["", " \n", "one", "one two", "a b c d", "x " * 5000, "Été   fin"]
    rng.shuffle(texts)
    return [*enumerate(texts), (None, "w1 w2 w3 w4 w5"), (500, None), (501, "one two"), (501, "one two")]


def components(ids, links):
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


@pytest.mark.parametrize("k", [4, 5])
def test_minhash_equals_brute_force(spark, k):
    rows = corpus()
    sets = {}
    for i, t in rows:
        w = "".join(c.lower() if c.isascii() else c for c in t or "").encode().split()
        sets[i] = frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) or frozenset([tuple(w)] if w else [])
    ids = [i for i, _ in rows if i is not None]
    links = [(a, b) for a in ids for b in ids if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and sets[b]]
    want = components(ids, links)
    got = minhash_dedup(spark.createDataFrame([(*r, "x", 1) for r in rows], DOCS), k=k).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.n_shingles == len(sets[r.doc_id])
        assert (r.component_id, r.kept) == ((want[r.doc_id], want[r.doc_id] == r.doc_id) if r.doc_id is not None else (None, True))


@pytest.mark.parametrize("block, size", [(256, 2 << 20), (5, 2 << 20), (256, 3_000)])
def test_minhash_compares_large_buckets_in_full(spark, monkeypatch, block, size):
    monkeypatch.setattr("spanloom.llm.minhash.BLOCK", block)
    monkeypatch.setattr("spanloom.llm.minhash.BLOCK_BYTES", size)
    # A chain of edits: far ends share buckets but not links, and the star's centre misses most members.
    words = [f"v{i}" for i in range(100)]
    rows = []
    for i in range(40):
        edited = list(words)
        edited[i * 2 : i * 2 + 6] = [f"e{i}_{j}" for j in range(6)]
        rows.append((i, " ".join(edited)))
    sets = {i: {tuple(t.split()[j : j + 4]) for j in range(97)} for i, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = components(list(sets), links)
    got = {r.doc_id: r.component_id for r in minhash_dedup(spark.createDataFrame(rows, "doc_id long, text string"), k=4).collect()}
    assert got == want


def test_minhash_tells_groups_of_repeated_rows_apart(spark):
    # Of three texts only the last two link; in some triples they share buckets with the first only. Every row is twice there.
    rows, links = [], []
    for c in range(120):
        for m, (at, n) in enumerate(((10, 3), (40, 2), (70, 2))):
            words = [f"v{c}_{i}" for i in range(100)]
            words[at : at + n] = [f"e{c}_{m}_{j}" for j in range(n)]
            rows.append((3 * c + m, " ".join(words)))
        links.append((3 * c + 1, 3 * c + 2))
    want = components([i for i, _ in rows], links)
    got = minhash_dedup(spark.createDataFrame(rows * 2, "doc_id long, text string"), k=4).collect()
    assert len(got) == 2 * len(rows) and {r.doc_id: r.component_id for r in got} == want


def test_minhash_sends_no_bands_or_texts_through_the_driver(spark, tmp_path, monkeypatch):
    # Spark takes both for small: 25 band keys count as one row, texts as their share of a compressed file.
    words = [f"v{i}" for i in range(100)]
    rows = [(i, " ".join(words[: 2 * i] + [f"e{i}_{j}" for j in range(6)] + words[2 * i + 6 :])) for i in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/docs")
    plans, save = [], Scratch.save

    def seen(self, df, few=False):
        plans.append(df._jdf.queryExecution().executedPlan().toString().splitlines())
        return save(self, df, few)

    monkeypatch.setattr(Scratch, "save", seen)
    minhash_dedup(spark.read.parquet(f"{tmp_path}/docs"), k=4)
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    sent, read = [], "\n".join(x for plan in plans for x in plan)
    for plan in plans:
        for i, line in enumerate(plan):
            if line.lstrip(" :+-").startswith("BroadcastExchange"):
                below = next((j for j in range(i + 1, len(plan)) if depth(plan[j]) <= depth(line)), len(plan))
                sent += [x for x in plan[i:below] if "Generate explode" in x or "text:string" in x]
    assert "Generate explode" in read and "text:string" in read and not sent


def test_minhash_of_nothing(spark):
    assert minhash_dedup(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def brute_windows(rows, window):
    first = {}
    for i, t in sorted((r for r in rows if r[1]), key=lambda r: (r[0] is None, r[0] or 0)):
        w = t.encode().split()
        for p in range(len(w) - window + 1):
            first.setdefault(tuple(w[p : p + window]), (i, p))
    out = {}
    for i, t in rows:
        w = (t or "").encode().split()
        gone = set()
        for p in range(len(w) - window + 1):
            if first[tuple(w[p : p + window])] != (i, p):
                gone |= set(range(p, p + window))
        out[i, t] = (len(w), len(gone), b" ".join(x for j, x in enumerate(w) if j not in gone).decode())
    return out


@pytest.mark.parametrize("window", [20, 6])
def test_rlz_equals_brute_force(spark, window):
    rows = corpus(2)
    want = brute_windows(rows, window)
    got = rlz_dedup(spark.createDataFrame([(*r, "x", 1) for r in rows], DOCS), window=window).collect()
    assert len(got) == len(rows)
    texts = dict(rows)
    for r in got:
        assert (r.n_words, r.n_removed, r.kept_text) == want[r.row.doc_id, texts[r.row.doc_id]]
        words = (texts[r.row.doc_id] or "").split()
        for f in r.factors or []:
            source = texts[f.src_doc if f.src_doc != 2**63 - 1 else None].split()
            assert words[f.start : f.start + f.n_words] == source[f.src_start : f.src_start + f.n_words]
            assert f.n_words >= window


def test_rlz_factors_are_greedy(spark):
    rng = random.Random(7)
    a = [f"a{rng.random()}" for _ in range(200)]
    b = [f"b{rng.random()}" for _ in range(200)]
    rows = [(1, " ".join(a)), (2, " ".join(b)), (3, " ".join([*a[10:60], "x", "y", *a[100:130], *b[5:25], "z", *b[50:69]]))]
    got = {r.row.doc_id: r for r in rlz_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [tuple(f) for f in got[3].factors] == [(0, 50, 1, 10), (52, 30, 1, 100), (82, 20, 2, 5)]
    assert (got[3].n_removed, got[3].kept_text) == (100, " ".join(["x", "y", "z", *b[50:69]]))
    # 15 words of another source follow a factor: no factor, but a window across the end occurs earlier as well.
    mixed = [*a[:40], *b[:30]]
    rows = [(1, " ".join(a)), (2, " ".join(mixed[20:55])), (3, " ".join([*mixed[:55], "end"]))]
    got = {r.row.doc_id: r for r in rlz_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    factors = [tuple(f) for f in got[3].factors]
    assert factors[0] == (0, 40, 1, 0) and factors[1:] == [(i, 20, 2, i - 20) for i in range(21, 36)] and got[3].n_removed == 55


def test_rlz_of_a_gram_in_very_many_contexts(spark, monkeypatch):
    # More shards than grams: one gram of eight words stands in every row, and some rows are copies around it.
    hot, rows = " ".join(f"h{i}" for i in range(8)), []
    for i in range(300):
        side = [f"{'abcd'[j % 4]}{i % 150}_{j}" for j in range(60)]
        rows.append((i, " ".join([*side[:30], hot, *side[30:]])))
    want = brute_windows(rows, 20)
    got = rlz_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(9)).collect()
    texts = dict(rows)
    assert all((r.n_words, r.n_removed, r.kept_text) == want[r.row.doc_id, texts[r.row.doc_id]] for r in got) and sum(r.n_removed for r in got) == 150 * 68


def test_rlz_of_rows_without_an_id(spark):
    words = " ".join(f"w{i}" for i in range(30))
    rows = [(None, words), (None, words), (None, "first " + words), (1, "z " + words)]
    got = rlz_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.row.doc_id or 0, r.n_words, r.n_removed) for r in got) == [(0, 30, 30), (0, 30, 30), (0, 31, 30), (1, 31, 0)]


def test_rlz_settles_in_small_buffers(spark):
    rows = corpus(3)
    one = rlz_dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    many = rlz_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(17))
    key = lambda r: (r.row.doc_id is None, r.row.doc_id or 0, r.kept_text)
    assert [(r.n_removed, r.kept_text) for r in sorted(one.collect(), key=key)] == [(r.n_removed, r.kept_text) for r in sorted(many.collect(), key=key)]


def test_rlz_of_nothing(spark):
    assert rlz_dedup(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_rlz_digest_matches_hashlib(spark):
    from pyspark.sql import functions as F

    df = rlz_dedup(spark.createDataFrame([(1, "é b\tc")], "doc_id long, text string"))
    assert df.select(F.sha2(F.encode("kept_text", "utf-8"), 256).alias("s")).first().s == hashlib.sha256("é b c".encode()).hexdigest()


def test_projection_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    rows, base = [], rng.standard_normal((40, 16))
    for i in range(400):
        v = base[i % 40] + rng.standard_normal(16) * (0.02 if i % 3 else 0.2)
        rows.append((i, [float(np.float32(x)) for x in v], int(i % 2), 7))
    rows += [(1000, rows[0][1], 0, 7), (1001, rows[0][1], 1, 7), (1002, None, 0, 7), (1003, [], 0, 7), (1004, [0.0] * 16, 0, 7), (1005, [float("nan")] * 16, 0, 7)]
    rows += [(1006, [None] * 16, 0, 7), (1007, rows[0][1], None, 7), (1008, [2 * x for x in rows[0][1]], 0, 7), (None, rows[0][1], 0, 7), (1009, [1.0, 2.0], 0, 7), (1010, [1.0, 2.0], 0, 7), (1000, rows[0][1], 0, 7)]
    fine = {r[0]: (np.array(r[1]) / np.linalg.norm(r[1]), r[2]) for r in rows if r[0] is not None and r[1] and None not in r[1] and np.isfinite(r[1]).all() and any(r[1]) and r[2] is not None}
    links = [(a, b) for a, (u, x) in fine.items() for b, (v, y) in fine.items() if a < b and x == y and len(u) == len(v) and u @ v >= 0.98]
    want, n = components([r[0] for r in rows if r[0] is not None], links), dict.fromkeys((r[0] for r in rows), 0)
    for a, b in links:
        n[a] += 1
        n[b] += 1
    got = embedding_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, n_links int")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_links, r.component_id) == ((n[r.vec_id], want[r.vec_id]) if r.vec_id is not None else (0, None)), r
        assert r.kept == (r.vec_id is None or r.component_id == r.vec_id)


@pytest.mark.parametrize("block", [8192, 700])
def test_projection_finds_isolated_pairs_of_a_dense_label(spark, monkeypatch, block):
    # All vectors of the label lie close together, and each is linked with at most one other.
    monkeypatch.setattr("spanloom.llm.sorted_projection.BLOCK", block)
    rng, n = np.random.default_rng(8), 4000
    v = rng.standard_normal((n, 64)) * 0.2 / 8 + np.eye(64)[0]
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    half = n // 2
    v[half:] = v[:half] + rng.standard_normal((half, 64)) * 0.17 / 8
    v = v.astype(np.float32).astype(np.float64)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    least = 0.983
    hit = u @ u.T >= least
    np.fill_diagonal(hit, False)
    a, b = np.nonzero(hit)
    want = components(range(n), zip(a.tolist(), b.tolist()))
    assert 1000 < len(a) < 3 * n
    rows = spark.createDataFrame([(i, x.tolist(), 1) for i, x in enumerate(v)], "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup(rows, least=least).collect()}
    assert got == {i: (int(hit[i].sum()), want[i]) for i in range(n)}


def test_projection_of_text_labels_and_extreme_components(spark):
    rows = [(1, [1e200, 1e200], "a"), (2, [1e-200, 1e-200], "a"), (3, [1.0, 1.0], "b"), (4, [2.0, 2.0], "b"), (5, [1.0, -1.0], "a"), (6, [1.0, 1.0], None)]
    got = embedding_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == {1: (1, 1), 2: (1, 1), 3: (1, 3), 4: (1, 3), 5: (0, 5), 6: (0, 6)}


def test_projection_of_nothing(spark):
    assert embedding_dedup(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).collect() == []
