"""Operators on defining cases and against brute force."""

from __future__ import annotations

import io
import random
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.functions import text as T
from spanloom.operators import calibrate, decode, evaluate, graph, infer, linking, retrieval, similarity, spans, split, validate


def one(spark, **columns):
    return spark.createDataFrame([tuple(columns.values())], list(columns))


# ------------------------------------------------------------ F, S02, P23
def test_scalars(spark):
    df = one(spark, a="kitten", b="sitting", c="a\r\nb", j='x ```json\n{"k": 1}\n``` y', t="gọi 0912345678 a@b.vn 1/2/1990 123456789")
    r = df.select(
        T.similarity(F.col("a"), F.col("b")).alias("s"), T.newline_style(F.col("c")).alias("n"), T.fenced_json(F.col("j")).alias("j"),
        F.regexp_count("t", F.lit(T.PRIVACY["phone"])).alias("p"), F.regexp_count("t", F.lit(T.PRIVACY["email"])).alias("e"),
        F.regexp_count("t", F.lit(T.PRIVACY["birth_date"])).alias("d"), F.regexp_count("t", F.lit(T.PRIVACY["national_id"])).alias("i"),
        T.logit(T.sigmoid(F.lit(0.3))).alias("l"), T.ngrams(F.split(F.lit("a b c"), " "), 2).alias("g"), T.char_ngrams(F.lit("abcd"), 3).alias("c"),
        T.jaccard(F.array().cast("array<string>"), F.array().cast("array<string>")).alias("z"), T.decimal_point(F.lit("0,5 a,b")).alias("dp"), T.scenario_id(F.lit("s"), F.lit("n")).alias("sid"),
    ).first()
    assert r.s == pytest.approx(1 - 3 / 7) and (r.n, r.j, r.p, r.e, r.d, r.i, r.z, r.dp) == ("crlf", '{"k": 1}', 1, 1, 1, 1, 1.0, "0.5 a,b")
    assert r.l == pytest.approx(0.3) and r.g == ["a b", "b c"] and r.c == ["abc", "bcd"] and len(r.sid) == 12


# ------------------------------------------------------------ J04, J05, W01, W06, W11
def random_spans(rng, n, docs=4, width=400):
    out = []
    for i in range(n):
        a = rng.randrange(width)
        out.append((rng.randrange(docs), a, a + rng.randint(1, 200 if i % 9 == 0 else 20), f"s{i:03}", rng.choice("AB"), round(rng.random(), 2)))
    return out


def test_j04_overlap_join_equals_all_pairs(spark):
    rng = random.Random(1)
    a, b = random_spans(rng, 80), random_spans(rng, 80)
    left = spark.createDataFrame([r[:4] for r in a], "doc_id long, start long, end long, id string")
    right = spark.createDataFrame([r[:4] for r in b], "doc_id long, r_start long, r_end long, r_id string")
    got = sorted((r.id, r.r_id) for r in spans.overlap_join(left, right, cell=32).collect())
    assert got == sorted((x[3], y[3]) for x in a for y in b if x[0] == y[0] and x[1] < y[2] and y[1] < x[2])


def test_j05_nearest_before(spark):
    rng = random.Random(2)
    a, b = [(rng.randrange(3), rng.randrange(50), i) for i in range(40)], [(k, t, f"v{k}{t}") for k in range(3) for t in sorted(rng.sample(range(50), 9))]
    got = spans.nearest_before(spark.createDataFrame(a, "k long, at long, i long"), spark.createDataFrame(b, "k long, at long, v string"), "k", "at", "v").collect()
    for r in got:
        best = max(((t, v) for k, t, v in b if k == r.k and t <= r.at), default=(None, None))
        assert (r.nearest_at, r.nearest_v) == best


def test_w06_w11_folds_equal_loops(spark):
    rows = random_spans(random.Random(3), 120)
    df = spark.createDataFrame([(*r, r[3]) for r in rows], "doc_id long, start long, end long, id string, type string, score double, text string")
    want = set()
    for d in range(4):
        taken = []
        for r in sorted((r for r in rows if r[0] == d), key=lambda r: (r[1] - r[2], r[1], r[2], r[3])):
            if not any(x[1] < r[2] and r[1] < x[2] for x in taken):
                taken.append(r)
        want |= {(r[0], r[1], r[2]) for r in taken}
    assert {(r.doc_id, r.start, r.end) for r in spans.greedy_non_overlap(df).collect()} == want
    want = set()
    for d in range(4):
        kept = []
        for r in sorted((r for r in rows if r[0] == d), key=lambda r: (-r[5], r[3])):
            if not any(x[1] < r[2] and r[1] < x[2] and x[4] != r[4] for x in kept):
                kept.append(r)
        want |= {r[3] for r in kept}
    assert {r.id for r in spans.drop_forbidden(df).collect()} == want


def test_w01_clusters(spark):
    df = spark.createDataFrame([(1, 0, 4, "fever", "a"), (1, 0, 4, "other", "b"), (1, 0, 5, "FEVER", "c"), (1, 9, 12, "x", "d")], "doc_id long, start long, end long, text string, id string")
    assert sorted(sorted(r.members) for r in spans.cluster(df).collect()) == [["a", "b", "c"], ["d"]]


# ------------------------------------------------------------ J15, A30, J11, retrieval
def test_j15_prefix_filter_equals_all_pairs(spark):
    rng = random.Random(4)
    sets = [(i, [f"t{rng.randrange(30)}" for _ in range(rng.choice((0, 1, 4, 8, 9)))]) for i in range(120)]
    got = {(r.a, r.b): r.jaccard for r in similarity.jaccard_join(spark.createDataFrame(sets, "id long, items array<string>"), 0.6).collect()}
    s = {i: set(x) for i, x in sets}
    first = {}
    for i, x in s.items():
        first.setdefault(frozenset(x), i)
    heads = sorted(first.values())
    full = {(a, b): len(s[a] & s[b]) / len(s[a] | s[b]) for a in heads for b in heads if a < b and s[a] and s[b] and len(s[a] & s[b]) >= 0.6 * len(s[a] | s[b])}
    copies = {(first[frozenset(x)], i): 1.0 for i, x in s.items() if first[frozenset(x)] != i}
    assert copies and got == full | copies


def test_a33_leakage_across_splits(spark):
    rows = [(1, "train", list("abcde")), (2, "train", list("abcde")), (3, "test", list("abcde")), (4, "test", list("abcdef")), (5, "dev", list("xyz"))]
    got = split.leakage(spark.createDataFrame(rows, "id long, split string, items array<string>"), 0.8).collect()
    assert sorted((r.split_a, r.split_b, r.a, r.b, round(r.jaccard, 4)) for r in got) == [("test", "train", 3, 1, 1.0), ("train", "test", 1, 4, 0.8333)]


def test_a30_components(spark):
    chain = [(i, i + 1) for i in range(0, 40) if i % 10 != 9]
    got = {r.vertex: r.component for r in graph.components(spark.createDataFrame(chain, "a long, b long"), spark.range(50).withColumnRenamed("id", "vertex")).collect()}
    assert all(got[i] == i // 10 * 10 for i in range(40)) and all(got[i] == i for i in range(41, 50))
    keys = [(1, "f", "x"), (2, "f", "x"), (2, "g", "y"), (3, "g", "y"), (4, "f", None), (5, "f", None)]
    groups = graph.shared_key_components(spark.createDataFrame(keys, "id long, field string, value string")).collect()
    assert sorted((r.id, r.component) for r in groups) == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 5)] and len({r.group_id for r in groups}) == 3


def test_retrieval_finds_a_misspelt_name(spark):
    q = spark.createDataFrame([(1, "metoprolal")], "query_id long, text string")
    al = spark.createDataFrame([("R1", "metoprolol"), ("R2", "warfarin"), ("R2", "metformin")], "id string, alias string")
    (r,) = retrieval.top_k(retrieval.ngram_search(q, al), 1).collect()
    assert r.id == "R1" and 0 < r.score < 1
    assert retrieval.exact_search(q, al).count() == 0


# ------------------------------------------------------------ linking
def test_a24_and_a06(spark):
    rows = spark.createDataFrame([("q", "A", 0.8), ("q", "B", 0.8), ("q", "C", 0.1)], "request_id string, concept_id string, p double")
    assert [r.concept_id for r in linking.expected_jaccard_set(rows).orderBy("k").collect()] == ["A", "B"]
    r = linking.ranking_metrics(spark.createDataFrame([("q", 1, False), ("q", 2, True)], "query_id string, rank int, hit boolean")).first()
    assert (r.recall_1, r.recall_2, r.mrr) == (0.0, 1.0, 0.5)


def test_a22_a23_w12(spark):
    rows = spark.createDataFrame([("q", "A", "x", 0.2, "e1"), ("q", "A", "x", 0.6, "e2"), ("q", "A", "y", 1.0, "e1"), ("q", "B", "x", 0.1, "e3")], "request_id string, concept_id string, channel string, score double, evidence string")
    m = linking.merge_candidates(rows).withColumn("fused", linking.fused(F.col("scores"), {"x": 0.5, "y": 0.9}))
    got = {r.concept_id: (r.scores, r.evidence, r.fused) for r in m.collect()}
    assert got["A"] == ({"x": 0.6, "y": 1.0}, ["e1", "e2"], 1.0) and got["B"][2] == pytest.approx(0.05)
    assert linking.abstain(m, 1.1).count() == 0


def test_j03_tiers_equal_a_plain_greedy_choice(spark):
    rng = random.Random(5)
    make = lambda: [(k, i, s := rng.randrange(12), s + rng.randint(1, 4), rng.choice("AB")) for k in range(30) for i in range(rng.randint(0, 7))]
    left, right = make(), make()
    over = lambda x, y: x[2] < y[3] and y[2] < x[3]
    tiers = (lambda x, y: x[2:] == y[2:], lambda x, y: x[2:4] == y[2:4], lambda x, y: x[4] == y[4] and over(x, y), over)
    want = set()
    for k in range(30):
        ls, rs = ([x for x in side if x[0] == k] for side in (left, right))
        for t, fits in enumerate(tiers, 1):
            for x in list(ls):
                near = [y for y in rs if fits(x, y)]
                if near:
                    y = min(near, key=lambda y: (abs(x[2] - y[2]) + abs(x[3] - y[3]), y[2], y[3], y[4], y[1]))
                    want.add((k, x[1], y[1], t))
                    ls.remove(x)
                    rs.remove(y)
    frame = lambda rows: spark.createDataFrame(rows, "sample_id int, i int, start int, end int, type string")
    assert {tuple(r) for r in decode.four_tier_alignment(frame(left), frame(right)).collect()} == want and len({t for *_, t in want}) == 4


def test_a34_a45_p09_j06(spark):
    g = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1), ("d", 0)], "group string, n long")
    assert {r.group: r.quota for r in split.apportion(g, 10).collect()} == {"a": 4, "b": 3, "c": 3, "d": 0} and {r.quota for r in split.apportion(g.where("n = 0"), 10).collect()} == {0}
    rows = spark.createDataFrame([(1, "x"), (2, "xy")], "id long, t string")
    got = {r.bucket: (r.n, r.first_id) for r in split.buckets(rows, {"x": F.contains("t", F.lit("x")), "y": F.contains("t", F.lit("y")), "z": F.col("t").isNull()}).collect()}
    assert got == {"x": (2, 1), "y": (1, 2), "z": (0, None)}
    assert [r.r for r in rows.select(validate.reasons({"a": F.col("id") > 0, "b": F.col("id") > 1}).alias("r")).collect()] == [["a"], ["a", "b"]]
    points = spark.createDataFrame([(1, 4), (1, 5), (1, 300)], "doc_id long, at long")
    spans_ = spark.createDataFrame([(1, 2, 5), (1, 5, 400)], "doc_id long, r_start long, r_end long")
    assert sorted((r["at"], r.r_start) for r in spans.containing(points, spans_).collect()) == [(4, 2), (5, 5), (300, 5)]


def test_small_sides_meet_documents_before_any_shuffle(spark):
    docs = spark.createDataFrame([(i, ["a", "b", f"w{i}"]) for i in range(50)], "doc_id long, w array<string>")
    few = spark.createDataFrame([(1, ["a", "b"])], "query_id long, tk array<string>")
    plan = lambda df: df._jdf.queryExecution().sparkPlan().toString().splitlines()
    scored = plan(retrieval.bm25(few, docs, "doc_id", "w"))
    semi = [i for i, line in enumerate(scored) if "BroadcastHashJoin" in line and "LeftSemi" in line]
    # Below each of them there are the documents' tokens alone.
    assert semi and all("Generate explode" in "".join(scored[i : i + 4]) for i in semi)
    found = split.contamination(docs, few.select(F.col("query_id").alias("item_id"), F.col("tk").alias("w")), 2)
    lines = plan(found)
    assert any("BroadcastHashJoin [h" in line or "BroadcastHashJoin" in line and "xxhash64" in line for line in lines)
    assert [(r.item_id, r.shared) for r in found.collect()] == [(1, 1)] * 50


def test_w12_ontology_rerank(spark):
    rows = [("d", "ICD10", "A", 0.5), ("d", "ICD10", "B", 0.45), ("d", "RxNorm", "1", 0.9), ("m", "RxNorm", "1", 0.6), ("m", "RxNorm", "2", 0.7), ("e", "ICD10", "A", 0.3), ("s", "ICD10", "A", 0.9), ("s", "ICD10", "B", 0.1)]
    c = spark.createDataFrame(rows, "request_id string, terminology string, concept_id string, fused double")
    shape = "request_id string, entity_type string, exact_match boolean, alias_ambiguity int, hierarchy_conflict boolean, uncertainty double, kind string, mention_ingredient array<string>, mention_strength array<string>, mention_dose_form array<string>"
    asked = [("d", "CHẨN_ĐOÁN", False, 1, True, 0.0, None, None, None, None), ("m", "THUỐC", False, 1, False, 0.0, "medication", ["x"], ["5"], []), ("e", "CHẨN_ĐOÁN", True, 5, True, 1.0, None, None, None, None), ("s", "CHẨN_ĐOÁN", False, 1, False, 0.0, None, None, None, None)]
    r = spark.createDataFrame(asked, shape)
    o = spark.createDataFrame([("ICD10", "A", None, None, None), ("ICD10", "B", None, None, None), ("RxNorm", "1", "x", "5", "t"), ("RxNorm", "2", "y", "5", "t")], "terminology string, concept_id string, ingredient string, strength string, dose_form string")
    got = {(x.request_id, x.concept_id): (x["rank"], round(x.reranked, 6), x.reason) for x in linking.ontology_rerank(c, r, o).collect()}
    assert got == {
        ("d", "A"): (1, 0.45, "gated_on"), ("d", "B"): (2, 0.4, "gated_on"), ("m", "1"): (1, 0.75, "gated_on"), ("e", "A"): (1, 0.3, "unique_exact_match"),
        ("s", "A"): (1, 0.9, "high_margin_simple_case"), ("s", "B"): (2, 0.1, "high_margin_simple_case"),
    }
    soft = {x.concept_id: round(x.reranked, 6) for x in linking.ontology_rerank(c, r, o, hard_ingredient=False).where("request_id = 'm'").collect()}
    assert soft == {"1": 0.75, "2": 0.65}
    assert {x.reason for x in linking.ontology_rerank(c, r, o, "off").collect()} == {"feature_disabled"} and {x.reason for x in linking.ontology_rerank(c, r, o, "always_on").collect()} == {"always_on"}
    with pytest.raises(Exception, match="not in the snapshot"):
        linking.ontology_rerank(c, r, o.where("concept_id <> 'A'")).collect()


def test_a29_meta_fusion(spark):
    d = spark.createDataFrame([(0.8, None, "A"), (None, None, "B")], "x double, y double, t string")
    v = d.select(calibrate.fuse_meta({"x": F.col("x"), "y": F.col("y")}, {"x": 2.0}, -0.6).alias("m"), calibrate.accepted(F.col("x"), F.col("t"), {"A": 0.7}).alias("ok"), calibrate.fuse_sources({"x": F.col("x"), "y": F.col("y")}, {}, "zero").alias("z")).collect()
    assert v[0].m == pytest.approx(1 / (1 + np.exp(-1.0))) and [r.ok for r in v] == [True, False] and v[0].z == 0.4


# ------------------------------------------------------------ evaluation, calibration
def test_j01_a01_alignment(spark):
    schema = "doc_id long, start long, end long, type string, n long"
    gold = spark.createDataFrame([(1, 0, 2, "S", 1), (1, 8, 10, "S", 2), (1, 8, 10, "S", 3)], schema)
    pred = spark.createDataFrame([(1, 8, 10, "S", 1), (1, 0, 2, "S", 2), (1, 1, 3, "S", 3)], schema)
    r = evaluate.counted(evaluate.multiset_align(gold, pred, ["doc_id", "start", "end", "type"], "n"), []).first()
    assert (r.tp, r.fp, r.fn, r.f1) == (2, 1, 1, pytest.approx(2 / 3, abs=1e-6))
    j = spark.sql("select array('a','b') as a, array('a','c') as b, cast(null as array<string>) as n, cast(array() as array<string>) as e")
    got = j.select(evaluate.optional_jaccard(F.col("a"), F.col("b")), evaluate.optional_jaccard(F.col("n"), F.col("e")), evaluate.optional_jaccard(F.col("n"), F.col("e"), strict=True)).first()
    assert tuple(got) == (pytest.approx(1 / 3), 1.0, 0.0)


def test_j03_four_tiers(spark):
    schema = "sample_id string, i long, start long, end long, type string"
    left = spark.createDataFrame([("s", 0, 0, 5, "A"), ("s", 1, 6, 9, "A"), ("s", 2, 20, 30, "A"), ("s", 3, 40, 50, "A")], schema)
    right = spark.createDataFrame([("s", 0, 6, 9, "B"), ("s", 1, 0, 5, "A"), ("s", 2, 22, 28, "A"), ("s", 3, 45, 60, "B")], schema)
    assert sorted((r.left, r.right, r.tier) for r in decode.four_tier_alignment(left, right).collect()) == [(0, 1, 1), (1, 0, 2), (2, 2, 3), (3, 3, 4)]


def test_a26_a27_a28(spark):
    x, y = np.array([-3.0, -1, 1, 3]), np.array([0.0, 0, 1, 1])
    a, b = calibrate.platt(x, y)
    assert a > 1 and abs(b) < 1e-9
    assert calibrate.isotonic(np.array([1.0, 2, 3, 4]), np.array([0.0, 1, 0, 1])) == [(1.0, 0.0), (3.0, 0.5), (4.0, 1.0)]
    points = spark.createDataFrame([("s", "t", float(u), int(v)) for u, v in zip(x, y)], "source string, entity_type string, logit double, label int")
    for method in ("platt", "isotonic"):
        assert calibrate.fit(points, method).count() == 1
    assert calibrate.temperature_grid(points, ["source"]).first().temperature == 0.1
    df = spark.sql("select array(1d, 3d) as x, array(0.2d, 0.9d) as y")
    assert [df.select(calibrate.step_value(F.lit(v), F.col("x"), F.col("y"))).first()[0] for v in (0.5, 2.0, 9.0)] == [0.2, 0.9, 0.9]
    bins = calibrate.reliability(spark.createDataFrame([(0.05, 0), (1.0, 1)], "p double, label int")).orderBy("bin").collect()
    assert len(bins) == 10 and [r.n for r in bins] == [1, *[0] * 8, 1] and bins[0].gap == pytest.approx(0.025)


# ------------------------------------------------------------ decode
WEIGHTS = dict(span=1.0, wrong_span=1.0, type=1.0, wrong_type=1.0, label=1.0, wrong_label=1.0, label_bar=0.5, code=1.0, wrong_code=2.0, code_bar=0.5)


def test_w07_w08_decode(spark):
    schema = "doc_id long, id string, start long, end long, span_p double, types map<string,double>, assertions map<string,double>, candidates map<string,double>"
    rows = [(1, "a", 0, 5, 0.9, {"T": 0.9}, {"n": 0.9, "h": 0.2}, {"x": 0.95, "y": 0.55}), (1, "b", 3, 8, 0.9, {"T": 0.9}, {"n": 0.9, "h": 0.2}, {"x": 0.95, "y": 0.55}), (1, "c", 20, 25, 0.9, {"T": 0.2}, {}, {}), (1, "d", 30, 31, 0.8, {"T": 0.9}, {}, {})]
    got = {r.id: (r.assertions, r.candidates) for r in decode.utility_decode(spark.createDataFrame(rows, schema), {"T": 0.5}, WEIGHTS).collect()}
    assert got == {"a": (["n"], ["x"]), "d": ([], None)}


def test_w02_w03_w09_w14(spark):
    clusters = spark.createDataFrame([(1, 0, 10, 0.9, ["a"], 1), (1, 2, 4, 0.8, ["a", "b"], 2), (1, 8, 14, 0.7, ["a"], 1), (1, 20, 24, 0.9, ["a", "a", "a"], 3), (1, 30, 31, 0.1, ["a"], 1)], "doc_id long, start int, end int, score double, sources array<string>, members int")
    assert sorted((r.start, r.end) for r in decode.resolve_boundaries(clusters).collect()) == [(0, 10), (2, 4)]
    ev = spark.createDataFrame([(1, "A", 1.0, 0.9), (1, "B", 1.0, 0.2), (2, "A", 1.0, 0.5), (2, "B", 1.0, 0.5)], "cluster_id long, type string, weight double, score double")
    assert [(r.cluster_id, r.type) for r in decode.normalised_types(ev).collect()] == [(1, "A")]
    s = spark.createDataFrame([(1, "a", 0, 5, "A", 0.9), (1, "b", 0, 5, "A", 0.8), (1, "c", 3, 6, "B", 0.7), (1, "d", 4, 9, "C", 0.6), (1, "e", 50, 51, "A", 0.1)], "doc_id long, id string, start long, end long, type string, utility double")
    actions = {("A", "A"): "forbid", ("B", "A"): "forbid", ("A", "C"): "allow", ("B", "C"): "allow"}
    got = {r.id: r.reason for r in decode.resolve_consistency(s.withColumn("text", F.lit("x")), actions, 0.5).collect()}
    assert got == {"a": "kept", "b": "exact_duplicate", "c": "overlap_conflict", "d": "kept", "e": "utility_below_minimum"}
    got = {r.id: r.reason for r in decode.resolve_consistency(s.withColumn("text", F.col("id")), actions | {("A", "A"): "allow"}, 0.0).collect()}
    assert got == {"a": "kept", "b": "kept", "c": "overlap_conflict", "d": "kept", "e": "kept"}
    # An overlap without a rule takes both, and even a copy counts for it.
    got = {r.id: r.reason for r in decode.resolve_consistency(s.withColumn("text", F.lit("x")), {("A", "C"): "allow", ("B", "C"): "allow", ("A", "B"): "forbid"}, 0.0).collect()}
    assert got == {"a": "unsupported_overlap", "b": "exact_duplicate", "c": "kept", "d": "kept", "e": "kept"}
    assert one(spark, r=0.9, m=0.9).select(decode.assertion_mix(F.col("r"), F.col("m"), 0.5)).first()[0] == pytest.approx(0.9)


# ------------------------------------------------------------ split
def test_a31_a32_splits(spark):
    with pytest.raises(ValueError):
        split.assign_groups({"a": 1, "b": 1})
    df = spark.createDataFrame([(i, f"g{i % 10}") for i in range(100)], "id long, g string")
    out = split.grouped_split(df, "g")
    m = split.manifest(out, "g")
    with pytest.raises(ValueError, match="without a group"):
        split.grouped_split(spark.createDataFrame([(1, None), (2, "a"), (3, "b"), (4, "c")], "id long, g string"), "g")
    numbers = split.grouped_split(spark.createDataFrame([(i, i % 5) for i in range(20)], "id long, g int"), "g")
    assert numbers.count() == 20 and dict(numbers.dtypes)["g"] == "int"
    assert m["leaking_groups"] == 0 and sum(c[0] for c in m["counts"].values()) == 100 and m == split.manifest(split.grouped_split(df, "g"), "g")


def test_a10_a45_a46_a47(spark):
    b = split.bootstrap([(0.1, 0.3), (0.2, 0.4)], 50)
    assert b["delta"] == pytest.approx(0.2) and b["low"] <= b["delta"] <= b["high"] + 1e-9
    assert split.largest_remainder(10, {"a": 1, "b": 1, "c": 1}) == {"a": 4, "b": 3, "c": 3}
    assert b["relevant"] and not split.bootstrap([(0.1, 0.3), (0.4, 0.2)], 50)["relevant"]
    signals = [("x", True, False, 50, 5, False), ("y", True, True, 0, 100, True), ("z", None, None, None, None, None)]
    got = split.boosts(spark.createDataFrame(signals, "profile string, missing_type boolean, missing_label boolean, errors int, deficit int, bad_positions boolean"))
    assert {r.profile: r.weight for r in got.collect()} == {"x": 4.5, "y": 4.5, "z": 1.0}
    assert split.next_profile({"a": 1}, {"a": 2, "b": 5}) == "b"


# ------------------------------------------------------------ validation
def test_validation(spark):
    entity = "struct<text:string,type:string,start:int,end:int,assertions:array<string>,candidates:array<string>>"
    rows = [("s", "sốt cao", [("sốt", "TRIỆU_CHỨNG", 0, 3, ["isNegated"], None), ("cao", "X", 4, 9, ["?"], ["c"]), ("ca", "TRIỆU_CHỨNG", 2, 5, [], None)], True)]
    r = validate.sample_report(spark.createDataFrame(rows, f"sample_id string, text string, entities array<{entity}>, confirmed boolean")).first()
    assert set(r.errors) == {"out_of_bounds", "unknown_type", "unknown_assertion", "candidates_not_allowed", "text_mismatch", "overlap"} and r.warnings == []
    df = spark.createDataFrame(rows, f"sample_id string, text string, entities array<{entity}>, confirmed boolean")
    got = df.select(validate.filter_schema(F.col("entities")).alias("f"), validate.masked(F.col("text"), F.slice("entities", F.lit(1), F.lit(1))).alias("m"), validate.paraphrase_valid(F.col("entities"), F.col("entities"), True).alias("p")).first()
    assert len(got.f) == 2 and got.m == "    cao" and got.p
    c = spark.sql("select array(named_struct('confidence', 2d), named_struct('confidence', cast(null as double)), named_struct('confidence', 0.1d)) as e, array('E11.9') as c, array('5') as q, array('10') as d, array() as n")
    got = c.select(
        F.transform(validate.filter_confidence(F.col("e"), 0.5), lambda e: e["confidence"]), validate.family_allowed(F.col("c"), ("E11",)),
        validate.structured_conflict({"form": F.col("n"), "strength": F.col("q")}, {"form": F.col("n"), "strength": F.col("d")}), validate.labeling_status(F.lit(True), F.lit(2), F.lit(0)),
    ).first()
    assert tuple(got) == ([1.0, None], True, "strength", "all_rejected")


# ------------------------------------------------------------ inference, sources, sinks, streaming
def test_infer(spark):
    docs = spark.createDataFrame([(1, "không sốt nhưng ho"), (2, None)], "doc_id long, text string")
    found = infer.entities(docs, {"TRIỆU_CHỨNG": ("sốt", "ho")}).orderBy("start").collect()
    assert [(r.text, r.start, r.end, r.assertions) for r in found] == [("sốt", 6, 9, ["isNegated"]), ("ho", 16, 18, [])]
    assert infer.entities(docs, {}).count() == 0
    p = spark.createDataFrame([(1, "ho", 16, 18), (1, "HO", 0, 1)], "doc_id long, surface string, expected_start int, expected_end int")
    assert {(r.surface, r.method, r.start) for r in infer.grounded(p, docs).collect()} == {("ho", "exact_raw", 16), ("HO", "case_insensitive", 16)}


def test_sources(spark, tmp_path):
    from pyspark.sql.types import LongType, StringType, StructField, StructType

    from spanloom.sources import readers

    (tmp_path / "docs").mkdir()
    for name, data in (("10.txt", b"\xef\xbb\xbfa\r\nb"), ("2.txt", b"x\ry"), ("bad.txt", b"\xff\xfe"), ("skip.md", b"no")):
        (tmp_path / "docs" / name).write_bytes(data)
    got = {r.document_id: r for r in readers.read_documents(spark, str(tmp_path / "docs")).orderBy("file_number", "document_id").collect()}
    assert list(got) == ["2", "10", "bad"] and (got["10"].raw_text, got["10"].had_bom, got["10"].newline_style) == ("a\r\nb", True, "crlf")
    assert got["2"].newline_style == "cr" and got["bad"].error == "encoding" and got["bad"].raw_text is None
    some = readers.read_documents(spark, [str(tmp_path / "docs/2.txt"), str(tmp_path / "docs/skip.md")]).collect()
    assert sorted(r.document_id for r in some) == ["2", "skip"]
    with pytest.raises(ValueError, match="twice"):
        readers.read_documents(spark, ["a", "a"])
    kept = {r.document_id: r for r in readers.read_documents(spark, str(tmp_path / "docs"), bom="preserve").collect()}
    assert kept["10"].raw_text == "﻿a\r\nb"
    shape = StructType([StructField("a", LongType()), StructField("b", StringType())])
    (tmp_path / "x.jsonl").write_text('{"a": 1, "b": "x"}\n\n{"a": 2, "z": 1}\nnope\n')
    rows = readers.read_jsonl(spark, str(tmp_path / "x.jsonl"), shape).collect()
    assert [r.error for r in rows] == [None, "unknown keys: z", "malformed"]
    with pytest.raises(Exception, match="unknown keys"):
        readers.read_jsonl(spark, str(tmp_path / "x.jsonl"), shape, strict=True).collect()
    (tmp_path / "x.json").write_text('[{"a": 1},\n {"a": 5, "b": "q"}]')
    assert [(r.a, r.source_index) for r in readers.read_json_array(spark, str(tmp_path / "x.json"), shape).collect()] == [(1, 0), (5, 1)]


def test_terminology_archives(spark, tmp_path):
    from spanloom.sources import readers

    icd = ["4;;;;A00.1;;;;Bệnh tả;tả;", "3;;;;A00;;;;Tả;;", "2;;;;A;;;;Chương;;", "4;;;;A00.1;;;;muộn;;"]
    rx = ["|".join(["7", "ENG", *[""] * 9, "RXNORM", "IN", "", "aspirin", "", "N", ""]), "|".join(["7", "ENG", *[""] * 9, "RXNORM", "BN", "", "Bayer", "", "O", ""]), "|".join(["8", "SPA", *[""] * 9, "RXNORM", "IN", "", "x", "", "N", ""])]
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("a/icd.csv", "\n".join(icd))
        z.writestr("b/RXNCONSO.RRF", "\n".join(rx))
    (tmp_path / "t.zip").write_bytes(buffer.getvalue())
    c, a = readers.icd_tables(readers.read_zip_members(spark, str(tmp_path / "t.zip"), "icd.csv", ";"))
    assert {(r.concept_id, r.preferred_term) for r in c.collect()} == {("A00.1", "Bệnh tả"), ("A00", "Tả")} and a.count() == 4
    c, a = readers.rxnorm_tables(readers.read_zip_members(spark, str(tmp_path / "t.zip"), "RXNCONSO.RRF", "|"), ("IN", "BN"))
    assert [(r.concept_id, r.preferred_term, r.active) for r in c.collect()] == [("7", "Bayer", False)] and a.count() == 2


def test_sinks(spark, tmp_path):
    from spanloom.sources import sinks

    path = str(tmp_path / "a.json")
    assert len(sinks.write_json(path, {"b": 1, "a": "é"})) == 64 and open(path, encoding="utf-8").read() == '{"a":"é","b":1}'
    with pytest.raises(FileExistsError):
        sinks.write_json(path, {}, overwrite=False)
    for name in ("1.zip", "2.zip"):
        sinks.package({"b.json": b"[]", "a.json": b"[1]"}, str(tmp_path / name))
    assert (tmp_path / "1.zip").read_bytes() == (tmp_path / "2.zip").read_bytes()
    df = spark.createDataFrame([(1, "x", []), (2, "y", ["bad", "worse"]), (3, "x", [])], "id long, text string, reasons array<string>")
    assert {(r.reason, r.n) for r in sinks.write_split(df, str(tmp_path / "s")).collect()} == {("accepted", 2), ("bad", 1)}
    table = str(tmp_path / "t")
    assert [sinks.append_new(df, table), sinks.append_new(df, table)] == [2, 0]


def test_streaming(spark, sf_dir, tmp_path):
    from spanloom.streaming import ingest

    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("text", F.col("event_type"))
    src = str(tmp_path / "in")
    events.orderBy("ts").coalesce(1).write.parquet(src)
    stream = ingest.stream_parquet(spark, src, events.schema)
    ingest.write_once(ingest.dedup_stream(stream, late="60 days"), str(tmp_path / "d"), str(tmp_path / "dc")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "d")).count() == events.select("event_type").distinct().count()
    q = ingest.windowed_counts(stream, width="30 days").writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.sql("select sum(n) from counts").first()[0] == events.count()


def test_j11_tiles_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(similarity, "QUERY_BLOCK", 3)
    monkeypatch.setattr(similarity, "VECTOR_BLOCK", 20)
    v = np.random.default_rng(1).standard_normal((90, 5))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = similarity.dense_top_k(df.where("vec_id % 10 = 0").withColumnRenamed("vec_id", "query_id"), df, 4).collect()
    want = {(q, int(j), r) for q in range(0, 90, 10) for r, j in enumerate([j for j in np.argsort(-(v @ v[q]), kind="stable") if j != q][:4], 1)}
    assert {(r.query_id, r.vec_id, r["rank"]) for r in got} == want


def test_expected_jaccard_takes_all_candidates(spark):
    p = [round(0.9 - i / 400, 6) for i in range(200)]
    values = [sum(p[:k]) / (sum(p) + k - sum(p[:k])) for k in range(1, 201)]
    rows = spark.createDataFrame([("q", i, x) for i, x in enumerate(p)], "request_id string, concept_id long, p double")
    got = linking.expected_jaccard_set(rows).agg(F.count("*").alias("n"), F.max("expected_jaccard").alias("value")).first()
    assert (got.n, round(got.value, 9)) == (values.index(max(values)) + 1, round(max(values), 9)) and got.n > 50


def test_fusion_and_oracle_take_the_whole_pool(spark, sf_dir):
    from spanloom.plans import linking as plans

    sizes = {r.p_brand: r["count"] for r in spark.read.parquet(f"{sf_dir}/part.parquet").groupBy("p_brand").count().collect()}
    fused = plans.channel_fusion(spark, sf_dir).groupBy("request_id").agg(F.count("*").alias("n"), F.max("rank").alias("last")).collect()
    assert fused and all(r.n == r.last == sizes[r.request_id] for r in fused) and max(r.n for r in fused) > 10
    n = {r.request_id: r.n for r in plans.expected_jaccard_set(spark, sf_dir).collect()}
    got = plans.candidate_oracle(spark, sf_dir).collect()
    assert {r.request_id: (r.n_pool, r.n_chosen) for r in got} == {q: (sizes[q], n[q]) for q in sizes}


def test_privacy_warnings_count_five_patterns(spark, tmp_path):
    from spanloom.plans.curation import privacy_warnings

    text = "0912 345 678, 0912-345-678; 123456789 x a.b@c.vn 01/02/1990 Số nhà 5, đường Láng"
    spark.createDataFrame([("s", text), ("s", None), ("t", "none")], "source string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.source: tuple(r)[1:] for r in privacy_warnings(spark, str(tmp_path)).collect()}
    assert got == {"s": (2, 1, 1, 1, 2, 7), "t": (0, 0, 0, 0, 0, 0)}


def test_w09_j22_j23_spans_of_a_document_meet_in_one_shuffle(spark):
    rng = random.Random(8)
    rows = [(d, f"s{i}", s, s + rng.randrange(0, 9), rng.choice("ABC"), "t", rng.randrange(9) / 9) for d in range(8) for i, s in enumerate(rng.randrange(60) for _ in range(25))]
    df = spark.createDataFrame(rows, "doc_id long, id string, start long, end long, type string, text string, utility double")
    out = decode.resolve_consistency(df, {("A", "A"): "forbid", ("A", "B"): "allow", ("B", "B"): "forbid", ("A", "C"): "forbid", ("B", "C"): "allow", ("C", "C"): "allow"}, 0.1)
    shuffles = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange ")
    assert shuffles(out) == 1 and out.count() == len(rows)
    near = decode.near_tests(out, "C", "B", 10)
    want = {(d, i): sorted(x[1] for x in rows if x[0] == d and x[4] == "B" and abs(x[2] - s) <= 10) for d, i, s, _, t, *_ in rows if t == "C"}
    assert {(r.doc_id, r.result_id): r.test_ids for r in near.collect()} == {k: v for k, v in want.items() if v}
    kept = {(r.doc_id, r.id): r for r in out.where("kept").collect()}
    for r in decode.resolve_lab_pairs(out, near)[1].collect():
        c = kept[r.doc_id, r.result_id]
        assert r.test_id == min((max(t.start - c.end, c.start - t.end, 0), -t.start, t.id) for (d, i), t in kept.items() if d == r.doc_id and i in want[d, c.id])[2]
    blockers = decode.span_blockers(df, lambda a, b: a != b)
    assert shuffles(blockers) == 1
    for r in blockers.collect():
        (a,) = (x for x in rows if x[:2] == (r.doc_id, r.id))
        assert r.blockers == sorted(x[1] for x in rows if x[0] == a[0] and x[1] != a[1] and x[4] == a[4] and max(x[2], a[2]) < min(x[3], a[3]) and x[2] < x[3] and a[2] < a[3])


def test_j15_signatures_rule_out_pairs_before_any_shuffle(spark, monkeypatch):
    monkeypatch.setattr(similarity, "BLOCK_SETS", 20)
    rng = random.Random(3)
    sets = []
    for i in range(90):
        x = rng.sample(range(3000), rng.choice((30, 150, 200, 430, 450, 700)))
        sets.append((2 * i, [f"t{k}" for k in x]))
        if i % 3 == 0:  # a near copy, whose signature may have another width
            sets.append((2 * i + 1, [f"t{k}" for k in x[: int(len(x) * rng.choice((0.6, 0.7, 0.9)))] + rng.sample(range(3000, 3100), 5)]))
    members, pairs = similarity.jaccard_classes(spark.createDataFrame(sets, "id long, items array<string>"), 0.62)
    s = {i: set(x) for i, x in sets}
    want = {(a, b) for a in s for b in s if a < b and len(s[a] & s[b]) >= 0.62 * len(s[a] | s[b])}
    assert want and {(r.a, r.b) for r in pairs.collect()} == want and members.count() == len(sets)
    # The index lists a pair of its own accord only if it is worth a comparison; no self-join writes all others.
    plan = pairs._jdf.queryExecution().analyzed().toString()
    tables = [spark.read.parquet(f) for f in pairs.inputFiles() if "spanloom-" in f]
    listed = next(t for t in tables if "na" in t.columns)
    assert "Join" in plan and sum(t.count() for t in tables if "na" in t.columns) <= 3 * len(want) and {"a", "b", "na", "nb"} == set(listed.columns)


def test_k02_best_documents_equal_all_scores(spark):
    rng = random.Random(5)
    docs = spark.createDataFrame([(i, [f"w{int(rng.expovariate(0.1))}" for _ in range(rng.randrange(0, 30))] if i % 40 else None) for i in range(300)], "doc_id long, w array<string>")
    queries = spark.createDataFrame([(100 + i, [f"w{int(rng.expovariate(0.08))}" for _ in range(6)]) for i in range(9)] + [(7, ["none"])], "query_id long, tk array<string>")
    want = retrieval.top_k(retrieval.bm25(queries, docs, "doc_id", "w").withColumn("score", F.round("score", 6)), 5)
    found = retrieval.bm25_top(queries, docs, "doc_id", "w", 5)
    key = lambda df: sorted((r.query_id, r["rank"], r.id, r.score) for r in df.collect())
    assert key(found) == key(want) and len(key(want)) == 45
    # No join of documents with queries: only the names of the queries are joined.
    assert found._jdf.queryExecution().sparkPlan().toString().count("Join") == 1


def test_t05_t08_only_the_asked_units_are_looked_for(spark):
    docs = spark.createDataFrame([(1, "Medications\n- a b. c\n- d but e"), (2, "x. y")], "doc_id long, text string")
    every = infer.structure_units(docs).collect()
    for kinds in (("section",), ("list_item",), ("clause", "section")):
        assert sorted(infer.structure_units(docs, kinds).collect()) == sorted(r for r in every if r.kind in kinds)
    assert [r.view for r in infer.text_views(docs, ("collapsed",)).collect()] == ["collapsed"] * 2


def test_a40_a_text_meets_its_spans_once(spark):
    docs = spark.createDataFrame([(1, "one two"), (2, None), (3, "three")], "doc_id long, text string")
    found = spark.createDataFrame([(1, 0, 3, "A", "one"), (1, 0, 3, "A", "two"), (1, 4, 9, "B", "two"), (2, 0, 1, "A", "x"), (9, 0, 1, "A", "x"), (3, -1, 1, "B", "")], "doc_id long, start long, end long, type string, text string")
    out = spans.fidelity(found, docs)
    assert "Join" not in out._jdf.queryExecution().sparkPlan().toString()
    assert sorted((r.type, r.n, r.bad, r.n_distinct) for r in out.collect()) == [("A", 3, 1, 2), ("B", 2, 2, 2)]
