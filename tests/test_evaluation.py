"""Scores, reports, assertion decisions, split evaluation, calibration."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from spanloom.operators import assertion, calibrate, evaluate, quality

ENTITY = "doc_id long, i int, start long, end long, type string, text string, assertions array<string>, candidates array<string>"
HO = ("TRIỆU_CHỨNG", "ho")


def side(spark, rows):
    """(doc, start, end, type, text, assertions, candidates) in order."""
    return spark.createDataFrame([(d, i, *r) for i, (d, *r) in enumerate(rows)], ENTITY)


def test_a01_cases_of_the_scorer(spark):
    # The published cases: perfect, extra, missing, wrong type, shifted span, repeated mentions in another order.
    gold = [(1, 3, 5, *HO, ["isNegated"], []), (3, 0, 2, *HO, None, None), (4, 0, 2, *HO, None, None), (5, 3, 5, *HO, None, None), (6, 0, 2, *HO, None, None), (6, 8, 10, *HO, None, None)]
    pred = [(1, 3, 5, *HO, ["isNegated"], []), (2, 0, 2, *HO, None, None), (4, 0, 2, "CHẨN_ĐOÁN", "ho", None, None), (5, 4, 6, *HO, None, None), (6, 8, 10, *HO, None, None), (6, 0, 2, *HO, None, None)]
    got = {r.doc_id: r for r in evaluate.score_samples(side(spark, gold), side(spark, pred)).collect()}
    assert {i: r.f1 for i, r in got.items()} == {1: 1.0, 2: 0.0, 3: 0.0, 4: 0.0, 5: 0.0, 6: 1.0}
    assert got[1].final_score == pytest.approx(1.0) and got[6].final_score == pytest.approx(1.0)
    # Nothing predicted: precision 1, recall 0; nothing expected: the other way round.
    assert (got[3].precision, got[3].recall) == (1.0, 0.0) and (got[2].precision, got[2].recall) == (0.0, 1.0)


def test_a01_a02_jaccard_of_pairs_and_leftovers(spark):
    gold = side(spark, [(1, 0, 2, "T", "ab", ["n", "h"], ["1"]), (1, 3, 5, "T", "cd", ["n"], None), (1, 9, 10, "T", "x", None, None)])
    pred = side(spark, [(1, 0, 2, "T", "ab", ["n"], ["1", "2"]), (1, 9, 10, "T", "x", None, ["3"])])
    r = evaluate.score_samples(gold, pred, (2.0, 1.0, 1.0)).first()
    assert (r.matched, r.unmatched_gold, r.unmatched_pred) == (2, 1, 0)
    assert r.assertion_jaccard == pytest.approx((0.5 + 0 + 1) / 3) and r.candidate_jaccard == pytest.approx((0.5 + 1 + 0) / 3)
    assert r.final_score == pytest.approx((2 * 0.8 + r.assertion_jaccard + r.candidate_jaccard) / 4)
    # Where missing is not empty, a missing set agrees with a missing one only.
    strict = evaluate.score_samples(gold, pred, none_is_empty=False).first()
    assert strict.candidate_jaccard == pytest.approx((0.5 + 0 + 0) / 3)
    with pytest.raises(ValueError):
        evaluate.score_samples(gold, pred, (0.0, 0.0, 0.0))


def test_j01_pairs_in_order(spark):
    gold = side(spark, [(1, 0, 2, "T", "ab", ["n"], None), (1, 0, 2, "T", "ab", ["h"], None)])
    pred = side(spark, [(1, 0, 2, "T", "ab", ["h"], None), (1, 0, 2, "T", "ab", ["h"], None), (1, 0, 2, "T", "ab", [], None)])
    rows = evaluate.paired(gold, pred, evaluate.SCORED).collect()
    assert sorted(((r.g and r.g.assertions) or ["-"], (r.p and r.p.assertions) or ["-"]) for r in rows) == [(["-"], ["-"]), (["h"], ["h"]), (["n"], ["h"])]


def test_a05_a06_labels_scopes_and_codes(spark):
    gold = side(spark, [(1, 0, 5, "T", "abcde", ["n", "h"], ["1"]), (1, 10, 15, "T", "fghij", ["n"], ["2"]), (1, 20, 22, "T", "kl", [], None)])
    pred = side(spark, [(1, 0, 5, "T", "abcde", ["n", "f"], ["1"]), (1, 11, 15, "T", "ghij", ["n"], ["9"]), (1, 20, 22, "T", "kl", None, None)]).withColumn("ranking", F.array(F.lit("7"), F.lit("1")))
    labels = {r.label: (r.tp, r.fp, r.fn, r.precision, r.recall) for r in evaluate.assertion_metrics(gold, pred).collect()}
    assert labels == {"n": (1, 0, 0, 1.0, 1.0), "h": (0, 0, 1, 1.0, 0.0), "f": (0, 1, 0, 0.0, 1.0)}
    assert [(r.start, r.end) for r in evaluate.scope_errors(gold, pred).collect()] == [(10, 15)]
    r = evaluate.linking_report(gold, pred).first()
    assert (r.n, r.recall_1, r.recall_2, r.mrr, r.oracle, r.jaccard) == (1, 0.0, 1.0, 0.5, 1.0, 1.0)


def test_a04_any_overlap_of_another_type_is_a_type_error(spark):
    gold = side(spark, [(1, 0, 5, "A", "abcde", None, None), (1, 10, 15, "A", "x", None, None), (1, 20, 25, "A", "x", None, None)])
    pred = side(spark, [(1, 2, 7, "B", "x", None, None), (1, 12, 16, "A", "x", None, None), (1, 40, 41, "A", "x", None, None)])
    got = {(r.start, r.error) for r in evaluate.error_classes(gold, pred).collect()}
    assert got == {(0, "type"), (10, "boundary"), (20, "missing"), (2, "partial"), (12, "partial"), (40, "spurious")}


def test_a03_a10_reports(spark):
    gold, none = side(spark, [(1, 0, 5, "A", "abcde", [], None)]), side(spark, [(9, 0, 1, "A", "x", None, None)]).limit(0)
    runs = spark.createDataFrame([(1, None, 10.0), (2, "timeout", None)], "doc_id long, failure_reason string, latency_ms double")
    as_pred = lambda df: df.withColumn("ranking", F.array().cast("array<string>"))
    report = lambda p: {(r.section, r.name): r.value for r in evaluate.evaluation_report(gold, as_pred(p), runs).collect()}
    good, bad = report(gold), report(none)
    assert good["score", "final_score"] == 1.0 and good["score", "samples"] == 2 and good["failure", "timeout"] == 1 and good["system", "max_latency_ms"] == 10.0
    # One sample of two has nothing in it and scores 1; the other has F1 0 and Jaccard indices of empty sets.
    assert bad["score", "final_score"] == pytest.approx((1 + 2 / 3) / 2, abs=1e-6) and bad["type", "A.precision"] == 1.0 and bad["error", "missing"] == 1
    delta = evaluate.bucket_deltas(evaluate.evaluation_report(gold, as_pred(gold), runs), evaluate.evaluation_report(gold, as_pred(none), runs))
    assert {(r.name, r.delta) for r in delta.collect()} == {("missing", 1), ("scope", 0), ("timeout", 0)}
    assert report(as_pred(gold).withColumn("doc_id", F.lit(77).cast("long")).drop("ranking"))["score", "unknown_samples"] == 1


def test_w04_assertions_are_capped_and_masked(spark):
    mentions = spark.createDataFrame([(1, "TRIỆU_CHỨNG"), (2, "TÊN_XÉT_NGHIỆM"), (3, "THUỐC")], "id int, type string")
    decisions = spark.createDataFrame([(1, "isNegated", 0.96, True), (1, "isNegated", 0.7, True), (1, "isFamily", 0.8, False), (2, "isNegated", 0.8, True)], "id int, label string, score double, applies boolean")
    got = {r.id: (r.probabilities, r.masked) for r in assertion.apply_decisions(mentions, decisions).collect()}
    zero = dict.fromkeys(assertion.LABELS, 0.0)
    assert got == {1: (zero | {"isNegated": 0.9}, False), 2: (zero, True), 3: (zero, False)}


def test_w14_p18_decisions(spark):
    shape = "id int, type string, logits map<string,double>, rules map<string,double>"
    rows = [(1, "A", {"isNegated": 4.0}, {}), (2, "A", {"isNegated": 4.0}, {"isNegated": 0.3}), (3, "B", {"isNegated": 9.0}, {}), (4, "A", {}, {}), (5, "A", {"isFamily": 2.5}, {})]
    d = assertion.decide(spark.createDataFrame(rows, shape), masks={"B": ("isNegated",)})
    got = {r.id: ({x.label: x.reason for x in r.decisions}, r.assertions, r.abstained) for r in d.collect()}
    assert got[1][1:] == (["isNegated"], False) and got[1][0]["isFamily"] == "below_threshold"
    assert got[2][0]["isNegated"] == "below_threshold" and got[3][0]["isNegated"] == "hard_mask:type" and got[3][1:] == ([], False)
    assert set(got[4][0].values()) == {"abstain:insufficient_evidence"} and got[4][2] and got[5][0]["isFamily"] == "below_threshold"
    p = {x.label: x.probability for x in d.where("id = 2").first().decisions}
    assert p["isNegated"] == pytest.approx(1 / (1 + math.exp(-(0.5 * math.log(0.3 / 0.7) + 2)))) and p["isFamily"] == 0.5
    risk = assertion.empty_gold_risk(spark.createDataFrame([([], ["x"]), ([], []), (["y"], ["x"]), (None, None)], "gold array<string>, predicted array<string>")).first()
    assert tuple(risk) == (3, 1, 0.333333)


def test_a40_a44_splits(spark):
    e = lambda t, k, s, n, a=(): (t, k, s, n, list(a))
    kinds = quality.TYPES
    rows = [
        ("synthetic_clean", "ho ho BN 0912345678", [e("ho", kinds[0], 0, 2, ["isNegated"]), e("ho", kinds[0], 0, 2), e("BN", kinds[1], 6, 8)]),
        ("synthetic_clean", "sot", [e("sot", kinds[2], 0, 3), e("xx", kinds[3], 1, 3)]), ("synthetic_hard", "a a a a", None), ("synthetic_hard", None, []),
    ]
    samples = spark.createDataFrame(rows, "split string, text string, entities array<struct<text:string,type:string,start:int,end:int,assertions:array<string>>>")
    got = {r.split: r for r in quality.evaluate_splits(samples).collect()}
    c, h, u = (got[s] for s in quality.SPLITS)
    assert (c.total_samples, c.total_entities, c.bad_position_count, c.duplicate_span_count, c.empty_entity_samples) == (2, 5, 1, 1, 0)
    assert c.bad_position_rate == 0.2 and c.abbreviation_rate == pytest.approx(1 / 5) and c.lexical_diversity == pytest.approx(4 / 5) and c.missing_types == [kinds[4]]
    assert not c.passed and c.utility == pytest.approx(1 - 0.2 - 0 - 0.5) and c.privacy_warning_count == 1
    assert (h.empty_entity_samples, h.avg_entities, h.passed) == (2, 0.0, False) and h.repetition_rate == pytest.approx(3 / 5) and h.utility == pytest.approx(0.5 - 0.4)
    assert h.warnings[:2] == ["no entities in the hard split", "low utility of the hard split"]
    assert (u.total_samples, u.utility, u.passed) == (0, 0.5, True) and u.warnings[0] == "no reviewed split" and len(u.missing_types) == 5
    r = quality.recommendation(quality.evaluate_splits(samples)).first()
    assert (r.blocking, r.warnings, r.ready) == (["clean_bad_positions", "hard_without_entities"], ["reviewed_missing"], False) and r.entity_drop == 2.5 and r.assertion_shift == pytest.approx(-0.2)


def test_k06_percentiles_by_index(spark):
    rows = [("a", float(i % 7)) for i in range(100)] + [("b", 5.0)]
    got = {r.g: (r.low, r.high) for r in calibrate.percentiles(spark.createDataFrame(rows, "g string, v double"), "v", {"low": 0.05, "high": 0.95}, ["g"]).collect()}
    ordered = sorted(v for g, v in rows if g == "a")
    assert got == {"a": (ordered[int(0.05 * 99)], ordered[int(0.95 * 99)]), "b": (5.0, 5.0)}


def test_a27_applies_every_method(spark):
    models = spark.createDataFrame([("s", "t", 2.0, 1.0, None, None, None), ("s", "u", None, None, [0.0, 1.0], [0.1, 0.8], None), ("s", "v", None, None, None, None, 2.0)], "source string, entity_type string, a double, b double, x array<double>, y array<double>, temperature double")
    rows = spark.createDataFrame([("s", "t", 0.5), ("s", "u", 0.5), ("s", "v", 1.0)], "source string, entity_type string, logit double")
    got = {r.entity_type: r.p for r in calibrate.apply(rows, models).collect()}
    sig = lambda z: 1 / (1 + math.exp(-z))
    assert got == {"t": pytest.approx(sig(2.0)), "u": 0.8, "v": pytest.approx(sig(0.5))}
    with pytest.raises(Exception, match="no calibration for s w"):
        calibrate.apply(spark.createDataFrame([("s", "w", 0.0)], rows.schema), models).collect()


def test_entities_of_a_sample_meet_in_one_shuffle(spark):
    rows = [(d, i, 5 * i, 5 * i + n, t, "x" * n, ["isNegated"][: i % 2], ["c1"][: d % 2], ["c1"]) for d in range(6) for i, (n, t) in enumerate([(3, "A"), (4, "B"), (7, "A")])]
    df = spark.createDataFrame(rows, "doc_id long, i int, start long, end long, type string, text string, assertions array<string>, candidates array<string>, ranking array<string>")
    moved = df.where("i <> 1").withColumn("end", F.when(F.col("i") == 2, F.col("end") - 1).otherwise(F.col("end")))
    shuffles = lambda out: out._jdf.queryExecution().executedPlan().toString().count("Exchange ")
    assert shuffles(evaluate.score_samples(df.drop("ranking"), moved.drop("ranking"))) == 1
    # The sums of a sample equal those of the joins.
    runs = spark.range(6).select(F.col("id").alias("doc_id"), F.lit(None).cast("string").alias("failure_reason"), F.lit(1.0).alias("latency_ms"))
    got = {(r.section, r["name"]): r.value for r in evaluate.evaluation_report(df, moved, runs).collect()}
    for r in evaluate.error_classes(df, moved).where("error <> 'partial'").groupBy("error").count().collect():
        assert got["error", r.error] == r["count"]
    for r in evaluate.assertion_metrics(df, moved).collect():
        assert [got["assertion", f"{r.label}.{c}"] for c in ("tp", "fp", "fn", "f1")] == [r.tp, r.fp, r.fn, r.f1]
    assert got["error", "scope"] == evaluate.scope_errors(df, moved).count() and got["linking", "jaccard"] == evaluate.linking_report(df, moved).first().jaccard
