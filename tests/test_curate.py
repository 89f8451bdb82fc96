"""Curation, terminology, submission, linking variants, configuration."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from spanloom.operators import curate, linking
from spanloom.sources import config, sinks


def test_a35_a39_curate(spark):
    words = [f"w{i}" for i in range(30)]
    near, soft = " ".join(words[:28] + ["x", "y"]), " ".join(words[:24] + list("abcdef"))
    rows = [
        (1, " ".join(words), "basic", True, []), (2, " ".join(words).upper(), None, False, []), (3, near, "mixed_language", True, []), (4, "other text entirely", "mixed_language", False, []),
        (5, "bad", "basic", False, ["cjk"]), (6, soft, "hard", True, []), (7, soft + " a", "basic", False, []),
    ]
    shape = "id long, text string, profile string, asserted boolean, errors array<string>"
    decided = curate.curate(spark.createDataFrame(rows, shape))
    got = {r.id: (r.status, r.winner, r.score) for r in decided.collect()}
    assert got[5] == ("validation_failed", None, 100) and got[2] == ("exact_duplicate", 1, 100) and got[1] == ("hard_near_duplicate", 3, 105)
    # Gold is what has a modern profile, whatever its score; equal token sets are one component.
    assert {got[3][0], got[4][0]} == {"gold_train", "gold_validation"} and got[3][2] == 130 and got[4][2] == 125
    assert got[6][0] == "standard" and got[7][:2] == ("hard_near_duplicate", 6)
    # 1 and 3 lie softly near both 6 and 7.
    assert {r.id: r.soft_pairs for r in decided.where("id in (1, 3, 6, 7)").collect()} == dict.fromkeys((1, 3, 6, 7), 2)
    report = {r.name: r.n for r in curate.curation_report(decided).collect()}
    assert report == {"input": 7, "gold": 2, "gold_train": 1, "gold_validation": 1, "standard": 1, "rejected": 4, "rejected.validation_failed": 1, "rejected.exact_duplicate": 1, "rejected.hard_near_duplicate": 2}


def test_a38_published_share_of_gold(spark):
    # 30 gold samples at 0.15: 4.5, which rounds to 4.
    rows = [(i, " ".join(f"t{i}_{j}" for j in range(9)), "repeated_mention", False, []) for i in range(30)]
    got = curate.curate(spark.createDataFrame(rows, "id long, text string, profile string, asserted boolean, errors array<string>")).groupBy("status").count().collect()
    assert {r.status: r["count"] for r in got} == {"gold_train": 26, "gold_validation": 4}


def test_a13_fold_means(spark):
    runs = spark.createDataFrame([("a", 1, 0.5, 0.25), ("a", 2, 1.0, 0.25)], "fold_id string, seed int, encoder double, baseline double")
    assert tuple(curate.fold_seed_means(runs).first()) == (2, 0.75, 0.25, 0.5)
    with pytest.raises(Exception, match="each pair once"):
        curate.fold_seed_means(runs.union(runs)).collect()


def test_a14_a17_terminology(spark):
    c = spark.createDataFrame([("S", "1", "a", True), ("S", "2", "b", True), ("S", "2", "c", True), ("S", "3", "d", False)], "system string, concept_id string, preferred_term string, active boolean")
    a = spark.createDataFrame([("S", "1", "Đau", "x", 1), ("S", "1", "đau ", "x", 2), ("S", "1", "Đau", "x", 9), ("S", "2", "đau", "x", 3), ("S", "3", "z", "x", 4), ("S", "2", "q", "x", 5)], "system string, concept_id string, alias string, alias_type string, row long")
    out = curate.prepare_terminology(c, a)
    assert [r.concept_id for r in out["concepts"].collect()] == ["1"] and [r.concept_id for r in out["conflicts"].collect()] == ["2"]
    assert {(r.key, r.status, r.n_rows) for r in out["report"].collect()} == {("đau", "conflict", 4), ("q", "unique", 1)} and out["aliases"].count() == 4


def test_p03_p04_submission(spark):
    good = [{"text": "ab", "type": "T", "position": [0, 2], "assertions": [], "candidates": ["c1"]}]
    files = {"1": good, "2": [{**good[0], "extra": 1}], "3": [{**good[0], "position": [1, 3]}], "4": [{**good[0], "candidates": ["zz", "zz"]}], "9": []}
    docs = spark.createDataFrame([(str(i), "abc") for i in range(1, 6)], "document_id string, text string")
    got = curate.submission_errors(spark.createDataFrame([(k, json.dumps(v)) for k, v in files.items()], "document_id string, json string"), docs, spark.createDataFrame([("T", "c1")], "type string, code string"))
    assert sorted((r.document_id, r.error) for r in got.collect()) == [("2", "keys"), ("3", "span"), ("4", "repeated_code"), ("4", "unknown_code"), ("5", "missing_file"), ("9", "unknown_document")]


def test_a07_a09_a11_j17_j18(spark):
    out = spark.createDataFrame([("v", "q1", ["A", "B", "A"], ["B"]), ("v", "q2", ["Z"], []), ("v", "q3", [], [])], "variant string, trace_id string, ranked array<string>, final array<string>")
    gold = spark.createDataFrame([("q1", "T", "S", ["B"]), ("q2", "T", "S", ["Y"]), ("q3", "T", "R", [])], "trace_id string, entity_type string, terminology string, codes array<string>")
    r = linking.variant_metrics(out, gold).where("entity_type is null and terminology is null").first()
    assert (r.entities, r.coverage, r.recall_1, r.recall_5, r.mrr) == (3, 0.666667, 0.333333, 0.666667, 0.166667)
    assert (r.top1, r.jaccard, r.abstention_precision, r.abstention_coverage) == (0.0, 0.666667, 0.5, 0.666667)
    ranked = spark.createDataFrame([("q1", "A", 1), ("q1", "B", 2), ("q2", "Z", 1)], "query_id string, concept_id string, rank int")
    g = spark.createDataFrame([("q1", "B"), ("q2", "Y")], "query_id string, concept_id string")
    assert {(x.query_id, x.hits, tuple(x.missed)) for x in linking.recall_with_misses(ranked, g, 5).collect()} == {("q1", 1, ()), ("q2", 0, ("Y",))}
    shape = "terminology string, concept_id string, parent_id string, ingredients array<string>, strengths array<string>, forms array<string>"
    catalog = spark.createDataFrame(
        [("ICD-10", "A", "P", [], [], []), ("ICD-10", "B", "P", [], [], []), ("ICD-10", "P", None, [], [], []), ("ICD-10", "A1", "A", [], [], []), ("ICD-10", "Q", None, [], [], []), ("OTHER", "B", "P", [], [], []),
         ("RXNORM", "1", None, ["x"], ["5"], ["t"]), ("RXNORM", "2", None, ["x"], ["10"], ["t"]), ("RXNORM", "3", None, ["x"], ["5"], ["t"]), ("RXNORM", "4", None, ["y"], ["5"], ["t"]), ("RXNORM", "5", None, ["x", "y"], ["5"], ["t"])], shape
    )
    negatives = linking.hard_negatives(catalog, spark.createDataFrame([("ICD-10", "A"), ("RXNORM", "1")], "terminology string, concept_id string"))
    assert sorted(map(tuple, negatives.collect())) == [("ICD-10", "A1"), ("ICD-10", "B"), ("ICD-10", "P"), ("RXNORM", "2"), ("RXNORM", "5")]
    ont = spark.createDataFrame([("S", "A", ["P"])], "terminology string, concept_id string, parents array<string>")
    with pytest.raises(Exception, match="not in the snapshot"):
        linking.snapshot_lookup(spark.createDataFrame([("S", "X")], "terminology string, concept_id string"), ont).collect()
    cases = spark.createDataFrame([("off", 1, 0.5, 1.0), ("off", 2, 0.5, 1.0), ("gated_on", 1, 0.7, 2.0), ("gated_on", 2, 0.5, 2.0), ("always_on", 1, 0.9, 2.0), ("always_on", 2, 0.4, 2.0)], "mode string, case_id int, score double, latency_ms double")
    assert {(x["mode"], x.enable) for x in linking.ablation(cases, 0.05).collect()} == {("gated_on", True), ("always_on", False)}
    assert {(x["mode"], x.net, x.enable) for x in linking.ablation(cases, 0.05, 0.2).collect()} == {("gated_on", -0.1, False), ("always_on", -0.05, False)}


def test_a08_errors_may_be_several(spark):
    gold = spark.createDataFrame([("a", ["1", "2"], "leaf", False), ("b", ["3"], None, True), ("c", [], "leaf", True)], "trace_id string, codes array<string>, granularity string, alias_present boolean")
    fused = spark.createDataFrame([("a", ["1"]), ("b", ["3"]), ("c", [])], "trace_id string, ranked array<string>")
    item = "array<struct<code:string,granularity:string,obsolete:boolean>>"
    again = spark.createDataFrame([("a", [("1", "branch", True)], ["1"], ["2"]), ("b", [("3", "branch", True)], [], []), ("c", [], [], [])], f"trace_id string, ranked {item}, final array<string>, rejected array<string>")
    got = {(r.bucket, r.trace_id) for r in linking.linking_errors(gold, fused, again).collect()}
    assert got == {("alias_missing", "a"), ("retrieval_miss", "a"), ("wrong_granularity", "a"), ("structured_mismatch", "a"), ("obsolete_concept", "a"), ("ambiguous_gold", "a"), ("rerank_miss", "b")}
    counts = {r.bucket: r.n for r in linking.linking_error_counts(linking.linking_errors(gold, fused, again)).collect()}
    assert list(counts.values()).count(1) == 7


def test_j12_w13_rerank(spark):
    raw = spark.createDataFrame([(1, "a", 0.9), (1, "b", 0.5), (1, "c", 0.7)], "request_id int, concept_id string, raw double")
    scores = spark.createDataFrame([(1, "b", 0.8), (1, "a", 0.8)], "request_id int, concept_id string, score double")
    assert [r.concept_id for r in linking.rerank_join(raw, scores).orderBy("rank").collect()] == ["a", "b", "c"]
    with pytest.raises(Exception, match="unknown request: 2"):
        linking.rerank_join(raw, spark.createDataFrame([(2, "a", 1.0)], scores.schema)).collect()


def test_a37_quality(spark):
    score = lambda p, a: spark.range(1).select(curate.quality_score(F.lit(p).cast("string"), F.lit(a))).first()[0]
    assert [score("mixed_language", True), score("mixed_language", False), score("hard", True), score("basic", True), score(None, False)] == [130, 125, 110, 105, 100]


def test_s19_s21_x01_p22(tmp_path):
    p = tmp_path / "c.json"
    p.write_text('{"dense": true, "reranker": true}')
    assert config.load_config(str(p)).reranker
    for bad in ('{"reranker": true}', '{"api_key": "x"}', '{"other": 1}', '{"offline": false}'):
        p.write_text(bad)
        with pytest.raises(ValueError):
            config.load_config(str(p))
    digest = sinks.write_json(str(tmp_path / "1.json"), [])
    size = (tmp_path / "1.json").stat().st_size
    item = {"path": str(tmp_path / "1.json"), "bytes": size, "sha256": digest}
    got = config.verify_artifacts([item, item | {"bytes": 1}, item | {"sha256": "0"}, item | {"path": "no"}, item | {"parameters": 10**10}])
    assert [g["status"] for g in got] == ["ok", "size", "digest", "missing", "parameters"]
    assert config.to_do(["1", "2"], str(tmp_path), {"1": digest}) == ["2"] and config.to_do(["1"], str(tmp_path), {}, "never") == ["1"]
    with pytest.raises(FileExistsError):
        config.to_do(["1"], str(tmp_path), {}, "fail_if_exists")
    assert config.manifest_complete({"status": "finalized", "completed": 1, "failed": 1, "resumed": 0, "n": 2})


def test_a07_a08_tables_of_entities_are_never_broadcast(spark):
    gold = spark.createDataFrame([(1, "drug", "RX", ["a"], None, True)], "trace_id long, entity_type string, terminology string, codes array<string>, granularity string, alias_present boolean")
    out = spark.createDataFrame([("v", 1, ["a"], ["a"])], "variant string, trace_id long, ranked array<string>, final array<string>")
    again = out.select("trace_id", F.transform("ranked", lambda x: F.struct(x.alias("code"), F.lit("leaf").alias("granularity"), F.lit(False).alias("obsolete"))).alias("ranked"), "final", F.col("final").alias("rejected"))
    for df in (linking.variant_metrics(out, gold), linking.linking_errors(gold, out, again)):
        plan = df._jdf.queryExecution().sparkPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
