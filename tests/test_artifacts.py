"""Artifacts, sample checks, isolated kernels, retrieval with eligibility, scalar keys."""

from __future__ import annotations

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from spanloom.functions import kernels as K
from spanloom.functions import text as T
from spanloom.operators import curate, decode, infer, retrieval, validate
from spanloom.sources import artifacts, sinks


def test_s11_alias_yaml(spark, tmp_path):
    (tmp_path / "a.yaml").write_text("aliases:\n- {system: S, concept_id: 1, alias: đau}\n- {system: S, concept_id: 2, alias: sốt, alias_type: x}\n")
    (tmp_path / "b.yml").write_text("- {system: S, concept_id: 3, alias: ho}\n")
    (tmp_path / "c.yaml").write_text("")
    (tmp_path / "d.txt").write_text("not read")
    got = artifacts.read_alias_yaml(spark, [(str(tmp_path / n), "name", "v1") for n in ("a.yaml", "b.yml", "c.yaml", "d.txt")]).collect()
    assert [(r.concept_id, r.alias, r.alias_type, r.row) for r in got] == [("1", "đau", "name", 1), ("2", "sốt", "x", 2), ("3", "ho", "name", 1)]
    (tmp_path / "a.yaml").write_text("3")
    with pytest.raises(ValueError):
        artifacts.read_alias_yaml(spark, [(str(tmp_path / "a.yaml"), "name", "v1")])


def test_s12_s13_k04_tables(spark, tmp_path):
    c = spark.createDataFrame([("S", str(i), f"t{i}", True) for i in range(9)], "system string, concept_id string, preferred_term string, active boolean")
    a = spark.createDataFrame([("S", str(i % 9), f"Alias {i}", "x", i) for i in range(30)], "system string, concept_id string, alias string, alias_type string, row long")
    tables = curate.prepare_terminology(c, a)
    one = artifacts.write_canonical(tables, f"file://{tmp_path}/t")
    assert one == artifacts.write_canonical({n: t.repartition(3) for n, t in tables.items()}, f"file://{tmp_path}/u")
    assert one["tables"]["aliases"]["rows"] == 30 and json.loads((tmp_path / "t/manifest.json").read_text()) == one
    rows = [(r.concept_id, r.key) for r in artifacts.ordered(tables)["aliases"].collect()]
    assert rows == sorted(rows)
    al = a.select(F.col("concept_id").alias("id"), "alias")
    m = artifacts.index_metadata(c, al, 1.2, 0.75, (3, 4, 5), {"medication": ("S",)})
    assert m["indexes"]["exact_alias_keys"] == 30 and m["indexes"]["documents"] == 9 and m["aliases"] == 30 and m["indexes"]["ngram_keys"] > 30
    assert m == artifacts.index_metadata(c, al.repartition(4), 1.2, 0.75, (3, 4, 5), {"medication": ("S",)})
    digest = artifacts.write_index_metadata(spark, m, f"file://{tmp_path}/index.json")
    assert digest == hashlib.sha256((tmp_path / "index.json").read_bytes()).hexdigest()


def test_s17_a28_calibration_artifact(spark, tmp_path):
    models = spark.createDataFrame([("s", "t", 1.0, 0.5)], "source string, entity_type string, a double, b double")
    path = f"file://{tmp_path}/c.json"
    whole = artifacts.write_calibration(models, ["g2", "g1"], "v1", path)
    assert artifacts.read_calibration(spark, path) == whole and whole["fit_group_ids"] == ["g1", "g2"]
    with pytest.raises(FileExistsError):
        artifacts.write_calibration(models, ["g1"], "v1", path)
    points = spark.createDataFrame([("g3", 1.0)], "group_id string, logit double")
    assert artifacts.refuse_fitted(points, whole).count() == 1
    with pytest.raises(Exception, match="fitted on this group: g1"):
        artifacts.refuse_fitted(spark.createDataFrame([("g1", 1.0)], points.schema), whole).collect()
    artifacts.put_json(spark, path, whole | {"version": "v2"})
    with pytest.raises(ValueError, match="checksum"):
        artifacts.read_calibration(spark, path)
    with pytest.raises(ValueError):
        artifacts.write_calibration(models, [], "v1", f"file://{tmp_path}/d.json")


def test_s22_p19_traces(spark, tmp_path):
    e = spark.createDataFrame([(1, 5, 7, "B", ["n"], None), (1, 0, 2, "A", [], ["c"])], "doc_id long, start int, end int, type string, assertions array<string>, candidates array<string>")
    t = artifacts.sample_traces(e, spark.createDataFrame([(1, 3.5, "ab"), (2, 1.0, None)], "doc_id long, elapsed_ms double, output_sha256 string"))
    artifacts.write_traces(t, f"file://{tmp_path}/traces", "r1")
    artifacts.write_traces(t, f"file://{tmp_path}/traces", "r2")
    got = {r.sample: r for r in spark.read.json(f"file://{tmp_path}/traces").where("run_id = 'r1'").collect()}
    assert got[1].status == "completed" and [(d.start, d.type, d.assertions, d.candidates) for d in got[1].decisions] == [(0, "A", 0, 1), (5, "B", 1, 0)]
    assert got[2].status == "failed" and got[2].entities == 0
    with pytest.raises(ValueError, match="raw text"):
        validate.safe_metadata(t.withColumn("x", F.array(F.struct(F.lit("secret").alias("raw_text")))))


def test_s06_gold_is_written_whole_or_not_at_all(spark, tmp_path):
    entity = "struct<text:string,type:string,start:int,end:int,assertions:array<string>,candidates:array<string>>"
    shape = f"sample_id string, text string, entities array<{entity}>, confirmed boolean"
    rows = [(f"s{i}", "sốt", [("sốt", "TRIỆU_CHỨNG", 0, 3, [], None)], True) for i in (2, 1, 3)]
    path = tmp_path / "gold"
    assert artifacts.write_gold(spark.createDataFrame(rows, shape), f"file://{path}") == 3
    lines = [json.loads(x) for p in sorted(path.glob("part-*")) for x in p.read_text().splitlines()]
    assert [x["sample_id"] for x in lines] == ["s1", "s2", "s3"] and list(lines[0]) == sorted(lines[0])
    with pytest.raises(ValueError, match="s9"):
        artifacts.write_gold(spark.createDataFrame([*rows, ("s9", "sốt", [("ho", "X", 0, 2, [], None)], True)], shape), f"file://{path}")
    assert len([x for p in path.glob("part-*") for x in p.read_text().splitlines()]) == 3


def test_s23_s24_sinks_write_once(spark, tmp_path):
    df = spark.createDataFrame([("a", []), ("b", ["bad"]), ("b", ["bad"])], "text string, reasons array<string>")
    assert {(r.reason, r.n) for r in sinks.write_split(df, str(tmp_path / "s")).collect()} == {("accepted", 1), ("bad", 2)}
    assert spark.read.parquet(str(tmp_path / "s/status=accepted")).count() == 1
    assert [sinks.append_new(df, str(tmp_path / "t")), sinks.append_new(df, str(tmp_path / "t"))] == [2, 0]


ENTITY = "struct<text:string,type:string,start:int,end:int,assertions:array<string>,candidates:array<string>>"


def test_p06_p07_p08_local_validation(spark):
    dx = lambda codes: ("E11", "CHẨN_ĐOÁN", 7, 10, ["isFamily"], codes)
    text = "no ho; E11 ho follow-up 中"
    rows = [
        (1, "no ho", [("ho", "TRIỆU_CHỨNG", 3, 5, ["isNegated"], None)], "basic"), (2, text, [dx(["E11.9"]), ("ho", "X", 0, 2, ["odd"], None)], "basic"), (3, text.replace("中", ""), [dx(["I10"])], "mixed_language"),
        (4, "ho, ho", [("ho", "TRIỆU_CHỨNG", 0, 2, [], None)], "repeated_mention"), (5, "ho, ho", [("ho", "TRIỆU_CHỨNG", 0, 2, [], None), ("ho", "TRIỆU_CHỨNG", 4, 6, [], None)], "repeated_mention"),
        (6, "CT scan", [("CT", "TÊN_XÉT_NGHIỆM", 0, 2, [], None)], "abbreviation_or_typo"), (7, "CT mri", [("CT", "TÊN_XÉT_NGHIỆM", 0, 2, [], None)], "abbreviation_or_typo"), (8, None, None, None),
    ]
    got = {r.id: (r.valid, r.errors, r.warnings) for r in validate.local_validation(spark.createDataFrame(rows, f"id int, text string, entities array<{ENTITY}>, profile string"), {"isNegated": ("No ",), "isFamily": ("mother",)}, ("E11.0",)).collect()}
    assert got[1] == (True, [], []) and got[8] == (True, [], [])
    assert got[2] == (False, ["contains_cjk_noise", "invalid_entity_type", "invalid_assertion", "bad_exact_span"], ["missing_isFamily_cue"])
    assert got[3] == (False, ["invalid_family_semantics"], ["missing_isFamily_cue"])
    assert got[4][1] == ["missing_repeated_mention"] and got[5][0] and got[6][1] == ["missing_medical_abbreviation"] and got[7][0]


def test_p20_completions(spark):
    ok = {"text": "ho", "provisional_type": "TRIỆU_CHỨNG"}
    cases = {
        "[]": None, json.dumps([ok, ok | {"evidence_label": "a.b"}]): None, "{}": "completion_must_be_list", "nonsense": "completion_must_be_list", json.dumps([ok | {"x": 1}]): "invalid_completion_object", json.dumps(["ho"]): "invalid_completion_object",
        json.dumps([{"text": "ho"}]): "missing_required_fields", json.dumps([ok | {"text": "sốt"}]): "non_exact_mention", json.dumps([ok | {"text": ""}]): "non_exact_mention", json.dumps([ok | {"provisional_type": "X"}]): "unsupported_provisional_type",
        json.dumps([ok | {"evidence_label": "A b"}]): "invalid_evidence_label", json.dumps([ok, ok]): "duplicate_proposal_object",
    }
    got = {r.completion: (r.error, r["items"]) for r in validate.completion_items(spark.createDataFrame([(c, "ho nhiều") for c in cases], "completion string, text string")).collect()}
    assert {c: e for c, (e, _) in got.items()} == cases
    assert all((e is None) == (i is not None) for e, i in got.values()) and len(got[json.dumps([ok, ok | {"evidence_label": "a.b"}])][1]) == 2


def test_j13_j14_j19_joins(spark):
    side = lambda *ids: spark.createDataFrame([(i, i.upper()) for i in ids], "sample_id string, x string")
    assert [(r.g.x, r.p.x) for r in validate.matched_samples(side("a"), side("a")).collect()] == [("A", "A")]
    for g, p in ((side("a"), side("b")), (side("a", "a"), side("a")), (side("a", "b"), side("a"))):
        with pytest.raises(Exception, match="one to one"):
            validate.matched_samples(g, p).collect()
    split = spark.createDataFrame([("1", "g", "train", "x"), ("2", "h", "test", "y")], "record_id string, group_id string, split string, text string")
    notes = lambda text: spark.createDataFrame([("1", text, ["e"])], "record_id string, text string, entities array<string>")
    assert [r.record_id for r in validate.training_rows(split, notes("x")).collect()] == ["1"]
    with pytest.raises(Exception, match="another text: 1"):
        validate.training_rows(split, notes("z")).collect()
    with pytest.raises(Exception, match="no annotation: 1"):
        validate.training_rows(split, notes("x").limit(0)).collect()
    with pytest.raises(Exception, match="group in two splits: 1"):
        validate.training_rows(split.withColumn("group_id", F.lit("g")), notes("x")).collect()
    e = spark.createDataFrame([(1, "A", 0, 0), (1, "B", 5, 1), (1, "A", 9, 2), (1, "B", 12, 3), (1, "A", 20, 4)], "doc_id long, type string, start int, i int")
    got = validate.cross_type_pairs(e, (("A", "B"),)).collect()
    assert sorted((r.source_start, r.negative_start) for r in got) == [(0, 5), (9, 12)]


def test_x02_x03_g03_isolation(spark):
    import time

    docs = spark.createDataFrame([(1, "ok"), (2, "raise"), (3, "slow"), (4, None)], "doc_id long, text string")

    def kernel(_, text):
        if text == "raise":
            raise KeyError("the text itself")
        if text == "slow":
            time.sleep(0.2)
        return {"n": len(text)}

    got = {r.doc_id: (r.result, r.error) for r in infer.isolated(docs, kernel, limit_ms=100).collect()}
    assert got == {1: ('{"n":2}', None), 2: (None, "KeyError"), 3: (None, "timeout"), 4: ('{"n":0}', None)}


def test_u01_j07_proposals(spark):
    p = lambda *spans: spark.createDataFrame([(1, *s) for s in spans], "doc_id long, start int, end int")
    both = infer.united(p((0, 4), (20, 22)), p((0, 4)))
    assert sorted((r.start, r.proposer) for r in both.collect()) == [(0, 0), (0, 1), (20, 0)]
    units = infer.structure_units(spark.createDataFrame([(1, "Chẩn đoán:\nviêm phổi, chẩn")], "doc_id long, text string"))
    assert [(r.start, r.end) for r in infer.without_headings(p((0, 4), (11, 21), (9, 12)), units).collect()] == [(11, 21)]


def test_long_texts_make_small_slices():
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(["x", "y" * (1 << 20), None, "z", "z" * (1 << 19), "w" * (1 << 20)])], names=["i", "t"])
    assert [s.num_rows for s in infer.slices(batch)] == [1, 2, 2, 1] or sum(s.num_rows for s in infer.slices(batch)) == 6
    assert [s.num_rows for s in infer.slices(pa.RecordBatch.from_arrays([pa.array(range(300)), pa.array(["a"] * 300)], names=["i", "t"]))] == [128, 128, 44]


def test_j22_j23_lab_pairs(spark):
    s = spark.createDataFrame([(1, "t1", 0, 2, "TÊN", "x", 0.9), (1, "t2", 8, 10, "TÊN", "y", 0.0), (1, "t3", 20, 22, "TÊN", "z", 0.9), (1, "r", 12, 14, "KQ", "w", 0.9), (1, "q", 40, 41, "KQ", "v", 0.9)], "doc_id long, id string, start long, end long, type string, text string, utility double")
    resolved = decode.resolve_consistency(s, {}, 0.5)
    pairings = spark.createDataFrame([(1, "r", ["t1", "t2", "t3"], "t2"), (1, "q", ["t2"], "t2")], "doc_id long, result_id string, test_ids array<string>, assigned string")
    out, pairs = decode.resolve_lab_pairs(resolved, pairings)
    assert [(r.result_id, r.test_id, r.reassigned) for r in pairs.collect()] == [("r", "t3", True)]
    assert {r.id: r.reason for r in out.collect()} == {"t1": "kept", "t2": "utility_below_minimum", "t3": "kept", "r": "kept", "q": "lab_pair_abstained"}
    edges = spark.createDataFrame([(1, "t1", "r", False), (1, "t1", "q", True)], "doc_id long, left_id string, right_id string, compatible boolean")
    assert {r.id: r.blockers for r in decode.overlap_blockers(s, edges).collect()} == {"t1": ["r"], "r": ["t1"], "t2": [], "t3": [], "q": []}


def test_p15_j09_j24_retrieval(spark):
    concepts = spark.createDataFrame([("RXNORM", "1", True), ("ICD", "2", True), ("RXNORM", "3", False)], "system string, concept_id string, active boolean")
    types = {"medication": ("RXNORM",), "diagnosis": ("ICD",)}
    ids = lambda *a: sorted(r.concept_id for r in retrieval.eligible(concepts, *a).collect())
    assert ids() == ["1", "2"] and ids(("ICD",)) == ["2"] and ids((), ("medication",), types) == ["1"] and ids(("RXNORM", "ICD"), ("diagnosis",), types) == ["2"]
    # Types that leave nothing start anew.
    assert ids((), ("medication", "diagnosis"), types) == ["1", "2"] and ids(("RXNORM",), ("diagnosis",), types) == ["1", "2"]
    with pytest.raises(ValueError, match="unsupported"):
        retrieval.eligible(concepts, (), ("x",), types)
    aliases = spark.createDataFrame([("1", "Paracetamol"), ("2", "Đái tháo đường"), ("3", "Paracetamol")], "id string, alias string")
    allowed = retrieval.eligible(concepts).select(F.col("concept_id").alias("id"))
    q = spark.createDataFrame([(1, "dai thao duong"), (2, " PARACETAMOL "), (3, "  ")], "query_id long, text string")
    got = {(r.query_id, r.id, r.channel) for r in retrieval.lexical_search(q, aliases, allowed).collect()}
    assert {(1, "2", "accentless_exact"), (2, "1", "exact_alias"), (2, "1", "accentless_exact"), (2, "1", "bm25")} <= got
    assert not any(i == "3" or k == 3 for k, i, _ in got) and (1, "2", "exact_alias") not in got
    m = spark.createDataFrame([(7, "paracetamol 500 mg po bid"), (8, "500 mg")], "query_id long, text string")
    found = {(r.query_id, r.id) for r in retrieval.slot_search(m, aliases, concepts, "medication", types).where("channel = 'exact_alias'").collect()}
    assert found == {(7, "1")}


def test_f02_f03_f15_f17_t35_keys(spark):
    row = spark.range(1).select(
        T.feature_key(F.lit("  A\t b ")), T.unit_key(F.lit("5 \u00b5G")), T.unit_key(F.lit("UG/mL")), T.range_key(F.lit("3,5 – 4")), T.route_key(F.lit(" Uống")), T.route_key(F.lit("iv")), T.route_key(F.lit("Nasal")),
        T.comparator_key(F.lit("≤")), T.qualitative_key(F.lit("Dương  tính")), T.accentless(F.lit("Đái-tháo  đường ß É")), T.association_tier(F.lit(0.85)), T.association_tier(F.lit(0.7)), T.association_tier(F.lit(0.1)),
        T.context_window(F.lit("0123456789"), F.lit(4), F.lit(6), 2), T.context_window(F.lit("0123"), F.lit(0), F.lit(1), 50), T.drug_text(F.lit("A"), F.lit("5 mg"), F.lit(" "), F.lit(None).cast("string"), F.lit("bid")), T.lab_text(F.lit("Na"), F.lit("140"), F.lit("")),
    ).first()
    assert list(row) == ["a b", "5mcg", "mcg/ml", "3.5-4", "oral", "intravenous", "nasal", "<=", "positive", "dai thao duong ss e", "high", "medium", "low", "234567", "0123", "A 5 mg bid", "Na: 140"]


def test_t11_t13_proposers_use_their_own_patterns():
    names, results = K.laboratory("CEA: 5 ng/mL", ["CEA"])
    assert [("CEA: 5 ng/mL"[a:b]) for a, b, _ in results] == ["5 ng/mL"]
    text = "TSH 2,1 mIU/L; proBNP: 300 pg/mL positive, cao"
    names, results = K.laboratory(text, ["TSH", "proBNP"])
    assert [(text[a:b], i) for a, b, i in results] == [("2,1 mIU/L", 0), ("300 pg/mL", 1), ("cao", 1)]
    assert K.laboratory("Glucose (3.9-5.6) x", ["Glucose"])[1] == []
    text = "aspirin 81 mg po and metoprolol 25 mg"
    assert [text[a:b] for a, b, _ in K.medications(text, ["aspirin", "metoprolol"])] == [text] or len(K.medications(text, ["aspirin", "metoprolol"])) == 1
    assert [k for _, _, k in K.medications("warfarin 5 ug", ["warfarin"])] == [()]


def test_f10_hash_vectors():
    raw = [int.from_bytes(hashlib.sha256(f"{i}:ho".encode()).digest()[:8], "big") / 2**63 - 1 for i in range(4)]
    norm = sum(x * x for x in raw) ** 0.5
    assert K.hash_embedding("ho", 4) == pytest.approx([x / norm for x in raw])


def test_t16_prior():
    assert K.symptom_prior(("symptom",), "x", True, "đau") == {"symptom": 0.9, "diagnosis": 0.1}
    both = ("symptom", "diagnosis")
    assert K.symptom_prior(both, "x", True, "đau")["diagnosis"] == 0.75 and K.symptom_prior(both, "ĐAU", False, "đau")["symptom"] == 0.75 and K.symptom_prior(both, "x", False, "đau")["symptom"] == 0.5
