"""Plug-ins with stand-ins for models, retries, the command line."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from spanloom import cli
from spanloom.functions import kernels as K
from spanloom.operators import generate as G


def test_protocols_and_stand_ins(spark):
    assert isinstance(G.HashEncoder(), G.MentionEncoder) and isinstance(G.OverlapScorer(), G.PairScorer) and isinstance(G.TemplateModel({}), G.TextModel)
    rows = spark.createDataFrame([(1, "ho khan", "ho"), (2, None, "ho")], "id int, mention string, term string")
    got = {r.id: r for r in G.pair_scores(G.encoded(rows, lambda: G.HashEncoder(4), "mention")).collect()}
    assert got[1].vector == pytest.approx(K.hash_embedding("ho khan", 4)) and (got[1].score, got[2].score) == (0.5, 0.0)


def test_x05_retries():
    waits, fails = [], [G.Overloaded(), ValueError()]

    def call():
        if fails:
            raise fails.pop(0)
        return "ok"

    assert G.with_retries(call, sleep=waits.append) == "ok" and waits == [30.0, 2.0]
    with pytest.raises(ZeroDivisionError):
        G.with_retries(lambda: 1 / 0, tries=2, sleep=waits.append)


def test_t17_proposals_of_a_model(spark):
    docs = spark.createDataFrame([(1, "ho rồi ho"), (2, "ho"), (3, "sốt")], "doc_id long, text string")
    item = json.dumps([{"text": "ho", "provisional_type": "TRIỆU_CHỨNG"}], ensure_ascii=False)
    factory = lambda: G.TemplateModel({"^sốt": "nonsense", "ho": item})
    assert G.proposed(docs, factory).count() == 0
    got = G.proposed(docs, factory, allowed=True).collect()
    assert sorted((r.doc_id, r.start, r.end, r.score) for r in got) == [(1, 0, 2, 0.5), (1, 7, 9, 0.5), (2, 0, 2, 0.5)]


ENTITY = "struct<text:string,type:string,start:int,end:int,assertions:array<string>,candidates:array<string>>"


def test_g07_critic_places_spans_anew(spark):
    rows = [(1, "ho rồi sốt", [("ho", "TRIỆU_CHỨNG", 0, 2, [], None), ("sốt", "TRIỆU_CHỨNG", 0, 3, [], None), ("đau", "TRIỆU_CHỨNG", 0, 3, [], None)], "basic"), (2, "ho", [("ho", "TRIỆU_CHỨNG", 0, 2, [], None)], "basic")]
    got = {r.id: r for r in G.criticised(spark.createDataFrame(rows, f"id int, text string, entities array<{ENTITY}>, profile string"), {}).collect()}
    assert got[2].valid and not got[1].valid and [(e.text, e.start, e.end) for e in got[1].fixed] == [("ho", 0, 2), ("sốt", 7, 10)] and got[2].fixed == got[2].entities


def test_g08_labels_of_a_teacher(spark):
    notes = spark.createDataFrame([(1, "ho và sốt"), (2, "x"), (3, "y")], "id int, note string")
    answer = json.dumps([{"text": "ho", "type": "TRIỆU_CHỨNG", "assertions": ["isNegated", "odd"], "confidence": 2}, {"text": "sốt", "type": "X"}, {"text": "sốt", "type": "TRIỆU_CHỨNG", "confidence": 0.1}], ensure_ascii=False)
    got = {r.id: r for r in G.labelled(notes, lambda: G.TemplateModel({"ho": answer, "^x": "not json"})).collect()}
    assert [(e.text, e.start, e.assertions, e.confidence) for e in got[1].entities] == [("ho", 0, ["isNegated"], 1.0)]
    assert {i: r.status for i, r in got.items()} == {1: "labeled", 2: "parse_failed", 3: "no_entities"}


def test_g09_paraphrases_keep_labels(spark):
    e = "struct<text:string,type:string,assertions:array<string>>"
    rows = [(i, t, [("ho", "TRIỆU_CHỨNG", [])]) for i, t in ((1, "bị ho"), (2, "có ho"), (3, "hay ho"))]
    ok = {"text": "đang ho nhiều", "entities": [{"text": "ho", "type": "TRIỆU_CHỨNG", "assertions": []}]}
    answers = {"bị": json.dumps(ok, ensure_ascii=False), "có": json.dumps(ok | {"entities": []}), "hay": json.dumps(ok | {"text": "khác"}, ensure_ascii=False)}
    got = {r.id: (r.paraphrase, r.entities_again and [(x.start, x.end) for x in r.entities_again]) for r in G.paraphrased(spark.createDataFrame(rows, f"id int, text string, entities array<{e}>"), lambda: G.TemplateModel(answers)).collect()}
    assert got == {1: ("đang ho nhiều", [(5, 7)]), 2: (None, None), 3: (None, None)}


def test_t36_styles_are_repeatable(spark):
    rows = spark.range(400).select("id", F.lit("Bệnh nhân ho, bệnh nhân sốt").alias("t"))
    style = lambda level: [r[0] for r in rows.orderBy("id").select(G.styled(F.col("t"), F.col("id"), {"bệnh nhân": "BN", "sốt": "$1"}, level)).collect()]
    assert style(0.0) == ["Bệnh nhân ho, bệnh nhân sốt"] * 400 and style(1.0) == ["BN ho, BN $1"] * 400
    some = style(0.3)
    assert some == style(0.3) and 60 < sum(x.startswith("BN") for x in some) < 180


def test_g11_g12_g15_commands(tmp_path, capsys):
    def run(*argv):
        code = cli.main([str(a) for a in argv])
        return code, json.loads(capsys.readouterr().out)

    (tmp_path / "c.json").write_text('{"dense": true}')
    (tmp_path / "bad.json").write_text("{")
    (tmp_path / "m.json").write_text('{"status": "finalized", "completed": 1, "failed": 0, "resumed": 0, "n": 1}')
    (tmp_path / "inv.json").write_text("[]")
    assert run("validate-config", tmp_path / "c.json") == (0, {"ok": True})
    assert run("offline-preflight", tmp_path / "none.json") == (1, {"ok": False, "error": "missing"})
    assert run("show-manifest", tmp_path / "bad.json") == (1, {"ok": False, "error": "format"})
    assert run("final-gate", tmp_path / "c.json", tmp_path / "inv.json", tmp_path / "m.json")[0] == 0
    (tmp_path / "out").mkdir()
    (tmp_path / "out/1.json").write_text("[]")
    assert run("package", tmp_path / "out", tmp_path / "a.zip") == (0, {"ok": True, "files": 1})
