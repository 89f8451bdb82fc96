"""The pipeline's stages, each on what the last one kept, against brute force and its own promises."""

from __future__ import annotations

from collections import Counter

import corpus_pipeline as P
import pytest

from tests.llm.test_dedup import brute_windows, components
from tests.llm.test_scoring import schedule


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    out, docs = {}, spark.read.parquet(f"{sf_dir}/documents.parquet")
    out["input"] = docs
    for name, stage in P.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, docs, sf_dir).write.parquet(path)
        out[name] = docs = spark.read.parquet(path)
    return out


def test_columns(stages):
    for name, _ in P.STAGES[:-1]:
        assert dict(stages[name].dtypes) == dict(stages["input"].dtypes)
    assert [n for n, _ in P.STAGES] == ["quality", "near_dedup", "substring_dedup", "mixing", "tokens"]


def test_quality_keeps_clean_documents(stages, spark, sf_dir):
    kept = {r.doc_id for r in stages["quality"].select("doc_id").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    assert sum(i in kept for i, q in labels.items() if q) / sum(labels.values()) > 0.95
    assert sum(i not in kept for i, q in labels.items() if not q) >= 0.3 * sum(1 - q for q in labels.values())


def test_near_dedup(stages):
    sets = {}
    for r in stages["quality"].collect():
        w = "".join(c.lower() if c.isascii() else c for c in r.text).encode().split()
        sets[r.doc_id] = frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) or frozenset([tuple(w)] if w else [])
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    comp = components(list(sets), links)
    assert {r.doc_id for r in stages["near_dedup"].collect()} == {i for i, c in comp.items() if i == c}


def test_substring_dedup(stages):
    rows = [(r.doc_id, r.text) for r in stages["near_dedup"].collect()]
    want = brute_windows(rows, 20)
    texts = dict(rows)
    got = {r.doc_id: r.text for r in stages["substring_dedup"].collect()}
    for i, t in rows:
        n, gone, kept = want[i, t]
        assert got.get(i) == (t if not gone else kept if gone < n else None)
    assert set(got) <= set(texts)


def mixed(rows):
    """By brute force: how often each (id, text, source) trains."""
    out = Counter()
    for (i, t, s), copies in zip(rows, schedule(rows)[0]):
        out[i, t, s] += sum(2 * w >= len(t.split()) for _, w in copies)
    return +out


def test_mixing(stages):
    want = mixed([(r.doc_id, r.text, r.source) for r in stages["substring_dedup"].collect()])
    assert Counter((r.doc_id, r.text, r.source) for r in stages["mixing"].collect()) == want


NEW = "a new start of twelve words or so and then what was seen"
EDGE = [
    (1, None, "en", "a", 0), (2, "", "en", None, 0), (3, " \n", None, "a", 2), (None, "some words here and more", "en", "b", 24), (None, "some words here and more", "en", "b", 24),
    (4, "x" * 200_000, "en", "b", 200_000), (5, "the same text twice over again", "en", "a", 30), (5, "the same text twice over again", "en", "a", 30), (6, "The same TEXT twice over again", "en", None, 30),
    (7, " ".join(f"w{i}" for i in range(60)), "fr", "c", None), (8, NEW + " " + " ".join(f"w{i}" for i in range(20, 45)), "fr", "c", 9), (9, " ".join(f"w{i}" for i in range(20, 45)), "fr", "c", 9),
]


@pytest.fixture(scope="module")
def edge(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("edge")
    docs = spark.createDataFrame([(*r, "clash", 1, 2) for r in EDGE], "doc_id long, text string, lang string, source string, n_chars long, row string, copy int, score int")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return docs, str(folder)


def test_stages_of_edge_rows(edge, spark):
    docs, folder = edge
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    rows = lambda df: sorted((tuple(r) for r in df.select("doc_id", "text", "source").collect()), key=key)
    whole = sorted(((i, t, s) for i, t, _, s, _ in EDGE), key=key)
    # Without labels there is no network, and every document stays.
    quality = P.quality(spark, docs, folder)
    assert quality.columns == columns and rows(quality) == whole
    near = P.near_dedup(spark, docs, folder)
    assert near.columns == columns and rows(near) == [r for r in whole if r[0] != 6]
    cut = P.substring_dedup(spark, near, folder)
    want = brute_windows([(i, t) for i, t, _ in whole], 20)
    assert cut.columns == columns
    assert rows(cut) == [(i, t if not want[i, t][1] else want[i, t][2], s) for i, t, s in whole if i not in (6, 9)]
    assert {r.doc_id: r.n_chars for r in cut.collect() if r.doc_id in (7, 8)} == {7: None, 8: len(NEW)}
    mix = P.mixing(spark, docs, folder)
    assert mix.columns == columns and Counter(rows(mix)) == mixed(whole)
    assert sorted(r.doc_id or 0 for r in P.tokens(spark, docs, folder).collect()) == sorted(i or 0 for i, *_ in EDGE)


def test_stages_of_an_empty_table(edge, spark):
    docs, folder = edge
    for _, stage in P.STAGES:
        assert stage(spark, docs.limit(0), folder).collect() == []


def test_run_equals_the_stages(stages, spark, sf_dir):
    rows = lambda df: sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in df.collect())
    assert rows(P.run(spark, sf_dir)) == rows(stages["tokens"])
    assert P.ORACLE_SQL is None
