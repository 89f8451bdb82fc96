"""Shared pieces: folders, batch sizes, memory of reused workers, components."""

from __future__ import annotations

import types

import pytest

from spanloom.llm import common
from spanloom.llm.components import connected_components


def session(master: str, folder: str | None = None):
    conf = types.SimpleNamespace(get=lambda key, default=None: folder)
    return types.SimpleNamespace(conf=conf, sparkContext=types.SimpleNamespace(master=master, getCheckpointDir=lambda: None, setCheckpointDir=lambda path: None))


@pytest.mark.parametrize("master", ["spark://host:7077", "yarn", "k8s://x", "local-cluster[2,1,1024]"])
def test_a_cluster_must_name_a_shared_folder(master):
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.scratch_root(session(master))
    assert common.scratch_root(session(master, "s3a://bucket/shared/")) == "s3a://bucket/shared"


def test_a_local_session_gets_a_folder():
    assert common.scratch_root(session("local[2]")).startswith("file:///")


def test_batch_size_of_the_session_is_left_alone(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    was = spark.conf.get(key, None)
    try:
        spark.conf.set(key, str(3 << 20))
        common.small_batches(spark)
        assert spark.conf.get(key) == str(3 << 20)
        spark.conf.unset(key)
        common.small_batches(spark)
        assert spark.conf.get(key) == str(common.BATCH_BYTES)
    finally:
        spark.conf.set(key, was) if was else spark.conf.unset(key)


def test_a_worker_drops_what_others_hold(monkeypatch):
    monkeypatch.setattr(common, "_release", {})
    dropped = []
    common.claim("a", lambda: dropped.append("a"))
    common.claim("a", lambda: dropped.append("a"))
    common.claim("b")
    common.claim("a", lambda: dropped.append("a again"))
    assert dropped == ["a"]


def test_components_of_many_files(spark, monkeypatch):
    monkeypatch.setattr("spanloom.llm.components.ROWS", 3)
    edges = [(i, i + 1) for i in range(40) if i % 9] + [(5, 5), (None, 3), (1, 2), (2, 1)]
    got = {r.vertex: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long"), common.Scratch(spark, "test")).collect()}
    want, low = {}, None
    for i in range(41):
        low = low if i and (i - 1) % 9 and low is not None else i
        want[i] = low
    assert got == {i: c for i, c in want.items() if any(i in e and None not in e and e[0] != e[1] for e in edges)}
