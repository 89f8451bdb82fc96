"""Connected components over shared keys."""

from __future__ import annotations

import atexit
import hashlib
import json
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a local session without one gets a temporary folder, any other must name one, as executors
    cannot see the driver's own disk."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='spanloom-')}"
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


class Saved:
    """Tables written to the folder that all executors share and read from there: lineage ends. ``drop`` deletes what is
    not read any more; what is left goes when the process ends."""

    def __init__(self, spark: SparkSession):
        self.spark, self.base, self.n = spark, f"{shared_folder(spark)}/spanloom-{uuid.uuid4().hex}", 0
        atexit.register(self._delete, self.base)

    def put(self, df: DataFrame) -> tuple[DataFrame, str]:
        self.n += 1
        path = f"{self.base}/t{self.n}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path), path

    def drop(self, path: str) -> None:
        self._delete(path)

    def _delete(self, path: str) -> None:
        try:
            target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # noqa: BLE001  the session may be gone at exit
            pass


#: Edges of a file.
ROWS = 1_000_000


def components(edges: DataFrame, vertices: DataFrame | None = None) -> DataFrame:
    """(vertex, component): the smallest vertex that links reach. ``edges`` has columns a and b.

    Labels fall to the smallest neighbour's, then to that label's own, until none changes; the minimum is combined
    before each shuffle, so a vertex with very many links is no hot spot.
    """
    store = Saved(edges.sparkSession)
    links = edges.where("a <> b").select("a", "b")
    both, _ = store.put(links.union(links.select("b", "a")).distinct())
    files = 1 + both.count() // ROWS
    label, path = store.put(both.select(F.col("a").alias("vertex"), F.col("a").alias("component")).distinct())
    while True:
        near = both.join(label.withColumnRenamed("vertex", "b"), "b").groupBy("a").agg(F.min("component").alias("near"))
        low = label.join(near, label.vertex == near.a).select("vertex", F.least("component", "near").alias("low"), "component")
        jump = label.select(F.col("vertex").alias("low"), F.col("component").alias("next"))
        moved = low.join(jump, "low").select("vertex", F.least("low", "next").alias("new"), "component")
        old = path
        after, path = store.put(moved.coalesce(files))
        store.drop(old)
        label = after.select("vertex", F.col("new").alias("component"))
        if after.where("new <> component").isEmpty():
            break
    if vertices is None:
        return label
    return vertices.join(label, "vertex", "left").select("vertex", F.coalesce("component", "vertex").alias("component"))


def _group_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (component, id) to (component, sha256 of the ids as a JSON list); a digest and one id are held at a time."""
    shape = pa.schema([("component", pa.int64()), ("group_id", pa.string())])
    last, digest = None, None
    for batch in batches:
        out: tuple[list, list] = ([], [])
        for component, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if component != last:
                if digest is not None:
                    digest.update(b"]")
                    out[0].append(last)
                    out[1].append(digest.hexdigest())
                last, digest = component, hashlib.sha256(b"[")
            else:
                digest.update(b",")
            digest.update(json.dumps(name, ensure_ascii=False).encode())
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.string())], schema=shape)
    if digest is not None:
        digest.update(b"]")
        yield pa.RecordBatch.from_arrays([pa.array([last], pa.int64()), pa.array([digest.hexdigest()])], schema=shape)


def shared_key_components(keys: DataFrame) -> DataFrame:
    """(id, group_id, component) of records that share any (field, value): ``keys`` has id, field, value; null and empty
    values link nothing.

    A record is linked to the smallest one with the same key, not to all. group_id is the sha256 of the sorted ids as a
    JSON list. A digest takes them one after the other, so a component passes through one task, as a stream of ids."""
    some = keys.where("value is not null and value <> ''")
    first = some.groupBy("field", "value").agg(F.min("id").alias("a"))
    edges = some.join(first, ["field", "value"]).select("a", F.col("id").alias("b"))
    comp = components(edges, keys.select(F.col("id").alias("vertex")).distinct())
    ids = comp.select(F.col("component").cast("long").alias("component"), F.col("vertex").cast("string").alias("name"))
    named = ids.repartition("component").sortWithinPartitions("component", "name").mapInArrow(_group_ids, "component long, group_id string")
    return comp.join(named, "component").select(F.col("vertex").alias("id"), "group_id", "component")
