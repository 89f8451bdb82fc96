"""Embedding near-duplicates by sorted projections and block comparison; exact.

1. Vectors that are equal (same label, same components) form a class with a multiplicity; one representative goes on.
2. Each vector is hashed to the signs of BITS random projections; representatives are range-sorted by label and those
   bits, numbered through and dealt into blocks of BLOCK rows.
3. A block knows its interval on PROBES projections on unit directions. A projection never lengthens a distance, so two
   blocks whose intervals lie further apart than linked vectors can be are not compared; no pair is lost by that.
4. All other pairs of blocks that share a label are compared in full, a task each: single-precision products, and double
   precision for what lies within their rounding error of the threshold. A task emits one count a vector and a spanning
   forest, not all pairs. Time grows with the square of a label that projections do not part.
5. Forests of all tasks are united into components.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components, null labels and null ids
link with nothing; so do vectors of different length. Labels may be of any type. Scaled copies are links like others. A repeated row counts once; an id
with several vectors is one vertex. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch
from .components import connected_components

BITS, PROBES, BLOCK = 63, 16, 8192


def unit(vectors: pa.Array) -> np.ndarray:
    """(rows, dimensions) in double precision, of length 1. All rows have one length."""
    flat = np.asarray(vectors.flatten(), np.float64).reshape(len(vectors), -1)
    # The squares of very large or very small components would leave the range of numbers.
    flat = flat / np.abs(flat).max(axis=1, keepdims=True)
    return flat / np.linalg.norm(flat, axis=1, keepdims=True)


def _by_dimension(batch: pa.RecordBatch, column: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, unit vectors) of the rows of each vector length."""
    n = batch.column(column).value_lengths().to_numpy()
    for d in np.unique(n):
        rows = np.flatnonzero(n == d)
        yield rows, unit(batch.column(column).take(pa.array(rows)))


def _projector(seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, probes = np.zeros(batch.num_rows, np.int64), np.zeros((batch.num_rows, PROBES))
            for rows, v in _by_dimension(batch, "vec"):
                d = v.shape[1]
                if d not in planes:
                    g = np.random.default_rng(seed + d).standard_normal((d, BITS))
                    planes[d] = g / np.linalg.norm(g, axis=0)
                at = v @ planes[d]
                keys[rows] = (at > 0) @ (np.int64(1) << np.arange(BITS - 1, -1, -1, dtype=np.int64))
                probes[rows] = at[:, :PROBES]
            offsets = np.arange(0, probes.size + 1, PROBES, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys), pa.ListArray.from_arrays(pa.array(offsets), pa.array(probes.ravel()))], names=[*batch.schema.names, "key", "probes"])

    return run


def _compare(least: float):
    """Of two blocks (or one with itself): of each vector the number of links with the other block, and the links that
    join something new, as a spanning forest."""

    def run(t):
        t = t.combine_chunks()
        i, j, block = t.column("i")[0].as_py(), t.column("j")[0].as_py(), t.column("block").to_numpy()
        mult, key, label = (t.column(c).to_numpy() for c in ("n", "rep", "label"))
        links, tree, forest = np.zeros(t.num_rows, np.int64), np.arange(t.num_rows), ([], [])
        one_label = (label == label[0]).all()
        batch = pa.RecordBatch.from_arrays([t.column("vec").combine_chunks()], names=["vec"])
        for rows, v in _by_dimension(batch, "vec"):
            single, slack = v.astype(np.float32), (v.shape[1] + 8) * 2.0**-23
            left, right = np.flatnonzero(block[rows] == i), np.flatnonzero(block[rows] == j)
            others = single[right].T
            for at in range(0, len(left), 512):
                own = left[at : at + 512]
                cos = single[own] @ others
                hit = cos >= least - slack
                x, y = np.nonzero(hit & (cos < least + slack))
                for a in range(0, len(x), 1 << 16):
                    x_, y_ = x[a : a + (1 << 16)], y[a : a + (1 << 16)]
                    hit[x_, y_] = np.einsum("ij,ij->i", v[own[x_]], v[right[y_]]) >= least
                if not one_label:
                    hit &= label[rows[own]][:, None] == label[rows[right]][None]
                if i == j:
                    hit[np.arange(len(own)), at + np.arange(len(own))] = False
                some = np.flatnonzero(hit.any(1))
                hit = hit[some]
                links[rows[own[some]]] += hit @ mult[rows[right]]
                if i != j:
                    links[rows[right]] += mult[rows[own[some]]] @ hit
                for r, line in zip(rows[own[some]].tolist(), hit):
                    near = rows[right[line]]
                    trees, first = np.unique(tree[near], return_index=True)
                    new = trees != tree[r]
                    if new.any():
                        forest[0].extend([key[r]] * int(new.sum()))
                        forest[1].extend(key[near[first[new]]].tolist())
                        tree[np.isin(tree, trees[new])] = tree[r]
        keep, n = np.flatnonzero(links), len(forest[0])
        none = lambda kind, m: pa.nulls(m, kind)
        counts = [pa.array(label[keep]), t.column("which").combine_chunks().take(pa.array(keep)), pa.array(links[keep]), none(pa.int64(), len(keep)), none(pa.int64(), len(keep))]
        joins = [none(pa.int64(), n), none(pa.string(), n), none(pa.int64(), n), pa.array(forest[0], pa.int64()), pa.array(forest[1], pa.int64())]
        return pa.table([pa.concat_arrays([c.cast(j_.type), j_]) for c, j_ in zip(counts, joins)], names=["label", "which", "links", "a", "b"])

    return run


def embedding_dedup(
    vectors: DataFrame, least: float = 0.98, seed: int = 17,
    id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row for each row of ``vectors``."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "vectors")
    # Single-precision components stay so on disk; products are taken in double precision.
    number = vectors.schema[vec_col].dataType.elementType.simpleString()
    kept = number in ("float", "double")
    number = number if kept else "double"
    vec = F.col(vec_col) if kept else F.transform(F.col(vec_col), lambda x: x.cast("double"))
    whole = vectors.schema[label_col].dataType.typeName() in ("byte", "short", "integer", "long")
    # Other labels are told apart by a 64-bit hash.
    label = F.col(label_col).cast("long") if whole else F.when(F.col(label_col).isNotNull(), F.xxhash64(F.col(label_col)))
    raw = vectors.select(F.col(id_col).cast("long").alias("vec_id"), label.alias("label"), vec.alias("vec"))
    fine = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)
    rows = raw.withColumn("ok", F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & fine, F.lit(False)))
    usable = rows.where("ok").select("vec_id", "label", "vec")
    # A class is known by its label and a 128-bit digest of its vector.
    which = F.md5(F.array_join(F.transform("vec", lambda x: (x.cast("double") + 0.0).cast("string")), " "))
    member = usable.withColumn("which", which)
    classes = member.groupBy("label", "which").agg(F.min("vec_id").alias("rep"), F.count_distinct("vec_id").alias("n"), F.any_value("vec").alias("vec"))
    reps = scratch.save(classes.select("rep", "label", "which", "n", "vec"))

    # Sorted by label and key; then every row gets its number in that order, and so its block.
    keyed = reps.select("rep", "label", "which", "n", "vec").mapInArrow(_projector(seed), f"rep long, label long, which string, n long, vec array<{number}>, key long, probes array<double>")
    order = ["label", "key", "rep", "which"]
    sorted_ = scratch.save(keyed.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id()))
    part, nth = F.shiftright("place", 33), F.col("place").bitwiseAND((1 << 33) - 1)
    # A row for each partition: where its numbers begin.
    sizes = sorted_.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    starts = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    numbered = sorted_.withColumn("part", part).join(F.broadcast(starts), "part").withColumn("block", F.floor((F.col("before") + nth) / BLOCK))

    # Pairs of blocks: one with itself, and two that share a label, which is then the last of one and the first of the other.
    ends = [f(F.col("probes")[k]).alias(f"{name}{k}") for k in range(PROBES) for name, f in (("lo", F.min), ("hi", F.max))]
    span = scratch.save(numbered.groupBy("block").agg(F.min("label").alias("first"), F.max("label").alias("last"), *ends))
    reach = (2 * (1 - least)) ** 0.5 + 1e-6
    x, y = span.alias("x"), span.alias("y")
    apart = [F.greatest(F.col(f"x.lo{k}"), F.col(f"y.lo{k}")) - F.least(F.col(f"x.hi{k}"), F.col(f"y.hi{k}")) for k in range(PROBES)]
    two = x.join(y, (F.col("x.last") == F.col("y.first")) & (F.col("x.block") < F.col("y.block"))).where(F.greatest(*apart) <= reach).select(F.col("x.block").alias("i"), F.col("y.block").alias("j"))
    met = two.unionByName(span.select(F.col("block").alias("i"), F.col("block").alias("j")))
    met = met.select("i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("block"))
    tiles = numbered.select("rep", "label", "which", "n", "vec", "block").join(met, "block")
    found = scratch.save(tiles.groupBy("i", "j").applyInArrow(_compare(least), "label long, which string, links long, a long, b long"), few=True)
    scratch.drop(sorted_)
    links = found.where("links is not null").groupBy("label", "which").agg(F.sum("links").alias("links"))
    own = member.join(reps.select("label", "which", "rep"), ["label", "which"]).where("vec_id <> rep").select(F.col("rep").alias("a"), F.col("vec_id").alias("b"))
    comps = scratch.save(connected_components(found.where("a is not null").select("a", "b").unionByName(own), scratch))

    per_vector = (
        member.select("vec_id", "label", "which").distinct()
        .join(reps.select("label", "which", "n"), ["label", "which"])
        .join(links, ["label", "which"], "left")
        .groupBy("vec_id").agg(F.sum(F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    )
    component = F.coalesce("component", "vec_id")
    return (
        rows.select("vec_id")
        .join(per_vector, "vec_id", "left")
        .join(comps.withColumnRenamed("vertex", "vec_id"), "vec_id", "left")
        .select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))
    )
