"""Leakage-safe splits, bootstrap comparison, quotas."""

from __future__ import annotations

import hashlib
import random

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.kernels import canonical_json
from .similarity import jaccard_classes


def hash_rank(df: DataFrame, digest: str, tie: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``rank`` (from 1) in the order of a hex digest, then ``tie``, and ``n``, in each group of ``by``.

    Rows are ranked inside cells of three digits and moved by the sizes of the cells before, so no group is ordered in
    one task; a window sees at most 4,096 cells of a group."""
    keyed, one = df.withColumn("__cell", F.substring(digest, 1, 3)), F.lit(1)
    cells = keyed.groupBy(*by, "__cell").agg(F.count("*").alias("__c"))
    group = Window.partitionBy(*(by or (one,)))
    before = F.sum("__c").over(group.orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1))
    starts = cells.select(*by, "__cell", F.coalesce(before, F.lit(0)).alias("__before"), F.sum("__c").over(group).alias("n"))
    inside = F.row_number().over(Window.partitionBy(*by, "__cell").orderBy(digest, tie))
    return keyed.withColumn("__i", inside).join(starts, [*by, "__cell"]).withColumn("rank", F.col("__before") + F.col("__i")).drop("__cell", "__before", "__i")


SPLITS = ("train", "dev", "test")
#: Groups that the sequential fold takes.
MOST_GROUPS = 1_000_000


def assign_groups(sizes: dict[str, int], shares: tuple[float, ...] = (0.6, 0.2, 0.2), seed: int = 17) -> dict[str, str]:
    """Whole groups in the order of a seeded hash; the first three start the splits, each other one goes to the split
    that is least filled for its share (then the smaller, then the earlier)."""
    if len(sizes) < len(SPLITS):
        raise ValueError("a grouped split needs three groups at least")
    order = sorted(sizes, key=lambda g: hashlib.sha256(f"{seed}:{g}".encode()).hexdigest())
    goal = dict(zip(SPLITS, (sum(sizes.values()) * s for s in shares)))
    filled, out = dict.fromkeys(SPLITS, 0), {}
    for i, g in enumerate(order):
        to = SPLITS[i] if i < len(SPLITS) else min(SPLITS, key=lambda s: (filled[s] / goal[s] if goal[s] else 0.0, filled[s], SPLITS.index(s)))
        out[g] = to
        filled[to] += sizes[g]
    return out


def grouped_split(df: DataFrame, group_col: str, shares: tuple[float, ...] = (0.6, 0.2, 0.2), seed: int = 17) -> DataFrame:
    """The rows with ``split``. The fold is sequential, so groups and their sizes, a row a group, go to the driver: at
    most MOST_GROUPS. Rows without a group are refused, as they might belong to any."""
    groups = df.groupBy(group_col).count()
    some = groups.limit(MOST_GROUPS + 1).collect()
    if len(some) > MOST_GROUPS:
        raise ValueError(f"more than {MOST_GROUPS} groups")
    if any(r[0] is None for r in some):
        raise ValueError("rows without a group cannot be split")
    named = {str(r[0]): r[0] for r in some}
    rows = [(named[g], split) for g, split in assign_groups({str(r[0]): r[1] for r in some}, shares, seed).items()]
    kind = df.schema[group_col].dataType.simpleString()
    return df.join(df.sparkSession.createDataFrame(rows, f"`{group_col}` {kind}, split string"), group_col)


def manifest(df: DataFrame, group_col: str) -> dict:
    """Counts by split, groups that lie in several, and a checksum of it all."""
    rows = {r.split: [r.n, r.g] for r in df.groupBy("split").agg(F.count("*").alias("n"), F.count_distinct(group_col).alias("g")).collect()}
    leaks = df.groupBy(group_col).agg(F.count_distinct("split").alias("k")).where("k > 1").count()
    body = {"counts": rows, "leaking_groups": leaks}
    return body | {"checksum": hashlib.sha256(canonical_json(body).encode()).hexdigest()}


def leakage(sets: DataFrame, least: float) -> DataFrame:
    """Of sets (id, split, items) with a similarity of ``least`` and more in different splits: split_a, split_b,
    a, b (ids), jaccard. Of equal sets of a split the smallest id stands for all, so copies make no pairs."""
    members, pairs = jaccard_classes(sets.select("id", "items"), least)
    first = members.join(sets.select("id", "split"), "id").groupBy("class", "split").agg(F.min("id").alias("first"))
    x, y = (first.select(F.col("class").alias(n), F.col("split").alias(f"split_{n}"), F.col("first").alias(f"first_{n}")) for n in "ab")
    near = pairs.join(x, "a").join(y, "b").where("split_a <> split_b")
    same = first.select(F.col("class").alias("a"), F.col("split").alias("split_a"), F.col("first").alias("first_a")).join(y.withColumnRenamed("b", "a"), "a").where("split_a < split_b").withColumn("jaccard", F.lit(1.0))
    columns = ["split_a", "split_b", F.col("first_a").alias("a"), F.col("first_b").alias("b"), "jaccard"]
    return near.select(*columns).unionByName(same.select(*columns))


#: Grams of a benchmark that are broadcast to the documents, each some hundred bytes.
MOST_GRAMS = 100_000


def contamination(docs: DataFrame, items: DataFrame, n: int) -> DataFrame:
    """Documents (doc_id, w) that hold word n-grams of benchmark items (item_id, w): doc_id, item_id, shared
    grams, coverage of the item. Documents' grams meet the items' where they are read, as hashes, if these are few (or
    are shuffled, else); only hits are made distinct, and their words compared."""
    gram = lambda df, i: df.select(i, F.explode(T.ngrams(F.col("w"), n)).alias("g"))
    b = gram(items, "item_id").distinct().withColumn("h", F.xxhash64("g"))
    few = b.limit(MOST_GRAMS + 1).count() <= MOST_GRAMS
    hit = gram(docs, "doc_id").withColumn("h", F.xxhash64("g")).join(F.broadcast(b) if few else b, ["h", "g"]).select("doc_id", "item_id", "g").distinct()
    sizes = b.groupBy("item_id").agg(F.count("*").alias("n"))
    return hit.groupBy("doc_id", "item_id").agg(F.count("*").alias("shared")).join(sizes, "item_id").select("doc_id", "item_id", "shared", (F.col("shared") / F.col("n")).alias("coverage"))


def bootstrap(pairs: list[tuple[float, float]], draws: int = 1000, seed: int = 0) -> dict[str, float]:
    """Mean difference of paired scores with its 95% interval by percentile index; a row a sample, on the driver."""
    if not pairs:
        raise ValueError("no pairs")
    rng, d = random.Random(seed), np.array([b - a for a, b in pairs])
    means = sorted(float(d[[rng.randrange(len(d)) for _ in d]].mean()) for _ in range(draws))
    low, high = means[int(0.025 * (draws - 1))], means[int(0.975 * (draws - 1))]
    return {"delta": float(d.mean()), "low": low, "high": high, "relevant": low > 0 or high < 0}


def apportion(groups: DataFrame, total: int, name: str = "group", weight: str = "n") -> DataFrame:
    """(name, weight, quota): whole quotas by largest remainder, of equal ones the earlier name. ``groups`` has a row
    a group, which two windows see in one task."""
    every = Window.partitionBy(F.lit(1))
    exact = F.col(weight) * float(total) / F.nullif(F.sum(weight).over(every), F.lit(0))
    f = groups.withColumn("__exact", F.coalesce(exact, F.lit(0.0))).withColumn("__base", F.floor("__exact"))
    order = F.row_number().over(every.orderBy(F.desc(F.col("__exact") - F.col("__base")), name))
    r = f.withColumn("__k", order).withColumn("__rest", F.when(F.sum(weight).over(every) > 0, total - F.sum("__base").over(every)).otherwise(0))
    return r.select(name, weight, (F.col("__base") + F.when(F.col("__k") <= F.col("__rest"), 1).otherwise(0)).cast("long").alias("quota"))


def buckets(rows: DataFrame, rules: dict[str, Column], id_col: str = "id") -> DataFrame:
    """(bucket, n, first_id) of every rule, also of those that no row fits; a row may be in several."""
    tags = F.array_compact(F.array(*(F.when(c, n) for n, c in rules.items())))
    n = rows.select(F.col(id_col).alias("id"), F.explode(tags).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))
    names = rows.sparkSession.createDataFrame([(b,) for b in rules], "bucket string")
    return names.join(n, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"), "first_id")


def largest_remainder(total: int, weights: dict[str, float]) -> dict[str, int]:
    """Whole quotas that add up to ``total``; of equal remainders the earlier key."""
    whole = sum(weights.values())
    exact = {k: total * w / whole for k, w in weights.items()} if whole else dict.fromkeys(weights, 0.0)
    out = {k: int(x) for k, x in exact.items()}
    for k in sorted(exact, key=lambda k: -(exact[k] - out[k]))[: total - sum(out.values()) if whole else 0]:
        out[k] += 1
    return out


def boosts(signals: DataFrame) -> DataFrame:
    """(profile, weight) from signals of each profile: 1, and 1 each for a missing type and a missing label, errors
    / 10 up to 2, deficit / 10 up to 1, and 0.5 where positions are bad."""
    add = lambda c, most: F.least(F.coalesce(c, F.lit(0)) / 10, F.lit(most))
    flag = lambda c, x: F.when(F.coalesce(F.col(c), F.lit(False)), x).otherwise(0.0)
    weight = 1.0 + flag("missing_type", 1.0) + flag("missing_label", 1.0) + add("errors", 2.0) + add("deficit", 1.0) + flag("bad_positions", 0.5)
    return signals.select("profile", weight.alias("weight"))


def next_profile(done: dict[str, int], target: dict[str, int], seed: int = 0) -> str:
    """A profile with the largest deficit, ties at random; by target weight where none is in deficit."""
    rng, gap = random.Random(seed), {k: t - done.get(k, 0) for k, t in target.items()}
    most = max(gap.values())
    if most > 0:
        return rng.choice(sorted(k for k, g in gap.items() if g == most))
    return rng.choices(sorted(target), [target[k] for k in sorted(target)])[0]
