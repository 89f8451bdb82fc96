"""Calibration of scores: fitting, applying, reliability."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import log_loss, sigmoid


def temperature_grid(points: DataFrame, by: list[str]) -> DataFrame:
    """For each group the temperature of 0.1, 0.2, ... 10.0 with the least mean log loss (the smallest of equal ones).

    Points meet a grid of 100 literals; the sums are combined before the shuffle."""
    t = points.withColumn("t", F.explode(F.transform(F.sequence(F.lit(1), F.lit(100)), lambda i: i / 10.0)))
    nll = t.groupBy(*by, "t").agg(F.round(F.avg(log_loss(sigmoid(F.col("logit") / F.col("t")), F.col("label"))), 9).alias("nll"))
    return nll.groupBy(*by).agg(F.min(F.struct("nll", "t")).alias("b")).select(*by, F.col("b.t").alias("temperature"), F.col("b.nll").alias("nll"))


def platt(logits: np.ndarray, labels: np.ndarray, steps: int = 500, rate: float = 0.05) -> tuple[float, float]:
    """Slope and offset by gradient descent from (1, 0)."""
    a, b = 1.0, 0.0
    for _ in range(steps):
        d = 1 / (1 + np.exp(-np.clip(a * logits + b, -700, 700))) - labels
        a, b = a - rate * float((d * logits).mean()), b - rate * float(d.mean())
    return a, b


def isotonic(logits: np.ndarray, labels: np.ndarray) -> list[tuple[float, float]]:
    """Steps (largest logit, mean) by pooling neighbours whose means fall."""
    blocks: list[list[float]] = []
    for x, y in sorted(zip(logits.tolist(), labels.tolist())):
        blocks.append([x, y, 1.0])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] > blocks[-1][1] / blocks[-1][2]:
            x, s, n = blocks.pop()
            blocks[-1] = [x, blocks[-1][1] + s, blocks[-1][2] + n]
    return [(x, s / n) for x, s, n in blocks]


def fit(points: DataFrame, method: str) -> DataFrame:
    """Source, entity_type, method and parameters of each group, fitted a group at a time.

    A group needs both classes; other groups are refused with an error."""

    def run(t):
        x, y = t["logit"].to_numpy(float), t["label"].to_numpy(float)
        if len(set(y.tolist())) < 2:
            raise ValueError("calibration needs both classes")
        a, b = platt(x, y) if method == "platt" else (None, None)
        steps = isotonic(x, y) if method == "isotonic" else []
        import pandas as pd

        return pd.DataFrame([{"source": t["source"].iloc[0], "entity_type": t["entity_type"].iloc[0], "a": a, "b": b, "x": [s[0] for s in steps], "y": [s[1] for s in steps]}])

    return points.groupBy("source", "entity_type").applyInPandas(run, "source string, entity_type string, a double, b double, x array<double>, y array<double>")


def step_value(logit: Column, xs: Column, ys: Column) -> Column:
    """The first step whose bound reaches the logit, else the last."""
    first = F.array_position(F.transform(xs, lambda x: logit <= x), True)
    return F.element_at(ys, F.when(first > 0, first.cast("int")).otherwise(-1))


def reliability(points: DataFrame, bins: int = 10) -> DataFrame:
    """Equal-width bins of p, empty ones too: n, mean p, share of label 1, and the bin's part of the error."""
    b = F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).cast("int")
    got = points.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg("p").alias("mean_p"), F.avg("label").alias("share"))
    all_ = points.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    total = points.agg(F.count("*").alias("total"))
    whole = all_.join(got, "bin", "left").join(F.broadcast(total))
    gap = F.coalesce(F.col("n") / F.col("total") * F.abs(F.col("mean_p") - F.col("share")), F.lit(0.0))
    return whole.select("bin", F.coalesce("n", F.lit(0)).alias("n"), F.round("mean_p", 6).alias("mean_p"), F.round("share", 6).alias("share"), F.round(gap, 6).alias("gap"))


def fuse_sources(scores: dict[str, Column], weights: dict[str, float], missing: str = "ignore") -> Column:
    """The weighted mean of the sources' scores; a missing one is left out, or counts as 0. Null without any."""
    top = sum((weights.get(s, 1.0) * F.coalesce(c, F.lit(0.0)) for s, c in scores.items()), F.lit(0.0))
    under = sum((F.when(c.isNotNull() | F.lit(missing == "zero"), weights.get(s, 1.0)).otherwise(0.0) for s, c in scores.items()), F.lit(0.0))
    return F.when(under > 0, top / F.greatest(under, F.lit(1e-12)))


def fuse_meta(scores: dict[str, Column], weights: dict[str, float], bias: float = 0.0) -> Column:
    """The logistic function of a bias and the weighted scores; missing ones add nothing."""
    return sigmoid(bias + sum((weights.get(s, 1.0) * F.coalesce(c, F.lit(0.0)) for s, c in scores.items()), F.lit(0.0)))


def accepted(probability: Column, entity_type: Column, thresholds: dict[str, float]) -> Column:
    """Whether a fused probability (null: 0) reaches the bar of its type; a type without one needs 1."""
    table = F.create_map(*(F.lit(x) for kv in thresholds.items() for x in kv)) if thresholds else F.create_map().cast("map<string,double>")
    return F.coalesce(probability, F.lit(0.0)) >= F.coalesce(F.try_element_at(table, entity_type), F.lit(1.0))


def percentiles(rows: DataFrame, value: str, shares: dict[str, float], by: list[str]) -> DataFrame:
    """For each group, the value at index floor(share * (n - 1)) of its sorted values.

    Equal values are counted first; the distinct ones are ranked inside cells of a group (as range-partitioned tasks hold
    them), and cells by the sizes of those before, so no group is ordered in one task or held in one array."""
    from pyspark.sql import Window

    counts = rows.groupBy(*by, value).agg(F.count("*").alias("c"))
    placed = counts.repartitionByRange(*by, value).withColumn("__cell", F.spark_partition_id())
    sizes = placed.groupBy(*by, "__cell").agg(F.sum("c").alias("s"), F.min(value).alias("low"))
    over = Window.partitionBy(*by)
    starts = sizes.select(*by, "__cell", F.coalesce(F.sum("s").over(over.orderBy("low").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("s").over(over).alias("n"))
    inside = F.sum("c").over(Window.partitionBy(*by, "__cell").orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    upto = placed.withColumn("last", inside).join(starts, [*by, "__cell"]).withColumn("end", F.col("before") + F.col("last"))
    at = lambda q: F.floor(F.lit(q) * (F.col("n") - 1))
    return upto.groupBy(*by).agg(*(F.max(F.when((F.col("end") > at(q)) & (F.col("end") - F.col("c") <= at(q)), F.col(value))).alias(n) for n, q in shares.items()))


def apply(rows: DataFrame, models: DataFrame) -> DataFrame:
    """Rows (source, entity_type, logit) with ``p``, by their fitted model (a, b: Platt; x, y: isotonic steps;
    temperature). A row whose source and type have no model stops the query."""
    m = models.select("source", "entity_type", *(F.col(c) if c in models.columns else F.lit(None).cast(k).alias(c) for c, k in (("a", "double"), ("b", "double"), ("temperature", "double"), ("x", "array<double>"), ("y", "array<double>"))), F.lit(True).alias("__known"))
    p = (
        F.when(F.col("__known").isNull(), F.raise_error(F.concat_ws(" ", F.lit("no calibration for"), "source", "entity_type")).cast("double"))
        .when(F.col("temperature").isNotNull(), sigmoid(F.col("logit") / F.col("temperature"))).when(F.col("a").isNotNull(), sigmoid(F.col("a") * F.col("logit") + F.col("b")))
        .otherwise(step_value(F.col("logit"), F.col("x"), F.col("y")))
    )
    return rows.join(m, ["source", "entity_type"], "left").withColumn("p", p).drop("a", "b", "temperature", "x", "y", "__known")
