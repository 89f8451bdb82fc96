"""Calibration and fusion queries on labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import sigmoid
from ..operators import calibrate
from .registry import query, table

_POINTS = "p AS (SELECT d.doc_id, d.lang, (d.n_chars - 1500) / 1000.0 AS logit, l.quality AS label, l.toxic FROM documents d JOIN labels l ON l.doc_id = d.doc_id)"


def _points(spark, sf_dir) -> DataFrame:
    d, la = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return d.join(la, "doc_id").select("doc_id", "lang", ((F.col("n_chars") - 1500) / 1000.0).alias("logit"), F.col("quality").alias("label"), "toxic")


@query(f"""WITH {_POINTS}, g AS (SELECT unnest(range(1, 101)) / 10.0 AS t),
s AS (SELECT lang, t, greatest(least(1 / (1 + exp(-logit / t)), 1 - 1e-12), 1e-12) AS q, label FROM p, g),
n AS (SELECT lang, t, round(avg(-(label * ln(q) + (1 - label) * ln(1 - q))), 6) AS nll FROM s GROUP BY lang, t),
b AS (SELECT lang, min(nll) AS nll FROM n GROUP BY lang) SELECT lang, nll FROM b""")
def temperature_fit(spark, sf_dir) -> DataFrame:
    """The least mean log loss over the grid, by language."""
    return calibrate.temperature_grid(_points(spark, sf_dir), ["lang"]).select("lang", F.round("nll", 6).alias("nll"))


@query(f"""WITH {_POINTS}, s AS (SELECT 1 / (1 + exp(-logit)) AS q, label FROM p), b AS (SELECT least(CAST(floor(q * 10) AS INT), 9) AS bin, count(*) AS n, avg(q) AS mp, avg(label) AS sh FROM s GROUP BY 1)
SELECT CAST(r.bin AS INT) AS bin, coalesce(n, 0) AS n, round(mp, 6) AS mean_p, round(sh, 6) AS share, round(coalesce(n * 1.0 / (SELECT count(*) FROM s) * abs(mp - sh), 0), 6) AS gap FROM (SELECT unnest(range(10)) AS bin) r LEFT JOIN b ON b.bin = r.bin""")
def reliability_ece(spark, sf_dir) -> DataFrame:
    """A28."""
    return calibrate.reliability(_points(spark, sf_dir).select(sigmoid(F.col("logit")).alias("p"), "label"))


@query(f"""WITH {_POINTS}, s AS (SELECT doc_id, CASE WHEN lang = 'en' THEN least(greatest(logit, 0), 1) END AS a, CASE WHEN toxic = 0 THEN 0.8 END AS b FROM p),
f AS (SELECT doc_id, CASE WHEN a IS NULL AND b IS NULL THEN NULL ELSE (0.7 * coalesce(a, 0) + 0.3 * coalesce(b, 0)) / (CASE WHEN a IS NULL THEN 0 ELSE 0.7 END + CASE WHEN b IS NULL THEN 0 ELSE 0.3 END) END AS v FROM s)
SELECT doc_id, round(v, 6) AS fused, coalesce(v >= 0.5, false) AS accepted FROM f""")
def source_fusion(spark, sf_dir) -> DataFrame:
    """Missing sources are ignored."""
    p = _points(spark, sf_dir)
    a = F.when(F.col("lang") == "en", F.least(F.greatest("logit", F.lit(0.0)), F.lit(1.0)))
    b = F.when(F.col("toxic") == 0, 0.8)
    v = calibrate.fuse_sources({"a": a, "b": b}, {"a": 0.7, "b": 0.3})
    return p.select("doc_id", F.round(v, 6).alias("fused"), F.coalesce(v >= 0.5, F.lit(False)).alias("accepted"))


@query(f"WITH {_POINTS} SELECT lang, CAST(sum((label = 0)::INT) AS BIGINT) AS empty_gold, CAST(sum((label = 0 AND logit >= 0)::INT) AS BIGINT) AS false_positives, CASE WHEN sum((label = 0)::INT) = 0 THEN 0.0 ELSE round(sum((label = 0 AND logit >= 0)::INT) * 1.0 / sum((label = 0)::INT), 6) END AS rate FROM p GROUP BY lang")
def empty_gold_risk(spark, sf_dir) -> DataFrame:
    """How often something is predicted where nothing is expected."""
    from ..operators.assertion import empty_gold_risk as risk

    said = lambda c: F.when(c, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>"))
    return risk(_points(spark, sf_dir).select("lang", said(F.col("label") == 1).alias("gold"), said(F.col("logit") >= 0).alias("predicted")), ("lang",))


@query(f"""WITH {_POINTS}, d AS (SELECT lang, logit, row_number() OVER (PARTITION BY lang ORDER BY logit, doc_id) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM p)
SELECT lang, max(CASE WHEN i = CAST(floor(0.05 * (n - 1)) AS BIGINT) THEN logit END) AS q05, max(CASE WHEN i = CAST(floor(0.95 * (n - 1)) AS BIGINT) THEN logit END) AS q95 FROM d GROUP BY lang""")
def percentile_by_index(spark, sf_dir) -> DataFrame:
    """The value at floor(q * (n - 1)) of the sorted draws, from counts of distinct values."""
    return calibrate.percentiles(_points(spark, sf_dir), "logit", {"q05": 0.05, "q95": 0.95}, ["lang"])


@query(f"""WITH {_POINTS}, q AS (SELECT doc_id, lang, greatest(least(1 / (1 + exp(-logit)), 1 - 1e-6), 1e-6) AS model, CASE WHEN toxic = 1 THEN 0.9 ELSE 0.4 END AS rule FROM p),
m AS (SELECT lang, 1 / (1 + exp(-((0.6 * ln(rule / (1 - rule)) + 0.4 * ln(model / (1 - model))) / 1.5 + 0.1))) AS v FROM q)
SELECT lang, count(*) AS n, round(avg(v), 6) AS mean_p, CAST(sum((v >= 0.5)::INT) AS BIGINT) AS accepted FROM m GROUP BY lang""")
def assertion_decisions(spark, sf_dir) -> DataFrame:
    """Rule and model mixed as logits, with temperature and bias."""
    from ..operators.decode import assertion_mix

    p = _points(spark, sf_dir)
    v = assertion_mix(F.when(F.col("toxic") == 1, 0.9).otherwise(0.4), sigmoid(F.col("logit")), 0.6, 1.5, 0.1)
    return p.withColumn("v", v).groupBy("lang").agg(F.count("*").alias("n"), F.round(F.avg("v"), 6).alias("mean_p"), F.count_if(F.col("v") >= 0.5).alias("accepted"))
