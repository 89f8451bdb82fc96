"""Evaluation of annotated samples by split: structure, realism, privacy, a utility score, gates and a recommendation.

Samples have the columns split, text and entities (array of text, type, start, end, assertions). Everything is a grouped
aggregate of one pass over the samples, but for the distinct tokens, which are counted by a second grouping.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: Types and assertions that a split should have.
TYPES = ("TRIỆU_CHỨNG", "TÊN_XÉT_NGHIỆM", "KẾT_QUẢ_XÉT_NGHIỆM", "CHẨN_ĐOÁN", "THUỐC")
ASSERTIONS = ("isNegated", "isFamily", "isHistorical")
#: Abbreviations that are counted.
ABBREVIATIONS = ("BN", "NV", "TS", "CD", "KQXN", "HA", "HR", "RR", "SpO2")
SPLITS = ("synthetic_clean", "synthetic_hard", "human_reviewed")


def _share(a: Column, b: Column) -> Column:
    return F.when(b == 0, 0.0).otherwise(a / F.greatest(b, F.lit(1)))


def _valid(text: Column, e: Column) -> Column:
    inside = (e["start"] >= 0) & (e["start"] < e["end"]) & (e["end"] <= F.length(text))
    return F.coalesce(inside & (F.substring(text, (e["start"] + 1).cast("int"), (e["end"] - e["start"]).cast("int")) == e["text"]), F.lit(False))


def structural(samples: DataFrame, types: tuple[str, ...] = TYPES, assertions: tuple[str, ...] = ASSERTIONS) -> DataFrame:
    """Counts of samples, entities, bad positions, repeated spans, types and assertions of each split."""
    e, text = F.coalesce("entities", F.array().cast(samples.schema["entities"].dataType)), F.coalesce("text", F.lit(""))
    spans = F.transform(F.filter("e", lambda x: x["start"].isNotNull() & x["end"].isNotNull()), lambda x: F.struct(x["start"], x["end"], F.coalesce(x["type"], F.lit(""))))
    labels = F.flatten(F.transform("e", lambda x: F.coalesce(x["assertions"], F.array().cast("array<string>"))))
    rows = samples.select("split", text.alias("text"), e.alias("e")).select(
        "split", F.size("e").alias("n"), F.size(F.filter("e", lambda x: ~_valid(F.col("text"), x))).alias("bad"), (F.size(spans) - F.size(F.array_distinct(spans))).alias("again"),
        F.transform("e", lambda x: x["type"]).alias("types"), labels.alias("labels"),
    )
    many = lambda c, v: F.sum(F.size(F.filter(c, lambda x: x == v)))
    g = rows.groupBy("split").agg(
        F.count("*").alias("total_samples"), F.count_if(F.col("n") == 0).alias("empty_entity_samples"), F.sum("n").alias("total_entities"),
        F.sum("bad").alias("bad_position_count"), F.sum("again").alias("duplicate_span_count"),
        F.create_map(*(x for t in types for x in (F.lit(t), many("types", t)))).alias("types"), F.create_map(*(x for a in assertions for x in (F.lit(a), many("labels", a)))).alias("assertions"),
    )
    none = lambda m: F.array_sort(F.map_keys(F.map_filter(m, lambda _, n: n == 0)))
    return g.select(
        "*", _share(F.col("total_entities"), F.col("total_samples")).alias("avg_entities"), _share(F.col("bad_position_count"), F.col("total_entities")).alias("bad_position_rate"),
        none("types").alias("missing_types"), none("assertions").alias("missing_assertions"),
    )


def realism(samples: DataFrame, abbreviations: tuple[str, ...] = ABBREVIATIONS) -> DataFrame:
    """Mean length, share of distinct tokens, of repeated 2- and 3-grams, of abbreviations and of punctuation."""
    text = F.coalesce("text", F.lit(""))
    rows = samples.select("split", text.alias("text"), T.tokens(text).alias("tk")).withColumn("low", F.transform("tk", F.lower))
    grams = [T.ngrams(F.col("low"), n) for n in (2, 3)]
    g = rows.select(
        "split", F.length("text").alias("chars"), F.size("tk").alias("n"), F.size(F.filter("tk", lambda t: t.isin(*abbreviations))).alias("short"), F.regexp_count("text", F.lit(T.PUNCTUATION)).alias("signs"),
        sum((F.size(x) for x in grams), F.lit(0)).alias("grams"), sum((F.size(F.array_distinct(x)) for x in grams), F.lit(0)).alias("different"),
    ).groupBy("split").agg(*(F.sum(c).alias(c) for c in ("chars", "n", "short", "signs", "grams", "different")), F.avg("chars").alias("avg_text_length"))
    words = rows.select("split", F.explode("low").alias("t")).groupBy("split").agg(F.count_distinct("t").alias("words"))
    return g.join(words, "split", "left").select(
        "split", "avg_text_length", _share(F.coalesce("words", F.lit(0)), F.col("n")).alias("lexical_diversity"), _share(F.col("grams") - F.col("different"), F.col("grams")).alias("repetition_rate"),
        _share(F.col("short"), F.col("n")).alias("abbreviation_rate"), _share(F.col("signs"), F.col("chars")).alias("punctuation_density"),
    )


def privacy(samples: DataFrame, by: str = "split") -> DataFrame:
    """Five personal-data patterns and their total."""
    counts = {n: F.coalesce(F.sum(F.regexp_count("text", F.lit(p))), F.lit(0)) for n, p in T.WARNINGS.items()}
    g = samples.groupBy(by).agg(*(c.alias(f"{n}_count") for n, c in counts.items()))
    return g.withColumn("privacy_warning_count", sum((F.col(f"{n}_count") for n in counts), F.lit(0).cast("long")))


def evaluate_splits(samples: DataFrame, abbreviations: tuple[str, ...] = ABBREVIATIONS, types: tuple[str, ...] = TYPES, assertions: tuple[str, ...] = ASSERTIONS, splits: tuple[str, ...] = SPLITS) -> DataFrame:
    """A row for each of ``splits``, present or not: all measures, the utility score with its parts, whether the
    split passes its gate, and warnings."""
    names = samples.sparkSession.createDataFrame([(s,) for s in splits], "split string")
    r = names.join(structural(samples, types, assertions), "split", "left").join(realism(samples, abbreviations), "split", "left").join(privacy(samples), "split", "left")
    kinds = {f.name: f.dataType.typeName() for f in r.schema.fields}
    r = r.select(*(F.coalesce(n, F.lit(0).cast(k)).alias(n) if k in ("long", "integer", "double") else F.col(n) for n, k in kinds.items()))
    r = r.withColumn("missing_types", F.coalesce("missing_types", F.array(*map(F.lit, sorted(types))))).withColumn("missing_assertions", F.coalesce("missing_assertions", F.array(*map(F.lit, sorted(assertions)))))
    n, none = F.greatest("total_samples", F.lit(1)), F.col("total_samples") == 0
    score = F.greatest(F.lit(0.0), 1 - F.col("bad_position_rate") - F.least(F.lit(0.5), F.col("empty_entity_samples") / n))
    r = r.withColumn("structural_score", F.when(none, 0.5).otherwise(score)).withColumn("realism_penalty", F.least(F.lit(0.4), "repetition_rate")).withColumn("privacy_penalty", F.least(F.lit(0.5), F.col("privacy_warning_count") / n))
    total = F.col("structural_score") - F.col("realism_penalty") - F.col("privacy_penalty")
    r = r.withColumn("utility", F.when(none, 0.5).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total))))
    clean, hard, human = (F.col("split") == s for s in splits)
    bad, bare = clean & (F.col("bad_position_rate") > 0), hard & (F.col("avg_entities") == 0)
    listed = lambda c, says: F.when(F.size(c) > 0, F.concat(F.lit(says), F.array_join(c, ", ")))
    warnings = F.array_compact(
        F.array(
            F.when(bad, "bad positions in the clean split"), F.when(bare, "no entities in the hard split"), F.when(hard & (F.col("utility") < 0.3), "low utility of the hard split"),
            F.when(human & none, "no reviewed split"), listed("missing_types", "missing types: "), listed("missing_assertions", "missing assertions: "),
        )
    )
    return r.withColumn("passed", ~(bad | bare)).withColumn("warnings", warnings)


def recommendation(report: DataFrame, splits: tuple[str, ...] = SPLITS) -> DataFrame:
    """One row from the rows of evaluate_splits: how the hard split differs from the clean one, what blocks training,
    what is to be looked at, and whether to train."""
    keep = ("total_samples", "avg_entities", "bad_position_rate", "empty_entity_samples", "privacy_warning_count", "total_entities")
    labels = F.aggregate(F.map_values(F.coalesce("assertions", F.create_map().cast("map<string,bigint>"))), F.lit(0).cast("long"), lambda a, x: a + x)
    rate = (labels / F.greatest("total_entities", F.lit(1))).alias("assertion_rate")
    row = report.groupBy().pivot("split", list(splits)).agg(F.first(F.struct(*keep, rate)))
    c, h, u = (F.col(s) for s in splits)
    sparse = (h["total_samples"] > 0) & (h["avg_entities"] > 0) & (h["avg_entities"] < 0.5 * F.greatest(F.lit(1e-8), c["avg_entities"]))
    blocking = F.array_compact(
        F.array(
            F.when(c["total_samples"] == 0, "clean_missing"), F.when(c["bad_position_rate"] > 0, "clean_bad_positions"), F.when(c["empty_entity_samples"] > 0, "clean_empty_samples"),
            F.when((h["total_samples"] > 0) & (h["avg_entities"] == 0), "hard_without_entities"),
        )
    )
    warnings = F.array_compact(
        F.array(
            F.when(sparse, "hard_sparse"), F.when(h["bad_position_rate"] > c["bad_position_rate"], "hard_worse_spans"), F.when(u["total_samples"] == 0, "reviewed_missing"),
            F.when(u["privacy_warning_count"] > 0, "reviewed_privacy"),
        )
    )
    out = row.select((c["avg_entities"] - h["avg_entities"]).alias("entity_drop"), (h["assertion_rate"] - c["assertion_rate"]).alias("assertion_shift"), blocking.alias("blocking"), warnings.alias("warnings"))
    return out.withColumn("ready", F.size("blocking") == 0)
