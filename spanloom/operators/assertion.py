"""Assertions of entities: scope decisions applied, rules and models weighed, labels included, masked or withheld."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import logit, sigmoid

#: The labels, their bars, and types that are never asserted.
LABELS = ("isNegated", "isFamily", "isHistorical")
THRESHOLDS = {"isNegated": 0.90, "isHistorical": 0.90, "isFamily": 0.95}
LAB_TYPES = ("TÊN_XÉT_NGHIỆM", "KẾT_QUẢ_XÉT_NGHIỆM")


def apply_decisions(mentions: DataFrame, decisions: DataFrame, cap: float = 0.9, masked: tuple[str, ...] = LAB_TYPES, id_col: str = "id") -> DataFrame:
    """Mentions (id, type, ...) with ``probabilities`` (a value for each label) and ``masked``: of the decisions (id,
    label, score, applies) that apply, the largest score up to ``cap``; 0 without one, and for masked types."""
    top = decisions.where("applies").groupBy(id_col, "label").agg(F.max(F.least("score", F.lit(cap))).alias("p"))
    maps = top.groupBy(id_col).agg(F.map_from_entries(F.collect_list(F.struct("label", "p"))).alias("found"))
    shut = F.col("type").isin(*masked)
    value = lambda n: F.when(shut, 0.0).otherwise(F.coalesce(F.try_element_at("found", F.lit(n)), F.lit(0.0)))
    whole = F.create_map(*(x for n in LABELS for x in (F.lit(n), value(n))))
    return mentions.join(maps, id_col, "left").withColumn("probabilities", whole).withColumn("masked", shut).drop("found")


def decide(
    rows: DataFrame, rule_weight: float = 0.5, temperatures: Mapping[str, float] = {}, biases: Mapping[str, float] = {}, thresholds: Mapping[str, float] = THRESHOLDS,
    least_evidence: float = 0.1, masks: Mapping[str, tuple[str, ...]] = {},
) -> DataFrame:
    """Rows (type, logits map, rules map) with ``decisions`` (label, probability, included, reason), the included
    ``assertions`` and ``abstained``.

    A label's logit is the model's (0 where it is missing), mixed with that of its rule if there is one, scaled and
    shifted. The evidence of a row is the largest rule probability or twice what a probability exceeds 0.5 by; without
    enough of it no label is included. ``masks``: labels that a type never takes."""

    def probability(n: str) -> Column:
        model, rule = F.coalesce(F.try_element_at("logits", F.lit(n)), F.lit(0.0)), F.try_element_at("rules", F.lit(n))
        mixed = F.when(rule.isNull(), model).otherwise(rule_weight * logit(rule) + (1 - rule_weight) * model)
        return sigmoid(mixed / temperatures.get(n, 1.0) + biases.get(n, 0.0))

    p = {n: F.col(f"__p.{n}") for n in LABELS}
    rules = F.coalesce(F.array_max(F.map_values(F.coalesce("rules", F.create_map().cast("map<string,double>")))), F.lit(0.0))
    evidence = F.greatest(rules, F.lit(0.0), *((p[n] - 0.5) * 2 for n in LABELS))

    def decision(n: str) -> Column:
        shut = F.col("type").isin(*[t for t, labels in masks.items() if n in labels])
        reason = F.when(shut, "hard_mask:type").when(F.col("__e") < least_evidence, "abstain:insufficient_evidence").when(p[n] >= thresholds[n], "included:threshold").otherwise("below_threshold")
        return F.struct(F.lit(n).alias("label"), p[n].alias("probability"), (reason == "included:threshold").alias("included"), reason.alias("reason"))

    out = rows.withColumn("__p", F.struct(*(probability(n).alias(n) for n in LABELS))).withColumn("__e", evidence)
    out = out.withColumn("decisions", F.array(*map(decision, LABELS))).withColumn("assertions", F.transform(F.filter("decisions", lambda d: d["included"]), lambda d: d["label"]))
    return out.withColumn("abstained", (F.size("assertions") == 0) & (F.col("__e") < least_evidence)).drop("__p", "__e")


def empty_gold_risk(rows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Of rows (gold, predicted arrays) without gold labels, how many have predicted ones, and their share."""
    empty = F.size(F.coalesce("gold", F.array().cast("array<string>"))) == 0
    wrong = empty & (F.size(F.coalesce("predicted", F.array().cast("array<string>"))) > 0)
    g = rows.groupBy(*by).agg(F.count_if(empty).alias("empty_gold"), F.count_if(wrong).alias("false_positives"))
    return g.withColumn("rate", F.when(F.col("empty_gold") == 0, 0.0).otherwise(F.round(F.col("false_positives") / F.greatest("empty_gold", F.lit(1)), 6)))
