"""Curation of samples end to end, terminology preparation, submission checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .graph import components
from .similarity import jaccard_classes
from .split import hash_rank


#: Profiles whose samples are gold.
MODERN = ("repeated_mention", "abbreviation_or_typo", "mixed_language", "lab_name_result_pair")


def quality_score(profile: Column, asserted: Column) -> Column:
    """100, with 20 for a modern profile, 5 for assertions, 5 for a profile other than basic; null is basic."""
    named = F.coalesce(profile, F.lit("basic"))
    return 100 + F.when(named.isin(*MODERN), 20).otherwise(0) + F.when(asserted, 5).otherwise(0) + F.when(named != "basic", 5).otherwise(0)


def reject_exact(samples: DataFrame) -> DataFrame:
    """Samples (id, text, score) with text_key, copies, winner (largest score, then smallest id) and rejected."""
    keyed = samples.withColumn("text_key", F.sha2(F.encode(T.collapsed(F.col("text")), "utf-8"), 256))
    best = keyed.groupBy("text_key").agg(F.count("*").alias("copies"), F.min(F.struct((-F.col("score")).alias("s"), "id"))["id"].alias("winner"))
    return keyed.join(best, "text_key").withColumn("rejected", F.col("id") != F.col("winner"))


def curate(samples: DataFrame, hard: float = 0.72, soft: float = 0.62, share: float = 0.15) -> DataFrame:
    """Samples (id long, text, profile, asserted boolean, errors array) with ``score``, ``status``
    (validation_failed, exact_duplicate, hard_near_duplicate, gold_train, gold_validation or standard), ``winner`` and
    ``soft_pairs``.

    Samples with errors fall first, then exact copies, then all but the best of each component of hard pairs (largest
    score, then smallest id). What is left of a modern profile is gold, of which the first by text hash are for
    validation: ``share`` of them, halves rounded to even, one at least."""
    scored = samples.withColumn("score", quality_score(F.col("profile"), F.coalesce("asserted", F.lit(False))))
    ok = reject_exact(scored.where(F.size("errors") == 0))
    fresh = ok.where("not rejected")
    members, pairs = jaccard_classes(fresh.select("id", F.array_distinct(T.tokens(F.lower("text"))).alias("items")), soft)
    copies = members.where(F.col("id") != F.col("class")).select(F.col("class").alias("a"), F.col("id").alias("b"))
    comp = components(pairs.where(F.col("jaccard") >= hard).select("a", "b").unionByName(copies), fresh.select(F.col("id").alias("vertex")))
    placed = fresh.join(comp.withColumnRenamed("vertex", "id"), "id")
    best = placed.groupBy("component").agg(F.min(F.struct((-F.col("score")).alias("s"), "id"))["id"].alias("best"))
    # Pairs of classes stand for those of their members.
    size = members.groupBy("class").agg(F.count("*").alias("copies"))
    ends = pairs.where(F.col("jaccard") < hard).select(F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("class")), F.struct(F.col("b").alias("x"), F.col("a").alias("class")))).alias("e"))
    of_class = ends.select("e.x", "e.class").join(size, "class").groupBy("x").agg(F.sum("copies").alias("soft_pairs"))
    near = members.select("id", F.col("class").alias("x")).join(of_class, "x").select("id", "soft_pairs")
    kept = placed.join(best, "component").join(near, "id", "left")
    gold = kept.where((F.col("id") == F.col("best")) & F.col("profile").isin(*MODERN)).select("id", F.sha2(F.encode("text", "utf-8"), 256).alias("h"))
    first = F.col("rank") <= F.greatest(F.lit(1.0), F.bround(F.col("n") * share))
    split = hash_rank(gold, "h", "id").select("id", F.when(first, "gold_validation").otherwise("gold_train").alias("gold"))
    status = F.when(F.col("id") != F.col("best"), "hard_near_duplicate").otherwise(F.coalesce("gold", F.lit("standard")))
    decided = kept.join(split, "id", "left").select("id", "score", status.alias("status"), F.col("best").alias("winner"), F.coalesce("soft_pairs", F.lit(0)).alias("soft_pairs"))
    zero = F.lit(0).cast("long").alias("soft_pairs")
    copies = ok.where("rejected").select("id", "score", F.lit("exact_duplicate").alias("status"), "winner", zero)
    failed = scored.where(F.size("errors") > 0).select("id", "score", F.lit("validation_failed").alias("status"), F.lit(None).cast("long").alias("winner"), zero)
    return decided.unionByName(copies).unionByName(failed)


def curation_report(decided: DataFrame) -> DataFrame:
    """(name, n): input, gold, gold_train, gold_validation, standard, rejected, and each reason of rejection."""
    rejected = ("validation_failed", "exact_duplicate", "hard_near_duplicate")
    s = F.col("status")
    groups = {"input": F.lit(True), "gold": s.startswith("gold_"), "gold_train": s == "gold_train", "gold_validation": s == "gold_validation", "standard": s == "standard", "rejected": s.isin(*rejected)} | {f"rejected.{r}": s == r for r in rejected}
    row = decided.agg(*(F.count_if(c).alias(n) for n, c in groups.items()))
    return row.select(F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.col(f"`{n}`").alias("n")) for n in groups))).alias("x")).select("x.name", "x.n")


def prepare_terminology(concepts: DataFrame, aliases: DataFrame) -> dict[str, DataFrame]:
    """Active concepts once each, their aliases once each, and the report of aliases (counted before
    the rows are made distinct) with one or several targets. An identifier with several names is a conflict."""
    active = concepts.where("active")
    named = active.groupBy("system", "concept_id").agg(F.min("preferred_term").alias("preferred_term"), F.count_distinct("preferred_term").alias("names"))
    valid = aliases.join(named.select("system", "concept_id"), ["system", "concept_id"], "left_semi").withColumn("key", T.collapsed(F.col("alias")))
    report = valid.groupBy("system", "key").agg(F.count("*").alias("n_rows"), F.array_sort(F.collect_set("concept_id")).alias("targets"))
    report = report.withColumn("status", F.when(F.size("targets") > 1, "conflict").when(F.col("n_rows") > 1, "duplicate").otherwise("unique"))
    once = valid.groupBy("system", "concept_id", "alias", "alias_type").agg(F.min("row").alias("row"), F.min("key").alias("key"))
    return {"concepts": named.where("names = 1").drop("names"), "conflicts": named.where("names > 1"), "aliases": once, "report": report}


def submission_errors(files: DataFrame, documents: DataFrame, codes: DataFrame) -> DataFrame:
    """(document_id, error) of a submission: files (document_id, json), documents (document_id, text),
    codes (type, code). Names must match on both sides; each file is an array of objects with exactly five keys, whose
    spans hold, in order of start, end, type and text, with known codes, each once."""
    shape = "array<struct<text:string,type:string,position:array<int>,assertions:array<string>,candidates:array<string>>>"
    whole = files.withColumn("there", F.lit(True)).join(documents, "document_id", "full")
    parsed = whole.withColumn("e", F.from_json("json", shape)).withColumn("objects", F.from_json("json", "array<string>"))
    five = F.array(*map(F.lit, ("assertions", "candidates", "position", "text", "type")))
    ranked = F.transform("e", lambda x: F.struct(x["position"][0].alias("s"), x["position"][1].alias("t"), x["type"].alias("k"), x["text"].alias("x")))
    held = F.forall("e", lambda x: (F.size(x["position"]) == 2) & (F.substring("text", x["position"][0] + 1, x["position"][1] - x["position"][0]) == x["text"]))
    checks = F.array_compact(
        F.array(
            F.when(F.col("there").isNull(), "missing_file").when(F.col("text").isNull(), "unknown_document").when(F.col("e").isNull(), "not_an_array"),
            F.when(F.col("json").rlike(r"(?<![\w\"])(?:NaN|-?Infinity)(?![\w\"])"), "not_finite"),
            F.when(F.exists("objects", lambda o: F.array_sort(F.coalesce(F.json_object_keys(o), F.array().cast("array<string>"))) != five), "keys"),
            F.when(~F.coalesce(held, F.lit(True)), "span"),
            F.when(F.array_sort(ranked) != ranked, "order"),
            F.when(F.exists("e", lambda x: F.size(F.array_distinct(F.coalesce(x["candidates"], F.array().cast("array<string>")))) < F.size(F.coalesce(x["candidates"], F.array().cast("array<string>")))), "repeated_code"),
        )
    )
    direct = parsed.select("document_id", F.explode(checks).alias("error"))
    used = parsed.select("document_id", F.explode("e").alias("x")).select("document_id", F.col("x.type").alias("type"), F.explode("x.candidates").alias("code"))
    return direct.unionByName(used.join(codes, ["type", "code"], "left_anti").select("document_id", F.lit("unknown_code").alias("error")).distinct())


def fold_seed_means(runs: DataFrame) -> DataFrame:
    """Of runs (fold_id, seed, encoder, baseline) their number, mean scores and mean delta; a fold and seed that
    occurs twice stops the query, as does an empty fold."""
    once = runs.groupBy("fold_id", "seed").agg(F.count("*").alias("n"), F.first("encoder").alias("encoder"), F.first("baseline").alias("baseline"))
    bad = (F.col("n") > 1) | F.coalesce(F.col("fold_id").cast("string") == "", F.lit(True)) | F.col("seed").isNull()
    stop = F.raise_error(F.concat(F.lit("runs need a fold and a seed, each pair once: "), F.coalesce(F.col("fold_id").cast("string"), F.lit("")))).cast("boolean")
    g = once.where(F.when(bad, stop).otherwise(True)).agg(F.count("*").alias("run_count"), F.avg("encoder").alias("e"), F.avg("baseline").alias("b"))
    return g.select("run_count", F.round("e", 6).alias("mean_encoder"), F.round("b", 6).alias("mean_baseline"), F.round(F.col("e") - F.col("b"), 6).alias("mean_delta"))


def report(aligned: DataFrame, pred: DataFrame) -> DataFrame:
    """A row of totals: matched, missing and extra spans, documents with failures and mean latency.

    ``pred`` has a row a document: failure_reason, latency_ms."""
    a = aligned.agg(F.count_if(F.col("in_gold") & F.col("in_pred")).alias("matched"), F.count_if(~F.col("in_pred")).alias("missing"), F.count_if(~F.col("in_gold")).alias("extra"))
    p = pred.agg(F.count("*").alias("documents"), F.count("failure_reason").alias("failed"), F.round(F.avg("latency_ms"), 6).alias("mean_latency_ms"))
    return a.join(F.broadcast(p))
