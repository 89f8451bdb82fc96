"""Candidate fusion, set selection and their metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merge_candidates(rows: DataFrame) -> DataFrame:
    """(request_id, concept_id, scores map, evidence): the largest score a channel, evidence united."""
    per = rows.groupBy("request_id", "concept_id", "channel").agg(F.max("score").alias("score"), F.collect_set("evidence").alias("evidence"))
    return per.groupBy("request_id", "concept_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("channel", "score")))).alias("scores"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("evidence")))).alias("evidence")
    )


def fused(scores: Column, weights: dict[str, float]) -> Column:
    """The weighted sum of channel scores, clamped to [0, 1]."""
    total = sum((w * F.coalesce(F.try_element_at(scores, F.lit(c)), F.lit(0.0)) for c, w in sorted(weights.items())), F.lit(0.0))
    return F.greatest(F.least(total, F.lit(1.0)), F.lit(0.0))


def abstain(rows: DataFrame, least: float) -> DataFrame:
    """Requests whose best fused score is below ``least`` get no candidates."""
    return rows.withColumn("best", F.max("fused").over(Window.partitionBy("request_id"))).where(F.col("best") >= least).drop("best")


def expected_jaccard_set(rows: DataFrame) -> DataFrame:
    """Of candidates by falling probability, the prefix with the largest expected Jaccard index
    hits / (total + length - hits), over all candidates of a request; the earliest of equal ones."""
    order = Window.partitionBy("request_id").orderBy(F.desc("p"), "concept_id")
    ranked = rows.withColumn("k", F.row_number().over(order))
    run = order.rowsBetween(Window.unboundedPreceding, 0)
    all_ = Window.partitionBy("request_id")
    u = ranked.withColumn("hits", F.sum("p").over(run)).withColumn("total", F.sum("p").over(all_))
    u = u.withColumn("value", F.col("hits") / (F.col("total") + F.col("k") - F.col("hits")))
    # Nothing probable, nothing chosen.
    best = u.where("value > 0").groupBy("request_id").agg(F.max(F.struct("value", (-F.col("k")).alias("nk"))).alias("b"))
    return u.join(best, "request_id").where(F.col("k") <= -F.col("b.nk")).select("request_id", "concept_id", "k", F.col("b.value").alias("expected_jaccard"))


def ranking_metrics(ranked: DataFrame, ks: tuple[int, ...] = (1, 2, 5)) -> DataFrame:
    """From (query_id, rank, hit): first-hit recall at k and mean reciprocal rank, one row."""
    first = ranked.groupBy("query_id").agg(F.min(F.when(F.col("hit"), F.col("rank"))).alias("first"))
    recalls = [F.round(F.avg(F.coalesce((F.col("first") <= k).cast("double"), F.lit(0.0))), 6).alias(f"recall_{k}") for k in ks]
    return first.agg(F.count("*").alias("n"), *recalls, F.round(F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))), 6).alias("mrr"))


#: What an ontology adds to a candidate's score, or takes from it.
ADJUSTMENTS = {"type": 0.05, "hierarchy": 0.1, "match": 0.1, "mismatch": 0.1}
#: A request is simple, and left alone by the gate, up to these.
GATE = {"candidates": 3, "margin": 0.2, "aliases": 1, "uncertainty": 0.1}


def ontology_rerank(rows: DataFrame, requests: DataFrame, ontology: DataFrame, mode: str = "gated", adjust: dict[str, float] = ADJUSTMENTS, gate: dict[str, float] = GATE, hard_ingredient: bool = True) -> DataFrame:
    """Candidates (request_id, terminology, concept_id, fused) with ``reranked``, ``rank`` and ``reason``.

    requests: request_id, entity_type, exact_match, alias_ambiguity, hierarchy_conflict, uncertainty, kind, and what the
    mention says: mention_ingredient, mention_strength, mention_dose_form (arrays); ontology: terminology, concept_id, ingredient, strength,
    dose_form. Modes: off, always_on, gated. The gate leaves a unique exact match alone, and a request with few candidates
    and aliases, a clear lead, no conflict, little uncertainty and no medication. Otherwise candidates of another
    terminology than the type's go; a diagnosis or drug of the right one gains; a conflict costs; of a medication a
    matching feature gains, and another ingredient goes (or costs). A candidate outside of the ontology stops the query."""
    every = Window.partitionBy("request_id")
    known = snapshot_lookup(rows, ontology).join(requests, "request_id")
    n, first = F.count("*").over(every), F.max("fused").over(every)
    second = F.max(F.when(F.col("__k") == 2, F.col("fused"))).over(every)
    r = known.withColumn("__k", F.row_number().over(every.orderBy(F.desc("fused"), "terminology", "concept_id")))
    margin = F.coalesce(first - second, F.lit(1.0))
    simple = (n <= gate["candidates"]) & (F.col("alias_ambiguity") <= gate["aliases"]) & (margin >= gate["margin"]) & ~F.col("hierarchy_conflict") & (F.col("uncertainty") <= gate["uncertainty"]) & ~F.coalesce(F.col("kind") == "medication", F.lit(False))
    left_alone = F.when(F.lit(mode == "off"), "feature_disabled").when(F.lit(mode == "gated") & F.col("exact_match") & (n == 1), "unique_exact_match").when(F.lit(mode == "gated") & simple, "high_margin_simple_case")
    kind, drug = F.col("entity_type"), F.col("entity_type") == "THUỐC"
    fits = F.when(kind == "CHẨN_ĐOÁN", F.col("terminology").startswith("ICD")).when(drug, F.col("terminology") == "RxNorm").otherwise(True)
    said = lambda c: F.size(F.coalesce(F.col(f"m.{c}"), F.array().cast(_KEYS))) > 0
    same = lambda c: said(c) & F.coalesce(F.array_contains(f"m.{c}", F.col(f"c.{c}")), F.lit(False))
    features = ("ingredient", "strength", "dose_form")
    r = r.withColumn("reason", left_alone)
    wrong = said("ingredient") & ~same("ingredient")
    feature = F.when(wrong, -adjust["mismatch"]).when(same("ingredient") | same("strength") | same("dose_form"), adjust["match"]).otherwise(0.0)
    r = r.select("*", F.struct(*(F.col(f"mention_{c}").alias(c) for c in features)).alias("m"), F.struct(*(F.col(c) for c in features)).alias("c"))
    delta = adjust["type"] - F.when(F.col("hierarchy_conflict"), adjust["hierarchy"]).otherwise(0.0) + F.when(drug, feature).otherwise(0.0)
    gone = F.col("reason").isNull() & (~fits | (drug & wrong & F.lit(hard_ingredient)))
    r = r.withColumn("reranked", F.when(F.col("reason").isNull(), F.col("fused") + delta).otherwise(F.col("fused"))).where(~gone)
    order = every.orderBy(F.desc("reranked"), "terminology", "concept_id")
    reason = F.coalesce("reason", F.lit("always_on" if mode == "always_on" else "gated_on"))
    return r.withColumn("rank", F.row_number().over(order)).select(*rows.columns, "reranked", "rank", reason.alias("reason"))


def recall_with_misses(ranked: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """(query_id, hits, missed): gold ids found among the first k, and the others."""
    top = ranked.where(F.col("rank") <= k).select("query_id", "concept_id").distinct().withColumn("hit", F.lit(True))
    g = gold.select("query_id", "concept_id").distinct().join(top, ["query_id", "concept_id"], "left")
    missed = F.array_sort(F.collect_list(F.when(F.col("hit").isNull(), F.col("concept_id"))))
    return g.groupBy("query_id").agg(F.count("hit").alias("hits"), missed.alias("missed"))


_KEYS = "array<string>"


def _distinct_codes(c: Column) -> Column:
    return F.array_distinct(F.coalesce(c, F.array().cast(_KEYS)))


def variant_metrics(outputs: DataFrame, gold: DataFrame, ks: tuple[int, ...] = (1, 5, 10, 20, 50)) -> DataFrame:
    """Of outputs (variant, trace_id, ranked and final arrays of codes) on gold (trace_id, entity_type, terminology,
    codes): metrics by variant, entity type and terminology, by variant and either of these, and by variant.

    An entity is covered if all its gold codes are ranked (at k: among the first k). top1 counts entities with gold codes
    whose first ranked code is one; an empty final list abstains, rightly where there is no gold code. Both tables grow
    with the entities, and Spark guesses lists of codes too small: they are merge-joined, never broadcast."""
    rows = outputs.join(gold.hint("merge"), "trace_id").select(
        "variant", "entity_type", "terminology", _distinct_codes(F.col("ranked")).alias("r"), _distinct_codes(F.col("final")).alias("f"), _distinct_codes(F.col("codes")).alias("g")
    )
    whole = lambda c: F.size(F.array_except("g", c)) == 0
    first = F.array_min(F.coalesce(F.filter(F.transform("r", lambda x, i: F.when(F.array_contains("g", x), i + 1)), lambda i: i.isNotNull()), F.array().cast("array<int>")))
    both, either = F.size(F.array_intersect("f", "g")), F.size(F.array_union("f", "g"))
    v = rows.select(
        "variant", "entity_type", "terminology", whole(F.col("r")).alias("covered"), *(whole(F.slice("r", 1, k)).alias(f"in_{k}") for k in ks), first.alias("first"),
        F.when(F.size("g") > 0, F.coalesce(F.array_contains("g", F.try_element_at("r", F.lit(1))), F.lit(False))).alias("top1"),
        F.when(either == 0, 1.0).otherwise(both / F.greatest(either, F.lit(1))).alias("jaccard"), (F.size("f") == 0).alias("abstained"), (F.size("g") == 0).alias("nothing"),
    )
    mean = lambda c: F.round(F.coalesce(F.avg(c.cast("double")), F.lit(0.0)), 6)
    out = (
        F.count("*").alias("entities"), mean(F.col("covered")).alias("coverage"), *(mean(F.col(f"in_{k}")).alias(f"recall_{k}") for k in ks),
        mean(F.coalesce(1 / F.col("first"), F.lit(0.0))).alias("mrr"), mean(F.col("top1")).alias("top1"), mean(F.col("jaccard")).alias("jaccard"),
        mean(F.when(F.col("abstained"), F.col("nothing"))).alias("abstention_precision"), mean(F.col("abstained")).alias("abstention_coverage"),
    )
    return v.groupingSets([["variant", "entity_type", "terminology"], ["variant", "entity_type"], ["variant", "terminology"], ["variant"]], "variant", "entity_type", "terminology").agg(*out)


#: Kinds of linking errors; an entity may have several.
ERROR_BUCKETS = ("alias_missing", "retrieval_miss", "rerank_miss", "wrong_granularity", "structured_mismatch", "obsolete_concept", "ambiguous_gold")


def linking_errors(gold: DataFrame, fused: DataFrame, reranked: DataFrame) -> DataFrame:
    """(bucket, trace_id) for each kind of error of each entity.

    gold: trace_id, codes, granularity, alias_present; fused: trace_id, ranked (codes); reranked: trace_id, ranked (array
    of code, granularity, obsolete), final (codes), rejected (codes that structure ruled out). Merge-joined, as above."""
    r = reranked.select("trace_id", F.col("ranked").alias("again"), _distinct_codes(F.col("final")).alias("final"), _distinct_codes(F.col("rejected")).alias("rejected"))
    rows = gold.select("trace_id", _distinct_codes(F.col("codes")).alias("g"), "granularity", "alias_present").join(fused.select("trace_id", _distinct_codes(F.col("ranked")).alias("pool")).hint("merge"), "trace_id", "left").join(r.hint("merge"), "trace_id", "left")
    some, pooled = F.size("g") > 0, F.size(F.array_except("g", F.coalesce("pool", F.array().cast(_KEYS)))) == 0
    told = F.size(F.array_except("g", F.coalesce("final", F.array().cast(_KEYS)))) == 0
    tests = {
        "alias_missing": ~F.col("alias_present"), "retrieval_miss": some & ~pooled, "rerank_miss": some & pooled & ~told,
        "wrong_granularity": F.exists("again", lambda x: F.array_contains("g", x["code"]) & (x["granularity"] != F.col("granularity"))),
        "structured_mismatch": F.arrays_overlap("g", "rejected"), "obsolete_concept": F.exists("again", lambda x: x["obsolete"] & F.array_contains("final", x["code"])), "ambiguous_gold": F.size("g") > 1,
    }
    hits = F.array_compact(F.array(*(F.when(tests[n], n) for n in ERROR_BUCKETS)))
    return rows.select(F.explode(hits).alias("bucket"), "trace_id")


def linking_error_counts(errors: DataFrame) -> DataFrame:
    """(bucket, n, first_trace) of all seven buckets."""
    names = errors.sparkSession.createDataFrame([(b,) for b in ERROR_BUCKETS], "bucket string")
    n = errors.groupBy("bucket").agg(F.count("*").alias("n"), F.min("trace_id").alias("first_trace"))
    return names.join(n, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"), "first_trace")


def rerank_join(retrieved: DataFrame, scores: DataFrame) -> DataFrame:
    """Retrieved (request_id, concept_id, raw) with the reranker's scores (request_id, concept_id, score), ranked
    by score, raw score, id. A score for a request that was not made stops the query; candidates without one come last."""
    asked = retrieved.select("request_id").distinct().withColumn("asked", F.lit(True))
    known = scores.join(asked, "request_id", "left")
    sure = known.withColumn("score", F.when(F.col("asked").isNull(), F.raise_error(F.concat(F.lit("unknown request: "), F.col("request_id").cast("string"))).cast("double")).otherwise(F.col("score"))).drop("asked")
    order = Window.partitionBy("request_id").orderBy(F.col("score").desc_nulls_last(), F.desc("raw"), "concept_id")
    return retrieved.join(sure, ["request_id", "concept_id"], "full").where("raw is not null or raise_error('unknown candidate') is null").withColumn("rank", F.row_number().over(order))


def snapshot_lookup(candidates: DataFrame, ontology: DataFrame) -> DataFrame:
    """Candidates with their ontology rows; one that is not in the snapshot stops the query."""
    joined = candidates.join(ontology.withColumn("__in", F.lit(True)), ["terminology", "concept_id"], "left")
    return joined.withColumn("__in", F.when(F.col("__in").isNull(), F.raise_error(F.concat(F.lit("not in the snapshot: "), F.col("concept_id")))).otherwise(True)).where("__in").drop("__in")


def hard_negatives(catalog: DataFrame, gold: DataFrame) -> DataFrame:
    """(terminology, concept_id) of the catalog that are easily taken for a gold one of their terminology, and are
    none. In ICD tables: its parent, its children, concepts with its parent. In RxNorm tables: concepts that share an
    ingredient and differ in ingredients, strengths or forms. catalog: terminology, concept_id, parent_id, ingredients,
    strengths, forms (arrays, normalised); gold: terminology, concept_id.

    They meet in their common key, of which either side keeps distinct values, and only negatives leave the joins."""
    keys = ["terminology", "concept_id"]
    want = catalog.join(gold.select(*keys).distinct(), keys, "left_semi")
    other = catalog.join(gold.select(*keys).distinct(), keys, "left_anti")
    icd, rx = F.upper("terminology").startswith("ICD"), F.upper("terminology").startswith("RXNORM")
    wi, oi = want.where(icd), other.where(icd)
    children = oi.join(wi.select("terminology", F.col("concept_id").alias("parent_id")), ["terminology", "parent_id"], "left_semi")
    parents = oi.join(wi.select("terminology", F.col("parent_id").alias("concept_id")), keys, "left_semi")
    siblings = oi.join(wi.select("terminology", "parent_id").where("parent_id is not null"), ["terminology", "parent_id"], "left_semi")
    # Of an ingredient, the distinct combinations of gold concepts.
    parts = F.struct(*(F.array_sort(F.array_distinct(c)).alias(c) for c in ("ingredients", "strengths", "forms")))
    of = lambda df: df.where(rx).select(*keys, parts.alias("p")).select("*", F.explode("p.ingredients").alias("ingredient"))
    shapes = of(want).groupBy("terminology", "ingredient").agg(F.min("p").alias("lo"), F.max("p").alias("hi"))
    # One with another combination than its own: the least or the greatest differs.
    drugs = of(other).join(shapes, ["terminology", "ingredient"]).where((F.col("lo") != F.col("p")) | (F.col("hi") != F.col("p")))
    out = children.select(*keys)
    for part in (parents, siblings, drugs):
        out = out.unionByName(part.select(*keys))
    return out.distinct()


def ablation(cases: DataFrame, least_gain: float, latency_penalty: float = 0.0) -> DataFrame:
    """Of (mode, case_id, score, latency_ms) with modes off, always_on, gated_on: against off, each mode's gain, lost
    cases, added latency and net gain (less ``latency_penalty`` for each added millisecond), and whether to enable it: no
    case loses, the gain reaches ``least_gain``, and the net gain is positive."""
    off = cases.where("mode = 'off'").select("case_id", F.col("score").alias("base"), F.col("latency_ms").alias("base_ms"))
    d = cases.where("mode <> 'off'").join(off, "case_id").groupBy("mode").agg(
        F.avg(F.col("score") - F.col("base")).alias("gain"), F.count_if(F.col("score") < F.col("base")).alias("lost"), (F.avg("latency_ms") - F.avg("base_ms")).alias("added_ms")
    )
    net = F.col("gain") - latency_penalty * F.greatest("added_ms", F.lit(0.0))
    d = d.withColumn("net", net).withColumn("enable", (F.col("lost") == 0) & (F.col("gain") >= least_gain) & (F.col("net") > 0))
    return d.select("mode", *(F.round(c, 6).alias(c) for c in ("gain", "added_ms", "net")), "lost", "enable")


def candidate_oracle(gold: DataFrame, pool: DataFrame, chosen: DataFrame) -> DataFrame:
    """Of each request with candidates: numbers of gold, pooled, chosen and rightly chosen ones, recall of the gold
    set by the pool, Jaccard index and equality of gold and chosen set."""
    side = lambda df, n: df.select("request_id", "concept_id", F.lit(True).alias(n)).distinct()
    r = side(pool, "pool").join(side(gold, "gold"), ["request_id", "concept_id"], "full").join(side(chosen, "chosen"), ["request_id", "concept_id"], "full")
    g = r.groupBy("request_id").agg(
        F.count("gold").alias("n_gold"), F.count("pool").alias("n_pool"), F.count("chosen").alias("n_chosen"),
        F.count_if(F.col("gold") & F.col("chosen")).alias("hit"), F.count_if(F.col("gold") & F.col("pool")).alias("found"),
    )
    recall = F.when(F.col("n_gold") == 0, 1.0).otherwise(F.col("found") / F.greatest("n_gold", F.lit(1)))
    either = F.col("n_gold") + F.col("n_chosen") - F.col("hit")
    return g.select(
        "request_id", "n_gold", "n_pool", "n_chosen", "hit", F.round(recall, 6).alias("recall"), F.round(F.when(either == 0, 1.0).otherwise(F.col("hit") / F.greatest(either, F.lit(1))), 6).alias("jaccard"),
        ((F.col("hit") == F.col("n_gold")) & (F.col("hit") == F.col("n_chosen"))).alias("exact"),
    )


def alias_remap(mentions: DataFrame, aliases: DataFrame) -> DataFrame:
    """Of each sample (sample_id, alias) the number of mentions, those whose alias does not name exactly one code,
    and the codes of the others. A sample with a missing one is to be rejected whole."""
    unique = aliases.groupBy("alias").agg(F.count_distinct("code").alias("k"), F.min("code").alias("code")).where("k = 1").select("alias", "code")
    rows = mentions.join(unique, "alias", "left")
    return rows.groupBy("sample_id").agg(F.count("*").alias("n"), F.count_if(F.col("code").isNull()).alias("missing"), F.array_sort(F.collect_set("code")).alias("codes"))
