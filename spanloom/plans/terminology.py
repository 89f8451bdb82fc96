"""Terminology tables, retrieval with eligibility, linking variants and errors, evaluation of splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import curate, linking, quality, retrieval, validate
from .registry import query, table
from .spans import _GOLD, _gold

#: Parts as concepts: a brand is a concept with a system, a part name is an alias; some rows are inactive or disagree.
_TERMS = """
co AS (SELECT 'S' || (p_size % 3) AS system, p_brand AS concept_id, CASE WHEN p_partkey % 40 = 0 THEN p_type ELSE 'term of ' || p_brand END AS preferred_term, p_size % 7 <> 0 AS active FROM part),
al AS (SELECT 'S' || (p_size % 3) AS system, p_brand AS concept_id, p_name AS alias, CASE WHEN p_size % 2 = 0 THEN 'name' ELSE 'synonym' END AS alias_type, p_partkey AS row FROM part),
ac AS (SELECT system, concept_id, min(preferred_term) AS preferred_term, count(DISTINCT preferred_term) AS names FROM co WHERE active GROUP BY system, concept_id),
va AS (SELECT al.*, lower(trim(alias)) AS key FROM al JOIN ac USING (system, concept_id))"""


def _terms(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    p = table(spark, sf_dir, "part")
    system = F.concat(F.lit("S"), (F.col("p_size") % 3).cast("string")).alias("system")
    term = F.when(F.col("p_partkey") % 40 == 0, F.col("p_type")).otherwise(F.concat(F.lit("term of "), "p_brand"))
    concepts = p.select(system, F.col("p_brand").alias("concept_id"), term.alias("preferred_term"), (F.col("p_size") % 7 != 0).alias("active"))
    aliases = p.select(system, F.col("p_brand").alias("concept_id"), F.col("p_name").alias("alias"), F.when(F.col("p_size") % 2 == 0, "name").otherwise("synonym").alias("alias_type"), F.col("p_partkey").alias("row"))
    return concepts, aliases


@query(f"""WITH {_TERMS} SELECT system, key, count(*) AS n_rows, count(DISTINCT concept_id) AS n_targets, min(concept_id) AS first_target,
 CASE WHEN count(DISTINCT concept_id) > 1 THEN 'conflict' WHEN count(*) > 1 THEN 'duplicate' ELSE 'unique' END AS status FROM va GROUP BY system, key""")
def alias_reports(spark, sf_dir) -> DataFrame:
    """Aliases of active concepts: one target twice is a duplicate, several targets are a conflict."""
    r = curate.prepare_terminology(*_terms(spark, sf_dir))["report"]
    return r.select("system", "key", "n_rows", F.size("targets").cast("long").alias("n_targets"), F.col("targets")[0].alias("first_target"), "status")


@query(f"WITH {_TERMS} SELECT system, concept_id, preferred_term, names > 1 AS conflict FROM ac")
def concept_dedup(spark, sf_dir) -> DataFrame:
    """Each active concept once; one with several names is a conflict."""
    t = curate.prepare_terminology(*_terms(spark, sf_dir))
    return t["concepts"].select("system", "concept_id", "preferred_term", F.lit(False).alias("conflict")).unionByName(t["conflicts"].select("system", "concept_id", "preferred_term", F.lit(True).alias("conflict")))


@query(f"""WITH {_TERMS}, o AS (SELECT system, concept_id, alias, alias_type, min(row) AS row, min(key) AS key FROM va GROUP BY system, concept_id, alias, alias_type)
SELECT *, row_number() OVER (PARTITION BY system ORDER BY concept_id, key, alias, row) AS place FROM o""")
def alias_dedup(spark, sf_dir) -> DataFrame:
    """Each alias of a concept once, in canonical order within its system."""
    a = curate.prepare_terminology(*_terms(spark, sf_dir))["aliases"]
    order = Window.partitionBy("system").orderBy("concept_id", "key", "alias", "row")
    return a.select("system", "concept_id", "alias", "alias_type", "row", "key").withColumn("place", F.row_number().over(order).cast("long"))


_CATALOG = """
ct AS (SELECT CASE WHEN p_size % 2 = 0 THEN 'ICD-10' ELSE 'RXNORM' END AS terminology, 'c' || p_partkey AS concept_id, CASE WHEN p_partkey % 9 <> 0 THEN 'c' || CAST(floor(p_partkey / 10) * 10 AS BIGINT) END AS parent_id,
 list_sort(list_distinct(string_split(p_name, ' '))) AS ingredients, [p_type] AS strengths, ['f' || (p_size % 4)] AS forms FROM part),
gd AS (SELECT * FROM ct WHERE CAST(substring(concept_id, 2) AS BIGINT) % 100 = 0)"""


def _catalog(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    p, key = table(spark, sf_dir, "part"), F.col("p_partkey")
    code = lambda n: F.concat(F.lit("c"), n.cast("long").cast("string"))
    c = p.select(
        F.when(F.col("p_size") % 2 == 0, "ICD-10").otherwise("RXNORM").alias("terminology"), code(key).alias("concept_id"), F.when(key % 9 != 0, code(F.floor(key / 10) * 10)).alias("parent_id"),
        F.array_sort(F.array_distinct(F.split("p_name", " "))).alias("ingredients"), F.array("p_type").alias("strengths"), F.array(F.concat(F.lit("f"), (F.col("p_size") % 4).cast("string"))).alias("forms"), key.alias("n"),
    )
    return c.drop("n"), c.where("n % 100 = 0").select("terminology", "concept_id")


@query(f"""WITH {_CATALOG} SELECT DISTINCT c.terminology, c.concept_id FROM ct c JOIN gd g ON g.terminology = c.terminology AND NOT EXISTS (SELECT 1 FROM gd x WHERE x.concept_id = c.concept_id)
 AND ((c.terminology = 'ICD-10' AND (c.parent_id = g.concept_id OR g.parent_id = c.concept_id OR c.parent_id = g.parent_id))
 OR (c.terminology = 'RXNORM' AND len(list_intersect(c.ingredients, g.ingredients)) > 0 AND (c.ingredients <> g.ingredients OR c.strengths <> g.strengths OR c.forms <> g.forms)))""")
def hard_negatives(spark, sf_dir) -> DataFrame:
    """Parts as ICD and RxNorm concepts; those whose key is divisible by 100 are gold."""
    return linking.hard_negatives(*_catalog(spark, sf_dir))


#: Requests are parts; the gold codes, pools and final lists come from their keys.
_LINKED = """
lg AS (SELECT p_partkey AS trace_id, CASE WHEN p_size % 3 = 0 THEN 'drug' ELSE 'disease' END AS entity_type, CASE WHEN p_size % 2 = 0 THEN 'ICD' ELSE 'RX' END AS terminology,
 CASE WHEN p_partkey % 8 = 0 THEN [] WHEN p_partkey % 5 = 0 THEN ['k' || (p_partkey % 6), 'k' || (p_partkey % 7 + 6)] ELSE ['k' || (p_partkey % 6)] END AS codes,
 CASE WHEN p_size % 4 = 0 THEN 'leaf' END AS granularity, p_partkey % 11 <> 0 AS alias_present FROM part),
lo AS (SELECT p_partkey AS trace_id, v AS variant, list_transform(range(0, CAST((p_partkey + v) % 9 AS BIGINT)), lambda i: 'k' || ((p_partkey * (v + 1) + i * 3) % 13)) AS ranked FROM part, (SELECT unnest([0, 1, 2, 3]) AS v)),
lf AS (SELECT trace_id, variant, ranked, list_distinct(ranked[1:2]) AS final FROM lo)"""


def _linked(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    code = lambda n: F.concat(F.lit("k"), n.cast("long").cast("string"))
    codes = F.when(k % 8 == 0, F.array().cast("array<string>")).when(k % 5 == 0, F.array(code(k % 6), code(k % 7 + 6))).otherwise(F.array(code(k % 6)))
    gold = p.select(
        k.alias("trace_id"), F.when(F.col("p_size") % 3 == 0, "drug").otherwise("disease").alias("entity_type"), F.when(F.col("p_size") % 2 == 0, "ICD").otherwise("RX").alias("terminology"), codes.alias("codes"),
        F.when(F.col("p_size") % 4 == 0, "leaf").alias("granularity"), (k % 11 != 0).alias("alias_present"),
    )
    o = p.select(k, F.explode(F.array(*map(F.lit, range(4)))).alias("variant")).withColumn("n", (k + F.col("variant")) % 9)
    ranked = F.when(F.col("n") == 0, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("n") - 1, F.lit(0)).cast("long")), lambda i: code((k * (F.col("variant") + 1) + i * 3) % 13)))
    out = o.select(k.alias("trace_id"), "variant", ranked.alias("ranked")).withColumn("final", F.array_distinct(F.slice("ranked", 1, 2)))
    return gold, out


_AT = ", ".join(f"round(avg((len(list_filter(g, lambda x: NOT list_contains(r[1:{k}], x))) = 0)::INT), 6) AS recall_{k}" for k in (1, 5, 10, 20, 50))


@query(f"""WITH {_LINKED}, b AS (SELECT variant, entity_type, terminology, codes AS g, list_distinct_ordered AS r, final AS f FROM lg JOIN (SELECT *, list_filter(ranked, lambda x, i: list_position(ranked, x) = i) AS list_distinct_ordered FROM lf) USING (trace_id)),
v AS (SELECT *, list_min(list_filter(list_transform(r, lambda x, i: CASE WHEN list_contains(g, x) THEN i END), lambda i: i IS NOT NULL)) AS first FROM b)
SELECT variant, entity_type, terminology, count(*) AS entities, round(avg((len(list_filter(g, lambda x: NOT list_contains(r, x))) = 0)::INT), 6) AS coverage, {_AT}, round(avg(coalesce(1.0 / first, 0)), 6) AS mrr,
 coalesce(round(avg(CASE WHEN len(g) > 0 THEN coalesce(list_contains(g, r[1]), false)::INT END), 6), 0) AS top1, round(avg(CASE WHEN len(g) + len(f) = 0 THEN 1.0 ELSE len(list_intersect(g, f)) * 1.0 / len(list_distinct(list_concat(g, f))) END), 6) AS jaccard,
 coalesce(round(avg(CASE WHEN len(f) = 0 THEN (len(g) = 0)::INT END), 6), 0) AS abstention_precision, round(avg((len(f) = 0)::INT), 6) AS abstention_coverage
FROM v GROUP BY GROUPING SETS ((variant, entity_type, terminology), (variant, entity_type), (variant, terminology), (variant))""")
def linking_variants(spark, sf_dir) -> DataFrame:
    """Four variants by entity type and terminology."""
    gold, out = _linked(spark, sf_dir)
    return linking.variant_metrics(out, gold)


@query(f"""WITH {_LINKED}, fu AS (SELECT * FROM lf WHERE variant = 2), re AS (SELECT * FROM lf WHERE variant = 3),
e AS (SELECT g.trace_id, g.codes AS g, g.granularity, g.alias_present, fu.ranked AS pool, re.ranked AS again, re.final, list_distinct(re.ranked[3:4]) AS rejected FROM lg g JOIN fu USING (trace_id) JOIN re USING (trace_id)),
x AS (SELECT trace_id, 'alias_missing' AS bucket FROM e WHERE NOT alias_present UNION ALL SELECT trace_id, 'retrieval_miss' FROM e WHERE len(g) > 0 AND len(list_filter(g, lambda c: NOT list_contains(pool, c))) > 0
UNION ALL SELECT trace_id, 'rerank_miss' FROM e WHERE len(g) > 0 AND len(list_filter(g, lambda c: NOT list_contains(pool, c))) = 0 AND len(list_filter(g, lambda c: NOT list_contains(final, c))) > 0
UNION ALL SELECT trace_id, 'wrong_granularity' FROM e WHERE granularity IS NOT NULL AND len(list_filter(again, lambda c: list_contains(g, c) AND c IN ('k1', 'k3'))) > 0
UNION ALL SELECT trace_id, 'structured_mismatch' FROM e WHERE len(list_intersect(g, rejected)) > 0 UNION ALL SELECT trace_id, 'obsolete_concept' FROM e WHERE len(list_filter(again, lambda c: list_contains(final, c) AND c = 'k5')) > 0 UNION ALL SELECT trace_id, 'ambiguous_gold' FROM e WHERE len(list_distinct(g)) > 1)
SELECT n.bucket, count(x.trace_id) AS n, min(x.trace_id) AS first_trace FROM (SELECT unnest(['alias_missing', 'retrieval_miss', 'rerank_miss', 'wrong_granularity', 'structured_mismatch', 'obsolete_concept', 'ambiguous_gold']) AS bucket) n LEFT JOIN x ON x.bucket = n.bucket GROUP BY n.bucket""")
def linking_error_buckets(spark, sf_dir) -> DataFrame:
    """Seven kinds of errors, which an entity may share. (k1 and k3 are of another granularity, k5 is obsolete.)"""
    gold, out = _linked(spark, sf_dir)
    grain = lambda x: F.when(x.isin("k1", "k3"), "branch").when(x != "k2", "leaf")
    again = F.transform("ranked", lambda x: F.struct(x.alias("code"), grain(x).alias("granularity"), (x == "k5").alias("obsolete")))
    reranked = out.where("variant = 3").select("trace_id", again.alias("ranked"), "final", F.slice("ranked", 3, 2).alias("rejected"))
    return linking.linking_error_counts(linking.linking_errors(gold, out.where("variant = 2"), reranked))


@query("""WITH r AS (SELECT p_brand AS request_id, p_partkey AS concept_id, p_size / 50.0 AS raw, CASE WHEN p_partkey % 4 <> 0 THEN (p_partkey % 89) / 89.0 END AS score FROM part)
SELECT request_id, concept_id, row_number() OVER (PARTITION BY request_id ORDER BY score DESC NULLS LAST, raw DESC, concept_id) AS rank FROM r""")
def rerank_order(spark, sf_dir) -> DataFrame:
    """Candidates by the reranker's score, raw score and id; some have no score."""
    p = table(spark, sf_dir, "part")
    retrieved = p.select(F.col("p_brand").alias("request_id"), F.col("p_partkey").alias("concept_id"), (F.col("p_size") / 50.0).alias("raw"))
    scores = p.where("p_partkey % 4 <> 0").select(F.col("p_brand").alias("request_id"), F.col("p_partkey").alias("concept_id"), (F.col("p_partkey") % 89 / 89.0).alias("score"))
    return linking.rerank_join(retrieved, scores).select("request_id", "concept_id", F.col("rank").cast("long").alias("rank"))


TYPE_MAP = {"medication": ("S0", "S1"), "diagnosis": ("S1", "S2")}
_SEARCHED = """qs AS (SELECT p_partkey AS query_id, upper(p_name) AS text FROM part WHERE p_partkey % 100 = 0), a AS (SELECT p_brand AS id, lower(p_name) AS bare FROM part),
ok AS (SELECT DISTINCT p_brand AS id FROM part WHERE p_size % 7 <> 0 AND 'S' || (p_size % 3) = 'S1')"""


@query(f"WITH {_SEARCHED} SELECT DISTINCT query_id, a.id, channel FROM qs JOIN a ON a.bare = lower(qs.text) JOIN ok ON ok.id = a.id, (SELECT unnest(['exact_alias', 'accentless_exact', 'bm25', 'ngram']) AS channel)")
def eligible_search(spark, sf_dir) -> DataFrame:
    """Exact hits and the other evidence on them, among active concepts of the systems that the terminology and
    both entity types leave."""
    p = table(spark, sf_dir, "part")
    concepts, _ = _terms(spark, sf_dir)
    allowed = retrieval.eligible(concepts, ("S0", "S1"), ("medication", "diagnosis"), TYPE_MAP).select(F.col("concept_id").alias("id"))
    queries = p.where("p_partkey % 100 = 0").select(F.col("p_partkey").alias("query_id"), F.upper("p_name").alias("text"))
    found = retrieval.lexical_search(queries, p.select(F.col("p_brand").alias("id"), F.col("p_name").alias("alias")), allowed)
    exact = found.where("channel = 'exact_alias'").select("query_id", "id")
    return found.join(exact, ["query_id", "id"], "left_semi").select("query_id", "id", "channel").distinct()


@query(f"WITH {_SEARCHED.replace(chr(39) + 'S1' + chr(39) + ')', chr(39) + 'S0' + chr(39) + ' OR p_size % 7 <> 0 AND ' + chr(39) + 'S' + chr(39) + ' || (p_size % 3) = ' + chr(39) + 'S1' + chr(39) + ')')} SELECT DISTINCT query_id, a.id FROM qs JOIN a ON a.bare = lower(qs.text) JOIN ok ON ok.id = a.id")
def slot_retrieval(spark, sf_dir) -> DataFrame:
    """Mentions with strength, route and frequency are searched by their ingredient alone."""
    p = table(spark, sf_dir, "part")
    mentions = p.where("p_partkey % 100 = 0").select(F.col("p_partkey").alias("query_id"), F.concat("p_name", F.lit(" 5 mg po bid")).alias("text"))
    concepts, _ = _terms(spark, sf_dir)
    found = retrieval.slot_search(mentions, p.select(F.col("p_brand").alias("id"), F.col("p_name").alias("alias")), concepts, "medication", TYPE_MAP)
    return found.where("channel = 'exact_alias'").select("query_id", "id").distinct()


@query("""WITH u AS (SELECT upper(p_name) || ' 5 ug/ml' AS v, p_size AS n FROM part) SELECT v, lower(regexp_replace(trim(v), '\\s+', ' ', 'g')) AS feature, replace(replace(lower(v), 'ug', 'mcg'), ' ', '') AS unit, CASE WHEN n >= 42.5 THEN 'high' WHEN n >= 35 THEN 'medium' ELSE 'low' END AS tier, count(*) AS n FROM u GROUP BY ALL""")
def scalar_keys(spark, sf_dir) -> DataFrame:
    """normalised features and units, tiers of scores."""
    v = F.concat(F.upper("p_name"), F.lit(" 5 ug/ml"))
    keys = table(spark, sf_dir, "part").select(v.alias("v"), T.feature_key(v).alias("feature"), T.unit_key(v).alias("unit"), T.association_tier(F.col("p_size") / 50.0).alias("tier"))
    return keys.groupBy("v", "feature", "unit", "tier").agg(F.count("*").alias("n"))


#: Documents as annotated samples: long words are entities; sources make the splits.
_ANNOTATED = f"""{_GOLD}, sp AS (SELECT doc_id, text, CASE WHEN doc_id % 5 = 0 THEN 'synthetic_hard' WHEN doc_id % 5 < 4 THEN 'synthetic_clean' ELSE 'human_reviewed' END AS split FROM documents),
en AS (SELECT g.doc_id, sp.split, CASE WHEN g.doc_id % 5 = 0 AND g.s % 50 = 0 THEN g.s + 1 ELSE g.s END AS s, g.e, g.text, ['TRIỆU_CHỨNG', 'TÊN_XÉT_NGHIỆM', 'CHẨN_ĐOÁN', 'THUỐC'][g.s % 4 + 1] AS type, g.s % 3 = 0 AS neg, g.s % 7 = 0 AS fam, d.text AS body FROM gold g JOIN sp ON sp.doc_id = g.doc_id JOIN documents d ON d.doc_id = g.doc_id WHERE g.doc_id % 5 <> 0 OR g.s % 10 = 0)"""


def _annotated(spark, sf_dir) -> DataFrame:
    s, hard = F.col("start"), F.col("doc_id") % 5 == 0
    kinds = F.element_at(F.array(*map(F.lit, ("TRIỆU_CHỨNG", "TÊN_XÉT_NGHIỆM", "CHẨN_ĐOÁN", "THUỐC"))), (s % 4 + 1).cast("int"))
    said = F.array_compact(F.array(F.when(s % 3 == 0, "isNegated"), F.when(s % 7 == 0, "isFamily")))
    e = F.struct("text", kinds.alias("type"), F.when(hard & (s % 50 == 0), s + 1).otherwise(s).alias("start"), "end", said.alias("assertions"))
    rows = _gold(spark, sf_dir).where(~hard | (s % 10 == 0)).groupBy("doc_id").agg(F.collect_list(e).alias("entities"))
    split = F.when(hard, "synthetic_hard").when(F.col("doc_id") % 5 < 4, "synthetic_clean").otherwise("human_reviewed")
    return table(spark, sf_dir, "documents").select("doc_id", "text", split.alias("split")).join(rows, "doc_id", "left")


_STRUCT = """st AS (SELECT sp.split, count(DISTINCT sp.doc_id) AS total_samples, count(en.s) AS total_entities, count(DISTINCT sp.doc_id) - count(DISTINCT en.doc_id) AS empty_entity_samples,
 CAST(coalesce(sum((en.s IS NOT NULL AND NOT (en.s < en.e AND en.e <= length(en.body) AND substring(en.body, CAST(en.s + 1 AS INT), CAST(en.e - en.s AS INT)) = en.text))::INT), 0) AS BIGINT) AS bad_position_count,
 count(en.s) FILTER (en.type = 'KẾT_QUẢ_XÉT_NGHIỆM') AS n_result, count(en.s) FILTER (en.neg) AS n_neg, count(en.s) FILTER (en.fam) AS n_fam FROM sp LEFT JOIN en ON en.doc_id = sp.doc_id GROUP BY sp.split)"""
_REAL = r"""tk AS (SELECT split, text, regexp_extract_all(text, '[\p{L}\p{N}_]+') AS tk FROM sp), lw AS (SELECT *, list_transform(tk, lambda x: lower(x)) AS low FROM tk),
gm AS (SELECT *, list_transform(range(1, len(low)), lambda i: low[i] || ' ' || low[i+1]) AS g2, list_transform(range(1, len(low) - 1), lambda i: low[i] || ' ' || low[i+1] || ' ' || low[i+2]) AS g3 FROM lw),
re AS (SELECT split, avg(length(text)) AS avg_text_length, sum(len(g2) + len(g3) - len(list_distinct(g2)) - len(list_distinct(g3))) * 1.0 / sum(len(g2) + len(g3)) AS repetition_rate, len(list_distinct(flatten(list(low)))) * 1.0 / sum(len(tk)) AS lexical_diversity,
 sum(len(regexp_extract_all(text, '[^\p{L}\p{N}_\s]'))) * 1.0 / sum(length(text)) AS punctuation_density FROM gm GROUP BY split)""".replace("\\\\", "\\")


@query(f"WITH {_ANNOTATED}, {_STRUCT}, {_REAL} SELECT split, total_samples, total_entities, empty_entity_samples, bad_position_count, round(total_entities * 1.0 / total_samples, 6) AS avg_entities, round(avg_text_length, 6) AS avg_text_length, round(lexical_diversity, 6) AS lexical_diversity, round(repetition_rate, 6) AS repetition_rate, round(punctuation_density, 6) AS punctuation_density, NOT (split = 'synthetic_clean' AND bad_position_count > 0) AS passed FROM st JOIN re USING (split)")
def synthetic_splits(spark, sf_dir) -> DataFrame:
    """Measures and gates of each split."""
    r = quality.evaluate_splits(_annotated(spark, sf_dir))
    rounded = lambda *names: [F.round(n, 6).alias(n) for n in names]
    return r.select("split", "total_samples", "total_entities", "empty_entity_samples", "bad_position_count", *rounded("avg_entities", "avg_text_length", "lexical_diversity", "repetition_rate", "punctuation_density"), "passed")


@query(f"""WITH {_ANNOTATED}, {_STRUCT}, c AS (SELECT * FROM st WHERE split = 'synthetic_clean'), h AS (SELECT * FROM st WHERE split = 'synthetic_hard')
SELECT round(c.total_entities * 1.0 / c.total_samples - h.total_entities * 1.0 / h.total_samples, 6) AS entity_drop, round((h.n_neg + h.n_fam) * 1.0 / greatest(h.total_entities, 1) - (c.n_neg + c.n_fam) * 1.0 / greatest(c.total_entities, 1), 6) AS assertion_shift,
 concat_ws(',', CASE WHEN c.bad_position_count > 0 THEN 'clean_bad_positions' END, CASE WHEN c.empty_entity_samples > 0 THEN 'clean_empty_samples' END) AS blocking, c.bad_position_count = 0 AND c.empty_entity_samples = 0 AS ready FROM c, h""")
def utility_gates(spark, sf_dir) -> DataFrame:
    """Whether the splits may be trained on, and what blocks it."""
    r = quality.recommendation(quality.evaluate_splits(_annotated(spark, sf_dir)))
    return r.select(F.round("entity_drop", 6).alias("entity_drop"), F.round("assertion_shift", 6).alias("assertion_shift"), F.array_join("blocking", ",").alias("blocking"), "ready")


@query(f"""WITH {_ANNOTATED}, x AS (SELECT sp.doc_id, en.s, NOT (en.s < en.e AND en.e <= length(en.body) AND substring(en.body, CAST(en.s + 1 AS INT), CAST(en.e - en.s AS INT)) = en.text) AS bad, en.fam, en.type FROM sp LEFT JOIN en ON en.doc_id = sp.doc_id)
SELECT sp.doc_id, coalesce(max((x.bad)::INT) = 1, false) AS bad_span, coalesce(max((NOT x.bad AND x.fam)::INT) = 1, false) AS bad_family, regexp_matches(any_value(sp.text), '[\\x{{4e00}}-\\x{{9fff}}\\x{{3400}}-\\x{{4dbf}}]') AS cjk FROM sp LEFT JOIN x ON x.doc_id = sp.doc_id GROUP BY sp.doc_id""")
def local_validation(spark, sf_dir) -> DataFrame:
    """Errors of annotated samples, by kind."""
    d = _annotated(spark, sf_dir)
    e = F.transform("entities", lambda x: F.struct(x["text"].alias("text"), x["type"].alias("type"), x["start"].cast("int").alias("start"), x["end"].cast("int").alias("end"), x["assertions"].alias("assertions"), F.array().cast("array<string>").alias("candidates")))
    r = validate.local_validation(d.withColumn("entities", e).withColumn("profile", F.lit("basic")), {"isNegated": ("not", "no"), "isFamily": ("family",)}, ("E11",))
    has = lambda n: F.array_contains("errors", n)
    return r.select("doc_id", has("bad_exact_span").alias("bad_span"), has("invalid_family_semantics").alias("bad_family"), has("contains_cjk_noise").alias("cjk"))
