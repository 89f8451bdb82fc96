"""Terminology, retrieval and linking queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import linking, retrieval
from ..operators.similarity import dense_top_k
from .registry import query, table

_BM25 = """
tf AS (SELECT token, id, doc_len, count(*) AS tf FROM (SELECT id, len(tk) AS doc_len, unnest(tk) AS token FROM d) GROUP BY token, id, doc_len),
st AS (SELECT count(*) AS n_docs, avg(len(tk)) AS avg_len FROM d), df AS (SELECT token, count(*) AS df FROM tf GROUP BY token),
qt AS (SELECT query_id, token, count(*) AS times FROM (SELECT query_id, unnest(tk) AS token FROM q) GROUP BY query_id, token),
sc AS (SELECT query_id, id, sum(times * ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * doc_len / avg_len))) AS score
  FROM qt JOIN df USING (token) JOIN tf USING (token), st GROUP BY query_id, id)"""


@query(rf"""
WITH d AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+') AS tk FROM documents),
q AS (SELECT item_id AS query_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+') AS tk FROM benchmark), {_BM25},
r AS (SELECT query_id, id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, id) AS rank FROM sc)
SELECT query_id, id, score, rank FROM r WHERE rank <= 5""")
def bm25_search(spark, sf_dir) -> DataFrame:
    """The five best documents for each benchmark item."""
    d = table(spark, sf_dir, "documents").select("doc_id", T.tokens(F.lower("text")).alias("tk"))
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), T.tokens(F.lower("text")).alias("tk"))
    return retrieval.bm25_top(q, d, "doc_id", "tk", 5)


_GRAMS = "list_distinct(flatten([list_transform(range(1, length({0}) - 1), lambda i: substring({0}, i, 3)), list_transform(range(1, length({0}) - 2), lambda i: substring({0}, i, 4)), list_transform(range(1, length({0}) - 3), lambda i: substring({0}, i, 5))]))"
_ALIASES = "al AS (SELECT DISTINCT p_brand AS id, p_name AS alias FROM part), qs AS (SELECT p_partkey AS query_id, p_name AS text FROM part WHERE p_partkey % 100 = 0)"
_NGRAM = f"""
qg AS (SELECT query_id, {_GRAMS.format("(' ' || text || ' ')")} AS g FROM qs), ag AS (SELECT id, alias, {_GRAMS.format("(' ' || alias || ' ')")} AS g FROM al),
anyg AS (SELECT DISTINCT id, unnest(g) AS gram FROM ag), h AS (SELECT query_id, id, count(*) AS overlap FROM (SELECT query_id, unnest(g) AS gram FROM qg) JOIN anyg USING (gram) GROUP BY query_id, id),
f AS (SELECT id, g FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY alias) AS rn FROM ag) WHERE rn = 1),
ng AS (SELECT h.query_id, h.id, overlap * 1.0 / len(list_distinct(list_concat(qg.g, f.g))) AS score FROM h JOIN f USING (id) JOIN qg ON qg.query_id = h.query_id)"""


def _aliases(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    p = table(spark, sf_dir, "part")
    return p.where("p_partkey % 100 = 0").select(F.col("p_partkey").alias("query_id"), F.col("p_name").alias("text")), p.select(F.col("p_brand").alias("id"), F.col("p_name").alias("alias")).distinct()


@query(f"WITH {_ALIASES}, {_NGRAM} SELECT query_id, id, round(score, 6) AS score FROM ng")
def ngram_search(spark, sf_dir) -> DataFrame:
    """Part names against the names of each brand."""
    return retrieval.ngram_search(*_aliases(spark, sf_dir)).select("query_id", "id", F.round("score", 6).alias("score"))


@query(f"WITH {_ALIASES}, s AS (SELECT id, min(alias) AS matched FROM al GROUP BY id) SELECT query_id, al.id, matched FROM qs JOIN al ON al.alias = qs.text JOIN s ON s.id = al.id")
def exact_alias_join(spark, sf_dir) -> DataFrame:
    """J09."""
    return retrieval.exact_search(*_aliases(spark, sf_dir))


@query(
    f"WITH {_ALIASES}, {_NGRAM}, d AS (SELECT id, flatten(list(string_split(alias, ' ') ORDER BY alias)) AS tk FROM al GROUP BY id), q AS (SELECT query_id, string_split(text, ' ') AS tk FROM qs), {_BM25} "
    "SELECT channel, query_id, id, round(score, 6) AS score FROM (SELECT 'ngram' AS channel, query_id, id, score FROM ng UNION ALL SELECT 'bm25', query_id, id, score FROM sc "
    "UNION ALL SELECT 'exact', query_id, al.id, 1.0 FROM qs JOIN al ON al.alias = qs.text)"
)
def hybrid_search(spark, sf_dir) -> DataFrame:
    """Evidence of all channels, for each query and target."""
    return retrieval.hybrid_search(*_aliases(spark, sf_dir)).select("channel", "query_id", "id", F.round("score", 6).alias("score"))


_DENSE = """
e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings),
s AS (SELECT q.vec_id AS query_id, q.label AS gold, d.vec_id, d.label, round(list_dot_product(q.v, d.v), 6) AS score FROM e q, e d WHERE q.vec_id % 100 = 0 AND q.vec_id <> d.vec_id),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)"""


def _dense(spark, sf_dir, k: int) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    found = dense_top_k(q, e, k).withColumn("score", F.round("score", 6))
    gold = e.select(F.col("vec_id").alias("query_id"), F.col("label").alias("gold"))
    return found.join(e.select("vec_id", "label"), "vec_id").join(gold, "query_id")


@query(f"WITH {_DENSE} SELECT query_id, vec_id, score, rank FROM k WHERE rank <= 3")
def dense_topk(spark, sf_dir) -> DataFrame:
    """J11, K03."""
    return _dense(spark, sf_dir, 3).select("query_id", "vec_id", "score", "rank")


@query(
    f"WITH {_DENSE}, f AS (SELECT query_id, min(CASE WHEN label = gold THEN rank END) AS first FROM k WHERE rank <= 5 GROUP BY query_id) "
    "SELECT count(*) AS n, round(avg(coalesce((first <= 1)::INT, 0)), 6) AS recall_1, round(avg(coalesce((first <= 2)::INT, 0)), 6) AS recall_2, round(avg(coalesce((first <= 5)::INT, 0)), 6) AS recall_5, round(avg(coalesce(1.0 / first, 0)), 6) AS mrr FROM f"
)
def recall_at_k(spark, sf_dir) -> DataFrame:
    """Labels as gold."""
    return linking.ranking_metrics(_dense(spark, sf_dir, 5).withColumn("hit", F.col("label") == F.col("gold")))


_CANDIDATES = "c AS (SELECT p_brand AS request_id, p_partkey AS concept_id, p_size / 50.0 AS lexical, (p_partkey % 97) / 97.0 AS dense, p_type FROM part)"


def _candidates(spark, sf_dir) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_brand").alias("request_id"), F.col("p_partkey").alias("concept_id"), (F.col("p_size") / 50.0).alias("lexical"), (F.col("p_partkey") % 97 / 97.0).alias("dense"), "p_type")


def _fused(spark, sf_dir) -> DataFrame:
    c = _candidates(spark, sf_dir)
    rows = c.select("request_id", "concept_id", F.expr("stack(2, 'lexical', lexical, 'dense', dense) as (channel, score)"), F.lit("part").alias("evidence"))
    f = linking.abstain(linking.merge_candidates(rows).withColumn("fused", linking.fused(F.col("scores"), {"lexical": 0.6, "dense": 0.5})), 0.9)
    order = Window.partitionBy("request_id").orderBy(F.desc(F.round("fused", 9)), "concept_id")
    return f.withColumn("rank", F.row_number().over(order)).select("request_id", "concept_id", F.round("fused", 6).alias("fused"), "rank")


@query(f"""WITH {_CANDIDATES}, f AS (SELECT *, greatest(least(0.6 * lexical + 0.5 * dense, 1.0), 0.0) AS fused FROM c),
b AS (SELECT *, max(fused) OVER (PARTITION BY request_id) AS best, row_number() OVER (PARTITION BY request_id ORDER BY round(fused, 9) DESC, concept_id) AS rank FROM f)
SELECT request_id, concept_id, round(fused, 6) AS fused, rank FROM b WHERE best >= 0.9""")
def channel_fusion(spark, sf_dir) -> DataFrame:
    """Weighted channels; requests whose best is under 0.9 abstain; all other candidates with their rank."""
    return _fused(spark, sf_dir)


_SELECTED = """r AS (SELECT request_id, concept_id, lexical, dense AS p, row_number() OVER (PARTITION BY request_id ORDER BY dense DESC, concept_id) AS k FROM c),
u AS (SELECT *, sum(p) OVER (PARTITION BY request_id ORDER BY k ROWS UNBOUNDED PRECEDING) AS hits, sum(p) OVER (PARTITION BY request_id) AS total FROM r),
v AS (SELECT *, hits / (total + k - hits) AS value FROM u), m AS (SELECT request_id, max(value) AS best FROM v GROUP BY request_id),
b AS (SELECT v.request_id, CAST(min(k) AS BIGINT) AS n, any_value(best) AS best FROM v JOIN m ON v.request_id = m.request_id AND v.value = m.best GROUP BY v.request_id)"""


@query(f"WITH {_CANDIDATES}, {_SELECTED} SELECT request_id, n, round(best, 6) AS expected_jaccard FROM b")
def expected_jaccard_set(spark, sf_dir) -> DataFrame:
    """Size and value of the best prefix of all candidates."""
    chosen = linking.expected_jaccard_set(_candidates(spark, sf_dir).select("request_id", "concept_id", F.col("dense").alias("p")))
    return chosen.groupBy("request_id").agg(F.max("k").cast("long").alias("n"), F.round(F.max("expected_jaccard"), 6).alias("expected_jaccard"))


@query(f"""WITH {_CANDIDATES}, {_SELECTED},
g AS (SELECT request_id, CAST(sum((lexical >= 0.9)::INT) AS BIGINT) AS n_gold, count(*) AS n_pool, CAST(sum((k <= n)::INT) AS BIGINT) AS n_chosen, CAST(sum((lexical >= 0.9 AND k <= n)::INT) AS BIGINT) AS shared FROM r JOIN b USING (request_id) GROUP BY request_id)
SELECT request_id, n_gold, n_pool, n_chosen, shared AS hit, CAST(1.0 AS DOUBLE) AS recall, round(shared * 1.0 / (n_gold + n_chosen - shared), 6) AS jaccard, shared = n_gold AND shared = n_chosen AS exact FROM g""")
def candidate_oracle(spark, sf_dir) -> DataFrame:
    """Recall of the gold set by the pool of all candidates; Jaccard and equality of the gold set with the set that
    expected_jaccard_set selects. Gold candidates are rows of the pool here."""
    p = _candidates(spark, sf_dir).select("request_id", "concept_id", F.col("dense").alias("p"), (F.col("lexical") >= 0.9).alias("gold"))
    chosen = linking.expected_jaccard_set(p)
    return linking.candidate_oracle(p.where("gold"), p, chosen)


@query("""
WITH u AS (SELECT p_name AS alias, min(p_brand) AS code FROM part GROUP BY p_name HAVING count(DISTINCT p_brand) = 1),
o AS (SELECT l_orderkey, count(*) AS n, sum((u.code IS NULL)::INT) AS missing FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey LEFT JOIN u ON u.alias = p.p_name GROUP BY l_orderkey)
SELECT CASE WHEN missing = 0 THEN 'accepted' ELSE 'rejected' END AS status, count(*) AS orders, CAST(sum(n) AS BIGINT) AS lines FROM o GROUP BY 1""")
def alias_remap(spark, sf_dir) -> DataFrame:
    """An order is remapped if every line's part name has a single brand, else rejected whole."""
    p, li = table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem")
    lines = li.select(F.col("l_orderkey").alias("sample_id"), F.col("l_partkey").alias("p_partkey")).join(p.select("p_partkey", F.col("p_name").alias("alias")), "p_partkey")
    o = linking.alias_remap(lines, p.select(F.col("p_name").alias("alias"), F.col("p_brand").alias("code")))
    return o.groupBy(F.when(F.col("missing") == 0, "accepted").otherwise("rejected").alias("status")).agg(F.count("*").alias("orders"), F.sum("n").alias("lines"))


@query("""
WITH s AS (SELECT DISTINCT p_name, unnest(string_split(p_name, ' ')) AS word FROM part), r AS (SELECT DISTINCT a.p_name, b.p_name AS related FROM s a JOIN s b ON a.word = b.word AND a.p_name <> b.p_name)
SELECT p_name, count(*) AS related, min(related) AS first_related FROM r GROUP BY p_name""")
def seed_relations(spark, sf_dir) -> DataFrame:
    """Names related by a shared word, through the word and not by comparing all names."""
    s = table(spark, sf_dir, "part").select("p_name").distinct().select("p_name", F.explode(F.split("p_name", " ")).alias("word")).distinct()
    r = s.join(s.withColumnRenamed("p_name", "related"), "word").where("p_name <> related").select("p_name", "related").distinct()
    return r.groupBy("p_name").agg(F.count("*").alias("related"), F.min("related").alias("first_related"))
