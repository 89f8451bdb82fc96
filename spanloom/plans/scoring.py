"""Scores of predicted entities against gold ones, on entities derived from words of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import assertion, evaluate
from .registry import query, table
from .spans import _GOLD, _PRF, _gold

_SAID = "list_filter([CASE WHEN ({0}) % 2 = 0 THEN 'isNegated' END, CASE WHEN ({0}) % 3 = 0 THEN 'isHistorical' END, CASE WHEN ({0}) % 5 = 0 THEN 'isFamily' END], lambda x: x IS NOT NULL)"
#: Some gold entities twice; predictions leave a tenth out, cut a tenth, retype a tenth, and change assertions and codes.
ENTITIES = f"""{_GOLD},
ent AS (SELECT doc_id, s, e, text, type, i, {_SAID.format('s + i')} AS asr, CASE WHEN type <> 'A' THEN ['c' || (s % 4), 'c' || (s % 7)] END AS cand FROM (SELECT *, 1 AS i FROM gold UNION ALL SELECT *, 2 AS i FROM gold WHERE s % 11 = 0)),
prd AS (SELECT doc_id, s, CASE WHEN k = 1 THEN e - 1 ELSE e END AS e, CASE WHEN k = 1 THEN left(text, length(text) - 1) ELSE text END AS text, CASE WHEN k = 2 THEN 'A' ELSE type END AS type, i,
 {_SAID.format('s + i + (k = 3)::INT')} AS asr, CASE WHEN k = 4 THEN NULL WHEN k = 5 THEN [] WHEN type <> 'A' THEN ['c' || (s % 4), 'c' || k] END AS cand, ['c' || k, 'c' || (s % 7), 'c' || (s % 4)] AS ranking
 FROM (SELECT *, (doc_id * 7 + s * 13) % 10 AS k FROM ent) WHERE k <> 0)"""
_JAC = "CASE WHEN len(list_distinct(list_concat({0}, {1}))) = 0 THEN 1.0 ELSE len(list_intersect({0}, {1})) * 1.0 / len(list_distinct(list_concat({0}, {1}))) END"


def _pair(keys: str) -> str:
    on = " AND ".join(f"g.{k} = p.{k}" for k in ["doc_id", *keys.split(", "), "k"])
    return f"""g AS (SELECT *, row_number() OVER (PARTITION BY doc_id, {keys} ORDER BY i) AS k FROM ent), p AS (SELECT *, row_number() OVER (PARTITION BY doc_id, {keys} ORDER BY i) AS k FROM prd),
m AS (SELECT coalesce(g.doc_id, p.doc_id) AS doc_id, coalesce(g.type, p.type) AS type, g.doc_id IS NOT NULL AS ing, p.doc_id IS NOT NULL AS inp, coalesce(g.asr, []) AS ga, coalesce(p.asr, []) AS pa, g.cand AS gcand, p.cand AS pcand, p.ranking FROM g FULL JOIN p ON {on})"""


def entities(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    text = lambda *parts: F.concat(*(p if not isinstance(p, str) else F.lit(p) for p in parts))
    code = lambda n: text("c", n.cast("string"))
    said = lambda n: F.array_compact(F.array(*(F.when(n % m == 0, label) for m, label in ((2, "isNegated"), (3, "isHistorical"), (5, "isFamily")))))
    once = _gold(spark, sf_dir)
    s = F.col("start")
    ent = once.withColumn("i", F.lit(1)).unionByName(once.where("start % 11 = 0").withColumn("i", F.lit(2)))
    ent = ent.withColumn("assertions", said(s + F.col("i"))).withColumn("candidates", F.when(F.col("type") != "A", F.array(code(s % 4), code(s % 7))))
    k = F.col("k")
    p = ent.withColumn("k", (F.col("doc_id") * 7 + s * 13) % 10).where("k <> 0")
    none = F.array().cast("array<string>")
    pred = p.select(
        "doc_id", "start", F.when(k == 1, F.col("end") - 1).otherwise(F.col("end")).alias("end"), F.when(k == 1, F.left("text", F.length("text") - 1)).otherwise(F.col("text")).alias("text"),
        F.when(k == 2, "A").otherwise(F.col("type")).alias("type"), "i", said(s + F.col("i") + (k == 3).cast("int")).alias("assertions"),
        F.when(k == 4, F.lit(None)).when(k == 5, none).when(F.col("type") != "A", F.array(code(s % 4), code(k))).alias("candidates"), F.array(code(k), code(s % 7), code(s % 4)).alias("ranking"),
    )
    return ent, pred


_SCORE = f"""{ENTITIES}, {_pair('s, e, type, text')},
c AS (SELECT doc_id, CAST(sum((ing AND inp)::INT) AS BIGINT) AS matched, CAST(sum((NOT inp)::INT) AS BIGINT) AS unmatched_gold, CAST(sum((NOT ing)::INT) AS BIGINT) AS unmatched_pred,
 avg({_JAC.format('ga', 'pa')}) AS aj, avg({_JAC.format("coalesce(gcand, [])", "coalesce(pcand, [])")}) AS cj FROM m GROUP BY doc_id),
q AS (SELECT *, CASE WHEN matched + unmatched_pred = 0 THEN 1.0 ELSE matched * 1.0 / (matched + unmatched_pred) END AS pr, CASE WHEN matched + unmatched_gold = 0 THEN 1.0 ELSE matched * 1.0 / (matched + unmatched_gold) END AS re FROM c),
f AS (SELECT *, CASE WHEN pr + re = 0 THEN 0.0 ELSE 2 * pr * re / (pr + re) END AS f1 FROM q)"""


@query(f"WITH {_SCORE} SELECT doc_id, matched, unmatched_gold, unmatched_pred, round(pr, 6) AS precision, round(re, 6) AS recall, round(f1, 6) AS f1, round(aj, 6) AS assertion_jaccard, round(cj, 6) AS candidate_jaccard, round((2 * f1 + aj + cj) / 4, 6) AS final_score FROM f")
def score_samples(spark, sf_dir) -> DataFrame:
    """The weighted score of each document (entities count twice)."""
    s = evaluate.score_samples(*entities(spark, sf_dir), weights=(2.0, 1.0, 1.0))
    r = lambda *names: [F.round(n, 6).alias(n) for n in names]
    return s.select("doc_id", "matched", "unmatched_gold", "unmatched_pred", *r("precision", "recall", "f1", "assertion_jaccard", "candidate_jaccard", "final_score"))


_LABELS = f"l AS (SELECT unnest(list_distinct(list_concat(ga, pa))) AS label, ga, pa FROM m WHERE ing AND inp), la AS (SELECT label, CAST(sum((list_contains(ga, label) AND list_contains(pa, label))::INT) AS BIGINT) AS tp, CAST(sum((NOT list_contains(ga, label))::INT) AS BIGINT) AS fp, CAST(sum((NOT list_contains(pa, label))::INT) AS BIGINT) AS fn FROM l GROUP BY label)"


@query(f"WITH {ENTITIES}, {_pair('s, e, type')}, {_LABELS} SELECT label, tp, fp, fn, {_PRF} FROM la")
def assertion_label_metrics(spark, sf_dir) -> DataFrame:
    """Labels of paired entities."""
    return evaluate.assertion_metrics(*entities(spark, sf_dir))


_SCOPES = "sc AS (SELECT DISTINCT g.doc_id, g.s, g.e, g.type, g.i FROM ent g JOIN prd p ON p.doc_id = g.doc_id AND p.type = g.type AND p.s < g.e AND g.s < p.e AND NOT (p.s = g.s AND p.e = g.e) AND len(list_intersect(g.asr, p.asr)) > 0)"


@query(f"WITH {ENTITIES}, {_SCOPES} SELECT doc_id, count(*) AS n FROM sc GROUP BY doc_id")
def assertion_scope_errors(spark, sf_dir) -> DataFrame:
    """Gold entities whose assertion was predicted on another span."""
    return evaluate.scope_errors(*entities(spark, sf_dir)).groupBy("doc_id").agg(F.count("*").alias("n"))


_LINKING = f"""k AS (SELECT gcand, coalesce(pcand, []) AS said, CASE WHEN list_contains(gcand, ranking[1]) THEN 1 WHEN list_contains(gcand, ranking[2]) THEN 2 WHEN list_contains(gcand, ranking[3]) THEN 3 END AS rank FROM m WHERE ing AND inp AND gcand IS NOT NULL),
li AS (SELECT count(*) AS n, avg(coalesce((rank <= 1)::INT, 0)) AS recall_1, avg(coalesce((rank <= 2)::INT, 0)) AS recall_2, avg(coalesce((rank <= 5)::INT, 0)) AS recall_5, avg(coalesce(1.0 / rank, 0)) AS mrr, avg((len(list_intersect(gcand, said)) > 0)::INT) AS oracle, avg({_JAC.format('gcand', 'said')}) AS jaccard FROM k)"""


@query(f"WITH {ENTITIES}, {_pair('s, e, type')}, {_LINKING} SELECT n, round(recall_1, 6) AS recall_1, round(recall_2, 6) AS recall_2, round(recall_5, 6) AS recall_5, round(mrr, 6) AS mrr, round(oracle, 6) AS oracle, round(jaccard, 6) AS jaccard FROM li")
def linking_report(spark, sf_dir) -> DataFrame:
    """Codes of paired entities."""
    return evaluate.linking_report(*entities(spark, sf_dir))


_RUNS = "runs AS (SELECT doc_id, CASE WHEN doc_id % 50 = 0 THEN 'timeout' WHEN doc_id % 71 = 0 THEN 'decode' END AS failure_reason, CASE WHEN doc_id % 9 <> 0 THEN doc_id % 97 END AS latency_ms FROM documents)"
_MELT = "SELECT '{0}' AS section, {1} AS name, round(CAST({2} AS DOUBLE), 6) AS value FROM {3}"


def _melted(section: str, names: str, source: str, key: str = "") -> str:
    return " UNION ALL ".join(_MELT.format(section, f"{key} || '.{n}'" if key else f"'{n}'", n, source) for n in names.split())


_COUNTS = "CAST(sum((ing AND inp)::INT) AS BIGINT) AS tp, CAST(sum((NOT ing)::INT) AS BIGINT) AS fp, CAST(sum((NOT inp)::INT) AS BIGINT) AS fn"


@query(f"""WITH {ENTITIES}, {_RUNS}, {_pair('s, e, type')}, {_LABELS}, {_LINKING}, {_SCOPES},
fin AS (WITH {_SCORE} SELECT avg(coalesce((f1 + aj + cj) / 3, 1.0)) AS final_score, count(*) AS samples FROM documents LEFT JOIN f USING (doc_id)), unk AS (SELECT 0 AS unknown_samples),
ty AS (SELECT type, tp, fp, fn, {_PRF} FROM (SELECT type, {_COUNTS} FROM m GROUP BY type)), lb AS (SELECT label, tp, fp, fn, {_PRF} FROM la),
ms AS (SELECT DISTINCT doc_id, s, e, type, i FROM (SELECT * FROM ent) x WHERE NOT EXISTS (SELECT 1 FROM prd p WHERE p.doc_id = x.doc_id AND p.s = x.s AND p.e = x.e AND p.type = x.type)),
er AS (SELECT CASE WHEN bool_or(p.type = ms.type) THEN 'boundary' WHEN count(p.doc_id) > 0 THEN 'type' ELSE 'missing' END AS error FROM ms LEFT JOIN prd p ON p.doc_id = ms.doc_id AND p.s < ms.e AND ms.s < p.e GROUP BY ms.doc_id, ms.s, ms.e, ms.type, ms.i),
ex AS (SELECT 'spurious' AS error FROM prd x WHERE NOT EXISTS (SELECT 1 FROM ent g WHERE g.doc_id = x.doc_id AND g.s < x.e AND x.s < g.e)),
sy AS (SELECT avg(latency_ms) AS mean_latency_ms, max(latency_ms) AS max_latency_ms, count(failure_reason) AS failures FROM runs)
{_melted('score', 'final_score samples', 'fin')} UNION ALL {_melted('score', 'unknown_samples', 'unk')} UNION ALL {_melted('type', 'tp fp fn precision recall f1', 'ty', 'type')} UNION ALL {_melted('assertion', 'tp fp fn precision recall f1', 'lb', 'label')}
UNION ALL {_melted('linking', 'n recall_1 recall_2 recall_5 mrr oracle jaccard', 'li')} UNION ALL SELECT 'error', error, CAST(count(*) AS DOUBLE) FROM (SELECT * FROM er UNION ALL SELECT * FROM ex) GROUP BY error UNION ALL SELECT 'error', 'scope', CAST(count(*) AS DOUBLE) FROM sc
UNION ALL {_melted('system', 'mean_latency_ms max_latency_ms failures', 'sy')} UNION ALL SELECT 'failure', failure_reason, CAST(count(*) AS DOUBLE) FROM runs WHERE failure_reason IS NOT NULL GROUP BY failure_reason""")
def evaluation_report(spark, sf_dir) -> DataFrame:
    """The whole report of a run, as (section, name, value)."""
    runs = table(spark, sf_dir, "documents").select(
        "doc_id", F.when(F.col("doc_id") % 50 == 0, "timeout").when(F.col("doc_id") % 71 == 0, "decode").alias("failure_reason"), F.when(F.col("doc_id") % 9 != 0, F.col("doc_id") % 97).alias("latency_ms")
    )
    return evaluate.evaluation_report(*entities(spark, sf_dir), runs)


_MENTIONS = f"""{_GOLD}, mt AS (SELECT doc_id || ':' || s AS id, CASE WHEN type = 'A' THEN 'TÊN_XÉT_NGHIỆM' ELSE type END AS type, s FROM gold WHERE s % 3 = 0),
dc AS (SELECT id, 'isNegated' AS label, (s % 100) / 100.0 AS score, s % 2 = 0 AS applies FROM mt UNION ALL SELECT id, 'isNegated', (s % 37) / 40.0, true FROM mt UNION ALL SELECT id, 'isFamily', 0.97, s % 5 = 0 FROM mt)"""


@query(f"""WITH {_MENTIONS}, tp AS (SELECT id, label, max(least(0.9, score)) AS p FROM dc WHERE applies GROUP BY id, label)
SELECT mt.id, mt.type = 'TÊN_XÉT_NGHIỆM' AS masked, round(CAST(CASE WHEN mt.type = 'TÊN_XÉT_NGHIỆM' THEN 0 ELSE coalesce(n.p, 0) END AS DOUBLE), 6) AS negated, round(CAST(CASE WHEN mt.type = 'TÊN_XÉT_NGHIỆM' THEN 0 ELSE coalesce(f.p, 0) END AS DOUBLE), 6) AS family
FROM mt LEFT JOIN tp n ON n.id = mt.id AND n.label = 'isNegated' LEFT JOIN tp f ON f.id = mt.id AND f.label = 'isFamily'""")
def assertion_application(spark, sf_dir) -> DataFrame:
    """Scope decisions on mentions, capped, and masked for laboratory types."""
    g, s = _gold(spark, sf_dir).where("start % 3 = 0"), F.col("s")
    mt = g.select(F.concat_ws(":", "doc_id", "start").alias("id"), F.when(F.col("type") == "A", assertion.LAB_TYPES[0]).otherwise(F.col("type")).alias("type"), F.col("start").alias("s"))
    row = lambda label, score, applies: mt.select("id", F.lit(label).alias("label"), score.cast("double").alias("score"), applies.alias("applies"))
    dc = row("isNegated", s % 100 / 100.0, s % 2 == 0).unionByName(row("isNegated", s % 37 / 40.0, F.lit(True))).unionByName(row("isFamily", F.lit(0.97), s % 5 == 0))
    p = assertion.apply_decisions(mt.drop("s"), dc)
    return p.select("id", "masked", F.round(F.col("probabilities")["isNegated"], 6).alias("negated"), F.round(F.col("probabilities")["isFamily"], 6).alias("family"))


_LOGIT = "CASE WHEN {0} IS NULL THEN {1} ELSE 0.5 * ln(greatest(least({0}, 1 - 1e-6), 1e-6) / (1 - greatest(least({0}, 1 - 1e-6), 1e-6))) + 0.5 * ({1}) END"


@query(f"""WITH {_GOLD}, r AS (SELECT doc_id, s, type, CAST((s % 41) / 4.0 - 5 AS DOUBLE) AS zn, CAST((s % 29) / 4.0 - 4 AS DOUBLE) AS zf, CAST((s % 23) / 8.0 - 2.5 AS DOUBLE) AS zh, CASE WHEN s % 4 = 0 THEN 0.95::DOUBLE END AS rn FROM gold),
q AS (SELECT *, 1 / (1 + exp(-(({_LOGIT.format('rn', 'zn')}) / 1.5 + 0.1))) AS pn, 1 / (1 + exp(-zf)) AS pf, 1 / (1 + exp(-zh)) AS ph FROM r),
v AS (SELECT *, greatest(coalesce(rn, 0), 0, (pn - 0.5) * 2, (pf - 0.5) * 2, (ph - 0.5) * 2) AS ev FROM q),
rs AS (SELECT type, 'isNegated' AS label, CASE WHEN ev < 0.1 THEN 'abstain:insufficient_evidence' WHEN pn >= 0.9 THEN 'included:threshold' ELSE 'below_threshold' END AS reason FROM v
UNION ALL SELECT type, 'isFamily', CASE WHEN type = 'B' THEN 'hard_mask:type' WHEN ev < 0.1 THEN 'abstain:insufficient_evidence' WHEN pf >= 0.95 THEN 'included:threshold' ELSE 'below_threshold' END FROM v
UNION ALL SELECT type, 'isHistorical', CASE WHEN ev < 0.1 THEN 'abstain:insufficient_evidence' WHEN ph >= 0.9 THEN 'included:threshold' ELSE 'below_threshold' END FROM v)
SELECT type, label, reason, count(*) AS n FROM rs GROUP BY type, label, reason""")
def assertion_engine(spark, sf_dir) -> DataFrame:
    """Decisions of each label, with calibration, evidence, thresholds and a masked type."""
    s = F.col("start")
    put = lambda **m: F.create_map(*(x for k, v in m.items() for x in (F.lit(k), v.cast("double"))))
    rows = _gold(spark, sf_dir).select("type", put(isNegated=s % 41 / 4.0 - 5, isFamily=s % 29 / 4.0 - 4, isHistorical=s % 23 / 8.0 - 2.5).alias("logits"), F.when(s % 4 == 0, put(isNegated=F.lit(0.95))).otherwise(F.create_map().cast("map<string,double>")).alias("rules"))
    d = assertion.decide(rows, 0.5, {"isNegated": 1.5}, {"isNegated": 0.1}, masks={"B": ("isFamily",)})
    return d.select("type", F.explode("decisions").alias("d")).groupBy("type", "d.label", "d.reason").agg(F.count("*").alias("n"))


@query(f"WITH {ENTITIES}, {_pair('s, e, type')} SELECT type, CAST(sum((len(ga) = 0)::INT) AS BIGINT) AS empty_gold, CAST(sum((len(ga) = 0 AND len(pa) > 0)::INT) AS BIGINT) AS false_positives, CASE WHEN sum((len(ga) = 0)::INT) = 0 THEN 0.0 ELSE round(sum((len(ga) = 0 AND len(pa) > 0)::INT) * 1.0 / sum((len(ga) = 0)::INT), 6) END AS rate FROM m WHERE ing AND inp GROUP BY type")
def empty_gold_assertions(spark, sf_dir) -> DataFrame:
    """Assertions predicted where none is expected."""
    both = evaluate.paired(*entities(spark, sf_dir), keys=("start", "end", "type")).where("g is not null and p is not null")
    return assertion.empty_gold_risk(both.select("type", F.col("g.assertions").alias("gold"), F.col("p.assertions").alias("predicted")), ("type",))
