"""Curation queries: profile, privacy, duplicates, splits, leakage, quotas."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.graph import components, shared_key_components
from ..operators.similarity import jaccard_join
from .registry import query, table

HARD, SOFT = 0.72, 0.62


@query(r"""
WITH t AS (SELECT lang, text, regexp_extract_all(text, '[\p{L}\p{N}_]+') AS tk FROM documents)
SELECT lang, count(*) AS n_docs, sum(len(tk)) AS n_tokens, round(avg(length(text)), 6) AS avg_chars,
  round(avg(CASE WHEN len(tk) > 0 THEN len(list_distinct(list_transform(tk, lambda x: lower(x)))) * 1.0 / len(tk) ELSE 0.0 END), 6) AS type_token_ratio,
  sum(len(regexp_extract_all(text, '[^\p{L}\p{N}_\s]'))) AS n_punct,
  sum(len(list_filter(tk, lambda x: regexp_matches(x, '^[A-Z]{2,6}$')))) AS n_abbrev
FROM t GROUP BY lang""")
def doc_text_profile(spark, sf_dir) -> DataFrame:
    """Lengths, type-token ratio, punctuation and abbreviations by language."""
    d = table(spark, sf_dir, "documents").withColumn("tk", T.tokens(F.col("text")))
    ratio = F.size(F.array_distinct(F.transform("tk", F.lower))) / F.greatest(F.size("tk"), F.lit(1))
    return d.groupBy("lang").agg(
        F.count("*").alias("n_docs"), F.sum(F.size("tk")).alias("n_tokens"), F.round(F.avg(F.length("text")), 6).alias("avg_chars"),
        F.round(F.avg(ratio), 6).alias("type_token_ratio"), F.sum(F.regexp_count("text", F.lit(T.PUNCTUATION))).alias("n_punct"),
        F.sum(F.size(F.filter("tk", lambda x: x.rlike(T.ABBREVIATION)))).alias("n_abbrev"),
    )


@query(r"""
SELECT source, sum(len(regexp_extract_all(text, '(?:\+84|0)(?:3|5|7|8|9)\d{8}'))) AS n_phone,
  sum(len(regexp_extract_all(text, '\b(?:\d{9}|\d{12})\b'))) AS n_national_id,
  sum(len(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}'))) AS n_email,
  sum(len(regexp_extract_all(text, '\b\d{1,2}[/-]\d{1,2}[/-](?:19|20)\d{2}\b'))) AS n_birth_date
FROM documents GROUP BY source""")
def privacy_counts(spark, sf_dir) -> DataFrame:
    """Four surface patterns by source, in a simpler form; A42 and P23 are privacy_warnings."""
    d = table(spark, sf_dir, "documents")
    return d.groupBy("source").agg(*(F.sum(F.regexp_count("text", F.lit(p))).alias(f"n_{n}") for n, p in T.PRIVACY.items()))


# Signs around numbers and words are doubled, so that neighbouring hits need not share one.
_AROUND = {
    "phone_like": (r"([^\d+])", r"(?:^|\D)(?:\+84|0)(?:\d(?:[\s.-][\s.-])?){8,10}\d(?:\D|$)"),
    "id_like": (r"([^\d])", r"(?:^|\D)(?:\d{12}|\d{9})(?:\D|$)"),
    "email": ("()", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"),
    "date_of_birth_like": ("()", r"\b(?:0?[1-9]|[12]\d|3[01])[/-](?:0?[1-9]|1[0-2])[/-](?:19\d{2}|20\d{2})\b"),
    "address_like": (r"([^\p{L}\p{N}_])", r"(?i)(?:^|[^\p{L}\p{N}_])(?:số  nhà|đường|phường|quận|hẻm|ngõ|ấp|xã|thôn)(?:[^\p{L}\p{N}_]|$)"),
}
_WARN = ", ".join(rf"CAST(coalesce(sum(len(regexp_extract_all(regexp_replace(text, '{around}', '\1\1', 'g'), '{rx}'))), 0) AS BIGINT) AS {n}_count" for n, (around, rx) in _AROUND.items())


@query(f"WITH c AS (SELECT source, {_WARN} FROM documents GROUP BY source) SELECT *, {' + '.join(f'{n}_count' for n in _AROUND)} AS privacy_warning_count FROM c")
def privacy_warnings(spark, sf_dir) -> DataFrame:
    """Five personal-data patterns by source, and their total."""
    from ..operators.quality import privacy

    return privacy(table(spark, sf_dir, "documents"), "source")


@query(r"""
WITH t AS (SELECT doc_id, list_transform(regexp_extract_all(text, '[\p{L}\p{N}_]+'), lambda x: lower(x)) AS tk FROM documents),
g AS (SELECT doc_id, list_transform(range(1, len(tk)), lambda i: tk[i] || ' ' || tk[i+1]) AS g2,
  list_transform(range(1, len(tk) - 1), lambda i: tk[i] || ' ' || tk[i+1] || ' ' || tk[i+2]) AS g3 FROM t)
SELECT doc_id, len(g2) AS n2, round(CASE WHEN len(g2) > 0 THEN 1 - len(list_distinct(g2)) * 1.0 / len(g2) ELSE 0 END, 6) AS repeat2,
  len(g3) AS n3, round(CASE WHEN len(g3) > 0 THEN 1 - len(list_distinct(g3)) * 1.0 / len(g3) ELSE 0 END, 6) AS repeat3 FROM g""")
def ngram_repetition(spark, sf_dir) -> DataFrame:
    """Share of repeated token 2- and 3-grams."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.transform(T.tokens(F.col("text")), F.lower).alias("tk"))
    g = d.select("doc_id", T.ngrams(F.col("tk"), 2).alias("g2"), T.ngrams(F.col("tk"), 3).alias("g3"))
    rate = lambda c: F.round(F.when(F.size(c) > 0, 1 - F.size(F.array_distinct(c)) / F.greatest(F.size(c), F.lit(1))).otherwise(0.0), 6)
    return g.select("doc_id", F.size("g2").alias("n2"), rate("g2").alias("repeat2"), F.size("g3").alias("n3"), rate("g3").alias("repeat3"))


@query("""
WITH k AS (SELECT doc_id, n_chars, sha256(trim(regexp_replace(lower(text), '[ \\t\\r\\n]+', ' ', 'g'))) AS text_key FROM documents)
SELECT doc_id, text_key, count(*) OVER (PARTITION BY text_key) AS copies,
  first_value(doc_id) OVER (PARTITION BY text_key ORDER BY n_chars DESC, doc_id) AS winner,
  row_number() OVER (PARTITION BY text_key ORDER BY n_chars DESC, doc_id) > 1 AS rejected FROM k""")
def exact_duplicates(spark, sf_dir) -> DataFrame:
    """Equal normalised texts; the longest, then first, wins."""
    from ..operators.curate import reject_exact

    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", F.col("n_chars").alias("score"))
    return reject_exact(d).select(F.col("id").alias("doc_id"), "text_key", "copies", "winner", "rejected")


_SETS = r"""
s AS (SELECT doc_id, list_sort(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'))) AS items FROM documents),
cl AS (SELECT items, min(doc_id) AS class FROM s GROUP BY items),
i AS (SELECT class AS doc_id, len(items) AS n, unnest(items) AS item FROM cl),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, any_value(x.n) AS na, any_value(y.n) AS nb, count(*) AS c FROM i x JOIN i y ON x.item = y.item AND x.doc_id < y.doc_id GROUP BY x.doc_id, y.doc_id),
j AS (SELECT a, b, c * 1.0 / (na + nb - c) AS jaccard FROM p UNION ALL SELECT cl.class, s.doc_id, 1.0 FROM s JOIN cl ON cl.items = s.items WHERE s.doc_id <> cl.class)"""


def _token_sets(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.array_distinct(T.tokens(F.lower("text"))).alias("items"))


@query(f"WITH {_SETS} SELECT a, b, round(jaccard, 6) AS jaccard, jaccard >= {HARD} AS hard FROM j WHERE jaccard >= {SOFT}")
def near_duplicate_pairs(spark, sf_dir) -> DataFrame:
    """Token-set Jaccard, hard and soft: pairs of different sets, and each copy of a set with the first."""
    return jaccard_join(_token_sets(spark, sf_dir), SOFT).select("a", "b", F.round("jaccard", 6).alias("jaccard"), (F.col("jaccard") >= HARD).alias("hard"))


@query(
    f"WITH RECURSIVE {_SETS}, e AS (SELECT a, b FROM j WHERE jaccard >= {HARD} UNION ALL SELECT b, a FROM j WHERE jaccard >= {HARD}), "
    "r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON r.doc_id = e.a) "
    "SELECT doc_id, min(c) AS component, min(c) <> doc_id AS rejected FROM r GROUP BY doc_id"
)
def near_duplicate_components(spark, sf_dir) -> DataFrame:
    """One document of each component of hard pairs stays."""
    ids = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vertex"))
    comp = components(jaccard_join(_token_sets(spark, sf_dir), HARD), ids)
    return comp.select(F.col("vertex").alias("doc_id"), "component", (F.col("component") != F.col("vertex")).alias("rejected"))


@query("""
WITH RECURSIVE k AS (SELECT DISTINCT conv_id, role || ':' || text AS v FROM conversations),
f AS (SELECT v, min(conv_id) AS a FROM k GROUP BY v), e0 AS (SELECT DISTINCT f.a, k.conv_id AS b FROM k JOIN f ON k.v = f.v WHERE f.a <> k.conv_id),
e AS (SELECT a, b FROM e0 UNION SELECT b, a FROM e0),
r AS (SELECT DISTINCT conv_id, conv_id AS c FROM conversations UNION SELECT e.b, r.c FROM r JOIN e ON r.conv_id = e.a),
m AS (SELECT conv_id AS id, min(c) AS component FROM r GROUP BY conv_id)
SELECT m.id, m.component, g.group_id FROM m JOIN (SELECT component AS gc, sha256('["' || string_agg(CAST(id AS VARCHAR), '","' ORDER BY CAST(id AS VARCHAR)) || '"]') AS group_id FROM m GROUP BY component) g ON m.component = g.gc""")
def lineage_groups(spark, sf_dir) -> DataFrame:
    """Conversations that share a turn are one group."""
    c = table(spark, sf_dir, "conversations")
    keys = c.select(F.col("conv_id").alias("id"), F.lit("turn").alias("field"), F.concat_ws(":", "role", "text").alias("value")).distinct()
    return shared_key_components(keys)


@query("""
WITH k AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256(text), doc_id) AS rn, count(*) OVER (PARTITION BY lang) AS n FROM documents)
SELECT doc_id, lang, CASE WHEN rn <= greatest(1, round_even(n * 0.15, 0)) THEN 'validation' ELSE 'train' END AS split FROM k""")
def hash_split(spark, sf_dir) -> DataFrame:
    """By the order of the text hash, the first 15% of each language, halves to even, are for validation."""
    from ..operators.split import hash_rank

    d = table(spark, sf_dir, "documents").select("doc_id", "lang", F.sha2(F.encode("text", "utf-8"), 256).alias("h"))
    limit = F.greatest(F.lit(1.0), F.bround(F.col("n") * 0.15))
    return hash_rank(d, "h", "doc_id", ("lang",)).select("doc_id", "lang", F.when(F.col("rank") <= limit, "validation").otherwise("train").alias("split"))


@query(f"""WITH {_SETS.replace('j AS (SELECT a, b, c * 1.0 / (na + nb - c) AS jaccard FROM p UNION ALL SELECT cl.class, s.doc_id, 1.0 FROM s JOIN cl ON cl.items = s.items WHERE s.doc_id <> cl.class)', 'j AS (SELECT a, b, c * 1.0 / (na + nb - c) AS jaccard FROM p WHERE c * 1.0 / (na + nb - c) >= 0.8 UNION ALL SELECT class, class, 1.0 FROM cl)')},
m AS (SELECT cl.class, s.doc_id % 3 AS split, min(s.doc_id) AS first FROM s JOIN cl ON cl.items = s.items GROUP BY cl.class, s.doc_id % 3)
SELECT x.split AS split_a, y.split AS split_b, x.first AS a, y.first AS b, round(jaccard, 6) AS jaccard FROM j JOIN m x ON x.class = j.a JOIN m y ON y.class = j.b WHERE x.split <> y.split AND (j.a <> j.b OR x.split < y.split)""")
def cross_split_leakage(spark, sf_dir) -> DataFrame:
    """Documents are split by id; those in different splits whose token sets are equal or nearly so, by the
    first document of each set and split."""
    from ..operators.split import leakage

    sets = _token_sets(spark, sf_dir).withColumn("split", F.col("id") % 3)
    return leakage(sets, 0.8).withColumn("jaccard", F.round("jaccard", 6))


@query(r"""
WITH b AS (SELECT item_id, string_split_regex(trim(lower(text)), '[ \t\r\n]+') AS w FROM benchmark), d AS (SELECT doc_id, string_split_regex(trim(lower(text)), '[ \t\r\n]+') AS w FROM documents),
bg AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i+7], ' '))) AS g FROM b),
dg AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i+7], ' '))) AS g FROM d),
n AS (SELECT item_id, count(*) AS n FROM bg GROUP BY item_id)
SELECT dg.doc_id, bg.item_id, count(*) AS shared, round(count(*) * 1.0 / any_value(n.n), 6) AS coverage FROM dg JOIN bg ON dg.g = bg.g JOIN n ON n.item_id = bg.item_id GROUP BY dg.doc_id, bg.item_id""")
def benchmark_contamination(spark, sf_dir) -> DataFrame:
    """Word 8-grams of benchmark items in documents; the grams of both sides meet by hash join."""
    from ..operators.split import contamination

    words = lambda t, i: table(spark, sf_dir, t).select(i, F.split(F.trim(F.lower("text")), r"[ \t\r\n]+").alias("w"))
    return contamination(words("documents", "doc_id"), words("benchmark", "item_id"), 8).withColumn("coverage", F.round("coverage", 6))


@query("""
WITH c AS (SELECT 'documents' AS t, text FROM documents UNION ALL SELECT 'pages', html FROM pages),
n AS (SELECT t, length(text) - length(replace(text, chr(13) || chr(10), chr(10))) AS crlf, length(text) - length(replace(text, chr(13), '')) AS cr, length(text) - length(replace(text, chr(10), '')) AS lf FROM c),
k AS (SELECT t, crlf, cr - crlf AS cr, lf - crlf AS lf FROM n)
SELECT t AS table_name, CASE WHEN (crlf > 0)::INT + (cr > 0)::INT + (lf > 0)::INT > 1 THEN 'mixed' WHEN crlf > 0 THEN 'crlf' WHEN cr > 0 THEN 'cr' WHEN lf > 0 THEN 'lf' ELSE 'none' END AS style, count(*) AS n
FROM k GROUP BY 1, 2""")
def newline_style(spark, sf_dir) -> DataFrame:
    """S02."""
    d = table(spark, sf_dir, "documents").select(F.lit("documents").alias("table_name"), "text")
    p = table(spark, sf_dir, "pages").select(F.lit("pages").alias("table_name"), F.col("html").alias("text"))
    return d.union(p).groupBy("table_name", T.newline_style(F.col("text")).alias("style")).agg(F.count("*").alias("n"))


@query("""
WITH c AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang), t AS (SELECT sum(n) AS total FROM c),
q AS (SELECT lang, n, n * 1000.0 / total AS exact FROM c, t), f AS (SELECT *, floor(exact) AS base FROM q),
r AS (SELECT *, row_number() OVER (ORDER BY exact - base DESC, lang) AS rn, 1000 - sum(base) OVER () AS rest FROM f)
SELECT lang, n, CAST(base + CASE WHEN rn <= rest THEN 1 ELSE 0 END AS BIGINT) AS quota FROM r""")
def quota_apportionment(spark, sf_dir) -> DataFrame:
    """1,000 places by largest remainder. One row a language reaches the windows."""
    from ..operators.split import apportion

    return apportion(table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n")), 1000, "lang")


@query(r"""
WITH t AS (SELECT doc_id, [CASE WHEN n_chars < 200 THEN 'short' END, CASE WHEN n_chars > 5000 THEN 'long' END, CASE WHEN contains(text, chr(10)) THEN 'multiline' END,
 CASE WHEN regexp_matches(text, '\d{3}') THEN 'digits' END, CASE WHEN regexp_matches(text, '[A-Z]{4}') THEN 'upper' END, CASE WHEN regexp_matches(text, '[éèàöüñ]') THEN 'accented' END,
 CASE WHEN contains(text, '?') THEN 'question' END, CASE WHEN contains(text, '"') THEN 'quoted' END, CASE WHEN contains(text, '://') THEN 'url' END] AS tags FROM documents),
e AS (SELECT doc_id, unnest(tags) AS tag FROM t),
b AS (SELECT unnest(['short','long','multiline','digits','upper','accented','question','quoted','url']) AS bucket)
SELECT b.bucket, count(e.doc_id) AS n, coalesce(min(e.doc_id), -1) AS first_id FROM b LEFT JOIN e ON e.tag = b.bucket GROUP BY b.bucket""")
def challenge_buckets(spark, sf_dir) -> DataFrame:
    """Documents by tag; every bucket is listed."""
    rules = {
        "short": F.col("n_chars") < 200, "long": F.col("n_chars") > 5000, "multiline": F.contains("text", F.lit("\n")), "digits": F.col("text").rlike(r"\d{3}"),
        "upper": F.col("text").rlike("[A-Z]{4}"), "accented": F.col("text").rlike("[éèàöüñ]"), "question": F.contains("text", F.lit("?")), "quoted": F.contains("text", F.lit('"')), "url": F.contains("text", F.lit("://")),
    }
    from ..operators.split import buckets

    found = buckets(table(spark, sf_dir, "documents"), rules, "doc_id")
    return found.withColumn("first_id", F.coalesce("first_id", F.lit(-1)))


@query("SELECT sha256(text) AS text_key, min(doc_id) AS doc_id, count(*) AS seen FROM documents GROUP BY sha256(text)")
def seen_hash_dedup(spark, sf_dir) -> DataFrame:
    """The first sample of each text hash."""
    key = F.sha2(F.encode("text", "utf-8"), 256)
    return table(spark, sf_dir, "documents").groupBy(key.alias("text_key")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("seen"))


@query("SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = 1)")
def resume_antijoin(spark, sf_dir) -> DataFrame:
    """Rows without a valid earlier output."""
    done = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return table(spark, sf_dir, "documents").join(done, "doc_id", "left_anti").select("doc_id", "source")


@query("""
WITH s AS (SELECT source, count(*) AS n, sha256(source) AS h FROM documents GROUP BY source), o AS (SELECT *, row_number() OVER (ORDER BY h) AS rn FROM s)
SELECT source, n, rn FROM o""")
def split_group_order(spark, sf_dir) -> DataFrame:
    """Groups in their seeded order, a row each."""
    s = table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n")).withColumn("h", F.sha2(F.encode("source", "utf-8"), 256))
    return s.select("source", "n", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("h")).alias("rn"))


@query(r"""
WITH r AS (SELECT doc_id, list_filter([CASE WHEN length(trim(text)) = 0 THEN 'empty' END, CASE WHEN regexp_matches(text, '[\x{4e00}-\x{9fff}]') THEN 'cjk' END,
 CASE WHEN n_chars <> length(text) THEN 'length' END, CASE WHEN regexp_matches(text, '(\*\*\*|%%%|\$\$\$)') THEN 'noise' END, CASE WHEN upper(text) = text THEN 'shouting' END], lambda x: x IS NOT NULL) AS reasons FROM documents)
SELECT doc_id, array_to_string(reasons, ',') AS reasons, coalesce(reasons[1], 'accepted') AS primary_reason FROM r""")
def batch_rejections(spark, sf_dir) -> DataFrame:
    """Ordered reasons, the first is primary."""
    from ..operators.validate import reasons

    t = F.col("text")
    checks = {"empty": F.length(F.trim(t)) == 0, "cjk": t.rlike(r"[\x{4e00}-\x{9fff}]"), "length": F.col("n_chars") != F.length(t), "noise": t.rlike(r"(\*\*\*|%%%|\$\$\$)"), "shouting": F.upper(t) == t}
    r = table(spark, sf_dir, "documents").select("doc_id", reasons(checks).alias("reasons"))
    return r.select("doc_id", F.array_join("reasons", ",").alias("reasons"), F.coalesce(F.try_element_at("reasons", F.lit(1)), F.lit("accepted")).alias("primary_reason"))


_FOLD = """
WITH RECURSIVE s AS (SELECT source, count(*) AS n, sha256('17:' || source) AS h FROM documents GROUP BY source), o AS (SELECT source, n, row_number() OVER (ORDER BY h) AS k FROM s),
t AS (SELECT sum(n) AS total FROM s),
f AS (SELECT CAST(0 AS BIGINT) AS k, CAST(NULL AS VARCHAR) AS source, '' AS split, CAST(0 AS DOUBLE) AS train, CAST(0 AS DOUBLE) AS dev, CAST(0 AS DOUBLE) AS test
UNION ALL SELECT z.k, z.source, z.split, z.train + CASE WHEN z.split = 'train' THEN z.n ELSE 0 END, z.dev + CASE WHEN z.split = 'dev' THEN z.n ELSE 0 END, z.test + CASE WHEN z.split = 'test' THEN z.n ELSE 0 END FROM (
 SELECT o.k, o.source, o.n, f.train, f.dev, f.test, CASE WHEN o.k = 1 THEN 'train' WHEN o.k = 2 THEN 'dev' WHEN o.k = 3 THEN 'test'
  WHEN (f.train / (t.total * 0.6), f.train, 0) < (f.dev / (t.total * 0.2), f.dev, 1) AND (f.train / (t.total * 0.6), f.train, 0) < (f.test / (t.total * 0.2), f.test, 2) THEN 'train'
  WHEN (f.dev / (t.total * 0.2), f.dev, 1) < (f.test / (t.total * 0.2), f.test, 2) THEN 'dev' ELSE 'test' END AS split FROM f JOIN o ON o.k = f.k + 1, t) z)
SELECT d.doc_id, d.source, f.split FROM documents d JOIN f ON f.source = d.source"""


@query(_FOLD)
def grouped_split(spark, sf_dir) -> DataFrame:
    """Whole sources in train, dev and test, by a seeded fold over their sizes."""
    from ..operators.split import grouped_split as split

    return split(table(spark, sf_dir, "documents").select("doc_id", "source"), "source").select("doc_id", "source", "split")


_PROFILES = ("basic", "repeated_mention", "long_note", "mixed_language")
_SAMPLES = """
d AS (SELECT doc_id AS id, text, ['basic', 'repeated_mention', 'long_note', 'mixed_language'][doc_id % 4 + 1] AS profile, doc_id % 3 = 0 AS asserted, length(trim(text)) = 0 OR n_chars > 20000 AS failed FROM documents),
sc AS (SELECT *, 100 + CASE WHEN profile IN ('repeated_mention', 'abbreviation_or_typo', 'mixed_language', 'lab_name_result_pair') THEN 20 ELSE 0 END + CASE WHEN asserted THEN 5 ELSE 0 END + CASE WHEN profile <> 'basic' THEN 5 ELSE 0 END AS score FROM d)"""
_CURATED = rf"""{_SAMPLES},
ok AS (SELECT *, trim(regexp_replace(lower(text), '[ \t\r\n]+', ' ', 'g')) AS norm FROM sc WHERE NOT failed),
ex AS (SELECT *, first_value(id) OVER (PARTITION BY norm ORDER BY score DESC, id) AS winner FROM ok), fr AS (SELECT * FROM ex WHERE id = winner),
st AS (SELECT id, list_sort(list_distinct(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+'))) AS items FROM fr), it AS (SELECT id, len(items) AS n, unnest(items) AS item FROM st),
pr AS (SELECT x.id AS a, y.id AS b, count(*) * 1.0 / (any_value(x.n) + any_value(y.n) - count(*)) AS j FROM it x JOIN it y ON x.item = y.item AND x.id < y.id GROUP BY x.id, y.id),
hp AS (SELECT a, b FROM pr WHERE j >= 0.72 UNION ALL SELECT b, a FROM pr WHERE j >= 0.72),
rr AS (SELECT id, id AS c FROM fr UNION SELECT hp.b, rr.c FROM rr JOIN hp ON hp.a = rr.id), cm AS (SELECT id, min(c) AS component FROM rr GROUP BY id),
bs AS (SELECT fr.*, first_value(fr.id) OVER (PARTITION BY component ORDER BY score DESC, fr.id) AS best FROM fr JOIN cm ON cm.id = fr.id),
sp AS (SELECT id, count(*) AS soft_pairs FROM (SELECT a AS id FROM pr WHERE j >= 0.62 AND j < 0.72 UNION ALL SELECT b FROM pr WHERE j >= 0.62 AND j < 0.72) GROUP BY id),
gd AS (SELECT id, row_number() OVER (ORDER BY sha256(text), id) AS rn, count(*) OVER () AS n FROM bs WHERE id = best AND profile IN ('repeated_mention', 'mixed_language')),
cu AS (SELECT bs.id, bs.score, CASE WHEN bs.id <> best THEN 'hard_near_duplicate' WHEN gd.id IS NULL THEN 'standard' WHEN rn <= greatest(1, round_even(n * 0.15, 0)) THEN 'gold_validation' ELSE 'gold_train' END AS status, best AS winner, coalesce(soft_pairs, 0) AS soft_pairs FROM bs LEFT JOIN gd ON gd.id = bs.id LEFT JOIN sp ON sp.id = bs.id
UNION ALL SELECT id, score, 'exact_duplicate', winner, 0 FROM ex WHERE id <> winner UNION ALL SELECT id, score, 'validation_failed', NULL, 0 FROM sc WHERE failed)"""


def _samples(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    profile = F.element_at(F.array(*map(F.lit, _PROFILES)), (F.col("doc_id") % 4 + 1).cast("int"))
    failed = (F.length(F.trim("text")) == 0) | (F.col("n_chars") > 20000)
    return d.select(F.col("doc_id").alias("id"), "text", profile.alias("profile"), (F.col("doc_id") % 3 == 0).alias("asserted"), F.when(failed, F.array(F.lit("bad"))).otherwise(F.array().cast("array<string>")).alias("errors"))


@query(f"WITH RECURSIVE {_CURATED} SELECT id, score, status, winner, soft_pairs FROM cu")
def curated_samples(spark, sf_dir) -> DataFrame:
    """Documents as samples with profiles, through the whole curation."""
    from ..operators.curate import curate

    return curate(_samples(spark, sf_dir))


@query(f"""WITH RECURSIVE {_CURATED} SELECT name, n FROM (SELECT count(*) AS input, count(*) FILTER (status LIKE 'gold%') AS gold, count(*) FILTER (status = 'gold_train') AS gold_train, count(*) FILTER (status = 'gold_validation') AS gold_validation, count(*) FILTER (status = 'standard') AS standard,
count(*) FILTER (status IN ('validation_failed', 'exact_duplicate', 'hard_near_duplicate')) AS rejected, count(*) FILTER (status = 'validation_failed') AS "rejected.validation_failed", count(*) FILTER (status = 'exact_duplicate') AS "rejected.exact_duplicate", count(*) FILTER (status = 'hard_near_duplicate') AS "rejected.hard_near_duplicate" FROM cu) UNPIVOT (n FOR name IN (COLUMNS(*)))""")
def curation_report(spark, sf_dir) -> DataFrame:
    """Counts of the curation."""
    from ..operators import curate

    return curate.curation_report(curate.curate(_samples(spark, sf_dir)))


@query(f"WITH {_SAMPLES} SELECT score, count(*) AS n, min(id) AS first_id FROM sc GROUP BY score")
def quality_points(spark, sf_dir) -> DataFrame:
    """Additive quality score of samples."""
    from ..operators.curate import quality_score

    return _samples(spark, sf_dir).groupBy(quality_score(F.col("profile"), F.col("asserted")).alias("score")).agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


@query("""
WITH r AS (SELECT source AS fold_id, lang AS seed, avg((n_chars % 100) / 100.0) AS encoder, avg((doc_id % 100) / 100.0) AS baseline FROM documents GROUP BY source, lang)
SELECT count(*) AS run_count, round(avg(encoder), 6) AS mean_encoder, round(avg(baseline), 6) AS mean_baseline, round(avg(encoder) - avg(baseline), 6) AS mean_delta FROM r""")
def fold_aggregate(spark, sf_dir) -> DataFrame:
    """Means and delta over runs, one for each fold and seed."""
    from ..operators.curate import fold_seed_means

    d = table(spark, sf_dir, "documents")
    runs = d.groupBy(F.col("source").alias("fold_id"), F.col("lang").alias("seed")).agg(F.avg(F.col("n_chars") % 100 / 100.0).alias("encoder"), F.avg(F.col("doc_id") % 100 / 100.0).alias("baseline"))
    return fold_seed_means(runs)
