"""Span queries over words of documents as derived entities."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import evaluate, spans
from .registry import query, table

_GOLD = """
w AS (SELECT doc_id, unnest(string_split(text, ' ')) AS word, unnest(range(1, len(string_split(text, ' ')) + 1)) AS i FROM documents),
o AS (SELECT doc_id, word, CAST(sum(length(word) + 1) OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) - length(word) - 1 AS s FROM w),
gold AS (SELECT doc_id, s, s + length(word) AS e, word AS text, ['A','B','C'][length(word) % 3 + 1] AS type FROM o WHERE length(word) >= 9),
pred AS (SELECT doc_id, s, CASE WHEN k = 1 THEN e - 1 ELSE e END AS e, CASE WHEN k = 2 THEN 'A' ELSE type END AS type, k FROM (SELECT *, (doc_id * 7 + s * 13) % 10 AS k FROM gold) WHERE k <> 0)"""


def _gold(spark, sf_dir) -> DataFrame:
    """Words of nine characters or more, typed by length."""
    kind = F.element_at(F.array(F.lit("A"), F.lit("B"), F.lit("C")), (F.length("text") % 3 + 1).cast("int"))
    return spans.pattern_spans(table(spark, sf_dir, "documents"), "[^ ]{9,}").withColumn("type", kind)


def _pred(gold: DataFrame, *more: str) -> DataFrame:
    """A tenth dropped, a tenth cut, a tenth retyped."""
    k = (F.col("doc_id") * 7 + F.col("start") * 13) % 10
    p = gold.withColumn("k", k).where("k <> 0")
    return p.select("doc_id", "start", F.when(F.col("k") == 1, F.col("end") - 1).otherwise(F.col("end")).alias("end"), F.when(F.col("k") == 2, "A").otherwise(F.col("type")).alias("type"), *more)


_ALIGNED = "a AS (SELECT coalesce(g.type, p.type) AS type, g.doc_id IS NOT NULL AS ing, p.doc_id IS NOT NULL AS inp FROM gold g FULL JOIN pred p ON g.doc_id = p.doc_id AND g.s = p.s AND g.e = p.e AND g.type = p.type)"
_P, _R = "CASE WHEN tp + fp = 0 THEN 1.0 ELSE tp * 1.0 / (tp + fp) END", "CASE WHEN tp + fn = 0 THEN 1.0 ELSE tp * 1.0 / (tp + fn) END"
_PRF = f"round({_P}, 6) AS precision, round({_R}, 6) AS recall, round(CASE WHEN {_P} + {_R} = 0 THEN 0 ELSE 2 * {_P} * {_R} / ({_P} + {_R}) END, 6) AS f1"
_COUNT = "CAST(sum((ing AND inp)::INT) AS BIGINT) AS tp, CAST(sum((NOT ing)::INT) AS BIGINT) AS fp, CAST(sum((NOT inp)::INT) AS BIGINT) AS fn"


def _aligned(spark, sf_dir) -> DataFrame:
    gold = _gold(spark, sf_dir)
    return evaluate.multiset_align(gold, _pred(gold), ["doc_id", "start", "end", "type"], "start")


@query(f"WITH {_GOLD}, {_ALIGNED}, c AS (SELECT {_COUNT} FROM a) SELECT tp, fp, fn, {_PRF} FROM c")
def score_entities(spark, sf_dir) -> DataFrame:
    """J01, A01, A12."""
    return evaluate.counted(_aligned(spark, sf_dir), [])


@query(f"WITH {_GOLD}, {_ALIGNED}, c AS (SELECT type, {_COUNT} FROM a GROUP BY type) SELECT type, tp, fp, fn, {_PRF} FROM c")
def type_metrics(spark, sf_dir) -> DataFrame:
    """A04."""
    return evaluate.counted(_aligned(spark, sf_dir), ["type"])


@query(f"""WITH {_GOLD},
m AS (SELECT g.* FROM gold g WHERE NOT EXISTS (SELECT 1 FROM pred p WHERE p.doc_id = g.doc_id AND p.s = g.s AND p.e = g.e AND p.type = g.type)),
x AS (SELECT p.* FROM pred p WHERE NOT EXISTS (SELECT 1 FROM gold g WHERE p.doc_id = g.doc_id AND p.s = g.s AND p.e = g.e AND p.type = g.type)),
n AS (SELECT m.doc_id, m.s, m.type, bool_or(p.type = m.type) AS same, count(p.doc_id) > 0 AS touched FROM m LEFT JOIN pred p ON p.doc_id = m.doc_id AND p.s < m.e AND m.s < p.e GROUP BY m.doc_id, m.s, m.type),
y AS (SELECT x.doc_id, x.s, x.type, count(g.doc_id) AS c FROM x LEFT JOIN gold g ON g.doc_id = x.doc_id AND g.s < x.e AND x.s < g.e GROUP BY x.doc_id, x.s, x.type)
SELECT type, CASE WHEN same THEN 'boundary' WHEN touched THEN 'type' ELSE 'missing' END AS error, count(*) AS n FROM n GROUP BY 1, 2
UNION ALL SELECT type, CASE WHEN c > 0 THEN 'partial' ELSE 'spurious' END, count(*) FROM y GROUP BY 1, 2""")
def error_taxonomy(spark, sf_dir) -> DataFrame:
    """A04, J04."""
    gold = _gold(spark, sf_dir)
    return evaluate.error_classes(gold, _pred(gold)).groupBy("type", "error").agg(F.count("*").alias("n"))


@query(f"WITH {_GOLD} SELECT g.doc_id, count(*) AS pairs, CAST(sum(least(g.e, p.e + 5) - greatest(g.s, p.s + 5)) AS BIGINT) AS shared FROM gold g JOIN pred p ON g.doc_id = p.doc_id AND g.s < p.e + 5 AND p.s + 5 < g.e GROUP BY g.doc_id")
def overlap_pairs(spark, sf_dir) -> DataFrame:
    """Gold spans against predictions moved by five characters."""
    gold = _gold(spark, sf_dir)
    moved = _pred(gold).select("doc_id", (F.col("start") + 5).alias("r_start"), (F.col("end") + 5).alias("r_end"))
    shared = F.least("end", "r_end") - F.greatest("start", "r_start")
    return spans.overlap_join(gold, moved).groupBy("doc_id").agg(F.count("*").alias("pairs"), F.sum(shared).alias("shared"))


@query(f"WITH {_GOLD} SELECT type, count(*) AS n, CAST(sum((substring(d.text, CAST(s + 1 AS INT), CAST(e - s AS INT)) <> g.text)::INT) AS BIGINT) AS bad, count(DISTINCT (g.doc_id, s)) AS n_distinct FROM gold g JOIN documents d ON d.doc_id = g.doc_id GROUP BY type")
def structural_fidelity(spark, sf_dir) -> DataFrame:
    """Counts by type and spans that do not hold their surface."""
    return spans.fidelity(_gold(spark, sf_dir), table(spark, sf_dir, "documents").select("doc_id", "text"))


@query(f"""WITH {_GOLD}, cue AS (SELECT doc_id, s AS cs, s + length(word) AS ce, word FROM o WHERE word IN ('not', 'for', 'with', 'sin', 'ohne', 'pas', 'que', 'und')),
r AS (SELECT g.doc_id, g.s, c.word, g.s - c.ce AS gap, row_number() OVER (PARTITION BY g.doc_id, g.s ORDER BY c.cs DESC) AS rn FROM gold g JOIN cue c ON c.doc_id = g.doc_id AND c.cs < g.s)
SELECT word AS cue, count(*) AS n, CAST(sum((gap <= 40)::INT) AS BIGINT) AS in_scope FROM r WHERE rn = 1 GROUP BY word""")
def scope_association(spark, sf_dir) -> DataFrame:
    """Each entity with the last cue before it; in scope up to 40 characters on."""
    cues = "not|for|with|sin|ohne|pas|que|und"
    words = spans.pattern_spans(table(spark, sf_dir, "documents"), rf"(?:(?<= )|(?<![^\x00]))(?:{cues})(?= |\Z)")
    near = spans.nearest_before(_gold(spark, sf_dir).select("doc_id", "start"), words.select("doc_id", "start", F.struct("text", "end").alias("cue")), "doc_id", "start", "cue")
    found = near.where("nearest_cue is not null")
    return found.groupBy(F.col("nearest_cue.text").alias("cue")).agg(F.count("*").alias("n"), F.count_if(F.col("start") - F.col("nearest_cue.end") <= 40).alias("in_scope"))


@query("""
WITH p AS (SELECT user_id, event_id, ts FROM events WHERE event_type = 'purchase'), v AS (SELECT user_id, event_id, ts FROM events WHERE event_type = 'view'),
r AS (SELECT p.event_id, v.event_id AS view_id, v.ts AS view_ts, p.ts, row_number() OVER (PARTITION BY p.event_id ORDER BY v.ts DESC, v.event_id DESC) AS rn FROM p JOIN v ON v.user_id = p.user_id AND v.ts <= p.ts)
SELECT event_id, view_ts FROM r WHERE rn = 1""")
def nearest_pairing(spark, sf_dir) -> DataFrame:
    """Each purchase with the time of its user's last view."""
    e = table(spark, sf_dir, "events")
    near = spans.nearest_before(e.where("event_type = 'purchase'").select("user_id", "event_id", "ts"), e.where("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("view")), "user_id", "ts", "view")
    return near.where("nearest_view is not null").select("event_id", F.col("nearest_ts").alias("view_ts"))


#: Each document under two headings: its first line as history, then all its lines as items of a medication list.
_HEADED = r"""
l AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents),
h AS (SELECT doc_id, lines, 22 + length(lines[1]) + 1 AS second, 22 + length(lines[1]) + 1 + 11 + 1 AS body FROM l),
it AS (SELECT doc_id, second, body, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS i FROM h),
ps AS (SELECT *, body + CAST(coalesce(sum(length(line) + 3) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS s FROM it)"""


def _headed(spark, sf_dir, *kinds: str) -> DataFrame:
    from ..operators.infer import structure_units as kernel

    lines = F.split("text", "\n")
    text = F.concat(F.lit("Past medical history:\n"), lines[0], F.lit("\nMedications\n- "), F.array_join(lines, "\n- "))
    return kernel(table(spark, sf_dir, "documents").select("doc_id", text.alias("text")), kinds)


@query(f"""WITH {_HEADED}, e AS (SELECT doc_id, max(s + 2 + length(line)) AS last FROM ps GROUP BY doc_id)
SELECT doc_id, 'medical_history' AS label, CAST(0 AS BIGINT) AS start, CAST(21 AS BIGINT) AS heading_end, CAST(second AS BIGINT) AS "end" FROM h
UNION ALL SELECT h.doc_id, 'medication_history', CAST(second AS BIGINT), CAST(second + 11 AS BIGINT), CAST(last AS BIGINT) FROM h JOIN e ON e.doc_id = h.doc_id""")
def sections(spark, sf_dir) -> DataFrame:
    """Sections from their heading to the next one."""
    u = _headed(spark, sf_dir, "section")
    return u.select("doc_id", "label", *(F.col(c).cast("long").alias(c) for c in ("start", "heading_end", "end")))


@query(rf"""WITH {_HEADED} SELECT doc_id, count(*) AS n, CAST(sum(s) AS BIGINT) AS starts, CAST(sum(2 + length(regexp_replace(line, '\s+$', ''))) AS BIGINT) AS chars FROM ps WHERE regexp_matches(line, '\S') GROUP BY doc_id""")
def list_items(spark, sf_dir) -> DataFrame:
    """The items of the list in the second section."""
    second = _headed(spark, sf_dir, "section").where("label = 'medication_history'").select("doc_id", F.col("start").alias("from"))
    items = _headed(spark, sf_dir, "list_item").where("label = 'bullet'").join(second, "doc_id").where("start >= from")
    return items.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("start").alias("starts"), F.sum(F.col("end") - F.col("start")).alias("chars"))


# On a line of pairs that overlap their neighbours alone, a pair is taken if it stands an even number of steps from the
# top of the slope on either side.
@query("""
WITH w AS (SELECT doc_id, unnest(string_split(text, ' ')) AS word, unnest(range(1, len(string_split(text, ' ')) + 1)) AS i, len(string_split(text, ' ')) AS n FROM documents),
o AS (SELECT doc_id, word, i, n, CAST(sum(length(word) + 1) OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) - length(word) - 1 AS s FROM w),
f AS (SELECT doc_id, s, s + length(word) AS e, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM o WHERE length(word) > 0 AND i < n),
p AS (SELECT doc_id, s, k, lead(e) OVER (PARTITION BY doc_id ORDER BY k) - s AS size FROM f), c AS (SELECT * FROM p WHERE size >= 18),
m AS (SELECT *, coalesce(lag(k) OVER d = k - 1 AND lag(size) OVER d >= size, false) AS l, coalesce(lead(k) OVER d = k + 1 AND lead(size) OVER d > size, false) AS r FROM c WINDOW d AS (PARTITION BY doc_id ORDER BY k)),
t AS (SELECT *, k - max(CASE WHEN NOT l THEN k END) OVER (PARTITION BY doc_id ORDER BY k) AS dl, min(CASE WHEN NOT r THEN k END) OVER (PARTITION BY doc_id ORDER BY k DESC) - k AS dr FROM m)
SELECT doc_id, count(*) AS n, CAST(sum(size) AS BIGINT) AS chars FROM t WHERE dl % 2 = 0 AND dr % 2 = 0 GROUP BY doc_id""")
def greedy_spans(spark, sf_dir) -> DataFrame:
    """Overlapping candidate spans of word pairs, longest first."""
    pairs = spans.pattern_spans(table(spark, sf_dir, "documents"), r"[^ ]+(?= )")
    nxt = F.lead("end").over(Window.partitionBy("doc_id").orderBy("start"))
    both = pairs.withColumn("end", nxt).where("end is not null and end - start >= 18")
    return spans.greedy_non_overlap(both).groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.col("end") - F.col("start")).alias("chars"))


#: Words of the driver's texts that stand in for concepts, and cues of its languages.
CONCEPTS = {"insult": ("idiot", "moron", "clown", "scum"), "judgement": ("worthless", "pathetic")}
DRIVER_CUES = (
    ("isNegated", "not|no|pas|ohne|sin", ("clause", "sentence", "list_item", "section"), True),
    ("isHistorical", "was|were|war|était", ("list_item", "section"), False),
)


_EDGE = r"[^\p{L}\p{N}]"
# A mention is negated by a cue before it in its clause, and historical after a cue anywhere in the document. (No text of
# the tables has the headings or bullets that other scopes start from.) A clause starts at a clause word, or where the sentence starts; stops in numbers and after
# abbreviations end no sentence, and are blanked out.
_ENTITY_SQL = rf"""
al AS (SELECT unnest(string_split('idiot|moron|clown|scum|worthless|pathetic', '|')) AS alias),
parts AS (SELECT doc_id, text, alias, string_split(lower(text), alias) AS p FROM documents, al WHERE contains(lower(text), alias)),
hits AS (SELECT doc_id, text, alias, unnest(list_transform(range(1, len(p)), lambda i: CAST(list_sum(list_transform(p[1:i], lambda x: length(x))) + (i - 1) * length(alias) AS BIGINT))) AS s FROM parts),
ok AS (SELECT *, s + length(alias) AS e, substring(text, 1, CAST(s AS INT)) AS before, substring(text, CAST(s + length(alias) + 1 AS INT), 1) AS after FROM hits),
mn AS (SELECT * FROM ok WHERE (before = '' OR regexp_matches(right(before, 1), '{_EDGE}')) AND (after = '' OR regexp_matches(after, '{_EDGE}'))),
st AS (SELECT *, regexp_extract(regexp_replace(regexp_replace(regexp_replace(before, '(\d)\.(\d)', '\1,\2', 'g'), '(\d)\.(\d)', '\1,\2', 'g'), '(?i)((?:^|[^\p{{L}}\p{{N}}_])(?:bs|dr|mr|mrs|ms|vs|p|ts|mg|ml|mcg|hr|min|eg|ie))\.', '\1,', 'g'), '[^.!?;\r\n]*$') AS sentence FROM mn),
cl AS (SELECT *, regexp_replace(' ' || regexp_replace(sentence, '"[^"]*"', '', 'g'), '(?is)^.*[^\p{{L}}\p{{N}}_](?:nhưng|tuy nhiên|còn|but|however|và|hoặc|and|or)([^\p{{L}}\p{{N}}_])', '\1') AS clause FROM st),
en AS (SELECT doc_id, CAST(s AS INT) AS start, CAST(e AS INT) AS "end", substring(text, CAST(s + 1 AS INT), CAST(e - s AS INT)) AS text, CASE WHEN alias IN ('worthless', 'pathetic') THEN 'judgement' ELSE 'insult' END AS type,
 concat_ws(',', CASE WHEN regexp_matches(' ' || regexp_replace(before, '"[^"\r\n]*"', '', 'g'), '(?i)[^\p{{L}}\p{{N}}_](?:was|were|war|était)[^\p{{L}}\p{{N}}_]') THEN 'isHistorical' END,
 CASE WHEN regexp_matches(clause, '(?i)[^\p{{L}}\p{{N}}_](?:not|no|pas|ohne|sin)[^\p{{L}}\p{{N}}_]') THEN 'isNegated' END) AS assertions FROM cl)"""


@query(f'WITH {_ENTITY_SQL} SELECT doc_id, start, "end", text, type, assertions FROM en')
def infer_entities(spark, sf_dir) -> DataFrame:
    """The flagship: documents to entities with assertions."""
    from ..operators.infer import entities

    found = entities(table(spark, sf_dir, "documents"), CONCEPTS, DRIVER_CUES)
    return found.withColumn("assertions", F.array_join("assertions", ","))


@query(f"WITH {_ENTITY_SQL} SELECT type, assertions, count(*) AS n, count(DISTINCT doc_id) AS docs FROM en GROUP BY type, assertions")
def entity_counts(spark, sf_dir) -> DataFrame:
    """Mentions by type and assertion."""
    return infer_entities(spark, sf_dir).groupBy("type", "assertions").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("docs"))


@query("""
SELECT doc_id, 'collapsed' AS view, CAST(length(text) AS BIGINT) AS raw_length, CAST(length(regexp_replace(text, '\\s+', ' ', 'g')) AS BIGINT) AS view_length,
 CAST(coalesce(list_sum(list_filter(range(1, length(text) + 1), lambda p: NOT (contains(' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), text[p]) AND p < length(text) AND contains(' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), text[p + 1])))), 0) AS BIGINT) AS bound_sum FROM documents""")
def text_views(spark, sf_dir) -> DataFrame:
    """Length of the last view, of the raw text that its boundaries reach, and the sum of all boundaries."""
    from ..operators.infer import text_views as kernel

    v = kernel(table(spark, sf_dir, "documents"), ("collapsed",))
    return v.select("doc_id", "view", F.element_at("bounds", -1).cast("long").alias("raw_length"), (F.size("bounds") - 1).cast("long").alias("view_length"), F.aggregate("bounds", F.lit(0).cast("long"), lambda a, b: a + b).alias("bound_sum"))


# Stops in numbers and after abbreviations end no sentence, and are blanked out. Signs that are no letters are doubled, so
# that clause words next to each other are both counted; one at the very start of a sentence begins no other clause.
@query(r"""
WITH b AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '(\d)\.(\d)', '\1,\2', 'g'), '(\d)\.(\d)', '\1,\2', 'g'), '(?i)((?:^|[^\p{L}\p{N}_])(?:bs|dr|mr|mrs|ms|vs|p|ts|mg|ml|mcg|hr|min|eg|ie))\.', '\1,', 'g') AS t FROM documents),
s AS (SELECT doc_id, unnest(list_filter(list_transform(regexp_extract_all(t, '[^.!?;\r\n]*(?:[!?;]+|\.|\r\n|\r|\n)|[^.!?;\r\n]+$'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')) AS x FROM b),
c AS (SELECT doc_id, length(x) AS chars, len(regexp_extract_all(regexp_replace(x, '([^\p{L}\p{N}_])', '\1\1', 'g'), '(?i)[^\p{L}\p{N}_](?:nhưng|tuy  nhiên|còn|but|however|và|hoặc|and|or)(?:[^\p{L}\p{N}_]|$)')) AS cues FROM s)
SELECT doc_id, 'sentence' AS kind, count(*) AS n, CAST(sum(chars) AS BIGINT) AS chars FROM c GROUP BY doc_id UNION ALL SELECT doc_id, 'clause', CAST(sum(1 + cues) AS BIGINT), CAST(sum(chars) AS BIGINT) FROM c GROUP BY doc_id""")
def structure_units(spark, sf_dir) -> DataFrame:
    """Units by kind."""
    from ..operators.infer import structure_units as kernel

    u = kernel(table(spark, sf_dir, "documents"))
    return u.groupBy("doc_id", "kind").agg(F.count("*").alias("n"), F.sum(F.col("end") - F.col("start")).alias("chars"))


@query(f"""WITH {_GOLD}, j AS (SELECT CASE WHEN g.e = p.e AND g.type = p.type THEN 1 WHEN g.e = p.e THEN 2 WHEN g.type = p.type THEN 3 ELSE 4 END AS tier FROM gold g JOIN pred p ON p.doc_id = g.doc_id AND p.s = g.s)
SELECT tier, count(*) AS n FROM j GROUP BY tier""")
def annotator_agreement(spark, sf_dir) -> DataFrame:
    """Pairs of two annotators by tier."""
    from ..operators.decode import four_tier_alignment

    gold = _gold(spark, sf_dir)
    side = lambda df: df.select(F.col("doc_id").alias("sample_id"), F.col("start").alias("i"), "start", "end", "type")
    return four_tier_alignment(side(gold), side(_pred(gold))).groupBy("tier").agg(F.count("*").alias("n"))


@query(f"WITH {_GOLD} SELECT doc_id, count(*) AS n, 'exact_raw' AS method, CAST(sum(s) AS BIGINT) AS starts FROM gold WHERE length(text) >= 24 GROUP BY doc_id")
def grounding(spark, sf_dir) -> DataFrame:
    """Long words are found where they are expected."""
    from ..operators.infer import grounded

    long = _gold(spark, sf_dir).where(F.length("text") >= 24)
    proposals = long.select("doc_id", F.col("text").alias("surface"), F.col("start").cast("int").alias("expected_start"), F.col("end").cast("int").alias("expected_end"))
    return grounded(proposals, table(spark, sf_dir, "documents")).groupBy("doc_id", "method").agg(F.count("*").alias("n"), F.sum("start").alias("starts"))


@query(f"""WITH {_GOLD}, i AS (SELECT (doc_id + s) % 100 / 100.0 AS sp, (doc_id * 3 + s) % 100 / 100.0 AS x, s % 10 / 10.0 AS n, s % 7 / 7.0 AS c FROM pred),
u AS (SELECT CASE WHEN x > 0.5 THEN 'A' ELSE 'B' END AS type, n >= 0.55 AS labelled, c >= 0.7 AS coded,
 (2 * sp - 1) + (2 * greatest(x, 1 - x) - 1) + CASE WHEN n >= 0.55 THEN 2 * n - 1 ELSE 0 END + CASE WHEN c >= 0.7 THEN 3 * c - 2 ELSE 0 END AS u FROM i)
SELECT type, count(*) AS n, CAST(sum(labelled::INT) AS BIGINT) AS labelled, CAST(sum(coded::INT) AS BIGINT) AS coded, round(sum(u), 4) AS utility FROM u WHERE u >= 0.0051 GROUP BY type""")
def joint_decode(spark, sf_dir) -> DataFrame:
    """Expected utilities of hypotheses that do not overlap."""
    from ..operators.decode import utility_decode

    x = (F.col("doc_id") * 3 + F.col("start")) % 100 / 100.0
    items = _pred(_gold(spark, sf_dir)).select(
        "doc_id", F.col("start").cast("string").alias("id"), "start", "end", ((F.col("doc_id") + F.col("start")) % 100 / 100.0).alias("span_p"),
        F.create_map(F.lit("A"), x, F.lit("B"), 1 - x).alias("types"), F.create_map(F.lit("n"), F.col("start") % 10 / 10.0).alias("assertions"), F.create_map(F.lit("c"), F.col("start") % 7 / 7.0).alias("candidates"),
    )
    weights = dict(span=1.0, wrong_span=1.0, type=1.0, wrong_type=1.0, label=1.0, wrong_label=1.0, label_bar=0.55, code=1.0, wrong_code=2.0, code_bar=0.7)
    d = utility_decode(items, {"A": 0.1, "B": 0.1}, weights, 0.0051)
    return d.groupBy("type").agg(F.count("*").alias("n"), F.count_if(F.size("assertions") > 0).alias("labelled"), F.count_if(F.col("candidates").isNotNull()).alias("coded"), F.round(F.sum("utility"), 4).alias("utility"))


_TWO = """b AS (SELECT doc_id, 'g' || s AS id, s, e, type, text, s % 100 / 100.0 AS u FROM gold UNION ALL SELECT p.doc_id, 'p' || p.s, p.s, p.e, p.type, CASE WHEN k = 1 THEN left(g.text, length(g.text) - 1) ELSE g.text END, (p.s + 37) % 100 / 100.0 FROM pred p JOIN gold g ON g.doc_id = p.doc_id AND g.s = p.s),
d AS (SELECT *, id <> min(id) OVER (PARTITION BY doc_id, s, e, type, text) AS copy FROM b),
ov AS (SELECT x.doc_id, x.id, y.id AS foe, CASE WHEN x.type = y.type THEN 'forbid' WHEN least(x.type, y.type) = 'A' AND greatest(x.type, y.type) = 'B' THEN 'allow' END AS action FROM d x JOIN d y ON x.doc_id = y.doc_id AND x.s < y.e AND y.s < x.e AND x.id <> y.id),
u1 AS (SELECT d.*, EXISTS (SELECT 1 FROM ov WHERE ov.doc_id = d.doc_id AND ov.id = d.id AND ov.action IS NULL) AS unknown FROM d),
live AS (SELECT * FROM u1 WHERE NOT copy AND NOT unknown),
lost AS (SELECT DISTINCT x.doc_id, x.id FROM live x JOIN ov ON ov.doc_id = x.doc_id AND ov.id = x.id AND ov.action = 'forbid' JOIN live y ON y.doc_id = ov.doc_id AND y.id = ov.foe AND (y.u > x.u OR (y.u = x.u AND (y.s, y.e, y.type, y.text, y.id) < (x.s, x.e, x.type, x.text, x.id)))),
r AS (SELECT u1.doc_id, u1.type, u1.id, u1.s, u1.e, CASE WHEN copy THEN 'exact_duplicate' WHEN unknown THEN 'unsupported_overlap' WHEN l.id IS NOT NULL THEN 'overlap_conflict' WHEN u < 0.1 THEN 'utility_below_minimum' ELSE 'kept' END AS reason FROM u1 LEFT JOIN lost l ON l.doc_id = u1.doc_id AND l.id = u1.id)"""


def _two(spark, sf_dir) -> DataFrame:
    """Spans of two annotators, of which at most two overlap."""
    gold = _gold(spark, sf_dir)
    side = lambda df, name, shift: df.select("doc_id", F.concat(F.lit(name), F.col("start").cast("string")).alias("id"), "start", "end", "type", "text", ((F.col("start") + shift) % 100 / 100.0).alias("utility"))
    return side(gold, "g", 0).unionByName(side(_pred(gold, "text").withColumn("text", F.left("text", (F.col("end") - F.col("start")).cast("int"))), "p", 37))


ACTIONS = {("A", "A"): "forbid", ("B", "B"): "forbid", ("C", "C"): "forbid", ("A", "B"): "allow"}


@query(f"WITH {_GOLD}, {_TWO} SELECT type, reason, count(*) AS n, CAST(sum(s) AS BIGINT) AS starts FROM r GROUP BY type, reason")
def consistency(spark, sf_dir) -> DataFrame:
    """Two annotators' spans: copies, overlaps without a rule, forbidden overlaps, low utility."""
    from ..operators.decode import resolve_consistency

    return resolve_consistency(_two(spark, sf_dir), ACTIONS, 0.1).groupBy("type", "reason").agg(F.count("*").alias("n"), F.sum("start").alias("starts"))


@query(f"""WITH {_GOLD}, {_TWO}, rs AS (SELECT doc_id, id AS result_id, s, e, reason = 'kept' AS kept FROM r WHERE type = 'C'),
t AS (SELECT doc_id, id, s, e, reason = 'kept' AS kept FROM r WHERE type = 'B'),
j AS (SELECT rs.doc_id, rs.result_id, t.id AS test_id, row_number() OVER (PARTITION BY rs.doc_id, rs.result_id ORDER BY greatest(t.s - rs.e, rs.s - t.e, 0), -t.s, t.id) AS n FROM rs JOIN t ON t.doc_id = rs.doc_id AND t.kept AND abs(t.s - rs.s) <= 300 WHERE rs.kept)
SELECT doc_id, result_id, test_id FROM j WHERE n = 1""")
def lab_pairs(spark, sf_dir) -> DataFrame:
    """Results (type C) with their nearest kept test (type B) of those within 300 characters."""
    from ..operators.decode import near_tests, resolve_consistency, resolve_lab_pairs
    from ..operators.graph import Saved

    resolved, _ = Saved(spark).put(resolve_consistency(_two(spark, sf_dir), ACTIONS, 0.1).select("doc_id", "id", "start", "end", "type", "kept", "reason"))
    return resolve_lab_pairs(resolved, near_tests(resolved, "C", "B", 300))[1].select("doc_id", "result_id", "test_id")


@query(f"WITH {_GOLD}, {_TWO}, x AS (SELECT doc_id, id, foe FROM ov WHERE action = 'forbid') SELECT b.doc_id, b.id, count(x.foe) AS n, coalesce(string_agg(x.foe, ',' ORDER BY x.foe), '') AS blockers FROM b LEFT JOIN x ON x.doc_id = b.doc_id AND x.id = b.id GROUP BY b.doc_id, b.id")
def overlap_blockers(spark, sf_dir) -> DataFrame:
    """What may not stand beside each span, from pairs that are listed once."""
    from ..operators.decode import span_blockers

    blockers = span_blockers(_two(spark, sf_dir), lambda a, b: a != b)
    return blockers.select("doc_id", "id", F.size("blockers").cast("long").alias("n"), F.array_join("blockers", ",").alias("blockers"))


@query(f"WITH {_GOLD} SELECT doc_id, s AS start, e AS \"end\", type, text, row_number() OVER (PARTITION BY doc_id ORDER BY s, e, type, text) AS place FROM gold")
def entity_order(spark, sf_dir) -> DataFrame:
    """Entities of a document by start, end, type and text."""
    order = Window.partitionBy("doc_id").orderBy("start", "end", "type", "text")
    return _gold(spark, sf_dir).select("doc_id", "start", "end", "type", "text", F.row_number().over(order).cast("long").alias("place"))


@query(f"WITH {_GOLD} SELECT type, CAST(sum(length(substring(d.text, CAST(greatest(s - 20, 0) + 1 AS INT), CAST(e + 20 - greatest(s - 20, 0) AS INT)))) AS BIGINT) AS chars, min(substring(d.text, CAST(greatest(s - 20, 0) + 1 AS INT), CAST(e + 20 - greatest(s - 20, 0) AS INT))) AS first_context FROM gold g JOIN documents d ON d.doc_id = g.doc_id GROUP BY type")
def context_windows(spark, sf_dir) -> DataFrame:
    """Entities with twenty characters on both sides."""
    from ..functions.text import context_window

    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("body"))
    c = _gold(spark, sf_dir).join(docs, "doc_id").select("type", context_window(F.col("body"), F.col("start"), F.col("end"), 20).alias("c"))
    return c.groupBy("type").agg(F.sum(F.length("c")).alias("chars"), F.min("c").alias("first_context"))


@query(f"""WITH {_GOLD}, r AS (SELECT doc_id, type, s, row_number() OVER (PARTITION BY doc_id, type ORDER BY s) AS n FROM gold)
SELECT a.doc_id, a.type AS source_type, b.type AS negative_type, a.s AS source_start, b.s AS negative_start FROM r a JOIN r b ON a.doc_id = b.doc_id AND a.n = b.n AND ((a.type = 'A' AND b.type = 'B') OR (a.type = 'B' AND b.type = 'A') OR (a.type = 'C' AND b.type = 'A'))""")
def cross_type_pairs(spark, sf_dir) -> DataFrame:
    """The i-th entity of a type with the i-th of a type that it is confused with."""
    from ..operators.validate import cross_type_pairs as pairs

    return pairs(_gold(spark, sf_dir).withColumn("i", F.col("start")), (("A", "B"), ("B", "A"), ("C", "A")))
