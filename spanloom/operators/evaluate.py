"""Alignment of gold and predicted spans, and the metrics on it."""

from __future__ import annotations

from collections import Counter
from math import fsum

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import Saved
from .spans import overlap_join, overlaps, per_key


def multiset_align(gold: DataFrame, pred: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The k-th gold row of a key is paired with the k-th predicted one; leftovers of both sides remain.
    Columns: keys, k, in_gold, in_pred."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    g = gold.withColumn("k", rank).select(*keys, "k", F.lit(True).alias("in_gold"))
    p = pred.withColumn("k", rank).select(*keys, "k", F.lit(True).alias("in_pred"))
    return g.join(p, [*keys, "k"], "full").fillna(False, ["in_gold", "in_pred"])


def optional_jaccard(a: Column, b: Column, strict: bool = False) -> Column:
    """Of two sets that may be missing; missing equals empty unless strict, two empty sets are equal."""
    x, y = (F.coalesce(c, F.array().cast("array<string>")) for c in (a, b))
    either = F.size(F.array_union(x, y))
    value = F.when(either == 0, 1.0).otherwise(F.size(F.array_intersect(x, y)) / F.greatest(either, F.lit(1)))
    return F.when(a.isNull() != b.isNull(), 0.0).otherwise(value) if strict else value


def ratio(n: Column, d: Column, empty: float = 1.0) -> Column:
    return F.when(d == 0, F.lit(empty)).otherwise(n / F.greatest(d, F.lit(1)))


def prf(tp: Column, fp: Column, fn: Column, digits: int = 6) -> list[Column]:
    """Precision, recall and F1, rounded. Without predictions precision is 1, without gold recall is 1."""
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    f1 = F.when(p + r == 0, 0.0).otherwise(2 * p * r / F.greatest(p + r, F.lit(1e-300)))
    return [F.round(c, digits).alias(n) for c, n in ((p, "precision"), (r, "recall"), (f1, "f1"))]


def counted(aligned: DataFrame, by: list[str]) -> DataFrame:
    c = aligned.groupBy(*by).agg(
        F.count_if(F.col("in_gold") & F.col("in_pred")).alias("tp"), F.count_if(~F.col("in_gold")).alias("fp"), F.count_if(~F.col("in_pred")).alias("fn")
    )
    return c.select(*by, "tp", "fp", "fn", *prf(F.col("tp"), F.col("fp"), F.col("fn")))


#: What makes two entities of a sample the same, for the score; without the text for the report.
SCORED = ("start", "end", "type", "text")
_SET = "array<string>"


def paired(gold: DataFrame, pred: DataFrame, keys: tuple[str, ...], sample: str = "doc_id") -> DataFrame:
    """Entities with the k-th gold one of a key beside the k-th predicted one, in the order of ``i``: the keys, structs
    ``g`` and ``p`` of the other columns (null on the side that lacks a partner)."""
    by = [sample, *keys]

    def side(df: DataFrame, name: str) -> DataFrame:
        ranked = df.withColumn("k", F.row_number().over(Window.partitionBy(*by).orderBy("i")))
        return ranked.select(*by, "k", F.struct(*(c for c in df.columns if c not in by)).alias(name))

    return side(gold, "g").join(side(pred, "p"), [*by, "k"], "full").drop("k")


#: Columns of an entity as the kernels below take it.
_ENTITY = {"i": "long", "start": "long", "end": "long", "type": "string", "text": "string", "assertions": _SET, "candidates": _SET, "ranking": _SET}


def _sided(gold: DataFrame, pred: DataFrame, sample: str) -> DataFrame:
    """Both sides in one table, so that one shuffle brings the entities of a sample together."""
    side = lambda df, p: df.select(sample, F.lit(p).alias("said"), *((F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in _ENTITY.items()))
    return side(gold, False).unionByName(side(pred, True))


def _pairs(sample, gold: list[dict], pred: list[dict], keys: tuple[str, ...]) -> list[tuple]:
    """What ``paired`` gives, of one sample: (gold or None, predicted or None). A null key has no partner."""
    queues: dict[tuple, list] = {}
    order = lambda e: (e["i"] is not None, e["i"] or 0)
    for e in sorted(pred, key=order):
        queues.setdefault(tuple(e[k] for k in keys), []).append(e)
    out, taken = [], Counter()
    for e in sorted(gold, key=order):
        key = tuple(e[k] for k in keys)
        q = queues.get(key, []) if sample is not None and None not in key else []
        if taken[key] < len(q):
            out.append((e, q[taken[key]]))
            taken[key] += 1
        else:
            out.append((e, None))
    return out + [(None, e) for key, q in queues.items() for e in q[taken[key] :]]


def _alike(a: list | None, b: list | None, strict: bool) -> float:
    """optional_jaccard of two lists."""
    if strict and (a is None) != (b is None):
        return 0.0
    x, y = set(a or ()), set(b or ())
    return len(x & y) / len(x | y) if x or y else 1.0


def _sample_sums(sample, gold: list[dict], pred: list[dict], strict: bool) -> tuple:
    """matched, unmatched gold and predicted entities, mean Jaccard indices of assertions and candidates."""
    pairs, none = _pairs(sample, gold, pred, SCORED), {"assertions": [], "candidates": []}
    mean = lambda c: fsum(_alike((g or none)[c], (p or none)[c], strict) for g, p in pairs) / len(pairs)
    return sum(bool(g and p) for g, p in pairs), sum(p is None for _, p in pairs), sum(g is None for g, _ in pairs), mean("assertions"), mean("candidates")


def _sides(said: list, columns: tuple) -> tuple[list[dict], list[dict]]:
    rows = [dict(zip(_ENTITY, x)) for x in zip(*columns)]
    return [r for r, p in zip(rows, said) if not p], [r for r, p in zip(rows, said) if p]


_SUMS = "matched long, unmatched_gold long, unmatched_pred long, assertion_jaccard double, candidate_jaccard double"


def _scored(sums: DataFrame, weights: tuple[float, float, float]) -> DataFrame:
    p, r, f = prf(F.col("matched"), F.col("unmatched_pred"), F.col("unmatched_gold"), 12)
    w = [float(x) / sum(weights) for x in weights]
    return sums.select("*", p, r, f).withColumn("final_score", w[0] * F.col("f1") + w[1] * F.col("assertion_jaccard") + w[2] * F.col("candidate_jaccard"))


def _checked(weights: tuple[float, float, float]) -> None:
    if min(weights) < 0 or not any(weights):
        raise ValueError("weights must not be negative, nor all 0")


def score_samples(gold: DataFrame, pred: DataFrame, weights: tuple[float, float, float] = (1.0, 1.0, 1.0), none_is_empty: bool = True, sample: str = "doc_id") -> DataFrame:
    """The score of each sample from its entities (i, start, end, type, text, assertions, candidates): precision,
    recall and F1 of equal entities; the mean Jaccard indices of assertions and of candidates, over pairs and over what
    has no partner (against an empty set); and the weighted mean of the three. A sample without entities scores 1.

    Both sides meet in one shuffle by sample."""
    _checked(weights)
    rows, strict = _sided(gold, pred, sample).drop("ranking"), not none_is_empty

    def kernel(key, said: list, *columns: list) -> list[tuple]:
        return [(key, *_sample_sums(key, *_sides(said, columns), strict))]

    kind = rows.schema[sample].dataType.simpleString()
    return _scored(per_key(rows, sample, ["said", *(c for c in _ENTITY if c != "ranking")], kernel, f"`{sample}` {kind}, {_SUMS}"), weights)


def assertion_metrics(gold: DataFrame, pred: DataFrame, sample: str = "doc_id") -> DataFrame:
    """Of entities paired by span and type, for each assertion label tp, fp, fn with precision, recall and F1."""
    both = paired(gold, pred, SCORED[:3], sample).where("g is not null and p is not null")
    sets = both.select(*(F.coalesce(f"{c}.assertions", F.array().cast(_SET)).alias(c) for c in ("g", "p")))
    rows = sets.select(F.explode(F.array_union("g", "p")).alias("label"), "g", "p")
    c = rows.select("label", F.array_contains("g", F.col("label")).alias("in_gold"), F.array_contains("p", F.col("label")).alias("in_pred"))
    return counted(c, ["label"])


def scope_errors(gold: DataFrame, pred: DataFrame, sample: str = "doc_id") -> DataFrame:
    """Gold entities that overlap a predicted one of their type and of another span with a common assertion."""
    r = pred.select(sample, F.col("start").alias("r_start"), F.col("end").alias("r_end"), F.col("type").alias("r_type"), F.col("assertions").alias("r_assertions"))
    hit = (F.col("type") == F.col("r_type")) & ~((F.col("start") == F.col("r_start")) & (F.col("end") == F.col("r_end"))) & F.arrays_overlap("assertions", "r_assertions")
    return overlap_join(gold, r, sample).where(hit).select(sample, "start", "end", "type", "i").distinct()


def linking_report(gold: DataFrame, pred: DataFrame, sample: str = "doc_id") -> DataFrame:
    """Over pairs (by span and type) whose gold candidates are known: recall of the first gold code at 1, 2 and 5,
    mean reciprocal rank, the share with any gold code among the predicted ones, and the mean Jaccard index; one row.
    ``pred`` has the array ``ranking`` beside ``candidates``."""
    both = paired(gold, pred, SCORED[:3], sample).where("g.candidates is not null and p is not null")
    want, said = F.col("g.candidates"), F.coalesce("p.candidates", F.array().cast(_SET))
    ranks = F.transform("p.ranking", lambda x, i: F.when(F.array_contains(want, x), i + 1))
    v = both.select(F.array_min(F.coalesce(ranks, F.array().cast("array<int>"))).alias("rank"), F.arrays_overlap(want, said).alias("found"), optional_jaccard(want, said).alias("jaccard"))
    at = lambda k: F.avg(F.coalesce((F.col("rank") <= k).cast("double"), F.lit(0.0)))
    values = {"recall_1": at(1), "recall_2": at(2), "recall_5": at(5), "mrr": F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))), "oracle": F.avg(F.coalesce(F.col("found"), F.lit(False)).cast("double")), "jaccard": F.avg("jaccard")}
    return v.agg(F.count("*").alias("n"), *(F.round(F.coalesce(c, F.lit(0.0)), 6).alias(n) for n, c in values.items()))


def _report_rows(sample, said: list, *columns: list) -> list[tuple]:
    """The sums of a sample for the report: (sample, part, name, values)."""
    gold, pred = _sides(said, columns)
    at, rows = lambda e: (e["start"], e["end"]), []

    def put(part: str, name: str | None, *values) -> None:
        rows.append((sample, part, name, *map(float, values), *[0.0] * (7 - len(values))))

    put("score", None, *_sample_sums(sample, gold, pred, False))
    pairs, types, labels, linking = _pairs(sample, gold, pred, SCORED[:3]), {}, {}, []
    for g, p in pairs:
        t = types.setdefault((g or p)["type"], [0, 0, 0])
        t[0 if g and p else 1 if p else 2] += 1
        if not (g and p):
            continue
        a, b = set(g["assertions"] or ()), set(p["assertions"] or ())
        for x in a | b:
            n = labels.setdefault(x, [0, 0, 0])
            if x is not None:
                n[0 if x in a and x in b else 1 if x in b else 2] += 1
        if g["candidates"] is not None:
            want, listed = set(g["candidates"]) - {None}, p["candidates"] or []
            rank = next((k for k, x in enumerate(p["ranking"] or (), 1) if x in want), None)
            linking.append((1, *(rank is not None and rank <= k for k in (1, 2, 5)), 1 / rank if rank else 0, bool(want & set(listed)), _alike(g["candidates"], listed, False)))
    for part, of in (("type", types), ("assertion", labels)):
        for name, n in of.items():
            put(part, name, *n)
    if linking:
        put("linking", None, *map(fsum, zip(*linking)))
    whole = lambda e: sample is not None and None not in (e["start"], e["end"], e["type"])
    same = lambda e: (e["start"], e["end"], e["type"])
    expected, predicted = {same(e) for e in gold if whole(e)}, {same(e) for e in pred if whole(e)}
    near: dict[int, set] = {}
    scoped, touched = set(), set()
    for i, j in overlaps([at(e) for e in gold], [at(e) for e in pred]) if sample is not None else ():
        g, p = gold[i], pred[j]
        near.setdefault(i, set()).add(p["type"])
        touched.add(j)
        if g["type"] is not None and g["type"] == p["type"] and at(g) != at(p) and (set(g["assertions"] or ()) & set(p["assertions"] or ())) - {None}:
            scoped.add((*same(g), g["i"]))
    errors = Counter()
    for i, g in enumerate(gold):
        if same(g) not in predicted:
            errors["missing" if i not in near or not whole(g) else "boundary" if g["type"] in near[i] else "type"] += 1
    errors["spurious"] += sum(same(p) not in expected and (j not in touched or not whole(p)) for j, p in enumerate(pred))
    for name, n in errors.items():
        if n:
            put("error", name, n)
    if scoped:
        put("scope", None, len(scoped))
    return rows


def evaluation_report(gold: DataFrame, pred: DataFrame, runs: DataFrame, weights: tuple[float, float, float] = (1.0, 1.0, 1.0), sample: str = "doc_id") -> DataFrame:
    """(section, name, value) of a run. ``runs`` has a row for each sample: its id, failure_reason, latency_ms; the
    samples of both sides must be those of ``runs``. Sections: score, type, assertion, linking, error, system, failure."""
    put = lambda df, section, name, value: df.select(F.lit(section).alias("section"), name.cast("string").alias("name"), F.round(value.cast("double"), 6).alias("value"))

    def melted(df: DataFrame, section: str, key: Column | None, columns: list[str]) -> DataFrame:
        pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("n"), F.col(c).cast("double").alias("v")) for c in columns))).alias("x")
        rows = df.select(*([key.alias("k")] if key is not None else []), pairs)
        return put(rows, section, F.concat_ws(".", "k", "x.n") if key is not None else F.col("x.n"), F.col("x.v"))

    # All that a sample's entities say comes from one shuffle of both sides, as sums that are added up where they arise.
    _checked(weights)
    kind = gold.schema[sample].dataType.simpleString()
    values = [f"v{k}" for k in range(7)]
    found, _ = Saved(gold.sparkSession).put(per_key(_sided(gold, pred, sample), sample, ["said", *_ENTITY], _report_rows, f"`{sample}` {kind}, part string, name string, {', '.join(f'{v} double' for v in values)}"))
    of = lambda part, *names: found.where(F.col("part") == part).groupBy(*(["name"] if "name" in names else [])).agg(*(F.coalesce(F.sum(v), F.lit(0.0)).cast("double" if part == "linking" else "long").alias(n) for v, n in zip(values, (n for n in names if n != "name"))))
    # A sample in which nothing is expected and nothing found scores 1.
    sums = found.where("part = 'score'").select(sample, *(F.col(v).cast(k).alias(n) for v, (n, k) in zip(values, (x.split() for x in _SUMS.split(", ")))))
    known = runs.select(sample).join(_scored(sums, weights), sample, "left")
    final = known.agg(F.avg(F.coalesce("final_score", F.lit(1.0))).alias("final_score"), F.count("*").alias("samples"))
    strange = found.where("part = 'score'").select(sample).join(runs.select(sample), sample, "left_anti").agg(F.count("*").alias("unknown_samples"))
    counts = ["tp", "fp", "fn", "precision", "recall", "f1"]
    measured = lambda df, by: df.select(by, "tp", "fp", "fn", *prf(F.col("tp"), F.col("fp"), F.col("fn")))
    types, labels = (measured(of(part, "name", "tp", "fp", "fn").withColumnRenamed("name", by), by) for part, by in (("type", "type"), ("assertion", "label")))
    means = ("recall_1", "recall_2", "recall_5", "mrr", "oracle", "jaccard")
    linked = of("linking", "n", *means).select("n", *(F.round(F.when(F.col("n") == 0, 0.0).otherwise(F.col(c) / F.greatest("n", F.lit(1.0))), 6).alias(c) for c in means))
    system = runs.agg(F.avg("latency_ms").alias("mean_latency_ms"), F.max("latency_ms").alias("max_latency_ms"), F.count("failure_reason").alias("failures"))
    failed = runs.where("failure_reason is not null").groupBy("failure_reason").agg(F.count("*").alias("n"))
    errors, scopes = of("error", "name", "n").withColumnRenamed("name", "error"), of("scope", "n")
    parts = [
        melted(final, "score", None, ["final_score", "samples"]), melted(strange, "score", None, ["unknown_samples"]),
        melted(types, "type", F.col("type"), counts), melted(labels, "assertion", F.col("label"), counts), melted(linked, "linking", None, ["n", *means]),
        put(errors, "error", F.col("error"), F.col("n")), put(scopes, "error", F.lit("scope"), F.col("n")),
        melted(system, "system", None, ["mean_latency_ms", "max_latency_ms", "failures"]), put(failed, "failure", F.col("failure_reason"), F.col("n")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def bucket_deltas(base: DataFrame, other: DataFrame) -> DataFrame:
    """A10: (name, delta) of the error sections of two reports."""
    side = lambda df, n: df.where("section in ('error', 'failure')").select("section", "name", F.col("value").alias(n))
    both = side(base, "b").join(side(other, "o"), ["section", "name"], "full")
    return both.select("section", "name", (F.coalesce("o", F.lit(0.0)) - F.coalesce("b", F.lit(0.0))).cast("long").alias("delta"))


def error_classes(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """For each unmatched gold span: boundary (a predicted one of its type overlaps), else type (any overlaps), else
    missing; for each unmatched predicted one: spurious if it overlaps no gold span, else partial. Columns: doc_id, start,
    end, type, error."""
    keys = ["doc_id", "start", "end", "type"]
    r = pred.select("doc_id", F.col("start").alias("r_start"), F.col("end").alias("r_end"), F.col("type").alias("r_type"))
    missed = gold.select(*keys).join(pred.select(*keys), keys, "left_anti")
    near = overlap_join(missed, r).groupBy(*keys).agg(
        F.bool_or(F.col("r_type") == F.col("type")).alias("same"), F.lit(True).alias("touched")
    )
    fn = missed.join(near, keys, "left").select(*keys, F.when(F.col("same"), "boundary").when(F.col("touched"), "type").otherwise("missing").alias("error"))
    extra = pred.select(*keys).join(gold.select(*keys), keys, "left_anti")
    g = gold.select("doc_id", F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    touched = overlap_join(extra, g).select(*keys).distinct().withColumn("touched", F.lit(True))
    fp = extra.join(touched, keys, "left").select(*keys, F.when(F.col("touched"), "partial").otherwise("spurious").alias("error"))
    return fn.unionByName(fp)
