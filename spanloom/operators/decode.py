"""Choosing entities from scored hypotheses: fusion, utility decoding, consistency, four-tier alignment."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import let, logit, sigmoid
from .spans import overlaps, per_key


def expected(p: Column, reward: float, penalty: float) -> Column:
    return p * reward - (1 - p) * penalty


def choose_type(probabilities: Column, thresholds: dict[str, float]) -> Column:
    """struct(p, type) of the most probable type that reaches its threshold; of equal ones the larger name."""
    bars = F.create_map(*(F.lit(x) for kv in thresholds.items() for x in kv))
    fit = F.filter(F.map_entries(probabilities), lambda e: e["value"] >= F.coalesce(bars[e["key"]], F.lit(1.0)))
    return F.array_max(F.transform(fit, lambda e: F.struct(e["value"].alias("p"), e["key"].alias("type"))))


def normalised_types(evidence: DataFrame, least: float = 0.5, margin: float = 0.05) -> DataFrame:
    """(cluster_id, type) with the largest share of weight * score, if it reaches ``least`` and leads by ``margin``."""
    sums = evidence.groupBy("cluster_id", "type").agg(F.sum(F.col("weight") * F.col("score")).alias("s"))
    best = sums.groupBy("cluster_id").agg(F.sum("s").alias("total"), F.array_sort(F.collect_list(F.struct((-F.col("s")).alias("n"), "type"))).alias("r"))
    first, second = -F.col("r")[0]["n"] / F.col("total"), F.coalesce(-F.try_element_at("r", F.lit(2))["n"] / F.col("total"), F.lit(0.0))
    return best.where(F.col("total") > 0).select("cluster_id", F.col("r")[0]["type"].alias("type"), first.alias("p"), second.alias("runner_up")).where((F.col("p") >= least) & (F.col("p") - F.col("runner_up") >= margin))


def resolve_boundaries(clusters: DataFrame, key: str = "doc_id", support: float = 0.5, agreement: float = 0.5) -> DataFrame:
    """Clusters (start, end, score, sources, members) by falling score; kept if score and share of distinct sources
    reach the bars and no kept one conflicts. One that nests with any kept one it touches is kept, others are not."""
    fit = clusters.where((F.col("score") >= support) & (F.size(F.array_distinct("sources")) / F.greatest("members", F.lit(1)) >= agreement))
    item = F.struct((-F.col("score")).alias("rank"), F.col("start").cast("long").alias("s"), F.col("end").cast("long").alias("e"))
    nested = lambda y, x: ((y["s"] <= x["s"]) & (x["e"] <= y["e"])) | ((x["s"] <= y["s"]) & (y["e"] <= x["e"]))

    def step(acc: Column, x: Column) -> Column:
        hits = F.filter(acc, lambda y: (y["s"] < x["e"]) & (x["s"] < y["e"]))
        return F.when((F.size(hits) == 0) | F.exists(hits, lambda y: nested(y, x)), F.concat(acc, F.array(x))).otherwise(acc)

    kept = F.aggregate(F.array_sort(F.collect_list(item)), F.array().cast("array<struct<rank:double,s:bigint,e:bigint>>"), step)
    return fit.groupBy(key).agg(F.explode(kept).alias("x")).select(key, F.col("x.s").alias("start"), F.col("x.e").alias("end"), (-F.col("x.rank")).alias("score"))


def utility_decode(items: DataFrame, thresholds: dict[str, float], weights: dict[str, float], least: float = 0.0, key: str = "doc_id") -> DataFrame:
    """Items (id, start, end, span_p, types map, assertions map, candidates map). The utility of a hypothesis is
    the expected gain of its span, type, assertions and candidates; those under ``least`` go, and of two that overlap
    the one with less utility (then the larger id)."""
    w = weights
    chosen = choose_type(F.col("types"), thresholds)

    def picks(column: str, reward: float, penalty: float, bar: float) -> Column:
        ok = F.filter(F.map_entries(column), lambda e: (e["value"] >= bar) & (expected(e["value"], reward, penalty) > 0))
        return F.array_sort(F.transform(ok, lambda e: F.struct((-e["value"]).alias("n"), e["key"].alias("name"))))

    total = lambda c, reward, penalty: F.aggregate(c, F.lit(0.0), lambda s, e: s + expected(-e["n"], reward, penalty))
    d = items.withColumn("chosen", chosen).where(F.col("chosen").isNotNull())
    d = d.withColumn("labels", picks("assertions", w["label"], w["wrong_label"], w["label_bar"])).withColumn("codes", picks("candidates", w["code"], w["wrong_code"], w["code_bar"]))
    u = expected(F.col("span_p"), w["span"], w["wrong_span"]) + expected(F.col("chosen.p"), w["type"], w["wrong_type"]) + total("labels", w["label"], w["wrong_label"]) + total("codes", w["code"], w["wrong_code"])
    d = d.withColumn("utility", u).where(F.col("utility") >= least)
    names = lambda c: F.transform(c, lambda e: e["name"])
    item = F.struct(
        (-F.col("utility")).alias("rank"), "id", F.col("start").cast("long").alias("s"), F.col("end").cast("long").alias("e"), F.col("chosen.type").alias("type"),
        F.array_sort(names("labels")).alias("labels"), F.when(F.size("codes") > 0, names("codes")).alias("codes"),
    )
    shape = "array<struct<rank:double,id:string,s:bigint,e:bigint,type:string,labels:array<string>,codes:array<string>>>"
    kept = F.aggregate(F.array_sort(F.collect_list(item)), F.array().cast(shape), lambda acc, x: F.when(F.exists(acc, lambda y: (y["s"] < x["e"]) & (x["s"] < y["e"])), acc).otherwise(F.concat(acc, F.array(x))))
    return d.groupBy(key).agg(F.explode(kept).alias("x")).select(key, "x.id", F.col("x.s").alias("start"), F.col("x.e").alias("end"), "x.type", F.col("x.labels").alias("assertions"), F.col("x.codes").alias("candidates"), (-F.col("x.rank")).alias("utility"))


def assertion_mix(rule: Column, model: Column, rule_weight: float, temperature: float = 1.0, bias: float = 0.0) -> Column:
    """Rule and model probability mixed as logits, then scaled and shifted."""
    return sigmoid((rule_weight * logit(rule) + (1 - rule_weight) * logit(model)) / temperature + bias)


def _ranked_pairs(left: DataFrame, right: DataFrame, by: list[str], tier: int, key: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pairs of a tier in which any two rows with equal ``by`` fit, the k-th with the k-th; and what is left of both."""
    rank = lambda *order: F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    a = left.select(*by, F.col("i").alias("left")).withColumn("k", rank("left"))
    b = right.select(*by, F.col("i").alias("right"), *([] if "type" in by else ["type"])).withColumn("k", rank("type", "right")).drop(*([] if "type" in by else ["type"]))
    pairs = a.join(b, [*by, "k"]).select(key, "left", "right", F.lit(tier).alias("tier"))
    rest = lambda df, n: df.join(pairs.select(key, F.col(n).alias("i")), [key, "i"], "left_anti")
    return pairs, rest(left, "left"), rest(right, "right")


def four_tier_alignment(left: DataFrame, right: DataFrame, key: str = "sample_id") -> DataFrame:
    """(key, left index, right index, tier): same span and type, same span, same type and overlap, overlap.
    In each tier, left rows in order take the closest free right row. Columns: key, i, start, end, type.

    In the first two tiers all rows of a span fit, so ranks pair them by joins. What is left over is grouped by sample, as
    the choice depends on order within one, and folded in the JVM; it is bounded by the sample's text."""
    cols = [key, "i", "start", "end", "type"]
    long = lambda df: df.select(key, *(F.col(c).cast("long").alias(c) for c in ("i", "start", "end")), "type")
    first, l1, r1 = _ranked_pairs(long(left), long(right), [key, "start", "end", "type"], 1, key)
    second, l2, r2 = _ranked_pairs(l1.select(*cols), r1.select(*cols), [key, "start", "end"], 2, key)
    one = "struct<i:bigint,start:bigint,end:bigint,type:string>"
    side = lambda df, n: df.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("i", "start", "end", "type").cast(one))).alias(n))
    shape = f"struct<l:array<{one}>,r:array<{one}>,found:array<struct<left:bigint,right:bigint,tier:int>>>"
    overlap = lambda x, y: (x["start"] < y["end"]) & (y["start"] < x["end"])
    tiers = {3: lambda x, y: (x["type"] == y["type"]) & overlap(x, y), 4: overlap}

    def step(fits, tier: int):
        def take(s: Column, x: Column) -> Column:
            near = F.transform(F.filter(s["r"], lambda y: fits(x, y)), lambda y: F.struct((F.abs(x["start"] - y["start"]) + F.abs(x["end"] - y["end"])).alias("gap"), y["start"].alias("s"), y["end"].alias("e"), y["type"].alias("t"), y["i"].alias("i")))
            # A lambda's body would find the closest anew for each place that names it.
            return let(F.array_min(near), lambda best: _taken(s, x, best, tier, shape))

        return take

    none = F.array().cast(f"array<{one}>")
    state = F.struct(F.col("l"), F.col("r"), F.array().cast("array<struct<left:bigint,right:bigint,tier:int>>").alias("found")).cast(shape)
    out = side(l2, "l").join(side(r2, "r"), key).select(key, state.alias("s"))
    for tier, fits in tiers.items():
        start = F.struct(none.alias("l"), F.col("s.r").alias("r"), F.col("s.found").alias("found")).cast(shape)
        out = out.select(key, F.aggregate("s.l", start, step(fits, tier)).alias("s"))
    rest = out.select(key, F.explode("s.found").alias("f")).select(key, "f.left", "f.right", "f.tier")
    return first.unionByName(second).unionByName(rest)


def _taken(s: Column, x: Column, best: Column, tier: int, shape: str) -> Column:
    """The state after a left row met its closest right one, if any."""
    pair = F.struct(x["i"].alias("left"), best["i"].alias("right"), F.lit(tier).alias("tier"))
    hit = F.struct(s["l"].alias("l"), F.filter(s["r"], lambda y: y["i"] != best["i"]).alias("r"), F.array_append(s["found"], pair).alias("found")).cast(shape)
    miss = F.struct(F.array_append(s["l"], x).alias("l"), s["r"].alias("r"), s["found"].alias("found")).cast(shape)
    return F.when(best.isNull(), miss).otherwise(hit)


ALLOW, FORBID = "allow", "forbid"


def resolve_consistency(spans: DataFrame, actions: dict[tuple[str, str], str], least: float, key: str = "doc_id") -> DataFrame:
    """Spans (key, id, start, end, type, text, utility, and any others) with ``kept`` and ``reason``.

    In this order: of spans that are equal in everything but id and utility the smallest id stays; two overlapping spans
    whose types have no action go both; of two whose types may not meet, the one with less utility (then the later place,
    then the larger id) goes, unless the other has gone; then what is under ``least`` goes. ``actions``: of unordered
    pairs of types, allow or forbid. The spans of a document meet in one shuffle, and their overlaps never leave the task."""
    whole, table = [c for c in spans.columns if c not in ("id", "utility")], {"|".join(sorted(pair)): what for pair, what in actions.items()}

    def kernel(name, ids: list, utilities: list, starts: list, ends: list, types: list, texts: list, *others: list) -> list[tuple]:
        original: dict[tuple, str] = {}
        rows = [tuple(map(_plain, x)) for x in zip(*others)]
        for i, r in zip(ids, rows):
            original[r] = min((x for x in (original.get(r), i) if x is not None), default=None)
        copy = [i is not None and i != original[r] for i, r in zip(ids, rows)]
        unknown, foes = set(), {}
        places = list(zip(starts, ends))
        for x, y in overlaps(places, places) if name is not None else ():
            if ids[x] is None or ids[y] is None or ids[x] == ids[y]:
                continue
            action = table.get("|".join(sorted(t for t in (types[x], types[y]) if t is not None)))
            if action is None:
                unknown.add(ids[x])
            elif action == FORBID:
                foes.setdefault(ids[x], set()).add(ids[y])
        nulls_first = lambda v: (v is not None, v if v is not None else 0)
        rank = lambda x: tuple(map(nulls_first, (None if utilities[x] is None else -utilities[x], starts[x], ends[x], types[x], texts[x], ids[x])))
        won: set = set()
        for x in sorted((x for x, i in enumerate(ids) if i in foes and not copy[x] and i not in unknown), key=rank):
            if not won & foes[ids[x]]:
                won.add(ids[x])
        out = []
        for x, i in enumerate(ids):
            low = utilities[x] is not None and utilities[x] < least
            reason = "exact_duplicate" if copy[x] else "unsupported_overlap" if i in unknown else "overlap_conflict" if i in foes and i not in won else "utility_below_minimum" if low else "kept"
            out.append((reason == "kept", reason))
        return out

    return per_key(spans, key, ["id", "utility", "start", "end", "type", "text", *whole], kernel, "kept boolean, reason string", keep=True)


def _plain(value: object) -> object:
    """A value that equals its equals: lists and maps as tuples, one NaN."""
    if isinstance(value, dict):
        return tuple((k, _plain(v)) for k, v in value.items())
    if isinstance(value, list):
        return tuple(map(_plain, value))
    return "NaN" if value != value else value


def resolve_lab_pairs(resolved: DataFrame, pairings: DataFrame, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """Results move to their nearest kept test. ``pairings``: key, result_id, test_ids, assigned. Returns the spans
    of resolve_consistency, where a kept result without a kept test goes (lab_pair_abstained), and the pairs: key,
    result_id, test_id, reassigned. Of equally near tests the later one counts, then the smaller id."""
    kind = resolved.schema[key].dataType.simpleString()
    spot = resolved.select(key, "id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "kept", F.lit(None).cast("array<string>").alias("test_ids"), F.lit(None).cast("string").alias("assigned"))
    asked = pairings.select(key, F.col("result_id").alias("id"), F.lit(None).cast("long").alias("start"), F.lit(None).cast("long").alias("end"), F.lit(None).cast("boolean").alias("kept"), F.coalesce("test_ids", F.array().cast("array<string>")).alias("test_ids"), "assigned")

    def kernel(name, ids: list, starts: list, ends: list, kept: list, tests: list, assigned: list) -> list[tuple]:
        at = {i: (s, e) for i, s, e, k, t in zip(ids, starts, ends, kept, tests) if t is None and k and i is not None and name is not None}
        out = []
        for i, listed, before in zip(ids, tests, assigned):
            if listed is None or i not in at:
                continue
            s, e = at[i]
            best = min(((max(at[t][0] - e, s - at[t][1], 0), -at[t][0], t) for t in listed if t in at), default=None)
            out.append((name, i, best[2] if best else None, before != best[2] if best else None))
        return out

    found = per_key(spot.unionByName(asked), key, ["id", "start", "end", "kept", "test_ids", "assigned"], kernel, f"`{key}` {kind}, result_id string, test_id string, reassigned boolean")
    pairs = found.where("test_id is not null")
    lost = found.where("test_id is null").select(key, F.col("result_id").alias("id")).withColumn("lost", F.lit(True))
    out = resolved.join(lost, [key, "id"], "left")
    out = out.withColumn("reason", F.when(F.col("lost"), "lab_pair_abstained").otherwise(F.col("reason"))).withColumn("kept", F.col("kept") & F.col("lost").isNull())
    return out.select(*resolved.columns), pairs


def near_tests(spans: DataFrame, result: str, test: str, reach: int, key: str = "doc_id") -> DataFrame:
    """Pairings for resolve_lab_pairs, from spans (key, id, start, type): (key, result_id, test_ids, assigned) of results
    with the sorted ids of tests that start within ``reach`` characters of them, of which the first is assigned."""

    def kernel(name, ids: list, starts: list, types: list) -> list[tuple]:
        tests = sorted((s, i) for i, s, t in zip(ids, starts, types) if t == test)
        places, out = [s for s, _ in tests], []
        for i, s in {(i, s): None for i, s, t in zip(ids, starts, types) if t == result}:
            near = sorted({x for _, x in tests[bisect_left(places, s - reach) : bisect_right(places, s + reach)]})
            if near:
                out.append((name, i, near, near[0]))
        return out

    kind, some = spans.schema[key].dataType.simpleString(), spans.where(F.col("type").isin(result, test) & F.col(key).isNotNull() & F.col("id").isNotNull() & F.col("start").isNotNull())
    return per_key(some.select(key, "id", "start", "type"), key, ["id", "start", "type"], kernel, f"`{key}` {kind}, result_id string, test_ids array<string>, assigned string")


def span_blockers(items: DataFrame, compatible: Callable[[str, str], bool], key: str = "doc_id") -> DataFrame:
    """overlap_blockers of spans (key, id, start, end, type): (key, id, blockers), where overlapping spans whose types
    are not compatible block each other. The overlaps never leave the task of their document."""

    def kernel(name, ids: list, starts: list, ends: list, types: list) -> list[tuple]:
        places, foes = list(zip(starts, ends)), {}
        for x, y in overlaps(places, places) if name is not None else ():
            if ids[x] is not None and ids[y] is not None and ids[x] < ids[y] and not compatible(types[x], types[y]):
                foes.setdefault(ids[x], set()).add(ids[y])
                foes.setdefault(ids[y], set()).add(ids[x])
        return [(name, i, sorted(foes.get(i, ()))) for i in ids]

    kind = items.schema[key].dataType.simpleString()
    return per_key(items.select(key, "id", "start", "end", "type"), key, ["id", "start", "end", "type"], kernel, f"`{key}` {kind}, id string, blockers array<string>")


def overlap_blockers(items: DataFrame, overlaps: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, id, blockers): the hypotheses that may not stand beside each one, in both directions. ``overlaps``: key,
    left_id, right_id, compatible."""
    edges = overlaps.where("not compatible").select(key, F.explode(F.array(F.struct(F.col("left_id").alias("id"), F.col("right_id").alias("b")), F.struct(F.col("right_id").alias("id"), F.col("left_id").alias("b")))).alias("x"))
    some = edges.select(key, "x.id", "x.b").groupBy(key, "id").agg(F.array_sort(F.collect_set("b")).alias("blockers"))
    return items.select(key, "id").join(some, [key, "id"], "left").withColumn("blockers", F.coalesce("blockers", F.array().cast("array<string>")))
