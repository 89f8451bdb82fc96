"""Span algebra: half-open [start, end) code-point spans of documents."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Characters of a cell in interval joins.
CELL = 128


def pattern_spans(docs: DataFrame, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, end, text) of every match, whole texts, without a shuffle (Arrow batches)."""
    rx = re.compile(pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids, starts, ends, texts = [], [], [], []
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    for m in rx.finditer(text or ""):
                        ids.append(doc)
                        starts.append(m.start())
                        ends.append(m.end())
                        texts.append(m[0])
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "start", "end", "text"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, "doc_id long, start long, end long, text string")


def per_key(rows: DataFrame, key: str, columns: list[str], kernel: Callable[..., Iterable[tuple]], schema: str, keep: bool = False) -> DataFrame:
    """Rows of kernel(key, lists of ``columns``) for each key; with ``keep`` it gives one tuple for each row of the key, and
    these are further columns of the rows. A kernel must take any order of the rows.

    One shuffle by the key brings together what joins and windows would shuffle again and again; a task streams through
    its sorted keys and holds an Arrow batch and the rows of one key, which are bounded by a document's text."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    shape = to_arrow_schema(_parse_datatype_string(schema))
    out = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in rows.schema)}, {schema}" if keep else schema

    def done(t: pa.Table, keys: list) -> Iterator[pa.RecordBatch]:
        lists, made = [t.column(c).to_pylist() for c in columns], []
        ends = [i for i in range(1, len(keys)) if keys[i] != keys[i - 1]] + [len(keys)]
        for a, b in zip([0, *ends], ends):
            made.extend(kernel(keys[a], *(x[a:b] for x in lists)))
        values = [pa.array(c, f.type) for c, f in zip(list(zip(*made)) or [()] * len(shape), shape)]
        new = pa.Table.from_arrays(values, schema=shape)
        if keep:
            new = pa.Table.from_arrays([*t.columns, *new.columns], names=[*t.column_names, *new.column_names])
        yield from new.to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(batch.schema.get_field_index(key)).to_pylist()
            if held and keys[0] == last and keys[-1] == last:
                held.append(batch)
                continue
            last, cut = keys[-1], keys.index(keys[-1])
            whole = pa.Table.from_batches([*held, batch.slice(0, cut)])
            if whole.num_rows:
                yield from done(whole, whole.column(key).to_pylist())
            held = [batch.slice(cut)]
        if held:
            whole = pa.Table.from_batches(held)
            yield from done(whole, whole.column(key).to_pylist())

    return rows.repartition(key).sortWithinPartitions(key).mapInArrow(run, out)


def overlaps(a: list[tuple], b: list[tuple]) -> Iterator[tuple[int, int]]:
    """Places (i, j) of overlapping spans (start, end) of two lists; null and empty spans overlap nothing."""
    right = sorted((s, e, j) for j, (s, e) in enumerate(b) if s is not None and e is not None and s < e)
    starts, reach = [x[0] for x in right], list(accumulate((x[1] for x in right), max))
    for i, (s, e) in enumerate(a):
        if s is None or e is None or s >= e:
            continue
        k = bisect_left(starts, e) - 1
        while k >= 0 and reach[k] > s:
            if right[k][1] > s:
                yield i, right[k][2]
            k -= 1


def valid_span(text: Column, start: Column, end: Column, surface: Column) -> Column:
    """The span lies in the text and holds its surface."""
    return (start >= 0) & (end <= F.length(text)) & (F.substring(text, start.cast("int") + 1, (end - start).cast("int")) == surface)


def fidelity(found: DataFrame, docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(type, n, bad, n_distinct) of spans (key, start, end, type, text) of docs (key, text): all, those that do
    not hold their surface, and distinct places. A text meets its spans once, and no span carries it."""
    kind = "start long, end long, type string, surface string"
    none = [F.lit(None).cast(x.split()[1]).alias(x.split()[0]) for x in kind.split(", ")]
    body = docs.select(key, F.lit(True).alias("whole"), F.col("text").alias("body"), *none)
    rows = body.unionByName(found.select(key, F.lit(False).alias("whole"), F.lit(None).cast("string").alias("body"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "type", F.col("text").alias("surface")))

    def kernel(name, whole: list, bodies: list, starts: list, ends: list, types: list, surfaces: list) -> list[tuple]:
        if name is None or True not in whole:
            return []
        text, n = bodies[whole.index(True)], {}
        for w, s, e, t, x in zip(whole, starts, ends, types, surfaces):
            if not w:
                c = n.setdefault(t, [0, 0, set()])
                c[0] += 1
                if None not in (text, s, e, x):
                    c[1] += not (s >= 0 and e <= len(text) and text[s:max(s, e)] == x)
                if s is not None:
                    c[2].add(s)
        return [(t, a, b, len(c)) for t, (a, b, c) in n.items()]

    sums = per_key(rows, key, ["whole", "body", "start", "end", "type", "surface"], kernel, "type string, n long, bad long, n_distinct long")
    return sums.groupBy("type").agg(*(F.sum(c).alias(c) for c in ("n", "bad", "n_distinct")))


def overlap_join(left: DataFrame, right: DataFrame, key: str = "doc_id", cell: int = CELL) -> DataFrame:
    """Pairs of left (start, end) and right (r_start, r_end) spans of a key that overlap.

    Spans meet in the cells they touch, an equi-join; a pair counts in the first cell that both touch, so none repeats.
    """
    cells = lambda s, e: F.sequence(F.floor(F.col(s) / cell), F.floor((F.col(e) - 1) / cell))
    a = left.where("start < end").withColumn("cell", F.explode(cells("start", "end")))
    b = right.where("r_start < r_end").withColumn("cell", F.explode(cells("r_start", "r_end")))
    first = F.greatest(F.floor(F.col("start") / cell), F.floor(F.col("r_start") / cell))
    return a.join(b, [key, "cell"]).where((F.col("start") < F.col("r_end")) & (F.col("r_start") < F.col("end")) & (F.col("cell") == first)).drop("cell")


def containing(points: DataFrame, spans: DataFrame, key: str = "doc_id", cell: int = CELL) -> DataFrame:
    """Points (key, at) with the spans (r_start, r_end) of their key that hold them, r_start <= at < r_end."""
    one = points.withColumn("start", F.col("at")).withColumn("end", F.col("at") + 1)
    return overlap_join(one, spans, key, cell).drop("start", "end")


def nearest_before(left: DataFrame, right: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """With each left row, the value and place of the closest right row of its key at or before it.

    One sort per key of both sides together, no pairing; ``right`` has key, at and value."""
    rows = left.withColumn("__l", F.lit(True)).withColumn("__v", F.lit(None).cast(right.schema[value].dataType)).withColumn("__t", F.lit(None).cast(right.schema[at].dataType))
    hits = right.select(key, at, F.lit(False).alias("__l"), F.col(value).alias("__v"), F.col(at).alias("__t"))
    order = Window.partitionBy(key).orderBy(at, "__l").rowsBetween(Window.unboundedPreceding, 0)
    both = rows.unionByName(hits, allowMissingColumns=True)
    last = F.last(F.when(~F.col("__l"), F.struct(F.col("__v").alias("v"), F.col("__t").alias("t"))), ignorenulls=True).over(order)
    return both.withColumn("__n", last).where("__l").withColumn(f"nearest_{value}", F.col("__n.v")).withColumn(f"nearest_{at}", F.col("__n.t")).drop("__l", "__v", "__t", "__n")


def greedy_non_overlap(spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """Of a document's spans, longest first and then leftmost, those that overlap none taken before.

    A fold over one document's sorted array; documents are the unit of parallelism, as their spans are bounded by text."""
    item = F.struct((F.col("start") - F.col("end")).alias("rank"), F.col("start").alias("s"), F.col("end").alias("e"), F.col("text").alias("t"))
    empty = F.array().cast("array<struct<rank:bigint,s:bigint,e:bigint,t:string>>")
    taken = F.aggregate(F.array_sort(F.collect_list(item)), empty, lambda acc, x: F.when(F.exists(acc, lambda y: (y["s"] < x["e"]) & (x["s"] < y["e"])), acc).otherwise(F.concat(acc, F.array(x))))
    return spans.groupBy(key).agg(taken.alias("x")).select(key, F.explode("x").alias("x")).select(key, F.col("x.s").alias("start"), F.col("x.e").alias("end"), F.col("x.t").alias("text"))


def cluster(spans: DataFrame, key: str = "doc_id", ratio: float = 0.8) -> DataFrame:
    """Proposals in order (start, end, id) join the first group whose first member has the same span, or equal
    folded text and an overlap of at least ``ratio`` of the shorter span. Columns: key, start, end, text, id."""
    item = F.struct(F.col("start").alias("s"), F.col("end").alias("e"), F.col("id").alias("id"), F.lower("text").alias("t"))
    shape = "array<struct<s:bigint,e:bigint,t:string,members:array<string>>>"

    def same(g: Column, x: Column) -> Column:
        shared = F.least(g["e"], x["e"]) - F.greatest(g["s"], x["s"])
        shorter = F.greatest(F.least(g["e"] - g["s"], x["e"] - x["s"]), F.lit(1))
        return ((g["s"] == x["s"]) & (g["e"] == x["e"])) | ((shared / shorter >= ratio) & (g["t"] == x["t"]))

    def step(acc: Column, x: Column) -> Column:
        first = F.array_position(F.transform(acc, lambda g: same(g, x)), True)
        grown = F.transform(acc, lambda g, i: F.when(i + 1 == first, F.struct(g["s"].alias("s"), g["e"].alias("e"), g["t"].alias("t"), F.concat(g["members"], F.array(x["id"])).alias("members"))).otherwise(g))
        return F.when(first > 0, grown).otherwise(F.concat(acc, F.array(F.struct(x["s"].alias("s"), x["e"].alias("e"), x["t"].alias("t"), F.array(x["id"]).alias("members")))))

    folded = F.aggregate(F.array_sort(F.collect_list(item)), F.array().cast(shape), step)
    return spans.groupBy(key).agg(folded.alias("g")).select(key, F.explode("g").alias("g")).select(key, F.col("g.s").alias("start"), F.col("g.e").alias("end"), F.col("g.t").alias("text"), F.col("g.members").alias("members"))


def drop_forbidden(spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """Spans by falling score, then id; one is dropped if it overlaps a higher one that is still kept, unless the
    two may overlap (their types are equal). Columns: key, start, end, type, score, id."""
    item = F.struct((-F.col("score")).alias("rank"), F.col("id").alias("id"), F.col("start").alias("s"), F.col("end").alias("e"), F.col("type").alias("k"))
    shape = "array<struct<rank:double,id:string,s:bigint,e:bigint,k:string>>"
    clash = lambda y, x: (y["s"] < x["e"]) & (x["s"] < y["e"]) & (y["k"] != x["k"])
    kept = F.aggregate(F.array_sort(F.collect_list(item)), F.array().cast(shape), lambda acc, x: F.when(F.exists(acc, lambda y: clash(y, x)), acc).otherwise(F.concat(acc, F.array(x))))
    return spans.groupBy(key).agg(kept.alias("x")).select(key, F.explode("x").alias("x")).select(key, F.col("x.s").alias("start"), F.col("x.e").alias("end"), F.col("x.k").alias("type"), (-F.col("x.rank")).alias("score"), F.col("x.id").alias("id"))
