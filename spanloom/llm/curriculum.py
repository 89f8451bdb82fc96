"""Mixing sources to target weights, as a curriculum that changes over the training run.

Targets: sources by code point (null last) weigh 3, 1, 2, repeating; they share ``share`` times all words; a source that
would exceed ``epochs`` times its words stops there and the rest is shared anew by weight, until none is above.

Schedule: over training time t in [0, 1], source i is drawn at rate target * (1 + tilt * (1 - 2t)), with a tilt in
[-TILT, TILT] by its place, from early to late; the integral over the run is its target. The words of a source are laid
out in a fixed random order of its documents, once for each epoch. A copy whose words begin at demand d trains at the
time when the integrated schedule reaches d (a quadratic, inverted in closed form), and ends when it reaches the demand
behind its words, or with the run. What a copy gives is what the schedule demands between the two times, in whole words;
a copy that the run does not reach gives nothing. Documents are range-sorted by position.

The running sums take three levels (groups of hash buckets of a source, the buckets of a group, the rows of a bucket), so a
hot source is spread over all tasks. The sources themselves, a row each, are balanced on the driver.

Defined results: null and empty texts have size 0, no position, and take 0 words. Rows with the same id, text and source
are separate rows, each with a place of its own, in arbitrary order. Other columns are kept, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_PATTERN, Scratch

WEIGHTS = (3.0, 1.0, 2.0)
#: Under 1, so that no source's rate reaches 0.
TILT = 0.8
#: Hexadecimal digits of a row's turn that name its bucket: a third of 100 TB makes buckets of half a GB.
DIGITS = 4


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def targets(sizes: list[tuple[str | None, int]], share: float = 1.5, epochs: float = 2.0, weights: tuple[float, ...] = WEIGHTS) -> dict[str | None, float]:
    """The words wanted of each source, from (source, words)."""
    order = sorted(sizes, key=lambda s: (s[0] is None, s[0] or ""))
    weight = {s: weights[i % len(weights)] for i, (s, _) in enumerate(order)}
    cap = {s: epochs * n for s, n in order}
    out: dict[str | None, float] = {}
    rest, open_ = share * sum(n for _, n in order), [s for s, _ in order]
    while open_:
        total = sum(weight[s] for s in open_)
        wanted = {s: rest * weight[s] / total for s in open_}
        above = [s for s in open_ if wanted[s] > cap[s]]
        if not above:
            return out | wanted
        for s in above:
            out[s] = float(cap[s])
            rest -= cap[s]
        open_ = [s for s in open_ if s not in out]
    return out


def _position(at: Column, target: Column, tilt: Column) -> Column:
    """When the integrated schedule, _demand, reaches ``at``; null if that is not before the end of the run."""
    a, c = 1 + tilt, at / target
    root = F.sqrt(F.greatest(a * a - 4 * tilt * c, F.lit(0.0)))
    return F.when(at < target, 2 * c / (a + root))


def _demand(t: Column, target: Column, tilt: Column) -> Column:
    """The integral of target * (1 + tilt * (1 - 2t)) up to t, in whole words."""
    return F.round(target * ((1 + tilt) * t - tilt * t * t)).cast("long")


def _turn(doc_id: Column, text: Column, source: Column) -> Column:
    """The place of a row in its source's random order: a digest of id, text and source, the same in every run."""
    body = F.md5(F.encode(F.coalesce(text, F.lit("")), "utf-8"))
    named = F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))
    return F.md5(F.encode(F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("")), body, named), "utf-8"))


def _placed(docs: DataFrame, payload: Column, share: float, epochs: int, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """row (the payload), doc_id, size, source_size, target, copies (position, words) that train, taken."""
    spark = docs.sparkSession
    source = F.col(source_col).cast("string")
    rows = docs.select(payload.alias("row"), F.col(id_col).alias("doc_id"), source.alias("source"), word_count(F.col(text_col)).alias("size"), _turn(F.col(id_col), F.col(text_col), source).alias("turn"))
    # A cell is a bucket of a source; its name starts with the bucket, so that of no two sources is the same.
    cell = F.concat(F.substring("turn", 1, DIGITS), F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")))
    rows = rows.withColumn("cell", cell)
    sums = Scratch(spark, "mix").save(rows.groupBy("cell").agg(F.first("source").alias("source"), F.sum("size").alias("words")))
    sources = sorted(((r.source, r.words) for r in sums.groupBy("source").agg(F.sum("words").alias("words")).collect()), key=lambda x: (x[0] is None, x[0] or ""))
    wanted, last = targets(sources, share, float(epochs)), max(len(sources) - 1, 1)
    plan = [(s, int(n), float(wanted[s]), TILT * (2 * i / last - 1)) for i, (s, n) in enumerate(sources)]
    facts = spark.createDataFrame(plan, "f string, source_size long, target double, tilt double")
    # Running sums over groups of cells, then over the cells of a group: at most 16 ** (DIGITS / 2) rows in a window.
    group = F.concat(F.substring("cell", 1, DIGITS // 2), F.substring("cell", DIGITS + 1, 1 << 30))
    sums = sums.withColumn("group", group)
    earlier = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    groups = sums.groupBy("group").agg(F.first("source").alias("source"), F.sum("words").alias("w"))
    groups = groups.withColumn("groups_before", F.coalesce(F.sum("w").over(earlier("source").orderBy("group")), F.lit(0)))
    groups = groups.join(facts, F.col("source").eqNullSafe(F.col("f"))).select("group", "groups_before", "source_size", "target", "tilt")
    cells = sums.withColumn("cells_before", F.coalesce(F.sum("words").over(earlier("group").orderBy("cell")), F.lit(0)))
    before = cells.join(groups, "group").select("cell", (F.col("groups_before") + F.col("cells_before")).alias("before"), "source_size", "target", "tilt")
    inner = Window.partitionBy("cell").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    at = F.col("before") + F.col("within")
    # The last word of the run is a whole one.
    end = F.greatest(F.round("target"), F.lit(1.0))

    def copy(e: Column) -> Column:
        start = e * F.col("source_size") + at
        t0, t1 = (_position(d.cast("double"), end, F.col("tilt")) for d in (start, start + F.col("size")))
        words = _demand(F.coalesce(t1, F.lit(1.0)), end, F.col("tilt")) - _demand(t0, end, F.col("tilt"))
        return F.struct(t0.alias("position"), F.coalesce(words, F.lit(0)).alias("words"))

    copies = F.filter(F.transform(F.sequence(F.lit(0), F.lit(epochs - 1)), copy), lambda c: c["words"] > 0)
    placed = rows.withColumn("within", F.coalesce(F.sum("size").over(inner), F.lit(0))).join(before, "cell").withColumn("copies", copies)
    taken = F.aggregate("copies", F.lit(0).cast("long"), lambda n, c: n + c["words"])
    return placed.select("row", "doc_id", "size", "source_size", "target", F.when(F.col("target") >= 0.5, F.col("copies")).otherwise(F.array().cast(placed.schema["copies"].dataType)).alias("copies")).withColumn("taken", taken)


def curriculum(docs: DataFrame, share: float = 1.5, epochs: int = 2, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """A row for each row of ``docs``: doc_id, size, source_size, target, taken, and ``positions``: of each epoch's copy
    that is taken, the training position in [0, 1] and its words; range-sorted by first position, untaken rows last."""
    first = F.when(F.size("copies") > 0, F.col("copies")[0]["position"])
    order = [F.col("position").asc_nulls_last(), F.xxhash64("doc_id")]
    return (
        _placed(docs, F.lit(None).cast("string"), share, epochs, id_col, text_col, source_col)
        .select("doc_id", "size", "source_size", "target", "taken", F.col("copies").alias("positions"), first.alias("position"))
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
    )


def mix_rows(docs: DataFrame, share: float = 1.5, epochs: int = 2, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of ``docs`` as they train, range-sorted by position: one for each copy that is taken. A copy that the
    target cuts short is taken whole if at least half of its words are wanted, else left out."""
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    copies = _placed(docs, row, share, epochs, id_col, text_col, source_col).select("row", "size", F.explode("copies").alias("copy"))
    order = [F.col("copy.position"), F.xxhash64(F.col(f"row.`{id_col}`"))]
    return copies.where(F.col("copy.words") * 2 >= F.col("size")).repartitionByRange(*order).sortWithinPartitions(*order).select(*(F.col(f"row.`{c}`") for c in docs.columns))
