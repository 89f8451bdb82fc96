"""Exact set-similarity joins without comparing all pairs, and dense search."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import Saved


#: Counters of the sketch that orders items, a bounded array (a power of two).
SKETCH = 1 << 20
#: Words of 64 bits in the signature of a set, by its number of items; the next width from each of these on.
WIDTHS, WIDER = (4, 8, 16), (180, 440)
#: Rows that the index compares at once, and bytes and number of sets in a block of the last comparison.
INDEX_ROWS, BLOCK_BYTES, BLOCK_SETS = 200_000, 8 << 20, 4096


def _signature(items: np.ndarray) -> bytes:
    """Bit k is the parity of the items whose hash ends in k: two signatures differ in no more bits than their sets in
    items. A wide one folds into a narrower one."""
    bits = 64 * WIDTHS[int(np.searchsorted(WIDER, len(items), "right"))]
    place = (items * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)
    return np.packbits(np.bincount((place & np.uint64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1, bitorder="little").tobytes()


def _lists(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets of a list column."""
    c = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = c.value_lengths().to_numpy(zero_copy_only=False)
    return c.flatten().to_numpy(zero_copy_only=False).view(np.uint64), np.concatenate([[0], np.cumsum(sizes)])


def _prefixes(least: float, counts):
    """Sets (id, items) to their index entries: item, id, n, place, signature."""
    shape = pa.schema([("item", pa.int64()), ("id", pa.int64()), ("n", pa.int32()), ("i", pa.int32()), ("sig", pa.binary())])

    def run(batches):
        often = counts.value
        for batch in batches:
            values, at = _lists(batch.column(1))
            for lo in range(0, batch.num_rows, 256):
                out = []
                for r in range(lo, min(lo + 256, batch.num_rows)):
                    x = values[at[r] : at[r + 1]]
                    n = len(x)
                    df = often[(x & np.uint64(SKETCH - 1)).astype(np.int64)]
                    k = n - int(np.ceil(round(n * least, 9))) + 1
                    order = np.lexsort((x, df))[:k]
                    place = np.flatnonzero(df[order] > 1)
                    out.append((x[order[place]].view(np.int64), batch.column(0)[r].as_py(), n, place + 1, _signature(x)))
                size = [len(o[0]) for o in out]
                each = lambda c, t: pa.array(np.repeat(np.array([o[c] for o in out]), size), t)
                sig = pa.array([o[4] for o in out], pa.binary()).take(pa.array(np.repeat(np.arange(len(out)), size)))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[0] for o in out])), each(1, pa.int64()), each(2, pa.int32()), pa.array(np.concatenate([o[3] for o in out]).astype(np.int32)), sig], schema=shape)

    return run


def _folded(sigs: list[bytes]) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """Words of each signature, and all signatures at each width (a row is void where it is narrower)."""
    words = np.array([len(x) // 8 for x in sigs])
    full = np.zeros((len(sigs), WIDTHS[-1]), np.uint64)
    for w in WIDTHS:
        rows = np.flatnonzero(words == w)
        if len(rows):
            full[rows, :w] = np.frombuffer(b"".join(sigs[r] for r in rows), np.uint64).reshape(-1, w)
    out = {WIDTHS[-1]: full}
    for w in WIDTHS[-2::-1]:
        wide = out[2 * w]
        out[w] = np.where((words > w)[:, None], wide[:, :w] ^ wide[:, w : 2 * w], wide[:, :w])
    return words, out


def _near(t: pa.Table, least: float) -> np.ndarray:
    """Pairs (a, b, na, nb) of an index part, sorted by item and n, that may be similar."""
    col = lambda c: t.column(c).to_numpy()
    item, ids, n, i = col("item"), col("id"), col("n").astype(np.int64), col("i").astype(np.int64)
    words, sigs = _folded(t.column("sig").to_pylist())
    share, found, held = least / (1 + least), [], []

    def check() -> None:
        if not held:
            return
        x, y = (np.concatenate(c) for c in zip(*held))
        held.clear()
        both = n[x] + n[y]
        fits = np.zeros(len(x), bool)
        narrow = np.minimum(words[x], words[y])
        for w in WIDTHS:
            for part in np.array_split(s := np.flatnonzero(narrow == w), 1 + len(s) // 100_000):
                fits[part] = np.bitwise_count(sigs[w][x[part]] ^ sigs[w][y[part]]).sum(1) <= (1 - 2 * share) * both[part] + 1e-6
        x, y = x[fits], y[fits]
        swap = ids[x] > ids[y]
        x, y = np.where(swap, y, x), np.where(swap, x, y)
        found.append(np.stack([ids[x], ids[y], n[x], n[y]], 1))

    # Rows of an item stand by size: once a row's partner is another item's or too large, so are all later ones.
    rows, lag, waiting = np.arange(len(item)), 0, 0
    while len(rows):
        lag += 1
        rows = rows[rows + lag < len(item)]
        other = rows + lag
        going = (item[rows] == item[other]) & (n[rows] >= n[other] * least - 1e-9)
        rows, other = rows[going], other[going]
        # What two sets can share from their first common item on.
        worth = 1 + np.minimum(n[rows] - i[rows], n[other] - i[other]) >= share * (n[rows] + n[other]) - 1e-6
        if worth.any():
            held.append((rows[worth], other[worth]))
            waiting += int(worth.sum())
            if waiting > 500_000:
                check()
                waiting = 0
    check()
    return np.unique(np.concatenate(found), axis=0) if found else np.empty((0, 4), np.int64)


def _index_pairs(least: float):
    def run(batches):
        shape = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("na", pa.int64()), ("nb", pa.int64())])
        held, rows = [], 0

        def done(parts):
            for at in range(0, len(p := _near(pa.Table.from_batches(parts), least)), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in p[at : at + 100_000].T.copy()], schema=shape)

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows += batch.num_rows
            items = batch.column(0).to_numpy()
            cut = int(np.flatnonzero(items == items[-1])[0])
            if rows >= INDEX_ROWS and cut:
                yield from done([*held[:-1], batch.slice(0, cut)])
                held, rows = [batch.slice(cut)], batch.num_rows - cut
        if held:
            yield from done(held)

    return run


def _compare(least: float):
    """Sorted rows of tiles, first sets (id a, items), then pairs (a, b): pairs with their Jaccard index."""

    def score(ids: list, sets: list, pairs: list) -> pa.RecordBatch:
        place = {x: k for k, x in enumerate(ids)}
        sizes = np.array([len(x) for x in sets])
        start = np.concatenate([[0], np.cumsum(sizes)])
        _, dense = np.unique(np.concatenate(sets), return_inverse=True)
        mark, out = np.zeros(len(dense), bool), ([], [], [])
        at = 0
        while at < len(pairs):
            a, end = pairs[at][0], at
            while end < len(pairs) and pairs[end][0] == a:
                end += 1
            x = place[a]
            own = dense[start[x] : start[x + 1]]
            mark[own] = True
            for _, b in pairs[at:end]:
                y = place[b]
                both = int(np.count_nonzero(mark[dense[start[y] : start[y + 1]]]))
                jaccard = both / (sizes[x] + sizes[y] - both)
                if jaccard >= least:
                    for c, v in zip(out, (a, b, float(jaccard))):
                        c.append(v)
            mark[own] = False
            at = end
        return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], names=["a", "b", "jaccard"])

    def run(batches):
        last, ids, sets, pairs = None, [], [], []
        for batch in batches:
            tiles, first, second = (batch.column(c).to_pylist() for c in ("tile", "a", "b"))
            values, at = _lists(batch.column(batch.schema.get_field_index("items")))
            for r, tile in enumerate(tiles):
                if tile != last:
                    if pairs:
                        yield score(ids, sets, sorted(pairs))
                    last, ids, sets, pairs = tile, [], [], []
                if second[r] is None:
                    ids.append(first[r])
                    sets.append(values[at[r] : at[r + 1]].copy())
                else:
                    pairs.append((first[r], second[r]))
        if pairs:
            yield score(ids, sets, sorted(pairs))

    return run


def _similar(whole: DataFrame, least: float) -> DataFrame:
    """Pairs (a < b, jaccard) of different sets (id long, items: sorted hashes) with jaccard >= least."""
    spark = whole.sparkSession
    cell = F.col("item").bitwiseAND(F.lit(SKETCH - 1)).cast("int")
    counted = whole.select(F.explode("items").alias("item")).groupBy(cell.alias("cell")).agg(F.count("*").cast("int").alias("n")).toArrow()
    often = np.zeros(SKETCH, np.int32)
    often[counted.column("cell").to_numpy()] = counted.column("n").to_numpy()
    entries = whole.mapInArrow(_prefixes(least, spark.sparkContext.broadcast(often)), "item long, id long, n int, i int, sig binary")
    found = entries.repartition("item").sortWithinPartitions("item", "n").mapInArrow(_index_pairs(least), "a long, b long, na long, nb long")
    store = Saved(spark)
    pairs, _ = store.put(found.groupBy("a", "b").agg(F.first("na").alias("na"), F.first("nb").alias("nb")))
    # Sets of similar sizes are dealt to blocks of bounded bytes; a tile takes the sets of two blocks that its pairs name.
    band = lambda n: F.floor(F.log(F.col(n).cast("double")) * 8).cast("int")
    bands = whole.select(F.size("items").alias("n")).groupBy(band("n").alias("band")).agg(F.sum("n").alias("n"), F.count("*").alias("sets")).collect()
    many = F.create_map(*(F.lit(x) for r in bands for x in (r.band, 1 + max(8 * r.n // BLOCK_BYTES, r.sets // BLOCK_SETS)))) if bands else F.create_map().cast("map<int,bigint>")
    block = lambda i, n: F.concat_ws(".", band(n), F.pmod(F.xxhash64(i), F.element_at(many, band(n))))
    tiled = pairs.select(F.concat_ws("/", block("a", "na"), block("b", "nb")).alias("tile"), "a", "b")
    ends = tiled.select("tile", F.explode(F.array("a", "b")).alias("id")).distinct()
    sets = ends.join(whole.hint("merge"), "id").select("tile", F.col("id").alias("a"), F.lit(None).cast("long").alias("b"), "items")
    rows = sets.unionByName(tiled.withColumn("items", F.array().cast("array<long>")))
    return rows.repartition("tile").sortWithinPartitions("tile").mapInArrow(_compare(least), "a long, b long, jaccard double")


def jaccard_classes(sets: DataFrame, least: float, id_col: str = "id", set_col: str = "items") -> tuple[DataFrame, DataFrame]:
    """(members, pairs): equal sets are one class, named after its smallest id. members: id, class, n (items); pairs of
    different classes (a < b, jaccard) with jaccard >= least, exactly (up to 64-bit hashes of items), by prefix filtering.

    Items are ordered by how often their cell of a bounded sketch is met, rarest first (any order is right; this one is
    quick); sets as similar as ``least`` share an item among the first n - ceil(least * n) + 1 of each, so only those meet.
    Where they meet, sizes, places and signatures rule out nearly all pairs before any is written or shuffled; what is left
    fetches its sets by tiles, so that a set comes once for all pairs of a tile."""
    hashes = F.sort_array(F.array_distinct(F.transform(set_col, lambda x: F.xxhash64(x))))
    base = sets.select(F.col(id_col).alias("id"), hashes.alias("items")).withColumn("key", F.md5(F.array_join(F.transform("items", lambda x: x.cast("string")), ",").cast("binary")))
    classes = base.groupBy("key").agg(F.min("id").alias("class"), F.first("items").alias("items"))
    kept, _ = Saved(sets.sparkSession).put(classes)
    members = base.select("id", "key", F.size("items").alias("n")).join(kept.select("key", "class").hint("merge"), "key").select("id", "class", "n")
    whole = kept.where(F.size("items") > 0).select(F.col("class").cast("long").alias("id"), "items")
    return members, _similar(whole, least)


def jaccard_join(sets: DataFrame, least: float, id_col: str = "id", set_col: str = "items") -> DataFrame:
    """Links (a < b, jaccard) that lose nothing: pairs between classes of equal sets, and each member of a class with the
    class's smallest id, with 1. (Two empty sets are equal.) So a group of copies has as many links as members."""
    members, pairs = jaccard_classes(sets, least, id_col, set_col)
    copies = members.where(F.col("id") != F.col("class")).select(F.col("class").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("jaccard"))
    return pairs.unionByName(copies)


#: Queries and vectors of a tile in dense search.
QUERY_BLOCK, VECTOR_BLOCK = 256, 4096


def _best_of_tile(k: int):
    def run(q, v):
        a, b = (np.asarray(t.column(c).combine_chunks().flatten(), np.float64).reshape(max(t.num_rows, 1), -1) for t, c in ((q, "q"), (v, "v")))
        qid, vid = q.column("query_id").to_numpy(), v.column("vec_id").to_numpy()
        none = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        out = tuple([c] for c in none)
        if not len(qid) or not len(vid):
            return pa.table([pa.array(c) for c in none], names=["query_id", "vec_id", "score"])
        for i in range(len(a)):
            score = b @ a[i]
            best = [j for j in np.lexsort((vid, -score))[: k + 1].tolist() if vid[j] != qid[i]][:k]
            for c, x in zip(out, (np.full(len(best), qid[i]), vid[best], score[best])):
                c.append(x)
        return pa.table([pa.array(np.concatenate(c)) for c in out], names=["query_id", "vec_id", "score"])

    return run


def dense_top_k(queries: DataFrame, vectors: DataFrame, k: int, query_id: str = "query_id", vector_id: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """The k vectors with the largest dot product for each query, ties by id; all vectors have one length.

    The queries are a stated set, held against all vectors in tiles of a block of each; a tile keeps k rows a query, so
    neither pairs nor all vectors meet in a task."""
    n_q = max(1, -(-queries.count() // QUERY_BLOCK))
    n_v = max(1, -(-vectors.count() // VECTOR_BLOCK))
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = queries.select(F.col(query_id).cast("long").alias("query_id"), F.col(vec).alias("q")).withColumn("i", deal("query_id", n_q)).withColumn("j", each(n_v))
    v = vectors.select(F.col(vector_id).cast("long").alias("vec_id"), F.col(vec).alias("v")).withColumn("j", deal("vec_id", n_v)).withColumn("i", each(n_q))
    tiles = q.groupBy("i", "j").cogroup(v.groupBy("i", "j")).applyInArrow(_best_of_tile(k), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return tiles.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
