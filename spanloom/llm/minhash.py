"""Near-duplicate documents by b-bit MinHash.

1. One pass sketches each text: its distinct word shingles, K minima, the low b bits of each minimum packed into
   a signature, and one key for each band of R minima.
2. Texts with equal shingle sets form a class; only one representative goes on (the class is linked by definition).
3. In each band bucket every member meets the bucket's smallest member. The packed signatures estimate the
   similarity by counting equal b-bit fields, corrected for chance collisions; what is clearly below the threshold
   goes, the rest is decided on the full shingle sets.
4. Buckets whose members are still in several components are compared further: those outside of the component of the
   bucket's smallest member (its *rest*) against all members, in blocks of about BLOCK members and BLOCK_BYTES of text.
   A task holds a block of each side and emits a spanning forest of the confirmed links instead of all pairs. So no
   bucket is capped, no task holds a bucket, and no group of copies is expanded into pairs; the rows that are dealt
   out grow with members times rest, not with the square of a bucket that the first step has linked.

Joins whose sides Spark takes for too small carry a merge hint: it counts a row with 25 band keys as one row, and texts
by their compressed files, and would broadcast them through the driver.

Defined results: null or empty texts have no shingles and link with nothing. A null id links with nothing and keeps a
null component. Rows that repeat an id are one vertex. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, WordHasher, claim, mix64, rolling, text_slices
from .components import connected_components

BANDS, ROWS, BITS = 25, 5, 4
HASHES = 128
#: Estimates under threshold - SLACK are dropped: over four standard deviations of an estimate from 128 fields.
SLACK = 0.15
#: Members of a bucket that a task compares with as many others, and bytes of their texts, on average.
BLOCK, BLOCK_BYTES = 256, 2 << 20

_rng = np.random.default_rng(20240229)
_A = _rng.integers(0, 2**32, HASHES, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_B = _rng.integers(0, 2**32, HASHES, dtype=np.uint64).astype(np.uint32)


def shingles(text: bytes | None, k: int, hasher: WordHasher) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles of a text; of the whole text, if it has fewer words."""
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = hasher.of(words)
    s = np.unique(rolling(h, min(k, len(h))))
    return s if len(h) >= k else s ^ np.uint64(len(h))


def minima(s: np.ndarray) -> np.ndarray:
    x, low = (s >> np.uint64(32)).astype(np.uint32), np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 2048):
        part = np.multiply(_A[:, None], x[None, at : at + 2048])
        part += _B[:, None]
        np.minimum(low, part.min(axis=1), out=low)
    return low


def pack(low: np.ndarray) -> bytes:
    """The low BITS bits of each (mixed) minimum, two fields a byte."""
    f = (mix64(low.astype(np.uint64)) & np.uint64((1 << BITS) - 1)).astype(np.uint8)
    return (f[0::2] | (f[1::2] << 4)).tobytes()


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity of rows of packed signatures (uint8, broadcastable): equal fields, less those equal by chance."""
    d = a ^ b
    equal = ((d & 15) == 0).sum(-1, dtype=np.int32) + ((d >> 4) == 0).sum(-1, dtype=np.int32)
    return (equal / HASHES - 2.0**-BITS) / (1 - 2.0**-BITS)


def band_keys(low: np.ndarray) -> list[int]:
    rows = low[: BANDS * ROWS].astype(np.uint64).reshape(BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for j in range(ROWS):
        key = mix64(key ^ rows[:, j]) + np.uint64(j)
    return key.view(np.int64)


_SKETCH = pa.schema(
    [("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("n_bytes", pa.int64()), ("set_key", pa.binary()), ("sig", pa.binary()), ("bands", pa.list_(pa.int64()))]
)
_SKETCH_DDL = "doc_id long, n_shingles long, n_bytes long, set_key binary, sig binary, bands array<long>"


def _sketcher(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("minhash")
        hasher = WordHasher()
        for part in text_slices(batches):
            out: dict[str, list] = {n: [] for n in _SKETCH.names}
            for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                s = shingles(text, k, hasher)
                out["doc_id"].append(doc)
                out["n_shingles"].append(len(s))
                out["n_bytes"].append(len(text or b""))
                if len(s):
                    low = minima(s)
                    out["set_key"].append(xxhash.xxh3_128_digest(s.tobytes()))
                    out["sig"].append(pack(low))
                    out["bands"].append(band_keys(low))
                else:
                    for name in ("set_key", "sig", "bands"):
                        out[name].append(None)
            yield pa.RecordBatch.from_pydict(out, schema=_SKETCH)

    return run


def _estimated(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("sig_a", "sig_b"))
                keep = pa.array(estimate(a, b) >= least)
                yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], ["a", "b"])

    return run


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def _confirmed(k: int, percent: int):
    """Pairs with both texts, to the pairs whose full sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("minhash")
        hasher = WordHasher()
        for part in text_slices(batches, "text_a"):
            out: tuple[list, list] = ([], [])
            last, x = None, None
            for a, b, s, t in zip(*(part.column(c).to_pylist() for c in ("a", "b", "text_a", "text_b"))):
                if s != last:
                    last, x = s, shingles(s, k, hasher)
                if _linked(x, shingles(t, k, hasher), percent):
                    out[0].append(a)
                    out[1].append(b)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64())], ["a", "b"])

    return run


class _Forest:
    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (y := self.up.get(x, x)) != x:
            self.up[x] = x = self.up.get(y, y)
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


def _sides(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed signatures of a group, and the rows of its block of the rest and of its block of all members."""
    sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint8).reshape(t.num_rows, -1)
    rest = t.column("rest").to_numpy()
    return sig, np.flatnonzero(rest), np.flatnonzero(~rest)


def _suspects(least: float):
    """Of two blocks of a bucket: the members that have a likely partner in another component."""

    def run(t):
        t = t.combine_chunks()
        sig, x, y = _sides(t)
        comp, found = t.column("component").to_numpy(), np.zeros(t.num_rows, bool)
        for at in range(0, len(x), 64):
            part = x[at : at + 64]
            hit = (estimate(sig[part, None], sig[None, y]) >= least) & (comp[part, None] != comp[None, y])
            found[part] = hit.any(1)
            found[y] |= hit.any(0)
        return t.filter(pa.array(found))

    return run


def _spanning(k: int, percent: int, least: float):
    """Of two blocks of a bucket, with texts: confirmed links that join components, as a spanning forest."""

    def run(t):
        claim("minhash")
        hasher, forest, links, sets = WordHasher(), _Forest(), ([], []), {}
        t = t.combine_chunks()
        sig, x, y = _sides(t)
        rep, comp, text = t.column("rep").to_pylist(), t.column("component").to_pylist(), t.column("text")

        def of(row: int) -> np.ndarray:
            if row not in sets:
                sets[row] = shingles(text[row].as_py(), k, hasher)
            return sets[row]

        for a in x.tolist():
            e = estimate(sig[a], sig[y])
            for b in y[np.argsort(-e, kind="stable")[: int((e >= least).sum())]].tolist():
                if forest.root(comp[a]) != forest.root(comp[b]) and _linked(of(a), of(b), percent):
                    forest.join(comp[a], comp[b])
                    links[0].append(rep[a])
                    links[1].append(rep[b])
        return pa.table([pa.array(links[0], pa.int64()), pa.array(links[1], pa.int64())], names=["a", "b"])

    return run


def minhash_dedup(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per row of ``docs``.

    Texts are linked if 100 * shared shingles >= ``percent`` * shingles of either; a component is what links reach.
    """
    spark = docs.sparkSession
    scratch, least = Scratch(spark, "minhash"), percent / 100 - SLACK
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    sketch = scratch.save(source.mapInArrow(_sketcher(k), _SKETCH_DDL))
    usable = sketch.where("set_key is not null and doc_id is not null")
    # One row a class, however often an id and its text are repeated; equal sets have equal signatures and bands.
    reps = scratch.save(usable.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.max("n_bytes").alias("n_bytes"), F.any_value("sig").alias("sig"), F.any_value("bands").alias("bands")))
    copies = usable.select("set_key", "doc_id").join(reps.select("set_key", "rep"), "set_key")
    own = copies.where("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))

    # Buckets of two or more, each member with the bucket's smallest.
    banded = reps.select("rep", F.explode("bands").alias("bucket"))
    heads = banded.groupBy("bucket").agg(F.min("rep").alias("head"), F.max("rep").alias("last"), F.count("*").alias("n")).where("head <> last")
    members = scratch.save(banded.hint("merge").join(heads.select("bucket", "head", "n"), "bucket"))
    signed = reps.select("rep", "sig")
    stars = (
        members.where("rep <> head")
        .select(F.col("head").alias("a"), F.col("rep").alias("b"))
        .distinct()
        .join(signed.select(F.col("rep").alias("a"), F.col("sig").alias("sig_a")), "a")
        .join(signed.select(F.col("rep").alias("b"), F.col("sig").alias("sig_b")), "b")
        .select("a", "b", "sig_a", "sig_b")
        .mapInArrow(_estimated(least), "a long, b long")
    )
    texts = source.where("text is not null").hint("merge")
    pairs = (
        stars.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
        .join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
        .select("a", "b", "text_a", "text_b")
    )
    links = scratch.save(pairs.mapInArrow(_confirmed(k, percent), "a long, b long"), few=True)

    # Larger buckets that the stars left in several components: their rest against all members.
    comps = connected_components(links, scratch)
    placed = members.where("n > 2").join(comps.select(F.col("vertex").alias("rep"), "component"), "rep", "left").select(
        "bucket", "rep", F.coalesce("component", "rep").alias("component")
    )
    split = placed.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.min_by("component", "rep").alias("home")).where("x <> y").select("bucket", "home")
    open_ = placed.join(split, "bucket").join(reps.select("rep", "sig", "n_bytes"), "rep").withColumn("rest", F.col("component") != F.col("home"))
    dealt_in = lambda n, size: F.greatest(F.ceil(n / BLOCK), F.ceil(size / BLOCK_BYTES), F.lit(1)).cast("int")
    blocks = open_.groupBy("bucket").agg(
        dealt_in(F.count_if("rest"), F.sum(F.when(F.col("rest"), F.col("n_bytes")).otherwise(0))).alias("m_rest"),
        dealt_in(F.count("*"), F.sum("n_bytes")).alias("m_all"),
    )
    cell = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    spread = open_.select("bucket", "rep", "component", "sig", "rest").join(blocks, "bucket")
    left = spread.where("rest").select("bucket", cell("m_rest").alias("i"), each("m_all").alias("j"), "rep", "component", "sig", "rest")
    right = spread.select("bucket", each("m_rest").alias("i"), cell("m_all").alias("j"), "rep", "component", "sig", F.lit(False).alias("rest"))
    shape = "bucket long, i int, j int, rep long, component long, sig binary, rest boolean"
    suspects = scratch.save(left.unionByName(right).groupBy("bucket", "i", "j").applyInArrow(_suspects(least), shape), few=True)
    more = links
    if not suspects.isEmpty():
        # The same suspects meet in many buckets: of equal groups one is enough.
        member = F.md5(F.concat(F.concat_ws(":", "rep", "rest").cast("binary"), F.lit(b":"), F.col("sig")))
        group = suspects.groupBy("bucket", "i", "j").agg(F.md5(F.array_join(F.sort_array(F.collect_set(member)), "")).alias("who"))
        once = group.groupBy("who").agg(F.min(F.struct("bucket", "i", "j")).alias("g")).select("g.bucket", "g.i", "g.j")
        held = suspects.join(once, ["bucket", "i", "j"]).join(texts.withColumnRenamed("doc_id", "rep"), "rep")
        more = links.unionByName(held.groupBy("bucket", "i", "j").applyInArrow(_spanning(k, percent, least), "a long, b long"))
    final = connected_components(more.unionByName(own), scratch)
    return sketch.join(final.withColumnRenamed("vertex", "doc_id"), "doc_id", "left").select(
        "doc_id", "n_shingles",
        F.coalesce("component", "doc_id").alias("component_id"),
        F.coalesce(F.coalesce("component", "doc_id") == F.col("doc_id"), F.lit(True)).alias("kept"),
    )
