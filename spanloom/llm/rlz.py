"""Substring dedup by relative Lempel-Ziv parsing: what a document copies from an earlier place is a factor.

Every document is reference text and is indexed whole. A window of W words has a minimizer, the smallest of its G-word
grams; a *block* is a run of windows with the same minimizer, so equal text falls into equal blocks wherever it stands.

1. One pass cuts each document into blocks (gram hash, hash of the block's words, place). A map task keeps the first
   place of equal blocks and settles the others at once, so a passage in a third of all documents leaves a task once.
2. The index of blocks is range-sharded by gram and content, so a gram with very many contexts is spread over shards. In
   a shard, a block whose words occur at an earlier place is a copy of the first. Blocks that share a gram but differ
   may be factor boundaries: copied text ends inside them. (So may those of a gram that a shard's edge cuts.)
3. Boundary blocks are looked up window by window, by the same two steps with windows in place of blocks.
4. A document is factored greedily: at the first place from which a window occurs earlier, the factor runs on as long as
   its source does, the next factor begins where it ends. Windows that lie across the end of a factor are checked one by
   one, and those with an earlier equal are boundary factors of their own. What factors cover is removed.

The first place of any window lies in the first of its equal blocks, so the result is exact: each window with an
earlier equal is found, and no other. Windows are judged on the input, not on what is left.

Defined results: null and empty texts have no words, keep an empty text, and copy nothing. Rows with the same id are one
document for "earlier": what they share at the same place is no copy. Rows without an id come after all others and are
one document in that sense, too (as is the id 2**63 - 1). Other columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, WordHasher, claim, mix64, rolling, text_slices

#: Words of the gram that anchors a block.
GRAM = 8
#: Blocks that a map task holds before it settles the equal ones.
BUFFER = 400_000
_BASE = np.uint64(0xD1342543DE82EF95)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_LAST = 2**63 - 1
_TAG = (1 << 28) - 1
_KEYS = pa.schema([(n, pa.int64()) for n in ("k", "c", "doc", "loc", "s")])
_HITS = pa.schema([(n, pa.int64()) for n in ("doc", "loc", "src_doc", "src_loc")])


class Powers:
    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << n.bit_length()
            self.up, self.down = (np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, b)]), dtype=np.uint64) for b in (_BASE, _INVERSE))
        return self.up[:n], self.down[:n]


class Reader:
    """Hashes of the word ranges of one text, by prefix sums of a polynomial modulo 2**64."""

    def __init__(self, words: list[bytes], hasher: WordHasher, powers: Powers, window: int):
        self.h, self.window = hasher.of(words), window
        up, self.down = powers.of(len(words) + 1)
        self.sums = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(self.h * up[:-1], out=self.sums[1:])

    def ranges(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix64((self.sums[b] - self.sums[a]) * self.down[a] + (b - a).astype(np.uint64))

    def blocks(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each block: first window, number of windows, gram hash, place of the gram."""
        grams = rolling(self.h, min(GRAM, self.window))
        key = (grams & ~np.uint64(_TAG)) | np.arange(len(grams), dtype=np.uint64)
        span, width = self.window - min(GRAM, self.window) + 1, 1
        while width * 2 <= span:
            key = np.minimum(key[:-width], key[width:])
            width *= 2
        if width < span:
            key = np.minimum(key[: width - span], key[span - width :])
        at = (key & np.uint64(_TAG)).astype(np.int64)
        first = np.concatenate([[0], np.flatnonzero(np.diff(at)) + 1])
        return first, np.diff(np.append(first, len(at))), grams[at[first]], at[first]


def _settle(parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Rows (gram, content, doc, loc): the first of equal ones stays a candidate, later ones become copies of it."""
    k, c, doc, loc = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((loc, doc, c, k))
    k, c, doc, loc = k[order], c[order], doc[order], loc[order]
    head = np.concatenate([[True], (k[1:] != k[:-1]) | (c[1:] != c[:-1])])
    first = np.flatnonzero(head)[np.cumsum(head) - 1]
    copy = (doc != doc[first]) | (loc >> 32 != loc[first] >> 32)
    k = np.where(copy, mix64(doc.view(np.uint64)).view(np.int64), k)
    c, s = np.where(copy, doc[first], c), pa.array(loc[first], mask=~copy)
    keep = copy | head | (loc != loc[first])
    for at in range(0, len(k), 100_000):
        cut = slice(at, at + 100_000)
        yield pa.RecordBatch.from_arrays([*(pa.array(x[cut]) for x in (k, c, doc, loc)), s[cut]], schema=_KEYS).filter(pa.array(keep[cut]))


def _cutter(window: int, boundary: bool):
    """Texts to candidate rows: of blocks, or of the single windows of the blocks listed in ``marks``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("rlz")
        hasher, powers, parts, held = WordHasher(), Powers(), [], 0
        for part in text_slices(batches, "body"):
            marks = part.column("marks").to_pylist() if boundary else [None] * part.num_rows
            for doc, tag, text, marked in zip(*(part.column(n).to_pylist() for n in ("doc", "tag", "body")), marks):
                words = (text or b"").split()
                if len(words) < window:
                    continue
                read = Reader(words, hasher, powers, window)
                first, size, gram, place = read.blocks()
                if boundary:
                    chosen = np.isin(first, np.array([m >> 32 for m in marked], np.int64))
                    first, size, gram, place = first[chosen], size[chosen], gram[chosen], place[chosen]
                    within = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                    gram, place, first, size = np.repeat(gram, size), np.repeat(place, size), np.repeat(first, size) + within, np.ones(len(within), np.int64)
                content = read.ranges(first, first + size + window - 1) ^ mix64((place - first).astype(np.uint64))
                loc = (first << 32) | (np.minimum(size, 15) << 28) | tag
                parts.append((gram.view(np.int64), content.view(np.int64), np.full(len(first), doc, np.int64), loc))
                held += len(first)
            if held > BUFFER:
                yield from _settle(parts)
                parts, held = [], 0
        if parts:
            yield from _settle(parts)

    return run


def _judge(boundary: bool):
    """A shard of the index, sorted: copies with their source; and, without source, blocks that share their gram with
    others (unless these are windows already, ``boundary``).

    From batch to batch only the last class is remembered, and of a gram with one class so far its first places.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The last class: gram, content, first document and place; whether its gram is known to be shared.
        last: tuple | None = None
        shared, held, none = False, [], np.empty(0, np.int64)

        def hits(doc, loc, src_doc, src_loc, mask=None):
            return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(loc), pa.array(src_doc, mask=mask), pa.array(src_loc, mask=mask)], schema=_HITS)

        def marks(some: list[tuple[np.ndarray, np.ndarray]]):
            doc, loc = (np.concatenate([none, *x]) for x in zip(*some)) if some else (none, none)
            return hits(doc, loc, doc, loc, np.ones(len(doc), bool))

        for batch in batches:
            settled = _valid(batch.column("s"))
            if settled.any():
                b = batch.filter(pa.array(settled))
                yield pa.RecordBatch.from_arrays([b.column("doc"), b.column("loc"), b.column("c"), b.column("s")], schema=_HITS)
            b = batch.filter(pa.array(~settled))
            if not b.num_rows:
                continue
            k, c, doc, loc = (b.column(n).to_numpy() for n in ("k", "c", "doc", "loc"))
            new_gram, head = np.ones(len(k), bool), np.ones(len(k), bool)
            new_gram[1:] = k[1:] != k[:-1]
            head[1:] = new_gram[1:] | (c[1:] != c[:-1])
            if last:
                new_gram[0] = k[0] != last[0]
                head[0] = new_gram[0] or c[0] != last[1]
            # Row -1 of ``first`` stands for the class that goes on from the batch before.
            at = np.concatenate([[-1], np.flatnonzero(head)])[np.cumsum(head)]
            first_doc, first_loc = np.where(at < 0, last[2] if last else 0, doc[at]), np.where(at < 0, last[3] if last else 0, loc[at])
            copy = (doc != first_doc) | (loc >> 32 != first_loc >> 32)
            if copy.any():
                yield hits(doc[copy], loc[copy], first_doc[copy], first_loc[copy])
            if not boundary:
                gram = np.cumsum(new_gram)
                classes = np.bincount(gram, head)
                # Of gram 0, the one that goes on: one class more is known.
                classes[0] += bool(last)
                many = classes > 1
                many[0] |= shared
                # The first gram of a shard may go on from the shard before.
                if last is None:
                    many[1] = True
                if many[0]:
                    yield marks(held)
                    held = []
                known = ~copy & many[gram]
                if gram[-1]:
                    held = []
                if known.any():
                    yield marks([(doc[known], loc[known])])
                shared, open_ = bool(many[gram[-1]]), ~copy & (gram == gram[-1])
                if not shared:
                    held.append((doc[open_], loc[open_]))
            last = (k[-1], c[-1], first_doc[-1], first_loc[-1])
        # The last gram may go on in the next shard.
        if held:
            yield marks(held)

    return run


def _valid(column: pa.Array) -> np.ndarray:
    return column.is_valid().to_numpy(zero_copy_only=False)


def _factors(hits: list[dict], n_words: int, window: int) -> list[tuple[int, int, int, int]]:
    """Greedy factors (start, words, source document, source start) of a document, from the windows that occur earlier."""
    n = n_words - window + 1
    source, at = np.full(n, -1, np.int64), np.zeros(n, np.int64)
    for h in hits:
        a, size = h["loc"] >> 32, h["loc"] >> 28 & 15
        source[a : a + size] = h["src_doc"]
        at[a : a + size] = np.arange(size) + (h["src_loc"] >> 32)
    found = np.zeros(n + 1, bool)
    for h in hits:
        a = h["loc"] >> 32
        found[a : a + (h["loc"] >> 28 & 15)] = True
    # A run of windows whose source runs on is the longest match from any of its places.
    goes_on = found[1:n] & found[: n - 1] & (source[1:] == source[:-1]) & (at[1:] == at[:-1] + 1)
    ends = np.append(np.flatnonzero(~goes_on), n - 1) if n > 1 else np.zeros(1, np.int64)
    starts, out, pos = np.flatnonzero(found), [], 0
    while True:
        i = np.searchsorted(starts, pos)
        if i == len(starts):
            return out
        first = int(starts[i])
        last = int(ends[np.searchsorted(ends, first)])
        out.append((first, last - first + window, int(source[first]), int(at[first])))
        # Windows across the end of the factor.
        pos = last + window
        across = starts[np.searchsorted(starts, last + 1) : np.searchsorted(starts, pos)]
        out.extend((int(w), window, int(source[w]), int(at[w])) for w in across)


def _remover(window: int, schema: pa.Schema, verbatim: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("rlz")
        for part in text_slices(batches, "body"):
            out: dict[str, list] = {n: [] for n in ("n_words", "n_removed", "kept_text", "factors")}
            for text, *hits in zip(*(part.column(n).to_pylist() for n in ("body", "hits", "more"))):
                words = (text or b"").split()
                hits = [h for some in hits for h in some or ()]
                parts, cover = _factors(hits, len(words), window) if hits else [], np.zeros(len(words) + 1, np.int32)
                for start, n, _, _ in parts:
                    cover[start] += 1
                    cover[start + n] -= 1
                gone = np.cumsum(cover[:-1]) > 0
                removed = int(gone.sum())
                out["n_words"].append(len(words))
                out["n_removed"].append(removed)
                if removed or not verbatim:
                    text = b" ".join([w for w, g in zip(words, gone.tolist()) if not g] if removed else words)
                out["kept_text"].append(text)
                out["factors"].append([dict(zip(("start", "n_words", "src_doc", "src_start"), f)) for f in parts])
            yield pa.RecordBatch.from_arrays(
                [part.column(n) if n not in out else pa.array(out[n], pa.binary()).cast(pa.string()) if n == "kept_text" else pa.array(out[n], schema.field(n).type) for n in schema.names],
                schema=schema,
            )

    return run


_FACTORS = "array<struct<start:int,n_words:int,src_doc:bigint,src_start:int>>"


def rlz_dedup(docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text", verbatim: bool = False) -> DataFrame:
    """The rows of ``docs``: struct ``row`` (all columns but the text), n_words, n_removed, kept_text and factors.

    kept_text has one space between words; with ``verbatim``, texts that lose nothing stay as they are.

    A factor is (start, n_words, src_doc, src_start) in words; its words occur from src_start of src_doc on, earlier.
    Factors of the greedy parse do not overlap; after each come the boundary factors, of one window, across its end.
    """
    if not 2 <= window <= 20:
        raise ValueError("a window has 2 to 20 words")
    from pyspark.sql.pandas.types import to_arrow_schema

    scratch = Scratch(docs.sparkSession, "rlz")
    doc = F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST))
    body = docs.select(
        doc.alias("doc"), F.xxhash64(text_col).bitwiseAND(_TAG).alias("tag"), F.col(text_col).cast("binary").alias("body"),
        F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != text_col)).alias("row"),
    )
    keys, hits = "k long, c long, doc long, loc long, s long", "doc long, loc long, src_doc long, src_loc long"

    def by_document(rows: DataFrame, column: str) -> DataFrame:
        return rows.groupBy("doc", F.col("loc").bitwiseAND(_TAG).alias("tag")).agg(F.collect_list(F.struct("loc", "src_doc", "src_loc")).alias(column))

    order = ("k", "c", "doc", "loc")
    # Kept on the executors' disks, as the range partitioning looks at the keys once to choose its bounds. What is lost
    # with an executor is cut from the documents anew; then a table ends the lineage.
    blocks = body.select("doc", "tag", "body").mapInArrow(_cutter(window, False), keys).persist(StorageLevel.DISK_ONLY)
    found = scratch.save(blocks.repartitionByRange("k", "c").sortWithinPartitions(*order).mapInArrow(_judge(False), hits))
    blocks.unpersist()
    copies = by_document(found.where("src_loc is not null"), "hits")
    bounds = found.where("src_loc is null").groupBy("doc", F.col("loc").bitwiseAND(_TAG).alias("tag")).agg(F.collect_list("loc").alias("marks"))
    # Both joins below read one exchange of the texts. Equal windows have equal contents, so no gram is needed here.
    windows = body.join(bounds, ["doc", "tag"]).mapInArrow(_cutter(window, True), keys)
    more = by_document(windows.repartition("k", "c").sortWithinPartitions(*order).mapInArrow(_judge(True), hits), "more")
    whole = body.join(copies, ["doc", "tag"], "left").join(more, ["doc", "tag"], "left")
    shape = whole.select("row", F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_removed"), F.lit("").alias("kept_text"), F.lit(None).cast(_FACTORS).alias("factors")).schema
    for f in shape.fields:
        f.nullable = True
    return whole.mapInArrow(_remover(window, to_arrow_schema(shape), verbatim), shape)
