"""Token ids in sorted-string-table shards: prefix-compressed blocks, a sparse index, a Bloom filter and a footer.

A shard file, little-endian except for keys:
  blocks   entries (shared key bytes, rest of the key, ids; lengths as varints) of ascending keys, then crc32
  index    for each block: its first key (length first), offset, length, ids before it in the shard, entries
  filter   bits of a Bloom filter over the shard's keys
  footer   64 bytes: offsets and lengths of index and filter, entries, ids, hashes, id width, crc32 of both, magic
A key begins with a head: 00 and the id as big-endian with its sign bit flipped (so bytes sort like numbers), or 01 for a
null id. The hash of the text follows, and a number that tells rows with the same id and text apart; so a key names one
row. The filter holds heads. A look-up asks it for an id, searches the index and reads the blocks that may hold the head.

Writing range-partitions the documents by id and text hash, so that shards are ordered, none depends on one hot range,
and rows with the same id and text lie in one task, which numbers them. Each task streams its rows into files of at most
SHARD_BYTES, in the folder that all executors share, under a name of its attempt, renamed when complete. A task that runs
again writes the same bytes. Reading verifies every checksum. Files are opened through Arrow's file systems: local paths,
and hdfs, s3 (s3a and s3n as well) and gs addresses.

Defined results: a null text is an empty one, and has the end id alone. Null ids come last. Rows with the same id are
ordered by text hash; shards next to each other may share an id whose texts differ. Other columns are ignored.
"""

from __future__ import annotations

import os
import struct
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe_piece import ChunkCoder
from .common import Scratch, claim, small_batches, text_slices

VOCABULARY = "byte_bpe_50k.json"
END_ID = 2
BLOCK_BYTES, SHARD_BYTES = 1 << 16, 256 << 20
HASHES, BITS_PER_KEY = 7, 10
#: Chunks that a generation of a worker's memory holds.
REMEMBERED = 600_000
MAGIC = b"SPLMSST1"
_FOOTER = struct.Struct("<QQQQQQHHI4x8s")


class BadShard(ValueError):
    pass


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        n |= (b & 127) << shift
        at += 1
        if b < 128:
            return n, at
        shift += 7


def head_of(doc_id: int | None) -> bytes:
    return b"\x01" + bytes(8) if doc_id is None else b"\x00" + _ordered(doc_id)


def _ordered(n: int) -> bytes:
    return struct.pack(">Q", (n + (1 << 63)) & (1 << 64) - 1)


def key_of(doc_id: int | None, h: int = 0, turn: int = 0) -> bytes:
    return head_of(doc_id) + _ordered(h) + struct.pack(">I", turn)


def id_of(key: bytes) -> int | None:
    return None if key[0] else struct.unpack(">Q", key[1:9])[0] - (1 << 63)


def _probes(key: bytes, bits: int) -> list[int]:
    h = xxhash.xxh3_128_intdigest(key)
    a, b = h & (1 << 64) - 1, h >> 64 | 1
    return [(a + i * b) % bits for i in range(HASHES)]


class Writer:
    """Takes ascending keys; ``finish`` returns (entries, ids)."""

    def __init__(self, out, width: int):
        self.out, self.width, self.at, self.n, self.ids = out, width, 0, 0, 0
        self.index: list[bytes] = []
        self.keys: list[bytes] = []
        self._open()

    def _open(self) -> None:
        self.block, self.size, self.first, self.last, self.count, self.before = [], 0, b"", b"", 0, self.ids

    def add(self, key: bytes, ids: np.ndarray) -> None:
        if self.keys and key <= self.keys[-1]:
            raise ValueError("keys must ascend")
        shared = len(os.path.commonprefix([self.last, key])) if self.count else 0
        value = ids.astype(f"<u{self.width}").tobytes()
        entry = b"".join([_varint(shared), _varint(len(key) - shared), key[shared:], _varint(len(ids)), value])
        self.first = self.first or key
        self.block.append(entry)
        self.keys.append(key)
        self.last, self.count, self.n, self.ids, self.size = key, self.count + 1, self.n + 1, self.ids + len(ids), self.size + len(entry)
        if self.size >= BLOCK_BYTES:
            self._close()

    def _write(self, data: bytes) -> int:
        self.out.write(data)
        self.at += len(data)
        return self.at - len(data)

    def _close(self) -> None:
        if self.count:
            data = b"".join(self.block)
            at = self._write(data + struct.pack("<I", zlib.crc32(data)))
            self.index.append(_varint(len(self.first)) + self.first + struct.pack("<QIQI", at, len(data) + 4, self.before, self.count))
            self._open()

    def finish(self) -> tuple[int, int]:
        self._close()
        index = b"".join(self.index)
        bits = max(64, len(self.keys) * BITS_PER_KEY + 7 & ~7)
        field = np.zeros(bits, np.uint8)
        for head in {key[:9] for key in self.keys}:
            field[_probes(head, bits)] = 1
        bloom = np.packbits(field, bitorder="little").tobytes()
        i, b = self._write(index), self._write(bloom)
        self._write(_FOOTER.pack(i, len(index), b, len(bloom), self.n, self.ids, HASHES, self.width, zlib.crc32(index + bloom), MAGIC))
        return self.n, self.ids


class Reader:
    """A shard through ``read_at(offset, length)``; holds index and filter, and one block at a time."""

    def __init__(self, read_at, size: int):
        self.read_at = read_at
        if size < _FOOTER.size:
            raise BadShard("cut off")
        i, ni, b, nb, self.n, self.ids, hashes, self.width, crc, magic = _FOOTER.unpack(read_at(size - _FOOTER.size, _FOOTER.size))
        if magic != MAGIC or hashes != HASHES:
            raise BadShard("no shard of this format")
        index, self.bloom = read_at(i, ni), read_at(b, nb)
        if zlib.crc32(index + self.bloom) != crc:
            raise BadShard("checksum of index and filter")
        self.first, self.blocks, at = [], [], 0
        while at < ni:
            n, at = _read_varint(index, at)
            self.first.append(index[at : at + n])
            self.blocks.append(struct.unpack_from("<QIQI", index, at + n))
            at += n + 24

    def block(self, k: int) -> Iterator[tuple[bytes, int, np.ndarray]]:
        """(key, ids before it in the shard, ids)."""
        offset, length, before, count = self.blocks[k]
        data, at, key = self.read_at(offset, length), 0, b""
        if zlib.crc32(data[:-4]) != struct.unpack_from("<I", data, length - 4)[0]:
            raise BadShard(f"checksum of block {k}")
        for _ in range(count):
            shared, at = _read_varint(data, at)
            rest, at = _read_varint(data, at)
            key = key[:shared] + data[at : at + rest]
            n, at = _read_varint(data, at + rest)
            yield key, before, np.frombuffer(data, f"<u{self.width}", n, at).astype("<u4")
            at, before = at + n * self.width, before + n

    def __iter__(self):
        for k in range(len(self.blocks)):
            yield from self.block(k)

    def may_hold(self, doc_id: int | None) -> bool:
        return all(self.bloom[p >> 3] >> (p & 7) & 1 for p in _probes(head_of(doc_id), len(self.bloom) * 8))

    def find(self, doc_id: int | None) -> Iterator[np.ndarray]:
        """The ids of each row of a document, by binary search."""
        head = head_of(doc_id)
        if not self.blocks or not self.may_hold(doc_id):
            return
        # The last block that begins before the head may end with it.
        for k in range(max(bisect_right(self.first, head) - 1, 0), len(self.blocks)):
            if self.first[k][:9] > head:
                return
            yield from (ids for key, _, ids in self.block(k) if key[:9] == head)

    def get(self, doc_id: int | None) -> np.ndarray | None:
        """The ids of a document, or of its first row; None if it is not here."""
        return next(self.find(doc_id), None)


def address(path: str) -> str:
    """An address as Spark writes it, as Arrow reads it."""
    scheme, colon, rest = path.partition("://")
    return "s3://" + rest if colon and scheme in ("s3a", "s3n") else path


def file_system(path: str):
    """(file system, path in it)."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(address(path))


def open_shard(path: str) -> Reader:
    system, where = file_system(path)
    f = system.open_input_file(where)

    def read_at(offset: int, length: int) -> bytes:
        f.seek(offset)
        return f.read(length)

    return Reader(read_at, f.size())


class ChunkEncoder(ChunkCoder):
    """Ids of the tokenizers library, remembered for pre-tokens and space-separated chunks.

    The vocabulary's pre-tokenizer cuts by PATTERN, and no match of that reaches over a space that follows something
    else than white space; so ids of such chunks, one after the other, are the ids of the text. A text with one of the
    vocabulary's special tokens is encoded whole by the tokenizer.
    """

    def __init__(self, path: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__(pattern, REMEMBERED)
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        keep = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
        self.letters = {b: chr(b) for b in keep} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in set(keep))}
        self.space = self.letters[32]

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def pretoken_ids(self, word: str) -> list[int]:
        if word.isascii() and word.isprintable():
            word = word.replace(" ", self.space)
        else:
            word = word.encode().decode("latin-1").translate(self.letters)
        return [t.id for t in self.model.tokenize(word)]

    def ids(self, text: str) -> np.ndarray:
        if any(s in text for s in self.special):
            return self.whole(text)
        return np.frombuffer(self.encode(text), "<u4")


@cache
def encoder(path: str, pattern: str) -> ChunkEncoder:
    """One for each worker process."""
    return ChunkEncoder(path, pattern)


_SHARD = "part int, shard int, path string, n_docs long, n_ids long"


def _shards(folder: str, vocabulary: str, pattern: str, end: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        claim("token_sstable", encoder.cache_clear)
        enc, task = encoder(vocabulary, pattern), TaskContext.get()
        system, base = file_system(folder)
        system.create_dir(base, recursive=True)
        done, writer, shard, last, turn = [], None, 0, object(), 0
        stop = np.array([end], "<u4")

        def close() -> None:
            nonlocal writer, shard
            n, ids = writer.finish()
            writer.out.close()
            name = f"part-{task.partitionId():06d}-{shard:04d}.sst"
            system.move(f"{base}/{writer.name}", f"{base}/{name}")
            done.append((task.partitionId(), shard, f"{folder}/{name}", n, ids))
            writer, shard = None, shard + 1

        for part in text_slices(batches):
            for doc, h, text in zip(*(part.column(n).to_pylist() for n in ("doc_id", "h", "text"))):
                turn = turn + 1 if (doc, h) == last else 0
                last = (doc, h)
                if writer is None:
                    name = f"_{task.partitionId()}-{shard}-{task.taskAttemptId()}"
                    writer = Writer(system.open_output_stream(f"{base}/{name}"), enc.width)
                    writer.name = name
                writer.add(key_of(doc, h, turn), np.concatenate([enc.ids(text or ""), stop]))
                if writer.at >= most:
                    close()
        if writer is not None:
            close()
        columns = list(zip(*done)) or [()] * 5
        types = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["part", "shard", "path", "n_docs", "n_ids"])

    return run


def write_shards(docs: DataFrame, folder: str, vocabulary: str, pattern: str, end: int = END_ID, most: int = SHARD_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the shards; part, shard, path, n_docs, n_ids of each."""
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("h"))
    order = [F.col("doc_id").asc_nulls_last(), F.col("h")]
    small_batches(docs.sparkSession)
    sorted_ = source.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "h", "text")
    return sorted_.mapInArrow(_shards(folder, vocabulary, pattern, end, most), _SHARD)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, before in zip(batch.column("path").to_pylist(), batch.column("before").to_pylist()):
            reader = open_shard(path)
            for k in range(len(reader.blocks)):
                rows = list(reader.block(k))
                # One document of each file is looked up as well, by filter, index and block.
                if k == len(reader.blocks) // 2 and not any(np.array_equal(ids, rows[0][2]) for ids in reader.find(id_of(rows[0][0]))):
                    raise BadShard("look-up")
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([id_of(key) for key, _, _ in rows], pa.int64()),
                        pa.array([before + b for _, b, _ in rows], pa.int64()),
                        pa.array([len(ids) for _, _, ids in rows], pa.int64()),
                        pa.array([zlib.crc32(ids.tobytes()) for _, _, ids in rows], pa.int64()),
                    ],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )


def scan_shards(shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, read back from the files.

    Only the running sum over shards, a row for each file, is taken in one task.
    """
    before = F.coalesce(F.sum("n_ids").over(Window.orderBy("part", "shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = shards.withColumn("before", before).select("path", "before")
    # A task for each file, whose rows are too few for Spark to see that they stand for much.
    return placed.repartition(max(1, shards.count()), "path").mapInArrow(_scan, "doc_id long, start long, n_tokens long, ids_crc32 long")


def sstable_round_trip(docs: DataFrame, vocabulary: str, pattern: str, end: int = END_ID) -> DataFrame:
    """Writes shards to the shared folder and returns what a reader finds in them."""
    scratch = Scratch(docs.sparkSession, "sstable")
    return scan_shards(scratch.save(write_shards(docs, f"{scratch.base}/shards", vocabulary, pattern, end)))
