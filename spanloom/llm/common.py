"""Shared pieces of the training-data operators: scratch tables, bounded batches, word hashing."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, in UTF-8: a run of bytes that are neither 0x20 nor 0x09-0x0D. ``bytes.split()`` splits on exactly these.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
#: Text bytes that one numpy step holds at once in a Python worker.
SLICE_BYTES = 4 << 20
#: Bytes of an Arrow batch between Spark and a Python worker.
BATCH_BYTES = 8 << 20
_BATCH, _BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a local session gets a
    temporary one, and any other must name one, as executors could not see the driver's own disk."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='spanloom-')}"
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of BATCH_BYTES, unless the session says otherwise: both ends of a Python worker hold a batch or two."""
    if spark.conf.get(_BATCH, None) in (None, _BATCH_DEFAULT):
        spark.conf.set(_BATCH, str(BATCH_BYTES))


class Scratch:
    """Tables written to the shared folder, to cut lineage: a lost executor costs a reread, not a recomputation.

    ``drop`` removes a table that nothing reads any more; what is left goes when the Python process ends.
    """

    def __init__(self, spark: SparkSession, what: str):
        small_batches(spark)
        self.spark, self.base = spark, f"{scratch_root(spark)}/spanloom-{what}-{uuid.uuid4().hex}"
        self.paths: dict[int, str] = {}
        self._count = 0
        atexit.register(self._remove, self.base)

    def path(self) -> str:
        self._count += 1
        return f"{self.base}/t{self._count}"

    def save(self, df: DataFrame, few: bool = False) -> DataFrame:
        """``few``: the rows are much fewer than those they come from; they are gathered into files of a fitting number."""
        path = self.path()
        (df.hint("rebalance") if few else df).write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            path = self.paths.pop(id(df), None)
            if path:
                self._remove(path)

    def _remove(self, path: str) -> None:
        try:
            jvm = self.spark.sparkContext._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # noqa: BLE001  the session may be gone at exit
            pass


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4, is 2; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that a slice holds one row or about ``most`` bytes of text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(lengths, dtype=np.int64) // most
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)


_release: dict[str, object] = {}


def claim(owner: str, release=None) -> None:
    """A Python worker outlives its task and serves other operators: whoever starts work in it drops what the others
    still hold in memory (their ``release``) and gives free memory back to the system, so a worker never holds more
    than one operator's caches."""
    others = [o for o in _release if o != owner]
    for other in others:
        _release.pop(other)()
    if others or _owner[0] != owner:
        _owner[0] = owner
        give_back()
    _release[owner] = release or (lambda: None)


_owner = [""]


def give_back() -> None:
    """Free memory of Python, Arrow and the C library goes back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


class WordHasher(dict):
    """64-bit word hashes, kept for words seen before; emptied when full, which changes no result."""

    def __init__(self, most: int = 150_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > self.most:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that every bit of the result depends on every bit of x."""
    x = x ^ (x >> np.uint64(33))
    x = x * _M1
    x = x ^ (x >> np.uint64(33))
    x = x * _M2
    return x ^ (x >> np.uint64(33))


def rolling(h: np.ndarray, k: int, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """Polynomial hashes (mod 2**64) of every run of k values of h; empty where h is shorter."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    b, out = np.uint64(base | 1), np.zeros(n, np.uint64)
    for j in range(k):
        out *= b
        out += h[j : j + n]
    return mix64(out)
