"""Quality scores from a byte-level convolutional network in numpy.

A filter of WIDTH bytes is a table of a weight for each byte at each place. The filters run over a whole document in
chunks of CHUNK bytes that overlap by WIDTH - 1, so that each run of WIDTH bytes lies in one chunk; each chunk is
max-pooled and gives, with the logarithm of its length, a logit, and the document's probability is the logistic function
of their mean, weighted by bytes.

Training takes a bounded sample: at most ``sample`` labelled documents that are not held out (those with the smallest
hash of the id, as far as their texts add up to SAMPLE_BYTES), each with its whole text. All their chunks are examples,
weighted so that documents count alike; and, so that short texts are judged as well as long ones, of each document a
piece of a random short length at a random place. The sample does not grow with the corpus, so training runs on the
driver, by Adam on the logistic loss, with a fixed seed.

Defined results: null and empty texts are scored as one padded chunk. Null labels are left out; an id that is labelled
more than once counts with its mean, from 0.5 up as 1. Without any label the score is 0.5. A null id is not held out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import claim, held_out, small_batches, text_slices

WIDTH, FILTERS, CHUNK = 5, 16, 512
SAMPLE_DOCS, SAMPLE_BYTES = 4_000, 64 << 20
STEP = CHUNK - WIDTH + 1
#: Times that training passes over the examples, by 64 at a time, and the least number of steps.
PASSES, STEPS = 2, 1_000
#: Byte 256 pads.
PAD = 256


def length(positions: np.ndarray) -> np.ndarray:
    """0 for one position, 1 for a whole chunk."""
    return (np.log(positions) / np.log(STEP)).astype(np.float32)


class Network:
    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.t = (rng.standard_normal((WIDTH, 257, FILTERS)) * 0.3).astype(np.float32)
        self.t[:, PAD] = 0
        self.c = np.zeros(FILTERS, np.float32)
        self.w = (rng.standard_normal(FILTERS) * 0.3).astype(np.float32)
        self.l = np.zeros(1, np.float32)
        self.b = np.zeros(1, np.float32)

    def responses(self, x: np.ndarray) -> np.ndarray:
        """(..., n) bytes to (..., n - WIDTH + 1, FILTERS)."""
        n = x.shape[-1] - WIDTH + 1
        out = self.t[0].take(x[..., :n], axis=0)
        for j in range(1, WIDTH):
            out += self.t[j].take(x[..., j : j + n], axis=0)
        return out

    def logit(self, text: bytes) -> float:
        """Of a whole document."""
        x = np.frombuffer(text, np.uint8).astype(np.int16)
        if len(x) < WIDTH:
            x = np.append(x, np.full(WIDTH - len(x), PAD, np.int16))
        total, n = 0.0, len(x) - WIDTH + 1
        for at in range(0, n, STEP * 64):
            r = self.responses(x[at : at + STEP * 64 + WIDTH - 1])
            starts = np.arange(0, len(r), STEP)
            pooled = np.maximum(np.maximum.reduceat(r, starts, axis=0) + self.c, 0)
            sizes = np.diff(np.append(starts, len(r)))
            total += float((pooled @ self.w + self.l * length(sizes)) @ sizes)
        return total / n + float(self.b[0])

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, batch: int = 64, rate: float = 0.01, seed: int = 11) -> Network:
        rng, step, steps = np.random.default_rng(seed), 0, max(STEPS, PASSES * -(-len(x) // batch))
        weight = np.ones(len(x), np.float32) if weight is None else weight
        moments = {n: (np.zeros_like(v), np.zeros_like(v)) for n, v in vars(self).items()}
        places = np.arange(WIDTH)
        while step < steps:
            order = rng.permutation(len(x))
            for at in range(0, min(len(x), (steps - step) * batch), batch):
                xb, yb = x[order[at : at + batch]], y[order[at : at + batch]]
                r = self.responses(xb)
                r[:, 1:][xb[:, WIDTH:] == PAD] = -1e9
                top = r.argmax(1)
                p = np.take_along_axis(r, top[:, None], 1)[:, 0] + self.c
                live, size = p > 0, length(np.maximum((xb[:, WIDTH - 1 :] != PAD).sum(1), 1))
                pooled = np.where(live, p, 0)
                d = (1 / (1 + np.exp(-(pooled @ self.w + self.l * size + self.b))) - yb).astype(np.float32) * weight[order[at : at + batch]] / len(xb)
                dp = np.where(live, d[:, None] * self.w, 0)
                g = {"w": pooled.T @ d, "l": (d * size).sum(keepdims=True), "b": d.sum(keepdims=True), "c": dp.sum(0), "t": np.zeros_like(self.t)}
                seen = xb[np.arange(len(xb))[:, None, None], top[..., None] + places]
                np.add.at(g["t"], (places[None, None], seen, np.arange(FILTERS)[None, :, None]), np.broadcast_to(dp[..., None], seen.shape))
                g["t"][:, PAD] = 0
                step += 1
                for n, v in vars(self).items():
                    m, s = moments[n]
                    m += 0.1 * (g[n] - m)
                    s += 0.001 * (g[n] ** 2 - s)
                    v -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
        return self


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_DOCS, most: int = SAMPLE_BYTES, label: str = "quality") -> Network | None:
    """A network from labelled documents that are not held out; None without any."""
    chosen = (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg((F.avg(label) >= 0.5).cast("int").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    )
    # The sample has a fixed bound, so it may be broadcast. Of rows that repeat an id one counts, the least.
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text")).join(F.broadcast(chosen), "doc_id")
    one = texts.groupBy("doc_id", "y").agg(F.min(F.struct(F.octet_length("text").alias("n"), F.xxhash64("text").alias("h"))).alias("least"))
    sizes = sorted(one.select(F.xxhash64("doc_id").alias("turn"), "doc_id", "y", "least").collect())
    fits = [r for r, n in zip(sizes, np.cumsum([r.least.n for r in sizes]).tolist()) if n <= most] or sizes[:1]
    if not fits:
        return None
    wanted = docs.sparkSession.createDataFrame([(r.doc_id, r.least.n, r.least.h, r.y) for r in fits], "doc_id long, n int, h long, y int")
    keyed = texts.drop("y").select("doc_id", "text", F.octet_length("text").alias("n"), F.xxhash64("text").alias("h"))
    rows = keyed.join(F.broadcast(wanted), ["doc_id", "n", "h"]).groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    return Network().fit(*examples(sorted((bytes(r.text), r.y) for r in rows.select("text", "y").collect())))


def examples(pairs: list[tuple[bytes, int]], seed: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Padded chunks that cover all texts, with labels and weights: those of a text weigh one together, and as much has a
    piece of a random length from 12 bytes up. The mean weight is 1."""
    rng, out, y, weight = np.random.default_rng(seed), [], [], []
    for text, label in pairs:
        starts = range(0, max(len(text) - WIDTH + 1, 1), STEP)
        n = int(12 * (CHUNK / 12) ** rng.random())
        at = int(rng.random() * max(len(text) - n, 0))
        out += [text[a : a + CHUNK] for a in starts] + [text[at : at + n]]
        y += [label] * (len(starts) + 1)
        weight += [1 / len(starts)] * len(starts) + [1.0]
    x = np.full((len(out), CHUNK), PAD, np.int16)
    for row, chunk in zip(x, out):
        row[: len(chunk)] = np.frombuffer(chunk, np.uint8)
    return x, np.array(y, np.float32), np.array(weight, np.float32) / np.float32(np.mean(weight))


def _scorer(net: Network | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("byte_cnn")
        for part in text_slices(batches):
            z = np.array([net.logit(t or b"") if net else 0.0 for t in part.column("text").to_pylist()])
            score = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
            kept = [part.column(i) for i, n in enumerate(part.schema.names) if n != "text"]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(score)], names=[*(n for n in part.schema.names if n != "text"), "score"])

    return run


def quality_scores(docs: DataFrame, net: Network | None, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted: a row for each row."""
    small_batches(docs.sparkSession)
    source = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("binary").alias("text"))
    scored = source.mapInArrow(_scorer(net), source.drop("text").withColumn("score", F.lit(0.0)).schema)
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def _judge(net: Network | None, schema: pa.Schema, threshold: float, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("byte_cnn")
        for part in text_slices(batches, text_col):
            bar = float(np.log(threshold / (1 - threshold)))
            keep = [not net or net.logit((t or "").encode()) >= bar for t in part.column(text_col).to_pylist()]
            yield part.filter(pa.array(keep, pa.bool_()))

    return run


def keep_quality(docs: DataFrame, net: Network | None, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose score reaches the threshold; all rows without a network."""
    from pyspark.sql.pandas.types import to_arrow_schema

    small_batches(docs.sparkSession)
    return docs.mapInArrow(_judge(net, to_arrow_schema(docs.schema), threshold, text_col), docs.schema)
