"""Language ID by nearest centroid: TF-IDF vectors of byte n-grams against several clustered centroids a language.

Features are runs of one to three bytes of the lower-cased words (UTF-8, so letters of any script; ASCII signs and digits
part words and say nothing of a language), hashed into DIMS columns; counts are dampened by log1p, weighted by inverse document frequency, and scaled to length 1. Each language's
training vectors are clustered into up to CENTROIDS spherical k-means centroids. A text gets the language of the closest
centroid by cosine; its score is that cosine's share against the best other language's, and it is *rejected* (column
``rejected``, score halved) if the distance is beyond the language's 99.5th percentile in training times a margin.

Fitting takes a bounded sample of each language: at most ``sample`` documents that are not held out (smallest hash of the
id), with their whole texts, which workers turn into vectors of n-gram counts. Document frequencies are those of all such
documents.

Defined results: ``und``, score 0, for a null text or one without a letter, and for all texts if there is no training
row. Null languages are left out of training. A null id is not held out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, held_out, small_batches, text_slices

DIMS = 1 << 13
CENTROIDS = 3
SAMPLE_DOCS = 2_000
#: Texts that are turned into dense vectors at once.
BLOCK = 128
_MUL = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text[:64])) or any(map(str.isalpha, text[64:]))


#: Bytes to bytes: ASCII letters and all of other scripts stay, whatever else is ASCII becomes a space.
_LETTERS = bytes(b if b > 127 or chr(b).isalpha() else 32 for b in range(256))


def counts(texts: list[bytes]) -> np.ndarray:
    """(texts, DIMS) counts of the hashed n-grams of the words, with one space between them."""
    out = np.zeros((len(texts), DIMS), np.float32)
    for row, text in zip(out, texts):
        text = b" ".join(text.translate(_LETTERS).split())
        for at in range(0, max(len(text), 1), 1 << 20):
            x = np.frombuffer(text, np.uint8, count=min(len(text) - at, (1 << 20) + 2), offset=at).astype(np.uint32)
            code = np.zeros(len(x), np.uint32)
            for n in range(3):
                code = code[: len(x) - n] << np.uint32(8) | x[n:] if len(x) > n else code[:0]
                row += np.bincount((code * _MUL[n]) >> np.uint32(19), minlength=DIMS)
    return out


def vectors(tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """In place."""
    np.log1p(tf, out=tf)
    tf *= idf
    tf /= np.maximum(np.linalg.norm(tf, axis=1, keepdims=True), 1e-9)
    return tf


def inverse(frequency: np.ndarray, n: int) -> np.ndarray:
    return (np.log((1 + n) / (1 + frequency)) + 1).astype(np.float32)


@dataclass
class Centroids:
    languages: list[str]
    idf: np.ndarray
    centres: np.ndarray
    of: np.ndarray
    radius: np.ndarray

    def predict(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        cos = vectors(counts(texts), self.idf) @ self.centres.T
        best = np.stack([cos[:, self.of == i].max(1) for i in range(len(self.languages))], 1)
        first = best.argmax(1)
        top = best[np.arange(len(best)), first]
        rest = np.where(np.arange(best.shape[1]) == first[:, None], -1, best).max(1) if best.shape[1] > 1 else np.zeros(len(best))
        rejected = 1 - top > self.radius[first]
        score = 1 / (1 + np.exp(-20 * np.clip(top - rest, 0, 1)))
        return first, np.clip(np.where(rejected, score / 2, score), 0, 1), rejected


#: Of a text: the columns that occur, and how often.
Sparse = tuple[np.ndarray, np.ndarray]


def fit(samples: dict[str, list[Sparse]], idf: np.ndarray, centroids: int = CENTROIDS, rounds: int = 8, margin: float = 1.25, seed: int = 3) -> Centroids | None:
    """From the counts of each language's sample; one language at a time is made dense."""
    if not samples:
        return None
    rng, names = np.random.default_rng(seed), sorted(samples)
    centres, of, radius = [], [], []
    for i in range(len(names)):
        own = np.zeros((len(samples[names[i]]), DIMS), np.float32)
        for row, (place, n) in zip(own, samples[names[i]]):
            row[place] = n
        own = vectors(own, idf)
        k = min(centroids, len(own))
        c = own[rng.permutation(len(own))[:k]]
        for _ in range(rounds):
            near = (own @ c.T).argmax(1)
            c = np.stack([own[near == j].sum(0) if (near == j).any() else c[j] for j in range(k)])
            c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
        centres.append(c)
        of += [i] * k
        radius.append(min(1.0, margin * float(np.quantile(1 - (own @ c.T).max(1), 0.995))))
    return Centroids(names, idf, np.concatenate(centres).astype(np.float32), np.array(of), np.array(radius))


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of lower-cased texts: in how many each column occurs; column -1 counts the texts."""
    n, found = 0, np.zeros(DIMS, np.int64)
    for part in text_slices(batches):
        for at in range(0, part.num_rows, BLOCK):
            texts = [x.encode() for x in part.column("text").slice(at, BLOCK).to_pylist()]
            found += (counts(texts) > 0).sum(0)
            n += len(texts)
    if n:
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, DIMS)), pa.array(np.concatenate([[n], found]))], names=["place", "n"])


def sparse(text: bytes) -> Sparse:
    n = counts([text])[0]
    place = np.flatnonzero(n)
    return place, n[place]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lower-cased texts to their counts: columns and numbers as 32-bit values, little-endian."""
    for part in text_slices(batches):
        packed = [np.concatenate(sparse(x.encode())).astype("<u4").tobytes() for x in part.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([part.column("lang"), part.column("doc_id"), part.column("h"), pa.array(packed, pa.binary())], names=["lang", "doc_id", "h", "counts"])


def train(docs: DataFrame, sample: int = SAMPLE_DOCS) -> Centroids | None:
    """Centroids from at most ``sample`` documents of each language that are not held out and have a letter."""
    small_batches(docs.sparkSession)
    rows = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").rlike(r"\p{L}") & ~held_out(F.col("doc_id")))
    rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.lower("text").alias("text"))
    keyed = rows.withColumn("h", F.xxhash64("text"))
    # Of rows that repeat an id one counts, the least hash of the text; repeated rows are one.
    ids = keyed.groupBy("lang", "doc_id").agg(F.min("h").alias("h")).withColumn("turn", F.xxhash64("doc_id"))
    ids = Scratch(docs.sparkSession, "lang").save(ids.withColumn("bucket", F.shiftright("turn", 52).cast("int")))
    # The smallest turns of a language lie in its first buckets; only these are ordered, however large the language is.
    filled = F.sum("count").over(Window.partitionBy("lang").orderBy("bucket"))
    before = ids.groupBy("lang", "bucket").count().withColumn("before", filled - F.col("count")).where(F.col("before") < sample)
    # A row a language, as the model has, too.
    ends = [(r.lang, r.end) for r in before.groupBy("lang").agg(F.max("bucket").alias("end")).collect()]
    ends = F.broadcast(docs.sparkSession.createDataFrame(ends, "lang string, end int"))
    order = Window.partitionBy("lang").orderBy("turn", "doc_id")
    first = ids.join(ends, "lang").where("bucket <= end").withColumn("k", F.row_number().over(order))
    chosen = first.where(F.col("k") <= sample).select("doc_id", "lang", "h")
    # The sample has a fixed bound for each language, so it may be broadcast.
    found = keyed.join(F.broadcast(chosen), ["doc_id", "lang", "h"]).select("lang", "doc_id", "h", "text").mapInArrow(_counted, "lang string, doc_id long, h long, counts binary")
    samples: dict[str, list] = {}
    for r in found.groupBy("lang", "doc_id").agg(F.min("counts").alias("counts")).toLocalIterator():
        samples.setdefault(r.lang, []).append((r.doc_id, *np.split(np.frombuffer(r.counts, "<u4"), 2)))
    if not samples:
        return None
    frequency = rows.select("text").mapInArrow(_frequencies, "place long, n long").groupBy("place").agg(F.sum("n").alias("n"))
    n = {r.place: r.n for r in frequency.collect()}
    ordered = {lang: [(place, n) for _, place, n in sorted(own, key=lambda v: v[0])] for lang, own in samples.items()}
    return fit(ordered, inverse(np.array([n[i] for i in range(DIMS)]), n[-1]))


def _predictor(model: Centroids | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            for at in range(0, part.num_rows, BLOCK):
                b = part.slice(at, BLOCK)
                texts = [x or "" for x in b.column("text").to_pylist()]
                known = [bool(model) and has_letter(x) for x in texts]
                lang, score, rejected = ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
                rows = [i for i, k in enumerate(known) if k]
                if rows:
                    first, s, r = model.predict([texts[i].lower().encode() for i in rows])
                    score[rows], rejected[rows] = s, r
                    for i, f in zip(rows, first.tolist()):
                        lang[i] = model.languages[f]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(lang), pa.array(score), pa.array(rejected)], names=["doc_id", "held_out", "lang_pred", "score", "rejected"])

    return run


def identify(docs: DataFrame, model: Centroids | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected: a row for each row."""
    small_batches(docs.sparkSession)
    source = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    shape = source.drop("text").withColumn("lang_pred", F.lit("")).withColumn("score", F.lit(0.0)).withColumn("rejected", F.lit(True)).schema
    return source.mapInArrow(_predictor(model), shape)
