"""The queries op1 to op10: each operator with production parameters over its whole table, digests by contract."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import lang_centroids
from .bpe_piece import VOCABULARY, bpe_encode
from .byte_cnn import quality_scores, train
from .common import table
from .curriculum import curriculum
from .license_scan import license_report
from .media import media_features, to_media
from .minhash import minhash_dedup
from .rlz import rlz_dedup
from .sorted_projection import embedding_dedup
from .sql import ORACLES  # noqa: F401
from .token_sstable import VOCABULARY as SSTABLE_VOCABULARY
from .token_sstable import sstable_round_trip


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup(table(spark, sf_dir, "documents"), k=4, percent=80)


def op2_rlz(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return rlz_dedup(docs, window=20).select("row.doc_id", "n_words", "n_removed", F.sha2(F.encode("kept_text", "utf-8"), 256).alias("kept_sha256"))


def op3_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup(table(spark, sf_dir, "embeddings"), least=0.98)


def op4_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_scores(docs, train(docs, table(spark, sf_dir, "labels"), label="quality"), threshold=0.7)


def op5_curriculum(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = curriculum(table(spark, sf_dir, "documents"))
    return mix.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken", F.round("position", 6).alias("position"))


def op6_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return lang_centroids.identify(docs, lang_centroids.train(docs))


def op7_png(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_features(to_media(table(spark, sf_dir, "documents")), keep=False).drop("media")


def op8_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_report(table(spark, sf_dir, "documents"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    return bpe_encode(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN, with_ids=False).drop("ids")


def op10_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    return sstable_round_trip(docs, public_tokenizers.path(SSTABLE_VOCABULARY), public_tokenizers.PATTERN)


QUERIES = {
    "op1_minhash": op1_minhash,
    "op2_rlz": op2_rlz,
    "op3_projection": op3_projection,
    "op4_byte_cnn": op4_byte_cnn,
    "op5_curriculum": op5_curriculum,
    "op6_lang": op6_lang,
    "op7_png": op7_png,
    "op8_license": op8_license,
    "op9_bpe": op9_bpe,
    "op10_sstable": op10_sstable,
}
