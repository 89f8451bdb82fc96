"""A training corpus from raw documents, in five stages; each is written as Parquet and read again by the next.

1. quality: documents that the byte network scores under 0.7 go.
2. near_dedup: of documents linked at five-word shingles and similarity 0.8, the one with the smallest id stays.
3. substring_dedup: words in 20-word passages that occur earlier go; a document that loses all its words goes.
4. mixing: the curriculum decides how often a document trains; untaken documents go, and others appear once for each
   epoch's copy that is taken. The copy that meets its source's target is taken whole or left out, whichever is nearer.
5. tokens: byte-level BPE ids of each row.

Defined results: stages 1 to 4 return the columns of documents and ignore any others. Rows without an id stay rows of
their own, and link with nothing in near_dedup. A row without a text counts as an empty one; an empty table stays empty.
Of a document that lost words, what is left has one space between words, and n_chars is its length; other texts stay as
they are.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.bpe_piece import VOCABULARY, bpe_encode
from spanloom.llm.byte_cnn import keep_quality, train
from spanloom.llm.common import Scratch, table
from spanloom.llm.curriculum import mix_rows
from spanloom.llm.minhash import minhash_dedup
from spanloom.llm.rlz import rlz_dedup

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_quality(docs.select(*COLUMNS), train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    gone = minhash_dedup(docs, k=5, percent=80).where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = rlz_dedup(docs.select(*COLUMNS), window=20, verbatim=True).where("n_removed = 0 or n_removed < n_words")
    length = F.when(F.col("n_removed") > 0, F.length("kept_text").cast("long")).otherwise(F.col("row.n_chars"))
    return cut.select("row.doc_id", F.col("kept_text").alias("text"), "row.lang", "row.source", length.alias("n_chars"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix_rows(docs.select(*COLUMNS))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe_encode(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("mixing", mixing), ("tokens", tokens)]
#: The network's decisions can't be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for _, stage in STAGES[:-1]:
        docs, was = scratch.save(stage(spark, docs, sf_dir)), docs
        scratch.drop(was)
    return STAGES[-1][1](spark, docs, sf_dir)
