"""Sources: lossless text files, JSON lines, JSON arrays, delimited members of ZIP archives, notes."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.text import newline_style

BOM = b"\xef\xbb\xbf"


def read_documents(spark: SparkSession, path: str | list[str], bom: str = "strip", glob: str = "*.txt") -> DataFrame:
    """Whole files of a folder, or those of a list, never changed: document_id (the file's stem), raw_bytes, raw_text, had_bom, newline_style,
    file_number (first digits of the stem, 10**18 without), error.

    ``bom`` is preserve, strip or reject. A file that is not UTF-8, or that has a rejected mark, is a row with an error
    and no text; it does not stop the batch."""
    if bom not in ("preserve", "strip", "reject"):
        raise ValueError("bom is preserve, strip or reject")
    if isinstance(path, list) and len(set(path)) < len(path):
        raise ValueError("a file is listed twice")
    reader = spark.read.format("binaryFile")
    files = reader.load(path) if isinstance(path, list) else reader.option("pathGlobFilter", glob).load(path)
    marked = F.substring("content", 1, 3) == F.lit(BOM)
    body = F.when(marked & F.lit(bom == "strip"), F.expr("substring(content, 4)")).otherwise(F.col("content"))
    text = F.try_validate_utf8(body.cast("string"))
    stem = F.regexp_extract(F.element_at(F.split("path", "/"), -1), r"^(.*?)(?:\.[^.]*)?$", 1)
    number = F.regexp_extract(stem, r"\d+", 0)
    error = F.when(marked & F.lit(bom == "reject"), "bom").when(text.isNull(), "encoding")
    rows = files.select(
        stem.alias("document_id"), F.col("content").alias("raw_bytes"), F.when(error.isNull(), text).alias("raw_text"), marked.alias("had_bom"),
        F.when(number == "", F.lit(10**18)).otherwise(number.cast("long")).alias("file_number"), error.alias("error"),
    )
    return rows.withColumn("newline_style", newline_style(F.col("raw_text")))


def read_jsonl(spark: SparkSession, path: str, schema: StructType, strict: bool = False) -> DataFrame:
    """A row for each non-blank line with the schema's fields, ``line`` and ``error``: malformed, or unknown
    keys. With ``strict``, the first error stops the read."""
    lines = spark.read.text(path).where(F.trim("value") != "").withColumn("line", F.col("value"))
    parsed = lines.withColumn("row", F.from_json("value", schema, {"mode": "PERMISSIVE"})).withColumn("keys", F.json_object_keys("value"))
    unknown = F.array_except("keys", F.array(*(F.lit(f.name) for f in schema.fields)))
    error = F.when(F.col("keys").isNull(), "malformed").when(F.size(unknown) > 0, F.concat(F.lit("unknown keys: "), F.array_join(unknown, ",")))
    out = parsed.select("row.*", "line", error.alias("error"))
    if strict:
        out = out.withColumn("error", F.when(F.col("error").isNotNull(), F.raise_error(F.col("error"))))
    return out


def read_json_array(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Elements of JSON arrays, with source_file and source_index."""
    texts = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("source_file"), F.from_json("value", f"array<{schema.simpleString()}>").alias("rows"))
    return texts.select("source_file", F.posexplode("rows").alias("source_index", "row")).select("row.*", "source_file", "source_index")


def read_zip_members(spark: SparkSession, path: str, member: str, delimiter: str) -> DataFrame:
    """Lines of archive members whose name ends with ``member``: source, row (from 1), fields. An archive is
    streamed by one task; several archives are read in parallel."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for m in sorted(n for n in z.namelist() if n.endswith(member)):
                        rows: list[list[str]] = []
                        first = 1
                        with z.open(m) as f:
                            for line in io.TextIOWrapper(f, "utf-8", newline="\n"):
                                rows.append(line.rstrip("\r\n").split(delimiter))
                                if len(rows) == 10_000:
                                    yield _rows(name, first, rows)
                                    first, rows = first + len(rows), []
                        yield _rows(name, first, rows)

    def _rows(name: str, first: int, rows: list[list[str]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([name] * len(rows), pa.string()), pa.array(range(first, first + len(rows)), pa.int64()), pa.array(rows, pa.list_(pa.string()))], names=["source", "row", "fields"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "source string, row long, fields array<string>")


def _field(i: int) -> Column:
    return F.try_element_at("fields", F.lit(i + 1))


def icd_tables(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Concepts (the first row by level and row number of each code at level 3 or 4) and aliases (fields 8, 9, 10)."""
    at = rows.where(F.size("fields") >= 11).select("row", _field(0).alias("level"), _field(4).alias("code"), _field(8).alias("preferred"), _field(9).alias("i1"), _field(10).alias("i2")).where(F.col("level").isin("3", "4"))
    concepts = at.groupBy("code").agg(F.min(F.struct("level", "row", "preferred")).alias("f")).select(F.lit("ICD").alias("system"), F.col("code").alias("concept_id"), F.col("f.preferred").alias("preferred_term"), F.lit(True).alias("active"))
    alias = at.select("code", "row", F.expr("stack(3, 'preferred', preferred, 'inclusion', i1, 'inclusion', i2) as (alias_type, alias)")).where(F.trim("alias") != "")
    return concepts, alias.select(F.lit("ICD").alias("system"), F.col("code").alias("concept_id"), "alias", "alias_type", "row")


def rxnorm_tables(rows: DataFrame, term_types: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """English RXNORM rows of the allowed types; a concept is its first row by type, name and row number, and is
    active unless that is suppressed as obsolete."""
    at = rows.where(F.size("fields") > 16).select("row", _field(0).alias("code"), _field(1).alias("lat"), _field(11).alias("sab"), _field(12).alias("tty"), _field(14).alias("str"), _field(16).alias("suppress"))
    at = at.where((F.col("lat") == "ENG") & (F.col("sab") == "RXNORM") & F.col("tty").isin(*term_types))
    first = at.groupBy("code").agg(F.min(F.struct("tty", "str", "row", "suppress")).alias("f"))
    concepts = first.select(F.lit("RXNORM").alias("system"), F.col("code").alias("concept_id"), F.col("f.str").alias("preferred_term"), (F.col("f.suppress") != "O").alias("active"))
    return concepts, at.select(F.lit("RXNORM").alias("system"), F.col("code").alias("concept_id"), F.col("str").alias("alias"), F.col("tty").alias("alias_type"), "row")


def number_notes(notes: DataFrame, order: str, prefix: str = "provisional") -> DataFrame:
    """Ids prefix:0001, ... in the order of a column (files in a batch, a row each)."""
    n = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(order))
    return notes.withColumn("sample_id", F.format_string(f"{prefix}:%04d", n))
