"""Sinks: atomic JSON, deterministic archives, accepted and rejected tables."""

from __future__ import annotations

import hashlib
import os
import tempfile
import zipfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.kernels import canonical_json


def write_json(path: str, value: object, overwrite: bool = True) -> str:
    """Compact sorted JSON by way of a temporary file in the same folder; returns its sha256."""
    if not overwrite and os.path.exists(path):
        raise FileExistsError(path)
    data = canonical_json(value).encode()
    handle, temporary = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(path)))
    try:
        with os.fdopen(handle, "wb") as f:
            f.write(data)
            f.flush()
            os.fsync(f.fileno())
        os.replace(temporary, path)
    except BaseException:
        os.unlink(temporary)
        raise
    return hashlib.sha256(data).hexdigest()


def package(files: dict[str, bytes], path: str, folder: str = "output") -> None:
    """An archive whose bytes depend on the files alone: sorted names, a fixed date."""
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name in sorted(files):
            z.writestr(zipfile.ZipInfo(f"{folder}/{name}", (1980, 1, 1, 0, 0, 0)), files[name], zipfile.ZIP_DEFLATED)


def write_split(df: DataFrame, folder: str, reasons: str = "reasons") -> DataFrame:
    """One pass writes the rows, with their reasons, under folder/status=accepted (no reasons) and
    folder/status=rejected; returns counts by first reason, read from there."""
    status = F.when(F.size(reasons) == 0, "accepted").otherwise("rejected")
    df.withColumn("status", status).write.mode("overwrite").partitionBy("status").parquet(folder)
    primary = F.coalesce(F.try_element_at(reasons, F.lit(1)), F.lit("accepted"))
    return df.sparkSession.read.parquet(folder).groupBy(primary.alias("reason")).agg(F.count("*").alias("n"))


def append_new(df: DataFrame, path: str, text_col: str = "text") -> int:
    """Appends rows whose text hash the table does not hold yet, each text once; returns how many. The rows are
    counted as they are written, so the plan runs once."""
    from pyspark.sql import Observation

    spark = df.sparkSession
    new = df.withColumn("text_key", F.sha2(F.encode(text_col, "utf-8"), 256)).dropDuplicates(["text_key"])
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jvm_path):
        new = new.join(spark.read.parquet(path).select("text_key"), "text_key", "left_anti")
    seen = Observation()
    new.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("append").parquet(path)
    return seen.get["n"]
