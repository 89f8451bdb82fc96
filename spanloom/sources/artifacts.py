"""Artifacts with checksums: alias files, canonical tables, index metadata, calibration, traces, gold records.

Tables are written by Spark, as Parquet or as JSON lines in a folder; the small JSON files beside them (manifests, a row a
table) are written by the driver through Hadoop, so that they may lie wherever the tables do.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.kernels import canonical_json
from ..operators.validate import safe_metadata, sample_report

ALIAS = "system string, concept_id string, alias string, alias_type string, row int, version string"


def read_alias_yaml(spark: SparkSession, sources: Iterable[tuple[str, str, str]]) -> DataFrame:
    """Alias rows of YAML files (path, kind, version): a list, or a mapping with a list ``aliases``; other files are
    skipped. Small files: they are parsed on the driver, where PyYAML must be installed."""
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("reading alias files needs PyYAML") from e
    rows = []
    for path, kind, version in sources:
        if not path.lower().endswith((".yaml", ".yml")):
            continue
        found = yaml.safe_load(read_text(spark, path))
        found = found.get("aliases", []) if isinstance(found, dict) else found
        if found is not None and not isinstance(found, list):
            raise ValueError(f"{path}: a list, or a mapping with aliases, is expected")
        for i, r in enumerate(found or (), 1):
            if not isinstance(r, dict):
                raise TypeError(f"{path}: row {i} is no mapping")
            rows.append((str(r["system"]), str(r["concept_id"]), str(r["alias"]), str(r.get("alias_type", kind)), i, version))
    return spark.createDataFrame(rows, ALIAS)


def _path(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    target, system = _path(spark, path)
    return system.exists(target)


def read_text(spark: SparkSession, path: str) -> str:
    """A small file, as UTF-8, from any file system that Spark reads."""
    row = spark.read.text(path, wholetext=True).first()
    return row[0] if row else ""


def put_json(spark: SparkSession, path: str, value: object, overwrite: bool = True) -> str:
    """Compact sorted JSON, renamed into place when complete; its sha256."""
    if not overwrite and exists(spark, path):
        raise FileExistsError(path)
    data = canonical_json(value).encode()
    target, system = _path(spark, path)
    temporary = target.suffix(".part")
    out = system.create(temporary, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()
    system.delete(target, False)
    if not system.rename(temporary, target):
        raise OSError(f"could not write {path}")
    return hashlib.sha256(data).hexdigest()


def table_checksum(df: DataFrame) -> tuple[int, str]:
    """(rows, a digest that neither order nor partitioning changes): sums of two hashes of each row."""
    row = F.to_json(F.struct(*(F.col(f"`{c}`") for c in sorted(df.columns))))
    halves = [F.sum(F.conv(F.substring(F.sha2(row, 256), 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")) for i in range(2)]
    r = df.agg(F.count("*").alias("n"), *(h.alias(f"h{i}") for i, h in enumerate(halves))).first()
    return r.n, hashlib.sha256(f"{r.n}:{r.h0}:{r.h1}".encode()).hexdigest()


#: The order of each canonical table.
ORDERS = {"concepts": ("system", "concept_id", "preferred_term"), "aliases": ("system", "concept_id", "key", "alias", "row"), "report": ("system", "key"), "conflicts": ("system", "concept_id")}


def ordered(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables in their canonical orders."""
    return {n: t.orderBy(*ORDERS[n]) for n, t in tables.items()}


def write_canonical(tables: dict[str, DataFrame], folder: str) -> dict:
    """The tables of prepare_terminology as sorted Parquet in ``folder``, with manifest.json: rows and checksum of
    each, read back from what was written. Returns the manifest."""
    spark, body = next(iter(tables.values())).sparkSession, {}
    for name, t in ordered(tables).items():
        t.write.mode("overwrite").parquet(f"{folder}/{name}")
        n, digest = table_checksum(spark.read.parquet(f"{folder}/{name}"))
        body[name] = {"rows": n, "checksum": digest}
    manifest = {"format_version": 1, "tables": body}
    put_json(spark, f"{folder}/manifest.json", manifest)
    return manifest


def index_metadata(concepts: DataFrame, aliases: DataFrame, k1: float, b: float, grams: tuple[int, ...], type_map: dict[str, tuple[str, ...]]) -> dict:
    """What identifies a lexical index: checksum of its tables, settings, and numbers of keys."""
    keyed = aliases.select("id", T.feature_key(F.col("alias")).alias("key"), T.accentless(F.col("alias")).alias("bare"))
    gram = F.explode(F.array_distinct(F.flatten(F.array(*(T.char_ngrams(F.concat(F.lit(" "), F.col("bare"), F.lit(" ")), n) for n in grams)))))
    n = keyed.agg(F.count_distinct("key").alias("exact"), F.count_distinct("bare").alias("bare"), F.count_distinct("id").alias("docs"), F.count("*").alias("aliases")).first()
    return {
        "schema_version": 1, "tables_checksum": table_checksum(concepts)[1] + table_checksum(aliases)[1], "config": {"k1": k1, "b": b, "grams": list(grams)}, "type_map": {k: sorted(v) for k, v in type_map.items()},
        "indexes": {"exact_alias_keys": n.exact, "accentless_exact_keys": n.bare, "documents": n.docs, "ngram_keys": keyed.select(gram.alias("g")).distinct().count()}, "aliases": n.aliases,
    }


def write_index_metadata(spark: SparkSession, metadata: dict, path: str) -> str:
    return put_json(spark, path, metadata)


def write_calibration(models: DataFrame, groups: Iterable[str], version: str, path: str) -> dict:
    """Fitted calibrators (source, entity_type, ..., a row each) with the groups they were fitted on and a checksum;
    never over an existing file."""
    if not version or not (fitted := sorted(set(groups))):
        raise ValueError("a calibration has a version and the groups that it was fitted on")
    rows = sorted((r.asDict(recursive=True) for r in models.collect()), key=lambda r: (r["source"], r["entity_type"]))
    if not rows:
        raise ValueError("a calibration has models")
    body = {"version": version, "fit_group_ids": fitted, "models": rows}
    whole = body | {"checksum": hashlib.sha256(canonical_json(body).encode()).hexdigest()}
    put_json(models.sparkSession, path, whole, overwrite=False)
    return whole


def read_calibration(spark: SparkSession, path: str) -> dict:
    """The artifact; a checksum that does not fit is an error."""
    import json

    whole = json.loads(read_text(spark, path))
    body = {k: v for k, v in whole.items() if k != "checksum"}
    if whole.get("checksum") != hashlib.sha256(canonical_json(body).encode()).hexdigest():
        raise ValueError(f"{path}: checksum")
    return whole


def refuse_fitted(points: DataFrame, artifact: dict, group: str = "group_id") -> DataFrame:
    """Points to measure or apply a calibration on; one of a group that it was fitted on stops the query."""
    fitted = points.sparkSession.createDataFrame([(g, True) for g in artifact["fit_group_ids"]], f"{group} string, fitted boolean")
    stop = F.raise_error(F.concat(F.lit("fitted on this group: "), F.col(group))).cast("boolean")
    return points.join(fitted, group, "left").where(F.when(F.col("fitted"), stop).otherwise(True)).drop("fitted")


def sample_traces(entities: DataFrame, timings: DataFrame, key: str = "doc_id") -> DataFrame:
    """A trace for each sample of ``timings`` (key, elapsed_ms, output_sha256): status, counts and the decision on
    each entity (start, end, type, number of assertions and candidates), in order; no text."""
    size = lambda c: F.when(F.col(c).isNull(), 0).otherwise(F.size(c))
    e = entities.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("start", "end", "type", size("assertions").alias("assertions"), size("candidates").alias("candidates")))).alias("decisions"))
    out = timings.join(e, key, "left")
    decisions = F.coalesce("decisions", F.array().cast(e.schema["decisions"].dataType))
    status = F.when(F.col("output_sha256").isNull(), "failed").otherwise("completed")
    return safe_metadata(out.select(F.col(key).alias("sample"), status.alias("status"), "output_sha256", "elapsed_ms", F.size(decisions).alias("entities"), decisions.alias("decisions")))


def write_traces(traces: DataFrame, folder: str, run_id: str) -> None:
    """JSON lines under folder/run_id=..., which other runs leave alone."""
    safe_metadata(traces).write.mode("overwrite").json(f"{folder}/run_id={run_id}")


def write_gold(samples: DataFrame, folder: str) -> int:
    """Gold samples (sample_id, text, entities, confirmed) as JSON lines with sorted keys, ordered by id, after all
    of them are valid; nothing is written if one is not. Written aside first, then renamed. Returns how many."""
    bad = sample_report(samples).where(F.size("errors") > 0)
    if first := bad.orderBy("sample_id").first():
        raise ValueError(f"sample {first.sample_id}: {first.errors}")
    spark, aside = samples.sparkSession, f"{folder}.part"
    keys = sorted(c for c in samples.columns)
    samples.orderBy("sample_id").select(F.to_json(F.struct(*(F.col(f"`{c}`") for c in keys))).alias("value")).write.mode("overwrite").text(aside)
    n = spark.read.text(aside).count()
    target, system = _path(spark, folder)
    system.delete(target, True)
    if not system.rename(_path(spark, aside)[0], target):
        raise OSError(f"could not write {folder}")
    return n
