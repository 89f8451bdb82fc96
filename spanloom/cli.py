"""Commands over the library: ``python -m spanloom.cli COMMAND ...``; each prints one JSON object, exit code 1 is a no."""

from __future__ import annotations

import argparse
import json
import os
import sys
from collections.abc import Sequence


class LoadError(Exception):
    """What went wrong with an input, by kind (missing, unreadable, encoding, format), never with its text."""

    def __init__(self, kind: str, where: str):
        super().__init__(f"{kind}: {where}")
        self.kind, self.where = kind, where


def _json(path: str) -> object:
    try:
        with open(path, encoding="utf-8") as f:
            return json.load(f)
    except FileNotFoundError as e:
        raise LoadError("missing", path) from e
    except UnicodeDecodeError as e:
        raise LoadError("encoding", path) from e
    except ValueError as e:
        raise LoadError("format", path) from e
    except OSError as e:
        raise LoadError("unreadable", path) from e


def _spark():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("spanloom").getOrCreate()


def validate_config(a) -> dict:
    from .sources.config import load_config

    load_config(a.config)
    return {"ok": True}


def preflight(a) -> dict:
    from .sources.config import verify_artifacts

    found = verify_artifacts(_json(a.inventory))
    return {"ok": all(x["status"] == "ok" for x in found), "artifacts": found}


def prepare_terminology(a) -> dict:
    from .operators.curate import prepare_terminology as prepare
    from .sources.artifacts import write_canonical

    spark = _spark()
    return {"ok": True} | write_canonical(prepare(spark.read.parquet(a.concepts), spark.read.parquet(a.aliases)), a.output)


def infer(a) -> dict:
    from .operators.infer import entities

    spark = _spark()
    lexicon = {t: tuple(names) for t, names in _json(a.lexicon).items()}
    entities(spark.read.parquet(a.documents), lexicon).write.mode("errorifexists").parquet(a.output)
    return {"ok": True, "entities": spark.read.parquet(a.output).count()}


def evaluate(a) -> dict:
    from .operators.evaluate import evaluation_report
    from .sources.artifacts import put_json

    spark = _spark()
    rows = evaluation_report(*(spark.read.parquet(p) for p in (a.gold, a.predictions, a.runs))).collect()
    report: dict[str, dict[str, float]] = {}
    for r in rows:
        report.setdefault(r.section, {})[r.name] = r.value
    return {"ok": True, "checksum": put_json(spark, a.output, report, overwrite=False)}


def package(a) -> dict:
    from .sources.sinks import package as write

    files = {}
    for name in sorted(os.listdir(a.folder)):
        with open(os.path.join(a.folder, name), "rb") as f:
            files[name] = f.read()
    write(files, a.output)
    return {"ok": True, "files": len(files)}


def validate_submit(a) -> dict:
    from .operators.curate import submission_errors

    spark = _spark()
    bad = submission_errors(*(spark.read.parquet(p) for p in (a.files, a.documents, a.codes)))
    counts = {r.error: r["count"] for r in bad.groupBy("error").count().collect()}
    return {"ok": not counts, "errors": counts}


def show_manifest(a) -> dict:
    from .sources.config import manifest_complete

    m = _json(a.manifest)
    return {"ok": manifest_complete(m), "manifest": m}


def final_gate(a) -> dict:
    """Configuration, artifacts and manifest together; tests and the smoke run are the build's business."""
    steps = {"config": validate_config(a)["ok"], "artifacts": preflight(a)["ok"], "manifest": show_manifest(a)["ok"]}
    return {"ok": all(steps.values()), "steps": steps}


COMMANDS = {
    "validate-config": (validate_config, ("config",)), "offline-preflight": (preflight, ("inventory",)), "prepare-terminology": (prepare_terminology, ("concepts", "aliases", "output")),
    "infer": (infer, ("documents", "lexicon", "output")), "evaluate": (evaluate, ("gold", "predictions", "runs", "output")), "package": (package, ("folder", "output")),
    "validate-submit": (validate_submit, ("files", "documents", "codes")), "show-manifest": (show_manifest, ("manifest",)), "final-gate": (final_gate, ("config", "inventory", "manifest")),
}


def main(argv: Sequence[str] | None = None) -> int:
    """G11."""
    parser = argparse.ArgumentParser(prog="spanloom")
    commands = parser.add_subparsers(dest="command", required=True)
    for name, (_, arguments) in COMMANDS.items():
        sub = commands.add_parser(name)
        for x in arguments:
            sub.add_argument(x)
    a = parser.parse_args(argv)
    try:
        result = COMMANDS[a.command][0](a)
    except (LoadError, ValueError, OSError) as e:
        result = {"ok": False, "error": getattr(e, "kind", type(e).__name__)}
    print(json.dumps(result, ensure_ascii=False, sort_keys=True))
    return 0 if result["ok"] else 1


if __name__ == "__main__":
    sys.exit(main())
