"""Run configuration, artifact checks and the resumable batch (driver side, small data)."""

from __future__ import annotations

import hashlib
import json
import os
import re
from dataclasses import dataclass, fields

SECRET = re.compile(r"(?i)(?:secret|token|password|api_?key|credential)")


@dataclass(frozen=True)
class RunConfig:
    """Flags that must agree: ontology needs reranking, reranking needs dense search, and runs are offline."""

    offline: bool = True
    dense: bool = False
    reranker: bool = False
    ontology: bool = False
    batch_size: int = 64

    def __post_init__(self):
        if not self.offline:
            raise ValueError("runs are offline")
        if self.reranker and not self.dense or self.ontology and not self.reranker:
            raise ValueError("ontology needs the reranker, and that needs dense search")
        if self.batch_size < 1:
            raise ValueError("batch_size is positive")


def load_config(path: str) -> RunConfig:
    """From JSON; unknown keys, and keys that look like secrets, are errors."""
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    if bad := sorted(k for k in data if SECRET.search(k)):
        raise ValueError(f"secrets do not belong in a configuration: {bad}")
    if bad := sorted(set(data) - {f.name for f in fields(RunConfig)}):
        raise ValueError(f"unknown keys: {bad}")
    return RunConfig(**data)


def sha256_of(path: str) -> str:
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while block := f.read(1 << 20):
            h.update(block)
    return h.hexdigest()


def verify_artifacts(inventory: list[dict], most_parameters: int = 9_000_000_000) -> list[dict]:
    """The status of each artifact (path, bytes, sha256, parameters): ok, missing, size, digest or parameters."""
    out = []
    for a in inventory:
        if not os.path.exists(a["path"]):
            status = "missing"
        elif os.path.getsize(a["path"]) != a["bytes"]:
            status = "size"
        elif sha256_of(a["path"]) != a["sha256"]:
            status = "digest"
        else:
            status = "ok" if a.get("parameters", 0) <= most_parameters else "parameters"
        out.append({"path": a["path"], "status": status})
    return out


def to_do(inputs: list[str], folder: str, checksums: dict[str, str], policy: str = "reuse_valid") -> list[str]:
    """The inputs whose output is absent or does not match its checksum; ``never`` redoes all, ``fail_if_exists``
    raises on any output."""
    valid = [i for i in inputs if os.path.exists(p := os.path.join(folder, f"{i}.json")) and checksums.get(i) == sha256_of(p)]
    if policy == "fail_if_exists" and any(os.path.exists(os.path.join(folder, f"{i}.json")) for i in inputs):
        raise FileExistsError(folder)
    return list(inputs) if policy == "never" else [i for i in inputs if i not in valid]


def manifest_complete(manifest: dict) -> bool:
    """P22."""
    return manifest.get("status") == "finalized" and sum(manifest.get(k, 0) for k in ("completed", "failed", "resumed")) == manifest.get("n")
