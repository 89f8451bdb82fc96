"""Models as plug-ins: protocols, stand-ins without a model, retries, and what surrounds a model's answers.

A model is an object with one of the methods below. It is created once in each worker process, by a factory that is sent
there, and is called with batches. Without a model the stand-ins here keep every step runnable: hashed vectors, word
overlap, templates.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator, Sequence
from typing import Protocol, runtime_checkable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import kernels as K
from . import infer, validate


@runtime_checkable
class SpanProposer(Protocol):
    """T19, G01."""

    def propose(self, text: str) -> Sequence[tuple[int, int, str, float]]: ...


@runtime_checkable
class MentionEncoder(Protocol):
    """G02."""

    def encode(self, texts: Sequence[str]) -> Sequence[Sequence[float]]: ...


@runtime_checkable
class PairScorer(Protocol):
    """Of (mention, candidate term) pairs."""

    def score(self, pairs: Sequence[tuple[str, str]]) -> Sequence[float]: ...


@runtime_checkable
class LabelModel(Protocol):
    """A logit for each label of each (text, start, end)."""

    def logits(self, items: Sequence[tuple[str, int, int]]) -> Sequence[dict[str, float]]: ...


@runtime_checkable
class TextModel(Protocol):
    """Completions of prompts."""

    def complete(self, prompts: Sequence[str]) -> Sequence[str]: ...


class HashEncoder:
    """Vectors without a model."""

    def __init__(self, dims: int = 16):
        self.dims = dims

    def encode(self, texts: Sequence[str]) -> list[list[float]]:
        return [K.hash_embedding(t, self.dims) for t in texts]


class OverlapScorer:
    """Shared words over all words of a pair."""

    def score(self, pairs: Sequence[tuple[str, str]]) -> list[float]:
        sets = [(set(a.casefold().split()), set(b.casefold().split())) for a, b in pairs]
        return [len(a & b) / len(a | b) if a | b else 0.0 for a, b in sets]


class TemplateModel:
    """Answers by rule; ``answers`` maps a pattern of the prompt to the answer, in which groups are filled in."""

    def __init__(self, answers: dict[str, str], default: str = "[]"):
        self.answers, self.default = [(re.compile(p, re.S), a) for p, a in answers.items()], default

    def complete(self, prompts: Sequence[str]) -> list[str]:
        return [next((m.expand(a) for p, a in self.answers if (m := p.search(x))), self.default) for x in prompts]


class Overloaded(Exception):
    """What a client raises when it was told to slow down."""


def with_retries(call: Callable[[], object], tries: int = 4, pause: float = 1.0, factor: float = 2.0, cooldown: float = 30.0, sleep: Callable[[float], None] = time.sleep) -> object:
    """The result of ``call``; failures are tried again after pauses that grow by ``factor``, and after ``cooldown`` at
    least where the service is overloaded. The last failure is raised."""
    for n in range(tries):
        try:
            return call()
        except Exception as e:  # noqa: BLE001  any failure of a client may pass
            if n + 1 == tries:
                raise
            sleep(max(pause * factor**n, cooldown if isinstance(e, Overloaded) else 0.0))


def _column(rows: DataFrame, columns: list[str], factory: Callable[[], object], ask: Callable, name: str, kind: str, size: int) -> DataFrame:
    """Adds ``name`` = ask(model, batch of the columns' values), in batches of ``size`` rows."""
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    out_type = to_arrow_type(_parse_datatype_string(kind))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = None
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                model = model or factory()
                values = ask(model, list(zip(*(part.column(c).to_pylist() for c in columns))))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(values, out_type)], names=[*part.schema.names, name])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{ddl}, `{name}` {kind}")


def encoded(rows: DataFrame, factory: Callable[[], MentionEncoder] = HashEncoder, text: str = "text", size: int = 64) -> DataFrame:
    """Rows with ``vector``."""
    return _column(rows, [text], factory, lambda m, v: m.encode([t or "" for (t,) in v]), "vector", "array<double>", size)


def pair_scores(rows: DataFrame, factory: Callable[[], PairScorer] = OverlapScorer, mention: str = "mention", term: str = "term", size: int = 64) -> DataFrame:
    """Candidate rows with ``score``."""
    return _column(rows, [mention, term], factory, lambda m, v: m.score([(a or "", b or "") for a, b in v]), "score", "double", size)


def completions(rows: DataFrame, factory: Callable[[], TextModel], prompt: str = "prompt", size: int = 16) -> DataFrame:
    """Rows with ``completion``; a batch whose call fails after all tries has null completions."""

    def ask(model: TextModel, values: list) -> list:
        try:
            return list(with_retries(lambda: model.complete([p or "" for (p,) in values])))
        except Exception:  # noqa: BLE001  a failed batch is marked, the others go on
            return [None] * len(values)

    return _column(rows, [prompt], factory, ask, "completion", "string", size)


def proposed(docs: DataFrame, factory: Callable[[], TextModel], allowed: bool = False, score: float = 0.5) -> DataFrame:
    """(doc_id, start, end, type, score) of a language model's proposals, every occurrence of each surface. Only runs
    where it is allowed (by an ablation); a completion that is not valid as a whole proposes nothing."""
    from pyspark.sql.types import StructType

    kinds = "doc_id long, start int, end int, type string, score double"
    if not allowed:
        return docs.sparkSession.createDataFrame([], StructType.fromDDL(kinds))
    asked = completions(docs.select("doc_id", "text", F.col("text").alias("prompt")), factory)
    good = validate.completion_items(asked).where("error is null").select("doc_id", F.to_json(F.struct("text", "items")).alias("text"))

    def kernel(_: int, packed: str) -> list[tuple]:
        import json

        row = json.loads(packed)
        return sorted({(a, a + len(x["text"]), x["provisional_type"], score) for x in row["items"] for a in K.occurrences(row["text"], x["text"])})

    return infer.per_document(good, kernel, kinds)


def criticised(samples: DataFrame, cues: dict[str, tuple[str, ...]], family_codes: tuple[str, ...] = ()) -> DataFrame:
    """Samples with the verdict of the deterministic critic: valid, errors, warnings; those that hold entities whose
    spans are wrong but can be found again get ``fixed`` entities, placed anew."""
    judged = validate.local_validation(samples, cues, family_codes)
    kind = samples.schema["entities"].dataType.simpleString()
    keep = [f.name for f in samples.schema["entities"].dataType.elementType.fields]

    def again(model: object, values: list) -> list:
        out = []
        for text, es, errors in values:
            if not es or "bad_exact_span" not in (errors or ()):
                out.append(es)
                continue
            spans = K.relocate(text or "", [e["text"] for e in es])
            out.append([{n: e[n] for n in keep} | {"start": s[0], "end": s[1], "text": text[s[0] : s[1]]} for e, s in zip(es, spans) if s])
        return out

    return _column(judged, ["text", "entities", "errors"], lambda: True, again, "fixed", kind, 256)


def labelled(notes: DataFrame, factory: Callable[[], TextModel], least: float = 0.5) -> DataFrame:
    """Notes (id, note) with the teacher's entities: its JSON answer is parsed, entities of unknown types and
    assertions go, surfaces are placed in the note, confidences filter; ``status`` tells what came of it."""
    shape = "array<struct<text:string,type:string,assertions:array<string>,confidence:double>>"
    asked = completions(notes.withColumn("prompt", F.col("note")), factory).drop("prompt")
    raw = asked.withColumn("parsed", F.from_json(F.coalesce("completion", F.lit("")), shape))
    kept = validate.filter_schema(F.transform("parsed", lambda e: e.withField("assertions", F.coalesce(e["assertions"], F.array().cast("array<string>")))))
    filtered = raw.withColumn("kept", F.coalesce(validate.filter_confidence(kept, least), F.array().cast(shape)))
    place = "array<struct<text:string,type:string,start:int,end:int,assertions:array<string>,confidence:double>>"

    def put(model: object, values: list) -> list:
        out = []
        for note, es in values:
            spans = K.relocate(note or "", [e["text"] or "" for e in es])
            out.append([{"text": note[s[0] : s[1]], "type": e["type"], "start": s[0], "end": s[1], "assertions": e["assertions"], "confidence": e["confidence"]} for e, s in zip(es, spans) if s])
        return out

    placed = _column(filtered, ["note", "kept"], lambda: True, put, "entities", place, 256)
    status = validate.labeling_status(F.col("parsed").isNotNull(), F.size(F.coalesce("parsed", F.array().cast(shape))), F.size("entities"))
    return placed.withColumn("status", status).drop("parsed", "kept", "completion")


def paraphrased(samples: DataFrame, factory: Callable[[], TextModel], strict: bool = True) -> DataFrame:
    """Samples (id, text, entities) rewritten by the model's JSON answer (text, entities); ``paraphrase`` and
    ``entities_again`` are null where the labels were not preserved or a surface cannot be placed."""
    entity = "struct<text:string,type:string,assertions:array<string>>"
    asked = completions(samples.withColumn("prompt", F.to_json(F.struct("text", "entities"))), factory).drop("prompt")
    r = asked.withColumn("new", F.from_json(F.coalesce("completion", F.lit("")), f"struct<text:string,entities:array<{entity}>>"))
    same = F.coalesce(validate.paraphrase_valid(F.col("entities"), F.col("new.entities"), strict), F.lit(False))
    r = r.withColumn("new", F.when(same, F.col("new")))
    place = "array<struct<text:string,type:string,start:int,end:int,assertions:array<string>>>"

    def put(model: object, values: list) -> list:
        out = []
        for (new,) in values:
            spans = K.relocate(new["text"], [e["text"] for e in new["entities"]]) if new else [None]
            out.append([e | {"start": s[0], "end": s[1]} for e, s in zip(new["entities"], spans)] if new and all(spans) else None)
        return out

    done = _column(r, ["new"], lambda: True, put, "entities_again", place, 256)
    return done.withColumn("paraphrase", F.when(F.col("entities_again").isNotNull(), F.col("new.text"))).drop("new", "completion")


def styled(text: Column, key: Column, rules: dict[str, str], level: float = 0.3, seed: int = 0) -> Column:
    """Each rule (a word, its replacement) applies to a text with probability ``level``, decided by a hash of the
    row's key, the rule and the seed: the same rows change alike in every run."""
    out = text
    for i, (word, other) in enumerate(rules.items()):
        chance = F.pmod(F.xxhash64(key, F.lit(i), F.lit(seed)), F.lit(1_000_000)) / 1_000_000
        out = F.when(chance < level, F.regexp_replace(out, rf"(?iU)(?<!\w){re.escape(word)}(?!\w)", re.sub(r"([\\$])", r"\\\1", other))).otherwise(out)
    return out
