"""Documents to views, structure and entities: span kernels in Arrow batches, one pass, no shuffle."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels as K
from .spans import overlap_join


#: Rows, and text bytes, that a kernel works on at once.
SLICE_ROWS, SLICE_BYTES = 128, 1 << 20


def slices(batch: pa.RecordBatch, column: int = 1) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of at most SLICE_ROWS rows and about SLICE_BYTES of text, or one row."""
    at, size = 0, 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()):
        if i > at and (i - at >= SLICE_ROWS or size + n > SLICE_BYTES):
            yield batch.slice(at, i - at)
            at, size = i, 0
        size += n
    if batch.num_rows:
        yield batch.slice(at)


def per_document(docs: DataFrame, kernel: Callable[[int, str], Iterable[tuple]], schema: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of kernel(id, text); the schema's first column is the id. A null text is an empty one."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    shape = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                rows = [(d, *r) for d, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist()) for r in kernel(d, t or "")]
                columns = list(zip(*rows)) or [()] * len(shape)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, shape)], schema=shape)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, schema)


def isolated(docs: DataFrame, kernel: Callable[[int, str], object], limit_ms: float | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, result, error, elapsed_ms): kernel(id, text) as JSON, one row for each document. What it
    raises becomes the row's error, by its type alone, so that no text leaks; a document that took longer than
    ``limit_ms`` is failed afterwards as timeout."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import time

        for batch in batches:
            for part in slices(batch):
                out: tuple[list, list, list] = ([], [], [])
                for d, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    began, result, error = time.perf_counter(), None, None
                    try:
                        result = K.canonical_json(kernel(d, t or ""))
                    except Exception as e:  # noqa: BLE001  whatever a kernel raises is the row's own failure
                        error = type(e).__name__
                    took = (time.perf_counter() - began) * 1000
                    if error is None and limit_ms is not None and took > limit_ms:
                        result, error = None, "timeout"
                    for column, value in zip(out, (result, error, took)):
                        column.append(value)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), pa.array(out[2], pa.float64())], names=["doc_id", "result", "error", "elapsed_ms"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, result string, error string, elapsed_ms double")


def united(*proposals: DataFrame) -> DataFrame:
    """The proposals of all proposers with ``proposer``, the place of each in this order."""
    out = proposals[0].withColumn("proposer", F.lit(0))
    for i, p in enumerate(proposals[1:], 1):
        out = out.unionByName(p.withColumn("proposer", F.lit(i)))
    return out


def without_headings(spans: DataFrame, units: DataFrame, key: str = "doc_id") -> DataFrame:
    """The spans that overlap no heading. ``units``: rows of structure_units, whose sections have heading_end."""
    heads = units.where("kind = 'section' and start < heading_end").select(key, F.col("start").alias("r_start"), F.col("heading_end").alias("r_end"))
    hit = overlap_join(spans.select(key, "start", "end").distinct(), heads, key).select(key, "start", "end").distinct()
    return spans.join(hit, [key, "start", "end"], "left_anti").select(*spans.columns)


def text_views(docs: DataFrame, names: tuple[str, ...] = ("raw", "nfc", "lower", "accentless", "collapsed")) -> DataFrame:
    """Each of the named views with its raw boundaries."""
    return per_document(docs, lambda _, t: [(n, v.text, v.bounds) for n, v in K.views(t).items() if n in names], "doc_id long, view string, text string, bounds array<int>")


UNITS = ("section", "list_item", "sentence", "clause")


def structure_units(docs: DataFrame, kinds: tuple[str, ...] = UNITS) -> DataFrame:
    """Sections, list items, sentences and clauses in one tall table; only what ``kinds`` need is looked for."""

    def kernel(_: int, text: str) -> list[tuple]:
        sec = K.sections(text) if "section" in kinds or "list_item" in kinds else []
        sen = K.sentences(text) if "sentence" in kinds or "clause" in kinds else []
        found = {"section": lambda: sec, "list_item": lambda: K.list_items(text, sec), "sentence": lambda: sen, "clause": lambda: K.clauses(text, sen)}
        return [(u.kind, u.start, u.end, u.label, u.heading_end) for k in UNITS if k in kinds for u in found[k]()]

    return per_document(docs, kernel, "doc_id long, kind string, start int, end int, label string, heading_end int")


def entities(docs: DataFrame, lexicon: dict[str, tuple[str, ...]], cues=K.CUES) -> DataFrame:
    """Alias mentions by type, longest first without overlaps, with their assertions. An
    empty lexicon gives no rows."""
    kind = {a.casefold(): t for t, aliases in lexicon.items() for a in aliases}

    def kernel(_: int, text: str) -> list[tuple]:
        spans = K.alias_spans(text, kind) if kind else []
        st = K.Structure.of(text) if spans else None
        return [(a, b, text[a:b], kind[text[a:b].casefold()], K.labels_of(K.assertions(text, a, b, st, cues))) for a, b in spans]

    return per_document(docs, kernel, "doc_id long, start int, end int, text string, type string, assertions array<string>")


def mention_slots(mentions: DataFrame, kind: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, name, start, end, value, confidence) of the slots of medication or laboratory mentions."""
    from ..functions import slots

    parse = {"medication": slots.parse_medication, "laboratory": slots.parse_laboratory}[kind]

    def kernel(_: int, mention: str) -> list[tuple]:
        p = parse(mention)
        rows = [(n, s) for n, v in p.slots.items() for s in (v if isinstance(v, list) else [v])]
        return [(n, s.start, s.end, s.value, p.confidence) for n, s in rows]

    return per_document(mentions, kernel, f"{id_col} long, name string, start int, end int, value string, confidence double", id_col, text_col)


def grounded(proposals: DataFrame, docs: DataFrame) -> DataFrame:
    """Proposals (doc_id, surface, expected_start, expected_end) placed in their documents."""
    rows = proposals.groupBy("doc_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct("surface", "expected_start", "expected_end")))).alias("p"))
    both = docs.select("doc_id", "text").join(rows, "doc_id").select("doc_id", F.to_json(F.struct("text", "p")).alias("text"))

    def kernel(_: int, packed: str) -> list[tuple]:
        import json

        row = json.loads(packed)
        out = []
        for p in json.loads(row["p"]):
            method, span, score = K.ground(row["text"], p["surface"], (p["expected_start"], p["expected_end"]))
            out.append((p["surface"], method, *(span or (None, None)), score))
        return out

    return per_document(both, kernel, "doc_id long, surface string, method string, start int, end int, confidence double")
