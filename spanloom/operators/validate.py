"""Validation of samples whose entities are arrays of structs (text, type, start, end, assertions, candidates)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values.
TYPES = ("TRIỆU_CHỨNG", "TÊN_XÉT_NGHIỆM", "KẾT_QUẢ_XÉT_NGHIỆM", "CHẨN_ĐOÁN", "THUỐC")
CODED = ("CHẨN_ĐOÁN", "THUỐC")
LABELS = ("isNegated", "isHistorical", "isFamily")


def entity_errors(entities: Column, text: Column) -> Column:
    """Error codes of each entity, in order."""
    known, labels = F.array(*map(F.lit, TYPES)), F.array(*map(F.lit, LABELS))

    def of(e: Column) -> Column:
        inside = (e["start"] >= 0) & (e["start"] < e["end"]) & (e["end"] <= F.length(text))
        return F.array_compact(
            F.array(
                F.when(~inside, "out_of_bounds"),
                F.when(inside & (F.substring(text, e["start"] + 1, e["end"] - e["start"]) != e["text"]), "text_mismatch"),
                F.when(~F.array_contains(known, e["type"]), "unknown_type"),
                F.when(F.size(F.array_except(F.coalesce(e["assertions"], F.array().cast("array<string>")), labels)) > 0, "unknown_assertion"),
                F.when(e["candidates"].isNotNull() & ~e["type"].isin(*CODED), "candidates_not_allowed"),
            )
        )

    return F.transform(entities, of)


def sample_report(samples: DataFrame, id_col: str = "sample_id") -> DataFrame:
    """Samples (id, text, entities, confirmed) with errors and warnings: each entity's codes, duplicates, and
    overlaps, which are errors in confirmed samples and warnings in others."""
    key = lambda e: F.struct(e["start"], e["end"], e["type"])
    keys = F.transform("entities", key)
    duplicate = F.size(F.array_distinct(keys)) < F.size(keys)
    overlap = F.exists("entities", lambda a: F.exists("entities", lambda b: (a["start"] < b["end"]) & (b["start"] < a["end"]) & (key(a) != key(b))))
    errors = F.array_distinct(F.flatten(entity_errors(F.col("entities"), F.col("text"))))
    more = F.array_compact(F.array(F.when(duplicate, "duplicate_entity"), F.when(overlap & F.col("confirmed"), "overlap")))
    return samples.select(id_col, F.concat(errors, more).alias("errors"), F.array_compact(F.array(F.when(overlap & ~F.col("confirmed"), "overlap"))).alias("warnings"))


def filter_schema(entities: Column) -> Column:
    """P10: entities of unknown types go, and unknown assertions."""
    keep = F.filter(entities, lambda e: e["type"].isin(*TYPES))
    return F.transform(keep, lambda e: e.withField("assertions", F.filter(e["assertions"], lambda a: a.isin(*LABELS))))


def filter_confidence(entities: Column, least: float) -> Column:
    """Confidences are clamped to [0, 1]; known ones under ``least`` go, unknown ones stay."""
    clamped = F.transform(entities, lambda e: e.withField("confidence", F.when(e["confidence"].isNotNull(), F.greatest(F.least(e["confidence"], F.lit(1.0)), F.lit(0.0)))))
    return F.filter(clamped, lambda e: e["confidence"].isNull() | (e["confidence"] >= least))


def reasons(checks: dict[str, Column]) -> Column:
    """The names of the checks that hold, in order, each once; the first is the primary reason."""
    return F.array_distinct(F.array_compact(F.array(*(F.when(c, n) for n, c in checks.items()))))


def labeling_status(parsed: Column, proposed: Column, validated: Column) -> Column:
    """P12."""
    return F.when(~parsed, "parse_failed").when(proposed == 0, "no_entities").when(validated == 0, "all_rejected").otherwise("labeled")


def masked(text: Column, entities: Column) -> Column:
    """The text with blanks in place of entities."""
    return F.aggregate(entities, text, lambda t, e: F.overlay(t, F.repeat(F.lit(" "), e["end"] - e["start"]), e["start"] + 1, e["end"] - e["start"]))


def family_allowed(candidates: Column, allowed: tuple[str, ...]) -> Column:
    """A code, or its part before the point, is on the list."""
    return F.exists(candidates, lambda c: c.isin(*allowed) | F.substring_index(c, ".", 1).isin(*allowed))


def paraphrase_valid(source: Column, rewritten: Column, strict: bool) -> Column:
    """As many entities, the same types and assertions in order; with ``strict`` the same surfaces."""
    same = lambda a, b: (a["type"] == b["type"]) & (a["assertions"] == b["assertions"]) & ((a["text"] == b["text"]) | F.lit(not strict))
    return (F.size(source) == F.size(rewritten)) & F.forall(F.zip_with(source, rewritten, lambda a, b: F.coalesce(same(a, b), F.lit(False))), lambda x: x)


def structured_conflict(query: dict[str, Column], candidate: dict[str, Column]) -> Column:
    """The first feature that both sides have and whose query values the candidate lacks; null if none."""
    out = F.lit(None).cast("string")
    for name in reversed(list(query)):
        q, c = query[name], candidate[name]
        out = F.when((F.size(q) > 0) & (F.size(c) > 0) & (F.size(F.array_except(q, c)) > 0), name).otherwise(out)
    return out


def subwords_aligned(offsets: Column, most: int) -> Column:
    """Offsets in order, without overlap, at most ``most``."""
    n = F.size(offsets)
    pairs = F.zip_with(F.slice(offsets, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(offsets, F.lit(2), F.greatest(n - 1, F.lit(0))), lambda a, b: a["end"] <= b["start"])
    return (n <= most) & F.forall(offsets, lambda o: o["start"] <= o["end"]) & F.forall(pairs, lambda ok: ok)


#: Signals of the profiles that are looked for outside of the entities, and ideographs that are noise.
PROFILE_SIGNALS = {
    "abbreviation_or_typo": ("missing_medical_abbreviation", r"(?iU)\b(?:BN|HA|THA|CRP|WBC|ECG|EEG|MRI|CT|SpO2|PO|IV)\b"),
    "mixed_language": ("missing_mixed_language_term", r"(?iU)\bfollow-up\b"),
}
CJK = r"[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}]"


def _held(text: Column, e: Column) -> Column:
    inside = (e["start"] >= 0) & (e["start"] < e["end"]) & (e["end"] <= F.length(text))
    return F.coalesce(inside & (F.substring(text, e["start"] + 1, e["end"] - e["start"]) == e["text"]), F.lit(False))


def profile_errors(text: Column, entities: Column, profile: Column) -> Column:
    """What a challenge profile promises and the sample lacks: a surface at two places; a medical abbreviation, or
    "follow-up", outside of the entities."""
    placed = F.transform(F.filter(entities, lambda e: e["text"].isNotNull() & e["start"].isNotNull() & e["end"].isNotNull()), lambda e: F.struct(e["text"].alias("text"), e["start"].alias("s"), e["end"].alias("e")))
    twice = F.size(F.array_distinct(placed)) > F.size(F.array_distinct(F.transform(placed, lambda x: x["text"])))
    out = F.when((profile == "repeated_mention") & ~twice, "missing_repeated_mention")
    bare = masked(text, F.filter(entities, lambda e: (e["start"] >= 0) & (e["start"] < e["end"]) & (e["end"] <= F.length(text))))
    for name, (error, signal) in PROFILE_SIGNALS.items():
        out = out.when((profile == name) & ~bare.rlike(signal), error)
    return F.array_compact(F.array(out))


def local_validation(samples: DataFrame, cues: dict[str, tuple[str, ...]], family_codes: tuple[str, ...]) -> DataFrame:
    """Samples (text, entities, profile) with ``valid``, ``errors`` and ``warnings``, entity by entity.

    An entity whose span does not hold its surface has no further errors. Cues of each of its assertions are looked for
    within 80 characters on both sides; a missing one is a warning."""
    text, e = F.coalesce("text", F.lit("")), F.coalesce("entities", F.array().cast(samples.schema["entities"].dataType))
    none = F.array().cast("array<string>")

    def per_entity(x: Column) -> Column:
        said = F.coalesce(x["assertions"], none)
        family = F.array_contains(said, "isFamily") & ~((x["type"] == "CHẨN_ĐOÁN") & F.coalesce(_family(x["candidates"], family_codes), F.lit(False)))
        held = _held(text, x)
        found = F.array(F.when(~F.coalesce(x["type"].isin(*TYPES), F.lit(False)), "invalid_entity_type"), F.when(F.size(F.array_except(said, F.array(*map(F.lit, LABELS)))) > 0, "invalid_assertion"), F.when(~held, "bad_exact_span"), F.when(held & family, "invalid_family_semantics"))
        return F.array_compact(found)

    def warned(x: Column) -> Column:
        first = F.greatest(x["start"] - 80, F.lit(0))
        near = F.lower(F.substring(text, first + 1, x["end"] + 80 - first))

        def missing(a: Column) -> Column:
            some = F.lit(False)
            for label, words in cues.items():
                for w in words:
                    some = some | ((a == label) & F.contains(near, F.lit(w.lower())))
            return F.when(~some, F.concat(F.lit("missing_"), a, F.lit("_cue")))

        return F.when(_held(text, x), F.array_compact(F.transform(F.coalesce(x["assertions"], none), missing))).otherwise(none)

    errors = F.concat(F.when(text.rlike(CJK), F.array(F.lit("contains_cjk_noise"))).otherwise(none), F.flatten(F.transform(e, per_entity)), profile_errors(text, e, F.coalesce("profile", F.lit("basic"))))
    out = samples.withColumn("errors", errors).withColumn("warnings", F.flatten(F.transform(e, warned)))
    return out.withColumn("valid", F.size("errors") == 0)


def _family(candidates: Column, allowed: tuple[str, ...]) -> Column:
    """A code, or its part before the point, is that of an allowed one."""
    heads = sorted({c.split(".")[0] for c in allowed})
    return F.exists(F.coalesce(candidates, F.array().cast("array<string>")), lambda c: c.isin(*allowed) | F.substring_index(c, ".", 1).isin(*heads))


#: Keys of a completion's objects.
COMPLETION = ("evidence_label", "provisional_type", "text")


def completion_items(rows: DataFrame, label: str = r"^[a-z0-9][a-z0-9_.-]{0,63}$") -> DataFrame:
    """P20: rows (completion, text) with ``error`` (null if none) and ``items`` (text, provisional_type, evidence_label),
    all or nothing: a JSON list of objects with these keys alone, text and type required; surfaces that stand in the
    text; known types; labels of the pattern; no object twice."""
    raw = F.from_json("completion", "array<string>")
    items = F.from_json("completion", "array<struct<text:string,provisional_type:string,evidence_label:string>>")
    keys = lambda o: F.coalesce(F.json_object_keys(o), F.array().cast("array<string>"))
    have = F.array(*map(F.lit, COMPLETION))
    r = rows.withColumn("__raw", raw).withColumn("items", items)
    error = (
        F.when(~F.coalesce(F.col("completion"), F.lit("")).rlike(r"^\s*\[(?s).*\]\s*$") | F.col("__raw").isNull(), "completion_must_be_list")
        .when(F.exists("__raw", lambda o: F.json_object_keys(o).isNull() | (F.size(F.array_except(keys(o), have)) > 0)), "invalid_completion_object")
        .when(F.exists("__raw", lambda o: ~F.array_contains(keys(o), "text") | ~F.array_contains(keys(o), "provisional_type")), "missing_required_fields")
        .when(F.exists("items", lambda x: F.coalesce(F.length(x["text"]) == 0, F.lit(True)) | ~F.contains("text", x["text"])), "non_exact_mention")
        .when(F.exists("items", lambda x: ~F.coalesce(x["provisional_type"].isin(*TYPES), F.lit(False))), "unsupported_provisional_type")
        .when(F.exists("items", lambda x: x["evidence_label"].isNotNull() & ~x["evidence_label"].rlike(label)), "invalid_evidence_label")
        .when(F.size(F.array_distinct("items")) < F.size("items"), "duplicate_proposal_object")
    )
    return r.withColumn("error", error).withColumn("items", F.when(F.col("error").isNull(), F.col("items"))).drop("__raw")


#: Names that metadata may not have.
RAW_TEXT = ("document", "document_id", "name", "note", "patient", "raw", "raw_text", "text")


def safe_metadata(trace: DataFrame) -> DataFrame:
    """The trace itself; columns (of nested structs, too) that carry raw text are an error."""

    def names(t, at: str = "") -> list[str]:
        if t.typeName() == "struct":
            return [n for f in t.fields for n in [at + f.name, *names(f.dataType, f"{at}{f.name}.")]]
        if t.typeName() == "array":
            return names(t.elementType, at)
        return names(t.valueType, at) if t.typeName() == "map" else []

    if bad := sorted(n for n in names(trace.schema) if n.rsplit(".", 1)[-1].lower() in RAW_TEXT):
        raise ValueError(f"traces hold no raw text: {bad}")
    return trace


def matched_samples(gold: DataFrame, pred: DataFrame, key: str = "sample_id") -> DataFrame:
    """Gold and predictions side by side (structs g and p). An id that is on one side only, or twice on a side, stops
    the query."""
    side = lambda df, n: df.groupBy(key).agg(F.count("*").alias(f"{n}_n"), F.first(F.struct(*(c for c in df.columns if c != key))).alias(n))
    both = side(gold, "g").join(side(pred, "p"), key, "full")
    fine = (F.col("g_n") == 1) & (F.col("p_n") == 1)
    stop = F.raise_error(F.concat(F.lit("samples must match one to one: "), F.col(key).cast("string"))).cast("boolean")
    return both.where(F.when(F.coalesce(fine, F.lit(False)), True).otherwise(stop)).select(key, "g", "p")


def training_rows(split: DataFrame, annotations: DataFrame, key: str = "record_id", group: str = "group_id") -> DataFrame:
    """Train and dev records (key, group, split, text) with their annotations (key, text, entities). A record without
    one, another text, or a group in two splits stops the query."""
    part = split.where("split in ('train', 'dev')")
    leaks = split.groupBy(group).agg(F.min("split").alias("lo"), F.max("split").alias("hi")).select(group, (F.col("lo") != F.col("hi")).alias("leaks"))
    rows = part.join(annotations.select(key, F.col("text").alias("annotated"), "entities"), key, "left").join(leaks, group, "left")
    error = F.when(F.col("annotated").isNull(), "no annotation: ").when(F.col("annotated") != F.col("text"), "another text: ").when(F.col("leaks"), "group in two splits: ")
    stop = F.raise_error(F.concat(error, F.col(key).cast("string"))).cast("boolean")
    return rows.where(F.when(error.isNull(), True).otherwise(stop)).select(*split.columns, "entities")


def cross_type_pairs(entities: DataFrame, confusions: tuple[tuple[str, str], ...], key: str = "doc_id") -> DataFrame:
    """For each pair of types that are confused, the i-th entity of one with the i-th of the other in a document, in
    the order of ``i``: key, source_type, negative_type, source_start, negative_start."""
    rank = F.row_number().over(Window.partitionBy(key, "type").orderBy("i"))
    e = entities.select(key, "type", "start", "i").withColumn("n", rank)
    pairs = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in confusions)))
    left = e.select(key, "n", F.col("start").alias("source_start"), F.col("type").alias("source_type"), pairs.alias("c")).where("source_type = c.a")
    right = e.select(key, "n", F.col("start").alias("negative_start"), F.col("type").alias("negative_type"))
    joined = left.select(key, "n", "source_start", "source_type", F.col("c.b").alias("negative_type")).join(right, [key, "n", "negative_type"])
    return joined.select(key, "source_type", "negative_type", "source_start", "negative_start")
