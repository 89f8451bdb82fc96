"""Scalar text functions as Column expressions (JVM side)."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A token: letters, digits and underscores of any script.
TOKEN = r"[\p{L}\p{N}_]+"
#: Surface patterns of personal data.
#: The five patterns of A42, with \b, \d and \s of all scripts.
WARNINGS = {
    "phone_like": r"(?U)(?<!\d)(?:\+84|0)(?:\d[\s.-]?){8,10}\d(?!\d)",
    "id_like": r"(?U)(?<!\d)\d{9}(?:\d{3})?(?!\d)",
    "email": r"(?U)\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b",
    "date_of_birth_like": r"(?U)\b(?:0?[1-9]|[12]\d|3[01])[/-](?:0?[1-9]|1[0-2])[/-](?:19\d{2}|20\d{2})\b",
    "address_like": r"(?iU)\b(?:số nhà|đường|phường|quận|hẻm|ngõ|ấp|xã|thôn)\b",
}
PRIVACY = {
    "phone": r"(?:\+84|0)(?:3|5|7|8|9)\d{8}",
    "national_id": r"\b(?:\d{9}|\d{12})\b",
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "birth_date": r"\b\d{1,2}[/-]\d{1,2}[/-](?:19|20)\d{2}\b",
}
ABBREVIATION = "^[A-Z]{2,6}$"
PUNCTUATION = r"[^\p{L}\p{N}_\s]"


#: Routes, comparators and results with one name each.
ROUTES = {"po": "oral", "oral": "oral", "uống": "oral", "iv": "intravenous", "im": "intramuscular", "sc": "subcutaneous"}
COMPARATORS = {"≤": "<=", "≥": ">="}
QUALITATIVE = {"dương tính": "positive", "âm tính": "negative", "không phát hiện": "not_detected", "tăng": "increased", "giảm": "decreased", "cao": "high", "thấp": "low"}


def _named(value: Column, names: dict[str, str]) -> Column:
    table = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))
    return F.coalesce(F.try_element_at(table, value), value)


def feature_key(text: Column) -> Column:
    """lower-cased, white space of any kind as one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), r"(?U)\s+", " "))


def unit_key(text: Column) -> Column:
    """lower-cased, micro signs as u, ug as mcg, without spaces. (A micro sign folds to the Greek letter.)"""
    plain = F.replace(F.replace(F.lower(text), F.lit("\u00b5"), F.lit("\u03bc")), F.lit("\u03bc"), F.lit("u"))
    return F.replace(F.replace(plain, F.lit("ug"), F.lit("mcg")), F.lit(" "), F.lit(""))


def range_key(text: Column) -> Column:
    """decimal points, a hyphen without spaces."""
    return F.regexp_replace(F.replace(text, F.lit(","), F.lit(".")), r"(?U)\s*[-–]\s*", "-")


def route_key(text: Column) -> Column:
    return _named(feature_key(text), ROUTES)


def comparator_key(text: Column) -> Column:
    return _named(text, COMPARATORS)


def qualitative_key(text: Column) -> Column:
    return _named(feature_key(text), QUALITATIVE)


def association_tier(score: Column) -> Column:
    """F17."""
    return F.when(score >= 0.85, "high").when(score >= 0.70, "medium").otherwise("low")


def _bare_letters() -> dict[str, str]:
    """Lower-case letters with marks to the same without, by Unicode decomposition (Latin blocks), and đ to d."""
    out = {"đ": "d"}
    for code in (*range(0xE0, 0x250), *range(0x1E00, 0x1F00)):
        c = chr(code)
        bare = "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn")
        if bare != c and len(bare) == 1 and c == c.lower():
            out[c] = bare
    return out


def accentless(text: Column) -> Column:
    """Lower-cased letters without marks, whatever is no letter or digit as one space, trimmed."""
    bare = _bare_letters()
    plain = F.translate(F.replace(F.lower(text), F.lit("ß"), F.lit("ss")), "".join(bare), "".join(bare.values()))
    return F.trim(F.regexp_replace(F.regexp_replace(plain, r"\p{Mn}+", ""), r"[^\p{L}\p{N}]+", " "))


def context_window(text: Column, start: Column, end: Column, size: int = 50) -> Column:
    """The span with ``size`` characters on both sides."""
    first = F.greatest(start - size, F.lit(0))
    return F.substring(text, (first + 1).cast("int"), (end + size - first).cast("int"))


def drug_text(name: Column, strength: Column, form: Column, route: Column, frequency: Column) -> Column:
    """the parts that are there, in this order, with spaces between."""
    return F.concat_ws(" ", *(F.when(F.length(F.trim(c)) > 0, F.trim(c)) for c in (name, strength, form, route, frequency)))


def lab_text(name: Column, value: Column, unit: Column) -> Column:
    """"name: value unit"."""
    return F.concat_ws(" ", F.concat(name, F.lit(":")), value, F.when(F.length(F.trim(unit)) > 0, unit))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def collapsed(text: Column) -> Column:
    """Lower-cased, white space runs as one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), r"[ \t\r\n]+", " "))


def newline_style(text: Column) -> Column:
    """none, lf, crlf, cr or mixed, by length arithmetic."""
    crlf = F.length(text) - F.length(F.replace(text, F.lit("\r\n"), F.lit("\n")))
    cr = F.length(text) - F.length(F.replace(text, F.lit("\r"), F.lit(""))) - crlf
    lf = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) - crlf
    kinds = (crlf > 0).cast("int") + (cr > 0).cast("int") + (lf > 0).cast("int")
    return F.when(kinds > 1, "mixed").when(crlf > 0, "crlf").when(cr > 0, "cr").when(lf > 0, "lf").otherwise("none")


def let(value: Column, f) -> Column:
    """f(value), with value evaluated once: lambda bodies would evaluate an expression anew for each element."""
    return F.element_at(F.transform(F.array(value), f), 1)


def ngrams(items: Column, n: int) -> Column:
    """Runs of n items, joined by a space; none where there are fewer."""

    def runs(a: Column) -> Column:
        count = F.size(a) - (n - 1)
        found = F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: F.array_join(F.slice(a, i, F.lit(n)), " "))
        return F.when(count > 0, found).otherwise(F.array().cast("array<string>"))

    return let(items, runs)


def char_ngrams(text: Column, n: int) -> Column:
    """The set of runs of n characters; the whole text if it is shorter."""

    def runs(t: Column) -> Column:
        count = F.length(t) - (n - 1)
        found = F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: F.substring(t, i, F.lit(n)))
        return F.when(count > 0, F.array_distinct(found)).otherwise(F.array(t))

    return let(text, runs)


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets; 1 where both are empty."""
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(either == 0, 1.0).otherwise(both / F.greatest(either, F.lit(1)))


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length; 1 where both are empty."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / F.greatest(longest, F.lit(1)))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.least(x, F.lit(700.0)), F.lit(-700.0))))


def logit(p: Column, least: float = 1e-6) -> Column:
    p = F.greatest(F.least(p, F.lit(1 - least)), F.lit(least))
    return F.log(p / (1 - p))


def log_loss(p: Column, y: Column, least: float = 1e-12) -> Column:
    p = F.greatest(F.least(p, F.lit(1 - least)), F.lit(least))
    return -(y * F.log(p) + (1 - y) * F.log(1 - p))


def scenario_id(source: Column, note: Column) -> Column:
    """The first 12 hex digits of sha1(source::note)."""
    return F.substring(F.sha1(F.encode(F.concat_ws("::", source, note), "utf-8")), 1, 12)


def decimal_point(text: Column) -> Column:
    return F.regexp_replace(text, r"(?<=\d),(?=\d)", ".")


def fenced_json(text: Column) -> Column:
    """JSON in a model's answer: a fenced block, else what the outermost braces hold, else null."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)\s*```", 1)
    braces = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.when(fenced != "", fenced).when(braces != "", braces)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
