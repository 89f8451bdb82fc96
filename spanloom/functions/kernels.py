"""Span kernels in plain Python, for Arrow batches: views, structure, mentions, slots, cues, grounding, BIO tags.

All positions are half-open code-point offsets into the raw text. Nothing here imports Spark.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import cache
from typing import NamedTuple

# ---------------------------------------------------------------- fixed values
#: Heading aliases of sections.
SECTIONS = {
    "medical_history": ("tiền sử bệnh", "past medical history"),
    "family_history": ("tiền sử gia đình", "family history"),
    "medication_history": ("thuốc trước nhập viện", "danh sách thuốc trước nhập viện", "medications", "current medications", "medication history", "home medications"),
    "current_exam": ("khám hiện tại", "physical examination", "history of present illness"),
    "laboratory": ("cận lâm sàng", "laboratory results", "lab results"),
    "diagnosis": ("chẩn đoán", "diagnosis", "assessment"),
    "conclusion": ("kết luận", "conclusion"),
    "plan": ("kế hoạch", "plan"),
}
#: Words whose full stop ends no sentence.
ABBREVIATIONS = frozenset("bs dr mr mrs ms vs p ts mg ml mcg hr min eg ie".split())
#: Words that begin a new clause.
CLAUSE_CUES = ("nhưng", "tuy nhiên", "còn", "but", "however", "và", "hoặc", "and", "or")
class Cue(NamedTuple):
    """Words that assert a label: the levels that their scope may take, whether contrast words end it, the side on which
    they work (forward, backward or bidirectional), and further patterns that end it."""

    label: str
    words: str
    levels: tuple[str, ...]
    ends: bool
    direction: str = "forward"
    blockers: tuple[str, ...] = ()


_LOCAL = ("clause", "sentence", "list_item", "section")
#: Fixed values.
CUES = (
    Cue("isNegated", "không có", _LOCAL, True),
    Cue("isNegated", "chưa ghi nhận", _LOCAL, True),
    Cue("isNegated", "phủ nhận|không", _LOCAL, True),
    Cue("isHistorical", "tiền sử", ("list_item", "section"), False),
    Cue("isHistorical", "trước nhập viện", ("list_item", "section"), False),
    Cue("isFamily", "mẹ|bố|cha|anh|chị|em", _LOCAL, True),
)
SCOPE_ENDS = r"(?<!\w)(?:nhưng|tuy nhiên|however|but|ghi nhận)(?!\w)"
#: Words of a list item that is about medication taken now.
CURRENT = r"(?<!\w)(?:thuốc hiện tại|current medications?)(?!\w)"
BASE_SCORE = {"clause": 0.96, "sentence": 0.91, "list_item": 0.86, "section": 0.80, "document": 0.70}


# ---------------------------------------------------------------- text
def fold_space(text: str) -> str:
    return " ".join(text.split())


def alias_key(text: str) -> str:
    return fold_space(unicodedata.normalize("NFC", text).casefold())


def accentless(text: str) -> str:
    """Marks go, đ becomes d, folded, whatever is not alphanumeric becomes a space."""
    bare = "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) != "Mn").replace("đ", "d").replace("Đ", "D")
    return fold_space("".join(c if c.isalnum() else " " for c in bare.casefold()))


def canonical_json(value: object) -> str:
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def proposal_id(value: object) -> str:
    return "proposal-" + hashlib.sha256(canonical_json(value).encode()).hexdigest()[:24]


def hash_embedding(text: str, dims: int) -> list[float]:
    raw = [int.from_bytes(hashlib.sha256(f"{i}:{text}".encode()).digest()[:8], "big") / (2**63) - 1 for i in range(dims)]
    norm = sum(x * x for x in raw) ** 0.5 or 1.0
    return [x / norm for x in raw]


def at_boundary(text: str, start: int, end: int) -> bool:
    return not (start and text[start - 1].isalnum()) and not (end < len(text) and text[end].isalnum())


# ---------------------------------------------------------------- views
@dataclass(frozen=True)
class View:
    """A rewritten text with, for each of its boundaries, the raw boundary."""

    text: str
    bounds: tuple[int, ...]

    def raw(self, start: int, end: int) -> tuple[int, int]:
        if not 0 <= start <= end < len(self.bounds):
            raise ValueError("span outside of the view")
        return self.bounds[start], self.bounds[end]


def raw_view(text: str) -> View:
    return View(text, tuple(range(len(text) + 1)))


def rewrite(view: View, unit: str, change: Callable[[str], str]) -> View:
    """Each match of ``unit`` becomes change(match); its characters end where the match ends in the raw text. A unit
    that vanishes moves the last boundary on."""
    out, bounds = [], [view.bounds[0]]
    for m in re.finditer(unit, view.text, re.S):
        new = change(m[0])
        out.append(new)
        if new:
            bounds += [view.bounds[m.end()]] * len(new)
        else:
            bounds[-1] = view.bounds[m.end()]
    return View("".join(out), tuple(bounds))


def _clusters(text: str) -> str:
    marks = "".join(sorted({c for c in text if unicodedata.combining(c)}))
    return f".[{re.escape(marks)}]*" if marks else "."


class _Each(dict):
    """A change of single characters for str.translate, kept for those seen before; ``uneven`` are those whose result is
    not one character."""

    def __init__(self, change: Callable[[str], str]):
        super().__init__()
        self.change, self.uneven = change, set()

    def __missing__(self, code: int) -> str:
        c = chr(code)
        new = self[code] = self.change(c)
        if len(new) != 1:
            self.uneven.add(c)
        return new


def _strip(unit: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", unit) if unicodedata.category(c)[0] != "M").replace("đ", "d").replace("Đ", "D")


_NFC, _LOWER, _BARE = _Each(lambda c: unicodedata.normalize("NFC", c)), _Each(str.lower), _Each(_strip)


def _each(view: View, unit: str, table: _Each) -> View:
    """``rewrite``; where each character is a unit that stays one character, the boundaries are the same."""
    chars = set(view.text)
    new = view.text.translate(table)
    if (unit == "." or not any(map(unicodedata.combining, chars))) and chars.isdisjoint(table.uneven):
        return View(new, view.bounds)
    return rewrite(view, unit, table.change)


def _collapse(view: View) -> View:
    """Runs of white space as one space, whose boundary is the run's end."""
    out, at = [view.bounds[0]], 0
    for m in re.finditer(r"\s{2,}", view.text):
        out += view.bounds[at + 1 : m.start() + 1]
        out.append(view.bounds[m.end()])
        at = m.end()
    return View(re.sub(r"\s+", " ", view.text), tuple(out) + tuple(view.bounds[at + 1 :]))


def views(text: str) -> dict[str, View]:
    raw = raw_view(text)
    nfc = _each(raw, _clusters(text), _NFC)
    lower = _each(nfc, ".", _LOWER)
    bare = _each(lower, _clusters(lower.text), _BARE)
    return {"raw": raw, "nfc": nfc, "lower": lower, "accentless": bare, "collapsed": _collapse(bare)}


# ---------------------------------------------------------------- structure
@dataclass(frozen=True)
class Unit:
    kind: str
    start: int
    end: int
    label: str = ""
    heading_end: int = -1
    indent: int = 0


def lines(text: str) -> list[tuple[int, int]]:
    """Ranges without their line ends: \\n, \\r or \\r\\n."""
    out, at = [], 0
    for m in re.finditer(r"\r\n|\r|\n", text):
        out.append((at, m.start()))
        at = m.end()
    return [*out, (at, len(text))]


def trimmed(text: str, start: int, end: int) -> tuple[int, int]:
    while start < end and text[start].isspace():
        start += 1
    while end > start and text[end - 1].isspace():
        end -= 1
    return start, end


def _aliases(headings: dict[str, tuple[str, ...]]) -> dict[str, str]:
    return {alias_key(a): label for label, aliases in headings.items() for a in aliases}


@cache
def _names() -> dict[str, str]:
    return _aliases(SECTIONS)


def sections(text: str, headings: dict[str, tuple[str, ...]] = SECTIONS) -> list[Unit]:
    """A heading line equals an alias, but for a number before it and a colon after it; its section runs to the next."""
    names = _names() if headings is SECTIONS else _aliases(headings)
    heads = []
    for a, b in lines(text):
        bare = re.sub(r"^\s*(?:\d+(?:\.\d+)*[.)]?|[ivx]+[.)])\s+", "", text[a:b], flags=re.I)
        label = names.get(alias_key(bare.strip().removesuffix(":").strip()))
        if label:
            heads.append((a, b, label))
    ends = [h[0] for h in heads[1:]] + [len(text)]
    return [Unit("section", a, end, label, b) for (a, b, label), end in zip(heads, ends)]


def list_items(text: str, found: list[Unit]) -> list[Unit]:
    """Lines with a bullet or number; and lines of a medication section, from two in a row on."""
    out, run = [], []

    def close() -> None:
        if len(run) >= 2:
            out.extend(run)
        run.clear()

    for a, b in lines(text):
        s, e = trimmed(text, a, b)
        section = next((u for u in found if u.start <= a < u.end), None)
        if re.match(r"(?:[-*•+]|\d+[.)])\s+\S", text[s:e]):
            close()
            out.append(Unit("list_item", s, e, "bullet" if not text[s].isdigit() else "numbered", indent=s - a))
        elif section and section.label == "medication_history" and s >= section.heading_end and s < e:
            run.append(Unit("list_item", s, e, "medication_lines", indent=s - a))
        else:
            close()
    close()
    return sorted(out, key=lambda u: u.start)


def sentences(text: str, abbreviations: frozenset[str] = ABBREVIATIONS) -> list[Unit]:
    """Cut after ! ? ; and at line ends, and after a full stop unless it is a decimal point or ends an abbreviation."""
    out, at = [], 0
    for m in re.finditer(r"[!?;]+|\.|\r\n|\r|\n", text):
        if m[0] == ".":
            before = re.search(r"\w+$", text[at : m.start()])
            digits = m.start() and text[m.start() - 1].isdigit() and text[m.end() : m.end() + 1].isdigit()
            if digits or (before and before[0].casefold() in abbreviations):
                continue
        s, e = trimmed(text, at, m.end())
        if s < e:
            out.append(Unit("sentence", s, e))
        at = m.end()
    s, e = trimmed(text, at, len(text))
    return [*out, Unit("sentence", s, e)] if s < e else out


def clauses(text: str, found: list[Unit], cues: Iterable[str] = CLAUSE_CUES) -> list[Unit]:
    rx = re.compile(rf"(?i)(?<!\w)(?:{'|'.join(map(re.escape, sorted(cues, key=len, reverse=True)))})(?!\w)")
    out = []
    for u in found:
        cuts = [u.start, *(m.start() for m in rx.finditer(text, u.start, u.end) if m.start() > u.start), u.end]
        out += [Unit("clause", a, b, (m := rx.match(text, a)) and m[0].casefold() or "") for a, b in zip(cuts, cuts[1:])]
    return out


@dataclass
class Structure:
    text: str
    sections: list[Unit] = field(default_factory=list)
    list_items: list[Unit] = field(default_factory=list)
    sentences: list[Unit] = field(default_factory=list)
    clauses: list[Unit] = field(default_factory=list)

    @classmethod
    def of(cls, text: str) -> Structure:
        sec, sen = sections(text), sentences(text)
        return cls(text, sec, list_items(text, sec), sen, clauses(text, sen))

    def units(self) -> list[Unit]:
        return [*self.sections, *self.list_items, *self.sentences, *self.clauses]

    def at(self, place: int, levels: tuple[str, ...]) -> Unit:
        by = {"clause": self.clauses, "sentence": self.sentences, "list_item": self.list_items, "section": self.sections}
        for level in _LOCAL:
            if level in levels:
                for u in by[level]:
                    if u.start <= place < u.end:
                        return u
        return Unit("document", 0, len(self.text))


# ---------------------------------------------------------------- mentions
def occurrences(text: str, part: str) -> list[int]:
    """All starts, overlapping ones too."""
    out, at = [], text.find(part) if part else -1
    while at >= 0:
        out.append(at)
        at = text.find(part, at + 1)
    return out


def alias_spans(text: str, aliases: Iterable[str], greedy: bool = True, blocked: Iterable[tuple[int, int]] = ()) -> list[tuple[int, int]]:
    """Case-insensitive matches between non-alphanumeric neighbours, longest alias first; greedy ones do not overlap."""
    taken, out = list(blocked), []
    for alias in sorted(set(aliases), key=lambda a: (-len(a), a)):
        for m in re.finditer(f"(?={re.escape(alias)})", text, re.I):
            span = (m.start(), m.start() + len(alias))
            if at_boundary(text, *span) and not (greedy and any(a < span[1] and span[0] < b for a, b in taken)):
                out.append(span)
                if greedy:
                    taken.append(span)
    return sorted(set(out))


#: What a proposed medication mention may go on with, in the order in which it is tried.
PROPOSED_PARTS = (
    ("strength", r"\d+(?:[.,]\d+)?(?:\s*[/\-]\s*\d+(?:[.,]\d+)?)?\s*-?\s*(?:mcg|mg|g|mL|ml|%)"),
    ("form", r"(?:enteric-coated\s+tablet|tablet|tab|capsule|cap|viên|ống|gói|syrup|solution|suspension|cream|gel|drops?)\b"),
    ("route", r"(?:po|iv|im|sc|oral|uống|tiêm|truyền\s+tĩnh\s+mạch)\b"),
    ("frequency", r"(?:qd|bid|tid|qhs|qam|q\d+h)(?::prn)?\b|prn\b|daily\b|khi\s+sốt\b|mỗi\s+(?:\d+\s+giờ|ngày)\b|\d+\s*(?:lần|x)\s*/\s*(?:ngày|day)\b"),
    ("release", r"(?:XR|XL|SR|CR|ER)\b"),
)
#: Proposed laboratory results.
PROPOSED_UNIT = r"(?:mmol/L|mg/dL|g/L|G/L|U/L|IU/L|mIU/L|ng/mL|pg/mL|%|10\^?\d+/L)"
PROPOSED_NUMBER = r"(?:(?:[<>≤≥]|<=|>=)\s*)?\d+(?:[.,]\d+)?"
PROPOSED_WORDS = r"\b(?:tăng|giảm|cao|thấp|dương\s+tính|âm\s+tính|không\s+phát\s+hiện)\b"

_PARTS = [(kind, re.compile(rf"[ \t]*(?:{rx})", re.I)) for kind, rx in PROPOSED_PARTS]
_JOINT = re.compile(r"\s*(?:\+|/|và|and)\s*", re.I)
_RESULT = re.compile(rf"(?<![\w.])(?:{PROPOSED_NUMBER}(?:\s*[-–]\s*{PROPOSED_NUMBER})?)(?:\s*{PROPOSED_UNIT})?(?:\s+(?:H|L))?(?!\w)|{PROPOSED_WORDS}", re.I)


def medications(text: str, aliases: Iterable[str], found: list[Unit] = ()) -> list[tuple[int, int, tuple[str, ...]]]:
    """Alias matches, longest first, each extended to the right over strength, form, route, frequency and release, and
    over combination signs to further names, inside its list item. One that overlaps an earlier one is part of it."""
    names = alias_spans(text, aliases, greedy=False)
    ends: dict[int, int] = {}
    for a, b in names:
        ends[a] = max(b, ends.get(a, 0))
    out: list[tuple[int, int, tuple[str, ...]]] = []
    for start, end in sorted(names, key=lambda s: (s[0] - s[1], s[0])):
        limit = next((u.end for u in found if u.start <= start < u.end), len(text))
        kinds: set[str] = set()
        while end < limit:
            kind, part = next(((k, m) for k, rx in _PARTS if (m := rx.match(text, end))), ("", None))
            if part:
                if part.end() > limit:
                    break
                end = part.end()
                kinds.add(kind)
                continue
            joint = _JOINT.match(text, end)
            further = ends.get(joint.end()) if joint else None
            if further is None or further > limit:
                break
            end = further
        if not any(a < end and start < b for a, b, _ in out):
            out.append((start, end, tuple(sorted(kinds))))
    return sorted(out)


def laboratory(text: str, tests: Iterable[str], structure: Structure | None = None) -> tuple[list[tuple[int, int]], list[tuple[int, int, int]]]:
    """Test names, and results with the index of their test: the closest one (then the later) in the same list item, else
    the same clause, else line. A number that fills a pair of brackets is a reference range and none."""
    names = alias_spans(text, tests, greedy=False)
    results = []
    for m in _RESULT.finditer(text):
        start, end = m.span()
        if any(a < end and start < b for a, b in names) or (text[start - 1 : start] == "(" and text[end : end + 1] == ")"):
            continue
        units = [*structure.list_items, *structure.clauses] if structure else []
        scope = next(((u.start, u.end) for u in units if u.start <= start and end <= u.end), None)
        if scope is None:
            stop = text.find("\n", end)
            scope = text.rfind("\n", 0, start) + 1, stop if stop >= 0 else len(text)
        near = [(abs(start - b), -a, i) for i, (a, b) in enumerate(names) if scope[0] <= a and b <= scope[1]]
        if near:
            results.append((start, end, min(near)[2]))
    return names, results


def symptom_prior(kinds: tuple[str, ...], text: str, triggered: bool, symptom_words: str) -> dict[str, float]:
    """Shares of symptom and diagnosis: one supported kind leads, else a trigger, else a symptom's word."""
    if len(kinds) == 1:
        return {kinds[0]: 0.9, "diagnosis" if kinds[0] == "symptom" else "symptom": 0.1}
    if triggered:
        return {"diagnosis": 0.75, "symptom": 0.25}
    if re.search(symptom_words, text, re.I):
        return {"symptom": 0.75, "diagnosis": 0.25}
    return {"diagnosis": 0.5, "symptom": 0.5}


def levenshtein(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        left, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            left, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, left + (x != y))
    return row[-1]


def fuzzy_find(text: str, part: str, least: float = 0.85) -> tuple[int, int, float] | None:
    """The window of the part's length that is most like it; the first of equals.

    A window lacks at least as many edits as letters of the part that it does not have (counted as it slides), so most
    windows are never compared."""
    n, best = len(part), None
    if not n or len(text) < n:
        return None
    # Letters of the part, less those of the window: what is positive is missing.
    gap = Counter(part)
    gap.subtract(text[:n])
    missing = sum(v for v in gap.values() if v > 0)
    for at in range(len(text) - n + 1):
        if at:
            gone, new = text[at - 1], text[at + n - 1]
            gap[gone] += 1
            missing += gap[gone] > 0
            missing -= gap[new] > 0
            gap[new] -= 1
        bar = least if best is None else best[2]
        if 1 - missing / n >= bar:
            s = 1 - levenshtein(text[at : at + n], part) / n
            if s >= least and (best is None or s > best[2]):
                best = (at, at + n, s)
    return best


def relocate_all(text: str, surfaces: list[str]) -> list[list[tuple[int, int]]]:
    """Every occurrence of each surface."""
    return [[(a, a + len(s)) for a in occurrences(text, s)] for s in surfaces]


def relocate(text: str, surfaces: list[str]) -> list[tuple[int, int] | None]:
    """Each surface's first occurrence that overlaps none taken before; else that of the surface without punctuation at
    its ends."""
    taken: list[tuple[int, int]] = []
    out: list[tuple[int, int] | None] = []
    for s in surfaces:
        hit = None
        for form in dict.fromkeys((s, s.strip(" .,;:!?()[]\"'"))):
            hit = next(((a, a + len(form)) for a in occurrences(text, form) if not any(x < a + len(form) and a < y for x, y in taken)), None)
            if hit:
                taken.append(hit)
                break
        out.append(hit)
    return out


# ---------------------------------------------------------------- assertions
@dataclass(frozen=True)
class Assertion:
    label: str
    cue: tuple[int, int]
    scope: tuple[int, int]
    level: str
    score: float


def cue_matches(text: str, cues=CUES) -> list[tuple[Cue, int, int]]:
    """Cues outside of quotation marks and templates, in order."""
    shut = [m.span() for m in re.finditer(r'"[^"\r\n]*"|\{\{.*?\}\}', text, re.S)]
    out = []
    for cue in (Cue(*c) for c in cues):
        for m in re.finditer(rf"(?i)(?<!\w)(?:{cue.words})(?!\w)", text):
            if not any(a <= m.start() and m.end() <= b for a, b in shut):
                out.append((cue, m.start(), m.end()))
    return sorted(out, key=lambda c: c[1:])


def scope(text: str, cue: Cue, a: int, b: int, st: Structure) -> tuple[int, int, str]:
    """The narrowest unit that the cue may take, with the items nested in a list item, up to what ends it on the side
    (or sides) on which the cue works."""
    unit = st.at(a, cue.levels)
    start, stop = unit.start, unit.end
    if unit.kind == "list_item":
        stop = max([stop, *(u.end for u in _nested(unit, st))])
    ends = [re.compile(p, re.I) for p in (*([SCOPE_ENDS] if cue.ends else []), *cue.blockers)]
    if cue.direction != "backward":
        stop = min([stop, *(m.start() for rx in ends if (m := rx.search(text, b, stop)))])
    if cue.direction != "forward":
        start = max([start, *(m.end() for rx in ends for m in rx.finditer(text, start, a))])
    return start, stop, unit.kind


def assertions(text: str, start: int, end: int, structure: Structure | None = None, cues=CUES) -> list[Assertion]:
    """The cues whose scope holds a span on the side on which they work; a history section's items are
    historical, those of a family section concern the family. In a list item about current medication nothing inherits
    that it is historical."""
    st = structure or Structure(text)
    out = []
    for cue, a, b in cue_matches(text, cues):
        if any(u.start <= a and b <= u.heading_end for u in st.sections):
            continue
        first, stop, level = scope(text, cue, a, b, st)
        before, after = b <= start, end <= a
        fits = {"forward": before, "backward": after}.get(cue.direction, before or after)
        if fits and first <= start and end <= stop:
            gap = start - b if before else a - end
            fade = min(0.20, 0.20 * gap / max(1, stop - first))
            out.append(Assertion(cue.label, (a, b), (first, stop), level, max(0.50, round(BASE_SCORE[level] - fade, 3))))
    current = any(u.start <= start and end <= u.end and re.search(CURRENT, text[u.start : u.end], re.I) for u in st.list_items)
    for section in st.sections:
        label = {"medical_history": "isHistorical", "medication_history": "isHistorical", "family_history": "isFamily"}.get(section.label)
        if label and section.heading_end <= start and end <= section.end and not (current and label == "isHistorical"):
            out.append(Assertion(label, (section.start, section.heading_end), (section.start, section.end), "section", 0.80))
    return out


def _nested(item: Unit, st: Structure) -> list[Unit]:
    out = []
    for u in st.list_items:
        if u.start > item.start:
            if u.indent <= item.indent:
                break
            out.append(u)
    return out


def labels_of(found: list[Assertion], least: float = 0.5) -> list[str]:
    return sorted({a.label for a in found if a.score >= least})


# ---------------------------------------------------------------- grounding (T20) and BIO
#: What a way of finding a surface is worth.
GROUNDING = {"exact_raw": 0.8, "exact_view": 0.75, "case_insensitive": 0.7, "token_aligned": 0.65}


def found_by(text: str, surface: str) -> list[tuple[int, int, str]]:
    """Places of a surface by the first way that finds any: in the raw text, in any view of it, regardless of case, as a
    run of equal words."""
    needle = re.escape(surface)
    if hits := [(*m.span(), "exact_raw") for m in re.finditer(needle, text)]:
        return hits
    seen: dict[tuple[int, int], None] = {}
    for name, view in views(text).items():
        if name != "raw":
            seen |= {view.raw(*m.span()): None for m in re.finditer(needle, view.text)}
    if seen:
        return [(*s, "exact_view") for s in seen]
    if hits := [(*m.span(), "case_insensitive") for m in re.finditer(needle, text, re.I)]:
        return hits
    want, words = re.findall(r"\w+", surface.casefold()), list(re.finditer(r"\w+", text))
    folded = [w[0].casefold() for w in words]
    n = len(want)
    return [(words[i].start(), words[i + n - 1].end(), "token_aligned") for i in range(len(words) - n + 1) if folded[i : i + n] == want] if n else []


def ground(text: str, surface: str, expected: tuple[int, int] | None = None, occupied: list[tuple[int, int]] = (), order: int = 0) -> tuple[str, tuple[int, int] | None, float]:
    """(method, span, confidence) of the best free place: what the method is worth, more at the expected place, less
    the further away it is and the later the proposal. None where two places are equally good."""
    scored = []
    for a, b, method in found_by(text, surface) if surface else []:
        if any(a < y and x < b for x, y in occupied):
            continue
        score = GROUNDING[method]
        if expected is not None:
            score = min(1.0, score + 0.2) if (a, b) == tuple(expected) else max(0.0, score - min(abs(a - expected[0]), 20) / 100 - min(order, 10) / 1000)
        scored.append((-score, a, b, method))
    if not scored:
        return "none", None, 0.0
    scored.sort()
    if len(scored) > 1 and scored[0][0] == scored[1][0]:
        return scored[0][3], None, 0.0
    score, a, b, method = scored[0]
    return method, (a, b), -score


def bio_decode(tags: list[str], offsets: list[tuple[int, int]], logits: list[float]) -> list[tuple[int, int, str, float]]:
    """Spans (start, end, type, mean logit): B starts one; I continues its type, and starts one of another type."""
    out: list[list] = []
    open_ = False
    for tag, (a, b), z in zip(tags, offsets, logits):
        if tag == "O":
            open_ = False
        elif open_ and tag[0] == "I" and out[-1][2] == tag[2:]:
            out[-1][1] = b
            out[-1][3].append(z)
        else:
            out.append([a, b, tag[2:], [z]])
            open_ = True
    return [(a, b, t, sum(z) / len(z)) for a, b, t, z in out]


def bio_encode(offsets: list[tuple[int, int]], entities: list[tuple[int, int, str]], special: Iterable[int] = ()) -> list[str | None]:
    """A tag for each token (None for special ones). A token that lies partly in an entity, or in two, is an error."""
    special, out = set(special), []
    for i, (a, b) in enumerate(offsets):
        hits = [e for e in entities if e[0] < b and a < e[1]]
        if i in special:
            out.append(None)
        elif not hits:
            out.append("O")
        elif len(hits) > 1 or a < hits[0][0] or b > hits[0][1]:
            raise ValueError("token and entity do not align")
        else:
            first = not any(o[0] >= hits[0][0] and o[0] < a for j, o in enumerate(offsets[:i]) if j not in special)
            out.append(f"{'B' if first else 'I'}-{hits[0][2]}")
    return out
