"""Span kernels (T01-T34, F01-F16) on their defining cases."""

from __future__ import annotations

import pytest

from spanloom.functions import kernels as K


def test_t01_boundary_maps():
    assert K.views("cafe\u0301")["nfc"].raw(3, 4) == (3, 5)
    assert K.views("\u0130")["lower"] == K.View("i\u0307", (0, 1, 1))
    assert K.views("TIẾNG Việt Đ")["accentless"].text == "tieng viet d"


def test_t03_t04_collapse():
    v = K.views("  a   b  ")["collapsed"]
    assert v.text == " a b "
    assert [v.raw(0, 1), v.raw(2, 3), v.raw(4, 5)] == [(0, 2), (3, 6), (7, 9)]
    with pytest.raises(ValueError):
        v.raw(0, 99)


def test_t06_t07_t08_structure():
    text = "Thuốc trước nhập viện:\namlodipine 5 mg\nmetformin 500 mg\n\nKết luận\nổn"
    st = K.Structure.of(text)
    assert [u.label for u in st.sections] == ["medication_history", "conclusion"]
    assert [u.label for u in st.list_items] == ["medication_lines"] * 2
    assert K.lines("a\r\nb\rc\nd") == [(0, 1), (3, 4), (5, 6), (7, 8)]


def test_t09_sentences():
    assert len(K.sentences("BS. kê amlodipine 5.5 mg q6h:prn. Nhiệt độ 37.5 C.")) == 2


def test_t10_clauses():
    text = "Không sốt nhưng ho nhiều"
    found = K.clauses(text, K.sentences(text))
    assert [text[c.start : c.end] for c in found] == ["Không sốt ", "nhưng ho nhiều"] and found[1].label == "nhưng"


def test_t11_medications():
    text = "Dùng clonazepam 0.5 mg po qam:prn."
    ((a, b, kinds),) = K.medications(text, ["clonazepam"])
    assert text[a:b] == "clonazepam 0.5 mg po qam:prn" and kinds == ("frequency", "route", "strength")
    text = "amoxicillin + clavulanate 875 mg po bid; clonazepam 0.5 mg, clonazepam 1 mg"
    found = K.medications(text, ["amoxicillin", "clavulanate", "clonazepam"])
    assert len(found) == 3 and text[found[0][0] : found[0][1]] == "amoxicillin + clavulanate 875 mg po bid"
    text = "aspirin\n81 mg po bid"
    assert [text[a:b] for a, b, _ in K.medications(text, ["aspirin"])] == ["aspirin"]


def test_t12_t13_laboratory():
    text = "Na 140 mmol/L; K 4,2 mmol/L\nGlucose 5.4 mmol/L (3.9-5.6)"
    names, results = K.laboratory(text, ["Na", "K", "Glucose"])
    assert [text[a:b] for a, b in names] == ["Na", "K", "Glucose"]
    assert [(text[a:b], i) for a, b, i in results] == [("140 mmol/L", 0), ("4,2 mmol/L", 1), ("5.4 mmol/L", 2)]
    assert [("Glucose: 5.4 mmol/L H"[a:b]) for a, b, _ in K.laboratory("Glucose: 5.4 mmol/L H", ["Glucose"])[1]] == ["5.4 mmol/L H"]


def test_t20_grounding():
    assert K.ground("ho, rồi ho", "ho", (8, 10)) == ("exact_raw", (8, 10), 1.0)
    assert K.ground("ho, rồi ho", "ho") == ("exact_raw", None, 0.0)
    assert K.ground("ho, rồi ho", "ho", occupied=[(0, 2)]) == ("exact_raw", (8, 10), 0.8)
    assert K.ground("HO nhiều", "ho") == ("exact_view", (0, 2), 0.75)
    assert K.ground("ho nhiều", "HO") == ("case_insensitive", (0, 2), 0.7)
    assert K.ground("viêm - phổi nặng", "VIÊM phổi", (3, 9)) == ("token_aligned", (0, 11), pytest.approx(0.62))
    assert K.ground("x", "ho") == K.ground("x", "") == ("none", None, 0.0)


def test_t21_t22_slots():
    from spanloom.functions import slots

    text = "Clonazepam 0,5-1 mg SR PO bid khi sốt"
    p = slots.parse_medication(text)
    got = {n: (text[s.start : s.end], s.value) for n, s in p.slots.items() if n != "components"}
    assert got == {
        "ingredient": ("Clonazepam", "clonazepam"), "strength_value": ("0,5", "0.5"), "strength_unit": ("mg", "mg"), "strength_range": ("0,5-1", "0.5-1"), "route": ("PO", "oral"),
        "release": ("SR", "sr"), "frequency": ("bid", "bid"), "prn": ("khi sốt", "prn"),
    }
    assert p.confidence == 1.0 and slots.parse_medication("x").confidence == 0.167
    both = slots.parse_medication("amoxicillin + clavulanate 875 mg")
    assert [s.value for s in both.slots["components"]] == ["amoxicillin", "clavulanate"] and both.evidence == ["ingredient", "strength", "combination"]
    text = "Glucose: ≥ 5,6 mmol/L (3.9 – 5,6) H"
    p = slots.parse_laboratory(text)
    assert {n: s.value for n, s in p.slots.items()} == {"test": "glucose", "result": "5.6", "comparator": ">=", "unit": "mmol/l", "reference": "3.9-5.6", "flag": "high"} and p.confidence == 1.0
    assert all(0 <= s.start < s.end <= len(text) for s in p.slots.values())
    assert {n: s.value for n, s in slots.parse_laboratory("HBsAg dương tính").slots.items()} == {"test": "hbsag", "result": "positive"}
    assert [slots.ingredient(m) for m in ("aspirin 81 mg", "500 mg", "PO bid", "")] == ["aspirin", "", "", ""]


def test_t24_directions_and_blockers():
    text = "sốt, ho: không thấy; đau nhưng mệt âm tính"
    st = K.Structure(text)
    back = (K.Cue("isNegated", "không thấy", ("document",), False, "backward"), K.Cue("isNegated", "âm tính", ("document",), True, "bidirectional", (";",)))
    at = lambda w: K.labels_of(K.assertions(text, text.index(w), text.index(w) + len(w), st, back))
    assert [at(w) for w in ("sốt", "ho", "đau", "mệt")] == [["isNegated"], ["isNegated"], [], ["isNegated"]]


def test_t27_current_medication_inherits_nothing():
    text = "Thuốc trước nhập viện:\n- aspirin\n- current medications: metformin"
    st = K.Structure.of(text)
    at = lambda w: K.labels_of(K.assertions(text, text.index(w), text.index(w) + len(w), st))
    assert at("aspirin") == ["isHistorical"] and at("metformin") == []


def test_t33_fuzzy_windows_equal_all_windows():
    import random

    rng = random.Random(3)
    for _ in range(200):
        text, part = ("".join(rng.choice("abcd") for _ in range(n)) for n in (rng.randint(0, 25), rng.randint(0, 8)))
        least = rng.choice((0.5, 0.75, 0.85))
        windows = [(1 - K.levenshtein(text[i : i + len(part)], part) / len(part), -i) for i in range(len(text) - len(part) + 1)] if part else []
        best = max(windows, default=(0, 0))
        assert K.fuzzy_find(text, part, least) == ((-best[1], -best[1] + len(part), best[0]) if windows and best[0] >= least else None)
    assert K.relocate_all("ho ho", ["ho", "x"]) == [[(0, 2), (3, 5)], []]


def labels(text, part, nth=0):
    at = K.occurrences(text, part)[nth]
    return K.labels_of(K.assertions(text, at, at + len(part), K.Structure.of(text)))


def test_t23_t28_assertions():
    text = "không sốt nhưng ho"
    assert labels(text, "sốt") == ["isNegated"] and labels(text, "ho") == []
    assert labels("{{không ho}}; bệnh nhân ho", "ho", 1) == []
    text = "- tiền sử\n  - tăng huyết áp\n- ho"
    assert labels(text, "tăng huyết áp") == ["isHistorical"] and labels(text, "ho") == []
    text = "Past medical history:\n- asthma\n- thuốc hiện tại: metformin"
    assert labels(text, "asthma") == ["isHistorical"] and labels(text, "metformin") == []


def test_t29_t30_bio():
    offsets = [(0, 0), (0, 2), (3, 5), (6, 8)]
    tags = K.bio_encode(offsets, [(0, 5, "S")], special=[0])
    assert tags == [None, "B-S", "I-S", "O"]
    assert K.bio_decode(tags[1:], offsets[1:], [1.0, 3.0, 0.0]) == [(0, 5, "S", 2.0)]
    with pytest.raises(ValueError):
        K.bio_encode(offsets, [(1, 5, "S")])


def test_t32_t33_t34_search():
    assert K.occurrences("aaaa", "aa") == [0, 1, 2]
    assert K.fuzzy_find("xx metoprolal yy", "metoprolol")[:2] == (3, 13)
    assert K.relocate("ho và ho.", ["ho", "ho.", "ho"]) == [(0, 2), (6, 9), None]


def test_f_scalars():
    assert K.alias_key("  ĐAU\u00a0 Đầu ") == "đau đầu" and K.accentless("Đau-đầu!") == "dau dau"
    assert K.canonical_json({"b": 1, "a": "é"}) == '{"a":"é","b":1}'
    assert K.proposal_id({"a": 1}).startswith("proposal-") and len(K.proposal_id({})) == 33
    assert abs(sum(x * x for x in K.hash_embedding("x", 8)) - 1) < 1e-9


def test_t01_views_of_plain_characters_equal_the_rewriting_of_each(monkeypatch):
    texts = ["", "Plain  Text\n\n x ", "caf\u00e9 \u0110a  \u0130 \u03a3\u03a3", "cafe\u0301  X", "a\u2003 \u00a0b\u0958", " \t"]
    calls, slow = [], K.rewrite
    monkeypatch.setattr(K, "rewrite", lambda v, unit, change: calls.append(v.text) or slow(v, unit, change))
    for text in texts:
        raw = K.raw_view(text)
        nfc = slow(raw, K._clusters(text), lambda u: K.unicodedata.normalize("NFC", u))
        lower = slow(nfc, ".", str.lower)
        bare = slow(lower, K._clusters(lower.text), K._strip)
        want = {"raw": raw, "nfc": nfc, "lower": lower, "accentless": bare, "collapsed": slow(bare, r"\s+|\S", lambda u: " " if u.isspace() else u)}
        assert K.views(text) == want
    # Nothing is matched character by character where characters stay single.
    assert not {"", texts[1], " \t"} & set(calls)
