"""Quality network, language centroids, mixing, media, licences: brute force, round trips, held-out accuracy, edge rows."""

from __future__ import annotations

import hashlib
import math
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.llm import byte_cnn, lang_centroids, media
from spanloom.llm.curriculum import curriculum, mix_rows, targets
from spanloom.llm.license_scan import NOTICES, PHRASES, license_report, license_scan

EDGE = [(1, None, "en", "a"), (2, "", "en", None), (3, " \n", None, "a"), (None, "some words here", "en", "b"), (4, "x" * 300_000, "en", "b"), (5, "same text", "en", "a"), (5, "same text", "en", "a"), (6, "café Été", "fr", None)]
SHAPE = "doc_id long, text string, lang string, source string"


@pytest.fixture
def edge(spark):
    return spark.createDataFrame([(*r, "clash", 1) for r in EDGE], SHAPE + ", score string, held_out int")


def test_network_learns_a_pattern(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows, labels = [], []
    for i in range(400):
        bad = i % 2
        rows.append((i, " ".join(word() + ("%%%" if bad else "") for _ in range(rng.randint(2, 150)))))
        labels.append((i, 1 - bad, None))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([*labels, (1000, None, 1)], "doc_id long, quality int, toxic int")
    net = byte_cnn.train(docs, marks)
    got = byte_cnn.quality_scores(docs, net).collect()
    held = [r for r in got if r.held_out]
    assert len(got) == 400 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert np.mean([r.predicted == 1 - r.doc_id % 2 for r in held]) > 0.95
    kept = {r.doc_id for r in byte_cnn.keep_quality(docs, net).collect()}
    assert kept == {r.doc_id for r in got if r.predicted}


def test_network_covers_the_whole_document():
    net = byte_cnn.Network(3)
    text = bytes(np.random.default_rng(0).integers(32, 127, 70_000, dtype=np.uint8))
    x = np.frombuffer(text, np.uint8).astype(np.int16)
    r = net.responses(x)
    want = 0.0
    for at in range(0, len(r), byte_cnn.STEP):
        part = r[at : at + byte_cnn.STEP]
        want += float(np.maximum(part.max(0) + net.c, 0) @ net.w) * len(part)
    assert abs(net.logit(text) - (want / len(r) + float(net.b[0]))) < 1e-3


def test_trained_network_equals_plain_loops(spark):
    """Scores of a trained network by the definition: filters at every place, the largest of each chunk, weighted mean."""
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(("good", "fine", "bad%%")) for _ in range(rng.choice((0, 1, 40, 300))))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    net = byte_cnn.train(docs, spark.createDataFrame([(i, int("%" not in t)) for i, t in rows], "doc_id long, quality int"))
    got = {r.doc_id: r for r in byte_cnn.quality_scores(docs, net).collect()}
    table, c, w, b = net.t.tolist(), net.c.tolist(), net.w.tolist(), float(net.b[0])
    for i, text in rows:
        x = list(text.encode())
        x += [byte_cnn.PAD] * (byte_cnn.WIDTH - len(x))
        places = range(len(x) - byte_cnn.WIDTH + 1)
        total = 0.0
        for at in range(0, len(places), byte_cnn.STEP):
            chunk = places[at : at + byte_cnn.STEP]
            pooled = [max(0, max(sum(table[j][x[p + j]][f] for j in range(byte_cnn.WIDTH)) for p in chunk) + c[f]) for f in range(byte_cnn.FILTERS)]
            total += len(chunk) * (sum(p * q for p, q in zip(pooled, w)) + float(net.l[0]) * math.log(len(chunk)) / math.log(byte_cnn.STEP))
        score = 1 / (1 + math.exp(-(total / len(places) + b)))
        assert got[i].score == pytest.approx(score, abs=1e-4) and got[i].predicted == int(got[i].score >= 0.7)


def test_training_reads_whole_texts_once():
    texts = [(bytes(range(256)) * 20, 1), (b"", 0), (b"ab", 1)]
    x, y, weight = byte_cnn.examples(texts)
    chunks = -(-(5120 - byte_cnn.WIDTH + 1) // byte_cnn.STEP)
    assert len(x) == chunks + 1 + 2 + 2 and y.tolist() == [1] * (chunks + 1) + [0, 0, 1, 1]
    assert weight.mean() == pytest.approx(1, abs=1e-5) and weight[:chunks].sum() == pytest.approx(weight[chunks + 1], abs=1e-5)
    whole = b"".join(bytes(r[: byte_cnn.STEP].astype(np.uint8)) for r in x[: chunks - 1]) + bytes(x[chunks - 1][x[chunks - 1] != byte_cnn.PAD].astype(np.uint8))
    assert whole == texts[0][0]


def test_quality_of_edge_rows(spark, edge):
    none = byte_cnn.train(edge, spark.createDataFrame([], "doc_id long, quality int"))
    assert none is None
    assert [r.score for r in byte_cnn.quality_scores(edge, none).collect()] == [0.5] * len(EDGE)
    got = byte_cnn.quality_scores(edge, byte_cnn.Network()).collect()
    assert len(got) == len(EDGE) and all(0 <= r.score <= 1 for r in got)
    assert byte_cnn.quality_scores(edge.limit(0), byte_cnn.Network()).collect() == []


def test_language_accuracy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = lang_centroids.identify(docs, lang_centroids.train(docs)).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert len(got) == docs.count() and np.mean([r.lang == r.lang_pred for r in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in got)


def test_a_rare_language_is_learned(spark):
    rng = random.Random(6)
    text = lambda letters: " ".join("".join(rng.choice(letters) for _ in range(5)) for _ in range(20))
    rows = [(i, text("abcdefgh"), "a") if i % 100 else (i, text("stuvwxyz"), "b") for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = lang_centroids.train(docs, sample=5)
    assert model.languages == ["a", "b"]
    assert all(r.lang_pred == ("a" if r.doc_id % 100 else "b") for r in lang_centroids.identify(docs, model).collect())


def slow_counts(text: str) -> Counter:
    """By the definition: hashed runs of one to three bytes of words, parted by one space."""
    letters = bytes(b if b > 127 or chr(b).isalpha() else 32 for b in text.lower().encode())
    raw, out = b" ".join(letters.split()), Counter()
    for n, mul in ((1, 0x9E3779B1), (2, 0x85EBCA77), (3, 0xC2B2AE3D)):
        for i in range(len(raw) - n + 1):
            out[(int.from_bytes(raw[i : i + n], "big") * mul % 2**32) >> 19] += 1
    return out


def test_language_equals_brute_force(spark, sf_dir):
    """Predictions of a trained model, recomputed in plain loops over whole texts; and its document frequencies."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(120).cache()
    model = lang_centroids.train(docs, sample=15)
    rows = docs.collect()
    training = [slow_counts(r.text) for r in rows if r.lang and any(map(str.isalpha, r.text)) and zlib.crc32(str(r.doc_id).encode()) % 4 != 2]
    frequency = Counter(x for t in training for x in t)
    idf = [math.log((1 + len(training)) / (1 + frequency[i])) + 1 for i in range(lang_centroids.DIMS)]
    assert np.allclose(model.idf, idf, atol=1e-5)
    got = {r.doc_id: r for r in lang_centroids.identify(docs, model).collect()}
    for r in rows:
        if not any(map(str.isalpha, r.text)):
            assert got[r.doc_id].lang_pred == "und"
            continue
        v = {i: math.log1p(n) * idf[i] for i, n in slow_counts(r.text).items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        cos = [sum(x * float(c[i]) for i, x in v.items()) / norm for c in model.centres]
        best = [max(c for c, o in zip(cos, model.of) if o == k) for k in range(len(model.languages))]
        first = max(range(len(best)), key=best.__getitem__)
        rest = max((b for k, b in enumerate(best) if k != first), default=0)
        score = 1 / (1 + math.exp(-20 * min(max(best[first] - rest, 0), 1)))
        rejected = 1 - best[first] > model.radius[first]
        assert got[r.doc_id].lang_pred == model.languages[first] and got[r.doc_id].rejected == rejected
        assert got[r.doc_id].score == pytest.approx(score / 2 if rejected else score, abs=1e-4)


def test_language_of_edge_rows(spark, edge):
    model = lang_centroids.fit({"en": [lang_centroids.sparse(b"the cat and the dog")], "fr": [lang_centroids.sparse(b"le chat et le chien")]}, np.ones(lang_centroids.DIMS, np.float32))
    got = lang_centroids.identify(edge, model).collect()
    assert len(got) == len(EDGE)
    for r, (_, text, _, _) in zip(got, EDGE):
        assert (r.lang_pred == "und") == (not text or not any(c.isalpha() for c in text))
    assert {r.lang_pred for r in lang_centroids.identify(edge, None).collect()} == {"und"}
    assert lang_centroids.train(edge.limit(0)) is None


def test_targets_fill_by_weight():
    assert targets([("a", 100), ("b", 100), (None, 100)]) == {"a": 200.0, "b": pytest.approx(250 / 3), None: pytest.approx(500 / 3)}
    assert targets([]) == {} and targets([("a", 0)]) == {"a": 0.0}


def schedule(rows):
    """By brute force: of each row (in order) its copies (position, words), by walking along the integral of the rate."""
    digest = lambda i, t, s: hashlib.md5(f"{i}:{hashlib.md5((t or '').encode()).hexdigest()}:{'n' if s is None else 's' + s}".encode()).hexdigest()
    names = sorted({s for _, _, s in rows}, key=lambda s: (s is None, s or ""))
    size = [len((t or "").split()) for _, t, _ in rows]
    total = {s: sum(n for n, r in zip(size, rows) if r[2] == s) for s in names}
    want, out = targets(list(total.items())), [[] for _ in rows]
    for k, s in enumerate(names):
        tilt, quota, at = 0.8 * (2 * k / max(len(names) - 1, 1) - 1), round(want[s]), 0
        time = lambda d: brentq(lambda t: quota * ((1 + tilt) * t - tilt * t * t) - d)  # noqa: B023, E731
        for _ in range(2):
            for i in sorted((i for i, r in enumerate(rows) if r[2] == s), key=lambda i: digest(*rows[i])):
                if size[i] and at < quota:
                    out[i].append((time(at), min(size[i], quota - at)))
                at += size[i]
    return out, total, want


def brentq(f):
    """The zero of a rising function on [0, 1], by halving."""
    lo, hi = 0.0, 1.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f(mid) < 0 else (lo, mid)
    return lo


def test_curriculum(spark, edge):
    rng = random.Random(4)
    rows = [(i, " ".join("w" * rng.randint(1, 5) for _ in range(rng.randint(0, 60))), (None, "s0", "s1", "s2", "s3")[i % 5] if i % 3 else "s0") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in curriculum(docs).collect()}
    assert {(r.doc_id, r.taken) for r in curriculum(docs.repartition(7)).collect()} == {(i, r.taken) for i, r in got.items()} and len(got) == 300
    want, total, target = schedule(rows)
    for i, (_, _, s) in enumerate(rows):
        r = got[i]
        assert (r.source_size, r.target) == (total[s], pytest.approx(target[s]))
        assert [p.words for p in r.positions] == [w for _, w in want[i]] and r.taken == sum(w for _, w in want[i]) <= 2 * r.size
        assert [p.position for p in r.positions] == pytest.approx([t for t, _ in want[i]], abs=1e-9)
        assert r.position == (r.positions[0].position if r.positions else None)
    order = [r.position for r in curriculum(docs).collect() if r.position is not None]
    assert order == sorted(order)
    got = curriculum(edge).collect()
    assert sorted((r.doc_id or 0, r.size) for r in got) == sorted((i or 0, len((t or "").split())) for i, t, _, _ in EDGE)
    assert curriculum(edge.limit(0)).collect() == []


def test_mixed_rows(spark, edge):
    rng = random.Random(9)
    rows = [(i, " ".join("w" * rng.randint(1, 5) for _ in range(rng.randint(0, 60))), f"s{i % 4}") for i in range(150)]
    # Equal rows keep places of their own; the same id and text in another source follow that source.
    rows += [(1000, "one two three", "s0")] * 3 + [(1000, "one two three", "s1")]
    docs = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id long, text string, source string, plan int, row int, size int")
    want, _, _ = schedule(rows)
    count = Counter()
    for (i, t, s), copies in zip(rows, want):
        count[i, t, s] += sum(2 * w >= len(t.split()) for _, w in copies)
    got = mix_rows(docs)
    assert got.columns == docs.columns
    assert Counter((r.doc_id, r.text, r.source) for r in got.collect()) == +count
    assert mix_rows(edge.limit(0)).collect() == [] and len(mix_rows(edge).columns) == len(edge.columns)


def paeth_file(pixels: np.ndarray, kinds: list[int]) -> bytes:
    """A PNG with given filters, by the definition, pixel by pixel."""
    h, w = pixels.shape
    lines = bytearray()
    for y in range(h):
        lines.append(kinds[y])
        for x in range(w):
            a, b, c = (int(pixels[y, x - 1]) if x else 0), (int(pixels[y - 1, x]) if y else 0), (int(pixels[y - 1, x - 1]) if x and y else 0)
            p = a + b - c
            near = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            lines.append((int(pixels[y, x]) - (0, a, b, (a + b) // 2, near)[kinds[y]]) % 256)
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return media.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"tEXt", b"a\0b") + chunk(b"IDAT", zlib.compress(bytes(lines))) + chunk(b"IEND", b"")


def test_png_reads_all_filters():
    rng = np.random.default_rng(2)
    pixels = rng.integers(0, 256, (40, 17), dtype=np.uint8)
    for kinds in ([4] * 40, [3] * 40, [i % 5 for i in range(40)], rng.integers(0, 5, 40).tolist()):
        assert (media.decode_png(paeth_file(pixels, kinds)) == pixels).all()
    assert (media.decode_png(media.encode_png(pixels)) == pixels).all()


def test_png_detects_damage():
    good = media.encode_png(np.arange(640, dtype=np.uint8).reshape(10, 64))
    for at in range(0, len(good), 7):
        with pytest.raises(media.BadPng):
            media.decode_png(good[:at] + bytes([good[at] ^ 1]) + good[at + 1 :])
    chunk = media._chunk
    head, body = good[:33], zlib.compress(bytes(65 * 10))
    bad = [
        good[:-3], good + b"x", head + good[-12:],
        media.SIGNATURE + chunk(b"IHDR", b"short") + good[33:],
        head + chunk(b"IDAT", body[:9]) + chunk(b"tEXt", b"a\0b") + chunk(b"IDAT", body[9:]) + chunk(b"IEND", b""),
        head + chunk(b"IDAT", body) + chunk(b"IEND", b"x"), head + chunk(b"IDAT", body + b"more") + chunk(b"IEND", b""),
        head + chunk(b"IDAT", zlib.compress(bytes(1 << 20))) + chunk(b"IEND", b""), head + chunk(b"IDAT", body[:-6]) + chunk(b"IEND", b""),
        media.SIGNATURE + chunk(b"IDAT", body) + good[8:],
    ]
    for data in bad:
        with pytest.raises(media.BadPng):
            media.decode_png(data)
    assert media.decode_png(head + chunk(b"IDAT", body[:9]) + chunk(b"IDAT", body[9:]) + chunk(b"IEND", b"")).shape == (10, 64)


def slow_hash(pixels: np.ndarray) -> str:
    """The cosine hash by the definition: means of 32 x 32 parts, the 8 x 8 lowest terms, their signs about the median."""

    def shrunk(lines):
        n = len(lines)
        cut = [i * n // 32 for i in range(32)] + [n]
        return [[sum(x) / len(x) for x in zip(*lines[a:b])] if b > a else list(lines[a]) for a, b in zip(cut, cut[1:])]

    small = list(map(list, zip(*shrunk(list(map(list, zip(*shrunk(pixels.tolist()))))))))
    scale = lambda u: math.sqrt((1 if u == 0 else 2) / 32)
    wave = [[math.cos((2 * x + 1) * u * math.pi / 64) * scale(u) for x in range(32)] for u in range(8)]
    low = [round(sum(wave[u][y] * wave[v][x] * small[y][x] for y in range(32) for x in range(32)), 6) for u in range(8) for v in range(8)]
    middle = sorted(low[1:])[31]
    return f"{int(''.join('1' if x > middle else '0' for x in low), 2):016x}"


@pytest.mark.parametrize("height", [1, 20, 32, 77])
def test_cosine_hash_equals_the_definition(height):
    pixels = np.random.default_rng(height).integers(32, 127, (height, 64), dtype=np.uint8)
    a, b = media.cosine_hash(pixels), slow_hash(pixels)
    # The transposed order of summing may tip a term that lies on the median.
    assert bin(int(a, 16) ^ int(b, 16)).count("1") <= 1


def test_media_rows(spark, edge):


    got = media.media_features(media.to_media(edge)).collect()
    assert len(got) == len(EDGE)
    for r, (i, text, _, _) in zip(got, EDGE):
        raw = (text or "").encode()
        body = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (i, len(raw), len(body), hashlib.sha256(body).hexdigest(), zlib.crc32(body[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(r.media), hashlib.sha256(bytes(r.media)).hexdigest())
    assert len({r.feature for r in got if r.doc_id == 5}) == 1


def test_licences_equal_brute_force(spark):
    rng = random.Random(3)
    words = "the mit license apache gnu general public cc by-x Version é".split()
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 80))) for _ in range(120)]
    texts += ["MIT LICENSE", "cc-by cc_by CC BY", "gnu general public license gnu general public license", "mit\nlicense", "", None, "Kelvin K mit license"]
    rows = [*enumerate(texts), (None, "mit license"), (7, texts[7])]
    got = license_report(spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, labels string")).collect()
    rx = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    want = []
    for i, t in rows:
        w = rx.findall("".join(c.lower() if c.isascii() else c for c in t or ""))
        hits = sorted((p, label) for label, phrase in PHRASES for p in range(len(w)) if w[p : p + len(phrase.split())] == phrase.split())
        want.append((i, len(w), len(hits), hits[0][0] if hits else None, hits[-1][0] if hits else None, ",".join(sorted({x for _, x in hits}))))
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got), key=key) == sorted(want, key=key)
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) for r in got)


def test_licence_notice_survives_edits(spark):
    text = "x y Permission is hereby granted, free of charge, to any person obtaining one copy of this software with associated documentation files z"
    (r,) = license_report(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert (r.labels, r.base_labels, r.n_base) == ("mit-text", "", 0) and r.score > 0.5


def test_licence_notice_is_found_by_its_words(spark):
    # A contiguous part is found if it has half of the notice's words, whatever words they are.
    rows, want = [(0, "licensed under the apache license version")], {0: ("apache-text", 0)}
    for label, text in NOTICES:
        w = text.split()
        for n in (len(w), (len(w) + 1) // 2, (len(w) + 1) // 2 - 1):
            for at in range(len(w) - n + 1):
                want[len(rows)] = (label, n / len(w) if 2 * n >= len(w) else 0)
                rows.append((len(rows), " ".join(["some words", *w[at : at + n], "follow here"])))
    _, spans = license_scan(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {(r.doc_id, r.label): r.score for r in spans.where("not whole").collect()}
    for i, (label, score) in want.items():
        assert got.get((i, label), 0) == pytest.approx(score), rows[i]


def test_licence_plan_is_native(spark, edge):
    plan = license_report(edge)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    assert license_report(edge.limit(0)).collect() == []
    assert license_report(edge).agg(F.count("*")).first()[0] == len(EDGE)
