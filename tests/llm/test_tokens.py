"""Tokenisers and token files: equal to the libraries, exact round trips, damage is found."""

from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest

from spanloom.llm import bpe_piece, token_sstable
from spanloom.llm.bpe_piece import VOCABULARY, bpe_decode, bpe_encode

PIECES = [" ", "  ", "\n", "\t", "a", "Bo", "é", "1", "2024", "'s", "'", "!", " ", "　", "  \n", "中", "​", "\U0001f600", "_", " x", "<|endoftext|>", "\x1c", "\x85", "the", " of"]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(9)
    return ["", " ", "\n\n", "a" * 5000, *("".join(rng.choice(PIECES) for _ in range(rng.randint(0, 25))) for _ in range(3000))]


def test_pieces_equal_tiktoken(texts, monkeypatch):
    import tiktoken

    codec = bpe_piece.PieceCodec(P.path(VOCABULARY), P.PATTERN)
    monkeypatch.setattr(bpe_piece, "REMEMBERED", 50)
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    for t in texts:
        packed = codec.encode(t)
        assert np.frombuffer(packed, "<u4").tolist() == library.encode_ordinary(t)
        assert codec.decode(packed) == t.encode()


def test_encode_rows(spark):
    import hashlib

    rows = [(1, "Hello  world"), (2, None), (3, ""), (None, "x"), (1, "Hello  world")]
    docs = spark.createDataFrame([(*r, "a") for r in rows], "doc_id long, text string, ids string")
    coded = bpe_encode(docs, P.path(VOCABULARY), P.PATTERN)
    got = coded.collect()
    assert [r.doc_id for r in got] == [1, 2, 3, None, 1] and [r.n_tokens for r in got][1:3] == [0, 0]
    assert [r.decoded_sha256 for r in got] == [hashlib.sha256((t or "").encode()).hexdigest() for _, t in rows]
    assert [bytes(r.decoded) for r in bpe_decode(coded, P.path(VOCABULARY), P.PATTERN).collect()] == [(t or "").encode() for _, t in rows]


def test_chunks_equal_tokenizers(texts):
    enc = token_sstable.ChunkEncoder(P.path(token_sstable.VOCABULARY), P.PATTERN)
    for t in texts:
        assert enc.ids(t).tolist() == enc.whole(t).tolist()


class Buffer(bytearray):
    write = bytearray.extend


def test_shard_round_trip(monkeypatch):
    monkeypatch.setattr(token_sstable, "BLOCK_BYTES", 200)
    out, rng = Buffer(), np.random.default_rng(1)
    writer = token_sstable.Writer(out, 2)
    ids = sorted({int(x) for x in rng.integers(-(2**62), 2**62, 300)} | {-5, 0, 7})
    data = {token_sstable.key_of(i): rng.integers(0, 50_000, rng.integers(0, 40)).astype("<u4") for i in ids}
    data |= {token_sstable.key_of(7, h, 1): np.array([h], "<u4") for h in range(300)} | {token_sstable.key_of(None): np.array([], "<u4")}
    for key in sorted(data):
        writer.add(key, data[key])
    with pytest.raises(ValueError):
        writer.add(token_sstable.key_of(0), data[token_sstable.key_of(0)])
    writer.finish()
    read = token_sstable.Reader(lambda at, n: bytes(out[at : at + n]), len(out))
    assert [k for k, _, _ in read] == sorted(data) and read.n == len(data) and len(read.blocks) > 20
    before = 0
    for key, at, values in read:
        assert at == before and values.tolist() == data[key].tolist()
        before += len(values)
    for i in [*ids, None]:
        assert [x.tolist() for x in read.find(i)] == [data[k].tolist() for k in sorted(data) if k[:9] == token_sstable.head_of(i)]
        assert read.get(i).tolist() == data[token_sstable.key_of(i)].tolist()
    assert len(list(read.find(7))) == 301
    assert before == read.ids and token_sstable.id_of(token_sstable.key_of(-5)) == -5 and token_sstable.id_of(token_sstable.key_of(None)) is None
    missing = range(10**6, 10**6 + 2000)
    assert all(read.get(i) is None for i in missing) and sum(map(read.may_hold, missing)) < 100
    out[20] ^= 1
    with pytest.raises(token_sstable.BadShard):
        list(token_sstable.Reader(lambda at, n: bytes(out[at : at + n]), len(out)))


def test_keys_name_one_row_across_shards(spark, tmp_path):
    # One id fills several range partitions; every document is looked up in the shards.
    rows = [(5, f"text {i % 300}") for i in range(400)] + [(i, f"other {i}") for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = token_sstable.write_shards(docs, f"file://{tmp_path}/s", P.path(token_sstable.VOCABULARY), P.PATTERN).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    shards = [token_sstable.open_shard(r.path) for r in found]
    keys = [k for s in shards for k, _, _ in s]
    assert len(shards) > 1 and len(keys) == len(set(keys)) == len(rows) and keys == sorted(keys)
    enc = token_sstable.ChunkEncoder(P.path(token_sstable.VOCABULARY), P.PATTERN)
    for i in range(100):
        want = sorted([*enc.ids(t).tolist(), 2] for j, t in rows if j == i)
        assert sorted(x.tolist() for s in shards for x in s.find(i)) == want


def test_addresses_of_object_stores():
    assert token_sstable.address("s3a://bucket/folder/x.sst") == "s3://bucket/folder/x.sst"
    for same in ("s3://b/x", "file:///tmp/x", "/tmp/x", "hdfs://name:8020/x", "gs://b/x"):
        assert token_sstable.address(same) == same


def test_very_long_texts(spark):
    """Real text, repeated, of a megabyte in one document."""
    import hashlib

    import tiktoken

    base = "\n".join(r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect())
    text = (base * (1 + (1 << 20) // len(base)))[: 1 << 20]
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    ranks = bpe_piece.read_ranks(P.path(VOCABULARY))
    ids = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary(text)
    r = bpe_encode(docs, P.path(VOCABULARY), P.PATTERN, with_ids=False).first()
    assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
    assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    r = token_sstable.sstable_round_trip(docs, P.path(token_sstable.VOCABULARY), P.PATTERN).first()
    whole = token_sstable.ChunkEncoder(P.path(token_sstable.VOCABULARY), P.PATTERN).whole(text).tolist()
    assert (r.n_tokens, r.ids_crc32) == (len(whole) + 1, zlib.crc32(np.array([*whole, 2], "<u4").tobytes()))


def test_shards_equal_the_library(spark, sf_dir):
    from tokenizers import Tokenizer

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    rows += [(None, "null id"), (9_999, None), (9_998, ""), (-3, "negative"), (9_997, "same"), (9_997, "same")]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, start int")
    got = sorted(token_sstable.sstable_round_trip(docs, P.path(token_sstable.VOCABULARY), P.PATTERN).collect(), key=lambda r: r.start)
    tok, start = Tokenizer.from_file(P.path(token_sstable.VOCABULARY)), 0
    rows.sort(key=lambda r: (r[0] is None, r[0] or 0))
    assert len(got) == len(rows)
    for r, (i, t) in zip(got, rows):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_no_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert bpe_encode(none, P.path(VOCABULARY), P.PATTERN).collect() == []
    assert token_sstable.sstable_round_trip(none, P.path(token_sstable.VOCABULARY), P.PATTERN).collect() == []
