"""Byte-level BPE through sentencepiece: a model written straight from a rank file, nothing trained.

Each byte is one character (U+0100 + byte), a rank becomes a piece scored by its negative rank, so the best-scored merge
is the lowest rank, and the normaliser is the identity. Texts are cut by the pre-token pattern; a pre-token that is a
rank is that id, any other is encoded by the model. Decoding maps ids back to their bytes.

Pre-tokens repeat, so a worker keeps the ids of the space-separated chunks that it has met (in two bounded generations).
A chunk that starts at a space is cut off from what is before it unless white space comes before that space; then the
chunks stay together, as the pattern looks at runs of white space.

Defined results: a null text is an empty one and has no ids. Special tokens do not exist. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import claim, small_batches, text_slices

#: The pattern and vocabulary that the queries use come with the installed tokenizer files.
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Chunks that a generation of a worker's memory holds, and the length that they stay under.
REMEMBERED, LONGEST = 250_000, 64
_LATIN = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+").fullmatch
_MAP = {b: chr(0x100 + b) for b in range(256)}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out + bytes([n]))


def _field(number: int, value: bytes | int | float) -> bytes:
    """A protocol-buffer field: bytes, an integer or a 32-bit float."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + np.float32(value).tobytes()
    return _varint(number << 3) + _varint(value & (1 << 64) - 1)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def piece(token: bytes) -> str:
    return token.decode("latin-1").translate(_MAP)


def model_proto(ranks: dict[bytes, int]) -> bytes:
    """The bytes of a sentencepiece model. Fields of the format: pieces 1 (piece 1, score 2, type 3: 1 normal, 2
    unknown), trainer 2 (model type 3: 2 BPE; unk 40, bos 41, eos 42, pad 43), normaliser 3 (name 1; dummy prefix 3,
    extra white space 4, escaping 5)."""
    if sorted(ranks.values()) != list(range(len(ranks))):
        raise ValueError("ranks must be 0 to n - 1")
    tokens = sorted(ranks, key=ranks.__getitem__)
    pieces = [_field(1, _field(1, piece(t).encode()) + _field(2, -float(i)) + _field(3, 1)) for i, t in enumerate(tokens)]
    unknown = _field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2))
    trainer = _field(3, 2) + _field(40, len(tokens)) + b"".join(_field(n, -1) for n in (41, 42, 43))
    plain = _field(1, b"identity") + b"".join(_field(n, 0) for n in (3, 4, 5))
    return b"".join([*pieces, unknown, _field(2, trainer), _field(3, plain)])


class Memory:
    """What was met lately, in two generations: between two texts, a full one becomes the old one, whose entries return
    when they are met again. A text that would add more than another generation leaves the rest of itself out."""

    def __init__(self, most: int):
        self.most, self.full = most, 2 * most
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def turn(self) -> None:
        if len(self.new) >= self.most:
            self.old, self.new = self.new, {}


#: Writers of so many little-endian 32-bit numbers.
_PACK = [struct.Struct(f"<{n}I").pack for n in range(32)]


def packed(ids: list[int]) -> bytes:
    n = len(ids)
    return _PACK[n](*ids) if n < 32 else struct.pack(f"<{n}I", *ids)


class ChunkCoder:
    """Packed ids (uint32, little-endian) of a text, through remembered chunks; ``pretoken_ids`` is what encodes."""

    def __init__(self, pattern: str, remembered: int | None = None):
        import regex

        most = remembered or REMEMBERED
        self.split = regex.compile(pattern).findall
        #: Letters after a space, then other signs, are two pre-tokens, so these need no search.
        self.plain_words = r"| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|" in pattern
        #: What follows a space and does not end with white space, under its text without the space; other pre-tokens.
        self.chunks, self.words = Memory(most), Memory(most // 4)

    def pretoken_ids(self, word: str) -> list[int]:
        raise NotImplementedError

    def _pretoken(self, word: str) -> bytes:
        memory, key = (self.chunks, word[1:]) if word[0] == " " and not word[-1].isspace() else (self.words, word)
        ids = memory.new.get(key)
        if ids is None:
            ids = memory.old.get(key)
            if ids is None:
                ids = packed(self.pretoken_ids(word))
            if len(key) < LONGEST and len(memory.new) < memory.full:
                memory.new[key] = ids
        return ids

    def _plain(self, text: str) -> bytes:
        return b"".join(map(self._pretoken, self.split(text)))

    def _chunk(self, bare: str) -> bytes:
        """Of a space and a chunk that does not end with white space: what ends so belongs with the next chunk."""
        ids = self.chunks.old.get(bare)
        if ids is None:
            core = bare.rstrip(".,;:!?") if self.plain_words else ""
            if core.isalpha() and (core.isascii() or _LATIN(core)):
                words = [" " + core, bare[len(core) :]] if len(core) < len(bare) else [" " + core]
            else:
                words = self.split(" " + bare)
            ids = packed(self.pretoken_ids(words[0])) if len(words) == 1 else b"".join(map(self._pretoken, words))
        if len(bare) < LONGEST and len(self.chunks.new) < self.chunks.full:
            self.chunks.new[bare] = ids
        return ids

    def encode(self, text: str) -> bytes:
        self.chunks.turn()
        self.words.turn()
        parts = text.split(" ")
        got = list(map(self.chunks.new.get, parts))
        got[0], i = None, -1
        while True:
            try:
                i = got.index(None, i + 1)
            except ValueError:
                return b"".join(got)
            bare = parts[i]
            if i and bare and not bare[-1].isspace():
                got[i] = self._chunk(bare)
                continue
            held, first = " " + bare if i else bare, i
            while (not held or held[-1].isspace()) and i + 1 < len(parts):
                i += 1
                held += " " + parts[i]
                got[i] = b""
            got[first] = self._plain(held)


class PieceCodec(ChunkCoder):
    def __init__(self, path: str, pattern: str):
        import sentencepiece

        super().__init__(pattern)
        self.ranks = read_ranks(path)
        self.tokens = sorted(self.ranks, key=self.ranks.__getitem__)
        self.model = sentencepiece.SentencePieceProcessor()
        self.model.LoadFromSerializedProto(model_proto(self.ranks))

    def pretoken_ids(self, word: str) -> list[int]:
        raw = word.encode()
        rank = self.ranks.get(raw)
        return [rank] if rank is not None else self.model.encode(piece(raw))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@cache
def codec(path: str, pattern: str) -> PieceCodec:
    """One for each worker process."""
    return PieceCodec(path, pattern)


def _codec(path: str, pattern: str) -> PieceCodec:
    claim("bpe_piece", codec.cache_clear)
    return codec(path, pattern)


def _coder(path: str, pattern: str, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = _codec(path, pattern)
        decimal = [b"%d" % i for i in range(len(c.tokens))]
        for part in text_slices(batches):
            n, ids_sha, text_sha, ids = [], [], [], []
            for text in part.column("text").to_pylist():
                packed = c.encode(text or "")
                n.append(len(packed) // 4)
                ids_sha.append(hashlib.sha256(b",".join(map(decimal.__getitem__, np.frombuffer(packed, "<u4").tolist()))).hexdigest())
                text_sha.append(hashlib.sha256(c.decode(packed)).hexdigest())
                ids.append(packed if with_ids else None)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string()), pa.array(ids, pa.binary())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"],
            )

    return run


def bpe_encode(docs: DataFrame, path: str, pattern: str, with_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and ids (packed little-endian uint32), a row for each row."""
    small_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(_coder(path, pattern, with_ids), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, ids binary")


def _decoder(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = _codec(path, pattern)
        for part in text_slices(batches, "ids"):
            texts = [None if x is None else c.decode(x) for x in part.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(texts, pa.binary())], names=["doc_id", "decoded"])

    return run


def bpe_decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, decoded: the bytes of each packed ``ids``."""
    return encoded.select("doc_id", "ids").mapInArrow(_decoder(path, pattern), "doc_id long, decoded binary")
