"""Media columns: bytes as greyscale PNG files, read back with every check, and a cosine-transform hash of the image.

The codec is zlib and numpy only. Writing picks, for each row, the filter with the smallest sum of residuals among
none, sub and up; reading undoes all five filters of the format and verifies signature, chunk checksums, chunk order,
header and length. A damaged file raises ``BadPng``.

Defined results: a null text is an empty one; every row gets a file, as the payload is padded to one row of pixels at
least. The result depends on the text alone. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, text_slices

SIGNATURE = b"\x89PNG\r\n\x1a\n"
WIDTH = 64
#: Bytes of compressed data in an IDAT chunk.
CHUNK = 1 << 16
#: zlib level; of 1 to 9.
LEVEL = 1


class BadPng(ValueError):
    pass


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode_png(pixels: np.ndarray) -> bytes:
    """An 8-bit greyscale PNG of a (height, width) array of uint8."""
    height, width = pixels.shape
    left, above = np.zeros_like(pixels), np.zeros_like(pixels)
    left[:, 1:], above[1:] = pixels[:, :-1], pixels[:-1]
    rows = np.stack([pixels, pixels - left, pixels - above])
    cost = np.minimum(rows, 0 - rows).sum(2, dtype=np.int64)
    kind = cost.argmin(0)
    lines = np.empty((height, width + 1), np.uint8)
    lines[:, 0], lines[:, 1:] = kind, rows[kind, np.arange(height)]
    data = zlib.compress(lines.tobytes(), LEVEL)
    parts = [_chunk(b"IDAT", data[at : at + CHUNK]) for at in range(0, len(data), CHUNK)]
    return b"".join([SIGNATURE, _chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)), *parts, _chunk(b"IEND", b"")])


def _paeth(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    a, b, c = (x.astype(np.int16) for x in (a, b, c))
    pa_, pb, pc = np.abs(b - c), np.abs(a - c), np.abs(a + b - 2 * c)
    return np.where((pa_ <= pb) & (pa_ <= pc), a, np.where(pb <= pc, b, c)).astype(np.uint8)


def unfilter(lines: np.ndarray) -> np.ndarray:
    """Pixels from filtered lines (filter byte first). Runs of one filter go at once: none as it is, sub and up as
    running sums; average and Paeth, where a pixel needs its left and upper ones, along anti-diagonals."""
    kind, out = lines[:, 0], lines[:, 1:].copy()
    if kind.max(initial=0) > 4:
        raise BadPng("unknown filter")
    height, width = out.shape
    cuts = [0, *(np.flatnonzero(np.diff(kind)) + 1).tolist(), height]
    for a, b in zip(cuts, cuts[1:]):
        if kind[a] == 1:
            out[a:b] = np.cumsum(out[a:b], axis=1, dtype=np.uint8)
        elif kind[a] == 2:
            if a:
                out[a] += out[a - 1]
            out[a:b] = np.cumsum(out[a:b], axis=0, dtype=np.uint8)
        elif kind[a] > 2:
            n = b - a
            box = np.zeros((n + 1, width + 1), np.uint8)
            box[0, 1:] = out[a - 1] if a else 0
            box[1:, 1:] = out[a:b]
            for d in range(n + width - 1):
                y = np.arange(max(0, d - width + 1), min(n, d + 1))
                x = d - y
                left, up, corner = box[y + 1, x], box[y, x + 1], box[y, x]
                guess = ((left.astype(np.uint16) + up) >> 1).astype(np.uint8) if kind[a] == 3 else _paeth(left, up, corner)
                box[y + 1, x + 1] += guess
            out[a:b] = box[1:, 1:]
    return out


def decode_png(data: bytes) -> np.ndarray:
    if data[:8] != SIGNATURE:
        raise BadPng("no PNG signature")
    at, size, idat, before, ended = 8, None, [], b"", False
    while not ended:
        if at + 12 > len(data):
            raise BadPng("cut off")
        (n,), kind = struct.unpack_from(">I", data, at), data[at + 4 : at + 8]
        body, end = data[at + 8 : at + 8 + n], at + 12 + n
        if end > len(data) or zlib.crc32(kind + body) != struct.unpack_from(">I", data, end - 4)[0]:
            raise BadPng(f"checksum of {kind!r}")
        if (size is None) != (kind == b"IHDR"):
            raise BadPng("header misplaced")
        if kind == b"IHDR":
            if n != 13:
                raise BadPng("length of the header")
            width, height, *form = struct.unpack(">IIBBBBB", body)
            if form != [8, 0, 0, 0, 0] or not width or not height:
                raise BadPng("not an 8-bit greyscale image without interlace")
            size = (height, width)
        elif kind == b"IDAT":
            if idat and before != b"IDAT":
                raise BadPng("image data is not in one run of chunks")
            idat.append(body)
        elif kind == b"IEND":
            if n or end != len(data):
                raise BadPng("bytes in or behind the end chunk")
            ended = True
        elif not kind[0] & 32:
            raise BadPng(f"unknown critical chunk {kind!r}")
        at, before = end, kind
    inflate = zlib.decompressobj()
    try:
        # One byte more than there should be, so that a small file does not swell.
        raw = inflate.decompress(b"".join(idat), size[0] * (size[1] + 1) + 1)
    except zlib.error as e:
        raise BadPng(str(e)) from e
    if not inflate.eof or inflate.unused_data:
        raise BadPng("end of the image data")
    if len(raw) != size[0] * (size[1] + 1):
        raise BadPng("length of the image data")
    return unfilter(np.frombuffer(raw, np.uint8).reshape(size[0], size[1] + 1))


_SIDE, _LOW = 32, 8
_u = np.arange(_LOW)[:, None]
_COSINES = np.cos((2 * np.arange(_SIDE)[None] + 1) * _u * np.pi / (2 * _SIDE)) * np.where(_u == 0, np.sqrt(1 / _SIDE), np.sqrt(2 / _SIDE))


def _shrunk(x: np.ndarray) -> np.ndarray:
    """Means of _SIDE even parts of the rows; rows repeat where there are fewer."""
    n = len(x)
    if n < _SIDE:
        return x[np.arange(_SIDE) * n // _SIDE]
    edges = np.arange(_SIDE) * n // _SIDE
    return np.add.reduceat(x, edges) / np.diff(np.append(edges, n))[:, None]


def cosine_hash(pixels: np.ndarray) -> str:
    """16 hex digits: the signs of the 8 x 8 lowest cosine-transform terms of the image against their median."""
    small = _shrunk(_shrunk(pixels.astype(np.float64)).T).T
    low = (_COSINES @ small @ _COSINES.T).round(6).ravel()
    bits = low > np.median(low[1:])
    return np.packbits(bits).tobytes().hex()


def payload(text: bytes | None) -> bytes:
    text = text or b""
    return text + bytes(-len(text) % 64 or 64 * (not text))


_OUT = pa.schema(
    [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()),
     ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]
)


def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in text_slices(batches):
        texts = part.column("text").to_pylist()
        media = [encode_png(np.frombuffer(payload(x), np.uint8).reshape(-1, WIDTH)) for x in texts]
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(x or b"") for x in texts], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])


def _read(keep: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "media"):
            out: dict[str, list] = {n: [] for n in _OUT.names[3:]}
            media = part.column("media").to_pylist()
            for m in media:
                pixels = decode_png(m)
                body = pixels.tobytes()
                for n, v in zip(out, (len(body), hashlib.sha256(body).hexdigest(), zlib.crc32(body[-64:]), len(m), hashlib.sha256(m).hexdigest(), cosine_hash(pixels))):
                    out[n].append(v)
            stored = part.column("media") if keep else pa.nulls(part.num_rows, pa.binary())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("n_bytes"), stored, *(pa.array(v, _OUT.field(n).type) for n, v in out.items())], schema=_OUT)

    return run


def to_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, media: each text as the binary of a PNG."""
    small_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return source.mapInArrow(_write, "doc_id long, n_bytes long, media binary")


def media_features(media: DataFrame, keep: bool = True) -> DataFrame:
    """Reads the PNG column back: payload and file digests and the cosine hash (``keep``: with the file)."""
    shape = "doc_id long, n_bytes long, media binary, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return media.select("doc_id", "n_bytes", "media").mapInArrow(_read(keep), shape)
