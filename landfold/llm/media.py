"""Media columns: what a stored blob really is and what media lie in it, found by signature.

One Aho-Corasick automaton locates every known signature in the bytes; a validator per format (see formats: WAV, WebP,
BMP, PPM, PNG, JPEG, GIF, Ogg, MP4, PDF) then confirms structure and length at that place, so a signature inside other data
is not mistaken for a file. `sniff` names the media a blob starts with and carves those embedded further on, whatever type was
declared.

Payloads are stored losslessly in one of four formats, chosen by content: WAV (8-bit PCM), BMP (24-bit), PPM (24-bit)
and PNG (8-bit RGB, stored rows). Payload lengths are positive multiples of 192, a row of 64 pixels.

Defined results: a null text is an empty payload of 192 spaces; equal texts give equal values; doc_ids may be null or
repeat; an empty table gives no rows; a null blob has null media, an unknown one none. `media_columns` reads doc_id and text
only, whatever other columns are named.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_name, utf8
from .formats import SIGNATURES, Media

ROW = 192
KINDS = ("wav", "bmp", "ppm", "png")


def pad(text: str | None) -> tuple[bytes, int]:
    raw = utf8(text)
    return raw + b" " * (max(ROW, -(-len(raw) // ROW) * ROW) - len(raw)), len(raw)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def store(payload: bytes, kind: str) -> bytes:
    """The payload (a positive multiple of 192 bytes) as a file of this kind."""
    rows = len(payload) // ROW
    if kind == "wav":
        fmt = struct.pack("<HHIIHH", 1, 1, 8000, 8000, 1, 8)
        return b"RIFF" + struct.pack("<I", 36 + len(payload)) + b"WAVEfmt " + struct.pack("<I", 16) + fmt + b"data" + struct.pack("<I", len(payload)) + payload
    if kind == "bmp":
        return b"BM" + struct.pack("<IHHI", 54 + len(payload), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, ROW // 3, -rows, 1, 24, 0, len(payload), 2835, 2835, 0, 0) + payload
    if kind == "ppm":
        return b"P6\n%d %d\n255\n" % (ROW // 3, rows) + payload
    if kind == "png":
        lines = b"".join(b"\0" + payload[i : i + ROW] for i in range(0, len(payload), ROW))
        return b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", struct.pack(">IIBBBBB", ROW // 3, rows, 8, 2, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(lines, 0)) + _chunk(b"IEND", b"")
    raise ValueError(f"unknown kind: {kind}")


_automaton = []


def magics(blob: bytes) -> list[tuple[int, bytes]]:
    """Places of all signatures, in order."""
    if not _automaton:
        import ahocorasick

        a = ahocorasick.Automaton()
        for magic in SIGNATURES:
            a.add_word(magic.decode("latin-1"), magic)
        a.make_automaton()
        _automaton.append(a)
    return sorted((end - len(magic) + 1, magic) for end, magic in _automaton[0].iter(blob.decode("latin-1")))


def sniff(blob: bytes | None) -> list[Media]:
    """The confirmed media of a blob: files that follow each other or lie in other data, not files within files."""
    out, free = [], 0
    for at, magic in magics(blob) if blob else []:
        if at >= free and (m := SIGNATURES[magic](blob, at)) and m.start >= free:
            out.append(m)
            free = m.start + m.length
    return out


def enclose(media: bytes, seed: int) -> bytes:
    """Media as an attachment in a larger blob: up to 63 bytes before it and after it, none of which start a format."""
    lead = bytes((seed + 7 * i) % 10 + 48 for i in range(seed % 64))
    return lead + media + lead[::-1]


def carve(blob: bytes, media: Media) -> bytes:
    return blob[media.start : media.start + media.length]


def describe(text: str | None) -> tuple:
    """The payload of a text goes into a blob as an attachment of one kind, under the label of perhaps another; what is
    said about it comes from sniffing the blob and carving the attachment out."""
    payload, n_bytes = pad(text)
    code = zlib.crc32(payload)
    kind, declared = KINDS[code % 4], KINDS[code // 4 % 4]
    blob = enclose(store(payload, kind), code // 16)
    found = sniff(blob)[0]  # what was declared is not trusted
    stored, back = carve(blob, found), found.payload
    feature = f"{found.kind};{'as declared' if declared == found.kind else 'declared ' + declared};at={found.start};rows={len(back) // ROW};sum={int(np.frombuffer(back, np.uint8).sum(dtype=np.int64))};distinct={len(set(back))}"
    return n_bytes, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), feature


COLUMNS = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def media_columns(docs: DataFrame) -> DataFrame:
    """doc_id and the digests of COLUMNS for every row."""

    @F.pandas_udf(COLUMNS)
    def described(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([describe(t) for t in texts], columns=[c.split()[0] for c in COLUMNS.split(", ")])

    return docs.select("doc_id", described("text").alias("m")).select("doc_id", "m.*")


FOUND = "array<struct<kind: string, start: long, length: long, content: binary>>"


def sniff_column(df: DataFrame, blob: str, declared: str | None = None) -> DataFrame:
    """df with media, an array of (kind, start, length, content) carved from the blob column, and corrected_type: the first
    one's kind if it begins the blob, else what was declared. Columns of these names are replaced."""

    @F.pandas_udf(FOUND)
    def run(blobs: pd.Series) -> pd.Series:
        return pd.Series([None if b is None else [{"kind": m.kind, "start": m.start, "length": m.length, "content": carve(bytes(b), m)} for m in sniff(bytes(b))] for b in blobs], dtype=object)

    given = F.col(declared) if declared else F.lit(None).cast("string")
    found = df.select(*(by_name(c) for c in df.columns if c not in ("media", "corrected_type")), run(F.col(blob)).alias("media"), given.alias("corrected_type"))
    first = F.get("media", F.lit(0))
    return found.withColumn("corrected_type", F.coalesce(F.when(first["start"] == 0, first["kind"]), F.col("corrected_type")))
