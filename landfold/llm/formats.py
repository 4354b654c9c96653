"""Validators of media formats: given bytes and the place of a signature, the file that begins there, or None.

Each follows the format's own structure to the end: lengths, check sums where there are any, and what a file must hold.
Nothing is trusted: lengths are checked against the bytes there are, and what unpacks is bounded by what was packed.
"""

from __future__ import annotations

import re
import struct
import zlib
from typing import NamedTuple


class Media(NamedTuple):
    kind: str
    start: int
    length: int  # of the whole file
    payload: bytes  # samples or pixels, where the format is read so far; else what follows the file's head


def _riff_chunks(b: bytes, at: int) -> tuple[int, list[tuple[bytes, int, int]]] | None:
    """The end of a RIFF file, and its chunks: name, where their data begins, length."""
    if len(b) < at + 12:
        return None
    size = struct.unpack_from("<I", b, at + 4)[0]
    end, p, out = at + 8 + size, at + 12, []
    if size < 4 or end > len(b):
        return None
    while p + 8 <= end:
        n = struct.unpack_from("<I", b, p + 4)[0]
        if p + 8 + n > end:
            return None
        out.append((b[p : p + 4], p + 8, n))
        p += 8 + n + n % 2
    return end + size % 2 * (b[end : end + 1] == b"\0"), out


def riff(b: bytes, at: int) -> Media | None:
    """Sound (WAVE) or a picture (WEBP); both are RIFF files."""
    found = _riff_chunks(b, at)
    if not found:
        return None
    end, chunks = found
    by_name = {name: (p, n) for name, p, n in reversed(chunks)}
    if b[at + 8 : at + 12] == b"WAVE" and b"fmt " in by_name and b"data" in by_name:
        p, n = by_name[b"fmt "]
        if n < 16:
            return None
        code, channels, rate, _, align, bits = struct.unpack_from("<HHIIHH", b, p)
        if not channels or not rate or code == 1 and (bits % 8 or align != channels * bits // 8):
            return None
        p, n = by_name[b"data"]
        return Media("wav", at, end - at, b[p : p + n])
    if b[at + 8 : at + 12] == b"WEBP" and chunks and chunks[0][0] in (b"VP8 ", b"VP8L", b"VP8X"):
        pictures = [(name, p, n) for name, p, n in chunks if name in (b"VP8 ", b"VP8L", b"ANMF")]
        right = {b"VP8 ": lambda p, n: n >= 10 and b[p + 3 : p + 6] == b"\x9d\x01\x2a", b"VP8L": lambda p, n: n >= 5 and b[p] == 0x2F, b"ANMF": lambda p, n: n >= 16}
        if pictures and all(right[name](p, n) for name, p, n in pictures):
            return Media("webp", at, end - at, b[at + 12 : end])
    return None


def bmp(b: bytes, at: int) -> Media | None:
    if len(b) < at + 54:
        return None
    total, zero, zero2, offset = struct.unpack_from("<IHHI", b, at + 2)
    head, width, height, planes, bits, packed, size, _, _, colours = struct.unpack_from("<IiiHHIIiiI", b, at + 14)
    if zero or zero2 or head not in (40, 52, 56, 108, 124) or planes != 1 or bits not in (1, 4, 8, 16, 24, 32) or packed not in (0, 3) or width <= 0 or height == 0:
        return None
    if packed == 3 and bits not in (16, 32) or bits <= 8 and colours > 1 << bits:
        return None
    palette = 4 * (colours or 1 << bits) if bits <= 8 else 0
    stride = (width * bits + 31) // 32 * 4
    if total > len(b) - at or offset < 14 + head + palette or offset + stride * abs(height) != total or size not in (0, stride * abs(height)):
        return None
    return Media("bmp", at, total, b[at + offset : at + total])


_PPM = re.compile(rb"P6(?:\s+|\s*#[^\n]*\n\s*)+(\d{1,9})\s+(\d{1,9})\s+(\d{1,5})\s")


def ppm(b: bytes, at: int) -> Media | None:
    m = _PPM.match(b, at, at + 1024)
    if not m or not int(m[1]) or not int(m[2]) or not 0 < int(m[3]) < 65536:
        return None
    end = m.end() + 3 * int(m[1]) * int(m[2]) * (1 + (int(m[3]) > 255))
    return Media("ppm", at, end - at, b[m.end() : end]) if end <= len(b) else None


#: Channels by colour type, with the depths that go with it, and the passes of an interlaced picture.
CHANNELS = {0: (1, (1, 2, 4, 8, 16)), 2: (3, (8, 16)), 3: (1, (1, 2, 4, 8)), 4: (2, (8, 16)), 6: (4, (8, 16))}
PASSES = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))
#: What a byte of deflated data can unpack to, at most.
SWELL = 1032


def _predicted(kind: int, a: int, b: int, c: int) -> int:
    """Of a sample, from the ones to the left, above, and above to the left."""
    if kind == 1:
        return a
    if kind == 2:
        return b
    if kind == 3:
        return (a + b) // 2
    p = a + b - c
    return min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]


def unfiltered(lines: bytes, stride: int, step: int) -> bytes | None:
    """Rows without their filters; None if one is unknown."""
    out, above = [], bytes(stride)
    for at in range(0, len(lines), stride + 1):
        kind, row = lines[at], lines[at + 1 : at + 1 + stride]
        if kind > 4:
            return None
        if kind:
            now = bytearray(row)
            for i in range(stride):
                a, c = (now[i - step], above[i - step]) if i >= step else (0, 0)
                now[i] = (now[i] + _predicted(kind, a, above[i], c)) & 255
            row = bytes(now)
        out.append(row)
        above = row
    return b"".join(out)


def png(b: bytes, at: int) -> Media | None:
    p, packed, head, palette = at + 8, [], None, False
    while p + 12 <= len(b):
        n, kind = struct.unpack_from(">I4s", b, p)
        if p + 12 + n > len(b) or struct.unpack_from(">I", b, p + 8 + n)[0] != zlib.crc32(b[p + 4 : p + 8 + n]):
            return None
        if (kind == b"IHDR") != (p == at + 8) or kind == b"IHDR" and n != 13:
            return None
        if kind == b"IHDR":
            head = struct.unpack_from(">IIBBBBB", b, p + 8)
        elif kind == b"PLTE":
            palette = True
        elif kind == b"IDAT":
            packed.append(b[p + 8 : p + 8 + n])
        p += 12 + n
        if kind == b"IEND":
            pixels = _pixels(head, b"".join(packed), palette)
            return None if pixels is None else Media("png", at, p - at, pixels)
    return None


def _pixels(head: tuple[int, ...], packed: bytes, palette: bool) -> bytes | None:
    """All rows, or those of one pass after the other."""
    width, height, depth, colour, method, filtering, interlaced = head
    if not width or not height or colour not in CHANNELS or method or filtering or interlaced > 1 or colour == 3 and not palette:
        return None
    channels, depths = CHANNELS[colour]
    if depth not in depths:
        return None
    grid = [(-(-(width - x) // dx), -(-(height - y) // dy)) for x, y, dx, dy in PASSES] if interlaced else [(width, height)]
    sizes = [((w * channels * depth + 7) // 8, h) for w, h in grid if w > 0 and h > 0]
    total = sum((s + 1) * h for s, h in sizes)
    if total > SWELL * len(packed):
        return None
    try:
        lines = zlib.decompressobj().decompress(packed, total + 1)
    except zlib.error:
        return None
    if len(lines) != total:
        return None
    out, p = [], 0
    for stride, h in sizes:
        rows = unfiltered(lines[p : p + (stride + 1) * h], stride, max(1, channels * depth // 8))
        if rows is None:
            return None
        out.append(rows)
        p += (stride + 1) * h
    return b"".join(out)


#: Markers without a length, and those that begin a frame.
BARE = {0x01, *range(0xD0, 0xD8)}
FRAMES = {*range(0xC0, 0xD0)} - {0xC4, 0xC8, 0xCC}
_MARK = re.compile(rb"\xff+[^\x00\xd0-\xd7\xff]", re.DOTALL)


def jpeg(b: bytes, at: int) -> Media | None:
    """Segments up to the end of the picture; entropy-coded data runs up to the next marker."""
    p, framed, scanned = at + 2, False, False
    while p + 2 <= len(b) and b[p] == 0xFF:
        while p + 1 < len(b) and b[p + 1] == 0xFF:
            p += 1
        if p + 2 > len(b):
            return None
        mark = b[p + 1]
        p += 2
        if mark == 0xD9:
            return Media("jpeg", at, p - at, b[at + 2 : p]) if scanned else None
        if mark in BARE:
            continue
        if p + 2 > len(b) or mark in (0x00, 0xD8):
            return None
        n = struct.unpack_from(">H", b, p)[0]
        if n < 2 or p + n > len(b):
            return None
        if mark in FRAMES:
            if n < 8 or framed and mark < 0xC5:
                return None
            _, height, width, parts = struct.unpack_from(">BHHB", b, p + 2)
            if not width or not parts or n != 8 + 3 * parts:
                return None
            framed = True
        p += n
        if mark == 0xDA:
            if not framed:
                return None
            m = _MARK.search(b, p)
            if not m:
                return None
            p, scanned = m.start(), True
    return None


def gif(b: bytes, at: int) -> Media | None:
    if len(b) < at + 13:
        return None
    width, height, flags = struct.unpack_from("<HHB", b, at + 6)
    if not width or not height:
        return None
    p, pictures = at + 13 + (3 << (flags & 7) + 1 if flags & 128 else 0), 0

    def blocks(p: int) -> int | None:
        while p < len(b):
            if not b[p]:
                return p + 1
            p += 1 + b[p]
        return None

    while p is not None and p < len(b):
        kind = b[p]
        if kind == 0x3B:
            return Media("gif", at, p + 1 - at, b[at + 13 : p + 1]) if pictures else None
        if kind == 0x21:
            p = blocks(p + 2)
        elif kind == 0x2C and p + 10 <= len(b):
            x, y, w, h, own = struct.unpack_from("<HHHHB", b, p + 1)
            if not w or not h or x + w > width or y + h > height:
                return None
            p += 10 + (3 << (own & 7) + 1 if own & 128 else 0)
            if p >= len(b) or not 2 <= b[p] <= 11:
                return None
            p, pictures = blocks(p + 1), pictures + 1
        else:
            return None
    return None


def _ogg_table() -> list[int]:
    out = []
    for i in range(256):
        r = i << 24
        for _ in range(8):
            r = (r << 1 ^ (0x04C11DB7 if r & 1 << 31 else 0)) & 0xFFFFFFFF
        out.append(r)
    return out


_OGG = _ogg_table()


def _ogg_sum(page: bytes) -> int:
    r = 0
    for x in page:
        r = (r << 8 & 0xFFFFFFFF) ^ _OGG[r >> 24 ^ x]
    return r


def ogg(b: bytes, at: int) -> Media | None:
    """Pages up to the last one of all streams that have begun; each has a check sum."""
    p, open_, begun = at, set(), set()
    while p + 27 <= len(b) and b[p : p + 5] == b"OggS\0":
        flags, _, serial, _, checked, n = struct.unpack_from("<BqIIIB", b, p + 5)
        table = b[p + 27 : p + 27 + n]
        size = 27 + n + sum(table)
        if len(table) < n or p + size > len(b):
            return None
        page = b[p : p + size]
        if _ogg_sum(page[:22] + b"\0\0\0\0" + page[26:]) != checked:
            return None
        if flags & 2:
            if serial in begun:
                return None
            open_.add(serial)
            begun.add(serial)
        elif serial not in open_:
            return None
        if flags & 4:
            open_.discard(serial)
        p += size
        if not open_:
            return Media("ogg", at, p - at, b[at + 27 + b[at + 26] : p])
    return None


#: Boxes that a film's top level holds.
BOXES = {b"ftyp", b"moov", b"mdat", b"free", b"skip", b"wide", b"moof", b"mfra", b"sidx", b"styp", b"meta", b"uuid", b"pdin", b"udta", b"emsg", b"ssix", b"prft"}


def mp4(b: bytes, at: int) -> Media | None:
    """Boxes as long as they are known; `at` is where the first one's name stands, after its length."""
    start = p = at - 4
    if start < 0 or struct.unpack_from(">I", b, start)[0] not in range(16, 1 << 12) or struct.unpack_from(">I", b, start)[0] % 4:
        return None
    if not re.fullmatch(rb"[ -~]{4}", b[at + 4 : at + 8]):
        return None
    seen = []
    while p + 8 <= len(b) and b[p + 4 : p + 8] in BOXES and not (seen and b[p + 4 : p + 8] == b"ftyp"):
        n, head = struct.unpack_from(">I", b, p)[0], 8
        if n == 1:
            if p + 16 > len(b):
                return None
            n, head = struct.unpack_from(">Q", b, p + 8)[0], 16
        elif n == 0:
            n = len(b) - p
        if n < head or p + n > len(b):
            return None
        seen.append(b[p + 4 : p + 8])
        p += n
    return Media("mp4", start, p - start, b[start:p]) if b"moov" in seen and (b"mdat" in seen or b"moof" in seen) else None


_END = re.compile(rb"startxref\s+(\d{1,15})\s+%%EOF(?:\r\n|\r|\n)?")
_OBJECT = re.compile(rb"\s*(?:xref\s|\d+\s+\d+\s+obj\b)")


def pdf(b: bytes, at: int) -> Media | None:
    """Up to the last end whose cross references are where it says, and before another document begins."""
    if not re.match(rb"%PDF-\d\.\d", b[at : at + 8]):
        return None
    limit = b.find(b"%PDF-", at + 5)
    end = None
    for m in _END.finditer(b, at, len(b) if limit < 0 else limit):
        place = at + int(m[1])
        if place < m.start() and _OBJECT.match(b, place):
            end = m.end()
    return None if end is None else Media("pdf", at, end - at, b[at:end])


#: The signatures, each with its validator.
SIGNATURES = {b"RIFF": riff, b"BM": bmp, b"P6": ppm, b"\x89PNG\r\n\x1a\n": png, b"\xff\xd8\xff": jpeg, b"GIF87a": gif, b"GIF89a": gif, b"OggS": ogg, b"ftyp": mp4, b"%PDF-": pdf}
