"""Files made by independent code, whole, cut, altered, nested and among other bytes."""

import random
import struct
import zlib

import pytest

from landfold.llm import formats, media

RNG = random.Random(3)


def noise(n, rng=RNG):
    return bytes(rng.choice(b"abcdefgh0123 \n\x00\x01\x02\xff") for _ in range(n))


def png(width, height, depth, colour, filters, interlaced=0, idats=2):
    """Filters rows as the format says, from pixels that are made up."""
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
    step = max(1, channels * depth // 8)
    passes = [(0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2)] if interlaced else [(0, 0, 1, 1)]
    lines, pixels, k = b"", b"", 0
    for x0, y0, dx, dy in passes:
        w, h = len(range(x0, width, dx)), len(range(y0, height, dy))
        if not w or not h:
            continue
        stride, above = -(-w * channels * depth // 8), None
        for _ in range(h):
            row, kind = bytes(RNG.randrange(256) for _ in range(stride)), filters[k % len(filters)]
            k += 1
            up = above or bytes(stride)
            out = []
            for i, v in enumerate(row):
                a = row[i - step] if i >= step else 0
                c = up[i - step] if i >= step else 0
                if kind == 4:
                    p = a + up[i] - c
                    pa, pb, pc = abs(p - a), abs(p - up[i]), abs(p - c)
                    guess = a if pa <= pb and pa <= pc else up[i] if pb <= pc else c
                else:
                    guess = [0, a, up[i], (a + up[i]) >> 1][kind]
                out.append((v - guess) % 256)
            lines += bytes([kind]) + bytes(out)
            pixels += row
            above = row
    chunk = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    packed = zlib.compress(lines)
    cut = len(packed) // idats
    parts = [packed[i * cut : (i + 1) * cut if i < idats - 1 else None] for i in range(idats)]
    body = chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, depth, colour, 0, 0, interlaced)) + (chunk(b"PLTE", bytes(768)) if colour == 3 else b"") + chunk(b"tEXt", b"k\0v")
    return b"\x89PNG\r\n\x1a\n" + body + b"".join(chunk(b"IDAT", p) for p in parts) + chunk(b"IEND", b""), pixels


def wav(bits=16, channels=2, extra=b""):
    data = noise(44)
    fmt = struct.pack("<HHIIHH", 1, channels, 44100, 44100 * channels * bits // 8, channels * bits // 8, bits)
    body = b"WAVE" + b"fmt " + struct.pack("<I", 16) + fmt + extra + b"data" + struct.pack("<I", len(data)) + data
    return b"RIFF" + struct.pack("<I", len(body)) + body


def webp(kind=b"VP8L"):
    data = b"\x2f" + noise(20) if kind == b"VP8L" else b"\x10\x00\x00\x9d\x01\x2a\x10\x00\x10\x00" + noise(9)
    body = b"WEBP" + kind + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def bmp(bits, width=5, height=-3):
    palette = (1 << bits) * 4 if bits <= 8 else 0
    pixels = noise((width * bits + 31) // 32 * 4 * abs(height))
    offset = 54 + palette
    return b"BM" + struct.pack("<IHHI", offset + len(pixels), 0, 0, offset) + struct.pack("<IiiHHIIiiII", 40, width, height, 1, bits, 0, 0, 0, 0, 0, 0) + bytes(palette) + pixels


def jpeg(progressive=False):
    seg = lambda mark, data: b"\xff" + bytes([mark]) + struct.pack(">H", len(data) + 2) + data
    frame = seg(0xC2 if progressive else 0xC0, struct.pack(">BHHB", 8, 16, 24, 1) + b"\x01\x11\x00")
    scan = lambda: seg(0xDA, b"\x01\x01\x00\x00\x3f\x00") + b"ab\xff\x00cd\xff\xd0ef\xff\xff\xd1gh"
    thumb = seg(0xE1, b"Exif\0\0" + b"\xff\xd8\xff\xe0 no picture \xff\xd9")
    return b"\xff\xd8" + seg(0xE0, b"JFIF\0") + thumb + seg(0xDB, bytes(65)) + frame + scan() + (seg(0xC4, bytes(9)) + scan() if progressive else b"") + b"\xff\xff\xd9"


def gif(version=b"89a", local=False):
    out = b"GIF" + version + struct.pack("<HHBBB", 4, 4, 0x80 | 1, 0, 0) + bytes(3 * 4) + b"\x21\xf9\x04\x00\x01\x00\x00\x00" + b"\x21\xfe\x03abc\x00"
    for _ in range(2):
        out += b"\x2c" + struct.pack("<HHHHB", 0, 0, 4, 4, 0x80 if local else 0) + (bytes(6) if local else b"") + b"\x02" + b"\x03\x3b\x3b\x3b" + b"\x02ab" + b"\x00"
    return out + b"\x3b"


def ogg(serials=(7,), pages=3):
    def page(flags, serial, number, data):
        table = bytes([255] * (len(data) // 255) + [len(data) % 255])
        raw = b"OggS\0" + struct.pack("<BqIII", flags, 0, serial, number, 0) + bytes([len(table)]) + table + data
        r = 0
        for x in raw:  # bit after bit
            r ^= x << 24
            for _ in range(8):
                r = r << 1 ^ 0x104C11DB7 if r >> 31 else r << 1
        return raw[:22] + struct.pack("<I", r) + raw[26:]

    out = b"".join(page(2, s, 0, b"\x01vorbis" + noise(9)) for s in serials)
    for n in range(1, pages):
        out += b"".join(page(4 if n == pages - 1 else 0, s, n, noise(300)) for s in serials)
    return out


def mp4(fragmented=False, big=False):
    box = lambda name, data: struct.pack(">I", 8 + len(data)) + name + data
    data = struct.pack(">I", 1) + b"mdat" + struct.pack(">Q", 16 + 30) + noise(30) if big else box(b"mdat", noise(33))
    return box(b"ftyp", b"isom\0\0\2\0isomavc1") + box(b"free", b"") + box(b"moov", box(b"mvhd", bytes(100))) + (box(b"moof", bytes(16)) if fragmented else b"") + data


def pdf(updates=0):
    out = b"%PDF-1.4\n%\xe2\xe3\xcf\xd3\n1 0 obj\n<<>>\nendobj\n"
    for _ in range(1 + updates):
        out += b"xref\n0 1\n0000000000 65535 f \ntrailer\n<<>>\nstartxref\n%d\n%%%%EOF\n" % len(out)
    return out


def examples():
    for depth, colour in ((8, 2), (1, 0), (2, 0), (16, 0), (8, 6), (16, 6), (8, 4), (4, 3), (8, 3), (16, 2)):
        for filters, interlaced in (((0,), 0), ((1, 2, 3, 4, 0), 0), ((4, 3), 1)):
            yield "png", png(9, 7, depth, colour, filters, interlaced)[0]
    yield from (("png", png(1, 1, 8, 2, (4,), 1)[0]), ("wav", wav()), ("wav", wav(8, 1, b"LIST\x04\x00\x00\x00abcd")), ("webp", webp()), ("webp", webp(b"VP8 ")))
    yield from (("bmp", bmp(b)) for b in (1, 4, 8, 24, 32))
    yield from (("ppm", b"P6 # note\n3 2 255\n" + noise(18)), ("ppm", b"P6\n2 1\n65535\n" + noise(12)), ("jpeg", jpeg()), ("jpeg", jpeg(True)), ("gif", gif()), ("gif", gif(b"87a", True)))
    yield from (("ogg", ogg()), ("ogg", ogg((7, 9))), ("mp4", mp4()), ("mp4", mp4(True)), ("mp4", mp4(big=True)), ("pdf", pdf()), ("pdf", pdf(2)))


FILES = list(examples())


@pytest.mark.parametrize("n", range(len(FILES)))
def test_files_whole_cut_and_altered(n):
    kind, blob = FILES[n]
    assert [(m.kind, m.start, m.length) for m in media.sniff(blob)] == [(kind, 0, len(blob))]
    lead, tail = noise(37), b"gh 0123"
    assert [(m.kind, m.start, m.length) for m in media.sniff(lead + blob + tail)] == [(kind, 37, len(blob))]
    for cut in sorted({1, 2, 9, len(blob) // 2}):
        got = media.sniff(blob[:-cut])
        # what an update added can be missing, and the rows of a picture be fewer than its file
        assert all(m.kind == "pdf" for m in got) and all(m.length <= len(blob) - cut for m in got)


def test_pixels_are_unfiltered():
    for depth, colour in ((8, 2), (16, 6), (4, 3), (8, 0)):
        for interlaced in (0, 1):
            blob, pixels = png(11, 6, depth, colour, (1, 2, 3, 4, 0), interlaced, 3)
            assert media.sniff(blob)[0].payload == pixels


def test_random_blobs_hold_what_was_put_in():
    rng = random.Random(5)
    for _ in range(60):
        blob, want = b"", []
        for _ in range(rng.randint(0, 5)):
            kind, one = rng.choice(FILES)
            if rng.random() < 0.3 and kind in ("png", "ogg"):
                one = one[: len(one) // 3]  # a file that breaks off; without check sums it could take what follows for its own
                kind = None
            blob += noise(rng.randint(0, 30), rng)
            if kind:
                want.append((kind, len(blob), len(one)))
            blob += one
        blob += noise(rng.randint(0, 30), rng)
        got = [(m.kind, m.start, m.length) for m in media.sniff(blob)]
        assert got == want


def test_flipped_bytes_are_seen_where_the_format_checks():
    for kind, blob in FILES:
        if kind in ("png", "ogg"):
            for at in (len(blob) // 2, len(blob) - 20):
                assert not any(m.start == 0 for m in media.sniff(blob[:at] + bytes([blob[at] ^ 1]) + blob[at + 1 :]))


def test_files_within_files_are_the_outer_ones():
    inner = jpeg()
    outer = pdf().replace(b"<<>>\nendobj\n", b"<<>>" + inner + b"\nendobj\n", 1)
    at = outer.index(b"xref\n0 1")
    outer = outer.replace(b"startxref\n%d" % (at - len(inner)), b"startxref\n%d" % at)
    assert [(m.kind, m.length) for m in media.sniff(outer + gif())] == [("pdf", len(outer)), ("gif", len(gif()))]
    broken = outer.replace(b"startxref", b"startxxxx")
    assert [(m.kind, m.length) for m in media.sniff(broken)] == [("jpeg", len(inner))]


def test_nothing_unpacks_without_bound():
    assert formats._pixels((1 << 30, 1 << 30, 8, 2, 0, 0, 0), zlib.compress(bytes(1000)), False) is None


def test_declared_types_are_corrected(spark):
    rows = [(i, bytearray(blob), "text/plain", "x") for i, (_, blob) in enumerate(FILES)] + [(900, bytearray(b"plain"), "text/plain", "x"), (901, None, None, "x"), (902, bytearray(b""), "a", "x"), (903, bytearray(b"zz" + gif() + jpeg()), "b", "x")]
    got = {r.id: r for r in media.sniff_column(spark.createDataFrame(rows, "id int, b binary, d string, kind string"), "b", "d").collect()}
    assert [got[i].corrected_type for i in range(len(FILES))] == [k for k, _ in FILES]
    assert [(got[i].corrected_type, len(got[i].media or [])) for i in (900, 901, 902, 903)] == [("text/plain", 0), (None, 0), ("a", 0), ("b", 2)]
    assert [bytes(m.content) for m in got[903].media] == [gif(), jpeg()] and got[901].media is None
