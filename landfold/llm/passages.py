"""Fuzzy passages that documents share, by collinear chaining of k-mer seeds.

Seeds are minimizers of word k-mers, of two lengths: K words for passages with edits, LONG words for exact ones. Each
occurrence of a seed is joined to the first one and to the one before it, never to all others. Matches of two documents are
chained in order with gap costs, by a Fenwick tree over the places in the earlier document. Chains are then aligned word by
word, reaching out beyond both ends, and kept if they have LEAST_WORDS words of which LEAST_SHARE agree.

A run of LONG + LONG_WINDOW - 1 equal words always has a LONG seed in common, and one such seed is a chain. So a text with
copies in many documents is linked to others that have it, whatever else its short k-mers occur in: it is reported against
the first and the preceding one; all of them are linked, and not in pairs. Passages with edits need LEAST_SEEDS short seeds
with the same partner, over LEAST_SPAN words at least; those whose short k-mers are all frequent elsewhere may be missed (see README for recall).

A row is a passage: doc_id, start_word, n_words, and the same in source_doc_id, which comes earlier; n_equal words agree.
A chain is aligned in parts where it drifts by more than MOST_DRIFT words or is longer than MOST_WORDS; parts overlap, and
each is a row.

Defined results: words are parted by U+0020 and U+0009..U+000D, A-Z in lower case; null, empty and short texts have no
passages; rows with a null doc_id take no part; of rows that repeat a doc_id only the one first in text order counts;
repeats within a document are not passages. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bloom import bloom, probe
from .common import cut, partitions, small_batches, utf8

K, WINDOW, LEAST_SEEDS, LEAST_SPAN, LONG, LONG_WINDOW = 5, 5, 2, 9, 20, 24
LEAST_WORDS, LEAST_SHARE = 50, 0.8
#: Words that an alignment reaches beyond a chain, its band around the chain's diagonals, and the cost of a word of gap in a chain.
REACH, BAND, GAP = 64, 12, 0.1
#: Chains that drift or reach further are aligned in parts.
MOST_DRIFT, MOST_WORDS = 64, 50_000
#: Steps that an alignment of several pairs keeps, at most (a longer pair goes alone).
STEP_CELLS = 4 << 20
#: Of which so many are compared at once.
ROW_CELLS = 1 << 18
#: Text whose seeds are sorted at once, and spans that are cut from one copy of a text.
CHUNK_BYTES, SPANS = 4 << 20, 1_000
SEEDS = "h long, doc long, place int, source long, source_place int"
_ODD = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(text: str | None) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    words = utf8(text).lower().split()
    return np.fromiter(map(digest, words), np.uint64, len(words))


def kmers(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive words."""
    n = max(0, len(words) - k + 1)
    h = np.zeros(n, np.uint64)
    for i in range(k):
        h ^= words[i : i + n]
        h *= _ODD
        h ^= h >> np.uint64(29)
    return h


def minimizers(h: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the k-mer (of those hashed in h) that is smallest among each `window` consecutive ones (fewer than
    256). Where one k-mer is chosen over and over in a row (a word said many times), only its first and last place in the row count."""
    if not len(h):
        return np.empty(0, np.int32), np.empty(0, np.uint64)
    n = len(h)
    width, low = min(n, window), np.uint64(255)
    least = (h & ~low) | (np.arange(n, dtype=np.uint64) & low)
    have = 1
    while have < width:  # each step looks at up to twice as many
        step = min(have, width - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    start = np.arange(len(least), dtype=np.int64)
    at = start + (((least & low).astype(np.int64) - start) & 255)  # never goes back
    at = at[np.concatenate([[True], at[1:] != at[:-1]])]
    same = h[at[1:]] == h[at[:-1]]
    at = at[~(np.concatenate([[False], same]) & np.concatenate([same, [False]]))]
    return at.astype(np.int32), h[at]


def seeds_of_all(each: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and hashes of the seeds of each text, given its words; the lowest bit of a hash tells LONG ones. The texts' k-mers are hashed together."""
    words, at = np.concatenate([np.empty(0, np.uint64), *each]), 0
    short_hashes, long_hashes = kmers(words, K), kmers(words, LONG)
    for n in map(len, each):
        short, long = minimizers(short_hashes[at : at + max(0, n - K + 1)], WINDOW), minimizers(long_hashes[at : at + max(0, n - LONG + 1)], LONG_WINDOW)
        yield np.concatenate([short[0], long[0]]), np.concatenate([short[1] & ~np.uint64(1), long[1] | np.uint64(1)])
        at += n


def seeds(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return next(seeds_of_all([words]))


def _length(h: np.ndarray) -> np.ndarray:
    return np.where(h.view(np.uint64) & np.uint64(1), LONG, K).astype(np.int64)


def _link(h: np.ndarray, d: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Rows (doc, place, source, source_place, k) from sorted seeds: each occurrence with the first of its hash, and with the last one in an earlier document."""
    if not len(h):
        return np.empty((0, 5), np.int64)
    first = np.concatenate([[True], h[1:] != h[:-1]])
    head = np.maximum.accumulate(np.where(first, np.arange(len(h)), 0))
    turn = np.concatenate([[True], (h[1:] != h[:-1]) | (d[1:] != d[:-1])])  # a document's first occurrence
    start = np.maximum.accumulate(np.where(turn, np.arange(len(h)), 0))
    later, k = d != d[head], _length(h)
    before = np.where(later, start - 1, 0)
    both = [np.stack([d[m], p[m], d[src[m]], p[src[m]], k[m]], 1) for m, src in ((later, head), (later & (before != head) & (d[before] != d[head]), before))]
    return np.concatenate(both).astype(np.int64)


def _packed(x: np.ndarray) -> list[pa.Array]:
    """Links as columns; LONG ones have a negative source_place."""
    place = np.where(x[:, 4] == LONG, ~x[:, 3], x[:, 3]).astype(np.int32)
    return [pa.array(x[:, 0]), pa.array(x[:, 1].astype(np.int32)), pa.array(x[:, 2]), pa.array(place)]


def _chunk_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of bounded runs of documents: the links within the run, and each seed's first and last occurrence, which go on to meet other runs."""
    docs, places, hashes, size = [], [], [], 0
    names = ["h", "doc", "place", "source", "source_place"]

    def flush() -> Iterator[pa.RecordBatch]:
        turn = sorted(range(len(docs)), key=docs.__getitem__)
        h, p = (np.concatenate([x[i] for i in turn]) for x in (hashes, places))
        d = np.repeat(np.array([docs[i] for i in turn], np.int64), [len(places[i]) for i in turn])
        order = np.argsort(h, kind="stable")  # documents are in order, and so are the places of each kind of seed
        h, d, p = h[order], d[order], p[order]
        ends = np.concatenate([[True], h[1:] != h[:-1]]) | np.concatenate([h[1:] != h[:-1], [True]]) if len(h) else np.empty(0, bool)
        none = pa.nulls(int(ends.sum()), pa.int64()), pa.nulls(int(ends.sum()), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(h[ends].view(np.int64)), pa.array(d[ends]), pa.array(p[ends]), *none], names)
        links = _link(h, d, p)
        yield pa.RecordBatch.from_arrays([pa.array((links[:, 0].view(np.uint64) * _ODD).view(np.int64)), *_packed(links)], names)

    for b in batches:
        texts = b.column("text").to_pylist()
        for i, t, (at, h) in zip(b.column("doc_id").to_pylist(), texts, seeds_of_all([word_hashes(t) for t in texts]), strict=True):
            docs.append(i)
            places.append(at)
            hashes.append(h)
            size += len(t)
            if size > CHUNK_BYTES:
                yield from flush()
                docs, places, hashes, size = [], [], [], 0
    if docs:
        yield from flush()


def _far_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between runs, beside those that are links already. Rows come sorted by h, doc, place; all that is held of a hash is its first and last occurrence so far."""
    held = None  # (h, first doc, first place, last doc, last place)
    for b in batches:
        known = ~b.column("source").is_null().to_numpy(zero_copy_only=False)
        yield b.filter(pa.array(known)).select(["doc", "place", "source", "source_place"])
        h, d, p = (b.column(n).to_numpy()[~known] for n in ("h", "doc", "place"))
        if not len(h):
            continue
        pre = [] if held is None else [(held[0], held[1], held[2]), (held[0], held[3], held[4])]
        h2, d2, p2 = (np.concatenate([np.array([x[i] for x in pre], a.dtype), a]) for i, a in enumerate((h, d, p)))
        n = len(pre)
        out = _link(h2, d2, p2)
        if n:  # those between what was held are known already
            known = _link(h2[:n], d2[:n], p2[:n])
            out = out[~(out[:, None] == known[None]).all(2).any(1)] if len(known) else out
        yield pa.RecordBatch.from_arrays(_packed(out), ["doc", "place", "source", "source_place"])
        lead = np.flatnonzero(h2 == h2[-1])[0]
        held = (h2[-1], d2[lead], p2[lead], d2[-1], p2[-1])


class Fenwick:
    """Largest value, with its owner, over a prefix."""

    def __init__(self, n: int):
        self.value, self.owner = [-1e18] * (n + 1), [-1] * (n + 1)

    def put(self, i: int, value: float, owner: int) -> None:
        i += 1
        while i < len(self.value):
            if value > self.value[i]:
                self.value[i], self.owner[i] = value, owner
            i += i & -i

    def get(self, i: int) -> tuple[float, int]:
        """Over the places before i."""
        value, owner = -1e18, -1
        while i:
            if self.value[i] > value:
                value, owner = self.value[i], self.owner[i]
            i -= i & -i
        return value, owner


Chain = tuple[int, int, int, int, int, int]


def chains(p: np.ndarray, q: np.ndarray, k: np.ndarray, gap: float = GAP) -> list[Chain]:
    """Collinear chains of matches of k words at p and q (sorted by p, then q): see _parts_of.

    A match adds k; a step costs gap for each word it goes on, halved over both documents. A chain starts afresh where
    that is better. Best chains come first, and each match is in one.
    """
    n, walk = len(p), gap / 2 * (p + q)
    if n == 1 or (np.diff(p) > 0).all() and (np.diff(q) > 0).all():  # all in order: costs add up, so no match is left out
        steps, gains, cuts, value = np.diff(walk, prepend=walk[0]).tolist(), k.tolist(), [], 0.0
        for i, (step, gain) in enumerate(zip(steps, gains, strict=True)):
            value -= step
            if value <= 0:
                cuts.append(i)
                value = 0.0
            value += gain
        return [c for a, b in zip(cuts, [*cuts[1:], n], strict=True) for c in _parts_of(p[a:b], q[a:b], k[a:b])]
    rank = np.unique(q, return_inverse=True)[1].tolist()
    tree, score, back = Fenwick(max(rank) + 1), [0.0] * n, [-1] * n
    pl, far, kl = p.tolist(), walk.tolist(), k.tolist()
    i = 0
    while i < n:
        j = i
        while j < n and pl[j] == pl[i]:  # matches of one place don't follow each other
            value, owner = tree.get(rank[j])
            value -= far[j]
            score[j], back[j] = (kl[j] + value, owner) if value > 0 else (float(kl[j]), -1)
            j += 1
        for m in range(i, j):
            tree.put(rank[m], score[m] + far[m], m)
        i = j
    used, out = [False] * n, []
    for end in sorted(range(n), key=lambda m: -score[m]):
        if used[end]:
            continue
        at, members = end, []
        while at >= 0 and not used[at]:
            used[at] = True
            members.append(at)
            at = back[at]
        out.extend(_parts_of(p[members[::-1]], q[members[::-1]], k[members[::-1]]))
    return out


def _parts_of(p: np.ndarray, q: np.ndarray, k: np.ndarray) -> Iterator[Chain]:
    """A chain that suffices, in parts whose diagonals and length suit an alignment in bounded memory: first and last places in both, the spread of the diagonals, and the words of its seeds."""
    if k.sum() < LEAST_SEEDS * K or (p + k).max() - p[0] < LEAST_SPAN:
        return
    diagonal, at = q - p, 0
    while at < len(p):
        low, high = np.minimum.accumulate(diagonal[at:]), np.maximum.accumulate(diagonal[at:])
        over = np.flatnonzero((high - low > MOST_DRIFT) | (p[at:] - p[at] > MOST_WORDS))
        end = at + int(over[0]) if len(over) else len(p)
        yield int(p[at]), int((p + k)[at:end].max()), int(q[at]), int((q + k)[at:end].max()), int((high - low)[end - at - 1]), int(k[at:end].sum())
        at = end


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Matches of each pair of documents with enough seeds; rows come sorted by doc, source, place."""
    held = [np.empty(0, np.int64)] * 4

    def split(cols):
        d, s, p, q = cols
        edge = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (s[1:] != s[:-1])]))
        size = np.diff(np.append(edge, len(d)))
        weight = np.add.reduceat(np.where(q < 0, LONG, K), edge)
        for at, n in zip(edge[weight >= LEAST_SEEDS * K].tolist(), size[weight >= LEAST_SEEDS * K].tolist(), strict=True):
            q_, k = q[at : at + n], np.where(q[at : at + n] < 0, LONG, K)
            p_, q_ = p[at : at + n], np.where(q_ < 0, ~q_, q_)
            order = np.lexsort((-k, q_, p_))
            p_, q_, k = p_[order], q_[order], k[order]
            own = np.concatenate([[True], (p_[1:] != p_[:-1]) | (q_[1:] != q_[:-1])])
            if k[own].sum() >= LEAST_SEEDS * K:
                yield int(d[at]), int(s[at]), p_[own], q_[own], k[own]

    for b in batches:
        cols = [np.concatenate([x, b.column(n).to_numpy().astype(np.int64)]) for x, n in zip(held, ("doc", "source", "place", "source_place"), strict=True)]
        if not len(cols[0]):
            continue
        same = (cols[0] == cols[0][-1]) & (cols[1] == cols[1][-1])
        last = 0 if same.all() else len(same) - int(np.argmin(same[::-1]))
        if last:
            yield from split([c[:last] for c in cols])
        held = [c[last:] for c in cols]
    if len(held[0]):
        yield from split(held)


CHAIN = "doc long, source long, p0 int, p1 int, q0 int, q1 int, spread int, seeded int"


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []

    def made() -> pa.RecordBatch:
        x = np.array(rows, np.int64).reshape(-1, 8)
        return pa.RecordBatch.from_arrays([pa.array(x[:, i]) if i < 2 else pa.array(x[:, i].astype(np.int32)) for i in range(8)], [c.split()[0] for c in CHAIN.split(", ")])

    for d, s, p, q, k in _groups(batches):
        rows.extend((d, s, *c) for c in chains(p, q, k))
        if len(rows) > 5_000:
            yield made()
            rows = []
    yield made()


Job = tuple[np.ndarray, np.ndarray, int, int]
Found = tuple[int, int, int, int, int]


def _one_diagonal(job: Job) -> Found | None:
    """The alignment where a single diagonal has almost all of it."""
    a, b, shift, spread = job
    lo, hi = max(0, -shift), min(len(a), len(b) - shift)
    if hi <= lo:
        return None
    eq = a[lo:hi] == b[lo + shift : hi + shift]
    run = np.cumsum(np.where(eq, 1, -1))
    low = np.minimum.accumulate(np.concatenate([[0], run[:-1]]))
    end = int(np.argmax(run - low))
    start = int(np.argmin(np.concatenate([[0], run[:end]])))
    equal, n = int(eq[start : end + 1].sum()), end + 1 - start
    if equal >= 0.95 * max(len(a), len(b)) or (n >= 0.9 * (hi - lo) and equal >= 0.9 * n and not spread):
        return lo + start, n, lo + start + shift, n, equal
    return None


def _banded(jobs: list[Job], ways: list[bytes] | None = None) -> list[Found | None]:
    """Banded local alignment of several pairs at once, a word of each per step. ways: gets the kinds of each one's steps."""
    n, rows, width = len(jobs), max(len(a) for a, *_ in jobs), BAND + max(j[3] for j in jobs)
    w = 2 * width + 1
    left, right = np.zeros((n, rows), np.uint64), np.zeros((n, rows + w), np.uint64)
    valid = np.zeros((n, rows + w), bool)
    for k, (a, b, shift, _) in enumerate(jobs):
        left[k, : len(a)] = a
        first = width - shift  # where b[0] stands
        lo, hi = max(0, first), min(rows + w, first + len(b))
        if hi > lo:
            right[k, lo:hi], valid[k, lo:hi] = b[lo - first : hi - first], True
    # scores of all rows are kept; which step led to each is asked of those on the way back only
    kind = np.int16 if rows + w < 1 << 14 else np.int32
    sizes, ramp = np.array([len(a) for a, *_ in jobs]), np.arange(w, dtype=kind)
    scores = np.zeros((n, rows + 1, w), kind)
    windows, within = (np.lib.stride_tricks.sliding_window_view(x, w, axis=1) for x in (right, valid))
    for at in range(0, rows, block := max(1, ROW_CELLS // (n * w))):
        some = slice(at, min(at + block, rows))
        inside = -(within[:, some] & (np.arange(some.start, some.stop) < sizes[:, None])[:, :, None]).astype(kind)
        gain = (windows[:, some] == left[:, some, None]).astype(kind) * kind(2)
        for i in range(some.stop - at):
            less = scores[:, at + i] - kind(1)
            best = less + gain[:, i]
            np.maximum(best[:, :-1], less[:, 1:], out=best[:, :-1])
            np.maximum(best, 0, out=best)
            best &= inside[:, i]
            best += ramp
            np.maximum.accumulate(best, axis=1, out=best)  # words of the other text left out
            best -= ramp
            np.bitwise_and(best, inside[:, i], out=scores[:, at + i + 1])
    out: list[Found | None] = []
    ways = [] if ways is None else ways
    for k, (a, b, shift, _) in enumerate(jobs):
        i, c = divmod(int(scores[k].argmax()), w)
        own = memoryview(scores[k].reshape(-1))
        if own[i * w + c] <= 0:
            out.append(None)
            ways.append(b"")
            continue
        equal, kinds, first, a, b = 0, bytearray(), width - shift, a.tolist(), b.tolist()
        end_a, end_b = i, i + c - width + shift
        while (score := own[i * w + c]) > 0:
            same = a[i - 1] == b[i - 1 + c - first]
            both = own[(i - 1) * w + c] + (1 if same else -1)
            best = max(both, own[(i - 1) * w + c + 1] - 1 if c + 1 < w else -1, 0)
            if score > best:
                kinds.append(3)
                c -= 1
            elif best == both:
                kinds.append(1 if same else 4)
                equal += same
                i -= 1
            else:
                kinds.append(2)
                i, c = i - 1, c + 1
        start_b = i + c - width + shift
        out.append((i, end_a - i, start_b, end_b - start_b, equal))
        ways.append(bytes(kinds[::-1]))
    return out


def _within_reach(job: Job) -> np.ndarray:
    """Which words of the first text occur anywhere within the band in the other: no alignment has more equal words."""
    a, b, shift, spread = job
    width = BAND + spread
    around = np.full(len(a) + 2 * width, ~np.uint64(0))
    lo, hi = max(0, width - shift), min(len(around), width - shift + len(b))
    if hi > lo:
        around[lo:hi] = b[lo + shift - width : hi + shift - width]
    return (np.lib.stride_tricks.sliding_window_view(around, 2 * width + 1) == a[:, None]).any(axis=1)


def _hopeless(near: np.ndarray) -> bool:
    """Whether no LEAST_WORDS words or more in a row have LEAST_SHARE within reach, so that no alignment can suffice."""
    if len(near) < LEAST_WORDS:
        return True
    gain = np.concatenate([[0.0], np.cumsum(np.where(near, 1 - LEAST_SHARE, -LEAST_SHARE))]).round(6)
    return not (gain[LEAST_WORDS:] >= np.minimum.accumulate(gain)[: len(gain) - LEAST_WORDS]).any()


def _straight(job: Job, near: np.ndarray) -> Found | None:
    """The best stretch of a single diagonal, where no alignment with gaps can be better: that would have to leave the
    diagonal, and come back or not, at a cost of 1 at least, for equal words that are within reach at all."""
    a, b, shift, _ = job
    lo, hi = max(0, -shift), min(len(a), len(b) - shift)
    if hi <= lo:
        return None
    equal = np.zeros(len(a), bool)
    equal[lo:hi] = a[lo:hi] == b[lo + shift : hi + shift]
    run = np.cumsum(np.where(equal, 1, -1))
    low = np.minimum.accumulate(np.concatenate([[0], run[:-1]]))
    end = int(np.argmax(run - low))
    start = int(np.argmin(np.concatenate([[0], run[:end]])))
    most = np.cumsum(np.where(near, 1, -1))
    bound = int((most - np.minimum.accumulate(np.concatenate([[0], most[:-1]]))).max())
    if bound - 1 > run[end] - low[end]:
        return None
    return start, end + 1 - start, start + shift, end + 1 - start, int(equal[start : end + 1].sum())


def align(jobs: list[Job], ways: dict[int, bytes] | None = None) -> list[Found | None]:
    """For each (a, b, shift, spread) the best local alignment of word hashes near the diagonal b = a + shift: start and
    length in both, and equal words. An equal word gains 1; one that differs, or is in one text only, costs 1. The band
    is BAND + spread to both sides. None where no alignment suffices. ways: gets the steps (1 equal, 4 differing, 2 and 3
    in the first or second text only) of those that may have gaps."""
    out: list[Found | None] = [_one_diagonal(j) for j in jobs]
    hopeful = [False] * len(jobs)
    for k, x in enumerate(out):  # what else there is in reach matters only where one diagonal doesn't have almost all
        if x is None:
            near = _within_reach(jobs[k])
            hopeful[k] = not _hopeless(near)
            out[k] = _straight(jobs[k], near) if hopeful[k] else None
    rest = sorted((k for k, x in enumerate(out) if x is None and hopeful[k]), key=lambda k: (jobs[k][3] // 16, len(jobs[k][0])))
    while rest:
        take = [rest.pop(0)]
        while rest and (len(take) + 1) * len(jobs[rest[0]][0]) * (2 * (BAND + max(jobs[k][3] for k in [*take, rest[0]])) + 1) <= STEP_CELLS and len(take) < 128:
            take.append(rest.pop(0))
        steps: list[bytes] = []
        for k, found, way in zip(take, _banded([jobs[k] for k in take], steps), steps, strict=True):
            out[k] = found
            if ways is not None:
                ways[k] = way
    return out


def _parts(found: Found, way: bytes) -> Iterator[Found]:
    """The parts of an alignment that suffice: the longest stretch with LEAST_SHARE of equal words, then those to both sides."""
    kind = np.frombuffer(way, np.uint8)
    equal = kind == 1
    at = [np.concatenate([[first], first + np.cumsum(kind != other)]) for first, other in ((found[0], 3), (found[2], 2))]
    gain = np.concatenate([[0.0], np.cumsum(np.where(equal, 1 - LEAST_SHARE, -LEAST_SHARE))]).round(6)
    todo = [(0, len(kind))]
    while todo:
        lo, hi = todo.pop()
        if hi - lo < LEAST_WORDS:
            continue
        own = gain[lo : hi + 1]
        start = np.searchsorted(-np.minimum.accumulate(own), -own)  # the first place from which the share is enough
        end = int(np.argmax(np.arange(len(own)) - start))
        same = np.flatnonzero(equal[lo + int(start[end]) : lo + end])
        if not len(same):
            continue
        i, j = lo + int(start[end]) + int(same[0]), lo + int(start[end]) + int(same[-1]) + 1
        part = int(at[0][i]), int(at[0][j] - at[0][i]), int(at[1][i]), int(at[1][j] - at[1][i]), len(same)
        if min(part[1], part[3]) >= LEAST_WORDS:
            yield part
        todo += [(lo, i), (j, hi)]


def _steps(found: Found, a: np.ndarray, b: np.ndarray) -> bytes:
    """The steps of an alignment without gaps."""
    same = a[found[0] : found[0] + found[1]] == b[found[2] : found[2] + found[1]]
    return np.where(same, 1, 4).astype(np.uint8).tobytes()


def shared(jobs: list[Job], spans: list[tuple[int, int]]) -> list[list[Found]]:
    """For each (a, b, shift, spread), whose seeds are in a from spans' first to second place, all its passages: of an
    alignment that has too few equal words the parts that have enough, and what is found among the seeds before and after it."""
    out: list[list[Found]] = [[] for _ in jobs]
    todo = [(k, j, 0, 0, *s) for k, (j, s) in enumerate(zip(jobs, spans, strict=True))]
    while todo:
        now, todo, ways = todo, [], {}
        for n, got in enumerate(align([x[1] for x in now], ways)):
            if not got:
                continue
            k, (a, b, shift, spread), a_at, b_at, lo, hi = now[n]
            if min(got[1], got[3]) >= LEAST_WORDS:
                enough = got[4] >= LEAST_SHARE * max(got[1], got[3])
                out[k] += [(a_at + p[0], p[1], b_at + p[2], *p[3:]) for p in ([got] if enough else _parts(got, ways[n] if n in ways else _steps(got, a, b)))]
            end, b_end = got[0] + got[1], got[2] + got[3]
            if lo < got[0] and min(got[0], got[2]) >= LEAST_WORDS:
                todo.append((k, (a[: got[0]], b[: got[2]], shift, spread), a_at, b_at, lo, min(hi, got[0])))
            if hi > end and min(len(a) - end, len(b) - b_end) >= LEAST_WORDS:
                todo.append((k, (a[end:], b[b_end:], shift + end - b_end, spread), a_at + end, b_at + b_end, max(lo - end, 0), hi - end))
    return out


OUT = "doc_id long, start_word int, n_words int, source_doc_id long, source_start_word int, source_n_words int, n_equal int"


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, tuple]]:
    """Both sides of each chain as (id, lo, hi, spread, at, words); rows come sorted by chain and side."""
    held = None
    for b in batches:
        fields = zip(*(b.column(n).to_pylist() for n in ("chain", "id", "lo", "hi", "spread", "at")), b.column("w"), strict=True)
        for chain, *rest, w in fields:
            now = (*rest, np.asarray(w.values).view(np.uint32).astype(np.uint64))
            if held and held[0] == chain:
                yield held[1], now
            held = chain, now


def _align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([(c.split()[0], pa.int64() if c.endswith("long") else pa.int32()) for c in OUT.split(", ")])
    pairs, together = _pairs(batches), 512
    while some := list(islice(pairs, together)):
        jobs, spans, rows = [], [], []
        for (_, p0, p1, spread, at, a), (_, q0, q1, _, bt, b) in some:
            drift = (q1 - p1) - (q0 - p0)
            jobs.append((a, b, (q0 - bt) - (p0 - at) + drift // 2, max(spread, abs(drift))))
            spans.append((p0 - at, p1 - at))
        for (one, two), passages in zip(some, shared(jobs, spans), strict=True):
            rows.extend((one[0], one[4] + got[0], got[1], two[0], two[4] + got[2], got[3], got[4]) for got in passages)
        x = np.array(rows, np.int64).reshape(-1, 7)
        yield pa.RecordBatch.from_arrays([pa.array(x[:, i]).cast(f.type) for i, f in enumerate(schema)], schema=schema)


def candidate_chains(docs: DataFrame) -> DataFrame:
    """CHAIN rows: chains of at least LEAST_SEEDS short seeds or one LONG seed."""
    n = partitions(docs, 2)
    link = "doc long, place int, source long, source_place int"
    links = docs.mapInArrow(_chunk_seeds, SEEDS).repartition(n, "h").sortWithinPartitions("h", "doc", "place").mapInArrow(_far_links, link)
    return links.repartition(n, "doc").sortWithinPartitions("doc", "source").mapInArrow(_chain, CHAIN)


SLICE = "chain long, side int, id long, lo int, hi int, spread int, at int, w array<int>"


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SLICE rows: each text is hashed once, and the spans that are wanted of it cut out, as 32-bit word hashes."""
    for b in batches:
        for i, t, spans in zip(b.column("id").to_pylist(), b.column("text").to_pylist(), b.column("spans"), strict=True):
            words = word_hashes(t).astype(np.uint32).view(np.int32)
            chain, side, lo, hi, spread = (np.asarray(spans.values.field(n)) for n in ("chain", "side", "lo", "hi", "spread"))
            at, end = np.maximum(lo - REACH, 0), np.minimum(hi + REACH, len(words))
            for x in range(0, len(lo), 64):
                s = slice(x, x + 64)
                parts = [words[u:v] for u, v in zip(at[s].tolist(), end[s].tolist(), strict=True)]
                ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(chain[s]), pa.array(side[s]), pa.array(np.full(len(parts), i)), pa.array(lo[s]), pa.array(hi[s]), pa.array(spread[s]), pa.array(at[s].astype(np.int32)), pa.ListArray.from_arrays(ends, np.concatenate(parts))], [c.split()[0] for c in SLICE.split(", ")])


def _id_hashes(ids: np.ndarray) -> np.ndarray:
    x = ids.astype(np.int64).view(np.uint64)
    x = (x ^ (x >> np.uint64(31))) * _ODD
    return np.stack([(x ^ (x >> np.uint64(29))).view(np.int64), ((x >> np.uint64(32)) | np.uint64(1)).view(np.int64)], 1)


def _single(docs: DataFrame) -> DataFrame:
    """doc_id, text: rows that take part, one for each doc_id. Texts move only where an id repeats."""
    docs = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    twice = cut(docs.groupBy("doc_id").count().where("count > 1").select("doc_id"))
    if twice.isEmpty():
        return docs
    return docs.join(twice, "doc_id", "left_anti").unionByName(docs.join(twice, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text")))


def fuzzy_passages(docs: DataFrame) -> DataFrame:
    """The passages (columns of OUT) that documents share with earlier ones."""
    small_batches(docs.sparkSession)
    docs = _single(docs)
    found = cut(candidate_chains(docs).withColumn("chain", F.monotonically_increasing_id()))
    side = lambda n, i, lo, hi: F.struct(F.lit(n).alias("side"), F.col(i).alias("id"), F.col(lo).alias("lo"), F.col(hi).alias("hi"))
    spans = found.select("chain", "spread", F.inline(F.array(side(0, "doc", "p0", "p1"), side(1, "source", "q0", "q1"))))
    # a text with very many chains is given to several tasks, SPANS chains each
    many = spans.groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") > SPANS).select("id", F.ceil(F.col("n") / SPANS).alias("parts"))
    dealt = spans.join(many, "id", "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("chain"), F.col("parts")), F.lit(0)))
    wanted = dealt.groupBy("id", "part").agg(F.collect_list(F.struct("chain", "side", "lo", "hi", "spread")).alias("spans"))

    @F.pandas_udf("struct<a: long, b: long>")
    def hashed(ids: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(_id_hashes(ids.to_numpy()), columns=["a", "b"])

    bits = docs.sparkSession.sparkContext.broadcast(bloom(spans.select("id").distinct().select(hashed("id").alias("h")).select("h.a", "h.b")))

    @F.pandas_udf("boolean")
    def maybe(ids: pd.Series) -> pd.Series:
        return pd.Series(probe(bits.value, _id_hashes(ids.to_numpy())))

    # most texts surely have no chain, and are not shuffled
    slices = wanted.join(docs.where(maybe("doc_id")).withColumnRenamed("doc_id", "id"), "id").select("id", "text", "spans").mapInArrow(_slices, SLICE)
    return slices.repartition(partitions(docs), "chain").sortWithinPartitions("chain", "side").mapInArrow(_align, OUT).distinct()
