"""SentencePiece encoding and decoding through a relational lattice.

Texts are split into units that no piece spans (runs of one kind of character, with the spaces before them). Each distinct
unit is encoded once: its substrings of bounded length are exploded and equi-joined to the piece table, the edges of a unit
come together, and a fold over its end positions keeps the best path to each. The table of encoded units then answers every text:
it is broadcast up to about TABLE_UNITS entries, the most frequent ones by a histogram of counts; units beyond are joined.

For unigram models the best path is the one with the highest sum of scores (ties: the longer last piece). For BPE models,
whose scores are merge ranks, that would be another segmentation than merging gives. There the lattice also carries which
pieces may follow each other: a segmentation is what merging gives just if each two neighbours would be left apart by it
(none of the pieces that they were merged from, at a time when both were there, would rather have merged across the
border). So a single path remains, and ids equal the library's. Characters without a piece become byte pieces.

Units that start with several spaces (their merges tie) or are longer than LONGEST are merged by the library, which gives
the same ids as a lattice would; no such unit is dropped or cut.

Defined results: null and empty texts have no pieces and decode to the empty text; doc_ids may be null or repeat; texts
of any length are encoded whole; an empty table gives no rows. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, give_back, small_batches, utf8

MARK = "▁"
#: Characters of a unit that goes through the lattice, at most; units that a worker counts at once; the broadcast table's entries; a worker's cache.
LONGEST, COUNTED, TABLE_UNITS, CACHED = 64, 200_000, 4_000_000, 100_000
#: Ways to split, the finest first: the first that no piece of a model crosses is taken. (A raised two goes with points.)
SPLITS = [rf"{MARK}*[^\W\d_²]+|{MARK}*(?:(?!{MARK})[\W_²])+|{MARK}+|\d", rf"{MARK}*[^{MARK}]+|{MARK}+"]


class Model(NamedTuple):
    """What is needed of a model file; its size is that of the vocabulary."""

    path: str
    split: str
    pieces: list[tuple[str, int, float]]  # those that can be the result of encoding
    surface: list[bytes]
    bytes_at: list[int] | None  # the byte pieces' ids
    #: Of a BPE model: each id's rank, and the ids of its left and right part (itself, if it is a character).
    rank: np.ndarray | None
    left: np.ndarray | None
    right: np.ndarray | None


_models: dict[str, Model] = {}
_library: dict[str, object] = {}


def _processor(path: str):
    if path not in _library:
        import sentencepiece

        _library[path] = sentencepiece.SentencePieceProcessor(model_file=path)
    return _library[path]


def _is_bpe(path: str) -> bool:
    """From the model file's trainer settings: field 2, and in it field 3, which is 2 for BPE."""
    with open(path, "rb") as f:
        raw = f.read()

    def fields(b: bytes) -> Iterator[tuple[int, int | bytes]]:
        at = 0

        def varint() -> int:
            nonlocal at
            out = shift = 0
            while True:
                x = b[at]
                at += 1
                out |= (x & 127) << shift
                shift += 7
                if x < 128:
                    return out

        while at < len(b):
            key = varint()
            if key & 7 == 0:
                yield key >> 3, varint()
            else:
                n = varint() if key & 7 == 2 else 4 if key & 7 == 5 else 8
                yield key >> 3, b[at : at + n]
                at += n

    return any(kind == 2 for n, trainer in fields(raw) if n == 2 for m, kind in fields(trainer) if m == 3)


def load(path: str) -> Model:
    """The model, once for each process."""
    if path in _models:
        return _models[path]
    sp = _processor(path)
    surface, normal, by_byte = [], [], {}
    for i in range(sp.get_piece_size()):
        piece = sp.id_to_piece(i)
        if sp.is_byte(i):
            by_byte[int(piece[3:5], 16)] = i
            surface.append(bytes([int(piece[3:5], 16)]))
        elif sp.is_control(i):
            surface.append(b"")
        elif sp.is_unknown(i):
            surface.append(" ⁇ ".encode())
        else:
            surface.append(piece.replace(MARK, " ").encode())
            if not sp.is_unused(i):
                normal.append((piece, i, sp.get_score(i)))
    split = next((s for s in SPLITS if all(re.fullmatch(s, p) for p, _, _ in normal)), None)
    if split is None:
        raise ValueError(f"{path}: pieces go beyond words")
    rank = left = right = None
    if _is_bpe(path):
        rank = np.zeros(len(surface), np.int64)
        for place, (_, i, _) in enumerate(sorted(normal, key=lambda x: (-x[2], x[1]))):
            rank[i] = place
        ids = {p: i for p, i, _ in normal}
        left, right = np.arange(len(surface)), np.arange(len(surface))
        whole = set()
        for p, i, _ in normal:
            last = _last_merge(p, ids, rank)
            if last is not None:
                whole.add(i)
                left[i], right[i] = last if last else (i, i)
        normal = [x for x in normal if x[1] in whole]
    _models[path] = Model(path, split, normal, surface, [by_byte[i] for i in range(256)] if len(by_byte) == 256 else None, rank, left, right)
    return _models[path]


def _last_merge(piece: str, ids: dict[str, int], rank: np.ndarray) -> tuple[int, int] | tuple[()] | None:
    """The two pieces that merging joins last to give this one; () for a character, None if merging doesn't give it."""
    parts = list(piece)
    while len(parts) > 1:
        options = [(rank[ids[a + b]], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ids]
        if not options:
            return None
        i = min(options)[1]
        if len(parts) == 2:
            return (ids[parts[0]], ids[parts[1]]) if parts[0] in ids and parts[1] in ids else None
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return ()


class Follows:
    """Which pieces of a BPE model stay apart when they meet."""

    def __init__(self, model: Model):
        self.rank, self.left, self.right = (x.astype(np.int64) for x in (model.rank, model.left, model.right))
        by_text = {model.surface[i]: i for _, i, _ in model.pieces}
        # every way in which two pieces make a third: as many as pieces have characters
        merged = {}
        for _, i, _ in model.pieces:
            s = model.surface[i]
            for at in range(1, len(s)):
                a, b = by_text.get(s[:at]), by_text.get(s[at:])
                if a is not None and b is not None:
                    merged[a << 32 | b] = model.rank[i]
        keys = np.fromiter(merged, np.int64, len(merged))
        order = np.argsort(keys)
        self.keys = np.append(keys[order], np.iinfo(np.int64).max)
        self.ranks = np.append(np.fromiter(merged.values(), np.int64, len(merged))[order], 0)

    def allowed(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For arrays of neighbours (-1: a character without a piece). Undo the merges of both pieces, the latest first:
        whatever meets at the border must not have merged before that."""
        out, rank = np.ones(len(a), bool), self.rank
        at = np.flatnonzero((a >= 0) & (b >= 0))
        a, b = a[at], b[at]
        limit, strict = np.full(len(at), 1 << 62), np.zeros(len(at), bool)
        while len(at):
            key = a << 32 | b
            place = np.searchsorted(self.keys, key)
            joined = self.ranks[place]
            apart = (self.keys[place] != key) | (joined > limit) | ((joined == limit) & strict)
            out[at[~apart]] = False
            inner_a, inner_b = self.right[a], self.left[b]
            go = np.flatnonzero(apart & ((inner_a != a) | (inner_b != b)))
            at, a, b, inner_a, inner_b = at[go], a[go], b[go], inner_a[go], inner_b[go]
            # of equal merges the one further left comes first
            strict = (inner_b == b) | ((inner_a != a) & (rank[a] > rank[b]))
            limit = np.where(strict, rank[a], rank[b])
            a, b = np.where(strict, inner_a, a), np.where(strict, b, inner_b)
        return out


#: An edge as one number: where it begins, its length, and the piece's id and 1 (0: none). Edges that are folded at once, about.
START, LENGTH, FOLDED = 1 << 40, 1 << 32, 100_000


def _folded(model: Model | None, scores: dict[int, float], names: list[str]):
    """From edges (unit and what goes with it, edge), in order, to (those, ids, score): the best path of each unit, null where
    there is none. The unit stands in the first row of each only. The fold goes over end positions, for many units at once:
    its state is the best path to each, as its last edge."""
    table = np.zeros(max([0, *scores]) + 2)
    for i, v in scores.items():
        table[i] = v
    table[-1] = -1e9
    by_byte = model.bytes_at if model is not None else None

    def made(t: pa.Table, follows: Follows | None) -> pa.RecordBatch:
        unit, edge = t.column("unit").combine_chunks(), t.column("edge").to_numpy()
        first = np.flatnonzero(unit.is_valid().to_numpy(zero_copy_only=False))
        word = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(edge))))
        s, n, piece = edge // START, edge % START // LENGTH, edge % LENGTH - 1
        begin, wide = word * (LONGEST + 1) + s, s + n
        last = np.maximum.reduceat(wide, first) + np.arange(len(first)) * (LONGEST + 1)
        state, total = np.full(len(first) * (LONGEST + 1), -1), np.zeros(len(first) * (LONGEST + 1))  # by place: the best path's last edge, its score
        order = np.argsort(wide, kind="stable")
        bounds = np.searchsorted(wide[order], np.arange(1, int(wide.max()) + 2))
        for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            e = order[lo:hi]
            before = state[begin[e]]
            opens = s[e] == 0
            ok = opens | (before >= 0)
            if by_byte is None:
                ok &= piece[e] >= 0
            e, before, opens = e[ok], before[ok], opens[ok]
            if follows is not None:
                ok = opens | follows.allowed(piece[before], piece[e])
                e = e[ok]
            score = total[begin[e]] + table[piece[e]]
            best = np.lexsort((n[e], score, word[e]))
            e, score = e[best], score[best]
            top = np.append(word[e][1:] != word[e][:-1], True)[: len(e)]
            place = begin[e[top]] + n[e[top]]
            state[place], total[place] = e[top], score[top]
        found = state[last] >= 0
        taken, at = np.zeros(len(edge), bool), last[found]
        while len(at):  # back along each path
            e = state[at]
            taken[e] = True
            at = begin[e][s[e] > 0]
        e = np.flatnonzero(taken)  # one edge at most begins at a place, so these are in order
        ids, size = piece[e], np.ones(len(e), np.int64)
        bare = np.flatnonzero(ids < 0)
        if len(bare):
            texts = unit.take(pa.array(first[word[e[bare]]])).to_pylist()
            raw = [[by_byte[x] for x in utf8(u[at])] for u, at in zip(texts, s[e[bare]].tolist(), strict=True)]
            size[bare] = [len(x) for x in raw]
            ids = np.repeat(ids, size)
            ids[ids < 0] = np.concatenate(raw)
        ends = np.concatenate([[0], np.cumsum(np.bincount(word[e], size, len(first)))]).astype(np.int32)
        given = [t.column(c).take(pa.array(first)).combine_chunks() for c in names]
        lists = pa.ListArray.from_arrays(ends, pa.array(ids.astype(np.int32)), mask=pa.array(~found))
        return pa.RecordBatch.from_arrays([*given, lists, pa.array(total[last], mask=~found)], [*names, "ids", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        follows = None if model is None or model.rank is None else Follows(model)
        held: list[pa.RecordBatch] = []
        for b in batches:
            held.append(b)
            if sum(map(len, held)) < FOLDED:
                continue
            now = pa.Table.from_batches(held)
            last = int(np.flatnonzero(now.column("unit").is_valid().to_numpy())[-1])
            if last:
                yield made(now.slice(0, last), follows)
                held = now.slice(last).combine_chunks().to_batches()
        if sum(map(len, held)):
            yield made(pa.Table.from_batches(held), follows)
        follows = held = None
        give_back()

    return run


def lattice_encode(units: DataFrame, pieces: DataFrame, scores: dict[int, float], longest: int = 16, model: Model | None = None) -> DataFrame:
    """From distinct units (unit string, of 1 to LONGEST characters) and pieces (piece string, id int) to (unit, ids, score).

    scores: of the ids. Units that no path covers have null ids. model: gives byte pieces and, if it is BPE, what may follow.
    Other columns of units go with them. All rows of a unit stay in order: nothing here moves them.
    """
    names = units.columns
    starts = units.select("*", F.explode(F.sequence(F.lit(0), F.length("unit") - 1)).alias("s"))
    starts = starts.select(*[F.when(F.col("s") == 0, F.col(c)).alias(c) for c in names], "s", F.expr(f"substring(unit, s + 1, {longest})").alias("rest"))
    # no piece is longer than the longest one that begins with the same three characters
    heads = pieces.where("length(piece) > 2").groupBy(F.substring("piece", 1, 3).alias("head")).agg(F.max(F.length("piece")).alias("most"))
    starts = starts.withColumn("head", F.substring("rest", 1, 3)).join(F.broadcast(heads), "head", "left")  # fewer than pieces
    spans = starts.select(*names, "s", "rest", F.explode(F.sequence(F.lit(1), F.least(F.length("rest"), F.coalesce("most", F.lit(2))))).alias("length"))
    spans = spans.select(*[F.when(F.col("length") == 1, F.col(c)).alias(c) for c in names], "s", "length", F.expr("substring(rest, 1, length)").alias("span"))
    # by a number, which is looked up faster than a string; whether the strings are equal is seen after
    known = pieces.select("piece", "id", F.xxhash64("piece").alias("key"))
    several, keys = known.agg(F.count("*"), F.count_distinct("key")).first()
    key = F.xxhash64 if several == keys else F.col
    known = known.withColumn("key", key("piece"))
    edges = spans.withColumn("key", key("span")).join(F.broadcast(known), "key", "left").where("piece = span or length = 1")  # a vocabulary has a fixed size
    edges = edges.select(*names, F.expr(f"s * {START}L + length * {LENGTH}L + if(piece = span, id, -1) + 1").alias("edge"))
    kinds = ", ".join(f"{c} {k}" for c, k in units.dtypes)
    return edges.mapInArrow(_folded(model, scores, names), f"{kinds}, ids array<int>, score double")


def splitter(split: str):
    """findall of a model's split. Texts of Latin-1 characters are split alike, and faster, by lists of these characters."""
    general = re.compile(split).findall
    if split != SPLITS[0]:
        return general
    listed = lambda kind: "".join(re.escape(chr(c)) for c in range(256) if re.fullmatch(kind, chr(c)))
    letter, other, digit = listed(r"[^\W\d_²]"), listed(r"[\W_²]"), listed(r"\d")
    latin = re.compile(f"{MARK}*[{letter}]+|{MARK}*[{other}]+|{MARK}+|[{digit}]").findall

    def run(text: str) -> list[str]:
        try:
            text.replace(MARK, " ").encode("latin-1")
        except UnicodeEncodeError:
            return general(text)
        return latin(text)

    return run


def units_of(text: str | None, split) -> list[str]:
    return split((MARK + text).replace(" ", MARK)) if text else []


def unit_counts(docs: DataFrame, model: Model) -> DataFrame:
    """unit, n: all distinct units that go through the lattice, counted within a task first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, found = splitter(model.split), Counter()

        def done() -> pa.RecordBatch:
            units, n = pa.array(found, pa.string()), pa.array(found.values(), pa.int64())
            keep = pc.and_(pc.less_equal(pc.utf8_length(units), LONGEST), pc.invert(pc.starts_with(units, 2 * MARK)))
            return pa.RecordBatch.from_arrays([units.filter(keep), n.filter(keep)], ["unit", "n"])

        for b in batches:
            for t in b.column("text").to_pylist():
                found.update(units_of(t, split))
                if len(found) > COUNTED:
                    yield done()
                    found.clear()
        yield done()
        found.clear()
        give_back()

    return docs.select("text").mapInArrow(count, "unit string, n long").groupBy("unit").agg(F.sum("n").alias("n"))


def piece_frame(spark: SparkSession, model: Model) -> DataFrame:
    """piece, id. From Arrow, as rows of the driver's own: a list of Python's would take workers of another kind, which stay."""
    names, ids, _ = zip(*model.pieces, strict=True)
    return spark.createDataFrame(pa.table({"piece": pa.array(names, pa.string()), "id": pa.array(ids, pa.int32())}))


def encoded_units(docs: DataFrame, model: Model) -> DataFrame:
    """unit, n, ids of every distinct unit of docs, through the lattice."""
    spark = docs.sparkSession
    counted = cut(unit_counts(docs, model))
    pieces = piece_frame(spark, model)
    longest = max(len(p) for p, _, _ in model.pieces)
    got = lattice_encode(counted, pieces, {i: v for _, i, v in model.pieces}, longest, model).select("unit", "n", "ids")
    # edges are small and of one size, so their number bounds a batch; to ask for its bytes at each of them takes long
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    try:
        return cut(got)
    finally:
        small_batches(spark)


def _hash(unit: str) -> int:
    return xxhash.xxh3_64_intdigest(utf8(unit)) - (1 << 63)


def _kind(model: Model) -> str:
    """What an id is packed as."""
    return "uint16" if len(model.surface) <= 1 << 16 else "int32"


def _decoded(model: Model, ids: np.ndarray) -> bytes:
    return b"".join([model.surface[i] for i in ids.tolist()])


#: Bits of a hash that say in which run of the table it is.
TOP = 8


def _packed(units: DataFrame, model: Model) -> DataFrame:
    """h, ids (packed), odd (what the ids decode to, where that isn't the unit): those with the same TOP bits of h together, in
    order of h. To sort by all of h, Spark would first pack every unit once more, to learn how the hashes lie."""
    path, kind = model.path, _kind(model)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = load(path)
        for b in batches:
            texts, each = b.column("unit").to_pylist(), [np.asarray(x.values) for x in b.column("ids")]
            raw = [_decoded(m, x) for x in each]
            odd = [None if x == utf8(u.replace(MARK, " ")) else x for u, x in zip(texts, raw, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([_hash(u) for u in texts], pa.int64()), pa.array([x.astype(kind).tobytes() for x in each], pa.binary()), pa.array(odd, pa.binary())], ["h", "ids", "odd"])
        texts = each = raw = odd = None
        give_back()

    return units.select("unit", "ids").mapInArrow(pack, "h long, ids binary, odd binary").repartition(F.shiftright("h", 64 - TOP)).sortWithinPartitions("h")


def _in_order(rows: pa.Table) -> pa.Table:
    """What _packed gives in order of h: its runs are put in order, nothing is copied."""
    top = rows.column("h").to_numpy() >> (64 - TOP)
    at = np.flatnonzero(np.append(True, top[1:] != top[:-1])[: len(top)])
    runs = sorted(zip(top[at].tolist(), at.tolist(), np.diff(np.append(at, len(top))).tolist(), strict=True))
    return pa.concat_tables([rows.slice(0, 0), *(rows.slice(start, n) for _, start, n in runs)])


class Table:
    """Packed ids by a unit's hash: sorted hashes, where each one's ids begin, and all ids, as plain bytes that workers read in place."""

    def __init__(self, rows: pa.Table):
        self.hashes = rows.column("h").to_numpy().tobytes()
        parts = rows.column("ids").chunks
        sizes = np.concatenate([np.empty(0, np.int64), *(np.diff(np.frombuffer(c.buffers()[1], np.int32)[c.offset : c.offset + len(c) + 1]) for c in parts if len(c))])
        self.ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32).tobytes()
        self.ids = b"".join(self._data(c) for c in parts if len(c))
        odd = rows.filter(rows.column("odd").is_valid())
        self.odd: dict[int, bytes] = dict(zip(odd.column("h").to_pylist(), odd.column("odd").to_pylist(), strict=True))

    @staticmethod
    def _data(c: pa.BinaryArray) -> pa.Buffer:
        at = np.frombuffer(c.buffers()[1], np.int32)
        return c.buffers()[2][int(at[c.offset]) : int(at[c.offset + len(c)])]

    def get(self, units: list[str]) -> tuple[list[bytes | None], dict[str, bytes]]:
        """Each unit's packed ids, None where there is no entry, and which of them decode to something else."""
        hashes, ends = np.frombuffer(self.hashes, np.int64), np.frombuffer(self.ends, np.int32)
        if not len(hashes) or not units:
            return [None] * len(units), {}
        digest = xxhash.xxh3_64_intdigest
        h = (np.fromiter([digest(u.encode("utf-8", "surrogatepass")) for u in units], np.uint64, len(units)) ^ np.uint64(1 << 63)).view(np.int64)
        at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
        ids = self.ids
        got = [ids[x:y] if ok else None for x, y, ok in zip(ends[at].tolist(), ends[at + 1].tolist(), (hashes[at] == h).tolist(), strict=True)]
        odd = {units[i]: self.odd[x] for i, x in enumerate(h.tolist()) if x in self.odd} if self.odd else {}
        return got, odd


class Read(NamedTuple):
    """A text as the cache knows it: packed ids by unit, and where None stands, and for which unit; all units, joined."""

    ids: list[bytes | None]
    at: list[int]
    units: list[str]
    text: str


class Encoder:
    """Encodes texts by the table, with what was looked up first kept, in bounded number, and the rest for the texts at hand."""

    def __init__(self, model: Model, table: Table):
        self.model, self.table, self.split, self.kind = model, table, splitter(model.split), _kind(model)
        self.ids: dict[str, bytes] = {}  # packed ids of the units that came first, CACHED of them
        self.fresh: dict[str, bytes] = {}  # and of those that the cache lacked, for the texts at hand
        self.odd: dict[str, bytes] = {}  # units that their ids don't decode to, with what they do decode to

    def read(self, text: str | None) -> Read:
        """Text by text, while its units are at hand: each is asked for once."""
        units = units_of(text, self.split)
        ids = list(map(self.ids.get, units))
        at = [i for i, x in enumerate(ids) if x is None]
        return Read(ids, at, [units[i] for i in at], "".join(units))

    def _direct(self, unit: str) -> np.ndarray:
        """By the library; a line feed is never merged and keeps the unit from the mark that the library puts first."""
        return np.array(_processor(self.model.path).encode("\n" + unit)[2:], np.int32)

    def _keep(self, unit: str, ids: bytes) -> None:
        self.fresh[unit] = ids
        if len(self.ids) < CACHED:
            self.ids[unit] = ids

    def learn(self, unit: str, ids: np.ndarray) -> None:
        """A unit that isn't in the table."""
        self._keep(unit, ids.astype(self.kind).tobytes())
        raw = _decoded(self.model, ids)
        if raw != utf8(unit.replace(MARK, " ")):
            self.odd[unit] = raw

    def look_up(self, each: list[list[str]]) -> set[str]:
        """Find what the cache lacks of these units; gives those that the table lacks."""
        known = self.ids
        if self.odd:
            for u in self.fresh:
                if u not in known:
                    self.odd.pop(u, None)
        self.fresh.clear()
        new = [u for u in set().union(*each) if u not in known]  # a set less the cache's keys would go through the whole cache
        lacking = set()
        got, odd = self.table.get(new)
        for u, ids in zip(new, got, strict=True):
            if ids is not None:
                self._keep(u, ids)
            elif len(u) > LONGEST or u.startswith(2 * MARK):
                self.learn(u, self._direct(u))
            else:
                lacking.add(u)
        self.odd |= odd
        return lacking

    def encode(self, read: Read) -> np.ndarray:
        for i, u in zip(read.at, read.units, strict=True):
            read.ids[i] = self.fresh[u]
        return np.frombuffer(b"".join(read.ids), self.kind).astype(np.int32)

    def decode(self, read: Read) -> str:
        """The text that the units' ids stand for: what each decodes to, joined, without the first mark's space."""
        text = read.text.replace(MARK, " ")
        if self.odd:
            units = self.split(read.text)
            if not self.odd.keys().isdisjoint(units):
                raw = b"".join([self.odd[u] if u in self.odd else utf8(u.replace(MARK, " ")) for u in units])
                return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


OUT = "doc_id long, n_pieces long, ids array<int>, decoded_sha256 string, round_trip boolean"


def _rows(encoder: Encoder, doc_ids: list, texts: list[str | None], each: list[Read]) -> pa.RecordBatch:
    ids = [encoder.encode(x) for x in each]
    ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
    back = [encoder.decode(x) for x in each]
    digest = [hashlib.sha256(utf8(t)).hexdigest() for t in back]
    same = [x == (t or "").replace(MARK, " ") for x, t in zip(back, texts, strict=True)]
    flat = np.concatenate([np.empty(0, np.int32), *ids])
    return pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(np.diff(ends).astype(np.int64)), pa.ListArray.from_arrays(ends, flat), pa.array(digest, pa.string()), pa.array(same, pa.bool_())], [c.split()[0] for c in OUT.split(", ")])


#: Of the scale of counts, steps to a doubling; parts of the step that the table takes in part.
STEPS, SHARES = 4, 4096


def most_frequent(units: DataFrame, most: int) -> tuple[DataFrame, bool]:
    """About `most` of the units at most, those with the largest n, and whether others are left.

    A histogram of n on a scale of doublings, a few hundred rows, gives the step from which all are taken; of the step
    below, units are taken by hash. So nothing is sorted, and no task holds more than its own rows.
    """
    step = F.floor(F.log2(F.greatest("n", F.lit(1))) * STEPS).cast("int")
    counts = {r["step"]: r["count"] for r in units.groupBy(step.alias("step")).count().collect()}
    room, above = most, None
    for s in sorted(counts, reverse=True):
        if counts[s] > room:
            share = SHARES * max(0, room) // counts[s]
            part = (step == s) & (F.pmod(F.xxhash64("unit"), F.lit(SHARES)) < share)
            return units.where(part if above is None else part | (step >= above)), True
        room, above = room - counts[s], s
    return units, False


def encode_pieces(docs: DataFrame, path: str, table_units: int = TABLE_UNITS) -> DataFrame:
    """doc_id, n_pieces, ids, decoded_sha256 (of the decoded text), round_trip (it equals the text) for every row."""
    spark = docs.sparkSession
    small_batches(spark)
    model = load(path)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    units = encoded_units(docs, model)

    kept, rest = most_frequent(units, table_units)
    table = spark.sparkContext.broadcast(Table(_in_order(_packed(kept, model).toArrow())))
    give_back()  # the driver needs its copy no more

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows of texts whose units are all in the table."""
        give_back()
        encoder = Encoder(load(path), table.value)
        for b in batches:
            texts = b.column("text").to_pylist()
            each = [encoder.read(t) for t in texts]
            lacking = encoder.look_up([x.units for x in each])
            ok = [i for i, x in enumerate(each) if not lacking or lacking.isdisjoint(x.units)]
            ids = b.column("doc_id").to_pylist()
            yield _rows(encoder, [ids[i] for i in ok], [texts[i] for i in ok], [each[i] for i in ok])
        encoder = texts = each = None
        give_back()

    done = docs.mapInArrow(whole, OUT)
    if not rest:
        return done
    keyed = "id long, t1 long, t2 long, text string, unit array<string>"

    def lacks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The other texts, with the units that they need besides; rows alike in doc_id and text need the same."""
        encoder = Encoder(load(path), table.value)
        for b in batches:
            texts, ids = b.column("text").to_pylist(), b.column("doc_id").to_pylist()
            each = [set(units_of(t, encoder.split)) for t in texts]
            lacking = encoder.look_up([list(u) for u in each])
            rows = [(ids[i], *np.frombuffer(xxhash.xxh3_128_digest(utf8(texts[i])), ">i8").tolist(), texts[i], sorted(u & lacking)) for i, u in enumerate(each) if not u.isdisjoint(lacking)]
            yield pa.RecordBatch.from_pylist([dict(zip(("id", "t1", "t2", "text", "unit"), r, strict=True)) for r in rows], pa.schema([("id", pa.int64()), ("t1", pa.int64()), ("t2", pa.int64()), ("text", pa.string()), ("unit", pa.list_(pa.string()))]))

    key = ["t1", "t2"]  # equal texts need the same
    lacking = docs.mapInArrow(lacks, keyed)
    asked = lacking.select(*key, "unit").dropDuplicates(key).select(*key, F.explode("unit").alias("unit"))
    told = asked.join(units.select("unit", "ids"), "unit").groupBy(*key).agg(F.collect_list(F.struct("unit", "ids")).alias("more"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(load(path), table.value)
        for b in batches:
            texts = b.column("text").to_pylist()
            each = [encoder.read(t) for t in texts]
            encoder.look_up([x.units for x in each])
            for row in b.column("more").to_pylist():
                for x in row:
                    encoder.learn(x["unit"], np.array(x["ids"], np.int32))
            yield _rows(encoder, b.column("id").to_pylist(), texts, each)

    return done.unionByName(lacking.select("id", *key, "text").join(told, key).select("id", "text", "more").mapInArrow(finish, OUT))
