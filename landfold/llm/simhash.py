"""SimHash near-duplicates, with pigeonring filtering in place of plain blocks.

A 64-bit fingerprint is a ring of segments. If two fingerprints differ in at most tau bits then, from some start on the
ring, every chain of l consecutive segments differs in at most l * tau / m bits. Keys are built from such chains: the
segments that the budgets force to be equal, with the few that may differ left out in every permitted way. Fingerprints
that share a key are checked for the whole chain of budgets before the full Hamming distance.

Defined results: null and empty texts have fingerprint 0 and are linked like any other; a null doc_id keeps its row, and
counts for no component_id unless nothing else is there (then null); repeated rows each keep a row. Other columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bloom import bloom, probe
from .common import by_name, cut, narrow, partitions, utf8
from .components import connected_components

BITS, SEED = 64, 42
#: Rows of one key that a task searches on its own; larger groups go through shared neighbours (see _stars).
BLOCK = 16_384


def fingerprint(text: str | None, k: int = 3) -> int:
    """Signed 64-bit SimHash over the k-word shingles of the text with A-Z in lower case."""
    words = utf8(text).lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= k:
        hashes = np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    else:
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        digest = xxhash.xxh64_intdigest
        hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)), np.uint64, len(words) - k + 1)
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 8192):
        ones += np.unpackbits(hashes[i : i + 8192].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprint_udf(k: int):
    @F.pandas_udf("long")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, k) for t in texts], dtype="int64")

    return run


class Ring:
    """Chains for tau over m equal segments. Each key is a start and the chain's places whose segments must be equal."""

    def __init__(self, tau: int, m: int, chain: int):
        self.tau, self.m, self.width = tau, m, BITS // m
        self.budgets = [(l + 1) * tau // m for l in range(m)]
        free = self.budgets[chain - 1]
        fits = lambda w: all(sum(x <= l for x in w) <= self.budgets[l] for l in range(chain))
        self.patterns = [tuple(sorted(set(range(chain)) - set(w))) for w in combinations(range(chain), free) if fits(w)]

    def mask(self, start: int, pattern: tuple[int, ...]) -> int:
        one = (1 << self.width) - 1
        out = sum(one << ((start + p) % self.m * self.width) for p in pattern)
        return out - (1 << 64) if out >= 1 << 63 else out

    def keys(self) -> list[tuple[int, int, int]]:
        """(number, start, mask) of each key."""
        both = [(s, p) for s in range(self.m) for p in self.patterns]
        return [(i, s, self.mask(s, p)) for i, (s, p) in enumerate(both)]

    def linked(self, x: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Which XORs pass: first the chain from start within its budgets, then the full distance."""
        x, start = np.atleast_1d(x).astype(np.uint64), np.atleast_1d(start)
        one, total, ok = np.uint64((1 << self.width) - 1), np.zeros(len(x), np.int64), np.ones(len(x), bool)
        for l, budget in enumerate(self.budgets):
            shift = ((start + l) % self.m * self.width).astype(np.uint64)
            total += np.bitwise_count((x >> shift) & one)
            ok &= total <= budget
        return ok & (np.bitwise_count(x) <= self.tau)


#: 8 segments of 8 bits; chains of 5 have at most one differing bit: 24 keys of 32 bits.
RING3 = Ring(3, 8, 5)


def _forest(fps: np.ndarray, ring: Ring, start: int) -> Iterator[tuple[int, int]]:
    """A spanning forest of the links among distinct fingerprints of one key, in memory proportional to their number."""
    left = fps.astype(np.uint64)
    while len(left) > 1:
        front, left = [left[0]], left[1:]
        while front and len(left):
            at = front.pop()
            near = ring.linked(left ^ at, np.full(len(left), start))
            if near.any():
                hit, left = left[near], left[~near]
                front.extend(hit)
                yield from ((int(at), int(h)) for h in hit)


def _pairs(fps: np.ndarray, ring: Ring, start: int) -> Iterator[tuple[int, int]]:
    """All links among a few distinct fingerprints of one key."""
    i, j = np.triu_indices(len(fps), 1)
    ok = ring.linked(fps[i] ^ fps[j], np.full(len(i), start))
    yield from zip(fps[i[ok]].tolist(), fps[j[ok]].tolist(), strict=True)


def _search(ring: Ring, views: int, whole: int):
    starts = np.tile(np.array([s for _, s, _ in ring.keys()]), views)
    masks = np.array([m for _, _, m in ring.keys()], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by key; a group may span batches. Out: links (hot false; c is the key's number) or rows of keys beyond BLOCK (hot true: a is the key's number, b the fingerprint, c its hash)."""
        key = np.empty(0, np.int64)
        num, fp = key.astype(np.int32), key
        overflow: tuple[int, int] | None = None

        def emit(a, b, c, hot):
            return pa.RecordBatch.from_arrays([pa.array(np.asarray(a, np.uint64).view(np.int64)), pa.array(np.asarray(b, np.uint64).view(np.int64)), pa.array(np.asarray(c, np.int64)), pa.array(np.asarray(hot, bool))], ["a", "b", "c", "hot"])

        def solve(num, key, fp):
            if not len(fp):
                return
            edge = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (num[1:] != num[:-1])]))
            size = np.diff(np.append(edge, len(fp)))
            two = edge[size == 2]
            x = (fp[two] ^ fp[two + 1]).view(np.uint64)
            ok = ring.linked(x, starts[num[two]]) if len(two) else np.empty(0, bool)
            pairs, numbers = [np.stack([fp[two[ok]], fp[two[ok] + 1]], 1)], [num[two[ok]]]
            for at, n in zip(edge[size > 2].tolist(), size[size > 2].tolist(), strict=True):
                search = _pairs if n <= whole else _forest
                found = np.array(list(search(fp[at : at + n].view(np.uint64), ring, int(starts[num[at]]))), np.uint64).reshape(-1, 2)
                pairs.append(found.view(np.int64))
                numbers.append(np.full(len(found), num[at]))
            pairs, numbers = np.concatenate(pairs), np.concatenate(numbers)
            # two that an earlier key accepts are connected by what that key gives; to share it is not enough
            x = pairs[:, 0] ^ pairs[:, 1]
            passed = np.stack([ring.linked(x.view(np.uint64), np.full(len(x), s)) for s in range(ring.m)], 1)
            accepted = ((x[:, None] & masks) == 0) & passed[:, starts[: len(masks)]]
            own = accepted.argmax(axis=1) == numbers % len(masks)
            pairs, numbers = pairs[own], numbers[own]
            if len(pairs):
                yield emit(pairs[:, 0].view(np.uint64), pairs[:, 1].view(np.uint64), numbers, np.zeros(len(pairs)))

        for b in batches:
            num = np.concatenate([num, b.column("num").to_numpy()])
            key = np.concatenate([key, b.column("key").to_numpy()])
            fp = np.concatenate([fp, b.column("fp").to_numpy()])
            last = len(fp) - int(np.argmin(((key == key[-1]) & (num == num[-1]))[::-1])) if len(fp) and not ((key == key[-1]) & (num == num[-1])).all() else 0
            if last:
                if overflow == (int(num[0]), int(key[0])):
                    own = int(((key == key[0]) & (num == num[0])).sum())
                    yield emit(num[:own], fp[:own].view(np.uint64), key[:own], np.ones(own))
                    num, key, fp, last = num[own:], key[own:], fp[own:], last - own
                yield from solve(num[:last], key[:last], fp[:last])
                num, key, fp, overflow = num[last:], key[last:], fp[last:], None
            if len(fp) > BLOCK or overflow:
                overflow = (int(num[0]), int(key[0]))
                yield emit(num, fp.view(np.uint64), key, np.ones(len(fp)))
                num, key, fp = num[:0], key[:0], fp[:0]
        yield from solve(num, key, fp)

    return run


def _stars(hot: DataFrame, ring: Ring) -> DataFrame:
    """Links within keys beyond BLOCK, at a cost in proportion to their rows (for tau = 3).

    Members of a key differ only in its free bits. Two at distance 3 or less have a common neighbour that is within 1 of
    one and within 2 of the other. So each member is put at all points within 2 of it, and at a point that has a member
    within 1, all members link to the smallest such: those within 2 of the point are within 3 of it.
    """
    masks = {i: m for i, _, m in ring.keys()}

    def spread(batches):
        for b in batches:
            for num, fp, key in zip(b.column("a").to_numpy(), b.column("b").to_numpy(), b.column("c").to_numpy(), strict=True):
                free = [1 << i for i in range(BITS) if not (masks[int(num) % len(masks)] >> i) & 1]
                flips = np.array([0, *free, *(p | q for p, q in combinations(free, 2))], np.uint64)
                at, near = (flips ^ np.array(fp).view(np.uint64)).view(np.int64), np.arange(len(flips)) <= len(free)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), num)), pa.array(np.full(len(at), key)), pa.array(at), pa.array(np.full(len(at), fp)), pa.array(near)], ["num", "key", "point", "fp", "near"])

    at = hot.select("a", "b", "c").mapInArrow(spread, "num long, key long, point long, fp long, near boolean")
    centre = at.where("near").groupBy("num", "key", "point").agg(F.min("fp").alias("a"))
    return at.join(centre, ["num", "key", "point"]).where("a <> fp").select("a", F.col("fp").alias("b"), "num")


def links(fps: DataFrame, ring: Ring = RING3, views: int = 1, whole: int = 0) -> DataFrame:
    """From distinct fingerprints (fp long, view int if there are several) to links (a, b, view) whose components are those
    of all pairs of a view within ring.tau. Keys of at most `whole` fingerprints give every pair, others a spanning forest."""
    each = ring.keys()
    keys = F.explode(F.array(*(F.struct(F.lit(i).alias("num"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, _, m in each)))
    view = F.col("view") if views > 1 else F.lit(0)
    keyed = fps.select("fp", view.alias("view"), keys.alias("k")).select((F.col("k.num") + F.col("view") * len(each)).alias("num"), "k.key", "fp")
    n = max(keyed.sparkSession.sparkContext.defaultParallelism, partitions(fps, 2 * len(each)))
    sorted_keys = keyed.repartition(n, "key", "num").sortWithinPartitions("num", "key", "fp")
    found = cut(sorted_keys.mapInArrow(_search(ring, views, whole), "a long, b long, c long, hot boolean"))
    both = found.where("not hot").select("a", "b", F.col("c").alias("num")).unionByName(_stars(found.where("hot"), ring))
    return both.select("a", "b", F.expr(f"cast(num div {len(each)} as int)").alias("view"))


def near_duplicates(docs: DataFrame, shingle: int = 3, ring: Ring = RING3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable) for every row of docs."""
    marked = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), fingerprint_udf(shingle)("text").alias("fp")))
    fps = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = connected_components(links(fps.select("fp"), ring).select("a", "b")).withColumnRenamed("node", "fp")
    rooted = fps.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "root").select("fp", "component_id")
    return marked.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


#: The stage on five-word shingles: how many fingerprints of a text's words are compared, and the least Jaccard similarity of its shingles.
VIEWS, SHINGLE, LEAST_SIMILARITY, WHOLE = 4, 5, 0.8, 16
#: Central members of a group, and leads that a list of a shingle begins with; each further round has its square times as many.
GROWTH = 16
#: Bits of a set's parities (see parities).
PARITIES = 512
_EDGE, _ODD = b".,!?;:", np.uint64(0x9E3779B97F4A7C15)


def text_class(text: str | None) -> int:
    """A hash that texts of the same words share."""
    return xxhash.xxh3_64_intdigest(b" ".join(utf8(text).lower().split())) - (1 << 63)


def word_views(text: str | None) -> list[int]:
    """VIEWS SimHashes over a text's distinct words, from different hashes of them. Texts that share most five-word shingles
    share still more words, so that one of these is likely to be near."""
    words = list({w.strip(_EDGE) for w in utf8(text).lower().split()})
    if not words:
        return [0] * VIEWS
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(w, SEED) for w in words), np.uint64, len(words))
    out = []
    for v in range(VIEWS):
        x = (h + np.uint64(v)) * _ODD
        x = (x ^ (x >> np.uint64(32))) * _ODD
        x ^= x >> np.uint64(29)
        ones = np.unpackbits(x.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
        out.append(int(np.packbits(2 * ones > len(x), bitorder="little").view("<i8")[0]))
    return out


def shingle_set(text: str | None) -> np.ndarray:
    """32-bit hashes of the distinct SHINGLE-word shingles; of a shorter text, of all its words at once."""
    words = utf8(text).lower().split()
    digest = xxhash.xxh64_intdigest
    n = max(1, len(words) - SHINGLE + 1)
    return np.unique(np.fromiter((digest(b" ".join(words[i : i + SHINGLE])) for i in range(n)), np.uint64, n).astype(np.uint32).view(np.int32))


def parities(s: np.ndarray) -> np.ndarray:
    """PARITIES bits, as longs: of the shingles that fall to each bit, whether their number is odd. Two sets differ in at least
    as many shingles as their parities do in bits, so a pair that this refuses is surely not near."""
    return np.packbits((np.bincount(s & (PARITIES - 1), minlength=PARITIES) & 1).astype(np.uint8), bitorder="little").view("<i8")


#: May members (cls, root, n, bits) and l of the same be near and of two components? Similar ones (0.8 of all) differ in at most a ninth of both sizes.
_MAY_LINK = f"root <> l.root and 5 * least(n, l.n) >= 4 * greatest(n, l.n) and 9 * ({' + '.join(f'bit_count(bits[{i}] ^ l.bits[{i}])' for i in range(PARITIES // 64))}) <= n + l.n"


def _hash_pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a.astype(np.int64).view(np.uint64) + b.astype(np.int64).view(np.uint64) * _ODD
    x = (x ^ (x >> np.uint64(31))) * _ODD
    return np.stack([x.view(np.int64), ((x >> np.uint64(32)) | np.uint64(1)).view(np.int64)], 1)


def _among(pairs: DataFrame):
    """The filter over `pairs` (cls, id), broadcast: it is never false of one that is there."""

    @F.pandas_udf("struct<a: long, b: long>")
    def hashed(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(_hash_pair(a.to_numpy(), b.to_numpy()), columns=["a", "b"])

    return pairs.sparkSession.sparkContext.broadcast(bloom(pairs.select(hashed("cls", "id").alias("h")).select("h.a", "h.b")))


def _judged(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (x, y and what they bring), with near: whether the shingles of the two classes are similar enough."""
    one = pairs.join(sets.select(F.col("cls").alias("x"), F.col("s").alias("sx")), "x")
    two = one.join(sets.select(F.col("cls").alias("y"), F.col("s").alias("sy")), "y")
    common = F.size(F.array_intersect("sx", "sy"))
    return two.select(*pairs.columns, (common >= LEAST_SIMILARITY * (F.size("sx") + F.size("sy") - common)).alias("near"))


def _named(pairs: DataFrame, comps: DataFrame) -> DataFrame:
    """Pairs x, y of classes as edges a, b of their components (cls, root)."""
    x, y = comps.select(F.col("cls").alias("x"), F.col("root").alias("a")), comps.select(F.col("cls").alias("y"), F.col("root").alias("b"))
    return pairs.join(x, "x").join(y, "y").where("a <> b").select("a", "b")


def _settled(judged: DataFrame, ids: DataFrame, sets) -> DataFrame:
    """cls, root of the near pairs' components, whatever tree the fingerprints were linked by.

    Links are trees in large groups, so a refused link may part classes that are near to others of the group. Groups with
    a refused link between components are decided by a prefix filter: two sets of this similarity share a shingle among
    the rarest of each. At first GROWTH members of a group, those whose shingles are the commonest in it, meet all members of
    other components. Then, in each list of a shingle, some leads do so and leave, and more follow, until the members
    left are of one component. Pairs whose parities differ too much never meet. So every pair of the group is decided or connected.
    """
    linked = connected_components(judged.where("near").select(F.col("x").alias("a"), F.col("y").alias("b"))).select(F.col("node").alias("cls"), "root")
    ends = judged.select(F.col("x").alias("cls")).unionByName(judged.select(F.col("y").alias("cls"))).distinct()
    comps = narrow(ends.join(linked, "cls", "left").select("cls", F.coalesce("root", "cls").alias("root")))
    groups = connected_components(_named(judged.where("not near"), comps)).select(F.col("node").alias("root"), F.col("root").alias("grp"))
    members = narrow(comps.join(groups, "root").select("cls", "root", "grp"))
    if members.isEmpty():
        return comps

    @F.pandas_udf("array<long>")
    def marked(sets: pd.Series) -> pd.Series:
        return pd.Series([parities(s) for s in sets])

    settled, open_ = comps.join(members.select("cls"), "cls", "left_anti"), members.select("cls", "root")
    grouped = sets(members.select("cls").join(ids, "cls")).join(members.select("cls", "grp"), "cls").groupBy("cls").agg(F.first("grp").alias("grp"), F.first("s").alias("s"))
    held = cut(grouped.withColumn("bits", marked("s")))
    each = held.select("cls", "grp", F.size("s").alias("n"), "bits", F.explode("s").alias("shingle"))
    seen = each.groupBy("grp", "shingle").agg(F.count("*").alias("times")).where("times > 1")
    own = Window.partitionBy("cls")
    # shingles of one text come first in the order, and are in no list
    ranked = each.join(seen, ["grp", "shingle"]).withColumn("place", F.row_number().over(own.orderBy("times", "shingle"))).withColumn("alone", F.col("n") - F.count("*").over(own)).withColumn("shared", F.sum("times").over(own) / F.col("n"))
    lists, leading = narrow(ranked.where("place + alone <= n - (4 * n + 4) div 5 + 1").select("grp", "shingle", "cls", "n", "bits", "shared")), GROWTH

    def after(meet: DataFrame, open_: DataFrame) -> DataFrame:
        """open_ when the pairs in meet (of members a and b: cls, root) are decided. Pairs bring their roots, which aren't looked up again."""
        met = narrow(meet.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().selectExpr("a.cls x", "b.cls y", "a.root a", "b.root b"))
        merged = connected_components(_judged(met, held).where("near").select("a", "b")).select(F.col("node").alias("root"), F.col("root").alias("now"))
        return narrow(open_.join(merged, "root", "left").select("cls", F.coalesce("now", "root").alias("root")))

    # first the members whose shingles most others have: copies of one text are often near to it and not to each other
    listed = narrow(lists.groupBy("cls").agg(*(F.first(c).alias(c) for c in ("grp", "n", "bits", "shared"))).join(open_, "cls"))
    place = F.row_number().over(Window.partitionBy("grp").orderBy(F.desc("shared"), "cls"))
    hubs = listed.withColumn("place", place).where(F.col("place") <= GROWTH).select("grp", F.struct("cls", "root", "n", "bits").alias("l"))
    open_ = after(listed.join(hubs, "grp").where(_MAY_LINK).select(F.struct("cls", "root").alias("a"), F.struct("l.cls", "l.root").alias("b")), open_)
    while True:
        known = narrow(lists.join(open_, "cls").select("grp", "shingle", "cls", "n", "bits", "root"))
        live = known.groupBy("grp", "shingle").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("size")).where("lo <> hi").select("grp", "shingle", "size")
        known = narrow(known.join(live, ["grp", "shingle"]))
        if known.isEmpty():
            return settled.unionByName(open_)
        # of a short list all members lead
        part = F.when(F.col("size") <= leading, F.col("cls")).otherwise(F.pmod(F.xxhash64("cls"), F.lit(leading)))
        leads = known.groupBy("grp", "shingle", part.alias("part")).agg(F.min(F.struct("cls", "root", "n", "bits")).alias("l")).select("grp", "shingle", "l")
        meet = known.join(leads, ["grp", "shingle"]).where(_MAY_LINK)
        open_ = after(meet.select(F.struct("cls", "root").alias("a"), F.struct("l.cls", "l.root").alias("b")), open_)
        lists = known.join(leads.select("grp", "shingle", F.col("l.cls").alias("cls")), ["grp", "shingle", "cls"], "left_anti").select("grp", "shingle", "cls", "n", "bits")
        leading *= GROWTH * GROWTH


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """docs with one row of each group of near-duplicates: that of the smallest doc_id (a null one is smaller than all).

    Texts of the same words are one class. Classes are near if their five-word shingles have a Jaccard similarity of
    LEAST_SIMILARITY; pairs to be compared come from links among VIEWS fingerprints (measured on the test tables: about 95 of
    100 pairs at or above the limit, and all where texts are equal). Groups are the components (see _settled). Of rows that
    are alike in doc_id and words one stays. Columns as they were, whatever their names (other than "__dup_" ones).
    """

    @F.pandas_udf("struct<cls: long, fps: array<long>>")
    def marks(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"cls": [text_class(t) for t in texts], "fps": [word_views(t) for t in texts]})

    number = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    light = cut(docs.select(number.alias("id"), marks("text").alias("m")).select("id", "m.cls", "m.fps"))
    first = cut(light.groupBy("cls").agg(F.min("id").alias("id"), F.first("fps").alias("fps")))
    held = first.select("cls", F.posexplode("fps").alias("view", "fp"))
    leads = narrow(held.groupBy("view", "fp").agg(F.min("cls").alias("lead")))
    edges = links(leads.select("view", "fp"), RING3, VIEWS, WHOLE)
    named = leads.select("view", F.col("fp").alias("a"), F.col("lead").alias("x")), leads.select("view", F.col("fp").alias("b"), F.col("lead").alias("y"))
    same = held.join(leads, ["view", "fp"]).where("cls <> lead").select(F.col("lead").alias("x"), F.col("cls").alias("y"))
    near = edges.join(named[0], ["view", "a"]).join(named[1], ["view", "b"]).where("x <> y").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
    pairs = narrow(near.unionByName(same).distinct())
    wanted = pairs.select(F.col("x").alias("cls")).unionByName(pairs.select(F.col("y").alias("cls"))).distinct().join(first.select("cls", "id"), "cls")

    def sets(of: DataFrame) -> DataFrame:
        """cls and shingles s of the texts in `of` (cls, id), perhaps of others too."""
        compared = _among(narrow(of))

        def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                texts = b.column("text").to_pylist()
                cls = np.array([text_class(t) for t in texts], np.int64)
                ok = np.flatnonzero(probe(compared.value, _hash_pair(cls, b.column("id").to_numpy()))) if len(texts) else []
                yield pa.RecordBatch.from_arrays([pa.array(cls[ok]), pa.array([shingle_set(texts[i]) for i in ok], pa.list_(pa.int32()))], ["cls", "s"])

        return docs.select(number.alias("id"), "text").mapInArrow(shingled, "cls long, s array<int>")

    judged = narrow(_judged(pairs, sets(wanted)))
    roots = _settled(judged, first.select("cls", "id"), sets)
    grouped = first.select("cls", "id").join(roots, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    best = grouped.groupBy("root").agg(F.min(F.struct("id", "cls")).alias("best"))
    keeper = grouped.join(best, "root").select("cls", F.col("best.id").alias("keep_id"), F.col("best.cls").alias("keep_cls"))
    rows = light.groupBy("cls", "id").agg(F.count("*").alias("n")).join(keeper, "cls")
    gone = narrow(rows.withColumn("gone", (F.col("id") != F.col("keep_id")) | (F.col("cls") != F.col("keep_cls"))).where("gone or n > 1").select("cls", "id", "gone"))
    # most rows are surely not among those that go or repeat, and are not shuffled
    leaving = _among(gone)

    @F.pandas_udf("struct<cls: long, maybe: boolean>")
    def judge(texts: pd.Series, ids: pd.Series) -> pd.DataFrame:
        cls = np.array([text_class(t) for t in texts], np.int64)
        return pd.DataFrame({"cls": cls, "maybe": probe(leaving.value, _hash_pair(cls, ids.to_numpy()))})

    kept = [by_name(c) for c in docs.columns]
    # said not to be deterministic, so that no filter asks it once more below: two at a time take two workers of a task
    judge = judge.asNondeterministic()
    judged = docs.select(*kept, number.alias("__dup_id"), judge("text", number).alias("__dup_m"))
    going = gone.select(F.col("cls").alias("__dup_cls"), F.col("id").alias("__dup_id"), F.col("gone").alias("__dup_gone"))
    doubtful = judged.where("__dup_m.maybe").withColumn("__dup_cls", F.col("__dup_m.cls")).join(going, ["__dup_cls", "__dup_id"], "left")
    sure = doubtful.where("__dup_gone is null").select(*kept)
    once = doubtful.where("not __dup_gone").dropDuplicates(["__dup_cls", "__dup_id"]).select(*kept)
    return judged.where("not __dup_m.maybe").select(*kept).unionByName(sure).unionByName(once)
