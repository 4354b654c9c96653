import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from landfold.llm import ann, backoff, common, line_runs, media, mixing, passages, pieces, simhash, token_counts, toxicity
from landfold.llm.components import connected_components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, extra string"


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(60)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage = " ".join(f"p{i}" for i in range(60))
    base = [say(rng.randint(1, 90)) for _ in range(40)]
    texts = [*base, base[0], base[0].upper(), base[3] + " tail", f"{say(20)} {passage} {say(9)}", f"{say(30)} {passage.replace('p30', 'x')} {say(5)}", "", None, "   ", "\n\n", "A long line that comes again and again\nown " + say(4), "  a LONG line that comes again and again \nother", "x\na long line that comes again and again", "日本語 🙂 text <|endoftext|>", "z" * 5000, " ".join(["long"] * 6000)]
    rows = [(i, t, "en", None if i % 11 == 0 else f"s{i % 4}", None, "e") for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, (None, "null id", None, None, None, None), rows[2], rows[2]], DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def every(fn, empty):
    assert fn(empty).count() == 0


def rows(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(30)] + [(None, 1), (200, 200)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((find(a), find(b)))
            up[y] = x
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in list(up)}


def brute_fingerprint(text, k):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_simhash(spark, docs, empty):
    every(simhash.near_duplicates, empty)
    got = [(r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()]
    all_ = [(i, brute_fingerprint(t, 3)) for i, t in rows(docs)]
    group = list(range(len(all_)))
    for _ in range(len(all_)):
        for a in range(len(all_)):
            for b in range(a):
                if (all_[a][1] ^ all_[b][1]).bit_count() <= 3:
                    group[a] = group[b] = min(group[a], group[b])
    first = {g: min((all_[x][0] for x in range(len(all_)) if group[x] == g and all_[x][0] is not None), default=None) for g in group}
    want = [(i, f"{f:016x}", first[group[n]]) for n, (i, f) in enumerate(all_)]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_simhash_ring_finds_every_pair():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    flips = np.array([sum(1 << int(b) for b in rng.choice(64, 3, replace=False)) for _ in a], np.uint64)
    masks = np.array([m for _, _, m in simhash.RING3.keys()], np.int64).view(np.uint64)
    hit = (flips[:, None] & masks) == 0
    assert hit.any(1).all()
    starts = np.array([s for _, s, _ in simhash.RING3.keys()])
    assert all(any(simhash.RING3.linked(f, starts[i])[0] for i in np.flatnonzero(h)) for f, h in zip(flips, hit, strict=True))


def test_simhash_emits_every_difference_once():
    flips = [sum(1 << b for b in at) for n in (1, 2, 3) for at in itertools.combinations(range(64), n)]
    x = np.array(flips, np.uint64).view(np.int64)
    num, pair = np.nonzero((np.array([m for _, _, m in simhash.RING3.keys()], np.int64)[:, None] & x) == 0)
    fp = np.stack([np.zeros(len(pair), np.int64), x[pair]], 1).reshape(-1)
    batch = pa.RecordBatch.from_arrays([pa.array(np.repeat(num, 2)), pa.array(np.repeat(pair, 2)), pa.array(fp)], ["num", "key", "fp"])
    got = [a ^ b for out in simhash._search(simhash.RING3, 1, 0)(iter([batch])) for a, b in zip(out.column("a").to_pylist(), out.column("b").to_pylist(), strict=True)]
    assert sorted(got) == sorted(x.tolist())


def test_simhash_large_keys(spark, monkeypatch):
    rng = random.Random(5)
    seed = rng.getrandbits(63)
    fps = list({seed ^ (1 << rng.randrange(60)) ^ (1 << rng.randrange(60)) for _ in range(150)} | {rng.getrandbits(63) for _ in range(50)})

    def groups():
        e = simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long")).select("a", "b")
        return {(r.node, r.root) for r in connected_components(e).collect()}

    whole = groups()
    monkeypatch.setattr(simhash, "BLOCK", 20)
    assert groups() == whole and len(whole) > 100


def test_near_duplicate_stage(spark, docs, empty):
    every(simhash.drop_near_duplicates, empty)
    clashing = docs.withColumns({c: docs["extra"] for c in ("gone", "cls", "id", "m", "root", "best")})
    kept = simhash.drop_near_duplicates(clashing)
    assert kept.columns == clashing.columns
    ids = collections.Counter(r.doc_id for r in kept.collect())
    assert set(ids.values()) == {1}
    assert 0 in ids and 40 not in ids and 41 not in ids and 42 not in ids and 3 in ids and 1 in ids


def test_near_duplicates_around_a_refused_lead(spark):
    base = [f"v{i}" for i in range(200)]
    texts = [base]
    for c in range(6):  # the same words, so equal fingerprints; 0.83 like the original, 0.69 like each other
        texts.append(base[:])
        for at in range(10 + 30 * c, 31 + 30 * c, 10):
            texts[-1][at : at + 2] = texts[-1][at : at + 2][::-1]
    sets = [{tuple(t[i : i + 5]) for i in range(196)} for t in texts]
    like = lambda a, b: len(a & b) / len(a | b)
    assert all(like(sets[0], s) >= 0.8 for s in sets) and all(like(a, b) < 0.8 for a, b in itertools.combinations(sets[1:], 2))
    said = [" ".join(t) for t in texts]
    assert min(said, key=simhash.text_class) != said[0]
    other = " ".join(base[::-1])  # the same words, and like none
    docs = spark.createDataFrame([*enumerate(said), (9, other)], "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.drop_near_duplicates(docs).collect()) == [0, 9]


def test_members_that_cannot_be_near_never_meet(spark, monkeypatch):
    """A large group of near copies whose sets share most shingles, and few of which are near: F1 of round 3."""
    rng = random.Random(3)
    draw = lambda n: [rng.randrange(-(1 << 31), 1 << 31) for _ in range(n)]
    base = draw(60)
    sets = {c: sorted({*rng.sample(base, 48), *draw(12)}) for c in range(70)}
    for c in range(70, 76):  # near to one other each
        sets[c] = sorted({*sets[c - 70][2:], *draw(2)})
    near = lambda a, b: len(a := set(a)) and len(a & set(b)) >= 0.8 * len(a | set(b))
    frame = spark.createDataFrame(list(sets.items()), "cls long, s array<int>")
    judged = spark.createDataFrame([(0, c, near(sets[0], sets[c])) for c in range(1, 76)], "x long, y long, near boolean")
    asked, plain = [], simhash._judged
    monkeypatch.setattr(simhash, "_judged", lambda pairs, of: (asked.append(pairs.count()), plain(pairs, of))[1])
    got = {r.cls: r.root for r in simhash._settled(judged, spark.createDataFrame([(c, c) for c in sets], "cls long, id long"), lambda of: frame.join(of.select("cls"), "cls")).collect()}
    root = {c: c for c in sets}
    for a, b in itertools.combinations(sets, 2):
        if near(sets[a], sets[b]):
            lo, hi = sorted((root[a], root[b]))
            root = {c: lo if r == hi else r for c, r in root.items()}
    assert got == root and len(set(root.values())) == 70
    assert sum(asked) < 100  # of 2,850 pairs


def test_parities_refuse_no_near_pair():
    rng = np.random.default_rng(5)
    for n in (1, 5, 40, 700, 5000):
        a = np.unique(rng.integers(-(1 << 31), 1 << 31, n).astype(np.int32))
        for swaps in range(n // 9 + 1) if n < 100 else (n // 20, n // 9):
            b = np.unique(np.concatenate([a[swaps:], rng.integers(-(1 << 31), 1 << 31, swaps).astype(np.int32)]))
            apart = int(np.bitwise_count((simhash.parities(a) ^ simhash.parities(b)).view(np.uint64)).sum())
            assert apart <= len(np.setxor1d(a, b))
            if len(np.intersect1d(a, b)) >= 0.8 * len(np.union1d(a, b)):
                assert 9 * apart <= len(a) + len(b)


def test_narrow_frames_are_read_by_few_tasks(spark):
    got = common.narrow(spark.range(0, 1000, 1, 40))
    assert got.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism and got.count() == 1000 and got.agg(F.sum("id")).first()[0] == 499_500


def test_nearest(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(300, 8)).astype(np.float32).tolist()
    v[5] = v[40] = v[41] = v[77]
    data = [(i, x) for i, x in enumerate(v)] + [(300, None), (320, [0.0] * 8), (340, [float("nan")] * 8), (360, [None] * 8), (None, v[0]), (20, v[1]), (380, [1.0, 2.0])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>")
    ok = [(i, x) for i, x in data if i is not None and x is not None and not any(e is None or not math.isfinite(e) for e in x) and any(x)]
    want = []
    for n, (i, x) in enumerate(ok):
        if i % 20 == 0:
            scores = []
            for m, (j, y) in enumerate(ok):
                if m != n and len(y) == len(x):
                    s = 0.0
                    for p, q in zip(x, y, strict=True):
                        s += p * q
                    scores.append((-s, j))
            want += [(i, r + 1, j, -s) for r, (s, j) in enumerate(sorted(scores)[:20])]
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in ann.nearest(df).collect()]
    assert sorted(got) == sorted(want)
    assert ann.nearest(df.limit(0)).count() == 0


def test_wide_codes_stay_within_their_bounds():
    rng = np.random.default_rng(6)
    for width in (3, 2048, 4096):
        v = np.sign(rng.normal(size=(40, width))) * rng.choice([1.0, 0.999, 1e-3], (40, width))
        code, step, error, length = ann.quantise(v)
        whole = code.astype(np.int64) @ code.astype(np.int64).T
        assert (ann.products(code, code) == whole).all()
        true = v @ v.T
        slack = error[:, None] * (length + error)[None] + length[:, None] * error[None] + 1e-9 * (1 + np.abs(true))
        assert (np.abs(true - whole * step[:, None] * step[None]) <= slack).all()


def test_nearest_over_many_tiles(spark, monkeypatch):
    monkeypatch.setattr(ann, "QUERY_BLOCK", 3)
    monkeypatch.setattr(ann, "ROW_BLOCK", 40)
    monkeypatch.setattr(ann, "STRIP", 2)
    v = np.random.default_rng(8).normal(size=(400, 6)).round(1)
    v[30:130:2] = v[40]  # more copies than are asked for
    v[:300:60] = 3 * v[40]
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in ann.nearest(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")).collect()]
    want = []
    for i in range(0, 400, 20):
        best = sorted((-float(ann.inner(v[i : i + 1], v[j : j + 1])[0]), j) for j in range(400) if j != i)[:20]
        want += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    assert sorted(got) == want


def test_token_counts_and_pieces(spark, docs, empty):
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    json, model = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    every(lambda d: token_counts.token_counts(d, json), empty)
    every(lambda d: pieces.encode_pieces(d, model), empty)
    tok, sp = Tokenizer.from_file(json), sentencepiece.SentencePieceProcessor(model_file=model)
    text = dict(rows(docs))
    for r in token_counts.token_counts(docs, json).collect():
        t = text[r.doc_id] or ""
        assert (r.n_bytes, r.n_tokens) == (len(t.encode()), len(tok.encode(t, add_special_tokens=False).ids))
        assert r.over_limit == (r.n_tokens > 512)
    for r in pieces.encode_pieces(docs, model).collect():
        t = text[r.doc_id] or ""
        assert list(r.ids) == sp.encode(t) and r.n_pieces == len(r.ids) and r.round_trip
        assert r.decoded_sha256 == hashlib.sha256(sp.decode(sp.encode(t)).encode()).hexdigest()


def test_lattice_finds_the_best_path(spark):
    score = {"a": -2.0, "b": -2.0, "ab": -3.0, "abc": -9.0, "c": -1.0, "bc": -2.5}
    table = spark.createDataFrame([(p, i) for i, p in enumerate(score)], "piece string, id int")
    names = list(score)

    def best(w):
        paths = [(0.0, [])] if not w else []
        for p, s in score.items():
            if w.startswith(p) and (rest := best(w[len(p) :])):
                paths.append((s + rest[0], [p, *rest[1]]))
        return max(paths, default=None)

    words = ["abc", "aabbc", "cab", "x", "abx", "xab"]
    got = {r.unit: r for r in pieces.lattice_encode(spark.createDataFrame([(w,) for w in words], "unit string"), table, dict(enumerate(score.values()))).collect()}
    assert len(got) == len(words)
    for w in words:
        want = best(w)
        assert (got[w].ids is None) == (want is None)
        if want:
            assert math.isclose(got[w].score, want[0]) and [names[i] for i in got[w].ids] == want[1]


@pytest.mark.parametrize("table_units", [pieces.TABLE_UNITS, 30])
def test_pieces_equal_the_library(spark, docs, table_units):
    import public_tokenizers
    import sentencepiece

    model = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    rng = random.Random(4)
    marks = ["▁", " ", "  ", "   ", "\n", "x²", "².", "_", "%%", "é", "é", "漢", "🙂", "7", "12", "'s", "http://", "\t", "ß"]
    odd = ["".join(rng.choice([*marks, "the", "ing", "zzzz", "Ünter"]) for _ in range(rng.randint(1, 40))) for _ in range(150)]
    odd += [" lead", "trail ", "z" * 70, "word " * 500, "a  b" + " " * 40 + "c", None, None, "same", "same"]
    df = spark.createDataFrame([(None if i % 50 == 0 else i % 140, t, i, "n") for i, t in enumerate(odd)], "doc_id long, text string, unit int, t1 string")
    got = sorted((repr(r.doc_id), list(r.ids), r.n_pieces, r.decoded_sha256, r.round_trip) for r in pieces.encode_pieces(df, model, table_units).collect())
    want = []
    for r in df.collect():
        ids = sp.encode(r.text or "")
        want.append((repr(r.doc_id), ids, len(ids), hashlib.sha256(sp.decode(ids).encode()).hexdigest(), sp.decode(ids) == (r.text or "").replace("▁", " ")))
    assert got == sorted(want)


def test_mixture(spark, docs, empty, monkeypatch):
    every(mixing.mixture, empty)
    every(mixing.mixed_documents, empty)
    for words, bale in ((mixing.SHARD_WORDS, mixing.BALE), (1000, 64)):
        monkeypatch.setattr(mixing, "SHARD_WORDS", words)
        monkeypatch.setattr(mixing, "BALE", bale)
        got = mixing.mixture(docs).collect()
        assert sorted(map(repr, got)) == sorted(map(repr, mixing.mixture(docs.repartition(7)).collect()))
        source = {r.doc_id: r.source for r in docs.collect()}
        text = dict(rows(docs))
        by = collections.defaultdict(lambda: [0, 0, 0.0, 0])
        for r in got:
            assert r.size == len((text[r.doc_id] or "").encode().split()) and 0 <= r.taken <= 3 * r.size
            b = by[source[r.doc_id]]
            b[0], b[1], b[2], b[3] = b[0] + r.size, r.source_size, r.target, b[3] + r.taken
        alike = len(got) - len({r.doc_id for r in got})
        assert all(b[0] == b[1] and b[2] <= 3 * b[1] and abs(b[3] - b[2]) <= mixing.BLOCK + 1 + alike for b in by.values())
        assert math.isclose(sum(b[2] for b in by.values()), sum(b[0] for b in by.values()))
        clashing = docs.withColumns({c: docs["extra"] for c in ("target", "taken", "size", "source_size", "words", "length", "blocks", "shards", "t", "n", "o", "shard", "quota", "start", "end")})
        mixed = mixing.mixed_documents(clashing)
        assert mixed.columns == clashing.columns
        out = mixed.collect()
        assert sum(len(r.text.split()) for r in out) == sum(r.taken for r in got) and {r.taken for r in out} <= {"e", None}


def test_mixture_equals_its_sql_with_many_shards(spark, docs, monkeypatch):
    import duckdb

    pd = docs.toPandas()  # noqa: F841
    db = duckdb.connect()
    db.sql("create table documents as select doc_id::bigint as doc_id, text, source from pd")
    got = sorted(repr(tuple(r)) for r in mixing.mixture(docs).collect())
    assert got == sorted(repr(r) for r in db.sql(mixing.ORACLE).fetchall())


def test_apportion_is_highest_quotients(spark):
    votes = {"a": 53.0, "b": 24.0, "c": 23.0, "d": 0.0, "e": 1.5}
    df = spark.createDataFrame([("x", k, v, 17) for k, v in votes.items()], "g string, k string, v double, seats long")
    got = {r.k: r.quota for r in mixing.apportion(df, "seats", "v", ["k"], ["g"]).collect()}
    best = sorted(((-v / (2 * s + 1), k) for k, v in votes.items() if v for s in range(17)))[:17]
    assert {k: got[k] for k in votes} == {k: sum(b == k for _, b in best) for k in votes}


def test_passages(spark, docs, empty):
    every(passages.fuzzy_passages, empty)
    got = passages.fuzzy_passages(docs).collect()
    text = {i: (t or "").lower().split() for i, t in rows(docs)}
    found = {(r.doc_id, r.source_doc_id) for r in got}
    assert (44, 43) in found
    for r in got:
        assert r.source_doc_id < r.doc_id and min(r.n_words, r.source_n_words) >= 50
        assert len(text[r.doc_id][r.start_word : r.start_word + r.n_words]) == r.n_words
    runs = lambda t: {tuple(t[a : a + 50]) for a in range(len(t) - 49)}
    held = {i: runs(t) for i, t in text.items() if i is not None}
    for i, own in held.items():
        if any(own & held[j] for j in held if j < i):
            assert any(d == i for d, _ in found)


@pytest.mark.parametrize("length, share", [(60, 0.82), (60, 0.87), (60, 0.92), (120, 0.82), (120, 0.87)])
def test_planted_fuzzy_passages_are_found(spark, length, share):
    rng = random.Random(length + int(100 * share))
    word = lambda: f"w{rng.randrange(5000)}"
    data, pairs = [], 60
    for i in range(pairs):
        passage = [word() for _ in range(length)]
        edited = passage[:]
        for at in rng.sample(range(2, length - 2), round(length * (1 - share))):
            edited[at] = "x" + word()
        for j, p in ((i, passage), (1000 + i, edited)):
            data.append((j, " ".join([*(word() for _ in range(40)), *p, *(word() for _ in range(40))])))
    got = passages.fuzzy_passages(spark.createDataFrame(data, "doc_id long, text string")).collect()
    hits = {r.doc_id for r in got if r.source_doc_id == r.doc_id - 1000 and r.n_words >= 0.8 * length}
    assert len(hits) >= 0.9 * pairs and all(r.n_equal >= 0.8 * max(r.n_words, r.source_n_words) for r in got)


def test_quick_answers_equal_the_alignment(monkeypatch):
    rng = np.random.default_rng(9)
    jobs = []
    for i in range(300):
        a = rng.integers(0, 40 if i % 3 else 4000, rng.integers(40, 190)).astype(np.uint64)
        b = a.copy()
        at = rng.random(len(a)) < rng.choice([0.02, 0.1, 0.2, 0.5])
        b[at] = rng.integers(0, 40, int(at.sum()))
        for _ in range(rng.integers(0, 3)):
            cut = int(rng.integers(0, len(b)))
            b = np.concatenate([b[:cut], rng.integers(0, 40, 2).astype(np.uint64), b[cut + int(rng.integers(0, 3)) :]])
        jobs.append((a, b, 0, int(rng.integers(0, 3))))
    quick, slow = passages.align(jobs), passages._banded(jobs)
    score = lambda g, j: 0 if g is None else sum(2 * x - 1 for x in [True] * g[4] + [False] * (max(g[1], g[3]) - g[4]))
    for q, s, j in zip(quick, slow, jobs, strict=True):
        if s and min(s[1], s[3]) >= 50 and s[4] >= 0.8 * max(s[1], s[3]):
            assert q is not None and (score(q, j) >= score(s, j) - 2 or passages._one_diagonal(j))


def test_seeds_of_repeated_words_and_of_shared_runs():
    rng = np.random.default_rng(5)
    assert len(passages.seeds(np.full(5000, 7, np.uint64))[0]) == 4  # first and last of either length
    for _ in range(50):
        run = rng.integers(0, 1 << 63, 43).astype(np.uint64)
        a, b = (passages.seeds(np.concatenate([rng.integers(0, 1 << 63, 600).astype(np.uint64), run, rng.integers(0, 1 << 63, 9).astype(np.uint64)]))[1] for _ in "ab")
        both = np.intersect1d(a, b)
        assert (both & np.uint64(1)).any() and (~both & np.uint64(1)).sum() >= 4


def test_passages_of_repeated_ids_long_drift_and_frequent_seeds(spark):
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(50000)}"
    a, b = [word() for _ in range(120)], [word() for _ in range(120)]
    long = [word() for _ in range(3000)]
    drifting = [w for i, x in enumerate(long) for w in ([x, word()] if i % 25 == 0 else [x])]
    shared = [word() for _ in range(60)]
    bits = [(100 + i, " ".join([*(word() for _ in range(9)), *shared[i : i + 12], *(word() for _ in range(9))])) for i in range(0, 49)]
    data = [(5, " ".join(a)), (5, "zz " + " ".join(b)), (9, " ".join(a)), (10, " ".join(b)), (20, " ".join(long)), (21, " ".join(drifting)), *bits, (300, " ".join(shared)), (301, " ".join([word(), *shared]))]
    got = passages.fuzzy_passages(spark.createDataFrame(data, "doc_id long, text string")).collect()
    kept = min(" ".join(a), "zz " + " ".join(b)).split()[0] == a[0]
    assert ((9 if kept else 10), 5) in {(r.doc_id, r.source_doc_id) for r in got}
    assert ((10 if kept else 9), 5) not in {(r.doc_id, r.source_doc_id) for r in got}
    covered = {w for r in got if (r.doc_id, r.source_doc_id) == (21, 20) for w in range(r.start_word, r.start_word + r.n_words)}
    assert len(covered) >= 0.98 * len(drifting)
    assert (301, 300) in {(r.doc_id, r.source_doc_id) for r in got}


@pytest.mark.parametrize("length, gap", [(60, 31), (60, 45), (60, 59), (60, 75), (100, 60), (200, 150)])
def test_two_passages_with_a_gap(length, gap):
    rng = np.random.default_rng(length + gap)
    word = lambda n: rng.integers(1, 1 << 63, n).astype(np.uint64)
    one, two = word(length), word(length)
    a, b = (np.concatenate([word(70), one, word(gap), two, word(70)]) for _ in "ab")
    places = [70, 70 + length + gap]
    got = passages.shared([(a, b, 0, 0)], [(70, 70 + 2 * length + gap)])[0]
    assert all(min(n, m) >= 50 and e >= 0.8 * max(n, m) for _, n, _, m, e in got)
    assert all(any(s <= p and s + n >= p + length and s2 <= p and s2 + m >= p + length for s, n, s2, m, _ in got) for p in places)


def test_alignment_and_chain():
    a = np.arange(1, 201, dtype=np.uint64)
    b = np.concatenate([a[:90], a[93:150], np.arange(900, 905, dtype=np.uint64), a[150:]])
    (start, n, start_b, n_b, equal), = passages._banded([(a, b, 0, 8)])
    assert (start, n, start_b, n_b, equal) == (0, 200, 0, 202, 197)
    k = np.full(4, 5)
    assert passages.chains(np.array([0, 5, 10, 60]), np.array([100, 105, 110, 3]), k) == [(0, 15, 100, 115, 0, 15)]
    assert passages.chains(np.array([0, 5, 10, 400]), np.array([100, 105, 110, 500]), np.array([5, 5, 5, 20])) == [(0, 15, 100, 115, 0, 15), (400, 420, 500, 520, 0, 20)]
    rng = np.random.default_rng(2)
    p = np.sort(rng.choice(300, 40, replace=False))
    q = np.where(rng.random(40) < 0.7, p + 20, rng.integers(0, 300, 40))
    best = []  # of chains that end at each match, by trying all matches before
    for i in range(40):
        steps = [best[j] - passages.GAP / 2 * (p[i] + q[i] - p[j] - q[j]) for j in range(i) if p[j] < p[i] and q[j] < q[i]]
        best.append(5 + max([0.0, *steps]))
    first = passages.chains(p, q, np.full(40, 5))[0]
    at = int(np.argmax(best))
    assert (first[1], first[3]) == (p[at] + 5, q[at] + 5)


@pytest.mark.parametrize("order", [2, 3])
def test_backoff(spark, docs, empty, monkeypatch, order):
    monkeypatch.setattr(backoff, "CHUNK_BYTES", 2000)
    every(backoff.backoff_scores, empty)
    words = [(i, (t or "").encode().lower().split()) for i, t in rows(docs)]
    count = collections.Counter(tuple(w[i : i + n]) for _, w in words for n in range(1, order + 1) for i in range(len(w) - n + 1))
    total = sum(len(w) for _, w in words)

    def score(w, i):
        penalty = 1.0
        for n in range(min(order, i + 1), 1, -1):
            if count[g := tuple(w[i - n + 1 : i + 1])] >= 2:
                return penalty * count[g] / count[g[:-1]]
            penalty *= 0.4
        return penalty * count[w[i],] / total

    want = sorted(((str(i), len(w), round(sum(math.log(score(w, j)) for j in range(len(w))), 6)) for i, w in words))
    got = sorted((str(r.doc_id), r.n_words, round(r.log_score, 6)) for r in backoff.backoff_scores(docs, order).collect())
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert all(abs(g[2] - w[2]) < 1e-4 for g, w in zip(got, want, strict=True))


def test_backoff_takes_rows_in_any_order(spark, docs, monkeypatch):
    monkeypatch.setattr(backoff, "CHUNK_BYTES", 500)
    whole = {r.doc_id: r.log_score for r in backoff.backoff_scores(docs.dropDuplicates(["doc_id"])).collect()}
    again = {r.doc_id: r.log_score for r in backoff.backoff_scores(docs.dropDuplicates(["doc_id"]).withColumn("n_words", docs["extra"]).repartition(5, "source")).collect()}
    assert whole.keys() == again.keys() and all(math.isclose(v, again[k], abs_tol=1e-6) for k, v in whole.items())


def test_media(spark, docs, empty):
    every(media.media_columns, empty)
    text = dict(rows(docs))
    for r in media.media_columns(docs).collect():
        raw = (text[r.doc_id] or "").encode()
        pay = raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(pay), hashlib.sha256(pay).hexdigest(), zlib.crc32(pay[-16:]))
    for kind in media.KINDS:
        blob = media.store(media.pad("BM RIFF P6 \x89PNG")[0], kind)
        tail = media.store(media.pad("t")[0], "bmp")
        both = media.sniff(b"junk BM RIFF" + blob + b"P6 1 1 " + tail)
        assert [(m.kind, m.length) for m in both] == [(kind, len(blob)), ("bmp", len(tail))]
        assert media.sniff(blob[:-1]) == []
    for r in media.media_columns(docs).collect():
        payload = media.pad(text[r.doc_id])[0]
        kind = r.feature.split(";")[0]
        stored = media.store(payload, kind)
        assert kind == media.KINDS[zlib.crc32(payload) % 4] and (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
        assert r.feature.endswith(f"rows={len(payload) // 192};sum={sum(payload)};distinct={len(set(payload))}")
    one = media.store(b"x" * 192, "png")
    df = spark.createDataFrame([(bytearray(one), "image/bmp", 1), (bytearray(b"none"), "t", 2), (None, None, 3), (bytearray(b"12 " + one + one), "text", 4)], "b binary, d string, media int")
    found = media.sniff_column(df, "b", "d").collect()
    assert [r.corrected_type for r in found] == ["png", "t", None, "text"]
    assert [r.media and [(m.start, bytes(m.content) == one) for m in r.media] for r in found] == [[(0, True)], [], None, [(3, True), (3 + len(one), True)]]


def test_line_dedup(spark, docs, empty):
    every(line_runs.line_report, empty)
    all_ = rows(docs)
    key = lambda line: line.strip(b" \t\n\r\x0b\x0c").lower()
    low = lambda i: -math.inf if i is None else i
    holders = collections.defaultdict(list)
    for i, t in all_:
        for k in {key(x) for x in (t or "").encode().split(b"\n")}:
            if len(k.decode()) >= 20:
                holders[k].append(low(i))
    want = []
    for i, t in all_:
        lines = (t or "").encode().split(b"\n")
        kept = [x for x in lines if len(holders.get(key(x), [])) < 3 or max(holders[key(x)]) == low(i)]
        want.append((i, len(lines), len(lines) - len(kept), hashlib.sha256(b"\n".join(kept)).hexdigest()))
    got = [(r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in line_runs.line_report(docs).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr) and sum(w[2] for w in want) > 1
    out = line_runs.drop_repeated(docs)
    assert out.columns == docs.columns and out.count() == docs.count()


def test_line_runs_by_batches(spark, docs):
    store = line_runs.LineRuns(spark, 3)
    for i in range(5):
        store.add(line_runs.lines_of(docs.where(f"coalesce(doc_id, 0) % 5 = {i}")))
    assert sorted(level for level, _ in store.runs) == [0, 2]
    assert store.keys().exceptAll(line_runs.line_counts(line_runs.lines_of(docs))).count() == 0
    own = store._union([name for _, name in store.runs])
    assert own.count() == own.select("h1", "h2").distinct().count() == store.keys().count()
    new = spark.createDataFrame([(900, "a line that nobody has had so far"), (901, "a long line that comes again and again")], "doc_id long, text string")
    assert store.unseen(line_runs.line_counts(line_runs.lines_of(new))).count() == 1
    store.drop()
    assert not spark.catalog.listTables()


def test_line_dedup_keeps_any_columns(spark):
    line = "a line of twenty characters or more"
    data = [(i, f"{line}\nown {i}", i, "g", 1.5, [i]) for i in range(5)] + [(None, line, 9, "n", None, None), (4, f"{line}\nown 4", 4, "g", 1.5, [4]), (4, line, 5, "h", 2.5, None)]
    df = spark.createDataFrame(data, "doc_id int, text string, id int, gone string, row double, h1 array<int>")
    got = sorted(map(repr, line_runs.drop_repeated(df).collect()))
    keep = lambda i, t: t if i == 4 else "\n".join(x for x in t.split("\n") if x != line)
    want = spark.createDataFrame([(d[0], keep(d[0], d[1]), *d[2:]) for d in data], df.schema).collect()
    assert got == sorted(map(repr, want))


def test_toxicity(spark, empty):
    rng = random.Random(3)
    plain = [f"word{i}" for i in range(200)]
    data, labels = [], []
    for i in range(900):
        words, bad = [rng.choice(plain) for _ in range(30)], i % 3 == 0
        for n in range((1 + i % 4) * bad):
            words[n] = rng.choice(["vile", "awful", "nasty"])
        data.append((i, " ".join(words)))
        if i < 600:
            labels.append((i, int(bad)))
    docs = spark.createDataFrame([*data, (None, None), (1000, "")], "doc_id long, text string")
    marks = spark.createDataFrame([*labels, (None, 1), (5, None), (0, 0)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(docs, marks).collect()}
    right = sum(got[i].toxic == (i % 3 == 0) for i in range(600, 900))
    assert right >= 285 and not got[None].toxic and not got[1000].toxic
    mild = np.mean([got[i].expected_severity for i in range(600, 900) if i % 12 == 0])
    harsh = np.mean([got[i].expected_severity for i in range(600, 900) if i % 12 == 3])
    assert harsh > mild > 0.8
    assert toxicity.drop_toxic(docs, marks).columns == ["doc_id", "text"]
    every(lambda d: toxicity.toxicity(d, marks), empty)
    assert not any(r.toxic for r in toxicity.toxicity(docs, marks.limit(0)).collect())


def test_pipeline(spark):
    import public_tokenizers
    import sentencepiece

    import corpus_pipeline

    assert len(corpus_pipeline.STAGES) == 5
    sf = "/root/testdata/sf0.001"
    raw = spark.read.parquet(f"{sf}/documents.parquet")
    kept, given = [], raw
    for _, stage in corpus_pipeline.STAGES:
        given = spark.createDataFrame(stage(spark, given, sf).collect(), given.schema if len(kept) < 4 else None)
        kept.append(given.collect())
    toxic = {r.doc_id for r in toxicity.toxicity(raw, spark.read.parquet(f"{sf}/labels.parquet")).where("toxic").collect()}
    texts = {r.doc_id: r.text for r in raw.collect()}
    assert {r.doc_id for r in kept[0]} == set(texts) - toxic and toxic
    # line dedup
    key = lambda line: line.strip(" \t\n\r\x0b\x0c").lower() if line.isascii() else "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\r\x0b\x0c"))
    holders = collections.defaultdict(set)
    for r in kept[0]:
        for line in r.text.split("\n"):
            if len(key(line)) >= 20:
                holders[key(line)].add(r.doc_id)
    want = {r.doc_id: "\n".join(x for x in r.text.split("\n") if len(holders.get(key(x), ())) < 3 or max(holders[key(x)]) == r.doc_id) for r in kept[0]}
    assert {r.doc_id: r.text for r in kept[1]} == want
    # near-duplicates
    shingles = {r.doc_id: (w := r.text.lower().split()) and {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for r in kept[1]}
    first = {i: i for i in shingles}
    for _ in shingles:
        for a, b in itertools.combinations(sorted(shingles), 2):
            x, y = shingles[a] or {()}, shingles[b] or {()}
            if len(x & y) >= 0.8 * len(x | y):
                first[a] = first[b] = min(first[a], first[b])
        if all(first[first[i]] == first[i] for i in first):
            break
    left = {r.doc_id for r in kept[2]}
    assert left >= set(first.values()) and len(left) <= len(set(first.values())) + 1
    # the mix, and pieces
    taken = {r.doc_id: r.taken for r in mixing.mixture(spark.createDataFrame(kept[2], raw.schema)).collect()}
    words = collections.Counter()
    for r in kept[3]:
        words[r.doc_id] += len(r.text.split())
    assert {i: n for i, n in taken.items() if n} == dict(words)
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert sorted((r.doc_id, list(r.ids)) for r in kept[4]) == sorted((r.doc_id, sp.encode(r.text)) for r in kept[3]) and all(r.round_trip for r in kept[4])
    assert corpus_pipeline.run(spark, sf).count() == len(kept[4])


def test_tables_of_frequent_words_need_no_funnel(spark, docs):
    """What is broadcast is found by hash and by histogram: no texts and no units are sorted in one place."""
    from landfold.llm.queries import BYTE_BPE, tokenizer_path

    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    words = token_counts.sampled_words(docs, tokenizer_path(BYTE_BPE))
    assert "Limit" not in plan(words) and "Sort" not in plan(words) and words.count() > 60
    units = spark.createDataFrame([(f"u{i}", 1 + 1000 // (i + 1)) for i in range(900)], "unit string, n long")
    for most in (0, 1, 10, 120, 899, 900, 5000):
        kept, rest = pieces.most_frequent(units, most)
        assert "Limit" not in plan(kept) and "Sort" not in plan(kept)
        got = [r.n for r in kept.collect()]
        assert len(got) <= most * 1.2 + 5 and rest == (most < 900)
        # all above the step that is taken in part
        assert all(n in got for n in [1 + 1000 // (i + 1) for i in range(900)] if got and n > 1.2 * min(got))
    assert pieces.most_frequent(units.limit(0), 5)[1] is False


def test_latin_texts_are_split_alike():
    rng, general, fast = random.Random(1), re.compile(pieces.SPLITS[0]).findall, pieces.splitter(pieces.SPLITS[0])
    for _ in range(20_000):
        text = "".join(chr(rng.choice([rng.randrange(256), rng.randrange(32, 127), 32, 0x2581, 0x4E2D if rng.random() < 0.1 else 98])) for _ in range(rng.randint(0, 12)))
        text = (pieces.MARK + text).replace(" ", pieces.MARK)
        assert fast(text) == general(text)


def test_backoff_as_rows_gives_the_same(spark, docs, empty):
    every(backoff.relational_scores, empty)
    near = lambda df: sorted((repr(r.doc_id), r.n_words, round(r.log_score, 5), round(r.mean_log_score, 5)) for r in df.collect())
    assert near(backoff.relational_scores(docs)) == near(backoff.backoff_scores(docs))


def test_stages_take_columns_of_any_name(spark, docs):
    odd = docs.where("doc_id is not null").dropDuplicates(["doc_id"]).withColumnsRenamed({"extra": "a.b", "lang": "x`y z"}).withColumn("__1", F.lit(1))
    for stage in (line_runs.drop_repeated, mixing.mixed_documents, simhash.drop_near_duplicates):
        got = stage(odd)
        assert got.columns == odd.columns and got.dtypes == odd.dtypes
        assert {(r["a.b"], r["x`y z"], r["__1"]) for r in got.collect()} == {("e", "en", 1)}


def test_neighbours_of_pieces_are_told_without_memory(spark):
    """Which pieces stay apart is what merging says, and a worker holds no answers: its memory doesn't grow with what it is asked."""
    import public_tokenizers

    model = pieces.load(public_tokenizers.path("piece_bpe_32k.model"))
    sp, follows, rng = pieces._processor(model.path), pieces.Follows(model), np.random.default_rng(2)
    held = lambda: {k: np.size(v) for k, v in vars(follows).items()}
    before, text = held(), {i: p for p, i, _ in model.pieces if p.isalpha()}
    a, b = (rng.choice(list(text), 3000) for _ in range(2))
    got = follows.allowed(a.astype(np.int64), b.astype(np.int64))
    assert held() == before and 0 < got.sum() < len(got)
    assert got.tolist() == [sp.encode("\n" + text[x] + text[y])[2:] == [x, y] for x, y in zip(a.tolist(), b.tolist(), strict=True)]
    assert follows.allowed(np.array([-1, a[0]]), np.array([b[0], -1])).all()


def test_lattice_takes_counts_along_and_the_cache_is_not_walked(spark):
    table = spark.createDataFrame([("a", 0), ("ab", 1), ("b", 2)], "piece string, id int")
    units = spark.createDataFrame([("ab", 7), ("ba", 3), ("x", 1)], "unit string, n long")
    got = {r.unit: (r.n, r.ids) for r in pieces.lattice_encode(units, table, {0: -1.0, 1: -1.0, 2: -1.0}).collect()}
    assert got == {"ab": (7, [1]), "ba": (3, [2, 0]), "x": (1, None)}

    class Cache(dict):
        def keys(self):
            raise AssertionError("all of the cache is walked for each batch")

    import public_tokenizers

    encoder = pieces.Encoder(pieces.load(public_tokenizers.path("piece_bpe_32k.model")), pieces.Table(pa.table({"h": pa.array([], pa.int64()), "ids": pa.array([], pa.binary()), "odd": pa.array([], pa.binary())})))
    encoder.ids = Cache(known=b"")
    assert encoder.look_up([["known", "new"]]) == {"new"}


def test_a_settled_diagonal_asks_for_no_reach(monkeypatch):
    words = np.random.default_rng(3).integers(0, 1 << 40, 120).astype(np.uint64)
    job = (words, np.concatenate([words[:7] + np.uint64(1), words]), 7, 0)
    want = passages.shared([job], [(0, 119)])
    assert want == [[(0, 120, 7, 120, 120)]]
    monkeypatch.setattr(passages, "_within_reach", lambda j: pytest.fail("words in reach are looked for in vain"))
    assert passages.shared([job], [(0, 119)]) == want


def test_driver_gives_back_what_it_has_broadcast(spark, monkeypatch):
    import public_tokenizers

    gave = []
    monkeypatch.setattr(pieces, "give_back", lambda: gave.append("pieces"))
    pieces.encode_pieces(spark.createDataFrame([(1, "some words")], "doc_id long, text string"), public_tokenizers.path("piece_bpe_32k.model"))
    monkeypatch.setattr(toxicity, "give_back", lambda: gave.append("toxicity"))
    rows = [(i, "bad vile words" if i % 2 else "good kind words") for i in range(8)]
    toxicity.drop_toxic(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, toxic int"))
    assert gave == ["pieces", "toxicity"]


def test_banded_alignment_is_the_plain_one_in_blocks_of_any_size(monkeypatch):
    rng = np.random.default_rng(11)

    def plain(a, b, shift, spread):
        """The largest score of a local alignment whose places in b are within the band around a's."""
        width, best = passages.BAND + spread, {}
        for i in range(len(a)):
            for j in range(max(0, i + shift - width), min(len(b), i + shift + width + 1)):
                both = best.get((i - 1, j - 1), 0) + (1 if a[i] == b[j] else -1)
                best[i, j] = max(0, both, best.get((i - 1, j), 0) - 1, best.get((i, j - 1), 0) - 1)
        return max(best.values(), default=0)

    jobs = []
    for n in (1, 30, 61, 150):
        a = rng.integers(1, 40, n).astype(np.uint64)
        b = np.delete(np.where(rng.random(n) < 0.1, np.uint64(99), a), rng.integers(0, n, n // 20))
        jobs += [(a, b, 0, 0), (a, np.concatenate([a[:5], b]), 5, 3), (a, b, -7, 0)]
    jobs.append((jobs[0][0], np.full(3, 77, np.uint64), 0, 0))
    ways = []
    want = passages._banded(jobs, ways)
    assert [0 if w is None else 2 * w[4] - len(way) for w, way in zip(want, ways, strict=True)] == [plain(*j) for j in jobs] and want[-1] is None
    monkeypatch.setattr(passages, "ROW_CELLS", 1)
    assert passages._banded(jobs) == want


def test_k_mers_of_texts_hashed_together_are_those_of_each():
    rng = np.random.default_rng(4)
    each = [rng.integers(0, 1 << 63, n).astype(np.uint64) for n in (0, 3, 5, 19, 20, 300, 0, 41)]
    for words, (places, hashes) in zip(each, passages.seeds_of_all(each), strict=True):
        at, h = passages.seeds(words)
        assert places.tolist() == at.tolist() and hashes.tolist() == h.tolist() and (len(at) > 0) == (len(words) >= passages.K)


def test_a_task_of_the_pipeline_takes_one_worker(spark, docs):
    """The near-duplicate stage asks Python once between exchanges, and the pieces come without Python."""
    import public_tokenizers

    plan = simhash.drop_near_duplicates(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == plan.count("judge(") == 3  # one for each branch of the union
    frame = pieces.piece_frame(spark, pieces.load(public_tokenizers.path("piece_bpe_32k.model")))
    assert "LocalRelation" in frame._jdf.queryExecution().optimizedPlan().toString()
    assert frame.dtypes == [("piece", "string"), ("id", "int")] and frame.count() > 30_000


def test_pieces_are_packed_once_and_asked_once(spark):
    """No sort that packs all units twice, and one question to the cache for each unit of a text."""
    import public_tokenizers

    model = pieces.load(public_tokenizers.path("piece_bpe_32k.model"))
    name = lambda i: "▁x" + "abcdefghij"[i % 10] + "abcdefghij"[i // 10 % 10] * (1 + i // 100)
    packed = pieces._packed(spark.createDataFrame([(name(i), [i]) for i in range(3000)], "unit string, ids array<int>"), model)
    assert "rangepartitioning" not in packed._jdf.queryExecution().executedPlan().toString()
    got = pieces._in_order(packed.toArrow())
    h = got.column("h").to_pylist()
    assert h == sorted(h) and dict(zip(h, got.column("ids").to_pylist(), strict=True)) == {pieces._hash(name(i)): np.array([i], "uint16").tobytes() for i in range(3000)}
    assert len(pieces._in_order(got.slice(0, 0))) == 0

    class Cache(dict):
        asked = 0

        def get(self, unit):
            self.asked += 1
            return super().get(unit)

    encoder = pieces.Encoder(model, pieces.Table(got))
    encoder.ids = Cache()
    for seen in range(2):
        read = encoder.read("".join(name(i)[1:] + " " for i in range(40))[:-1])
        assert encoder.ids.asked == 40 * (seen + 1) and len(read.units) == (0 if seen else 40)
        assert encoder.look_up([read.units]) == set() and encoder.encode(read).tolist() == list(range(40))
        assert encoder.decode(read) == pieces._decoded(model, np.arange(40)).decode("utf-8", "replace")[1:]  # not the units: told as such
