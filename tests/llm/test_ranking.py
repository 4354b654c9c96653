import math
import random
import re
from collections import Counter

import numpy as np

from landfold.llm import ranking

DOCS = "doc_id long, text string, score string, item string"
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return [w.translate(LOWER) for w in TERM.findall(text or "")]


def brute(docs, items, k):
    held = [(i, Counter(words(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        found = []
        for doc, c in held:
            m = 100 - 50 + (50 * sum(c.values()) * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(words(text)) if c[t])
            if score > 0:
                found.append((-score, doc is None, doc or 0, doc))
        out += [(item, r, x[3], -x[0]) for r, x in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


def corpus(rng):
    say = lambda n: " ".join(rng.choice(["Alpha", "beta", "GAMMA", "délta", "東京", "x9", "rare%d" % rng.randint(0, 40), "the", "the"]) for _ in range(n))
    docs = [(i, say(rng.randint(1, 60))) for i in range(150)]
    docs += [(900 + i, docs[7][1]) for i in range(40)]  # ties
    docs += [docs[3], docs[3], (None, docs[7][1]), (300, None), (301, ""), (302, " .,;"), (303, "the " * 30_000 + "rare1"), (304, "É-é ß_ß 'tis\x7f\x80")]
    items = [(i, say(rng.randint(1, 20))) for i in range(12)] + [(50, None), (51, ""), (52, "unseen"), (53, docs[7][1]), (53, docs[7][1]), (None, "alpha rare3"), (54, "É ß tis")]
    return docs, items


def test_ranked_search(spark):
    docs, items = corpus(random.Random(5))
    d = spark.createDataFrame([(*x, "a", "b") for x in docs], DOCS).repartition(5)
    q = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, doc_id int")
    for k in (3, 50):
        got = sorted((tuple(r) for r in ranking.ranked_search(d, q, k).collect()), key=str)
        assert got == brute(docs, items, k)
    # many small shards, many passes
    shards, n = ranking.index(d, shard_bytes=400)
    assert shards.count() > 20
    got = sorted((tuple(r) for r in ranking.search(shards, n, q, 7, pass_bytes=300).collect()), key=str)
    assert got == brute(docs, items, 7)
    assert ranking.ranked_search(d, q).dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]


def test_empty_tables(spark):
    d, q = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert ranking.ranked_search(d, q).count() == 0
    assert ranking.ranked_search(q.toDF("doc_id", "text"), d.toDF("item_id", "text")).count() == 0
    nothing = spark.createDataFrame([(1, None), (2, "?")], "doc_id long, text string")
    assert ranking.ranked_search(nothing, q).count() == 0


def test_best_keeps_ties():
    rng = np.random.default_rng(2)
    for _ in range(200):
        n, k = int(rng.integers(1, 60)), int(rng.integers(1, 20))
        scores, ids, nulls = rng.integers(-1, 4, n), rng.permutation(n), rng.integers(0, 2, n)
        want = sorted((-s, z, i) for s, z, i in zip(scores, nulls, ids, strict=True) if s > 0)[:k]
        at = ranking.best(scores, nulls, ids, k)
        assert sorted((-scores[p], nulls[p], ids[p]) for p in at) == want


def test_terms():
    for text in ("", None, "a", "A b-c_d", "éÉ 東京x\x80 ~9", " x", "x "):
        assert [t.decode() for t in ranking.terms(text)] == words(text)
        assert ranking.n_terms(text) == len(words(text))
