import itertools
import math
import random
from collections import Counter

import pytest

from landfold.operators import segments

WORDS = {"中国": 8, "中": 3, "国": 2, "国人": 4, "人民": 6, "人": 5, "民": 1, "中国人": 2, "上海": 3, "海": 4, "在": 7, "ab": 3, "a": 2, "abc": 1, "bc": 2}


def best_path(run):
    """All segmentations, the most probable and then the one with longer words first."""
    total, found = sum(WORDS.values()), []
    for cuts in itertools.product([0, 1], repeat=len(run) - 1):
        at = [0, *(i + 1 for i, c in enumerate(cuts) if c), len(run)]
        parts = [run[a:b] for a, b in itertools.pairwise(at)]
        if all(p in WORDS or len(p) == 1 for p in parts):
            found.append((round(sum(math.log(WORDS.get(p, 1) / total) for p in parts), 7), [len(p) for p in parts], parts))
    return max(found)[2]


def positions(s, part):
    """All ways in which positions may follow each other."""
    found = []
    for places in itertools.product("BMES", repeat=len(part)):
        if places[0] in "BS" and places[-1] in "ES" and all(b in segments.AFTER[a] for a, b in itertools.pairwise(places)):
            v = s.begins[places[0]] + sum(s.follows[a + b] for a, b in itertools.pairwise(places)) + sum(s.says[p].get(c, segments.NEVER) for p, c in zip(places, part, strict=True))
            found.append((v, "".join(places)))
    return max(found)


def brute(s, run):
    out = []
    for known, group in itertools.groupby(best_path(run), lambda p: p in WORDS):
        group = list(group)
        if known or len("".join(group)) == 1:
            out += group
            continue
        part, begin = "".join(group), 0
        for i, p in enumerate(positions(s, part)[1]):
            if p in "ES":
                out.append(part[begin : i + 1])
                begin = i + 1
    return out


def texts(rng, n):
    return ["".join(rng.choice(["中", "国", "人", "民", "上", "海", "在", "a", "b", "c", "新", "x", " ", "，"]) for _ in range(rng.randint(0, 16))) for _ in range(n)]


def test_segmentations_equal_a_search_over_all():
    s, rng = segments.Segmenter(WORDS), random.Random(1)
    for run in {r for t in texts(rng, 400) for r in t.replace("，", " ").split() if len(r) <= 9}:
        got = s.cut(run)
        assert "".join(got) == run
        if got != brute(s, run):  # unknown parts of equal probability
            parts = ["".join(g) for k, g in itertools.groupby(best_path(run), lambda p: p in WORDS) if not k]
            assert any(abs(sorted(v for v, _ in [positions(s, p)])[0] - positions(s, p)[0]) < 1e-6 for p in parts if len(p) > 1)


@pytest.fixture(scope="module")
def words(spark):
    rows = [(w, n) for w, n in WORDS.items()] + [("AB", 0), ("", 5), (None, 3), ("x", -1)]
    return spark.createDataFrame(rows, "word string, n long")


def test_word_counts_of_texts(spark, words):
    rng, s = random.Random(2), segments.Segmenter(WORDS)
    given = [*texts(rng, 120), None, "", "，", "AbC 中国人民在上海 ABC"]
    df = spark.createDataFrame(list(enumerate(given)), "id int, t string").repartition(3)
    want = Counter(w for t in given for r in (t or "").lower().replace("，", " ").split() for w in s.cut(r))
    assert {r.word: r.n for r in segments.word_freq(df, "t", words).collect()} == want
    stop = spark.createDataFrame([("中国",), ("在",)], "word string")
    assert segments.word_freq(df, "t", words, stop).count() == len(want) - 2
    own = segments.word_freq(df, "t", words, custom={"新X": 50}).collect()
    assert "新x" in {r.word for r in own} or not any("新x" in (t or "") for t in given)
    each = {r.id: r.segments for r in segments.segmented(df, "t", words).collect()}
    assert Counter(w for x in each.values() for w in x) == want and each[len(given) - 4] == []


def test_dictionaries(spark, monkeypatch):
    df = spark.createDataFrame([("a a a b b c",), ("a b d d",), (None,)], "t string")
    got = lambda **o: {r.word: r.n for r in segments.learned(df, "t", **o).collect()}
    assert got() == {"a": 4, "b": 3, "d": 2} and got(most=2) == {"a": 4, "b": 3} and got(most=0) == {} and got(least=1) == {"a": 4, "b": 3, "d": 2, "c": 1}
    empty = spark.createDataFrame([], "word string, n long")
    assert sum(r.n for r in segments.word_freq(df, "t", empty).collect()) == 10
    monkeypatch.setattr(segments, "MOST_WORDS", 2)
    with pytest.raises(ValueError):
        segments.word_freq(df, "t", segments.learned(df, "t"))


def test_counts_as_one_object(spark, tmp_path, words):
    import json

    from landfold.sources import sinks

    counted = segments.learned(spark.createDataFrame([("b b a a a \u4e2d\u56fd",)], "t string"), "t", least=1)
    sinks.write_counts(counted, str(tmp_path / "w"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "w")).collect()]
    assert [list(json.loads(x).items()) for x in lines] == [[("a", 3), ("b", 2), ("中国", 1)]]
    sinks.write_counts(counted.limit(0), str(tmp_path / "e"))
    assert [r.value for r in spark.read.text(str(tmp_path / "e")).collect()] == ["{}"]
    with pytest.raises(ValueError):
        sinks.write_counts(counted, str(tmp_path / "x"), most=2)
