import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from landfold.llm import language

DOCS = "doc_id long, text string, lang string, source string, score double"
#: Syllables of invented languages.
SAYS = {"aa": ["ka", "lo", "mi", "tu"], "bb": ["schr", "ein", "ung", "ß"], "cc": ["ció", "ñe", "llo", "ra"], "日": ["日本", "語", "東"]}


def say(rng, lang, n):
    return " ".join("".join(rng.choices(SAYS[lang], k=rng.randint(1, 4))).capitalize() for _ in range(n))


def units(text):
    """Runs of letters, lower-cased, found one character after the other."""
    return ["".join(g) for letter, g in itertools.groupby(text.lower(), str.isalpha) if letter]


def counter_of(a, b, c):
    """The counter of a trigram, by plain integers."""
    m, odd = (1 << 64) - 1, [int(x) for x in language._ODD]
    h = (ord(a) * odd[0] & m) ^ (ord(b) * odd[1] & m) ^ (ord(c) * odd[2] & m)
    h = (h ^ (h >> 29)) * odd[1] & m
    h ^= h >> 32
    return (h >> 8) & (language.DIM - 1)


def grams(unit):
    x = "\0\0" + unit + "\0"
    return [counter_of(*("\0" if x[i - 1] == "\0" else x[i - 2], x[i - 1], x[i])) for i in range(2, len(x))]


class Brute:
    def __init__(self, rows):
        self.counts = {}
        for i, text, lang in rows:
            if text is not None and lang is not None and zlib.crc32(str("" if i is None else i).encode()) % 3 != 1:
                self.counts.setdefault(lang, Counter()).update(g for u in units(text) for g in grams(u))
        self.languages = sorted(self.counts)
        self.all = sum(self.counts.values(), Counter())

    def log(self, unit, lang):
        c, n, total = self.counts[lang], self.counts[lang].total(), self.all.total()
        return sum(math.log((1 - language.COMMON) * c[g] / max(n, 1) + language.COMMON * (self.all[g] + language.LEAST) / (total + language.LEAST * language.DIM)) for g in grams(unit))

    def level(self, held, share):
        return sum(n * math.log(sum(share[j] * math.exp(x - max(log)) for j, x in enumerate(log))) + n * max(log) for n, log in held)

    def fit(self, held, chosen):
        share = [1 / len(chosen) if j in chosen else 0.0 for j in range(len(self.languages))]
        for _ in range(300):
            new = [0.0] * len(share)
            for n, log in held:
                p = [s * math.exp(x - max(log)) for s, x in zip(share, log, strict=True)]
                for j, x in enumerate(p):
                    new[j] += n * x / sum(p)
            total = sum(new)
            share = [x / total for x in new]
        return share

    def predict(self, text):
        bag = Counter(units(text or ""))
        if not bag or not self.languages:
            return "und", []
        held = [(n, [self.log(u, x) for x in self.languages]) for u, n in bag.items()]
        cost = language.PENALTY * math.log(1 + sum(bag.values()))
        # all subsets; the nested ones that the operator tries must hold the best
        found = []
        for k in range(1, len(self.languages) + 1):
            for chosen in itertools.combinations(range(len(self.languages)), k):
                share = self.fit(held, chosen)
                found.append((self.level(held, share) - (k - 1) * cost, share))
        share = max(found)[1]
        best = sorted((-s, x) for s, x in zip(share, self.languages, strict=True) if s > 1e-9)
        return best[0][1], [-s for s, _ in best]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    out = []
    for i in range(160):
        lang = rng.choice(list(SAYS))
        out.append((i, say(rng, lang, rng.randint(1, 25)), lang))
    for i in range(160, 172):  # two languages in one text, labelled with neither
        a, b = rng.sample(list(SAYS), 2)
        out.append((i, say(rng, a, 30) + ". " + say(rng, b, 12), None))
    odd = [None, "", "  12 !?\n", "x", "ZZZ qqq", "İSTANBUL ΣΑΣ", say(rng, "aa", 3) + " 42 \x00\x01", "é" * 40]
    return out + [(200 + i, t, None) for i, t in enumerate(odd)] + [(None, say(rng, "bb", 9), "bb"), out[3], out[3], (400, None, "aa")]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, None, 0.5) for i, t, lang in rows], DOCS)


def test_against_brute_force(spark, rows):
    got = language.identified(frame(spark, rows).repartition(3)).collect()
    assert len(got) == len(rows)
    brute = Brute(rows)
    want = Counter()
    for i, t, _ in rows:
        name, share = brute.predict(t)
        want[(i, zlib.crc32(str("" if i is None else i).encode()) % 3 == 1, name, tuple(round(s, 2) for s in share))] += 1
    assert Counter((r.doc_id, r.held_out, r.lang_pred, tuple(round(p, 2) for p in r.proportions)) for r in got) == want
    for r in got:
        assert r.lang_pred == (r.languages[0] if r.languages else "und") and r.score == (r.proportions[0] if r.proportions else 0)
        assert 0 <= r.score <= 1 and (not r.proportions or abs(sum(r.proportions) - 1) < 1e-4)


def test_mixtures_and_accuracy(spark, rows):
    got = {r.doc_id: r for r in language.identified(frame(spark, rows)).collect()}
    labelled = [(got[i], lang) for i, _, lang in rows if lang and i is not None and got[i].held_out and got[i].lang_pred != "und"]
    assert len(labelled) > 30 and sum(r.lang_pred == lang for r, lang in labelled) >= 0.97 * len(labelled)
    for i in range(160, 172):
        assert len(got[i].languages) == 2 and abs(got[i].score - 30 / 42) < 0.1


def test_long_texts_are_read_whole(spark, rows, monkeypatch):
    model = language.train(frame(spark, rows))
    rng = random.Random(1)
    text = say(rng, "aa", 3000) + "\n" + say(rng, "cc", 2000)
    whole = language.infer(model, [text, None, "lo mi"])
    monkeypatch.setattr(language, "WINDOW", 500)
    assert "".join(language.windows(text)) == text and max(map(len, language.windows(text))) <= 500
    parts = language.infer(model, ["ka", text, None, "lo mi"])
    assert [model.languages[j] for j in parts[1][0]] == ["aa", "cc"]
    np.testing.assert_allclose(parts[1][1], whole[0][1], atol=1e-4)
    assert parts[2] is None and parts[3][0].tolist() == whole[2][0].tolist()
    assert "".join(language.windows("x" * 1700 + " y")) == "x" * 1700 + " y"


def test_results_do_not_depend_on_other_rows(spark, rows):
    model = language.train(frame(spark, rows))
    texts = [t for _, t, _ in rows]
    together = language.infer(model, texts)
    for t, x in zip(texts, together, strict=True):
        alone = language.infer(model, [t])[0]
        assert (x is None) == (alone is None)
        if x:
            assert x[0].tolist() == alone[0].tolist() and x[1].tolist() == alone[1].tolist()


def test_nothing_to_learn_from(spark):
    for rows in ([], [(0, "abc", None)], [(1, "abc", "aa")] if zlib.crc32(b"1") % 3 == 1 else [(4, "abc", None)], [(0, None, "aa")]):
        got = language.identified(frame(spark, rows)).collect()
        assert [(r.lang_pred, r.score, r.languages) for r in got] == [("und", 0.0, [])] * len(rows)
