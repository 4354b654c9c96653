"""Words of texts that are written without spaces: the most probable segmentation under a dictionary of words with counts.

Texts are split into runs of letters and digits. Each distinct run is segmented once: all dictionary words within it span
a graph between its characters, and the path with the highest product of word probabilities is taken (of equal ones the
one whose first differing word is longer). A character that no word covers counts as seen once; two or more such characters
in a row are an unknown part, which a hidden Markov model of word positions (begin, middle, end, single) splits, with
probabilities learnt from the dictionary's own words.

The dictionary is a parameter: a frame (word string, n long), or one that `learned` takes from the texts' own words. It is
broadcast, so it has MOST_WORDS entries at most; a longer one is refused. Runs are counted before they are segmented, and
words after, so no text and no frequent run is segmented twice.

Defined results: null and empty texts have no words; letters are lower-cased; a dictionary's null or empty words, and counts
that aren't above 0, are left out, and counts of a repeated word add up; without a dictionary each run is an unknown part.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_WORDS = 1_000_000
#: Log probability of what the model of positions has never seen.
NEVER = -30.0
#: Positions in a word, and which may follow which.
AFTER = {"B": "ME", "M": "ME", "E": "BS", "S": "BS"}


def runs(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"))


class Segmenter:
    def __init__(self, words: dict[str, int]):
        self.total = sum(words.values())
        self.log = {w: math.log(n) for w, n in words.items()}
        self.longest = max(map(len, words), default=1)
        self.one = math.log(max(1, self.total))
        begins, follows, says = Counter(), Counter(), {p: Counter() for p in AFTER}
        for w, n in words.items():
            places = "S" if len(w) == 1 else "B" + "M" * (len(w) - 2) + "E"
            begins[places[0]] += n
            for c, p in zip(w, places, strict=True):
                says[p][c] += n
            for a, b in zip(places, places[1:]):  # noqa: B905
                follows[a + b] += n
        # what follows the end of a word is the start of another
        for a in "ES":
            for b in "BS":
                follows[a + b] = begins[b]
        share = lambda n, of: math.log(n / of) if n else NEVER
        self.begins = {p: share(begins[p], begins.total()) for p in "BS"}
        self.follows = {a + b: share(follows[a + b], sum(follows[a + x] for x in AFTER[a])) for a in AFTER for b in AFTER[a]}
        self.says = {p: {c: share(n, says[p].total()) for c, n in each.items()} for p, each in says.items()}

    def known(self, run: str) -> list[str]:
        """The most probable path, in which a character that no word covers stands alone."""
        n = len(run)
        best: list[tuple[float, int]] = [(0.0, 0)] * (n + 1)
        for i in range(n - 1, -1, -1):
            here = (-math.inf, 0)
            for size in range(1, min(self.longest, n - i) + 1):
                log = self.log.get(run[i : i + size], 0.0 if size == 1 else None)
                if log is not None:
                    here = max(here, (round(log - self.one + best[i + size][0], 9), size))
            best[i] = here
        out, i = [], 0
        while i < n:
            out.append(run[i : i + best[i][1]])
            i += best[i][1]
        return out

    def unknown(self, part: str) -> list[str]:
        """The most probable positions of an unknown part's characters, cut after each end."""
        say = lambda p, c: self.says[p].get(c, NEVER)
        paths = {p: (self.begins[p] + say(p, part[0]), p) for p in "BS"}
        for c in part[1:]:
            paths = {b: max((v + self.follows[a + b], path + b) for a, (v, path) in paths.items() if b in AFTER[a]) for b in {x for a in paths for x in AFTER[a]}}
            paths = {b: (v + say(b, c), path) for b, (v, path) in paths.items()}
        places = max((v, path) for p, (v, path) in paths.items() if p in "ES" or len(part) == 1 and p == "S")[1]
        out, begin = [], 0
        for i, p in enumerate(places):
            if p in "ES":
                out.append(part[begin : i + 1])
                begin = i + 1
        return out

    def cut(self, run: str) -> list[str]:
        out: list[str] = []
        loose = ""
        for w in self.known(run):
            if w in self.log:
                out += self._loose(loose)
                loose = ""
                out.append(w)
            else:
                loose += w
        return out + self._loose(loose)

    def _loose(self, part: str) -> list[str]:
        return [part] * bool(part) if len(part) < 2 else self.unknown(part)


def learned(df: DataFrame, text: str, most: int = 200_000, least: int = 2) -> DataFrame:
    """word, n: the runs that occur at least `least` times, the most frequent ones by a threshold on n; never more than `most`."""
    counted = run_counts(df, text).where(F.col("n") >= least)
    sizes = [(r["n"], r["count"]) for r in counted.groupBy("n").count().orderBy(F.desc("n")).limit(most).collect()]  # distinct counts are few
    room, threshold = most, None
    for n, count in sizes:
        if count > room:
            break
        room, threshold = room - count, n
    return counted.where(F.lit(False) if threshold is None else F.col("n") >= threshold).withColumnRenamed("run", "word")


def run_counts(df: DataFrame, text: str) -> DataFrame:
    return df.select(F.explode(runs(F.col(text))).alias("run")).groupBy("run").agg(F.count("*").alias("n"))


def _segmenter(words: DataFrame, custom: dict[str, int] | None) -> Segmenter:
    rows = words.where("word <> '' and n > 0").select(F.lower("word").alias("word"), "n").groupBy("word").agg(F.sum("n").alias("n")).limit(MOST_WORDS + 1).collect()
    if len(rows) > MOST_WORDS:
        raise ValueError(f"a dictionary has {MOST_WORDS} words at most")
    return Segmenter({r["word"]: r["n"] for r in rows} | {w.lower(): n for w, n in (custom or {}).items()})


def word_freq(df: DataFrame, text: str, words: DataFrame, stop: DataFrame | None = None, custom: dict[str, int] | None = None) -> DataFrame:
    """word, n of all texts, segmented. custom: own words with counts, which replace the dictionary's; stop (word) is left out."""
    shared = df.sparkSession.sparkContext.broadcast(_segmenter(words, custom))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = shared.value
        for b in batches:
            found: Counter = Counter()
            for part, n in zip(b.column("run").to_pylist(), b.column("n").to_pylist(), strict=True):
                for w in s.cut(part):
                    found[w] += n
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array(found.values(), pa.int64())], ["word", "n"])

    counted = run_counts(df, text).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted if stop is None else counted.join(stop.select("word"), "word", "left_anti")


def segmented(df: DataFrame, text: str, words: DataFrame, custom: dict[str, int] | None = None) -> DataFrame:
    """df with a column `segments`: the words of each text, in order."""
    shared = df.sparkSession.sparkContext.broadcast(_segmenter(words, custom))

    @F.arrow_udf("array<string>")
    def run(each: pa.Array) -> pa.Array:
        seen: dict[str, list[str]] = {}
        out = []
        for parts in each.to_pylist():
            for r in set(parts or ()) - seen.keys():
                seen[r] = shared.value.cut(r)
            out.append([w for r in parts or () for w in seen[r]])
        return pa.array(out, pa.list_(pa.string()))

    return df.withColumn("segments", run(F.coalesce(runs(F.col(text)), F.array().cast("array<string>"))))
