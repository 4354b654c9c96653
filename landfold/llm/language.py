"""Language identification by mixture inference.

A text is a bag of units, its runs of letters in lower case. Each language gives a unit a likelihood: the product over the
unit's letter trigrams, with a mark at both ends, of the language's share of that trigram (hashed to DIM counters), mixed
with the share in all languages, so that a trigram that no text of a language had speaks against none. A document's
language proportions maximise the mixture's likelihood; expectation-maximisation finds them, which is a concave problem, so
from any start inside. The set of languages is chosen by penalised likelihood among the nested sets of the 1, 2, ...
languages with the largest proportions: a further language must gain more than PENALTY times the logarithm of the number of
units. The languages are refitted within the set, and the one with the largest proportion is the prediction.

Counts are made of all documents to learn from, by task and then by language and counter; the model has languages times DIM
numbers. Documents are scored in one pass, many at once; a text of any length is read whole, in windows of WINDOW
characters, and each keeps only its distinct units.

To learn from: rows with text and lang whose crc32 of doc_id as text isn't 1 modulo 3. No prediction reads lang, source or
doc_id. At most MOST_LANGUAGES languages are learnt, those with the most documents (then by name): a bound of the model.

Defined results: a null text, or one without a letter, is `und` with score 0 and an empty set, as is every text when there is
nothing to learn from; a null doc_id counts as empty text for the remainder; proportions that tie go to the language that is
first by code point; repeated rows are scored one by one and count each time; an empty table gives no rows; other columns,
whatever their names, are not read.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: Counters of trigrams, languages of a model at most, part of the shares that comes from all languages, smoothing of those.
DIM, MOST_LANGUAGES, COMMON, LEAST = 1 << 16, 64, 0.05, 0.5
#: What a further language costs, in nats per logarithm of the number of units.
PENALTY = 6.0
#: Characters read at once; rounds of a fit at most, and the change of proportions at which it ends.
WINDOW, ROUNDS, STILL = 1 << 20, 200, 1e-5
NONE = "und"
#: Odd multipliers that spread bits.
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


@functools.cache
def _letters() -> np.ndarray:
    """Of each code point, whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the trigrams of the texts' units, where each unit's begin, and the number of the text that it is in.
    A unit's last trigram ends with the mark."""
    lower = [t.lower() for t in texts]
    points = np.frombuffer("\n".join(lower).encode("utf-32-le", "surrogatepass"), np.uint32)
    x = np.zeros(len(points) + 3, np.uint64)
    x[2:-1] = points * _letters()[points]
    second, last = x[1:-1], x[2:]
    h = (x[:-2] * (second != 0)) * _ODD[0] ^ second * _ODD[1] ^ last * _ODD[2]
    at = np.flatnonzero(last | second)
    h = h[at]
    h = (h ^ (h >> np.uint64(29))) * _ODD[1]
    h ^= h >> np.uint64(32)
    begins = np.flatnonzero(second[at] == 0)
    ends = np.cumsum([len(t) + 1 for t in lower])
    return h, begins, np.searchsorted(ends, at[begins], side="right")


def windows(text: str) -> Iterator[str]:
    """The text in parts of about WINDOW characters that end after a character that isn't a letter (or anywhere within a longer run)."""
    at = 0
    while len(text) - at > WINDOW:
        end = at + WINDOW
        while end > at + WINDOW // 2 and text[end - 1].isalpha():
            end -= 1
        end = end if end > at + WINDOW // 2 else at + WINDOW
        yield text[at:end]
        at = end
    yield text[at:] if at else text


def counters(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(8)).astype(np.int64) & (DIM - 1)


class Model:
    """Logarithms of each language's share of each counter: a row per counter, a column per language."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = languages
        counts = counts.astype(float)
        everywhere = (counts.sum(1) + LEAST) / (counts.sum() + LEAST * DIM)
        self.log = np.log((1 - COMMON) * counts / np.maximum(counts.sum(0), 1) + COMMON * everywhere[:, None])


def learns(doc_id: Column) -> Column:
    """Whether a document is to be learnt from, by its id."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 != 1


def train(docs: DataFrame) -> Model:
    rows = docs.where(learns(F.col("doc_id"))).where("text is not null and lang is not null").select(F.col("lang").cast("string").alias("lang"), "text")
    known = [r["lang"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES).collect()]
    languages = sorted(known)
    number = {name: i for i, name in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            names, texts = b.column("lang").to_pylist(), b.column("text").to_pylist()
            for name in number.keys() & set(names):
                own = held.setdefault(number[name], np.zeros(DIM, np.int64))
                for _, parts in _portions([t for x, t in zip(names, texts, strict=True) if x == name]):
                    own += np.bincount(counters(trigrams(parts)[0]), minlength=DIM)
        for i, own in held.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), i, np.int32)), pa.array(at.astype(np.int32)), pa.array(own[at])], ["language", "counter", "n"])

    told = rows.mapInArrow(count, "language int, counter int, n long").groupBy("language", "counter").agg(F.sum("n").alias("n")).toArrow()  # languages x DIM at most
    counts = np.zeros((DIM, len(languages)), np.int64)
    counts[told.column("counter").to_numpy(), told.column("language").to_numpy()] = told.column("n").to_numpy()
    return Model(languages, counts)


class Bag:
    """The distinct units of many documents: for each document (place) its units, and how often it has each."""

    def __init__(self, model: Model, texts: list[str | None]):
        """Documents without a letter have no units."""
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # place, unit, count
        names, logs = np.empty(0, np.uint64), np.empty((0, len(model.languages)))
        for places, parts in _portions(texts):
            h, start, part = trigrams(parts)
            if not len(h):
                continue
            place = places[part]
            unit = np.add.reduceat(h, start)  # units with equal trigrams have equal likelihoods
            names, logs, number = _with(model, names, logs, h, start, unit)
            both, n = np.unique(place * len(names) + number, return_counts=True)
            held.append((both // len(names), both % len(names), n))
            if sum(len(x[0]) for x in held) > WINDOW:
                held = [_merged(held, len(names))]
        place, unit, self.n = _merged(held, max(1, len(names))) if held else (np.empty(0, np.int64),) * 3
        # in order of the units' hashes, whatever other documents are at hand
        order = np.lexsort((names[unit], place))
        place, unit, self.n = place[order], unit[order], self.n[order].astype(float)
        self.log = logs[unit]
        self.docs, self.starts = np.unique(place, return_index=True)
        self.ends = np.append(self.starts[1:], len(place))


def _portions(texts: list[str | None]) -> Iterator[tuple[np.ndarray, list[str]]]:
    """(places, parts of texts) of about WINDOW characters at once."""
    places, parts, size = [], [], 0
    for i, text in enumerate(texts):
        for part in windows(text or ""):
            if parts and size + len(part) > WINDOW:
                yield np.array(places, np.int64), parts
                places, parts, size = [], [], 0
            places.append(i)
            parts.append(part)
            size += len(part)
    if parts:
        yield np.array(places, np.int64), parts


def _with(model: Model, names: np.ndarray, logs: np.ndarray, h: np.ndarray, start: np.ndarray, unit: np.ndarray):
    """names (units by hash) and their log likelihoods with those that are new, and each unit's number among them."""
    distinct, at, back = np.unique(unit, return_index=True, return_inverse=True)
    place = np.argsort(names)
    found = np.searchsorted(names, distinct, sorter=place)
    old = np.zeros(len(distinct), bool)
    if len(names):
        found = place[np.minimum(found, len(names) - 1)]
        old = names[found] == distinct
    number = np.where(old, found, len(names) + np.cumsum(~old) - 1)
    end = np.append(start[1:], len(h))
    new = at[~old]
    if len(new):
        size = end[new] - start[new]
        first = np.cumsum(size) - size
        each = np.repeat(start[new] - first, size) + np.arange(int(size.sum()))
        which = counters(h[each])
        told = np.stack([np.add.reduceat(model.log[which, j], first) for j in range(logs.shape[1])], 1) if logs.shape[1] else np.empty((len(new), 0))
        names, logs = np.concatenate([names, distinct[~old]]), np.concatenate([logs, told])
    return names, logs, number[back]


def _merged(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]], units: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    key = np.concatenate([p * units + u for p, u, _ in held])
    key, back = np.unique(key, return_inverse=True)
    return key // units, key % units, np.bincount(back, np.concatenate([n for *_, n in held])).astype(np.int64)


def fit(log: np.ndarray, n: np.ndarray, starts: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions and log likelihood of each document by expectation-maximisation from `start`; languages that start at 0 stay out.

    log: a row for each unit of a document, the documents' rows one after the other from `starts`; n: how often it occurs.
    A document ends on its own account, so nothing depends on the others.
    """
    sizes = np.diff(np.append(starts, len(n)))
    share, level = start.copy(), np.zeros(len(starts))
    at = np.arange(len(starts))  # documents that go on
    top = np.max(np.where(np.repeat(start > 0, sizes, 0), log, -np.inf), 1)
    likely = np.exp(log - top[:, None])
    total = np.add.reduceat(n, starts)
    level = np.add.reduceat(n * top, starts)
    out = np.zeros(len(starts))
    for i in range(ROUNDS + 1):
        by = np.repeat(share[at], sizes[at], 0)
        by *= likely
        sums = by.sum(1)
        first = np.cumsum(sizes[at]) - sizes[at]
        out[at] = level[at] + np.add.reduceat(n * np.log(sums), first)
        if i == ROUNDS:
            break
        by *= (n / sums)[:, None]
        new = np.add.reduceat(by, first, 0) / total[at][:, None]
        still = np.abs(new - share[at]).max(1) < STILL
        if still.all():
            break
        share[at] = np.where(still[:, None], share[at], new)
        if still.any():
            rows = np.repeat(~still, sizes[at])
            likely, n, at = likely[rows], n[rows], at[~still]
    return share, out


def infer(model: Model, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray] | None]:
    """Of each text: numbers of the languages in its set, largest proportion first, and the proportions; None without a letter."""
    out: list[tuple[np.ndarray, np.ndarray] | None] = [None] * len(texts)
    if not model.languages:
        return out
    bag = Bag(model, texts)
    if not len(bag.docs):
        return out
    some = len(model.languages)
    full, best = fit(bag.log, bag.n, bag.starts, np.full((len(bag.docs), some), 1 / some))
    alone = np.add.reduceat(bag.log * bag.n[:, None], bag.starts, 0)
    cost = PENALTY * np.log(1 + np.add.reduceat(bag.n, bag.starts))
    order = np.argsort(-full, 1, kind="stable")
    rank = np.argsort(order, 1, kind="stable")
    share = np.zeros_like(full)
    share[np.arange(len(full)), alone.argmax(1)] = 1
    level = alone.max(1)  # penalised, of the best set so far
    for k in range(2, some + 1):
        # no set of k languages or more can gain over `best`, which all have together
        left = np.flatnonzero(best - (k - 1) * cost > level)
        if not len(left):
            break
        rows = np.concatenate([np.arange(bag.starts[i], bag.ends[i]) for i in left])
        sizes = bag.ends[left] - bag.starts[left]
        got, told = fit(bag.log[rows], bag.n[rows], np.cumsum(sizes) - sizes, np.where(rank[left] < k, 1 / k, 0.0))
        better = told - (k - 1) * cost[left] > level[left]
        share[left[better]] = got[better]
        level[left[better]] = (told - (k - 1) * cost[left])[better]
    for i, place in enumerate(bag.docs.tolist()):
        held = np.argsort(-share[i], kind="stable")
        held = held[share[i][held] > 0]
        out[place] = held, share[i][held]
    return out


OUT = "lang_pred string, score double, languages array<string>, proportions array<double>"


def languages(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score (the predicted language's proportion), languages, proportions for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # MOST_LANGUAGES x DIM numbers at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            got = infer(m, b.column("text").to_pylist())
            sets = [([m.languages[i] for i in x[0].tolist()], [round(p, 6) for p in x[1].tolist()]) if x else ([], []) for x in got]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array([s[0] if s else NONE for s, _ in sets], pa.string()), pa.array([p[0] if p else 0.0 for _, p in sets], pa.float64()), pa.array([s for s, _ in sets], pa.list_(pa.string())), pa.array([p for _, p in sets], pa.list_(pa.float64()))], ["doc_id", "held_out", "lang_pred", "score", "languages", "proportions"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), (~learns(F.col("doc_id"))).alias("held_out"), "text").mapInArrow(run, f"doc_id long, held_out boolean, {OUT}")


def identified(docs: DataFrame) -> DataFrame:
    """The languages of all documents, learnt from those that are not held out."""
    small_batches(docs.sparkSession)
    return languages(docs, train(docs))
