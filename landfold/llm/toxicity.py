"""Toxicity grades by cumulative-link ordinal regression on sparse text features.

P(grade >= k) = sigmoid(w.x - theta_k) with one weight vector w for all ordered thresholds theta_1 < theta_2 < ...
x marks which hashed features a text has: its lower-cased words and their prefixes. The model is fitted on a bounded,
documented sample of labelled rows; scoring covers every whole text.

Defined results: a null or empty text has no features and takes the base severity; null or repeated doc_ids score row by
row; labels that are null are ignored, repeated labels of a document count once (the highest); with no labels, or only
one class, nothing is toxic and severity is 0. Columns besides doc_id and text are not read.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back

#: Hashed feature space, and the prefix lengths that count as features besides the word.
DIM, PREFIXES = 1 << 20, (3, 4, 5, 6, 7)
#: Labelled rows that the model is fitted on, at most: toxic and other ones.
SAMPLE_TOXIC, SAMPLE_CLEAN = 2_000, 4_000
MAX_FEATURES, LEAST_DOCS, LEAST_Z = 1_024, 5, 4.0
#: Words that a worker remembers as carrying no selected feature.
DULL = 150_000
EDGE = "".join(map(chr, range(33, 48))) + ":;<=>?@[\\]^_`{|}~«»„“”’"


def token_features(token: str) -> set[int]:
    word = token.strip(EDGE)
    if not word:
        return set()
    names = [f"w:{word}", *(f"p:{word[:n]}" for n in PREFIXES if len(word) > n)]
    return {zlib.crc32(n.encode("utf-8", "surrogatepass")) & (DIM - 1) for n in names}


def text_features(text: str | None) -> set[int]:
    return set().union(*(token_features(t) for t in set((text or "").lower().split())))


@dataclass
class OrdinalModel:
    """weights: feature to weight; thresholds ascending, one fewer than there are grades."""

    weights: dict[int, float] = field(default_factory=dict)
    thresholds: list[float] = field(default_factory=lambda: [40.0, 80.0])

    def at_least(self, score: float) -> list[float]:
        return [float(1 / (1 + np.exp(np.clip(t - score, -500, 500)))) for t in self.thresholds]


def fit_ordinal(rows: list[np.ndarray], grades: np.ndarray, weights: np.ndarray, features: np.ndarray, rounds: int = 400, l2: float = 2e-4) -> OrdinalModel:
    """Weighted maximum likelihood by Adam; rows hold each text's feature numbers, grades run from 0."""
    k = int(grades.max())
    at = {int(f): i for i, f in enumerate(features)}
    x = np.zeros((len(rows), len(features)), np.float32)
    for i, row in enumerate(rows):
        x[i, [at[f] for f in row.tolist() if f in at]] = 1
    share = weights / weights.sum()
    # theta_1 and the logs of the gaps above it are free, so that thresholds stay in order
    free = np.concatenate([np.zeros(len(features)), [2.0], np.zeros(k - 1)])
    m, v = np.zeros_like(free), np.zeros_like(free)

    def unpack(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return p[: len(features)], p[len(features)] + np.concatenate([[0.0], np.cumsum(np.exp(p[len(features) + 1 :]))])

    row = np.arange(len(rows))
    for t in range(1, rounds + 1):
        w, theta = unpack(free)
        s = x @ w.astype(np.float32)
        up = 1 / (1 + np.exp(np.clip(theta[None, :] - s[:, None], -60, 60)))  # P(grade >= k)
        tail = np.hstack([np.ones((len(rows), 1)), up, np.zeros((len(rows), 1))])
        p = np.maximum(tail[row, grades] - tail[row, grades + 1], 1e-9)
        slope = np.hstack([np.zeros((len(rows), 1)), up * (1 - up), np.zeros((len(rows), 1))])
        lo, hi = slope[row, grades], slope[row, grades + 1]
        ds = -share * (lo - hi) / p
        dtheta = np.zeros(k + 2)
        np.add.at(dtheta, grades, share * lo / p)
        np.add.at(dtheta, grades + 1, -share * hi / p)
        dtheta = dtheta[1 : k + 1]
        gap = np.exp(free[len(features) + 1 :])
        g = np.concatenate([x.T @ ds.astype(np.float32) + l2 * w / len(features) ** 0.5, [dtheta.sum()], [gap[j] * dtheta[j + 1 :].sum() for j in range(k - 1)]])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        free = free - 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    w, theta = unpack(free)
    return OrdinalModel({int(f): float(c) for f, c in zip(features, w, strict=True)}, [float(c) for c in theta])


def select_features(rows: list[np.ndarray], toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The features whose document rates differ most between the classes, and their z values."""
    flat = np.concatenate([*rows, np.empty(0, np.int32)])
    owner = np.repeat(toxic, [len(r) for r in rows]) if rows else np.empty(0, bool)
    n, pos = np.bincount(flat, minlength=DIM), np.bincount(flat[owner.astype(bool)], minlength=DIM)
    a, b = max(1, int(toxic.sum())), max(1, int((~toxic).sum()))
    rate = (n + 1) / (a + b + 2)
    z = (pos / a - (n - pos) / b) / np.sqrt(rate * (1 - rate).clip(1e-9) * (1 / a + 1 / b))
    good = np.flatnonzero((n >= LEAST_DOCS) & (np.abs(z) >= LEAST_Z))
    good = good[np.argsort(-np.abs(z[good]), kind="stable")][:MAX_FEATURES]
    return good, z[good]


def train(docs: DataFrame, labels: DataFrame) -> OrdinalModel:
    """Fit on at most SAMPLE_TOXIC + SAMPLE_CLEAN labelled documents, taken in hash order of doc_id.

    The labels are 0 or 1. Grade 0 is not toxic; toxic documents are graded 1 or 2 by how many distinct toxic features
    they have, below or from their median. What counts as a toxic feature is learnt from the half of the sample that the
    document is not in, so that no grade follows from the document's own label.
    """
    known = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    picked = [known.where(cond).orderBy(*order).limit(n) for cond, n in (("toxic > 0", SAMPLE_TOXIC), ("toxic <= 0", SAMPLE_CLEAN))]
    totals = {int(r["t"]): int(r["n"]) for r in known.groupBy((F.col("toxic") > 0).cast("int").alias("t")).agg(F.count("*").alias("n")).collect()}
    if len(totals) < 2:
        return OrdinalModel()

    def extract(batches):
        for b in batches:
            found = [np.fromiter(sorted(text_features(t)), np.int32) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("toxic").cast(pa.int32()), pa.array(found, pa.list_(pa.int32()))], ["toxic", "features"])

    sample = picked[0].unionByName(picked[1])  # its size is bounded by the two limits
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id")
    # a doc_id that repeats counts once, by the text that is first in order; each text passes its distinct features only
    got = found.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("text").alias("text")).mapInArrow(extract, "toxic int, features array<int>").toArrow()
    toxic = got.column("toxic").to_numpy() > 0
    rows = [r for c in got.column("features").chunks for r in np.split(c.flatten().to_numpy(), np.cumsum(c.value_lengths().to_numpy())[:-1])] if len(got) else []
    if toxic.all() or not toxic.any():
        return OrdinalModel()
    features, _ = select_features(rows, toxic)
    half, found = np.arange(len(rows)) % 2, np.zeros(len(rows), np.int64)
    for side in (0, 1):
        other = np.flatnonzero(half != side)
        names, z = select_features([rows[i] for i in other], toxic[other])
        bad = np.sort(names[z > 0])
        found[half == side] = [np.isin(rows[i], bad).sum() for i in np.flatnonzero(half == side)]
    grades = np.where(toxic, 1 + (found >= max(1.0, float(np.median(found[toxic])))), 0).astype(np.int64)
    grades[toxic & (found == 0)] = 1
    if grades.max() < 2:
        grades[np.flatnonzero(toxic)[0]] = 2
    weights = np.where(toxic, totals[1] / toxic.sum(), totals[0] / (~toxic).sum())
    return fit_ordinal(rows, grades, weights, features)


def grade(model: OrdinalModel):
    """A pandas UDF from text to struct(expected_severity, p_toxic, grade)."""
    weights, thresholds = model.weights, model.thresholds
    dull: set[str] = set()

    def score(text: str | None) -> tuple[float, float, int]:
        active: set[int] = set()
        for token in set((text or "").lower().split()) - dull:
            if hit := token_features(token) & weights.keys():
                active |= hit
            elif len(dull) < DULL:
                dull.add(token)
        at_least = OrdinalModel(weights, thresholds).at_least(sum(weights[f] for f in sorted(active)))
        return sum(at_least), at_least[0], sum(p >= 0.5 for p in at_least)

    @F.pandas_udf("expected_severity double, p_toxic double, grade int")
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([score(t) for t in texts], columns=["expected_severity", "p_toxic", "grade"]).astype({"expected_severity": float, "p_toxic": float, "grade": "int32"})

    return run


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, expected_severity, p_toxic, grade, toxic (grade 1 or above) for every row of docs."""
    scored = docs.select("doc_id", grade(train(docs, labels))("text").alias("s"))
    return scored.select("doc_id", "s.expected_severity", "s.p_toxic", "s.grade", (F.col("s.grade") >= 1).alias("toxic"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rows graded 1 or above; columns as they were."""
    model = train(docs, labels)
    give_back()  # the sample is needed no more
    return docs.where(grade(model)("text")["grade"] < 1)
