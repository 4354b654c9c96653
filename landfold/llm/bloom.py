"""A Bloom filter, to keep rows that surely match nothing out of a shuffle. What passes is still joined exactly."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits for each key, and the most there are: 32 MB, whatever the input. A fuller filter only lets more rows through to the join.
PER_KEY, MOST_BITS, PROBES = 16, 1 << 28, 4


def bloom(hashes: DataFrame) -> bytes:
    """The filter over rows of two 64-bit hashes, put together on the executors: its words are all that reaches the driver."""
    n = hashes.count()
    bits = min(MOST_BITS, max(1 << 16, 1 << (PER_KEY * n).bit_length()))
    low = [F.col(c).bitwiseAND(F.lit(bits - 1)) for c in hashes.columns]
    bit = F.explode(F.array(*((low[0] + i * low[1]).bitwiseAND(F.lit(bits - 1)) for i in range(PROBES))))
    word, mask = F.shiftright("p", 6).alias("w"), F.expr("shiftleft(1L, cast(p & 63 as int))")
    words = hashes.select(bit.alias("p")).groupBy(word).agg(F.bit_or(mask).alias("b")).toArrow()
    out = np.zeros(bits // 64, "<i8")
    out[words.column("w").to_numpy()] = words.column("b").to_numpy()
    return out.tobytes()


def probe(bits: bytes, h: np.ndarray) -> np.ndarray:
    """Which rows of h (n x 2, int64) may be in the filter."""
    last = 8 * len(bits) - 1
    p = np.stack([((h[:, 0] & last) + i * (h[:, 1] & last)) & last for i in range(PROBES)], 1)
    return ((np.frombuffer(bits, np.uint8)[p >> 3] >> (p & 7).astype(np.uint8)) & 1).all(axis=1)
