"""A Bloom filter of long keys, built by Spark and sent to every task.

Its size is bounded whatever the number of keys is, so it may be broadcast at any scale. It says
"perhaps" for every key that was put in and for a small share of others; beyond the bound that
share grows. It is for sparing a shuffle to rows that cannot meet a join, never for deciding.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_LEAST, _MOST, _PER_KEY = 16, 27, 16  # as powers of two the first two: 8 KB to 16 MB
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93], np.uint64)


def _places(keys: np.ndarray, power: int) -> np.ndarray:
    """Three bit numbers below ``2 ** power`` for each key."""
    mixed = (keys ^ (keys >> np.uint64(32))) * _FACTORS[:, None]
    return ((mixed ^ (mixed >> np.uint64(29))) * _FACTORS[::-1, None]) >> np.uint64(64 - power)


class Sieve:
    """The words of the filter; ``passes`` tells which keys may have been put in."""

    def __init__(self, power: int, words: np.ndarray) -> None:
        self.power, self.words = power, words

    def passes(self, keys: np.ndarray) -> np.ndarray:
        at = _places(keys.astype(np.int64).view(np.uint64), self.power)
        bit = self.words[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)
        return bit.all(axis=0)


def sieve(keys: DataFrame, count: int) -> Sieve:
    """The filter of the one long column of ``keys``, which has about ``count`` rows without nulls."""
    power = min(_MOST, max(_LEAST, (count * _PER_KEY).bit_length()))

    def fill(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = np.zeros(1 << (power - 6), np.uint64)
        for part in parts:
            at = _places(part.column(0).to_numpy().astype(np.int64).view(np.uint64), power).ravel()
            np.bitwise_or.at(words, at >> np.uint64(6), np.uint64(1) << (at & np.uint64(63)))
        cells = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(words[cells].view(np.int64))], ["cell", "bits"])

    filled = keys.mapInArrow(fill, "cell long, bits long").groupBy("cell").agg(F.bit_or("bits").alias("bits"))
    table = filled.toArrow()  # at most 2 ** (_MOST - 6) rows
    words = np.zeros(1 << (power - 6), np.uint64)
    words[table["cell"].to_numpy()] = table["bits"].to_numpy().view(np.uint64)
    return Sieve(power, words)


def without(rows: DataFrame, gone: DataFrame, key: str, most: int = 2_000_000) -> DataFrame:
    """The rows whose ``key`` is not in ``gone``, which has that one column; null keys stay. No row is shuffled for it.

    Up to ``most`` keys are broadcast. Beyond that a filter of bounded size goes round, and only rows
    that it cannot clear meet an exact join.
    """
    count = gone.count()
    if count <= most:
        return rows.join(F.broadcast(gone), key, "left_anti").select(*rows.columns)
    shared = rows.sparkSession.sparkContext.broadcast(sieve(gone.select(F.col(key).cast("long")).where(F.col(key).isNotNull()), count))

    @F.arrow_udf("boolean")
    def perhaps(keys: pa.Array) -> pa.Array:
        return pa.array(shared.value.passes(keys.fill_null(0).to_numpy(zero_copy_only=False)), mask=keys.is_null().to_numpy(zero_copy_only=False))

    met = F.coalesce(perhaps(F.col(key).cast("long")), F.lit(False))
    doubtful = rows.where(met).join(gone, key, "left_anti").select(*rows.columns)
    return rows.where(~met).unionByName(doubtful)
