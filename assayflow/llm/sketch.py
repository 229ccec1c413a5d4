"""Bitmaps of hashed keys, broadcast as a sieve before a join: what they let through is checked by the join."""

from __future__ import annotations

import numpy as np
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits for each key counted, and the fewest and most bits of a sketch (8 kB to 64 MB to broadcast). Beyond 2 ** 25 keys
#: a sketch gets fuller and lets more through, in the end everything, which the join then drops.
BITS_PER_KEY, LEAST_BITS, MOST_BITS = 16, 1 << 16, 1 << 29

_U = np.uint64


def sketch(spark: SparkSession, keys: DataFrame, key: str) -> Broadcast:
    """A bitmap sized by the number of keys (hashes as longs), set at each key's low bits: a sieve that never misses."""
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << int(BITS_PER_KEY * keys.count()).bit_length()))
    bit = F.col(key).bitwiseAND(F.lit(bits - 1))
    words = keys.select(F.shiftright(bit, 6).cast("int").alias("word"), bit.bitwiseAND(F.lit(63)).cast("int").alias("bit"))
    rows = words.groupBy("word").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit"))).alias("bits")).toArrow()
    out = np.zeros(bits >> 6, np.int64)
    out[rows.column("word").to_numpy()] = rows.column("bits").to_numpy()
    return spark.sparkContext.broadcast(out.view(_U))


def in_sketch(words: np.ndarray, values: np.ndarray) -> np.ndarray:
    bit = values.astype(np.int64, copy=False).view(_U) & _U(64 * len(words) - 1)
    return (words[(bit >> _U(6)).astype(np.int64)] >> (bit & _U(63))) & _U(1) == 1
