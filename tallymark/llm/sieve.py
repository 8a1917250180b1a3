"""A bounded filter in front of a join: most rows that the join would drop are not shuffled."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS_A_KEY = 16
_PAGE = 1 << 15  # bits in a bitmap of Spark's bitmap functions
MOST_BITS = 1 << 26  # 8 MB


def sieve(keys: DataFrame, *columns: str) -> Callable[..., Column]:
    """A test of as many columns, true for each row whose values stand in ``columns`` of ``keys``, and for few others.

    Spark builds a bitmap of the keys' hashes, which goes to the tasks. It has 8 MB at most; with more than four
    million keys more rows pass that need not. Only a join tells which rows are meant, so one follows on all that pass.
    """
    bits = max(_PAGE, min(MOST_BITS, 1 << (BITS_A_KEY * keys.count()).bit_length()))
    place = F.xxhash64(*columns).bitwiseAND(F.lit(bits - 1)) + 1
    pages = keys.select(F.bitmap_bucket_number(place).alias("page"), F.bitmap_bit_position(place).alias("bit")) \
        .repartition("page").groupBy("page").agg(F.bitmap_construct_agg("bit").alias("bits")).collect()
    filled = np.zeros(bits // 8, np.uint8)
    for page, held in pages:
        filled[(page - 1) * _PAGE // 8:page * _PAGE // 8] = np.frombuffer(held, np.uint8)

    def passes(hashes: pa.Array) -> pa.Array:
        at = hashes.to_numpy(zero_copy_only=False) & (bits - 1)
        return pa.array((filled[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1)

    passes.__annotations__ = {"hashes": pa.Array, "return": pa.Array}
    test = F.arrow_udf(passes, "boolean")
    return lambda *of: test(F.xxhash64(*of))
