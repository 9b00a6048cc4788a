"""A bit map of hashes, of bounded size, that spares a shuffle most rows without a partner.

It only ever lets too many rows through; what passes is joined exactly.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: From 2**16 to 2**27 bits (16 MB), whatever the data.
LEAST_BITS, MOST_BITS = 16, 27
_OTHERS = (np.uint64(0x8CB92BA72F3D8DD7), np.uint64(0xC2B2AE3D27D4EB4F))


@dataclass
class HashFilter:
    bits: int
    table: Broadcast

    @classmethod
    def of(cls, hashes: DataFrame, count: int, col: str = "h", share: int = 16) -> HashFilter:
        """The filter of a column of well-mixed longs, of which there are about ``count``, with ``share`` bits for each."""
        bits = min(MOST_BITS, max(LEAST_BITS, (share * max(count, 1) - 1).bit_length()))

        @F.pandas_udf("array<long>")
        def places(h: pd.Series) -> pd.Series:
            return pd.Series(list(np.stack(_probes(h.to_numpy(dtype=np.int64).view(np.uint64), bits), 1).astype(np.int64)), dtype=object)

        spots = hashes.select(F.explode(places(F.col(col))).alias("p"))
        words = spots.groupBy(F.expr("shiftright(p, 6)").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(p & 63 as int)))").alias("m"))
        filled = words.toPandas()  # 2**(bits - 6) rows at most
        table = np.zeros(1 << (bits - 6), np.int64)
        table[filled["w"].to_numpy(dtype=np.int64)] = filled["m"].to_numpy(dtype=np.int64)
        return cls(bits, hashes.sparkSession.sparkContext.broadcast(table.view(np.uint8)))

    def maybe(self, h: np.ndarray) -> np.ndarray:
        """Which of these unsigned hashes may be in the set."""
        bitmap, hit = self.table.value, np.ones(len(h), bool)
        for p in _probes(h, self.bits):
            hit &= ((bitmap[(p >> np.uint64(3)).astype(np.int64)] >> (p & np.uint64(7)).astype(np.uint8)) & 1) > 0
        return hit

    def column(self, col: str | Column) -> Column:
        """The same of a column of longs."""
        bits, table = self.bits, self.table

        @F.pandas_udf("boolean")
        def passes(h: pd.Series) -> pd.Series:
            return pd.Series(HashFilter(bits, table).maybe(h.to_numpy(dtype=np.int64).view(np.uint64)))

        return passes(F.col(col) if isinstance(col, str) else col)


def _probes(h: np.ndarray, bits: int) -> list[np.ndarray]:
    shift = np.uint64(64 - bits)
    return [h >> shift, *((h * m) >> shift for m in _OTHERS)]
