"""A filter of bounded size before a shuffle: which of a column of hashes may be among some others."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Bitmap:
    """Holds for every hash of `column` in `keys`, and for few others: about one in 16 while there are
    fewer than a 16th of 2 ** most_bits keys. Beyond that it holds more often, and for all in the end: it
    never takes more than 2 ** most_bits bits (8 MB) on the driver and the executors, and what it
    lets through is only ever a reason to look closer."""

    def __init__(self, keys: DataFrame, column: str, most_bits: int = 26):
        self.bits = 1 << min(most_bits, max(16, (16 * keys.count()).bit_length()))
        place = keys.select(F.pmod(F.col(column), F.lit(self.bits).cast("long")).alias("b"))
        held = place.groupBy(F.shiftright("b", 6).alias("at")).agg(F.expr("bit_or(shiftleft(1L, cast(b % 64 AS int)))").alias("word")).toArrow()
        words = np.zeros(self.bits // 64, np.int64)
        words[held["at"].to_numpy()] = held["word"].to_numpy()
        self.words = keys.sparkSession.sparkContext.broadcast(words)

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes & (self.bits - 1)
        return (self.words.value[at >> 6] >> (at & 63) & 1).astype(bool)

    def filter(self, df: DataFrame, column: str, inside: bool = True) -> DataFrame:
        """The rows of df for which it holds, or for which it doesn't. (As whole rows, in one Python
        function: an expression beside another one would take a second worker for each task.)"""
        at = df.columns.index(column)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array(self.holds(batch.column(at).to_numpy()) == inside))

        return df.mapInArrow(run, df.schema)
