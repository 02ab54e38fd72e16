"""Counts of hashes in a fixed number of cells, summed over all rows of a table."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from lipika.llm.common import CLEAN_SHUFFLES, settings

CHUNKS = 64


def cell_counts(df: DataFrame, hashes: Callable[[pa.Array], Iterator[np.ndarray]], cells: int) -> np.ndarray:
    """How many of the hashes of the first column fall in each cell.

    Every task sends one array of ``cells`` numbers, in CHUNKS pieces that are added apart; the driver gets one array.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(cells, np.int64)
        for b in batches:
            for h in hashes(b.column(0)):
                total += np.bincount((h & np.uint64(cells - 1)).astype(np.int64), minlength=cells)
        parts = np.minimum(total, 2**31 - 1).astype("<i4").reshape(CHUNKS, -1)
        yield pa.RecordBatch.from_arrays([pa.array(range(CHUNKS), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], ["chunk", "n"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(v, "<i4").astype(np.int64) for v in pdf["n"])
        return pd.DataFrame({"chunk": pdf["chunk"].iloc[:1], "n": [total.astype("<i8").tobytes()]})

    sums = df.mapInArrow(count, "chunk int, n binary").groupBy("chunk").applyInPandas(add, "chunk int, n binary")
    with settings(df.sparkSession, CLEAN_SHUFFLES):
        rows = sorted((r["chunk"], r["n"]) for r in sums.select("*").collect())  # CHUNKS rows of cells / CHUNKS numbers
    return np.concatenate([np.frombuffer(v, "<i8") for _, v in rows]) if rows else np.zeros(cells, np.int64)
