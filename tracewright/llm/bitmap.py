"""A semi-join's filter told to all tasks: a bitmap of the keys, so that most rows without a partner are never shuffled."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewright.llm.shingles import mix

#: Bits of a bitmap: 2**BITS at most; bytes of it that travel together.
BITS = 28
_CHUNK = 1 << 13


def slots(keys: np.ndarray, bits: int) -> np.ndarray:
    """The slot of each key in a table of 2**bits."""
    return (mix(keys.view(np.uint64)) & np.uint64((1 << bits) - 1)).astype(np.int64)


def only(rows: DataFrame, keys: DataFrame, column: str = "x") -> DataFrame:
    """``rows`` without most of those whose ``column``, a long, is not in ``keys``. Read ``keys`` from a table."""
    bits = min(max((16 * keys.count()).bit_length(), 16), BITS)

    def mark(batches):  # noqa: ANN001, ANN202
        table = np.zeros(1 << bits >> 3, np.uint8)
        for some in batches:
            at = slots(some[column].to_numpy(np.int64), bits)
            np.bitwise_or.at(table, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))
        for i in range(0, len(table), _CHUNK):
            if (part := table[i : i + _CHUNK]).any():
                yield pd.DataFrame({"chunk": [i], "marks": [zlib.compress(part.tobytes(), 1)]})

    def merge(some: pd.DataFrame) -> pd.DataFrame:
        both = np.zeros(_CHUNK, np.uint8)
        for part in some["marks"]:
            both |= np.frombuffer(zlib.decompress(part), np.uint8)
        return pd.DataFrame({"chunk": some["chunk"].iloc[:1], "marks": [zlib.compress(both.tobytes(), 1)]})

    marks = np.zeros(1 << bits >> 3, np.uint8)
    for row in keys.select(column).mapInPandas(mark, "chunk int, marks binary").groupBy("chunk").applyInPandas(merge, "chunk int, marks binary").collect():  # 2**bits bits at most
        marks[row["chunk"] : row["chunk"] + _CHUNK] = np.frombuffer(zlib.decompress(row["marks"]), np.uint8)
    table = rows.sparkSession.sparkContext.broadcast(marks)

    @F.pandas_udf(T.BooleanType())
    def marked(key: pd.Series) -> pd.Series:
        at = slots(key.to_numpy(np.int64), bits)
        return pd.Series((table.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1)

    return rows.where(marked(column))
