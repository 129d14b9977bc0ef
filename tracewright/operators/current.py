"""The current row of each key: the one with the latest time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.functions.text import fix_key, instant_us

#: Rows without a readable time are older than all others.
NO_TIME = -(2**63)


def recency(updated_at: Column, seq: Column) -> Column:
    """Orders the versions of a record: by instant, then by storage position."""
    return F.struct(F.coalesce(instant_us(updated_at), F.lit(NO_TIME)).alias("at"), seq.alias("seq"))


def current_rows(df: DataFrame, columns: list[str], key: Column | None = None) -> DataFrame:
    """One row per key with ``columns`` as in its current row, and ``fix_key``.

    ``max_by`` is combined on the map side, so a key that holds a third of all rows sends one row
    per input partition. Rows whose id is null or blank have the key null or '' and count as one record.
    """
    key = fix_key(df["id"]) if key is None else key
    best = F.max_by(F.struct(*[df[c] for c in columns]), recency(df["updated_at"], df["seq"]))
    return df.groupBy(key.alias("fix_key")).agg(best.alias("row")).select("fix_key", "row.*")
