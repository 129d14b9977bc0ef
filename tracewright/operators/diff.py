"""Differences between two copies of a dataset, by a column-by-bucket checksum matrix.

Pass 1 reads both copies, hashes every normalised field of every current record to 128 bits, and
adds the hashes up by key bucket and column, local minus remote. A cell of this matrix is zero where
the copies agree. Pass 2 reads only the columns, and joins only the rows of the buckets, whose cells
are not zero, and compares the values themselves.

Both passes combine on the map side (``max_by`` and ``sum``): a key or bucket that holds a third of
all rows sends one row per input partition.

Cases with a defined result: null and blank fields are equal; a record stored again counts once, by
its latest version; two empty copies have no differences; columns that only one copy has are ignored
unless named in ``fields``; a null id is the record ''.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.functions.text import canonical_text, canonical_time, fix_key
from tracewright.operators.current import recency
from tracewright.operators.tags import tag_set_key
from tracewright.sources.scratch import settle

#: Rows that share a bucket of the matrix, on average.
ROWS_PER_BUCKET = 8


@dataclass(frozen=True)
class Compared:
    """A compared field and its canonical form (null where it is blank)."""

    name: str
    canonical: Callable[[Column], Column]


FIX_FIELDS = [
    *(Compared(n, canonical_text) for n in ("issue", "resolution", "error_excerpt", "notes", "author", "author_email")),
    Compared("tags", tag_set_key),
    Compared("created_at", canonical_time),
    Compared("updated_at", canonical_time),
    Compared("is_private", lambda c: F.when(c, F.lit("true"))),
]


def _sides(local: DataFrame, remote: DataFrame, fields: list[Compared], buckets: int) -> DataFrame:
    """The rows of both copies: side, bucket, key, recency and the canonical fields f0, f1, ..."""

    def side(df: DataFrame, name: str) -> DataFrame:
        key = F.coalesce(fix_key(df["id"]), F.lit(""))
        return df.select(
            F.lit(name == "local").alias("is_local"),
            F.pmod(F.xxhash64(key), F.lit(buckets)).alias("bucket"),
            key.alias("fix_key"),
            recency(df["updated_at"], df["seq"]).alias("at"),
            *[c.canonical(df[c.name]).alias(f"f{i}") for i, c in enumerate(fields)],
        )

    return side(local, "local").unionByName(side(remote, "remote"))


def _hashes(n_fields: int, salt: int) -> Column:
    """One 64-bit hash for each field of a record, and one for its key alone."""
    values = [F.coalesce(F.col(f"f{i}"), F.lit("\x00")) for i in range(n_fields)] + [F.lit("present")]
    return F.array(*[F.xxhash64(F.lit(salt), F.col("fix_key"), F.lit(i), v) for i, v in enumerate(values)])


def unequal_cells(sides: DataFrame, n_fields: int) -> DataFrame:
    """The matrix's unequal rows: bucket and a bit mask of the columns (bit ``n_fields``: the keys themselves).

    Each copy adds up its own records; the two never meet by key here. A cell's sum holds the two
    64-bit hashes in halves below 2**32, which can be added without overflow.
    """
    packed = F.arrays_zip(_hashes(n_fields, 11).alias("a"), _hashes(n_fields, 47).alias("b"))
    records = sides.select("bucket", "fix_key", "is_local", "at", packed.alias("h")).groupBy("is_local", "bucket", "fix_key").agg(F.max_by("h", "at").alias("h"))
    cells = records.select("is_local", "bucket", F.posexplode("h").alias("column", "h"))
    low, high = (lambda h: h.bitwiseAND(F.lit(0xFFFFFFFF))), (lambda h: F.shiftrightunsigned(h, 32))
    signed = lambda h: F.when(F.col("is_local"), h).otherwise(-h)
    parts = [low(F.col("h.a")), high(F.col("h.a")), low(F.col("h.b")), high(F.col("h.b"))]
    sums = cells.groupBy("bucket", "column").agg(*[F.sum(signed(x)).alias(f"s{i}") for i, x in enumerate(parts)])
    unequal = sums.where("s0 <> 0 or s1 <> 0 or s2 <> 0 or s3 <> 0")
    return unequal.groupBy("bucket").agg(F.bit_or(F.expr("shiftleft(1, column)")).alias("mask"))


def _rows(df: DataFrame) -> int:
    return df.select(F.count(F.lit(1))).first()[0]  # from the Parquet footers


def diff_copies(
    local: DataFrame, remote: DataFrame, fields: list[Compared] = FIX_FIELDS, rows_per_bucket: int = ROWS_PER_BUCKET
) -> DataFrame:
    """fix_id, conflict_type, field_name: a row for each record missing on a side and each differing field.

    ``remote_deleted`` / ``local_deleted`` with the field ``id`` for records of one copy only, else
    ``both_modified`` with the field's name.
    """
    need = max(64, (_rows(local) + _rows(remote)) // 2 // max(1, rows_per_bucket))
    buckets = 1 << (need - 1).bit_length()
    n = len(fields)
    cells = settle(unequal_cells(_sides(local, remote, fields, buckets), n), "unequal-cells")
    anywhere = cells.agg(F.bit_or("mask")).first()[0] or 0
    used = [i for i in range(n) if anywhere >> i & 1]

    picked = [fields[i] for i in used]
    sides = _sides(local, remote, picked, buckets)
    # A differing field lies in an unequal cell, so other cells' values need not travel.
    masked = [F.when(F.col("mask").bitwiseAND(F.lit(1 << i)) != 0, F.col(f"f{k}")).alias(f"f{k}") for k, i in enumerate(used)]
    touched = sides.join(cells, "bucket").select("fix_key", "is_local", "at", F.struct(F.lit(1).alias("one"), *masked).alias("v"))
    both = touched.groupBy("fix_key").agg(
        F.max_by("v", F.when(F.col("is_local"), F.col("at"))).alias("l"),
        F.max_by("v", F.when(~F.col("is_local"), F.col("at"))).alias("r"),
    )
    found = F.struct
    names = [
        F.when(~F.col(f"l.f{k}").eqNullSafe(F.col(f"r.f{k}")), found(F.lit("both_modified").alias("conflict_type"), F.lit(c.name).alias("field_name")))
        for k, c in enumerate(picked)
    ]
    missing = lambda kind: F.array(found(F.lit(kind).alias("conflict_type"), F.lit("id").alias("field_name")))
    empty = "array<struct<conflict_type:string,field_name:string>>"
    cases = (
        F.when(F.col("r").isNull(), missing("remote_deleted"))
        .when(F.col("l").isNull(), missing("local_deleted"))
        .otherwise(F.array_compact(F.array(*names)) if names else F.array().cast(empty))
    )
    return both.select(F.col("fix_key").alias("fix_id"), F.inline(cases))
