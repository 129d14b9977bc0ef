"""Several values packed in one field: a quote-aware finite-state tokenizer.

The machine reads one field from left to right and knows three things: the quote it is in, whether
the last character was an escape, and the stack of open brackets. Values are cut at separators
that lie outside quotes. A first pass takes blanks as separators too, so that a quote after a blank
opens a value; if it meets another separator outside quotes, blanks do not separate in this field and
a second pass reads it without them.

Cases with a defined result: null, empty and blank fields have no values; runs of separators make
no empty values (positions count the values that are left); a quote that never closes, or stands
inside a value, is an ordinary character; so is a bracket without partner.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What separates, quotes and encloses.
SEPARATORS = ",;|\t\n\r，；、"
QUOTES = "\"'"
BRACKETS = {"[": "]", "{": "}", "(": ")"}

_SEPARATOR = set(SEPARATORS)
_CLOSERS = set(BRACKETS.values())
_SPECIAL = re.compile(r"[\"'\\\[\]{}()]")
_SPLIT = re.compile("[" + re.escape(SEPARATORS) + "]")


def _partners(s: str) -> dict[int, int]:
    """Positions of opening brackets that have a partner, with the partner's position."""
    found: dict[int, int] = {}
    stack: list[int] = []
    for i, ch in enumerate(s):
        if ch in BRACKETS:
            stack.append(i)
        elif ch in _CLOSERS and stack and BRACKETS[s[stack[-1]]] == ch:
            found[stack.pop()] = i
    return found


def _quoted(s: str, i: int, blank_separates: bool, closers: set[int]) -> tuple[str, int] | None:
    """The value of the quotation that opens at ``i`` and the position after it; None if it never closes."""
    quote, n, j, buf = s[i], len(s), i + 1, []
    while j < n:
        ch = s[j]
        if ch == "\\" and j + 1 < n:
            if s[j + 1] == "u" and re.fullmatch("[0-9a-fA-F]{4}", s[j + 2 : j + 6]):
                buf.append(chr(int(s[j + 2 : j + 6], 16)))
                j += 6
                continue
            buf.append(s[j + 1])
            j += 2
            continue
        if ch == quote:
            k = j + 1
            while k < n and s[k].isspace() and s[k] not in _SEPARATOR:
                k += 1
            ends = k >= n or s[k] in _SEPARATOR or k in closers or (blank_separates and k > j + 1)
            if ends:
                return "".join(buf), j + 1
            if s[j + 1] == quote:
                j += 1
            buf.append(quote)
        else:
            buf.append(ch)
        j += 1
    return None


def _pass(s: str, blank_separates: bool) -> tuple[list[str], bool]:
    """The values of a field, and whether a separator other than a blank stood outside quotes."""
    partner = _partners(s)
    closers: set[int] = set()  # of brackets that enclose values
    inner: list[int] = []  # ends of brackets inside the current value
    values: list[str] = []
    buf: list[str] = []
    met, i, n = False, 0, len(s)

    def emit() -> None:
        if value := "".join(buf).strip():
            values.append(value)
        buf.clear()

    while i < n:
        ch = s[i]
        fresh = not buf or not "".join(buf).strip()
        if inner and i == inner[-1]:
            inner.pop()
            buf.append(ch)
        elif ch == "\\" and i + 1 < n and (s[i + 1] in _SEPARATOR or s[i + 1] in QUOTES or s[i + 1] == "\\" or s[i + 1].isspace()):
            buf.append(s[i + 1])
            i += 1
        elif i in closers:
            emit()
        elif inner:
            buf.append(ch)
        elif ch in _SEPARATOR:
            met = True
            emit()
        elif blank_separates and ch.isspace():
            emit()
        elif fresh and ch in QUOTES and (got := _quoted(s, i, blank_separates, closers)):
            buf[:] = [got[0]]
            emit()
            i = got[1]
            continue
        elif ch in BRACKETS and i in partner:
            if fresh:
                buf.clear()
                closers.add(partner[i])
            else:
                inner.append(partner[i])
                buf.append(ch)
        else:
            buf.append(ch)
        i += 1
    emit()
    return values, met


def tokenize(field: str | None) -> list[str]:
    """The values of one packed field, in order."""
    if not field or field.isspace():
        return []
    if not _SPECIAL.search(field):
        parts = _SPLIT.split(field)
        if len(parts) == 1:
            parts = field.split()
        return [v for p in parts if (v := p.strip())]
    values, met = _pass(field, blank_separates=True)
    return _pass(field, blank_separates=False)[0] if met else values


@F.pandas_udf(T.ArrayType(T.StringType()))
def split_packed(fields: pd.Series) -> pd.Series:
    """The values of each packed field as an array (empty for null)."""
    known: dict[str, list[str]] = {}
    out = []
    for f in fields:
        if f is None:
            out.append([])
            continue
        v = known.get(f)
        if v is None:
            v = known[f] = tokenize(f)
        out.append(v)
    return pd.Series(out, dtype=object)


@F.pandas_udf(T.StringType())
def tag_set_key(fields: pd.Series) -> pd.Series:
    """The set of values of each packed field, ignoring case, as one canonical text; null if empty."""
    known: dict[str, str | None] = {}
    out = []
    for f in fields:
        if f is None:
            out.append(None)
            continue
        if f not in known:
            known[f] = "\x1f".join(sorted({v.lower() for v in tokenize(f)})) or None
        out.append(known[f])
    return pd.Series(out, dtype=object)


def explode_packed(df: DataFrame, field: str, value: str = "tag", position: str = "pos") -> DataFrame:
    """One row per value of ``field``; the other columns are kept and ``position`` counts from 1.

    Fields without values give no row. Columns of ``df`` named ``value`` or ``position`` are replaced.
    """
    keep: list[Column] = [df[c] for c in df.columns if c not in (field, value, position)]
    packed = df.where(df[field].isNotNull()).select(*keep, split_packed(df[field]).alias("__values"))
    names = [c for c in df.columns if c not in (field, value, position)]
    return packed.select(*names, F.posexplode("__values").alias("__at", value)).select(
        *names, (F.col("__at") + 1).cast("int").alias(position), F.col(value)
    )
