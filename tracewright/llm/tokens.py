"""Counting the tokens of a public byte-level BPE, and finding where they end.

A text's tokens are those of its pre-tokens, one after another, so a text may be cut between any two
pre-tokens. It is cut after each word or number with the punctuation that follows, and what is known
of such a chunk is remembered in each Python worker. The rest is one pass of a regular expression.
The counts are exactly those of encoding the whole text.
"""

from __future__ import annotations

import base64
import functools
import itertools
import re
import unicodedata
from collections.abc import Callable
from pathlib import Path
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Where the vocabulary files of public tokenizers lie; a parameter of every operator that counts tokens.
TOKENIZER_DIR = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"

#: Fixed value: the pre-token pattern that this family of public vocabularies was made with.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Unicode's white space, which is what the pattern's \s means there (Python's \s has four more).
_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"

#: Chunks that a worker remembers before it starts anew; bounds its memory.
REMEMBERED = 400_000


def _category(letter: str) -> str:
    """The basic plane's characters beyond ASCII of a general category, as the inside of a character class."""
    runs: list[list[int]] = []
    for cp in range(0x80, 0x10000):
        if unicodedata.category(chr(cp))[0] == letter:
            if runs and runs[-1][1] == cp - 1:
                runs[-1][1] = cp
            else:
                runs.append([cp, cp])
    return "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in runs)


def _chunks(letters: str, numbers: str, space: str) -> re.Pattern[str]:
    """PATTERN with the punctuation after a word or number joined to it, unless it ends at an apostrophe."""
    other = f"{space}{letters}{numbers}"
    tail = f"(?:[^{other}']++(?!'))?"
    return re.compile(f"'(?:[stdm]|re|ve|ll)| ?[{letters}]+{tail}| ?[{numbers}]+{tail}| ?[^{other}]+|[{space}]+(?![^{space}])|[{space}]+")


class _Memo(dict):
    """A function's results so far."""

    def __init__(self, make: Callable[[str], Any]) -> None:
        self._make = make

    def __missing__(self, key: str) -> Any:
        value = self[key] = self._make(key)
        return value


class Bpe:
    """Token counts and byte lengths of texts under one vocabulary file."""

    def __init__(self, path: str) -> None:
        import tiktoken

        ranks = {}
        for line in Path(path).read_bytes().splitlines():
            token, rank = line.split()
            ranks[base64.b64decode(token)] = int(rank)
        self._encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._tokens = {r: t for t, r in ranks.items()}
        self._ascii = _chunks("A-Za-z", "0-9", "\\t-\\r ")
        self._any = _chunks("A-Za-z" + _category("L"), "0-9" + _category("N"), _SPACE)
        self._counts = _Memo(lambda w: len(self._encoding.encode_ordinary(w)))
        self._lengths = _Memo(self._char_lengths)

    def _cut(self, text: str) -> list[str]:
        if text.isascii():
            return self._ascii.findall(text)
        # Letters and numbers beyond the basic plane are not in the classes: such a text stays whole.
        return self._any.findall(text) if max(text) < "\U00010000" else [text]

    def count(self, text: str) -> int:
        """Number of tokens."""
        known = self._counts
        if len(known) > REMEMBERED:
            known.clear()
        return sum(map(known.__getitem__, self._cut(text)))

    def ends(self, text: str) -> np.ndarray:
        """For each token the number of characters of the text up to its end.

        A token that ends inside a character counts that character as not yet there.
        """
        known = self._lengths
        if len(known) > REMEMBERED:
            known.clear()
        parts = map(known.__getitem__, self._cut(text))
        return np.cumsum(np.fromiter(itertools.chain.from_iterable(parts), np.int64))

    def _char_lengths(self, piece: str) -> tuple[int, ...]:
        """Characters that each token of a chunk completes."""
        ids = self._encoding.encode_ordinary(piece)
        if piece.isascii():
            return tuple(len(self._tokens[i]) for i in ids)
        starts = np.cumsum([0] + [len(ch.encode("utf-8", "surrogatepass")) for ch in piece])
        at = np.cumsum([len(self._tokens[i]) for i in ids])
        done = np.searchsorted(starts, at, side="right") - 1
        return tuple(int(x) for x in np.diff(np.concatenate([[0], done])))


@functools.cache
def bpe(path: str) -> Bpe:
    """The vocabulary at ``path``, once per process."""
    return Bpe(path)


def vocabulary_path(tokenizer_dir: str = TOKENIZER_DIR, name: str = VOCABULARY) -> str:
    """The vocabulary's file."""
    return f"{tokenizer_dir}/{name}"


def token_count(path: str):  # noqa: ANN201
    """A column function: number of tokens of a text (0 for null and empty)."""

    @F.pandas_udf(T.IntegerType())
    def count(texts: pd.Series) -> pd.Series:
        model = bpe(path)
        return pd.Series([model.count(t) if t else 0 for t in texts], dtype="int32")

    return count
