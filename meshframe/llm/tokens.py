"""Rows of numbers for the tokens of a text, worked out once for each token that a worker meets."""

from __future__ import annotations

from collections.abc import Callable, Hashable, Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tokens that a worker remembers; then it starts afresh. Longer tokens are worked out each time.
REMEMBERED, LONGEST = 300_000, 48

_EDGE = "".join(chr(i) for i in range(0x21, 0x7F) if not chr(i).isalnum()) + "«»“”„‘’…–—¿¡"


def stripped(token: str) -> str:
    return token.strip(_EDGE)


def held_out(id_col: str | Column) -> Column:
    """Whether crc32 of the identifier as text leaves 1 modulo 3; null identifiers are not held out."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % 3 == 1, F.lit(False))


class TokenTable:
    """values of tokens (split at white space, lower case) under a function from a token to a row of numbers."""

    def __init__(self, row: Callable[[str], Sequence[float]], width: int) -> None:
        self.row, self.width = row, width
        self._reset()

    def _reset(self) -> None:
        self.at: dict[str, int] = {}
        self.rows = np.zeros((1024, self.width))

    def _add(self, token: str) -> int:
        k = self.at[token] = len(self.at)
        if k >= len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        self.rows[k] = self.row(token)
        return k

    def values(self, text: str) -> np.ndarray:
        """One row for every token of the text."""
        tokens = text.lower().split()
        if len(self.at) > REMEMBERED:
            self._reset()
        found = [*map(self.at.get, tokens)]
        extra: dict[int, Sequence[float]] = {}
        if None in found:
            for i, k in enumerate(found):
                if k is None:
                    t = tokens[i]
                    if len(t) > LONGEST:
                        extra[i], found[i] = self.row(t), 0
                    else:
                        found[i] = self.at[t] if t in self.at else self._add(t)
        out = self.rows[found] if found else np.zeros((0, self.width))
        for i, v in extra.items():
            out[i] = v
        return out


_last: list[tuple[Hashable, TokenTable]] = []


def kept_table(key: Hashable, row: Callable[[str], Sequence[float]], width: int) -> TokenTable:
    """The table that this worker process made for the key in an earlier task, or a new one; only one is kept."""
    if not _last or _last[0][0] != key:
        _last[:] = [(key, TokenTable(row, width))]
    return _last[0][1]
