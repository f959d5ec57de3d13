"""Space-filling-curve keys and octree index arithmetic as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bits an axis that a 3-D code has room for in a BIGINT.
BITS_3D, BITS_2D = 21, 31


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def interleave(coords: list[str | Column], bits: int | None = None) -> Column:
    """Interleaved bits of 1, 2 or 3 coordinates, the first one lowest; raises for coordinates out of range."""
    n = len(coords)
    if n not in (1, 2, 3):
        raise ValueError(f"1, 2 or 3 coordinates are needed, not {n}")
    bits = bits or {1: 62, 2: BITS_2D, 3: BITS_3D}[n]
    if n == 1:
        code = _col(coords[0]).cast("long")
    else:
        terms = [
            F.shiftleft(F.shiftright(_col(c).cast("long"), b).bitwiseAND(F.lit(1)), n * b + axis)
            for axis, c in enumerate(coords)
            for b in range(bits)
        ]
        code = reduce(lambda a, b: a.bitwiseOR(b), terms)
    ok = reduce(lambda a, b: a & b, [(_col(c) >= 0) & (_col(c) < F.lit(1 << bits)) for c in coords])
    return F.when(ok, code).otherwise(F.raise_error(F.lit(f"a coordinate needs 0 to {bits} bits")).cast("long"))


def morton3(x: str | Column, y: str | Column, z: str | Column) -> Column:
    return interleave([x, y, z])


def parent(c: str | Column) -> Column:
    return F.shiftright(_col(c), 1)


def clamp(c: Column, low: Column | int, high: Column | int) -> Column:
    low, high = (x if isinstance(x, Column) else F.lit(x) for x in (low, high))
    return F.greatest(low, F.least(high, c))

