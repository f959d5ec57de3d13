"""Ghost cells across refinement levels as joins on global cell addresses.

V is every leaf cell together with the means of finer cells one level up; on a 2:1 balanced forest the two never meet at
one address. A ghost address is clamped into the domain (zero-gradient boundary) and looked up in V. What is not there
lies beside a coarser leaf and is interpolated from V one level up with limited slopes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import clamp
from .mesh import AXES, KEY, Mesh, block_cells, interior, split_to_blocks


def restrict(mesh: Mesh) -> DataFrame:
    """Mean of each 2x2x2 group of cells, at the level above."""
    up = [F.shiftright(c, 1).alias(c) for c in AXES]
    fine = mesh.cells.where("level > 1").select((F.col("level") - 1).alias("level"), *up, *mesh.fields)
    return fine.groupBy(*KEY).agg(*[(F.sum(f) / 8).alias(f) for f in mesh.fields])


def view(mesh: Mesh) -> DataFrame:
    """V: leaf cells and restricted cells."""
    return mesh.cells.select(*KEY, *mesh.fields).unionByName(restrict(mesh))


def addresses(mesh: Mesh, depth: int) -> DataFrame:
    """(igrid, level, i, j, k, ci, cj, ck) of every ghost cell; c are clamped into the domain."""
    grown = block_cells(mesh, depth).where(~interior(mesh))
    return grown.select(
        "igrid", *KEY, *[clamp(F.col(x), 0, mesh.extent(a) - 1).cast("long").alias(f"c{x}") for a, x in enumerate(AXES)]
    )


def _at(level: Column, cells: list[Column], prefix: str) -> Column:
    on = level == F.col(f"{prefix}level")
    for x, c in zip(AXES, cells, strict=True):
        on = on & (c == F.col(f"{prefix}{x}"))
    return on


def _prefixed(df: DataFrame, prefix: str, columns: tuple[str, ...]) -> DataFrame:
    return df.select(*[F.col(c).alias(f"{prefix}{c}") for c in columns])


def looked_up(mesh: Mesh, addr: DataFrame, v: DataFrame) -> DataFrame:
    """addr with the values of V at the clamped address (null where V has none), and `found`."""
    right = _prefixed(v, "v_", (*KEY, *mesh.fields)).withColumn("__in", F.lit(True))
    out = addr.join(right, _at(F.col("level"), [F.col(f"c{x}") for x in AXES], "v_"), "left")
    return out.select(*addr.columns, *[F.col(f"v_{f}").alias(f) for f in mesh.fields], F.col("__in").isNotNull().alias("found"))


def minmod(left: Column, mid: Column, right: Column) -> Column:
    """Limited slope of three values: sign(c) * max(0, min(|c|, sign * l, sign * r)), c the mean of both differences."""
    lo, hi = mid - left, right - mid
    c = (lo + hi) / 2
    s = F.signum(c)
    return s * F.greatest(F.lit(0.0), F.least(F.abs(c), s * lo, s * hi))


def slopes(mesh: Mesh, wanted: DataFrame, v: DataFrame) -> DataFrame:
    """(level, i, j, k, fields, field_sx, field_sy, field_sz) of the wanted addresses; neighbours are clamped.

    Only the wanted cells are spread to their seven stencil addresses; V is read once.
    """
    roles = [("mid", 0, 0, 0), ("xl", -1, 0, 0), ("xr", 1, 0, 0), ("yl", 0, -1, 0), ("yr", 0, 1, 0), ("zl", 0, 0, -1), ("zr", 0, 0, 1)]
    steps = F.array(*[F.struct(F.lit(r).alias("role"), F.lit(a).alias("di"), F.lit(b).alias("dj"), F.lit(c).alias("dk")) for r, a, b, c in roles])
    spread = wanted.select(*KEY, F.explode(steps).alias("s"))
    to = [clamp(F.col(x) + F.col(f"s.d{x}"), 0, mesh.extent(a) - 1).cast("long") for a, x in enumerate(AXES)]
    spread = spread.select(*KEY, F.col("s.role").alias("role"), *[c.alias(f"t{x}") for c, x in zip(to, AXES, strict=True)])
    right = _prefixed(v, "v_", (*KEY, *mesh.fields))
    met = spread.join(right, _at(F.col("level"), [F.col(f"t{x}") for x in AXES], "v_"))
    pick = {f"{f}_{r[0]}": F.max(F.when(F.col("role") == r[0], F.col(f"v_{f}"))) for f in mesh.fields for r in roles}
    g = met.groupBy(*KEY).agg(*[c.alias(n) for n, c in pick.items()])
    out = []
    for f in mesh.fields:
        out.append(F.col(f"{f}_mid").alias(f))
        out += [minmod(F.col(f"{f}_{a}l"), F.col(f"{f}_mid"), F.col(f"{f}_{a}r")).alias(f"{f}_s{a}") for a in "xyz"]
    return g.select(*KEY, *out)


def prolonged(mesh: Mesh, rest: DataFrame, v: DataFrame) -> DataFrame:
    """Values at clamped addresses that V lacks: the coarse cell's value and a quarter of its slopes either way."""
    up = [F.shiftright(f"c{x}", 1) for x in AXES]
    wanted = rest.select((F.col("level") - 1).alias("level"), *[u.alias(x) for u, x in zip(up, AXES, strict=True)]).distinct()
    s = slopes(mesh, wanted, v)
    s = _prefixed(s, "s_", tuple(s.columns))
    met = rest.join(s, _at(F.col("level") - 1, up, "s_"))
    side = [F.when(F.col(f"c{x}") % 2 == 0, -0.25).otherwise(0.25) for x in AXES]
    value = {
        f: F.col(f"s_{f}") + F.col(f"s_{f}_sx") * side[0] + F.col(f"s_{f}_sy") * side[1] + F.col(f"s_{f}_sz") * side[2] for f in mesh.fields
    }
    return met.select("igrid", *KEY, *[c.alias(f) for f, c in value.items()])


def ghosts(mesh: Mesh, depth: int = 2) -> DataFrame:
    """(igrid, level, i, j, k, fields): the ghost cells of every leaf, indices may lie outside the domain."""
    v = view(mesh)
    met = looked_up(mesh, addresses(mesh, depth), v)
    near = met.where("found").select("igrid", *KEY, *mesh.fields)
    rest = met.where("NOT found").select("igrid", *KEY, *[f"c{x}" for x in AXES])
    return near.unionByName(prolonged(mesh, rest, v))


def ghosted(mesh: Mesh, depth: int = 2) -> DataFrame:
    """Every leaf's own cells and its ghost cells, with `ghost`."""
    own = split_to_blocks(mesh).select("igrid", *KEY, *mesh.fields).withColumn("ghost", F.lit(False))
    return own.unionByName(ghosts(mesh, depth).withColumn("ghost", F.lit(True)))
