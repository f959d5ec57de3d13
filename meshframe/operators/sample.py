"""Point location, sampling and resampling.

A point's block follows from its coordinates at each level that occurs, so location is an equi-join on block indices:
one candidate a level, more only for points exactly on faces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ghost import view
from .mesh import AXES, BLOCK, KEY, Mesh, split_to_blocks

XYZ = ("x", "y", "z")


def root_position(mesh: Mesh, points: DataFrame) -> DataFrame:
    """points with their position in level-1 block units: u, v, w."""
    cols = {}
    for a, (u, x) in enumerate(zip("uvw", XYZ, strict=True)):
        size = (mesh.xmax[a] - mesh.xmin[a]) / mesh.roots[a]
        cols[u] = (F.col(x) - F.lit(mesh.xmin[a])) / F.lit(size)
    return points.withColumns(cols)


def candidates(mesh: Mesh, points: DataFrame) -> DataFrame:
    """points joined with every leaf whose closed box holds them: (points.., igrid, level, b1, b2, b3)."""
    levels = mesh.blocks.where("is_leaf").select("level").distinct()
    deepest = [r[0] for r in levels.collect()]  # one row a level
    rows = points.withColumn("__level", F.explode(F.array(*[F.lit(x) for x in sorted(deepest)])))
    for a, (x, b) in enumerate(zip(XYZ, BLOCK, strict=True)):
        size = F.lit((mesh.xmax[a] - mesh.xmin[a]) / mesh.roots[a]) / F.expr("shiftleft(1L, __level - 1)")
        at = (F.col(x) - F.lit(mesh.xmin[a])) / size
        low, high = F.ceil(at) - 1, F.floor(at)
        rows = rows.withColumn(f"__{b}", F.explode(F.array_distinct(F.array(low, high))))
    leaves = mesh.leaves
    on = F.col("level") == F.col("__level")
    for b in BLOCK:
        on = on & (F.col(b) == F.col(f"__{b}"))
    return rows.join(leaves, on).select(*points.columns, *leaves.columns)


def locate(mesh: Mesh, points: DataFrame, pid: str = "pid") -> DataFrame:
    """Each point inside the domain with its leaf; on a shared face the lowest igrid."""
    rest = [c for c in points.columns if c != pid]
    found = candidates(mesh, points).groupBy(pid).agg(F.min(F.struct("igrid", "level", *BLOCK, *rest)).alias("l"))
    return found.select(pid, *[f"l.{c}" for c in rest], "l.igrid", "l.level", *[f"l.{b}" for b in BLOCK])


def cell_position(mesh: Mesh, axis: int) -> Column:
    """A point's position in cells of its leaf's level."""
    return (F.col(XYZ[axis]) - F.lit(mesh.xmin[axis])) / mesh.spacing(axis)


def nearest_cell(mesh: Mesh, located: DataFrame) -> DataFrame:
    """located with the global index of the cell that holds the point; a leaf's upper face belongs to its last cell."""
    cols = {}
    for a, (x, b) in enumerate(zip(AXES, BLOCK, strict=True)):
        first = F.col(b) * mesh.block_nx[a]
        cols[x] = F.greatest(first, F.least(F.floor(cell_position(mesh, a)), first + mesh.block_nx[a] - 1)).cast("long")
    return located.withColumns(cols)


def sample_nearest(mesh: Mesh, points: DataFrame, field: str, pid: str = "pid") -> DataFrame:
    """(pid, value) of the cell that holds each point."""
    mesh.need(field)
    at = nearest_cell(mesh, locate(mesh, points, pid)).select(pid, *KEY)
    cells = mesh.cells.select(*[F.col(c).alias(f"c_{c}") for c in KEY], F.col(field).alias("value"))
    on = F.lit(True)
    for c in KEY:
        on = on & (F.col(c) == F.col(f"c_{c}"))
    return at.join(cells, on).select(pid, "value")


def _corners(rows: DataFrame, mesh: Mesh) -> DataFrame:
    """rows with the lower corner cell and fraction of each axis, spread to eight corners (i, j, k, weight)."""
    for a, x in enumerate(AXES):
        at = cell_position(mesh, a) - 0.5
        rows = rows.withColumns({f"__{x}": F.floor(at).cast("long"), f"__f{x}": at - F.floor(at)})
    steps = F.array(*[F.struct(*[F.lit((n >> a) & 1).alias(f"d{x}") for a, x in enumerate(AXES)]) for n in range(8)])
    rows = rows.withColumn("__d", F.explode(steps))
    weight = F.lit(1.0)
    for x in AXES:
        rows = rows.withColumn(x, F.col(f"__{x}") + F.col(f"__d.d{x}"))
        weight = weight * F.when(F.col(f"__d.d{x}") == 1, F.col(f"__f{x}")).otherwise(1 - F.col(f"__f{x}"))
    return rows.withColumn("weight", weight)


def sample_linear(mesh: Mesh, points: DataFrame, field: str, pid: str = "pid") -> DataFrame:
    """(pid, value) between the eight cells around each point, without ghost cells.

    A corner inside another leaf takes that leaf's cell: the same level's, the mean of eight finer ones, or the coarser
    cell that holds it. Corners beyond the domain are clamped.
    """
    mesh.need(field)
    at = _corners(locate(mesh, points, pid), mesh)
    at = at.withColumns({f"c{x}": F.greatest(F.lit(0), F.least(F.col(x), mesh.extent(a) - 1)).cast("long") for a, x in enumerate(AXES)})
    v = view(mesh.with_cells(mesh.cells.select(*KEY, field), (field,)))
    same = v.select(*[F.col(c).alias(f"s_{c}") for c in KEY], F.col(field).alias("s_value"))
    up = mesh.cells.select(*[F.col(c).alias(f"u_{c}") for c in KEY], F.col(field).alias("u_value"))
    on = F.col("level") == F.col("s_level")
    on_up = (F.col("level") - 1 == F.col("u_level")) & F.col("s_level").isNull()
    for x in AXES:
        on = on & (F.col(f"c{x}") == F.col(f"s_{x}"))
        on_up = on_up & (F.shiftright(f"c{x}", 1) == F.col(f"u_{x}"))
    met = at.join(same, on, "left").join(up, on_up, "left")
    return met.groupBy(pid).agg(F.sum(F.col("weight") * F.coalesce("s_value", "u_value")).alias("value"))


def resample(mesh: Mesh, ghosted: DataFrame, points: DataFrame, box: tuple, n: tuple, fields: tuple[str, ...]) -> DataFrame:
    """(p, q, r, fields): trilinear values at a uniform grid's cell centres; 0 outside the mesh.

    points is uniform_points() of the box. A leaf owns the grid cells from the half-to-even rounded start of its box to
    the half-up rounded end; where two leaves claim a point on their face, the later igrid is taken. ghosted needs one
    filled ghost layer.
    """
    own = candidates(mesh, points)
    ok = F.lit(True)
    for a, (p, b) in enumerate(zip("pqr", BLOCK, strict=True)):
        step = (box[1][a] - box[0][a]) / n[a]
        size = mesh.spacing(a) * mesh.block_nx[a]
        lo = (F.lit(mesh.xmin[a]) + F.col(b) * size - box[0][a]) / step
        hi = (F.lit(mesh.xmin[a]) + (F.col(b) + 1) * size - box[0][a]) / step
        ok = ok & (F.col(p) >= F.rint(lo)) & (F.col(p) < F.floor(hi + 0.5))
    owned = own.where(ok).groupBy("p", "q", "r").agg(F.max(F.struct("igrid", "level", *XYZ)).alias("l"))
    at = _corners(owned.select("p", "q", "r", "l.*"), mesh)
    right = ghosted.select(*[F.col(c).alias(f"g_{c}") for c in ("igrid", *AXES)], *[F.col(f).alias(f"g_{f}") for f in fields])
    on = F.col("igrid") == F.col("g_igrid")
    for x in AXES:
        on = on & (F.col(x) == F.col(f"g_{x}"))
    got = at.join(right, on).groupBy("p", "q", "r").agg(*[F.sum(F.col("weight") * F.col(f"g_{f}")).alias(f) for f in fields])
    got = got.select(*[F.col(x).alias(f"o_{x}") for x in "pqr"], *fields)
    on = (F.col("p") == F.col("o_p")) & (F.col("q") == F.col("o_q")) & (F.col("r") == F.col("o_r"))
    return points.select("p", "q", "r").join(got, on, "left").select("p", "q", "r", *[F.coalesce(f, F.lit(0.0)).alias(f) for f in fields])


def dense_blocks(mesh: Mesh) -> DataFrame:
    """Interior cells with igrid and local indices, as files hold them."""
    out = split_to_blocks(mesh)
    return out.withColumns({f"l{x}": F.pmod(F.col(x), F.lit(mesh.block_nx[a])) for a, x in enumerate(AXES)})
