"""The mesh: a small header on the driver and two relations, blocks and cells.

blocks: (igrid, level, b1, b2, b3, is_leaf, root), one row an octree node; b are 0-based block indices at the level,
igrid numbers the leaves from 1 in curve order and is -1 for parents.
cells: (level, i, j, k, <one DOUBLE a field>), one row a leaf cell, with indices that are global at the level, so that
neighbours are found by arithmetic and joins by equality.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

AXES = ("i", "j", "k")
KEY = ("level", "i", "j", "k")
BLOCK = ("b1", "b2", "b3")


@dataclass(frozen=True)
class Mesh:
    domain_nx: tuple[int, int, int]
    block_nx: tuple[int, int, int]
    xmin: tuple[float, float, float]
    xmax: tuple[float, float, float]
    fields: tuple[str, ...]
    blocks: DataFrame
    cells: DataFrame

    def __post_init__(self) -> None:
        for a, b in zip(self.domain_nx, self.block_nx, strict=True):
            if a % b or b % 2:
                raise ValueError("block_nx must be even and divide domain_nx")
        if any(a >= b for a, b in zip(self.xmin, self.xmax, strict=True)):
            raise ValueError("xmin must be below xmax on each axis")
        if missing := set(self.fields) - set(self.cells.columns):
            raise ValueError(f"cells lack the fields {sorted(missing)}")

    @property
    def roots(self) -> tuple[int, int, int]:
        return tuple(a // b for a, b in zip(self.domain_nx, self.block_nx, strict=True))

    @property
    def leaves(self) -> DataFrame:
        return self.blocks.where("is_leaf").select("igrid", "level", *BLOCK)

    def spacing(self, axis: int, level: str = "level") -> Column:
        dx = (self.xmax[axis] - self.xmin[axis]) / self.domain_nx[axis]
        return F.lit(dx) / F.expr(f"shiftleft(1L, {level} - 1)")

    def extent(self, axis: int, level: str = "level") -> Column:
        """Cells along an axis at a level."""
        return F.expr(f"shiftleft({self.domain_nx[axis]}L, {level} - 1)")

    def need(self, *names: str) -> None:
        if lack := [x for x in names if x not in self.fields]:
            raise ValueError(f"the mesh has no field {', '.join(lack)}")

    def block_of(self, axis: int) -> Column:
        return F.floor(F.col(AXES[axis]) / F.lit(self.block_nx[axis])).cast("long")

    def with_cells(self, cells: DataFrame, fields: tuple[str, ...]) -> Mesh:
        return replace(self, cells=cells, fields=fields)


def split_to_blocks(mesh: Mesh) -> DataFrame:
    """cells with the igrid of their leaf: an equi-join on the block index that the cell index implies."""
    keyed = mesh.cells.withColumns({f"__{b}": mesh.block_of(a) for a, b in enumerate(BLOCK)})
    leaves = mesh.leaves.select("igrid", F.col("level").alias("__level"), *[F.col(b).alias(f"__l{b}") for b in BLOCK])
    on = (F.col("level") == F.col("__level")) & (F.col("__b1") == F.col("__lb1"))
    on = on & (F.col("__b2") == F.col("__lb2")) & (F.col("__b3") == F.col("__lb3"))
    return keyed.join(leaves, on).select("igrid", *mesh.cells.columns)


def block_cells(mesh: Mesh, grow: int = 0) -> DataFrame:
    """(igrid, level, b.., i, j, k) of each leaf's cells and of `grow` layers around them."""
    out = mesh.leaves
    for axis, (name, b) in enumerate(zip(AXES, BLOCK, strict=True)):
        n = mesh.block_nx[axis]
        lo = F.col(b) * n - grow
        out = out.withColumn(name, F.explode(F.sequence(lo, lo + n + 2 * grow - 1)))
    return out


def interior(mesh: Mesh) -> Column:
    """Whether (i, j, k) lies in the block of the row."""
    parts = [mesh.block_of(a) == F.col(b) for a, b in enumerate(BLOCK)]
    return parts[0] & parts[1] & parts[2]


def empty_cells(mesh: Mesh, fields: tuple[str, ...]) -> DataFrame:
    """Cells of all leaves with every field 0."""
    return block_cells(mesh).select(*KEY, *[F.lit(0.0).alias(f) for f in fields])


def block_geometry(mesh: Mesh) -> DataFrame:
    """Bounds and cell size of each leaf; halving is exact."""
    out = mesh.leaves
    cols = {}
    for a, (x, b) in enumerate(zip("xyz", BLOCK, strict=True)):
        size = mesh.spacing(a) * F.lit(mesh.block_nx[a])
        cols[f"{x}min"] = F.lit(mesh.xmin[a]) + F.col(b) * size
        cols[f"{x}max"] = F.lit(mesh.xmin[a]) + (F.col(b) + 1) * size
        cols[f"d{x}"] = mesh.spacing(a)
    return out.withColumns(cols).drop(*BLOCK)


def uniform_points(spark: SparkSession, xmin: tuple, xmax: tuple, n: tuple) -> DataFrame:
    """Cell centres of a region: (p, q, r, x, y, z), made on the executors from one range."""
    total = n[0] * n[1] * n[2]
    at = F.col("id")
    ids = {"p": F.expr(f"id div {n[1] * n[2]}"), "q": F.expr(f"(id div {n[2]}) % {n[1]}"), "r": at % n[2]}
    pts = spark.range(total).select(*[c.cast("long").alias(k) for k, c in ids.items()])
    for a, (x, p) in enumerate(zip("xyz", "pqr", strict=True)):
        pts = pts.withColumn(x, F.lit(float(xmin[a])) + (F.col(p) + 0.5) * F.lit((xmax[a] - xmin[a]) / n[a]))
    return pts
