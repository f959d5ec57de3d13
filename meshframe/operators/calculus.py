"""Central differences on ghosted blocks and slabs.

Rows are dealt by block once; the three directions are windows within that partitioning, so they only sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .mesh import AXES, KEY, Mesh

B, M = ("b1", "b2", "b3"), ("m1", "m2", "m3")


def _difference(f: str, axis: int, h: Column, block: list[str]) -> Column:
    """(next - previous) / 2h along an axis; null where either is missing."""
    others = [x for a, x in enumerate(AXES) if a != axis]
    w = Window.partitionBy(*block, *others).orderBy(AXES[axis])
    return (F.lead(f).over(w) - F.lag(f).over(w)) / (2 * h)


def curl(cells: DataFrame, fields: tuple[str, str, str], h: list[Column], out: tuple[str, str, str], block: list[str]) -> DataFrame:
    """cells with the curl of three fields, null on the outermost layer."""
    d = lambda f, a: _difference(fields[f], a, h[a], block)
    return cells.withColumns({out[0]: d(2, 1) - d(1, 2), out[1]: d(0, 2) - d(2, 0), out[2]: d(1, 0) - d(0, 1)})


def divergence(cells: DataFrame, fields: tuple[str, str, str], h: list[Column], out: str, block: list[str]) -> DataFrame:
    return cells.withColumn(out, sum((_difference(f, a, h[a], block) for a, f in enumerate(fields)), F.lit(0.0)))


def current(mesh: Mesh, ghosted: DataFrame, fields: tuple[str, str, str] = B) -> DataFrame:
    """(igrid, level, i, j, k, ghost, j1, j2, j3): curl of the magnetic field on all but the outermost ghost layer."""
    mesh.need(*fields)
    dealt = ghosted.repartition("igrid")
    out = curl(dealt, fields, [mesh.spacing(a) for a in range(3)], ("j1", "j2", "j3"), ["igrid"])
    return out.select("igrid", *KEY, "ghost", "j1", "j2", "j3").where("j1 IS NOT NULL AND j2 IS NOT NULL AND j3 IS NOT NULL")


def momentum_divergence(mesh: Mesh, ghosted: DataFrame) -> DataFrame:
    """(igrid, level, i, j, k, ghost, div_m): divergence of the momentum, not of the velocity."""
    mesh.need(*M)
    out = divergence(ghosted.repartition("igrid"), M, [mesh.spacing(a) for a in range(3)], "div_m", ["igrid"])
    return out.select("igrid", *KEY, "ghost", "div_m").where("div_m IS NOT NULL")


def curl_slab(slab: DataFrame, fields: tuple[str, str, str], dx: tuple[float, float, float], out: tuple[str, str, str]) -> DataFrame:
    """Curl on a uniform slab (i, j, k, fields), edges dropped.

    Neighbours meet by address instead of whole lines meeting in a task: each point goes to the six points next to it,
    and a point that hears from all six has a curl.
    """
    steps = F.array(
        *[
            F.struct(*[F.lit(s if a == axis else 0).alias(f"d{x}") for a, x in enumerate(AXES)], F.lit(axis).alias("axis"), F.lit(-s).alias("side"))
            for axis in range(3)
            for s in (-1, 1)
        ]
    )
    sent = slab.select(*AXES, *fields, F.explode(steps).alias("s"))
    sent = sent.select(*[(F.col(x) + F.col(f"s.d{x}")).alias(x) for x in AXES], "s.axis", "s.side", *fields)
    d = lambda f, a: F.sum(F.when(F.col("axis") == a, F.col("side") * F.col(fields[f]))) / (2 * dx[a])
    met = sent.groupBy(*AXES).agg(
        F.count(F.lit(1)).alias("__n"), (d(2, 1) - d(1, 2)).alias(out[0]), (d(0, 2) - d(2, 0)).alias(out[1]), (d(1, 0) - d(0, 1)).alias(out[2])
    )
    return met.where("__n = 6").select(*AXES, *out)
