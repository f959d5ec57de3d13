"""Analytic magnetic-field models as column expressions over points (x, y, z)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.calculus import curl_slab
from ..operators.mesh import uniform_points

#: Axis points, or sources, that a plan carries as literals; more come in as a table.
CROSS_LIMIT = 100_000


def _xyz() -> tuple[Column, Column, Column]:
    return F.col("x"), F.col("y"), F.col("z")


def bipolar_a(q: float, length: float, depth: float) -> dict[str, Column]:
    """Vector potential of two opposite charges at (+-length, 0, -depth)."""
    x, y, z = _xyz()
    rho2 = y * y + (z + depth) * (z + depth)
    a = q * (x - length) / F.sqrt(rho2 + (x - length) * (x - length)) - q * (x + length) / F.sqrt(rho2 + (x + length) * (x + length))
    return {"a1": F.lit(0.0), "a2": -a * (z + depth) / rho2, "a3": a * y / rho2}


def bipolar_b(length: float, depth: float) -> dict[str, Column]:
    """Field of two unit charges at (-+length, 0, -depth); it does not scale with a charge."""
    x, y, z = _xyz()
    zd = z + depth

    def pull(at: float) -> list[Column]:
        dx = x - at
        r3 = F.pow(F.sqrt(dx * dx + y * y + zd * zd), F.lit(3.0))
        return [dx / r3, y / r3, zd / r3]

    return {f"b{n + 1}": p - m for n, (p, m) in enumerate(zip(pull(-length), pull(length), strict=True))}


def _from(at: tuple) -> tuple[Column, Column, Column, Column]:
    d = [c - (p if isinstance(p, Column) else F.lit(float(p))) for c, p in zip(_xyz(), at, strict=True)]
    return *d, F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])


def dipolez_a(mz: float | Column, at: tuple) -> dict[str, Column]:
    """Vector potential of a dipole along z."""
    dx, dy, _, r = _from(at)
    mz = mz if isinstance(mz, Column) else F.lit(float(mz))
    return {"a1": -mz * dy / F.pow(r, F.lit(3.0)), "a2": mz * dx / F.pow(r, F.lit(3.0)), "a3": F.lit(0.0)}


def dipole_b(m: tuple, at: tuple) -> dict[str, Column]:
    dx, dy, dz, r = _from(at)
    m = [x if isinstance(x, Column) else F.lit(float(x)) for x in m]
    dot = m[0] * dx + m[1] * dy + m[2] * dz
    return {f"b{n + 1}": 3 * d * dot / F.pow(r, F.lit(5.0)) - mn / F.pow(r, F.lit(3.0)) for n, (d, mn) in enumerate(zip((dx, dy, dz), m, strict=True))}


def monopole_b(q: float, at: tuple) -> dict[str, Column]:
    dx, dy, dz, r = _from(at)
    return {f"b{n + 1}": q * d / F.pow(r, F.lit(3.0)) for n, d in enumerate((dx, dy, dz))}


def _with_sources(points: DataFrame, sources: DataFrame) -> DataFrame:
    """Every point with every source: the definition of a superposed field. The smaller list, the sources, is
    broadcast only when its count stays below CROSS_LIMIT; a longer one is spread by Spark."""
    few = sources.limit(CROSS_LIMIT + 1).count() <= CROSS_LIMIT
    return points.crossJoin(F.broadcast(sources) if few else sources)


def superposed(points: DataFrame, sources: DataFrame, key: list[str], parts: dict[str, Column]) -> DataFrame:
    """Sum over all sources (sx, sy, sz, ..) of the parts; points keep their key. Partial sums stay where points are."""
    met = _with_sources(points.select(*key, "x", "y", "z"), sources)
    return met.groupBy(*key).agg(*[F.sum(c).alias(n) for n, c in parts.items()])


def fan_a(points: DataFrame, sources: DataFrame, key: list[str]) -> DataFrame:
    return superposed(points, sources, key, dipolez_a(F.col("m3"), (F.col("sx"), F.col("sy"), F.col("sz"))))


def fan_b(points: DataFrame, sources: DataFrame, key: list[str]) -> DataFrame:
    return superposed(points, sources, key, dipole_b((F.col("m1"), F.col("m2"), F.col("m3")), (F.col("sx"), F.col("sy"), F.col("sz"))))


def fan_slab(sources: DataFrame, xmin: tuple, xmax: tuple, n: tuple) -> DataFrame:
    return fan_b(uniform_points(sources.sparkSession, xmin, xmax, n), sources, ["p", "q", "r"])


def ring_axis(spark: SparkSession, centre: tuple, r0: float, n: int, sign: float) -> DataFrame:
    """(m, ax, ay, az, tx, ty, tz): points of a closed ring in the y-z plane and half the step between a point's
    neighbours. The neighbours follow from the ring's formula, so no row needs another."""
    at = lambda m: 2 * math.pi * m / n
    y = lambda m: F.lit(centre[1]) + F.lit(r0) * F.sin(at(m)) * F.lit(sign)
    z = lambda m: F.lit(centre[2]) + F.lit(r0) * F.cos(at(m))
    m = F.col("id").cast("double")
    before, after = F.pmod(m - 1, F.lit(float(n))), F.pmod(m + 1, F.lit(float(n)))
    return spark.range(n).select(
        F.col("id").alias("m"), F.lit(float(centre[0])).alias("ax"), y(m).alias("ay"), z(m).alias("az"),
        F.lit(0.0).alias("tx"), (0.5 * (y(after) - y(before))).alias("ty"), (0.5 * (z(after) - z(before))).alias("tz"),
    )


def rbsl_a(points: DataFrame, axis: DataFrame, a: float, flux: float, key: list[str]) -> DataFrame:
    """Potential (a1, a2, a3) of a regularised flux rope of core radius a along an axis of points with tangents.

    Within the core the kernels are smooth, outside they are those of a line. A point that lies exactly on an axis point
    has no kernel value (0/0), as the formula says; keep grids off the axis.
    """
    met = _with_sources(points.select(*key, "x", "y", "z"), axis)
    d = [(F.col(c) - F.col(f"a{c}")) / a for c in "xyz"]
    met = met.withColumns({"__dx": d[0], "__dy": d[1], "__dz": d[2]})
    met = met.withColumn("__r", F.sqrt(F.col("__dx") * F.col("__dx") + F.col("__dy") * F.col("__dy") + F.col("__dz") * F.col("__dz")))
    r, pi = F.col("__r"), math.pi
    r2 = r * r
    root = F.sqrt(F.greatest(F.lit(0.0), 1 - r2))
    arc = F.asin(F.least(F.lit(1.0), r)) / r
    inner_i = 2 / pi * (arc + (5 - 2 * r2) / 3 * root)
    tail = (5 - 2 * r2) * 0.5 / math.sqrt(6.0) * (1 - 2 / pi * F.asin(F.least(F.lit(1.0), (1 + 2 * r2) / (5 - 2 * r2))))
    inner_f = 2 / pi / r2 * (arc - root + 2 / pi * root + tail)
    met = met.withColumns({"__ki": F.when(r <= 1, inner_i).otherwise(1 / r), "__kf": F.when(r <= 1, inner_f).otherwise(1 / (r * r2))})
    t, v = [F.col(f"t{c}") for c in "xyz"], [F.col(f"__d{c}") for c in "xyz"]
    cross = [t[1] * v[2] - t[2] * v[1], t[2] * v[0] - t[0] * v[2], t[0] * v[1] - t[1] * v[0]]
    amp = flux * 5 * math.sqrt(2.0) / 3 / a
    part = [amp / (4 * pi) * F.col("__ki") * t[n] / a + flux / (4 * pi) * F.col("__kf") * cross[n] / (a * a) for n in range(3)]
    return met.groupBy(*key).agg(*[F.sum(p).alias(f"a{n + 1}") for n, p in enumerate(part)])


def rope_flux(r0: float, a0: float, q0: float, l0: float, balance: float = 1.0) -> float:
    """Flux that balances the rope in the overlying field of two charges; r0 must exceed l0."""
    if r0 <= l0:
        raise ValueError("r0 must be larger than l0")
    over = q0 * l0 * ((r0 * r0 + l0 * l0) ** -1.5 + (r0 * r0 - l0 * l0) ** -1.5)
    amp = balance * r0 * over / (math.log(8 * r0 / a0) - 1)
    return 4 * math.pi * 0.6 / math.sqrt(2.0) * amp * a0


def tdm_slab(
    spark: SparkSession, xmin: tuple, xmax: tuple, n: tuple, r0: float, a0: float, n_axis: int, q0: float, l0: float, d0: float, balance: float = 1.0
) -> DataFrame:
    """(i, j, k, b1, b2, b3): flux rope and overlying field on a slab's cell centres, the rope's as the curl of its
    potential on the slab and one layer around it."""
    flux = rope_flux(r0, a0, q0, l0, balance)
    d = [(hi - lo) / m for lo, hi, m in zip(xmin, xmax, n, strict=True)]
    axis = ring_axis(spark, ((xmin[0] + xmax[0]) / 2, (xmin[1] + xmax[1]) / 2, -d0), r0, n_axis, math.copysign(1.0, flux))
    wide = uniform_points(spark, tuple(a - s for a, s in zip(xmin, d, strict=True)), tuple(b + s for b, s in zip(xmax, d, strict=True)), tuple(m + 2 for m in n))
    wide = wide.select(*[(F.col(p) - 1).alias(x) for p, x in zip("pqr", "ijk", strict=True)], "x", "y", "z")
    rope = curl_slab(rbsl_a(wide, axis, a0, flux, ["i", "j", "k"]), ("a1", "a2", "a3"), tuple(d), ("r1", "r2", "r3"))
    over = wide.withColumns(bipolar_b(l0, d0)).select("i", "j", "k", "b1", "b2", "b3")
    met = over.join(rope, ["i", "j", "k"])
    return met.select("i", "j", "k", *[(F.col(f"b{c}") + F.col(f"r{c}")).alias(f"b{c}") for c in (1, 2, 3)])

