"""Meshes made from the driver's tables, and the same relations as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import morton3  # noqa: F401  (re-exported for queries)
from ..operators import forest
from ..operators.mesh import BLOCK, Mesh

FIELDS = ("rho", "m1", "m2", "m3", "b1", "b2", "b3")
N, NX = 16, 8
ROOTS = (2, 2, 2)
#: Pre-order bits: root 1 refined; and a nested forest.
REFINED_BITS = (1, 0, *[1] * 14)
NESTED_BITS = (1, 0, 1, 0, *[1] * 8, *[1] * 6, *[1] * 6)
SLAB = ((-3.75, -3.25, 0.125), (4.25, 4.75, 8.125), (6, 6, 6))
BOX = ((2.0, 2.0, 2.0), (14.0, 14.0, 14.0), (24, 24, 24))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bits(spark: SparkSession, which: tuple[int, ...]) -> DataFrame:
    leaf = F.array(*[F.lit(bool(b)) for b in which])
    return spark.range(1).select(F.posexplode(leaf).alias("pos", "is_leaf"))


def _aggregates() -> list[Column]:
    flag = lambda c, v: F.sum(F.when(F.col(c) == v, 1.0).otherwise(0.0))
    return [
        F.count(F.lit(1)).cast("double").alias("rho"),
        F.sum("l_quantity").alias("m1"),
        F.sum(F.col("l_linenumber").cast("double")).alias("m2"),
        flag("l_returnflag", "R").alias("m3"),
        F.sum(F.col("l_quantity") * F.col("l_linenumber")).alias("b1"),
        flag("l_returnflag", "A").alias("b2"),
        flag("l_linestatus", "F").alias("b3"),
    ]


def _grid(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n**3).select(F.expr(f"id div {n * n}").alias("i"), F.expr(f"(id div {n}) % {n}").alias("j"), (F.col("id") % n).alias("k"))


def _cells(spark: SparkSession, sf_dir: str, n: int, level: int) -> DataFrame:
    item = table(spark, sf_dir, "lineitem")
    keys = [(F.col("l_partkey") % n).alias("gi"), ((F.col("l_suppkey") * 7 + F.col("l_linenumber")) % n).alias("gj"), (F.col("l_orderkey") % n).alias("gk")]
    sums = item.groupBy(*keys).agg(*_aggregates())
    grid = _grid(spark, n)
    on = (F.col("i") == F.col("gi")) & (F.col("j") == F.col("gj")) & (F.col("k") == F.col("gk"))
    return grid.join(sums, on, "left").select(F.lit(level).alias("level"), "i", "j", "k", *[F.coalesce(f, F.lit(0.0)).alias(f) for f in FIELDS])


def uniform_mesh(spark: SparkSession, sf_dir: str) -> Mesh:
    blocks = forest.uniform_forest(spark, ROOTS)
    return Mesh((N,) * 3, (NX,) * 3, (0.0,) * 3, (16.0,) * 3, FIELDS, blocks, _cells(spark, sf_dir, N, 1))


def refined_mesh(spark: SparkSession, sf_dir: str) -> Mesh:
    coarse = _cells(spark, sf_dir, N, 1).where("NOT (i >= 8 AND j < 8 AND k < 8)")
    fine = _cells(spark, sf_dir, 2 * N, 2).where("i >= 16 AND j < 16 AND k < 16")
    blocks = forest.mesh_blocks(spark, bits(spark, REFINED_BITS), ROOTS)
    return Mesh((N,) * 3, (NX,) * 3, (0.0,) * 3, (16.0,) * 3, FIELDS, blocks, coarse.unionByName(fine))


def points(spark: SparkSession, sf_dir: str, shift: float = 0.125) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("pid"),
        ((F.col("event_id") % 64) / 4.0 + shift).alias("x"),
        (((F.col("event_id") * 7 + 3) % 64) / 4.0 + shift).alias("y"),
        ((F.col("user_id") % 64) / 4.0 + shift).alias("z"),
    )


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One source a vector: positions below the points' grid, so that no distance is zero."""
    v = table(spark, sf_dir, "embeddings")
    at = lambda n: F.col("embedding")[n].cast("double")
    return v.select(
        F.col("vec_id").alias("sid"), (at(0) * 4).alias("sx"), (at(1) * 4).alias("sy"), (-20.0 - F.abs(at(2))).alias("sz"),
        at(3).alias("m1"), at(4).alias("m2"), at(5).alias("m3"),
    )


# The same relations in DuckDB's SQL, as named common table expressions.

_MORTON = "list_sum(list_transform(range(21), lambda t: ((({0}) >> t::INT) & 1) << (3 * t)::INT))::BIGINT"


def morton_sql(a: str, b: str, c: str) -> str:
    spread = lambda e, s: f"list_sum(list_transform(range(20), lambda t: ((({e}) >> t::INT) & 1) << (3 * t + {s})::INT))::BIGINT"
    return f"({spread(a, 0)} + {spread(b, 1)} + {spread(c, 2)})"


def order_cte(ng: tuple[int, int, int] = ROOTS, low: tuple = (0, 0, 0), name: str = "ord") -> str:
    m = morton_sql("a.r", "b.r", "c.r")
    return f"""{name} AS (
  SELECT a.r + {low[0]} AS b1, b.r + {low[1]} AS b2, c.r + {low[2]} AS b3, {m} AS morton, row_number() OVER (ORDER BY {m}) - 1 AS sfc
  FROM range({ng[0]}) a(r), range({ng[1]}) b(r), range({ng[2]}) c(r))"""


def nodes_cte(which: tuple[int, ...], ng: tuple[int, int, int] = ROOTS) -> str:
    """`nodes` (pos, is_leaf, root, igrid, level, parent, b1, b2, b3); needs WITH RECURSIVE."""
    return f"""{order_cte(ng)},
bits AS (SELECT unnest(range({len(which)})) AS pos, unnest({[bool(b) for b in which]}::BOOLEAN[]) AS is_leaf),
walk AS (SELECT *, sum(CASE WHEN is_leaf THEN -1 ELSE 7 END) OVER (ORDER BY pos) AS s FROM bits),
ends AS (SELECT p.pos, min(k.pos) AS e FROM walk p JOIN walk k ON k.pos > p.pos AND k.s = p.s - 8 WHERE NOT p.is_leaf GROUP BY p.pos),
lev AS (SELECT w.pos, w.is_leaf, (1 + count(e.pos))::INT AS level, max(e.pos) AS parent FROM walk w LEFT JOIN ends e ON e.pos < w.pos AND w.pos <= e.e GROUP BY w.pos, w.is_leaf),
slots AS (SELECT *, row_number() OVER (PARTITION BY parent ORDER BY pos) - 1 AS slot, sum(CASE WHEN level = 1 THEN 1 ELSE 0 END) OVER (ORDER BY pos)::BIGINT - 1 AS root,
  CASE WHEN is_leaf THEN sum(is_leaf::INT) OVER (ORDER BY pos) ELSE -1 END::BIGINT AS igrid FROM lev),
nodes AS (
  SELECT s.pos, s.is_leaf, s.root, s.igrid, s.level, s.parent, o.b1, o.b2, o.b3 FROM slots s JOIN ord o ON s.level = 1 AND o.sfc = s.root
  UNION ALL
  SELECT s.pos, s.is_leaf, s.root, s.igrid, s.level, s.parent, 2 * n.b1 + (s.slot & 1), 2 * n.b2 + ((s.slot >> 1) & 1), 2 * n.b3 + ((s.slot >> 2) & 1)
  FROM slots s JOIN nodes n ON s.parent = n.pos)"""


def cells_sql(n: int, level: int, where: str = "true") -> str:
    return f"""SELECT {level} AS level, a.r AS i, b.r AS j, c.r AS k, {", ".join(f"coalesce(g.{f}, 0.0)::DOUBLE AS {f}" for f in FIELDS)}
  FROM range({n}) a(r) CROSS JOIN range({n}) b(r) CROSS JOIN range({n}) c(r) LEFT JOIN (
    SELECT l_partkey % {n} AS i, (l_suppkey * 7 + l_linenumber) % {n} AS j, l_orderkey % {n} AS k, count(*)::DOUBLE AS rho, sum(l_quantity) AS m1,
           sum(l_linenumber)::DOUBLE AS m2, sum((l_returnflag = 'R')::INT)::DOUBLE AS m3, sum(l_quantity * l_linenumber) AS b1,
           sum((l_returnflag = 'A')::INT)::DOUBLE AS b2, sum((l_linestatus = 'F')::INT)::DOUBLE AS b3
    FROM lineitem GROUP BY ALL) g ON g.i = a.r AND g.j = b.r AND g.k = c.r WHERE {where}"""


def uniform_cte() -> str:
    return f"""{order_cte()},
nodes AS (SELECT sfc + 1 AS igrid, 1 AS level, b1, b2, b3, true AS is_leaf, sfc AS root FROM ord),
cells AS ({cells_sql(N, 1)})"""


def refined_cte() -> str:
    return f"""{nodes_cte(REFINED_BITS)},
cells AS ({cells_sql(N, 1, "NOT (a.r >= 8 AND b.r < 8 AND c.r < 8)")} UNION ALL {cells_sql(2 * N, 2, "a.r >= 16 AND b.r < 16 AND c.r < 16")})"""


def points_cte(shift: float = 0.125) -> str:
    return f"pts AS (SELECT event_id AS pid, (event_id % 64) / 4.0::DOUBLE + {shift} AS x, ((event_id * 7 + 3) % 64) / 4.0::DOUBLE + {shift} AS y, (user_id % 64) / 4.0::DOUBLE + {shift} AS z FROM events)"


def sources_cte() -> str:
    return (
        "src AS (SELECT vec_id AS sid, embedding[1]::DOUBLE * 4 AS sx, embedding[2]::DOUBLE * 4 AS sy, -20.0 - abs(embedding[3]::DOUBLE) AS sz,"
        " embedding[4]::DOUBLE AS m1, embedding[5]::DOUBLE AS m2, embedding[6]::DOUBLE AS m3 FROM embeddings)"
    )


def grid_cte(box: tuple, name: str = "grid") -> str:
    lo, hi, n = box
    axis = lambda a, v: f"{float(lo[a])}::DOUBLE + ({v} + 0.5::DOUBLE) * {(hi[a] - lo[a]) / n[a]!r}::DOUBLE"
    return f"{name} AS (SELECT a.r AS p, b.r AS q, c.r AS r, {axis(0, 'a.r')} AS x, {axis(1, 'b.r')} AS y, {axis(2, 'c.r')} AS z FROM range({n[0]}) a(r), range({n[1]}) b(r), range({n[2]}) c(r))"


def view_cte() -> str:
    fs = ", ".join(FIELDS)
    return f"""restricted AS (SELECT level - 1 AS level, i >> 1 AS i, j >> 1 AS j, k >> 1 AS k, {", ".join(f"sum({f}) / 8 AS {f}" for f in FIELDS)} FROM cells WHERE level > 1 GROUP BY ALL),
v AS (SELECT level, i, j, k, {fs} FROM cells UNION ALL SELECT level, i, j, k, {fs} FROM restricted)"""


def ghosts_cte(depth: int = 2) -> str:
    """addr, near, slopes, ghosts and ghosted over nodes, cells and v."""
    g = range(-depth, NX + depth)
    lo, hi = g[0], g[-1] + 1
    n = "16 * (1 << (level - 1))"
    fs = ", ".join(f"v.{f}" for f in FIELDS)
    c = lambda x, shift=0: f"greatest(0, least({n} - 1, {x} + {shift}))"
    mm = lambda a, m, b: f"(sign(({b} - {a}) / 2) * greatest(0.0, least(abs(({b} - {a}) / 2), sign(({b} - {a}) / 2) * ({m} - {a}), sign(({b} - {a}) / 2) * ({b} - {m}))))"
    slope = ", ".join(f"m_{f} AS {f}, " + ", ".join(f"{mm(f'{a}l_{f}', f'm_{f}', f'{a}r_{f}')} AS {f}_s{a}" for a in "xyz") for f in FIELDS)
    roles = [("m", (0, 0, 0)), ("xl", (-1, 0, 0)), ("xr", (1, 0, 0)), ("yl", (0, -1, 0)), ("yr", (0, 1, 0)), ("zl", (0, 0, -1)), ("zr", (0, 0, 1))]
    values = ", ".join("('{}', {}, {}, {})".format(r, *d) for r, d in roles)
    picked = ", ".join(f"max(CASE WHEN role = '{r}' THEN v.{f} END) AS {r}_{f}" for f in FIELDS for r, _ in roles)
    to = ", ".join(f"greatest(0, least({n} - 1, w.{x} + r.d{x})) AS t{x}" for x in "ijk")
    eta = lambda x: f"CASE WHEN f.c{x} % 2 = 0 THEN -0.25 ELSE 0.25 END"
    return f"""addr AS (
  SELECT igrid, level, i, j, k, {c("i")} AS ci, {c("j")} AS cj, {c("k")} AS ck FROM (
    SELECT igrid, level, b1 * 8 + a.r AS i, b2 * 8 + b.r AS j, b3 * 8 + c.r AS k, a.r BETWEEN 0 AND 7 AND b.r BETWEEN 0 AND 7 AND c.r BETWEEN 0 AND 7 AS own
    FROM nodes CROSS JOIN range({lo}, {hi}) a(r) CROSS JOIN range({lo}, {hi}) b(r) CROSS JOIN range({lo}, {hi}) c(r) WHERE is_leaf) WHERE NOT own),
near AS (SELECT a.igrid, a.level, a.i, a.j, a.k, {fs} FROM addr a JOIN v ON v.level = a.level AND v.i = a.ci AND v.j = a.cj AND v.k = a.ck),
far AS (SELECT a.* FROM addr a ANTI JOIN v ON v.level = a.level AND v.i = a.ci AND v.j = a.cj AND v.k = a.ck),
wanted AS (SELECT DISTINCT level - 1 AS level, ci >> 1 AS i, cj >> 1 AS j, ck >> 1 AS k FROM far),
spread AS (SELECT w.*, r.role, {to} FROM wanted w CROSS JOIN (VALUES {values}) r(role, di, dj, dk)),
picked AS (SELECT s.level, s.i, s.j, s.k, {picked} FROM spread s JOIN v ON v.level = s.level AND v.i = s.ti AND v.j = s.tj AND v.k = s.tk GROUP BY s.level, s.i, s.j, s.k),
slopes AS (SELECT level, i, j, k, {slope} FROM picked),
prolonged AS (SELECT f.igrid, f.level, f.i, f.j, f.k, {", ".join(f"s.{x} + s.{x}_sx * {eta('i')} + s.{x}_sy * {eta('j')} + s.{x}_sz * {eta('k')} AS {x}" for x in FIELDS)}
  FROM far f JOIN slopes s ON s.level = f.level - 1 AND s.i = f.ci >> 1 AND s.j = f.cj >> 1 AND s.k = f.ck >> 1),
ghosts AS (SELECT * FROM near UNION ALL SELECT * FROM prolonged),
own AS (SELECT n.igrid, c.level, c.i, c.j, c.k, {", ".join(f"c.{f}" for f in FIELDS)} FROM cells c JOIN nodes n ON n.is_leaf AND n.level = c.level AND n.b1 = c.i // 8 AND n.b2 = c.j // 8 AND n.b3 = c.k // 8),
ghosted AS (SELECT *, false AS ghost FROM own UNION ALL SELECT *, true AS ghost FROM ghosts)"""
