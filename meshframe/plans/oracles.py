"""Each query as DuckDB SQL over the same tables."""

from __future__ import annotations

import math

from . import fixtures as X
from .fixtures import FIELDS, ROOTS
from .queries import CROP, N_AXIS, ORDER_NG

FS = ", ".join(FIELDS)
L = "level::BIGINT AS level"


def _with(*parts: str, sql: str) -> str:
    return f"WITH RECURSIVE {', '.join(parts)}\n{sql}"


NODES = X.nodes_cte(X.REFINED_BITS)
NESTED = X.nodes_cte(X.NESTED_BITS)
REFINED = (X.refined_cte(), X.view_cte())
GHOSTED = (*REFINED, X.ghosts_cte())
POINTS = X.points_cte()
SPAN = "(1 << (l.level - 1))"
STEPS = "d(d1) CROSS JOIN (SELECT unnest([-1, 0, 1])::BIGINT) e(d2) CROSS JOIN (SELECT unnest([-1, 0, 1])::BIGINT) f(d3)"


def neighbors_cte(faces: bool = False, nodes: str = "nodes", roots: tuple[int, ...] = ROOTS) -> str:
    some = "abs(d1) + abs(d2) + abs(d3) = 1" if faces else "abs(d1) + abs(d2) + abs(d3) > 0"
    inside = " AND ".join(f"b{a} + d{a} BETWEEN 0 AND {roots[a - 1]} * {SPAN} - 1" for a in (1, 2, 3))
    same = " AND ".join(f"s.b{a} = l.b{a} + d{a}" for a in (1, 2, 3))
    up = " AND ".join(f"c.b{a} = (l.b{a} + d{a}) >> 1" for a in (1, 2, 3))
    return f"""nbrs AS (
  SELECT l.igrid, l.level, d1, d2, d3, l.b1 + d1 AS t1, l.b2 + d2 AS t2, l.b3 + d3 AS t3,
         CASE WHEN NOT ({inside.replace("b1 +", "l.b1 +").replace("b2 +", "l.b2 +").replace("b3 +", "l.b3 +")}) THEN 1 WHEN s.is_leaf THEN 3 WHEN NOT s.is_leaf THEN 4 WHEN c.igrid IS NOT NULL THEN 2 ELSE 1 END::BIGINT AS ntype,
         CASE WHEN s.is_leaf THEN s.igrid WHEN s.is_leaf IS NULL THEN coalesce(c.igrid, 0) ELSE 0 END AS nbr
  FROM {nodes} l CROSS JOIN (SELECT unnest([-1, 0, 1])::BIGINT) {STEPS}
  LEFT JOIN {nodes} s ON s.level = l.level AND {same} LEFT JOIN {nodes} c ON c.is_leaf AND c.level = l.level - 1 AND {up}
  WHERE l.is_leaf AND {some})"""


def _in_crop(level: str = "level") -> str:
    return " AND ".join(f"(b{a + 1} >> ({level} - 1)) BETWEEN {lo} AND {hi - 1}" for a, (lo, hi) in enumerate(CROP))


CROP_NG = tuple(b - a for a, b in CROP)
CROP_TREE = f"""{X.order_cte(CROP_NG, tuple(a for a, _ in CROP), "newroots")},
cropped AS (
  SELECT row_number() OVER (ORDER BY o.sfc, n.igrid) AS igrid, n.level::BIGINT AS level, {", ".join(f"n.b{a + 1} - {lo} * (1 << (n.level - 1)) AS b{a + 1}" for a, (lo, _) in enumerate(CROP))}, n.igrid AS old_igrid, o.sfc
  FROM nodes n JOIN newroots o ON {" AND ".join(f"n.b{a} >> (n.level - 1) = o.b{a}" for a in (1, 2, 3))} WHERE n.is_leaf)"""


CROP_NODES = f"""cnodes AS (
  SELECT coalesce(c.igrid, -1) AS igrid, n.level, {", ".join(f"n.b{a + 1} - {lo} * (1 << (n.level - 1)) AS b{a + 1}" for a, (lo, _) in enumerate(CROP))}, n.is_leaf
  FROM (SELECT * FROM nodes WHERE {_in_crop()}) n LEFT JOIN cropped c ON n.is_leaf AND c.old_igrid = n.igrid)"""


def children_sql(nodes: str = "nodes") -> str:
    return f"""SELECT n.igrid, CASE d1 WHEN -1 THEN 0 WHEN 1 THEN 3 ELSE 1 + (c.b1 & 1) END AS c1, CASE d2 WHEN -1 THEN 0 WHEN 1 THEN 3 ELSE 1 + (c.b2 & 1) END AS c2,
       CASE d3 WHEN -1 THEN 0 WHEN 1 THEN 3 ELSE 1 + (c.b3 & 1) END AS c3, c.igrid AS nbr
FROM nbrs n JOIN {nodes} c ON c.is_leaf AND c.level = n.level + 1 AND c.b1 >> 1 = t1 AND c.b2 >> 1 = t2 AND c.b3 >> 1 = t3
 AND (d1 = 0 OR c.b1 & 1 = CASE d1 WHEN -1 THEN 1 ELSE 0 END) AND (d2 = 0 OR c.b2 & 1 = CASE d2 WHEN -1 THEN 1 ELSE 0 END) AND (d3 = 0 OR c.b3 & 1 = CASE d3 WHEN -1 THEN 1 ELSE 0 END)
WHERE ntype = 4"""


def _located(shift: float) -> str:
    box = " AND ".join(f"{x} BETWEEN n.b{a} * (8.0 / (1 << (n.level - 1))) AND (n.b{a} + 1) * (8.0 / (1 << (n.level - 1)))" for a, x in ((1, "x"), (2, "y"), (3, "z")))
    return f"""{X.points_cte(shift)},
loc AS (SELECT pid, x, y, z, igrid, level, b1, b2, b3 FROM (
  SELECT p.*, n.igrid, n.level, n.b1, n.b2, n.b3, row_number() OVER (PARTITION BY pid ORDER BY n.igrid) AS rn FROM pts p JOIN nodes n ON n.is_leaf AND {box}) WHERE rn = 1),
cell AS (SELECT pid, level, {", ".join(f"greatest(b{a} * 8, least(floor({x} * (1 << (level - 1)))::BIGINT, b{a} * 8 + 7)) AS {i}" for a, x, i in ((1, "x", "i"), (2, "y", "j"), (3, "z", "k")))} FROM loc)"""


def _corners(source: str, keys: str) -> str:
    """`corner` with the eight corners of each row of source (x, y, z, level)."""
    at = lambda x: f"({x} * (1 << (level - 1)) - 0.5)"
    return f"""corner AS (
  SELECT {keys}, level, {", ".join(f"floor({at(x)})::BIGINT + d.{i} AS {i}" for x, i in zip("xyz", "ijk", strict=True))},
         {" * ".join(f"CASE WHEN d.{i} = 1 THEN {at(x)} - floor({at(x)}) ELSE 1 - ({at(x)} - floor({at(x)})) END" for x, i in zip("xyz", "ijk", strict=True))} AS w
  FROM {source} CROSS JOIN (SELECT a.r AS i, b.r AS j, c.r AS k FROM range(2) a(r), range(2) b(r), range(2) c(r)) d)"""


def _resample(values: str, names: list[str], points: str = "pt") -> str:
    lo, hi, n = X.BOX
    step = [(b - a) / m for a, b, m in zip(lo, hi, n, strict=True)]
    own = " AND ".join(
        f"{p} >= round_even((l.b{a} * (8.0 / {SPAN}) - {lo[a - 1]}) / {step[a - 1]}, 0) AND {p} < floor(((l.b{a} + 1) * (8.0 / {SPAN}) - {lo[a - 1]}) / {step[a - 1]} + 0.5)"
        for a, p in ((1, "p"), (2, "q"), (3, "r"))
    )
    return f"""{X.grid_cte(X.BOX)},
owned AS (SELECT p, q, r, x, y, z, igrid, level FROM (SELECT g.*, l.igrid, l.level, row_number() OVER (PARTITION BY p, q, r ORDER BY l.igrid DESC) AS rn
  FROM grid g JOIN nodes l ON l.is_leaf AND {own}) WHERE rn = 1),
{_corners("owned", "p, q, r, igrid")},
got AS (SELECT p, q, r, {", ".join(f"sum(w * g.{f}) AS {f}" for f in names)} FROM corner c JOIN {values} g ON g.igrid = c.igrid AND g.i = c.i AND g.j = c.j AND g.k = c.k GROUP BY p, q, r),
res AS (SELECT g.p, g.q, g.r, {", ".join(f"coalesce(o.{f}, 0.0) AS {f}" for f in names)} FROM grid g LEFT JOIN got o ON g.p = o.p AND g.q = o.q AND g.r = o.r)"""


def _stencil(table: str, fields: list[str], block: str = "") -> str:
    """`sten`: each row of a table with the next and the previous value of each field along each axis."""
    cols = []
    for x in "ijk":
        others = [y for y in "ijk" if y != x]
        w = f"(PARTITION BY {', '.join([block] * bool(block) + others)} ORDER BY {x})"
        cols += [f"{f}({c}) OVER {w} AS {x}{s}_{c}" for c in fields for f, s in (("lead", "r"), ("lag", "l"))]
    return f"sten AS (SELECT *, {', '.join(cols)} FROM {table})"


def _curl(fields: list[str], h: tuple[str, str, str]) -> str:
    d = lambda n, x: f"({x}r_{fields[n]} - {x}l_{fields[n]}) / {h['ijk'.index(x)]}"
    return f"{d(2, 'j')} - {d(1, 'k')} AS j1, {d(0, 'k')} - {d(2, 'i')} AS j2, {d(1, 'i')} - {d(0, 'j')} AS j3"


_H = "(2 * (1.0::DOUBLE / (1 << (level - 1))))"
_B = ["b1", "b2", "b3"]
CURRENT = f"""{_stencil("ghosted", _B, "igrid")},
current AS (SELECT * FROM (SELECT igrid, level, i, j, k, ghost, {_curl(_B, (_H,) * 3)} FROM sten) WHERE j1 IS NOT NULL AND j2 IS NOT NULL AND j3 IS NOT NULL)"""
DIV = " + ".join(f"({x}r_m{n} - {x}l_m{n}) / {_H}" for n, x in ((1, "i"), (2, "j"), (3, "k")))


def _r(cols: dict[str, str]) -> str:
    return ", ".join(f"round({e}, 9) + 0.0 AS {n}" for n, e in cols.items())


def _bip_b(length: float, d: float) -> dict[str, str]:
    r3 = lambda at: f"pow(sqrt((x - {at}) * (x - {at}) + y * y + (z + {d}) * (z + {d})), 3.0)"
    top = {"b1": ("(x - {0})"), "b2": "y", "b3": f"(z + {d})"}
    return {n: f"{t.format(f'({-length})')} / {r3(f'({-length})')} - {t.format(length)} / {r3(length)}" for n, t in top.items()}


def _bip_a(q: float, length: float, d: float) -> dict[str, str]:
    rho = f"(y * y + (z + {d}) * (z + {d}))"
    a = f"({q} * (x - {length}) / sqrt({rho} + (x - {length}) * (x - {length})) - {q} * (x + {length}) / sqrt({rho} + (x + {length}) * (x + {length})))"
    return {"a1": "0.0::DOUBLE", "a2": f"-{a} * (z + {d}) / {rho}", "a3": f"{a} * y / {rho}"}


def _rr(sx: str, sy: str, sz: str) -> str:
    return f"sqrt((x - {sx}) * (x - {sx}) + (y - {sy}) * (y - {sy}) + (z - {sz}) * (z - {sz}))"


def _dip_a(m: str, at: tuple[str, str, str]) -> dict[str, str]:
    r3 = f"pow({_rr(*at)}, 3.0)"
    return {"a1": f"-{m} * (y - {at[1]}) / {r3}", "a2": f"{m} * (x - {at[0]}) / {r3}", "a3": "0.0::DOUBLE"}


def _dip_b(m: tuple[str, str, str], at: tuple[str, str, str]) -> dict[str, str]:
    d = [f"({x} - {p})" for x, p in zip("xyz", at, strict=True)]
    dot = f"({' + '.join(f'{a} * {b}' for a, b in zip(m, d, strict=True))})"
    return {f"b{n + 1}": f"3 * {d[n]} * {dot} / pow({_rr(*at)}, 5.0) - {m[n]} / pow({_rr(*at)}, 3.0)" for n in range(3)}


AT = ("8.0", "8.0", "(-1.0)")
SRC = ("sx", "sy", "sz")
SUMMED = lambda cols: ", ".join(f"round(sum({e}), 9) + 0.0 AS {n}" for n, e in cols.items())


def _rope(points: str, keys: str) -> str:
    """`axis` and `rope` over a table of points."""
    n, r0, a, q, l0 = N_AXIS, 1.5, 0.3, 1.0, 1.0
    over = q * l0 * ((r0 * r0 + l0 * l0) ** -1.5 + (r0 * r0 - l0 * l0) ** -1.5)
    flux = 4 * math.pi * 0.6 / math.sqrt(2.0) * (r0 * over / (math.log(8 * r0 / a) - 1)) * a
    ang = lambda m: f"(2 * pi() * ({m}) / {n})"
    amp = flux * 5 * math.sqrt(2.0) / 3 / a
    cross = {"1": "ty * dz - tz * dy", "2": "tz * dx - tx * dz", "3": "tx * dy - ty * dx"}
    tail = f"(5 - 2 * r2) * 0.5 / {math.sqrt(6.0)!r} * (1 - 2 / pi() * asin(least(1.0, (1 + 2 * r2) / (5 - 2 * r2))))"
    inner = "(asin(least(1.0, rr)) / rr)"
    root = "sqrt(greatest(0.0, 1 - r2))"
    return f"""axis AS (SELECT 0.25 AS ax, 0.75 + {r0} * sin{ang("m")} AS ay, -0.5 + {r0} * cos{ang("m")} AS az, 0.0 AS tx,
    0.5 * ({r0} * sin{ang(f"(m + 1) % {n}")} - {r0} * sin{ang(f"(m + {n - 1}) % {n}")}) AS ty, 0.5 * ({r0} * cos{ang(f"(m + 1) % {n}")} - {r0} * cos{ang(f"(m + {n - 1}) % {n}")}) AS tz FROM range({n}) t(m)),
met AS (SELECT *, dx * dx + dy * dy + dz * dz AS r2, sqrt(dx * dx + dy * dy + dz * dz) AS rr FROM (SELECT p.*, a.*, (x - ax) / {a} AS dx, (y - ay) / {a} AS dy, (z - az) / {a} AS dz FROM {points} p CROSS JOIN axis a)),
kern AS (SELECT *, CASE WHEN rr <= 1 THEN 2 / pi() * ({inner} + (5 - 2 * r2) / 3 * {root}) ELSE 1 / rr END AS ki,
    CASE WHEN rr <= 1 THEN 2 / pi() / r2 * ({inner} - {root} + 2 / pi() * {root} + {tail}) ELSE 1 / (rr * r2) END AS kf FROM met),
rope AS (SELECT {keys}, {", ".join(f"sum({amp / (4 * math.pi)!r} * ki * t{x} / {a} + {flux / (4 * math.pi)!r} * kf * ({cross[c]}) / ({a} * {a})) AS a{c}" for c, x in (("1", "x"), ("2", "y"), ("3", "z")))} FROM kern GROUP BY {keys})"""


_D = [(b - a) / n for a, b, n in zip(*X.SLAB, strict=True)]
WIDE = (tuple(a - d for a, d in zip(X.SLAB[0], _D, strict=True)), tuple(b + d for b, d in zip(X.SLAB[1], _D, strict=True)), tuple(n + 2 for n in X.SLAB[2]))


def _slab_curl(table: str, fields: str, h: tuple[float, ...]) -> str:
    names = [f"{fields}{n}" for n in (1, 2, 3)]
    return f"""{_stencil(table, names)},
crl AS (SELECT * FROM (SELECT i, j, k, {_curl(names, tuple(f"{2 * x!r}::DOUBLE" for x in h))} FROM sten) WHERE j1 IS NOT NULL AND j2 IS NOT NULL AND j3 IS NOT NULL)"""


_SIZE = 24 + 8 * 7 * 512

_CROP_CELLS = _with(
    X.refined_cte(),
    sql=f"SELECT {L}, " + ", ".join(f"{x} - {lo} * 8 * (1 << (level - 1)) AS {x}" for x, (lo, _) in zip("ijk", CROP, strict=True)) + f", {FS} FROM cells WHERE " + " AND ".join(f"{x} BETWEEN {lo} * 8 * (1 << (level - 1)) AND {hi} * 8 * (1 << (level - 1)) - 1" for x, (lo, hi) in zip("ijk", CROP, strict=True)),
)
_FROM_UNIFORM = _with(X.uniform_cte(), sql=f"SELECT n.igrid, c.i, c.j, c.k, {FS.replace('b1', 'c.b1').replace('b2', 'c.b2').replace('b3', 'c.b3')} FROM cells c JOIN nodes n ON n.b1 = c.i // 8 AND n.b2 = c.j // 8 AND n.b3 = c.k // 8")
_HEADER_BYTES = 10 * 4 + 8 + 2 * 3 * 8 + 2 * 3 * 4 + 3 * 4 + 16 + 4 + 7 * 16 + 16 + 4 + 3 * 4
_NODE_BYTES = 4 * 16 + 15 * (4 + 12 + 8)
_BLOCK_ROWS = _with(NODES, sql=f"SELECT igrid, {L}, b1, b2, b3, {_HEADER_BYTES + _NODE_BYTES} + (igrid - 1) * {_SIZE} AS \"offset\" FROM nodes WHERE is_leaf")


def _header_sql(it: int, time: float, n_params: int) -> str:
    start = _HEADER_BYTES + n_params * (8 + 16)
    return _with(
        NODES,
        sql=f"""SELECT sum(is_leaf::INT)::BIGINT AS nleafs, sum((NOT is_leaf)::INT)::BIGINT AS nparents, max(level)::BIGINT AS levmax, 7::BIGINT AS nw, 3::BIGINT AS ndim,
       {it}::BIGINT AS it, {time}::DOUBLE AS time, {start}::BIGINT AS offset_tree, {start + _NODE_BYTES}::BIGINT AS offset_blocks, 16::BIGINT AS nx1, 16::BIGINT AS nx2, 16::BIGINT AS nx3
FROM nodes""",
    )


ORACLE_SQL: dict[str, str] = {
    "morton_encode": f"SELECT l_orderkey, l_linenumber, {X.morton_sql('l_orderkey % 1024', 'l_partkey % 1024', 'l_suppkey % 1024')} AS code FROM lineitem",
    "interleave_2d": "SELECT o_orderkey, o_custkey, list_sum(list_transform(range(31), lambda t: (((o_orderkey >> t::INT) & 1) << (2 * t)::INT) + (((o_custkey >> t::INT) & 1) << (2 * t + 1)::INT)))::BIGINT AS code FROM orders",
    "interleave_3d": f"SELECT l_orderkey, l_linenumber, {X.morton_sql('l_orderkey % 2097152', 'l_partkey', 'l_suppkey').replace('range(20)', 'range(21)')} AS code FROM lineitem",
    "level1_order": _with(X.order_cte(ORDER_NG), sql="SELECT * FROM ord"),
    "morton_box": _with(X.order_cte(ORDER_NG), sql="SELECT b1, b2, b3, morton FROM ord WHERE b1 <= 1 AND b2 BETWEEN 1 AND 2 AND b3 BETWEEN 1 AND 2"),
    "morton_select": _with(X.order_cte(ORDER_NG), sql="SELECT b1, b2, b3, sfc AS position FROM ord WHERE b1 = 1 AND b2 BETWEEN 1 AND 2 AND b3 BETWEEN 1 AND 2"),
    "forest_levels": _with(NESTED, sql=f"SELECT pos, is_leaf, {L}, b1, b2, b3 FROM nodes"),
    "leaf_order": _with(NESTED, sql=f"SELECT igrid, pos, {L} FROM nodes WHERE is_leaf"),
    "root_positions": _with(NESTED, sql="SELECT root, pos FROM nodes WHERE level = 1"),
    "root_first_leaf": _with(NESTED, sql="SELECT root, min(igrid) - 1 AS first_leaf, count(*) AS n_leaves FROM nodes WHERE is_leaf GROUP BY root"),
    "root_neighbors_periodic": _with(
        X.order_cte(ORDER_NG),
        sql=f"""SELECT b1, b2, b3, d1, d2, d3, CASE WHEN ok THEN n1 END AS n1, CASE WHEN ok THEN n2 END AS n2, CASE WHEN ok THEN n3 END AS n3 FROM (
  SELECT *, (b1 + d1 + 2) % 2 AS n1, b2 + d2 AS n2, (b3 + d3 + 4) % 4 AS n3, b2 + d2 BETWEEN 0 AND 2 AS ok FROM ord CROSS JOIN (SELECT unnest([-1, 0, 1])::BIGINT) {STEPS}
  WHERE abs(d1) + abs(d2) + abs(d3) > 0)""",
    ),
    "neighbor_types": _with(NODES, neighbors_cte(), sql="SELECT igrid, d1, d2, d3, ntype FROM nbrs"),
    "face_neighbors": _with(NODES, neighbors_cte(True), sql="SELECT igrid, d1, d2, d3, ntype, nbr FROM nbrs"),
    "neighbor_children": _with(NODES, neighbors_cte(), sql=children_sql()),
    "phys_sides": _with(
        NODES,
        sql="SELECT igrid, " + ", ".join(f"CASE WHEN b{a} = 0 AND b{a} = 2 * (1 << (level - 1)) - 1 THEN 2 WHEN b{a} = 0 THEN -1 WHEN b{a} = 2 * (1 << (level - 1)) - 1 THEN 1 ELSE 0 END::BIGINT AS side{a}" for a in (1, 2, 3)) + " FROM nodes WHERE is_leaf",
    ),
    "check_tree": _with(
        NESTED,
        "cnt AS (SELECT level, sum(is_leaf::INT)::BIGINT AS n_leaves, sum((NOT is_leaf)::INT)::BIGINT AS n_parents FROM nodes GROUP BY level)",
        sql=f"SELECT c.{L}, c.n_leaves, c.n_parents, coalesce((d.n_leaves + d.n_parents) / 8, 0.0)::DOUBLE AS expected_parents, c.n_parents = coalesce((d.n_leaves + d.n_parents) / 8, 0.0) AS ok FROM cnt c LEFT JOIN cnt d ON d.level = c.level + 1",
    ),
    "leaves_per_level": _with(NESTED, sql=f"SELECT {L}, count(*) AS n_leaves FROM nodes WHERE is_leaf GROUP BY level"),
    "tree_offsets": "SELECT (10 * 4 + 8 + 2 * 3 * 8 + 2 * 3 * 4 + 3 * 4 + 16 + 4 + 7 * 16 + 16 + 4 + 3 * 4)::BIGINT AS offset_tree, (10 * 4 + 8 + 2 * 3 * 8 + 2 * 3 * 4 + 3 * 4 + 16 + 4 + 7 * 16 + 16 + 4 + 3 * 4 + 4 * 16 + 15 * (4 + 12 + 8))::BIGINT AS offset_blocks",
    "write_tree": _with(NODES, sql=f"SELECT igrid, {L}, b1 + 1 AS ix1, b2 + 1 AS ix2, b3 + 1 AS ix3, (igrid - 1) * {_SIZE} AS \"offset\" FROM nodes WHERE is_leaf"),
    "write_forest": _with(NESTED, sql="SELECT pos, is_leaf FROM nodes"),
    "crop_roots": _with(X.order_cte((2, 2, 3), (0, 1, 1)), sql="SELECT b1, b2, b3, sfc FROM ord"),
    "crop_forest": _with(
        NODES,
        X.order_cte(CROP_NG, tuple(a for a, _ in CROP), "newroots"),
        sql=f"SELECT row_number() OVER (ORDER BY o.sfc, n.pos) - 1 AS pos, n.is_leaf FROM nodes n JOIN newroots o ON {' AND '.join(f'n.b{a} >> (n.level - 1) = o.b{a}' for a in (1, 2, 3))}",
    ),
    "crop_tree": _with(NODES, CROP_TREE, sql="SELECT igrid, level, b1, b2, b3, old_igrid FROM cropped"),
    "crop_check": _with(
        NODES,
        CROP_TREE,
        f"want AS (SELECT igrid FROM nodes WHERE is_leaf AND {_in_crop()})",
        sql="SELECT (SELECT count(*) FROM want WHERE igrid NOT IN (SELECT old_igrid FROM cropped)) AS missing, (SELECT count(*) FROM cropped WHERE old_igrid NOT IN (SELECT igrid FROM want)) AS extra",
    ),
    "crop_header": _with(
        NODES,
        CROP_TREE,
        sql="SELECT max(level) AS levmax, count(*) AS nleafs, "
        + ", ".join(f"{(hi - lo) * 8}::BIGINT AS nx{a + 1}, {lo * 8.0}::DOUBLE AS xmin{a + 1}, {hi * 8.0}::DOUBLE AS xmax{a + 1}" for a, (lo, hi) in enumerate(CROP))
        + " FROM cropped",
    ),
    "crop_cells": _CROP_CELLS,
    "crop_neighbors": _with(NODES, CROP_TREE, CROP_NODES, neighbors_cte(nodes="cnodes", roots=CROP_NG), sql="SELECT igrid, d1, d2, d3, ntype, nbr FROM nbrs"),
    "crop_children": _with(NODES, CROP_TREE, CROP_NODES, neighbors_cte(nodes="cnodes", roots=CROP_NG), sql=children_sql("cnodes")),
    "cropped_snapshot": _CROP_CELLS,
    "snapshot_header": _header_sql(0, 2.5, 0),
    "rewritten_header": _header_sql(7, 1.5, 1),
    "snapshot_forest": _with(NODES, sql="SELECT pos, is_leaf FROM nodes"),
    "snapshot_blocks": _BLOCK_ROWS,
    "metadata_only": _BLOCK_ROWS,
    "snapshot_cells": _with(*GHOSTED, sql=f"SELECT igrid, {L}, i, j, k, {FS} FROM own"),
    "snapshot_open": _with(*GHOSTED, sql=f"SELECT igrid, {L}, i, j, k, {FS} FROM own"),
    "copied_blocks": _with(*GHOSTED, sql=f"SELECT igrid, {L}, i, j, k, {FS} FROM own"),
    "snapshot_fields": _with(*GHOSTED, sql=f"SELECT igrid, {L}, i, j, k, b3, rho FROM own"),
    "rewritten_field": _with(*GHOSTED, sql=f"SELECT igrid, {L}, i, j, k, m3, b1 * 2 AS b1, b2 FROM own"),
    "vtk_cells": _with(*GHOSTED, sql="SELECT igrid, f AS field, i, j, k, CASE f WHEN 'rho' THEN rho ELSE b2 END AS value FROM own, (SELECT unnest(['rho', 'b2']) AS f)"),
    "dense_round_trip": _FROM_UNIFORM,
    "blocks_from_uniform": _FROM_UNIFORM,
    "project_fields": _with(X.uniform_cte(), sql="SELECT i, j, k, rho, b3 FROM cells"),
    "load_interior": _with(*GHOSTED, sql=f"SELECT igrid, {L}, i, j, k, {FS} FROM own"),
    "empty_mesh_cells": _with(X.refined_cte(), sql=f"SELECT {L}, i, j, k, 0.0::DOUBLE AS density, 0.0::DOUBLE AS magnetic_field FROM cells"),
    "block_geometry": _with(
        NODES,
        sql=f"SELECT igrid, {L}, "
        + ", ".join(f"b{a} * (8.0::DOUBLE / (1 << (level - 1))) AS {x}min, (b{a} + 1) * (8.0::DOUBLE / (1 << (level - 1))) AS {x}max, 1.0::DOUBLE / (1 << (level - 1)) AS d{x}" for a, x in ((1, "x"), (2, "y"), (3, "z")))
        + " FROM nodes WHERE is_leaf",
    ),
    "point_to_root": _with(POINTS, sql="SELECT pid, x / 8.0::DOUBLE AS u, y / 8.0::DOUBLE AS v, z / 8.0::DOUBLE AS w FROM pts"),
    "uniform_points": _with(X.grid_cte(X.BOX), sql="SELECT * FROM grid"),
    "locate_points": _with(NODES, _located(0.125), sql=f"SELECT pid, igrid, {L} FROM loc"),
    "locate_face_points": _with(NODES, _located(0.0), sql=f"SELECT pid, igrid, {L} FROM loc"),
    "nearest_cell": _with(NODES, _located(0.0), sql=f"SELECT pid, {L}, i, j, k FROM cell"),
    "sample_nearest": _with(X.refined_cte(), _located(0.125), sql="SELECT s.pid, c.rho AS value FROM cell s JOIN cells c ON c.level = s.level AND c.i = s.i AND c.j = s.j AND c.k = s.k"),
    "sample_linear": _with(
        *REFINED,
        _located(0.125),
        _corners("loc", "pid"),
        "clamped AS (SELECT pid, w, level, " + ", ".join(f"greatest(0, least(16 * (1 << (level - 1)) - 1, {x})) AS {x}" for x in "ijk") + " FROM corner)",
        sql="""SELECT c.pid, sum(c.w * coalesce(v.rho, u.rho)) AS value FROM clamped c LEFT JOIN v ON v.level = c.level AND v.i = c.i AND v.j = c.j AND v.k = c.k
LEFT JOIN cells u ON u.level = c.level - 1 AND u.i = c.i >> 1 AND u.j = c.j >> 1 AND u.k = c.k >> 1 GROUP BY c.pid""",
    ),
    "coarsen": _with(*REFINED, sql=f"SELECT {L}, i, j, k, {FS} FROM restricted"),
    "ghost_boundary": _with(*GHOSTED, sql=f"SELECT n.igrid, n.{L}, n.i, n.j, n.k, {FS} FROM near n JOIN addr a ON a.igrid = n.igrid AND a.i = n.i AND a.j = n.j AND a.k = n.k WHERE a.i <> a.ci OR a.j <> a.cj OR a.k <> a.ck"),
    "ghost_sibling": _with(*GHOSTED, sql=f"SELECT a.igrid, a.{L}, a.i, a.j, a.k, {FS} FROM addr a JOIN cells c ON c.level = a.level AND c.i = a.ci AND c.j = a.cj AND c.k = a.ck"),
    "ghost_restrict": _with(*GHOSTED, sql=f"SELECT a.igrid, a.{L}, a.i, a.j, a.k, {FS} FROM addr a JOIN restricted c ON c.level = a.level AND c.i = a.ci AND c.j = a.cj AND c.k = a.ck"),
    "ghost_prolong": _with(*GHOSTED, sql=f"SELECT igrid, {L}, i, j, k, {FS} FROM prolonged"),
    "minmod_slopes": _with(*GHOSTED, sql=f"SELECT {L}, * EXCLUDE (level) FROM slopes"),
    "ghost_fill": _with(*GHOSTED, sql=f"SELECT igrid, {L}, i, j, k, {FS} FROM ghosts"),
    "curl_b": _with(*GHOSTED, CURRENT, sql=f"SELECT igrid, {L}, i, j, k, j1, j2, j3 FROM current WHERE NOT ghost"),
    "div_m": _with(*GHOSTED, _stencil("ghosted", ["m1", "m2", "m3"], "igrid"), sql=f"SELECT igrid, {L}, i, j, k, {DIV} AS div_m FROM sten WHERE NOT ghost"),
    "slab_with_boundary": _with(
        X.uniform_cte(),
        sql=f"SELECT a.r AS i, b.r AS j, c.r AS k, {FS.replace('b1', 's.b1').replace('b2', 's.b2').replace('b3', 's.b3')} FROM range(-2, 18) a(r) CROSS JOIN range(-2, 18) b(r) CROSS JOIN range(-2, 18) c(r) JOIN cells s ON s.i = greatest(0, least(15, a.r)) AND s.j = greatest(0, least(15, b.r)) AND s.k = greatest(0, least(15, c.r))",
    ),
    "resample_uniform": _with(*GHOSTED, _resample("ghosted", list(FIELDS)), sql="SELECT * FROM res"),
    "resample_current": _with(*GHOSTED, CURRENT, _resample("current", ["j1", "j2", "j3"]), sql="SELECT * FROM res"),
    "bipolar_a": _with(POINTS, sql=f"SELECT pid, {_r(_bip_a(2.0, 1.5, 0.75))} FROM pts"),
    "bipolar_b": _with(POINTS, sql=f"SELECT pid, {_r(_bip_b(1.5, 0.75))} FROM pts"),
    "dipolez_a": _with(POINTS, sql=f"SELECT pid, {_r(_dip_a('3.0', AT))} FROM pts"),
    "dipole_b": _with(POINTS, sql=f"SELECT pid, {_r(_dip_b(('1.0', '(-2.0)', '3.0'), AT))} FROM pts"),
    "monopole_b": _with(POINTS, sql=f"SELECT pid, {_r({f'b{n + 1}': f'5.0 * ({x} - {p}) / pow({_rr(*AT)}, 3.0)' for n, (x, p) in enumerate(zip('xyz', AT, strict=True))})} FROM pts"),
    "fan_a": _with(X.grid_cte(X.SLAB), X.sources_cte(), sql=f"SELECT p, q, r, {SUMMED(_dip_a('m3', SRC))} FROM grid, src GROUP BY p, q, r"),
    "fan_b": _with(X.grid_cte((*X.BOX[:2], (5, 5, 5))), X.sources_cte(), sql=f"SELECT p, q, r, {SUMMED(_dip_b(('m1', 'm2', 'm3'), SRC))} FROM grid, src GROUP BY p, q, r"),
    "fan_slab": _with(X.grid_cte(X.SLAB), X.sources_cte(), sql=f"SELECT p, q, r, {SUMMED(_dip_b(('m1', 'm2', 'm3'), SRC))} FROM grid, src GROUP BY p, q, r"),
    "curl_slab": _with(X.uniform_cte(), _slab_curl("cells", "b", (1.0, 1.0, 1.0)), sql="SELECT i, j, k, j1, j2, j3 FROM crl"),
    "rbsl_a": _with(X.grid_cte(X.SLAB), _rope("grid", "p, q, r"), sql="SELECT p, q, r, round(a1, 9) + 0.0 AS a1, round(a2, 9) + 0.0 AS a2, round(a3, 9) + 0.0 AS a3 FROM rope"),
    "tdm_slab": _with(
        X.grid_cte(WIDE, "wide0"),
        "wide AS (SELECT p - 1 AS i, q - 1 AS j, r - 1 AS k, x, y, z FROM wide0)",
        _rope("wide", "i, j, k"),
        _slab_curl("rope", "a", tuple(_D)),
        f"ovr AS (SELECT i, j, k, {', '.join(f'{e} AS {n}' for n, e in _bip_b(1.0, 0.5).items())} FROM wide)",
        sql="SELECT c.i, c.j, c.k, " + ", ".join(f"round(o.b{n} + c.j{n}, 9) + 0.0 AS b{n}" for n in (1, 2, 3)) + " FROM crl c JOIN ovr o ON o.i = c.i AND o.j = c.j AND o.k = c.k",
    ),
}
