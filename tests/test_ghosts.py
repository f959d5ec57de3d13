"""Ghost cells, calculus and sampling: constants and linear fields are exact, everything else against plain loops."""

import random
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshframe.operators import calculus, crop, forest, ghost, mesh, sample
from meshframe.plans import fixtures as X

N = 4


def make(spark, bits, ng, deepest, value, fields=("b1", "b2", "b3", "m1", "m2", "m3")):
    """A mesh of N^3-cell blocks whose fields are value(field, x, y, z) at cell centres."""
    blocks = forest.mesh_blocks(spark, spark.createDataFrame(list(enumerate(bits)), "pos long, is_leaf boolean"), ng)
    leaves = blocks.where("is_leaf").collect()
    rows = []
    for r in leaves:
        h = 1.0 / 2 ** (r.level - 1)
        for c in product(range(N), repeat=3):
            at = [b * N + x for b, x in zip((r.b1, r.b2, r.b3), c, strict=True)]
            rows.append((r.level, *at, *[float(value(f, *[(x + 0.5) * h for x in at])) for f in fields]))
    cells = spark.createDataFrame(rows, "level int, i long, j long, k long, " + ", ".join(f"{f} double" for f in fields))
    dn = tuple(n * N for n in ng)
    return mesh.Mesh(dn, (N,) * 3, (0.0,) * 3, tuple(map(float, dn)), fields, blocks, cells), leaves, rows


def balanced(rng, ng=(2, 2, 2)):
    """Bits of a forest with some refined roots: 2:1 balanced by its depth."""
    out = []
    for _ in range(ng[0] * ng[1] * ng[2]):
        split = rng.random() < 0.4
        out += [False, *[True] * 8] if split else [True]
    return out


def plain_ghosts(m, leaves, rows, field_at, depth=2):
    """Ghost values by direct lookups, written without the operators' relations."""
    value = {r[:4]: np.array(r[4:]) for r in rows}

    def look(level, at):
        if (level, *at) in value:
            return value[(level, *at)]
        fine = [value.get((level + 1, *[2 * a + d for a, d in zip(at, c, strict=True)])) for c in product((0, 1), repeat=3)]
        return None if any(f is None for f in fine) else sum(fine) / 8

    def clamp(level, at):
        return tuple(max(0, min(n * 2 ** (level - 1) - 1, a)) for a, n in zip(at, m.domain_nx, strict=True))

    out = {}
    for r in leaves:
        b = (r.b1, r.b2, r.b3)
        for c in product(range(-depth, N + depth), repeat=3):
            if all(0 <= x < N for x in c):
                continue
            at = tuple(x * N + y for x, y in zip(b, c, strict=True))
            to = clamp(r.level, at)
            v = look(r.level, to)
            if v is None:
                up, level = tuple(x // 2 for x in to), r.level - 1
                mid = look(level, up)
                v = mid.copy()
                for axis in range(3):
                    step = np.eye(3, dtype=int)[axis]
                    lo = look(level, clamp(level, tuple(np.array(up) - step)))
                    hi = look(level, clamp(level, tuple(np.array(up) + step)))
                    mean = (hi - lo) / 2
                    s = np.sign(mean)
                    slope = s * np.maximum(0, np.minimum(np.abs(mean), np.minimum(s * (mid - lo), s * (hi - mid))))
                    v += slope * (0.25 if to[axis] % 2 else -0.25)
            out[(r.igrid, *at)] = v
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_ghosts_match_plain_lookups(spark, seed):
    rng = random.Random(seed)
    m, leaves, rows = make(spark, balanced(rng), (2, 2, 2), 2, lambda *_: rng.randint(0, 64))
    got = {(r.igrid, r.i, r.j, r.k): np.array([r[f] for f in m.fields]) for r in ghost.ghosts(m).collect()}
    want = plain_ghosts(m, leaves, rows, None)
    assert set(got) == set(want)
    assert all((got[k] == want[k]).all() for k in want)
    assert forest.neighbors(m.blocks, m.roots).where("ntype = 0").count() == 0 and forest.unbalanced(m).count() == 0


def test_constants_and_linear_fields(spark):
    coef = {"b1": (0, 1, 2), "b2": (3, 0, 5), "b3": (7, 11, 0), "m1": (2, 0, 0), "m2": (0, 3, 0), "m3": (0, 0, 4)}
    f = lambda name, x, y, z: np.dot(coef[name], (x, y, z))
    m, _, _ = make(spark, [False, *[True] * 8, *[True] * 7], (2, 2, 2), 2, f)
    g = ghost.ghosted(m).cache()
    inner = F.lit(True)
    for a, x in enumerate("ijk"):  # away from the domain's edge, where values are copied outwards
        h = F.expr("2.0 / shiftleft(1, level - 1)") / 2
        inner = inner & ((F.col(x) + 0.5) * h > 2) & ((F.col(x) + 0.5) * h < 6)
    j = calculus.current(m, g).where(inner & ~F.col("ghost"))
    assert j.count() > 100
    assert {(r.j1, r.j2, r.j3) for r in j.collect()} == {(6.0, -5.0, 2.0)}
    d = calculus.momentum_divergence(m, g).where(inner & ~F.col("ghost"))
    assert {r.div_m for r in d.collect()} == {9.0}
    box, n = ((3.0, 3.0, 3.0), (5.0, 5.0, 5.0), (8, 8, 8)), (8, 8, 8)
    pts = mesh.uniform_points(spark, *box)
    for r in sample.resample(m, g, pts, box, n, m.fields).join(pts, ["p", "q", "r"]).collect():
        assert all(abs(r[name] - f(name, r.x, r.y, r.z)) < 1e-12 for name in m.fields)
    far = ((20.0,) * 3, (22.0,) * 3, (2, 2, 2))
    assert {r.b1 for r in sample.resample(m, g, mesh.uniform_points(spark, *far), far, (2, 2, 2), ("b1",)).collect()} == {0.0}
    g.unpersist()


def test_sampling(spark):
    f = lambda name, x, y, z: x + 2 * y + 4 * z
    m, _, rows = make(spark, [False, *[True] * 8, *[True] * 7], (2, 2, 2), 2, f, ("rho",))
    pts = [(0, 3.0, 3.0, 3.0), (1, 0.1, 7.9, 4.3), (2, 4.0, 4.0, 4.0), (3, 5.5, 5.25, 6.0), (4, 9.0, 0.0, 0.0), (5, 8.0, 8.0, 8.0)]
    df = spark.createDataFrame(pts, "pid long, x double, y double, z double")
    at = {r.pid: r for r in sample.locate(m, df).collect()}
    assert set(at) == {0, 1, 2, 3, 5} and at[2].level == 2  # on a corner the lowest leaf wins; outside is dropped
    near = {r.pid: r.value for r in sample.sample_nearest(m, df, "rho").collect()}
    assert near[3] == f("", 5.5, 5.5, 6.5) and near[5] == f("", 7.5, 7.5, 7.5)
    line = {r.pid: r.value for r in sample.sample_linear(m, df, "rho").collect()}
    assert line[3] == f("", 5.5, 5.25, 6.0) and abs(line[0] - f("", 3, 3, 3)) < 1e-12
    with pytest.raises(ValueError):
        sample.sample_nearest(m, df, "nothing")
    with pytest.raises(ValueError):
        calculus.current(m, ghost.ghosted(m))


def test_crop(spark):
    rng = random.Random(3)
    m, leaves, rows = make(spark, [True, False, *[True] * 8, *[True] * 6], (2, 2, 2), 2, lambda *_: rng.random(), ("rho",))
    c = crop.crop(m, ((1, 2), (0, 2), (0, 1)))
    assert c.domain_nx == (4, 8, 4) and c.xmin == (4.0, 0.0, 0.0) and c.xmax == (8.0, 8.0, 4.0)
    assert c.leaves.count() == 9 and c.cells.count() == 9 * 64
    assert ghost.ghosted(c).where("rho IS NULL").count() == 0
    with pytest.raises(ValueError):
        crop.crop(m, ((0, 3), (0, 2), (0, 1)))


def test_mesh_checks(spark):
    e = spark.range(0).selectExpr("1 AS level", "id AS i", "id AS j", "id AS k", "0.0D AS rho")
    b = forest.uniform_forest(spark, (2, 2, 2))
    for dn, nx, lo, hi, f in (((7, 8, 8), (4,) * 3, 0.0, 1.0, "rho"), ((6,) * 3, (3,) * 3, 0.0, 1.0, "rho"), ((8,) * 3, (4,) * 3, 1.0, 1.0, "rho"), ((8,) * 3, (4,) * 3, 0.0, 1.0, "no")):
        with pytest.raises(ValueError):
            mesh.Mesh(dn, nx, (lo,) * 3, (hi,) * 3, (f,), b, e)


def test_plans_hold_no_cartesian_join(spark):
    m = X.refined_mesh(spark, "/root/testdata/sf0.001")
    plan = ghost.ghosts(m)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan and "Python" not in plan
