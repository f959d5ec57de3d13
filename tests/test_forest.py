"""Curve order, octree decoding and neighbours: known values and random forests against plain recursion."""

import random

import pytest
from pyspark.sql import functions as F

from meshframe.functions.keys import interleave, morton3
from meshframe.operators import forest
from meshframe.plans import fixtures as X


def random_forest(rng, roots, deepest, share=0.3):
    bits = []

    def grow(level):
        split = level < deepest and rng.random() < share
        bits.append(not split)
        if split:
            for _ in range(8):
                grow(level + 1)

    for _ in range(roots):
        grow(1)
    return bits


def walk(bits, order):
    """(pos, level, b1, b2, b3, is_leaf, igrid) by recursion."""
    out, leaf, at = [], 0, 0

    def visit(level, b):
        nonlocal leaf, at
        pos, at = at, at + 1
        is_leaf = bits[pos]
        leaf += is_leaf
        out.append((pos, level, *b, is_leaf, leaf if is_leaf else -1))
        if not is_leaf:
            for c in range(8):
                visit(level + 1, tuple(2 * x + (c >> a & 1) for a, x in enumerate(b)))

    for b in order:
        visit(1, b)
    return out


def as_bits(spark, bits):
    return spark.createDataFrame(list(enumerate(bits)), "pos long, is_leaf boolean")


def test_morton_codes(spark):
    rows = [((0, 0, 0), 0), ((1, 0, 0), 1), ((0, 1, 0), 2), ((1, 1, 0), 3), ((0, 0, 1), 4), ((2**21 - 1,) * 3, 2**63 - 1)]
    df = spark.createDataFrame([r for r, _ in rows], "x long, y long, z long").select(morton3("x", "y", "z").alias("c"))
    assert [r.c for r in df.collect()] == [c for _, c in rows]
    with pytest.raises(ValueError):
        interleave(["x"] * 4)
    with pytest.raises(Exception, match="bits"):
        spark.range(1).select(morton3(F.lit(-1), F.lit(0), F.lit(0))).collect()


def test_level1_order(spark):
    rows = forest.level1_order(spark, (3, 3, 3)).orderBy("sfc").collect()
    assert len(rows) == 27 and tuple(rows[26])[:3] == (2, 2, 2)
    codes = [r.morton for r in forest.level1_order(spark, (2, 3, 4)).orderBy("sfc").collect()]
    assert codes == sorted(codes) and len(set(codes)) == 24


def test_known_neighbors(spark):
    blocks = forest.mesh_blocks(spark, X.bits(spark, X.REFINED_BITS), X.ROOTS)
    n = forest.neighbors(blocks, X.ROOTS)
    got = {(r.d1, r.d2, r.d3): r.ntype for r in n.where("igrid = 1").collect()}
    assert (got[-1, -1, -1], got[1, 1, 1], got[1, 0, 0]) == (1, 3, 4)
    assert {r.ntype: r["count"] for r in n.groupBy("ntype").count().collect()} == {1: 224, 2: 61, 3: 98, 4: 7}
    fine = {(r.c1, r.c2, r.c3) for r in forest.neighbor_children(blocks, X.ROOTS).where("igrid = 1").collect()}
    assert {c[1:] for c in fine if c[0] == 3} == {(j, k) for j in (1, 2) for k in (1, 2)}


def test_neighbors_are_mutual(spark):
    blocks = forest.mesh_blocks(spark, X.bits(spark, X.REFINED_BITS), X.ROOTS)
    n = {(r.igrid, r.d1, r.d2, r.d3): (r.ntype, r.nbr) for r in forest.neighbors(blocks, X.ROOTS).collect()}
    for (g, *d), (t, m) in n.items():
        if t == 3:
            assert n[m, -d[0], -d[1], -d[2]] == (3, g)
        if t == 2:
            assert any(n[m, a, b, c][0] == 4 for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1) if (a, b, c) != (0, 0, 0))


@pytest.mark.parametrize("seed, chunk", [(1, 1 << 16), (2, 7)])
def test_decode_and_encode(spark, seed, chunk, monkeypatch):
    monkeypatch.setattr(forest, "CHUNK", chunk)
    ng = (2, 3, 2)
    bits = random_forest(random.Random(seed), 12, 3)
    order = forest.level1_order(spark, ng)
    roots = [(r.b1, r.b2, r.b3) for r in order.orderBy("sfc").collect()]
    nodes = forest.decode(as_bits(spark, bits), order)
    got = sorted((r.pos, r.level, r.b1, r.b2, r.b3, r.is_leaf, r.igrid) for r in nodes.collect())
    assert got == walk(bits, roots)
    names = ["igrid", "level", "b1", "b2", "b3", "is_leaf", "root"]
    both = [sorted(map(tuple, forest.mesh_blocks(spark, as_bits(spark, bits), ng, small).select(names).collect())) for small in (0, 10_000)]
    assert both[0] == both[1] == sorted(map(tuple, nodes.select(names).collect()))
    leaves = nodes.where("is_leaf").select("level", "b1", "b2", "b3")
    deepest = max(x[1] for x in got)
    assert [r.is_leaf for r in forest.encode(leaves, order, deepest).orderBy("pos").collect()] == bits
    numbered = {(r.level, r.b1, r.b2, r.b3): r.igrid for r in forest.number_leaves(leaves, order, deepest).collect()}
    assert numbered == {x[1:5]: x[6] for x in got if x[5]}
    assert all(r.ok for r in forest.check_tree(nodes).collect())


@pytest.mark.parametrize("small", [0, 100])
@pytest.mark.parametrize("bits", [[1] * 9, [1] * 7, [1] * 7 + [0] + [1] * 7, [0] + [1] * 16, []])
def test_walks_that_do_not_end_with_their_trees(spark, bits, small):
    with pytest.raises(ValueError, match="more or fewer nodes"):
        forest.mesh_blocks(spark, as_bits(spark, [bool(b) for b in bits]), (2, 2, 2), small)


def test_periodic_roots(spark):
    n = forest.root_neighbors(forest.level1_order(spark, (2, 2, 2)), (2, 2, 2), (True, True, True))
    assert n.where("n1 IS NULL").count() == 0
    assert forest.root_neighbors(forest.level1_order(spark, (2, 2, 2)), (2, 2, 2)).where("n1 IS NULL").count() == 8 * 19
