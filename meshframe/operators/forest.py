"""Octree forests as relations: decoding and encoding the bit walk, neighbours, checks.

No step needs all nodes in one task: running sums go over chunks of CHUNK positions and then over the chunks' totals;
everything else is keyed by the root, a level or a block index.
"""

from __future__ import annotations

from itertools import product

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.keys import morton3
from .lineage import checkpointed
from .mesh import BLOCK, Mesh

CHUNK = 1 << 16
#: Nodes that the driver decodes by itself, about 60 bytes each.
SMALL = 100_000
WRONG_WALK = "the walk has more or fewer nodes than its trees"
LOW = Window.unboundedPreceding


def level1_order(spark: SparkSession, ng: tuple[int, int, int], low: tuple = (0, 0, 0)) -> DataFrame:
    """(b1, b2, b3, morton, sfc) of the level-1 blocks: sfc is the rank of the Morton code among blocks of the domain.

    The code is taken relative to `low`. Ranks are counted for codes' high bits first, so no task sorts all roots.
    """
    n = ng[0] * ng[1] * ng[2]
    ids = spark.range(n).select(
        F.expr(f"id div {ng[1] * ng[2]}").alias("b1"), F.expr(f"(id div {ng[2]}) % {ng[1]}").alias("b2"), (F.col("id") % ng[2]).alias("b3")
    )
    ids = ids.withColumn("morton", morton3("b1", "b2", "b3"))
    ranked = ranks(ids, "morton", F.shiftright("morton", 15)).withColumnRenamed("__rank", "sfc")
    return ranked.select(*[(F.col(b) + low[a]).cast("long").alias(b) for a, b in enumerate(BLOCK)], "morton", "sfc")


def ranks(df: DataFrame, order: str, bucket: Column) -> DataFrame:
    """Adds __rank, from 0, by a column; bucket must grow with it. Only one row a bucket meets in a single task."""
    df = df.withColumn("__bucket", bucket)
    sizes = df.groupBy("__bucket").agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__bucket").rowsBetween(LOW, -1))
    sizes = sizes.select(F.col("__bucket").alias("__of"), F.coalesce(before, F.lit(0)).alias("__before"))
    place = F.row_number().over(Window.partitionBy("__bucket").orderBy(order)) - 1
    out = df.withColumn("__place", place).join(sizes, F.col("__bucket") == F.col("__of"))
    return out.withColumn("__rank", (F.col("__before") + F.col("__place")).cast("long")).drop("__bucket", "__of", "__before", "__place")


def _walk(bits: DataFrame) -> DataFrame:
    """(pos, is_leaf, root, igrid): a leaf closes one open place, a parent opens seven more; whenever the running sum
    reaches a new minimum a tree is complete."""
    step = F.when(F.col("is_leaf"), -1).otherwise(7)
    b = bits.select(F.col("pos").cast("long").alias("pos"), "is_leaf", step.alias("step")).withColumn("c", F.expr(f"pos div {CHUNK}"))
    w = Window.partitionBy("c").orderBy("pos")
    b = b.withColumns({"s": F.sum("step").over(w), "n": F.sum(F.col("is_leaf").cast("int")).over(w)})
    b = b.withColumn("low", F.min("s").over(w.rowsBetween(LOW, -1)))
    totals = b.groupBy("c").agg(F.sum("step").alias("t"), F.min("s").alias("m"), F.sum(F.col("is_leaf").cast("int")).alias("leaves"))
    seq = Window.orderBy("c").rowsBetween(LOW, -1)
    totals = totals.withColumns({"s0": F.coalesce(F.sum("t").over(seq), F.lit(0)), "n0": F.coalesce(F.sum("leaves").over(seq), F.lit(0))})
    totals = totals.withColumn("low0", F.least(F.lit(0), F.min(F.col("s0") + F.col("m")).over(seq)))
    totals = totals.select(F.col("c").alias("c0"), "s0", "n0", "low0")
    b = b.join(totals, F.col("c") == F.col("c0"))
    low = F.least(F.col("low0"), F.col("s0") + F.col("low"))
    igrid = F.when(F.col("is_leaf"), F.col("n0") + F.col("n")).otherwise(-1)
    return b.select("pos", "is_leaf", (-low).cast("long").alias("root"), igrid.cast("long").alias("igrid"), "step")


def decode(bits: DataFrame, order: DataFrame) -> DataFrame:
    """Nodes (pos, is_leaf, root, igrid, level, parent, b1, b2, b3) of a pre-order bit walk (pos, is_leaf).

    A parent's subtree ends where the running sum first is eight lower. A node's level is one more than the number of
    subtrees begun and not ended before it. Children stand x fastest.
    """
    n = _walk(bits)
    by_root = Window.partitionBy("root").orderBy("pos")
    n = n.withColumn("s", F.sum("step").over(by_root))
    probe = n.withColumn("v", F.when(F.col("is_leaf"), F.col("s")).otherwise(F.col("s") - 8))
    after = Window.partitionBy("root", "v").orderBy("pos").rowsBetween(1, Window.unboundedFollowing)
    probe = probe.withColumn("end", F.when(~F.col("is_leaf"), F.first(F.when(F.col("is_leaf"), F.col("pos")), ignorenulls=True).over(after)))
    ends = probe.where("NOT is_leaf").groupBy(F.col("root").alias("r"), F.col("end").alias("e")).agg(F.count(F.lit(1)).alias("ended"))
    n = n.join(ends, (F.col("root") == F.col("r")) & (F.col("pos") == F.col("e")), "left")
    begun = F.sum((~F.col("is_leaf")).cast("int")).over(by_root.rowsBetween(LOW, -1))
    ended = F.sum(F.coalesce("ended", F.lit(0))).over(by_root.rowsBetween(LOW, -1))
    n = n.withColumn("level", (1 + F.coalesce(begun, F.lit(0)) - F.coalesce(ended, F.lit(0))).cast("int"))
    n = n.select("pos", "is_leaf", "root", "igrid", "level")

    both = n.withColumn("as_parent", F.lit(False)).unionByName(
        n.where("NOT is_leaf").withColumn("level", F.col("level") + 1).withColumn("as_parent", F.lit(True))
    )
    line = Window.partitionBy("root", "level").orderBy("pos").rowsBetween(LOW, -1)
    both = both.withColumn("parent", F.last(F.when(F.col("as_parent"), F.col("pos")), ignorenulls=True).over(line))
    n = both.where("NOT as_parent").drop("as_parent")
    slot = F.row_number().over(Window.partitionBy("root", "parent").orderBy("pos")) - 1
    n = checkpointed(n.withColumn("slot", slot))  # each level below reads it
    deepest = n.agg(F.max("level")).first()[0] or 0
    at = n.where("level = 1").join(order.select("sfc", *BLOCK), F.col("root") == F.col("sfc")).drop("sfc")
    out = at
    for level in range(2, deepest + 1):
        up = at.select(F.col("pos").alias("up"), *[F.col(b).alias(f"up_{b}") for b in BLOCK])
        at = n.where(F.col("level") == level).join(up, F.col("parent") == F.col("up"))
        bits_of = [2 * F.col(f"up_{b}") + F.shiftright("slot", a).bitwiseAND(F.lit(1)) for a, b in enumerate(BLOCK)]
        at = at.select(*n.columns, *[c.alias(b) for c, b in zip(bits_of, BLOCK, strict=True)])
        out = out.unionByName(at)
    return out.drop("slot")


def encode(leaves: DataFrame, order: DataFrame, deepest: int) -> DataFrame:
    """The bit walk (pos, is_leaf) of leaves (level, b1, b2, b3): all ancestors, by root, padded path and level."""
    up = leaves.select("level", *BLOCK, F.explode(F.sequence(F.lit(1), "level")).alias("at"))
    shift = F.col("level") - F.col("at")
    nodes = up.select(F.col("at").alias("level"), *[F.expr(f"shiftright({b}, level - at)").alias(b) for b in BLOCK], (shift == 0).alias("is_leaf"))
    nodes = nodes.groupBy("level", *BLOCK).agg(F.max("is_leaf").alias("is_leaf"))
    inner = [F.expr(f"{b} & (shiftleft(1L, level - 1) - 1)") for b in BLOCK]
    nodes = nodes.withColumn("path", morton3(*inner))
    nodes = nodes.withColumn("path", F.expr(f"shiftleft(path, 3 * ({deepest} - level))"))
    roots = order.select("sfc", *[F.col(b).alias(f"r{b}") for b in BLOCK])
    on = [F.expr(f"shiftright({b}, level - 1)") == F.col(f"r{b}") for b in BLOCK]
    nodes = nodes.join(roots, on[0] & on[1] & on[2])
    nodes = nodes.withColumn("__order", F.struct("sfc", "path", "level"))
    return ranks(nodes, "__order", F.col("sfc")).select(F.col("__rank").alias("pos"), "is_leaf")


def number_leaves(leaves: DataFrame, order: DataFrame, deepest: int) -> DataFrame:
    """leaves with igrid, from 1 in curve order."""
    inner = [F.expr(f"{b} & (shiftleft(1L, level - 1) - 1)") for b in BLOCK]
    roots = order.select("sfc", *[F.col(b).alias(f"r{b}") for b in BLOCK])
    on = [F.expr(f"shiftright({b}, level - 1)") == F.col(f"r{b}") for b in BLOCK]
    out = leaves.join(roots, on[0] & on[1] & on[2]).withColumn("path", morton3(*inner))
    out = out.withColumn("path", F.expr(f"shiftleft(path, 3 * ({deepest} - level))"))
    out = ranks(out.withColumn("__order", F.struct("sfc", "path")), "__order", F.col("sfc"))
    return out.select(*leaves.columns, (F.col("__rank") + 1).alias("igrid"), F.col("sfc").alias("root"))


def root_neighbors(order: DataFrame, ng: tuple[int, int, int], periodic: tuple = (False, False, False)) -> DataFrame:
    """(b1, b2, b3, d1, d2, d3, n1, n2, n3): the root in each of 26 directions, null outside, wrapped where periodic."""
    rows = order.select(*BLOCK, F.explode(offsets()).alias("d")).select(*BLOCK, "d.*")
    for a, b in enumerate(BLOCK):
        to = F.col(b) + F.col(f"d{a + 1}")
        rows = rows.withColumn(f"n{a + 1}", F.pmod(to, F.lit(ng[a])) if periodic[a] else to)
    inside = F.lit(True)
    for a in range(3):
        inside = inside & F.col(f"n{a + 1}").between(0, ng[a] - 1)
    return rows.select(*BLOCK, "d1", "d2", "d3", *[F.when(inside, F.col(f"n{a}")).cast("long").alias(f"n{a}") for a in (1, 2, 3)])


def offsets(faces_only: bool = False) -> Column:
    steps = [(a, b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1) if (a, b, c) != (0, 0, 0)]
    if faces_only:
        steps = [x for x in steps if sum(map(abs, x)) == 1]
    return F.array(*[F.struct(*[F.lit(v).alias(f"d{n + 1}") for n, v in enumerate(s)]) for s in steps])


def neighbors(blocks: DataFrame, ng: tuple[int, int, int], periodic: tuple = (False, False, False), faces_only: bool = False) -> DataFrame:
    """(igrid, d1, d2, d3, ntype, nbr): 1 boundary, 2 coarser, 3 same level, 4 finer; nbr is the leaf's igrid for 2 and
    3, else 0. Two equi-joins, on the node at the same level and on the leaf one level up."""
    leaf = blocks.where("is_leaf").select("igrid", "level", *BLOCK)
    rows = leaf.withColumn("d", F.explode(offsets(faces_only))).select(*leaf.columns, "d.*")
    inside = F.lit(True)
    for a, b in enumerate(BLOCK):
        n = F.expr(f"shiftleft({ng[a]}L, level - 1)")
        to = F.col(b) + F.col(f"d{a + 1}")
        rows = rows.withColumn(f"t{a + 1}", F.pmod(to, n) if periodic[a] else to)
        inside = inside & (F.col(f"t{a + 1}") >= 0) & (F.col(f"t{a + 1}") < n)
    rows = rows.withColumn("inside", inside)
    same = blocks.select(F.col("level").alias("sl"), *[F.col(b).alias(f"s{b}") for b in BLOCK], F.col("is_leaf").alias("s_leaf"), F.col("igrid").alias("s_igrid"))
    up = leaf.select(F.col("level").alias("cl"), *[F.col(b).alias(f"c{b}") for b in BLOCK], F.col("igrid").alias("c_igrid"))
    on = (F.col("level") == F.col("sl")) & (F.col("t1") == F.col("sb1")) & (F.col("t2") == F.col("sb2")) & (F.col("t3") == F.col("sb3"))
    rows = rows.join(same, on, "left")
    half = [F.shiftright(f"t{a}", 1) for a in (1, 2, 3)]
    on = (F.col("level") - 1 == F.col("cl")) & (half[0] == F.col("cb1")) & (half[1] == F.col("cb2")) & (half[2] == F.col("cb3"))
    rows = rows.join(up, on & F.col("s_leaf").isNull() & F.col("inside"), "left")
    kind = F.when(~F.col("inside"), 1).when(F.col("s_leaf"), 3).when(F.col("s_leaf") == F.lit(False), 4).when(F.col("c_igrid").isNotNull(), 2).otherwise(1)
    nbr = F.when(kind == 3, F.col("s_igrid")).when(kind == 2, F.col("c_igrid")).otherwise(0)
    return rows.select("igrid", "level", *BLOCK, "d1", "d2", "d3", "t1", "t2", "t3", kind.alias("ntype"), nbr.cast("long").alias("nbr"))


def neighbor_children(blocks: DataFrame, ng: tuple[int, int, int]) -> DataFrame:
    """(igrid, c1, c2, c3, nbr): the finer leaves that touch a leaf; c is 0 and 3 outside, 1 and 2 along the block."""
    fine = neighbors(blocks, ng).where("ntype = 4")
    for a in (1, 2, 3):
        d = F.col(f"d{a}")
        fine = fine.withColumn(f"h{a}", F.explode(F.when(d == -1, F.array(F.lit(1))).when(d == 1, F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))))
    leaf = blocks.where("is_leaf").select(F.col("level").alias("fl"), *[F.col(b).alias(f"f{b}") for b in BLOCK], F.col("igrid").alias("child"))
    on = F.col("level") + 1 == F.col("fl")
    for a, b in enumerate(BLOCK):
        on = on & (2 * F.col(f"t{a + 1}") + F.col(f"h{a + 1}") == F.col(f"f{b}"))
    place = [F.when(F.col(f"d{a}") == -1, 0).when(F.col(f"d{a}") == 1, 3).otherwise(1 + F.col(f"h{a}")) for a in (1, 2, 3)]
    return fine.join(leaf, on).select("igrid", *[p.alias(f"c{a + 1}") for a, p in enumerate(place)], F.col("child").alias("nbr"))


def phys_sides(blocks: DataFrame, ng: tuple[int, int, int]) -> DataFrame:
    """(igrid, side1, side2, side3): -1 lower boundary, 1 upper, 2 both, 0 none."""
    leaf = blocks.where("is_leaf")
    out = []
    for a, b in enumerate(BLOCK):
        lo, hi = F.col(b) == 0, F.col(b) == F.expr(f"shiftleft({ng[a]}L, level - 1)") - 1
        out.append(F.when(lo & hi, 2).when(lo, -1).when(hi, 1).otherwise(0).alias(f"side{a + 1}"))
    return leaf.select("igrid", *out)


def check_tree(blocks: DataFrame) -> DataFrame:
    """(level, n_leaves, n_parents, expected_parents, ok): parents at a level are an eighth of the nodes below."""
    by = blocks.groupBy("level").agg(F.sum(F.col("is_leaf").cast("long")).alias("n_leaves"), F.sum((~F.col("is_leaf")).cast("long")).alias("n_parents"))
    below = by.select((F.col("level") - 1).alias("l"), ((F.col("n_leaves") + F.col("n_parents")) / 8).alias("e"))
    out = by.join(below, F.col("level") == F.col("l"), "left").withColumn("expected_parents", F.coalesce("e", F.lit(0.0)))
    return out.select("level", "n_leaves", "n_parents", "expected_parents", (F.col("n_parents") == F.col("expected_parents")).alias("ok"))


def tree_rows(blocks: DataFrame, block_nx: tuple[int, int, int], n_fields: int, first: int = 0) -> DataFrame:
    """(igrid, level, ix1, ix2, ix3, offset) as files hold them: 1-based indices, running byte offsets."""
    size = 24 + 8 * n_fields * block_nx[0] * block_nx[1] * block_nx[2]
    return blocks.where("is_leaf").select(
        "igrid", "level", *[(F.col(b) + 1).alias(f"ix{a + 1}") for a, b in enumerate(BLOCK)], (F.lit(first) + (F.col("igrid") - 1) * size).cast("long").alias("offset")
    )


def root_first_leaf(blocks: DataFrame) -> DataFrame:
    return blocks.where("is_leaf").groupBy("root").agg((F.min("igrid") - 1).alias("first_leaf"), F.count(F.lit(1)).alias("n_leaves"))


def uniform_forest(spark: SparkSession, ng: tuple[int, int, int]) -> DataFrame:
    """Blocks of a mesh whose roots are all leaves."""
    o = level1_order(spark, ng)
    return o.select((F.col("sfc") + 1).alias("igrid"), F.lit(1).alias("level"), *BLOCK, F.lit(True).alias("is_leaf"), F.col("sfc").alias("root"))


def _small_blocks(bits: list[bool], ng: tuple[int, int, int]) -> pa.Table:
    """The same nodes as decode() gives, by a stack, for a walk that the driver holds."""
    def code(b: tuple[int, int, int]) -> int:
        return sum((x >> t & 1) << (3 * t + a) for a, x in enumerate(b) for t in range(max(ng).bit_length()))

    rows, leaves, at = [], 0, 0
    for root, b in enumerate(sorted(product(*map(range, ng)), key=code)):
        todo = [(1, *b)]
        while todo:
            level, x, y, z = todo.pop()
            if at == len(bits):
                raise ValueError(WRONG_WALK)
            leaves += bits[at]
            rows.append((leaves if bits[at] else -1, level, x, y, z, bits[at], root))
            if not bits[at]:
                todo += [(level + 1, 2 * x + (c & 1), 2 * y + (c >> 1 & 1), 2 * z + (c >> 2)) for c in range(7, -1, -1)]
            at += 1
    if at != len(bits):
        raise ValueError(WRONG_WALK)
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64())
    names = ("igrid", "level", *BLOCK, "is_leaf", "root")
    return pa.table({n: pa.array(c, k) for n, c, k in zip(names, zip(*rows, strict=True), kinds, strict=True)})


def mesh_blocks(spark: SparkSession, bits: DataFrame, ng: tuple[int, int, int], small: int = SMALL) -> DataFrame:
    """The decoded blocks (igrid, level, b1, b2, b3, is_leaf, root), held or written out once: every operator joins
    them, and none should decode them again. A walk of at most `small` nodes is decoded on the driver. A walk that does not
    end with its last tree is an error either way."""
    head = bits.select("pos", "is_leaf").limit(small + 1).collect()
    if len(head) <= small:
        return spark.createDataFrame(_small_blocks([r.is_leaf for r in sorted(head)], ng))
    blocks = checkpointed(decode(bits, level1_order(spark, ng)).select("igrid", "level", *BLOCK, "is_leaf", "root"))
    # Nodes beyond the last tree meet no root; a tree that is cut off leaves places open.
    n, step = blocks.agg(F.count(F.lit(1)), F.sum(F.when(F.col("is_leaf"), -1).otherwise(7))).first()
    if n != bits.count() or step != -ng[0] * ng[1] * ng[2]:
        raise ValueError(WRONG_WALK)
    return blocks


def unbalanced(mesh: Mesh) -> DataFrame:
    """Leaves whose neighbours differ by more than one level: rows of neighbors() inside the domain without a match."""
    n = neighbors(mesh.blocks, mesh.roots)
    inside = F.lit(True)
    for a in range(3):
        top = F.expr(f"shiftleft({mesh.roots[a]}L, level - 1)")
        inside = inside & (F.col(f"t{a + 1}") >= 0) & (F.col(f"t{a + 1}") < top)
    return n.where((F.col("ntype") == 1) & inside)
