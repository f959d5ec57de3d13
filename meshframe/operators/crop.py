"""Cropping a mesh to a half-open box of level-1 blocks."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .forest import encode, level1_order, number_leaves, ranks
from .mesh import AXES, BLOCK, Mesh

Box = tuple[tuple[int, int], tuple[int, int], tuple[int, int]]


def sides(box: Box) -> tuple[int, int, int]:
    return tuple(b - a for a, b in box)


def crop_roots(spark: SparkSession, box: Box) -> DataFrame:
    """(b1, b2, b3, sfc): roots in the box, ranked by the Morton code relative to the box's corner."""
    return level1_order(spark, sides(box), tuple(a for a, _ in box)).select(*BLOCK, "sfc")


def in_box(box: Box, level: str = "level") -> Column:
    ok = F.lit(True)
    for b, (lo, hi) in zip(BLOCK, box, strict=True):
        root = F.expr(f"shiftright({b}, {level} - 1)")
        ok = ok & (root >= lo) & (root < hi)
    return ok


def crop_tree(blocks: DataFrame, box: Box) -> DataFrame:
    """(igrid, level, b1, b2, b3, old_igrid): leaves of the box, shifted by its corner and numbered anew.

    New roots keep their subtrees' order, so leaves sort by (new root rank, old igrid).
    """
    spark = blocks.sparkSession
    leaves = blocks.where(F.col("is_leaf") & in_box(box)).select(F.col("igrid").alias("old_igrid"), "level", *BLOCK)
    order = crop_roots(spark, box).select("sfc", *[F.col(b).alias(f"r{b}") for b in BLOCK])
    on = [F.expr(f"shiftright({b}, level - 1)") == F.col(f"r{b}") for b in BLOCK]
    rows = leaves.join(order, on[0] & on[1] & on[2]).withColumn("__order", F.struct("sfc", "old_igrid"))
    rows = ranks(rows, "__order", F.col("sfc"))
    shifted = [(F.col(b) - lo * F.expr("shiftleft(1L, level - 1)")).alias(b) for b, (lo, _) in zip(BLOCK, box, strict=True)]
    return rows.select((F.col("__rank") + 1).alias("igrid"), "level", *shifted, "old_igrid")


def crop_parents(blocks: DataFrame, box: Box) -> DataFrame:
    """(igrid, level, b1, b2, b3, is_leaf, root): refined nodes of the box, shifted by its corner; igrid is -1."""
    parents = blocks.where(~F.col("is_leaf") & in_box(box)).select("level", *[F.col(b).alias(f"__{b}") for b in BLOCK])
    order = crop_roots(blocks.sparkSession, box).select("sfc", *[F.col(b).alias(f"r{b}") for b in BLOCK])
    on = [F.expr(f"shiftright(__{b}, level - 1)") == F.col(f"r{b}") for b in BLOCK]
    shifted = [(F.col(f"__{b}") - lo * F.expr("shiftleft(1L, level - 1)")).alias(b) for b, (lo, _) in zip(BLOCK, box, strict=True)]
    return parents.join(order, on[0] & on[1] & on[2]).select(
        F.lit(-1).cast("long").alias("igrid"), "level", *shifted, F.lit(False).alias("is_leaf"), F.col("sfc").alias("root")
    )


def crop_forest(blocks: DataFrame, box: Box, deepest: int) -> DataFrame:
    """(pos, is_leaf) of the cropped forest."""
    spark = blocks.sparkSession
    leaves = blocks.where(F.col("is_leaf") & in_box(box)).select("level", *BLOCK)
    shifted = leaves.select("level", *[(F.col(b) - lo * F.expr("shiftleft(1L, level - 1)")).alias(b) for b, (lo, _) in zip(BLOCK, box, strict=True)])
    return encode(shifted, level1_order(spark, sides(box)), deepest)


def crop_check(blocks: DataFrame, box: Box) -> DataFrame:
    """(missing, extra): leaves of the box that the cropped tree lacks, and rows that it has beyond them; both 0."""
    want = blocks.where(F.col("is_leaf") & in_box(box)).select("igrid")
    have = crop_tree(blocks, box).select(F.col("old_igrid").alias("igrid"))
    missing = want.exceptAll(have).agg(F.count(F.lit(1)).alias("missing"))
    extra = have.exceptAll(want).agg(F.count(F.lit(1)).alias("extra"))
    return missing.withColumn("__k", F.lit(1)).join(extra.withColumn("__k", F.lit(1)), "__k").drop("__k")


def crop(mesh: Mesh, box: Box) -> Mesh:
    """The mesh of the box: shifted indices, new bounds and domain size."""
    spark = mesh.blocks.sparkSession
    if any(not 0 <= lo < hi <= n for (lo, hi), n in zip(box, mesh.roots, strict=True)):
        raise ValueError("the box must be a non-empty range of level-1 blocks")
    deepest = mesh.blocks.agg(F.max("level")).first()[0]
    leaves = crop_tree(mesh.blocks, box).select("level", *BLOCK)
    blocks = number_leaves(leaves, level1_order(spark, sides(box)), deepest).withColumn("is_leaf", F.lit(True))
    blocks = blocks.select("igrid", "level", *BLOCK, "is_leaf", "root").unionByName(crop_parents(mesh.blocks, box))
    step = [(hi - lo) / n for lo, hi, n in zip(mesh.xmin, mesh.xmax, mesh.roots, strict=True)]
    cells, keep = mesh.cells, F.lit(True)
    for a, x in enumerate(AXES):
        unit = F.expr(f"shiftleft({mesh.block_nx[a]}L, level - 1)")
        keep = keep & (F.col(x) >= box[a][0] * unit) & (F.col(x) < box[a][1] * unit)
    cells = cells.where(keep)
    for a, x in enumerate(AXES):
        cells = cells.withColumn(x, F.col(x) - F.expr(f"shiftleft({box[a][0] * mesh.block_nx[a]}L, level - 1)"))
    return replace(
        mesh,
        domain_nx=tuple(s * b for s, b in zip(sides(box), mesh.block_nx, strict=True)),
        xmin=tuple(lo + b[0] * d for lo, b, d in zip(mesh.xmin, box, step, strict=True)),
        xmax=tuple(lo + b[1] * d for lo, b, d in zip(mesh.xmin, box, step, strict=True)),
        blocks=blocks,
        cells=cells,
    )
