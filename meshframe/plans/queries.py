"""One query for each operator of the engine, over meshes made from the driver's tables."""

from __future__ import annotations

import os
import uuid

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fields as A
from ..functions.keys import interleave, morton3
from ..operators import calculus, crop, forest, ghost, mesh, sample
from ..operators.lineage import shared_dir
from ..operators.mesh import BLOCK, KEY
from ..sources.codec import Header
from ..sources import snapshot
from . import fixtures as X

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
CROP = ((1, 2), (0, 2), (0, 1))
ORDER_NG = (2, 3, 4)
J = ("j1", "j2", "j3")


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def rounded(df: DataFrame, names: tuple[str, ...], digits: int = 9) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) + 0.0 for n in names})


def _ints(df: DataFrame) -> DataFrame:
    """Integers as BIGINT, so that both engines give one type."""
    return df.select(*[F.col(n).cast("long").alias(n) if t in ("int", "smallint") else F.col(n) for n, t in df.dtypes])


@query
def morton_encode(spark: SparkSession, d: str) -> DataFrame:
    p = X.table(spark, d, "lineitem")
    return p.select("l_orderkey", "l_linenumber", morton3(F.col("l_orderkey") % 1024, F.col("l_partkey") % 1024, F.col("l_suppkey") % 1024).alias("code"))


@query
def interleave_2d(spark: SparkSession, d: str) -> DataFrame:
    return X.table(spark, d, "orders").select("o_orderkey", "o_custkey", interleave(["o_orderkey", "o_custkey"]).alias("code"))


@query
def interleave_3d(spark: SparkSession, d: str) -> DataFrame:
    p = X.table(spark, d, "lineitem")
    return p.select("l_orderkey", "l_linenumber", interleave([F.col("l_orderkey") % 2097152, "l_partkey", "l_suppkey"]).alias("code"))


@query
def level1_order(spark: SparkSession, d: str) -> DataFrame:
    return forest.level1_order(spark, ORDER_NG)


@query
def morton_box(spark: SparkSession, d: str) -> DataFrame:
    box = F.col("b1").between(0, 1) & F.col("b2").between(1, 2) & F.col("b3").between(1, 2)
    return forest.level1_order(spark, ORDER_NG).where(box).select(*BLOCK, "morton")


@query
def morton_select(spark: SparkSession, d: str) -> DataFrame:
    every = forest.level1_order(spark, ORDER_NG)
    some = forest.level1_order(spark, (1, 2, 2), (1, 1, 1)).select(*BLOCK)
    return every.join(some, list(BLOCK)).select(*BLOCK, F.col("sfc").alias("position"))


def _nested(spark: SparkSession) -> DataFrame:
    return forest.decode(X.bits(spark, X.NESTED_BITS), forest.level1_order(spark, X.ROOTS))


@query
def forest_levels(spark: SparkSession, d: str) -> DataFrame:
    return _ints(_nested(spark).select("pos", "is_leaf", "level", *BLOCK))


@query
def leaf_order(spark: SparkSession, d: str) -> DataFrame:
    return _ints(_nested(spark).where("is_leaf").select("igrid", "pos", "level"))


@query
def root_positions(spark: SparkSession, d: str) -> DataFrame:
    return _nested(spark).where("level = 1").select("root", "pos")


@query
def root_first_leaf(spark: SparkSession, d: str) -> DataFrame:
    return forest.root_first_leaf(_nested(spark))


@query
def root_neighbors_periodic(spark: SparkSession, d: str) -> DataFrame:
    return _ints(forest.root_neighbors(forest.level1_order(spark, ORDER_NG), ORDER_NG, (True, False, True)))


def _blocks(spark: SparkSession) -> DataFrame:
    return forest.mesh_blocks(spark, X.bits(spark, X.REFINED_BITS), X.ROOTS)


@query
def neighbor_types(spark: SparkSession, d: str) -> DataFrame:
    return _ints(forest.neighbors(_blocks(spark), X.ROOTS).select("igrid", "d1", "d2", "d3", "ntype"))


@query
def face_neighbors(spark: SparkSession, d: str) -> DataFrame:
    n = forest.neighbors(_blocks(spark), X.ROOTS, faces_only=True)
    return _ints(n.select("igrid", "d1", "d2", "d3", "ntype", "nbr"))


@query
def neighbor_children(spark: SparkSession, d: str) -> DataFrame:
    return _ints(forest.neighbor_children(_blocks(spark), X.ROOTS))


@query
def phys_sides(spark: SparkSession, d: str) -> DataFrame:
    return _ints(forest.phys_sides(_blocks(spark), X.ROOTS))


@query
def check_tree(spark: SparkSession, d: str) -> DataFrame:
    return _ints(forest.check_tree(_nested(spark)))


@query
def leaves_per_level(spark: SparkSession, d: str) -> DataFrame:
    return _ints(_nested(spark).where("is_leaf").groupBy("level").agg(F.count(F.lit(1)).alias("n_leaves")))


def header() -> Header:
    return Header(
        domain_nx=(16, 16, 16), block_nx=(8, 8, 8), xmin=(0.0,) * 3, xmax=(16.0,) * 3, w_names=X.FIELDS, nleafs=15, nparents=1, levmax=2
    )


@query
def tree_offsets(spark: SparkSession, d: str) -> DataFrame:
    tree, blocks = header().offsets()
    return spark.range(1).select(F.lit(tree).cast("long").alias("offset_tree"), F.lit(blocks).cast("long").alias("offset_blocks"))


@query
def write_tree(spark: SparkSession, d: str) -> DataFrame:
    return _ints(forest.tree_rows(_blocks(spark), (8, 8, 8), len(X.FIELDS)))


@query
def write_forest(spark: SparkSession, d: str) -> DataFrame:
    leaves = _nested(spark).where("is_leaf").select("level", *BLOCK)
    return forest.encode(leaves, forest.level1_order(spark, X.ROOTS), 3)


@query
def crop_roots(spark: SparkSession, d: str) -> DataFrame:
    return crop.crop_roots(spark, ((0, 2), (1, 3), (1, 4)))


@query
def crop_forest(spark: SparkSession, d: str) -> DataFrame:
    return crop.crop_forest(_blocks(spark), CROP, 2)


@query
def crop_tree(spark: SparkSession, d: str) -> DataFrame:
    return _ints(crop.crop_tree(_blocks(spark), CROP))


@query
def crop_check(spark: SparkSession, d: str) -> DataFrame:
    return crop.crop_check(_blocks(spark), CROP)


@query
def crop_header(spark: SparkSession, d: str) -> DataFrame:
    m = crop.crop(X.refined_mesh(spark, d), CROP)
    rows = {f"{n}{a + 1}": F.lit(v[a]) for n, v in (("nx", m.domain_nx), ("xmin", m.xmin), ("xmax", m.xmax)) for a in range(3)}
    return _ints(m.leaves.agg(F.max("level").alias("levmax"), F.count(F.lit(1)).alias("nleafs")).withColumns(rows))


@query
def crop_cells(spark: SparkSession, d: str) -> DataFrame:
    m = crop.crop(X.refined_mesh(spark, d), CROP)
    return _ints(m.cells)


@query
def crop_neighbors(spark: SparkSession, d: str) -> DataFrame:
    m = crop.crop(X.refined_mesh(spark, d), CROP)
    return _ints(forest.neighbors(m.blocks, m.roots).select("igrid", "d1", "d2", "d3", "ntype", "nbr"))


@query
def crop_children(spark: SparkSession, d: str) -> DataFrame:
    m = crop.crop(X.refined_mesh(spark, d), CROP)
    return _ints(forest.neighbor_children(m.blocks, m.roots))


def _file(spark: SparkSession, m: mesh.Mesh | None = None, **header: object) -> str:
    """A new place in the shared folder, and the mesh written there."""
    path = snapshot.local(f"{shared_dir(spark)}/{uuid.uuid4().hex}.dat")
    os.makedirs(os.path.dirname(path), exist_ok=True)
    if m is not None:
        snapshot.write_snapshot(m, path, **header)
    return path


def _scan(spark: SparkSession, path: str, table: str, **options: str) -> DataFrame:
    spark.dataSource.register(snapshot.Snapshot)
    return _ints(spark.read.format("meshframe").options(table=table, **options).load(path))


HEADER = ("nleafs", "nparents", "levmax", "nw", "ndim", "it", "time", "offset_tree", "offset_blocks")


def _header(spark: SparkSession, path: str) -> DataFrame:
    return _scan(spark, path, "header").select(*HEADER, *[F.col("domain_nx")[a].cast("long").alias(f"nx{a + 1}") for a in range(3)])


@query
def snapshot_header(spark: SparkSession, d: str) -> DataFrame:
    return _header(spark, _file(spark, X.refined_mesh(spark, d), time=2.5))


@query
def snapshot_forest(spark: SparkSession, d: str) -> DataFrame:
    return _scan(spark, _file(spark, X.refined_mesh(spark, d)), "forest")


@query
def snapshot_blocks(spark: SparkSession, d: str) -> DataFrame:
    return _scan(spark, _file(spark, X.refined_mesh(spark, d)), "blocks")


@query
def snapshot_cells(spark: SparkSession, d: str) -> DataFrame:
    return _scan(spark, _file(spark, X.refined_mesh(spark, d)), "cells", blocks_a_task="4")


@query
def snapshot_fields(spark: SparkSession, d: str) -> DataFrame:
    return _scan(spark, _file(spark, X.refined_mesh(spark, d)), "cells", fields="b3,rho")


@query
def snapshot_open(spark: SparkSession, d: str) -> DataFrame:
    m = snapshot.open_snapshot(spark, _file(spark, X.refined_mesh(spark, d)))[1]
    return _ints(ghost.ghosted(m).where("NOT ghost").drop("ghost"))


@query
def metadata_only(spark: SparkSession, d: str) -> DataFrame:
    path = _file(spark)
    snapshot.write_metadata(X.refined_mesh(spark, d), path)
    return _scan(spark, path, "blocks")


@query
def rewritten_field(spark: SparkSession, d: str) -> DataFrame:
    m = X.refined_mesh(spark, d)
    path = _file(spark, m)
    snapshot.write_field(path, m.with_cells(m.cells.withColumn("b1", F.col("b1") * 2), m.fields), "b1")
    return _scan(spark, path, "cells", fields="m3,b1,b2")


def _copy(spark: SparkSession, d: str) -> str:
    path = _file(spark)
    snapshot.rewrite_header(_file(spark, X.refined_mesh(spark, d)), path, it=7, time=1.5, params=(1.5,), param_names=("gamma",))
    return path


@query
def rewritten_header(spark: SparkSession, d: str) -> DataFrame:
    return _header(spark, _copy(spark, d))


@query
def copied_blocks(spark: SparkSession, d: str) -> DataFrame:
    return _scan(spark, _copy(spark, d), "cells")


@query
def dense_round_trip(spark: SparkSession, d: str) -> DataFrame:
    m = X.uniform_mesh(spark, d)
    back = snapshot.mesh_from_arrays(spark, snapshot.dense(m), m.fields, m.xmin, m.xmax, m.block_nx)
    return _ints(mesh.split_to_blocks(back).drop("level"))


@query
def vtk_cells(spark: SparkSession, d: str) -> DataFrame:
    path = _file(spark).replace(".dat", ".vthb")
    snapshot.write_vtk(X.refined_mesh(spark, d), path)
    return snapshot.read_vtk(spark, path.removesuffix(".vthb")).where("field IN ('rho', 'b2')")


@query
def cropped_snapshot(spark: SparkSession, d: str) -> DataFrame:
    return _scan(spark, _file(spark, crop.crop(X.refined_mesh(spark, d), CROP)), "cells").drop("igrid")


@query
def blocks_from_uniform(spark: SparkSession, d: str) -> DataFrame:
    return mesh.split_to_blocks(X.uniform_mesh(spark, d)).drop("level")


@query
def project_fields(spark: SparkSession, d: str) -> DataFrame:
    return X.uniform_mesh(spark, d).cells.select("i", "j", "k", "rho", "b3")


@query
def load_interior(spark: SparkSession, d: str) -> DataFrame:
    return _ints(ghost.ghosted(X.refined_mesh(spark, d)).where("NOT ghost").drop("ghost"))


@query
def empty_mesh_cells(spark: SparkSession, d: str) -> DataFrame:
    return _ints(mesh.empty_cells(X.refined_mesh(spark, d), ("density", "magnetic_field")))


@query
def block_geometry(spark: SparkSession, d: str) -> DataFrame:
    return _ints(mesh.block_geometry(X.refined_mesh(spark, d)))


@query
def point_to_root(spark: SparkSession, d: str) -> DataFrame:
    return sample.root_position(X.refined_mesh(spark, d), X.points(spark, d)).select("pid", "u", "v", "w")


@query
def uniform_points(spark: SparkSession, d: str) -> DataFrame:
    return mesh.uniform_points(spark, *X.BOX)


@query
def locate_points(spark: SparkSession, d: str) -> DataFrame:
    return _ints(sample.locate(X.refined_mesh(spark, d), X.points(spark, d)).select("pid", "igrid", "level"))


@query
def locate_face_points(spark: SparkSession, d: str) -> DataFrame:
    return _ints(sample.locate(X.refined_mesh(spark, d), X.points(spark, d, 0.0)).select("pid", "igrid", "level"))


@query
def nearest_cell(spark: SparkSession, d: str) -> DataFrame:
    m = X.refined_mesh(spark, d)
    return _ints(sample.nearest_cell(m, sample.locate(m, X.points(spark, d, 0.0))).select("pid", *KEY))


@query
def sample_nearest(spark: SparkSession, d: str) -> DataFrame:
    return sample.sample_nearest(X.refined_mesh(spark, d), X.points(spark, d), "rho")


@query
def sample_linear(spark: SparkSession, d: str) -> DataFrame:
    return sample.sample_linear(X.refined_mesh(spark, d), X.points(spark, d), "rho")


@query
def coarsen(spark: SparkSession, d: str) -> DataFrame:
    return _ints(ghost.restrict(X.refined_mesh(spark, d)))


def _looked_up(spark: SparkSession, d: str) -> tuple[mesh.Mesh, DataFrame, DataFrame]:
    m = X.refined_mesh(spark, d)
    v = ghost.view(m)
    return m, v, ghost.looked_up(m, ghost.addresses(m, 2), v)


@query
def ghost_boundary(spark: SparkSession, d: str) -> DataFrame:
    outside = (F.col("i") != F.col("ci")) | (F.col("j") != F.col("cj")) | (F.col("k") != F.col("ck"))
    return _ints(_looked_up(spark, d)[2].where(outside & F.col("found")).select("igrid", *KEY, *X.FIELDS))


@query
def ghost_sibling(spark: SparkSession, d: str) -> DataFrame:
    m = X.refined_mesh(spark, d)
    met = ghost.looked_up(m, ghost.addresses(m, 2), m.cells)
    return _ints(met.where("found").select("igrid", *KEY, *X.FIELDS))


@query
def ghost_restrict(spark: SparkSession, d: str) -> DataFrame:
    m = X.refined_mesh(spark, d)
    met = ghost.looked_up(m, ghost.addresses(m, 2), ghost.restrict(m))
    return _ints(met.where("found").select("igrid", *KEY, *X.FIELDS))


@query
def ghost_prolong(spark: SparkSession, d: str) -> DataFrame:
    m, v, met = _looked_up(spark, d)
    return _ints(ghost.prolonged(m, met.where("NOT found").select("igrid", *KEY, "ci", "cj", "ck"), v))


@query
def minmod_slopes(spark: SparkSession, d: str) -> DataFrame:
    m, v, met = _looked_up(spark, d)
    up = [F.shiftright(f"c{x}", 1).alias(x) for x in "ijk"]
    wanted = met.where("NOT found").select((F.col("level") - 1).alias("level"), *up).distinct()
    return _ints(ghost.slopes(m, wanted, v))


@query
def ghost_fill(spark: SparkSession, d: str) -> DataFrame:
    return _ints(ghost.ghosts(X.refined_mesh(spark, d)))


def _current(m: mesh.Mesh) -> DataFrame:
    return calculus.current(m, ghost.ghosted(m))


@query
def curl_b(spark: SparkSession, d: str) -> DataFrame:
    return _ints(_current(X.refined_mesh(spark, d)).where("NOT ghost").drop("ghost"))


@query
def div_m(spark: SparkSession, d: str) -> DataFrame:
    m = X.refined_mesh(spark, d)
    return _ints(calculus.momentum_divergence(m, ghost.ghosted(m)).where("NOT ghost").drop("ghost"))


@query
def slab_with_boundary(spark: SparkSession, d: str) -> DataFrame:
    m = X.uniform_mesh(spark, d)
    one = mesh.Mesh(m.domain_nx, m.domain_nx, m.xmin, m.xmax, m.fields, forest.uniform_forest(spark, (1, 1, 1)), m.cells)
    return ghost.ghosted(one).select("i", "j", "k", *X.FIELDS)


@query
def resample_uniform(spark: SparkSession, d: str) -> DataFrame:
    m = X.refined_mesh(spark, d)
    return sample.resample(m, ghost.ghosted(m), mesh.uniform_points(spark, *X.BOX), X.BOX, X.BOX[2], m.fields)


@query
def resample_current(spark: SparkSession, d: str) -> DataFrame:
    m = X.refined_mesh(spark, d)
    return sample.resample(m, _current(m), mesh.uniform_points(spark, *X.BOX), X.BOX, X.BOX[2], J)


def _at_points(spark: SparkSession, d: str, cols: dict[str, Column]) -> DataFrame:
    return rounded(X.points(spark, d).withColumns(cols).select("pid", *cols), tuple(cols))


@query
def bipolar_a(spark: SparkSession, d: str) -> DataFrame:
    return _at_points(spark, d, A.bipolar_a(2.0, 1.5, 0.75))


@query
def bipolar_b(spark: SparkSession, d: str) -> DataFrame:
    return _at_points(spark, d, A.bipolar_b(1.5, 0.75))


@query
def dipolez_a(spark: SparkSession, d: str) -> DataFrame:
    return _at_points(spark, d, A.dipolez_a(3.0, (8.0, 8.0, -1.0)))


@query
def dipole_b(spark: SparkSession, d: str) -> DataFrame:
    return _at_points(spark, d, A.dipole_b((1.0, -2.0, 3.0), (8.0, 8.0, -1.0)))


@query
def monopole_b(spark: SparkSession, d: str) -> DataFrame:
    return _at_points(spark, d, A.monopole_b(5.0, (8.0, 8.0, -1.0)))


@query
def fan_a(spark: SparkSession, d: str) -> DataFrame:
    pts = mesh.uniform_points(spark, *X.SLAB)
    return rounded(A.fan_a(pts, X.sources(spark, d), ["p", "q", "r"]), ("a1", "a2", "a3"))


@query
def fan_b(spark: SparkSession, d: str) -> DataFrame:
    pts = mesh.uniform_points(spark, *X.BOX[:2], (5, 5, 5))
    return rounded(A.fan_b(pts, X.sources(spark, d), ["p", "q", "r"]), ("b1", "b2", "b3"))


@query
def fan_slab(spark: SparkSession, d: str) -> DataFrame:
    return rounded(A.fan_slab(X.sources(spark, d), *X.SLAB), ("b1", "b2", "b3"))


@query
def curl_slab(spark: SparkSession, d: str) -> DataFrame:
    m = X.uniform_mesh(spark, d)
    return calculus.curl_slab(m.cells, ("b1", "b2", "b3"), (1.0, 1.0, 1.0), J)


N_AXIS = 64


@query
def rbsl_a(spark: SparkSession, d: str) -> DataFrame:
    flux = A.rope_flux(1.5, 0.3, 1.0, 1.0)
    axis = A.ring_axis(spark, (0.25, 0.75, -0.5), 1.5, N_AXIS, 1.0)
    pts = mesh.uniform_points(spark, *X.SLAB)
    return rounded(A.rbsl_a(pts, axis, 0.3, flux, ["p", "q", "r"]), ("a1", "a2", "a3"))


@query
def tdm_slab(spark: SparkSession, d: str) -> DataFrame:
    out = A.tdm_slab(spark, *X.SLAB, n_axis=N_AXIS, r0=1.5, a0=0.3, q0=1.0, l0=1.0, d0=0.5)
    return rounded(out, ("b1", "b2", "b3"))
