"""The binary snapshot source and the sinks: round trips."""

import random
import xml.etree.ElementTree as ET

import numpy as np
import pytest

from meshframe.operators import ghost
from meshframe.sources import codec, snapshot
from test_ghosts import make


@pytest.fixture(scope="module")
def refined(spark):
    rng = random.Random(11)
    return make(spark, [False, *[True] * 8, *[True] * 7], (2, 2, 2), 2, lambda *_: rng.random(), ("rho", "b1", "b2"))[0]


def values(df, fields):
    return {(r.level, r.i, r.j, r.k): tuple(r[f] for f in fields) for r in df.collect()}


def test_snapshot_round_trip(spark, refined, tmp_path):
    path = str(tmp_path / "a.dat")
    h = snapshot.write_snapshot(refined, path, time=2.5, params=(5 / 3,), param_names=("gamma",))
    with pytest.raises(FileExistsError):
        snapshot.write_snapshot(refined, path)
    back, m = snapshot.open_snapshot(spark, path)
    assert (back.nleafs, back.nparents, back.levmax, back.time, back.params) == (15, 1, 2, 2.5, (5 / 3,))
    assert (back.offset_tree, back.offset_blocks) == h.offsets()
    assert values(m.cells, m.fields) == values(refined.cells, refined.fields)
    assert ghost.ghosts(m).count() == ghost.ghosts(refined).count()
    one = snapshot.open_snapshot(spark, path, ("b2",))[1]
    assert one.cells.columns == ["level", "i", "j", "k", "b2"]
    for push in ("false", "true"):
        spark.conf.set("spark.sql.python.filterPushdown.enabled", push)
        some = spark.read.format("meshframe").options(table="cells", fields="rho", blocks_a_task="4", pushdown=push).load(path)
        assert some.where("igrid = 3").count() == 64 and some.where("level > 1").count() == 8 * 64
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    head = spark.read.format("meshframe").options(table="header").load(path).first()
    assert head.w_names == ["rho", "b1", "b2"] and head.domain_nx == [8, 8, 8] and head.time == 2.5
    tree = spark.read.format("meshframe").options(table="blocks").load(path)
    assert [r.offset for r in tree.orderBy("igrid").collect()] == [h.offsets()[1] + n * codec.block_size(h) for n in range(15)]


def test_fields_and_headers_can_be_rewritten(spark, refined, tmp_path):
    path, copy = str(tmp_path / "a.dat"), str(tmp_path / "b.dat")
    snapshot.write_snapshot(refined, path)
    twice = refined.with_cells(refined.cells.selectExpr("level", "i", "j", "k", "rho", "b1 * 2 AS b1", "b2"), refined.fields)
    snapshot.write_field(path, twice, "b1")
    assert values(snapshot.open_snapshot(spark, path)[1].cells, refined.fields) == values(twice.cells, refined.fields)
    h = snapshot.rewrite_header(path, copy, it=7, physics_type="hd")
    assert (h.it, h.physics_type) == (7, "hd")
    assert values(snapshot.open_snapshot(spark, copy)[1].cells, refined.fields) == values(twice.cells, refined.fields)
    with pytest.raises(ValueError):
        snapshot.rewrite_header(path, str(tmp_path / "c.dat"), nothing=1)


def test_dense_arrays(spark, tmp_path):
    a = np.random.default_rng(0).random((8, 4, 12, 2))
    m = snapshot.mesh_from_arrays(spark, a, ("rho", "e"), (0.0,) * 3, (1.0, 2.0, 3.0), (4, 4, 4))
    assert m.leaves.count() == 6
    path = str(tmp_path / "u.dat")
    snapshot.write_snapshot(m, path)
    back = snapshot.open_snapshot(spark, path)[1]
    assert (snapshot.dense(back) == a).all()
    with pytest.raises(ValueError):
        snapshot.mesh_from_arrays(spark, a[..., 0], ("rho",), (0.0,) * 3, (1.0,) * 3, (4, 4, 4))


def test_blocks_with_ghost_layers_and_old_versions(tmp_path):
    h = codec.Header((4, 4, 4), (4, 4, 4), (0.0,) * 3, (1.0,) * 3, ("rho", "e"), nleafs=1)
    full = np.arange(2 * 6 * 5 * 4, dtype=float).reshape(2, 6, 5, 4)
    path = tmp_path / "g.dat"
    with path.open("wb") as f:
        f.write(codec.metadata(h, np.array([True]), np.array([1]), np.array([[1, 1, 1]])))
        f.write(np.array([1, 1, 0, 1, 0, 0], "<i4").tobytes() + b"".join(x.tobytes(order="F") for x in full))
    with path.open("rb") as f:
        h2 = codec.read_header(f)
        got = codec.read_block(f, h2, h.offsets()[1], ("e",))
        assert (got["e"] == full[1][1:5, 1:5, :]).all()
        assert (codec.read_block(f, h2, h.offsets()[1], None, True)["rho"] == full[0]).all()
    with pytest.raises(ValueError):
        codec.Header((4,) * 3, (4,) * 3, (0.0,) * 3, (1.0,) * 3, ("rho",), datfile_version=2)
    three = codec.Header((4,) * 3, (4,) * 3, (0.0,) * 3, (1.0,) * 3, ("rho",), nleafs=1, datfile_version=3)
    (tmp_path / "v3.dat").write_bytes(codec.metadata(three, np.array([True]), np.array([1]), np.array([[1, 1, 1]])))
    with (tmp_path / "v3.dat").open("rb") as f:
        assert codec.read_header(f).staggered is False


def test_vtk(refined, tmp_path):
    files = snapshot.write_vtk(refined, str(tmp_path / "m.vthb"))
    assert len(files) == 16
    top = ET.parse(files[0]).getroot()
    assert [len(b) for b in top.iter("Block")] == [7, 8]
    image = ET.parse(files[1]).getroot()
    assert [d.get("Name") for d in image.iter("DataArray")] == ["rho", "b1", "b2"]
