"""Snapshots as a Spark data source, and the mesh's sinks.

spark.read.format("meshframe").option("table", "header|forest|blocks|cells").load(path): a cells scan has one task for each
run of blocks and reads only the bytes of the fields asked for (option `fields`). With the option `pushdown` and Spark's
spark.sql.python.filterPushdown.enabled, filters on igrid and level skip blocks before anything of them is read, and runs
without any such block get no task. A task reads the slice of the tree that names its blocks. Every executor must see the path.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path
from xml.etree import ElementTree

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    InputPartition,
    LessThan,
    LessThanOrEqual,
)

from ..operators import forest
from ..operators.mesh import AXES, BLOCK, KEY, Mesh, split_to_blocks
from . import codec

HEADER_SCHEMA = (
    "domain_nx array<int>, block_nx array<int>, xmin array<double>, xmax array<double>, w_names array<string>, nleafs int, nparents int, levmax int, "
    "datfile_version int, offset_tree int, offset_blocks int, nw int, ndir int, ndim int, it int, time double, periodic array<boolean>, geometry string, "
    "staggered boolean, physics_type string, n_par int, params array<double>, param_names array<string>, snapshotnext int, slicenext int, collapsenext int"
)
BLOCKS_A_TASK = 64


def local(path: str) -> str:
    return "/" + path.removeprefix("file:").lstrip("/") if path.startswith("file:") else path


@dataclass
class Run(InputPartition):
    """Blocks first..last of the tree; or the whole metadata."""

    first: int
    last: int


_TESTS = {EqualTo: "__eq__", GreaterThan: "__gt__", GreaterThanOrEqual: "__ge__", LessThan: "__lt__", LessThanOrEqual: "__le__"}


class SnapshotReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.table = local(options["path"]), options.get("table", "cells")
        self.names = tuple(x.strip() for x in options["fields"].split(",")) if options.get("fields") else None
        self.ghost = str(options.get("load_ghost", "false")).lower() == "true"
        self.step = int(options.get("blocks_a_task", BLOCKS_A_TASK))
        self.tests: list[tuple[str, str, int]] = []

    def _kept(self, level: np.ndarray, first: int = 0) -> np.ndarray:
        values = {"igrid": np.arange(first + 1, first + len(level) + 1), "level": level}
        ok = np.ones(len(level), dtype=bool)
        for name, test, value in self.tests:
            ok &= getattr(values[name], test)(value)
        return np.flatnonzero(ok)

    def partitions(self) -> list[InputPartition]:
        if self.table != "cells":
            return [Run(0, 0)]
        with open(self.path, "rb") as f:
            h = codec.read_header(f)
            runs = [Run(a, min(a + self.step, h.nleafs)) for a in range(0, h.nleafs, self.step)]
            if self.tests:
                kept = np.unique(self._kept(codec.read_tree(f, h)[0]) // self.step)
                runs = [runs[k] for k in kept.tolist()]
        return runs

    def read(self, run: Run) -> Iterator:
        with open(self.path, "rb") as f:
            h = codec.read_header(f)
            if self.table == "header":
                row = h.as_row()
                yield tuple(list(v) if isinstance(v, tuple) else v for v in (row[x.split()[0]] for x in HEADER_SCHEMA.split(", ")))
            elif self.table == "forest":
                yield pa.RecordBatch.from_pydict({"pos": np.arange(h.nleafs + h.nparents, dtype=np.int64), "is_leaf": codec.read_forest(f, h)})
            else:
                level, index, offset = codec.read_tree(f, h, run.first, run.last if self.table == "cells" else None)
                if self.table == "blocks":
                    cols = {"igrid": np.arange(1, h.nleafs + 1), "level": level.astype(np.int32), **{b: (index[:, a] - 1).astype(np.int64) for a, b in enumerate(BLOCK)}}
                    yield pa.RecordBatch.from_pydict({**cols, "offset": offset})
                    return
                for g in self._kept(level, run.first):
                    yield self._cells(f, h, run.first + int(g), int(level[g]), index[g] - 1, int(offset[g]))

    def _cells(self, f, h: codec.Header, g: int, level: int, index: np.ndarray, offset: int) -> pa.RecordBatch:
        low, _ = codec.block_ghosts(f, h, offset)
        arrays = codec.read_block(f, h, offset, self.names, self.ghost)
        shape = next(iter(arrays.values())).shape
        start = index * np.array(h.block_nx) - (low if self.ghost else 0)
        at = np.indices(shape).reshape(3, -1) + start[:, None]
        n = at.shape[1]
        cols = {"igrid": np.full(n, g + 1), "level": np.full(n, level, np.int32), **dict(zip(AXES, at.astype(np.int64), strict=True))}
        return pa.RecordBatch.from_pydict({**cols, **{k: v.reshape(-1) for k, v in arrays.items()}})


class FilteringReader(SnapshotReader):
    """Takes filters on igrid and level; Spark asks for them only where spark.sql.python.filterPushdown.enabled is set."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            name = getattr(f, "attribute", (None,))
            if type(f) in _TESTS and name in (("igrid",), ("level",)) and self.table == "cells":
                self.tests.append((name[0], _TESTS[type(f)], f.value))
            else:
                yield f


class Snapshot(DataSource):
    @classmethod
    def name(cls) -> str:
        return "meshframe"

    def schema(self) -> str:
        table = self.options.get("table", "cells")
        if table == "header":
            return HEADER_SCHEMA
        if table == "forest":
            return "pos long, is_leaf boolean"
        if table == "blocks":
            return "igrid long, level int, b1 long, b2 long, b3 long, offset long"
        if table != "cells":
            raise ValueError(f"no table {table}: header, forest, blocks or cells")
        with open(local(self.options["path"]), "rb") as f:
            names = codec.read_header(f).w_names
        if asked := self.options.get("fields"):
            names = tuple(x.strip() for x in asked.split(","))
        return "igrid long, level int, i long, j long, k long, " + ", ".join(f"`{x}` double" for x in names)

    def reader(self, schema) -> DataSourceReader:
        wanted = str(self.options.get("pushdown", "false")).lower() == "true"
        return (FilteringReader if wanted else SnapshotReader)(dict(self.options))


def open_snapshot(spark: SparkSession, path: str, fields: tuple[str, ...] | None = None) -> tuple[codec.Header, Mesh]:
    """A snapshot's header and its mesh; the driver reads the metadata only."""
    spark.dataSource.register(Snapshot)
    with open(local(path), "rb") as f:
        h = codec.read_header(f)
    at = lambda table, **o: spark.read.format("meshframe").options(table=table, **o).load(path)
    roots = tuple(a // b for a, b in zip(h.domain_nx, h.block_nx, strict=True))
    blocks = forest.mesh_blocks(spark, at("forest"), roots)
    names = fields or h.w_names
    cells = at("cells", fields=",".join(names)).select(*KEY, *names)
    return h, Mesh(h.domain_nx, h.block_nx, h.xmin, h.xmax, tuple(names), blocks, cells)


def mesh_from_arrays(
    spark: SparkSession, arrays: np.ndarray, names: tuple[str, ...], xmin: tuple, xmax: tuple, block_nx: tuple[int, int, int]
) -> Mesh:
    """A level-1 mesh of a dense array [x, y, z, field] that the driver holds."""
    if arrays.ndim != 4 or arrays.shape[3] != len(names):
        raise ValueError("the array must have the axes x, y, z and one entry a field")
    n = arrays.shape[:3]
    at = np.indices(n).reshape(3, -1)
    cols = {"level": np.ones(at.shape[1], np.int32), **dict(zip(AXES, at.astype(np.int64), strict=True))}
    cols |= {f: np.ascontiguousarray(arrays[..., k]).reshape(-1) for k, f in enumerate(names)}
    cells = spark.createDataFrame(pa.Table.from_pydict(cols))
    roots = tuple(a // b for a, b in zip(n, block_nx, strict=True))
    return Mesh(tuple(n), tuple(block_nx), tuple(xmin), tuple(xmax), tuple(names), forest.uniform_forest(spark, roots), cells)


def _payloads(mesh: Mesh) -> DataFrame:
    """(igrid, payload): each block's bytes, packed by the task that gathers its cells."""
    nx, names = mesh.block_nx, mesh.fields

    def pack(group: pa.Table) -> pa.Table:
        cols = {c: np.asarray(group[c]) for c in group.column_names}
        local_at = tuple(cols[x] % n for x, n in zip(AXES, nx, strict=True))
        arrays = []
        for f in names:
            a = np.zeros(nx)
            a[local_at] = cols[f]
            arrays.append(a)
        return pa.table({"igrid": cols["igrid"][:1], "payload": pa.array([codec.block_bytes(arrays)], pa.binary())})

    return split_to_blocks(mesh).groupBy("igrid").applyInArrow(pack, "igrid long, payload binary")


def header_of(mesh: Mesh, **changes: object) -> codec.Header:
    row = mesh.blocks.agg(F.max("level").alias("m"), F.sum(F.col("is_leaf").cast("int")).alias("n")).first()
    roots = mesh.roots[0] * mesh.roots[1] * mesh.roots[2]
    h = codec.Header(
        domain_nx=mesh.domain_nx, block_nx=mesh.block_nx, xmin=mesh.xmin, xmax=mesh.xmax, w_names=mesh.fields,
        nleafs=int(row.n), nparents=(int(row.n) - roots) // 7, levmax=int(row.m),
    )
    return h.updated(**changes)


def _metadata(mesh: Mesh, h: codec.Header) -> bytes:
    order = forest.level1_order(mesh.blocks.sparkSession, mesh.roots)
    bits = forest.encode(mesh.leaves.select("level", *BLOCK), order, h.levmax).orderBy("pos").toPandas()
    tree = mesh.leaves.orderBy("igrid").toPandas()
    return codec.metadata(h, bits["is_leaf"].to_numpy(), tree["level"].to_numpy(), tree[list(BLOCK)].to_numpy() + 1)


def write_metadata(mesh: Mesh, path: str, **changes: object) -> codec.Header:
    """Header, forest and tree only."""
    h = header_of(mesh, **changes)
    with open(path, "xb") as f:
        f.write(_metadata(mesh, h))
    return h


def write_snapshot(mesh: Mesh, path: str, **changes: object) -> codec.Header:
    """Write one file; an existing one is refused. Tasks pack blocks; the driver streams them to the file in curve
    order, a partition at a time."""
    h = header_of(mesh, **changes)
    size = codec.block_size(h)
    with open(path, "xb") as f:
        f.write(_metadata(mesh, h))
        for row in _payloads(mesh).orderBy("igrid").toLocalIterator():
            if len(row.payload) != size:
                raise AssertionError("a block has an unexpected size")
            f.write(row.payload)
    return h


def write_field(path: str, mesh: Mesh, field: str) -> None:
    """Overwrite one field of every block of a file that was written without ghost layers."""
    one = mesh.with_cells(mesh.cells.select(*KEY, field), (field,))
    with open(path, "r+b") as f:
        h = codec.read_header(f)
        _, _, offset = codec.read_tree(f, h)
        n = 8 * int(np.prod(h.block_nx))
        for row in _payloads(one).orderBy("igrid").toLocalIterator():
            f.seek(int(offset[row.igrid - 1]) + 8 * h.ndim + n * h.w_names.index(field))
            f.write(row.payload[8 * h.ndim :])


def rewrite_header(source: str, target: str, **changes: object) -> codec.Header:
    """Copy a file with header entries changed; blocks are copied as they are and their offsets are counted anew."""
    with open(source, "rb") as f, open(target, "xb") as out:
        old = codec.read_header(f)
        h = old.updated(**changes)
        level, index, offset = codec.read_tree(f, old)
        out.write(codec.metadata(h, codec.read_forest(f, old), level, index))
        for at in offset:
            low, high = codec.block_ghosts(f, old, int(at))
            if low.any() or high.any():
                raise ValueError("blocks with ghost layers can't be copied")
            f.seek(int(at))
            out.write(f.read(codec.block_size(old)))
    return h


def header_row(h: codec.Header) -> dict[str, object]:
    """A header as one flat row of numbers: what the tree and the blocks need."""
    plain = {c: getattr(h, c) for c in ("nleafs", "nparents", "levmax", "nw", "ndim", "it", "time")}
    tree, blocks = h.offsets()
    return plain | {"offset_tree": tree, "offset_blocks": blocks} | {f"nx{a + 1}": n for a, n in enumerate(h.domain_nx)}


def dense(mesh: Mesh) -> np.ndarray:
    """A uniform mesh's fields as one array [x, y, z, field] on the driver."""
    if mesh.blocks.where("level > 1").limit(1).count():
        raise ValueError("only a mesh of level-1 blocks is one dense array")
    t = mesh.cells.select(*AXES, *mesh.fields).toPandas()
    out = np.zeros((*mesh.domain_nx, len(mesh.fields)))
    for k, f in enumerate(mesh.fields):
        out[t["i"], t["j"], t["k"], k] = t[f]
    return out


def write_vtk(mesh: Mesh, path: str) -> list[str]:
    """A hierarchical VTK file (.vthb) and one image file for each leaf, written by the tasks that hold the leaves.

    All executors must see the folder. x runs fastest, each field is one double array.
    """
    root = Path(path)
    if root.suffix != ".vthb":
        raise ValueError("the file name must end in .vthb")
    folder = root.with_suffix("")
    os.makedirs(folder)
    nx, names, xmin = mesh.block_nx, mesh.fields, mesh.xmin
    dx = [(b - a) / n for a, b, n in zip(mesh.xmin, mesh.xmax, mesh.domain_nx, strict=True)]

    def save(group: pa.Table) -> pa.Table:
        c = {x: np.asarray(group[x]) for x in group.column_names}
        g, level = int(c["igrid"][0]), int(c["level"][0])
        low = [int(c[x].min()) for x in AXES]
        h = [d / 2 ** (level - 1) for d in dx]
        order = np.lexsort(tuple(c[x] for x in AXES))
        body = []
        for f in names:
            raw = np.ascontiguousarray(c[f][order], "<f8").tobytes()
            body.append(f'<DataArray type="Float64" Name="{f}" format="binary">{base64.b64encode(np.uint32(len(raw)).tobytes() + raw).decode()}</DataArray>')
        extent = " ".join(f"{a} {a + n}" for a, n in zip(low, nx, strict=True))
        head = f'<ImageData WholeExtent="{extent}" Origin="{xmin[0]} {xmin[1]} {xmin[2]}" Spacing="{h[0]} {h[1]} {h[2]}">'
        text = f'<VTKFile type="ImageData" version="0.1" byte_order="LittleEndian">{head}<Piece Extent="{extent}"><CellData>{"".join(body)}</CellData></Piece></ImageData></VTKFile>\n'
        (folder / f"{g}.vti").write_text(text)
        return pa.table({"igrid": [g], "level": pa.array([level], pa.int32()), **{x: [v] for x, v in zip(AXES, low, strict=True)}})

    done = split_to_blocks(mesh).groupBy("igrid").applyInArrow(save, "igrid long, level int, i long, j long, k long").orderBy("level", "igrid").collect()
    parts = []
    for level in sorted({r.level for r in done}):
        rows = [r for r in done if r.level == level]
        h = [d / 2 ** (level - 1) for d in dx]
        boxes = "".join(
            f'<DataSet index="{n}" amr_box="{" ".join(f"{r[x]} {r[x] + m - 1}" for x, m in zip(AXES, nx, strict=True))}" file="{folder.name}/{r.igrid}.vti"/>'
            for n, r in enumerate(rows)
        )
        parts.append(f'<Block level="{level - 1}" spacing="{h[0]} {h[1]} {h[2]}">{boxes}</Block>')
    head = '<VTKFile type="vtkOverlappingAMR" version="1.1" byte_order="LittleEndian">'
    root.write_text(f'{head}<vtkOverlappingAMR origin="{xmin[0]} {xmin[1]} {xmin[2]}" grid_description="XYZ">{"".join(parts)}</vtkOverlappingAMR></VTKFile>\n')
    return [str(root), *[str(folder / f"{r.igrid}.vti") for r in done]]


def read_vtk(spark: SparkSession, folder: str) -> DataFrame:
    """(igrid, field, i, j, k, value) of every image file that write_vtk wrote; one task a run of files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.vti").load(folder).select("path", "content")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                image = ElementTree.fromstring(content)[0]
                e = [int(x) for x in image.get("WholeExtent").split()]
                nx = [e[1] - e[0], e[3] - e[2], e[5] - e[4]]
                k, j, i = np.indices(nx[::-1]).reshape(3, -1)
                for array in image.iter("DataArray"):
                    value = np.frombuffer(base64.b64decode(array.text)[4:], "<f8")
                    at = {x: (v + low).astype(np.int64) for x, v, low in zip(AXES, (i, j, k), e[::2], strict=True)}
                    n = len(value)
                    yield pa.RecordBatch.from_pydict({"igrid": np.full(n, int(Path(path).stem)), "field": [array.get("Name")] * n, **at, "value": value})

    return files.mapInArrow(rows, "igrid long, field string, i long, j long, k long, value double")
