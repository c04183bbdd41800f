"""Readers and writers of little-endian record files.

One Python data source reads any section of fixed-width records in parallel byte ranges and streams it as Arrow batches;
every file kind is a composition of sections.  Parquet is the native format; these are for exchange.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import ArrayType, DoubleType, FloatType, LongType, StructField, StructType

from ..operators.ranking import with_rank
from ..shipping import ship
from ..storage import materialise

SOURCE = "record_file"
BATCH_BYTES = 4 << 20
#: Bytes of a file that one task reads, about.
SPLIT_BYTES = 64 << 20


def _file_system(path: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if "://" not in path and not path.startswith("file:"):
        return pa.fs.LocalFileSystem(), path
    return pa.fs.FileSystem.from_uri(path.replace("file:/", "file:///") if path.startswith("file:/") and not path.startswith("file://") else path)


def _open(path: str):
    fs, inner = _file_system(path)
    return fs.open_input_file(inner)


def file_size(path: str) -> int:
    with _open(path) as f:
        return f.size()


def header(path: str, n: int, offset: int = 0, kind: str = "i") -> tuple[int, ...]:
    with _open(path) as f:
        f.seek(offset)
        return struct.unpack(f"<{n}{kind}", f.read(4 * n))


@dataclass
class Range(InputPartition):
    first: int
    last: int


class RecordReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.dtype = options["path"], np.dtype(options["dtype"])
        self.offset, self.skip, self.width = int(options.get("offset", 0)), int(options.get("skip", 0)), int(options["width"])
        self.size = self.skip + self.width * self.dtype.itemsize
        room = (file_size(self.path) - self.offset) // self.size
        self.count = int(options["count"]) if "count" in options else room
        if self.count > room:
            raise ValueError(f"{self.path}: {self.count} records of {self.size} bytes from byte {self.offset} do not fit")

    def partitions(self) -> list[Range]:
        per = max(1, SPLIT_BYTES // self.size)
        return [Range(a, min(a + per, self.count)) for a in range(0, self.count, per)] or [Range(0, 0)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        per = max(1, BATCH_BYTES // self.size)
        floats = self.dtype.kind == "f"
        with _open(self.path) as f:
            for a in range(part.first, part.last, per):
                b = min(a + per, part.last)
                f.seek(self.offset + a * self.size)
                raw = np.frombuffer(f.read((b - a) * self.size), np.uint8).reshape(b - a, self.size)[:, self.skip :]
                flat = np.ascontiguousarray(raw).view(self.dtype).ravel()
                flat = flat.astype(np.float64 if self.dtype.itemsize == 8 else np.float32) if floats else flat.astype(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, self.width, dtype=np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(a, b)), lists], ["id", "vals"])


class RecordSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return SOURCE

    def schema(self) -> StructType:
        kind = np.dtype(self.options["dtype"])
        element = (DoubleType() if kind.itemsize == 8 else FloatType()) if kind.kind == "f" else LongType()
        return StructType([StructField("id", LongType()), StructField("vals", ArrayType(element))])

    def reader(self, schema: StructType) -> RecordReader:
        return RecordReader(self.options)


def records(spark: SparkSession, path: str, dtype: str, width: int, *, offset: int = 0, skip: int = 0, count: int | None = None) -> DataFrame:
    """(id, vals): `count` records of `width` numbers from byte `offset`, each after `skip` bytes; id is the place."""
    ship(spark)
    spark.dataSource.register(RecordSource)
    reader = spark.read.format(SOURCE).option("dtype", dtype).option("width", width).option("offset", offset).option("skip", skip)
    return (reader if count is None else reader.option("count", count)).load(path)


def _spread(rows: DataFrame, names: list[str]) -> DataFrame:
    return rows.select("id", *[F.col("vals")[j].alias(n) for j, n in enumerate(names)])


def read_fvecs(spark: SparkSession, path: str) -> DataFrame:
    """(id, vec) of float vectors, each led by its dimension."""
    (dim,) = header(path, 1)
    return records(spark, path, "<f4", dim, skip=4).withColumnRenamed("vals", "vec")


def read_ivecs(spark: SparkSession, path: str) -> DataFrame:
    """(id, nbrs): lists of the same length, each led by it."""
    (k,) = header(path, 1)
    return records(spark, path, "<u4", k, skip=4).withColumnRenamed("vals", "nbrs")


def read_matrix(spark: SparkSession, path: str, dtype: str, out: str = "vals") -> DataFrame:
    """(id, vals) of a file with number of rows and width before the rows: byte vectors, graphs, truth."""
    n, width = header(path, 2, kind="I")
    if 8 + n * width * np.dtype(dtype).itemsize != file_size(path):
        raise ValueError(f"{path}: {n} x {width} numbers are not what the file holds")
    return records(spark, path, dtype, width, offset=8, count=n).withColumnRenamed("vals", out)


def read_u8bin(spark: SparkSession, path: str, *, as_float: bool = True) -> DataFrame:
    kind = "array<float>" if as_float else "array<smallint>"
    return read_matrix(spark, path, "<u1", "vec").withColumn("vec", F.col("vec").cast(kind))


def read_attributes(spark: SparkSession, path: str, dtype: str = "<i4") -> DataFrame:
    """(id, a0, a1, ...); a file of another length than its header says is refused."""
    rows = read_matrix(spark, path, dtype)
    return _spread(rows, [f"a{j}" for j in range(header(path, 2, kind="I")[1])])


def read_ranges(spark: SparkSession, path: str, attributes: int = 1, dtype: str = "<u4") -> DataFrame:
    """(qid, l0, r0, ...) of closed intervals."""
    rows = records(spark, path, dtype, 2 * attributes)
    return _spread(rows, [f"{s}{j}" for j in range(attributes) for s in "lr"]).withColumnRenamed("id", "qid")


def read_graph(spark: SparkSession, path: str) -> DataFrame:
    """(src, rank, dst)."""
    rows = read_matrix(spark, path, "<u4", "nbrs")
    return rows.select(F.col("id").alias("src"), F.posexplode("nbrs").alias("rank", "dst")).select("src", (F.col("rank") + 1).cast("long").alias("rank"), "dst")


def read_cell_graphs(spark: SparkSession, prefix: str, suffix: str, cells: int) -> DataFrame:
    """(cell_id, src, rank, dst) of one file per cell, numbered from 0; cell-local ids become places in the concatenation."""
    start, out = 0, None
    for c in range(cells):
        path = f"{prefix}{c}{suffix}"
        one = read_graph(spark, path).select(F.lit(c).cast("long").alias("cell_id"), (F.col("src") + start).alias("src"), "rank", (F.col("dst") + start).alias("dst"))
        start += header(path, 1, kind="I")[0]
        out = one if out is None else out.unionByName(one)
    return out


def read_cross_graph(spark: SparkSession, path: str, per_cell: int, starts: list[int], *, transposed: bool = False) -> DataFrame:
    """(src, dst_cell, rank, dst): neighbours in every cell, given as ids inside it, row-major or cell by cell."""
    n, width = header(path, 2, kind="I")
    start = F.array(*[F.lit(s).cast("long") for s in starts])
    rows = records(spark, path, "<u4", per_cell if transposed else width, offset=8, count=n * (width // per_cell) if transposed else n)
    long = rows.select("id", F.posexplode("vals").alias("p", "v"))
    if transposed:
        src, cell, rank = F.col("id") % n, F.floor(F.col("id") / n), F.col("p") + 1
    else:
        src, cell, rank = F.col("id"), F.floor(F.col("p") / per_cell), F.col("p") % per_cell + 1
    cell = cell.cast("long")
    return long.select(src.alias("src"), cell.alias("dst_cell"), rank.cast("long").alias("rank"), (F.col("v") + F.get(start, cell.cast("int"))).alias("dst"))


def read_numbers(spark: SparkSession, path: str, out: str) -> DataFrame:
    """(id, out) of a file with the number of rows before them: cluster labels, query ids."""
    (n,) = header(path, 1, kind="I")
    return _spread(records(spark, path, "<u4", 1, offset=4, count=n), [out])


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """(qid, rank, id)."""
    return read_graph(spark, path).select(F.col("src").alias("qid"), "rank", F.col("dst").alias("id"))


def read_grid(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """bounds (dim, bucket, lo, hi) and point cells (id, b0, ..., cell_id)."""
    n, dims = header(path, 2)
    shape = header(path, dims, 8)
    at, edges, cells = 8 + 4 * dims, None, None
    for j, s in enumerate(shape):
        low = _spread(records(spark, path, "<i4", 1, offset=at, count=s), ["lo"])
        high = _spread(records(spark, path, "<i4", 1, offset=at + 4 * s, count=s), ["hi"])
        one = low.join(high, "id").select(F.lit(j).cast("long").alias("dim"), F.col("id").alias("bucket"), "lo", "hi")
        edges = one if edges is None else edges.unionByName(one)
        own = _spread(records(spark, path, "<i4", 1, offset=at + 8 * s, count=n), [f"b{j}"])
        cells = own if cells is None else cells.join(own, "id")
        at += 8 * s + 4 * n
    return edges, cells.join(_spread(records(spark, path, "<i4", 1, offset=at, count=n), ["cell_id"]), "id")


def read_quantised(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """codes (id, codes) and parameters (dim, scale, zp)."""
    n, dim = header(path, 2, kind="I")
    scales = records(spark, path, "<f4", 1, offset=8, count=dim)
    zeros = records(spark, path, "<i4", 1, offset=8 + 4 * dim, count=dim)
    both = scales.select("id", F.col("vals")[0].cast("double").alias("scale")).join(zeros.select("id", F.col("vals")[0].alias("zp")), "id")
    codes = records(spark, path, "<i1", dim, offset=8 + 8 * dim, count=n).select("id", F.col("vals").cast("array<tinyint>").alias("codes"))
    return codes, both.withColumnRenamed("id", "dim")


#: Rows that a task encodes at one time.
ROWS_AT_ONCE = 1 << 14
COPY_BYTES = 8 << 20


class _Sink:
    """Writes one file, its numbers from the driver and its rows from the tasks that hold them.

    Every row has as many bytes and knows its place, so each task encodes its rows and writes them where they belong: into the file itself where the folder is mounted on all machines, and
    elsewhere, as on object stores, into parts beside it, whose bytes are copied one after another when the file is closed.  A task that is run again writes the same bytes again.
    """

    def __init__(self, path: str):
        self.path = path
        self.fs, self.inner = _file_system(path)
        self.mounted = isinstance(self.fs, pa.fs.LocalFileSystem)
        self.fs.create_dir(self.inner.rsplit("/", 1)[0], recursive=True)
        self.at = 0
        self.parts: list[bytes | str] = []
        if self.mounted:
            open(self.inner, "wb").close()

    def __enter__(self) -> _Sink:
        return self

    def __exit__(self, failed: type | None, *_: object) -> None:
        if self.mounted or failed:
            return
        with self.fs.open_output_stream(self.inner) as out:
            for part in self.parts:
                if isinstance(part, bytes):
                    out.write(part)
                    continue
                with self.fs.open_input_stream(part) as source:
                    while block := source.read(COPY_BYTES):
                        out.write(block)
        if any(isinstance(p, str) for p in self.parts):
            self.fs.delete_dir(f"{self.inner}.parts")

    def numbers(self, values: list | tuple | np.ndarray, dtype: str) -> None:
        raw = np.asarray(values, dtype).tobytes()
        if self.mounted:
            with open(self.inner, "r+b") as f:
                f.seek(self.at)
                f.write(raw)
        else:
            self.parts.append(raw)
        self.at += len(raw)

    def rows(self, df: DataFrame, order: list[str], value: str, dtype: str, *, lead: bool = False) -> None:
        """The values, numbers or lists of as many each, in the order named; with lead each after its length."""
        ship(df.sparkSession)
        listed = isinstance(df.schema[value].dataType, ArrayType)
        rows = df.select(*order, (F.col(value) if listed else F.array(value)).alias("_value"))
        ranked = with_rank(rows, order, "_at").select("_at", "_value")
        sizes = ranked.agg(F.count(F.lit(1)).alias("n"), F.min(F.size("_value")).alias("least"), F.max(F.size("_value")).alias("most")).first()
        if not sizes["n"]:
            return
        if sizes["least"] != sizes["most"]:
            raise ValueError(f"rows of {value} have {sizes['least']} to {sizes['most']} numbers; a file has as many in each")
        width, base, mounted, fs, inner = sizes["most"], self.at, self.mounted, self.fs, self.inner
        row_bytes = width * np.dtype(dtype).itemsize + 4 * lead
        folder = f"{inner}.parts/{base}"
        if not mounted:
            fs.create_dir(folder, recursive=True)

        def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            f = open(inner, "r+b") if mounted else None
            named: list[tuple[str, int, int]] = []
            for batch in batches:
                for i in range(0, len(batch), ROWS_AT_ONCE):
                    part = batch.slice(i, ROWS_AT_ONCE)
                    place = part.column(0).to_numpy()
                    values = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(dtype).reshape(len(part), width)
                    raw = np.empty((len(part), row_bytes), np.uint8)
                    if lead:
                        raw[:, :4] = np.full(len(part), width, "<i4").view(np.uint8).reshape(-1, 4)
                    raw[:, 4 * lead :] = values.view(np.uint8).reshape(len(part), -1)
                    order_ = np.argsort(place, kind="stable")
                    place, raw = place[order_], raw[order_]
                    cut = np.flatnonzero(np.diff(place) != 1) + 1
                    for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(place)]):
                        if mounted:
                            f.seek(base + int(place[a]) * row_bytes)
                            f.write(raw[a:b].tobytes())
                            named.append(("", int(place[a]), b - a))
                        else:
                            name = f"{folder}/{int(place[a]):020d}"
                            with fs.open_output_stream(name) as out:
                                out.write(raw[a:b].tobytes())
                            named.append((name, int(place[a]), b - a))
            if f is not None:
                f.close()
                named = [("", 0, sum(n for _, _, n in named))]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in named], pa.string()), pa.array([x[1] for x in named], pa.int64()), pa.array([x[2] for x in named], pa.int64())], ["part", "place", "n"])

        written = ranked.mapInArrow(write, "part string, place long, n long")
        if mounted:
            done = written.agg(F.sum("n").alias("n")).first()["n"]
        else:
            found = written.orderBy("place").collect()  # one row a part of some thousand rows
            self.parts += [r["part"] for r in found]
            done = sum(r["n"] for r in found)
        if done != sizes["n"]:
            raise OSError(f"{done} of {sizes['n']} rows were written to {self.path}")
        self.at = base + sizes["n"] * row_bytes


def write_fvecs(points: DataFrame, path: str) -> None:
    with _Sink(path) as out:
        out.rows(points, ["id"], "vec", "<f4", lead=True)


def write_ivecs(lists: DataFrame, path: str, value: str = "nbrs", order: str = "id") -> None:
    """Lists of the same length, each led by it."""
    with _Sink(path) as out:
        out.rows(lists, [order], value, "<u4", lead=True)


def write_u8bin(points: DataFrame, path: str) -> None:
    write_matrix(points, path, "vec", "<u1")


def write_matrix(df: DataFrame, path: str, value: str, dtype: str, order: str = "id") -> None:
    """Rows of equal width, after their number and width."""
    n = df.count()
    width = len(df.select(value).first()[0]) if n else 0
    with _Sink(path) as out:
        out.numbers([n, width], "<u4")
        out.rows(df, [order], value, dtype)


def write_attributes(df: DataFrame, path: str, attributes: int, dtype: str = "<i4") -> None:
    write_matrix(df.select("id", F.array(*[f"a{j}" for j in range(attributes)]).alias("v")), path, "v", dtype)


def write_ranges(df: DataFrame, path: str, attributes: int, dtype: str = "<u4") -> None:
    with _Sink(path) as out:
        out.rows(df.select("qid", F.array(*[f"{s}{j}" for j in range(attributes) for s in "lr"]).alias("v")), ["qid"], "v", dtype)


def write_graph(edges: DataFrame, path: str, src: str = "src", dst: str = "dst") -> None:
    lists = edges.groupBy(src).agg(F.sort_array(F.collect_list(F.struct("rank", dst))).alias("n"))
    # Written first, as rows are counted, looked at and ranked before they are encoded, and each would make the lists anew.
    write_matrix(materialise(lists.select(src, F.transform("n", lambda s: s[dst]).alias("nbrs")), "lists"), path, "nbrs", "<u4", src)


def write_truth(truth: DataFrame, path: str) -> None:
    """Rows (qid, rank, id) as lists of ids in the order of qid; every query needs the same number of them."""
    write_graph(truth.withColumnRenamed("id", "dst"), path, "qid")


def write_cell_graphs(edges: DataFrame, local: DataFrame, prefix: str, suffix: str, cells: int) -> None:
    """One file per cell, numbered from 0, of the edges (src, rank, dst) inside it, by the places of points (id, cell_id, local_id) in their cell."""
    of = local.select("id", "cell_id", "local_id")
    ends = edges.select("src", "rank", "dst").join(of.withColumnsRenamed({"id": "src", "local_id": "s"}), "src").join(of.drop("cell_id").withColumnsRenamed({"id": "dst", "local_id": "d"}), "dst")
    lists = ends.groupBy("cell_id", "s").agg(F.sort_array(F.collect_list(F.struct("rank", "d"))).alias("n")).select("cell_id", "s", F.transform("n", lambda x: x["d"]).alias("n"))

    def write(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("s")
        nbrs = table["n"].combine_chunks()
        flat = nbrs.flatten().to_numpy(zero_copy_only=False).astype("<u4")
        if len(flat) % len(table):
            raise ValueError("points of a cell have different numbers of neighbours")
        _write_whole(f"{prefix}{key[0].as_py()}{suffix}", [len(table), len(flat) // len(table)], flat)
        return pa.table({"cell_id": pa.array([key[0].as_py()], pa.int64())})

    written = {r["cell_id"] for r in lists.groupBy("cell_id").applyInArrow(write, "cell_id long").collect()}  # of as many cells as the grid has
    for c in set(range(cells)) - written:
        _write_whole(f"{prefix}{c}{suffix}", [0, 0], np.zeros(0, "<u4"))


def _write_whole(path: str, head: list[int], flat: np.ndarray) -> None:
    fs, inner = _file_system(path)
    fs.create_dir(inner.rsplit("/", 1)[0], recursive=True)
    with fs.open_output_stream(inner) as out:
        out.write(np.array(head, "<u4").tobytes() + flat.tobytes())


def write_compressed(reps: DataFrame, cross: DataFrame, path: str) -> None:
    """Representatives (id, rep_id) of all points by place, then the cross edges (src, dst_cell, rank, dst) of representatives only, in order of src.

    The file holds the number of points, of representatives and of edges each has, the representative of each point, the representatives, and their edges.
    """
    kept = cross.groupBy("src").agg(F.sort_array(F.collect_list(F.struct("dst_cell", "rank", "dst"))).alias("e"))
    kept = kept.select("src", F.flatten(F.transform("e", lambda x: F.array(x["dst_cell"], x["rank"], x["dst"]))).alias("e"))
    width = kept.select(F.size("e")).first()[0]
    with _Sink(path) as out:
        out.numbers([reps.count(), kept.count(), width], "<u4")
        out.rows(reps, ["id"], "rep_id", "<u4")
        out.rows(kept, ["src"], "src", "<u4")
        out.rows(kept, ["src"], "e", "<u4")


def read_compressed(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Representatives (id, rep_id) and their cross edges (src, dst_cell, rank, dst)."""
    n, m, width = header(path, 3, kind="I")
    reps = _spread(records(spark, path, "<u4", 1, offset=12, count=n), ["rep_id"])
    sources = _spread(records(spark, path, "<u4", 1, offset=12 + 4 * n, count=m), ["src"])
    lists = records(spark, path, "<u4", width, offset=12 + 4 * (n + m), count=m).join(sources, "id")
    each = F.explode(F.sequence(F.lit(0), F.lit(width - 3), F.lit(3))).alias("p")
    return reps, lists.select("src", "vals", each).select("src", *[F.get("vals", F.col("p") + j).alias(c) for j, c in enumerate(("dst_cell", "rank", "dst"))])


def write_numbers(df: DataFrame, path: str, value: str, order: str = "id") -> None:
    with _Sink(path) as out:
        out.numbers([df.count()], "<u4")
        out.rows(df, [order], value, "<u4")


def write_grid(gridded: DataFrame, edges: DataFrame, shape: list[int], path: str) -> None:
    with _Sink(path) as out:
        out.numbers([gridded.count(), len(shape), *shape], "<i4")
        for j, s in enumerate(shape):
            own = {r["bucket"]: r for r in edges.filter(F.col("dim") == j).collect()}  # as many rows as buckets
            for side in ("lo", "hi"):
                out.numbers([own[b][side] if b in own else 0 for b in range(s)], "<i4")
            out.rows(gridded, ["id"], f"b{j}", "<i4")
        out.rows(gridded, ["id"], "cell_id", "<i4")


def write_quantised(coded: DataFrame, parameters: DataFrame, path: str) -> None:
    rows = parameters.orderBy("dim").collect()  # a vector's width
    with _Sink(path) as out:
        out.numbers([coded.count(), len(rows)], "<u4")
        out.numbers([r["scale"] for r in rows], "<f4")
        out.numbers([r["zp"] for r in rows], "<i4")
        out.rows(coded, ["id"], "codes", "<i1")


def exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target))


def load_or_build(spark: SparkSession, path: str, build) -> DataFrame:
    """The Parquet table at path, made by build() if it is not there yet."""
    if not exists(spark, path + "/_SUCCESS"):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
