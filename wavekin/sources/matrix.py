"""Headerless binary matrices: little-endian float32, float64, uint8, int8 or int64 rows of n values.

``spark.read.format("series_matrix")`` gives (series_id, values); a row's id is its place in
the file, or for a folder of parts written by ``write_matrix`` the first id in the part's
name plus the place. It reads ranges of files in parallel through ``pyarrow.fs``, which knows local
and shared file systems by their URI. Stores that only Spark reaches are read with
``read_remote`` through Spark's ``binaryFile`` reader; ``read_matrix`` chooses. ``pyarrow`` uses
its own credentials, not those of Spark's configuration.

``df.write.format("series_matrix")`` writes (series_id, values) rows as one file for each run of
consecutive ids that a task has, a batch at a time. Files lie in a hidden folder until all tasks are done; the
commit moves them to ``rows-<first id>.bin``, and an abort deletes the folder, so neither a killed task nor a failed job leaves a part.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

DTYPES = {"float32": "<f4", "float64": "<f8", "uint8": "u1", "int8": "i1", "int64": "<i8"}
#: Bytes of a file that one task reads, about.
SPLIT = 64 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, else one in the warehouse; in local mode a local one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if spark.sparkContext.master.startswith("local"):
        return "/tmp/checkpoints/wavekin"
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"


def _file_system(path: str) -> tuple[fs.FileSystem, str]:
    """(file system, path in it) of a URI or a local path."""
    return fs.FileSystem.from_uri(path) if ":" in path.split("/", 1)[0] else (fs.LocalFileSystem(), path)


def _first_id(name: str) -> int:
    return int(name.split("-")[1].split(".")[0]) if name.startswith("rows-") else 0


class _Rows(InputPartition):
    def __init__(self, path: str, first: int, count: int, base: int):
        self.path, self.first, self.count, self.base = path, first, count, base


class _MatrixReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.n, self.dtype = int(options["n"]), np.dtype(DTYPES[options.get("dtype", "float32")])
        self.limit = int(options["rows"]) if "rows" in options else None

    def partitions(self):
        width = self.n * self.dtype.itemsize
        store, place = _file_system(self.path)
        info = store.get_file_info(place)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        files = [info] if info.is_file else sorted((f for f in store.get_file_info(fs.FileSelector(place)) if f.base_name.startswith("rows-")), key=lambda f: f.base_name)
        parts, have = [], 0
        for f in files:
            rows = f.size // width  # an incomplete last row is dropped
            have += rows
            step = max(1, SPLIT // width)
            for first in range(0, rows, step):
                parts.append(_Rows(f.path, first, min(step, rows - first), _first_id(f.base_name) if not info.is_file else 0))
        if self.limit is not None:
            if have < self.limit:
                raise ValueError(f"{self.limit} rows are asked for, the file has {have}")
            for p in parts:
                p.count = max(0, min(p.count, self.limit - p.base - p.first))
        return parts or [_Rows("", 0, 0, 0)]

    def read(self, part):
        if not part.count:
            return
        width = self.n * self.dtype.itemsize
        with _file_system(self.path)[0].open_input_file(part.path) as f:
            f.seek(part.first * width)
            data = np.frombuffer(f.read(part.count * width), self.dtype).reshape(-1, self.n)
        for lo in range(0, len(data), 4096):
            block = data[lo : lo + 4096].astype(np.float64)
            ids = pa.array(np.arange(lo, lo + len(block)) + part.base + part.first)
            offsets = pa.array(np.arange(0, block.size + 1, self.n, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(offsets, pa.array(block.ravel()))], ["series_id", "values"])


class _Written(WriterCommitMessage):
    def __init__(self, files: list[tuple[str, str]]):
        self.files = files


class _MatrixWriter(DataSourceArrowWriter):
    def __init__(self, options, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.n, self.kind = int(options["n"]), DTYPES[options.get("dtype", "float32")]
        self.job = uuid.uuid4().hex
        store, place = _file_system(self.path)
        store.create_dir(f"{place}/.{self.job}", recursive=True)

    def write(self, batches: Iterator[pa.RecordBatch]) -> _Written:
        """One hidden file for each run of consecutive ids, so a task holds one batch. The rows of a task are in order of their ids."""
        store, place = _file_system(self.path)
        files, out, following = [], None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, lists = batch.column(batch.schema.get_field_index("series_id")).to_numpy(), batch.column(batch.schema.get_field_index("values"))
            if set(lists.value_lengths().to_pylist()) != {self.n}:
                raise ValueError(f"series of other lengths than {self.n}")
            data = lists.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, self.n)
            if np.dtype(self.kind).kind in "iu":
                data = np.rint(data)
            cuts = [0, *(np.flatnonzero(np.diff(ids) != 1) + 1).tolist(), len(ids)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if out is None or ids[lo] != following:
                    if following is not None and ids[lo] < following:
                        raise ValueError("ids are not in ascending order or repeat")
                    if out is not None:
                        out.close()
                    # a task that outlives an abort finds no folder to write into
                    name = f"{place}/.{self.job}/{uuid.uuid4().hex}"
                    files.append((name, f"{place}/rows-{int(ids[lo]):012d}.bin"))
                    out = store.open_output_stream(name)
                out.write(data[lo:hi].astype(self.kind).tobytes())
                following = ids[hi - 1] + 1
        if out is not None:
            out.close()
        return _Written(files)

    def commit(self, messages: list[_Written | None]) -> None:
        store, place = _file_system(self.path)
        files = [f for m in messages if m is not None for f in m.files]
        targets = [target for _, target in files]
        if len(set(targets)) != len(targets):
            self.abort(messages)
            raise ValueError("an id is in several tasks")
        if self.overwrite:
            for f in store.get_file_info(fs.FileSelector(place)):
                if f.base_name.startswith("rows-"):
                    store.delete_file(f.path)
        for name, target in files:
            store.move(name, target)
        self._clean(store, place)

    def abort(self, messages: list[_Written | None]) -> None:
        self._clean(*_file_system(self.path))

    def _clean(self, store, place: str) -> None:
        """Delete what attempts of this job's tasks have left, also of those that were killed."""
        store.delete_dir(f"{place}/.{self.job}")


class MatrixSource(DataSource):
    @classmethod
    def name(cls):
        return "series_matrix"

    def schema(self):
        return "series_id bigint, values array<double>"

    def reader(self, schema):
        return _MatrixReader(self.options)

    def writer(self, schema, overwrite):
        return _MatrixWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(MatrixSource)


def read_matrix(spark: SparkSession, path: str, n: int, dtype: str = "float32", rows: int | None = None) -> DataFrame:
    """(series_id, values), of the first ``rows`` rows if given, by the data source where ``pyarrow`` reaches the path, else by Spark's reader."""
    try:
        _file_system(path)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return read_remote(spark, path, n, dtype, rows)
    register(spark)
    reader = spark.read.format("series_matrix").option("path", path).option("n", n).option("dtype", dtype)
    return (reader if rows is None else reader.option("rows", rows)).load()


def read_remote(spark: SparkSession, path: str, n: int, dtype: str = "float32", rows: int | None = None) -> DataFrame:
    """The same rows through Spark's own file reader, a whole file to a task: for stores that only Spark reaches.

    With ``rows`` the first so many ids; parts that begin behind them are not read.
    """
    kind = np.dtype(DTYPES[dtype])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                base = _first_id(path.rsplit("/", 1)[-1])
                count = len(content) // (n * kind.itemsize)
                data = np.frombuffer(content, kind, count * n).reshape(count, n)
                for lo in range(0, count, 4096):
                    block = data[lo : lo + 4096].astype(np.float64)
                    yield pd.DataFrame({"series_id": np.arange(lo, lo + len(block)) + base, "values": list(block)})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    if rows is None:
        return files.mapInPandas(run, "series_id long, values array<double>")
    first = F.coalesce(F.regexp_extract("path", r"/rows-([0-9]+)[^/]*$", 1).try_cast("long"), F.lit(0))
    return files.where(first < rows).mapInPandas(run, "series_id long, values array<double>").where(F.col("series_id") < rows)


def read_labels(spark: SparkSession, path: str, rows: int | None = None) -> DataFrame:
    """(series_id, label) from a file of int64 class ids, one for each row of a matrix."""
    return read_matrix(spark, path, 1, "int64", rows).select("series_id", F.col("values")[0].cast("long").alias("label"))


def write_matrix(series: DataFrame, path: str, dtype: str = "float32", rows_per_file: int = 1 << 20) -> None:
    """Write (series_id, values) as parts named by their first id: ``rows-<first id>.bin``. Ids must be 0, 1, 2 ... without gaps, and series of one length.

    ``path`` is a folder that all executors share, as a URI or a mounted path; parts that are there are replaced. Each part is one
    contiguous range of about ``rows_per_file`` ids, sorted by ranges and written batch by batch, so parts can be joined to one file by name.
    """
    rows = series.select(F.col("series_id").cast("long").alias("series_id"), F.col("values").cast("array<double>").alias("values"))
    count, n = rows.agg(F.count("*"), F.max(F.size("values"))).first()
    register(series.sparkSession)
    ranged = rows.repartitionByRange(max(1, -(-count // rows_per_file)), "series_id").sortWithinPartitions("series_id")
    ranged.write.format("series_matrix").option("path", path).option("n", n or 1).option("dtype", dtype).mode("overwrite").save()
