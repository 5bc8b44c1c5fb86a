"""Matrices in .npy files as a Spark data source, and Parquet files that belong to them by position."""

from __future__ import annotations

import io
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

SUFFIX = "_emb.npy"
HEADER, ROWS = 1 << 16, 65_536  # bytes that a header may take; rows of a partition
FOUND = "stem string, pos long, n long, embedding array<float>"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", path))


@dataclass
class Slice(InputPartition):
    """Some rows of one matrix; ``n`` is the number of all its rows."""

    file: str
    offset: int
    width: int
    kind: str
    first: int
    rows: int
    n: int


def header(raw) -> tuple[int, tuple[int, ...], np.dtype]:
    """Where the numbers of a .npy file begin, its shape and its type."""
    head = io.BytesIO(raw.read(HEADER))
    version = np.lib.format.read_magic(head)
    shape, by_column, kind = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(head)
    if by_column or len(shape) != 2 or kind.kind != "f":
        raise ValueError("only matrices of floating-point numbers, row by row, can be read")
    return head.tell(), shape, kind


class Reader(DataSourceReader):
    def __init__(self, path: str, rows: int):
        self.path, self.rows = path, rows

    def partitions(self) -> list[Slice]:
        store, folder = opened(self.path)
        found = []
        for info in sorted(store.get_file_info(fs.FileSelector(folder, allow_not_found=True)), key=lambda i: i.path):
            if info.base_name.endswith(SUFFIX):
                with store.open_input_stream(info.path, compression=None) as raw:
                    offset, (n, width), kind = header(raw)
                n = min(n, (info.size - offset) // max(1, width * kind.itemsize))  # a file that was cut off has fewer
                found += [Slice(info.path, offset, width, kind.str, first, min(self.rows, n - first), n) for first in range(0, max(n, 1), self.rows)]
        return found or [Slice("", 0, 0, "<f4", 0, 0, 0)]

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        p = partition
        if not p.rows:
            return
        kind, stem = np.dtype(p.kind), p.file.rsplit("/", 1)[-1].removesuffix(SUFFIX)
        step = max(1, (8 << 20) // (p.width * kind.itemsize))
        with opened(self.path)[0].open_input_file(p.file) as raw:
            raw.seek(p.offset + p.first * p.width * kind.itemsize)
            for at in range(p.first, p.first + p.rows, step):
                n = min(step, p.first + p.rows - at)
                flat = np.frombuffer(raw.read(n * p.width * kind.itemsize), kind).astype(np.float32)
                lists = pa.ListArray.from_arrays(np.arange(0, n * p.width + 1, p.width, dtype=np.int32), pa.array(flat))
                yield pa.RecordBatch.from_arrays([pa.array([stem] * n), pa.array(np.arange(at, at + n)), pa.array(np.full(n, p.n)), lists], names=["stem", "pos", "n", "embedding"])


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class Writer(DataSourceArrowWriter):
    """A matrix for each run of rows with an equal ``stem``, and a Parquet file of the other columns in the same order; files get their names when Spark
    commits, so a task that runs twice leaves one copy.  One matrix is held until it is whole: stems should be batches of bounded size."""

    def __init__(self, path: str, kind: str, matrices_only: bool):
        self.path, self.kind, self.only = path, np.dtype(kind), matrices_only

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, folder = opened(self.path)
        run, files = uuid.uuid4().hex, []
        store.create_dir(f"{folder}/_writing/{run}", recursive=True)

        def close(stem: str, batches: list[pa.RecordBatch]) -> None:
            rows = pa.Table.from_batches(batches)
            lists = rows.column("embedding").combine_chunks()
            x = np.asarray(lists.flatten().to_numpy(zero_copy_only=False), self.kind).reshape(rows.num_rows, -1)
            with store.open_output_stream(f"{folder}/_writing/{run}/{stem}{SUFFIX}", compression=None) as out:
                np.lib.format.write_array_header_1_0(out, np.lib.format.header_data_from_array_1_0(x))
                out.write(x.tobytes())
            files.append(f"{run}/{stem}{SUFFIX}")
            if not self.only:
                pq.write_table(rows.drop_columns(["embedding", "stem"]), f"{folder}/_writing/{run}/{stem}.parquet", filesystem=store)
                files.append(f"{run}/{stem}.parquet")

        now, held = None, []
        for batch in iterator:
            stems = batch.column("stem").to_pylist()
            edges = [i for i in range(1, len(stems)) if stems[i] != stems[i - 1]]
            for a, b in zip([0, *edges], [*edges, len(stems)]):
                if a < b:
                    if held and stems[a] != now:
                        close(now, held)
                        held = []
                    now = stems[a]
                    held.append(batch.slice(a, b - a))
        if held:
            close(now, held)
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        store, folder = opened(self.path)
        for file in (f for m in messages if m for f in m.files):
            store.move(f"{folder}/_writing/{file}", f"{folder}/{file.split('/', 1)[1]}")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        store, folder = opened(self.path)
        if store.get_file_info(f"{folder}/_writing").type == fs.FileType.Directory:
            store.delete_dir(f"{folder}/_writing")


class MatrixSource(DataSource):
    """``format("npy")``.  Options: ``rows`` (of a partition), ``kind`` (of the numbers written), ``matricesOnly``."""

    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        return FOUND

    def _option(self, name: str, default: str) -> str:
        return {k.lower(): v for k, v in self.options.items()}.get(name, default)

    def reader(self, schema) -> Reader:
        return Reader(self._option("path", ""), int(self._option("rows", str(ROWS))))

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self._option("path", ""), self._option("kind", "<f4"), self._option("matricesonly", "false") == "true")


def read_matrices(spark: SparkSession, path: str, rows: int = ROWS) -> DataFrame:
    """The rows of all matrices of a folder: stem (the file's name without its ending), pos, n (rows of the whole matrix), embedding.  A partition is a
    range of rows, so one large file is read by many tasks."""
    spark.dataSource.register(MatrixSource)
    return spark.read.format("npy").option("rows", rows).load(path)


def write_pairs(rows: DataFrame, path: str, stem: str, order: str, vector: str = "embedding", kind: str = "<f4", matrices_only: bool = False) -> None:
    """Rows as pairs of files, <stem>.parquet and <stem>_emb.npy, both in the order of ``order``; files of other stems stay.  A batch is written by one
    task, so ``stem`` should name batches of bounded size.  With ``matrices_only`` just the matrices."""
    rows.sparkSession.dataSource.register(MatrixSource)
    own = rows.select(F.col(stem).cast("string").alias("stem"), F.col(vector).alias("embedding"), *(F.col(c) for c in rows.columns if c not in (stem, vector)))
    own.repartition("stem").sortWithinPartitions("stem", order).write.format("npy").mode("append").option("kind", kind).option("matricesOnly", str(matrices_only).lower()).save(path)


def read_pairs(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(rows, report) of a folder of pairs.

    rows: stem, the Parquet file's columns and the vector at the same position.  A stem whose two files differ in length, or that has only one of them, gives
    no rows.  report: stem, n_rows, n_vectors, used.
    """
    matrices = read_matrices(spark, path)
    texts = spark.read.option("pathGlobFilter", "*.parquet").parquet(path)
    texts = texts.select(*texts.columns, F.regexp_extract("_metadata.file_name", r"([^/]+)\.parquet$", 1).alias("stem"), F.col("_metadata.row_index").alias("pos"))
    counts = texts.groupBy("stem").agg(F.count("*").alias("n_rows"))
    both = counts.join(matrices.groupBy("stem").agg(F.count("*").alias("n_vectors")), "stem", "full_outer").na.fill(0)
    report = both.withColumn("used", F.col("n_rows") == F.col("n_vectors"))
    rows = texts.join(report.where("used").select("stem"), "stem", "left_semi").join(matrices.drop("n"), ["stem", "pos"]).drop("pos")
    return rows, report
