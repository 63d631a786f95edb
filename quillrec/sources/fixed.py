"""Fixed-length record files as a Spark data source: ``spark.read.format("fixedrec")``.

Options: path (a file, or a folder of files that follow each other by name; local, or a URI that pyarrow opens: file, s3, gs, abfs, hdfs); copybook (source text) or recordLength; batchRecords (records in an Arrow batch, default 65,536);
partitionBytes (default 64 MiB); firstRecord and lastRecord (a range, for resumed jobs); truncated ("error" or "drop");
decode ("true": the copybook's columns in place of the record; an invalid field fails the scan).
Rows: record_index (global, zero-based) and record (binary). Each partition is a range of whole records that is sought
to and read on its own, so a file of any size splits without a scan and the index needs no shuffle.
"""

from __future__ import annotations

import errno
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quillrec.errors import ConversionError
from quillrec.functions.vectors import decode_records
from quillrec.plans.layout import ADDRESSABLE, MAX_TEXT, Layout, compile_copybook, from_json, to_json, validate_layout

SCHEMA = "record_index long, record binary"


def batch_bytes(record_length: int, batch_records: int) -> int:
    """Size of a batch buffer, checked."""
    if batch_records <= 0:
        raise ConversionError("InvalidBatchSize")
    if record_length * batch_records > ADDRESSABLE:
        raise ConversionError("CapacityExceeded")
    return record_length * batch_records


class RecordRange(InputPartition):
    """``count`` records of a file (a path within its store) from its ``first``; the files before it hold ``base``."""

    def __init__(self, path: str, base: int, first: int, count: int):
        self.path, self.base, self.first, self.count = path, base, first, count


def store_of(path: str) -> tuple[fs.FileSystem, str]:
    """The store that holds a path or URI, and the path within it."""
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def record_files(path: str) -> list[tuple[str, int]]:
    """Path within its store and size of the file itself, or of a folder's visible files in order of their names: one sequence of records."""
    store, inside = store_of(path)
    found = store.get_file_info(inside)
    if found.type == fs.FileType.NotFound:
        raise FileNotFoundError(errno.ENOENT, os.strerror(errno.ENOENT), path)
    if found.type != fs.FileType.Directory:
        return [(inside, found.size)]
    files = [i for i in store.get_file_info(fs.FileSelector(inside)) if i.type == fs.FileType.File and not i.base_name.startswith((".", "_"))]
    return [(i.path, i.size) for i in sorted(files, key=lambda i: i.base_name)]


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.size = int(options["recordlength"]) if "recordlength" in options else compile_copybook(options["copybook"]).record_length
        self.batch = int(options.get("batchrecords", 65_536))
        batch_bytes(self.size, self.batch)
        self.batch = min(self.batch, max(1, MAX_TEXT // (2 * self.size)))  # so that the texts of a batch fit into one Arrow array
        self.partition_bytes = int(options.get("partitionbytes", 64 << 20))
        self.first, self.last = int(options.get("firstrecord", 0)), options.get("lastrecord")
        self.layout = validate_layout(compile_copybook(options["copybook"])) if options.get("decode") == "true" else None
        if "layout" in options:
            self.layout = validate_layout(from_json(options["layout"]))
        self.drop = options.get("truncated", "error") == "drop"

    def partitions(self) -> list[RecordRange]:
        step = max(1, self.partition_bytes // self.size)
        out, base = [], 0  # base: records in the files before
        for path, total in record_files(self.path):
            if total % self.size and not self.drop:
                raise ConversionError("TruncatedRecord", byte_offset=total - total % self.size, record_length=self.size, actual=total % self.size)
            n = total // self.size
            begin = max(self.first - base, 0)
            end = n if self.last is None else min(n, int(self.last) + 1 - base)
            out += [RecordRange(path, base, i, min(step, end - i)) for i in range(begin, end, step)]
            base += n
        return out or [RecordRange(self.path, 0, 0, 0)]

    def read(self, partition: RecordRange) -> Iterator[pa.RecordBatch]:
        if not partition.count:
            return
        with store_of(self.path)[0].open_input_file(partition.path) as f:
            f.seek(partition.first * self.size)
            for at in range(partition.first, partition.first + partition.count, self.batch):
                n = min(self.batch, partition.first + partition.count - at)
                data = f.read_buffer(n * self.size)
                if len(data) != n * self.size:
                    raise ConversionError("TruncatedRecord", byte_offset=at * self.size + len(data) // self.size * self.size, record_length=self.size, actual=len(data) % self.size)
                index = pa.array(np.arange(at, at + n) + partition.base)
                if self.layout is not None:
                    columns, bad = decode_records(data, self.layout)
                    if bad.any():
                        raise ValueError(f"record {partition.base + at + int(bad.argmax())} has an invalid field")
                    yield pa.RecordBatch.from_arrays([index, *columns], ["record_index", *(c.name for c in self.layout.columns)])
                    continue
                # one buffer, cut without copying
                fixed = pa.Array.from_buffers(pa.binary(self.size), n, [None, data])
                yield pa.RecordBatch.from_arrays([index, fixed.cast(pa.binary())], ["record_index", "record"])


class FixedRecordSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fixedrec"

    def schema(self) -> str | T.StructType:
        options = {k.lower(): v for k, v in self.options.items()}
        if "layout" in options:
            layout = validate_layout(from_json(options["layout"]))
        elif options.get("decode") == "true":
            layout = compile_copybook(options["copybook"])
        else:
            return SCHEMA
        return T.StructType([T.StructField("record_index", T.LongType(), False), *layout.schema()])

    def reader(self, schema) -> DataSourceReader:
        return _Reader({k.lower(): v for k, v in self.options.items()})


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FixedRecordSource)


def read_records(spark: SparkSession, path: str, layout: Layout | int, **options) -> DataFrame:
    """record_index and record of a file or folder (see the options above). ``layout`` may be just the record length."""
    register(spark)
    size = layout if isinstance(layout, int) else layout.record_length
    reader = spark.read.format("fixedrec").option("recordLength", size).option("path", os.fspath(path))
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load()


def read_decoded(spark: SparkSession, path: str, layout: Layout, **options) -> DataFrame:
    """record_index and the decoded columns of a file or folder; any invalid field fails the query, selected or not."""
    register(spark)
    packed = to_json(validate_layout(layout))
    reader = spark.read.format("fixedrec").option("recordLength", layout.record_length).option("layout", packed).option("path", os.fspath(path))
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load()


def write_records(df: DataFrame, folder: str, record: str = "record") -> None:
    """Writes a column of records as files of a new local folder, one for each partition, in the order of the partitions."""
    os.makedirs(folder)

    def save(batches):
        from pyspark import TaskContext

        context = TaskContext.get()
        final = os.path.join(folder, f"records-{context.partitionId():08}.bin")
        temporary = os.path.join(folder, f".{context.taskAttemptId()}.tmp")
        n = 0
        with open(temporary, "wb") as f:
            for batch in batches:
                values = batch.column(0)
                f.write(b"".join(values.to_pylist()))
                n += len(values)
        os.replace(temporary, final)  # a repeated attempt writes the same bytes
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    df.select(record).mapInArrow(save, "n long").agg({"n": "sum"}).collect()


def read_records_remote(spark: SparkSession, path: str, layout: Layout | int, partition_bytes: int = 64 << 20) -> DataFrame:
    """The same from a store that only Spark reads, by Hadoop's fixed-length input format.

    Splits hold whole records. A record's index follows from its file's split lengths; a file whose length is no multiple of the
    record length is refused before the read.
    """
    size = layout if isinstance(layout, int) else layout.record_length
    sc = spark.sparkContext
    jvm = sc._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    status = target.getFileSystem(sc._jsc.hadoopConfiguration()).getFileStatus(target)
    if status.getLen() % size:
        total = status.getLen()
        raise ConversionError("TruncatedRecord", byte_offset=total - total % size, record_length=size, actual=total % size)
    conf = {"fixedlengthinputformat.record.length": str(size), "mapreduce.input.fileinputformat.split.maxsize": str(max(size, partition_bytes // size * size))}
    rdd = sc.newAPIHadoopFile(
        path, "org.apache.hadoop.mapreduce.lib.input.FixedLengthInputFormat", "org.apache.hadoop.io.LongWritable", "org.apache.hadoop.io.BytesWritable", conf=conf
    )
    return rdd.map(lambda kv: (kv[0] // size, bytes(kv[1]))).toDF(SCHEMA)
