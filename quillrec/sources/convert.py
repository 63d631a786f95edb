"""One input file to one Parquet file, or to a Spark directory at any scale."""

from __future__ import annotations

import os
import secrets
import shutil
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillrec.errors import ConversionError, DecodeError
from quillrec.functions.vectors import decode_records
from quillrec.operators.decode import ERROR_COLUMN, decode, decode_error, error_of, first_error
from quillrec.plans.layout import Layout, validate_layout
from quillrec.sources.fixed import batch_bytes, read_decoded, read_records


def io_error(operation: str, path, source: OSError) -> ConversionError:
    return ConversionError("Io", operation=operation, path=path, source=source)


def arrow_schema(layout: Layout) -> pa.Schema:
    kinds = {"utf8": lambda t: pa.string(), "int64": lambda t: pa.int64(), "decimal128": lambda t: pa.decimal128(t.precision, t.scale)}
    as_bytes = lambda m: {k.encode(): v.encode() for k, v in m.items()} or None
    fields = [pa.field(c.name, kinds[c.logical.name](c.logical), nullable=False, metadata=as_bytes(c.metadata)) for c in layout.columns]
    return pa.schema(fields, metadata=as_bytes(layout.metadata))


def checked(layout: Layout, batch_records: int) -> None:
    """What must hold before any file is touched, in order: the layout, a column, the batch size."""
    try:
        validate_layout(layout)
    except DecodeError as e:
        raise ConversionError("Decode", byte=0, source=e) from e
    if not layout.columns:
        raise ConversionError("EmptySchema")
    batch_bytes(layout.record_length, batch_records)


def fail_at(error, layout: Layout, batch_records: int) -> ConversionError:
    """The conversion failure for (record index, row) of ``first_error``."""
    index, row = error
    cause = decode_error(row, layout, index, batch_records)
    start = index // batch_records * batch_records * layout.record_length
    found = ConversionError("Decode", byte=start + cause.context["byte_offset"], source=cause)
    found.__cause__ = cause
    return found


def _validated(records: DataFrame, layout: Layout, total: int, batch_records: int) -> None:
    """Raises what a reader of batches would meet first: a bad record of a whole batch, a cut-off record, a bad record."""
    size = layout.record_length
    rest = total % size
    limit = total // (size * batch_records) * batch_records if rest else None
    if error := first_error(records, layout, below=limit):
        raise fail_at(error, layout, batch_records)
    if rest:
        raise ConversionError("TruncatedRecord", byte_offset=total - rest, record_length=size, actual=rest)


def _size(path) -> int:
    try:
        return os.stat(path).st_size
    except OSError as e:
        raise io_error("open input", path, e) from e


def convert_file(spark: SparkSession, layout: Layout, input_path, output_path, batch_records: int = 65_536, local_bytes: int = 64 << 20) -> None:
    """Converts to one new uncompressed Parquet file with a row group for every batch.

    Tasks decode and write ranges of whole batches beside the output; the driver then moves their row groups into the one
    file, in order and one at a time, so its memory is one group. Bad data raises the first error and leaves no output; an
    existing output is never touched. Inputs of up to ``local_bytes`` are decoded batch by batch on the driver instead, as starting
    tasks would take longer. For inputs that one file should not hold see ``convert_dataset``.
    """
    checked(layout, batch_records)
    total = _size(input_path)
    out = Path(os.path.abspath(output_path))
    try:
        sink = open(out, "xb")
    except OSError as e:
        raise io_error("create output", output_path, e) from e
    staging, done = out.parent / f".{out.name}.{secrets.token_hex(8)}", False
    try:
        with sink:
            schema = arrow_schema(layout)
            if total > local_bytes:
                _decode_to(spark, layout, input_path, os.fspath(staging), total, batch_records, max(1, total // spark.sparkContext.defaultParallelism))
                groups = _staged_groups(staging)
            else:
                groups = _local_groups(spark, layout, input_path, total, batch_records)
            with pq.ParquetWriter(sink, schema, compression="NONE") as writer:
                for columns in groups:
                    columns = [c.cast(f.type) for c, f in zip(columns, schema, strict=True)]
                    writer.write_table(pa.Table.from_arrays(columns, schema=schema), row_group_size=max(len(columns[0]), 1))
        done = True
    finally:
        shutil.rmtree(staging, ignore_errors=True)
        if not done:
            out.unlink(missing_ok=True)


def _staged_groups(folder: Path):
    for part in sorted(folder.glob("part-*.parquet")):
        with pq.ParquetFile(part) as f:
            for i in range(f.num_row_groups):
                yield f.read_row_group(i).columns


def _local_groups(spark: SparkSession, layout: Layout, input_path, total: int, batch_records: int):
    """The columns of each batch in turn; Spark is asked only for the place of an error."""
    size = layout.record_length
    records = lambda: read_records(spark, input_path, layout, truncated="drop")
    if total % size:
        _validated(records(), layout, total, batch_records)
    with open(input_path, "rb") as f:
        while data := f.read(size * batch_records):
            columns, bad = decode_records(data, layout)
            if bad.any():
                raise fail_at(first_error(records(), layout), layout, batch_records)
            yield columns


def _decode_to(spark: SparkSession, layout: Layout, input_path, folder: str, total: int, batch_records: int, about: int) -> None:
    """Decodes whole batches in ranges of ``about`` bytes into a new folder of Parquet files, all or nothing."""
    size = layout.record_length
    step = max(1, about // (size * batch_records)) * batch_records * size
    records = read_records(spark, input_path, layout, batchRecords=min(batch_records, 65_536), partitionBytes=step, truncated="drop")
    if total % size:
        _validated(records, layout, total, batch_records)
    decoded = read_decoded(spark, input_path, layout, batchRecords=min(batch_records, 65_536), partitionBytes=step, truncated="drop")
    writer = decoded.drop("record_index").write.mode("errorifexists").option("compression", "uncompressed").option("parquet.block.row.count.limit", batch_records)
    try:
        writer.parquet(folder)
    except Exception as e:
        shutil.rmtree(folder, ignore_errors=True)  # it was new, and the commit never came
        error = first_error(records, layout)
        if error is None:
            raise ConversionError("Parquet", source=e) from e
        raise fail_at(error, layout, batch_records) from e


def convert_dataset(spark: SparkSession, layout: Layout, input_path, output_dir: str, batch_records: int = 65_536) -> None:
    """Converts to a new directory of Parquet files, each with row groups of a batch: the way for large inputs.

    One pass: every task decodes, validates and writes its own range of records; the commit makes the result visible only if
    all records are good. On bad data the first error is found by an aggregation and raised.
    """
    checked(layout, batch_records)
    total = _size(input_path)
    if os.path.exists(output_dir):
        raise io_error("create output", output_dir, FileExistsError(17, "File exists"))
    _decode_to(spark, layout, input_path, os.fspath(output_dir), total, batch_records, 128 << 20)


def quarantine(spark: SparkSession, layout: Layout, input_path) -> tuple[DataFrame, DataFrame]:
    """Good rows, and (record_index, record, _error) of the bad ones, for flows that must go on."""
    records = read_records(spark, input_path, layout)
    marked = records.withColumn(ERROR_COLUMN, error_of(F.col("record"), layout))
    good = decode(marked.where(F.col(ERROR_COLUMN).isNull()), layout, errors="ignore", keep=("record_index",))
    return good, marked.where(F.col(ERROR_COLUMN).isNotNull())
