"""Registered queries of conversions, recoverable jobs, protection, reports and comparison: each runs the operator on whole tables or on fixed cases.

Where a query lists rejections, its SQL states the kinds of failure as constants.
"""

from __future__ import annotations

import contextlib
import hashlib
import io
import json
import os
import shutil
import stat
import tempfile
from collections.abc import Callable, Iterator
from dataclasses import replace
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillrec import cli
from quillrec.errors import ConversionError, CopybookError, DecodeError, ProtectionError, RecoveryError
from quillrec.functions import mlkem, vectors
from quillrec.functions.codecs import encode_text, utf8_length
from quillrec.operators import compare
from quillrec.operators.decode import decode, decode_batch
from quillrec.plans.copybook import parse_copybook
from quillrec.plans.layout import Layout, compile_copybook, layout_fingerprint, validate_layout, with_metadata
from quillrec.plans.queries import _LINEITEM_SQL, _patched, encoded, layout_of, lineitem_file, lineitem_values, money, query, table
from quillrec.sources import parts, protect
from quillrec.sources.convert import convert_dataset, convert_file, quarantine
from quillrec.sources.fixed import batch_bytes, read_decoded, read_records_remote, write_records
from quillrec.sources.storage import working_folder
from quillrec.streaming.records import stream_decoded

FAILURES = (CopybookError, DecodeError, ConversionError, RecoveryError, ProtectionError)
CUSTOMER = {"custkey": "9(9) COMP", "name": "X(18)", "balance": "S9(7)V9(2) COMP-3"}  # 27 bytes
_CUSTOMER_SQL = "CAST(c_custkey AS BIGINT) AS custkey, rpad(c_name, 18, ' ') AS name, CAST(c_acctbal AS DECIMAL(9,2)) AS balance"
COPYBOOK = "       01  REC.\n           05  CUSTKEY PIC 9(9) COMP.\n           05  NAME PIC X(18).\n           05  BALANCE PIC S9(7)V9(2) COMP-3.\n"


def customer_values() -> dict[str, Column]:
    return {"custkey": F.col("c_custkey"), "name": F.col("c_name"), "balance": money("c_acctbal")}


def one_file(records: DataFrame, folder: str) -> str:
    write_records(records, folder)
    return os.path.join(folder, os.listdir(folder)[0])


def customer_file(spark: SparkSession, sf_dir: str, bad: Column | None = None) -> tuple[str, Layout]:
    """``customer`` by key as one file; the packed balances of ``bad`` rows get an invalid digit, at byte 24 of their record."""
    layout = layout_of(**CUSTOMER)
    rows = encoded(table(spark, sf_dir, "customer"), layout, ("c_custkey",), **customer_values())
    if bad is not None:
        rows = rows.withColumn("record", _patched(F.col("record"), 24, "1F", bad))
    return one_file(rows.repartition(1).sortWithinPartitions("c_custkey"), working_folder(spark, "customer")), layout


def cases(spark: SparkSession, *found: tuple[str, Callable[[], object]]) -> DataFrame:
    """What each case raises: its name, the kind of failure, or null."""
    rows = []
    for name, run in found:
        try:
            run()
            rows.append((name, None))
        except FAILURES as e:
            rows.append((name, e.kind))
    return spark.createDataFrame(rows, "name string, kind string")


def expected(**kinds: str | None) -> str:
    values = ", ".join(f"('{name}', {'NULL' if kind is None else repr(kind)})" for name, kind in kinds.items())
    return f"SELECT name, CAST(kind AS VARCHAR) AS kind FROM (VALUES {values}) AS t(name, kind)"


def message(run: Callable[[], object]) -> str | None:
    try:
        run()
    except FAILURES as e:
        return str(e)
    return None


# ---------------------------------------------------------------- copybooks


@query(
    "SELECT * FROM (VALUES (1, 1, 'REC', 'group', 8), (2, 5, 'A-1', 'display', 12), (4, 5, 'G', 'group', 12), (5, 10, 'FILLER', 'display', 16),"
    " (6, 10, 'B', 'binary', 16), (7, 10, 'C', 'packed', 16)) AS t(line, level, name, usage, \"column\")"
)
def copybook_entries(spark, sf_dir):
    """Source lines, comments, sequence numbers and tokens to entries."""
    text = (
        "000100 01  REC.\n000200     05  A-1 PIC X(3).  *> a note\n000300*    a comment\n000400     05  G.\n"
        "000500         10  FILLER PIC 9(4).\n000600         10  B PIC S9(4) USAGE COMP.\n000700         10  C PIC 9(3) COMP-3.\n"
    )
    rows = [(e.span.line, e.level, e.name, "group" if e.picture is None else e.usage, e.span.column) for e in parse_copybook(text)]
    return spark.createDataFrame(rows, "line int, level int, name string, usage string, column int")


_BAD_SOURCES = {
    "tab": ("       01\tREC.", "InvalidSourceFormat"),
    "short_line": ("    01", "InvalidSourceFormat"),
    "continuation": ("      -01  REC.", "InvalidIndicator"),
    "level_88": ("       88  REC.", "InvalidLevel"),
    "name": ("       01  9REC.", "InvalidName"),
    "picture": ("       01  REC.\n           05  A PIC 99.", "InvalidPicture"),
    "no_name": ("       01  .", "UnexpectedToken"),
    "cut_off": ("       01", "UnexpectedEnd"),
    "occurs": ("       01  REC.\n           05  A PIC X OCCURS 3 TIMES.", "UnsupportedClause"),
    "no_period": ("       01  REC.\n           05  A PIC X", "MissingPeriod"),
    "empty": ("", "InvalidHierarchy"),
    "two_roots": ("       01  REC.\n           05  A PIC X.\n       01  B.", "InvalidHierarchy"),
    "precision": ("       01  REC.\n           05  A PIC 9(19).", "InvalidPrecision"),
    "length": ("       01  REC.\n           05  A PIC X(2147483648).", "InvalidLength"),
    "signed_display": ("       01  REC.\n           05  A PIC S9(4).", "UnsupportedCombination"),
    "repeated": ("       01  REC.\n           05  A PIC X.\n           05  A PIC X.", "DuplicateField"),
}


@query(expected(**{name: kind for name, (_, kind) in _BAD_SOURCES.items()}))
def copybook_rejections(spark, sf_dir):
    return cases(spark, *((name, lambda text=text: compile_copybook(text + "\n" if text else "")) for name, (text, _) in _BAD_SOURCES.items()))


@query(
    "SELECT * FROM (VALUES ('REC.A', 0, 3, 'ebcdic_text', 'string'), (NULL, 3, 4, 'ebcdic_display_numeric', NULL), ('REC.G.B', 7, 2, 'big_endian_binary', 'bigint'),"
    " ('REC.G.C', 9, 8, 'big_endian_binary', 'decimal(10,2)'), ('REC.G.D', 17, 5, 'packed_decimal', 'decimal(8,0)')) AS t(path, \"offset\", length, encoding, type)"
)
def layout_fields(spark, sf_dir):
    text = (
        "       01  REC.\n           05  A PIC X(3).\n           05  FILLER PIC 9(4).\n           05  G.\n               10  B PIC 9(4) COMP.\n"
        "               10  C PIC 9(8)V9(2) BINARY.\n               10  D PIC 9(8) PACKED-DECIMAL.\n"
    )
    rows = [(f.path, f.offset, f.byte_length, f.encoding, f.logical.spark().simpleString() if f.path else None) for f in compile_copybook(text).fields]
    return spark.createDataFrame(rows, "path string, offset int, length int, encoding string, type string")


@query(expected(good=None, offset="InvalidLayout", length="InvalidLayout", name="InvalidLayout", columns="InvalidLayout", nullable="InvalidLayout", total="InvalidLayout", precision="InvalidLayout"))
def layout_rejections(spark, sf_dir):
    """Layouts made by hand."""
    good = layout_of(**CUSTOMER)
    first, column = good.fields[0], good.columns[0]
    field = lambda **changes: replace(good, fields=(replace(first, **changes), *good.fields[1:]))
    made = {
        "good": good, "offset": field(offset=1), "length": field(byte_length=5), "name": field(source_name="custkey"), "columns": replace(good, columns=good.columns[1:]),
        "nullable": replace(good, columns=(replace(column, nullable=True), *good.columns[1:])), "total": replace(good, record_length=28), "precision": field(precision=19),
    }
    return cases(spark, *((name, lambda layout=layout: validate_layout(layout)) for name, layout in made.items()))


@query(expected(batch_length="InvalidBatchLength", field_length="InvalidFieldLength", text_capacity="CapacityExceeded", no_records="InvalidBatchSize", buffer="CapacityExceeded", only_filler="EmptySchema"))
def batch_rejections(spark, sf_dir):
    layout, filler = layout_of(**CUSTOMER), layout_of(filler1="X(4)")
    empty = one_file(spark.createDataFrame([(bytearray(b"four"),)], "record binary"), working_folder(spark, "filler"))
    return cases(
        spark,
        ("batch_length", lambda: decode_batch(spark, bytes(28), layout)),
        ("field_length", lambda: vectors.checked_width(np.zeros((2, 3), dtype=np.uint8), layout.fields[0])),
        ("text_capacity", lambda: vectors.text_array(np.full((4, 18), 0x40, dtype=np.uint8), most=71)),
        ("no_records", lambda: batch_bytes(27, 0)),
        ("buffer", lambda: batch_bytes(27, 2**62)),
        ("only_filler", lambda: convert_file(spark, filler, empty, working_folder(spark, "out.parquet"))),
    )


@query("SELECT CAST(c_custkey AS BIGINT) AS custkey, CAST(octet_length(encode(rpad(c_name, 18, ' '))) AS INT) AS bytes FROM customer")
def utf8_lengths(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("custkey"), utf8_length(encode_text(F.col("c_name"), 18)).alias("bytes"))


# ---------------------------------------------------------------- scans


@query(f"SELECT {_CUSTOMER_SQL}, row_number() OVER (ORDER BY c_custkey) - 1 AS record_index FROM customer QUALIFY record_index BETWEEN 10 AND 99")
def record_range(spark, sf_dir):
    """A range of records that is sought to, as a resumed job reads it."""
    path, layout = customer_file(spark, sf_dir)
    return read_decoded(spark, path, layout, firstRecord=10, lastRecord=99, partitionBytes=700, batchRecords=7).toDF("record_index", *customer_values())


@query(f"SELECT {_LINEITEM_SQL} FROM lineitem")
def uri_scan_lineitem(spark, sf_dir):
    """A folder of files by its URI, decoded in the scan."""
    path, layout = lineitem_file(spark, sf_dir)
    return read_decoded(spark, f"file://{path}", layout, partitionBytes=1 << 20).drop("record_index").toDF(*lineitem_values())


@query(f"SELECT {_CUSTOMER_SQL}, row_number() OVER (ORDER BY c_custkey) - 1 AS record_index FROM customer")
def hadoop_scan_customer(spark, sf_dir):
    """Through Hadoop's input format, decoded by Column expressions."""
    path, layout = customer_file(spark, sf_dir)
    rows = decode(read_records_remote(spark, f"file://{path}", layout, 5000), layout, keep=("record_index",))
    return rows.toDF("record_index", *customer_values())


@query(f"SELECT {_CUSTOMER_SQL} FROM customer")
def stream_customer(spark, sf_dir):
    """Record files as a stream, until all that are there are read."""
    path, layout = customer_file(spark, sf_dir)
    out = working_folder(spark, "stream")
    rows = stream_decoded(spark, os.path.dirname(path), layout).drop("path", "record_index").toDF(*customer_values())
    running = rows.writeStream.format("parquet").option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start(out)
    running.awaitTermination()
    return spark.read.parquet(out)


@query("SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS record_index, c_custkey % 7 = 0 AS bad FROM customer")
def quarantine_customer(spark, sf_dir):
    """Good rows and bad records apart."""
    path, layout = customer_file(spark, sf_dir, F.col("c_custkey") % 7 == 0)
    good, bad = quarantine(spark, layout, path)
    return good.select("record_index", F.lit(False).alias("bad")).union(bad.select("record_index", F.lit(True)))


# ---------------------------------------------------------------- conversions


@query(f"SELECT {_CUSTOMER_SQL} FROM customer")
def convert_file_customer(spark, sf_dir):
    """One Parquet file, by tasks."""
    path, layout = customer_file(spark, sf_dir)
    out = working_folder(spark, "customer.parquet")
    convert_file(spark, layout, path, out, 64, local_bytes=0)
    return spark.read.parquet(out).toDF(*customer_values())


#: The text for the first record whose key is a multiple of 97, in batches of 64 records.
_BAD_TEXT = (
    "'input file byte ' || (i * 27 + 24) || ': record ' || i || ', field REC.BALANCE, batch byte ' || (i % 64 * 27 + 24) || ' (line 4, column 12): invalid packed digit 0xF at nibble 5'"
)
_BAD_ROW = "(SELECT min(i) AS i FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS i FROM customer) WHERE c_custkey % 97 = 0)"


@query(f"SELECT way, {_BAD_TEXT} AS text, false AS left_over FROM {_BAD_ROW}, (VALUES ('file'), ('tasks'), ('dataset')) AS t(way)")
def conversion_failures(spark, sf_dir):
    """The first bad record by its place in the whole file; no output is left."""
    path, layout = customer_file(spark, sf_dir, F.col("c_custkey") % 97 == 0)
    rows = []
    for way, run in (("file", convert_file), ("tasks", lambda *a: convert_file(*a, local_bytes=0)), ("dataset", convert_dataset)):
        out = working_folder(spark, "out")
        text = message(lambda run=run, out=out: run(spark, layout, path, out, 64))
        rows.append((way, text, bool(os.listdir(os.path.dirname(out)))))
    return spark.createDataFrame(rows, "way string, text string, left_over boolean")


@query("SELECT 'incomplete record at input file byte ' || (count(*) - 1) * 27 || ': expected 27 bytes, got 26' AS text, false AS left_over FROM customer")
def cut_off_input(spark, sf_dir):
    path, layout = customer_file(spark, sf_dir)
    os.truncate(path, os.path.getsize(path) - 1)
    out = working_folder(spark, "out")
    text = message(lambda: convert_file(spark, layout, path, out, 64))
    return spark.createDataFrame([(text, os.path.exists(out))], "text string, left_over boolean")


# ---------------------------------------------------------------- recoverable jobs


@query("SELECT sha256(text) AS digest, octet_length(encode(text)) AS bytes FROM documents")
def sha256_identity(spark, sf_dir):
    """The fingerprint of a file, for every text as a file of its own, written and read in one task."""

    def fingerprints(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with tempfile.TemporaryDirectory() as folder:
            path = os.path.join(folder, "text")
            for pdf in batches:
                found = []
                for text in pdf["text"]:
                    with open(path, "wb") as f:
                        f.write(text.encode())
                    found.append(parts.file_sha256(path))
                yield pd.DataFrame({"digest": [d for _, d in found], "bytes": [n for n, _ in found]})

    return table(spark, sf_dir, "documents").select("text").mapInPandas(fingerprints, "digest string, bytes long")


_LAYOUT_JSON = (
    '{"arrow_fields":[{"data_type":{"type":"utf8"},"metadata":{"unit":"x"},"name":"REC.NAME","nullable":false}],"arrow_metadata":{},"fields":[{"byte_length":18,'
    '"logical_type":{"type":"utf8"},"offset":0,"path":"REC.NAME","physical_encoding":"ebcdic_text","precision":null,"scale":null,"signed":false,"source_name":"NAME"}],'
    '"name":"REC","record_length":18}'
)


@query(
    "SELECT *, sha256('{\"batch_records\":100,\"format\":\"quillrec-parts\",\"input_bytes\":' || input_bytes || ',\"input_sha256\":\"' || input_sha256 || '\",\"layout_sha256\":\"' ||"
    " layout_sha256 || '\",\"profile\":\"quillrec-v1-cp037-pyarrow-uncompressed\",\"record_length\":18,\"version\":1}') AS job_id FROM (SELECT length(s) AS input_bytes,"
    f" sha256(s) AS input_sha256, sha256('{_LAYOUT_JSON}') AS layout_sha256 FROM (SELECT string_agg(c_name, '' ORDER BY c_custkey) AS s FROM customer))"
)
def job_identity(spark, sf_dir):
    """What a job is known by: hashes of its input, of its layout and of both with the batch size."""
    layout = layout_of(name="X(18)")
    layout = with_metadata(layout, {"unit": "x"}, "REC.NAME")
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").cast("binary").alias("record")).repartition(1).sortWithinPartitions("c_custkey")
    job = parts._plan(Path(one_file(rows, working_folder(spark, "names"))), layout, 100)
    assert job.layout_sha256 == layout_fingerprint(layout)
    return spark.createDataFrame([(job.input_bytes, job.input_sha256, job.layout_sha256, job.job_id)], "input_bytes long, input_sha256 string, layout_sha256 string, job_id string")


_PLAN_SQL = (
    "SELECT i AS part_index, i * 64 AS start_record, least(64, n - i * 64) AS record_count FROM (SELECT count(*) AS n FROM customer),"
    " LATERAL (SELECT unnest(generate_series(0, (n + 63) // 64 - 1)) AS i)"
)


@query(f"SELECT *, true AS same_file, record_count AS rows FROM ({_PLAN_SQL})")
def part_receipts(spark, sf_dir):
    """The receipts of a job, against the parts themselves."""
    path, layout = customer_file(spark, sf_dir)
    root = working_folder(spark, "job")
    parts.convert_parts(spark, layout, path, root, 64)
    receipts = spark.read.json(os.path.join(root, parts.COMMITS))
    files = spark.read.format("binaryFile").load(os.path.join(root, parts.PARTS)).select(F.sha2("content", 256).alias("have"), "length", "path")
    files = files.select("have", "length", F.regexp_extract("path", "part-([0-9]+)", 1).cast("long").alias("part_index"))
    rows = spark.read.parquet(os.path.join(root, parts.PARTS)).groupBy(F.regexp_extract(F.input_file_name(), "part-([0-9]+)", 1).cast("long").alias("part_index")).agg(F.count("*").alias("rows"))
    same = (F.col("have") == F.col("parquet_sha256")) & (F.col("length") == F.col("parquet_bytes"))
    return receipts.join(files, "part_index").join(rows, "part_index").select("part_index", "start_record", "record_count", same.alias("same_file"), "rows")


class _Stopped(Exception):
    pass


@query(
    f"SELECT {_CUSTOMER_SQL}, committed FROM customer, (SELECT greatest(0, least(2, (count(*) + 63) // 64)) AS committed FROM customer)"
)
def resume_after_failure(spark, sf_dir):
    """A job that stops between its third part and that part's receipt, and is resumed from what was committed."""
    path, layout = customer_file(spark, sf_dir)
    root = Path(working_folder(spark, "job"))

    def hook(artifact, stage, index):
        if (artifact, stage, index) == ("part", "after_rename", 2):
            raise _Stopped

    with contextlib.suppress(_Stopped):
        parts.convert_parts(spark, layout, path, root, 64, hook=hook)
    committed = len(os.listdir(root / parts.COMMITS))
    parts.convert_parts(spark, layout, path, root, 64, resume=True)
    return spark.read.parquet(os.fspath(root / parts.PARTS)).toDF(*customer_values()).withColumn("committed", F.lit(committed).cast("long"))


@query(f"SELECT i // 64 AS committed, false AS complete, {_BAD_TEXT} AS text FROM {_BAD_ROW}")
def committed_prefix(spark, sf_dir):
    """A bad record leaves the parts before its own committed."""
    path, layout = customer_file(spark, sf_dir, F.col("c_custkey") % 97 == 0)
    root = Path(working_folder(spark, "job"))
    text = message(lambda: parts.convert_parts(spark, layout, path, root, 64))
    return spark.createDataFrame([(len(os.listdir(root / parts.COMMITS)), (root / parts.COMPLETE).exists(), text)], "committed long, complete boolean, text string")


def _rewritten(path: Path, **changes) -> None:
    path.write_text(json.dumps(json.loads(path.read_text()) | changes, separators=(",", ":")))


def _moved(root: Path) -> None:
    shutil.move(root / parts.PARTS, root.parent / "elsewhere")
    (root / parts.PARTS).symlink_to(root.parent / "elsewhere")


_PART0, _RECEIPT0 = f"{parts.PARTS}/{parts.part_name(0, 'parquet')}", f"{parts.COMMITS}/{parts.part_name(0, 'json')}"
#: How the state of a complete job is broken, and the kind of failure that a resume reports.
_BROKEN: dict[str, tuple[Callable[[Path], object], str | None]] = {
    "untouched": (lambda r: None, None),
    "completion_lost": (lambda r: (r / parts.COMPLETE).unlink(), None),
    "left_over": (lambda r: (r / parts.PARTS / f".{parts.part_name(0, 'parquet')}.tmp").write_text("x"), None),
    "unknown_file": (lambda r: (r / "extra").write_text("x"), "InvalidState"),
    "unknown_part": (lambda r: (r / parts.PARTS / "part-1.parquet").write_text("x"), "InvalidState"),
    "gap": (lambda r: (r / _RECEIPT0).unlink(), "InvalidState"),
    "part_lost": (lambda r: (r / _PART0).unlink(), "MissingCommittedPart"),
    "part_changed": (lambda r: (r / _PART0).write_bytes(b"PAR1"), "CorruptCommittedPart"),
    "long_receipt": (lambda r: (r / _RECEIPT0).write_bytes(b" " * 4097), "InvalidState"),
    "unknown_field": (lambda r: _rewritten(r / parts.MANIFEST, more=1), "Metadata"),
    "not_whole": (lambda r: _rewritten(r / parts.COMPLETE, part_count=2.0), "Metadata"),
    "version": (lambda r: _rewritten(r / parts.MANIFEST, version=2), "UnsupportedVersion"),
    "profile": (lambda r: _rewritten(r / parts.MANIFEST, profile="other"), "UnsupportedProfile"),
    "job_id": (lambda r: _rewritten(r / parts.MANIFEST, batch_records=7), "InvalidState"),
    "range": (lambda r: _rewritten(r / _RECEIPT0, record_count=1), "InvalidState"),
    "lock_lost": (lambda r: (r / parts.LOCK).unlink(), "InvalidState"),
    "folder_lost": (lambda r: shutil.rmtree(r / parts.PARTS), "InvalidState"),
    "link": (_moved, "InvalidState"),
}


@query(expected(**{name: kind for name, (_, kind) in _BROKEN.items()}))
def broken_job_states(spark, sf_dir):
    """Copies of a finished job over ``customer``, each broken in its own way and then resumed."""
    path, layout = customer_file(spark, sf_dir)
    root = Path(working_folder(spark, "job"))
    parts.convert_parts(spark, layout, path, root, 64)

    def resumed(name: str) -> None:
        copy = root.parent / name / "job"
        shutil.copytree(root, copy)
        _BROKEN[name][0](copy)
        parts.convert_parts(spark, layout, path, copy, 64, resume=True)

    return cases(spark, *((name, lambda name=name: resumed(name)) for name in _BROKEN))


@query(expected(same=None, input="IncompatibleResume", layout="IncompatibleResume", batch="IncompatibleResume", busy="Busy", exists="Io", inside="InvalidState", not_ours="InvalidState"))
def resume_rejections(spark, sf_dir):
    path, layout = customer_file(spark, sf_dir)
    root = Path(working_folder(spark, "job"))
    parts.convert_parts(spark, layout, path, root, 64)
    other = shutil.copy(path, root.parent / "other.bin")
    with open(other, "rb+") as f:
        f.write(b"\xff")
    foreign = root.parent / "foreign"
    foreign.mkdir()
    (foreign / "file").write_text("mine")

    def locked() -> None:
        with parts._locked(root):
            resume()

    def resume(path=path, layout=layout, batch=64, root=root) -> None:
        parts.convert_parts(spark, layout, path, root, batch, resume=True)

    inside = root.parent / "whole" / "in.bin"
    inside.parent.mkdir()
    shutil.copy(path, inside)
    return cases(
        spark,
        ("same", resume),
        ("input", lambda: resume(path=other)),
        ("layout", lambda: resume(layout=with_metadata(layout, {"a": "b"}))),
        ("batch", lambda: resume(batch=65)),
        ("busy", locked),
        ("exists", lambda: parts.convert_parts(spark, layout, path, root, 64)),
        ("inside", lambda: resume(path=inside, root=inside.parent)),
        ("not_ours", lambda: resume(root=foreign)),
    )


# ---------------------------------------------------------------- protection


_FRAMES_SQL = "greatest(1, (octet_length(encode(text)) + 1048575) // 1048576)"


@query(f"SELECT doc_id, {_FRAMES_SQL} AS frames, 1179 + octet_length(encode(text)) + 16 * {_FRAMES_SQL} AS envelope FROM documents")
def frame_plan(spark, sf_dir):
    """Frames and envelope size of every text."""

    def plan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "frames": pdf["size"].map(protect.frame_count), "envelope": pdf["size"].map(protect.envelope_size)})

    return table(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").cast("long").alias("size")).mapInPandas(plan, "doc_id long, frames long, envelope long")


def _keys(folder: Path) -> Path:
    folder.mkdir(parents=True)
    protect.generate_keypair(folder)
    return folder


@query(f"SELECT {_LINEITEM_SQL} FROM lineitem")
def aead_roundtrip(spark, sf_dir):
    """A record file sealed for a new key, opened again and decoded."""
    path, layout = lineitem_file(spark, sf_dir, tasks=1)
    folder = Path(working_folder(spark, "keys"))
    _keys(folder)
    protect.protect_file(spark, path, folder / "public.key", folder / "sealed")
    protect.unprotect_file(spark, folder / "sealed", folder / "secret.key", folder / "opened")
    return read_decoded(spark, os.fspath(folder / "opened"), layout).drop("record_index").toDF(*lineitem_values())


@query(
    "SELECT 'M2CM5ENC' AS magic, 1 AS version, 1 AS suite, n AS plain_bytes, true AS fingerprint, 1179 + n + 16 * greatest(1, (n + 1048575) // 1048576) AS envelope_bytes"
    " FROM (SELECT count(*) * 27 AS n FROM customer)"
)
def envelope_header(spark, sf_dir):
    """The fields of an envelope's header, read by their places."""
    path, _ = customer_file(spark, sf_dir)
    folder = _keys(Path(working_folder(spark, "keys")))
    protect.protect_file(spark, path, folder / "public.key", folder / "sealed")
    head = (folder / "sealed").read_bytes()[:1179]
    number = lambda a, b: int.from_bytes(head[a:b], "big")
    same = head[20:52] == hashlib.sha256((folder / "public.key").read_bytes()[16:]).digest()
    row = (head[:8].decode(), number(8, 10), number(10, 12), number(12, 20), same, (folder / "sealed").stat().st_size)
    return spark.createDataFrame([row], "magic string, version int, suite int, plain_bytes long, fingerprint boolean, envelope_bytes long")


@query("SELECT * FROM (VALUES ('public.key', 1200, '644', 'M2CM5PUB'), ('secret.key', 2416, '600', 'M2CM5SEC')) AS t(name, bytes, mode, magic)")
def key_files(spark, sf_dir):
    folder = _keys(Path(working_folder(spark, "keys")))
    rows = [(p.name, p.stat().st_size, f"{stat.S_IMODE(p.stat().st_mode):o}", p.read_bytes()[:8].decode()) for p in sorted(folder.iterdir())]
    return spark.createDataFrame(rows, "name string, bytes int, mode string, magic string")


@query("SELECT n_nationkey, 1184 AS public_bytes, 2400 AS secret_bytes, true AS same, false AS same_after_change FROM nation")
def kem_agreement(spark, sf_dir):
    """A key pair from each nation's name: both sides get one content key, another from a changed ciphertext."""

    def agree(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for key, name in zip(pdf["n_nationkey"], pdf["n_name"], strict=True):
                public, secret = mlkem.generate(hashlib.sha512(name.encode()).digest())
                shared, sealed = mlkem.encapsulate(public)
                content = [protect.content_key(s, bytes(32)) for s in (shared, mlkem.decapsulate(secret, sealed), mlkem.decapsulate(secret, bytes([sealed[0] ^ 1]) + sealed[1:]))]
                yield pd.DataFrame({"n_nationkey": [key], "public_bytes": [len(public)], "secret_bytes": [len(secret)], "same": [content[0] == content[1]], "same_after_change": [content[0] == content[2]]})

    kind = table(spark, sf_dir, "nation").schema["n_nationkey"].dataType.simpleString()
    return table(spark, sf_dir, "nation").select("n_nationkey", "n_name").mapInPandas(agree, f"n_nationkey {kind}, public_bytes int, secret_bytes int, same boolean, same_after_change boolean")


@query(
    expected(
        good=None, other_key="RecipientFingerprintMismatch", frame_changed="AuthenticationFailed", salt_changed="AuthenticationFailed", magic="InvalidMagic", version="UnsupportedVersion",
        suite="UnsupportedSuite", cut_off="InvalidLength", header_cut="InvalidLength", public_for_secret="InvalidLength", key_magic="InvalidMagic", key_algorithm="UnsupportedAlgorithm",
        key_changed="InvalidKey", keys_exist="OutputAlreadyExists", way_up="UnsafePath", no_parent="UnsafePath", inside_job="DestinationInM4Namespace",
    )
)
def protection_rejections(spark, sf_dir):
    """An envelope of ``customer`` that is changed, or opened with other keys or into other places."""
    path, layout = customer_file(spark, sf_dir)
    top = Path(working_folder(spark, "protection"))
    mine, other = _keys(top / "mine"), _keys(top / "other")
    protect.protect_file(spark, path, mine / "public.key", top / "sealed")
    good, secret = (top / "sealed").read_bytes(), (mine / "secret.key").read_bytes()
    job = top / "job"
    job.mkdir()
    (job / parts.LOCK).write_text("")

    def opened(name: str, data: bytes = good, key: bytes = secret, out: Path | None = None) -> tuple[str, Callable[[], object]]:
        def run() -> None:
            (top / f"{name}.in").write_bytes(data)
            (top / f"{name}.key").write_bytes(key)
            protect.unprotect_file(spark, top / f"{name}.in", top / f"{name}.key", top / f"{name}.out" if out is None else out)

        return name, run

    flip = lambda data, at: data[:at] + bytes([data[at] ^ 1]) + data[at + 1 :]
    return cases(
        spark, opened("good"), opened("other_key", key=(other / "secret.key").read_bytes()), opened("frame_changed", flip(good, 1179)), opened("salt_changed", flip(good, 52)),
        opened("magic", flip(good, 0)), opened("version", flip(good, 9)), opened("suite", flip(good, 11)), opened("cut_off", good[:-1]), opened("header_cut", good[:1178]),
        opened("public_for_secret", key=(mine / "public.key").read_bytes()), opened("key_magic", key=flip(secret, 0)), opened("key_algorithm", key=flip(secret, 11)),
        opened("key_changed", key=flip(secret, 16 + 2360)), ("keys_exist", lambda: protect.generate_keypair(mine)), opened("way_up", out=top / ".." / "x"),
        opened("no_parent", out=top / "none" / "x"), opened("inside_job", out=job / "x"),
    )


# ---------------------------------------------------------------- command line


def _command(spark: SparkSession, *argv) -> tuple[int, str, str]:
    out, err = io.StringIO(), io.StringIO()
    with contextlib.redirect_stdout(out), contextlib.redirect_stderr(err):
        status = cli.main([str(a) for a in argv], spark=lambda: spark)
    return status, out.getvalue(), err.getvalue()


@query(
    "SELECT command, mode, 'success' AS status, n * 27 AS input_bytes, n AS dataset_records, parts AS dataset_parts, 64 AS batch_records, 27 AS record_length FROM"
    " (SELECT count(*) AS n FROM customer), LATERAL (SELECT * FROM (VALUES ('convert', NULL, NULL), ('convert-parts', 'create', (n + 63) // 64), ('convert-parts', 'resume', (n + 63) // 64))"
    " AS t(command, mode, parts))"
)
def run_reports(spark, sf_dir):
    """The JSON reports of conversions by command line."""
    path, _ = customer_file(spark, sf_dir)
    top = Path(working_folder(spark, "cli"))
    top.mkdir()
    (top / "c.cpy").write_text(COPYBOOK)
    common = ("--copybook", top / "c.cpy", "--input", path, "--batch-records", 64, "--report-json")
    runs = (("convert", "--output", top / "out.parquet"), ("convert-parts", "--output-dir", top / "job"), ("convert-parts", "--output-dir", top / "job", "--resume"))
    found = [json.loads(_command(spark, *run, *common)[1]) for run in runs]
    names = ("command", "mode", "status", "input_bytes", "dataset_records", "dataset_parts", "batch_records", "record_length")
    return spark.createDataFrame([tuple(r[n] for n in names) for r in found], "command string, mode string, status string, input_bytes long, dataset_records long, dataset_parts long, batch_records int, record_length int")


_COMMANDS = {
    "no_command": ((), None), "unknown": (("other",), None), "missing_value": (("keygen", "--output-dir"), None),
    "repeated": (("keygen", "--output-dir", "a", "--output-dir", "b"), "arguments"), "no_key": (("protect", "--input", "in", "--public-key", "none", "--output", "out"), "protection"),
    "zero_batch": (("convert", "--copybook", "c", "--input", "in", "--output", "out", "--batch-records", "0"), "arguments"),
    "no_copybook": (("convert", "--copybook", "none", "--input", "in", "--output", "out", "--batch-records", "5"), "input_io"),
}


@query(
    "SELECT * FROM (VALUES " + ", ".join(f"('{name}', 1, {repr(category) if category else 'NULL'}, true)" for name, (argv, category) in _COMMANDS.items()) + ") AS t(name, status, category, told)"
)
def command_rejections(spark, sf_dir):
    """Status, error category of the report and the one line of each failed command.

    There is no report without a known command, or where the flag stands in the place of a value.
    """
    rows = []
    for name, (argv, _) in _COMMANDS.items():
        status, out, err = _command(spark, *argv, *(("--report-json",) if argv else ()))
        report = json.loads(out) if out else {}
        rows.append((name, status, report.get("error_category"), err.startswith("quillrec: ")))
    return spark.createDataFrame(rows, "name string, status int, category string, told boolean")


# ---------------------------------------------------------------- comparison


def _balances(spark: SparkSession, sf_dir: str, change: Column | None = None) -> DataFrame:
    """Positions, keys and balances decoded from a file; some balances changed."""
    path, layout = customer_file(spark, sf_dir)
    rows = read_decoded(spark, path, layout).toDF("record_index", *customer_values()).drop("name")
    return rows if change is None else rows.withColumn("balance", F.when(change, F.col("balance") + 1).otherwise(F.col("balance")).cast("decimal(9,2)"))


@query(
    "SELECT 'problem' AS kind, text FROM (SELECT unnest(['row counts differ: ' || n || ' and ' || n - gone, 'right: ' || gone || ' keys are missing']) AS text FROM"
    " (SELECT count(*) AS n, count(*) FILTER (c_custkey % 5 = 0) AS gone FROM customer)) UNION ALL"
    " SELECT 'mismatch', c_custkey || ' BALANCE ' || CAST(c_acctbal AS DECIMAL(9,2)) || ' ' || CAST(c_acctbal AS DECIMAL(9,2)) + 1"
    " FROM (SELECT * FROM customer WHERE c_custkey % 3 = 0 AND c_custkey % 5 <> 0 ORDER BY c_custkey LIMIT 10) UNION ALL"
    " SELECT 'compared', CAST(count(*) AS VARCHAR) FROM customer WHERE c_custkey % 5 <> 0"
)
def comparison_report(spark, sf_dir):
    """What the comparator reports of a side that lacks keys and has other values: counts, and the first ten examples."""
    left = _balances(spark, sf_dir).drop("record_index")
    right = _balances(spark, sf_dir, F.col("custkey") % 3 == 0).drop("record_index").where("custkey % 5 <> 0")
    found = compare.compare(left, right, ["custkey"])
    rows = [("problem", p) for p in found.problems] + [("mismatch", " ".join(map(str, m))) for m in found.mismatches] + [("compared", str(found.compared))]
    return spark.createDataFrame(rows, "kind string, text string")


@query(
    "SELECT * FROM (VALUES ('names', 'left: column names collide after normalization: BALANCE'), ('columns', 'columns on one side only: BALANCE, OTHER'),"
    " ('types', 'left: column BALANCE is decimal(9,2), expected decimal(9,3)'), ('types', 'right: column BALANCE is decimal(9,2), expected decimal(9,3)'),"
    " ('keys', 'a key column is missing')) AS t(name, problem)"
)
def comparison_schemas(spark, sf_dir):
    rows = _balances(spark, sf_dir).drop("record_index")
    found = {
        "names": compare.compare(rows.withColumn("A.BALANCE", F.lit(1)), rows, ["custkey"]),
        "columns": compare.compare(rows, rows.withColumnRenamed("balance", "other"), ["custkey"]),
        "types": compare.compare(rows, rows, ["custkey"], expected={"BALANCE": T.DecimalType(9, 3)}),
        "keys": compare.compare(rows, rows, ["nothing"]),
    }
    return spark.createDataFrame([(name, p) for name, c in found.items() for p in c.problems], "name string, problem string")


@query(
    "SELECT 'same order' AS name, 'position' AS by, n AS compared, least(10, bad) AS mismatches FROM (SELECT count(*) AS n, count(*) FILTER (c_custkey % 3 = 0) AS bad FROM customer) UNION ALL"
    " SELECT 'turned', 'key', n, least(10, bad) FROM (SELECT count(*) AS n, count(*) FILTER (c_custkey % 3 = 0) AS bad FROM customer)"
)
def comparison_order(spark, sf_dir):
    """By position where the keys stand in the same order, else by key."""
    left, right = _balances(spark, sf_dir), _balances(spark, sf_dir, F.col("custkey") % 3 == 0)
    turned = right.withColumn("record_index", -F.col("record_index"))
    found = [(name, compare.compare_in_order(left, side, ["custkey"])) for name, side in (("same order", right), ("turned", turned))]
    return spark.createDataFrame([(name, c.by, c.compared, len(c.mismatches)) for name, c in found], "name string, by string, compared long, mismatches long")


@query("SELECT * FROM (VALUES ('same', true), ('changed', false), ('twice', false)) AS t(name, equal)")
def equal_datasets(spark, sf_dir):
    """Decoded rows against the table itself, repeats counted."""
    rows = _balances(spark, sf_dir).drop("record_index")
    plain = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("custkey"), money("c_acctbal").alias("balance"))
    changed = _balances(spark, sf_dir, F.col("custkey") % 3 == 0).drop("record_index")
    found = (("same", rows, plain), ("changed", rows, changed), ("twice", rows, plain.union(plain)))
    return spark.createDataFrame([(name, compare.same_rows(a, b)) for name, a, b in found], "name string, equal boolean")
