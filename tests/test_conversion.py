"""Single files, datasets and recoverable parts."""

import json
import os
import shutil

import pyarrow.parquet as pq
import pytest

from quillrec.errors import ConversionError, RecoveryError
from quillrec.operators.decode import decode
from quillrec.plans.layout import compile_copybook, with_metadata
from quillrec.sources import parts
from quillrec.sources.convert import convert_dataset, convert_file, quarantine
from quillrec.sources.fixed import batch_bytes, read_decoded, read_records, read_records_remote, write_records
from quillrec.streaming.records import stream_decoded
from tests.fixtures import COPYBOOK, RECORDS, ROWS, copybook, plain

LAYOUT = compile_copybook(COPYBOOK)


@pytest.fixture
def source(tmp_path):
    def make(data=RECORDS, name="in.bin"):
        path = tmp_path / name
        path.write_bytes(data)
        return path

    return make


def snapshot(root):
    return {p.relative_to(root): (p.read_bytes() if p.is_file() and not p.is_symlink() else None) for p in sorted(root.rglob("*"))}


def rows_of(path):
    t = pq.read_table(path)
    return plain(tuple(r.values()) for r in t.to_pylist())


# ---------------------------------------------------------------- source


def test_batches_and_ranges(spark, source):
    path = source(RECORDS * 50)
    for step in (1, 35, 36, 350, 10**9):
        df = read_records(spark, path, LAYOUT, partitionBytes=step, batchRecords=7)
        got = sorted((r.record_index, bytes(r.record)) for r in df.collect())
        assert got == [(i, (RECORDS * 50)[35 * i : 35 * i + 35]) for i in range(150)]
    some = read_records(spark, path, LAYOUT, firstRecord=10, lastRecord=19)
    assert sorted(r.record_index for r in some.collect()) == list(range(10, 20))
    assert plain(read_decoded(spark, path, LAYOUT).orderBy("record_index").drop("record_index").collect()) == ROWS * 50
    df = spark.read.format("fixedrec").option("copybook", COPYBOOK).option("decode", "true").load(str(path))
    assert df.count() == 150 and df.columns[0] == "record_index"
    assert sorted(r.record_index for r in read_records_remote(spark, f"file://{path}", LAYOUT, 1000).collect()) == list(range(150))
    with pytest.raises(ConversionError) as e:
        batch_bytes(35, 0)
    assert e.value.kind == "InvalidBatchSize"
    with pytest.raises(ConversionError) as e:
        batch_bytes(35, 2**60)
    assert e.value.kind == "CapacityExceeded"


def test_folder_of_record_files(spark, source, tmp_path):
    records = read_records(spark, source(RECORDS * 20), LAYOUT, partitionBytes=35 * 9)
    write_records(records, str(tmp_path / "out"))
    assert len(os.listdir(tmp_path / "out")) == 7
    back = read_records(spark, str(tmp_path / "out"), LAYOUT, partitionBytes=35 * 4)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, records.collect()))


def test_truncated_source(spark, source):
    with pytest.raises(Exception, match="incomplete record at input file byte 70: expected 35 bytes, got 34"):
        read_records(spark, source(RECORDS[:-1]), LAYOUT).collect()


# ---------------------------------------------------------------- one file


@pytest.mark.parametrize("local", [0, 10**9])
@pytest.mark.parametrize("batch,groups", [(1, [1, 1, 1]), (2, [2, 1]), (3, [3]), (100, [3])])
def test_convert_file(spark, source, tmp_path, batch, groups, local):
    convert_file(spark, LAYOUT, source(), tmp_path / "o.parquet", batch, local)
    f = pq.ParquetFile(tmp_path / "o.parquet")
    assert [f.metadata.row_group(i).num_rows for i in range(f.num_row_groups)] == groups
    assert all(not x.nullable for x in f.schema_arrow)
    assert {f.metadata.row_group(0).column(c).compression for c in range(6)} == {"UNCOMPRESSED"}
    assert rows_of(tmp_path / "o.parquet") == ROWS
    with pytest.raises(ConversionError, match="create output"):
        convert_file(spark, LAYOUT, source(), tmp_path / "o.parquet", batch)
    assert sorted(p.name for p in tmp_path.iterdir()) == ["in.bin", "o.parquet"]


def test_batches_do_not_change_rows(spark, source, tmp_path):
    path = source(RECORDS * 333)
    for local in (0, 10**9):
        for batch in (1000, 64, 7):
            convert_file(spark, LAYOUT, path, tmp_path / f"{batch}.{local}", batch, local)
            assert rows_of(tmp_path / f"{batch}.{local}") == ROWS * 333


def test_empty_input(spark, source, tmp_path):
    for local in (-1, 10**9):
        convert_file(spark, LAYOUT, source(b""), tmp_path / f"o{local}", 2, local)
        f = pq.ParquetFile(tmp_path / f"o{local}")
        assert f.metadata.num_rows == 0 and f.num_row_groups == 0 and len(f.schema_arrow) == 6
    convert_dataset(spark, LAYOUT, source(b""), tmp_path / "set", 2)
    assert spark.read.parquet(str(tmp_path / "set")).count() == 0


def test_every_truncation(spark, source, tmp_path):
    for cut in (1, 17, 34, 36, 69, 71, 104):
        with pytest.raises(ConversionError) as e:
            convert_file(spark, LAYOUT, source(RECORDS[:cut]), tmp_path / "o.parquet", 2, 10**9 * (cut % 2))
        assert e.value.kind == "TruncatedRecord" and str(e.value) == f"incomplete record at input file byte {cut // 35 * 35}: expected 35 bytes, got {cut % 35}"
        assert not (tmp_path / "o.parquet").exists()


def test_first_error_and_its_place(spark, source, tmp_path):
    data = bytearray(RECORDS)
    data[83] = 0x40
    for convert, out, *local in ((convert_file, "o.parquet", 0), (convert_file, "o.parquet"), (convert_dataset, "set")):
        with pytest.raises(ConversionError) as e:
            convert(spark, LAYOUT, source(bytes(data)), tmp_path / out, 2, *local)
        assert str(e.value) == (
            "input file byte 83: record 2, field SAMPLE-RECORD.HEADER-GROUP.ACCOUNT-NUMBER, batch byte 13 (line 6, column 16): "
            "invalid DISPLAY digit 0x40 at field byte 1"
        )
        assert not (tmp_path / out).exists()


def test_cut_off_record_against_bad_records(spark, source, tmp_path):
    """A bad record of an earlier batch comes first; one in the cut-off batch does not."""
    early, late = bytearray(RECORDS[:-1]), bytearray(RECORDS[:-1])
    early[12], late[35 * 2 + 12] = 0, 0
    for data, kind, local in ((early, "Decode", 0), (late, "TruncatedRecord", 0), (early, "Decode", 10**9), (late, "TruncatedRecord", 10**9)):
        with pytest.raises(ConversionError) as e:
            convert_file(spark, LAYOUT, source(bytes(data)), tmp_path / "o.parquet", 2, local)
        assert e.value.kind == kind


def test_what_is_checked_first(spark, source, tmp_path):
    filler = compile_copybook(copybook("FILLER PIC X."))
    for layout, batch, path, kind in ((filler, 0, "nowhere", "EmptySchema"), (LAYOUT, 0, "nowhere", "InvalidBatchSize"), (LAYOUT, 2**62, "nowhere", "CapacityExceeded"), (LAYOUT, 1, "nowhere", "Io")):
        with pytest.raises(ConversionError) as e:
            convert_file(spark, layout, tmp_path / path, tmp_path / "o.parquet", batch)
        assert e.value.kind == kind and not (tmp_path / "o.parquet").exists()


def test_quarantine(spark, source):
    data = bytearray(RECORDS)
    data[83] = 0x40
    good, bad = quarantine(spark, LAYOUT, source(bytes(data)))
    assert sorted(r.record_index for r in good.collect()) == [0, 1] and [r.record_index for r in bad.collect()] == [2]


def test_stream(spark, source, tmp_path):
    folder = tmp_path / "landing"
    folder.mkdir()
    (folder / "a.bin").write_bytes(RECORDS)
    (folder / "b.bin").write_bytes(RECORDS[:35])
    q = stream_decoded(spark, str(folder), LAYOUT).writeStream.format("memory").queryName("records").start()
    try:
        q.processAllAvailable()
        assert spark.table("records").count() == 4
        (folder / "c.bin").write_bytes(RECORDS)
        q.processAllAvailable()
        got = spark.table("records")
        assert got.count() == 7 and plain(got.where("path like '%c.bin'").orderBy("record_index").drop("path", "record_index").collect()) == ROWS
    finally:
        q.stop()


# ---------------------------------------------------------------- parts


def test_parts(spark, source, tmp_path):
    job = tmp_path / "job"
    parts.convert_parts(spark, LAYOUT, source(), job, 2)
    assert sorted(p.name for p in (job / "parts").iterdir()) == [parts.part_name(i, "parquet") for i in range(2)]
    assert [rows_of(p) for p in sorted((job / "parts").iterdir())] == [ROWS[:2], ROWS[2:]]
    manifest = json.loads((job / "manifest.json").read_text())
    assert list(manifest) == ["format", "version", "input_bytes", "input_sha256", "layout_sha256", "record_length", "batch_records", "profile", "job_id"]
    assert (manifest["input_bytes"], manifest["input_sha256"][:6], manifest["record_length"]) == (105, "bc5083", 35)
    receipt = json.loads((job / "commits" / parts.part_name(1, "json")).read_text())
    assert (receipt["start_record"], receipt["record_count"]) == (2, 1)
    assert json.loads((job / "complete.json").read_text()) == {"version": 1, "job_id": manifest["job_id"], "part_count": 2, "total_records": 3}
    before = snapshot(job)
    for _ in range(2):
        parts.convert_parts(spark, LAYOUT, source(), job, 2, resume=True)
    with pytest.raises(RecoveryError, match="create output directory"):
        parts.convert_parts(spark, LAYOUT, source(), job, 2)
    assert snapshot(job) == before


def test_empty_job_has_one_empty_part(spark, source, tmp_path):
    parts.convert_parts(spark, LAYOUT, source(b""), tmp_path / "job", 2)
    f = pq.ParquetFile(tmp_path / "job/parts" / parts.part_name(0, "parquet"))
    assert f.metadata.num_rows == 0 and f.num_row_groups == 0


@pytest.mark.parametrize("n,b,want", [(0, 5, 1), (1, 5, 1), (5, 5, 1), (6, 5, 2), (10, 3, 4)])
def test_plan(n, b, want):
    job = parts.Manifest.plan(n * 7, "0" * 64, "1" * 64, 7, b)
    assert job.part_count == want
    assert sum(job.part(i)[1] for i in range(want)) == n
    with pytest.raises(RecoveryError):
        job.part(want)


class Stop(Exception):
    pass


STAGES = [(a, s) for a, stages in (("manifest", ("before_create", "before_sync", "before_rename", "after_rename")), ("part", ("before_rename", "after_rename")),
          ("receipt", ("before_create", "before_sync", "before_rename", "after_rename")), ("completion", ("before_create", "before_rename", "after_rename"))) for s in stages]


@pytest.mark.parametrize("artifact,stage", STAGES)
def test_resume_after_a_failure_anywhere(spark, source, tmp_path, artifact, stage):
    reference, job = tmp_path / "whole", tmp_path / "job"
    parts.convert_parts(spark, LAYOUT, source(RECORDS), reference, 2)

    def hook(a, s, index):
        if (a, s) == (artifact, stage) and index in (None, 1):
            raise Stop

    with pytest.raises(Stop):
        parts.convert_parts(spark, LAYOUT, source(), job, 2, hook=hook)
    parts.convert_parts(spark, LAYOUT, source(), job, 2, resume=True)
    assert snapshot(job) == snapshot(reference)


def test_bad_record_leaves_the_prefix(spark, source, tmp_path):
    data = bytearray(RECORDS * 3)
    data[35 * 4 + 12] = 0
    with pytest.raises(RecoveryError, match="input file byte 152: record 4, .*batch byte 12 "):
        parts.convert_parts(spark, LAYOUT, source(bytes(data)), tmp_path / "job", 2)
    assert len(list((tmp_path / "job/commits").iterdir())) == 2
    with pytest.raises(RecoveryError, match="record 4"):
        parts.convert_parts(spark, LAYOUT, source(bytes(data)), tmp_path / "job", 2, resume=True)


def test_resume_must_match(spark, source, tmp_path):
    job = tmp_path / "job"
    parts.convert_parts(spark, LAYOUT, source(), job, 2)
    before = snapshot(job)
    other = compile_copybook(COPYBOOK.replace("FILLER            PIC X(2)", "FILLER            PIC 9(2)"))
    flipped = RECORDS[:-1] + b"\0"
    for layout, data, batch, component in ((LAYOUT, flipped, 3, "input"), (other, RECORDS, 3, "layout/schema"), (with_metadata(LAYOUT, {"a": "b"}), RECORDS, 2, "layout/schema"), (LAYOUT, RECORDS, 3, "batch-records")):
        with pytest.raises(RecoveryError, match=f"incompatible resume: {component}"):
            parts.convert_parts(spark, layout, source(data), job, batch, resume=True)
    comment = compile_copybook(COPYBOOK.replace("* names are padded", "* another note"))
    parts.convert_parts(spark, comment, source(RECORDS, "moved.bin"), job, 2, resume=True)
    assert snapshot(job) == before


def test_metadata_travels(spark, source, tmp_path):
    layout = with_metadata(with_metadata(LAYOUT, {"owner": "á"}), {"unit": "x"}, LAYOUT.columns[0].name)
    parts.convert_parts(spark, layout, source(), tmp_path / "job", 3)
    schema = pq.read_schema(tmp_path / "job/parts" / parts.part_name(0, "parquet"))
    assert schema.metadata[b"owner"] == "á".encode() and schema.field(0).metadata[b"unit"] == b"x"
    parts.convert_parts(spark, layout, source(), tmp_path / "job", 3, resume=True)


def rewrite(path, **changes):
    path.write_text(json.dumps(json.loads(path.read_text()) | changes, separators=(",", ":")))


BROKEN = {
    "unknown file": lambda j: (j / "extra").write_text("x"),
    "unknown part": lambda j: (j / "parts/part-1.parquet").write_text("x"),
    "gap": lambda j: (j / "commits" / parts.part_name(0, "json")).unlink(),
    "lost part": lambda j: (j / "parts" / parts.part_name(0, "parquet")).unlink(),
    "changed part": lambda j: (j / "parts" / parts.part_name(0, "parquet")).write_bytes(b"PAR1"),
    "long receipt": lambda j: (j / "commits" / parts.part_name(1, "json")).write_bytes(b" " * 4097),
    "trailing": lambda j: (j / "manifest.json").write_text((j / "manifest.json").read_text() + "{}"),
    "twice": lambda j: (j / "manifest.json").write_text((j / "manifest.json").read_text().replace('"version":1', '"version":1,"version":1')),
    "unknown field": lambda j: rewrite(j / "manifest.json", more=1),
    "version": lambda j: rewrite(j / "manifest.json", version=2),
    "version too large": lambda j: rewrite(j / "manifest.json", version=2**32),
    "float": lambda j: rewrite(j / "complete.json", part_count=2.0),
    "negative": lambda j: rewrite(j / "complete.json", part_count=-1),
    "boolean": lambda j: rewrite(j / "complete.json", version=True),
    "profile": lambda j: rewrite(j / "manifest.json", profile="other"),
    "job id": lambda j: rewrite(j / "manifest.json", batch_records=7),
    "hash": lambda j: rewrite(j / "commits" / parts.part_name(0, "json"), parquet_sha256="A" * 64),
    "range": lambda j: rewrite(j / "commits" / parts.part_name(0, "json"), record_count=1),
    "early completion": lambda j: ((j / "commits" / parts.part_name(1, "json")).unlink(), (j / "parts" / parts.part_name(1, "parquet")).unlink()),
    "lost lock": lambda j: (j / ".m4.lock").unlink(),
    "lost folder": lambda j: shutil.rmtree(j / "parts"),
    "link": lambda j: (shutil.move(j / "parts", j.parent / "elsewhere"), (j / "parts").symlink_to(j.parent / "elsewhere")),
}


@pytest.mark.parametrize("name", BROKEN)
def test_invalid_state_is_rejected_and_untouched(spark, source, tmp_path, name):
    job = tmp_path / "job"
    parts.convert_parts(spark, LAYOUT, source(), job, 2)
    (job / "parts" / f".{parts.part_name(1, 'parquet')}.0123456789abcdef.tmp").write_text("left over")
    BROKEN[name](job)
    before = snapshot(job)
    with pytest.raises(RecoveryError):
        parts.convert_parts(spark, LAYOUT, source(), job, 2, resume=True)
    assert snapshot(job) == before


def test_forged_receipt_of_another_file(spark, source, tmp_path):
    job = tmp_path / "job"
    parts.convert_parts(spark, LAYOUT, source(), job, 2)
    part = job / "parts" / parts.part_name(0, "parquet")
    shutil.copy(job / "parts" / parts.part_name(1, "parquet"), part)
    size, digest = parts.file_sha256(part)
    rewrite(job / "commits" / parts.part_name(0, "json"), parquet_bytes=size, parquet_sha256=digest)
    with pytest.raises(RecoveryError, match="row count, row groups or compression"):
        parts.convert_parts(spark, LAYOUT, source(), job, 2, resume=True)


def test_completion_alone_is_made_again(spark, source, tmp_path):
    job = tmp_path / "job"
    parts.convert_parts(spark, LAYOUT, source(), job, 2)
    before = snapshot(job)
    (job / "complete.json").unlink()
    (job / "parts" / f".{parts.part_name(0, 'parquet')}.tmp").write_text("left over")
    parts.convert_parts(spark, LAYOUT, source(), job, 2, resume=True)
    assert snapshot(job) == before


def test_busy_bootstrap_and_places(spark, source, tmp_path):
    job = tmp_path / "job"
    job.mkdir()
    parts.convert_parts(spark, LAYOUT, source(), job, 2, resume=True)  # an empty folder is a beginning
    with parts._locked(job), pytest.raises(RecoveryError, match="busy"):
        parts.convert_parts(spark, LAYOUT, source(), job, 2, resume=True)
    other = tmp_path / "other"
    other.mkdir()
    (other / "file").write_text("mine")
    with pytest.raises(RecoveryError, match="unexpected bootstrap artifact"):
        parts.convert_parts(spark, LAYOUT, source(), other, 2, resume=True)
    assert [p.name for p in other.iterdir()] == ["file"]
    for cut in range(1, 35):
        with pytest.raises(RecoveryError, match="incomplete record"):
            parts.convert_parts(spark, LAYOUT, source(RECORDS[:cut]), tmp_path / "none", 2)
    assert not (tmp_path / "none").exists()
    inside = job / "in.bin"
    inside.write_bytes(RECORDS)
    with pytest.raises(RecoveryError, match="outside the output directory"):
        parts.convert_parts(spark, LAYOUT, inside, job, 2, resume=True)


def test_decoded_rows_equal_converted_rows(spark, source, tmp_path):
    path = source(RECORDS * 40)
    parts.convert_parts(spark, LAYOUT, path, tmp_path / "job", 17, wave=3)
    got = spark.read.parquet(str(tmp_path / "job/parts"))
    want = decode(read_records(spark, path, LAYOUT), LAYOUT)
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
