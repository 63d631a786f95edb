"""Restartable conversion into deterministic Parquet parts, each committed by a receipt.

Tasks write parts under temporary names; the driver alone renames a part and then publishes its receipt, in order of the
part's index. So the receipts always form a prefix without gaps, whichever task ends first and whatever is killed.
"""

from __future__ import annotations

import fcntl
import hashlib
import json
import os
import re
import secrets
import stat
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import asdict, dataclass, fields
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import SparkSession

from quillrec.errors import ConversionError, RecoveryError
from quillrec.functions.vectors import decode_records
from quillrec.operators.decode import first_error
from quillrec.plans.layout import Layout, canonical_hash, layout_fingerprint
from quillrec.sources.convert import arrow_schema, checked, fail_at
from quillrec.sources.fixed import read_records

FORMAT, VERSION, PROFILE = "quillrec-parts", 1, "quillrec-v1-cp037-pyarrow-uncompressed"
LOCK, MANIFEST, COMPLETE, PARTS, COMMITS = ".m4.lock", "manifest.json", "complete.json", "parts", "commits"
MAX_JSON = 4096
_U64 = 2**64


def _bad(reason: str, path="") -> RecoveryError:
    return RecoveryError("InvalidState", path=path, reason=reason)


def _io(operation: str, path, source: OSError) -> RecoveryError:
    return RecoveryError("Io", operation=operation, path=path, source=source)


# ---------------------------------------------------------------- documents


class _Document:
    """A JSON document with exactly the fields of its dataclass, as compact JSON in their order."""

    def to_bytes(self) -> bytes:
        data = json.dumps(asdict(self), separators=(",", ":"), ensure_ascii=False).encode()
        if len(data) > MAX_JSON:
            raise RecoveryError("Metadata", path="", source="metadata exceeds the 4096-byte limit")
        return data

    @classmethod
    def read(cls, path: Path):
        try:
            with open(path, "rb") as f:
                data = f.read(MAX_JSON + 1)
        except OSError as e:
            raise _io("open metadata", path, e) from e
        if len(data) > MAX_JSON:
            raise _bad("metadata exceeds the 4096-byte limit", path)
        try:
            found = json.loads(data, object_pairs_hook=_without_repeats)
            return cls(**{f.name: _typed(found, f.name, f.type) for f in fields(cls) if _only(found, cls)})
        except (ValueError, TypeError, KeyError) as e:
            raise RecoveryError("Metadata", path=path, source=e) from e


def _without_repeats(pairs: list[tuple]) -> dict:
    if len({k for k, _ in pairs}) != len(pairs):
        raise ValueError("duplicate field")
    return dict(pairs)


def _only(found, cls) -> bool:
    if not isinstance(found, dict) or set(found) - {f.name for f in fields(cls)}:
        raise ValueError("unknown field, or not an object")
    return True


def _typed(found: dict, name: str, kind: str):
    value = found[name]
    if kind == "str" and type(value) is str:
        return value
    if kind == "int" and type(value) is int and 0 <= value < (2**32 if name == "version" else _U64):
        return value
    raise ValueError(f"invalid value of {name}")


def _is_hash(value: str) -> bool:
    return bool(re.fullmatch("[0-9a-f]{64}", value))


def _check_version(version: int) -> None:
    if version != VERSION:
        raise RecoveryError("UnsupportedVersion", version=version)


@dataclass
class Manifest(_Document):
    format: str
    version: int
    input_bytes: int
    input_sha256: str
    layout_sha256: str
    record_length: int
    batch_records: int
    profile: str
    job_id: str

    @classmethod
    def plan(cls, input_bytes: int, input_sha256: str, layout_sha256: str, record_length: int, batch_records: int) -> Manifest:
        new = cls(FORMAT, VERSION, input_bytes, input_sha256, layout_sha256, record_length, batch_records, PROFILE, "")
        new.check_dimensions()
        new.job_id = new.identity()
        new.check()
        return new

    def identity(self) -> str:
        return canonical_hash({k: v for k, v in asdict(self).items() if k != "job_id"})

    def check_dimensions(self) -> None:
        if self.record_length == 0 or self.batch_records == 0:
            raise _bad("record length and batch size must be positive")
        if self.input_bytes % self.record_length:
            raise _bad("input length is not a multiple of record length")
        if self.record_length * self.batch_records >= _U64:
            raise _bad("batch byte capacity overflow")

    def check(self) -> None:
        _check_version(self.version)
        if self.profile != PROFILE:
            raise RecoveryError("UnsupportedProfile", profile=self.profile)
        if self.format != FORMAT:
            raise _bad("unknown manifest format")
        self.check_dimensions()
        if not all(map(_is_hash, (self.input_sha256, self.layout_sha256, self.job_id))):
            raise _bad("hash must contain 64 lowercase hexadecimal characters")
        if self.job_id != self.identity():
            raise _bad("manifest job identity does not match its contents")

    @property
    def total_records(self) -> int:
        return self.input_bytes // self.record_length if self.record_length else 0

    @property
    def part_count(self) -> int:
        return max(1, -(-self.total_records // self.batch_records)) if self.batch_records else 1

    def part(self, index: int) -> tuple[int, int]:
        """First record and number of records of a part."""
        self.check_dimensions()
        if index >= self.part_count:
            raise _bad("part index exceeds the conversion range")
        start = index * self.batch_records
        return start, min(self.batch_records, self.total_records - start)


@dataclass
class Receipt(_Document):
    version: int
    job_id: str
    part_index: int
    start_record: int
    record_count: int
    parquet_bytes: int
    parquet_sha256: str

    def check(self, job: Manifest, index: int) -> None:
        _check_version(self.version)
        if not _is_hash(self.job_id) or not _is_hash(self.parquet_sha256):
            raise _bad("receipt contains an invalid hash")
        if self.job_id != job.job_id or self.part_index != index:
            raise _bad("receipt identity does not match its job and filename")
        if (self.start_record, self.record_count) != job.part(index):
            raise _bad("receipt does not match its deterministic record range")
        if self.parquet_bytes == 0:
            raise _bad("a Parquet artifact cannot be empty")


@dataclass
class Completion(_Document):
    version: int
    job_id: str
    part_count: int
    total_records: int

    def check(self, job: Manifest) -> None:
        _check_version(self.version)
        if not _is_hash(self.job_id) or self.job_id != job.job_id:
            raise _bad("completion identity does not match its job")
        if (self.part_count, self.total_records) != (job.part_count, job.total_records):
            raise _bad("completion does not cover the input exactly")


# ---------------------------------------------------------------- files


def file_sha256(path) -> tuple[int, str]:
    """Size and SHA-256 of a file, streamed."""
    size, digest = 0, hashlib.sha256()
    with open(path, "rb") as f:
        while data := f.read(1 << 20):
            size += len(data)
            digest.update(data)
    return size, digest.hexdigest()


def part_name(index: int, extension: str) -> str:
    return f"part-{index:020}.{extension}"


def parse_part_name(name: str, extension: str) -> tuple[int, bool] | None:
    """Index and whether the name is temporary; temporary parts may carry the attempt that wrote them."""
    m = re.fullmatch(rf"(\.?)part-([0-9]{{20}})\.{extension}((?:\.[0-9a-f]{{16}})?\.tmp)?", name)
    if not m or bool(m[1]) != bool(m[3]) or int(m[2]) >= _U64:
        return None
    return int(m[2]), bool(m[1])


def _kind(path: Path, folder: bool) -> None:
    mode = os.lstat(path).st_mode
    if stat.S_ISLNK(mode):
        raise _bad("symbolic links are not allowed", path)
    if not (stat.S_ISDIR(mode) if folder else stat.S_ISREG(mode)):
        raise _bad("unexpected artifact type", path)


def _children(folder: Path) -> list[Path]:
    try:
        return sorted(folder.iterdir())
    except OSError as e:
        raise _io("list directory", folder, e) from e


def _sync(folder: Path) -> None:
    fd = os.open(folder, os.O_RDONLY)
    try:
        os.fsync(fd)
    finally:
        os.close(fd)


#: Called with (artifact, stage, index) around every publication; tests inject failures here.
Hook = Callable[[str, str, int | None], None]


def _none(artifact: str, stage: str, index: int | None) -> None:
    pass


def _publish(path: Path, data: bytes, artifact: str, index: int | None, hook: Hook) -> None:
    temporary = path.parent / f".{path.name}.tmp"
    hook(artifact, "before_create", index)
    try:
        with open(temporary, "xb") as f:
            f.write(data)
            f.flush()
            hook(artifact, "before_sync", index)
            os.fsync(f.fileno())
        hook(artifact, "before_rename", index)
        os.link(temporary, path)  # never over an existing file
        os.unlink(temporary)
        _sync(path.parent)
    except OSError as e:
        raise _io("publish", path, e) from e
    hook(artifact, "after_rename", index)


def _check_bootstrap(root: Path) -> None:
    """Without a manifest only traces of a job that had not yet begun may be there."""
    for p in _children(root):
        if p.name in (LOCK, f".{MANIFEST}.tmp"):
            _kind(p, False)
        elif p.name in (PARTS, COMMITS):
            _kind(p, True)
            if _children(p):
                raise _bad("bootstrap directory must be empty", p)
        else:
            raise _bad("unexpected bootstrap artifact", p)


@contextmanager
def _locked(root: Path) -> Iterator[None]:
    path = root / LOCK
    if os.path.lexists(path):
        _kind(path, False)
    else:
        _check_bootstrap(root)  # a lock that an initialised job has lost is never made anew
    try:
        fd = os.open(path, os.O_RDWR | os.O_CREAT, 0o644)
    except OSError as e:
        raise _io("open lock", path, e) from e
    try:
        try:
            fcntl.flock(fd, fcntl.LOCK_EX | fcntl.LOCK_NB)
        except BlockingIOError as e:
            raise RecoveryError("Busy", path=path) from e
        yield
    finally:
        os.close(fd)


def verify_part(path: Path, layout: Layout, rows: int, index: int) -> None:
    """Footer, schema, rows, row groups and compression of a part."""

    def corrupt(reason: str) -> RecoveryError:
        return RecoveryError("CorruptCommittedPart", part_index=index, path=path, reason=reason)

    try:
        with pq.ParquetFile(path) as f:
            meta, schema = f.metadata, f.schema_arrow
    except (OSError, pa.ArrowException) as e:
        raise corrupt(f"invalid Parquet footer: {e}") from e
    want = arrow_schema(layout)
    same = schema.remove_metadata() == want.remove_metadata() and all(
        {k: v for k, v in (a.metadata or {}).items() if k != b"PARQUET:field_id"} == (b.metadata or {}) for a, b in zip(schema, want, strict=True)
    )
    if not same or {k: v for k, v in (schema.metadata or {}).items() if k != b"ARROW:schema"} != (want.metadata or {}):
        raise corrupt("schema differs from compiled layout")
    groups = [meta.row_group(i) for i in range(meta.num_row_groups)]
    packed = any(g.column(c).compression != "UNCOMPRESSED" for g in groups for c in range(g.num_columns))
    if meta.num_rows != rows or len(groups) != (rows != 0) or any(g.num_rows != rows for g in groups) or packed:
        raise corrupt("row count, row groups or compression differs from profile")


def _verify_committed(root: Path, job: Manifest, layout: Layout, index: int) -> None:
    path = root / COMMITS / part_name(index, "json")
    receipt = Receipt.read(path)
    try:
        receipt.check(job, index)
    except RecoveryError as e:
        if e.kind == "InvalidState":
            raise _bad(e.facts["reason"], path) from e
        raise
    part = root / PARTS / part_name(index, "parquet")
    if not os.path.lexists(part):
        raise RecoveryError("MissingCommittedPart", part_index=index, path=part)
    if file_sha256(part) != (receipt.parquet_bytes, receipt.parquet_sha256):
        raise RecoveryError("CorruptCommittedPart", part_index=index, path=part, reason="size or SHA-256 differs from receipt")
    verify_part(part, layout, receipt.record_count, index)


def validate_state(root: Path, job: Manifest, layout: Layout) -> tuple[int, bool]:
    """Number of committed parts, and whether the job is complete. Looks at everything and changes nothing."""
    plain = {LOCK, MANIFEST, f".{MANIFEST}.tmp", COMPLETE, f".{COMPLETE}.tmp"}
    for p in _children(root):
        if p.name not in plain | {PARTS, COMMITS}:
            raise _bad("unknown artifact", p)
        _kind(p, p.name in (PARTS, COMMITS))
    commits, parts = root / COMMITS, root / PARTS
    for folder in (commits, parts):
        if not os.path.lexists(folder):
            raise _bad("missing artifact", folder)
    committed = set()
    for p in _children(commits):
        _kind(p, False)
        if (found := parse_part_name(p.name, "json")) is None:
            raise _bad("unknown receipt name", p)
        if found[0] >= job.part_count:
            raise _bad("receipt index outside input", p)
        if not found[1]:
            committed.add(found[0])
    count = len(committed)
    if committed and max(committed) + 1 != count:
        raise _bad("committed receipt sequence has a gap", commits)
    for p in _children(parts):
        _kind(p, False)
        if (found := parse_part_name(p.name, "parquet")) is None:
            raise _bad("unknown part name", p)
        if found[0] >= job.part_count or not found[1] and found[0] > count:
            raise _bad("unexpected part beyond committed prefix", p)
    for index in range(count):
        _verify_committed(root, job, layout, index)
    path = root / COMPLETE
    done = os.path.lexists(path)
    if done:
        marker = Completion.read(path)
        try:
            marker.check(job)
        except RecoveryError as e:
            raise (_bad(e.facts["reason"], path) if e.kind == "InvalidState" else e) from e
        if count != job.part_count:
            raise _bad("completion precedes all part commits", path)
    return count, done


def _clean(root: Path, count: int, hook: Hook) -> None:
    """Removes temporaries, and the one part that was renamed but got no receipt."""
    doomed = [p for name in (MANIFEST, COMPLETE) if os.path.lexists(p := root / f".{name}.tmp")]
    for folder, extension in ((PARTS, "parquet"), (COMMITS, "json")):
        for p in _children(root / folder):
            index, temporary = parse_part_name(p.name, extension)
            if temporary or folder == PARTS and index == count:
                doomed.append(p)
    for p in doomed:
        _kind(p, False)
        hook("cleanup", "before_remove", None)
        os.unlink(p)
        hook("cleanup", "after_remove", None)


# ---------------------------------------------------------------- conversion


def _write_part(root: str, input_path: str, layout: Layout, job: Manifest, index: int) -> tuple[int, str, int, str] | None:
    """In a task: decodes one part into a temporary file, synced and verified. None if a record is invalid."""
    start, count = job.part(index)
    with open(input_path, "rb") as f:
        f.seek(start * layout.record_length)
        data = f.read(count * layout.record_length)
    if len(data) != count * layout.record_length:
        raise _bad("input changed during conversion", input_path)
    columns, bad = decode_records(data, layout)
    if bad.any():
        return None
    path = Path(root) / PARTS / f".{part_name(index, 'parquet')}.{secrets.token_hex(8)}.tmp"
    schema = arrow_schema(layout)
    table = pa.Table.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
    with open(path, "xb") as sink:
        with pq.ParquetWriter(sink, schema, compression="NONE") as writer:
            if count:
                writer.write_table(table, row_group_size=count)
        sink.flush()
        os.fsync(sink.fileno())
    verify_part(path, layout, count, index)
    return index, os.fspath(path), *file_sha256(path)


def _commit(root: Path, job: Manifest, staged: tuple[int, str, int, str], hook: Hook) -> None:
    index, temporary, size, digest = staged
    final = root / PARTS / part_name(index, "parquet")
    hook("part", "before_rename", index)
    try:
        os.link(temporary, final)
        os.unlink(temporary)
        _sync(final.parent)
    except OSError as e:
        raise _io("publish", final, e) from e
    hook("part", "after_rename", index)
    receipt = Receipt(VERSION, job.job_id, index, *job.part(index), size, digest)
    _publish(root / COMMITS / part_name(index, "json"), receipt.to_bytes(), "receipt", index, hook)


def _fingerprint(path: Path) -> tuple[int, str]:
    try:
        before = os.stat(path)
        if not stat.S_ISREG(before.st_mode):
            raise _bad("input must be a regular file", path)
        size, digest = file_sha256(path)
        after = os.stat(path)
    except OSError as e:
        raise _io("open input", path, e) from e
    if not before.st_size == size == after.st_size:
        raise _bad("input changed during identity validation", path)
    return size, digest


def _wave(spark: SparkSession, root: Path, source: Path, layout: Layout, job: Manifest, indexes: range) -> list:
    """One task for each part; what comes back to the driver is a name, a size and a hash each."""
    if len(indexes) == 1:
        return [_write_part(os.fspath(root), os.fspath(source), layout, job, indexes[0])]
    args = (os.fspath(root), os.fspath(source), layout, job)
    rdd = spark.sparkContext.parallelize(list(indexes), min(len(indexes), 4 * spark.sparkContext.defaultParallelism))
    return rdd.map(lambda i: _write_part(*args, i)).collect()


def convert_parts(spark: SparkSession, layout: Layout, input_path, output_dir, batch_records: int = 65_536, resume: bool = False, hook: Hook = _none, wave: int | None = None) -> None:
    """Converts into parts of ``batch_records`` records each, or resumes a validated prefix of them.

    Parts are written in parallel, ``wave`` at a time (four for each core by default), and committed in order after each wave.
    A failure leaves the parts before it committed. The input must not change meanwhile; the output is a POSIX folder that
    driver and executors share.
    """
    try:
        checked(layout, batch_records)
    except ConversionError as e:
        raise RecoveryError("Conversion", source=e) from e
    source = Path(input_path)
    try:
        source = source.resolve(strict=True)
    except OSError as e:
        raise _io("resolve input", input_path, e) from e
    root = Path(os.path.abspath(output_dir))
    if os.path.islink(root):
        raise _bad("symbolic links are not allowed", root)
    root = root.parent.resolve() / root.name
    if source.is_relative_to(root):
        raise _bad("input must be outside the output directory", source)
    if not resume:
        job = _plan(source, layout, batch_records)
        try:
            os.mkdir(root)
        except OSError as e:
            raise _io("create output directory", root, e) from e
    elif not root.is_dir():
        raise _io("open output directory", root, FileNotFoundError(2, "No such directory"))
    with _locked(root):
        if resume:
            job = _plan(source, layout, batch_records)
        job = _joined(root, job, hook)
        count, done = validate_state(root, job, layout)
        _clean(root, count, hook)
        if done:
            return
        step = wave or 4 * spark.sparkContext.defaultParallelism
        for first in range(count, job.part_count, step):
            for index, staged in enumerate(_wave(spark, root, source, layout, job, range(first, min(first + step, job.part_count))), first):
                if staged is None:
                    start, n = job.part(index)
                    records = read_records(spark, source, layout, firstRecord=start, lastRecord=start + n - 1, truncated="drop")
                    raise RecoveryError("Conversion", source=fail_at(first_error(records, layout), layout, batch_records))
                _commit(root, job, staged, hook)
        if os.stat(source).st_size > job.input_bytes:
            raise _bad("input grew after identity validation", source)
        marker = Completion(VERSION, job.job_id, job.part_count, job.total_records)
        _publish(root / COMPLETE, marker.to_bytes(), "completion", None, hook)


def _plan(source: Path, layout: Layout, batch_records: int) -> Manifest:
    size, digest = _fingerprint(source)
    if rest := size % layout.record_length:
        cause = ConversionError("TruncatedRecord", byte_offset=size - rest, record_length=layout.record_length, actual=rest)
        raise RecoveryError("Conversion", source=cause)
    return Manifest.plan(size, digest, layout_fingerprint(layout), layout.record_length, batch_records)


def _joined(root: Path, job: Manifest, hook: Hook) -> Manifest:
    """The job on disk, if it is the same; else publishes the manifest into an empty bootstrap."""
    path = root / MANIFEST
    if not os.path.lexists(path):
        _check_bootstrap(root)
        temporary = root / f".{MANIFEST}.tmp"
        if os.path.lexists(temporary):
            os.unlink(temporary)
        for name in (PARTS, COMMITS):
            (root / name).mkdir(exist_ok=True)
        _publish(path, job.to_bytes(), "manifest", None, hook)
        return job
    _kind(path, False)
    there = Manifest.read(path)
    try:
        there.check()
    except RecoveryError as e:
        raise (_bad(e.facts["reason"], path) if e.kind == "InvalidState" else e) from e
    for component, names in (("input", ("input_bytes", "input_sha256")), ("layout/schema", ("layout_sha256", "record_length")), ("batch-records", ("batch_records",))):
        if any(getattr(there, n) != getattr(job, n) for n in names):
            raise RecoveryError("IncompatibleResume", component=component)
    return there
