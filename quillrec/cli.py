"""Command line: convert, convert-parts, keygen, protect, unprotect; ``--report-json`` with any of them.

Success is silent with status 0; a failure prints ``quillrec: <text>`` to stderr, with status 1.
"""

from __future__ import annotations

import json
import os
import sys
import time
from dataclasses import asdict, dataclass, field

PROGRAM = "quillrec"
#: Flags of each command, in the order its usage shows them; all but the last group are required.
COMMANDS = {
    "convert": (("--copybook", "file"), ("--input", "file"), ("--output", "file"), ("--batch-records", "N")),
    "convert-parts": (("--copybook", "file"), ("--input", "file"), ("--output-dir", "dir"), ("--batch-records", "N")),
    "keygen": (("--output-dir", "dir"),),
    "protect": (("--input", "file"), ("--public-key", "file"), ("--output", "file")),
    "unprotect": (("--input", "file"), ("--secret-key", "file"), ("--output", "file")),
}
_VALUED = {flag for flags in COMMANDS.values() for flag, _ in flags}


class UsageError(Exception):
    pass


def usage(command: str) -> str:
    flags = " ".join(f"{flag} <{kind}>" for flag, kind in COMMANDS[command])
    return f"usage: {PROGRAM} {command} {flags}" + (" [--resume]" if command == "convert-parts" else "")


def parse(argv: list[str]) -> tuple[str, dict[str, str], bool]:
    """Command, values by flag, and whether to resume."""
    command = argv[0] if argv else ""
    if command not in COMMANDS:
        raise UsageError(f"{usage('convert')}\n{usage('convert-parts')}")
    text, known = usage(command), dict(COMMANDS[command])
    values: dict[str, str] = {}
    resume, rest = False, iter(argv[1:])
    for flag in rest:
        if command == "convert-parts" and flag == "--resume" and not resume:
            resume = True
            continue
        if command == "convert-parts" and flag == "--resume":
            raise UsageError(f'unknown or duplicate argument "{flag}"\n{text}')
        value = next(rest, None)
        if value is None:
            raise UsageError(f'missing value for "{flag}"\n{text}')
        if flag not in known or flag in values:
            raise UsageError(f'unknown or duplicate argument "{flag}"\n{text}')
        if flag == "--batch-records" and not (value.removeprefix("+").isascii() and value.removeprefix("+").isdigit() and 0 < int(value) < 2**64):
            raise UsageError("batch-records must be a positive addressable integer")
        values[flag] = value
    if set(values) != set(known):
        raise UsageError(text)
    return command, values, resume


@dataclass
class Report:
    """What a run did, as one JSON object; what is not known is null. No paths, keys or contents."""

    command: str
    report_version: int = 1
    mode: str | None = None
    status: str = "error"
    elapsed_ms: int = 0
    error_category: str | None = "arguments"
    input_bytes: int | None = None
    output_bytes: int | None = None
    dataset_records: int | None = None
    dataset_parts: int | None = None
    batch_records: int | None = None
    record_length: int | None = None
    publication: dict | None = None
    warnings: list[str] = field(default_factory=list)

    def to_json(self) -> str:
        values = asdict(self)
        order = ["report_version", "command", *(k for k in values if k not in ("report_version", "command"))]
        return json.dumps({k: values[k] for k in order}, separators=(",", ":"))


def _file_size(path: str) -> int | None:
    return os.path.getsize(path) if os.path.isfile(path) else None


def _convert(spark, command: str, values: dict[str, str], resume: bool, report: Report) -> None:
    from quillrec.plans.layout import compile_copybook
    from quillrec.sources.convert import convert_file
    from quillrec.sources.parts import convert_parts

    batch, source = int(values["--batch-records"]), values["--input"]
    parts = command == "convert-parts"
    report.batch_records, report.input_bytes = batch, _file_size(source)
    report.mode = ("resume" if resume else "create") if parts else None
    report.error_category = "input_io"
    try:
        with open(values["--copybook"], encoding="utf-8", newline="") as f:
            text = f.read()
    except (OSError, UnicodeDecodeError) as e:
        raise RuntimeError(f"read copybook {values['--copybook']}: {e}") from e
    report.error_category = "copybook"
    layout = compile_copybook(text)
    report.record_length = layout.record_length
    report.error_category = "recovery" if parts else "conversion"
    if parts:
        convert_parts(Later(spark), layout, source, values["--output-dir"], batch, resume)
    else:
        convert_file(Later(spark), layout, source, values["--output"], batch)
        report.output_bytes = _file_size(values["--output"])
    if report.input_bytes is not None:
        report.dataset_records = report.input_bytes // layout.record_length
        report.dataset_parts = max(1, -(-report.dataset_records // batch)) if parts else None


def _protection(spark, command: str, values: dict[str, str], report: Report) -> None:
    from quillrec.sources import protect

    report.error_category = "protection"
    if command == "keygen":
        outcome = protect.generate_keypair(values["--output-dir"])
    else:
        report.input_bytes = _file_size(values["--input"])
        if command == "protect":
            outcome = protect.protect_file(spark(), values["--input"], values["--public-key"], values["--output"])
        else:
            outcome = protect.unprotect_file(spark(), values["--input"], values["--secret-key"], values["--output"])
        report.output_bytes = _file_size(values["--output"])
    report.warnings = outcome.pop("warnings")
    report.publication = outcome


class Later:
    """A session that starts when something of it is first used: a small file that is good needs none."""

    def __init__(self, start):
        self._start, self._session = start, None

    def __getattr__(self, name: str):
        if self._session is None:
            self._session = self._start()
        return getattr(self._session, name)


def session():
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName(PROGRAM).config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main(argv: list[str] | None = None, spark=session) -> int:
    began = time.monotonic()
    argv = list(sys.argv[1:] if argv is None else argv)
    command = argv[0] if argv else ""
    kept, asked, value = argv[:1], 0, False
    for arg in argv[1:]:  # a report flag that stands where a value should is a value
        if command in COMMANDS and not value and arg == "--report-json":
            asked += 1
            continue
        value = not value and arg in _VALUED
        kept.append(arg)
    report, failure = Report(command), None
    try:
        if asked > 1:
            raise UsageError("duplicate argument --report-json")
        command, values, resume = parse(kept)
        if command.startswith("convert"):
            _convert(spark, command, values, resume, report)
        else:
            _protection(spark, command, values, report)
        report.status, report.error_category = "success", None
    except Exception as e:  # noqa: BLE001 - every failure becomes one line and a status
        failure = e
    report.elapsed_ms = int((time.monotonic() - began) * 1000)
    if asked:
        try:
            print(report.to_json(), flush=True)
        except OSError:
            print(f"{PROGRAM}: warning: JSON report unavailable", file=sys.stderr)
    if failure is not None:
        print(f"{PROGRAM}: {failure}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
