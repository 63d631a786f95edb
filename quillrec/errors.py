"""Typed failures. Their texts are part of the interface, and fixed values."""

from __future__ import annotations

from dataclasses import dataclass


def quoted(value: str, mark: str = '"') -> str:
    """A value as diagnostics show it: in quotes, with escapes for the mark, backslash and control characters."""
    named = {"\\": "\\\\", "\n": "\\n", "\r": "\\r", "\t": "\\t", "\0": "\\0", mark: "\\" + mark}
    return mark + "".join(named.get(c) or (c if c.isprintable() else f"\\u{{{ord(c):x}}}") for c in value) + mark


@dataclass(frozen=True, order=True)
class Span:
    """One-based place in the copybook source."""

    line: int
    column: int

    def __str__(self) -> str:
        return f"line {self.line}, column {self.column}"


class CopybookError(ValueError):
    """A diagnostic with the place it points at; ``kind`` is one of the keys of ``TEXTS``."""

    TEXTS = {
        "InvalidSourceFormat": "invalid fixed-format source: {details}",
        "InvalidIndicator": "unsupported indicator {indicator} in column 7; expected a space, '*' or '/'",
        "InvalidLevel": "invalid level {value}; expected exactly two digits in the range 01..49",
        "InvalidName": "invalid data-name {value}; expected a letter followed by letters, digits or hyphens",
        "InvalidPicture": "invalid PICTURE {value}: {details}",
        "UnexpectedToken": "unexpected token {found}; expected {expected}",
        "UnexpectedEnd": "unexpected end of copybook; expected {expected}",
        "UnsupportedClause": "unsupported COBOL clause {clause}",
        "MissingPeriod": "missing period at end of data entry",
        "InvalidHierarchy": "invalid copybook hierarchy: {details}",
        "InvalidPrecision": "numeric precision {precision} is outside the supported range 1..={max}",
        "InvalidLength": "field byte length {length} is outside the supported range 1..={max}",
        "UnsupportedCombination": "unsupported PICTURE/USAGE combination: {details}",
        "LayoutOverflow": "compiled record layout exceeds addressable size",
        "DuplicateField": "duplicate field path {path}",
    }
    _QUOTED = {"value", "found", "clause", "path"}

    def __init__(self, kind: str, span: Span, **facts):
        shown = {k: quoted(v) if k in self._QUOTED else quoted(v, "'") if k == "indicator" else v for k, v in facts.items()}
        super().__init__(f"{span}: {self.TEXTS[kind].format(**shown)}")
        self.kind, self.span, self.facts = kind, span, facts


class DecodeError(ValueError):
    """A record that cannot be decoded, or an invalid layout or batch.

    ``context`` has record_index, field_path, byte_offset (within the batch) and span; it is None for failures of a whole
    batch or layout.
    """

    TEXTS = {
        "InvalidLayout": "invalid compiled layout (field {field_index}): {details}",
        "InvalidBatchLength": "batch length {actual} is not a multiple of record length {record_length}",
        "InvalidFieldLength": "expected {expected} field bytes, got {actual}",
        "InvalidDisplayDigit": "invalid DISPLAY digit 0x{byte:02X} at field byte {offset}",
        "InvalidPackedDigit": "invalid packed digit 0x{nibble:X} at nibble {nibble_index}",
        "InvalidPackedSign": "invalid packed sign 0x{nibble:X} for signed={signed}",
        "InvalidPackedPadding": "nonzero packed padding nibble 0x{nibble:X}",
        "NumericOutOfRange": "unscaled value {value} exceeds precision {precision}",
        "CapacityExceeded": "capacity exceeded for {resource}",
    }

    def __init__(self, kind: str, context: dict | None = None, **facts):
        shown = dict(facts)
        if "signed" in shown:
            shown["signed"] = str(shown["signed"]).lower()
        if kind == "InvalidLayout":
            shown["field_index"] = "None" if facts["field_index"] is None else f"Some({facts['field_index']})"
        text = self.TEXTS[kind].format(**shown)
        if context:
            text = "record {record_index}, field {field_path}, batch byte {byte_offset} ({span}): ".format(**context) + text
        super().__init__(text)
        self.kind, self.facts, self.context = kind, facts, context


class ConversionError(RuntimeError):
    TEXTS = {
        "InvalidBatchSize": "batch-records must be greater than zero",
        "CapacityExceeded": "conversion buffer capacity or file offset exceeded",
        "EmptySchema": "Parquet conversion requires at least one non-FILLER field",
        "Io": "{operation} {path}: {source}",
        "Decode": "input file byte {byte}: {source}",
        "TruncatedRecord": "incomplete record at input file byte {byte_offset}: expected {record_length} bytes, got {actual}",
        "Parquet": "Parquet output: {source}",
    }

    def __init__(self, kind: str, **facts):
        super().__init__(self.TEXTS[kind].format(**facts))
        self.kind, self.facts = kind, facts


class RecoveryError(RuntimeError):
    TEXTS = {
        "Conversion": "{source}",
        "Io": "{operation} {path}: {source}",
        "Metadata": "invalid recovery metadata {path}: {source}",
        "UnsupportedVersion": "unsupported recovery version {version}",
        "UnsupportedProfile": "unsupported recovery profile {profile}",
        "IncompatibleResume": "incompatible resume: {component}",
        "Busy": "conversion is busy: {path}",
        "InvalidState": "invalid recovery state {path}: {reason}",
        "MissingCommittedPart": "missing committed part {part_index}: {path}",
        "CorruptCommittedPart": "corrupt committed part {part_index} {path}: {reason}",
    }

    def __init__(self, kind: str, **facts):
        super().__init__(self.TEXTS[kind].format(**facts))
        self.kind, self.facts = kind, facts


class ProtectionError(RuntimeError):
    """``kind`` tells causes apart; the text of all failed authentications is one and the same."""

    UNIFORM = "M5 authentication/unprotection failed"
    TEXTS = {
        "OutputAlreadyExists": "M5 output already exists: {path}",
        "DestinationInM4Namespace": "M5 destination {path} is inside M4-managed namespace {root}",
        "UnsafePath": "unsafe M5 output path {path}: {reason}",
        "Io": "{operation} {path}: {source}",
        "InvalidMagic": "invalid {artifact} magic",
        "UnsupportedVersion": "unsupported {artifact} version {version}",
        "UnsupportedAlgorithm": "unsupported M5 key algorithm {algorithm}",
        "UnsupportedSuite": "unsupported M5 envelope suite {suite}",
        "InvalidKey": "invalid M5 key {path}: {reason}",
        "RecipientFingerprintMismatch": UNIFORM,
        "AuthenticationFailed": UNIFORM,
        "InputTooLarge": "M5 input has {length} bytes, exceeding the {maximum}-byte limit",
        "InvalidLength": "invalid {artifact} length: expected {expected} bytes, got {actual}",
    }

    def __init__(self, kind: str, **facts):
        super().__init__(self.TEXTS[kind].format(**facts))
        self.kind, self.facts = kind, facts
