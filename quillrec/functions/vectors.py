"""The field codecs over whole batches of records at once, for the scan: numpy in, Arrow out.

The scan's records are in Python anyway, so decoding them there saves a crossing; the results equal those of the Column expressions
(``functions.codecs``), which serve every other binary column.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from quillrec.errors import DecodeError
from quillrec.plans.layout import BINARY, DISPLAY, MAX_TEXT, TEXT, Field, Layout

_CP037 = np.array([ord(c) for c in bytes(range(256)).decode("cp037")], dtype=np.uint16)
_PLUS = np.isin(np.arange(16), (10, 12, 14, 15))
_SIGN = np.isin(np.arange(16), (10, 11, 12, 13, 14, 15))


def text_array(raw: np.ndarray, most: int = MAX_TEXT) -> pa.Array:
    """CP037 bytes (records x length) as strings: every byte is one character of one or two UTF-8 bytes, ``most`` bytes in all."""
    n, size = raw.shape
    points = _CP037[raw]
    wide = points >= 128
    if not wide.any():
        offsets = np.arange(0, (n + 1) * size, size, dtype=np.int64)
        data = points.astype(np.uint8)
    else:
        count = 1 + wide.ravel().astype(np.int64)
        ends = np.cumsum(count)
        data = np.empty(int(ends[-1]), dtype=np.uint8)
        flat, two = points.ravel(), wide.ravel()
        data[ends - 1] = np.where(two, 0x80 | flat & 0x3F, flat)
        data[ends[two] - 2] = 0xC0 | flat[two] >> 6
        offsets = np.concatenate(([0], ends[size - 1 :: size]))
    if offsets[-1] > most:
        raise DecodeError("CapacityExceeded", resource="the text of one batch")
    return pa.Array.from_buffers(pa.string(), n, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def display_values(raw: np.ndarray, f: Field) -> tuple[np.ndarray, np.ndarray]:
    digit = raw - np.uint8(0xF0)  # wraps below
    return _joined(digit), (digit > 9).any(axis=1)


def _joined(digits: np.ndarray) -> np.ndarray:
    value = np.zeros(len(digits), dtype=np.int64)
    for j in range(digits.shape[1]):
        value = value * 10 + digits[:, j]
    return value


def binary_values(raw: np.ndarray, f: Field) -> tuple[np.ndarray, np.ndarray]:
    kind = f">{'i' if f.signed else 'u'}{f.byte_length}"
    value = np.ascontiguousarray(raw).view(kind).ravel()
    limit = 10**f.precision
    bad = (value >= limit) | (value <= -limit) if f.signed else value >= np.uint64(limit) if f.byte_length == 8 else value >= limit
    return value.astype(np.int64), bad


def packed_values(raw: np.ndarray, f: Field) -> tuple[np.ndarray, np.ndarray]:
    digits = np.empty((len(raw), 2 * f.byte_length), dtype=np.uint8)
    digits[:, 0::2] = raw >> 4
    digits[:, 1::2] = raw & 15
    sign = digits[:, -1]
    bad = (digits[:, :-1] > 9).any(axis=1) | (~_SIGN[sign] if f.signed else sign != 15)
    if f.precision % 2 == 0:
        bad |= digits[:, 0] != 0
    value = _joined(digits[:, :-1])
    return np.where(_PLUS[sign], value, -value) if f.signed else value, bad


def number_array(value: np.ndarray, f: Field) -> pa.Array:
    if f.logical.name == "int64":
        return pa.array(value)
    both = np.empty((len(value), 2), dtype="<i8")
    both[:, 0], both[:, 1] = value, value >> 63
    return pa.Array.from_buffers(pa.decimal128(f.precision, f.scale), len(value), [None, pa.py_buffer(both)])


def checked_width(raw: np.ndarray, f: Field) -> np.ndarray:
    """A field's bytes (records x length), if they are as many as its item has."""
    if raw.shape[1] != f.byte_length:
        raise DecodeError("InvalidFieldLength", expected=f.byte_length, actual=raw.shape[1])
    return raw


def decode_records(data, layout: Layout) -> tuple[list[pa.Array], np.ndarray]:
    """Arrays of the layout's columns, and which records have an invalid field."""
    if len(data) % layout.record_length:
        raise DecodeError("InvalidBatchLength", actual=len(data), record_length=layout.record_length)
    records = np.frombuffer(data, dtype=np.uint8).reshape(-1, layout.record_length)
    bad = np.zeros(len(records), dtype=bool)
    out = []
    for f in layout.data_fields:
        raw = checked_width(records[:, f.offset : f.offset + f.byte_length], f)
        if f.encoding == TEXT:
            out.append(text_array(raw))
            continue
        value, wrong = {DISPLAY: display_values, BINARY: binary_values}.get(f.encoding, packed_values)(raw, f)
        bad |= wrong
        out.append(number_array(value, f))
    return out, bad
