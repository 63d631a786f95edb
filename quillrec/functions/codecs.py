"""Field codecs as Column expressions: values, errors, and encoders for tools and tests.

Every expression is made of built-in functions, so decoding stays in generated code. A number is read from the hex form
of its bytes; value and error of a field share that form.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillrec.plans.layout import BINARY, DISPLAY, PACKED, TEXT, Field

#: CP037 to Unicode. Characters that stay the same are left out: translate() would take U+0000 for "delete".
_LATIN = "".join(map(chr, range(256)))
_CP037 = bytes(range(256)).decode("cp037")
CP037_FROM = "".join(a for a, b in zip(_LATIN, _CP037, strict=True) if a != b)
CP037_TO = "".join(b for a, b in zip(_LATIN, _CP037, strict=True) if a != b)

ERROR = "struct<kind:string,offset:int,code:int,value:decimal(20,0)>"


def field_bytes(record: Column, f: Field) -> Column:
    return F.substring(record, f.offset + 1, f.byte_length)


def decode_text(raw: Column) -> Column:
    """All bytes, none trimmed or replaced."""
    return F.translate(F.decode(raw, "ISO-8859-1"), CP037_FROM, CP037_TO)


def utf8_length(raw: Column) -> Column:
    """Bytes that CP037 text takes in UTF-8."""
    return F.octet_length(decode_text(raw))


def encode_text(text: Column, length: int) -> Column:
    """CP037 bytes, padded with its space. Characters outside Latin-1 become ``?`` as in the charset's encoder."""
    plain = F.translate(text, CP037_TO, CP037_FROM)
    return F.encode(F.rpad(plain, length, "@"), "ISO-8859-1")


def _error(kind: str, offset: Column, code: Column | None = None, value: Column | None = None) -> Column:
    none_int, none_dec = F.lit(None).cast("int"), F.lit(None).cast("decimal(20,0)")
    return F.struct(
        F.lit(kind).alias("kind"),
        offset.cast("int").alias("offset"),
        (none_int if code is None else code.cast("int")).alias("code"),
        (none_dec if value is None else value.cast("decimal(20,0)")).alias("value"),
    )


@dataclass(frozen=True)
class Decoded:
    """value: null where error is not; error: null or a struct of ERROR (offset: byte or nibble within the field)."""

    value: Column
    error: Column


def _nibble(hexes: Column, index: int | Column) -> Column:
    return F.conv(F.substr(hexes, (F.lit(index) if isinstance(index, int) else index) + 1, F.lit(1)), 16, 10).cast("int")


def _scaled(value: Column, f: Field) -> Column:
    """An exact unscaled number (decimal of scale 0) as the field's type."""
    if f.logical.name == "int64":
        return value.cast("bigint")
    if f.scale == 0:
        return value.cast(T.DecimalType(f.precision, 0))
    # digits are moved behind the point without a division
    unit = F.lit("0." + "0" * (f.scale - 1) + "1").cast(T.DecimalType(f.scale, f.scale))
    return (value.cast("decimal(18,0)") * unit).cast(T.DecimalType(f.precision, f.scale))


def decode_display(raw: Column, f: Field) -> Decoded:
    """F0 to F9 for each digit; the first other byte is an error."""
    h = F.hex(raw)
    good = h.rlike(f"^(?:F[0-9]){{{f.byte_length}}}$")
    digits = F.decode(raw, "ISO-8859-1")
    digits = F.translate(digits, "".join(map(chr, range(0xF0, 0xFA))), "0123456789")
    value = F.when(good, digits).cast("decimal(18,0)")
    at = (F.length(F.regexp_extract(h, "^(?:F[0-9])*", 0)) / 2).cast("int")
    code = F.conv(F.substr(h, 2 * at + 1, F.lit(2)), 16, 10)
    return Decoded(_scaled(value, f), F.when(~good, _error("InvalidDisplayDigit", at, code)))


def decode_binary(raw: Column, f: Field) -> Decoded:
    """Big-endian; two's complement if signed; magnitudes of 10**precision and more are errors."""
    bits = 8 * f.byte_length
    value = F.conv(F.hex(raw), 16, 10).cast("decimal(20,0)")
    if f.signed:
        half, whole = (F.lit(str(2**b)).cast("decimal(20,0)") for b in (bits - 1, bits))
        value = F.when(value >= half, value - whole).otherwise(value).cast("decimal(20,0)")
    over = F.abs(value) >= F.lit(str(10**f.precision)).cast("decimal(20,0)")
    return Decoded(_scaled(F.when(~over, value), f), F.when(over, _error("NumericOutOfRange", F.lit(0), None, value)))


def decode_packed(raw: Column, f: Field) -> Decoded:
    """Two digits a byte, the last nibble a sign: A, C, E, F plus and B, D minus if signed, F alone if not.

    With an even precision the first nibble is padding and must be 0. The leftmost fault counts. Minus zero is zero.
    """
    h = F.hex(raw)
    pad = 1 - f.precision % 2
    signs = "A-F" if f.signed else "F"
    good = h.rlike(f"^{'0' * pad}[0-9]{{{f.precision}}}[{signs}]$")
    digits = F.substring(h, pad + 1, f.precision)
    value = F.when(good, digits).cast("decimal(18,0)")
    if f.signed:
        value = F.when(F.right(h, F.lit(1)).isin("B", "D"), -value).otherwise(value).cast("decimal(18,0)")
    clean = F.length(F.regexp_extract(digits, "^[0-9]*", 0))
    bad_digit = clean < f.precision
    fault = F.when(bad_digit, _error("InvalidPackedDigit", clean + pad, _nibble(h, clean + pad)))
    if pad:
        fault = F.when(F.left(h, F.lit(1)) != "0", _error("InvalidPackedPadding", F.lit(0), _nibble(h, 0))).otherwise(fault)
    last = 2 * f.byte_length - 1
    sign = _error("InvalidPackedSign", F.lit(f.byte_length - 1), _nibble(h, last))
    return Decoded(_scaled(value, f), F.when(~good, F.coalesce(fault, sign)))


def decode_field(record: Column, f: Field) -> Decoded:
    raw = field_bytes(record, f)
    if f.encoding == TEXT:
        return Decoded(decode_text(raw), F.lit(None).cast(ERROR))
    return {DISPLAY: decode_display, BINARY: decode_binary, PACKED: decode_packed}[f.encoding](raw, f)


def _unscaled(value: Column, f: Field) -> Column:
    """The number without its point, as a decimal of scale 0."""
    exact = value.cast(T.DecimalType(38, f.scale or 0))
    return (exact * F.lit(10 ** (f.scale or 0)).cast("decimal(19,0)")).cast("decimal(20,0)")


def encode_field(value: Column, f: Field, plus: str | Column = "C", minus: str | Column = "D") -> Column:
    """The inverse of ``decode_field`` for values within the field's range; ``plus`` and ``minus`` are packed signs."""
    if f.encoding == TEXT:
        return encode_text(value, f.byte_length)
    number = _unscaled(value, f)
    digits = F.lpad(F.abs(number).cast("string"), f.precision, "0")
    if f.encoding == DISPLAY:
        return F.unhex(F.regexp_replace(digits, "(.)", "F$1"))
    if f.encoding == BINARY:
        whole = F.lit(str(2 ** (8 * f.byte_length))).cast("decimal(20,0)")
        number = F.when(number < 0, number + whole).otherwise(number).cast("decimal(20,0)")
        return F.unhex(F.lpad(F.conv(number.cast("string"), 10, 16), 2 * f.byte_length, "0"))
    as_column = lambda s: F.lit(s) if isinstance(s, str) else s
    sign = F.when(number < 0, as_column(minus)).otherwise(as_column(plus)) if f.signed else F.lit("F")
    return F.unhex(F.lpad(F.concat(digits, sign), 2 * f.byte_length, "0"))


def encode_record(layout, values: dict[str, Column], filler: bytes = b"\xff") -> Column:
    """A record of ``layout`` from a column for each path; FILLER is filled with a byte."""
    parts = [encode_field(values[f.path], f) if f.path is not None else F.lit(filler * f.byte_length) for f in layout.fields]
    return F.concat(*parts)
