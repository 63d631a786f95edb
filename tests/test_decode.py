"""Codecs and decoding against plain Python, in Spark and in the scan."""

import itertools
from decimal import Decimal

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillrec.errors import DecodeError
from quillrec.functions.codecs import encode_record
from quillrec.functions.vectors import decode_records
from quillrec.operators.decode import ERROR_COLUMN, decode, decode_batch, decode_error, first_error
from quillrec.plans.layout import BINARY, DISPLAY, PACKED, TEXT, compile_copybook
from tests.fixtures import COPYBOOK, GROUP, RECORDS, ROWS, copybook, plain


def oracle(raw: bytes, f):
    """(value, kind, offset) of a field by hand."""
    if f.encoding == TEXT:
        return raw.decode("cp037"), None, None
    if f.encoding == DISPLAY:
        bad = next((i for i, b in enumerate(raw) if not 0xF0 <= b <= 0xF9), None)
        if bad is not None:
            return None, "InvalidDisplayDigit", bad
        number = int("".join(chr(b - 0xC0) for b in raw))
    elif f.encoding == BINARY:
        number = int.from_bytes(raw, "big", signed=f.signed)
        if abs(number) >= 10**f.precision:
            return None, "NumericOutOfRange", 0
    else:
        nibbles = [int(c, 16) for c in raw.hex()]
        if f.precision % 2 == 0 and nibbles[0]:
            return None, "InvalidPackedPadding", 0
        bad = next((i for i, n in enumerate(nibbles[:-1]) if n > 9), None)
        if bad is not None:
            return None, "InvalidPackedDigit", bad
        if nibbles[-1] not in ((10, 11, 12, 13, 14, 15) if f.signed else (15,)):
            return None, "InvalidPackedSign", len(raw) - 1
        number = int("".join(map(str, nibbles[:-1]))) * (-1 if nibbles[-1] in (11, 13) else 1)
    return (number if f.logical.name == "int64" else Decimal(number).scaleb(-f.scale)), None, None


def check(spark, layout, records):
    """Both decoders give what the oracle says, for values and first errors."""
    df = spark.createDataFrame([(i, bytearray(r)) for i, r in enumerate(records)], "i int, record binary")
    rows = decode(df, layout, errors="column", keep=("i",)).orderBy("i").collect()
    arrays, bad = decode_records(b"".join(records), layout)
    columns = [a.to_pylist() for a in arrays]
    for i, r in enumerate(records):
        error, at = rows[i][ERROR_COLUMN], 0
        wants = [(f, *oracle(r[f.offset : f.offset + f.byte_length], f)) for f in layout.data_fields]
        first = next(((f, k, o) for f, _, k, o in wants if k), None)
        assert bool(bad[i]) == (first is not None)
        if first:
            f, kind, offset = first
            assert (layout.fields[error["field"]], error["kind"], error["offset"]) == (f, kind, offset)
            assert error["byte"] == f.offset + (offset // 2 if kind == "InvalidPackedDigit" else offset)
        else:
            assert error is None
        for (f, value, kind, _), got, scan in zip(wants, rows[i][1 : 1 + len(wants)], (c[i] for c in columns), strict=True):
            assert got == value, (f, r.hex())
            if not kind:
                assert scan == value
            at += 1


def test_golden_rows(spark):
    assert plain(decode_batch(spark, RECORDS, compile_copybook(COPYBOOK)).collect()) == ROWS


def test_every_byte_of_cp037(spark):
    layout = compile_copybook(copybook("A PIC X.", "B PIC 9.", "C PIC S9 COMP-3.", "D PIC 9 COMP-3."))
    check(spark, layout, [bytes([b, b, b, b]) for b in range(256)] + [bytes([0, 0xF1, b, 0x1F]) for b in range(256)])


def test_all_two_byte_patterns(spark):
    layouts = [compile_copybook(copybook(p)) for p in ("A PIC S9(4) COMP.", "A PIC 9(2)V9(2) COMP.", "A PIC S9(2) COMP-3.", "A PIC 9(3) COMP-3.", "A PIC S9(1)V9(2) COMP-3.")]
    for layout in layouts:
        f = layout.fields[0]
        data = b"".join(i.to_bytes(2, "big") for i in range(65536))
        arrays, bad = decode_records(data, layout)
        values = arrays[0].to_pylist()
        df = spark.range(65536).select(F.col("id"), F.unhex(F.lpad(F.hex("id"), 4, "0")).alias("record"))
        rows = decode(df, layout, errors="column", keep=("id",)).orderBy("id").collect()
        for i in range(65536):
            value, kind, _ = oracle(i.to_bytes(2, "big"), f)
            assert rows[i][1] == value and (rows[i][ERROR_COLUMN] or {"kind": None})["kind"] == kind and bool(bad[i]) == bool(kind)
            if not kind:
                assert values[i] == value


@settings(max_examples=12, deadline=None)
@given(st.lists(st.binary(min_size=35, max_size=35), min_size=1, max_size=40))
def test_arbitrary_bytes(spark, records):
    check(spark, compile_copybook(COPYBOOK), records)


def test_limits(spark):
    pictures = ["A PIC 9(18).", "B PIC 9(1)V9(17).", "C PIC 9(18) BINARY.", "D PIC S9(1)V9(17) COMP.", "E PIC 9(18) COMP-3.", "F PIC S9(1)V9(17) COMP-3."]
    layout = compile_copybook(copybook(*pictures))
    top = 10**18 - 1
    value = {n: F.lit(v).cast(t) for n, v, t in (
        ("REC.A", str(top), "decimal(18,0)"), ("REC.B", f"9.{'9' * 17}", "decimal(18,17)"), ("REC.C", str(top), "decimal(18,0)"),
        ("REC.D", f"-9.{'9' * 17}", "decimal(18,17)"), ("REC.E", str(top), "decimal(18,0)"), ("REC.F", f"-9.{'9' * 17}", "decimal(18,17)"))}
    raw = bytes(spark.range(1).select(encode_record(layout, value).alias("r")).first()["r"])
    check(spark, layout, [raw])
    row = decode_batch(spark, raw, layout).first()
    assert [str(v) for v in row] == [str(top), f"9.{'9' * 17}", str(top), f"-9.{'9' * 17}", str(top), f"-9.{'9' * 17}"]


INVALID = [
    ("9(4) COMP", "FFFF", "NumericOutOfRange"), ("S9(4) COMP", "8000", "NumericOutOfRange"), ("9(9) BINARY", "FFFFFFFF", "NumericOutOfRange"),
    ("9(18) BINARY", "FFFFFFFFFFFFFFFF", "NumericOutOfRange"), ("9(3) COMP-3", "123D", "InvalidPackedSign"), ("9(3) COMP-3", "000D", "InvalidPackedSign"),
    ("9(3) COMP-3", "123C", "InvalidPackedSign"), ("9(2) COMP-3", "112F", "InvalidPackedPadding"), ("S9(3) COMP-3", "1A2C", "InvalidPackedDigit"), ("9(4) COMP", "2710", "NumericOutOfRange"),
]


@pytest.mark.parametrize("picture,data,kind", INVALID)
def test_invalid_values(spark, picture, data, kind):
    layout = compile_copybook(copybook(f"A PIC {picture}."))
    check(spark, layout, [bytes.fromhex(data)])
    with pytest.raises(DecodeError) as e:
        decode_batch(spark, bytes.fromhex(data), layout)
    assert e.value.kind == kind
    if data == "1A2C":
        assert "invalid packed digit 0xA at nibble 1" in str(e.value) and e.value.context["byte_offset"] == 0
    if data == "2710":
        assert str(e.value).endswith("unscaled value 10000 exceeds precision 4")


def test_first_error_is_of_the_first_record_then_field(spark):
    data = bytearray(RECORDS)
    data[48], data[30] = 0x40, 0xA4
    with pytest.raises(DecodeError) as e:
        decode_batch(spark, bytes(data), compile_copybook(COPYBOOK))
    assert e.value.context["record_index"] == 0 and e.value.context["field_path"] == f"{GROUP}.AMOUNT-PACKED"
    with pytest.raises(DecodeError, match="batch length 34 is not a multiple of record length 35"):
        decode_batch(spark, bytes(34), compile_copybook(COPYBOOK))


def test_strict_decoding_checks_columns_that_are_not_selected(spark):
    layout = compile_copybook(COPYBOOK)
    data = bytearray(RECORDS)
    data[83] = 0x40
    df = spark.createDataFrame([(i, bytearray(data[35 * i : 35 * i + 35])) for i in range(3)], "i int, record binary")
    name = f"`{GROUP}.CUSTOMER-NAME`"
    for q in (decode(df, layout).groupBy().count(), decode(df, layout, keep=("i",)).where("i = 0").select(name)):
        with pytest.raises(Exception, match="invalid record"):
            q.collect()
    with pytest.raises(Exception, match="invalid record"):
        decode(df, layout).select(name).collect()
    with pytest.raises(Exception, match="invalid record"):
        decode(df, layout).count()
    assert decode(df, layout, errors="ignore").count() == 3
    found = first_error(df.withColumnRenamed("i", "record_index"), layout)
    assert "batch byte 13 (line 6, column 16): invalid DISPLAY digit 0x40 at field byte 1" in str(decode_error(found[1], layout, found[0], 2))
    odd = spark.createDataFrame([(bytearray(3),), (None,)], "record binary")
    assert [tuple(r) for r in decode(odd.where("record is null"), layout, errors="ignore").collect()] == [(None,) * 6]
    with pytest.raises(Exception, match="invalid record"):
        decode(odd, layout).collect()


def test_decoding_stays_in_generated_code_and_is_pruned(spark):
    layout = compile_copybook(COPYBOOK)
    df = spark.createDataFrame([(bytearray(RECORDS[:35]),)], "record binary")
    q = decode(df, layout, errors="ignore").select(f"`{GROUP}.ACCOUNT-NUMBER`")
    text = q._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and text.count("ISO-8859-1") <= 1


def test_filler_only_layout(spark):
    layout = compile_copybook(copybook("FILLER PIC X(3)."))
    assert decode_batch(spark, bytes(9), layout).count() == 3


def test_text_arrays():
    layout = compile_copybook(copybook("A PIC X(3).", "B PIC X(2)."))
    for data in ("abcde", "éàücd", "abÿ¤é"):
        raw = (data + data[::-1]).encode("cp037")
        arrays, _ = decode_records(raw, layout)
        assert [a.to_pylist() for a in arrays] == [[data[:3], data[::-1][:3]], [data[3:], data[::-1][3:]]]
        for a in arrays:
            a.validate(full=True)
            assert a.type == pa.string()


def test_packed_signs():
    for signed, nibble in itertools.product((True, False), range(16)):
        layout = compile_copybook(copybook(f"A PIC {'S' if signed else ''}9 COMP-3."))
        arrays, bad = decode_records(bytes([0x10 | nibble]), layout)
        value, kind, _ = oracle(bytes([0x10 | nibble]), layout.fields[0])
        assert bool(bad[0]) == bool(kind) and (kind or arrays[0].to_pylist()[0] == value)
        assert layout.fields[0].encoding == PACKED
