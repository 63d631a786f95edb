"""Copybook source to entries and layouts: accepted forms, places of diagnostics, sizes."""

import random
import string

import pytest

from quillrec.errors import CopybookError, DecodeError, Span
from quillrec.plans.copybook import parse_copybook
from quillrec.plans.layout import Column, compile_copybook, layout_fingerprint, validate_layout, with_metadata
from tests.fixtures import COPYBOOK, GROUP, copybook


def test_golden_layout():
    layout = compile_copybook(COPYBOOK)
    assert layout.record_length == 35 and layout.name == "SAMPLE-RECORD"
    assert [f.offset for f in layout.fields] == [0, 10, 12, 16, 23, 25, 29, 34]
    assert [f.byte_length for f in layout.fields] == [10, 2, 4, 7, 2, 4, 5, 1]
    assert [f.span for f in layout.fields] == [Span(i, 16) for i in range(4, 12)]
    assert [c.name for c in layout.columns] == [f"{GROUP}.{n}" for n in ("CUSTOMER-NAME", "ACCOUNT-NUMBER", "INTEREST-RATE", "BALANCE-BIN", "RATE-BIN", "AMOUNT-PACKED")]
    assert [f.dataType.simpleString() for f in layout.schema()] == ["string", "bigint", "decimal(7,2)", "bigint", "decimal(7,2)", "decimal(9,2)"]
    assert not any(f.nullable for f in layout.schema())


A = "000100 01 SAMPLE-RECORD.\n"
REJECTED = {
    "occurs": (A + "000200 05 ITEMS OCCURS 3 TIMES.\n", 2, 17, "OCCURS"),
    "redefines": (A + "000200 05 FIRST PIC X(4).\n000300 05 ALIAS REDEFINES FIRST PIC X(4).\n", 3, 17, "REDEFINES"),
    "value": (A + "000200 05 STATUS-CODE PIC X VALUE 'A'.\n", 2, 29, "VALUE"),
    "copy": (A + "000200 COPY COMMON-FIELDS.\n", 2, 8, "COPY"),
    "comp-5": (A + "000200 05 COUNTER PIC S9(9) COMP-5.\n", 2, 29, "COMP-5"),
    "signed display": (A + "000200 05 SIGNED-TEXT PIC S9(4) DISPLAY.\n", 2, 8, "DISPLAY"),
    "level 88": (A + "000200 05 STATUS-CODE PIC X.\n000300 88 STATUS-OK VALUE 'Y'.\n", 3, 8, "88"),
    "two roots": (A + "000200 05 F PIC X.\n000300 01 OTHER.\n000400 05 G PIC X.\n", 3, 8, "root"),
    "child": (A + "000200 05 F PIC X(4).\n000300 10 G PIC X.\n", 3, 8, "elementary"),
    "precision": (A + "000200 05 TOO-WIDE PIC 9(17)V9(2) COMP-3.\n", 2, 8, "precision"),
    "non-ascii comment": (A + "000200*é\n", 2, 8, "non-ASCII character 'é'"),
    "tab": ("000100\t01 A.\n", 1, 7, "tabs"),
    "control": (A + "000200 05 F\x01 PIC X.\n", 2, 12, "0x01"),
    "short": ("0001\n", 1, 5, "4 columns"),
    "indicator": ("000100D01 A.\n", 1, 7, "unsupported indicator 'D'"),
    "no period": (A + "000200 05 F PIC X\n000300 05 G PIC X.\n", 3, 8, "missing period"),
    "no period at end": (A + "000200 05 F PIC X", 2, 18, "missing period"),
    "name": (A + "000200 05 1F PIC X.\n", 2, 11, 'invalid data-name "1F"'),
    "name ends in hyphen": (A + "000200 05 F- PIC X.\n", 2, 11, "data-name"),
    "level 50": (A + "000200 50 F PIC X.\n", 2, 8, 'invalid level "50"'),
    "level 5": (A + "000200 5 F PIC X.\n", 2, 8, 'invalid level "5"'),
    "empty": ("", 1, 8, "must contain one root"),
    "starts at 05": ("000100 05 F PIC X.\n", 1, 8, "first entry"),
    "root with picture": ("000100 01 F PIC X.\n", 1, 8, "must be a group"),
    "root filler": ("000100 01 FILLER.\n000200 05 F PIC X.\n", 1, 8, "FILLER"),
    "filler group": (A + "000200 05 FILLER.\n000300 10 F PIC X.\n", 2, 8, "FILLER"),
    "empty group": (A + "000200 05 G.\n000300 05 F PIC X.\n", 2, 8, "group G must contain"),
    "duplicate": (A + "000200 05 F PIC X.\n000300 05 f PIC 9.\n", 3, 8, 'duplicate field path "SAMPLE-RECORD.F"'),
    "duplicate group": (A + "000200 05 G.\n000300 10 F PIC X.\n000400 05 G.\n000500 10 H PIC X.\n", 4, 8, "SAMPLE-RECORD.G"),
    "text with usage": (A + "000200 05 F PIC X COMP.\n", 2, 8, "unsigned DISPLAY"),
    "too long": (A + "000200 05 F PIC X(2147483648).\n", 2, 8, "2147483648 is outside"),
    "usage missing": (A + "000200 05 F PIC 9 USAGE IS.\n", 2, 27, 'unexpected token "."'),
    "picture missing": (A + "000200 05 F PIC.\n", 2, 16, "expected a supported PICTURE"),
    "end in picture": (A + "000200 05 F PIC", 2, 16, "unexpected end"),
    "digits in AST": (A + "000200 05 F PIC 9(256).\n", 2, 17, "does not fit in the AST"),
}


@pytest.mark.parametrize("name", REJECTED)
def test_rejections(name):
    source, line, column, part = REJECTED[name]
    with pytest.raises(CopybookError) as e:
        compile_copybook(source)
    assert (e.value.span.line, e.value.span.column) == (line, column) and part in str(e.value)
    assert str(e.value).startswith(f"line {line}, column {column}: ")


@pytest.mark.parametrize("picture", ["X(0)", "X()", "SX(2)", "99", "9V9", "9(2)V9", "9(2)V9(0)", "S", "9(2)A", "V99", "9(0)", "XX", "A(3)", "9(2)V9(2)V9(1)"])
def test_rejected_pictures(picture):
    with pytest.raises(CopybookError, match="invalid PICTURE"):
        compile_copybook(copybook(f"F PIC {picture}."))


def test_accepted_spellings():
    layout = compile_copybook(
        "000100 01 rec.\r\n\r\n      / page\n" + "000200 05 PIC PIC IS x(007).".ljust(72) + "IGNORED\n"
        "000300 05 A\n000400 PICTURE\n000500 9(2) USAGE COMP-4. *> note\n000600 05 B PIC s9(3)v9(1) USAGE IS packed-decimal. 05 C PIC 9.\n"
    )
    assert [(f.path, f.offset, f.byte_length) for f in layout.fields] == [("REC.PIC", 0, 7), ("REC.A", 7, 2), ("REC.B", 9, 3), ("REC.C", 12, 1)]


def test_storage_sizes():
    layout = compile_copybook(copybook("A PIC 9 COMP.", "B PIC 9(4) BINARY.", "C PIC 9(5) COMP-4.", "D PIC 9(9) COMP.", "E PIC 9(10) COMP.", "F PIC 9(18) COMP."))
    assert [(f.offset, f.byte_length) for f in layout.fields] == [(0, 2), (2, 2), (4, 4), (8, 4), (12, 8), (20, 8)]
    packed = compile_copybook(copybook(*(f"P{n} PIC 9({n}) COMP-3." for n in (1, 2, 3, 4, 18))))
    assert [f.byte_length for f in packed.fields] == [1, 2, 2, 3, 10]
    assert {f.logical.name for f in packed.fields} == {"decimal128"}


def test_hierarchy():
    layout = compile_copybook(
        "000100 01 ROOT.\n000200 05 OUTER.\n000300 10 FIRST PIC X(2).\n000400 10 INNER.\n000500 15 SECOND PIC X(4).\n000600 05 SIBLING.\n000700 07 THIRD PIC X.\n"
        "000800 05 TWIN.\n000900 10 INNER.\n001000 15 SECOND PIC X.\n"
    )
    assert [(f.path, f.offset) for f in layout.fields] == [("ROOT.OUTER.FIRST", 0), ("ROOT.OUTER.INNER.SECOND", 2), ("ROOT.SIBLING.THIRD", 6), ("ROOT.TWIN.INNER.SECOND", 7)]
    with pytest.raises(ValueError, match="collide"):
        layout.leaf_names()


def test_parser_never_breaks():
    rng = random.Random(7)
    words = ["01", "05", "88", "PIC", "X(3)", "9(4)V9(2)", ".", "COMP-3", "USAGE", "IS", "A-B", "-", "FILLER", "\n000100 ", "*>", "99"]
    for _ in range(3000):
        text = "000100 " + " ".join(rng.choice(words) for _ in range(rng.randrange(14)))
        if rng.random() < 0.3:
            text = "".join(rng.choice(string.printable) for _ in range(rng.randrange(60)))
        try:
            compile_copybook(parse_copybook(text))
        except CopybookError as e:
            assert e.span.line >= 1 and e.span.column >= 1


def test_fingerprint():
    a = compile_copybook(COPYBOOK)
    assert layout_fingerprint(a) == layout_fingerprint(compile_copybook(COPYBOOK.replace("names are", "names may be")))
    changed = compile_copybook(COPYBOOK.replace("FILLER            PIC X(2)", "FILLER            PIC 9(2)"))
    assert a.schema().fieldNames() == changed.schema().fieldNames() and layout_fingerprint(a) != layout_fingerprint(changed)
    one, two = with_metadata(a, {"x": "á", "a": "1"}), with_metadata(a, {"a": "1", "x": "á"})
    assert layout_fingerprint(one) == layout_fingerprint(two) != layout_fingerprint(a)
    assert layout_fingerprint(with_metadata(a, {"k": "v"}, a.columns[0].name)) != layout_fingerprint(a)


def test_layouts_made_by_hand_are_validated():
    from dataclasses import replace

    good = validate_layout(compile_copybook(COPYBOOK))
    first = good.fields[0]
    for changes in (
        {"name": "sample"}, {"name": "FILLER"}, {"record_length": 0}, {"record_length": 36}, {"fields": ()}, {"columns": good.columns[1:]},
        {"columns": (*good.columns, Column("X", first.logical))}, {"columns": (replace(good.columns[0], nullable=True), *good.columns[1:])},
        *({"fields": (replace(first, **c), *good.fields[1:])} for c in (
            {"offset": 1}, {"byte_length": 0}, {"path": None}, {"path": "OTHER.CUSTOMER-NAME"}, {"source_name": "customer"}, {"signed": True}, {"precision": 1}, {"encoding": "packed_decimal"})),
    ):
        with pytest.raises(DecodeError, match="invalid compiled layout"):
            validate_layout(replace(good, **changes))
