"""Records to rows: projection, strict validation and the first error."""

from __future__ import annotations


from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillrec.errors import DecodeError
from quillrec.functions.codecs import decode_field
from quillrec.plans.layout import PACKED, TEXT, Field, Layout, validate_layout

ERROR_COLUMN, _RAW, _HERE = "_error", "__quillrec_record", "__quillrec_here"


def error_of(record: Column, layout: Layout) -> Column:
    """The first error of a record in field order: struct(field, kind, offset, code, value), or null.

    offset counts bytes from the record's start.
    """
    found = []
    for i, f in enumerate(layout.fields):
        if f.path is None:
            continue
        e = decode_field(record, f).error
        # a digit's nibble stands for its byte; padding and range errors point at the field
        at = (F.floor(e["offset"] / 2) if f.encoding == PACKED else e["offset"]).cast("int")
        at = F.when(e["kind"] == "InvalidPackedSign", e["offset"]).otherwise(at) if f.encoding == PACKED else at
        found.append(
            F.when(
                e.isNotNull(),
                F.struct(F.lit(i).alias("field"), e["kind"].alias("kind"), (at + f.offset).alias("byte"), e["offset"].alias("offset"), e["code"].alias("code"), e["value"].alias("value")),
            )
        )
    none = F.lit(None).cast("struct<field:int,kind:string,byte:int,offset:int,code:int,value:decimal(20,0)>")
    return F.coalesce(*found, none) if found else none


def decode(df: DataFrame, layout: Layout, record: str = "record", errors: str = "raise", keep: tuple[str, ...] = (), naming: str = "path") -> DataFrame:
    """Decodes a column of fixed-length binary records into the layout's columns.

    errors="raise": any invalid field of any record that the query reaches fails it, even where its column is not selected
    or a filter would drop the row; a limit may stop before it.
    errors="column": bad values are null and ``_error`` has the record's first error (struct of field, kind, byte, offset,
    code, value). errors="ignore": bad values are null. ``keep`` names columns of ``df`` to carry along;
    naming="leaf" gives plain upper-case names and refuses clashes. A null record is one of a wrong length.
    """
    validate_layout(layout)
    rec = F.col(record)
    names = layout.leaf_names() if naming == "leaf" else {c.name: c.name for c in layout.columns}
    out = [F.col(f"`{k}`") for k in keep]
    out += [decode_field(rec, f).value.alias(names[f.path]) for f in layout.data_fields]
    if errors == "column":
        out.append(error_of(rec, layout).alias(ERROR_COLUMN))
    if errors != "raise":
        return df.select(*out)
    rows = df.select(*out, rec.alias(_RAW), F.rand(0).alias(_HERE))
    sized = F.coalesce(F.octet_length(_RAW), F.lit(-1)) == layout.record_length
    # A number's value is null just where it is invalid, so the filter looks at the decoded values. The random column keeps
    # filters, this one and the user's, above the projection: pushed below it they would decode a second time.
    bad = reduce(or_, [~sized, *(F.col(f"`{names[f.path]}`").isNull() for f in layout.data_fields if f.encoding != TEXT)])
    text = F.concat(F.lit("invalid record (see first_error): "), F.coalesce(F.left(F.hex(_RAW), F.lit(512)), F.lit("null")))
    return rows.where(F.when(bad, F.raise_error(text).cast("boolean")).otherwise(F.col(_HERE) >= 0)).drop(_RAW, _HERE)


def decode_error(row, layout: Layout, record_index: int, batch_records: int | None = None) -> DecodeError:
    """The typed error for a row of ``first_error``; byte offsets count from the start of the record's batch."""
    f: Field = layout.fields[row["field"]]
    within = record_index if batch_records is None else record_index % batch_records
    context = {"record_index": record_index, "field_path": f.path, "byte_offset": within * layout.record_length + row["byte"], "span": f.span}
    kind, code = row["kind"], row["code"]
    facts = {
        "InvalidDisplayDigit": lambda: {"offset": row["offset"], "byte": code},
        "InvalidPackedDigit": lambda: {"nibble_index": row["offset"], "nibble": code},
        "InvalidPackedSign": lambda: {"offset": row["offset"], "nibble": code, "signed": f.signed},
        "InvalidPackedPadding": lambda: {"nibble": code},
        "NumericOutOfRange": lambda: {"value": int(row["value"]), "precision": f.precision},
    }[kind]()
    return DecodeError(kind, context, **facts)


def first_error(df: DataFrame, layout: Layout, record: str = "record", index: str = "record_index", below: int | None = None):
    """(record index, error row) of the invalid record with the smallest index, or None. One aggregation, no ordering."""
    rows = df if below is None else df.where(F.col(index) < below)
    problem = error_of(F.col(record), layout)
    rows = rows.select(F.col(index).alias("i"), problem.alias("e")).where("e is not null")
    found = rows.agg(F.min("i").alias("i"), F.min_by("e", "i").alias("e")).first()
    return None if found is None or found["i"] is None else (found["i"], found["e"])


def decode_batch(spark, data: bytes, layout: Layout) -> DataFrame:
    """Decodes concatenated records given as bytes; raises the first DecodeError."""
    validate_layout(layout)
    size = layout.record_length
    if len(data) % size:
        raise DecodeError("InvalidBatchLength", actual=len(data), record_length=size)
    rows = [(i, bytearray(data[at : at + size])) for i, at in enumerate(range(0, len(data), size))]
    df = spark.createDataFrame(rows, "record_index long, record binary")
    if bad := first_error(df, layout):
        raise decode_error(bad[1], layout, bad[0])
    ordered = df.orderBy("record_index")
    return decode(ordered, layout, errors="ignore")


