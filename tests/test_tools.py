"""Command line, reports, comparison."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillrec import cli
from quillrec.errors import DecodeError
from quillrec.functions import vectors
from quillrec.operators.compare import compare, compare_by_position, compare_in_order, same_rows, schema_problems
from quillrec.plans.layout import compile_copybook, from_json, to_json
from quillrec.sources.fixed import read_decoded, record_files
from tests.fixtures import COPYBOOK, RECORDS


@pytest.fixture
def files(tmp_path):
    (tmp_path / "c.cpy").write_text(COPYBOOK)
    (tmp_path / "in.bin").write_bytes(RECORDS)
    return tmp_path


def run(spark, capsys, *argv):
    status = cli.main([str(a) for a in argv], spark=lambda: spark)
    out, err = capsys.readouterr()
    return status, out, err


def convert_args(files, out="o.parquet", batch=2, command="convert", flag="--output"):
    return (command, "--copybook", files / "c.cpy", "--input", files / "in.bin", flag, files / out, "--batch-records", batch)


def test_convert(spark, capsys, files):
    assert run(spark, capsys, *convert_args(files)) == (0, "", "")
    status, out, err = run(spark, capsys, *convert_args(files), "--report-json")
    report = json.loads(out)
    assert status == 1 and err.startswith("quillrec: create output") and out.endswith("}\n")
    assert (report["status"], report["error_category"], report["input_bytes"], report["output_bytes"], report["dataset_records"]) == ("error", "conversion", 105, None, None)
    status, out, _ = run(spark, capsys, "convert", "--report-json", *convert_args(files, "p.parquet")[1:])
    report = json.loads(out)
    assert list(report) == ["report_version", "command", "mode", "status", "elapsed_ms", "error_category", "input_bytes", "output_bytes", "dataset_records",
                            "dataset_parts", "batch_records", "record_length", "publication", "warnings"]
    assert report["output_bytes"] == (files / "p.parquet").stat().st_size and report["dataset_records"] == 3 and report["dataset_parts"] is None
    assert str(files) not in out


def test_parts(spark, capsys, files):
    args = convert_args(files, "job", command="convert-parts", flag="--output-dir")
    report = json.loads(run(spark, capsys, *args, "--report-json")[1])
    assert (report["mode"], report["dataset_parts"], report["output_bytes"], report["status"]) == ("create", 2, None, "success")
    report = json.loads(run(spark, capsys, *args, "--resume", "--report-json")[1])
    assert report["mode"] == "resume" and report["status"] == "success"
    assert json.loads(run(spark, capsys, *args, "--report-json")[1])["error_category"] == "recovery"


def test_arguments(spark, capsys, files):
    good = convert_args(files)
    for bad in ((), ("other",), good[:-1], good[:-2], (*good, "--resume"), (*good, "--input", "x"), (*good[:-1], "0"), (*good[:-1], "x"), ("convert-parts", "--resume", "--resume")):
        status, out, err = run(spark, capsys, *bad)
        assert status == 1 and out == "" and err.startswith("quillrec: ")
    status, out, err = run(spark, capsys, *good, "--report-json", "--report-json")
    assert json.loads(out)["error_category"] == "arguments" and "duplicate argument" in err
    # where a value should stand it is a value
    status, out, err = run(spark, capsys, "convert", "--input", "--report-json", *good[1:3], *good[5:])
    assert out == "" and "--report-json" in err
    (files / "c.cpy").write_text("000100 01 A.\n")
    report = json.loads(run(spark, capsys, *good, "--report-json")[1])
    assert (report["error_category"], report["record_length"]) == ("copybook", None)
    (files / "c.cpy").unlink()
    assert json.loads(run(spark, capsys, *good, "--report-json")[1])["error_category"] == "input_io"


def test_protection(spark, capsys, files):
    assert run(spark, capsys, "keygen", "--output-dir", files)[0] == 0
    for command, key, a, b in (("protect", "public", "in.bin", "sealed"), ("unprotect", "secret", "sealed", "out.bin")):
        status, out, err = run(spark, capsys, command, "--input", files / a, f"--{key}-key", files / f"{key}.key", "--output", files / b, "--report-json")
        report = json.loads(out)
        assert status == 0 and report["publication"] == {"output": "published"} and report["output_bytes"] == (files / b).stat().st_size
    assert (files / "out.bin").read_bytes() == RECORDS
    assert run(spark, capsys, "unprotect", "--input", files / "in.bin", "--secret-key", files / "secret.key", "--output", files / "x")[0] == 1


def orders(spark, rows, names=("A.ORDER-ID", "A.AMOUNT"), kinds=("decimal(9,0)", "decimal(9,2)")):
    df = spark.createDataFrame(rows, "k string, v string") if rows else spark.createDataFrame([], "k string, v string")
    return df.select(*(F.col(c).cast(t).alias(n) for c, t, n in zip("kv", kinds, names, strict=True)))


ROWS = [("1", "1.50"), ("2", "-2.25"), ("3", "0.00")]


def test_comparison(spark):
    base = orders(spark, ROWS)
    assert compare(base, orders(spark, ROWS[::-1]), ["A.ORDER-ID"]).equal
    assert compare(base, orders(spark, ROWS, ("order_id", "amount"), ("bigint", "decimal(12,4)")), ["ORDER_ID"]).equal
    found = compare(base, orders(spark, [*ROWS[:2], ("3", "0.01")]), ["A.ORDER-ID"])
    assert [r[1:] for r in found.mismatches] == [("AMOUNT", "0.00", "0.01")] and not found.problems and found.compared == 3
    assert "left: 1 duplicate keys" in compare(orders(spark, [*ROWS, ROWS[0]]), base, ["A.ORDER-ID"]).problems
    assert "right: 1 keys are missing" in compare(base, orders(spark, ROWS[:2]), ["A.ORDER-ID"]).problems
    assert "row counts differ: 3 and 2" in compare(base, orders(spark, ROWS[:2]), ["A.ORDER-ID"]).problems
    clash = base.select("*", F.lit(1).alias("B.AMOUNT"))
    assert "collide" in compare(clash, base, ["A.ORDER-ID"]).problems[0]
    wrong = compare(base, base, ["A.ORDER-ID"], expected={"AMOUNT": T.DecimalType(9, 3)})
    assert len(wrong.problems) == 2 and not wrong.equal
    assert "columns on one side only: AMOUNT, OTHER" in compare(base, orders(spark, ROWS, ("A.ORDER-ID", "OTHER")), ["A.ORDER-ID"]).problems
    many = [(str(i), "1.00") for i in range(30)]
    assert len(compare(orders(spark, many), orders(spark, [(k, "2.00") for k, _ in many]), ["A.ORDER-ID"]).mismatches) == 10
    assert compare(orders(spark, []), orders(spark, []), ["A.ORDER-ID"]).equal
    assert schema_problems(base, {"nope": T.LongType()}, "left") == ["left: column nope is missing"]


def test_positions_and_rows(spark):
    a = spark.range(5).select(F.col("id").alias("record_index"), (F.col("id") * 2).alias("v"))
    b = a.withColumn("v", F.when(F.col("record_index") == 3, 0).otherwise(F.col("v")))
    assert compare_by_position(a, a.orderBy(F.desc("record_index"))).equal
    assert compare_by_position(a, b).mismatches == [(3, "V", "6", "0")]
    assert same_rows(a, a) and not same_rows(a, b) and not same_rows(a, a.union(a))


def test_contract(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_null_keys_are_compared_and_counted(spark):
    left = spark.createDataFrame([(1, "a"), (None, "b"), (2, "c"), (2, "d")], "K long, V string")
    right = spark.createDataFrame([(1, "a"), (None, "x"), (2, "c")], "K long, V string")
    got = compare(left, right, ["K"])
    assert got.compared == 2 and [m[1:] for m in got.mismatches] == [("V", "b", "x")]
    twice = spark.createDataFrame([(None, "b"), (None, "y")], "K long, V string")
    assert compare(twice, right, ["K"]).compared == 0


def test_layouts_travel_as_json():
    layout = compile_copybook(COPYBOOK)
    assert from_json(to_json(layout)) == layout


def test_order_decides_how_rows_are_compared(spark):
    side = lambda rows: spark.createDataFrame(rows, "record_index long, k long, v long")
    left = side([(0, 1, 10), (1, 1, 20), (2, None, 30)])  # keys may repeat and be null where positions decide
    got = compare_in_order(left, side([(2, None, 31), (0, 1, 10), (1, 1, 20)]), ["k"])
    assert got.by == "position" and got.compared == 3 and got.mismatches == [(2, "V", "30", "31")]
    a = side([(0, 1, 10), (1, 2, 20)])
    got = compare_in_order(a, side([(0, 2, 20), (1, 1, 11)]), ["k"])
    assert got.by == "key" and got.mismatches == [(1, "V", "10", "11")]
    assert "row counts differ: 2 and 1" in compare_in_order(a, side([(0, 1, 10)]), ["k"]).problems
    assert compare_in_order(side([]), side([]), ["k"]).equal


def test_widths_and_capacity():
    layout = compile_copybook(COPYBOOK)
    text = np.full((3, 10), 0x40, dtype=np.uint8)
    for run, kind in (
        (lambda: vectors.checked_width(text, layout.fields[1]), "InvalidFieldLength"),
        (lambda: vectors.text_array(text, most=29), "CapacityExceeded"),
        (lambda: vectors.decode_records(RECORDS[:-1], layout), "InvalidBatchLength"),
    ):
        with pytest.raises(DecodeError) as e:
            run()
        assert e.value.kind == kind
    assert vectors.text_array(text, most=30).to_pylist() == [" " * 10] * 3


def test_files_by_uri(spark, tmp_path):
    layout, folder = compile_copybook(COPYBOOK), tmp_path / "in"
    folder.mkdir()
    for name, n in (("b", 2), ("a", 1), (".hidden", 5), ("c", 0)):
        (folder / name).write_bytes(RECORDS * n)
    for path in (str(folder), f"file://{folder}"):
        assert sorted(r[0] for r in read_decoded(spark, path, layout, partitionBytes=70).select("record_index").collect()) == list(range(9))
    assert record_files(f"file://{folder}") == [(str(folder / n), 105 * k) for n, k in (("a", 1), ("b", 2), ("c", 0))]
    with pytest.raises(FileNotFoundError):
        record_files(str(tmp_path / "none"))
