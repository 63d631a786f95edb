"""Registered queries of the record engine: tables are encoded as fixed records, decoded again and compared with SQL."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillrec.functions.codecs import encode_record
from quillrec.operators import compare
from quillrec.operators.decode import ERROR_COLUMN, decode, decode_error, error_of, first_error
from quillrec.plans.layout import Layout, compile_copybook
from quillrec.sources import parts
from quillrec.sources.convert import convert_dataset
from quillrec.sources.fixed import read_decoded, read_records, write_records
from quillrec.sources.storage import working_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def layout_of(**fields: str) -> Layout:
    """A one-group layout from names and PICTURE clauses; ``_`` in a name stands for ``-``, filler1, filler2 ... for FILLER."""
    lines = ["       01  REC."]
    for name, pic in fields.items():
        shown = "FILLER" if name.lower().startswith("filler") else name.upper().replace("_", "-")
        lines.append(f"           05  {shown} PIC {pic}.")
    return compile_copybook("\n".join(lines) + "\n")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the test data, spread over all cores where its files have fewer splits than that."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


def encoded(df: DataFrame, layout: Layout, keep: tuple[str, ...] = (), **values: Column) -> DataFrame:
    paths = {f"{layout.name}.{k.upper().replace('_', '-')}": v for k, v in values.items()}
    return df.select(*keep, encode_record(layout, paths).alias("record"))


def round_trip(df: DataFrame, layout: Layout, keep: tuple[str, ...] = (), **values: Column) -> DataFrame:
    """Encodes and decodes; columns get the names of ``values``."""
    out = decode(encoded(df, layout, keep, **values), layout, keep=keep)
    return out.toDF(*keep, *values)


def money(name: str, precision: int = 9) -> Column:
    return F.col(name).cast(f"decimal({precision},2)")


# ---------------------------------------------------------------- codecs


@query("SELECT c_custkey, rpad(c_name, 18, ' ') AS name FROM customer")
def text_cp037_customer(spark, sf_dir):
    layout = layout_of(name="X(18)")
    return round_trip(table(spark, sf_dir, "customer"), layout, ("c_custkey",), name=F.col("c_name"))


@query(
    "SELECT doc_id, i, rpad(substr(text, CAST(i AS INT) * 200 + 1, 200), 200, ' ') AS part FROM (SELECT doc_id, text,"
    " unnest(generate_series(0, CAST((length(text) - 1) // 200 AS BIGINT))) AS i FROM documents WHERE length(text) > 0)"
)
def text_cp037_documents(spark, sf_dir):
    """Whole texts, as records of 200 characters."""
    docs = table(spark, sf_dir, "documents").where(F.length("text") > 0)
    last = ((F.length("text") - 1) / 200).cast("long")
    pieces = docs.select("doc_id", "text", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("i"))
    part = F.substring("text", (F.col("i") * 200 + 1).cast("int"), F.lit(200))
    return round_trip(pieces, layout_of(part="X(200)"), ("doc_id", "i"), part=part)


@query("SELECT CAST(l_orderkey AS BIGINT) AS orderkey, CAST(l_linenumber AS BIGINT) AS linenumber FROM lineitem")
def display_int_lineitem(spark, sf_dir):
    layout = layout_of(orderkey="9(9)", linenumber="9(1)")
    return round_trip(table(spark, sf_dir, "lineitem"), layout, orderkey=F.col("l_orderkey"), linenumber=F.col("l_linenumber"))


@query("SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(9,2)) AS price FROM orders")
def display_decimal_orders(spark, sf_dir):
    return round_trip(table(spark, sf_dir, "orders"), layout_of(price="9(7)V9(2)"), ("o_orderkey",), price=money("o_totalprice"))


@query(
    "SELECT CAST(c_nationkey - 12 AS BIGINT) AS small, CAST(-c_custkey AS BIGINT) AS middle,"
    " CAST((c_custkey - 700) * 1000000007 AS BIGINT) AS large FROM customer"
)
def binary_signed_customer(spark, sf_dir):
    layout = layout_of(small="S9(4) COMP", middle="S9(9) COMP-4", large="S9(18) BINARY")
    key = F.col("c_custkey")
    return round_trip(table(spark, sf_dir, "customer"), layout, small=F.col("c_nationkey") - 12, middle=-key, large=(key - 700) * 1000000007)


@query("SELECT c_custkey, CAST(c_acctbal AS DECIMAL(9,2)) AS balance FROM customer")
def binary_decimal_customer(spark, sf_dir):
    return round_trip(table(spark, sf_dir, "customer"), layout_of(balance="S9(7)V9(2) BINARY"), ("c_custkey",), balance=money("c_acctbal"))


@query("SELECT c_custkey, CAST(c_acctbal AS DECIMAL(9,2)) AS balance FROM customer")
def packed_signed_customer(spark, sf_dir):
    return round_trip(table(spark, sf_dir, "customer"), layout_of(balance="S9(7)V9(2) COMP-3"), ("c_custkey",), balance=money("c_acctbal"))


@query("SELECT c_custkey, CAST(c_acctbal AS DECIMAL(8,2)) AS balance FROM customer")
def packed_even_precision(spark, sf_dir):
    return round_trip(table(spark, sf_dir, "customer"), layout_of(balance="S9(6)V9(2) COMP-3"), ("c_custkey",), balance=money("c_acctbal", 8))


@query("SELECT CAST(l_orderkey AS DECIMAL(9,0)) AS orderkey FROM lineitem")
def packed_unsigned_lineitem(spark, sf_dir):
    return round_trip(table(spark, sf_dir, "lineitem"), layout_of(orderkey="9(9) COMP-3"), orderkey=F.col("l_orderkey"))


@query("SELECT CAST(abs(l_discount) AS DECIMAL(5,2)) AS discount, count(*) AS n FROM lineitem GROUP BY 1")
def packed_negative_zero(spark, sf_dir):
    """Zeros get a minus sign in their bytes."""
    digits = F.lpad((F.abs(F.col("l_discount")) * 100).cast("decimal(5,0)").cast("string"), 5, "0")
    record = F.unhex(F.concat(digits, F.when(digits == "00000", "D").otherwise("C")))
    layout = layout_of(discount="S9(3)V9(2) COMP-3")
    out = decode(table(spark, sf_dir, "lineitem").select(record.alias("record")), layout).toDF("discount")
    return out.groupBy("discount").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 4 = 3 THEN -o_custkey ELSE o_custkey END AS DECIMAL(9,0)) AS custkey FROM orders")
def packed_alt_signs(spark, sf_dir):
    """The signs A, E and F for plus, B for minus."""
    turn = F.col("o_orderkey") % 4
    sign = F.when(turn == 0, "A").when(turn == 1, "E").when(turn == 2, "F").otherwise("B")
    record = F.unhex(F.concat(F.lpad(F.col("o_custkey").cast("string"), 9, "0"), sign))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", record.alias("record"))
    return decode(rows, layout_of(custkey="S9(9) COMP-3"), keep=("o_orderkey",)).toDF("o_orderkey", "custkey")


# ---------------------------------------------------------------- records


@query("SELECT CAST(s_suppkey AS BIGINT) AS suppkey, rpad(s_name, 18, ' ') AS name FROM supplier")
def filler_skipped(spark, sf_dir):
    layout = layout_of(filler1="X(3)", suppkey="9(9) COMP", filler2="9(4) COMP-3", name="X(18)", filler3="X")
    return round_trip(table(spark, sf_dir, "supplier"), layout, suppkey=F.col("s_suppkey"), name=F.col("s_name"))


LINEITEM = {
    "orderkey": "9(9) COMP", "partkey": "9(9) COMP-3", "suppkey": "9(9)", "linenumber": "9(1)", "quantity": "S9(5)V9(2) COMP-3",
    "extendedprice": "9(7)V9(2)", "discount": "S9(3)V9(2) COMP-3", "tax": "S9(3)V9(2) BINARY", "returnflag": "X", "linestatus": "X", "filler1": "X(2)", "shipdate": "X(10)",
}
_LINEITEM_SQL = (
    "CAST(l_orderkey AS BIGINT) AS orderkey, CAST(l_partkey AS DECIMAL(9,0)) AS partkey, CAST(l_suppkey AS BIGINT) AS suppkey, CAST(l_linenumber AS BIGINT) AS linenumber,"
    " CAST(l_quantity AS DECIMAL(7,2)) AS quantity, CAST(l_extendedprice AS DECIMAL(9,2)) AS extendedprice, CAST(abs(l_discount) AS DECIMAL(5,2)) AS discount,"
    " CAST(l_tax AS DECIMAL(5,2)) AS tax, l_returnflag AS returnflag, l_linestatus AS linestatus, strftime(l_shipdate, '%Y-%m-%d') AS shipdate"
)


def lineitem_values() -> dict[str, Column]:
    return {
        "orderkey": F.col("l_orderkey"), "partkey": F.col("l_partkey"), "suppkey": F.col("l_suppkey"), "linenumber": F.col("l_linenumber"),
        "quantity": money("l_quantity", 7), "extendedprice": money("l_extendedprice"), "discount": F.abs(money("l_discount", 5)),
        "tax": money("l_tax", 5), "returnflag": F.col("l_returnflag"), "linestatus": F.col("l_linestatus"), "shipdate": F.date_format("l_shipdate", "yyyy-MM-dd"),
    }


def lineitem_file(spark: SparkSession, sf_dir: str, tasks: int | None = None) -> tuple[str, Layout]:
    """``lineitem`` as a folder of record files, or as one file."""
    layout = layout_of(**LINEITEM)
    records = encoded(table(spark, sf_dir, "lineitem"), layout, **lineitem_values())
    folder = working_folder(spark, "lineitem")
    write_records(records if tasks is None else records.coalesce(tasks), folder)
    return (folder if tasks is None else os.path.join(folder, os.listdir(folder)[0])), layout


@query(f"SELECT {_LINEITEM_SQL} FROM lineitem")
def mixed_record_lineitem(spark, sf_dir):
    """All encodings in one record, by way of files and the data source; decoded by Column expressions."""
    path, layout = lineitem_file(spark, sf_dir)
    return decode(read_records(spark, path, layout), layout).toDF(*lineitem_values())


@query(f"SELECT {_LINEITEM_SQL} FROM lineitem")
def scan_decoded_lineitem(spark, sf_dir):
    """The same, decoded in the scan."""
    path, layout = lineitem_file(spark, sf_dir)
    return read_decoded(spark, path, layout).drop("record_index").toDF(*lineitem_values())


@query('SELECT CAST(c_custkey AS BIGINT) AS "CUST_KEY", rpad(c_mktsegment, 10, \' \') AS "SEGMENT", CAST(c_acctbal AS DECIMAL(9,2)) AS "BALANCE" FROM customer')
def group_paths_customer(spark, sf_dir):
    layout = compile_copybook(
        "000100 01  CUSTOMER.\n000200     05  IDENT.\n000300         10  CUST-KEY PIC 9(9) COMP.\n000400     05  DETAIL.\n"
        "000500         10  SEGMENT PIC X(10).\n      *  money\n000600         10  AMOUNTS.\n000700             15  BALANCE PIC S9(7)V9(2) COMP-3.\n"
    )
    values = {"CUSTOMER.IDENT.CUST-KEY": F.col("c_custkey"), "CUSTOMER.DETAIL.SEGMENT": F.col("c_mktsegment"), "CUSTOMER.DETAIL.AMOUNTS.BALANCE": money("c_acctbal")}
    rows = table(spark, sf_dir, "customer").select(encode_record(layout, values).alias("record"))
    return decode(rows, layout, naming="leaf")


# ---------------------------------------------------------------- errors


def _marked(df: DataFrame, layout: Layout, record: Column, key: str) -> DataFrame:
    """key, and kind and byte of each record's first error."""
    rows = df.select(F.col(key).alias("key"), record.alias("record"))
    out = decode(rows, layout, errors="column", keep=("key",))
    return out.select("key", F.col(ERROR_COLUMN)["kind"].alias("kind"), F.col(ERROR_COLUMN)["byte"].cast("long").alias("byte"))


def _patched(record: Column, at: int, value: str, where: Column) -> Column:
    """``record`` with one byte (zero-based) replaced by a hex value where a condition holds."""
    h = F.hex(record)
    return F.unhex(F.when(where, F.concat(F.substring(h, 1, 2 * at), F.lit(value), F.substring(h, 2 * at + 3, 1 << 30))).otherwise(h))


@query("SELECT o_orderkey AS key, CASE WHEN o_orderkey % 7 = 0 THEN 'InvalidDisplayDigit' END AS kind, CASE WHEN o_orderkey % 7 = 0 THEN CAST(3 AS BIGINT) END AS byte FROM orders")
def invalid_display_rows(spark, sf_dir):
    layout = layout_of(price="9(7)V9(2)")
    record = encode_record(layout, {"REC.PRICE": money("o_totalprice")})
    return _marked(table(spark, sf_dir, "orders"), layout, _patched(record, 3, "40", F.col("o_orderkey") % 7 == 0), "o_orderkey")


@query("SELECT o_orderkey AS key, CASE WHEN o_orderkey % 5 = 1 THEN 'InvalidPackedDigit' END AS kind, CASE WHEN o_orderkey % 5 = 1 THEN CAST(2 AS BIGINT) END AS byte FROM orders")
def invalid_packed_digit(spark, sf_dir):
    layout = layout_of(price="S9(7)V9(2) COMP-3")
    record = encode_record(layout, {"REC.PRICE": money("o_totalprice")})
    return _marked(table(spark, sf_dir, "orders"), layout, _patched(record, 2, "1B", F.col("o_orderkey") % 5 == 1), "o_orderkey")


@query("SELECT o_orderkey AS key, CASE WHEN o_orderkey % 5 = 2 THEN 'InvalidPackedSign' END AS kind, CASE WHEN o_orderkey % 5 = 2 THEN CAST(4 AS BIGINT) END AS byte FROM orders")
def invalid_packed_sign(spark, sf_dir):
    """C is no sign of an unsigned item."""
    record = F.unhex(F.concat(F.lpad(F.col("o_custkey").cast("string"), 9, "0"), F.when(F.col("o_orderkey") % 5 == 2, "C").otherwise("F")))
    return _marked(table(spark, sf_dir, "orders"), layout_of(custkey="9(9) COMP-3"), record, "o_orderkey")


@query("SELECT o_orderkey AS key, CASE WHEN o_orderkey % 3 = 0 THEN 'InvalidPackedPadding' END AS kind, CASE WHEN o_orderkey % 3 = 0 THEN CAST(0 AS BIGINT) END AS byte FROM orders")
def invalid_packed_padding(spark, sf_dir):
    """The digit before an even number of digits must be 0, and counts before a bad sign."""
    bad = F.col("o_orderkey") % 3 == 0
    record = F.unhex(F.concat(F.when(bad, "7").otherwise("0"), F.lpad(F.col("o_custkey").cast("string"), 8, "0"), F.when(bad, "0").otherwise("D")))
    return _marked(table(spark, sf_dir, "orders"), layout_of(custkey="S9(8) COMP-3"), record, "o_orderkey")


@query(
    "SELECT l_orderkey AS key, CASE WHEN v > 9999999999 THEN 'NumericOutOfRange' END AS kind, CASE WHEN v > 9999999999 THEN CAST(0 AS BIGINT) END AS byte,"
    " CASE WHEN v > 9999999999 THEN CAST(v AS DECIMAL(20,0)) END AS value FROM (SELECT l_orderkey, l_orderkey * 1000003 AS v FROM lineitem)"
)
def binary_out_of_range(spark, sf_dir):
    """Eight bytes hold more than ten digits."""
    value = F.col("l_orderkey") * 1000003
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key"), F.unhex(F.lpad(F.hex(value), 16, "0")).alias("record"))
    out = decode(rows, layout_of(orderkey="9(10) COMP"), errors="column", keep=("key",))
    e = F.col(ERROR_COLUMN)
    return out.select("key", e["kind"].alias("kind"), e["byte"].cast("long").alias("byte"), e["value"].alias("value"))


@query(
    "SELECT min(o_orderkey) AS record_index, (min(o_orderkey) % 64) * 14 + 12 AS byte, 'record ' || min(o_orderkey) || ', field REC.PRICE, batch byte ' || ((min(o_orderkey) % 64) * 14 + 12)"
    " || ' (line 3, column 12): invalid packed digit 0xF at nibble 7' AS text FROM orders WHERE o_orderkey % 1000 = 999"
)
def first_error_context(spark, sf_dir):
    """The first bad record of all, with its place in its batch of 64."""
    layout = layout_of(orderkey="9(9)", price="S9(7)V9(2) COMP-3")
    record = encode_record(layout, {"REC.ORDERKEY": F.col("o_orderkey"), "REC.PRICE": money("o_totalprice")})
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("record_index"), _patched(record, 12, "1F", F.col("o_orderkey") % 1000 == 999).alias("record"))
    index, row = first_error(rows, layout)
    error = decode_error(row, layout, index, 64)
    return spark.createDataFrame([(index, error.context["byte_offset"], str(error))], "record_index long, byte long, text string")


# ---------------------------------------------------------------- conversion


@query(
    "SELECT i AS part_index, i * 4096 AS start_record, least(4096, n - i * 4096) AS record_count FROM (SELECT count(*) AS n FROM lineitem),"
    " LATERAL (SELECT unnest(generate_series(0, greatest(1, (n + 4095) // 4096) - 1)) AS i)"
)
def part_plan(spark, sf_dir):
    n = table(spark, sf_dir, "lineitem").count()
    job = parts.Manifest.plan(n * 10, "0" * 64, "0" * 64, 10, 4096)
    i, total = F.col("id"), F.lit(job.total_records)
    return spark.range(job.part_count).select(i.alias("part_index"), (i * 4096).alias("start_record"), F.least(F.lit(4096).cast("long"), total - i * 4096).alias("record_count"))


@query(f"SELECT {_LINEITEM_SQL} FROM lineitem")
def parts_concat_equals_whole(spark, sf_dir):
    """A recoverable conversion, then a resume that finds it complete."""
    path, layout = lineitem_file(spark, sf_dir, tasks=1)
    out = working_folder(spark, "job")
    parts.convert_parts(spark, layout, path, out, 8192)
    parts.convert_parts(spark, layout, path, out, 8192, resume=True)
    return spark.read.parquet(os.path.join(out, "parts")).toDF(*lineitem_values())


@query(
    "SELECT CAST(least(10000, n - i * 10000) AS BIGINT) AS row_count, count(*) AS n FROM (SELECT count(*) AS n FROM lineitem),"
    " LATERAL (SELECT unnest(generate_series(0, (n + 9999) // 10000 - 1)) AS i) GROUP BY 1"
)
def row_group_layout(spark, sf_dir):
    """Row groups of a converted dataset: one for each batch of 10,000."""
    import pyarrow.parquet as pq

    path, layout = lineitem_file(spark, sf_dir, tasks=1)
    out = working_folder(spark, "dataset")
    convert_dataset(spark, layout, path, out, 10_000)
    counts = [pq.ParquetFile(os.path.join(out, f)).metadata for f in os.listdir(out) if f.endswith(".parquet")]
    rows = [(m.row_group(g).num_rows,) for m in counts for g in range(m.num_row_groups)]
    return spark.createDataFrame(rows, "row_count long").groupBy("row_count").agg(F.count("*").alias("n"))


@query(f"SELECT {_LINEITEM_SQL} FROM lineitem WHERE false")
def empty_input(spark, sf_dir):
    layout = layout_of(**LINEITEM)
    path = working_folder(spark, "empty.bin")
    open(path, "wb").close()
    out = working_folder(spark, "dataset")
    convert_dataset(spark, layout, path, out)
    return spark.read.parquet(out).toDF(*lineitem_values())


# ---------------------------------------------------------------- comparison


def _two_sides(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """``orders`` decoded from packed and from zoned records; prices of some keys differ on the right."""
    orders = table(spark, sf_dir, "orders")
    left = round_trip(orders, layout_of(orderkey="9(9) COMP-3", price="S9(7)V9(2) COMP-3"), orderkey=F.col("o_orderkey"), price=money("o_totalprice"))
    other = F.when(F.col("o_orderkey") % 11 == 0, money("o_totalprice") + 1).otherwise(money("o_totalprice")).cast("decimal(9,2)")
    right = round_trip(orders, layout_of(orderkey="9(9)", price="9(7)V9(2)"), orderkey=F.col("o_orderkey"), price=other)
    return left, right


@query("SELECT count(*) AS n, true AS same FROM customer")
def differential_match(spark, sf_dir):
    customer = table(spark, sf_dir, "customer")
    a, b = (round_trip(customer, layout_of(balance=p), ("c_custkey",), balance=money("c_acctbal")) for p in ("S9(7)V9(2) COMP-3", "S9(7)V9(2) COMP"))
    found = compare.compare(a, b, ["c_custkey"])
    return spark.createDataFrame([(found.compared, found.equal)], "n long, same boolean")


@query(
    "SELECT CAST(o_orderkey AS DECIMAL(9,0)) AS ORDERKEY, 'PRICE' AS \"column\", CAST(CAST(o_totalprice AS DECIMAL(9,2)) AS VARCHAR) AS \"left\","
    " CAST(CAST(o_totalprice AS DECIMAL(9,2)) + 1 AS VARCHAR) AS \"right\" FROM orders WHERE o_orderkey % 11 = 0"
)
def differential_mismatches(spark, sf_dir):
    left, right = (compare.normalized(x)[0] for x in _two_sides(spark, sf_dir))
    out = compare.differing_values(left, right, ["ORDERKEY"], ["PRICE"])
    return out.withColumn("ORDERKEY", F.col("ORDERKEY").cast("decimal(9,0)"))


@query("SELECT o_orderkey AS orderkey FROM orders WHERE o_orderkey % 13 = 0")
def differential_missing_keys(spark, sf_dir):
    left = round_trip(table(spark, sf_dir, "orders"), layout_of(orderkey="9(9)"), orderkey=F.col("o_orderkey"))
    return compare.missing_keys(left, left.where("orderkey % 13 <> 0"), ["orderkey"])


@query("SELECT l_orderkey AS orderkey, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 1")
def differential_duplicate_keys(spark, sf_dir):
    left = round_trip(table(spark, sf_dir, "lineitem"), layout_of(orderkey="9(9) COMP"), orderkey=F.col("l_orderkey"))
    return compare.duplicate_keys(left, ["orderkey"]).withColumnRenamed("count", "n")


# ---------------------------------------------------------------- queries over decoded records


def decoded_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "lineitem"), layout_of(**LINEITEM), **lineitem_values())


@query(
    "SELECT l_returnflag AS returnflag, l_linestatus AS linestatus, CAST(sum(CAST(l_quantity AS DECIMAL(7,2))) AS DECIMAL(17,2)) AS sum_qty,"
    " CAST(sum(CAST(l_extendedprice AS DECIMAL(9,2))) AS DECIMAL(19,2)) AS sum_price,"
    " CAST(sum(CAST(l_extendedprice AS DECIMAL(9,2)) * (1 - CAST(abs(l_discount) AS DECIMAL(5,2)))) AS DECIMAL(30,4)) AS sum_disc_price, count(*) AS n"
    " FROM lineitem WHERE strftime(l_shipdate, '%Y-%m-%d') <= '1998-09-02' GROUP BY 1, 2"
)
def q1_pricing_summary(spark, sf_dir):
    rows = decoded_lineitem(spark, sf_dir).where("shipdate <= '1998-09-02'")
    return rows.groupBy("returnflag", "linestatus").agg(
        F.sum("quantity").cast("decimal(17,2)").alias("sum_qty"),
        F.sum("extendedprice").cast("decimal(19,2)").alias("sum_price"),
        F.sum(F.col("extendedprice") * (1 - F.col("discount"))).cast("decimal(30,4)").alias("sum_disc_price"),
        F.count("*").alias("n"),
    )


@query(
    "SELECT CAST(sum(CAST(l_extendedprice AS DECIMAL(9,2)) * CAST(abs(l_discount) AS DECIMAL(5,2))) AS DECIMAL(30,4)) AS revenue FROM lineitem"
    " WHERE CAST(abs(l_discount) AS DECIMAL(5,2)) BETWEEN 0.05 AND 0.07 AND l_quantity < 24"
)
def q6_revenue(spark, sf_dir):
    rows = decoded_lineitem(spark, sf_dir).where("discount between 0.05 and 0.07 and quantity < 24")
    return rows.agg(F.sum(F.col("extendedprice") * F.col("discount")).cast("decimal(30,4)").alias("revenue"))


@query(
    "SELECT suppkey, month, price, CAST(rank() OVER (PARTITION BY month ORDER BY price DESC) AS BIGINT) AS rank FROM (SELECT CAST(l_suppkey AS BIGINT) AS suppkey,"
    " strftime(l_shipdate, '%Y-%m') AS month, CAST(sum(CAST(l_extendedprice AS DECIMAL(9,2))) AS DECIMAL(19,2)) AS price FROM lineitem GROUP BY 1, 2)"
)
def shipping_window_rank(spark, sf_dir):
    rows = decoded_lineitem(spark, sf_dir).groupBy("suppkey", F.substring("shipdate", 1, 7).alias("month")).agg(F.sum("extendedprice").cast("decimal(19,2)").alias("price"))
    return rows.withColumn("rank", F.rank().over(Window.partitionBy("month").orderBy(F.desc("price"))).cast("long"))


@query(
    "SELECT c_mktsegment AS segment, n_name AS nation, CAST(sum(CAST(c_acctbal AS DECIMAL(9,2))) AS DECIMAL(19,2)) AS balance, count(*) AS n"
    " FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ROLLUP (c_mktsegment, n_name)"
)
def segment_rollup(spark, sf_dir):
    layout = layout_of(nationkey="9(4) COMP", segment="X(10)", balance="S9(7)V9(2) COMP-3")
    rows = round_trip(table(spark, sf_dir, "customer"), layout, nationkey=F.col("c_nationkey"), segment=F.col("c_mktsegment"), balance=money("c_acctbal"))
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("nationkey"), F.col("n_name").alias("nation"))
    rows = rows.join(nation, "nationkey").withColumn("segment", F.rtrim("segment"))
    return rows.rollup("segment", "nation").agg(F.sum("balance").cast("decimal(19,2)").alias("balance"), F.count("*").alias("n"))


@query("SELECT CAST(o_orderkey AS BIGINT) AS orderkey, CAST(NULL AS VARCHAR) AS kind FROM orders")
def strict_scan_is_clean(spark, sf_dir):
    """No record of a clean table has an error."""
    layout = layout_of(orderkey="9(9)", price="S9(7)V9(2) COMP-3")
    rows = encoded(table(spark, sf_dir, "orders"), layout, ("o_orderkey",), orderkey=F.col("o_orderkey"), price=money("o_totalprice"))
    return rows.select(F.col("o_orderkey").cast("long").alias("orderkey"), error_of(F.col("record"), layout)["kind"].alias("kind"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of records, scanned, decoded and summed up."""
    rows = mixed_record_lineitem(spark, sf_dir)
    return rows.groupBy("returnflag", "linestatus").agg(F.sum("quantity").alias("sum_qty"), F.sum("extendedprice").alias("sum_price"), F.count("*").alias("n"))
