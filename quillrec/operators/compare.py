"""Differential comparison of two datasets of decoded records."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillrec.plans.layout import leaf_name


@dataclass
class Comparison:
    """What differs: ``problems`` are texts, ``mismatches`` rows of (key, column, left, right), at most the limit."""

    rows: tuple[int, int] = (0, 0)
    by: str = "key"  # or "position"
    compared: int = 0
    problems: list[str] = field(default_factory=list)
    mismatches: list[tuple] = field(default_factory=list)

    @property
    def equal(self) -> bool:
        return not self.problems and not self.mismatches


def normalized(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """Plain column names (see ``leaf_name``), and the names that more than one column would get."""
    names = [leaf_name(n) for n in df.columns]
    return df.toDF(*names) if len(set(names)) == len(names) else df, sorted({n for n in names if names.count(n) > 1})


def schema_problems(df: DataFrame, expected: Mapping[str, T.DataType], side: str) -> list[str]:
    """Columns that are missing, or have another type than expected."""
    have = {f.name: f.dataType for f in df.schema}
    out = [f"{side}: column {n} is missing" for n in expected if n not in have]
    return out + [f"{side}: column {n} is {have[n].simpleString()}, expected {t.simpleString()}" for n, t in expected.items() if n in have and have[n] != t]


def _comparable(df: DataFrame, name: str, other: DataFrame) -> Column:
    """Numbers by value, whatever their width and scale; all else as it is."""
    kinds = [d.schema[name].dataType for d in (df, other)]
    if all(isinstance(k, (T.DecimalType, T.IntegralType)) for k in kinds):
        scale = max(k.scale if isinstance(k, T.DecimalType) else 0 for k in kinds)
        return F.col(f"`{name}`").cast(T.DecimalType(38, scale))
    return F.col(f"`{name}`")


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*(f"`{k}`" for k in keys)).count().where("count > 1")


def missing_keys(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys of ``left`` that ``right`` does not have; null keys are equal to each other."""
    same = reduce(lambda a, b: a & b, (left[f"`{k}`"].eqNullSafe(right[f"`{k}`"]) for k in keys))
    return left.join(right, same, "left_anti").select(*(f"`{k}`" for k in keys))


def differing_values(left: DataFrame, right: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """One row for each differing cell of rows with equal keys: the keys, column, left, right (as text)."""
    marked = lambda df, other, p: df.select(*(F.col(f"`{k}`").alias(f"{p}k{i}") for i, k in enumerate(keys)), *(_comparable(df, c, other).alias(f"{p}{i}") for i, c in enumerate(columns)))
    a, b = marked(left, right, "a"), marked(right, left, "b")
    same = reduce(lambda x, y: x & y, (F.col(f"ak{i}").eqNullSafe(F.col(f"bk{i}")) for i in range(len(keys))))
    cells = [
        F.when(~F.col(f"a{i}").eqNullSafe(F.col(f"b{i}")), F.struct(F.lit(c).alias("column"), F.col(f"a{i}").cast("string").alias("left"), F.col(f"b{i}").cast("string").alias("right")))
        for i, c in enumerate(columns)
    ]
    joined = a.join(b, same)
    found = F.filter(F.array(*cells).cast("array<struct<column:string,left:string,right:string>>"), lambda x: x.isNotNull())
    out = joined.select(*(F.col(f"ak{i}").alias(k) for i, k in enumerate(keys)), F.explode(found).alias("cell"))
    return out.select(*(f"`{k}`" for k in keys), "cell.column", "cell.left", "cell.right")


def _keyed(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, Column]:
    """The keys of ``df`` under names of their own, and the condition that a row has them; null keys are equal to each other."""
    other = df.select(*(F.col(f"`{k}`").alias(f"__key{i}") for i, k in enumerate(keys)))
    return other, reduce(lambda a, b: a & b, (F.col(f"`{k}`").eqNullSafe(F.col(f"__key{i}")) for i, k in enumerate(keys)))


def compare(left: DataFrame, right: DataFrame, keys: Sequence[str], expected: Mapping[str, T.DataType] | None = None, limit: int = 10) -> Comparison:
    """Compares two datasets by key: names, types, counts, repeated and missing keys, values.

    All comparisons are joins and aggregations over whole tables; only counts and at most ``limit`` examples reach the driver. Rows
    whose key is repeated on a side are reported and left out of the comparison of values.
    """
    out = Comparison()
    (left, clash_a), (right, clash_b) = normalized(left), normalized(right)
    for side, clash in (("left", clash_a), ("right", clash_b)):
        if clash:
            out.problems.append(f"{side}: column names collide after normalization: {', '.join(clash)}")
    if out.problems:
        return out
    keys = [leaf_name(k) for k in keys]
    if only := sorted(set(left.columns) ^ set(right.columns)):
        out.problems.append(f"columns on one side only: {', '.join(only)}")
    for side, df in (("left", left), ("right", right)):
        out.problems += schema_problems(df, expected or {}, side)
    shared = [c for c in left.columns if c in right.columns]
    if not set(keys) <= set(shared):
        out.problems.append("a key column is missing")
        return out
    out.rows = (left.count(), right.count())
    if out.rows[0] != out.rows[1]:
        out.problems.append(f"row counts differ: {out.rows[0]} and {out.rows[1]}")
    unique = []
    for side, df in (("left", left), ("right", right)):
        twice = duplicate_keys(df, keys)
        n = twice.count()
        if n:
            out.problems.append(f"{side}: {n} duplicate keys")
            df = df.join(*_keyed(twice, keys), "left_anti")
        unique.append(df)
    for side, a, b in (("right", left, right), ("left", right, left)):
        if n := missing_keys(a.select(*keys).distinct(), b.select(*keys).distinct(), keys).count():
            out.problems.append(f"{side}: {n} keys are missing")
    cells = differing_values(*unique, keys, [c for c in shared if c not in keys])
    out.mismatches = [tuple(r) for r in cells.orderBy(*keys, "column").limit(limit).collect()]
    out.compared = unique[0].select(*keys).join(*_keyed(unique[1], keys)).count()
    return out


def compare_in_order(left: DataFrame, right: DataFrame, keys: Sequence[str], index: str = "record_index", limit: int = 10) -> Comparison:
    """Compares by position where both sides have the same keys at the same positions, and by key where they do not.

    ``index`` is the position on both sides. By position, rows may repeat a key; by key, positions are not compared. The choice takes
    one join on the position.
    """
    (left, clash_a), (right, clash_b) = normalized(left), normalized(right)
    at, names = leaf_name(index), [leaf_name(k) for k in keys]
    if not clash_a and not clash_b and {at, *names} <= set(left.columns) & set(right.columns):
        side = lambda df, p: df.select(F.col(f"`{at}`").alias(f"{p}at"), *(F.col(f"`{k}`").alias(f"{p}{i}") for i, k in enumerate(names)))
        same = reduce(lambda a, b: a & b, (F.col(f"a{i}").eqNullSafe(F.col(f"b{i}")) for i in range(len(names))))
        paired = side(left, "a").join(side(right, "b"), F.col("aat") == F.col("bat"), "full_outer")
        if paired.where(F.col("aat").isNull() | F.col("bat").isNull() | ~same).isEmpty():
            out = compare(left, right, [at], limit=limit)
            out.by = "position"
            return out
        left, right = left.drop(at), right.drop(at)
    return compare(left, right, keys, limit=limit)


def compare_by_position(left: DataFrame, right: DataFrame, index: str = "record_index", limit: int = 10) -> Comparison:
    """The same with the position of a record as its key."""
    return compare(left, right, [index], limit=limit)


def same_rows(left: DataFrame, right: DataFrame) -> bool:
    """Whether two datasets have the same rows, repeats counted, in any order."""
    names = left.columns
    return sorted(names) == sorted(right.columns) and left.exceptAll(right.select(*names)).isEmpty() and right.select(*names).exceptAll(left).isEmpty()
