"""Duplicate marks and filling of nulls."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .labels import running_number


def mark_duplicates(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The first column gets an exclamation mark wherever the columns together occur more than once.

    Counts are combined before the shuffle and only repeated keys are joined back, so one key with
    most of the rows is spread by the skew join; a window would hold it in one task.
    """
    keys = {c: f"__key{k}" for k, c in enumerate(columns)}
    counts = df.groupBy(*[F.col(f"`{c}`").alias(k) for c, k in keys.items()]).agg(F.count(F.lit(1)).alias("__n"))
    repeated = counts.where("__n > 1")
    same = reduce(lambda a, b: a & b, [F.col(f"`{c}`").eqNullSafe(F.col(k)) for c, k in keys.items()])
    joined = df.join(repeated, same, "left")
    first = columns[0]
    shown = F.when(F.col("__n").isNotNull(), F.concat(F.lit("!"), F.col(f"`{first}`").cast("string"))).otherwise(F.col(f"`{first}`").cast("string"))
    return joined.select(*[shown.alias(c) if c == first else F.col(f"`{c}`") for c in df.columns])


def fill_value(df: DataFrame, columns: Sequence[str], value: object) -> DataFrame:
    """Nulls become a constant of the column's type."""
    kinds = dict(df.dtypes)
    filled = {c: F.coalesce(F.col(f"`{c}`"), F.lit(value).cast(kinds[c])) for c in columns}
    return df.withColumns(filled)


def fill_across(df: DataFrame, columns: Sequence[str], backward: bool = False) -> DataFrame:
    """Nulls take the nearest value from the columns before (or after) in their row."""
    ordered = list(columns)[::-1] if backward else list(columns)
    return df.withColumns({c: F.coalesce(*[F.col(f"`{x}`") for x in ordered[: k + 1][::-1]]) for k, c in enumerate(ordered)})


def fill_along(df: DataFrame, columns: Sequence[str], order_by: Sequence[str], partition_by: Sequence[str] = (), backward: bool = False, limit: int | None = None, block_rows: int = 1_000_000) -> DataFrame:
    """Nulls take the nearest value from the rows before (or after); limit: at most so many rows in a run.

    Without partition_by the table has one order; its rows are numbered in it and filled in blocks of
    block_rows, which hand their last values on, so that no task has the whole table.
    """
    if not partition_by:
        return _filled_in_blocks(df, columns, order_by, backward, limit, block_rows)
    order = [F.col(c).desc() if backward else F.col(c) for c in order_by]
    window = Window.partitionBy(*partition_by).orderBy(*order)
    before = window.rowsBetween(Window.unboundedPreceding, 0)
    out = df
    for c in columns:
        cell = F.col(f"`{c}`")
        value = F.last(cell, ignorenulls=True).over(before)
        if limit is not None:
            out = out.withColumn("__place", F.row_number().over(window))
            near = F.col("__place") - F.max(F.when(cell.isNotNull(), F.col("__place"))).over(before)
            out = out.withColumn(c, F.when(near <= limit, value)).drop("__place")
        else:
            out = out.withColumn(c, value)
    return out.select(*df.columns)


def _filled_in_blocks(df: DataFrame, columns: Sequence[str], order_by: Sequence[str], backward: bool, limit: int | None, block_rows: int) -> DataFrame:
    sign = -1 if backward else 1
    numbered = running_number(df, order_by, "__number").withColumn("__block", F.expr(f"__number div {block_rows}"))
    inside = Window.partitionBy("__block").orderBy(F.col("__number") * sign).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.orderBy(F.col("__block") * sign).rowsBetween(Window.unboundedPreceding, -1)  # a row a block
    known = {c: F.when(F.col(f"`{c}`").isNotNull(), F.struct(F.col(f"`{c}`").alias("v"), F.col("__number").alias("at"))) for c in columns}
    last = numbered.groupBy("__block").agg(*[F.max_by(known[c], F.when(F.col(f"`{c}`").isNotNull(), F.col("__number") * sign)).alias(f"__l{k}") for k, c in enumerate(columns)])
    carried = last.select("__block", *[F.last(f"__l{k}", ignorenulls=True).over(earlier).alias(f"__c{k}") for k in range(len(columns))])
    out = numbered.withColumns({f"__l{k}": F.last(known[c], ignorenulls=True).over(inside) for k, c in enumerate(columns)}).join(carried, "__block")
    near = {c: F.coalesce(f"__l{k}", f"__c{k}") for k, c in enumerate(columns)}
    close = lambda c: F.lit(True) if limit is None else F.abs(F.col("__number") - near[c]["at"]) <= limit
    return out.withColumns({c: F.when(close(c), near[c]["v"]) for c in columns}).select(*df.columns)
