"""Labels: row copies, running codes, templates and pages."""

from __future__ import annotations

import html
import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .cluster import checkpointed


def copies(df: DataFrame, repeat: int = 0, column: str = "duplicatesOfLabel") -> DataFrame:
    """Each row repeat times; with 0, as often as its column says (1 where that is no number, none for 0). Adds copy, from 1."""
    n = F.lit(repeat) if repeat > 0 else F.coalesce(F.col(column).cast("string").try_cast("double").cast("int"), F.lit(1))
    numbered = df.withColumn("__n", n).where("__n > 0")
    return numbered.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("__n")))).drop("__n")


def code_parts(start: str) -> tuple[str, int, int]:
    """Prefix, number and width of a code; the number is its last run of digits, the rest in front is the prefix."""
    digits = re.findall(r"\d+", start)
    if not digits:
        raise ValueError(f"no number in {start!r}")
    at = start.rindex(digits[-1])
    return start[:at] + start[at + len(digits[-1]) :], int(digits[-1]), len(digits[-1])


def running_number(df: DataFrame, order_by: Sequence[str], name: str = "number", rows_a_task: int = 1_000_000) -> DataFrame:
    """Numbers from 0 in the order of columns, without bringing all rows to one task.

    Rows are range-partitioned, about rows_a_task each, and numbered inside partitions; the
    partitions' sizes, one row each, give the offsets.
    """
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // rows_a_task))
    ordered = df.repartitionByRange(parts, *[F.col(c) for c in order_by]).sortWithinPartitions(*order_by)
    placed = checkpointed(ordered.withColumn("__part", F.spark_partition_id()))  # else partitions could be cut anew
    local = placed.withColumn("__at", F.row_number().over(Window.partitionBy("__part").orderBy(*order_by)) - 1)
    sizes = local.groupBy("__part").agg((F.max("__at") + 1).cast("long").alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    return local.join(offsets, "__part").withColumn(name, F.col("__at") + F.col("__offset")).drop("__part", "__at", "__offset")


def running_codes(df: DataFrame, start: str, order_by: Sequence[str], column: str = "catalogNumber") -> DataFrame:
    """The column overwritten by codes that count up from start; zeros pad to its width, longer numbers stay whole."""
    prefix, first, width = code_parts(start)
    numbered = running_number(df, order_by, "__number")
    digits = (F.col("__number") + first).cast("string")
    code = F.concat(F.lit(prefix), F.repeat(F.lit("0"), F.greatest(F.lit(0), width - F.length(digits))), digits)
    return numbered.withColumn(column, code).drop("__number")


def renumbered(df: DataFrame, start: str, order_by: Sequence[str], repeat: int = 0) -> DataFrame:
    """The table behind a run of labels: a row for each copy, with its own code, and df's columns in their order."""
    coded = running_codes(copies(df, repeat), start, [*order_by, "copy"])
    return coded.select(*df.columns, *(["catalogNumber"] if "catalogNumber" not in df.columns else []))


def texts(df: DataFrame) -> DataFrame:
    """All columns as text, nulls empty."""
    return df.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in df.columns])


_TAG = re.compile(r"\{\{\{\s*(\w+)\s*\}\}\}|\{\{([#^/&]?)\s*(\w+)\s*\}\}")


def render(template: str, values: dict[str, str]) -> str:
    """A template with variables, sections ({{#x}} shown if x is not empty), inverted ones ({{^x}}) and raw {{{x}}}."""
    out, shown = [], [True]
    at = 0
    for m in _TAG.finditer(template):
        if shown[-1]:
            out.append(template[at : m.start()])
        at = m.end()
        kind, name = (m[2], m[3]) if m[3] else ("&", m[1])
        value = values.get(name) or ""
        if kind in "#^" and kind:
            shown.append(shown[-1] and bool(value) == (kind == "#"))
        elif kind == "/":
            if len(shown) == 1:
                raise ValueError(f"section {name} is not open")
            shown.pop()
        elif shown[-1]:
            out.append(value if kind == "&" else html.escape(value))
    return "".join([*out, template[at:]])


def rendered(df: DataFrame, template: str, name: str = "label") -> DataFrame:
    """df with each row rendered by the template."""
    used = [c for c in df.columns if re.search(r"\{\W*" + re.escape(c) + r"\s*\}", template)]

    @F.pandas_udf("string")
    def show(rows: pd.DataFrame) -> pd.Series:
        return pd.Series([render(template, r) for r in rows.to_dict("records")], dtype="object")

    shown = texts(df.select(*used)) if used else None
    cells: list[Column] = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in (shown.columns if shown is not None else [])]
    return df.withColumn(name, show(F.struct(*cells)) if cells else F.lit(render(template, {})))


def pages(labels: DataFrame, order_by: Sequence[str], columns: int = 2, rows: int = 3, page_height: float = 297.0, label: str = "label") -> DataFrame:
    """page (from 0), html and label_height of pages of columns x rows labels, in order."""
    per_page, height = columns * rows, (page_height - (rows - 1) * 0.5) / rows
    numbered = running_number(labels, order_by, "__number").withColumn("page", F.expr(f"__number div {per_page}"))
    cell = F.struct(F.col("__number").alias("n"), F.concat(F.lit(f'<div class="label" style="height:{height:.4f}mm">'), F.col(label), F.lit("</div>")).alias("h"))
    sheet = numbered.groupBy("page").agg(F.sort_array(F.collect_list(cell)).alias("cells"))
    body = F.concat(F.lit('<section class="page">'), F.array_join(F.transform("cells", lambda c: c["h"]), ""), F.lit("</section>"))
    return sheet.select("page", body.alias("html"), F.lit(height).alias("label_height"))


def style_sheet(label_height: float, columns: int = 2, rows: int = 3) -> str:
    """A style sheet for pages of columns x rows labels, one printed sheet a page."""
    return (
        f".page {{ display: grid; grid-template-columns: repeat({columns}, 1fr); page-break-after: always; }}\n"
        f".label {{ min-height: {label_height:.4f}mm; overflow: hidden; border: 0.25mm dashed #e6e6e6; }}\n"
        f".page .label:nth-child({columns}n) {{ border-right: none; }}\n@page {{ size: auto; margin: 0; }}\n"
    )


def write_document(sheets: DataFrame, path: str, columns: int = 2, rows: int = 3, style: str | None = None) -> int:
    """One HTML file on the driver of all pages in order, written page by page; gives their number."""
    n = 0
    with open(path, "w", encoding="utf-8") as out:
        out.write('<!DOCTYPE html><html><head><meta charset="utf-8">')
        for sheet in sheets.orderBy("page").toLocalIterator():
            if n == 0:
                out.write(f"<style>{style or style_sheet(sheet['label_height'], columns, rows)}</style></head><body>")
            out.write(sheet["html"])
            n += 1
        out.write("</body></html>" if n else "</head><body></body></html>")
    return n
