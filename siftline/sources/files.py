"""Reading and writing tables."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.cluster import checkpointed


#: Fixed value: rows of an Excel sheet without the header.
EXCEL_ROWS = 1_048_575


def null_nan(df: DataFrame, empty_text: bool = False) -> DataFrame:
    """NaN (and empty text, if asked for) become null."""
    out = {}
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            out[f.name] = F.when(~F.isnan(c), c)
        elif empty_text and isinstance(f.dataType, T.StringType):
            out[f.name] = F.when(c != "", c)
    return df.withColumns(out) if out else df


def load(spark: SparkSession, source, *, sql: str | None = None, jdbc: Mapping[str, str] | None = None, encoding: str = "UTF-8", sep: str | None = None, **options) -> DataFrame:
    """A table from a DataFrame (Spark's or pandas'), a path by its extension, or a database query.

    csv and txt are read as text columns with a header; quoted fields may hold line breaks, so a file
    is one task unless multiLine=False says that there are none; json keeps its types, and is one
    task a file unless multiLine=False says that each line is a record; parquet and
    orc are read as they are; xls and xlsx need pandas with an Excel engine and fit the driver.  With
    partitionColumn, bounds and numPartitions among jdbc's options, a query is read in that many tasks.
    """
    if jdbc is not None:
        reader = spark.read.format("jdbc").options(**jdbc)
        # a query cannot be read in partitions, a table of its result can
        return (reader.option("dbtable", f"({sql or source}) AS q") if "partitionColumn" in jdbc else reader.option("query", sql or source)).load()
    if isinstance(source, DataFrame) or hasattr(source, "sparkSession"):
        return source
    if not isinstance(source, str):
        return null_nan(spark.createDataFrame(source))
    kind = os.path.splitext(source.rstrip("/"))[1].lower()
    if kind in (".csv", ".txt"):
        reader = spark.read.options(header=True, inferSchema=False, encoding=encoding, sep=sep or ("\t" if kind == ".txt" else ","), multiLine=True, quote='"', escape='"')
        return reader.options(**options).csv(source)
    if kind == ".json":
        return spark.read.options(**({"multiLine": True} | options)).json(source)
    if kind in (".parquet", ".orc"):
        return spark.read.format(kind[1:]).options(**options).load(source)
    if kind in (".xls", ".xlsx"):
        import pandas as pd

        table = pd.read_excel(source, dtype=str, **options)
        return spark.createDataFrame(table.astype(object).where(table.notna(), None), schema=T.StructType([T.StructField(str(c), T.StringType()) for c in table.columns]))
    raise ValueError(f"no reader for {source!r}")


def save(df: DataFrame, path: str, *, jdbc: Mapping[str, str] | None = None, table: str | None = None, mode: str = "errorifexists") -> None:
    """Write by extension (csv, json, parquet, orc, or xlsx for tables that fit the driver), or to a database table."""
    if jdbc is not None:
        df.write.format("jdbc").options(**jdbc).option("dbtable", table).mode(mode).save()
        return
    kind = os.path.splitext(path.rstrip("/"))[1].lower()
    if kind == ".csv":
        df.write.mode(mode).options(header=True, quote='"', escape='"').csv(path)
    elif kind in (".json", ".parquet", ".orc"):
        df.write.mode(mode).format(kind[1:]).save(path)
    elif kind == ".xlsx":
        if df.count() > EXCEL_ROWS:
            raise ValueError(f"a sheet has at most {EXCEL_ROWS} rows")
        df.toPandas().to_excel(path, index=False)
    else:
        raise ValueError(f"no writer for {path!r}")


def export_csv(df: DataFrame, path: str) -> None:
    """One CSV file on the driver with a byte order mark, row by row."""
    import csv

    with open(path, "w", encoding="utf-8-sig", newline="") as out:
        writer = csv.writer(out)
        writer.writerow(df.columns)
        writer.writerows(df.toLocalIterator())


def write_routed(routed: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """JSON lines in a folder for each status."""
    routed.write.mode(mode).partitionBy("status").json(path)


def export_routed(routed: DataFrame, path: str) -> dict[str, int]:
    """Three JSON files on the driver (path_ready.json and so on), written row by row; counts by status.

    The records are checked once, and written for the three from there.
    """
    counts, routed = {}, checkpointed(routed)
    for status in ("ready", "needcheck", "unvalid"):
        rows = routed.where(F.col("status") == status).drop("status")
        n = 0
        with open(f"{path}_{status}.json", "w", encoding="utf-8") as out:
            out.write("[")
            for line in rows.select(F.to_json(F.struct("*")).alias("j")).toLocalIterator():
                out.write(",\n" * bool(n) + json.dumps(json.loads(line["j"]), ensure_ascii=False))
                n += 1
            out.write("]")
        counts[status] = n
    return counts
