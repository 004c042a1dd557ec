"""Helpers that the operators of this package share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Prefix of the columns that operators add for their own use.
OWN = "__sl_"
_GIVEN: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it.

    Where spark.checkpoint.dir is unset, a temporary folder is set on one machine (tests); a cluster
    has to name one.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named is None and not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="siftline-"))
    return named or context.getCheckpointDir()


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path for a table or files in the shared folder; remove_scratch() deletes all that were given."""
    _GIVEN.append(f"{shared_dir(spark).rstrip('/')}/siftline-{tag}-{uuid.uuid4().hex}")
    return _GIVEN[-1]


def remove_scratch() -> None:
    """Delete the intermediate tables of this session, once the results that read them are written elsewhere."""
    from pyarrow import fs

    while _GIVEN:
        store, path = filesystem(_GIVEN.pop())
        if store.get_file_info(path).type != fs.FileType.NotFound:
            store.delete_dir(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint, which outlives executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def without(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Drop columns that an operator is about to add, in any letter case."""
    taken = {n.lower() for n in names}
    return df.select(*[df[f"`{c}`"] for c in df.columns if c.lower() not in taken])


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z alone."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def held_out(doc_id: Column) -> Column:
    """Documents that no classifier may learn from: crc32 of the id's text is divisible by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def sample_place(*key: Column) -> Column:
    """A place from 0 to 2**63 - 1 by a hash of a row's key."""
    return F.xxhash64(*key).bitwiseAND(F.lit((1 << 63) - 1))


def last_place(most: float, n: int) -> int:
    """The last place of a sample of about ``most`` of n rows; never below 0, so that no share is rounded to nothing."""
    return max(1, min(1 << 63, (int(most) << 63) // max(1, n))) - 1


def hashed_sample(rows: DataFrame, group: str, key: list[str], most: int, sizes: dict) -> DataFrame:
    """At most ``most`` rows of each group, those of the least hashes of their key; rows of one key count once.

    sizes are the groups' numbers of rows.  A threshold by the size leaves about twice ``most`` rows of
    a group (fewer, if many repeat), and a ranking of these is the hard bound; few rows are shuffled.
    """
    places = [(g, last_place(2 * most, n)) for g, n in sizes.items()]
    kinds = f"{OWN}g {rows.schema[group].dataType.simpleString()}, {OWN}last long"
    limits = rows.sparkSession.createDataFrame(places, kinds)
    near = rows.join(F.broadcast(limits), F.col(group) == F.col(f"{OWN}g")).withColumn(f"{OWN}place", sample_place(*[F.col(k) for k in key]))
    near = near.where(F.col(f"{OWN}place") <= F.col(f"{OWN}last")).dropDuplicates([group, f"{OWN}place"])
    rank = F.row_number().over(Window.partitionBy(group).orderBy(f"{OWN}place"))
    return near.withColumn(f"{OWN}rank", rank).where(F.col(f"{OWN}rank") <= most).select(*rows.columns)


def running_offsets(counts: DataFrame, key: str, n: str, out: str, width: int = 4096) -> DataFrame:
    """For each key (a long from 0), the sum of n over all smaller keys.

    Two levels: sums over blocks of ``width`` keys, then inside each block, so that no task
    holds more than ``width`` keys or one row a block.
    """
    block = f"{OWN}block"
    per = counts.withColumn(block, F.expr(f"{key} div {width}"))
    tops = per.groupBy(block).agg(F.sum(n).alias(f"{OWN}top"))
    before = Window.orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select(block, F.coalesce(F.sum(f"{OWN}top").over(before), F.lit(0)).alias(f"{OWN}top"))
    inside = Window.partitionBy(block).orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    return per.join(tops, block).select(
        key, (F.col(f"{OWN}top") + F.coalesce(F.sum(n).over(inside), F.lit(0))).alias(out)
    )


def filesystem(uri: str):
    """pyarrow's file system for a URI or a plain path, and the path on it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def id_and_text(docs: DataFrame, id_col: str, text_col: str, added: str, carry: bool) -> tuple[DataFrame, str, int, int]:
    """What an operator that adds columns to each row reads and gives.

    With carry, all columns but those that the new ones replace; else doc_id and text alone, of which
    only doc_id is given back.  Also the result's schema, and the places of id and text.
    """
    if not carry:
        slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
        return slim, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, {added}", 0, 1
    kept = without(docs, [x.split()[0] for x in added.split(", ")])
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    return kept, f"{fields}, {added}", kept.columns.index(id_col), kept.columns.index(text_col)


def widened(batch, new: dict, carry: bool):
    """The batch's columns, or its first alone, with new ones."""
    import pyarrow as pa

    n = batch.num_columns if carry else 1
    return pa.RecordBatch.from_arrays([*batch.columns[:n], *new.values()], names=[*batch.schema.names[:n], *new])
