"""Sharding by a two-pass external shuffle.

Pass one scatters the records into memory-sized buckets by a seeded hash; pass two loads one
bucket at a time, shuffles it by Fisher-Yates and writes it.  A bucket's offset travels with it as a
row of its own, so the records are shuffled once and joined with nothing.  Bucket b holds the places
[offset(b), offset(b) + size(b)) of one global permutation, and shard i the places from
floor(i * n / shards), so that the shards' row counts differ by one at most (law "rows").

Rows equal in id and text have one hash.  Where more than ``hot_rows`` share it, their hashes are
salted by the row's number in the input, so that no bucket grows with them; the salted table is
written first, so that both passes see the same salts.

Results in odd cases: a null text or id is a record like any other; equal rows are all kept (their
order among themselves cannot be told apart); an empty table gives no rows; with fewer rows than
shards, some shards are empty; input columns called shard, slot or position are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import OWN, checkpointed, running_offsets, scratch, without

BUCKET, TIE, OFFSET, PART = f"{OWN}bucket", f"{OWN}tie", f"{OWN}offset", f"{OWN}part"


def fisher_yates(n: int, seed: tuple[int, ...]) -> np.ndarray:
    """A uniform permutation of range(n) that the seed decides."""
    rng = np.random.Generator(np.random.PCG64(list(seed)))
    order = list(range(n))
    for i, j in zip(range(n - 1, 0, -1), rng.integers(0, np.arange(n, 1, -1)).tolist() if n > 1 else []):
        order[i], order[j] = order[j], order[i]
    return np.array(order, dtype=np.int64)


def _permute_buckets(seed: int, bucket_at: int, offset_at: int, keep: list[int]):
    def emit(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held)
        bucket, offset = rows.column(bucket_at)[0].as_py(), rows.column(offset_at)[0].as_py()
        rows = rows.slice(1)  # the first row told the offset
        places = fisher_yates(rows.num_rows, (seed, bucket)) + offset
        out = rows.select(keep).append_column("position", pa.array(places)).take(pa.array(np.argsort(places)))
        yield from out.combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        current = None
        for batch in batches:
            buckets = batch.column(bucket_at).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(np.diff(buckets)) + 1).tolist(), len(buckets)]
            for lo, hi in zip(cuts, cuts[1:]):
                if lo == hi:
                    continue
                if held and buckets[lo] != current:
                    yield from emit(held)
                    held = []
                current = buckets[lo]
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield from emit(held)

    return run


def _salted(keyed: DataFrame, seed: int, hot_rows: int) -> DataFrame:
    """keyed, where hashes that more than hot_rows rows share are replaced by hashes of the rows' numbers too."""
    spark, tie, number = keyed.sparkSession, f"{OWN}hot", f"{OWN}number"
    hot = checkpointed(keyed.groupBy(F.col(TIE).alias(tie)).agg(F.count(F.lit(1)).alias(f"{OWN}n")).where(F.col(f"{OWN}n") > hot_rows).select(tie))
    n = hot.count()
    if not n:
        return keyed
    numbered = keyed.withColumn(number, F.monotonically_increasing_id())
    joined = numbered.join(F.broadcast(hot) if n < 1_000_000 else hot, F.col(TIE) == F.col(tie), "left")
    salted = F.when(F.col(tie).isNotNull(), F.xxhash64(F.lit(seed), F.col(TIE), F.col(number))).otherwise(F.col(TIE))
    path, columns = scratch(spark, "salted"), [*[F.col(f"`{c}`") for c in keyed.columns if c != TIE], salted.alias(TIE)]
    joined.select(*columns).write.parquet(path)
    return spark.read.schema(joined.select(*columns).schema).parquet(path).select(*keyed.columns)


def shard_documents(docs: DataFrame, shards: int = 40, seed: int = 20261, id_col: str = "doc_id", text_col: str = "text",
                    bucket_bytes: int = 16 << 20, least_buckets: int = 1024, task_bytes: int = 128 << 20, hot_rows: int = 2000) -> DataFrame:
    """All rows and columns of docs, with position (long, in the global shuffle), shard and slot."""
    docs = without(docs, ("position", "shard", "slot"))
    size = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long") + 16
    total = docs.agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("bytes")).first()
    n, all_bytes = total["n"], total["bytes"] or 0
    buckets = max(least_buckets, -(-all_bytes // bucket_bytes))
    keyed = docs.withColumn(TIE, F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)))
    keyed = _salted(keyed, seed, hot_rows)
    keyed = keyed.withColumn(BUCKET, F.pmod(F.col(TIE), F.lit(buckets)).cast("long"))
    counts = checkpointed(keyed.groupBy(BUCKET).agg(F.count(F.lit(1)).alias(f"{OWN}n")))
    heads = running_offsets(counts, BUCKET, f"{OWN}n", OFFSET)
    keyed = keyed.withColumn(OFFSET, F.lit(None).cast("long")).unionByName(heads, allowMissingColumns=True)
    spark = docs.sparkSession
    parts = min(buckets, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-all_bytes // task_bytes)))
    keyed = keyed.select(*docs.columns, TIE, BUCKET, OFFSET)
    scattered = keyed.repartitionById(parts, F.expr(f"cast({BUCKET} * {parts} div {buckets} as int)"))
    scattered = scattered.sortWithinPartitions(BUCKET, F.col(OFFSET).asc_nulls_last(), TIE, id_col)
    schema = T.StructType([*docs.schema.fields, T.StructField("position", T.LongType())])
    width = len(docs.columns)
    placed = scattered.mapInArrow(_permute_buckets(seed, width + 1, width + 2, list(range(width))), schema)
    last = f"(((position + 1) * {shards} - 1) div {max(n, 1)})"
    return placed.withColumns({
        "shard": F.expr(f"cast({last} as int)"),
        "slot": F.expr(f"position - ({last} * {n}) div {shards}"),
    })


def write_shards(sharded: DataFrame, path: str) -> None:
    """Parquet below path, a folder for each shard."""
    sharded.write.partitionBy("shard").parquet(path)
