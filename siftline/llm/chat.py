"""Chat formatting after a cumulative-snapshot collapse.  DataFrame functions only.

Logs often hold a conversation many times, each snapshot a few turns longer.  Every turn gets a
rolling hash of its conversation up to there (two 64-bit xors of hashes that include the turn's
place, so order counts).  A conversation whose whole hash is a proper prefix of another is removed
by an anti-join; of equal ones the smallest conv_id stays, with the number of copies.  The text
takes part in one shuffle alone, by conv_id, which serves the join with the conversations kept and
their rendering; hashes of common first turns are made distinct before they are joined.

Results in odd cases: null roles and texts count as empty; turns are ordered by turn (nulls first),
equal turns by the hash of role and text; a row without conv_id is a conversation of its own, so
that any number of them is spread over tasks, and equal ones are copies; an empty table gives no
rows; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import OWN, checkpointed

TIE, K, N, A, B = f"{OWN}tie", f"{OWN}k", f"{OWN}n", f"{OWN}a", f"{OWN}b"


def rendered_turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit("<|"), role, F.lit("|>\n"), text, F.lit("<|end|>\n"))


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """For turns (conv_id, turn, role, text): conv_id, place of the turn, turns in all, and the two prefix hashes."""
    slim = turns.select("conv_id", "turn", F.xxhash64("role", "text").alias(TIE), F.xxhash64(F.lit(7), "text", "role").alias(B))
    each = Window.partitionBy("conv_id")
    ordered = each.orderBy("turn", TIE)
    placed = slim.withColumns({K: F.row_number().over(ordered), N: F.count(F.lit(1)).over(each)})
    so_far = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return placed.select("conv_id", K, N, F.bit_xor(F.xxhash64(K, TIE)).over(so_far).alias(A), F.bit_xor(F.xxhash64(B, K)).over(so_far).alias(B))


def lone_turns(turns: DataFrame) -> DataFrame:
    """For turns without conv_id: the hashes, copies and text of each distinct one, combined before the shuffle."""
    one = F.lit(1)
    hashed = turns.select(F.xxhash64(one, F.xxhash64("role", "text")).alias(A), F.xxhash64(F.xxhash64(F.lit(7), "text", "role"), one).alias(B), "role", "text")
    alike = hashed.groupBy(A, B).agg(F.count(one).alias("copies"), F.first("role").alias("role"), F.first("text").alias("text"))
    return alike.select(A, B, F.lit(1).cast("long").alias(N), F.lit(None).cast(turns.schema["conv_id"].dataType).alias("conv_id"), "copies", rendered_turn(F.col("role"), F.col("text")).alias("text"))


def maximal_conversations(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns and copies of the conversations that are no proper prefix of another; text of those without an id."""
    hashes = checkpointed(prefix_hashes(turns.where("conv_id is not null")))
    whole = hashes.where(F.col(K) == F.col(N)).groupBy(A, B, N).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("copies"))
    every = whole.withColumn("text", F.lit(None).cast("string")).unionByName(lone_turns(turns.where("conv_id is null")))
    whole = every.groupBy(A, B, N).agg(F.min("conv_id").alias("conv_id"), F.sum("copies").alias("copies"), F.max("text").alias("text"))
    proper = hashes.where(F.col(K) < F.col(N)).select(A, B, F.col(K).cast("long").alias(N)).distinct()
    return whole.join(proper, [A, B, N], "left_anti").select("conv_id", F.col(N).alias("n_turns"), "copies", "text")


def format_chats(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns, copies, n_chars and text (rendered) of each maximal conversation."""
    empty = F.lit("")
    turns = conversations.select("conv_id", "turn", F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text"))
    kept = checkpointed(maximal_conversations(turns))
    named = kept.where("conv_id is not null").select("conv_id", "n_turns", "copies")
    members = turns.join(named, "conv_id")
    turn = F.struct("turn", F.xxhash64("role", "text").alias(TIE), rendered_turn(F.col("role"), F.col("text")).alias("shown"))
    whole = members.groupBy("conv_id").agg(F.first("n_turns").alias("n_turns"), F.first("copies").alias("copies"), F.sort_array(F.collect_list(turn)).alias("turns"))
    shown = whole.select("conv_id", "n_turns", "copies", F.array_join("turns.shown", "").alias("text"))
    shown = shown.unionByName(kept.where("conv_id is null").select("conv_id", "n_turns", "copies", "text"))
    return shown.select("conv_id", "n_turns", "copies", F.length("text").cast("long").alias("n_chars"), "text")


ORACLE = """
WITH c AS (SELECT *, CASE WHEN conv_id IS NULL THEN row_number() OVER () ELSE 0 END AS lone FROM conversations),
t AS (
  SELECT conv_id, lone, row_number() OVER (PARTITION BY conv_id, lone ORDER BY turn NULLS FIRST) AS k, count(*) OVER (PARTITION BY conv_id, lone) AS n,
         '<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10) AS s
  FROM c),
p AS (SELECT conv_id, k, n, string_agg(s, '') OVER (PARTITION BY conv_id, lone ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS r FROM t),
u AS (SELECT r, n, min(conv_id) AS conv_id, count(*) AS copies FROM p WHERE k = n GROUP BY r, n)
SELECT conv_id, n AS n_turns, copies, CAST(length(r) AS BIGINT) AS n_chars, r AS text
FROM u WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.r = u.r AND p.k = u.n AND p.k < p.n)
"""
