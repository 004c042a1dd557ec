"""Best-fit packing by exact-complement hashing.

Only lengths matter to a packing, and a piece has at most ``capacity`` tokens, so the plan is made
on the histogram of lengths: at most ``capacity`` numbers, however large the corpus.  An index lists,
for each sum, the single lengths, pairs and triples that make it; for each length, longest first, a
combination that exactly fills the gap is consumed as often as the counts allow; what is left goes
best-fit, longest first.  The plan lists patterns with multiplicities.  Pieces are then dealt to the
pattern slots by their rank within their length; ranks come from salted counts, so that one length
with most of the rows is still spread over many tasks.

Results in odd cases: a null or empty text is a piece of the end id alone; repeated rows are packed
each; an empty table gives no rows; extra columns are not read; ids have to be whole numbers (text that
is none is an error).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import OWN, checkpointed
from .tokens import encoded

SALT, RANK, BEFORE = f"{OWN}salt", f"{OWN}rank", f"{OWN}before"
#: Ranks within a length stay below 2 ** RANK_BITS.
RANK_BITS = 50


class SumIndex:
    """For each sum up to the capacity, the combinations of one, two or three lengths that make it, that of the largest length first.

    Pairs are listed by their sum; triples as their largest length with a sum that pairs make.
    Lengths only run out, so the start of a list whose lengths are gone is passed for good.
    """

    def __init__(self, counts: np.ndarray):
        self.left, self.capacity = counts, len(counts) - 1
        lengths = np.flatnonzero(counts)
        self.pairs, self.pair_at = self._listed(lengths, lengths)
        self.triples, self.triple_at = self._listed(lengths, np.flatnonzero(np.diff(self.pair_at) > 0))
        self.pair_from, self.triple_from = self.pair_at[:-1].copy(), self.triple_at[:-1].copy()

    def _listed(self, lengths: np.ndarray, rests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each length with each rest, by their sum and then by length downward; and where each sum's list begins."""
        rows = [np.stack([np.full(len(fits), a, dtype=np.int32), fits]) for a in lengths.tolist() if len(fits := rests[rests <= self.capacity - a].astype(np.int32))]
        listed = np.concatenate(rows, axis=1) if rows else np.zeros((2, 0), dtype=np.int32)
        if rests is lengths:
            listed = listed[:, listed[0] >= listed[1]]
        sums = listed.sum(axis=0)
        order = np.lexsort((-listed[0], sums))
        return listed[:, order], np.searchsorted(sums[order], np.arange(self.capacity + 2))

    def pair(self, total: int, held: tuple[int, ...]) -> tuple[int, int] | None:
        """Two lengths of a sum that are still there besides those held."""
        lo, hi = int(self.pair_from[total]), int(self.pair_at[total + 1])
        a, b = self.pairs[:, lo:hi]
        there = (self.left[a] > 0) & (self.left[b] > (a == b))
        first = int(there.argmax()) if there.any() else hi - lo
        self.pair_from[total] = lo + first
        for k in (first + np.flatnonzero(there[first:])).tolist():
            found = int(a[k]), int(b[k])
            if all(self.left[x] >= found.count(x) + held.count(x) for x in set(found)):
                return found
        return None

    def fill(self, gap: int, held: int) -> tuple[int, ...] | None:
        """The lengths that exactly fill a gap: one, else two, else three; one piece of a length is held already."""
        if self.left[gap] > (gap == held):
            return (gap,)
        if found := self.pair(gap, (held,)):
            return found
        lo, hi = int(self.triple_from[gap]), int(self.triple_at[gap + 1])
        a, rest = self.triples[:, lo:hi]
        there = np.flatnonzero((self.left[a] > 0) & (self.pair_from[rest] < self.pair_at[rest + 1]))
        self.triple_from[gap] = lo + int(there[0]) if len(there) else hi
        for k in there.tolist():
            x = int(a[k])
            if self.left[x] > (x == held) and (found := self.pair(int(rest[k]), (held, x))):
                return (x, *found)
        return None


def plan_packing(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths of the pieces of one sequence, in order) and how many sequences have each."""
    left = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in counts.items():
        left[length] = n
    plan = [((capacity,), int(left[capacity]))] if left[capacity] else []
    left[capacity] = 0
    index = SumIndex(left)
    for length in range(capacity - 1, 0, -1):
        while left[length] and (found := index.fill(capacity - length, length)):
            pattern = (length, *found)
            times = min(int(left[x]) // pattern.count(x) for x in set(pattern))
            for x in pattern:
                left[x] -= times
            plan.append((pattern, times))
    open_bins: dict[int, list[list]] = {}
    room = np.zeros(capacity + 1, dtype=bool)

    def put(gap: int, pattern: tuple[int, ...], times: int) -> None:
        if times:
            open_bins.setdefault(gap, []).append([pattern, times])
            room[gap] = True

    for length in range(capacity - 1, 0, -1):
        todo = int(left[length])
        while todo:
            gaps = np.flatnonzero(room[length:])
            if len(gaps):
                gap = length + int(gaps[0])
                pattern, have = open_bins[gap].pop()
                if not open_bins[gap]:
                    room[gap] = False
            else:
                gap, pattern, have = capacity, (), -(-todo // (capacity // length))
            each = gap // length
            full = min(have, todo // each)
            put(gap - each * length, pattern + (length,) * each, full)
            todo -= full * each
            if full < have:
                if todo < each and todo:
                    put(gap - todo * length, pattern + (length,) * todo, 1)
                    full, todo = full + 1, 0
                if pattern:
                    put(gap, pattern, have - full)
    return plan + [(p, n) for group in open_bins.values() for p, n in group]


def _slots(plan: list[tuple[tuple[int, ...], int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted keys (length, first rank) of the plan's slots, with first rank, first sequence and offset."""
    rows, taken, sequence = [], {}, 0
    for pattern, times in plan:
        offset = 0
        for length in pattern:
            first = taken.get(length, 0)
            rows.append(((length << RANK_BITS) + first, first, sequence, offset))
            taken[length] = first + times
            offset += length
        sequence += times
    return tuple(np.array(x, dtype=np.int64) for x in zip(*sorted(rows))) if rows else (np.zeros(0, np.int64),) * 4


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of at most capacity tokens: doc_id, piece, start, length, ids_crc32; a longer document's first piece is the short one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, data in encoded(batches, tokenizer, end_id):
            out: list[tuple] = []
            for i, x in zip(ids, data):
                n = len(x) // 4
                cuts = [0, *range(n % capacity or capacity, n + 1, capacity)] if n > capacity else [0, n]
                out += [(i, k, a, b - a, zlib.crc32(x[4 * a : 4 * b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t"))
    return slim.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack_pieces(pieces: DataFrame, capacity: int) -> DataFrame:
    """pieces (with doc_id, piece, length, ids_crc32) with their sequence_id and offset.

    Reads pieces twice, so they should be materialised.
    """
    spark = pieces.sparkSession
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    slots = spark.sparkContext.broadcast(_slots(plan_packing(histogram, capacity)))
    salts = 1 << max(8, (sum(histogram.values()) // 200_000).bit_length())
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    order = ["doc_id", "piece", "ids_crc32"]
    salted = pieces.select(*names).withColumn(SALT, F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int"))
    counts = salted.groupBy("length", SALT).agg(F.count(F.lit(1)).alias("n"))
    smaller = Window.partitionBy("length").orderBy(SALT).rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("length", SALT, F.coalesce(F.sum("n").over(smaller), F.lit(0)).alias(BEFORE))
    ranked = salted.withColumn(RANK, F.row_number().over(Window.partitionBy("length", SALT).orderBy(*order)) - 1)
    ranked = ranked.join(before, ["length", SALT]).select(*names, (F.col(RANK) + F.col(BEFORE)).alias(RANK))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, first, sequence, offset = slots.value
        for batch in batches:
            rank = batch.column(5).to_numpy()
            at = np.searchsorted(keys, (batch.column(3).to_numpy() << RANK_BITS) + rank, side="right") - 1
            places = [pa.array(sequence[at] + rank - first[at]), pa.array(offset[at])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], *places], names=[*names, "sequence_id", "offset"])

    return ranked.mapInArrow(deal, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every document."""
    return pack_pieces(checkpointed(token_pieces(docs, tokenizer, end_id, capacity, id_col, text_col)), capacity)
