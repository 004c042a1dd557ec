"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are windows of ``window`` consecutive words of a benchmark item; an item of fewer words is
one pattern.  Texts are mapped to ids of benchmark words (others: 0).  For each group of patterns,
by length, a shift table over blocks of two words tells how far the search may jump; at shift 0 the
suffix's bucket gives the few patterns that a direct comparison then confirms.

The benchmark is written in blocks of at most ``block_words`` pattern words to the shared folder.  A
worker process reads a block and builds its tables once, whatever the number of tasks, and holds one
block at a time: with several blocks the documents pass through one search a block, each of whose
results but the last is written, and carry their hits along.

Results in odd cases: a null or wordless text has no words, no hits and is clean; a null or
wordless item is no pattern; rows of one item id count as one item; a null item id is written as an
empty string; repeated documents each get a row; extra columns are not read, or carried along if asked for,
but for those that the new columns replace.
"""

from __future__ import annotations

import functools
import pickle
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import filesystem, id_and_text, scratch

#: Bytes of words: digits, lower-case letters and all of non-ASCII; A-Z become a-z, the rest spaces.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
SHIFT_BITS = 18
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[bytes]:
    """The words of a text, as UTF-8."""
    return text.encode().translate(_TABLE).split() if text else []


def _blocks(ids: np.ndarray) -> np.ndarray:
    """Slots in the shift table of the two-word blocks that end at each place from 1."""
    joined = (ids[:-1].astype(np.uint64) << np.uint64(32)) | ids[1:].astype(np.uint64)
    return ((joined * _MIX) >> np.uint64(64 - SHIFT_BITS)).astype(np.int64)


class WuManber:
    """Finds all occurrences of patterns of one length in a row of word ids."""

    def __init__(self, length: int, patterns: dict[tuple[int, ...], list[str]]):
        self.length, self.items = length, patterns
        if length > 1:
            self.shift = np.full(1 << SHIFT_BITS, length - 1, dtype=np.int32)
            self.buckets: dict[int, set[tuple[int, ...]]] = defaultdict(set)
            for p in patterns:
                slots = _blocks(np.array(p, dtype=np.int64))
                np.minimum.at(self.shift, slots, np.arange(length - 2, -1, -1, dtype=np.int32))
                self.buckets[int(slots[-1])].add(p)

    def find(self, ids: np.ndarray) -> list[tuple[int, tuple[int, ...]]]:
        n, length = len(ids), self.length
        if n < length:
            return []
        if length == 1:
            return [(i, (w,)) for i, w in enumerate(ids.tolist()) if w and (w,) in self.items]
        slots = _blocks(ids)
        jumps, found, at = self.shift[slots].tolist(), [], length - 2
        while at < n - 1:  # the block at this place ends with the word at + 1
            jump = jumps[at]
            if jump:
                at += jump
                continue
            bucket = self.buckets.get(int(slots[at]))
            if bucket:
                window = tuple(ids[at + 2 - length : at + 2].tolist())
                if window in bucket:
                    found.append((at + 2 - length, window))
            at += 1
        return found


class Patterns:
    """The search tables of one block of the benchmark."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        by_length: dict[int, dict[tuple[int, ...], list[str]]] = defaultdict(lambda: defaultdict(list))
        for item, found in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in found]
            length = min(window, len(ids))
            for i in range(len(ids) - length + 1):
                owners = by_length[length][tuple(ids[i : i + length])]
                if item not in owners:
                    owners.append(item)
        self.searches = [WuManber(n, dict(p)) for n, p in sorted(by_length.items())]

    def search(self, text_words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Spans (first word, end) that occurrences cover, merged, and the items found."""
        get = self.vocabulary.get
        ids = np.fromiter((get(w, 0) for w in text_words), dtype=np.int64, count=len(text_words))
        spans, items = [], set()
        for search in self.searches:
            for at, pattern in search.find(ids):
                spans.append((at, at + search.length))
                items.update(search.items[pattern])
        return merged(spans), items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def _written_blocks(benchmark: DataFrame, window: int, block_words: int, item_col: str, text_col: str) -> list[str]:
    """Files of items and their words; the driver holds one block at a time."""
    root, paths, held, size = scratch(benchmark.sparkSession, "patterns"), [], [], 0

    def write() -> None:
        store, folder = filesystem(root)
        store.create_dir(folder, recursive=True)
        paths.append(f"{root}/{len(paths)}.pickle")
        with store.open_output_stream(filesystem(paths[-1])[1]) as out:
            out.write(pickle.dumps((held, window)))

    for row in benchmark.select(F.col(item_col).cast("string").alias("i"), F.col(text_col).alias("t")).toLocalIterator():
        found = words(row["t"])
        if found:
            weight = (len(found) - min(window, len(found)) + 1) * min(window, len(found))
            if held and size + weight > block_words:
                write()
                held, size = [], 0
            held.append((row["i"] or "", found))
            size += weight
    if held or not paths:
        write()
    return paths


@functools.lru_cache(maxsize=1)
def patterns_at(path: str) -> Patterns:
    """The search tables of a block, built once a worker process; the next block replaces them."""
    store, file = filesystem(path)
    with store.open_input_file(file) as source:
        return Patterns(*pickle.loads(source.readall()))


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = 13, block_words: int = 4_000_000, id_col: str = "doc_id",
                       text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", carry: bool = False) -> DataFrame:
    """A row for each document: doc_id (with carry: all columns), n_words, spans (array of first word and end), items (array of item ids, sorted)."""
    blocks = _written_blocks(benchmark, window, block_words, item_col, item_text_col)
    spans_type = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))
    added = "n_words bigint, spans array<struct<first:bigint,end:bigint>>, items array<string>"

    def search(block: str, text_at: int, keep: int, found_at: int | None):
        """Search one block; found_at: where an earlier block's spans are, if there was one."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            patterns = patterns_at(block)
            for batch in batches:
                counts, spans, items = [], [], []
                was = batch.column(found_at).to_pylist() if found_at else [[]] * batch.num_rows
                had = batch.column(found_at + 1).to_pylist() if found_at else [[]] * batch.num_rows
                for text, before, known in zip(batch.column(text_at), was, had):
                    found = words(text.as_py())
                    hit, new = patterns.search(found)
                    counts.append(len(found))
                    spans.append([{"first": a, "end": b} for a, b in merged([(s["first"], s["end"]) for s in before] + hit)])
                    items.append(sorted({*known, *new}))
                new_columns = [pa.array(counts, pa.int64()), pa.array(spans, spans_type), pa.array(items, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([*batch.columns[:keep], *new_columns], names=[*batch.schema.names[:keep], "n_words", "spans", "items"])

        return run

    out, _, _, text_at = id_and_text(docs, id_col, text_col, added, carry)
    for k, block in enumerate(blocks):
        last = k == len(blocks) - 1
        keep = len(out.columns) - 3 * (k > 0)
        found_at = keep + 1 if k else None
        if last and not carry:
            keep = 1
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema.fields[:keep])
        out = out.mapInArrow(search(block, text_at, keep, found_at), f"{fields}, {added}")
        if not last:
            path = scratch(docs.sparkSession, "searched")
            out.write.parquet(path)
            out = docs.sparkSession.read.schema(out.schema).parquet(path)
    return out


def n_hit() -> Column:
    return F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["first"])


def contaminated(per_cent: int = 5) -> Column:
    """Whether words in occurrences are at least so many per cent of a document's words."""
    return (n_hit() > 0) & (100 * n_hit() >= per_cent * F.col("n_words"))


def verdicts(found: DataFrame, per_cent: int = 5) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of find_contamination()'s rows."""
    return found.select(
        "doc_id", "n_words", n_hit().alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), contaminated(per_cent).alias("contaminated"),
    )


_SQL_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
ORACLE = f"""
WITH items AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_SQL_WORDS} AS w FROM benchmark),
patterns AS (
  SELECT DISTINCT item, n, list_aggregate(list_slice(w, i, i + n - 1), 'string_agg', ' ') AS gram
  FROM (SELECT item, w, least(len(w), 13) AS n, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM items WHERE len(w) > 0)),
docs AS (SELECT doc_id, row_number() OVER () AS k, {_SQL_WORDS} AS w FROM documents),
grams AS (
  SELECT k, n, i, list_aggregate(list_slice(w, i, i + n - 1), 'string_agg', ' ') AS gram
  FROM (SELECT k, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, (SELECT DISTINCT n FROM patterns) WHERE len(w) >= n)),
found AS (SELECT g.k, g.i, g.n, p.item FROM grams g JOIN patterns p ON g.n = p.n AND g.gram = p.gram),
hits AS (SELECT k, count(DISTINCT place) AS n_hit FROM (SELECT k, unnest(range(i, i + n)) AS place FROM found) GROUP BY k),
owners AS (SELECT k, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT k, item FROM found) GROUP BY k)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN hits USING (k) LEFT JOIN owners USING (k)
"""
