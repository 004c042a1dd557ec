"""Near-duplicates by SimHash, found with Gray-order hierarchical indexes.

A fingerprint has 64 bits, by majority over the XXH64 of a text's word shingles.  Equal
fingerprints are first collapsed.  Two fingerprints with at most ``distance`` differing bits agree
on ``kept`` of ``distance + kept`` bit blocks, so each fingerprint goes to one bucket for each
choice of kept blocks; buckets are found by hashing, so the work is spread.  A task sorts the
fingerprints of its buckets by Gray rank and builds an index bottom up: a node factors out the bit
pattern that its members share, under a mask.  The search compares pairs of nodes from the roots:
differences in the shared bits accumulate, and a pair of groups with more than ``distance`` is
pruned as a whole; groups that cannot differ by more are linked as a whole; groups already linked
are skipped.  A task gives a forest, so at most one link for each member, never all pairs.

Results in odd cases: null and wordless texts have fingerprint zero and are linked like any other; a
null id can be a member, and is a component's id only if it has no other; repeated rows each get a
row; an empty table gives no rows; extra columns are not read; ids have to be whole numbers (text that
is none is an error).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import OWN, checkpointed, id_and_text, scratch, widened
from .components import components

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
FAN_OUT, CHUNK, SLICE = 8, 40_000, 65_536


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """The SimHash of a whole text, unsigned."""
    from xxhash import xxh64_intdigest

    found = text.encode().translate(_LOWER).split() if text else []
    if not found:
        return 0
    joined = b" ".join(found)
    if len(found) <= shingle:
        return xxh64_intdigest(joined, 42)
    ends = list(accumulate([len(w) + 1 for w in found]))
    starts = [0, *ends[:-1]]
    ones, count = np.zeros(64, dtype=np.int64), len(found) - shingle + 1
    for at in range(0, count, SLICE):
        some = zip(starts[at : min(at + SLICE, count)], ends[at + shingle - 1 :])
        hashes = np.array([xxh64_intdigest(joined[a : b - 1], 42) for a, b in some], dtype="<u8")
        octets = hashes.view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > count, bitorder="little").view("<u8")[0])


def block_masks(distance: int = 4, kept: int = 2) -> list[int]:
    """Bit masks, unsigned, one for each choice of kept blocks."""
    blocks = distance + kept
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    each = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:])]
    return [sum(x) for x in combinations(each, kept)]


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Places of the codes in the reflected Gray sequence."""
    out = codes.copy()
    for s in (1, 2, 4, 8, 16, 32):
        out ^= out >> np.uint64(s)
    return out


class GrayIndex:
    """Hierarchies over the fingerprints of many buckets, searched together."""

    def __init__(self, buckets: np.ndarray, codes: np.ndarray, distance: int):
        """Rows are sorted by bucket and then by Gray rank; buckets are numbered."""
        self.codes, self.distance = codes, distance
        self.compared = 0  # pairs of nodes
        self.labels = np.arange(len(codes))
        every = np.uint64(0xFFFFFFFFFFFFFFFF)
        self.levels = [(codes, codes, np.append(np.arange(len(codes)), len(codes)))]  # and, or, first leaf
        self.children: list[np.ndarray] = [np.zeros(0, np.int64)]
        self.every = every
        owner = buckets
        while len(owner) and (owner[1:] == owner[:-1]).any():
            heads = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            inside = np.arange(len(owner)) - np.repeat(heads, np.diff(np.append(heads, len(owner))))
            first = np.flatnonzero(inside % FAN_OUT == 0)
            low, high, leaf = self.levels[-1]
            self.levels.append((np.bitwise_and.reduceat(low, first), np.bitwise_or.reduceat(high, first), np.append(leaf[first], leaf[-1])))
            self.children.append(np.append(first, len(owner)))
            owner = owner[first]

    def _spread(self, level: int, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Differences that all pairs of members of two nodes have, and those that they may have at most."""
        low, high, _ = self.levels[level]
        shared = ~((low[i] ^ high[i]) | (low[j] ^ high[j]))
        differ = np.bitwise_count((low[i] ^ low[j]) & shared).astype(np.int64)
        return differ, differ + 64 - np.bitwise_count(shared)

    def _link(self, a: np.ndarray, b: np.ndarray) -> None:
        labels = self.labels
        while True:
            x, y = labels[a], labels[b]
            far = x != y
            if not far.any():
                break
            a, b, x, y = a[far], b[far], x[far], y[far]
            np.minimum.at(labels, np.maximum(x, y), np.minimum(x, y))
            while (labels[labels] != labels).any():
                labels[:] = labels[labels]

    def _known(self, level: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Pairs of nodes whose members are all in one component already."""
        first = self.levels[level][2]
        if level == 0:
            return self.labels[i] == self.labels[j]
        heads = first[:-1]
        low, high = np.minimum.reduceat(self.labels, heads), np.maximum.reduceat(self.labels, heads)
        return (low[i] == high[i]) & (low[j] == high[j]) & (low[i] == low[j])

    def search(self) -> np.ndarray:
        """The label of each row: the first row of its component within its bucket."""
        top = len(self.levels) - 1
        roots = np.arange(len(self.levels[top][0]))
        stack = [(top, roots[at : at + CHUNK], roots[at : at + CHUNK]) for at in range(0, len(roots), CHUNK)]
        while stack:
            level, i, j = stack.pop()
            new = ~self._known(level, i, j) if level < top else np.ones(len(i), dtype=bool)
            i, j = i[new], j[new]
            self.compared += len(i)
            least, most = self._spread(level, i, j)
            first = self.levels[level][2]
            whole = most <= self.distance
            if whole.any():
                a, b = i[whole], j[whole]
                self._link(first[a], first[b])
                same = a[a == b]
                size = first[same + 1] - first[same]
                inner = np.repeat(first[same], size)
                self._link(inner, inner + np.arange(len(inner)) - np.repeat(np.cumsum(size) - size, size))
            go = (least <= self.distance) & ~whole
            if level == 0 or not go.any():
                continue
            i, j = i[go], j[go]
            edge = self.children[level]
            wide, high = edge[i + 1] - edge[i], edge[j + 1] - edge[j]
            total = wide * high
            pair = np.repeat(np.arange(len(i)), total)
            inner = np.arange(len(pair)) - np.repeat(np.cumsum(total) - total, total)
            x, y = edge[i][pair] + inner // high[pair], edge[j][pair] + inner % high[pair]
            keep = x <= y if level > 1 else x < y
            x, y = x[keep], y[keep]
            keep = self._spread(level - 1, x, y)[0] <= self.distance
            x, y = x[keep], y[keep]
            order = np.argsort(x - y, kind="stable")  # far pairs first, so that near ones are taken from the stack's end
            x, y = x[order], y[order]
            stack += [(level - 1, x[at : at + CHUNK], y[at : at + CHUNK]) for at in range(0, len(x), CHUNK)]
        return self.labels


def bucket_links(choice: np.ndarray, codes: np.ndarray, masks: np.ndarray, distance: int, group: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links of a forest within each bucket: rows are (which choice of kept blocks, fingerprint, group of the bucket)."""
    index, codes = bucket_index(choice, codes, masks, distance, group)
    labels = index.search()
    linked = labels != np.arange(len(codes))
    return codes[linked], codes[labels[linked]]


def bucket_index(choice: np.ndarray, codes: np.ndarray, masks: np.ndarray, distance: int, group: np.ndarray | None = None) -> tuple[GrayIndex, np.ndarray]:
    """The index of all buckets with several fingerprints, and these."""
    group = np.zeros(len(codes), dtype=np.int32) if group is None else group
    key = codes & masks[choice]
    order = np.lexsort((gray_rank(codes), group, key, choice))
    choice, key, codes, group = choice[order], key[order], codes[order], group[order]
    new = np.append(True, (choice[1:] != choice[:-1]) | (key[1:] != key[:-1]) | (group[1:] != group[:-1]))
    bucket = np.cumsum(new) - 1
    several = np.bincount(bucket)[bucket] > 1
    return GrayIndex(bucket[several], codes[several], distance), codes[several]


def fingerprints(docs: DataFrame, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and code (the fingerprint as a signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(codes.view(np.int64))], names=["doc_id", "code"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t")).mapInArrow(run, "doc_id long, code long")


def kept_blocks(codes: int, distance: int = 4, fill: int = 64) -> int:
    """How many blocks to keep, so that a bucket of unlike fingerprints has about ``fill`` of them at most."""
    kept = 2
    while kept < 8 and codes > fill << 64 * kept // (distance + kept):
        kept += 1
    return kept


def _dealt(placed: DataFrame, sampled: int, group_size: int) -> DataFrame:
    """placed (choice, key, code) with pair: 0, or for large buckets the number of the pair of groups whose task gets the row.

    A bucket is large if more than group_size / sampled of the fingerprints whose hash is divisible
    by ``sampled`` are in it; then it is cut into groups of about group_size, and each group goes to the
    tasks of all pairs with it.  What the sample says bears on the dealing alone: any is exact.
    """
    some = placed.where(F.pmod(F.xxhash64("code"), F.lit(sampled)) == 0)
    large = some.groupBy("choice", "key").agg(F.count(F.lit(1)).alias("n")).where(f"n > {group_size // sampled}")
    large = checkpointed(large.select("choice", "key", F.expr(f"cast(n * {sampled} div {group_size} + 1 as int)").alias("g")))
    n = large.count()
    if not n:
        return placed.select("choice", "key", "code", F.lit(0).alias("pair"))
    joined = placed.join(F.broadcast(large) if n < 1_000_000 else large, ["choice", "key"], "left")
    own = F.pmod(F.xxhash64(F.lit(1), "code"), F.col("g")).cast("int")
    other = F.when(F.col("g").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("g") - 1))
    each = joined.withColumn("own", F.coalesce(own, F.lit(0))).withColumn("other", F.explode(other))
    return each.select("choice", "key", "code", F.coalesce(F.least("own", "other") * F.col("g") + F.greatest("own", "other"), F.lit(0)).alias("pair"))


def near_links(codes: DataFrame, distance: int = 4, kept: int | None = None, sampled: int = 64, group_size: int = 8192) -> DataFrame:
    """Links (u, v) that connect all distinct codes within the distance, directly or through others.  codes should be materialised."""
    kept = kept or kept_blocks(codes.count(), distance)
    masks = np.array(block_masks(distance, kept), dtype=np.uint64)
    signed = masks.view(np.int64).tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [[c.to_numpy() for c in b.columns] for b in batches if b.num_rows]
        if held:
            choice, code, pair = (np.concatenate(x) for x in zip(*held))
            u, v = bucket_links(choice, code.view(np.uint64), masks, distance, pair)
            for at in range(0, len(u), 100_000):
                some = slice(at, at + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(u[some].view(np.int64)), pa.array(v[some].view(np.int64))], names=["u", "v"])

    placed = codes.select(F.posexplode(F.array(*[F.lit(m) for m in signed])).alias("choice", "mask"), "code")
    placed = placed.select("choice", F.col("code").bitwiseAND(F.col("mask")).alias("key"), "code")
    dealt = _dealt(placed, sampled, group_size).repartition("choice", "key", "pair").select("choice", "code", "pair")
    return dealt.mapInArrow(run, "u long, v long")


def _rooted(prints: DataFrame, distance: int) -> DataFrame:
    """For each distinct code: code, root (the code that names its component), least_id, and the component's least id."""
    distinct = checkpointed(prints.groupBy("code").agg(F.min("doc_id").alias("least_id")))
    found = components(near_links(distinct.select("code"), distance))
    rooted = distinct.join(found.select(F.col("u").alias("code"), F.col("v").alias("root")), "code", "left")
    rooted = checkpointed(rooted.withColumn("root", F.coalesce("root", "code")))
    # checkpointed, so that the join reads both sides from a shuffle and can split a component with many codes
    ids = checkpointed(rooted.groupBy("root").agg(F.min("least_id").alias("component_id")))
    return rooted.join(ids, "root")


def near_duplicates(docs: DataFrame, distance: int = 4, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, the smallest id that links reach."""
    prints = checkpointed(fingerprints(docs, shingle, id_col, text_col))
    named = _rooted(prints, distance).select("code", "component_id")
    return prints.join(named, "code").select("doc_id", F.lower(F.lpad(F.hex("code"), 16, "0")).alias("fingerprint"), "component_id")


def representatives(docs: DataFrame, distance: int = 4, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One whole row of each component: of the smallest id (rows without one come last), that of the smallest text.

    An id may repeat with other texts: rows are told apart by their fingerprints, and components by
    their roots, since two components can have the same smallest id.  The rows are written with
    their fingerprints, so that these are made once; rows alike in id and fingerprint are reduced to
    one before the shuffle of the texts, of which there is one alone.
    """
    code, number, missing, root, only, row = (f"{OWN}{x}" for x in ("code", "number", "missing", "root", "only", "row"))
    slim, schema, _, text_at = id_and_text(docs, id_col, text_col, f"{code} long", True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(text_at)], dtype=np.uint64)
            yield widened(batch, {code: pa.array(codes.view(np.int64))}, True)

    path = scratch(docs.sparkSession, "coded")
    slim.mapInArrow(run, schema).write.parquet(path)
    coded = docs.sparkSession.read.schema(schema).parquet(path)
    rooted = _rooted(coded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(code).alias("code")), distance)
    first = rooted.where(F.col("least_id").eqNullSafe(F.col("component_id"))).select("code", "root", "least_id")
    alone = first.groupBy("root").agg((F.count(F.lit(1)) == 1).alias("alone"))
    keyed = lambda df, c, i: df.select(F.col(c).alias(code), F.coalesce(i, F.lit(0)).alias(number), i.isNull().alias(missing), *[x for x in df.columns if x != c])
    first = keyed(checkpointed(first.join(alone, "root")), "code", F.col("least_id")).select(code, number, missing, F.col("root").alias(root), F.col("alone").alias(only))
    order = [text_col, *[c for c in docs.columns if c != text_col]]
    rows = keyed(coded, code, F.col(id_col).cast("long")).groupBy(code, number, missing).agg(F.min(F.struct(*[F.col(f"`{c}`") for c in order])).alias(row))
    chosen = rows.join(first, [code, number, missing])  # dealt as the rows are: texts are shuffled once
    tied = chosen.where(~F.col(only)).groupBy(root).agg(F.min(row).alias(row))
    return chosen.where(only).select(row).unionByName(tied.select(row)).select(*[F.col(f"{row}.`{c}`") for c in docs.columns])
