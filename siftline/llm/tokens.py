"""Token ids in seekable zstandard files.

A file is a run of independent zstandard frames of at most FRAME_IDS ids each (little-endian
unsigned 32-bit), then a skippable frame with the document index, then the seek table of the public
zstandard seekable format, with a checksum for each frame.  A reader loads the last bytes, the seek
table and the index, and decompresses only the frames that hold the documents asked for.

Results in odd cases: a null text counts as empty and has the end id alone; documents of one id go
by a hash of their texts, and may lie in several files; a null id sorts first and is kept; ids have to
be whole numbers (text that is none is an error); an empty table writes a manifest without
files; extra columns are not read.  A document may span frames, so its length has no bound.
"""

from __future__ import annotations

import functools
import json
import os
import re
import struct
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import filesystem

FRAME_IDS = 65536
#: Fixed values of the zstandard frame and seekable formats.
SKIPPABLE_INDEX, SKIPPABLE_SEEK, SEEK_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1

#: White space of any kind, as RE2 and Python know it, next to a space; or a space at either end.
_WHITE = "[\\s\\x0b\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
_UNSAFE = f" {_WHITE}|{_WHITE} |^ | $"
_BETWEEN = re.compile(r"(?<=\S) (?=\S)")
#: Characters of a segment and of a batch; pieces that are encoded in one call's text.
SEGMENT, BATCH, GROUP = 1 << 21, 10_000_000, 128


def _segments(text: str) -> list[str]:
    """A text in runs of about SEGMENT characters, cut where a token starts in any case."""
    cuts = [0]
    while len(text) - cuts[-1] > SEGMENT and (found := _BETWEEN.search(text, cuts[-1] + SEGMENT)):
        cuts.append(found.start())
    return [text[a:b] for a, b in zip(cuts, [*cuts[1:], len(text)])]


class PieceEncoder:
    """The ids of whole texts, as bytes, from the tokenizers library.

    Byte-level pre-tokenisation always starts a new token at a single space between two characters
    that are no white space.  So texts are cut there, the distinct pieces of a batch are found by
    Arrow's dictionary encoding, and each is encoded once; a cache keeps the ids of the first
    ``entries`` pieces of at most ``longest`` characters.  numpy then lines the ids up.
    """

    def __init__(self, path: str, entries: int = 1_000_000, longest: int = 32):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.entries, self.longest = entries, longest
        self.cache = pa.array([], pa.large_string())
        self.pool, self.used = np.zeros(1 << 20, dtype="<u4"), 0
        self.starts, self.sizes = np.zeros(entries, dtype=np.int32), np.zeros(entries, dtype=np.int32)
        n = self.tokenizer.get_vocab_size()
        self.opens = np.array([(self.tokenizer.id_to_token(i) or "").startswith("Ġ") for i in range(n)])

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype="<u4") for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _spaced(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces with a space before each, one after another, and how many each has."""
        if any(" " in p for p in pieces):
            found = self._whole([" " + p for p in pieces])
            return np.concatenate(found), np.array([len(x) for x in found])
        groups = [pieces[at : at + GROUP] for at in range(0, len(pieces), GROUP)]
        ids: list[np.ndarray] = []
        for at in range(0, len(groups), 100):
            found = self.tokenizer.encode_batch_fast([" " + " ".join(g) for g in groups[at : at + 100]], add_special_tokens=False)
            ids += [np.array(e.ids, dtype="<u4") for e in found]
        joined = np.concatenate(ids)
        cuts = np.flatnonzero(self.opens[joined])
        if len(cuts) != len(pieces):  # not seen so far: a piece with a second token that begins like a first one
            found = self._whole([" " + p for p in pieces])
            return np.concatenate(found), np.array([len(x) for x in found])
        return joined, np.diff(np.append(cuts, len(joined)))

    def _keep(self, pieces: pa.Array, ids: np.ndarray, sizes: np.ndarray) -> None:
        room = self.entries - len(self.cache)
        if room <= 0:
            return
        kept = np.flatnonzero(pc.less_equal(pc.utf8_length(pieces), self.longest).to_numpy(zero_copy_only=False))[:room]
        at, ends = slice(len(self.cache), len(self.cache) + len(kept)), np.cumsum(sizes)
        self.cache = pa.concat_arrays([self.cache, pieces.take(pa.array(kept))])
        self.starts[at], self.sizes[at] = self.used + ends[kept] - sizes[kept], sizes[kept]
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used : self.used + len(ids)] = ids
        self.used += len(ids)

    def _distinct(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A pool of ids, and each piece's place and size in it."""
        numbers = pc.fill_null(pc.index_in(pieces, self.cache), -1).to_numpy()
        late = np.flatnonzero(numbers < 0)
        starts, sizes = self.starts[numbers], self.sizes[numbers]
        pool = self.pool[: self.used]
        if len(late):
            missing = pieces.take(pa.array(late))
            ids, n = self._spaced(missing.to_pylist())
            starts[late], sizes[late] = len(pool) + np.cumsum(n) - n, n
            pool = np.concatenate([pool, ids])
            self._keep(missing, ids, n)
        return pool, starts, sizes

    def _encode(self, texts: list[str]) -> list[bytes]:
        column = pa.array(texts, pa.large_string())
        unsafe = pc.match_substring_regex(column, _UNSAFE)
        pieces = pc.split_pattern(column, " ")
        if pc.any(unsafe).as_py():
            mixed = [_BETWEEN.split(t) if u else t.split(" ") for t, u in zip(texts, unsafe.to_pylist())]
            pieces = pa.array(mixed, pa.large_list(pa.large_string()))
        bounds = np.asarray(pieces.offsets).astype(np.int64)
        coded = pieces.flatten().dictionary_encode()
        word = np.asarray(coded.indices)
        pool, starts, sizes = self._distinct(coded.dictionary)
        first = bounds[:-1]
        heads, which = np.unique(word[first], return_inverse=True)
        bare = self._whole(coded.dictionary.take(pa.array(heads)).to_pylist())  # without the space in front
        own = np.array([len(x) for x in bare], dtype=np.int32)
        begin, size = starts[word], sizes[word]
        begin[first], size[first] = (len(pool) + np.cumsum(own) - own)[which], own[which]
        pool = np.concatenate([pool, *bare])
        ends = np.append(0, np.cumsum(size, dtype=np.int32))
        at = np.repeat(begin - ends[:-1], size)
        at += np.arange(ends[-1], dtype=np.int32)
        ids = pool[at]
        data, edges = ids.tobytes(), (ends[bounds] * 4).tolist()
        return [data[a:b] for a, b in zip(edges, edges[1:])]

    def encode(self, texts: Sequence[str | None]) -> list[bytes]:
        parts = [_segments(t or "") for t in texts]
        flat, out, held, size = [s for p in parts for s in p], [], [], 0
        total = sum(map(len, flat))
        most = total / max(1, round(total / BATCH))  # batches alike: each has the cost of looking the cache up
        for segment in flat:
            held.append(segment)
            size += len(segment)
            if size >= most:
                out += self._encode(held)
                held, size = [], 0
        out += self._encode(held) if held else []
        done = iter(out)
        return [b"".join(next(done) for _ in p) for p in parts]


@functools.cache
def piece_encoder(path: str) -> PieceEncoder:
    """One encoder for each worker process, which outlives its tasks."""
    return PieceEncoder(path)


def encoded(batches: Iterator[pa.RecordBatch], tokenizer: str, end_id: int, at_once: int = 3000) -> Iterator[tuple[list, list[bytes]]]:
    """For batches of (id, text): ids and the documents' token bytes with the end id."""
    encoder, end = piece_encoder(tokenizer), struct.pack("<I", end_id)
    for batch in batches:
        for at in range(0, batch.num_rows, at_once):
            some = batch.slice(at, at_once)
            yield some.column(0).to_pylist(), [x + end for x in encoder.encode(some.column(1).to_pylist())]
    pa.default_memory_pool().release_unused()  # the worker lives on


class FrameWriter:
    """Writes one file of the format."""

    def __init__(self, sink):
        import zstandard

        self.sink, self.zip = sink, zstandard.ZstdCompressor(level=3, write_checksum=False)
        self.pending, self.pending_bytes, self.table = [], 0, []
        self.ids: list[int | None] = []
        self.lengths: list[int] = []

    def add(self, doc_id: int | None, data: bytes) -> None:
        self.ids.append(doc_id)
        self.lengths.append(len(data) // 4)
        self.pending.append(data)
        self.pending_bytes += len(data)
        if self.pending_bytes >= FRAME_IDS * 4:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        import xxhash

        data, size, at = b"".join(self.pending), FRAME_IDS * 4, 0
        while len(data) - at >= size or (last and at < len(data)):
            raw = data[at : at + size]
            frame = self.zip.compress(raw)
            self.sink.write(frame)
            self.table.append((len(frame), len(raw), xxhash.xxh64_intdigest(raw, 0) & 0xFFFFFFFF))
            at += len(raw)
        self.pending, self.pending_bytes = [data[at:]], len(data) - at

    def close(self) -> None:
        self._flush(True)
        nulls = np.array([i is None for i in self.ids], dtype=np.uint8).tobytes()
        ids = np.array([i or 0 for i in self.ids], dtype="<i8").tobytes()
        index = self.zip.compress(nulls + ids + np.array(self.lengths, dtype="<i8").tobytes())
        self.sink.write(struct.pack("<III", SKIPPABLE_INDEX, len(index) + 4, len(self.ids)) + index)
        entries = b"".join(struct.pack("<III", *x) for x in self.table)
        self.sink.write(struct.pack("<II", SKIPPABLE_SEEK, len(entries) + 9) + entries)
        self.sink.write(struct.pack("<IBI", len(self.table), 0x80, SEEK_MAGIC))


class FrameReader:
    """Random access to one file of the format."""

    def __init__(self, source):
        import zstandard

        self.source, self.unzip = source, zstandard.ZstdDecompressor()
        size = source.size()
        frames, flags, magic = struct.unpack("<IBI", self._read(size - 9, 9))
        if magic != SEEK_MAGIC or flags != 0x80:
            raise ValueError("not a seekable file with checksums")
        raw = self._read(size - 9 - 12 * frames, 12 * frames)
        self.table = np.frombuffer(raw, dtype="<u4").reshape(frames, 3).astype(np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.table[:, 0])])
        self.first = np.concatenate([[0], np.cumsum(self.table[:, 1])]) // 4
        kind, length, n = struct.unpack("<III", self._read(int(self.at[-1]), 12))
        if kind != SKIPPABLE_INDEX:
            raise ValueError("no document index")
        index = self.unzip.decompress(self._read(int(self.at[-1]) + 12, length - 4))
        nulls = np.frombuffer(index[:n], dtype=np.uint8)
        ids = np.frombuffer(index[n : 9 * n], dtype="<i8").tolist()
        self.ids = [None if x else i for i, x in zip(ids, nulls)]
        self.lengths = np.frombuffer(index[9 * n :], dtype="<i8")
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])

    def _read(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def frame(self, k: int) -> bytes:
        import xxhash

        size, raw_size, check = self.table[k].tolist()
        raw = self.unzip.decompress(self._read(int(self.at[k]), size), max_output_size=raw_size)
        if len(raw) != raw_size or xxhash.xxh64_intdigest(raw, 0) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {k} is damaged")
        return raw

    def documents(self, wanted: Sequence[int] | None = None) -> Iterator[tuple[int, Iterator[bytes]]]:
        """(place in the file, chunks of its ids' bytes) of the wanted documents, or all."""
        held, raw = -1, b""
        for d in range(len(self.ids)) if wanted is None else wanted:
            lo, hi, chunks = int(self.starts[d]), int(self.starts[d + 1]), []
            k = int(np.searchsorted(self.first, lo, side="right")) - 1
            while lo < hi:
                if k != held:
                    held, raw = k, self.frame(k)
                base, end = int(self.first[k]), int(self.first[k + 1])
                chunks.append(raw[(lo - base) * 4 : (min(hi, end) - base) * 4])
                lo, k = min(hi, end), k + 1
            yield d, iter(chunks)


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", task_bytes: int = 128 << 20) -> dict:
    """Write the ids of docs in ascending id order below path, about task_bytes of text a file; gives (and writes) the manifest.

    Every attempt of a task writes a file under a name of its own, and the manifest lists those of the
    attempts that succeeded; the others are deleted in the end, and no reader ever looks at them.  So
    a lost executor's file is written again without trace, on any file system.  The manifest has a
    line for each file, the only thing that the driver collects.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        name, writer, sink = f"part-{task.partitionId():06d}-{task.taskAttemptId()}.zids", None, None
        store, root = filesystem(path)
        for ids, data in encoded(batches, tokenizer, end_id):
            if writer is None:
                store.create_dir(root, recursive=True)
                sink = store.open_output_stream(f"{root}/{name}")
                writer = FrameWriter(sink)
            for i, x in zip(ids, data):
                writer.add(i, x)
        if writer is not None:
            writer.close()
            sink.close()
            yield pa.RecordBatch.from_pydict({"part": pa.array([task.partitionId()], pa.int32()), "name": [name], "docs": [len(writer.ids)], "ids": [sum(writer.lengths)]})

    from pyarrow import fs

    slim = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t"))
    size = slim.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // task_bytes))
    # rows equal in id and text are dealt by where they come from, so that any number of them is split
    placed = slim.select("i", "t", F.xxhash64("t").alias("h"), F.spark_partition_id().alias("p"))
    ordered = placed.repartitionByRange(parts, "i", "h", "p").sortWithinPartitions("i", "h").select("i", "t")
    files = ordered.mapInArrow(run, "part int, name string, docs long, ids long").collect()
    manifest, start = [], 0
    for f in sorted(files):
        manifest.append({"name": f["name"], "docs": f["docs"], "ids": f["ids"], "start": start})
        start += f["ids"]
    store, root = filesystem(path)
    store.create_dir(root, recursive=True)
    listed = {f["name"] for f in manifest}
    for found in store.get_file_info(fs.FileSelector(root)):
        if found.base_name.endswith(".zids") and found.base_name not in listed:
            store.delete_file(found.path)
    with store.open_output_stream(f"{root}/manifest.json") as out:
        out.write(json.dumps(manifest).encode())
    return {"files": manifest, "ids": start}


def read_tokens(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """All documents of the files: doc_id, start, n_tokens, ids_crc32 (and ids, as bytes, if asked for)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                store, root = filesystem(path)
                with store.open_input_file(f"{root}/{name}") as source:
                    reader = FrameReader(source)
                    rows, held = [], 0
                    for d, chunks in reader.documents():
                        crc, kept = 0, []
                        for chunk in chunks:
                            crc = zlib.crc32(chunk, crc)
                            kept += [chunk] if with_ids else []
                        rows.append((reader.ids[d], base + int(reader.starts[d]), int(reader.lengths[d]), crc, b"".join(kept)))
                        held += len(rows[-1][4])
                        if len(rows) >= 5000 or held >= 16 << 20:
                            yield pack(rows)
                            rows, held = [], 0
                    if rows:
                        yield pack(rows)

    def pack(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows))
        names = ("doc_id", "start", "n_tokens", "ids_crc32")
        out = {n: pa.array(c, pa.int64()) for n, c in zip(names, columns)}
        return pa.RecordBatch.from_pydict(out | ({"ids": pa.array(columns[4], pa.binary())} if with_ids else {}))

    store, root = filesystem(path)
    with store.open_input_file(f"{root}/manifest.json") as source:
        files = [(f["name"], f["start"]) for f in json.loads(source.readall())]
    listed = spark.createDataFrame(files, "name string, start long").repartition(max(1, len(files)))
    return listed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)
