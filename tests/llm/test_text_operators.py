"""Packing, decontamination, sharding, near-duplicates and token files against plain versions."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
import xxhash
from helpers import SCHEMA, awkward_rows, made_text, near_copies, words13
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siftline.llm import decontaminate, packing, sharding, simhash, tokens
from siftline.llm.common import running_offsets, scratch
from siftline.llm.queries import tokenizer_path


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(awkward_rows() + near_copies(), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def plain_ids(tokenizer, text, end):
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [end]


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


@given(st.lists(st.lists(st.sampled_from([*"ab ,.\n\t\u00a0\u3000é日1'", "<|endoftext|>", " a", " b"]), max_size=30).map("".join), max_size=8))
@settings(max_examples=150, deadline=None)
def test_pieces_make_the_same_ids(texts):
    encoder = tokens.piece_encoder(tokenizer_path())
    expected = [np.array(encoder.tokenizer.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts]
    assert encoder.encode(texts) == expected


def test_long_texts_are_cut_without_a_trace(monkeypatch):
    import random

    monkeypatch.setattr(tokens, "SEGMENT", 40)
    monkeypatch.setattr(tokens, "BATCH", 100)
    encoder = tokens.PieceEncoder(tokenizer_path(), entries=5)
    texts = [made_text(random.Random(k), 60) + "  x \n y" for k in range(5)]
    expected = [np.array(encoder.tokenizer.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts]
    assert encoder.encode(texts) == expected


def check_packing(rows, capacity):
    by_sequence = collections.defaultdict(list)
    for r in rows:
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for placed in by_sequence.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_sequence)


@pytest.mark.parametrize("capacity", [16, 2048])
def test_packing(spark, docs, tokenizer, capacity):
    rows = packing.pack_documents(docs, tokenizer_path(), 0, capacity).collect()
    check_packing(rows, capacity)
    expected = collections.Counter()
    for r in docs.collect():
        ids = plain_ids(tokenizer, r["text"], 0)
        short = len(ids) % capacity or capacity
        cuts = [0, *range(short, len(ids) + 1, capacity)] if len(ids) > capacity else [0, len(ids)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            expected[(r["doc_id"], k, a, b - a, crc(ids[a:b]))] += 1
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == expected


def test_packing_of_nothing(empty):
    assert packing.pack_documents(empty, tokenizer_path()).collect() == []


@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), max_size=20))
@settings(max_examples=200, deadline=None)
def test_plan_uses_every_piece_once(counts):
    plan, used = packing.plan_packing(counts, 40), collections.Counter()
    for pattern, times in plan:
        assert sum(pattern) <= 40 and times > 0
        for length in pattern:
            used[length] += times
    assert used == collections.Counter(counts)


def test_plan_finds_exact_complements():
    plan = packing.plan_packing({30: 5, 10: 5, 20: 4, 7: 3, 13: 3}, 40)
    assert sum(n for _, n in plan) == 9  # 5 x (30, 10), 2 x (20, 20), and 60 left in 2
    assert packing.plan_packing({25: 1000}, 40) == [((25,), 1000)]


def plain_contamination(text, items, window=13):
    words, hit, found = words13(text), set(), set()
    for item, item_text in items:
        w = words13(item_text)
        n = min(window, len(w))
        patterns = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()
        for i in range(len(words) - n + 1) if w else ():
            if tuple(words[i : i + n]) in patterns:
                hit.update(range(i, i + n))
                found.add(str(item) if item is not None else "")
    digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
    return len(words), len(hit), len(found), digest, len(hit) > 0 and 20 * len(hit) >= len(words)


@pytest.mark.parametrize("block_words", [20_000_000, 60])
def test_decontamination(spark, docs, block_words):
    texts = [r["text"] for r in docs.collect()]
    items = [(1, texts[3]), (2, texts[-1][:200]), (10, "Thin,onent"), (11, "the"), (11, "wha ti"), (None, "blere blere"), (12, None), (13, "..."), (14, made_text(__import__("random").Random(9), 40))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    clash = docs.withColumns({"spans": F.lit("x"), "ITEMS": F.lit(1), "n_words": F.lit("y")})
    rows = decontaminate.verdicts(decontaminate.find_contamination(clash, bench, block_words=block_words, carry=True)).collect()
    got = collections.Counter((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in rows)
    assert got == collections.Counter((r["doc_id"], *plain_contamination(r["text"], items)) for r in docs.collect())


def test_decontamination_of_and_by_nothing(spark, docs, empty):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.find_contamination(empty, bench).count() == 0
    assert {r["contaminated"] for r in decontaminate.verdicts(decontaminate.find_contamination(docs, bench)).collect()} == {False}


def test_sharding(spark, docs, empty):
    clash = docs.withColumns({"Shard": F.lit(1), "slot": F.lit("a")})
    rows = sharding.shard_documents(clash, shards=7, least_buckets=5).collect()
    assert collections.Counter((r["doc_id"], r["text"]) for r in rows) == collections.Counter((r["doc_id"], r["text"]) for r in docs.collect())
    sizes = collections.Counter(r["shard"] for r in rows)
    assert set(sizes) == set(range(7)) and max(sizes.values()) - min(sizes.values()) <= 1
    for s in sizes:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sizes[s]))
    again = sharding.shard_documents(docs, shards=7, least_buckets=5).collect()
    key = lambda r: (r["position"], r["doc_id"] or -1, r["text"] or "")
    assert sorted(map(key, rows)) == sorted(map(key, again))
    assert sharding.shard_documents(empty).count() == 0


def test_shards_are_written_and_read(spark, docs):
    path = scratch(spark, "test-shards")
    sharding.write_shards(sharding.shard_documents(docs, shards=3), path)
    assert spark.read.parquet(path).groupBy("shard").count().count() == 3


def test_query_shards_every_column(spark, docs, tmp_path, monkeypatch):
    from siftline.llm import queries

    docs.write.parquet(str(tmp_path / "documents.parquet"))
    path = str(tmp_path / "shards")
    monkeypatch.setattr(queries, "scratch", lambda *_: path)
    found = queries.op6_sharding(spark, str(tmp_path))
    assert found.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"] and found.count() == docs.count()
    written = spark.read.parquet(path).select(*docs.columns)
    assert collections.Counter(map(tuple, written.collect())) == collections.Counter(map(tuple, docs.collect()))


def test_fisher_yates_is_uniform():
    seen = collections.Counter(tuple(sharding.fisher_yates(3, (1, k)).tolist()) for k in range(6000))
    assert len(seen) == 6 and all(800 < n < 1200 for n in seen.values())


def test_running_offsets(spark):
    counts = spark.createDataFrame([(k, k % 4 + 1) for k in range(50)], "k long, n long")
    rows = sorted(running_offsets(counts, "k", "n", "o", width=8).collect())
    assert [r["o"] for r in rows] == [sum(j % 4 + 1 for j in range(k)) for k in range(50)]


def plain_fingerprint(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_near_duplicates(docs, empty):
    rows = docs.collect()
    prints = [plain_fingerprint(r["text"]) for r in rows]
    group = list(range(len(rows)))

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                group[find(i)] = find(j)
    least = collections.defaultdict(list)
    for i, r in enumerate(rows):
        least[find(i)].append(r["doc_id"])
    expected = collections.Counter((r["doc_id"], f"{prints[i]:016x}", min((d for d in least[find(i)] if d is not None), default=None)) for i, r in enumerate(rows))
    got = simhash.near_duplicates(docs.withColumn("code", F.lit(1))).collect()
    assert collections.Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got) == expected
    assert simhash.near_duplicates(empty).count() == 0


def test_one_row_of_each_component_survives(spark, docs, empty):
    """Also where one id carries several texts, a third of all rows, and is the smallest of several components."""
    import random

    import corpus_pipeline

    rng = random.Random(21)
    a, b, c = (made_text(rng, 200) for _ in range(3))
    rows = [(7, a, "en", "s", 1), (7, b, "en", "s", 1), (3, b, "en", "s", 1), (9, a, "en", "s", 1), (8, c, "en", "s", 1), (8, c + " on", "en", "s", 1), (None, c, "en", "s", 1)]
    rows += [(2000, made_text(rng, 80), "en", "s", k) for k in range(60)]
    rows += [(None, made_text(rng, 80), "en", "s", k) for k in range(3)]
    whole = docs.unionByName(spark.createDataFrame(rows, SCHEMA))
    whole = whole.unionByName(whole.where("doc_id in (7, 2000)"))
    held = [tuple(r) for r in whole.collect()]
    prints = [plain_fingerprint(r[1]) for r in held]
    root = list(range(len(held)))
    for i in range(len(held)):
        for j in range(i):
            if root[i] != root[j] and (prints[i] ^ prints[j]).bit_count() <= 4:
                root = [root[j] if x == root[i] else x for x in root]
    order = lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or "")
    expected = sorted((min((r for r, x in zip(held, root) if x == g), key=order)[:2] for g in set(root)), key=order)
    found = corpus_pipeline.drop_near_duplicates(spark, whole, "")
    assert found.columns == whole.columns
    assert sorted((tuple(r)[:2] for r in found.collect()), key=order) == expected
    assert sum(r[0] == 2000 for r in expected) == 60 and {(7, a), (3, b)} <= set(expected) and (7, b) not in expected
    assert corpus_pipeline.drop_near_duplicates(spark, empty, "").count() == 0


@given(st.integers(0, 2**32), st.integers(1, 4))
@settings(max_examples=25, deadline=None)
def test_gray_index_links_what_all_pairs_link(seed, spread):
    rng = np.random.default_rng(seed)
    codes = []
    for b in rng.integers(0, 2**63, 6, dtype=np.uint64).tolist():
        for _ in range(15):
            codes.append(b)
            for k in rng.integers(0, 64, rng.integers(0, 2 * spread)).tolist():
                codes[-1] ^= 1 << k
    codes = np.unique(np.array(codes, dtype=np.uint64))
    masks = np.array(simhash.block_masks(), dtype=np.uint64)
    u, v = simhash.bucket_links(np.repeat(np.arange(len(masks)), len(codes)), np.tile(codes, len(masks)), masks, 4)

    def classes(pairs):
        group = {int(c): int(c) for c in codes}

        def find(x):
            while group[x] != x:
                x = group[x]
            return x

        for a, b in pairs:
            group[find(a)] = find(b)
        out = collections.defaultdict(set)
        for c in group:
            out[find(c)].add(c)
        return sorted(map(sorted, out.values()))

    every = [(int(a), int(b)) for i, a in enumerate(codes) for b in codes[:i] if int(a ^ b).bit_count() <= 4]
    assert classes(zip(u.tolist(), v.tolist())) == classes(every)


def test_token_files(spark, docs, empty, tokenizer):
    path = scratch(spark, "test-tokens")
    written = tokens.write_tokens(docs, path, tokenizer_path(), end_id=2)
    rows = sorted(tokens.read_tokens(spark, path, with_ids=True).collect(), key=lambda r: r["start"])
    order = sorted(docs.withColumn("h", F.xxhash64("text")).collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["h"]))
    start = 0
    for r, d in zip(rows, order, strict=True):
        ids = plain_ids(tokenizer, d["text"], 2)
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (d["doc_id"], start, len(ids), crc(ids))
        assert np.frombuffer(r["ids"], dtype="<u4").tolist() == ids
        start += len(ids)
    assert written["ids"] == start
    path = scratch(spark, "test-none")
    tokens.write_tokens(empty, path, tokenizer_path(), end_id=2)
    assert tokens.read_tokens(spark, path).count() == 0


def test_frames_can_be_read_apart_and_damage_is_noticed(monkeypatch):
    import io

    monkeypatch.setattr(tokens, "FRAME_IDS", 10)
    sink = io.BytesIO()
    writer = tokens.FrameWriter(sink)
    documents = [np.arange(k, k + n, dtype="<u4").tobytes() for k, n in enumerate((3, 25, 1, 0, 40))]
    for k, d in enumerate(documents):
        writer.add(k, d)
    writer.close()

    class Source(io.BytesIO):
        def size(self):
            return len(self.getbuffer())

    reader = tokens.FrameReader(Source(sink.getvalue()))
    assert [b"".join(c) for _, c in reader.documents()] == documents
    assert [b"".join(c) for _, c in reader.documents([4, 0])] == [documents[4], documents[0]]
    data = bytearray(sink.getvalue())
    data[8] ^= 0xFF
    with pytest.raises(Exception):
        list(tokens.FrameReader(Source(bytes(data))).documents([0]))


def test_sharding_as_two_plain_passes(spark):
    """Buckets by hash, offsets by their sizes, Fisher-Yates in each: the same places, by loops."""
    import random

    rng = random.Random(3)
    rows = [(k, made_text(rng, 5), "en", "s", 1) for k in range(400)]
    frame, seed, buckets = spark.createDataFrame(rows, SCHEMA), 20261, 16
    hashed = frame.select("doc_id", F.xxhash64(F.lit(seed), "doc_id", "text").alias("h")).collect()
    by_bucket = collections.defaultdict(list)
    for r in hashed:
        by_bucket[r["h"] % buckets].append((r["h"], r["doc_id"]))
    expected, offset = {}, 0
    for b in sorted(by_bucket):
        order = list(range(len(by_bucket[b])))
        draws = np.random.Generator(np.random.PCG64([seed, b]))
        for i, j in zip(range(len(order) - 1, 0, -1), draws.integers(0, np.arange(len(order), 1, -1)).tolist() if len(order) > 1 else []):
            order[i], order[j] = order[j], order[i]
        for (_, doc_id), place in zip(sorted(by_bucket[b]), order):
            expected[doc_id] = offset + place
        offset += len(order)
    got = sharding.shard_documents(frame, shards=7, least_buckets=buckets).collect()
    assert {r["doc_id"]: r["position"] for r in got} == expected


def test_many_equal_rows_are_spread_over_buckets(spark):
    rows = [(None, "same", "en", "s", 1)] * 3000 + [(k, f"t{k}", "en", "s", 1) for k in range(200)]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    keyed = frame.withColumn(sharding.TIE, F.xxhash64(F.lit(1), F.col("doc_id"), F.col("text")))
    salted = sharding._salted(keyed, 1, 100)
    assert salted.columns == keyed.columns and salted.select(sharding.TIE).distinct().count() == 3200
    got = sharding.shard_documents(frame, shards=5, least_buckets=50, hot_rows=100).collect()
    assert collections.Counter(tuple(r)[:5] for r in got) == collections.Counter(rows)
    assert sorted(r["position"] for r in got) == list(range(3200))


def test_pattern_tables_are_built_once(spark):
    bench = spark.createDataFrame([(k, made_text(__import__("random").Random(k), 30)) for k in range(6)], "item_id long, text string")
    paths = decontaminate._written_blocks(bench, 13, 500, "item_id", "text")
    assert len(paths) > 1
    decontaminate.patterns_at.cache_clear()
    for path in paths:
        for _ in range(5):
            decontaminate.patterns_at(path)
    assert decontaminate.patterns_at.cache_info().misses == len(paths) and decontaminate.patterns_at.cache_info().currsize == 1


def test_blocks_kept_grow_with_the_fingerprints():
    for n in (1, 10**6, 10**8, 10**9, 10**10, 10**11, 10**12):
        kept = simhash.kept_blocks(n)
        assert n / 2 ** (64 * kept // (4 + kept)) <= 64
    assert simhash.kept_blocks(10**7) == 2 and simhash.kept_blocks(10**11) == 4


def classes(codes, links):
    root = {c: c for c in codes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        root[find(a)] = find(b)
    out = collections.defaultdict(set)
    for c in codes:
        out[find(c)].add(c)
    return sorted(map(sorted, out.values()))


@pytest.mark.parametrize("kept", [2, 3])
def test_large_buckets_are_dealt_to_several_tasks(spark, kept):
    """Many near copies of one text, and some codes apart, with buckets large from 16 codes on."""
    rng = np.random.default_rng(4)
    centre, codes = 0x0123456789ABCDEF, set(rng.integers(0, 2**63, 60).tolist())
    for _ in range(500):
        flips = rng.choice(64, rng.integers(0, 9), replace=False).tolist()
        codes.add(int(centre ^ sum(1 << b for b in flips)))
    signed = lambda c: c - 2**64 if c >= 2**63 else c
    frame = spark.createDataFrame([(signed(c),) for c in codes], "code long")
    masks = [signed(m) for m in simhash.block_masks(4, kept)]
    placed = frame.select(F.posexplode(F.array(*[F.lit(m) for m in masks])).alias("choice", "mask"), "code").select("choice", F.col("code").bitwiseAND(F.col("mask")).alias("key"), "code")
    dealt = simhash._dealt(placed, 2, 16)
    assert dealt.select("choice", "key", "pair").distinct().groupBy("choice", "key").count().where("count > 2").count() > 0
    links = [(r["u"] % 2**64, r["v"] % 2**64) for r in simhash.near_links(frame, kept=kept, sampled=2, group_size=16).collect()]
    every = [(a, b) for a in codes for b in codes if a < b and (a ^ b).bit_count() <= 4]
    assert classes(codes, links) == classes(codes, every)


def test_token_files_of_failed_attempts_are_not_read(spark, tokenizer):
    """One id with most rows lies in several files; a stray file goes."""
    import os

    rows = [(None, "same text", "en", "s", 1)] * 200 + [(k, f"text {k}", "en", "s", 1) for k in range(10)]
    path = scratch(spark, "test-attempts")
    os.makedirs(path)
    open(f"{path}/part-000000-99.zids", "wb").write(b"cut")
    written = tokens.write_tokens(spark.createDataFrame(rows, SCHEMA).repartition(4), path, tokenizer_path(), 2, task_bytes=100)
    assert sorted(f["name"] for f in written["files"]) == sorted(x for x in os.listdir(path) if x.endswith(".zids")) and len(written["files"]) > 2
    got = sorted(tokens.read_tokens(spark, path).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [None] * 200 + list(range(10))
    assert [r["start"] for r in got] == np.cumsum([0, *[r["n_tokens"] for r in got]])[:-1].tolist()


def test_work_grows_with_the_fingerprints():
    """Ten times the codes, unlike ones and near copies, with buckets as they would be: at most twelve times the pairs compared and rows placed."""
    rng = np.random.default_rng(9)

    def work(n):
        copies = rng.integers(0, 2**63, n // 4, dtype=np.uint64)
        near = copies ^ (np.uint64(1) << rng.integers(0, 64, n // 4).astype(np.uint64))
        codes = np.unique(np.concatenate([rng.integers(0, 2**63, n // 2, dtype=np.uint64), copies, near]))
        masks = np.array(simhash.block_masks(4, simhash.kept_blocks(n)), dtype=np.uint64)
        index, _ = simhash.bucket_index(np.repeat(np.arange(len(masks)), len(codes)), np.tile(codes, len(masks)), masks, 4)
        index.search()
        return index.compared + len(masks) * len(codes)

    assert work(60_000) <= 12 * work(6_000)


def test_scratch_is_removed(spark):
    import os

    from siftline.llm.common import remove_scratch

    path = scratch(spark, "gone")
    spark.range(3).write.parquet(path)
    remove_scratch()
    assert not os.path.exists(path)
    remove_scratch()
