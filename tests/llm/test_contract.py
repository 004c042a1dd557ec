"""All queries of the package on one small set of tables, held against plain versions of their contracts."""

import collections
import random
import zlib

import duckdb
import numpy as np
import pytest
from helpers import SCHEMA, awkward_rows, made_text, near_copies
from pages_by_hand import PAGES
from pyspark.sql import functions as F
from test_models_and_rules import LANGUAGES, plain_statistics, spoken
from test_text_operators import check_packing, crc, plain_contamination, plain_fingerprint, plain_ids

from siftline.llm import html_extract, langid, quality, queries, toxicity


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    root, rng = tmp_path_factory.mktemp("tables"), random.Random(31)
    rows = [(2000 + i, text, lang, "s", 1) for i, text, lang, *_ in spoken(500)] + awkward_rows() + near_copies()
    toxic = {2000 + i for i in range(0, 500, 6)}
    rows = [(i, t + " slurry vilest" if i in toxic else t, g, s, n) for i, t, g, s, n in rows]
    labels = [(2000 + i, int(i % 9 != 0), int(2000 + i in toxic)) for i in range(500)]
    bench = [(1, rows[3][1]), (2, made_text(rng, 40)), (None, "blere blere"), (4, None)]
    turns = [(k, j, "user" if j % 2 == 0 else "assistant", f"turn {k % 7} {j}") for k in range(30) for j in range(k % 5 + 1)] + [(None, 0, "user", "alone")] * 3
    pages = [(k, f"http://{k}", html) for k, (html, _) in enumerate(PAGES.values())] + [(None, None, None), (99, "u", "")]
    tables = {
        "documents": (rows, SCHEMA), "labels": (labels, "doc_id long, quality int, toxic int"), "benchmark": (bench, "item_id long, text string"),
        "conversations": (turns, "conv_id long, turn long, role string, text string"), "pages": (pages, "page_id long, url string, html string"),
    }
    for name, (data, schema) in tables.items():
        spark.createDataFrame(data, schema).write.parquet(f"{root}/{name}.parquet")
    return str(root)


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]


def learned(i):
    return i is not None and zlib.crc32(str(i).encode()) % 5 != 0


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, sf_dir, name):
    connection = duckdb.connect()
    for table in ("documents", "benchmark", "conversations"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet/*.parquet'")
    found = queries.QUERIES[name](spark, sf_dir)
    columns = sorted(found.columns)
    got = [tuple(map(str, r)) for r in found.select(*columns).collect()]
    expected = [tuple(map(str, r)) for r in connection.execute(f"SELECT {', '.join(columns)} FROM ({queries.ORACLE_SQL[name]})").fetchall()]
    assert sorted(got) == sorted(expected)


def test_packing(spark, sf_dir, docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    rows = queries.op2_best_fit_packing(spark, sf_dir).collect()
    sequences = check_packing(rows, 2048)
    lengths = [len(plain_ids(tokenizer, t, 0)) for _, t, *_ in docs]
    assert sequences <= -(-sum(lengths) // 2048) + 2 and sum(r["length"] for r in rows) == sum(lengths)
    whole = collections.Counter((i, crc(plain_ids(tokenizer, t, 0))) for (i, t, *_), n in zip(docs, lengths) if n <= 2048)
    by_start = [r for r in rows if r["start"] == 0]
    assert len(by_start) == len(docs) and not whole - collections.Counter((r["doc_id"], r["ids_crc32"]) for r in rows)


def test_decontamination(spark, sf_dir, docs):
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    rows = queries.op3_decontamination(spark, sf_dir).collect()
    expected = collections.Counter((i, *plain_contamination(t, items)) for i, t, *_ in docs)
    assert collections.Counter((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in rows) == expected


def plain_language(model, text):
    """Loss-weighted decoding of the bits' classifiers, a loop over languages and bits."""
    if text is None or not any(map(str.isalpha, text)):
        return "und", 0.0
    x = langid.profile(text).astype(np.float64)
    losses = []
    for code in model.codes:
        margin = [float(x @ model.weights[:-1, b] + model.weights[-1, b]) for b in range(len(code))]
        losses.append(sum(float(w) * np.log1p(np.exp(-m * c)) for m, c, w in zip(margin, code.tolist(), model.trust)))
    best = int(np.argmin(losses))
    return model.languages[best], 1 / sum(np.exp(losses[best] - v) for v in losses)


def test_language_id(spark, sf_dir, docs):
    model = langid.fit(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    rows = queries.op4_language_id(spark, sf_dir).collect()
    assert collections.Counter((r["doc_id"], r["held_out"]) for r in rows) == collections.Counter((i, i is not None and not learned(i)) for i, *_ in docs)
    expected = collections.defaultdict(list)
    for i, t, *_ in docs:
        expected[i].append(plain_language(model, t))
    for r in rows:
        assert any(g == r["lang_pred"] and abs(s - r["score"]) < 1e-3 for g, s in expected[r["doc_id"]])
    assert set(model.languages) == {g for i, t, g, *_ in docs if learned(i) and g and t}
    truth = {i: g for i, _, g, *_ in docs if i is not None and 2000 <= i < 2500}
    held = [r for r in rows if r["doc_id"] in truth and r["held_out"]]
    assert len(held) > 50 and sum(truth[r["doc_id"]] == r["lang_pred"] for r in held) >= 0.97 * len(held)


def plain_logit(model, text):
    """The network as loops: words, embeddings, filters of several widths over blank-padded words, the largest response, the output."""
    rows, _ = toxicity.word_rows([text])
    words = [sum(model.embedding[r].astype(np.float64) for r in row) for row in rows.tolist()] + [np.zeros(toxicity.DIMS)] * (max(toxicity.WIDTHS) - 1)
    part, total, out = 0, model.bias, 0
    for width in toxicity.WIDTHS:
        for f in range(toxicity.FILTERS):
            best = max((sum(float(words[at + k] @ model.filters[:, part + k, f]) for k in range(width)) for at in range(len(words) - width + 1)), default=0.0) if len(rows) else -np.inf
            total += max(0.0, best + model.biases[out]) * model.output[out]
            out += 1
        part += width
    return total


def test_toxicity(spark, sf_dir, docs):
    frame, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(frame, labels, langid.fit(frame))
    rows = queries.op5_toxicity(spark, sf_dir).collect()
    assert collections.Counter((r["doc_id"], r["held_out"]) for r in rows) == collections.Counter((i, i is not None and not learned(i)) for i, *_ in docs)
    expected = collections.defaultdict(list)
    for i, t, *_ in docs:
        if len(t or "") < 3000:
            limit = model.thresholds.get(langid.guess(model.language, [t])[0][0], model.thresholds[""])
            score = 1 / (1 + np.exp(-(plain_logit(model, t) - limit)))
            expected[i].append(score if (t or "").strip() else min(score, 0.49))
    for r in rows:
        assert r["predicted"] == int(r["score"] >= 0.5)
        assert r["doc_id"] not in expected or any(abs(s - r["score"]) < 2e-3 for s in expected[r["doc_id"]]) or len(expected[r["doc_id"]]) > 3
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    held = [r for r in rows if r["doc_id"] in truth and r["held_out"]]
    assert len(held) > 50 and sum(truth[r["doc_id"]] == r["predicted"] for r in held) >= 0.95 * len(held)


def test_sharding(spark, sf_dir, docs):
    rows = queries.op6_sharding(spark, sf_dir).collect()
    octets = lambda t: (t or "").encode()
    assert collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == collections.Counter((i, len(octets(t)) + 16, zlib.crc32(octets(t))) for i, t, *_ in docs)
    sizes = collections.Counter(r["shard"] for r in rows)
    assert set(sizes) == set(range(40)) and max(sizes.values()) - min(sizes.values()) <= 1
    assert all(sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(n)) for s, n in sizes.items())
    assert {(r["law"], r["grown_shard"]) for r in rows} == {("rows", None)}


def test_near_duplicates(spark, sf_dir, docs):
    rows = queries.op7_simhash(spark, sf_dir).collect()
    assert collections.Counter((r["doc_id"], r["fingerprint"]) for r in rows) == collections.Counter((i, f"{plain_fingerprint(t):016x}") for i, t, *_ in docs)
    component = {r["fingerprint"]: r["component_id"] for r in rows}
    prints = sorted(component)
    for a in prints:
        for b in prints:
            assert (int(a, 16) ^ int(b, 16)).bit_count() > 4 or component[a] == component[b]


def test_token_output(spark, sf_dir, docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    rows = sorted(queries.op8_token_output(spark, sf_dir).collect(), key=lambda r: r["start"])
    expected = collections.Counter((i, len(ids := plain_ids(tokenizer, t, 2)), crc(ids)) for i, t, *_ in docs)
    assert collections.Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in rows) == expected
    at = 0
    for r in rows:
        assert r["start"] == at
        at += r["n_tokens"]
    ids = [r["doc_id"] for r in rows if r["doc_id"] is not None]
    assert ids == sorted(ids)


def test_html_extraction(spark, sf_dir):
    rows = queries.op9_html_extraction(spark, sf_dir).collect()
    expected = {k: "\n".join(t) for k, (_, t) in enumerate(PAGES.values())} | {None: "", 99: ""}
    assert {r["page_id"]: r["text"] for r in rows} == expected and len(rows) == len(expected)
    assert all(r["n_chars"] == len(r["text"]) and r["url"] == (None if r["page_id"] is None else "u" if r["page_id"] == 99 else f"http://{r['page_id']}") for r in rows)


def test_weights_are_written_once(spark, monkeypatch):
    first = html_extract.stored_model(spark)
    monkeypatch.setattr(html_extract, "fitted", lambda *_: 1 / 0)
    again = html_extract.stored_model(spark)
    assert again.vocabulary == first.vocabulary and (again.weights == first.weights).all() and (again.edges == first.edges).all()


def plain_rules(rows, precision=0.9, least=3):
    """Sequential covering by loops over all conditions of all features."""
    names = list(quality.FEATURES)
    held = lambda c, r: r[0][c[0]] > c[2] if c[1] else r[0][c[0]] <= c[2]
    covered = lambda rule, rs: [r for r in rs if all(held(c, r) for c in rule)]
    grow, prune, rules = [r for k, r in enumerate(rows) if k % 3], rows[::3], []

    def worth(rule, rs):
        hit = covered(rule, rs)
        return (sum(r[1] for r in hit) + 1) / (len(hit) + 2), len(hit)

    while any(r[1] for r in grow):
        rule, inside = [], grow
        while any(r[1] for r in inside) and not all(r[1] for r in inside):
            before, best = np.log2(sum(r[1] for r in inside) / len(inside)), (1e-9, None)
            for name in names:
                values = sorted({r[0][name] for r in inside})
                for above in (False, True):
                    for a, b in zip(values, values[1:]):
                        hit = covered([(name, above, (a + b) / 2)], inside)
                        p = sum(r[1] for r in hit)
                        gain = p * (np.log2(p / len(hit)) - before) if p else 0.0
                        best = (gain, (name, above, (a + b) / 2)) if gain > best[0] + 1e-9 else best
            if best[1] is None:
                break
            rule.append(best[1])
            inside = covered([best[1]], inside)
        if not rule:
            break
        rule = max((rule[: k + 1] for k in range(len(rule))), key=lambda r: (worth(r, prune)[0], -len(r)))
        good, n = worth(rule, prune)
        if not (good >= precision * (n + 1) / (n + 2) and n >= least and worth(rule, grow)[0] >= precision):
            break
        rules.append(rule)
        grow, prune = ([r for r in part if r not in covered(rule, part)] for part in (grow, prune))
    return rules


@pytest.mark.parametrize("seed", range(3))
def test_rule_learner(seed):
    rng = random.Random(seed)
    a, b, c = list(quality.FEATURES)[:3]
    made = [dict.fromkeys(quality.FEATURES, 0.0) | {a: float(k), b: float(rng.randint(0, 9)), c: float(rng.randint(0, 5))} for k in rng.sample(range(900), 300)]
    rows = [(f, f[c] > 3 or (f[b] < 3 and f[a] > 300)) for f in made]
    got = quality.learn_rules(rows)
    judged = lambda f: any(all(f[c.feature] > c.threshold if c.above else f[c.feature] <= c.threshold for c in rule) for rule in got)
    plain = plain_rules(rows)
    expected = lambda f: any(all(f[n] > t if a else f[n] <= t for n, a, t in rule) for rule in plain)
    assert got and all(judged(f) == expected(f) for f, _ in rows)


def test_quality_rules(spark, sf_dir, docs):
    rows = queries.op10_quality_rules(spark, sf_dir).collect()
    assert collections.Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in rows) == collections.Counter((i, *plain_statistics(t)) for i, t, *_ in docs)
    for r in rows:
        assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])


def test_languages_of_the_tables():
    assert set(LANGUAGES) <= {g for _, _, g, *_ in spoken(500)}


def test_samples_are_bounded_where_ids_repeat(spark):
    """An id with many rows, alike and not, in fitting."""
    rng = random.Random(5)
    rows = [(7, made_text(rng, 30), "en", "s", 1) for _ in range(300)] + [(7, "same text here", "en", "s", 1)] * 300 + [(1, "le que eau la", "fr", "s", 1), (3, "le que ment", "fr", "s", 1)]
    frame = spark.createDataFrame(rows, SCHEMA)
    taken = []
    original = langid.train
    try:
        langid.train = lambda x, names: taken.append(collections.Counter(names)) or original(x, names)
        langid.fit(frame, per_language=50)
        langid.fit(frame, per_language=50, fit_rows=4)
    finally:
        langid.train = original
    assert taken[0]["en"] <= 50 and 20 < taken[0]["en"] and taken[1]["en"] <= 2 and set(taken[0]) == {"en", "fr"}
    labels = spark.createDataFrame([(7, 0, 1), (1, 1, 0), (3, 1, 0)], "doc_id long, quality int, toxic int")
    original = toxicity.train
    try:
        toxicity.train = lambda texts, y: taken.append((len(texts), max(map(len, texts)))) or original(texts, y)
        toxicity.fit(frame, labels, langid.fit(frame), per_class=40, fit_words=5)
    finally:
        toxicity.train = original
    assert taken[2][0] <= 42 and taken[2][1] <= 5
    assert isinstance(quality.fit(frame, labels, fit_rows=20), list)


def test_many_languages_are_learned(spark):
    rows = [(k, f"w{k % 310} x{k % 310} y{k % 310} zz", f"l{k % 310}", "s", 1) for k in range(1240)]
    model = langid.fit(spark.createDataFrame(rows, SCHEMA), fit_rows=700)
    assert len(model.languages) > 300


def test_shared_folder_is_required_on_a_cluster():
    from types import SimpleNamespace

    from siftline.llm import common
    from siftline.operators import cluster

    context = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)
    session = SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda *_: None))
    for ask in (common.shared_dir, cluster.ensure_checkpoint_dir):
        with pytest.raises(ValueError):
            ask(session)


def test_columns_with_clashing_names(spark, sf_dir):
    from siftline.llm import packing, tokens
    from siftline.llm.common import scratch

    frame = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(20).withColumns({c: F.lit("x") for c in ("piece", "START", "length", "i", "t", "p", "sequence_id")})
    assert packing.pack_documents(frame, queries.tokenizer_path()).select("doc_id", "piece", "start").count() >= 20
    path = scratch(spark, "clash")
    assert sum(f["docs"] for f in tokens.write_tokens(frame, path, queries.tokenizer_path(), 2)["files"]) == 20
