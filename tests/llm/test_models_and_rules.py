"""Chat formatting, quality rules, classifiers, HTML extraction and the pipeline."""

import collections
import random
import re
import zlib

import numpy as np
import pytest
from helpers import SCHEMA, awkward_rows, made_text
from pyspark.sql import functions as F

from siftline.llm import chat, common, html_extract, langid, quality, toxicity
from siftline.llm.pagegen import PageMaker

TURNS = "conv_id long, turn long, role string, text string"


def shown(turns):
    ordered = sorted(turns, key=lambda t: (t[1] is not None, t[1] or 0))
    return ["<|" + (r or "") + "|>\n" + (t or "") + "<|end|>\n" for _, _, r, t in ordered]


def test_chats_keep_maximal_conversations(spark):
    rng, rows = random.Random(4), []
    base = [[("user" if k % 2 == 0 else "assistant", made_text(rng, 5)) for k in range(rng.randint(1, 7))] for _ in range(12)]
    base.append([("user", "same first")])
    conv = 0
    for turns in base:
        for n in {len(turns), rng.randint(1, len(turns)), 1}:
            for _ in range(rng.randint(1, 3)):
                rows += [(conv, k, r, t) for k, (r, t) in enumerate(turns[:n])]
                conv += 1
    rows += [(conv, 0, None, None), (conv + 1, 0, "", ""), (conv + 2, None, "user", "x"), (conv + 2, 5, None, "y"), (conv + 3, 0, "user", "very long " * 50_000)]
    rows += [(None, 0, "user", "nobody"), (None, 1, "user", "asks"), (None, 7, "user", "nobody"), (None, 0, *base[0][0]), (None, None, "user", "same first")] + [(None, 0, None, "")] * 300
    table = spark.createDataFrame(rows, TURNS).repartition(3)
    by_conv = collections.defaultdict(list)
    for n, r in enumerate(rows):
        by_conv[r[0] if r[0] is not None else ("alone", n)].append(r)
    texts = {c: shown(t) for c, t in by_conv.items()}
    proper = {tuple(t[:k]) for t in texts.values() for k in range(1, len(t))}
    kept = collections.defaultdict(list)
    for c, t in texts.items():
        if tuple(t) not in proper:
            kept[tuple(t)].append(c if isinstance(c, int) else None)
    expected = {(min((c for c in cs if c is not None), default=None), len(t), len(cs), len("".join(t)), "".join(t)) for t, cs in kept.items()}
    got = chat.format_chats(table.withColumn("copies", F.lit(1))).collect()
    assert {tuple(r) for r in got} == expected and len(got) == len(expected)
    assert chat.format_chats(spark.createDataFrame([], TURNS)).count() == 0
    named = chat.format_chats(table.withColumn("conv_id", F.concat(F.lit("c"), F.col("conv_id"))))
    assert named.schema["conv_id"].dataType.simpleString() == "string" and named.count() == len(expected)


def plain_statistics(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = collections.defaultdict(list)
    for i in range(len(words) - 4):
        windows[tuple(words[i : i + 5])].append(i)
    covered = {p for at in windows.values() if len(at) > 1 for i in at for p in range(i, i + 5)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)


def quality_rows():
    rows = awkward_rows()
    rows += [(200, "a b c d e " * 6, "en", "s", 1), (201, "x\ny\nx\n \n \nx", "en", "s", 1), (202, "one two three four five six seven eight nine ten one two three four five", "en", "s", 1), (203, " a b # *", "en", "s", 1)]
    return rows


def test_quality_statistics(spark):
    docs = spark.createDataFrame(quality_rows(), SCHEMA).withColumn("n_words", F.lit("clash"))
    got = collections.Counter(tuple(r)[:6] for r in quality.text_statistics(docs).collect())
    assert got == collections.Counter((r[0], *plain_statistics(r[1])) for r in quality_rows())


def test_quality_rules_are_learned(spark):
    rng = random.Random(8)
    rows, marks = [], []
    for k in range(900):
        bad = k % 5 == 0
        words = made_text(rng, 40, "alpha beta gamma delta epsilon zeta theta kappa lambda sigma omega tau rho").split()
        rows.append((k, " ".join(w + "###" if bad else w for w in words), "en", "s", 1))
        marks.append((k, 0 if bad else 1, 0))
    docs, labels = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    rules = quality.fit(docs, labels)
    assert rules
    kept = {r["doc_id"]: r["kept"] for r in quality.judge(docs, rules).collect()}
    assert all(kept[k] == bool(q) for k, q, _ in marks)
    assert quality.fit(docs, labels.limit(0)) == []
    none = quality.judge(spark.createDataFrame(quality_rows(), SCHEMA), [])
    for r in none.collect():
        assert r["kept"] == (not r["base_failed"]) and r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"])


def test_quality_rules_separate_small_tails_and_many_groups():
    """The top 1/200 of one feature by one condition, and more than 24 rules."""
    plain = dict.fromkeys(quality.FEATURES, 0.0)
    tail = [(plain | {"n_words": float(k)}, k >= 5970) for k in range(6000)]
    ((only,),) = quality.learn_rules(tail)
    assert only.above and 5969 <= only.threshold < 5971
    groups = [(plain | {"n_words": float(k)}, k // 60 % 2 == 1) for k in range(3600)]
    rules = quality.learn_rules(groups)
    assert len(rules) > 24


LANGUAGES = {"en": "the of and thing ering ation wh", "de": "der und sch ung keit ein ü", "fr": "le que eau ée ment è oi", "es": "la ción que os ñ ado ó"}


def spoken(n=400):
    rng = random.Random(6)
    names = list(LANGUAGES)
    return [(k, made_text(rng, rng.randint(5, 80), LANGUAGES[names[k % 4]]), names[k % 4], "s", 1) for k in range(n)]


def test_codewords_differ():
    for k in (1, 2, 3, 4, 5, 9):
        code = langid.codewords(k)
        assert len({tuple(r) for r in code.tolist()}) == k
        if k > 2:
            assert min((a != b).sum() for i, a in enumerate(code) for b in code[:i]) >= 2


def test_language_id(spark):
    rows = spoken()
    docs = spark.createDataFrame(rows, SCHEMA)
    model = langid.fit(docs)
    assert model.languages == sorted(LANGUAGES)
    odd = spark.createDataFrame(awkward_rows(), SCHEMA).withColumn("SCORE", F.lit("clash"))
    found = langid.identify(docs.unionByName(odd, allowMissingColumns=True), model, carry=True).collect()
    held = [r for r in found if r["lang_pred"] != "und" and r["doc_id"] is not None and r["doc_id"] < 400 and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 and r["lang"] in LANGUAGES and r["source"] == "s"]
    assert len(held) > 40 and sum(r["lang_pred"] == r["lang"] for r in held) >= 0.98 * len(held)
    for r in found:
        assert 0 <= r["score"] <= 1
        assert (r["lang_pred"] == "und") == (not any(map(str.isalpha, r["text"] or "")))
    nobody = langid.fit(docs.limit(0))
    assert {r["lang_pred"] for r in langid.identify(docs, nobody).collect()} == {"und"}
    assert langid.identify(docs.limit(0), model).count() == 0


def test_samples_of_huge_tables_are_not_empty(spark):
    """The share of a sample, exactly, also above a thousand million rows; and that the hash follows it."""
    for most, n in ((800, 10**9), (3000, 10**10), (12_000, 10**11), (800, 799_999_999), (5, 8), (9, 3)):
        assert common.last_place(most, n) + 1 == min(2**63, most * 2**63 // n) > 0
    ids = spark.range(200_000).withColumn("p", common.sample_place(F.col("id")))
    assert ids.where(F.col("p") <= common.last_place(9, 3)).count() == 200_000
    assert 1800 < ids.where(F.col("p") <= common.last_place(2000, 200_000)).count() < 2200


def test_profile_does_not_depend_on_slices(monkeypatch):
    text = made_text(random.Random(3), 300)
    whole = langid.profile(text)
    monkeypatch.setattr(langid, "SLICE", 64)
    assert np.allclose(whole, langid.profile(text), atol=0.02)


def test_word_rows_are_those_of_each_text():
    texts = ["one two", "", None, "  Three,four ", "ééé longerword longerwords", "..."]
    rows, counts = toxicity.word_rows(texts)
    assert counts.tolist() == [2, 0, 0, 2, 3, 0]
    alone = np.concatenate([toxicity.word_rows([t])[0] for t in texts])
    assert (rows == alone).all()
    assert (rows[5][1:] == rows[6][1:]).all() and rows[5][0] != rows[6][0]


def test_long_texts_are_pooled_alike(monkeypatch):
    rng = np.random.default_rng(0)
    model = toxicity._start([rng.integers(0, 99, (9, 3)) for _ in range(4)], np.array([0, 1, 0, 1]), rng)
    rows, counts = rng.integers(0, toxicity.ROWS, (500, 3)), np.array([0, 200, 1, 299])
    whole = model.logits(model.table(), rows, counts)
    monkeypatch.setattr(toxicity, "RUN", 7)
    assert np.allclose(whole, model.logits(model.table(), rows, counts), atol=1e-4)


def test_toxicity(spark):
    rng = random.Random(7)
    rows, marks = [], []
    for k, (i, text, lang, *_) in enumerate(spoken(800)):
        toxic = k % 4 == (k // 4) % 4
        words = text.split()
        if toxic:
            words.insert(rng.randint(0, len(words)), rng.choice(("slurry", "slurrous", "vilest")))
        rows.append((i, " ".join(words), lang, "s", 1))
        marks.append((i, 1, int(toxic)))
    docs, labels = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    language = langid.fit(docs)
    model = toxicity.fit(docs, labels, language)
    truth = {i: y for i, _, y in marks}
    found = toxicity.score(docs, model).collect()
    held = [r for r in found if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) >= 0.95 * len(held)
    odd = toxicity.score(spark.createDataFrame(awkward_rows(), SCHEMA).withColumn("Predicted", F.lit(9)), model, carry=True).collect()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in odd) and len(odd) == len(awkward_rows())
    assert {r["predicted"] for r in odd if not (r["text"] or "").strip()} == {0}
    unlabelled = toxicity.fit(docs, labels.limit(0), language)
    assert {r["predicted"] for r in toxicity.score(docs, unlabelled).collect()} == {0}
    assert toxicity.score(docs.limit(0), model).count() == 0


@pytest.fixture(scope="module")
def tree_model():
    return html_extract.fitted()


def test_html_of_made_pages(tree_model):
    right = 0
    for k in range(150):
        page, labels, blocks = html_extract.labelled_page(77_000_000 + k)
        html = "".join(r[0] for r in PageMaker(77_000_000 + k).runs())
        right += html_extract.main_texts(tree_model, [html])[0] == "\n".join(blocks)
    assert right >= 130


def test_html_of_pages_by_hand(tree_model):
    from pages_by_hand import PAGES

    for name, (html, text) in PAGES.items():
        assert html_extract.main_texts(tree_model, [html]) == ["\n".join(text)], name
    long = "<html><body><nav><a href=/>Home</a></nav><article>" + "".join(f"<p>Paragraph {k} of a long page.</p>" for k in range(20_000)) + "</article><footer>End</footer></body></html>"
    assert html_extract.main_texts(tree_model, [long])[0].split("\n") == [f"Paragraph {k} of a long page." for k in range(20_000)]


def test_messages_give_exact_marginals(tree_model):
    """Against a sum over all labellings of a small page."""
    html = "<body><nav><a href=x>Go</a></nav><article><h1>A</h1><p>Text here.</p></article></body>"
    page = html_extract.Page(html)
    forest = html_extract.Forest([page], tree_model.vocabulary)
    got, pairs = tree_model.infer(forest)
    n = len(page.parent)
    own = np.bincount(forest.node_of, weights=tree_model.weights[forest.feature_of], minlength=n)
    weights = np.zeros(2**n)
    for s in range(2**n):
        y = [s >> k & 1 for k in range(n)]
        weights[s] = sum(own[k] * y[k] + (tree_model.edges[forest.kind[k], y[page.parent[k]], y[k]] if page.parent[k] >= 0 else 0) for k in range(n))
    p = np.exp(weights - weights.max())
    p /= p.sum()
    assert np.allclose(got, [sum(p[s] for s in range(2**n) if s >> k & 1) for k in range(n)])
    assert np.allclose(pairs[forest.parent >= 0].sum(axis=(1, 2)), 1)


def test_html_cases(spark, tree_model):
    main = lambda x: html_extract.main_texts(tree_model, [x])[0]
    page = '<html><head><title>T</title><script>var a="<p>no</p>";</script></head><body><nav><ul><li><a href="/a">Home</a></li></ul></nav><div class="ad">Buy this now.</div><article><h1>The  title</h1><p><b>First &amp; second&nbsp;part<br>of it.<p>Next &lt;one&gt; here.</p><!-- <p>gone</p> --></article><div id="comments"><div class="comment"><p>A reader says.</p></div></div><footer>&copy; us</footer>'
    assert main(page) == "The title\nFirst & second part of it.\nNext <one> here."
    assert [main(x) for x in (None, "", "   ", "<", "<p", "<!-- open", "<script>never")] == [""] * 7
    assert main("<article><p>Text that is cut &am") == "Text that is cut &am"
    assert main('<article><p title="a>b" class=\'x\'>Quoted.</p><p id="open>Rest of it.</p></article>').startswith("Quoted.")
    deep = "<div>" * 3000 + "<article><p>Deep text is here.</p></article>"
    assert isinstance(main(deep), str)
    pages = spark.createDataFrame([(1, "u", page), (1, "u", page), (None, None, None), (2, "v", "")], "page_id long, url string, html string").withColumn("text", F.lit(1))
    got = html_extract.extract(pages, tree_model).collect()
    assert sorted((r["page_id"] or 0, r["text"]) for r in got) == sorted([(1, main(page)), (1, main(page)), (0, ""), (2, "")])
    assert html_extract.extract(pages.limit(0), tree_model).count() == 0


def test_pipeline(spark, tmp_path):
    """Each stage against its own rule, on a small corpus with planted cases."""
    import corpus_pipeline

    rng = random.Random(12)
    rows, marks = [], []
    for i, text, lang, *_ in spoken(600):
        text = " ".join([text, made_text(rng, 60, LANGUAGES[lang])])
        toxic = i % 7 == 3
        rows.append((i, text + (" slurry vilest slurry" if toxic else ""), lang, "s", 1))
        marks.append((i, 1, int(toxic)))
    long = made_text(rng, 3000, LANGUAGES["en"])
    passage = made_text(rng, 30, "benchmark passage words never seen elsewhere at all")
    rows += [(700, rows[0][1], "en", "s", 1), (701, None, None, None, None), (702, "123 456", None, "s", 1), (703, rows[1][1] + " " + passage, "de", "s", 1), (None, rows[2][1], "fr", "s", 1), (5, rows[5][1], "de", "s", 1), (704, long, "en", "s", 1)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k < 4:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept.append([r["doc_id"] for r in docs.collect()])
    assert not {701, 702} & set(kept[0]) and len(kept[0]) == len(rows) - 2
    wrong = [i for i, _, y in marks if (i in kept[1]) == bool(y)]
    assert len(wrong) <= 12
    assert kept[2].count(5) == (5 in kept[1]) and 700 not in kept[2] and None not in kept[2]
    assert 703 in kept[2] and 703 not in kept[3] and len(kept[3]) == len(kept[2]) - 1
    assert set(kept[4]) == set(kept[3])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(kept[4])


def test_pipeline_of_nothing_and_of_clashing_columns(spark, tmp_path):
    """An empty table; null ids, an id on unlike texts, and columns that bear operators' names."""
    import corpus_pipeline

    rng = random.Random(14)
    known = [(i, text, lang, "s", 1) for i, text, lang, *_ in spoken(300)]
    spark.createDataFrame([(i, 1, int(i % 9 == 0)) for i in range(300)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "never found words")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    texts = [made_text(rng, 120, LANGUAGES["en"]) for _ in range(6)]
    rows = [(9000, texts[0]), (9000, texts[1]), (9000, texts[1]), (None, texts[2]), (None, texts[3]), (9001, texts[3] + " the end"), (9002, texts[4]), (9002, None), (None, None)]
    known += [(i, t, "en", "s", 1) for i, t in rows]
    spark.createDataFrame(known, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    clash = ("lang_pred", "score", "AMBIGUOUS", "predicted", "spans", "items", "n_words", "code", "root", "row", "component_id")
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(f"own {c}") for c in clash})
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        assert {tuple(r)[2:] for r in out.collect()} <= {tuple(f"own {c}" for c in clash)}, name
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    kept = corpus_pipeline.drop_near_duplicates(spark, docs.where("text is not null"), str(tmp_path))
    assert sorted(((r["doc_id"] or 0, r["text"]) for r in kept.collect())) == sorted([(9000, texts[0]), (9000, texts[1]), (0, texts[2]), (9001, texts[3] + " the end"), (9002, texts[4])])
    packed = corpus_pipeline.pack(spark, docs, str(tmp_path))
    assert packed.where("piece = 0").count() == len(rows) and corpus_pipeline.pack(spark, docs.limit(0), str(tmp_path)).count() == 0


def marked_rows(n: int, before: str = "") -> tuple[list, list]:
    """Texts and labels; a word at the end of every fourth text is what the label goes by."""
    rng = random.Random(11)
    words = "the of and thin onent erly stoun wha ti blere ounds".split()
    rows = [(k, before + " ".join(rng.choices(words, k=12)) + (" slurry" if k % 4 == 0 else ""), "en", "s", 1) for k in range(n)]
    return rows, [(k, 1, int(k % 4 == 0)) for k in range(n)]


def right_held_out(found: list, marks: list) -> float:
    truth = {i: y for i, _, y in marks}
    held = [r for r in found if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    return sum(r["predicted"] == truth[r["doc_id"]] for r in held) / len(held)


def test_toxicity_is_learned_in_shards_from_all_rows(spark, monkeypatch):
    """Many shards: no words come to the driver, every labelled row is counted once, and the result is the same each time."""
    rows, marks = marked_rows(1500)
    docs = spark.createDataFrame(rows + rows[:300], SCHEMA)
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    monkeypatch.setattr(toxicity, "SHARD_BYTES", 16_000)
    monkeypatch.setattr(toxicity, "_fit_here", None)
    counted, original = [], toxicity._from_hits
    monkeypatch.setattr(toxicity, "_from_hits", lambda hits, sizes, rng: counted.append(sizes) or original(hits, sizes, rng))
    ends, calibrate = [], toxicity.calibrate
    monkeypatch.setattr(toxicity, "calibrate", lambda m, x, y, g, n: ends.append(n.sum()) or calibrate(m, x, y, g, n))
    language = langid.fit(docs)
    models = [toxicity.fit(docs, labels, language) for _ in range(2)]
    learned = [k for k, *_ in rows if zlib.crc32(str(k).encode()) % 5]
    assert counted[0].sum() + ends[0] == len(learned) and counted[0][1] > 0
    assert (models[0].embedding == models[1].embedding).all() and models[0].thresholds == models[1].thresholds
    assert right_held_out(toxicity.score(docs, models[0]).collect(), marks) >= 0.95


def test_toxicity_is_learned_from_whole_texts(spark):
    """What a label goes by stands after 20000 words."""
    rows, marks = marked_rows(120, "thin erly " * 10_050)
    docs, labels = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    assert right_held_out(toxicity.score(docs, toxicity.fit(docs, labels, langid.fit(docs))).collect(), marks) >= 0.95


def test_training_finds_the_strongest_words_of_long_texts(monkeypatch):
    rng = np.random.default_rng(0)
    model = toxicity._start([rng.integers(0, 99, (9, 3)) for _ in range(4)], np.array([0, 1, 0, 1]), rng)
    counts = np.array([200, 1, 9, 8, 7, 299])
    rows = rng.integers(0, toxicity.ROWS, (counts.sum(), 3))
    whole = toxicity.strongest(model, rows, counts)
    monkeypatch.setattr(toxicity, "RUN", 7)
    cut = toxicity.strongest(model, rows, counts)
    assert (whole[0] == cut[0]).all() and np.allclose(whole[1], cut[1], atol=1e-5)
