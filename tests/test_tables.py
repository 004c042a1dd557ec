"""Operators on tables, models, alignment, files, HTTP and streams."""

import io
import json
import urllib.error

import pytest
from pyspark.sql import functions as F

from siftline.operators import columns as cols
from siftline.operators import labels, resolve, rows, validate
from siftline.plans import align, cleaners
from siftline.plans.dsl import Model, ModelError, imodel
from siftline.plans.models import MODELS
from siftline.sources import files, http
from siftline.streaming import cleaning


def collected(df):
    return [tuple(r) for r in df.collect()]


def test_splitting(spark):
    df = spark.createDataFrame([("a:b-c:d", 1), ("a", 2), (None, 3), ("", 4)], "t string, k int")
    assert collected(cols.split_column(df, "t", [":", "-"], ["x", "y", "z"])) == [(1, "a", "b", "c:d"), (2, "a", None, None), (3, None, None, None), (4, "", None, None)]
    mixed = spark.createDataFrame([("木香薷 Elsholtzia",), ("Elsholtzia 木香薷",), ("木香薷É",), ("木香薷",), ("Poa",)], "t string")
    assert collected(cols.split_column(mixed, "t", "$", ["a", "b"])) == [("木香薷", "Elsholtzia"), ("Elsholtzia ", "木香薷"), ("木香薷", "É"), ("木香薷", ""), ("Poa", "")]


def test_merging(spark):
    df = spark.createDataFrame([("a", None, "c"), (None, None, None), ("a", "b", "c")], "x string, y string, z string")
    one = lambda how: [r["m"] for r in cols.merge_columns(df, ["x", "y", "z"], how, "m").collect()]
    assert one(",") == ["a,c", None, "a,b,c"]
    assert one(["-", "+"]) == ["a+c", None, "a-b+c"]
    assert one("r") == ["x：a\nz：c", None, "x：a\ny：b\nz：c"] and one("t") == ["x：a；z：c", None, "x：a；y：b；z：c"]
    assert one("l") == [["a", "c"], None, ["a", "b", "c"]] and one("a") == ['["a", "c"]', None, '["a", "b", "c"]']
    assert one("o")[:2] == ['{"x": "a", "z": "c"}', None] and one("d")[1] is None
    kept = cols.merge_columns(df, ["x", "y"], ",", "x", drop=False)
    assert kept.columns == ["x", "y", "z", "x_"]


def test_names_and_order(spark):
    assert cols.free_names(["a", "a", "b", "a_"]) == ["a", "a_", "b", "a__"]
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    assert cols.append_columns(df, {"a": F.lit(9)}).columns == ["a_", "b", "a"]
    assert cols.replace_columns(df, ["a"], {"x": F.lit(1)}).columns == ["b", "a"]
    assert cols.replace_columns(df, ["a"], {"x": F.lit(1), "y": F.lit(2)}).columns == ["b", "x", "y"]
    assert cols.final_columns(df, ["b", "c", "b"], cut=False, fill="", fillable=["c"]).columns == ["c", "b", "a"]


def test_duplicates_and_nulls(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("a", 2), (None, 1), (None, 1)], "k string, n int")
    assert sorted(collected(rows.mark_duplicates(df, ["k", "n"])), key=str) == sorted([("!a", 1), ("!a", 1), ("a", 2), (None, 1), (None, 1)], key=str)
    gaps = spark.createDataFrame([(1, 5), (2, None), (3, None), (4, 6), (5, None)], "t int, v int")
    along = lambda **k: [r["v"] for r in rows.fill_along(gaps, ["v"], ["t"], **k).orderBy("t").collect()]
    assert along() == [5, 5, 5, 6, 6] and along(limit=1) == [5, 5, None, 6, 6] and along(backward=True) == [5, 6, 6, 6, None]
    for size in (1, 2, 3):
        assert along(block_rows=size) == [5, 5, 5, 6, 6] and along(limit=1, block_rows=size) == [5, 5, None, 6, 6] and along(backward=True, block_rows=size) == [5, 6, 6, 6, None]
        assert along(backward=True, limit=1, block_rows=size) == [5, None, 6, 6, None]
    assert [r["v"] for r in rows.fill_value(gaps, ["v"], 0).orderBy("t").collect()] == [5, 0, 0, 6, 0]


def test_alignment():
    aliases = {"catalogNumber": ["BARCODE", "NO"], "recordNumber": ["NO"], "country": []}
    assert align.build_mapping(["Barcode", "country", "other"], aliases) == {"Barcode": "catalogNumber", "country": "country"}
    for headers in (["no"], ["Barcode", "catalogNumber"]):
        with pytest.raises(align.AlignmentError):
            align.build_mapping(headers, aliases)
    assert align.build_mapping(["no"], aliases, policy="first") == {"no": "catalogNumber"} and align.build_mapping(["no"], aliases, policy="ignore") == {}
    assert align.build_mapping(["no"], aliases, {"no": "recordNumber"}) == {"no": "recordNumber"}
    heads, terms = ["a", "b", "c"], ["x", "y", "z"]
    assert align.parse_expression("0;1=2", heads, terms) == {("a", "b", ";"): "z"}
    assert align.parse_expression("2=0,1", heads, terms) == {("c", (",",)): ("x", "y")}
    assert align.parse_expression("1=2", heads, terms) == {"b": "z"} and align.parse_expression("d 0 , 1 = 2", heads, terms) == {("a", "b", "d"): "z"}


def test_mappings_are_kept(tmp_path):
    align.save_mapping({"a": "x"}, str(tmp_path / "m.json"))
    assert align.load_mapping(str(tmp_path / "m.json"), ["a", "b"]) == {"a": "x"}
    with pytest.raises(align.AlignmentError):
        align.load_mapping(str(tmp_path / "m.json"), ["b"])


def test_models(spark):
    df = spark.createDataFrame([("云南,昆明", "Poa", "annua", "var. x", "12m", "5")], "place string, g string, s string, i string, h string, n string")

    @imodel(fill="-")
    class Table:
        province__city = {"$place": ","}
        name = ("$g", "$s", "$i", " ")
        height = cleaners.Number("$h", kind="int")
        n__ = "$n"
        _n2 = ["$missing", "$n"]
        gone = "$missing"
        made_ = cleaners.Number("$missing")

    out = Table(df)
    assert out.columns == ["province", "city", "name", "height", "n", "n2", "made"] or out.columns == ["province", "city", "name", "height", "n2", "made"]
    row = out.collect()[0].asDict()
    assert (row["province"], row["city"], row["name"], row["height"], row["n2"], row["made"]) == ("云南", "昆明", "Poa annua var. x", "12", "5", "-")
    assert Table.compile(df.columns).missing == ["gone"]
    chained = Model([("a", "$g"), ("b", ("$a", "$s", "/"))])
    assert collected(chained(df)) == [("Poa/annua",)]
    same = Model([("p__q", {("$g", "$s", ","): ","})])
    assert collected(same(spark.createDataFrame([(None, "x")], "g string, s string"))) == [(None, "x")]
    for bad in ("x", ("$a", "$b", 3), {"$a": ",", "$b": ","}, 5):
        with pytest.raises(ModelError):
            Model([("o", bad)]).compile(["a", "b"])


OCCURRENCE = {
    "occurrenceID": "urn:12345", "catalogNumber": "PE01", "recordedBy": "王 小明, 李四", "recordNumber": "7", "eventDate": "1982.08.24", "verbatimCoordinates": "N39°30′,E116°15′", "country": "中国",
    "province": "云南省", "prefecture": "大理州", "county": "洱源县", "scientificName": "Poa annua L.", "verbatimElevation": "100-200", "individualCount": "3", "basisOfRecord": "specimen", "dataFrom": "x",
    "rightsHolder": "y", "license": "z", "locality": "hill", "habitat": "wood", "typeStatus": "holo", "identifiedBy": "A.Smith", "dateIdentified": "1990", "fundedBy": "f", "labelTitle": "Title", "fruit": "red",
}


@pytest.mark.parametrize("name", sorted(MODELS))
def test_ready_models(spark, name):
    df = spark.createDataFrame([tuple(OCCURRENCE.values())] * 2, ", ".join(f"{k} string" for k in OCCURRENCE))
    model = MODELS[name]({"typeStatus": {"holotype": ["holo"]}})
    out = model(df)
    found = out.collect()
    row = found[0].asDict(recursive=True)
    assert len(out.columns) == len(set(out.columns)) and len(found) == 2
    if name == "nested_occurrence":
        assert row["Occurrence"]["occurrenceID"] == "!urn:12345" and row["Identification"][0]["typeStatus"] == "holotype" and row["Location"]["decimalLatitude"] == "39.5"
    if name == "herbarium_portal":
        assert row["采集人"] == "王小明，李四" and row["属"] == "Poa" and row["拉丁名"] == "Poa annua L." and row["省市"] == "云南省,大理州" and row["果实"] == "red"
    if name == "label":
        assert row["genus"] == "Poa" and row["eventDate"] == "1982-8-24" and row["host"] == ""


def test_resolution(spark):
    lib = spark.createDataFrame([("Poa annua L.", 1, False), ("Poa annua Benth.", 2, True), ("Poa annuaria L.", 3, False), ("Poa L. annua", 4, True)], "name string, ord long, accepted boolean")
    table = resolve.lookup_table(lib, "name", "ord", ["accepted"])
    df = spark.createDataFrame([("Poa annua Bentham",), ("Poa annua",), ("Poa rara",), (None,)], "q string")
    out = {r["q"]: (r["n"], r["a"]) for r in resolve.resolve(df, "q", table, {"n": "lib_name", "a": "accepted"}).collect()}
    assert out == {"Poa annua Bentham": ("Poa annua Benth.", True), "Poa annua": ("Poa annua L.", False), "Poa rara": (None, None), None: (None, None)}
    accepted_first = resolve.resolve(df, "q", table, {"n": "lib_name"}, resolve.PRIORITIES["powo"]()).where("q = 'Poa annua'")
    assert collected(accepted_first) == [("Poa annua", "Poa annua Benth.")]
    assert {r["n"] for r in resolve.resolve(df, "q", table, {"n": "lib_name"}, mark=True).collect()} == {"Poa annua Benth.", "Poa annua L.", "!Poa rara", None}
    assert resolve.resolve(df, "q", table, {"n": "lib_name"}, only_hits=True).count() == 2


def test_projections_and_trees(spark):
    found = spark.createDataFrame([("q", "Poa", "not_stated", "Poaceae", "x")], "raw string, lib_name string, lib_authors string, family string, ipni_lsid string")
    assert collected(resolve.projected(found, "ipniName")) == [("q", "Poa", None, "Poaceae", "x")]
    with pytest.raises(ValueError):
        resolve.projected(found, "other")
    lib = spark.createDataFrame([("Poaceae", "Poa", 2), ("Poaceae", "Zea", 1)], "family string, genus string, ord long")
    keys = resolve.query_keys(spark.createDataFrame([("Poa",), ("Poaceae",), ("Poa annua",)], "n string"), "n")
    assert sorted(collected(resolve.tree_matches(keys, lib))) == [("Poa", "Poaceae", "Poa"), ("Poaceae", "Poaceae", "Zea")]


def test_arrays_of_nulls_count_as_null(spark):
    df = spark.createDataFrame([([None], "x"), ([None, "a"], "y")], "a array<string>, b string")
    assert [r["m"] for r in cols.merge_columns(df, ["a", "b"], "o", "m").collect()] == ['{"b": "x"}', '{"a": [null, "a"], "b": "y"}']
    model = Model([("m", ("$a", "$b", "o"))])
    assert [r["m"] for r in model(df).collect()] == ['{"b": "x"}', '{"a": [null, "a"], "b": "y"}']
    quoted = spark.createDataFrame([('x:"y, z\\', 1)], "a string, b int")
    assert [r["m"] for r in cols.merge_columns(quoted, ["a", "b"], "o", "m").collect()] == [json.dumps({"a": 'x:"y, z\\', "b": 1})]


def test_validation(spark):
    record = "Occurrence struct<occurrenceID:string,catalogNumber:string,recordedBy:string,sex:string>, Location struct<country:string,decimalLatitude:double>, Record struct<basisOfRecord:string,dataFrom:string,rightsHolder:string,license:string>"
    good = (("urn:1", "PE01", "A", "male"), ("China", 10.0), ("s", "d", "r", "l"))
    cases = [
        (good, "ready"), ((("urn:1", None, None, None), *good[1:]), "unvalid"), (("!" and ("!rn:1", "PE01", "A", "male"), *good[1:]), "needcheck"), ((("urn:1", "", "A", None), *good[1:]), "needcheck"),
        ((good[0], ("China", 91.0), good[2]), "unvalid"), ((good[0], None, good[2]), "unvalid"), ((("urn:1", "PE01", "A", "other"), *good[1:]), "unvalid"),
    ]
    schema = validate.with_terms(validate.OCCURRENCE_SCHEMA, {"Occurrence.sex": ["male", "female"]})
    df = spark.createDataFrame([c[0] for c in cases], record)
    assert [r["status"] for r in validate.route(df.coalesce(1), schema).collect()] == [c[1] for c in cases]


def test_labels(spark):
    df = spark.createDataFrame([(1, "2"), (2, "x"), (3, "0"), (4, None)], "k int, duplicatesOfLabel string")
    assert sorted(collected(labels.copies(df).select("k", "copy"))) == [(1, 1), (1, 2), (2, 1), (4, 1)]
    assert labels.copies(df, 3).count() == 12
    table = labels.renumbered(df, "K07", ["k"])
    assert table.columns == ["k", "duplicatesOfLabel", "catalogNumber"] and [r["catalogNumber"] for r in table.orderBy("catalogNumber").collect()] == ["K07", "K08", "K09", "K10"]
    many = spark.createDataFrame([(k,) for k in range(250)], "k int")
    codes = [r["catalogNumber"] for r in labels.running_codes(many.repartition(5), "A098", ["k"]).orderBy("k").collect()]
    assert codes[:3] == ["A098", "A099", "A100"] and codes[-1] == "A347" and labels.code_parts("B01-9") == ("B01-", 9, 1)
    assert labels.render("{{a}}{{{a}}}{{#b}}x{{c}}{{/b}}{{^b}}y{{/b}}", {"a": "<", "b": "", "c": "z"}) == "&lt;<y"
    sheets = labels.pages(labels.rendered(many, "<i>{{k}}</i>"), ["k"], 5, 4).orderBy("page").collect()
    assert len(sheets) == 13 and sheets[0]["html"].count("<i>") == 20 and "<i>249</i>" in sheets[-1]["html"]


def test_label_documents(spark, tmp_path):
    rows = labels.rendered(spark.createDataFrame([(k,) for k in range(5)], "k int"), "<i>{{k}}</i>")
    assert labels.write_document(labels.pages(rows, ["k"], 2, 1), str(tmp_path / "l.html"), 2, 1) == 3
    text = (tmp_path / "l.html").read_text()
    assert text.count('class="page"') == 3 and text.index("<i>0") < text.index("<i>4") and "repeat(2, 1fr)" in text
    assert labels.write_document(labels.pages(rows.limit(0), ["k"]), str(tmp_path / "none.html")) == 0


@pytest.mark.parametrize("name", sorted(MODELS))
def test_ready_models_give_their_fields_in_order(spark, name):
    source = spark.createDataFrame([("x",)], "catalogNumber string")
    model = MODELS[name]()
    made = model(source).columns
    wanted = [o for f in model.fields for o in f.outputs]
    assert [c for c in made if c in wanted] == [c for c in dict.fromkeys(reversed(wanted)) if c in made][::-1]


def test_files(spark, tmp_path):
    df = spark.createDataFrame([("a", 'x "q", y'), (None, "z")], "k string, v string")
    for kind in ("csv", "json", "parquet"):
        path = str(tmp_path / f"t.{kind}")
        files.save(df, path)
        again = spark.read.json(path) if kind == "json" else files.load(spark, path)
        assert sorted(map(tuple, again.select("k", "v").collect()), key=str) == sorted(collected(df), key=str)
    (tmp_path / "lines.csv").write_text('k,v\n1,"two\nlines, ""quoted"""\n')
    assert collected(files.load(spark, str(tmp_path / "lines.csv"))) == [("1", 'two\nlines, "quoted"')]
    (tmp_path / "t.txt").write_text("k\tv\n1\t2\n")
    assert collected(files.load(spark, str(tmp_path / "t.txt"))) == [("1", "2")]
    files.export_csv(df, str(tmp_path / "one.csv"))
    assert (tmp_path / "one.csv").read_bytes().startswith(b"\xef\xbb\xbfk,v")
    for call in (lambda: files.load(spark, "x.bin"), lambda: files.save(df, "x.bin")):
        with pytest.raises(ValueError):
            call()
    routed = df.withColumn("status", F.lit("ready"))
    assert files.export_routed(routed, str(tmp_path / "r")) == {"ready": 2, "needcheck": 0, "unvalid": 0}
    assert len(json.loads((tmp_path / "r_ready.json").read_text())) == 2
    files.write_routed(routed, str(tmp_path / "routed"))
    assert spark.read.json(str(tmp_path / "routed")).count() == 2


def test_http(spark, monkeypatch):
    def answer(url):
        from urllib.parse import parse_qs, urlsplit

        q = parse_qs(urlsplit(url).query)
        if "id" in q:
            return json.dumps({"uuid": q["id"][0], "more": 1})
        page = int(q["page"][0])
        return json.dumps({"total": 65, "rows": [{"collectionID": str(k)} for k in range((page - 1) * 30, min(65, page * 30))]})

    reader = http._PortalReader({"list_url": "http://x/list", "search": '{"family": "Poaceae"}', "detail_url": "http://x/one"}, answer)
    parts = reader.partitions()
    found = [r for p in parts for r in reader.read(p)]
    assert len(parts) == 3 and len(found) == 65 and found[0][2:] == ("http://x/one?id=0", "Poaceae")
    tries = []

    def busy(request, timeout):
        tries.append(timeout)
        if len(tries) < 3:
            raise urllib.error.HTTPError("u", 429, "busy", {}, None)
        return io.BytesIO(b"ok")

    monkeypatch.setattr(http.urllib.request, "urlopen", busy)
    assert http.fetch("http://x", http.Policy(wait=0)) == "ok" and len(tries) == 3
    queries = spark.createDataFrame([("Poa annua L.",)], "raw string")
    keys = resolve.query_keys(queries, "raw")
    asked = http.ask(keys, lambda r: http.name_request("ipni", "http://n", r.simple_name, r.platform_rank), get=lambda u: u).collect()
    assert asked[0]["answer"] == "http://n/search?q=Poa+annua&f=f_specific&perPage=500"
    assert http.name_request("col", "http://n", "Poaceae", "familial", "k") == "http://n/getFamiliesByFamilyName?apiKey=k&familyName=Poaceae&page=1"
    assert http.name_request("tropicos", "http://n", "12", "acceptedname", "k") == "http://n/12/AcceptedNames?apikey=k&format=json" and http.name_request("powo", "http://n", "x", "images") is None
    assert http.name_request("tropicos", "http://n", "Poa L.", key="k").startswith("http://n/Search?name=Poa+L%252e&type=exact") and len(http.SEARCHES) == 15
    registry = http.Registry("http://r", "key", "secret")
    assert registry.token(0).startswith("key:") and registry.token(0) != http.Registry("http://r", "key", "other").token(0)
    done = http.register(queries.withColumn("id", F.lit(1)), registry, "id", send=lambda url, data, headers: url).collect()
    assert [(r["key"], r["ok"], r["message"]) for r in done] == [("1", True, "http://r/create")]


def test_registering_happens_once(spark, tmp_path):
    log = tmp_path / "log"

    def send(url, data, headers):
        with open(log, "a") as out:
            out.write("x")
        if b'"id":2' in data:
            raise OSError("refused")
        return "done"

    records = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    done = http.register(records, http.Registry("http://r", "key", "secret"), "id", send=send)
    assert done.count() == 2 and done.where("ok").count() == 1 and len(log.read_text()) == 2
    http.write_outcomes(records, done, "id", str(tmp_path / "out"))
    assert [r["v"] for r in spark.read.json(str(tmp_path / "out" / "success")).collect()] == ["a"]
    assert [(r["v"], r["message"]) for r in spark.read.json(str(tmp_path / "out" / "failed")).collect()] == [("b", "refused")]
    assert len(log.read_text()) == 2


def test_searches_of_a_portal(spark):
    class Local(http.PortalSource):
        @staticmethod
        def get(url):
            return json.dumps({"total": 31, "rows": [{"collectionID": str(k % 3)} for k in range(30 if "page=1&" in url else 1)]})

    assert {r["collectionID"] for r in http.search_portal(spark, "http://x/list", {"withPhoto": True}, source=Local).collect()} == {"0", "1", "2"}


def test_streams(spark, tmp_path):
    spark.createDataFrame([("a", "12m", "2024-01-01 00:00:00"), ("a", "13m", "2024-01-01 00:10:00"), ("b", "x", "2024-01-01 00:20:00")], "k string, h string, t string").write.csv(str(tmp_path / "in"), header=True)
    stream = cleaning.read_stream(spark, str(tmp_path / "in"), "csv", "k string, h string, t timestamp")
    model = Model([("k", "$k"), ("h", cleaners.Number("$h")), ("t", "$t")])
    unique = cleaning.first_seen(cleaning.cleaned_stream(stream, model), ["k"], "t")
    cleaning.write_stream(unique, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert {r["k"] for r in got.collect()} == {"a", "b"} and "!x" in {r["h"] for r in got.collect()}
    assert cleaning.counts_by_window(stream, "t", ["k"]).isStreaming
