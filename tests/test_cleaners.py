"""Column cleaners against worked examples and plain rules."""

import datetime

import pytest
from pyspark.sql import functions as F

from siftline.functions import admin, authors, dates, geo, numbers, people, taxon, urls, vocab
from siftline.functions.flags import Staging


def today():
    return F.lit(datetime.date(2024, 1, 1))


def column(spark, values, expression, kind="string"):
    table = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, v {kind}")
    return [r["out"] for r in table.select("k", expression(F.col("v")).alias("out")).orderBy("k").collect()]


def cleaned(spark, values, cleaner, kind="string"):
    """What a cleaner makes of values; it takes a stage and a column and gives one column or several."""
    table = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, v {kind}")
    stage = Staging()
    made = cleaner(stage, F.col("v"))
    several = isinstance(made, (list, tuple))
    rows = stage.select(table, "k", *[c.alias(f"o{n}") for n, c in enumerate(made if several else [made])]).orderBy("k").collect()
    return [list(r)[1:] if several else r[1] for r in rows]


DATES = {
    "1982.08.24": ("19820824", "1982-8-24", "1982-8-24 00:00:00", "1982-08-24T00:00:00+08:00"),
    "19820824": ("19820824", "1982-8-24", "1982-8-24 00:00:00", "1982-08-24T00:00:00+08:00"),
    "1978": ("19780000", "1978-01-01", "1978-01-01 00:00:02", "1978-01-01T00:00:02+08:00"),
    "1983-05": ("19830500", "1983-5-01", "1983-5-01 00:00:01", "1983-05-01T00:00:01+08:00"),
    "19830500": ("19830500", "1983-5-01", "1983-5-01 00:00:01", "1983-05-01T00:00:01+08:00"),
    "5 Aug 1960": ("19600805", "1960-8-5", "1960-8-5 00:00:00", "1960-08-05T00:00:00+08:00"),
    "12.VIII.1934": ("19340812", "1934-8-12", "1934-8-12 00:00:00", "1934-08-12T00:00:00+08:00"),
    "Sept 1950": ("19500900", "1950-9-01", "1950-9-01 00:00:01", "1950-09-01T00:00:01+08:00"),
    "24/8/82": ("19820824", "1982-8-24", "1982-8-24 00:00:00", "1982-08-24T00:00:00+08:00"),
    "2003-04-05 06:07:08": ("20030405", "2003-04-05", "2003-04-05 06:07:08", "2003-04-05T06:07:08+08:00"),
    "2003-04-05 00:00:00": ("20030405", "2003-4-5", "2003-4-5 00:00:00", "2003-04-05T00:00:00+08:00"),
}


@pytest.mark.parametrize("style", range(4))
def test_dates(spark, style):
    got = cleaned(spark, list(DATES), lambda s, c: dates.format_date(s, c, dates.STYLES[style], as_of=today()).shown())
    assert dict(zip(DATES, got)) == {k: v[style] for k, v in DATES.items()}


def test_dates_that_fail(spark):
    bad = ["1982-04-31", "2030", "12", "45", "1.2.3", "1500", "1982 1983", "0000", "a b", "1982-13-01", "1.2.3.4", "2024-01-02"]
    assert cleaned(spark, bad, lambda s, c: dates.format_date(s, c, as_of=today()).shown()) == ["!" + b for b in bad]
    assert cleaned(spark, [None, *dates.UNKNOWN], lambda s, c: dates.format_date(s, c, as_of=today()).shown()) == [None] * 5
    assert cleaned(spark, bad, lambda s, c: dates.format_date(s, c, mark=False, as_of=today()).shown()) == [None] * len(bad)
    with pytest.raises(ValueError):
        dates.format_date(Staging(), F.lit("x"), "week")


def test_dates_are_stable(spark):
    once = cleaned(spark, list(DATES), lambda s, c: dates.format_date(s, c, as_of=today()).shown())
    assert cleaned(spark, once, lambda s, c: dates.format_date(s, c, as_of=today()).shown()) == once


def test_numbers(spark):
    raw = ["约12.5m", "-3", "a-3", "1 2", None, "", "9000", "x"]
    assert cleaned(spark, raw, lambda s, c: numbers.number(s, c).shown()) == ["12.5", "-3.0", "3.0", "!1 2", None, "!", "!9000", "!x"]
    assert cleaned(spark, ["12.9"], lambda s, c: numbers.number(s, c, "int").value) == [12]
    ranges = ["1400～1800", "大概600-400", "1000-1100m", "3800米", "500-0", "1-2-3", None, "9999"]
    ends = cleaned(spark, ranges, lambda s, c: [e.shown() for e in numbers.number_range(s, c, F.lit(None).cast("string"), "int")])
    assert ends[:5] == [["1400", "1800"], ["400", "600"], ["1000", "1100"], ["3800", "3800"], ["500", "500"]]
    assert cleaned(spark, ["１４００米", "٣-٥"], lambda s, c: [e.shown() for e in numbers.number_range(s, c, F.lit(None).cast("string"), "int")]) == [["1400", "1400"], ["3", "5"]]
    assert ends[5:] == [["!1-2-3", None], [None, None], ["!9999", None]]


POINTS = {
    "N39°30′36″,E116°15′": (39.51, 116.25), "28°30'S; 101°20'W": (-28.5, -101.333333), "E101.5, N25.25": (25.25, 101.5), "-33.5, 151.25": (-33.5, 151.25), "30°10′75″N, 100°20′30″E": (30.179167, 100.338333), "N３９°30′,E116°": (39.5, 116.0), "N39.5°,E116°15′30″": (39.5, 116.258333), "N1.5°,E89°15′": None, "10°20′N 30°E": (10.333333, 30.0),
}


def test_coordinates(spark):
    got = cleaned(spark, list(POINTS), lambda s, c: [p.value for p in geo.coordinates(s, c)])
    for point, expected in zip(got, POINTS.values()):
        assert point == (pytest.approx(expected, abs=1e-6) if expected else [None, None])
    bad = {"N91°0′,E10°0′": ["!N91°0′", "!E10°0′"], "N10°,N20°": ["!N10°", "!N20°"], "100,200": ["!100", "!200"], "N10°60′, E20°10′": ["!N10°60′", "!E20°10′"], "no place": ["!no place", None]}
    got = cleaned(spark, [*bad, None], lambda s, c: [p.shown() for p in geo.coordinates(s, c)])
    assert got == [*bad.values(), [None, None]]


def test_people(spark):
    cases = {
        "王 小明, 李四": "王小明，李四", "A.B.Smith & J. Hooker": "A. B. Smith，J. Hooker", "张三|12": "张三|12", "无": None, "王，李四": "!王，李四", "R. Brown.": "R. Brown.", None: None, "12": "", "王　小明": "王　小明", "A, Smith": "Smith", "Smith12": "!Smith12", "-- Tsang, -. Tang & Fung, --": "Tsang，Tang，Fung", "[Cavalerie] J.": "[Cavalerie] J.", "David (Abbé)": "David (Abbé)",
        "Handel-Mazzetti H. von": "Handel-Mazzetti H. von", "Kang P., Tak Ts'ang": "Kang P.，Tak Ts'ang", "王Smith": "!王Smith", "王小明Smith": "王小明，Smith", "Ho T.N.|12": "!Ho T.N.|12", "Incarville   P.N.   C. d'": "Incarville P. N. C. d'",
    }
    got = dict(zip(cases, cleaned(spark, list(cases), lambda s, c: people.person_names(s, c).shown())))
    assert got == cases


def test_urls(spark):
    assert column(spark, ["http://a/b|https://c,ftp://d", "none", "", None], urls.urls) == [["http://a/b", "https://c", "ftp://d"], [], None, None]


def test_vocabularies(spark):
    words = {"male": ["m", "♂"], "female": ["f", "m"]}
    raw = ["m", "♂", "f", "female", "x", None]
    assert column(spark, raw, lambda c: vocab.standardised(c, words)) == ["male", "male", "female", "female", "x", None]
    assert column(spark, raw, lambda c: vocab.standardised(c, words, "flag"))[4] == "!x"
    assert column(spark, raw, lambda c: vocab.standardised(c, words, "null"))[4] is None
    assert column(spark, raw, lambda c: vocab.standardised(c, {})) == raw
    assert vocab.with_aliases(words, {"x": "male"})["male"] == ["m", "♂", "x"]


NAMES = {
    "Carex minor L.": ("Carex", "minor", None, None, "L.", None, "specific"),
    "Rhododendron arboreum Sm. var. roseum Lindl.": ("Rhododendron", "arboreum", "var.", "roseum", "Lindl.", "Sm.", "infraspecific"),
    "Poa annua L. var. annua": ("Poa", "annua", None, None, "L.", None, "specific"),
    "Poaceae": ("Poaceae", None, None, None, None, None, "familial"),
    "Poa": ("Poa", None, None, None, None, None, "generic"),
    "Salix × alba L.": ("Salix", "× alba", None, None, "L.", None, "specific"),
}


#: Names as they are written in the field, and how they are read: genus, species, first authors, rank, infraspecific epithet, authors.
SPLIT = {
    "Adansonia za var. bozy (Jum. & H.Perrier) H.Perrier": ("Adansonia", "za", None, "var.", "bozy", "(Jum. & H.Perrier) H.Perrier"),
    "Hieracium lagopus Soest non Don": ("Hieracium", "lagopus", None, None, None, "Soest non Don"),
    "Ania elmeri (Ames & sine ref.) A.D.Hawkes": ("Ania", "elmeri", None, None, None, "(Ames & sine ref.) A.D.Hawkes"),
    "Ophrys vernixia var. regis-ferinandii (Renz) H.Baumann & al.": ("Ophrys", "vernixia", None, "var.", "regis-ferinandii", "(Renz) H.Baumann & al."),
    "Adiantum thalictroides var. hirsutum (Hook. & Grev.) de la Sota": ("Adiantum", "thalictroides", None, "var.", "hirsutum", "(Hook. & Grev.) de la Sota"),
    "Lycopodioideae W.H.Wagner & Beitel ex B.Øllg.": ("Lycopodioideae", None, None, None, None, "W.H.Wagner & Beitel ex B.Øllg."),
    "Phyllostachys nigra var. stauntonii (Munro) Keng f. ex Q.F.Zheng & Y.M.Lin": ("Phyllostachys", "nigra", None, "var.", "stauntonii", "(Munro) Keng f. ex Q.F.Zheng & Y.M.Lin"),
    "Saxifraga rufescens Bal f. f. var. uninervata J. T. Pan": ("Saxifraga", "rufescens", "Bal f. f.", "var.", "uninervata", "J. T. Pan"),
    "Microcephala discoidea var. discoidea (Ledeb.) K.Bremer": ("Microcephala", "discoidea", None, None, None, "(Ledeb.) K.Bremer"),
    "Passiflora × alatocaerulea Lindl.": ("Passiflora", "× alatocaerulea", None, None, None, "Lindl."),
    "Betula ×piperi Britton, pro spec. & C.L.Hitchc.": ("Betula", "× piperi", None, None, None, "Britton, pro spec. & C.L.Hitchc."),
    "Phegopteris decursive-pinnata (van Hall)": ("Phegopteris", "decursive-pinnata", None, None, None, "(van Hall)"),
    "Saxifraga umbellulata Hook. f. et Thoms. var. pectinata (C. Marq. et Airy Shaw) J. T. Pan": ("Saxifraga", "umbellulata", "Hook. f. et Thoms.", "var.", "pectinata", "(C. Marq. et Airy Shaw) J. T. Pan"),
    "Lindera pulcherrima (Nees) Hook. f. var. attenuata C. K. Allen": ("Lindera", "pulcherrima", "(Nees) Hook. f.", "var.", "attenuata", "C. K. Allen"),
    "Houpoëa officinalis (Rehd. et E. H. Wils.) N. H. Xia et C. Y. Wu": ("Houpoëa", "officinalis", None, None, None, "(Rehd. et E. H. Wils.) N. H. Xia et C. Y. Wu"),
    "Poa annua annua": ("Poa", "annua", None, None, None, None),
    "Poa annua annua (Kurz ex Hook. f. et T. Anderson) O. E. Schulz": ("Poa", "annua", None, None, None, "(Kurz ex Hook. f. et T. Anderson) O. E. Schulz"),
    "Poa annua subsp. sine": ("Poa", "annua", None, "subsp.", "sine", None),
    "Aus bus minor Hook.": ("Aus", "bus", None, None, "minor", "Hook."),
}


def test_taxon_names(spark):
    fields = ("genus", "species", "taxon_rank", "infraspecies", "authors", "first_authors", "platform_rank")
    got = cleaned(spark, [*NAMES, "123", None], lambda s, c: [getattr(taxon.parsed_name(s, c), f) for f in fields])
    assert [tuple(r) for r in got] == [*NAMES.values(), (None,) * 7, (None,) * 7]
    assert cleaned(spark, list(NAMES)[1:2], lambda s, c: taxon.styled_name(s, c)) == [["Rhododendron arboreum var. roseum Lindl."]]
    assert cleaned(spark, list(NAMES)[1:2], lambda s, c: taxon.styled_name(s, c, "simpleName")) == [["Rhododendron arboreum var. roseum"]]
    assert dict(zip(SPLIT, map(tuple, cleaned(spark, list(SPLIT), lambda s, c: taxon.styled_name(s, c, "fullPlantSplitName"))))) == SPLIT
    with pytest.raises(ValueError):
        taxon.styled_name(Staging(), F.lit("x"), "short")


def test_filters_do_not_enter_the_steps(spark):
    """A filter on a cleaned column stays above it, one on another column goes below."""
    table = spark.createDataFrame([("N39°30′36″,E116°15′", 1), ("x", 2)], "v string, k int")
    stage = Staging()
    point = geo.coordinates(stage, F.col("v"))
    made = stage.select(table, "k", point.latitude.value.alias("lat"))
    assert made.where("lat > 10 and k = 1").collect() == [(1, 39.51)]
    plan = made.where("lat > 10 and k = 1")._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 30_000 and plan.index("lat") < plan.index("k#")


def test_authors(spark):
    assert authors.team_of("Müll. ex Benth. & J.D.Hook. in Smith") == ["Benth.", "J.D.Hook."]
    assert authors.team_of("(L.) Hook. f. comb. nov.")[0] == "L." and authors.team_of(None) == []
    assert authors.sorted_ratio("Hook f", "f Hook") == 100 and authors.sorted_ratio("", "x") == 0
    assert authors.team_of("(A ex B) C ex D") == [] and authors.team_of("(Aa ex Bb) Cc") == ["Bb", "Cc"] and authors.team_of("(Aa) Bb ex Cc") == ["Aa", "Cc"] and authors.team_of("（Aa in Bb）Cc") == ["Aa", "Cc"]
    assert authors.team_of("Hung T. Chang et al.") == ["Hung T. Chang"] and authors.team_of("Kze ; Kl") == ["Kze"] and authors.team_of("auct.") == []
    pairs = spark.createDataFrame([("auct.", "auct."), ("Benth.", "Benth."), ("Benth.", None), (None, "L."), ("Regel Wall.", "Regel")], "q string, c string")
    assert sorted((r["q"] or "", r["c"] or "", r["s"]) for r in authors.with_scores(pairs, "q", "c", "s").collect()) == [("", "L.", None), ("Benth.", "", 0.0), ("Benth.", "Benth.", 100.0), ("Regel Wall.", "Regel", 0.0), ("auct.", "auct.", 0.0)]
    for a, b in (("kitten", "sitting"), ("", "x"), ("abcabc", "cab")):
        rows = [[0] * (len(b) + 1)]
        for x in a:
            rows.append([0])
            for k, y in enumerate(b):
                rows[-1].append(rows[-2][k] + 1 if x == y else max(rows[-2][k + 1], rows[-1][k]))
        assert authors._common(a, b) == rows[-1][-1]
    assert authors.team_score(["Benth."], ["Bentham"]) > 70 and authors.team_score(["Regel Wall."], ["Regel"]) == 0
    assert authors.ascii_text("Øœ", discard=False) == "Oœ"
    assert column(spark, ["Pančić", None], authors.strip_accents) == ["Pancic", None]
    assert column(spark, ["A.B. Smith-Jones"], authors.clean_author) == ["A B Smith Jones"]


PATHS = ["中国", "中国::云南省", "中国::云南省::大理州", "中国::云南省::大理州::洱源县", "中国::河北省", "中国::天津市::天津市::河北区", "中国::内蒙古自治区", "中国::内蒙古自治区::阿拉善盟::阿拉善左旗", "中国::西藏自治区", "中国::西藏自治区::林芝市", "中国::西藏自治区::林芝市::米林县"]
#: By the rules: runs of characters in order; ties go to the first path, or a shorter one, which is flagged.
PLACES = {
    "云南省大理州洱源县": "中国::云南省::大理州::洱源县", "河北": "中国::河北省", "中国": "中国", "中国火星": "!中国火星", "不丹": "不丹", "中": "中", "西藏林芝米林": "中国::西藏自治区::林芝市::米林县",
    "西藏林芝": "中国::西藏自治区::林芝市", "内蒙古": "中国::内蒙古自治区", "云南": "中国::云南省", "天津河北": "中国::天津市::天津市::河北区", "": "",
}


def plain_best(raw, paths):
    best, most, length = None, 0, 0
    for path in paths:
        n = admin.score(raw, path)
        if n >= 2 and n > most:
            best, most, length = path, n, len(path)
        elif n >= 2 and n == most and best not in path and len(path) < length:
            best, length = "!" + path, len(path)
    return best or (raw if raw == admin.HOME or admin.HOME not in raw else "!" + raw)


def test_divisions(spark):
    regions = spark.createDataFrame([(p,) for p in PLACES], "raw string")
    gazetteer = spark.createDataFrame(list(zip(PATHS, range(len(PATHS)))), "path string, ord long")
    got = {r["raw"]: r["path"] for r in admin.best_paths(regions, gazetteer).collect()}
    assert got == PLACES
    reverse = spark.createDataFrame(list(zip(PATHS[::-1], range(len(PATHS)))), "path string, ord long")
    assert {r["raw"]: r["path"] for r in admin.best_paths(regions, reverse).collect()} == {p: plain_best(p, PATHS[::-1]) for p in PLACES}
    table = spark.createDataFrame([("云南省大理州",), (None,)], "r string")
    rows = admin.match_divisions(table, "r", PATHS).collect()
    assert {(r["country"], r["province"], r["city"], r["county"]) for r in rows} == {("中国", "云南省", "大理州", None), (None, None, None, None)}
