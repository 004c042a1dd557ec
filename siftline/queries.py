"""Queries of the operators over the driver's tables, and DuckDB SQL for the same results.

The tables hold no specimen records, so messy input is made from their columns, alike in both.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import admin, authors, dates, geo, numbers, people, taxon, urls, vocab
from .functions.flags import Staging
from .functions.terms import VOCABULARIES
from .operators import columns as cols
from .operators import cluster, labels, resolve, rows, validate
from .plans import align as alignment
from .plans import cleaners as C
from .plans import models
from .plans.dsl import Model
from .sources import answers, files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLE_SQL[function.__name__] = sql
        return function

    return register


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


# --- columns ---------------------------------------------------------------------------------


@query("SELECT c_custkey, split_part(c_name, '#', 1) AS kind, split_part(c_name, '#', 2) AS number FROM customer")
def split_once(spark, sf_dir):
    return cols.split_column(read(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_name", "#", ["kind", "number"])


@query("""
SELECT s_suppkey, split_part(s_name, '#', 1) AS a,
       CASE WHEN strpos(s_name, '#') > 0 THEN split_part(substr(s_name, strpos(s_name, '#') + 1), '-', 1) END AS b,
       CASE WHEN strpos(substr(s_name, strpos(s_name, '#') + 1), '-') > 0 AND strpos(s_name, '#') > 0
            THEN substr(substr(s_name, strpos(s_name, '#') + 1), strpos(substr(s_name, strpos(s_name, '#') + 1), '-') + 1) END AS c
FROM supplier""")
def split_multi_pad(spark, sf_dir):
    return cols.split_column(read(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), "s_name", ["#", "-"], ["a", "b", "c"])


@query("SELECT p_partkey, regexp_extract(p_brand, '^[^0-9]+') AS letters, regexp_replace(p_brand, '^[^0-9]+', '') AS digits FROM part")
def split_alpha_digit(spark, sf_dir):
    return cols.split_column(read(spark, sf_dir, "part").select("p_partkey", "p_brand"), "p_brand", "%", ["letters", "digits"])


@query("SELECT p_partkey, '木香薷' AS chinese, p_name AS latin FROM part")
def split_cjk(spark, sf_dir):
    parts = read(spark, sf_dir, "part").select("p_partkey", text("木香薷 ", F.col("p_name")).alias("n"))
    return cols.split_column(parts, "n", "$", ["chinese", "latin"])


def _part(spark, sf_dir):
    """part with nulls in some columns."""
    size = F.when(F.col("p_partkey") % 3 != 0, F.col("p_size"))
    brand = F.when(F.col("p_partkey") % 2 != 0, F.col("p_brand"))
    kind = F.when(F.col("p_partkey") % 6 != 0, F.col("p_type"))
    return read(spark, sf_dir, "part").select("p_partkey", brand.alias("brand"), size.alias("size"), kind.alias("kind"))


_PART = "(SELECT p_partkey, CASE WHEN p_partkey % 2 <> 0 THEN p_brand END AS brand, CASE WHEN p_partkey % 3 <> 0 THEN p_size END AS size, CASE WHEN p_partkey % 6 <> 0 THEN p_type END AS kind FROM part) p"


@query(f"SELECT p_partkey, nullif(concat_ws(', ', brand, size, kind), '') AS m FROM {_PART}")
def merge_sep(spark, sf_dir):
    return cols.merge_columns(_part(spark, sf_dir), ["brand", "size", "kind"], ", ", "m")


@query(f"""SELECT p_partkey, CASE WHEN s IS NULL THEN kind WHEN kind IS NULL THEN s ELSE s || '; ' || kind END AS m
FROM (SELECT *, CASE WHEN brand IS NULL THEN CAST(size AS VARCHAR) WHEN size IS NULL THEN brand ELSE brand || '-' || size END AS s FROM {_PART})""")
def merge_multi_sep(spark, sf_dir):
    return cols.merge_columns(_part(spark, sf_dir), ["brand", "size", "kind"], ["-", "; "], "m")


@query(f"SELECT p_partkey, nullif(concat_ws(chr(10), 'brand：' || brand, 'size：' || size, 'kind：' || kind), '') AS m FROM {_PART}")
def merge_kv_lines(spark, sf_dir):
    return cols.merge_columns(_part(spark, sf_dir), ["brand", "size", "kind"], "r", "m")


@query(f"SELECT p_partkey, nullif(concat_ws('；', 'brand：' || brand, 'size：' || size, 'kind：' || kind), '') AS m FROM {_PART}")
def merge_kv_text(spark, sf_dir):
    return cols.merge_columns(_part(spark, sf_dir), ["brand", "size", "kind"], "t", "m")


@query(f"""SELECT p_partkey, CASE WHEN brand IS NULL AND kind IS NULL THEN NULL ELSE
  '{{' || concat_ws(', ', '"brand": "' || brand || '"', '"kind": "' || kind || '"') || '}}' END AS m FROM {_PART}""")
def merge_json_object(spark, sf_dir):
    return cols.merge_columns(_part(spark, sf_dir).drop("size"), ["brand", "kind"], "o", "m")


@query(f"""SELECT p_partkey, CASE WHEN brand IS NULL AND kind IS NULL THEN NULL ELSE
  '[' || concat_ws(', ', '"' || brand || '"', '"' || kind || '"') || ']' END AS m FROM {_PART}""")
def merge_json_array(spark, sf_dir):
    return cols.merge_columns(_part(spark, sf_dir).drop("size"), ["brand", "kind"], "a", "m")


@query(f"SELECT p_partkey, brand AS b, kind AS k, brand IS NULL AND kind IS NULL AS missing FROM {_PART}")
def merge_struct(spark, sf_dir):
    one = cols.merge_columns(_part(spark, sf_dir).drop("size"), ["brand", "kind"], "d", "m")
    return one.select("p_partkey", F.col("m.brand").alias("b"), F.col("m.kind").alias("k"), F.col("m").isNull().alias("missing"))


@query(f"SELECT p_partkey, CAST((brand IS NOT NULL)::INT + (kind IS NOT NULL)::INT AS BIGINT) AS n, coalesce(brand, kind) AS first FROM {_PART}")
def merge_list(spark, sf_dir):
    one = cols.merge_columns(_part(spark, sf_dir).drop("size"), ["brand", "kind"], "l", "m")
    return one.select("p_partkey", F.when(F.col("m").isNull(), 0).otherwise(F.size("m")).cast("long").alias("n"), F.get("m", F.lit(0)).alias("first"))


@query("SELECT n_nationkey, n_name AS name, n_name AS name_ FROM nation")
def append_suffix(spark, sf_dir):
    nation = read(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("name"))
    return cols.append_columns(nation, {"name": F.col("name")})


@query("SELECT split_part(c_name, '#', 1) AS kind, split_part(c_name, '#', 2) AS number, c_mktsegment AS segment, CAST(c_custkey AS VARCHAR) || '/' || c_nationkey AS place FROM customer")
def mapping_by_dict(spark, sf_dir):
    customer = read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    return cols.table_mapping(customer, {"c_mktsegment": "segment", ("c_name", "#"): ("kind", "number"), ("c_custkey", "c_nationkey", "/"): "place"})


# --- models and alignment --------------------------------------------------------------------


@query("SELECT o_orderkey AS key, o_orderpriority AS priority FROM orders")
def rename_cut(spark, sf_dir):
    return Model([("key", "$o_orderkey"), ("priority", "$o_orderpriority")])(read(spark, sf_dir, "orders"))


@query("SELECT o_orderkey AS key, o_orderpriority, o_orderstatus, o_custkey FROM orders")
def rename_keep(spark, sf_dir):
    return Model([("key", "$o_orderkey")], cut=False)(read(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus", "o_custkey"))


@query("SELECT o_orderkey AS key, o_orderpriority AS p FROM orders")
def choice_first(spark, sf_dir):
    return Model([("key", "$o_orderkey"), ("p", ["$not_there", "$o_orderpriority", "$o_orderstatus"])])(read(spark, sf_dir, "orders"))


@query("SELECT o_orderkey AS key, 'none' AS remarks FROM orders")
def fill_missing(spark, sf_dir):
    return Model([("key", "$o_orderkey"), ("remarks_", "$not_there"), ("gone", "$nor_this")], fill="none")(read(spark, sf_dir, "orders"))


@query("""SELECT id, kind, CASE WHEN CAST(n AS BIGINT) <= 100 THEN CAST(CAST(n AS BIGINT) AS VARCHAR) ELSE '!' || n END AS number, place, raw
FROM (SELECT c_custkey AS id, split_part(c_name, '#', 1) AS kind, split_part(c_name, '#', 2) AS n, c_mktsegment || ' ' || c_nationkey AS place, c_name AS raw FROM customer)""")
def model_occurrence(spark, sf_dir):
    model = Model([
        ("id", "$c_custkey"), ("raw__", "$c_name"), ("kind__number", {"$c_name": "#"}), ("place", ("$c_mktsegment", "$c_nationkey", " ")),
        ("number", C.Number("$number", kind="int", least=0, most=100)),
    ])
    return model(read(spark, sf_dir, "customer"))


@query("SELECT c_custkey AS catalogNumber, c_name AS recordedBy, c_nationkey AS country, c_mktsegment FROM customer")
def align_headers(spark, sf_dir):
    aliases = {"catalogNumber": ["C_CUSTKEY", "NO"], "recordedBy": ["C_NAME", "COLLECTOR"], "country": ["C_NATIONKEY"]}
    customer = read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    return alignment.align(customer, aliases)


@query("SELECT c_custkey AS b, c_name || '/' || c_mktsegment AS a FROM customer")
def align_expression(spark, sf_dir):
    customer = read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    for expression in ("1/2=0", "0=1"):
        customer = cols.table_mapping(customer, alignment.parse_expression(expression, ["c_custkey", "c_name", "c_mktsegment"], ["a", "b"]))
    return customer


def _specimens(spark, sf_dir) -> DataFrame:
    """Specimen records made from customers, all columns text."""
    k = F.col("c_custkey")
    return read(spark, sf_dir, "customer").select(
        k.cast("string").alias("catalogNumber"), text("A.", F.col("c_mktsegment")).alias("recordedBy"), text("19", F.lpad((k % 90 + 10).cast("string"), 2, "0"), ".8.24").alias("eventDate"),
        text("N", k % 80, "°30′,E", k % 100 + 1, "°15′").alias("verbatimCoordinates"), text(k % 700 + 200, "-", k % 200, "m").alias("verbatimElevation"),
        text("Carex sp", F.translate(k.cast("string"), "0123456789", "abcdefghij"), " L. var. minor Hook.").alias("scientificName"), F.when(k % 2 == 0, "holotype").otherwise("主模").alias("typeStatus"),
        F.lit("中国").alias("country"), F.lit("云南省").alias("province"),
    )


_SPECIES = "'sp' || translate(CAST(c_custkey AS VARCHAR), '0123456789', 'abcdefghij')"
_DAY = "'19' || lpad(CAST(c_custkey % 90 + 10 AS VARCHAR), 2, '0')"


@query(f"""SELECT CAST(c_custkey AS VARCHAR) AS "条形码", 'holotype' AS "模式类型", 'A. ' || c_mktsegment AS "采集人", {_DAY} || '0824' AS "采集日期", 'Carex' AS "属", {_SPECIES} AS "种",
  'L.' AS "定名人", 'var. minor' AS "种下等级", 'Hook.' AS "种下等级定名人", CAST(c_custkey % 80 + 0.5 AS DOUBLE) || '' AS "纬度", CAST(c_custkey % 100 + 1.25 AS DOUBLE) || '' AS "经度",
  CAST(least(c_custkey % 700 + 200, c_custkey % 200) AS DOUBLE) || '' AS low FROM customer""")
def model_portal(spark, sf_dir):
    """A ready model: the herbarium portal's table."""
    made = models.herbarium_portal()(_specimens(spark, sf_dir))
    low = F.when(F.col("海拔").cast("double") < F.col("海拔高").cast("double"), F.col("海拔")).otherwise(F.when(F.col("海拔高") == "0.0", "0.0").otherwise(F.col("海拔")))
    wide = made.withColumn("low", F.when(F.col("海拔") == F.col("海拔高"), "0.0").otherwise(low))
    return wide.select("条形码", "模式类型", "采集人", "采集日期", "属", "种", "定名人", "种下等级", "种下等级定名人", "纬度", "经度", "low")


@query(f"""SELECT CAST(c_custkey AS VARCHAR) AS "catalogNumber", 'A. ' || c_mktsegment AS "recordedBy", {_DAY} || '-08-24T00:00:00+08:00' AS "eventDate", 'Carex ' || {_SPECIES} || ' var. minor Hook.' AS name FROM customer""")
def model_nested(spark, sf_dir):
    """A ready model: the nested record, from which members are read again."""
    made = models.nested_occurrence()(_specimens(spark, sf_dir))
    return made.select(F.col("Occurrence.catalogNumber"), F.col("Occurrence.recordedBy"), F.col("Event.eventDate"), F.col("Identification")[0]["scientificName"].alias("name"))


# --- files -----------------------------------------------------------------------------------


@query("SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name || chr(10) || '\"quoted\", text' AS n_name FROM nation")
def source_csv(spark, sf_dir):
    """Written and read again as text; quoted fields hold line breaks, quotes and commas."""
    path = cluster.shared_path(spark, "nation.csv")
    files.save(read(spark, sf_dir, "nation").select("n_nationkey", text(F.col("n_name"), '\n"quoted", text').alias("n_name")), path)
    return files.load(spark, path)


@query("SELECT c_custkey, c_name, c_acctbal FROM customer")
def source_json(spark, sf_dir):
    path = cluster.shared_path(spark, "customer.json")
    files.save(read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal"), path)
    return files.load(spark, path, multiLine=False)


# --- numbers ---------------------------------------------------------------------------------


@query("SELECT p_partkey, CAST(p_size AS DOUBLE) AS n FROM part")
def number_single(spark, sf_dir):
    stage = Staging()
    n = numbers.number(stage, text("约", F.col("p_size"), "m"))
    return stage.select(read(spark, sf_dir, "part"), "p_partkey", n.value.alias("n"))


@query("""SELECT l_orderkey, l_linenumber, least(a, b) AS low, greatest(a, b) AS high FROM
(SELECT l_orderkey, l_linenumber, CAST(l_orderkey % 900 + 1 AS BIGINT) AS a, CAST(l_partkey % 700 + 1 AS BIGINT) AS b FROM lineitem)""")
def number_range(spark, sf_dir):
    item = read(spark, sf_dir, "lineitem")
    stage = Staging()
    both = numbers.number_range(stage, text("大概", F.col("l_orderkey") % 900 + 1, "～", F.col("l_partkey") % 700 + 1, "米"), F.lit(None).cast("string"), kind="int")
    return stage.select(item, "l_orderkey", "l_linenumber", both.low.value.alias("low"), both.high.value.alias("high"))


@query("SELECT p_partkey, CASE WHEN p_size <= 25 THEN CAST(p_size AS VARCHAR) || '.0' ELSE '!' || p_size || 'm' END AS n FROM part")
def number_flagged(spark, sf_dir):
    stage = Staging()
    n = numbers.number(stage, text(F.col("p_size"), "m"), least=0, most=25)
    return stage.select(read(spark, sf_dir, "part"), "p_partkey", n.shown().alias("n"))


@query("SELECT p_partkey, CAST(p_partkey AS BIGINT) AS n, '!' || translate(CAST(p_partkey AS VARCHAR), '0123456789', '０１２３４５６７８９') || '；１' AS issue FROM part")
def number_scripts(spark, sf_dir):
    """Digits of another script."""
    stage, wide = Staging(), F.translate(F.col("p_partkey").cast("string"), "0123456789", "０１２３４５６７８９")
    one = numbers.number(stage, text(wide, "米"), kind="int", least=0, most=1e15)
    two = numbers.number(stage, text(wide, "；１"))
    return stage.select(read(spark, sf_dir, "part"), "p_partkey", one.value.alias("n"), two.shown().alias("issue"))


# --- dates -----------------------------------------------------------------------------------

_TODAY = "DATE '2024-01-01'"


def _dates(spark, sf_dir, raw: Callable[[Column], Column], style: str = "num", mark: bool = True) -> DataFrame:
    day = F.col("o_orderdate").cast("date")
    stage = Staging()
    found = dates.format_date(stage, raw(day), style, "+08:00", mark, F.lit("2024-01-01").cast("date"))
    return stage.select(read(spark, sf_dir, "orders"), "o_orderkey", found.shown().alias("d"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y%m%d') AS d FROM orders")
def date_num(spark, sf_dir):
    return _dates(spark, sf_dir, lambda d: F.date_format(d, "yyyy.MM.dd"))


@query("SELECT o_orderkey, year(o_orderdate) || '-' || month(o_orderdate) || '-' || day(o_orderdate) AS d FROM orders")
def date_iso(spark, sf_dir):
    return _dates(spark, sf_dir, lambda d: F.date_format(d, "yyyyMMdd"), "date")


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT00:00:00') || '+08:00' AS d FROM orders")
def date_utc(spark, sf_dir):
    return _dates(spark, sf_dir, lambda d: F.date_format(d, "d MMM yyyy"), "utc")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%Y') || '-' || month(o_orderdate) || '-01 00:00:01'
  ELSE strftime(o_orderdate, '%Y') || '-01-01 00:00:02' END AS d FROM orders""")
def date_partial(spark, sf_dir):
    day = F.col("o_orderdate")
    return _dates(spark, sf_dir, lambda d: F.when(F.col("o_orderkey") % 2 == 0, F.date_format(day, "yyyy/MM")).otherwise(F.date_format(day, "yyyy")), "datetime")


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y%m%d') AS d FROM orders")
def date_roman(spark, sf_dir):
    return _dates(spark, sf_dir, lambda d: text(F.dayofmonth(d), " ", F.get(F.array(*[F.lit(r) for r in dates.ROMAN]), F.month(d) - 1), " ", F.year(d)))


@query("""SELECT o_orderkey, CASE WHEN month(o_orderdate) IN (1, 3, 5, 7, 8, 10, 12) THEN strftime(o_orderdate, '%Y%m') || '31'
  ELSE '!' || strftime(o_orderdate, '%Y-%m') || '-31' END AS d FROM orders""")
def date_bad(spark, sf_dir):
    return _dates(spark, sf_dir, lambda d: text(F.date_format(d, "yyyy-MM"), "-31"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') || ' 0' || (o_orderkey % 9 + 1) || ':30:00' AS d FROM orders")
def date_time(spark, sf_dir):
    return _dates(spark, sf_dir, lambda d: text(F.date_format(d, "yyyy-MM-dd"), "T0", F.col("o_orderkey") % 9 + 1, ":30:00Z"), "datetime")


# --- coordinates -----------------------------------------------------------------------------


def _points(spark, sf_dir, raw: Callable[[Column, Column, Column], Column]) -> DataFrame:
    item = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_orderkey") % 80).alias("a"), (F.col("l_partkey") % 60).alias("b"), (F.col("l_suppkey") % 60).alias("c"))
    stage = Staging()
    both = geo.coordinates(stage, raw(F.col("a"), F.col("b"), F.col("c")))
    return stage.select(item, "l_orderkey", "l_linenumber", both.latitude.value.alias("lat"), both.longitude.value.alias("lon"), both.latitude.issue.alias("issue"))


_POINTS = "(SELECT l_orderkey, l_linenumber, l_orderkey % 80 AS a, l_partkey % 60 AS b, l_suppkey % 60 AS c FROM lineitem)"


@query(f"SELECT l_orderkey, l_linenumber, round(a + b / 60.0 + c / 3600.0, 6) AS lat, 0.0 - round(a + 90 + c / 60.0 + b / 3600.0, 6) AS lon, CAST(NULL AS VARCHAR) AS issue FROM {_POINTS}")
def geo_dms(spark, sf_dir):
    return _points(spark, sf_dir, lambda a, b, c: text("N", a, "°", b, "′", c, "″, W", a + 90, "°", c, "′", b, "″"))


@query(f"SELECT l_orderkey, l_linenumber, 0.0 - round(a + (b + 0.25) / 60.0, 6) AS lat, round(a + 90 + c / 60.0, 6) AS lon, CAST(NULL AS VARCHAR) AS issue FROM {_POINTS}")
def geo_dm(spark, sf_dir):
    return _points(spark, sf_dir, lambda a, b, c: text(a + 90, "°", c, "′E; ", a, "°", b, ".25′S"))


@query(f"SELECT l_orderkey, l_linenumber, 0.0 - (a + b / 100.0) AS lat, a + 90 + c / 100.0 AS lon, CAST(NULL AS VARCHAR) AS issue FROM {_POINTS}")
def geo_decimal(spark, sf_dir):
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    return _points(spark, sf_dir, lambda a, b, c: text("-", a, ".", two(b), ",", a + 90, ".", two(c)))


@query(f"SELECT l_orderkey, l_linenumber, CAST(NULL AS DOUBLE) AS lat, CAST(NULL AS DOUBLE) AS lon, 'N' || (a + 91) || '°' || b || '′' AS issue FROM {_POINTS}")
def geo_bad(spark, sf_dir):
    return _points(spark, sf_dir, lambda a, b, c: text("N", a + 91, "°", b, "′,E", a, "°", c, "′"))


# --- people, vocabularies, URLs --------------------------------------------------------------


@query("""SELECT c_custkey, 'A. B. Smith' || '，' || 'J. Hooker' || '，' || c_mktsegment || '，' || '王　小明' AS names, '!' || c_mktsegment || ', Smith 12' AS wrong FROM customer""")
def people_latin(spark, sf_dir):
    stage = Staging()
    names = people.person_names(stage, text("A.B.  Smith, J.Hooker; ", F.col("c_mktsegment"), " & 王　小明"))
    wrong = people.person_names(stage, text(F.col("c_mktsegment"), ", Smith12")).shown()
    return stage.select(read(spark, sf_dir, "customer"), "c_custkey", names.shown().alias("names"), F.replace(wrong, F.lit("Smith12"), F.lit("Smith 12")).alias("wrong"))


@query("""SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN '王小明，李四' WHEN 1 THEN NULL WHEN 2 THEN '!王，李四' ELSE '张三|12，欧阳修' END AS names FROM nation""")
def people_cjk(spark, sf_dir):
    k = F.col("n_nationkey") % 4
    raw = F.when(k == 0, "王 小明, 李四").when(k == 1, "佚名").when(k == 2, "王，李四").otherwise("张三|12；欧 阳修")
    stage = Staging()
    names = people.person_names(stage, raw)
    return stage.select(read(spark, sf_dir, "nation"), "n_nationkey", names.shown().alias("names"))


@query("SELECT c_custkey, c_name AS plain, '!' || c_name || '|12' AS flagged FROM customer")
def strip_collector_id(spark, sf_dir):
    return read(spark, sf_dir, "customer").select("c_custkey", people.without_ids(text(F.col("c_name"), "|12")).alias("plain"), people.without_ids(text("!", F.col("c_name"), "|12")).alias("flagged"))


_PRIORITY = {"high": ["1-URGENT", "2-HIGH"], "other": ["3-MEDIUM", "2-HIGH"], "4-NOT SPECIFIED": []}


@query("SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'high' WHEN '2-HIGH' THEN 'high' WHEN '3-MEDIUM' THEN 'other' ELSE o_orderpriority END AS p FROM orders")
def vocab_keep(spark, sf_dir):
    return read(spark, sf_dir, "orders").select("o_orderkey", vocab.standardised(F.col("o_orderpriority"), _PRIORITY).alias("p"))


@query("""SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'high' WHEN '2-HIGH' THEN 'high' WHEN '3-MEDIUM' THEN 'other'
  WHEN '4-NOT SPECIFIED' THEN o_orderpriority ELSE '!' || o_orderpriority END AS p FROM orders""")
def vocab_flag(spark, sf_dir):
    return read(spark, sf_dir, "orders").select("o_orderkey", vocab.standardised(F.col("o_orderpriority"), _PRIORITY, "flag").alias("p"))


@query("""SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'high' WHEN '2-HIGH' THEN 'high' WHEN '3-MEDIUM' THEN 'other'
  WHEN '4-NOT SPECIFIED' THEN o_orderpriority ELSE NULL END AS o_orderpriority FROM orders""")
def vocab_table(spark, sf_dir):
    table = vocab.as_table(spark, _PRIORITY)
    return vocab.standardise_by_table(read(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", table, "null")


@query("SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN '♂' WHEN 1 THEN '♀' WHEN 2 THEN '☉' ELSE '!' || c_mktsegment END AS sex, CASE WHEN c_custkey % 2 = 0 THEN '极少' ELSE '常见' END AS often FROM customer")
def vocab_standard(spark, sf_dir):
    """The standard vocabularies; an ambiguous alias is the first term that lists it."""
    k = F.col("c_custkey")
    raw = F.when(k % 4 == 0, "Male").when(k % 4 == 1, "雌性").when(k % 4 == 2, "☉").otherwise(F.col("c_mktsegment"))
    sex = vocab.standardised(raw, VOCABULARIES["sex"], "flag")
    often = vocab.standardised(F.when(k % 2 == 0, "个别").otherwise("尚多"), VOCABULARIES["frequency"])
    return read(spark, sf_dir, "customer").select("c_custkey", sex.alias("sex"), often.alias("often"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'even' ELSE '!' || c_name END AS word FROM customer")
def vocab_joined(spark, sf_dir):
    """A vocabulary of as many entries as the table has even keys, in a model, which joins it."""
    customer = read(spark, sf_dir, "customer")
    even = customer.where("c_custkey % 2 = 0").select(F.lit("even").alias("standard"), F.col("c_custkey").cast("string").alias("alias"), F.lit(0).cast("long").alias("ord"))
    model = Model([("c_custkey", "$c_custkey"), ("c_name", "$c_name"), ("word__", C.RadioInput("$c_custkey", even, "null"))])
    return model(customer).select("c_custkey", F.coalesce("word", text("!", F.col("c_name"))).alias("word"))


@query("SELECT o_orderpriority AS value, count(*) AS n FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED') GROUP BY 1")
def vocab_unmatched(spark, sf_dir):
    return vocab.unmatched_values(read(spark, sf_dir, "orders"), "o_orderpriority", _PRIORITY)


@query("SELECT page_id, CAST(2 AS BIGINT) AS n, regexp_extract(url, '^[^,|\"'']+') AS first FROM pages")
def url_extract(spark, sf_dir):
    found = urls.urls(text(F.col("url"), "|x ", F.col("url")))
    return read(spark, sf_dir, "pages").select("page_id", F.size(found).cast("long").alias("n"), F.get(found, F.lit(0)).alias("first"))


# --- duplicates and nulls --------------------------------------------------------------------


@query("SELECT l_linenumber, CASE WHEN count(*) OVER (PARTITION BY l_orderkey) > 1 THEN '!' ELSE '' END || l_orderkey AS l_orderkey FROM lineitem")
def dup_mark(spark, sf_dir):
    return rows.mark_duplicates(read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), ["l_orderkey"])


@query("""SELECT CAST(nullif(l_linenumber, 3) AS VARCHAR) AS l_linenumber, CASE WHEN count(*) OVER (PARTITION BY l_orderkey, nullif(l_linenumber, 3)) > 1 THEN '!' ELSE '' END || l_orderkey AS l_orderkey
FROM lineitem""")
def dup_mark_multi(spark, sf_dir):
    item = read(spark, sf_dir, "lineitem").select("l_orderkey", F.nullif(F.col("l_linenumber"), F.lit(3)).cast("string").alias("l_linenumber"))
    return rows.mark_duplicates(item, ["l_orderkey", "l_linenumber"])


_EVENTS = "(SELECT event_id, user_id, ts, CASE WHEN event_id % 3 = 0 THEN value END AS v FROM events)"


def _events(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", "user_id", "ts", F.when(F.col("event_id") % 3 == 0, F.col("value")).alias("v"))


@query(f"SELECT event_id, coalesce(v, 0.5) AS v FROM {_EVENTS}")
def fill_value(spark, sf_dir):
    return rows.fill_value(_events(spark, sf_dir).select("event_id", "v"), ["v"], 0.5)


@query(f"SELECT event_id, user_id, last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS v FROM {_EVENTS}")
def fill_forward(spark, sf_dir):
    return rows.fill_along(_events(spark, sf_dir), ["v"], ["ts", "event_id"], ["user_id"]).select("event_id", "user_id", "v")


@query(f"""SELECT event_id, coalesce(v, lag(v, 1) OVER w) AS v FROM {_EVENTS} WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def fill_limit(spark, sf_dir):
    return rows.fill_along(_events(spark, sf_dir), ["v"], ["ts", "event_id"], ["user_id"], limit=1).select("event_id", "v")


@query("""SELECT o_orderkey, last_value(CASE WHEN o_orderkey % 5 = 0 THEN o_orderstatus END IGNORE NULLS) OVER (ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS s FROM orders""")
def fill_whole(spark, sf_dir):
    """The whole table in one order, in blocks."""
    orders = read(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 5 == 0, F.col("o_orderstatus")).alias("s"))
    return rows.fill_along(orders, ["s"], ["o_orderkey"], block_rows=1000)


@query("SELECT c_custkey, CAST(nullif(c_nationkey, 3) AS DOUBLE) AS a, CAST(coalesce(CASE WHEN c_custkey % 2 = 0 THEN c_nationkey + 100 END, nullif(c_nationkey, 3)) AS DOUBLE) AS b FROM customer")
def fill_across(spark, sf_dir):
    nation = F.col("c_nationkey").cast("double")
    customer = read(spark, sf_dir, "customer").select("c_custkey", F.nullif(nation, F.lit(3.0)).alias("a"), F.when(F.col("c_custkey") % 2 == 0, nation + 100).alias("b"))
    return rows.fill_across(customer, ["a", "b"])


# --- taxon names -----------------------------------------------------------------------------


def _epithet(c: Column) -> Column:
    return F.concat(F.lit("sp"), F.translate(F.lower(c), "0123456789# ", "abcdefghij"))


_EPITHET = "'sp' || translate(lower(p_brand), '0123456789# ', 'abcdefghij')"


@query(f"SELECT p_partkey, 'Carex ' || {_EPITHET} || ' var. minor' AS s FROM part")
def taxon_simple(spark, sf_dir):
    raw = text("Carex ", _epithet(F.col("p_brand")), " L. var. minor Hook.")
    stage = Staging()
    (name,) = taxon.styled_name(stage, raw, "simpleName")
    return stage.select(read(spark, sf_dir, "part"), "p_partkey", name.alias("s"))


@query(f"SELECT p_partkey, 'Carex' AS genus, {_EPITHET} AS species, 'L.' AS first_authors, 'subsp.' AS taxon_rank, 'minor' AS infraspecies, '(Hook.) Benth.' AS authors FROM part")
def taxon_split(spark, sf_dir):
    raw = text("Carex ", _epithet(F.col("p_brand")), " L. subsp. minor (Hook.) Benth.")
    stage = Staging()
    parts = taxon.styled_name(stage, raw, "fullPlantSplitName")
    return stage.select(read(spark, sf_dir, "part"), "p_partkey", *[p.alias(n) for p, n in zip(parts, taxon.STYLES["fullPlantSplitName"])])


@query(f"SELECT p_partkey, 'Poa ' || {_EPITHET} || ' L.' AS s, 'specific' AS level FROM part")
def taxon_autonym(spark, sf_dir):
    e = _epithet(F.col("p_brand"))
    stage = Staging()
    n = taxon.parsed_name(stage, text("Poa ", e, " L. var. ", e))
    return stage.select(read(spark, sf_dir, "part"), "p_partkey", n.scientific_name.alias("s"), n.platform_rank.alias("level"))


@query("SELECT p_partkey, 'A B ' || replace(p_name, ' ', ' Jones ') || ' ' || replace(p_brand, '#', ' ') AS author FROM part")
def author_clean(spark, sf_dir):
    raw = text("A.B. ", F.replace(F.col("p_name"), F.lit(" "), F.lit("-Jones ")), " ", F.replace(F.col("p_brand"), F.lit("#"), F.lit("'")), ".")
    return read(spark, sf_dir, "part").select("p_partkey", authors.clean_author(raw).alias("author"))


@query("""SELECT p_partkey, 'Pancic ' || p_name AS plain, 'O' || p_brand || 'ss' AS mapped, CAST(2 + p_partkey % 2 AS BIGINT) AS team,
  'B' || p_brand AS first FROM part""")
def author_letters(spark, sf_dir):
    brand, name = F.col("p_brand"), F.col("p_name")
    team = authors.author_team(text("Müll. ex B", brand, " & J.D.Hook.", F.when(F.col("p_partkey") % 2 == 1, " et Bá").otherwise(" et nom."), " in ", name))
    return read(spark, sf_dir, "part").select(
        "p_partkey", authors.strip_accents(text("Pančić ", name)).alias("plain"), authors.ascii_authors()(text("Ø", brand, "ß")).alias("mapped"),
        F.size(team).cast("long").alias("team"), F.get(team, F.lit(0)).alias("first"),
    )


# --- name resolution -------------------------------------------------------------------------


def _lib(spark, sf_dir, share: int) -> DataFrame:
    """A taxon list of part keys that the number divides, each name by two authors."""
    part = read(spark, sf_dir, "part").where(F.col("p_partkey") % share == 0)
    letters = lambda c: F.translate(c.cast("string"), "0123456789", "abcdefghij")
    each = part.select("p_partkey", F.explode(F.array(F.lit(" L."), F.lit(" Benth."))).alias("by"))
    return each.select(text("Carex sp", letters(F.col("p_partkey")), F.col("by")).alias("name"), (F.col("p_partkey") * 2 + (F.col("by") == " Benth.").cast("int")).alias("ord"))


def _queries(spark, sf_dir) -> DataFrame:
    letters = F.translate(F.col("p_partkey").cast("string"), "0123456789", "abcdefghij")
    by = F.when(F.col("p_partkey") % 3 == 0, " Benth.").when(F.col("p_partkey") % 3 == 1, " L.").otherwise("")
    return read(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("Carex sp"), letters, by).alias("q"))


_LETTERS = "'Carex sp' || translate(CAST(p_partkey AS VARCHAR), '0123456789', 'abcdefghij')"


@query(f"""SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN {_LETTERS} || CASE WHEN p_partkey % 3 = 0 THEN ' Benth.' ELSE ' L.' END END AS found,
  CASE WHEN p_partkey % 2 = 0 AND p_partkey % 3 <> 2 THEN 100.0::DOUBLE END AS score FROM part""")
def name_resolve_local(spark, sf_dir):
    lib = resolve.lookup_table(_lib(spark, sf_dir, 2), "name", "ord")
    return resolve.resolve(_queries(spark, sf_dir), "q", lib, {"found": "lib_name", "score": "score"}).select("p_partkey", "found", "score")


@query(f"""SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 OR p_partkey % 5 = 0 THEN {_LETTERS} || CASE WHEN p_partkey % 3 = 0 THEN ' Benth.' ELSE ' L.' END END AS std_name,
  CASE WHEN p_partkey % 2 = 0 THEN 'one' WHEN p_partkey % 5 = 0 THEN 'two' END AS provider FROM part""")
def resolve_cascade(spark, sf_dir):
    libs = [(n, resolve.lookup_table(_lib(spark, sf_dir, k), "name", "ord")) for n, k in (("one", 2), ("two", 5))]
    return resolve.resolve_cascade(_queries(spark, sf_dir), "q", libs).select("p_partkey", "std_name", "provider")


@query(f"SELECT {_LETTERS} || CASE p_partkey % 3 WHEN 0 THEN ' Benth.' WHEN 1 THEN ' L.' ELSE '' END AS raw FROM part WHERE p_partkey % 2 <> 0")
def resolve_uncached(spark, sf_dir):
    """All names are asked for; those of even keys were answered before."""
    queries = resolve.query_keys(_queries(spark, sf_dir), "q")
    return resolve.uncached(queries, _queries(spark, sf_dir).where("p_partkey % 2 = 0").select(F.col("q").alias("raw"))).select("raw")


@query(f"""SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN {_LETTERS} ELSE '!' || {_LETTERS} || CASE p_partkey % 3 WHEN 0 THEN ' Benth.' WHEN 1 THEN ' L.' ELSE '' END END AS name FROM part""")
def spell_check(spark, sf_dir):
    lib = resolve.lookup_table(_lib(spark, sf_dir, 2), "name", "ord")
    return resolve.spell_checked(_queries(spark, sf_dir), "q", [("one", lib)], ["name"], "simpleName").select("p_partkey", "name")


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END AS score FROM part")
def author_score(spark, sf_dir):
    """Equal texts score 100, but 0 where no author counts."""
    by = F.when(F.col("p_partkey") % 2 == 0, text("B", F.col("p_brand"))).otherwise(text("auct. ", F.lower("p_name")))
    return authors.with_scores(read(spark, sf_dir, "part").select("p_partkey", by.alias("q"), by.alias("c")), "q", "c", "score").select("p_partkey", "score")


def _asked(spark, sf_dir) -> DataFrame:
    """Names of the parts with authors, keyed as queries are."""
    return resolve.query_keys(_queries(spark, sf_dir).select(F.col("q")), "q")


def _answered(spark, sf_dir, body: Callable[[Column, Column], Column]) -> DataFrame:
    """What a service answers to each name, made from the part's key; no JSON to every seventh."""
    key = F.col("p_partkey").cast("string")
    name = F.concat(F.lit("Carex sp"), F.translate(key, "0123456789", "abcdefghij"))
    parts = _queries(spark, sf_dir).select("q", "p_partkey")
    return parts.select(F.col("q").alias("raw"), F.when(F.col("p_partkey") % 7 == 0, "busy").otherwise(body(name, key)).alias("answer"))


_SAID = "p_partkey % 7 <> 0"
_BY = "CASE p_partkey % 3 WHEN 0 THEN 'Benth.' ELSE 'L.' END"


@query(f"""SELECT {_LETTERS} || CASE p_partkey % 3 WHEN 0 THEN ' Benth.' WHEN 1 THEN ' L.' ELSE '' END AS raw, {_LETTERS} AS lib_name, {_BY} AS lib_authors,
  'Cyperaceae' AS family, 'urn:' || p_partkey || CASE p_partkey % 3 WHEN 0 THEN 'b' ELSE 'a' END AS ipni_lsid, CAST(NULL AS VARCHAR) AS publication, '1999' AS publication_year
FROM part WHERE {_SAID}""")
def service_ipni(spark, sf_dir):
    """Of two names of other authors and one unlike name, the one asked for; what is not stated is null."""
    def body(name, key):
        one = lambda n, by, mark: text('{"name":"', n, '","authors":"', by, '","authorTeam":[],"family":"Cyperaceae","fqId":"urn:', key, mark, '","publication":"not_stated","publicationYear":1999}')
        return text('{"results":[', one(text(name, "x"), "L.", "z"), ",", one(name, "L.", "a"), ",", one(name, "Benth.", "b"), "]}")

    best = resolve.best_answers(_asked(spark, sf_dir), answers.ipni(_answered(spark, sf_dir, body)), "ipni", ["family", "ipni_lsid", "lib_authors", "publication", "publication_year"])
    return best.select("raw", "lib_name", "lib_authors", "family", "ipni_lsid", "publication", "publication_year")


@query(f"""SELECT {_LETTERS} || CASE p_partkey % 3 WHEN 0 THEN ' Benth.' WHEN 1 THEN ' L.' ELSE '' END AS raw,
  CASE p_partkey % 3 WHEN 1 THEN 'Poa annua Sw.' ELSE {_LETTERS} || ' Benth.' END AS accepted_name, CAST(1 AS BIGINT) AS images FROM part WHERE {_SAID}""")
def service_powo(spark, sf_dir):
    """Without authors the accepted name is taken; a synonym tells whose it is."""
    def body(name, key):
        picture = '"images":[{"fullsize":"http://x"}]'
        return text('{"results":[{"name":"', name, '","author":"L.","accepted":false,', picture, ',"synonymOf":{"name":"Poa annua","author":"Sw."}},{"name":"', name, '","author":"Benth.","accepted":true,', picture, "}]}")

    best = resolve.best_answers(_asked(spark, sf_dir), answers.powo(_answered(spark, sf_dir, body)), "powo", ["accepted_name", "images"])
    return best.select("raw", "accepted_name", F.size("images").cast("long").alias("images"))


@query(f"""SELECT {_LETTERS} || CASE p_partkey % 3 WHEN 0 THEN ' Benth.' WHEN 1 THEN ' L.' ELSE '' END AS raw, p_partkey || CASE p_partkey % 3 WHEN 1 THEN '1' ELSE '2' END AS name_id,
  CASE p_partkey % 3 WHEN 1 THEN {_LETTERS} || ' L.' ELSE 'Poa annua L.' END AS accepted_name FROM part WHERE {_SAID}""")
def service_tropicos(spark, sf_dir):
    """Names need not be equal; without authors the legitimate one is taken; its accepted name comes from a second request."""
    def body(name, key):
        one = lambda k, by, status: text('{"NameId":', key, k, ',"ScientificName":"', name, ' sic","Author":"', by, '","ScientificNameWithAuthors":"', name, " ", by, '","NomenclatureStatusName":"', status, '"}')
        return text("[", one("1", "L.", "No opinion"), ",", one("2", "Benth.", "Legitimate"), "]")

    best = resolve.best_answers(_asked(spark, sf_dir), answers.tropicos(_answered(spark, sf_dir, body)), "tropicos", ["name_id", "full_name"])
    more = F.when(F.col("name_id").endswith("2"), '[{"AcceptedName":{"ScientificNameWithAuthors":"Poa annua L."}}]').otherwise('[{"Error":"none"}]')
    second = answers.tropicos_accepted(best.select(F.col("name_id").alias("raw"), more.alias("answer")))
    return resolve.accepted_of(best, second).select("raw", "name_id", "accepted_name")


@query(f"""SELECT {_LETTERS} || CASE p_partkey % 3 WHEN 0 THEN ' Benth.' WHEN 1 THEN ' L.' ELSE '' END AS raw, CASE p_partkey % 3 WHEN 0 THEN 'c2' WHEN 1 THEN 'c1' ELSE 'c2' END AS name_code,
  'Carex' AS genus, 'Poa x' AS synonym FROM part WHERE {_SAID}""")
def service_col(spark, sf_dir):
    def body(name, key):
        info = '"accepted_name_info":{"scientificName":"A","author":"B","Synonyms":[{"synonym":"Poa x"}],"taxonTree":{"genus":"Carex","family":"Cyperaceae"}}}'
        one = lambda code, by, status: text('{"scientific_name":"', name, '","author":"', by, '","name_code":"', code, '","name_status":"', status, '",', info)
        return text('{"code":200,"data":{"species":[', one("c1", "L.", "synonym"), ",", one("c2", "Benth.", "accepted name"), "]}}")

    best = resolve.best_answers(_asked(spark, sf_dir), answers.col(_answered(spark, sf_dir, body)), "col", ["name_code", "genus", "synonyms"])
    return best.select("raw", "name_code", "genus", F.get("synonyms", F.lit(0)).alias("synonym"))


_GAZETTEER = ("中国", "中国::云南省", "中国::云南省::大理州", "中国::云南省::大理州::洱源县", "中国::河北省", "中国::天津市::天津市::河北区")


@query("""SELECT n_nationkey, CASE n_nationkey % 3 WHEN 2 THEN '不丹' ELSE '中国' END AS country, CASE n_nationkey % 3 WHEN 0 THEN '云南省' WHEN 1 THEN '河北省' END AS province,
  CASE n_nationkey % 3 WHEN 0 THEN '大理州' END AS city, CASE n_nationkey % 3 WHEN 0 THEN '洱源县' END AS county FROM nation""")
def admin_match(spark, sf_dir):
    k = F.col("n_nationkey") % 3
    raw = F.when(k == 0, "云南省大理州洱源县").when(k == 1, "中国::河北省").otherwise("不丹")
    return admin.match_divisions(read(spark, sf_dir, "nation").select("n_nationkey", raw.alias("r")), "r", _GAZETTEER).drop("r")


# --- validation ------------------------------------------------------------------------------


def _records(spark, sf_dir) -> DataFrame:
    priority = F.when(F.col("o_orderkey") % 7 == 0, text("!", F.col("o_orderpriority"))).otherwise(F.col("o_orderpriority"))
    return read(spark, sf_dir, "orders").select(
        F.struct(F.col("o_orderkey").alias("id"), priority.alias("priority")).alias("Order"), F.array(F.struct(F.col("o_orderstatus").alias("status"))).alias("States"),
        F.struct(F.col("o_totalprice").alias("price")).alias("Sum"),
    )


_SCHEMA = {
    "required": ["Order", "Sum"],
    "properties": {
        "Order": {"type": "object", "required": ["id"], "properties": {"priority": {"type": "string", "pattern": "^[1-4]-"}}},
        "States": {"type": "array", "items": {"type": "object", "properties": {"status": {"enum": ["F", "O"]}}}},
        "Sum": {"type": "object", "properties": {"price": {"type": "number", "minimum": 0, "maximum": 300000}}},
    },
}


@query("SELECT o_orderkey % 7 = 0 AS dirty, count(*) AS n FROM orders GROUP BY 1")
def dirty_route(spark, sf_dir):
    records = _records(spark, sf_dir)
    return records.groupBy(validate.any_dirty(records).alias("dirty")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT CASE WHEN o_orderkey % 7 = 0 THEN 'needcheck' WHEN o_orderpriority SIMILAR TO '[1-4]-.*' AND o_orderstatus IN ('F', 'O') AND o_totalprice BETWEEN 0 AND 300000 THEN 'ready'
  ELSE 'unvalid' END AS status, count(*) AS n FROM orders GROUP BY 1""")
def schema_route(spark, sf_dir):
    return validate.status_counts(validate.route(_records(spark, sf_dir), _SCHEMA))


@query("""SELECT CASE WHEN o_orderkey % 11 = 0 THEN 'needcheck' WHEN o_orderkey % 3 < 2 AND o_orderkey % 5 < 4 AND o_orderkey % 200 <= 90 THEN 'ready' ELSE 'unvalid' END AS status, count(*) AS n
FROM orders GROUP BY 1""")
def schema_occurrence(spark, sf_dir):
    """The schema of occurrence records with its terms: sexes and types that are none, latitudes out of bounds, flagged names."""
    k = F.col("o_orderkey")
    sex = F.when(k % 3 == 0, "♂").when(k % 3 == 1, "♀").otherwise("male")
    kind = F.when(k % 5 < 4, "holotype").otherwise("holo")
    collector = F.when(k % 11 == 0, "!A.").otherwise("A.")
    records = read(spark, sf_dir, "orders").select(
        F.struct(text("urn:", k).alias("occurrenceID"), collector.alias("recordedBy"), sex.alias("sex")).alias("Occurrence"),
        F.struct(F.lit("中国").alias("country"), (k % 200).cast("double").alias("decimalLatitude")).alias("Location"),
        F.array(F.struct(F.lit("Poa annua").alias("scientificName"), kind.alias("typeStatus"))).alias("Identification"),
        F.struct(*[F.lit(v).alias(c) for c, v in (("basisOfRecord", "馆藏标本"), ("dataFrom", "x"), ("rightsHolder", "y"), ("license", "z"))]).alias("Record"),
    )
    return validate.status_counts(validate.route(records, validate.occurrence_schema()))


# --- labels ----------------------------------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber, unnest(range(1, l_linenumber))::INT AS copy FROM lineitem")
def label_expand(spark, sf_dir):
    item = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_linenumber") - 1).alias("duplicatesOfLabel"))
    return labels.copies(item).select("l_orderkey", "l_linenumber", "copy")


@query("""SELECT c_custkey, 'HB-' || CASE WHEN length(CAST(n AS VARCHAR)) < 3 THEN lpad(CAST(n AS VARCHAR), 3, '0') ELSE CAST(n AS VARCHAR) END AS catalogNumber
FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) + 97 AS n FROM customer)""")
def label_codes(spark, sf_dir):
    return labels.running_codes(read(spark, sf_dir, "customer").select("c_custkey"), "HB-098", ["c_custkey"])


@query("SELECT n_nationkey, '<b>' || n_name || '</b>' || CASE WHEN n_regionkey = 0 THEN '<i>zero</i>' ELSE '' END || CASE WHEN n_nationkey % 2 = 0 THEN '' ELSE 'odd' END AS label FROM nation")
def label_render(spark, sf_dir):
    nation = read(spark, sf_dir, "nation").select("n_nationkey", "n_name", F.when(F.col("n_regionkey") == 0, "zero").alias("zero"), F.when(F.col("n_nationkey") % 2 == 0, "even").alias("even"))
    return labels.rendered(nation, "<b>{{n_name}}</b>{{#zero}}<i>{{{zero}}}</i>{{/zero}}{{^even}}odd{{/even}}").select("n_nationkey", "label")


@query("""SELECT page, count(*) AS n, string_agg(n_name, ',' ORDER BY n_nationkey) AS names
FROM (SELECT *, CAST((row_number() OVER (ORDER BY n_nationkey) - 1) // 6 AS BIGINT) AS page FROM nation) GROUP BY page""")
def label_pages(spark, sf_dir):
    sheets = labels.pages(read(spark, sf_dir, "nation").withColumn("label", F.col("n_name")), ["n_nationkey"])
    cells = F.regexp_extract_all("html", F.lit(r"mm\">([^<]*)</div>"), F.lit(1))
    return sheets.select("page", F.size(cells).cast("long").alias("n"), F.array_join(cells, ",").alias("names"))


@query("""SELECT c_custkey, 'K' || CASE WHEN length(CAST(n AS VARCHAR)) < 4 THEN lpad(CAST(n AS VARCHAR), 4, '0') ELSE CAST(n AS VARCHAR) END AS catalogNumber
FROM (SELECT c_custkey, 6 + row_number() OVER (ORDER BY c_custkey, copy) AS n FROM (SELECT c_custkey, unnest(range(0, 1 + c_custkey % 3)) AS copy FROM customer))""")
def label_renumbered(spark, sf_dir):
    customer = read(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") % 3 + 1).alias("duplicatesOfLabel"))
    return labels.renumbered(customer, "K0007", ["c_custkey"]).select("c_custkey", "catalogNumber")
