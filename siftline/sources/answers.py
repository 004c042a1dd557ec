"""Answers of the taxonomic services as tables.

Each service gives JSON; a parser turns the table of answers (raw, answer) into rows (raw, lib_name,
lib_authors, ord and what the service tells besides), one for each name in an answer, in its order.
Parsing is from_json inside the plan; an answer that is null, no JSON or an error has no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Members of the services' answers.
_IPNI = """struct<results: array<struct<name: string, authors: string, authorTeam: array<struct<name: string>>, family: string, fqId: string, publishingAuthor: string,
publication: string, referenceCollation: string, publicationYear: string, publicationYearNote: string, referenceRemarks: string, reference: string, bhlLink: string,
linkedPublication: struct<fqId: string>>>>"""
_POWO = """struct<results: array<struct<name: string, author: string, accepted: boolean, family: string, fqId: string, images: array<struct<fullsize: string>>,
synonymOf: struct<name: string, author: string>>>>"""
_TROPICOS = "array<struct<Error: string, NameId: string, ScientificName: string, ScientificNameWithAuthors: string, Author: string, Family: string, NomenclatureStatusName: string, AcceptedName: struct<ScientificNameWithAuthors: string>>>"
_TREE = "struct<genus: string, family: string, `order`: string, `class`: string, phylum: string, kingdom: string>"
_COL = f"""struct<code: int, data: struct<species: array<struct<scientific_name: string, author: string, name_code: string, name_status: string, accepted_name_info:
struct<scientificName: string, author: string, Synonyms: array<struct<synonym: string>>, taxonTree: {_TREE}>>>,
familes: array<struct<record_id: string, family: string, `order`: string, `class`: string, phylum: string, kingdom: string>>>>"""


def _rows(answers: DataFrame, schema: str, of: Callable[[Column], Column]) -> DataFrame:
    """raw, ord and r, a name of the answer."""
    read = answers.select("raw", F.from_json("answer", schema).alias("a"))
    return read.select("raw", F.posexplode(of(F.col("a"))).alias("ord", "r")).withColumn("ord", F.col("ord").cast("long"))


def _stated(text: Column) -> Column:
    """Text without blanks around it; null where the service says that it is not stated."""
    return F.when(text != "not_stated", F.trim(text))


def ipni(answers: DataFrame) -> DataFrame:
    """Authors are the service's own team, or where that is empty its author text."""
    r = F.col("r")
    team = F.when(F.size(r["authorTeam"]) > 0, F.array_join(r["authorTeam"]["name"], ", "))
    told = {
        "publishing_author": r["publishingAuthor"], "publication": r["publication"], "reference_collation": r["referenceCollation"], "publication_year": r["publicationYear"],
        "publication_year_note": r["publicationYearNote"], "reference_remarks": r["referenceRemarks"], "reference": r["reference"], "bhl_link": r["bhlLink"],
    }
    return _rows(answers, _IPNI, lambda a: a["results"]).select(
        "raw", "ord", r["name"].alias("lib_name"), F.coalesce(team, r["authors"]).alias("lib_authors"), r["family"].alias("family"), r["fqId"].alias("ipni_lsid"),
        *[_stated(c).alias(n) for n, c in told.items()], r["linkedPublication"]["fqId"].alias("linked_publication"),
    )


def powo(answers: DataFrame) -> DataFrame:
    """The accepted name is that which a synonym belongs to, or the name itself, with authors."""
    r = F.col("r")
    known = F.when(r["synonymOf"].isNotNull(), F.concat_ws(" ", r["synonymOf"]["name"], r["synonymOf"]["author"])).otherwise(F.concat_ws(" ", r["name"], r["author"]))
    return _rows(answers, _POWO, lambda a: a["results"]).select(
        "raw", "ord", r["name"].alias("lib_name"), r["author"].alias("lib_authors"), F.coalesce(r["accepted"], F.lit(False)).alias("accepted"), r["family"].alias("family"),
        r["fqId"].alias("ipni_lsid"), r["images"]["fullsize"].alias("images"), known.alias("accepted_name"),
    )


def tropicos(answers: DataFrame) -> DataFrame:
    r = F.col("r")
    return _rows(answers, _TROPICOS, lambda a: a).where(r["Error"].isNull()).select(
        "raw", "ord", r["ScientificName"].alias("lib_name"), r["Author"].alias("lib_authors"), r["Family"].alias("family"), r["NameId"].alias("name_id"),
        r["NomenclatureStatusName"].alias("nomenclature_status"), r["ScientificNameWithAuthors"].alias("full_name"),
    )


def tropicos_accepted(answers: DataFrame) -> DataFrame:
    """name_id (the key asked for, in raw) and accepted_name, the first of the second request's answer."""
    r = F.col("r")
    rows = _rows(answers, _TROPICOS, lambda a: a).where(r["Error"].isNull() & (F.col("ord") == 0))
    return rows.select(F.col("raw").alias("name_id"), F.coalesce(r["AcceptedName"]["ScientificNameWithAuthors"], r["ScientificNameWithAuthors"]).alias("accepted_name"))


def col(answers: DataFrame) -> DataFrame:
    """Species and below; the classification is that of the accepted name."""
    r = F.col("r")
    info = r["accepted_name_info"]
    levels = ("genus", "family", "order", "class", "phylum", "kingdom")
    rows = _rows(answers, _COL, lambda a: F.when(a["code"] == 200, a["data"]["species"]))
    return rows.select(
        "raw", "ord", r["scientific_name"].alias("lib_name"), r["author"].alias("lib_authors"), r["name_status"].alias("name_status"), r["name_code"].alias("name_code"),
        F.when(info["scientificName"].isNotNull() & info["author"].isNotNull(), F.concat_ws(" ", info["scientificName"], info["author"])).alias("accepted_name"),
        info["Synonyms"]["synonym"].alias("synonyms"), *[info["taxonTree"][n].alias(n) for n in levels],
    )


def col_families(answers: DataFrame) -> DataFrame:
    """Families, for queries of that rank."""
    r = F.col("r")
    rows = _rows(answers, _COL, lambda a: F.when(a["code"] == 200, a["data"]["familes"]))
    return rows.select("raw", "ord", r["family"].alias("lib_name"), r["record_id"].alias("name_code"), F.lit(None).cast("string").alias("genus"), *[r[n].alias(n) for n in ("family", "order", "class", "phylum", "kingdom")])


PARSERS = {"ipni": ipni, "powo": powo, "tropicos": tropicos, "col": col}
