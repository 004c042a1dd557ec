"""Checking nested records: flagged leaves, a schema, and routing by the two."""

from __future__ import annotations

import copy
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import json_text

READY, CHECK, INVALID = "ready", "needcheck", "unvalid"


def dirty(cell: Column, kind: T.DataType) -> Column:
    """Whether any text in a nested value is empty or flagged."""
    if isinstance(kind, T.StringType):
        return F.coalesce(cell.startswith("!") | (cell == ""), F.lit(False))
    if isinstance(kind, T.StructType):
        parts = [dirty(cell[f.name], f.dataType) for f in kind.fields]
        return reduce(lambda a, b: a | b, parts, F.lit(False))
    if isinstance(kind, T.ArrayType):
        return F.coalesce(F.exists(cell, lambda x: dirty(x, kind.elementType)), F.lit(False))
    if isinstance(kind, T.MapType):
        return F.coalesce(F.exists(F.map_values(cell), lambda x: dirty(x, kind.valueType)), F.lit(False))
    return F.lit(False)


def any_dirty(df: DataFrame) -> Column:
    return reduce(lambda a, b: a | b, [dirty(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields], F.lit(False))


_TYPES = {"string": T.StringType, "integer": T.IntegralType, "number": T.NumericType, "boolean": T.BooleanType, "array": T.ArrayType, "object": T.StructType}


def valid(cell: Column, kind: T.DataType, schema: Mapping) -> Column:
    """Whether a value follows a JSON schema: type, required, properties, items, enum, bounds, lengths, pattern.

    A missing member is null; formats and unknown keywords are not enforced.
    """
    wanted = schema.get("type")
    wanted = [wanted] if isinstance(wanted, str) else wanted
    if wanted and not any(isinstance(kind, _TYPES[w]) for w in wanted if w != "null"):
        return cell.isNull()
    rules = [F.lit(True)]
    if "enum" in schema:
        rules.append(cell.isin(*schema["enum"]))
    for key, test in (("minimum", lambda v: cell >= v), ("maximum", lambda v: cell <= v), ("minLength", lambda v: F.length(cell) >= v), ("maxLength", lambda v: F.length(cell) <= v), ("pattern", lambda v: cell.rlike(v)), ("minItems", lambda v: F.size(cell) >= v), ("maxItems", lambda v: F.size(cell) <= v)):
        if key in schema:
            rules.append(test(schema[key]))
    if isinstance(kind, T.StructType):
        members = {f.name: f.dataType for f in kind.fields}
        for name in schema.get("required", ()):
            rules.append(cell[name].isNotNull() if name in members else F.lit(False))
        rules += [valid(cell[name], members[name], s) for name, s in schema.get("properties", {}).items() if name in members]
    if isinstance(kind, T.ArrayType) and "items" in schema:
        rules.append(F.forall(cell, lambda x: valid(x, kind.elementType, schema["items"])))
    return cell.isNull() | F.coalesce(reduce(lambda a, b: a & b, rules), F.lit(False))


def valid_row(df: DataFrame, schema: Mapping) -> Column:
    """valid() of a row, its columns being the members of the root."""
    members = {f.name: f.dataType for f in df.schema.fields}
    rules = [F.col(f"`{n}`").isNotNull() if n in members else F.lit(False) for n in schema.get("required", ())]
    rules += [valid(F.col(f"`{n}`"), members[n], s) for n, s in schema.get("properties", {}).items() if n in members]
    return reduce(lambda a, b: a & b, rules, F.lit(True))


def route(df: DataFrame, schema: Mapping) -> DataFrame:
    """df with status: needcheck where a leaf is flagged or empty, else ready or unvalid by the schema."""
    return df.withColumn("status", F.when(any_dirty(df), F.lit(CHECK)).when(valid_row(df, schema), F.lit(READY)).otherwise(F.lit(INVALID)))


def status_counts(routed: DataFrame) -> DataFrame:
    return routed.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def split_people(names: Column, separator: str = ", ") -> Column:
    """A text of joined names as an array, for the schema."""
    return F.split(names, "\\Q" + separator + "\\E")


def text_or_none(records: Column, unknown: str = "unknown") -> Column:
    """A list of lists as JSON text, or null if the first item of the first is the word for unknown."""
    first = F.get(F.get(records, F.lit(0)), F.lit(0))
    return F.when(~F.coalesce(first == unknown, F.lit(False)), json_text(records))


def _text(**more) -> dict:
    return {"type": "string", **more}


def _number(low: float, high: float) -> dict:
    return {"type": "number", "minimum": low, "maximum": high}


#: Required parts, bounds and lengths of an occurrence record.
OCCURRENCE_SCHEMA = {
    "required": ["Occurrence", "Location", "Record"],
    "properties": {
        "Occurrence": {"type": "object", "required": ["occurrenceID", "recordedBy"], "properties": {"occurrenceID": _text(minLength=5, maxLength=45), "catalogNumber": _text(minLength=2, maxLength=35)}},
        "Location": {
            "type": "object", "required": ["country"],
            "properties": {
                "countryCode": _text(minLength=2, maxLength=3), "decimalLatitude": _number(-90, 90), "decimalLongitude": _number(-180, 180),
                "minimumElevationInMeters": _number(-800, 8845), "maximumElevationInMeters": _number(-800, 8845), "minimumDepthInMeters": _number(0, 12000),
                "maximumDepthInMeters": _number(0, 12000), "minimumDistanceAboveSurfaceInMeters": _number(-12000, 8845), "maximumDistanceAboveSurfaceInMeters": _number(-12000, 8845),
            },
        },
        "Identification": {"type": "array", "items": {"type": "object", "properties": {"scientificName": _text(pattern="[A-Z][a-z][a-z]+")}}},
        "Record": {"type": "object", "required": ["basisOfRecord", "dataFrom", "rightsHolder", "license"]},
    },
}


def with_terms(schema: Mapping, terms: Mapping[str, list[str]]) -> dict:
    """The schema with lists of allowed terms by path, such as {"Occurrence.sex": [...]}; paths go through lists."""
    out = copy.deepcopy(dict(schema))
    for path, allowed in terms.items():
        node = out
        for name in path.split("."):
            node = node.get("items", node)
            node = node.setdefault("properties", {}).setdefault(name, {})
        node["enum"] = list(allowed)
    return out


#: Terms that members of an occurrence record may have.
OCCURRENCE_TERMS = {
    "Occurrence.sex": ["♂", "♀", "☉"],
    "Occurrence.lifeStage": ["无花无果", "有花无果", "无花有果", "有花有果", "无孢子囊", "有孢子囊", "幼", "亚成", "成", "不清"],
    "Occurrence.establishmentMeans": ["本土", "引种", "归化", "入侵", "受控"],
    "Occurrence.disposition": ["在库", "出库", "遗失"],
    "Identification.typeStatus": [
        "type", "type species", "type genus", "allolectotype", "alloneotype", "allotype", "cotype", "epitype", "ex-epitype", "ex-holotype", "ex-isotype", "ex-lectotype", "ex-neotype",
        "ex-paratype", "ex-syntype", "ex-type", "hapantotype", "holotype", "iconotype", "isolectotype", "isoneotype", "isosyntype", "isotype", "lectotype", "neotype", "paralectotype",
        "paraneotype", "paratype", "plastoholotype", "plastoisotype", "plastolectotype", "plastoneotype", "plastoparatype", "plastosyntype", "plastotype", "secondary type",
        "supplementary type", "syntype", "topotype", "original material", "not type",
    ],
    "Record.category": ["植物", "动物", "真菌", "假菌", "古细菌", "原核生物", "病毒"],
    "Record.basisOfRecord": ["生物痕迹", "人类观察", "机器记录", "馆藏标本", "活体标本", "化石标本", "文献记录", "不清"],
}


def occurrence_schema(terms: Mapping[str, list[str]] | None = None) -> dict:
    """The schema of occurrence records with their terms, or others by path."""
    return with_terms(OCCURRENCE_SCHEMA, OCCURRENCE_TERMS | dict(terms or {}))
