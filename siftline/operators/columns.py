"""Splitting, merging, renaming and ordering columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The first part at a change between scripts ($) and between digits and others (%).
SCRIPT = (r"^\s*[一-龥][一-龥[^\p{L}\p{N}_]]*", r"^[^一-龥]+")
DIGITS = (r"^\s*[0-9][0-9[^\p{L}\p{N}_]]*", r"^[^0-9]+")
MODES = ("d", "l", "o", "a", "r", "t")
_JSON_GAP = r'\G((?:[^":,]++|"[^"\\]*+(?:\\.[^"\\]*+)*+")*+)([:,])'


def _cut(rest: Column, separator: str) -> tuple[Column, Column]:
    """The part before a separator and the rest, null where the separator is missing."""
    if separator in ("$", "%"):
        lead, other = SCRIPT if separator == "$" else DIGITS
        starts = rest.rlike(lead)
        head = F.when(starts, F.regexp_extract(rest, lead, 0)).otherwise(F.regexp_extract(rest, other, 0))
        shown = F.when(starts, F.trim(head)).otherwise(head)
        return F.when(head != "", shown).otherwise(rest), F.when(head != "", F.substring(rest, F.length(head) + 1, F.length(rest)))
    at = F.instr(rest, separator) if len(separator) else F.lit(0)
    return F.when(at > 0, F.substring(rest, F.lit(1), at - 1)).otherwise(rest), F.when(at > 0, F.substring(rest, at + len(separator), F.length(rest)))


def split_parts(text: Column, separators: str | Sequence[str]) -> list[Column]:
    """One more part than separators; each separator cuts once, what is left of the cuts before."""
    separators = [separators] if isinstance(separators, str) else list(separators)
    rest, out = text.cast("string"), []
    for s in separators:
        head, rest = _cut(rest, s)
        out.append(head)
    return [*out, rest]


def split_column(df: DataFrame, column: str, separators: str | Sequence[str], names: Sequence[str], drop: bool = True) -> DataFrame:
    parts = split_parts(F.col(f"`{column}`"), separators)
    kept = [F.col(f"`{c}`") for c in df.columns if not (drop and c == column)]
    return unique_names(df.select(*kept, *[p.alias(n) for p, n in zip(parts, names)]))


def json_text(value: Column) -> Column:
    """JSON with a space after each colon and comma outside of strings."""
    return F.regexp_replace(F.to_json(value), _JSON_GAP, "$1$2 ")


def merged(columns: Mapping[str, Column], how: str | Sequence[str]) -> Column:
    """Several columns as one, without nulls; null if all are null.

    how: a separator; a list of them, for the gaps; or a mode: d struct, l array, o JSON object, a JSON
    array, r lines of "key：value", t the same joined by "；".
    """
    cells = list(columns.values())
    some = F.coalesce(*[F.when(c.isNotNull(), F.lit(True)) for c in cells]).isNotNull()
    if not isinstance(how, str):
        out = cells[0].cast("string")
        for separator, cell in zip(how, cells[1:]):
            cell = cell.cast("string")
            out = F.coalesce(F.concat(out, F.lit(separator), cell), out, cell)
        return out
    if how == "d":
        return F.when(some, F.struct(*[c.alias(k) for k, c in columns.items()]))
    if how in ("l", "a"):
        values = F.array_compact(F.array(*cells))
        return F.when(some, values if how == "l" else json_text(values))
    if how == "o":
        return F.when(some, json_text(F.struct(*[c.alias(k) for k, c in columns.items()])))
    if how in ("r", "t"):
        pairs = F.array_compact(F.array(*[F.concat(F.lit(f"{k}："), c.cast("string")) for k, c in columns.items()]))
        return F.when(some, F.array_join(pairs, "\n" if how == "r" else "；"))
    return F.when(some, F.concat_ws(how, *[c.cast("string") for c in cells]))


def merge_columns(df: DataFrame, columns: Sequence[str], how: str | Sequence[str], name: str, drop: bool = True) -> DataFrame:
    arrays = {c for c, kind in df.dtypes if kind.startswith("array<")}
    cells = {c: F.when(has_value(F.col(f"`{c}`")), F.col(f"`{c}`")) if c in arrays else F.col(f"`{c}`") for c in columns}
    one = merged(cells, how)
    kept = [F.col(f"`{c}`") for c in df.columns if not (drop and c in columns)]
    return unique_names(df.select(*kept, one.alias(name)))


def has_value(cell: Column) -> Column:
    """Whether an array has a member that is not null."""
    return F.exists(cell, lambda x: x.isNotNull())


def free_names(names: Sequence[str]) -> list[str]:
    """Names made unique by underscores after later ones."""
    seen: set[str] = set()
    out = []
    for name in names:
        while name in seen:
            name += "_"
        seen.add(name)
        out.append(name)
    return out


def unique_names(df: DataFrame) -> DataFrame:
    return df.toDF(*free_names(df.columns))


def append_columns(df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """Further columns at the end; an existing one of the same name gets an underscore."""
    taken = [f"{c}_" if c in columns else c for c in df.columns]
    return unique_names(df.select(*[F.col(f"`{c}`").alias(t) for c, t in zip(df.columns, taken)], *[v.alias(k) for k, v in columns.items()]))


def replace_columns(df: DataFrame, inputs: Sequence[str], results: Mapping[str, Column], drop: bool = True) -> DataFrame:
    """A cleaner's results at the right end: under the inputs' names if there are as many, else their own."""
    names = list(inputs) if drop and len(inputs) == len(results) else list(results)
    kept = [F.col(f"`{c}`") for c in df.columns if not (drop and c in inputs)]
    return unique_names(df.select(*kept, *[v.alias(n) for v, n in zip(results.values(), names)]))


def table_mapping(df: DataFrame, mapping: Mapping) -> DataFrame:
    """Rename (str: str), split ((column, separators): names) or merge ((c1, c2, ..., separator): name)."""
    for source, target in mapping.items():
        if isinstance(source, str):
            df = df.withColumnRenamed(source, target)
        elif len(source) == 2:
            df = split_column(df, source[0], source[1], [target] if isinstance(target, str) else target)
        elif len(source) > 2:
            df = merge_columns(df, source[:-1], source[-1], target)
        else:
            raise ValueError(f"no mapping: {source}")
    return df


def final_columns(df: DataFrame, order: Sequence[str], cut: bool = True, fill: object | None = None, fillable: Sequence[str] = ()) -> DataFrame:
    """Columns in the model's order (a name's last place counts); others cut or appended; missing fillable ones made constant."""
    wanted = list(dict.fromkeys(reversed(order)))[::-1]
    chosen = [F.col(f"`{c}`") if c in df.columns else F.lit(fill).cast("string").alias(c) for c in wanted if c in df.columns or c in fillable]
    rest = [] if cut else [F.col(f"`{c}`") for c in df.columns if c not in wanted]
    return df.select(*chosen, *rest)
