"""Aligning source headers with canonical terms.  Works on names alone; no data are read."""

from __future__ import annotations

import json
import re
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame

Aliases = Mapping[str, Sequence[str]]


class AlignmentError(ValueError):
    """Headers that map to no term, or several headers to one."""


def terms_of(header: str, aliases: Aliases) -> list[str]:
    """The canonical terms a header may mean: itself if it is one, else those that list its upper-cased text."""
    if header in aliases:
        return [header]
    return [term for term, names in aliases.items() if header.upper() in names]


def conflicts(mapping: Mapping[str, str]) -> dict[str, list[str]]:
    """Terms with several headers."""
    by_term: dict[str, list[str]] = {}
    for header, term in mapping.items():
        by_term.setdefault(term, []).append(header)
    return {t: h for t, h in by_term.items() if len(h) > 1}


def build_mapping(headers: Sequence[str], aliases: Aliases, overrides: Mapping[str, str | None] | None = None, policy: str = "error") -> dict[str, str]:
    """Header to term.  Overrides go first (None: leave the header alone).

    policy, for headers with several terms and terms with several headers: error, first or ignore.
    """
    if policy not in ("error", "first", "ignore"):
        raise ValueError(f"policy is error, first or ignore, not {policy}")
    overrides, out, doubtful = overrides or {}, {}, {}
    for header in headers:
        if header in overrides:
            if overrides[header]:
                out[header] = overrides[header]
            continue
        terms = terms_of(header, aliases)
        if len(terms) > 1:
            doubtful[header] = terms
        if len(terms) == 1 or (terms and policy == "first"):
            out[header] = terms[0]
    clashes = conflicts(out)
    if policy == "error" and (doubtful or clashes):
        raise AlignmentError(f"headers with several terms: {doubtful}; terms with several headers: {clashes}")
    for term, several in clashes.items():
        for header in several[1:] if policy == "first" else several:
            if header not in overrides:
                del out[header]
    return out


def align(df: DataFrame, aliases: Aliases, overrides: Mapping[str, str | None] | None = None, policy: str = "error") -> DataFrame:
    return df.withColumnsRenamed(build_mapping(df.columns, aliases, overrides, policy))


_STEP = re.compile(r"([dlroat]?)\s*(\d+)([^\d]*)")


def parse_expression(text: str, headers: Sequence[str], terms: Sequence[str]) -> dict:
    """A mapping as table_mapping() takes it, from "2 ; 4 , 5 = 11" (merge), "11 = 2 ; 4 , 5" (split), "1 = 64" (rename) or "0" (the rest as they are).

    Numbers count headers on the left and terms on the right, from 0; what stands between numbers
    separates, a run of spaces as one; a letter in front is a merge mode.
    """
    if text.strip() == "0":
        return {h: h for h in headers}
    left, right = text.split("=")

    def side(part: str, names: Sequence[str]) -> tuple[list[str], list[str], str]:
        steps = _STEP.findall(part.strip())
        between = [s if not s.strip() and s else s.strip() for *_, s in steps[:-1]]
        return [names[int(n)] for _, n, _ in steps], [" " if s and not s.strip() else s for s in between], steps[0][0]

    sources, joins, mode = side(left, headers)
    targets, cuts, _ = side(right, terms)
    if len(sources) == 1 and len(targets) == 1:
        return {sources[0]: targets[0]}
    if len(sources) == 1:
        return {(sources[0], tuple(cuts)): tuple(targets)}
    if len(targets) == 1:
        return {(*sources, mode or (joins[0] if len(set(joins)) == 1 else tuple(joins))): targets[0]}
    raise AlignmentError(f"either side has one column: {text}")


def save_mapping(mapping: Mapping[str, str], path: str) -> None:
    with open(path, "w", encoding="utf-8") as out:
        json.dump(list(mapping.items()), out, ensure_ascii=False)


def load_mapping(path: str, headers: Sequence[str] | None = None) -> dict[str, str]:
    """A mapping saved before; with headers, only if it is for the same ones."""
    with open(path, encoding="utf-8") as source:
        mapping = dict(json.load(source))
    if headers is not None and not set(mapping) <= set(headers):
        raise AlignmentError("the mapping is for other headers")
    return mapping
