"""Resolving names against lookup tables.

Every provider is a table with a raw name, its authors and a priority; the operators are the same.
Queries are made distinct and parsed once; candidates join on the canonical name, so a name with
many candidates is one query against them and the pick is a maximum, combined before the shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.authors import with_scores
from ..functions.flags import Staging
from ..functions.taxon import parsed_name, styled_name
from .cluster import checkpointed

#: What each provider's answers hold, by the names of sources.answers.
PROJECTIONS = {
    "powoImages": ("images",),
    "powoAccepted": ("accepted_name",),
    "powoName": ("lib_name", "lib_authors", "family", "ipni_lsid"),
    "colAccepted": ("accepted_name",),
    "colSynonyms": ("synonyms",),
    "colTaxonTree": ("genus", "family", "order", "class", "phylum", "kingdom"),
    "colName": ("lib_name", "lib_authors", "family", "name_code"),
    "ipniName": ("lib_name", "lib_authors", "family", "ipni_lsid"),
    "ipniReference": ("publishing_author", "publication", "reference_collation", "publication_year", "publication_year_note", "reference_remarks", "reference", "bhl_link", "linked_publication"),
    "tropicosName": ("lib_name", "lib_authors", "family", "name_id"),
    "tropicosAccepted": ("accepted_name",),
}


def query_keys(names: DataFrame, column: str) -> DataFrame:
    """Distinct names with raw, simple_name, authors and platform_rank."""
    distinct = names.select(F.col(column).alias("raw")).where("raw is not null").distinct()
    stage = Staging("__name")
    name = parsed_name(stage, F.col("raw"))
    return stage.select(distinct, "raw", name.simple_name.alias("simple_name"), name.authors.alias("authors"), name.platform_rank.alias("platform_rank"))


def lookup_table(lib: DataFrame, name: str, order: str, carry: Sequence[str] = ()) -> DataFrame:
    """A provider's names, parsed once: lib_name, simple_name, lib_authors, ord and carried columns."""
    stage = Staging("__name")
    p = parsed_name(stage, F.col(name))
    return stage.select(lib, F.col(name).alias("lib_name"), p.simple_name.alias("simple_name"), p.authors.alias("lib_authors"), F.col(order).alias("ord"), *carry)


def _best(joined: DataFrame, priority: Column | None, carry: Sequence[str]) -> DataFrame:
    """For queries with their candidates: raw with its best one.

    With authors in the query: the highest author score above zero, earlier entries first among
    equals.  Without: the lowest priority (default: the first entry).
    """
    named = F.col("authors").isNotNull()
    scored = with_scores(joined, "authors", "lib_authors", "score").where(~named | (F.col("score") > 0))
    first = F.when(named, F.lit(0)).otherwise(F.lit(0) if priority is None else priority)
    rank = F.struct((-F.coalesce("score", F.lit(0.0))).alias("s"), first.alias("p"), F.col("ord").alias("o"))
    best = scored.groupBy("raw").agg(F.min_by(F.struct("lib_name", "score", *carry), rank).alias("b"))
    return best.select("raw", "b.*")


def best_candidates(queries: DataFrame, lib: DataFrame, priority: Column | None = None, prefix: bool = True, carry: Sequence[str] = ()) -> DataFrame:
    """raw with its best candidate in a table: lib_name, score and carried columns; queries without one are missing."""
    joined = queries.join(lib, "simple_name")
    return _best(joined.where(F.col("lib_name").startswith(F.col("simple_name"))) if prefix else joined, priority, carry)


def best_answers(queries: DataFrame, answers: DataFrame, service: str, carry: Sequence[str] = ()) -> DataFrame:
    """raw with the best of a service's answers to it (raw, lib_name, lib_authors, ord, ...).

    Answers of another name than the one asked for do not count, but for the service that compares
    names itself.
    """
    joined = queries.join(answers, "raw")
    same = joined if service in EXACT_SERVICES else joined.where(F.col("lib_name") == F.col("simple_name"))
    return _best(same, PRIORITIES[service](), carry)


def resolve(df: DataFrame, column: str, lib: DataFrame, outputs: Mapping[str, str], priority: Column | None = None, mark: bool = False, only_hits: bool = False) -> DataFrame:
    """df with the outputs {new column: column of the best candidate}; misses are null, or flagged in the first output."""
    carry = [c for c in outputs.values() if c not in ("lib_name", "score")]
    best = best_candidates(query_keys(df, column), lib, priority, carry=carry)
    chosen = best.select(F.col("raw").alias("__raw"), *[F.col(c).alias(n) for n, c in outputs.items()], F.lit(True).alias("__hit"))
    joined = df.join(chosen, F.col(f"`{column}`") == F.col("__raw"), "inner" if only_hits else "left")
    first = next(iter(outputs))
    if mark:
        joined = joined.withColumn(first, F.when(F.col("__hit"), F.col(first)).otherwise(F.concat(F.lit("!"), F.col(f"`{column}`"))))
    return joined.drop("__raw", "__hit")


def resolve_cascade(df: DataFrame, column: str, libs: Sequence[tuple[str, DataFrame]], output: str = "std_name") -> DataFrame:
    """The first provider's candidate, for each name the earliest of libs (name, table) that has one; also its provider.

    Only names that earlier providers miss are asked of later ones.  Each provider's answers, a row for
    a distinct name, are checkpointed, since both the result and the next question read them.
    """
    open_queries = checkpointed(query_keys(df, column))
    found: DataFrame | None = None
    for provider, lib in libs:
        best = checkpointed(best_candidates(open_queries, lib).select("raw", F.col("lib_name").alias(output), F.lit(provider).alias("provider")))
        open_queries = open_queries.join(best.select("raw"), "raw", "left_anti")
        found = best if found is None else found.unionByName(best)
    chosen = found.withColumnRenamed("raw", "__raw")
    return df.join(chosen, F.col(f"`{column}`") == F.col("__raw"), "left").drop("__raw")


def uncached(queries: DataFrame, cache: DataFrame) -> DataFrame:
    """Queries that a table of earlier answers (with raw) lacks."""
    return queries.join(cache.select("raw"), "raw", "left_anti")


def priority_of(column: Column, order: Sequence[str | None]) -> Column:
    """The place of a value in an order; others come last."""
    out = F.lit(len(order))
    for k in range(len(order) - 1, -1, -1):
        out = F.when(column.eqNullSafe(F.lit(order[k])), F.lit(k)).otherwise(out)
    return out


#: Services that are asked for exact names, so that theirs need not be compared.
EXACT_SERVICES = ("tropicos",)
#: Which of several candidates a provider gives for a name without authors.
PRIORITIES = {
    "ipni": lambda: F.lit(0),
    "powo": lambda: F.when(F.col("accepted"), 0).otherwise(1),
    "tropicos": lambda: priority_of(F.col("nomenclature_status"), ("nom. cons.", "Legitimate", "No opinion")),
    "col": lambda: F.when(F.col("name_status") == "accepted name", 0).otherwise(1),
}


def accepted_of(found: DataFrame, accepted: DataFrame, key: str = "name_id") -> DataFrame:
    """A second lookup: the accepted name by a name's id, or the name itself with its authors where there is none."""
    joined = found.join(accepted.select(key, "accepted_name"), key, "left")
    return joined.withColumn("accepted_name", F.coalesce("accepted_name", "full_name"))


def projected(found: DataFrame, kind: str, keys: Sequence[str] = ("raw",)) -> DataFrame:
    """keys and the fields of one of PROJECTIONS; what a service calls not stated is null."""
    if kind not in PROJECTIONS:
        raise ValueError(f"kind is one of {', '.join(PROJECTIONS)}, not {kind}")
    texts = {c for c, t in found.dtypes if t == "string"}
    cells = [F.when(F.col(c) != "not_stated", F.col(c)).alias(c) if c in texts else F.col(c) for c in PROJECTIONS[kind]]
    return found.select(*keys, *cells)


def tree_matches(queries: DataFrame, lib: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """For queries that are genera or families: raw with the first entry of lib (family, genus, ord) whose classification has the name."""
    out = None
    for rank, level in (("generic", "genus"), ("familial", "family")):
        asked = queries.where(F.col("platform_rank") == rank)
        first = lib.where(F.col(level).isNotNull()).groupBy(F.col(level).alias("simple_name")).agg(F.min_by(F.struct("family", "genus", *carry), "ord").alias("b"))
        hit = asked.join(first, "simple_name").select("raw", "b.*")
        out = hit if out is None else out.unionByName(hit)
    return out


def spell_checked(df: DataFrame, column: str, libs: Sequence[tuple[str, DataFrame]], outputs: Sequence[str], style: str = "scientificName", mark: bool = True) -> DataFrame:
    """df with its names as the first of libs (name, table) spells them, in a style; a name that none has is flagged in the first output, or null."""
    checked = resolve_cascade(df, column, libs, "__std")
    stage = Staging("__styled")
    parts = styled_name(stage, F.col("__std"), style)
    missing = F.col("__std").isNull() & F.lit(mark)
    parts[0] = F.when(missing, F.concat(F.lit("!"), F.col(f"`{column}`"))).otherwise(parts[0])
    kept = [F.col(f"`{c}`") for c in df.columns if c not in outputs]
    return stage.select(checked, *kept, *[p.alias(n) for p, n in zip(parts, outputs)])
