"""Latin names of taxa: parsing and restyling.

A name is read from the left: genus, hybrid sign, specific epithet.  What is left holds authors, and
for an infraspecific name a rank word with another epithet and its authors at the end.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from .flags import Staging

#: Rank words, endings of family names, and the letters of genera and epithets.
RANKS = ("var.", "subvar.", "subsp.", "ssp.", "f.", "fo.", "subf.", "form.", "forma", "nothosp.", "cv.", "cultivar.")
FAMILIES = ("aceae", "idae", "umbelliferae", "labiatae", "compositae", "gramineae", "leguminosae")
GENUS_LETTERS = "a-zàäçéèêëöôùûüîï"
EPITHET_LETTERS = "a-zàâäèéêëîïôœùûüÿç"
STYLES = {
    "simpleName": ("simple_name",),
    "apiName": ("simple_name", "authors"),
    "scientificName": ("scientific_name",),
    "plantSplitName": ("genus", "species", "taxon_rank", "infraspecies", "authors"),
    "fullPlantSplitName": ("genus", "species", "first_authors", "taxon_rank", "infraspecies", "authors"),
    "animalSplitName": ("genus", "species", "infraspecies", "authors"),
}
_SPACE = r"\p{IsWhite_Space}"
_GENUS = rf"(!?(?:×{_SPACE}?)?[A-Z][{GENUS_LETTERS}-]+){_SPACE}*(.*)"
_SIGN = rf"^(?:×{_SPACE}*|[Xx]{_SPACE}+)"
_EPITHET = rf"^[{EPITHET_LETTERS}][{EPITHET_LETTERS}-]+"
_RANK = "|".join(sorted((r.replace(".", r"\.") for r in RANKS), key=len, reverse=True))
#: Authors begin like this; an end of a name has an epithet of three letters and perhaps authors.
_OPENS = "\"'A-Z(."
_END = rf"([{GENUS_LETTERS}]{{2}}[{GENUS_LETTERS}-]+){_SPACE}*([\"'（A-Z(].*?[^A-Z-])?$"
#: After authors the end needs a rank word, itself not after a capital; else it may do without.
_AFTER_AUTHORS = rf"(?<=[^A-Z\s-]{_SPACE}{{0,9}})({_RANK}){_SPACE}*{_END}"
_ALONE = rf"({_RANK})?{_SPACE}*{_END}"


class Name(NamedTuple):
    """Parts of a name, null where missing; all are null for a text that is no Latin name."""

    genus: Column
    species: Column
    taxon_rank: Column
    infraspecies: Column
    authors: Column
    first_authors: Column
    platform_rank: Column
    simple_name: Column
    scientific_name: Column

    def struct(self) -> Column:
        return F.when(self.genus.isNotNull(), F.struct(*[c.alias(n) for n, c in self._asdict().items()]))


def _rest(text: Column, part: Column) -> Column:
    """What follows a part at the start of a text."""
    return F.substring(text, F.length(part) + 1, F.length(text))


def parsed_name(stage: Staging, text: Column) -> Name:
    """The parts of a name.  An autonym (infraspecific epithet equal to the specific one) counts as the species."""
    raw = F.coalesce(text.cast("string"), F.lit(""))
    first = stage.keep(genus=F.regexp_extract(raw, _GENUS, 1), rest=F.regexp_extract(raw, _GENUS, 2))
    sign = stage.one(F.regexp_extract(first.rest, _SIGN, 0))
    after = stage.one(_rest(first.rest, sign))
    epithet = stage.one(F.regexp_extract(after, _EPITHET, 0))
    rest = stage.one(F.regexp_replace(_rest(after, epithet), rf"^{_SPACE}+", ""))
    headed = stage.one(rest.rlike(f"^[{_OPENS}]"))
    end = stage.keep(
        rank=F.when(headed, F.regexp_extract(rest, _AFTER_AUTHORS, 1)).otherwise(F.regexp_extract(rest, _ALONE, 1)),
        infra=F.when(headed, F.regexp_extract(rest, _AFTER_AUTHORS, 2)).otherwise(F.regexp_extract(rest, _ALONE, 2)),
        late=F.when(headed, F.regexp_extract(rest, _AFTER_AUTHORS, 3)).otherwise(F.regexp_extract(rest, _ALONE, 3)),
        whole=F.when(headed, F.regexp_extract(rest, _AFTER_AUTHORS, 0)),
    )
    species = F.when(sign == "", epithet).otherwise(F.concat(F.lit("× "), epithet))
    own = end.infra != ""
    k = stage.keep(
        species=species, below=own & (end.infra != species), autonym=own & (end.infra == species), late=F.trim(end.late),
        early=F.when(headed & own, F.rtrim(F.substring(rest, F.lit(1), F.length(rest) - F.length(end.whole)))).otherwise(""),
    )
    some = lambda c, when=F.lit(True): F.when(when & (c != ""), c)
    authors = F.when(k.below, k.late).when(k.autonym, F.when(k.early != "", k.early).otherwise(k.late)).otherwise(rest)
    family = F.lower(first.genus).rlike(f"(?:{'|'.join(FAMILIES)})$")
    level = F.when(k.below, "infraspecific").when(k.autonym | (epithet != ""), "specific").when(family, "familial").otherwise("generic")
    is_name = first.genus != ""
    parts = stage.keep(
        genus=some(first.genus), species=some(k.species, is_name), rank=some(end.rank, is_name & k.below), infra=some(end.infra, is_name & k.below),
        authors=some(authors, is_name), early=some(k.early, is_name & k.below), level=F.when(is_name, level),
    )
    simple = stage.one(F.when(is_name, F.concat_ws(" ", parts.genus, parts.species, parts.rank, parts.infra)))
    whole = F.when(is_name, F.concat_ws(" ", simple, parts.authors))
    return Name(parts.genus, parts.species, parts.rank, parts.infra, parts.authors, parts.early, parts.level, simple, whole)


def styled_name(stage: Staging, text: Column, style: str = "scientificName") -> list[Column]:
    """A Latin name in one of STYLES, a column for each part."""
    if style not in STYLES:
        raise ValueError(f"style is one of {', '.join(STYLES)}, not {style}")
    name = parsed_name(stage, text)
    return [getattr(name, part) for part in STYLES[style]]
