"""Names of persons in free text.

A text is cut into runs of one script, Chinese or Latin, each with the id that may follow it; whatever
else there is separates names.  Runs are then trimmed to what can begin and end a name.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .flags import Cell, Staging, flagged, found

#: Characters of names in the two scripts, and words for no name.
CHINESE, LATIN = "一-龥", r"A-Za-zÀ-ÿ'.()\]\-"
NOBODY = ("无", "缺失", "佚名")
_SPACE, _ID = r"\p{IsWhite_Space}", r"[|\p{Nd}]"


def _run(script: str) -> str:
    """A run of one script, with spaces inside, and an id."""
    return rf"[{script}{_SPACE}]*[{script}]{_ID}*"


_RUN = rf"{_run(CHINESE)}|\[?{_run(LATIN)}"
#: What a Latin name cannot begin or end with; an id after such an end is none.
_HEAD, _TAIL = rf"^[^A-Za-z(\[{CHINESE}]+", rf"[(\-{_SPACE}]+{_ID}*$"


def _western(name: Column) -> Column:
    """Single spaces, and one after each full stop but the last."""
    return F.rtrim(F.regexp_replace(F.regexp_replace(name, " {2,}", " "), rf"\.{_SPACE}*", ". "))


def person_names(stage: Staging, text: Column, separator: str = "，") -> Cell:
    """All names of a text, joined by the separator."""
    raw = text.cast("string")
    trimmed = F.transform(found(raw, _RUN), lambda x: F.regexp_replace(F.regexp_replace(x, _HEAD, ""), _TAIL, ""))
    is_name = lambda x: x.rlike(rf"^[{CHINESE}]|^.[^|\p{{Nd}}]")
    names = stage.one(F.filter(trimmed, is_name))
    cjk = lambda x: x.rlike(f"[{CHINESE}]")
    wrong_id = lambda x: x.rlike(_ID) & ~x.rlike(rf"[a-z{CHINESE}]\|\p{{Nd}}")
    shown = F.transform(names, lambda x: F.when(~cjk(x), _western(x)).when(F.length(x) > 2, F.replace(x, F.lit(" "), F.lit(""))).otherwise(x))
    k = stage.keep(bad=F.exists(names, wrong_id), first=F.get(names, F.lit(0)), size=F.size(names))
    nobody = stage.one(F.coalesce((k.size == 1) & k.first.isin(*NOBODY), F.lit(False)))
    short = F.coalesce(cjk(k.first) & (F.length(k.first) == 1), F.lit(False))
    return flagged(F.when(~nobody, F.array_join(shown, separator)), (k.bad | short) & ~nobody, raw)


def without_ids(text: Column) -> Column:
    """Names without the ids after them; flagged values stay as they are."""
    return F.when(text.startswith("!"), text).otherwise(F.regexp_replace(text, r"\|[0-9]+", ""))
