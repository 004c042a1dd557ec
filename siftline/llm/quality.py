"""Quality rules: a learned decision list over text statistics.  DataFrame functions only.

Statistics are built-in expressions over the whole text.  The list is fitted by sequential
covering: conjunctions of thresholds are grown by information gain on two thirds of the labelled
statistics and pruned on the rest; rules that hold there are kept in order, and become one ordered
conditional expression.  Every midpoint between neighbouring values is a threshold, and neither the
conditions of a rule nor the rules are capped: growth ends where nothing is gained, and the list with
the first rule that fails the precision test.  Fitting reads at most about ``fit_rows`` labelled rows, chosen by a hash
of the id; the rules then judge every row.

Results in odd cases: a null text has no words, so it fails the base rule (fewer than ten words); an
empty table, or one without labels, gives no learned rule, and the base rule alone decides; repeated
rows each get a row; labels with several rows for an id count once, by their least value; extra
columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import held_out, last_place, sample_place

WINDOW = 5


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeated(hashes: Column) -> Column:
    """Words in windows found twice or more, from the windows' hashes in order."""

    def covered(by_hash: Column) -> Column:
        def twice(s: Column, i: Column) -> Column:
            before, after = F.get(by_hash, i - 1)["h"], F.get(by_hash, i + 1)["h"]
            return F.coalesce(before == s["h"], F.lit(False)) | F.coalesce(after == s["h"], F.lit(False))

        places = F.sort_array(F.transform(F.filter(by_hash, twice), lambda s: s["p"]))

        def total(at: Column) -> Column:
            own = F.transform(at, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(at, i + 1) - p, F.lit(WINDOW))))
            return F.aggregate(own, F.lit(0).cast("long"), lambda n, x: n + x)

        return let(places, total)

    def count(g: Column) -> Column:
        pairs = F.sort_array(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
        return F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0).cast("long")).otherwise(let(pairs, covered))

    return let(hashes, count)


def _n_repeat_words(words: Column) -> Column:
    each = F.transform(words, lambda w: F.xxhash64(w))

    def windows(h: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(h) - WINDOW)
        return F.transform(starts, lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)]))

    return F.when(F.size(words) < WINDOW, F.lit(0).cast("long")).otherwise(_repeated(let(each, windows)))


def text_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and n_upper, n_marks, n_digits, n_distinct for the rules."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    with_words = slim.withColumn("words", F.filter(F.split("text", "[ \\t-\\r]+"), lambda w: w != ""))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike("[^ \\t-\\r]"))
    counted = lambda pattern: F.regexp_count("text", F.lit(pattern)).cast("long")
    return with_words.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.aggregate("words", F.lit(0).cast("long"), lambda n, w: n + F.length(w)).alias("word_chars"),
        counted("[#*$%&|<>]").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        _n_repeat_words(F.col("words")).alias("n_repeat_words"),
        counted("\\p{Lu}").alias("n_upper"),
        counted("[!?]").alias("n_marks"),
        counted("[0-9]").alias("n_digits"),
        F.size(F.array_distinct("words")).cast("long").alias("n_distinct"),
    )


#: What the rules may test: numerator and denominator.
FEATURES = {
    "n_words": ("n_words", None), "mean_word": ("word_chars", "n_words"), "symbols": ("n_symbols", "n_words"), "dup_lines": ("n_dup_lines", None),
    "repeats": ("n_repeat_words", "n_words"), "upper": ("n_upper", "word_chars"), "marks": ("n_marks", "n_words"),
    "digits": ("n_digits", "word_chars"), "distinct": ("n_distinct", "n_words"),
}


def feature(name: str) -> Column:
    above, below = FEATURES[name]
    value = F.col(above).cast("double")
    return value if below is None else F.coalesce(F.try_divide(value, F.col(below).cast("double")), F.lit(0.0))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        return feature(self.feature) > self.threshold if self.above else feature(self.feature) <= self.threshold


Rule = tuple[Condition, ...]


def _held(condition: Condition, x: np.ndarray) -> np.ndarray:
    values = x[:, list(FEATURES).index(condition.feature)]
    return values > condition.threshold if condition.above else values <= condition.threshold


def _covered(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), dtype=bool)
    for c in rule:
        out &= _held(c, x)
    return out


def _gains(p: np.ndarray, size: np.ndarray, before: float) -> np.ndarray:
    return np.where(p > 0, p * (np.log2(np.maximum(p, 1) / np.maximum(size, 1)) - before), 0.0)


def _best_condition(x: np.ndarray, y: np.ndarray) -> Condition | None:
    """The condition of most gain, over the midpoints of all neighbouring distinct values of each feature."""
    bad, best, best_gain = int(y.sum()), None, 1e-9
    before = np.log2(bad / len(y))
    for k, name in enumerate(FEATURES):
        order = np.argsort(x[:, k], kind="stable")
        values, p = x[order, k], np.cumsum(y[order])
        last = np.flatnonzero(values[1:] > values[:-1])  # the last row at or below each cut
        if not len(last):
            continue
        for above, hits, size in ((False, p[last], last + 1), (True, bad - p[last], len(y) - last - 1)):
            gains = _gains(hits, size, before)
            at = int(gains.argmax())
            if gains[at] > best_gain:
                low, high = float(values[last[at]]), float(values[last[at] + 1])
                middle = (low + high) / 2
                best, best_gain = Condition(name, above, middle if middle < high else low), float(gains[at])
    return best


def _grow(x: np.ndarray, y: np.ndarray) -> Rule:
    """Conditions until the rows are all bad or no condition gains."""
    rule: Rule = ()
    while y.any() and not y.all() and (best := _best_condition(x, y)):
        rule += (best,)
        inside = _held(best, x)
        x, y = x[inside], y[inside]
    return rule


def _worth(rule: Rule, x: np.ndarray, y: np.ndarray) -> tuple[float, int]:
    """Precision by Laplace's estimate, and rows covered."""
    hit = y[_covered(rule, x)]
    return (int(hit.sum()) + 1) / (len(hit) + 2), len(hit)


def learn_rules(rows: list[tuple[dict[str, float], bool]], precision: float = 0.9, least: int = 3) -> list[Rule]:
    """An ordered list of rules for rows that are bad (True), until a rule fails the precision test or no bad row is left."""
    x = np.array([[r[n] for n in FEATURES] for r, _ in rows], dtype=float).reshape(len(rows), len(FEATURES))
    y, at = np.array([bad for _, bad in rows], dtype=bool), np.arange(len(rows)) % 3
    grow, prune = (x[at > 0], y[at > 0]), (x[at == 0], y[at == 0])
    rules: list[Rule] = []
    while grow[1].any():
        rule = _grow(*grow)
        if not rule:
            break
        choices = [rule[:k] for k in range(1, len(rule) + 1)]
        rule = max(choices, key=lambda r: (_worth(r, *prune)[0], -len(r)))
        worth, covered = _worth(rule, *prune)
        if not (worth >= precision * (covered + 1) / (covered + 2) and covered >= least and _worth(rule, *grow)[0] >= precision):
            break
        rules.append(rule)
        grow, prune = (tuple(v[~_covered(rule, part[0])] for v in part) for part in (grow, prune))
    return rules


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = 12_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> list[Rule]:
    """Rules from the labelled rows that are not held out, of which at most fit_rows are read: of ids chosen by a hash, rows with the same figures once."""
    marked = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    marked = marked.groupBy(F.col(id_col).alias("doc_id")).agg(F.min(label_col).alias("y"))
    marked = marked.where(sample_place(F.col("doc_id")) <= last_place(fit_rows, marked.count()))
    chosen = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(marked), "doc_id")
    found = text_statistics(chosen.select("doc_id", "text")).join(F.broadcast(marked), "doc_id")
    # filtered after collect(): a filter on statistics would be pushed below the join and computed for every document
    figures = found.select("doc_id", "y", base_failed().alias("failed"), *[feature(n).alias(f"f_{n}") for n in FEATURES]).distinct()
    places = [F.col(f"f_{n}") for n in FEATURES]
    rows = figures.orderBy(sample_place(F.col("doc_id")), "doc_id", *places).limit(fit_rows).collect()
    rows = sorted((r for r in rows if not r["failed"]), key=lambda r: (r["doc_id"], *[r[f"f_{n}"] for n in FEATURES]))
    return learn_rules([({n: r[f"f_{n}"] for n in FEATURES}, r["y"] == 0) for r in rows])


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def decision(rules: list[Rule]) -> Column:
    """The number of the first rule that holds, from 1; 0 if none does."""
    out = F.lit(0)
    for k in range(len(rules), 0, -1):
        holds = rules[k - 1][0].column()
        for c in rules[k - 1][1:]:
            holds = holds & c.column()
        out = F.when(holds, F.lit(k)).otherwise(out)
    return out


def judge(docs: DataFrame, rules: list[Rule], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Base statistics, base_failed, kept and rule (number of the learned rule that rejects, else 0)."""
    found = text_statistics(docs, id_col, text_col).withColumn("base_failed", base_failed())
    found = found.withColumn("rule", F.when(F.col("base_failed"), F.lit(0)).otherwise(decision(rules)))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                        (~F.col("base_failed") & (F.col("rule") == 0)).alias("kept"), "rule")
