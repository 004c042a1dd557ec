"""Table models: output columns declared as expressions over source columns.

A field's name may hold several outputs ("a__b") and ends with a suffix: none drops the inputs, "_"
also creates the column if the inputs are missing, "__" keeps the inputs, "___" keeps and creates.
A value is "$x" (rename), ("$a", "$b", sep) (merge), {"$x": sep} (split), [e1, e2] (the first that
the schema has), or a lifted function of such references.  A model is compiled against a schema
into projections before any data are read.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from enum import EnumMeta
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.flags import Staging
from ..operators.columns import MODES, final_columns, has_value, merged, split_parts


class ModelError(ValueError):
    """A model that is not well formed."""


@dataclass(frozen=True)
class Deferred:
    """A lifted function, to be applied to columns later."""

    function: Callable
    args: tuple
    kwargs: Mapping[str, Any]
    staged: bool = False


def is_reference(value: Any) -> bool:
    if isinstance(value, str):
        return value.startswith("$")
    if isinstance(value, tuple):
        return bool(value) and isinstance(value[0], str) and value[0].startswith("$")
    if isinstance(value, list):
        return bool(value) and is_reference(value[0])
    return isinstance(value, dict) and bool(value) and is_reference(next(iter(value)))


def ifunc(function: Callable) -> Callable:
    """Lift a function of columns: given references it is deferred, else called at once."""

    @functools.wraps(function)
    def lifted(*args, **kwargs):
        if any(map(is_reference, (*args, *kwargs.values()))):
            return Deferred(function, args, kwargs)
        return function(*args, **kwargs)

    return lifted


def sfunc(function: Callable) -> Callable:
    """Lift a cleaner that keeps its steps in a Staging, its first argument; outside a model, give it as stage=."""

    @functools.wraps(function)
    def lifted(*args, stage: Staging | None = None, **kwargs):
        if any(map(is_reference, (*args, *kwargs.values()))):
            return Deferred(function, args, kwargs, staged=True)
        if stage is None:
            raise ModelError(f"{function.__name__} needs references, or columns and a stage")
        return function(stage, *args, **kwargs)

    return lifted


def tfunc(function: Callable) -> Callable:
    """Lift a function of a table: (df, input names, output names, **kwargs) gives the table with the outputs."""

    def lifted(*references: Any, **kwargs) -> Deferred:
        return Deferred(function, references, kwargs | {"__table": True})

    return lifted


@dataclass
class Field:
    outputs: list[str]
    value: Any
    drop: bool
    create: bool


def parse_field(name: str, value: Any) -> Field:
    body = name.rstrip("_")
    suffix = len(name) - len(body)
    if suffix > 3:
        raise ModelError(f"{name} ends with more than three underscores")
    return Field(body.strip("_").split("__"), value, drop=suffix < 2, create=suffix in (1, 3))


@dataclass
class Step:
    """One projection: new columns, columns that go, and projections before it that only it reads."""

    new: dict[str, Column]
    drop: set[str] = field(default_factory=set)
    table: Callable[[DataFrame], DataFrame] | None = None
    used: set[str] = field(default_factory=set)
    before: list[dict[str, Column]] = field(default_factory=list)

    def staging(self) -> Staging:
        out = Staging(cut=6 if len(self.before[0]) < 8 else 2)
        out.levels = self.before
        return out


class _Compiler:
    def __init__(self, columns: Sequence[str], arrays: Sequence[str] = ()):
        self.columns, self.arrays = list(columns), set(arrays)
        self.stage, self.stages = Staging("__s0"), 0

    def known(self, reference: str) -> str | None:
        if not (isinstance(reference, str) and reference.startswith("$")):
            raise ModelError(f"{reference!r} is no reference")
        name = reference[1:]
        return name if name in self.columns else None

    def value(self, expression: Any) -> tuple[list[Column], set[str]] | None:
        """The columns of an expression and the inputs it uses; None if the schema lacks them."""
        if isinstance(expression, str):
            name = self.known(expression)
            return ([F.col(f"`{name}`")], {name}) if name else None
        if isinstance(expression, tuple):
            *references, how = expression
            if not isinstance(how, (str, tuple)) or (isinstance(how, str) and how.startswith("$")):
                raise ModelError(f"{expression} lacks a separator")
            present = [n for n in map(self.known, references) if n]
            if not present:
                return None
            if len(present) == 1 and not (isinstance(how, str) and how in MODES):
                return [F.col(f"`{present[0]}`")], set(present)
            if isinstance(how, tuple):
                gaps = [how[min(references.index(f"${n}"), len(how)) - 1] for n in present[1:]]
                how = gaps
            cells = {n: F.when(has_value(F.col(f"`{n}`")), F.col(f"`{n}`")) if n in self.arrays else F.col(f"`{n}`") for n in present}
            return [merged(cells, how)], set(present)
        if isinstance(expression, dict):
            if len(expression) != 1:
                raise ModelError(f"{expression} has not one key")
            source, separators = next(iter(expression.items()))
            if isinstance(source, tuple) and source[-1] == separators and all(map(self.known, source[:-1])):
                names = [self.known(s) for s in source[:-1]]
                return [F.col(f"`{n}`") for n in names], set(names)  # merging and splitting again would change nothing
            found = self.value(source)
            return (split_parts(found[0][0], list(separators) if not isinstance(separators, str) else separators), found[1]) if found else None
        if isinstance(expression, list):
            return next((found for e in expression if (found := self.value(e)) is not None), None)
        if isinstance(expression, Deferred):
            return self.call(expression)
        raise ModelError(f"{expression!r} is no expression")

    def call(self, deferred: Deferred) -> tuple[list[Column], set[str]] | None:
        used: set[str] = set()
        arguments = []
        for value in (*deferred.args, *deferred.kwargs.values()):
            if is_reference(value):
                found = self.value(value)
                if found is None:
                    return None
                used |= found[1]
                value = found[0][0]
            arguments.append(value)
        n = len(deferred.args)
        first = (self.stage,) if deferred.staged else ()
        result = deferred.function(*first, *arguments[:n], **dict(zip(deferred.kwargs, arguments[n:])))
        return (list(result) if isinstance(result, (list, tuple)) else [result]), used

    def on_table(self, item: Field) -> Step | None:
        """A lifted function of the table, whose references may be several columns or alternatives."""
        kwargs = {k: v for k, v in item.value.kwargs.items() if k != "__table"}
        references = item.value.args
        if len(references) == 1 and not isinstance(references[0], str):
            found = self.value(references[0])
            if found is None:
                return None
            cells, used = found
            inputs = [f"__input_{item.outputs[0]}"]
        else:
            names = [self.known(r) for r in references]
            if None in names:
                return None
            cells, used, inputs = [], set(names), names
        taken = {o.lower() for o in item.outputs}
        drop = {u for u in used if item.drop and u.lower() not in taken and (cells or u == inputs[0])}
        self.columns = [c for c in self.columns if c not in drop and c not in item.outputs] + item.outputs

        def run(df: DataFrame) -> DataFrame:
            df = df.withColumn(inputs[0], cells[0]) if cells else df
            out = item.value.function(df, inputs, item.outputs, **kwargs)
            return out.drop(*drop, *(inputs if cells else []))

        return Step({}, table=run)

    def step(self, item: Field) -> Step | None:
        if isinstance(item.value, Deferred) and "__table" in item.value.kwargs:
            return self.on_table(item)
        self.stages += 1
        self.stage = Staging(f"__s{self.stages}")
        found = self.value(item.value)
        if found is None:
            return None
        results, used = found
        if len(results) < len(item.outputs):
            raise ModelError(f"{'__'.join(item.outputs)} has {len(results)} results")
        new = dict(zip(item.outputs, results))
        drop = {u for u in used if item.drop and u not in new}
        self.columns = [c for c in self.columns if c not in drop and c not in new] + list(new)
        self.arrays -= drop | set(new)
        return Step(new, drop, used=set(used), before=self.stage.levels)


def levels(steps: Sequence[Step]) -> list[Step]:
    """Neighbouring steps as one projection where the later does not read what the earlier makes."""
    out: list[Step] = []
    for step in steps:
        last = out[-1] if out else None
        if last is None or step.table or last.table or (step.used | set(step.new)) & set(last.new):
            out.append(Step(dict(step.new), set(step.drop), step.table, set(step.used), [dict(x) for x in step.before]))
        else:
            last.new |= step.new
            last.drop |= step.drop
            last.before = [a | b for a, b in itertools.zip_longest(last.before, step.before, fillvalue={})]
    return out


@dataclass
class Plan:
    """A compiled model."""

    steps: list[Step]
    order: list[str]
    fillable: list[str]
    missing: list[str]
    cut: bool
    fill: Any

    def apply(self, df: DataFrame) -> DataFrame:
        for step in levels(self.steps):
            if step.table is not None:
                df = step.table(df)
                continue
            kept = [f"`{c}`" for c in df.columns if c not in step.new and c not in step.drop]
            new = [v.alias(n) for n, v in step.new.items()]
            df = step.staging().select(df, *kept, *new) if step.before else df.select(*kept, *new)
        return final_columns(df, self.order, self.cut, self.fill, self.fillable)


class Model:
    """Fields in order, with a default for cutting other columns and filling missing ones."""

    def __init__(self, fields: Sequence[tuple[str, Any]], cut: bool = True, fill: Any = None, name: str = "Model", keep: Sequence[str] = ()):
        self.fields = [parse_field(n, v) for n, v in fields]
        self.cut, self.fill, self.name, self.keep = cut, fill, name, tuple(keep)

    def compile(self, columns: Sequence[str], arrays: Sequence[str] = ()) -> Plan:
        """The plan for a schema's column names, of which some hold arrays."""
        compiler, steps, fillable, missing = _Compiler(columns, arrays), [], [], []
        for item in self.fields:
            step = compiler.step(item)
            if step is not None:
                steps.append(step)
            elif item.create:
                fillable += item.outputs
            else:
                missing += item.outputs
        order = [o for f in self.fields for o in f.outputs if not self.keep or o in self.keep]
        return Plan(steps, order, fillable, missing, self.cut, self.fill)

    def __call__(self, df: DataFrame, aliases: Mapping[str, Sequence[str]] | None = None, overrides: Mapping[str, str | None] | None = None, policy: str = "error") -> DataFrame:
        """The model's table; with aliases, headers are aligned first."""
        if aliases is not None:
            from .align import align

            df = align(df, aliases, overrides, policy)
        return self.compile(df.columns, [c for c, kind in df.dtypes if kind.startswith("array<")]).apply(df)


def imodel(fields: EnumMeta | type | None = None, *, cut: bool = True, fill: Any = None):
    """Turn a class whose attributes are fields into a model.

    Enum classes lose members of equal value to aliases; their names are read in order all the same.
    """

    def build(cls) -> Model:
        if isinstance(cls, EnumMeta):
            members = [(n, m.value) for n, m in cls.__members__.items()]
        else:
            members = [(n, v) for n, v in vars(cls).items() if not (n.startswith("__") and n.endswith("__")) and n not in ("_abc_impl",)]
        return Model(members, cut, fill, cls.__name__)

    return build(fields) if fields is not None else build
