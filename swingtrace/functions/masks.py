"""Predicates over dimensions: one segment, its exclusion, and typed filter scopes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from swingtrace.functions.metrics import QueryError, check_dimension


@dataclass(frozen=True)
class Mask:
    """A predicate, what it says in words, and the dimensions it needs."""

    condition: Column | None = None
    text: str = "no exclusions"
    dims: tuple[str, ...] = ()
    filters: Mapping[str, str] = field(default_factory=dict)

    @property
    def is_open(self) -> bool:
        return self.condition is None

    def apply(self, df):
        return df if self.condition is None else df.filter(self.condition)


OPEN = Mask()


def _union(*groups: Sequence[str]) -> tuple[str, ...]:
    return tuple(dict.fromkeys(d for g in groups for d in g))


def _split(dim: str, val: str) -> list[tuple[str, str]]:
    """``a|b`` with ``x|y`` is two equalities; anything else is one."""
    names = dim.split("|")
    if len(names) == 1:
        return [(dim, val)]
    values = (val.split("|") + [""] * len(names))[: len(names)]
    return list(zip(names, values))


def segment_condition(dim: str, val: str) -> Column:
    return reduce(lambda a, b: a & b, (F.col(d) == F.lit(v) for d, v in _split(dim, val)))


def segment_mask(dim: str, val: str) -> Mask:
    return Mask(segment_condition(dim, val), f"{dim}='{val}'", tuple(dim.split("|")))


def exclusion_mask(dim: str, val: str) -> Mask:
    """Everything but one segment. Needs columns without NULLs, which enrichment guarantees."""
    return Mask(~segment_condition(dim, val), f"excluding {dim} = '{val}'", tuple(dim.split("|")))


def and_mask(a: Mask, b: Mask) -> Mask:
    if a.is_open:
        return b
    if b.is_open:
        return a
    return Mask(a.condition & b.condition, f"{a.text}; {b.text}", _union(a.dims, b.dims))


def exclude_all(segments: Sequence[tuple[str, str]]) -> Mask:
    return reduce(and_mask, (exclusion_mask(d, v) for d, v in segments), OPEN)


def scope(filters: Mapping[str, object] | None, metric: str) -> Mask:
    """Filters per dimension: exact, list, ``prefix*`` or a pair. Meaningless ones are refused."""
    if not filters:
        return OPEN
    conditions, words, dims, clean = [], [], [], {}
    for dim, value in filters.items():
        names = dim.split("|")
        for name in names:
            check_dimension(metric, name)
        dims.append(names)
        if len(names) > 1:
            if not isinstance(value, str) or "|" not in value:
                raise QueryError(f"pair filter {dim!r} needs a value of the form 'a|b'")
            conditions.append(segment_condition(dim, value))
            words.append(", ".join(f"{d}='{v}'" for d, v in _split(dim, value)))
            clean[dim] = value
        elif isinstance(value, (list, tuple)):
            if not value or not all(isinstance(v, str) for v in value):
                raise QueryError(f"filter {dim!r} needs a non-empty list of strings")
            conditions.append(F.col(dim).isin(*value))
            words.append(f"{dim} in ({', '.join(value)})")
            clean[dim] = " | ".join(value)
        elif not isinstance(value, str):
            raise QueryError(f"filter {dim!r} must be a string, a list or 'prefix*'")
        elif value.endswith("*"):
            prefix = value[:-1]
            if not prefix:
                raise QueryError(f"filter {dim!r} matches everything; leave it out")
            conditions.append(F.col(dim).startswith(prefix))
            words.append(f"{dim} starts with '{prefix}'")
            clean[dim] = value
        else:
            conditions.append(F.col(dim) == F.lit(value))
            words.append(f"{dim}='{value}'")
            clean[dim] = value
    return Mask(reduce(lambda a, b: a & b, conditions), ", ".join(words), _union(*dims), clean)
