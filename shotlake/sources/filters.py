"""Filters that Spark hands to a data source, judged on a value as Spark would judge them."""

from __future__ import annotations

from pyspark.sql.datasource import EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, IsNotNull, IsNull, LessThan, LessThanOrEqual, Not, StringContains, StringEndsWith, StringStartsWith

_COMPARED = {
    EqualTo: lambda x, v: x == v,
    GreaterThan: lambda x, v: x > v,
    GreaterThanOrEqual: lambda x, v: x >= v,
    LessThan: lambda x, v: x < v,
    LessThanOrEqual: lambda x, v: x <= v,
    StringStartsWith: lambda x, v: x.startswith(v),
    StringEndsWith: lambda x, v: x.endswith(v),
    StringContains: lambda x, v: v in x,
}


def column_of(f: Filter) -> str | None:
    """The one top-level column that f looks at; None where it is nested, or f is of a kind that holds() does not know."""
    while type(f) is Not:
        f = f.child
    known = type(f) in _COMPARED or type(f) in (In, IsNull, IsNotNull, EqualNullSafe)
    return f.attribute[0] if known and len(f.attribute) == 1 else None


def holds(f: Filter, x) -> bool | None:
    """Whether f holds for a value of its column; None where that is unknown, as SQL has it."""
    kind = type(f)
    if kind is Not:
        inner = holds(f.child, x)
        return None if inner is None else not inner
    if kind in (IsNull, IsNotNull):
        return (x is None) == (kind is IsNull)
    if kind is EqualNullSafe:
        return x == f.value
    if x is None:
        return None
    if kind is In:
        return True if any(v is not None and v == x for v in f.value) else None if None in f.value else False
    return None if f.value is None else _COMPARED[kind](x, f.value)


def all_hold(filters: list[Filter], x) -> bool:
    return all(holds(f, x) is True for f in filters)


def span(f: Filter) -> tuple[int | None, int | None]:
    """Between which whole numbers, both included, any number lies for which f holds; None for no bound, (1, 0) for none at all."""
    kind, v = type(f), getattr(f, "value", None)
    if kind is In:
        known = [x for x in v if x is not None]
        return (min(known), max(known)) if known else (1, 0)
    if kind in _COMPARED and v is None:
        return 1, 0
    if kind in (EqualTo, EqualNullSafe) and v is not None:
        return v, v
    return {GreaterThan: lambda: (v + 1, None), GreaterThanOrEqual: lambda: (v, None), LessThan: lambda: (None, v - 1), LessThanOrEqual: lambda: (None, v)}.get(kind, lambda: (None, None))()


def may_hold(filters: list[Filter], low: int, high: int) -> bool:
    """Whether some whole number of low to high may pass all filters; in lists each value is looked at."""
    for f in filters:
        a, b = span(f)
        if (a is not None and a > high) or (b is not None and b < low) or (a is not None and b is not None and a > b):
            return False
        if type(f) is In and not any(v is not None and low <= v <= high for v in f.value):
            return False
    return True
