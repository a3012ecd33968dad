"""Array expressions: run lengths, page sets and metadata predicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body`` as a bound variable.

    Spark copies an aliased expression to every place that uses it when it
    merges projections or pushes filters down; inside a lambda that means once
    for each element. A lambda variable is never copied.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def counted(values: Column, weight: float = 1.0) -> Column:
    """(term, tf) pairs of an array, counted inside the row."""
    return let(
        F.sort_array(values), lambda s: let(run_starts(s), lambda p: run_lengths(s, p, weight))
    )


def run_starts(ordered: Column) -> Column:
    """1-based positions where a sorted array begins a new value."""
    return F.when(
        F.size(ordered) > 0,
        F.filter(
            F.sequence(F.lit(1), F.size(ordered)),
            lambda i: (i == 1) | (F.get(ordered, i - 1) != F.get(ordered, i - 2)),
        ),
    ).otherwise(F.array().cast("array<int>"))


def run_lengths(ordered: Column, starts: Column, weight: float = 1.0) -> Column:
    """(term, tf) pairs of a sorted array, counted without leaving the row."""
    return F.transform(
        starts,
        lambda p, j: F.struct(
            F.get(ordered, p - 1).alias("term"),
            (F.lit(float(weight)) * (F.coalesce(F.get(starts, j + 1), F.size(ordered) + 1) - p)).alias("tf"),
        ),
    )


def page_set(page_number: Column, page_numbers: Column, pages: Column | None = None) -> Column:
    """{page_number} plus page_numbers, or plus pages when that list is absent."""
    rest = page_numbers if pages is None else F.coalesce(page_numbers, pages)
    rest = F.coalesce(rest, F.array().cast("array<int>"))
    return F.array_distinct(F.array_compact(F.concat(F.array(page_number.cast("int")), rest.cast("array<int>"))))


def matches(actual: Column, expected, actual_is_list: bool = False) -> Column:
    """Metadata predicate; a missing value never matches.

    list against list asks for a superset, list against scalar for membership,
    scalar against list for membership the other way, else equality.
    """
    many = isinstance(expected, (list, tuple, set))
    if actual_is_list and many:
        want = F.array(*[F.lit(v) for v in expected])
        hit = F.size(F.array_except(want, actual)) == 0
    elif actual_is_list:
        hit = F.array_contains(actual, F.lit(expected))
    elif many:
        hit = actual.isin(*expected)
    else:
        hit = actual == F.lit(expected)
    return F.coalesce(hit, F.lit(False))


def path_value(df: DataFrame, dotted: str) -> tuple[Column | None, bool]:
    """(value, whether it is an array) behind a dotted key through structs and maps; no value where the schema has no such key.

    A map that lacks the key gives null, as a struct field that is null does.
    """
    first, *rest = dotted.split(".")
    if first not in df.columns:
        return None, False
    at, kind = F.col(f"`{first}`"), df.schema[first].dataType
    for part in rest:
        if isinstance(kind, StructType) and part in kind.fieldNames():
            at, kind = at.getField(part), kind[part].dataType
        elif isinstance(kind, MapType):
            at, kind = F.try_element_at(at, F.lit(part)), kind.valueType
        else:
            return None, False
    return at, isinstance(kind, ArrayType)


def path_matches(df: DataFrame, dotted: str, expected) -> Column:
    """`matches` for the value behind a dotted key of ``df``; a missing key never matches."""
    value, is_list = path_value(df, dotted)
    return F.lit(False) if value is None else matches(value, expected, is_list)


def eligible(tenant: Column, corpus, status: Column | None = None, predicates=(), include_deprecated=False) -> Column:
    """Tenant equality, not deprecated, and every metadata predicate."""
    ok = F.coalesce(tenant == corpus, F.lit(False)) if corpus is not None else F.lit(True)
    if status is not None and not include_deprecated:
        ok = ok & (F.coalesce(status, F.lit("stable")) != "deprecated")
    for p in predicates:
        ok = ok & p
    return ok
