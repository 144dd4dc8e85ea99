"""Filters: lists of {column, op, value, value2, values, columns}, all of which must hold."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import SheetError, col, text_form

MOST_VALUES = 10_000


def _needed(spec: dict, key: str):
    if spec.get(key) is None:
        raise SheetError(f"{spec.get('op')} needs {key}")
    return spec[key]


def _compare(df: DataFrame, spec: dict, how) -> Column:
    return how(col(df, spec["column"]), F.lit(_needed(spec, "value")).cast(df.schema[spec["column"]].dataType))


def _listed(df: DataFrame, spec: dict, keep: bool) -> Column:
    values = spec.get("values")
    if not isinstance(values, (list, tuple)):
        raise SheetError("values must be a list")
    if len(values) > MOST_VALUES:
        raise SheetError(f"more than {MOST_VALUES} values")
    c, named = col(df, spec["column"]), [str(v) for v in values if v is not None]
    hit = text_form(df, spec["column"]).isin(named) if named else F.lit(False)
    null = F.lit(None in values)
    found = F.when(c.isNull(), null).otherwise(hit)
    return found if keep else ~found


def _span(df: DataFrame, spec: dict) -> Column:
    t = df.schema[spec["column"]].dataType
    return col(df, spec["column"]).between(F.lit(_needed(spec, "value")).cast(t), F.lit(_needed(spec, "value2")).cast(t))


def predicate(df: DataFrame, spec: dict) -> Column:
    """One filter as a condition; unknown operations, columns or missing values raise SheetError."""
    if not isinstance(spec, dict) or "op" not in spec:
        raise SheetError("a filter is a dict with op")
    op = spec["op"]
    if op == "any_contains":
        if not (needle := str(spec.get("value") or "").lower()):
            return F.lit(True)
        parts = [F.coalesce(F.lower(text_form(df, n)).contains(needle), F.lit(False)) for n in spec.get("columns") or []]
        return reduce(or_, parts, F.lit(False))
    if "column" not in spec:
        raise SheetError("a filter needs a column")
    c, t = col(df, spec["column"]), text_form(df, spec["column"])
    null = c.isNull()
    low = lambda: str(_needed(spec, "value")).lower()
    raw = lambda: str(_needed(spec, "value"))
    made = {
        "is_null": lambda: null,
        "is_not_null": lambda: ~null,
        "is_blank": lambda: null | (t == ""),
        "is_not_blank": lambda: ~null & (t != ""),
        "in": lambda: _listed(df, spec, True),
        "not_in": lambda: _listed(df, spec, False),
        "between": lambda: _span(df, spec),
        "not_between": lambda: ~_span(df, spec),
        "contains": lambda: F.lower(t).contains(low()),
        "not_contains": lambda: null | ~F.lower(t).contains(low()),
        "starts_with": lambda: F.lower(t).startswith(low()),
        "ends_with": lambda: F.lower(t).endswith(low()),
        "equals_text": lambda: t == raw(),
        "not_equals_text": lambda: null | (t != raw()),
        "regex": lambda: t.rlike(raw()),
        "eq": lambda: _compare(df, spec, lambda a, b: a == b),
        "ne": lambda: null | _compare(df, spec, lambda a, b: a != b),
        "gt": lambda: _compare(df, spec, lambda a, b: a > b),
        "gte": lambda: _compare(df, spec, lambda a, b: a >= b),
        "lt": lambda: _compare(df, spec, lambda a, b: a < b),
        "lte": lambda: _compare(df, spec, lambda a, b: a <= b),
    }
    if op not in made:
        raise SheetError(f"unknown filter {op!r}")
    return made[op]()


def condition(df: DataFrame, filters: list[dict]) -> Column:
    return reduce(and_, [predicate(df, f) for f in filters or []], F.lit(True))


def keep(df: DataFrame, filters: list[dict]) -> DataFrame:
    """Rows that match; unknown counts as not matched."""
    return df.where(condition(df, filters))


def delete(df: DataFrame, filters: list[dict]) -> DataFrame:
    """Rows that do not match, those of which it is unknown included."""
    return df.where(~F.coalesce(condition(df, filters), F.lit(False)))
