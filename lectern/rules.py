"""Row rules: a list of (condition, code) becomes an array of violated codes."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import normalise_whitespace


def violations(rules: Iterable[tuple[Column, str]]) -> Column:
    """Array of the codes whose condition is true (null counts as not violated)."""
    return F.array_compact(F.array(*[F.when(cond, F.lit(code)) for cond, code in rules]))


def first_violation(rules: Iterable[tuple[Column, str]]) -> Column:
    """First violated code in rule order, null when the row is fine."""
    return F.coalesce(*[F.when(cond, F.lit(code)) for cond, code in rules])


def issue_rows(df: DataFrame, keys: list[str], rules: Iterable[tuple[Column, str]], code: str = "code") -> DataFrame:
    """One row per violated rule, no row for a clean input row."""
    return df.select(*keys, F.explode(violations(rules)).alias(code))


def blank(col: Column) -> Column:
    """True for null or whitespace-only text."""
    return F.coalesce(normalise_whitespace(col), F.lit("")) == ""
