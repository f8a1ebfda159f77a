"""Ratios in basis points, usage records and call prices."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def basis_points(numerator: Column, denominator: Column, empty: int | None = None) -> Column:
    """floor(n * 10000 / d), at most 10000; ``empty`` (null or 0) when d is 0."""
    n, d = numerator.cast("long"), denominator.cast("long")
    # least() ignores nulls, so the empty case is decided before it.
    value = F.when(d > 0, F.least(F.lit(10000).cast("long"), F.call_function("div", n * 10000, d)))
    return F.coalesce(value, F.lit(empty).cast("long")) if empty is not None else value


def confidence_default(has_citations: Column, difficult: Column | None = None, explanation: bool = False) -> Column:
    """9000 with support; 6000 without, 6500 for an explanation without a difficult passage."""
    support = difficult if explanation and difficult is not None else has_citations
    return F.when(support, F.lit(9000)).otherwise(F.lit(6500 if explanation else 6000)).cast("long")


def valid_usage(input_tokens: Column, output_tokens: Column, cached: Column, cache_write: Column) -> Column:
    """Usage record, or null when any count is missing, negative or inconsistent."""
    cached0 = F.coalesce(cached, F.lit(0).cast("long"))
    ok = (
        (input_tokens >= 0)
        & (output_tokens >= 0)
        & (cached0 >= 0)
        & (cached0 <= input_tokens)
        & (F.coalesce(cache_write, F.lit(0).cast("long")) == 0)
    )
    return F.when(
        ok,
        F.struct(
            input_tokens.cast("long").alias("input_tokens"),
            cached0.cast("long").alias("cached_input_tokens"),
            output_tokens.cast("long").alias("output_tokens"),
        ),
    )


def flat_cost(input_tokens: Column, output_tokens: Column, input_rate, output_rate) -> Column:
    """USD; null when any part is unknown.  Rates are USD per million tokens."""
    return (input_tokens * _rate(input_rate) + output_tokens * _rate(output_rate)) / F.lit(1_000_000.0)


def cached_cost(usage: Column, input_rate, cached_rate, output_rate) -> Column:
    """USD of a valid usage record; null for a null record."""
    fresh = usage["input_tokens"] - usage["cached_input_tokens"]
    return (
        fresh * _rate(input_rate)
        + usage["cached_input_tokens"] * _rate(cached_rate)
        + usage["output_tokens"] * _rate(output_rate)
    ) / F.lit(1_000_000.0)


# USD per million tokens, short and long context.
TIERED_RATES = {
    "short": {"input": 10.0, "cached": 1.0, "write": 12.5, "output": 50.0},
    "long": {"input": 20.0, "cached": 2.0, "write": 25.0, "output": 75.0},
}
LONG_CONTEXT_ABOVE = 272_000


def tiered_cost(input_tokens: Column, cached: Column, write: Column, output_tokens: Column) -> Column:
    """USD with long-context rates above 272 000 input tokens; null for bad counts."""
    cached0 = F.coalesce(cached, F.lit(0).cast("long"))
    write0 = F.coalesce(write, F.lit(0).cast("long"))
    is_long = input_tokens > LONG_CONTEXT_ABOVE

    def rate(kind: str) -> Column:
        return F.when(is_long, F.lit(TIERED_RATES["long"][kind])).otherwise(F.lit(TIERED_RATES["short"][kind]))

    ok = (input_tokens >= 0) & (output_tokens >= 0) & (cached0 >= 0) & (write0 >= 0) & (
        cached0 + write0 <= input_tokens
    )
    usd = (
        (input_tokens - cached0 - write0) * rate("input")
        + cached0 * rate("cached")
        + write0 * rate("write")
        + output_tokens * rate("output")
    ) / F.lit(1_000_000.0)
    return F.when(ok, usd)


def _rate(value) -> Column:
    return value if isinstance(value, Column) else F.lit(float(value))


def wall_micros(ts: Column) -> Column:
    """Microseconds since 1970 of a wall-clock timestamp, whatever the session time zone."""
    seconds = F.unix_date(ts.cast("date")).cast("long") * 86_400 + F.hour(ts) * 3_600 + F.minute(ts) * 60
    return seconds * 1_000_000 + (F.extract(F.lit("SECOND"), ts) * 1_000_000).cast("long")
