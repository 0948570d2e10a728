"""Column expressions shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the cost model and the display bands.
TRANSACTION_COST_BPS = 5.0
SLIPPAGE_BPS = 2.0
MAX_POSITION = 0.1
BPS = 1e-4
TRADING_DAYS = 252
MATCH_TOLERANCE = 1e-9


def ratio_change(new: Column, old: Column) -> Column:
    """``new / old - 1``; NULL when the base is zero (ANSI division would raise)."""
    return F.try_divide(new, old) - F.lit(1.0)


def change(new: Column, old: Column) -> Column:
    """``(new - old) / old``, the form (and rounding) of the live process."""
    return F.try_divide(new - old, old)


def null_if_nan(c: Column) -> Column:
    """NaN means "no value" in vendor frames; the engine knows only NULL."""
    return F.when(~F.isnan(c), c)


def values_match(a: Column, b: Column, tol: float = MATCH_TOLERANCE) -> Column:
    """Relative comparison where two absent values agree and one absent value does not."""
    near = F.abs(a - b) <= F.lit(tol) * (F.lit(1.0) + F.abs(b))
    return (a.isNull() & b.isNull()) | F.coalesce(near, F.lit(False))


def knowable_value(value: Column, event: Column, knowledge: Column) -> Column:
    """The value itself, or a failed job if it claims to be known before it was true.

    The check sits inside the value, so column pruning cannot drop it.
    """
    message = F.concat(
        F.lit("knowledge "), knowledge.cast("string"),
        F.lit(" precedes event "), event.cast("string"),
    )
    return F.when(knowledge < event, F.raise_error(message).cast("double")).otherwise(value)


def epoch_seconds(df: DataFrame, name: str) -> Column:
    """Whole seconds since 1970 for a date, zone-free or instant column, in time order.

    Zone-free timestamps go through date parts: a cast to an instant is not monotone where the
    session zone has daylight saving.
    """
    c = F.col(name)
    if isinstance(df.schema[name].dataType, T.TimestampType):
        return F.unix_seconds(c)
    days = F.datediff(c.cast("date"), F.lit("1970-01-01")).cast("long")
    if isinstance(df.schema[name].dataType, T.DateType):
        return days * 86400
    return days * 86400 + F.hour(c) * 3600 + F.minute(c) * 60 + F.second(c)


def position(p_up: Column, cap: float = MAX_POSITION) -> Column:
    """Position size from the probability of a rise, clipped to +-cap."""
    return F.greatest(F.lit(-cap), F.least(F.lit(cap), F.lit(2.0) * (p_up - F.lit(0.5))))


def trading_cost(turnover: Column, pos: Column) -> Column:
    return turnover * F.lit(TRANSACTION_COST_BPS * BPS) + F.abs(pos) * F.lit(SLIPPAGE_BPS * BPS)


def signal(p_up: Column) -> Column:
    return F.when(p_up >= 0.5, F.lit("bullish")).when(p_up.isNotNull(), F.lit("bearish"))


def scaled_to_band(x: Column, low: float, high: float) -> Column:
    """Place of x in a fixed display range, clipped to 0..1."""
    share = (x - F.lit(low)) / F.lit(high - low)
    return F.when(x.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)))


def clean_symbol(c: Column) -> Column:
    """Upper-cased, trimmed symbol; NULL when blank."""
    s = F.upper(F.trim(c))
    return F.when(s != "", s)


def epoch_micros(df: DataFrame, name: str) -> Column:
    """Microseconds since 1970 of a time column, or the integer column itself."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(F.col(name))
    if isinstance(kind, T.TimestampNTZType):
        micros = (F.date_part(F.lit("SECOND"), F.col(name)) % 1 * 1_000_000).cast("long")
        return epoch_seconds(df, name) * 1_000_000 + micros
    return F.col(name).cast("long")


def order_key(df: DataFrame, columns: Sequence[str]) -> Column:
    """A key that sorts like the tuple of ``columns``.

    One or two time or integer columns become a number (two of them if the first is a time: 18 digits
    hold any of those, but not any integer). Fixed-width keys let ``min_by``/``max_by``
    aggregate in a hash map; a struct key would force a sort of every input partition.
    """
    integral = (T.IntegralType, T.TimestampType, T.TimestampNTZType)
    if len(columns) > 2 or not all(isinstance(df.schema[c].dataType, integral) for c in columns):
        return F.struct(*columns)
    if len(columns) == 2 and isinstance(df.schema[columns[0]].dataType, T.LongType):
        return F.struct(*columns)
    first = epoch_micros(df, columns[0])
    if len(columns) == 1:
        return first
    return packed(first, (signed_to_unsigned(epoch_micros(df, columns[1])), 20))


def signed_to_unsigned(c: Column) -> Column:
    """A 64-bit integer shifted to 0..2^64-1 (at most 20 digits), keeping its order."""
    return c.cast("decimal(20,0)") + F.lit("9223372036854775808").cast("decimal(20,0)")


def packed(first: Column, *rest: tuple[Column, int]) -> Column:
    """Concatenate integers digit-wise into one decimal; ``rest`` gives (value >= 0, digits)."""
    digits = sum(d for _, d in rest)
    if digits > 30:
        raise ValueError("packed keys hold 38 digits, 30 of them after the first part")
    key = first.cast(f"decimal({38 - digits},0)")
    for value, width in rest:
        shifted = (key * F.lit("1" + "0" * width).cast(f"decimal({width + 1},0)"))
        key = (shifted + value.cast(f"decimal({width},0)")).cast("decimal(38,0)")
    return key
