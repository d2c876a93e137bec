"""Time expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import MONTH_CODES, TICKER_ZONE

# Date, T or blank, time, optional fraction, optional zone; text after that is ignored.
_ISO = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(Z|[+-]\d{2}(?::?\d{2})?)?"
_TICKER = r"-(\d{2})(" + "|".join(MONTH_CODES) + r")(\d{2})(\d{2})(\d{2})"


def micros(col: Column) -> Column:
    """Microseconds since 1970 of a TIMESTAMP or TIMESTAMP_NTZ (read as UTC)."""
    return F.unix_micros(col.cast("timestamp"))


def epoch_seconds(col: Column) -> Column:
    """Unix seconds, rounded to nearest as a SQL cast from numeric does."""
    return F.round(micros(col) / F.lit(1e6)).cast("bigint")


def epoch_millis(col: Column) -> Column:
    """Unix milliseconds, rounded to nearest."""
    return F.round(micros(col) / F.lit(1e3)).cast("bigint")


def from_seconds(col: Column) -> Column:
    return F.timestamp_seconds(col)


def from_millis(col: Column) -> Column:
    return F.timestamp_millis(col.cast("bigint"))


def parse_ts(col: Column) -> Column:
    """Unix seconds from epoch seconds, epoch milliseconds or ISO-like text.

    A naive time counts as UTC, trailing text is ignored, a bare date or a
    time outside the calendar gives NULL.
    """
    text = F.trim(col.cast("string"))
    number = text.cast("double")
    epoch = F.when(number > 1e12, number / 1000).otherwise(number).cast("bigint")
    stamp = F.try_to_timestamp(F.concat(F.substring(text, 1, 10), F.lit(" "), F.substring(text, 12, 8)),
                               F.lit("yyyy-MM-dd HH:mm:ss"))
    zone = F.regexp_extract(text, _ISO, 1)
    hours = F.substring(zone, 2, 2).cast("int")
    minutes = F.when(F.length(zone) > 3, F.right(zone, F.lit(2)).cast("int")).otherwise(0)
    offset = hours * 3600 + minutes * 60
    shift = (F.when(zone.startswith("+"), -offset).when(zone.startswith("-"), offset).otherwise(0))
    # Casts run only on text that was matched; failing ones are costly.
    return (F.when(text.rlike(r"^-?\d+(\.\d+)?([eE][+-]?\d+)?$"), epoch)
            .when(text.rlike(_ISO), F.unix_seconds(stamp) + shift))


def ticker_start(ticker: Column) -> Column:
    """Scheduled start in a ticker such as ``X-26AUG090300AB`` (US Eastern) as unix seconds."""
    def part(i):
        return F.regexp_extract(ticker, _TICKER, i)

    months = F.array(*[F.lit(m) for m in MONTH_CODES])
    local = F.try_make_timestamp(
        part(1).cast("int") + 2000, F.array_position(months, part(2)).cast("int"),
        part(3).cast("int"), part(4).cast("int"), part(5).cast("int"), F.lit(0).cast("decimal(8,6)"))
    return F.when(ticker.rlike(_TICKER),
                  F.unix_seconds(F.to_utc_timestamp(local, TICKER_ZONE)))


def match_date(col: Column) -> Column:
    """Strict ``yyyy-MM-dd HH:mm:ss`` in UTC as unix seconds, else NULL."""
    return F.when(col.rlike(r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}$"),
                  F.unix_seconds(F.try_to_timestamp(col, F.lit("yyyy-M-d H:m:s"))))
