"""Time parsing, local wall clocks and calendar buckets, as column expressions. The session time zone is UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from listenlake.params import TemporalParams


def parse_long_date(value: Column) -> Column:
    """'January 02, 2024 at 03:04PM' in UTC; null for anything else, a bare date too."""
    return F.try_to_timestamp(value, F.lit("MMMM d, yyyy 'at' h:mma"))


def parse_iso(value: Column) -> Column:
    """ISO 8601 with Z, an offset or none (UTC); null without a full date."""
    return F.when(value.rlike(r"^\d{4}-\d{2}-\d{2}"), value.try_cast("timestamp"))


def parse_minutes(value: Column) -> Column:
    return F.try_to_timestamp(value, F.lit("yyyy-MM-dd HH:mm"))


def wall_clock(instant: Column, zone: Column) -> Column:
    """What a clock in ``zone`` showed then, with its rules of that day."""
    return F.from_utc_timestamp(instant, zone).cast("timestamp_ntz")


def in_ranges(value: Column, ranges: dict[str, tuple[int, int]], inclusive: bool) -> Column:
    """The first range that holds ``value``, else 'unknown'."""
    out = None
    for name, (low, high) in ranges.items():
        under = value <= high if inclusive else value < high
        inside = (value >= low) & under if low <= high else (value >= low) | under
        out = F.when(inside, name) if out is None else out.when(inside, name)
    return out.otherwise("unknown") if out is not None else F.lit("unknown")


def buckets(at: Column, params: TemporalParams = TemporalParams()) -> list[Column]:
    """day_part, weekday_kind and season of a local time."""
    return [
        in_ranges(F.hour(at), params.day_parts, False).alias("day_part"),
        in_ranges(F.weekday(at) + 1, params.weekday_kinds, True).alias("weekday_kind"),
        in_ranges(F.month(at), params.seasons, True).alias("season"),
    ]


def micros(at: Column) -> Column:
    return F.unix_micros(at.cast("timestamp"))
