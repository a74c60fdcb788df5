"""Timestamp parsing. Two epoch thresholds exist; each reader picks its own parser."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mnemolake.functions.clean import strip

_ZONED = (
    "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "yyyy-MM-dd'T'HH:mm:ss.SSSXXX", "yyyy-MM-dd'T'HH:mm:ssXXX",
    "yyyy-MM-dd HH:mm:ss.SSSSSSXXX", "yyyy-MM-dd HH:mm:ss.SSSXXX", "yyyy-MM-dd HH:mm:ssXXX",
)
_NAIVE = (
    "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "yyyy-MM-dd'T'HH:mm:ss.SSS", "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd HH:mm:ss.SSSSSS", "yyyy-MM-dd HH:mm:ss.SSS", "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd HH:mm", "yyyy-MM-dd",
)


def epoch_to_timestamp(seconds_or_ms: Column, ms_above: float) -> Column:
    v = seconds_or_ms.cast("double")
    return F.timestamp_micros(F.round(F.when(v > ms_above, v / 1000.0).otherwise(v) * 1e6).cast("long"))


def parse_ts(value: Column) -> Column:
    """P14, tolerant form: epoch numbers (milliseconds above 1e11) or twelve text formats."""
    s = strip(value.cast("string"))
    epoch = F.when(s.rlike(r"^\d{9,13}(\.\d+)?$"), s.try_cast("double"))
    # a bare +HH zone becomes +HH:00, +HHMM becomes +HH:MM
    zoned = F.regexp_replace(s, r"([+-]\d{2})$", "$1:00")
    zoned = F.when(s.rlike(r"T.*[+-]\d{2}$| \d.*:.*[+-]\d{2}$"), zoned).otherwise(
        F.regexp_replace(s, r"([+-]\d{2})(\d{2})$", "$1:$2")
    )
    with_zone = F.coalesce(*[F.try_to_timestamp(zoned, F.lit(f)) for f in _ZONED])
    naive = F.coalesce(*[F.try_to_timestamp(s, F.lit(f)) for f in _NAIVE])
    return F.coalesce(epoch_to_timestamp(epoch, 1e11), with_zone, naive)


def iso_utc(ts: Column) -> Column:
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("Z"))


def to_iso(value: Column) -> Column:
    """P14, keep form: date-like text unchanged, epoch (milliseconds above 1e12) rendered."""
    s = strip(value.cast("string"))
    epoch = F.when(s.rlike(r"^-?\d+(\.\d+)?([eE]\d+)?$"), s.try_cast("double"))
    rendered = F.concat(
        F.date_format(epoch_to_timestamp(F.floor(epoch), 1e12), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")
    )
    return (
        F.when(s == "", F.lit(None))
        .when(s.rlike(r"^\d{4}-\d{2}-\d{2}"), s)
        .when(epoch.isNotNull(), rendered)
        .otherwise(s)
    )


def same_instant(a: Column, b: Column) -> Column:
    """two renderings of one moment are equal whatever their zone."""
    return parse_ts(a) == parse_ts(b)


def event_bounds(links: Column, created_at: Column, kinds=("event_time", "source_event")) -> Column:
    """``struct(started, ended)`` from the first event link that has a bound, else ``created_at``.

    ``links``: array of struct(kind, start, end) with ISO text bounds.
    """
    known = F.filter(links, lambda x: x["kind"].isin(*kinds) & (x["start"].isNotNull() | x["end"].isNotNull()))
    first = F.get(known, 0)
    start, end = first["start"].try_cast("timestamp"), first["end"].try_cast("timestamp")
    return F.struct(
        F.coalesce(start, end, created_at).alias("started"), F.coalesce(end, start, created_at).alias("ended")
    )
