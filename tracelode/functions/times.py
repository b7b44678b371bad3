"""Times kept as ISO 8601 strings with mixed offsets, ages and cut-offs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def instant(text: Column) -> Column:
    """The instant of an ISO string; without an offset it is UTC (the session's zone); null where it cannot be read."""
    return F.try_to_timestamp(F.regexp_replace(text, "Z$", "+00:00"))


def epoch_seconds(at: Column) -> Column:
    """Seconds since the epoch, with fractions, of a timestamp of either kind."""
    return F.unix_micros(at.cast("timestamp")) / F.lit(1e6)


def epoch_ms_to_iso(ms: Column) -> Column:
    """An ISO string in UTC of milliseconds; values too large for that are nanoseconds."""
    return F.date_format(F.timestamp_millis(F.when(F.abs(ms) > 10**14, F.floor(ms.cast("decimal(20,0)") / F.lit(10**6).cast("decimal(7,0)")).cast("bigint")).otherwise(ms).cast("bigint")), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def age_seconds(text: Column) -> Column:
    """Seconds of an age such as 36h, 7d or 2w; null for anything else."""
    n = F.try_to_number(F.regexp_extract(text, r"^(\d{1,9})[hdw]$", 1), F.lit("999999999")).cast("bigint")
    return n * F.when(text.endswith("h"), 3600).when(text.endswith("d"), 86400).when(text.endswith("w"), 604800)


def since_cutoff(text: Column, now: Column) -> Column:
    """The instant an age or a date names, seen from ``now``."""
    back = F.timestamp_micros(F.unix_micros(now.cast("timestamp")) - age_seconds(text) * 1_000_000)
    return F.coalesce(back, instant(text))


def ago(seconds: Column) -> Column:
    """An age in words: minutes below an hour, hours below two days, then days."""
    s = F.greatest(seconds, F.lit(0)).cast("bigint")
    return F.when(s < 3600, F.concat(F.floor(s / 60).cast("string"), F.lit(" min ago"))).when(s < 172800, F.concat(F.floor(s / 3600).cast("string"), F.lit(" h ago"))).otherwise(F.concat(F.floor(s / 86400).cast("string"), F.lit(" d ago")))
