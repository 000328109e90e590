"""Instants and wall times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def utc_instant(text: Column) -> Column:
    """A timestamp (whole seconds) from ISO text that states an offset; null otherwise."""
    has_offset = F.trim(text).rlike(r"(?:Z|[+-]\d{2}:?\d{2})$")
    return F.when(has_offset, F.date_trunc("second", F.try_to_timestamp(F.trim(text))))


def local_to_utc(wall: Column, zone: Column, fold: Column) -> Column:
    """Struct (at, problem): the UTC instant of a wall time (timestamp_ntz).

    A time that a clock change skips is `nonexistent`; one that occurs twice needs fold 0 or 1, else it is `ambiguous`.
    """
    session = wall.cast("timestamp")  # the session's zone is UTC
    early = F.to_utc_timestamp(session, zone)
    shown = lambda t: F.from_utc_timestamp(t, zone)
    # Zones shift by an hour, a few by half an hour.
    late = F.coalesce(*[F.when(shown(early + F.expr(f"INTERVAL '{m}' MINUTE")) == session, early + F.expr(f"INTERVAL '{m}' MINUTE")) for m in (60, 30)])
    before = F.coalesce(*[F.when(shown(early - F.expr(f"INTERVAL '{m}' MINUTE")) == session, early - F.expr(f"INTERVAL '{m}' MINUTE")) for m in (60, 30)])
    first, second = F.coalesce(before, early), F.coalesce(late, F.when(before.isNotNull(), early))
    at = F.when(shown(early) != session, F.lit(None).cast("timestamp")).when(second.isNull(), early).when(fold == 0, first).when(fold == 1, second)
    problem = F.when(shown(early) != session, "nonexistent").when(second.isNotNull() & (fold.isNull() | ~fold.isin(0, 1)), "ambiguous")
    return F.struct(at.alias("at"), problem.alias("problem"))


def local_text(at: Column, zone: Column) -> Column:
    """ISO text of an instant in a zone, with its offset."""
    wall = F.from_utc_timestamp(at, zone)
    minutes = ((F.unix_timestamp(wall) - F.unix_timestamp(at)) / 60).cast("int")
    sign = F.when(minutes < 0, "-").otherwise("+")
    offset = F.concat(sign, F.lpad((F.abs(minutes) / 60).cast("int").cast("string"), 2, "0"), F.lit(":"), F.lpad((F.abs(minutes) % 60).cast("string"), 2, "0"))
    return F.concat(F.date_format(wall, "yyyy-MM-dd'T'HH:mm:ss"), offset)
