"""Time helpers.  The session time zone must be UTC (see session.py)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def floor_to_window(ts, minutes, ntz: bool = True) -> Column:
    """Start of the tumbling window of ``minutes`` that holds ``ts``,
    floored on epoch minutes (windows are aligned to 1970-01-01 00:00 UTC).

    ``minutes`` may be a column (several window sizes in one pass).  Integer
    arithmetic on epoch microseconds, so it is exact and negative-safe.
    """
    m = _col(minutes) if not isinstance(minutes, int) else F.lit(minutes)
    micros = F.unix_micros(_col(ts).cast(T.TimestampType()))
    step = m.cast("long") * F.lit(60_000_000)
    start = F.timestamp_micros(micros - F.pmod(micros, step))
    return start.cast(T.TimestampNTZType()) if ntz else start


def add_minutes(ts, minutes) -> Column:
    m = _col(minutes) if not isinstance(minutes, int) else F.lit(minutes)
    return F.timestamp_add("MINUTE", m, _col(ts))
