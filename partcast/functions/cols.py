"""Small reusable column expressions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def day_start(d: dt.date) -> Column:
    """Timestamp literal for midnight of ``d`` (keeps predicates on raw
    timestamp columns so they reach the parquet scan).  Built as a
    TIMESTAMP_NTZ from ISO text, so no session or machine time zone is involved
    (a Python ``datetime`` literal would be read in the local zone)."""
    return F.lit(f"{d.isoformat()} 00:00:00").cast("timestamp_ntz")


def ts_between_days(col: Column, start: dt.date | None, end: dt.date | None) -> Column:
    """``start <= col < end + 1 day`` on a timestamp column; either bound optional."""
    cond = F.lit(True)
    if start is not None:
        cond = cond & (col >= day_start(start))
    if end is not None:
        cond = cond & (col < day_start(end + dt.timedelta(days=1)))
    return cond


def count_if(cond: Column) -> Column:
    return F.sum(F.when(cond, 1).otherwise(0)).cast("bigint")
