"""Canonical output form used by the registered queries.

Registered queries end with :func:`present`: dates and timestamps become ISO
strings, integral columns become bigint and doubles are rounded to 6 places,
so a result can be compared value-for-value with the DuckDB oracle.  The same
normalisation is applied to the oracle SQL (see ``partcast.plans.oracle``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIGITS = 6
BIG = 1e6          # from here on, round to SIG_DIGITS significant digits
SIG_DIGITS = 10


def _round_float(x, digits: int):
    """round(x, digits) the way DuckDB rounds doubles: scale by 10^digits, round
    half away from zero, scale back -- cheap float arithmetic (Spark's own
    ``round`` goes through BigDecimal).  Magnitudes beyond 1e12 are returned as
    is (the significant-digit branch handles them)."""
    m = float(10 ** digits)
    scaled = F.floor(F.abs(x) * m + 0.5).cast("double")
    return F.when(F.abs(x) < 1e12, F.signum(x) * scaled / m + F.lit(0.0)).otherwise(x)


def _significant(r):
    """Values >= 1e6 in magnitude, rounded to SIG_DIGITS significant digits
    (float noise of sums in a different order would otherwise show at the 6th
    decimal of a huge value); other values (and NaN) pass through.  Kept small:
    it is applied to every double column, and a large generated method would
    not be JIT-compiled."""
    mag = F.abs(r)
    big = (mag >= BIG) & (mag < float("inf"))
    # 10^k parsed from text: correctly rounded in every engine, unlike pow().  Its
    # input is NULL unless the value is large, so it costs nothing on ordinary rows.
    e = F.concat(F.lit("1e"), F.floor(F.log10(F.when(big, mag))).cast("string")).cast("double")
    v = r / e                       # in [1, 10) on the big branch
    m = float(10 ** (SIG_DIGITS - 1))
    return F.when(big, F.signum(v) * F.floor(F.abs(v) * m + 0.5).cast("double") / m * e).otherwise(r)


def canonical_double(c):
    """Round to 6 decimals, then large values to SIG_DIGITS significant digits."""
    return _significant(_round_float(c.cast("double"), DIGITS))


def present(df: DataFrame) -> DataFrame:
    """Two projections: the first rounds every double (and formats dates / casts
    integers), the second applies the rare significant-digit step to the rounded
    column -- separate projections so the rounded value is computed once per
    row instead of being inlined into every branch of the second step."""
    cols, doubles = [], []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        dt = f.dataType
        if isinstance(dt, (T.DoubleType, T.FloatType, T.DecimalType)):
            c = _round_float(c.cast("double"), DIGITS)
            doubles.append(f.name)
        elif isinstance(dt, T.DateType):
            c = c.cast("string")          # ISO yyyy-MM-dd; cheaper than date_format
        elif isinstance(dt, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(dt, (T.IntegerType, T.ShortType, T.ByteType, T.LongType)):
            c = c.cast("bigint")
        cols.append(c.alias(f.name))
    rounded = df.select(*cols)
    return rounded.select(*[_significant(F.col(f"`{n}`")).alias(n) if n in doubles else F.col(f"`{n}`")
                            for n in rounded.columns])
