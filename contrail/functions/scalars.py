"""Column expressions (JVM-side built-ins only; no Python UDFs)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from contrail.functions import constants as K


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# Measures are summed in whole steps of 10**-EXACT_DIGITS.
EXACT_DIGITS = 6


def exact_sum(col) -> Column:
    """Aggregate: the sum of ``col`` in units of 10**-6, exact (each value is
    rounded to 6 digits first). Whole parts and fractions are summed apart as
    longs; a sum beyond a long is an error, never a wrong number."""
    c = _c(col).cast("double")
    whole = F.floor(c)
    steps = F.round((c - whole) * 10 ** EXACT_DIGITS).cast("long")
    return (F.sum(whole).cast("decimal(19,0)") * F.lit(10 ** EXACT_DIGITS).cast("decimal(7,0)")
            + F.sum(steps))


def _half_up(num: Column, den: Column, digits: int) -> Column:
    """round(num / den, digits), ties away from zero, for exact whole ``num``
    and ``den``: floor((2 |num| 10**digits + den) / (2 den)) in decimals."""
    n, d = num.cast("decimal(30,0)"), den.cast("decimal(24,0)")
    twice = (F.abs(n) * F.lit(2 * 10 ** digits).cast("decimal(6,0)")).cast("decimal(37,0)") + d
    mag = F.call_function("div", twice, d * F.lit(2).cast("decimal(1,0)"))
    signed = F.when(n < 0, -mag).otherwise(mag)
    return F.when(d > 0, signed.cast("double") / F.lit(float(10 ** digits)))


def ratio_half_up(num, den, digits: int = 2) -> Column:
    """``round(num / den, digits)`` with half-up (away from zero) ties, exact.

    ``num`` and ``den`` must be whole numbers (counts and their products).
    Every engine yields the same double (a PostgreSQL ``ROUND(x::numeric, d)``
    of the exact ratio). NULL when ``den`` is 0/NULL.
    """
    return _half_up(_c(num), _c(den), digits)


def mean_half_up(total, count, digits: int = 2) -> Column:
    """``ROUND(total / count, digits)`` half-up, ``total`` from ``exact_sum``."""
    return _half_up(_c(total), _c(count).cast("decimal(18,0)") * F.lit(10 ** EXACT_DIGITS)
                    .cast("decimal(7,0)"), digits)


def avg_half_up(col, digits: int = 2) -> Column:
    """Aggregate: ``ROUND(AVG(col), digits)`` half-up, also for fractions."""
    return mean_half_up(exact_sum(col), F.count(_c(col)), digits)


def pct_half_up(count_true: Column, total: Column, digits: int = 2) -> Column:
    """``ROUND(count_true / total * 100, digits)`` half-up."""
    return ratio_half_up(count_true * 100, total, digits)


def hhmm_to_minutes(col) -> Column:
    """hhmm clock (3 or 4 digits, possibly '905.0') -> minutes of day; bad -> NULL.

    ``2400`` and anything over 4 digits are rejected (as the reference's
    ``%H%M`` parse does); minutes are 0..1439.
    """
    v = to_nullable_int(col)
    hh = F.floor(v / 100)
    mm = v - hh * 100
    ok = v.isNotNull() & (v >= 0) & (v <= 2359) & (mm < 60)
    return F.when(ok, (hh * 60 + mm).cast("int"))


def to_nullable_int(col) -> Column:
    """Text/number -> nullable int. '12.0' -> 12; '12.5' -> NULL (reported apart)."""
    d = _c(col).cast("string").try_cast("double")
    return F.when(d == F.floor(d), d.try_cast("int"))


def fractional_value(col) -> Column:
    """True where a value would lose its fraction when made an integer."""
    d = _c(col).cast("string").try_cast("double")
    return d.isNotNull() & (d != F.floor(d))


def to_bool(col, default: bool = False) -> Column:
    """Numeric/boolean/text flag -> boolean; missing -> ``default``."""
    c = _c(col)
    s = F.lower(F.trim(c.cast("string")))
    val = (F.when(s.isin("true", "t", "yes", "y"), F.lit(True))
           .when(s.isin("false", "f", "no", "n"), F.lit(False))
           .otherwise(s.try_cast("double") != 0))
    return F.coalesce(val, F.lit(default))


def flag_to_int(col) -> Column:
    """boolean delayed flag -> 0/1, NULL -> 0."""
    return F.coalesce(_c(col), F.lit(False)).cast("int")


def clip(col, lo=None, hi=None) -> Column:
    c = _c(col)
    if lo is not None:
        c = F.greatest(c, F.lit(lo))
    if hi is not None:
        c = F.least(c, F.lit(hi))
    return c


def route_label(origin="origin", dest="dest") -> Column:
    o, d = _c(origin), _c(dest)
    return F.when(o.isNotNull() & d.isNotNull(), F.concat_ws(" → ", o, d))


def pg_day_of_week(col) -> Column:
    """Day of week with Sunday = 0 (PostgreSQL ``EXTRACT(DOW)``)."""
    return (F.dayofweek(_c(col)) - 1).cast("int")


def day_name(col) -> Column:
    return F.date_format(_c(col), "EEEE")


def month_abbr(month_col) -> Column:
    """1..12 -> 'Jan'..'Dec'."""
    return F.element_at(F.array(*[F.lit(m) for m in K.MONTH_ABBR]), _c(month_col).cast("int"))


def risk_tier(prob) -> Column:
    p = _c(prob)
    return (F.when(p < K.RISK_LOW_BELOW, K.RISK_LABELS[0])
            .when(p < K.RISK_MEDIUM_BELOW, K.RISK_LABELS[1])
            .when(p.isNotNull(), K.RISK_LABELS[2]))


def oktas(cloud_pct) -> Column:
    """cloud cover percent -> oktas (eighths of sky)."""
    return _c(cloud_pct) / 100.0 * 8


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle distance in km."""
    la1, lo1, la2, lo2 = (F.radians(_c(x)) for x in (lat1, lon1, lat2, lon2))
    a = (F.pow(F.sin((la2 - la1) / 2), 2)
         + F.cos(la1) * F.cos(la2) * F.pow(F.sin((lo2 - lo1) / 2), 2))
    return F.lit(2 * 6371.0088) * F.asin(F.sqrt(a))
