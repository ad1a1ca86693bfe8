"""Row filters (F1-F14). All are plain ``where`` predicates, so Catalyst
pushes them into the Parquet scan (``PushedFilters``) and below joins and
group-bys on their keys; optional filters combine by AND."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ALL = "ALL"


def not_cancelled_strict(df: DataFrame) -> DataFrame:
    """``cancelled = FALSE`` (NULL rows are dropped)."""
    return df.where(F.col("cancelled") == F.lit(False))


def not_cancelled_lenient(df: DataFrame) -> DataFrame:
    """``cancelled = FALSE OR cancelled IS NULL``."""
    return df.where(~F.coalesce(F.col("cancelled"), F.lit(False)))


def _given(v) -> bool:
    return v is not None and v != "" and v != ALL


def by_keys(df: DataFrame, airline: str | None = None, origin: str | None = None,
            dest: str | None = None) -> DataFrame:
    """equality on carrier / origin / dest; arguments are upper-cased.

    ``None``, empty and the ``"ALL"`` sentinel mean no filter (F7).
    """
    for col, v in (("operating_airline", airline), ("origin", origin), ("dest", dest)):
        if _given(v):
            df = df.where(F.col(col) == F.lit(str(v).upper()))
    return df


def _month_key(d) -> int:
    d = _dt.date.fromisoformat(str(d)[:10])
    return d.year * 100 + d.month


def date_range(df: DataFrame, date_from=None, date_to=None, col: str = "flightdate") -> DataFrame:
    """inclusive date range. On the bronze table the matching partition
    predicate on ``flight_month`` is added so whole months are pruned."""
    part = "flight_month" in df.columns
    if date_from:
        df = df.where(F.col(col) >= F.lit(str(date_from)[:10]).cast("date"))
        if part:
            df = df.where(F.col("flight_month") >= _month_key(date_from))
    if date_to:
        df = df.where(F.col(col) <= F.lit(str(date_to)[:10]).cast("date"))
        if part:
            df = df.where(F.col("flight_month") <= _month_key(date_to))
    return df


def delayed_only(df: DataFrame, col: str = "depdel15") -> DataFrame:
    """``depdel15 = TRUE``."""
    return df.where(F.col(col) == F.lit(True))


def month_between(df: DataFrame, lo: int = 1, hi: int = 12, col: str = "flightdate") -> DataFrame:
    """calendar month in [lo, hi]. On a frame with the bronze partition
    column whole months are pruned."""
    if lo <= 1 and hi >= 12:
        return df
    if "flight_month" in df.columns:
        df = df.where((F.col("flight_month") % 100).between(lo, hi))
    return df.where(F.month(F.col(col)).between(lo, hi))


def dashboard_filter(airline: str | None = ALL, origin: str | None = ALL,
                     months: tuple[int, int] = (1, 12), delayed: bool = False,
                     dest: str | None = ALL):
    """the composed dashboard filter, as a function for ``DataFrame.transform``."""
    def _apply(df: DataFrame) -> DataFrame:
        out = by_keys(df, airline, origin, dest).transform(
            lambda d: month_between(d, months[0], months[1]))
        return delayed_only(out) if delayed else out
    return _apply


def positive(df: DataFrame, col: str = "depdelay") -> DataFrame:
    """strictly positive delay."""
    return df.where(F.col(col) > 0)


def at_most(df: DataFrame, col: str, v) -> DataFrame:
    """upper bound on an aggregate; ``0`` is a real bound (``is not None``)."""
    return df if v is None else df.where(F.col(col) <= F.lit(v))


def airborne(df: DataFrame) -> DataFrame:
    """on_ground = FALSE with latitude, longitude and callsign present."""
    return (df.where(F.col("on_ground") == F.lit(False))
              .dropna(subset=["latitude", "longitude", "callsign"]))


def country(df: DataFrame, name: str | None) -> DataFrame:
    """origin_country equality (exact, as stored)."""
    return df if not name else df.where(F.col("origin_country") == F.lit(name))
