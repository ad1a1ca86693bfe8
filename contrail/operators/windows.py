"""Keep-one-row-per-key operators (W1, W3, W4) and frame-wide scalars.

"Keep the first/newest row per key" is written as an aggregate over a
struct - ``min(struct(order..., payload...))`` - instead of
``row_number() over (partition by key order by ...)``. Both are exact and
deterministic (the payload breaks ties), but the aggregate combines
map-side: each task ships one row per key to the shuffle, so a key holding a
third of all rows costs one row of shuffle, not a third of the data, and
never gathers into one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _pick(df: DataFrame, keys: list[str], order: list[str], newest: bool) -> DataFrame:
    """One row per key: the smallest (``newest=False``) or largest order tuple,
    ties broken by the remaining columns. A NULL order value never wins: each
    order column is preceded by a flag that sorts NULLs after values for min
    and before them for max."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    fields = []
    for c in order:
        flag = F.col(c).isNotNull() if newest else F.col(c).isNull()
        fields += [flag.alias(f"_n_{c}"), F.col(c).alias(c)]
    s = F.struct(*fields, *[F.col(c) for c in rest])
    agg = F.max(s) if newest else F.min(s)
    out = df.groupBy(*keys).agg(agg.alias("_s"))
    return out.select(*keys, *[F.col(f"_s.{c}").alias(c) for c in order + rest]).select(*df.columns)


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Smallest ``order`` tuple per key (ties broken by the other columns);
    NULL order values come last."""
    return _pick(df, keys, order, newest=False)


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Largest ``order`` tuple per key (ties broken by the other
    columns); NULL order values lose."""
    return _pick(df, keys, order, newest=True)


def frame_stat(df: DataFrame, agg: Column) -> Column:
    """One aggregate over a whole (usually already aggregated) frame as a
    scalar subquery. Unlike ``agg().over(Window.partitionBy())`` it never
    moves the frame into one task: the subquery reuses the frame's shuffle
    and combines one partial row per partition."""
    return df.agg(agg).scalar()


def frame_max(df: DataFrame, col: str) -> Column:
    return frame_stat(df, F.max(F.col(col)))


def frame_min(df: DataFrame, col: str) -> Column:
    return frame_stat(df, F.min(F.col(col)))


def frame_sum(df: DataFrame, col: str) -> Column:
    return frame_stat(df, F.sum(F.col(col)))
