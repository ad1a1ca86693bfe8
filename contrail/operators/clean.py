"""Projection and cleaning.

Column-level decisions (which columns are sparse or constant) take one
aggregate pass over the data; everything else is a per-row built-in
expression inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contrail.functions.scalars import (fractional_value, hhmm_to_minutes, to_bool,
                                        to_nullable_int)
from contrail.operators.quantiles import exact_quantiles
from contrail.session import stored


def strip_column_names(df: DataFrame) -> DataFrame:
    """``"Operating_Airline "`` -> ``"Operating_Airline"``."""
    return df.toDF(*[c.strip() for c in df.columns])


def lower_column_names(df: DataFrame) -> DataFrame:
    """P4."""
    return df.toDF(*[c.lower() for c in df.columns])


def keep_columns(df: DataFrame, wanted: list[str]) -> DataFrame:
    """Keep a list of columns matched case-insensitively (after
    stripping blanks), renamed to the wanted spelling; absent ones skipped."""
    by_lower = {c.strip().lower(): c for c in df.columns}
    return df.select(*[F.col(f"`{by_lower[w.lower()]}`").alias(w)
                       for w in wanted if w.lower() in by_lower])


def column_profile(df: DataFrame) -> dict:
    """One aggregate pass: rows, and per column NULL count and min/max as text."""
    aggs = []
    for i, c in enumerate(df.columns):
        col = F.col(f"`{c}`").cast("string")
        aggs += [F.count_if(col.isNull()).alias(f"z{i}"), F.min(col).alias(f"a{i}"),
                 F.max(col).alias(f"b{i}")]
    row = df.agg(F.count(F.lit(1)).alias("_rows"), *aggs).first()
    return {"rows": row["_rows"],
            "cols": {c: (row[f"z{i}"], row[f"a{i}"], row[f"b{i}"]) for i, c in enumerate(df.columns)}}


def sparse_columns(df: DataFrame, max_nulls: int | float, profile: dict | None = None) -> list[str]:
    """P1 decision: columns with at least ``max_nulls`` NULLs (absolute count,
    or a fraction of the rows when < 1)."""
    prof = profile or column_profile(df)
    n = prof["rows"]
    limit = max_nulls * n if max_nulls < 1 else max_nulls
    return [c for c, (z, _, _) in prof["cols"].items() if n > 0 and z >= limit]


def drop_sparse_columns(df: DataFrame, max_nulls: int | float) -> DataFrame:
    """Drop columns with >= max_nulls NULLs."""
    return df.drop(*sparse_columns(df, max_nulls))


def constant_columns(df: DataFrame, profile: dict | None = None) -> list[str]:
    """P11 decision: columns holding one distinct value and no NULL (``min ==
    max`` from the profiling pass instead of an exact distinct count)."""
    prof = profile or column_profile(df)
    return [c for c, (z, a, b) in prof["cols"].items() if a is not None and a == b and z == 0]


def drop_constant_columns(df: DataFrame) -> DataFrame:
    """P11."""
    return df.drop(*constant_columns(df))


def drop_sparse_and_constant(df: DataFrame, max_nulls: int | float) -> DataFrame:
    """P1 + P11 decided from a single profiling pass."""
    prof = column_profile(df)
    drop = set(sparse_columns(df, max_nulls, prof)) | set(constant_columns(df, prof))
    return df.drop(*[c for c in df.columns if c in drop])


def parse_clock_columns(df: DataFrame, cols: list[str]) -> DataFrame:
    """Hhmm clocks -> minutes of day (bad, 2400, >4 digits -> NULL)."""
    return df.withColumns({c: hhmm_to_minutes(c) for c in cols if c in df.columns})


def to_int_columns(df: DataFrame, cols: list[str]) -> DataFrame:
    """Nullable integers ('12.0' -> 12; fractions -> NULL, see report)."""
    return df.withColumns({c: to_nullable_int(c) for c in cols if c in df.columns})


def fractional_report(df: DataFrame, cols: list[str]) -> DataFrame:
    """P7 companion: how many values per column would lose a fraction."""
    present = [c for c in cols if c in df.columns]
    return df.agg(*[F.count_if(fractional_value(c)).alias(c) for c in present])


def to_bool_columns(df: DataFrame, cols: list[str], default: bool = False) -> DataFrame:
    """Flags -> boolean, missing -> ``default``."""
    return df.withColumns({c: to_bool(c, default) for c in cols if c in df.columns})


def to_double_columns(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("string").try_cast("double")
                           for c in cols if c in df.columns})


def parse_dates(df: DataFrame, cols: list[str], fmt: str | None = None) -> DataFrame:
    """Text -> date, bad -> NULL."""
    conv = (lambda c: F.try_to_date(F.col(c).cast("string"), F.lit(fmt))) if fmt else \
        (lambda c: F.try_to_date(F.col(c).cast("string")))
    return df.withColumns({c: conv(c) for c in cols if c in df.columns})


def trim_strings(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """P10: trim string columns (all string columns by default)."""
    if cols is None:
        cols = [f.name for f in df.schema.fields if f.dataType.simpleString() == "string"]
    return df.withColumns({c: F.trim(F.col(c)) for c in cols if c in df.columns})


def drop_incomplete(df: DataFrame, subset: list[str] | None = None) -> DataFrame:
    """Drop rows with a NULL in ``subset`` (any column when omitted)."""
    return df.dropna(subset=subset) if subset else df.dropna()


def fill_mean(df: DataFrame, cols: list[str]) -> DataFrame:
    """NULL -> global mean of the column (one scalar subquery with all
    means: one pass, no join, no single-partition window)."""
    means = df.agg(F.struct(*[F.avg(c).alias(c) for c in cols])).scalar()
    return df.withColumns({c: F.coalesce(F.col(c), means.getField(c)) for c in cols})


def exact_medians(train: DataFrame, cols: list[str], written: bool = False) -> dict[str, float | None]:
    """Exact medians of ``cols``, by histogram narrowing over just these
    columns, stored first unless ``train`` is ``written`` (a selection of rows
    of a file, which each round may read again)."""
    values = train.select(*[F.col(c).cast("double").alias(c) for c in cols])
    return exact_quantiles(values if written else stored(values, "medians"), cols, 0.5)


def fill_median(train: DataFrame, target: DataFrame, cols: list[str]) -> DataFrame:
    """NULL -> exact median learned on ``train``; a column without values
    stays as it is."""
    medians = exact_medians(train, cols)
    return target.withColumns({c: F.coalesce(F.col(c), F.lit(m)) for c, m in medians.items()
                               if m is not None})


def rename_columns(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Rename present columns."""
    return df.withColumnsRenamed({k: v for k, v in mapping.items() if k in df.columns})


def split_date(df: DataFrame, col: str, prefix: str = "") -> DataFrame:
    """Year / month / day of an ISO date."""
    d = F.try_to_date(F.col(col).cast("string"))
    return df.withColumns({f"{prefix}year": F.year(d), f"{prefix}month": F.month(d),
                           f"{prefix}day": F.dayofmonth(d)})


def missing_features(df: DataFrame, features: list[str]) -> list[str]:
    """P25: features absent from the frame (schema only, no job)."""
    have = set(df.columns)
    return [f for f in features if f not in have]


def require_features(df: DataFrame, features: list[str]) -> DataFrame:
    """P25: raise with the list of missing features."""
    miss = missing_features(df, features)
    if miss:
        raise ValueError(f"Missing features: {miss}")
    return df


def audit(df: DataFrame) -> DataFrame:
    """One row - rows, columns, and NULL count per column."""
    return df.agg(F.count(F.lit(1)).alias("rows"), F.lit(len(df.columns)).alias("columns"),
                  *[F.count_if(F.col(f"`{c}`").isNull()).alias(f"null_{c}") for c in df.columns])
