"""Feature preparation for the delay models.

Spark ML stages are fitted with distributed passes (StringIndexer counts,
StandardScaler moments); the driver only holds the fitted parameters.
"""

from __future__ import annotations

from pyspark.ml.feature import (Imputer, OneHotEncoder, SQLTransformer, StandardScaler,
                                StringIndexer, VectorAssembler)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contrail.functions.constants import LEAKAGE_COLUMNS, WEATHER_MEASURES

NUMERIC_FEATURES = ["distance", "distancegroup"] + \
    [f"{m}_o" for m in WEATHER_MEASURES] + [f"{m}_d" for m in WEATHER_MEASURES]
CATEGORICAL_FEATURES = ["diverted", "origin", "dest"]
MODEL_FEATURES = NUMERIC_FEATURES + CATEGORICAL_FEATURES
ROUTE_FEATURES = ["operating_airline", "origin", "dest"]
LABEL = "label"


def leakage_safe(df: DataFrame, label_from: str = "depdel15") -> DataFrame:
    """M1 + M6: keep pre-departure information only.

    Drops cancelled flights, derives the 0/1 label from ``label_from`` (then
    drops it), removes identifiers, schedule and post-departure columns,
    turns booleans into 0/1 and drops rows with missing values.
    """
    out = df
    if "cancelled" in out.columns:
        out = out.where(~F.coalesce(F.col("cancelled"), F.lit(False))).drop("cancelled")
    out = out.withColumn(LABEL, F.col(label_from).cast("int"))
    out = out.drop(label_from, *[c for c in LEAKAGE_COLUMNS if c in out.columns])
    out = bools_to_int(out)
    return out.dropna()


def bools_to_int(df: DataFrame) -> DataFrame:
    """M6: every boolean column -> 0/1 int."""
    return df.withColumns({f.name: F.col(f.name).cast("int") for f in df.schema.fields
                           if f.dataType.simpleString() == "boolean"})


# Split hash: multiplicative hashing modulo a prime. It is plain integer
# arithmetic, so any engine (the DuckDB oracle included) computes the same
# split, and it does not depend on partitioning or cluster size.
SPLIT_PRIME = 1000003
SPLIT_MULT = 48271


def split_key(key: str = "flight_id", seed: int = 7):
    """A repeatable pseudo-random number in [0, 1) from an integer key (M2)."""
    h = F.pmod(F.pmod(F.col(key), F.lit(SPLIT_PRIME)) * SPLIT_MULT + seed, F.lit(SPLIT_PRIME))
    return h / float(SPLIT_PRIME)


def split_key_sql(key: str = "flight_id", seed: int = 7) -> str:
    """The same number as SQL text (non-negative keys)."""
    return f"((({key} % {SPLIT_PRIME}) * {SPLIT_MULT} + {seed}) % {SPLIT_PRIME}) / {float(SPLIT_PRIME)}"


def hash_split(df: DataFrame, test_fraction: float = 0.2, key: str = "flight_id",
               seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """M2: train/test split that is the same on every run and cluster size
    (``randomSplit`` depends on partitioning)."""
    u = split_key(key, seed)
    return df.where(u >= test_fraction), df.where(u < test_fraction)


def label_encoders(cols: list[str]) -> list[StringIndexer]:
    """M5: alphabetical label encoding; unseen values get their own index at
    scoring time instead of colliding with class 0."""
    return [StringIndexer(inputCols=list(cols), outputCols=[f"{c}_idx" for c in cols],
                          stringOrderType="alphabetAsc", handleInvalid="keep")]


def varied(df: DataFrame, cols: list[str]) -> list[str]:
    """The columns of ``cols`` with two values or more: with its first level
    dropped, a column of one value has no slot left to encode."""
    got = df.agg(*[(F.min(c) < F.max(c)).alias(c) for c in cols]).first()
    return [c for c in cols if got[c]]


def one_hot(cols: list[str], drop_first: bool = False) -> list:
    """M4: one-hot of categoricals.

    ``drop_first=False``: every level, unseen values in an extra slot.
    ``drop_first=True``: the alphabetically first level is the reference
    level (indexing in descending order makes it the last index, which
    ``dropLast`` removes); unseen values are an error, as in the model this
    mirrors. It needs columns of two levels or more (``varied``).
    """
    if not cols:
        return []
    if drop_first:
        idx = StringIndexer(inputCols=list(cols), outputCols=[f"{c}_idx" for c in cols],
                            stringOrderType="alphabetDesc", handleInvalid="error")
        enc = OneHotEncoder(inputCols=[f"{c}_idx" for c in cols],
                            outputCols=[f"{c}_oh" for c in cols], dropLast=True)
        return [idx, enc]
    stages = label_encoders(cols)
    stages.append(OneHotEncoder(inputCols=[f"{c}_idx" for c in cols],
                                outputCols=[f"{c}_oh" for c in cols], dropLast=False,
                                handleInvalid="keep"))
    return stages


def scaled_numeric(cols: list[str], out: str = "num_scaled",
                   medians: dict[str, float] | None = None) -> list:
    """P16 + M3: median-impute (learned on the training rows), assemble and
    standardise numerics (mean 0, unit sample std).

    ``medians`` are the training rows' exact medians (``clean.exact_medians``);
    without them the estimator's approximate ones are learned in the fit."""
    imp = [f"{c}_imp" for c in cols]
    if medians is None:
        fill = Imputer(inputCols=cols, outputCols=imp, strategy="median", relativeError=0.0001)
    else:
        filled = ", ".join(f"COALESCE(NANVL(`{c}`, NULL), {float(medians[c])!r}D) AS `{i}`"
                           if medians[c] is not None else f"`{c}` AS `{i}`" for c, i in zip(cols, imp))
        fill = SQLTransformer(statement=f"SELECT *, {filled} FROM __THIS__")
    return [fill,
            VectorAssembler(inputCols=imp, outputCol="num_raw", handleInvalid="keep"),
            StandardScaler(inputCol="num_raw", outputCol=out, withMean=True, withStd=True)]


def weather_feature_stages(drop_first: bool = True, categoricals: list[str] | None = None,
                           medians: dict[str, float] | None = None) -> list:
    """The weather model's features: 20 imputed, scaled numerics and one-hot
    diverted / origin / dest (``categoricals``)."""
    categoricals = CATEGORICAL_FEATURES if categoricals is None else categoricals
    return (scaled_numeric(NUMERIC_FEATURES, medians=medians)
            + one_hot(categoricals, drop_first)
            + [VectorAssembler(inputCols=["num_scaled"] + [f"{c}_oh" for c in categoricals],
                               outputCol="features")])


def route_feature_stages() -> list:
    """The route model's features: label-encoded carrier/origin/dest + distance."""
    return label_encoders(ROUTE_FEATURES) + [
        VectorAssembler(inputCols=[f"{c}_idx" for c in ROUTE_FEATURES] + ["distance"],
                        outputCol="features", handleInvalid="keep")]


def _positioned(part: DataFrame) -> DataFrame:
    """``part`` with ``_pos``: a dense 0..n-1 index over all its rows.

    ``part`` must be checkpointed, so partition ids and row order are the same
    in every job that reads it. The index is the row's place inside its
    partition plus the sizes of the partitions before it; only one count per
    partition reaches the driver (bounded by the partition count, not the data).
    """
    spark = part.sparkSession
    pid = F.spark_partition_id()
    tagged = part.withColumn("_pid", pid).withColumn("_mid", F.monotonically_increasing_id())
    sizes = sorted((r["_pid"], r["n"]) for r in
                   tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("n")).collect())
    offsets, run = [], 0
    for p, n in sizes:
        offsets.append((p, run))
        run += n
    off = spark.createDataFrame(offsets, "_pid int, _off long")
    # one row per partition: a proven size bound, so broadcast it
    return (tagged.join(F.broadcast(off), "_pid")
                  .withColumn("_pos", F.col("_off") + F.col("_mid")
                              - F.shiftleft(F.col("_pid").cast("long"), 33))
                  .drop("_pid", "_mid", "_off"))


def oversample(df: DataFrame, label: str = LABEL, seed: int = 42) -> DataFrame:
    """M7: random oversampling as ``RandomOverSampler()`` does it: every class
    is brought to exactly the majority's size; the original rows are kept and
    the extra rows are drawn from their own class with replacement, each draw
    independent and uniform.

    A class of ``n`` rows needing ``k`` extra copies gets them from ``k``
    counter-based draws: draw ``i`` takes the row whose place is a hash of
    (seed, class, i) modulo ``n``. Places follow a hash of the row's content, so
    the draw is the same however the rows are partitioned. The class is range
    partitioned by that hash and checkpointed (reliably), so the dense row index
    is stable across jobs; a small class is broadcast by AQE after it measures
    it, a large one is sort-merge joined. No step gathers a class or a rank into
    one task.
    """
    from contrail.session import checkpoint_root

    counts = {r[label]: r["n"] for r in df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(counts) < 2:
        return df
    majority = max(counts.values())
    spark = df.sparkSession
    checkpoint_root(spark)
    out = df
    for cls in sorted(counts, key=lambda c: (c is None, c)):
        n, extra = counts[cls], majority - counts[cls]
        if extra == 0:
            continue
        cond = F.col(label).isNull() if cls is None else F.col(label) == F.lit(cls)
        # two hashes that see NULLs: equal rows may swap places, others practically never
        content = [F.xxhash64(F.lit(side), *[x for c in df.columns for x in
                                             (F.col(f"`{c}`"), F.col(f"`{c}`").isNull())])
                   for side in (0, 1)]
        ordered = (df.where(cond).withColumns({"_h0": content[0], "_h1": content[1]})
                   .repartitionByRange("_h0", "_h1").sortWithinPartitions("_h0", "_h1")
                   .drop("_h0", "_h1"))
        rows = _positioned(ordered.checkpoint(eager=True))
        draws = spark.range(extra).select(
            F.pmod(F.xxhash64(F.lit(seed), F.lit(str(cls)), "id"), F.lit(n)).alias("_pos"))
        out = out.unionByName(draws.join(rows, "_pos").drop("_pos"))
    return out


def class_weights(df: DataFrame, label: str = LABEL, out: str = "weight") -> DataFrame:
    """M7 alternative: exact balancing by weights n / (k * n_class), for
    ``weightCol`` (no duplicated rows)."""
    n_class = df.groupBy(label).agg(F.count(F.lit(1)).alias("_nc"))
    total = df.agg(F.count(F.lit(1))).scalar()
    k = df.agg(F.countDistinct(label)).scalar()
    return (df.join(F.broadcast(n_class), label)  # one row per class
              .withColumn(out, total / (k * F.col("_nc"))).drop("_nc"))


def explode_request(request: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A prediction request (flights[], weather[] per row) -> two tables;
    request ids are kept so many requests are served in one job."""
    rid = "request_id"
    fl = request.select(rid, F.inline("flights"))
    wx = request.select(rid, F.inline("weather")).fillna(0.0, subset=["snow_mm"])
    return fl, wx
