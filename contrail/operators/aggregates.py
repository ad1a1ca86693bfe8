"""Grouped statistics over flights.

All of them are one hash aggregation (partial + final) on low-cardinality
keys - carrier, airport, route, calendar - so the shuffle moves one row per
key per task however skewed the keys are. Rounded means use the exact
half-up form (``avg_half_up``) on decimal sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contrail.functions import constants as K
from contrail.functions.scalars import (avg_half_up, clip, day_name, exact_sum, flag_to_int,
                                        mean_half_up, month_abbr, pg_day_of_week, ratio_half_up,
                                        route_label)
from contrail.operators.filters import not_cancelled_strict
from contrail.operators.windows import frame_max, frame_min, frame_sum
from contrail.session import checkpoint_root, stored


# Most columns a matrix takes from the data (one per destination airport).
MAX_PIVOT = 10_000


def _delayed_sum(col: str = "depdel15"):
    return F.sum(F.when(F.col(col) == F.lit(True), 1).otherwise(0))


def carrier_names(spark: SparkSession) -> DataFrame:
    """The fixed 21-row code -> name dictionary as a DataFrame."""
    return spark.createDataFrame(sorted(K.CARRIER_NAMES.items()), "code string, name string")


def with_carrier_name(df: DataFrame, spark: SparkSession, col: str = "operating_airline",
                      out: str = "airline_name") -> DataFrame:
    """Code -> carrier name, unknown codes kept. The dictionary has a
    fixed 21 rows, so it is broadcast."""
    names = F.broadcast(carrier_names(spark))
    return (df.join(names, F.col(col) == F.col("code"), "left")
              .withColumn(out, F.coalesce(F.col("name"), F.col(col)))
              .drop("code", "name"))


def dashboard_frame(flights: DataFrame) -> DataFrame:
    """The analysis frame behind every chart (P17, P18, P20, P21 on F1).

    All (not only a sample of) strictly uncancelled flights; delayed flag to
    0/1, causes NULL -> 0, calendar month and day name.
    """
    f = not_cancelled_strict(flights)
    return f.select(
        *[c for c in ("flight_month",) if c in f.columns],  # lets month filters prune
        "flight_id", "flightdate", "operating_airline", "origin",
        F.col("origincityname").alias("origin_city"), "dest",
        F.col("destcityname").alias("dest_city"), "distance", "depdelay",
        flag_to_int("depdel15").alias("delayed"),
        *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in K.DELAY_CAUSES],
        F.month("flightdate").alias("month"),
        day_name("flightdate").alias("day_of_week"),
    )


# ---------------------------------------------------------------- API stats
def general_stats(df: DataFrame) -> DataFrame:
    """A5: count, delay rate %, mean delay; NULL -> 0 (input: F1-filtered flights)."""
    n = F.count(F.lit(1))
    return df.agg(
        n.alias("total_flights"),
        F.coalesce(F.try_divide(_delayed_sum().cast("double"), n) * 100, F.lit(0.0)).alias("delay_rate"),
        F.coalesce(F.avg("depdelay"), F.lit(0.0)).alias("avg_delay_minutes"))


def stats_by_day_of_week(df: DataFrame) -> DataFrame:
    """Flights and delay rate by day of week, Sunday = 0."""
    n = F.count(F.lit(1))
    return (df.groupBy(pg_day_of_week("flightdate").alias("day_of_week"))
              .agg(n.alias("flights"),
                   (F.try_divide(_delayed_sum().cast("double"), n) * 100).alias("delay_rate"))
              .orderBy("day_of_week"))


# ------------------------------------------------------------ chart frames
def monthly_trend(dash: DataFrame) -> DataFrame:
    """Mean delay (r1) and delayed count per month, with month name."""
    return (dash.groupBy("month")
                .agg(avg_half_up("depdelay", 1).alias("avg_delay"),
                     F.sum("delayed").cast("long").alias("delayed_count"))
                .withColumn("month_name", month_abbr("month")))


def carrier_delay_rate(dash: DataFrame) -> DataFrame:
    """Delay rate % (r1) and flights per carrier, plus the min-max score."""
    g = dash.dropna(subset=["operating_airline"]).groupBy("operating_airline").agg(
        ratio_half_up(F.sum("delayed") * 100, F.count("delayed"), 1).alias("pct"),
        F.count("delayed").alias("total"))
    lo, hi = frame_min(g, "pct"), frame_max(g, "pct")
    return g.withColumn("score", (F.col("pct") - lo) / (hi - lo + F.lit(0.01)))


def delay_causes_by_carrier(dash: DataFrame, long: bool = True) -> DataFrame:
    """Mean of the five delay causes per carrier (r1); long form for stacking."""
    wide = dash.dropna(subset=["operating_airline"]).groupBy("operating_airline").agg(
        *[avg_half_up(c, 1).alias(c) for c in K.DELAY_CAUSES])
    if not long:
        return wide
    return wide.unpivot(["operating_airline"], K.DELAY_CAUSES, "cause", "avg_minutes")


def route_mean_delay(dash: DataFrame) -> DataFrame:
    """A10 long form: mean delay (r1) per (origin, dest) over non-null delays
    and keys."""
    return (dash.dropna(subset=["depdelay", "origin", "dest"])
                .groupBy("origin", "dest")
                .agg(avg_half_up("depdelay", 1).alias("avg_delay")))


def route_pivot(dash: DataFrame, fill: float | None = 0.0, dests: list[str] | None = None) -> DataFrame:
    """A10/A11 wide form: origin x dest matrix of mean delay.

    ``dests`` lists the pivot columns; when omitted they are taken from the
    data (one small distinct job - the number of airports, not of flights).
    """
    long = route_mean_delay(dash)
    if dests is None:
        # the destinations with a known delay, read from two pruned columns
        # (not by re-running the route aggregation)
        found = (dash.dropna(subset=["depdelay", "origin", "dest"]).select("dest").distinct()
                 .orderBy("dest").limit(MAX_PIVOT + 1).collect())
        if len(found) > MAX_PIVOT:
            raise ValueError(f"more than {MAX_PIVOT} destinations: name the columns in dests")
        dests = [r[0] for r in found]
    wide = long.groupBy("origin").pivot("dest", dests).agg(F.first("avg_delay"))
    return wide.fillna(fill) if fill is not None else wide


def top_airports(dash: DataFrame, n: int = 20) -> DataFrame:
    """The top-n origins and top-n dests by flights, unioned, ranked by
    combined count desc then code, first n kept (the reference left the set
    order undefined)."""
    def top(col):
        c = dash.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("iata")).agg(
            F.count(F.lit(1)).alias("n"))
        return c.orderBy(F.desc("n"), "iata").limit(n).select("iata")
    cand = top("origin").union(top("dest")).distinct()
    o = dash.groupBy(F.col("origin").alias("iata")).agg(F.count(F.lit(1)).alias("n_o"))
    d = dash.groupBy(F.col("dest").alias("iata")).agg(F.count(F.lit(1)).alias("n_d"))
    ranked = (cand.join(o, "iata", "left").join(d, "iata", "left")
                  .select("iata", (F.coalesce("n_o", F.lit(0)) + F.coalesce("n_d", F.lit(0)))
                          .alias("flights")))
    return ranked.orderBy(F.desc("flights"), "iata").limit(n)


def top_airport_routes_of(dash: DataFrame, n: int = 20) -> DataFrame:
    """Flights whose both ends are top-n airports (F11: two left-semi joins
    against the n-row set)."""
    top = F.broadcast(top_airports(dash, n).select("iata"))  # at most n rows
    return (dash.join(top, F.col("origin") == F.col("iata"), "left_semi")
                .join(top, F.col("dest") == F.col("iata"), "left_semi"))


def route_level_flag(gold: DataFrame, above: float = 15.0) -> DataFrame:
    """Route-level flag: 1 where the delay rate in per cent is above ``above``
    (the dashboard compares the rate with the number of minutes that make a
    flight late), 0 elsewhere, also where there is no rate."""
    return gold.select("operating_airline", "origin", "dest", "delay_rate_pct",
                       F.when(F.col("delay_rate_pct") > above, 1).otherwise(0).alias("delayed"))


def top_airport_routes(dash: DataFrame, n: int = 20) -> DataFrame:
    """A11 long form: mean delay (r1) for routes whose both ends are top-n
    airports."""
    return route_mean_delay(top_airport_routes_of(dash, n))


def top_airport_matrix(dash: DataFrame, n: int = 20, names: list[str] | None = None) -> DataFrame:
    """A11 wide form: origin x dest matrix over the top-n airports, pairs
    without flights as NULL. ``names`` fixes the columns: an airport that is not
    among the top n then has a column of NULLs and no row."""
    if names is not None:
        return route_pivot(top_airport_routes_of(dash, n), None, names)
    names = sorted(r.iata for r in top_airports(dash, n).select("iata").collect())  # n rows
    sub = dash.where(F.col("origin").isin(names) & F.col("dest").isin(names))
    return route_pivot(sub, None, names)


def day_of_week_delay(dash: DataFrame, spark: SparkSession) -> DataFrame:
    """Mean delay by day name in Monday..Sunday order; the maximum is
    flagged; days without flights are kept with NULL."""
    cal = spark.createDataFrame([(i + 1, d) for i, d in enumerate(K.WEEKDAY_ORDER)],
                                "day_index int, day_of_week string")
    g = (dash.groupBy("day_of_week")
             .agg(exact_sum("depdelay").alias("s"), F.count("depdelay").alias("c")))
    j = cal.join(g, "day_of_week", "left")  # seven rows on both sides
    means = j.select("day_index", "day_of_week",
                     mean_half_up(F.col("s"), F.col("c"), 1).alias("avg_delay"),
                     F.try_divide(F.col("s"), F.col("c")).alias("_m"))
    return (means.withColumn("is_max", F.coalesce(F.col("_m") == frame_max(means, "_m"),
                                                  F.lit(False)))
                 .drop("_m"))


def delay_histogram(dash: DataFrame, upper: int = 180, width: int = 5) -> DataFrame:
    """Positive delays clipped at ``upper`` in bins of ``width`` minutes
    (the clip value joins the last bin), with the mean of the clipped delays."""
    last = upper // width - 1
    pos = dash.where(F.col("depdelay") > 0).select(clip("depdelay", hi=float(upper)).alias("d"))
    g = pos.groupBy(F.least(F.floor(F.col("d") / width), F.lit(last)).cast("int").alias("bin")).agg(
        F.count(F.lit(1)).alias("flights"), exact_sum("d").alias("s"))
    return g.select((F.col("bin") * width).alias("bin_start"), "flights",
                    mean_half_up(frame_sum(g, "s"), frame_sum(g, "flights"), 2)
                    .alias("mean_delay"))


def kpis(dash: DataFrame) -> DataFrame:
    """The KPI row - flights, delayed, delay rate (r1), mean positive
    delay (r1), distinct carriers, distinct routes (non-null pairs)."""
    pos = F.when(F.col("depdelay") > 0, F.col("depdelay"))
    route = F.when(F.col("origin").isNotNull() & F.col("dest").isNotNull(),
                   F.struct("origin", "dest"))
    return dash.agg(
        F.count(F.lit(1)).alias("total_flights"),
        F.coalesce(F.sum("delayed"), F.lit(0)).cast("long").alias("delayed_flights"),
        ratio_half_up(F.sum("delayed") * 100, F.count(F.lit(1)), 1).alias("delay_rate"),
        avg_half_up(pos, 1).alias("avg_dep_delay"),
        F.countDistinct("operating_airline").alias("airlines"),
        F.countDistinct(route).alias("routes"))


def summary_from_gold(gold: DataFrame) -> DataFrame:
    """Summary rolled up from gold rows (no row cap): flight and delayed
    totals, overall delay rate (r1, 0 when empty), the *unweighted* mean of
    the route means with a missing mean counted as 0 (r1, as the dashboard
    computes it), the flight-weighted mean beside it (r2), distinct carriers
    and the number of gold rows."""
    cents = F.round(F.col("avg_dep_delay") * 100).cast("long")
    total = F.sum("total_flights")
    delayed = F.sum("delayed_count")
    return gold.agg(
        F.coalesce(total, F.lit(0)).cast("long").alias("total_flights"),
        F.coalesce(delayed, F.lit(0)).cast("long").alias("delayed_flights"),
        F.coalesce(ratio_half_up(delayed * 100, total, 1), F.lit(0.0)).alias("delay_rate"),
        F.coalesce(ratio_half_up(F.sum(F.coalesce(cents, F.lit(0))), F.count(F.lit(1)) * 100, 1),
                   F.lit(0.0)).alias("avg_dep_delay"),
        ratio_half_up(F.sum(cents * F.col("total_flights")),
                      F.sum(F.when(cents.isNotNull(), F.col("total_flights"))) * 100, 2)
        .alias("weighted_avg_delay"),
        F.countDistinct("operating_airline").alias("airlines"),
        F.count(F.lit(1)).alias("routes"))


def airport_stats(dash: DataFrame, coords: DataFrame, min_flights: int = 5) -> DataFrame:
    """Per-origin flights, mean delay, delayed, rate, coordinates (J3,
    airports without coordinates drop out) and relative marker size."""
    g = (dash.dropna(subset=["origin"]).groupBy("origin")
             .agg(F.count("depdelay").alias("total"),
                  avg_half_up("depdelay", 1).alias("avg_delay"),
                  F.sum("delayed").cast("long").alias("delayed"))
             .where(F.col("total") >= min_flights)
             .withColumn("delay_rate", ratio_half_up(F.col("delayed") * 100, F.col("total"), 1)))
    j = (g.join(coords.select(F.col("iata").alias("origin"), "lat", "lon"), "origin")
          .dropna(subset=["lat", "lon"]))
    return j.withColumn("marker_size",
                        F.col("total").cast("double") / frame_max(j, "total") * 40 + 6)


def route_bubble(dash: DataFrame, min_flights: int = 20, top: int = 30) -> DataFrame:
    """Busiest routes (>= min_flights) with mean delay, volume, rate; top by volume."""
    g = (dash.dropna(subset=["origin", "dest"]).groupBy("origin", "dest")
             .agg(avg_half_up("depdelay", 1).alias("avg_delay"),
                  F.count("depdelay").alias("total"),
                  F.sum("delayed").cast("long").alias("delayed"))
             .where(F.col("total") >= min_flights)
             .withColumn("delay_rate", ratio_half_up(F.col("delayed") * 100, F.col("total"), 1))
             .withColumn("route", route_label()))
    return g.orderBy(F.desc("total"), "origin", "dest").limit(top)


def top_delayed_routes(dash: DataFrame, min_flights: int = 5, top: int = 10) -> DataFrame:
    """The ``top`` routes by mean delay among routes with >= min_flights delays."""
    g = (dash.dropna(subset=["origin", "dest"]).groupBy("origin", "dest")
             .agg(exact_sum("depdelay").alias("s"), F.count("depdelay").alias("total"))
             .where(F.col("total") >= min_flights))
    return (g.orderBy(F.desc(F.col("s") / F.col("total")), "origin", "dest").limit(top)
             .select("origin", "dest", route_label().alias("route"), "total",
                     mean_half_up(F.col("s"), F.col("total"), 1).alias("avg_delay")))


def trip_rates(dash: DataFrame, trips: DataFrame) -> DataFrame:
    """For each requested trip (carrier, origin, dest, day name) the
    delay rate (r1) of its route, weekday and carrier, and the route's mean
    delay (r1) and mean distance.

    Flights are aggregated once, to (carrier, origin, dest, weekday); that
    small result is checkpointed (the planner would prune it differently for
    each use and scan the flights again) and the three tables are rolled up
    from it.
    """
    cube = dash.groupBy("operating_airline", "origin", "dest", "day_of_week").agg(
        F.sum("delayed").alias("_late"), F.count("delayed").alias("_n"),
        exact_sum("depdelay").alias("_delay"), F.count("depdelay").alias("_delays"),
        F.sum("distance").alias("_dist"), F.count("distance").alias("_dists"))
    checkpoint_root(dash.sparkSession)
    cube = cube.checkpoint(eager=True)

    def rate():
        return ratio_half_up(F.sum("_late") * 100, F.sum("_n"), 1)

    route = cube.groupBy("origin", "dest").agg(
        rate().alias("route_rate"),
        mean_half_up(F.sum("_delay"), F.sum("_delays"), 1).alias("route_avg_delay"),
        F.try_divide(F.sum("_dist"), F.sum("_dists")).alias("route_avg_distance"))
    return (trips.join(route, ["origin", "dest"], "left")
                 .join(cube.groupBy("day_of_week").agg(rate().alias("day_rate")), "day_of_week", "left")
                 .join(cube.groupBy("operating_airline").agg(rate().alias("carrier_rate")),
                       "operating_airline", "left"))


# ------------------------------------------------------------ data quality
def null_counts(df: DataFrame, prefix: str = "null_") -> DataFrame:
    """One pass, one row: NULL count per column."""
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(prefix + c) for c in df.columns])


def row_digest(df: DataFrame, bits: int = 64) -> list[Column]:
    """Two 64-bit digests of a row (``bits`` of them are kept: fewer force
    collisions in tests). NULL differs from every value, equal doubles (0.0 and
    -0.0) are equal."""
    parts = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        parts += [c + 0 if f.dataType.simpleString() in ("float", "double") else c, c.isNull()]
    return [F.shiftrightunsigned(F.xxhash64(F.lit(side), *parts), 64 - bits) for side in (0, 1)]


def duplicate_count(df: DataFrame, bits: int = 64) -> DataFrame:
    """Rows, distinct rows, duplicates. Rows are grouped by a 128-bit
    digest first, so the shuffle carries 16 bytes a row; only rows whose digest
    occurs more than once meet in full, to tell copies from collisions. These
    digests are stored first: while they are few the rows are filtered by a
    broadcast, and a full row is shuffled only if its digest is among them."""
    d0, d1 = row_digest(df, bits)
    more = stored(df.select(d0.alias("_d0"), d1.alias("_d1")).groupBy("_d0", "_d1")
                  .agg(F.count(F.lit(1)).alias("_n")).where("_n > 1"), "duplicate-digests")
    shared = df.withColumns({"_d0": d0, "_d1": d1}).join(
        more.select("_d0", "_d1"), ["_d0", "_d1"], "left_semi")
    full = shared.groupBy("_d0", "_d1", *[F.col(f"`{c}`") for c in df.columns]).agg(F.lit(1).alias("_one"))
    among = more.agg(F.coalesce(F.sum("_n"), F.lit(0)).cast("long")).scalar()
    return df.agg(F.count(F.lit(1)).alias("rows")).select(
        "rows", (F.col("rows") - among + full.agg(F.count(F.lit(1))).scalar()).alias("distinct_rows")).withColumn(
        "duplicate_rows", F.col("rows") - F.col("distinct_rows"))


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """Absolute and normalised counts of a column's non-null values."""
    g = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("count"))
    return g.withColumn("share", F.col("count") / frame_sum(g, "count"))
