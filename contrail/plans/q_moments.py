"""Models with a checkable answer: least squares (M9) and Newton steps (M8),
each with the same sums and elimination in SQL."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from contrail.ml import features as FT
from contrail.ml import models as M
from contrail.ml import moments as MM
from contrail.plans.oracle import with_base
from contrail.plans.q_ml import _materialised
from contrail.plans.registry import register
from contrail.session import checkpoint_root
from contrail.sources.tables import flights

NEWTON_STEPS = 8
_X = ["operating_airline_idx", "origin_idx", "dest_idx", "distance"]


def _encoded_split(spark, sf, positive: bool):
    """Train and test rows of the route models with label-encoded features;
    the encoders know the training rows only."""
    data = _materialised(spark, sf, "train_route", M.route_training_frame(flights(spark, sf)))
    if positive:
        data = data.where(F.col("depdelay") > 0)
    train, test = FT.hash_split(data, 0.2)
    coder = Pipeline(stages=FT.label_encoders(FT.ROUTE_FEATURES)).fit(train)
    keep = ["flight_id", "depdelay", FT.LABEL, *_X]
    checkpoint_root(spark)
    return (coder.transform(train).select(*keep).checkpoint(eager=True),
            coder.transform(test).select(*keep))


def _encoded_sql(where: str) -> str:
    """CTE x: encoded rows, and whether they train."""
    codes = ",\n".join(
        f"k{i} AS (SELECT {c} AS v, CAST(ROW_NUMBER() OVER (ORDER BY {c}) - 1 AS DOUBLE) AS i "
        f"FROM (SELECT DISTINCT {c} FROM d WHERE trains))" for i, c in enumerate(FT.ROUTE_FEATURES))
    joins = " ".join(f"LEFT JOIN k{i} ON k{i}.v = d.{c}" for i, c in enumerate(FT.ROUTE_FEATURES))
    picked = ", ".join(f"COALESCE(k{i}.i, (SELECT COUNT(*) FROM k{i})) AS x{i}"
                       for i in range(len(FT.ROUTE_FEATURES)))
    return f"""
d AS (SELECT flight_id, depdelay, operating_airline, origin, dest, distance,
  CAST(COALESCE(depdel15, FALSE) AS INT) AS label, {FT.split_key_sql()} >= 0.2 AS trains
  FROM flights WHERE cancelled = FALSE AND depdelay IS NOT NULL{where}),
{codes},
x AS MATERIALIZED (SELECT flight_id, depdelay, label, trains, {picked}, distance AS x3 FROM d {joins})"""


def _elimination_sql(tag: str, source: str, size: int) -> str:
    """CTEs that solve the symmetric system a{i}_{j} (right side: j = size) of
    the one-row table ``source``; the last, ``{tag}``, has b0, b1, ..."""
    parts, last = [], source
    for k in range(size):
        cells = [f"a{i}_{j} - a{i}_{k} * a{k}_{j} / a{k}_{k} AS a{i}_{j}" if i > k else f"a{i}_{j}"
                 for i in range(size) for j in range(size + 1)]
        parts.append(f"{tag}_e{k} AS MATERIALIZED (SELECT {', '.join(cells)} FROM {last})")
        last = f"{tag}_e{k}"
    for k in reversed(range(size)):
        known = "".join(f" - a{k}_{j} * b{j}" for j in range(k + 1, size))
        name = tag if k == 0 else f"{tag}_b{k}"
        parts.append(f"{name} AS MATERIALIZED (SELECT *, (a{k}_{size}{known}) / a{k}_{k} AS b{k} FROM {last})")
        last = name
    return ",\n".join(parts)


def _step_sums(size: int) -> str:
    steps = ", ".join([f"CAST(ROUND(x{i} * 1000000) AS HUGEINT) AS x{i}" for i in range(4)]
                      + ["CAST(ROUND(depdelay * 1000000) AS HUGEINT) AS x4"])
    sums = ", ".join([f"SUM(x{i})::HUGEINT AS s{i}" for i in range(size)]
                     + [f"SUM(x{i} * x{j})::HUGEINT AS s{i}_{j}" for i in range(size) for j in range(i + 1)])
    return f"m AS MATERIALIZED (SELECT COUNT(*)::HUGEINT AS n, {sums} FROM (SELECT {steps} FROM x WHERE trains))"


def _covariance(i: int, j: int) -> str:
    return f"CAST(n * s{max(i, j)}_{min(i, j)} - s{i} * s{j} AS DOUBLE)"


_LEAST_SQUARES = _encoded_sql(" AND depdelay > 0").strip() + f""",
{_step_sums(5)},
sys AS (SELECT {', '.join(f'{_covariance(i, j)} AS a{i}_{j}' for i in range(4) for j in range(5))} FROM m),
{_elimination_sql('sol', 'sys', 4)},
fit AS (SELECT b0, b1, b2, b3,
  (s4::DOUBLE - b0 * s0::DOUBLE - b1 * s1::DOUBLE - b2 * s2::DOUBLE - b3 * s3::DOUBLE) / n::DOUBLE / 1000000 AS c
  FROM sol, m)"""

_TERMS = "".join(f" UNION ALL SELECT '{c}', ROUND(b{i}, 6) FROM fit" for i, c in enumerate(_X))


@register("m9_closed_form_coefficients", with_base(
    f"SELECT 'intercept' AS term, ROUND(c, 6) AS coefficient FROM fit{_TERMS}", extra=_LEAST_SQUARES))
def m9_coefficients(spark, sf):
    train, _ = _encoded_split(spark, sf, positive=True)
    return MM.least_squares(train, _X, "depdelay").rows(spark).select(
        "term", F.round("coefficient", 6).alias("coefficient"))


@register("m9_closed_form_predictions", with_base("""
SELECT flight_id, depdelay, ROUND(c + b0 * x0 + b1 * x1 + b2 * x2 + b3 * x3, 6) AS predicted_delay
FROM x, fit WHERE NOT trains""", extra=_LEAST_SQUARES))
def m9_predictions(spark, sf):
    train, test = _encoded_split(spark, sf, positive=True)
    score = MM.least_squares(train, _X, "depdelay").score()
    return test.select("flight_id", "depdelay", F.round(score, 6).alias("predicted_delay"))


def _newton_sql() -> str:
    z = ", ".join(f"(x{i} - s{i}::DOUBLE / 1000000 / n::DOUBLE) / sd{i} AS z{i + 1}" for i in range(4))
    sds = ", ".join(f"SQRT({_covariance(i, i)} / 1e12 / (n * n)::DOUBLE) AS sd{i}" for i in range(4))
    parts = [_encoded_sql("").strip(), _step_sums(5), f"sd AS MATERIALIZED (SELECT *, {sds} FROM m)",
             f"z AS MATERIALIZED (SELECT CAST(label AS DOUBLE) AS y, 1.0::DOUBLE AS z0, {z} FROM x, sd WHERE trains)",
             "t0 AS (SELECT 0.0::DOUBLE AS b0, 0.0::DOUBLE AS b1, 0.0::DOUBLE AS b2, 0.0::DOUBLE AS b3, 0.0::DOUBLE AS b4)"]
    sums = ", ".join([f"SUM(w * z{i} * z{j}) AS a{i}_{j}" for i in range(5) for j in range(5)]
                     + [f"SUM((y - p) * z{i}) AS a{i}_5" for i in range(5)])
    for k in range(NEWTON_STEPS):
        score = " + ".join(["b0"] + [f"b{i} * z{i}" for i in range(1, 5)])
        parts.append(f"h{k} AS MATERIALIZED (SELECT {sums} FROM (SELECT *, p * (1 - p) AS w FROM "
                     f"(SELECT z.*, 1.0 / (1.0 + EXP(-({score}))) AS p FROM z, t{k})))")
        parts.append(_elimination_sql(f"n{k}", f"h{k}", 5))
        parts.append(f"t{k + 1} AS MATERIALIZED (SELECT " + ", ".join(
            f"t{k}.b{i} + n{k}.b{i} AS b{i}" for i in range(5)) + f" FROM t{k}, n{k})")
    means = " ".join(f"- b{i + 1} / sd{i} * (s{i}::DOUBLE / 1000000 / n::DOUBLE)" for i in range(4))
    parts.append("fit AS (SELECT " + ", ".join(f"t.b{i + 1} / sd{i} AS b{i}" for i in range(4))
                 + f", t.b0 {means} AS c FROM t{NEWTON_STEPS} t, sd)")
    return ",\n".join(parts)


_NEWTON = _newton_sql()


@register("m8_newton_coefficients", with_base(
    f"SELECT 'intercept' AS term, ROUND(c, 6) AS coefficient FROM fit{_TERMS}", extra=_NEWTON))
def m8_coefficients(spark, sf):
    train, _ = _encoded_split(spark, sf, positive=False)
    return MM.newton_logistic(train, _X, FT.LABEL, NEWTON_STEPS).rows(spark).select(
        "term", F.round("coefficient", 6).alias("coefficient"))


@register("m8_newton_probabilities", with_base("""
SELECT flight_id, label, ROUND(1.0 / (1.0 + EXP(-(c + b0 * x0 + b1 * x1 + b2 * x2 + b3 * x3))), 6) AS delay_probability
FROM x, fit WHERE NOT trains""", extra=_NEWTON))
def m8_probabilities(spark, sf):
    train, test = _encoded_split(spark, sf, positive=False)
    score = MM.newton_logistic(train, _X, FT.LABEL, NEWTON_STEPS).score()
    return test.select("flight_id", FT.LABEL, F.round(MM.logistic(score), 6).alias("delay_probability"))
