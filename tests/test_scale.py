"""What the larger tables need: narrow shuffles, sides of known size, no work done twice."""
import os

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from contrail.functions.constants import WEATHER_MEASURES
from contrail.ml import features as FT
from contrail.ml import models as M
from contrail.operators import aggregates as AG
from contrail.operators import clean as C
from contrail.plans import q_checks, q_ml
from contrail.session import checkpoint_root
from contrail.sources import raw as R
from contrail.sources import tables as T
from tests.conftest import SF_SMALL


def _nodes(plan, name):
    found = [plan] if plan.nodeName() == name else []
    children = plan.children()
    return found + [n for i in range(children.size()) for n in _nodes(children.apply(i), name)]


def _joins(df):
    text = df._jdf.queryExecution().sparkPlan().toString()
    return text.count("BroadcastHashJoin"), text.count("SortMergeJoin")


def test_flights_are_shuffled_narrow(spark):
    plan = T.derive_flights(spark, SF_SMALL)._jdf.queryExecution().optimizedPlan()
    (node,) = _nodes(plan, "RebalancePartitions")
    assert node.output().size() <= 13
    names = {node.output().apply(i).name() for i in range(node.output().size())}
    assert not names & {"origin", "dest", "l_returnflag", "l_extendedprice"}


def test_raw_csv_is_landed_compressed(spark):
    path = R.land_raw_csv(spark, SF_SMALL)
    files = [f for f in os.listdir(path) if f.startswith("part-")]
    assert files and all(f.endswith(".csv.gz") for f in files)
    raw = R.read_raw_csv(spark, path)
    assert raw.count() == T.flights(spark, SF_SMALL).count()
    flags = {r[0] for r in raw.select("Cancelled").union(raw.select("DepDel15")).distinct().collect()}
    assert flags <= {"0.00", "1.00", None}


def test_cleaning_runs_compiled(spark):
    key = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(key, "65535")
    raw = spark.createDataFrame([tuple("1" for _ in R.RAW_COLUMNS)], R.RAW_SCHEMA)
    try:
        spark.conf.unset(key)
        R.clean_raw_flights(raw)
        assert spark.conf.get(key) == "8000"
        spark.conf.set(key, "20000")
        R.clean_raw_flights(raw)
        assert spark.conf.get(key) == "20000"  # the submitter's stays
    finally:
        spark.conf.set(key, before)


def test_duplicates_shuffle_no_row_of_its_own_digest(spark):
    df = spark.range(2000).select((F.col("id") % 1999).alias("a"), F.lit("x").alias("b")).repartition(4).checkpoint()
    got = AG.duplicate_count(df)
    assert _joins(got.select("*"))[1] == 0
    assert tuple(got.first()) == (2000, 1999, 1)
    assert tuple(AG.duplicate_count(df.limit(0)).first()) == (0, 0, 0)
    assert tuple(AG.duplicate_count(df, bits=2).first()) == (2000, 1999, 1)  # collisions of digests


def test_rates_and_levels_are_broadcast(spark):
    assert _joins(q_checks._rule_predictions(spark, SF_SMALL)) == (1, 0)
    train = spark.createDataFrame([(0, "A", "B", 1), (1, "B", "A", 2)], "diverted int, origin string, dest string, n int").checkpoint()
    test = spark.createDataFrame([(0, "A", "B", 1), (0, "C", "B", 2), (0, "A", None, 3)], train.schema).checkpoint()
    known = q_ml._of_known_levels(train, test)
    assert _joins(known) == (3, 0)
    assert [r.n for r in known.collect()] == [1]


def test_medians_of_a_written_frame_store_nothing(spark):
    folder = f"{checkpoint_root(spark)}/contrail-stored"
    df = spark.range(11).select(F.col("id").cast("double").alias("x")).checkpoint()
    before = len(os.listdir(folder)) if os.path.isdir(folder) else 0
    assert C.exact_medians(df, ["x"], written=True) == {"x": 5.0}
    assert (len(os.listdir(folder)) if os.path.isdir(folder) else 0) == before
    assert C.exact_medians(df, ["x"]) == {"x": 5.0}
    assert len(os.listdir(folder)) == before + 1


class _Model:
    def transform(self, df):
        return df.withColumn("probability", array_to_vector(F.array(F.lit(0.25), F.lit(0.75))))


def test_requests_are_computed_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b
    day = [(c, "2024-01-01", *[1.0] * len(WEATHER_MEASURES)) for c in ("X", "Y")]
    measures = ", ".join(f"{m}: double" for m in WEATHER_MEASURES)
    requests = spark.createDataFrame(
        [(i, [("2024-01-01", "X", "X", "Y", "Y", 100.0, 1, 0)], day) for i in range(6)],
        "request_id long, flights array<struct<flightdate: string, origin: string, origincityname: string, "
        "dest: string, destcityname: string, distance: double, distancegroup: int, diverted: int>>, "
        f"weather array<struct<location_name: string, weather_date: string, {measures}>>")
    out = M.predict_requests(_Model(), requests.mapInArrow(counted, requests.schema), FT.MODEL_FEATURES)
    assert [r.delay_probability for r in out.collect()] == [0.75] * 6
    assert seen.value == 6
