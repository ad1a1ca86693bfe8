"""A saved table leaves none of its job's shuffle files."""

from pyspark.sql import functions as F

from contrail.llm.shared import _END_CLEANUP, Scratch


def test_save_deletes_the_shuffle_files(spark):
    files = lambda: {f.getName() for f in spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava(
        spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles())
        if f.getName().startswith("shuffle_")}
    before, setting = files(), spark.conf.get(_END_CLEANUP, None)
    df = spark.range(10_000).groupBy((F.col("id") % 7).alias("k")).count()
    saved = Scratch(spark, "test").save(df, "counts")
    assert not files() - before
    assert spark.conf.get(_END_CLEANUP, None) == setting
    assert saved.count() == df.count() == 7
