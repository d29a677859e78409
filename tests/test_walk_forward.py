import os

from panelwright.plans import catalog, q_models, registry

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_every_test_month_is_scored(spark):
    months = sorted({r.test_month for r in catalog.queries()["ml1_folds"](spark, FOLDER).collect()})
    got = catalog.queries()["ml4_walk_forward_scores"](spark, FOLDER).select("month").distinct().collect()
    assert len(months) > 2 and sorted(r.month for r in got) == months


def test_rows_of_folds_are_few_partitions(spark):
    """Each of a fold's many jobs has a task for each partition, and each task answers the driver."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "50")
    try:
        assert q_models._boosted(registry.Tables(spark, FOLDER)).rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
