"""What is shuffled, and how heavy rows are spread."""

from tessera.plans import queries

DATA = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_ingested_prints_shuffle_the_number_of_features_alone(spark):
    told = next(line for line in plan(queries.QUERIES["print_ingest"](spark, DATA)).splitlines() if "max_by" in line)
    assert "n_features" in told and "features, features" not in told


def test_heavy_rows_are_dealt_over_all_tasks(spark):
    """A small file is one read task, however much work its rows are."""
    for name in ("europeana_objects", "description_reconciled"):
        assert queries.QUERIES[name](spark, DATA).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
