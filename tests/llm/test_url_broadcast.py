"""What of the URL filter reaches the driver."""

from pyspark.sql import functions as F

from tessera.llm import url_filters


def test_scores_are_not_broadcast(spark):
    """Their files are small enough to be, but rows for each salt are many times as large in the driver."""
    df = spark.range(3000).select("id", F.format_string("https://a%d.example.%s/p%d", F.col("id") % 97, F.when(F.col("id") % 2 == 0, "net").otherwise("org/fr"), "id").alias("url"))
    out = url_filters.filter_urls(df)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert out.count() == 3000 and "Join" in plan
    assert "BroadcastHashJoin" not in out._jdf.queryExecution().sparkPlan().toString()


def test_model_has_a_row_for_each_context(spark):
    """Of 1000 n-grams with 100 contexts 100 rows are broadcast, with every ratio under its symbol."""
    grams = [(f"{i // 10:03d}"[::-1] + "abcdefghij"[i % 10], float(i)) for i in range(1000)]
    rows = url_filters.by_context(spark.createDataFrame(grams, "gram string, ratio double").repartition(5)).collect()
    assert len(rows) == 100
    assert {r.context + s: x for r in rows for s, x in zip(r.symbols, r.ratios, strict=True)} == dict(grams)
