"""Market facts, coins, rules and observations, read from the star-schema tables.

Every view is a projection over scans, so filters and column pruning reach the Parquet readers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The day that ages and periods are counted from; fixed, so that results do not change with the clock.
AS_OF = "2001-11-05"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def facts(spark: SparkSession, sf_dir: str, lineitem: DataFrame | None = None) -> DataFrame:
    """Auction price facts: one row of lineitem each, with its house, lot identity and one price.

    lineitem can be a stream of such rows in place of the table.
    """
    nations = F.broadcast(read(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey"))  # 25 rows, a fixed table
    houses = read(spark, sf_dir, "supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "s_name", "n_name", "n_regionkey")
    lots = read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    rows = (read(spark, sf_dir, "lineitem") if lineitem is None else lineitem).join(lots, F.col("l_partkey") == F.col("p_partkey")).join(houses, F.col("l_suppkey") == F.col("s_suppkey"))
    return rows.selectExpr(
        "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, date_format(l_shipdate, 'yyyyMMdd'), cast(round(l_extendedprice * 100) as bigint)) AS fact_id",
        "l_orderkey AS lot_key",
        "l_partkey AS item_id",
        "concat('S', cast(l_suppkey % 6 as string)) AS source",
        "CASE WHEN l_orderkey % 5 <> 0 THEN concat('https://lots.example/', cast(l_orderkey as string)) END AS source_url",
        "s_name AS house",
        "l_shipdate AS sold_at",
        "CASE WHEN l_returnflag = 'A' THEN l_extendedprice END AS hammer_price",
        "CASE WHEN l_returnflag = 'N' THEN l_extendedprice END AS realized_price",
        "CASE WHEN l_returnflag = 'R' THEN l_extendedprice END AS total_price",
        "l_extendedprice AS amount",
        "CASE n_regionkey WHEN 0 THEN 'PLN' WHEN 1 THEN 'EUR' WHEN 2 THEN 'USD' WHEN 3 THEN 'GBP' ELSE 'CHF' END AS currency",
        "CASE WHEN l_partkey % 7 <> 0 THEN p_brand END AS ruler",
        "p_type AS nominal",
        "1500 + p_size AS year",
        "n_name AS mint",
        "CASE WHEN l_orderkey % 3 <> 0 THEN concat('v', cast(l_linenumber % 3 as string)) END AS variant",
        "CASE l_linenumber % 6 WHEN 0 THEN 'AU 58' WHEN 1 THEN 'XF' WHEN 2 THEN 'Very Fine' WHEN 3 THEN 'F' WHEN 5 THEN 'II' END AS grade",
        "CASE WHEN l_partkey % 4 = 0 THEN concat('K', cast(l_partkey % 50 as string)) END AS catalog_ref",
        "p_name AS title",
    )


def coins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A collection: one coin for each part."""
    return read(spark, sf_dir, "part").selectExpr(
        "p_partkey AS coin_id",
        "p_name AS title",
        "CASE WHEN p_partkey % 7 <> 0 THEN p_brand END AS ruler",
        "p_type AS nominal",
        "1500 + p_size AS year",
        "CASE WHEN p_partkey % 6 = 0 THEN 'unknown' ELSE concat('Mint ', cast(p_partkey % 9 as string)) END AS mint",
        "concat('v', cast(p_partkey % 3 as string)) AS variant",
        "CASE p_partkey % 5 WHEN 0 THEN 'AU' WHEN 1 THEN 'XF 45' WHEN 2 THEN 'VF' WHEN 3 THEN 'fine' END AS grade",
        "CASE WHEN p_partkey % 4 = 0 THEN concat('K', cast(p_partkey % 50 as string)) END AS catalog_ref",
        "p_retailprice AS purchase_price",
        "CASE WHEN p_partkey % 10 < 8 THEN 'PLN' ELSE 'EUR' END AS purchase_currency",
        "CASE WHEN p_partkey % 3 = 0 THEN p_retailprice * 1.5 END AS market_median",
        "CASE WHEN p_partkey % 4 = 1 THEN p_retailprice * 1.2 END AS estimated_value",
        "CASE WHEN p_partkey % 8 = 2 THEN p_retailprice * 0.8 END AS estimate_low",
        "CASE WHEN p_partkey % 8 = 2 THEN p_retailprice * 1.4 END AS estimate_high",
        "p_partkey % 13 = 0 AS stale",
        "p_partkey % 5 = 0 AS accepted",
        "CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE concat(p_type, ' x') END AS raw_nominal",
        "p_brand AS raw_ruler",
        "concat('v', cast(p_partkey % 4 as string)) AS raw_variant",
    )


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sourced knowledge: documents as observations of an identity, experts by quality label."""
    labels = read(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    return docs.join(labels, "doc_id", "left").selectExpr(
        "doc_id AS observation_id",
        "source",
        "lang AS ruler",
        "cast(n_chars % 40 as string) AS nominal",
        "CASE WHEN doc_id % 3 = 0 THEN NULL ELSE cast(n_chars % 3 as string) END AS variant",
        "CASE WHEN n_chars % 5 = 0 THEN 'R' WHEN n_chars % 5 = 1 THEN 'R2' END AS rarity",
        "coalesce(quality = 1, false) AS expert",
        "CASE WHEN doc_id % 4 = 0 THEN 'user' WHEN doc_id % 4 = 1 THEN 'ai' ELSE 'catalogue' END AS origin",
    )


def fee_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two fee rules for most houses, the later one checked later, with open or closed validity."""
    return read(spark, sf_dir, "supplier").selectExpr(
        "s_name AS house",
        "explode(array(named_struct('valid_from', date'1995-01-01', 'valid_to', date'1998-12-31', 'checked_at', date'1995-02-01', 'premium_pct', 15.0D + s_suppkey % 5, 'vat_pct', 23.0D, 'fixed_fee', 0.0D),"
        " named_struct('valid_from', date'1998-06-01', 'valid_to', cast(null as date), 'checked_at', date'1998-06-02', 'premium_pct', 18.0D + s_suppkey % 5, 'vat_pct', 23.0D, 'fixed_fee', 5.0D))) AS rule",
    ).where("substring(house, -1) <> '7'").select("house", "rule.*")
