"""Saved states, the older store of knowledge, searches, open concepts and the calendar; with the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import analysis, lookup
from tessera.sources import state
from tessera.sources.market_tables import observations, read

DEFAULTS = {"currency": "PLN", "language": "pl"}
SEARCHED = ("ruler", "nominal", "variant", "rarity", "source")
SINCE = "1997-06-01"


def state_scan(spark, sf_dir):
    """Everyone's saved state: whole, with lists that are none, broken, missing, or no object."""
    saved = r"""CASE c_custkey % 6 WHEN 0 THEN concat('{"coins":[1,2,', c_custkey, '],"albums":{},"settings":{"currency":"EUR"}}') WHEN 1 THEN '{"coins":"x","history":[1],"settings":[1]}'
        WHEN 2 THEN concat('{"coins":[', c_custkey) WHEN 4 THEN '[]' WHEN 5 THEN '{"events":[{"a":1},null],"settings":{"language":"en","view":"grid"}}' END"""
    out = state.state_scan(read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("owner"), F.expr(saved).alias("json")), "json", DEFAULTS)
    return out.select("owner", *(F.size(c).alias(f"n_{c}") for c in state.LISTS), *(F.col("settings")[k].alias(k) for k in ("currency", "language", "view")), "unreadable")


def knowledge_fallback(spark, sf_dir):
    rows = observations(spark, sf_dir).select("observation_id", F.col("source").alias("owner"), "ruler", "nominal")
    current = rows.where("owner <> 'src1' AND observation_id % 3 = 0")
    return state.with_older(current, rows.where("observation_id % 2 = 0"), "owner")


def knowledge_search(spark, sf_dir):
    return lookup.search(observations(spark, sf_dir), " R2 ", SEARCHED).select("observation_id", "source", "ruler", "nominal", "variant", "rarity")


def concept_upsert(spark, sf_dir):
    rows = read(spark, sf_dir, "part").selectExpr("p_partkey", "p_partkey % 60 AS id", "p_brand AS source", "concat('  ', p_name, '  ', p_type) AS label", "CASE WHEN p_partkey % 11 <> 0 THEN p_type ELSE ' ' END AS license", "p_partkey % 4 = 0 AS media_reusable")
    kept, _ = lookup.concepts(rows, ["p_partkey"])
    return kept.select("source", "id", "p_partkey", "label", "license", "media_reusable")


def calendar_abroad(spark, sf_dir):
    """Auctions to come outside one country, of houses that are favourites."""
    house = read(spark, sf_dir, "customer").join(F.broadcast(read(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 rows, a fixed table
    auctions = read(spark, sf_dir, "orders").join(house, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("auction_id"), F.col("o_orderdate").alias("starts_at"), F.col("c_name").alias("house"), F.col("n_name").alias("country"))
    liked = read(spark, sf_dir, "customer").where("c_acctbal > 5000").select(F.col("c_name").alias("house"))
    home = read(spark, sf_dir, "nation").agg(F.min("n_name")).first()[0]
    return analysis.upcoming(auctions, SINCE, country=home, favourites=liked, abroad=True)


QUERIES = {f.__name__: f for f in (state_scan, knowledge_fallback, knowledge_search, concept_upsert, calendar_abroad)}


def oracle(obs: str) -> dict[str, str]:
    anywhere = " OR ".join(f"contains(lower(coalesce({c}, '')), 'r2')" for c in SEARCHED)
    n = "CAST({} AS INTEGER)".format
    return {
        "state_scan": f"""WITH c AS (SELECT c_custkey AS owner, c_custkey % 6 AS k FROM customer)
 SELECT owner, {n("CASE WHEN k = 0 THEN 3 ELSE 0 END")} AS n_coins, {n("0")} AS n_albums, {n("0")} AS n_watchlist, {n("CASE WHEN k = 5 THEN 2 ELSE 0 END")} AS n_events, {n("CASE WHEN k = 1 THEN 1 ELSE 0 END")} AS n_history,
 CASE WHEN k = 0 THEN 'EUR' ELSE 'PLN' END AS currency, CASE WHEN k = 5 THEN 'en' ELSE 'pl' END AS language, CASE WHEN k = 5 THEN 'grid' END AS view, CASE WHEN k = 2 THEN '{{"coins":[' || owner END AS unreadable FROM c""",
        "knowledge_fallback": f"""WITH {obs}, c AS (SELECT * FROM obs WHERE source <> 'src1' AND observation_id % 3 = 0)
 SELECT observation_id, source AS owner, ruler, nominal, false AS from_older FROM c UNION ALL
 SELECT observation_id, source, ruler, nominal, true FROM obs o WHERE observation_id % 2 = 0 AND NOT EXISTS (SELECT 1 FROM c WHERE c.source IS NOT DISTINCT FROM o.source)""",
        "knowledge_search": f"WITH {obs} SELECT observation_id, source, ruler, nominal, variant, rarity FROM obs WHERE {anywhere}",
        "concept_upsert": r"""WITH p AS (SELECT p_partkey, CAST(p_partkey % 60 AS VARCHAR) AS id, p_brand AS source, trim(regexp_replace(p_name || ' ' || p_type, '\s+', ' ', 'g')) AS label, p_type AS license, p_partkey % 4 = 0 AS media_reusable,
 row_number() OVER (PARTITION BY p_brand, p_partkey % 60 ORDER BY p_partkey DESC) AS n FROM part WHERE p_partkey % 11 <> 0) SELECT source, id, p_partkey, left(label, 180) AS label, left(license, 120) AS license, media_reusable FROM p WHERE n = 1""",
        "calendar_abroad": f"""SELECT o_orderkey AS auction_id, o_orderdate AS starts_at, c_name AS house, n_name AS country FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
 WHERE o_orderdate >= TIMESTAMP '{SINCE}' AND c_acctbal > 5000 AND n_name <> (SELECT min(n_name) FROM nation)""",
    }
