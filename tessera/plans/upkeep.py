"""Care of a collection: likely duplicates, market refresh after corrections, registered types, costs of records, backups; with the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import cost, duplicates, ingest, knowledge, lifecycle
from tessera.plans.streams import folder
from tessera.sources import backup
from tessera.sources.market_tables import coins, facts, fee_rules, observations, read

RULES = backup.Rules("collection-backup", "state", ("facts", "knowledge"), {"view": ("grid", "list")}, ("moves",))


def coin_duplicates(spark, sf_dir):
    own = coins(spark, sf_dir).select("coin_id", "ruler", "year", F.col("raw_nominal").alias("nominal"), text.known(F.col("mint")).alias("mint"))
    return duplicates.likely_duplicates(own)


def market_refresh(spark, sf_dir):
    """Coins some of which were corrected after their detail analysis, or after their valuation."""
    now, raw = lifecycle.identity_key(*map(F.col, lifecycle.IDENTITY)), lifecycle.identity_key(*(F.col(f"raw_{c}") for c in lifecycle.IDENTITY))
    c = F.col("coin_id")
    rows = coins(spark, sf_dir).select("coin_id", (c % 5 < 3).alias("accepted"), (c % 2 == 0).alias("needs_reanalysis"), now.alias("identity_key"), F.when(c % 3 != 0, now).otherwise(raw).alias("detail_key"), F.when(c % 8 != 6, now).otherwise(raw).alias("valued_key"), "market_median", "stale")
    sales = facts(spark, sf_dir).groupBy(F.col("item_id").alias("coin_id")).agg(F.count("*").alias("n"), F.round(F.median("amount"), 6).alias("median"))
    valuations = sales.join(rows.select("coin_id", F.col("valued_key").alias("identity_key")), "coin_id").withColumn("quality", F.when(F.col("n") >= 25, "good").otherwise("indicative"))
    return lifecycle.market_refreshed(rows.drop("valued_key"), valuations).select("coin_id", "refreshed", F.round("market_median", 6).alias("market_median"), "valuation_quality", "auction_records", "needs_reanalysis", "stale")


def type_registry(spark, sf_dir):
    rows = observations(spark, sf_dir).selectExpr(
        "observation_id AS record_id", "CASE WHEN observation_id % 3 = 0 THEN concat('t', observation_id % 50) ELSE '' END AS type_id", "CASE WHEN expert THEN 'verified' ELSE 'candidate' END AS status",
        "CASE observation_id % 4 WHEN 0 THEN concat('ca. ', 1500 + observation_id % 300) WHEN 1 THEN '16' WHEN 2 THEN '0000' END AS year", "ruler", "nominal",
    )
    return knowledge.registered_types(rows)


def wanted_union(spark, sf_dir):
    """Goals before watched coins before the rest, one coin for each nominal and year."""
    own = coins(spark, sf_dir).select("coin_id", "nominal", "year")
    return ingest.first_wins([own.where("coin_id % 7 = 0"), own.where("coin_id % 3 = 0"), own], ["nominal", "year"], ["coin_id"])


def record_cost_view(spark, sf_dir):
    out = cost.record_cost(facts(spark, sf_dir), fee_rules(spark, sf_dir))
    return out.select("fact_id", "result_basis", "result_value", "complete", *(F.round(c, 6).alias(c) for c in ("premium", "vat", "total")))


def _documents(spark, sf_dir, items: str, version: str = "8"):
    made = F.expr(f"""concat('{{"format":"collection-backup","version":', {version}, ',"items":', {items}, '}}')""")
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("owner"), made.alias("json"))


def backup_check(spark, sf_dir):
    items = r"""CASE c_custkey % 8 WHEN 0 THEN '{"state":"{\\"coins\\":[1]}","view":"grid"}' WHEN 1 THEN '{"state":"{\\"coins\\":{}}","view":"wide"}' WHEN 2 THEN '{"other":"1"}'
        WHEN 3 THEN '[]' WHEN 4 THEN '{"facts":"[1","moves":"1"}' WHEN 5 THEN '{"facts":7}' WHEN 6 THEN '{' ELSE '{"knowledge":"null"}' END"""
    verdicts, _ = backup.checked(_documents(spark, sf_dir, items, "CAST(c_custkey % 9 AS STRING)"), RULES)
    return verdicts.select("owner", "status", F.array_join("bad_keys", ",").alias("bad_keys"))


def backup_restore(spark, sf_dir):
    """Everyone's backup, then another of a third, half of which is damaged."""
    store = backup.Store(spark, folder(spark, "backup"))
    first = r"""concat('{"state":"{\\"coins\\":[', c_custkey, ']}","view":"grid","moves":"1"}')"""
    second = r"""CASE WHEN c_custkey % 2 = 0 THEN '{"facts":"[1","view":"list"}' ELSE '{"facts":"[1]","view":"list"}' END"""
    store.restore(_documents(spark, sf_dir, first), RULES)
    store.restore(_documents(spark, sf_dir, second).where("owner % 3 = 0"), RULES)
    return store.items()


def backup_export(spark, sf_dir):
    items = read(spark, sf_dir, "customer").selectExpr("c_nationkey AS owner", "explode(array('view', 'moves', 'facts')) AS key").distinct().selectExpr("CAST(owner AS LONG) AS owner", "key", "CASE key WHEN 'view' THEN 'list' ELSE concat('[', owner, ']') END AS value")
    return backup.exported(items, RULES)


QUERIES = {f.__name__: f for f in (coin_duplicates, market_refresh, type_registry, wanted_union, record_cost_view, backup_check, backup_restore, backup_export)}


def oracle(facts: str, coins: str, obs: str, rules: str) -> dict[str, str]:
    agree = " AND ".join(f"coalesce(contains(a.{f}, b.{f}) OR contains(b.{f}, a.{f}), true)" for f in "rynm")
    both = " + ".join(f"CAST(a.{f} IS NOT NULL AND b.{f} IS NOT NULL AS INTEGER)" for f in "rynm")
    key = "lower({0}nominal) || '|' || lower(coalesce({0}ruler, '')) || '|' || {0}variant"
    return {
        "coin_duplicates": f"""WITH {coins}, k AS (SELECT coin_id, lower(ruler) AS r, CAST(year AS VARCHAR) AS y, lower(raw_nominal) AS n, CASE WHEN mint <> 'unknown' THEN lower(mint) END AS m FROM coins),
 p AS (SELECT a.coin_id, count(*) AS c FROM k a JOIN k b ON a.coin_id <> b.coin_id AND {agree} AND {both} >= 3 GROUP BY 1)
 SELECT coin_id, CASE WHEN r IS NULL AND m IS NULL THEN coin_id ELSE min(coin_id) OVER (PARTITION BY r, y, n, m) END AS first, coalesce(c, 0) AS n_same FROM k LEFT JOIN p USING (coin_id)""",
        "market_refresh": f"""WITH {facts}, {coins}, k AS (SELECT *, {key.format("")} AS now, {key.format("raw_")} AS was FROM coins),
 v AS (SELECT item_id, count(*) AS n, round(median(amount), 6) AS med FROM facts GROUP BY 1),
 j AS (SELECT k.*, v.n, med, coin_id % 5 < 3 AND coin_id % 2 = 0 AND (coin_id % 3 <> 0 OR now = was) AND (coin_id % 8 <> 6 OR now = was) AND n IS NOT NULL AS hit FROM k LEFT JOIN v ON coin_id = item_id)
 SELECT coin_id, hit AS refreshed, round(CASE WHEN hit THEN med ELSE market_median END, 6) AS market_median, CASE WHEN hit THEN CASE WHEN n >= 25 THEN 'good' ELSE 'indicative' END END AS valuation_quality,
 CASE WHEN hit THEN n END AS auction_records, coin_id % 2 = 0 AND NOT hit AS needs_reanalysis, stale AND NOT hit AS stale FROM j""",
        "type_registry": f"""WITH {obs}, t AS (SELECT CASE WHEN observation_id % 3 = 0 THEN 't' || (observation_id % 50) ELSE 'verified_' || observation_id END AS type_id, observation_id AS record_id,
 CASE observation_id % 4 WHEN 0 THEN CAST(1500 + observation_id % 300 AS INTEGER) END AS year, ruler, nominal FROM obs WHERE expert),
 r AS (SELECT *, row_number() OVER (PARTITION BY type_id ORDER BY record_id) AS n FROM t) SELECT type_id, record_id, year, ruler, nominal FROM r WHERE n = 1""",
        "wanted_union": f"""WITH {coins}, u AS (SELECT coin_id, nominal, year, CASE WHEN coin_id % 7 = 0 THEN 0 WHEN coin_id % 3 = 0 THEN 1 ELSE 2 END AS source_rank FROM coins),
 r AS (SELECT *, row_number() OVER (PARTITION BY nominal, year ORDER BY source_rank, coin_id) AS n FROM u) SELECT nominal, year, coin_id, source_rank FROM r WHERE n = 1""",
        "record_cost_view": f"""WITH {facts}, {rules} SELECT fact_id, CASE WHEN hammer_price > 0 THEN 'hammer' WHEN realized_price > 0 THEN 'realized' WHEN total_price > 0 THEN 'total' ELSE 'unknown' END AS result_basis,
 CASE WHEN hammer_price > 0 THEN hammer_price WHEN realized_price > 0 THEN realized_price WHEN total_price > 0 THEN total_price ELSE amount END AS result_value, pct IS NOT NULL AND coalesce(hammer_price > 0, false) AS complete,
 CASE WHEN hammer_price > 0 THEN round(hammer_price * pct / 100, 6) END AS premium, CASE WHEN hammer_price > 0 THEN round(hammer_price * pct / 100 * 23.0::DOUBLE / 100, 6) END AS vat,
 CASE WHEN hammer_price > 0 THEN round(hammer_price + hammer_price * pct / 100 + hammer_price * pct / 100 * 23.0::DOUBLE / 100 + fixed::DOUBLE, 6) END AS total FROM ruled""",
        "backup_check": """WITH c AS (SELECT c_custkey AS owner, c_custkey % 9 = 0 OR c_custkey % 8 IN (3, 6) AS bad, c_custkey % 8 AS k FROM customer)
 SELECT owner, CASE WHEN bad THEN 'unsupported' WHEN k IN (0, 7) THEN 'ok' WHEN k = 2 THEN 'unknown_key' ELSE 'bad_value' END AS status,
 CASE WHEN bad OR k IN (0, 7) THEN '' WHEN k = 1 THEN 'state,view' WHEN k = 2 THEN 'other' ELSE 'facts' END AS bad_keys FROM c""",
        "backup_restore": """SELECT c_custkey AS owner, 'state' AS key, '{"coins":[' || c_custkey || ']}' AS value FROM customer UNION ALL SELECT c_custkey, 'view', CASE WHEN c_custkey % 6 = 3 THEN 'list' ELSE 'grid' END FROM customer
 UNION ALL SELECT c_custkey, 'facts', '[1]' FROM customer WHERE c_custkey % 6 = 3""",
        "backup_export": """SELECT DISTINCT CAST(c_nationkey AS BIGINT) AS owner, '{"format":"collection-backup","version":8,"items":{"facts":"[' || c_nationkey || ']","view":"list"}}' AS json FROM customer""",
    }
