"""Payloads, analyses and earlier records made of the star-schema tables and read by the library; intake_sql.py has the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import analysis, lifecycle, migrate
from tessera.sources import feeds
from tessera.sources.market_tables import coins, facts


def feed_records(spark, sf_dir):
    """A feed of three items for each coin, one of which has no title."""
    xml = F.expr(
        """concat('<rss><item>\n<title><![CDATA[', title, ' &amp; co]]></title><link>http://lots.example/a/', coin_id, '/</link></item>',
        '<ITEM x="1"><title> </title><guid>g</guid></ITEM><item><title lang="en">', nominal, '</title><guid>n/', coin_id, '</guid></item></rss>')"""
    )
    return feeds.rss_records(coins(spark, sf_dir).select("coin_id", xml.alias("xml")), "xml")


def graph_labels(spark, sf_dir):
    """A graph for each coin, labelled by a list, a text or an object, or no JSON at all."""
    json = F.expr(
        """CASE coin_id % 4
        WHEN 0 THEN concat('{"@graph":[{"@id":"x/id/other","skos:prefLabel":"no"},{"@id":"http://n/id/', coin_id, '","skos:prefLabel":[{"@language":"de","@value":"D"},{"@language":"en","@value":"', nominal, '"}]}]}')
        WHEN 1 THEN '{"@graph":[{"@id":"q","label":"first"}]}'
        WHEN 2 THEN concat('{"@id":"z","skos:prefLabel":{"@value":"', nominal, '"}}') ELSE '{"@graph":[' END"""
    )
    return feeds.graph_labels(coins(spark, sf_dir).select("coin_id", F.col("coin_id").cast("string").alias("node"), json.alias("json")), "json", "node").drop("node")


def met_objects(spark, sf_dir):
    fields = coins(spark, sf_dir).selectExpr(
        "coin_id AS objectID", "coin_id % 3 <> 0 AS isPublicDomain", "title", "CASE WHEN coin_id % 2 = 0 THEN 'Coin' END AS objectName", "mint AS city", "ruler AS artistDisplayName",
        "CASE WHEN coin_id % 5 = 0 THEN array(named_struct('term', 'Tokens')) END AS tags", "CAST(year AS STRING) AS objectDate", "CASE WHEN coin_id % 7 = 0 THEN '' ELSE concat('img', coin_id) END AS primaryImage",
    )
    return feeds.met_records(fields.select(F.to_json(F.struct("*")).alias("json")), "json")


def smithsonian_objects(spark, sf_dir):
    fields = coins(spark, sf_dir).selectExpr(
        "CAST(coin_id AS STRING) AS id", "CASE coin_id % 4 WHEN 0 THEN concat('Coin ', title) WHEN 1 THEN 'A catalog of coins' ELSE title END AS title", "CASE WHEN coin_id % 3 = 0 THEN 'nmah' ELSE 'ABC' END AS unitCode",
        """named_struct('descriptiveNonRepeating', named_struct('record_link', concat('u', coin_id), 'online_media', named_struct('media', array(
        named_struct('content', 'closed', 'usage', named_struct('access', 'none')), named_struct('content', concat('i', coin_id), 'usage', named_struct('access', CASE WHEN coin_id % 5 = 0 THEN 'cc0' ELSE 'no' END))))),
        'freetext', named_struct('objectType', array(named_struct('content', CASE WHEN coin_id % 2 = 0 THEN 'Medal' END)))) AS content""",
    )
    return feeds.smithsonian_records(fields.select(F.to_json(F.struct("*")).alias("json")), "json")


def _spread(spark, rows):
    """Small rows that much work is done on: a file of many of them is few read tasks, so they are dealt out."""
    return rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))


def europeana_objects(spark, sf_dir):
    json = F.expr(
        """concat('{"object":{"about":"/1/', coin_id, '"', CASE WHEN coin_id % 4 = 0 THEN ',"provider":["own"]' ELSE '' END, ',"type":"IMAGE","title":["', title, '"],"year":"', year, '","aggregations":[{"edmRights":', CASE coin_id % 3 WHEN 0 THEN '"http://creativecommons.org/licenses/by/4.0/"'
        WHEN 1 THEN '["http://rightsstatements.org/vocab/InC/1.0/","http://rightsstatements.org/vocab/InC/1.0/"]' ELSE '{"def":["http://rightsstatements.org/vocab/NoC-NC/1.0/"],"en":["x"]}' END,
        CASE coin_id % 4 WHEN 1 THEN ',"edmDataProvider":{"en":["english"],"pl":["polski"]}' WHEN 2 THEN ',"edmDataProvider":"text","edmProvider":{"pl":"no"}' WHEN 3 THEN ',"edmProvider":{"de":["deutsch"]}' ELSE '' END, '},{}]}}')"""
    )
    return feeds.europeana_records(_spread(spark, coins(spark, sf_dir).select(json.alias("json"))), "json")


def analysis_settled(spark, sf_dir):
    rows = coins(spark, sf_dir).selectExpr(
        "coin_id", "CASE WHEN coin_id % 9 = 0 THEN 'nie ustalono' ELSE 'Polska' END AS country", "ruler", "year", "CASE WHEN coin_id % 11 = 0 THEN 'X, do potwierdzenia' ELSE nominal END AS nominal",
        "CAST(coin_id % 130 - 10 AS INT) AS confidence", "CAST(70 + coin_id % 40 AS INT) AS ruler_confidence", "90 AS year_confidence", "CASE WHEN coin_id % 17 <> 0 THEN 88 END AS nominal_confidence",
        "CASE WHEN coin_id % 16 = 2 THEN estimate_high ELSE estimate_low END AS estimate_low", "CASE WHEN coin_id % 16 = 2 THEN estimate_low ELSE estimate_high END AS estimate_high",
        "CASE coin_id % 13 WHEN 0 THEN array('w') WHEN 1 THEN array('') END AS warnings",
    )
    out = analysis.settled(rows).withColumn("ordered", F.col("estimate_low") <= F.col("estimate_high"))
    return out.select("coin_id", "confidence", "ruler_confidence", "nominal_confidence", "ordered", F.array_join("missing", ",").alias("missing"), "needs_detail")


def description_reconciled(spark, sf_dir):
    said = F.expr("concat('Intro here. The coin is a ', raw_nominal, '. Fine surface. Minted under ', raw_ruler, '! Of type ', raw_variant, '.')")
    current = {c: F.col(c) for c in lifecycle.IDENTITY}
    raw = {c: F.col(f"raw_{c}") for c in lifecycle.IDENTITY}
    return _spread(spark, coins(spark, sf_dir)).select("coin_id", analysis.reconciled(said, current, raw).alias("description"))


def literature_works(spark, sf_dir):
    given = F.expr("CASE WHEN coin_id % 3 = 0 THEN array(' Kopicki ', 'Gumowski') END")
    works = analysis.literature({"tyszkiewicz": F.col("catalog_ref").isNotNull(), "parchimowicz": F.col("coin_id") % 5 == 0}, given)
    return coins(spark, sf_dir).select("coin_id", F.array_join(works, ",").alias("works"))


def photo_choice(spark, sf_dir):
    c = F.col("coin_id")
    mode = F.when(c % 3 == 0, "none").when(c % 3 == 1, "cut").otherwise("full")
    cut = F.when(c % 5 != 0, F.concat(F.lit("c"), c.cast("string")))
    return coins(spark, sf_dir).select("coin_id", analysis.photo(mode, cut, F.concat(F.lit("o"), c.cast("string")), c % 4).alias("photo"))


def earlier_prices(spark, sf_dir):
    rows = facts(spark, sf_dir).withColumns({"price_type": F.when(F.col("lot_key") % 3 == 0, "hammer").when(F.col("lot_key") % 3 == 1, "realized"), "price": F.col("amount")})
    return migrate.prices_by_type(rows).select("fact_id", "price_type", "hammer_price", "realized_price", "source_url")


def earlier_coins(spark, sf_dir):
    pairs = {c: (F.col(c), F.col(f"raw_{c}")) for c in lifecycle.IDENTITY}
    rows = coins(spark, sf_dir).withColumn("record_version", (F.col("coin_id") % 6).cast("int"))
    changed = F.size(lifecycle.changed_fields(F.col("accepted"), pairs)) > 0
    out = migrate.quarantined(rows, ("market_median", "estimated_value", "catalog_ref"), changed, F.col("coin_id") % 4 == 0)
    return out.select("coin_id", "quarantined", "stale", "record_version", F.col("market_median").isNotNull().alias("has_median"))


NAMES = (
    feed_records, graph_labels, met_objects, smithsonian_objects, europeana_objects, analysis_settled, description_reconciled, literature_works, photo_choice, earlier_prices, earlier_coins,
)
QUERIES = {f.__name__: f for f in NAMES}
