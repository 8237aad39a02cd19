"""More of the library's operators over the star-schema tables; records_sql.py has the same in SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import albums, collection, community, extract, identity, ingest, knowledge, selection
from tessera.sources.market_tables import coins, facts, observations, read

CLAIMS = (
    ("c1", "hypothesis", "Brand#12", 1501, 1510, None, None, ["steel", "copper"]),
    ("c2", "hypothesis", None, 1520, None, "standard", None, ["blue"]),
    ("c3", "hypothesis", None, None, None, None, None, ["red", "steel", "goldenrod"]),
    ("c4", "occupation_mint_diagnostics", "brand 3", 1505, 1540, "promo", "Mint 4", ["green"]),
    ("c5", "hypothesis", None, None, None, "small plated copper", "mint 1", []),
    ("c6", "hypothesis", "brand", 1500, 1549, None, None, ["lace", "linen", "navy", "tin"]),
    ("c7", "hypothesis", None, None, None, None, "mint", ["metallic"]),
)
CLAIM = "claim_id string, claim_type string, ruler string, year_from int, year_to int, nominal string, mint string, keywords array<string>"
REIGNS = (("Brand#11", 1501, 1512), ("Brand#2", 1505, 1530), ("Brand#35", 1520, 1540))
TIERS = (("src0", "GREEN"), ("src1", "GREEN"), ("src2", "AMBER"), ("src3", "RED: licence"), ("src5", "GREEN"))


def html_facts(spark, sf_dir):
    """Lots written as pages, in two languages, some without price or day, and read again: fact rows and error rows."""
    polish = F.col("lot_key") % 2 == 0
    price = F.concat(F.floor("amount").cast("string"), F.lit(",50 "), F.when(F.col("currency") == "EUR", "€").when(F.col("currency") == "USD", "USD").otherwise("zł"))
    parts = [
        F.lit("<html><style>p {}</style><script>var x = 'Sell price: 1 EUR';</script><p>Sale:&nbsp;A</p><td>Lot number: "), F.col("lot_key").cast("string"),
        F.lit("</td><td>Description: c &amp; d</td><td>"), F.when(polish, "Stan").otherwise("Grade"), F.lit(": "), F.coalesce("grade", F.lit("-")), F.lit("</td><td>"),
        F.when(F.col("lot_key") % 7 == 0, "").otherwise(F.concat(F.when(polish, "Cena sprzedaży").otherwise("Sell price"), F.lit(": "), price)), F.lit("</td>\n<td>"),
        F.when(F.col("lot_key") % 11 == 0, "").otherwise(F.concat(F.when(polish, "Data sprzedaży").otherwise("Sell date"), F.lit(": "), F.date_format("sold_at", "dd-MM-yyyy"))), F.lit("</td></html>"),
    ]
    pages = facts(spark, sf_dir).select("fact_id", F.concat(*parts).alias("html"))
    return extract.lot_rows(pages, "html").drop("html")


def price_clean(spark, sf_dir):
    rows = facts(spark, sf_dir).withColumns({"price_type": F.expr("CASE l % 3 WHEN 0 THEN 'realized' WHEN 1 THEN 'total' ELSE 'other' END".replace("l ", "lot_key ")), "price": F.when(F.col("lot_key") % 5 == 0, 0.0).when(F.col("lot_key") % 2 == 0, F.col("amount"))})
    rows = rows.withColumns({c: F.when(F.col("lot_key") % 4 != 1, F.col(c)) for c in ("hammer_price", "realized_price", "total_price")})
    return ingest.clean_prices(rows).select("fact_id", "price", "realized_price", "basis")


def community_match(spark, sf_dir):
    return community.matches(coins(spark, sf_dir), spark.createDataFrame(list(CLAIMS), CLAIM))


def community_scan(spark, sf_dir):
    seeds = spark.createDataFrame(list(CLAIMS), CLAIM).select("claim_id", "claim_type")
    own = observations(spark, sf_dir).where("origin = 'user'").select(F.concat(F.lit("c"), (F.col("observation_id") % 300).cast("string")).alias("claim_id"), F.col("source").alias("claim_type")).distinct()
    return community.scan(own, seeds).groupBy("claim_type", "status").agg(F.count("*").alias("n"))


def source_links(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", community.belongs(F.col("url"), F.lit("example.com")).alias("belongs"))


def multi_source_evidence(spark, sf_dir):
    firsts = coins(spark, sf_dir).groupBy("nominal").agg(F.min("coin_id").alias("coin_id")).select("coin_id")
    types = coins(spark, sf_dir).join(firsts, "coin_id", "left_semi").withColumnRenamed("coin_id", "type_id")
    return identity.agreeing(coins(spark, sf_dir), types, identity.EVIDENCE, 5, "type_id")


def chronology_guard(spark, sf_dir):
    rows = coins(spark, sf_dir).select("coin_id", "ruler", F.col("year").cast("int").alias("year"), (F.col("coin_id") % 101).cast("int").alias("confidence"), "estimate_low", "estimate_high")
    reigns = spark.createDataFrame(list(REIGNS), "name string, from_year int, to_year int")
    return identity.chronology(rows, reigns).select("coin_id", "mismatch", "confidence", "estimate_low", "estimate_high")


def fingerprint_evidence(spark, sf_dir):
    rows = coins(spark, sf_dir).select("coin_id", (F.col("coin_id") % 101).alias("score"), (F.col("coin_id") % 9).alias("matched"), (F.col("coin_id") % 4).alias("conflicts"))
    status = identity.fingerprint_status(F.col("score"), F.col("matched"), F.col("conflicts"))
    other = identity.fingerprint_status(100 - F.col("score"), F.col("matched"), F.lit(0))
    return rows.select("coin_id", status.alias("status"), identity.verdict(F.array(status, other)).alias("verdict"))


def model_route(spark, sf_dir):
    c = F.col("coin_id")
    how = identity.route(F.when(c % 10 == 0, "detail").otherwise("basic"), c % 1000, 95 + c % 6, c % 5, 80 + c % 21, c % 17)
    return coins(spark, sf_dir).select("coin_id", how.alias("route"))


def reference_check(spark, sf_dir):
    label = F.lower(F.concat_ws(" ", "title", "nominal", F.col("year").cast("string"), F.when(F.col("coin_id") % 3 == 0, "poland")))
    forms = F.array(F.lower(F.element_at(F.split("nominal", " "), 1)), F.lit("talar"))
    rulers = F.when(F.col("coin_id") % 4 == 0, F.array().cast("array<string>")).otherwise(F.array(F.element_at(F.split("title", " "), 2), F.lit("blue")))
    year = (1500 + F.col("coin_id") % 50).cast("string")
    return coins(spark, sf_dir).select("coin_id", identity.reference_score(label, year, forms, rulers).alias("score"), identity.reference_status(label, year, forms, rulers).alias("status"))


def _albums(spark, sf_dir):
    ids = F.array_distinct(F.array(F.concat(F.lit("a"), (F.col("coin_id") % 7).cast("string")), F.when(F.col("coin_id") % 5 == 0, "goals").otherwise("dreams")))
    return coins(spark, sf_dir).select("coin_id", "purchase_price", "grade", ids.alias("album_ids"))


def _listed(ids):
    return F.array_join(F.sort_array(ids), ",")


def album_moves(spark, sf_dir):
    known = spark.createDataFrame([(f"a{i}",) for i in range(5)] + [("goals",)], "album_id string")
    c = F.col("coin_id")
    moves = coins(spark, sf_dir).where("coin_id % 2 = 0").select("coin_id", F.when(c % 3 != 0, F.concat(F.lit("a"), (c % 7).cast("string"))).alias("source"), F.when(c % 10 != 4, F.concat(F.lit("a"), (c % 8).cast("string"))).alias("target"))
    out = albums.changed(_albums(spark, sf_dir), moves, known)
    return out.select("coin_id", _listed(F.col("album_ids")).alias("album_ids"))


def default_albums(spark, sf_dir):
    have = spark.createDataFrame([("a1", "Alpha", "user"), ("a9", "Old", "user"), ("a3", "Gamma", "user"), ("x", "moje CELE", "user")], "album_id string, name string, kind string")
    return albums.with_defaults(have, _albums(spark, sf_dir), have.where("album_id IN ('a9', 'a1')").select("album_id", "name"))


def target_purchase(spark, sf_dir):
    c = F.col("coin_id")
    lots = coins(spark, sf_dir).where("coin_id % 10 = 0").select("coin_id", F.when(c % 20 == 0, 100.0 + c).alias("hammer_price"), F.when(c % 30 == 0, 200.0 + c).alias("realized_price"), F.when(c % 50 == 0, 0.0).otherwise(300.0 + c).alias("price"))
    watch = coins(spark, sf_dir).where("coin_id % 4 = 0").select("coin_id")
    out, left = albums.bought(_albums(spark, sf_dir), lots, watch)
    return out.join(left.withColumn("watched", F.lit(True)), "coin_id", "left").select("coin_id", "purchase_price", _listed(F.col("album_ids")).alias("album_ids"), F.coalesce("watched", F.lit(False)).alias("watched"))


def album_filter(spark, sf_dir):
    return albums.in_album(_albums(spark, sf_dir), "goals", grade="AU").select("coin_id")


def rarity_facets(spark, sf_dir):
    key = albums.rarity_key(F.col("coin_id") % 3 == 0, F.col("catalog_ref"), F.when(F.col("coin_id") % 2 == 0, "R2"))
    return coins(spark, sf_dir).groupBy(key.alias("rarity")).agg(F.count("*").alias("n"))


def knowledge_normalise(spark, sf_dir):
    rows = observations(spark, sf_dir).selectExpr(
        "observation_id", "source", "concat('  ', ruler, '  x ') AS ruler", "nominal", "variant", "CAST(NULL AS STRING) AS catalog_ref", "CASE WHEN observation_id % 6 <> 0 THEN concat('https://s.example/', observation_id) END AS source_url",
        "CASE observation_id % 4 WHEN 0 THEN '1623 (?)' WHEN 1 THEN 'ca 1500' WHEN 2 THEN '' END AS year", "CASE observation_id % 3 WHEN 0 THEN '12,5' WHEN 1 THEN 'free' END AS sale_price",
    )
    return knowledge.valid(knowledge.normalised(rows)).select("observation_id", "source", "ruler", "year", "sale_price")


def trust_evidence(spark, sf_dir):
    given = F.array("source", F.concat(F.lit("src"), (F.col("observation_id") % 5).cast("string")))
    listed = knowledge.evidence_list(F.col("origin") == "ai", F.col("origin") == "user", F.col("expert"), F.array("source"), given)
    return observations(spark, sf_dir).select("observation_id", F.array_join(F.transform(listed, lambda e: F.concat_ws(":", e["kind"], e["source"])), ",").alias("evidence"))


def verified_scan(spark, sf_dir):
    tiers = spark.createDataFrame([("src0", "ALLOW"), ("src1", "ALLOW"), ("src2", "ALLOW_WITH_RIGHTS"), ("src4", "BLOCK")], "source string, ingest string")
    rows = observations(spark, sf_dir).withColumn("rights", F.when(F.col("observation_id") % 5 != 0, "CC0").otherwise(" "))
    return knowledge.verified(rows, tiers, "ruler", "nominal", "variant", rights="rights")


def source_ingest(spark, sf_dir):
    rows = observations(spark, sf_dir).select(F.col("observation_id").alias("record_id"), "source", F.when(F.col("observation_id") % 3 == 0, F.col("nominal")).otherwise("").alias("source_id"), F.concat(F.lit("u"), (F.col("observation_id") % 17).cast("string")).alias("source_url"), "observation_id")
    return knowledge.ingested(rows, spark.createDataFrame(list(TIERS), "source string, tier string"), [F.col("observation_id")]).select("record_id", "source", "source_id", "source_url", "observation_id")


def fee_rule_upsert(spark, sf_dir):
    """Rules need a house, a day of checking and rates that are not negative; the last one of a house and day stays."""
    rows = read(spark, sf_dir, "lineitem").select(F.when(F.col("l_suppkey") % 9 != 0, F.concat(F.lit("H"), (F.col("l_suppkey") % 50).cast("string"))).alias("house"), F.col("l_shipdate").cast("date").alias("checked_at"), (F.col("l_partkey") % 25 - 2).cast("double").alias("premium_pct"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    good = rows.where("house IS NOT NULL AND checked_at IS NOT NULL AND premium_pct >= 0")
    order = [F.col(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")]
    return ingest.upsert_latest(good, ["house", "checked_at"], order).select("house", "checked_at", "premium_pct")


def collection_pages(spark, sf_dir):
    """The second page of 60 coins, in each of the five orders."""
    rows = coins(spark, sf_dir).select("coin_id", "year", "nominal", "title", ((F.col("coin_id") * 7919) % 1000).alias("added_at"))
    out = None
    for mode in ("added-desc", "year-asc", "year-desc", "nominal-asc", "nominal-desc"):
        page = rows.orderBy(*collection.sort_key(mode)).limit(120)
        page = page.withColumn("place", F.row_number().over(Window.orderBy(*collection.sort_key(mode))).cast("long")).where("place > 60").select(F.lit(mode).alias("mode"), "coin_id", "place")
        out = page if out is None else out.unionByName(page)
    return out


def upper_median(spark, sf_dir):
    """The upper of the two middle prices, without a mean."""
    return selection.upper_middle(facts(spark, sf_dir).select("nominal", F.col("amount").alias("price")), ["nominal"], "price")


def source_summary(spark, sf_dir):
    return facts(spark, sf_dir).groupBy("source").agg(F.count("*").alias("n"))


def latest_coins(spark, sf_dir):
    """The three coins that were changed or made last: a report."""
    rows = coins(spark, sf_dir).select("coin_id", F.coalesce(F.when(F.col("coin_id") % 3 == 0, F.col("coin_id") % 500), F.col("coin_id") % 400).alias("seen_at"))
    return rows.orderBy(F.desc("seen_at"), "coin_id").limit(3)


def knowledge_coverage(spark, sf_dir):
    return observations(spark, sf_dir).groupBy("origin").agg(F.count("*").alias("n"), F.count_distinct("source").alias("sources"), F.count_if("expert").alias("experts"))


def canonical_title(spark, sf_dir):
    parts = [text.known(F.col(c).cast("string")) for c in ("nominal", "ruler", "mint", "year")]
    return coins(spark, sf_dir).select("coin_id", F.concat_ws(" • ", *parts).alias("title"))


def lot_to_coin(spark, sf_dir):
    """A lot as a new coin of the collection, with where it came from."""
    said = F.concat_ws(", ", "house", F.date_format("sold_at", "yyyy-MM-dd"), F.concat(F.lit("lot "), F.col("lot_key").cast("string")))
    price = F.coalesce(*(F.when(F.col(c) > 0, F.col(c)) for c in ("hammer_price", "realized_price", "total_price")))
    return facts(spark, sf_dir).select("fact_id", "ruler", "nominal", "year", "mint", "variant", price.alias("purchase_price"), F.col("currency").alias("purchase_currency"), said.alias("provenance"))


NAMES = (
    html_facts, price_clean, community_match, community_scan, source_links, multi_source_evidence, chronology_guard, fingerprint_evidence, model_route, reference_check, album_moves,
    default_albums, target_purchase, album_filter, rarity_facets, knowledge_normalise, trust_evidence, verified_scan, source_ingest, fee_rule_upsert, collection_pages, upper_median,
    source_summary, latest_coins, knowledge_coverage, canonical_title, lot_to_coin,
)
QUERIES = {f.__name__: f for f in NAMES}
