"""The library's operators applied to the star-schema tables; oracle.py has the same in SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import collection, cost, extract, fingerprint, ingest, knowledge, lifecycle, market, match
from tessera.plans import intake, prints, records, stores, streams, upkeep
from tessera.plans.valuation import price_range, valuation, valuation_agreed, valuation_once
from tessera.sources.market_tables import AS_OF, coins, facts, fee_rules, observations, read
from tessera.streaming import jobs

# Reigns and eras with their years, in the order of the dictionary.
ERAS = (("medieval", 960, 1506), ("jagiellonian", 1386, 1572), ("elective", 1573, 1795), ("partitions", 1795, 1918), ("ii-rp", 1918, 1939), ("war", 1939, 1945), ("prl", 1945, 1989), ("iii-rp", 1990, 2100))
LICENCES = (("src0", "ALLOW"), ("src1", "ALLOW"), ("src2", "ALLOW_WITH_RIGHTS"), ("src3", "ALLOW_WITH_RIGHTS"), ("src4", "REFERENCE_ONLY"), ("src5", "BLOCK"), ("src6", "ALLOW"))


def priced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market.price_basis(facts(spark, sf_dir))


def banded_coins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coins(spark, sf_dir).withColumns({"band": market.grade_band(F.col("grade")), "mint": text.known(F.col("mint"))})


def price_basis(spark, sf_dir):
    return priced(spark, sf_dir).select("fact_id", "basis", "price")


def fact_validity(spark, sf_dir):
    return market.valid(facts(spark, sf_dir)).groupBy("source", "currency").agg(F.count("*").alias("n"))


def archive_search(spark, sf_dir):
    return market.search(facts(spark, sf_dir), AS_OF, years=3, currency="EUR", text="brand#2").select("fact_id", "house", "year")


def market_stats_by_type(spark, sf_dir):
    return market.statistics(priced(spark, sf_dir), "nominal", "basis")


def dominant_basis(spark, sf_dir):
    rows = priced(spark, sf_dir).withColumn("sale_year", F.year("sold_at").cast("long"))
    return market.dominant_basis(rows, "item_id", "sale_year")


def evidence_quality(spark, sf_dir):
    return market.evidence(facts(spark, sf_dir)).groupBy("evidence_level", "core_complete").agg(F.count("*").alias("n"), F.sum("evidence_score").cast("long").alias("score"))


def freshness_bands(spark, sf_dir):
    rows = facts(spark, sf_dir).withColumn("band", market.freshness(F.col("sold_at"), AS_OF))
    return rows.groupBy("band").agg(F.count("*").alias("n"), F.min("sold_at").cast("date").alias("first_day"))


def grade_bands(spark, sf_dir):
    return facts(spark, sf_dir).groupBy("grade").agg(F.count("*").alias("n")).withColumn("band", market.grade_band(F.col("grade")))


def dedupe_sales(spark, sf_dir):
    rows = market.evidence(priced(spark, sf_dir))
    rows = rows.withColumn("price_step", F.floor(F.col("price") / 20000))
    key = text.key_of(F.date_format("sold_at", "yyyy-MM-dd"), F.col("house"), F.col("nominal"), F.col("basis"), F.col("price_step"))
    out = market.dedupe(rows, key, [F.desc("evidence_score"), F.col("source_url").isNull(), F.col("fact_id")])
    return out.where("copies > 1").select("fact_id", "copies", "kept", "duplicate_of")


def source_conflicts(spark, sf_dir):
    rows = priced(spark, sf_dir).withColumn("day", F.to_date("sold_at"))
    return market.conflicts(rows, "house", "day", "nominal")


def iqr_outliers(spark, sf_dir):
    return market.iqr_outliers(priced(spark, sf_dir), "item_id").where("outlier").select("fact_id", "item_id", "price")


def _rates(spark):
    """A rate every fourth day of each currency, so that some sales have one, some a near one, some none."""
    days = spark.range(0, 640).select(F.date_add(F.lit("1995-01-01").cast("date"), (F.col("id") * 4).cast("int")).alias("rate_day"), "id")
    rates = days.select("rate_day", F.explode(F.array(*(F.struct(F.lit(c).alias("currency"), F.lit(r).alias("base")) for c, r in (("EUR", 4.0), ("USD", 3.5), ("GBP", 5.0))))).alias("r"), "id")
    return rates.select("r.currency", "rate_day", (F.col("r.base") + (F.col("id") % 10) / 10.0).alias("rate"))


def fx_normalise(spark, sf_dir):
    rates = _rates(spark)
    out = market.converted(priced(spark, sf_dir).select("fact_id", "sold_at", "currency", "price"), rates, "PLN", most_days=1)
    return out.groupBy("currency").agg(F.count("*").alias("n"), F.round(F.sum("price_to"), 0).alias("total"))


def liquidity(spark, sf_dir):
    return market.liquidity(facts(spark, sf_dir), AS_OF, "item_id")


def trend(spark, sf_dir):
    return market.trend(priced(spark, sf_dir), AS_OF, "item_id")


def comparable_match(spark, sf_dir):
    rows = priced(spark, sf_dir).withColumn("band", market.grade_band(F.col("grade")))
    return match.comparables(banded_coins(spark, sf_dir), rows, columns=("fact_id",)).select("coin_id", "fact_id", "similarity", "quality")


def valuation_tiers(spark, sf_dir):
    out = valuation(banded_coins(spark, sf_dir), facts(spark, sf_dir), as_of=AS_OF, currency="PLN", years=10)
    return out.withColumn("price_range", price_range("PLN"))


def valuation_gated(spark, sf_dir):
    return valuation(banded_coins(spark, sf_dir), facts(spark, sf_dir), as_of=AS_OF, currency="PLN", years=10, gated=True)


def valuation_unique(spark, sf_dir):
    """Every sale once: the facts are given twice, the second time without a link."""
    every = facts(spark, sf_dir)
    mirror = every.where("lot_key % 3 = 0").withColumns({"fact_id": F.concat("fact_id", F.lit("-m")), "source_url": F.lit(None).cast("string")})
    return valuation_once(banded_coins(spark, sf_dir), every.unionByName(mirror), AS_OF, "PLN")


def valuation_undisputed(spark, sf_dir):
    """Some facts are given twice, the second time with another price; such sales are left out of the statistics."""
    every = facts(spark, sf_dir)
    more = {c: F.col(c) + 1 for c in ("hammer_price", "realized_price", "total_price")}
    mirror = every.where("lot_key % 4 = 0").withColumns({"fact_id": F.concat("fact_id", F.lit("-m")), **more})
    return valuation_agreed(banded_coins(spark, sf_dir), every.unionByName(mirror), AS_OF, "PLN")


def valuation_fx(spark, sf_dir):
    """Prices of all currencies at the rate within three days of the sale; rows without one are left out."""
    sales = market.converted(market.price_basis(facts(spark, sf_dir)), _rates(spark), "PLN")
    return valuation(banded_coins(spark, sf_dir), sales, AS_OF, None, value="price_to")


def target_alerts(spark, sf_dir):
    targets = coins(spark, sf_dir).select(F.col("coin_id").alias("target_id"), "ruler", "nominal", "year", F.lit(None).cast("string").alias("mint"), "variant")
    return match.alerts(targets, facts(spark, sf_dir)).select("target_id", "fact_id", "confidence", "strong")


def type_suggest_topk(spark, sf_dir):
    """The first coin of each nominal is a registered type."""
    firsts = coins(spark, sf_dir).groupBy("nominal").agg(F.min("coin_id").alias("coin_id")).select("coin_id")
    types = coins(spark, sf_dir).join(firsts, "coin_id", "left_semi").select(F.col("coin_id").alias("type_id"), "year", "ruler", "nominal", "mint")
    return match.suggest_types(coins(spark, sf_dir), types, 8)


def same_variant(spark, sf_dir):
    key = text.key_of(*(text.fold(F.col(c).cast("string")) for c in ("ruler", "nominal", "variant")))
    return coins(spark, sf_dir).groupBy(key.alias("identity")).agg(F.count("*").alias("n"), F.min("coin_id").alias("first_coin"))


def fee_rule_asof(spark, sf_dir):
    out = cost.with_fee_rule(facts(spark, sf_dir).select("fact_id", "house", "sold_at"), fee_rules(spark, sf_dir))
    return out.groupBy("rule_checked_at", "premium_pct").agg(F.count("*").alias("n"))


def buyer_cost(spark, sf_dir):
    rows = facts(spark, sf_dir).where("hammer_price IS NOT NULL").select("fact_id", "house", "sold_at", "hammer_price")
    out = cost.cost_for_house(rows, fee_rules(spark, sf_dir))
    return out.select("fact_id", "complete", *(F.round(c, 6).alias(c) for c in ("premium", "vat", "total")))


def seller_net(spark, sf_dir):
    net = cost.seller_net(F.col("hammer_price"), 12.0, 23.0, 3.0)
    return facts(spark, sf_dir).where("hammer_price IS NOT NULL").groupBy("source").agg(F.round(F.sum(net), 0).alias("net"), F.count("*").alias("n"))


def purchasing_power(spark, sf_dir):
    factor = 1 + (2001 - F.year("sold_at")) * 0.08
    value = cost.purchasing_power(F.col("amount"), factor, F.col("source_url"), F.col("sold_at"))
    rows = facts(spark, sf_dir).withColumns({"now": value, "sale_year": F.year("sold_at").cast("long")})
    return rows.groupBy("sale_year").agg(F.count("now").alias("n"), F.round(F.sum("now"), 0).alias("today"))


def era_range_join(spark, sf_dir):
    eras = spark.createDataFrame([(n, i, a, b) for i, (n, a, b) in enumerate(ERAS)], "era string, place int, from_year int, to_year int")
    rows = coins(spark, sf_dir).select("coin_id", (F.col("year") - 1500 + F.col("coin_id") % 600 + 1400).cast("int").alias("year"))
    found = match.in_range(rows, eras, "year", "era")
    return found.groupBy("coin_id", "year").agg(F.count("era").alias("n_eras"), F.min_by("era", "place").alias("first_era"))


def collection_search(spark, sf_dir):
    return collection.search(coins(spark, sf_dir), "brand#1", grade="VF").select("coin_id", "title", "grade")


def collection_facets(spark, sf_dir):
    return collection.facets(coins(spark, sf_dir), "ruler", "nominal", "grade", "mint")


def collection_sort(spark, sf_dir):
    """The first page, of 60 coins, in the collection's order."""
    order = [F.col("year").desc_nulls_last(), text.fold_l(F.col("nominal")), text.fold_l(F.col("title")), F.col("coin_id")]
    page = coins(spark, sf_dir).orderBy(*order).limit(60)
    return page.select("coin_id", F.row_number().over(Window.orderBy(*order)).cast("long").alias("place"))


def collection_value_by_currency(spark, sf_dir):
    return collection.value_by_currency(coins(spark, sf_dir).withColumn("value", collection.display_value()))


def roi_summary(spark, sf_dir):
    rows = coins(spark, sf_dir).withColumn("value", collection.display_value())
    both = rows.where("value > 0 AND purchase_price > 0").groupBy("purchase_currency").agg(F.sum("value").alias("v"), F.sum("purchase_price").alias("p"), F.count("*").alias("n"))
    return both.select("purchase_currency", "n", collection.roi(F.col("v"), F.col("p")).alias("roi_pct"))


def value_breakdown(spark, sf_dir):
    return collection.breakdown(coins(spark, sf_dir).withColumn("value", collection.display_value()), "ruler", "mint", "nominal")


def export_view(spark, sf_dir):
    return collection.export_view(coins(spark, sf_dir)).select("coin_id", "catalog_ref", F.round("market_median", 2).alias("market_median"), F.round("estimated_value", 2).alias("estimated_value"))


def friend_view(spark, sf_dir):
    return collection.view(coins(spark, sf_dir), collection.FRIEND_VIEW)


def album_rollup(spark, sf_dir):
    rows = coins(spark, sf_dir).withColumn("albums", F.array_distinct(F.array(F.col("coin_id") % 7, F.col("coin_id") % 3)))
    return collection.album_counts(rows)


def knowledge_consensus(spark, sf_dir):
    return knowledge.consensus(observations(spark, sf_dir), "ruler", "nominal")


def knowledge_audit(spark, sf_dir):
    return knowledge.audit(observations(spark, sf_dir), ("ruler", "nominal"), ("variant", "rarity"))


def trust_levels(spark, sf_dir):
    rows = observations(spark, sf_dir).groupBy("ruler", "nominal", "variant").agg(F.bool_or("expert").alias("expert"), F.count_distinct("source").alias("sources"), F.bool_or(F.col("origin") == "user").alias("corrected"))
    level = knowledge.trust_level(F.col("expert"), F.col("sources"), F.col("corrected"))
    out = rows.withColumn("level", level).withColumn("trust_rank", knowledge.trust_rank(F.col("level")))
    return out.groupBy("level", "trust_rank").agg(F.count("*").alias("n"))


def _licences(spark):
    return spark.createDataFrame(LICENCES, "source string, ingest string")


def licence_gate(spark, sf_dir):
    rows = observations(spark, sf_dir).withColumn("rights", F.when(F.col("observation_id") % 2 == 0, "open"))
    return knowledge.allowed(rows, _licences(spark)).groupBy("source", "ingest").agg(F.count("*").alias("n"))


def promotion(spark, sf_dir):
    rows = observations(spark, sf_dir).withColumn("is_allowed", ~F.col("source").isin("src4", "src5"))
    known = observations(spark, sf_dir).where("observation_id % 50 = 0").select("ruler", "nominal").distinct()
    return knowledge.promoted(rows, known, "ruler", "nominal")


def source_band(spark, sf_dir):
    return knowledge.source_band(observations(spark, sf_dir).withColumn("score", F.col("observation_id") % 12), "score", "ruler", "nominal", "variant")


def hard_negatives(spark, sf_dir):
    rows = coins(spark, sf_dir).where("accepted AND raw_nominal <> nominal").select(F.col("raw_nominal").alias("wrong"), F.col("nominal").alias("right"), F.when(F.col("coin_id") % 3 == 0, 70).otherwise(30).alias("trust_rank"), F.col("coin_id").alias("seen_at"))
    out = knowledge.hard_negatives(rows)
    return out.select("wrong", "right", "n", "trust_rank", "last_seen", knowledge.learned_boost(F.col("n"), F.col("trust_rank")).alias("boost"), knowledge.learned_penalty(F.col("n")).alias("penalty"))


#: Components of a vector as features: the first ones by name.
PRINT_FEATURES = [*fingerprint.WEIGHTS, *(f"component{k}" for k in range(len(fingerprint.WEIGHTS) + 1, 65))]


def _prints(spark, sf_dir):
    """All components of each vector as features; its label is the identity."""
    names = F.array(*map(F.lit, PRINT_FEATURES))
    rows = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("print_id"), F.col("label").cast("long").alias("identity"), F.posexplode("embedding").alias("k", "v"))
    return rows.select("print_id", "identity", F.get(names, F.col("k")).alias("feature"), F.round(F.col("v").cast("double") * 20, 0).alias("value"), (60.0 + F.col("print_id") % 41).alias("confidence"))


def fingerprint_similarity(spark, sf_dir):
    prints = _prints(spark, sf_dir)
    return fingerprint.compare(prints, prints, ["identity"], PRINT_FEATURES)


def fingerprint_topk(spark, sf_dir):
    prints = _prints(spark, sf_dir)
    return fingerprint.nearest(prints, prints, ["identity"], PRINT_FEATURES, k=3).select("a_print_id", "b_print_id", "rank")


def master_fingerprint(spark, sf_dir):
    return fingerprint.masters(_prints(spark, sf_dir), "identity")


def changed_fields(spark, sf_dir):
    pairs = {c: (F.col(c), F.col(f"raw_{c}")) for c in lifecycle.IDENTITY}
    rows = coins(spark, sf_dir).withColumn("changed", F.array_join(lifecycle.changed_fields(F.col("accepted"), pairs), ","))
    return rows.groupBy("changed").agg(F.count("*").alias("n"))


def invalidate_derived(spark, sf_dir):
    pairs = {c: (F.col(c), F.col(f"raw_{c}")) for c in lifecycle.IDENTITY}
    rows = coins(spark, sf_dir).withColumn("changed", lifecycle.changed_fields(F.col("accepted"), pairs))
    out = lifecycle.invalidate(rows, ("market_median", "estimated_value", "catalog_ref"))
    return out.groupBy("stale", "needs_reanalysis").agg(F.count("*").alias("n"), F.count("market_median").alias("n_median"), F.count("catalog_ref").alias("n_ref"))


def reanalysis_status(spark, sf_dir):
    rows = coins(spark, sf_dir)
    now = lifecycle.identity_key(F.col("nominal"), F.col("variant"))
    was = lifecycle.identity_key(F.col("raw_nominal"), F.col("raw_variant"))
    status = lifecycle.resolution(now, F.when(F.col("coin_id") % 5 != 0, was), F.when(F.col("coin_id") % 7 != 0, now))
    return rows.groupBy(status.alias("status")).agg(F.count("*").alias("n"))


def upsert_latest(spark, sf_dir):
    order = [F.col("l_shipdate"), F.col("l_extendedprice"), F.col("l_partkey"), F.col("l_suppkey")]
    out = ingest.upsert_latest(read(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], order)
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")


def cascade_delete(spark, sf_dir):
    gone = read(spark, sf_dir, "orders").where("o_orderkey % 10 = 3").select("o_orderkey")
    orders, lines = ingest.cascade_delete(read(spark, sf_dir, "orders"), read(spark, sf_dir, "lineitem"), gone, "o_orderkey", "l_orderkey")
    count = lambda df, name: df.agg(F.lit(name).alias("rows_of"), F.count("*").alias("n"))
    return count(orders, "orders").unionByName(count(lines, "lineitem"))


def insert_absent(spark, sf_dir):
    rows = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    out = ingest.insert_absent(rows.where("c_custkey % 2 = 0"), rows.withColumn("c_nationkey", F.lit(99)), ["c_custkey"])
    return out.groupBy("c_nationkey").agg(F.count("*").alias("n"))


def html_extract(spark, sf_dir):
    plain = extract.plain_text(F.col("html"))
    title = F.regexp_extract("html", r"(?is)<title>(.*?)</title>", 1)
    return read(spark, sf_dir, "pages").select("page_id", title.alias("title"), F.length(plain).cast("long").alias("n_chars"), (F.instr(plain, "<") == 0).alias("no_tags"))


def running_cap(spark, sf_dir):
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    out = ingest.running_cap(rows, "conv_id", ["turn"], F.length("text"), 1000)
    return out.select("conv_id", "turn", F.col("running").cast("long").alias("running"))


def history_topn(spark, sf_dir):
    return ingest.history(read(spark, sf_dir, "events").select("event_id", "ts", "event_type"), 200)


def latency_p50_p90(spark, sf_dir):
    rows = read(spark, sf_dir, "events")
    return ingest.nearest_rank(rows, "event_type", [F.desc("ts"), F.desc("event_id")], "value", 60, {"p50": 0.5, "p90": 0.9})


def text_fold(spark, sf_dir):
    whole = F.col("text")
    return read(spark, sf_dir, "documents").select("doc_id", text.fold_l(whole).alias("folded"), text.comparable(whole).alias("comparable"))


def sentinel_canonical(spark, sf_dir):
    return coins(spark, sf_dir).groupBy(text.known(F.col("mint")).alias("mint")).agg(F.count("*").alias("n"))


def job_dedupe_stream(spark, sf_dir):
    """The events as a stream in which a user's type of event is a job; run over what is there."""
    schema = read(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*").select("user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    folder = folder or "file:///tmp/checkpoints/tessera"
    return jobs.run_available(jobs.first_of_job(stream, ["user_id", "event_type"]), f"{folder}/jobs-{uuid.uuid4().hex}")


NAMES = (
    price_basis, fact_validity, archive_search, market_stats_by_type, dominant_basis, evidence_quality, freshness_bands, grade_bands, dedupe_sales,
    source_conflicts, iqr_outliers, fx_normalise, liquidity, trend, comparable_match, valuation_tiers, valuation_gated, valuation_unique,
    valuation_undisputed, valuation_fx, target_alerts, type_suggest_topk, same_variant,
    fee_rule_asof, buyer_cost, seller_net, purchasing_power, era_range_join, collection_search, collection_facets, collection_sort,
    collection_value_by_currency, roi_summary, value_breakdown, export_view, friend_view, album_rollup, knowledge_consensus, knowledge_audit,
    trust_levels, licence_gate, promotion, source_band, hard_negatives, fingerprint_similarity, fingerprint_topk, master_fingerprint, changed_fields,
    invalidate_derived, reanalysis_status, upsert_latest, cascade_delete, insert_absent, html_extract, running_cap, history_topn, latency_p50_p90,
    text_fold, sentinel_canonical, job_dedupe_stream,
)
QUERIES = {**{f.__name__: f for f in NAMES}, **records.QUERIES, **intake.QUERIES, **streams.QUERIES, **upkeep.QUERIES, **prints.QUERIES, **stores.QUERIES}
