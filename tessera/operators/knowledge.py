"""Sourced knowledge: consensus, contradictions, trust, promotion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import round_half_up

# Rank of each trust level; learning from 30, promotion from 70.
TRUST = (("multi_source_verified", 90), ("expert_verified", 70), ("user_corrected", 30), ("ai_suggestion", 10))


def consensus(rows: DataFrame, *identity: str) -> DataFrame:
    """Rows and distinct sources of each identity; strong with two sources or an expert."""
    out = rows.groupBy(*identity).agg(F.count("*").alias("n"), F.count_distinct("source").alias("n_sources"), F.bool_or("expert").alias("expert"))
    return out.withColumn("strong", (F.col("n_sources") >= 2) | F.col("expert"))


def audit(rows: DataFrame, identity: tuple[str, ...], facts: tuple[str, ...]) -> DataFrame:
    """Identities for which a fact is told in more than one way."""
    out = rows.groupBy(*identity).agg(F.count("*").alias("n"), *(F.count_distinct(c).alias(f"n_{c}") for c in facts))
    clashes = sum(((F.col(f"n_{c}") > 1).cast("int") for c in facts), F.lit(0))
    return out.withColumn("conflicts", clashes).where("conflicts > 0")


def trust_level(expert: Column, sources: Column, corrected: Column) -> Column:
    level = F.when(expert & (sources >= 2), "multi_source_verified").when(expert, "expert_verified")
    return level.when(corrected, "user_corrected").otherwise("ai_suggestion")


def trust_rank(level: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for pair in TRUST for x in pair)), level)


def allowed(rows: DataFrame, licences: DataFrame) -> DataFrame:
    """Rows whose source may be ingested: ALLOW, or ALLOW_WITH_RIGHTS with a rights statement."""
    ok = (F.col("ingest") == "ALLOW") | ((F.col("ingest") == "ALLOW_WITH_RIGHTS") & (F.trim(F.coalesce("rights", F.lit(""))) != ""))
    return rows.join(licences, "source").where(ok)


def promoted(rows: DataFrame, known: DataFrame, *identity: str) -> DataFrame:
    """Strong identities, all of whose rows are allowed, and which are not known yet."""
    out = rows.groupBy(*identity).agg(F.count_distinct("source").alias("n_sources"), F.bool_or("expert").alias("expert"), F.bool_and("is_allowed").alias("all_allowed"))
    out = out.where("all_allowed AND (n_sources >= 2 OR expert)").drop("all_allowed")
    on = None
    for c in identity:
        same = out[c].eqNullSafe(known[c])
        on = same if on is None else on & same
    return out.join(known, on, "left_anti")


def source_band(rows: DataFrame, score: str, *identity: str) -> DataFrame:
    """strong from 3 sources and 18 points (8 a row at most), supported from 2 and 10, else single-source."""
    out = rows.groupBy(*identity).agg(F.count("*").alias("n"), F.count_distinct("source").alias("n_sources"), F.sum(F.least(F.lit(8), F.col(score))).alias("points"))
    band = F.when((F.col("n_sources") >= 3) & (F.col("points") >= 18), "strong").when((F.col("n_sources") >= 2) & (F.col("points") >= 10), "supported")
    return out.withColumn("band", band.when(F.col("n") > 0, "single-source").otherwise("none"))


def hard_negatives(corrections: DataFrame) -> DataFrame:
    """How often each wrong identity was corrected to each right one, the best trust, the last day."""
    return corrections.groupBy("wrong", "right").agg(F.count("*").alias("n"), F.max("trust_rank").alias("trust_rank"), F.max("seen_at").alias("last_seen"))


def learned_boost(count: Column, rank: Column) -> Column:
    """Points a correction adds: by how often it was seen and by trust, 24 at most."""
    base = F.when(rank >= 90, 12).when(rank >= 70, 9).otherwise(4)
    factor = F.when(rank >= 90, 1.0).when(rank >= 70, 0.85).otherwise(0.45)
    return F.least(F.lit(24), round_half_up((F.least(F.lit(12), 4 + 2 * count) + base) * factor)).cast("int")


def learned_penalty(count: Column) -> Column:
    return F.least(F.lit(30), 8 + 4 * count).cast("int")


def clean_text(text: Column, longest: int) -> Column:
    """Blanks collapsed, cut to so many characters; null is empty."""
    return F.substring(F.regexp_replace(F.trim(F.coalesce(text.cast("string"), F.lit(""))), r"\s+", " "), 1, longest)


def normalised(rows: DataFrame) -> DataFrame:
    """Knowledge rows with texts cut (fixed values: 120 characters, links 500), the year as a number where it begins with one, the price with a decimal point."""
    cut = {c: clean_text(F.col(c), 500 if c == "source_url" else 120) for c in ("ruler", "nominal", "variant", "catalog_ref", "source_url") if c in rows.columns}
    year = clean_text(F.col("year"), 120)
    price = F.replace(F.col("sale_price").cast("string"), F.lit(","), F.lit(".")).try_cast("double")
    return rows.withColumns({**cut, "source": F.upper("source"), "year": F.coalesce(F.nullif(F.regexp_extract(year, r"^[+-]?\d+", 0).try_cast("long"), F.lit(0)).cast("string"), year), "sale_price": F.when(price != 0, price)})


def valid(rows: DataFrame) -> DataFrame:
    """Rows with a link, someone who issued the coin, and a year, nominal, variant or reference."""
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) != ""
    return rows.where(filled("source_url") & filled("ruler") & (filled("year") | filled("nominal") | filled("variant") | filled("catalog_ref")))


def evidence_list(ai: Column, user: Column, expert: Column, provenance: Column, sources: Column) -> Column:
    """Kinds and sources that speak for a row: AI result, user correction, expert, provenance in order, then sources not named yet."""
    entry = lambda kind, source: F.struct(F.lit(kind).alias("kind"), source.cast("string").alias("source"))
    none = F.lit(None)
    own = F.array_compact(F.array(F.when(ai, entry("ai_result", none)), F.when(user, entry("user_correction", none)), F.when(expert, entry("expert_verification", none))))
    more = F.array_distinct(F.array_except(sources, provenance))
    return F.concat(own, F.transform(provenance, lambda s: entry("source", s)), F.transform(more, lambda s: entry("source", s)))


def verified(rows: DataFrame, sources: DataFrame, *by: str, rights: str | None = None) -> DataFrame:
    """Identities of which every source may be used; one allowed with rights needs the row's rights statement.

    rights names the column of that statement; without it no row has any.
    """
    stated = F.coalesce(F.trim(F.col(rights).cast("string")), F.lit("")) != "" if rights else F.lit(False)
    allowed = (F.col("ingest") == "ALLOW") | ((F.col("ingest") == "ALLOW_WITH_RIGHTS") & stated)
    known = rows.join(sources.select("source", "ingest"), "source", "left").withColumn("_ok", allowed)
    return known.groupBy(*by).agg(F.count("*").alias("n"), F.bool_and(F.coalesce("_ok", F.lit(False))).alias("_all")).where("_all").drop("_all")


def ingested(rows: DataFrame, tiers: DataFrame, order: list[Column]) -> DataFrame:
    """Rows of known sources that are not red, once for each source and its id (or link): the latest, under the first one's id."""
    known = rows.join(tiers.where("NOT startswith(tier, 'RED')").select("source"), "source")
    key = ["source", "_key"]
    keyed = known.withColumn("_key", F.coalesce(F.nullif(F.col("source_id"), F.lit("")), F.col("source_url")))
    best = Window.partitionBy(*key)
    ranked = keyed.withColumns({"_last": F.row_number().over(best.orderBy(*(c.desc() for c in order))), "_first": F.first("record_id").over(best.orderBy(*(c.asc() for c in order)))})
    return ranked.where("_last = 1").withColumn("record_id", F.col("_first")).drop("_key", "_last", "_first")


def registered_types(rows: DataFrame) -> DataFrame:
    """Verified rows as types: one for each type_id, the first by record_id; the year is the first four digits in a row."""
    year = F.nullif(F.regexp_extract(F.coalesce(F.col("year").cast("string"), F.lit("")), r"[0-9]{4}", 0), F.lit("")).cast("int")
    kept = rows.where(F.col("status") == "verified").withColumns({"type_id": F.coalesce(F.nullif(F.col("type_id"), F.lit("")), F.concat(F.lit("verified_"), F.col("record_id").cast("string"))), "year": F.nullif(year, F.lit(0))})
    rest = [c for c in kept.columns if c not in ("type_id", "status")]
    return kept.groupBy("type_id").agg(F.min_by(F.struct(*rest), "record_id").alias("_first")).select("type_id", "_first.*")


def exported_facts(rows: DataFrame, sources: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """record_id and a JSON document of each row: its fields that have a value, and where it comes from.

    sources: source, mode, license; a source that is not listed has neither.
    """
    known = rows.join(sources.select("source", "mode", "license"), "source", "left")
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    provenance = F.struct("source", F.col("source_url").alias("url"), "checked_at", "expert", empty("rights").alias("rights"), empty("mode").alias("mode"), empty("license").alias("license"))
    # to_json leaves nulls out
    return known.select("record_id", F.to_json(F.struct(*(F.nullif(F.col(c).cast("string"), F.lit("")).alias(c) for c in fields), provenance.alias("provenance"))).alias("json"))
