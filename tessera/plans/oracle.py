"""The queries of queries.py in SQL, over the tables as views."""

from __future__ import annotations

from tessera.functions.text import MARKED, PLAIN
from tessera.plans import intake_sql, prints, records, records_sql, stores, streams, upkeep

FACTS = """facts AS (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, strftime(l_shipdate, '%Y%m%d'), CAST(round(l_extendedprice * 100) AS BIGINT)) AS fact_id,
 l_orderkey AS lot_key, l_partkey AS item_id, 'S' || (l_suppkey % 6) AS source, CASE WHEN l_orderkey % 5 <> 0 THEN 'https://lots.example/' || l_orderkey END AS source_url,
 s_name AS house, l_shipdate AS sold_at, CASE WHEN l_returnflag = 'A' THEN l_extendedprice END AS hammer_price, CASE WHEN l_returnflag = 'N' THEN l_extendedprice END AS realized_price,
 CASE WHEN l_returnflag = 'R' THEN l_extendedprice END AS total_price, l_extendedprice AS amount,
 CASE n_regionkey WHEN 0 THEN 'PLN' WHEN 1 THEN 'EUR' WHEN 2 THEN 'USD' WHEN 3 THEN 'GBP' ELSE 'CHF' END AS currency,
 CASE WHEN l_partkey % 7 <> 0 THEN p_brand END AS ruler, p_type AS nominal, 1500 + p_size AS year, n_name AS mint,
 CASE WHEN l_orderkey % 3 <> 0 THEN 'v' || (l_linenumber % 3) END AS variant,
 CASE l_linenumber % 6 WHEN 0 THEN 'AU 58' WHEN 1 THEN 'XF' WHEN 2 THEN 'Very Fine' WHEN 3 THEN 'F' WHEN 5 THEN 'II' END AS grade,
 CASE WHEN l_partkey % 4 = 0 THEN 'K' || (l_partkey % 50) END AS catalog_ref, p_name AS title
 FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey)"""
PRICED = FACTS + """, priced AS (SELECT *, CASE WHEN hammer_price > 0 THEN 'hammer' WHEN realized_price > 0 THEN 'realized' WHEN total_price > 0 THEN 'total' ELSE 'unknown' END AS basis,
 CASE WHEN hammer_price > 0 THEN hammer_price WHEN realized_price > 0 THEN realized_price WHEN total_price > 0 THEN total_price END AS price,
 (epoch_ms(TIMESTAMP '2001-11-05') - epoch_ms(CAST(sold_at AS TIMESTAMP))) / 86400000.0 AS age,
 CASE WHEN grade = 'AU 58' THEN 4 WHEN grade = 'XF' THEN 3 WHEN grade = 'Very Fine' THEN 2 WHEN grade = 'F' THEN 1 END AS band FROM facts)"""
COINS = """coins AS (SELECT p_partkey AS coin_id, p_name AS title, CASE WHEN p_partkey % 7 <> 0 THEN p_brand END AS ruler, p_type AS nominal, 1500 + p_size AS year,
 CASE WHEN p_partkey % 6 = 0 THEN 'unknown' ELSE 'Mint ' || (p_partkey % 9) END AS mint, 'v' || (p_partkey % 3) AS variant,
 CASE p_partkey % 5 WHEN 0 THEN 'AU' WHEN 1 THEN 'XF 45' WHEN 2 THEN 'VF' WHEN 3 THEN 'fine' END AS grade,
 CASE p_partkey % 5 WHEN 0 THEN 4 WHEN 1 THEN 3 WHEN 2 THEN 2 WHEN 3 THEN 1 END AS band,
 CASE WHEN p_partkey % 4 = 0 THEN 'K' || (p_partkey % 50) END AS catalog_ref, p_retailprice AS purchase_price, CASE WHEN p_partkey % 10 < 8 THEN 'PLN' ELSE 'EUR' END AS purchase_currency,
 CASE WHEN p_partkey % 3 = 0 THEN p_retailprice * 1.5 END AS market_median, CASE WHEN p_partkey % 4 = 1 THEN p_retailprice * 1.2 END AS estimated_value,
 CASE WHEN p_partkey % 8 = 2 THEN p_retailprice * 0.8 END AS estimate_low, CASE WHEN p_partkey % 8 = 2 THEN p_retailprice * 1.4 END AS estimate_high,
 p_partkey % 13 = 0 AS stale, p_partkey % 5 = 0 AS accepted, CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE p_type || ' x' END AS raw_nominal, p_brand AS raw_ruler, 'v' || (p_partkey % 4) AS raw_variant FROM part),
 valued AS (SELECT *, CASE WHEN stale THEN 0.0 ELSE coalesce(CASE WHEN market_median > 0 THEN market_median END, CASE WHEN estimated_value > 0 THEN estimated_value END, (estimate_low + estimate_high) / 2, 0.0) END AS value FROM coins)"""
OBS = """obs AS (SELECT doc_id AS observation_id, source, lang AS ruler, CAST(n_chars % 40 AS VARCHAR) AS nominal, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE CAST(n_chars % 3 AS VARCHAR) END AS variant,
 CASE WHEN n_chars % 5 = 0 THEN 'R' WHEN n_chars % 5 = 1 THEN 'R2' END AS rarity, coalesce(q = 1, false) AS expert, CASE WHEN doc_id % 4 = 0 THEN 'user' WHEN doc_id % 4 = 1 THEN 'ai' ELSE 'catalogue' END AS origin
 FROM documents LEFT JOIN (SELECT doc_id AS d, max(quality) AS q FROM labels GROUP BY 1) ON doc_id = d)"""
RULES = """rules AS (SELECT s_name AS house, DATE '1995-01-01' AS f, DATE '1998-12-31' AS t, DATE '1995-02-01' AS c, 15.0 + s_suppkey % 5 AS pct, 0.0 AS fixed FROM supplier WHERE right(s_name, 1) <> '7'
 UNION ALL SELECT s_name, DATE '1998-06-01', NULL, DATE '1998-06-02', 18.0 + s_suppkey % 5, 5.0 FROM supplier WHERE right(s_name, 1) <> '7'),
 ruled AS (SELECT * FROM (SELECT s.*, c, CAST(pct AS DOUBLE) AS pct, fixed, row_number() OVER (PARTITION BY fact_id ORDER BY c DESC NULLS LAST) AS n FROM facts s
 LEFT JOIN rules r ON s.house = r.house AND f <= CAST(sold_at AS DATE) AND (t IS NULL OR t >= CAST(sold_at AS DATE))) WHERE n = 1)"""
EVIDENCE = """ev AS (SELECT *, 10 + CASE WHEN source_url IS NOT NULL THEN 20 ELSE 0 END + 15 + 10 + 20 + CASE WHEN ruler IS NOT NULL THEN 15 ELSE 0 END
 + CASE WHEN variant IS NOT NULL OR catalog_ref IS NOT NULL THEN 7 ELSE 0 END + CASE WHEN grade IS NOT NULL THEN 3 ELSE 0 END AS score FROM priced)"""
HALF = "CAST(floor({} + 0.5) AS BIGINT)"
STRIP = f"translate(lower({{}}), '{MARKED}', '{PLAIN}')"


def stats(column: str = "price") -> str:
    return ", ".join(f"{HALF.format(f'quantile_cont({column}, {p})')} AS {n}" for n, p in (("low", 0.1), ("q1", 0.25), ("median", 0.5), ("q3", 0.75), ("high", 0.9)))


PAIRS = """pairs AS (SELECT c.coin_id, c.band IS NOT NULL AS banded, f.*, abs(c.band - f.band) AS dist,
 greatest(0, 25 + CASE WHEN c.ruler = f.ruler THEN 25 ELSE 0 END + CASE WHEN c.year = f.year THEN 20 ELSE -8 END + CASE WHEN c.mint = 'unknown' THEN 0 WHEN c.mint = f.mint THEN 15 ELSE -8 END
 + CASE WHEN c.variant = f.variant THEN 20 ELSE 0 END + CASE WHEN c.catalog_ref = f.catalog_ref THEN 25 ELSE 0 END
 + CASE WHEN abs(c.band - f.band) = 0 THEN 8 WHEN abs(c.band - f.band) >= 2 THEN -15 ELSE 0 END) AS similarity,
 CASE WHEN c.catalog_ref IS NOT NULL THEN coalesce(c.catalog_ref = f.catalog_ref, false) ELSE c.variant IS NULL OR coalesce(c.variant = f.variant, false) END AS specific
 FROM coins c JOIN priced f ON c.nominal = f.nominal AND coalesce(c.ruler = f.ruler, true) AND coalesce(c.variant = f.variant, true) AND coalesce(c.catalog_ref = f.catalog_ref, true)),
 scored AS (SELECT *, CASE WHEN similarity >= 85 THEN CASE WHEN NOT specific OR coalesce(dist >= 2, false) THEN 'good' ELSE 'strict' END WHEN similarity >= 70 THEN 'good' ELSE 'indicative' END AS quality FROM pairs WHERE similarity >= 55)"""



def appraised_sql(base: str, value: str = "price", facts: str | None = None, more: str | None = None, extra: str = "") -> str:
    """Valuation of every coin from the rows of base; facts replaces the facts, more adds tables."""
    head = PRICED.replace("FROM facts)", f"FROM ({facts}))") if facts else PRICED
    last = ", ".join(f"coalesce({HALF.format(f'quantile_cont(v, {p})')}, 0) AS {n}" for n, p in (("low", 0.1), ("q1", 0.25), ("median", 0.5), ("q3", 0.75), ("high", 0.9)))
    return f"""WITH {head}, {EVIDENCE}, {COINS}, {PAIRS}{", " + more if more else ""}, base AS ({base}),
 a AS (SELECT *, count(*) FILTER (dist = 0) OVER w AS same, count(*) FILTER (coalesce(dist <= 1, true)) OVER w AS near FROM base WINDOW w AS (PARTITION BY coin_id)),
 b AS (SELECT *, CASE WHEN NOT banded THEN true WHEN same >= 3 THEN coalesce(dist = 0, false) ELSE near >= 4 AND coalesce(dist <= 1, true) END AS pool FROM a),
 c AS (SELECT *, count(*) FILTER (pool AND quality = 'strict') OVER w AS s, count(*) FILTER (pool AND quality IN ('strict', 'good')) OVER w AS g FROM b WINDOW w AS (PARTITION BY coin_id)),
 d AS (SELECT *, pool AND CASE WHEN s >= 3 THEN quality = 'strict' ELSE g >= 4 AND quality IN ('strict', 'good') END AS chosen FROM c),
 e AS (SELECT *, CASE WHEN count(*) FILTER (chosen AND basis = 'hammer') OVER w >= 3 THEN 'hammer' WHEN count(*) FILTER (chosen AND basis = 'realized') OVER w >= 3 THEN 'realized' WHEN count(*) FILTER (chosen AND basis = 'total') OVER w >= 3 THEN 'total' END AS main FROM d WINDOW w AS (PARTITION BY coin_id)),
 f AS (SELECT *, CASE WHEN banded AND same < 3 AND near < 4 THEN 'insufficient-condition' WHEN s < 3 AND g < 4 THEN 'insufficient' WHEN main IS NULL THEN 'insufficient-price-basis' ELSE CASE WHEN s >= 3 THEN 'strict' ELSE 'strict+good' END || CASE WHEN banded THEN '-condition' ELSE '' END END AS t, CASE WHEN chosen AND basis = main THEN {value} END AS v FROM e),
 o AS (SELECT coin_id AS i, count(*) AS records, count(*) FILTER (quality = 'strict') AS n_strict, count(*) FILTER (quality = 'good') AS n_good, count(*) FILTER (quality = 'indicative') AS n_indicative, count(v) AS n, min(t) AS tier, min(CASE WHEN t LIKE 'strict%' THEN main END) AS basis, {last} FROM f GROUP BY 1),
 r AS (SELECT c.coin_id, coalesce(records, 0) AS records, coalesce(n_strict, 0) AS n_strict, coalesce(n_good, 0) AS n_good, coalesce(n_indicative, 0) AS n_indicative, coalesce(n, 0) AS n, coalesce(tier, 'none') AS tier, basis, coalesce(low, 0) AS low, coalesce(q1, 0) AS q1, coalesce(median, 0) AS median, coalesce(q3, 0) AS q3, coalesce(high, 0) AS high,
 CASE WHEN records IS NULL THEN 'none' WHEN tier IN ('strict', 'strict-condition') THEN 'strong' WHEN tier LIKE 'strict+good%' THEN 'usable' ELSE 'limited' END AS quality FROM coins c LEFT JOIN o ON c.coin_id = i)
 SELECT *, quality IN ('strong', 'usable') AND n > 0 AS can_estimate{extra} FROM r"""


PRINTS = """feat AS (SELECT unnest(['punctuationPattern', 'dateSpacing', 'datePosition', 'legendStartClock', 'legendEndClock', 'portraitOrientation', 'crownShape', 'shieldPosition', 'mintMarkPosition', 'eagleTail', 'wingPattern', 'featherPattern', 'letterForms', 'digitForms', 'monogramShape', 'edgeFeature'] || list_transform(range(17, 65), lambda k: 'component' || k)) AS feature,
 unnest([1.4, 1.3, 1.0, 0.8, 0.8, 0.7, 1.0, 0.8, 1.2, 1.3, 1.3, 1.4, 1.1, 1.1, 1.0, 0.7] || list_transform(range(17, 65), lambda k: 0.6))::DOUBLE AS w, unnest(range(1, 65)) AS k),
 prints AS (SELECT vec_id AS print_id, CAST(label AS BIGINT) AS identity, feature, w, round(CAST(embedding[k] AS DOUBLE) * 20, 0) + 0.0 AS value, CAST(60 + vec_id % 41 AS DOUBLE) AS confidence FROM embeddings, feat),
 cmp AS (SELECT a.print_id AS a_print_id, b.print_id AS b_print_id, round(sum(s * a.w * sqrt(a.confidence / 100 * b.confidence / 100)) / sum(a.w * sqrt(a.confidence / 100 * b.confidence / 100)) * 100, 4) AS score,
 count(*) AS matched, count(*) FILTER (s < 0.25 AND a.w >= 1) AS conflicts FROM prints a JOIN prints b ON a.identity = b.identity AND a.feature = b.feature AND a.print_id <> b.print_id,
 LATERAL (SELECT greatest(0.0, 1 - abs(a.value - b.value) / greatest(1.0, abs(a.value), abs(b.value))) AS s) GROUP BY 1, 2)"""

CHANGED = """chg AS (SELECT *, concat_ws(',', CASE WHEN accepted AND lower(nominal) <> lower(raw_nominal) THEN 'nominal' END, CASE WHEN accepted AND ruler IS NOT NULL AND lower(ruler) <> lower(raw_ruler) THEN 'ruler' END,
 CASE WHEN accepted AND variant <> raw_variant THEN 'variant' END) AS changed FROM coins)"""

ORACLE_SQL = {
    "price_basis": f"WITH {PRICED} SELECT fact_id, basis, price FROM priced",
    "fact_validity": f"WITH {FACTS} SELECT source, currency, count(*) AS n FROM facts WHERE coalesce(hammer_price, realized_price, total_price, amount) > 0 AND sold_at IS NOT NULL GROUP BY 1, 2",
    "archive_search": f"WITH {PRICED} SELECT fact_id, house, year FROM priced WHERE age <= 3 * 365.25 AND currency = 'EUR' AND regexp_replace(lower(concat_ws(' ', title, ruler, nominal, year, mint, variant, house)), '[^a-z0-9]+', ' ', 'g') LIKE '%brand 2%'",
    "market_stats_by_type": f"WITH {PRICED} SELECT nominal, basis, count(price) AS n, {stats()} FROM priced GROUP BY 1, 2",
    "dominant_basis": f"""WITH {PRICED}, g AS (SELECT item_id, year(sold_at) AS sale_year, count(*) FILTER (basis = 'hammer') AS n_hammer, count(*) FILTER (basis = 'realized') AS n_realized, count(*) FILTER (basis = 'total') AS n_total FROM priced GROUP BY 1, 2)
 SELECT *, CASE WHEN n_hammer >= 3 THEN 'hammer' WHEN n_realized >= 3 THEN 'realized' WHEN n_total >= 3 THEN 'total' END AS dominant FROM g""",
    "evidence_quality": f"""WITH {PRICED}, {EVIDENCE} SELECT CASE WHEN score >= 85 THEN 'strong' WHEN score >= 65 THEN 'usable' WHEN score >= 45 THEN 'limited' ELSE 'weak' END AS evidence_level,
 source_url IS NOT NULL AND ruler IS NOT NULL AS core_complete, count(*) AS n, CAST(sum(score) AS BIGINT) AS score FROM ev GROUP BY 1, 2""",
    "freshness_bands": f"WITH {PRICED} SELECT CASE WHEN floor(age) <= 30 THEN 'fresh' WHEN floor(age) <= 180 THEN 'aging' ELSE 'stale' END AS band, count(*) AS n, CAST(min(sold_at) AS DATE) AS first_day FROM priced GROUP BY 1",
    "grade_bands": f"WITH {PRICED} SELECT grade, count(*) AS n, CASE max(band) WHEN 4 THEN 'AU' WHEN 3 THEN 'XF' WHEN 2 THEN 'VF' WHEN 1 THEN 'F' END AS band FROM priced GROUP BY 1",
    "dedupe_sales": f"""WITH {PRICED}, {EVIDENCE}, r AS (SELECT fact_id, count(*) OVER w AS copies, row_number() OVER o AS n, first_value(fact_id) OVER o AS first FROM ev
 WINDOW w AS (PARTITION BY strftime(sold_at, '%Y-%m-%d'), house, nominal, basis, floor(price / 20000)), o AS (PARTITION BY strftime(sold_at, '%Y-%m-%d'), house, nominal, basis, floor(price / 20000) ORDER BY score DESC, source_url IS NULL, fact_id))
 SELECT fact_id, copies, n = 1 AS kept, CASE WHEN n > 1 THEN first END AS duplicate_of FROM r WHERE copies > 1""",
    "source_conflicts": f"""WITH {PRICED}, g AS (SELECT house, CAST(sold_at AS DATE) AS day, nominal, count(*) AS n, count(DISTINCT hammer_price) AS n_hammer_price, count(DISTINCT realized_price) AS n_realized_price, count(DISTINCT total_price) AS n_total_price,
 count(DISTINCT basis) AS n_basis, count(DISTINCT currency) AS n_currency FROM priced GROUP BY 1, 2, 3) SELECT * FROM g WHERE n > 1 AND (n_hammer_price > 1 OR n_realized_price > 1 OR n_total_price > 1 OR n_basis > 1 OR n_currency > 1)""",
    "iqr_outliers": f"""WITH {PRICED}, q AS (SELECT item_id AS i, count(price) AS n, quantile_cont(price, 0.25) AS q1, quantile_cont(price, 0.75) AS q3 FROM priced GROUP BY 1),
 b AS (SELECT fact_id, item_id, price, n >= 4 AND q3 > q1 AND (price < greatest(0, q1 - (q3 - q1) * 1.5) OR price > q3 + (q3 - q1) * 1.5) AS beyond FROM priced JOIN q ON item_id = i),
 k AS (SELECT *, count(*) FILTER (NOT beyond) OVER (PARTITION BY item_id) AS kept FROM b) SELECT fact_id, item_id, price FROM k WHERE beyond AND kept >= 2""",
    "fx_normalise": f"""WITH {PRICED}, rates AS (SELECT c AS rc, DATE '1995-01-01' + CAST(i * 4 AS INTEGER) AS rate_day, base + (i % 10) / 10.0 AS rate FROM range(0, 640) d(i), (VALUES ('EUR', 4.0), ('USD', 3.5), ('GBP', 5.0)) v(c, base)),
 o AS (SELECT fact_id, currency, price, rate, row_number() OVER (PARTITION BY fact_id ORDER BY abs(rate_day - CAST(sold_at AS DATE)), rate_day) AS n FROM priced JOIN rates ON currency = rc AND abs(rate_day - CAST(sold_at AS DATE)) <= 1),
 a AS (SELECT currency, price * rate AS v FROM o WHERE n = 1 UNION ALL SELECT currency, price FROM priced WHERE currency = 'PLN') SELECT currency, count(*) AS n, round(sum(v), 0) AS total FROM a GROUP BY 1""",
    "liquidity": f"""WITH {PRICED}, g AS (SELECT item_id, count(sold_at) AS n, count(DISTINCT year(sold_at)) AS years, count(*) FILTER (age <= 3 * 365.25) AS recent FROM priced GROUP BY 1)
 SELECT *, floor(n / greatest(years, 1) * 100 + 0.5) / 100 AS per_year, CASE WHEN n >= 12 AND years >= 4 AND recent >= 4 THEN 'high' WHEN n >= 5 AND years >= 3 AND recent >= 2 THEN 'medium' WHEN n > 0 THEN 'low' ELSE 'none' END AS liquidity FROM g""",
    "trend": f"""WITH {PRICED}, g AS (SELECT item_id, count(*) FILTER (age / 365.25 <= 3) AS n_recent, count(*) FILTER (age / 365.25 > 3 AND age / 365.25 <= 10) AS n_older, median(price) FILTER (age / 365.25 <= 3) AS r, median(price) FILTER (age / 365.25 > 3 AND age / 365.25 <= 10) AS o FROM priced GROUP BY 1),
 c AS (SELECT item_id, n_recent, n_older, CASE WHEN n_recent >= 2 AND n_older >= 2 AND o > 0 THEN CAST(floor((r - o) / o * 100 + 0.5) AS BIGINT) END AS change_pct FROM g)
 SELECT *, CASE WHEN change_pct IS NULL THEN 'insufficient' WHEN change_pct >= 15 THEN 'up' WHEN change_pct <= -15 THEN 'down' ELSE 'stable' END AS trend FROM c""",
    "comparable_match": f"WITH {PRICED}, {COINS}, {PAIRS} SELECT coin_id, fact_id, CAST(similarity AS INTEGER) AS similarity, quality FROM scored",
    "valuation_tiers": appraised_sql("SELECT * FROM scored WHERE currency = 'PLN' AND age <= 3652.5 AND price > 0", extra=", CASE WHEN quality IN ('strong', 'usable') AND n > 0 THEN low || '–' || high || ' PLN' END AS price_range"),
    "valuation_gated": appraised_sql(
        "SELECT scored.* FROM scored JOIN (SELECT fact_id AS e FROM ev WHERE score >= 65 AND source_url IS NOT NULL AND ruler IS NOT NULL AND greatest(coalesce(hammer_price, 0), coalesce(realized_price, 0), coalesce(total_price, 0)) > 0) ON fact_id = e WHERE currency = 'PLN' AND age <= 3652.5 AND price > 0"
    ),
    "valuation_unique": appraised_sql(
        "SELECT * EXCLUDE (rn) FROM (SELECT scored.*, row_number() OVER (PARTITION BY coin_id, CAST(sold_at AS DATE), house, ruler, nominal, year, mint, variant, catalog_ref, basis, price ORDER BY score DESC, source_url IS NULL, fact_id) AS rn FROM scored JOIN (SELECT fact_id AS e, score FROM ev) ON fact_id = e WHERE currency = 'PLN' AND age <= 3652.5 AND price > 0) WHERE rn = 1",
        facts="SELECT * FROM facts UNION ALL SELECT * REPLACE (fact_id || '-m' AS fact_id, CAST(NULL AS VARCHAR) AS source_url) FROM facts WHERE lot_key % 3 = 0",
    ),
    "valuation_undisputed": appraised_sql(
        "SELECT *, coalesce(min(hammer_price) OVER w <> max(hammer_price) OVER w, false) OR coalesce(min(realized_price) OVER w <> max(realized_price) OVER w, false) OR coalesce(min(total_price) OVER w <> max(total_price) OVER w, false) OR min(basis) OVER w <> max(basis) OVER w OR min(currency) OVER w <> max(currency) OVER w AS bad FROM scored WHERE currency = 'PLN' AND age <= 3652.5 AND price > 0 WINDOW w AS (PARTITION BY coin_id, CAST(sold_at AS DATE), house, ruler, nominal, year, mint, variant, catalog_ref)",
        facts="SELECT * FROM facts UNION ALL SELECT * REPLACE (fact_id || '-m' AS fact_id, hammer_price + 1 AS hammer_price, realized_price + 1 AS realized_price, total_price + 1 AS total_price) FROM facts WHERE lot_key % 4 = 0",
        value="CASE WHEN NOT bad THEN price END",
    ),
    "valuation_fx": appraised_sql(
        "SELECT scored.*, price * rate AS price_to FROM scored JOIN fx ON fact_id = fx_id WHERE age <= 3652.5 AND price > 0",
        value="price_to",
        more="""rates AS (SELECT currency AS cur, CAST(DATE '1995-01-01' + CAST(id * 4 AS INTEGER) AS DATE) AS d, base + (id % 10) / 10.0::DOUBLE AS rate FROM range(0, 640) t(id), (VALUES ('EUR', 4.0::DOUBLE), ('USD', 3.5::DOUBLE), ('GBP', 5.0::DOUBLE)) v(currency, base)),
 fx AS (SELECT fact_id AS fx_id, arg_min(rate, abs(date_diff('day', CAST(sold_at AS DATE), d)) * 10 + CASE WHEN d > CAST(sold_at AS DATE) THEN 1 ELSE 0 END) AS rate FROM priced JOIN rates ON currency = cur AND abs(date_diff('day', CAST(sold_at AS DATE), d)) <= 3 GROUP BY 1 UNION ALL SELECT fact_id, 1.0 FROM priced WHERE currency = 'PLN')""",
    ),
    "target_alerts": f"""WITH {FACTS}, {COINS}, p AS (SELECT c.coin_id AS target_id, fact_id, CASE WHEN c.ruler = f.ruler THEN 25 ELSE 0 END + 30 + 25 + 10 AS confidence FROM coins c JOIN facts f ON c.year = f.year AND c.variant = f.variant AND coalesce(c.ruler = f.ruler, true) AND c.nominal = f.nominal)
 SELECT target_id, fact_id, CAST(confidence AS INTEGER) AS confidence, confidence >= 70 AS strong FROM p WHERE confidence >= 70""",
    "type_suggest_topk": f"""WITH {COINS}, p AS (SELECT a.coin_id, t.coin_id AS type_id, CASE WHEN a.year = t.year THEN 45 ELSE 0 END + CASE WHEN a.ruler = t.ruler THEN 20 ELSE 0 END + CASE WHEN a.nominal = t.nominal THEN 20 ELSE 0 END + CASE WHEN a.mint = t.mint THEN 10 ELSE 0 END AS score
 FROM coins a, coins t WHERE t.coin_id IN (SELECT min(coin_id) FROM coins GROUP BY nominal)), r AS (SELECT coin_id, type_id, CAST(score AS INTEGER) AS score, CAST(row_number() OVER (PARTITION BY coin_id ORDER BY score DESC, type_id) AS INTEGER) AS rank FROM p WHERE score > 0) SELECT * FROM r WHERE rank <= 8""",
    "same_variant": f"WITH {COINS} SELECT trim(regexp_replace(lower(coalesce(ruler, '')), '[^a-z0-9]+', ' ', 'g')) || '|' || trim(regexp_replace(lower(nominal), '[^a-z0-9]+', ' ', 'g')) || '|' || variant AS identity, count(*) AS n, min(coin_id) AS first_coin FROM coins GROUP BY 1",
    "fee_rule_asof": f"WITH {FACTS}, {RULES} SELECT c AS rule_checked_at, pct AS premium_pct, count(*) AS n FROM ruled GROUP BY 1, 2",
    "buyer_cost": f"""WITH {FACTS}, {RULES} SELECT fact_id, pct IS NOT NULL AS complete, round(hammer_price * pct / 100, 6) AS premium, round(hammer_price * pct / 100 * 23.0::DOUBLE / 100, 6) AS vat,
 round(hammer_price + hammer_price * pct / 100 + hammer_price * pct / 100 * 23.0::DOUBLE / 100 + fixed::DOUBLE, 6) AS total FROM ruled WHERE hammer_price IS NOT NULL""",
    "seller_net": f"WITH {FACTS} SELECT source, round(sum(hammer_price - hammer_price * 12.0::DOUBLE / 100 - hammer_price * 12.0::DOUBLE / 100 * 23.0::DOUBLE / 100 - 3), 0) AS net, count(*) AS n FROM facts WHERE hammer_price IS NOT NULL GROUP BY 1",
    "purchasing_power": f"WITH {FACTS} SELECT year(sold_at) AS sale_year, count(source_url) AS n, round(sum(CASE WHEN source_url IS NOT NULL THEN amount * (1 + (2001 - year(sold_at)) * 0.08::DOUBLE) END), 0) AS today FROM facts GROUP BY 1",
    "era_range_join": f"""WITH {COINS}, eras(era, place, f, t) AS (VALUES ('medieval', 0, 960, 1506), ('jagiellonian', 1, 1386, 1572), ('elective', 2, 1573, 1795), ('partitions', 3, 1795, 1918), ('ii-rp', 4, 1918, 1939), ('war', 5, 1939, 1945), ('prl', 6, 1945, 1989), ('iii-rp', 7, 1990, 2100)),
 r AS (SELECT coin_id, CAST(year - 1500 + coin_id % 600 + 1400 AS INTEGER) AS year FROM coins) SELECT coin_id, year, count(era) AS n_eras, arg_min(era, place) AS first_era FROM r LEFT JOIN eras ON year BETWEEN f AND t GROUP BY 1, 2""",
    "collection_search": f"WITH {COINS} SELECT coin_id, title, grade FROM coins WHERE contains(lower(concat_ws(chr(10), title, ruler, nominal, year, mint, variant, grade)), 'brand#1') AND grade = 'VF'",
    "collection_facets": f"WITH {COINS} " + " UNION ALL ".join(f"SELECT '{c}' AS facet, CAST({c} AS VARCHAR) AS value, count(*) AS n FROM coins GROUP BY 2" for c in ("ruler", "nominal", "grade", "mint")),
    "collection_sort": f"""WITH {COINS}, r AS (SELECT coin_id, row_number() OVER (ORDER BY year DESC NULLS LAST, trim(regexp_replace(lower(nominal), '[^a-z0-9]+', ' ', 'g')), trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')), coin_id) AS place FROM coins) SELECT * FROM r WHERE place <= 60""",
    "collection_value_by_currency": f"WITH {COINS} SELECT purchase_currency, round(sum(value), 2) AS value, count(*) FILTER (stale) AS n_stale, count(*) FILTER (value > 0) AS n_valued, count(*) FILTER (NOT stale AND value <= 0) AS n_unvalued FROM valued GROUP BY 1",
    "roi_summary": f"WITH {COINS} SELECT purchase_currency, count(*) AS n, floor((sum(value) - sum(purchase_price)) / sum(purchase_price) * 1000 + 0.5) / 10 AS roi_pct FROM valued WHERE value > 0 AND purchase_price > 0 GROUP BY 1",
    "value_breakdown": f"WITH {COINS} " + " UNION ALL ".join(f"SELECT '{c}' AS dimension, coalesce({c}, 'unknown') AS member, count(*) AS n, round(sum(value), 2) AS value FROM valued GROUP BY {c}" for c in ("ruler", "mint", "nominal")),
    "export_view": f"WITH {COINS} SELECT coin_id, CASE WHEN NOT stale THEN catalog_ref END AS catalog_ref, round(CASE WHEN NOT stale THEN market_median END, 2) AS market_median, round(CASE WHEN NOT stale THEN estimated_value END, 2) AS estimated_value FROM coins",
    "friend_view": f"WITH {COINS} SELECT title, ruler, year, nominal, mint, variant, grade FROM coins",
    "album_rollup": f"""WITH {COINS}, m AS (SELECT DISTINCT unnest([coin_id % 7, coin_id % 3]) AS album, coin_id FROM coins), r AS (SELECT *, row_number() OVER (PARTITION BY album ORDER BY coin_id) AS k FROM m)
 SELECT album, count(*) AS n, string_agg(CAST(coin_id AS VARCHAR), ',' ORDER BY coin_id) FILTER (k <= 4) AS covers FROM r GROUP BY 1""",
    "knowledge_consensus": f"WITH {OBS} SELECT ruler, nominal, count(*) AS n, count(DISTINCT source) AS n_sources, bool_or(expert) AS expert, count(DISTINCT source) >= 2 OR bool_or(expert) AS strong FROM obs GROUP BY 1, 2",
    "knowledge_audit": f"""WITH {OBS}, g AS (SELECT ruler, nominal, count(*) AS n, count(DISTINCT variant) AS n_variant, count(DISTINCT rarity) AS n_rarity FROM obs GROUP BY 1, 2)
 SELECT *, CAST(CASE WHEN n_variant > 1 THEN 1 ELSE 0 END + CASE WHEN n_rarity > 1 THEN 1 ELSE 0 END AS INTEGER) AS conflicts FROM g WHERE n_variant > 1 OR n_rarity > 1""",
    "trust_levels": f"""WITH {OBS}, g AS (SELECT bool_or(expert) AS e, count(DISTINCT source) AS s, bool_or(origin = 'user') AS u FROM obs GROUP BY ruler, nominal, variant),
 l AS (SELECT CASE WHEN e AND s >= 2 THEN 'multi_source_verified' WHEN e THEN 'expert_verified' WHEN u THEN 'user_corrected' ELSE 'ai_suggestion' END AS level FROM g)
 SELECT level, CAST(CASE level WHEN 'multi_source_verified' THEN 90 WHEN 'expert_verified' THEN 70 WHEN 'user_corrected' THEN 30 ELSE 10 END AS INTEGER) AS trust_rank, count(*) AS n FROM l GROUP BY 1, 2""",
    "licence_gate": f"""WITH {OBS}, lic(s, ingest) AS (VALUES ('src0', 'ALLOW'), ('src1', 'ALLOW'), ('src2', 'ALLOW_WITH_RIGHTS'), ('src3', 'ALLOW_WITH_RIGHTS'), ('src4', 'REFERENCE_ONLY'), ('src5', 'BLOCK'), ('src6', 'ALLOW'))
 SELECT source, ingest, count(*) AS n FROM obs JOIN lic ON source = s WHERE ingest = 'ALLOW' OR (ingest = 'ALLOW_WITH_RIGHTS' AND observation_id % 2 = 0) GROUP BY 1, 2""",
    "promotion": f"""WITH {OBS}, g AS (SELECT ruler, nominal, count(DISTINCT source) AS n_sources, bool_or(expert) AS expert, bool_and(source NOT IN ('src4', 'src5')) AS ok FROM obs GROUP BY 1, 2)
 SELECT ruler, nominal, n_sources, expert FROM g WHERE ok AND (n_sources >= 2 OR expert) AND NOT EXISTS (SELECT 1 FROM obs o WHERE o.observation_id % 50 = 0 AND o.ruler = g.ruler AND o.nominal = g.nominal)""",
    "source_band": f"""WITH {OBS}, g AS (SELECT ruler, nominal, variant, count(*) AS n, count(DISTINCT source) AS n_sources, CAST(sum(least(8, observation_id % 12)) AS BIGINT) AS points FROM obs GROUP BY 1, 2, 3)
 SELECT *, CASE WHEN n_sources >= 3 AND points >= 18 THEN 'strong' WHEN n_sources >= 2 AND points >= 10 THEN 'supported' ELSE 'single-source' END AS band FROM g""",
    "hard_negatives": f"""WITH {COINS}, g AS (SELECT raw_nominal AS wrong, nominal AS right, count(*) AS n, CAST(max(CASE WHEN coin_id % 3 = 0 THEN 70 ELSE 30 END) AS INTEGER) AS trust_rank, max(coin_id) AS last_seen FROM coins WHERE accepted AND raw_nominal <> nominal GROUP BY 1, 2)
 SELECT *, CAST(least(24, floor((least(12, 4 + 2 * n) + CASE WHEN trust_rank >= 70 THEN 9 ELSE 4 END) * CASE WHEN trust_rank >= 70 THEN 0.85 ELSE 0.45 END + 0.5)) AS INTEGER) AS boost, CAST(least(30, 8 + 4 * n) AS INTEGER) AS penalty FROM g""",
    "fingerprint_similarity": f"WITH {PRINTS} SELECT *, CASE WHEN matched >= 8 THEN 'strong' WHEN matched >= 5 THEN 'good' WHEN matched >= 3 THEN 'limited' ELSE 'weak' END AS quality FROM cmp",
    "fingerprint_topk": f"WITH {PRINTS}, r AS (SELECT a_print_id, b_print_id, CAST(row_number() OVER (PARTITION BY a_print_id ORDER BY score DESC, b_print_id) AS INTEGER) AS rank FROM cmp WHERE matched >= 3) SELECT * FROM r WHERE rank <= 3",
    "master_fingerprint": f"""WITH {PRINTS}, p AS (SELECT identity, count(DISTINCT print_id) AS prints FROM prints GROUP BY 1), c AS (SELECT identity, feature, value, count(*) AS n, avg(confidence) AS confidence FROM prints GROUP BY 1, 2, 3),
 r AS (SELECT *, row_number() OVER (PARTITION BY identity, feature ORDER BY n DESC, value) AS k FROM c) SELECT r.identity, feature, value, round(confidence, 4) AS confidence, n || '/' || prints AS note FROM r JOIN p ON r.identity = p.identity WHERE k = 1 AND prints >= 2""",
    "changed_fields": f"WITH {COINS}, {CHANGED} SELECT changed, count(*) AS n FROM chg GROUP BY 1",
    "invalidate_derived": f"""WITH {COINS}, {CHANGED} SELECT stale OR changed <> '' AS stale, changed <> '' AS needs_reanalysis, count(*) AS n, count(CASE WHEN changed = '' THEN market_median END) AS n_median, count(CASE WHEN changed = '' THEN catalog_ref END) AS n_ref FROM chg GROUP BY 1, 2""",
    "reanalysis_status": f"""WITH {COINS}, k AS (SELECT lower(nominal) || '|' || variant AS now, CASE WHEN coin_id % 5 <> 0 THEN lower(raw_nominal) || '|' || raw_variant END AS a, CASE WHEN coin_id % 7 <> 0 THEN lower(nominal) || '|' || variant END AS b FROM coins)
 SELECT CASE WHEN coalesce(a = now, false) AND coalesce(b = now, false) THEN 'resolved' WHEN a IS NOT NULL OR b IS NOT NULL THEN 'drifted' ELSE 'waiting' END AS status, count(*) AS n FROM k GROUP BY 1""",
    "upsert_latest": """WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_extendedprice DESC, l_partkey DESC, l_suppkey DESC) AS n FROM lineitem) SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM r WHERE n = 1""",
    "cascade_delete": """SELECT 'orders' AS rows_of, count(*) AS n FROM orders WHERE o_orderkey % 10 <> 3 UNION ALL SELECT 'lineitem', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 10 = 3)""",
    "insert_absent": "SELECT CAST(CASE WHEN c_custkey % 2 = 0 THEN c_nationkey ELSE 99 END AS INTEGER) AS c_nationkey, count(*) AS n FROM customer GROUP BY 1",
    "html_extract": r"""WITH p AS (SELECT page_id, html, regexp_replace(regexp_replace(regexp_replace(html, '<script.*?</script>', ' ', 'gis'), '<style.*?</style>', ' ', 'gis'), '<[^>]+>', ' ', 'g') AS t FROM pages),
 q AS (SELECT page_id, html, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '&nbsp;', ' ', 'gi'), '&amp;', '&', 'gi'), '&#39;', '''', 'g'), '&quot;', '"', 'g'), '\s+', ' ', 'g')) AS plain FROM p)
 SELECT page_id, regexp_extract(html, '<title>(.*?)</title>', 1, 'is') AS title, length(plain) AS n_chars, NOT contains(plain, '<') AS no_tags FROM q""",
    "running_cap": "WITH r AS (SELECT conv_id, turn, CAST(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS running FROM conversations) SELECT * FROM r WHERE running <= 1000",
    "history_topn": "SELECT event_id, ts, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 200",
    "latency_p50_p90": """WITH r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS n FROM events), k AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS r, count(*) OVER (PARTITION BY event_type) AS m FROM r WHERE n <= 60)
 SELECT event_type, count(*) AS n, max(CASE WHEN r = ceil(m * 0.5) THEN value END) AS p50, max(CASE WHEN r = ceil(m * 0.9) THEN value END) AS p90 FROM k GROUP BY 1""",
    "text_fold": f"SELECT doc_id, trim(regexp_replace(translate({STRIP.format('text')}, 'ł', 'l'), '[^a-z0-9]+', ' ', 'g')) AS folded, {STRIP.format('trim(text)')} AS comparable FROM documents",
    "sentinel_canonical": f"WITH {COINS} SELECT CASE WHEN mint <> 'unknown' THEN mint END AS mint, count(*) AS n FROM coins GROUP BY 1",
}
ORACLE_SQL |= records_sql.oracle(FACTS, COINS, OBS, records.CLAIMS, records.REIGNS, records.TIERS)
ORACLE_SQL |= intake_sql.oracle(FACTS, COINS)
ORACLE_SQL |= streams.oracle(FACTS, ORACLE_SQL)
ORACLE_SQL |= upkeep.oracle(FACTS, COINS, OBS, RULES)
ORACLE_SQL |= prints.oracle(FACTS, COINS, OBS)
ORACLE_SQL |= stores.oracle(OBS)
