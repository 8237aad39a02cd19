"""The queries of records.py in SQL, over the tables as views."""

from __future__ import annotations


def _values(rows: tuple[tuple, ...]) -> str:
    def one(v) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, list):
            return "[" + ", ".join(map(one, v)) + "]::VARCHAR[]"
        return str(v) if isinstance(v, int) else "'" + str(v) + "'"

    return "VALUES " + ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows)


def _fold(x: str) -> str:
    return f"trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'))"


def _alike(a: str, b: str) -> str:
    return f"coalesce({a} <> '' AND {b} <> '' AND (contains({a}, {b}) OR contains({b}, {a})), false)"


def oracle(facts: str, coins: str, obs: str, claims: tuple, reigns: tuple, tiers: tuple) -> dict[str, str]:
    albums = f"""WITH {coins}, al AS (SELECT coin_id, purchase_price, grade, list_distinct(['a' || (coin_id % 7), CASE WHEN coin_id % 5 = 0 THEN 'goals' ELSE 'dreams' END]) AS ids FROM coins)"""
    listed = "array_to_string(list_sort({}), ',')"
    claim = f"claims(claim_id, claim_type, ruler, yf, yt, nominal, mint, kw) AS ({_values(claims)})"
    status = "CASE WHEN {m} < 5 THEN 'neutral' WHEN {s} >= 85 AND {c} = 0 THEN 'supported' WHEN {c} >= 2 OR {s} < 45 THEN 'conflict' ELSE 'neutral' END"
    first, second = status.format(s="coin_id % 101", m="coin_id % 9", c="coin_id % 4"), status.format(s="100 - coin_id % 101", m="coin_id % 9", c="0")
    label = "lower(concat_ws(' ', title, nominal, year, CASE WHEN coin_id % 3 = 0 THEN 'poland' END))"
    order = {"added-desc": "added DESC", "year-asc": "year", "year-desc": "year DESC", "nominal-asc": "rank", "nominal-desc": "rank DESC"}
    page = "SELECT '{0}' AS mode, coin_id, place FROM (SELECT coin_id, row_number() OVER (ORDER BY {1}, " + _fold("nominal") + ", " + _fold("title") + ", coin_id) AS place FROM r) WHERE place BETWEEN 61 AND 120"
    return {
        "html_facts": f"""WITH {facts}, p AS (SELECT fact_id, CAST(lot_key AS VARCHAR) AS lot, CASE WHEN lot_key % 7 <> 0 THEN floor(amount) + 0.5::DOUBLE END AS realized_price, CASE WHEN lot_key % 7 = 0 OR currency NOT IN ('EUR', 'USD') THEN 'PLN' ELSE currency END AS currency,
 CASE WHEN lot_key % 11 <> 0 THEN CAST(sold_at AS DATE) END AS sold_at, coalesce(grade, '-') AS grade FROM facts) SELECT *, CASE WHEN realized_price IS NULL THEN 'no price' WHEN sold_at IS NULL THEN 'no day' END AS error FROM p""",
        "price_clean": f"""WITH {facts}, a AS (SELECT fact_id, lot_key, CASE lot_key % 3 WHEN 0 THEN 'realized' WHEN 1 THEN 'total' ELSE 'other' END AS t, CASE WHEN lot_key % 5 = 0 THEN 0.0 WHEN lot_key % 2 = 0 THEN amount END AS p,
 CASE WHEN lot_key % 4 <> 1 THEN hammer_price END AS h, CASE WHEN lot_key % 4 <> 1 THEN realized_price END AS r, CASE WHEN lot_key % 4 <> 1 THEN total_price END AS tt FROM facts),
 b AS (SELECT *, coalesce(nullif(p, 0), nullif(r, 0), nullif(h, 0), nullif(tt, 0), 0.0) AS price FROM a), c AS (SELECT *, coalesce(r, CASE WHEN t = 'realized' THEN nullif(price, 0) END) AS realized_price FROM b)
 SELECT fact_id, price, realized_price, CASE WHEN h > 0 THEN 'hammer' WHEN realized_price > 0 THEN 'realized' WHEN tt > 0 THEN 'total' WHEN t IN ('hammer', 'realized', 'total') THEN t ELSE 'unknown' END AS basis FROM c""",
        "community_match": f"""WITH {coins}, {claim}, k AS (SELECT *, {_fold("nominal")} AS rn, {_fold("ruler")} AS rr, {_fold("mint")} AS rm FROM claims),
 c AS (SELECT coin_id, year AS cy, {_fold("ruler")} AS cr, {_fold("nominal")} AS cn, {_fold("mint")} AS cm, {_fold("concat_ws(' ', ruler, nominal, year, mint, variant, title)")} AS hay FROM coins),
 x AS (SELECT *, coalesce(cy BETWEEN yf AND coalesce(yt, yf), false) AS ym, {_alike("rn", "cn")} AS nm, {_alike("rr", "cr")} AS rum, {_alike("rm", "cm")} AS mm, len(list_filter(kw, lambda w: contains(hay, w))) AS words FROM c, k),
 y AS (SELECT *, CASE WHEN yf IS NOT NULL AND rn IS NOT NULL AND claim_type <> 'occupation_mint_diagnostics' THEN ym AND nm WHEN yf IS NULL AND rn IS NULL AND rr IS NULL AND rm IS NULL THEN words >= 2
 ELSE CAST(yf IS NOT NULL AND ym AS INTEGER) + CAST(rn IS NOT NULL AND nm AS INTEGER) + CAST(rr IS NOT NULL AND rum AS INTEGER) + CAST(rm IS NOT NULL AND mm AS INTEGER) >= 2 END AS fits FROM x
 WHERE NOT (yf IS NOT NULL AND NOT ym) AND NOT (rn IS NOT NULL AND NOT nm) AND NOT (rr IS NOT NULL AND cr IS NOT NULL AND NOT rum) AND NOT (rm IS NOT NULL AND cm <> 'unknown' AND NOT mm)),
 z AS (SELECT coin_id, claim_id, CAST(4 * CAST(ym AS INTEGER) + 4 * CAST(nm AS INTEGER) + 3 * CAST(rum AS INTEGER) + 2 * CAST(mm AS INTEGER) + least(3, words) AS INTEGER) AS score FROM y WHERE fits),
 r AS (SELECT *, CAST(row_number() OVER (PARTITION BY coin_id ORDER BY score DESC, claim_id) AS INTEGER) AS rank FROM z) SELECT * FROM r WHERE rank <= 5""",
        "community_scan": f"""WITH {obs}, {claim}, own AS (SELECT DISTINCT 'c' || (observation_id % 300) AS claim_id, source AS claim_type FROM obs WHERE origin = 'user'),
 u AS (SELECT * FROM own UNION ALL SELECT claim_id, claim_type FROM claims WHERE claim_id NOT IN (SELECT claim_id FROM own)) SELECT claim_type, 'candidate' AS status, count(*) AS n FROM u GROUP BY 1""",
        "source_links": """SELECT page_id, coalesce(regexp_matches(regexp_extract(url, '^https?://([^/?#@:]+)(:[0-9]+)?([/?#]|$)', 1), '(?i)(^|\\.)example\\.com$'), false) AS belongs FROM pages""",
        "multi_source_evidence": f"""WITH {coins}, t AS (SELECT * FROM coins WHERE coin_id IN (SELECT min(coin_id) FROM coins GROUP BY nominal)),
 p AS (SELECT a.coin_id, t.coin_id AS type_id, CAST(CASE WHEN a.ruler = t.ruler THEN 3 ELSE 0 END + CASE WHEN a.nominal = t.nominal THEN 3 ELSE 0 END + CASE WHEN a.year = t.year THEN 2 ELSE 0 END + CASE WHEN a.mint = t.mint THEN 1 ELSE 0 END AS INTEGER) AS score FROM coins a, t) SELECT * FROM p WHERE score >= 5""",
        "chronology_guard": f"""WITH {coins}, reigns(name, f, t) AS ({_values(reigns)}), y AS (SELECT coin_id, bool_or({_alike(_fold("ruler"), _fold("name"))}) AS named FROM coins JOIN reigns ON year BETWEEN f AND t GROUP BY 1),
 m AS (SELECT c.coin_id, coalesce(ruler IS NOT NULL AND NOT named, false) AS mismatch, CAST(c.coin_id % 101 AS INTEGER) AS conf, estimate_low AS lo, estimate_high AS hi FROM coins c LEFT JOIN y ON c.coin_id = y.coin_id)
 SELECT coin_id, mismatch, CASE WHEN mismatch THEN least(conf, 72) ELSE conf END AS confidence, CASE WHEN mismatch THEN 0.0 ELSE lo END AS estimate_low, CASE WHEN mismatch THEN 0.0 ELSE hi END AS estimate_high FROM m""",
        "fingerprint_evidence": f"""WITH {coins}, s AS (SELECT coin_id, {first} AS status, {second} AS other FROM coins) SELECT coin_id, status, CASE WHEN 'supported' IN (status, other) AND 'conflict' IN (status, other) THEN 'mixed' WHEN 'conflict' IN (status, other) THEN 'conflict' WHEN 'supported' IN (status, other) THEN 'supported' ELSE 'neutral' END AS verdict FROM s""",
        "model_route": f"""WITH {coins} SELECT coin_id, CASE WHEN coin_id % 10 = 0 THEN 'strong: stage' WHEN coin_id % 1000 < 100 THEN 'strong: samples' WHEN 95 + coin_id % 6 < 97 THEN 'strong: accuracy' WHEN coin_id % 5 < 2 THEN 'strong: hits' WHEN 80 + coin_id % 21 < 90 THEN 'strong: quality' WHEN coin_id % 17 > 10 THEN 'strong: ambiguity' ELSE 'fast' END AS route FROM coins""",
        "reference_check": f"""WITH {coins}, r AS (SELECT coin_id, contains({label}, CAST(1500 + coin_id % 50 AS VARCHAR)) AS y, contains({label}, lower(split_part(nominal, ' ', 1))) OR contains({label}, 'talar') AS n,
 coin_id % 4 <> 0 AND (contains({label}, split_part(title, ' ', 2)) OR contains({label}, 'blue')) AS r, coin_id % 4 <> 0 AS known, coin_id % 3 = 0 AS pl FROM coins)
 SELECT coin_id, CAST(4 * CAST(y AS INTEGER) + 4 * CAST(n AS INTEGER) + 3 * CAST(r AS INTEGER) + 2 * CAST(pl AS INTEGER) AS INTEGER) AS score, CASE WHEN y AND n AND r THEN 'supported' WHEN y AND n AND known THEN 'possible_conflict' ELSE 'neutral' END AS status FROM r""",
        "album_moves": f"""{albums}, m AS (SELECT coin_id, CASE WHEN coin_id % 3 <> 0 THEN 'a' || (coin_id % 7) END AS s, CASE WHEN coin_id % 10 <> 4 THEN 'a' || (coin_id % 8) END AS t FROM coins WHERE coin_id % 2 = 0),
 g AS (SELECT * FROM m WHERE (t IS NULL OR t IN ('a0', 'a1', 'a2', 'a3', 'a4', 'goals')) AND NOT coalesce(s = t, false)), w AS (SELECT al.coin_id, CASE WHEN s IS NULL THEN ids ELSE list_filter(ids, lambda x: x <> s) END AS ids, t FROM al LEFT JOIN g ON al.coin_id = g.coin_id)
 SELECT coin_id, {listed.format("CASE WHEN t IS NULL THEN ids ELSE list_distinct(list_append(ids, t)) END")} AS album_ids FROM w""",
        "default_albums": """SELECT * FROM (VALUES ('a1', 'Alpha', 'user'), ('a3', 'Gamma', 'user'), ('x', 'moje CELE', 'user'), ('my-album', 'Mój album', 'collection'), ('dreams', 'Marzenia', 'dreams')) t(album_id, name, kind)""",
        "target_purchase": f"""{albums}, l AS (SELECT coin_id, coalesce(CASE WHEN coin_id % 20 = 0 THEN 100.0::DOUBLE + coin_id END, CASE WHEN coin_id % 30 = 0 THEN 200.0::DOUBLE + coin_id END, CASE WHEN coin_id % 50 = 0 THEN 0.0::DOUBLE ELSE 300.0::DOUBLE + coin_id END) AS paid FROM coins WHERE coin_id % 10 = 0)
 SELECT al.coin_id, CASE WHEN paid > 0 THEN paid ELSE purchase_price END AS purchase_price, {listed.format("CASE WHEN paid IS NULL THEN ids ELSE list_distinct(list_append(list_filter(ids, lambda x: x NOT IN ('goals', 'dreams')), 'my-album')) END")} AS album_ids, al.coin_id % 4 = 0 AND paid IS NULL AS watched FROM al LEFT JOIN l ON al.coin_id = l.coin_id""",
        "album_filter": f"{albums} SELECT coin_id FROM al WHERE list_contains(ids, 'goals') AND grade = 'AU'",
        "rarity_facets": f"WITH {coins} SELECT CASE WHEN coin_id % 3 = 0 AND catalog_ref IS NOT NULL THEN 'kopicki:' || catalog_ref WHEN coin_id % 2 = 0 THEN 'general:R2' END AS rarity, count(*) AS n FROM coins GROUP BY 1",
        "knowledge_normalise": f"""WITH {obs} SELECT observation_id, upper(source) AS source, ruler || ' x' AS ruler, CASE observation_id % 4 WHEN 0 THEN '1623' WHEN 1 THEN 'ca 1500' ELSE '' END AS year, CASE WHEN observation_id % 3 = 0 THEN 12.5::DOUBLE END AS sale_price FROM obs WHERE observation_id % 6 <> 0 AND ruler IS NOT NULL AND (observation_id % 4 < 2 OR nominal <> '' OR variant <> '')""",
        "trust_evidence": f"""WITH {obs} SELECT observation_id, array_to_string(list_filter([CASE WHEN origin = 'ai' THEN 'ai_result' END, CASE WHEN origin = 'user' THEN 'user_correction' END, CASE WHEN expert THEN 'expert_verification' END, CASE WHEN source IS NULL THEN 'source' ELSE 'source:' || source END, CASE WHEN source IS DISTINCT FROM 'src' || (observation_id % 5) THEN 'source:src' || (observation_id % 5) END], lambda x: x IS NOT NULL), ',') AS evidence FROM obs""",
        "verified_scan": f"WITH {obs} SELECT ruler, nominal, variant, count(*) AS n FROM obs GROUP BY 1, 2, 3 HAVING bool_and(coalesce(source IN ('src0', 'src1') OR (source = 'src2' AND observation_id % 5 <> 0), false))",
        "source_ingest": f"""WITH {obs}, tiers(s, tier) AS ({_values(tiers)}), k AS (SELECT observation_id, source, CASE WHEN observation_id % 3 = 0 THEN nominal ELSE '' END AS source_id, 'u' || (observation_id % 17) AS source_url FROM obs JOIN tiers ON source = s AND tier NOT LIKE 'RED%'),
 r AS (SELECT *, row_number() OVER (PARTITION BY source, coalesce(nullif(source_id, ''), source_url) ORDER BY observation_id DESC) AS rn, min(observation_id) OVER (PARTITION BY source, coalesce(nullif(source_id, ''), source_url)) AS record_id FROM k) SELECT record_id, source, source_id, source_url, observation_id FROM r WHERE rn = 1""",
        "fee_rule_upsert": """SELECT 'H' || (l_suppkey % 50) AS house, CAST(l_shipdate AS DATE) AS checked_at, CAST(arg_max(l_partkey % 25 - 2, (l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice)) AS DOUBLE) AS premium_pct FROM lineitem WHERE l_suppkey % 9 <> 0 AND l_shipdate IS NOT NULL AND l_partkey % 25 >= 2 GROUP BY 1, 2""",
        "collection_pages": f"WITH {coins}, r AS (SELECT coin_id, year, nominal, title, coin_id * 7919 % 1000 AS added, 0 AS rank FROM coins) " + " UNION ALL ".join(page.format(m, o) for m, o in order.items()),
        "upper_median": f"WITH {facts}, r AS (SELECT nominal, amount AS price, row_number() OVER (PARTITION BY nominal ORDER BY amount, fact_id) AS r, count(*) OVER (PARTITION BY nominal) AS n FROM facts) SELECT nominal, price FROM r WHERE r = n // 2 + 1",
        "source_summary": f"WITH {facts} SELECT source, count(*) AS n FROM facts GROUP BY 1",
        "latest_coins": f"WITH {coins} SELECT coin_id, CASE WHEN coin_id % 3 = 0 THEN coin_id % 500 ELSE coin_id % 400 END AS seen_at FROM coins ORDER BY seen_at DESC, coin_id LIMIT 3",
        "knowledge_coverage": f"WITH {obs} SELECT origin, count(*) AS n, count(DISTINCT source) AS sources, count(*) FILTER (expert) AS experts FROM obs GROUP BY 1",
        "canonical_title": f"WITH {coins} SELECT coin_id, concat_ws(' • ', nominal, ruler, CASE WHEN mint <> 'unknown' THEN mint END, year) AS title FROM coins",
        "lot_to_coin": f"WITH {facts} SELECT fact_id, ruler, nominal, year, mint, variant, coalesce(hammer_price, realized_price, total_price) AS purchase_price, currency AS purchase_currency, house || ', ' || strftime(sold_at, '%Y-%m-%d') || ', lot ' || lot_key AS provenance FROM facts",
    }
