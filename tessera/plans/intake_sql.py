"""The queries of intake.py in SQL: what the payloads were made of, without the payloads."""

from __future__ import annotations


def oracle(facts: str, coins: str) -> dict[str, str]:
    coined = "title LIKE '%coin%' OR title LIKE '%medal%' OR title LIKE '%token%'"
    return {
        "feed_records": f"""WITH {coins} SELECT coin_id, CAST(coin_id AS VARCHAR) AS source_id, 'https://lots.example/a/' || coin_id || '/' AS source_url, title || ' & co' AS label FROM coins
 UNION ALL SELECT coin_id, CAST(coin_id AS VARCHAR), 'n/' || coin_id, nominal FROM coins""",
        "graph_labels": f"WITH {coins} SELECT coin_id, CASE WHEN coin_id % 4 = 1 THEN 'first' ELSE nominal END AS label FROM coins WHERE coin_id % 4 <> 3",
        "met_objects": f"""WITH {coins} SELECT CAST(coin_id AS VARCHAR) AS source_id, 'https://www.metmuseum.org/art/collection/search/' || coin_id AS source_url, coalesce(ruler, '') AS ruler,
 CASE WHEN coin_id % 2 = 0 THEN 'Coin' ELSE title END AS nominal, CAST(year AS VARCHAR) AS year, mint, '' AS metal, title AS variant, CASE WHEN coin_id % 7 <> 0 THEN 'img' || coin_id END AS image_url
 FROM coins WHERE coin_id % 3 <> 0 AND (coin_id % 2 = 0 OR coin_id % 5 = 0 OR {coined})""",
        "smithsonian_objects": f"""WITH {coins}, s AS (SELECT coin_id, CASE coin_id % 4 WHEN 0 THEN 'Coin ' || title ELSE title END AS t FROM coins WHERE coin_id % 4 <> 1)
 SELECT CAST(coin_id AS VARCHAR) AS source_id, 'u' || coin_id AS source_url, t AS label, CASE WHEN coin_id % 3 = 0 THEN 'nmah' ELSE 'ABC' END AS provider, CASE WHEN coin_id % 5 = 0 THEN 'i' || coin_id END AS image_url
 FROM s WHERE coin_id % 4 = 0 OR (coin_id % 2 = 0 AND coin_id % 3 = 0)""",
        "europeana_objects": f"""WITH {coins} SELECT '/1/' || coin_id AS source_id, 'https://www.europeana.eu/item/1/' || coin_id AS source_url, title AS label, CAST(year AS VARCHAR) AS year, 'IMAGE' AS concept_type,
 CASE coin_id % 4 WHEN 0 THEN 'own' WHEN 1 THEN 'polski' WHEN 2 THEN 'text' ELSE 'deutsch' END AS provider,
 CASE coin_id % 3 WHEN 0 THEN 'http://creativecommons.org/licenses/by/4.0/' WHEN 1 THEN 'http://rightsstatements.org/vocab/InC/1.0/' ELSE 'http://rightsstatements.org/vocab/NoC-NC/1.0/ | x' END AS rights, coin_id % 3 <> 1 AS media_reusable FROM coins""",
        "analysis_settled": f"""WITH {coins}, a AS (SELECT coin_id, estimate_low <= estimate_high AS ordered, CAST(greatest(0, least(95, coin_id % 130 - 10)) AS INTEGER) AS confidence, CAST(least(100, 70 + coin_id % 40) AS INTEGER) AS ruler_confidence,
 CASE WHEN coin_id % 17 <> 0 THEN 88 ELSE 0 END AS nominal_confidence, array_to_string(list_filter([CASE WHEN coin_id % 9 = 0 THEN 'country' END, CASE WHEN ruler IS NULL THEN 'ruler' END, CASE WHEN coin_id % 11 = 0 THEN 'nominal' END], lambda x: x IS NOT NULL), ',') AS missing FROM coins)
 SELECT *, missing <> '' OR confidence < 85 OR ruler_confidence < 80 OR nominal_confidence < 80 OR coin_id % 13 = 0 AS needs_detail FROM a""",
        "description_reconciled": f"""WITH {coins}, d AS (SELECT *, nominal <> raw_nominal AS nc, variant <> raw_variant AS vc FROM coins)
 SELECT coin_id, CASE WHEN nc OR vc THEN concat_ws(' ', 'Nominał: ' || nominal || '.', 'Władca / emitent: ' || ruler || '.', 'Odmiana / typ: ' || variant || '.', CASE WHEN NOT nc THEN 'The coin is a ' || raw_nominal || '.' END, 'Fine surface.', 'Minted under ' || raw_ruler || '!',
 CASE WHEN NOT vc THEN 'Of type ' || raw_variant || '.' END) ELSE 'Intro here. The coin is a ' || raw_nominal || '. Fine surface. Minted under ' || raw_ruler || '! Of type ' || raw_variant || '.' END AS description FROM d""",
        "literature_works": f"""WITH {coins} SELECT coin_id, 'kopicki' || CASE WHEN catalog_ref IS NOT NULL THEN ',tyszkiewicz' ELSE '' END || CASE WHEN coin_id % 5 = 0 THEN ',parchimowicz' ELSE '' END || CASE WHEN coin_id % 3 = 0 THEN ',gumowski' ELSE '' END AS works FROM coins""",
        "photo_choice": f"WITH {coins} SELECT coin_id, CASE WHEN coin_id % 3 = 0 THEN '' WHEN coin_id % 3 = 1 AND coin_id % 4 >= 2 AND coin_id % 5 <> 0 THEN 'c' || coin_id ELSE 'o' || coin_id END AS photo FROM coins",
        "earlier_prices": f"""WITH {facts} SELECT fact_id, CASE lot_key % 3 WHEN 0 THEN 'hammer' WHEN 1 THEN 'realized' ELSE 'unknown' END AS price_type, CASE WHEN lot_key % 3 = 0 THEN coalesce(hammer_price, amount) END AS hammer_price,
 CASE WHEN lot_key % 3 = 1 THEN coalesce(realized_price, amount) END AS realized_price, coalesce(source_url, '') AS source_url FROM facts""",
        "earlier_coins": f"""WITH {coins}, q AS (SELECT *, accepted AND (nominal <> raw_nominal OR variant <> raw_variant) AND coin_id % 6 < 4 AND (market_median IS NOT NULL OR estimated_value IS NOT NULL OR catalog_ref IS NOT NULL) AND NOT stale AND coin_id % 4 <> 0 AS hit FROM coins)
 SELECT coin_id, hit AS quarantined, stale OR hit AS stale, CAST(greatest(coin_id % 6, 4) AS INTEGER) AS record_version, market_median IS NOT NULL AND NOT hit AS has_median FROM q""",
    }
