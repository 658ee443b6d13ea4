"""Canonical entities of the freight network as queries over the base tables or other entities.

The base tables are generic; these queries give typed rows of the right shape, in SQL that any engine reads.  Attributes
that the base tables lack (providers, feasibility, labels) are derived from keys and counts.  NOW is the point in time of
every freshness rule here; operators take it as a parameter.
"""

NOW = "DATE '2001-06-01'"
MODES = "CASE mode_ix WHEN 0 THEN 'road' WHEN 1 THEN 'rail' WHEN 2 THEN 'sea' ELSE 'air' END"

ENTITIES = {
    "observations": """
SELECT s_nationkey AS from_id, c_nationkey AS to_id, l_linenumber % 4 AS mode_ix, l_orderkey, l_linenumber,
  CAST(round(l_extendedprice * 100) AS BIGINT) AS cents, CAST(round(l_discount * 100) AS BIGINT) AS pct,
  CAST(l_quantity AS BIGINT) AS qty, CAST(l_shipdate AS DATE) AS ship
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN supplier ON l_suppkey = s_suppkey
WHERE s_nationkey <> c_nationkey""",
    "segments": f"""
SELECT concat('S', CAST(from_id AS STRING), '-', CAST(to_id AS STRING), '-', CAST(mode_ix AS STRING)) AS segment_id,
  from_id, to_id, mode_ix, {MODES} AS mode, CAST(count(*) AS BIGINT) AS n,
  CAST(sum(cents * (100 - pct)) AS DOUBLE) / (count(*) * 1000000.0e0) AS cost,
  CAST(sum(qty) AS DOUBLE) / (count(*) * 1.0e0) AS time_days,
  CASE WHEN count(*) % 3 = 0 THEN NULL ELSE CAST(sum(pct) AS DOUBLE) / (count(*) * 10.0e0) END AS risk,
  (count(*) % 5) / 4.0e0 AS completeness, max(ship) AS observed_at, max(ship) + 90 AS expires_at,
  CASE WHEN count(*) % 7 = 0 THEN NULL ELSE concat('P', CAST(count(*) % 3 AS STRING)) END AS provider,
  CASE WHEN count(*) % 11 = 0 THEN 'invalid_cross_ocean' WHEN count(*) % 2 = 0 THEN 'feasible' END AS feasibility,
  CASE WHEN count(*) % 13 = 0 THEN 'synthetic' WHEN count(*) % 3 = 1 THEN 'provider' ELSE 'estimated' END AS data_status,
  CASE WHEN count(*) % 17 = 0 THEN concat('Z', CAST(to_id % 7 AS STRING), '|Z7')
    WHEN count(*) % 2 = 0 THEN concat('Z', CAST(to_id % 7 AS STRING)) END AS zone_ids
FROM observations GROUP BY from_id, to_id, mode_ix""",
    "locations": """
SELECT n_nationkey AS location_id, n_name AS name, r_name AS region, concat('LOC-', CAST(n_nationkey AS STRING)) AS code,
  -60.0e0 + 5 * n_nationkey AS lat, -170.0e0 + 13 * n_nationkey AS lng,
  CASE WHEN n_nationkey % 3 = 0 THEN 'Port' WHEN n_nationkey % 3 = 1 THEN 'Airport' ELSE 'RailTerminal' END AS kind,
  CASE WHEN n_nationkey % 4 <> 0 THEN concat('Harbour ', CAST(n_nationkey AS STRING), '|', lower(n_name)) END AS aliases
FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "gated": f"""
SELECT segment_id, from_id, to_id, mode, cost, time_days, provider,
  CASE WHEN provider IS NOT NULL AND expires_at > {NOW} THEN risk END AS risk,
  CASE WHEN provider IS NOT NULL AND expires_at > {NOW} THEN completeness ELSE 0.0e0 END AS completeness,
  CASE WHEN provider IS NULL OR expires_at <= {NOW} OR risk IS NULL THEN 'unavailable'
    WHEN completeness >= 1 THEN 'available' ELSE 'partial' END AS status
FROM segments""",
    "weighted_edges": """
SELECT segment_id, from_id, to_id, mode, cost, time_days, risk,
  CASE WHEN risk IS NULL THEN 1.0e0 WHEN greatest(risk, 0) + (1 - completeness) * 0.25e0 > 1 THEN 1.0e0
    ELSE round(greatest(risk, 0) + (1 - completeness) * 0.25e0, 6) END AS w_risk,
  CASE WHEN cost IS NULL THEN 1.0e9 WHEN cost < 1.0e-6 THEN 1.0e-6 ELSE cost END AS w_cost,
  CASE WHEN time_days IS NULL THEN 1.0e9 WHEN time_days < 1.0e-6 THEN 1.0e-6 ELSE time_days END AS w_time
FROM gated""",
    "vessel_obs": """
SELECT event_id, user_id AS mmsi, ts AS observed_at, CAST(round(value * 100) AS BIGINT) AS speed100, event_type,
  CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'view' THEN 5 WHEN 'purchase' THEN 8 END AS nav_code,
  CAST(regexp_extract(props, '[0-9]+', 0) AS BIGINT) AS k
FROM events""",
    "positions": "SELECT *, (k - 50) * 1.0e0 AS lat, ((mmsi * 7) % 360) - 180.0e0 AS lng FROM vessel_obs",
    "targets": """
SELECT 'T1' AS target_id, -30.0e0 AS south, -120.0e0 AS west, 10.0e0 AS north, 0.0e0 AS east, 40 AS reference_count,
  10000 AS slow100, 'LOC-9' AS port_ids, CAST(NULL AS STRING) AS zone_id
UNION ALL SELECT 'T2', 0.0e0, -60.0e0, 40.0e0, 90.0e0, 30, 8000, 'LOC-12|LOC-15', NULL
UNION ALL SELECT 'T3', -50.0e0, 60.0e0, 50.0e0, 180.0e0, 60, 12000, NULL, 'Z3'
UNION ALL SELECT 'T4', 49.0e0, -180.0e0, 60.0e0, -170.0e0, 5, 5000, NULL, NULL""",
    "inside": """
SELECT target_id, mmsi, observed_at, event_id, speed100, nav_code, slow100, reference_count
FROM positions JOIN targets ON lat BETWEEN south AND north AND lng BETWEEN west AND east""",
    "suppliers_from": """
SELECT s_suppkey AS supplier_id, s_name AS name, s_nationkey AS origin_id, s_acctbal FROM supplier
WHERE s_suppkey % 7 <> 0""",
    "route_segments": """
SELECT concat('R', CAST(from_id AS STRING), '-', CAST(mode_ix AS STRING)) AS route_id, segment_id, from_id, to_id, mode,
  cost, time_days, risk, completeness, provider,
  row_number() OVER (PARTITION BY from_id, mode_ix ORDER BY to_id, segment_id) AS sequence FROM segments""",
    "factors": """
SELECT segment_id, 'war' AS factor, 0.40e0 AS weight, risk AS score, completeness AS confidence, provider, observed_at,
  expires_at FROM segments
UNION ALL SELECT segment_id, 'natural_disaster', 0.35e0, CASE WHEN n % 2 = 0 THEN completeness END,
  CASE WHEN n % 6 <> 0 THEN 0.5e0 END, provider, observed_at - 7, expires_at - 30 FROM segments
UNION ALL SELECT segment_id, 'trade_policy', 0.25e0, CASE WHEN n % 4 <> 1 THEN least(time_days / 50, 1.0e0) END,
  0.75e0, provider, observed_at, expires_at + 30 FROM segments""",
    "articles": """
SELECT doc_id AS article_id, regexp_extract(text, '^[^\\n]*', 0) AS title, text AS body, source AS domain, lang,
  doc_id AS minute FROM documents""",
    "news": """
SELECT article_id, domain, minute, concat('Z', CAST(article_id % 7 AS STRING)) AS zone_id,
  concat(title, CASE article_id % 10 WHEN 0 THEN ' Port strike after missile attack' WHEN 1 THEN ' earthquake and tsunami'
    WHEN 2 THEN ' customs delay, export ban' WHEN 3 THEN ' warfare studies' WHEN 4 THEN ' tariffs; duty'
    WHEN 5 THEN ' channel blocked by grounding' WHEN 6 THEN ' walkout' ELSE '' END) AS title,
  concat('https://', domain, '.example/', CAST(article_id % 400 AS STRING)) AS url,
  CASE article_id % 6 WHEN 0 THEN '20240110T093000Z' WHEN 1 THEN '20240109183000' WHEN 2 THEN '2024-01-10T08:15:00Z'
    WHEN 3 THEN '2024-01-09 06:00:00' WHEN 4 THEN '2024-01-08T22:00:00+02:00'
    ELSE CASE WHEN article_id % 12 = 5 THEN '20240301T000000Z' ELSE 'last week' END END AS seen_at
FROM articles""",
    "weather_hourly": """
SELECT user_id % 25 AS point_id, date_trunc('hour', ts) AS hour, CAST(round(max(value) * 100) AS BIGINT) AS wind100,
  CAST(count(*) AS BIGINT) AS samples FROM events GROUP BY user_id % 25, date_trunc('hour', ts)""",
    "forecasts": """
SELECT point_id, hour, samples, wind100 / 400.0e0 AS wind, CASE WHEN samples % 4 <> 0 THEN wind100 / 300.0e0 END AS gust,
  (samples % 9) * 1.5e0 AS precipitation, CASE WHEN point_id % 5 <> 0 THEN 500.0e0 * (1 + samples % 30) END AS visibility,
  CASE WHEN point_id % 3 = 0 THEN wind100 / 8000.0e0 END AS wave, (wind100 % 70) - 20.0e0 AS temperature,
  (samples % 5) * 0.8e0 AS snowfall,
  CASE samples % 8 WHEN 0 THEN 0 WHEN 1 THEN 3 WHEN 2 THEN 45 WHEN 3 THEN 61 WHEN 4 THEN 75 WHEN 5 THEN 95 WHEN 6 THEN 81
    END AS code
FROM weather_hourly""",
    "zones": """
SELECT concat('Z', CAST(location_id % 7 AS STRING)) AS zone_id, min(lat) AS lat, min(lng) AS lng,
  500.0e0 + 200 * (location_id % 7) AS radius_km FROM locations GROUP BY location_id % 7""",
    "existing": """
SELECT c_custkey AS k, CAST(round(c_acctbal * 100) AS BIGINT) AS v, c_custkey % 13 <> 0 AS active FROM customer""",
    "desired": """
SELECT c_custkey AS k, CAST(round(c_acctbal * 100) AS BIGINT) + CASE WHEN c_custkey % 10 = 0 THEN 100 ELSE 0 END AS v
FROM customer WHERE c_custkey % 17 <> 0
UNION ALL SELECT -1 - c_custkey, CAST(7 AS BIGINT) FROM customer WHERE c_custkey < 5""",
}
