"""Joins: equi, outer, semi, anti, OR, range, as-of, time band, priority and reconciliation (section C)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideway.functions.geo import ends, haversine, haversine_sql, pairs
from tideway.operators.filters import active, items
from tideway.sources.silver import NOW
from tideway.sources.tables import Net, operator


def named(t: Net, end: str, *columns: str) -> DataFrame:
    """Locations as the ``end`` (from, to) of a segment: <end>_id and <end>_<column>."""
    return t.locations.select(F.col("location_id").alias(f"{end}_id"), *[F.col(c).alias(f"{end}_{c}") for c in columns])


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in an order; a sort inside the key's partition, without a second shuffle."""
    return rows.withColumn("place_", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("place_ = 1").drop("place_")


def asof_nearest(left: DataFrame, right: DataFrame, key: str, at: str, time: str, slot: int) -> DataFrame:
    """Each row of ``left`` (key, at) with the row of ``right`` (key, time) nearest in time, the earlier one of two; none
    for rows outside the key's first and last time.

    ``time`` is regular, one row in ``slot`` seconds at most, so a left row looks at the slots before and after its own
    only; rows whose neighbours are further off are settled by the last and next filled slot of the key.
    """
    slots = right.withColumn("slot_", F.floor(F.unix_timestamp(F.col(time).cast("timestamp")) / slot))
    by = Window.partitionBy(key).orderBy("slot_")
    # Every filled slot also answers for the gap behind it, up to the next filled one.
    spans = slots.withColumn("next_slot_", F.lead("slot_").over(by)).withColumn("next_time_", F.lead(time).over(by))
    gaps = spans.withColumn("own_", F.explode(F.sequence("slot_", F.coalesce(F.col("next_slot_") - 1, "slot_"))))
    seen = left.withColumn("own_", F.floor(F.unix_micros(F.col(at).cast("timestamp")) / (slot * 1_000_000)))
    met = seen.join(gaps, [key, "own_"])
    seconds = lambda a, b: F.abs(F.floor(F.unix_micros(F.col(a).cast("timestamp")) / 1_000_000) - F.unix_timestamp(F.col(b).cast("timestamp")))
    later = F.col("next_time_").isNotNull() & (seconds(at, "next_time_") < seconds(at, time))
    inside = (F.col(at) == F.col(time)) | F.col("next_time_").isNotNull()
    return met.filter(inside).withColumn(time, F.when(later, F.col("next_time_")).otherwise(F.col(time))).drop("own_", "slot_", "next_slot_", "next_time_")


@operator("""SELECT s.segment_id, a.name AS from_name, b.name AS to_name FROM segments s
JOIN locations a ON s.from_id = a.location_id JOIN locations b ON s.to_id = b.location_id""")
def segment_endpoints(t: Net) -> DataFrame:
    return t.segments.select("segment_id", "from_id", "to_id").join(named(t, "from", "name"), "from_id").join(named(t, "to", "name"), "to_id").select("segment_id", "from_name", "to_name")


@operator("SELECT l.location_id, s.segment_id FROM locations l LEFT JOIN segments s ON l.location_id = s.from_id")
def segment_routes_left(t: Net) -> DataFrame:
    return t.locations.join(t.segments, F.col("location_id") == F.col("from_id"), "left").select("location_id", "segment_id")


@operator(f"SELECT l.location_id, s.segment_id FROM locations l LEFT JOIN (SELECT * FROM segments WHERE expires_at > {NOW}) s ON l.location_id = s.from_id")
def segment_active_exposures(t: Net) -> DataFrame:
    live = t.segments.filter(active("expires_at", F.expr(NOW))).select("from_id", "segment_id")
    return t.locations.join(live, F.col("location_id") == F.col("from_id"), "left").select("location_id", "segment_id")


@operator("""SELECT s.segment_id, o.l_orderkey, o.ship FROM segments s LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY from_id, to_id, mode_ix
  ORDER BY ship DESC NULLS FIRST, l_orderkey, l_linenumber) AS r FROM observations) o
  ON s.from_id = o.from_id AND s.to_id = o.to_id AND s.mode_ix = o.mode_ix AND o.r = 1""")
def latest_observation_join(t: Net) -> DataFrame:
    key = ["from_id", "to_id", "mode_ix"]
    # The least of a struct needs no sort and is combined before the shuffle.
    newest = t.observations.groupBy(*key).agg(F.min(F.struct((-F.unix_date("ship")).alias("d"), "l_orderkey", "l_linenumber", "ship")).alias("o"))
    return t.segments.select("segment_id", *key).join(newest, key, "left").select("segment_id", "o.l_orderkey", "o.ship")


@operator("""SELECT segment_id, cost FROM segments WHERE segment_id IN ('S1-2-0', 'S1-2-1', 'S0-5-2', 'none')""")
def values_join(t: Net) -> DataFrame:
    wanted = t.spark.createDataFrame([("S1-2-0",), ("S1-2-1",), ("S0-5-2",), ("none",)], "segment_id string")
    return t.segments.join(F.broadcast(wanted), "segment_id").select("segment_id", "cost")


@operator("""SELECT DISTINCT f.supplier_id, l.location_id FROM suppliers_from f JOIN locations l
ON f.origin_id = l.location_id OR f.name = l.code OR l.name = (SELECT n_name FROM nation WHERE n_nationkey = f.origin_id)""")
def supplier_origin_resolution(t: Net) -> DataFrame:
    """An OR of equalities as a union of equi joins, so that no nested loop is needed."""
    f, place = t.suppliers_from.select("supplier_id", "origin_id", "name"), t.locations.select("location_id", "code", F.col("name").alias("place_name"))
    by_id = f.join(place, F.col("origin_id") == F.col("location_id"))
    by_code = f.join(place, F.col("name") == F.col("code"))
    by_name = f.join(t.nation, F.col("origin_id") == F.col("n_nationkey")).join(place, F.col("n_name") == F.col("place_name"))
    return by_id.select("supplier_id", "location_id").union(by_code.select("supplier_id", "location_id")).union(by_name.select("supplier_id", "location_id")).distinct()


@operator("SELECT from_id AS node FROM segments UNION SELECT to_id FROM segments")
def distinct_route_nodes(t: Net) -> DataFrame:
    return t.segments.select(F.explode(F.array("from_id", "to_id")).alias("node")).distinct()


@operator("SELECT s_suppkey FROM supplier WHERE s_suppkey IN (SELECT supplier_id FROM suppliers_from)")
def suppliers_with_origin(t: Net) -> DataFrame:
    return t.supplier.join(t.suppliers_from, F.col("s_suppkey") == F.col("supplier_id"), "left_semi").select("s_suppkey")


@operator("SELECT s_suppkey FROM supplier EXCEPT SELECT supplier_id FROM suppliers_from")
def missing_canonical_edge(t: Net) -> DataFrame:
    return t.supplier.join(t.suppliers_from, F.col("s_suppkey") == F.col("supplier_id"), "left_anti").select("s_suppkey")


REGIONAL = """(SELECT s.from_id, s.to_id FROM segments s JOIN locations a ON s.from_id = a.location_id JOIN locations b ON s.to_id = b.location_id
  WHERE s.mode = 'sea' AND a.kind = 'Port' AND b.kind = 'Port' AND a.region = b.region)"""


def regional(t: Net) -> DataFrame:
    """Sea segments between two ports of one region."""
    ports = t.segments.filter("mode = 'sea'").join(named(t, "from", "kind", "region"), "from_id").join(named(t, "to", "kind", "region"), "to_id")
    return ports.filter("from_kind = 'Port' and to_kind = 'Port' and from_region = to_region").select("from_id", "to_id")


@operator(f"""SELECT location_id FROM locations WHERE NOT EXISTS (SELECT 1 FROM {REGIONAL} s WHERE s.from_id = location_id)
AND NOT EXISTS (SELECT 1 FROM {REGIONAL} s WHERE s.to_id = location_id)
UNION ALL SELECT 1000""")
def orphan_nodes(t: Net) -> DataFrame:
    """Nodes without any edge of the regional sea network, out or in; one node without an edge of any kind is added."""
    used = regional(t).select(F.explode(F.array("from_id", "to_id")).alias("location_id"))
    return t.locations.select("location_id").union(t.spark.range(1000, 1001).select(F.col("id").cast("int"))).join(used, "location_id", "left_anti")


@operator("SELECT event_id, target_id FROM positions JOIN targets ON lat >= south AND lat <= north AND lng >= west AND lng <= east")
def bbox_range_join(t: Net) -> DataFrame:
    boxes = F.broadcast(t.targets.select("target_id", "south", "west", "north", "east"))
    return t.positions.select("event_id", "lat", "lng").join(boxes, F.expr("lat between south and north and lng between west and east")).select("event_id", "target_id")


@operator("""SELECT event_id, hour FROM (SELECT e.event_id, w.hour, row_number() OVER (PARTITION BY e.event_id
  ORDER BY abs(floor(epoch(e.ts)) - epoch(w.hour)), w.hour) AS r FROM events e JOIN weather_hourly w ON w.point_id = (e.user_id + 1) % 25
  JOIN (SELECT point_id, min(hour) AS a, max(hour) AS z FROM weather_hourly GROUP BY point_id) b ON b.point_id = w.point_id AND e.ts BETWEEN b.a AND b.z) x WHERE r = 1""")
def asof_nearest_hour(t: Net) -> DataFrame:
    seen = t.events.select("event_id", "ts", ((F.col("user_id") + 1) % 25).alias("point_id"))
    hours = t.weather_hourly.select("point_id", "hour")
    return asof_nearest(seen, hours, "point_id", "ts", "hour", 3600).select("event_id", "hour")


@operator("""SELECT location_id FROM (SELECT location_id, CASE WHEN lower(name) = 'nation_1' THEN 1 ELSE 0 END AS exact,
  max(CASE WHEN lower(name) = 'nation_1' THEN 1 ELSE 0 END) OVER () AS any_exact FROM locations WHERE lower(name) LIKE '%nation_1%') x WHERE exact = any_exact""")
def node_match_exact_or_partial(t: Net) -> DataFrame:
    """Exact matches if there are any, else all that contain the text; only one flag is shared between the two."""
    name, wanted = F.lower("name"), "nation_1"
    found = t.locations.filter(name.contains(wanted)).select("location_id", (name == wanted).alias("exact"))
    best = found.agg(F.max("exact").alias("any_exact"))
    return found.join(F.broadcast(best), F.col("exact") == F.col("any_exact")).select("location_id")


@operator("""WITH m AS (SELECT location_id, code, name, region, aliases, kind, CASE WHEN kind = 'Port' THEN 1 ELSE 0 END AS bonus FROM locations),
c AS (SELECT location_id, 0 AS priority, bonus FROM m WHERE lower(code) = 'harbour 7' UNION ALL SELECT location_id, 1, bonus FROM m WHERE lower(name) = 'harbour 7'
  UNION ALL SELECT location_id, 2, bonus FROM m WHERE lower(region) = 'harbour 7' UNION ALL SELECT location_id, 3, bonus FROM m WHERE concat('|', lower(aliases), '|') LIKE '%|harbour 7|%'
  UNION ALL SELECT location_id, 4, bonus FROM m WHERE lower(name) LIKE '%harbour 7%' OR lower(name) LIKE '%7%')
SELECT location_id, CAST(priority AS INT) AS priority FROM c ORDER BY priority, bonus DESC, location_id LIMIT 1""")
def location_priority_lookup(t: Net) -> DataFrame:
    """The best match of a text over several fields: the field's priority, then ports first, then the id."""
    wanted, part = "harbour 7", "7"
    rank = F.coalesce(
        F.when(F.lower("code") == wanted, 0),
        F.when(F.lower("name") == wanted, 1),
        F.when(F.lower("region") == wanted, 2),
        F.when(F.exists(items("aliases"), lambda x: F.lower(x) == wanted), 3),
        F.when(F.lower("name").contains(part), 4),
    )
    found = t.locations.withColumn("priority", rank).filter("priority is not null")
    return found.orderBy("priority", F.when(F.col("kind") == "Port", 0).otherwise(1), "location_id").limit(1).select("location_id", "priority")


@operator("""SELECT DISTINCT f.supplier_id, s.from_id FROM suppliers_from f JOIN segments s
ON concat('NATION', CAST(f.origin_id AS STRING)) = upper(replace(concat('nation_', CAST(s.from_id AS STRING)), '_', ''))""")
def supplier_origin_overlap(t: Net) -> DataFrame:
    """Suppliers and segments whose sets of normalised ids meet."""
    norm = lambda c: F.upper(F.regexp_replace(c, "[-_]", ""))
    own = t.suppliers_from.join(named(t, "origin", "name", "code"), "origin_id").select("supplier_id", F.explode(F.array(norm("origin_name"), norm("origin_code"))).alias("norm"))
    edge = t.segments.select("from_id").distinct().join(named(t, "from", "name", "code"), "from_id").select("from_id", F.explode(F.array(norm("from_name"), norm("from_code"))).alias("norm"))
    return own.join(edge, "norm").select("supplier_id", "from_id").distinct()


@operator("""SELECT s_suppkey, s_name FROM supplier WHERE lower(s_name) LIKE '%7%' ORDER BY lower(s_name) <> 'supplier#000000007', s_name LIMIT 1""")
def supplier_best_match(t: Net) -> DataFrame:
    name = F.lower("s_name")
    return t.supplier.filter(name.contains("7")).orderBy(F.when(name == "supplier#000000007", 0).otherwise(1), "s_name").limit(1).select("s_suppkey", "s_name")


@operator("SELECT (SELECT CAST(count(*) AS BIGINT) FROM locations) AS nodes, (SELECT CAST(count(*) AS BIGINT) FROM segments) AS edges")
def graph_totals(t: Net) -> DataFrame:
    one = lambda df, name: df.agg(F.count("*").alias(name))
    return one(t.locations, "nodes").join(F.broadcast(one(t.segments, "edges")))


def reconciled(existing: DataFrame, desired: DataFrame, key: str, value: str) -> DataFrame:
    """(key, action) that bring ``existing`` (key, value, active) to ``desired`` (key, value): insert, update, deactivate."""
    digest = lambda side: F.sha2(F.col(f"{side}.{value}").cast("string"), 256)
    both = existing.alias("e").join(desired.alias("d"), F.col(f"e.{key}") == F.col(f"d.{key}"), "full")
    old, new = F.col(f"e.{key}"), F.col(f"d.{key}")
    action = (
        F.when(old.isNull(), "insert")
        .when(new.isNull(), F.when(F.col("e.active"), "deactivate"))
        .when((digest("e") != digest("d")) | ~F.col("e.active"), "update")
    )
    return both.select(F.coalesce(old, new).alias(key), action.alias("action")).filter("action is not null")


@operator("""SELECT k, 'insert' AS action FROM desired WHERE k NOT IN (SELECT k FROM existing)
UNION ALL SELECT k, 'deactivate' FROM existing WHERE active AND k NOT IN (SELECT k FROM desired)
UNION ALL SELECT e.k, 'update' FROM existing e JOIN desired d ON e.k = d.k WHERE e.v <> d.v OR NOT e.active""")
def hash_diff_plan(t: Net) -> DataFrame:
    return reconciled(t.existing, t.desired, "k", "v")


@operator("""SELECT s.segment_id, CASE WHEN a.w IS NOT NULL AND b.w IS NOT NULL THEN round((4 * a.w + 6 * b.w) / 1000.0e0, 6) ELSE round(coalesce(a.w, b.w) / 100.0e0, 6) END AS weather,
  CASE WHEN a.w IS NOT NULL AND b.w IS NOT NULL THEN round(0.35e0 * least(a.c, b.c), 6) ELSE round(0.35e0 * coalesce(a.c, b.c), 6) END AS confidence
FROM segments s LEFT JOIN (SELECT point_id, max(wind100) AS w, least(count(*) / 24.0e0, 1.0e0) AS c FROM weather_hourly WHERE point_id % 4 <> 0 GROUP BY point_id) a ON s.from_id = a.point_id
LEFT JOIN (SELECT point_id, max(wind100) AS w, least(count(*) / 24.0e0, 1.0e0) AS c FROM weather_hourly WHERE point_id % 4 <> 0 GROUP BY point_id) b ON s.to_id = b.point_id""")
def endpoint_weather_propagation(t: Net) -> DataFrame:
    """The weather of both ends, 0.4 to 0.6, or of the one that has any; confidence is 0.35 of the lower one."""
    ends_ = t.weather_hourly.filter("point_id % 4 <> 0").groupBy("point_id").agg((F.max("wind100") / 100).alias("w"), F.least(F.count("*") / 24.0, F.lit(1.0)).alias("c"))
    end = lambda k: ends_.select(F.col("point_id").alias(f"{k}_id"), F.col("w").alias(f"{k}_w"), F.col("c").alias(f"{k}_c"))
    rows = t.segments.select("segment_id", "from_id", "to_id").join(end("from"), "from_id", "left").join(end("to"), "to_id", "left")
    blend = F.coalesce(0.4 * F.col("from_w") + 0.6 * F.col("to_w"), "from_w", "to_w")
    return rows.select("segment_id", F.round(blend, 6).alias("weather"), F.round(0.35 * F.least("from_c", "to_c"), 6).alias("confidence"))


@operator("""SELECT segment_id, 'endpoint' AS via FROM segments WHERE mode = 'sea' AND (from_id = 7 OR to_id = 7)
UNION SELECT s.segment_id, 'zone' FROM segments s JOIN locations l ON s.to_id = l.location_id WHERE s.mode = 'sea' AND l.location_id % 6 = 0""")
def traffic_exposure(t: Net) -> DataFrame:
    sea = t.segments.filter("mode = 'sea'")
    ends_ = sea.withColumn("end", F.explode(F.array("from_id", "to_id"))).filter("end = 7").select("segment_id", F.lit("endpoint").alias("via"))
    zone = t.locations.filter("location_id % 6 = 0").select(F.col("location_id").alias("to_id"))
    return ends_.union(sea.join(F.broadcast(zone), "to_id", "left_semi").select("segment_id", F.lit("zone"))).distinct()


@operator("""SELECT r.route_id, CAST(count(DISTINCT a.article_id) AS BIGINT) AS articles, CAST(count(DISTINCT a.domain) AS BIGINT) AS domains, max(a.article_id) AS newest
FROM route_segments r JOIN segments s ON s.segment_id = r.segment_id JOIN news a ON concat('|', s.zone_ids, '|') LIKE concat('%|', a.zone_id, '|%') GROUP BY r.route_id""")
def route_risk_news(t: Net) -> DataFrame:
    """The news of all zones that any leg of a route passes, each article once a route.

    Routes and zones are made distinct, and articles rolled up by zone, before they meet: a zone's articles are counted
    once, not for each of its legs.
    """
    zones = t.route_segments.select("route_id", "segment_id").join(t.segments.select("segment_id", F.explode(items("zone_ids")).alias("zone_id")), "segment_id")
    by_zone = t.news.groupBy("zone_id").agg(F.count_distinct("article_id").alias("articles"), F.collect_set("domain").alias("domains"), F.max("article_id").alias("newest"))
    met = zones.select("route_id", "zone_id").distinct().join(by_zone, "zone_id")
    all_domains = F.size(F.array_distinct(F.flatten(F.collect_list("domains")))).cast("long")
    return met.groupBy("route_id").agg(F.sum("articles").alias("articles"), all_domains.alias("domains"), F.max("newest").alias("newest"))


@operator("""SELECT l.location_id, coalesce(x.lat, z.lat, y.lat, -1.0e0) AS lat, CASE WHEN x.lat IS NOT NULL THEN 'sourced' WHEN z.lat IS NOT NULL THEN 'curated' WHEN y.lat IS NOT NULL THEN 'estimated' ELSE 'unavailable' END AS status
FROM locations l LEFT JOIN locations x ON l.location_id = x.location_id AND x.location_id % 3 <> 0
LEFT JOIN (SELECT 6 AS location_id, 31.5e0 AS lat UNION ALL SELECT 7, 12.0e0) z ON l.location_id = z.location_id
LEFT JOIN (SELECT region, min(lat) AS lat FROM locations WHERE location_id % 3 <> 0 AND region <> 'ASIA' GROUP BY region) y ON l.region = y.region""")
def coordinate_cascade(t: Net) -> DataFrame:
    """Coordinates from the first source that has them: the record, a curated list, the region's first known place."""
    known = t.locations.filter("location_id % 3 <> 0")
    sourced = known.select("location_id", F.col("lat").alias("sourced"))
    curated = t.spark.createDataFrame([(6, 31.5), (7, 12.0)], "location_id int, curated double")
    nearby = known.filter("region <> 'ASIA'").groupBy("region").agg(F.min("lat").alias("estimated"))
    rows = t.locations.join(sourced, "location_id", "left").join(F.broadcast(curated), "location_id", "left").join(F.broadcast(nearby), "region", "left")
    steps = ["sourced", "curated", "estimated"]
    status = F.coalesce(*[F.when(F.col(c).isNotNull(), c) for c in steps], F.lit("unavailable"))
    return rows.select("location_id", F.coalesce(*steps, F.lit(-1.0)).alias("lat"), status.alias("status"))


@operator("""SELECT alias, min(location_id) AS owner FROM (SELECT DISTINCT lower(alias) AS alias, location_id FROM
  (SELECT location_id, code AS alias FROM locations UNION ALL SELECT location_id, name FROM locations UNION ALL SELECT location_id, region FROM locations
   UNION ALL SELECT location_id, concat('OLD-', code) FROM locations) x) y GROUP BY alias HAVING count(*) = 1""")
def alias_ownership(t: Net) -> DataFrame:
    """Aliases that belong to exactly one location, old ids included; shared ones have no owner."""
    names = F.array("code", "name", "region", F.concat(F.lit("OLD-"), "code"))
    owned = t.locations.select("location_id", F.explode(F.transform(names, F.lower)).alias("alias")).distinct()
    return owned.groupBy("alias").agg(F.min("location_id").alias("owner"), F.count("*").alias("n")).filter("n = 1").select("alias", "owner")


@operator("""SELECT a.point_id, a.i, a.wind100, b.samples FROM (SELECT point_id, wind100, row_number() OVER (PARTITION BY point_id ORDER BY hour) AS i FROM weather_hourly) a
LEFT JOIN (SELECT point_id, samples, row_number() OVER (PARTITION BY point_id ORDER BY hour DESC) AS i FROM weather_hourly) b ON a.point_id = b.point_id AND a.i = b.i WHERE a.i <= 24""")
def positional_hour_merge(t: Net) -> DataFrame:
    """Two series of a point by position, the second one backwards, 24 hours as the merge is defined."""
    number = lambda order: F.row_number().over(Window.partitionBy("point_id").orderBy(order))
    rows = t.weather_hourly.select("point_id", "wind100", "samples", number("hour").alias("i"), number(F.desc("hour")).alias("j"))
    return rows.filter("i <= 24").select("point_id", "i", "wind100").join(rows.select("point_id", F.col("j").alias("i"), "samples"), ["point_id", "i"], "left")


@operator("""SELECT s.segment_id, CASE WHEN s.zone_ids IS NOT NULL THEN 'spatial' WHEN s.data_status = 'provider' THEN 'none' WHEN z.zone_id IS NOT NULL THEN 'inferred' ELSE 'none' END AS method
FROM segments s LEFT JOIN (SELECT DISTINCT zone_id FROM zones WHERE radius_km > 1000) z ON z.zone_id = concat('Z', CAST(s.from_id % 7 AS STRING))""")
def zone_exposure_resolution(t: Net) -> DataFrame:
    """Spatial exposures win; segments that were processed and have none stay without; others take the inferred ones."""
    wide = t.zones.filter("radius_km > 1000").select("zone_id", F.lit(True).alias("near"))
    rows = t.segments.withColumn("zone_id", F.concat(F.lit("Z"), (F.col("from_id") % 7).cast("string"))).join(F.broadcast(wide), "zone_id", "left")
    method = F.when(F.size(items("zone_ids")) > 0, "spatial").when(F.col("data_status") == "provider", "none").when(F.col("near"), "inferred").otherwise("none")
    return rows.select("segment_id", method.alias("method"))


#: How far a mode goes in km, and the detour factor of the distance.
REACH = {"road": (5000.0, 1.0), "rail": (12000.0, 1.18)}


@operator(f"""WITH p AS (SELECT DISTINCT a.location_id AS a, b.location_id AS b, a.kind AS ka, b.kind AS kb, a.region = b.region AS same, {haversine_sql('a', 'b')} AS km
  FROM segments s JOIN locations a ON s.from_id = a.location_id JOIN locations b ON s.to_id = b.location_id)
SELECT a, b, 'sea' AS mode, CASE WHEN ka = 'Port' AND kb = 'Port' THEN 'feasible' ELSE 'not_both_ports' END AS status FROM p
UNION ALL SELECT a, b, 'air', CASE WHEN ka = 'Airport' AND kb = 'Airport' THEN 'feasible' ELSE 'not_both_airports' END FROM p
UNION ALL SELECT a, b, 'rail', CASE WHEN NOT same THEN 'other_landmass' WHEN km * 1.18e0 > 12000 THEN 'too_far' ELSE 'feasible' END FROM p
UNION ALL SELECT a, b, 'road', CASE WHEN NOT same THEN 'other_landmass' WHEN km > 5000 THEN 'too_far' ELSE 'feasible' END FROM p""")
def mode_feasibility(t: Net) -> DataFrame:
    """For each pair of places the four modes, feasible or with the first reason why not."""
    place = lambda x: t.locations.select(F.col("location_id").alias(x), F.col("kind").alias(f"kind_{x}"), F.col("region").alias(f"region_{x}"))
    rows = pairs(t).join(place("a"), "a").join(place("b"), "b").withColumn("km", haversine(*ends()))
    both = lambda kind: (F.col("kind_a") == kind) & (F.col("kind_b") == kind)
    land = lambda mode: F.when(F.col("region_a") != F.col("region_b"), "other_landmass").when(F.col("km") * REACH[mode][1] > REACH[mode][0], "too_far").otherwise("feasible")
    status = {
        "sea": F.when(both("Port"), "feasible").otherwise("not_both_ports"),
        "air": F.when(both("Airport"), "feasible").otherwise("not_both_airports"),
        "rail": land("rail"),
        "road": land("road"),
    }
    modes = F.explode(F.array(*[F.struct(F.lit(m).alias("mode"), s.alias("status")) for m, s in status.items()])).alias("m")
    return rows.select("a", "b", modes).select("a", "b", "m.mode", "m.status")
