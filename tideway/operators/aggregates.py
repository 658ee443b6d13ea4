"""Aggregations: counts, renormalised means, rollups, argmax, blends (section D)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideway.operators.filters import checkpointed, items
from tideway.sources.tables import Net, operator

#: The other engine's text for a renormalised mean over factors with a provider, and the weight that it rests on.
MEAN = """CASE WHEN sum(CASE WHEN score IS NOT NULL AND provider IS NOT NULL THEN weight END) > 0
  THEN round(sum(CASE WHEN provider IS NOT NULL THEN score * weight END) / sum(CASE WHEN score IS NOT NULL AND provider IS NOT NULL THEN weight END) + 1e-10, 6) END"""
USED = "round(coalesce(sum(CASE WHEN score IS NOT NULL AND provider IS NOT NULL THEN weight END), 0) + 1e-10, 4)"


def rounded(x: Column, digits: int = 6) -> Column:
    """Half up also where the sum of doubles falls a little short of it, in whatever order it was added."""
    return F.round(x + 1e-10, digits)


def weighted_mean(value: Column, weight: Column, given: Column) -> tuple[Column, Column]:
    """(mean over the given values, weight that they carry): weights are scaled up to the values that exist."""
    there = F.when(value.isNotNull() & given, weight)
    total = F.sum(there)
    return F.when(total > 0, F.sum(F.when(given, value * weight)) / total), F.coalesce(total, F.lit(0.0))


def status_of(completeness: Column) -> Column:
    return F.when(completeness >= 0.9999, "available").when(completeness > 0, "partial").otherwise("unavailable")


def top3_blend(scores: str | Column) -> Column:
    """0.7 of the best score and 0.3 of the mean of the best three, 1 at most, as an aggregate."""
    best = F.slice(F.sort_array(F.collect_list(scores), asc=False), 1, 3)
    mean = F.aggregate(best, F.lit(0.0), lambda a, x: a + x) / F.size(best)
    return F.when(F.size(best) > 0, F.least(F.lit(1.0), 0.7 * F.get(best, 0) + 0.3 * mean))


@operator("SELECT mode, provider, CAST(count(*) AS BIGINT) AS n FROM segments GROUP BY mode, provider")
def count_by_group(t: Net) -> DataFrame:
    return t.segments.groupBy("mode", "provider").agg(F.count("*").alias("n"))


@operator("""SELECT CAST(count(*) AS BIGINT) AS total, CAST(sum(CASE WHEN risk IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS with_risk,
  CAST(sum(CASE WHEN provider IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS without_provider FROM segments""")
def coverage_counts(t: Net) -> DataFrame:
    return t.segments.agg(F.count("*").alias("total"), F.count("risk").alias("with_risk"), F.count_if(F.col("provider").isNull()).alias("without_provider"))


@operator("""SELECT mode, CAST(count(DISTINCT from_id) AS BIGINT) AS origins, CAST(count(DISTINCT to_id) AS BIGINT) AS destinations FROM segments GROUP BY mode""")
def distinct_counts(t: Net) -> DataFrame:
    return t.segments.groupBy("mode").agg(F.count_distinct("from_id").alias("origins"), F.count_distinct("to_id").alias("destinations"))


@operator("""SELECT from_id, string_agg(x, ',' ORDER BY x) AS exposures, CAST(count(*) AS BIGINT) AS n FROM
 (SELECT DISTINCT s.from_id, concat(u.zone, ':', s.mode) AS x FROM segments s, unnest(string_split(s.zone_ids, '|')) AS u(zone)) y GROUP BY from_id
UNION ALL SELECT DISTINCT from_id, '', CAST(0 AS BIGINT) FROM segments WHERE from_id NOT IN (SELECT from_id FROM segments WHERE zone_ids IS NOT NULL)""")
def collect_exposures(t: Net) -> DataFrame:
    """The distinct (zone, mode) of each origin as a list of structs, without nulls, in order."""
    rows = t.segments.select("from_id", "mode", F.explode_outer(items("zone_ids")).alias("zone"))
    listed = F.sort_array(F.collect_set(F.when(F.col("zone").isNotNull(), F.struct("zone", "mode"))))
    found = rows.groupBy("from_id").agg(listed.alias("x"))
    return found.select("from_id", F.array_join(F.transform("x", lambda e: F.concat(e["zone"], F.lit(":"), e["mode"])), ",").alias("exposures"), F.size("x").cast("long").alias("n"))


@operator("SELECT from_id, segment_id FROM (SELECT from_id, segment_id, row_number() OVER (PARTITION BY from_id ORDER BY cost DESC, segment_id) AS r FROM segments) x WHERE r = 1")
def head_collect(t: Net) -> DataFrame:
    first = F.min(F.struct((-F.col("cost")).alias("c"), "segment_id"))
    return t.segments.groupBy("from_id").agg(first.alias("m")).select("from_id", "m.segment_id")


@operator("""SELECT route_id, CAST(row_number() OVER (ORDER BY penalty, route_id) AS BIGINT) AS place, legs, cost, penalty FROM (
 SELECT route_id, string_agg(segment_id, '>' ORDER BY sequence) AS legs, round(sum(cost) + 1e-10, 6) AS cost,
  round(CASE WHEN count(risk) = count(*) THEN max(risk) ELSE 1.0e0 END + 0.25e0 * (1 - avg(completeness)) + 1e-10, 6) AS penalty FROM route_segments GROUP BY route_id) x""")
def route_rollup_rank(t: Net) -> DataFrame:
    """Routes with their legs in order, cost and penalty, ranked: the rank is a route's number of better routes."""
    legs = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("sequence", "segment_id"))), lambda x: x["segment_id"]), ">")
    risk = F.when(F.count("risk") == F.count("*"), F.max("risk")).otherwise(1.0)
    routes = t.route_segments.groupBy("route_id").agg(legs.alias("legs"), rounded(F.sum("cost")).alias("cost"), rounded(risk + 0.25 * (1 - F.avg("completeness"))).alias("penalty"))
    return ranked(routes, ["penalty", "route_id"], "place")


def ranked(rows: DataFrame, order: list[str | Column], name: str) -> DataFrame:
    """Rows with their place (from 1) in a total order.

    Rows are sorted by range, numbered inside their partitions, and moved on by the sizes of the partitions before, so
    no task sees all rows.  The numbered rows are written once: a second execution would sample other range bounds, which
    the sizes of the first don't fit.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spread = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("id_", F.monotonically_increasing_id())
    numbered = checkpointed(spread.withColumn("part_", F.shiftright("id_", 33)).withColumn("at_", F.col("id_").bitwiseAND((1 << 33) - 1)))
    sizes = {r["part_"]: r["n"] for r in numbered.groupBy("part_").agg(F.count("*").alias("n")).collect()}
    before, total = [], 0
    for part in sorted(sizes):
        before.append((part, total))
        total += sizes[part]
    starts = spark.createDataFrame(before, "part_ long, start_ long")
    return numbered.join(F.broadcast(starts), "part_").select(*rows.columns, (F.col("start_") + F.col("at_") + 1).alias(name))


@operator("SELECT p_name, CAST(count(*) AS BIGINT) AS n FROM part GROUP BY p_name HAVING count(*) > 1")
def duplicate_ids(t: Net) -> DataFrame:
    return t.part.groupBy("p_name").agg(F.count("*").alias("n")).filter("n > 1")


def provider_scores(factors: DataFrame) -> DataFrame:
    """(segment_id, score, completeness, status) of a renormalised mean over the factors that a provider vouches for."""
    mean, used = weighted_mean(F.col("score"), F.col("weight"), F.col("provider").isNotNull())
    found = factors.groupBy("segment_id").agg(rounded(mean).alias("score"), rounded(used, 4).alias("completeness"))
    return found.withColumn("status", status_of(F.col("completeness")))


@operator(f"""SELECT segment_id, {MEAN} AS score, {USED} AS completeness,
  CASE WHEN {USED} >= 0.9999e0 THEN 'available' WHEN {USED} > 0 THEN 'partial' ELSE 'unavailable' END AS status FROM factors GROUP BY segment_id""")
def provider_risk(t: Net) -> DataFrame:
    return provider_scores(t.factors)


@operator("""SELECT segment_id, round(sum(confidence * weight) / nullif(sum(CASE WHEN confidence IS NOT NULL THEN weight END), 0) + 1e-10, 4) AS confidence,
  max(observed_at) AS observed_at, min(expires_at) AS expires_at FROM factors WHERE score IS NOT NULL AND provider IS NOT NULL GROUP BY segment_id""")
def provider_confidence(t: Net) -> DataFrame:
    """The mean confidence by weight over factors that have one; observed last, and expired with the first of them."""
    used = t.factors.filter("score is not null and provider is not null")
    mean, _ = weighted_mean(F.col("confidence"), F.col("weight"), F.lit(True))
    return used.groupBy("segment_id").agg(rounded(mean, 4).alias("confidence"), F.max("observed_at").alias("observed_at"), F.min("expires_at").alias("expires_at"))


@operator("""SELECT segment_id, zone_id, factor, score FROM (SELECT f.segment_id, u.zone AS zone_id, f.factor, f.score,
  row_number() OVER (PARTITION BY f.segment_id ORDER BY f.score DESC, f.factor, u.zone) AS r
FROM factors f JOIN segments s ON s.segment_id = f.segment_id, unnest(string_split(s.zone_ids, '|')) AS u(zone) WHERE f.score IS NOT NULL) x WHERE r = 1""")
def factor_argmax(t: Net) -> DataFrame:
    """The strongest factor of a segment over its zones."""
    zones = t.segments.select("segment_id", F.explode(items("zone_ids")).alias("zone_id"))
    rows = t.factors.filter("score is not null").select("segment_id", "factor", "score").join(zones, "segment_id")
    return rows.groupBy("segment_id").agg(F.min(F.struct((-F.col("score")).alias("c"), "factor", "zone_id", "score")).alias("m")).select("segment_id", "m.zone_id", "m.factor", "m.score")


@operator("""SELECT from_id, round(least(1.0e0, 0.7e0 * max(risk) + 0.3e0 * (sum(risk) / count(*))) + 1e-10, 6) AS score FROM (SELECT from_id, risk,
  row_number() OVER (PARTITION BY from_id ORDER BY risk DESC, segment_id) AS r FROM segments WHERE risk IS NOT NULL) x WHERE r <= 3 GROUP BY from_id""")
def zone_top3_blend(t: Net) -> DataFrame:
    return t.segments.filter("risk is not null").groupBy("from_id").agg(rounded(top3_blend("risk")).alias("score"))


@operator("SELECT point_id, round((6 * max(wind100) * count(*) + 4 * sum(wind100)) / (count(*) * 1000.0e0) + 1e-10, 6) AS score FROM weather_hourly GROUP BY point_id")
def route_weather_aggregate(t: Net) -> DataFrame:
    wind = F.col("wind100") / 100
    return t.weather_hourly.groupBy("point_id").agg(rounded(0.6 * F.max(wind) + 0.4 * F.avg(wind)).alias("score"))


@operator("SELECT event_type AS category, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY event_type")
def category_histogram(t: Net) -> DataFrame:
    counts = t.events.groupBy("event_type").agg(F.count("*").alias("n"))
    as_map = counts.agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("m"))  # one entry a category
    return as_map.select(F.explode("m").alias("category", "n"))


#: Weights of the congestion score.
CONGESTION = {"density": 0.35, "anchored": 0.30, "slow": 0.25, "imbalance": 0.10}


def congestion(inside: DataFrame, moves: DataFrame, hours: float) -> DataFrame:
    """Per target: congestion from vessel density, vessels at anchor, slow vessels, and arrivals against departures.

    ``inside``: observations in the target's area; ``moves`` (target_id, arrivals, departures).  A part that can't be
    known (no status, no transition window) is left out and the weights of the others are scaled up.
    """
    seconds = F.unix_micros(F.max("observed_at").cast("timestamp")) - F.unix_micros(F.min("observed_at").cast("timestamp"))
    facts = inside.groupBy("target_id").agg(
        F.count_distinct("mmsi").alias("vessels"),
        F.least(F.count_distinct("mmsi") / F.max("reference_count"), F.lit(1.0)).alias("density"),
        (F.count_if(F.col("nav_code").isin(1, 5)) / F.nullif(F.count("nav_code"), F.lit(0))).alias("anchored"),
        (F.count_if(F.col("speed100") <= F.col("slow100")) / F.nullif(F.count("speed100"), F.lit(0))).alias("slow"),
        (F.count("speed100") / F.count("*")).alias("speed_coverage"),
        (F.count("nav_code") / F.count("*")).alias("nav_coverage"),
        F.least(seconds / (hours * 3_600_000_000), F.lit(1.0)).alias("temporal"),
        F.max("observed_at").alias("observed_at"),
    )
    rows = facts.join(moves, "target_id", "left").fillna(0, ["arrivals", "departures"])
    both = F.col("arrivals") + F.col("departures")
    imbalance = F.when(F.col("temporal") >= 0.25, F.when(both > 0, F.greatest(F.col("arrivals") - F.col("departures"), F.lit(0)) / both).otherwise(0.0))
    rows = rows.withColumn("imbalance", imbalance)
    parts = [(F.col(k), w) for k, w in CONGESTION.items()]
    total = sum(F.coalesce(c * w, F.lit(0.0)) for c, w in parts)
    used = sum(F.when(c.isNotNull(), w).otherwise(0.0) for c, w in parts)
    certain = 0.35 * F.least(F.col("vessels") / 20, F.lit(1.0)) + 0.35 * F.col("temporal") + 0.15 * F.col("speed_coverage") + 0.15 * F.col("nav_coverage")
    complete = (1 + F.col("speed_coverage") + F.col("nav_coverage") + F.col("temporal")) / 4
    return rows.select(
        "target_id", "vessels", "arrivals", "departures", "observed_at", rounded(100 * total / used, 2).alias("score"), rounded(complete, 4).alias("completeness"), rounded(certain, 4).alias("confidence")
    )


def transitions(rows: DataFrame) -> DataFrame:
    """(target_id, arrivals, departures) from rows (target_id, mmsi, observed_at, event_id, inside) in time order."""
    from pyspark.sql import Window

    was = F.lag("inside").over(Window.partitionBy("target_id", "mmsi").orderBy("observed_at", "event_id"))
    moved = rows.withColumn("was", was)
    return moved.groupBy("target_id").agg(F.count_if(~F.col("was") & F.col("inside")).alias("arrivals"), F.count_if(F.col("was") & ~F.col("inside")).alias("departures"))


def areas(t: Net) -> DataFrame:
    """Every position with every target and whether it lies inside; targets are a small table and are broadcast."""
    box = F.broadcast(t.targets.select("target_id", "south", "west", "north", "east"))
    inside = F.expr("lat between south and north and lng between west and east")
    return t.positions.join(box).select("target_id", "mmsi", "observed_at", "event_id", inside.alias("inside"))


MOVES = """(SELECT target_id, CAST(count(CASE WHEN was = 0 AND now_in = 1 THEN 1 END) AS BIGINT) AS arrivals, CAST(count(CASE WHEN was = 1 AND now_in = 0 THEN 1 END) AS BIGINT) AS departures
 FROM (SELECT target_id, now_in, lag(now_in) OVER (PARTITION BY target_id, mmsi ORDER BY observed_at, event_id) AS was FROM (SELECT t.target_id, p.mmsi, p.observed_at, p.event_id,
  CASE WHEN lat BETWEEN south AND north AND lng BETWEEN west AND east THEN 1 ELSE 0 END AS now_in FROM positions p CROSS JOIN targets t) x) y GROUP BY target_id)"""


@operator(f"""WITH f AS (SELECT i.target_id, CAST(count(DISTINCT mmsi) AS BIGINT) AS vessels, least(count(DISTINCT mmsi) / (max(reference_count) * 1.0e0), 1.0e0) AS density,
  count(CASE WHEN nav_code IN (1, 5) THEN 1 END) / nullif(count(nav_code) * 1.0e0, 0) AS anchored, count(CASE WHEN speed100 <= slow100 THEN 1 END) / (count(*) * 1.0e0) AS slow,
  count(nav_code) / (count(*) * 1.0e0) AS nav, least((epoch_us(max(observed_at)) - epoch_us(min(observed_at))) / (24 * 3600000000.0e0), 1.0e0) AS temporal, max(observed_at) AS observed_at FROM inside i GROUP BY i.target_id),
g AS (SELECT f.*, m.arrivals, m.departures, CASE WHEN temporal < 0.25e0 THEN NULL WHEN m.arrivals + m.departures = 0 THEN 0.0e0 ELSE greatest(m.arrivals - m.departures, 0) / (1.0e0 * (m.arrivals + m.departures)) END AS imbalance
  FROM f JOIN {MOVES} m ON f.target_id = m.target_id)
SELECT target_id, vessels, arrivals, departures, observed_at, round(100 * (0.35e0 * density + coalesce(0.30e0 * anchored, 0) + 0.25e0 * slow + coalesce(0.10e0 * imbalance, 0)) /
  (0.60e0 + CASE WHEN anchored IS NULL THEN 0.0e0 ELSE 0.30e0 END + CASE WHEN imbalance IS NULL THEN 0.0e0 ELSE 0.10e0 END) + 1e-10, 2) AS score,
  round((2 + nav + temporal) / 4 + 1e-10, 4) AS completeness, round(0.35e0 * least(vessels / 20.0e0, 1.0e0) + 0.35e0 * temporal + 0.15e0 + 0.15e0 * nav + 1e-10, 4) AS confidence FROM g""")
def port_congestion(t: Net) -> DataFrame:
    return congestion(t.inside, transitions(areas(t)), 24.0)


@operator("""SELECT route_id, round(sum(coalesce(cost, 0)) + 1e-10, 6) AS cost, round(sum(coalesce(time_days, 0)) + 1e-10, 6) AS days,
  CASE WHEN count(risk) = 0 THEN 'unavailable' WHEN count(risk) = count(*) THEN 'available' ELSE 'partial' END AS status,
  round(sum(CASE WHEN risk IS NULL THEN 0 ELSE completeness END) / count(*) + 1e-10, 6) AS completeness,
  concat_ws(',', CASE WHEN count(provider) < count(*) THEN 'provider' END, CASE WHEN count(risk) < count(*) THEN 'risk' END) AS missing FROM route_segments GROUP BY route_id""")
def path_rollup(t: Net) -> DataFrame:
    """Cost and days with unknown legs as 0, the status of the risk, and which factors some leg lacks."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    status = F.when(F.count("risk") == 0, "unavailable").when(F.count("risk") == F.count("*"), "available").otherwise("partial")
    lacking = F.array_sort(F.array_compact(F.array(*[F.when(F.count(c) < F.count("*"), c) for c in ("risk", "provider")])))
    known = F.when(F.col("risk").isNotNull(), F.col("completeness")).otherwise(0.0)
    return t.route_segments.groupBy("route_id").agg(
        rounded(F.sum(zero("cost"))).alias("cost"), rounded(F.sum(zero("time_days"))).alias("days"), status.alias("status"), rounded(F.avg(known)).alias("completeness"), F.array_join(lacking, ",").alias("missing")
    )


COSTED = "(SELECT r.route_id, CASE WHEN s.n % 29 <> 0 THEN s.cost END AS cost, CASE WHEN s.n % 31 <> 0 THEN s.time_days END AS days, s.data_status, s.mode FROM route_segments r JOIN segments s ON s.segment_id = r.segment_id)"


def costed(t: Net) -> DataFrame:
    """Legs of which some have no cost or no time."""
    s = t.segments.select("segment_id", "n", "data_status", F.col("cost").alias("c"), F.col("time_days").alias("d"))
    rows = t.route_segments.select("route_id", "segment_id", "mode").join(s, "segment_id")
    return rows.select("route_id", "data_status", "mode", F.when(F.col("n") % 29 != 0, F.col("c")).alias("cost"), F.when(F.col("n") % 31 != 0, F.col("d")).alias("days"))


@operator(f"""SELECT route_id, CASE WHEN bool_and(cost IS NOT NULL) THEN round(sum(cost) + 1e-10, 6) END AS cost,
  CASE WHEN bool_or(cost IS NULL) THEN 'unavailable' WHEN min(data_status) = max(data_status) THEN min(data_status) ELSE 'estimated' END AS status FROM {COSTED} x GROUP BY route_id""")
def path_cost_rollup(t: Net) -> DataFrame:
    """A route's cost is known only if every leg's is; its status is the legs' common one."""
    whole = F.count("cost") == F.count("*")
    status = F.when(~whole, "unavailable").when(F.count_distinct("data_status") == 1, F.max("data_status")).otherwise("estimated")
    return costed(t).groupBy("route_id").agg(F.when(whole, rounded(F.sum("cost"))).alias("cost"), status.alias("status"))


#: The 90th percentile of a leg's time as a multiple of its median, by mode.
P90 = {"road": 1.35, "rail": 1.45, "sea": 1.50, "air": 1.30}


@operator(f"""SELECT route_id, CASE WHEN bool_and(days IS NOT NULL) THEN round(sum(days) + 1e-10, 6) END AS p50,
  CASE WHEN bool_and(days IS NOT NULL) THEN round(sum(days * CASE mode WHEN 'road' THEN 1.35e0 WHEN 'rail' THEN 1.45e0 WHEN 'sea' THEN 1.5e0 ELSE 1.3e0 END) + 1e-10, 6) END AS p90 FROM {COSTED} x GROUP BY route_id""")
def path_duration_rollup(t: Net) -> DataFrame:
    whole = F.count("days") == F.count("*")
    factor = F.create_map(*[F.lit(x) for kv in P90.items() for x in kv])[F.col("mode")]
    return costed(t).groupBy("route_id").agg(F.when(whole, rounded(F.sum("days"))).alias("p50"), F.when(whole, rounded(F.sum(F.col("days") * factor))).alias("p90"))


@operator("""SELECT r.route_id, f.factor, round(avg(CASE WHEN f.provider IS NOT NULL THEN f.score END) + 1e-10, 6) AS score, CAST(count(CASE WHEN f.provider IS NOT NULL THEN f.score END) AS BIGINT) AS legs,
  min(CASE WHEN f.provider IS NOT NULL AND f.score IS NOT NULL THEN f.expires_at END) AS expires_at,
  coalesce(string_agg(DISTINCT CASE WHEN f.score IS NOT NULL THEN f.provider END, ',' ORDER BY CASE WHEN f.score IS NOT NULL THEN f.provider END), '') AS providers,
  CASE WHEN count(CASE WHEN f.provider IS NOT NULL THEN f.score END) = 0 THEN 'missing' ELSE 'known' END AS status FROM route_segments r JOIN factors f ON r.segment_id = f.segment_id GROUP BY r.route_id, f.factor""")
def route_risk_factors(t: Net) -> DataFrame:
    """Per route and factor: mean over known legs, their providers, and the first expiry; a factor no leg knows is missing."""
    known = F.col("provider").isNotNull() & F.col("score").isNotNull()
    rows = t.route_segments.select("route_id", "segment_id").join(t.factors, "segment_id").withColumn("known", known)
    mine = lambda c: F.when(F.col("known"), F.col(c))
    return rows.groupBy("route_id", "factor").agg(
        rounded(F.avg(mine("score"))).alias("score"),
        F.count(mine("score")).alias("legs"),
        F.min(mine("expires_at")).alias("expires_at"),
        F.array_join(F.sort_array(F.collect_set(mine("provider"))), ",").alias("providers"),
        F.when(F.count_if("known") == 0, "missing").otherwise("known").alias("status"),
    )


@operator("""SELECT x.region, coalesce(y.lat, 0.0e0) AS lat, y.lng, CASE WHEN y.lat IS NULL THEN 'unavailable' ELSE 'centroid' END AS status FROM (SELECT DISTINCT region FROM locations) x
LEFT JOIN (SELECT region, round(avg(lat) + 1e-10, 6) AS lat, round(avg(lng) + 1e-10, 6) AS lng FROM locations WHERE location_id % 5 > 0 AND region <> 'ASIA' GROUP BY region) y ON x.region = y.region""")
def city_centroid_fallback(t: Net) -> DataFrame:
    """The mean of the known coordinates of a region; none leave it unavailable."""
    known = (F.col("location_id") % 5 > 0) & (F.col("region") != "ASIA")
    mean = lambda c: rounded(F.avg(F.when(known, F.col(c))))
    found = t.locations.groupBy("region").agg(mean("lat").alias("lat"), mean("lng").alias("lng"))
    return found.select("region", F.coalesce("lat", F.lit(0.0)).alias("lat"), "lng", F.when(F.col("lat").isNull(), "unavailable").otherwise("centroid").alias("status"))


TRAFFIC = "(SELECT target_id, CAST(count(DISTINCT mmsi) AS BIGINT) AS vessels, max(observed_at) AS seen FROM inside GROUP BY target_id)"


@operator(f"""SELECT s.segment_id, max(v.vessels) AS congestion, string_agg(v.target_id, ',' ORDER BY v.target_id) AS snapshots FROM segments s JOIN
 (SELECT target_id, u.port FROM targets, unnest(string_split(port_ids, '|')) AS u(port)) p ON p.port = concat('LOC-', CAST(s.from_id AS STRING)) OR p.port = concat('LOC-', CAST(s.to_id AS STRING))
 JOIN {TRAFFIC} v ON v.target_id = p.target_id WHERE s.mode = 'sea' GROUP BY s.segment_id""")
def segment_congestion(t: Net) -> DataFrame:
    """A sea segment has the congestion of its busiest port, and names all snapshots that it was taken from."""
    ports = t.targets.select("target_id", F.explode(items("port_ids")).alias("port"))
    traffic = t.inside.groupBy("target_id").agg(F.count_distinct("mmsi").alias("vessels"))
    sea = t.segments.filter("mode = 'sea'").select("segment_id", F.explode(F.array("from_id", "to_id")).alias("end"))
    met = sea.withColumn("port", F.concat(F.lit("LOC-"), F.col("end").cast("string"))).join(F.broadcast(ports), "port").join(F.broadcast(traffic), "target_id")
    return met.groupBy("segment_id").agg(F.max("vessels").alias("congestion"), F.array_join(F.sort_array(F.collect_list("target_id")), ",").alias("snapshots"))


@operator("""SELECT provider, CAST(count(*) AS BIGINT) AS total, max(observed_at) AS latest,
  CASE WHEN count(risk) = count(*) THEN 'healthy' WHEN count(risk) > 0 THEN 'degraded' ELSE 'unavailable' END AS status FROM segments WHERE provider IS NOT NULL GROUP BY provider""")
def provider_health(t: Net) -> DataFrame:
    status = F.when(F.count("risk") == F.count("*"), "healthy").when(F.count("risk") > 0, "degraded").otherwise("unavailable")
    return t.segments.filter("provider is not null").groupBy("provider").agg(F.count("*").alias("total"), F.max("observed_at").alias("latest"), status.alias("status"))


@operator("""SELECT l.region, (SELECT CAST(count(*) AS BIGINT) FROM suppliers_from f JOIN locations x ON f.origin_id = x.location_id WHERE x.region = l.region) AS suppliers,
  (SELECT CAST(count(*) AS BIGINT) FROM segments s JOIN locations x ON s.from_id = x.location_id WHERE x.region = l.region) AS segments,
  (SELECT CAST(count(*) AS BIGINT) FROM supplier s JOIN locations x ON s.s_nationkey = x.location_id WHERE x.region = l.region AND s.s_suppkey % 7 = 0) AS without_origin
FROM (SELECT DISTINCT region FROM locations) l""")
def supplier_origin_summary(t: Net) -> DataFrame:
    """Per region: suppliers with and without an origin, and segments; each is counted before it is joined."""
    place = t.locations.select(F.col("location_id").alias("id"), "region")
    count = lambda rows, key, name: rows.groupBy(F.col(key).alias("id")).agg(F.count("*").alias(name))
    rows = place.join(count(t.suppliers_from, "origin_id", "suppliers"), "id", "left").join(count(t.segments, "from_id", "segments"), "id", "left")
    rows = rows.join(count(t.supplier.filter("s_suppkey % 7 = 0"), "s_nationkey", "without_origin"), "id", "left")
    names = ("suppliers", "segments", "without_origin")
    return rows.groupBy("region").agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in names])


@operator("""SELECT 'risk' AS field, CAST(count(risk) AS BIGINT) AS present FROM segments UNION ALL SELECT 'provider', CAST(count(provider) AS BIGINT) FROM segments
UNION ALL SELECT 'cost', CAST(count(cost) AS BIGINT) FROM segments""")
def field_completeness(t: Net) -> DataFrame:
    fields = ["risk", "provider", "cost"]
    counted = t.segments.agg(*[F.count(c).alias(c) for c in fields])
    return counted.unpivot([], fields, "field", "present")


@operator("""SELECT segment_id, string_agg(snapshot, ',' ORDER BY snapshot) AS snapshots, CAST(count(*) AS BIGINT) AS n FROM (SELECT DISTINCT r.segment_id, concat(CAST(o_orderkey % 40 AS STRING), ':', r.route_id) AS snapshot
  FROM orders JOIN route_segments r ON r.route_id = concat('R', CAST(o_orderkey % 25 AS STRING), '-', CAST(o_orderkey % 4 AS STRING)) WHERE o_orderkey < 200) x GROUP BY segment_id""")
def segment_inclusions(t: Net) -> DataFrame:
    """Snapshots of routes turned round: for each segment the snapshots and routes that hold it."""
    number = F.col("o_orderkey")
    snapshots = t.orders.filter(number < 200).select(
        F.concat(F.lit("R"), (number % 25).cast("string"), F.lit("-"), (number % 4).cast("string")).alias("route_id"), (number % 40).cast("string").alias("snapshot_id")
    )
    entry = F.concat("snapshot_id", F.lit(":"), "route_id")
    rows = snapshots.distinct().join(t.route_segments.select("route_id", "segment_id"), "route_id").groupBy("segment_id").agg(F.sort_array(F.collect_set(entry)).alias("s"))
    return rows.select("segment_id", F.array_join("s", ",").alias("snapshots"), F.size("s").cast("long").alias("n"))


@operator("SELECT from_id, string_agg(mode, ',' ORDER BY first_place) AS modes FROM (SELECT from_id, mode, min(n * 100 + mode_ix) AS first_place FROM segments GROUP BY from_id, mode) x GROUP BY from_id")
def ordered_distinct(t: Net) -> DataFrame:
    """The modes of an origin without repeats, in the order in which they first come up."""
    ordered = F.transform(F.sort_array(F.collect_list(F.struct((F.col("n") * 100 + F.col("mode_ix")).alias("k"), "mode"))), lambda x: x["mode"])
    return t.segments.groupBy("from_id").agg(F.array_join(F.array_distinct(ordered), ",").alias("modes"))
