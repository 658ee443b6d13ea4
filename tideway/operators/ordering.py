"""Window-style operators, sorting, paging and set operations (sections E, F and G)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideway.operators.aggregates import MOVES, areas, ranked, rounded, transitions
from tideway.operators.filters import active, items
from tideway.operators.joins import latest
from tideway.sources.silver import NOW
from tideway.sources.tables import Net, operator


@operator("""SELECT from_id, to_id, l_orderkey, l_linenumber, ship FROM (SELECT *, row_number() OVER (PARTITION BY from_id, to_id
  ORDER BY ship DESC, l_orderkey, l_linenumber) AS r FROM observations) x WHERE r = 1""")
def latest_per_key(t: Net) -> DataFrame:
    rows = t.observations.select("from_id", "to_id", "l_orderkey", "l_linenumber", "ship")
    return latest(rows, ["from_id", "to_id"], [F.desc("ship"), F.asc("l_orderkey"), F.asc("l_linenumber")])


@operator("SELECT segment_id, CAST(row_number() OVER (ORDER BY w_risk, w_cost, segment_id) AS BIGINT) AS place FROM weighted_edges")
def route_rank(t: Net) -> DataFrame:
    return ranked(t.weighted_edges.select("segment_id", "w_risk", "w_cost"), ["w_risk", "w_cost", "segment_id"], "place").select("segment_id", "place")


@operator("""SELECT segment_id, cost - lead(cost) OVER (PARTITION BY from_id ORDER BY cost, segment_id) AS cost_delta,
  risk - lead(risk) OVER (PARTITION BY from_id ORDER BY cost, segment_id) AS risk_delta FROM segments""")
def comparison_to_next(t: Net) -> DataFrame:
    by = Window.partitionBy("from_id").orderBy("cost", "segment_id")
    delta = lambda c: (F.col(c) - F.lead(c).over(by)).alias(f"{c}_delta")
    return t.segments.select("segment_id", delta("cost"), delta("risk"))


@operator(f"SELECT target_id, arrivals, departures FROM {MOVES} m")
def arrivals_departures(t: Net) -> DataFrame:
    return transitions(areas(t))


TREND = "CASE WHEN max24 - first >= 2500 THEN 'RAPIDLY_WORSENING' WHEN max24 - first >= 1000 THEN 'WORSENING' WHEN max24 - first <= -1000 THEN 'IMPROVING' ELSE 'STABLE' END"


@operator(f"""SELECT point_id, max6, max24, mean24, {TREND} AS trend FROM (SELECT point_id, max(CASE WHEN r <= 6 THEN wind100 END) AS max6, max(wind100) AS max24,
  round(avg(wind100) + 1e-10, 4) AS mean24, max(CASE WHEN r = 1 THEN wind100 END) AS first FROM (SELECT point_id, wind100, row_number() OVER (PARTITION BY point_id ORDER BY hour) AS r
  FROM weather_hourly) x WHERE r <= 24 GROUP BY point_id) y""")
def forecast_trend(t: Net) -> DataFrame:
    """Maxima and mean of a point's next hours (24 is the horizon), and where the 24-hour maximum goes from now."""
    hours = t.weather_hourly.withColumn("r", F.row_number().over(Window.partitionBy("point_id").orderBy("hour"))).filter("r <= 24")
    within = lambda k: F.max(F.when(F.col("r") <= k, F.col("wind100")))
    found = hours.groupBy("point_id").agg(within(6).alias("max6"), F.max("wind100").alias("max24"), rounded(F.avg("wind100"), 4).alias("mean24"), within(1).alias("first"))
    rise = F.col("max24") - F.col("first")
    trend = F.when(rise >= 2500, "RAPIDLY_WORSENING").when(rise >= 1000, "WORSENING").when(rise <= -1000, "IMPROVING").otherwise("STABLE")
    return found.select("point_id", "max6", "max24", "mean24", trend.alias("trend"))


@operator("SELECT a.article_id, NOT EXISTS (SELECT 1 FROM articles b WHERE b.body = a.body AND b.article_id < a.article_id) AS kept FROM articles a")
def exact_dedup(t: Net) -> DataFrame:
    """Of equal texts the one with the smallest id is kept.  Only digests and ids are grouped, so a hot text is combined
    before the shuffle."""
    rows = t.articles.select("article_id", F.sha2("body", 256).alias("h"))
    first = rows.groupBy("h").agg(F.min("article_id").alias("first"))
    return rows.join(first, "h").select("article_id", (F.col("article_id") == F.col("first")).alias("kept"))


@operator("""SELECT p_partkey, CASE WHEN r = 1 THEN p_name ELSE concat(p_name, '-', substr(sha256(CAST(p_partkey AS STRING)), 1, 8)) END AS new_id
FROM (SELECT p_partkey, p_name, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS r FROM part) x""")
def id_disambiguation(t: Net) -> DataFrame:
    """The first owner of a name keeps it; every later one gets a digest of its key behind it."""
    first = t.part.groupBy("p_name").agg(F.min("p_partkey").alias("first"))
    own = F.concat("p_name", F.lit("-"), F.substring(F.sha2(F.col("p_partkey").cast("string"), 256), 1, 8))
    return t.part.join(first, "p_name").select("p_partkey", F.when(F.col("p_partkey") == F.col("first"), F.col("p_name")).otherwise(own).alias("new_id"))


@operator("""SELECT segment_id, (SELECT CAST(count(DISTINCT u.zone) AS BIGINT) FROM segments x, unnest(string_split(x.zone_ids, '|')) AS u(zone)
  WHERE x.from_id = s.from_id AND x.segment_id < s.segment_id) AS zones_before FROM segments s""")
def used_so_far(t: Net) -> DataFrame:
    """For each segment of an origin, in the order of ids, how many zones the earlier ones have used."""
    by = Window.partitionBy("from_id").orderBy("segment_id").rowsBetween(Window.unboundedPreceding, -1)
    seen = F.size(F.array_distinct(F.flatten(F.collect_list(items("zone_ids")).over(by))))
    return t.segments.select("segment_id", seen.cast("long").alias("zones_before"))


@operator("""SELECT segment_id, CASE WHEN risk IS NULL THEN 'risk' WHEN provider IS NULL THEN 'provider' WHEN expires_at <= DATE '2001-06-01' THEN 'expired' END AS reason FROM segments""")
def first_unavailable_reason(t: Net) -> DataFrame:
    reasons = [F.when(F.col("risk").isNull(), "risk"), F.when(F.col("provider").isNull(), "provider"), F.when(~active("expires_at", F.expr(NOW)), "expired")]
    return t.segments.select("segment_id", F.coalesce(*reasons).alias("reason"))


@operator("""SELECT segment_id, 'cheapest' AS tag FROM (SELECT segment_id, row_number() OVER (PARTITION BY from_id ORDER BY cost, segment_id) AS r FROM segments) a WHERE r = 1
UNION ALL SELECT segment_id, 'fastest' FROM (SELECT segment_id, row_number() OVER (PARTITION BY from_id ORDER BY time_days, segment_id) AS r FROM segments) b WHERE r = 1
UNION ALL SELECT segment_id, 'safest' FROM (SELECT segment_id, row_number() OVER (PARTITION BY from_id ORDER BY risk, segment_id) AS r FROM segments WHERE risk IS NOT NULL) c WHERE r = 1""")
def superlative_tags(t: Net) -> DataFrame:
    """All three tags from one aggregation."""
    tags = {"cheapest": "cost", "fastest": "time_days", "safest": "risk"}
    best = [F.min(F.when(F.col(c).isNotNull(), F.struct(c, "segment_id"))).getField("segment_id").alias(tag) for tag, c in tags.items()]
    return t.segments.groupBy("from_id").agg(*best).unpivot(["from_id"], list(tags), "tag", "segment_id").filter("segment_id is not null").select("segment_id", "tag")


@operator("SELECT segment_id, cost FROM segments ORDER BY cost DESC, segment_id LIMIT 100")
def topk_segments(t: Net) -> DataFrame:
    return t.segments.select("segment_id", "cost").orderBy(F.desc("cost"), "segment_id").limit(100)


SORTABLE = {"name": "name", "lat": "lat", "lng": "lng"}


def sorted_by(rows: DataFrame, column: str, descending: bool, tie: str, limit: int) -> DataFrame:
    """Rows in an order that a request names; only listed columns are allowed."""
    if column not in SORTABLE:
        raise ValueError(f"can't sort by {column}; it is one of {sorted(SORTABLE)}")
    order: Column = F.col(SORTABLE[column])
    return rows.orderBy(order.desc() if descending else order.asc(), tie).limit(limit)


@operator("SELECT location_id, name, lat FROM locations ORDER BY lat DESC, location_id LIMIT 10")
def sorted_ports(t: Net) -> DataFrame:
    return sorted_by(t.locations.select("location_id", "name", "lat"), "lat", True, "location_id", 10)


@operator("SELECT point_id, hour, wind100 FROM weather_hourly ORDER BY hour, point_id LIMIT 50 OFFSET 50")
def paged_history(t: Net) -> DataFrame:
    return t.weather_hourly.select("point_id", "hour", "wind100").orderBy("hour", "point_id").offset(50).limit(50)


@operator("SELECT segment_id FROM weighted_edges ORDER BY 0.4e0 * w_risk + 0.6e0 * w_cost / 500, risk IS NULL, risk, cost, time_days, segment_id LIMIT 20")
def ranking_balanced(t: Net) -> DataFrame:
    value = F.lit(0.4) * F.col("w_risk") + F.lit(0.6) * F.col("w_cost") / 500
    return t.weighted_edges.orderBy(value, F.asc_nulls_last("risk"), "cost", "time_days", "segment_id").limit(20).select("segment_id")


@operator("SELECT segment_id FROM weighted_edges ORDER BY risk IS NULL, risk, w_cost, cost, time_days, segment_id LIMIT 20")
def ranking_risk_first(t: Net) -> DataFrame:
    return t.weighted_edges.orderBy(F.asc_nulls_last("risk"), "w_cost", "cost", "time_days", "segment_id").limit(20).select("segment_id")


@operator("SELECT segment_id FROM weighted_edges ORDER BY round(0.5e0 * w_risk + 0.5e0 * least(w_cost / 500, 1.0e0), 9), segment_id LIMIT 25")
def legacy_ranking(t: Net) -> DataFrame:
    value = F.round(F.lit(0.5) * F.col("w_risk") + F.lit(0.5) * F.least(F.col("w_cost") / 500, F.lit(1.0)), 9)
    return t.weighted_edges.orderBy(value, "segment_id").limit(25).select("segment_id")


@operator(f"SELECT segment_id, expires_at > {NOW} AS active, risk FROM segments ORDER BY expires_at > {NOW} DESC, risk DESC NULLS FIRST, segment_id LIMIT 60")
def weather_risk_list(t: Net) -> DataFrame:
    rows = t.segments.select("segment_id", active("expires_at", F.expr(NOW)).alias("active"), "risk")
    return rows.orderBy(F.desc("active"), F.desc_nulls_first("risk"), "segment_id").limit(60)


@operator("SELECT segment_id, cost FROM segments ORDER BY cost, segment_id LIMIT 50")
def ranked_cost_segments(t: Net) -> DataFrame:
    return t.segments.select("segment_id", "cost").orderBy("cost", "segment_id").limit(50)


@operator("SELECT segment_id FROM segments WHERE from_id = 7 OR mode = 'sea'")
def union_distinct_segments(t: Net) -> DataFrame:
    s = t.segments
    return s.filter("from_id = 7").select("segment_id").union(s.filter("mode = 'sea'").select("segment_id")).distinct()


@operator("SELECT DISTINCT from_id AS node, mode FROM segments s WHERE NOT EXISTS (SELECT 1 FROM segments x WHERE x.to_id = s.from_id AND x.mode = s.mode AND x.data_status = 'synthetic')")
def set_difference(t: Net) -> DataFrame:
    """Nodes and modes that set out without a synthetic segment of the mode coming in."""
    s = t.segments
    return s.select(F.col("from_id").alias("node"), "mode").subtract(s.filter("data_status = 'synthetic'").select("to_id", "mode"))


@operator("SELECT DISTINCT a.from_id AS node FROM segments a JOIN segments b ON a.from_id = b.to_id WHERE a.mode = 'sea' AND b.mode = 'rail'")
def set_intersection(t: Net) -> DataFrame:
    s = t.segments
    return s.filter("mode = 'sea'").select(F.col("from_id").alias("node")).intersect(s.filter("mode = 'rail'").select("to_id"))


@operator("SELECT location_id, CASE WHEN location_id % 2 = 0 THEN 'second' ELSE 'first' END AS origin FROM locations")
def provider_union_dedup(t: Net) -> DataFrame:
    """Rows of several providers by id; the last provider that has one wins."""
    given = [("first", t.locations), ("second", t.locations.filter("location_id % 2 = 0"))]
    rows = None
    for k, (origin, part) in enumerate(given):
        part = part.select("location_id", F.struct(F.lit(k).alias("k"), F.lit(origin).alias("origin")).alias("x"))
        rows = part if rows is None else rows.union(part)
    return rows.groupBy("location_id").agg(F.max("x").alias("x")).select("location_id", "x.origin")


@operator("SELECT round(a.lat, 5) AS lat, round(a.lng, 5) AS lng FROM locations a WHERE EXISTS (SELECT 1 FROM segments s WHERE s.from_id = a.location_id)")
def distinct_sample_points(t: Net) -> DataFrame:
    used = t.segments.select(F.col("from_id").alias("location_id"))
    return t.locations.join(used, "location_id", "left_semi").select(F.round("lat", 5).alias("lat"), F.round("lng", 5).alias("lng")).distinct()
