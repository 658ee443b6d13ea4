"""Geometry on the sphere as column expressions, and the operators of the inventory that show them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideway.sources.tables import Net, operator

#: Fixed value: the mean radius of the earth in km.  The leg estimator uses 6371.0.
RADIUS = 6371.0088
PAIRS = "(SELECT DISTINCT a.location_id AS a, b.location_id AS b, a.lat AS lat1, a.lng AS lng1, b.lat AS lat2, b.lng AS lng2 FROM segments s JOIN locations a ON s.from_id = a.location_id JOIN locations b ON s.to_id = b.location_id)"


def haversine_sql(a: str, b: str, radius: float = RADIUS) -> str:
    """The other engine's text for the distance in km of rows ``a`` and ``b`` with lat and lng."""
    h = f"(pow(sin(radians({b}.lat - {a}.lat) / 2), 2) + cos(radians({a}.lat)) * cos(radians({b}.lat)) * pow(sin(radians({b}.lng - {a}.lng) / 2), 2))"
    return f"2 * {radius}e0 * asin(sqrt(least(1.0e0, {h})))"


def haversine(lat1: Column, lng1: Column, lat2: Column, lng2: Column, radius: float = RADIUS) -> Column:
    """Great-circle distance in km."""
    half = lambda a, b: F.pow(F.sin(F.radians(b - a) / 2), F.lit(2.0))
    h = half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lng1, lng2)
    return 2 * radius * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def normalize_longitude_of(lng: Column) -> Column:
    """Degrees wrapped to [-180, 180)."""
    return F.pmod(lng + 180, F.lit(360.0)) - 180


def shortest_way(lng1: Column, lng2: Column) -> Column:
    """``lng2`` moved by a full turn where the way over the antimeridian is shorter."""
    return F.when(lng2 - lng1 > 180, lng2 - 360).when(lng2 - lng1 < -180, lng2 + 360).otherwise(lng2)


def great_circle(lat1: Column, lng1: Column, lat2: Column, lng2: Column, n: int) -> Column:
    """``n`` points (lat, lng) along the great circle, to 6 digits; both ends are exact."""
    d = haversine(lat1, lng1, lat2, lng2, 1.0)
    a, b, c, e = (F.radians(x) for x in (lat1, lng1, lat2, lng2))

    def point(i: Column) -> Column:
        f = i / (n - 1)
        p, q = F.sin((1 - f) * d) / F.sin(d), F.sin(f * d) / F.sin(d)
        x = p * F.cos(a) * F.cos(b) + q * F.cos(c) * F.cos(e)
        y = p * F.cos(a) * F.sin(b) + q * F.cos(c) * F.sin(e)
        z = p * F.sin(a) + q * F.sin(c)
        inner = F.struct(F.round(F.degrees(F.atan2(z, F.sqrt(x * x + y * y))), 6).alias("lat"), F.round(F.degrees(F.atan2(y, x)), 6).alias("lng"))
        ends = F.when((i == 0) | (d == 0), F.struct(lat1.alias("lat"), lng1.alias("lng"))).when(i == n - 1, F.struct(lat2.alias("lat"), lng2.alias("lng")))
        return F.coalesce(ends, inner)

    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), point)


def circle(lat: Column, lng: Column, km: Column, corners: int = 48) -> Column:
    """The corners (lat, lng) of a polygon whose corners lie ``km`` away, from north and turning east."""
    a, d = F.radians(lat), km / RADIUS

    def corner(i: Column) -> Column:
        turn = 2 * math.pi * i / corners
        south = F.asin(F.sin(a) * F.cos(d) + F.cos(a) * F.sin(d) * F.cos(turn))
        east = F.radians(lng) + F.atan2(F.sin(turn) * F.sin(d) * F.cos(a), F.cos(d) - F.sin(a) * F.sin(south))
        return F.struct(F.round(F.degrees(south), 6).alias("lat"), F.round(normalize_longitude_of(F.degrees(east)), 6).alias("lng"))

    return F.transform(F.sequence(F.lit(0), F.lit(corners - 1)), corner)


def covers(ring: Column, lat: Column, lng: Column) -> Column:
    """Whether a ring of points (lat, lng) goes round the point: an odd number of its sides lies north of it."""
    size = F.size(ring)

    def crossed(n: Column, i: Column) -> Column:
        p, q = F.get(ring, i), F.get(ring, (i + 1) % size)
        spans = (p["lng"] > lng) != (q["lng"] > lng)
        north = p["lat"] + (lng - p["lng"]) * (q["lat"] - p["lat"]) / (q["lng"] - p["lng"]) > lat
        return n + F.when(spans & north, 1).otherwise(0)

    return F.aggregate(F.sequence(F.lit(0), size - 1), F.lit(0), crossed) % 2 == 1


def along(points: Column, fraction: Column) -> Column:
    """The point (lat, lng) at a fraction of the length of a line of points; steps take the shorter way round."""
    steps = F.transform(
        F.sequence(F.lit(1), F.size(points) - 1),
        lambda i: F.struct(
            haversine(F.get(points, i - 1)["lat"], F.get(points, i - 1)["lng"], F.get(points, i)["lat"], F.get(points, i)["lng"]).alias("km"), i.alias("i")
        ),
    )
    start = F.struct(length_km(points).alias("total"), F.lit(0.0).alias("done"), F.lit(None).cast("struct<lat:double,lng:double>").alias("at"))

    def step(state: Column, s: Column) -> Column:
        p, q = F.get(points, s["i"] - 1), F.get(points, s["i"])
        want = state["total"] * fraction
        share = F.when(s["km"] > 0, (want - state["done"]) / s["km"]).otherwise(0.0)
        here = F.struct(
            (p["lat"] + (q["lat"] - p["lat"]) * share).alias("lat"),
            normalize_longitude_of(p["lng"] + (shortest_way(p["lng"], q["lng"]) - p["lng"]) * share).alias("lng"),
        )
        last = s["i"] == F.size(points) - 1
        reached = state["at"].isNull() & ((want <= state["done"] + s["km"]) | last)
        return F.struct(state["total"].alias("total"), (state["done"] + s["km"]).alias("done"), F.when(reached, here).otherwise(state["at"]).alias("at"))

    return F.aggregate(steps, start, step)["at"]


def length_km(points: Column) -> Column:
    """The length of a line of points (lat, lng)."""
    step = lambda i: haversine(F.get(points, i - 1)["lat"], F.get(points, i - 1)["lng"], F.get(points, i)["lat"], F.get(points, i)["lng"])
    return F.when(F.size(points) < 2, 0.0).otherwise(F.aggregate(F.sequence(F.lit(1), F.size(points) - 1), F.lit(0.0), lambda s, i: s + step(i)))


def geometry(text: Column) -> Column:
    """(kind, points) of GeoJSON text: a Point, LineString of two points or more, or Polygon whose first ring is closed and
    has four or more; anything else, and points off the globe, give null.  Longitudes up to 360 are accepted."""
    kind = F.get_json_object(text, "$.type")
    shapes = {"Point": "array<double>", "LineString": "array<array<double>>", "Polygon": "array<array<array<double>>>"}
    read = {k: F.from_json(F.get_json_object(text, "$.coordinates"), v) for k, v in shapes.items()}
    points = F.when(kind == "Point", F.array(read["Point"])).when(kind == "LineString", read["LineString"]).when(kind == "Polygon", F.get(read["Polygon"], 0))
    fine = F.forall(points, lambda p: (F.size(p) >= 2) & F.get(p, 0).between(-180, 360) & F.get(p, 1).between(-90, 90))
    least = F.when(kind == "Point", 1).when(kind == "LineString", 2).otherwise(4)
    closed = (kind != "Polygon") | (F.get(points, 0) == F.element_at(points, -1))
    there = points.isNotNull() & (F.size(points) >= least)
    return F.when(F.when(there, fine & closed).otherwise(False), F.struct(kind.alias("kind"), F.transform(points, lambda p: F.struct(F.get(p, 1).alias("lat"), F.get(p, 0).alias("lng"))).alias("points")))


def clipped_share(lat1: Column, lng1: Column, lat2: Column, lng2: Column, ring: Column) -> Column:
    """The share of a straight line that lies in a convex ring of points (lat, lng), counter-clockwise or clockwise."""
    size = F.size(ring)
    area = F.aggregate(F.sequence(F.lit(0), size - 1), F.lit(0.0), lambda s, i: s + F.get(ring, i)["lng"] * F.get(ring, (i + 1) % size)["lat"] - F.get(ring, (i + 1) % size)["lng"] * F.get(ring, i)["lat"])
    turn = F.when(area < 0, -1.0).otherwise(1.0)

    def cut(state: Column, i: Column) -> Column:
        p, q = F.get(ring, i), F.get(ring, (i + 1) % size)
        side = lambda lat, lng: turn * ((q["lng"] - p["lng"]) * (lat - p["lat"]) - (q["lat"] - p["lat"]) * (lng - p["lng"]))
        s, e = side(lat1, lng1), side(lat2, lng2)
        at = s / F.nullif(s - e, F.lit(0.0))
        lo = F.when((s < 0) & (e < 0), 2.0).when((s < 0) & (e >= 0), F.greatest(state["lo"], at)).otherwise(state["lo"])
        hi = F.when((s >= 0) & (e < 0), F.least(state["hi"], at)).otherwise(state["hi"])
        return F.struct(lo.alias("lo"), hi.alias("hi"))

    found = F.aggregate(F.sequence(F.lit(0), size - 1), F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi")), cut)
    return F.greatest(F.lit(0.0), found["hi"] - found["lo"])


def simplified(points: list[tuple[float, float]], tolerance: float = 0.005) -> list[tuple[float, float]]:
    """The fewest of a line's points, both ends included, from which no other lies further than ``tolerance`` degrees off
    its part of the line.  Parts are worked off a list, so a long line needs no deep recursion."""
    if len(points) < 3:
        return list(points)
    kept, parts = {0, len(points) - 1}, [(0, len(points) - 1)]
    while parts:
        a, e = parts.pop()
        (x1, y1), (x2, y2) = points[a], points[e]
        length = math.hypot(x2 - x1, y2 - y1)
        far, at = tolerance, None
        for k in range(a + 1, e):
            x, y = points[k]
            off = math.hypot(x - x1, y - y1) if not length else abs((x2 - x1) * (y1 - y) - (x1 - x) * (y2 - y1)) / length
            if off > far:
                far, at = off, k
        if at is not None:
            kept.add(at)
            parts += [(a, at), (at, e)]
    return [points[k] for k in sorted(kept)]


def pairs(t: Net) -> DataFrame:
    """Distinct pairs of locations that a segment joins."""
    end = lambda x, k: t.locations.select(F.col("location_id").alias(x), F.col("lat").alias(f"lat{k}"), F.col("lng").alias(f"lng{k}"))
    joined = t.segments.select(F.col("from_id").alias("a"), F.col("to_id").alias("b")).distinct()
    return joined.join(end("a", 1), "a").join(end("b", 2), "b")


def ends() -> list[Column]:
    return [F.col(c) for c in ("lat1", "lng1", "lat2", "lng2")]


@operator(f"""SELECT s.segment_id, round({haversine_sql('a', 'b')}, 6) AS km, round({haversine_sql('a', 'b', 6371.0)}, 6) AS km_simple
FROM segments s JOIN locations a ON s.from_id = a.location_id JOIN locations b ON s.to_id = b.location_id""", "haversine")
def distances(t: Net) -> DataFrame:
    rows = t.segments.select("segment_id", F.col("from_id").alias("a"), F.col("to_id").alias("b")).join(pairs(t), ["a", "b"])
    return rows.select("segment_id", F.round(haversine(*ends()), 6).alias("km"), F.round(haversine(*ends(), 6371.0), 6).alias("km_simple"))


@operator(f"""WITH g AS (SELECT *, radians(lat1) AS a1, radians(lng1) AS o1, radians(lat2) AS a2, radians(lng2) AS o2,
  2 * asin(sqrt(least(1.0e0, pow(sin(radians(lat2 - lat1) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin(radians(lng2 - lng1) / 2), 2)))) AS d
  FROM {PAIRS} p), f AS (SELECT g.*, i, sin((1 - i / 8.0e0) * d) / sin(d) AS u, sin(i / 8.0e0 * d) / sin(d) AS v FROM g, range(9) r(i))
SELECT a, b, CAST(i AS INT) AS i, CASE i WHEN 0 THEN lat1 WHEN 8 THEN lat2 ELSE round(degrees(atan2(u * sin(a1) + v * sin(a2),
    sqrt(pow(u * cos(a1) * cos(o1) + v * cos(a2) * cos(o2), 2) + pow(u * cos(a1) * sin(o1) + v * cos(a2) * sin(o2), 2)))), 6) END AS lat,
  CASE i WHEN 0 THEN lng1 WHEN 8 THEN lng2 ELSE round(degrees(atan2(u * cos(a1) * sin(o1) + v * cos(a2) * sin(o2), u * cos(a1) * cos(o1) + v * cos(a2) * cos(o2))), 6) END AS lng FROM f""")
def great_circle_points(t: Net) -> DataFrame:
    return pairs(t).select("a", "b", F.posexplode(great_circle(*ends(), 9)).alias("i", "p")).select("a", "b", "i", "p.lat", "p.lng")


@operator(f"""WITH c AS (SELECT zone_id, i, radians(lat) AS a, radians(lng) AS o, radius_km / {RADIUS}e0 AS d, 2 * pi() * i / 48 AS w FROM zones, range(48) r(i)),
e AS (SELECT *, asin(sin(a) * cos(d) + cos(a) * sin(d) * cos(w)) AS s FROM c)
SELECT zone_id, CAST(i AS INT) AS i, round(degrees(s), 6) AS lat,
  round(degrees(o + atan2(sin(w) * sin(d) * cos(a), cos(d) - sin(a) * sin(s))) - 360 * floor((degrees(o + atan2(sin(w) * sin(d) * cos(a), cos(d) - sin(a) * sin(s))) + 180) / 360), 6) AS lng FROM e""")
def geodesic_circle(t: Net) -> DataFrame:
    ring = circle(F.col("lat"), F.col("lng"), F.col("radius_km"))
    return t.zones.select("zone_id", F.posexplode(ring).alias("i", "p")).select("zone_id", "i", "p.lat", "p.lng")


@operator("""SELECT location_id, lng + 37.5e0 * location_id - 360 * floor((lng + 37.5e0 * location_id + 180) / 360) AS wrapped,
  CASE WHEN abs(lng - 10 - 50) > 180 THEN lng - 10 + 360 ELSE lng - 10 END AS near_50 FROM locations""")
def normalize_longitude(t: Net) -> DataFrame:
    lng = F.col("lng")
    return t.locations.select("location_id", normalize_longitude_of(lng + 37.5 * F.col("location_id")).alias("wrapped"), shortest_way(F.lit(50.0), lng - 10).alias("near_50"))


def lines(t: Net) -> DataFrame:
    """For each origin the line over its destinations in the order of their ids."""
    stops = t.segments.select("from_id", "to_id").distinct().join(t.locations, F.col("to_id") == F.col("location_id"))
    points = F.transform(F.sort_array(F.collect_list(F.struct("to_id", "lat", "lng"))), lambda p: F.struct(p["lat"], p["lng"]))
    return stops.groupBy("from_id").agg(points.alias("points"))


LEGS = f"""(SELECT x.from_id, x.k, a.lat AS lat1, a.lng AS lng1, b.lat AS lat2, b.lng AS lng2, {haversine_sql('a', 'b')} AS km FROM
  (SELECT from_id, to_id, lead(to_id) OVER (PARTITION BY from_id ORDER BY to_id) AS next_id, row_number() OVER (PARTITION BY from_id ORDER BY to_id) AS k
   FROM (SELECT DISTINCT from_id, to_id FROM segments) d) x JOIN locations a ON x.to_id = a.location_id JOIN locations b ON x.next_id = b.location_id)"""


@operator(f"SELECT from_id, round(sum(km), 4) AS km FROM {LEGS} l GROUP BY from_id")
def line_length(t: Net) -> DataFrame:
    return lines(t).filter(F.size("points") > 1).select("from_id", F.round(length_km(F.col("points")), 4).alias("km"))


@operator(f"""WITH l AS (SELECT *, sum(km) OVER (PARTITION BY from_id ORDER BY k) AS upto, sum(km) OVER (PARTITION BY from_id) AS total FROM {LEGS} x),
w AS (SELECT l.*, f, row_number() OVER (PARTITION BY from_id, f ORDER BY k) AS r FROM l, unnest([0.25e0, 0.6e0]) u(f) WHERE total * f <= upto)
SELECT from_id, f AS fraction, round(lat1 + (lat2 - lat1) * (total * f - upto + km) / km, 4) AS lat,
  round(lng1 + (lng2 - lng1) * (total * f - upto + km) / km, 4) AS lng FROM w WHERE r = 1""")
def sample_line(t: Net) -> DataFrame:
    found = lines(t).filter(F.size("points") > 1).withColumn("fraction", F.explode(F.array(F.lit(0.25), F.lit(0.6)))).withColumn("p", along(F.col("points"), F.col("fraction")))
    return found.select("from_id", "fraction", F.round("p.lat", 4).alias("lat"), F.round("p.lng", 4).alias("lng"))


@operator(f"""WITH p AS (SELECT a, b, i, lat1 + (lat2 - lat1) * i / 95.0e0 AS lat, lng1 + (lng2 - lng1) * i / 95.0e0 AS lng FROM {PAIRS} x, range(96) r(i))
SELECT a, b, round(count(CASE WHEN lng > -120.5e0 AND lng <= 40.25e0 AND lat < 35.5e0 AND lat >= -20.25e0 THEN 1 END) / 96.0e0, 6) AS fraction FROM p GROUP BY a, b""")
def land_fraction(t: Net) -> DataFrame:
    """The share of 96 points of a line that a polygon covers."""
    corner = lambda lat, lng: F.struct(F.lit(lat).alias("lat"), F.lit(lng).alias("lng"))
    land = F.array(corner(-20.25, -120.5), corner(-20.25, 40.25), corner(35.5, 40.25), corner(35.5, -120.5))
    lat1, lng1, lat2, lng2 = ends()
    points = F.transform(F.sequence(F.lit(0), F.lit(95)), lambda i: F.struct((lat1 + (lat2 - lat1) * i / 95.0).alias("lat"), (lng1 + (lng2 - lng1) * i / 95.0).alias("lng")))
    inside = F.size(F.filter(points, lambda p: covers(land, p["lat"], p["lng"])))
    return pairs(t).select("a", "b", F.round(inside / 96.0, 6).alias("fraction"))


SHAPES = """concat('{"type":"', CASE location_id % 5 WHEN 0 THEN 'Point' WHEN 4 THEN 'Circle' ELSE 'LineString' END, '","coordinates":',
  CASE location_id % 5 WHEN 0 THEN concat('[', CAST(CAST(lng AS INT) AS STRING), ',', CAST(CAST(lat AS INT) AS STRING), ']')
  WHEN 1 THEN concat('[[', CAST(CAST(lng AS INT) AS STRING), ',', CAST(CAST(lat AS INT) AS STRING), '],[5,6]]') WHEN 2 THEN '[[1,2],[3,99]]'
  WHEN 3 THEN '[[1,2]]' ELSE '3' END, CASE WHEN location_id = 21 THEN '' ELSE '}' END)"""


@operator("""SELECT location_id, CASE WHEN location_id % 5 = 0 THEN 'Point' WHEN location_id % 5 = 1 AND location_id <> 21 THEN 'LineString' END AS kind,
  CASE WHEN location_id % 5 = 0 THEN CAST(1 AS BIGINT) WHEN location_id % 5 = 1 AND location_id <> 21 THEN 2 END AS points,
  CASE WHEN location_id % 5 = 0 OR location_id % 5 = 1 AND location_id <> 21 THEN lat END AS lat FROM locations""")
def parse_geojson(t: Net) -> DataFrame:
    """GeoJSON text of which some is broken, of another kind, too short or off the globe."""
    shapes = t.locations.select("location_id", geometry(F.expr(SHAPES)).alias("g"))
    return shapes.select("location_id", "g.kind", F.when(F.col("g").isNotNull(), F.size("g.points").cast("long")).alias("points"), F.get("g.points", F.lit(0))["lat"].alias("lat"))


@operator(f"""WITH r AS (SELECT s.segment_id, t.target_id, a.lat AS y, a.lng AS x, b.lat - a.lat AS dy, b.lng - a.lng AS dx, south, west, north, east, {haversine_sql('a', 'b')} AS km
  FROM segments s JOIN locations a ON s.from_id = a.location_id JOIN locations b ON s.to_id = b.location_id CROSS JOIN targets t),
c AS (SELECT segment_id, target_id, km,
  greatest(0.0e0, CASE WHEN dy > 0 THEN (south - y) / dy WHEN dy < 0 THEN (north - y) / dy WHEN y < south OR y > north THEN 2.0e0 ELSE 0.0e0 END,
    CASE WHEN dx > 0 THEN (west - x) / dx WHEN dx < 0 THEN (east - x) / dx WHEN x < west OR x > east THEN 2.0e0 ELSE 0.0e0 END) AS lo,
  least(1.0e0, CASE WHEN dy > 0 THEN (north - y) / dy WHEN dy < 0 THEN (south - y) / dy ELSE 1.0e0 END,
    CASE WHEN dx > 0 THEN (east - x) / dx WHEN dx < 0 THEN (west - x) / dx ELSE 1.0e0 END) AS hi FROM r)
SELECT segment_id, target_id, round(least(1.0e0, hi - lo), 6) AS ratio, round(km * (hi - lo), 4) AS km FROM c WHERE (hi - lo) * km > 0.01e0""")
def spatial_exposure(t: Net) -> DataFrame:
    """Segments and target areas that they cross for more than 10 m: the share inside, and its length.

    Candidates come from a range join of bounding boxes; the areas are convex polygons and are broadcast as a small
    dimension, so segments don't move.
    """
    corner = lambda a, b: F.struct(F.col(a).alias("lat"), F.col(b).alias("lng"))
    areas = t.targets.withColumn("ring", F.array(corner("south", "west"), corner("north", "west"), corner("north", "east"), corner("south", "east")))
    lat1, lng1, lat2, lng2 = ends()
    near = F.expr("least(lat1, lat2) <= north AND greatest(lat1, lat2) >= south AND least(lng1, lng2) <= east AND greatest(lng1, lng2) >= west")
    rows = pairs(t).join(F.broadcast(areas), near).withColumn("share", clipped_share(lat1, lng1, lat2, lng2, F.col("ring"))).withColumn("km", haversine(lat1, lng1, lat2, lng2) * F.col("share"))
    crossed = rows.filter("km > 0.01").select("a", "b", "target_id", F.round(F.least("share", F.lit(1.0)), 6).alias("ratio"), F.round("km", 4).alias("km"))
    return t.segments.select("segment_id", F.col("from_id").alias("a"), F.col("to_id").alias("b")).join(crossed, ["a", "b"]).select("segment_id", "target_id", "ratio", "km")
