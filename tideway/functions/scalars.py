"""Scalar functions of scores, weather, identifiers and tolerant parsing (the rest of section I)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideway.operators.filters import active, items
from tideway.sources.silver import NOW
from tideway.sources.tables import Net, operator

#: The weather risk curves (value, risk), and the risk of a weather code; others have 25.
CURVES = {
    "wind": [(0.0, 0.0), (20.0, 15.0), (40.0, 40.0), (60.0, 70.0), (80.0, 90.0), (100.0, 100.0)],
    "gust": [(0.0, 0.0), (30.0, 15.0), (50.0, 40.0), (70.0, 70.0), (90.0, 90.0), (110.0, 100.0)],
    "precipitation": [(0.0, 0.0), (1.0, 10.0), (5.0, 35.0), (15.0, 70.0), (30.0, 100.0)],
    "visibility": [(0.0, 100.0), (1000.0, 80.0), (2000.0, 60.0), (5000.0, 30.0), (10000.0, 10.0), (20000.0, 0.0)],
    "wave": [(0.0, 0.0), (1.0, 15.0), (2.0, 35.0), (3.0, 60.0), (4.0, 80.0), (6.0, 100.0)],
    "snowfall": [(0.0, 0.0), (0.2, 10.0), (1.0, 35.0), (3.0, 70.0), (7.0, 100.0)],
}
CODES = {
    0: 0, 1: 5, 2: 8, 3: 12, 45: 55, 48: 65, 51: 15, 53: 25, 55: 40, 56: 55, 57: 70, 61: 25, 63: 45, 65: 70, 66: 65, 67: 85,
    71: 30, 73: 55, 75: 80, 77: 45, 80: 35, 81: 55, 82: 80, 85: 55, 86: 80, 95: 75, 96: 90, 99: 100,
}


def interpolated(x: Column, points: list[tuple[float, float]]) -> Column:
    """Piecewise linear between the points, constant beyond both ends, null for null."""
    out = F.when(x <= points[0][0], points[0][1])
    for (x0, y0), (x1, y1) in zip(points, points[1:], strict=False):
        out = out.when(x <= x1, y0 + (y1 - y0) * (x - x0) / (x1 - x0))
    return F.when(x.isNotNull(), out.otherwise(points[-1][1]))


def temperature_score(x: Column) -> Column:
    """5 between -10 and 40 degrees, and 5 more for each degree beyond, up to 100."""
    excess = F.greatest(-10 - x, x - 40, F.lit(0.0))
    return F.when(x.isNotNull(), F.least(F.lit(100.0), 5 + 5 * excess))


def code_score(code: Column) -> Column:
    """The risk of a weather code: 25 for one that the table lacks, null for null."""
    table = F.create_map(*[F.lit(x) for k, v in CODES.items() for x in (k, float(v))])
    return F.when(code.isNotNull(), F.coalesce(F.try_element_at(table, code), F.lit(25.0)))


def curve_sql(x: str, points: list[tuple[float, float]]) -> str:
    """The other engine's text for a curve: the risk is read off the piece that holds the value, found by a search."""
    xs, ys = [p[0] for p in points], [p[1] for p in points]
    at = f"least(greatest(len(list_filter({xs}, lambda p: p <= {x})), 1), {len(points) - 1})"
    return f"(CASE WHEN {x} IS NULL THEN NULL ELSE {ys}[{at}] + ({ys}[{at} + 1] - {ys}[{at}]) * (least(greatest({x}, {xs[0]}e0), {xs[-1]}e0) - {xs}[{at}]) / ({xs}[{at} + 1] - {xs}[{at}]) END)"


TEMPERATURE = "least(100.0e0, 5 + 5 * CASE WHEN {x} < -10 THEN -10 - {x} WHEN {x} > 40 THEN {x} - 40 ELSE 0 END)"
CODE_ROWS = ", ".join(f"({k}, {v}e0)" for k, v in CODES.items())


def level(score: Column, bounds: list[tuple[float, str]], lowest: str, unknown: str | None) -> Column:
    """The name of the first bound that the score reaches."""
    out = F.when(score.isNull(), unknown)
    for least, name in bounds:
        out = out.when(score >= least, name)
    return out.otherwise(lowest)


LEVELS = {
    "weather": ([(75, "CRITICAL"), (50, "HIGH"), (25, "MEDIUM")], "LOW"),
    "provider": ([(80, "critical"), (60, "high"), (30, "medium")], "low"),
    "zone": ([(0.8, "CRITICAL"), (0.6, "HIGH"), (0.35, "MEDIUM")], "LOW"),
    "vehicle": ([(80, "critical"), (60, "high"), (30, "medium")], "low"),
}


@operator("""SELECT segment_id, CASE WHEN x < 0 OR x > 100 THEN NULL WHEN x <= 1 THEN round(x * 100, 4) ELSE round(x, 4) END AS score
FROM (SELECT segment_id, CASE n % 5 WHEN 0 THEN risk * 100 WHEN 1 THEN -risk WHEN 2 THEN risk * 300 WHEN 3 THEN 1.0e0 ELSE risk END AS x FROM segments) y""")
def normalize_score(t: Net) -> DataFrame:
    """Scores of 0 to 1 become 0 to 100 (1 is 100), scores of up to 100 stay, others are null."""
    k = F.col("n") % 5
    x = F.when(k == 0, F.col("risk") * 100).when(k == 1, -F.col("risk")).when(k == 2, F.col("risk") * 300).when(k == 3, F.lit(1.0)).otherwise(F.col("risk"))
    scaled = F.when(F.col("x") <= 1, F.col("x") * 100).otherwise(F.col("x"))
    return t.segments.select("segment_id", x.alias("x")).select("segment_id", F.when(F.col("x").between(0, 100), F.round(scaled, 4)).alias("score"))


@operator("""SELECT segment_id, expires_at IS NULL OR expires_at > DATE '2001-06-01' AS active, CASE WHEN expires_at IS NOT NULL THEN date_diff('day', observed_at, DATE '2001-06-01') BETWEEN 0 AND 60 ELSE FALSE END AS fresh
FROM (SELECT segment_id, observed_at, CASE WHEN n % 9 <> 0 THEN expires_at END AS expires_at FROM segments) x""")
def freshness_flags(t: Net) -> DataFrame:
    """Active: no expiry, or one to come.  Fresh: seen within 60 days before now, not after it."""
    rows = t.segments.withColumn("expires_at", F.when(F.col("n") % 9 != 0, F.col("expires_at")))
    age = F.date_diff(F.expr(NOW), F.col("observed_at"))
    return rows.select("segment_id", (F.col("expires_at").isNull() | active("expires_at", F.expr(NOW))).alias("active"), (F.col("expires_at").isNotNull() & age.between(0, 60)).alias("fresh"))


@operator("SELECT point_id, hour, " + ", ".join(f"round({curve_sql(k, p)} + 1e-10, 6) AS {k}_risk" for k, p in CURVES.items()) + " FROM forecasts")
def risk_curves(t: Net) -> DataFrame:
    return t.forecasts.select("point_id", "hour", *[F.round(interpolated(F.col(k), p) + 1e-10, 6).alias(f"{k}_risk") for k, p in CURVES.items()])


@operator(f"SELECT point_id, hour, round({TEMPERATURE.format(x='temperature')}, 6) AS risk FROM forecasts")
def temperature_risk(t: Net) -> DataFrame:
    return t.forecasts.select("point_id", "hour", F.round(temperature_score(F.col("temperature")), 6).alias("risk"))


@operator(f"SELECT point_id, hour, CASE WHEN f.code IS NOT NULL THEN coalesce(c.risk, 25.0e0) END AS risk FROM forecasts f LEFT JOIN (VALUES {CODE_ROWS}) c(code, risk) ON c.code = f.code")
def weather_code_risk(t: Net) -> DataFrame:
    return t.forecasts.select("point_id", "hour", code_score(F.col("code")).alias("risk"))


@operator("""SELECT segment_id, CASE WHEN risk IS NULL THEN 'unknown' ELSE list_extract(['low', 'medium', 'high', 'critical'], 1 + CAST(risk * 100 >= 30 AS INT) + CAST(risk * 100 >= 60 AS INT) + CAST(risk * 100 >= 80 AS INT)) END AS provider_level,
  CASE WHEN risk IS NOT NULL THEN list_extract(['LOW', 'MEDIUM', 'HIGH', 'CRITICAL'], 1 + CAST(risk * 100 >= 25 AS INT) + CAST(risk * 100 >= 50 AS INT) + CAST(risk * 100 >= 75 AS INT)) END AS weather_level,
  CASE WHEN risk IS NULL THEN 'UNKNOWN' ELSE list_extract(['LOW', 'MEDIUM', 'HIGH', 'CRITICAL'], 1 + CAST(risk >= 0.35e0 AS INT) + CAST(risk >= 0.6e0 AS INT) + CAST(risk >= 0.8e0 AS INT)) END AS zone_level,
  CASE WHEN risk IS NOT NULL THEN list_extract(['low', 'medium', 'high', 'critical'], 1 + CAST(risk * 100 >= 30 AS INT) + CAST(risk * 100 >= 60 AS INT) + CAST(risk * 100 >= 80 AS INT)) END AS vehicle_level FROM segments""")
def risk_levels(t: Net) -> DataFrame:
    unknown = {"provider": "unknown", "zone": "UNKNOWN"}
    score = {"zone": F.col("risk")}
    return t.segments.select("segment_id", *[level(score.get(k, F.col("risk") * 100), *LEVELS[k], unknown.get(k)).alias(f"{k}_level") for k in ("provider", "weather", "zone", "vehicle")])


@operator("""SELECT segment_id, method, confidence, points FROM (SELECT s.segment_id, CASE WHEN s.n % 4 = 0 AND s.zone_ids IS NOT NULL THEN 'geometry_linestring' WHEN a.lat <> -60 AND b.lat <> -60 THEN 'endpoints' ELSE 'none' END AS method,
  CASE WHEN s.n % 4 = 0 AND s.zone_ids IS NOT NULL THEN CASE WHEN s.data_status = 'estimated' THEN 0.55e0 ELSE 1.0e0 END WHEN a.lat <> -60 AND b.lat <> -60 THEN 0.35e0 ELSE 0.0e0 END AS confidence,
  CASE WHEN s.n % 4 = 0 AND s.zone_ids IS NOT NULL THEN concat_ws(';', CAST(CAST(a.lat AS INT) AS STRING), CAST(CAST(b.lat AS INT) AS STRING), '5') WHEN a.lat <> -60 AND b.lat <> -60 THEN concat_ws(';', CAST(CAST(a.lat AS INT) AS STRING), CAST(CAST(b.lat AS INT) AS STRING), '2') ELSE '0' END AS points
FROM segments s JOIN locations a ON s.from_id = a.location_id JOIN locations b ON s.to_id = b.location_id) x""")
def route_samples(t: Net) -> DataFrame:
    """Sample points of a route: five along its geometry, else its ends, else none; an inferred geometry counts less."""
    from tideway.functions.geo import along, pairs

    rows = t.segments.join(pairs(t).withColumnsRenamed({"a": "from_id", "b": "to_id"}), ["from_id", "to_id"])
    line = F.array(*[F.struct(F.col(f"lat{k}").alias("lat"), F.col(f"lng{k}").alias("lng")) for k in (1, 2)])
    has_line = (F.col("n") % 4 == 0) & F.col("zone_ids").isNotNull()
    has_ends = (F.col("lat1") != -60) & (F.col("lat2") != -60)
    sampled = F.transform(F.array(*[F.lit(k / 4) for k in range(5)]), lambda f: along(line, f))
    points = F.when(has_line, sampled).when(has_ends, line).otherwise(F.slice(line, 1, 0))
    method = F.when(has_line, "geometry_linestring").when(has_ends, "endpoints").otherwise("none")
    confidence = F.when(has_line, F.when(F.col("data_status") == "estimated", 0.55).otherwise(1.0)).when(has_ends, 0.35).otherwise(0.0)
    size = F.size("p")
    text = lambda p: F.round(p["lat"]).cast("int").cast("string")
    shown = F.when(size > 0, F.concat_ws(";", text(F.get("p", F.lit(0))), text(F.element_at("p", -1)), size.cast("string"))).otherwise("0")
    found = rows.select("segment_id", method.alias("method"), confidence.alias("confidence"), points.alias("p"))
    return found.select("segment_id", "method", "confidence", shown.alias("points"))


#: Names of the four modes.
SYNONYMS = {
    "road": ("road", "truck", "trucking", "highway", "delivery", "land"),
    "rail": ("rail", "train", "railway", "railroad"),
    "sea": ("sea", "ship", "ocean", "maritime", "vessel", "water", "marine"),
    "air": ("air", "plane", "flight", "aviation", "airplane", "aircraft"),
}
RAW_MODE = "CASE p_partkey % 7 WHEN 0 THEN ' Truck' WHEN 1 THEN 'RAILWAY' WHEN 2 THEN 'ocean ' WHEN 3 THEN 'Flight' WHEN 4 THEN 'sea' WHEN 5 THEN lower(p_type) END"


def mode_of(text: Column) -> Column:
    """One of the four modes, or null for a name that none of them has."""
    word = F.lower(F.trim(text))
    return F.coalesce(*[F.when(word.isin(*names), mode) for mode, names in SYNONYMS.items()])


@operator("SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN 'road' WHEN 1 THEN 'rail' WHEN 2 THEN 'sea' WHEN 3 THEN 'air' WHEN 4 THEN 'sea' END AS mode FROM part")
def canonical_mode(t: Net) -> DataFrame:
    return t.part.select("p_partkey", mode_of(F.expr(RAW_MODE)).alias("mode"))


@operator("""SELECT segment_id, CASE data_status WHEN 'provider' THEN CASE WHEN provider = 'P1' THEN 'observed' ELSE 'curated' END WHEN 'synthetic' THEN 'synthetic' ELSE CASE WHEN provider IS NULL THEN 'unverified' ELSE 'inferred' END END AS data_status FROM segments""")
def data_status(t: Net) -> DataFrame:
    rule = F.coalesce(
        F.when(F.col("data_status") == "synthetic", "synthetic"),
        F.when((F.col("data_status") == "provider") & (F.col("provider") == "P1"), "observed"),
        F.when(F.col("data_status") == "provider", "curated"),
        F.when(F.col("provider").isNotNull(), "inferred"),
        F.lit("unverified"),
    )
    return t.segments.select("segment_id", rule.alias("data_status"))


@operator("""SELECT location_id, CASE WHEN location_id % 3 = 0 THEN concat('N', chr(65 + location_id)) WHEN location_id % 3 = 1 AND location_id < 20 THEN concat('N', chr(65 + location_id)) END AS country,
  CASE WHEN location_id % 3 = 0 THEN 'code' WHEN location_id % 3 = 1 AND location_id < 20 THEN 'alias' ELSE 'unresolved' END AS method FROM locations""")
def country_resolve(t: Net) -> DataFrame:
    """The first of several fields that is a two-letter code or a known name, accents and case aside."""
    plain = lambda c: F.upper(F.translate(F.trim(c), "áàâäéèêëíîïóôöúùûüñç", "aaaaeeeeiiiooouuuunc"))
    names = t.nation.filter("n_nationkey < 20").select(F.upper(F.regexp_replace("n_name", "_", " ")).alias("alias"), F.concat(F.lit("N"), F.expr("char(65 + n_nationkey)")).alias("known"))
    k = F.col("location_id")
    given = F.when(k % 3 == 0, F.concat(F.lit("n"), F.expr("char(97 + location_id)"))).when(k % 3 == 1, F.concat(F.lit(" Nätion "), k.cast("string"))).otherwise("Atlantis")
    rows = t.locations.select("location_id", plain(given).alias("alias")).join(F.broadcast(names), "alias", "left")
    is_code = F.col("alias").rlike("^[A-Z]{2}$")
    method = F.when(is_code, "code").when(F.col("known").isNotNull(), "alias").otherwise("unresolved")
    return rows.select("location_id", F.when(is_code, F.col("alias")).otherwise(F.col("known")).alias("country"), method.alias("method"))


def compact(text: Column) -> Column:
    """Upper-case letters and digits, runs of anything else as one dash, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.upper(F.trim(text)), "[^A-Z0-9]+", "-"), "^-|-$", "")


@operator("""SELECT location_id, CASE kind WHEN 'Port' THEN concat('PORT-', replace(code, '-', '')) WHEN 'Airport' THEN concat('AIR-', upper(substr(md5(name), 1, 3)))
  ELSE concat('RAIL-', upper(substr(region, 1, 2)), '-', replace(upper(name), '_', '-')) END AS canonical FROM locations""")
def location_id(t: Net) -> DataFrame:
    """The id that a kind's grammar makes: ports by code, airports by a short digest, rail terminals by region and name."""
    port = F.concat(F.lit("PORT-"), F.regexp_replace("code", "-", ""))
    airport = F.concat(F.lit("AIR-"), F.upper(F.substring(F.md5("name"), 1, 3)))
    rail = F.concat(F.lit("RAIL-"), F.upper(F.substring("region", 1, 2)), F.lit("-"), compact(F.col("name")))
    return t.locations.select("location_id", F.when(F.col("kind") == "Port", port).when(F.col("kind") == "Airport", airport).otherwise(rail).alias("canonical"))


@operator("""SELECT location_id, concat_ws('|', name, CASE WHEN code <> name THEN code END, CASE WHEN region NOT IN (name, code) THEN region END, kind,
  CASE WHEN aliases IS NOT NULL THEN string_split(aliases, '|')[1] END, CASE WHEN aliases IS NOT NULL THEN string_split(aliases, '|')[2] END) AS aliases FROM locations""")
def location_aliases(t: Net) -> DataFrame:
    """All names of a place in a fixed order of fields, then its listed aliases, without blanks and repeats."""
    fields = [F.trim(F.col(c)) for c in ("name", "code", "region", "kind", "name")]
    given = F.filter(F.concat(F.array(*fields), items("aliases")), lambda x: x.isNotNull() & (x != ""))
    return t.locations.select("location_id", F.array_join(F.array_distinct(given), "|").alias("aliases"))


@operator("""SELECT location_id, round(CASE WHEN location_id % 2 = 0 THEN 1 ELSE -1 END * (location_id + (2 * location_id) / 60.0e0), 6) AS lat,
  CASE WHEN location_id <> 11 THEN round(CASE WHEN location_id % 3 = 0 THEN 1 ELSE -1 END * (100 + location_id + location_id / 60.0e0), 6) END AS lng FROM locations""")
def parse_dms(t: Net) -> DataFrame:
    """``DDMM[NS] DDDMM[EW]`` as degrees; a half that doesn't read is null."""
    k = F.col("location_id")
    raw = F.concat(
        F.format_string("%02d%02d", k, k * 2), F.when(k % 2 == 0, "N").otherwise("S"), F.lit(" "), F.format_string("%03d%02d", k + 100, k), F.when(k == 11, "?").when(k % 3 == 0, "E").otherwise("W")
    )

    def degrees(pattern: str, negative: str) -> Column:
        part = lambda i: F.regexp_extract("raw", pattern, i)
        value = F.try_to_number(part(1), F.lit("999")).cast("double") + F.try_to_number(part(2), F.lit("99")).cast("double") / 60
        return F.when(F.col("raw").rlike(pattern), F.round(F.when(part(3) == negative, -value).otherwise(value), 6))

    return t.locations.select("location_id", raw.alias("raw")).select("location_id", degrees(r"^(\d{2})(\d{2})([NS])\b", "S").alias("lat"), degrees(r"\b(\d{3})(\d{2})([EW])$", "W").alias("lng"))


def first_positive_of(*values: Column) -> Column:
    """The first value above zero; zero counts as missing, and text that isn't a number too."""
    tried = [v.try_cast("double") for v in values]
    return F.coalesce(*[F.when(v > 0, v) for v in tried])


@operator("""SELECT c_custkey, CASE WHEN c_custkey % 4 <> 0 AND c_acctbal > 0 THEN c_acctbal WHEN c_nationkey > 0 THEN c_nationkey * 1.0e0 END AS value FROM customer""")
def first_positive(t: Net) -> DataFrame:
    first = F.when(F.col("c_custkey") % 4 == 0, "n/a").otherwise(F.col("c_acctbal").cast("string"))
    return t.customer.select("c_custkey", first_positive_of(first, F.col("c_nationkey").cast("string")).alias("value"))


@operator("""SELECT event_id, CASE WHEN event_id % 5 <> 0 AND event_id % 7 <> 0 THEN CAST(regexp_extract(props, '[0-9]+') AS BIGINT) END AS k, event_id % 5 <> 0 AS readable FROM events""")
def tolerant_json(t: Net) -> DataFrame:
    """A field of JSON text: broken text reads as nothing, a field of another type as null."""
    raw = F.when(F.col("event_id") % 5 == 0, F.substring("props", 1, 5)).when(F.col("event_id") % 7 == 0, '{"k": "many"}').otherwise(F.col("props"))
    tree = F.try_parse_json(raw)
    return t.events.select("event_id", F.try_variant_get(tree, "$.k", "bigint").alias("k"), tree.isNotNull().alias("readable"))


@operator("SELECT segment_id, factor FROM factors WHERE abs(score - 0.5e0) < 1.0e-9 OR abs(score - 50) < 1.0e-9")
def neutral_defaults(t: Net) -> DataFrame:
    """Factors whose value is a neutral filler, from a map of a segment's factors."""
    maps = t.factors.filter("score is not null").groupBy("segment_id").agg(F.map_from_entries(F.collect_list(F.struct("factor", "score"))).alias("m"))
    near = lambda v, x: F.abs(v - x) < 1e-9
    return maps.select("segment_id", F.explode(F.map_keys(F.map_filter("m", lambda k, v: near(v, 0.5) | near(v, 50)))).alias("factor"))


@operator("""SELECT c_custkey, CASE WHEN lower(c_name) LIKE '%13%' THEN 'demo' WHEN lower(c_mktsegment) LIKE '%machin%' THEN 'synthetic' ELSE 'real' END AS status FROM customer""")
def source_status(t: Net) -> DataFrame:
    """The first marker that the record's joined text holds."""
    text = F.lower(F.concat_ws(" ", "c_name", "c_mktsegment"))
    markers = {"demo": ["13"], "synthetic": ["machin", "mock"]}
    rule = F.coalesce(*[F.when(F.exists(F.array(*map(F.lit, ms)), lambda m: text.contains(m)), status) for status, ms in markers.items()], F.lit("real"))
    return t.customer.select("c_custkey", rule.alias("status"))


def redacted(properties: Column) -> Column:
    """A map of properties with the values of secret keys replaced, whatever they are."""
    secret = lambda k: F.lower(k).rlike("password|secret|token|api_?key|credential")
    return F.transform_values(properties, lambda k, v: F.when(secret(k), F.lit("[redacted]")).otherwise(v))


@operator("""SELECT c_custkey, concat('{"Api_Key":"[redacted]","name":"', c_name, '","userToken":"[redacted]"}') AS properties FROM customer""")
def redact_keys(t: Net) -> DataFrame:
    made = F.create_map(F.lit("Api_Key"), "c_mktsegment", F.lit("name"), "c_name", F.lit("userToken"), F.md5("c_name"))
    return t.customer.select("c_custkey", F.to_json(redacted(made)).alias("properties"))


def bounded_number(text: Column, low: float, high: float) -> Column:
    """A number inside its range; anything else is null."""
    x = text.try_cast("double")
    return F.when(x.between(low, high), x)


def clean_name(text: Column) -> Column:
    """Vessel text without its filler (@ and NUL), blanks collapsed; nothing left is null."""
    return F.nullif(F.trim(F.regexp_replace(F.translate(F.regexp_replace(text, "\x00", ""), "@", " "), r"\s+", " ")), F.lit(""))


@operator("""SELECT event_id, CASE WHEN event_type <> 'error' AND value <= 102.2e0 THEN value END AS speed, CASE WHEN k <= 15 THEN k END AS nav_code, CASE WHEN event_id % 3 = 0 THEN NULL ELSE concat('MV ', event_type) END AS name
FROM (SELECT *, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k FROM events) x""")
def ais_field_coercion(t: Net) -> DataFrame:
    """Fields of a message under keys in any case: numbers in their range, names without filler."""
    sent = F.create_map(
        F.lit("SOG"), F.when(F.col("event_type") == "error", "fast").otherwise(F.col("value").cast("string")),
        F.lit("navigationalstatus"), F.regexp_extract("props", "[0-9]+", 0),
        F.lit("NAME"), F.when(F.col("event_id") % 3 == 0, "@@@ ").otherwise(F.concat(F.lit("@MV@@ "), "event_type", F.lit("@@"))),
    )
    by_name = F.transform_keys(sent, lambda k, v: F.lower(k))
    field = lambda k: F.try_element_at("m", F.lit(k.lower()))
    rows = t.events.select("event_id", by_name.alias("m"))
    return rows.select("event_id", bounded_number(field("Sog"), 0, 102.2).alias("speed"), bounded_number(field("NavigationalStatus"), 0, 15).cast("long").alias("nav_code"), clean_name(field("Name")).alias("name"))


@operator("""SELECT target_id, last_seen, CASE WHEN last_seen + INTERVAL 90 MINUTES > TIMESTAMP '2024-01-20 00:00:00' THEN vessels END AS vessels,
  CASE WHEN last_seen + INTERVAL 90 MINUTES > TIMESTAMP '2024-01-20 00:00:00' THEN 'active' ELSE 'stale' END AS status
FROM (SELECT target_id, max(observed_at) AS last_seen, CAST(count(DISTINCT mmsi) AS BIGINT) AS vessels FROM inside WHERE target_id <> 'T2' OR observed_at < TIMESTAMP '2024-01-10 00:00:00' GROUP BY target_id) x""")
def traffic_snapshot_view(t: Net) -> DataFrame:
    """Snapshots as shown: what has expired keeps its time but not its score."""
    seen = t.inside.filter("target_id <> 'T2' or observed_at < timestamp_ntz '2024-01-10 00:00:00'")
    found = seen.groupBy("target_id").agg(F.max("observed_at").alias("last_seen"), F.count_distinct("mmsi").alias("vessels"))
    live = F.col("last_seen") + F.expr("INTERVAL 90 MINUTES") > F.expr("timestamp_ntz '2024-01-20 00:00:00'")
    return found.select("target_id", "last_seen", F.when(live, F.col("vessels")).alias("vessels"), F.when(live, "active").otherwise("stale").alias("status"))
