"""Composite scoring models (section L): signals, cost, duration, utility, weather, overlays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideway.functions.geo import ends, haversine, haversine_sql, pairs
from tideway.functions.scalars import CODE_ROWS, CURVES, TEMPERATURE, code_score, curve_sql, interpolated, temperature_score
from tideway.operators.aggregates import MEAN, P90, USED, provider_scores, ranked, rounded, weighted_mean
from tideway.operators.filters import active
from tideway.sources.silver import NOW
from tideway.sources.tables import Net, operator

#: Fixed values by mode: rate per km, fuel share, handling fee, vehicles a unit, detour, speed km/h, terminal hours.
MODES = {
    "road": (1.20, 0.18, 0.0, 8, 1.22, 65.0, 2.0),
    "rail": (0.55, 0.10, 180.0, 10, 1.18, 55.0, 12.0),
    "sea": (0.11, 0.16, 420.0, 2, 1.12, 32.0, 36.0),
    "air": (3.80, 0.24, 680.0, 1, 1.04, 760.0, 8.0),
}
FIELDS = ("rate", "fuel", "handling", "capacity", "detour", "speed", "terminal")
#: Fixed values of a sea shipment: rate multipliers and capacities.
SHIPMENT = {"roro": (0.92, 10)}
CONTAINER = {"20ft": (0.90, 1), "40ft": (1.0, 2), "40hc": (1.08, 2)}
LOW, HIGH, ESTIMATED, SYNTHETIC, OBSERVED = 0.82, 1.45, 0.35, 0.20, 0.70
TRUSTED = ("observed", "quoted", "contracted")
#: Bounds of the utilities (best, worst) and the share of the uncertainty penalty.
BOUNDS = {"risk": (0.0, 100.0), "cost": (0.0, 50000.0), "duration": (0.0, 120.0)}
PENALTY = 0.20
#: Weights of weather metrics for ports and by mode.
PORT = {"wind": 0.20, "gust": 0.15, "precipitation": 0.15, "visibility": 0.15, "wave": 0.25, "temperature": 0.05, "code": 0.05}
BY_MODE = {
    "sea": {"wind": 0.15, "gust": 0.15, "precipitation": 0.10, "visibility": 0.15, "wave": 0.40, "code": 0.05},
    "air": {"wind": 0.20, "gust": 0.25, "precipitation": 0.15, "visibility": 0.25, "code": 0.15},
    "road": {"wind": 0.05, "precipitation": 0.25, "snowfall": 0.20, "visibility": 0.20, "temperature": 0.15, "code": 0.15},
    "rail": {"wind": 0.15, "gust": 0.10, "precipitation": 0.15, "snowfall": 0.25, "visibility": 0.05, "temperature": 0.20, "code": 0.10},
}
MODE_ROWS = ", ".join(f"('{m}', {r}e0, {f}e0, {h}e0, {c}, {d}e0, {s}e0, {x}e0, {P90[m]}e0)" for m, (r, f, h, c, d, s, x) in MODES.items())
LEGS = f"""(SELECT s.*, {haversine_sql('a', 'b', 6371.0)} AS km, m.* FROM segments s JOIN locations a ON s.from_id = a.location_id JOIN locations b ON s.to_id = b.location_id
JOIN (VALUES {MODE_ROWS}) m(m, rate, fuel, handling, capacity, detour, speed, terminal, p90) ON m.m = s.mode)"""


def by_mode(field: str) -> Column:
    """A fixed value of the row's mode."""
    k = FIELDS.index(field)
    return F.element_at(F.create_map(*[F.lit(x) for m, row in MODES.items() for x in (m, float(row[k]))]), F.col("mode"))


def located(t: Net) -> DataFrame:
    """Segments with the great-circle distance between their ends."""
    km = pairs(t).select(F.col("a").alias("from_id"), F.col("b").alias("to_id"), haversine(*ends(), 6371.0).alias("km"))
    return t.segments.join(km, ["from_id", "to_id"])


def estimated_cost(km: Column, quantity: int, shipment: str | None = None, container: str | None = None, kg: float | None = None, m3: float | None = None, electric: bool = False) -> dict[str, Column]:
    """Parts of a formula cost of ``quantity`` vehicles over ``km`` in the row's mode: movement, fuel, handling, surcharge,
    total.  Shipment and container count at sea only; weight and volume scale the movement if they are known."""
    sea = F.col("mode") == "sea"
    ship, ship_capacity = SHIPMENT.get(shipment or "", (1.0, None))
    box, box_capacity = CONTAINER.get(container or "", (1.0, None))
    scale = (max(kg / quantity / 2000, 0.1) ** 0.35 if kg else 1.0) * (max(m3 / 10, 0.1) ** 0.25 if m3 else 1.0)
    movement = km * by_mode("rate") * (quantity * scale) * F.when(sea, ship * box).otherwise(1.0)
    fuel = movement * by_mode("fuel")
    sea_capacity = box_capacity if shipment == "container" and box_capacity else ship_capacity
    capacity = by_mode("capacity") if sea_capacity is None else F.when(sea, float(sea_capacity)).otherwise(by_mode("capacity"))
    handling = by_mode("handling") * F.ceil(F.lit(float(quantity)) / capacity)
    surcharge = (movement + fuel + handling) * (0.08 if electric else 0.0)
    return {"movement": movement, "fuel": fuel, "handling": handling, "surcharge": surcharge, "total": movement + fuel + handling + surcharge}


def trusted_cost(quantity: int, now: Column, cargo: str = "vehicle") -> Column:
    """Whether the row's cost observation may stand for a formula: a trusted status, a positive amount, a provider, in
    USD, for the same quantity and cargo, and a quote or contract that is still in force."""
    status = F.col("obs_status")
    lasting = ~status.isin("quoted", "contracted") | active("obs_until", now)
    same = F.coalesce(F.col("obs_cargo"), F.lit(cargo)) == cargo
    return F.coalesce(status.isin(*TRUSTED) & (F.col("obs_amount") > 0) & F.col("provider").isNotNull() & (F.col("obs_currency") == "USD") & (F.col("obs_quantity") == quantity) & same & lasting, F.lit(False))


OBSERVED_COST = """CASE n % 6 WHEN 0 THEN 'observed' WHEN 1 THEN 'quoted' WHEN 2 THEN 'estimated' WHEN 3 THEN 'contracted' END AS obs_status, cost * 10 - 500 AS obs_amount,
  CASE WHEN n % 19 = 0 THEN 'EUR' ELSE 'USD' END AS obs_currency, CASE WHEN n % 5 = 0 THEN 3 ELSE 2 END AS obs_quantity, CASE WHEN n % 23 = 0 THEN 'grain' WHEN n % 2 = 0 THEN 'vehicle' END AS obs_cargo, expires_at AS obs_until"""


def utility(x: Column, bound: str) -> Column:
    """100 at the best bound, 0 at the worst and beyond, null for null."""
    best, worst = BOUNDS[bound]
    return F.when(x.isNotNull(), (worst - F.least(F.greatest(x, F.lit(best)), F.lit(worst))) / (worst - best) * 100)


def final(utilities: dict[str, Column], confidences: dict[str, Column], weights: dict[str, float]) -> tuple[Column, Column]:
    """(score, completeness): weighted utilities, unknown ones as 0, less a penalty for what isn't certain."""
    sure = {k: F.when(utilities[k].isNull(), 0.0).otherwise(confidences[k]) for k in weights}
    base = sum((F.coalesce(utilities[k], F.lit(0.0)) * w for k, w in weights.items()), F.lit(0.0))
    doubt = sum(((1 - sure[k]) * w for k, w in weights.items()), F.lit(0.0))
    return F.least(F.greatest(base - 100 * PENALTY * doubt, F.lit(0.0)), F.lit(100.0)), sum((sure[k] * w for k, w in weights.items()), F.lit(0.0))


def metric_scores() -> dict[str, Column]:
    """The risk of each weather metric of a row."""
    found = {k: interpolated(F.col(k), p) for k, p in CURVES.items()}
    return found | {"temperature": temperature_score(F.col("temperature")), "code": code_score(F.col("code"))}


def blended(weights: dict[str, float]) -> tuple[Column, Column, Column]:
    """(score, share of the weight, share of the metrics) of the metrics that the row has, with their weights scaled up."""
    scores = metric_scores()
    total = sum((F.coalesce(scores[k] * w, F.lit(0.0)) for k, w in weights.items()), F.lit(0.0))
    used = sum((F.when(scores[k].isNotNull(), w).otherwise(0.0) for k, w in weights.items()), F.lit(0.0))
    there = sum((scores[k].isNotNull().cast("int") for k in weights), F.lit(0))
    return F.when(used > 0, total / used), used, there / len(weights)


METRIC = {**{k: curve_sql(k, p) for k, p in CURVES.items()}, "temperature": TEMPERATURE.format(x="temperature"), "code": "code_risk"}
SCORED = f"(SELECT f.*, CASE WHEN f.code IS NOT NULL THEN coalesce(c.risk, 25.0e0) END AS code_risk FROM forecasts f LEFT JOIN (VALUES {CODE_ROWS}) c(k, risk) ON c.k = f.code)"
LONG = "(" + " UNION ALL ".join(f"SELECT point_id, hour, '{k}' AS metric, {x} AS v FROM {SCORED} q" for k, x in METRIC.items()) + ")"


@operator("""SELECT f.segment_id, f.factor, CASE WHEN f.factor = 'natural_disaster' AND s.completeness > coalesce(f.score, 0) THEN s.completeness ELSE f.score END AS score FROM factors f JOIN segments s ON f.segment_id = s.segment_id
UNION ALL SELECT segment_id, 'port_congestion', (n % 10) / 10.0e0 FROM segments WHERE mode = 'sea'""")
def segment_signals(t: Net) -> DataFrame:
    """Signals of a segment: news factors, of which weather replaces natural_disaster only if it is worse, and at sea the
    congestion of ports, which is shown but carries no weight."""
    s = t.segments.select("segment_id", "mode", "n", F.col("completeness").alias("weather"))
    worse = (F.col("factor") == "natural_disaster") & (F.col("weather") > F.coalesce("score", F.lit(0.0)))
    news = t.factors.select("segment_id", "factor", "score").join(s, "segment_id").select("segment_id", "factor", F.when(worse, F.col("weather")).otherwise(F.col("score")).alias("score"))
    return news.unionByName(s.filter("mode = 'sea'").select("segment_id", F.lit("port_congestion").alias("factor"), (F.col("n") % 10 / 10).alias("score")))


@operator(f"""SELECT segment_id, substr(sha256(string_agg(concat(factor, '=', CASE WHEN score IS NULL THEN 'null' WHEN score >= 0.5e0 THEN 'high' ELSE 'low' END, '@', coalesce(provider, 'none')), ';' ORDER BY factor)), 1, 16) AS input_hash,
  {USED} AS completeness, string_agg(CASE WHEN score IS NULL OR provider IS NULL THEN factor END, ',' ORDER BY factor) AS missing FROM factors GROUP BY segment_id""")
def risk_properties(t: Net) -> DataFrame:
    """The stored form of a segment's risk: a digest of all inputs in a fixed order, completeness, and what is missing."""
    band = F.when(F.col("score").isNull(), "null").when(F.col("score") >= 0.5, "high").otherwise("low")
    entry = F.concat("factor", F.lit("="), band, F.lit("@"), F.coalesce("provider", F.lit("none")))
    _, used = weighted_mean(F.col("score"), F.col("weight"), F.col("provider").isNotNull())
    lacking = F.when(F.col("score").isNull() | F.col("provider").isNull(), F.col("factor"))
    found = t.factors.groupBy("segment_id").agg(F.sort_array(F.collect_list(entry)).alias("e"), rounded(used, 4).alias("completeness"), F.sort_array(F.collect_list(lacking)).alias("m"))
    return found.select("segment_id", F.substring(F.sha2(F.array_join("e", ";"), 256), 1, 16).alias("input_hash"), "completeness", F.when(F.size("m") > 0, F.array_join("m", ",")).alias("missing"))


@operator(f"""SELECT segment_id, {MEAN} AS score, {USED} AS completeness FROM (SELECT f.segment_id, f.weight, f.provider,
  CASE WHEN f.factor = 'natural_disaster' AND s.completeness > coalesce(f.score, 0) THEN s.completeness ELSE f.score END AS score FROM factors f JOIN segments s ON s.segment_id = f.segment_id) x GROUP BY segment_id""")
def three_factor_overlay(t: Net) -> DataFrame:
    """A segment's risk at request time, from its news factors and the weather; the stored risk isn't read."""
    signals = segment_signals(t).filter("factor <> 'port_congestion'")
    return provider_scores(t.factors.drop("score").join(signals, ["segment_id", "factor"])).select("segment_id", "score", "completeness")


@operator(f"""SELECT segment_id, CASE WHEN ok THEN round(obs_amount + 1e-10, 2) ELSE round(total + 1e-10, 2) END AS cost, CASE WHEN ok THEN round(obs_amount + 1e-10, 2) ELSE round(0.82e0 * total + 1e-10, 2) END AS low,
  CASE WHEN ok THEN round(obs_amount + 1e-10, 2) ELSE round(1.45e0 * total + 1e-10, 2) END AS high, CASE WHEN ok THEN obs_status ELSE 'estimated' END AS status,
  CASE WHEN ok THEN 0.7e0 WHEN data_status = 'synthetic' THEN 0.2e0 ELSE 0.35e0 END AS confidence FROM (SELECT *, provider IS NOT NULL AND coalesce(obs_status, '') IN ('observed', 'quoted', 'contracted') AND obs_amount > 0 AND obs_currency = 'USD' AND obs_quantity = 2
  AND coalesce(obs_cargo, 'vehicle') = 'vehicle' AND (obs_status = 'observed' OR expires_at > {NOW}) AS ok, 1.08e0 * (km * rate * 2 * CASE WHEN mode = 'sea' THEN 0.92e0 ELSE 1.0e0 END * pow(0.75e0, 0.35e0) * (1 + fuel)
  + handling * CASE mode WHEN 'air' THEN 2 ELSE 1 END) AS total FROM (SELECT *, {OBSERVED_COST} FROM {LEGS} l) x) y""")
def segment_cost(t: Net) -> DataFrame:
    """A trusted observation of the same quantity, else the formula, with its range and confidence."""
    rows = located(t).selectExpr("*", *OBSERVED_COST.replace("\n", " ").split(", "))
    quantity = 2
    total = estimated_cost(F.col("km"), quantity, shipment="roro", kg=3000.0, electric=True)["total"]
    ok = trusted_cost(quantity, F.expr(NOW))
    pick = lambda factor: F.when(ok, rounded(F.col("obs_amount"), 2)).otherwise(rounded(factor * total, 2))
    sure = F.when(ok, OBSERVED).when(F.col("data_status") == "synthetic", SYNTHETIC).otherwise(ESTIMATED)
    return rows.select("segment_id", pick(F.lit(1.0)).alias("cost"), pick(F.lit(LOW)).alias("low"), pick(F.lit(HIGH)).alias("high"), F.when(ok, F.col("obs_status")).otherwise("estimated").alias("status"), sure.alias("confidence"))


def duration(km: Column) -> tuple[Column, Column, Column]:
    """(median days, 90th percentile, status): a trusted observation, else the known days, else distance and terminals."""
    factor = F.element_at(F.create_map(*[F.lit(x) for kv in P90.items() for x in kv]), F.col("mode"))
    trusted = F.coalesce(F.col("obs_status").isin(*TRUSTED) & F.col("provider").isNotNull() & (F.col("obs_p50") > 0), F.lit(False))
    known = F.when(F.col("known_days") > 0, F.col("known_days"))
    p50 = F.when(trusted, F.col("obs_p50")).otherwise(F.coalesce(known, (km / by_mode("speed") + by_mode("terminal")) / 24))
    p90 = F.when(trusted, F.greatest("obs_p50", F.when(F.col("obs_p90") > 0, F.col("obs_p90")))).otherwise(p50 * factor)
    return p50, p90, F.when(trusted, F.col("obs_status")).otherwise("estimated")


OBSERVED_DAYS = "CASE n % 6 WHEN 0 THEN 'observed' WHEN 1 THEN 'quoted' WHEN 2 THEN 'guessed' END AS obs_status, time_days - 20 AS obs_p50, CASE WHEN n % 4 > 1 THEN time_days - 19 END AS obs_p90, CASE WHEN n % 2 = 0 THEN time_days END AS known_days"


@operator(f"""SELECT segment_id, round(p50 + 1e-10, 3) AS p50, round(CASE WHEN ok THEN coalesce(obs_p90, p50) ELSE p50 * p90 END + 1e-10, 3) AS p90, CASE WHEN ok THEN obs_status ELSE 'estimated' END AS status FROM
 (SELECT *, CASE WHEN ok THEN obs_p50 WHEN known_days IS NOT NULL THEN known_days ELSE (km / speed + terminal) / 24 END AS p50 FROM (SELECT *, provider IS NOT NULL AND coalesce(obs_status, '') IN ('observed', 'quoted') AND obs_p50 > 0 AS ok
  FROM (SELECT *, {OBSERVED_DAYS} FROM {LEGS} l) x) y) z""")
def segment_duration(t: Net) -> DataFrame:
    rows = located(t).selectExpr("*", *OBSERVED_DAYS.split(", "))
    p50, p90, status = duration(F.col("km"))
    return rows.select("segment_id", rounded(p50, 3).alias("p50"), rounded(p90, 3).alias("p90"), status.alias("status"))


@operator("""SELECT segment_id, CASE WHEN risk IS NOT NULL THEN round(100 - greatest(0, least(100, risk * 130 - 10)) + 1e-10, 6) END AS risk_utility, round(100 - greatest(0, least(50000, cost * 60)) / 500 + 1e-10, 6) AS cost_utility,
  round(100 - greatest(0, least(120, time_days * 5)) / 1.2e0 + 1e-10, 6) AS time_utility, round(CASE WHEN risk IS NULL THEN 1.0e0 ELSE greatest(0, least(100, risk * 130 - 10)) / 100 END + 1e-10, 6) AS risk_penalty FROM segments""")
def utility_scores(t: Net) -> DataFrame:
    """Utilities on fixed bounds; an unknown one has no utility and the full penalty."""
    risk = utility(F.col("risk") * 130 - 10, "risk")
    rows = t.segments.select("segment_id", risk.alias("r"), utility(F.col("cost") * 60, "cost").alias("c"), utility(F.col("time_days") * 5, "duration").alias("d"))
    penalty = F.coalesce(1 - F.col("r") / 100, F.lit(1.0))
    return rows.select("segment_id", rounded(F.col("r")).alias("risk_utility"), rounded(F.col("c")).alias("cost_utility"), rounded(F.col("d")).alias("time_utility"), rounded(penalty).alias("risk_penalty"))


@operator("""SELECT segment_id, round(greatest(0.0e0, least(100.0e0, 0.4e0 * coalesce(100 - risk * 100, 0) + 0.3e0 * (100 - least(cost * 60, 50000) / 500) + 0.3e0 * (100 - time_days / 1.2e0)
  - 20 * (1 - 0.4e0 * CASE WHEN risk IS NULL THEN 0 ELSE completeness END - 0.3e0 * 0.35e0 - 0.3e0 * 0.7e0))) + 1e-10, 6) AS score,
  round(0.4e0 * CASE WHEN risk IS NULL THEN 0 ELSE completeness END + 0.3e0 * 0.35e0 + 0.3e0 * 0.7e0 + 1e-10, 6) AS completeness FROM segments""")
def final_score(t: Net) -> DataFrame:
    utilities = {"risk": utility(F.col("risk") * 100, "risk"), "cost": utility(F.col("cost") * 60, "cost"), "duration": utility(F.col("time_days"), "duration")}
    sure = {"risk": F.col("completeness"), "cost": F.lit(ESTIMATED), "duration": F.lit(OBSERVED)}
    score, complete = final(utilities, sure, {"risk": 0.4, "cost": 0.3, "duration": 0.3})
    return t.segments.select("segment_id", rounded(score).alias("score"), rounded(complete).alias("completeness"))


@operator("""SELECT s.segment_id, f.supplier_id, round(CASE WHEN s.risk IS NULL THEN (f.supplier_id % 100) / 100.0e0 ELSE 0.2e0 * ((f.supplier_id % 100) / 100.0e0) + 0.8e0 * s.risk END + 1e-10, 6) AS blended
FROM segments s JOIN suppliers_from f ON s.from_id = f.origin_id""")
def supplier_blend(t: Net) -> DataFrame:
    own = F.col("supplier_id") % 100 / 100
    rows = t.segments.select("segment_id", "risk", F.col("from_id").alias("origin_id")).join(t.suppliers_from, "origin_id")
    return rows.select("segment_id", "supplier_id", rounded(F.coalesce(0.2 * own + 0.8 * F.col("risk"), own)).alias("blended"))


PORT_ROWS = ", ".join(f"('{k}', {w}e0)" for k, w in PORT.items())


@operator(f"""SELECT point_id, hour, CASE WHEN share < 0.4e0 THEN NULL ELSE round(score + 1e-10, 4) END AS score, CASE WHEN share < 0.4e0 THEN 'INSUFFICIENT_DATA' WHEN score < 25 THEN 'LOW' WHEN score < 50 THEN 'MEDIUM' WHEN score < 75 THEN 'HIGH' ELSE 'CRITICAL' END AS level,
  round(share * CASE WHEN waves = 0 THEN 0.85e0 ELSE 1.0e0 END + 1e-10, 4) AS confidence FROM (SELECT point_id, hour, sum(v * w) / sum(CASE WHEN v IS NOT NULL THEN w END) AS score, count(v) / 7.0e0 AS share, count(CASE WHEN metric = 'wave' THEN v END) AS waves
  FROM {LONG} l JOIN (VALUES {PORT_ROWS}) p(m, w) ON p.m = l.metric GROUP BY point_id, hour) x""")
def port_weather_score(t: Net) -> DataFrame:
    """Seven metrics; confidence is the share that is there, less without waves; below 0.4 there is no score."""
    score, _, share = blended(PORT)
    rows = t.forecasts.select("point_id", "hour", score.alias("x"), share.alias("s"), F.col("wave").isNull().alias("no_wave"))
    enough = F.col("s") >= 0.4
    level = F.when(~enough, "INSUFFICIENT_DATA").when(F.col("x") < 25, "LOW").when(F.col("x") < 50, "MEDIUM").when(F.col("x") < 75, "HIGH").otherwise("CRITICAL")
    return rows.select("point_id", "hour", F.when(enough, rounded(F.col("x"), 4)).alias("score"), level.alias("level"), rounded(F.col("s") * F.when(F.col("no_wave"), 0.85).otherwise(1.0), 4).alias("confidence"))


MODE_WEIGHTS = ", ".join(f"('{m}', '{k}', {w}e0)" for m, ws in BY_MODE.items() for k, w in ws.items())


@operator(f"""SELECT point_id, hour, p.mode, round(sum(v * w) / sum(CASE WHEN v IS NOT NULL THEN w END) + 1e-10, 4) AS score, round(coalesce(sum(CASE WHEN v IS NOT NULL THEN w END), 0) + 1e-10, 4) AS completeness
FROM {LONG} l JOIN (VALUES {MODE_WEIGHTS}) p(mode, m, w) ON p.m = l.metric GROUP BY point_id, hour, p.mode""")
def mode_weather_score(t: Net) -> DataFrame:
    """The weather's score for each mode, whose completeness counts weights, not metrics; all modes in one pass."""
    each = []
    for mode, weights in BY_MODE.items():
        score, used, _ = blended(weights)
        each.append(F.struct(F.lit(mode).alias("mode"), rounded(score, 4).alias("score"), rounded(used, 4).alias("completeness")))
    return t.forecasts.select("point_id", "hour", F.explode(F.array(*each)).alias("x")).select("point_id", "hour", "x.mode", "x.score", "x.completeness")


SEA_SCORE = f"(SELECT point_id, hour, row_number() OVER (PARTITION BY point_id ORDER BY hour) - 1 AS r, score FROM (SELECT point_id, hour, sum(v * w) / sum(CASE WHEN v IS NOT NULL THEN w END) AS score FROM {LONG} l JOIN (VALUES {MODE_WEIGHTS}) p(mode, m, w) ON p.m = l.metric AND p.mode = 'sea' GROUP BY point_id, hour) x)"


def sea_hours(t: Net) -> DataFrame:
    """The sea score of each point's hours, numbered from 0."""
    score, _, _ = blended(BY_MODE["sea"])
    number = F.row_number().over(Window.partitionBy("point_id").orderBy("hour")) - 1
    return t.forecasts.select("point_id", number.alias("r"), score.alias("score"))


def samples(t: Net, fractions: list[float]) -> DataFrame:
    """Points and hours at which a segment is sampled: by the time at which it gets there, or now without a time."""
    days = F.when(F.col("n") % 5 != 0, F.col("time_days"))
    each = F.explode(F.array(*map(F.lit, fractions))).alias("fraction")
    rows = t.segments.select("segment_id", "from_id", "to_id", "n", "data_status", days.alias("days"), each)
    point = F.when(F.col("fraction") < 0.5, F.col("from_id")).otherwise(F.col("to_id"))
    hour = F.coalesce(F.floor(F.col("days") * F.col("fraction")), F.lit(0))
    return rows.select("segment_id", "n", "data_status", "fraction", point.cast("long").alias("point_id"), hour.cast("int").alias("r"), F.when(F.col("days").isNull(), 0.7).otherwise(1.0).alias("sure"))


SAMPLES = """(SELECT segment_id, n, data_status, f AS fraction, CASE WHEN f < 0.5e0 THEN from_id ELSE to_id END AS point_id, CASE WHEN n % 5 = 0 THEN 0 ELSE floor(time_days * f) END AS r, CASE WHEN n % 5 = 0 THEN 0.7e0 ELSE 1.0e0 END AS sure
FROM segments, unnest([{0}]) AS u(f))"""


@operator(f"SELECT s.segment_id, round(w.score + 1e-10, 4) AS score, s.sure AS confidence FROM {SAMPLES.format('0.75e0')} s JOIN {SEA_SCORE} w ON w.point_id = s.point_id AND w.r = s.r")
def sample_weather_score(t: Net) -> DataFrame:
    """The weather where a segment is at three quarters of its way, when it gets there; without a time now, and less sure."""
    return samples(t, [0.75]).join(sea_hours(t), ["point_id", "r"]).select("segment_id", rounded(F.col("score"), 4).alias("score"), F.col("sure").alias("confidence"))


@operator(f"""SELECT segment_id, round(0.6e0 * max(score) + 0.4e0 * avg(score) + 1e-10, 4) AS score, CAST(count(*) AS BIGINT) AS samples, round(count(*) / 3.0e0 + 1e-10, 4) AS coverage, round(0.55e0 * count(*) / 3.0e0 * avg(sure) + 1e-10, 4) AS confidence,
  CASE WHEN count(*) = 3 THEN 'available' ELSE 'partial' END AS status FROM (SELECT s.*, w.score FROM {SAMPLES.format('0.0e0, 0.5e0, 1.0e0')} s JOIN {SEA_SCORE} w ON w.point_id = s.point_id AND w.r = s.r WHERE s.data_status <> 'synthetic') x GROUP BY segment_id""")
def route_weather_job(t: Net) -> DataFrame:
    """Eligible segments, their samples, each distinct point and hour looked up once, scored and put together."""
    wanted = samples(t, [0.0, 0.5, 1.0]).filter("data_status <> 'synthetic'")
    places = wanted.select("point_id", "r").distinct().join(sea_hours(t), ["point_id", "r"])
    found = wanted.join(places, ["point_id", "r"]).groupBy("segment_id")
    score, coverage = F.col("score"), F.count("*") / 3
    return found.agg(
        rounded(0.6 * F.max(score) + 0.4 * F.avg(score), 4).alias("score"),
        F.count("*").alias("samples"),
        rounded(coverage, 4).alias("coverage"),
        rounded(0.55 * coverage * F.avg("sure"), 4).alias("confidence"),
        F.when(F.count("*") == 3, "available").otherwise("partial").alias("status"),
    )


@operator(f"SELECT segment_id, {MEAN} AS score, {USED} AS completeness FROM (SELECT segment_id, provider, weight, CASE WHEN factor = 'war' THEN score END AS score FROM factors) x GROUP BY segment_id")
def risk_recompute(t: Net) -> DataFrame:
    """The recalculation from stored overlays, which knows one news score only and counts it as war."""
    news = t.factors.withColumn("score", F.when(F.col("factor") == "war", F.col("score")))
    return provider_scores(news).select("segment_id", "score", "completeness")


@operator(f"SELECT segment_id, round(km * rate + 1e-10, 4) AS movement, round(km * rate * fuel + 1e-10, 4) AS fuel_cost, handling AS handling_cost FROM {LEGS} l")
def simple_cost(t: Net) -> DataFrame:
    movement = F.col("km") * by_mode("rate")
    return located(t).select("segment_id", rounded(movement, 4).alias("movement"), rounded(movement * by_mode("fuel"), 4).alias("fuel_cost"), by_mode("handling").alias("handling_cost"))


@operator("SELECT segment_id, round(sum(score * weight) / nullif(sum(CASE WHEN score IS NOT NULL THEN weight END), 0) + 1e-10, 6) AS score FROM factors GROUP BY segment_id")
def simple_risk(t: Net) -> DataFrame:
    mean, _ = weighted_mean(F.col("score"), F.col("weight"), F.lit(True))
    return t.factors.groupBy("segment_id").agg(rounded(mean).alias("score"))


@operator("""SELECT segment_id, CAST(row_number() OVER (ORDER BY round(0.40e0 * (1 - coalesce(risk, 1)) + 0.30e0 * (1 - least(cost / 1000, 1)) + 0.20e0 * (1 - least(time_days / 120, 1)) + 0.10e0 * completeness + 1e-10, 9) DESC, segment_id) AS BIGINT) AS place FROM segments""")
def hybrid_rank(t: Net) -> DataFrame:
    below = lambda x: 1 - F.least(x, F.lit(1.0))
    value = 0.40 * (1 - F.coalesce("risk", F.lit(1.0))) + 0.30 * below(F.col("cost") / 1000) + 0.20 * below(F.col("time_days") / 120) + 0.10 * F.col("completeness")
    rows = t.segments.select("segment_id", (-F.round(value + 1e-10, 9)).alias("v"))
    return ranked(rows, ["v", "segment_id"], "place").select("segment_id", "place")


@operator(f"SELECT segment_id, round(km * detour + 1e-10, 4) AS km, round(km * detour / speed + terminal + 1e-10, 4) AS hours FROM {LEGS} l")
def leg_estimate(t: Net) -> DataFrame:
    km = F.col("km") * by_mode("detour")
    return located(t).select("segment_id", rounded(km, 4).alias("km"), rounded(km / by_mode("speed") + by_mode("terminal"), 4).alias("hours"))


@operator(f"""WITH p AS (SELECT point_id, hour, sum(v * w) / sum(CASE WHEN v IS NOT NULL THEN w END) AS score, row_number() OVER (PARTITION BY point_id ORDER BY hour) AS r FROM {LONG} l JOIN (VALUES {PORT_ROWS}) p(m, w) ON p.m = l.metric GROUP BY point_id, hour)
SELECT concat('port|', CAST(point_id AS STRING), '|', strftime(min(hour), '%Y%m%d%H')) AS snapshot_id, CAST(floor((dense_rank() OVER (ORDER BY point_id) - 1) / 25) AS BIGINT) AS batch,
  round(max(CASE WHEN r = 1 THEN score END) + 1e-10, 4) AS current, round(max(score) + 1e-10, 4) AS worst FROM p WHERE r <= 24 GROUP BY point_id""")
def port_weather_job(t: Net) -> DataFrame:
    """A snapshot for each port: now and the worst of 24 hours, in request batches of 25 ports."""
    score, _, _ = blended(PORT)
    number = F.row_number().over(Window.partitionBy("point_id").orderBy("hour"))
    hours = t.forecasts.select("point_id", "hour", score.alias("score"), number.alias("r")).filter("r <= 24")
    found = hours.groupBy("point_id").agg(F.min("hour").alias("first"), F.max(F.when(F.col("r") == 1, F.col("score"))).alias("now"), F.max("score").alias("worst"))
    name = F.concat(F.lit("port|"), F.col("point_id").cast("string"), F.lit("|"), F.date_format("first", "yyyyMMddHH"))
    batched = ranked(found, ["point_id"], "place").withColumn("batch", F.floor((F.col("place") - 1) / 25))
    return batched.select(name.alias("snapshot_id"), "batch", rounded(F.col("now"), 4).alias("current"), rounded(F.col("worst"), 4).alias("worst"))
