"""Route recommendation: request, strategies, scored candidates, constraints, snapshots and their quality."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideway.operators.aggregates import rounded
from tideway.operators.filters import items, without_high_risk
from tideway.operators.graph import Search, candidates, checkpointed, legs, route_id, weighted
from tideway.plans.scoring import BOUNDS, duration, estimated_cost, final, located, trusted_cost, utility
from tideway.sources.silver import NOW
from tideway.sources.tables import Net, operator

#: The weights of the strategies, the risk from which a path is rerouted, and the sizes of the pool.
STRATEGIES = {"min_risk": (1.0, 0.0, 0.0), "min_cost": (0.0, 1.0, 0.0), "fastest": (0.0, 0.0, 1.0), "balanced": (0.4, 0.3, 0.3)}
HIGH_RISK, PER_OBJECTIVE, POOL, REJECTED = 0.60, 30, 120, 50
ALL_MODES = ("road", "rail", "sea", "air")


@dataclass(frozen=True)
class Weights:
    """Weights of risk, cost and duration, which add up to 1."""

    risk: float
    cost: float
    duration: float

    def __post_init__(self):
        if abs(self.risk + self.cost + self.duration - 1) > 1e-6 or min(self.risk, self.cost, self.duration) < 0:
            raise ValueError(f"weights {self} don't add up to 1")


@dataclass(frozen=True)
class Cargo:
    quantity: int = 1
    type: str = "vehicle"
    shipment: str | None = None
    container: str | None = None
    kg: float | None = None
    m3: float | None = None
    electric: bool = False

    def __post_init__(self):
        if self.quantity < 1:
            raise ValueError("a quantity is 1 at least")


@dataclass(frozen=True)
class Constraints:
    allowed_modes: tuple[str, ...] = ALL_MODES
    avoided_zones: tuple[str, ...] = ()
    max_hops: int = 12
    require_known_risk: bool = False
    max_risk: float | None = None
    max_cost: float | None = None
    max_days: float | None = None
    min_completeness: float | None = None

    def __post_init__(self):
        if not 1 <= self.max_hops <= 20 or not set(self.allowed_modes) <= set(ALL_MODES):
            raise ValueError("1 to 20 hops, and modes that are known")


@dataclass(frozen=True)
class Request:
    """What a shipper asks for.  Explicit weights beat those of any strategy; ``custom`` can't do without."""

    origins: frozenset[int]
    destinations: frozenset[int]
    strategy: str = "balanced"
    weights: Weights | None = None
    cargo: Cargo = field(default_factory=Cargo)
    constraints: Constraints = field(default_factory=Constraints)
    limit: int = 5
    auto_reroute: bool = True

    def __post_init__(self):
        if self.strategy not in (*STRATEGIES, "custom") or (self.strategy == "custom" and not self.weights):
            raise ValueError("a strategy, or custom with weights")
        if not 1 <= self.limit <= 10:
            raise ValueError("1 to 10 routes")

    def resolved(self) -> Weights:
        return self.weights or Weights(*STRATEGIES[self.strategy])

    def objectives(self) -> list[str]:
        first = "balanced" if self.strategy == "custom" else self.strategy
        return list(dict.fromkeys((first, "min_risk", "min_cost", "fastest", "balanced")))


def estimated(segments: DataFrame, request: Request, now: Column) -> DataFrame:
    """Feasible segments of the allowed modes outside avoided zones, with cost and time for the request's cargo.

    ``segments``: located segments with the columns of a cost and a time observation (obs_*, days_*).
    """
    c, cargo = request.constraints, request.cargo
    rows = segments.filter((F.coalesce("feasibility", F.lit("")) != "invalid_cross_ocean") & F.col("mode").isin(*c.allowed_modes))
    if c.avoided_zones:
        rows = rows.filter(~F.arrays_overlap(items("zone_ids"), F.array(*map(F.lit, c.avoided_zones))))
    formula = estimated_cost(F.col("km"), cargo.quantity, cargo.shipment, cargo.container, cargo.kg, cargo.m3, cargo.electric)["total"]
    trusted = trusted_cost(cargo.quantity, now, cargo.type)
    synthetic = F.when(F.col("data_status") == "synthetic", 0.20).otherwise(0.35)
    rows = rows.withColumns(
        {"leg_cost": F.round(F.when(trusted, F.col("obs_amount")).otherwise(formula), 2), "cost_sure": F.when(trusted, 0.7).otherwise(synthetic), "cost_status": F.when(trusted, F.col("obs_status")).otherwise("estimated")}
    )
    p50, p90, status = duration(F.col("km"))
    days = rows.drop("obs_status").withColumnsRenamed({"days_status": "obs_status", "days_p50": "obs_p50", "days_p90": "obs_p90"})
    days = days.withColumns({"leg_p50": F.round(p50, 3), "leg_p90": F.round(p90, 3), "time_sure": F.when(status != "estimated", 0.7).otherwise(synthetic)})
    return days.withColumns({"cost": F.col("leg_cost"), "time_days": F.col("leg_p50")})


def scored(paths: DataFrame, segments: DataFrame, request: Request) -> DataFrame:
    """A row for each path with its sums, score, completeness and the reasons why it can't be taken.

    A sum is known only if every leg's part is; the risk is the mean of the known legs, as a whole number of 0 to 100.
    """
    known = F.col("risk").isNotNull()
    route = legs(paths, segments).groupBy("signature").agg(
        F.count("*").alias("hops"),
        F.round(100 * F.avg("risk")).alias("risk"),
        F.avg(F.when(known, F.col("completeness")).otherwise(0.0)).alias("risk_sure"),
        F.when(F.count("leg_cost") == F.count("*"), F.round(F.sum("leg_cost"), 2)).alias("cost"),
        F.min("cost_sure").alias("cost_sure"),
        F.when(F.count("leg_p50") == F.count("*"), F.round(F.sum("leg_p50"), 3)).alias("days"),
        F.when(F.count("leg_p90") == F.count("*"), F.round(F.sum("leg_p90"), 3)).alias("days_p90"),
        F.min("time_sure").alias("time_sure"),
        F.array_sort(F.collect_set("mode")).alias("modes"),
    )
    weights = {k: float(v) for k, v in asdict(request.resolved()).items()}
    utilities = {"risk": utility(F.col("risk"), "risk"), "cost": utility(F.col("cost") / request.cargo.quantity, "cost"), "duration": utility(F.col("days"), "duration")}
    score, complete = final(utilities, {"risk": F.col("risk_sure"), "cost": F.col("cost_sure"), "duration": F.col("time_sure")}, weights)
    penalty = sum((w * (1 - F.coalesce(utilities[k] / 100, F.lit(0.0))) for k, w in weights.items()), F.lit(0.0))
    route = route.withColumns({"score": rounded(score, 4), "completeness": rounded(complete, 4), "penalty": rounded(penalty, 6)})
    c = request.constraints
    over = lambda col, most, name: [F.when(F.col(col).isNull(), f"{name}_unknown").when(F.col(col) > most, f"{name}_over_limit")] if most is not None else []
    reasons = [*over("risk", c.max_risk, "risk"), *over("cost", c.max_cost, "cost"), *over("days", c.max_days, "duration")]
    if c.require_known_risk:
        reasons.append(F.when(F.col("risk").isNull(), "risk_required"))
    if c.min_completeness is not None:
        reasons.append(F.when(F.col("completeness") < c.min_completeness, "completeness_too_low"))
    failed = F.array_compact(F.array(*reasons)) if reasons else F.array().cast("array<string>")
    return route.withColumn("reasons", failed).withColumn("route_id", route_id(F.col("signature")))


def recommend_routes(segments: DataFrame, request: Request, now: Column) -> dict[str, DataFrame | bool]:
    """routes (the best ``limit``), rejected (with reasons), and whether they were rerouted or fell back.

    If the best path has a segment of high risk and the request allows it, the pool is searched again without all such
    segments; nothing found falls back to the first pool.  Rerouted ones are ranked by risk first.
    """
    edges = checkpointed(estimated(segments, request, now))
    w = request.resolved()
    share = w.risk / (w.risk + w.cost) if w.risk + w.cost else 0.5
    search = Search(request.origins, request.destinations, max(3 * request.limit, PER_OBJECTIVE), request.constraints.max_hops)
    pool = lambda rows: checkpointed(candidates(weighted(rows, share, BOUNDS["cost"][1] * request.cargo.quantity), search, request.objectives(), POOL))
    base = pool(edges)
    kept, _ = without_high_risk(edges, HIGH_RISK)
    first = base.orderBy(F.array_position(F.array(*map(F.lit, request.objectives())), F.col("objective")), "place").limit(1)
    wanted = request.auto_reroute and not legs(first, edges).filter(F.col("risk") >= HIGH_RISK).isEmpty()
    safe = pool(kept) if wanted else base
    fallback = wanted and safe.isEmpty()
    chosen = base if fallback else safe
    rerouted = wanted and not fallback
    routes = checkpointed(scored(chosen, edges, request))
    risk_first = [F.asc_nulls_last("risk"), F.asc("penalty")] if rerouted else [F.desc("score"), F.asc_nulls_last("risk")]
    order = [*risk_first, F.asc_nulls_last("cost"), F.asc_nulls_last("days"), F.asc("signature")]
    best = routes.filter(F.size("reasons") == 0).orderBy(*order).limit(request.limit)
    place = F.row_number().over(Window.orderBy(*order))  # ``limit`` rows
    rejected = routes.filter(F.size("reasons") > 0).orderBy("route_id").limit(REJECTED).select("route_id", "reasons")
    return {"routes": best.withColumn("place", place), "rejected": rejected, "rerouted": rerouted, "fallback": fallback}


def decorated(routes: DataFrame) -> DataFrame:
    """Ranked routes with their tags (best, safest, cheapest, fastest) and the differences to the next one."""
    by = Window.orderBy("place")  # as many rows as a request may have
    least = lambda c: F.col(c) == F.min(c).over(Window.partitionBy())
    tags = [F.when(F.col("place") == 1, "best"), F.when(least("risk"), "safest"), F.when(least("cost"), "cheapest"), F.when(least("days"), "fastest")]
    delta = lambda c: F.round(F.col(c) - F.lead(c).over(by), 4).alias(f"{c}_to_next")
    return routes.select("*", F.array_compact(F.array(*tags)).alias("tags"), delta("risk"), delta("cost"), delta("days"))


def snapshot(request: Request, found: dict[str, DataFrame | bool], created: Column) -> tuple[DataFrame, DataFrame]:
    """(snapshots, inclusions): one row with request and response as JSON, and (snapshot_id, segment_id, route_ids)."""
    routes = found["routes"]
    listed = F.array_sort(F.collect_list(F.struct("place", "route_id", "signature", "score")))
    text = str(sorted((k, str(v)) for k, v in asdict(request).items()))
    head = routes.agg(listed.alias("routes")).withColumn("created_at", created)
    head = head.withColumn("snapshot_id", F.concat(F.lit("snap-"), F.substring(F.sha2(F.concat(F.lit(text), F.to_json("routes"), F.col("created_at").cast("string")), 256), 1, 16)))
    snapshots = head.select("snapshot_id", "created_at", F.lit(text).alias("request"), F.to_json(F.struct("routes")).alias("response"), F.transform("routes", lambda r: r["route_id"]).alias("route_ids"))
    used = head.select("snapshot_id", F.explode("routes").alias("r")).select("snapshot_id", "r.route_id", F.explode(F.split("r.signature", r"\|")).alias("segment_id"))
    return snapshots, used.groupBy("snapshot_id", "segment_id").agg(F.array_sort(F.collect_set("route_id")).alias("route_ids"))


def snapshot_by_id(snapshots: DataFrame, snapshot_id: str) -> DataFrame:
    return snapshots.filter(F.col("snapshot_id") == snapshot_id)


def newest_with_route(snapshots: DataFrame, route: str) -> DataFrame:
    """The latest snapshot that holds a route."""
    return snapshots.filter(F.array_contains("route_ids", route)).orderBy(F.desc("created_at"), "snapshot_id").limit(1)


def quality(routes: DataFrame) -> DataFrame:
    """(check, violations): what no returned route may do."""
    rules = {
        "score_out_of_range": ~F.col("score").between(0, 100),
        "completeness_out_of_range": ~F.col("completeness").between(0, 1),
        "p90_below_p50": F.col("days_p90") < F.col("days"),
        "cost_negative": F.col("cost") < 0,
        "risk_out_of_range": ~F.col("risk").between(0, 100),
        "rejected_but_returned": F.size("reasons") > 0,
        "legs_differ_from_hops": F.size(F.split("signature", r"\|")) != F.col("hops"),
    }
    counted = routes.agg(*[F.count_if(F.coalesce(rule, F.lit(False))).alias(name) for name, rule in rules.items()])
    return counted.unpivot([], list(rules), "check", "violations")


def methodology(request: Request) -> str:
    """How the routes of a request are scored, in words."""
    w = request.resolved()
    return (
        f"final score = {w.risk:g} x risk utility + {w.cost:g} x cost utility + {w.duration:g} x duration utility - 20 x (weighted share that isn't certain), "
        f"from 0 to 100; utilities fall evenly over risk {BOUNDS['risk']}, USD a vehicle {BOUNDS['cost']} and days {BOUNDS['duration']}; what is unknown has utility 0."
    )


OBSERVED = (
    "CASE n % 6 WHEN 0 THEN 'observed' WHEN 1 THEN 'quoted' WHEN 2 THEN 'estimated' END AS obs_status", "cost * 10 AS obs_amount", "'USD' AS obs_currency", "n % 3 AS obs_quantity",
    "CASE WHEN n % 2 = 0 THEN 'vehicle' END AS obs_cargo", "expires_at AS obs_until", "CASE n % 4 WHEN 0 THEN 'observed' END AS days_status", "time_days AS days_p50", "time_days + 1 AS days_p90", "CASE WHEN n % 2 = 0 THEN time_days END AS known_days",
)
ASKED = Request(frozenset({3, 13}), frozenset({8, 11}), cargo=Cargo(2, shipment="roro", kg=3200.0), constraints=Constraints(avoided_zones=("Z7",), max_days=90.0))


def asked(t: Net, request: Request = ASKED) -> dict[str, DataFrame | bool]:
    return recommend_routes(located(t).selectExpr("*", *OBSERVED), request, F.expr(NOW))


@operator()
def recommend(t: Net) -> DataFrame:
    """The five best routes from two origins to two destinations; tests check the parts against brute force."""
    shown = decorated(asked(t)["routes"]).withColumn("tags", F.array_join("tags", ","))
    return shown.select("place", "route_id", "hops", "risk", "cost", "days", "score", "completeness", "tags", "cost_to_next")


@operator()
def rejected_routes(t: Net) -> DataFrame:
    tight = Request(ASKED.origins, ASKED.destinations, "min_cost", cargo=ASKED.cargo, constraints=Constraints(require_known_risk=True, max_risk=45.0, max_days=20.0), auto_reroute=False)
    return asked(t, tight)["rejected"].select("route_id", F.array_join("reasons", ",").alias("reasons"))


@operator()
def snapshot_persist(t: Net) -> DataFrame:
    snapshots, inclusions = snapshot(ASKED, asked(t), F.expr("timestamp '2001-06-01 00:00:00'"))
    return snapshots.join(inclusions.select("snapshot_id", "segment_id", F.array_join("route_ids", ",").alias("included")), "snapshot_id").select("snapshot_id", "segment_id", "included", F.size("route_ids").alias("routes"))


@operator("SELECT check_name AS \"check\", CAST(0 AS BIGINT) AS violations FROM (VALUES ('score_out_of_range'), ('completeness_out_of_range'), ('p90_below_p50'), ('cost_negative'), ('risk_out_of_range'), ('rejected_but_returned'), ('legs_differ_from_hops')) v(check_name)")
def recommendation_quality(t: Net) -> DataFrame:
    return quality(asked(t)["routes"])


