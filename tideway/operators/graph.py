"""Graph operators: weights, shortest and k shortest paths, components, closure, rerouting, generation (section H)."""

from __future__ import annotations

import heapq
import math
from collections import defaultdict
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideway.functions.geo import haversine_sql
from tideway.operators.aggregates import rounded
from tideway.operators.filters import checkpointed, items, released
from tideway.operators.joins import REGIONAL, mode_feasibility, named, regional
from tideway.sources.tables import Net, operator

OBJECTIVES = {"min_cost": "w_cost", "min_risk": "w_risk", "fastest": "w_time", "balanced": "w_balanced"}
#: Fixed value: what one more hop of missing knowledge adds to a risk, and the weight of an unknown cost or time.
GAP, UNKNOWN, FLOOR = 0.25, 1.0e9, 1.0e-6


def risk_value(risk: Column, completeness: Column) -> Column:
    """The risk that an optimiser sees: unknown is 1, gaps in the data add up to a quarter, 1 at most."""
    whole = F.least(F.greatest(F.coalesce(completeness, F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    return F.when(risk.isNull(), 1.0).otherwise(F.round(F.least(F.greatest(risk, F.lit(0.0)) + (1 - whole) * GAP, F.lit(1.0)), 6))


def weighted(segments: DataFrame, risk_weight: float = 0.5, dear: float = 500.0) -> DataFrame:
    """``segments`` with the weights of the four objectives; a cost of ``dear`` or more weighs 1 in the balanced one, which
    is never floored and may be 0."""
    floor = lambda c: F.coalesce(F.greatest(F.col(c), F.lit(FLOOR)), F.lit(UNKNOWN))
    out = segments.withColumns({"w_risk": risk_value(F.col("risk"), F.col("completeness")), "w_cost": F.when(F.col("cost").isNull(), UNKNOWN).otherwise(floor("cost"))})
    out = out.withColumn("w_time", F.when(F.col("time_days").isNull(), UNKNOWN).otherwise(floor("time_days")))
    share = F.when(F.col("cost").isNull(), 1.0).otherwise(F.least(F.col("cost") / dear, F.lit(1.0)))
    return out.withColumn("w_balanced", risk_weight * F.col("w_risk") + (1 - risk_weight) * share)


def shortest_paths(edges: DataFrame, origins: list[int], weight: str, hops: int = 12) -> DataFrame:
    """(origin, node, length, hops, signature): the shortest path of up to ``hops`` edges from each origin to each node.

    The frontier is relaxed once for each hop: all edges out of it in one join, then the best path of each node.  Rounds
    end when nothing improves, and each one is checkpointed.  Of equal lengths the path with fewer hops wins, then that
    with the smaller signature.
    """
    spark = edges.sparkSession
    out = checkpointed(edges.select("from_id", "to_id", "segment_id", F.col(weight).cast("double").alias("w")))
    start = spark.createDataFrame([(o, o, 0.0, 0, "") for o in origins], "origin int, node int, length double, hops int, signature string")
    best = frontier = checkpointed(start)
    pick = lambda rows: rows.groupBy("origin", "node").agg(F.min(F.struct("length", "hops", "signature")).alias("m")).select("origin", "node", "m.*")
    for _ in range(hops):
        path = F.when(F.col("signature") == "", F.col("segment_id")).otherwise(F.concat("signature", F.lit("|"), "segment_id"))
        step = frontier.join(out, frontier.node == out.from_id).select("origin", F.col("to_id").alias("node"), (F.col("length") + F.col("w")).alias("length"), (F.col("hops") + 1).alias("hops"), path.alias("signature"))
        merged = checkpointed(pick(best.union(step)))
        frontier = checkpointed(merged.join(best, ["origin", "node", "signature"], "left_anti"))
        best = merged
        if frontier.isEmpty():
            break
    return best


@dataclass(frozen=True)
class Search:
    """A search for the best simple paths from any origin to any destination."""

    origins: frozenset[int]
    destinations: frozenset[int]
    k: int = 30
    hops: int = 12
    #: Partial paths that one objective may extend; None searches without an end.
    budget: int | None = None


def found_paths(edges: list[tuple], search: Search) -> list[tuple[float, list[int]]]:
    """(length, edge numbers) of the k shortest simple paths of edges (from, to, weight), and of all that are as long as
    the k-th.  Partial paths are extended in the order of a lower bound: their length and the least length from their end
    to a destination in the hops that are left.  A path ends at the first destination that it meets."""
    out = defaultdict(list)
    for i, (a, b, w) in enumerate(edges):
        out[a].append((i, b, w))
    goals, hops = search.destinations, search.hops
    rest = [dict.fromkeys(goals, 0.0)]
    for _ in range(hops):
        best = dict(rest[-1])
        for a, b, w in edges:
            if a not in goals and b in rest[-1]:
                best[a] = min(best.get(a, math.inf), w + rest[-1][b])
        rest.append(best)
    queue = [(rest[hops].get(o, math.inf), k, 0.0, o, (o,), ()) for k, o in enumerate(sorted(search.origins - goals))]
    heapq.heapify(queue)
    found, made, most = [], len(queue), math.inf
    while queue and queue[0][0] <= most and (search.budget is None or made <= search.budget):
        _, _, length, at, visited, path = heapq.heappop(queue)
        if at in goals:
            found.append((length, list(path)))
            if len(found) == search.k:  # sums in another order differ by a rounding error
                most = max(x for x, _ in found) * (1 + 1e-9) + 1e-8
            continue
        left = rest[hops - len(path) - 1] if len(path) < hops else {}
        for i, b, w in out[at]:
            if b in left and b not in visited and length + w + left[b] <= most:
                made += 1
                heapq.heappush(queue, (length + w + left[b], made, length + w, b, (*visited, b), (*path, i)))
    return found


def best_paths(edges: DataFrame, search: Search, objectives: list[str]) -> DataFrame:
    """(objective, place, signature, hops) of the k best simple paths of each objective, one task each.

    Places are by the objective's sum to 9 digits, then hops, then signature.  The network is one task's input: it has an
    edge for each pair of places and mode, however many observations it was made from.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        name = pdf["objective"].iloc[0]
        pdf = pdf.sort_values("segment_id", ignore_index=True)
        ids = pdf["segment_id"].tolist()
        graph = list(zip(pdf["from_id"], pdf["to_id"], pdf[OBJECTIVES[name]].tolist(), strict=True))
        rows = sorted((round(length, 9), len(path), "|".join(ids[i] for i in path)) for length, path in found_paths(graph, search))
        return pd.DataFrame([(name, n, r[2], r[1]) for n, r in enumerate(rows[: search.k], 1)], columns=["objective", "place", "signature", "hops"])

    each = edges.select("segment_id", "from_id", "to_id", *OBJECTIVES.values(), F.explode(F.array(*map(F.lit, objectives))).alias("objective"))
    return each.groupBy("objective").applyInPandas(run, "objective string, place int, signature string, hops int")


def route_id(signature: Column) -> Column:
    return F.concat(F.lit("route-"), F.substring(F.sha2(signature, 256), 1, 20))


def candidates(edges: DataFrame, search: Search, objectives: list[str], most: int = 120) -> DataFrame:
    """(signature, hops, objective, place): the pool of all objectives, each path once, under the first objective in the
    given order that has it; ``most`` of them in that order, as a pool is defined."""
    paths = best_paths(edges, search, objectives)
    order = F.array_position(F.array(*map(F.lit, objectives)), F.col("objective")).cast("int")
    first = paths.groupBy("signature", "hops").agg(F.min(F.struct(order.alias("o"), "place", "objective")).alias("m"))
    return first.orderBy("m.o", "m.place").limit(most).select("signature", "hops", "m.objective", "m.place")


def legs(paths: DataFrame, segments: DataFrame) -> DataFrame:
    """A row for each leg of each path (signature), numbered from 0, with the segment's columns."""
    split = paths.select("signature", F.posexplode(F.split("signature", r"\|")).alias("leg", "segment_id"))
    return split.join(segments, "segment_id")


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest label reachable.  Labels spread along edges and jump to their label's label, so
    rounds grow with the logarithm of the diameter; each round is checkpointed to keep lineage short, and the one before it
    deleted."""
    both = checkpointed(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = checkpointed(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")))
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("near"))
        spread = labels.join(near, labels.node == near.a).select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = spread.select(F.col("node").alias("label"), F.col("label").alias("far"))
        new = checkpointed(spread.join(jump, "label").select("node", "old", F.least("label", "far").alias("label")))
        released(labels)
        labels = new.select("node", "label")
        if new.filter("label <> old").isEmpty():
            return labels.withColumnRenamed("label", "component")


def closure(edges: DataFrame, start: DataFrame) -> DataFrame:
    """All nodes that edges (a, b) reach from ``start`` (node), itself included; only new nodes go on in each round."""
    found = frontier = checkpointed(start.select("node").distinct())
    while not frontier.isEmpty():
        step = edges.join(frontier, edges.a == frontier.node).select(F.col("b").alias("node")).distinct()
        frontier = checkpointed(step.join(found, "node", "left_anti"))
        found = found.union(frontier)
    return found


def rerouted(edges: DataFrame, search: Search, bad: DataFrame) -> DataFrame:
    """(signature, hops, decision): if the best path has a segment of ``bad``, the best paths without any of them, or the
    first ones anyway if there are none; else the best paths."""
    base = checkpointed(best_paths(edges, search, ["min_cost"]))
    hit = not legs(base.filter("place = 1"), bad.select("segment_id")).isEmpty()
    if not hit:
        return base.select("signature", "hops", F.lit("baseline").alias("decision"))
    safe = checkpointed(best_paths(edges.join(bad.select("segment_id"), "segment_id", "left_anti"), search, ["min_cost"]))
    if safe.isEmpty():
        return base.select("signature", "hops", F.lit("fallback").alias("decision"))
    return safe.select("signature", "hops", F.lit("rerouted").alias("decision"))


EDGES = "(SELECT segment_id, from_id, to_id, w_cost FROM weighted_edges)"


def relaxed_sql(origins: str, rounds: int) -> str:
    """The other engine's text of as many rounds of relaxation."""
    text = f"WITH d0 AS (SELECT CAST(o AS INT) AS origin, CAST(o AS INT) AS node, 0.0e0 AS length, 0 AS hops, '' AS signature FROM unnest({origins}) u(o))"
    for k in range(1, rounds + 1):
        text += f""", d{k} AS MATERIALIZED (SELECT origin, node, length, hops, signature FROM (SELECT *, row_number() OVER (PARTITION BY origin, node ORDER BY length, hops, signature) AS r FROM (
  SELECT * FROM d{k - 1} UNION SELECT d.origin, e.to_id, d.length + e.w_cost, d.hops + 1, CASE WHEN d.signature = '' THEN e.segment_id ELSE concat(d.signature, '|', e.segment_id) END FROM d{k - 1} d JOIN {EDGES} e ON d.node = e.from_id) x) y WHERE r = 1)"""
    return text


@operator("SELECT segment_id, w_risk, w_cost, w_time, 0.5e0 * w_risk + 0.5e0 * least(w_cost / 500, 1.0e0) AS w_balanced FROM weighted_edges")
def edge_weights(t: Net) -> DataFrame:
    return weighted(t.gated).select("segment_id", "w_risk", "w_cost", "w_time", "w_balanced")


@operator("""SELECT segment_id, CASE WHEN risk IS NULL THEN 1.0e0 ELSE round(least(1.0e0, greatest(risk, 0.0e0) + 0.25e0 - 0.25e0 * coalesce(completeness, 0)), 6) END AS w_risk
FROM (SELECT segment_id, risk, CASE WHEN n % 4 <> 0 THEN completeness END AS completeness FROM segments) x""")
def risk_opt_value(t: Net) -> DataFrame:
    rows = t.segments.withColumn("completeness", F.when(F.col("n") % 4 != 0, F.col("completeness")))
    return rows.select("segment_id", risk_value(F.col("risk"), F.col("completeness")).alias("w_risk"))


@operator(relaxed_sql("[3, 13]", 12) + " SELECT origin, node, hops, round(length, 6) AS length, signature FROM d12 WHERE hops > 0")
def shortest_path(t: Net) -> DataFrame:
    """The cheapest paths from two origins to every place."""
    found = shortest_paths(weighted(t.gated), [3, 13], "w_cost").filter("hops > 0")
    return found.select("origin", "node", "hops", F.round("length", 6).alias("length"), "signature")


SEARCH = Search(frozenset({3, 13}), frozenset({8, 11}))


@operator()
def k_shortest_paths(t: Net) -> DataFrame:
    """Paths of 12 hops are too many for recursive SQL; tests compare the search with brute force on small graphs."""
    paths = best_paths(weighted(t.gated), SEARCH, list(OBJECTIVES))
    return paths.select("objective", "place", route_id(F.col("signature")).alias("route_id"), "hops")


@operator()
def candidate_pool(t: Net) -> DataFrame:
    pool = candidates(weighted(t.gated), SEARCH, ["balanced", "min_risk", "min_cost", "fastest"])
    return pool.select(route_id(F.col("signature")).alias("route_id"), "hops", "objective", "place")


@operator()
def dynamic_reroute(t: Net) -> DataFrame:
    edges = weighted(t.gated)
    return rerouted(edges, SEARCH, edges.filter("risk >= 0.45"))


@operator()
def legacy_reroute(t: Net) -> DataFrame:
    """As the dynamic one, but by the news score of the zones that a segment passes."""
    loud = t.news.filter("title like '%attack%' or title like '%tsunami%'").select("zone_id").distinct()
    passes = t.segments.select("segment_id", "mode", F.explode(items("zone_ids")).alias("zone_id")).filter("mode = 'air'")
    return rerouted(weighted(t.gated), SEARCH, passes.join(loud, "zone_id", "left_semi").select("segment_id").distinct())


@operator("""SELECT concat(a.segment_id, '|', b.segment_id) AS signature, concat('route-', substr(sha256(concat(a.segment_id, '|', b.segment_id)), 1, 20)) AS route_id
FROM weighted_edges a JOIN weighted_edges b ON a.to_id = b.from_id WHERE a.from_id = 3 AND b.to_id = 8""")
def route_signature(t: Net) -> DataFrame:
    """Signature and stable id of the paths of two legs between two places."""
    one = t.gated.select("segment_id", "from_id", "to_id")
    first, second = one.filter("from_id = 3").select(F.col("segment_id").alias("x"), "to_id"), one.filter("to_id = 8").select(F.col("segment_id").alias("y"), F.col("from_id").alias("to_id"))
    return first.join(second, "to_id").select(F.concat_ws("|", "x", "y").alias("signature")).withColumn("route_id", route_id(F.col("signature")))


@operator(f"""WITH RECURSIVE pairs AS (SELECT DISTINCT from_id AS a, to_id AS b FROM {REGIONAL} x UNION SELECT DISTINCT to_id, from_id FROM {REGIONAL} x),
reach AS (SELECT a, a AS b FROM pairs UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON r.b = p.a)
SELECT component, CAST(count(*) AS BIGINT) AS size FROM (SELECT a, min(b) AS component FROM reach GROUP BY a) x GROUP BY component
UNION ALL SELECT l.location_id, CAST(1 AS BIGINT) FROM locations l WHERE l.location_id NOT IN (SELECT a FROM pairs)""")
def component_sizes(t: Net) -> DataFrame:
    """Sizes of the weakly connected components of the regional sea network; places outside it are alone."""
    found = components(regional(t).select(F.col("from_id").alias("a"), F.col("to_id").alias("b")))
    every = t.locations.join(found, F.col("location_id") == F.col("node"), "left").select(F.coalesce("component", "location_id").alias("component"))
    return every.groupBy("component").agg(F.count("*").alias("size"))


@operator("""WITH RECURSIVE e AS (SELECT DISTINCT from_id AS a, to_id AS b FROM segments WHERE mode = 'sea' AND provider IS NULL),
r AS (SELECT b AS node FROM e WHERE a = 3 AND b > 4 UNION SELECT e.b FROM r JOIN e ON r.node = e.a WHERE e.b > 4) SELECT DISTINCT node FROM r""")
def blocked_closure(t: Net) -> DataFrame:
    """Candidates (locations over 4) that a protected location reaches through other candidates, by sea segments without a provider."""
    edges = t.segments.filter("mode = 'sea' and provider is null and to_id > 4").select(F.col("from_id").alias("a"), F.col("to_id").alias("b")).distinct()
    return closure(edges, edges.filter("a = 3").select(F.col("b").alias("node")))


@operator("""SELECT r.route_id, string_agg(concat(r.segment_id, ':', a.name, '>', b.name), ';' ORDER BY r.sequence) AS legs, CAST(count(*) AS BIGINT) AS n
FROM route_segments r JOIN locations a ON r.from_id = a.location_id JOIN locations b ON r.to_id = b.location_id GROUP BY r.route_id""")
def route_detail(t: Net) -> DataFrame:
    rows = t.route_segments.join(named(t, "from", "name"), "from_id").join(named(t, "to", "name"), "to_id")
    leg = F.concat("segment_id", F.lit(":"), "from_name", F.lit(">"), "to_name")
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("sequence", leg.alias("leg")))), lambda x: x["leg"])
    return rows.groupBy("route_id").agg(F.array_join(ordered, ";").alias("legs"), F.count("*").alias("n"))


@operator("""SELECT r.route_id, to_json(struct_pack(id := r.route_id, legs := list(struct_pack(id := r.segment_id, mode := r.mode, "from" := a.name, "to" := b.name, risk := r.risk) ORDER BY r.sequence),
  legCount := count(*), modes := list_sort(list_distinct(list(r.mode))), riskStatus := CASE WHEN count(r.risk) = count(*) THEN 'available' WHEN count(r.risk) > 0 THEN 'partial' ELSE 'unavailable' END)) AS document
FROM (SELECT route_id, segment_id, from_id, to_id, mode, sequence, CASE WHEN risk > 0.5e0 THEN 'high' WHEN risk IS NOT NULL THEN 'low' END AS risk FROM route_segments) r
JOIN locations a ON r.from_id = a.location_id JOIN locations b ON r.to_id = b.location_id GROUP BY r.route_id""")
def route_document(t: Net) -> DataFrame:
    """A route as one JSON document with its legs in order; unknown values are there as null."""
    rows = t.route_segments.join(named(t, "from", "name"), "from_id").join(named(t, "to", "name"), "to_id")
    risk = F.when(F.col("risk") > 0.5, "high").when(F.col("risk").isNotNull(), "low").alias("risk")
    leg = F.struct(F.col("segment_id").alias("id"), "mode", F.col("from_name").alias("from"), F.col("to_name").alias("to"), risk)
    status = F.when(F.count("risk") == F.count("*"), "available").when(F.count("risk") > 0, "partial").otherwise("unavailable")
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("sequence", leg.alias("leg")))), lambda x: x["leg"])
    whole = rows.groupBy("route_id").agg(ordered.alias("legs"), F.count("*").alias("legCount"), F.sort_array(F.collect_set("mode")).alias("modes"), status.alias("riskStatus"))
    document = F.to_json(F.struct(F.col("route_id").alias("id"), "legs", "legCount", "modes", "riskStatus"), {"ignoreNullFields": "false"})
    return whole.select("route_id", document.alias("document"))


#: Fixed values by mode: rate per km, and the detour factor of the great circle.
RATES = {"road": (1.20, 1.22), "rail": (0.55, 1.18), "sea": (0.11, 1.12), "air": (3.80, 1.04)}


@operator(f"""WITH p AS (SELECT DISTINCT a.location_id AS origin, b.location_id AS destination, a.kind AS ka, b.kind AS kb, a.region = b.region AS same, {haversine_sql('a', 'b')} AS km
  FROM segments s JOIN locations a ON s.from_id = a.location_id JOIN locations b ON s.to_id = b.location_id),
m AS (SELECT origin, destination, 'sea' AS mode, 0.11e0 * km * 1.12e0 AS cost FROM p WHERE ka = 'Port' AND kb = 'Port' UNION ALL SELECT origin, destination, 'air', 3.80e0 * km * 1.04e0 FROM p WHERE ka = 'Airport' AND kb = 'Airport'
  UNION ALL SELECT origin, destination, 'rail', 0.55e0 * km * 1.18e0 FROM p WHERE same AND km * 1.18e0 <= 12000 UNION ALL SELECT origin, destination, 'road', 1.20e0 * km * 1.22e0 FROM p WHERE same AND km <= 5000)
SELECT origin, destination, mode, round(cost + 1e-10, 4) AS cost, CAST(row_number() OVER (PARTITION BY origin, destination ORDER BY cost, mode) AS BIGINT) AS place FROM m""")
def generate_routes(t: Net) -> DataFrame:
    """One route of a single leg for each feasible mode of a pair of places, costed and ranked."""
    from pyspark.sql import Window

    from tideway.functions.geo import ends, haversine, pairs

    rows = mode_feasibility(t).filter("status = 'feasible'").join(pairs(t).withColumn("km", haversine(*ends())), ["a", "b"])
    per_km = F.create_map(*[F.lit(x) for m, (r, d) in RATES.items() for x in (m, r * d)])
    rows = rows.withColumn("cost", F.col("km") * F.element_at(per_km, F.col("mode")))
    place = F.row_number().over(Window.partitionBy("a", "b").orderBy("cost", "mode")).cast("long")
    return rows.select(F.col("a").alias("origin"), F.col("b").alias("destination"), "mode", rounded(F.col("cost"), 4).alias("cost"), place.alias("place"))


@operator("""SELECT s.segment_id, z.zone_id, z.how, 0.2e0 AS confidence FROM segments s JOIN locations a ON s.from_id = a.location_id JOIN locations b ON s.to_id = b.location_id
JOIN (SELECT 'suez' AS zone_id, 'crossing' AS how, 'ASIA' AS x, 'EUROPE' AS y, 'sea' AS m UNION ALL SELECT 'panama', 'crossing', 'AMERICA', 'ASIA', 'sea' UNION ALL SELECT 'cape', 'crossing', 'AFRICA', 'ASIA', 'sea') z
  ON s.mode = z.m AND ((a.region = z.x AND b.region = z.y) OR (a.region = z.y AND b.region = z.x))
UNION SELECT s.segment_id, 'hormuz', 'alias', 0.2e0 FROM segments s JOIN locations a ON s.from_id = a.location_id JOIN locations b ON s.to_id = b.location_id
WHERE strpos(lower(concat(a.name, ' ', b.name)), 'nation_13') > 0 OR strpos(lower(concat(a.name, ' ', b.name)), 'nation_2 ') > 0""")
def inferred_exposure(t: Net) -> DataFrame:
    """Zones that a segment is taken to pass: by the groups of countries it joins, or by names in its text."""
    crossings = [("suez", "ASIA", "EUROPE"), ("panama", "AMERICA", "ASIA"), ("cape", "AFRICA", "ASIA")]
    both_ways = [(z, x, y) for z, a, b in crossings for x, y in ((a, b), (b, a))]
    rules = t.spark.createDataFrame([(*r, "sea") for r in both_ways], "zone_id string, from_region string, to_region string, mode string")
    rows = t.segments.select("segment_id", "mode", "from_id", "to_id").join(named(t, "from", "region", "name"), "from_id").join(named(t, "to", "region", "name"), "to_id")
    crossing = rows.join(F.broadcast(rules), ["from_region", "to_region", "mode"]).select("segment_id", "zone_id", F.lit("crossing").alias("how"))
    text = F.lower(F.concat_ws(" ", "from_name", "to_name"))
    names = F.array(F.lit("nation_13"), F.lit("nation_2 "))
    by_name = rows.filter(F.exists(names, lambda x: text.contains(x))).select("segment_id", F.lit("hormuz").alias("zone_id"), F.lit("alias").alias("how"))
    return crossing.union(by_name).distinct().withColumn("confidence", F.lit(0.2))


@operator("""SELECT 'node' AS kind, region AS label, CAST(count(*) AS BIGINT) AS n FROM locations GROUP BY region
UNION ALL SELECT 'edge', mode, CAST(count(*) AS BIGINT) FROM segments GROUP BY mode""")
def graph_summary(t: Net) -> DataFrame:
    count = lambda rows, kind, c: rows.groupBy(F.lit(kind).alias("kind"), F.col(c).alias("label")).agg(F.count("*").alias("n"))
    return count(t.locations, "node", "region").unionByName(count(t.segments, "edge", "mode"))
