"""Paths and recommendations against brute force on small graphs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideway.operators import graph
from tideway.plans import recommend


def brute(edges, weight, search):
    """All simple paths that end at their first destination: (sum, hops, signature) in order."""
    found = []

    def walk(at, visited, path):
        if at in search.destinations:
            found.append((round(sum(e[weight] for e in path), 9), len(path), "|".join(e["segment_id"] for e in path)))
        elif len(path) < search.hops:
            for e in edges:
                if e["from_id"] == at and e["to_id"] not in visited:
                    walk(e["to_id"], visited | {e["to_id"]}, [*path, e])

    for o in search.origins - search.destinations:
        walk(o, {o}, [])
    return sorted(found)


def made(pairs, rng):
    weight = lambda: float(rng.integers(0, 4)) / 2  # noqa: E731  many ties, some of no length
    return [{"segment_id": f"S{a}-{b}-{k}", "from_id": a, "to_id": b, "w_cost": weight(), "w_risk": weight(), "w_time": float(rng.random()), "w_balanced": weight()} for k, (a, b) in enumerate(pairs)]


PAIRS = [(a, (a + s) % 14) for a in range(14) for s in (1, 1, 3)]


@pytest.mark.parametrize(("hops", "origins", "goals"), [(3, {1}, {8}), (5, {1, 2, 8}, {8, 10}), (12, {1}, {8, 5})])
def test_best_paths_against_brute_force(spark, hops, origins, goals):
    edges = made(PAIRS, np.random.default_rng(hops))
    df = spark.createDataFrame(edges)
    for k in (1, 7, 10_000):
        search = graph.Search(frozenset(origins), frozenset(goals), k, hops)
        rows = graph.best_paths(df, search, list(graph.OBJECTIVES)).collect()
        for name, weight in graph.OBJECTIVES.items():
            want = brute(edges, weight, search)[:k]
            mine = sorted((r.place, r.hops, r.signature) for r in rows if r.objective == name)
            assert [(n, s) for _, n, s in mine] == [(n, s) for _, n, s in want] and [p for p, _, _ in mine] == list(range(1, len(mine) + 1))


def test_a_budget_ends_a_search():
    edges = [(a, b, 1.0) for a in range(9) for b in range(9) if a != b]
    few = graph.found_paths(edges, graph.Search(frozenset({0}), frozenset({8}), 10_000, 8, budget=50))
    assert 0 < len(few) < 100 and len(graph.found_paths(edges, graph.Search(frozenset({0}), frozenset({8}), 10_000, 8))) > 10_000


def test_pool_has_each_path_once_in_the_order_of_objectives(spark):
    df = spark.createDataFrame(made(PAIRS, np.random.default_rng(4)))
    search = graph.Search(frozenset({1}), frozenset({8}), 6, 12)
    order = ["fastest", "min_cost", "min_risk"]
    each = {(r.objective, r.place): r.signature for r in graph.best_paths(df, search, order).collect()}
    want = list(dict.fromkeys(each[o, p] for o in order for p in range(1, 7)))
    for most in (120, 7):
        found = graph.candidates(df, search, order, most).collect()
        assert [r.signature for r in sorted(found, key=lambda r: (order.index(r.objective), r.place))] == want[:most]


def test_shortest_paths_against_brute_force(spark):
    edges = made(PAIRS, np.random.default_rng(2))
    for e in edges:
        e["w_cost"] += 0.25  # paths of no length have ties that only differ in the way
    df = spark.createDataFrame(edges)
    for hops in (2, 12):
        found = {(r.origin, r.node): (round(r.length, 9), r.hops) for r in graph.shortest_paths(df, [1, 3], "w_cost", hops).collect() if r.hops}
        want = {}
        for o in (1, 3):
            for n in range(14):
                if n != o and (paths := brute(edges, "w_cost", graph.Search(frozenset({o}), frozenset({n}), 1, hops))):
                    want[o, n] = paths[0][:2]
        assert found == want


def chain(spark, length, risk=0.5):
    nodes = [1, *range(20, 19 + length), 8]
    rows = [(f"S{a}-{b}-0", a, b, "sea", 0.01, 2.0, risk, 1.0, 100.0, 7, "P1", None, "provider", None) for a, b in zip(nodes, nodes[1:], strict=False)]
    schema = "segment_id string, from_id int, to_id int, mode string, cost double, time_days double, risk double, completeness double, km double, n long, provider string, feasibility string, data_status string, zone_ids string"
    return spark.createDataFrame(rows, schema)


OBSERVED = ("CAST(NULL AS STRING) AS obs_status", "1D AS obs_amount", "'USD' AS obs_currency", "1 AS obs_quantity", "CAST(NULL AS STRING) AS obs_cargo", "DATE '2030-01-01' AS obs_until", "CAST(NULL AS STRING) AS days_status", "1D AS days_p50", "1D AS days_p90", "2D AS known_days")


@pytest.mark.parametrize(("length", "hops", "found"), [(12, 12, 1), (13, 12, 0), (13, 13, 1)])
def test_hop_limits_hold(spark, length, hops, found):
    request = recommend.Request(frozenset({1}), frozenset({8}), constraints=recommend.Constraints(max_hops=hops))
    rows = recommend.recommend_routes(chain(spark, length).selectExpr("*", *OBSERVED), request, F.expr("DATE '2001-06-01'"))["routes"].collect()
    assert [r.hops for r in rows] == [length] * found


def test_route_sums_and_score(spark):
    request = recommend.Request(frozenset({1}), frozenset({8}), "custom", recommend.Weights(0.4, 0.3, 0.3), recommend.Cargo(2))
    row = recommend.recommend_routes(chain(spark, 2).selectExpr("*", *OBSERVED), request, F.expr("DATE '2001-06-01'"))["routes"].first()
    leg = round((100 * 0.11 * 2) * 1.16 + 420, 2)  # movement and fuel, and one unit of handling
    assert (row.hops, row.risk, row.cost, row.days, row.days_p90) == (2, 50.0, round(2 * leg, 2), 4.0, 6.0)
    utility = 0.4 * 50 + 0.3 * (100 - leg / 500) + 0.3 * (100 - 4 / 1.2)
    assert row.score == pytest.approx(utility - 20 * (0.3 * 0.65 + 0.3 * 0.65), abs=1e-3) and row.completeness == pytest.approx(0.4 + 0.6 * 0.35, abs=1e-4)


def test_reroute_and_fallback(spark):
    risky, safe = chain(spark, 2, 0.9), chain(spark, 3, 0.1).withColumns({"segment_id": F.concat("segment_id", F.lit("s")), "from_id": F.when(F.col("from_id") > 19, F.col("from_id") + 100).otherwise(F.col("from_id")), "to_id": F.when(F.col("to_id") > 19, F.col("to_id") + 100).otherwise(F.col("to_id"))})
    ask = lambda rows, **more: recommend.recommend_routes(rows.selectExpr("*", *OBSERVED), recommend.Request(frozenset({1}), frozenset({8}), "min_cost", **more), F.expr("DATE '2001-06-01'"))
    both = ask(risky.union(safe))
    assert both["rerouted"] and not both["fallback"] and [r.hops for r in both["routes"].collect()] == [3]
    alone = ask(risky)
    assert alone["fallback"] and not alone["rerouted"] and [r.hops for r in alone["routes"].collect()] == [2]
    assert not ask(risky.union(safe), auto_reroute=False)["rerouted"]
    limited = ask(risky, constraints=recommend.Constraints(max_risk=50.0))
    assert limited["routes"].count() == 0 and [r.reasons for r in limited["rejected"].collect()] == [["risk_over_limit"]]
    snapshots, inclusions = recommend.snapshot(recommend.ASKED, both, F.expr("timestamp '2024-01-01 00:00:00'"))
    assert inclusions.count() == 3 and recommend.newest_with_route(snapshots, both["routes"].first().route_id).count() == 1 and recommend.newest_with_route(snapshots, "x").count() == 0
    assert all(r.violations == 0 for r in recommend.quality(both["routes"]).collect())
