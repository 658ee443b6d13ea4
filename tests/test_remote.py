"""Network sources with clients that answer from memory."""

import json
import random

import pytest

from tideway.functions import geo
from tideway.plans import recommend
from tideway.sources import remote


nowait = lambda _: None  # noqa: E731  by value, for workers that can't import this module


def test_backoff_doubles_up_to_a_minute():
    rng = random.Random(1)
    found = [remote.backoff(k, rng=rng) for k in range(8)]
    assert all(0.85 * b <= x <= 1.15 * b for x, b in zip(found, (2, 4, 8, 16, 32, 60, 60, 60), strict=True))


@pytest.mark.parametrize(("answers", "want"), [([(200, "{}")], ("ok", "{}", 1)), ([(429, ""), (503, ""), (200, "[1]")], ("ok", "[1]", 3)), ([(404, "")], ("http 404", None, 1)), ([(200, "oops")] * 4, ("not json", None, 4)), ([OSError()] * 4, ("error OSError", None, 4))])
def test_retries(answers, want):
    left = iter(answers)

    def fetch(_):
        x = next(left)
        if isinstance(x, OSError):
            raise x
        return x

    assert remote.fetched_once({}, fetch, wait=nowait) == want


def test_news(spark):
    def fetch(request):
        if request["zone_id"] == "bad":
            return 400, ""
        return 200, json.dumps({"articles": [{"title": f"{request['query']} {k}", "url": f"http://h/{k}", "domain": "h", "seendate": "20240101T000000Z"} for k in range(min(3, request["records"]))]})

    zones = spark.createDataFrame([("a", "ships"), ("bad", "x")], "zone_id string, query string")
    rows = remote.news(zones, fetch, records=2, spacing=0.0, wait=nowait).collect()
    assert sorted((r.zone_id, r.status, r.title) for r in rows) == [("a", "ok", "ships 0"), ("a", "ok", "ships 1"), ("bad", "http 400", None)] or sorted((r.zone_id, r.title or "") for r in rows) == [("a", "ships 0"), ("a", "ships 1"), ("bad", "")]
    assert all(len(r.article_id) == 24 for r in rows if r.title)


def test_weather_in_batches(spark):
    def fetch(request):
        n = len(request["points"])
        if n > 25:
            return 400, ""
        return 200, json.dumps([{"hourly": {"time": ["2024-01-01T00:00", "2024-01-01T01:00"], "wind_speed_10m": [p["point_id"], None], "wind_gusts_10m": [1.5, 2.5]}} for p in request["points"]])

    points = spark.range(60).selectExpr("id AS point_id", "1.0D AS lat", "2.0D AS lng")
    rows = remote.weather(points, fetch, wait=nowait).collect()
    assert len(rows) == 120 and {r.status for r in rows} == {"ok"} and {(r.point_id, r.wind) for r in rows if r.hour.hour == 0} == {(k, float(k)) for k in range(60)}
    failed = remote.weather(points.limit(3), lambda r: (404, ""), wait=nowait).collect()
    assert [(r.status, r.hour) for r in failed] == [("http 404", None)] * 3


def test_bridge_keeps_messages_over_broken_connections():
    written, calls = [], []

    def connect():
        calls.append(1)
        yield from ([f'{{"m": {len(calls)}}}'] * 3)
        if len(calls) < 3:
            raise ConnectionError

    counts = remote.bridge(connect, written.extend, flush=2, wait=nowait)
    assert len(written) == 9 and counts == {"messages": 9, "writes": 6, "connections": 3}

    def refused():
        yield '{"m": 1}'
        yield '{"error": "key"}'

    kept = []
    with pytest.raises(remote.ProviderRefused):
        remote.bridge(refused, kept.extend, wait=nowait)
    assert kept == ['{"m": 1}']

    def down():
        raise ConnectionError
        yield

    with pytest.raises(ConnectionError):
        remote.bridge(down, kept.extend, attempts=3, wait=nowait)


def test_lines_are_simplified():
    line = [(0.0, 0.0), (1.0, 0.001), (2.0, 0.0), (3.0, 1.0), (4.0, 0.0)]
    assert geo.simplified(line) == [(0.0, 0.0), (2.0, 0.0), (3.0, 1.0), (4.0, 0.0)] and geo.simplified(line[:2]) == line[:2]
    ring = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 0.0)]
    assert geo.simplified(ring) == ring and len(geo.simplified([(k / 1000, 0.0) for k in range(50_000)])) == 2


def test_methodology_names_the_weights():
    assert "0.4 x risk" in recommend.methodology(recommend.ASKED)
