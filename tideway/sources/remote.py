"""Sources behind a network: requests as rows, answers as rows, and a stream of messages bridged into files.

How a request is sent is a function that the caller gives (``fetch``, ``connect``), so that nothing here depends on a
client library and tests need no network.
"""

from __future__ import annotations

import json
import random
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideway.operators.aggregates import ranked

#: (status, text) of a request's answer.
Fetch = Callable[[dict], tuple[int, str]]
ANSWERS = "request string, status string, answer string, attempts int"
#: Records of a news query at most, points in a weather request, retries.
NEWS_RECORDS, WEATHER_POINTS, RETRIES = 250, 25, 3


def backoff(attempt: int, first: float = 2.0, most: float = 60.0, jitter: float = 0.15, rng: random.Random | None = None) -> float:
    """Seconds to wait before a further attempt (from 0): doubling up to ``most``, off by up to ``jitter`` of it."""
    return min(first * 2**attempt, most) * (rng or random).uniform(1 - jitter, 1 + jitter)


def fetched_once(request: dict, fetch: Fetch, retries: int = RETRIES, wait: Callable[[float], None] = time.sleep) -> tuple[str, str | None, int]:
    """(status, answer, attempts): ok, or the last failure.  Busy servers (429, 5xx), broken connections and text that is
    no JSON are tried again; any other refusal isn't."""
    last = "failed"
    for attempt in range(retries + 1):
        if attempt:
            wait(backoff(attempt - 1))
        try:
            code, text = fetch(request)
        except OSError as e:
            last = f"error {type(e).__name__}"
            continue
        if code == 200:
            try:
                json.loads(text)
                return "ok", text, attempt + 1
            except ValueError:
                last = "not json"
        elif code == 429 or code >= 500:
            last = f"http {code}"
        else:
            return f"http {code}", None, attempt + 1
    return last, None, retries + 1


def fetched(requests: DataFrame, fetch: Fetch, spacing: float = 0.0, tasks: int = 1, retries: int = RETRIES, wait: Callable[[float], None] = time.sleep) -> DataFrame:
    """ANSWERS to ``requests`` (request: JSON text), at most one in ``spacing`` seconds from each of ``tasks`` tasks.  A
    failed request is a row with its status and doesn't stop the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent = False
        for b in batches:
            rows = []
            for text in b.column(0).to_pylist():
                if sent and spacing:
                    wait(spacing)
                sent = True
                rows.append((text, *fetched_once(json.loads(text), fetch, retries, wait)))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.string(), pa.string(), pa.int32()))], ["request", "status", "answer", "attempts"])

    return requests.select("request").repartition(tasks).mapInArrow(run, ANSWERS)


def news(zones: DataFrame, fetch: Fetch, records: int = 100, spacing: float = 6.0, **more: object) -> DataFrame:
    """Articles (zone_id, status, article_id, title, url, domain, seen_at) of a query for each zone (zone_id, query), all
    sent by one task, as a throttle needs.  A zone that fails has one row with its status."""
    limit = max(1, min(records, NEWS_RECORDS))
    requests = zones.select(F.to_json(F.struct("zone_id", "query", F.lit(limit).alias("records"))).alias("request"))
    answers = fetched(requests, fetch, spacing, 1, **more)
    article = "struct<title:string,url:string,domain:string,seendate:string>"
    rows = answers.select(F.get_json_object("request", "$.zone_id").alias("zone_id"), "status", F.explode_outer(F.from_json("answer", f"struct<articles:array<{article}>>")["articles"]).alias("a"))
    identity = F.substring(F.sha2(F.coalesce("a.url", "a.title"), 256), 1, 24)
    return rows.select("zone_id", "status", identity.alias("article_id"), "a.title", "a.url", "a.domain", F.col("a.seendate").alias("seen_at"))


def weather(points: DataFrame, fetch: Fetch, **more: object) -> DataFrame:
    """Hourly rows (point_id, status, hour, wind, gust) of points (point_id, lat, lng), WEATHER_POINTS in a request.  A
    request that fails gives its points one row each with the status."""
    batches = ranked(points.select("point_id", "lat", "lng"), ["point_id"], "place").withColumn("batch", F.floor((F.col("place") - 1) / WEATHER_POINTS))
    listed = batches.groupBy("batch").agg(F.sort_array(F.collect_list(F.struct("point_id", "lat", "lng"))).alias("points"))
    answers = fetched(listed.select(F.to_json(F.struct("points")).alias("request")), fetch, **more)
    asked = F.from_json("request", "struct<points:array<struct<point_id:long,lat:double,lng:double>>>")["points"]
    hourly = F.from_json("answer", "array<struct<hourly:struct<time:array<string>,wind_speed_10m:array<double>,wind_gusts_10m:array<double>>>>")
    each = answers.select("status", F.posexplode(asked).alias("k", "p"), hourly.alias("h")).select("status", "p.point_id", F.get("h", F.col("k"))["hourly"].alias("h"))
    rows = each.select("point_id", "status", F.explode_outer(F.arrays_zip(F.col("h.time").alias("time"), F.col("h.wind_speed_10m").alias("wind"), F.col("h.wind_gusts_10m").alias("gust"))).alias("x"))
    return rows.select("point_id", "status", F.to_timestamp("x.time", "yyyy-MM-dd'T'HH:mm").alias("hour"), "x.wind", "x.gust")


class ProviderRefused(ValueError):
    """The provider sent an error; connecting again is of no use."""


def bridge(connect: Callable[[], Iterator[str]], write: Callable[[list[str]], None], flush: int = 1000, attempts: int = 5, wait: Callable[[float], None] = time.sleep) -> dict[str, int]:
    """Carry messages of a connection into files of JSON lines (``write``), from which a stream reads them.

    A broken connection is opened again after a growing pause, up to ``attempts`` times in a row without a message; what
    has come in is written first.  An error message of the provider ends it.  Returns counters.
    """
    counts = {"messages": 0, "writes": 0, "connections": 0}
    held: list[str] = []

    def settle() -> None:
        if held:
            write(list(held))  # a failed write keeps them
            counts["writes"] += 1
            held.clear()

    failed = 0
    while True:
        counts["connections"] += 1
        try:
            for message in connect():
                failed = 0
                if message.lstrip().startswith("{") and '"error"' in message and "error" in json.loads(message):
                    settle()
                    raise ProviderRefused(message[:200])
                held.append(message)
                counts["messages"] += 1
                if len(held) >= flush:
                    settle()
            settle()
            return counts
        except OSError:
            settle()
            failed += 1
            if failed >= attempts:
                raise
            wait(backoff(failed - 1))
