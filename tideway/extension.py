"""What a user of the library can plug in: providers of locations, storage, segment builders, SQL functions (section K)."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideway.streaming.ais import latest_rows

LOCATION = "location_id string, name string, kind string, lat double, lng double, provider string"
SegmentBuilder = Callable[[DataFrame], DataFrame]


class LocationProvider(ABC):
    """A source of locations.  ``collect`` returns a DataFrame with the columns of LOCATION."""

    name: str

    @abstractmethod
    def collect(self, spark: SparkSession, request: dict) -> DataFrame: ...


def collected(spark: SparkSession, providers: list[LocationProvider], request: dict) -> tuple[DataFrame, dict[str, str]]:
    """(locations of all providers, their states).  One that fails or lacks a column doesn't stop the others; of rows with
    one id the last provider's counts."""
    rows, states = spark.createDataFrame([], LOCATION + ", order_ int"), {}
    for k, p in enumerate(providers):
        try:
            found = p.collect(spark, request).withColumn("provider", F.lit(p.name))
            names = [c.split()[0] for c in LOCATION.split(", ")]
            rows = rows.unionByName(found.select(*names).withColumn("order_", F.lit(k)))
            states[p.name] = "ok"
        except Exception as e:  # noqa: BLE001  any failure of a plug-in is its state
            states[p.name] = f"failed: {type(e).__name__}"
    return latest_rows(rows.withColumnRenamed("order_", "batch"), ["location_id"]), states


class Storage(Protocol):
    """The boundary at which streams keep what they make; every write may come twice."""

    def write_observations(self, rows: DataFrame, batch: int) -> None: ...
    def write_snapshots(self, rows: DataFrame, batch: int) -> None: ...
    def latest_snapshots(self, spark: SparkSession) -> DataFrame: ...
    def expire(self, spark: SparkSession, now: str) -> DataFrame: ...
    def write_state(self, state: dict[str, int]) -> None: ...


class ParquetStorage:
    """Storage in folders that only grow, one for each micro-batch, so that a batch written again replaces itself."""

    def __init__(self, folder: str, schema: str):
        self.folder, self.schema, self.state = folder, schema, {}

    def _write(self, rows: DataFrame, kind: str, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.folder}/{kind}/batch={batch}")

    def write_observations(self, rows: DataFrame, batch: int) -> None:
        self._write(rows, "observations", batch)

    def write_snapshots(self, rows: DataFrame, batch: int) -> None:
        self._write(rows, "snapshots", batch)

    def latest_snapshots(self, spark: SparkSession) -> DataFrame:
        return latest_rows(spark.read.schema(self.schema + ", batch long").parquet(f"{self.folder}/snapshots"), ["snapshot_id"])

    def expire(self, spark: SparkSession, now: str) -> DataFrame:
        """Snapshots as they count at ``now``: those that have expired lose their score, and nothing is rewritten."""
        live = F.col("expires_at") > F.lit(now).cast("timestamp")
        return self.latest_snapshots(spark).withColumns({"score": F.when(live, F.col("score")), "status": F.when(live, "available").otherwise("unavailable")})

    def write_state(self, state: dict[str, int]) -> None:
        self.state = dict(state)


def built(segments: DataFrame, builder: SegmentBuilder) -> DataFrame:
    """Segments with the geometry that a builder gives them; it must keep every row and add ``geometry``."""
    out = builder(segments)
    if "geometry" not in out.columns or not set(segments.columns) <= set(out.columns):
        raise ValueError("a builder keeps all columns and adds geometry")
    return out


def register_functions(spark: SparkSession) -> None:
    """SQL functions of the library, for the session: clamp(x, low, high) and gated(x, expires, now)."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION clamp(x DOUBLE, low DOUBLE, high DOUBLE) RETURNS DOUBLE RETURN CASE WHEN x IS NOT NULL THEN least(greatest(x, low), high) END")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION gated(x DOUBLE, expires TIMESTAMP, at TIMESTAMP) RETURNS DOUBLE RETURN CASE WHEN expires > at THEN x END")
