"""Scans, idempotent sinks, projections, filters and predicates (inventory sections A and B)."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideway.sources.silver import NOW
from tideway.sources.tables import Net, operator

LISTED = r"\|"


def items(packed: str | Column) -> Column:
    """The members of a packed list; a null list has none."""
    return F.filter(F.split(F.coalesce(F.col(packed) if isinstance(packed, str) else packed, F.lit("")), LISTED), lambda x: x != "")


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` computed once and cut off from its lineage, in the shared folder of spark.checkpoint.dir.

    It is read back from files, whose size the planner knows.  A checkpoint of Spark's keeps the estimate of the plan that
    made it: over rounds of joins that is a number whose digits double with each round, and fills the driver.
    Where the folder is unset and Spark runs in one process, one of the warehouse is used; on a cluster it is an error.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not where:
        if not context.master.startswith(("local[", "local")) or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir isn't set")
        where = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/tideway-steps"
    path = f"{where.rstrip('/')}/step-{uuid.uuid4().hex}"
    hadoop = context._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def released(df: DataFrame) -> None:
    """Delete the files of a table of :func:`checkpointed` that no later step reads."""
    context = df.sparkSession.sparkContext
    for name in df.inputFiles()[:1]:
        path = context._jvm.org.apache.hadoop.fs.Path(name).getParent()
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def upsert(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The rows that a keyed write leaves: new rows replace old ones of their key."""
    return existing.select(*new.columns).join(new.select(key), key, "left_anti").unionByName(new)


def latest_state(rows: DataFrame, key: str, at: str, tie: str, moving: list[str], fixed: list[str]) -> DataFrame:
    """One row a key: ``moving`` columns as of the latest row, ``fixed`` ones from the latest row that has them."""
    order = lambda c: F.struct(F.col(at), F.col(tie), F.col(c).alias("v"))
    last = F.max(F.struct(at, tie, *moving))
    picked = [F.max(F.when(F.col(c).isNotNull(), order(c))).getField("v").alias(c) for c in fixed]
    return rows.groupBy(key).agg(last.alias("m"), *picked).select(key, *[F.col(f"m.{c}").alias(c) for c in (at, *moving)], *fixed)


def replaced_edges(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Edges after a write that replaces all edges of the keys that it touches."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def active(expires: str | Column, now: Column) -> Column:
    """Whether something is in force: an expiry that is there and lies after ``now``."""
    at = F.col(expires) if isinstance(expires, str) else expires
    return at.isNotNull() & (at > now)


def contains(text: Column, part: str) -> Column:
    """Whether ``part`` occurs in the text, in any case; all characters are plain."""
    return F.lower(text).contains(part.lower())


def optional(df: DataFrame, **wanted: object) -> DataFrame:
    """Rows that equal every value given; a None isn't a condition, so it never reaches the plan."""
    for name, value in wanted.items():
        df = df if value is None else df.filter(F.col(name) == value)
    return df


@operator("SELECT location_id, name, region, code, lat, lng FROM locations")
def scan_entity(t: Net) -> DataFrame:
    return t.locations.select("location_id", "name", "region", "code", "lat", "lng")


@operator("""SELECT 'Location' AS label, CAST(count(*) AS BIGINT) AS n FROM locations UNION ALL
SELECT kind, CAST(count(*) AS BIGINT) FROM locations GROUP BY kind UNION ALL
SELECT 'Hub', CAST(count(*) AS BIGINT) FROM locations WHERE location_id % 10 = 0 HAVING count(*) > 0""")
def label_counts(t: Net) -> DataFrame:
    hub = F.when(F.col("location_id") % 10 == 0, "Hub")
    labels = t.locations.select(F.array_compact(F.array(F.lit("Location"), "kind", hub)).alias("labels"))
    return labels.select(F.explode("labels").alias("label")).groupBy("label").agg(F.count("*").alias("n"))


@operator("""SELECT k, v FROM (SELECT k, v, row_number() OVER (PARTITION BY k ORDER BY seq DESC) AS r
  FROM (SELECT k, v, 0 AS seq FROM existing UNION ALL SELECT k, v, 1 FROM desired) u) w WHERE r = 1""")
def upsert_merge(t: Net) -> DataFrame:
    return upsert(t.existing, t.desired, "k")


@operator("""SELECT coalesce(e.k, d.k) AS k, coalesce(e.v, d.v) AS v
FROM (SELECT * FROM existing WHERE k % 4 <> 0) e FULL OUTER JOIN desired d ON e.k = d.k""")
def upsert_keep_existing(t: Net) -> DataFrame:
    old, new = t.existing.filter("k % 4 <> 0").select("k", "v"), t.desired.withColumnRenamed("v", "w")
    return old.join(new, "k", "full").select("k", F.coalesce("v", "w").alias("v"))


@operator("""SELECT a.mmsi, a.observed_at, a.speed100, b.nav_code FROM
 (SELECT mmsi, observed_at, speed100, row_number() OVER (PARTITION BY mmsi ORDER BY observed_at DESC, event_id DESC) AS r FROM vessel_obs) a
 LEFT JOIN (SELECT mmsi, nav_code, row_number() OVER (PARTITION BY mmsi ORDER BY observed_at DESC, event_id DESC) AS r
   FROM vessel_obs WHERE event_type <> 'error' AND nav_code IS NOT NULL) b ON a.mmsi = b.mmsi AND b.r = 1 WHERE a.r = 1""")
def vessel_latest_state(t: Net) -> DataFrame:
    rows = t.vessel_obs.withColumn("nav_code", F.when(F.col("event_type") != "error", F.col("nav_code")))
    return latest_state(rows, "mmsi", "observed_at", "event_id", ["speed100"], ["nav_code"])


@operator("""SELECT from_id, to_id, mode FROM segments s WHERE NOT EXISTS (SELECT 1 FROM segments x
  WHERE x.from_id = s.from_id AND x.mode = 'sea' AND x.data_status = 'synthetic')
UNION ALL SELECT from_id, to_id, 'sea' FROM segments WHERE mode = 'sea' AND data_status = 'synthetic'""")
def edge_replace(t: Net) -> DataFrame:
    edges = t.segments
    return replaced_edges(edges.select("from_id", "to_id", "mode"), edges.filter("mode = 'sea' and data_status = 'synthetic'").select("from_id", "to_id", "mode"), "from_id")


@operator("""SELECT route_id, snapshot_id, created FROM (SELECT r.route_id, s.snapshot_id, s.created,
  row_number() OVER (PARTITION BY r.route_id ORDER BY s.created DESC, s.snapshot_id) AS place
  FROM (SELECT concat('N', CAST(o_orderkey AS STRING)) AS snapshot_id, CAST(o_orderdate AS DATE) AS created,
    o_orderkey % 25 AS a, (o_orderkey * 3 + 1) % 25 AS b FROM orders) s
  JOIN (SELECT DISTINCT route_id, from_id FROM route_segments) r ON r.from_id = s.a OR r.from_id = s.b) x WHERE place = 1""")
def snapshot_latest_for_route(t: Net) -> DataFrame:
    """The newest snapshot whose list of routes holds the route."""
    day = F.col("o_orderdate").cast("date")
    listed = F.array_distinct(F.array(F.col("o_orderkey") % 25, (F.col("o_orderkey") * 3 + 1) % 25))
    snapshots = t.orders.select(F.concat(F.lit("N"), F.col("o_orderkey").cast("string")).alias("snapshot_id"), day.alias("created"), F.explode(listed).alias("from_id"))
    newest = snapshots.groupBy("from_id").agg(F.min(F.struct((-F.unix_date("created")).alias("d"), "snapshot_id", "created")).alias("m"))
    return t.route_segments.select("route_id", "from_id").distinct().join(newest, "from_id").select("route_id", "m.snapshot_id", "m.created")


@operator(f"SELECT segment_id, observed_at FROM segments WHERE observed_at >= {NOW} - 30")
def retention_keep(t: Net) -> DataFrame:
    return t.segments.filter(F.col("observed_at") >= F.date_sub(F.expr(NOW), 30)).select("segment_id", "observed_at")


@operator("""SELECT k, CASE WHEN deleted AND NOT restored THEN 'deleted' WHEN deleted THEN 'restored' ELSE 'active' END AS status,
  CAST(1 + CASE WHEN deleted THEN 1 ELSE 0 END + CASE WHEN deleted AND restored THEN 1 ELSE 0 END AS BIGINT) AS log_rows
FROM (SELECT e.k, d.k IS NULL AS deleted, NOT e.active AS restored FROM existing e LEFT JOIN desired d ON e.k = d.k) x""")
def soft_delete_view(t: Net) -> DataFrame:
    """The status that an append-only audit log leaves: its last entry for each key."""
    base = t.existing.join(t.desired.select("k", F.lit(True).alias("kept")), "k", "left")
    log = lambda rows, at, what: rows.select("k", F.lit(at).alias("at"), F.lit(what).alias("status"))
    gone = base.filter("kept is null")
    entries = log(base, 1, "active").union(log(gone, 2, "deleted")).union(log(gone.filter("not active"), 3, "restored"))
    return entries.groupBy("k").agg(F.max_by("status", "at").alias("status"), F.count("*").alias("log_rows"))


@operator("SELECT segment_id, coalesce(provider, mode) AS source, coalesce(risk, completeness, 0.0e0) AS first_known FROM segments")
def segment_projection(t: Net) -> DataFrame:
    return t.segments.select("segment_id", F.coalesce("provider", "mode").alias("source"), F.coalesce("risk", "completeness", F.lit(0.0)).alias("first_known"))


@operator("SELECT segment_id, risk, completeness, status FROM gated")
def ttl_gated_risk(t: Net) -> DataFrame:
    """Scores that count only while they are in force and come from a provider; each column has its own default."""
    valid = F.col("provider").isNotNull() & active("expires_at", F.expr(NOW))
    status = F.when(~valid | F.col("risk").isNull(), "unavailable").when(F.col("completeness") >= 1, "available").otherwise("partial")
    return t.segments.select("segment_id", F.when(valid, F.col("risk")).alias("risk"), F.when(valid, F.col("completeness")).otherwise(0.0).alias("completeness"), status.alias("status"))


@operator("""SELECT s.s_suppkey, CASE WHEN p.s_suppkey IS NOT NULL THEN s.s_acctbal END AS risk_score,
  CASE WHEN p.s_suppkey IS NOT NULL THEN 'available' ELSE 'unavailable' END AS risk_status, coalesce(p.n, 0) AS providers
FROM supplier s LEFT JOIN (SELECT s_suppkey, CAST(count(DISTINCT provider) AS BIGINT) AS n FROM supplier JOIN segments ON s_nationkey = from_id
  WHERE provider IS NOT NULL AND mode = 'air' AND n % 5 = 0 GROUP BY s_suppkey) p ON s.s_suppkey = p.s_suppkey""")
def provider_gated_supplier(t: Net) -> DataFrame:
    """A supplier's score is shown only if its list of providers isn't empty."""
    lists = t.segments.filter("mode = 'air' and n % 5 = 0").groupBy("from_id").agg(F.collect_set("provider").alias("providers"))
    rows = t.supplier.join(lists, F.col("s_nationkey") == F.col("from_id"), "left").withColumn("providers", F.coalesce("providers", F.array().cast("array<string>")))
    there = F.size("providers") > 0
    return rows.select("s_suppkey", F.when(there, F.col("s_acctbal")).alias("risk_score"), F.when(there, "available").otherwise("unavailable").alias("risk_status"), F.size("providers").cast("long").alias("providers"))


@operator("SELECT segment_id, mode, provider FROM segments WHERE mode = 'sea'")
def optional_filter(t: Net) -> DataFrame:
    return optional(t.segments, mode="sea", provider=None).select("segment_id", "mode", "provider")


@operator("SELECT location_id, name FROM locations WHERE strpos(lower(name), '_1') > 0 OR strpos(lower(region), 'asi') > 0")
def search_contains(t: Net) -> DataFrame:
    return t.locations.filter(contains(F.col("name"), "_1") | contains(F.col("region"), "ASI")).select("location_id", "name")


@operator("""SELECT DISTINCT location_id FROM locations, unnest(string_split(coalesce(aliases, ''), '|')) AS u(alias)
WHERE lower(alias) IN ('harbour 7', 'nation_9')""")
def alias_any(t: Net) -> DataFrame:
    return t.locations.filter(F.exists(items("aliases"), lambda x: F.lower(x).isin("harbour 7", "nation_9"))).select("location_id")


@operator("SELECT location_id, upper(replace(code, '-', '')) AS norm FROM locations WHERE upper(replace(code, '-', '')) IN ('LOC7', 'LOC12')")
def normalized_id_match(t: Net) -> DataFrame:
    norm = F.upper(F.regexp_replace("code", "-", ""))
    return t.locations.select("location_id", norm.alias("norm")).filter(F.col("norm").isin("LOC7", "LOC12"))


@operator("SELECT location_id, kind FROM locations WHERE kind IN ('Port', 'Airport')")
def label_filter(t: Net) -> DataFrame:
    labels = F.array(F.lit("Location"), "kind")
    return t.locations.filter(F.arrays_overlap(labels, F.array(F.lit("Port"), F.lit("Airport")))).select("location_id", "kind")


@operator("SELECT segment_id FROM segments WHERE feasibility IS DISTINCT FROM 'invalid_cross_ocean'")
def feasible_segments(t: Net) -> DataFrame:
    return t.segments.filter(F.coalesce("feasibility", F.lit("")) != "invalid_cross_ocean").select("segment_id")


@operator("""SELECT g.segment_id, a.name AS from_name, b.name AS to_name, g.risk, g.completeness FROM gated g
JOIN locations a ON g.from_id = a.location_id JOIN locations b ON g.to_id = b.location_id
WHERE g.risk IS NOT NULL AND g.risk >= 0.4e0 ORDER BY g.risk DESC, g.segment_id LIMIT 100""")
def ranked_risk_segments(t: Net) -> DataFrame:
    top = t.gated.filter("risk >= 0.4").orderBy(F.desc("risk"), "segment_id").limit(100)
    name = lambda end: t.locations.select(F.col("location_id").alias(f"{end}_id"), F.col("name").alias(f"{end}_name"))
    return top.join(name("from"), "from_id").join(name("to"), "to_id").select("segment_id", "from_name", "to_name", "risk", "completeness")


@operator("SELECT segment_id, provider IS NOT NULL OR risk IS NOT NULL AS any_known FROM segments")
def any_field_not_null(t: Net) -> DataFrame:
    fields = ["provider", "risk"]  # names that a request gives
    known = F.exists(F.array(*[F.col(f).cast("string") for f in fields]), lambda x: x.isNotNull())
    return t.segments.select("segment_id", known.alias("any_known"))


@operator("SELECT location_id, regexp_full_match(code, '(PORT|AIR|LOC)-[A-Z0-9-]+') AS well_formed FROM locations")
def id_format_check(t: Net) -> DataFrame:
    return t.locations.select("location_id", F.col("code").rlike("^(PORT|AIR|LOC)-[A-Z0-9-]+$").alias("well_formed"))


def without_high_risk(segments: DataFrame, threshold: float, score: str = "risk") -> tuple[DataFrame, DataFrame]:
    """(segments below the threshold, zones of the others); an unknown score counts as 0."""
    high = F.coalesce(score, F.lit(0.0)) >= threshold
    return segments.filter(~high), segments.filter(high).select(F.explode(items("zone_ids")).alias("zone_id")).distinct()


@operator("""SELECT segment_id AS id, 'kept' AS kind FROM segments WHERE coalesce(risk, 0) < 0.6e0
UNION ALL SELECT DISTINCT u.zone, 'blocked_zone' FROM segments, unnest(string_split(zone_ids, '|')) AS u(zone) WHERE risk >= 0.6e0""")
def reroute_block_filter(t: Net) -> DataFrame:
    kept, blocked = without_high_risk(t.segments, 0.6)
    return kept.select(F.col("segment_id").alias("id"), F.lit("kept").alias("kind")).union(blocked.select("zone_id", F.lit("blocked_zone")))


@operator("""SELECT segment_id FROM segments s WHERE NOT EXISTS (SELECT 1 FROM (SELECT 'Z3' AS z UNION ALL SELECT 'Z7') a
  WHERE strpos(concat('|', coalesce(s.zone_ids, ''), '|'), concat('|', a.z, '|')) > 0)""")
def avoid_zones(t: Net) -> DataFrame:
    return t.segments.filter(~F.arrays_overlap(items("zone_ids"), F.array(F.lit("Z3"), F.lit("Z7")))).select("segment_id")


@operator("SELECT segment_id, mode FROM segments WHERE mode IN ('sea', 'rail')")
def allowed_modes(t: Net) -> DataFrame:
    return t.segments.filter(F.col("mode").isin("sea", "rail")).select("segment_id", "mode")


@operator("""SELECT segment_id, reason IS NULL AS eligible, reason FROM (SELECT s.segment_id, CASE
  WHEN s.data_status = 'synthetic' THEN 'synthetic' WHEN s.data_status = 'estimated' AND s.zone_ids IS NULL AND s.provider IS NULL THEN 'inactive_estimated'
  WHEN a.location_id IS NULL OR b.location_id IS NULL THEN 'missing_coordinates'
  WHEN s.feasibility = 'invalid_cross_ocean' THEN 'infeasible' END AS reason
FROM segments s LEFT JOIN locations a ON s.from_id = a.location_id AND NOT (a.lat = 0 AND a.lng = 0)
  LEFT JOIN locations b ON s.to_id = b.location_id AND b.lat <> -60) x""")
def route_eligibility(t: Net) -> DataFrame:
    """Eligible, or the first reason in a fixed order why not."""
    place = t.locations.select("location_id", "lat", "lng")
    ends = [place.filter("not (lat = 0 and lng = 0)").select(F.col("location_id").alias("from_id"), F.lit(1).alias("a"))]
    ends += [place.filter("lat <> -60").select(F.col("location_id").alias("to_id"), F.lit(1).alias("b"))]
    rows = t.segments.join(ends[0], "from_id", "left").join(ends[1], "to_id", "left")
    reason = F.coalesce(
        F.when(F.col("data_status") == "synthetic", "synthetic"),
        F.when((F.col("data_status") == "estimated") & F.col("zone_ids").isNull() & F.col("provider").isNull(), "inactive_estimated"),
        F.when(F.col("a").isNull() | F.col("b").isNull(), "missing_coordinates"),
        F.when(F.col("feasibility") == "invalid_cross_ocean", "infeasible"),
    )
    return rows.select("segment_id", reason.isNull().alias("eligible"), reason.alias("reason"))


@operator("""SELECT segment_id, 'risk_unknown' AS reason FROM gated WHERE risk IS NULL
UNION ALL SELECT segment_id, 'risk_too_high' FROM gated WHERE risk > 0.7e0
UNION ALL SELECT segment_id, 'cost_too_high' FROM gated WHERE cost IS NULL OR cost > 450
UNION ALL SELECT segment_id, 'too_slow' FROM gated WHERE time_days IS NULL OR time_days > 28""")
def constraint_failures(t: Net) -> DataFrame:
    failed = F.array_compact(
        F.array(
            F.when(F.col("risk").isNull(), "risk_unknown"),
            F.when(F.col("risk") > 0.7, "risk_too_high"),
            F.when(F.col("cost").isNull() | (F.col("cost") > 450), "cost_too_high"),
            F.when(F.col("time_days").isNull() | (F.col("time_days") > 28), "too_slow"),
        )
    )
    return t.gated.select("segment_id", F.explode(failed).alias("reason"))


@operator("""SELECT segment_id, reasons FROM (SELECT segment_id, concat_ws(',', CASE WHEN risk IS NULL THEN 'risk_unknown' END,
  CASE WHEN completeness < 0.5e0 THEN 'incomplete' END) AS reasons, completeness FROM gated) x
WHERE reasons <> '' ORDER BY completeness DESC, segment_id LIMIT 50""")
def rejected_candidates(t: Net) -> DataFrame:
    """The first 50 rejected candidates with all their reasons; the limit is the report's."""
    reasons = F.array_compact(F.array(F.when(F.col("risk").isNull(), "risk_unknown"), F.when(F.col("completeness") < 0.5, "incomplete")))
    rejected = t.gated.withColumn("r", reasons).filter(F.size("r") > 0).orderBy(F.desc("completeness"), "segment_id").limit(50)
    return rejected.select("segment_id", F.array_join("r", ",").alias("reasons"))


@operator("""SELECT target_id, south < north AND west < east AS box_ok, greatest(abs(south), abs(north)) <= 90 AS lat_ok,
  reference_count > 0 AS reference_ok, zone_id IS NOT NULL OR length(coalesce(port_ids, '')) > 0 AS links_ok,
  (SELECT count(*) FROM targets x WHERE x.target_id = targets.target_id) = 1 AS unique_ok FROM targets""")
def target_config_checks(t: Net) -> DataFrame:
    """Boxes in order and on the globe, a reference, a port list or a zone, and ids that are there once."""
    in_range = lambda c: F.col(c).between(-90, 90)
    return t.targets.select(
        "target_id",
        ((F.col("south") < F.col("north")) & (F.col("west") < F.col("east"))).alias("box_ok"),
        (in_range("south") & in_range("north")).alias("lat_ok"),
        (F.col("reference_count") > 0).alias("reference_ok"),
        ((F.size(items("port_ids")) > 0) | F.col("zone_id").isNotNull()).alias("links_ok"),
        (F.count("*").over(Window.partitionBy("target_id")) == 1).alias("unique_ok"),
    )


@operator("""SELECT c_custkey FROM customer WHERE (strpos(lower(c_name), '7') > 0 OR strpos(lower(c_name), '13') > 0)
AND c_mktsegment IN ('MACHINERY', 'HOUSEHOLD')""")
def facet_selection(t: Net) -> DataFrame:
    """Values are alternatives inside a facet, facets must all hold, and an empty facet is no condition."""
    tests = {"contains": lambda c, v: F.lower(c).contains(F.lower(v)), "equals": lambda c, v: F.col(c) == v}
    facets = [("c_name", "contains", ["7", "13"]), ("c_mktsegment", "equals", ["MACHINERY", "HOUSEHOLD"]), ("c_custkey", "equals", [])]
    rows = t.customer
    for column, how, values in facets:
        if values:
            rows = rows.filter(reduce(Column.__or__, [tests[how](column, F.lit(v)) for v in values]))
    return rows.select("c_custkey")
