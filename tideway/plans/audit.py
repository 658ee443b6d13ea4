"""Data quality, audits and reconciliation plans (section M)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideway.functions.geo import ends, haversine, haversine_sql, pairs
from tideway.functions.scalars import compact
from tideway.operators.graph import closure
from tideway.operators.joins import mode_feasibility, named, reconciled
from tideway.sources.tables import Net, operator


def united(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def metrics(rows: DataFrame, **counts: Column) -> DataFrame:
    """(metric, value) of several conditions over one pass of the rows."""
    return rows.agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(k) for k, c in counts.items()]).unpivot([], list(counts), "metric", "value")


AUDIT = """SELECT 'segments' AS metric, CAST(count(*) AS BIGINT) AS value FROM segments UNION ALL SELECT 'without_risk', CAST(count(*) AS BIGINT) FROM segments WHERE risk IS NULL
UNION ALL SELECT 'without_provider', CAST(count(*) AS BIGINT) FROM segments WHERE provider IS NULL UNION ALL SELECT 'infeasible', CAST(count(*) AS BIGINT) FROM segments WHERE feasibility = 'invalid_cross_ocean'
UNION ALL SELECT 'synthetic', CAST(count(*) AS BIGINT) FROM segments WHERE data_status = 'synthetic' UNION ALL SELECT 'estimated', CAST(count(*) AS BIGINT) FROM segments WHERE data_status = 'estimated'
UNION ALL SELECT 'expired', CAST(count(*) AS BIGINT) FROM segments WHERE expires_at <= DATE '2001-06-01' UNION ALL SELECT 'exposed', CAST(count(*) AS BIGINT) FROM segments WHERE zone_ids IS NOT NULL
UNION ALL SELECT 'incomplete', CAST(count(*) AS BIGINT) FROM segments WHERE completeness < 1 UNION ALL SELECT 'locations', CAST(count(*) AS BIGINT) FROM locations
UNION ALL SELECT 'ports', CAST(count(*) AS BIGINT) FROM locations WHERE kind = 'Port' UNION ALL SELECT 'without_alias', CAST(count(*) AS BIGINT) FROM locations WHERE aliases IS NULL
UNION ALL SELECT 'suppliers', CAST(count(*) AS BIGINT) FROM supplier UNION ALL SELECT 'suppliers_with_origin', CAST(count(*) AS BIGINT) FROM suppliers_from
UNION ALL SELECT 'routes', CAST(count(DISTINCT route_id) AS BIGINT) FROM route_segments UNION ALL SELECT 'articles', CAST(count(*) AS BIGINT) FROM news
UNION ALL SELECT 'vessels', CAST(count(DISTINCT mmsi) AS BIGINT) FROM vessel_obs UNION ALL SELECT 'targets', CAST(count(*) AS BIGINT) FROM targets"""


def audit(t: Net) -> DataFrame:
    """All counts of the audit, each table read once."""
    yes = F.lit(True)
    counted = lambda df, name: df.agg(F.count("*").alias("value")).select(F.lit(name).alias("metric"), "value")
    s = metrics(
        t.segments, segments=yes, without_risk=F.col("risk").isNull(), without_provider=F.col("provider").isNull(), infeasible=F.col("feasibility") == "invalid_cross_ocean",
        synthetic=F.col("data_status") == "synthetic", estimated=F.col("data_status") == "estimated", expired=F.col("expires_at") <= F.expr("DATE '2001-06-01'"),
        exposed=F.col("zone_ids").isNotNull(), incomplete=F.col("completeness") < 1,
    )
    places = metrics(t.locations, locations=yes, ports=F.col("kind") == "Port", without_alias=F.col("aliases").isNull())
    rest = [counted(t.supplier, "suppliers"), counted(t.suppliers_from, "suppliers_with_origin"), counted(t.route_segments.select("route_id").distinct(), "routes")]
    rest += [counted(t.news, "articles"), counted(t.vessel_obs.select("mmsi").distinct(), "vessels"), counted(t.targets, "targets")]
    return united([s, places, *rest])


@operator(AUDIT)
def audit_summary(t: Net) -> DataFrame:
    return audit(t)


#: Rules over the audit's numbers: (code, severity, metric, most that is fine, metric that it is a share of).
RULES = (
    ("NO_PROVIDER", "high", "without_provider", 20, None), ("NO_RISK", "medium", "without_risk", 100, None), ("INFEASIBLE", "high", "infeasible", 0, None), ("SYNTHETIC", "high", "synthetic", 10, None),
    ("MOSTLY_ESTIMATED", "medium", "estimated", 0.5, "segments"), ("EXPIRED", "medium", "expired", 0.1, "segments"), ("UNEXPOSED", "low", "exposed", 0.9, "segments"), ("INCOMPLETE", "low", "incomplete", 0.9, "segments"),
    ("NO_ALIAS", "low", "without_alias", 3, None), ("NO_ORIGIN", "medium", "suppliers_with_origin", 0.99, "suppliers"), ("FEW_TARGETS", "low", "targets", 3, None),
)
RULE_ROWS = ", ".join(f"('{c}', '{s}', '{m}', {x}e0, {'NULL' if o is None else repr(o)})" for c, s, m, x, o in RULES)


@operator(f"""WITH a AS ({AUDIT}) SELECT code, severity, concat(a.metric, ' ', CAST(a.value AS STRING)) AS message FROM (VALUES {RULE_ROWS}) r(code, severity, m, most, share) JOIN a ON a.metric = r.m LEFT JOIN a b ON b.metric = r.share
WHERE a.value > most * coalesce(b.value, 1)""")
def audit_findings(t: Net) -> DataFrame:
    """Eleven threshold rules over the audit's counts."""
    rules = t.spark.createDataFrame([(c, s, m, float(x), o) for c, s, m, x, o in RULES], "code string, severity string, metric string, most double, share string")
    found = audit(t).select(F.map_from_entries(F.collect_list(F.struct("metric", "value"))).alias("m"))  # a number of metrics that the code fixes
    rows = rules.join(F.broadcast(found))
    value, of = F.try_element_at("m", F.col("metric")), F.coalesce(F.try_element_at("m", F.col("share")), F.lit(1))
    return rows.filter(value > F.col("most") * of).select("code", "severity", F.concat_ws(" ", "metric", value.cast("string")).alias("message"))


@operator("""SELECT 'part' AS entity, CAST(count(*) AS BIGINT) AS total, CAST(count(p_name) AS BIGINT) AS with_id, CAST(count(*) - count(p_name) AS BIGINT) AS missing, CAST(count(p_name) - count(DISTINCT p_name) AS BIGINT) AS duplicates FROM part
UNION ALL SELECT 'supplier', CAST(count(*) AS BIGINT), CAST(count(s_name) AS BIGINT), CAST(0 AS BIGINT), CAST(count(s_name) - count(DISTINCT s_name) AS BIGINT) FROM supplier
UNION ALL SELECT 'segment_provider', CAST(count(*) AS BIGINT), CAST(count(provider) AS BIGINT), CAST(sum(CASE WHEN provider IS NULL THEN 1 ELSE 0 END) AS BIGINT), CAST(count(provider) - count(DISTINCT provider) AS BIGINT) FROM segments""")
def identity_audit(t: Net) -> DataFrame:
    def checked(rows: DataFrame, entity: str, key: str) -> DataFrame:
        missing = F.count_if(F.col(key).isNull())
        return rows.agg(F.count("*").alias("total"), F.count(key).alias("with_id"), missing.alias("missing"), (F.count(key) - F.count_distinct(key)).alias("duplicates")).select(F.lit(entity).alias("entity"), "*")

    return united([checked(t.part, "part", "p_name"), checked(t.supplier, "supplier", "s_name"), checked(t.segments, "segment_provider", "provider")])


CHECKS = """SELECT 'segments_have_endpoints' AS name, 'fail' AS bad, count(*) AS n FROM segments s LEFT JOIN locations l ON s.from_id = l.location_id WHERE l.location_id IS NULL
UNION ALL SELECT 'risk_has_provider', 'warn', count(*) FROM segments WHERE risk IS NOT NULL AND provider IS NULL UNION ALL SELECT 'completeness_in_range', 'fail', count(*) FROM segments WHERE completeness < 0 OR completeness > 1
UNION ALL SELECT 'risk_in_range', 'fail', count(*) FROM segments WHERE risk < 0 OR risk > 1 UNION ALL SELECT 'unique_segments', 'fail', count(*) FROM (SELECT segment_id FROM segments GROUP BY segment_id HAVING count(*) > 1) x
UNION ALL SELECT 'expiry_after_sight', 'fail', count(*) FROM segments WHERE expires_at < observed_at UNION ALL SELECT 'routes_start_at_one', 'fail', count(*) FROM (SELECT route_id FROM route_segments GROUP BY route_id HAVING min(sequence) <> 1 OR max(sequence) <> count(*)) x
UNION ALL SELECT 'no_synthetic', 'warn', count(*) FROM segments WHERE data_status = 'synthetic' UNION ALL SELECT 'no_loops', 'fail', count(*) FROM segments WHERE from_id = to_id"""


@operator(f"""WITH c AS ({CHECKS}), d AS (SELECT name, CASE WHEN n = 0 THEN 'pass' ELSE bad END AS status, CAST(n AS BIGINT) AS violations FROM c)
SELECT name, status, violations FROM d UNION ALL SELECT 'overall', CASE WHEN bool_or(status = 'fail') THEN 'fail' WHEN bool_or(status = 'warn') THEN 'warn' ELSE 'pass' END, CAST(sum(violations) AS BIGINT) FROM d""")
def validation_checks(t: Net) -> DataFrame:
    """Nine checks; the overall status is the worst of them."""
    s = t.segments
    by_row = metrics(
        s, risk_has_provider=F.col("risk").isNotNull() & F.col("provider").isNull(), completeness_in_range=~F.col("completeness").between(0, 1), risk_in_range=~F.col("risk").between(0, 1),
        expiry_after_sight=F.col("expires_at") < F.col("observed_at"), no_synthetic=F.col("data_status") == "synthetic", no_loops=F.col("from_id") == F.col("to_id"),
    )
    counted = lambda df, name: df.agg(F.count("*").alias("value")).select(F.lit(name).alias("metric"), "value")
    lost = s.join(t.locations, F.col("from_id") == F.col("location_id"), "left_anti")
    twice = s.groupBy("segment_id").count().filter("count > 1")
    gaps = t.route_segments.groupBy("route_id").agg(F.min("sequence").alias("a"), F.max("sequence").alias("z"), F.count("*").alias("n")).filter("a <> 1 or z <> n")
    found = united([by_row, counted(lost, "segments_have_endpoints"), counted(twice, "unique_segments"), counted(gaps, "routes_start_at_one")])
    bad = F.when(F.col("metric").isin("risk_has_provider", "no_synthetic"), "warn").otherwise("fail")
    checks = found.select(F.col("metric").alias("name"), F.when(F.col("value") == 0, "pass").otherwise(bad).alias("status"), F.col("value").alias("violations"))
    rank = F.max(F.when(F.col("status") == "fail", 2).when(F.col("status") == "warn", 1).otherwise(0))
    worst = checks.agg(F.element_at(F.array(F.lit("pass"), F.lit("warn"), F.lit("fail")), rank + 1).alias("status"), F.sum("violations").alias("violations"))
    return checks.unionByName(worst.select(F.lit("overall").alias("name"), "status", "violations"))


@operator("""SELECT segment_id, coalesce(provider, CASE WHEN data_status = 'synthetic' THEN 'generator' ELSE 'unknown' END) AS provider,
  CASE WHEN data_status = 'synthetic' THEN 'synthetic' WHEN provider IS NULL THEN 'estimated' WHEN data_status = 'provider' THEN 'provider' ELSE 'derived' END AS source_type,
  data_status <> 'provider' OR provider IS NULL AS is_inferred, CASE WHEN data_status = 'synthetic' THEN 0.2e0 WHEN provider IS NULL THEN 0.35e0 ELSE 0.7e0 END AS confidence, 'unified-transport-v1' AS schema_version FROM segments""")
def normalize_provenance(t: Net) -> DataFrame:
    made, nobody = F.col("data_status") == "synthetic", F.col("provider").isNull()
    return t.segments.select(
        "segment_id",
        F.coalesce("provider", F.when(made, "generator"), F.lit("unknown")).alias("provider"),
        F.when(made, "synthetic").when(nobody, "estimated").when(F.col("data_status") == "provider", "provider").otherwise("derived").alias("source_type"),
        ((F.col("data_status") != "provider") | nobody).alias("is_inferred"),
        F.when(made, 0.2).when(nobody, 0.35).otherwise(0.7).alias("confidence"),
        F.lit("unified-transport-v1").alias("schema_version"),
    )


@operator("""SELECT segment_id, mode AS canonical_mode, coalesce(feasibility, 'unverified') AS feasibility_status, coalesce(feasibility, '') <> 'invalid_cross_ocean' AND data_status <> 'synthetic' AS valid FROM segments""")
def normalize_segments(t: Net) -> DataFrame:
    status = F.coalesce("feasibility", F.lit("unverified"))
    return t.segments.select("segment_id", F.col("mode").alias("canonical_mode"), status.alias("feasibility_status"), ((status != "invalid_cross_ocean") & (F.col("data_status") != "synthetic")).alias("valid"))


@operator("""SELECT 'label' AS kind, kind AS name, CAST(count(*) AS BIGINT) AS n FROM locations GROUP BY kind UNION ALL SELECT 'label', 'TransportLocation', CAST(count(*) AS BIGINT) FROM locations
UNION ALL SELECT 'label', 'RouteSegment', CAST(count(*) AS BIGINT) FROM segments UNION ALL SELECT 'label', 'NewsRiskEvent', CAST(count(*) AS BIGINT) FROM news
UNION ALL SELECT 'edge', 'SHIPS_FROM', CAST(count(*) AS BIGINT) FROM supplier WHERE s_suppkey NOT IN (SELECT supplier_id FROM suppliers_from) UNION ALL SELECT 'edge', 'FROM_NODE', CAST(count(*) AS BIGINT) FROM segments
UNION ALL SELECT 'edge', 'PASSES_THROUGH', CAST(count(*) AS BIGINT) FROM segments, unnest(string_split(zone_ids, '|')) AS u(z)""")
def backfill_counts(t: Net) -> DataFrame:
    """How many labels and edges a back-fill would write: rows that lack them."""
    count = lambda rows, kind, name: rows.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), F.lit(name).alias("name"), "n")
    kinds = t.locations.groupBy("kind").agg(F.count("*").alias("n")).select(F.lit("label").alias("kind"), F.col("kind").alias("name"), "n")
    lacking = t.supplier.join(t.suppliers_from, F.col("s_suppkey") == F.col("supplier_id"), "left_anti")
    passes = t.segments.select(F.explode(F.split("zone_ids", r"\|")))
    rows = [(t.locations, "label", "TransportLocation"), (t.segments, "label", "RouteSegment"), (t.news, "label", "NewsRiskEvent"), (lacking, "edge", "SHIPS_FROM"), (t.segments, "edge", "FROM_NODE"), (passes, "edge", "PASSES_THROUGH")]
    return united([kinds, *[count(*r) for r in rows]])


STORED = "(SELECT segment_id, string_agg(concat(factor, CASE WHEN score IS NULL THEN '-' ELSE '+' END, coalesce(provider, '')), ',' ORDER BY factor) AS h FROM factors GROUP BY segment_id)"


@operator(f"""SELECT s.segment_id, CASE WHEN s.n % 9 = 0 THEN 'write' WHEN s.n % 8 = 0 THEN 'write' WHEN s.provider IS NULL AND s.risk IS NOT NULL THEN 'write' ELSE 'skip' END AS action, substr(sha256(f.h), 1, 12) AS input_hash FROM segments s JOIN {STORED} f ON f.segment_id = s.segment_id""")
def risk_recalc_plan(t: Net) -> DataFrame:
    """Skipped if the digest of the inputs and the version are as stored and no forbidden field is left."""
    entry = F.concat("factor", F.when(F.col("score").isNull(), "-").otherwise("+"), F.coalesce("provider", F.lit("")))
    now = t.factors.groupBy("segment_id").agg(F.sha2(F.array_join(F.sort_array(F.collect_list(entry)), ","), 256).alias("hash"))
    s = t.segments.join(now, "segment_id")
    stored = s.withColumns({"old_hash": F.when(F.col("n") % 9 != 0, F.col("hash")), "version": F.when(F.col("n") % 8 == 0, "v1").otherwise("v2")})
    same = F.col("old_hash").eqNullSafe(F.col("hash")) & (F.col("version") == "v2") & ~(F.col("provider").isNull() & F.col("risk").isNotNull())
    return stored.select("segment_id", F.when(same, "skip").otherwise("write").alias("action"), F.substring("hash", 1, 12).alias("input_hash"))


@operator("SELECT segment_id, CAST(NULL AS DOUBLE) AS risk FROM segments WHERE provider IS NULL AND risk IS NOT NULL")
def risk_clear_plan(t: Net) -> DataFrame:
    return t.segments.filter("provider is null and risk is not null").select("segment_id", F.lit(None).cast("double").alias("risk"))


@operator("""WITH RECURSIVE e AS (SELECT DISTINCT from_id AS a, to_id AS b FROM segments WHERE provider IS NULL), r AS (SELECT location_id AS node FROM locations WHERE location_id % 12 = 5 UNION SELECT e.b FROM r JOIN e ON e.a = r.node WHERE e.b > 15)
SELECT segment_id FROM segments WHERE provider IS NULL AND data_status <> 'provider' AND from_id NOT IN (SELECT node FROM r) AND to_id NOT IN (SELECT node FROM r)""")
def deletion_plan(t: Net) -> DataFrame:
    """Unverified segments that no protected place reaches through other unverified ones."""
    loose = t.segments.filter("provider is null")
    edges = loose.filter("to_id > 15").select(F.col("from_id").alias("a"), F.col("to_id").alias("b")).distinct()
    blocked = closure(edges, t.locations.filter("location_id % 12 = 5").select(F.col("location_id").alias("node")))
    free = loose.filter("data_status <> 'provider'")
    for end in ("from_id", "to_id"):
        free = free.join(F.broadcast(blocked.select(F.col("node").alias(end))), end, "left_anti")
    return free.select("segment_id")


class ProtectedRowsLost(ValueError):
    """A write would have lost rows that are protected."""


def guarded(before: DataFrame, after: DataFrame, group: str, protected: list[str]) -> DataFrame:
    """(group, before_n, after_n, ok): whether a staged table keeps as many rows of each protected group."""
    count = lambda rows, name: rows.groupBy(group).agg(F.count("*").alias(name))
    both = count(before, "before_n").join(count(after, "after_n"), group, "left").withColumn("after_n", F.coalesce("after_n", F.lit(0)))
    return both.withColumn("ok", ~F.col(group).isin(*protected) | (F.col("after_n") >= F.col("before_n")))


def guarded_swap(before: DataFrame, after: DataFrame, group: str, protected: list[str]) -> DataFrame:
    """``after``, if the guard holds; else nothing changes and :class:`ProtectedRowsLost` says what would be lost."""
    lost = [r[group] for r in guarded(before, after, group, protected).filter("not ok").select(group).collect()]  # protected names only
    if lost:
        raise ProtectedRowsLost(f"fewer rows of {sorted(lost)}")
    return after


@operator("""SELECT kind, CAST(count(*) AS BIGINT) AS before_n, CAST(count(CASE WHEN location_id <> 3 THEN 1 END) AS BIGINT) AS after_n, NOT (kind = 'Port') AS ok FROM locations GROUP BY kind""")
def protected_counts(t: Net) -> DataFrame:
    return guarded(t.locations, t.locations.filter("location_id <> 3"), "kind", ["Port", "Airport"])


@operator(f"""WITH p AS (SELECT s.segment_id AS k, round(km, 1) AS v FROM segments s JOIN (SELECT DISTINCT a.location_id AS a, b.location_id AS b, {haversine_sql('a', 'b')} AS km FROM segments x JOIN locations a ON x.from_id = a.location_id JOIN locations b ON x.to_id = b.location_id) d ON d.a = s.from_id AND d.b = s.to_id),
h AS (SELECT p.k, p.v + CASE WHEN n % 5 = 1 THEN 1 ELSE 0 END AS v, n % 6 <> 2 AS active, n FROM p JOIN segments s ON s.segment_id = p.k WHERE n % 7 <> 3)
SELECT p.k AS segment_id, CASE WHEN h.k IS NULL THEN 'insert' ELSE 'update' END AS action FROM p LEFT JOIN h ON h.k = p.k WHERE p.k NOT LIKE 'S3-%' AND (h.k IS NULL OR h.v <> p.v OR NOT h.active)
UNION ALL SELECT k, 'deactivate' FROM h WHERE k LIKE 'S3-%' AND active""")
def geo_plan(t: Net) -> DataFrame:
    """What brings the stored distances to those of the present coordinates."""
    km = pairs(t).select(F.col("a").alias("from_id"), F.col("b").alias("to_id"), F.round(haversine(*ends()), 1).alias("v"))
    every = t.segments.join(km, ["from_id", "to_id"]).withColumn("k", F.col("segment_id"))
    stored = every.filter("n % 7 <> 3").select("k", (F.col("v") + F.when(F.col("n") % 5 == 1, 1.0).otherwise(0.0)).alias("v"), (F.col("n") % 6 != 2).alias("active"))
    return reconciled(stored, every.filter("from_id <> 3").select("k", "v"), "k", "v").withColumnRenamed("k", "segment_id")


@operator("""SELECT s.segment_id, concat('V2-', upper(a.name)) AS new_from, concat('V2-', upper(b.name)) AS new_to FROM segments s JOIN locations a ON s.from_id = a.location_id JOIN locations b ON s.to_id = b.location_id WHERE s.mode = 'air'""".replace("upper(a.name)", "replace(upper(a.name), '_', '-')").replace("upper(b.name)", "replace(upper(b.name), '_', '-')"))
def location_id_plan(t: Net) -> DataFrame:
    """References of segments after all location ids have changed: the mapping is joined, so no id is in between."""
    mapping = t.locations.select("location_id", F.concat(F.lit("V2-"), compact(F.col("name"))).alias("new_id"))
    end = lambda c, name: F.broadcast(mapping.select(F.col("location_id").alias(c), F.col("new_id").alias(name)))
    return t.segments.filter("mode = 'air'").join(end("from_id", "new_from"), "from_id").join(end("to_id", "new_to"), "to_id").select("segment_id", "new_from", "new_to")


@operator("""SELECT CAST(sum(CASE WHEN location_id % 3 = 0 OR (location_id % 3 = 1 AND location_id < 20) THEN 1 ELSE 0 END) AS BIGINT) AS resolvable, CAST(sum(CASE WHEN location_id % 3 = 0 OR (location_id % 3 = 1 AND location_id < 20) THEN 0 ELSE 1 END) AS BIGINT) AS unresolved,
  CAST(sum(CASE WHEN location_id % 3 = 1 AND location_id < 20 THEN 1 ELSE 0 END) AS BIGINT) AS changed FROM locations""")
def country_plan(t: Net) -> DataFrame:
    """How many country fields resolve, and how many of them change to a code."""
    from tideway.functions.scalars import country_resolve

    found = country_resolve(t)
    return found.agg(F.count("country").alias("resolvable"), F.count_if(F.col("country").isNull()).alias("unresolved"), F.count_if(F.col("method") == "alias").alias("changed"))


@operator(f"""SELECT s.segment_id FROM segments s JOIN locations a ON s.from_id = a.location_id JOIN locations b ON s.to_id = b.location_id WHERE s.data_status <> 'provider' AND NOT CASE s.mode WHEN 'sea' THEN a.kind = 'Port' AND b.kind = 'Port' WHEN 'air' THEN a.kind = 'Airport' AND b.kind = 'Airport'
  WHEN 'rail' THEN a.region = b.region AND 1.18e0 * {haversine_sql('a', 'b')} <= 12000 ELSE a.region = b.region AND {haversine_sql('a', 'b')} <= 5000 END""")
def infeasible_routes(t: Net) -> DataFrame:
    """Inferred segments whose mode can't join their ends."""
    feasible = mode_feasibility(t).filter("status = 'feasible'").select(F.col("a").alias("from_id"), F.col("b").alias("to_id"), "mode")
    return t.segments.filter("data_status <> 'provider'").join(feasible, ["from_id", "to_id", "mode"], "left_anti").select("segment_id")


@operator(f"""SELECT segment_id, CASE WHEN blind THEN 'unavailable' WHEN mode IN ('road', 'rail') AND NOT same AND km > 1000 THEN 'invalid_cross_ocean' WHEN mode = 'sea' AND NOT ports THEN 'invalid_endpoint' WHEN zone_ids IS NULL THEN 'inferred' ELSE 'valid' END AS status,
  CASE WHEN blind THEN 'missing_coordinates' WHEN mode IN ('road', 'rail') AND NOT same AND km > 1000 THEN 'no_land_way' WHEN mode = 'sea' AND NOT ports THEN 'not_a_port' WHEN zone_ids IS NULL THEN 'great_circle' ELSE 'geometry' END AS reason FROM
 (SELECT s.segment_id, s.mode, s.zone_ids, a.lat = -60 OR b.lat = -60 AS blind, a.region = b.region AS same, a.kind = 'Port' AND b.kind = 'Port' AS ports, {haversine_sql('a', 'b')} AS km FROM segments s JOIN locations a ON s.from_id = a.location_id JOIN locations b ON s.to_id = b.location_id) x""")
def geometry_status(t: Net) -> DataFrame:
    """The first rule that applies gives a segment's status and its reason."""
    rows = t.segments.join(pairs(t).withColumnsRenamed({"a": "from_id", "b": "to_id"}), ["from_id", "to_id"])
    rows = rows.join(named(t, "from", "region", "kind"), "from_id").join(named(t, "to", "region", "kind"), "to_id")
    over_sea = F.col("mode").isin("road", "rail") & (F.col("from_region") != F.col("to_region")) & (haversine(*ends()) > 1000)
    rules = [
        ((F.col("lat1") == -60) | (F.col("lat2") == -60), "unavailable", "missing_coordinates"),
        (over_sea, "invalid_cross_ocean", "no_land_way"),
        ((F.col("mode") == "sea") & ~((F.col("from_kind") == "Port") & (F.col("to_kind") == "Port")), "invalid_endpoint", "not_a_port"),
        (F.col("zone_ids").isNull(), "inferred", "great_circle"),
        (F.lit(True), "valid", "geometry"),
    ]
    pick = F.coalesce(*[F.when(c, F.struct(F.lit(s).alias("status"), F.lit(r).alias("reason"))) for c, s, r in rules])
    return rows.select("segment_id", pick.alias("x")).select("segment_id", "x.status", "x.reason")


def fingerprints(plan: DataFrame, group: str, key: str) -> DataFrame:
    """(group, n, fingerprint): a digest of each group's set of ids, by which a dry run and its execution are compared.

    Ids are dealt to 4096 buckets by their own digest; a bucket's sorted ids make its digest, and the digests of the
    buckets in order make the group's.  No task holds more than a bucket.
    """
    rows = plan.select(group, F.sha2(F.col(key).cast("string"), 256).alias("d"))
    buckets = rows.groupBy(group, F.substring("d", 1, 3).alias("b")).agg(F.count("*").alias("n"), F.sha2(F.array_join(F.sort_array(F.collect_list("d")), ","), 256).alias("h"))
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("b", "h"))), lambda x: x["h"]), ",")
    return buckets.groupBy(group).agg(F.sum("n").alias("n"), F.sha2(whole, 256).alias("fingerprint"))


@operator("""WITH d AS (SELECT CASE WHEN n % 2 = 0 THEN 'write' ELSE 'skip' END AS action, sha256(segment_id) AS h FROM segments),
b AS (SELECT action, substr(h, 1, 3) AS b, count(*) AS n, sha256(string_agg(h, ',' ORDER BY h)) AS h FROM d GROUP BY action, substr(h, 1, 3))
SELECT action, CAST(sum(n) AS BIGINT) AS n, sha256(string_agg(h, ',' ORDER BY b)) AS fingerprint FROM b GROUP BY action""")
def plan_fingerprint(t: Net) -> DataFrame:
    return fingerprints(t.segments.select("segment_id", F.when(F.col("n") % 2 == 0, "write").otherwise("skip").alias("action")), "action", "segment_id")


@operator("""SELECT CAST(sum(CASE WHEN demo THEN 1 ELSE 0 END) AS BIGINT) AS excluded, CAST(sum(CASE WHEN demo THEN 0 ELSE 1 END) AS BIGINT) AS kept, CAST(count(DISTINCT CASE WHEN demo THEN mmsi END) AS BIGINT) AS vessels
FROM (SELECT mmsi, strpos(concat('MV ', CAST(mmsi AS STRING)), '13') > 0 OR event_type = 'error' AS demo FROM vessel_obs) x""")
def demo_exclusion(t: Net) -> DataFrame:
    """Observations that a name, call sign or source marks as a demo's are counted out."""
    text = F.lower(F.concat_ws(" ", F.concat(F.lit("MV "), F.col("mmsi").cast("string")), F.when(F.col("event_type") == "error", "demo")))
    demo = F.exists(F.array(F.lit("13"), F.lit("demo")), lambda m: text.contains(m))
    rows = t.vessel_obs.select("mmsi", demo.alias("demo"))
    return rows.agg(F.count_if("demo").alias("excluded"), F.count_if(~F.col("demo")).alias("kept"), F.count_distinct(F.when(F.col("demo"), F.col("mmsi"))).alias("vessels"))
