"""File sources and sinks: JSON, YAML, CSV, zipped TSV, shapefiles, documents, jobs, evidence, backups (section A)."""

from __future__ import annotations

import io
import json
import re
import struct
import zipfile
from collections.abc import Iterator
from dataclasses import asdict, is_dataclass
from datetime import date, datetime, timezone

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideway.functions.scalars import redacted
from tideway.sources.tables import Net, operator
from tideway.streaming.ais import shared_folder

#: The fields of a line of the gazetteer.
GAZETTEER = (
    "geonameid name asciiname alternatenames latitude longitude feature_class feature_code country_code cc2 admin1 admin2 admin3 admin4 population elevation dem timezone modified"
).split()


def parameterised(spark: SparkSession, sql: str, **values: object) -> DataFrame:
    """A query with named markers (``:name``); values never become part of its text."""
    return spark.sql(sql, args=values)


WRITES = re.compile(r"\b(create|merge|insert|update|delete|drop|alter|truncate|set|remove|call)\b", re.IGNORECASE)


def read_only(sql: str) -> str:
    """The text if it only reads, else ValueError; words in quotes don't count."""
    bare = re.sub(r"'(?:[^']|'')*'|\"[^\"]*\"|`[^`]*`|--[^\n]*|/\*.*?\*/", " ", sql, flags=re.DOTALL)
    if not re.match(r"\s*(select|with|values)\b", bare, re.IGNORECASE) or WRITES.search(bare) or ";" in bare.rstrip().rstrip(";"):
        raise ValueError("only a single query that reads is allowed")
    return sql


def to_jsonable(value: object) -> object:
    """Plain JSON values of rows, dataclasses, times and bytes, at any depth; a time without a zone is UTC."""
    if isinstance(value, datetime):
        return (value if value.tzinfo else value.replace(tzinfo=timezone.utc)).isoformat()
    if isinstance(value, date):
        return value.isoformat()
    if is_dataclass(value) and not isinstance(value, type):
        return to_jsonable(asdict(value))
    if hasattr(value, "asDict"):
        return to_jsonable(value.asDict(recursive=True))
    if isinstance(value, dict):
        return {str(k): to_jsonable(v) for k, v in value.items()}
    if isinstance(value, (list, tuple, set, frozenset)):
        return [to_jsonable(v) for v in (sorted(value, key=str) if isinstance(value, (set, frozenset)) else value)]
    return value.hex() if isinstance(value, (bytes, bytearray)) else value


def json_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON files of one document or a list of them each, with a fixed schema; text that doesn't read fails."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def csv_rows(spark: SparkSession, path: str, schema: str, key: list[str] | None = None) -> DataFrame:
    """CSV files with a header; with ``key`` also a column ``key`` of these joined, and rows without it left out."""
    rows = spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return rows if key is None else rows.withColumn("key", F.concat(*key)).filter(F.col("key").isNotNull())


def load_config(text: str) -> dict:
    """A configuration document: YAML where PyYAML is there, JSON else."""
    try:
        import yaml
    except ImportError:
        return json.loads(text)
    return yaml.safe_load(text)


def save_config(config: dict) -> str:
    """The document's text; JSON is YAML as well."""
    return json.dumps(config, indent=2, sort_keys=True, ensure_ascii=False) + "\n"


def strategy(config: dict) -> dict:
    """A strategy document whose groups of weights add up to 1 (within 0.001), else ValueError."""
    for name, group in config.items():
        if isinstance(group, dict) and group and abs(sum(group.values()) - 1) > 1e-3:
            raise ValueError(f"the weights of {name} add up to {sum(group.values())}")
    return config


def zipped_lines(spark: SparkSession, path: str, member: str) -> DataFrame:
    """(line) of a text file inside each zip file of a path, unpacked in Arrow batches as it is read."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column("content").to_pylist():
                with zipfile.ZipFile(io.BytesIO(content)) as z, z.open(member) as f:
                    lines: list[str] = []
                    for line in io.TextIOWrapper(f, "utf-8", newline="\n"):
                        lines.append(line.rstrip("\r\n"))
                        if len(lines) == 10_000:
                            yield pa.RecordBatch.from_pydict({"line": lines})
                            lines = []
                    yield pa.RecordBatch.from_pydict({"line": pa.array(lines, pa.string())})

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(unpack, "line string")


def gazetteer(lines: DataFrame) -> DataFrame:
    """(alias, country, id, lat, lng): places by every name, in lower case, with their country and without (null).

    Lines of fewer than 19 fields are left out.  Of places with one name the most populous is the entry, then the least id.
    """
    fields = F.split("line", "\t")
    get = lambda name: F.get("f", F.lit(GAZETTEER.index(name)))
    rows = lines.select(fields.alias("f")).filter(F.size("f") >= len(GAZETTEER))
    names = F.concat(F.array(get("name"), get("asciiname")), F.split(get("alternatenames"), ","))
    aliases = F.array_distinct(F.transform(F.filter(names, lambda n: F.trim(n) != ""), lambda n: F.lower(F.trim(n))))
    place = F.struct((-F.coalesce(get("population").try_cast("long"), F.lit(0))).alias("p"), get("geonameid").cast("long").alias("id"), get("latitude").cast("double").alias("lat"), get("longitude").cast("double").alias("lng"))
    each = rows.select(F.explode(aliases).alias("alias"), F.array(get("country_code"), F.lit(None).cast("string")).alias("c"), place.alias("place"))
    each = each.select("alias", F.explode("c").alias("country"), "place")
    return each.groupBy("alias", "country").agg(F.min("place").alias("m")).select("alias", "country", "m.id", "m.lat", "m.lng")


def shapefile_rows(shp: bytes, dbf: bytes) -> list[tuple[dict[str, str], list[list[tuple[float, float]]]]]:
    """(attributes, parts of (lng, lat)) of each shape: points, lines and polygons; other kinds and broken lengths raise."""
    if len(shp) < 100 or struct.unpack(">i", shp[:4])[0] != 9994:
        raise ValueError("not a shapefile")
    shapes, at = [], 100
    while at < len(shp):
        size = 2 * struct.unpack(">i", shp[at + 4 : at + 8])[0]
        body = shp[at + 8 : at + 8 + size]
        if len(body) != size or size < 4:
            raise ValueError("a record's length doesn't fit")
        kind = struct.unpack("<i", body[:4])[0]
        if kind == 0:
            shapes.append([])
        elif kind == 1:
            shapes.append([[struct.unpack("<2d", body[4:20])]])
        elif kind in (3, 5):
            n_parts, n = struct.unpack("<2i", body[36:44])
            starts = [*struct.unpack(f"<{n_parts}i", body[44 : 44 + 4 * n_parts]), n]
            flat = struct.unpack(f"<{2 * n}d", body[44 + 4 * n_parts : 44 + 4 * n_parts + 16 * n])
            points = list(zip(flat[::2], flat[1::2], strict=True))
            shapes.append([points[a:b] for a, b in zip(starts, starts[1:], strict=False)])
        else:
            raise ValueError(f"shapes of kind {kind} aren't read")
        at += 8 + size
    count, head, width = struct.unpack("<IHH", dbf[4:12])
    fields, at = [], 32
    while dbf[at : at + 1] != b"\r":
        fields.append((dbf[at : at + 11].split(b"\0")[0].decode(), dbf[at + 16]))
        at += 32
    rows = []
    for k in range(count):
        place, row = head + k * width + 1, {}
        for name, length in fields:
            row[name] = dbf[place : place + length].decode(errors="replace").strip()
            place += length
        rows.append(row)
    if len(rows) != len(shapes):
        raise ValueError("as many shapes as rows are needed")
    return list(zip(rows, shapes, strict=True))


def shapes(spark: SparkSession, path: str) -> DataFrame:
    """(name, attributes, parts) of the shapes of ``path``.shp and .dbf, as reference data of a size that one task reads."""
    binary = lambda end: spark.read.format("binaryFile").load(f"{path}.{end}").select(F.col("content").alias(end))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shp, dbf in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found = shapefile_rows(shp, dbf)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([list(a.items()) for a, _ in found], pa.map_(pa.string(), pa.string())),
                        pa.array([[[{"lng": x, "lat": y} for x, y in part] for part in parts] for _, parts in found], pa.list_(pa.list_(pa.struct([("lng", pa.float64()), ("lat", pa.float64())])))),
                    ],
                    ["attributes", "parts"],
                )

    both = binary("shp").join(F.broadcast(binary("dbf")))
    return both.mapInArrow(read, "attributes map<string,string>, parts array<array<struct<lng:double,lat:double>>>")


def appended(existing: DataFrame | None, rows: DataFrame, key: list[str]) -> DataFrame:
    """An append-only table after a write: rows whose key is there already aren't added again."""
    return rows if existing is None else existing.unionByName(rows.join(existing.select(*key), key, "left_anti"))


def job(job_id: Column, status: str, at: Column, detail: Column | None = None) -> list[Column]:
    """Columns of a row of the job log."""
    return [job_id.alias("job_id"), F.lit(status).alias("status"), at.alias("at"), (detail if detail is not None else F.lit(None).cast("string")).alias("detail")]


def jobs(log: DataFrame) -> DataFrame:
    """A row for each job of an append-only log: start, end, last status; a job without an end is running."""
    started, ended = F.min(F.when(F.col("status") == "started", F.col("at"))), F.max(F.when(F.col("status") != "started", F.struct("at", "status", "detail")))
    found = log.groupBy("job_id").agg(started.alias("started_at"), ended.alias("e"))
    return found.select("job_id", "started_at", F.col("e.at").alias("ended_at"), F.coalesce("e.status", F.lit("running")).alias("status"), "e.detail")


def with_evidence(evidence: DataFrame, entities: DataFrame, id_columns: list[str], ref: str) -> DataFrame:
    """Evidence with the entity that any of its ids names, if there is one."""
    ids = entities.select(F.col(id_columns[0]).alias("entity_id"), F.explode(F.array_distinct(F.array_compact(F.array(*[F.col(c).cast("string") for c in id_columns])))).alias(ref))
    owner = ids.groupBy(ref).agg(F.min("entity_id").alias("entity_id"))
    return evidence.join(owner, ref, "left")


#: Providers that are named but not connected.
DISABLED = ("acled", "emdat", "gdacs", "imf_portwatch", "marinetraffic", "noaa", "unctad", "usgs", "worldbank")


def disabled_providers(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(p, "disabled", "no credentials") for p in DISABLED], "provider string, status string, reason string")


def backup(rows: DataFrame, path: str, properties: str = "properties") -> DataFrame:
    """The rows that a deletion will touch, written as JSON with their secrets redacted; returns them as read back."""
    rows.withColumn(properties, redacted(F.col(properties))).write.json(path)
    return rows.sparkSession.read.schema(rows.schema).json(path)


def report(rows: DataFrame, title: str) -> str:
    """A small table as Markdown: a report's rows are checks or metrics, whose number the code fixes."""
    found = rows.collect()
    lines = [f"# {title}", "", "| " + " | ".join(rows.columns) + " |", "|" + "-|" * len(rows.columns)]
    return "\n".join([*lines, *("| " + " | ".join("" if x is None else str(x) for x in r) + " |" for r in found), ""])


class Cached:
    """A table kept in memory for reuse until it is closed, as a route network between requests."""

    def __init__(self, df: DataFrame):
        self.df = df.persist()

    def __enter__(self) -> DataFrame:
        return self.df

    def __exit__(self, *_: object) -> None:
        self.df.unpersist()


@operator("SELECT concat('N', CAST(n_nationkey AS STRING), n_name) AS key, n_name AS name, CAST(n_regionkey AS INT) AS region, concat('say \"hi\", ', n_name) AS remark FROM nation WHERE n_nationkey <> 5")
def src_csv(t: Net) -> DataFrame:
    """A CSV file with quotes, commas and a row without a key, written and read back."""
    path = shared_folder(t, "csv")
    country = F.when(F.col("n_nationkey") != 5, F.concat(F.lit("N"), F.col("n_nationkey").cast("string")))
    rows = t.nation.select(country.alias("country"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"), F.concat(F.lit('say "hi", '), "n_name").alias("remark"))
    rows.write.option("header", True).option("escape", '"').csv(path)
    return csv_rows(t.spark, path, "country string, name string, region int, remark string", ["country", "name"]).select("key", "name", "region", "remark")


@operator("SELECT target_id, south, north, reference_count, CAST(CASE WHEN port_ids IS NULL THEN 0 ELSE len(string_split(port_ids, '|')) END AS INT) AS ports FROM targets")
def src_json_dim(t: Net) -> DataFrame:
    """Targets as JSON documents with nested boxes and lists, written and read back."""
    path = shared_folder(t, "json")
    t.targets.select("target_id", F.struct("south", "north", "west", "east").alias("box"), "reference_count", F.split("port_ids", r"\|").alias("ports")).write.json(path)
    found = json_documents(t.spark, path, "target_id string, box struct<south:double,north:double,west:double,east:double>, reference_count int, ports array<string>")
    return found.select("target_id", "box.south", "box.north", "reference_count", F.when(F.col("ports").isNull(), 0).otherwise(F.size("ports")).alias("ports"))


@operator("""WITH p AS (SELECT p_partkey AS id, p_name AS name, string_split(p_name, ' ')[1] AS a, string_split(p_name, ' ')[2] AS b, concat('C', CAST(p_size % 3 AS STRING)) AS country, CAST(p_size AS INT) AS pop FROM part),
e AS (SELECT DISTINCT id, pop, country, lower(alias) AS alias FROM (SELECT *, name AS alias FROM p UNION ALL SELECT *, a FROM p UNION ALL SELECT *, b FROM p) x WHERE id % 17 <> 0),
c AS (SELECT id, pop, alias, country FROM e UNION ALL SELECT id, pop, alias, NULL FROM e)
SELECT alias, country, id FROM (SELECT *, row_number() OVER (PARTITION BY alias, country ORDER BY pop DESC, id) AS r FROM c) y WHERE r = 1""")
def gazetteer_index(t: Net) -> DataFrame:
    """A zipped gazetteer of the parts, of which some lines are short, unpacked and indexed by every name."""
    path = shared_folder(t, "gazetteer")
    word = lambda k: F.split("p_name", " ")[k]
    blank = lambda n: [F.lit("")] * n
    cells = [F.col("p_partkey").cast("string"), F.col("p_name"), word(0), F.concat_ws(",", word(1), F.upper(word(0))), F.lit("1.5"), F.lit("2.5"), F.lit("P"), F.lit("PPL"), F.concat(F.lit("C"), (F.col("p_size") % 3).cast("string")), *blank(5), F.col("p_size").cast("string"), *blank(4)]
    line = F.when(F.col("p_partkey") % 17 == 0, F.concat_ws("\t", *cells[:9])).otherwise(F.concat_ws("\t", *cells))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = io.BytesIO()
            with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
                z.writestr("places.txt", "\n".join(b.column(0).to_pylist()) + "\n")
            yield pa.RecordBatch.from_pydict({"content": [out.getvalue()]})

    # Each batch is a zip file of its own; a table of them stands for the folder that a download fills.
    t.part.select(line.alias("line")).mapInArrow(pack, "content binary").write.parquet(path)
    packed = t.spark.read.schema("content binary").parquet(path)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0).to_pylist():
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    yield pa.RecordBatch.from_pydict({"line": z.read("places.txt").decode().split("\n")[:-1]})

    return gazetteer(packed.mapInArrow(unpack, "line string")).select("alias", "country", "id")


@operator("""SELECT concat('J', CAST(o_orderkey % 50 AS STRING)) AS job_id, min(CASE WHEN o_orderstatus <> 'F' THEN CAST(o_orderdate AS DATE) END) AS started_at, max(CASE WHEN o_orderstatus = 'F' THEN CAST(o_orderdate AS DATE) END) AS ended_at,
  CASE WHEN count(CASE WHEN o_orderstatus = 'F' THEN 1 END) > 0 THEN 'done' ELSE 'running' END AS status FROM orders WHERE o_orderkey < 150 GROUP BY o_orderkey % 50""")
def job_lifecycle(t: Net) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "done").otherwise("started")
    some = t.orders.filter("o_orderkey < 150")
    log = some.select(F.concat(F.lit("J"), (F.col("o_orderkey") % 50).cast("string")).alias("job_id"), status.alias("status"), F.col("o_orderdate").cast("date").alias("at"), F.lit("").alias("detail"))
    return jobs(log).select("job_id", "started_at", "ended_at", "status")


@operator("""SELECT d.doc_id, l.location_id FROM documents d LEFT JOIN locations l ON (d.doc_id % 3 = 0 AND l.code = concat('LOC-', CAST(d.doc_id % 40 AS STRING))) OR (d.doc_id % 3 = 1 AND l.name = concat('NATION_', CAST(d.doc_id % 40 AS STRING)))""")
def evidence_attach(t: Net) -> DataFrame:
    """Documents as evidence, linked to a place by whichever of its ids they name."""
    k = (F.col("doc_id") % 40).cast("string")
    ref = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("LOC-"), k)).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("NATION_"), k)).otherwise("?")
    found = with_evidence(t.documents.select("doc_id", ref.alias("ref")), t.locations, ["location_id", "code", "name"], "ref")
    return found.select("doc_id", F.col("entity_id").alias("location_id"))
