"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

A key's place on the ring is its hash; the virtual node that owns the place names its shard.  A shard has a capacity;
keys that find it full go on clockwise to the next virtual nodes until a shard has room.  Capacities add up to the
rows (slack 0) or exceed them by a share, so balance holds whatever the keys are.

The ring is cut into CELLS equal cells and virtual nodes stand on cell edges, so an arc is a run of cells.  Two counts
settle everything: keys by cell (a table of CELLS rows at most) and keys by arc (shards x virtual nodes rows).  The
walk of overflowing keys happens on the arc counts, as SQL on that small table; every row then finds its shard from
its rank in its arc.  A hot key holds many ranks, and ranks are handed out, so it spreads over shards by itself: rows
are first counted by (key, size, checksum), which is what crosses the network.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideway.llm.common import table, utf8, written

CELLS = 1 << 16
#: Rows of a key that are numbered at a time.
STEP = 10_000
VIRTUAL = 64


def ring_plan(arcs: list[tuple[int, int, int]], capacity: list[int]) -> list[tuple[int, int, int, int, int]]:
    """Who takes which ranks: (arc, shard, first rank, end rank, first slot), from (arc, shard, keys) in ring order.

    Keys move in rounds: in round r each arc's unplaced keys ask the shard of the arc r places clockwise, arcs in ring
    order, and a shard takes as many as it has room for.  That is bounded-load placement for the insertion order in
    which keys that go less far come first.  Works on counts of arcs only, never on keys.
    """
    left = [n for _, _, n in arcs]
    used = [0] * len(capacity)
    out: list[tuple[int, int, int, int, int]] = []
    r = 0
    open_arcs = [i for i, n in enumerate(left) if n]
    while open_arcs and r < len(arcs):
        for i in open_arcs:
            shard = arcs[(i + r) % len(arcs)][1]
            if take := min(left[i], capacity[shard] - used[shard]):
                first = arcs[i][2] - left[i]
                out.append((arcs[i][0], shard, first, first + take, used[shard]))
                used[shard] += take
                left[i] -= take
        open_arcs = [i for i in open_arcs if left[i]]
        r += 1
    return out


def shard_by_ring(docs: DataFrame, shards: int = 16, slack: float = 0.0, virtual: int = VIRTUAL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: id, size (UTF-8 bytes + 1), text_crc32, law, shard, slot, grown_shard (null: law is not key).

    With ``slack`` 0 the law is ``rows``: shard counts differ by one at most.  With more, a shard takes up to
    (1 + slack) times the mean and fewer keys move when a shard joins.  Slots are gapless from 0 in each shard.
    Null text has size 1 and checksum 0.  Null ids are one key.  Repeated rows are one key with many ranks and may fall
    into several shards.  An empty table gives an empty result.  Other columns are not read.
    """
    spark = docs.sparkSession
    cell = F.shiftrightunsigned(F.xxhash64(F.col("id")), 48).cast("int")
    ids = docs.select(F.col(id_col).cast("long").alias("id"))

    nodes = spark.range(shards * virtual).select(F.floor(F.col("id") / virtual).cast("int").alias("shard"), F.shiftrightunsigned(F.xxhash64(F.lit("virtual node"), F.floor(F.col("id") / virtual), F.col("id") % virtual), 48).cast("int").alias("at"))
    nodes = nodes.groupBy("at").agg(F.min("shard").alias("shard"))  # two nodes on one edge: the lower shard holds it
    w = Window.orderBy("at")
    nodes = nodes.select("at", "shard", F.lag("at").over(w).alias("before"))
    # A cell belongs to the first node at or after it; cells after the last node belong to the first one.
    top = nodes.agg(F.max("at")).first()[0]
    arcs = nodes.select("shard", "at", F.explode(F.sequence(F.coalesce(F.col("before") + 1, F.lit(0)), F.col("at"))).alias("cell"))
    first = nodes.orderBy("at").first()
    if top < CELLS - 1:
        arcs = arcs.union(spark.range(top + 1, CELLS).select(F.lit(first["shard"]).alias("shard"), F.lit(first["at"]).alias("at"), F.col("id").cast("int").alias("cell")))

    counted = ids.groupBy(cell.alias("cell")).agg(F.count("*").alias("n"))
    in_arc = Window.partitionBy("at").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = arcs.join(counted, "cell").select("cell", "at", "shard", "n", F.coalesce(F.sum("n").over(in_arc), F.lit(0)).alias("base"))
    cells = written(cells, "cells")  # CELLS rows at most
    by_arc = [tuple(r) for r in cells.groupBy("at").agg(F.min("shard").alias("shard"), F.sum("n").alias("n")).orderBy("at").select("at", "shard", "n").collect()]
    every = [tuple(r) for r in nodes.orderBy("at").select("at", "shard").collect()]
    found = {at: n for at, _, n in by_arc}
    rows = sum(found.values())
    if slack:
        capacity = [int(-(-rows * (1 + slack) // shards))] * shards
    else:
        capacity = [rows // shards + (s < rows % shards) for s in range(shards)]
    plan = ring_plan([(at, s, found.get(at, 0)) for at, s in every], capacity)
    # At most shards x virtual arcs and one more interval for each time a shard fills up: a fixed bound.
    plan_df = spark.createDataFrame(plan or [(-1, 0, 0, 0, 0)], "at int, shard int, lo long, hi long, slot0 long")
    by_at = plan_df.groupBy("at").agg(F.array_sort(F.collect_list(F.struct("lo", "hi", "shard", "slot0"))).alias("spans"))

    body = utf8(text_col)
    keyed = (
        docs.select(F.col(id_col).cast("long").alias("id"), (F.octet_length(body) + F.lit(1)).cast("long").alias("size"), F.crc32(body).alias("crc"))
        .groupBy("id", "size", "crc")
        .agg(F.count("*").alias("n"))
    )
    ranked = keyed.withColumn("cell", cell).withColumn("up_to", F.sum("n").over(Window.partitionBy("cell").orderBy("id", "size", "crc").rowsBetween(Window.unboundedPreceding, 0)))
    placed = ranked.join(F.broadcast(cells.select("cell", "at", "base")), "cell").join(F.broadcast(by_at), "at")
    begin, last = F.col("base") + F.col("up_to") - F.col("n"), F.col("base") + F.col("up_to") - 1
    # In two steps, so that a key with very many rows never becomes one long array.
    steps = placed.select("id", "size", "crc", "spans", last.alias("last"), F.explode(F.sequence(begin, last, F.lit(STEP))).alias("at"))
    one = steps.select("id", "size", "crc", "spans", F.explode(F.sequence("at", F.least(F.col("at") + STEP - 1, "last"))).alias("rank"))
    one = one.withColumn("span", F.filter("spans", lambda s: (s["lo"] <= F.col("rank")) & (F.col("rank") < s["hi"]))[0])
    return one.select(
        F.col("id").alias(id_col),
        "size",
        F.col("crc").alias("text_crc32"),
        F.lit("near" if slack else "rows").alias("law"),
        F.col("span.shard").alias("shard"),
        (F.col("span.slot0") + F.col("rank") - F.col("span.lo")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op2_ring_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_ring(table(spark, sf_dir, "documents"))
