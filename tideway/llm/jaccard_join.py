"""N-gram Jaccard join: a grouped prefix join over word shingles, and the components that its links make.

A document is the set of its five-word shingles.  In any fixed order of shingles, two sets with similarity of 0.8 or
more share one among their first ``n - ceil(0.8 n) + 1`` (the prefix).  The order here: shingles by hash, but heavy
ones (found in many documents) last, from the least to the most heavy.  Any order gives the same links, so the list of
heavy shingles may be bounded; it only keeps passages that many documents share out of the prefixes.

Steps: documents with identical prefix and size become one group; prefixes meet by shingle and give group pairs;
groups expand to members (one for each distinct text) and members are verified on their whole sets.  Components need
one link, not all pairs: every group is first verified against its likeliest partners, linked texts become a component,
and only then texts that still lie in different components, of one group or of two, meet again by shingle, dealt to blocks, and are compared on
whole texts, block by block, all of them.  So a large group of copies costs as many comparisons as it has members, no
link between different components is lost, and no pair of texts is ever a row unless it is a link or a first try.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideway.llm.common import dropped, joined_small, released, runs, small_batches, table, utf8, written
from tideway.llm.components import components
from tideway.llm.shingles import shingle_sets

SHINGLE = 5
#: A shingle counts as heavy from so many documents on (counted in tasks that saw it in LOCAL documents at least);
#: at most HEAVY_LIST of them, the heaviest, are put last in the order.  12 bytes each are broadcast.
HEAVY, LOCAL, HEAVY_LIST = 12, 3, 1 << 20
#: Shingles that a task counts before it tells their numbers.
COUNTED = 3_000_000
#: Prefix shingles in one bucket of the meeting step, on average, and texts in one block of a comparison.
BUCKET, MEMBERS = 400_000, 128
BROADCAST_ROWS = 400_000
#: The first tries are verified in so many rounds, dealt by meeting place: only one round's texts lie in a shuffle at a time.
ROUNDS = 4
#: Shingles in one block of texts, and columns of one matrix product.
BLOCK_SHINGLES, COLUMNS = 400_000, 4096


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets have a Jaccard similarity of 0.8 or more."""
    if not len(a) or not len(b):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= 80 * (len(a) + len(b) - both)


def heavy_shingles(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(heavy shingles sorted, their ranks by count) from all documents' whole texts (column body)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, held, size = set(), [], 0

        def told() -> pa.RecordBatch:
            found, n = np.unique(np.concatenate(held), return_counts=True)
            keep = n >= LOCAL
            return pa.RecordBatch.from_arrays([pa.array(found[keep].view(np.int64)), pa.array(n[keep].astype(np.int64))], ["shingle", "n"])

        for b in batches:
            bodies = b.column(0).to_pylist()
            for at, end in runs(bodies):
                texts = []
                for t in bodies[at:end]:
                    t = t.lower()
                    if (key := blake2b(t, digest_size=8).digest()) not in seen:
                        seen.add(key)
                        texts.append(t)
                for s in shingle_sets(texts, SHINGLE):
                    held.append(s)
                    size += len(s)
                if size > COUNTED:
                    yield told()
                    seen, held, size = set(), [], 0
        if held:
            yield told()
        held = []
        released()

    counts = rows.select("body").mapInArrow(count, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).filter(F.col("n") >= HEAVY)
    with small_batches(rows.sparkSession):
        top = counts.orderBy(F.desc("n"), "shingle").limit(HEAVY_LIST).toArrow()
    shingles = top["shingle"].to_numpy().view(np.uint64)
    ranks = np.arange(len(shingles), 0, -1, dtype=np.uint32)  # the heaviest comes last
    order = np.argsort(shingles)
    return shingles[order], ranks[order]


def signatures(rows: DataFrame) -> DataFrame:
    """(id, n, text_key, group_key, prefix) per row of (id, body): the prefix as packed 64-bit hashes."""
    heavy = rows.sparkSession.sparkContext.broadcast(heavy_shingles(rows))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, ranks = heavy.value
        for b in batches:
            bodies = b.column(1).to_pylist()
            for at, end in runs(bodies):
                texts = [t.lower() for t in bodies[at:end]]
                sizes, keys, groups, prefixes = [], [], [], []
                for t, s in zip(texts, shingle_sets(texts, SHINGLE), strict=True):
                    n = len(s)
                    p = n - (4 * n + 4) // 5 + 1 if n else 0
                    prefix = s[:p]
                    if n and len(shingles):
                        place = np.minimum(np.searchsorted(shingles, s), len(shingles) - 1)
                        is_heavy = shingles[place] == s
                        if is_heavy[:p].any():
                            light = s[~is_heavy]
                            late = s[is_heavy][np.argsort(ranks[place[is_heavy]], kind="stable")]
                            prefix = np.concatenate([light[:p], late[: max(0, p - len(light))]])
                    packed = prefix.tobytes()
                    sizes.append(n)
                    keys.append(blake2b(b" ".join(t.split()), digest_size=16).digest())
                    groups.append(int.from_bytes(blake2b(packed + n.to_bytes(8, "little"), digest_size=8).digest(), "little", signed=True))
                    prefixes.append(packed)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(at, end - at), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(groups, pa.int64()), pa.array(prefixes, pa.binary())],
                    ["id", "n", "text_key", "group_key", "prefix"],
                )
        released()

    return rows.mapInArrow(sign, "id long, n long, text_key binary, group_key long, prefix binary")


def meetings(signed: DataFrame, buckets: int) -> DataFrame:
    """(shingle, group_key, n, pos, near, first) for each prefix shingle that two groups or more have; pos: its place.

    near and first: the group before it by size and the first one, among those of this shingle whose size allows 0.8.
    A batch's prefixes cross the network as packed arrays, one row for each bucket of shingles, each group once.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            groups, first = np.unique(b.column(0).to_numpy(), return_index=True)
            prefixes = b.column(2)
            parts = [np.frombuffer(prefixes[int(i)].as_py(), np.uint64) for i in first]
            sizes = b.column(1).to_numpy()[first].astype(np.int32)
            if not sum(map(len, parts)):
                continue
            every = np.concatenate(parts)
            lengths = np.array([len(x) for x in parts])
            owner = np.repeat(np.arange(len(groups), dtype=np.int32), lengths)
            place = np.arange(len(every)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            place = np.minimum(place, 65535).astype(np.uint16)  # an earlier place only lets more pairs through
            bucket = (mixed_bucket(every) % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            every, owner, bucket, place = every[order], owner[order], bucket[order], place[order]
            heads = np.flatnonzero(np.diff(bucket, prepend=-1))
            rows = []
            for a, e in zip(heads, [*heads[1:], len(bucket)], strict=True):
                who, local = np.unique(owner[a:e], return_inverse=True)
                rows.append((int(bucket[a]), every[a:e].tobytes(), local.astype(np.int32).tobytes(), groups[who].tobytes(), sizes[who].tobytes(), place[a:e].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[k] for r in rows], pa.binary()) for k in range(1, 6))], ["bucket", "s", "o", "g", "n", "p"])

    def meet(t: pa.Table) -> pa.Table:
        s, g, n, p = [], [], [], []
        for b in t.to_batches():
            for a, o, gs, ns, ps in zip(*(c.to_pylist() for c in b.columns[1:]), strict=True):
                o = np.frombuffer(o, np.int32)
                s.append(np.frombuffer(a, np.uint64))
                g.append(np.frombuffer(gs, np.int64)[o])
                n.append(np.frombuffer(ns, np.int32)[o])
                p.append(np.frombuffer(ps, np.uint16))
        every = np.concatenate(s)
        s = np.sort(every)
        many = np.unique(s[1:][s[1:] == s[:-1]])  # most are alone
        at = np.minimum(np.searchsorted(many, every), max(0, len(many) - 1))
        met = many[at] == every if len(many) else np.zeros(len(every), bool)
        s, g, n, p = every[met], np.concatenate(g)[met], np.concatenate(n)[met], np.concatenate(p)[met]
        del every, at, met
        order = np.lexsort((g, n, s))
        s, g, n, p = s[order], g[order], n[order], p[order]
        same = (s[1:] == s[:-1]) & (g[1:] == g[:-1])
        keep = np.append(True, ~same)[: len(s)]
        s, g, n, p = s[keep], g[keep], n[keep], p[keep]
        if len(s):
            new = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
            count = np.diff(np.append(new, len(s)))
            head = np.repeat(new, count)
            several = np.repeat(count > 1, count)
            before = np.maximum(np.arange(len(s)) - 1, head)
            fits = lambda at: 5 * n[at].astype(np.int64) >= 4 * n.astype(np.int64)
            near, first = np.where(fits(before), g[before], g), np.where(fits(head), g[head], g)
            s, g, n, p, near, first = s[several], g[several], n[several], p[several], near[several], first[several]
        else:
            near = first = g
        out = pa.Table.from_arrays([pa.array(s.view(np.int64)), pa.array(g), pa.array(n.astype(np.int64)), pa.array(p.astype(np.int64)), pa.array(near), pa.array(first)], ["shingle", "group_key", "n", "pos", "near", "first"])
        released()
        return out

    dealt = signed.select("group_key", "n", "prefix").mapInArrow(deal, "bucket int, s binary, o binary, g binary, n binary, p binary")
    return dealt.groupBy("bucket").applyInArrow(meet, "shingle long, group_key long, n long, pos long, near long, first long")


def mixed_bucket(x: np.ndarray) -> np.ndarray:
    return (x * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(33)


def verified(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) of ids whose whole texts are alike.  ``pairs``, a written table, has a meeting place t for each.

    Texts of one place are dealt to blocks of about MEMBERS, and the pairs of two blocks are compared in one task, so a
    text is sent once for each block that it has partners in, not for each partner.
    """
    n = pairs.count()
    ends = pairs.select("t", F.col("a").alias("id")).union(pairs.select("t", "b")).distinct()
    # Only places with more than one block need to be known, one in MEMBERS ends at most: pairs of a hot place don't move.
    parts = written(ends.groupBy("t").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("parts")).filter("parts > 1"), "parts")
    block = lambda c: F.pmod(F.xxhash64(c), F.coalesce("parts", F.lit(1))).cast("int")
    placed = joined_small(pairs, parts, "t", "left", parts.count(), BROADCAST_ROWS).select("a", "b", "t", F.least(block("a"), block("b")).alias("x"), F.greatest(block("a"), block("b")).alias("y"))
    members = placed.select("t", "x", "y", F.col("a").alias("id")).union(placed.select("t", "x", "y", "b")).distinct()
    bodies = joined_small(rows, members, "id", "inner", 2 * n, BROADCAST_ROWS)

    def compare(texts: pa.Table, wanted: pa.Table) -> pa.Table:
        sets: dict[int, list[np.ndarray]] = {}  # rows with equal ids are one node, so an id may have several texts
        for i, s in zip(texts["id"].to_pylist(), shingle_sets([x.lower() for x in texts["body"].to_pylist()], SHINGLE), strict=True):
            sets.setdefault(i, []).append(s)
        found = [(i, j) for i, j in zip(wanted["a"].to_pylist(), wanted["b"].to_pylist(), strict=True) if any(alike(x, y) for x in sets.get(i, ()) for y in sets.get(j, ()))]
        return pa.Table.from_pydict({"a": pa.array([x[0] for x in found], pa.int64()), "b": pa.array([x[1] for x in found], pa.int64())})

    key = ["t", "x", "y"]
    wanted = placed.select(*[F.col(c).alias(f"{c}_") for c in key], "a", "b").groupBy(*[f"{c}_" for c in key])
    return bodies.select(*key, "id", "body").groupBy(*key).cogroup(wanted).applyInArrow(lambda left, right: compare(left, right), "a long, b long")


def verified_in_rounds(rows: DataFrame, pairs: DataFrame) -> list[DataFrame]:
    """Written tables that together have the rows of :func:`verified`; each round reads all texts, but moves its own only."""
    place = F.pmod(F.xxhash64("t"), F.lit(ROUNDS))
    return [written(verified(rows, pairs.filter(place == k)), "links") for k in range(ROUNDS)]


def whole_prefixes(signed: DataFrame, groups: DataFrame) -> DataFrame:
    """(shingle, group_key, n, pos) for all prefix shingles of these groups, also those that no other group has."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = [np.frombuffer(x, np.int64) for x in b.column(2).to_pylist()]
            lengths = [len(x) for x in parts]
            if not sum(lengths):
                continue
            keys, n = (np.repeat(b.column(k).to_numpy(), lengths) for k in (0, 1))
            pos = np.minimum(np.concatenate([np.arange(k) for k in lengths]), 65535)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(parts)), pa.array(keys), pa.array(n), pa.array(pos)], ["shingle", "group_key", "n", "pos"])

    one = signed.join(groups, "group_key", "left_semi").groupBy("group_key").agg(F.first("n").alias("n"), F.first("prefix").alias("prefix"))
    return one.mapInArrow(unpack, "shingle long, group_key long, n long, pos long")


def still_open(shared: DataFrame, signed: DataFrame, placed: DataFrame) -> DataFrame:
    """(shingle, group_key, rep, n, pos, component) of prefix shingles whose texts lie in two components or more.

    ``shared`` lacks the shingles of one group only, but a group whose members lie in several components is open within
    itself as well: its whole prefix takes part.
    """
    split = written(placed.groupBy("group_key").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x <> y").select("group_key"), "split")
    few = split.count() <= BROADCAST_ROWS
    groups = F.broadcast(split) if few else split
    facts = shared.select("shingle", "group_key", "n", "pos").join(groups, "group_key", "left_anti").select("shingle", "group_key", "n", "pos")
    met = facts.union(whole_prefixes(signed, groups)).join(placed, "group_key").select("shingle", "group_key", "rep", "n", "pos", "component")
    mixed = met.groupBy("shingle").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x <> y").select("shingle")
    return met.join(mixed, "shingle")


def overlaps(left: list[np.ndarray], right: list[np.ndarray], one: bool) -> np.ndarray:
    """How many shingles each set of ``left`` has in common with each of ``right`` (``one``: both are the same list).

    Only shingles that can be common become columns, COLUMNS at a time, and a product of 0/1 matrices counts them.
    """
    out = np.zeros((len(left), len(right)), np.float32)
    if one:
        every, n = np.unique(np.concatenate(left), return_counts=True)
        common = every[n > 1]
    else:
        common = np.intersect1d(np.concatenate(left), np.concatenate(right))

    def marks(sets: list[np.ndarray], part: np.ndarray) -> np.ndarray:
        m = np.zeros((len(sets), len(part)), np.float32)
        for i, s in enumerate(sets):
            here = s[np.searchsorted(s, part[0]) : np.searchsorted(s, part[-1], "right")]
            at = np.searchsorted(part, here)
            m[i, at[part[at] == here]] = 1
        return m

    for k in range(0, len(common), COLUMNS):
        part = common[k : k + COLUMNS]
        m = marks(left, part)
        out += m @ (m if one else marks(right, part)).T
    return out


def new_links(ids: list[int], of: list[int], sets: list[np.ndarray], on_left: np.ndarray, on_right: np.ndarray) -> list[tuple[int, int]]:
    """Links (a, b) between the left and right texts, as few as join all components ``of`` that they join."""
    left, right = np.flatnonzero(on_left), np.flatnonzero(on_right)
    both = overlaps([sets[i] for i in left], [sets[i] for i in right], bool((on_left == on_right).all()))
    n = np.array([len(s) for s in sets], np.int64)
    union = n[left][:, None] + n[right][None, :] - both
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.get(x, x) != x:
            x = parent[x]
        return x

    found = []
    for i, j in zip(*np.nonzero((both > 0) & (100 * both.astype(np.int64) >= 80 * union)), strict=True):
        a, b = int(left[i]), int(right[j])
        x, y = root(of[a]), root(of[b])
        if x != y:
            parent[x] = y
            found.append((ids[a], ids[b]))
    return found


def open_spots(open_: DataFrame) -> DataFrame:
    """``open_`` with most: by its place, a shingle can only be the first one in common with a set of up to this size, or
    not at all."""
    return open_.withColumn("most", F.expr("(9 * (n - pos)) div 4 - n"))


def block_pairs(open_: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rep, component, block) of open texts, and the pairs (x, y), x <= y, of blocks in which two texts of different
    components may be alike.  ``open_`` is a written table of :func:`open_spots`.

    Sets of s and l shingles, s <= l, need 4/9 (s + l) in common.  The first common one is followed by the others in
    both, so it must come early enough.  And of the text whose prefix ends earlier in the order, all common shingles
    of the prefix lie in the other prefix too, and at most 0.8 l lie behind it: (20 s - 16 l) / 45 are in both.

    A text's home is the one of its shingles that most open texts have, so a group of near copies has few homes.  A
    home's texts are dealt by size to blocks of about MEMBERS texts and BLOCK_SHINGLES shingles.  A shingle then names
    the blocks that it lies in, not its texts: a group of m near copies costs (m / MEMBERS) ** 2 rows.
    """
    counts = open_.groupBy("shingle").agg(F.count("*").alias("c"))
    homes = open_.join(counts, "shingle").groupBy("rep").agg(F.max(F.struct("c", F.xxhash64("shingle").alias("h"))).alias("m"), F.max("n").alias("n"), F.first("component").alias("component"))
    homes = homes.select("rep", "n", "component", F.xxhash64("m.h", F.floor(16 * F.log("n"))).alias("h"))
    parts = homes.groupBy("h").agg(F.ceil(F.greatest(F.count("*") / MEMBERS, F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("parts"))
    placed = written(homes.join(parts, "h").select("rep", "component", F.xxhash64("h", F.pmod(F.xxhash64("rep"), F.col("parts"))).alias("block")), "blocks")
    facts = ["block", "lo", "hi", "small", "large", "most"]
    spots = open_.join(placed.select("rep", "block"), "rep").groupBy("shingle", "block")
    spots = spots.agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.min("n").alias("small"), F.max("n").alias("large"), F.max("most").alias("most"))
    met = spots.join(spots.select("shingle", *[F.col(c).alias(f"{c}2") for c in facts]), "shingle").filter("block <= block2 and not (lo = hi and lo2 = hi2 and lo = lo2)")
    sides = met.groupBy(F.col("block").alias("x"), F.col("block2").alias("y")).agg(
        F.count("*").alias("c"),
        F.max(F.expr("small2 <= most and small <= most2")).alias("early"),
        F.min(F.least("small", "small2")).alias("s"),
        F.max(F.greatest("large", "large2")).alias("l"),
    )
    return placed, sides.filter("early and 45 * c >= 20 * s - 16 * l").select("x", "y")


def links_by_block(rows: DataFrame, placed: DataFrame, pairs: DataFrame) -> DataFrame:
    """Links (a, b) that join components of the texts in each pair of blocks, found on whole texts."""
    ends = pairs.select("x", "y", F.col("x").alias("block")).union(pairs.filter("x <> y").select("x", "y", "y"))
    members = written(ends.join(placed, "block").select("x", "y", "block", "component", F.col("rep").alias("id")), "members")
    bodies = joined_small(rows, members, "id", "inner", members.count(), BROADCAST_ROWS)
    dealt = bodies.select("x", "y", "block", "component", "id", "body").repartition("x", "y").sortWithinPartitions("x", "y")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(held: pa.Table) -> pa.RecordBatch:
            x, y, block = held["x"][0].as_py(), held["y"][0].as_py(), held["block"].to_numpy()
            sets = shingle_sets([t.lower() for t in held["body"].to_pylist()], SHINGLE)
            found = new_links(held["id"].to_pylist(), held["component"].to_pylist(), sets, block == x, block == y)
            return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], ["a", "b"])

        held, now = [], None  # a pair of blocks may go on in the next batch
        for b in batches:
            if not b.num_rows:
                continue
            x, y = b.column(0).to_numpy(), b.column(1).to_numpy()
            heads = np.flatnonzero(np.append(True, (x[1:] != x[:-1]) | (y[1:] != y[:-1])))
            for at, end in zip(heads.tolist(), [*heads[1:].tolist(), len(x)], strict=True):
                if held and now != (x[at], y[at]):
                    yield told(pa.Table.from_batches(held))
                    held = []
                now = (x[at], y[at])
                held.append(b.slice(at, end - at))
        if held:
            yield told(pa.Table.from_batches(held))
        released()

    return dealt.mapInArrow(compare, "a long, b long")


def merged(placed: DataFrame, links: DataFrame) -> DataFrame:
    """``placed`` after new links: components of components."""
    ends = placed.select("rep", "component")
    bridge = links.join(ends.withColumnsRenamed({"rep": "a", "component": "x"}), "a").join(ends.withColumnsRenamed({"rep": "b", "component": "y"}), "b")
    joined = components(bridge.select(F.col("x").alias("a"), F.col("y").alias("b")))
    return placed.join(joined, placed.component == joined.node, "left").select("rep", "group_key", F.coalesce(joined.component, placed.component).alias("component"))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_shingles (distinct shingles), component_id (smallest id reachable by links of 0.8 or more).

    Null or wordless text has no shingles and links with nothing.  A row with a null id takes no part: its component is
    null.  Rows with equal ids are one node.  Equal texts are linked if they have words.  An empty table gives an empty
    result.  Other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), utf8(text_col).alias("body"))
    signed = written(signatures(rows), "signatures")
    known = signed.filter("n > 0 and id is not null")
    texts = known.groupBy("text_key").agg(F.min("id").alias("rep"), F.first("group_key").alias("group_key"), F.first("n").alias("n"))
    texts = written(texts, "texts")
    total = known.agg(F.sum(F.octet_length("prefix") / 8)).first()[0] or 0
    shared = written(meetings(known, max(8, int(total // BUCKET) + 1)), "meetings")

    leaders = texts.groupBy("group_key").agg(F.min("rep").alias("leader"), F.count("*").alias("members"))
    tries = shared.select("group_key", F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("near").alias("other")), F.struct(F.lit(1).alias("kind"), F.col("first").alias("other")))).alias("x"))
    tries = tries.filter("x.other <> group_key").groupBy("group_key", "x.kind", "x.other").agg(F.count("*").alias("c"))
    likely = tries.groupBy("group_key", "kind").agg(F.max(F.struct("c", F.col("other"))).alias("m")).select("group_key", F.col("m.other").alias("other")).distinct()
    by_group = leaders.select(F.col("group_key").alias("other"), F.col("leader").alias("b"))
    across = likely.join(leaders.select("group_key", F.col("leader").alias("a")), "group_key").join(by_group, "other").select("a", "b")
    inside = texts.join(leaders.filter("members > 1"), "group_key").filter("rep <> leader").select(F.col("rep").alias("a"), F.col("leader").alias("b"))
    tried = written(across.union(inside).distinct().withColumn("t", F.col("b")), "pairs")
    links = verified_in_rounds(rows, tried)
    dropped(tried)

    of = components(reduce(DataFrame.union, links))
    first = written(texts.join(of, texts.rep == of.node, "left").select("rep", "group_key", F.coalesce("component", "rep").alias("component")), "placed")
    dropped(*links, of)

    open_ = written(open_spots(still_open(shared, known, first)), "open")
    dropped(shared)
    blocks, pairs = block_pairs(open_)
    pairs = written(pairs, "block-pairs")
    dropped(open_)
    links = written(links_by_block(rows, blocks, pairs), "links")
    placed = written(merged(first, links), "placed")
    dropped(first, blocks, pairs, links)

    by_text = texts.select("text_key", "rep").join(placed, "rep").select("text_key", "component")
    found = signed.join(by_text, "text_key", "left").select("id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).alias("component"))
    return found.select(F.col("id").alias(id_col), "n_shingles", F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component_id"))


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))
