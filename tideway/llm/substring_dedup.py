"""Substring dedup: remove every word covered by a window of words that also starts in a document with a smaller id.

Passages stream through suffix automata of reference shards.  A state of an automaton stands for word sequences that
occur at the same places, and holds the smallest document among them, so the matching statistics of a passage, cut to
the window's length, say of each window whether a smaller document has it; runs of such windows are maximal spans.

1. Equal texts: all but the smallest id's lose every word, without further work.
2. Anchors.  A window's anchor is the least hash of its five-word shingles, so equal windows have equal anchors, and
   overlapping windows mostly share theirs: about one anchor for five words.  Only passages (runs of windows) with an
   anchor that two documents or more have can repeat; all else is settled.
3. The passages that recur most are one reference shard, of at most HOT_WORDS words.  Its automaton is broadcast: copies
   of hot passages, however many, are settled where they are.
4. The corpus is its own reference, so the other shards have no bound together and aren't broadcast: passages go to the
   shard of their anchor, whose automaton is built there, of about SHARD_WORDS words of distinct passages at a time.
   Hot anchors (a common line between ever other words) would fill one task: their windows meet by their own 128-bit
   hash instead, packed by batch.  Should another anchor's passages outgrow an automaton, their windows go on one by one.
5. Documents with spans to remove are read once more and the covered words dropped.

Words are 64-bit hashes; a wrong match takes two words of one hash between the same other words.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideway.llm.common import joined_small, released, runs, small_batches, table, utf8, written
from tideway.llm.shingles import mixed, windows, words_hashed

ANCHOR = 5
#: Anchors, or windows of hot anchors, in one bucket of their meeting, on average.
BUCKET = 1_500_000
#: Ids that may be broadcast, 8 bytes each; more go through a shuffle join.
BROADCAST_IDS = 1_000_000
#: Texts whose passages a task settles among themselves before it sends them.
BATCH_BYTES = 16 << 20
#: The broadcast shard: passages that HOT batches or more have, of up to HOT_LENGTH words each and HOT_WORDS together.
HOT, HOT_LENGTH, HOT_WORDS = 8, 256, 60_000
#: Words of the automaton of a shard, and bytes of passages in one task, on average.
SHARD_WORDS, TASK_BYTES = 100_000, 16 << 20
#: An anchor whose passages have so many words, and one in HOT_ANCHORS of all, is hot: at most HOT_ANCHORS are.
HOT_ANCHOR, HOT_ANCHORS = 20_000, 20_000
#: A text that so many rows or more have, and one in HOT_TEXTS of all copies, is joined by broadcast: at most HOT_TEXTS.
COPIES, HOT_TEXTS = 5_000, 100_000
WORD_BYTES = re.compile(rb"[^\x20\x09-\x0D]+")


class Automaton:
    """Suffix automaton of word sequences, each of a document; a state knows the smallest document of its sequences."""

    def __init__(self, passages: Iterator[tuple[list[int], int]]):
        self.next, self.link, self.length, self.least = [{}], [-1], [0], [1 << 63]
        for words, ident in passages:
            self.add(words, ident)
        for v in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            up = self.link[v]
            if self.least[v] < self.least[up]:
                self.least[up] = self.least[v]

    def split(self, p: int, word: int) -> int:
        """The state behind ``word`` from ``p``, made one of its own if it stands for longer sequences as well."""
        q = self.next[p][word]
        if self.length[q] == self.length[p] + 1:
            return q
        clone = len(self.link)
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.length.append(self.length[p] + 1)
        self.least.append(1 << 63)
        self.link[q] = clone
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        return clone

    def add(self, words: list[int], ident: int) -> None:
        nxt, link, length, least = self.next, self.link, self.length, self.least
        last = 0
        for w in words:
            if w in nxt[last]:
                last = self.split(last, w)
            else:
                now = len(link)
                nxt.append({})
                length.append(length[last] + 1)
                link.append(0)
                least.append(1 << 63)
                p = last
                while p >= 0 and w not in nxt[p]:
                    nxt[p][w] = now
                    p = link[p]
                if p >= 0:
                    link[now] = self.split(p, w)
                last = now
            if ident < least[last]:
                least[last] = ident

    def spans(self, words: list[int], ident: int, size: int) -> tuple[list[tuple[int, int]], int]:
        """Maximal (first, end) of the words covered by windows that a document smaller than ``ident`` has here, and the
        number of these windows."""
        nxt, link, length, least = self.next, self.link, self.length, self.least
        found: list[tuple[int, int]] = []
        state = match = count = 0
        for at, w in enumerate(words, 1):
            while state and w not in nxt[state]:
                state = link[state]
                match = length[state]
            state = nxt[state].get(w, 0)
            match = match + 1 if state else 0
            if match >= size:
                match = size
                while length[link[state]] >= size:
                    state = link[state]
                if least[state] < ident:
                    first = at - size
                    count += 1
                    if found and found[-1][1] >= first:
                        found[-1] = (found[-1][0], at)
                    else:
                        found.append((first, at))
        return found, count


def window_anchors(words: np.ndarray, size: int) -> np.ndarray:
    """The anchor of the window from each word on, over all texts on end."""
    n, small = max(0, len(words) - size + 1), windows(words, ANCHOR)
    least = small[:n].copy()
    for j in range(1, size - ANCHOR + 1):
        np.minimum(least, small[j : j + n], out=least)
    return least


def anchors(texts: list[bytes], size: int) -> list[np.ndarray]:
    """The distinct anchors of each text."""
    words, sizes = words_hashed(texts)
    least, ends = window_anchors(words, size), np.cumsum(sizes)
    return [np.unique(least[e - n : max(e - n, e - size + 1)]) for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]


def passages(texts: list[bytes], shared: np.ndarray, size: int) -> Iterator[tuple[int, int, int, bytes]]:
    """(text, first word, anchor, packed words) of each run of windows with one anchor that is ``shared`` (sorted)."""
    words, sizes = words_hashed(texts)
    least, ends = window_anchors(words, size), np.cumsum(sizes)
    if not len(least) or not len(shared):
        return
    owner = np.repeat(np.arange(len(texts)), sizes)[: len(least)]
    place = np.arange(len(least))
    inside = place + size <= ends[owner]
    at = np.minimum(np.searchsorted(shared, least), len(shared) - 1)
    hit = inside & (shared[at] == least)
    go_on = hit[1:] & hit[:-1] & (least[1:] == least[:-1]) & (owner[1:] == owner[:-1])
    first = np.flatnonzero(hit & np.append(True, ~go_on))
    last = np.flatnonzero(hit & np.append(~go_on, True))
    start = (first - (ends - sizes)[owner[first]]).tolist()
    for t, s, key, a, e in zip(owner[first].tolist(), start, least[first].view(np.int64).tolist(), first.tolist(), (last + size).tolist(), strict=True):
        yield t, s, key, words[a:e].tobytes()


def repeated(ids: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, head) of entries sorted by hash and id without repeats; heads are the first ones of their hash."""
    order = np.lexsort((ids, hashes))
    h, i = hashes[order], ids[order]
    order = order[np.append(True, (h[1:] != h[:-1]) | (i[1:] != i[:-1]))[: len(order)]]
    h = hashes[order]
    return order, np.append(True, h[1:] != h[:-1])[: len(order)]


def by_id(ids: np.ndarray, hashes: np.ndarray) -> tuple[list[int], list[bytes]]:
    order = np.argsort(ids, kind="stable")
    ids, hashes = ids[order], hashes[order]
    heads = np.flatnonzero(np.append(True, ids[1:] != ids[:-1])) if len(ids) else np.zeros(0, np.int64)
    return ids[heads].tolist(), [x.tobytes() for x in np.split(hashes, heads[1:])] if len(ids) else []


def shared_anchors(rows: DataFrame, size: int, buckets: int) -> DataFrame:
    """(id, found): for each document of ``rows`` (id, body) its packed anchors that another document has too.

    Anchors cross the network as packed arrays.  A batch sends one entry for an anchor however many of its documents
    have it, and settles the others itself, so an anchor in a third of all documents costs one entry for each batch.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(ids: list[int], parts: list[np.ndarray]) -> pa.RecordBatch:
            owner = np.repeat(np.array(ids, np.int64), [len(p) for p in parts])
            every = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
            order, head = repeated(owner, every)
            flagged = ~head | np.append(~head[1:], False)[: len(head)]
            local_ids, local = by_id(owner[order][flagged], every[order][flagged])
            sent_ids, sent = owner[order][head], every[order][head]
            # Heads that are flagged already need no answer, but they still stand for their anchor.
            bucket = ((sent * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(40)) % np.uint64(buckets)
            order = np.argsort(bucket, kind="stable")
            sent, sent_ids, bucket = sent[order], sent_ids[order], bucket[order].astype(np.int64)
            cuts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.zeros(0, np.int64)
            rows = [(-1, i, h, None, None) for i, h in zip(local_ids, local, strict=True)]
            for a, e in zip(cuts.tolist(), [*cuts[1:].tolist(), len(bucket)], strict=False):
                who, at = np.unique(sent_ids[a:e], return_inverse=True)
                rows.append((int(bucket[a]), None, sent[a:e].tobytes(), at.astype(np.int32).tobytes(), who.tobytes()))
            kinds = [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["bucket", "id", "found", "o", "g"])

        ids, parts, room = [], [], BATCH_BYTES
        for b in batches:
            bodies = b.column(1).to_pylist()
            for at, end in runs(bodies):
                ids += b.column(0).slice(at, end - at).to_pylist()
                parts += anchors(bodies[at:end], size)
                room -= sum(map(len, bodies[at:end]))
                if room < 0:
                    yield told(ids, parts)
                    ids, parts, room = [], [], BATCH_BYTES
        yield told(ids, parts)
        ids, parts = [], []
        released()

    def meet(t: pa.Table) -> pa.Table:
        hashes, owner = [], []
        for h, o, g in zip(t["found"].to_pylist(), t["o"].to_pylist(), t["g"].to_pylist(), strict=True):
            hashes.append(np.frombuffer(h, np.uint64))
            owner.append(np.frombuffer(g, np.int64)[np.frombuffer(o, np.int32)])
        ids, every = np.concatenate(owner), np.concatenate(hashes)
        del hashes, owner
        order, head = repeated(ids, every)
        order = order[~head | np.append(~head[1:], False)[: len(head)]]
        who, found = by_id(ids[order], every[order])
        out = pa.Table.from_arrays([pa.array(who, pa.int64()), pa.array(found, pa.binary())], ["id", "found"])
        released()
        return out

    # The parts that a batch settled itself and the buckets are one output, written once.
    dealt = written(rows.mapInArrow(deal, "bucket int, id long, found binary, o binary, g binary"), "dealt")
    met = dealt.filter("bucket >= 0").select("bucket", "found", "o", "g").groupBy("bucket").applyInArrow(meet, "id long, found binary")
    return met.union(dealt.filter("bucket < 0").select("id", "found")).groupBy("id").agg(F.collect_list("found").alias("found"))


PASSAGE = "anchor long, id long, row long, at int, n int, words binary, spans binary"
KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]


class Sink:
    """Rows of PASSAGE: passages that are open, and spans (first, end) of words to remove, packed by document."""

    def __init__(self):
        self.open: list[tuple] = []
        self.spans: dict[tuple[int, int], list[int]] = {}
        self.size = 0

    def passage(self, anchor: int, ident: int, row: int, at: int, words: bytes) -> None:
        self.open.append((anchor, ident, row, at, len(words) // 8, words, None))
        self.size += len(words) + 40

    def remove(self, ident: int, row: int, first: int, end: int) -> None:
        self.spans.setdefault((ident, row), []).extend((first, end))
        self.size += 80

    def batch(self) -> pa.RecordBatch:
        # Spans are dealt by document, so that no task gets them all.
        rows = self.open + [(i ^ r, i, r, 0, 0, None, np.array(x, np.int32).tobytes()) for (i, r), x in self.spans.items()]
        self.open, self.spans, self.size = [], {}, 0
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(KINDS)], [x.split()[0] for x in PASSAGE.split(", ")])

    def full(self) -> bool:
        return self.size > 4 << 20


def cut_passages(rows: DataFrame, size: int) -> DataFrame:
    """The open passages of ``rows`` (id, row, body, found), and spans of those whose copy in the batch is in a smaller document."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(same: dict[bytes, list[tuple[int, int, int, int]]]) -> Iterator[pa.RecordBatch]:
            sink = Sink()
            for words, found in same.items():
                least = min(found)[0]
                for ident, row, at, anchor in found:
                    if ident > least:
                        sink.remove(ident, row, at, at + len(words) // 8)
                    else:
                        sink.passage(anchor, ident, row, at, words)
                if sink.full():
                    yield sink.batch()
            yield sink.batch()

        same: dict[bytes, list[tuple[int, int, int, int]]] = {}
        room = BATCH_BYTES
        for b in batches:
            ids, keys, bodies, found = (c.to_pylist() for c in b.columns)
            for a, e in runs(bodies):
                shared = np.unique(np.frombuffer(b"".join(x for f in found[a:e] for x in f), np.uint64))
                for t, at, anchor, words in passages(bodies[a:e], shared, size):
                    same.setdefault(words, []).append((ids[a + t], keys[a + t], at, anchor))
                room -= sum(map(len, bodies[a:e]))
                if room < 0:
                    yield from told(same)
                    same, room = {}, BATCH_BYTES
        yield from told(same)
        same = {}
        released()

    return rows.select("id", "row", "body", "found").mapInArrow(cut, PASSAGE)


def hot_automaton(cut: DataFrame) -> Automaton:
    """The automaton of the passages that most batches have; HOT_WORDS bounds what comes to the driver and is broadcast."""
    sent = cut.filter(f"words is not null and n <= {HOT_LENGTH}").withColumn("h", F.xxhash64("words"))
    often = sent.groupBy("h").agg(F.count("*").alias("c"), F.min("id").alias("least"), F.max("n").alias("n")).filter(F.col("c") >= HOT)
    top = often.orderBy(F.desc("c"), "h").limit(HOT_WORDS // ANCHOR).collect()
    chosen, words = [], 0
    for r in top:
        if words + r["n"] <= HOT_WORDS:
            chosen.append((r["h"], r["least"]))
            words += r["n"]
    if not chosen:
        return Automaton(iter(()))
    small = F.broadcast(cut.sparkSession.createDataFrame(chosen, "h long, least long"))
    texts = sent.join(small, "h").groupBy("words").agg(F.min("id").alias("least")).limit(2 * len(chosen)).collect()
    return Automaton((np.frombuffer(r["words"], np.uint64).tolist(), r["least"]) for r in texts)


def hot_windows(cut: DataFrame, size: int, buckets: int) -> DataFrame:
    """(id, row, spans) that the windows of ``cut``'s passages lose to smaller documents, by meeting one by one.

    A batch sends a window once for its smallest document that has it and settles the others itself; windows cross the
    network as packed arrays, one row for each batch and bucket.
    """

    def packed(ids: np.ndarray, rows: np.ndarray, at: np.ndarray) -> tuple[list[int], list[int], list[bytes]]:
        order = np.lexsort((at, rows, ids))
        ids, rows, at = ids[order], rows[order], at[order]
        heads = np.flatnonzero(np.append(True, (ids[1:] != ids[:-1]) | (rows[1:] != rows[:-1]))[: len(ids)])
        spans = [np.stack([x, x + size], axis=1).astype(np.int32).tobytes() for x in np.split(at, heads[1:])] if len(ids) else []
        return ids[heads].tolist(), rows[heads].tolist(), spans

    def lost(hashes: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Which entries (two hashes each) have an equal one with a smaller id."""
        order = np.lexsort((ids, hashes[:, 1], hashes[:, 0]))
        h, i = hashes[order], ids[order]
        head = np.append(True, (h[1:] != h[:-1]).any(axis=1))[: len(order)]
        least = i[np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))]
        out = np.zeros(len(order), bool)
        out[order] = i > least
        return out

    def entries(words: list[bytes], ids: list[int], rows: list[int], at: list[int]) -> tuple[np.ndarray, ...]:
        lengths = np.array([len(w) // 8 for w in words])
        every, ends = np.frombuffer(b"".join(words), np.uint64), np.cumsum(lengths)
        owner = np.repeat(np.arange(len(words)), lengths)
        place = np.arange(len(every))
        inside = place + size <= ends[owner]
        first = np.zeros((len(every), 2), np.uint64)
        first[: max(0, len(every) - size + 1), 0] = windows(every, size)
        first[: max(0, len(every) - size + 1), 1] = windows(mixed(every), size)
        owner = owner[inside]
        start = place[inside] - (ends - lengths)[owner]
        return first[inside], np.array(ids, np.int64)[owner], np.array(rows, np.int64)[owner], np.array(at, np.int64)[owner] + start

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            ids, rows, at, words = (b.column(k).to_pylist() for k in (1, 2, 3, 5))
            h, i, r, p = entries(words, ids, rows, at)
            gone = lost(h, i)
            who, which, spans = packed(i[gone], r[gone], p[gone])
            out = [(-1, x, y, z, None, None) for x, y, z in zip(who, which, spans, strict=True)]
            h, i, r, p = h[~gone], i[~gone], r[~gone], p[~gone]
            bucket = ((h[:, 0] * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(40)) % np.uint64(buckets)
            order = np.argsort(bucket, kind="stable")
            h, i, r, p, bucket = h[order], i[order], r[order], p[order], bucket[order].astype(np.int64)
            cuts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.zeros(0, np.int64)
            for a, e in zip(cuts.tolist(), [*cuts[1:].tolist(), len(bucket)], strict=False):
                facts = np.stack([i[a:e], r[a:e], p[a:e]], axis=1)
                who, back = np.unique(facts[:, :2], axis=0, return_inverse=True)
                out.append((int(bucket[a]), None, None, np.stack([back.ravel(), p[a:e]], axis=1).astype(np.int32).tobytes(), h[a:e].tobytes(), who.tobytes()))
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(kinds)], ["bucket", "id", "row", "spans", "h", "who"])
        released()

    def meet(t: pa.Table) -> pa.Table:
        hashes, ids, rows, at = [], [], [], []
        for spans, h, who in zip(t["spans"].to_pylist(), t["h"].to_pylist(), t["who"].to_pylist(), strict=True):
            place, owner = np.frombuffer(spans, np.int32).reshape(-1, 2), np.frombuffer(who, np.int64).reshape(-1, 2)
            hashes.append(np.frombuffer(h, np.uint64).reshape(-1, 2))
            ids.append(owner[place[:, 0], 0])
            rows.append(owner[place[:, 0], 1])
            at.append(place[:, 1].astype(np.int64))
        ids, rows, at = np.concatenate(ids), np.concatenate(rows), np.concatenate(at)
        gone = lost(np.concatenate(hashes), ids)
        who, which, spans = packed(ids[gone], rows[gone], at[gone])
        out = pa.Table.from_arrays([pa.array(who, pa.int64()), pa.array(which, pa.int64()), pa.array(spans, pa.binary())], ["id", "row", "spans"])
        released()
        return out

    with small_batches(cut.sparkSession):
        dealt = written(cut.mapInArrow(deal, "bucket int, id long, row long, spans binary, h binary, who binary"), "dealt")
    met = dealt.filter("bucket >= 0").select("bucket", "spans", "h", "who").groupBy("bucket").applyInArrow(meet, "id long, row long, spans binary")
    return met.union(dealt.filter("bucket < 0").select("id", "row", "spans"))


def spans_to_remove(cut: DataFrame, size: int) -> DataFrame:
    """(id, row, spans) of all words that ``cut``'s passages lose."""
    spark = cut.sparkSession
    hot = spark.sparkContext.broadcast(hot_automaton(cut))
    total = cut.agg(F.sum("n")).first()[0] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(8 * total // TASK_BYTES))
    anchors_ = written(cut.filter("words is not null").groupBy("anchor").agg(F.sum("n").alias("words")).filter(F.col("words") > max(HOT_ANCHOR, total // HOT_ANCHORS)), "hot-anchors")
    hot_words = anchors_.agg(F.sum("words")).first()[0] or 0
    often = F.broadcast(anchors_.select("anchor"))
    by_window = None
    if hot_words:
        by_window = written(hot_windows(cut.filter("words is not null").join(often, "anchor", "left_semi"), size, max(1, int(hot_words // BUCKET))), "spans")
        cut = cut.filter("words is null").unionByName(cut.filter("words is not null").join(often, "anchor", "left_anti"))

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A passage whose windows all are in smaller documents of the hot shard goes no further: those documents stand
        for it wherever its windows are looked for."""
        known = hot.value
        for b in batches:
            if b.num_rows and len(known.link) > 1:
                sink, packed = Sink(), b.column(6).to_pylist()
                done = np.zeros(b.num_rows, bool)
                for k, (ident, row, at, n, words) in enumerate(zip(*(b.column(c).to_pylist() for c in (1, 2, 3, 4, 5)), strict=True)):
                    if packed[k] is None and known.spans(np.frombuffer(words, np.uint64).tolist(), ident, size)[1] == n - size + 1:
                        sink.remove(ident, row, at, at + n)
                        done[k] = True
                yield b.filter(pa.array(~done))
                yield sink.batch()
            else:
                yield b

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sink = Sink()
        shard: list[tuple[bytes, list[tuple[int, int, int]]]] = []  # distinct passages and where their smallest document has them
        here: list[tuple[bytes, list[tuple[int, int, int]]]] = []
        room = here_words = 0
        anchor = last = None
        late = False

        def solved() -> None:
            known = Automaton((np.frombuffer(w, np.uint64).tolist(), found[0][0]) for w, found in shard)
            for w, found in shard:
                for first, end in known.spans(np.frombuffer(w, np.uint64).tolist(), found[0][0], size)[0]:
                    for ident, row, at in found:
                        sink.remove(ident, row, at + first, at + end)
            shard.clear()

        def one_by_one(passages: list[tuple[bytes, list[tuple[int, int, int]]]]) -> None:
            for w, found in passages:
                for k in range(len(w) // 8 - size + 1):
                    window = w[8 * k : 8 * (k + size)]
                    key = int.from_bytes(hashlib.blake2b(window, digest_size=8).digest(), "little", signed=True)
                    for ident, row, at in found:
                        sink.passage(key, ident, row, at + k, window)

        for b in batches:
            for key, ident, row, at, words, spans in zip(*(b.column(c).to_pylist() for c in (0, 1, 2, 3, 5, 6)), strict=True):
                if sink.full():
                    yield sink.batch()
                if words is None:
                    sink.spans.setdefault((ident, row), []).extend(np.frombuffer(spans, np.int32).tolist())
                    sink.size += 20 + len(spans)
                    continue
                if key != anchor:
                    if len(here) > 1:  # else the only passage with this anchor is nowhere else
                        shard += here
                        room += here_words
                        if room > SHARD_WORDS:
                            solved()
                            room = 0
                    anchor, last, late, here, here_words = key, None, False, [], 0
                if words == last:
                    if ident > least:
                        sink.remove(ident, row, at, at + len(words) // 8)
                    elif late:
                        one_by_one([(words, [(ident, row, at)])])
                    else:
                        here[-1][1].append((ident, row, at))
                    continue
                last, least = words, ident
                here_words += len(words) // 8
                if not late and here_words > SHARD_WORDS:
                    late = True
                    one_by_one(here)
                    here = []
                if late:
                    one_by_one([(words, [(ident, row, at)])])
                else:
                    here.append((words, [(ident, row, at)]))
        if len(here) > 1:
            shard += here
        solved()
        yield sink.batch()
        released()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, least, sink = None, 0, Sink()
        for b in batches:
            for ident, row, at, words in zip(*(b.column(c).to_pylist() for c in (1, 2, 3, 5)), strict=True):
                if words != last:
                    last, least = words, ident
                elif ident > least:
                    sink.remove(ident, row, at, at + size)
            yield sink.batch()

    def dealt(df: DataFrame, n: int) -> DataFrame:
        return df.repartition(n, "anchor").sortWithinPartitions("anchor", "words", "id")

    with small_batches(spark):
        first = written(dealt(cut.mapInArrow(settle, PASSAGE), tasks).mapInArrow(match, PASSAGE), "spans")
    left = first.filter("words is not null")
    late = left.count()
    found = first.filter("words is null").select("id", "row", "spans")
    if by_window is not None:
        found = found.union(by_window)
    if late:
        found = found.union(written(dealt(left, max(tasks, 8 * size * late // TASK_BYTES)).mapInArrow(meet, PASSAGE), "spans").select("id", "row", "spans"))
    return found.groupBy("id", "row").agg(F.collect_list("spans").alias("spans"))


def joined_found(rows: DataFrame, found: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Rows joined to their entry in ``found``; while its rows are few enough, texts without one don't move."""
    if found.count() > BROADCAST_IDS:
        return rows.join(found, on, how)
    keys = F.broadcast(found.select(*on))
    out = rows.join(keys, on, "left_semi").join(found, on)
    if how == "left":
        rest = rows.join(keys, on, "left_anti")
        names = [c for c in found.columns if c not in on]
        out = out.unionByName(rest.select("*", *[F.lit(None).cast(found.schema[c].dataType).alias(c) for c in names]))
    return out


def copies_of(keyed: DataFrame) -> DataFrame:
    """(id, key) of the documents whose text a smaller document has.  Texts of very many rows meet by broadcast."""
    sums = written(keyed.groupBy("key").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.count("*").alias("rows")).filter("first <> last"), "texts")
    often = max(COPIES, (sums.agg(F.sum("rows")).first()[0] or 0) // HOT_TEXTS)
    hot = F.broadcast(sums.filter(F.col("rows") >= often).select("key", "first"))
    many = keyed.join(hot, "key")
    few = keyed.join(hot.select("key"), "key", "left_anti").join(sums.filter(F.col("rows") < often).select("key", "first"), "key")
    return many.unionByName(few).filter("id <> first").select("id", "key").distinct()


def cut_text(body: bytes, covered: np.ndarray) -> bytes:
    """The text without its covered words; a removed run goes up to the next kept word."""
    out, at = [], 0
    spans = [m.span() for m in WORD_BYTES.finditer(body)]
    starts = np.flatnonzero(np.diff(covered.astype(np.int8), prepend=0) == 1).tolist()
    ends = np.flatnonzero(np.diff(covered.astype(np.int8), append=0) == -1).tolist()
    for a, e in zip(starts, ends, strict=True):
        out.append(body[at : spans[a][0]])
        at = spans[e + 1][0] if e + 1 < len(spans) else len(body)
    return b"".join([*out, body[at:]])


def substring_dedup(docs: DataFrame, size: int = 13, id_col: str = "doc_id", text_col: str = "text", digests: bool = False, whole: bool = False) -> DataFrame:
    """Per row: id, n_words, n_removed, kept text (or with ``digests`` kept_sha256 of the kept words, one space between).

    Null text has no words and stays null.  Rows with a null id keep all words and are no reference.  Rows with equal
    ids are one document: neither removes the other's words.  Texts of fewer words than ``size`` stay as they are.  An
    empty table gives an empty result.  Other columns are not read; with ``whole`` the row comes along as a struct.
    """
    carried = ["whole"] * whole
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), *[F.struct("*").alias("whole")] * whole)
    copies = written(copies_of(rows.filter("id is not null and text is not null").select("id", F.md5(utf8("text")).alias("key"))), "copies")
    body = rows.select("id", utf8("text").alias("body"), F.md5(utf8("text")).alias("key"), F.col("text").isNull().alias("none"), *carried)
    marked = joined_small(body, copies.withColumn("copy", F.lit(True)), ["id", "key"], "left", copies.count(), BROADCAST_IDS // 4)
    marked = marked.withColumn("row", F.xxhash64("body"))  # rows of one id may have several texts
    own = marked.filter("id is not null and copy is null").select("id", "row", "body")
    total = docs.agg(F.sum(F.octet_length(F.col(text_col)))).first()[0] or 0

    shared = written(shared_anchors(own.select("id", "body"), size, max(8, int(total / 6 / 5 // BUCKET) + 1)), "anchors")
    cut = written(cut_passages(joined_found(own, shared, ["id"]), size), "passages")
    found = written(spans_to_remove(cut, size), "found")

    def removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bodies, flags = b.column(1).to_pylist(), list(zip(b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True))
            for at, end in runs(bodies):
                out = []
                for t, (none, copy, spans) in zip(bodies[at:end], flags[at:end], strict=True):
                    words = t.split()
                    n = len(words)
                    gone = np.full(n, bool(copy) and n >= size)
                    for x in [] if copy else spans or []:
                        for first, last in np.frombuffer(x, np.int32).reshape(-1, 2).tolist():
                            gone[first:last] = True
                    lost = int(gone.sum())
                    if digests:
                        kept = hashlib.sha256(b" ".join(w for w, c in zip(words, gone.tolist(), strict=True) if not c) if lost else b" ".join(words)).hexdigest()
                    else:
                        kept = None if none else (cut_text(t, gone) if lost else t).decode()
                    out.append((n, lost, kept))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(at, end - at), *(pa.array([o[k] for o in out], pa.int64()) for k in (0, 1)), pa.array([o[2] for o in out], pa.string()), *(c.slice(at, end - at) for c in b.columns[5:])],
                    ["id", "n_words", "n_removed", "kept", *carried],
                )

    last = joined_found(marked.select("id", "row", "body", "none", "copy", *carried), found, ["id", "row"], "left")
    schema = "id long, n_words long, n_removed long, kept string" + "".join(f", whole {rows.schema['whole'].dataType.simpleString()}" for _ in carried)
    done = last.select("id", "body", "none", "copy", "spans", *carried).mapInArrow(removed, schema)
    return done.select(F.col("id").alias(id_col), "n_words", "n_removed", F.col("kept").alias("kept_sha256" if digests else "kept"), *carried)


def without_repeats(docs: DataFrame, size: int = 13, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with repeated words cut from the text column; all else as it was."""
    done = substring_dedup(docs, size, id_col, text_col, whole=True)
    return done.select(*[F.col("kept").alias(c) if c == text_col else F.col(f"whole.`{c}`").alias(c) for c in docs.columns])


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"), digests=True)
