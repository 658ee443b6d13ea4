"""Content-addressed store of token-id streams.

Write: documents become id streams (end id appended); a rolling hash over the last ids cuts each stream into chunks at
content-defined places; a chunk's address is its BLAKE2b digest.  Chunks and recipes (document to list of addresses)
cross the network once, chunks to packs by address and recipes to files by range of doc_id, so packs hold every chunk
once and recipe files are in ascending doc_id order.  Every recipe has the Merkle root of its chunk addresses, every
file the Merkle root over its entries.  A manifest table lists only the files of successful tasks; a lost task's files
are never listed.

Read: packs are read and each chunk's digest recomputed; recipe files are read and their roots recomputed; a mismatch
raises.  Chunk facts or contents then join the recipes by address.

Pack file:   b"TWPACK1\\n", then blocks (u32 raw size, u32 stored size, zstd data); a block holds entries
             (16-byte address, u32 bytes, ids little-endian).
Recipe file: b"TWRECP1\\n", then blocks as above of entries (u8 has id, i64 doc_id, i64 n_tokens, u32 chunks,
             16-byte root, 16 bytes for each chunk).
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideway.llm.common import by_file, fresh_dir, table, tokenizer_path, utf8, written
from tideway.llm.token_counts import word_table

PACK, RECIPE = b"TWPACK1\n", b"TWRECP1\n"
ADDRESS = 16
BLOCK_BYTES = 1 << 20
#: Chunks have at least MIN_IDS ids but for a document's last, MAX_IDS at most, and on average about MIN_IDS + MASK + 1.
MIN_IDS, MAX_IDS, MASK, SPAN = 64, 1024, np.uint64(255), 8
#: Addresses that a writing task remembers to send a chunk once; past that it forgets (the pack's writer still keeps one).
SEEN = 400_000
MIX = np.uint64(0x9E3779B97F4A7C15)
#: The hash of SPAN ids is a polynomial in this number; its powers 1, 2 and 4 join the hashes of two halves.
POWERS = {k: np.uint64(pow(0x100000001B3, k, 1 << 64)) for k in (1, 2, 4)}


def digest(data: bytes) -> bytes:
    return blake2b(data, digest_size=ADDRESS).digest()


def merkle(leaves: list[bytes]) -> bytes:
    """Root over digests; an odd node moves up unchanged, no leaves give the digest of nothing."""
    if not leaves:
        return digest(b"")
    while len(leaves) > 1:
        leaves = [digest(b"\1" + b"".join(leaves[i : i + 2])) if i + 1 < len(leaves) else leaves[i] for i in range(0, len(leaves), 2)]
    return leaves[0]


def cuts(ids: np.ndarray) -> list[int]:
    """Ends of the content-defined chunks of a stream: where the hash of the last SPAN ids has zero low bits."""
    n = len(ids)
    if n <= MIN_IDS:
        return [n] if n else []
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * MIX
    mixed ^= mixed >> np.uint64(29)
    rolled = mixed
    for k, power in POWERS.items():
        rolled = rolled[:-k] * power + rolled[k:]
    marks = np.flatnonzero(((rolled ^ (rolled >> np.uint64(31))) & MASK) == 0) + SPAN
    ends, at = [], 0
    for m in marks.tolist():
        while m - at > MAX_IDS:
            at += MAX_IDS
            ends.append(at)
        if m - at >= MIN_IDS:
            ends.append(m)
            at = m
    while n - at > MAX_IDS:
        at += MAX_IDS
        ends.append(at)
    return [*ends, n] if at < n else ends


def opened(uri: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system of the shared folder, as Arrow knows it, and the path there."""
    return pa.fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))


class BlockWriter:
    """A file of compressed blocks under a name of its own, so a repeated task never touches another's file."""

    def __init__(self, folder: str, magic: bytes):
        import zstandard

        self.uri = f"{folder}/{magic[2:6].decode().lower()}-{uuid.uuid4().hex}"
        fs, path = opened(self.uri)
        fs.create_dir(path.rpartition("/")[0], recursive=True)
        self.out = fs.open_output_stream(path, compression=None)
        self.out.write(magic)
        self.compress = zstandard.ZstdCompressor(level=1).compress
        self.block, self.room, self.size, self.entries = [], BLOCK_BYTES, 0, 0

    def add(self, entry: bytes) -> None:
        self.block.append(entry)
        self.entries += 1
        self.room -= len(entry)
        if self.room <= 0:
            self.flush()

    def flush(self) -> None:
        if self.block:
            raw = b"".join(self.block)
            stored = self.compress(raw)
            self.out.write(struct.pack("<II", len(raw), len(stored)) + stored)
            self.size += len(stored)
        self.block, self.room = [], BLOCK_BYTES

    def close(self) -> str:
        self.flush()
        self.out.close()
        return self.uri


def blocks(uri: str, magic: bytes) -> Iterator[bytes]:
    import zstandard

    fs, path = opened(uri)
    with fs.open_input_stream(path, compression=None) as f:
        if f.read(len(magic)) != magic:
            raise ValueError(f"{uri}: not a {magic!r} file")
        expand = zstandard.ZstdDecompressor().decompress
        while head := f.read(8):
            raw, stored = struct.unpack("<II", head)
            yield expand(f.read(stored), max_output_size=raw)


def pack_entries(uri: str) -> Iterator[tuple[bytes, bytes]]:
    """(address, chunk) of a pack; raises if a chunk doesn't have its address."""
    for block in blocks(uri, PACK):
        at = 0
        while at < len(block):
            address, (size,) = block[at : at + ADDRESS], struct.unpack_from("<I", block, at + ADDRESS)
            data = block[at + ADDRESS + 4 : at + ADDRESS + 4 + size]
            if digest(data) != address:
                raise ValueError(f"{uri}: a chunk differs from its address")
            yield address, data
            at += ADDRESS + 4 + size


def recipe_entries(uri: str) -> Iterator[tuple[int | None, int, list[bytes], bytes]]:
    """(doc_id, n_tokens, addresses, root) of a recipe file; raises if a root differs."""
    for block in blocks(uri, RECIPE):
        at = 0
        while at < len(block):
            known, doc, n, count = struct.unpack_from("<BqqI", block, at)
            root = block[at + 21 : at + 21 + ADDRESS]
            at += 21 + ADDRESS
            found = [block[at + ADDRESS * k : at + ADDRESS * (k + 1)] for k in range(count)]
            if merkle(found) != root:
                raise ValueError(f"{uri}: a recipe differs from its root")
            yield doc if known else None, n, found, root
            at += ADDRESS * count


def write_store(docs: DataFrame, path: str, folder: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None) -> DataFrame:
    """Encode ``docs`` and write the store to ``folder``; returns the manifest (kind, part, seq, uri, entries, root,
    width: the bytes of an id in packs).

    Null text counts as empty: the stream is the end id alone.  Null doc_ids come first, equal doc_ids stay separate
    documents ordered by recipe; an empty table gives an empty manifest; other columns are not read.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("long").alias("id"), utf8(text_col).alias("body"))
    rows = base.count()
    # A range's recipes are a few hundred bytes a document and one task's; its file goes on in another one at 64 MB.
    ranges = min(4096, max(8, rows // 20_000))
    marks = [k / ranges for k in range(1, ranges)]
    splits = sorted(set(base.select(F.percentile_approx("id", F.array(*map(F.lit, marks)), F.lit(10_000))).first()[0] or []))
    shards = shards or max(16, rows // 8_000)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_table(path)
        end = np.array([end_id], words.type).tobytes()
        seen: set[bytes] = set()
        width = np.dtype(words.type).itemsize
        names = ["part", "kind", "doc", "n", "address", "data"]
        kinds = [pa.int32(), pa.int8(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
        for b in batches:
            out: list[list] = [[] for _ in names]
            size = 0
            for doc, packed in zip(b.column(0).to_pylist(), words.packed(b.column(1).to_pylist()), strict=True):
                packed += end
                found, at = [], 0
                for e in cuts(np.frombuffer(packed, words.type)):
                    chunk = packed[at * width : e * width]
                    address = digest(chunk)
                    found.append(address)
                    at = e
                    if address not in seen:
                        if len(seen) > SEEN:
                            seen.clear()
                        seen.add(address)
                        size += len(chunk)
                        for column, v in zip(out, (int.from_bytes(address[:4], "big") % shards, 0, None, width, address, chunk), strict=True):
                            column.append(v)
                part = shards + (0 if doc is None else int(np.searchsorted(splits, doc, side="right")))
                for column, v in zip(out, (part, 1, doc, at, merkle(found), b"".join(found)), strict=True):
                    column.append(v)
                if size > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds, strict=True)], names)
                    out, size = [[] for _ in names], 0
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds, strict=True)], names)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, writer, leaves, last, seq, width = None, None, [], None, 0, None

        def closed() -> pa.RecordBatch:
            done = pa.RecordBatch.from_pydict(
                {"kind": pa.array([now[1]], pa.int8()), "part": pa.array([now[0]], pa.int32()), "seq": pa.array([seq], pa.int32()), "uri": [writer.close()], "entries": pa.array([writer.entries], pa.int64()), "root": pa.array([merkle(leaves)], pa.binary()), "width": pa.array([width], pa.int64())}
            )
            leaves.clear()
            return done

        for b in batches:
            for part, kind, doc, n, address, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (part, kind) != now or writer.size > 64 << 20:
                    if writer:
                        yield closed()
                    seq = seq + 1 if (part, kind) == now else 0
                    now, writer = (part, kind), BlockWriter(folder, RECIPE if kind else PACK)
                width = None if kind else n
                if kind:
                    writer.add(struct.pack("<BqqI", doc is not None, doc or 0, n, len(data) // ADDRESS) + address + data)
                elif address != last:
                    writer.add(address + struct.pack("<I", len(data)) + data)
                    last = address
                else:
                    continue
                leaves.append(address)
        if writer:
            yield closed()

    manifest = (
        base.mapInArrow(encode, "part int, kind byte, doc long, n long, address binary, data binary")
        .repartition(max(16, (shards + ranges) // 4), "part")
        .sortWithinPartitions("part", "kind", "doc", "address", "data")
        .mapInArrow(write, "kind byte, part int, seq int, uri string, entries long, root binary, width long")
    )
    return written(manifest, "manifest")


def read_recipes(manifest: DataFrame) -> DataFrame:
    """(part, seq, pos, doc_id, n_tokens, addresses) of every document, verified against its root and the manifest."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, seq, uri, root in zip(*(c.to_pylist() for c in b.columns), strict=True):
                found = list(recipe_entries(uri))
                if merkle([x[3] for x in found]) != root:
                    raise ValueError(f"{uri} differs from the manifest")
                yield pa.RecordBatch.from_pydict(
                    {
                        "part": pa.array([part] * len(found), pa.int32()),
                        "seq": pa.array([seq] * len(found), pa.int32()),
                        "pos": pa.array(range(len(found)), pa.int64()),
                        "doc_id": pa.array([x[0] for x in found], pa.int64()),
                        "n_tokens": pa.array([x[1] for x in found], pa.int64()),
                        "addresses": pa.array([x[2] for x in found], pa.list_(pa.binary())),
                    }
                )

    files = manifest.filter("kind = 1").select("part", "seq", "uri", "root")
    return by_file(files).mapInArrow(read, "part int, seq int, pos long, doc_id long, n_tokens long, addresses array<binary>")


def read_chunks(manifest: DataFrame, contents: bool = False) -> DataFrame:
    """(address, n_ids, crc32 of the ids as unsigned 32-bit, and with ``contents`` the ids) of every stored chunk."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri, root, width in zip(*(c.to_pylist() for c in b.columns), strict=True):
                leaves, rows, kind = [], [], np.dtype(f"<u{width}")

                def made(rows: list) -> pa.RecordBatch:
                    cols = {"address": pa.array([r[0] for r in rows], pa.binary()), "n_ids": pa.array([len(r[1]) for r in rows], pa.int64())}
                    cols |= {"crc": pa.array([zlib.crc32(r[1].astype("<u4").tobytes()) for r in rows], pa.int64())}
                    if contents:
                        cols["ids"] = pa.array([r[1].astype(np.int32) for r in rows], pa.list_(pa.int32()))
                    return pa.RecordBatch.from_pydict(cols)

                for address, data in pack_entries(uri):
                    leaves.append(address)
                    rows.append((address, np.frombuffer(data, kind)))
                    if len(rows) == 5000:
                        yield made(rows)
                        rows = []
                if merkle(leaves) != root:
                    raise ValueError(f"{uri} differs from the manifest")
                if rows:
                    yield made(rows)

    files = manifest.filter("kind = 0").select("uri", "root", "width")
    return by_file(files).mapInArrow(read, "address binary, n_ids long, crc long" + ", ids array<int>" * contents)


class CrcShift:
    """The CRC-32 register after so many more zero bytes, as four tables of 256, kept for each length."""

    known: dict[int, list[list[int]]] = {}

    @classmethod
    def tables(cls, size: int) -> list[list[int]]:
        if size not in cls.known:
            # crc32(a + zeros) is affine in crc32(a): its linear part is read off single bits.
            zeros = bytes(size)
            zero = zlib.crc32(zeros, 0)
            bit = [zlib.crc32(zeros, 1 << k) ^ zero for k in range(32)]
            made = []
            for t in range(4):
                row = [0] * 256
                for v in range(1, 256):
                    low = v & -v
                    row[v] = row[v ^ low] ^ bit[8 * t + low.bit_length() - 1]
                made.append(row)
            cls.known[size] = made
        return cls.known[size]

    @classmethod
    def joined(cls, parts: Iterable[tuple[int, int]]) -> int:
        """CRC-32 of a concatenation, from (crc, bytes) of its parts."""
        crc = 0
        for c, size in parts:
            a, b, d, e = cls.tables(size)
            crc = a[crc & 255] ^ b[crc >> 8 & 255] ^ d[crc >> 16 & 255] ^ e[crc >> 24] ^ c
        return crc


def read_summary(manifest: DataFrame) -> DataFrame:
    """Per stored document: doc_id, start (ids of all documents before it), n_tokens and ids_crc32, from the files.

    Planned as merge joins: the planner sees only the manifest's few rows and would broadcast what the files hold.
    A document's checksum is put together from its chunks' in recipe order, so chunk contents never move.
    """
    recipes = written(read_recipes(manifest), "recipes")
    facts = recipes.select("part", "seq", "pos", F.posexplode("addresses").alias("k", "address")).join(read_chunks(manifest).hint("merge"), "address", "left")
    listed = facts.groupBy("part", "seq", "pos").agg(F.array_sort(F.collect_list(F.struct("k", F.coalesce("n_ids", F.lit(-1)).alias("n_ids"), "crc"))).alias("chunks"))

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            crcs = []
            for chunks in b.column(3).to_pylist():
                if any(c["n_ids"] < 0 for c in chunks):
                    raise ValueError("a recipe names a chunk that no pack holds")
                crcs.append((CrcShift.joined((c["crc"], 4 * c["n_ids"]) for c in chunks), sum(c["n_ids"] for c in chunks)))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array([c[0] for c in crcs], pa.int64()), pa.array([c[1] for c in crcs], pa.int64())], ["part", "seq", "pos", "ids_crc32", "n_read"])

    sums = listed.select("part", "seq", "pos", "chunks").mapInArrow(combine, "part int, seq int, pos long, ids_crc32 long, n_read long")
    files = recipes.groupBy("part", "seq").agg(F.sum("n_tokens").alias("n"))
    before = F.sum("n").over(Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1))  # one row a file
    starts = files.select("part", "seq", F.coalesce(before, F.lit(0)).alias("base"))
    inside = F.sum("n_tokens").over(Window.partitionBy("part", "seq").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1))
    return (
        recipes.select("part", "seq", "pos", "doc_id", "n_tokens", F.coalesce(inside, F.lit(0)).alias("inside"))
        .join(starts, ["part", "seq"])
        .join(sums.hint("merge"), ["part", "seq", "pos"])
        .select("doc_id", (F.col("base") + F.col("inside")).alias("start"), F.col("n_read").alias("n_tokens"), "ids_crc32")
    )


def read_documents(manifest: DataFrame) -> DataFrame:
    """(doc_id, ids) of every document, rebuilt from its recipe and the packs."""
    recipes = read_recipes(manifest)
    chunks = read_chunks(manifest, contents=True).select("address", "ids")
    parts = recipes.select("part", "seq", "pos", "doc_id", F.posexplode("addresses").alias("k", "address")).join(chunks.hint("merge"), "address")
    whole = parts.groupBy("part", "seq", "pos", "doc_id").agg(F.array_sort(F.collect_list(F.struct("k", "ids"))).alias("chunks"))
    return whole.select("doc_id", F.flatten(F.col("chunks.ids")).alias("ids"))


def op10_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_store(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), fresh_dir(spark, "store"))
    return read_summary(manifest)
