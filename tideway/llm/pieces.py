"""SentencePiece encoding and decoding through a table of distinct marked words.

The model marks blanks with U+2581 and, if no piece has a marker after another character (checked when the model is
loaded), no piece crosses the start of a run of markers.  So a text falls into chunks, each a run of markers and the
characters up to the next one; every distinct chunk of a batch is segmented once, and ids and decoded text are joined
back by position.  A model whose pieces do cross is encoded text by text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideway.llm.common import released, table, tokenizer_path, utf8

MARK = "▁"
MARK_UTF8 = MARK.encode()
#: Chunks kept between batches by one Python worker; past that the table starts anew (a memory bound only).
TABLE_CHUNKS = 200_000
RUN_BYTES = 1 << 20


class ChunkTable:
    """Distinct chunks, each without its first marker, to (ids as decimal text, ids, decoded text)."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.apart = not any(MARK in p.lstrip(MARK) for p in pieces)
        self.known: dict[bytes, tuple[str, int, str]] = {}

    def learn(self, chunks: set[bytes]) -> None:
        if len(self.known) > TABLE_CHUNKS:
            self.known = {c: self.known[c] for c in chunks & self.known.keys()}
        missing = [c.decode() for c in chunks - self.known.keys()]
        ids = self.model.encode(missing, num_threads=1)
        lone = self.model.piece_to_id(MARK)
        ids = [x if c else [lone] for c, x in zip(missing, ids, strict=True)]  # encode("") has no ids; the chunk is one marker
        for c, x, d in zip(missing, ids, self.model.decode(ids), strict=True):
            self.known[c.encode()] = (",".join(map(str, x)), len(x), d)

    @staticmethod
    def chunks(text: bytes) -> list[bytes]:
        """The marked text's chunks in order, each without its first marker."""
        if not text:
            return []
        if b"  " not in text and MARK_UTF8 not in text and text[:1] != b" " and text[-1:] != b" ":
            return text.split(b" ")
        marked = MARK + text.decode().replace(" ", MARK)
        return [c[1:].encode() for c in re.findall(f"{MARK}+[^{MARK}]*", marked)]

    def run(self, texts: list[bytes]) -> list[tuple[str, int, str]]:
        """(ids as decimals joined by commas, their number, decoded text) of each text."""
        if not self.apart:
            each = [self.model.encode(t.decode()) for t in texts]
            return [(",".join(map(str, x)), len(x), self.model.decode(x)) for x in each]
        split = [self.chunks(t) for t in texts]
        self.learn(set().union(*split))
        get, out = self.known.__getitem__, []
        for cs in split:
            found = list(map(get, cs))
            out.append((",".join([x[0] for x in found]), sum([x[1] for x in found]), " ".join([x[2] for x in found])))
        return out


TABLES: dict[str, ChunkTable] = {}


def chunk_table(path: str) -> ChunkTable:
    if path not in TABLES:
        TABLES[path] = ChunkTable(path)
    return TABLES[path]


def runs(texts: list[bytes]) -> Iterator[list[bytes]]:
    """Consecutive texts of about RUN_BYTES bytes."""
    at = 0
    while at < len(texts):
        size, end = 0, at
        while end < len(texts) and size < RUN_BYTES:
            size += len(texts[end])
            end += 1
        yield texts[at:end]
        at = end


def encode_pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """Per row: id, n_tokens, and ids (array) with decoded text; or with ``digests`` their SHA-256 in hex instead.

    Null text counts as empty: no ids, empty decoded text.  Null ids, repeated rows and ties are kept; an empty table
    gives an empty result; other columns are not read, so clashing names do no harm.  No shuffle.
    """
    schema = "id long, n_tokens long, " + ("ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = chunk_table(path)
        for b in batches:
            at = 0
            for texts in runs(b.column(1).to_pylist()):
                found = known.run(texts)
                if digests:
                    last = [[hashlib.sha256(x[k].encode()).hexdigest() for x in found] for k in (0, 2)]
                else:
                    last = [[list(map(int, x[0].split(","))) if x[0] else [] for x in found], [x[2] for x in found]]
                kinds = (pa.string(), pa.string()) if digests else (pa.list_(pa.int32()), pa.string())
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(at, len(texts)), pa.array([x[1] for x in found], pa.int64()), *(pa.array(v, k) for v, k in zip(last, kinds, strict=True))],
                    ["id", "n_tokens", *(("ids_sha256", "decoded_sha256") if digests else ("ids", "decoded"))],
                )
                at += len(texts)
        released()

    return docs.select(F.col(id_col).cast("long").alias("id"), utf8(text_col).alias("body")).mapInArrow(encode, schema).withColumnRenamed("id", id_col)


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_pieces(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"), digests=True)
