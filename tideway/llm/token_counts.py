"""Token counts: Arrow functions that batch-encode and return lengths only.

Texts are cut at ASCII white space.  That boundary is safe for this family of tokenizers: the normaliser turns white
space into a blank and neither composition nor case mapping reaches over it, no match of the pre-tokenizer contains
it, and an added token's string has none.  So the count of a text is the sum over its words, each distinct word of a
batch is encoded once, and a text of any length is only ever seen as words.  Words to encode go to the library in
batches balanced by bytes.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideway.llm.common import table, tokenizer_path, utf8

#: Words kept between batches by one Python worker; past that the table starts anew (a memory bound, no effect on results).
TABLE_WORDS = 700_000
#: Bytes handed to the library at once.
BATCH_BYTES = 1 << 18
#: A text or word that can be cut further: printable ASCII without ' and <, Latin-1 letters, ASCII white space.  They
#: have no combining marks, one-to-one lower case, and fall into the pre-tokenizer's letters, digits and others.
PLAIN = re.compile(r"[\t-\r -&(-;=-~À-ÖØ-öø-ÿ]*")
PARTS = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9\t-\r ]+")
WORD_END = "</w>"


class Known(dict):
    """Packed ids by word or part.  A missing one is given an empty array at its first lookup, which ``fill`` fills in
    place: so texts are looked up once, before what is new in them is encoded."""

    def __init__(self) -> None:
        self.new: dict[bytes | str, bytearray] = {}

    def __missing__(self, key: bytes | str) -> bytearray:
        self[key] = room = self.new[key] = bytearray()
        return room

    def fill(self, encoded: Callable[[list], Iterable[bytes]]) -> None:
        for (key, room), ids in zip(self.new.items(), encoded([*self.new]), strict=True):
            room.extend(ids)
            self[key] = ids
        self.new = {}


class WordTable:
    """Distinct words to token ids, for a tokenizers file with the normaliser and pre-tokenizer described above.

    ``plain`` tells whether words may be cut into letters, digits and others after lower-casing, as the pre-tokenizer
    does; it is read from the file, so other files fall back to whole words, or to whole texts (``words`` false).
    """

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer, pre_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks already fill the cores
        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        pre, norm = json.dumps(spec.get("pre_tokenizer")), json.dumps(spec.get("normalizer"))
        self.words = '"behavior": "Removed", "invert": true' in pre and r"[^\\s\\p{L}\\p{N}]+" in pre and "\\\\s+" in norm
        vocab = self.tokenizer.get_vocab(True)
        self.is_end = np.zeros(max(vocab.values(), default=0) + 1, bool)
        self.is_end[[i for t, i in vocab.items() if t.endswith(WORD_END)]] = True
        self.plain = self.words and "Lowercase" in norm and spec["model"].get("end_of_word_suffix") == WORD_END
        self.wide = self.tokenizer.get_vocab_size(True) > 1 << 16
        self.type = np.uint32 if self.wide else np.uint16
        self.by_part = self.tokenizer
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or []
        if self.plain and [x["type"] for x in steps] == ["Split", "ByteLevel"] and not any(PLAIN.fullmatch(t["content"]) for t in spec.get("added_tokens", [])):
            # Parts are lower-cased and cut already and hold no added token, so they need the file's model and byte letters only.
            self.by_part = Tokenizer(self.tokenizer.model)
            letters = pre_tokenizers.ByteLevel(add_prefix_space=steps[1]["add_prefix_space"], use_regex=steps[1]["use_regex"])
            self.by_part.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), letters])
        self.ids, self.parts = Known(), Known()

    def encoded(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of each text as packed integers, encoded in batches balanced by bytes."""
        batch: list[str] = []
        room = BATCH_BYTES
        for k, text in enumerate(texts):
            batch.append(text)
            room -= len(text)
            if room <= 0 or k == len(texts) - 1:
                for e in self.tokenizer.encode_batch_fast(batch, add_special_tokens=False):
                    yield np.array(e.ids, dtype=self.type).tobytes()
                batch, room = [], BATCH_BYTES

    def encoded_parts(self, parts: list[str]) -> Iterator[bytes]:
        """Ids of each part.  A part is one match of the pre-tokenizer, so in a line of parts each ends at the one id
        whose piece has the end mark, and a line is encoded at once."""
        for k in range(0, len(parts), 2000):
            line = parts[k : k + 2000]
            ids = np.array(self.by_part.encode_batch_fast([" ".join(line)], add_special_tokens=False)[0].ids, dtype=self.type)
            ends = (np.flatnonzero(self.is_end[ids]) + 1) * ids.itemsize
            if len(ends) != len(line):
                yield from self.encoded(line)
                continue
            data, at = ids.tobytes(), 0
            for end in ends.tolist():
                yield data[at:end]
                at = end

    def runs(self, texts: list[bytes]) -> Iterator[list[list[bytes]]]:
        """For runs of texts of about BATCH_BYTES * 16 bytes, each text's packed ids in pieces: by the parts of a plain
        text, by the words of another."""
        at = 0
        while at < len(texts):
            # A table with unfilled arrays is left by a run that failed.
            if len(self.ids) > TABLE_WORDS // 4 or self.ids.new:
                self.ids = Known()
            if len(self.parts) > TABLE_WORDS or self.parts.new:
                self.parts = Known()
            word, part = self.ids.__getitem__, self.parts.__getitem__
            size, out = 0, []
            while at < len(texts) and size < BATCH_BYTES * 16:
                size += len(texts[at])
                text = texts[at].decode() if self.plain else ""
                if self.plain and PLAIN.fullmatch(text):
                    out.append(list(map(part, PARTS.findall(text.lower()))))
                else:
                    out.append(list(map(word, texts[at].split())))
                at += 1
            self.ids.fill(lambda words: self.encoded([w.decode() for w in words]))
            self.parts.fill(self.encoded_parts)
            yield out

    def packed(self, texts: list[bytes]) -> Iterator[bytes]:
        """Each text's ids as packed integers."""
        if not self.words:
            yield from self.encoded([t.decode() for t in texts])
            return
        for run in self.runs(texts):
            yield from map(b"".join, run)

    def lengths(self, texts: list[bytes]) -> list[int]:
        """Token counts only: the packed ids are never joined."""
        width, out = np.dtype(self.type).itemsize, []
        if not self.words:
            return [len(x) // width for x in self.encoded([t.decode() for t in texts])]
        for run in self.runs(texts):
            out += [sum(map(len, pieces)) // width for pieces in run]
        return out


TABLES: dict[str, WordTable] = {}


def word_table(path: str) -> WordTable:
    """This worker's table; it serves all tasks that the worker runs."""
    if path not in TABLES:
        TABLES[path] = WordTable(path)
    return TABLES[path]


def token_counts(docs: DataFrame, path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: id, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit).

    Null text counts as empty (0 bytes, 0 tokens); null ids, repeated rows and ties are kept as they are; an empty
    table gives an empty result; other columns, whatever their names, are not read.  No shuffle: one pass of the scan.
    """
    schema = "id long, n_bytes long, n_tokens long"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = word_table(path)
        for b in batches:
            texts = b.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(map(len, texts), pa.int64()), pa.array(known.lengths(texts), pa.int64())], ["id", "n_bytes", "n_tokens"]
            )

    return (
        docs.select(F.col(id_col).cast("long").alias("id"), utf8(text_col).alias("body"))
        .mapInArrow(count, schema)
        .select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
    )


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))
