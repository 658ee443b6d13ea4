"""Language identification by unigram models over pieces of a fixed public vocabulary, summed over all segmentations.

A word (a lower-cased run of letters behind a marker) can be cut into vocabulary pieces in many ways.  A language has a
probability for each piece; the word's likelihood is the sum over all its segmentations of the product of their pieces,
which the forward algorithm adds up from left to right.  A text's score is the product over its words, times nothing
else; the posterior assumes equal priors.  Piece probabilities come from expectation-maximisation (forward-backward)
on word counts of a bounded sample of training documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideway.llm.common import table, tokenizer_path

MARK = "▁"
#: Letters, and also numbers such as a half or a circled one, which only a slower pattern tells apart.
LETTERS_AND_NUMBERS, LETTERS = re.compile(r"[^\W\d_]+"), regex.compile(r"\p{L}+")
#: Runs of letters longer than this are scored in parts, which keeps products within a double.
LONGEST = 40
#: Chance of a character that no piece covers, the same in every language, and of a piece a language has not shown.
UNSEEN = 1e-9
#: Words whose likelihoods a worker remembers (a memory bound only).
KNOWN_WORDS = 400_000


class Lattice:
    """All places of vocabulary pieces in a list of words, ready for forward and backward sums."""

    def __init__(self, automaton, lengths: np.ndarray, words: list[str]):
        joined = "\n".join([MARK + w for w in words]) + "\n"
        sizes = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
        ends = np.cumsum(sizes)
        self.first, self.last = ends - sizes, ends - 1  # nodes before the marker and behind the last letter
        self.nodes = int(ends[-1]) if len(words) else 0
        base = np.repeat(self.first, sizes)
        at = np.flatnonzero(np.arange(self.nodes) != np.repeat(self.last, sizes))  # every character but the line ends
        found = list(automaton.iter(joined))
        end = np.fromiter((x[0] for x in found), np.int64, len(found)) + 1
        piece = np.fromiter((x[1] for x in found), np.int64, len(found))
        # Piece 0 stands for any single character.
        self.end = np.concatenate([end, at + 1])
        self.piece = np.concatenate([piece, np.zeros(len(at), np.int64)])
        self.start = self.end - lengths[self.piece]
        depth = self.end - base[self.end - 1]
        order = np.lexsort((self.end, depth))
        self.end, self.start, self.piece, depth = self.end[order], self.start[order], self.piece[order], depth[order]
        self.steps = np.flatnonzero(np.diff(depth, prepend=-1, append=-1))

    def forward(self, p: np.ndarray) -> np.ndarray:
        alpha = np.zeros((self.nodes + 1, p.shape[1]))
        alpha[self.first] = 1
        for a, b in zip(self.steps[:-1], self.steps[1:], strict=True):
            end = self.end[a:b]
            heads = np.flatnonzero(np.diff(end, prepend=-1))
            alpha[end[heads]] = np.add.reduceat(alpha[self.start[a:b]] * p[self.piece[a:b]], heads, axis=0)
        return alpha

    def expected(self, p: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Expected uses of each piece in each language, given how often each word occurs there."""
        alpha = self.forward(p)
        beta = np.zeros_like(alpha)
        beta[self.last] = counts / alpha[self.last]
        out = np.zeros_like(p)
        for a, b in zip(self.steps[-2::-1], self.steps[:0:-1], strict=True):
            flow = p[self.piece[a:b]] * beta[self.end[a:b]]
            used = alpha[self.start[a:b]] * flow
            for k in range(p.shape[1]):
                out[:, k] += np.bincount(self.piece[a:b], used[:, k], len(p))
                beta[:, k] += np.bincount(self.start[a:b], flow[:, k], len(beta))
        return out


class LanguageModel:
    """Piece probabilities by language; pickles as plain arrays, the automaton is built where it is used."""

    def __init__(self, pieces: list[str], languages: list[str], p: np.ndarray):
        self.pieces, self.languages, self.p = pieces, languages, p
        self.automaton, self.known, self.rows = None, {}, None

    def __reduce__(self):
        return LanguageModel, (self.pieces, self.languages, self.p)

    def lattice(self, words: list[str]) -> Lattice:
        import ahocorasick

        if self.automaton is None:
            self.automaton = ahocorasick.Automaton()
            for k, piece in enumerate(self.pieces):
                if k:
                    self.automaton.add_word(piece, k)
            self.automaton.make_automaton()
            self.lengths = np.array([len(x) for x in self.pieces])
        return Lattice(self.automaton, self.lengths, words)

    def scores(self, words: list[str]) -> np.ndarray:
        """Log likelihood of each word in each language."""
        out = [np.zeros((0, len(self.languages)))]
        for k in range(0, len(words), 20_000):
            lattice = self.lattice(words[k : k + 20_000])
            out.append(np.log(np.maximum(lattice.forward(self.p)[lattice.last], 1e-300)))
        return np.concatenate(out)

    def texts(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(language, posterior) of each text; ("und", 0.0) without letters."""
        split = [words_of(t) for t in texts]
        new = set().union(*split) - self.known.keys()
        if self.rows is None or len(self.known) + len(new) > KNOWN_WORDS:
            new = set().union(*split)
            self.known, self.rows = {}, np.zeros((0, len(self.languages)))
        if new:
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
            self.rows = np.concatenate([self.rows, self.scores(list(new))])
        out = []
        for ws in split:
            if not ws or not self.languages:
                out.append(("und", 0.0))
                continue
            total = self.rows[list(map(self.known.__getitem__, ws))].sum(axis=0)
            best = int(total.argmax())
            out.append((self.languages[best], float(1 / np.exp(total - total[best]).sum())))
        return out


def words_of(text: str | None) -> list[str]:
    found = LETTERS_AND_NUMBERS.findall(text.lower()) if text else []
    if found and not "".join(found).isalpha():
        found = [x for w in found for x in LETTERS.findall(w)]
    if any(len(w) > LONGEST for w in found):
        found = [w[k : k + LONGEST] for w in found for k in range(0, len(w), LONGEST)]
    return found


def vocabulary(path: str) -> list[str]:
    """Lower-case letter pieces of the public vocabulary, with or without a marker in front; piece 0 is any character."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {model.id_to_piece(i).lower() for i in range(model.get_piece_size())}
    return ["?", *sorted(x for x in pieces if re.fullmatch(rf"{MARK}?[^\W\d_]+|{MARK}", x))]


def fit(labelled: DataFrame, path: str, per_language: int = 1500, rounds: int = 3, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """A model from labelled rows.

    ``per_language`` is the documented bound of the sample: about that many documents of each language, those whose ids
    hash lowest.  Word counts are made on the executors; only the sample's distinct words come to the driver.  Rows
    without text or language are left out; no rows give a model without languages, which answers ``und``.
    """
    rows = labelled.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("body"), F.col(lang_col).alias("lang"))
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    languages = sorted(sizes)
    pieces = vocabulary(path)
    if not languages:
        return LanguageModel(pieces, [], np.zeros((len(pieces), 0)))
    share = F.lit(0.0)
    for lang, n in sizes.items():
        share = F.when(F.col("lang") == lang, min(1.0, per_language / n)).otherwise(share)
    chosen = rows.filter(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < share * 1_000_000)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ws = words_of(text)
                yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(ws), pa.string()), "word": pa.array(ws, pa.string())})

    counts = chosen.select("lang", "body").mapInArrow(split, "lang string, word string").groupBy("lang", "word").count().toArrow()
    words = sorted(set(counts["word"].to_pylist()))
    place = {w: k for k, w in enumerate(words)}
    n = np.zeros((len(words), len(languages)))
    n[[place[w] for w in counts["word"].to_pylist()], [languages.index(x) for x in counts["lang"].to_pylist()]] = counts["count"].to_numpy()
    p = np.full((len(pieces), len(languages)), 1 / len(pieces))
    model = LanguageModel(pieces, languages, p)
    for _ in range(rounds):
        uses = np.zeros_like(p)
        for k in range(0, len(words), 20_000):
            uses += model.lattice(words[k : k + 20_000]).expected(model.p, n[k : k + 20_000])
        model.p = (uses + 0.01) / (uses + 0.01).sum(axis=0)
        model.p[0] = UNSEEN
    return LanguageModel(pieces, languages, model.p)


def held_out(id_col: str = "doc_id"):
    """Whether a row is held out: crc32 of the id as text leaves 1 modulo 3.  A null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame, path: str, per_language: int = 1500, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Per row: id, held_out, lang_pred, score.  Learns from the rows that are not held out; a prediction reads the text only.

    Null text, or text without a letter: ``und`` with score 0.  Null ids, ties and repeated rows are kept; an empty
    table gives an empty result; other columns are not read.  Texts are scored whole, in place, without a shuffle.
    """
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(fit(docs.filter(~held_out(id_col)), path, per_language, id_col=id_col, text_col=text_col, lang_col=lang_col))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = model.value
        for b in batches:
            texts = b.column(2).to_pylist()
            found: list[tuple[str, float]] = []
            size, run = 0, []
            for k, t in enumerate(texts):
                run.append(t)
                size += len(t or "")
                if size > 4 << 20 or k == len(texts) - 1:
                    found += known.texts(run)
                    run, size = [], 0
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], ["id", "held_out", "lang_pred", "score"]
            )

    rows = docs.select(F.col(id_col).cast("long").alias("id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("body"))
    return rows.mapInArrow(score, "id long, held_out boolean, lang_pred string, score double").withColumnRenamed("id", id_col)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))
