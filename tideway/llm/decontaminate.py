"""Benchmark decontamination by spaced seeds, in DataFrame functions only.

A seed is a fixed mask over consecutive words of which some places are ignored; the hash of the others finds passages
in which ignored words were replaced.  Hashes of all places of all documents meet the hashes of the benchmark; each hit
fixes an alignment of one document and one item, which is verified word by word: somewhere along it a run of WINDOW
words must agree in at least AGREE places, or the same share of the words of an item shorter than WINDOW: all but two
of 11 to 15 words, all but one of 6 to 10, all of up to 5.  The masks leave out no such alignment.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideway.llm.common import joined_small, table, written

WINDOW, AGREE = 16, 13
#: (words of an item at least, its masks, 1 for places that count).  However the words that may differ lie in a run of so
#: many words, one of the masks meets none of them at some place of the run.  Each mask starts with 1 and is there once.
BANDS = (
    (16, ("1101111", "10110001011", "110100111")),
    (13, ("11010111", "1100110011")),
    (11, ("1101011", "100100111")),
    (8, ("101101",)),
    (6, ("10101",)),
    *((n, ("1" * n,)) for n in range(5, 0, -1)),
)
#: Seed hashes and items are broadcast up to so many rows, of at most some 100 bytes each; beyond, they are joined by shuffle.
BROADCAST_ROWS = 500_000


def words_of(text: str) -> Column:
    """Lower-cased runs of letters and digits; null text has none."""
    return F.array_remove(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def band_of(words: str) -> Column:
    """The least length of the band that a text of these words is in; null if there are none."""
    return F.coalesce(*[F.when(F.size(words) >= n, F.lit(n)) for n, _ in BANDS])


def seeds(df: DataFrame, keep: list[str], bands: list[int], own: bool = False) -> DataFrame:
    """A row for each place and mask of ``bands`` (``own``: of the text's band only): ``keep``, words, at (from 0) and
    hash (with the mask as part of it)."""
    # outer: else the planner infers a filter that splits every text a second time
    places = df.select(*keep, "words", F.posexplode_outer("words").alias("at", "first"))
    hashes = []
    for n, mask in ((n, mask) for n, masks in BANDS if n in bands for mask in masks):
        used = [F.get("words", F.col("at") + j) for j, c in enumerate(mask) if c == "1"]
        fits = F.col("at") + len(mask) <= F.size("words")
        hashes.append(F.when(fits & (band_of("words") == n) if own else fits, F.xxhash64(F.lit(int(mask, 2)), *used)))
    return places.select(*keep, "words", "at", F.explode(F.array(*hashes)).alias("hash")).filter("hash is not null")


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id, item, start, n_equal) for each document and benchmark item that share a passage; others have no row.

    start is the first aligned word of the document, n_equal the words of the item that agree along the best alignment.
    Null or wordless texts on either side share nothing; null ids are kept as ids; repeated rows count once; an empty
    table on either side gives an empty result; other columns are not read.

    Only hits leave the scan's stage: places, hashes and the look-up of the broadcast seeds are one generated loop, and
    a document's words travel to the verification of the same row, so texts are never shuffled.  A benchmark of more than
    BROADCAST_ROWS seeds is joined by shuffle: then only (document, place, hash) move, 24 bytes each, and the words of
    documents with a hit are fetched afterwards.
    """
    items = written(
        benchmark.select(F.col(item_col).alias("item"), words_of(item_text).alias("words")).withColumnRenamed("words", "item_words").dropDuplicates(), "items"
    )
    # Documents are hashed by the masks of the bands that the benchmark has items in.
    bands = [r[0] for r in items.select(band_of("item_words")).distinct().collect() if r[0]] or [WINDOW]
    keys = written(
        seeds(items.select("item", F.col("item_words").alias("words")), ["item"], bands, own=True).select("hash", "item", F.col("at").alias("item_at")).dropDuplicates(["hash", "item", "item_at"]), "seeds"
    )
    n_keys, n_items = keys.count(), items.count()
    base = docs.select(F.col(id_col).alias("id"), words_of(text_col).alias("words"))
    if n_keys <= BROADCAST_ROWS:
        hits = seeds(base, ["id"], bands).join(F.broadcast(keys), "hash")
    else:
        base = base.withColumn("row", F.xxhash64(F.coalesce(F.col("id").cast("string"), F.lit("")), "words"))  # rows of one id may differ
        met = seeds(base, ["row"], bands).select("row", "at", "hash").join(keys, "hash").select("row", "item", (F.col("at") - F.col("item_at")).alias("shift"))
        hits = base.join(met.distinct(), "row").withColumns({"at": F.greatest("shift", F.lit(0)), "item_at": F.greatest(-F.col("shift"), F.lit(0))})
    aligned = joined_small(hits, items.select("item", F.size("item_words").alias("m")), "item", "inner", n_items, BROADCAST_ROWS)
    shift = F.col("at") - F.col("item_at")
    low = F.greatest(-shift, F.lit(0))  # the item's first place inside the document
    size = F.least(F.col("m"), F.size("words") - shift) - low
    # Many hits lie on one alignment: one is left of them before anything moves or is compared.
    # Rows of one id may differ in text, so the passage is part of the key.
    once = aligned.select("id", "item", shift.alias("shift"), low.alias("low"), F.slice("words", low + shift + 1, size).alias("part")).distinct()
    with_item = joined_small(once, items, "item", "inner", n_items, BROADCAST_ROWS // 50)
    equal = F.zip_with("part", F.slice("item_words", F.col("low") + 1, F.size("part")), lambda a, b: (a == b).cast("int"))
    total = lambda e: F.aggregate(e, F.lit(0), lambda a, x: a + x)
    window = F.least(F.size("item_words"), F.lit(WINDOW))
    checked = with_item.select("id", "item", (F.col("low") + F.col("shift")).cast("long").alias("start"), window.alias("window"), equal.alias("e")).filter(F.size("part") >= window)
    best = F.array_max(F.transform(F.sequence(F.lit(1), F.size("e") - F.col("window") + 1), lambda k: total(F.slice("e", k, F.col("window")))))
    found = checked.select("id", "item", "start", "window", total(F.col("e")).cast("long").alias("n"), best.alias("best")).filter(F.col("best") * WINDOW >= F.col("window") * AGREE)
    return found.groupBy("id", "item").agg(F.max(F.struct("n", (-F.col("start")).alias("s"))).alias("b")).select(
        F.col("id").alias(id_col), F.col("item").alias(item_col), (-F.col("b.s")).alias("start"), F.col("b.n").alias("n_equal")
    )


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
