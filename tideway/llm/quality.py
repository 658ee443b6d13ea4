"""Quality rules as weak supervision, in DataFrame functions only.

Each rule votes good (+1), bad (-1) or abstains (0) on a document.  Nobody knows the rules' accuracies, so
expectation-maximisation estimates them from how the rules agree: a latent class (good, bad) with a prior, and for each
rule and class the chances of the three votes.  EM needs only the number of documents by vote pattern, a table of at
most 3^rules rows that partial aggregation makes; a document is kept if its posterior of good is at least a half,
instead of having to pass every rule.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideway.llm.common import GAP, WORD, table, written

SYMBOLS = "[#*$%&|<>]"
#: Frequent function words of the four corpus languages.
STOP_WORDS = (
    "the of and to in is that it for was with as on be at by this are or from "
    "de la le les et un une des que est dans pour qui en du au il elle ne pas "
    "der die das und ist von zu den mit sich auf ein eine nicht als im dem für es "
    "el los las y una por con no su para se lo más como al"
).split()
#: A line that ends as a sentence does.
ENDED = r"[.!?…:;\"'”»)]\s*$"
ROUNDS = 12


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", whole: bool = False) -> DataFrame:
    """Per row the counts that the rules read, and with ``whole`` the row itself as a struct.  Null text has no words.

    Three-word windows are found by sorting (hash, place) pairs inside the row, so a text of n words costs n log n and
    no window ever crosses the network; 64-bit hashes of one text's windows collide with chance n^2 / 2^65.
    """
    row = [F.struct("*").alias("row")] if whole else []
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("body"), *row)
    row = ["row"] if whole else []
    words = base.select("id", "body", *row, F.array_remove(F.split("body", GAP), "").alias("w"))
    n = F.size("w")
    triples = F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.struct(F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)).alias("h"), i.alias("i"))))
    lines = F.filter(F.split("body", "\n"), lambda x: x.rlike(WORD))
    counted = words.select(
        "id",
        *row,
        n.cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count("body", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.size(F.array_intersect("w", F.array(*map(F.lit, STOP_WORDS)))).cast("long").alias("n_stop"),
        F.size(F.array_distinct("w")).cast("long").alias("n_unique"),
        F.size(F.filter("w", lambda x: F.length(x) == 1)).cast("long").alias("n_short"),
        F.size(F.filter("w", lambda x: x.rlike(r"\p{L}"))).cast("long").alias("n_lettered"),
        F.size(F.filter(lines, lambda x: x.rlike(ENDED))).cast("long").alias("n_ended"),
        lines.alias("l"),
        F.sort_array(triples).alias("s"),
    )
    near = counted.select(
        "*",
        F.sort_array(
            F.transform(
                F.filter("s", lambda x, k: x["h"].eqNullSafe(F.get("s", k - 1)["h"]) | x["h"].eqNullSafe(F.get("s", k + 1)["h"])), lambda x: x["i"]
            )
        ).alias("p"),
    )
    covered = F.aggregate(
        "p",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end")),
        lambda a, x: F.struct((a["n"] + x + 3 - F.greatest(x, a["end"])).cast("long").alias("n"), (x + 3).alias("end")),
    )["n"]
    return near.select(
        "id",
        *row,
        "n_words",
        "word_chars",
        "n_symbols",
        "n_stop",
        "n_unique",
        "n_short",
        "n_lettered",
        "n_ended",
        F.size("l").cast("long").alias("n_lines"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
    )


def vote(value: Column, good: Column, bad: Column) -> Column:
    return F.when(value.isNull(), 0).when(bad, -1).when(good, 1).otherwise(0)


def votes() -> dict[str, Column]:
    """The rules: shares with a gap between good and bad in which a rule abstains, as do rules without anything to judge.

    The bounds are those of published web corpus filters or close to them.  No rule is a part of ``base_failed``: the
    bounds of repeated words are far below the base's.
    """
    share = lambda a, b: F.col(a) / F.nullif(F.col(b), F.lit(0))
    low = lambda x, good, bad: vote(x, x < good, x > bad)
    high = lambda x, good, bad: vote(x, x > good, x < bad)
    length = share("word_chars", "n_words")
    return {
        "v_symbols": low(share("n_symbols", "n_words"), 0.05, 0.1),
        "v_dup_lines": low(share("n_dup_lines", "n_lines"), 0.1, 0.3),
        "v_repeats": low(share("n_repeat_words", "n_words"), 0.1, 0.2),
        "v_length": vote(length, (length > 3.5) & (length < 6.5), (length < 3) | (length > 7)),
        "v_letters": high(share("n_lettered", "n_words"), 0.9, 0.8),
        "v_short": low(share("n_short", "n_words"), 0.15, 0.3),
        "v_unique": high(share("n_unique", "n_words"), 0.6, 0.3),
        "v_ends": high(share("n_ended", "n_lines"), 0.8, 0.5),
        "v_stop": vote(F.col("n_words"), F.col("n_stop") >= 3, (F.col("n_words") >= 50) & (F.col("n_stop") == 0)),
    }


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def log_odds(names: list[str], prior: float, chance: dict[str, dict[int, tuple[float, float]]]) -> Column:
    """Log odds of good given the votes; ``chance``: for each rule and vote its chance if good and if bad."""
    total = F.lit(math.log(prior / (1 - prior)))
    for name in names:
        each = F.lit(0.0)
        for v, (good, bad) in chance[name].items():
            each = F.when(F.col(name) == v, math.log(good / bad)).otherwise(each)
        total = total + each
    return total


def posterior(odds: Column) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.least(odds, F.lit(40.0)), F.lit(-40.0))))


def fit(patterns: DataFrame, names: list[str]) -> tuple[float, dict[str, dict[int, tuple[float, float]]]]:
    """EM over the pattern counts (columns ``names`` and ``n``): each round is one aggregate by rule and vote.

    Starts from the number of bad votes and pulls each chance towards a tenth of a pseudo-count; an empty table leaves
    the starting values.
    """
    bad_votes = sum((F.col(c) == -1).cast("int") for c in names)
    post: Column = F.when(bad_votes == 0, 0.95).when(bad_votes == 1, 0.3).otherwise(0.05)
    prior, chance = 0.9, {c: {-1: (0.01, 0.4), 0: (0.1, 0.2), 1: (0.89, 0.4)} for c in names}
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("rule"), F.col(c).alias("vote")) for c in names])).alias("x")
    for _ in range(ROUNDS):
        sums = patterns.select(*names, "n", post.alias("post")).select("n", "post", each).groupBy("x.rule", "x.vote").agg(F.sum(F.col("n") * F.col("post")).alias("g"), F.sum(F.col("n") * (1 - F.col("post"))).alias("b"))
        m = {(r["rule"], r["vote"]): (r["g"], r["b"]) for r in sums.collect()}  # three rows for each rule
        if not m:
            break
        good, bad = (sum(m.get((names[0], v), (0, 0))[k] for v in (-1, 0, 1)) for k in (0, 1))
        prior = min(max((good + 0.1) / (good + bad + 0.2), 0.05), 0.99)
        new = {c: {v: ((m.get((c, v), (0, 0))[0] + 0.1) / (good + 0.3), (m.get((c, v), (0, 0))[1] + 0.1) / (bad + 0.3)) for v in (-1, 0, 1)} for c in names}
        moved = max(abs(x - y) for c in names for v in (-1, 0, 1) for x, y in zip(new[c][v], chance[c][v], strict=True))
        chance, post = new, posterior(log_odds(names, prior, new))
        if moved < 1e-4:
            break
    return prior, chance


def judged(docs: DataFrame, id_col: str, text_col: str, whole: bool) -> DataFrame:
    """``features`` with votes, base_failed, quality and kept.  One pass over the texts, written once; then counts by
    vote pattern."""
    names = list(votes())
    voted = written(features(docs, id_col, text_col, whole), "quality").withColumns(votes()).withColumn("base_failed", base_failed())
    patterns = written(voted.filter("not base_failed").groupBy(*names).agg(F.count("*").alias("n")).coalesce(1), "patterns")
    odds = log_odds(names, *fit(patterns, names))
    return voted.withColumn("quality", posterior(odds)).withColumn("kept", ~F.col("base_failed") & (odds >= 0))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, counts, base_failed, quality (posterior of good), kept (false if base_failed) and the votes.

    Null or wordless text: zero counts, base_failed, not kept.  Null ids, ties and repeated rows are kept as rows; an
    empty table gives an empty result; other columns are not read.
    """
    found = judged(docs, id_col, text_col, whole=False)
    return found.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality", *votes())


def good_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the rules keep, unchanged: rows travel with their counts, so no join is needed."""
    return judged(docs, id_col, text_col, whole=True).filter("kept").select("row.*")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))
