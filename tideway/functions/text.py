"""Text functions of the news section: cleaning, URLs, tokens, classification, times."""

from __future__ import annotations

import html
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideway.sources.tables import Net, operator

#: Query parameters that only track, besides utm_*.
TRACKING = ("fbclid", "gclid", "mc_cid", "mc_eid", "ref", "ref_src")
#: Signs of UTF-8 that was read as Latin-1.
MOJIBAKE = ("Ã", "Â", "â€", "â€™", "ï»¿")
#: Terms and severities of the event categories, in the order of priority.
TERMS = {
    "conflict": {"missile": 0.95, "attack": 0.92, "war": 0.92, "conflict": 0.82, "airstrike": 0.9, "strike": 0.72, "blockade": 0.86, "seized": 0.9, "closure": 0.78, "closed": 0.76},
    "natural_disaster": {"typhoon": 0.82, "cyclone": 0.82, "hurricane": 0.84, "earthquake": 0.86, "tsunami": 0.94, "flood": 0.72, "landslide": 0.72, "volcanic": 0.78},
    "transport_accident": {"collision": 0.75, "grounding": 0.78, "derailment": 0.82, "crash": 0.82, "accident": 0.62, "explosion": 0.84, "fire": 0.68},
    "port_disruption": {"port closure": 0.82, "port congestion": 0.66, "congestion": 0.55, "shipping disruption": 0.72, "logistics disruption": 0.68, "terminal closure": 0.8, "channel blocked": 0.84},
    "strike": {"labor strike": 0.72, "dockworker strike": 0.78, "port strike": 0.78, "walkout": 0.68, "industrial action": 0.66},
    "sanction": {"sanction": 0.78, "sanctions": 0.78, "embargo": 0.82, "blacklist": 0.74, "export ban": 0.76},
    "trade_policy": {"trade restriction": 0.65, "trade policy": 0.55, "export control": 0.68, "import restriction": 0.62, "quota": 0.48},
    "tariff": {"tariff": 0.55, "tariffs": 0.55, "duty": 0.52, "duties": 0.52, "customs levy": 0.55},
    "customs_delay": {"customs delay": 0.58, "border delay": 0.58, "clearance delay": 0.56, "inspection backlog": 0.6, "customs backlog": 0.62},
}
WORD = r"[\p{L}\p{N}]+"
EDGE = r"[\p{L}\p{N}_]"


def repaired(texts: pd.Series) -> pd.Series:
    """Entities resolved, byte order marks dropped, mojibake repaired where that lowers its signs, NFKC."""

    def one(t: str | None) -> str | None:
        if t is None:
            return None
        t = html.unescape(t).replace("﻿", "").strip()
        if any(m in t for m in MOJIBAKE):
            try:
                fixed = t.encode("latin-1").decode("utf-8")
                t = fixed if sum(m in fixed for m in MOJIBAKE) < sum(m in t for m in MOJIBAKE) else t
            except UnicodeError:
                pass
        return unicodedata.normalize("NFKC", t)

    return texts.map(one)


def clean_text(rows: DataFrame, column: str) -> DataFrame:
    """``rows`` with the column's text cleaned; null stays null.

    Only texts with an entity or a character beyond ASCII go to Python, in Arrow batches; the others need their blanks
    collapsed only.
    """
    odd = F.coalesce(F.col(column).rlike(r"&|[^\x00-\x7F]"), F.lit(False))
    blanks = lambda c: F.trim(F.regexp_replace(c, r"[\s\u0085\p{Z}\x1C-\x1F]+", " "))
    plain = rows.filter(~odd).withColumn(column, blanks(F.col(column)))
    return plain.unionByName(rows.filter(odd).withColumn(column, blanks(F.pandas_udf(repaired, "string")(column))))


def canonical(url: Column) -> Column:
    """Scheme and host in lower case, no fragment, no tracking parameters, parameters in order, single slashes, none at the
    end.  Text without a host stays as it is, empty text is null.  Percent encoding is left as given."""
    raw = F.trim(url)
    part = lambda k: F.regexp_extract(raw, r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?//([^/?#]*)([^?#]*)(?:\?([^#]*))?", k)
    fields = F.transform(F.filter(F.split(part(4), "&"), lambda x: x != ""), lambda x: F.struct(F.split(x, "=", 2)[0].alias("k"), F.coalesce(F.get(F.split(x, "=", 2), 1), F.lit("")).alias("v")))
    kept = F.array_sort(F.filter(fields, lambda f: ~F.lower(f["k"]).startswith("utm_") & ~F.lower(f["k"]).isin(*TRACKING)))
    query = F.array_join(F.transform(kept, lambda f: F.concat(f["k"], F.lit("="), f["v"])), "&")
    path = F.regexp_replace(F.when(part(3) == "", "/").otherwise(part(3)), "/{2,}", "/")
    path = F.when(path == "/", path).otherwise(F.regexp_replace(path, "/+$", ""))
    scheme = F.when(part(1) == "", "https").otherwise(F.lower(part(1)))
    whole = F.concat(scheme, F.lit("://"), F.lower(part(2)), path, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))
    return F.when(raw == "", None).when(part(2) == "", raw).otherwise(whole)


def folded(text: Column) -> Column:
    """Lower case as for comparing: a sharp s counts as two."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "ß", "ss")


def normal_title(text: Column) -> Column:
    """The title's words, folded, one blank between."""
    return F.array_join(F.regexp_extract_all(folded(text), F.lit(WORD), F.lit(0)), " ")


def tokens(text: Column) -> Column:
    """The distinct words of two characters or more; null text has none."""
    return F.array_distinct(F.filter(F.regexp_extract_all(folded(text), F.lit(WORD), F.lit(0)), lambda x: F.length(x) > 1))


def jaccard_similarity(a: Column, b: Column) -> Column:
    """Intersection over union of two token sets; 0 if either is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(0.0)


def classified(rows: DataFrame, column: str) -> DataFrame:
    """``rows`` with x: (terms, categories, category, severity, status) of the column's text by the terms that it has as
    whole words.  The category is that of the most severe term, and of two the one with priority; without a term it is
    other, 0.25.  The folded text and the hits are columns of their own, so they are made once a row."""
    hit = lambda k, c, w, x: F.when(
        F.contains("folded_", F.lit(w)) & F.col("folded_").rlike(f"(?<!{EDGE}){w}(?!{EDGE})"), F.struct(F.lit(-x).alias("s"), F.lit(k).alias("p"), F.lit(c).alias("c"), F.lit(w).alias("t"))
    )
    hits = F.array_compact(F.array(*[hit(k, c, w, x) for k, (c, ws) in enumerate(TERMS.items()) for w, x in ws.items()]))
    found = rows.withColumn("folded_", folded(F.col(column))).withColumn("hits_", hits).withColumn("best_", F.array_min("hits_"))
    ordered = F.array_distinct(F.array_sort(F.transform("hits_", lambda h: F.struct(h["p"].alias("p"), h["c"].alias("c")))))
    x = F.struct(
        F.array_sort(F.array_distinct(F.transform("hits_", lambda h: h["t"]))).alias("terms"),
        F.transform(ordered, lambda h: h["c"]).alias("categories"),
        F.coalesce("best_.c", F.lit("other")).alias("category"),
        F.coalesce(-F.col("best_.s"), F.lit(0.25)).alias("severity"),
        F.when(F.size("hits_") > 0, "classified").otherwise("unclassified").alias("status"),
    )
    return found.withColumn("x", x).drop("folded_", "hits_", "best_")


def seen_time(text: Column, now: Column, tolerance_minutes: int = 5) -> Column:
    """A UTC time from four formats; without a zone it is UTC.  What doesn't read, or lies in the future, is null."""
    zoned = F.regexp_replace(F.trim(text), "Z$", "+0000")
    formats = ((zoned, r"^\d{8}T\d{6}[+-]\d{4}$", "yyyyMMdd'T'HHmmssZ"), (zoned, r"^\d{14}$", "yyyyMMddHHmmss"))
    read = [F.when(x.rlike(shape), F.try_to_timestamp(x, F.lit(f))) for x, shape, f in formats]
    read.append(F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+-]\d{2}:?\d{2})?)?$"), F.try_to_timestamp(text)))
    at = F.coalesce(*read)
    return F.when(at <= now + F.expr(f"INTERVAL {tolerance_minutes} MINUTES"), at)


def freshness(age_hours: Column, half_life: float) -> Column:
    """Halves with every ``half_life`` hours; what lies ahead counts as new."""
    return F.pow(F.lit(0.5), F.greatest(age_hours, F.lit(0.0)) / half_life)


#: The other engine's text for the pieces above, over a column x.
FOLDED = "replace(lower(coalesce({x}, '')), 'ß', 'ss')"
WORDS_SQL = f"regexp_extract_all({FOLDED}, '[\\p{{{{L}}}}\\p{{{{N}}}}]+')"
TOKENS = f"list_distinct(list_filter({WORDS_SQL}, lambda w: length(w) > 1))"
NORMAL = f"array_to_string({WORDS_SQL}, ' ')"
TERM_ROWS = ", ".join(f"('{w}', {x}e0, '{c}', {k})" for k, (c, ws) in enumerate(TERMS.items()) for w, x in ws.items())
HITS = f"""SELECT article_id, term, severity, category, priority FROM (SELECT article_id, {FOLDED.format(x='title')} AS x, concat(' ', regexp_replace({FOLDED.format(x='title')}, '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g'), ' ') AS spaced FROM news) n,
(VALUES {TERM_ROWS}) t(term, severity, category, priority) WHERE strpos(x, term) > 0 AND strpos(spaced, concat(' ', term, ' ')) > 0"""
SEEN = """(SELECT article_id, CASE WHEN seen <= TIMESTAMP '2024-01-10 12:05:00' THEN seen END AS seen FROM (SELECT article_id, CASE
  WHEN seen_at LIKE '%T%Z' AND seen_at NOT LIKE '%-%' THEN strptime(seen_at, '%Y%m%dT%H%M%SZ') WHEN regexp_full_match(seen_at, '[0-9]{14}') THEN strptime(seen_at, '%Y%m%d%H%M%S')
  WHEN seen_at LIKE '%+02:00' THEN strptime(substr(seen_at, 1, 19), '%Y-%m-%dT%H:%M:%S') - INTERVAL 2 HOURS WHEN seen_at LIKE '%-%' THEN CAST(replace(replace(seen_at, 'Z', ''), 'T', ' ') AS TIMESTAMP) END AS seen FROM news) y)"""
NEWS_NOW = "TIMESTAMP '2024-01-10 12:00:00'"


@operator(None, "clean_text")
def clean_titles(t: Net) -> DataFrame:
    titles = t.pages.select("page_id", F.regexp_extract("html", "<title>([^<]*)", 1).alias("title"))
    return clean_text(titles, "title")


@operator("""WITH p AS (SELECT page_id, url, regexp_extract(url, '^https?://([^/?#]*)', 1) AS host, regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '[?]([^#]*)', 1) AS query FROM pages),
q AS (SELECT page_id, string_agg(concat(k, '=', v), '&' ORDER BY k, v) AS query FROM (SELECT page_id, split_part(f, '=', 1) AS k, substr(f, length(split_part(f, '=', 1)) + 2) AS v
  FROM (SELECT page_id, unnest(string_split(concat(query, '&b=2&', CASE WHEN page_id % 3 = 0 THEN 'a' ELSE 'A=x=y' END), '&')) AS f FROM p) x WHERE f <> '') y
  WHERE lower(k) NOT LIKE 'utm@_%' ESCAPE '@' AND lower(k) NOT IN ('fbclid', 'gclid', 'mc_cid', 'mc_eid', 'ref', 'ref_src') GROUP BY page_id)
SELECT p.page_id, concat(regexp_extract(p.url, '^https?'), '://', lower(host), CASE WHEN regexp_replace(path, '/+', '/', 'g') IN ('', '/') THEN '/' ELSE rtrim(regexp_replace(path, '/+', '/', 'g'), '/') END, '?', q.query) AS canonical
FROM p JOIN q ON p.page_id = q.page_id""")
def canonical_url(t: Net) -> DataFrame:
    """The pages' URLs with shouted hosts, doubled slashes, a fragment, and parameters that track, repeat or are blank."""
    host, rest = F.regexp_extract("url", "^https?://[^/?#]*", 0), F.regexp_extract("url", "^https?://[^/?#]*([^?#]*)", 1)
    query = F.regexp_extract("url", r"\?([^#]*)", 1)
    blank = F.when(F.col("page_id") % 3 == 0, "a").otherwise("A=x=y")
    messy = F.concat(F.lit(" "), F.upper(host), F.regexp_replace(rest, "/", "//"), F.lit("?"), query, F.lit("&utm_Source=n&b=2&GCLID=7&"), blank, F.lit("#top"))
    return t.pages.select("page_id", canonical(messy).alias("canonical"))


@operator(f"SELECT article_id, {NORMAL.format(x='title')} AS normal, array_to_string(list_sort({TOKENS.format(x='title')}), ' ') AS tokens FROM news")
def title_tokens(t: Net) -> DataFrame:
    return t.news.select("article_id", normal_title(F.col("title")).alias("normal"), F.array_join(F.array_sort(tokens(F.col("title"))), " ").alias("tokens"))


@operator(f"""WITH names AS (SELECT min(p_partkey) AS k, {TOKENS.format(x='p_name')} AS t FROM part GROUP BY p_name)
SELECT a.k AS a, b.k AS b, CASE WHEN len(a.t) = 0 OR len(b.t) = 0 THEN 0 ELSE round(len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t))), 9) END AS similarity
FROM names a JOIN names b ON a.k < b.k""")
def jaccard(t: Net) -> DataFrame:
    """The similarity of every pair of part names; equal names are one, by their least key."""
    names = t.part.groupBy("p_name").agg(F.min("p_partkey").alias("k")).select("k", tokens(F.col("p_name")).alias("t"))
    both = names.select(F.col("k").alias("a"), F.col("t").alias("x")).join(names.select(F.col("k").alias("b"), F.col("t").alias("y")), F.expr("a < b"))
    return both.select("a", "b", F.round(jaccard_similarity(F.col("x"), F.col("y")), 9).alias("similarity"))


@operator(f"""WITH h AS ({HITS}) SELECT n.article_id, coalesce(string_agg(DISTINCT term, ',' ORDER BY term), '') AS terms, coalesce(arg_min(category, priority - 1000 * severity), 'other') AS category,
  coalesce(max(severity), 0.25e0) AS severity, CASE WHEN count(term) > 0 THEN 'classified' ELSE 'unclassified' END AS status FROM news n LEFT JOIN h ON n.article_id = h.article_id GROUP BY n.article_id""")
def classify_text(t: Net) -> DataFrame:
    return classified(t.news.select("article_id", "title"), "title").select("article_id", F.array_join("x.terms", ",").alias("terms"), "x.category", "x.severity", "x.status")


@operator(f"SELECT article_id, seen FROM {SEEN} s")
def parse_timestamp_multi(t: Net) -> DataFrame:
    seen = seen_time(F.col("seen_at"), F.expr(NEWS_NOW).cast("timestamp"))
    return t.news.select("article_id", seen.cast("timestamp_ntz").alias("seen"))


@operator(f"SELECT article_id, round(pow(0.5e0, greatest(epoch({NEWS_NOW}) - epoch(seen), 0) / 86400.0e0) + 1e-10, 6) AS weight FROM {SEEN} s WHERE seen IS NOT NULL")
def freshness_decay(t: Net) -> DataFrame:
    now = F.expr(NEWS_NOW).cast("timestamp")
    rows = t.news.select("article_id", seen_time(F.col("seen_at"), now).alias("at")).filter("at is not null")
    hours = (F.unix_timestamp(now) - F.unix_timestamp("at")) / 3600
    return rows.select("article_id", F.round(freshness(hours, 24.0) + 1e-10, 6).alias("weight"))


@operator(f"SELECT article_id, substr(sha256(concat({NORMAL.format(x='title')}, '|', lang)), 1, 24) AS content_hash FROM articles")
def content_hash(t: Net) -> DataFrame:
    """A digest of the canonical text of a record: its parts in a fixed order with a bar between."""
    return t.articles.select("article_id", F.substring(F.sha2(F.concat_ws("|", normal_title(F.col("title")), "lang"), 256), 1, 24).alias("content_hash"))
