"""News events: preparation, clusters, zone scores, decision factors and their plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideway.functions.text import HITS, NEWS_NOW, NORMAL, SEEN, TOKENS, canonical, classified, freshness, normal_title, seen_time, tokens
from tideway.operators.aggregates import rounded, top3_blend
from tideway.operators.filters import items
from tideway.operators.graph import checkpointed, components
from tideway.operators.joins import reconciled
from tideway.sources.tables import Net, operator

#: Titles of one event: so many hours apart at most, and so alike in hundredths; severity halves in HALF_LIFE hours.
BAND, ALIKE, HALF_LIFE = 48, 82, 24.0
#: The categories of each decision factor.
DECISIONS = {"war": ["conflict"], "natural_disaster": ["natural_disaster"], "trade_policy": ["sanction", "trade_policy", "tariff"]}


def prepared(articles: DataFrame, now: Column) -> DataFrame:
    """Articles with their time, category, normalised title, tokens and digests.

    Rejected: no title and no URL; a time that doesn't read or lies in the future; in a zone, all but the smallest id of
    rows with one URL and one normalised title.
    """
    rows = articles.withColumns({"seen": seen_time(F.col("seen_at"), now), "canonical_url": canonical(F.col("url")), "norm": normal_title(F.col("title"))})
    rows = rows.filter("seen is not null and (title <> '' or url <> '')").withColumn("t", tokens(F.col("title")))
    first = rows.groupBy("zone_id", "canonical_url", "norm").agg(F.min("article_id").alias("article_id"))
    rows = rows.join(first, ["zone_id", "canonical_url", "norm", "article_id"], "left_semi")
    rows = classified(rows, "title")
    identity = F.concat_ws("|", "norm", F.date_format("seen", "yyyy-MM-dd"), "x.category")
    # Several joins read it: computed once.
    return checkpointed(rows).select("article_id", "zone_id", "domain", "seen", "canonical_url", "norm", "t", "x.category", "x.severity", F.substring(F.sha2(identity, 256), 1, 24).alias("content_hash"), F.length("title").alias("size"))


def representatives(rows: DataFrame) -> DataFrame:
    """Of articles with one zone, category, title and time the one with the smallest id; the others link to it."""
    first = rows.groupBy("zone_id", "category", "norm", "seen").agg(F.min("article_id").alias("article_id"))
    return rows.join(first, ["zone_id", "category", "norm", "seen", "article_id"], "left_semi")


def similar_titles(rows: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b, of a zone and a category within BAND hours with different titles and a token Jaccard of ALIKE
    or more.  Two such sets share one among their first n - ceil(0.82 n) + 1 tokens, from the rarest to the most common."""
    counts = rows.select(F.explode("t").alias("token")).groupBy("token").agg(F.count("*").alias("c"))
    ranked = rows.select("article_id", F.explode("t").alias("token")).join(counts, "token").groupBy("article_id").agg(F.sort_array(F.collect_list(F.struct("c", "token"))).alias("r"))
    size = F.size("r")
    first = F.slice("r", F.lit(1), (size - F.floor((size * ALIKE + 99) / 100) + 1).cast("int"))
    spread = rows.join(ranked.select("article_id", F.explode(first).alias("f")), "article_id").withColumn("token", F.col("f.token"))
    x, y = spread.alias("x"), spread.alias("y")
    near = F.expr(
        f"x.token = y.token and x.zone_id = y.zone_id and x.category = y.category and x.article_id < y.article_id and x.norm <> y.norm and abs(unix_timestamp(x.seen) - unix_timestamp(y.seen)) <= {BAND * 3600}"
    )
    both, union = F.size(F.array_intersect("x.t", "y.t")), F.size(F.array_union("x.t", "y.t"))
    return x.join(y, near).filter(100 * both >= ALIKE * union).select(F.col("x.article_id").alias("a"), F.col("y.article_id").alias("b")).distinct()


def linked(rows: DataFrame) -> DataFrame:
    """Links (a, b) that join what is one event: equal titles within BAND hours and similar titles, both of one zone and
    category, and equal URLs of a zone, whenever and whatever.  Equal ones are linked to their neighbour only."""
    by = lambda c, *key: F.lag(c).over(Window.partitionBy(*key).orderBy("seen", "article_id"))
    title = ("zone_id", "category", "norm")
    gap = F.unix_timestamp("seen") - F.unix_timestamp(by("seen", *title))
    near = F.when(gap <= BAND * 3600, by("article_id", *title))
    before = rows.select("article_id", near.alias("x"), by("article_id", "zone_id", "canonical_url").alias("y"))
    ends = before.select("article_id", F.explode(F.array_compact(F.array("x", "y"))).alias("b"))
    return ends.select(F.col("article_id").alias("a"), "b").union(similar_titles(representatives(rows)))


def clusters(rows: DataFrame) -> DataFrame:
    """(article_id, cluster) of prepared articles: cluster is the smallest article id of the event."""
    found = components(linked(rows))
    return rows.join(found, rows.article_id == found.node, "left").select("article_id", F.coalesce("component", "article_id").alias("cluster"))


def cluster_facts(rows: DataFrame, now: Column, found: DataFrame | None = None) -> DataFrame:
    """A row for each event: zone, members, domains, severity, its decay, and the representative and stable id.

    The category is that of the most severe member; the representative is the most severe one with the shortest title.
    ``found``: the rows' clusters, if they are known.
    """
    worst = F.max(F.struct("severity", (-F.col("size")).alias("s"), (-F.col("article_id")).alias("i"), "category"))
    joined = rows.join(clusters(rows) if found is None else found, "article_id")
    events = joined.groupBy("zone_id", "cluster").agg(
        F.count("*").alias("members"), F.array_sort(F.collect_set("domain")).alias("domains"), F.max("seen").alias("last_seen"), F.min("content_hash").alias("cluster_id"), worst.alias("w")
    )
    hours = (F.unix_timestamp(now) - F.unix_timestamp("last_seen")) / 3600
    effective = F.round(F.col("w.severity") * freshness(hours, HALF_LIFE) + 1e-10, 4)
    return events.select("zone_id", "cluster", "cluster_id", "members", "domains", "last_seen", F.col("w.category").alias("category"), F.col("w.severity").alias("severity"), (-F.col("w.i")).alias("representative"), effective.alias("effective"))


def confidence(n: Column, domains: Column, share: Column | None = None) -> Column:
    """Grows with the number of events and of domains up to three of each, and with the share that has a category."""
    third = lambda x: F.least(x / 3, F.lit(1.0))
    base = 0.45 + (0.3 if share is None else 0.25) * third(n) + 0.2 * third(domains)
    return F.least(F.lit(0.95), base if share is None else base + 0.1 * share)


def zone_scores(rows: DataFrame, now: Column) -> DataFrame:
    """Per zone: score, level, confidence, and the numbers of its articles and events; unclassified events don't score."""
    events = cluster_facts(rows, now)
    known = F.col("category") != "other"
    facts = events.groupBy("zone_id").agg(
        top3_blend(F.when(known, F.col("effective"))).alias("score"),
        F.count("*").alias("clusters"),
        F.count_if(known).alias("scored"),
        F.size(F.array_distinct(F.flatten(F.collect_list(F.when(known, F.col("domains")))))).alias("domains"),
    )
    counts = rows.groupBy("zone_id").agg(F.count("*").alias("articles"), F.avg(known.cast("int")).alias("share"))
    score = F.col("score")
    level = F.when(score.isNull(), "UNKNOWN").when(score >= 0.8, "CRITICAL").when(score >= 0.6, "HIGH").when(score >= 0.35, "MEDIUM").otherwise("LOW")
    sure = F.when(score.isNotNull(), rounded(confidence(F.col("scored"), F.col("domains"), F.col("share")), 4))
    return facts.join(counts, "zone_id").select("zone_id", "articles", "clusters", rounded(score, 4).alias("score"), level.alias("level"), sure.alias("confidence"))


def decisions(rows: DataFrame, now: Column) -> DataFrame:
    """Per zone and decision factor with an event of its categories: score, confidence, newest sight."""
    factor = F.coalesce(*[F.when(F.col("category").isin(*cs), f) for f, cs in DECISIONS.items()])
    events = cluster_facts(rows, now).withColumn("factor", factor).filter("factor is not null")
    domains = F.size(F.array_distinct(F.flatten(F.collect_list("domains"))))
    return events.groupBy("zone_id", "factor").agg(
        rounded(top3_blend("effective"), 4).alias("score"), rounded(confidence(F.count("*"), domains), 4).alias("confidence"), F.count("*").alias("clusters"), F.max("last_seen").alias("observed_at")
    )


#: The other engine's text: prepared articles, their links, events by reachability, and facts of events.
PREPARED = f"""h AS ({HITS}), g AS (SELECT article_id, max(severity) AS severity, arg_min(category, priority - 1000 * severity) AS category FROM h GROUP BY article_id),
p0 AS (SELECT n.article_id, n.zone_id, n.domain, s.seen AS seen, n.url, {NORMAL.format(x='n.title')} AS norm, {TOKENS.format(x='n.title')} AS t, coalesce(g.category, 'other') AS category,
  coalesce(g.severity, 0.25e0) AS severity, length(n.title) AS size FROM news n JOIN {SEEN} s ON s.article_id = n.article_id LEFT JOIN g ON g.article_id = n.article_id WHERE s.seen IS NOT NULL),
p AS (SELECT * FROM p0 WHERE NOT EXISTS (SELECT 1 FROM p0 x WHERE x.zone_id = p0.zone_id AND x.url = p0.url AND x.norm = p0.norm AND x.article_id < p0.article_id)),
pairs AS (SELECT x.article_id AS a, y.article_id AS b FROM p x JOIN p y ON x.zone_id = y.zone_id AND x.category = y.category AND x.article_id < y.article_id AND abs(epoch(x.seen) - epoch(y.seen)) <= {BAND * 3600}
  WHERE x.norm = y.norm OR len(x.t) > 0 AND len(y.t) > 0 AND 100 * len(list_intersect(x.t, y.t)) >= {ALIKE} * len(list_distinct(list_concat(x.t, y.t))))"""
EVENTS = f"""{PREPARED}, links AS (SELECT a, b FROM pairs UNION SELECT x.article_id, y.article_id FROM p x JOIN p y ON x.zone_id = y.zone_id AND x.url = y.url AND x.article_id < y.article_id),
ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links), reach AS (SELECT article_id AS a, article_id AS b FROM p UNION SELECT r.a, l.b FROM reach r JOIN ways l ON r.b = l.a),
c AS (SELECT a AS article_id, min(b) AS cluster FROM reach GROUP BY a)"""
FACTS = f"""{EVENTS}, m AS (SELECT p.*, c.cluster, row_number() OVER (PARTITION BY c.cluster ORDER BY severity DESC, size, p.article_id) AS r FROM p JOIN c ON p.article_id = c.article_id),
f AS (SELECT zone_id, cluster, max(CASE WHEN r = 1 THEN category END) AS category, max(severity) AS severity, max(seen) AS last_seen, CAST(count(*) AS BIGINT) AS members, max(CASE WHEN r = 1 THEN article_id END) AS representative,
  round(max(severity) * pow(0.5e0, greatest(epoch({NEWS_NOW}) - epoch(max(seen)), 0) / 86400.0e0) + 1e-10, 4) AS effective FROM m GROUP BY zone_id, cluster),
d AS (SELECT DISTINCT m.zone_id, m.cluster, m.domain, f.category FROM m JOIN f ON m.cluster = f.cluster)"""


def now_() -> Column:
    return F.expr(NEWS_NOW).cast("timestamp")


@operator(f"""WITH {PREPARED}, first AS (SELECT zone_id, category, norm, seen, min(article_id) AS r FROM p GROUP BY zone_id, category, norm, seen)
SELECT a, b, 'similar' AS kind FROM pairs WHERE a IN (SELECT r FROM first) AND b IN (SELECT r FROM first)
UNION ALL SELECT f.r, p.article_id, 'member' FROM p JOIN first f ON f.zone_id = p.zone_id AND f.category = p.category AND f.norm = p.norm AND f.seen = p.seen WHERE f.r <> p.article_id""")
def near_duplicate_pairs(t: Net) -> DataFrame:
    """Pairs of articles of a zone and category within 48 hours with equal or similar titles: all pairs between
    representatives, and each other article with its own."""
    rows = prepared(t.news, now_())
    reps = representatives(rows)
    key = ["zone_id", "category", "norm"]
    member = rows.join(reps.select(*key, "seen", F.col("article_id").alias("a")), [*key, "seen"]).filter("a <> article_id").select("a", F.col("article_id").alias("b"), F.lit("member").alias("kind"))
    x, y = reps.alias("x"), reps.alias("y")
    near = F.expr(f"x.article_id < y.article_id and abs(unix_timestamp(x.seen) - unix_timestamp(y.seen)) <= {BAND * 3600}")
    same = x.join(y, near & (F.col("x.zone_id") == F.col("y.zone_id")) & (F.col("x.norm") == F.col("y.norm")) & (F.col("x.category") == F.col("y.category")))
    alike = same.select(F.col("x.article_id").alias("a"), F.col("y.article_id").alias("b")).union(similar_titles(reps))
    return alike.withColumn("kind", F.lit("similar")).union(member)


@operator(f"WITH RECURSIVE {FACTS} SELECT m.article_id, m.cluster, f.representative, f.category, f.members FROM m JOIN f ON m.cluster = f.cluster")
def event_clusters(t: Net) -> DataFrame:
    rows = prepared(t.news, now_())
    found = clusters(rows)
    facts = cluster_facts(rows, now_(), found).select("cluster", "representative", "category", "members")
    return found.join(facts, "cluster").select("article_id", "cluster", "representative", "category", "members")


@operator(f"""WITH RECURSIVE {FACTS}, r3 AS (SELECT zone_id, effective, row_number() OVER (PARTITION BY zone_id ORDER BY effective DESC) AS k FROM f WHERE category <> 'other'),
s AS (SELECT zone_id, least(1.0e0, 0.7e0 * max(effective) + 0.3e0 * sum(effective) / count(*)) AS score FROM r3 WHERE k <= 3 GROUP BY zone_id),
n AS (SELECT zone_id, CAST(count(*) AS BIGINT) AS clusters, count(CASE WHEN category <> 'other' THEN 1 END) AS scored FROM f GROUP BY zone_id),
a AS (SELECT p.zone_id, CAST(count(*) AS BIGINT) AS articles, count(CASE WHEN category <> 'other' THEN 1 END) / (count(*) * 1.0e0) AS share FROM p GROUP BY p.zone_id),
e AS (SELECT zone_id, count(DISTINCT domain) AS domains FROM d WHERE category <> 'other' GROUP BY zone_id)
SELECT n.zone_id, a.articles, n.clusters, round(s.score + 1e-10, 4) AS score, CASE WHEN s.score IS NULL THEN 'UNKNOWN' WHEN s.score >= 0.8e0 THEN 'CRITICAL' WHEN s.score >= 0.6e0 THEN 'HIGH' WHEN s.score >= 0.35e0 THEN 'MEDIUM' ELSE 'LOW' END AS level,
  CASE WHEN s.score IS NOT NULL THEN round(least(0.95e0, 0.45e0 + 0.25e0 * least(1.0e0, n.scored / 3.0e0) + 0.2e0 * least(1.0e0, e.domains / 3.0e0) + 0.1e0 * a.share) + 1e-10, 4) END AS confidence
FROM n JOIN a ON n.zone_id = a.zone_id LEFT JOIN s ON s.zone_id = n.zone_id LEFT JOIN e ON e.zone_id = n.zone_id""")
def zone_news_score(t: Net) -> DataFrame:
    return zone_scores(prepared(t.news, now_()), now_())


DECIDED = f"""{FACTS}, k AS (SELECT *, CASE WHEN category = 'conflict' THEN 'war' WHEN category = 'natural_disaster' THEN category WHEN category IN ('sanction', 'trade_policy', 'tariff') THEN 'trade_policy' END AS factor FROM f),
r3 AS (SELECT *, row_number() OVER (PARTITION BY zone_id, factor ORDER BY effective DESC) AS place FROM k WHERE factor IS NOT NULL),
dd AS (SELECT k.zone_id, k.factor, count(DISTINCT d.domain) AS domains FROM k JOIN d ON d.cluster = k.cluster WHERE factor IS NOT NULL GROUP BY k.zone_id, k.factor),
z AS (SELECT r3.zone_id, r3.factor, round(least(1.0e0, 0.7e0 * max(effective) + 0.3e0 * sum(CASE WHEN place <= 3 THEN effective END) / least(count(*), 3)) + 1e-10, 4) AS score,
  round(least(0.95e0, 0.45e0 + 0.3e0 * least(1.0e0, count(*) / 3.0e0) + 0.2e0 * least(1.0e0, max(dd.domains) / 3.0e0)) + 1e-10, 4) AS confidence, CAST(count(*) AS BIGINT) AS clusters
  FROM r3 JOIN dd ON dd.zone_id = r3.zone_id AND dd.factor = r3.factor GROUP BY r3.zone_id, r3.factor)"""


@operator(f"WITH RECURSIVE {DECIDED} SELECT zone_id, factor, score, confidence, clusters FROM z")
def decision_factors(t: Net) -> DataFrame:
    return decisions(prepared(t.news, now_()), now_()).select("zone_id", "factor", "score", "confidence", "clusters")


@operator(f"""WITH RECURSIVE {DECIDED} SELECT segment_id, factor, zone_id, score FROM (SELECT s.segment_id, z.factor, z.zone_id, z.score,
  row_number() OVER (PARTITION BY s.segment_id, z.factor ORDER BY z.score DESC, z.zone_id) AS place FROM segments s, unnest(string_split(s.zone_ids, '|')) AS u(zone) JOIN z ON z.zone_id = u.zone) x WHERE place = 1""")
def news_overlay(t: Net) -> DataFrame:
    """For each segment and decision factor the strongest score of the zones that it passes."""
    zones = t.segments.select("segment_id", F.explode(items("zone_ids")).alias("zone_id"))
    met = zones.join(F.broadcast(decisions(prepared(t.news, now_()), now_()).select("zone_id", "factor", "score")), "zone_id")
    best = met.groupBy("segment_id", "factor").agg(F.min(F.struct((-F.col("score")).alias("s"), "zone_id", "score")).alias("m"))
    return best.select("segment_id", "factor", "m.zone_id", "m.score")


@operator(f"""WITH RECURSIVE {EVENTS}, want AS (SELECT article_id AS k, cluster AS v FROM c), have AS (SELECT article_id AS k, article_id AS v, article_id % 11 <> 0 AS active FROM news WHERE article_id % 3 <> 1)
SELECT coalesce(want.k, have.k) AS article_id, CASE WHEN have.k IS NULL THEN 'insert' WHEN want.k IS NULL THEN 'deactivate' ELSE 'update' END AS action FROM want FULL JOIN have ON want.k = have.k
WHERE have.k IS NULL OR (want.k IS NULL AND have.active) OR (want.k IS NOT NULL AND (want.v <> have.v OR NOT have.active))""")
def news_migration_plan(t: Net) -> DataFrame:
    """What brings stored memberships of events to those of a new clustering."""
    want = clusters(prepared(t.news, now_())).select(F.col("article_id").alias("k"), F.col("cluster").alias("v"))
    have = t.news.filter("article_id % 3 <> 1").select(F.col("article_id").alias("k"), F.col("article_id").alias("v"), (F.col("article_id") % 11 != 0).alias("active"))
    return reconciled(have, want, "k", "v").withColumnRenamed("k", "article_id")
