"""Queries of filters, joins, aggregations, ranking and pages over stories."""

from __future__ import annotations

from pyspark.sql import functions as F

from storyline.functions import fixed
from storyline.functions.urls import bare_host
from storyline.operators import feed as S
from storyline.operators import ranking as R
from storyline.operators.candidates import candidate_stories
from storyline.operators.feed import FeedQuery
from storyline.operators.mutations import A8_SETS, feature_rollup
from storyline.plans import bindings as B
from storyline.plans import oracle_text as O
from storyline.plans.q_outlets import OUTLETS_CTE, ordered_distinct, outlets  # noqa: F401
from storyline.plans.registry import query

PUBLISHED = (
    "publication_state = 'published' AND state <> 'merged' AND cleared_at IS NULL AND thread_id IS NOT NULL"
)
ST = f"WITH {B.STORIES_CTE}"
SO = ST + f", outlets AS (SELECT *, {O.outlet_columns('publisher', 'url')} FROM articles)"
NOW_SQL = f"TIMESTAMP '{B.NOW}'"


def now():
    return F.lit(B.NOW).cast("timestamp")


def hours_ago(n: int):
    return now() - F.expr(f"INTERVAL {n} HOURS")


def ids(df):
    return df.select("story_id", "title", "state", F.unix_micros("last_updated_at").alias("updated_us"))


IDS_SQL = "story_id, title, state, epoch_us(last_updated_at) AS updated_us"


@query("f1_published_stories", f"{ST} SELECT {IDS_SQL} FROM stories WHERE {PUBLISHED}")
def f1(spark, sf_dir):
    return ids(B.stories(spark, sf_dir).filter(S.is_published()))


@query(
    "f2_search",
    f"""{ST} SELECT {IDS_SQL} FROM stories s WHERE {PUBLISHED} AND (contains(lower(title), 'fed') OR EXISTS
    (SELECT 1 FROM articles a WHERE a.story_id = s.story_id AND contains(lower(a.publisher), 'fed')))
    UNION ALL SELECT {IDS_SQL} FROM stories s WHERE {PUBLISHED} AND (contains(lower(title), 'news') OR EXISTS
    (SELECT 1 FROM articles a WHERE a.story_id = s.story_id AND contains(lower(a.publisher), 'news')))""",
)
def f2(spark, sf_dir):
    st, ar = B.stories(spark, sf_dir).filter(S.is_published()), B.articles(spark, sf_dir)
    return ids(S.search(st, ar, " Fed ")).unionAll(ids(S.search(st, ar, "NEWS")))


@query(
    "f3_tag_filter",
    f"{ST} SELECT {IDS_SQL} FROM stories WHERE {PUBLISHED} AND list_has_any(tags, ['AI', 'Markets'])",
)
def f3(spark, sf_dir):
    return ids(S.with_tags(B.stories(spark, sf_dir).filter(S.is_published()), ("AI", " Markets", "")))


@query(
    "f4_source_filter",
    f"{SO} SELECT {IDS_SQL} FROM stories WHERE {PUBLISHED} AND story_id IN (SELECT story_id FROM outlets WHERE outlet = 'Reuters')",
)
def f4(spark, sf_dir):
    st = B.stories(spark, sf_dir).filter(S.is_published())
    return ids(S.with_source(st, B.articles(spark, sf_dir), "Reuters"))


@query(
    "f5_bias_filter",
    f"""{SO} SELECT {IDS_SQL} FROM stories WHERE {PUBLISHED} AND story_id IN
    (SELECT story_id FROM outlets WHERE bias IN ('left', 'center-left'))""",
)
def f5(spark, sf_dir):
    st = B.stories(spark, sf_dir).filter(S.is_published())
    return ids(S.with_bias(st, B.articles(spark, sf_dir), "Left"))


@query(
    "f6_due_feeds",
    f"""WITH {B.ITEMS_CTE}, {B.FEEDS_CTE} SELECT feed_id, name, epoch_us(next_poll_at) AS next_us FROM feeds
    WHERE state = 'active' AND next_poll_at <= TIMESTAMP '2024-01-09 12:00:00' ORDER BY next_poll_at, feed_id""",
)
def f6(spark, sf_dir):
    due = B.feeds(spark, sf_dir).filter(
        (F.col("state") == "active") & (F.col("next_poll_at") <= F.lit("2024-01-09 12:00:00").cast("timestamp"))
    )
    return due.orderBy("next_poll_at", "feed_id").select(
        "feed_id", "name", F.unix_micros("next_poll_at").alias("next_us")
    )


# --- significance -----------------------------------------------------------------------
def _score_sql() -> str:
    topics = " + ".join(
        f"least({O.hits('txt', terms)}, 2) * {w}" for terms, w in fixed.TOPIC_WEIGHTS
    )
    state = "CASE state " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in fixed.STATE_BONUS.items()) + " END"
    return f"""CAST(least(source_count, 4) * 16 + least(greatest(article_count - source_count, 0), 2) + {state} + {topics}
     - CASE WHEN {O.any_of('txt', fixed.FORECAST_TERMS)} THEN 44 ELSE 0 END
     - CASE WHEN list_contains(tags, 'Sports') OR {O.any_of('txt', fixed.ROUTINE_SPORTS_TERMS)} THEN 70 ELSE 0 END
     - CASE WHEN {O.any_of('txt', fixed.LOW_IMPACT_TERMS)} THEN 40 ELSE 0 END
     - CASE WHEN {O.any_of('txt', fixed.NO_ACTION_TERMS)} THEN 24 ELSE 0 END AS BIGINT)"""


RANK_CTE = f"""{B.STORIES_CTE},
 counted AS (SELECT story_id, count(DISTINCT lower(publisher)) AS source_count, count(*) AS article_count
   FROM articles GROUP BY story_id),
 texts AS (SELECT s.*, source_count, article_count, {O.fold("(title || ' ' || summary)")} AS txt
   FROM stories s JOIN counted USING (story_id)),
 scored AS (SELECT *, {_score_sql()} AS score FROM texts),
 gated AS (SELECT *, NOT {O.any_of('txt', fixed.LOW_IMPACT_TERMS)} AND NOT list_contains(tags, 'Sports')
     AND NOT {O.any_of('txt', fixed.ROUTINE_SPORTS_TERMS)}
     AND (NOT {O.any_of('txt', fixed.FORECAST_TERMS)} OR source_count >= 3) AND score >= 20 AS worthy,
     score >= 30 AND NOT list_contains(tags, 'Sports') AND NOT {O.any_of('txt', fixed.ROUTINE_SPORTS_TERMS)}
     AND (NOT {O.any_of('txt', fixed.FORECAST_TERMS)} OR source_count >= 3) AS eligible FROM scored)"""


def ranked(spark, sf_dir):
    counts = B.articles(spark, sf_dir).groupBy("story_id").agg(
        F.countDistinct(F.lower("publisher")).alias("source_count"),
        F.count(F.lit(1)).alias("article_count"),
    )
    return R.with_significance(B.stories(spark, sf_dir).join(counts, "story_id"))


@query("w1_significance_score", f"WITH {RANK_CTE} SELECT story_id, source_count, article_count, score FROM gated")
def w1(spark, sf_dir):
    return ranked(spark, sf_dir).select("story_id", "source_count", "article_count", "score")


@query("f7_publication_worthiness", f"WITH {RANK_CTE} SELECT story_id, worthy FROM gated")
def f7(spark, sf_dir):
    return ranked(spark, sf_dir).select("story_id", "worthy")


@query("f8_weekly_eligibility", f"WITH {RANK_CTE} SELECT story_id, score FROM gated WHERE eligible")
def f8(spark, sf_dir):
    return ranked(spark, sf_dir).filter("eligible").select("story_id", "score")


# --- selections ---------------------------------------------------------------------------
SUMMARISING = f"{ST}, {B.FEEDS_CTE}, wants AS (SELECT DISTINCT story_id FROM articles JOIN feeds USING (feed_id) WHERE summarization_enabled)"


def summarising_articles(spark, sf_dir):
    on = B.feeds(spark, sf_dir).filter("summarization_enabled").select("feed_id")
    return B.articles(spark, sf_dir).join(on, "feed_id", "left_semi")


@query(
    "f10_needs_analysis",
    f"""{SUMMARISING} SELECT {IDS_SQL} FROM stories WHERE {PUBLISHED} AND analysis_state IN ('disabled', 'failed')
    AND story_id IN (SELECT story_id FROM wants) ORDER BY last_updated_at DESC, story_id DESC LIMIT 100""",
)
def f10(spark, sf_dir):
    st = B.stories(spark, sf_dir).filter(S.is_published() & F.col("analysis_state").isin("disabled", "failed"))
    need = st.join(summarising_articles(spark, sf_dir), "story_id", "left_semi")
    return ids(need.orderBy(F.desc("last_updated_at"), F.desc("story_id")).limit(100))


@query(
    "f11_summaries_enabled",
    f"""{ST}, {B.FEEDS_CTE} SELECT a.story_id, bool_or(f.summarization_enabled) AS enabled
    FROM articles a JOIN feeds f USING (feed_id) GROUP BY a.story_id""",
)
def f11(spark, sf_dir):
    f = B.feeds(spark, sf_dir).select("feed_id", "summarization_enabled")
    return B.articles(spark, sf_dir).join(f, "feed_id").groupBy("story_id").agg(
        F.bool_or("summarization_enabled").alias("enabled")
    )


@query(
    "f12_pending_recovery",
    f"""{ST} SELECT {IDS_SQL} FROM stories WHERE publication_state = 'pending' AND state <> 'merged'
    AND cleared_at IS NULL AND thread_id IS NULL ORDER BY created_at, story_id LIMIT 100""",
)
def f12(spark, sf_dir):
    st = B.stories(spark, sf_dir).filter(
        "publication_state = 'pending' AND state <> 'merged' AND cleared_at IS NULL AND thread_id IS NULL"
    )
    return ids(st.orderBy("created_at", "story_id").limit(100))


@query(
    "f13_presentation_stale",
    f"""{ST} SELECT * FROM (SELECT 'stale' AS kind, {IDS_SQL} FROM stories WHERE {PUBLISHED} AND presentation_version < 10
      AND forum = 'en' ORDER BY last_updated_at DESC, story_id DESC LIMIT 100)
    UNION ALL SELECT * FROM (SELECT 'forced' AS kind, {IDS_SQL} FROM stories WHERE {PUBLISHED}
      ORDER BY last_updated_at DESC, story_id DESC LIMIT 100)""",
)
def f13(spark, sf_dir):
    st = B.stories(spark, sf_dir).filter(S.is_published())
    newest = [F.desc("last_updated_at"), F.desc("story_id")]
    stale = st.filter("presentation_version < 10 AND forum = 'en'").orderBy(*newest).limit(100)
    forced = st.orderBy(*newest).limit(100)
    return ids(stale).select(F.lit("stale").alias("kind"), "*").unionAll(
        ids(forced).select(F.lit("forced").alias("kind"), "*")
    )


CLEANUP = f"cleared_at IS NULL AND thread_id IS NOT NULL AND state <> 'merged' AND last_updated_at < {NOW_SQL} - INTERVAL 7 DAY"


@query("f14_cleanup_selection", f"{ST} SELECT {IDS_SQL} FROM stories WHERE {CLEANUP} ORDER BY last_updated_at, story_id LIMIT 25")
def f14(spark, sf_dir):
    old = B.stories(spark, sf_dir).filter(
        F.col("cleared_at").isNull() & F.col("thread_id").isNotNull() & (F.col("state") != "merged")
        & (F.col("last_updated_at") < hours_ago(168))
    )
    return ids(old.orderBy("last_updated_at", "story_id").limit(25))


@query(
    "f15_reprocess_eligibility",
    f"""{ST} SELECT article_id, CASE WHEN s.story_id IS NULL THEN 'article not found or not clustered'
      WHEN a.delivery_state = 'uncertain' THEN 'uncertain writes cannot be retried automatically'
      WHEN a.delivery_state <> 'failed' AND s.analysis_state <> 'failed'
        THEN 'only confirmed delivery or analysis failures can be reprocessed' END AS refusal
    FROM articles a LEFT JOIN stories s USING (story_id)""",
)
def f15(spark, sf_dir):
    st = B.stories(spark, sf_dir).select("story_id", "analysis_state", F.lit(True).alias("found"))
    refusal = (
        F.when(F.col("found").isNull(), "article not found or not clustered")
        .when(F.col("delivery_state") == "uncertain", "uncertain writes cannot be retried automatically")
        .when(
            (F.col("delivery_state") != "failed") & (F.col("analysis_state") != "failed"),
            "only confirmed delivery or analysis failures can be reprocessed",
        )
    )
    return B.articles(spark, sf_dir).join(st, "story_id", "left").select("article_id", refusal.alias("refusal"))


@query(
    "f16_maintenance_selection",
    f"""{ST} SELECT {IDS_SQL} FROM stories WHERE state <> 'merged' AND cleared_at IS NULL AND publication_state <> 'uncertain'
    AND last_updated_at >= {NOW_SQL} - INTERVAL 72 HOUR ORDER BY last_updated_at DESC, story_id DESC LIMIT 50""",
)
def f16(spark, sf_dir):
    st = B.stories(spark, sf_dir).filter(
        (F.col("state") != "merged") & F.col("cleared_at").isNull()
        & (F.col("publication_state") != "uncertain") & (F.col("last_updated_at") >= hours_ago(72))
    )
    return ids(st.orderBy(F.desc("last_updated_at"), F.desc("story_id")).limit(50))


# --- pages and points -------------------------------------------------------------------------
FEED_QUERY = FeedQuery(limit=15, search="e", bias="")
PAGE_CURSOR = ("2024-01-08 00:00:00", 100000)


@query(
    "w3_keyset_page",
    f"""{ST}, p AS (SELECT *, row_number() OVER (ORDER BY last_updated_at DESC, story_id DESC) AS position,
      count(*) OVER () > 15 AS has_more FROM stories s WHERE {PUBLISHED} AND (contains(lower(title), 'e') OR EXISTS
      (SELECT 1 FROM articles a WHERE a.story_id = s.story_id AND contains(lower(a.publisher), 'e')))
      AND (last_updated_at < TIMESTAMP '{PAGE_CURSOR[0]}' OR (last_updated_at = TIMESTAMP '{PAGE_CURSOR[0]}' AND story_id < {PAGE_CURSOR[1]})))
    SELECT story_id, CAST(position AS INTEGER) AS position, has_more,
      CASE WHEN has_more AND position = 15 THEN translate(replace(base64(encode('["' ||
       strftime(last_updated_at, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(last_updated_at) % 1000000 = 0 THEN '' ELSE '.' ||
       lpad(CAST(epoch_us(last_updated_at) % 1000000 AS VARCHAR), 6, '0') END || '+00:00",' || CAST(story_id AS VARCHAR) || ']')),
       '=', ''), '+/', '-_') END AS next_cursor FROM p WHERE position <= 15""",
)
def w3(spark, sf_dir):
    found = S.browse(B.stories(spark, sf_dir), B.articles(spark, sf_dir), FEED_QUERY)
    return S.page(found, FEED_QUERY.limit, PAGE_CURSOR).select("story_id", "position", "has_more", "next_cursor")


@query(
    "w4_latest_published",
    f"{ST} SELECT {IDS_SQL} FROM stories WHERE {PUBLISHED} ORDER BY last_updated_at DESC, story_id DESC LIMIT 50",
)
def w4(spark, sf_dir):
    st = B.stories(spark, sf_dir).filter(S.is_published())
    return ids(st.orderBy(F.desc("last_updated_at"), F.desc("story_id")).limit(50))


@query(
    "w5_article_order",
    f"{ST} SELECT story_id, arg_max(article_id, (published_at, article_id)) AS article_id, count(*) AS articles FROM articles GROUP BY story_id",
)
def w5(spark, sf_dir):
    return S.newest_articles(B.articles(spark, sf_dir))


@query(
    "w6_primary_article",
    f"""{ST} SELECT story_id, article_id, priority FROM articles
    QUALIFY row_number() OVER (PARTITION BY story_id ORDER BY priority DESC, published_at, article_id) = 1""",
)
def w6(spark, sf_dir):
    return S.primary_articles(B.articles(spark, sf_dir))


@query(
    "w7_backfill_cap",
    f"""WITH {B.ITEMS_CTE} SELECT feed_id, article_id, CASE WHEN row_number() OVER
      (PARTITION BY feed_id ORDER BY published_at DESC, article_id DESC) > 3 THEN 'skipped' ELSE 'process' END AS outcome FROM items""",
)
def w7(spark, sf_dir):
    return backfill(B.items(spark, sf_dir), 3)


def backfill(items, keep: int):
    """Outcome per item of a first poll: the newest ``keep`` per feed are processed.

    A feed may hold a third of all items, so nothing is ranked within a feed beyond the few that
    stay: their boundary comes from a group limit pushed below the shuffle, and every item is
    then compared with its feed's boundary.
    """
    from pyspark.sql import Window as W

    if not 1 <= keep <= 25:
        raise ValueError("backfill must be between 1 and 25")
    key = F.struct("published_at", "article_id")
    rank = F.row_number().over(
        W.partitionBy("feed_id").orderBy(F.desc("published_at"), F.desc("article_id"))
    )
    edge = (
        items.select("feed_id", "published_at", "article_id", rank.alias("r"))
        .filter(F.col("r") <= keep).groupBy("feed_id").agg(F.min(key).alias("edge"))
    )
    return items.join(edge, "feed_id").select(
        "feed_id", "article_id",
        F.when(key >= F.col("edge"), "process").otherwise("skipped").alias("outcome"),
    )


@query(
    "w12_published_story",
    f"{ST} SELECT {IDS_SQL}, array_to_string(tags, '|') AS tags FROM stories WHERE {PUBLISHED} AND story_id = 1",
)
def w12(spark, sf_dir):
    one = B.stories(spark, sf_dir).filter(S.is_published() & (F.col("story_id") == 1))
    return one.select(
        "story_id", "title", "state", F.unix_micros("last_updated_at").alias("updated_us"),
        F.array_join("tags", "|").alias("tags"),
    )


CONTEXT_AGE = 259200


@query(
    "w9_message_context",
    f"""WITH m AS (SELECT event_id AS message_id, user_id AS channel, CASE WHEN event_id % 3 = 0 THEN 'a' ELSE event_type END AS author,
      ts, CASE WHEN event_id % 17 = 0 THEN '' ELSE event_type || ' ' || repeat('x', CAST(event_id % 1900 AS INTEGER)) END AS text FROM events),
    l AS (SELECT *, {', '.join(f"lag(author, {k}) OVER w AS a{k}, lag(ts, {k}) OVER w AS t{k}, lag(text, {k}) OVER w AS x{k}" for k in range(1, 5))}
      FROM m WINDOW w AS (PARTITION BY channel ORDER BY message_id)),
    o AS (SELECT *, coalesce(a1 = author AND epoch_us(ts) - epoch_us(t1) <= {CONTEXT_AGE}000000 AND x1 <> '' AND length(x1) <= 4000, false) AS o1 FROM l),
    o2 AS (SELECT *, coalesce(o1 AND a2 = author AND epoch_us(ts) - epoch_us(t2) <= {CONTEXT_AGE}000000 AND x2 <> '' AND length(x1) + length(x2) <= 4000, false) AS o2 FROM o),
    o3 AS (SELECT *, coalesce(o2 AND a3 = author AND epoch_us(ts) - epoch_us(t3) <= {CONTEXT_AGE}000000 AND x3 <> '' AND length(x1) + length(x2) + length(x3) <= 4000, false) AS o3 FROM o2),
    o4 AS (SELECT *, coalesce(o3 AND a4 = author AND epoch_us(ts) - epoch_us(t4) <= {CONTEXT_AGE}000000 AND x4 <> '' AND length(x1) + length(x2) + length(x3) + length(x4) <= 4000, false) AS o4 FROM o3)
    SELECT message_id, channel, author, CAST(CAST(o1 AS INTEGER) + CAST(o2 AS INTEGER) + CAST(o3 AS INTEGER) + CAST(o4 AS INTEGER) AS INTEGER) AS messages,
      sha256(concat_ws(chr(10), CASE WHEN o4 THEN x4 END, CASE WHEN o3 THEN x3 END, CASE WHEN o2 THEN x2 END, CASE WHEN o1 THEN x1 END)) AS context_sha FROM o4""",
)
def w9(spark, sf_dir):
    e = F.col("event_id")
    msgs = B.read(spark, sf_dir, "events").select(
        e.alias("message_id"), F.col("user_id").alias("channel"),
        F.when(e % 3 == 0, "a").otherwise(F.col("event_type")).alias("author"),
        F.col("ts").alias("created_at"),
        F.when(e % 17 == 0, "").otherwise(
            F.concat("event_type", F.lit(" "), F.repeat(F.lit("x"), (e % 1900).cast("int")))
        ).alias("text"),
    )
    return S.message_context(msgs, age_seconds=CONTEXT_AGE).select(
        "message_id", "channel", "author", F.size("context").alias("messages"),
        F.sha2(F.array_join("context", "\n"), 256).alias("context_sha"),
    )


# --- joins ----------------------------------------------------------------------------------------
@query(
    "j1_candidate_window",
    f"""{ST} SELECT a.article_id, count(s.story_id) AS candidates, max(epoch_us(s.last_updated_at)) AS newest_us
    FROM articles a LEFT JOIN stories s ON s.forum = a.forum AND s.state <> 'merged'
      AND s.last_updated_at >= a.published_at - INTERVAL 72 HOUR GROUP BY a.article_id""",
)
def j1(spark, sf_dir):
    return candidate_counts(B.articles(spark, sf_dir), B.stories(spark, sf_dir), hours=72)


@query(
    "j1_candidate_stories",
    f"""{ST} SELECT a.article_id, s.story_id, epoch_us(s.last_updated_at) AS updated_us FROM articles a JOIN stories s ON s.guild_id = a.article_id // 3 % 2 + 1 AND s.forum = a.forum
      AND s.state <> 'merged' AND s.last_updated_at >= a.published_at - INTERVAL 72 HOUR WHERE a.published_at >= {NOW_SQL} - INTERVAL 24 HOUR""",
)
def j1_rows(spark, sf_dir):
    """Each article of the last day with the stories of its guild and forum that it may join; two guilds share every forum."""
    new = B.articles(spark, sf_dir).filter(F.col("published_at") >= hours_ago(24)).withColumn("guild_id", F.floor(F.col("article_id") / 3) % 2 + 1)
    pairs = candidate_stories(new, B.stories(spark, sf_dir), hours=72)
    return pairs.select("article_id", "story_id", F.unix_micros("last_updated_at").alias("updated_us"))


def candidate_counts(articles, stories, hours: int):
    """How many live stories of its forum each article may join, and the newest of them.

    The window has no upper end, so pairs would grow with the square of a forum.  Counting
    needs none: stories are counted per (forum, hour); the tail over later hours is a running
    sum over hours; only the article's own cut-off hour is compared row by row.
    """
    from pyspark.sql import Window as W

    hour_us = 3600 * 10**6
    live = stories.filter("state <> 'merged'").select("forum", F.unix_micros("last_updated_at").alias("us"))
    live = live.withColumn("h", F.floor(F.col("us") / hour_us))
    cut = articles.select(
        "article_id", "forum", (F.unix_micros("published_at") - hours * hour_us).alias("us")
    ).withColumn("h", F.floor(F.col("us") / hour_us))
    per_hour = live.groupBy("forum", "h").agg(F.count(F.lit(1)).alias("n"), F.max("us").alias("top"))
    newest = per_hour.groupBy("forum").agg(F.max("top").alias("newest_us"), F.min("h").alias("h0"), F.max("h").alias("h1"))
    # Every hour between the first and the last, so that any cut-off finds its running sum.
    hours_df = newest.select("forum", F.explode(F.sequence("h0", "h1")).alias("h"))
    after = W.partitionBy("forum").orderBy(F.desc("h")).rowsBetween(W.unboundedPreceding, -1)
    tail = hours_df.join(per_hour, ["forum", "h"], "left").select(
        "forum", "h", F.coalesce(F.sum("n").over(after), F.lit(0)).alias("later"),
    )
    # Within the cut-off hour: stories and cut-offs in one ordered run per (forum, hour).
    mixed = live.select("forum", "h", "us", F.lit(None).cast("bigint").alias("article_id"), F.lit(1).alias("k")).unionByName(
        cut.select("forum", "h", "us", "article_id", F.lit(0).alias("k"))
    )
    onward = W.partitionBy("forum", "h").orderBy(F.desc("us"), F.desc("k"))
    same = mixed.withColumn("here", F.sum("k").over(onward)).filter("article_id IS NOT NULL")
    joined = same.join(tail, ["forum", "h"], "left").join(newest, "forum", "left")
    total = F.when(F.col("h") < F.col("h0"), F.lit(None)).otherwise(F.coalesce("later", F.lit(0)) + F.col("here"))
    everything = per_hour.groupBy("forum").agg(F.sum("n").alias("all_n"))
    return joined.join(everything, "forum", "left").select(
        "article_id",
        F.coalesce(total, "all_n", F.lit(0)).cast("bigint").alias("candidates"),
        F.when(F.col("newest_us") >= F.col("us"), F.col("newest_us")).alias("newest_us"),
    )


@query(
    "j3_semi_joins",
    f"""{SO}, {B.FEEDS_CTE} SELECT {IDS_SQL} FROM stories s WHERE {PUBLISHED}
    AND EXISTS (SELECT 1 FROM outlets o WHERE o.story_id = s.story_id AND bias IN ('official'))
    AND EXISTS (SELECT 1 FROM articles a JOIN feeds f USING (feed_id) WHERE a.story_id = s.story_id AND f.summarization_enabled)""",
)
def j3(spark, sf_dir):
    st = B.stories(spark, sf_dir).filter(S.is_published())
    st = S.with_bias(st, B.articles(spark, sf_dir), "official")
    return ids(st.join(summarising_articles(spark, sf_dir), "story_id", "left_semi"))


EDGES_CTE = """edges AS (SELECT least(a, b) AS low, greatest(a, b) AS high FROM (
   SELECT story_id AS a, CASE WHEN story_id % 2 = 0 THEN story_id + 1 + story_id % 3 ELSE story_id - 1 END AS b FROM stories)
   WHERE a <> b AND b >= 0 GROUP BY ALL)"""


def edges(spark, sf_dir):
    """Undirected relationships, each once as (low, high)."""
    s = F.col("story_id")
    other = F.when(s % 2 == 0, s + 1 + s % 3).otherwise(s - 1)
    return (
        B.stories(spark, sf_dir).select(F.least(s, other).alias("low"), F.greatest(s, other).alias("high"))
        .filter("low <> high AND low >= 0").distinct()
    )


@query(
    "j5_related_stories",
    f"""{ST}, {EDGES_CTE}, b AS (SELECT low AS story_id, high AS related_id FROM edges UNION ALL SELECT high, low FROM edges)
    SELECT b.story_id, b.related_id, epoch_us(s.last_updated_at) AS updated_us FROM b JOIN stories s
    ON s.story_id = b.related_id WHERE s.state <> 'merged'""",
)
def j5(spark, sf_dir):
    n = S.neighbours(edges(spark, sf_dir), B.stories(spark, sf_dir))
    return n.select("story_id", "related_id", F.unix_micros("last_updated_at").alias("updated_us"))


@query(
    "j6_story_updates",
    f"""{ST}, {B.HISTORY_CTE} SELECT h.story_id, h.history_id, h.article_id, h.action AS kind, epoch_us(h.created_at) AS recorded_us,
    nullif(h.detail->>'$.update', '') AS update_detail, a.publisher FROM history h JOIN articles a
    ON a.article_id = h.article_id AND a.story_id = h.story_id WHERE h.action IN ('major_update', 'source_added')""",
)
def j6(spark, sf_dir):
    u = S.story_updates(B.history(spark, sf_dir), B.articles(spark, sf_dir))
    return u.select(
        "story_id", "history_id", "article_id", "kind", F.unix_micros("recorded_at").alias("recorded_us"),
        "update_detail", "publisher",
    )


@query(
    "j8_relationship_candidates",
    f"""{ST}, pool AS (SELECT * FROM stories WHERE state <> 'merged' AND thread_id IS NOT NULL AND last_updated_at >= {NOW_SQL} - INTERVAL 72 HOUR)
    SELECT s.story_id, p.story_id AS related_id FROM stories s JOIN pool p ON p.guild_id = s.guild_id AND p.story_id <> s.story_id
    QUALIFY row_number() OVER (PARTITION BY s.story_id ORDER BY p.last_updated_at DESC, p.story_id DESC) <= 5""",
)
def j8(spark, sf_dir):
    return S.relationship_candidates(B.stories(spark, sf_dir), hours_ago(72), 5)


@query(
    "j10_feed_routing",
    f"""WITH {B.ITEMS_CTE}, {B.FEEDS_CTE}, p AS (SELECT page_id, 1 + page_id % 2 AS guild_id,
      CASE WHEN page_id % 3 = 0 THEN ['en', 'fr', 'de', 'es', 'xx'][CAST(page_id % 5 + 1 AS INTEGER)] END AS parent_forum,
      {O.bare_host(f"CASE WHEN page_id % 4 = 1 THEN 'https://www.' || {B.sql_pick(B.HOSTS, 'page_id')} || '/a' ELSE url END")} AS host FROM pages),
    f AS (SELECT *, {O.bare_host('source')} AS host FROM feeds WHERE state = 'active')
    SELECT page_id, coalesce(
      (SELECT arg_min(feed_id, name) FROM f WHERE f.guild_id = p.guild_id AND f.forum = p.parent_forum),
      (SELECT arg_min(feed_id, name) FROM f WHERE f.guild_id = p.guild_id AND f.host = p.host AND p.host <> ''),
      (SELECT arg_min(feed_id, name) FROM f WHERE f.guild_id = p.guild_id)) AS feed_id FROM p""",
)
def j10(spark, sf_dir):
    i = F.col("page_id")
    url = F.when(i % 4 == 1, F.concat(F.lit("https://www."), B.pick(B.HOSTS, i), F.lit("/a"))).otherwise(F.col("url"))
    pages = B.read(spark, sf_dir, "pages").select(
        "page_id", (1 + i % 2).alias("guild_id"),
        F.when(i % 3 == 0, B.pick(("en", "fr", "de", "es", "xx"), i)).alias("forum"),
        bare_host(url).alias("host"),
    )
    return route(pages, B.feeds(spark, sf_dir)).select("page_id", "feed_id")


def route(items, feeds):
    """Feed for an external item: parent forum, else same host, else the guild's first feed."""
    active = feeds.filter("state = 'active'").withColumn("host", bare_host(F.col("source")))

    def first(*keys):
        return active.groupBy(*keys).agg(F.min_by("feed_id", "name").alias("_".join(keys)))

    by_forum = first("guild_id", "forum")
    by_host = first("guild_id", "host").filter("host <> ''")
    any_feed = active.groupBy("guild_id").agg(F.min_by("feed_id", "name").alias("any_feed"))
    return (
        items.join(by_forum, ["guild_id", "forum"], "left")
        .join(by_host, ["guild_id", "host"], "left")
        .join(any_feed, "guild_id", "left")
        .withColumn("feed_id", F.coalesce("guild_id_forum", "guild_id_host", "any_feed"))
    )


DEST = "list_filter(list_transform(range(20), lambda t: {'id': t + 100, 'k': (t + k) % 3}), lambda x: x.k <> 0)"
DEST_CTE = f"""dest AS (SELECT forum, u.id AS tag_id, {B.sql_pick([t.upper() for t in fixed.TAG_CATALOG], 'u.id - 100')} AS name FROM (
   SELECT forum, unnest({DEST}) AS u FROM (SELECT forum, CAST(instr('en fr de es', forum) AS BIGINT) AS k FROM stories GROUP BY forum)))"""


def destination_tags(spark, sf_dir):
    """Tags installed per forum: two thirds of the catalogue, written in capitals."""
    forums = B.stories(spark, sf_dir).select("forum").distinct()
    t = F.explode(F.sequence(F.lit(0), F.lit(19))).alias("t")
    k = F.position(F.col("forum"), F.lit("en fr de es"))
    return (
        forums.select("forum", k.alias("k"), t).filter((F.col("t") + F.col("k")) % 3 != 0)
        .select("forum", (F.col("t") + 100).cast("bigint").alias("tag_id"),
                B.pick([x.upper() for x in fixed.TAG_CATALOG], F.col("t")).alias("name"))
    )


@query(
    "j11_tag_resolution",
    f"""{ST}, {DEST_CTE}, w AS (SELECT story_id, forum, generate_subscripts(x, 1) AS pos, unnest(x) AS want FROM (
      SELECT story_id, forum, [CAST(100 + story_id % 25 AS VARCHAR)] || tags AS x FROM stories)),
    m AS (SELECT w.story_id, min(pos) AS pos, d.name FROM w JOIN dest d ON d.forum = w.forum
      AND ((pos = 1 AND CAST(d.tag_id AS VARCHAR) = want) OR (pos > 1 AND lower(d.name) = lower(want))) GROUP BY ALL)
    SELECT s.story_id, coalesce((SELECT string_agg(name, '|' ORDER BY pos) FROM (SELECT * FROM m WHERE m.story_id = s.story_id ORDER BY pos LIMIT 5)), '') AS tags,
      CASE WHEN s.story_id % 2 = 0 AND NOT EXISTS (SELECT 1 FROM m WHERE m.story_id = s.story_id) THEN 'forum requires a tag but no configured tag exists there' END AS error
    FROM stories s""",
)
def j11(spark, sf_dir):
    st = B.stories(spark, sf_dir).withColumn("tag_ids", F.array((F.col("story_id") % 25 + 100)))
    st = st.withColumn("require_tag", F.col("story_id") % 2 == 0)
    return resolve_tags(st, destination_tags(spark, sf_dir))


def resolve_tags(stories, destination):
    """Installed tags of a story: by id first, then by name in any case; distinct, first five."""
    by_id = stories.select("story_id", "forum", F.posexplode("tag_ids").alias("pos", "tag_id"))
    by_name = stories.select(
        "story_id", "forum", F.posexplode(F.transform("tags", lambda t: F.lower(t))).alias("pos", "key")
    )
    hits = by_id.join(destination, ["forum", "tag_id"]).select("story_id", "pos", "name").unionAll(
        by_name.join(destination.withColumn("key", F.lower("name")), ["forum", "key"]).select(
            "story_id", F.col("pos") + 1000, "name"
        )
    )
    listed = hits.groupBy("story_id", "name").agg(F.min("pos").alias("pos")).groupBy("story_id").agg(
        F.array_sort(F.collect_list(F.struct("pos", "name"))).alias("ts")
    )
    tags = F.array_join(F.transform(F.slice("ts", 1, fixed.TAGS_PER_STORY), lambda t: t["name"]), "|")
    return stories.join(listed, "story_id", "left").select(
        "story_id", F.coalesce(tags, F.lit("")).alias("tags"),
        F.when(F.col("require_tag") & F.col("ts").isNull(), "forum requires a tag but no configured tag exists there").alias("error"),
    )


@query(
    "j12_protected_stories",
    f"""{ST}, {B.HISTORY_CTE} SELECT story_id FROM stories s WHERE NOT EXISTS (SELECT 1 FROM history h WHERE h.story_id = s.story_id
    AND h.action IN ('manual_merge', 'manual_split', 'manual_split_out') AND h.created_at >= {NOW_SQL} - INTERVAL 7 DAY)""",
)
def j12(spark, sf_dir):
    return without_manual_actions(B.stories(spark, sf_dir), B.history(spark, sf_dir), hours_ago(168)).select("story_id")


def without_manual_actions(stories, history, since):
    """Stories that no person merged or split since then."""
    manual = history.filter(
        F.col("action").isin(list(fixed.MANUAL_ACTIONS)) & (F.col("created_at") >= since)
    )
    return stories.join(manual.select("story_id"), "story_id", "left_anti")


@query(
    "d8_catalogue_coverage",
    f"""{ST}, {DEST_CTE}, cat AS (SELECT forum, generate_subscripts(c, 1) AS pos, unnest(c) AS tag FROM
      (SELECT forum, {O.lst(fixed.TAG_CATALOG)} AS c FROM stories GROUP BY forum)),
    n AS (SELECT forum, count(*) AS installed FROM dest GROUP BY forum)
    SELECT cat.forum, count(d.name) AS present, CAST(greatest(0, 20 - any_value(n.installed)) AS BIGINT) AS free_slots,
      coalesce(string_agg(tag, '|' ORDER BY pos) FILTER (WHERE d.name IS NULL), '') AS missing
    FROM cat JOIN n USING (forum) LEFT JOIN dest d ON d.forum = cat.forum AND lower(d.name) = lower(cat.tag) GROUP BY cat.forum""",
)
def d8(spark, sf_dir):
    dest = destination_tags(spark, sf_dir)
    installed = dest.groupBy("forum").agg(
        F.collect_set(F.lower("name")).alias("names"), F.count(F.lit(1)).alias("installed")
    )
    catalogue = S.literal_array(fixed.TAG_CATALOG)
    present = F.filter(catalogue, lambda t: F.array_contains("names", F.lower(t)))
    return installed.select(
        "forum", F.size(present).cast("bigint").alias("present"),
        F.greatest(F.lit(0), 20 - F.col("installed")).cast("bigint").alias("free_slots"),
        F.array_join(F.array_except(catalogue, present), "|").alias("missing"),
    )


# --- aggregations --------------------------------------------------------------------------------
@query(
    "a1_story_count",
    f"""{SO} SELECT count(*) AS stories FROM stories s WHERE {PUBLISHED} AND list_has_any(tags, ['World', 'Law', 'AI', 'Health'])
    AND story_id IN (SELECT story_id FROM outlets WHERE bias IN ('left', 'center-left'))""",
)
def a1(spark, sf_dir):
    q = FeedQuery(tags=("World", "Law", "AI", "Health"), bias="left")
    return S.browse(B.stories(spark, sf_dir), B.articles(spark, sf_dir), q).agg(F.count(F.lit(1)).alias("stories"))


@query(
    "a2_tag_counts",
    f"""{ST} SELECT tag, count(*) AS stories FROM (SELECT unnest(tags) AS tag FROM stories s WHERE {PUBLISHED} AND
    (contains(lower(title), 'th') OR EXISTS (SELECT 1 FROM articles a WHERE a.story_id = s.story_id AND contains(lower(a.publisher), 'th'))))
    WHERE tag <> '' GROUP BY tag""",
)
def a2(spark, sf_dir):
    return S.tag_counts(S.browse(B.stories(spark, sf_dir), B.articles(spark, sf_dir), FeedQuery(search="th")))


BALANCE_CTE = f"""{B.STORIES_CTE}, outlets AS (SELECT *, {O.outlet_columns('publisher', 'url')} FROM articles),
 balance AS (SELECT outlet, bias, count(*) AS appearances FROM (SELECT DISTINCT s.story_id, outlet, bias
   FROM stories s JOIN outlets o USING (story_id) WHERE {PUBLISHED}) GROUP BY outlet, bias)"""


def balance(spark, sf_dir):
    return S.source_balance(B.stories(spark, sf_dir).filter(S.is_published()), B.articles(spark, sf_dir))


@query("a3_source_balance", f"WITH {BALANCE_CTE} SELECT outlet, bias, appearances FROM balance ORDER BY appearances DESC, outlet")
def a3(spark, sf_dir):
    return balance(spark, sf_dir).orderBy(F.desc("appearances"), "outlet")


@query(
    "a4_balance_rollup",
    f"""WITH {BALANCE_CTE}, r AS (SELECT
      CAST(coalesce(sum(appearances) FILTER (WHERE bias IN ('left', 'center-left')), 0) AS BIGINT) AS "left",
      CAST(coalesce(sum(appearances) FILTER (WHERE bias = 'center'), 0) AS BIGINT) AS center,
      CAST(coalesce(sum(appearances) FILTER (WHERE bias IN ('right', 'center-right')), 0) AS BIGINT) AS "right",
      CAST(coalesce(sum(appearances) FILTER (WHERE bias = 'official'), 0) AS BIGINT) AS official,
      CAST(coalesce(sum(appearances) FILTER (WHERE bias = 'unrated'), 0) AS BIGINT) AS unrated FROM balance)
    SELECT *, "left" + center + "right" AS rated_appearances, "left" + center + "right" + official + unrated AS total_appearances FROM r""",
)
def a4(spark, sf_dir):
    return S.balance_rollup(balance(spark, sf_dir))


@query(
    "a5_state_counts",
    f"""{ST} SELECT e.state, count(s.story_id) AS n FROM (SELECT unnest({O.lst(fixed.STORY_STATES)}) AS state) e
    LEFT JOIN (SELECT * FROM stories WHERE guild_id = 2) s USING (state) GROUP BY e.state""",
)
def a5(spark, sf_dir):
    return S.zero_filled_counts(B.stories(spark, sf_dir).filter("guild_id = 2"), "state", fixed.STORY_STATES)


@query(
    "a6_delivery_counts",
    f"""{ST}, d AS (SELECT * FROM (SELECT DISTINCT feed_id FROM articles), (SELECT unnest({O.lst(fixed.DELIVERY_STATES)}) AS delivery_state))
    SELECT feed_id, delivery_state, count(a.article_id) AS n FROM d LEFT JOIN articles a USING (feed_id, delivery_state) GROUP BY ALL""",
)
def a6(spark, sf_dir):
    return S.zero_filled_counts(B.articles(spark, sf_dir), "delivery_state", fixed.DELIVERY_STATES, by="feed_id")


def rollup_sql(source: str, key: str = "story_id", name: str = "rollup") -> str:
    def union(c):
        return f"coalesce(list_sort(list_distinct(flatten(list({c})))), [])"

    return f"""{name} AS (SELECT {key}, count(*) AS articles, min(published_at) AS first_published_at,
      max(published_at) AS last_published_at, {', '.join(f"{union(c)} AS {c}" for c in A8_SETS)},
      {union('keywords')}[1:24] AS keywords FROM {source} GROUP BY {key})"""


@query(
    "a8_feature_rollup",
    f"""WITH {B.STORIES_CTE}, {O.norm_cte()}, {rollup_sql('norm')}
    SELECT story_id, articles, epoch_us(first_published_at) AS first_us, epoch_us(last_published_at) AS last_us,
      {', '.join(f"array_to_string({c}, '|') AS {c}" for c in (*A8_SETS, 'keywords'))} FROM rollup""",
)
def a8(spark, sf_dir):
    from storyline.plans.q_text import norm

    r = feature_rollup(norm(spark, sf_dir))
    return r.select(
        "story_id", "articles", F.unix_micros("first_published_at").alias("first_us"),
        F.unix_micros("last_published_at").alias("last_us"),
        *[F.array_join(c, "|").alias(c) for c in (*A8_SETS, "keywords")],
    )


OUTCOME_SQL = B.sql_pick(fixed.OUTCOMES, "event_id // 3")
REPORT_SUMS = ", ".join(f"count(*) FILTER (WHERE outcome = '{o}') AS {o}" for o in fixed.OUTCOMES)


@query(
    "a9_poll_report",
    f"""WITH o AS (SELECT CAST(event_id % 20 + 1 AS VARCHAR) AS feed, {OUTCOME_SQL} AS outcome FROM events)
    SELECT coalesce(feed, 'total') AS feed, count(*) AS fetched, {REPORT_SUMS} FROM o GROUP BY GROUPING SETS ((feed), ())""",
)
def a9(spark, sf_dir):
    e = F.col("event_id")
    polled = B.read(spark, sf_dir, "events").select(
        (e % 20 + 1).cast("string").alias("feed"), B.pick(fixed.OUTCOMES, F.floor(e / 3)).alias("outcome")
    )
    counts = polled.groupBy("feed").pivot("outcome", list(fixed.OUTCOMES)).agg(F.count(F.lit(1))).na.fill(0)
    per_feed = counts.select("feed", sum(F.col(o) for o in fixed.OUTCOMES).alias("fetched"), *fixed.OUTCOMES)
    total = per_feed.agg(*[F.sum(c).alias(c) for c in ("fetched", *fixed.OUTCOMES)]).select(F.lit("total").alias("feed"), "*")
    return per_feed.unionByName(total)


@query(
    "a10_status_summary",
    f"""{ST}, {B.FEEDS_CTE} SELECT (SELECT count(*) FROM feeds WHERE state = 'active') AS active_feeds, (SELECT count(*) FROM feeds) AS feeds,
    (SELECT count(last_error) FROM feeds) AS feed_errors, count(*) AS stories, count(*) FILTER (WHERE state = 'breaking') AS breaking,
    count(*) FILTER (WHERE state = 'developing') AS developing, count(*) FILTER (WHERE state = 'updated') AS updated FROM stories""",
)
def a10(spark, sf_dir):
    def n(cond):
        return F.count(F.when(cond, 1))

    f = B.feeds(spark, sf_dir).agg(
        n(F.col("state") == "active").alias("active_feeds"), F.count(F.lit(1)).alias("feeds"),
        F.count("last_error").alias("feed_errors"),
    )
    s = B.stories(spark, sf_dir).agg(
        F.count(F.lit(1)).alias("stories"),
        *[n(F.col("state") == x).alias(x) for x in ("breaking", "developing", "updated")],
    )
    return f.crossJoin(s)
