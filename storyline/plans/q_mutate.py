"""Queries of table changes."""

from __future__ import annotations

from pyspark.sql import functions as F

from storyline.functions import fixed
from storyline.operators import mutations as M
from storyline.operators.attach import attach_fold
from storyline.plans import bindings as B
from storyline.plans import oracle_text as O
from storyline.plans import q_feed as Q
from storyline.plans.q_outlets import ordered_distinct
from storyline.plans.q_text import norm
from storyline.plans.registry import query

ST = Q.ST


@query(
    "s9_feed_upsert",
    f"""WITH {B.ITEMS_CTE}, {B.FEEDS_CTE}, n AS (SELECT feed_id, guild_id, name, 'https://new.example/' || name AS source, 900 AS interval_seconds FROM feeds WHERE feed_id % 2 = 0
      UNION ALL SELECT feed_id + 100, guild_id, 'extra ' || name, 'https://new.example/' || name, 900 FROM feeds WHERE feed_id % 3 = 0)
    SELECT coalesce(f.guild_id, n.guild_id) AS guild_id, coalesce(f.name, n.name) AS name, coalesce(f.feed_id, n.feed_id) AS feed_id,
      coalesce(n.source, f.source) AS source, CAST(coalesce(n.interval_seconds, f.interval_seconds) AS BIGINT) AS interval_seconds
    FROM feeds f FULL OUTER JOIN n ON f.guild_id = n.guild_id AND f.name = n.name""",
)
def s9(spark, sf_dir):
    f = B.feeds(spark, sf_dir).select("guild_id", "name", "feed_id", "source", "interval_seconds")
    src = F.concat(F.lit("https://new.example/"), "name")
    changed = f.filter("feed_id % 2 = 0").withColumn("source", src)
    added = f.filter("feed_id % 3 = 0").select(
        "guild_id", F.concat(F.lit("extra "), "name").alias("name"), (F.col("feed_id") + 100).alias("feed_id"),
        src.alias("source"), "interval_seconds",
    )
    new = changed.unionByName(added).withColumn("interval_seconds", F.lit(900).cast("bigint"))
    return M.upsert(f, new, ["guild_id", "name"], ["source", "interval_seconds"])


@query(
    "u1_keyed_upsert",
    """WITH w AS (SELECT user_id AS guild_id, min(event_type) AS model, max(ts) AS at FROM events WHERE event_id % 2 = 0 GROUP BY 1),
    n AS (SELECT user_id AS guild_id, max(event_type) AS model, max(ts) AS at FROM events WHERE event_id % 5 = 0 GROUP BY 1)
    SELECT coalesce(w.guild_id, n.guild_id) AS guild_id, coalesce(n.model, w.model) AS model, epoch_us(coalesce(n.at, w.at)) AS updated_us
    FROM w FULL OUTER JOIN n USING (guild_id)""",
)
def u1(spark, sf_dir):
    ev = B.read(spark, sf_dir, "events").withColumnRenamed("user_id", "guild_id")
    base = ev.filter("event_id % 2 = 0").groupBy("guild_id").agg(F.min("event_type").alias("model"), F.max("ts").alias("at"))
    new = ev.filter("event_id % 5 = 0").groupBy("guild_id").agg(F.max("event_type").alias("model"), F.max("ts").alias("at"))
    return M.upsert(base, new, ["guild_id"], ["model", "at"]).select("guild_id", "model", F.unix_micros("at").alias("updated_us"))


def attached(spark, sf_dir):
    """Thirty articles a story, with tags and significance by rules of their id."""
    i = F.col("article_id")
    tags = F.array_distinct(F.concat(
        F.when(i % 41 == 0, F.array(F.lit("Breaking"))).otherwise(F.array().cast("array<string>")), F.array(B.pick(fixed.TAG_CATALOG, i), B.pick(fixed.TAG_CATALOG, F.floor(i / 2) * 3)),
    ))
    return norm(spark, sf_dir).withColumns({
        "story_id": F.floor(i / 30), "priority": (i % 4).cast("int"), "tags": tags, "significant": i % 4 == 1,
    })


@query(
    "u2_attach_fold",
    f"""{B.STORIES_CTE.replace('WITH ', 'WITH RECURSIVE ', 1) if B.STORIES_CTE.startswith('WITH ') else 'WITH RECURSIVE ' + B.STORIES_CTE}, {O.norm_cte()}, a AS MATERIALIZED (SELECT * REPLACE (article_id // 30 AS story_id), CAST(article_id % 4 AS INTEGER) AS priority, article_id % 4 = 1 AS significant,
      list_filter([CASE WHEN article_id % 41 = 0 THEN 'Breaking' END, {B.sql_pick(fixed.TAG_CATALOG, 'article_id')}, CASE WHEN {B.sql_pick(fixed.TAG_CATALOG, 'article_id')} <> {B.sql_pick(fixed.TAG_CATALOG, 'article_id // 2 * 3')}
        THEN {B.sql_pick(fixed.TAG_CATALOG, 'article_id // 2 * 3')} END], lambda x: x IS NOT NULL) AS raw FROM norm),
    u0 AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY story_id ORDER BY published_at, article_id) AS n FROM a),
    u AS MATERIALIZED (SELECT *, CASE WHEN len(raw) > 1 AND raw[1] = raw[2] THEN list_concat([raw[1]], raw[3:]) WHEN len(raw) > 2 AND raw[1] = raw[3] THEN raw[1:2] ELSE raw END AS tags FROM u0),
    walk AS (SELECT story_id, n, CASE WHEN list_contains(tags, 'Breaking') THEN 'breaking' ELSE 'new' END AS state, list_concat(CASE WHEN list_contains(tags, 'Breaking') THEN ['Breaking'] ELSE [] END, list_filter(tags, lambda t: t <> 'Breaking' OR NOT list_contains(tags, 'Breaking')))[1:5] AS list FROM u WHERE n = 1
      UNION ALL SELECT story_id, n, state, list_concat(mine, list_filter(list, lambda t: lower(t) NOT IN ('breaking', 'developing') AND NOT list_contains(mine, t)))[1:5] FROM (
        SELECT story_id, n, state, list, list_concat(lead, list_filter(tags, lambda t: NOT list_contains(lead, t)))[1:5] AS mine FROM (
          SELECT u.story_id, u.n, w.list, u.tags, CASE WHEN w.state = 'breaking' THEN 'breaking' WHEN u.significant THEN 'developing' ELSE 'updated' END AS state,
            CASE WHEN w.state = 'breaking' THEN ['Breaking'] WHEN u.significant THEN ['Developing'] ELSE [] END AS lead FROM walk w JOIN u ON u.story_id = w.story_id AND u.n = w.n + 1))),
    ends AS (SELECT story_id, arg_max(state, n) AS state, arg_max(list, n) AS list, max(n) AS articles FROM walk GROUP BY story_id),
    p AS (SELECT story_id, article_id, title, priority FROM u QUALIFY row_number() OVER (PARTITION BY story_id ORDER BY priority DESC, published_at, article_id) = 1),
    f AS (SELECT story_id, epoch_us(max(published_at)) AS last_us, array_to_string(list_sort(list_distinct(flatten(list(keywords))))[1:24], '|') AS keywords, array_to_string(list_sort(list_distinct(flatten(list(entities)))), '|') AS entities FROM u GROUP BY story_id)
    SELECT story_id, ends.state, array_to_string(list, '|') AS tags, p.article_id AS primary_article_id, p.title, p.priority AS primary_priority, articles, last_us, keywords, entities
    FROM ends JOIN p USING (story_id) JOIN f USING (story_id)""",
)
def u2(spark, sf_dir):
    """Stories as their articles, attached one by one, have made them: tags and state too."""
    return attach_fold(attached(spark, sf_dir)).select(
        "story_id", "state", F.array_join("tags", "|").alias("tags"), "primary_article_id", "title", "primary_priority", "articles",
        F.unix_micros("last_published_at").alias("last_us"), F.array_join("keywords", "|").alias("keywords"), F.array_join("entities", "|").alias("entities"),
    )


PAIRS_CTE = """asked AS (SELECT story_id AS source_id, CASE WHEN story_id % 24 = 4 THEN story_id ELSE story_id - 2 END AS target_id FROM stories WHERE story_id % 4 = 0),
 judged AS (SELECT source_id, target_id, CASE WHEN source_id = target_id THEN 'a story cannot be merged into itself'
    WHEN t.story_id IS NULL THEN 'story not found' WHEN s.state = 'merged' OR t.state = 'merged' THEN 'merged stories cannot be merged again'
    WHEN s.guild_id <> t.guild_id OR s.forum <> t.forum THEN 'stories must belong to the same forum' END AS refusal
   FROM asked JOIN stories s ON s.story_id = source_id LEFT JOIN stories t ON t.story_id = target_id),
 pairs AS (SELECT source_id, target_id FROM judged WHERE refusal IS NULL)"""


def judged(spark, sf_dir):
    s = F.col("story_id")
    st = B.stories(spark, sf_dir)
    asked = st.filter(s % 4 == 0).select(
        s.alias("source_id"), F.when(s % 24 == 4, s).otherwise(s - 2).alias("target_id")
    )
    return M.merge_refusal(asked, st)


def pairs(spark, sf_dir):
    return judged(spark, sf_dir).filter("refusal IS NULL").select("source_id", "target_id")


@query("u3_merge_refusals", f"{ST}, {PAIRS_CTE} SELECT source_id, target_id, refusal FROM judged")
def u3_refusals(spark, sf_dir):
    return judged(spark, sf_dir)


@query(
    "u3_merge_stories",
    f"""WITH {B.STORIES_CTE}, {PAIRS_CTE}, {O.norm_cte()},
    moved AS (SELECT norm.* EXCLUDE (story_id), coalesce(p.target_id, norm.story_id) AS story_id FROM norm LEFT JOIN pairs p ON p.source_id = norm.story_id),
    {Q.rollup_sql('(SELECT * FROM moved WHERE story_id IN (SELECT target_id FROM pairs))')},
    m AS (SELECT t.story_id, CASE WHEN s.primary_priority > t.primary_priority THEN s.title ELSE t.title END AS title,
      CASE WHEN s.primary_priority > t.primary_priority THEN s.primary_article_id ELSE t.primary_article_id END AS primary_article_id,
      t.tags || s.tags AS x FROM pairs p JOIN stories t ON t.story_id = p.target_id JOIN stories s ON s.story_id = p.source_id)
    SELECT m.story_id, title, 'updated' AS state, primary_article_id, array_to_string({ordered_distinct('x')}, '|') AS tags, array_to_string(keywords, '|') AS keywords,
      array_to_string(entities, '|') AS entities, epoch_us(r.last_published_at) AS last_us, CAST(NULL AS BIGINT) AS merged_into FROM m JOIN rollup r USING (story_id)
    UNION ALL SELECT s.story_id, s.title, 'merged', s.primary_article_id, array_to_string(s.tags, '|'), NULL, NULL, epoch_us(s.last_published_at), p.target_id
    FROM pairs p JOIN stories s ON s.story_id = p.source_id""",
)
def u3(spark, sf_dir):
    out = M.merge_stories(B.stories(spark, sf_dir), norm(spark, sf_dir), pairs(spark, sf_dir), Q.now())
    return out.select(
        "story_id", "title", "state", "primary_article_id", F.array_join("tags", "|").alias("tags"),
        F.array_join("keywords", "|").alias("keywords"), F.array_join("entities", "|").alias("entities"),
        F.unix_micros("last_published_at").alias("last_us"), "merged_into",
    )


@query(
    "u3_merge_edges",
    f"""{ST}, {Q.EDGES_CTE}, {PAIRS_CTE}, m AS (SELECT coalesce(a.target_id, low) AS x, coalesce(b.target_id, high) AS y
      FROM edges LEFT JOIN pairs a ON a.source_id = low LEFT JOIN pairs b ON b.source_id = high)
    SELECT DISTINCT least(x, y) AS low, greatest(x, y) AS high FROM m WHERE x <> y""",
)
def u3_edges(spark, sf_dir):
    return M.merge_edges(Q.edges(spark, sf_dir), pairs(spark, sf_dir))


@query(
    "u4_split_article",
    f"""WITH {B.STORIES_CTE}, {O.norm_cte()}, asked AS (SELECT story_id, max(article_id) AS article_id FROM norm WHERE story_id % 5 = 0 GROUP BY story_id HAVING count(*) > 1),
    own AS (SELECT a.article_id, s.* EXCLUDE (title, summary, state, first_published_at, last_published_at, forum) FROM asked a JOIN stories s USING (story_id)),
    kept AS (SELECT norm.* FROM norm WHERE story_id IN (SELECT story_id FROM asked) AND article_id NOT IN (SELECT article_id FROM asked)), {Q.rollup_sql('kept')},
    head AS (SELECT k.story_id, arg_min(k.article_id, (CASE WHEN k.article_id = o.primary_article_id THEN 0 ELSE 1 END, k.published_at, k.article_id)) AS article_id
      FROM kept k JOIN own o USING (story_id) GROUP BY k.story_id)
    SELECT n.article_id + 10000000 AS story_id, n.title, 'new' AS state, array_to_string(o.tags, '|') AS tags,
      CASE WHEN n.article_id = o.primary_article_id THEN o.primary_priority ELSE 0 END AS primary_priority, n.article_id AS primary_article_id,
      array_to_string(n.keywords, '|') AS keywords, CAST(1 AS BIGINT) AS articles FROM own o JOIN norm n ON n.article_id = o.article_id
    UNION ALL SELECT r.story_id, n.title, 'updated', array_to_string(o.tags, '|'), CASE WHEN h.article_id = o.primary_article_id THEN o.primary_priority ELSE 0 END,
      h.article_id, array_to_string(r.keywords, '|'), r.articles FROM rollup r JOIN head h USING (story_id) JOIN own o USING (story_id) JOIN norm n ON n.article_id = h.article_id""",
)
def u4(spark, sf_dir):
    arts = norm(spark, sf_dir)
    asked = arts.filter("story_id % 5 = 0").groupBy("story_id").agg(F.max("article_id").alias("article_id"))
    req = asked.select("article_id", (F.col("article_id") + 10000000).alias("new_story_id"))
    out = M.split_articles(B.stories(spark, sf_dir), arts, req, Q.now())
    return out.select(
        "story_id", "title", "state", F.array_join("tags", "|").alias("tags"), "primary_priority", "primary_article_id",
        F.array_join("keywords", "|").alias("keywords"), "articles",
    )


@query(
    "u5_mark_stale",
    f"""{ST} SELECT story_id, CASE WHEN state IN ('new', 'developing', 'breaking', 'updated') AND last_updated_at < {Q.NOW_SQL} - INTERVAL 96 HOUR
    THEN 'stale' ELSE state END AS state FROM stories""",
)
def u5(spark, sf_dir):
    return M.mark_stale(B.stories(spark, sf_dir), Q.hours_ago(96)).select("story_id", "state")


@query(
    "u6_mark_cleared",
    f"""{ST}, c AS (SELECT story_id FROM stories WHERE {Q.CLEANUP} ORDER BY last_updated_at, story_id LIMIT 25)
    SELECT 'story' AS kind, s.story_id, epoch_us(CASE WHEN c.story_id IS NOT NULL THEN {Q.NOW_SQL} ELSE cleared_at END) AS at_us, CASE WHEN c.story_id IS NOT NULL THEN 'archive' END AS action
    FROM stories s LEFT JOIN c USING (story_id) UNION ALL SELECT 'history', story_id, epoch_us({Q.NOW_SQL}), 'cleanup_archive' FROM c""",
)
def u6(spark, sf_dir):
    marked, log = M.mark_cleared(B.stories(spark, sf_dir), Q.f14(spark, sf_dir).select("story_id"), "archive", Q.now())
    return marked.select(
        F.lit("story").alias("kind"), "story_id", F.unix_micros("cleared_at").alias("at_us"), F.col("clear_action").alias("action")
    ).unionAll(log.select(F.lit("history"), "story_id", F.unix_micros("created_at"), "action"))


@query(
    "u7_replace_relationships",
    f"""{ST}, {Q.EDGES_CTE}, an AS (SELECT story_id, CASE WHEN story_id % 9 = 0 THEN CAST([] AS BIGINT[]) ELSE [story_id + 2, story_id + 4, story_id + 2] END AS rel
      FROM stories WHERE story_id % 3 = 0),
    w AS (SELECT DISTINCT story_id, unnest(rel) AS related_id FROM an),
    c AS (SELECT w.*, w.story_id <> w.related_id AND r.story_id IS NOT NULL AND r.guild_id = o.guild_id AND r.state <> 'merged' AND r.thread_id IS NOT NULL AS ok
      FROM w JOIN stories o ON o.story_id = w.story_id LEFT JOIN stories r ON r.story_id = w.related_id),
    v AS (SELECT story_id FROM an WHERE story_id NOT IN (SELECT story_id FROM c WHERE NOT coalesce(ok, false)))
    SELECT low, high FROM edges WHERE low NOT IN (SELECT story_id FROM v) AND high NOT IN (SELECT story_id FROM v)
    UNION SELECT least(story_id, related_id), greatest(story_id, related_id) FROM c WHERE story_id IN (SELECT story_id FROM v)""",
)
def u7(spark, sf_dir):
    s = F.col("story_id")
    st = B.stories(spark, sf_dir)
    analysed = st.filter(s % 3 == 0).select(
        "story_id", F.when(s % 9 == 0, F.array().cast("array<bigint>")).otherwise(F.array(s + 2, s + 4, s + 2)).alias("related_ids")
    )
    return M.replace_relationships(Q.edges(spark, sf_dir), analysed, st)


@query(
    "u8_state_transition",
    f"""WITH {B.STORIES_CTE} SELECT a.article_id, CASE WHEN a.article_id = s.primary_article_id
      THEN CASE WHEN list_has_any(s.tags, ['Breaking']) THEN 'breaking' ELSE 'new' END
      WHEN s.state = 'breaking' THEN 'breaking' WHEN a.article_id % 2 = 0 THEN 'developing' ELSE 'updated' END AS state
    FROM articles a JOIN stories s USING (story_id)""",
)
def u8(spark, sf_dir):
    st = B.stories(spark, sf_dir).select("story_id", "state", "tags", "primary_article_id")
    i = F.col("article_id")
    return B.articles(spark, sf_dir).select("article_id", "story_id").join(st, "story_id").select(
        "article_id", M.next_state(i == F.col("primary_article_id"), F.col("tags"), F.col("state"), i % 2 == 0).alias("state")
    )


@query(
    "u9_outcome_update",
    f"""WITH {B.ARTICLES_CTE}, o AS (SELECT event_id AS article_id, CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'uncertain' ELSE 'posted' END AS outcome,
      CASE WHEN event_type = 'error' THEN repeat('e', 1200) END AS error FROM events WHERE event_id % 3 <> 0)
    SELECT a.article_id, coalesce(o.outcome, a.delivery_state) AS delivery_state, length(substring(o.error, 1, 1000)) AS error_length FROM articles a LEFT JOIN o USING (article_id)""",
)
def u9(spark, sf_dir):
    ev = B.read(spark, sf_dir, "events").filter("event_id % 3 <> 0").select(
        F.col("event_id").alias("article_id"),
        F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "purchase", "uncertain").otherwise("posted").alias("outcome"),
        F.when(F.col("event_type") == "error", F.repeat(F.lit("e"), 1200)).alias("error"),
    )
    out = M.apply_outcomes(B.articles(spark, sf_dir).select("article_id", "delivery_state"), ev, "article_id", "delivery_state")
    return out.select("article_id", "delivery_state", F.length("error").cast("bigint").alias("error_length"))


@query(
    "u10_feed_progress",
    f"""WITH {B.ITEMS_CTE}, {B.FEEDS_CTE}, p AS (SELECT event_id % 20 + 1 AS feed_id, max(ts) AS polled_at, count(*) FILTER (WHERE event_type = 'view') AS uncertain,
      max(CASE WHEN event_id % 20 IN (3, 7) THEN 'timeout' END) AS error, CAST(max(event_id) AS VARCHAR) AS cur FROM events GROUP BY 1),
    f AS (SELECT feeds.*, CAST(feed_id * 10 AS VARCHAR) AS cur0, p.* EXCLUDE (feed_id) FROM feeds JOIN p USING (feed_id))
    SELECT feed_id, CASE WHEN error IS NULL THEN 0 ELSE failure_count + 1 END AS failure_count,
      epoch_us(polled_at) + 1000000 * CASE WHEN error IS NULL THEN interval_seconds ELSE least(interval_seconds * CAST(pow(2, least(failure_count + 1, 8)) AS BIGINT), 86400) END AS next_us,
      coalesce(error, CASE WHEN uncertain > 0 THEN CAST(uncertain AS VARCHAR) || ' outcome(s) uncertain' END) AS last_error,
      epoch_us(CASE WHEN error IS NULL THEN polled_at ELSE last_polled_at END) AS polled_us, CASE WHEN error IS NULL THEN cur ELSE cur0 END AS cursor_value FROM f""",
)
def u10(spark, sf_dir):
    e = F.col("event_id")
    polls = B.read(spark, sf_dir, "events").groupBy((e % 20 + 1).alias("feed_id")).agg(
        F.max("ts").alias("polled_at"), F.count(F.when(F.col("event_type") == "view", 1)).alias("uncertain"),
        F.max(F.when((e % 20).isin(3, 7), "timeout")).alias("error"), F.max("event_id").cast("string").alias("cursor"),
    )
    feeds = B.feeds(spark, sf_dir).withColumn("cursor", (F.col("feed_id") * 10).cast("string"))
    return M.feed_progress(feeds, polls).select(
        "feed_id", "failure_count", F.unix_micros("next_poll_at").alias("next_us"), "last_error",
        F.unix_micros("last_polled_at").alias("polled_us"), F.col("cursor").alias("cursor_value"),
    )


@query(
    "u11_delivery_decision",
    f"""WITH {Q.RANK_CTE}, x AS (SELECT story_id, thread_id IS NULL AS creating, CASE WHEN analysis_state = 'failed' THEN 'model said no' END AS model_error,
      CASE WHEN analysis_state = 'disabled' THEN 'verified analysis was not available' END AS quality_error, worthy, story_id % 2 = 0 AS significant, story_id % 3 = 0 AS summaries FROM gated),
    r AS (SELECT *, CASE WHEN NOT creating AND model_error IS NOT NULL THEN model_error WHEN creating AND summaries AND quality_error IS NOT NULL THEN quality_error
      WHEN creating THEN coalesce(model_error, CASE WHEN NOT worthy THEN 'story did not meet the configured newsworthiness threshold' END) END AS reason FROM x)
    SELECT story_id, CASE WHEN reason IS NOT NULL THEN 'skipped' WHEN creating THEN 'new_stories' ELSE 'updated_stories' END AS outcome, reason,
      reason IS NULL AND NOT creating AND significant AS post_update FROM r""",
)
def u11(spark, sf_dir):
    s = F.col("story_id")
    d = M.delivery_decision(
        F.col("thread_id").isNull(), F.when(F.col("analysis_state") == "failed", "model said no"),
        F.when(F.col("analysis_state") == "disabled", "verified analysis was not available"),
        F.col("worthy"), s % 2 == 0, s % 3 == 0,
    )
    return Q.ranked(spark, sf_dir).select("story_id", d.alias("d")).select("story_id", "d.*")


@query(
    "u12_analysis_state_update",
    f"""{ST}, {B.FEEDS_CTE}, w AS (SELECT a.story_id, bool_or(f.summarization_enabled AND f.feed_id % 4 = 0) AS wanted FROM articles a JOIN feeds f USING (feed_id) GROUP BY a.story_id)
    SELECT story_id, CASE WHEN NOT wanted THEN 'disabled' WHEN story_id % 3 = 0 THEN analysis_state WHEN story_id % 3 = 1 THEN 'ready'
      WHEN thread_id IS NOT NULL AND analysis_state = 'ready' THEN 'ready' ELSE 'failed' END AS analysis_state FROM stories JOIN w USING (story_id)""",
)
def u12(spark, sf_dir):
    f = B.feeds(spark, sf_dir).select("feed_id", (F.col("summarization_enabled") & (F.col("feed_id") % 4 == 0)).alias("on"))
    wanted = B.articles(spark, sf_dir).join(f, "feed_id").groupBy("story_id").agg(F.bool_or("on").alias("wanted"))
    s = F.col("story_id")
    ok = F.when(s % 3 == 1, F.lit(True)).when(s % 3 == 2, F.lit(False))
    return B.stories(spark, sf_dir).join(wanted, "story_id").select(
        "story_id", M.analysis_update(F.col("wanted"), ok, F.col("analysis_state"), F.col("thread_id").isNotNull()).alias("analysis_state")
    )


@query(
    "w11_latest_update_detail",
    f"""{ST}, {B.HISTORY_CTE}, last AS (SELECT story_id, article_id, max(history_id) AS history_id FROM history WHERE action IN ('major_update', 'source_added') GROUP BY ALL)
    SELECT h.history_id, h.story_id, h.article_id, CASE WHEN l.history_id IS NOT NULL AND h.article_id % 2 = 0 THEN '{{"update":"fresh ' || CAST(h.article_id AS VARCHAR) || '"}}' ELSE h.detail END AS detail
    FROM history h LEFT JOIN last l USING (history_id)""",
)
def w11(spark, sf_dir):
    h = B.history(spark, sf_dir)
    details = B.articles(spark, sf_dir).filter("article_id % 2 = 0").select(
        "article_id", F.concat(F.lit("fresh "), F.col("article_id").cast("string")).alias("text")
    )
    return save_update_details(h, details).select("history_id", "story_id", "article_id", "detail")


def save_update_details(history, details):
    """Write each detail (article_id, text) into the latest update record of story and article."""
    last = (
        history.filter(F.col("action").isin(list(fixed.UPDATE_ACTIONS)))
        .groupBy("story_id", "article_id").agg(F.max("history_id").alias("history_id"))
        .join(details, "article_id").select("history_id", "text")
    )
    return history.join(last, "history_id", "left").withColumn(
        "detail", F.when(F.col("text").isNotNull(), F.to_json(F.struct(F.col("text").alias("update")))).otherwise(F.col("detail"))
    ).drop("text")


@query(
    "s11_history_append",
    f"""WITH {B.ITEMS_CTE}, {B.HISTORY_CTE} SELECT action, count(*) AS records, count(DISTINCT story_id) AS stories FROM history GROUP BY action""",
)
def s11(spark, sf_dir):
    """Write the log append-only to the shared folder, read it back and count per action."""
    from storyline.session import ensure_checkpoint_dir

    h = B.history(spark, sf_dir)
    folder = f"{ensure_checkpoint_dir(spark)}/history-{spark.sparkContext.applicationId}-{abs(hash(sf_dir))}"
    h.filter("history_id % 2 = 0").write.mode("overwrite").parquet(folder)
    h.filter("history_id % 2 = 1").write.mode("append").parquet(folder)
    return spark.read.parquet(folder).groupBy("action").agg(
        F.count(F.lit(1)).alias("records"), F.countDistinct("story_id").alias("stories")
    )
