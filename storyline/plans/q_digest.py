"""Queries of the weekly digest, details and presentation."""

from __future__ import annotations

import uuid

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from storyline.functions import fixed
from storyline.functions.outlets import source_bias_bucket, source_bias_score
from storyline.functions.text import forum_title
from storyline.functions.urls import safe_external_link
from storyline.operators import digest as E
from storyline.operators import feed as S
from storyline.operators import items as IT
from storyline.operators import mutations as M
from storyline.operators import ranking as R
from storyline.plans import bindings as B
from storyline.plans import oracle_text as O
from storyline.plans import q_dedup as QD
from storyline.plans import q_feed as Q
from storyline.plans.q_outlets import LABEL
from storyline.plans.q_text import BODY_CTE, LINES_CTE
from storyline.plans.registry import query
from storyline.session import cut_lineage, ensure_checkpoint_dir

ST = Q.ST
CAND_CTE = f"""{B.STORIES_CTE}, cnt AS (SELECT story_id, count(DISTINCT lower(publisher)) AS source_count, count(*) AS article_count FROM articles
   WHERE published_at >= {Q.NOW_SQL} - INTERVAL 168 HOUR AND published_at < {Q.NOW_SQL} GROUP BY story_id),
 cands AS (SELECT s.*, source_count, article_count, row_number() OVER (PARTITION BY guild_id, forum ORDER BY source_count DESC,
   CASE state WHEN 'breaking' THEN 4 WHEN 'developing' THEN 3 WHEN 'updated' THEN 2 ELSE 1 END DESC, article_count DESC, last_updated_at DESC, story_id DESC) AS rank
   FROM stories s JOIN cnt USING (story_id) WHERE publication_state = 'published' AND state <> 'merged' AND cleared_at IS NULL)"""


def candidates(spark, sf_dir, limit=80):
    return R.weekly_candidates(
        B.stories(spark, sf_dir), B.articles(spark, sf_dir), Q.hours_ago(168), Q.now(), limit
    )


@query(
    "a7_weekly_candidates",
    f"WITH {CAND_CTE} SELECT guild_id, forum, story_id, title, source_count, article_count, CAST(rank AS INTEGER) AS rank FROM cands WHERE rank <= 80",
)
def a7(spark, sf_dir):
    return candidates(spark, sf_dir).select(
        "guild_id", "forum", "story_id", "title", "source_count", "article_count", "rank"
    )


@query("w2_weekly_selection")
def w2(spark, sf_dir):
    titled = candidates(spark, sf_dir).withColumn("normalized_title", F.lower("title"))
    return R.select_weekly(titled, limit=8).select("guild_id", "forum", "position", "story_id", "score")


@query(
    "a11_source_list",
    f"""WITH {QD.COPIES_CTE}, r AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY published_at, article_id) AS r, count(*) OVER (PARTITION BY s) AS n
      FROM (SELECT *, story_id // 10 AS s FROM unique_copies))
    SELECT s AS story_id, any_value(n) AS sources, string_agg(publisher, '|' ORDER BY r) FILTER (WHERE r <= 11) AS shown, greatest(0, any_value(n) - 11) AS more FROM r GROUP BY s""",
)
def a11(spark, sf_dir):
    """Ten stories' unique articles as one story, so that lists overflow."""
    u = S.unique_articles(QD.copies(spark, sf_dir)).withColumn("story_id", F.floor(F.col("story_id") / 10))
    out = E.source_list(u.withColumn("label", F.col("publisher")))
    return out.withColumn("shown", F.array_join("shown", "|"))


@query(
    "t6_calendar_week",
    f"""WITH {B.ITEMS_CTE}, l AS (SELECT *, timezone('{B.ZONE}', timezone('UTC', published_at)) AS local FROM items),
    d AS (SELECT *, timezone('{B.ZONE}', CAST(CAST(local AS DATE) - CAST((isodow(local) - 1 - {(B.WEEKDAY + 1) % 7} + 7) % 7 AS INTEGER) AS TIMESTAMP)) AS ws FROM l)
    SELECT guild_id, forum, epoch_us(ws) AS week_us, count(*) AS articles, count(DISTINCT story_id) AS stories, epoch_us(max(published_at)) AS end_us FROM d GROUP BY ALL""",
)
def t6(spark, sf_dir):
    w = E.weekly_counts(B.items(spark, sf_dir), B.ZONE, B.WEEKDAY)
    return w.select(
        "guild_id", "forum", F.unix_micros("week_start").alias("week_us"), "articles", "stories",
        F.unix_micros("week_end").alias("end_us"),
    )


@query(
    "t7_digest_due",
    f"""WITH {B.STORIES_CTE}, d AS (SELECT story_id, CASE WHEN story_id % 4 <> 0 THEN story_id END AS latest_id, CASE WHEN story_id % 3 <> 0 THEN {B.sql_pick(fixed.DELIVERY_STATES, 'story_id')} END AS es,
      last_published_at AS gen, story_id % 10 = 0 AS force, TIMESTAMP '2024-01-06 18:00:00' AS sched FROM stories)
    SELECT story_id, coalesce(es, '') <> 'uncertain' AND (force OR (latest_id IS NULL AND es IS NULL) OR
      coalesce({Q.NOW_SQL} >= sched AND (es IS NULL OR gen < sched OR es = 'failed'), false)) AS due FROM d""",
)
def t7(spark, sf_dir):
    s = F.col("story_id")
    d = B.stories(spark, sf_dir).select(
        "story_id", F.when(s % 4 != 0, s).alias("latest_id"),
        F.when(s % 3 != 0, B.pick(fixed.DELIVERY_STATES, s)).alias("existing_state"),
        F.when(s % 3 != 0, F.col("last_published_at")).alias("existing_generated_at"), (s % 10 == 0).alias("force"),
    )
    return E.digest_due(d, Q.now(), F.lit("2024-01-06 18:00:00").cast("timestamp")).select("story_id", "due")


@query(
    "t8_retention_batches",
    f"""{ST} SELECT story_id, CAST((row_number() OVER (ORDER BY last_updated_at, story_id) - 1) // 25 AS BIGINT) AS batch FROM stories
    WHERE cleared_at IS NULL AND thread_id IS NOT NULL AND state <> 'merged' AND last_updated_at < {Q.NOW_SQL} - INTERVAL 168 HOUR""",
)
def t8(spark, sf_dir):
    """Every due story with the retention tick of 25 that takes it: each tick takes the oldest that are left."""
    due = B.stories(spark, sf_dir).filter(
        F.col("cleared_at").isNull() & F.col("thread_id").isNotNull() & (F.col("state") != "merged")
        & (F.col("last_updated_at") < Q.hours_ago(168))
    )
    return M.retention_batches(due, 25).select("story_id", "batch")


DIGEST_CTE = f"""digests AS (SELECT week * 10 + guild_id AS digest_id, guild_id, forum, week, TIMESTAMP '2024-01-01' + to_days(CAST(7 * week AS INTEGER)) AS week_start,
   CASE WHEN week % 2 = 0 THEN 'posted' ELSE 'failed' END AS delivery_state, list(story_id ORDER BY story_id)[1:12] AS story_ids
   FROM (SELECT *, story_id % 4 AS week FROM stories) GROUP BY guild_id, forum, week)"""


def digests(spark, sf_dir):
    s = F.col("story_id")
    st = B.stories(spark, sf_dir).withColumn("week", s % 4)
    rank = F.row_number().over(W.partitionBy("guild_id", "forum", "week").orderBy("story_id"))
    top = st.select("guild_id", "forum", "week", "story_id", rank.alias("r")).filter("r <= 12")
    return top.groupBy("guild_id", "forum", "week").agg(F.array_sort(F.collect_list("story_id")).alias("story_ids")).select(
        (F.col("week") * 10 + F.col("guild_id")).alias("digest_id"), "guild_id", "forum",
        F.timestamp_micros(F.lit(B.BASE_US) + F.col("week") * 7 * 86400000000).alias("week_start"),
        F.when(F.col("week") % 2 == 0, "posted").otherwise("failed").alias("delivery_state"), "story_ids",
    )


def unique_digests(spark, sf_dir):
    """Digest ids made unique over forums."""
    return digests(spark, sf_dir).withColumn(
        "digest_id", F.col("digest_id") * 100 + F.position(F.col("forum"), F.lit("en fr de es"))
    )


UDIGEST_CTE = DIGEST_CTE.replace("week * 10 + guild_id AS", "(week * 10 + guild_id) * 100 + instr('en fr de es', forum) AS")
MEMBERS_CTE = f"""{UDIGEST_CTE}, mem AS (SELECT digest_id, guild_id, forum, week_start, delivery_state, generate_subscripts(story_ids, 1) - 1 AS position, unnest(story_ids) AS story_id FROM digests),
 live AS (SELECT m.digest_id, m.guild_id AS g, m.forum AS f, m.week_start, m.delivery_state, m.position, s.* FROM mem m JOIN stories s USING (story_id) WHERE {Q.PUBLISHED.replace("publication_state", "s.publication_state").replace("AND state", "AND s.state")})"""


@query("j7_digest_stories", f"{ST}, {MEMBERS_CTE} SELECT digest_id, CAST(position AS INTEGER) AS position, story_id FROM live")
def j7(spark, sf_dir):
    return E.digest_members(unique_digests(spark, sf_dir), B.stories(spark, sf_dir)).select("digest_id", "position", "story_id")


@query(
    "w8_latest_digest",
    f"""{ST}, {MEMBERS_CTE} SELECT g AS guild_id, f AS forum, arg_max(digest_id, (week_start, digest_id)) AS digest_id, epoch_us(max(week_start)) AS week_us
    FROM live WHERE delivery_state = 'posted' GROUP BY ALL""",
)
def w8(spark, sf_dir):
    d = E.latest_digests(unique_digests(spark, sf_dir), B.stories(spark, sf_dir))
    return d.select("guild_id", "forum", "digest_id", F.unix_micros("week_start").alias("week_us"))


TITLE_SQL = f"coalesce(nullif(trim({O.plain('title', 100)}, ' .-|•'), ''), 'New feed item')"


SITE, THREADS = "https://news.example", "https://threads.example"


def analysed(spark, sf_dir):
    """Stories with an analysis: the summary under headings, with cited links."""
    s = F.col("story_id").cast("string")
    copy = F.concat(F.lit("https://copy.example/s/"), s, F.lit("/?ref=x"))
    text = F.concat(
        F.col("summary"), F.lit("\n**Key facts**\n- "), F.col("title"), F.lit(" with a longer account of what followed\n- "), F.col("summary"),
        F.lit("\n**Unclear or disputed**\n- It is unknown who was there.\n**Sources**\n- [Outlet](https://a.example/"), s, F.lit(")\n- [Own]("), copy,
        F.lit(")\n- [Outlet](https://a.example/"), s, F.lit(")"),
    )
    return B.stories(spark, sf_dir).withColumn("analysis", text)


STORY_TEXT_CTE = f"""analyses AS (SELECT story_id AS doc_id, title, CASE WHEN analysis_state = 'ready' THEN summary || chr(10) || '**Key facts**' || chr(10) || '- ' || title
   || ' with a longer account of what followed' || chr(10) || '- ' || summary || chr(10) || '**Unclear or disputed**' || chr(10) || '- It is unknown who was there.' ELSE summary END AS body
   FROM stories WHERE {Q.PUBLISHED}), {LINES_CTE}"""
SECTIONS_CTE = """sections AS (SELECT doc_id AS story_id, trim(coalesce(string_agg(c, ' ' ORDER BY i) FILTER (WHERE heading = 'Summary'), '')) AS summary,
   coalesce(string_agg(c, '|' ORDER BY i) FILTER (WHERE heading = 'Key facts'), '') AS key_facts,
   coalesce(string_agg(c, '|' ORDER BY i) FILTER (WHERE heading = 'Unclear or disputed'), '') AS uncertainty FROM kept GROUP BY doc_id)"""


def full_digests(spark, sf_dir):
    day = F.expr("INTERVAL 7 DAYS")
    return unique_digests(spark, sf_dir).withColumns({
        "title": F.lit("Top Stories"), "overview": F.concat(F.lit("The week in "), "forum"), "week_end": F.col("week_start") + day,
    })


@query(
    "v6_weekly_digest_item",
    f"""{ST}, {MEMBERS_CTE}, {STORY_TEXT_CTE}, {SECTIONS_CTE}, n AS (SELECT story_id, count(*) AS source_count FROM articles GROUP BY story_id)
    SELECT digest_id, 'Top Stories' AS title, 'The week in ' || l.f AS overview, epoch_us(week_start) AS start_us, epoch_us(week_start + INTERVAL 7 DAY) AS end_us,
      string_agg(story_id || '~' || {TITLE_SQL} || '~' || coalesce(nullif(x.summary, ''), l.summary) || '~' || coalesce(key_facts, '') || '~' || coalesce(uncertainty, '') || '~' || state || '~'
        || source_count || '~' || array_to_string(tags, '|') || '~https://news.example/news/story/' || story_id || '/', chr(10) ORDER BY position) AS stories
    FROM live l JOIN n USING (story_id) LEFT JOIN sections x USING (story_id) GROUP BY digest_id, l.f, week_start""",
)
def v6(spark, sf_dir):
    n = B.articles(spark, sf_dir).groupBy("story_id").agg(F.count(F.lit(1)).alias("source_count"))
    items = IT.digest_items(full_digests(spark, sf_dir), analysed(spark, sf_dir), n, SITE)
    line = lambda x: F.concat_ws(
        "~", x["id"].cast("string"), x["title"], x["summary"], F.array_join(x["key_facts"], "|"), F.array_join(x["uncertainty"], "|"), x["state"],
        x["source_count"].cast("string"), F.array_join(x["tags"], "|"), x["web_url"],
    )
    return items.select(
        "digest_id", "title", "overview", F.unix_micros("week_start").alias("start_us"), F.unix_micros("week_end").alias("end_us"),
        F.array_join(F.transform("stories", line), "\n").alias("stories"),
    )


@query(
    "v7_digest_cards",
    f"""{ST}, {MEMBERS_CTE}, analyses AS (SELECT story_id AS doc_id, title, CASE WHEN analysis_state = 'ready' THEN summary || chr(10) || '**Key facts**' || chr(10) || '- ' || summary
      || chr(10) || '**Unclear or disputed**' || chr(10) || '- It is unknown.' ELSE summary END AS body FROM stories WHERE {Q.PUBLISHED}), {LINES_CTE}, {SECTIONS_CTE},
    points AS (SELECT doc_id AS story_id, heading, c, row_number() OVER (PARTITION BY doc_id, heading ORDER BY i) AS r FROM kept WHERE heading IN ('Key facts', 'Unclear or disputed')),
    said AS (SELECT s.story_id, 'summary' AS kind, 1 AS r, coalesce(nullif(x.summary, ''), s.summary) AS t FROM stories s LEFT JOIN sections x USING (story_id) WHERE {Q.PUBLISHED.replace("publication_state", "s.publication_state").replace("AND state", "AND s.state")}
      UNION ALL SELECT story_id, CASE WHEN heading = 'Key facts' THEN 'fact' ELSE 'doubt' END, r, c FROM points WHERE r <= CASE WHEN heading = 'Key facts' THEN 2 ELSE 1 END),
    sized AS (SELECT *, unnest(CASE kind WHEN 'summary' THEN [300, 220] WHEN 'fact' THEN [150, 100] ELSE [150] END) AS lim FROM (SELECT *, {O.plain('t', 2000)} AS c FROM said)),
    cuts AS (SELECT *, string_split(regexp_replace(c, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS ps FROM sized),
    fits AS (SELECT *, len(list_filter(range(1, len(ps) + 1), lambda i: length(array_to_string(ps[1:i], ' ')) <= lim)) AS k,
      regexp_replace(regexp_replace(substring(ps[1], 1, lim), ' [^ ]*$', ''), '[,;:]+$', '') AS head FROM cuts),
    x AS MATERIALIZED (SELECT story_id, kind, r, lim, CASE WHEN length(c) <= lim THEN c WHEN length(ps[1]) > lim THEN CASE WHEN head <> '' THEN head || '.' ELSE ps[1] END ELSE array_to_string(ps[1:k], ' ') END AS e FROM fits),
    parts AS (SELECT story_id, max(e) FILTER (WHERE kind = 'summary' AND lim = 300) AS s1, max(e) FILTER (WHERE kind = 'summary' AND lim = 220) AS s2,
      string_agg('• ' || e, chr(10) ORDER BY r) FILTER (WHERE kind = 'fact' AND lim = 150) AS f1, max('• ' || e) FILTER (WHERE kind = 'fact' AND lim = 100 AND r = 1) AS f2,
      max(e) FILTER (WHERE kind = 'doubt') AS d1 FROM x GROUP BY story_id),
    n AS (SELECT story_id, count(*) AS source_count FROM articles GROUP BY story_id),
    base AS (SELECT digest_id, position + 1 AS position, story_id, position + 1 || '. ' || {TITLE_SQL} AS line, p.*, upper(state[1]) || state[2:] || ' | ' || source_count || CASE WHEN source_count = 1 THEN ' source' ELSE ' sources' END || ' | ' AS glance,
      coalesce(nullif(array_to_string(list_filter(tags, lambda t: lower(t) <> lower(state)), ', '), ''), 'General') AS tagged FROM live JOIN n USING (story_id) JOIN parts p USING (story_id)),
    cards AS (SELECT digest_id, position, story_id, concat_ws(chr(10), line, '**Summary**' || chr(10) || s1, 'Key facts' || chr(10) || f1, 'Unclear or disputed' || chr(10) || d1, 'At a glance' || chr(10) || glance || {O.plain('tagged', 80)}) AS full_card,
      concat_ws(chr(10), line, '**Summary**' || chr(10) || s2, 'Key facts' || chr(10) || f2, 'At a glance' || chr(10) || glance || {O.plain('tagged', 40)}) AS compact FROM base),
    judged AS (SELECT *, sum(length(full_card)) OVER (PARTITION BY digest_id) + 160 > 5900 AS is_compact FROM cards)
    SELECT digest_id, CAST(position AS INTEGER) AS position, story_id, is_compact, CASE WHEN is_compact THEN compact ELSE full_card END AS card FROM judged""",
)
def v7(spark, sf_dir):
    n = B.articles(spark, sf_dir).groupBy("story_id").agg(F.count(F.lit(1)).alias("source_count"))
    st = B.stories(spark, sf_dir)
    text = F.concat(F.col("summary"), F.lit("\n**Key facts**\n- "), F.col("summary"), F.lit("\n**Unclear or disputed**\n- It is unknown."))
    told = E.analysis_of(st.withColumn("analysis", text))
    mem = E.digest_members(unique_digests(spark, sf_dir), st).select("digest_id", "position", "story_id").join(told, "story_id").join(n, "story_id")
    ready = mem.select(
        "digest_id", (F.col("position") + 1).alias("position"), "story_id", forum_title(F.col("title")).alias("title_line"),
        F.coalesce(F.nullif(F.col("sections.summary"), F.lit("")), F.col("summary")).alias("summary"),
        F.col("sections.key_facts").alias("facts"), F.col("sections.uncertainty").alias("uncertainty"), "tags", "state", "source_count",
    )
    return E.digest_cards(ready, overview_chars=160)


@query(
    "w10_timeline",
    f"""{QD.VISIBLE_CTE}, v AS (SELECT v.story_id, v.history_id, v.detail, a.publisher, h.created_at FROM visible v JOIN history h ON h.history_id = v.history_id JOIN articles a ON a.article_id = h.article_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY story_id ORDER BY created_at DESC, history_id DESC) AS r, count(*) OVER (PARTITION BY story_id) AS n FROM v),
    t AS (SELECT story_id, any_value(n) AS n, list('**Update**' || chr(10) || detail || chr(10) || publisher ORDER BY r DESC) FILTER (WHERE r <= 2) AS tail FROM r GROUP BY story_id),
    o AS (SELECT story_id, arg_min(publisher, article_id) AS publisher FROM articles GROUP BY story_id),
    e AS (SELECT o.story_id, coalesce(n, 0) AS updates, list_concat(list_concat(['**Original report**' || chr(10) || publisher],
      CASE WHEN n > 2 THEN [CAST(n - 2 AS VARCHAR) || ' earlier updates are on the story page'] ELSE [] END), coalesce(tail, [])) AS e FROM o LEFT JOIN t USING (story_id))
    SELECT story_id, updates, coalesce(list_filter(list_transform(range(0, len(e)), lambda k: array_to_string(list_concat(e[1:1], e[k + 2:]), chr(10) || chr(10))), lambda x: length(x) <= 1024)[1], e[1]) AS timeline FROM e""",
)
def w10(spark, sf_dir):
    seen = QD.visible(spark, sf_dir)
    first = seen[1]
    shown = QD.visible_rows(spark, sf_dir, seen).select(
        "story_id", "history_id", F.unix_micros("recorded_at").alias("recorded_us"),
        F.concat(F.lit("**Update**\n"), "detail", F.lit("\n"), "publisher").alias("entry"),
    )
    primaries = first.select("story_id", F.concat(F.lit("**Original report**\n"), "publisher").alias("entry"))
    return E.timelines(primaries, shown)


@query(
    "v5_story_sources",
    f"""WITH {QD.COPIES_CTE}, o AS (SELECT u.*, {O.outlet_columns('publisher', 'url')} FROM unique_copies u JOIN (SELECT story_id FROM stories WHERE {Q.PUBLISHED}) USING (story_id))
    SELECT story_id, article_id, bias, bias_score, {O.safe_link('url')} AS url, epoch_us(published_at) AS published_us FROM o""",
)
def v5_sources(spark, sf_dir):
    """Source rows of published stories, ordered by (published, id); a list is its reader's choice."""
    st = B.stories(spark, sf_dir).filter(S.is_published()).select("story_id")
    pub, url = F.col("publisher"), F.col("url")
    return S.unique_articles(QD.copies(spark, sf_dir)).join(st, "story_id", "left_semi").select(
        "story_id", "article_id", source_bias_bucket(pub, url).alias("bias"), source_bias_score(pub, url).alias("bias_score"),
        safe_external_link(url).alias("url"), F.unix_micros("published_at").alias("published_us"),
    )


def items(spark, sf_dir, stories):
    every = B.stories(spark, sf_dir)
    return IT.story_items(stories, every, QD.copies(spark, sf_dir), QD.visible_rows(spark, sf_dir), Q.edges(spark, sf_dir), SITE, THREADS)


ITEMS_TWIN = f"""{QD.VISIBLE_CTE.replace('firsts', 'first_ids')}, {STORY_TEXT_CTE}, {BODY_CTE}, {Q.EDGES_CTE}, {QD.COPIES_CTE[len(B.STORIES_CTE) + 2:]},
 pub AS (SELECT * FROM stories WHERE {Q.PUBLISHED}),
 f0 AS (SELECT article_id, title, summary, url, published_at, {O.plain('title', 500)} AS head, {O.plain('summary', 1000)} AS d, {LABEL[0]} FROM (SELECT *, publisher AS p, url AS u FROM copies)),
 f1 AS (SELECT *, {LABEL[1]}, {O.squash(O.fold('d'))} AS low FROM f0),
 f2 AS MATERIALIZED (SELECT *, {LABEL[2]}, {O.ascii_words('low')} AS asc_low, regexp_extract_all(low, '[a-z0-9]+') AS w FROM f1),
 shown AS MATERIALIZED (SELECT article_id, {LABEL[3]} || '~' || bias || '~' || coalesce(bias_score::VARCHAR, '') || '~' || {TITLE_SQL} || '~'
   || CASE WHEN d = '' OR {O.artifacts('low', 'asc_low', 'w')} OR {O.compared('d')} = {O.compared('head')} THEN '' ELSE d END || '~' || {O.safe_link('url')} || '~' || epoch_us(published_at) AS item
   FROM f2 JOIN (SELECT article_id, {O.outlet_columns('publisher', 'url')} FROM copies) USING (article_id)),
 src AS (SELECT story_id, string_agg(item, chr(10) ORDER BY published_at, article_id) AS sources, count(*) AS n_sources FROM unique_copies JOIN shown USING (article_id) GROUP BY story_id),
 upd AS (SELECT v.story_id, string_agg(item || '~' || v.detail || '~' || CASE WHEN h.action = 'major_update' THEN 'major' ELSE 'source' END || '~' || epoch_us(h.created_at), chr(10) ORDER BY h.created_at, v.history_id) AS updates, count(*) AS n_updates
   FROM visible v JOIN history h ON h.history_id = v.history_id JOIN shown s ON s.article_id = h.article_id GROUP BY v.story_id),
 rel AS (SELECT b.story_id, string_agg(b.related_id || '~' || {TITLE_SQL} || '~' || coalesce('{{threads}}/' || guild_id || '/' || thread_id, '') || '~{{site}}/news/story/' || b.related_id || '/', chr(10) ORDER BY s.last_updated_at DESC, b.related_id DESC) AS related, count(*) AS n_related
   FROM (SELECT low AS story_id, high AS related_id FROM edges UNION ALL SELECT high, low FROM edges) b JOIN stories s ON s.story_id = b.related_id WHERE s.state <> 'merged' GROUP BY b.story_id),
 own AS (SELECT DISTINCT story_id FROM copies WHERE canonical_url <> ''),
 item AS MATERIALIZED (SELECT p.story_id, {TITLE_SQL} AS title, coalesce(b.body, '') AS analysis,
   CASE WHEN analysis_state = 'ready' THEN 'Outlet~https://a.example/' || p.story_id || CASE WHEN o.story_id IS NULL THEN chr(10) || 'Own~https://copy.example/s/' || p.story_id || '/?ref=x' ELSE '' END ELSE '' END AS cited,
   analysis_state, state, array_to_string(tags, '|') AS tags, epoch_us(a.published_at) AS published_us, epoch_us(last_updated_at) AS updated_us, '{{threads}}/' || guild_id || '/' || thread_id AS thread_url,
   '{{site}}/news/story/' || p.story_id || '/' AS web_url, x.item AS original, sources, coalesce(updates, '') AS updates, coalesce(related, '') AS related,
   n_sources, coalesce(n_updates, 0) AS n_updates, coalesce(n_related, 0) AS n_related
   FROM pub p LEFT JOIN bodies b ON b.doc_id = p.story_id JOIN shown x ON x.article_id = p.primary_article_id JOIN (SELECT article_id, published_at FROM items) a ON a.article_id = p.primary_article_id
   LEFT JOIN src USING (story_id) LEFT JOIN upd USING (story_id) LEFT JOIN rel USING (story_id) LEFT JOIN own o ON o.story_id = p.story_id)"""
ITEMS_TWIN = ITEMS_TWIN.replace("{site}", SITE).replace("{threads}", THREADS)


def _flat_source(x):
    return [
        x["publisher"], x["bias"], F.coalesce(x["bias_score"].cast("string"), F.lit("")), x["title"], x["description"], x["url"],
        F.unix_micros(x["published_at"]).cast("string"),
    ]


def flat_items(rows):
    """An item's nested fields as texts, for comparison."""
    lines = lambda c, f: F.array_join(F.transform(c, f), "\n").alias(c)
    return rows.select(
        "story_id", "title", "analysis", F.array_join(F.transform("analysis_sources", lambda x: F.concat_ws("~", x["publisher"], x["url"])), "\n").alias("cited"),
        "analysis_state", "state", F.array_join("tags", "|").alias("tags"), F.unix_micros("published_at").alias("published_us"), F.unix_micros("updated_at").alias("updated_us"),
        "thread_url", "web_url", F.concat_ws("~", *_flat_source(F.col("original"))).alias("original"), lines("sources", lambda x: F.concat_ws("~", *_flat_source(x))),
        lines("updates", lambda x: F.concat_ws("~", *_flat_source(x), x["detail"], x["kind"], F.unix_micros(x["recorded_at"]).cast("string"))),
        lines("related", lambda x: F.concat_ws("~", x["id"].cast("string"), x["title"], F.coalesce(x["thread_url"], F.lit("")), x["web_url"])),
        "n_sources", "n_updates", "n_related",
    )


@query("v5_story_items", f"{ITEMS_TWIN} SELECT * FROM item")
def v5(spark, sf_dir):
    """The whole item of every published story."""
    return flat_items(items(spark, sf_dir, analysed(spark, sf_dir).filter(S.is_published())))


@query(
    "s10_story_feed_sink",
    f"""{ITEMS_TWIN}, page AS (SELECT *, row_number() OVER (ORDER BY last_updated_at DESC, story_id DESC) AS position FROM pub ORDER BY position LIMIT 15),
    t AS (SELECT tag, count(*) AS n FROM (SELECT unnest(tags) AS tag FROM pub) GROUP BY tag), balance AS (SELECT outlet, bias, count(*) AS appearances FROM (SELECT DISTINCT story_id, outlet, bias FROM (SELECT story_id, {O.outlet_columns('publisher', 'url')} FROM articles)
      JOIN (SELECT story_id FROM pub) USING (story_id)) GROUP BY ALL)
    SELECT 7 AS version, (SELECT count(*) FROM pub) AS total, (SELECT count(*) FROM pub) > 15 AS has_more,
      (SELECT string_agg(tag || '=' || n, '|' ORDER BY tag) FROM t) AS tag_counts,
      (SELECT string_agg(outlet || '~' || bias || '~' || appearances, chr(10) ORDER BY appearances DESC, outlet, bias) FROM balance) AS outlets,
      (SELECT coalesce(sum(appearances) FILTER (WHERE bias IN ('left', 'center-left', 'center', 'right', 'center-right')), 0)::BIGINT FROM balance) AS rated,
      (SELECT string_agg(item.story_id || '~' || item.title || '~' || item.analysis || '~' || item.sources || '~' || item.updates, chr(10) ORDER BY position) FROM page JOIN item USING (story_id)) AS stories""",
)
def s10(spark, sf_dir):
    """The feed document with its page of 15 items, written as JSON and read again."""
    live = analysed(spark, sf_dir).filter(S.is_published())
    page = cut_lineage(S.page(live, 15))
    latest = E.latest_digests(unique_digests(spark, sf_dir), B.stories(spark, sf_dir)).orderBy(F.desc("week_start"), F.desc("digest_id")).limit(1)
    n = B.articles(spark, sf_dir).groupBy("story_id").agg(F.count(F.lit(1)).alias("source_count"))
    digest = IT.digest_items(full_digests(spark, sf_dir).join(F.broadcast(latest.select("digest_id")), "digest_id"), analysed(spark, sf_dir), n, SITE)
    doc = IT.feed_document(page, items(spark, sf_dir, page.select(*live.columns)), live, Q.balance(spark, sf_dir), digest, Q.now())
    folder = f"{ensure_checkpoint_dir(spark)}/feed-{uuid.uuid4().hex}"
    micros = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}
    doc.coalesce(1).write.options(**micros).json(folder)
    back = spark.read.schema(doc.schema).options(**micros).json(folder)
    flat = flat_items(back.select(F.posexplode("stories").alias("at", "s")).select("s.*", *[F.lit(0).alias(c) for c in ("n_sources", "n_updates", "n_related")], "at"))
    told = F.concat_ws("~", F.col("story_id").cast("string"), "title", "analysis", "sources", "updates")
    order = back.select(F.posexplode("stories").alias("at", "s")).select("at", F.col("s.story_id").alias("story_id"))
    stories = flat.join(order, "story_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", told.alias("t")))), lambda x: x["t"]), "\n").alias("stories"))
    b = F.col("source_balance")
    return back.select(
        F.col("version").cast("int").alias("version"), "total", "has_more",
        F.array_join(F.transform("tag_counts", lambda x: F.concat_ws("=", x["tag"], x["stories"].cast("string"))), "|").alias("tag_counts"),
        F.array_join(F.transform(b["outlets"], lambda x: F.concat_ws("~", x["outlet"], x["bias"], x["appearances"].cast("string"))), "\n").alias("outlets"),
        b["rated_appearances"].alias("rated"),
    ).crossJoin(stories)
