"""Logical inputs (items, articles, stories, feeds, history, messages) from the given tables.

All values that the tables lack are modulo rules over ids, so a query and its SQL twin see the
same rows.  ``*_CTE`` holds the SQL text of each binding.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storyline.functions import fixed
from storyline.functions.text import literal_array

PHRASES = (
    "Federal Reserve cuts interest rates by 25 basis points",
    "Fed lowers interest rates by a quarter point",
    "NASA launches spacecraft to study climate",
    "Supreme Court rejects appeal over election",
    "OpenAI unveils artificial intelligence chatbot",
    "Bitcoin hits 90 million as crypto market rises",
    "Hurricane kills 12 and triggers evacuation",
    "Earthquake death toll reaches 340",
    "Senate approves government funding",
    "President resigns after parliament vote",
    "Regulators ban exports of semiconductor hardware",
    "Hospital outbreak of disease spreads",
    "Ceasefire talks continue as airstrike hits city",
    "Reuters: company acquires startup for 3.5 billion",
    "Football league championship tournament final",
    "Police charged with murder in prison",
    "Trade war tariff raises inflation",
    "Ransomware attack strikes White House",
    "Stocks could fall as investors forecast recession",
    "Breaking news: explosion at factory",
    "Celebrity fashion newsletter",
    "Trademark dispute over name in United States",
    "Company valued at 2 billion in funding round",
    "Court may block merger of automaker",
    "Fact check: verified claim about vaccine",
)
PUBLISHERS = (
    "Reuters", "AP News", "BBC News", "NPR", "Fox News", "WSJ", "The Guardian",
    "Department of Energy", "Local Gazette", "CNN", "Straßenblatt", "microsoft com", "Newsmax",
    "Government Register", "Time", "- Town Crier -", "The Hill",
)
HOSTS = (
    "reuters.com", "apnews.com", "bbc.co.uk", "energy.gov", "example.com", "news.sky.com",
    "foxnews.com", "gazette.example.org", "m.ft.com", "data.gov.uk", "npr.org",
)
PRIORITIES = {"reuters": 3, "ap news": 3, "bbc news": 2, "src3": 1, "src7": 2}
PUBLICATION = ("published", "published", "pending", "published", "failed", "published",
               "uncertain", "published", "published", "pending")
ANALYSIS = ("disabled", "ready", "failed", "ready", "disabled")
ZONE, WEEKDAY, HOUR = "America/Chicago", 5, 12
NOW = "2024-01-09 00:00:00"
BASE_US = 1704067200000000  # 2024-01-01T00:00:00Z


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A given table; naive times are UTC, as everywhere in the engine."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    naive = [f.name for f in df.schema if f.dataType.typeName() == "timestamp_ntz"]
    df = df.withColumns({c: F.col(c).cast("timestamp") for c in naive}) if naive else df
    # A text table in one small file would keep all but one core idle; tables with enough
    # splits, as on a cluster, are never shuffled here.
    cores = spark.sparkContext.defaultParallelism
    if table in ("documents", "pages") and df.rdd.getNumPartitions() < cores:
        df = df.repartition(cores)
    return df


def pick(options, index: Column) -> Column:
    """Literal list lookup by a zero-based index column."""
    return F.get(literal_array(options), (index % len(options)).cast("int"))


def sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def sql_pick(options, index: str) -> str:
    inner = ", ".join(sql_text(o) for o in options)
    return f"([{inner}])[CAST(({index}) % {len(options)} AS INTEGER) + 1]"


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feed items: documents dated by the event of the same id."""
    return items_of(read(spark, sf_dir, "documents"), event_times(spark, sf_dir))


def event_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates by document id: event times, stretched threefold so that documents span days."""
    spread = F.timestamp_micros(F.lit(BASE_US) + (F.unix_micros("ts") - BASE_US) * 3)
    return read(spark, sf_dir, "events").select(F.col("event_id").alias("doc_id"), spread.alias("ts"))


def items_of(documents: DataFrame, when: DataFrame) -> DataFrame:
    """Feed items from documents and their dates."""
    docs = documents.select("doc_id", "text", "lang", "source")
    i = F.col("doc_id")
    lead = F.regexp_replace(
        F.regexp_extract("text", r"^\s*(\S+(?:\s+\S+){0,11})", 1), r"\s+", " "
    )
    short = F.regexp_extract(lead, r"^(\S+(?: \S+){0,2})", 1)
    # A sixth of all items repeat five headlines (near copies); another sixth vary on all phrases.
    phrase = F.when(i % 6 == 0, pick(PHRASES[:5], F.floor(i / 6))).otherwise(pick(PHRASES, F.floor(i / 3)))
    title = (
        F.when(i % 6 == 0, phrase)
        .when(i % 3 == 0, F.concat(phrase, F.lit(" "), short))
        .otherwise(lead)
    )
    summary = (
        F.when(i % 7 == 3, F.concat(pick(fixed.PAGE_MARKERS, i), F.lit(" "), F.col("text")))
        .when(i % 3 == 0, F.concat(phrase, F.lit(". "), F.col("text")))
        .otherwise(F.col("text"))
    )
    page = F.when(i % 11 == 0, i - i % 7).otherwise(i).cast("string")
    url = F.when(i % 5 == 0, F.lit("")).otherwise(
        F.concat(
            F.lit("HTTPS://WWW."), pick(HOSTS, i), F.lit(":443/news//"), F.col("lang"),
            F.lit("/item-"), page, F.lit("/?utm_source=feed&b=2&a="), (i % 3).cast("string"),
            F.lit("&q=x%20y#top"),
        )
    )
    return docs.join(when, "doc_id").select(
        i.alias("article_id"),
        i.cast("string").alias("external_id"),
        (i % 20 + 1).alias("feed_id"),
        F.floor(i / 3).alias("story_id"),
        F.lit(1).cast("bigint").alias("guild_id"),
        F.col("lang").alias("forum"),
        F.col("source").alias("feed_name"),
        title.alias("title"),
        summary.alias("summary"),
        pick(PUBLISHERS, i).alias("publisher"),
        url.alias("url"),
        F.col("ts").alias("published_at"),
    )


ITEMS_CTE = f"""lead AS (
  SELECT d.doc_id AS i, d.text, d.lang, d.source,
         make_timestamp({BASE_US} + (epoch_us(e.ts) - {BASE_US}) * 3) AS ts,
         regexp_replace(regexp_extract(d.text, '^\\s*(\\S+(?:\\s+\\S+){{0,11}})', 1), '\\s+', ' ', 'g') AS lead
  FROM documents d JOIN events e ON d.doc_id = e.event_id),
items AS (
  SELECT i AS article_id, CAST(i AS VARCHAR) AS external_id, i % 20 + 1 AS feed_id,
         i // 3 AS story_id, CAST(1 AS BIGINT) AS guild_id, lang AS forum, source AS feed_name,
         CASE WHEN i % 6 = 0 THEN {sql_pick(PHRASES[:5], "i // 6")}
              WHEN i % 3 = 0 THEN {sql_pick(PHRASES, "i // 3")} || ' ' ||
              regexp_extract(lead, '^(\\S+(?: \\S+){{0,2}})', 1) ELSE lead END AS title,
         CASE WHEN i % 7 = 3 THEN {sql_pick(fixed.PAGE_MARKERS, "i")} || ' ' || text
              WHEN i % 6 = 0 THEN {sql_pick(PHRASES[:5], "i // 6")} || '. ' || text
              WHEN i % 3 = 0 THEN {sql_pick(PHRASES, "i // 3")} || '. ' || text
              ELSE text END AS summary,
         {sql_pick(PUBLISHERS, "i")} AS publisher,
         CASE WHEN i % 5 = 0 THEN '' ELSE 'HTTPS://WWW.' || {sql_pick(HOSTS, "i")} ||
              ':443/news//' || lang || '/item-' ||
              CAST(CASE WHEN i % 11 = 0 THEN i - i % 7 ELSE i END AS VARCHAR) ||
              '/?utm_source=feed&b=2&a=' || CAST(i % 3 AS VARCHAR) || '&q=x%20y#top' END AS url,
         ts AS published_at
  FROM lead)"""


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored articles: items plus delivery state; descriptions are the item summaries."""
    i = F.col("article_id")
    return items(spark, sf_dir).select(
        "*",
        pick(fixed.DELIVERY_STATES, i).alias("delivery_state"),
        (i % 4).cast("int").alias("priority"),
    )


ARTICLES_CTE = (
    ITEMS_CTE
    + f""",
articles AS (
  SELECT *, {sql_pick(fixed.DELIVERY_STATES, "article_id")} AS delivery_state,
         CAST(article_id % 4 AS INTEGER) AS priority
  FROM items)"""
)


def stories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stories of up to three articles; states and flags follow modulo rules."""
    s = F.col("story_id")
    first = lambda c: F.min_by(c, "article_id").alias(c)
    grouped = items(spark, sf_dir).groupBy("story_id").agg(
        first("title"),
        first("summary"),
        first("forum"),
        F.min("article_id").alias("primary_article_id"),
        F.min("published_at").alias("first_published_at"),
        F.max("published_at").alias("last_published_at"),
    )
    return grouped.select(
        "story_id",
        (s % 2 + 1).alias("guild_id"),
        "forum",
        "title",
        "summary",
        pick(fixed.STORY_STATES, s).alias("state"),
        pick(PUBLICATION, s).alias("publication_state"),
        F.when(s % 11 != 0, s + 1000000).alias("thread_id"),
        F.when(s % 13 == 0, F.col("last_published_at")).alias("cleared_at"),
        F.array_distinct(
            F.array(pick(fixed.TAG_CATALOG, s), pick(fixed.TAG_CATALOG, s * 7 + 3))
        ).alias("tags"),
        pick(ANALYSIS, s).alias("analysis_state"),
        (s % 12).cast("int").alias("presentation_version"),
        (s % 4).cast("int").alias("primary_priority"),
        "primary_article_id",
        "first_published_at",
        "last_published_at",
        F.col("last_published_at").alias("last_updated_at"),
        F.col("first_published_at").alias("created_at"),
    )


STORIES_CTE = (
    ARTICLES_CTE
    + f""",
story_base AS (
  SELECT story_id AS s, arg_min(title, article_id) AS title, arg_min(summary, article_id) AS summary,
         arg_min(forum, article_id) AS forum, min(article_id) AS primary_article_id,
         min(published_at) AS first_published_at, max(published_at) AS last_published_at
  FROM items GROUP BY story_id),
stories AS (
  SELECT s AS story_id, s % 2 + 1 AS guild_id, forum, title, summary,
         {sql_pick(fixed.STORY_STATES, "s")} AS state,
         {sql_pick(PUBLICATION, "s")} AS publication_state,
         CASE WHEN s % 11 <> 0 THEN s + 1000000 END AS thread_id,
         CASE WHEN s % 13 = 0 THEN last_published_at END AS cleared_at,
         CASE WHEN {sql_pick(fixed.TAG_CATALOG, "s")} = {sql_pick(fixed.TAG_CATALOG, "s * 7 + 3")}
              THEN [{sql_pick(fixed.TAG_CATALOG, "s")}]
              ELSE [{sql_pick(fixed.TAG_CATALOG, "s")}, {sql_pick(fixed.TAG_CATALOG, "s * 7 + 3")}] END AS tags,
         {sql_pick(ANALYSIS, "s")} AS analysis_state,
         CAST(s % 12 AS INTEGER) AS presentation_version,
         CAST(s % 4 AS INTEGER) AS primary_priority,
         primary_article_id, first_published_at, last_published_at,
         last_published_at AS last_updated_at, first_published_at AS created_at
  FROM story_base)"""
)


def feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One feed per document source, with polling state derived from the source's dates."""
    f = F.col("feed_id")
    grouped = items(spark, sf_dir).groupBy("feed_id").agg(
        F.min("feed_name").alias("name"), F.max("published_at").alias("last_item_at"),
        F.count(F.lit(1)).alias("item_count"),
    )
    return grouped.select(
        "feed_id",
        (f % 2 + 1).alias("guild_id"),
        pick(("en", "fr", "de", "es"), f).alias("forum"),
        "name",
        F.concat(F.lit("https://"), pick(HOSTS, f), F.lit("/rss")).alias("source"),
        F.when(f % 5 == 0, F.lit("paused")).otherwise(F.lit("active")).alias("state"),
        (F.lit(300) * (f % 4 + 1)).alias("interval_seconds"),
        (f % 10).cast("int").alias("failure_count"),
        F.when(f % 6 == 0, F.lit("HTTP 500")).alias("last_error"),
        F.array(pick(fixed.TAG_CATALOG, f + 2)).alias("default_tags"),
        (f % 3 != 0).alias("summarization_enabled"),
        F.timestamp_micros(F.unix_micros("last_item_at") - f * 3600000000).alias("next_poll_at"),
        F.when(f % 4 != 0, F.col("last_item_at")).alias("last_polled_at"),
        "item_count",
    )


FEEDS_CTE = f"""feeds AS (
  SELECT f AS feed_id, f % 2 + 1 AS guild_id, {sql_pick(("en", "fr", "de", "es"), "f")} AS forum, name,
         'https://' || {sql_pick(HOSTS, "f")} || '/rss' AS source,
         CASE WHEN f % 5 = 0 THEN 'paused' ELSE 'active' END AS state,
         300 * (f % 4 + 1) AS interval_seconds, CAST(f % 10 AS INTEGER) AS failure_count,
         CASE WHEN f % 6 = 0 THEN 'HTTP 500' END AS last_error,
         [{sql_pick(fixed.TAG_CATALOG, "f + 2")}] AS default_tags,
         f % 3 <> 0 AS summarization_enabled,
         make_timestamp(epoch_us(last_item_at) - f * 3600000000) AS next_poll_at,
         CASE WHEN f % 4 <> 0 THEN last_item_at END AS last_polled_at, item_count
  FROM (SELECT feed_id AS f, min(feed_name) AS name, max(published_at) AS last_item_at,
               count(*) AS item_count FROM items GROUP BY feed_id))"""


HISTORY_ACTIONS = ("created", "major_update", "source_added", "manual_merge", "automatic_split")


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Story history: every event is an action on the article its id maps to."""
    ev = read(spark, sf_dir, "events")
    n = read(spark, sf_dir, "documents").agg(F.count(F.lit(1)).alias("n"))
    e = F.col("event_id")
    article = e % F.col("n")
    return ev.crossJoin(F.broadcast(n)).select(
        e.alias("history_id"),
        # Every seventh record still names the story its article has since left.
        F.floor((article + F.when(e % 7 == 0, 3).otherwise(0)) / 3).alias("story_id"),
        article.alias("article_id"),
        pick(HISTORY_ACTIONS, e + F.floor(e / F.col("n"))).alias("action"),
        F.col("user_id").alias("actor_id"),
        F.when(
            e % 4 == 0, F.concat(F.lit('{"update":"update '), e.cast("string"), F.lit('"}'))
        ).otherwise(F.lit("{}")).alias("detail"),
        F.col("ts").alias("created_at"),
    )


HISTORY_CTE = f"""history AS (
  SELECT e AS history_id, (a + CASE WHEN e % 7 = 0 THEN 3 ELSE 0 END) // 3 AS story_id, a AS article_id,
         {sql_pick(HISTORY_ACTIONS, "e + e // n")} AS action, user_id AS actor_id,
         CASE WHEN e % 4 = 0 THEN '{{"update":"update ' || CAST(e AS VARCHAR) || '"}}' ELSE '{{}}' END AS detail,
         ts AS created_at
  FROM (SELECT event_id AS e, event_id % n AS a, n, user_id, ts
        FROM events, (SELECT count(*) AS n FROM documents)))"""


def all_of(conditions) -> Column:
    return reduce(lambda a, b: a & b, conditions)
