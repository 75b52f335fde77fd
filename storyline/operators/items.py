"""Items that a reader of stories sees: a story with its sources, updates and relations; a digest; the feed document.

Every list of a story is cut to its first ``most`` entries by a rank below the shuffle, with the number of all beside it,
so a story with millions of sources is one row of bounded size and nothing is left out unseen.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from storyline.functions import analysis as A
from storyline.functions.outlets import publisher_label, source_bias_bucket, source_bias_score
from storyline.functions.text import forum_title, story_update_detail
from storyline.functions.urls import safe_external_link
from storyline.operators import dedup as D
from storyline.operators import digest as E
from storyline.operators import feed as S
from storyline.operators.redundancy import with_kept_lines
from storyline.session import cut_lineage

#: Entries of each list of a story.
MOST = 500
VERSION = 7


def source_fields() -> list[Column]:
    """What is shown of an article."""
    pub, url = F.col("publisher"), F.col("url")
    return [
        publisher_label(pub, url).alias("publisher"), source_bias_bucket(pub, url).alias("bias"), source_bias_score(pub, url).alias("bias_score"),
        forum_title(F.col("title")).alias("title"), story_update_detail(F.col("title"), F.col("summary"), 1000).alias("description"),
        safe_external_link(url).alias("url"), "published_at",
    ]


def story_url(site: str, story: Column) -> Column:
    return F.concat(F.lit(site.rstrip("/") + "/news/story/"), story.cast("string"), F.lit("/"))


def _thread(url: str, guild: Column, thread: Column) -> Column:
    return F.concat(F.lit(url.rstrip("/") + "/"), guild.cast("string"), F.lit("/"), thread.cast("string"))


def _listed(rows: DataFrame, order: list[Column], item: Column, name: str, most: int) -> DataFrame:
    """(story_id, name, n_name): the first ``most`` items of each story in order, and how many there are."""
    first = rows.withColumn("_r", F.row_number().over(W.partitionBy("story_id").orderBy(*order))).filter(F.col("_r") <= most)
    lists = first.select("story_id", "_r", item.alias("item")).groupBy("story_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_r", "item"))), lambda x: x["item"]).alias(name)
    )
    counts = rows.groupBy("story_id").agg(F.count("*").alias(f"n_{name}"))
    return lists.join(counts, "story_id")


def story_items(
    stories: DataFrame, every: DataFrame, articles: DataFrame, updates: DataFrame, edges: DataFrame, site: str, threads: str, most: int = MOST,
) -> DataFrame:
    """One row per story of ``stories``, its item assembled: the columns are the item's fields.

    ``stories`` needs story_id, guild_id, title, summary, analysis, analysis_state, state, tags, thread_id,
    primary_article_id, first_published_at and last_updated_at; ``every`` holds all stories, for the titles of related ones;
    ``articles`` (with canonical_url) and visible ``updates`` (with detail and kind) of any story; ``edges`` as (low, high).
    A story without a primary article shows its first one, without articles none. Null dates sort first.
    """
    ids = cut_lineage(stories.select("story_id", "primary_article_id"))
    arts = cut_lineage(articles.join(ids.select("story_id"), "story_id", "left_semi"))
    sources = _listed(S.unique_articles(arts), [F.col("published_at"), F.col("article_id")], F.struct(*source_fields()), "sources", most)
    rank = F.struct((F.col("article_id") != F.coalesce("primary_article_id", F.lit(-1))).alias("other"), "published_at", "article_id")
    fields = ["article_id", "publisher", "title", "summary", "url", "published_at"]
    first = arts.join(ids, "story_id").groupBy("story_id").agg(F.min_by(F.struct(*fields), rank).alias("a")).select("story_id", "a.*")
    original = first.select("story_id", F.struct(*source_fields()).alias("original"))
    told = updates.join(ids.select("story_id"), "story_id", "left_semi")
    update = F.struct(*source_fields(), "detail", F.when(F.col("kind") == "major_update", "major").otherwise("source").alias("kind"), "recorded_at")
    told = _listed(told, [F.col("recorded_at"), F.col("history_id")], update, "updates", most)
    others = every.select(F.col("story_id").alias("related_id"), F.col("title").alias("_t"), F.col("guild_id").alias("_g"), F.col("thread_id").alias("_th"))
    near = S.neighbours(edges, every).join(ids.select("story_id"), "story_id", "left_semi").join(others, "related_id")
    relation = F.struct(
        F.col("related_id").alias("id"), forum_title(F.col("_t")).alias("title"), _thread(threads, F.col("_g"), F.col("_th")).alias("thread_url"),
        story_url(site, F.col("related_id")).alias("web_url"),
    )
    near = _listed(near, [F.desc("last_updated_at"), F.desc("related_id")], relation, "related", most)
    text = F.when((F.col("analysis_state") == "ready") & (F.coalesce("analysis", F.lit("")) != ""), F.col("analysis")).otherwise(F.col("summary"))
    shown = cut_lineage(with_kept_lines(stories.withColumn("_text", text), "story_id", "_text", "title"))
    cited = D.subtract_article_urls(A.analysis_sources(shown, "story_id", "_text"), arts)
    cited = cited.groupBy("story_id").agg(  # twelve at most
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "label", "url"))), lambda x: F.struct(x["label"].alias("publisher"), x["url"].alias("url"))).alias("analysis_sources")
    )
    head = shown.select(
        "story_id", forum_title(F.col("title")).alias("title"), A.analysis_body(F.col("kept")).alias("analysis"),
        "analysis_state", "state", "tags", "first_published_at", F.col("last_updated_at").alias("updated_at"),
        _thread(threads, F.col("guild_id"), F.col("thread_id")).alias("thread_url"), story_url(site, F.col("story_id")).alias("web_url"),
    )
    out = reduce(lambda a, b: a.join(b, "story_id", "left"), [original, sources, told, near, cited], head)
    counts = ["n_sources", "n_updates", "n_related"]
    out = out.withColumns({c: F.coalesce(c, F.lit(0)) for c in counts}).withColumns(
        {c: F.coalesce(c, F.array().cast(out.schema[c].dataType)) for c in ("sources", "updates", "related", "analysis_sources")}
    )
    dated = F.coalesce(F.col("original.published_at"), F.when(F.col("original").isNull(), F.coalesce("first_published_at", "updated_at")))
    return out.withColumn("published_at", dated).drop("first_published_at")


def digest_items(digests: DataFrame, stories: DataFrame, counts: DataFrame, site: str) -> DataFrame:
    """One row per digest: digest_id, title, overview, week_start, week_end, web_url and its stories that are still published.

    ``stories`` needs analysis and analysis_state too; ``counts`` are (story_id, source_count). A digest has a dozen stories.
    """
    shown = cut_lineage(E.digest_members(digests, stories).select("digest_id", "position", "story_id"))  # a story can be in several digests
    told = E.analysis_of(stories.join(shown.select("story_id").distinct(), "story_id", "left_semi"))
    members = shown.join(told, "story_id").join(counts, "story_id", "left")
    sections = F.col("sections")
    story = F.struct(
        "position", F.col("story_id").alias("id"), forum_title(F.col("title")).alias("title"),
        F.coalesce(F.nullif(sections["summary"], F.lit("")), F.col("summary")).alias("summary"), sections["key_facts"].alias("key_facts"),
        sections["uncertainty"].alias("uncertainty"), "state", F.coalesce("source_count", F.lit(0)).alias("source_count"), "tags",
        story_url(site, F.col("story_id")).alias("web_url"),
    )
    lists = members.select("digest_id", story.alias("s")).groupBy("digest_id").agg(F.array_sort(F.collect_list("s")).alias("stories"))
    return digests.join(lists, "digest_id").select(
        "digest_id", "title", "overview", "week_start", "week_end", F.lit(site.rstrip("/") + "/news/").alias("web_url"), "stories"
    )


def feed_document(page: DataFrame, items: DataFrame, live: DataFrame, balance: DataFrame, digest: DataFrame, now: Column) -> DataFrame:
    """The feed as one row: version, generated_at, total, has_more, next_cursor, tag_counts, source_balance, weekly_summary, stories.

    ``page`` (of at most 50 stories) with has_more and next_cursor, ``items`` theirs, ``live`` all stories of the selection,
    ``balance`` as of ``feed.source_balance``, ``digest`` at most one digest item. Tags and outlets are a catalogue's.
    """
    total = live.agg(F.count("*").alias("total"))
    tags = S.tag_counts(live).agg(F.array_sort(F.collect_list(F.struct("tag", "stories"))).alias("tag_counts"))
    rows = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("appearances")).alias("n"), "outlet", "bias"))), lambda x: F.struct(
        x["outlet"].alias("outlet"), x["bias"].alias("bias"), (-x["n"]).alias("appearances")))
    outlets = balance.agg(rows.alias("outlets"))
    rolled = S.balance_rollup(balance)
    rolled = rolled.crossJoin(outlets).select(F.struct(*rolled.columns, "outlets").alias("source_balance"))
    shown = page.select("story_id", "position", "has_more", "next_cursor").join(items, "story_id")
    whole = F.struct("position", F.struct(*[c for c in items.columns if not c.startswith("n_")]).alias("item"))
    stories = shown.agg(
        F.coalesce(F.bool_or("has_more"), F.lit(False)).alias("has_more"), F.max("next_cursor").alias("next_cursor"),
        F.transform(F.array_sort(F.collect_list(whole)), lambda x: x["item"]).alias("stories"),
    )
    weekly = digest.agg(F.first(F.struct(*digest.columns)).alias("weekly_summary"))
    return total.crossJoin(tags).crossJoin(rolled).crossJoin(weekly).crossJoin(stories).select(
        F.lit(VERSION).alias("version"), now.alias("generated_at"), "total", "has_more", "next_cursor", "tag_counts", "source_balance", "weekly_summary", "stories"
    )
