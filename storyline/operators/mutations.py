"""Table changes as DataFrame → DataFrame operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from storyline.functions import fixed
from storyline.functions.clock import retry_delay
from storyline.session import cut_lineage

A8_SETS = ("entities", "numbers", "event_terms")


def feature_rollup(articles, key: str = "story_id"):
    """Story features from its articles: sorted unions, 24 keywords, first and last date.

    Two steps: distinct (story, kind, token) with map-side combine, then one small set per
    story.  The work per story is bounded by its vocabulary, not by its number of articles.
    """
    kinds = (*A8_SETS, "keywords")

    def tagged(kind):
        return F.transform(kind, lambda t: F.struct(F.lit(kind).alias("kind"), t.alias("t")))

    tokens = articles.select(
        key, F.explode(F.concat(*[tagged(c) for c in kinds])).alias("x")
    ).select(key, "x.kind", "x.t").distinct()
    sets = tokens.groupBy(key).agg(
        *[F.array_sort(F.collect_list(F.when(F.col("kind") == c, F.col("t")))).alias(c) for c in kinds]
    )
    dates = articles.groupBy(key).agg(
        F.min("published_at").alias("first_published_at"), F.max("published_at").alias("last_published_at"),
        F.count(F.lit(1)).alias("articles"),
    )
    empty = F.array().cast("array<string>")
    return dates.join(sets, key, "left").select(
        key, "articles", "first_published_at", "last_published_at",
        *[F.coalesce(c, empty).alias(c) for c in A8_SETS],
        F.slice(F.coalesce("keywords", empty), 1, fixed.KEYWORDS_PER_STORY).alias("keywords"),
    )


def upsert(base: DataFrame, changes: DataFrame, keys: list[str], update: list[str]) -> DataFrame:
    """Insert new keys, overwrite the ``update`` columns of known ones; one full outer join."""
    new = changes.select(*keys, *[F.col(c).alias(f"_n_{c}") for c in base.columns if c not in keys])
    both = base.withColumn("_old", F.lit(True)).join(new.withColumn("_new", F.lit(True)), keys, "full_outer")

    def value(c):
        if c in keys:
            return F.col(c)
        if c in update:
            return F.when(F.col("_new"), F.col(f"_n_{c}")).otherwise(F.col(c)).alias(c)
        return F.when(F.col("_old"), F.col(c)).otherwise(F.col(f"_n_{c}")).alias(c)

    return both.select(*[value(c) for c in base.columns])


def _without_state_tags(tags: Column) -> Column:
    return F.filter(tags, lambda t: ~F.lower(t).isin("breaking", "developing"))


def union_tags(first: Column, second: Column) -> Column:
    return F.slice(F.array_distinct(F.concat(first, second)), 1, fixed.TAGS_PER_STORY)


def attach_tags(new: Column, prior: Column) -> Column:
    """Tags after an attach: the article's, then the story's own without state tags."""
    return union_tags(new, _without_state_tags(prior))


def next_state(is_new: Column, tags: Column, old_state: Column, significant: Column) -> Column:
    """State after an article: breaking sticks, significant news develops, the rest updates."""
    breaking = F.exists(tags, lambda t: F.lower(t) == "breaking")
    return (
        F.when(is_new, F.when(breaking, "breaking").otherwise("new"))
        .when(old_state == "breaking", "breaking")
        .when(significant, "developing")
        .otherwise("updated")
    )


def merge_refusal(pairs: DataFrame, stories: DataFrame) -> DataFrame:
    """Pairs (source_id, target_id) with the reason why a merge is refused, or null."""
    s = stories.select(
        F.col("story_id").alias("source_id"), F.col("state").alias("ss"),
        F.struct("guild_id", "forum").alias("sf"),
    )
    t = stories.select(
        F.col("story_id").alias("target_id"), F.col("state").alias("ts"),
        F.struct("guild_id", "forum").alias("tf"),
    )
    j = pairs.join(s, "source_id", "left").join(t, "target_id", "left")
    return j.select(
        "source_id",
        "target_id",
        F.when(F.col("source_id") == F.col("target_id"), "a story cannot be merged into itself")
        .when(F.col("ss").isNull() | F.col("ts").isNull(), "story not found")
        .when((F.col("ss") == "merged") | (F.col("ts") == "merged"), "merged stories cannot be merged again")
        .when(F.col("sf") != F.col("tf"), "stories must belong to the same forum")
        .alias("refusal"),
    )


def repoint(df: DataFrame, pairs: DataFrame, column: str = "story_id") -> DataFrame:
    """Move rows of source stories to their targets."""
    m = pairs.select(F.col("source_id").alias(column), "target_id")
    return df.join(m, column, "left").withColumn(
        column, F.coalesce("target_id", column)
    ).drop("target_id")


def merge_edges(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """Relationships after merges: end points moved, self loops and doubles gone."""
    moved = repoint(repoint(edges, pairs, "low"), pairs, "high")
    return (
        moved.filter("low <> high")
        .select(F.least("low", "high").alias("low"), F.greatest("low", "high").alias("high"))
        .distinct()
    )


def merge_stories(stories: DataFrame, articles: DataFrame, pairs: DataFrame, now: Column) -> DataFrame:
    """Stories after merging each source into its target (pairs must have no refusal).

    Targets get united features, target-first tags and the head of the story with the higher
    priority; sources become merged and point at their target.
    """
    moved = repoint(articles, pairs)
    targets = pairs.select(F.col("target_id").alias("story_id"))
    features = feature_rollup(moved.join(targets, "story_id", "left_semi"))
    head = ["title", "summary", "primary_priority", "primary_article_id"]
    src = stories.join(pairs.withColumnRenamed("source_id", "story_id"), "story_id").select(
        F.col("target_id").alias("story_id"), F.col("tags").alias("s_tags"),
        *[F.col(c).alias(f"s_{c}") for c in head],
    )
    keep = [c for c in stories.columns if c not in (*head, "tags", "state", "first_published_at",
                                                    "last_published_at", "last_updated_at")]
    take = F.col("s_primary_priority") > F.col("primary_priority")
    merged = stories.join(src, "story_id").join(features, "story_id").select(
        *keep,
        *[F.when(take, F.col(f"s_{c}")).otherwise(stories[c]).alias(c) for c in head],
        union_tags(F.col("tags"), F.col("s_tags")).alias("tags"),
        F.lit("updated").alias("state"),
        features["first_published_at"], features["last_published_at"],
        now.alias("last_updated_at"),
        *[features[c] for c in (*A8_SETS, "keywords")],
        F.lit(None).cast("bigint").alias("merged_into"),
    )
    gone = stories.join(
        pairs.select(F.col("source_id").alias("story_id"), F.col("target_id").alias("merged_into")), "story_id"
    ).withColumn("state", F.lit("merged"))
    return merged.unionByName(gone, allowMissingColumns=True)


def split_articles(stories: DataFrame, articles: DataFrame, requests: DataFrame, now: Column) -> DataFrame:
    """Both halves of every split: request rows are (article_id, new_story_id), one per story.

    Requests for the only article of a story are refused, i.e. produce nothing.
    """
    asked = articles.join(requests, "article_id")
    size = articles.groupBy("story_id").agg(F.count(F.lit(1)).alias("n"))
    asked = asked.join(size.filter("n > 1"), "story_id").drop("n")
    st = stories.select(
        "story_id", "guild_id", "forum", "tags", "primary_priority", "primary_article_id"
    )
    own = F.col("article_id") == F.col("primary_article_id")
    fresh = asked.join(st.drop("guild_id", "forum"), "story_id").select(
        F.col("new_story_id").alias("story_id"), "guild_id", "forum", "title", "summary",
        F.lit("new").alias("state"), "tags",
        F.when(own, F.col("primary_priority")).otherwise(0).alias("primary_priority"),
        F.col("article_id").alias("primary_article_id"),
        F.col("published_at").alias("first_published_at"), F.col("published_at").alias("last_published_at"),
        *A8_SETS, "keywords", F.lit(1).cast("bigint").alias("articles"), now.alias("last_updated_at"),
    )
    left = articles.join(asked.select("story_id"), "story_id", "left_semi").join(
        requests.select("article_id"), "article_id", "left_anti"
    )
    features = feature_rollup(left)
    ranked = left.join(st.select("story_id", "primary_article_id"), "story_id")
    first = ranked.groupBy("story_id").agg(
        F.min_by(
            F.struct("article_id", "title", "summary"),
            F.struct(
                F.col("article_id") != F.col("primary_article_id"), F.col("published_at"), F.col("article_id")
            ),
        ).alias("p")
    )
    rest = features.join(first, "story_id").join(st, "story_id").select(
        "story_id", "guild_id", "forum", "p.title", "p.summary", F.lit("updated").alias("state"), "tags",
        F.when(F.col("p.article_id") == F.col("primary_article_id"), F.col("primary_priority"))
        .otherwise(0).alias("primary_priority"),
        F.col("p.article_id").alias("primary_article_id"),
        "first_published_at", "last_published_at", *A8_SETS, "keywords", "articles",
        now.alias("last_updated_at"),
    )
    return fresh.unionByName(rest)


def mark_stale(stories: DataFrame, before: Column) -> DataFrame:
    old = F.col("state").isin(list(fixed.ACTIVE_STORY_STATES)) & (F.col("last_updated_at") < before)
    return stories.withColumn("state", F.when(old, "stale").otherwise(F.col("state")))


def mark_cleared(stories: DataFrame, cleared: DataFrame, action: str, now: Column):
    """Stories with clear marks, and the history records of the clean-up."""
    if action not in ("archive", "delete"):
        raise ValueError("cleanup action must be archive or delete")
    flag = cleared.select("story_id").withColumn("_c", F.lit(True))
    known = F.col("clear_action") if "clear_action" in stories.columns else F.lit(None).cast("string")
    marked = stories.join(flag, "story_id", "left").select(
        *[c for c in stories.columns if c not in ("cleared_at", "clear_action")],
        F.when(F.col("_c"), now).otherwise(F.col("cleared_at")).alias("cleared_at"),
        F.when(F.col("_c"), F.lit(action)).otherwise(known).alias("clear_action"),
    )
    log = cleared.select("story_id", F.lit(f"cleanup_{action}").alias("action"), now.alias("created_at"))
    return marked, log


def retention_batches(due: DataFrame, size: int) -> DataFrame:
    """``due`` with the number (from 0) of the clean-up tick of ``size`` that takes each story, oldest first.

    A global rank without a global sort in one task: rows are split by ranges of age, ranked inside a range, and set off by
    the counts of the ranges before it.
    """
    order = ["last_updated_at", "story_id"]
    ranged = cut_lineage(due.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    counts = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    offsets = counts.select("_range", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    placed = ranged.withColumn("_place", inside).join(offsets, "_range")
    batch = F.floor((F.col("_place") + F.col("_before") - 1) / size).cast("long")
    return placed.withColumn("batch", batch).drop("_range", "_place", "_before")


def replace_relationships(edges: DataFrame, analysed: DataFrame, stories: DataFrame) -> DataFrame:
    """Edges after analyses: rows (story_id, related_ids) replace all edges of their stories.

    An analysis with an ineligible relation (itself, other guild, merged, no thread, unknown)
    is refused as a whole.
    """
    wanted = analysed.select("story_id", F.explode(F.array_distinct("related_ids")).alias("related_id"))
    own = stories.select("story_id", F.col("guild_id").alias("g"))
    other = stories.select(
        F.col("story_id").alias("related_id"), F.col("guild_id").alias("rg"),
        F.col("state").alias("rs"), F.col("thread_id").alias("rt"),
    )
    checked = wanted.join(own, "story_id").join(other, "related_id", "left").withColumn(
        "ok",
        (F.col("story_id") != F.col("related_id")) & F.col("rg").isNotNull() & (F.col("g") == F.col("rg"))
        & (F.col("rs") != "merged") & F.col("rt").isNotNull(),
    )
    refused = checked.filter(~F.coalesce("ok", F.lit(False))).select("story_id").distinct()
    valid = analysed.select("story_id").join(refused, "story_id", "left_anti")
    old = edges.join(valid.select(F.col("story_id").alias("low")), "low", "left_anti").join(
        valid.select(F.col("story_id").alias("high")), "high", "left_anti"
    )
    new = checked.join(valid, "story_id", "left_semi").select(
        F.least("story_id", "related_id").alias("low"), F.greatest("story_id", "related_id").alias("high")
    )
    return old.select("low", "high").unionAll(new).distinct()


def apply_outcomes(rows: DataFrame, outcomes: DataFrame, key: str, column: str) -> DataFrame:
    """Set ``column`` from an outcome table (key, outcome, error); others keep theirs."""
    o = outcomes.select(key, F.col("outcome").alias("_o"), F.substring("error", 1, 1000).alias("_e"))
    return rows.join(o, key, "left").select(
        *[c for c in rows.columns if c != column],
        F.coalesce("_o", column).alias(column),
        F.col("_e").alias("error"),
    )


def feed_progress(feeds: DataFrame, polls: DataFrame) -> DataFrame:
    """Feeds after polls (feed_id, polled_at, error, cursor, uncertain): one row per poll.

    Success resets failures and moves on by the interval; an error backs off exponentially.
    """
    failed = F.col("p_error").isNotNull()
    delay = retry_delay(F.col("interval_seconds"), F.col("failure_count"))
    p = polls.select(
        "feed_id", "polled_at", F.col("error").alias("p_error"), F.col("cursor").alias("p_cursor"), "uncertain"
    )
    at = F.unix_micros("polled_at")
    note = F.concat(F.col("uncertain").cast("string"), F.lit(" outcome(s) uncertain"))
    return feeds.join(p, "feed_id").select(
        "feed_id",
        F.when(failed, F.col("failure_count") + 1).otherwise(0).alias("failure_count"),
        F.timestamp_micros(at + F.when(failed, delay).otherwise(F.col("interval_seconds")) * 1000000).alias("next_poll_at"),
        F.when(failed, F.substring("p_error", 1, 1000)).otherwise(F.when(F.col("uncertain") > 0, note)).alias("last_error"),
        F.when(failed, F.col("last_polled_at")).otherwise(F.col("polled_at")).alias("last_polled_at"),
        F.when(failed, F.col("cursor")).otherwise(F.coalesce("p_cursor", "cursor")).alias("cursor"),
    )


def delivery_decision(
    creating: Column, model_error: Column, quality_error: Column, newsworthy: Column,
    significant: Column, summaries: Column, source_updates: bool = False, major_updates: bool = True,
    quality_gate: bool = True,
) -> Column:
    """Struct (outcome, reason, post_update) for one processed article."""
    gate = F.lit(quality_gate)
    news_error = F.when(
        ~newsworthy, F.lit("story did not meet the configured newsworthiness threshold")
    )
    reason = (
        F.when(~creating & model_error.isNotNull(), model_error)
        .when(creating & summaries & quality_error.isNotNull(), quality_error)
        .when(creating & gate, F.coalesce(model_error, news_error))
    )
    post = ~creating & (F.lit(source_updates) | (significant & F.lit(major_updates)))
    return F.struct(
        F.when(reason.isNotNull(), "skipped").when(creating, "new_stories").otherwise("updated_stories").alias("outcome"),
        reason.alias("reason"),
        (reason.isNull() & post).alias("post_update"),
    )


def analysis_update(wanted: Column, ok: Column, state: Column, published: Column) -> Column:
    """Analysis state after a response: ready, failed (a published ready one stays), or cleared."""
    return (
        F.when(~wanted, "disabled")
        .when(ok.isNull(), state)
        .when(ok, "ready")
        .when(published & (state == "ready"), "ready")
        .otherwise("failed")
    )
