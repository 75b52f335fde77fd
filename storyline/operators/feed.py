"""The story feed: filters, pages, counts, balances and story details."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from storyline.functions import fixed
from storyline.functions.clock import encode_cursor
from storyline.functions.outlets import canonical_source_name, source_bias_bucket
from storyline.functions.text import literal_array
from storyline.functions.urls import normalize_url


@dataclass(frozen=True)
class FeedQuery:
    """What a reader asks for; checked on construction."""

    limit: int = 15
    cursor: tuple | None = None
    search: str = ""
    tags: tuple[str, ...] = ()
    source: str = ""
    bias: str = ""

    def __post_init__(self):
        if not 1 <= self.limit <= 51:
            raise ValueError("story limit must be between 1 and 51")
        if self.bias and self.bias.strip().casefold() not in fixed.BIAS_GROUPS:
            raise ValueError("bias must be left, center, right, official, or unrated")


def is_published() -> Column:
    return (
        (F.col("publication_state") == "published")
        & (F.col("state") != "merged")
        & F.col("cleared_at").isNull()
        & F.col("thread_id").isNotNull()
    )


def search(stories: DataFrame, articles: DataFrame, text: str) -> DataFrame:
    """Literal, case-insensitive match in the title or in any publisher of the story."""
    wanted = text.strip().lower()
    if not wanted:
        return stories
    named = articles.filter(F.lower("publisher").contains(wanted)).select("story_id").distinct()
    flagged = stories.join(named.withColumn("_hit", F.lit(True)), "story_id", "left")
    return flagged.filter(F.lower("title").contains(wanted) | F.col("_hit")).drop("_hit")


def with_tags(stories: DataFrame, tags) -> DataFrame:
    wanted = list(dict.fromkeys(t.strip() for t in tags if t.strip()))
    return stories.filter(F.arrays_overlap("tags", literal_array(wanted))) if wanted else stories


def with_source(stories: DataFrame, articles: DataFrame, outlet: str) -> DataFrame:
    wanted = outlet.strip()
    if not wanted:
        return stories
    name = canonical_source_name(F.col("publisher"), F.col("url"))
    return stories.join(articles.filter(name == wanted).select("story_id"), "story_id", "left_semi")


def with_bias(stories: DataFrame, articles: DataFrame, bias: str) -> DataFrame:
    group = bias.strip().casefold()
    if not group:
        return stories
    if group not in fixed.BIAS_GROUPS:
        raise ValueError("bias must be left, center, right, official, or unrated")
    bucket = source_bias_bucket(F.col("publisher"), F.col("url"))
    hit = articles.filter(bucket.isin(list(fixed.BIAS_GROUPS[group]))).select("story_id")
    return stories.join(hit, "story_id", "left_semi")


def browse(stories: DataFrame, articles: DataFrame, query: FeedQuery) -> DataFrame:
    """All published stories that the query selects (before paging)."""
    out = with_tags(stories.filter(is_published()), query.tags)
    out = search(out, articles, query.search)
    out = with_source(out, articles, query.source)
    return with_bias(out, articles, query.bias)


def page(stories: DataFrame, limit: int, cursor: tuple | None = None) -> DataFrame:
    """Keyset page in newest-first order, with has_more and next_cursor on each row.

    One row beyond the page is fetched (51 at most), so the window here is over a bounded set.
    """
    rows = stories
    if cursor is not None:
        ts, sid = F.lit(cursor[0]).cast("timestamp"), F.lit(cursor[1])
        rows = rows.filter(
            (F.col("last_updated_at") < ts)
            | ((F.col("last_updated_at") == ts) & (F.col("story_id") < sid))
        )
    top = rows.orderBy(F.desc("last_updated_at"), F.desc("story_id")).limit(limit + 1)
    order = W.orderBy(F.desc("last_updated_at"), F.desc("story_id"))
    ranked = top.select(
        "*", F.row_number().over(order).alias("position"), F.count(F.lit(1)).over(W.partitionBy()).alias("_n")
    )
    more = F.col("_n") > limit
    last = F.col("position") == limit
    return ranked.filter(F.col("position") <= limit).select(
        *rows.columns,
        "position",
        more.alias("has_more"),
        F.when(more & last, encode_cursor(F.col("last_updated_at"), F.col("story_id"))).alias(
            "next_cursor"
        ),
    )


def tag_counts(stories: DataFrame) -> DataFrame:
    return (
        stories.select(F.explode("tags").alias("tag"))
        .select(F.trim("tag").alias("tag"))
        .filter("tag <> ''")
        .groupBy("tag")
        .agg(F.count(F.lit(1)).alias("stories"))
    )


def source_balance(stories: DataFrame, articles: DataFrame) -> DataFrame:
    """Outlet appearances: each outlet counts once per story."""
    pub, url = F.col("publisher"), F.col("url")
    named = articles.select(
        "story_id",
        canonical_source_name(pub, url).alias("outlet"),
        source_bias_bucket(pub, url).alias("bias"),
    )
    seen = named.join(stories.select("story_id"), "story_id", "left_semi").distinct()
    return seen.groupBy("outlet", "bias").agg(F.count(F.lit(1)).alias("appearances"))


def balance_rollup(outlets: DataFrame) -> DataFrame:
    """One row: appearances per leaning group, rated and total."""
    n = F.col("appearances")

    def total(*names):
        return F.coalesce(F.sum(F.when(F.col("bias").isin(*names), n)), F.lit(0))

    known = [b for g in fixed.BIAS_GROUPS.values() for b in g if b != "unrated"]
    sums = outlets.agg(
        total("left", "center-left").alias("left"),
        total("center").alias("center"),
        total("center-right", "right").alias("right"),
        total("official").alias("official"),
        F.coalesce(F.sum(F.when(~F.col("bias").isin(known), n)), F.lit(0)).alias("unrated"),
    )
    rated = F.col("left") + F.col("center") + F.col("right")
    return sums.select(
        "*",
        rated.alias("rated_appearances"),
        (rated + F.col("official") + F.col("unrated")).alias("total_appearances"),
    )


def zero_filled_counts(df: DataFrame, column: str, values, by: str | None = None) -> DataFrame:
    """Counts per enumeration value, zeros included, optionally per ``by``."""
    spark = df.sparkSession
    enum = spark.range(1).select(F.explode(literal_array(values)).alias(column))
    keys = [by, column] if by else [column]
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    frame = df.select(by).distinct().crossJoin(F.broadcast(enum)) if by else enum
    return frame.join(counts, keys, "left").select(*keys, F.coalesce("n", F.lit(0)).alias("n"))


def unique_articles(articles: DataFrame) -> DataFrame:
    """First article per story and normalised URL; articles without URL all stay.

    ``min_by`` combines before the shuffle: a story of many transport copies is no hot spot.
    """
    keyed = articles.withColumn(
        "_key", normalize_url(F.coalesce(F.nullif(F.col("canonical_url"), F.lit("")), F.col("url")))
    )
    rest = [c for c in articles.columns if c != "story_id"]
    first = (
        keyed.filter("_key <> ''")
        .groupBy("story_id", "_key")
        .agg(F.min_by(F.struct(*rest), F.struct("published_at", "article_id")).alias("a"))
        .select("story_id", *[F.col("a")[c].alias(c) for c in rest])
    )
    bare = keyed.filter("_key = ''").select("story_id", *rest)
    return first.unionByName(bare).select(*articles.columns)


def primary_articles(articles: DataFrame) -> DataFrame:
    """Highest priority, earliest on ties, per story."""
    best = articles.groupBy("story_id").agg(
        F.max_by(
            F.struct("article_id", "priority"),
            F.struct(
                F.col("priority"), -F.unix_micros("published_at"), -F.col("article_id")
            ),
        ).alias("p")
    )
    return best.select("story_id", "p.article_id", "p.priority")


def newest_articles(articles: DataFrame) -> DataFrame:
    """Last article of each story in (published, id) order, undated ones first."""
    at = F.coalesce(F.unix_micros("published_at"), F.lit(-(2**62)))
    last = articles.groupBy("story_id").agg(
        F.max(F.struct(at.alias("at"), F.col("article_id"))).alias("l"),
        F.count(F.lit(1)).alias("articles"),
    )
    return last.select("story_id", F.col("l.article_id").alias("article_id"), "articles")


def neighbours(edges: DataFrame, stories: DataFrame) -> DataFrame:
    """Both directions of undirected edges, merged neighbours left out."""
    both = edges.select(F.col("low").alias("story_id"), F.col("high").alias("related_id")).unionAll(
        edges.select(F.col("high"), F.col("low"))
    )
    other = stories.filter("state <> 'merged'").select(
        F.col("story_id").alias("related_id"), "last_updated_at"
    )
    return both.join(other, "related_id").select("story_id", "related_id", "last_updated_at")


def story_updates(history: DataFrame, articles: DataFrame) -> DataFrame:
    """Update records whose article still belongs to the story of the record."""
    h = history.filter(F.col("action").isin(list(fixed.UPDATE_ACTIONS)))
    # An update that is empty text counts as no update.
    detail = F.nullif(F.get_json_object("detail", "$.update"), F.lit(""))
    return h.join(articles.drop("feed_name"), ["story_id", "article_id"]).select(
        "story_id", "history_id", "article_id", F.col("action").alias("kind"),
        F.col("created_at").alias("recorded_at"), detail.alias("update_detail"),
        "title", "summary", "publisher", "url", "published_at",
    )


def relationship_candidates(stories: DataFrame, since: Column, limit: int) -> DataFrame:
    """Newest ``limit`` other stories of the guild for every story.

    The newest ``limit + 1`` of a guild serve all its stories (each drops itself), so no pair
    beyond the result is ever formed.
    """
    rank = F.row_number().over(
        W.partitionBy("guild_id").orderBy(F.desc("last_updated_at"), F.desc("story_id"))
    )
    top = (
        stories.filter(
            (F.col("state") != "merged")
            & F.col("thread_id").isNotNull()
            & (F.col("last_updated_at") >= since)
        )
        .select("guild_id", F.col("story_id").alias("related_id"), rank.alias("r"))
        .filter(F.col("r") <= limit + 1)
    )
    newest = top.groupBy("guild_id").agg(
        F.array_sort(F.collect_list(F.struct("r", "related_id"))).alias("top")
    )
    own = stories.select("story_id", "guild_id").join(newest, "guild_id")
    return own.select(
        "story_id",
        F.explode(
            F.slice(F.filter("top", lambda t: t["related_id"] != F.col("story_id")), 1, limit)
        ).alias("t"),
    ).select("story_id", F.col("t.related_id").alias("related_id"))


def message_context(messages: DataFrame, age_seconds: int = 600, keep: int = 4, chars: int = 4000):
    """Up to ``keep`` directly preceding messages of the same author in a channel, oldest first.

    Needs channel, author, message_id, created_at, text.  Context never reaches back more than
    ``age_seconds``, so a channel is cut into time slices of that length: each message is a
    target in its slice and context in the next.  A busy channel is many small partitions.
    """
    slice_no = F.floor(F.unix_seconds("created_at") / age_seconds)
    m = messages.withColumn("_s", slice_no)
    both = m.withColumn("_t", F.lit(True)).unionByName(
        m.withColumn("_s", F.col("_s") + 1).withColumn("_t", F.lit(False))
    )
    w = W.partitionBy("channel", "_s").orderBy("message_id")
    prior = F.struct("author", "created_at", "text", "message_id")
    lagged = both.select(
        "*", *[F.lag(prior, k).over(w).alias(f"_p{k}") for k in range(1, keep + 1)]
    ).filter("_t")
    ok, size, taken = F.lit(True), F.lit(0), []
    for k in range(1, keep + 1):
        p = F.col(f"_p{k}")
        age = (F.unix_micros("created_at") - F.unix_micros(p["created_at"])) / 1e6
        size = size + F.coalesce(F.length(p["text"]), F.lit(0))
        ok = (
            ok
            & (p["author"] == F.col("author"))
            & age.between(0, age_seconds)
            & (p["text"] != "")
            & (size <= chars)
        )
        taken.append(F.when(ok, p["text"]))
    return lagged.select(
        "message_id", "channel", "author", F.array_compact(F.array(*reversed(taken))).alias("context")
    )
