"""Weekly digest, story details and their presentation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from storyline.functions import analysis as A
from storyline.functions import clock as C
from storyline.functions.text import excerpt_of_plain, tidy
from storyline.operators import feed as S
from storyline.operators.redundancy import with_kept_lines


def digest_due(summaries: DataFrame, now: Column, scheduled: Column) -> DataFrame:
    """Whether each destination's digest is due.

    Needs latest_id (any earlier digest), existing_state and existing_generated_at of this
    week's digest, and force.  An uncertain one is never retried.
    """
    existing = F.col("existing_state").isNotNull()
    bootstrap = F.col("latest_id").isNull() & ~existing
    retry = existing & (F.col("existing_state") == "failed")
    due = (now >= scheduled) & (~existing | (F.col("existing_generated_at") < scheduled) | retry)
    uncertain = F.coalesce(F.col("existing_state") == "uncertain", F.lit(False))
    return summaries.withColumn("due", ~uncertain & (F.col("force") | bootstrap | F.coalesce(due, F.lit(False))))


def weekly_counts(articles: DataFrame, zone: str, weekday: int) -> DataFrame:
    """Coverage per forum and local calendar week (zone and first day are the caller's)."""
    week = C.week_start(F.col("published_at"), zone, weekday)
    return articles.groupBy("guild_id", "forum", week.alias("week_start")).agg(
        F.count(F.lit(1)).alias("articles"), F.countDistinct("story_id").alias("stories"),
        F.max("published_at").alias("week_end"),
    )


def digest_members(digests: DataFrame, stories: DataFrame) -> DataFrame:
    """Digest stories that are still published, in digest order: (digest_id, position, story…)."""
    ids = digests.select("digest_id", F.posexplode("story_ids").alias("position", "story_id"))
    return ids.join(stories.filter(S.is_published()), "story_id")


def latest_digests(digests: DataFrame, stories: DataFrame) -> DataFrame:
    """Latest posted digest per (guild, forum) that still has a published story."""
    alive = digest_members(digests, stories).select("digest_id").distinct()
    posted = digests.filter("delivery_state = 'posted'").join(alive, "digest_id", "left_semi")
    key = F.struct("week_start", "digest_id")
    return posted.groupBy("guild_id", "forum").agg(F.max(key).alias("k")).select(
        "guild_id", "forum", F.col("k.digest_id").alias("digest_id"), F.col("k.week_start").alias("week_start")
    )


def source_list(unique: DataFrame, shown: int = 11) -> DataFrame:
    """First ``shown`` sources of each story in order, and how many more there are."""
    rank = F.row_number().over(W.partitionBy("story_id").orderBy("published_at", "article_id"))
    top = (
        unique.select("story_id", "label", rank.alias("r")).filter(F.col("r") <= shown)
        .groupBy("story_id").agg(F.array_sort(F.collect_list(F.struct("r", "label"))).alias("t"))
    )
    n = unique.groupBy("story_id").agg(F.count(F.lit(1)).alias("sources"))
    return n.join(top, "story_id").select(
        "story_id", "sources", F.transform("t", lambda x: x["label"]).alias("shown"),
        F.greatest(F.lit(0), F.col("sources") - shown).alias("more"),
    )


def timelines(primaries: DataFrame, visible: DataFrame, last: int = 2, chars: int = 1024) -> DataFrame:
    """Original report, count of earlier updates, then the last ``last`` updates.

    While the text is too long, the second entry goes.  Needs primaries (story_id, entry) and
    visible updates (story_id, recorded_us, history_id, entry); only the last few per story
    travel, thanks to the rank filter below the shuffle.
    """
    rank = F.row_number().over(
        W.partitionBy("story_id").orderBy(F.desc("recorded_us"), F.desc("history_id"))
    )
    tail = (
        visible.select("story_id", "entry", rank.alias("r")).filter(F.col("r") <= last)
        .groupBy("story_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("r")).alias("r"), "entry"))).alias("t"))
    )
    counts = visible.groupBy("story_id").agg(F.count(F.lit(1)).alias("n"))
    j = primaries.join(tail.join(counts, "story_id"), "story_id", "left")
    earlier = F.when(
        F.col("n") > last,
        F.array(F.concat((F.col("n") - last).cast("string"), F.lit(" earlier updates are on the story page"))),
    ).otherwise(F.array().cast("array<string>"))
    entries = F.concat(
        F.array("entry"), earlier,
        F.coalesce(F.transform("t", lambda x: x["entry"]), F.array().cast("array<string>")),
    )
    # Drop the second entry until the text fits: try every number of drops, keep the first fit.
    def trimmed(e):
        options = F.transform(
            F.sequence(F.lit(0), F.size(e) - 1),
            lambda k: F.array_join(F.concat(F.slice(e, 1, 1), F.slice(e, k + 2, F.size(e))), "\n\n"),
        )
        return F.coalesce(F.get(F.filter(options, lambda o: F.length(o) <= chars), F.lit(0)), F.element_at(options, -1))

    from storyline.functions.text import let

    return j.select("story_id", F.coalesce("n", F.lit(0)).alias("updates"), let(entries, trimmed).alias("timeline"))


def digest_cards(members: DataFrame, overview_chars: int, budget: int = 5900) -> DataFrame:
    """Cards of a digest: full ones, or all compact when the digest exceeds its budget.

    ``members``: digest_id, position, story_id, title_line, summary, facts, uncertainty, tags,
    state, source_count.  A digest has at most a dozen stories, so the window is that small.
    """
    def card(compact: bool) -> Column:
        facts = F.transform(
            F.slice("facts", 1, 1 if compact else 2), lambda f: excerpt_of_plain(tidy(f, 2000), 100 if compact else 150)
        )
        fact_text = F.array_join(F.transform(facts, lambda f: F.concat(F.lit("• "), f)), "\n")
        tags = F.array_join(
            F.filter("tags", lambda t: F.lower(t) != F.lower(F.col("state"))), ", "
        )
        tags = tidy(F.coalesce(F.nullif(tags, F.lit("")), F.lit("General")), 40 if compact else 80)
        count = F.concat(
            F.col("source_count").cast("string"), F.when(F.col("source_count") == 1, " source").otherwise(" sources")
        )
        parts = [
            F.concat(F.col("position").cast("string"), F.lit(". "), "title_line"),
            F.concat(F.lit("**Summary**\n"), excerpt_of_plain(tidy(F.col("summary"), 2000), 220 if compact else 300)),
            F.when(F.size(facts) > 0, F.concat(F.lit("Key facts\n"), fact_text)),
            F.lit(None) if compact else F.when(
                F.size("uncertainty") > 0,
                F.concat(F.lit("Unclear or disputed\n"), excerpt_of_plain(tidy(F.element_at("uncertainty", 1), 2000), 150)),
            ),
            F.concat(F.lit("At a glance\n"), F.initcap("state"), F.lit(" | "), count, F.lit(" | "), tags),
        ]
        return F.array_join(F.array_compact(F.array(*parts)), "\n")

    both = members.select("digest_id", "position", "story_id", card(False).alias("full"), card(True).alias("compact"))
    total = F.sum(F.length("full")).over(W.partitionBy("digest_id")) + overview_chars
    return both.select(
        "digest_id", "position", "story_id", (total > budget).alias("is_compact"),
        F.when(total > budget, F.col("compact")).otherwise(F.col("full")).alias("card"),
    )


def analysis_of(stories: DataFrame, key: str = "story_id") -> DataFrame:
    """Sections of the ready analysis, else of the summary; ``key`` names a row."""
    text = F.when(
        (F.col("analysis_state") == "ready") & F.col("analysis").isNotNull(), F.col("analysis")
    ).otherwise(F.col("summary"))
    read = with_kept_lines(stories.withColumn("_text", text), key, "_text", "title").drop("_text")
    return read.withColumn("sections", A.analysis_sections(F.col("kept")))
