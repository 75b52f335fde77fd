"""Social posts (JSON) → items, and the incremental cursor."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyline.functions.clock import parse_iso
from storyline.functions.text import squash

POST = "id string, text string, created_at string, is_reply boolean, is_repost boolean"


def parse_posts(posts: DataFrame, replies: bool = True, reposts: bool = True) -> DataFrame:
    """Items of posts (feed, username, display_name, json); a bad date becomes null."""
    p = posts.select("feed", "username", "display_name", F.from_json("json", POST).alias("p"))
    rows = p.select("feed", "username", "display_name", "p.*").filter("id IS NOT NULL AND id <> ''")
    if not replies:
        rows = rows.filter(~F.coalesce("is_reply", F.lit(False)))
    if not reposts:
        rows = rows.filter(~F.coalesce("is_repost", F.lit(False)))
    preview = F.substring(squash(F.coalesce("text", F.lit(""))), 1, 80)
    preview = F.coalesce(F.nullif(preview, F.lit("")), F.lit("New post"))
    return rows.select(
        "feed",
        F.col("id").alias("external_id"),
        F.concat(F.lit("@"), "username", F.lit(": "), preview).alias("title"),
        F.concat(F.lit("https://x.com/"), "username", F.lit("/status/"), "id").alias("url"),
        F.coalesce("text", F.lit("")).alias("summary"),
        F.col("display_name").alias("author"),
        parse_iso(F.col("created_at")).alias("published_at"),
    )


def cursors(items: DataFrame) -> DataFrame:
    """Highest numeric id per feed: the next poll asks for anything newer."""
    return items.groupBy("feed").agg(F.max(F.col("external_id").try_cast("bigint")).alias("cursor"))


def since(items: DataFrame, known: DataFrame) -> DataFrame:
    """Items beyond the cursor of their feed (all items where none is known)."""
    j = items.join(known.withColumnRenamed("cursor", "_c"), "feed", "left")
    return j.filter(F.col("_c").isNull() | (F.col("external_id").try_cast("bigint") > F.col("_c"))).drop("_c")
