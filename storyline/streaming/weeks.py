"""Digests of calendar weeks, kept in place while articles keep coming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from storyline.functions.clock import week_start
from storyline.session import cut_lineage
from storyline.streaming.snapshot import Snapshots

WEEK = ["guild_id", "forum", "week_us"]


class WeekDigests:
    """One digest per (guild, forum, week of a zone): its articles, its stories, its end and its ``shown`` largest stories.

    ``process`` is what a stream calls with each micro-batch of articles (guild_id, forum, story_id, published_at). It adds
    to the counts of stories, then renews the digests of the weeks that the batch falls into, late ones included. Either
    table swaps versions whole; a repeated batch changes nothing, also where it was cut short between the two.
    """

    def __init__(self, spark: SparkSession, folder: str, zone: str, weekday: int, shown: int = 8, parts: int = 16):
        self.zone, self.weekday, self.shown = zone, weekday, shown
        self.coverage = Snapshots(spark, f"{folder}/coverage", [*WEEK, "story_id"], by=WEEK, parts=parts)
        self.digests = Snapshots(spark, f"{folder}/digests", WEEK, parts=parts)

    def process(self, articles: DataFrame, batch_id: int) -> None:
        dated = articles.filter("published_at is not null").select(
            "guild_id", "forum", F.unix_micros(week_start(F.col("published_at"), self.zone, self.weekday)).alias("week_us"), "story_id", "published_at"
        )
        new = cut_lineage(dated.groupBy(*WEEK, "story_id").agg(F.count("*").alias("articles"), F.max("published_at").alias("last_at")))
        if new.isEmpty():
            return
        self.coverage.refresh(new, batch_id, self._added)
        weeks = new.select(*WEEK).distinct()
        told = self.coverage.near(weeks).join(F.broadcast(weeks), WEEK, "left_semi")
        self.digests.refresh(self._digest(told), batch_id)

    @staticmethod
    def _added(old: DataFrame, new: DataFrame) -> DataFrame:
        both = new.unionByName(old.join(new.select(*WEEK, "story_id"), [*WEEK, "story_id"], "left_semi"))
        return both.groupBy(*WEEK, "story_id").agg(F.sum("articles").alias("articles"), F.max("last_at").alias("last_at"))

    def _digest(self, stories: DataFrame) -> DataFrame:
        largest = F.row_number().over(W.partitionBy(*WEEK).orderBy(F.desc("articles"), F.desc("last_at"), F.desc("story_id")))
        top = stories.withColumn("r", largest).filter(F.col("r") <= self.shown).groupBy(*WEEK).agg(
            F.transform(F.array_sort(F.collect_list(F.struct("r", "story_id"))), lambda x: x["story_id"]).alias("story_ids")
        )
        sums = stories.groupBy(*WEEK).agg(F.sum("articles").alias("articles"), F.count("*").alias("stories"), F.unix_micros(F.max("last_at")).alias("end_us"))
        return sums.join(top, WEEK)

    def read(self, version: int | None = None) -> DataFrame:
        return self.digests.read(version)
