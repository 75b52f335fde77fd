"""Ranks of rows within groups of any size, without a window over a group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from storyline.session import cut_lineage

#: Rows of the table of ranges up to which it is broadcast (about 60 bytes each); a larger one is joined by a shuffle.
BROADCAST_RANGES = 200_000
_PLACES = (1 << 33) - 1


def ranked(rows: DataFrame, group: str, order: list[str], rank: str = "rank", size: str = "group_size") -> DataFrame:
    """``rows`` with their rank (from 0) in their group by ``order``, nulls first, and the group's size.

    Rows are dealt over ranges of (group, order, place in the input), so a group of any size is spread over tasks; each
    range then counts its rows of each group, and these counts, one row per range and group, give the offsets. Rows
    equal in group and order get ranks in any order. ``group`` must not be null.
    """
    spread = rows.withColumn("_row", F.monotonically_increasing_id())
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = spread.repartitionByRange(parts, group, *order, "_row").sortWithinPartitions(group, *order, "_row")
    spread = cut_lineage(spread.drop("_row").withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    ranges = spread.groupBy(F.col(group), part.alias("_part")).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    whole = W.partitionBy(group)
    before = whole.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    ranges = cut_lineage(ranges.select(
        group, "_part", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(whole).alias(size)
    ))
    if ranges.count() <= BROADCAST_RANGES:
        ranges = F.broadcast(ranges)
    place = F.col("_at").bitwiseAND(F.lit(_PLACES)) - F.col("_first").bitwiseAND(F.lit(_PLACES)) + F.col("_before")
    return spread.withColumn("_part", part).join(ranges, [group, "_part"]).withColumn(rank, place).drop("_at", "_part", "_first", "_before")
