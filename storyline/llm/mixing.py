"""A mix of sources at target weights, filled to the word by subset sums over document lengths."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from storyline.session import cut_lineage

WEIGHTS = (5, 2, 1)
#: Documents of one source and length that are ranked in one piece.
RANKED = 1024


def word_count(text):
    """Number of words (runs of other characters than space and 0x09-0x0D); 0 of a null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length to take, so that their words come as near to ``budget`` as lengths allow.

    Each length first gives its proportional share, rounded down, and lengths with the largest lost fraction one document
    more while the budget has room; a bounded knapsack over the documents left fits the rest exactly, or as nearly as any
    choice of them can. Its table holds twice the longest length, not the budget.
    """
    total = int((lengths * counts).sum())
    budget = max(0, min(int(budget), total))
    if budget in (0, total):
        return counts * (budget > 0)
    share = counts * (budget / total)
    take = np.minimum(np.floor(share).astype(np.int64), counts)
    left = budget - int((take * lengths).sum())
    room = 2 * int(lengths.max())
    for i in np.lexsort((-lengths, take - share)).tolist():
        if left <= room:
            break
        if take[i] < counts[i] and lengths[i] <= left:
            take[i] += 1
            left -= int(lengths[i])
    for i in np.argsort(-lengths, kind="stable").tolist():
        if left <= room:
            break
        more = min(int(counts[i] - take[i]), (left - room) // int(lengths[i]) + 1, left // int(lengths[i]))
        take[i] += more
        left -= more * int(lengths[i])
    return take + _knapsack(lengths, counts - take, max(0, left))


def _knapsack(lengths: np.ndarray, counts: np.ndarray, target: int) -> np.ndarray:
    """Bounded knapsack: the counts whose sum is nearest to ``target``, the smaller of two sums at equal distance."""
    size = target + int(lengths.max()) + 1
    by = np.full(size, -1, np.int64)  # the piece that first reached a sum
    reached = np.zeros(size, bool)
    reached[0] = True
    pieces: list[tuple[int, int]] = []
    for i in np.flatnonzero(counts).tolist():
        rest, k = min(int(counts[i]), (size - 1) // int(lengths[i])), 1
        while rest > 0:
            k = min(k, rest)
            step = k * int(lengths[i])
            if step < size:
                new = reached[: size - step] & ~reached[step:]
                at = np.flatnonzero(new) + step
                reached[at] = True
                by[at] = len(pieces)
                pieces.append((i, k))
            rest -= k
            k *= 2
        if reached[target]:
            break
    sums = np.flatnonzero(reached)
    at = int(sums[np.argmin(np.abs(sums - target))])
    take = np.zeros(len(lengths), np.int64)
    while at:
        i, k = pieces[by[at]]
        take[i] += k
        at -= k * int(lengths[i])
    return take


def targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """``sizes`` (source, source_size) with ``target``: ``share`` of all words by weight, none above ``most`` times its size.

    Sources take the weights in code-point order, null last. What lies above a source's bound is shared among the others
    again, by weight, until none is above: one level for all, found in rounds of one aggregate over the sources.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    ranked = sizes.withColumn("rank", F.row_number().over(order) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = cut_lineage(ranked.withColumn("weight", weight).withColumn("bound", F.col("source_size") * float(most)))
    level, full = 0.0, -1
    while True:
        over = F.col("weight") * level >= F.col("bound")
        row = ranked.agg(
            F.sum("source_size").alias("all"),
            F.sum(F.when(over, F.col("bound"))).alias("used"),
            F.sum(F.when(~over, F.col("weight"))).alias("free"),
            F.count_if(over).alias("full"),
        ).first()
        if not row["free"] or row["full"] == full:
            break
        full = row["full"]
        level = (row["all"] * float(share) - (row["used"] or 0.0)) / row["free"]
    return ranked.withColumn("target", F.least("bound", F.col("weight") * level)).drop("rank", "bound")


def mix(
    docs: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: Sequence[float] = WEIGHTS,
    share: float = 1.5,
    most: int = 2,
    seed: int = 0,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, target, taken (words taken, repeats counted).

    A source is taken whole as often as its target allows; of the rest, documents of each length are counted, ``fit``
    chooses how many of each length to take, and the seed which ones. A null text has no words and, like an empty one, is
    never taken; null is a source of its own; a null id has a draw of its own; repeated rows are drawn one by one; other
    columns are ignored; an empty table gives no rows. The words taken are nearest to the target among what the lengths
    allow, and no document gives more than ``most`` times its words.

    A hot source only meets aggregates; a hot length of one source is ranked in pieces of about ``RANKED`` documents.
    """
    named = docs.select(
        F.col(id).alias("doc_id"), F.col(source).cast("string").alias("source"), word_count(F.col(text)).alias("size")
    )
    sized = cut_lineage(named.withColumn("key", F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))))
    counts = sized.groupBy("key", "source", "size").agg(F.count("*").alias("n"))
    totals = counts.groupBy("key", "source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    goals = targets(totals, weights, share, most)

    def choose(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("size")  # rows come in any order; the choice shall not depend on it
        sizes, n = group["size"].to_numpy(np.int64), group["n"].to_numpy(np.int64)
        total, goal = int((sizes * n).sum()), float(group["target"].iloc[0])
        whole = min(int(goal // total), most) if total else 0
        take = fit(sizes, n, round(goal - whole * total)) if total and whole < most else np.zeros(len(n), np.int64)
        return pd.DataFrame({"key": group["key"], "size": sizes, "n": n, "whole": whole, "take": take})

    lengths = counts.filter("size > 0").select("key", "size", "n").join(goals.select("key", "target"), "key")
    chosen = lengths.groupBy("key").applyInPandas(choose, "key string, size long, n long, whole long, take long")
    chosen = cut_lineage(chosen)
    drawn = sized.join(chosen, ["key", "size"], "left").withColumn("draw", F.xxhash64(F.lit(seed), "doc_id", "key", "size"))
    piece = F.pmod(F.shiftrightunsigned("draw", 20), F.ceil(F.col("n") / RANKED))
    drawn = drawn.withColumn("piece", F.coalesce(piece, F.lit(0))).repartition("key", "size", "piece")
    large = drawn.filter(f"n > {RANKED}").groupBy("key", "size", "piece").agg(F.count("*").alias("k"))
    before = Window.partitionBy("key", "size").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    offset = large.select("key", "size", "piece", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("key", "size", "piece").orderBy("draw", "doc_id")
    ranked = drawn.withColumn("place", F.row_number().over(inside)).join(offset, ["key", "size", "piece"], "left")
    picked = (F.col("place") + F.coalesce("before", F.lit(0)) <= F.col("take")).cast("long")
    taken = F.coalesce(F.col("size") * (F.col("whole") + picked), F.lit(0))
    return ranked.withColumn("taken", taken).join(goals.select("key", "source_size", "target"), "key").select(
        "doc_id", "source", "size", "source_size", "target", "taken"
    )
