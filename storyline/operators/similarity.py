"""Similarity signals, scores and the exact search for the pairs that reach a threshold.

A score can only reach the threshold when at least one set signal is large, so pairs that share too few tokens are passed
over. The search loses nothing; it is a bound, not a heuristic.
"""

from __future__ import annotations

from dataclasses import dataclass
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storyline.functions import fixed
from storyline.functions.text import let
from storyline.operators.pairs import SUPPORT_HEADLINE, in_cells, in_slices, link_rows, linked_rows, merge_rows, pair_rows
from storyline.session import cut_lineage

BLOCK_ROWS = 4000  # rows of a slice of a guild and forum; two slices meet in a task
#: Articles only meet others of their guild and forum.
PLACE = ["guild_id", "forum"]
#: Characters that normalised titles consist of.
TITLE_CHARACTERS = "abcdefghijklmnopqrstuvwxyz0123456789. "


@dataclass(frozen=True)
class ScoreOptions:
    """Options of clustering, checked like the settings they come from."""

    threshold: float = 0.68
    window_hours: int = 72
    sequence: bool = True

    def __post_init__(self):
        if not 0.5 <= self.threshold <= 0.95:
            raise ValueError("clustering threshold must be between 0.5 and 0.95")
        if not 1 <= self.window_hours <= 720:
            raise ValueError("window_hours must be between 1 and 720")

    def slack(self) -> float:
        """Most that the signals without token evidence can add."""
        extra = fixed.WEIGHT_TIME + fixed.EVENT_MATCH + fixed.NUMBER_MATCH
        return extra + (fixed.WEIGHT_SEQUENCE if self.sequence else 0.0)


# --- signals -----------------------------------------------------------------------
def jaccard(a: Column, b: Column) -> Column:
    return let(
        F.size(F.array_intersect(a, b)),
        lambda n: F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(
            n / (F.size(a) + F.size(b) - n)
        ),
    )


def cosine(a: Column, b: Column) -> Column:
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(
        F.size(F.array_intersect(a, b)) / (F.sqrt(F.size(a).cast("double")) * F.sqrt(F.size(b).cast("double")))
    )


def compatibility(a: Column, b: Column) -> Column:
    """0 when either side is silent, 1 on any overlap, else -1."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0)).otherwise(
        F.when(F.arrays_overlap(a, b), F.lit(1)).otherwise(F.lit(-1))
    )


def time_proximity(us_a: Column, us_b: Column) -> Column:
    hours = F.abs(us_a - us_b) / 3.6e9
    return F.greatest(F.lit(0.0), 1.0 - hours / fixed.TIME_DECAY_HOURS)


@F.pandas_udf(T.DoubleType())
def sequence_ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    """Character similarity of two sorted token texts; argument order matters."""
    return pd.Series(
        [None if a is None or b is None else SequenceMatcher(None, a, b).ratio() for a, b in zip(left, right)],
        dtype="float64",
    )


def weighted(hj, seq, ent, kw, desc, time, ev, num) -> Column:
    """Weighted score, clamped to 0..1; the order of additions is part of the definition."""
    base = (
        fixed.WEIGHT_HEADLINE * hj + fixed.WEIGHT_SEQUENCE * seq + fixed.WEIGHT_ENTITIES * ent
        + fixed.WEIGHT_KEYWORDS * kw + fixed.WEIGHT_DESCRIPTION * desc + fixed.WEIGHT_TIME * time
    )
    base = base + F.when(ev < 0, fixed.EVENT_CONFLICT).when(ev > 0, fixed.EVENT_MATCH).otherwise(0.0)
    base = base + F.when(num < 0, fixed.NUMBER_CONFLICT).when(num > 0, fixed.NUMBER_MATCH).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), base))


def has_support(hj, seq, ent, kw, desc, ev) -> Column:
    """Whether a score rests on a shared identity."""
    head = F.greatest(hj, seq)
    return (ev >= 0) & (
        ((head >= SUPPORT_HEADLINE) & ((ent >= 0.25) | (kw >= 0.4))) | ((head >= 0.72) & (desc >= 0.2))
    )


SIGNALS = ("hj", "ent", "kw", "descr", "prox", "ev", "num")


def character_counts(text: Column) -> Column:
    """How often each of TITLE_CHARACTERS occurs in a normalised title, as an array."""
    return F.array(*[F.length(text) - F.length(F.replace(text, F.lit(c), F.lit(""))) for c in TITLE_CHARACTERS])


def ratio_bound(left: Column, right: Column) -> Column:
    """What the character ratio of two titles cannot exceed: twice the characters that both have, over all."""
    shared = F.aggregate(F.zip_with(left, right, lambda a, b: F.least(a, b)), F.lit(0), lambda n, x: n + x)
    every = F.aggregate(F.concat(left, right), F.lit(0), lambda n, x: n + x)
    return F.when(every == 0, F.lit(1.0)).otherwise(2.0 * shared / every)


def score_columns(df: DataFrame, options: ScoreOptions, threshold: float | None) -> DataFrame:
    """Add seq, score and support to rows with the cheap signals and texts ``lt`` / ``rt``.

    With a threshold, rows that cannot reach it even with a perfect sequence are dropped, and then those that cannot with
    the ratio that their characters (``lc`` / ``rc``, where given) allow at most; the Arrow UDF sees the rest.
    """
    c = [F.col(x) for x in SIGNALS]
    best = weighted(c[0], F.lit(1.0 if options.sequence else 0.0), *c[1:])
    rows = df if threshold is None else df.filter(best >= threshold - 1e-9)
    if "lc" in df.columns:
        if threshold is not None and options.sequence:
            rows = rows.filter(weighted(c[0], ratio_bound(F.col("lc"), F.col("rc")), *c[1:]) >= threshold - 1e-9)
        rows = rows.drop("lc", "rc")
    seq = sequence_ratio(F.col("lt"), F.col("rt")) if options.sequence else F.lit(0.0)
    rows = rows.withColumn("seq", seq)
    s = F.col("seq")
    return rows.select(
        "*",
        weighted(c[0], s, *c[1:]).alias("score"),
        has_support(c[0], s, c[1], c[2], c[3], c[5]).alias("support"),
    )


FEATURES = ("title_tokens", "entities", "keywords", "numbers", "event_terms", "published_us")


def signals_of(left: str, right: str) -> list[Column]:
    """Cheap signals of two articles whose features have these prefixes, symmetric in both."""
    def lr(name):
        return F.col(f"{left}_{name}"), F.col(f"{right}_{name}")

    return [
        jaccard(*lr("title_tokens")).alias("hj"),
        jaccard(*lr("entities")).alias("ent"),
        jaccard(*lr("keywords")).alias("kw"),
        cosine(*lr("keywords")).alias("descr"),
        time_proximity(*lr("published_us")).alias("prox"),
        compatibility(*lr("event_terms")).alias("ev"),
        compatibility(*lr("numbers")).alias("num"),
    ]


def article_signals(pairs: DataFrame, articles: DataFrame) -> DataFrame:
    """Cheap signals of given pairs (left_id, right_id) of articles."""
    def side(p):
        text = F.col("text") if "text" in articles.columns else F.array_join("title_tokens", " ")
        return articles.select(
            F.col("article_id").alias(f"{p}_id"), *[F.col(c).alias(f"{p}_{c}") for c in FEATURES], text.alias(f"{p[0]}t"),
            character_counts(text).alias(f"{p[0]}c"),
        )

    j = pairs.join(side("left"), "left_id").join(side("right"), "right_id")
    keep = [c for c in pairs.columns if c not in ("left_id", "right_id")]
    return j.select("left_id", "right_id", *keep, *signals_of("left", "right"), "lt", "rt", "lc", "rc")


# --- pairs -------------------------------------------------------------------------
def _window_us(options: ScoreOptions, window: bool) -> int | None:
    return options.window_hours * 3600 * 10**6 if window else None


def supported_pairs(articles: DataFrame, options: ScoreOptions, window: bool = True, both: bool = False) -> DataFrame:
    """Distinct pairs (left_id, right_id, seq, score), both of one guild and forum, supported and at the threshold.

    Left is the later one, or either with ``both``, as the character ratio depends on which comes first. Within the window of the
    options unless ``window`` is off.
    """
    us = _window_us(options, window)
    schema = "left_id long, right_id long, seq double, score double"
    return in_cells(*in_slices(articles, PLACE, options, us, BLOCK_ROWS), PLACE, pair_rows(options, us, both), schema)


def linked_articles(articles: DataFrame, options: ScoreOptions) -> tuple[DataFrame, DataFrame]:
    """Labels (article_id, label) and links (a, b) of labels: together they connect what ``similar_articles`` connects.

    A label is the smallest id that the pairs of an article's slice connect it with, so near copies of a slice are one to the others.
    """
    us = _window_us(options, True)
    placed, cells = in_slices(articles, PLACE, options, us, BLOCK_ROWS)
    found = cut_lineage(in_cells(placed, cells.filter("earlier = later"), PLACE, linked_rows(options, us), "article_id long, label long").distinct())
    labels = cut_lineage(found.groupBy("article_id").agg(F.min("label").alias("label"), F.count(F.lit(1)).alias("n")))
    repeated = labels.filter("n > 1").select("article_id", F.col("label").alias("a"))  # rows of one id are one article
    told = cut_lineage(placed.join(labels.select("article_id", "label"), "article_id"))
    links = in_cells(told, cells.filter("earlier < later"), PLACE, link_rows(options, us), "a long, b long")
    return labels.select("article_id", "label"), links.unionByName(found.join(repeated, "article_id").select("a", F.col("label").alias("b")).filter("a <> b"))


def best_by_story(articles: DataFrame, options: ScoreOptions) -> DataFrame:
    """Rows (small_id, large_id, small_n, left_id, best) over all times: best score of an article of a smaller story with a larger one.

    An article has a row for each task that finds one. Needs the columns story, n (its articles) and u (its last update) too.
    """
    schema = "small_id long, large_id long, small_n long, left_id long, best double"
    return in_cells(*in_slices(articles, PLACE, options, None, BLOCK_ROWS, ("story", "n", "u")), PLACE, merge_rows(options), schema)


def similar_articles(articles: DataFrame, options: ScoreOptions) -> DataFrame:
    """Supported article pairs of one guild and forum within the window, score at least the threshold.

    Needs article_id, guild_id, forum, published_us and the feature arrays; run it on de-duplicated
    articles (``first_wins``), so that copies do not multiply pairs.
    """
    return supported_pairs(articles, options)
