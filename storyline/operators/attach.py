"""What a story has become after its articles were attached one by one, from parts that can be joined in order.

Everything but the tags is a maximum, a minimum or a union. Tags are a short ordered list: each article puts its own first,
keeps the story's earlier ones without state tags, and cuts the list. A run of articles is then a function of the list
before it: some tags of its own, followed by what is left of the earlier list after a few steps (leave these out, keep so
many). Steps that change nothing more are dropped, so a run of any length is a few small steps, and runs are joined by
putting their steps one after the other.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyline.functions import fixed
from storyline.operators.mutations import feature_rollup

_STATE_TAGS = ("breaking", "developing")
_PARTS = "story_id long, at long, calm struct<own:array<string>,steps:array<struct<out:array<string>,keep:int>>>, urgent struct<own:array<string>,steps:array<struct<out:array<string>,keep:int>>>"


def _topics(tags: list[str]) -> list[str]:
    return [t for t in tags if t.lower() not in _STATE_TAGS]


def _labelled(tags, state: str | None) -> list[str]:
    """An article's tags under a state: its label first, each once, cut."""
    label = {"breaking": ["Breaking"], "developing": ["Developing"]}.get(state, [])
    return list(dict.fromkeys([*label, *(t for t in tags if t is not None)]))[: fixed.TAGS_PER_STORY]


class Run:
    """The function of the list before: ``own`` first, then the earlier topics after ``steps`` of (left out, kept)."""

    def __init__(self, own: list[str], steps: list[tuple[list[str], int]] | None):
        self.own, self.steps = own, steps  # None: nothing of the list before is used

    @classmethod
    def of(cls, tags: list[str]) -> Run:
        """One attached article."""
        room = fixed.TAGS_PER_STORY - len(tags)
        return cls(tags, [(tags, room)] if room > 0 else None)

    def after(self, before: list[str]) -> list[str]:
        rest = _topics(before)
        for out, keep in self.steps or ():
            rest = [t for t in rest if t not in out][:keep]
        return self.own + (rest if self.steps is not None else [])

    def then(self, later: Run) -> Run:
        """This run and the one after it as one."""
        if later.steps is None:
            return later
        rest = _topics(self.own)
        steps = []
        for out, keep in later.steps:
            rest = [t for t in rest if t not in out][:keep]
            steps.append((out, keep - len(rest)))
        # What came from this run takes its places first; each later step leaves the rest of its room to the list before.
        own = later.own + rest
        if self.steps is None or any(room <= 0 for _, room in steps) or len(own) >= fixed.TAGS_PER_STORY:
            return Run(own, None)
        return Run(own, self._short(self.steps + steps))

    @staticmethod
    def _short(steps: list[tuple[list[str], int]]) -> list[tuple[list[str], int]]:
        kept, gone, room = [], set(), fixed.TAGS_PER_STORY
        for out, keep in steps:
            if set(out) - gone or keep < room:
                kept.append((out, keep))
                gone |= set(out)
                room = min(room, keep)
        return kept


def _row(run: Run) -> dict:
    return {"own": run.own, "steps": None if run.steps is None else [{"out": o, "keep": k} for o, k in run.steps]}


def _run(row) -> Run:
    steps = row["steps"]
    return Run(list(row["own"]), None if steps is None else [(list(s["out"]), int(s["keep"])) for s in steps])


def _runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Articles in order → a run for each story of the partition, for a story that opened as breaking and for one that did not."""
    held, at = {}, {}
    for frame in batches:
        for n, (story, ord_, first, tags, significant) in enumerate(zip(*(frame[c] for c in ("story_id", "ord", "opens", "tags", "significant")))):
            tags = [] if tags is None else list(tags)
            calm = Run.of(_labelled(tags, None if first else "developing" if significant else "updated"))
            urgent = Run.of(_labelled(tags, "breaking"))
            at.setdefault(story, ord_)
            held[story] = tuple(a.then(b) for a, b in zip(held[story], (calm, urgent))) if story in held else (calm, urgent)
    rows = [(s, at[s], _row(c), _row(u)) for s, (c, u) in held.items()]
    yield pd.DataFrame(rows, columns=["story_id", "at", "calm", "urgent"])


def attach_fold(articles: DataFrame) -> DataFrame:
    """One row per story as its articles, attached in order, have made it.

    ``articles``: story_id, article_id, published_at, priority, tags, significant, title, summary and the feature arrays;
    order is (published_at, article_id), nulls first. Returns story_id, state, tags, primary_article_id, title, summary,
    primary_priority, and the count, unions and dates of ``feature_rollup``. The first article makes the story breaking if
    it is tagged so, which then stays; later ones make it developing if they are significant, else updated. The primary
    article has the highest priority, the earliest of those. Runs are folded where the articles lie, by ranges of (story,
    order): a story has a row per task in the shuffle that joins them. Articles without a story are left out.
    """
    articles = articles.filter("story_id is not null")
    rank = F.struct(F.col("published_at"), F.col("article_id"))
    high = F.struct(F.coalesce("priority", F.lit(0)), -F.coalesce(F.unix_micros("published_at"), F.lit(-(2**62))), -F.col("article_id"))
    heads = articles.groupBy("story_id").agg(
        F.max_by(F.struct("article_id", "title", "summary", "priority"), high).alias("p"), F.count("*").alias("articles"),
        F.min_by(F.exists(F.coalesce("tags", F.array().cast("array<string>")), lambda t: F.lower(t) == "breaking"), rank).alias("urgent"),
        F.max_by(F.coalesce("significant", F.lit(False)), rank).alias("significant"), F.min_by("article_id", rank).alias("opener"),
    )
    state = F.when(F.coalesce("urgent", F.lit(False)), "breaking").when(F.col("articles") == 1, "new").when(F.col("significant"), "developing").otherwise("updated")
    spark = articles.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    marked = articles.join(heads.select("story_id", F.col("opener").alias("_first")), "story_id").select(
        "story_id", "article_id", "published_at", "tags", F.coalesce("significant", F.lit(False)).alias("significant"), (F.col("article_id") == F.col("_first")).alias("opens")
    )
    placed = marked.repartitionByRange(parts, "story_id", "published_at", "article_id").sortWithinPartitions("story_id", "published_at", "article_id")
    placed = placed.select("story_id", F.monotonically_increasing_id().alias("ord"), "opens", "tags", "significant")
    runs = placed.mapInPandas(_runs, _PARTS)

    def joined(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("at")
        whole = []
        for name in ("calm", "urgent"):
            run = None
            for r in rows[name]:
                run = _run(r) if run is None else run.then(_run(r))
            whole.append(run.after([]))
        return pd.DataFrame({"story_id": [rows["story_id"].iloc[0]], "calm": [whole[0]], "hot": [whole[1]]})

    tags = runs.groupBy("story_id").applyInPandas(joined, "story_id long, calm array<string>, hot array<string>")
    told = heads.join(tags, "story_id").select(
        "story_id", state.alias("state"), F.when(F.coalesce("urgent", F.lit(False)), F.col("hot")).otherwise(F.col("calm")).alias("tags"),
        F.col("p.article_id").alias("primary_article_id"), "p.title", "p.summary", F.col("p.priority").alias("primary_priority"),
    )
    return told.join(feature_rollup(articles), "story_id")
