"""Queries of outlets, priorities, classification and tags."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from storyline.functions import fixed
from storyline.functions import outlets as P
from storyline.operators import classify as K
from storyline.plans import bindings as B
from storyline.plans import oracle_text as O
from storyline.plans.q_text import NORM, norm
from storyline.plans.registry import query

OUTLETS_CTE = f"""{B.ARTICLES_CTE}, outlets AS (
  SELECT *, {O.outlet_columns('publisher', 'url')} FROM articles)"""


def outlets(spark, sf_dir):
    pub, url = F.col("publisher"), F.col("url")
    return B.articles(spark, sf_dir).select(
        "*",
        P.canonical_source_name(pub, url).alias("outlet"),
        P.source_bias_bucket(pub, url).alias("bias"),
        P.source_bias_score(pub, url).alias("bias_score"),
    )


LABELS = ("", "site:reuters.com", "www.apnews.com", "Google News", "'Quoted'", "CNN.com")


def label_sql(publisher: str, url: str) -> tuple[str, str, str, str]:
    """Steps to the label of a publisher: columns for three inner selects, and the last expression."""
    return (
        f"""trim({O.plain(publisher, 100)}, {O.sql_text(chr(32) + chr(34) + chr(39))}) AS l0, regexp_replace({O.host(url)}, '^www\\.', '') AS h""",
        "CASE WHEN regexp_extract(l0, '(?i)site:([a-z0-9.-]+)', 1) <> '' THEN regexp_extract(l0, '(?i)site:([a-z0-9.-]+)', 1) ELSE l0 END AS l",
        f"""regexp_replace({O.fold('l')}, '^www\\.', '') AS c, MAP {{{', '.join(f"{O.sql_text(k)}: {O.sql_text(v)}" for k, v in fixed.KNOWN_LABELS.items())}}} AS known""",
        """CASE WHEN known[c] IS NOT NULL THEN known[c] WHEN contains(c, 'google news') AND h = 'news.google.com' THEN 'Google News'
      WHEN l <> '' THEN l ELSE coalesce(known[h], nullif(h, ''), 'Source') END""",
    )


LABEL = label_sql("p", "u")


@query(
    "p15_publisher_label",
    f"""WITH {B.ITEMS_CTE}, v AS (SELECT article_id,
      CASE WHEN article_id % 2 = 0 THEN publisher ELSE {B.sql_pick(LABELS, 'article_id // 2')} END AS p,
      CASE WHEN article_id % 7 = 0 THEN 'https://news.google.com/x' ELSE url END AS u FROM items),
    w AS (SELECT *, {LABEL[0]} FROM v), x AS (SELECT *, {LABEL[1]} FROM w), y AS (SELECT *, {LABEL[2]} FROM x)
    SELECT article_id, {LABEL[3]} AS label FROM y""",
)
def p15(spark, sf_dir):
    i = F.col("article_id")
    name = F.when(i % 2 == 0, F.col("publisher")).otherwise(B.pick(LABELS, F.floor(i / 2)))
    url = F.when(i % 7 == 0, F.lit("https://news.google.com/x")).otherwise(F.col("url"))
    return B.items(spark, sf_dir).select("article_id", P.publisher_label(name, url).alias("label"))


@query(
    "p16_source_profile",
    f"WITH {OUTLETS_CTE} SELECT article_id, outlet, bias_score FROM outlets WHERE bias_score IS NOT NULL",
)
def p16(spark, sf_dir):
    return outlets(spark, sf_dir).filter("bias_score IS NOT NULL").select("article_id", "outlet", "bias_score")


@query("p17_canonical_source_name", f"WITH {OUTLETS_CTE} SELECT article_id, outlet FROM outlets")
def p17(spark, sf_dir):
    return outlets(spark, sf_dir).select("article_id", "outlet")


@query("p18_source_bias_bucket", f"WITH {OUTLETS_CTE} SELECT article_id, bias FROM outlets")
def p18(spark, sf_dir):
    """Through the SQL functions, as a SQL user writes it."""
    P.register_sql(spark)
    B.articles(spark, sf_dir).createOrReplaceTempView("storyline_articles")
    return spark.sql(
        "SELECT article_id, source_bias_bucket(publisher, url) AS bias FROM storyline_articles"
    )


@query("p19_source_bias_score", f"WITH {OUTLETS_CTE} SELECT article_id, bias_score FROM outlets")
def p19(spark, sf_dir):
    return outlets(spark, sf_dir).select("article_id", "bias_score")


PRIORITY_MAP = "MAP {" + ", ".join(f"'{k}': {v}" for k, v in B.PRIORITIES.items()) + "}"


@query(
    "p30_source_priority",
    f"""WITH {B.ITEMS_CTE} SELECT article_id, CAST(coalesce({PRIORITY_MAP}[{O.fold('publisher')}],
      {PRIORITY_MAP}[{O.fold('feed_name')}], 0) AS INTEGER) AS priority FROM items""",
)
def p30(spark, sf_dir):
    return B.items(spark, sf_dir).select(
        "article_id",
        P.source_priority(F.col("publisher"), F.col("feed_name"), B.PRIORITIES).alias("priority"),
    )




def ordered_distinct(x: str, cap: int = 5) -> str:
    """Keep-first distinct of a list expression, capped (DuckDB's list_distinct has no order)."""
    return f"list_filter({x}, lambda v, i: list_position({x}, v) = i)[1:{cap}]"


@query(
    "p31_tags_for_state",
    f"""WITH {B.STORIES_CTE} SELECT story_id, array_to_string(CASE state
      WHEN 'breaking' THEN {ordered_distinct("(['Breaking'] || tags)")}
      WHEN 'developing' THEN {ordered_distinct("(['Developing'] || tags)")} ELSE tags END, '|') AS tags FROM stories""",
)
def p31(spark, sf_dir):
    return B.stories(spark, sf_dir).select(
        "story_id", F.array_join(K.tags_for_state(F.col("tags"), F.col("state")), "|").alias("tags")
    )


def classify_sql(rules: dict, source: str, feed_tags: str) -> str:
    """CTE chain ending in ``tagged`` (article_id, tags): exploded rules joined on word patterns."""
    values = ", ".join(
        f"({i}, {O.sql_text(tag)}, {O.sql_text('(^|[^A-Za-z0-9_])' + re.escape(t.casefold()) + '($|[^A-Za-z0-9_])')})"
        for i, (tag, terms) in enumerate(rules.items())
        for t in terms
    )
    return f"""texts AS MATERIALIZED (SELECT article_id, story_id, {O.ascii_words(O.fold('title'))} AS t,
      {O.ascii_words(O.fold('summary'))} AS d, canonical_url, {feed_tags} AS feed_tags FROM {source}),
    given AS (SELECT *, CASE WHEN contains(lower(canonical_url), '/sport/') AND NOT list_contains(feed_tags, 'Sports')
      THEN feed_tags || ['Sports'] ELSE feed_tags END AS g FROM texts),
    rules(o, tag, pattern) AS (VALUES {values}),
    hits AS (SELECT article_id, o, tag, sum(3 * CAST(regexp_matches(t, pattern) AS INTEGER)
      + CAST(regexp_matches(d, pattern) AS INTEGER)) AS score FROM given, rules
      WHERE NOT list_contains(g, tag) GROUP BY ALL),
    ranked AS (SELECT article_id, list(tag ORDER BY score DESC, o) AS ts FROM hits WHERE score > 0 GROUP BY article_id),
    tagged AS (SELECT given.article_id, given.story_id,
      CASE WHEN len(g || coalesce(ts, [])) = 0 THEN ['General'] ELSE (g || coalesce(ts, []))[1:5] END AS tags
      FROM given LEFT JOIN ranked USING (article_id))"""


FEED_TAGS = "CASE WHEN article_id % 4 = 0 THEN ['World', 'World'] WHEN article_id % 4 = 1 THEN ['Economy'] ELSE CAST([] AS VARCHAR[]) END"
FEED_TAGS_DISTINCT = FEED_TAGS.replace("['World', 'World']", "['World']")


def feed_tags():
    i = F.col("article_id")
    return (
        F.when(i % 4 == 0, F.array(F.lit("World"), F.lit("World")))
        .when(i % 4 == 1, F.array(F.lit("Economy")))
        .otherwise(F.array().cast("array<string>"))
    )


@query(
    "c1_classify",
    f"{NORM}, {classify_sql(fixed.TAG_RULES, 'norm', FEED_TAGS_DISTINCT)} "
    "SELECT article_id, array_to_string(tags, '|') AS tags FROM tagged",
)
def c1(spark, sf_dir):
    tags = K.classify(F.col("title"), F.col("summary"), F.col("canonical_url"), feed_tags())
    return norm(spark, sf_dir).select("article_id", F.array_join(tags, "|").alias("tags"))


OVERRIDES = {"World": ("war", "tre", "les"), "Local": ("gazette", "the", "der"), "AI": ("robot",)}


@query(
    "c2_rule_overrides",
    f"{NORM}, {classify_sql(K.with_overrides(OVERRIDES), 'norm', FEED_TAGS_DISTINCT)} "
    "SELECT unnest(tags) AS tag, count(*) AS articles FROM tagged GROUP BY 1",
)
def c2(spark, sf_dir):
    rules = K.with_overrides(OVERRIDES)
    tags = K.classify(F.col("title"), F.col("summary"), F.col("canonical_url"), feed_tags(), rules)
    return (
        norm(spark, sf_dir).select(F.explode(tags).alias("tag"))
        .groupBy("tag").agg(F.count(F.lit(1)).alias("articles"))
    )


def retag_stories(tagged, stories):
    """First five distinct tags of a story's articles in order, then its known current tags.

    ``tagged`` has story_id, article order columns and tags.  Only the first position of each
    tag matters, and there are few distinct tags, so the shuffle carries one row per
    (story, tag) however many articles a story has.
    """
    order = F.struct("published_at", "article_id", "pos")
    first = (
        tagged.select("story_id", "published_at", "article_id", F.posexplode("tags").alias("pos", "tag"))
        .groupBy("story_id", "tag").agg(F.min(order).alias("at"))
        .groupBy("story_id").agg(F.array_sort(F.collect_list(F.struct("at", "tag"))).alias("ts"))
    )
    known = F.filter("tags", lambda t: t.isin(list(fixed.TAG_CATALOG)))
    merged = F.slice(
        F.array_distinct(F.concat(F.transform("ts", lambda x: x["tag"]), known)), 1, fixed.TAGS_PER_STORY
    )
    return stories.join(first, "story_id").select(
        "story_id", "state", K.tags_for_state(merged, F.col("state")).alias("tags")
    )


RETAG_ORDERED = ordered_distinct("ts")


@query(
    "c3_story_retagging",
    f"""WITH {B.STORIES_CTE}, {O.norm_cte()}, {classify_sql(fixed.TAG_RULES, 'norm', FEED_TAGS_DISTINCT)},
    flat AS (SELECT story_id, flatten(list(tags ORDER BY published_at, article_id)) AS ts0
      FROM tagged JOIN items USING (article_id, story_id) GROUP BY story_id),
    joined AS (SELECT s.story_id, s.state, ts0 || s.tags AS ts FROM flat JOIN stories s USING (story_id)),
    firsts AS (SELECT story_id, state, {RETAG_ORDERED} AS ts FROM joined)
    SELECT story_id, state, array_to_string(CASE state WHEN 'breaking' THEN {ordered_distinct("(['Breaking'] || ts)")}
      WHEN 'developing' THEN {ordered_distinct("(['Developing'] || ts)")} ELSE ts END, '|') AS tags FROM firsts""",
)
def c3(spark, sf_dir):
    tags = K.classify(F.col("title"), F.col("summary"), F.col("canonical_url"), feed_tags())
    tagged = norm(spark, sf_dir).select("story_id", "article_id", "published_at", tags.alias("tags"))
    out = retag_stories(tagged, B.stories(spark, sf_dir))
    return out.withColumn("tags", F.array_join("tags", "|"))
