"""Queries of similarity and clustering."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from storyline.functions import fixed
from storyline.operators import clustering as G
from storyline.operators import dedup as D
from storyline.operators import feed as S
from storyline.operators import similarity as Y
from storyline.operators.assignment import assign_in_slices
from storyline.operators.similarity import ScoreOptions
from storyline.plans import bindings as B
from storyline.plans import oracle_text as O
from storyline.plans import q_feed as Q
from storyline.plans.q_text import NORM, norm
from storyline.plans.registry import query

# SQL has no character ratio: twins run with the sequence term off, an option of the operator.
PLAIN = ScoreOptions(threshold=0.5, sequence=False)
FULL = ScoreOptions(threshold=0.68)


def guild():
    """Two guilds that share every forum."""
    return (F.floor(F.col("article_id") / 3) % 2 + 1).alias("guild_id")


def features(spark, sf_dir):
    n = norm(spark, sf_dir)
    us = F.unix_micros("published_at")
    return n.select(
        "article_id", guild(), "forum", "story_id", "publisher", "fingerprint", "canonical_url", "feed_id", "external_id",
        "title_tokens", "description_tokens", "entities", "keywords", "numbers", "event_terms",
        us.alias("published_us"), us.alias("arrival_us"), (F.col("article_id") % 4).cast("int").alias("priority"),
    )


FEATURES_CTE = f"""{NORM}, f AS MATERIALIZED (SELECT article_id, article_id // 3 % 2 + 1 AS guild_id, forum, story_id, title_tokens AS t, description_tokens AS d, entities AS e, keywords AS k,
   numbers AS n, event_terms AS v, epoch_us(published_at) AS us, CAST(article_id % 4 AS INTEGER) AS priority FROM norm)"""


def jac(a, b):
    return f"(CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect({a}, {b}))::DOUBLE / (len({a}) + len({b}) - len(list_intersect({a}, {b}))) END)"


def cos(a, b):
    return f"(CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect({a}, {b}))::DOUBLE / (sqrt(len({a})::DOUBLE) * sqrt(len({b})::DOUBLE)) END)"


def comp(a, b):
    return f"(CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0 WHEN list_has_any({a}, {b}) THEN 1 ELSE -1 END)"


def signals_sql(a: str, b: str, desc: str) -> str:
    return f"""{jac(f'{a}.t', f'{b}.t')} AS hj, {jac(f'{a}.e', f'{b}.e')} AS ent, {jac(f'{a}.k', f'{b}.k')} AS kw, {desc} AS descr,
      greatest(0.0::DOUBLE, 1.0::DOUBLE - (abs({a}.us - {b}.us)::DOUBLE / 3.6e9::DOUBLE) / 96.0::DOUBLE) AS prox, {comp(f'{a}.v', f'{b}.v')} AS ev, {comp(f'{a}.n', f'{b}.n')} AS num"""


SCORE_SQL = """greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.29::DOUBLE * hj + 0.21::DOUBLE * 0.0::DOUBLE + 0.17::DOUBLE * ent + 0.13::DOUBLE * kw
  + 0.12::DOUBLE * descr + 0.08::DOUBLE * prox + CASE WHEN ev < 0 THEN -0.22::DOUBLE WHEN ev > 0 THEN 0.07::DOUBLE ELSE 0.0::DOUBLE END
  + CASE WHEN num < 0 THEN -0.13::DOUBLE WHEN num > 0 THEN 0.04::DOUBLE ELSE 0.0::DOUBLE END))"""
SUPPORT_SQL = "(ev >= 0 AND ((hj >= 0.58 AND (ent >= 0.25 OR kw >= 0.4)) OR (hj >= 0.72 AND descr >= 0.2)))"


# --- signals over given pairs: each article with the one 30 before it (same lead phrase) -------
PAIR_CTE = f"""{FEATURES_CTE}, s AS (SELECT a.article_id AS left_id, b.article_id AS right_id, {signals_sql('a', 'b', cos('a.k', 'b.k'))}
   FROM f a JOIN f b ON b.article_id = a.article_id - 30), sc AS (SELECT *, {SCORE_SQL} AS score, {SUPPORT_SQL} AS support FROM s)"""


def paired(spark, sf_dir, options):
    arts = G.cut_lineage(features(spark, sf_dir))  # both sides of a pair read them
    pairs = arts.filter("article_id >= 30").select(
        F.col("article_id").alias("left_id"), (F.col("article_id") - 30).alias("right_id")
    )
    return Y.score_columns(Y.article_signals(pairs, arts), options, None)


def six(col):
    return F.round(col, 6).alias(col)


@query(
    "g1_signals",
    f"WITH {PAIR_CTE.replace('WITH ', '', 1)} SELECT left_id, right_id, round(hj, 6) AS hj, round(ent, 6) AS ent, round(kw, 6) AS kw, round(descr, 6) AS descr, round(prox, 6) AS prox, ev, num FROM sc",
)
def g1(spark, sf_dir):
    return paired(spark, sf_dir, PLAIN).select(
        "left_id", "right_id", *[six(c) for c in ("hj", "ent", "kw", "descr", "prox")], "ev", "num"
    )


@query("g2_weighted_score", f"WITH {PAIR_CTE.replace('WITH ', '', 1)} SELECT left_id, right_id, round(score, 6) AS score FROM sc")
def g2(spark, sf_dir):
    return paired(spark, sf_dir, PLAIN).select("left_id", "right_id", six("score"))


@query("g2_score_with_sequence")
def g2_full(spark, sf_dir):
    return paired(spark, sf_dir, FULL).select("left_id", "right_id", six("seq"), six("score"), "support")


@query("g3_support_gate", f"WITH {PAIR_CTE.replace('WITH ', '', 1)} SELECT left_id, right_id, support FROM sc")
def g3(spark, sf_dir):
    return paired(spark, sf_dir, PLAIN).select("left_id", "right_id", "support")


@query(
    "g5_significant_update",
    f"""WITH {FEATURES_CTE.replace('WITH ', '', 1)} SELECT a.article_id AS left_id, b.article_id AS right_id,
      1.0::DOUBLE - greatest({jac('a.t', 'b.t')}, {jac('a.k', 'b.k')}) >= 0.38::DOUBLE OR len(list_filter(a.n, lambda x: NOT list_contains(b.n, x))) > 0
      OR len(list_filter(a.e, lambda x: NOT list_contains(b.e, x))) > 0 AS significant FROM f a JOIN f b ON b.article_id = a.article_id - 30""",
)
def g5(spark, sf_dir):
    arts = G.cut_lineage(features(spark, sf_dir))
    other = arts.select((F.col("article_id") + 30).alias("article_id"), *[F.col(c).alias(f"b_{c}") for c in ("title_tokens", "keywords", "numbers", "entities")])
    j = arts.join(other, "article_id")
    facts = (F.size(F.array_except("numbers", "b_numbers")) > 0) | (F.size(F.array_except("entities", "b_entities")) > 0)
    return j.select(
        F.col("article_id").alias("left_id"), (F.col("article_id") - 30).alias("right_id"),
        G.is_significant(
            Y.jaccard(F.col("title_tokens"), F.col("b_title_tokens")), Y.jaccard(F.col("keywords"), F.col("b_keywords")), facts
        ).alias("significant"),
    )


# --- blocked joins -------------------------------------------------------------------------------
def pairs_cte(source: str = "f", window: str = " AND a.us - b.us <= 259200000000") -> str:
    """All supported pairs within the window by brute force, later article first."""
    return f"""ps AS (SELECT a.article_id AS left_id, b.article_id AS right_id, {signals_sql('a', 'b', cos('a.k', 'b.k'))}
   FROM {source} a JOIN {source} b ON a.guild_id = b.guild_id AND a.forum = b.forum AND (a.us, a.article_id) > (b.us, b.article_id){window}),
 similar_pairs AS MATERIALIZED (SELECT * FROM (SELECT *, {SCORE_SQL} AS score, {SUPPORT_SQL} AS support FROM ps) WHERE support AND score >= 0.5)"""


@query(
    "j2_similar_articles",
    f"WITH {FEATURES_CTE.replace('WITH ', '', 1)}, {pairs_cte()} SELECT left_id, right_id, round(score, 6) AS score FROM similar_pairs",
)
def j2(spark, sf_dir):
    return Y.similar_articles(features(spark, sf_dir), PLAIN).select("left_id", "right_id", six("score"))


@query("j2_similar_articles_with_sequence")
def j2_full(spark, sf_dir):
    return Y.similar_articles(features(spark, sf_dir), FULL).select("left_id", "right_id", six("seq"), six("score"))


@query(
    "g4_select_story",
    f"""WITH {FEATURES_CTE.replace('WITH ', '', 1)},
    st AS (SELECT a.article_id, a.us AS a_us, b.story_id * 100 + instr('en fr de es', b.forum) AS root, max(b.us) AS us, arg_max(b.t, (b.priority, -b.us, -b.article_id)) AS t,
      list_distinct(flatten(list(b.e))) AS e, list_sort(list_distinct(flatten(list(b.k))))[1:24] AS k, list_distinct(flatten(list(b.n))) AS n, list_distinct(flatten(list(b.v))) AS v
      FROM f a JOIN f b ON a.guild_id = b.guild_id AND a.forum = b.forum AND (b.us, b.article_id) < (a.us, a.article_id) WHERE a.article_id % 2 = 1 AND b.article_id % 2 = 0 GROUP BY ALL),
    sg AS (SELECT a.article_id, st.root, st.us AS updated, {signals_sql('a', 'st', cos('a.d', 'st.k'))},
      len(list_filter(a.n, lambda x: NOT list_contains(st.n, x))) > 0 OR len(list_filter(a.e, lambda x: NOT list_contains(st.e, x))) > 0 AS facts
      FROM st JOIN f a USING (article_id) WHERE st.us >= st.a_us - 259200000000),
    sc AS (SELECT *, {SCORE_SQL} AS score, {SUPPORT_SQL} AS support FROM sg),
    w AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY article_id ORDER BY score DESC, updated DESC, root) = 1)
    SELECT article_id, root, round(score, 6) AS score, 1.0::DOUBLE - greatest(hj, kw) >= 0.38::DOUBLE OR facts AS significant FROM w WHERE score >= 0.5 AND support""",
)
def g4(spark, sf_dir):
    """New (odd) articles against the stories that the even ones formed before each of them."""
    arts = G.cut_lineage(features(spark, sf_dir))
    members = arts.filter("article_id % 2 = 0").withColumn(
        "root", F.col("story_id") * 100 + F.position(F.col("forum"), F.lit("en fr de es"))
    )
    return G.select_stories(arts.filter("article_id % 2 = 1"), members, PLAIN).select(
        "article_id", "root", six("score"), "significant"
    )


#: Every thirteenth article is late: dated five days before it arrives.
LATE_US = 5 * 24 * 3600 * 10**6
ARRIVED_CTE = f"""{FEATURES_CTE}, src AS (SELECT f.*, norm.publisher, norm.fingerprint, norm.canonical_url, norm.feed_id, norm.external_id,
   us AS arr, CASE WHEN article_id % 13 = 5 THEN us - {LATE_US} ELSE us END AS pub FROM f JOIN norm USING (article_id)),
 ks AS MATERIALIZED (SELECT article_id, row_number() OVER (ORDER BY arr, article_id) AS n, list_filter(['id|' || feed_id || '|' || external_id, CASE WHEN canonical_url <> '' THEN 'url|' || canonical_url END,
   'print|' || publisher || '|' || fingerprint], lambda x: x IS NOT NULL) AS ks FROM src),
 firsts AS (SELECT CAST(0 AS BIGINT) AS n, CAST(-1 AS BIGINT) AS article_id, CAST([] AS VARCHAR[]) AS seen, false AS kept
   UNION ALL SELECT k.n, k.article_id, CASE WHEN list_has_any(w.seen, k.ks) THEN w.seen ELSE w.seen || k.ks END, NOT list_has_any(w.seen, k.ks) FROM firsts w JOIN ks k ON k.n = w.n + 1),
 came AS MATERIALIZED (SELECT src.* REPLACE (pub AS us), row_number() OVER (PARTITION BY guild_id, forum ORDER BY arr, article_id) AS n_th,
   min(pub) OVER (PARTITION BY guild_id, forum ORDER BY arr, article_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS later
   FROM src JOIN firsts USING (article_id) WHERE kept)"""


def arrived(spark, sf_dir):
    """Articles of two guilds in arrival order, some late."""
    late = F.when(F.col("article_id") % 13 == 5, F.col("published_us") - LATE_US).otherwise(F.col("published_us"))
    arts = G.cut_lineage(features(spark, sf_dir).withColumn("published_us", late))
    kept = D.first_wins(arts.withColumn("keys", D.article_keys()), "article_id", ["arrival_us"], "keys")
    return arts.join(kept, "article_id", "left_semi")


def replay_sql(threshold: float, hours: int = 72) -> str:
    """The sequence itself: one article of each (guild, forum) a step, the open stories as a list."""
    window = hours * 3600 * 10**6
    scored = f"""SELECT w.*, list_filter(stories, lambda s: s.us < w.r.us - {window}) AS others, list_transform(list_filter(stories, lambda s: s.us >= w.r.us - {window}), lambda s: {{
        'score': {SCORE_SQL}, 'us': s.us, 'nid': -s.root, 'hj': hj, 'kw': kw, 'support': {SUPPORT_SQL}, 'facts': facts }}) AS c FROM w"""
    for name, expression in (
        ("hj", jac("w.r.t", "s.t")), ("ent", jac("w.r.e", "s.e")), ("kw", jac("w.r.k", "s.k")), ("descr", cos("w.r.d", "s.k")),
        ("prox", "greatest(0.0::DOUBLE, 1.0::DOUBLE - (abs(w.r.us - s.last)::DOUBLE / 3.6e9::DOUBLE) / 96.0::DOUBLE)"),
        ("ev", comp("w.r.v", "s.v")), ("num", comp("w.r.n", "s.n")),
        ("facts", "(len(list_filter(w.r.n, lambda x: NOT list_contains(s.n, x))) > 0 OR len(list_filter(w.r.e, lambda x: NOT list_contains(s.e, x))) > 0)"),
    ):
        scored = re.sub(rf"(?<![\w'.]){name}(?![\w'])", lambda _, e=expression: f"({e})", scored)
    union = lambda c: f"list_sort(list_distinct(list_concat(s.{c}, r.{c})))"
    return f"""walk AS (SELECT guild_id, forum, CAST(0 AS BIGINT) AS n_th, CAST(NULL AS BIGINT) AS article_id, CAST(NULL AS BIGINT) AS root, CAST(NULL AS DOUBLE) AS score, CAST(NULL AS BOOLEAN) AS significant,
      CAST([] AS STRUCT(root BIGINT, t VARCHAR[], e VARCHAR[], k VARCHAR[], n VARCHAR[], v VARCHAR[], prio INTEGER, last BIGINT, us BIGINT)[]) AS stories FROM came GROUP BY guild_id, forum
    UNION ALL
    SELECT guild_id, forum, n_th, r.article_id, root, CASE WHEN fits THEN b.score END, CASE WHEN fits THEN 1.0::DOUBLE - greatest(b.hj, b.kw) >= 0.38::DOUBLE OR b.facts END,
      list_filter(CASE WHEN fits THEN list_transform(stories, lambda s: CASE WHEN s.root <> root THEN s ELSE {{'root': s.root, 't': CASE WHEN r.priority > s.prio THEN r.t ELSE s.t END,
          'e': {union('e')}, 'k': {union('k')}[1:24], 'n': {union('n')}, 'v': {union('v')}, 'prio': greatest(r.priority, s.prio), 'last': greatest(s.last, r.us), 'us': r.arr}} END)
        ELSE list_append(stories, {{'root': r.article_id, 't': r.t, 'e': r.e, 'k': r.k, 'n': r.n, 'v': r.v, 'prio': r.priority, 'last': r.us, 'us': r.arr}}) END, lambda s: s.us >= r.later - {window})
    FROM (SELECT *, coalesce(b.score >= {threshold} AND b.support, false) AS fits, CASE WHEN coalesce(b.score >= {threshold} AND b.support, false) THEN -b.nid ELSE r.article_id END AS root FROM (
      SELECT *, list_sort(c, 'DESC')[1] AS b FROM ({scored.replace(' FROM w', ' FROM (SELECT walk.guild_id, walk.forum, came.n_th, walk.stories, came AS r FROM walk JOIN came ON came.guild_id = walk.guild_id AND came.forum = walk.forum AND came.n_th = walk.n_th + 1) w')}))))"""


ASSIGNED_SQL = f"WITH RECURSIVE {ARRIVED_CTE.replace('WITH ', '', 1)}, {replay_sql(0.5)} SELECT article_id, root, round(score, 6) AS score, significant FROM walk WHERE n_th > 0"


@query("g6_online_assignment", ASSIGNED_SQL)
def g6(spark, sf_dir):
    """In sequence, character ratio off: SQL can replay it."""
    decisions, _ = assign_in_slices(arrived(spark, sf_dir), PLAIN)
    return decisions.select("article_id", "root", six("score"), "significant")


@query("g6_online_assignment_with_sequence")
def g6_full(spark, sf_dir):
    """All signals at the default threshold."""
    decisions, _ = assign_in_slices(arrived(spark, sf_dir), FULL)
    return decisions.select("article_id", "root", six("score"), "significant")


GROUPS_CTE = f"""{FEATURES_CTE}, gs AS (SELECT f.* EXCLUDE (story_id), article_id // 60 * 30 + article_id % 30 AS story_id FROM f),
 sizes AS (SELECT story_id, count(*) AS n, max(us) AS u FROM gs GROUP BY story_id), {pairs_cte('gs', '')},
 dir AS (SELECT p.score, CASE WHEN small THEN p.left_id ELSE p.right_id END AS art, CASE WHEN small THEN a.story_id ELSE b.story_id END AS small_id,
   CASE WHEN small THEN b.story_id ELSE a.story_id END AS large_id, least(a.n, b.n) AS small_n
   FROM (SELECT p.*, x.story_id AS ls, y.story_id AS rs FROM similar_pairs p JOIN gs x ON x.article_id = p.left_id JOIN gs y ON y.article_id = p.right_id WHERE x.story_id <> y.story_id) p
   JOIN sizes a ON a.story_id = p.ls JOIN sizes b ON b.story_id = p.rs, LATERAL (SELECT a.n < b.n OR (a.n = b.n AND (a.u, a.story_id) > (b.u, b.story_id)) AS small)),
 merges AS (SELECT small_id, large_id, min(best) AS merge_score FROM (SELECT small_id, large_id, small_n, art, max(score) AS best FROM dir GROUP BY ALL)
   GROUP BY small_id, large_id, small_n HAVING count(*) = small_n)"""


def grouped(spark, sf_dir):
    """Articles grouped in twos of the same lead phrase, so that whole stories repeat."""
    i = F.col("article_id")
    arts = G.cut_lineage(features(spark, sf_dir).withColumn("story_id", F.floor(i / 60) * 30 + i % 30))
    last = arts.groupBy("story_id").agg(F.max("published_us").alias("last_updated_us"))
    return arts.join(last, "story_id")


@query("g7_story_merge_score", f"WITH {GROUPS_CTE.replace('WITH ', '', 1)} SELECT small_id, large_id, round(merge_score, 6) AS merge_score FROM merges")
def g7(spark, sf_dir):
    return G.merge_scores(grouped(spark, sf_dir), PLAIN).select("small_id", "large_id", six("merge_score"))


@query(
    "g8_best_merge",
    f"""WITH {GROUPS_CTE.replace('WITH ', '', 1)}, {B.HISTORY_CTE},
    bare AS (SELECT s.story_id, s.n, s.u, s.story_id % 11 <> 0 AS threaded FROM sizes s WHERE s.story_id NOT IN (SELECT story_id FROM history WHERE CASE WHEN history_id % 40 = 0 THEN action END IN ('manual_merge', 'manual_split', 'manual_split_out'))),
    c AS (SELECT m.merge_score, (a.threaded, a.n, -a.story_id) >= (b.threaded, b.n, -b.story_id) AS keep, small_id, large_id,
      greatest((a.u, a.story_id), (b.u, b.story_id)) AS p, least((a.u, a.story_id), (b.u, b.story_id)) AS q
      FROM merges m JOIN bare a ON a.story_id = small_id JOIN bare b ON b.story_id = large_id)
    SELECT CASE WHEN keep THEN small_id ELSE large_id END AS target_id, CASE WHEN keep THEN large_id ELSE small_id END AS source_id, round(merge_score, 6) AS merge_score
    FROM c ORDER BY merge_score DESC, p DESC, q DESC LIMIT 1""",
)
def g8(spark, sf_dir):
    arts = G.cut_lineage(grouped(spark, sf_dir))
    stories = arts.groupBy("story_id").agg(F.timestamp_micros(F.max("published_us")).alias("last_updated_at"))
    stories = stories.withColumn("thread_id", F.when(F.col("story_id") % 11 != 0, F.col("story_id")))
    log = B.history(spark, sf_dir).withColumn("action", F.when(F.col("history_id") % 40 == 0, F.col("action")).otherwise("noted"))
    bare = Q.without_manual_actions(stories, log, F.lit("1970-01-01").cast("timestamp"))
    counts = arts.groupBy("story_id").agg(F.count(F.lit(1)).alias("n"))
    return G.best_merge(G.merge_scores(arts, PLAIN), bare, counts).withColumn("merge_score", F.round("merge_score", 6))


@query(
    "g9_outliers",
    f"""WITH {FEATURES_CTE.replace('WITH ', '', 1)}, p AS (SELECT a.story_id, a.article_id, {signals_sql('a', 'b', cos('a.k', 'b.k'))}
      FROM f a JOIN f b ON a.story_id = b.story_id AND a.article_id <> b.article_id),
    sc AS (SELECT *, {SCORE_SQL} AS score, {SUPPORT_SQL} AS support FROM p),
    j AS (SELECT story_id, article_id, max(score) FILTER (WHERE support) AS supported, max(score) AS score, bool_and(ev < 0) AS conflict, bool_and(hj < 0.42 AND ent < 0.25) AS apart
      FROM sc GROUP BY ALL),
    r AS (SELECT *, CASE WHEN conflict THEN 'conflicting event terms' WHEN score < 0.45 AND apart THEN 'no shared event identity' END AS reason FROM j WHERE coalesce(supported < 0.45, true))
    SELECT story_id, article_id, round(score, 6) AS score, reason FROM r WHERE reason IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY story_id ORDER BY score, article_id DESC) = 1""",
)
def g9(spark, sf_dir):
    return G.outliers(features(spark, sf_dir), 0.45, PLAIN).withColumn("score", F.round("score", 6))


@query(
    "g10_story_graph",
    f"""WITH RECURSIVE {FEATURES_CTE.replace('WITH ', '', 1)}, {pairs_cte()},
    e AS MATERIALIZED (SELECT left_id AS a, right_id AS b FROM similar_pairs UNION SELECT right_id, left_id FROM similar_pairs),
    reach AS (SELECT article_id AS a, article_id AS b FROM f UNION SELECT reach.a, e.b FROM reach JOIN e ON e.a = reach.b)
    SELECT a AS article_id, min(b) AS story_id FROM reach GROUP BY a""",
)
def g10(spark, sf_dir):
    return G.story_graph(features(spark, sf_dir), PLAIN)


@query("g11_maintenance_pass")
def g11(spark, sf_dir):
    arts = G.cut_lineage(grouped(spark, sf_dir).drop("last_updated_us"))
    stories = arts.groupBy("story_id", "forum").agg(F.timestamp_micros(F.max("published_us")).alias("last_updated_at"))
    stories = stories.groupBy("story_id").agg(F.max("last_updated_at").alias("last_updated_at"), F.min("forum").alias("forum"))
    stories = stories.select(
        "story_id", "forum", "last_updated_at", F.lit(1).cast("bigint").alias("guild_id"), F.lit("updated").alias("state"),
        F.lit("published").alias("publication_state"), (F.col("story_id") + 1000).alias("thread_id"), F.lit(None).cast("timestamp").alias("cleared_at"),
    )
    none = stories.select("story_id").limit(0)
    _, _, done = G.maintain(arts, stories, none, FULL, 0.82, 0.45, 50, Q.hours_ago(72), Q.now())
    return done


# --- relationships -------------------------------------------------------------------------------
def story_features_sql() -> str:
    def words(x):
        return f"list_distinct(list_filter(regexp_extract_all({O.fold(x)}, '[a-z0-9]+'), lambda w: length(w) > 1 AND NOT list_contains({O.lst(fixed.RELATION_IGNORED_WORDS)}, w)))"

    return f"""{Q.rollup_sql('norm')}, sf AS (SELECT s.story_id, s.guild_id, s.state, s.thread_id, s.last_updated_at, {words('s.title')} AS w, r.entities AS e, r.event_terms AS v, r.numbers AS n, r.keywords AS k
      FROM stories s JOIN rollup r USING (story_id))"""


@query(
    "j9_relationship_support",
    f"""WITH {B.STORIES_CTE}, {O.norm_cte()}, {story_features_sql()},
    pool AS (SELECT * FROM sf WHERE state <> 'merged' AND thread_id IS NOT NULL AND last_updated_at >= {Q.NOW_SQL} - INTERVAL 240 HOUR),
    pairs AS (SELECT s.story_id, p.story_id AS related_id FROM sf s JOIN pool p ON p.guild_id = s.guild_id AND p.story_id <> s.story_id
      QUALIFY row_number() OVER (PARTITION BY s.story_id ORDER BY p.last_updated_at DESC, p.story_id DESC) <= 20),
    c AS (SELECT story_id, related_id, len(list_intersect(a.w, b.w)) AS shared, least(len(a.w), len(b.w)) AS short, list_has_any(a.e, b.e) AS se, list_has_any(a.v, b.v) AS sv,
      list_has_any(a.n, b.n) AS sn, len(list_intersect(a.k, b.k)) AS sk FROM pairs JOIN sf a USING (story_id) JOIN (SELECT story_id AS related_id, w, e, v, n, k FROM sf) b USING (related_id))
    SELECT story_id, related_id, shared FROM c WHERE (shared >= 3 AND shared >= 0.5 * short) OR (se AND ((sv AND (shared >= 2 OR sk >= 3)) OR (sn AND shared >= 2)))""",
)
def j9(spark, sf_dir):
    """Support test over the relationship candidates of each story (a fixed number each)."""
    from storyline.operators.mutations import feature_rollup

    st = B.stories(spark, sf_dir)
    sf = G.cut_lineage(
        feature_rollup(norm(spark, sf_dir)).join(st.select("story_id", "title"), "story_id").select(
            "story_id", G.relationship_words(F.col("title")).alias("words"), "entities", "event_terms", "numbers", "keywords"
        )
    )
    pairs = S.relationship_candidates(st, Q.hours_ago(240), 20)
    names = ("words", "entities", "event_terms", "numbers", "keywords")
    right = sf.select(F.col("story_id").alias("related_id"), *[F.col(c).alias(f"b_{c}") for c in names])
    j = pairs.join(sf, "story_id").join(right, "related_id")
    ok = G.relationship_supported({c: F.col(c) for c in names}, {c: F.col(f"b_{c}") for c in names})
    return j.filter(ok).select(
        "story_id", "related_id", F.size(F.array_intersect("words", "b_words")).cast("bigint").alias("shared")
    )
