"""Queries of the scalar text, URL and time functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from storyline.functions import analysis as A
from storyline.functions import clock as C
from storyline.functions import fixed
from storyline.functions import text as X
from storyline.functions import urls as U
from storyline.operators.normalize import normalize_items
from storyline.operators.redundancy import with_kept_lines
from storyline.plans import bindings as B
from storyline.plans import oracle_text as O
from storyline.plans.registry import query

NORM = "WITH " + B.ITEMS_CTE + ", " + O.norm_cte()


def norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize_items(B.items(spark, sf_dir))


def bar(col: str):
    return F.array_join(col, "|").alias(col)


def sbar(col: str) -> str:
    return f"array_to_string({col}, '|') AS {col}"


@query(
    "p1_plain_text",
    f"SELECT doc_id, {O.plain("(text || '  & more')", 500)} AS plain FROM documents",
)
def p1(spark, sf_dir):
    marked = F.concat(F.lit("<b>"), F.col("text"), F.lit("</b> &amp; <!-- note -->more"))
    return B.read(spark, sf_dir, "documents").select("doc_id", X.plain_text(marked, 500).alias("plain"))


MENTION_TAIL = " @everyone @Here and @!45 @nobody @7"


@query(
    "p2_neutralize_mentions",
    f"SELECT conv_id, turn, {O.mentions(f"(text || '{MENTION_TAIL}')")} AS safe FROM conversations",
)
def p2(spark, sf_dir):
    text = F.concat(F.col("text"), F.lit(MENTION_TAIL))
    return B.read(spark, sf_dir, "conversations").select(
        "conv_id", "turn", X.neutralize_mentions(text).alias("safe")
    )


P3_SQL = """CASE page_id % 5 WHEN 0 THEN url WHEN 1 THEN replace(url, '://', '://user:pw@')
 WHEN 2 THEN 'ftp' || url WHEN 3 THEN url || repeat('x', 2048) ELSE upper(url) END"""


@query(
    "p3_safe_external_link",
    f"SELECT page_id, {O.safe_link('u')} AS link FROM (SELECT page_id, {P3_SQL} AS u FROM pages)",
)
def p3(spark, sf_dir):
    variant = F.expr(
        "CASE page_id % 5 WHEN 0 THEN url WHEN 1 THEN replace(url, '://', '://user:pw@') "
        "WHEN 2 THEN concat('ftp', url) WHEN 3 THEN concat(url, repeat('x', 2048)) ELSE upper(url) END"
    )
    return B.read(spark, sf_dir, "pages").select(
        "page_id", U.safe_external_link(variant).alias("link")
    )


@query(
    "p4_normalize_url",
    f"""WITH {B.ITEMS_CTE}
    SELECT 'page' AS kind, page_id AS id, {O.normalize_url('url')} AS canonical FROM pages
    UNION ALL SELECT 'item', article_id, {O.normalize_url('url')} FROM items""",
)
def p4(spark, sf_dir):
    pages = B.read(spark, sf_dir, "pages").select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), "url")
    items = B.items(spark, sf_dir).select(F.lit("item").alias("kind"), F.col("article_id").alias("id"), "url")
    return pages.unionAll(items).select("kind", "id", U.normalize_url(F.col("url")).alias("canonical"))


@query(
    "p5_normalize_headline",
    f"""WITH {B.ITEMS_CTE} SELECT article_id,
    array_to_string({O.headline_words("(title || ' 50-basis-point')")}, ' ') AS headline FROM items""",
)
def p5(spark, sf_dir):
    title = F.concat(F.col("title"), F.lit(" 50-basis-point"))
    return B.items(spark, sf_dir).select("article_id", X.normalize_headline(title).alias("headline"))


@query(
    "p6_tokenize",
    f"""WITH {B.ITEMS_CTE} SELECT article_id,
    array_to_string({O.token_set(O.headline_words("title"))}, '|') AS tokens FROM items""",
)
def p6(spark, sf_dir):
    return B.items(spark, sf_dir).select(
        "article_id", F.array_join(X.tokenize(F.col("title")), "|").alias("tokens")
    )


@query("p7_extract_entities", f"{NORM} SELECT article_id, {sbar('entities')} FROM norm")
def p7(spark, sf_dir):
    return norm(spark, sf_dir).select("article_id", bar("entities"))


@query("p8_extract_keywords", f"{NORM} SELECT article_id, {sbar('keywords')} FROM norm")
def p8(spark, sf_dir):
    return norm(spark, sf_dir).select("article_id", bar("keywords"))


@query("p9_extract_numbers", f"{NORM} SELECT article_id, {sbar('numbers')} FROM norm")
def p9(spark, sf_dir):
    return norm(spark, sf_dir).select("article_id", bar("numbers"))


@query("p10_event_terms", f"{NORM} SELECT article_id, {sbar('event_terms')} FROM norm")
def p10(spark, sf_dir):
    return norm(spark, sf_dir).select("article_id", bar("event_terms"))


@query(
    "p11_fingerprint",
    f"{NORM} SELECT fingerprint, count(*) AS copies FROM norm GROUP BY fingerprint",
)
def p11(spark, sf_dir):
    return norm(spark, sf_dir).groupBy("fingerprint").agg(F.count(F.lit(1)).alias("copies"))


@query(
    "p12_source_artifacts",
    f"""WITH {B.ITEMS_CTE}, a AS (SELECT article_id, {O.squash(O.fold('summary'))} AS low FROM items),
    b AS MATERIALIZED (SELECT *, {O.ascii_words('low')} AS asc_low, regexp_extract_all(low, '[a-z0-9]+') AS w FROM a)
    SELECT article_id, {O.artifacts('low', 'asc_low', 'w')} AS contaminated FROM b""",
)
def p12(spark, sf_dir):
    return B.items(spark, sf_dir).select(
        "article_id", X.source_artifacts(F.col("summary")).alias("contaminated")
    )


@query(
    "p13_normalize_item",
    f"""{NORM} SELECT article_id, title, publisher, canonical_url, normalized_title, fingerprint,
    sha256(summary) AS summary_sha, {sbar('keywords')}, {sbar('entities')}, {sbar('numbers')} FROM norm""",
)
def p13(spark, sf_dir):
    return norm(spark, sf_dir).select(
        "article_id", "title", "publisher", "canonical_url", "normalized_title", "fingerprint",
        F.sha2("summary", 256).alias("summary_sha"), bar("keywords"), bar("entities"), bar("numbers"),
    )


P14_SPARK = """CASE doc_id % 4 WHEN 0 THEN concat('## ', substring_index(text, '\n', 1), ' - www.example.com')
 WHEN 1 THEN concat('Lead - tail\n- point\n', text) WHEN 2 THEN concat('<br/> \n', text) ELSE text END"""
P14_SQL = f"""WITH v AS (SELECT doc_id, CASE doc_id % 4
   WHEN 0 THEN '## ' || string_split(text, chr(10))[1] || ' - www.example.com'
   WHEN 1 THEN 'Lead - tail' || chr(10) || '- point' || chr(10) || text
   WHEN 2 THEN '<br/> ' || chr(10) || text ELSE text END AS t FROM documents),
 l AS (SELECT doc_id, t, list_filter(list_transform(string_split_regex(
   regexp_replace(t, '(?i)<br\\s*/?>', chr(10), 'g'), '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]'),
   lambda x: regexp_replace(x, '^{O.RE2_SPACE}+|{O.RE2_SPACE}+$', '', 'g')), lambda x: x <> '') AS ls FROM v),
 f AS (SELECT doc_id, CASE WHEN len(list_filter(ls[2:], lambda x: regexp_matches(x, '^(?:[-*•]|\\d+[.)])\\s+'))) > 0
   AND contains(ls[1], ' - ') THEN string_split(ls[1], ' - ')[1] ELSE ls[1] END AS h FROM l),
 g AS (SELECT doc_id, regexp_replace(regexp_replace(h, '^\\s*(?:#{{1,6}}|[-*•]|\\d+[.)])\\s+', ''),
   '(?i)\\s+(?:-|\\|)\\s+(?:www\\.)?(?:[a-z0-9-]+\\.)+[a-z]{{2,}}\\s*$', '') AS h FROM f)
 SELECT doc_id, coalesce(nullif(trim({O.plain('h', 100)}, ' .-|•'), ''), 'New feed item') AS title FROM g"""


@query("p14_forum_title", P14_SQL)
def p14(spark, sf_dir):
    return B.read(spark, sf_dir, "documents").select(
        "doc_id", X.forum_title(F.expr(P14_SPARK)).alias("title")
    )


P20_TAIL = (" see https://a.example.com/x?y=1, HTTPS://A.example.com/X?Y=1 (https://b.example.org/p). "
            "http://plain.example.com https://u:p@c.example.com/z https://d.example.com/")
P20_URLS = f"regexp_extract_all(text || '{P20_TAIL}' || CAST(conv_id AS VARCHAR), '(?i)https?://[^\\s<>\\[\\]{{}}\"'']+')"


@query(
    "p20_extract_urls",
    f"""WITH u AS (SELECT conv_id, turn, list_filter(list_transform({P20_URLS},
      lambda u: regexp_replace(u, '[.,;:!?)\\]}}]+$', '')),
      lambda u: {O.safe_link('u')} <> '' AND lower({O.piece('u', 1)}) = 'https') AS urls FROM conversations)
    SELECT conv_id, turn, array_to_string(list_filter(urls,
      lambda u, i: list_position(list_transform(urls, lambda x: lower(x)), lower(u)) = i), ' ') AS urls FROM u""",
)
def p20(spark, sf_dir):
    text = F.concat(F.col("text"), F.lit(P20_TAIL), F.col("conv_id").cast("string"))
    return B.read(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.array_join(U.extract_article_urls(text), " ").alias("urls")
    )


@query(
    "p21_parse_time",
    """SELECT event_id, CASE event_id % 6 WHEN 5 THEN NULL WHEN 3 THEN epoch_us(date_trunc('day', ts))
       WHEN 0 THEN epoch_us(ts) ELSE epoch_us(date_trunc('second', ts)) END AS parsed_us FROM events""",
)
def p21(spark, sf_dir):
    ts = F.col("ts")
    mail = F.date_format(ts, "dd MMM yyyy HH:mm:ss")
    text = (
        F.when(F.col("event_id") % 6 == 0, C.iso_text(ts))
        .when(F.col("event_id") % 6 == 1, F.concat(F.date_format(ts, "E, "), mail, F.lit(" GMT")))
        .when(F.col("event_id") % 6 == 2, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .when(F.col("event_id") % 6 == 3, F.date_format(ts, "yyyy-MM-dd"))
        .when(F.col("event_id") % 6 == 4, F.concat(
            F.date_format(ts + F.expr("INTERVAL 2 HOURS"), "d MMM yyyy HH:mm:ss"), F.lit(" +0200")))
        .otherwise(F.lit("not a date"))
    )
    return B.read(spark, sf_dir, "events").select(
        "event_id", F.unix_micros(C.parse_time(text)).alias("parsed_us")
    )


@query(
    "p22_update_detail",
    f"""WITH {B.ITEMS_CTE}, v AS (SELECT article_id, {O.plain('title', 500)} AS head,
      {O.plain("CASE WHEN article_id % 9 = 0 THEN upper(title) || '!' ELSE summary END", 500)} AS d FROM items),
    a AS (SELECT *, {O.squash(O.fold('d'))} AS low FROM v),
    b AS MATERIALIZED (SELECT *, {O.ascii_words('low')} AS asc_low, regexp_extract_all(low, '[a-z0-9]+') AS w FROM a)
    SELECT article_id, CASE WHEN d = '' OR {O.artifacts('low', 'asc_low', 'w')}
      OR {O.compared('d')} = {O.compared('head')} THEN '' ELSE d END AS detail FROM b""",
)
def p22(spark, sf_dir):
    body = F.when(
        F.col("article_id") % 9 == 0, F.concat(F.upper("title"), F.lit("!"))
    ).otherwise(F.col("summary"))
    return B.items(spark, sf_dir).select(
        "article_id", X.story_update_detail(F.col("title"), body).alias("detail")
    )


@query(
    "p23_repeats_reference",
    f"""WITH {B.ITEMS_CTE}, v AS (SELECT article_id, {O.compared('title')} AS a,
      {O.compared("substring(summary, 1, length(title) + (article_id % 4) * 10)")} AS b FROM items),
    w AS (SELECT *, {O.content_words('a')} AS wa, {O.content_words('b')} AS wb FROM v)
    SELECT article_id, a = '' OR {O.overlap_redundant('a', 'wa', 'b', 'wb')} AS repeats FROM w""",
)
def p23(spark, sf_dir):
    ref = F.substring(
        F.col("summary"), F.lit(1), (F.length("title") + (F.col("article_id") % 4) * 10).cast("int")
    )
    return B.items(spark, sf_dir).select(
        "article_id", X.repeats_reference(F.col("title"), ref).alias("repeats")
    )


def analyses(spark, sf_dir):
    """Analysis texts made of whole documents: first line, the other lines as facts, citations."""
    first = F.substring_index("text", "\n", 1)
    rest = F.substring(F.col("text"), F.length(first) + 2, F.length("text"))
    outlet = F.concat(F.lit("https://a.example/"), F.col("doc_id").cast("string"))
    return B.read(spark, sf_dir, "documents").select(
        "doc_id",
        F.substring(first, 1, 40).alias("title"),
        F.concat(
            first, F.lit("\n**Key facts:**\n- "), F.replace(rest, F.lit("\n"), F.lit("\n- ")),
            F.lit("\n\nUseful context\n* "), F.substring(F.col("text"), 30, 90),
            F.lit("\n**Unclear or disputed**\nIt is not known who was there.\n"),
            F.lit("**Sources**\n- [Outlet  one]("), outlet, F.lit(")\n- [Outlet  one]("), outlet,
            F.lit(")\n- [Two](http://b.example/2)\nnoise"),
        ).alias("analysis"),
    )


ANALYSES_CTE = """analyses AS (SELECT doc_id, substring(first, 1, 40) AS title,
   first || chr(10) || '**Key facts:**' || chr(10) || '- ' || replace(substring(text, length(first) + 2), chr(10), chr(10) || '- ')
   || chr(10) || chr(10) || 'Useful context' || chr(10) || '* ' || substring(text, 30, 90)
   || chr(10) || '**Unclear or disputed**' || chr(10) || 'It is not known who was there.' AS body
   FROM (SELECT *, string_split(text, chr(10))[1] AS first FROM documents))"""
# The same selection, relationally: lines, governing headings, pairwise comparison with earlier lines.
LINES_CTE = f"""lines AS (SELECT doc_id, title, generate_subscripts(ls, 1) AS i, unnest(ls) AS s FROM (
   SELECT doc_id, title, list_transform(string_split(body, chr(10)),
     lambda x: regexp_replace(x, '^{O.RE2_SPACE}+|{O.RE2_SPACE}+$', '', 'g')) AS ls FROM analyses)),
 named AS (SELECT *, CASE lower(regexp_replace(replace(s, '*', ''), ':$', ''))
     WHEN 'summary' THEN 'Summary' WHEN 'key facts' THEN 'Key facts' WHEN 'useful context' THEN 'Context'
     WHEN 'context' THEN 'Context' WHEN 'unclear or disputed' THEN 'Unclear or disputed' END AS h FROM lines),
 placed AS (SELECT *, coalesce(last_value(h IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i), 'Summary') AS heading
   FROM named),
 stated AS (SELECT doc_id, title, i, heading, s,
     regexp_replace(regexp_replace(s, '^[-*•]{O.RE2_SPACE}+', ''), '^{O.RE2_SPACE}+|{O.RE2_SPACE}+$', '', 'g') AS c
   FROM placed WHERE h IS NULL AND s <> ''),
 marked AS (SELECT *, {O.compared('c')} AS t FROM stated),
 worded AS (SELECT *, {O.content_words('t')} AS w FROM marked),
 refs AS (SELECT doc_id, i, t, w FROM worded UNION ALL
   SELECT doc_id, 0, t, {O.content_words('t')} FROM (SELECT doc_id, {O.compared('title')} AS t FROM analyses)),
 firsts AS (SELECT doc_id, word, min(i) AS i FROM (SELECT doc_id, i, unnest(w) AS word FROM refs) GROUP BY ALL),
 novelty AS (SELECT a.doc_id, a.i, count(*) FILTER (WHERE f.i = a.i) AS novel, count(*) AS n
   FROM (SELECT doc_id, i, unnest(w) AS word FROM worded) a JOIN firsts f USING (doc_id, word) GROUP BY ALL),
 repeated AS (SELECT DISTINCT a.doc_id, a.i FROM worded a JOIN refs b ON a.doc_id = b.doc_id AND b.i < a.i
   WHERE {O.overlap_redundant('a.t', 'a.w', 'b.t', 'b.w')}),
 kept AS (SELECT w.doc_id, w.i, w.heading, w.c,
     CASE WHEN regexp_matches(w.s, '^[-*•] ') THEN '- ' || w.c ELSE w.c END AS line
   FROM worded w LEFT JOIN novelty n USING (doc_id, i) LEFT JOIN repeated r ON r.doc_id = w.doc_id AND r.i = w.i
   WHERE w.t <> '' AND r.i IS NULL AND NOT (w.heading <> 'Summary' AND coalesce(n.n, 0) >= 4
     AND n.n - n.novel >= 3 AND (n.novel <= 2 OR n.novel <= 0.18 * n.n)))"""
KEPT_CTE = f"{ANALYSES_CTE},\n {LINES_CTE}"


def kept(spark, sf_dir):
    return with_kept_lines(analyses(spark, sf_dir), "doc_id", "analysis", "title").select("doc_id", "title", "kept")


@query(
    "p24_analysis_sections",
    f"""WITH {KEPT_CTE}
    SELECT doc_id, coalesce(string_agg(c, ' ' ORDER BY i) FILTER (WHERE heading = 'Summary'), '') AS summary,
      coalesce(string_agg(c, '|' ORDER BY i) FILTER (WHERE heading = 'Key facts'), '') AS key_facts,
      coalesce(string_agg(c, '|' ORDER BY i) FILTER (WHERE heading = 'Context'), '') AS context,
      coalesce(string_agg(c, '|' ORDER BY i) FILTER (WHERE heading = 'Unclear or disputed'), '') AS uncertainty
    FROM kept GROUP BY doc_id""",
)
def p24(spark, sf_dir):
    s = kept(spark, sf_dir).select("doc_id", A.analysis_sections(F.col("kept")).alias("s"))
    return s.select(
        "doc_id", "s.summary", F.array_join("s.key_facts", "|").alias("key_facts"),
        F.array_join("s.context", "|").alias("context"),
        F.array_join("s.uncertainty", "|").alias("uncertainty"),
    )


@query(
    "p24_analysis_sources",
    """SELECT doc_id, 1 AS pos, 'Outlet one' AS label, 'https://a.example/' || CAST(doc_id AS VARCHAR) AS url FROM documents
    UNION ALL SELECT doc_id, 2, 'Two', 'http://b.example/2' FROM documents""",
)
def p24_sources(spark, sf_dir):
    return A.analysis_sources(analyses(spark, sf_dir), "doc_id", "analysis")


BODY_CTE = """opened AS (SELECT *, heading IS DISTINCT FROM lag(heading) OVER (PARTITION BY doc_id ORDER BY i) AS opens,
      row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n FROM kept),
 bodies AS (SELECT doc_id, string_agg(CASE WHEN opens THEN CASE WHEN n = 1 THEN '' ELSE chr(10) || chr(10) END
      || '**' || heading || '**' || chr(10) || chr(10) || line ELSE chr(10) || line END, '' ORDER BY i) AS body
    FROM opened GROUP BY doc_id)"""


@query("p25_deduplicate_sections", f"WITH {KEPT_CTE}, {BODY_CTE} SELECT doc_id, body FROM bodies")
def p25(spark, sf_dir):
    return kept(spark, sf_dir).select("doc_id", A.analysis_body(F.col("kept")).alias("body"))


@query(
    "p26_complete_excerpt",
    f"""WITH v AS (SELECT doc_id, {O.plain('text', 2000)} AS c FROM documents),
    s AS (SELECT doc_id, c, string_split(regexp_replace(c, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS ps FROM v),
    r AS (SELECT doc_id, c, ps, len(list_filter(range(1, len(ps) + 1),
       lambda i: length(array_to_string(ps[1:i], ' ')) <= 300)) AS k FROM s),
    h AS (SELECT *, regexp_replace(regexp_replace(substring(ps[1], 1, 300), ' [^ ]*$', ''), '[,;:]+$', '') AS head FROM r)
    SELECT doc_id, CASE WHEN length(c) <= 300 THEN c WHEN length(ps[1]) > 300
      THEN CASE WHEN head <> '' THEN head || '.' ELSE ps[1] END
      ELSE array_to_string(ps[1:k], ' ') END AS excerpt FROM h""",
)
def p26(spark, sf_dir):
    return B.read(spark, sf_dir, "documents").select(
        "doc_id", X.complete_excerpt(F.col("text"), 300).alias("excerpt")
    )


@query(
    "p27_cursor_codec",
    """WITH p AS (SELECT event_id, ts, '["' || strftime(ts, '%Y-%m-%dT%H:%M:%S') ||
        CASE WHEN epoch_us(ts) % 1000000 = 0 THEN '' ELSE '.' || lpad(CAST(epoch_us(ts) % 1000000 AS VARCHAR), 6, '0') END
        || '+00:00",' || CAST(event_id AS VARCHAR) || ']' AS payload FROM events)
    SELECT event_id, translate(replace(base64(encode(payload)), '=', ''), '+/', '-_') AS page_cursor,
      CASE WHEN event_id >= 1 THEN epoch_us(ts) END AS decoded_us,
      CASE WHEN event_id >= 1 THEN event_id END AS decoded_id,
      CASE WHEN event_id < 1 THEN 'invalid cursor' END AS error FROM p""",
)
def p27(spark, sf_dir):
    coded = B.read(spark, sf_dir, "events").select(
        "event_id", C.encode_cursor(F.col("ts"), F.col("event_id")).alias("page_cursor")
    )
    return coded.withColumn("d", C.decode_cursor(F.col("page_cursor"))).select(
        "event_id", "page_cursor", F.unix_micros("d.ts").alias("decoded_us"),
        F.col("d.id").alias("decoded_id"), F.col("d.error").alias("error"),
    )


# --- fallback summaries -----------------------------------------------------------------
def sent_sql(x: str) -> str:
    """Sentence ends turned into a separator byte."""
    return f"regexp_replace({x}, '([.!?])[\"”’]?{O.RE2_SPACE}+', '\\1' || chr(1), 'g')"


def _dateline(x: str) -> str:
    pat = "(?is)^.*?\\((?:" + "|".join(fixed.WIRE_AGENCIES) + ")\\)\\s*[-–—]{1,2}\\s*"
    m = f"regexp_extract(substring({x}, 1, 500), '{pat}', 0)"
    tail = f"trim(substring({x}, length({m}) + 1))"
    return f"CASE WHEN {m} <> '' AND length({tail}) >= 35 THEN {tail} ELSE {x} END"


FALLBACK_SPARK = (
    "CASE article_id % 6 WHEN 0 THEN concat('LONDON, Jan 5 (Reuters) - ', summary) "
    "WHEN 1 THEN concat('https://x.example/a [1] **', summary) "
    "WHEN 2 THEN concat('Exclusive: ', title, ' - ', summary) "
    "WHEN 3 THEN lower(summary) WHEN 4 THEN concat(summary, ' Sign up for more.') ELSE summary END"
)
FALLBACK_SQL = (
    "CASE article_id % 6 WHEN 0 THEN 'LONDON, Jan 5 (Reuters) - ' || summary "
    "WHEN 1 THEN 'https://x.example/a [1] **' || summary "
    "WHEN 2 THEN 'Exclusive: ' || title || ' - ' || summary "
    "WHEN 3 THEN lower(summary) WHEN 4 THEN summary || ' Sign up for more.' ELSE summary END"
)
FALLBACK_CTE = f"""{B.ITEMS_CTE},
 fb0 AS (SELECT article_id, story_id, title, {FALLBACK_SQL} AS raw FROM items),
 fb1 AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(raw, 'https?://[^\\s]+', ' ', 'g'),
     '\\[(?:\\d+|[^\\]]{{1,80}})\\]', ' ', 'g'), '[*_#>`]+', ' ', 'g') AS a FROM fb0),
 fb2 AS (SELECT *, regexp_replace(regexp_replace(a, '(?i)^[^\\n]*?\\(Reuters\\)\\s*[-–—]\\s*', ''),
     '(?:^|{O.RE2_SPACE})[-•]{O.RE2_SPACE}+', '. ', 'g') AS b FROM fb1),
 fb3 AS (SELECT *, regexp_replace(regexp_replace(b, '{O.RE2_SPACE}+', ' ', 'g'), '^[ .]+|[ .]+$', '', 'g') AS c FROM fb2),
 fb4 AS (SELECT *, {_dateline('c')} AS d,
     trim(regexp_replace(regexp_replace(translate(title, '‘’', ''''''), '(?i)^(?:analysis|exclusive|watch):\\s*', ''),
       '(?i)\\s*[-|]\\s*(?:ap|associated press|reuters|reuters\\.com)\\s*$', '')) AS r FROM fb3),
 fb5 AS (SELECT *, strpos({O.fold("translate(d, '‘’', '''''')")}, {O.fold('r')}) AS found_at FROM fb4),
 fb6 AS (SELECT *, regexp_replace(regexp_replace(substring(translate(d, '‘’', ''''''), found_at + length(r)),
     '^[ :\\-]+', ''), '(?i)^(?:exclusive|report)\\s+', '') AS tail FROM fb5),
 fb7 AS MATERIALIZED (SELECT article_id, story_id, title, CASE WHEN length(r) >= 24 AND found_at > 0 AND length(tail) >= 35 THEN tail ELSE d END AS t FROM fb6),
 fb8 AS (SELECT *, {O.squash(O.fold('t'))} AS low, string_split({sent_sql('t')}, chr(1)) AS parts FROM fb7),
 fb9 AS MATERIALIZED (SELECT *, {O.ascii_words('low')} AS asc_low, regexp_extract_all(low, '[a-z0-9]+') AS w,
     CASE WHEN NOT regexp_matches(t, '^\\p{{Ll}}') THEN t WHEN len(parts) >= 2
       THEN trim(substring(t, length(regexp_extract(t, '^(?s)(.*?[.!?])["”’]?{O.RE2_SPACE}+', 0)) + 1)) END AS o FROM fb8),
 fb10 AS (SELECT *, CASE WHEN o <> '' AND NOT regexp_matches(o, '^\\p{{Ll}}')
     AND NOT {O.artifacts('low', 'asc_low', 'w')} AND NOT {O.any_of(O.fold('o'), fixed.FALLBACK_REJECT_MARKERS)}
     THEN o END AS u FROM fb9),
 fb11 AS (SELECT article_id, story_id, title, u, {O.compared('title')} AS tt,
     list_transform(string_split({sent_sql('u')}, chr(1)), lambda s: trim(s)) AS ss FROM fb10),
 fb12 AS MATERIALIZED (SELECT *, {O.content_words('tt')} AS tw FROM fb11),
 fb13 AS (SELECT article_id, story_id, u, list_filter(ss, lambda s: length(s) >= 35 AND {O.compared('s')} <> ''
     AND NOT {O.overlap_redundant(O.compared('s'), O.content_words(O.compared('s')), 'tt', 'tw')})[1:2] AS ks FROM fb12),
 fb14 AS (SELECT article_id, story_id, u, array_to_string(ks, ' ') AS j FROM fb13),
 fb15 AS MATERIALIZED (SELECT article_id, story_id, u, CASE WHEN j <> '' AND NOT regexp_matches(j, '[.!?]$') THEN j || '.' ELSE j END AS j FROM fb14),
 fb16 AS (SELECT *, {_dateline("regexp_replace(" + O.squash("translate(j, '—–', '--')") + ", '\\.{2,}', '.', 'g')")} AS k FROM fb15),
 fb17 AS (SELECT article_id, story_id, u, {O.mentions("trim(k)")} AS k FROM fb16),
 fb18 AS (SELECT *, {O.squash(O.fold('k'))} AS low FROM fb17),
 fb19 AS MATERIALIZED (SELECT *, {O.ascii_words('low')} AS asc_low, regexp_extract_all(low, '[a-z0-9]+') AS w FROM fb18),
 fallback AS (SELECT article_id, story_id, CASE WHEN u IS NOT NULL AND k <> '' AND length(k) <= 800
     AND NOT {O.artifacts('low', 'asc_low', 'w')}
     AND NOT {O.any_of('low', fixed.CANNED_MODEL_PHRASES + fixed.PROCESS_PHRASES)} THEN k END AS summary FROM fb19)"""


def fallback(spark, sf_dir):
    items = B.items(spark, sf_dir).select("article_id", "story_id", "title", F.expr(FALLBACK_SPARK).alias("raw"))
    return X.with_fallback(items, "summary", F.col("raw"), F.col("title")).select("article_id", "story_id", "summary")


@query("p32_fallback_cleaning", f"WITH {FALLBACK_CTE} SELECT article_id, summary FROM fallback")
def p32(spark, sf_dir):
    return fallback(spark, sf_dir).select("article_id", "summary")


QUALITY_SQL = """(least(length(summary), 600) + CASE WHEN regexp_matches(summary, '[.!?]$') THEN 120 ELSE -180 END
 + CASE WHEN contains(summary, '...') OR contains(summary, '…') THEN -400 ELSE 0 END)"""


@query(
    "p33_best_fallback",
    f"""WITH {FALLBACK_CTE}, q AS (SELECT *, {QUALITY_SQL} AS quality FROM fallback WHERE summary IS NOT NULL)
    SELECT story_id, article_id, quality, summary FROM q
    QUALIFY row_number() OVER (PARTITION BY story_id ORDER BY quality DESC, article_id) = 1""",
)
def p33(spark, sf_dir):
    # max_by combines before the shuffle, so a story with most of the rows is no hot spot.
    best = fallback(spark, sf_dir).groupBy("story_id").agg(
        F.max(
            X.let(
                F.col("summary"),
                lambda s: F.when(
                    s.isNotNull(),
                    F.struct(
                        X.fallback_quality(s).alias("quality"),
                        (-F.col("article_id")).alias("back"),
                        F.col("article_id").alias("article_id"),
                        s.alias("summary"),
                    ),
                ),
            )
        ).alias("b")
    )
    return best.filter("b IS NOT NULL").select("story_id", "b.article_id", "b.quality", "b.summary")


WORDS_SQL = "len(regexp_extract_all({x}, '[\\p{{L}}\\p{{N}}_](?:[\\p{{L}}\\p{{N}}_''-]*[\\p{{L}}\\p{{N}}_])?'))"


@query(
    "p34_needs_web_evidence",
    f"""WITH {B.ITEMS_CTE}, v AS (SELECT story_id, article_id, trim(summary) AS d, {O.compared('summary')} AS a,
      {O.compared('title')} AS b, {O.squash(O.fold('summary'))} AS low FROM items),
    x AS MATERIALIZED (SELECT *, {O.ascii_words('low')} AS asc_low, regexp_extract_all(low, '[a-z0-9]+') AS w,
      {O.content_words('a')} AS wa, {O.content_words('b')} AS wb FROM v),
    y AS (SELECT story_id, article_id, d, d <> '' AND NOT {O.artifacts('low', 'asc_low', 'w')}
      AND NOT (a = '' OR {O.overlap_redundant('a', 'wa', 'b', 'wb')}) AS usable FROM x),
    z AS (SELECT story_id, sum(CASE WHEN usable THEN {WORDS_SQL.format(x='d')} ELSE 0 END) AS words,
      sum(CASE WHEN usable THEN len(list_filter(string_split({sent_sql('d')}, chr(1)), lambda s: trim(s) <> ''))
          - CASE WHEN regexp_matches(d, '[.!?]["”’]?$') THEN 0 ELSE 1 END ELSE 0 END) AS ended,
      arg_max(CASE WHEN regexp_matches(d, '[.!?]["”’]?$') THEN 0 ELSE 1 END, article_id) FILTER (WHERE usable) AS open_end
      FROM y GROUP BY story_id)
    SELECT story_id, CAST(words AS BIGINT) AS words, words < 45 OR ended + coalesce(open_end, 0) < 3 AS needs_evidence FROM z""",
)
def p34(spark, sf_dir):
    return needs_web_evidence(B.items(spark, sf_dir))


def needs_web_evidence(articles: DataFrame) -> DataFrame:
    """Per story: too few words or sentences in its usable descriptions?

    Descriptions are never concatenated: words and sentence ends add up, and only the last
    description can leave one more sentence open, so partial aggregation carries three numbers.
    """
    d = X.strip_space(F.col("summary"))
    usable = (
        (d != "")
        & ~X.source_artifacts(F.col("summary"))
        & ~X.repeats_reference(F.col("summary"), F.col("title"))
    )
    open_end = (~d.rlike("[.!?][\"”’]?$")).cast("int")
    parts = F.size(F.filter(X.sentences(d), lambda s: s != ""))
    per = articles.select("story_id", "article_id", "summary", usable.alias("usable"))
    usable = F.col("usable")
    per = per.select(
        "story_id", "article_id",
        F.when(usable, X.word_count(d)).otherwise(0).alias("words"),
        F.when(usable, parts - open_end).otherwise(0).alias("ended"),
        F.when(usable, open_end).alias("open_end"),
    )
    total = per.groupBy("story_id").agg(
        F.sum("words").alias("words"),
        F.sum("ended").alias("ended"),
        F.max_by("open_end", F.when(F.col("open_end").isNotNull(), F.col("article_id"))).alias("open_end"),
    )
    few = (F.col("words") < 45) | (F.col("ended") + F.coalesce("open_end", F.lit(0)) < 3)
    return total.select("story_id", "words", few.alias("needs_evidence"))


@query(
    "p35_claim_limit",
    f"""SELECT conv_id, turn, CAST(greatest(1, least(5, len(list_filter(
      string_split_regex(text, '(?:[.!?]+{O.RE2_SPACE}+)|\\n+'),
      lambda p: len(string_split({O.squash('p')}, ' ')) >= 3)))) AS INTEGER) AS claims FROM conversations""",
)
def p35(spark, sf_dir):
    return B.read(spark, sf_dir, "conversations").select(
        "conv_id", "turn", X.claim_limit(F.col("text")).alias("claims")
    )


@query(
    "p36_render_analysis",
    f"""WITH {KEPT_CTE}, r AS (SELECT doc_id,
      coalesce(string_agg(c, ' ' ORDER BY i) FILTER (WHERE heading = 'Summary'), '') AS summary,
      string_agg('- ' || c, chr(10) ORDER BY i) FILTER (WHERE heading = 'Key facts') AS f,
      string_agg('- ' || c, chr(10) ORDER BY i) FILTER (WHERE heading = 'Context') AS x,
      string_agg('- ' || c, chr(10) ORDER BY i) FILTER (WHERE heading = 'Unclear or disputed') AS u
      FROM kept GROUP BY doc_id)
    SELECT doc_id, '**Summary**' || chr(10) || summary
      || coalesce(chr(10) || chr(10) || '**Key facts**' || chr(10) || f, '')
      || coalesce(chr(10) || chr(10) || '**Context**' || chr(10) || x, '')
      || coalesce(chr(10) || chr(10) || '**Unclear or disputed**' || chr(10) || u, '') AS rendered FROM r""",
)
def p36(spark, sf_dir):
    s = kept(spark, sf_dir).select("doc_id", A.analysis_sections(F.col("kept")).alias("s"))
    return s.select(
        "doc_id",
        A.render_analysis(
            F.col("s.summary"), F.col("s.key_facts"), F.col("s.context"), F.col("s.uncertainty")
        ).alias("rendered"),
    )


@query(
    "p37_fallback_article_summary",
    f"""WITH {FALLBACK_CTE} SELECT story_id, article_id, '**Summary**' || chr(10) || summary AS rendered
    FROM fallback WHERE summary IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY story_id ORDER BY article_id) = 1""",
)
def p37(spark, sf_dir):
    best = fallback(spark, sf_dir).groupBy("story_id").agg(
        F.min(
            X.let(
                F.col("summary"),
                lambda s: F.when(s.isNotNull(), F.struct(F.col("article_id"), s.alias("summary"))),
            )
        ).alias("b")
    )
    return best.filter("b IS NOT NULL").select(
        "story_id", "b.article_id", F.concat(F.lit("**Summary**\n"), "b.summary").alias("rendered")
    )


@query(
    "p38_strip_emoji",
    """SELECT conv_id, turn, regexp_replace(regexp_replace('☀ ' || text || ' 🚀🇺🇸 done',
       '[\\x{1F1E6}-\\x{1F1FF}\\x{1F300}-\\x{1FAFF}\\x{2600}-\\x{27BF}]', '', 'g'), '^\\s+|\\s+$', '', 'g') AS clean
       FROM conversations""",
)
def p38(spark, sf_dir):
    text = F.concat(F.lit("☀ "), F.col("text"), F.lit(" 🚀🇺🇸 done"))
    return B.read(spark, sf_dir, "conversations").select(
        "conv_id", "turn", X.strip_emoji(text).alias("clean")
    )


@query(
    "p39_url_label",
    f"""WITH v AS (SELECT page_id, coalesce(nullif(regexp_replace({O.host('url')}, '^www\\.', ''), ''), 'Article') AS h,
      translate(regexp_extract(rtrim({O.piece('url', 3)}, '/'), '([^/]*)$', 1), '-_', '  ') AS l FROM pages)
    SELECT page_id, {O.plain("(CASE WHEN l = '' THEN h ELSE h || ': ' || l END)", 100)} AS label FROM v""",
)
def p39(spark, sf_dir):
    return B.read(spark, sf_dir, "pages").select("page_id", U.url_label(F.col("url")).alias("label"))


@query(
    "p28_weekly_period",
    f"""WITH l AS (SELECT event_id, timezone('{B.ZONE}', timezone('UTC', ts)) AS local FROM events),
    d AS (SELECT event_id, CAST(local AS DATE) - CAST((isodow(local) - 1 - {(B.WEEKDAY + 1) % 7} + 7) % 7 AS INTEGER) AS day0 FROM l)
    SELECT event_id, epoch_us(timezone('{B.ZONE}', CAST(day0 AS TIMESTAMP))) AS week_start_us,
      epoch_us(timezone('{B.ZONE}', CAST(day0 + 6 AS TIMESTAMP) + INTERVAL {B.HOUR} HOUR)) AS scheduled_us FROM d""",
)
def p28(spark, sf_dir):
    ts = F.col("ts")
    return B.read(spark, sf_dir, "events").select(
        "event_id",
        F.unix_micros(C.week_start(ts, B.ZONE, B.WEEKDAY)).alias("week_start_us"),
        F.unix_micros(C.week_scheduled(ts, B.ZONE, B.WEEKDAY, B.HOUR)).alias("scheduled_us"),
    )


@query(
    "p29_retry_backoff",
    f"""WITH {B.ITEMS_CTE}, {B.FEEDS_CTE} SELECT feed_id,
    CAST(least(interval_seconds * CAST(pow(2, least(failure_count + 1, 8)) AS BIGINT), 86400) AS BIGINT) AS delay FROM feeds""",
)
def p29(spark, sf_dir):
    return B.feeds(spark, sf_dir).select(
        "feed_id",
        C.retry_delay(F.col("interval_seconds"), F.col("failure_count")).cast("bigint").alias("delay"),
    )


def first_by(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """First row per key; the rank filter lets Spark drop rows before the shuffle."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_r", rank).filter("_r = 1").drop("_r")
