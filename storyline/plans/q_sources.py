"""Queries of sources."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from storyline.functions.clock import iso_text
from storyline.plans import bindings as B
from storyline.plans import oracle_text as O
from storyline.plans.registry import query
from storyline.session import cut_lineage, ensure_checkpoint_dir
from storyline.sources import pages as P
from storyline.sources import rss as R
from storyline.sources import social as X
from storyline.sources.posts import PostsSource, split_posts, store_posts


def feed_documents(spark, sf_dir):
    """Feed documents of at most 20 entries, written from the documents table.

    Three kinds by chunk: dated RSS, undated RSS, Atom.  Some entries lack title, id or link.
    """
    i = F.col("article_id")

    def esc(c):
        return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))

    kind = F.floor(i / 400) % 3
    link = F.when(i % 5 == 0, F.lit("javascript:x")).otherwise(F.concat(F.lit("https://feed.example/"), i.cast("string")))
    title = F.when(i % 50 == 7, F.lit("")).otherwise(F.concat(F.lit("<title>"), esc(F.col("title")), F.lit("</title>")))
    body = esc(F.concat(F.lit("<b>"), F.col("summary"), F.lit("</b>")))
    gid = F.when(i % 4 == 0, F.lit("")).otherwise(F.concat(F.lit("<guid>guid-"), i.cast("string"), F.lit("</guid>")))
    date = F.when(kind == 0, F.concat(F.lit("<pubDate>"), F.date_format("published_at", "dd MMM yyyy HH:mm:ss"), F.lit(" GMT</pubDate>"))).otherwise(F.lit(""))
    thumb = F.when(i % 3 == 0, F.concat(F.lit('<media:thumbnail url="https://img.example/'), i.cast("string"), F.lit('.jpg"/>'))).when(
        i % 3 == 1, F.concat(F.lit('<enclosure type="image/png" url="https://enc.example/'), i.cast("string"), F.lit('.png"/>'))
    ).otherwise(F.lit('<enclosure type="audio/mpeg" url="https://enc.example/a.mp3"/>'))
    rss = F.concat(F.lit("<item>"), gid, title, F.lit("<link>"), link, F.lit("</link><description>"), body, F.lit("</description>"), date, thumb, F.lit("</item>"))
    atom = F.concat(
        F.lit("<entry>"), F.replace(F.replace(gid, F.lit("<guid>"), F.lit("<id>")), F.lit("</guid>"), F.lit("</id>")), title,
        F.lit('<link href="'), link, F.lit('"/><summary>'), body, F.lit("</summary><updated>"), iso_text(F.col("published_at")), F.lit("</updated></entry>"),
    )
    entries = B.items(spark, sf_dir).select(
        ((i % 20) * 1000000 + F.floor(i / 400)).alias("document_id"), kind.alias("kind"), "article_id",
        F.when(kind == 2, atom).otherwise(rss).alias("entry"),
    )
    joined = entries.groupBy("document_id", "kind").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("article_id", "entry"))), lambda x: x["entry"]), "").alias("body")
    )
    name = F.concat(F.lit("<title>Feed "), F.col("document_id").cast("string"), F.lit("</title>"))
    return joined.select(
        "document_id",
        F.when(F.col("kind") == 2, F.concat(F.lit('<feed xmlns="http://www.w3.org/2005/Atom">'), name, "body", F.lit("</feed>")))
        .otherwise(F.concat(F.lit('<rss xmlns:media="http://search.yahoo.com/mrss/"><channel>'), name, "body", F.lit("</channel></rss>"))).alias("xml"),
    )


FEED_CTE = f"""{B.ITEMS_CTE}, en AS (SELECT article_id AS i, (article_id % 20) * 1000000 + article_id // 400 AS document_id, (article_id // 400) % 3 AS kind, published_at,
   {O.plain('title', 500)} AS title, title AS raw_title, '<b>' || summary || '</b>' AS summary, CASE WHEN article_id % 5 = 0 THEN '' ELSE 'https://feed.example/' || CAST(article_id AS VARCHAR) END AS url FROM items WHERE article_id % 50 <> 7),
 fed AS (SELECT *, CASE kind WHEN 0 THEN date_trunc('second', published_at) WHEN 2 THEN published_at END AS ts,
   row_number() OVER (PARTITION BY document_id ORDER BY CASE kind WHEN 0 THEN epoch_us(date_trunc('second', published_at)) WHEN 2 THEN epoch_us(published_at) ELSE -i END, i) AS position,
   CASE WHEN i % 4 <> 0 THEN 'guid-' || CAST(i AS VARCHAR) WHEN url <> '' THEN url ELSE 'sha256:' || sha256(title || chr(10) ||
     CASE WHEN kind = 0 THEN strftime(published_at, '%d %b %Y %H:%M:%S') || ' GMT' ELSE '' END || chr(10) || summary) END AS external_id FROM en)"""


@query(
    "s1_feed_items",
    f"WITH {FEED_CTE} SELECT document_id, external_id, title, url, sha256(summary) AS summary_sha, 'Feed ' || CAST(document_id AS VARCHAR) AS author FROM fed",
)
def s1(spark, sf_dir):
    out = R.parse_feeds(feed_documents(spark, sf_dir))
    return out.select("document_id", "external_id", "title", "url", F.sha2("summary", 256).alias("summary_sha"), "author")


@query("s2_feed_order", f"WITH {FEED_CTE} SELECT document_id, CAST(position AS INTEGER) AS position, external_id FROM fed")
def s2(spark, sf_dir):
    return R.parse_feeds(feed_documents(spark, sf_dir)).select("document_id", "position", "external_id")


@query("s3_entry_time", f"WITH {FEED_CTE} SELECT external_id, epoch_us(ts) AS published_us FROM fed")
def s3(spark, sf_dir):
    return R.parse_feeds(feed_documents(spark, sf_dir)).select("external_id", F.unix_micros("published_at").alias("published_us"))


@query(
    "s4_entry_image",
    f"""WITH {FEED_CTE} SELECT external_id, CASE WHEN kind = 2 OR i % 3 = 2 THEN NULL WHEN i % 3 = 0 THEN 'https://img.example/' || CAST(i AS VARCHAR) || '.jpg'
      ELSE 'https://enc.example/' || CAST(i AS VARCHAR) || '.png' END AS image_url FROM fed""",
)
def s4(spark, sf_dir):
    return R.parse_feeds(feed_documents(spark, sf_dir)).select("external_id", "image_url")


POSTS_CTE = f"""posts AS (SELECT 'feed' || CAST(conv_id % 7 AS VARCHAR) AS feed, conv_id * 100 + turn AS id, CASE WHEN turn = 3 THEN '' ELSE text END AS text, turn FROM conversations),
 kept AS (SELECT * FROM posts WHERE turn <> 2)"""


def posts(spark, sf_dir):
    t = F.col("turn")
    c = B.read(spark, sf_dir, "conversations")
    body = F.struct(
        (F.col("conv_id") * 100 + t).cast("string").alias("id"), F.when(t == 3, "").otherwise(F.col("text")).alias("text"),
        F.when(t == 1, "not a date").otherwise("2024-01-05T10:00:00Z").alias("created_at"), (t == 2).alias("is_reply"),
    )
    return c.select(
        F.concat(F.lit("feed"), (F.col("conv_id") % 7).cast("string")).alias("feed"), F.lit("desk").alias("username"),
        F.lit("The Desk").alias("display_name"), F.to_json(body).alias("json"),
    )


@query(
    "s5_social_posts",
    f"""WITH {POSTS_CTE} SELECT feed, CAST(id AS VARCHAR) AS external_id, '@desk: ' || coalesce(nullif(substring({O.squash('text')}, 1, 80), ''), 'New post') AS title,
      'https://x.com/desk/status/' || CAST(id AS VARCHAR) AS url, CASE WHEN turn <> 1 THEN epoch_us(TIMESTAMP '2024-01-05 10:00:00') END AS published_us FROM kept""",
)
def s5(spark, sf_dir):
    return X.parse_posts(posts(spark, sf_dir), replies=False).select("feed", "external_id", "title", "url", F.unix_micros("published_at").alias("published_us"))


@query(
    "s6_incremental_cursor",
    f"""WITH {POSTS_CTE}, c AS (SELECT feed, max(id) AS cursor_value FROM kept WHERE turn = 0 GROUP BY feed)
    SELECT k.feed, c.cursor_value, count(*) AS newer FROM kept k JOIN c USING (feed) WHERE k.id > c.cursor_value - 500 GROUP BY ALL""",
)
def s6(spark, sf_dir):
    items = X.parse_posts(posts(spark, sf_dir), replies=False)
    known = X.cursors(items.filter(F.col("external_id").try_cast("bigint") % 100 == 0))
    back = known.select("feed", (F.col("cursor") - 500).alias("cursor"))
    return X.since(items, back).groupBy("feed").agg(F.count(F.lit(1)).alias("newer")).join(known, "feed").select(
        "feed", F.col("cursor").alias("cursor_value"), "newer"
    )


@query(
    "s6_post_stream",
    """WITH p AS (SELECT 'feed' || (conv_id % 7) AS feed, conv_id * 100 + turn AS id, CASE WHEN conv_id % 11 = 4 AND turn = 1 THEN 'broken' WHEN conv_id % 13 = 5 AND turn = 0 THEN 'no text' END AS bad,
      turn = 2 AS reply FROM conversations)
    SELECT feed, max(id) AS cursor_value, count(*) FILTER (WHERE bad IS NULL AND NOT reply) AS posts, count(*) FILTER (WHERE bad IS NOT NULL) AS rejects FROM p GROUP BY feed""",
)
def s6_stream(spark, sf_dir):
    """Posts read feed by feed beyond the highest id read before, in several micro-batches and over a restart; malformed ones apart."""
    folder = f"{ensure_checkpoint_dir(spark)}/posts-{uuid.uuid4().hex}"
    t = F.col("turn")
    body = F.struct(
        (F.col("conv_id") * 100 + t).cast("string").alias("id"), F.when((F.col("conv_id") % 13 != 5) | (t != 0), F.coalesce("text", F.lit(""))).alias("text"),
        F.lit("2024-01-05T10:00:00Z").alias("created_at"), (t == 2).alias("is_reply"),
    )
    rows = B.read(spark, sf_dir, "conversations").select(
        F.concat(F.lit("feed"), (F.col("conv_id") % 7).cast("string")).alias("feed"), (F.col("conv_id") * 100 + t).alias("id"),
        F.when((F.col("conv_id") % 11 == 4) & (t == 1), F.lit('{"id": "broken')).otherwise(F.to_json(body)).alias("json"),
    )
    spark.dataSource.register(PostsSource)
    half = rows.agg(F.expr("percentile(id, 0.5)")).first()[0]

    def each(batch, batch_id):
        batch = cut_lineage(batch)
        good, bad = split_posts(batch.withColumns({"username": F.lit("desk"), "display_name": F.lit("The Desk")}))
        items = X.parse_posts(good, replies=False).select("feed", F.col("external_id").cast("long").alias("id"), F.lit(True).alias("good"))
        items.unionByName(bad.select("feed", "id", F.lit(False).alias("good"))).write.mode("overwrite").parquet(f"{folder}/out/batch={batch_id}")
        batch.groupBy("feed").agg(F.max("id").alias("cursor")).write.mode("overwrite").parquet(f"{folder}/cursors/batch={batch_id}")

    for part in (F.col("id") <= half, F.col("id") > half):  # more posts come between two runs of the stream
        store_posts(rows.filter(part), f"{folder}/posts")
        most = int(rows.agg(F.max("id") - F.min("id")).first()[0] or 0) // 3 + 1
        query = spark.readStream.format("posts").option("path", f"{folder}/posts").option("idsPerTrigger", most).load().writeStream.foreachBatch(each)
        query = query.option("checkpointLocation", f"{folder}/checkpoint").start()
        query.processAllAvailable()
        query.stop()
    out = spark.read.parquet(f"{folder}/out").groupBy("feed").agg(F.count_if("good").alias("posts"), F.count_if(~F.col("good")).alias("rejects"))
    return spark.read.parquet(f"{folder}/cursors").groupBy("feed").agg(F.max("cursor").alias("cursor_value")).join(out, "feed", "left").select("feed", "cursor_value", "posts", "rejects")


@query("s7_page_articles")
def s7(spark, sf_dir):
    out = P.extract_pages(B.read(spark, sf_dir, "pages"))
    return out.select("page_id", "external_id", "url", "title", "summary", "publisher", F.unix_micros("published_at").alias("published_us"))


@query(
    "s8_json_ld",
    f"""SELECT page_id, 'LD ' || CAST(page_id AS VARCHAR) AS title, 'Described ' || CAST(page_id AS VARCHAR) AS summary, 'Desk' AS publisher,
      epoch_us(TIMESTAMP '2024-01-05 10:00:00') AS published_us FROM pages""",
)
def s8(spark, sf_dir):
    """Pages with a nested JSON-LD graph put before their own markup."""
    n = F.col("page_id").cast("string")
    ld = F.concat(
        F.lit('<script type="application/ld+json">not json</script><script type="application/ld+json">{"@graph":[{"@type":"WebSite","name":"x"},{"@type":["Thing","NewsArticle"],"headline":"LD '), n,
        F.lit('","description":"Described '), n, F.lit('","publisher":{"name":"Desk"},"datePublished":"2024-01-05T10:00:00Z"}]}</script>'), F.col("html"),
    )
    pages = B.read(spark, sf_dir, "pages").select("page_id", "url", ld.alias("html"))
    return P.extract_pages(pages).select("page_id", "title", "summary", "publisher", F.unix_micros("published_at").alias("published_us"))
