"""RSS and Atom documents → items, with Spark's XML reader."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from storyline.functions.clock import parse_time
from storyline.functions.text import plain_text
from storyline.functions.urls import safe_external_link

MEDIA = "array<struct<_url:string,_medium:string,_type:string,_href:string>>"
ENTRY = (
    "guid:string,id:string,`_rdf:about`:string,title:string,link:array<struct<_href:string,_rel:string,_VALUE:string>>,"
    "description:string,summary:string,content:string,`content:encoded`:string,"
    "pubDate:string,published:string,`dcterms:issued`:string,updated:string,`dc:date`:string,`dcterms:modified`:string,"
    "created:string,`dcterms:created`:string,author:array<struct<name:string,_VALUE:string>>,`dc:creator`:array<string>,"
    f"`media:thumbnail`:{MEDIA},`media:content`:{MEDIA},enclosure:{MEDIA},"
    f"`media:group`:array<struct<`media:thumbnail`:{MEDIA},`media:content`:{MEDIA}>>"
)
#: RSS keeps its items in the channel, RDF beside it; Atom has entries.
DOCUMENT = (
    f"struct<channel:struct<title:string,item:array<struct<{ENTRY}>>>,item:array<struct<{ENTRY}>>,"
    f"title:string,entry:array<struct<{ENTRY}>>,_broken:string>"
)


def _image(e: Column) -> Column:
    """First safe link among thumbnails, image media and image enclosures."""
    def urls(values, keep):
        picked = F.filter(F.coalesce(values, F.array().cast(MEDIA)), keep)
        return F.transform(picked, lambda m: F.coalesce(m["_href"], m["_url"], F.lit("")))

    def of(name):
        grouped = F.flatten(F.transform(e["media:group"], lambda g: F.coalesce(g[name], F.array().cast(MEDIA))))
        empty = F.array().cast(MEDIA)
        return F.concat(F.coalesce(e[name], empty), F.coalesce(grouped, empty))

    every = F.concat(
        urls(of("media:thumbnail"), lambda m: F.lit(True)),
        urls(of("media:content"), lambda m: (F.lower(m["_medium"]) == "image") | F.coalesce(m["_type"].startswith("image/"), F.lit(False))),
        urls(e["enclosure"], lambda m: F.coalesce(m["_type"].startswith("image/"), F.lit(False))),
    )
    return F.get(F.filter(F.transform(every, safe_external_link), lambda u: u != ""), F.lit(0))


def _filled(*cols: Column) -> Column:
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols])


def _parsed(documents: DataFrame) -> DataFrame:
    read = F.from_xml("xml", DOCUMENT, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"})
    parsed = documents.select("document_id", read.alias("d"))
    return parsed.withColumn("entries", F.coalesce("d.channel.item", "d.item", "d.entry"))


def rejected_feeds(documents: DataFrame) -> DataFrame:
    """Documents (document_id) that are no well-formed XML and gave no entry."""
    empty = F.coalesce(F.size("entries"), F.lit(0)) <= 0
    return _parsed(documents).filter(empty & (F.col("d").isNull() | F.col("d._broken").isNotNull())).select("document_id")


def _link(links: Column) -> Column:
    """The alternate link of an entry, else its first one."""
    given = F.transform(links, lambda x: F.struct(F.coalesce(x["_href"], x["_VALUE"]).alias("to"), F.coalesce(x["_rel"], F.lit("alternate")).alias("rel")))
    given = F.filter(given, lambda x: x["to"].isNotNull())
    best = F.filter(given, lambda x: F.lower(x["rel"]) == "alternate")
    return F.coalesce(F.get(best, F.lit(0))["to"], F.get(given, F.lit(0))["to"], F.lit(""))


def parse_feeds(documents: DataFrame) -> DataFrame:
    """Items of feed documents (document_id, xml), numbered in reading order per document.

    Entries without title go.  When any entry is dated, dates ascend and undated ones lead;
    otherwise document order is reversed, as feeds list the newest first.
    """
    entries = _parsed(documents).select(
        "document_id",
        F.coalesce("d.channel.title", "d.title").alias("feed_title"),
        F.posexplode("entries").alias("pos", "e"),
    )
    e = F.col("e")
    link = _link(e["link"])
    writer = F.get(e["author"], F.lit(0))
    raw = entries.select(
        "document_id", "feed_title", "pos",
        plain_text(F.coalesce(e["title"], F.lit("")), 500).alias("title"),
        safe_external_link(F.trim(link)).alias("url"),
        _filled(e["summary"], e["description"], e["content"], e["content:encoded"]).alias("summary"),
        _filled(e["pubDate"], e["published"], e["dcterms:issued"]).alias("published"),
        F.coalesce(
            *[parse_time(e[x]) for x in (
                "pubDate", "published", "dcterms:issued", "updated", "dc:date", "dcterms:modified", "created", "dcterms:created"
            )]
        ).alias("published_at"),
        _filled(e["guid"], e["id"], e["_rdf:about"]).alias("given_id"),
        _filled(F.trim(writer["name"]), F.trim(writer["_VALUE"]), F.get(e["dc:creator"], F.lit(0)), F.col("feed_title")).alias("author"),
        _image(e).alias("image_url"),
    ).filter("title <> ''")
    summary = F.coalesce("summary", "title")
    digest = F.sha2(F.concat_ws("\n", "title", F.coalesce("published", F.lit("")), summary), 256)
    identity = F.coalesce(
        "given_id", F.nullif(F.col("url"), F.lit("")), F.concat(F.lit("sha256:"), digest)
    )
    # One feed document is at most a few megabytes; the window spans one document.
    doc = W.partitionBy("document_id")
    dated = F.max(F.col("published_at").isNotNull()).over(doc)
    key = F.when(F.col("dated"), F.struct(F.col("published_at").alias("t"), F.col("pos").alias("p"))).otherwise(
        F.struct(F.lit(None).cast("timestamp").alias("t"), (-F.col("pos")).alias("p"))
    )
    ordered = raw.withColumn("dated", dated).withColumn("position", F.row_number().over(doc.orderBy(key)))
    return ordered.select(
        "document_id", "position", F.substring(identity, 1, 2048).alias("external_id"), "title", "url",
        summary.alias("summary"), "author", "published_at", "image_url", F.col("feed_title").alias("publisher"),
    )


def read_feeds(spark, path: str) -> DataFrame:
    """Feed documents from files, one document per file."""
    files = spark.read.format("binaryFile").load(path)
    return parse_feeds(files.select(F.col("path").alias("document_id"), F.col("content").cast("string").alias("xml")))
