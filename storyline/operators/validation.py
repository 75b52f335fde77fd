"""Checks of already collected model responses, as columns."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyline.functions import fixed
from storyline.functions.analysis import render_analysis
from storyline.functions.text import checked_sentence, squash
from storyline.functions.urls import bare_host, safe_external_link
from storyline.session import cut_lineage

BASE_FIELDS = (
    "summary", "key_facts", "useful_context", "unclear_or_disputed", "related_story_ids", "latest_update",
)
EXTRA_FIELDS = ("publication_suitable", "publication_reason")
LIST_LIMITS = (("key_facts", 6), ("useful_context", 3), ("unclear_or_disputed", 3))
DEFAULT_REASON = "Story meets the configured public-interest standard."
CLAIM_FIELDS = ("claim", "verdict", "explanation", "source_urls")


def unfenced(col: Column) -> Column:
    """JSON text without a surrounding code fence."""
    text = F.trim(col)
    inner = F.regexp_extract(text, r"(?is)^```(?:json)?\s*(.*?)\s*```$", 1)
    return F.when(text.rlike(r"(?is)^```(?:json)?\s*.*?\s*```$"), inner).otherwise(text)


def _kind(v: Column, path: str) -> Column:
    """JSON type of a field: STRING, BIGINT, BOOLEAN, VOID, ARRAY<…>, OBJECT<…>."""
    return F.schema_of_variant(F.try_variant_get(v, path, "variant"))


def _first_error(errors: list[Column]) -> Column:
    return F.coalesce(*errors)


def _checked_list(values: Column, name: str) -> Column:
    return F.transform(values, lambda s: checked_sentence(s, name, 420))


def validate_story_responses(responses: DataFrame, candidates: DataFrame) -> DataFrame:
    """Validate story analyses (story_id, raw): text, related ids and notices, or an error.

    ``candidates`` (story_id, related_id) are the relations that were offered; others are
    dropped without refusing the response. They are many more than the ids that responses name, so both are brought together by a
    shuffle and neither is ever held whole by the driver.
    """
    v = responses.select("story_id", unfenced(F.col("raw")).alias("text")).withColumn(
        "v", F.try_parse_json("text")
    )
    keys = F.array_sort(F.json_object_keys("text"))
    shapes = [F.array(*[F.lit(k) for k in sorted(s)]) for s in (BASE_FIELDS, BASE_FIELDS + EXTRA_FIELDS)]
    shaped = v.withColumn("shape", F.coalesce((keys == shapes[0]) | (keys == shapes[1]), F.lit(False)) & F.col("v").isNotNull())

    def text_list(name):
        return F.try_variant_get(F.col("v"), f"$.{name}", "array<string>")

    strings = ("ARRAY<STRING>", "ARRAY<VOID>")
    has_extra = F.size(keys) == len(BASE_FIELDS + EXTRA_FIELDS)
    get = lambda name, kind="string": F.try_variant_get(F.col("v"), f"$.{name}", kind)
    typed = shaped.select(
        "story_id", "shape", "v",
        has_extra.alias("extra"),
        F.when(_kind(F.col("v"), "$.summary") == "STRING", get("summary")).alias("summary"),
        *[
            F.when(
                _kind(F.col("v"), f"$.{n}").isin(*strings) & (F.size(text_list(n)) <= limit), text_list(n)
            ).alias(n)
            for n, limit in LIST_LIMITS
        ],
        F.when(
            _kind(F.col("v"), "$.related_story_ids").isin("ARRAY<BIGINT>", "ARRAY<VOID>"),
            get("related_story_ids", "array<bigint>"),
        ).alias("ids"),
        _kind(F.col("v"), "$.latest_update").alias("latest_kind"),
        get("latest_update").alias("latest"),
        F.when(~has_extra, F.lit(True)).otherwise(
            F.when(_kind(F.col("v"), "$.publication_suitable") == "BOOLEAN", get("publication_suitable", "boolean"))
        ).alias("suitable"),
        F.when(~has_extra, F.lit(DEFAULT_REASON)).otherwise(
            F.when(_kind(F.col("v"), "$.publication_reason") == "STRING", get("publication_reason"))
        ).alias("reason"),
    )
    checked = typed.select(
        "story_id", "shape", "ids", "suitable", "latest_kind",
        checked_sentence(F.col("summary"), "summary", 800, opening=True).alias("s"),
        *[_checked_list(F.col(n), n).alias(n) for n, _ in LIST_LIMITS],
        checked_sentence(F.col("latest"), "latest_update", 600).alias("l"),
        checked_sentence(F.col("reason"), "publication_reason", 240).alias("r"),
    )

    def list_error(name):
        return F.when(F.col(name).isNull(), f"invalid {name}").otherwise(
            F.get(F.filter(F.transform(name, lambda x: x["error"]), lambda e: e.isNotNull()), F.lit(0))
        )

    null_latest = F.col("latest_kind") == "VOID"
    error = F.when(~F.col("shape"), "invalid object shape").otherwise(
        _first_error(
            [
                F.col("s.error"), *[list_error(n) for n, _ in LIST_LIMITS],
                F.when(F.col("ids").isNull(), "invalid related story IDs"),
                F.when(~null_latest, F.when(F.col("latest_kind") != "STRING", "invalid latest_update").otherwise(F.col("l.error"))),
                F.when(F.col("suitable").isNull(), "invalid publication suitability"),
                F.col("r.error"),
            ]
        )
    )
    lists = [F.transform(n, lambda x: x["value"]) for n, _ in LIST_LIMITS]
    # Used twice below; the checks are costly, so their result is written once.
    judged = cut_lineage(checked.withColumn("error", error).select(
        "story_id", "error", "ids", "suitable",
        render_analysis(F.col("s.value"), *lists).alias("analysis"),
        F.when(~null_latest, F.col("l.value")).alias("latest_update"),
        F.col("r.value").alias("reason"),
    ))
    known = (
        judged.filter("error IS NULL").select("story_id", F.posexplode("ids").alias("pos", "related_id"))
        .hint("merge").join(candidates.hint("merge"), ["story_id", "related_id"], "left_semi")
        .groupBy("story_id", "related_id").agg(F.min("pos").alias("pos"))
        .groupBy("story_id").agg(F.array_sort(F.collect_list(F.struct("pos", "related_id"))).alias("k"))
    )
    ok = F.col("error").isNull()
    return judged.join(known, "story_id", "left").select(
        "story_id", "error",
        *[F.when(ok, F.col(c)).alias(c) for c in ("analysis", "latest_update", "suitable", "reason")],
        F.when(ok, F.coalesce(F.transform("k", lambda x: x["related_id"]), F.array().cast("array<bigint>"))).alias("related_ids"),
    )


def validate_fact_checks(responses: DataFrame, links: DataFrame) -> DataFrame:
    """Validate fact checks (id, raw, max_claims): rows (id, error, claims).

    Every cited URL must be among ``links`` (id, url).  A response fails as a whole.
    """
    claim = "struct<claim:string,verdict:string,explanation:string,source_urls:array<string>>"
    v = responses.select("id", "max_claims", unfenced(F.col("raw")).alias("text")).withColumn("v", F.try_parse_json("text"))
    parsed = v.select(
        "id", "max_claims",
        (F.col("v").isNotNull() & F.coalesce(F.json_object_keys("text") == F.array(F.lit("claims")), F.lit(False))).alias("shape"),
        F.try_variant_get("v", "$.claims", "array<variant>").alias("raw_claims"),
        F.from_json("text", f"claims array<{claim}>")["claims"].alias("claims"),
    )
    wanted = F.array(*[F.lit(k) for k in sorted(CLAIM_FIELDS)])
    exploded = parsed.filter("shape").select(
        "id", F.posexplode("raw_claims").alias("pos", "rv"), F.col("claims").alias("cs")
    ).withColumn("c", F.get("cs", F.col("pos")))
    kinds = {k: F.schema_of_variant(F.try_variant_get("rv", f"$.{k}", "variant")) for k in CLAIM_FIELDS}
    url = F.explode_outer("c.source_urls").alias("url")
    cited = exploded.select("id", url).filter("url IS NOT NULL")
    bad_links = cited.filter(safe_external_link(F.col("url")) == "").select("id").unionByName(
        cited.join(links, ["id", "url"], "left_anti").select("id")
    ).distinct().withColumn("bad_link", F.lit(True))
    sentence = checked_sentence(F.when(kinds["claim"] == "STRING", F.col("c.claim")), "fact-check claim", 500)
    explained = checked_sentence(
        F.when(kinds["explanation"] == "STRING", F.col("c.explanation")), "fact-check explanation", 1200
    )
    per = exploded.select(
        "id", "pos", sentence.alias("s"), explained.alias("x"), "c",
        (F.array_sort(F.json_object_keys(F.to_json("rv"))) == wanted).alias("shaped"),
        kinds["source_urls"].isin("ARRAY<STRING>", "ARRAY<VOID>").alias("url_list"),
    ).select(
        "id", "pos",
        F.when(~F.coalesce("shaped", F.lit(False)), "invalid claim shape").otherwise(
            F.coalesce(
                F.col("s.error"), F.col("x.error"),
                F.when(~F.coalesce(F.col("c.verdict").isin(list(fixed.VERDICTS)), F.lit(False)), "invalid verdict"),
                F.when(~F.col("url_list") | (F.size("c.source_urls") > 4), "invalid source URLs"),
            )
        ).alias("error"),
        F.struct(
            F.col("s.value").alias("claim"), F.col("c.verdict").alias("verdict"), F.col("x.value").alias("explanation"),
            F.array_distinct("c.source_urls").alias("urls"),
        ).alias("claim"),
    )
    # A response holds at most five claims, so gathering them is bounded by its own size.
    grouped = per.groupBy("id").agg(
        F.min_by("error", F.when(F.col("error").isNotNull(), F.col("pos"))).alias("claim_error"),
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "claim"))), lambda x: x["claim"]).alias("claims"),
    )
    out = parsed.select("id", "shape", "raw_claims", "max_claims").join(grouped, "id", "left").join(bad_links, "id", "left")
    error = (
        F.when(~F.col("shape"), "invalid object shape")
        .when(F.col("raw_claims").isNull() | (F.size("raw_claims") > F.col("max_claims")), "invalid claims")
        .otherwise(F.coalesce("claim_error", F.when(F.col("bad_link"), "unverified source URL")))
    )
    return out.withColumn("error", error).select("id", "error", F.when(F.col("error").isNull(), F.col("claims")).alias("claims"))


ANNOTATION = "array<struct<type:string,url_citation:struct<url:string,title:string,content:string>>>"


def citation_evidence(annotations: Column) -> Column:
    """First 12 safe citations with title and excerpt, from annotation JSON."""
    def item(a):
        c = a["url_citation"]
        title = squash(F.coalesce(F.nullif(c["title"], F.lit("")), F.lit("Web source")))
        return F.struct(
            safe_external_link(F.coalesce(c["url"], F.lit(""))).alias("url"),
            F.substring(title, 1, 200).alias("title"),
            F.substring(squash(F.coalesce(c["content"], F.lit(""))), 1, 800).alias("excerpt"),
        )

    cited = F.filter(
        F.coalesce(F.from_json(annotations, ANNOTATION), F.array().cast(ANNOTATION)),
        lambda a: (a["type"] == "url_citation") & a["url_citation"].isNotNull(),
    )
    return F.slice(F.filter(F.transform(cited, item), lambda s: s["url"] != ""), 1, 12)


def citation_links(evidence_urls: Column) -> Column:
    """Distinct citation links in order, at most 12 (from all safe citations, not the first 12)."""
    return F.slice(F.array_distinct(evidence_urls), 1, 12)


def append_sources(analyses: DataFrame, sources: DataFrame) -> DataFrame:
    """Analysis text with its source list: (story_id, text) and sources (story_id, ord, label, url).

    Distinct by URL, first wins; the first 12 are listed.  The rank filter keeps only 12 rows
    per story and task before the shuffle.
    """
    from pyspark.sql import Window as W

    first = sources.filter("url <> ''").groupBy("story_id", "url").agg(F.min(F.struct("ord", "label")).alias("s"))
    rank = F.row_number().over(W.partitionBy("story_id").orderBy("s.ord", "url"))
    top = first.withColumn("r", rank).filter("r <= 12")
    line = F.concat(F.lit("- ["), "s.label", F.lit("]("), "url", F.lit(")"))
    lines = top.select("story_id", "r", line.alias("line")).groupBy("story_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "line"))), lambda x: x["line"]), "\n").alias("lines")
    )
    return analyses.join(lines, "story_id", "left").select(
        "story_id",
        F.when(F.col("lines").isNull(), F.col("text"))
        .otherwise(F.concat("text", F.lit("\n\n**Sources**\n"), "lines")).alias("text"),
    )


def link_label(url: Column) -> Column:
    return F.coalesce(F.nullif(bare_host(url), F.lit("")), F.lit("Web source"))
