"""A training corpus from ``documents``: judged, freed of near copies and benchmark passages, mixed and sharded."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyline.llm.decontaminate import benchmark_hits
from storyline.llm.mixing import mix
from storyline.llm.parity_join import near_duplicates
from storyline.llm.quality import accepted
from storyline.llm.shards import place
from storyline.session import cut_lineage, ensure_checkpoint_dir

#: Boosted trees, Hamming searches and subset sums have no SQL form; tests compare with a plain version.
ORACLE_SQL = None
SHARDS = tuple(f"shard-{k:02d}" for k in range(32))
#: Ids (8 bytes each) up to which documents are picked by a broadcast; more are joined by a shuffle.
BROADCAST_IDS = 2_000_000


def _sized(ids: DataFrame) -> DataFrame:
    """``ids``, computed once, with a hint to broadcast them if they are few."""
    ids = cut_lineage(ids)
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def _free(docs: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``docs`` does not have, whatever the case."""
    used = {c.lower() for c in docs.columns}
    while name in used:
        name = f"_{name}"
    return name


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier accepts, learnt from ``labels``.

    Null and empty texts are judged like any; repeated rows and null ids are judged one by one. Without usable labels all stay.
    """
    return accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def one_per_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id; documents without an id stay.

    Rows that are equal in all columns count once. Rows of one id that differ stay, unless their id is not the smallest
    of their group: an id does not tell which of its rows belongs to which group.
    """
    found = cut_lineage(near_duplicates(docs))
    others = found.filter("doc_id <> component_id").select("doc_id").distinct()
    kept = docs.join(_sized(others), "doc_id", "left_anti")
    twice = found.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id")
    twice = cut_lineage(twice)
    if not twice.isEmpty():
        again = _sized(twice)
        once = kept.join(again, "doc_id", "left_semi").dropDuplicates()
        kept = kept.join(again, "doc_id", "left_anti").unionByName(once)
    return kept.select(docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no item of ``benchmark``.

    Null and empty texts hold none. All rows of an id go if one of them holds an item; rows without an id stay.
    """
    hits = benchmark_hits(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return docs.join(_sized(hits.select("doc_id").distinct()), "doc_id", "left_anti").select(docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, each as often as it takes them; those without an id or words are not taken."""
    taken = mix(docs).filter("taken > 0 and doc_id is not null")
    many, one = _free(docs, "copies"), _free(docs, "copy")
    taken = taken.groupBy("doc_id").agg(F.max(F.expr("taken div size")).cast("int").alias(many))
    copies = docs.join(_sized(taken), "doc_id")
    return copies.withColumn(one, F.explode(F.sequence(F.lit(1), many))).select(docs.columns)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with the slot and shard of their id, repeated rows and rows without an id too; a column of that name gives way."""
    return place(docs, SHARDS)


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", one_per_group),
    ("benchmark decontamination", decontaminated),
    ("mixing to target weights", mixed),
    ("sharding", sharded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn, each written to the shared folder and read again by the next."""
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
