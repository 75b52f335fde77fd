"""A streaming source of social posts: it reads what is newer than the highest id of each feed that it has read.

``spark.readStream.format("posts").option("path", folder)`` reads a Parquet table partitioned by ``feed`` with ``id`` (text)
and ``json``. Offsets are the highest numeric id of each feed, as a poll's cursor is; a batch is planned as ranges of
ids per feed, from file statistics alone, so a feed of any size is read by many tasks. Register with ``PostsSource``.
"""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.dataset as ds
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "feed string, id bigint, json string"


def _dataset(path: str) -> ds.Dataset:
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return ds.dataset(inner, format="parquet", filesystem=store, partitioning=ds.partitioning(pa.schema([("feed", pa.string())]), flavor="hive"))


class IdRange(InputPartition):
    def __init__(self, feed: str, after: int, upto: int):
        self.feed, self.after, self.upto = feed, after, upto


class _PostsReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.rows = int(options.get("rowsPerPartition", 50_000))
        self.most = int(options.get("idsPerTrigger", 0))
        self.at: dict | None = None

    def initialOffset(self) -> dict:
        return {}

    def _ranges(self) -> dict[str, list[tuple[int, int, int]]]:
        """(lowest id, highest id, rows) of each group of rows of each feed, from the files' footers."""
        out: dict[str, list] = {}
        for fragment in _dataset(self.path).get_fragments():
            feed = unquote(fragment.path.split("feed=")[1].split("/")[0])
            for group in fragment.row_groups:
                stats = (group.statistics or {}).get("id")
                if stats and group.num_rows:
                    out.setdefault(feed, []).append((stats["min"], stats["max"], group.num_rows))
        return out

    def latestOffset(self) -> dict:
        """The highest id of each feed, or for ``idsPerTrigger`` the highest within so many ids of the last offset."""
        top = {feed: max(r[1] for r in ranges) for feed, ranges in self._ranges().items()}
        if self.most:
            low = {feed: min(r[0] for r in ranges) - 1 for feed, ranges in self._ranges().items()}
            before = self.at or {}
            top = {feed: min(v, before.get(feed, low[feed]) + self.most) for feed, v in top.items()}
        self.at = {**(self.at or {}), **top}
        return dict(self.at)

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.at = {**end, **(self.at or {})}
        ranges, out = self._ranges(), []
        for feed, upto in sorted(end.items()):
            after = start.get(feed, min((r[0] for r in ranges.get(feed, [])), default=1) - 1)
            if upto <= after:
                continue
            within = sum(n for low, high, n in ranges.get(feed, []) if high > after and low <= upto)
            parts = max(1, -(-within // self.rows))
            step = -(-(upto - after) // parts)
            out += [IdRange(feed, a, min(a + step, upto)) for a in range(after, upto, step)]
        return out

    def read(self, partition: IdRange) -> Iterator[pa.RecordBatch]:
        inside = (ds.field("feed") == partition.feed) & (ds.field("id") > partition.after) & (ds.field("id") <= partition.upto)
        for batch in _dataset(self.path).to_batches(columns=["feed", "id", "json"], filter=inside):
            if batch.num_rows:
                yield batch.cast(pa.schema([("feed", pa.string()), ("id", pa.int64()), ("json", pa.string())]))

    def commit(self, end: dict) -> None:
        pass


class PostsSource(DataSource):
    """Options: ``path``, ``rowsPerPartition`` (50,000), ``idsPerTrigger`` (no limit)."""

    @classmethod
    def name(cls) -> str:
        return "posts"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _PostsReader(self.options)


def store_posts(posts: DataFrame, path: str) -> None:
    """Posts (feed, id, json) as the table that the source reads, in order of their ids; those without a feed or an id are left out."""
    rows = posts.filter("id is not null and feed is not null").select("feed", F.col("id").cast("long").alias("id"), "json")
    rows.repartition("feed").sortWithinPartitions("feed", "id").write.mode("append").partitionBy("feed").parquet(path)


def split_posts(posts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(posts that are an object with an id and a text, rejects with their reason)."""
    kind = "id string, text string, created_at string, is_reply boolean, is_repost boolean, _bad string"
    parsed = posts.withColumn("p", F.from_json("json", kind, {"columnNameOfCorruptRecord": "_bad"}))
    reason = (
        F.when(F.col("json").isNull(), "no post").when(F.col("p").isNull() | F.col("p._bad").isNotNull(), "no JSON object")
        .when(F.coalesce("p.id", F.lit("")) == "", "no id").when(F.col("p.text").isNull(), "no text")
    )
    marked = parsed.withColumn("reason", reason).drop("p")
    return marked.filter("reason is null").drop("reason"), marked.filter("reason is not null")
