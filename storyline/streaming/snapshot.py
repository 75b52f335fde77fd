"""A keyed table that a stream refreshes in place: partitions copied on write, versions named by their batch.

A version is a short record that says where each partition's files are. A refresh writes the partitions it changes as new
files and then puts the record of the next version in one step; readers take the newest record, so they see a refresh whole
or not at all. A batch id that already has a record changes nothing. Files of versions that no reader can still hold are
removed after ``keep`` further refreshes.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyline.session import cut_lineage
from storyline.streaming.store import Folder


class Snapshots:
    """``keys`` identify a row; ``parts`` buckets of the hash of ``by``, some of the keys, are the partitions."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], by: list[str] | None = None, parts: int = 16, keep: int = 2):
        self.folder, self.keys, self.by, self.parts, self.keep = Folder(spark, path), keys, by or keys, parts, keep
        self.spark = spark

    def versions(self) -> list[int]:
        return sorted(int(n) for n in self.folder.names("versions"))

    def _record(self, version: int | None = None) -> dict:
        known = self.versions()
        at = known[-1] if known and version is None else version
        return self.folder.read(f"versions/{at:020d}") if at is not None else {"batch": None, "parts": {}, "schema": None}

    def read(self, version: int | None = None) -> DataFrame | None:
        """The table as of a version, the newest by default; None before the first."""
        record = self._record(version)
        return self._rows(record, record["parts"])

    def near(self, rows: DataFrame) -> DataFrame | None:
        """The partitions of the newest version that ``rows`` fall into by their ``by`` columns."""
        record = self._record()
        return self._rows(record, [p for p in self._touched(rows) if p in record["parts"]])

    def _bucket(self):
        return F.pmod(F.xxhash64(*self.by), F.lit(self.parts)).cast("int")

    def _touched(self, rows: DataFrame) -> list[str]:
        return sorted(str(r[0]) for r in rows.select(self._bucket()).distinct().collect())  # at most ``parts`` numbers

    def _rows(self, record: dict, parts) -> DataFrame | None:
        if record["schema"] is None:
            return None
        paths = [f"{self.folder.path}/{record['parts'][p]}" for p in parts]
        if not paths:
            return self.spark.createDataFrame([], record["schema"])
        return self.spark.read.schema(record["schema"]).parquet(*paths)

    def refresh(self, changes: DataFrame, batch: int, merge=None) -> bool:
        """Puts ``changes`` (one row a key) over the rows of equal keys; False if the batch was there before.

        ``merge(old, new)`` may return the rows that shall stand for both where a key has an old row; it gets the old
        rows of the partitions concerned and the new ones. Only the partitions that ``changes`` fall into are read and
        written. A batch older than the newest one is refused like a repeated one.
        """
        known = self.versions()
        if known and batch <= known[-1]:
            return False
        record = self._record()
        new = cut_lineage(changes)
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in new.schema)
        touched = self._touched(new)
        old = self._rows(record, [p for p in touched if p in record["parts"]])
        rows = new
        if old is not None:
            if merge is not None:
                new = cut_lineage(merge(old, new))
            rest = old.join(new.select(*self.keys), self.keys, "left_anti")
            rows = new.unionByName(rest.select(new.columns))
        home = f"data/{batch}-{uuid.uuid4().hex}"
        rows.withColumn("_part", self._bucket()).repartition(len(touched) or 1, "_part").write.partitionBy("_part").parquet(f"{self.folder.path}/{home}")
        parts = {**record["parts"], **{p: f"{home}/_part={p}" for p in touched}}
        done = self.folder.write(f"versions/{batch:020d}", {"batch": batch, "parts": parts, "schema": record["schema"] or schema})
        if done:
            self._forget()
        return done

    def _forget(self) -> None:
        """Drops records older than the last ``keep`` and the files that only they name."""
        known = self.versions()
        old, kept = known[: -1 - self.keep], known[-1 - self.keep:]
        if not old:
            return
        held = {p.split("/_part=")[0] for v in kept for p in self._record(v)["parts"].values()}
        for v in old:
            self.folder.remove(f"versions/{v:020d}")
        oldest = kept[0]
        for home in self.folder.names("data"):
            if f"data/{home}" not in held and int(home.split("-")[0]) < oldest:
                self.folder.remove(f"data/{home}")
