"""Nearest vectors by inner product, with cross-polytope hashing.

A table rotates unit vectors pseudo-randomly, by three rounds of random signs and a fast Hadamard transform, and puts each
vector in the bucket of the nearest signed axis. A query looks into the buckets of its ``probes`` nearest axes in every
table; all it meets there are ranked by their exact inner products. Vectors of unequal norms are lifted by one coordinate
that makes their norms equal and leaves inner products with queries as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from storyline.session import cut_lineage

TABLES = 12
#: Vectors, and queries, that meet in one piece; larger buckets are met piece by piece.
BLOCK = 4096


def rotate(x: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """Rounds of signs and Hadamard transforms of the rows of ``x``; its width is a power of two."""
    for s in signs:
        x = x * s
        h = 1
        while h < x.shape[1]:
            y = x.reshape(len(x), -1, 2, h)
            x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(len(x), -1)
            h *= 2
    return x


def buckets(x: np.ndarray, signs: np.ndarray, probes: int) -> np.ndarray:
    """For each row the numbers of the ``probes`` nearest signed axes, nearest first."""
    y = rotate(x, signs)
    near = np.argsort(-np.abs(y), axis=1, kind="stable")[:, :probes]
    return 2 * near + (np.take_along_axis(y, near, axis=1) > 0)


def usable(vector: Column) -> Column:
    """Whether a vector has a value, no null or non-finite component, and is not zero."""
    bad = F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~bad & F.exists(vector, lambda v: v != 0), F.lit(False))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), width)


def _hashed(dim: int, width: int, norm: float, lift: bool, tables: int, probes: int, seed: int):
    """Rows (gid, v) → (bucket, gid, v): one per table for stored vectors (``probes`` 1), several for queries."""
    signs = np.random.default_rng(seed).choice([-1.0, 1.0], (tables, 3, width))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                piece = batch.slice(at, 1000)
                x = np.zeros((piece.num_rows, width))
                x[:, :dim] = _matrix(piece.column(1), dim)
                if lift and probes == 1:
                    x[:, :dim] /= norm
                    x[:, dim] = np.sqrt(np.maximum(0, 1 - (x[:, :dim] ** 2).sum(axis=1)))
                for t in range(tables):
                    to = buckets(x, signs[t], probes) + t * 2 * width
                    rows = pa.array(np.repeat(np.arange(piece.num_rows), probes))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(to.ravel().astype(np.int32)), piece.column(0).take(rows), piece.column(1).take(rows)],
                        ["bucket", "gid", "v"],
                    )

    return run


def _meet(dim: int, keep: int):
    """One block of queries and vectors → (query, gid, score) of each query's ``keep`` best."""

    def run(queries: pa.Table, stored: pa.Table) -> pa.Table:
        out = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        if len(queries) and len(stored):
            q, x = (_matrix(t.column("v").combine_chunks(), dim) for t in (queries, stored))
            ids, gids = queries.column("gid").to_numpy(), stored.column("gid").to_numpy()
            order = np.argsort(gids, kind="stable")
            x, gids = x[order], gids[order]
            parts = []
            for at in range(0, len(q), 256):
                some = q[at:at + 256]
                rough = some @ x.T
                n = min(len(x), keep)
                last = -np.partition(-rough, n - 1, axis=1)[:, n - 1]
                # Whatever may tie with the last one kept stays until the exact order, in which smaller ids come first.
                near = rough >= (last - 1e-9 * np.maximum(1.0, np.abs(rough).max(axis=1)))[:, None]
                for i, row in enumerate(near):
                    top = np.flatnonzero(row)
                    exact = np.einsum("kd,d->k", x[top], some[i])
                    rank = np.lexsort((top, -exact))[:keep]
                    parts.append((np.full(len(rank), ids[at + i]), gids[top[rank]], exact[rank]))
            out = [np.concatenate(c) for c in zip(*parts)]
        return pa.table({"query": out[0], "gid": out[1], "score": out[2]})

    return run


def nearest(
    vectors: DataFrame,
    queries: Column,
    id: str = "vec_id",
    vector: str = "embedding",
    k: int = 20,
    tables: int = TABLES,
    probes: int | None = None,
    seed: int = 0,
) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): up to ``k`` nearest found of each row for which ``queries`` holds.

    Nearest is largest inner product in double precision, ties to the smaller id; a row is no neighbour of its own. Vectors
    that are null, zero, or hold a null or non-finite component take no part, neither do null ids and vectors of another
    length than most. Equal vectors are one point with their ``k + 1`` smallest ids, which is all that a result can show,
    so copies cost nothing and a repeated id counts once; other columns are ignored; an empty table gives no rows. A query
    whose tables lead to fewer than ``k`` vectors, as in small tables, is compared with all of them, block by block, so it has
    fewer rows only if there are fewer candidates.
    """
    schema = "bucket int, gid long, v " + vectors.schema[vector].dataType.simpleString()
    rows = vectors.withColumn("_q", F.coalesce(queries, F.lit(False))).select(
        F.col(id).cast("long").alias("id"), F.col(vector).alias("v"), "_q"
    )
    rows = rows.filter(F.col("id").isNotNull() & usable(F.col("v")))
    common = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    dim = common["dim"] if common else 1
    rows = rows.filter(F.size("v") == dim).withColumn("h", F.xxhash64("v"))
    inside = Window.partitionBy("h", "v").orderBy("id")
    few = rows.groupBy("h", "v", "id").agg(F.max("_q").alias("_q")).withColumn("n", F.row_number().over(inside)).filter(F.col("n") <= k + 1)
    points = cut_lineage(few.groupBy("h", "v").agg(F.min("id").alias("gid"), F.sort_array(F.collect_list("id")).alias("ids")))
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    norms = points.agg(F.min(F.sqrt(square)).alias("low"), F.max(F.sqrt(square)).alias("high")).first()
    low, high = norms["low"] or 1.0, norms["high"] or 1.0
    lift = low < 0.99 * high
    width = 1 << max(1, (dim + lift - 1).bit_length())
    probes = min(probes or max(6, 3 * width // 16), width)
    asked = cut_lineage(
        rows.filter("_q").select("id", "h", "v").distinct().join(points.select("h", "v", "gid"), ["h", "v"]).select("id", "gid")
    )
    asked_points = points.join(asked.select("gid").distinct(), "gid", "left_semi").select("gid", "v")
    stored = points.select("gid", "v").mapInArrow(_hashed(dim, width, high, lift, tables, 1, seed), schema)
    probing = asked_points.mapInArrow(_hashed(dim, width, high, lift, tables, probes, seed), schema)

    sizes = stored.groupBy("bucket").count().select("bucket", F.ceil(F.col("count") / BLOCK).cast("int").alias("cuts"))
    asks = probing.groupBy("bucket").count().select("bucket", F.ceil(F.col("count") / BLOCK).cast("int").alias("parts"))
    plan = F.broadcast(cut_lineage(sizes.join(asks, "bucket")))  # at most a row per table and signed axis
    cut = F.pmod(F.xxhash64("gid"), F.col("cuts")).cast("int")
    part = F.pmod(F.xxhash64("gid"), F.col("parts")).cast("int")
    left = probing.join(plan, "bucket").withColumn("part", part).withColumn(
        "cut", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1))
    )
    right = stored.join(plan, "bucket").withColumn("cut", cut).withColumn(
        "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    )
    keys = ["bucket", "part", "cut"]
    met = left.select(*keys, "gid", "v").groupBy(*keys).cogroup(right.select(*keys, "gid", "v").groupBy(*keys)).applyInArrow(
        _meet(dim, k + 1), "query long, gid long, score double"
    )
    best = Window.partitionBy("query").orderBy(F.desc("score"), "gid")

    def first(scores: DataFrame) -> DataFrame:
        once = scores.groupBy("query", "gid").agg(F.max("score").alias("score"))
        return once.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= k + 1)

    top = cut_lineage(first(met))
    # Points, not ids, are counted: k + 1 of them hold k ids besides the query's own at least.
    ended = top.groupBy("query").agg(F.count("*").alias("n")).filter(F.col("n") > k)
    points_n = points.count()
    short = cut_lineage(asked_points.join(ended.select(F.col("query").alias("gid")), "gid", "left_anti")) if points_n else None
    if short is not None and not short.isEmpty():
        blocks = -(-points_n // BLOCK)
        every = points.select(F.pmod(F.xxhash64("gid"), F.lit(blocks)).cast("int").alias("cut"), "gid", "v")
        groups = -(-short.count() // BLOCK)
        ask = short.select(F.pmod(F.xxhash64("gid"), F.lit(groups)).cast("int").alias("part"), "gid", "v")
        ask = ask.withColumn("cut", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        every = every.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
        more = ask.select("part", "cut", "gid", "v").groupBy("part", "cut").cogroup(every.select("part", "cut", "gid", "v").groupBy("part", "cut")).applyInArrow(
            _meet(dim, k + 1), "query long, gid long, score double"
        )
        top = top.join(short.select(F.col("gid").alias("query")), "query", "left_anti").unionByName(first(more))
    found = top.join(points.select("gid", "ids"), "gid").select("query", "score", F.explode("ids").alias("vec_id"))
    mine = asked.select(F.col("id").alias("query_id"), F.col("gid").alias("query")).join(found, "query").filter("query_id <> vec_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return mine.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
