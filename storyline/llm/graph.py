"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyline.session import cut_lineage


def components(edges: DataFrame) -> DataFrame:
    """Rows (id, label) for every end point of ``edges`` (a, b): the smallest id it can reach.

    Alternating large and small stars: every round hangs each node below the smallest neighbour it knows, so the number
    of rounds grows with the logarithm of the longest chain. Minima combine before the shuffle, and a hub with very many
    edges only meets a join that Spark may split. Edges with a null end and loops link nothing; no edges give no rows.
    """
    tree = cut_lineage(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("id"), F.least("a", "b").alias("up")).distinct()
    )
    while True:
        both = tree.select("id", "up").unionAll(tree.select(F.col("up"), F.col("id")))
        least = both.groupBy("id").agg(F.min("up").alias("m")).select("id", F.least("id", "m").alias("m"))
        large = both.join(least, "id").filter("up > id").select(F.col("up").alias("id"), F.col("m").alias("up")).distinct()
        large = cut_lineage(large)
        least = large.groupBy("id").agg(F.min("up").alias("m"))
        small = large.join(least, "id")
        grown = cut_lineage(
            small.select("id", F.col("m").alias("up"))
            .unionAll(small.filter("up <> m").select(F.col("up").alias("id"), F.col("m").alias("up")))
            .distinct()
        )
        parents = grown.select(F.col("up").alias("id")).distinct()
        twice = grown.groupBy("id").count().filter("count > 1")
        if grown.join(parents, "id", "left_semi").isEmpty() and twice.isEmpty():
            return grown.select("id", F.col("up").alias("label")).unionAll(
                parents.select("id", F.col("id").alias("label"))
            )
        tree = grown
