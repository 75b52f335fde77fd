"""A Merkle manifest of a table: a digest per row, a tree per group, a tree over the groups, and a proof per row.

Ranks are written as binary digits. Within blocks of ``2 ** BITS`` consecutive nodes the digits are grouped away one after
the other, lowest first; each step nests the structs of a run of two as children of the struct that holds their digest.
Block tops are the nodes of the next round, so any group ends in one top after a few rounds. A transform down the nested
structs then hands every node the siblings that it meets on its way up, and an explode emits them: no join within a block.
A block learns the path above itself by its group and number, one row per block.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyline.operators.ranks import ranked
from storyline.session import cut_lineage

#: Levels of a block; it holds up to 256 nodes.
BITS = 8
#: Step of a path that only rehashes; others are "L" or "R" and the sibling that stands left or right.
ALONE = ""
#: Groups up to which the paths from their subroots (some 2 KB each) are broadcast; more are joined by a shuffle.
BROADCAST_GROUPS = 10_000


def framed(values: Sequence[Column]) -> Column:
    """``-`` for null, else UTF-8 byte count, ``:`` and value; one after the other."""
    text = [v.cast("string") for v in values]
    return F.concat(*[F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in text])


def _digest(text: Column) -> Column:
    return F.sha2(text, 256)


def _blocks(nodes: DataFrame) -> DataFrame:
    """Nodes (g, rank, height, hash, ...) → (g, rank, height, hash, tree): blocks of 2^BITS nodes under their top.

    ``height`` is the number of a group's levels above the given nodes; above the last one a top is handed up as it is.
    """
    inner = [c for c in nodes.columns if c not in ("g", "height")]
    digits = [f"d{k}" for k in range(BITS)]
    out = nodes.select(
        "g", "height", F.shiftright("rank", BITS).alias("block"),
        *[F.shiftright("rank", k).bitwiseAND(F.lit(1)).cast("int").alias(d) for k, d in enumerate(digits)],
        F.struct(*inner).alias("node"),
    ).repartition("g", "block")  # every grouping below keeps these two, so this is a round's only shuffle of nodes
    for k, digit in enumerate(digits):
        kids = F.array_sort(F.collect_list(F.struct(F.col(digit).alias("digit"), F.col("node").alias("node"))))
        out = out.groupBy("g", "height", "block", *digits[k + 1:]).agg(kids.alias("kids"))
        joined = F.array_join(F.transform("kids", lambda kid: kid["node"]["hash"]), "")
        top = F.when(F.col("height") > k, _digest(joined)).otherwise(F.col("kids")[0]["node"]["hash"])
        out = out.select("g", "height", "block", *digits[k + 1:], F.struct(top.alias("hash"), "kids").alias("node"))
    return out.select("g", F.col("block").alias("rank"), "height", F.col("node.hash").alias("hash"), F.col("node").alias("tree"))


def _down(node: Column, path: Column, level: int, height: Column) -> Column:
    """The nodes below ``node`` with their paths, as an array of (node, path)."""
    if level == 0:
        return F.array(F.struct(node.alias("node"), path.alias("path")))
    kids = node["kids"]

    def one(kid: Column) -> Column:
        right = kid["digit"] == 0
        other = F.when(right, kids[1]["node"]["hash"]).otherwise(kids[0]["node"]["hash"])
        step = F.when(F.size(kids) == 1, F.array(F.lit(ALONE))).otherwise(
            F.array(F.concat(F.when(right, F.lit("R")).otherwise(F.lit("L")), other))
        )
        ours = F.concat(F.when(height >= level, step).otherwise(F.array().cast("array<string>")), path)
        return _down(kid["node"], ours, level - 1, height)

    return F.flatten(F.transform(kids, one))


def _height(size: Column) -> Column:
    """Levels of a tree over ``size`` nodes: the digits of its largest rank."""
    return F.when(size < 2, 0).otherwise(F.length(F.bin(size - 1))).cast("int")


def tree_paths(nodes: DataFrame) -> DataFrame:
    """Nodes (g, rank, group_size, hash, ...) → (g, top, node, path): each with its group's digest and the steps up to it.

    Ranks run from 0 in each group, which must not be null. Other columns travel in ``node``.
    """
    rows = nodes.withColumn("height", _height(F.col("group_size"))).drop("group_size")
    most = rows.agg(F.max("height")).first()[0] or 0
    rounds = []
    while True:
        rounds.append(cut_lineage(_blocks(rows)))
        most -= BITS
        if most <= 0:
            break
        rows = rounds[-1].select("g", "rank", F.greatest(F.col("height") - BITS, F.lit(0)).alias("height"), "hash")
    above = rounds[-1].select("g", "rank", F.col("hash").alias("top"), F.array().cast("array<string>").alias("path"))
    for k in range(len(rounds) - 1, -1, -1):
        tops = rounds[k].select("g", "rank", "height", "tree").join(above, ["g", "rank"])
        paths = _down(F.col("tree"), F.col("path"), BITS, F.col("height"))
        below = tops.select("g", "top", F.explode(paths).alias("x")).select("g", "top", "x.node", "x.path")
        if k:
            above = cut_lineage(below.select("g", F.col("node.rank").alias("rank"), "top", "path"))
    return below


def fold(leaf: Column, path: Column) -> Column:
    """The digest that a leaf and its path lead to."""
    def up(digest: Column, step: Column) -> Column:
        other, side = F.substring(step, 2, 64), F.substring(step, 1, 1)
        return _digest(F.when(side == "R", F.concat(digest, other)).when(side == "L", F.concat(other, digest)).otherwise(digest))

    return F.aggregate(path, leaf, up)


def manifest(
    docs: DataFrame, columns: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), id: str = "doc_id",
    group: str = "lang", altered: dict[str, Column] | None = None, when: Column | None = None,
) -> DataFrame:
    """One row per row of ``docs``: id, leaf, subroot, root, path, proof_sha256, folded_root and verified.

    A leaf is the SHA-256 of the framed ``columns``. Leaves of a group ascend by id (nulls first, then by leaf) and are
    rolled up in twos to the group's subroot; subroots, ordered by group (null first, bytewise), to the root. ``path`` holds
    the steps from leaf to root, ``proof_sha256`` digests the siblings on it. Where ``when`` is true, ``folded_root`` is
    computed from a leaf with the values of ``altered`` instead, and so only verifies if these change nothing.

    Nulls are framed as ``-``; null ids and null groups are ids and a group like any other. Empty and very long texts are
    digested as they are, one text at a time. Repeated rows are leaves of their own with paths of their own. An empty table
    gives no rows. Only the named columns are read, so others may have any names.
    """
    names = {c: F.col(f"`{c}`") for c in columns}
    leaf = _digest(framed([names[c] for c in columns]))
    changed = _digest(framed([(altered or {}).get(c, names[c]) for c in columns]))
    start = F.when(F.coalesce(when, F.lit(False)), changed) if when is not None else F.lit(None).cast("string")
    key = F.coalesce(F.concat(F.lit("+"), F.col(f"`{group}`").cast("string")), F.lit(""))
    leaves = cut_lineage(docs.select(F.col(f"`{id}`").alias("id"), key.alias("g"), leaf.alias("hash"), start.alias("start")))
    below = cut_lineage(tree_paths(ranked(leaves, "g", ["id", "hash"])).select(
        "g", F.col("top").alias("subroot"), "node.id", F.col("node.hash").alias("leaf"), "node.start", "path"
    ))
    tops = below.groupBy("g").agg(F.min("subroot").alias("hash")).select(F.lit("").alias("g"), F.col("g").alias("of"), "hash")
    upper = tree_paths(ranked(tops, "g", ["of"])).select(F.col("node.of").alias("g"), F.col("top").alias("root"), F.col("path").alias("more"))
    upper = cut_lineage(upper)
    if upper.count() <= BROADCAST_GROUPS:
        upper = F.broadcast(upper)
    rows = below.join(upper, "g").withColumn("path", F.concat("path", "more")).drop("more")
    siblings = F.array_join(F.transform("path", lambda step: F.substring(step, 2, 64)), "")
    folded = fold(F.coalesce("start", "leaf"), F.col("path"))
    return rows.select(
        F.col("id").alias(id), "leaf", "subroot", "root", "path", _digest(siblings).alias("proof_sha256"), folded.alias("folded_root")
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
