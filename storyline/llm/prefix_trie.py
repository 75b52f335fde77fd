"""The trie of all conversations' shared beginnings, its subtrees measured on balanced parentheses.

A node is a distinct sequence of first turns, known by two 60-bit sums over hashes of (turn, place); the sums of a
conversation are running ones, so a conversation of any length is scanned by several tasks. A node is owned by its smallest
member, which holds it from some depth down to its own end. Rows of owners are dealt over shards by ranges of their first
turns; a shard sorts its paths, writes their trie as balanced parentheses, finds where each subtree closes by blocks of
least and greatest excess, and reads the leaves and savings between from running counts. A spine that several shards share
has a part in each; parts are added up. A path cut between shards hands what lies beyond the cut to its last node.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from storyline.operators.ranks import ranked
from storyline.session import cut_lineage

MASK = (1 << 60) - 1
#: Parentheses of a block of excesses.
BLOCK = 64
#: Ids joined into one text on the way to a digest.
CHUNK = 1 << 16
_WORD = r"[^\x20\x09-\x0D]+"


class Parentheses:
    """Balanced parentheses (1 opens) with their excess, and the least and greatest excess of blocks and of blocks of blocks."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits
        self.excess = np.cumsum(2 * bits.astype(np.int64) - 1)
        n = -(-len(bits) // BLOCK)
        self.cells = np.full(n * BLOCK, 1 << 40, np.int64)
        self.cells[: len(bits)] = self.excess
        self.cells = self.cells.reshape(n, BLOCK)
        low, high = self.cells.min(axis=1), np.where(self.cells < 1 << 40, self.cells, -1).max(axis=1)
        self.levels = [(low, high)]
        while len(low) > 1:
            if len(low) % 2:
                low, high = np.append(low, 1 << 40), np.append(high, -1)
                self.levels[-1] = (low, high)
            low, high = low.reshape(-1, 2).min(axis=1), high.reshape(-1, 2).max(axis=1)
            self.levels.append((low, high))

    def _holds(self, level: int, at: np.ndarray, value: np.ndarray) -> np.ndarray:
        low, high = self.levels[level]
        return (low[at] <= value) & (high[at] >= value)

    def findclose(self, at: np.ndarray) -> np.ndarray:
        """The close of each opening parenthesis in ``at``: the next place where the excess is one less."""
        out = np.empty(len(at), np.int64)
        for a in range(0, len(at), 1 << 14):
            out[a:a + (1 << 14)] = self._findclose(at[a:a + (1 << 14)])
        return out

    def _findclose(self, at: np.ndarray) -> np.ndarray:
        target = self.excess[at] - 1
        block, places = at // BLOCK, np.arange(BLOCK)
        hit = (self.cells[block] == target[:, None]) & (places > (at % BLOCK)[:, None])
        out = block * BLOCK + hit.argmax(axis=1)
        on = np.flatnonzero(~hit.any(axis=1))  # these close in a later block
        node, found = block[on], np.full(len(on), -1)
        for level in range(len(self.levels)):
            rest = np.flatnonzero(found < 0)
            right = rest[node[rest] % 2 == 0]
            right = right[node[right] + 1 < len(self.levels[level][0])]
            ends = right[self._holds(level, node[right] + 1, target[on[right]])]
            node[ends] += 1
            found[ends] = level
            rest = np.flatnonzero(found < 0)
            node[rest] //= 2
        for level in range(len(self.levels) - 1, 0, -1):
            down = np.flatnonzero(found == level)
            left = 2 * node[down]
            node[down] = np.where(self._holds(level - 1, left, target[on[down]]), left, left + 1)
            found[down] = level - 1
        last = self.cells[node] == target[on][:, None]
        out[on] = node * BLOCK + last.argmax(axis=1)
        return out


def subtrees(paths: list[list[int]], value: np.ndarray, leaf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nodes of the trie of ``paths``, and the sums of ``leaf`` and ``value`` over each one's subtree.

    ``value`` and ``leaf`` belong to the elements of all paths in a row. A node can come more than once, with a part each.
    """
    start = np.concatenate(([0], np.cumsum([len(p) for p in paths]))).astype(np.int64)
    order = sorted(range(len(paths)), key=paths.__getitem__)
    bits, nodes, stack, at, before = bytearray(), [], [], [], []
    for i in order:
        path, same = paths[i], 0
        for x, y in zip(before, path):
            if x != y:
                break
            same += 1
        bits += b"\0" * (len(before) - same) + b"\1" * (len(path) - same)
        stack = stack[:same] + list(range(len(nodes), len(nodes) + len(path) - same))
        nodes += path[same:]
        at += stack
        before = path
    bits += b"\0" * len(before)
    tree = Parentheses(np.frombuffer(bytes(bits), np.uint8))
    opens = np.flatnonzero(tree.bits)
    rows = np.concatenate([np.arange(start[i], start[i + 1]) for i in order]) if order else np.zeros(0, np.int64)
    sums = []
    close = tree.findclose(opens)
    for given in (leaf, value):
        own = np.zeros(len(tree.bits) + 1, np.int64)
        np.add.at(own, opens[np.array(at, np.int64)] + 1, given[rows])
        upto = np.cumsum(own)
        sums.append(upto[close + 1] - upto[opens])
    return np.array(nodes, np.int64), sums[0], sums[1]


def _columns(batches: Iterator[pa.RecordBatch]) -> list[np.ndarray]:
    """All rows of a partition as one array per column; a partition is a range of bounded size."""
    held = [[c.to_numpy(zero_copy_only=False) for c in b.columns] for b in batches if b.num_rows]
    return [np.concatenate(c) for c in zip(*held)] if held else []


def _shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (conv, k1, k2, saved, leaf, later_saved, later_leaves) of whole or cut paths, in order → (k1, k2, leaves, saved)."""
    columns = _columns(batches)
    if not columns:
        return
    conv, k1, k2, saved, leaf, later_saved, later_leaves = columns
    pairs, ids = np.unique(np.stack([k1, k2], axis=1), axis=0, return_inverse=True)
    first = np.flatnonzero(np.concatenate(([True], conv[1:] != conv[:-1])))
    past = np.append(first[1:], len(conv))
    saved, leaf = saved.copy(), leaf.copy()
    saved[past - 1] += later_saved[past - 1]
    leaf[past - 1] += later_leaves[past - 1]
    ids = ids.ravel().tolist()
    nodes, leaves, sums = subtrees([ids[a:b] for a, b in zip(first.tolist(), past.tolist())], saved, leaf)
    out = [pairs[nodes, 0], pairs[nodes, 1], leaves, sums]
    yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], ["k1", "k2", "leaves", "saved"])


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (conv, pos, len, words, r1, r2) in order → the same with the running sums k1, k2 of r1, r2 since the partition's start, and part."""
    part, conv, carried = TaskContext.get().partitionId(), None, (0, 0)
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column(0).to_numpy()
        new = np.concatenate(([True], ids[1:] != ids[:-1]))
        first = np.flatnonzero(new)[np.cumsum(new) - 1]
        out = []
        for k in (0, 1):
            r = batch.column(4 + k).to_numpy().astype(np.uint64)
            total = np.cumsum(r, dtype=np.uint64)
            sums = total - total[first] + r[first]
            if ids[0] == conv:
                sums[first == 0] += np.uint64(carried[k])
            out.append((sums & np.uint64(MASK)).astype(np.int64))
        conv, carried = ids[-1], (int(out[0][-1]), int(out[1][-1]))
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, *map(pa.array, out), pa.array(np.full(len(ids), part, np.int32))],
            ["conv", "pos", "len", "words", "r1", "r2", "k1", "k2", "part"],
        )


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (k1, k2, conv) in order → (k1, k2, first, ids): ids joined by commas, at most CHUNK of a batch in a row."""
    for batch in batches:
        k1, k2, conv = (c.to_numpy() for c in batch.columns)
        if not len(conv):
            continue
        new = np.concatenate(([True], (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])))
        first = np.flatnonzero(new | (np.arange(len(conv)) % CHUNK == 0))
        text = conv.astype(str).tolist()
        joined = [",".join(text[a:b]) for a, b in zip(first.tolist(), [*first[1:].tolist(), len(conv)])]
        yield pa.RecordBatch.from_arrays([pa.array(k1[first]), pa.array(k2[first]), pa.array(conv[first]), pa.array(joined)], ["k1", "k2", "first", "ids"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (k1, k2, first, ids) in order → (k1, k2, ends): the digest of each node's ids, one row held at a time."""
    key, digest = None, None
    for batch in batches:
        done = []
        for k1, k2, ids in zip(*(batch.column(k).to_pylist() for k in (0, 1, 3))):
            if (k1, k2) != key:
                done += [(*key, digest.hexdigest())] if key else []
                key, digest = (k1, k2), hashlib.sha256(ids.encode())
            else:
                digest.update(b"," + ids.encode())
        if done:
            yield _ended(done)
    if key:
        yield _ended([(*key, digest.hexdigest())])


def _ended(rows: list) -> pa.RecordBatch:
    k1, k2, ends = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(ends)], ["k1", "k2", "ends"])


def ordered_turns(conversations: DataFrame, id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows (conv, place, conv_turns, turn_id, words): the turns of each conversation from place 0, in the order of ``turn``.

    A null turn comes first; turns of equal number are ordered by the digest of role and text, in which nulls are empty.
    Rows without an id belong to no conversation and are dropped.
    """
    said = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    who = F.coalesce(F.col(f"`{role}`").cast("string"), F.lit(""))
    rows = conversations.filter(F.col(f"`{id}`").isNotNull()).select(
        F.col(f"`{id}`").cast("long").alias("conv"), F.col(f"`{turn}`").alias("turn"),
        F.md5(F.concat(F.octet_length(who).cast("string"), F.lit(":"), who, said)).alias("turn_id"),
        F.regexp_count(said, F.lit(_WORD)).cast("long").alias("words"),
    )
    return ranked(cut_lineage(rows), "conv", ["turn", "turn_id"], "place", "conv_turns").drop("turn")


def spliced(turns: DataFrame, heads: Column, donor: Column) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin with another's turns: (their turns, all of them with their length).

    ``turns`` as of ``ordered_turns``. ``heads``, a number below 4, and ``donor``, an id that at most some dozens of
    conversations name, are columns of ``conv``: the first ``heads`` turns of the donor come first (all if it has fewer,
    none if there is none), then the conversation's own turns after its first ``heads``.
    """
    sizes = turns.groupBy("conv").agg(F.max("conv_turns").alias("n")).select("conv", "n", heads.cast("int").alias("h"), donor.alias("donor"))
    given = sizes.select(F.col("conv").alias("donor"), F.col("n").alias("donor_n"))
    lent = F.least(F.col("h").cast("long"), F.coalesce("donor_n", F.lit(0)))
    convs = cut_lineage(sizes.join(given, "donor", "left").select(
        "conv", "h", "donor", lent.alias("lent"), (lent + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("len")
    ))
    own = turns.join(convs, "conv").filter("place >= h").select("conv", (F.col("place") - F.col("h") + F.col("lent") + 1).alias("pos"), "len", "turn_id", "words")
    first = turns.filter("place < 3").select(F.col("conv").alias("donor"), "place", "turn_id", "words")
    borrowed = convs.join(first, "donor").filter("place < lent").select("conv", (F.col("place") + 1).alias("pos"), "len", "turn_id", "words")
    return own.unionByName(borrowed), convs.select("conv", "len")


def _spans(rows: DataFrame, sums: list[Column], later: bool) -> DataFrame:
    """(conv, part, sums over the conversation's parts before or after) of conversations cut between parts: two rows a part at most."""
    parts = rows.groupBy("conv", "part").agg(*sums)
    names = [c for c in parts.columns if c not in ("conv", "part")]
    whole = W.partitionBy("conv")
    side = whole.orderBy("part").rowsBetween(*((1, W.unboundedFollowing) if later else (W.unboundedPreceding, -1)))
    total = [F.coalesce(F.sum(F.col(c).cast("decimal(38,0)")).over(side), F.lit(0)).alias(c) for c in names]
    return F.broadcast(parts.select("conv", "part", *total, F.count("*").over(whole).alias("cuts")).filter("cuts > 1").drop("cuts"))


def _running_keys(turns: DataFrame, parts: int) -> DataFrame:
    """Turns (conv, pos, len, turn_id, words) with the keys k1, k2 of their node and p1, p2 of its parent."""
    mixed = F.md5(F.concat("turn_id", F.lit(":"), F.col("pos").cast("string")))
    half = [F.conv(F.substring(mixed, at, 15), 16, 10).cast("long").alias(r) for r, at in (("r1", 1), ("r2", 17))]
    rows = turns.select("conv", F.col("pos").cast("long").alias("pos"), F.col("len").cast("long").alias("len"), "words", *half)
    rows = rows.repartitionByRange(parts, "conv", "pos").sortWithinPartitions("conv", "pos")
    rows = cut_lineage(rows.mapInArrow(_running, "conv long, pos long, len long, words long, r1 long, r2 long, k1 long, k2 long, part int"))
    before = _spans(rows, [F.max_by("k1", "pos").alias("b1"), F.max_by("k2", "pos").alias("b2")], later=False)
    whole = {k: (F.col(k) + F.coalesce((F.col(b) % (MASK + 1)).cast("long"), F.lit(0))).bitwiseAND(F.lit(MASK)) for k, b in (("k1", "b1"), ("k2", "b2"))}
    rows = rows.join(before, ["conv", "part"], "left").withColumns(whole).drop("b1", "b2", "part")
    parent = {p: (F.col(k) - F.col(r) + (MASK + 1)).bitwiseAND(F.lit(MASK)) for p, k, r in (("p1", "k1", "r1"), ("p2", "k2", "r2"))}
    return rows.withColumns(parent).drop("r1", "r2")


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``turns``: (conv, pos from 1, len, turn_id, words), ``convs``: (conv, len), each conversation once, turnless ones too.
    A node is known by its smallest member and depth. The root, of depth 0, has no parent and all conversations;
    ``saved_tokens`` sums (members - 1) times the words of the last turn over a node's subtree, ``n_leaves`` its childless
    nodes; ``ends_sha256`` digests the ids of the members that end at the node. Without conversations there are no rows.
    """
    spark = turns.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    everyone = convs.agg(F.min("conv").alias("owner"), F.count("*").alias("n_convs")).first()
    if not everyone["n_convs"]:
        schema = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
        return spark.createDataFrame([], schema)
    rows = cut_lineage(_running_keys(turns, parts))
    nodes = rows.groupBy("k1", "k2").agg(
        F.min("conv").alias("owner"), F.max("pos").alias("depth"), F.count("*").alias("n_convs"), F.max("words").alias("words"),
        F.max("p1").alias("p1"), F.max("p2").alias("p2"),
    )
    root = spark.range(1).select(
        F.lit(0).cast("long").alias("k1"), F.lit(0).cast("long").alias("k2"), F.lit(everyone["owner"]).alias("owner"),
        F.lit(0).cast("long").alias("depth"), F.lit(everyone["n_convs"]).alias("n_convs"), F.lit(0).cast("long").alias("words"),
        F.lit(-1).cast("long").alias("p1"), F.lit(-1).cast("long").alias("p2"),
    )
    nodes = cut_lineage(nodes)
    children = nodes.groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("n_children"))
    nodes = cut_lineage(nodes.unionByName(root).join(children, ["k1", "k2"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))))

    own = nodes.filter("depth > 0").select(
        F.col("owner").alias("conv"), F.col("depth").alias("pos"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved"),
        (F.col("n_children") == 0).cast("long").alias("leaf"),
    )
    lead = rows.filter("pos <= 3").groupBy("conv").agg(*[F.max(F.when(F.col("pos") == k, F.col("k1"))).alias(f"lead{k}") for k in (1, 2, 3)])
    owners = lead.join(own.select("conv").distinct(), "conv", "left_semi")
    paths = rows.select("conv", "pos", "k1", "k2").join(own, ["conv", "pos"], "left").join(owners, "conv")
    key = ["lead1", "lead2", "lead3", "conv", "pos"]
    paths = paths.repartitionByRange(parts, *key).sortWithinPartitions(*key).withColumn("part", F.spark_partition_id())
    paths = cut_lineage(paths.select("conv", "pos", "k1", "k2", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("saved", "leaf")], "part"))
    later = _spans(paths, [F.sum("saved").alias("later_saved"), F.sum("leaf").alias("later_leaves")], later=True)
    shards = paths.join(later, ["conv", "part"], "left").select(
        "conv", "k1", "k2", "saved", "leaf", *[F.coalesce(F.col(c).cast("long"), F.lit(0)).alias(c) for c in ("later_saved", "later_leaves")]
    )
    partly = shards.mapInArrow(_shard, "k1 long, k2 long, leaves long, saved long")
    sums = partly.groupBy("k1", "k2").agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    zero = [F.lit(0).cast("long").alias(k) for k in ("k1", "k2")]
    top = own.agg(F.coalesce(F.sum("leaf"), F.lit(1)).alias("n_leaves"), F.coalesce(F.sum("saved"), F.lit(0)).alias("saved_tokens")).select(*zero, "n_leaves", "saved_tokens")
    sums = sums.unionByName(top)

    ends = rows.filter("pos = len").select("k1", "k2", "conv").unionByName(convs.filter("len = 0").select(*zero, "conv"))
    ends = ends.repartitionByRange(parts, "k1", "k2", "conv").sortWithinPartitions("k1", "k2", "conv")
    ends = ends.mapInArrow(_chunks, "k1 long, k2 long, first long, ids string")
    ends = ends.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "first").mapInArrow(_digests, "k1 long, k2 long, ends string")

    # Children of the root, possibly most nodes, know their parent; a key of their own keeps them apart in the join.
    apart = [F.when(F.col("depth") > 1, F.col("p1")).otherwise(-2 - F.col("owner")).alias("p1"), "p2"]
    above = nodes.filter("n_children > 0 and depth > 0").select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("owner").alias("parent"))
    out = nodes.select("k1", "k2", "owner", "depth", "n_convs", "n_children", *apart).join(above, ["p1", "p2"], "left")
    out = out.join(sums, ["k1", "k2"], "left").join(ends, ["k1", "k2"], "left")
    return out.select(
        F.col("owner").alias("conv_id"), "depth", F.when(F.col("depth") == 1, F.lit(everyone["owner"])).otherwise(F.col("parent")).alias("parent_conv_id"),
        "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )
