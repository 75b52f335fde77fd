"""Near duplicates by a join of parity sketches.

A text's shingles are XOR-hashed into a sketch of 2^b parts: the leading bits of a shingle's hash name its part, and each
part holds the XOR of its shingles, so a shingle that two texts share cancels out of their difference. At most
``|A xor B|`` parts can differ, which bounds the symmetric difference from below. Similarity ``s`` allows a symmetric
difference of ``(1 - s) / (1 + s) * (|A| + |B|)`` at most, so by the pigeonhole principle similar texts agree in all other
parts; of any order of the parts, the first ``difference + 1`` of each text then hold a common one. Texts meet per band of
sizes, in the parts that come first when parts with rare shingles come first, and every meeting is verified exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyline.llm import words
from storyline.llm.graph import components
from storyline.session import cut_lineage

#: Sizes of a band span a factor of 2^3; a band's sketch has as many parts as its largest text has shingles.
BAND_BITS = 3
#: Counters of shingle frequency. They order the parts, so they touch the speed and never the result.
COUNTER_BITS = 23
HEAVY = 1 << 17
#: Members up to which all pairs of a bucket meet. In a larger one all meet the first ``FIRST``, which are the same in most
#: buckets of a group, and ``_across`` does the rest.
SMALL, FIRST = 16, 2
#: Shingles (8 bytes each) of a block of texts that meet in one piece.
BLOCK_SHINGLES = 500_000
#: Ids up to which the texts to verify are picked by a broadcast (8 bytes each).
BROADCAST_IDS = 2_000_000
ROWS = 400
_CARRY = 4096


def _pieces(batches, rows=ROWS):
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def heavy_shingles(docs: DataFrame, text: str = "text", n: int = words.SHINGLE) -> np.ndarray:
    """A frequency class (0 to 255) for each counter: 0 for all but the ``HEAVY`` most frequent ones. Counts all texts."""
    size = 1 << COUNTER_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, total = np.zeros(size, np.int32), 0
        for batch in _pieces(batches):
            hashes, of = words.tokens(batch.column(0))
            grams = words.runs(hashes, n)
            at, many = np.unique((grams & np.uint64(size - 1)).astype(np.uint32), return_counts=True)
            seen[at] += many.astype(np.int32)
            total += len(grams)
        at = np.flatnonzero(seen >= 3 + 4 * total // size)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(seen[at].astype(np.int64))], ["c", "n"])

    top = docs.select(text).mapInArrow(count, "c int, n long").groupBy("c").agg(F.sum("n").alias("n"))
    classes = np.zeros(size, np.uint8)
    for c, k in top.orderBy(F.desc("n"), "c").limit(HEAVY).select("c", F.log2("n").cast("int")).collect():
        classes[c] = k + 1
    return classes


def allowed_difference(size: int, percent: int) -> int:
    """Most shingles by which a text of ``size`` shingles and any similar one can differ, counted on both sides."""
    return (size + size * 100 // percent) * (100 - percent) // (100 + percent)


def sketch_keys(shingles: np.ndarray, classes: np.ndarray, percent: int) -> np.ndarray:
    """The bucket keys of one text's sorted shingle set: two similar sets have a key in common."""
    size = len(shingles)
    most = size * 100 // percent
    spare = allowed_difference(size, percent)
    band = (size.bit_length() - 1) // BAND_BITS
    out = []
    for g in range(band, (most.bit_length() - 1) // BAND_BITS + 1):
        part = shingles >> np.uint64(64 - BAND_BITS * (g + 1))
        starts = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
        sketch = np.bitwise_xor.reduceat(shingles, starts)
        keys = words.mix(sketch + (part[starts] * np.uint64(64) + np.uint64(g)) * np.uint64(0x9E3779B97F4A7C15))
        if len(keys) <= spare:  # too few parts to promise a common one: its single shingles, for others of this kind
            out.append(words.mix(shingles + np.uint64(g + 1) * np.uint64(0xD6E8FEB86659FD93)))
        if len(keys) > spare + 1:
            rare = np.minimum.reduceat(classes[shingles & np.uint64(len(classes) - 1)], starts)
            if rare.any():
                keys = keys[np.lexsort((keys, rare))]
                keys = keys[: spare + 1]
            else:
                keys = np.partition(keys, spare)[: spare + 1]
        out.append(keys)
    return np.concatenate(out)


def _set_hashes(n: int):
    """Texts (doc, text) → (doc, own, n): a 64-bit hash of the shingle set and its size; an empty set hashes its id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            own, sizes = np.zeros(len(ids), np.uint64), np.zeros(len(ids), np.int32)
            for i, (doc, s) in enumerate(zip(ids.tolist(), words.shingle_sets(batch.column(1), n))):
                sizes[i] = len(s)
                own[i] = np.bitwise_xor.reduce(words.mix(s + np.uint64(1))) ^ s.sum(dtype=np.uint64) if len(s) else doc & (2**64 - 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(words.mix(own).view(np.int64)), pa.array(sizes)], ["doc", "own", "n"]
            )

    return run


def equal_sets(texts: DataFrame, n: int) -> DataFrame:
    """Rows (doc, n, class_id) of the texts (doc, text): the size of its shingle set, and the smallest id with the same set."""
    hashed = cut_lineage(texts.mapInArrow(_set_hashes(n), "doc long, own long, n int"))
    first = hashed.groupBy("own", "n").agg(F.min("doc").alias("class_id"))
    return cut_lineage(hashed.join(first, ["own", "n"]).select("doc", "n", "class_id"))


def _bucket_rows(classes, percent: int, n: int):
    """Texts (doc, text) → rows (key, n, doc): a text's keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            keys, sizes, docs = [], [], []
            for doc, s in zip(ids.tolist(), words.shingle_sets(batch.column(1), n)):
                if len(s):
                    keys.append(sketch_keys(s, classes, percent))
                    sizes.append(np.full(len(keys[-1]), len(s), np.int32))
                    docs.append(np.full(len(keys[-1]), doc, np.int64))
            if keys:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(x)) for x in ([k.view(np.int64) for k in keys], sizes, docs)], ["key", "n", "doc"]
                )

    return run


class _Buckets:
    """Meets the members of buckets that arrive in order of key and tie, in memory that does not grow with a bucket.

    Rows of a bucket with the same tie and size are one member; the tie must tell different members apart.
    """

    def __init__(self, percent: int):
        self.percent = percent
        self.held = None  # rows of the last, perhaps unfinished bucket
        self.open = False  # whether only its first members are held, the others having been met

    def take(self, rows: np.ndarray, last: bool):
        """Rows [key, tie, n, doc] → arrays of (kind, key, a, b, n)."""
        old = 0 if self.held is None else len(self.held)
        if old:
            rows = np.concatenate([self.held, rows])
        seen = old if self.open else 0
        if not len(rows):
            return
        new = np.concatenate(([True], (rows[1:, 0] != rows[:-1, 0]) | ((rows[1:, 2] > 0) != (rows[:-1, 2] > 0))))
        fresh = np.concatenate(([True], new[1:] | (rows[1:, 1] != rows[:-1, 1]) | (rows[1:, 2] != rows[:-1, 2]) | (rows[:-1, 2] < 1)))
        keep = fresh | (np.arange(len(rows)) < seen)  # of copies, the first alone
        rows, new = rows[keep], new[keep]
        starts = np.flatnonzero(new)
        cut = len(rows) if last else int(starts[-1])
        was_open = self.open
        tail = rows[cut:]
        if not last and len(tail) > _CARRY:
            cut, self.open = len(rows), True
            self.held = tail[: FIRST if tail[0, 2] > 0 else 1]
        else:
            # a bucket that was open stays so while it is the last one
            self.open = was_open and cut == 0
            self.held = tail
        if self.open and cut == 0 and len(tail) > seen:
            cut, self.held = len(rows), tail[: FIRST if tail[0, 2] > 0 else 1]
        yield from self.meet(rows[:cut], seen)

    def meet(self, rows: np.ndarray, seen: int):
        if len(rows) <= seen:
            return
        starts = np.flatnonzero(np.concatenate(([True], (rows[1:, 0] != rows[:-1, 0]) | ((rows[1:, 2] > 0) != (rows[:-1, 2] > 0)))))
        sizes = np.diff(np.append(starts, len(rows)))
        first = np.repeat(starts, sizes)
        place = np.arange(len(rows)) - first
        done = np.arange(len(rows)) < seen
        big = np.repeat(sizes > SMALL, sizes)
        if seen:
            big |= first == 0
        sets = rows[:, 2] < 1
        at = np.flatnonzero(sets & ~(done & (place == 0) & (seen > 0)))
        yield 0, rows[at, 0], rows[first[at], 3], rows[at, 3], -rows[at, 2]
        at = np.flatnonzero(big & ~sets & (place > 0) & ~done)
        yield 1, rows[at, 0], rows[first[at], 3], rows[at, 3], rows[at, 2]
        pairs = []
        shared = np.flatnonzero(~sets & (place > 0) & ~done)
        for k in range(SMALL - 1):
            at = shared[(place[shared] > k) & (~big[shared] | (k < FIRST))]
            to = first[at] + k
            x, y = rows[at, 2], rows[to, 2]
            ok = np.minimum(x, y) * 100 >= np.maximum(x, y) * self.percent
            at, to = at[ok], to[ok]
            pairs.append(np.stack([np.minimum(rows[at, 3], rows[to, 3]), np.maximum(rows[at, 3], rows[to, 3])]))
        pairs = np.unique(np.concatenate(pairs, axis=1), axis=1)
        pairs = pairs[:, pairs[0] != pairs[1]]
        yield 2, np.zeros(pairs.shape[1], np.int64), pairs[0], pairs[1], np.zeros(pairs.shape[1], np.int64)


def _meetings(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = _Buckets(percent)

        def out(rows, last):
            for kind, *columns in buckets.take(rows, last):
                if len(columns[0]):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(columns[0]), kind, np.int8)), *map(pa.array, columns)],
                        ["kind", "key", "a", "b", "n"],
                    )

        for batch in batches:
            key, size, doc = (c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns)
            rows = np.stack([key, doc, size, doc], axis=1)  # each id is a member
            if len(rows):
                yield from out(rows, False)
        yield from out(np.zeros((0, 4), np.int64), True)

    return run


def bit_sketch(shingles: np.ndarray) -> np.ndarray:
    """Parities of the shingles per bit, 2 to 4 bits a shingle; a sketch of twice the bits folds into this one."""
    size = 1 << max(6, (2 * len(shingles)).bit_length())
    odd = np.bincount((shingles >> np.uint64(8)) & np.uint64(size - 1), minlength=size) & 1
    return np.packbits(odd.astype(bool), bitorder="little")


def _fold(bits: np.ndarray, size: int) -> np.ndarray:
    while len(bits) > size:
        bits = bits[: len(bits) // 2] ^ bits[len(bits) // 2:]
    return bits


def _sketches(n: int):
    """Texts (doc, text) → (doc, n, bits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            sets = list(words.shingle_sets(batch.column(1), n))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([bit_sketch(s).tobytes() for s in sets], pa.binary())],
                ["doc", "n", "bits"],
            )

    return run


def _close(percent: int):
    """Pairs (a, b, n_a, n_b, bits_a, bits_b) whose sketches are not farther apart than similar sets can be."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            keep = []
            sizes = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())
            for i, ((m, k), x, y) in enumerate(zip(sizes, batch.column(4), batch.column(5))):
                x, y = np.frombuffer(x.as_py(), np.uint8), np.frombuffer(y.as_py(), np.uint8)
                size = min(len(x), len(y))
                apart = int(np.bitwise_count(_fold(x, size) ^ _fold(y, size)).sum())
                if apart <= (m + k) * (100 - percent) // (100 + percent):
                    keep.append(i)
            yield batch.select([0, 1]).take(pa.array(keep, pa.int64()))

    return run


def _verified(percent: int, n: int):
    """Pairs (a, b, text_a, text_b) whose shingle sets are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches, 200):
            keep = []
            for i, (x, y) in enumerate(zip(words.shingle_sets(batch.column(2), n), words.shingle_sets(batch.column(3), n))):
                same = len(np.intersect1d(x, y, assume_unique=True))
                if same and same * 100 >= percent * (len(x) + len(y) - same):
                    keep.append(i)
            yield batch.select([0, 1]).take(pa.array(keep, pa.int64()))

    return run


def _of_pairs(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The texts that the pairs name: few ids are broadcast, many are joined by a shuffle."""
    ids = cut_lineage(pairs.select(F.col("a").alias("doc")).unionAll(pairs.select("b")).distinct())
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return texts.filter("doc is not null").join(ids, "doc", "left_semi")


def close_pairs(pairs: DataFrame, texts: DataFrame, percent: int, n: int) -> DataFrame:
    """The pairs (a, b) whose bit sketches, an eighth of the texts, are no farther apart than those of similar texts."""
    pairs = cut_lineage(pairs)
    bits = cut_lineage(_of_pairs(pairs, texts).mapInArrow(_sketches(n), "doc long, n long, bits binary"))
    left = bits.select(F.col("doc").alias("a"), F.col("n").alias("na"), F.col("bits").alias("x"))
    right = bits.select(F.col("doc").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("y"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "na", "nb", "x", "y")
    return cut_lineage(both.mapInArrow(_close(percent), "a long, b long"))


def verify(pairs: DataFrame, texts: DataFrame, percent: int, n: int) -> DataFrame:
    """The pairs (a, b) whose texts are similar; ``texts`` has doc and text."""
    pairs = cut_lineage(pairs)
    picked = _of_pairs(pairs, texts)
    both = pairs.join(picked.select(F.col("doc").alias("a"), F.col("text").alias("x")), "a")
    both = both.join(picked.select(F.col("doc").alias("b"), F.col("text").alias("y")), "b").select("a", "b", "x", "y")
    return cut_lineage(both.mapInArrow(_verified(percent, n), "a long, b long").distinct())


def linked(pairs: DataFrame, texts: DataFrame, percent: int, n: int) -> DataFrame:
    """Components (id, label) of the similar ones among ``pairs``, those of verifying all of them.

    Of the close pairs, each text's first is verified; of the others only those that would still join two components.
    """
    close = close_pairs(pairs, texts, percent, n)
    labels = cut_lineage(components(verify(close.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), texts, percent, n)))

    def named(end):
        return labels.select(F.col("id").alias(end), F.col("label").alias(f"l{end}"))

    apart = close.join(named("a"), "a", "left").join(named("b"), "b", "left")
    apart = apart.filter(F.coalesce("la", "a") != F.coalesce("lb", "b")).select("a", "b")
    more = verify(apart, texts, percent, n)
    if more.isEmpty():
        return labels
    return cut_lineage(components(labels.select(F.col("id").alias("a"), F.col("label").alias("b")).unionAll(more)))


def _sets(n: int):
    """Texts (doc, text) → (doc, n, shingles), the sorted set as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches, 200):
            sets = list(words.shingle_sets(batch.column(1), n))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())],
                ["doc", "n", "shingles"],
            )

    return run


def _bridges(percent: int):
    """A block of outsiders and one of members (doc, label, shingles) → pairs (a, b) of similar ones that join components.

    An inverted index of the members' shingles counts an outsider's intersections with all of them at once. Labels joined
    on the way are one from then on, so no more pairs come out than there are labels.
    """

    def run(outsiders: pa.Table, members: pa.Table) -> pa.Table:
        found = []
        if len(outsiders) and len(members):
            sets = [np.frombuffer(x.as_py(), np.uint64) for x in members.column("shingles")]
            size = np.array([len(x) for x in sets])
            owner = np.repeat(np.arange(len(sets)), size)
            shingles = np.concatenate(sets)
            order = np.argsort(shingles, kind="stable")
            shingles, owner = shingles[order], owner[order]
            docs = members.column("doc").to_numpy()
            mine = outsiders.column("label").to_numpy()
            names, at = np.unique(np.concatenate([members.column("label").to_numpy(), mine]), return_inverse=True)
            root, label, own = np.arange(len(names)), at[: len(docs)], at[len(docs):]
            for k, (doc, x) in enumerate(zip(outsiders.column("doc").to_pylist(), outsiders.column("shingles"))):
                x = np.frombuffer(x.as_py(), np.uint64)
                low, high = np.searchsorted(shingles, x, "left"), np.searchsorted(shingles, x, "right")
                many = high - low
                inside = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                same = np.bincount(owner[np.repeat(low, many) + inside], minlength=len(sets))
                near = (same * 100 >= percent * (size + len(x) - same)) & (same > 0) & (root[label] != root[own[k]])
                near = np.flatnonzero(near)
                roots, first = np.unique(root[label[near]], return_index=True)
                found += [(doc, int(d)) for d in docs[near[first]]]
                if len(roots):
                    root[np.isin(root, roots)] = root[own[k]]
        a, b = zip(*found) if found else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _neighbours(percent: int):
    """A block of outsiders and one of members (crowd, doc, label, n, bits) → (crowd, doc) of those that are close to some
    one of another component, by the Hamming distance of their bit sketches."""

    def run(outsiders: pa.Table, members: pa.Table) -> pa.Table:
        found: set[int] = set()
        if len(outsiders) and len(members):
            docs, labels, sizes = (members.column(c).to_numpy() for c in ("doc", "label", "n"))
            raw = [np.frombuffer(x.as_py(), np.uint8) for x in members.column("bits")]
            width = np.array([len(x) for x in raw])
            classes = {}
            for w in np.unique(width).tolist():
                at = np.flatnonzero(width == w)
                classes[w] = at, np.stack([raw[i] for i in at])
            folded = {w: np.bitwise_xor(m[:, : w // 2], m[:, w // 2:]) for w, (_, m) in classes.items() if w > 8}
            rows = zip(*(outsiders.column(c).to_pylist() for c in ("doc", "label", "n", "bits")))
            for doc, label, n, bits in rows:
                x = np.frombuffer(bits, np.uint8)
                for w in (len(x) // 2, len(x), 2 * len(x)):
                    if w not in classes:
                        continue
                    at, m = classes[w]
                    m = folded[w] if w > len(x) else m
                    apart = np.bitwise_count(m ^ _fold(x, m.shape[1])).sum(axis=1, dtype=np.int64)
                    near = (apart <= (sizes[at] + n) * (100 - percent) // (100 + percent)) & (labels[at] != label)
                    near &= np.minimum(sizes[at], n) * 100 >= np.maximum(sizes[at], n) * percent
                    if near.any():
                        found.add(doc)
                        found.update(docs[at[near]].tolist())
        crowd = members.column("crowd")[0].as_py() if len(members) else None
        return pa.table({"crowd": pa.array([crowd] * len(found), pa.int64()), "doc": pa.array(sorted(found), pa.int64())})

    return run


def _by_blocks(people: DataFrame, payload: str, shingles: int, meet, schema: str) -> DataFrame:
    """Each crowd's outsiders (``out``) meet all its members, in blocks of about ``shingles`` shingles or one text."""
    blocks = people.groupBy("crowd").agg(
        F.ceil(F.sum("n") / shingles).cast("int").alias("rows"),
        F.ceil(F.sum(F.when(F.col("out"), F.col("n"))) / shingles).cast("int").alias("outs"),
    )
    placed = people.join(blocks.filter("outs > 0"), "crowd")
    mine = F.pmod(F.xxhash64("doc"), F.col("rows")).cast("int")
    all_ = placed.withColumn("row", mine).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("outs") - 1)))
    mine = F.pmod(F.xxhash64("doc"), F.col("outs")).cast("int")
    outs = placed.filter("out").withColumn("part", mine).withColumn("row", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)))
    keys = ["crowd", "part", "row"]
    columns = [*keys, "doc", "label", "n", payload]
    left, right = (df.select(*[F.col(c).alias(c) for c in columns]).groupBy(*keys) for df in (outs, all_))
    return left.cogroup(right).applyInArrow(meet, schema)


def _across(stars: DataFrame, labels: DataFrame, texts: DataFrame, percent: int, n: int) -> DataFrame:
    """Pairs of large buckets' members that still join two components; with them, the components are those of all pairs.

    Buckets whose members are in one component are done. Others with the same smallest member are one crowd, as buckets of
    a group of near copies hold nearly the same texts. In a crowd, at least one side of a link between components is
    outside the component of most members, so blocks of such outsiders meet blocks of all members, however large a crowd
    is: first by bit sketches, then those that are close to another component by their shingles.
    """
    firsts = stars.groupBy("key").agg(F.min("a").alias("doc"))
    members = stars.select("key", F.col("b").alias("doc")).unionAll(firsts.select("key", "doc"))
    members = members.join(labels.withColumnRenamed("id", "doc"), "doc", "left")
    members = cut_lineage(members.select("key", "doc", F.coalesce("label", "doc").alias("label")))
    split = members.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.min("doc").alias("hub"))
    still = members.join(split.filter("x <> y").select("key", "hub"), "key")
    inside = cut_lineage(still.select("doc", "label", F.col("hub").alias("crowd")).distinct())
    bulk = inside.groupBy("crowd", "label").count().groupBy("crowd").agg(F.max_by("label", F.struct("count", "label")).alias("bulk"))
    inside = inside.join(bulk, "crowd").withColumn("out", F.col("label") != F.col("bulk"))
    picked = _of_pairs(inside.select(F.col("doc").alias("a"), F.col("doc").alias("b")), texts)
    bits = cut_lineage(picked.mapInArrow(_sketches(n), "doc long, n long, bits binary"))
    close = _by_blocks(inside.join(bits, "doc"), "bits", 16 * BLOCK_SHINGLES, _neighbours(percent), "crowd long, doc long")
    close = cut_lineage(close.distinct())
    picked = _of_pairs(close.select(F.col("doc").alias("a"), F.col("doc").alias("b")), texts)
    sets = picked.mapInArrow(_sets(n), "doc long, n long, shingles binary")
    people = inside.join(close, ["crowd", "doc"]).join(sets, "doc")
    return _by_blocks(people, "shingles", BLOCK_SHINGLES, _bridges(percent), "a long, b long")


def near_duplicates(
    docs: DataFrame, id: str = "doc_id", text: str = "text", percent: int = 75, n: int = words.SHINGLE
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, class_id (smallest id with the same set), component_id.

    Two texts link when the Jaccard similarity of their sets of ``n``-word shingles is ``percent`` % or more; a component
    is what links reach, named by its smallest id. Other columns of ``docs`` are ignored. A null or empty text has no
    shingles, links with nothing and is its own component; a text of fewer than ``n`` words has its whole sequence as its
    only shingle; a row without id has no component and links nothing. Repeated rows link like any equal texts. An empty
    table gives no rows.

    Members of a bucket meet its first ``FIRST`` members; of larger buckets, only members that are then still in different
    components meet, in blocks that put out no more pairs than components. So near copies are not all paired, yet the
    components are those of all pairs. Equal sets (64-bit hash and size) are found first, and the smallest id stands for them.
    """
    texts = docs.select(F.col(id).cast("long").alias("doc"), F.col(text).cast("string").alias("text"))
    classes = docs.sparkSession.sparkContext.broadcast(heavy_shingles(texts, "text", n))

    def rows(batches):
        yield from _bucket_rows(classes.value, percent, n)(batches)

    named = texts.filter("doc is not null")
    equal = equal_sets(named, n)
    copies = cut_lineage(equal.groupBy("doc").agg(F.bool_and(F.col("doc") != F.col("class_id")).alias("copy")).filter("copy").select("doc"))
    few = F.broadcast(copies) if copies.count() <= BROADCAST_IDS else copies
    members = named.join(few, "doc", "left_anti").select("doc", "text").mapInArrow(rows, "key long, n int, doc long")
    met = cut_lineage(
        members.repartition("key")
        .sortWithinPartitions("key", "doc", "n")
        .mapInArrow(_meetings(percent), "kind byte, key long, a long, b long, n long")
    )
    pairs = met.filter("kind = 2").select("a", "b").distinct()
    labels = linked(pairs, texts, percent, n)
    stars = met.filter("kind = 1")
    if not stars.isEmpty():
        rest = cut_lineage(_across(stars, labels, texts, percent, n))
        if not rest.isEmpty():
            labels = cut_lineage(components(labels.select(F.col("id").alias("a"), F.col("label").alias("b")).unionAll(rest)))
    equal = equal.select(F.col("doc").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), "class_id")
    found = equal.join(labels.withColumnRenamed("id", "class_id"), "class_id", "left").select(
        "doc_id", "n_shingles", "class_id", F.coalesce("label", "class_id").alias("component_id")
    )

    def sizes(batches):
        for batch in _pieces(batches):
            counts = [len(s) for s in words.shingle_sets(batch.column(0), n)]
            yield pa.RecordBatch.from_arrays([pa.array(counts, pa.int64())], ["n_shingles"])

    nameless = texts.filter("doc is null").select("text").mapInArrow(sizes, "n_shingles long")
    none = F.lit(None).cast("long")
    return found.unionByName(
        nameless.select(none.alias("doc_id"), "n_shingles", none.alias("class_id"), none.alias("component_id"))
    )
