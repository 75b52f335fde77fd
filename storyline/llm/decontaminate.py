"""Benchmark passages in documents, by fingerprints of item-sized windows.

A window of as many words as an item is fingerprinted by the signs of its weighted shingle hashes (64 bits). Two
fingerprints within ``RADIUS`` bits agree in one of 8 blocks of 8 bits up to ``RADIUS // 8`` bits, so an index of each
block's values and their neighbours finds all of them. What it finds is verified by the exact similarity of the weighted
shingles. A window that holds no shingle of an item has similarity 0 to it, so only windows around shared shingles are
fingerprinted; that skips nothing. A document of fewer words than the item is one window as a whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyline.llm import words
from storyline.session import cut_lineage

#: At similarity .75 fingerprints differ by 11 bits on average, with a deviation of 3.
RADIUS = 23
BLOCKS = 8
#: Words of items that are broadcast at a time; a larger benchmark is searched in several passes.
ITEM_WORDS = 2_000_000
_GATE_BITS = 20
_WEIGHT = 16
_NEAR = [np.uint8(sum(1 << b for b in bits)) for bits in (
    [()] + [(i,) for i in range(8)] + [(i, j) for i in range(8) for j in range(i)]
)]


def _grams(hashes: np.ndarray, k: int, n: int) -> np.ndarray:
    return words.runs(hashes, k) if k == n else words.mix(words.runs(hashes, k) + np.uint64(k))


def item_grams(hashes: np.ndarray, of: np.ndarray, n: int) -> list[np.ndarray]:
    """The shingles of each item that has words."""
    return [_grams(hashes[a:b], min(n, b - a), n) for a, b in zip(of[:-1].tolist(), of[1:].tolist()) if b > a]


def _common(items: DataFrame, n: int) -> tuple[int, tuple[np.ndarray, np.ndarray]]:
    """The number of items with words, and the sorted shingles that several of them hold with the numbers of those items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                every = [np.unique(g) for g in item_grams(*words.tokens(batch.column(0).slice(at, 1000)), n)]
                grams = np.concatenate(every).view(np.int64) if every else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.concat_arrays([pa.array(grams, pa.int64()), pa.nulls(len(every), pa.int64())])], ["gram"]
                )  # a null for each item

    counts = cut_lineage(items.select("t").mapInArrow(run, "gram long").groupBy("gram").count())
    total = counts.filter("gram is null").first()
    several = counts.filter("gram is not null and count > 1").toArrow()
    grams, many = (several.column(c).to_numpy().astype(np.int64) for c in ("gram", "count"))
    order = np.argsort(grams.view(np.uint64))
    return total["count"] if total else 0, (grams.view(np.uint64)[order], many[order])


class Index:
    """Shingles, weights, fingerprints and block tables of a bounded set of items.

    Weights are those of the whole benchmark: ``total`` items with words, and ``common``, the sorted shingles that several
    of its items hold with the numbers of those items. Any other shingle, known or not, weighs as one that one item holds.
    Without them, the items are the whole benchmark.
    """

    def __init__(self, items: list[tuple[int, str]], n: int = words.SHINGLE, total: int | None = None, common=None):
        self.n = n
        hashes, of = words.tokens(pa.array([t for _, t in items], pa.string()))
        sizes = np.diff(of)
        keep = np.flatnonzero(sizes)
        self.ids = [items[i][0] for i in keep]
        self.sizes = sizes[keep]
        grams = item_grams(hashes, of, n)
        every = [np.unique(g) for g in grams]
        flat = np.concatenate(every) if every else np.zeros(0, np.uint64)
        self.known, items_with = np.unique(flat, return_counts=True)
        if common is None:
            total, common = len(self.ids), (self.known[items_with > 1], items_with[items_with > 1])
        self.common = common[0]
        self.weight = np.maximum(1, np.round(_WEIGHT * np.log2(1 + total / common[1]))).astype(np.int64)
        self.other = max(1, round(_WEIGHT * np.log2(1 + total)))
        self.gate = np.zeros(1 << _GATE_BITS, bool)
        self.gate[self.known & np.uint64((1 << _GATE_BITS) - 1)] = True
        self.counted = [dict(zip(*(x.tolist() for x in np.unique(g, return_counts=True)))) for g in grams]
        self.prints = np.array([self.fingerprints(g, np.zeros(1, np.int64), len(g))[0] for g in grams], np.uint64)
        pairs = {(int(s), x) for m, g in zip(self.sizes, every) for s, x in zip([m] * len(g), g.tolist())}
        by = {}
        for m, x in pairs:
            by.setdefault(m, []).append(x)
        self.by_size = {m: np.sort(np.array(x, np.uint64)) for m, x in by.items()}
        self.tables = {m: self._table(np.flatnonzero(self.sizes == m)) for m in self.by_size}

    def grams(self, hashes: np.ndarray, k: int) -> np.ndarray:
        """Runs of ``k`` words; runs shorter than a shingle stand for whole items of that length and hash apart."""
        return _grams(hashes, k, self.n)

    def held(self, grams: np.ndarray) -> np.ndarray:
        """Positions of shingles that some item holds: a bitmap passes few others, a search the items' alone."""
        at = np.flatnonzero(self.gate[grams & np.uint64((1 << _GATE_BITS) - 1)])
        if not len(at):
            return at
        place = np.minimum(np.searchsorted(self.known, grams[at]), len(self.known) - 1)
        return at[self.known[place] == grams[at]]

    def weights(self, grams: np.ndarray) -> np.ndarray:
        if not len(self.common):
            return np.full(len(grams), self.other)
        at = np.minimum(np.searchsorted(self.common, grams), len(self.common) - 1)
        return np.where(self.common[at] == grams, self.weight[at], self.other)

    def fingerprints(self, grams: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
        """Signs of the weighted bit sums of the ``width`` shingles from each start on."""
        bits = ((grams[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).astype(np.int64) * 2 - 1
        sums = np.zeros((len(grams) + 1, 64), np.int64)
        np.cumsum(bits * self.weights(grams)[:, None], axis=0, out=sums[1:])
        signs = sums[starts + width] - sums[starts] > 0
        return np.packbits(signs, axis=1, bitorder="little").view(np.uint64).ravel()

    def _table(self, items: np.ndarray):
        """Per block: the items whose value, up to ``RADIUS // BLOCKS`` bits, is each of 256."""
        blocks = self.prints[items].view(np.uint8).reshape(len(items), BLOCKS)
        out = []
        for b in range(BLOCKS):
            values = np.concatenate([blocks[:, b] ^ d for d in _NEAR])
            owners = np.tile(items, len(_NEAR))
            order = np.argsort(values, kind="stable")
            out.append((np.searchsorted(values[order], np.arange(257)), owners[order]))
        return out

    def similarity(self, grams: np.ndarray, item: int) -> float:
        """Weighted Jaccard similarity of the shingles, with their numbers of occurrences."""
        mine = dict(zip(*(x.tolist() for x in np.unique(grams, return_counts=True))))
        its = self.counted[item]
        keys = np.array(list(mine.keys() | its.keys()), np.uint64)
        weight = self.weights(keys).tolist()
        low = sum(w * min(mine.get(k, 0), its.get(k, 0)) for k, w in zip(keys.tolist(), weight))
        high = sum(w * max(mine.get(k, 0), its.get(k, 0)) for k, w in zip(keys.tolist(), weight))
        return low / high

    def search(self, hashes: np.ndarray, grams: np.ndarray, threshold: float) -> list[tuple[int, int, int, int, float]]:
        """(item, first word, words, differing bits, similarity) of each item's best window in one text."""
        best: dict[int, tuple] = {}
        for m, shingles in self.by_size.items():
            k = min(self.n, m)
            own = grams if k == self.n else self.grams(hashes, k)
            if not len(own):
                continue
            at = np.minimum(np.searchsorted(shingles, own), len(shingles) - 1)
            hits = np.flatnonzero(shingles[at] == own)
            if not len(hits):
                continue
            long = min(m, len(hashes))  # a shorter document is the one window
            width = long - k + 1
            covers = np.zeros(len(own) + 1, np.int64)
            np.add.at(covers, np.maximum(hits - width + 1, 0), 1)
            np.add.at(covers, hits + 1, -1)
            starts = np.flatnonzero(np.cumsum(covers)[: len(hashes) - long + 1] > 0)
            for run in np.split(starts, np.flatnonzero(np.diff(starts) > width) + 1):
                if not len(run):
                    continue
                part = own[run[0]:run[-1] + width]
                prints = self.fingerprints(part, run - run[0], width)
                blocks = prints.view(np.uint8).reshape(len(prints), BLOCKS)
                found = []
                for b, (offsets, owners) in enumerate(self.tables[m]):
                    low, high = offsets[blocks[:, b]], offsets[blocks[:, b].astype(int) + 1]
                    many = high - low
                    window = np.repeat(np.arange(len(run)), many)
                    inside = np.arange(len(window)) - np.repeat(np.cumsum(many) - many, many)
                    found.append(np.stack([window, owners[np.repeat(low, many) + inside]]))
                window, item = np.unique(np.concatenate(found, axis=1), axis=1)
                apart = np.bitwise_count(prints[window] ^ self.prints[item])
                ok = apart <= RADIUS
                for w, i, d in zip(window[ok].tolist(), item[ok].tolist(), apart[ok].tolist()):
                    s = int(run[w])
                    like = self.similarity(own[s:s + width], i)
                    if like >= threshold and (i not in best or (like, -s) > (best[i][4], -best[i][1])):
                        best[i] = (i, s, long, d, like)
        return [best[i] for i in sorted(best)]


def _search(index: Index, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        short = sorted({int(m) for m in index.sizes if m < index.n})
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                piece = batch.slice(at, 1000)
                hashes, of = words.tokens(piece.column(1))
                rows = []
                grams = words.runs(hashes, index.n)
                hit = index.held(grams)
                for k in short:
                    hit = np.append(hit, index.held(index.grams(hashes, k)))
                for d in np.unique(np.searchsorted(of, hit, "right") - 1).tolist():
                    a, b = int(of[d]), int(of[d + 1])
                    for i, *what in index.search(hashes[a:b], grams[a:max(a, b - index.n + 1)], threshold):
                        rows.append((piece.column(0)[d].as_py(), index.ids[i], *what))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(
                        zip(*rows) if rows else [[]] * 6,
                        [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.float64()],
                    )],
                    ["doc_id", "item_id", "first_word", "n_words", "bits", "similarity"],
                )

    return run


def benchmark_hits(
    docs: DataFrame,
    items: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    threshold: float = 0.75,
    n: int = words.SHINGLE,
) -> DataFrame:
    """Rows (doc_id, item_id, first_word, n_words, bits, similarity): each item's best window in each document that has one.

    A window has the item's number of words, or all words of a document that has fewer. Items of fewer
    than ``n`` words have their whole sequence as one shingle; items without words, and null or empty texts, match nothing. Items with the same text match apiece; repeated documents give repeated rows; other columns are
    ignored; empty tables give no rows; a null id comes out null.

    The documents are not shuffled: the items are broadcast, up to ``ITEM_WORDS`` words at a time. Shingles are weighted by
    their numbers of items in the whole benchmark, so results do not depend on the passes; for that each pass also holds
    the shingles that several items share (16 bytes each).
    """
    items = items.select(F.col(item_id).cast("long").alias("i"), F.col(item_text).cast("string").alias("t"))
    letters = items.agg(F.sum(F.length("t"))).first()[0] or 0
    passes = 1 + int(letters) // (2 * ITEM_WORDS)
    docs = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    whole = _common(items, n) if passes > 1 else (None, None)
    out = []
    for k in range(passes):
        part = items.filter(F.pmod(F.xxhash64("i", "t"), F.lit(passes)) == k).orderBy("i", "t").collect()
        index = Index([(r.i, r.t) for r in part], n, *whole)
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches, shared=shared):
            yield from _search(shared.value, threshold)(batches)

        out.append(docs.mapInArrow(
            run, "doc_id long, item_id long, first_word long, n_words long, bits int, similarity double"
        ))
    return reduce(DataFrame.unionAll, out)
