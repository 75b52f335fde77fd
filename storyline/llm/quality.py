"""A quality classifier: histogram gradient-boosted trees over statistics of a text.

The statistics are computed per text with numpy inside tasks. Trees are trained on a bounded sample of labelled rows and
flattened into arrays (feature, threshold bin, children, value), so that scoring walks all rows of a batch down a tree with
one array step per level.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyline.llm import words
from storyline.session import cut_lineage

FEATURES = (
    "log_bytes", "log_words", "word_bytes", "long_words", "upper", "digit", "space", "punctuation", "symbol", "other",
    "newlines", "distinct_words", "top_word", "distinct_pairs", "distinct_runs", "first_upper", "all_upper", "repeat_next",
    "digit_words", "marked_words", "symbol_kinds", "entropy", "word_spread", "sentence_ends", "line_bytes",
)
#: Labelled rows that the trees learn from at most (200 bytes each).
SAMPLE = 30_000
ROWS = 500
_PUNCTUATION = np.frombuffer(b".,;:!?'\"()-", np.uint8)
_ENDS = np.frombuffer(b".!?", np.uint8)


def _per(of: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of ``values`` over the ranges between offsets, empty ranges included."""
    sums = np.concatenate(([0], np.cumsum(values, dtype=np.float64)))
    return sums[of[1:]] - sums[of[:-1]]


def _distinct(of: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of distinct values in each range, and the occurrences of the most frequent one."""
    n = len(of) - 1
    bits = np.uint64(64 - max(1, n.bit_length()))
    owner = np.repeat(np.arange(n, dtype=np.uint64), np.diff(of))
    keys = np.sort((owner << bits) | (hashes >> (np.uint64(64) - bits)))
    new = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    owner, counts = (keys[new] >> bits).astype(np.int64), np.diff(np.append(new, len(keys)))
    top = np.zeros(n)
    np.maximum.at(top, owner, counts)
    return np.bincount(owner, minlength=n).astype(float), top


def statistics(column: pa.Array) -> np.ndarray:
    """One row of ``FEATURES`` per text, of its whole length. A null counts as an empty text."""
    raw, at = words.utf8(column)
    first, past, of = words.word_bounds(raw, at)
    hashes = words.word_hashes(raw, first, past)
    size = np.diff(at).astype(float)
    n = np.diff(of).astype(float)
    bytes_, count = np.maximum(size, 1), np.maximum(n, 1)
    table = np.zeros(256, np.int8)  # 0 letters, 1 upper, 2 digit, 3 space, 4 punctuation, 5 other sign, 6 beyond ASCII
    table[:128] = 5
    table[128:] = 6
    table[np.frombuffer(b"abcdefghijklmnopqrstuvwxyz", np.uint8)] = 0
    table[0x41:0x5B], table[0x30:0x3A], table[_PUNCTUATION] = 1, 2, 4
    table[[0x20, *range(9, 14)]] = 3
    kind = table[raw]
    grid = np.stack([np.bincount(raw[a:b], minlength=256) for a, b in zip(at[:-1], at[1:])]) if len(size) else np.zeros((0, 256))
    share = {k: grid[:, table == k].sum(axis=1) / bytes_ for k in range(1, 7)}
    length = (past - first).astype(float)
    ahead = kind[first] if len(first) else np.zeros(0, np.int8)
    upper, digits, signs = (np.concatenate(([0], np.cumsum(kind == k, dtype=np.int32))) for k in (1, 2, 5))
    pairs = words.runs(hashes, 2)
    runs = words.runs(hashes, 5)

    def inner(k: int) -> np.ndarray:
        """Offsets of the runs of ``k`` words that lie in one text, after dropping the others."""
        return np.concatenate(([0], np.cumsum(np.maximum(n - k + 1, 0)))).astype(np.int64)

    def inside(values: np.ndarray, k: int) -> np.ndarray:
        owner = np.repeat(np.arange(len(n)), np.diff(of))[: len(values)]
        return values[np.arange(len(values)) + k <= of[1:][owner]] if len(values) else values

    words_of, top = _distinct(of, hashes)
    pairs_of, _ = _distinct(inner(2), inside(pairs, 2))
    runs_of, _ = _distinct(inner(5), inside(runs, 5))
    same = np.concatenate((hashes[1:] == hashes[:-1], [False])) if len(hashes) else np.zeros(0, bool)
    if len(of) > 1 and len(hashes):
        same[np.maximum(of[1:] - 1, 0)] = False
    p = grid / bytes_[:, None]
    entropy = -np.sum(p * np.log2(np.maximum(p, 1e-12)), axis=1)
    mean = _per(of, length) / count
    spread = np.sqrt(np.maximum(_per(of, length**2) / count - mean**2, 0))
    lines, ends = grid[:, 0x0A], grid[:, _ENDS].sum(axis=1)
    return np.stack([
        np.log1p(size), np.log1p(n), mean, _per(of, length > 20) / count, share[1], share[2], share[3], share[4], share[5],
        share[6], lines / count, words_of / count, top / count, pairs_of / np.maximum(n - 1, 1),
        runs_of / np.maximum(n - 4, 1), _per(of, ahead == 1) / count,
        _per(of, (upper[past] - upper[first] > 1) & (upper[past] - upper[first] >= 0.8 * length)) / count,
        _per(of, same) / count, _per(of, digits[past] > digits[first]) / count, _per(of, signs[past] > signs[first]) / count,
        (grid[:, table == 5] > 0).sum(axis=1).astype(float), entropy, spread,
        ends / count, size / (lines + 1),
    ], axis=1)


@dataclass
class Trees:
    """Boosted trees as arrays: node 2i+1 and 2i+2 of a tree are the children of node i; ``feature`` < 0 ends a path."""

    edges: list[np.ndarray]
    base: float
    feature: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.int16))
    cut: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.uint8))
    value: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))

    def bins(self, x: np.ndarray) -> np.ndarray:
        columns = [np.searchsorted(e, x[:, k], "right") for k, e in enumerate(self.edges)]
        return np.stack(columns, axis=1).astype(np.uint8) if columns else np.zeros((len(x), 0), np.uint8)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 of each row, all rows of the batch going down each tree together."""
        binned, rows = self.bins(x), np.arange(len(x))
        total = np.full(len(x), self.base)
        for feature, cut, value in zip(self.feature, self.cut, self.value):
            node = np.zeros(len(x), np.int64)
            while True:
                on = feature[node] >= 0
                if not on.any():
                    break
                right = binned[rows, np.maximum(feature[node], 0)] > cut[node]
                node = np.where(on, 2 * node + 1 + right, node)
            total += value[node]
        return 1 / (1 + np.exp(-total))


def train(x: np.ndarray, y: np.ndarray, rounds: int = 120, depth: int = 4, rate: float = 0.1, bins: int = 64, least: int = 20) -> Trees:
    """Trees for the logistic loss; every split is the best cut of a feature's histogram of gradients.

    Labels of one kind only, or none, give a constant score: the smoothed share of label 1.
    """
    share = (y.sum() + 1) / (len(y) + 2)
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1])) for k in range(x.shape[1])] if len(x) else []
    trees = Trees(edges, float(np.log(share / (1 - share))))
    if not 0 < y.sum() < len(y):
        return trees
    binned = trees.bins(x).astype(np.int64)
    flat = binned + np.arange(x.shape[1]) * bins
    raw = np.full(len(y), trees.base)
    nodes = 2 ** (depth + 1) - 1
    shape = (rounds, nodes)
    trees.feature, trees.cut, trees.value = np.full(shape, -1, np.int16), np.zeros(shape, np.uint8), np.zeros(shape)
    for t in range(rounds):
        p = 1 / (1 + np.exp(-raw))
        g, h = y - p, p * (1 - p)
        at = np.zeros(len(y), np.int64)
        for node in range(nodes):
            rows = np.flatnonzero(at == node)
            if not len(rows):
                continue
            trees.value[t, node] = rate * g[rows].sum() / (h[rows].sum() + 1.0)
            if 2 * node + 2 >= nodes or len(rows) < 2 * least:
                continue
            cells = flat[rows].ravel()
            sums = [
                np.bincount(cells, np.repeat(w[rows], x.shape[1]), minlength=x.shape[1] * bins).reshape(-1, bins).cumsum(axis=1)
                for w in (g, h, np.ones(len(y)))
            ]
            (gl, hl, nl), (gt, ht, nt) = sums, [s[:, -1:] for s in sums]
            gain = gl**2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt**2 / (ht + 1)
            gain[(nl < least) | (nt - nl < least)] = 0
            best = int(gain.argmax())
            if gain.flat[best] <= 1e-6:
                continue
            k, cut = divmod(best, bins)
            trees.feature[t, node], trees.cut[t, node] = k, cut
            at[rows] = 2 * node + 1 + (binned[rows, k] > cut)
        raw += trees.value[t, at]
    return trees


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (text, y) → (x, y) with the text's statistics."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            piece = batch.slice(at, ROWS)
            values = pa.array(statistics(piece.column(0)).ravel())
            x = pa.FixedSizeListArray.from_arrays(values, len(FEATURES)).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([x, piece.column(1)], ["x", "y"])


def fit(
    docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "quality", held_out=None,
    sample: int = SAMPLE, seed: int = 0,
) -> Trees:
    """Trees from the documents of at most ``sample`` labels, those first in a seeded order; only these are measured.

    ``held_out`` is a condition on the id column whose rows are never learnt from. The bound is what one process holds and
    what is broadcast. Null ids, labels other than 0 and 1, and labels without a document teach nothing.
    """
    out = F.lit(False) if held_out is None else F.coalesce(held_out(F.col("doc_id")), F.lit(False))
    marked = labels.select(F.col(id).cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
    marked = marked.filter("doc_id is not null and y in (0, 1)").filter(~out)
    first = cut_lineage(marked.orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id", "y").limit(sample))
    texts = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    known = texts.join(F.broadcast(first), "doc_id").select("text", "y").mapInArrow(_measure, "x array<double>, y int").toArrow()
    x = known.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
    y = known.column("y").to_numpy().astype(np.float64)
    order = np.lexsort((*x.T, y))  # rows may come in any order; sums of gradients shall not differ
    return train(x[order], y[order])


def _scores(trees: Trees, column: pa.Array) -> np.ndarray:
    parts = [trees.score(statistics(column.slice(at, ROWS))) for at in range(0, len(column), ROWS)]
    return np.concatenate(parts) if parts else np.zeros(0)


def quality_scores(
    docs: DataFrame,
    labels: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    held_out=None,
    sample: int = SAMPLE,
    threshold: float = 0.7,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score (0 to 1), predicted (1 from ``threshold`` on).

    Learns as ``fit`` says. Null and empty texts are scored like any text; null ids and repeated rows are rows of their own;
    other columns are ignored. Without labels the score is 0.5; an empty table gives no rows. No shuffle of documents.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, id, text, label, held_out, sample))
    texts = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    out = F.lit(False) if held_out is None else F.coalesce(held_out(F.col("doc_id")), F.lit(False))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = pa.array(_scores(model.value, batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), scores], ["doc_id", "score"])

    scored = texts.mapInArrow(score, "doc_id long, score double")
    return scored.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(
    docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "quality",
    sample: int = SAMPLE, threshold: float = 0.7,
) -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores ``threshold`` or more; without usable labels, all rows."""
    trees = fit(docs, labels, id, text, label, sample=sample)
    if not len(trees.feature):
        return docs
    model, place = docs.sparkSession.sparkContext.broadcast(trees), docs.columns.index(text)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_scores(model.value, batch.column(place)) >= threshold))

    return docs.mapInArrow(keep, docs.schema)
