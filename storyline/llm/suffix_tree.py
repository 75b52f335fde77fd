"""Language-model scores from a probabilistic suffix tree over the characters of word sequences.

A text is its words, A-Z lower-cased, each closed by a space, and an end. Characters are symbols of a 64-letter alphabet:
end, space, the most frequent bytes, and one symbol for all other bytes. Contexts of up to ``DEPTH`` symbols are counted
over the whole corpus. A context becomes a state when its next-symbol counts diverge from those of its longest proper
suffix by more bits than its parameters cost, and so do its suffixes. A state's distribution is smoothed towards its
suffix's, and a symbol is scored by the longest suffix of its history that is a state. The probability of a whole word (or
the end) is the mean of what the tree and what the smoothed counts of whole words give it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyline.llm import words
from storyline.session import cut_lineage

DEPTH = 5
LETTERS = 64
END, SPACE, OTHER = 0, 1, 63
#: States that are broadcast at a time (512 bytes each); a larger tree is split by the two nearest symbols of its contexts
#: and scores in several passes. The contexts that end in two given symbols are 266,305 at most, so every part fits.
STATES = 300_000
#: States up to which they are broadcast to pick their counts (16 bytes each); more are joined by a shuffle.
BROADCAST_STATES = 1_000_000
#: Words with the most occurrences, whose counts are broadcast (16 bytes each); all others' counts are joined.
FREQUENT = 1 << 18
#: Distinct keys that a task counts before it hands them on.
HELD = 2_000_000
ROWS = 500


@dataclass
class Alphabet:
    symbol: np.ndarray  # of each byte
    spread: float  # log10 of the share of one byte among those of OTHER

    @classmethod
    def of(cls, counts: np.ndarray) -> Alphabet:
        counts = counts.copy()
        counts[0x61:0x7B] += counts[0x41:0x5B]
        counts[0x41:0x5B] = 0
        counts[[0x20, *range(9, 14)]] = 0
        order = np.argsort(-counts, kind="stable")[: OTHER - SPACE - 1]
        symbol = np.full(256, OTHER, np.uint8)
        symbol[order] = np.arange(SPACE + 1, SPACE + 1 + len(order))
        symbol[0x41:0x5B] = symbol[0x61:0x7B]
        return cls(symbol, -float(np.log10(256 - len(order))))


def streams(raw, first, past, of, alphabet: Alphabet) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of all texts in a row, ``DEPTH`` ends before each as its history; offsets of the histories, and of the words."""
    n, size = len(of) - 1, (past - first)
    before = np.concatenate(([0], np.cumsum(size + 1)))[of]  # symbols of the words of earlier texts
    start = before + np.arange(n + 1) * (DEPTH + 1)
    out = np.full(int(start[-1]), END, np.uint8)
    place = np.repeat(np.arange(1, n + 1) * DEPTH + np.arange(n), np.diff(of))
    at = np.concatenate(([0], np.cumsum(size + 1)))[:-1] + place  # where each word goes
    gap = at + size
    out[gap] = SPACE
    inside = np.zeros(len(raw) + 1, np.int8)
    inside[first] += 1
    inside[past] -= 1
    chars = raw[np.cumsum(inside[:-1]).astype(bool)]
    move = np.arange(len(chars)) + np.repeat(at - (np.cumsum(size) - size), size)
    out[move] = alphabet.symbol[chars]
    return out, start, at


def contexts(symbols: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """For each position the ``depth`` symbols before it, the nearest in the lowest 6 bits."""
    out = np.zeros(len(symbols), np.int64)
    for k in range(depth):
        out[k + 1:] |= symbols[: len(symbols) - k - 1].astype(np.int64) << (6 * k)
    return out


def _scored(symbols: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Which positions are symbols of a text, not history."""
    history = np.zeros(len(symbols) + 1, np.int32)
    history[start[:-1]] += 1
    np.add.at(history, start[:-1] + DEPTH, -1)
    return np.cumsum(history[:-1]) == 0


class _Counter:
    """Counts of int64 keys; hands them on when many are held."""

    def __init__(self, kind: int):
        self.kind, self.parts, self.held = kind, [], 0

    def add(self, keys: np.ndarray):
        keys, counts = np.unique(keys, return_counts=True)
        self.parts.append((keys, counts))
        self.held += len(keys)
        if self.held > HELD:
            self.merge()
            if self.held > HELD // 2:
                yield from self.flush()

    def merge(self):
        keys = np.concatenate([k for k, _ in self.parts])
        counts = np.concatenate([c for _, c in self.parts])
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        new = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        self.parts = [(keys[new], np.add.reduceat(counts, new))]
        self.held = len(new)

    def flush(self):
        if self.held:
            self.merge()
            keys, counts = self.parts[0]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(keys), self.kind, np.int8)), pa.array(keys), pa.array(counts.astype(np.int64))],
                ["kind", "key", "n"],
            )
        self.parts, self.held = [], 0


def _pieces(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def _byte_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(256, np.int64)
    for piece in _pieces(batches):
        raw, _ = words.utf8(piece.column(0))
        for at in range(0, len(raw), words.PIECE):
            counts += np.bincount(raw[at:at + words.PIECE], minlength=256)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(256, dtype=np.int32)), pa.array(counts)], ["b", "n"])


def _corpus_counts(alphabet: Alphabet):
    """Texts → (kind, key, n): kind 0 words, 1 contexts with their next symbol, 2 texts and tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word, gram, texts = _Counter(0), _Counter(1), 0
        for piece in _pieces(batches):
            raw, at = words.utf8(piece.column(0))
            first, past, of = words.word_bounds(raw, at)
            texts += piece.num_rows
            yield from word.add(words.word_hashes(raw, first, past).view(np.int64))
            symbols, start, _ = streams(raw, first, past, of, alphabet)
            keys = contexts(symbols) | (symbols.astype(np.int64) << (6 * DEPTH))
            yield from gram.add(keys[_scored(symbols, start)])
        yield from word.flush()
        yield from gram.flush()
        yield pa.RecordBatch.from_arrays(
            [pa.array([2], pa.int8()), pa.array([0], pa.int64()), pa.array([texts], pa.int64())], ["kind", "key", "n"]
        )

    return run


def select_states(grams: DataFrame) -> DataFrame:
    """Rows (depth, context, symbol, n) of the root and of all contexts that are states.

    ``grams``: (context of ``DEPTH`` symbols, symbol, n). A context with k next symbols is a state when its counts,
    coded by its own shares rather than by its suffix's, save more than k bits.
    """
    levels = [grams]
    for d in range(DEPTH - 1, -1, -1):
        cut = F.col("context").bitwiseAND(F.lit((1 << (6 * d)) - 1)).alias("context")
        levels.append(cut_lineage(levels[-1].groupBy(cut, "symbol").agg(F.sum("n").alias("n"))))
    levels.reverse()
    gains = []
    for d in range(1, DEPTH + 1):
        own, above = levels[d], levels[d - 1]
        total = own.groupBy("context").agg(F.sum("n").alias("total"))
        wider = above.groupBy("context").agg(F.sum("n").alias("wide"))
        up = F.col("context").bitwiseAND(F.lit((1 << (6 * (d - 1))) - 1))
        pairs = own.withColumn("up", up).join(
            above.select(F.col("context").alias("up"), "symbol", F.col("n").alias("m")), ["up", "symbol"]
        )
        parts = pairs.groupBy("context", "up").agg(
            F.sum(F.col("n") * F.log2(F.col("n") / F.col("m"))).alias("part"), F.count("*").alias("k")
        )
        saved = F.col("part") + F.col("total") * F.log2(F.col("wide") / F.col("total"))
        gains.append(
            parts.join(total, "context").join(wider.select(F.col("context").alias("up"), "wide"), "up")
            .select(F.lit(d).alias("depth"), "context", (saved - F.col("k")).alias("gain"))
            .filter("gain > 0")
        )
    best = cut_lineage(reduce(DataFrame.unionAll, gains).select("depth", "context"))
    sized = F.broadcast if best.count() <= BROADCAST_STATES else (lambda c: c)
    chosen = [grams.select(F.lit(0).alias("depth"), F.lit(0).cast("long").alias("context")).limit(1)]
    for d in range(1, DEPTH + 1):
        cut = F.col("context").bitwiseAND(F.lit((1 << (6 * d)) - 1)).alias("context")
        chosen.append(best.filter(F.col("depth") >= d).select(F.lit(d).alias("depth"), cut).distinct())
    return reduce(DataFrame.unionAll, [
        sized(c).join(level, "context").select("depth", "context", "symbol", "n") for c, level in zip(chosen, levels)
    ])


def _parts(chosen: DataFrame, states: int) -> list[tuple[DataFrame, np.ndarray | None]]:
    """The rows of ``select_states`` in parts of up to ``states`` states: all of them, or by the two nearest symbols."""
    pair = F.col("context").bitwiseAND(F.lit((1 << 12) - 1))
    deep = chosen.filter("depth > 1").select("depth", "context").distinct().groupBy(pair.alias("pair")).count()
    sizes = [(r["pair"], r["count"]) for r in deep.orderBy("pair").collect()]
    if sum(k for _, k in sizes) + LETTERS + 1 <= states:
        return [(chosen, None)]
    parts, room = [], 0
    for p, k in sizes:
        if k > room:
            parts.append([])
            room = states - LETTERS - 1
        parts[-1].append(p)
        room -= k
    out = []
    for i, some in enumerate(parts):
        mask = np.zeros(1 << 12, bool) if i else np.ones(1 << 12, bool)  # pairs without states go with the first part
        mask[[p for other in parts[1:] for p in other]] = False
        mask[some] = True
        out.append((chosen.filter((F.col("depth") < 2) | pair.isin(some)), mask))
    return out


@dataclass
class Tree:
    """States as arrays: ``child[i, s]`` is the state that extends state i's context by the earlier symbol s, or -1.

    ``pairs``: the two nearest symbols of the histories that this part of a tree scores; others are scored 0. None: all.
    """

    alphabet: Alphabet
    child: np.ndarray
    log10: np.ndarray
    pairs: np.ndarray | None = None

    @classmethod
    def build(cls, alphabet: Alphabet, depth, context, symbol, n, pairs=None) -> Tree:
        return cls.of_batches(alphabet, [((depth.astype(np.int64) << 58) | context, symbol, n)], pairs)

    @classmethod
    def of_batches(cls, alphabet: Alphabet, batches: list, pairs=None) -> Tree:
        """From arrays (key, symbol, n), the key being the depth above 58 bits of context; no array of all rows is made."""
        states = np.unique(np.concatenate([np.zeros(1, np.int64), *(np.unique(key) for key, _, _ in batches)]))
        share = np.zeros((len(states), LETTERS), np.float32)  # counts, then shares, then their logarithms, all in place
        for key, symbol, n in batches:
            np.add.at(share, (np.searchsorted(states, key), symbol), n)
        level, code = states >> 58, states & ((1 << 58) - 1)
        child = np.full((max(1, int((level < DEPTH).sum())), LETTERS), -1, np.int32)  # the deepest have none
        share[0] = (share[0] + 1.0 / LETTERS) / (share[0].sum(dtype=np.float64) + 1.0)
        for d in range(1, DEPTH + 1):
            every = np.flatnonzero(level == d)
            for at in (every[i:i + 4096] for i in range(0, len(every), 4096)):
                up = np.searchsorted(states, ((d - 1) << 58) | (code[at] & ((1 << (6 * (d - 1))) - 1)))
                child[up, code[at] >> (6 * (d - 1))] = at
                counts = share[at].astype(np.float64)
                total, kinds = counts.sum(axis=1, keepdims=True), (counts > 0).sum(axis=1, keepdims=True)
                share[at] = (counts + kinds * share[up]) / (total + kinds)
        np.log10(share, out=share)
        share[:, OTHER] += alphabet.spread
        return cls(alphabet, child, share, pairs)

    def symbol_scores(self, symbols: np.ndarray) -> np.ndarray:
        """log10 probability of each symbol given the longest suffix of its history that is a state."""
        state = np.zeros(len(symbols), np.int32)
        mine = None if self.pairs is None else self.pairs[contexts(symbols, 2)]
        on = np.arange(len(symbols)) if mine is None else np.flatnonzero(mine)
        for k in range(1, DEPTH + 1):
            on = on[on >= k]
            deeper = self.child[state[on], symbols[on - k]]
            keep = deeper >= 0
            on, deeper = on[keep], deeper[keep]
            state[on] = deeper
        values = self.log10[state, symbols]
        return values if mine is None else np.where(mine, values, np.float32(0))


def _spellings(tree: Tree, raw, first, past, of) -> tuple[np.ndarray, np.ndarray]:
    """log10 probability of each word, and of each text's end, as far as the tree scores their symbols."""
    symbols, start, at = streams(raw, first, past, of, tree.alphabet)
    values = tree.symbol_scores(symbols)
    spelled = np.add.reduceat(values, np.stack([at, at + past - first + 1], axis=1).ravel(), dtype=np.float64)[::2] if len(at) else at.astype(float)
    return spelled, values[start[1:] - 1].astype(np.float64)


def _earlier(column: pa.Array, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What earlier parts gave each word and each text's end, from lists of a text's words and then its end."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    ends = of[1:] + np.arange(len(of) - 1)
    return np.delete(flat, ends), flat[ends]


def _partly_spelled(tree: Tree):
    """Rows (doc, text[, spelled]) → (doc, text, spelled): with the scores of a part of the tree added."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in _pieces(batches):
            raw, at = words.utf8(piece.column(1))
            first, past, of = words.word_bounds(raw, at)
            spelled, ends = _spellings(tree, raw, first, past, of)
            if piece.num_columns > 2:
                more, last = _earlier(piece.column(2), of)
                spelled, ends = spelled + more, ends + last
            lists = of + np.arange(len(of))
            flat = pa.array(np.insert(spelled, of[1:], ends))
            yield pa.RecordBatch.from_arrays(
                [piece.column(0), piece.column(1), pa.ListArray.from_arrays(pa.array(lists.astype(np.int32)), flat)],
                ["doc_id", "text", "spelled"],
            )

    return run


def _scores(tree: Tree, common: np.ndarray, counts: np.ndarray, texts: int, total: int, kinds: int):
    """Rows (doc, text[, spelled]) → (row, doc, n_tokens, known, base, score, rare, spelled): rare words are still to be counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        floor = np.log10(total + kinds + 1.0)
        for piece in _pieces(batches):
            raw, at = words.utf8(piece.column(1))
            first, past, of = words.word_bounds(raw, at)
            hashes = words.word_hashes(raw, first, past).view(np.int64)
            place = np.minimum(np.searchsorted(common, hashes), max(0, len(common) - 1))
            found = common[place] == hashes if len(common) else np.zeros(len(hashes), bool)
            logs = np.where(found, np.log10(counts[place] + 1.0) - floor, 0.0) if len(common) else np.zeros(len(hashes))
            end = np.log10(texts + 1.0) - floor
            known = _sums(of, found).astype(np.int64) + (texts > 0)
            spelled, ends = _spellings(tree, raw, first, past, of)
            if piece.num_columns > 2:
                more, last = _earlier(piece.column(2), of)
                spelled, ends = spelled + more, ends + last
            rare = np.flatnonzero(~found)
            offsets = np.searchsorted(rare, of)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(row + np.arange(piece.num_rows)), piece.column(0), pa.array(np.diff(of) + 1), pa.array(known),
                    pa.array(_sums(of, logs) + end), pa.array(_sums(of, np.where(found, _mean(logs, spelled), 0.0)) + _mean(end, ends)),
                    *(pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(v[rare])) for v in (hashes, spelled)),
                ],
                ["row", "doc_id", "n_tokens", "known", "base", "score", "rare", "spelled"],
            )
            row += piece.num_rows

    return run


def _mean(x, y):
    """log10 of the mean of two probabilities given as log10."""
    return np.logaddexp2(x / np.log10(2), y / np.log10(2)) * np.log10(2) - np.log10(2)


def _sums(of: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between offsets, each range by itself, so that no text's rounding touches another's."""
    out = np.zeros(len(of) - 1)
    some = np.flatnonzero(np.diff(of) > 0)
    if len(some):
        out[some] = np.add.reduceat(values.astype(np.float64), of[some])
    return out


def score_texts(
    docs: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    held_out: Callable | None = None,
    states: int = STATES,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    ``held_out`` is a condition on the id column; rows for which it is not true are learnt from, all of them. ``score`` is
    the log10 probability of the text, ``base_score`` that of word counts plus one, ``n_known`` the tokens that
    occur in training. ``states`` are held at a time; it bounds memory and leaves the scores as they are. A null or empty text is one end. Null ids and repeated rows are rows of their own; other columns
    are ignored. Without training texts all scores are those of uniform distributions; an empty table gives no rows.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    out = F.lit(False) if held_out is None else F.coalesce(held_out(F.col("doc_id")), F.lit(False))
    training = texts.filter(~out).select("text")
    by = training.mapInArrow(_byte_counts, "b int, n long").groupBy("b").agg(F.sum("n").alias("n"))
    seen = np.zeros(256, np.int64)
    for r in by.collect():
        seen[r.b] = r.n
    alphabet = Alphabet.of(seen)
    counted = training.mapInArrow(_corpus_counts(alphabet), "kind byte, key long, n long")
    counted = cut_lineage(counted.groupBy("kind", "key").agg(F.sum("n").alias("n")))
    vocabulary = counted.filter("kind = 0").select("key", "n")
    size = {r.kind: (r.n, r.k) for r in counted.groupBy("kind").agg(F.sum("n").alias("n"), F.count("*").alias("k")).collect()}
    trained = size.get(2, (0, 0))[0]
    total, kinds = size.get(0, (0, 0))[0] + trained, size.get(0, (0, 0))[1] + (trained > 0)

    top = vocabulary.orderBy(F.desc("n"), "key").limit(FREQUENT).toArrow().sort_by("key")
    common, common_n = top.column("key").to_numpy().astype(np.int64), top.column("n").to_numpy().astype(np.int64)
    grams = counted.filter("kind = 1").select(
        F.col("key").bitwiseAND(F.lit((1 << (6 * DEPTH)) - 1)).alias("context"),
        F.shiftright("key", 6 * DEPTH).cast("int").alias("symbol"), "n",
    )
    *parts, last = _parts(cut_lineage(select_states(grams)), states)

    def grown(part, pairs):
        key = F.shiftleft(F.col("depth").cast("long"), 58).bitwiseOR(F.col("context")).alias("key")
        rows = part.select(key, F.col("symbol").cast("byte").alias("symbol"), "n").toArrow()
        tree = Tree.of_batches(alphabet, [tuple(c.to_numpy() for c in b.columns) for b in rows.to_batches()], pairs)
        del rows
        pa.default_memory_pool().release_unused()
        return tree

    for part in parts:
        some = spark.sparkContext.broadcast(grown(*part))

        def spell(batches, some=some):
            yield from _partly_spelled(some.value)(batches)

        kind = texts.schema["doc_id"].dataType.simpleString()
        texts = cut_lineage(texts.mapInArrow(spell, f"doc_id {kind}, text string, spelled array<double>"))
        some.unpersist()
    model = spark.sparkContext.broadcast((grown(*last), common, common_n))

    def run(batches):
        yield from _scores(*model.value, trained, total, kinds)(batches)

    scored = cut_lineage(texts.mapInArrow(
        run, "row long, doc_id " + texts.schema["doc_id"].dataType.simpleString()
        + ", n_tokens long, known long, base double, score double, rare array<long>, spelled array<double>"
    ))
    rare = scored.select("row", F.explode(F.arrays_zip("rare", "spelled")).alias("x"))
    rare = rare.select("row", F.col("x.rare").alias("key"), F.col("x.spelled").alias("spelled"))
    share = (F.coalesce("n", F.lit(0)) + F.lit(1.0)) / F.lit(float(total + kinds + 1))
    joined = rare.join(vocabulary, "key", "left").groupBy("row").agg(
        F.sum(F.log10(share)).alias("more"), F.count("n").alias("also"),
        F.sum(F.log10(share / 2 + F.pow(F.lit(10.0), "spelled") / 2)).alias("mixed"),
    )
    return scored.drop("rare", "spelled").join(joined, "row", "left").select(
        "doc_id", out.alias("held_out"), "n_tokens", (F.col("known") + F.coalesce("also", F.lit(0))).alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("mixed", F.lit(0.0))).alias("score"),
    )
