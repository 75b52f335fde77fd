"""Toxicity of texts whose words may be disguised: a noisy channel restores them, then restored words are scored.

A disguised stretch (letters mixed with signs or digits, single letters set apart, letters repeated) becomes a lattice:
each character offers the letters it may stand for, a separator may be a word's end or nothing, a run of a letter may be one
or two of it, each at the price of the channel. Viterbi decoding finds the cheapest reading under a character model of
four letters counted over the whole corpus. Restored words and their beginnings are weighed by how much more often they
occur in documents labelled toxic, and a logistic model turns a document's weights into a score.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyline.session import cut_lineage

#: Symbols of the character model: an end of word, a to z without accents, any other letter.
SYMBOLS, END, OTHER = 28, 0, 27
ORDER = 4
#: Labelled documents that are learnt from at most, those first in a seeded order.
SAMPLE = 30_000
#: A word is weighed by itself and by its first letters, so many.
BEGINNINGS = (4, 5, 6, 7)
#: Documents labelled toxic that must hold a word or beginning, and the least log odds, to give it a weight.
LEAST_DOCUMENTS, LEAST_WEIGHT = 2, 1.0
FOLDS = 4
#: Characters handled at a time when letters are counted.
PIECE = 1 << 20
#: Distinct tokens whose reading a task remembers before it starts anew.
REMEMBERED = 200_000
#: Letters that signs and digits stand for.
STANDS_FOR = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "€": "e", "(": "c", "#": "h", "*": "aeiou",
}
#: Prices (nats) of a sign for a letter, of a separator inside a word, of keeping one of a run's letters or two, of a sign as an end.
SIGN, JOINED, ONE, TWO, KEPT = 1.0, 1.5, 0.2, 0.5, 2.0

_WORD = re.compile(r"[^\W\d_]+")
_RUN = re.compile(r"([^\W\d_])\1\1")
_MIXED = re.compile(r"[^\W\d_][^\sa-zA-Z]*[0-9@$!|+€(#*._\-~/]+[^\sa-zA-Z]*[^\W\d_]|(?:^|\W)[@$€(][^\W\d_]|[^\W\d_][0-9]$")
_EDGES = " \t\r\n.,;:!?\"'()[]{}<>#%&*~_-=/\\|^`+"


@cache
def _symbol_table() -> np.ndarray:
    table = np.zeros(1 << 16, np.uint8)
    for code in range(1 << 16):
        char = chr(code)
        if char.isalpha():
            plain = unicodedata.normalize("NFKD", char)[0].lower()
            table[code] = ord(plain) - 96 if "a" <= plain <= "z" else OTHER
    return table


def symbols(text: str) -> np.ndarray:
    """The symbol of each character; what is no letter, or lies beyond the basic plane, ends words."""
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    return np.where(codes < 1 << 16, _symbol_table()[np.minimum(codes, (1 << 16) - 1)], END)


def _symbol(char: str) -> int:
    return int(_symbol_table()[ord(char)]) if ord(char) < 1 << 16 else END


def _letter_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts → (key, n): how often each four symbols follow each other, ends of words counted once."""
    total = np.zeros(SYMBOLS**ORDER, np.int64)

    def count(text: str):
        row = np.concatenate(([END] * (ORDER - 1), symbols(text), [END])).astype(np.int64)
        row = row[np.concatenate(([True] * (ORDER - 1), (row[ORDER - 1:] != END) | (row[ORDER - 2:-1] != END)))]
        key = np.zeros(len(row) - ORDER + 1, np.int64)
        for k in range(ORDER):
            key = key * SYMBOLS + row[k:len(row) - ORDER + 1 + k]
        total[:] += np.bincount(key, minlength=len(total))

    for batch in batches:
        held, size = [], 0
        for text in batch.column(0).to_pylist():
            for at in range(0, len(text or ""), PIECE):
                held.append(text[at:at + PIECE].lower())
                size += len(held[-1])
                if size >= PIECE:
                    count("\n".join(held))
                    held, size = [], 0
        if held:
            count("\n".join(held))
    keys = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(total[keys])], ["key", "n"])


@dataclass
class Letters:
    """-log probability of a symbol after three, each order smoothed towards the next lower one."""

    cost: np.ndarray

    @classmethod
    def of(cls, counts: np.ndarray, weight: float = 4.0) -> Letters:
        grid = counts.reshape((SYMBOLS,) * ORDER).astype(np.float64)
        share = np.full(SYMBOLS, 1 / SYMBOLS)
        for order in range(1, ORDER + 1):
            own = grid.sum(axis=tuple(range(ORDER - order)))
            share = (own + weight * share) / (own.sum(axis=-1, keepdims=True) + weight)
        return cls(-np.log(share).astype(np.float32).reshape(-1, SYMBOLS))

    def decode(self, lattice: list[list[tuple[str, float]]]) -> str:
        """The cheapest reading: one alternative of each place, the texts in a row, each text's letters priced by the model."""
        best: dict[int, tuple[float, str]] = {0: (0.0, "")}
        for place in [*lattice, [(" ", 0.0)]]:
            grown: dict[int, tuple[float, str]] = {}
            for state, (so_far, read) in best.items():
                for text, price in place:
                    now, after, out = so_far + price, state, read
                    for char in text:
                        s = _symbol(char)
                        if s == END and after % SYMBOLS == END:
                            continue
                        now += float(self.cost[after, s])
                        after = (after * SYMBOLS + s) % SYMBOLS ** (ORDER - 1)
                        out += char
                    if after not in grown or (now, out) < grown[after]:
                        grown[after] = (now, out)
            best = grown
        return min(best.values())[1].strip()


def lattice(stretch: str) -> list[list[tuple[str, float]]]:
    """Alternatives, with their prices, of each character or run of characters of a lower-cased stretch."""
    out, at = [], 0
    while at < len(stretch):
        char, run = stretch[at], 1
        while at + run < len(stretch) and stretch[at + run] == char:
            run += 1
        if char.isalpha():
            out += [[(char, ONE), (char * 2, TWO)]] if run > 2 else [[(char, 0.0)]] * run
        elif char in STANDS_FOR:
            price = SIGN + math.log(len(STANDS_FOR[char]))
            signs = [(letter, price) for letter in STANDS_FOR[char]] + [(" ", KEPT)]
            out += [signs] * run if run < 3 else [signs]
        else:
            out.append([(" ", 0.0), ("", JOINED)])
        at += run
    return out


class Reader:
    """Words of texts as restored by the channel, and their weights."""

    def __init__(self, letters: Letters, table: dict[str, float] | None = None):
        self.letters, self.table, self.known = letters, table or {}, {}
        self.heads = {part.rstrip("-")[: BEGINNINGS[0]] for part in self.table}  # most words begin like none that has a weight

    def restored(self, token: str) -> tuple[str, ...]:
        """Words of a lower-cased token; white space in it parts single letters."""
        if token.isalpha() and not _RUN.search(token):
            return (token,)
        core = token.strip(_EDGES)
        if " " in core or (core and not core.isalpha() and _MIXED.search(core)):
            core = self.letters.decode(lattice(core))
        return tuple(
            part for word in _WORD.findall(core)
            for part in (_WORD.findall(self.letters.decode(lattice(word))) if _RUN.search(word) else (word,))
        )

    def _read(self, text: str | None) -> Iterator[tuple[str, int]]:
        """Restored words and how often each token that gives them occurs; a word can come several times."""
        text = text or ""
        doubtful = _RUN.search(text.lower()) is not None
        for token, n in self.tokens(text).items():
            if n <= 0:
                continue
            word = token if token.isalpha() else token.strip(_EDGES)
            if word.isalpha() and not (doubtful and _RUN.search(word)):
                yield word, n
                continue
            words = self.known.get(token)
            if words is None:
                if len(self.known) >= REMEMBERED:
                    self.known.clear()
                words = self.known[token] = self.restored(token)
            for word in words:
                yield word, n

    @staticmethod
    def tokens(text: str | None) -> Counter:
        """How often each lower-cased token occurs; three or more single characters in a row are one token."""
        found = (text or "").lower().split()
        single = [i for i, t in enumerate(found) if len(t) == 1 or (len(t) == 2 and t[1] in ".,;:!?")]
        counts, joined, run = Counter(found), [], 0
        for k in range(1, len(single) + 1):
            if k == len(single) or single[k] != single[k - 1] + 1:
                if k - run > 2:
                    joined.append(found[single[run]:single[k - 1] + 1])
                run = k
        for part in joined:
            counts.subtract(part)
            counts[" ".join(part)] += 1
        return counts

    def words(self, text: str | None) -> Counter:
        """How often each restored word occurs in the text."""
        found = Counter()
        for word, n in self._read(text):
            found[word] += n
        return found

    def measures(self, text: str | None) -> list[float]:
        """``measures`` of the text's restored words."""
        size, hits, heads, first = 0, Counter(), self.heads, BEGINNINGS[0]
        for word, n in self._read(text):
            size += n
            if word[:first] in heads:
                hits[word] += n
        weighed = ((weight_of(word, self.table), n) for word, n in hits.items())
        return measures(size, [(v, n) for v, n in weighed if v > 0])


def weight_of(word: str, table: dict[str, float]) -> float:
    return max(table.get(part, 0.0) for part in beginnings(word))


def beginnings(word: str) -> list[str]:
    """The word and its first letters, the parts that can have a weight."""
    return [word, *(word[:k] + "-" for k in BEGINNINGS if len(word) > k)]


def measures(size: int, hits: list[tuple[float, int]]) -> list[float]:
    """What the model sees of a document of ``size`` words, some with weights: the highest ones, their sum alone and against the length, the length."""
    hits = sorted(hits, reverse=True)
    top = [w for w, _ in hits[:3]] + [0.0] * 3
    total = sum(w * min(n, 5) for w, n in hits)
    return [*top[:3], math.log1p(total), total / math.sqrt(size + 5), 10 * total / (size + 20), math.log1p(size)]


def weights(toxic: dict[str, int], clean: dict[str, int], documents: tuple[int, int]) -> dict[str, float]:
    """Log odds of the parts that enough toxic documents hold; ``documents``: all clean and all toxic ones."""
    out = {}
    for part, n in toxic.items():
        odds = math.log((n + 0.5) / (documents[1] + 1)) - math.log((clean.get(part, 0) + 0.5) / (documents[0] + 1))
        if n >= LEAST_DOCUMENTS and odds > LEAST_WEIGHT:
            out[part] = odds
    return out


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-4, steps: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Means, spreads and coefficients (the first without measure) of a ridge logistic model, by Newton's steps."""
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-9
    a = np.column_stack([np.ones(len(x)), (x - mean) / spread])
    w, pull = np.zeros(a.shape[1]), ridge * len(y) + 1e-3
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + pull * np.eye(len(w)), a.T @ (p - y) + pull * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return mean, spread, w


@dataclass
class Model:
    letters: Letters
    table: dict[str, float]
    fit: tuple[np.ndarray, np.ndarray, np.ndarray] | None
    share: float

    def reader(self) -> Reader:
        return Reader(self.letters, self.table)

    def scores(self, reader: Reader, texts: Iterable[str | None]) -> np.ndarray:
        """Probability of label 1; without a fitted model the smoothed share of label 1."""
        if self.fit is None:
            return np.array([self.share for _ in texts])
        mean, spread, w = self.fit
        x = np.array([reader.measures(t) for t in texts]).reshape(-1, len(mean))
        return 1 / (1 + np.exp(-np.clip(w[0] + ((x - mean) / spread) @ w[1:], -30, 30)))


def letter_model(docs: DataFrame, text: str = "text") -> Letters:
    """The character model of all texts; at most 28^4 counts reach the driver, whatever the corpus."""
    counted = docs.select(F.col(f"`{text}`").cast("string")).mapInArrow(_letter_counts, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(SYMBOLS**ORDER, np.int64)
    counts[counted.column("key").to_numpy()] = counted.column("n").to_numpy()
    return Letters.of(counts)


def fit(
    docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic", held_out=None,
    sample: int = SAMPLE, seed: int = 0,
) -> Model:
    """Learns from all texts' letters and from the documents of at most ``sample`` labels, those first in a seeded order.

    ``held_out`` is a condition on ``doc_id`` whose rows teach nothing about labels. Null ids, labels other than 0 and 1 and
    labels without a document teach nothing. Weights that a document's measures are learnt with come from other documents.
    """
    spark = docs.sparkSession
    letters = letter_model(docs, text)
    out = F.lit(False) if held_out is None else F.coalesce(held_out(F.col("doc_id")), F.lit(False))
    marked = labels.select(F.col(f"`{id}`").cast("long").alias("doc_id"), F.col(f"`{label}`").cast("int").alias("y"))
    marked = marked.filter("doc_id is not null and y in (0, 1)").filter(~out).groupBy("doc_id").agg(F.max("y").alias("y"))
    first = cut_lineage(marked.orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(sample))
    texts = docs.select(F.col(f"`{id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    model = spark.sparkContext.broadcast(letters)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(model.value)
        for batch in batches:
            for k in range(batch.num_rows):
                words = reader.words(batch.column(2)[k].as_py())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(k, 1), batch.column(1).slice(k, 1), pa.array([list(words)], pa.list_(pa.string())), pa.array([list(words.values())], pa.list_(pa.int64()))],
                    ["doc_id", "y", "words", "counts"],
                )

    fold = F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id"), F.lit(FOLDS)).cast("int").alias("fold")
    known = texts.join(F.broadcast(first), "doc_id").select("doc_id", "y", "text")
    known = cut_lineage(known.mapInArrow(read, "doc_id long, y int, words array<string>, counts array<long>").withColumn("fold", fold))
    sizes = {(r["fold"], r["y"]): r["n"] for r in known.groupBy("fold", "y").agg(F.count("*").alias("n")).collect()}
    n = [sum(v for (_, y), v in sizes.items() if y == k) for k in (0, 1)]
    share = (n[1] + 1) / (n[0] + n[1] + 2)
    if not all(n):
        return Model(letters, {}, None, share)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for f, y, words in zip(*(batch.column(k).to_pylist() for k in range(3))):
                held = sorted({part for word in words for part in beginnings(word)})
                yield pa.RecordBatch.from_arrays([pa.array([f] * len(held), pa.int32()), pa.array([y] * len(held), pa.int32()), pa.array(held, pa.string())], ["fold", "y", "part"])

    counted = known.select("fold", "y", "words").mapInArrow(parts, "fold int, y int, part string").groupBy("part").agg(
        *[F.count_if((F.col("y") == y) & (F.col("fold") == f)).alias(f"n{y}{f}") for y in (0, 1) for f in range(FOLDS)]
    )
    toxic = " + ".join(f"n1{f}" for f in range(FOLDS))
    rows = counted.filter(f"{toxic} >= {LEAST_DOCUMENTS}").toArrow().sort_by("part")  # of the sample's documents alone
    names = rows.column("part").to_pylist()
    grid = {(y, f): rows.column(f"n{y}{f}").to_numpy() for y in (0, 1) for f in range(FOLDS)}

    def table(without: int | None) -> dict[str, float]:
        some = [f for f in range(FOLDS) if f != without]
        held = [dict(zip(names, sum(grid[y, f] for f in some).tolist())) for y in (0, 1)]
        return weights(held[1], held[0], tuple(sum(sizes.get((f, y), 0) for f in some) for y in (0, 1)))

    tables = spark.sparkContext.broadcast([table(f) for f in range(FOLDS)])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f, y, words, counts = (batch.column(k).to_pylist() for k in range(4))
            x = []
            for g, w, c in zip(f, words, counts):
                weighed = ((weight_of(word, tables.value[g]), n) for word, n in zip(w, c))
                x.append(measures(sum(c), [(v, n) for v, n in weighed if v > 0]))
            yield pa.RecordBatch.from_arrays([pa.array(y, pa.int32()), pa.array(x, pa.list_(pa.float64()))], ["y", "x"])

    seen = known.select("fold", "y", "words", "counts").mapInArrow(measure, "y int, x array<double>").toArrow()
    x = np.array(seen.column("x").to_pylist(), np.float64)
    y = seen.column("y").to_numpy().astype(np.float64)
    order = np.lexsort((*x.T, y))  # rows may come in any order; sums shall not differ
    return Model(letters, table(None), logistic(x[order], y[order]), share)


def toxicity_scores(
    docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic", held_out=None,
    sample: int = SAMPLE, threshold: float = 0.7,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score (0 to 1), predicted (1 from ``threshold`` on).

    Learns as ``fit`` says. Null and empty texts are texts without words and scored as such; very long ones are read whole,
    one at a time. Null ids and repeated rows are rows of their own; other columns are ignored. Labels of one kind only, or
    none, give every text the smoothed share of label 1; an empty table gives no rows. No shuffle of documents.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, id, text, label, held_out, sample))
    texts = docs.select(F.col(f"`{id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    out = F.lit(False) if held_out is None else F.coalesce(held_out(F.col("doc_id")), F.lit(False))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = model.value.reader()
        for batch in batches:
            scores = model.value.scores(reader, (v.as_py() for v in batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    scored = texts.mapInArrow(score, "doc_id long, score double")
    return scored.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
