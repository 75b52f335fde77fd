"""Language shares of texts: expectation-maximisation over n-gram likelihoods of their segments.

Every language has one smoothed distribution over hashed byte 4-grams of lower-cased letters, counted over all training
texts. A text is a row of segments of ``SEGMENT`` words, each in one language; expectation-maximisation estimates the
shares of the languages from the segments' likelihoods. The set of languages is the one of best penalised likelihood among
the most likely one, two, and so on: each language more has to pay half the logarithm of the number of segments.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyline.llm import words

BUCKETS = 1 << 16
GRAM = 4
SEGMENT = 8
ROUNDS = 12
SMOOTHING = 0.5
#: Weight of a language that another must exceed per segment, so that one odd word makes no second language.
PENALTY = 4.0
ROWS = 500
UNKNOWN = "und"

_LETTERS = np.full(256, 0x20, np.uint8)
_LETTERS[0x61:0x7B] = np.arange(0x61, 0x7B)
_LETTERS[0x41:0x5B] = np.arange(0x61, 0x7B)
_LETTERS[0x80:] = np.arange(0x80, 0x100)


def letters(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased letters of all texts in a row, other characters and the gaps between texts as spaces; where texts begin."""
    raw, at = words.utf8(column)
    size = np.diff(at)
    begin = at[:-1] + (GRAM - 1) * np.arange(1, len(at))
    out = np.full(len(raw) + (GRAM - 1) * len(at), 0x20, np.uint8)
    out[np.arange(len(raw)) + np.repeat(begin - at[:-1], size)] = _LETTERS[raw]
    return out, begin


def grams(text: np.ndarray) -> np.ndarray:
    """Bucket of the 4-gram that starts at each position."""
    wide = np.zeros(max(0, len(text) - GRAM + 1), np.uint32)
    for k in range(GRAM):
        wide |= text[k:k + len(wide)].astype(np.uint32) << np.uint32(8 * k)
    return (wide * np.uint32(0x9E3779B1)) >> np.uint32(16)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts (text, lang) → (lang, gram, n), one row per language and gram of a task."""
    seen: dict[str, np.ndarray] = {}
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            piece = batch.slice(at, ROWS)
            langs = piece.column(1).dictionary_encode()
            for k, lang in enumerate(langs.dictionary.to_pylist()):
                own = piece.column(0).filter(pa.compute.equal(langs.indices, k))
                text, _ = letters(own)
                counts = np.bincount(grams(text), minlength=BUCKETS)
                seen[lang] = seen.get(lang, 0) + counts
    for lang, counts in seen.items():
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(counts[at].astype(np.int64))],
            ["lang", "gram", "n"],
        )


def mixture(scores: np.ndarray, of: np.ndarray, weight: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shares of the languages in each text and its log likelihood, by expectation-maximisation.

    ``scores``: log likelihood of each segment in each language; ``of``: offsets of the texts' segments, none empty;
    ``weight``: of each segment; ``mask``: which languages each text may have.
    """
    owner = np.repeat(np.arange(len(of) - 1), np.diff(of))
    total = np.add.reduceat(weight, of[:-1])[:, None]
    share = mask / mask.sum(axis=1, keepdims=True)
    top = np.where(mask[owner], scores, -np.inf).max(axis=1, keepdims=True)
    like = np.where(mask[owner], np.exp(scores - top), 0.0)
    for _ in range(ROUNDS):
        part = share[owner] * like
        part /= np.maximum(part.sum(axis=1, keepdims=True), 1e-300)
        share = np.add.reduceat(part * weight[:, None], of[:-1], axis=0) / total
    fit = np.log(np.maximum((share[owner] * like).sum(axis=1), 1e-300)) + top[:, 0]
    return share, np.add.reduceat(fit, of[:-1])


def language_shares(column: pa.Array, table: np.ndarray) -> np.ndarray:
    """Shares of the languages in each text, rows of zeros for texts without letters. ``table``: log probability by gram."""
    count = table.shape[1]
    text, begin = letters(column)
    out = np.zeros((len(begin), count))
    inside = text != 0x20
    starts = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1
    of = np.append(np.searchsorted(starts, begin), len(starts))
    some = np.flatnonzero(np.diff(of) > 0)
    if not len(some) or not count:
        return out
    place = np.arange(len(starts)) - np.repeat(of[:-1], np.diff(of))
    first = starts[place % SEGMENT == 0]
    of = np.append(np.searchsorted(first, begin), len(first))[np.append(some, len(begin))]
    ids = grams(text)
    past = np.minimum(np.append(first[1:], len(ids)) - 1, len(ids))
    begins = first - 1
    scores = np.empty((len(first), count))
    for k in range(count):
        sums = np.concatenate(([0.0], np.cumsum(table[ids, k], dtype=np.float64)))
        scores[:, k] = sums[past] - sums[begins]
    weight = (past - begins).astype(float)
    everything = np.ones((len(some), count), bool)
    share, _ = mixture(scores, of, weight, everything)
    order = np.argsort(-share, axis=1, kind="stable")
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.broadcast_to(np.arange(count), order.shape), axis=1)
    best, best_share = np.full(len(some), -np.inf), share
    cost = PENALTY * np.log(np.maximum(np.diff(of), 2))
    for k in range(1, count + 1):
        kept, like = mixture(scores, of, weight, rank < k)
        value = like - cost * (k - 1)
        better = value > best
        best = np.where(better, value, best)
        best_share = np.where(better[:, None], kept, best_share)
    out[some] = best_share
    return out


def identify(
    docs: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    held_out: Callable | None = None,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, lang_pred, score, languages (array of lang and share).

    Learns from the text of rows with a language for which ``held_out``, a condition on the id column, is not true; nothing
    but the text goes into a prediction. ``lang_pred`` is the language with the largest share (the first in order of two)
    and ``score`` its share. A text that is null or has no letter, and any text when nothing was learnt, is ``und`` with
    score 0 and no languages. Null ids and repeated rows are rows of their own; other columns are ignored; an empty table
    gives no rows. The model holds ``BUCKETS`` numbers for each language, whatever the size of the corpus.
    """
    out = F.lit(False) if held_out is None else F.coalesce(held_out(F.col("doc_id")), F.lit(False))
    base = docs.select(
        F.col(id).alias("doc_id"), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang")
    )
    training = base.filter(~out & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang")
    counted = training.mapInArrow(_counts, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    model = counted.toArrow()
    names = sorted(set(model.column("lang").to_pylist()))
    table = np.zeros((BUCKETS, len(names)))
    at = np.searchsorted(np.array(names), model.column("lang").to_pylist()) if names else np.zeros(0, int)
    table[model.column("gram").to_numpy(), at] = model.column("n").to_numpy()
    table = np.log((table + SMOOTHING) / (table.sum(axis=0) + SMOOTHING * BUCKETS)).astype(np.float32)
    shared = docs.sparkSession.sparkContext.broadcast((table, names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, names = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                piece = batch.slice(at, ROWS)
                share = language_shares(piece.column(1), table)
                share[~piece.column(2).to_numpy(zero_copy_only=False).astype(bool)] = 0
                top = share.argmax(axis=1) if names else np.zeros(len(share), int)
                score = share.max(axis=1) if names else np.zeros(len(share))
                said = [names[k] if s > 0 else UNKNOWN for k, s in zip(top.tolist(), score.tolist())]
                mixed = [
                    [{"lang": names[k], "share": row[k]} for k in np.argsort(-row, kind="stable").tolist() if row[k] > 0]
                    for row in share
                ]
                kind = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), pa.array(said, pa.string()), pa.array(np.clip(score, 0, 1)), pa.array(mixed, kind)],
                    ["doc_id", "lang_pred", "score", "languages"],
                )

    lettered = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("lettered")
    found = base.select("doc_id", "text", lettered).mapInArrow(
        run,
        f"doc_id {base.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double, "
        "languages array<struct<lang:string,share:double>>",
    )
    return found.select("doc_id", out.alias("held_out"), "lang_pred", "score", "languages")
