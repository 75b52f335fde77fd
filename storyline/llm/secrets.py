"""Secrets in texts: fixed shapes, and stretches of high entropy (DataFrame and SQL functions only).

A stretch is judged by a sliding window over a candidate string: the Shannon entropy of the last ``WINDOW`` characters,
kept up by the counts of the character that enters and the one that leaves, against a threshold for the string's class.
Positions are code points, ends exclusive.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 20
#: Character classes of candidates, the first that fits counts: (kind, whole-string pattern, least entropy in bits).
CLASSES = (
    ("entropy_hex", "[0-9a-fA-F]+", 3.0),
    ("entropy_base64", "[A-Za-z0-9+/=_-]+", 3.85),
)
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/=_-"
#: Candidates that are no secrets: plain numbers, plain words joined by signs, identifiers in the 8-4-4-4-12 form,
#: runs along the alphabet or the digits, and strings that say so themselves.
ALLOWED = (
    r"[0-9+/=_-]+",
    r"[A-Za-z]+([+/=_-]+[A-Za-z]+)*[0-9]{0,4}",
    r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}",
    r".*(?i:0123456789|abcdefghij|example|placeholder|changeme|dummy|your[_-]).*",
)
_ASSIGN = (
    r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
_ACCESS = r"AKIA[A-Z0-9]{12,}"
_HEX = r"[0-9a-f]{32,}"
_CANDIDATE = rf"(?<![A-Za-z0-9+/=_-])(?=[A-Za-z+/=_-]*[0-9])[A-Za-z0-9+/=_-]{{{WINDOW},}}"
KINDS = ("assign", "access", "hex", *(name for name, _, _ in CLASSES))


def _found(text: Column, pattern: str, value: str | None = None) -> Column:
    """Leftmost non-overlapping matches as structs (start, end, value); value is the match or its group.

    Each match is taken together with the gap before it, anchored where the last one ended, so one pass gives positions.
    """
    anchored = F.lit(rf"(?s)\G(.*?)({pattern})")
    gap, whole = F.regexp_extract_all(text, anchored, F.lit(1)), F.regexp_extract_all(text, anchored, F.lit(2))
    part = F.regexp_extract_all(text, anchored, F.lit(3)) if value else whole
    first = F.struct(
        F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,value:string>>").alias("out")
    )

    def step(acc, x):
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["whole"])
        item = F.struct(start.alias("start"), end.alias("end"), x["part"].alias("value"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(item)).alias("out"))

    rows = F.arrays_zip(gap.alias("gap"), whole.alias("whole"), part.alias("part"))
    return F.aggregate(rows, first, step, lambda acc: acc["out"])


def window_entropy(value: Column, least: float) -> Column:
    """First start and last end (struct, in characters) of the windows of ``value`` with ``least`` bits or more.

    Counts of the window's characters are updated by one entry and one leave per step; null ends where no window reaches.
    """
    table = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(WINDOW + 2)])
    places = F.transform(F.split(value, ""), lambda c: F.instr(F.lit(ALPHABET), c))
    first = F.struct(
        F.array_repeat(F.lit(0), len(ALPHABET)).alias("counts"), F.lit(0.0).cast("double").alias("sum"),
        F.lit(None).cast("int").alias("first"), F.lit(None).cast("int").alias("last"),
    )
    steps = F.transform(
        places, lambda c, i: F.struct(c.alias("into"), F.when(i >= WINDOW, F.get(places, i - WINDOW)).alias("out"), i.alias("i"))
    )

    def of(c):
        return F.element_at(table, c + 1)

    def step(acc, x):
        into, out = x["into"], x["out"]
        more, less = F.element_at(acc["counts"], into), F.element_at(acc["counts"], F.coalesce(out, F.lit(1)))
        change = F.when(out.isNull(), of(more + 1) - of(more)).when(out == into, 0.0).otherwise(
            of(more + 1) - of(more) + of(F.greatest(less - 1, F.lit(0))) - of(less)
        )
        counts = F.transform(
            acc["counts"],
            lambda c, k: c + (k + 1 == into).cast("int") - F.coalesce((k + 1 == out).cast("int"), F.lit(0)),
        )
        total = acc["sum"] + change
        high = (x["i"] >= WINDOW - 1) & (math.log2(WINDOW) - total / WINDOW >= least)
        return F.struct(
            counts.alias("counts"), total.alias("sum"),
            F.when(high & acc["first"].isNull(), x["i"] - (WINDOW - 1)).otherwise(acc["first"]).alias("first"),
            F.when(high, x["i"] + 1).otherwise(acc["last"]).alias("last"),
        )

    return F.aggregate(steps, first, step, lambda acc: F.struct(acc["first"].alias("first"), acc["last"].alias("last")))


def _high(candidates: Column, least: float) -> Column:
    """The stretches of the candidates that windows of ``least`` bits or more cover, as matches."""

    def place(m):
        high = window_entropy(m["value"], least)
        start, end = m["start"] + high["first"], m["start"] + high["last"]
        return F.struct(start.alias("start"), end.alias("end"), m["value"].alias("value"))

    return F.filter(F.transform(candidates, place), lambda m: m["start"].isNotNull())


def _spans(matches: Column, kind: str) -> Column:
    order = KINDS.index(kind)
    return F.transform(
        matches, lambda m: F.struct(m["start"].alias("start"), F.lit(order).alias("kind"), m["end"].alias("end"))
    )


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(
        F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])
    ))


def scan(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, spans (array of start, kind, end), n_assign, n_access, n_hex, base, spans_text.

    ``base`` joins the assignments, access keys and hex strings as ``kind:start:end`` by start, then kind; ``spans_text``
    joins these and the high-entropy stretches of other candidates likewise. A null text is an empty one and has none;
    null ids and repeated rows stay; other columns are ignored; an empty table gives no rows. No shuffle.
    """
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    body = docs.select(F.col(id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    low = F.lower("text")
    named = low.contains("passw") | low.contains("secret") | low.contains("token") | low.contains("api")
    t = F.col("text")
    raw = body.select(
        "doc_id",
        F.when(named, _found(t, _ASSIGN, "group")).otherwise(none).alias("assign"),
        F.when(t.contains("AKIA"), _found(t, _ACCESS)).otherwise(none).alias("access"),
        F.when(t.rlike(_HEX), _found(t, _HEX)).otherwise(none).alias("hex"),
        F.when(t.rlike(_CANDIDATE), _found(t, _CANDIDATE)).otherwise(none).alias("candidates"),
    )
    raw = raw.withColumn("assign", F.filter("assign", lambda m: F.length(m["value"]) >= 8))
    plain = "^(" + "|".join(ALLOWED) + ")$"
    free = F.filter("candidates", lambda m: ~m["value"].rlike(plain))
    found = []
    for kind, pattern, least in CLASSES:
        found.append(_spans(_high(F.filter(free, lambda m: m["value"].rlike(f"^{pattern}$")), least), kind))
        free = F.filter(free, lambda m: ~m["value"].rlike(f"^{pattern}$"))
    base = F.concat(*[_spans(F.col(k), k) for k in ("assign", "access", "hex")])
    spans = raw.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")],
        base.alias("base"), F.concat(*found).alias("more"),
    )
    return spans.select(
        "doc_id", F.array_sort(F.concat("base", "more")).alias("spans"), "n_assign", "n_access", "n_hex",
        _joined(F.col("base")).alias("base"), _joined(F.concat("base", "more")).alias("spans_text"),
    )
