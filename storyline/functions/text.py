"""Scalar text functions as Spark columns.

Everything stays on the JVM except markup stripping and Unicode compatibility folding, which
Spark does not offer.  Those two go through an Arrow UDF that is handed only the values that
need it: all other rows send a null across and keep their native result.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections import Counter
from collections.abc import Callable
from functools import reduce
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storyline.functions import fixed

# Fixed patterns.  SPACE spells out Unicode white space, so Java and RE2 agree on it.
SPACE = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
# The same set for Java alone: one bit test for Latin-1, one range test for the rest, instead of a chain of ranges at each character.
_WIDE = r"[\u1680-\u3000&&[\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]]"
_NO_BLANK = r"[\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0" + _WIDE + "]"
_ANY_SPACE = _NO_BLANK.replace(r"\xa0", r"\xa0\x20")
NON_ASCII_WORD = r"[[^\x00-\x7F]&&[\p{L}\p{N}]]"  # most characters fail the cheap half
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
CHAR_REFERENCE = r"(?i)&(?:#[0-9]+|#x[0-9a-f]+|[a-z][a-z0-9]+);"
MENTION = r"(?i)@(everyone|here|[!&]?\p{Nd}+)"
TOKEN = r"[a-z0-9]+(?:\.[0-9]+)?"
ENTITY = r"\b(?:[A-Z][A-Za-z0-9&.-]+(?:\s+[A-Z][A-Za-z0-9&.-]+){0,3}|[A-Z]{2,})\b"
NUMBER = r"\b\d+(?:\.\d+)?(?:\s?(?:bps|basis points?|million|billion|trillion))?\b"
SENTENCE_END = "(?<=[.!?])(?:[\"”’])?" + SPACE + "+"
# Characters that compatibility folding leaves alone; anything else takes the Arrow path.
FOLD_STABLE = (
    r"\x00-\x7F\u00a1-\u00a7\u00a9\u00ab-\u00ae\u00b0\u00b1\u00b6\u00b7\u00bb\u00bf-\u0131"
    r"\u0134-\u013e\u0141-\u0148\u014a-\u017e\u0400-\u0475\u05d0-\u05ea\u2013\u2014"
    r"\u2018-\u201e\u2020-\u2022\u200b\u20ac\u4e00-\u9fff"
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it many times inside ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _quoted(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, int):
        return str(value)
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def literal_array(values) -> Column:
    """A constant array; one expression text keeps plan building cheap for long lists."""
    return F.expr("array(" + ", ".join(map(_quoted, values)) + ")")


def literal_map(pairs) -> Column:
    """A constant map."""
    return F.expr("map(" + ", ".join(_quoted(x) for kv in pairs for x in kv) + ")")


def contains_any(col: Column, terms) -> Column:
    """True when any of the literal ``terms`` occurs in ``col``."""
    return reduce(lambda a, b: a | b, [col.contains(t) for t in terms])


def squash(col: Column) -> Column:
    """Collapse runs of white space to one blank and trim; single blanks are left alone, not replaced by themselves."""
    return F.trim(F.regexp_replace(col, rf"{_NO_BLANK}{_ANY_SPACE}*|\x20{_ANY_SPACE}+", " "))


def strip_space(col: Column) -> Column:
    """Trim Unicode white space at both ends."""
    return F.regexp_replace(col, f"^{SPACE}+|{SPACE}+$", "")


def casefold(col: Column) -> Column:
    return F.replace(F.lower(col), F.lit("ß"), F.lit("ss"))


def is_ascii(col: Column) -> Column:
    return F.length(col) == F.octet_length(col)


def ascii_words(col: Column) -> Column:
    """Turn non-ASCII letters and digits into ``_`` so ASCII word boundaries are Unicode-exact."""
    return F.when(is_ascii(col), col).otherwise(F.regexp_replace(col, NON_ASCII_WORD, "_"))


def cut(col: Column, limit: int) -> Column:
    """At most ``limit`` characters, an ellipsis marking the cut."""
    return let(
        col,
        lambda c: F.when(F.length(c) <= limit, c).otherwise(
            F.concat(F.rtrim(F.substring(c, 1, max(0, limit - 1))), F.lit("\u2026"))
        ),
    )


def neutralize_mentions(col: Column) -> Column:
    """Put a zero-width space after the ``@`` of broadcast and id mentions."""
    return F.regexp_replace(col, MENTION, "@\u200b$1")


# --- markup -------------------------------------------------------------------
class _DataRuns(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.runs = []

    def handle_data(self, data):
        self.runs.append(data)


_BARE_AMPERSAND = re.compile(r"&(?!(?:#[0-9]+|#x[0-9a-f]+|[a-z][a-z0-9]+);)", re.I)


def visible_text(value: str) -> str:
    """The data runs of an HTML fragment, joined by blanks."""
    guarded = _BARE_AMPERSAND.sub("&amp;", value)
    if "<" not in guarded:
        return html.unescape(guarded)
    reader = _DataRuns()
    reader.feed(guarded)
    reader.close()
    return " ".join(reader.runs)


@F.pandas_udf(T.StringType())
def _strip_markup(values: pd.Series) -> pd.Series:
    return values.map(visible_text, na_action="ignore")


def needs_folding(col: Column) -> Column:
    """Whether compatibility folding may change the text; what is ASCII leaves before the long character class is tried."""
    return ~is_ascii(col) & F.regexp_replace(col, r"[\x00-\x7F]+", "").rlike(f"[^{FOLD_STABLE}]")


_SPACES = re.compile(SPACE + "+")
_MENTION = re.compile(r"@(everyone|here|[!&]?\d+)", re.I)


def plain_value(value: str, limit: int) -> str:
    """``plain_text`` of one value, for the few rows that leave the JVM."""
    text = _SPACES.sub(" ", visible_text(value)).strip(" ")
    text = _MENTION.sub("@\u200b\\1", text)
    return text if len(text) <= limit else text[: max(0, limit - 1)].rstrip() + "\u2026"


def headline_value(value: str) -> str:
    """Plain, compatibility-folded headline of one value, for rows that leave the JVM."""
    return unicodedata.normalize("NFKC", plain_value(value, 500))


def folded_value(value: str) -> str:
    """Squashed, case-folded form of one plain value."""
    return _SPACES.sub(" ", value.lower().replace("ß", "ss")).strip(" ")


@F.pandas_udf(T.StringType())
def _headline_text(values: pd.Series) -> pd.Series:
    return values.map(headline_value, na_action="ignore")


def has_markup(col: Column) -> Column:
    return col.contains("<") | (col.contains("&") & col.rlike(CHAR_REFERENCE))


def without_markup(col: Column) -> Column:
    """Drop tags and decode character references; rows without either never leave the JVM."""
    return F.coalesce(_strip_markup(F.when(has_markup(col), col)), col)


def tidy(col: Column, limit: int) -> Column:
    """``plain_text`` of a value known to be free of markup.

    Of a long value a head decides, if it is still longer than ``limit`` by more than a mention once squashed.
    """
    reach, mention = 2 * limit + 200, 16

    def done(c: Column) -> Column:
        return cut(F.when(c.contains("@"), neutralize_mentions(c)).otherwise(c), limit)

    def headed(c: Column) -> Column:
        return let(squash(F.substring(c, 1, reach)), lambda h: F.when(F.length(h) >= limit + mention, done(h)).otherwise(let(squash(c), done)))

    return let(col, lambda c: F.when(F.length(c) <= reach, let(squash(c), done)).otherwise(headed(c)))


def plain_text(col: Column, limit: int) -> Column:
    """Readable text of an HTML-ish value, mentions neutralised, at most ``limit`` characters."""
    return tidy(without_markup(col), limit)


# --- headline normalisation ----------------------------------------------------
def _event_root(word: Column) -> Column:
    roots = literal_map((f, root) for root, forms in fixed.EVENT_FORMS.items() for f in forms)
    forms = [f for fs in fixed.EVENT_FORMS.values() for f in fs]
    # isin over many literals is a hash probe; only true event forms pay for the map lookup.
    return F.when(word.isin(forms), F.element_at(roots, word)).otherwise(word)


def headline_words_of_lower(text: Column) -> Column:
    """Words of an already plain, folded and lower-cased headline."""
    for source, target in fixed.SYNONYMS:
        text = F.replace(text, F.lit(source), F.lit(target))
    words = F.transform(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), _event_root)
    return F.filter(words, lambda w: ~w.isin(list(fixed.STOP_WORDS)))


def _spell_basis_points(text: Column) -> Column:
    dashed = r"\b(\d+(?:\.\d+)?)\s*-\s*basis\s*-\s*points?\b"
    spaced = r"\b(\d+(?:\.\d+)?)\s+basis\s+points?\b"
    return let(
        text,
        lambda t: F.when(
            t.contains("basis"),
            F.regexp_replace(F.regexp_replace(t, dashed, "$1 bps"), spaced, "$1 bps"),
        ).otherwise(t),
    )


def headline_words_of_text(text: Column) -> Column:
    """Words of a plain, folded headline of at most 500 characters."""
    return headline_words_of_lower(_spell_basis_points(F.lower(text)))


def headline_words(col: Column) -> Column:
    """Normalised headline as an ordered array of words (first 500 characters of the value)."""
    special = F.when(has_markup(col) | needs_folding(col), col)
    return headline_words_of_text(F.coalesce(_headline_text(special), tidy(col, 500)))


def normalize_headline(col: Column) -> Column:
    return F.array_join(headline_words(col), " ")


def token_set(words: Column) -> Column:
    """Sorted distinct tokens longer than one character, or single digits."""
    return F.array_sort(
        F.array_distinct(F.filter(words, lambda w: (F.length(w) > 1) | w.rlike("^[0-9]+$")))
    )


def tokenize(col: Column) -> Column:
    return token_set(headline_words(col))


def extract_entities(title: Column, summary: Column) -> Column:
    """Sorted distinct normalised capitalised runs of ``"title. summary"``."""
    text = F.regexp_replace(ascii_words(F.concat(title, F.lit(". "), summary)), _NO_BLANK, " ")
    runs = F.array_distinct(F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0)))
    names = F.transform(
        runs, lambda r: F.array_join(headline_words_of_lower(F.lower(cut(r, 500))), " ")
    )
    return F.array_sort(F.array_distinct(F.filter(names, lambda n: n != "")))


def extract_keywords(title_tokens: Column, description_tokens: Column) -> Column:
    """First 16 of both token sets: title tokens first, longer first, then alphabetical."""

    def ranked(tokens):
        keyed = F.transform(tokens, lambda t: F.struct((-F.length(t)).alias("n"), t.alias("t")))
        return F.transform(F.array_sort(keyed), lambda s: s["t"])

    rest = F.array_except(description_tokens, title_tokens)
    return F.slice(F.concat(ranked(title_tokens), ranked(rest)), 1, fixed.KEYWORDS_PER_ARTICLE)


def extract_numbers(words: Column) -> Column:
    """Sorted distinct numbers with units, from normalised headline words."""
    found = F.regexp_extract_all(F.array_join(words, " "), F.lit(NUMBER), F.lit(0))
    return F.array_sort(F.array_distinct(found))


def event_terms(title_tokens: Column) -> Column:
    return F.filter(title_tokens, lambda t: t.isin(list(fixed.EVENT_FORMS)))


def fingerprint(publisher: Column, title_tokens: Column, keywords: Column) -> Column:
    parts = [casefold(publisher), F.array_join(title_tokens, " "), F.array_join(keywords, " ")]
    return F.sha2(F.concat_ws("\n", *parts), 256)


# --- artefacts of scraped pages --------------------------------------------------
def contains_source_artifacts(col: Column) -> Column:
    """Navigation, metadata, advertising or repeated page modules in scraped copy."""

    def judge(low: Column) -> Column:
        return let(ascii_words(low), lambda asc: F.coalesce(_judge(low, asc), F.lit(False)))

    def _judge(low: Column, asc: Column) -> Column:
        some = asc.rlike(rf"\b(?:{'|'.join(fixed.MARKET_SYMBOLS)})\b")  # most texts hold none and stop here
        symbols = F.when(some, reduce(
            lambda a, b: a + b,
            [asc.rlike(rf"\b{s}\b").cast("int") for s in fixed.MARKET_SYMBOLS],
        )).otherwise(0)
        wire = asc.rlike(r"^by (?:reuters|the associated press|associated press|ap)\b")
        return (
            contains_any(low, fixed.PAGE_MARKERS)
            | (F.regexp_count(asc, F.lit(r"\b\d{1,2}:\d{2}\b")) >= 3)
            | (low.contains("(published)") & asc.rlike(r"\b\d+\s+min read\b"))
            | (wire & contains_any(low, (" advertisement", " follow us", " share ")))
            | (
                contains_any(low, ("advertising", "read more"))
                & asc.rlike(r"\b\d+\s+min(?:ute)?s?\s+(?:read|reading time)\b")
            )
            | (
                low.contains("section:")
                & (F.regexp_count(asc, F.lit(r"\b\d+\s+days?\s+ago\b")) >= 2)
            )
            | (symbols >= 3)
            | let(
                F.regexp_extract_all(low, F.lit("[a-z0-9]+"), F.lit(0)),
                lambda w: _opening_repeats(w) | _shingle_repeats(w),
            )
        )

    return F.coalesce(let(squash(casefold(col)), judge), F.lit(False))


class _Underscores(dict):
    """For ``str.translate``: non-ASCII letters and digits become ``_``, as in ``ascii_words``."""

    def __missing__(self, code: int):
        out = "_" if code > 127 and unicodedata.category(chr(code))[0] in "LN" else chr(code)
        self[code] = out
        return out


_UNDERSCORES = _Underscores()
_ASCII = {name: re.compile(p, re.ASCII) for name, p in {
    "clock": r"\b\d{1,2}:\d{2}\b", "min_read": r"\b\d+\s+min read\b", "days_ago": r"\b\d+\s+days?\s+ago\b",
    "reading": r"\b\d+\s+min(?:ute)?s?\s+(?:read|reading time)\b", "wire": r"by (?:reuters|the associated press|associated press|ap)\b",
    "symbol": rf"\b({'|'.join(fixed.MARKET_SYMBOLS)})\b", "word": "[a-z0-9]+",
}.items()}


def artifacts_in(low: str) -> bool:
    """``contains_source_artifacts`` of one squashed, case-folded value."""
    if any(m in low for m in fixed.PAGE_MARKERS):
        return True
    asc, has = low if low.isascii() else low.translate(_UNDERSCORES), _ASCII
    words = has["word"].findall(low)
    n = len(words)
    if any(words[:k] == words[k:2 * k] for k in range(4, 13) if n >= 2 * k):
        return True
    if n >= 18:
        runs = list(zip(words, words[1:], words[2:], words[3:], words[4:]))
        if len(set(runs)) <= len(runs) - 2 and max(Counter(runs).values()) >= 3:
            return True
    return (
        (":" in asc and len(has["clock"].findall(asc)) >= 3)
        or ("(published)" in low and has["min_read"].search(asc) is not None)
        or (any(x in low for x in (" advertisement", " follow us", " share ")) and has["wire"].match(asc) is not None)
        or (("advertising" in low or "read more" in low) and has["reading"].search(asc) is not None)
        or ("section:" in low and len(has["days_ago"].findall(asc)) >= 2)
        or len(set(has["symbol"].findall(asc))) >= 3
    )


@F.pandas_udf(T.BooleanType())
def _artifacts(low: pd.Series) -> pd.Series:
    return low.map(lambda x: x is not None and artifacts_in(x)).astype(bool)


def source_artifacts(col: Column) -> Column:
    """``contains_source_artifacts`` for a column of its own, at a part of its cost; not inside a lambda, nor over another Python UDF."""
    return _artifacts(squash(casefold(col)))


def _opening_repeats(words: Column) -> Column:
    return F.exists(
        F.sequence(F.lit(4), F.lit(12)),
        lambda n: (F.size(words) >= 2 * n)
        & (F.slice(words, 1, n) == F.slice(words, n + 1, n)),
    )


def _shingle_repeats(words: Column) -> Column:
    """Any run of five words three times: equal neighbours two apart once the runs are sorted."""
    starts = F.sequence(F.lit(1), F.size(words) - 4)
    # Three equal runs leave at least two fewer distinct hashes: most texts stop here.
    some = let(
        F.transform(starts, lambda i: F.xxhash64(F.slice(words, i, 5))),
        lambda h: F.size(F.array_distinct(h)) <= F.size(h) - 2,
    )
    thrice = F.when(
        some,
        let(
            F.array_sort(F.transform(starts, lambda i: F.array_join(F.slice(words, i, 5), " "))),
            lambda r: F.exists(
                F.sequence(F.lit(1), F.size(r) - 2),
                lambda i: F.get(r, i - 1) == F.get(r, i + 1),
            ),
        ),
    ).otherwise(F.lit(False))
    return F.when(F.size(words) >= 18, thrice).otherwise(F.lit(False))


# --- titles ----------------------------------------------------------------------
def forum_title(col: Column) -> Column:
    """First meaningful line, without list marks or a trailing domain, at most 100 characters."""
    bullet = r"^(?:[-*•]|\d+[.)])\s+"
    broken = F.regexp_replace(col, r"(?i)<br\s*/?>", "\n")
    lines = F.filter(
        F.transform(F.split(broken, LINE_BREAK), strip_space), lambda line: line != ""
    )

    def head(ls: Column) -> Column:
        first = F.coalesce(F.get(ls, F.lit(0)), col)
        listed = F.exists(F.slice(ls, 2, F.greatest(F.size(ls), F.lit(1))), lambda x: x.rlike(bullet))
        return F.when(
            listed & first.contains(" - "), F.substring_index(first, " - ", 1)
        ).otherwise(first)

    first = let(lines, head)
    first = F.regexp_replace(first, r"^\s*(?:#{1,6}|[-*•]|\d+[.)])\s+", "")
    first = F.regexp_replace(
        first, r"(?i)\s+(?:-|\|)\s+(?:www\.)?(?:[a-z0-9-]+\.)+[a-z]{2,}\s*$", ""
    )
    title = F.regexp_replace(plain_text(first, 100), r"^[ .\-|•]+|[ .\-|•]+$", "")
    return F.coalesce(F.nullif(title, F.lit("")), F.lit("New feed item"))


# --- comparison of statements -----------------------------------------------------
def comparison_text(col: Column) -> Column:
    return F.trim(F.regexp_replace(casefold(col), "[^a-z0-9]+", " "))


def _word_root(word: Column) -> Column:
    n = F.length(word)
    return (
        F.when((n > 5) & word.endswith("ing"), F.substring(word, F.lit(1), n - 3))
        .when(
            (n > 5) & word.endswith("ies"),
            F.concat(F.substring(word, F.lit(1), n - 3), F.lit("y")),
        )
        .when((n > 4) & word.endswith("s"), F.substring(word, F.lit(1), n - 1))
        .otherwise(word)
    )


def content_words(compared: Column) -> Column:
    """Distinct stemmed words of a comparison text, without filler words."""
    kept = F.filter(
        F.split(compared, " "),
        lambda w: (w != "") & ~w.isin(list(fixed.COMPARISON_STOP_WORDS)),
    )
    return F.array_distinct(F.transform(kept, _word_root))


def overlap_redundant(text_a: Column, words_a: Column, text_b: Column, words_b: Column) -> Column:
    """Whether statement a restates statement b; an empty b restates nothing."""
    short = F.least(F.size(words_a), F.size(words_b))
    long = F.greatest(F.size(words_a), F.size(words_b))
    shared = F.size(F.array_intersect(words_a, words_b))
    close = (short >= 4) & (shared >= 0.8 * short) & (long <= 1.45 * short)
    return (text_b != "") & ((text_a == text_b) | close)


def repeats_reference(value: Column, reference: Column) -> Column:
    """Whether ``value`` restates ``reference`` (an empty value always does)."""
    pair = F.struct(comparison_text(value).alias("a"), comparison_text(reference).alias("b"))
    return let(
        pair,
        lambda p: (p["a"] == "")
        | overlap_redundant(p["a"], content_words(p["a"]), p["b"], content_words(p["b"])),
    )


def story_update_detail(title: Column, description: Column, limit: int = 500) -> Column:
    """The description, unless it is empty, page furniture or just the headline again."""
    pair = F.struct(
        comparison_text(plain_text(title, 500)).alias("h"), plain_text(description, limit).alias("d")
    )
    return let(
        pair,
        lambda p: F.when(
            (p["d"] == "")
            | contains_source_artifacts(p["d"])
            | (comparison_text(p["d"]) == p["h"]),
            F.lit(""),
        ).otherwise(p["d"]),
    )


# --- excerpts -----------------------------------------------------------------------
def excerpt_of_plain(clean: Column, limit: int) -> Column:
    """Whole sentences up to ``limit`` of an already plain value, else a word cut with a period."""
    parts = F.split(clean, r"(?<=[.!?])\s+")

    def choose(ps: Column) -> Column:
        first = F.element_at(ps, 1)
        head = F.regexp_replace(F.substring(first, 1, limit), r" [^ ]*$", "")
        head = F.regexp_replace(head, r"[,;:]+$", "")
        # Running length stops at the first sentence that would overflow.
        taken = F.aggregate(
            ps,
            F.struct(F.lit("").alias("s"), F.lit(False).alias("done")),
            lambda acc, p: F.when(acc["done"], acc).otherwise(
                let(
                    F.when(acc["s"] == "", p).otherwise(F.concat(acc["s"], F.lit(" "), p)),
                    lambda nxt: F.when(
                        F.length(nxt) > limit, F.struct(acc["s"].alias("s"), F.lit(True).alias("done"))
                    ).otherwise(F.struct(nxt.alias("s"), F.lit(False).alias("done"))),
                )
            ),
            lambda acc: acc["s"],
        )
        return (
            F.when(F.length(first) > limit, F.when(head != "", F.concat(head, F.lit("."))).otherwise(first))
            .otherwise(taken)
        )

    return F.when(F.length(clean) <= limit, clean).otherwise(let(parts, choose))


def complete_excerpt(col: Column, limit: int) -> Column:
    return excerpt_of_plain(plain_text(col, 2000), limit)


# --- fallback summaries ---------------------------------------------------------------
def strip_wire_dateline(col: Column) -> Column:
    """Drop everything up to an agency dateline in the first 500 characters, if enough remains."""
    agencies = "|".join(fixed.WIRE_AGENCIES)
    pattern = rf"(?is)^.*?\((?:{agencies})\)\s*[-–—]{{1,2}}\s*"
    matched = F.regexp_extract(F.substring(col, 1, 500), pattern, 0)
    tail = let(
        matched, lambda m: F.when(m != "", strip_space(F.substring(col, F.length(m) + 1, F.length(col))))
    )
    return let(tail, lambda t: F.when(F.length(t) >= 35, t).otherwise(col))


def _trim_repeated_headline(value: Column, title: Column) -> Column:
    def straight(c):
        return F.when(c.contains("‘") | c.contains("’"), F.translate(c, "‘’", "''")).otherwise(c)

    reference = F.regexp_replace(straight(title), r"(?i)^(?:analysis|exclusive|watch):\s*", "")
    reference = strip_space(
        F.regexp_replace(
            reference, r"(?i)\s*[-|]\s*(?:ap|associated press|reuters|reuters\.com)\s*$", ""
        )
    )

    def after(pair: Column) -> Column:
        at = F.when(F.length(pair["r"]) >= 24, F.position(casefold(pair["r"]), casefold(pair["v"]))).otherwise(0)
        return let(F.struct(pair["v"].alias("v"), pair["r"].alias("r"), at.alias("at")), trimmed)

    def trimmed(pair: Column) -> Column:
        tail = F.substring(pair["v"], pair["at"] + F.length(pair["r"]), F.length(pair["v"]))
        tail = F.regexp_replace(tail, r"^[ :\-]+", "")
        tail = F.regexp_replace(tail, r"(?i)^(?:exclusive|report)\s+", "")
        return F.when((pair["at"] > 0) & (F.length(tail) >= 35), tail).otherwise(value)

    return let(F.struct(straight(value).alias("v"), reference.alias("r")), after)


def sentences(col: Column) -> Column:
    return F.transform(F.split(col, SENTENCE_END), strip_space)


def clean_fallback_candidate(col: Column, title: Column) -> Column:
    """Up to two publishable sentences of scraped copy, or null.

    Runs over the whole value; each stage is a native expression, bound once with ``let``. ``with_fallback`` adds the same
    as a column, at a part of its cost.
    """
    chosen = let(fallback_text(col, title), lambda t: let(_opened(t), lambda o: _two_sentences(F.when(~contains_source_artifacts(t), o), title)))
    return let(chosen, lambda s: F.when(s.isNotNull(), checked_sentence(s, "summary text", 800)["value"]))


def with_fallback(df: DataFrame, name: str, value: Column, title: Column) -> DataFrame:
    """``df`` with ``clean_fallback_candidate`` as a column; page furniture is looked for by an Arrow function over whole columns."""
    kept = df.columns
    out = df.withColumns({"_title": title, "_text": fallback_text(value, title)})
    out = out.withColumn("_open", _opened(F.col("_text")))
    out = out.withColumn("_said", statement_text(_two_sentences(F.col("_open"), F.col("_title"))))
    clean = ~source_artifacts(F.when(F.col("_open").isNotNull(), F.col("_text")))
    error = statement_error(F.col("_said"), "summary text", 800, artifacts=source_artifacts(F.col("_said")))
    return out.select(*kept, F.when(clean & error.isNull(), F.col("_said")).alias(name))


def fallback_text(col: Column, title: Column) -> Column:
    """Scraped copy without links, references, marks, datelines and its repeated headline."""
    text = F.regexp_replace(col, r"https?://" + SPACE.replace("[", "[^", 1) + "+", " ")
    text = F.regexp_replace(text, r"\[(?:\d+|[^\]]{1,80})\]", " ")
    text = F.regexp_replace(text, r"[*_#>`]+", " ")
    text = F.regexp_replace(text, r"(?i)^[^\n]*?\(Reuters\)\s*[-–—]\s*", "")
    text = F.regexp_replace(text, rf"(?:^|{_ANY_SPACE})[-•]{_ANY_SPACE}+", ". ")
    text = F.regexp_replace(F.regexp_replace(text, rf"{_NO_BLANK}{_ANY_SPACE}*|\x20{_ANY_SPACE}+", " "), r"^[ .]+|[ .]+$", "")
    return let(text, lambda t0: let(strip_wire_dateline(t0), lambda t1: _trim_repeated_headline(t1, title)))


def _opened(text: Column) -> Column:
    """The text from its first sentence that begins as one, unless that is empty or holds what may never be published."""
    lower_start = r"^\p{Ll}"
    tail = let(
        F.split(text, SENTENCE_END, 2),
        lambda ps: F.when(F.size(ps) == 2, strip_space(F.get(ps, F.lit(1)))),
    )
    opened = F.when(text.rlike(lower_start), tail).otherwise(text)
    return let(
        opened,
        lambda o: F.when(
            (o != "") & ~o.rlike(lower_start) & ~let(casefold(o), lambda low: contains_any(low, fixed.FALLBACK_REJECT_MARKERS)), o
        ),
    )


def _two_sentences(usable: Column, title: Column) -> Column:
    def pick(x: Column) -> Column:
        # Stops looking after two sentences; the headline is compared in prepared form.
        def fits(s: Column) -> Column:
            return let(
                comparison_text(s),
                lambda c: (c != "")
                & ~overlap_redundant(c, content_words(c), x["title"], x["words"]),
            )

        def more(acc: Column, part: Column) -> Column:
            return let(
                strip_space(part),
                lambda s: F.when((F.length(s) >= 35) & fits(s), F.concat(acc, F.array(s))).otherwise(acc),
            )

        keep = F.aggregate(
            F.split(x["text"], SENTENCE_END),
            F.array().cast("array<string>"),
            lambda acc, part: F.when((F.size(acc) < 2) & (F.length(part) >= 35), more(acc, part)).otherwise(acc),
        )
        return let(
            F.array_join(keep, " "),
            lambda j: F.when(
                (j != "") & ~j.rlike(r"[.!?]$"), F.concat(j, F.lit("."))
            ).otherwise(j),
        )

    known = let(
        comparison_text(title),
        lambda t: F.struct(t.alias("title"), content_words(t).alias("words")),
    )
    return let(
        F.struct(usable.alias("text"), known.alias("k")),
        lambda x: F.when(
            x["text"].isNotNull(),
            let(
                F.struct(
                    x["text"].alias("text"), x["k"]["title"].alias("title"), x["k"]["words"].alias("words")
                ),
                pick,
            ),
        ),
    )


def fallback_quality(col: Column) -> Column:
    """Prefer longer, finished, untruncated summaries."""
    ends = col.rlike(r"[.!?]$")
    cut_off = col.contains("...") | col.contains("…")
    return (
        F.least(F.length(col), F.lit(600))
        + F.when(ends, F.lit(120)).otherwise(F.lit(-180))
        + F.when(cut_off, F.lit(-400)).otherwise(F.lit(0))
    )


def strip_emoji(col: Column) -> Column:
    ranges = r"[\x{1F1E6}-\x{1F1FF}\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}]"
    return strip_space(F.regexp_replace(col, ranges, ""))


def word_count(col: Column) -> Column:
    """Words made of letters, digits, underscores, apostrophes and dashes."""
    return F.regexp_count(col, F.lit(r"[\p{L}\p{N}_](?:[\p{L}\p{N}_'-]*[\p{L}\p{N}_])?"))


def claim_limit(col: Column) -> Column:
    """Number of statements of three or more words, between 1 and 5."""
    parts = F.split(col, rf"(?:[.!?]+{SPACE}+)|\n+")
    long = F.filter(parts, lambda p: F.size(F.split(squash(p), " ")) >= 3)
    return F.greatest(F.lit(1), F.least(F.lit(5), F.size(long)))


# --- checks on generated statements -------------------------------------------------------
def statement_text(col: Column) -> Column:
    """A statement with plain dashes and stops, without dateline, pictographs and mentions."""
    text = squash(F.translate(col, "—–", "--"))
    text = F.regexp_replace(text, r"\.{2,}", ".")
    return let(let(text, strip_wire_dateline), lambda t: neutralize_mentions(strip_emoji(t)))


def statement_error(t: Column, name: str, limit: int, opening: bool = False, artifacts: Column | None = None) -> Column:
    """Why a statement is refused, or null. ``artifacts``: whether it holds page furniture, if that is known."""
    found = contains_source_artifacts(t) if artifacts is None else artifacts
    said = F.when(let(casefold(t), lambda low: contains_any(low, fixed.CANNED_MODEL_PHRASES)), F.lit("canned model language")).when(
        let(casefold(t), lambda low: contains_any(low, fixed.PROCESS_PHRASES)), F.lit("internal analysis details")
    )
    return (
        F.when(t.isNull() | (t == "") | (F.length(t) > limit), F.lit(f"invalid {name}"))
        .when(F.lit(opening) & t.rlike(r"^[a-z]+(?![A-Za-z])"), F.lit("incomplete summary opening"))
        .when(found, F.lit(f"page chrome in {name}"))
        .otherwise(said)
    )


def checked_sentence(col: Column, name: str, limit: int, opening: bool = False) -> Column:
    """Clean one statement; a struct of ``value`` (null when refused) and ``error``."""

    def verdict(t: Column) -> Column:
        error = statement_error(t, name, limit, opening)
        return let(error, lambda e: F.struct(F.when(e.isNull(), t).alias("value"), e.alias("error")))

    return let(statement_text(col), verdict)
