"""SQL text of the scalar functions in the DuckDB dialect, composed by string helpers."""

from __future__ import annotations

import re

from storyline.functions import fixed
from storyline.plans.bindings import sql_text

RE2_SPACE = (
    r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)


def lst(values) -> str:
    return "[" + ", ".join(sql_text(v) for v in values) + "]"


def fold(x: str) -> str:
    return f"replace(lower({x}), 'ß', 'ss')"


def squash(x: str) -> str:
    return f"trim(regexp_replace({x}, '{RE2_SPACE}+', ' ', 'g'))"


def cut(x: str, n: int) -> str:
    return f"(CASE WHEN length({x}) <= {n} THEN {x} ELSE rtrim(substring({x}, 1, {n - 1})) || '…' END)"


def mentions(x: str) -> str:
    return f"regexp_replace({x}, '(?i)@(everyone|here|[!&]?\\p{{Nd}}+)', '@​\\1', 'g')"


def plain(x: str, n: int) -> str:
    """Plain text of values without markup."""
    return cut(mentions(squash(x)), n)


def ascii_words(x: str) -> str:
    # RE2 has no class intersection: non-ASCII letters and digits one block at a time.
    return f"regexp_replace({x}, '[^\\x00-\\x{{BF}}×÷‐-⁯]', '_', 'g')"


def any_of(x: str, terms) -> str:
    return "(" + " OR ".join(f"contains({x}, {sql_text(t)})" for t in terms) + ")"


def hits(x: str, terms) -> str:
    return "(" + " + ".join(f"CAST(contains({x}, {sql_text(t)}) AS INTEGER)" for t in terms) + ")"


EVENT_MAP = (
    "MAP {" + ", ".join(
        f"{sql_text(f)}: {sql_text(r)}" for r, fs in fixed.EVENT_FORMS.items() for f in fs
    ) + "}"
)


def words_of_lower(x: str) -> str:
    for a, b in fixed.SYNONYMS:
        x = f"replace({x}, {sql_text(a)}, {sql_text(b)})"
    return (
        f"list_filter(list_transform(regexp_extract_all({x}, '[a-z0-9]+(?:\\.[0-9]+)?'), "
        f"lambda w: coalesce({EVENT_MAP}[w], w)), "
        f"lambda w: NOT list_contains({lst(fixed.STOP_WORDS)}, w))"
    )


def headline_words(x: str) -> str:
    low = f"lower({plain(x, 500)})"
    low = f"regexp_replace({low}, '\\b(\\d+(?:\\.\\d+)?)\\s*-\\s*basis\\s*-\\s*points?\\b', '\\1 bps', 'g')"
    low = f"regexp_replace({low}, '\\b(\\d+(?:\\.\\d+)?)\\s+basis\\s+points?\\b', '\\1 bps', 'g')"
    return words_of_lower(low)


def token_set(words: str) -> str:
    return (
        f"list_sort(list_distinct(list_filter({words}, "
        f"lambda w: length(w) > 1 OR regexp_matches(w, '^[0-9]+$'))))"
    )


def entities(title: str, summary: str) -> str:
    text = ascii_words(f"{title} || '. ' || {summary}")
    runs = (
        f"list_distinct(regexp_extract_all({text}, "
        "'\\b(?:[A-Z][A-Za-z0-9&.-]+(?:\\s+[A-Z][A-Za-z0-9&.-]+){0,3}|[A-Z]{2,})\\b'))"
    )
    names = f"list_transform({runs}, lambda r: array_to_string({words_of_lower('lower(r)')}, ' '))"
    return f"list_sort(list_distinct(list_filter({names}, lambda n: n <> '')))"


def keywords(title_tokens: str, desc_tokens: str) -> str:
    def ranked(x):
        return (
            f"list_transform(list_sort(list_transform({x}, lambda t: {{'n': -length(t), 't': t}})), "
            "lambda s: s.t)"
        )

    rest = f"list_filter({desc_tokens}, lambda d: NOT list_contains({title_tokens}, d))"
    return f"(({ranked(title_tokens)} || {ranked(rest)})[1:16])"


def numbers(words: str) -> str:
    pattern = r"\b\d+(?:\.\d+)?(?:\s?(?:bps|basis points?|million|billion|trillion))?\b"
    return (
        f"list_sort(list_distinct(regexp_extract_all(array_to_string({words}, ' '), '{pattern}')))"
    )


def artifacts(low: str, asc: str, words: str) -> str:
    """``low`` squashed and folded, ``asc`` its ASCII form, ``words`` its [a-z0-9]+ runs."""
    symbols = " + ".join(
        f"CAST(regexp_matches({asc}, '\\b{s}\\b') AS INTEGER)" for s in fixed.MARKET_SYMBOLS
    )
    runs = (
        f"list_sort(list_transform(range(1, len({words}) - 3), "
        f"lambda i: array_to_string({words}[i:i+4], ' ')))"
    )
    return f"""({any_of(low, fixed.PAGE_MARKERS)}
      OR len(regexp_extract_all({asc}, '\\b\\d{{1,2}}:\\d{{2}}\\b')) >= 3
      OR (contains({low}, '(published)') AND regexp_matches({asc}, '\\b\\d+\\s+min read\\b'))
      OR (regexp_matches({asc}, '^by (?:reuters|the associated press|associated press|ap)\\b')
          AND {any_of(low, (" advertisement", " follow us", " share "))})
      OR ({any_of(low, ("advertising", "read more"))}
          AND regexp_matches({asc}, '\\b\\d+\\s+min(?:ute)?s?\\s+(?:read|reading time)\\b'))
      OR (contains({low}, 'section:')
          AND len(regexp_extract_all({asc}, '\\b\\d+\\s+days?\\s+ago\\b')) >= 2)
      OR ({symbols}) >= 3
      OR len(list_filter(range(4, 13), lambda n: len({words}) >= 2 * n
             AND {words}[1:n] = {words}[n+1:2*n])) > 0
      OR (len({words}) >= 18 AND
          len(list_filter(list_value({runs})[1:1], lambda r:
              len(list_filter(range(1, len(r) - 1), lambda i: r[i] = r[i+2])) > 0)) > 0))"""


def compared(x: str) -> str:
    return f"trim(regexp_replace({fold(x)}, '[^a-z0-9]+', ' ', 'g'))"


def content_words(c: str) -> str:
    root = (
        "CASE WHEN length(w) > 5 AND w LIKE '%ing' THEN w[1:length(w)-3] "
        "WHEN length(w) > 5 AND w LIKE '%ies' THEN w[1:length(w)-3] || 'y' "
        "WHEN length(w) > 4 AND w LIKE '%s' THEN w[1:length(w)-1] ELSE w END"
    )
    return (
        f"list_distinct(list_transform(list_filter(string_split({c}, ' '), "
        f"lambda w: w <> '' AND NOT list_contains({lst(fixed.COMPARISON_STOP_WORDS)}, w)), "
        f"lambda w: {root}))"
    )


def overlap_redundant(ta: str, wa: str, tb: str, wb: str) -> str:
    short, long = f"least(len({wa}), len({wb}))", f"greatest(len({wa}), len({wb}))"
    return (
        f"({tb} <> '' AND ({ta} = {tb} OR ({short} >= 4 "
        f"AND len(list_intersect({wa}, {wb})) >= 0.8 * {short} AND {long} <= 1.45 * {short})))"
    )


# --- URLs ----------------------------------------------------------------------
URL_RE = "^([A-Za-z][A-Za-z0-9+.\\-]*):(?://([^/?#]*))?([^?#]*)(?:\\?([^#]*))?(?:#.*)?$"


def piece(x: str, group: int) -> str:
    return f"regexp_extract({x}, '{URL_RE}', {group})"


def host(x: str) -> str:
    return f"lower(regexp_extract(regexp_replace({piece(x, 2)}, '^.*@', ''), '^[^:]*', 0))"


def bare_host(x: str) -> str:
    return f"regexp_replace({fold(host(x))}, '^www\\.', '')"


def safe_link(x: str) -> str:
    user = f"regexp_extract({piece(x, 2)}, '^(.*)@', 1)"
    return (
        f"(CASE WHEN length({x}) <= 2048 AND lower({piece(x, 1)}) IN ('http', 'https') "
        f"AND {host(x)} <> '' AND {user} IN ('', ':') THEN {x} ELSE '' END)"
    )


def normalize_url(x: str) -> str:
    scheme = f"lower({piece(x, 1)})"
    h = f"regexp_replace({host(x)}, '\\.+$', '')"
    port = f"TRY_CAST(regexp_extract({piece(x, 2)}, ':([0-9]+)$', 1) AS INTEGER)"
    path = f"regexp_replace('/' || {piece(x, 3)}, '/{{2,}}', '/', 'g')"
    path = (
        f"CASE WHEN {h} = '{fixed.AGGREGATOR_HOST}' "
        f"THEN regexp_replace({path}, '^/(?:rss|atom)/articles/', '/articles/') ELSE {path} END"
    )
    path = f"CASE WHEN ({path}) = '/' THEN '/' ELSE rtrim({path}, '/') END"

    def dec(v):
        return f"url_decode(replace({v}, '+', ' '))"

    def enc(v):
        return f"replace(url_encode({v}), '%20', '+')"

    pairs = (
        f"list_transform(list_filter(string_split({piece(x, 4)}, '&'), lambda p: p <> ''), "
        f"lambda p: {{'k': {dec("regexp_extract(p, '^([^=]*)', 1)")}, "
        f"'v': {dec("regexp_extract(p, '^[^=]*=(.*)$', 1)")}}})"
    )
    kept = (
        f"list_sort(list_filter({pairs}, lambda p: NOT list_contains({lst(fixed.TRACKING_KEYS)}, lower(p.k)) "
        f"AND NOT regexp_matches(lower(p.k), '^(?:{'|'.join(fixed.TRACKING_PREFIXES)})')))"
    )
    query = f"array_to_string(list_transform({kept}, lambda p: {enc('p.k')} || '=' || {enc('p.v')}), '&')"
    net = (
        f"{h} || CASE WHEN {port} IS NULL OR {port} = 0 OR ({scheme} = 'https' AND {port} = 443) "
        f"OR ({scheme} = 'http' AND {port} = 80) THEN '' ELSE ':' || CAST({port} AS VARCHAR) END"
    )
    return (
        f"(CASE WHEN {scheme} = '' OR {h} = '' THEN {x} ELSE {scheme} || '://' || {net} || ({path}) || "
        f"CASE WHEN {query} = '' THEN '' ELSE '?' || {query} END END)"
    )


# --- outlets ---------------------------------------------------------------------
def _plain_name(value: str) -> str:
    return re.sub(r"[^a-z0-9]+", " ", value.lower()).strip()


def profile_index(name: str, h: str) -> str:
    alias = "CASE " + " ".join(
        f"WHEN {name} IN ({', '.join(sql_text(_plain_name(a)) for a in o[3])}) THEN {i}"
        for i, o in enumerate(fixed.OUTLETS)
    ) + " END"
    domain = "CASE " + " ".join(
        "WHEN " + " OR ".join(
            f"{h} = {sql_text(d)} OR ends_with({h}, {sql_text('.' + d)}) "
            f"OR contains({name}, {sql_text(_plain_name(d))})" for d in o[4]
        ) + f" THEN {i}"
        for i, o in enumerate(fixed.OUTLETS)
    ) + " END"
    return f"coalesce({alias}, {domain})"


def outlet_columns(publisher: str, url: str) -> str:
    """Select list with outlet, bias and bias_score (through nested sub-expressions)."""
    name, h = compared(publisher), bare_host(url)
    idx = profile_index(name, h)
    official = (
        "(" + " OR ".join(f"ends_with({h}, {sql_text(s)})" for s in fixed.OFFICIAL_HOST_SUFFIXES)
        + " OR " + any_of(name, fixed.OFFICIAL_NAME_MARKERS) + ")"
    )
    names = lst([o[0] for o in fixed.OUTLETS])
    biases = lst([o[1] for o in fixed.OUTLETS])
    scores = "[" + ", ".join(str(o[2]) for o in fixed.OUTLETS) + "]"
    cleaned = f"trim({squash(publisher)}, ' -|:')"
    return (
        f"coalesce({names}[{idx} + 1], nullif(substring({cleaned}, 1, 100), ''), "
        f"nullif(substring({h}, 1, 100), ''), 'Unknown source') AS outlet, "
        f"CASE WHEN {official} THEN 'official' ELSE coalesce({biases}[{idx} + 1], 'unrated') END AS bias, "
        f"CAST({scores}[{idx} + 1] AS INTEGER) AS bias_score"
    )


# --- normalised articles -----------------------------------------------------------
def norm_cte(source: str = "items", name: str = "norm") -> str:
    """CTE chain that normalises ``source`` exactly as the Spark operator does."""
    return f"""{name}_p AS (
  SELECT * EXCLUDE (title, summary, publisher),
         coalesce(nullif({plain("title", 500)}, ''), 'Untitled story') AS title,
         {plain("summary", 4000)} AS summary0, {plain("publisher", 200)} AS publisher
  FROM {source}),
{name}_a AS (SELECT *, {squash(fold("summary0"))} AS low FROM {name}_p),
{name}_b AS MATERIALIZED (SELECT *, {ascii_words("low")} AS asc_low,
             regexp_extract_all(low, '[a-z0-9]+') AS low_words FROM {name}_a),
{name}_c AS (
  SELECT * EXCLUDE (low, asc_low, low_words, summary0),
         CASE WHEN summary0 = '' OR {artifacts("low", "asc_low", "low_words")}
              THEN title ELSE summary0 END AS summary
  FROM {name}_b),
{name}_w AS MATERIALIZED (
  SELECT *, {headline_words("title")} AS tw, {headline_words("summary")} AS dw,
         {headline_words("(title || ' ' || summary)")} AS bw
  FROM {name}_c),
{name}_t AS MATERIALIZED (
  SELECT * EXCLUDE (tw, dw, bw), {token_set("tw")} AS title_tokens,
         {token_set("dw")} AS description_tokens, {numbers("bw")} AS numbers
  FROM {name}_w),
{name}_k AS MATERIALIZED (SELECT *, {keywords("title_tokens", "description_tokens")} AS keywords FROM {name}_t),
{name} AS MATERIALIZED (
  SELECT *, array_to_string(title_tokens, ' ') AS normalized_title,
         {entities("title", "summary")} AS entities,
         list_filter(title_tokens, lambda t: list_contains({lst(fixed.EVENT_FORMS)}, t)) AS event_terms,
         {normalize_url("url")} AS canonical_url,
         sha256({fold("publisher")} || chr(10) || array_to_string(title_tokens, ' ') || chr(10)
                || array_to_string(keywords, ' ')) AS fingerprint
  FROM {name}_k)"""
