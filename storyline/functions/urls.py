"""URL functions as native columns (RFC 3986 pieces by pattern; no row-wise Python)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from storyline.functions import fixed
from storyline.functions.text import casefold, let, plain_text, strip_space

# scheme, authority, path, query
URL = r"^([A-Za-z][A-Za-z0-9+.\-]*):(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"
ARTICLE_URL = r"""(?i)https?://[^\s<>\[\]{}"']+"""


def _piece(col: Column, group: int) -> Column:
    return F.regexp_extract(col, URL, group)


def _host_of_authority(authority: Column) -> Column:
    """Host part, lower case: drop user info and port, keep bracketed addresses whole."""
    bare = F.substring_index(authority, "@", -1)
    return F.lower(F.regexp_extract(bare, r"^(?:\[([^\]]*)\]|([^:]*))", 0))


def hostname(col: Column) -> Column:
    """Lower-case host of a URL, empty where there is none."""
    return F.coalesce(_host_of_authority(_piece(col, 2)), F.lit(""))


def bare_host(col: Column) -> Column:
    """Host without a leading ``www.``."""
    return F.regexp_replace(casefold(hostname(col)), r"^www\.", "")


def safe_external_link(col: Column) -> Column:
    """The URL itself when it is http(s), short, has a host and carries no credentials; else ''."""
    authority = _piece(col, 2)
    userinfo = F.regexp_extract(authority, r"^(.*)@", 1)
    ok = (
        (F.length(col) <= 2048)
        & F.lower(_piece(col, 1)).isin("http", "https")
        & (hostname(col) != "")
        & userinfo.isin("", ":")
    )
    return F.when(ok, col).otherwise(F.lit(""))


def is_https(col: Column) -> Column:
    return F.lower(_piece(col, 1)) == "https"


def _decode(col: Column) -> Column:
    # A stray percent sign is literal text; escape it first, so decoding never fails.
    guarded = F.regexp_replace(col, "%(?![0-9A-Fa-f]{2})", "%25")
    return F.coalesce(F.try_url_decode(guarded), col)


def _encode(col: Column) -> Column:
    return F.replace(
        F.replace(F.url_encode(col), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~")
    )


def _query(raw: Column) -> Column:
    """Query without tracking keys, sorted by key and value, re-encoded; blanks are kept."""
    pairs = F.transform(
        F.filter(F.split(raw, "&"), lambda p: p != ""),
        lambda p: F.struct(
            _decode(F.regexp_extract(p, r"^([^=]*)", 1)).alias("k"),
            _decode(F.regexp_extract(p, r"^[^=]*=(.*)$", 1)).alias("v"),
        ),
    )
    kept = F.filter(
        pairs,
        lambda p: ~F.lower(p["k"]).isin(list(fixed.TRACKING_KEYS))
        & ~F.lower(p["k"]).rlike("^(?:" + "|".join(fixed.TRACKING_PREFIXES) + ")"),
    )
    return F.array_join(
        F.transform(
            F.array_sort(kept), lambda p: F.concat(_encode(p["k"]), F.lit("="), _encode(p["v"]))
        ),
        "&",
    )


def normalize_url(col: Column) -> Column:
    """Canonical form of a URL; values without scheme or host come back stripped."""
    value = F.regexp_replace(strip_space(col), r"[\t\r\n]", "")

    def split(v: Column) -> Column:
        return F.struct(
            v.alias("raw"),
            F.lower(_piece(v, 1)).alias("scheme"),
            F.regexp_replace(_host_of_authority(_piece(v, 2)), r"\.+$", "").alias("host"),
            F.regexp_extract(_piece(v, 2), r":([0-9]+)$", 1).try_cast("int").alias("port"),
            F.regexp_replace(F.concat(F.lit("/"), _piece(v, 3)), "/{2,}", "/").alias("path"),
            _query(_piece(v, 4)).alias("query"),
        )

    def join(u: Column) -> Column:
        port = u["port"]
        standard = F.when(u["scheme"] == "https", port == 443).otherwise(
            (u["scheme"] == "http") & (port == 80)
        )
        suffix = F.when(port.isNull() | (port == 0) | standard, F.lit("")).otherwise(
            F.concat(F.lit(":"), port.cast("string"))
        )
        path = F.when(
            u["host"] == fixed.AGGREGATOR_HOST,
            F.regexp_replace(u["path"], "^/(?:rss|atom)/articles/", "/articles/"),
        ).otherwise(u["path"])
        # Trailing slashes go, except for the root path.
        path = F.regexp_replace(path, "(?<=.)/+$", "")
        query = F.when(u["query"] == "", F.lit("")).otherwise(F.concat(F.lit("?"), u["query"]))
        return F.when((u["scheme"] == "") | (u["host"] == ""), u["raw"]).otherwise(
            F.concat(u["scheme"], F.lit("://"), u["host"], suffix, path, query)
        )

    return let(let(value, split), join)


def extract_article_urls(col: Column) -> Column:
    """Distinct https links of a message in order of appearance (case-insensitive distinct)."""
    found = F.transform(
        F.regexp_extract_all(col, F.lit(ARTICLE_URL), F.lit(0)),
        lambda u: F.regexp_replace(u, r"[.,;:!?)\]}]+$", ""),
    )
    safe = F.filter(found, lambda u: (safe_external_link(u) != "") & is_https(u))
    return let(
        safe,
        lambda urls: let(
            F.transform(urls, casefold),
            lambda low: F.filter(
                urls, lambda u, i: F.array_position(low, casefold(u)) == (i + 1).cast("long")
            ),
        ),
    )


def url_label(col: Column) -> Column:
    """Host and last path segment, separators as blanks."""
    host = F.regexp_replace(hostname(col), r"^www\.", "")
    host = F.coalesce(F.nullif(host, F.lit("")), F.lit("Article"))
    last = F.regexp_extract(F.rtrim(_piece(col, 3), F.lit("/")), r"([^/]*)$", 1)
    last = F.translate(last, "-_", "  ")
    label = F.when(last == "", host).otherwise(F.concat(host, F.lit(": "), last))
    return plain_text(label, 100)
