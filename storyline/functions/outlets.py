"""Outlet identity, editorial leaning and labels.

The profile table is a fixed list of 35 rows, so it is compiled into the expression instead of
being joined: the lookup needs no shuffle and no broadcast, and works in any filter.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from storyline.functions import fixed
from storyline.functions.text import (
    casefold,
    let,
    literal_array,
    literal_map,
    plain_text,
    squash,
)
from storyline.functions.urls import bare_host, hostname


def normalized_name(col: Column) -> Column:
    return F.trim(
        F.regexp_replace(casefold(F.coalesce(col, F.lit(""))), "[^a-z0-9]+", " ")
    )


def _plain_name(value: str) -> str:
    return re.sub(r"[^a-z0-9]+", " ", value.lower()).strip()


def profile_index(publisher: Column, url: Column) -> Column:
    """Position of the outlet profile: exact alias first, then the first matching domain."""

    def find(key: Column) -> Column:
        name, host = key["name"], key["host"]
        alias = domain = None
        for i, (_, _, _, aliases, domains) in enumerate(fixed.OUTLETS):
            by_alias = name.isin([_plain_name(a) for a in aliases])
            by_domain = reduce(
                lambda a, b: a | b,
                [
                    (host == d) | host.endswith("." + d) | name.contains(_plain_name(d))
                    for d in domains
                ],
            )
            alias = F.when(by_alias, i) if alias is None else alias.when(by_alias, i)
            domain = F.when(by_domain, i) if domain is None else domain.when(by_domain, i)
        return F.coalesce(alias, domain)

    return let(
        F.struct(
            normalized_name(publisher).alias("name"),
            bare_host(F.coalesce(url, F.lit(""))).alias("host"),
        ),
        find,
    )


def _of_profile(index: Column, field: int) -> Column:
    return F.get(literal_array(o[field] for o in fixed.OUTLETS), index)


def is_official(publisher: Column, url: Column) -> Column:
    host = bare_host(F.coalesce(url, F.lit("")))
    name = normalized_name(publisher)
    by_host = reduce(lambda a, b: a | b, [host.endswith(s) for s in fixed.OFFICIAL_HOST_SUFFIXES])
    by_name = reduce(lambda a, b: a | b, [name.contains(m) for m in fixed.OFFICIAL_NAME_MARKERS])
    return by_host | by_name


def canonical_source_name(publisher: Column, url: Column) -> Column:
    cleaned = F.regexp_replace(
        F.regexp_replace(
            squash(F.coalesce(publisher, F.lit(""))), r"^[ \-|:]+", ""
        ),
        r"[ \-|:]+$",
        "",
    )
    host = F.substring(bare_host(F.coalesce(url, F.lit(""))), 1, 100)
    return F.coalesce(
        _of_profile(profile_index(publisher, url), 0),
        F.when(cleaned != "", F.substring(cleaned, 1, 100)),
        F.when(host != "", host),
        F.lit("Unknown source"),
    )


def source_bias_bucket(publisher: Column, url: Column) -> Column:
    bias = _of_profile(profile_index(publisher, url), 1)
    return F.when(is_official(publisher, url), F.lit("official")).otherwise(
        F.coalesce(bias, F.lit("unrated"))
    )


def source_bias_score(publisher: Column, url: Column) -> Column:
    return _of_profile(profile_index(publisher, url), 2)


def publisher_label(publisher: Column, url: Column) -> Column:
    """Short display name of an outlet."""
    label = F.regexp_replace(plain_text(publisher, 100), "^[ \"']+|[ \"']+$", "")
    queried = F.regexp_extract(label, r"(?i)site:([a-z0-9.-]+)", 1)
    label = F.when(queried != "", queried).otherwise(label)
    known = literal_map(fixed.KNOWN_LABELS.items())

    def choose(s: Column) -> Column:
        cand = F.regexp_replace(casefold(s["label"]), r"^www\.", "")
        fallback = F.coalesce(
            F.element_at(known, s["host"]),
            F.when(s["host"] != "", s["host"]),
            F.lit("Source"),
        )
        return (
            F.when(cand.isin(list(fixed.KNOWN_LABELS)), F.element_at(known, cand))
            .when(
                cand.contains("google news") & (s["host"] == fixed.AGGREGATOR_HOST),
                F.lit("Google News"),
            )
            .when(s["label"] != "", s["label"])
            .otherwise(fallback)
        )

    host = F.regexp_replace(hostname(url), r"^www\.", "")
    return let(F.struct(label.alias("label"), host.alias("host")), choose)


def source_priority(publisher: Column, feed_name: Column, priorities: dict[str, int]) -> Column:
    """Configured priority by publisher, else by feed name, else 0 (names compared case-folded)."""
    if not priorities:
        return F.lit(0)
    table = literal_map((k.casefold(), v) for k, v in priorities.items())
    return F.coalesce(
        F.element_at(table, casefold(publisher)),
        F.element_at(table, casefold(feed_name)),
        F.lit(0),
    )


def _profile_sql() -> str:
    """The profile lookup as SQL text over ``name`` and ``host``."""

    def q(v):
        return "'" + v.replace("'", "\\'") + "'"

    alias = " ".join(
        f"WHEN name IN ({', '.join(q(_plain_name(a)) for a in o[3])}) THEN {i}"
        for i, o in enumerate(fixed.OUTLETS)
    )
    domain = " ".join(
        "WHEN "
        + " OR ".join(
            f"host = {q(d)} OR endswith(host, {q('.' + d)}) OR contains(name, {q(_plain_name(d))})"
            for d in o[4]
        )
        + f" THEN {i}"
        for i, o in enumerate(fixed.OUTLETS)
    )
    return f"coalesce(CASE {alias} END, CASE {domain} END)"


def register_sql(spark) -> None:
    """Offer ``canonical_source_name`` and ``source_bias_bucket`` to SQL text.

    They are SQL functions: Catalyst inlines them, so no Python runs per row.
    """
    name_sql = (
        "trim(regexp_replace(replace(lower(coalesce(publisher, '')), 'ß', 'ss'), '[^a-z0-9]+', ' '))"
    )
    host_sql = (
        "regexp_replace(lower(regexp_extract(coalesce(url, ''), "
        "'^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#]*@)?([^/?#:]*)', 1)), '^www[.]', '')"
    )

    def names(field):
        return "array(" + ", ".join("'" + str(o[field]) + "'" for o in fixed.OUTLETS) + ")"

    official = " OR ".join(
        [f"endswith(host, '{s}')" for s in fixed.OFFICIAL_HOST_SUFFIXES]
        + [f"contains(name, '{m}')" for m in fixed.OFFICIAL_NAME_MARKERS]
    )
    for func, args in (("storyline_outlet_name", "name STRING, host STRING"),):
        spark.sql(
            f"CREATE OR REPLACE TEMPORARY FUNCTION {func}({args}) RETURNS INT "
            f"RETURN {_profile_sql()}"
        )
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION storyline_is_official(name STRING, host STRING) "
        f"RETURNS BOOLEAN RETURN {official}"
    )
    cleaned = (
        "regexp_replace(regexp_replace(trim(regexp_replace(coalesce(publisher, ''), '[ \\\\t\\\\n\\\\r]+', ' ')), "
        "'^[ |:-]+', ''), '[ |:-]+$', '')"
    )
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION canonical_source_name(publisher STRING, url STRING) "
        f"RETURNS STRING RETURN coalesce(get({names(0)}, storyline_outlet_name({name_sql}, {host_sql})), "
        f"nullif(substring({cleaned}, 1, 100), ''), nullif(substring({host_sql}, 1, 100), ''), "
        "'Unknown source')"
    )
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION source_bias_bucket(publisher STRING, url STRING) "
        f"RETURNS STRING RETURN CASE WHEN storyline_is_official({name_sql}, {host_sql}) THEN 'official' "
        f"ELSE coalesce(get({names(1)}, storyline_outlet_name({name_sql}, {host_sql})), 'unrated') END"
    )
