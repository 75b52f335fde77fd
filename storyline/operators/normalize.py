"""Item → normalised article, one narrow projection (no shuffle)."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storyline.functions import text as X
from storyline.functions.urls import normalize_url

FEATURES = ("title_tokens", "description_tokens", "entities", "keywords", "numbers", "event_terms")


_TEXT_FIELDS = (
    "title", "summary", "publisher", "title_head", "summary_head", "both_head", "twice_head",
)


@F.pandas_udf(T.StructType([*[T.StructField(n, T.StringType()) for n in _TEXT_FIELDS], T.StructField("bad", T.BooleanType())]))
def _texts(title: pd.Series, summary: pd.Series, publisher: pd.Series, low: pd.Series) -> pd.DataFrame:
    """Whether the summary is page furniture; plain and folded texts of the rows that need Python, null for every other row.

    ``low`` is the squashed, case-folded plain summary of those other rows.
    """

    def row(t, s, p, low):
        if t is None:
            return (None,) * 7 + (X.artifacts_in(low),)
        t, s, p = X.plain_value(t, 500), X.plain_value(s, 4000), X.plain_value(p, 200)
        head = t or "Untitled story"
        return (t, s, p, X.headline_value(head), X.headline_value(s),
                X.headline_value(f"{head} {s}"), X.headline_value(f"{head} {head}"), X.artifacts_in(X.folded_value(s)))

    rows = [row(*r) for r in zip(title, summary, publisher, low)]
    return pd.DataFrame(rows, columns=[*_TEXT_FIELDS, "bad"], dtype=object)


# Kept in a projection of its own: merged into what reads its fields, it would be called within expressions.
_texts = _texts.asNondeterministic()


def normalize_items(items: DataFrame, fallback_publisher: str = "") -> DataFrame:
    """Add normalised columns to items with title, summary, url and publisher (author optional).

    A contaminated or empty summary is replaced by the title.  Every set is a sorted array.
    """
    author = F.col("author") if "author" in items.columns else F.lit(None).cast("string")
    publisher = F.coalesce(
        F.when(F.col("publisher") != "", F.col("publisher")),
        F.when(author != "", author),
        F.lit(fallback_publisher),
    )
    rest = [c for c in items.columns if c not in ("title", "summary", "publisher", "url")]
    raw = items.select(
        *rest,
        F.col("url"),
        F.coalesce("title", F.lit("")).alias("title"),
        F.coalesce("summary", F.lit("")).alias("summary"),
        publisher.alias("publisher"),
    )
    special = reduce(
        lambda a, b: a | b,
        [X.has_markup(F.col(c)) for c in ("title", "summary", "publisher")]
        + [X.needs_folding(F.col(c)) for c in ("title", "summary")],
    )
    tidied = raw.withColumn("_special", special).withColumn("_s", F.when(~F.col("_special"), X.tidy(F.col("summary"), 4000)))
    # One Arrow pass; texts with markup or foldable characters are made there, of all others only the plain summary is looked at.
    # That summary is named twice: a column that is read once is merged into its reader, and Spark cannot call a Python function
    # whose arguments hold lambdas.
    low = F.when(F.col("_s").isNotNull(), X.squash(X.casefold(F.col("_s"))))
    marked = tidied.withColumn("_x", _texts(*[F.when(F.col("_special"), F.col(c)) for c in ("title", "summary", "publisher")], low)).drop("_special")
    both = F.concat_ws(" ", F.col("title"), F.col("summary"))
    plain = marked.select(
        *rest,
        "url",
        "_x",
        F.coalesce("_x.title", X.tidy(F.col("title"), 500)).alias("title"),
        F.coalesce("_x.summary", "_s").alias("summary"),
        F.coalesce("_x.publisher", X.tidy(F.col("publisher"), 200)).alias("publisher"),
    ).withColumn(
        "title", F.when(F.col("title") == "", F.lit("Untitled story")).otherwise(F.col("title"))
    )
    judged = plain.withColumn("_bad", (F.col("summary") == "") | F.col("_x.bad"))
    chosen = judged.select(
        *[c for c in judged.columns if c not in ("_x", "_bad", "summary")],
        F.when(F.col("_bad"), F.col("title")).otherwise(F.col("summary")).alias("summary"),
        F.col("_x.title_head").alias("_th"),
        F.when(F.col("_bad"), F.col("_x.title_head")).otherwise(F.col("_x.summary_head")).alias("_sh"),
        F.when(F.col("_bad"), F.col("_x.twice_head")).otherwise(F.col("_x.both_head")).alias("_bh"),
    )
    keep = [c for c in chosen.columns if c not in ("_th", "_sh", "_bh")]
    worded = chosen.select(
        *keep,
        X.headline_words_of_text(F.coalesce("_th", X.tidy(F.col("title"), 500))).alias("_tw"),
        X.headline_words_of_text(F.coalesce("_sh", X.tidy(F.col("summary"), 500))).alias("_dw"),
        X.headline_words_of_text(F.coalesce("_bh", X.tidy(both, 500))).alias("_bw"),
    )
    tokens = worded.select(
        *keep,
        X.token_set(F.col("_tw")).alias("title_tokens"),
        X.token_set(F.col("_dw")).alias("description_tokens"),
        X.extract_numbers(F.col("_bw")).alias("numbers"),
    )
    ranked = tokens.withColumn(
        "keywords", X.extract_keywords(F.col("title_tokens"), F.col("description_tokens"))
    )
    return ranked.select(
        "*",
        F.array_join("title_tokens", " ").alias("normalized_title"),
        X.extract_entities(F.col("title"), F.col("summary")).alias("entities"),
        X.event_terms(F.col("title_tokens")).alias("event_terms"),
        normalize_url(F.coalesce("url", F.lit(""))).alias("canonical_url"),
        X.fingerprint(F.col("publisher"), F.col("title_tokens"), F.col("keywords")).alias(
            "fingerprint"
        ),
    )
