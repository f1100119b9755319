"""Projections and filters over posts and insights."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedlode.functions.ids import post_id
from feedlode.functions.keywords import keyword_hits
from feedlode.functions.text import clean
from feedlode.functions.timeparse import parse_time


def instant(value: datetime | Column) -> Column:
    """A point in time as a Column; a time without zone counts as UTC."""
    if isinstance(value, Column):
        return value
    if value.tzinfo is None:
        value = value.replace(tzinfo=timezone.utc)
    since_epoch = value - datetime(1970, 1, 1, tzinfo=timezone.utc)
    micros = (since_epoch.days * 86400 + since_epoch.seconds) * 10**6 + since_epoch.microseconds
    return F.timestamp_micros(F.lit(micros).cast("bigint"))


def keep_where(df: DataFrame, condition: Column) -> DataFrame:
    """A filter on columns that are costly to work out.

    A plain filter moves below the projection it reads from and repeats the projection's
    expressions there, once per mention; a row generator in between keeps them apart.
    """
    marked = df.select("*", F.explode_outer(F.when(condition, F.array(F.lit(True)))).alias("_keep"))
    return marked.filter(F.col("_keep").isNotNull()).drop("_keep")


def clean_text(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Strip tags and collapse blanks in the given columns."""
    return df.withColumns({c: clean(F.col(c)) for c in cols})


def parse_times(df: DataFrame, col: str, as_of: datetime | Column, out: str | None = None) -> DataFrame:
    """Read time stamps in any of the known layouts; ``as_of`` where none fits."""
    return df.withColumn(out or col, F.coalesce(parse_time(F.col(col)), instant(as_of)))


def assign_post_id(df: DataFrame, col: str = "id") -> DataFrame:
    """Fill in missing post ids from platform, channel, url and title."""
    parts = [F.col(c) for c in ("platform", "channel", "url", "title")]
    return df.withColumn(col, post_id(F.col(col), *parts))


def match_keywords(
    df: DataFrame,
    keywords: Sequence[str],
    cols: Sequence[str] = ("title", "content"),
    out: str = "matched_keywords",
) -> DataFrame:
    """Keep rows that mention a keyword and list those found; without keywords keep all."""
    matched = df.withColumn(out, keyword_hits([F.col(c) for c in cols], keywords))
    # A list of blanks only is still a list: it matches nothing.
    return keep_where(matched, F.size(out) > 0) if keywords else matched


def exclude_explicit(df: DataFrame, flag: str = "is_explicit_content") -> DataFrame:
    """Drop rows flagged explicit; a missing flag counts as not explicit."""
    return df.filter(~F.coalesce(F.col(flag), F.lit(False)))


def since(df: DataFrame, ts: str, hours: int, as_of: datetime | Column) -> DataFrame:
    """Rows from the last ``hours`` before ``as_of``, border included, later rows kept."""
    return df.filter(F.col(ts) >= instant(as_of) - F.make_dt_interval(F.lit(0), F.lit(hours)))


__all__ = [
    "assign_post_id", "clean_text", "exclude_explicit", "instant", "keep_where", "match_keywords",
    "parse_times", "since",
]


SHOWN_TEXTS = [
    "cluster_key", "cluster_label", "source_post_id", "title", "author", "raw_content",
    "core_pain_point", "current_workaround", "saas_feasibility", "analysis_model",
    "embedding_model",
]


def present_insights(df: DataFrame) -> DataFrame:
    """Fill missing values for display; the vector is left out. Columns that are not there are
    not made up."""
    present = {c: F.coalesce(F.col(c), F.lit("")) for c in SHOWN_TEXTS}
    present["commercial_potential"] = F.coalesce(F.col("commercial_potential"), F.lit(0))
    present["is_explicit_content"] = F.coalesce(F.col("is_explicit_content"), F.lit(False))
    present["matched_keywords"] = F.coalesce(
        F.col("matched_keywords"), F.array().cast("array<string>")
    )
    present["published_at"] = F.coalesce(F.col("published_at"), F.col("created_at"))
    return df.select(
        *[present[c].alias(c) if c in present else F.col(c) for c in df.columns if c != "embedding"]
    )
