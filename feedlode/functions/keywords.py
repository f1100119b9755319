"""Keyword matching as Column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedlode.functions.text import UNICODE_SPACE, text_or_empty


def usable_keywords(keywords: Sequence[str]) -> list[str]:
    """Trimmed, without blanks, each spelling once, in the order given."""
    trimmed = (k.strip(UNICODE_SPACE) for k in keywords)
    return list(dict.fromkeys(k for k in trimmed if k))


def keyword_hits(cols: Sequence[Column], keywords: Sequence[str]) -> Column:
    """The keywords found, upper or lower case, in the columns joined by a space."""
    text = F.lower(F.concat_ws(" ", *[text_or_empty(c) for c in cols]))
    none = F.array().cast("array<string>")
    words = usable_keywords(keywords)
    if not words:
        return none
    # One array per keyword, concatenated: unlike an array filter this stays in generated code.
    return F.concat(
        *[F.when(text.contains(w.lower()), F.array(F.lit(w))).otherwise(none) for w in words]
    )
