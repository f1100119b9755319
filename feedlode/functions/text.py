"""Text cleaning as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedlode.functions.fixed_values import SENTENCE_BYTES, SENTENCE_MARKS

# \s of the Java engine also takes vertical tab, so the class is written out.
BLANKS = "[\\t\\n\\f\\r ]+"
# A run that is not just one space: most gaps between words need no replacement.
LOOSE_BLANKS = "[\\t\\n\\f\\r][\\t\\n\\f\\r ]*| [\\t\\n\\f\\r ]+"
TAG = "<[^>]+>"
NON_WORD = "[^\\p{L}\\p{N}\\t\\n\\f\\r ]+"

# Every character with the Unicode White_Space property.
UNICODE_SPACE = (
    "\t\n\x0b\f\r \x85\xa0\u1680"
    + "".join(chr(code) for code in range(0x2000, 0x200B))
    + "\u2028\u2029\u202f\u205f\u3000"
)


def text_or_empty(col: Column | str) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def trim_unicode(col: Column) -> Column:
    """Trim all Unicode white space; plain ``trim`` only takes the ASCII space."""
    return F.btrim(col, F.lit(UNICODE_SPACE))


def clean(col: Column) -> Column:
    """Tags become a space, runs of blanks one space, ends trimmed."""
    spaced = F.regexp_replace(F.regexp_replace(col, TAG, " "), LOOSE_BLANKS, " ")
    return trim_unicode(spaced)


def default_text(col: Column, fallback: str) -> Column:
    """``fallback`` where the text is NULL or blank, else the text as it is."""
    text = text_or_empty(col)
    return F.when(trim_unicode(text) == "", F.lit(fallback)).otherwise(text)


def contains_any(col: Column, words: list[str]) -> Column:
    hit = F.lit(False)
    for word in words:
        hit = hit | col.contains(word)
    return hit


def byte_prefix(col: Column, size: int) -> Column:
    """The longest prefix of whole characters that takes at most ``size`` bytes."""
    # A UTF-8 character takes up to 4 bytes, so at most ``size`` characters matter.
    head = F.substring(col, 1, size)
    kept = F.lit("")
    for width in range(size, size - 4, -1):
        piece = F.substring(F.encode(head, "UTF-8"), 1, width)
        # A cut inside a character shows as invalid bytes.
        valid = F.is_valid_utf8(piece.cast("string"))
        kept = F.when((kept == "") & valid, piece.cast("string")).otherwise(kept)
    return kept


def first_sentence(cleaned: Column) -> Column:
    """First sentence of a cleaned text; the mark at its end is kept whole.

    Without a mark, or with one in first place, the text itself, shortened to
    140 bytes of whole characters and three dots.
    """
    marks = "[" + SENTENCE_MARKS + "]"
    sentence = F.regexp_extract(cleaned, "(?s)\\A([^" + SENTENCE_MARKS + "]+" + marks + ")", 1)
    short = F.concat(trim_unicode(byte_prefix(cleaned, SENTENCE_BYTES)), F.lit("..."))
    return (
        F.when(sentence != "", trim_unicode(sentence))
        .when(F.octet_length(cleaned) > SENTENCE_BYTES, short)
        .otherwise(cleaned)
    )
