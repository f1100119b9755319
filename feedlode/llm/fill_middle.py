"""Fill-in-the-middle: a text is cut in three at token borders and put together anew, so that a
model learns to write the middle from what stands around it.

Cuts are kept in code points, texts lie in memory as UTF-8 bytes. A sparse index of exceptions
joins the two: it records only the characters of several bytes, with their place and the bytes
that they have in excess of one. Both ways are one binary search in it; a span of ASCII has no
entry and is plain arithmetic.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedlode.llm.common import fresh_name, small_batches, table, without
from feedlode.llm.words import text_bytes

#: Marks of the three parts.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of a hundred texts so many stay plain, and of a hundred others so many have the suffix first.
PLAIN_SHARE, SPM_SHARE = 10, 20
#: Put before the id whose digest draws the cuts and the form.
SALT = "1:"
RESULTS = ["n", "form", "prefix_chars", "middle_chars", "output"]


class ExceptionIndex:
    """Between places in bytes and in code points of texts that lie one behind the other."""

    def __init__(self, raw: np.ndarray) -> None:
        leads = np.flatnonzero(raw >= 0xC0)
        kind = raw[leads]
        excess = 1 + (kind >= 0xE0).astype(np.int64) + (kind >= 0xF0)
        self.byte_at = leads
        #: Bytes in excess up to each exception, and up to the end.
        self.before = np.concatenate([np.zeros(1, np.int64), np.cumsum(excess)])
        self.point_at = leads - self.before[:-1]

    def points(self, places: np.ndarray) -> np.ndarray:
        """Code points before these byte places, each of them the begin of a character or the end."""
        return places - self.before[np.searchsorted(self.byte_at, places)]

    def bytes(self, places: np.ndarray) -> np.ndarray:
        """Bytes before these places in code points."""
        return places + self.before[np.searchsorted(self.point_at, places)]


_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


def token_starts(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The bytes at which tokens begin: runs of A-Z and a-z, and every other character alone."""
    letter = _LETTER[raw]
    inside = np.zeros(len(raw) + 1, bool)
    inside[1:-1] = letter[1:] & letter[:-1]
    inside[at] = False
    return np.flatnonzero(~inside[:-1] & ((raw & 0xC0) != 0x80))


def draws(key: Column, salt: str = SALT) -> list[Column]:
    """Four numbers of 32 bits that depend on the id alone; a null id counts as empty text."""
    digest = F.sha2(F.concat(F.lit(salt), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def form_of(text: Column, third: Column, fourth: Column) -> Column:
    """plain, spm (suffix first) or psm."""
    marked = F.contains(text, F.lit(PREFIX)) | F.contains(text, F.lit(SUFFIX)) | F.contains(text, F.lit(MIDDLE))
    plain = (text == "") | marked | (third % 100 >= 100 - PLAIN_SHARE)
    return F.when(plain, "plain").when(fourth % 100 < SPM_SHARE, "spm").otherwise("psm")


def _rearranged(raw: bytes, form: str, ends: tuple[int, int, int, int]) -> bytes:
    first, low, high, last = ends
    parts = {PREFIX: raw[first:low], MIDDLE: raw[low:high], SUFFIX: raw[high:last]}
    order = {"psm": (PREFIX, SUFFIX, MIDDLE), "spm": (SUFFIX, PREFIX, MIDDLE)}[form]
    return b"".join(mark.encode() + parts[mark] for mark in order)


def fill_in_middle(docs: DataFrame, text: str = "text", key: str = "doc_id", salt: str = SALT) -> DataFrame:
    """All columns of the rows, and n (tokens), form, prefix_chars, middle_chars, output.

    A null text counts as empty; an empty text, and one that holds a mark, is plain: its output
    is the text and its counts of characters are null. A null id draws as an empty one. Rows are
    taken one by one, so repeated rows and keys give repeated results. Columns that bear the
    results' names are replaced, unless they are the text or the key. A very long text takes
    memory in proportion to itself.
    """
    small_batches(docs.sparkSession)
    results = dict(zip(RESULTS, ["long", "string", "long", "long", "string"], strict=True))
    clash = {text.lower(), key.lower()} & set(results)
    if clash:
        raise ValueError(f"results would replace {sorted(clash)}")
    docs = without(docs, *results)
    whole, form, one, two = (fresh_name(n, docs.columns) for n in ("whole", "drawn_form", "draw_one", "draw_two"))
    h1, h2, h3, h4 = draws(F.col(f"`{key}`"), salt)
    kept = [F.col(f"`{c}`") for c in docs.columns]
    read = docs.select(*kept, F.coalesce(F.col(f"`{text}`"), F.lit("")).alias(whole),
                       h1.alias(one), h2.alias(two), h3.alias("h3"), h4.alias("h4"))
    read = read.select(*kept, whole, one, two, form_of(F.col(f"`{whole}`"), F.col("h3"), F.col("h4")).alias(form))
    width = len(kept)
    schema = docs.select("*", *[F.lit(None).cast(kind).alias(name) for name, kind in results.items()]).schema

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = text_bytes(batch.column(width))
            first, second = (batch.column(width + i).to_numpy(zero_copy_only=False) for i in (1, 2))
            forms = batch.column(width + 3).to_pylist()
            starts = token_starts(raw, at)
            before = np.searchsorted(starts, at)
            n = np.diff(before)
            borders = np.append(starts, len(raw))
            units = np.sort(np.stack([first % (n + 1), second % (n + 1)]), axis=0)
            index = ExceptionIndex(raw)
            begin = index.points(at[:-1])
            # Where a text's tokens are used up, the next text's first begins at its end.
            low, high = (index.points(borders[before[:-1] + u]) for u in units)
            ends = np.stack([at[:-1], index.bytes(low), index.bytes(high), at[1:]], axis=1).tolist()
            data, outputs = raw.tobytes(), []
            for own, spans in zip(forms, ends, strict=True):
                outputs.append(data[spans[0]:spans[3]] if own == "plain" else _rearranged(data, own, spans))
            plain = np.array([own == "plain" for own in forms], bool)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:width], pa.array(n, pa.int64()), pa.array(forms, pa.string()),
                 pa.array(low - begin, pa.int64(), mask=plain), pa.array(high - low, pa.int64(), mask=plain),
                 pa.array(outputs, pa.binary()).cast(pa.string())],
                [*batch.schema.names[:width], *RESULTS],
            )

    return read.mapInArrow(work, schema)


def restore(output: Column, form: Column) -> Column:
    """The text that an output was made from. A text with marks in it is plain, so the three
    marks are the only ones, and none can arise where a mark meets a part of the text."""
    parts = F.split(output, "<[PSM]>", -1)
    part = lambda i: F.get(parts, F.lit(i))
    return (F.when(form == "psm", F.concat(part(1), part(3), part(2)))
            .when(form == "spm", F.concat(part(2), part(3), part(1)))
            .otherwise(output))


def op11_fill_middle(spark, sf_dir: str) -> DataFrame:
    made = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(restore(F.col("output"), F.col("form")).cast("binary"), 256).alias("restored_sha256"),
    )


#: The same in DuckDB: lists of tokens, cut and joined.
OP11_SQL = f"""
WITH d AS (
    SELECT doc_id, coalesce(text, '') AS text, sha256('{SALT}' || coalesce(doc_id::VARCHAR, '')) AS h,
           regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS tokens
    FROM documents),
e AS (
    SELECT doc_id, text, tokens, len(tokens) AS n,
           ('0x' || substr(h, 1, 8))::UBIGINT % (len(tokens) + 1)::UBIGINT AS a,
           ('0x' || substr(h, 9, 8))::UBIGINT % (len(tokens) + 1)::UBIGINT AS b,
           CASE WHEN text = '' OR contains(text, '{PREFIX}') OR contains(text, '{SUFFIX}') OR contains(text, '{MIDDLE}')
                     OR ('0x' || substr(h, 17, 8))::UBIGINT % 100 >= {100 - PLAIN_SHARE} THEN 'plain'
                WHEN ('0x' || substr(h, 25, 8))::UBIGINT % 100 < {SPM_SHARE} THEN 'spm' ELSE 'psm' END AS form
    FROM d),
f AS (
    SELECT doc_id, text, n, form,
           array_to_string(list_slice(tokens, 1, least(a, b)::BIGINT), '') AS p,
           array_to_string(list_slice(tokens, least(a, b)::BIGINT + 1, greatest(a, b)::BIGINT), '') AS m,
           array_to_string(list_slice(tokens, greatest(a, b)::BIGINT + 1, n), '') AS s
    FROM e)
SELECT doc_id, n::BIGINT AS n, form,
       CASE WHEN form <> 'plain' THEN length(p)::BIGINT END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(m)::BIGINT END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text
                        WHEN 'psm' THEN '{PREFIX}' || p || '{SUFFIX}' || s || '{MIDDLE}' || m
                        ELSE '{SUFFIX}' || s || '{PREFIX}' || p || '{MIDDLE}' || m END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM f
"""
