"""Rows that every operator has to take: nulls, empty and long texts, ties, repeats, odd names."""

from __future__ import annotations

import re
from pathlib import Path

import duckdb

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"

LONG = " ".join(f"wort{i % 977} é{i}" for i in range(30_000))

TEXTS = [
    None, "", " ", "\n\n", "one", "one two three four", "Plain words. And more words.\nA line.",
    "MIT under the MIT License, under the mit license!", "Ünder thé MIT License", LONG,
    "a\x00b\tc\x0bd", "😀 emoji ﬁ ‍ x", "same text here " * 30, "same text here " * 30,
]


def odd_docs(spark):
    """Documents with all of that, and columns whose names operators might use themselves."""
    rows = [(i if i != 4 else None, text, "x", i, 1.5, "kept") for i, text in enumerate(TEXTS)]
    rows.append(rows[6])
    rows.append(rows[12])
    schema = "doc_id long, text string, key_a string, KEY_B int, place double, lines string"
    return spark.createDataFrame(rows, schema)


def no_docs(spark):
    return odd_docs(spark).where("false")


def small_rows(name: str, sf_dir: str = SMALL) -> list[tuple]:
    return duckdb.sql(f"SELECT * FROM '{Path(sf_dir) / name}.parquet'").fetchall()


def lowered(text: str | None) -> str:
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def words_of(text: str | None) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))


def blank_words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")
