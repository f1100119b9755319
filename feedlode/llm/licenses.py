"""License scan: ordered signature rules over the words of a text.

A rule is a regular expression over the text's words, lower-cased and joined by single spaces.
It is tried only on texts that hold all its keywords, and has a priority. Detections are taken
by priority, then length, then place; one that lies within a kept one is suppressed.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlode.llm.common import small_batches, table
from feedlode.llm.words import NOT_ALNUM

#: The phrases that count as base detections, and their labels.
BASE_PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

#: label: names as patterns over words, versions (pattern: suffix of the label), short names.
FAMILIES: dict[str, tuple[list[str], dict[str, str], list[str]]] = {
    "mit": (["mit", "expat"], {}, ["mit"]),
    "apache": (["apache(?: software)?"], {"2(?: 0)?": "2", "1 1": "1.1", "1 0": "1"}, ["apache"]),
    "gpl": (["gnu general public", "gpl"], {"3(?: 0)?": "3", "2(?: 0)?": "2", "1(?: 0)?": "1"}, ["gpl", "gnu gpl"]),
    "lgpl": (["gnu lesser general public", "gnu library general public", "lgpl"],
             {"3(?: 0)?": "3", "2 1": "2.1", "2(?: 0)?": "2"}, ["lgpl", "gnu lgpl"]),
    "agpl": (["gnu affero general public", "affero general public", "agpl"],
             {"3(?: 0)?": "3", "1(?: 0)?": "1"}, ["agpl", "gnu agpl"]),
    "gfdl": (["gnu free documentation", "gfdl"], {"1 3": "1.3", "1 2": "1.2", "1 1": "1.1"}, ["gfdl"]),
    "mpl": (["mozilla public", "mpl"], {"2(?: 0)?": "2", "1 1": "1.1", "1 0": "1"}, ["mpl"]),
    "epl": (["eclipse public", "epl"], {"2(?: 0)?": "2", "1(?: 0)?": "1"}, ["epl"]),
    "cddl": (["common development and distribution", "cddl"], {"1 1": "1.1", "1 0": "1"}, ["cddl"]),
    "eupl": (["european union public", "eupl"], {"1 2": "1.2", "1 1": "1.1"}, ["eupl"]),
    "osl": (["open software", "osl"], {"3(?: 0)?": "3", "2 1": "2.1"}, ["osl"]),
    "afl": (["academic free", "afl"], {"3(?: 0)?": "3", "2 1": "2.1"}, ["afl"]),
    "artistic": (["artistic"], {"2(?: 0)?": "2", "1(?: 0)?": "1"}, ["artistic"]),
    "boost": (["boost software", "bsl"], {"1(?: 0)?": "1"}, ["bsl"]),
    "zlib": (["zlib", "zlib libpng"], {}, ["zlib"]),
    "isc": (["isc", "internet systems consortium"], {}, ["isc"]),
    "bsd-2": (["(?:simplified|freebsd) bsd", "bsd 2 clause", "2 clause bsd", "two clause bsd"], {}, ["bsd 2 clause"]),
    "bsd-3": (["(?:new|modified|revised) bsd", "bsd 3 clause", "3 clause bsd", "three clause bsd"], {}, ["bsd 3 clause"]),
    "bsd-4": (["(?:original|old) bsd", "bsd 4 clause", "4 clause bsd"], {}, ["bsd 4 clause"]),
    "bsd": (["bsd", "bsd style"], {}, ["bsd"]),
    "unlicense": (["the unlicense", "unlicense"], {}, ["unlicense"]),
    "wtfpl": (["do what the fuck you want to public", "wtfpl"], {"2(?: 0)?": "2"}, ["wtfpl"]),
    "cc0": (["cc0", "creative commons (?:zero|0|cc0)"], {"1 0": "1"}, ["cc0"]),
    "cc-by-nc-nd": (["cc by nc nd", "creative commons attribution non ?commercial no ?deriv(?:s|atives|ative works)"],
                    {"4 0": "4", "3 0": "3", "2 5": "2.5", "2 0": "2"}, ["cc by nc nd"]),
    "cc-by-nc-sa": (["cc by nc sa", "creative commons attribution non ?commercial share ?alike"],
                    {"4 0": "4", "3 0": "3", "2 5": "2.5", "2 0": "2"}, ["cc by nc sa"]),
    "cc-by-nc": (["cc by nc", "creative commons attribution non ?commercial"],
                 {"4 0": "4", "3 0": "3", "2 5": "2.5", "2 0": "2"}, ["cc by nc"]),
    "cc-by-nd": (["cc by nd", "creative commons attribution no ?deriv(?:s|atives)"],
                 {"4 0": "4", "3 0": "3", "2 5": "2.5", "2 0": "2"}, ["cc by nd"]),
    "cc-by-sa": (["cc by sa", "creative commons attribution share ?alike"],
                 {"4 0": "4", "3 0": "3", "2 5": "2.5", "2 0": "2"}, ["cc by sa"]),
    "cc-by": (["cc by", "creative commons attribution"],
              {"4 0": "4", "3 0": "3", "2 5": "2.5", "2 0": "2"}, ["cc by"]),
    "odbl": (["open database", "odbl"], {"1 0": "1"}, ["odbl"]),
    "odc-by": (["open data commons attribution", "odc by"], {"1 0": "1"}, ["odc by"]),
    "pddl": (["public domain dedication and", "pddl"], {"1 0": "1"}, ["pddl"]),
    "ofl": (["sil open font", "open font", "ofl"], {"1 1": "1.1", "1 0": "1"}, ["ofl"]),
    "psf": (["python software foundation", "psf"], {"2(?: 0)?": "2"}, ["psf"]),
    "php": (["php"], {"3 01": "3.01", "3 0": "3"}, ["php"]),
    "ruby": (["ruby"], {}, ["ruby"]),
    "postgresql": (["postgresql"], {}, ["postgresql"]),
    "ms-pl": (["microsoft public", "ms pl"], {}, ["ms pl"]),
    "ms-rl": (["microsoft reciprocal", "ms rl"], {}, ["ms rl"]),
    "ecl": (["educational community"], {"2(?: 0)?": "2", "1 0": "1"}, ["ecl"]),
    "upl": (["universal permissive"], {"1 0": "1"}, ["upl"]),
    "ncsa": (["university of illinois ncsa open source", "ncsa"], {}, ["ncsa"]),
    "openrail": (["(?:big ?science )?open ?rail(?: m)?", "creativeml open ?rail m"], {}, ["openrail"]),
    "llama": (["llama [23](?: [0-9])? community"], {}, ["llama2"]),
    "busl": (["business source"], {"1 1": "1.1", "1 0": "1"}, ["busl"]),
    "elastic": (["elastic"], {"2(?: 0)?": "2"}, ["elastic"]),
    "sspl": (["server side public", "sspl"], {"1(?: 0)?": "1"}, ["sspl"]),
}

#: Sentences that stand in only one license or notice: (label, pattern).
CLAUSES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3", "neither the name of (?:the )?(?:[^ ]+ ){1,8}nor the names of its contributors may be used to endorse"),
    ("bsd-4", "all advertising materials mentioning features or use of this software must display"),
    ("apache-2", "unless required by applicable law or agreed to in writing software distributed under the license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license"),
    ("zlib", "altered source versions must be plainly marked as such and must not be misrepresented"),
    ("boost", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("wtfpl", "you just do what the fuck you want to"),
    ("cc0", "has waived all copyright and related or neighboring rights"),
    ("public-domain", "(?:released|placed|dedicated|is) (?:in|into|to) the public domain"),
    ("all-rights-reserved", "all rights reserved"),
    ("proprietary", "proprietary and confidential"),
    ("proprietary", "unauthorized copying of this file"),
    ("copyright", "copyright (?:c )?(?:19|20)[0-9]{2}"),
]


@dataclass(frozen=True)
class Rule:
    label: str
    pattern: str
    keywords: frozenset[str]
    priority: int
    confidence: float
    base: bool = False


def _plain_words(pattern: str) -> frozenset[str]:
    """Words that every match of the pattern holds: those outside groups, options and classes."""
    flat = pattern
    # A group that begins with a space leaves the word before it whole.
    while (less := re.sub(r"\((?:\?:)?( ?)[^()]*\)[?*+]?(?:\{[^}]*\})?|\[[^\]]*\][?*+]?", "\\1\0", flat)) != flat:
        flat = less
    flat = re.sub(r"[^ ]\?", "\0", re.sub(r" \?", "\0", flat))
    # What follows a group directly may be part of its last word.
    return frozenset(w for w in flat.split() if w.isalnum())


def build_rules() -> list[Rule]:
    """All rules in order, from the phrases, the families' name forms and the clauses."""
    rules = [Rule(label, phrase, _plain_words(phrase), 100, 1.0, True) for phrase, label in BASE_PHRASES.items()]

    def add(label: str, pattern: str, priority: int, confidence: float, gate: str = "") -> None:
        rules.append(Rule(label, pattern, _plain_words(gate or pattern), priority, confidence))

    licence = "licen[cs]es?"
    for label, (names, versions, short) in FAMILIES.items():
        for name in names:
            for version, suffix in versions.items():
                full = f"{label}-{suffix}"
                add(full, f"{name} {licence} (?:version|v) ?{version}", 80, 0.95)
                add(full, f"{name} {licence} {version}", 75, 0.9)
                add(full, f"{name} v?{version}(?: {licence}| international| unported)?", 60, 0.7)
            add(label, f"(?:licen[cs]ed|released|distributed|available|published|covered) (?:under|by) (?:the )?"
                       f"(?:terms of (?:the )?)?{name}(?: {licence})?", 70, 0.9, name)
            add(label, f"{name} {licence}", 50, 0.8)
        for word in short:
            add(label, f"spdx license identifier {word}(?: [0-9]+)*(?: (?:only|or later))?", 95, 1.0)
            add(label, f"opensource org licenses {word}(?: license)?(?: [0-9]+)*", 90, 0.95)
    for kind in ("by nc nd", "by nc sa", "by nc", "by nd", "by sa", "by"):
        add(f"cc-{kind.replace(' ', '-')}", f"creativecommons org licenses {kind}(?: [0-9] [0-9])?", 90, 0.95)
    add("cc0", "creativecommons org publicdomain zero(?: 1 0)?", 90, 0.95)
    for label, pattern in CLAUSES:
        sure = label not in ("all-rights-reserved", "copyright", "proprietary", "public-domain")
        add(label, pattern, 85 if sure else 20, 0.95 if sure else 0.4)
    add("other", f"(?:under|see) (?:the )?(?:terms of )?(?:the |this )?(?:accompanying )?{licence}", 10, 0.2)
    return rules


class Scanner:
    """Finds the rules' places in texts; built in the task."""

    def __init__(self, rules: list[Rule]) -> None:
        self.rules = rules
        flat = bytearray(range(256))
        for byte in range(65, 91):
            flat[byte] += 32
        for byte in NOT_ALNUM:
            flat[byte] = 32
        flat[65:91] = bytes(range(97, 123))
        self.flat = bytes(flat)
        self.patterns: dict[int, re.Pattern[bytes]] = {}
        # A text's words are looked up once; a rule waits under the longest of its keywords.
        self.waiting: dict[bytes, list[tuple[int, frozenset[bytes]]]] = defaultdict(list)
        self.always: list[int] = []
        for number, rule in enumerate(rules):
            keys = sorted((k.encode() for k in rule.keywords), key=lambda k: (-len(k), k))
            if keys:
                self.waiting[keys[0]].append((number, frozenset(keys[1:])))
            else:
                self.always.append(number)
        # Rules of options only: any of these words must be there.
        self.gates = frozenset([b"license", b"licenses", b"licence", b"licences", b"openrail", b"rail"])
        self.keys = frozenset(self.waiting) | self.gates

    def _found(self, number: int, joined: bytes) -> list[tuple[int, int]]:
        """First word and number of words of each place, overlapping ones of base phrases too."""
        rule = self.rules[number]
        pattern = self.patterns.get(number)
        if pattern is None:
            body = f" (?:{rule.pattern})(?= )"
            pattern = self.patterns[number] = re.compile((f"(?=({body}))" if rule.base else f"({body})").encode())
        out, word, at = [], 0, 0
        for match in pattern.finditer(joined):
            word += joined.count(b" ", at, match.start(1))
            at = match.start(1)
            out.append((word, match.group(1).count(b" ")))
        return out

    def scan(self, text: str) -> tuple[int, list[dict]]:
        """Number of words, and the detections by place."""
        words = text.encode().translate(self.flat).split(b" ") if text else []
        present = self.keys.intersection(words)
        if not present:
            return len(words) - words.count(b""), []
        words = [w for w in words if w]
        all_words = set(words)
        numbers = [n for key in present for n, rest in self.waiting.get(key, ()) if rest <= all_words]
        if self.gates & present:
            numbers += self.always
        if not numbers:
            return len(words), []
        joined = b" " + b" ".join(words) + b" "
        found = [(n, first, size) for n in sorted(numbers) for first, size in self._found(n, joined)]
        found.sort(key=lambda f: (-self.rules[f[0]].priority, -f[2], f[1], f[0]))
        # Kept places in order of their first word, without those within others, so that their ends
        # ascend, too: the last that begins before a place reaches furthest.
        firsts: list[int] = []
        ends: list[int] = []
        out = []
        for n, first, size in found:
            rule = self.rules[n]
            at, end = bisect_right(firsts, first), first + size
            inside = at > 0 and ends[at - 1] >= end
            if not inside:
                low = at - 1 if at and firsts[at - 1] == first else at
                high = bisect_right(ends, end, low)
                firsts[low:high], ends[low:high] = [first], [end]
            if rule.base or not inside:
                out.append({"label": rule.label, "rule": n, "first_word": first, "n_words": size,
                            "confidence": rule.confidence, "base": rule.base, "kept": not inside})
        out.sort(key=lambda d: (d["first_word"], -d["n_words"], d["rule"]))
        return len(words), out


DETECTION = pa.struct([
    ("label", pa.string()), ("rule", pa.int32()), ("first_word", pa.int64()), ("n_words", pa.int64()),
    ("confidence", pa.float64()), ("base", pa.bool_()), ("kept", pa.bool_()),
])


def scan(docs: DataFrame, rules: list[Rule] | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_words, detections) of every row.

    A detection has its label, rule, place in words, confidence, and whether it is a base
    phrase; base phrases are listed even where a stronger detection covers them (kept false).
    Null and empty texts have no words and no detections. Rows are scanned one by one, so
    repeated keys and rows give repeated results; other columns are left out.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rules = build_rules() if rules is None else rules
    kind = docs.schema[key].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        for batch in batches:
            found = [scanner.scan(value or "") for value in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([f[0] for f in found], pa.int64()),
                pa.array([f[1] for f in found], pa.list_(DETECTION)),
            ], [key, "n_words", "detections"])

    return docs.select(key, text).mapInArrow(
        work, f"`{key}` {kind}, n_words long, detections array<struct<label: string, rule: int, first_word: long, "
              "n_words: long, confidence: double, base: boolean, kept: boolean>>")


def op1_licenses(spark, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    base = F.filter("detections", lambda d: d["base"])
    names = lambda rows: F.array_join(F.array_sort(F.array_distinct(F.transform(rows, lambda d: d["label"]))), ",")
    # The chance that at least one detection is right.
    wrong = F.aggregate(F.filter("detections", lambda d: d["kept"]), F.lit(1.0),
                        lambda left, d: left * (1 - d["confidence"]))
    return found.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda d: d["first_word"])).alias("first_word"),
        F.array_max(F.transform(base, lambda d: d["first_word"])).alias("last_word"),
        names(base).alias("base_labels"), names(F.col("detections")).alias("labels"),
        (1 - wrong).alias("score"), "detections",
    )
