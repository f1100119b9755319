"""SentencePiece encoding and decoding by a table of prefixes.

For a merge-type (BPE) vocabulary every prefix of a string has exactly one last token. An
automaton over the vocabulary gives the tokens that end at each place; the one that can follow
the last token of the prefix before it is kept. Going back from the end by token lengths gives
the ids. Two tokens can stand side by side if undoing their merges, latest first, never shows
a merge across their border that would have been made earlier.

No piece holds the space mark after another character, and in most models none mixes letters
with signs, so no merge crosses such a border: a text falls into stretches, and equal
stretches are worked out once per task.
"""

from __future__ import annotations

import re
import struct
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlode.llm.common import small_batches, table, without

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
BPE = 2
#: Remembered stretches and pairs of a task; a full memory is emptied. Longer
#: stretches are worked out anew.
REMEMBER = 400_000
LONG = 48

#: Stretches that no merge leaves: spaces before Latin letters, or before others. The coarse rule
#: (spaces and all up to the next space) is for models with pieces of letters and signs.
LATIN = "A-Za-zÀ-ÖØ-öø-ʯ"
FINE = re.compile(f"{SPACE}*[{LATIN}]+|{SPACE}*[^{LATIN}{SPACE}]+|{SPACE}+")
COARSE = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


@dataclass
class PieceModel:
    """What the tables are built from; its size is that of the vocabulary."""

    pieces: list[str]
    scores: list[float]
    kinds: list[int]


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The fields of a protocol-buffer message."""
    i = 0

    def varint() -> int:
        nonlocal i
        value = shift = 0
        while True:
            byte = data[i]
            i += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while i < len(data):
        key = varint()
        number, wire = key >> 3, key & 7
        if wire == 0:
            yield number, varint()
            continue
        size = {1: 8, 5: 4}.get(wire) or varint()
        yield number, data[i:i + size]
        i += size


def load_model(path: str) -> PieceModel:
    """Read a model file on the driver. Only what the tables can serve is taken: merge type,
    texts taken as they are, one space put before a text."""
    with open(path, "rb") as file:
        message = list(_fields(file.read()))
    pieces, scores, kinds = [], [], []
    for number, data in message:
        if number == 1:
            piece = dict(_fields(data))
            pieces.append(piece[1].decode())
            scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
            kinds.append(piece.get(3, NORMAL))
    trainer = dict(_fields(next((d for n, d in message if n == 2), b"")))
    normaliser = dict(_fields(next((d for n, d in message if n == 3), b"")))
    plain = not normaliser.get(2) and normaliser.get(3, 1) == 1 and normaliser.get(4, 1) == 0
    if trainer.get(3, 1) != BPE or not plain or trainer.get(24, 0):
        raise ValueError(f"{path}: not a merge-type model over unchanged texts")
    if {USER_DEFINED, UNUSED} & set(kinds) or kinds.count(BYTE) != 256:
        raise ValueError(f"{path}: needs plain pieces and all 256 byte pieces")
    normal = [p for p, kind in zip(pieces, kinds, strict=True) if kind == NORMAL]
    singles = {p for p in normal if len(p) == 1}
    if any(set(p) - singles or SPACE in p.lstrip(SPACE) for p in normal):
        raise ValueError(f"{path}: a piece goes beyond a word, or has a character of its own")
    return PieceModel(pieces, scores, kinds)


class Remembered(dict):
    """Results for stretches, worked out when first asked for; long ones are not kept."""

    def __init__(self, work: Callable[[str], bytes | str]) -> None:
        self.work = work

    def __missing__(self, stretch: str) -> bytes | str:
        found = self.work(stretch)
        if len(stretch) <= LONG:
            if len(self) >= REMEMBER:
                self.clear()
            self[stretch] = found
        return found


class PieceTables:
    """Encoder and decoder; built in the task from the model."""

    def __init__(self, model: PieceModel) -> None:
        import ahocorasick

        self.pieces, self.kinds = model.pieces, model.kinds
        self.ids = {p: i for i, p in enumerate(model.pieces) if model.kinds[i] == NORMAL}
        #: Ids that are not simply their piece's text.
        self.loose = frozenset(i for i, kind in enumerate(model.kinds) if kind != NORMAL)
        self.bytes = [0] * 256
        for i, piece in enumerate(model.pieces):
            if model.kinds[i] == BYTE:
                self.bytes[int(piece[3:5], 16)] = i
        merged = sorted((i for p, i in self.ids.items() if len(p) > 1),
                        key=lambda i: (-model.scores[i], i))
        #: When a token is made; single characters are there before all merges.
        self.rank = dict.fromkeys(self.ids.values(), -1)
        self.rank.update({i: n for n, i in enumerate(merged)})
        self.halves: dict[int, tuple[int, int]] = {}
        reachable = [i for p, i in self.ids.items() if len(p) == 1]
        for i in merged:
            # A token's last merge: of two tokens that can stand side by side before it is made.
            halves = self._last_merge(i)
            if halves:
                self.halves[i] = halves
                reachable.append(i)
        self.automaton = ahocorasick.Automaton()
        for i in reachable:
            self.automaton.add_word(self.pieces[i], i)
        self.automaton.make_automaton()
        self.sizes = [len(p) for p in self.pieces]
        self.singles = frozenset(p for p in self.ids if len(p) == 1)
        whole = all(len(FINE.findall(p)) == 1 for p in self.ids)
        self.stretches = (FINE if whole else COARSE).findall
        self.fits: dict[int, bool] = {}
        self.known_ids = Remembered(lambda s: array("i", self._stretch(s)).tobytes())
        self.known_text = Remembered(
            lambda s: self.decode_ids(np.frombuffer(self.known_ids[s], np.int32).tolist()))

    def _last_merge(self, token: int) -> tuple[int, int] | None:
        piece, rank = self.pieces[token], self.rank
        for cut in range(1, len(piece)):
            left, right = self.ids.get(piece[:cut]), self.ids.get(piece[cut:])
            if left is None or right is None or max(rank[left], rank[right]) >= rank[token]:
                continue
            if all(len(self.pieces[t]) == 1 or t in self.halves for t in (left, right)) \
                    and self._apart(left, right, rank[token]):
                return left, right
        return None

    def _apart(self, left: int, right: int, until: float = float("inf")) -> bool:
        """Whether merging keeps these two tokens apart until the given time.

        Undoes the later of the two tokens' own merges again and again. A merge across the
        border that comes before the merge last undone would have been made instead; of equal
        ones the one further left is made first.
        """
        pieces, ids, rank, halves = self.pieces, self.ids, self.rank, self.halves
        limit, strict = until, True
        while True:
            across = ids.get(pieces[left] + pieces[right])
            if across is not None and (rank[across] < limit or not strict and rank[across] == limit):
                return False
            if left not in halves and right not in halves:
                return True
            if right not in halves or left in halves and rank[left] > rank[right]:
                # The left token's merge lies left of the border: it wins a tie.
                limit, strict = rank[left], True
                left = halves[left][1]
            else:
                limit, strict = rank[right], False
                right = halves[right][0]

    def can_follow(self, left: int, right: int) -> bool:
        pair = left << 24 | right
        fits = self.fits.get(pair)
        if fits is None:
            if len(self.fits) >= REMEMBER:
                self.fits.clear()
            fits = self.fits[pair] = self._apart(left, right)
        return fits

    def _last_tokens(self, run: str) -> list[int]:
        """Ids of characters that are all in the vocabulary."""
        fits, sizes, n = self.fits, self.sizes, len(run)
        last = [-1] * (n + 1)
        for end, token in self.automaton.iter(run):
            end += 1
            if last[end] < 0:
                left = last[end - sizes[token]]
                if left >= 0:
                    ok = fits.get(left << 24 | token)
                    if self.can_follow(left, token) if ok is None else ok:
                        last[end] = token
                elif end == sizes[token]:
                    last[end] = token
        out, end = [], n
        while end:
            out.append(last[end])
            end -= sizes[last[end]]
        out.reverse()
        return out

    def _stretch(self, stretch: str) -> list[int]:
        if self.singles.issuperset(stretch):
            return self._last_tokens(stretch)
        ids: list[int] = []
        run = 0
        for i, char in enumerate(stretch):
            if char not in self.singles:
                if run < i:
                    ids += self._last_tokens(stretch[run:i])
                ids += [self.bytes[b] for b in char.encode()]
                run = i + 1
        return ids + self._last_tokens(stretch[run:]) if run < len(stretch) else ids

    def decode_ids(self, ids: list[int]) -> str:
        """The text of ids, without taking off the space put before it; bytes that are no
        character become U+FFFD each."""
        if not self.loose.intersection(ids):
            return "".join([self.pieces[i] for i in ids]).replace(SPACE, " ")
        out, loose = [], bytearray()

        def flush() -> None:
            i = 0
            while i < len(loose):
                for size in (1, 2, 3, 4):
                    try:
                        out.append(loose[i:i + size].decode())
                    except UnicodeDecodeError:
                        continue
                    i += size
                    break
                else:
                    out.append("�")
                    i += 1
            loose.clear()

        for i in ids:
            if self.kinds[i] == BYTE:
                loose.append(int(self.pieces[i][3:5], 16))
                continue
            flush()
            if self.kinds[i] == NORMAL:
                out.append(self.pieces[i])
            elif self.kinds[i] == UNKNOWN:
                out.append(" ⁇ ")
        flush()
        return "".join(out).replace(SPACE, " ")

    def encode(self, text: str) -> tuple[bytes, str]:
        """The ids as 32-bit integers, and the text that they decode to."""
        if not text:
            return b"", ""
        found = self.stretches(SPACE + text.replace(" ", SPACE))
        ids = b"".join(map(self.known_ids.__getitem__, found))
        return ids, "".join(map(self.known_text.__getitem__, found))[1:]


def encode_decode(docs: DataFrame, path: str, text: str = "text",
                  ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """All columns of the rows, the ids of the text and the text that the ids decode to.

    A null or empty text has no ids and decodes to the empty text; rows are taken one by one,
    so repeated rows and keys give repeated results. Columns that bear the result's names are
    replaced. Very long texts take memory in proportion to the text itself.
    """
    model = docs.sparkSession.sparkContext.broadcast(load_model(path))
    small_batches(docs.sparkSession)
    docs = without(docs, *({ids, decoded} - {text}))
    extra = [F.lit(None).cast(kind).alias(name) for name, kind in ((ids, "array<int>"), (decoded, "string"))]
    schema = docs.select("*", *extra).schema
    place = docs.columns.index(text)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = PieceTables(model.value)
        for batch in batches:
            counts, flat, texts = [0], [], []
            for value in batch.column(place).to_pylist():
                found, back = tables.encode(value or "")
                counts.append(counts[-1] + len(found) // 4)
                flat.append(found)
                texts.append(back)
            values = pa.array(np.frombuffer(b"".join(flat), np.int32))
            lists = pa.ListArray.from_arrays(pa.array(counts, pa.int32()), values)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, lists, pa.array(texts, pa.string())],
                [*batch.schema.names, ids, decoded],
            )

    return docs.mapInArrow(work, schema)


def digests(docs: DataFrame, path: str) -> DataFrame:
    """Number of ids and digests of the ids and of the decoded text, per document."""
    found = encode_decode(docs.select("doc_id", "text"), path)
    return found.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def model_path() -> str:
    """The public vocabulary that the registered query takes."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op2_sentencepiece(spark, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), model_path())
