"""De-duplication of repeated byte strings by a suffix sort that compares hashes.

Every string of LENGTH bytes that starts in two places is found, without a row for every place.
Of the short grams in a string the one of the smallest hash is its anchor: equal strings have
equal anchors at equal distances, and strings that start side by side mostly share theirs. A
segment is a run of starts with one anchor. Only anchors that occur twice are looked into, and
only their segments are shuffled: equal segments are one, and of the others the suffixes that
begin at equal distances from an anchor are sorted. The sort is a mergesort whose comparisons
find the common extension of two suffixes by binary search over polynomial hashes of prefixes;
neighbours that agree in LENGTH bytes by their hash are compared byte by byte.

An anchor with very many segments is dealt out by the bytes around it, and what even then is
too much for one task by digests of the strings themselves, so no task sees a whole hot group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlode.llm.common import fresh_name, row_key, small_batches, table, whole_text, without
from feedlode.llm.words import BASE, INVERSE, mixed, text_bytes
from feedlode.session import cut_lineage

#: Bytes of a repeated string, and of the grams that anchors are chosen from.
LENGTH, GRAM = 200, 48
#: Segments of one anchor that a task sorts; larger groups are dealt out, with the same result.
MOST_ROWS = 2_000
#: Starts that anchors are chosen for at once, and rows that are sorted at once at least.
STRETCH, SORTED_ROWS = 1 << 17, 4_000

SEGMENT = "anchor long, parts int, key_a long, key_b int, start long, n long, lead int, twice boolean, bytes binary"
FOUND = "key_a long, key_b int, start long, n long"


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


class PrefixHashes:
    """Hashes of any span of some bytes, from polynomial hashes of all prefixes."""

    def __init__(self, raw: np.ndarray, powers: np.ndarray | None = None) -> None:
        self.raw = raw
        self.powers = _powers(BASE, len(raw) + 1) if powers is None else powers
        self.sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * self.powers[:len(raw)], out=self.sums[1:])

    def equal(self, a: np.ndarray, b: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        """Whether the spans of that size from a and b on have equal hashes."""
        return ((self.sums[a + size] - self.sums[a]) * self.powers[b]
                == (self.sums[b + size] - self.sums[b]) * self.powers[a])

    def extension(self, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
        """In how many bytes, `most` at most, the suffixes from a and b on agree."""
        low, high = np.zeros(len(a), np.int64), np.full(len(a), most, np.int64)
        while (open_ := low < high).any():
            mid = (low + high + 1) >> 1
            same = self.equal(a, b, mid)
            low = np.where(open_ & same, mid, low)
            high = np.where(open_ & ~same, mid - 1, high)
        return low


class Anchors:
    """Chooses the anchor of every string of LENGTH bytes within a text."""

    def __init__(self) -> None:
        self.width = LENGTH - GRAM + 1
        self.powers = _powers(BASE, STRETCH + LENGTH + 1)
        self.inverses = _powers(INVERSE, STRETCH + LENGTH + 1)
        #: The low bits of a hash give way to the place, so that the first of equal ones is least.
        self.places = np.uint64((1 << (STRETCH + LENGTH).bit_length()) - 1)

    def runs(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
        """(anchor hash, place of the anchor, first start, number of starts, text) of each run."""
        ends = np.maximum(at[:-1], at[1:] - LENGTH + 1)
        inside = np.zeros(len(raw) + 1, np.int32)
        np.add.at(inside, at[:-1], 1)
        np.add.at(inside, ends, -1)
        inside = np.cumsum(inside[:-1]) > 0
        parts = [self._stretch(raw, inside, low) for low in range(0, len(raw) - LENGTH + 1, STRETCH)]
        if not parts:
            return tuple(np.empty(0, np.int64) for _ in range(5))
        anchors, places, starts, counts = (np.concatenate(p) for p in zip(*parts, strict=True))
        return anchors, places, starts, counts, np.searchsorted(at, starts, "right") - 1

    def _stretch(self, raw: np.ndarray, inside: np.ndarray, low: int) -> tuple[np.ndarray, ...]:
        high = min(low + STRETCH, len(raw) - LENGTH + 1)
        own = raw[low:high + LENGTH - 1]
        n = len(own) - GRAM + 1
        sums = PrefixHashes(own, self.powers).sums
        grams = mixed((sums[GRAM:] - sums[:-GRAM]) * self.inverses[:n])
        packed = (grams & ~self.places) | np.arange(n, dtype=np.uint64)
        # Least of every window: blocks of its width, from their begin and from their end on.
        blocks = np.full(-(-n // self.width) * self.width, np.iinfo(np.uint64).max, np.uint64)
        blocks[:n] = packed
        blocks = blocks.reshape(-1, self.width)
        onward = np.minimum.accumulate(blocks, axis=1).ravel()
        back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        starts = np.flatnonzero(inside[low:high])
        least = (np.minimum(back[starts], onward[starts + self.width - 1]) & self.places).astype(np.int64)
        first = np.ones(len(starts), bool)
        first[1:] = (least[1:] != least[:-1]) | (starts[1:] != starts[:-1] + 1)
        edges = np.flatnonzero(first)
        chosen = least[edges]
        return (grams[chosen].view(np.int64), chosen + low, starts[edges] + low,
                np.diff(np.append(edges, len(starts))))


def anchor_places(keyed: DataFrame) -> DataFrame:
    """(anchor, key_a, key_b, n): the anchors of each row of (key_a, key_b, text), once per row,
    with the number of their runs."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chooser = Anchors()
        for batch in batches:
            anchors, _, _, _, own = chooser.runs(*text_bytes(batch.column(2)))
            order = np.lexsort((anchors, own))
            anchors, own = anchors[order], own[order]
            first = np.ones(len(own), bool)
            first[1:] = (anchors[1:] != anchors[:-1]) | (own[1:] != own[:-1])
            edges = np.flatnonzero(first)
            rows = pa.array(own[edges])
            yield pa.RecordBatch.from_arrays(
                [pa.array(anchors[edges]), batch.column(0).take(rows), batch.column(1).take(rows),
                 pa.array(np.diff(np.append(edges, len(own))).astype(np.int32))],
                ["anchor", "key_a", "key_b", "n"])

    return keyed.mapInArrow(work, "anchor long, key_a long, key_b int, n int")


def suspects(keyed: DataFrame) -> DataFrame:
    """(key_a, key_b, suspects): of each row the anchors that occur more than once anywhere, each
    with the number of parts that its rows are dealt into."""
    places = anchor_places(keyed)
    again = places.groupBy("anchor").agg(F.sum("n").alias("n"), F.count("*").alias("rows")).where("n > 1")
    again = again.select("anchor", F.ceil(F.col("rows") / MOST_ROWS).cast("int").alias("parts"))
    return (places.select("anchor", "key_a", "key_b").join(again, "anchor")
            .groupBy("key_a", "key_b").agg(F.collect_set(F.struct("anchor", "parts")).alias("suspects")))


def segments(read: DataFrame) -> DataFrame:
    """The segments of suspect anchors of (key_a, key_b, text, suspects), as SEGMENT.

    A segment that stands in its text again comes once, marked `twice`; the starts of its other
    places come as runs without bytes, as no more needs to be known of them.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chooser = Anchors()
        for batch in batches:
            raw, at = text_bytes(batch.column(2))
            anchors, places, starts, counts, own = chooser.runs(raw, at)
            lists = batch.column(3)
            sizes = np.diff(lists.offsets.to_numpy())
            wanted, parts = (lists.flatten().field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            owner = np.repeat(np.arange(len(sizes)), sizes)
            # One number for text and anchor: at worst an anchor that is no suspect comes along.
            keys = _joined(wanted, owner)
            order = np.argsort(keys)
            keys, parts = keys[order], parts[order]
            mine = _joined(anchors, own)
            found = np.minimum(np.searchsorted(keys, mine), max(len(keys) - 1, 0))
            hit = np.flatnonzero(keys[found] == mine) if len(keys) else np.empty(0, np.int64)
            rows = _segment_rows(raw.tobytes(), at, hit, anchors, places, starts, counts, own, parts[found] if len(keys) else None)
            owners = pa.array(rows.pop("own"), pa.int64())
            columns = {"anchor": pa.int64(), "parts": pa.int32(), "key_a": None, "key_b": None, "start": pa.int64(),
                       "n": pa.int64(), "lead": pa.int32(), "twice": pa.bool_(), "bytes": pa.binary()}
            keys_of = {"key_a": batch.column(0).take(owners), "key_b": batch.column(1).take(owners)}
            yield pa.RecordBatch.from_arrays(
                [keys_of[c] if kind is None else pa.array(rows[c], kind) for c, kind in columns.items()], list(columns))

    return read.mapInArrow(work, SEGMENT)


def _joined(anchors: np.ndarray, owner: np.ndarray) -> np.ndarray:
    return mixed(anchors.view(np.uint64) + mixed(owner.astype(np.uint64)))


def _segment_rows(data, at, hit, anchors, places, starts, counts, own, parts) -> dict[str, list]:
    names = ("own", "anchor", "parts", "start", "n", "lead", "twice", "bytes")
    rows: dict[str, list] = {name: [] for name in names}
    if not len(hit):
        return rows
    columns = [x[hit].tolist() for x in (own, anchors, parts, starts, counts, places)]
    begins = at.tolist()
    seen: dict[tuple[int, int, bytes], int] = {}
    for text, anchor, part, start, n, place in zip(*columns, strict=True):
        piece = data[start:start + n - 1 + LENGTH]
        kept = seen.setdefault((text, place - start, piece), len(rows["own"]))
        again = kept < len(rows["own"])
        if again:
            rows["twice"][kept] = True
            # A run that goes on from the last one makes it longer.
            if rows["bytes"][-1] is None and rows["own"][-1] == text and rows["start"][-1] + rows["n"][-1] == start - begins[text]:
                rows["n"][-1] += n
                continue
        values = (text, anchor, part, start - begins[text], n, place - start, False, None if again else piece)
        for name, value in zip(names, values, strict=True):
            rows[name].append(value)
    return rows


def sorted_order(hashes: PrefixHashes, places: np.ndarray, group: np.ndarray) -> np.ndarray:
    """The order of suffixes by group, then by their first LENGTH bytes: a mergesort of all groups
    at once, with few comparisons, each of a logarithmic number of steps. `group` ascends."""
    first = np.ones(len(group), bool)
    first[1:] = group[1:] != group[:-1]
    begin = np.maximum.accumulate(np.where(first, np.arange(len(group)), 0))
    size = np.diff(np.append(np.flatnonzero(first), len(group)))
    end = begin + np.repeat(size, size)
    order = np.arange(len(group))
    rank = order - begin
    width, longest = 1, int(size.max(initial=0))
    while width < longest:
        half = rank // width
        pair = begin + half // 2 * 2 * width
        left = half % 2 == 0
        # The other half of the two that are merged.
        low = np.where(left, np.minimum(pair + width, end), pair)
        high = np.where(left, np.minimum(pair + 2 * width, end), pair + width)
        other, floor = low.copy(), low.copy()
        mine = places[order]
        while (todo := np.flatnonzero(other < high)).size:
            mid = (other[todo] + high[todo]) >> 1
            a, b = mine[todo], places[order[mid]]
            common = hashes.extension(a, b, LENGTH)
            at_end = common >= LENGTH
            step = np.where(at_end, 0, common)
            before = np.where(at_end, ~left[todo], hashes.raw[b + step] < hashes.raw[a + step])
            other[todo] = np.where(before, mid + 1, other[todo])
            high[todo] = np.where(before, high[todo], mid)
        new = pair + (rank - half * width) + (other - floor)
        merged = np.empty_like(order)
        merged[new] = order
        order = merged
        width *= 2
    return order


def _repeated(data: bytes, hashes: PrefixHashes, places: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Which of the strings, `group` ascending, equal another one of their group."""
    order = sorted_order(hashes, places, group)
    a, b = places[order[:-1]], places[order[1:]]
    same = np.flatnonzero((group[order[:-1]] == group[order[1:]]) & hashes.equal(a, b, LENGTH))
    out = np.zeros(len(places), bool)
    wrong = []
    for i, p, q in zip(same.tolist(), a[same].tolist(), b[same].tolist(), strict=True):
        if data[p:p + LENGTH] == data[q:q + LENGTH]:
            out[order[i]] = out[order[i + 1]] = True
        else:
            wrong.append(group[order[i]])
    for g in set(wrong):
        # Where equal hashes belong to different bytes, the bytes alone decide.
        members: dict[bytes, list[int]] = {}
        for i in np.flatnonzero(group == g).tolist():
            members.setdefault(data[places[i]:places[i] + LENGTH], []).append(i)
        for where in members.values():
            out[where] = len(where) > 1
    return out


def _sort_groups(table_: pa.Table) -> pa.RecordBatch:
    """Repeated strings among the segments of whole anchors, rows ordered by anchor, as FOUND."""
    anchors = table_.column("anchor").to_numpy()
    pieces = table_.column("bytes").to_pylist()
    leads, counts = table_.column("lead").to_pylist(), table_.column("n").to_pylist()
    twice = table_.column("twice").to_pylist()
    # Equal segments of an anchor are one, by their bytes.
    kinds: dict[tuple[int, int, bytes], int] = {}
    kind_of, kind_rows, settled, of_anchor = [], [], [], {}
    for row, key in enumerate(zip(anchors.tolist(), leads, pieces, strict=True)):
        kind = kinds.setdefault(key, len(kind_rows))
        if kind == len(kind_rows):
            kind_rows.append(row)
            settled.append(twice[row])
            of_anchor.setdefault(key[0], []).append(kind)
        else:
            settled[kind] = True
        kind_of.append(kind)
    compared = [k for group in of_anchor.values() if len(group) > 1 for k in group]
    runs: dict[int, list[tuple[int, int]]] = {k: [(0, counts[kind_rows[k]])] for k, done in enumerate(settled) if done}
    if compared:
        runs |= _compare([(kind_rows[k], k) for k in compared], anchors, pieces, leads, counts, settled)
    out: list[tuple[int, int, int]] = []
    for row, kind in enumerate(kind_of):
        out += [(row, first, n) for first, n in runs.get(kind, ())]
    rows, first, n = (np.array(c, np.int64) for c in zip(*out, strict=True)) if out else [np.empty(0, np.int64)] * 3
    keys = [table_.column(c).combine_chunks().take(pa.array(rows)) for c in ("key_a", "key_b")]
    starts = table_.column("start").to_numpy()[rows] + first
    return pa.RecordBatch.from_arrays([*keys, pa.array(starts), pa.array(n)], ["key_a", "key_b", "start", "n"])


def _compare(members, anchors, pieces, leads, counts, settled) -> dict[int, list[tuple[int, int]]]:
    data = b"".join(pieces[row] for row, _ in members)
    raw = np.frombuffer(data, np.uint8)
    sizes = np.array([counts[row] for row, _ in members])
    begin = np.cumsum([0, *(len(pieces[row]) for row, _ in members)])[:-1]
    which = np.repeat(np.arange(len(members)), sizes)
    step = np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    places = begin[which] + step
    ahead = np.array([leads[row] for row, _ in members])[which] - step
    # Suffixes meet that begin at one distance from one anchor.
    _, own = np.unique(anchors[[row for row, _ in members]], return_inverse=True)
    block = own[which] * (LENGTH + 1) + ahead
    order = np.argsort(block, kind="stable")
    hashes = PrefixHashes(raw)
    again = np.zeros(len(which), bool)
    again[order] = _repeated(data, hashes, places[order], block[order])
    out = {}
    edges = np.cumsum([0, *sizes])
    for i, (_, kind) in enumerate(members):
        flags = again[edges[i]:edges[i + 1]]
        if not settled[kind] and flags.any():
            change = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]])))
            out[kind] = [(int(a), int(b - a)) for a, b in zip(change[::2], change[1::2], strict=True)]
    return out


def sort_segments(rows: DataFrame) -> DataFrame:
    """FOUND of SEGMENT rows with bytes: all rows of an anchor meet in a task, a few at a time."""
    columns = ["anchor", "key_a", "key_b", "start", "n", "lead", "twice", "bytes"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        held = 0
        for batch in batches:
            waiting.append(batch)
            held += batch.num_rows
            if held < SORTED_ROWS:
                continue
            whole = pa.Table.from_batches(waiting)
            anchors = whole.column("anchor").to_numpy()
            last = int(np.searchsorted(anchors, anchors[-1]))
            if last:
                yield _sort_groups(whole.slice(0, last))
                waiting = whole.slice(last).to_batches()
                held -= last
        if held:
            yield _sort_groups(pa.Table.from_batches(waiting))

    dealt = rows.select(*columns).repartition("anchor").sortWithinPartitions("anchor")
    return dealt.mapInArrow(work, FOUND)


def _sides(kinds: DataFrame) -> DataFrame:
    """The segments in two, by the side of the anchor on which their strings have more: those go
    on with an anchor that stands for the bytes next to it on that side, too."""
    side = (LENGTH - GRAM) // 2
    right = LENGTH - side + 1
    lead = F.col("lead")
    to_left = F.least(F.greatest(lead - side + 1, F.lit(0)), F.col("n").cast("int"))
    split = kinds.withColumn("to_left", to_left)
    cut = lambda first, size: F.substring("bytes", first, size)
    left = split.where("to_left > 0").select(
        F.xxhash64("anchor", F.lit("left"), cut(lead - side + 1, F.lit(side))).alias("anchor"),
        "key_a", "key_b", F.col("start"), F.col("to_left").cast("long").alias("n"), "lead", "twice",
        cut(F.lit(1), F.col("to_left") - 1 + LENGTH).alias("bytes"))
    rest = F.col("n").cast("int") - F.col("to_left")
    other = split.where("to_left < n").select(
        F.xxhash64("anchor", F.lit("right"), cut(lead + GRAM + 1, F.lit(right - GRAM))).alias("anchor"),
        "key_a", "key_b", (F.col("start") + F.col("to_left")).alias("start"), rest.cast("long").alias("n"),
        (lead - F.col("to_left")).alias("lead"), "twice",
        cut(F.col("to_left") + 1, rest - 1 + LENGTH).alias("bytes"))
    return left.unionByName(other)


def _by_digest(rows: DataFrame) -> DataFrame:
    """FOUND of segments, many of one anchor, by digests of each of their strings: counted, and
    those that occur again compared by their bytes. Each row stands for different bytes."""
    string = lambda: F.substring("bytes", F.col("step") + 1, F.lit(LENGTH))
    each = rows.select("key_a", "key_b", "start", "parts", "bytes",
                       F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1)).alias("step"))
    each = each.select("key_a", "key_b", "start", "step", "parts", "bytes",
                       F.xxhash64(string()).alias("h"), F.hash(string(), F.lit(7)).alias("g"))
    again = each.groupBy("h", "g").agg(F.count("*").alias("n"), F.max("parts").alias("parts")).where("n > 1")
    again = again.select("h", "g", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    each = each.withColumn("part", F.pmod(F.xxhash64("key_a", "key_b"), "parts").cast("int"))
    likely = cut_lineage(each.join(again, ["h", "g", "part"]).select("key_a", "key_b", "start", "step", "h", "g", string().alias("own")))
    unequal = likely.groupBy("h", "g").agg(F.min("own").alias("low"), F.max("own").alias("high")).where("low <> high")
    found = likely
    if not unequal.isEmpty():
        real = likely.groupBy("own").agg(F.count("*").alias("n")).where("n > 1").select("own")
        found = likely.join(real, "own")
    return found.select("key_a", "key_b", (F.col("start") + F.col("step")).alias("start"), F.lit(1).cast("long").alias("n"))


def hot_segments(rows: DataFrame) -> DataFrame:
    """FOUND of the segments of anchors that have too many for one task.

    Equal segments are counted first, so that copies, however many, are one row. The others are
    dealt out by the bytes beside the anchor, then sorted as others are, and where there are
    still too many, their strings are counted by digest.
    """
    named = rows.select("*", F.xxhash64("anchor", "lead", "bytes").alias("kind_a"),
                        F.hash("anchor", "lead", "bytes", F.lit(3)).alias("kind_b"))
    kinds = cut_lineage(
        named.groupBy("anchor", "lead", "bytes", "kind_a", "kind_b", "n")
        .agg(F.max("parts").alias("parts"), ((F.count("*") > 1) | F.max("twice")).alias("twice")))
    plain = kinds.select("anchor", F.col("kind_a").alias("key_a"), F.col("kind_b").alias("key_b"),
                         F.lit(0).cast("long").alias("start"), "n", "lead", "twice", "bytes")
    sides = cut_lineage(_sides(plain))
    sizes = sides.groupBy("anchor").agg(F.ceil(F.count("*") / MOST_ROWS).cast("int").alias("parts"))
    sides = cut_lineage(sides.join(sizes, "anchor"))
    settled = kinds.where("twice").select(
        F.col("kind_a").alias("key_a"), F.col("kind_b").alias("key_b"), F.lit(0).cast("long").alias("start"), "n")
    found = settled.unionByName(sort_segments(sides.where("parts = 1")))
    many = sides.where("parts > 1")
    if not many.isEmpty():
        found = found.unionByName(_by_digest(many))
    runs = found.groupBy("key_a", "key_b").agg(F.collect_set(F.struct("start", "n")).alias("runs"))
    # Back to the places of each kind, in as many parts as its anchor has.
    back = runs.toDF("kind_a", "kind_b", "runs").join(kinds.select("kind_a", "kind_b", "parts"), ["kind_a", "kind_b"])
    back = back.select("kind_a", "kind_b", "runs", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    places = named.select("kind_a", "kind_b", "key_a", "key_b", F.col("start").alias("base"),
                          F.pmod(F.xxhash64("key_a", "key_b", "start"), "parts").cast("int").alias("part"))
    return (places.join(back, ["kind_a", "kind_b", "part"])
            .select("key_a", "key_b", "base", F.inline("runs"))
            .select("key_a", "key_b", (F.col("base") + F.col("start")).alias("start"), "n"))


def repeated_runs(keyed: DataFrame) -> DataFrame:
    """(key_a, key_b, runs) of (key_a, key_b, text): runs of starts (start, n), in bytes, of
    strings of LENGTH bytes that start anywhere else, too. Equal rows are places of their own."""
    small_batches(keyed.sparkSession)
    read = keyed.join(suspects(keyed), ["key_a", "key_b"])
    own = cut_lineage(segments(read.select("key_a", "key_b", "text", "suspects")))
    found = own.where("bytes IS NULL").select("key_a", "key_b", "start", "n")
    own = own.where("bytes IS NOT NULL")
    found = found.unionByName(sort_segments(own.where("parts = 1")))
    hot = own.where("parts > 1")
    if not hot.isEmpty():
        found = found.unionByName(hot_segments(hot))
    return found.groupBy("key_a", "key_b").agg(F.collect_set(F.struct("start", "n")).alias("runs"))


def covered(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The maximal spans of bytes that strings with these starts cover, in order."""
    out: list[tuple[int, int]] = []
    for start, n in sorted(runs):
        end = start + n - 1 + LENGTH
        if out and start <= out[-1][1]:
            out[-1] = out[-1][0], max(end, out[-1][1])
        else:
            out.append((start, end))
    return out


def drop_repeats(docs: DataFrame, text: str = "text", key: str = "doc_id", kept: str = "kept",
                 spans: str = "spans") -> DataFrame:
    """All columns of the rows, `kept`, the text's bytes without those in repeated strings, and
    `spans`, the maximal runs (first, end) of bytes that are removed.

    A repeated string is one of LENGTH bytes that starts in another place, too, of the same or
    of another row; all its places go. What is kept can begin or end within a character, so it
    is binary. A null text is empty. Rows that repeat all values are copies of each other like
    any others. Columns that bear the results' names are replaced. A text is worked on by one
    task: memory follows the longest.
    """
    small_batches(docs.sparkSession)
    docs = without(docs, *({kept, spans} - {text, key}))
    taken = [*docs.columns, kept, spans]
    key_a, key_b, runs = (fresh_name(n, taken) for n in ("key_a", "key_b", "runs"))
    keyed = docs.select("*", *[c.alias(n) for c, n in zip(row_key(key, text), (key_a, key_b), strict=True)])
    narrow = keyed.select(F.col(f"`{key_a}`").alias("key_a"), F.col(f"`{key_b}`").alias("key_b"),
                          F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    found = repeated_runs(narrow).toDF(key_a, key_b, runs)
    joined = keyed.join(found, [key_a, key_b], "left").select(*[F.col(f"`{c}`") for c in docs.columns], F.col(runs))
    place = docs.columns.index(text)
    names = [*docs.columns, kept, spans]
    extra = [F.lit(None).cast("binary").alias(kept),
             F.lit(None).cast("array<struct<first:bigint,end:bigint>>").alias(spans)]
    schema = docs.select("*", *extra).schema

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = text_bytes(batch.column(place))
            data, edges, left, sizes, flat = raw.tobytes(), at.tolist(), [], [0], []
            for i, own in enumerate(batch.column(len(names) - 2).to_pylist()):
                gone = covered([(r["start"], r["n"]) for r in own or ()])
                body = data[edges[i]:edges[i + 1]]
                left.append(b"".join(body[a:b] for a, b in zip([0, *(e for _, e in gone)],
                                                               [*(f for f, _ in gone), len(body)], strict=True)))
                flat += gone
                sizes.append(len(flat))
            first, end = (pa.array([x[k] for x in flat], pa.int64()) for k in (0, 1))
            lists = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.StructArray.from_arrays([first, end], ["first", "end"]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(left, pa.binary()), lists], names)

    return joined.mapInArrow(work, schema)


def op13_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    found = drop_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    n_bytes = F.octet_length(whole_text()).cast("long")
    return found.select(
        "doc_id", n_bytes.alias("n_bytes"), (n_bytes - F.octet_length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
