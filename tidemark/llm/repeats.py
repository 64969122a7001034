"""Repeated substrings: removes every byte covered by a string of 100 bytes that also starts earlier in the corpus.

Prefix doubling names every position by the rank of its first h bytes, pairs the names at p and p + h, sorts the pairs and
renames, and drops positions whose name is unique, until h passes the threshold. Over all positions of a corpus each
round would sort some twenty times the input. Here the positions are sampled so that no match is lost, ranks are 64-bit
fingerprints, and two rounds remain:

1. Anchors. Of the grams of 24 bytes in a window of 100 bytes, the one with the smallest fingerprint is the window's anchor;
   equal windows have their anchor at the same place. Consecutive windows of one anchor form a stretch. Spark sorts the
   pairs (rank of the anchor's 24 bytes, rank of the whole stretch with its surroundings). A gram that is unique
   drops out with all its windows; of equal pairs all but the first are repeats as a whole.
2. Only where one gram stands in different surroundings, the first stretch of each kind goes on with its bytes. Spark sorts
   these by gram again, and windows of 100 bytes are ranked within each gram; all but the first of equal ones are
   repeats. A gram with very many kinds is not gathered: its windows are sorted by their own ranks.

The repeats of each document are then laid over its text. Both rounds and the last step read texts dealt by document;
Spark deals them once. Within a task only the first of equal pairs goes on to a sort, the others are known to be repeats;
so a passage that a third of all documents hold reaches the sort once per task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.text import fresh, key_of, plain_names, text_of
from tidemark.session import cut_lineage

LENGTH, GRAM = 100, 24
#: Bytes fingerprinted at once; a longer text is cut into pieces that overlap by a window.
PIECE = 1_000_000
#: Pairs in which a task looks for equal ones before it passes them on.
HELD = 750_000
#: Kinds of surroundings of one gram that are ranked in one task.
KINDS = 20_000
#: A text is named by its id ``key`` and a 64-bit hash ``row``. ``place`` holds the start, 7 bits of the number of windows
#: less one, and whether the pair is known to be a repeat; its order is that of places within a text.
PAIR = "one long, two long, key long, row long, place long"
FOUND = "one long, key long, row long, place long"
EDGE = "one long, two long, key long, row long, place long, around binary"
RANGE = "key long, row long, start long, span long"
_random = np.random.default_rng(20240229)
_BYTE = _random.integers(0, 2**64, (2, 256), np.uint64)
_BASE = [int(b) | 1 for b in _random.integers(2**62, 2**63, 2)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _gather(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


class Fingerprints:
    """Fingerprints of any stretch of a byte array, from running sums modulo 2^64."""

    powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, flat: np.ndarray, family: int):
        forth, back = self._powers(family, len(flat) + 1)
        self.back = back
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[family][flat] * forth[: len(flat)])])

    @classmethod
    def _powers(cls, family: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        if family not in cls.powers or len(cls.powers[family][0]) < n:
            size = 1 << (n - 1).bit_length()
            both = [np.full(size, b, np.uint64) for b in (_BASE[family], pow(_BASE[family], -1, 2**64))]
            for powers in both:
                powers[0] = 1
                np.multiply.accumulate(powers, out=powers)
            cls.powers[family] = tuple(both)
        return cls.powers[family]

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return _mix((self.sums[ends] - self.sums[starts]) * self.back[starts])


def _window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each ``width`` consecutive values, from running minima of blocks in both directions."""
    n = len(values) - width + 1
    padded = np.concatenate([values, np.full(-len(values) % width, 2**64 - 1, np.uint64)]).reshape(-1, width)
    forward = np.minimum.accumulate(padded, axis=1).reshape(-1)
    backward = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(backward[:n], forward[width - 1 : width - 1 + n])


def stretches(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
    """First and last window start, gram rank and surroundings rank of every stretch of the pieces laid out in ``flat``."""
    inside = sizes >= LENGTH
    starts, sizes = starts[inside], sizes[inside]
    if not len(starts):
        empty = np.zeros(0, np.int64)
        return empty, empty, empty.view(np.uint64), empty.view(np.uint64)
    at = np.arange(len(flat) - GRAM + 1)
    one, two = Fingerprints(flat, 0), Fingerprints(flat, 1)
    grams = one.of(at, at + GRAM)
    low = np.uint64((1 << len(flat).bit_length()) - 1)
    # Places in the low bits: of equal grams in a window the leftmost is taken.
    minima = _window_minima((grams & ~low) | at.astype(np.uint64), LENGTH - GRAM + 1)
    windows = _gather(starts, sizes - LENGTH + 1)
    anchors = (minima[windows] & low).astype(np.int64)
    new = np.concatenate([[True], (anchors[1:] != anchors[:-1]) | (windows[1:] != windows[:-1] + 1)])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(windows)) - 1
    lo, hi, anchor = windows[first], windows[last], anchors[first]
    shape = ((anchor - lo) * 256 + (hi - lo)).astype(np.uint64)
    return lo, hi, grams[anchor], _mix(two.of(lo, hi + LENGTH) + shape)


def _place(start: np.ndarray, span: np.ndarray) -> np.ndarray:
    return (start << 8) | (span << 1)


def _later(one: np.ndarray, two: np.ndarray, key: np.ndarray, row: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Which pairs equal one of a smaller place."""
    order = np.lexsort((place, row, key, two, one))
    a, b, k, r, p = (x[order] for x in (one, two, key, row, place))
    new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
    first = np.flatnonzero(new)[np.cumsum(new) - 1]
    out = np.empty(len(one), bool)
    out[order] = (k != k[first]) | (r != r[first]) | (p != p[first])
    return out


class _Firsts:
    """Collects pairs of a task and marks those that equal an earlier one of the task as known repeats."""

    def __init__(self):
        self.parts, self.n = [], 0

    def add(self, *columns: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        self.parts.append(columns)
        self.n += len(columns[0])
        if self.n >= HELD:
            yield from self.flush()

    def flush(self) -> Iterator[tuple[np.ndarray, ...]]:
        if self.n:
            one, two, key, row, place = (np.concatenate(c) for c in zip(*self.parts, strict=True))
            self.parts, self.n = [], 0
            known = _later(one, two, key, row, place)
            # What is known need not meet its like: it is dealt out by its place.
            one = np.where(known, _mix(one + place.view(np.uint64) * np.uint64(31) + _mix(row.view(np.uint64) + key.view(np.uint64))), one)
            place = place | known
            for a in range(0, len(one), 50_000):
                b = slice(a, a + 50_000)
                yield one[b].view(np.int64), two[b].view(np.int64), key[b], row[b], place[b]


def _anchor_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    firsts = _Firsts()

    def pairs(held):
        pieces = [piece for *_, piece in held]
        sizes = np.array([len(p) for p in pieces])
        starts = np.cumsum(sizes) - sizes
        flat = np.frombuffer(b"".join(pieces), np.uint8)
        lo, hi, grams, around = stretches(flat, starts, sizes)
        of = np.searchsorted(starts, lo, side="right") - 1
        keys, rows, offsets = (np.array([h[i] for h in held], np.int64) for i in range(3))
        return grams, around, keys[of], rows[of], _place(lo - starts[of] + offsets[of], hi - lo)

    def batch(columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["one", "two", "key", "row", "place"])

    held, n = [], 0
    for arrow in batches:
        for key, row, text in zip(*[c.to_pylist() for c in arrow.columns], strict=True):
            data = text.encode()
            for offset in range(0, max(len(data) - LENGTH + 1, 0), PIECE):
                piece = data[offset : offset + PIECE + LENGTH - 1]
                if held and n + len(piece) > PIECE + LENGTH:
                    yield from map(batch, firsts.add(*pairs(held)))
                    held, n = [], 0
                held.append((key, row, offset, piece))
                n += len(piece)
    if held:
        yield from map(batch, firsts.add(*pairs(held)))
    yield from map(batch, firsts.flush())


def _first_of(new: np.ndarray, before: tuple | None, *columns: np.ndarray) -> list[np.ndarray]:
    """Of each row the columns of the last row that is ``new``, or those of ``before`` where there is none."""
    at = np.maximum.accumulate(np.where(new, np.arange(len(new)), -1))
    return [np.where(at >= 0, c[np.maximum(at, 0)], b) for c, b in zip(columns, before or (0,) * len(columns), strict=True)]


def _differ(firsts: list[np.ndarray], *columns: np.ndarray) -> np.ndarray:
    return np.any([f != c for f, c in zip(firsts, columns, strict=True)], axis=0)


def _ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pairs in order: the repeats (all but the first of equal pairs; marked in ``place``), and the first pairs of a rank
    ``one`` that has several."""
    pair = first = waiting = None  # last pair, its first place, and the first pair of a rank without a second one so far
    for batch in batches:
        one, two, key, row, place = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        if not len(one):
            continue
        known = (place & 1) > 0
        repeat = known.copy()
        live = np.flatnonzero(~known)
        chosen, extra = np.zeros(0, np.int64), []
        if len(live):
            a, b = one[live], two[live]
            new_rank = np.concatenate([[pair is None or pair[0] != a[0]], a[1:] != a[:-1]])
            new = new_rank | np.concatenate([[pair is None or pair != (a[0], b[0])], b[1:] != b[:-1]])
            firsts_of = _first_of(new, first, key[live], row[live], place[live])
            repeat[live[~new & _differ(firsts_of, key[live], row[live], place[live])]] = True
            # A rank with a second pair gives all its first pairs to the next round.
            rank = np.cumsum(new_rank) - (1 if new_rank[0] else 0)
            kinds = np.bincount(rank[new], minlength=int(rank[-1]) + 1)
            if not new_rank[0]:
                kinds[0] += 1  # the pair met before this batch
                if kinds[0] > 1 and waiting is not None:
                    extra.append(waiting)
                    waiting = None
            firsts = np.flatnonzero(new)
            chosen = live[firsts[kinds[rank[firsts]] > 1]]
            if new_rank.any():
                waiting = None
            if len(firsts) and rank[firsts[-1]] == rank[-1] and kinds[rank[-1]] == 1:
                i = live[firsts[-1]]
                waiting = (one[i], key[i], row[i], place[i])
            pair, first = (a[-1], b[-1]), tuple(c[-1] for c in firsts_of)
        both = np.concatenate([np.flatnonzero(repeat), chosen])
        marks = np.arange(len(both)) < int(repeat.sum())
        columns = [np.concatenate([c, np.array([e[i] for e in extra], np.int64)]) for i, c in enumerate((one[both], key[both], row[both], place[both] | marks))]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["one", "key", "row", "place"])


def _with_bytes(batches: Iterator[pa.RecordBatch], columns: tuple[int, int, int, int]) -> Iterator[pa.RecordBatch]:
    """Stretches with the bytes of all their windows; of a gram with many kinds one pair per window instead."""
    firsts = _Firsts()

    def pairs(parts) -> pa.RecordBatch:
        none = pa.nulls(len(parts[0]), pa.binary())
        return pa.RecordBatch.from_arrays([*[pa.array(c) for c in parts], none], names=["one", "two", "key", "row", "place", "around"])

    for batch in batches:
        keys, rows, texts, lists = (batch.column(i).to_pylist() for i in columns)
        local: list[tuple] = []
        for key, row, text, spans in zip(keys, rows, texts, lists, strict=True):
            data = (text or "").encode()
            hot = [(s["start"], s["span"] + 1) for s in spans if s["hot"]]
            for s in spans:
                if not s["hot"]:
                    local.append((s["one"], 0, key, row, (s["start"] << 8) | (s["span"] << 1), data[s["start"] : s["start"] + s["span"] + LENGTH]))
            # In steps, so that the copied surroundings stay small.
            for i in range(0, len(hot), 2000):
                starts, counts = (np.array(x, np.int64) for x in zip(*hot[i : i + 2000], strict=True))
                one, two, place = _windows(np.frombuffer(data, np.uint8)[_gather(starts, counts + LENGTH - 1)], starts, counts)
                same = np.zeros(len(place), np.int64)
                yield from map(pairs, firsts.add(one, two, same + key, same + row, _place(place, same)))
        if local:
            kinds = (pa.int64(),) * 5 + (pa.binary(),)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, kind) for c, kind in zip(zip(*local, strict=True), kinds, strict=True)], names=["one", "two", "key", "row", "place", "around"]
            )
    yield from map(pairs, firsts.flush())


def _windows(flat: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Both ranks and the place of every window; ``flat`` holds the bytes of the stretches one after the other."""
    sizes = counts + LENGTH - 1
    at = _gather(np.cumsum(sizes) - sizes, counts)
    return Fingerprints(flat, 0).of(at, at + LENGTH), Fingerprints(flat, 1).of(at, at + LENGTH), _gather(starts, counts)


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranges of window starts that are repeats, out of rows in the order of ``one``."""
    start_of = lambda place: place >> 8

    def ranges(key, row, start) -> pa.RecordBatch:
        order = np.lexsort((start, row, key))
        key, row, start = key[order], row[order], start[order]
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (row[1:] != row[:-1]) | (start[1:] > start[:-1] + 1)])[: len(key)]
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(key)) - 1
        span = start[last] - start[first] if len(first) else np.zeros(0, np.int64)
        return pa.RecordBatch.from_arrays(
            [pa.array(key[first]), pa.array(row[first]), pa.array(start[first]), pa.array(span)], names=["key", "row", "start", "span"]
        )

    def ranked(one, key, row, place, around) -> pa.RecordBatch:
        counts = ((place >> 1) & 127) + 1
        w1, w2, windows = _windows(np.frombuffer(b"".join(around), np.uint8), start_of(place), counts)
        keys, rows = np.repeat(key, counts), np.repeat(row, counts)
        again = _later(w1, w2, keys, rows, _place(windows, np.zeros(len(rows), np.int64)))
        return ranges(keys[again], rows[again], windows[again])

    held: list[tuple] = []  # rows of grams that are not complete yet
    pair = first = None
    for batch in batches:
        one, two, key, row, place = (c.to_numpy(zero_copy_only=False) for c in batch.columns[:5])
        around = batch.column(5).to_pylist()
        local = np.array([x is not None for x in around], bool)
        # Pairs of single windows: all but the first of equal ones.
        live, known = np.flatnonzero(~local & ((place & 1) == 0)), np.flatnonzero(~local & ((place & 1) > 0))
        again = [known]
        if len(live):
            a, b = one[live], two[live]
            new = np.concatenate([[pair != (a[0], b[0])], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
            firsts_of = _first_of(new, first, key[live], row[live], place[live])
            again.append(live[~new & _differ(firsts_of, key[live], row[live], place[live])])
            pair, first = (a[-1], b[-1]), tuple(c[-1] for c in firsts_of)
        again = np.concatenate(again)
        yield ranges(key[again], row[again], start_of(place[again]))
        at = np.flatnonzero(local)
        held += zip(one[at].tolist(), key[at].tolist(), row[at].tolist(), place[at].tolist(), [around[i] for i in at], strict=True)
        end = len(held)
        while end and held[end - 1][0] == held[-1][0]:
            end -= 1
        for i, j in _whole_grams(held, end):
            yield ranked(*_columns(held[i:j]))
        held = held[end:]
    if held:
        yield ranked(*_columns(held))


def _whole_grams(rows: list[tuple], end: int) -> Iterator[tuple[int, int]]:
    """Parts of about 4000 rows that end with a gram."""
    start = 0
    while start < end:
        stop = min(start + 4000, end)
        while stop < end and rows[stop][0] == rows[stop - 1][0]:
            stop += 1
        yield start, stop
        start = stop


def _columns(rows: list[tuple]) -> tuple:
    *numbers, around = zip(*rows, strict=True)
    return *[np.array(c, np.int64) for c in numbers], around


@plain_names
def remove_repeats(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``documents`` with ``n_bytes``, ``n_removed``, ``n_spans`` (long) and ``kept`` (binary: the bytes that stay) added.

    A byte goes if a string of 100 bytes that covers it also starts earlier: in a smaller id, or before it in the same text.
    Strings are judged on the input; they never cross documents. Null and short texts lose nothing (null: no bytes). A null
    id comes before all others. Texts of one id are ordered by a 64-bit hash; rows that repeat an id and a text are one
    document. What stays may cut a character in two, hence bytes. Columns of the added names are replaced.
    """
    added = ("n_bytes", "n_removed", "n_spans", "kept")
    kept = [c for c in documents.columns if c.lower() not in added]
    n = fresh(documents, "key", "row", "spans")
    key, row = n["key"], n["row"]
    rows = documents.select(*[f"`{c}`" for c in kept]).withColumns(
        {key: key_of(id_column), row: F.xxhash64(text_of(text_column), F.octet_length(text_of(text_column)))}
    )
    at = [c.lower() for c in kept].index(text_column.lower())
    pairs = rows.select(key, row, text_of(text_column)).mapInArrow(_anchor_pairs, PAIR)
    order = ["one", "two", "key", "row", "place"]
    found = cut_lineage(pairs.repartition("one").sortWithinPartitions(*order).mapInArrow(_ranked, FOUND), "stretches")
    where = {"start": F.shiftright("place", 8), "span": F.shiftright("place", 1).bitwiseAND(127)}
    repeat = F.col("place").bitwiseAND(1) == 1

    # Rows that repeat an id and a text name the same places again.
    kinds = found.where(~repeat).distinct()
    many = cut_lineage(kinds.groupBy("one").agg(F.count("*").alias("kinds")).where(F.col("kinds") > KINDS).select("one", F.lit(True).alias("hot")), "hot")
    opened = kinds.join(many, "one", "left").withColumn("hot", F.coalesce("hot", F.lit(False))).withColumns(where)
    opened = opened.groupBy("key", "row").agg(F.collect_list(F.struct("one", "start", "span", "hot")).alias("spans"))
    opened = cut_lineage(opened.select(F.col("key").alias(key), F.col("row").alias(row), F.col("spans").alias(n["spans"])), "opened")
    # The same columns of the same rows as in the last join, so that texts are dealt out once for both.
    met = rows.join(opened.hint("merge"), [key, row])
    places = tuple(met.columns.index(c) for c in (key, row)) + (at + 2, len(met.columns) - 1)
    edges = (
        met.mapInArrow(lambda batches: _with_bytes(batches, places), EDGE)
        .repartition("one").sortWithinPartitions(*order).mapInArrow(_edges, RANGE)
    )
    repeats = found.where(repeat).withColumns(where).select("key", "row", "start", F.col("span").cast("long").alias("span"))
    spans = repeats.unionByName(edges).groupBy("key", "row").agg(F.collect_list(F.struct("start", "span")).alias("spans"))
    spans = spans.select(F.col("key").alias(key), F.col("row").alias(row), F.col("spans").alias(n["spans"]))
    joined = rows.join(spans.hint("merge"), [key, row], "left")
    last = len(joined.columns) - 1

    def lay_over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, ranges in zip(batch.column(at + 2).to_pylist(), batch.column(last).to_pylist(), strict=True):
                data = (text or "").encode()
                if not ranges:
                    out.append((len(data), 0, 0, data))
                    continue
                marks = np.zeros(len(data) + 1, np.int32)
                np.add.at(marks, [r["start"] for r in ranges], 1)
                np.add.at(marks, [r["start"] + r["span"] + LENGTH for r in ranges], -1)
                gone = np.cumsum(marks)[:-1] > 0
                begins = np.count_nonzero(gone & ~np.concatenate([[False], gone[:-1]]))
                out.append((len(data), int(gone.sum()), int(begins), np.frombuffer(data, np.uint8)[~gone].tobytes()))
            types = (pa.int64(),) * 3 + (pa.binary(),)
            columns = [pa.array([x[i] for x in out], kind) for i, kind in enumerate(types)]
            yield pa.RecordBatch.from_arrays([*batch.columns[2:last], *columns], names=[*kept, *added])

    fields = [T.StructField(c, T.LongType()) for c in added[:3]] + [T.StructField("kept", T.BinaryType())]
    return joined.mapInArrow(lay_over, T.StructType([*joined.schema.fields[2:last], *fields]))
