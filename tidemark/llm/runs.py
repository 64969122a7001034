"""Periodic runs: stretches of words that repeat with a period, found by recursive frequency splitting.

A word inside a run of exponent 2 or more occurs at least twice in it. So a word that occurs once within a segment can be in
no run of that segment, and parts it; segments shorter than the shortest run are done with. What is left is parted anew,
until no segment changes: prose falls to pieces after a few rounds, all documents of a batch at once. The segments that
survive are scanned lag by lag. A run of period q holds a stretch of at least q words that are equal to those q further on,
and such a stretch covers a multiple of q; so only the multiples of each lag are looked at (m ln m of them in m words), and
how far the equality reaches from there is read off ranks of all blocks of 1, 2, 4, ... words, which are exact.

Every document is worked on by itself, where it is read; nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidemark.llm.text import add_columns

#: Words of a run at least, and how many periods it holds at least.
LEAST_WORDS, LEAST_PERIODS = 12, 2
#: Bytes of text that are split at once, distinct words kept between passes, and pairs of places compared at once.
PASS_BYTES, KEPT_WORDS, PAIRS = 4_000_000, 500_000, 2_000_000
RUN = T.StructType([T.StructField(name, T.LongType(), False) for name in ("start", "length", "period")])


def surviving(codes: np.ndarray, owners: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Places left after splitting to stability, ascending, and the number of the segment of each.

    ``codes`` are the words of all documents one after the other, ``owners`` the document of each. A word stays while it
    occurs twice in its segment, a segment while it has ``least`` words.
    """
    places, segments = np.arange(len(codes)), owners
    span = int(codes.max(initial=0)) + 1
    while len(places):
        keys = segments * span + codes[places]
        order = np.argsort(keys, kind="stable")
        ranked = keys[order]
        again = np.zeros(len(keys), bool)
        same = ranked[1:] == ranked[:-1]
        again[1:] |= same
        again[:-1] |= same
        stays = np.empty(len(keys), bool)
        stays[order] = again
        kept, of = places[stays], segments[stays]
        starts = np.ones(len(kept), bool)
        starts[1:] = (np.diff(kept) != 1) | (np.diff(of) != 0)
        number = np.cumsum(starts) - 1
        long_enough = np.bincount(number)[number] >= least if len(kept) else np.zeros(0, bool)
        kept, number = kept[long_enough], number[long_enough]
        if len(kept) == len(places):
            return places, number
        places, segments = kept, number
    return places, segments


class Reach:
    """How many words from two places on (or back from them) are equal."""

    def __init__(self, words: np.ndarray, most: int):
        self.n, self.levels = len(words), [words.astype(np.int32)]
        width = 1
        while 2 * width <= most:
            level = self.levels[-1].astype(np.int64)
            pairs = level[:-width] * (int(level.max()) + 1) + level[width:]
            self.levels.append(np.unique(pairs, return_inverse=True)[1].astype(np.int32))
            width *= 2

    def forward(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Equal words from ``left`` and ``right`` (greater) on, to the end."""
        total = np.zeros(len(left), np.int64)
        for level in range(len(self.levels) - 1, -1, -1):
            names, width = self.levels[level], 1 << level
            # The largest level may match more than once: a reach is below twice its width otherwise.
            while True:
                fits = right + total + width <= self.n
                at = np.flatnonzero(fits)
                at = at[names[left[at] + total[at]] == names[right[at] + total[at]]]
                total[at] += width
                if level < len(self.levels) - 1 or not len(at):
                    break
        return total

    def backward(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Equal words before ``left`` (smaller) and ``right``."""
        total = np.zeros(len(left), np.int64)
        for level in range(len(self.levels) - 1, -1, -1):
            names, width = self.levels[level], 1 << level
            while True:
                at = np.flatnonzero(left - total >= width)
                at = at[names[left[at] - total[at] - width] == names[right[at] - total[at] - width]]
                total[at] += width
                if level < len(self.levels) - 1 or not len(at):
                    break
        return total


def scan(words: np.ndarray, least: int = LEAST_WORDS, periods: int = LEAST_PERIODS) -> np.ndarray:
    """Runs of one segment as rows (start, length, period), by start and then by period."""
    m = len(words)
    words = np.unique(words, return_inverse=True)[1]
    reach, found = Reach(words, max(m // 2, 1)), []
    lag, top = 1, m // periods
    while lag <= top:
        # Lags lag .. last - 1 and their multiples, about PAIRS pairs at a time.
        last, held = lag, 0
        while last <= top and (last == lag or held + m // last <= PAIRS):
            held += m // last
            last += 1
        lags = np.arange(lag, last)
        counts = np.maximum(-(-(m - lags) // lags), 0)  # multiples k * lag with k * lag + lag < m
        lags = np.repeat(lags, counts)
        left = (np.arange(len(lags)) - np.repeat(np.cumsum(counts) - counts, counts)) * lags
        equal = words[left] == words[left + lags]
        left, lags = left[equal], lags[equal]
        # Of the multiples inside one stretch only the first: the one before it is not equal all the way.
        behind = reach.backward(left, left + lags)
        first = behind < lags
        left, lags, behind = left[first], lags[first], behind[first]
        length = behind + reach.forward(left, left + lags) + lags
        fits = (length >= periods * lags) & (length >= least)
        found.append(np.stack([(left - behind)[fits], length[fits], lags[fits]], axis=1))
        lag = last
    rows = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
    # A stretch is met again under multiples of its smallest period.
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
    rows = rows[new]
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


class Finder:
    """Finds the runs of a batch of texts; numbers words as it meets them, up to a bound."""

    def __init__(self, least: int, periods: int):
        self.least, self.periods, self.known = least, periods, {}

    def find(self, split: list[list[bytes]]) -> list[np.ndarray]:
        known = self.known
        if len(known) > KEPT_WORDS:
            known.clear()
        sizes = np.fromiter(map(len, split), np.int64, len(split))
        codes = np.fromiter((known.setdefault(w, len(known)) for words in split for w in words), np.int64, int(sizes.sum()))
        owners = np.repeat(np.arange(len(split)), sizes)
        places, segments = surviving(codes, owners, self.least)
        out: list[list[np.ndarray]] = [[] for _ in split]
        firsts = np.cumsum(sizes) - sizes
        cuts = np.flatnonzero(np.diff(segments)) + 1
        for part in np.split(places, cuts) if len(places) else []:
            start = int(part[0])
            rows = scan(codes[start : start + len(part)], self.least, self.periods)
            if len(rows):
                owner = int(owners[start])
                rows[:, 0] += start - int(firsts[owner])
                out[owner].append(rows)
        return [np.concatenate(rows) if rows else np.zeros((0, 3), np.int64) for rows in out]


def collapsed(words: list[bytes], rows: np.ndarray) -> bytes:
    """The words left when each run keeps its first period only, joined by single blanks."""
    if not len(rows):
        return b" ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, rows[:, 0] + rows[:, 2], 1)
    np.add.at(change, rows[:, 0] + rows[:, 1], -1)
    covered = np.cumsum(change[:-1]) > 0
    return b" ".join([w for w, gone in zip(words, covered.tolist(), strict=True) if not gone])


def _passes(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Consecutive stretches of about PASS_BYTES in all; a longer text is one of its own."""
    start = held = 0
    for at, size in enumerate(sizes):
        if held and held + size > PASS_BYTES:
            yield start, at
            start, held = at, 0
        held += size
    if start < len(sizes):
        yield start, len(sizes)


def periodic_runs(
    documents: DataFrame, text_column: str = "text", least: int = LEAST_WORDS, periods: int = LEAST_PERIODS,
    runs_column: str = "runs", collapsed_column: str = "collapsed", words_column: str = "n_words",
) -> DataFrame:
    """``documents`` with the number of words, all periodic runs and the text without their repetitions.

    Words are what blanks (``[\\x20\\x09-\\x0D]``) part, numbered from 0. A run is a stretch of words with smallest period q
    and at least max(``least``, ``periods`` * q) words that no neighbouring word extends with period q; ``runs`` is an array of
    (start, length, period) by start, then period. ``collapsed`` drops each word that some run contains after its first q
    words, and joins the others by one blank. A null or empty text has no words, no runs and an empty ``collapsed``. Repeated
    rows and null ids are rows like others. Columns of the three names are replaced.
    """
    if periods < 2 or least < 2:
        raise ValueError("a run has at least two periods and two words")
    kind = pa.struct([pa.field(name, pa.int64(), nullable=False) for name in ("start", "length", "period")])

    def run(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[list[pa.Array]]:
        finder, at = Finder(least, periods), names.index(text_column.lower())
        for batch in batches:
            column = batch.column(at)
            for start, end in _passes(pc.fill_null(pc.binary_length(column), 0).to_pylist()):
                split = [(text or b"").split() for text in column.slice(start, end - start).cast(pa.binary()).to_pylist()]
                found = finder.find(split)
                offsets = np.concatenate([[0], np.cumsum([len(rows) for rows in found])]).astype(np.int32)
                flat = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
                structs = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(flat[:, i])) for i in range(3)], fields=list(kind))
                left = [collapsed(words, rows) for words, rows in zip(split, found, strict=True)]
                yield [
                    *batch.slice(start, end - start).columns, pa.array([len(words) for words in split], pa.int64()),
                    pa.ListArray.from_arrays(pa.array(offsets), structs), pa.array(left, pa.binary()).cast(pa.string()),
                ]

    fields = [T.StructField(words_column, T.LongType()), T.StructField(runs_column, T.ArrayType(RUN, False)), T.StructField(collapsed_column, T.StringType())]
    return add_columns(documents, fields, run)
