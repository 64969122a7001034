"""Exact dedup against a history of distinct digests held in minimal perfect hash tables.

The history is grouped by digest once. Digests are cut into parts by their own bits; every part becomes one table without
gaps: levels of bit arrays place each digest alone in a slot, and the slot holds the whole digest, the winner's id and
the size of the group. A lookup computes one slot per digest and compares all 32 bytes, so a digest that is not in the
history is never taken for a member. Members join the group of their slot; nonmembers form groups of their own.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.text import ascii_lower, key_of, text_of
from tidemark.session import cut_lineage

#: Digests of one table at most, on average.
PART_ROWS = 50_000
#: Bits of a level for each digest that still has no slot.
SPREAD = 2
LEVELS = 40
INDEX = "part int, n long, level_bits array<long>, bits binary, digests binary, winners binary, sizes binary"
GROUPS = "digest binary, keep_key long, group_size long"


def _words(digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    whole = digests.view("<u8").reshape(len(digests), 4)
    return whole[:, 1] ^ whole[:, 2], whole[:, 3]


def _spots(low: np.ndarray, high: np.ndarray, level: int, bits: int) -> np.ndarray:
    mixed = (low + high * np.uint64(2 * level + 1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(32)
    return (mixed % np.uint64(bits)).astype(np.int64)


class PerfectTable:
    """A minimal perfect hash over the distinct 32-byte rows of ``digests``: digest to slot in [0, n)."""

    def __init__(self, level_bits: list[int], packed: bytes):
        self.level_bits = level_bits
        self.bits = np.unpackbits(np.frombuffer(packed, np.uint8))[: sum(level_bits)].astype(bool)
        self.before = np.concatenate([[0], np.cumsum(self.bits)])

    @classmethod
    def build(cls, digests: np.ndarray) -> PerfectTable:
        low, high = _words(digests)
        level_bits, arrays = [], []
        while len(low):
            if len(level_bits) == LEVELS:
                raise ValueError("digests of a perfect hash table have to be distinct")
            size = max(8, SPREAD * len(low))
            spots = _spots(low, high, len(level_bits), size)
            alone = np.bincount(spots, minlength=size) == 1
            level_bits.append(size)
            arrays.append(alone)
            again = ~alone[spots]
            low, high = low[again], high[again]
        return cls(level_bits, np.packbits(np.concatenate(arrays)).tobytes() if arrays else b"")

    def packed(self) -> bytes:
        return np.packbits(self.bits).tobytes()

    def slots(self, digests: np.ndarray) -> np.ndarray:
        """A slot for every row; -1 where no level has a place. A row outside the table may get any slot."""
        low, high = _words(digests)
        out = np.full(len(digests), -1, np.int64)
        left, start = np.arange(len(digests)), 0
        for level, size in enumerate(self.level_bits):
            if not len(left):
                break
            spots = _spots(low[left], high[left], level, size) + start
            hit = self.bits[spots]
            out[left[hit]] = self.before[spots[hit]]
            left, start = left[~hit], start + size
        return out


def _matrix(digests: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(digests), np.uint8).reshape(len(digests), 32)


def _build_part(pdf: pd.DataFrame) -> pd.DataFrame:
    digests = _matrix(pdf["digest"])
    built = PerfectTable.build(digests)
    at = np.argsort(built.slots(digests), kind="stable")
    return pd.DataFrame(
        [
            {
                "part": pdf["part"].iloc[0], "n": len(pdf), "level_bits": built.level_bits, "bits": built.packed(),
                "digests": digests[at].tobytes(), "winners": pdf["keep_key"].to_numpy(np.int64)[at].tobytes(),
                "sizes": pdf["group_size"].to_numpy(np.int64)[at].tobytes(),
            }
        ]
    )


def _look_up(tables: pd.DataFrame, probes: pd.DataFrame) -> pd.DataFrame:
    """All groups of one part: the slots, with what the probes add to them, and the probes that are in no slot."""
    stored = np.zeros((0, 32), np.uint8)
    winners = sizes = np.zeros(0, np.int64)
    member = np.zeros(len(probes), bool)
    asked = _matrix(probes["digest"])
    keys, counts = probes["keep_key"].to_numpy(np.int64), probes["group_size"].to_numpy(np.int64)
    if len(tables):
        row = tables.iloc[0]
        stored = np.frombuffer(row["digests"], np.uint8).reshape(-1, 32)
        winners, sizes = np.frombuffer(row["winners"], np.int64).copy(), np.frombuffer(row["sizes"], np.int64).copy()
        slots = PerfectTable(list(row["level_bits"]), row["bits"]).slots(asked)
        member = slots >= 0
        member[member] = (stored[slots[member]] == asked[member]).all(axis=1)
        np.maximum.at(winners, slots[member], keys[member])
        np.add.at(sizes, slots[member], counts[member])
    new = ~member
    return pd.DataFrame(
        {
            "digest": [row.tobytes() for row in stored] + [row.tobytes() for row in asked[new]],
            "keep_key": np.concatenate([winners, keys[new]]), "group_size": np.concatenate([sizes, counts[new]]),
        }
    )


def _grouped(rows: DataFrame) -> DataFrame:
    return rows.groupBy("digest").agg(F.max("key").alias("keep_key"), F.count("*").alias("group_size"))


def _in_parts(groups: DataFrame, parts: int) -> DataFrame:
    return groups.withColumn("part", F.pmod(F.xxhash64("digest"), F.lit(parts)).cast("int"))


def part_count(history: DataFrame) -> int:
    """Parts for a history of distinct digests: tables of bounded size, and several for each task of a shuffle."""
    shuffles = int(history.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(4 * shuffles, -(-history.count() // PART_ROWS))


def build_index(history: DataFrame, parts: int) -> DataFrame:
    """One row per part out of distinct ``digest``, ``keep_key``, ``group_size``; it can be stored and reused."""
    return _in_parts(history, parts).groupBy("part").applyInPandas(_build_part, INDEX)


def look_up(index: DataFrame, arrivals: DataFrame, parts: int) -> DataFrame:
    """All groups after ``arrivals`` (distinct ``digest``, ``keep_key``, ``group_size``) have met the index."""
    return index.groupBy("part").cogroup(_in_parts(arrivals, parts).groupBy("part")).applyInPandas(_look_up, GROUPS)


def digests(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``key`` (id, or the lowest number for null) and ``digest`` (SHA-256 of the text with A-Z lower-cased; null is empty)."""
    return documents.select(
        key_of(id_column).alias("key"), F.unhex(F.sha2(ascii_lower(text_of(text_column)), 256)).alias("digest")
    )


def dedup(history: DataFrame, arrivals: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Every row of both tables with its group: ``key``, ``digest``, ``keep_key``, ``group_size``, ``kept``.

    Equal texts (A-Z lower-cased, null as empty) form a group; the row with the largest id stays. Rows with a null id order
    below all others. Of rows that repeat an id and a text, each counts in ``group_size`` and each is kept or dropped
    like the others. Either table may be empty. Other columns are not read.
    """
    was = cut_lineage(digests(history, id_column, text_column), "digests")
    come = cut_lineage(digests(arrivals, id_column, text_column), "digests")
    known = cut_lineage(_grouped(was), "history")
    parts = part_count(known)
    index = cut_lineage(build_index(known, parts), "index")
    groups = look_up(index, _grouped(come), parts)
    return was.unionByName(come).join(groups, "digest").withColumn("kept", F.col("key") == F.col("keep_key"))
