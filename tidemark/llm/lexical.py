"""Exact ranked search over bit-sliced Bloom signatures.

The index holds documents in blocks of like size. A document's signature is a Bloom filter over its terms and, with another
salt, over the terms that occur 2, 4, 8, ... times in it; a block keeps the signatures by slice: one bitmap over its
documents per bit. The slices of a term, joined by AND, name every document that holds it and a few that don't. Their sums,
weighted by what each level of occurrences adds to a document of that length at most, are upper bounds of all scores of the
block. What the blocks' best bounds score exactly gives a floor under each item's k-th best score, and only documents whose
bound reaches the floor are read and scored again, exactly; every other one is provably below.

Spark reads the texts where they lie, once for the index and once for each of the two exact steps, where it joins them with
the few documents that are asked for (sent to all tasks only if Spark finds them small). Items are taken in blocks of a
bounded number of terms; nothing else passes through the driver.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from tidemark.llm.text import ascii_lower, id_of, key_of, text_of
from tidemark.session import cut_lineage, scratch_path

#: A term is a longest stretch of ASCII letters and digits and of characters beyond ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Bits of a signature per key at least (twice that at most), and bits set by a key.
BITS, HASHES = 10, 4
#: Bits and documents of a block at most (but eight documents always fit).
BLOCK_BITS, BLOCK_ROWS = 1 << 23, 8192
#: Bytes of text that are split at once, and distinct terms counted before they are handed on.
PASS_BYTES, KEPT_TERMS = 4_000_000, 400_000
#: Terms of the items that are searched for together, and those unpacked at once.
ASKED_TERMS, UNPACKED = 100_000, 1024
INDEX = "term string, df long, width int, n_rows int, n_words long, keys binary, hashes binary, lengths binary, texts binary, slices binary"
_LETTERS = bytes(b if chr(b).isalnum() or b >= 0x80 else 32 for b in range(256)).lower()
_LEVEL = np.uint64(0x9E3779B97F4A7C15)


def terms_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_LETTERS).split()


def _mixed(values: np.ndarray, level: int) -> np.ndarray:
    """Splitmix64 of each value, another one for each level."""
    with np.errstate(over="ignore"):
        x = values + _LEVEL * np.uint64(level + 1)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _positions(mixed: np.ndarray, width: int) -> np.ndarray:
    """The bits of each key in a signature of ``width`` (a power of two) bits: one row per key."""
    low, high = (mixed & np.uint64(0xFFFFFFFF)).astype(np.int64), (mixed >> np.uint64(32)).astype(np.int64) | 1
    return (low[:, None] + high[:, None] * np.arange(HASHES)) & (width - 1)


def _hash(term: bytes) -> int:
    return xxhash.xxh3_64_intdigest(term)


class Slices:
    """A block in the making: documents of one signature width."""

    def __init__(self, width: int):
        self.width, self.most = width, max(min(BLOCK_BITS // width, BLOCK_ROWS) & ~7, 8)
        self.used, self.names = 0, []
        self.packed = np.zeros((width, self.most // 8), np.uint8)

    def add(self, names: list[tuple[int, int, int, bytes]], rows: np.ndarray, positions: np.ndarray) -> None:
        """Documents (key, hash, length, digest of the text) and the bits of their keys; rows count from 0."""
        rows = rows + self.used
        flat = self.packed.reshape(-1)
        at = positions * self.packed.shape[1] + (rows >> 3)[:, None]
        for bit in range(8):
            mine = at[(rows & 7) == bit].ravel()
            flat[mine] |= np.uint8(128 >> bit)  # equal places get the same value
        self.used += len(names)
        self.names += names

    def row(self) -> tuple:
        numbers = np.array([name[:3] for name in self.names], np.int64).T
        packed = np.ascontiguousarray(self.packed[:, : -(-self.used // 8)])
        return (
            None, None, self.width, self.used, int(numbers[2].sum()), numbers[0].tobytes(), numbers[1].tobytes(), numbers[2].tobytes(),
            b"".join(name[3] for name in self.names), packed.tobytes(),
        )


class Indexer:
    def __init__(self):
        self.open: dict[int, Slices] = {}
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.hashes, self.df = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def counts(self) -> list[tuple]:
        """Terms met so far with the number of their documents; forgets them."""
        out = [(term.decode(), n, *[None] * 8) for term, n in zip(self.known, self.df.tolist(), strict=True)]
        self.forget()
        return out

    def add(self, keys: list[int], hashes: list[int], texts: list[bytes | None]) -> Iterator[tuple]:
        known, split = self.known, [terms_of(text) for text in texts]
        sizes = np.fromiter(map(len, split), np.int64, len(split))
        before = len(known)
        codes = np.fromiter((known.setdefault(t, len(known)) for terms in split for t in terms), np.int64, int(sizes.sum()))
        new = [_hash(term) for term in islice(known, before, None)]
        self.hashes = np.concatenate([self.hashes, np.array(new, np.uint64)])
        pairs, tf = np.unique(np.repeat(np.arange(len(split)), sizes) * max(len(known), 1) + codes, return_counts=True)
        rows, codes = np.divmod(pairs, max(len(known), 1))
        self.df = np.concatenate([self.df, np.zeros(len(new), np.int64)]) + np.bincount(codes, minlength=len(known))
        levels = np.frexp(tf)[1] - 1  # the largest power of two that tf reaches
        owners, keyed = [], []
        for level in range(int(levels.max(initial=-1)) + 1):
            held = levels >= level
            owners.append(rows[held])
            keyed.append(_mixed(self.hashes[codes[held]], level))
        if not owners:
            return
        owners, keyed = np.concatenate(owners), np.concatenate(keyed)
        order = np.argsort(owners, kind="stable")
        owners, keyed = owners[order], keyed[order]
        n_keys = np.bincount(owners, minlength=len(split))
        widths = np.where(n_keys > 0, 1 << np.maximum(np.ceil(np.log2(np.maximum(n_keys * BITS, 1))).astype(np.int64), 6), 0)
        ends = np.cumsum(n_keys)
        for width in np.unique(widths[widths > 0]).tolist():
            mine, start = np.flatnonzero(widths == width), 0
            while start < len(mine):
                block = self.open.setdefault(width, Slices(width))
                part = mine[start : start + block.most - block.used]
                inside = np.concatenate([np.arange(ends[i] - n_keys[i], ends[i]) for i in part.tolist()])
                names = [(keys[i], hashes[i], int(sizes[i]), hashlib.blake2b(texts[i], digest_size=16).digest()) for i in part.tolist()]
                block.add(names, np.repeat(np.arange(len(part)), n_keys[part]), _positions(keyed[inside], width))
                start += len(part)
                if block.used == block.most:
                    yield self.open.pop(width).row()


def _arrays(rows: list[tuple]) -> list[pa.Array]:
    kinds = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 5]
    return [pa.array(column, kind) for column, kind in zip(zip(*rows, strict=True), kinds, strict=True)]


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


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    indexer, names = Indexer(), [part.split()[0] for part in INDEX.split(", ")]
    for batch in batches:
        for start, end in _passes(pc.binary_length(batch.column(2)).to_pylist()):
            part = batch.slice(start, end - start)
            keys, hashes, texts = part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).cast(pa.binary()).to_pylist()
            for row in indexer.add(keys, hashes, texts):
                yield pa.RecordBatch.from_arrays(_arrays([row]), names=names)
            if len(indexer.known) > KEPT_TERMS:
                yield pa.RecordBatch.from_arrays(_arrays(indexer.counts()), names=names)
    for block in indexer.open.values():
        yield pa.RecordBatch.from_arrays(_arrays([block.row()]), names=names)
    if indexer.known:
        yield pa.RecordBatch.from_arrays(_arrays(indexer.counts()), names=names)


def _named(documents: DataFrame, id_column: str, text_column: str) -> DataFrame:
    return documents.select(key_of(id_column).alias("key"), F.xxhash64(text_of(text_column)).alias("hash"), text_of(text_column).alias("text"))


def build_index(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Blocks of signatures (``term`` is null) and parts of the document counts of terms, as a table in the shared folder.

    Documents without a term (null and empty texts too) are in no block; repeated rows and null ids are documents of their own.
    """
    return cut_lineage(_named(documents, id_column, text_column).mapInArrow(_index, INDEX), "signatures")


@dataclass(frozen=True)
class Asked:
    """Items searched for together: their terms, the weights of these (repeats counted), and the corpus counts."""

    terms: list[bytes]
    places: list[np.ndarray]
    weights: list[np.ndarray]
    documents: int
    words: int

    def damping(self, lengths: np.ndarray) -> np.ndarray:
        return 25 + 75 * lengths * self.documents // self.words

    def score(self, item: int, counts: Counter, length: int) -> int:
        m, total = 25 + 75 * length * self.documents // self.words, 0
        for place, weight in zip(self.places[item].tolist(), self.weights[item].tolist(), strict=True):
            tf = counts.get(self.terms[place], 0)
            if tf:
                total += weight * (1_000_000_000 * tf // (1000 * tf + 8 * m))
        return total

    def bounds(self, block: dict) -> np.ndarray:
        """Upper bounds of the scores: one row per item, one column per document of the block."""
        n, width = block["n_rows"], block["width"]
        slices = np.frombuffer(block["slices"], np.uint8).reshape(width, -1)
        lengths = np.frombuffer(block["lengths"], np.int64)
        m, hashes = self.damping(lengths), np.array([_hash(t) for t in self.terms], np.uint64)
        total, reached, level = np.zeros((len(self.places), n), np.int64), np.zeros(n, np.int64), 0
        while 1 << level <= int(lengths.max(initial=0)):
            at = _positions(_mixed(hashes, level), width)
            held = slices[at[:, 0]]
            for i in range(1, HASHES):
                held &= slices[at[:, i]]
            anywhere = held.any(axis=1)
            if not anywhere.any():
                break
            # The most occurrences at this level, and what they add to those of the level below.
            most = np.minimum((2 << level) - 1, lengths) if level else np.ones(n, np.int64)
            now = 1_000_000_000 * most // (1000 * most + 8 * m)
            step, reached = np.maximum(now - reached, 0), np.maximum(now, reached)
            for item, (places, weights) in enumerate(zip(self.places, self.weights, strict=True)):
                seen = anywhere[places]
                places, weights = places[seen], weights[seen].astype(np.float64)
                for start in range(0, len(places), UNPACKED):
                    part = slice(start, start + UNPACKED)
                    # Sums of integers below 2 ** 53 are exact.
                    sums = weights[part] @ np.unpackbits(held[places[part]], axis=1, count=n).astype(np.float64)
                    total[item] += sums.astype(np.int64) * step
            level += 1
        return total


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for at in range(batch.num_rows):
            yield batch.slice(at, 1).to_pylist()[0]


def _seeds(asked: Asked, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The best k bounds of each item in this task."""
        n = len(asked.places)
        best = np.zeros((n, 0), np.int64)
        keys, hashes = best, best
        for block in _blocks(batches):
            own, names = asked.bounds(block), (np.frombuffer(block["keys"], np.int64), np.frombuffer(block["hashes"], np.int64))
            best = np.concatenate([best, own], axis=1)
            keys, hashes = (np.concatenate([old, np.broadcast_to(new, own.shape)], axis=1) for old, new in zip((keys, hashes), names, strict=True))
            if best.shape[1] > k:
                top = np.argpartition(-best, k - 1, axis=1)[:, :k]
                best, keys, hashes = (np.take_along_axis(x, top, axis=1) for x in (best, keys, hashes))
        rows, columns = np.nonzero(best > 0)
        yield pa.RecordBatch.from_arrays(
            [pa.array(rows, pa.int32()), *[pa.array(x[rows, columns]) for x in (keys, hashes, best)]], names=["item", "key", "hash", "bound"]
        )

    return run


def _reaching(asked: Asked, floors: np.ndarray, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Documents whose bound reaches the floor; of equal texts in a block the k smallest ids, which rank before the others."""
        for block in _blocks(batches):
            bounds, keys, hashes = asked.bounds(block), np.frombuffer(block["keys"], np.int64), np.frombuffer(block["hashes"], np.int64)
            texts = np.frombuffer(block["texts"], np.dtype("V16"))
            copies = np.unique(texts, return_inverse=True)[1]
            rows, columns = np.nonzero(bounds >= floors[:, None])
            order = np.lexsort((keys[columns], copies[columns], rows))
            rows, columns = rows[order], columns[order]
            first = np.ones(len(rows), bool)
            first[1:] = (rows[1:] != rows[:-1]) | (copies[columns[1:]] != copies[columns[:-1]])
            starts = np.flatnonzero(first)
            place = np.arange(len(rows)) - np.repeat(starts, np.diff([*starts, len(rows)]))
            rows, columns = rows[place < k], columns[place < k]
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows, pa.int32()), pa.array(keys[columns]), pa.array(hashes[columns]), pa.array([texts[c].tobytes() for c in columns.tolist()], pa.binary())],
                names=["item", "key", "hash", "copy"],
            )

    return run


def _scores(asked: Asked):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end in _passes(pc.binary_length(batch.column(1)).to_pylist()):
                out = []
                part = batch.slice(start, end - start)
                for key, text, items in zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist(), part.column(2).to_pylist(), strict=True):
                    terms = terms_of(text)
                    counts = Counter(terms)
                    out += [(item, key, asked.score(item, counts, len(terms))) for item in items]
                columns = zip(*out, strict=True) if out else ([], [], [])
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["item", "key", "score"])

    return run


def weights(index: DataFrame, items: DataFrame, id_column: str = "item_id", text_column: str = "text") -> DataFrame:
    """``item``, ``text`` (a hash), ``term`` and ``weight``: floor(1000 * ln((2N + 2) / (2df + 1))) times the repeats of the term.

    A repeated row of ``items`` counts once; rows of one id with different texts are items of their own. Terms that no
    document holds are left out.
    """
    known = index.where(F.col("term").isNull()).agg(F.sum("n_rows").alias("n"))
    frequency = index.where(F.col("term").isNotNull()).groupBy("term").agg(F.sum("df").alias("df"))
    listed = items.select(key_of(id_column).alias("item"), text_of(text_column).alias("text")).dropDuplicates(["item", "text"])
    each = listed.select("item", F.xxhash64("text").alias("text"), F.explode(F.regexp_extract_all(ascii_lower(F.col("text")), F.lit(TERM), F.lit(0))).alias("term"))
    counted = each.groupBy("item", "text", "term").agg(F.count("*").alias("times"))
    weight: Column = F.floor(1000 * F.ln((2 * known.scalar() + 2) / (2 * F.col("df") + 1)))
    return counted.join(frequency, "term").select("item", "text", "term", (F.col("times") * weight).alias("weight"))


def _asked(rows: list[Row], documents: int, words: int) -> Asked:
    terms: dict[str, int] = {}
    for row in rows:
        for term, _ in row.terms:
            terms.setdefault(term, len(terms))
    return Asked(
        [t.encode() for t in terms], [np.array([terms[t] for t, _ in row.terms], np.int64) for row in rows],
        [np.array([w for _, w in row.terms], np.int64) for row in rows], documents, words,
    )


def search(
    index: DataFrame, documents: DataFrame, items: DataFrame, k: int = 10, id_column: str = "doc_id", text_column: str = "text",
    item_column: str = "item_id", item_text_column: str = "text",
) -> DataFrame:
    """``item_id``, ``rank`` (from 1), ``doc_id``, ``score``: the best k documents with a score above 0, ties to the smaller id.

    ``index`` comes from ``build_index(documents)``. A null id orders first. Items without a term that some document holds,
    and empty tables, give no rows. Rows of ``documents`` with equal id and text rank one after the other.
    """
    spark = documents.sparkSession
    blocks = index.where(F.col("term").isNull())
    total = blocks.agg(F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n"), F.coalesce(F.sum("n_words"), F.lit(0)).alias("words")).first()
    per_item = weights(index, items, item_column, item_text_column).groupBy("item", "text").agg(F.sort_array(F.collect_list(F.struct("term", "weight"))).alias("terms"))
    texts, path = _named(documents, id_column, text_column), scratch_path(spark, "hits")

    def exact(wanted: DataFrame, asked: Asked, label: str) -> DataFrame:
        """Scores of the wanted (item, key, hash); the table's size tells Spark whether every task may get it."""
        per_text = cut_lineage(wanted.groupBy("key", "hash").agg(F.collect_set("item").alias("items")), label)
        return texts.join(per_text, ["key", "hash"]).select("key", "text", "items").mapInArrow(_scores(asked), "item int, key long, score long")

    def find(rows: list[Row]) -> None:
        asked = _asked(rows, total.n, total.words)
        first = blocks.mapInArrow(_seeds(asked, k), "item int, key long, hash long, bound long")
        by_bound = Window.partitionBy("item").orderBy(F.col("bound").desc(), "key", "hash")
        seeds = first.withColumn("place", F.row_number().over(by_bound)).where(F.col("place") <= k)
        floors = np.ones(len(rows), np.int64)
        by_score = Window.partitionBy("item").orderBy(F.col("score").desc(), "key")
        scored = exact(seeds, asked, "seeds").withColumn("place", F.row_number().over(by_score)).where(F.col("place") == k)
        for row in scored.collect():  # one number per item of the block
            floors[row.item] = max(row.score, 1)
        reaching = blocks.mapInArrow(_reaching(asked, floors, k), "item int, key long, hash long, copy binary")
        of_text = Window.partitionBy("item", "copy").orderBy("key")
        wanted = reaching.withColumn("place", F.row_number().over(of_text)).where(F.col("place") <= k)
        ranked = exact(wanted, asked, "candidates").where(F.col("score") > 0).withColumn("rank", F.row_number().over(by_score))
        names = spark.createDataFrame([(i, row.item) for i, row in enumerate(rows)], "item int, item_key long")
        ranked.where(F.col("rank") <= k).join(F.broadcast(names), "item").select("item_key", "rank", "key", "score").write.mode("append").parquet(path)

    held, size = [], 0
    for row in per_item.toLocalIterator():
        if held and size + len(row.terms) > ASKED_TERMS:
            find(held)
            held, size = [], 0
        held.append(row)
        size += len(row.terms)
    if held:
        find(held)
    schema = "item_key long, rank int, key long, score long"
    found = spark.read.schema(schema).parquet(path) if held else spark.createDataFrame([], schema)
    return found.select(id_of("item_key").alias("item_id"), "rank", id_of("key").alias("doc_id"), "score")


def ranked_search(documents: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """``build_index`` and ``search`` over the same documents."""
    return search(build_index(documents), documents, items, k)
