"""Near-duplicate documents by min-max hashing, with every link confirmed on the full sets.

A document's set holds the hashes of its word shingles. Each of 64 permutations gives its smallest and its largest value,
so 128 signature values cost 64 evaluations; four values make a band, 32 bands a signature. Two sets of similarity s share
a band with probability 1 - (1 - s^4)^32: 0.9999999 at 0.8, more above.

Equal sets are one node. Nodes that share a band lie in one bucket, and links are sought in two steps, none of which forms
all pairs of a large group. First every node is compared with one node of each of its buckets, the one that meets most
others, and the links found are joined to components. Then the buckets that still hold several components are searched:
nodes outside the largest component meet all of the bucket, in blocks of bounded size, and only nodes that no link
connects yet are compared. What is left apart in a bucket has been compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.components import components
from tidemark.llm.text import fresh, key_of, text_of
from tidemark.session import cut_lineage

PERMUTATIONS, BAND_VALUES = 64, 4
BANDS = 2 * PERMUTATIONS // BAND_VALUES
#: Nodes of a block that one task compares; a larger bucket is cut into pairs of blocks.
BLOCK = 256
#: Shingles that one step permutes, and words whose hashes a task remembers.
STEP, REMEMBERED = 4096, 500_000
_random = np.random.default_rng(20240229)
_FLIP = _random.integers(0, 2**64, (PERMUTATIONS, 1), np.uint64)
_FACTOR = _random.integers(0, 2**63, (PERMUTATIONS, 1), np.uint64) * np.uint64(2) + np.uint64(1)
_FOLD = _random.integers(0, 2**63, BAND_VALUES, np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sets of shingle hashes: A-Z lower-cased, words between blanks, ``width`` words a shingle."""

    def __init__(self, width: int):
        self.width, self.words = width, {}

    def _hashes(self, words: list[bytes]) -> np.ndarray:
        known = self.words
        if len(known) > REMEMBERED:
            known.clear()
        for word in set(words).difference(known):
            known[word] = xxhash.xxh3_64_intdigest(word)
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))

    def of(self, text: str | None) -> np.ndarray:
        """Sorted distinct hashes; with fewer words than a shingle, the whole sequence is the one; without words, none."""
        words = (text or "").encode().lower().split()  # bytes are split at just the six blanks
        if not words:
            return np.zeros(0, np.uint64)
        hashes = self._hashes(words)
        width = min(self.width, len(words))
        n = len(words) - width + 1
        rolled = np.full(n, width, np.uint64)
        for i in range(width):
            rolled = _mix(rolled + hashes[i : i + n])
        return np.unique(rolled)


def bands(shingles: np.ndarray) -> np.ndarray:
    """One 64-bit key per band."""
    low = np.full(PERMUTATIONS, 2**64 - 1, np.uint64)
    high = np.zeros(PERMUTATIONS, np.uint64)
    for start in range(0, len(shingles), STEP):
        permuted = (shingles[None, start : start + STEP] ^ _FLIP) * _FACTOR
        np.minimum(low, permuted.min(axis=1), out=low)
        np.maximum(high, permuted.max(axis=1), out=high)
    values = np.stack([low, high], axis=1).reshape(BANDS, BAND_VALUES)
    return _mix((_mix(values) * _FOLD).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64))


def node_of(shingles: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingles.tobytes())


def sketch(documents: DataFrame, width: int, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``key``, ``row`` (hash of the text), ``n_shingles``, ``node`` (128 bits that name the set; null if empty), ``bands``."""
    rows = documents.select(key_of(id_column).alias("key"), F.xxhash64(text_of(text_column)).alias("row"), text_of(text_column).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(width)
        for batch in batches:
            sizes, nodes, keys = [], [], []
            for text in batch.column(2):
                shingles = shingler.of(text.as_py())
                sizes.append(len(shingles))
                nodes.append(node_of(shingles) if len(shingles) else None)
                keys.append(bands(shingles).view(np.int64) if len(shingles) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(nodes, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                names=["key", "row", "n_shingles", "node", "bands"],
            )

    return rows.mapInArrow(run, "key long, row long, n_shingles long, node binary, bands array<long>")


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[tuple]]:
    """Rows of sorted batches, one list for each run of equal values in the first ``keys`` columns."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*[column.to_pylist() for column in batch.columns], strict=True):
            if held and row[:keys] != held[0][:keys]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


class _Sets:
    """The sets of a block, laid flat, to compare one set with many."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], np.int64)
        self.sets = sets

    def linked(self, shingles: np.ndarray, among: np.ndarray, percent: int) -> np.ndarray:
        """Those of ``among`` with 100 * intersection >= percent * union."""
        n, sizes = len(shingles), self.sizes[among]
        among = among[(100 * np.minimum(n, sizes) >= percent * np.maximum(n, sizes))]
        if not len(among):
            return among
        sizes = self.sizes[among]
        flat = np.concatenate([self.sets[i] for i in among.tolist()])
        at = np.minimum(np.searchsorted(shingles, flat), n - 1)
        shared = np.add.reduceat((shingles[at] == flat).astype(np.int64), np.cumsum(sizes) - sizes)
        return among[100 * shared >= percent * (n + sizes - shared)]


def _search(width: int, percent: int):
    """Links between the nodes of one group: side 0 against side 1, or within side 2; nodes of one label are not compared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(width)
        for group in _groups(batches, 3):
            rows = []
            for *_, side, node, label, text in group:
                shingles = shingler.of(text)
                rows.append((side, node, label, shingles))
            sets = _Sets([r[3] for r in rows])
            names = {label: i for i, label in enumerate(dict.fromkeys(r[2] for r in rows))}
            labels = np.array([names[r[2]] for r in rows])
            sides = np.array([r[0] for r in rows])
            u, v = [], []
            for i in np.flatnonzero(sides != 1).tolist():
                among = np.flatnonzero(((sides == 1) if sides[i] == 0 else (np.arange(len(rows)) > i)) & (labels != labels[i]))
                for j in sets.linked(rows[i][3], among, percent).tolist():
                    if labels[j] != labels[i]:
                        u.append(rows[i][1])
                        v.append(rows[j][1])
                        labels[labels == labels[j]] = labels[i]
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.binary()), pa.array(v, pa.binary())], names=["u", "v"])

    return run


def _compare(groups: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (u, v) found in ``groups``: a, b, c (names of the group), side, node, label.

    Texts grow with the input, so they are joined by sorting whatever their size, never broadcast.
    """
    rows = groups.join(texts.hint("merge"), "node").select("a", "b", "c", "side", "node", "label", "text")
    dealt = rows.repartition("a", "b", "c").sortWithinPartitions("a", "b", "c", "side", "node")
    return dealt.mapInArrow(_search(width, percent), "u binary, v binary")


def near_duplicates(
    documents: DataFrame, width: int = 5, percent: int = 80, id_column: str = "doc_id", text_column: str = "text",
) -> DataFrame:
    """One row per row of ``documents``: ``key``, ``row``, ``n_shingles``, ``component`` (smallest key reachable), ``lead_row``.

    Rows are linked if 100 * intersection >= percent * union of their shingle sets. Null texts count as empty; a row without
    words has no shingles and is linked with nothing. A null id has the lowest key. Rows that repeat an id and a text come
    out as often as they come in, with one component. ``row`` is a hash of the text and tells apart rows of one id;
    ``lead_row`` is the smallest ``row`` of the component's smallest key.
    """
    sketched = cut_lineage(sketch(documents, width, id_column, text_column), "sketch")
    nodes = (
        sketched.where(F.col("node").isNotNull()).groupBy("node")
        .agg(F.min(F.struct("key", "row")).alias("lead"), F.count("*").alias("copies"), F.first("bands").alias("bands"))
    )
    nodes = cut_lineage(nodes, "nodes")
    placed = nodes.select("node", F.explode("bands").alias("bucket"))
    buckets = placed.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    members = cut_lineage(placed.join(cut_lineage(buckets, "buckets"), "bucket"), "members")
    # A node that meets many others is the likeliest to be near them: the text that copies were made from.
    weights = members.groupBy("node").agg(F.sum(F.col("n") - 1).alias("weight"))
    shapes = members.join(weights, "node").groupBy("bucket", "n").agg(
        F.max_by("node", F.struct("weight", "node")).alias("pivot"), F.bit_xor(F.xxhash64("node")).alias("names")
    )
    # Buckets of the same members count once.
    shapes = cut_lineage(shapes.groupBy("n", "pivot", "names").agg(F.min("bucket").alias("bucket")), "shapes")
    members = cut_lineage(members.join(shapes.select("bucket", "pivot"), "bucket"), "distinct_members")
    wanted = members.select("node").distinct().join(nodes.select("node", "lead"), "node")
    wanted = cut_lineage(wanted.select("node", F.col("lead.key").alias("key"), F.col("lead.row").alias("row")), "wanted")
    texts = documents.select(key_of(id_column).alias("key"), F.xxhash64(text_of(text_column)).alias("row"), text_of(text_column).alias("text"))
    # Rows that repeat an id and a text differ in nothing.
    texts = cut_lineage(texts.join(wanted.hint("merge"), ["key", "row"]).groupBy("node").agg(F.first("text").alias("text")), "texts")

    chunk = F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / BLOCK)).cast("int")
    stars = members.where(F.col("node") != F.col("pivot")).groupBy("pivot", "node").agg(F.max("n").alias("n"))
    stars = stars.withColumn("chunk", chunk)
    star_groups = stars.select(
        F.col("pivot").alias("a"), F.col("chunk").alias("b"), F.col("n").alias("c"), F.lit(1).alias("side"), "node", F.col("node").alias("label")
    ).unionByName(
        stars.select(F.col("pivot").alias("a"), F.col("chunk").alias("b"), F.col("n").alias("c")).distinct()
        .select("a", "b", "c", F.lit(0).alias("side"), F.col("a").alias("node"), F.col("a").alias("label"))
    )
    links = cut_lineage(_compare(star_groups, texts, width, percent), "links")
    labels = cut_lineage(components(links), "labels")

    labelled = members.join(labels, "node", "left").select("bucket", "n", "node", F.coalesce("component", "node").alias("label"))
    labelled = cut_lineage(labelled, "labelled")
    apart = (
        labelled.groupBy("bucket", "label").agg(F.count("*").alias("share"))
        .groupBy("bucket").agg(F.max_by("label", F.struct("share", "label")).alias("major"), F.max("share").alias("most"), F.count("*").alias("labels"))
        .where(F.col("labels") > 1).select("bucket", "major", "most")
    )
    # Those outside the largest component of their bucket meet all of the bucket; within it nothing is left to find.
    opened = labelled.join(cut_lineage(apart, "apart"), "bucket").withColumns(
        {"few": F.ceil((F.col("n") - F.col("most")) / BLOCK).cast("int"), "all": F.ceil(F.col("n") / BLOCK).cast("int")}
    )
    dealt = lambda parts: F.pmod(F.xxhash64("node"), F.col(parts)).cast("int")
    each = lambda parts: F.explode(F.sequence(F.lit(0), F.col(parts) - 1))
    block_groups = (
        opened.where((F.col("all") > 1) & (F.col("label") != F.col("major")))
        .select(F.col("bucket").alias("a"), dealt("few").alias("b"), each("all").alias("c"), F.lit(0).alias("side"), "node", "label")
        .unionByName(
            opened.select(
                F.col("bucket").alias("a"), each("few").alias("b"), dealt("all").alias("c"),
                F.when(F.col("all") > 1, 1).otherwise(2).alias("side"), "node", "label",
            )
        )
    )
    more = _compare(block_groups, texts, width, percent)
    final = components(links.unionByName(more))

    named = nodes.select("node", "lead", "copies").join(final, "node", "left")
    # Only rows of a node with copies or links can have another component than their own key.
    named = cut_lineage(
        named.where((F.col("copies") > 1) | F.col("component").isNotNull()).select("node", F.coalesce("component", "node").alias("label"), "lead"), "named"
    )
    least = cut_lineage(named.groupBy("label").agg(F.min("lead").alias("least")), "components")
    of_node = cut_lineage(named.join(least, "label").select("node", "least"), "of_node")
    return sketched.select("key", "row", "n_shingles", "node").join(of_node, "node", "left").select(
        "key", "row", "n_shingles", F.coalesce("least.key", "key").alias("component"), F.coalesce("least.row", "row").alias("lead_row")
    )


def keep_one(documents: DataFrame, width: int = 5, percent: int = 80, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``documents`` with one row of each group: of the smallest id, and of its texts the one of the smallest hash.

    Of rows that repeat this id and text one stays, whichever has the smallest hash of all columns. Rows without words
    stay; columns and their order are the same.
    """
    found = near_duplicates(documents, width, percent, id_column, text_column).where(F.col("n_shingles") > 0)
    names = fresh(documents, "key", "row", "place")
    pair = [F.col("key").alias(names["key"]), F.col("row").alias(names["row"])]
    lead = (F.col("key") == F.col("component")) & (F.col("row") == F.col("lead_row"))
    # Pairs of id and text that are not to stay, and those that stay once of several times.
    counted = cut_lineage(found.groupBy(*pair, lead.alias("lead")).agg(F.count("*").alias("n")).where(~F.col("lead") | (F.col("n") > 1)), "dropped")
    same = (key_of(id_column) == F.col(names["key"])) & (F.xxhash64(text_of(text_column)) == F.col(names["row"]))
    stays = documents.join(counted.select(names["key"], names["row"]), same, "left_anti")
    repeated = counted.where("lead").select(names["key"], names["row"])
    if repeated.isEmpty():
        return stays
    hashed = [f"`{f.name}`" for f in documents.schema.fields if "map<" not in f.dataType.simpleString()]
    first = Window.partitionBy(names["key"], names["row"]).orderBy(F.xxhash64(*hashed))
    once = documents.join(repeated, same).withColumn(names["place"], F.row_number().over(first)).where(F.col(names["place"]) == 1)
    return stays.unionByName(once.drop(*names.values()))
