"""Mixing sources to target weights by systematic sampling.

Built-in functions only. Every document of a source is expected ``target / size of the source`` times. Documents are put
in a fixed order within their source, the expected copies are summed along it, one offset is added, and a document is
emitted once for every integer that its stretch crosses. The offset is random, turned by the sixteenth that brings the
words taken closest to the target: in a source of few documents one very long text would else decide the sum.

The order is (size class, hash, id). Similar sizes stand together, so the words taken follow the target closely. The
running sum is taken in blocks: within a block, over the blocks of a size class, and over the classes of a source; no
window holds more than a block, so a source with a third of all rows is spread over thousands of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.text import WORD, fresh, key_of, plain_names, text_of
from tidemark.session import cut_lineage

#: Blocks of one size class (a power of two).
BLOCKS = 256
#: Turns of the random offset among which the closest to the target is taken.
TURNS = 16
WEIGHTS = (5.0, 2.0, 1.0)


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = 3.0) -> DataFrame:
    """Targets for a table of one row per source (``source``, ``size``): ``source``, ``size``, ``target``.

    Sources by code point, null last, take the weights in turn; together they share the sum of all sizes. A target stops at
    ``most`` times the source's size, and the excess goes to the others by weight until none is above. The table has one
    row per source; its two orderings run over that table alone, never over documents.
    """
    everywhere = Window.orderBy(F.col("source").asc_nulls_last())
    choices = F.array(*[F.lit(float(weight)) for weight in weights])
    ranked = sizes.withColumns(
        {
            "weight": F.element_at(choices, (F.pmod(F.row_number().over(everywhere) - 1, F.lit(len(weights))) + 1).cast("int")),
            "cap": F.col("size") * F.lit(float(most)),
        }
    )
    # Sources reach their caps in the order of cap / weight. The level at which the rest shares what is left is that of
    # the first source that stays below its cap; targets are min(cap, level * weight).
    filling = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    levels = ranked.withColumns(
        {
            "place": F.row_number().over(filling),
            "left": F.sum("size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
            "weights": F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
        }
    ).withColumn("level", F.col("left") / F.col("weights"))
    below = F.when(F.col("cap") >= F.col("level") * F.col("weight"), F.col("place"))
    first = F.min_by("level", below).over(whole)
    return levels.select("source", "size", F.least("cap", F.coalesce(first, F.lit(0.0)) * F.col("weight")).alias("target"))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


@plain_names
def mix(
    documents: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = 3.0, seed: int = 17,
    id_column: str = "doc_id", text_column: str = "text", source_column: str = "source",
) -> DataFrame:
    """``documents`` with ``size``, ``source_size`` (long), ``target`` (double) and ``copies`` (int) added.

    A size is the number of words of the text; a null or empty text has none. A null source is a source of its own.
    Documents of size 0 take part; a source without words has target 0 and no copies. Null ids order first, rows that
    repeat are documents of their own. Reruns give the same copies. Columns with the added names are replaced.
    """
    added = ("size", "source_size", "target", "copies")
    n = fresh(documents, "source", "class", "block", "hash", "offset", "rank", "rate", "start", "count", "above", "words")
    cls, blk = n["class"], n["block"]
    kept = [c for c in documents.columns if c.lower() not in added]
    rows = (
        documents.select(*[F.col(c) for c in kept])
        .withColumns(
            {
                # The first byte keeps null apart from any text and orders it last.
                n["source"]: F.coalesce(F.concat(F.lit("0"), F.col(source_column).cast("string")), F.lit("1")),
                n["words"]: word_count(text_of(text_column)),
                n["hash"]: F.xxhash64(F.lit(seed), key_of(id_column)),
            }
        )
        .withColumns(
            {
                cls: (F.log2(F.col(n["words"]) + 1) * 8).cast("int"),
                blk: F.pmod(F.shiftright(n["hash"], 64 - BLOCKS.bit_length() + 1), F.lit(BLOCKS)).cast("int"),
            }
        )
    )
    # What the sums need, counted once: the texts are read again only for the result.
    slim = cut_lineage(rows.select(n["source"], cls, blk, n["hash"], id_column, n["words"]), "sizes")
    blocks = slim.groupBy(n["source"], cls, blk).agg(
        F.count("*").alias(n["count"]), F.sum(n["words"]).alias(n["words"])
    )
    classes = blocks.groupBy(n["source"], cls).agg(F.sum(n["count"]).alias(n["count"]), F.sum(n["words"]).alias(n["words"]))
    sources = classes.groupBy(n["source"]).agg(F.sum(n["words"]).alias("size"))
    rates = (
        targets(sources.withColumnRenamed(n["source"], "source"), weights, most)
        .select(
            F.col("source").alias(n["source"]), F.col("size").alias("source_size"), "target",
            F.when(F.col("size") > 0, F.col("target") / F.col("size")).otherwise(F.lit(0.0)).alias(n["rate"]),
            (F.pmod(F.xxhash64(F.lit(seed), F.lit("offset"), F.col("source")), F.lit(2**40)) / F.lit(float(2**40))).alias(n["offset"]),
        )
    )

    def preceding(*keys: str, order: str) -> Column:
        window = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum(n["count"]).over(window), F.lit(0))

    class_starts = classes.select(n["source"], cls, preceding(n["source"], order=cls).alias(n["above"]))
    block_starts = (
        blocks.select(n["source"], cls, blk, preceding(n["source"], cls, order=blk).alias(n["start"]))
        .join(class_starts, [n["source"], cls])
        .join(rates, [n["source"]])
        .withColumn(n["start"], F.col(n["start"]) + F.col(n["above"]))
        .drop(n["above"])
    )
    within = Window.partitionBy(n["source"], cls, blk).orderBy(n["hash"], id_column, n["words"])
    position = F.col(n["start"]) + F.col(n["rank"])

    def copies(offset: Column) -> Column:
        crossed = lambda upto: F.floor(upto * F.col(n["rate"]) + offset)
        return (crossed(position) - crossed(position - 1)).cast("int")

    # Which turn is best depends on sizes alone; it joins the starts of the blocks, so no row is looked up by its source.
    turned = [(F.col(n["offset"]) + F.lit(i / TURNS)) % 1.0 for i in range(TURNS)]
    off_target = [F.struct(F.abs(F.sum(F.col(n["words"]) * copies(u)) - F.first("target")), F.first(u)) for u in turned]
    best = (
        slim.withColumn(n["rank"], F.row_number().over(within))
        .join(block_starts, [n["source"], cls, blk])
        .groupBy(n["source"]).agg(F.least(*off_target).alias("best"))
        .select(n["source"], F.col("best.col2").alias(n["offset"]))
    )
    return (
        rows.withColumn(n["rank"], F.row_number().over(within))
        .join(block_starts.drop(n["offset"]).join(best, [n["source"]]), [n["source"], cls, blk])
        .withColumn("copies", copies(F.col(n["offset"])))
        .withColumnRenamed(n["words"], "size")
        .select(*kept, *added)
    )


def emit(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """One row per copy, with the given columns."""
    return mixed.where(F.col("copies") > 0).select(
        *[F.col(f"`{c}`") for c in columns], F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("__copy")
    ).drop("__copy")
