"""Line dedup: lines that many documents share stay in one document only.

Built-in functions only. Lines are exploded once with their position, normalised and hashed; the hashes are counted in
two aggregations, so that a line of a third of all documents is summed up before it meets in one task. Occurrences look the
few commonest lines up in every task and meet the other frequent ones by a join; the dropped ones come back as
positions per document, and the text is put together without them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.text import BLANKS, ascii_lower, fresh, key_of, plain_names, text_of
from tidemark.session import cut_lineage

#: A line is common if its documents are more than one ``PER_TASK``-th of the occurrences that a task reads on average.
PER_TASK = 8


def line_key(line: Column) -> Column:
    """The line without blanks at both ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


@plain_names
def dedup_lines(
    documents: DataFrame, min_chars: int = 40, min_documents: int = 5, id_column: str = "doc_id", text_column: str = "text",
) -> DataFrame:
    """``documents`` with the text changed, and the columns ``n_lines`` and ``n_dropped`` (both long) added.

    A key of at least ``min_chars`` code points found in at least ``min_documents`` different ids loses its lines in all of
    them but the largest. A null or empty text is one empty line and comes back as an empty text. Rows with a null id
    are one document, whose id is below all others. Repeated rows are treated alike; texts of one id are told apart by 96 bits
    of hashes. An empty table gives an empty table. Other columns pass through; a column named ``n_lines`` or ``n_dropped`` is
    replaced.
    """
    n = fresh(documents, "key", "r1", "r2", "text", "lines", "at", "line", "h1", "h2", "keep", "drops")
    key, hashes, row = n["key"], [n["h1"], n["h2"]], [n["key"], n["r1"], n["r2"]]
    rows = documents.drop("n_lines", "n_dropped").withColumns(
        {key: key_of(id_column), n["text"]: text_of(text_column), n["r1"]: F.xxhash64(text_of(text_column)), n["r2"]: F.hash(text_of(text_column))}
    )
    # Keys this short cannot count, and trimming never lengthens a line. Texts are split once; counts and places come out of
    # the table of hashes.
    lines = cut_lineage(
        rows.select(*row, F.posexplode(F.split(n["text"], "\n", -1)).alias(n["at"], n["line"]))
        .where(F.char_length(n["line"]) >= min_chars)
        .select(*row, n["at"], line_key(F.col(n["line"])).alias(n["line"]))
        .where(F.char_length(n["line"]) >= min_chars)
        .select(*row, n["at"], F.xxhash64(n["line"]).alias(n["h1"]), F.hash(n["line"]).alias(n["h2"])),
        "lines",
    )
    frequent = cut_lineage(
        lines.select(*hashes, key).distinct()
        .groupBy(*hashes).agg(F.count("*").alias("documents"), F.max(key).alias(n["keep"]))
        .where(F.col("documents") >= min_documents),
        "frequent",
    )
    # Lines of very many documents: as each has more than a set share of all occurrences, there are less than ``PER_TASK``
    # for each task, and every task can look them up; only the others are dealt out by their hash.
    tasks = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    common = F.col("documents") > lines.count() / (PER_TASK * tasks)
    hot = F.broadcast(frequent.where(common).drop("documents"))
    drops = (
        lines.join(hot, hashes).select(*row, n["at"], n["keep"])
        .unionByName(
            lines.join(hot.select(*hashes), hashes, "left_anti")
            .join(frequent.where(~common).drop("documents"), hashes).select(*row, n["at"], n["keep"])
        )
        .where(F.col(key) != F.col(n["keep"]))
        .groupBy(*row).agg(F.collect_set(n["at"]).alias(n["drops"]))
    )
    split = F.split(n["text"], "\n", -1)
    without = F.array_join(
        F.transform(
            F.array_except(F.sequence(F.lit(0), F.size(n["lines"]) - 1), F.col(n["drops"])),
            lambda at: F.element_at(n["lines"], at + 1),
        ),
        "\n",
    )
    return (
        rows.join(drops, row, "left")
        .withColumn(n["lines"], split)
        .withColumns(
            {
                text_column: F.when(F.col(n["drops"]).isNull(), F.col(n["text"])).otherwise(without),
                "n_lines": F.size(n["lines"]).cast("long"),
                "n_dropped": F.coalesce(F.size(n["drops"]), F.lit(0)).cast("long"),
            }
        )
        .select(*[c for c in documents.columns if c.lower() not in ("n_lines", "n_dropped")], "n_lines", "n_dropped")
    )
