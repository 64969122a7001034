"""Vendor CSV files: legacy encodings, preamble lines, per-file headers.

Files are read line by line with Spark's splittable text source, so one huge file is shared by
many tasks. Each line is decoded, split and matched to its own file's header inside the JVM.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators.scans import Running, attach, running
from tidemark.session import cut_lineage
from tidemark.sources.contracts import DatasetSpec, header_error, header_reordered, projection
from tidemark.sources.files import qualified

EXAMPLES = 100
# One cell up to its separator: a quoted text with doubled quotes inside, or anything else.
CELL = '("(?:[^"]++|"")*+"|[^,]*+),'
# What is left of a quoted value, with the quote that closes it.
CLOSING = re.compile(rb'(?:[^"]|"")*+"(?!")')


def plain_path(path: Column) -> Column:
    """One spelling for the paths of different sources: decoded, one slash after the scheme."""
    return F.regexp_replace(F.url_decode(F.regexp_replace(path, "\\+", "%2B")), "^file:/+", "file:/")


def identity_of(spec: DatasetSpec, path: Column) -> Column:
    if spec.identity_from_folder:
        return F.element_at(F.split(path, "/"), -2)
    return F.regexp_extract(path, "([^/]+)\\.[^./]*$", 1)


def list_files(spark: SparkSession, spec: DatasetSpec, source: str, limit: int | None = None) -> DataFrame:
    """(path, file, identity, shard, length, modified) of the CSV files; contents stay unread."""
    root = qualified(spark, source).replace("file:///", "file:/")
    listed = (
        spark.read.format("binaryFile").option("pathGlobFilter", "*.csv")
        .option("recursiveFileLookup", str(spec.recursive).lower()).load(source)
        .select(F.regexp_replace("path", "^file:/+", "file:/").alias("path"), "length", F.col("modificationTime").alias("modified"))
    )
    files = listed.select(
        "path", F.expr(f"substring(path, {len(root) + 2})").alias("file"),
        identity_of(spec, F.col("path")).alias("identity"),
        F.regexp_extract("path", "([^/]+)\\.[^./]*$", 1).alias("shard"), "length", "modified",
    )
    return files.orderBy("path").limit(limit) if limit else files


def _decoded(spec: DatasetSpec, value: pa.Array) -> pa.Array:
    """Lines as text; bytes that the encoding does not know become U+FFFD."""
    if spec.encoding.upper() in ("UTF-8", "UTF8"):
        return value.cast(pa.string()) if value.type != pa.string() else value
    return pa.array([raw.decode(spec.encoding, "replace") for raw in value.cast(pa.binary()).to_pylist()], pa.string())


def _lines(spark: SparkSession, spec: DatasetSpec, paths: Sequence[str]) -> DataFrame:
    """(path, block, n, line): every line, numbered within its block of its file from 0.

    A task reads its blocks one after the other and each from its start, so counting along the batches numbers the
    lines; block 0 holds the first lines of a file.
    """
    raw = spark.read.text(list(paths)).select(
        plain_path(F.col("_metadata.file_path")).alias("path"),
        F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("raw"),
    )

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, n = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            paths, blocks = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            new = np.concatenate([[last != (paths[0], blocks[0])], (paths[1:] != paths[:-1]) | (blocks[1:] != blocks[:-1])])
            at = np.arange(len(paths))
            start = np.maximum.accumulate(np.where(new, at, -n))
            numbers = at - start
            last, n = (paths[-1], blocks[-1]), int(numbers[-1]) + 1
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(numbers), _decoded(spec, batch.column(2))],
                names=["path", "block", "n", "line"],
            )

    return raw.mapInArrow(number, "path string, block long, n long, line string")


def _cells(line: Column) -> Column:
    """Cells of one CSV line; lines without quotes take the cheap way."""
    quoted = F.transform(
        F.regexp_extract_all(F.concat(line, F.lit(",")), F.lit(CELL), F.lit(1)),
        lambda cell: F.when(
            cell.startswith('"'), F.replace(F.regexp_replace(cell, '^"|"$', ""), F.lit('""'), F.lit('"'))
        ).otherwise(cell),
    )
    return F.when(F.contains(line, F.lit('"')), quoted).otherwise(F.split(line, ",", -1))


def read_headers(spark: SparkSession, spec: DatasetSpec, paths: Sequence[str]) -> DataFrame:
    """(path, header) per file: the line after the preamble. A file without such a line has no row."""
    top = _lines(spark, spec, paths).filter((F.col("block") == 0) & (F.col("n") == spec.preamble_lines))
    return top.select("path", _cells(F.regexp_replace("line", "^\\x{FEFF}", "")).alias("header"))


def scan(
    spark: SparkSession, spec: DatasetSpec, paths: Sequence[str], headers: DataFrame | None = None, quoted_breaks: bool = False,
) -> DataFrame:
    """(path, identity, values, problem): one row per data line, values by header name.

    ``problem`` says why a line may not be used: more values than the header, an identity other
    than the file's, or a quote left open by a line break inside a value (such files need ``quoted_breaks``;
    then only a quote that is open at the end of the file is a problem). Blank lines are dropped.
    """
    headers = read_headers(spark, spec, paths) if headers is None else headers
    # By position: a data line may well equal the header or a line above it.
    if quoted_breaks:
        data = quoted_records(spark, spec, paths)
    else:
        quotes = F.length("line") - F.length(F.replace("line", F.lit('"')))
        data = _lines(spark, spec, paths).filter((F.col("block") > 0) | (F.col("n") > spec.preamble_lines)).withColumn("open_quote", quotes % 2 == 1)
    data = attach(data.filter(F.trim("line") != ""), headers, ["path"])
    split = data.select("path", "header", "open_quote", _cells(F.col("line")).alias("cells"))
    by_name = F.map_from_arrays("header", F.transform("header", lambda _, at: F.get("cells", at)))
    problem = F.when(F.col("open_quote"), "quote left open").when(
        F.size("cells") > F.size("header"), "values beyond the header"
    )
    # Generating the row keeps later filters from repeating the map for every column they name.
    row = F.struct("path", by_name.alias("values"), problem.alias("problem"))
    return _judged(spec, split.select(F.inline(F.array(row))))


def _judged(spec: DatasetSpec, rows: DataFrame) -> DataFrame:
    known = F.array(*[F.lit(name) for name in spec.known_sources])
    filled = F.exists(
        F.map_values(F.map_filter("values", lambda name, _: F.array_contains(known, name))),
        lambda cell: F.trim(F.coalesce(cell, F.lit(""))) != "",
    )
    identity = identity_of(spec, F.col("path"))
    source = next(c.source for c in spec.columns if c.target == spec.identity)
    told = F.regexp_replace(F.coalesce(F.try_element_at("values", F.lit(source)), F.lit("")), "^\\s+|\\s+$", "")
    wrong = F.when(told != identity, F.lit("identity does not match the file"))
    return rows.filter(filled | F.col("problem").isNotNull()).select(
        "path", identity.alias("identity"), "values", F.coalesce("problem", wrong).alias("problem")
    )


def _ends_inside(line: bytes, inside: bool) -> bool:
    """Whether a quoted value is still open at the end of the line; ``inside``: one was open before it."""
    at = 0
    while True:
        if inside or line[at : at + 1] == b'"':
            closed = CLOSING.match(line, at if inside else at + 1)
            if not closed:
                return True
            at, inside = closed.end(), False
        at = line.find(b",", at) + 1
        if not at:
            return False


def _quoted_lines(spark: SparkSession, spec: DatasetSpec, paths: Sequence[str]) -> DataFrame:
    """(path, block, n, line, starts, ends): every line, and whether a quoted value is open where it starts and ends.

    A task can't know whether its block of a file starts inside a quoted value, so it follows both cases. A block is then a
    function on two states: constant, the same, or swapped. These functions, one row per block, are run through in the order
    of each file, and their results choose the case for each line. Lines end with \\n or \\r\\n.
    """
    raw = spark.read.option("lineSep", "\n").text(list(paths)).select(
        plain_path(F.col("_metadata.file_path")).alias("path"),
        F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("raw"),
    )
    preamble = spec.preamble_lines

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, n, states = None, 0, (False, True)
        for batch in batches:
            numbers, cases = [], []
            for path, block, line in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if (path, block) != last:
                    last, n, states = (path, block), 0, (False, True)
                before = states
                # Lines before the header are no records.
                if b'"' in line and (block or n >= preamble):
                    states = tuple(_ends_inside(line, state) for state in before)
                numbers.append(n)
                cases.append((*before, *states))
                n += 1
            marks = [pa.array(c, pa.bool_()) for c in (zip(*cases, strict=True) if cases else ([],) * 4)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(numbers, pa.int64()), _decoded(spec, batch.column(2)), *marks],
                names=["path", "block", "n", "line", "starts_out", "starts_in", "ends_out", "ends_in"],
            )

    marked = raw.mapInArrow(follow, "path string, block long, n long, line string, starts_out boolean, starts_in boolean, ends_out boolean, ends_in boolean")
    blocks = marked.groupBy("path", "block").agg(F.max_by(F.struct("ends_out", "ends_in"), "n").alias("f"))
    constant, swaps = F.col("f.ends_out") == F.col("f.ends_in"), (F.col("f.ends_out") & ~F.col("f.ends_in")).cast("int")
    in_file = Window.partitionBy("path").orderBy("block")
    before = in_file.rowsBetween(Window.unboundedPreceding, -1)
    counted = blocks.withColumn("swaps", F.sum(swaps).over(in_file))
    fixed = F.when(constant, F.struct(F.col("f.ends_out").alias("state"), F.col("swaps").alias("at")))
    known = F.last(fixed, ignorenulls=True).over(before)
    since = F.coalesce(F.max("swaps").over(before), F.lit(0)) - F.coalesce(known["at"], F.lit(0))
    inside = counted.select("path", "block", (F.coalesce(known["state"], F.lit(False)).cast("int") + since).alias("state")).filter(F.col("state") % 2 == 1)
    opened = attach(marked, cut_lineage(inside.select("path", "block", F.lit(True).alias("opened")), "opened"), ["path", "block"])
    pick = lambda name: F.when(F.coalesce("opened", F.lit(False)), F.col(f"{name}_in")).otherwise(F.col(f"{name}_out"))
    return opened.select("path", "block", "n", "line", pick("starts").alias("starts"), pick("ends").alias("ends"))


def quoted_records(spark: SparkSession, spec: DatasetSpec, paths: Sequence[str]) -> DataFrame:
    """(path, line, open_quote): one row per record after the header, line breaks inside quotes kept.

    A huge file is read by many tasks. Records of one line, nearly all, are not moved; only the lines of the others meet.
    """
    lines = _quoted_lines(spark, spec, paths).filter((F.col("block") > 0) | (F.col("n") > spec.preamble_lines))
    alone = lines.filter(~F.col("starts") & ~F.col("ends")).select("path", "line", F.lit(False).alias("open_quote"))
    parts = lines.filter(F.col("starts") | F.col("ends"))
    # The number of a record in its file is that of the records begun so far.
    numbered = running(parts, ["path"], ["block", "n"], F.col("block"), {"record": Running("sum", (~F.col("starts")).cast("long"))})
    joined = numbered.groupBy("path", "record").agg(F.array_sort(F.collect_list(F.struct("block", "n", "line", "ends"))).alias("lines")).select(
        "path", F.array_join("lines.line", "\n").alias("line"), F.element_at("lines", -1)["ends"].alias("open_quote")
    )
    whole = alone.unionByName(joined)
    return whole.withColumn("line", F.regexp_replace("line", "\r$", ""))


def typed_rows(spec: DatasetSpec, scanned: DataFrame, strict: bool = True, keep_problems: bool = False) -> DataFrame:
    """Contract columns of the usable lines, with the file they came from.

    With ``keep_problems`` unusable lines come too, with their problem and without values.
    """
    if not keep_problems:
        return scanned.filter(F.col("problem").isNull()).select("path", *projection(spec, F.col("values"), strict))
    values = F.when(F.col("problem").isNull(), F.col("values")).otherwise(F.create_map().cast("map<string,string>"))
    return scanned.withColumn("values", values).select("path", "problem", *projection(spec, F.col("values"), strict))


def malformed(spec: DatasetSpec, scanned: DataFrame) -> DataFrame:
    """Lines with a value that does not fit its type, for a quarantine table."""
    usable = scanned.filter(F.col("problem").isNull())
    bad = F.lit(False)
    for column in spec.columns:
        raw = F.trim(F.coalesce(F.try_element_at(F.col("values"), F.lit(column.source)), F.lit("")))
        fits = projection(spec, F.col("values"), strict=False)[spec.targets.index(column.target)]
        bad = bad | ((raw != "") & fits.isNull())
    return usable.filter(bad).select("path", "identity", "values")


def inventory(files: DataFrame, headers: DataFrame, spec: DatasetSpec) -> DataFrame:
    """One row: counts, bytes, newest change, faulty and reordered headers, duplicate shards."""
    seen = attach(files, headers.select("path", "header"), ["path"]).withColumn(
        "header", F.coalesce("header", F.array().cast("array<string>"))
    )
    judged = seen.withColumn("error", header_error(spec, F.col("header"))).withColumn(
        "reordered", F.col("error").isNull() & header_reordered(spec, F.col("header"))
    )
    judged = cut_lineage(judged, "headers")

    def examples(flag: Column, value: Column) -> Column:
        # The first few are cut in every task; only they meet.
        first = judged.filter(flag).select(value.alias("e")).orderBy("e").limit(EXAMPLES)
        return first.agg(F.array_sort(F.collect_list("e"))).scalar()

    twice = files.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
    shown = files.join(twice.orderBy("shard").limit(EXAMPLES).select("shard"), "shard", "left_semi")
    of_shard = shown.groupBy("shard").agg(F.array_sort(F.collect_list("file")).alias("files"))
    return judged.agg(
        F.lit(spec.table).alias("table"),
        F.count(F.lit(1)).alias("file_count"),
        F.count_distinct("identity").alias("identity_count"),
        F.sum("length").alias("total_bytes"),
        F.max("modified").alias("latest_change"),
        F.lit(len(spec.columns)).alias("expected_column_count"),
        F.count("error").alias("invalid_header_count"),
        F.count_if("reordered").alias("reordered_header_count"),
    ).withColumns(
        {
            "invalid_headers": examples(
                F.col("error").isNotNull(), F.struct("file", "error", F.size("header").alias("columns"))
            ),
            "reordered_headers": examples(F.col("reordered"), F.col("file")),
            "duplicate_shard_count": twice.agg(F.count(F.lit(1))).scalar(),
            "duplicate_shards": of_shard.agg(F.array_sort(F.collect_list(F.struct("shard", "files")))).scalar(),
        }
    )
