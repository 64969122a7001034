"""Incremental conversion of vendor files into typed, versioned Parquet tables.

Converted rows are appended as one folder per run. The manifest names, for every source file, the
run that holds its current rows; publishing a new manifest version is the single atomic step. A
run that dies leaves the old manifest and an unreferenced folder behind.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.numeric import any_of
from tidemark.operators.aggregates import tuple_distinct
from tidemark.operators.quality import check_columns, check_table
from tidemark.plans.metrics import MARKET_METRIC_IDS, pick, with_metrics
from tidemark.session import cut_lineage
from tidemark.sources import files as fs
from tidemark.sources import layout, vendor_csv
from tidemark.sources.contracts import DatasetSpec

MANIFEST_SCHEMA = (
    "file string, identity string, length long, modified timestamp, signature string, run string,"
    " rows long, min_date date, max_date date"
)
ROWS_PER_FILE = 5_000_000
EXTRA = {"stock_daily": MARKET_METRIC_IDS}


def output_columns(spec: DatasetSpec) -> list[str]:
    return [*spec.targets, *EXTRA.get(spec.table, ())]


def manifest(spark: SparkSession, spec: DatasetSpec, output: str) -> DataFrame:
    folder = fs.current(spark, f"{output}/_manifest/{spec.table}")
    if folder is None:
        return spark.createDataFrame([], MANIFEST_SCHEMA)
    return spark.read.schema(MANIFEST_SCHEMA).parquet(folder)


def pending_files(files: DataFrame, known: DataFrame, signature: str) -> DataFrame:
    """Files that are new, were changed, or were converted under another contract."""
    same = known.filter(F.col("signature") == signature).select("file", "length", "modified")
    return files.join(same, ["file", "length", "modified"], "left_anti")


def summary(spec: DatasetSpec, records: DataFrame, converted: int, skipped: int) -> dict:
    """Manifest roll-up."""
    total = records.agg(
        F.count(F.lit(1)).alias("file_count"), F.count_distinct("identity").alias("identity_count"),
        F.coalesce(F.sum("rows"), F.lit(0)).alias("row_count"),
        F.min("min_date").alias("min_date"), F.max("max_date").alias("max_date"),
    ).first()
    return {
        "table": spec.table, "signature": spec.signature, **total.asDict(),
        "converted_this_run": converted, "skipped_this_run": skipped,
    }


def convert(
    spark: SparkSession, spec: DatasetSpec, source: str, output: str,
    force: bool = False, limit_files: int | None = None, quoted_breaks: bool = False,
) -> dict:
    """Convert what changed since the last run and publish the new manifest."""
    files = vendor_csv.list_files(spark, spec, source, limit_files)
    known = manifest(spark, spec, output)
    everything = files.count()
    if not everything:
        raise ValueError(f"no CSV files at {source}")
    due = files if force else pending_files(files, known, spec.signature)
    # File names only; Spark's own listing holds as many on the driver.
    due_paths = [row[0] for row in due.select("path").collect()]
    if not due_paths:
        return summary(spec, known, 0, everything)
    headers = cut_lineage(vendor_csv.read_headers(spark, spec, due_paths), "headers")
    report = vendor_csv.inventory(due, headers, spec).first()
    if report["invalid_header_count"]:
        raise ValueError(f"invalid headers: {report['invalid_headers']}")
    # Rows are kept by file; two files of one name clash only where the name is the identity.
    if not spec.identity_from_folder:
        twice = files.groupBy("identity").count().filter(F.col("count") > 1).take(5)
        if twice:
            raise ValueError(f"several files for one identity: {[row[0] for row in twice]}")
    records = _convert_files(spark, spec, due, due_paths, headers, output, quoted_breaks)
    # Records of files that this run has not looked at, or that have left the source, stay.
    merged = known.join(records.select("file"), "file", "left_anti").unionByName(records)
    fs.publish(merged, f"{output}/_manifest/{spec.table}")
    return summary(spec, manifest(spark, spec, output), len(due_paths), everything - len(due_paths)) | {
        "reordered_header_count": report["reordered_header_count"]
    }


def _convert_files(spark, spec, due, paths, headers, output, quoted_breaks) -> DataFrame:
    """Write the rows of the due files in one pass and check what was written; the records of the files."""
    run = uuid.uuid4().hex
    folder = f"{output}/{spec.table}/run={run}"
    scanned = vendor_csv.scan(spark, spec, paths, headers, quoted_breaks)
    # Every line is written, an unusable one with its problem in place of values; its file then fails the checks.
    rows = vendor_csv.typed_rows(spec, scanned, keep_problems=True).join(due.select("path", "file"), "path").drop("path")
    if spec.table in EXTRA:
        rows = with_metrics(rows, pick(EXTRA[spec.table]))
    rows.write.option("compression", "zstd").option("maxRecordsPerFile", ROWS_PER_FILE).parquet(folder)
    written = spark.read.schema(rows.schema).parquet(folder)
    day = F.col(spec.date_column) if spec.date_column else F.lit(None).cast("date")
    stats = written.groupBy("file").agg(
        F.count(F.lit(1)).alias("rows"),
        F.max("problem").alias("problem"),
        F.count_if(any_of(F.col(key).isNull() for key in spec.keys)).alias("null_keys"),
        tuple_distinct(*spec.keys).alias("distinct_keys"),
        F.count_distinct(F.col(spec.identity)).alias("identities"),
        F.min(day).alias("min_date"), F.max(day).alias("max_date"),
    )
    checked = cut_lineage(due.join(stats, "file", "left"), "converted")
    unusable = checked.filter(F.col("problem").isNotNull()).select("file", "problem").take(5)
    if unusable:
        raise ValueError("unusable lines: " + "; ".join(f"{p.file}: {p.problem}" for p in unusable))
    faulty = checked.filter(
        (F.coalesce("rows", F.lit(0)) == 0) | (F.col("null_keys") > 0)
        | (F.col("distinct_keys") != F.col("rows")) | (F.col("identities") != 1)
    ).select("file").take(5)
    if faulty:
        raise ValueError(
            "empty files, or null, duplicate or foreign keys in: " + ", ".join(row.file for row in faulty)
        )
    return checked.select(
        "file", "identity", "length", "modified", F.lit(spec.signature).alias("signature"),
        F.lit(run).alias("run"), "rows", "min_date", "max_date",
    )


def read_table(spark: SparkSession, spec: DatasetSpec, output: str) -> DataFrame:
    """Current rows of a converted table: those of the run the manifest names for their file."""
    current = manifest(spark, spec, output).select("file", "run")
    # Runs that no record names are superseded; a conversion makes one run, so the names are few.
    runs = [f"{output}/{spec.table}/run={row[0]}" for row in current.select("run").distinct().collect()]
    if not runs:
        raise ValueError(f"nothing is converted for {spec.table} in {output}")
    stored = spark.read.option("mergeSchema", "true").option("basePath", f"{output}/{spec.table}").parquet(*runs)
    return stored.join(current, ["file", "run"], "left_semi").select(*output_columns(spec))


def validate(spark: SparkSession, spec: DatasetSpec, output: str) -> dict:
    """Table against manifest and contract."""
    records = manifest(spark, spec, output)
    promised = summary(spec, records, 0, 0)
    rows = read_table(spark, spec, output)
    report = check_table(
        rows, spec.keys, spec.identity, spec.date_column, promised["row_count"], promised["identity_count"]
    ).first().asDict()
    report["errors"] = [*report["errors"], *check_columns(rows, output_columns(spec))]
    stale = records.filter(F.col("signature") != spec.signature).count()
    if stale:
        report["errors"].append(f"{stale} files were converted under another contract")
    return report


def compact(spark: SparkSession, spec: DatasetSpec, output: str) -> str:
    """Rewrite the current rows into few large files along a curve over the keys, and publish them.

    Identity and date both cut the files; ``layout.read_within`` reads those a range needs.
    """
    expected = summary(spec, manifest(spark, spec, output), 0, 0)["row_count"]
    rows = read_table(spark, spec, output)
    def same_count(written: DataFrame) -> list[str]:
        found = written.count()
        return [] if found == expected else [f"row count changed: {expected} != {found}"]

    return layout.publish_along(rows, f"{output}/{spec.table}_compact", spec.keys, same_count, ROWS_PER_FILE)
