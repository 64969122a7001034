"""Build-and-publish jobs: statements -> periods -> daily table, each checked before it is seen."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import quality
from tidemark.plans.daily import DAILY_COLUMNS, build_daily
from tidemark.plans.metrics import DAILY_METRIC_IDS, pick
from tidemark.plans.periods import PERIOD_COLUMNS, build_periods
from tidemark.session import cut_lineage, tune
from tidemark.sources import files as fs

ROWS_PER_FILE = 2_000_000
PIPELINE_VERSION = 1  # raised when the rules of a build change, so that older tables are built again
ABOUT = "_about"
BUILD_SCHEMA = "symbol string, digest string, version int, run string, rows long"


def _note_version(written: DataFrame, folder: str) -> None:
    about = written.agg(F.count(F.lit(1)).alias("rows"), F.lit(PIPELINE_VERSION).alias("version"))
    about.coalesce(1).write.parquet(f"{folder}/{ABOUT}")


def check_version(spark: SparkSession, table: str) -> list[str]:
    """The newest version of a published table has to come from the rules in force."""
    folder = fs.current(spark, table)
    if folder is None:
        return ["nothing is published"]
    if not any(name == ABOUT for name, _ in fs.children(spark, folder)):
        return ["pipeline version is not noted"]
    found = spark.read.parquet(f"{folder}/{ABOUT}").first()["version"]
    return [] if found == PIPELINE_VERSION else [f"pipeline version {found} is not {PIPELINE_VERSION}"]


def publish_periods(statements: DataFrame, output: str) -> str:
    def check(written: DataFrame) -> list[str]:
        return [*quality.check_periods(written).first()["errors"], *quality.check_columns(written, PERIOD_COLUMNS)]

    return fs.publish(build_periods(statements), f"{output}/financial_period", check, ROWS_PER_FILE, _note_version)


def publish_daily(spark: SparkSession, stocks: DataFrame, output: str) -> str:
    def check(written: DataFrame) -> list[str]:
        report = quality.check_daily(written, pick(DAILY_METRIC_IDS)).first()
        return [*report["errors"], *quality.check_columns(written, DAILY_COLUMNS)]

    tune(spark)
    outdated = check_version(spark, f"{output}/financial_period")
    if outdated:
        raise ValueError(f"financial_period: {'; '.join(outdated)}")
    periods = fs.read_current(spark, f"{output}/financial_period")
    return fs.publish(build_daily(stocks, periods), f"{output}/stock_financial_daily", check, ROWS_PER_FILE, _note_version)


def digests_of(statements: DataFrame) -> DataFrame:
    """(symbol, digest): changes when a row of the company comes, goes or changes.

    Two hashes of every row are added up, so one pass with map-side sums is enough.
    """
    row = [F.col(name) for name in statements.columns]
    added = [F.sum(F.xxhash64(*row, F.lit(salt)).cast("decimal(20,0)")) for salt in (0, 1)]
    return statements.groupBy("symbol").agg(
        F.concat_ws("/", F.count(F.lit(1)).cast("string"), *[total.cast("string") for total in added]).alias("digest")
    )


def digests_of_files(*manifests: DataFrame) -> DataFrame:
    """(symbol, digest) out of ingest manifests, without reading rows: the files of a company and their state."""
    parts = [
        known.select(
            F.col("identity").alias("symbol"),
            F.concat_ws("|", F.lit(str(at)), "file", F.col("length").cast("string"), F.col("modified").cast("string"), "signature").alias("part"),
        )
        for at, known in enumerate(manifests)
    ]
    together = parts[0]
    for part in parts[1:]:
        together = together.unionByName(part)
    return together.groupBy("symbol").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("part")), "\n"), 256).alias("digest"))


def _built(spark: SparkSession, output: str) -> DataFrame:
    folder = fs.current(spark, f"{output}/_manifest/financial_period")
    if folder is None:
        return spark.createDataFrame([], BUILD_SCHEMA)
    return spark.read.schema(BUILD_SCHEMA).parquet(folder)


def refresh_periods(spark: SparkSession, statements: DataFrame, digests: DataFrame, output: str) -> dict:
    """Build the periods of companies whose digest or pipeline version changed; the others keep their rows.

    A company's periods depend on its own statements only. New rows go to a folder of this run; the
    manifest names the run that holds each company's rows, and publishing it is the one atomic step.
    """
    known = _built(spark, output)
    same = known.filter(F.col("version") == PIPELINE_VERSION).select("symbol", "digest")
    due = cut_lineage(digests.filter(F.col("symbol").isNotNull()).join(same, ["symbol", "digest"], "left_anti"), "due")
    gone = known.join(digests, "symbol", "left_anti")
    counts = {"companies_built": due.count(), "companies_gone": gone.count()}
    if not any(counts.values()):
        return counts
    run = uuid.uuid4().hex
    folder = f"{output}/financial_period_runs/run={run}"
    rows = build_periods(statements.join(due.select("symbol"), "symbol", "left_semi"))
    rows.write.option("compression", "zstd").option("maxRecordsPerFile", ROWS_PER_FILE).parquet(folder)
    written = spark.read.schema(rows.schema).parquet(folder)
    errors = quality.check_periods(written).first()["errors"]
    if errors:
        raise ValueError("; ".join(errors))
    made = written.groupBy("symbol").agg(F.count(F.lit(1)).alias("rows"))
    records = due.join(made, "symbol", "left").select(
        "symbol", "digest", F.lit(PIPELINE_VERSION).alias("version"), F.lit(run).alias("run"),
        F.coalesce("rows", F.lit(0)).cast("long").alias("rows"),
    )
    kept = known.join(digests.select("symbol"), "symbol", "left_semi").join(due.select("symbol"), "symbol", "left_anti")
    fs.publish(kept.unionByName(records), f"{output}/_manifest/financial_period")
    return counts


def read_periods(spark: SparkSession, output: str) -> DataFrame:
    """Rows of the runs that the manifest names for their companies."""
    current = _built(spark, output).select("symbol", "run")
    runs = [f"{output}/financial_period_runs/run={row[0]}" for row in current.select("run").distinct().collect()]
    if not runs:
        raise ValueError(f"no periods are built in {output}")
    stored = spark.read.option("basePath", f"{output}/financial_period_runs").parquet(*runs)
    return stored.join(current, ["symbol", "run"], "left_semi").select(*PERIOD_COLUMNS)
