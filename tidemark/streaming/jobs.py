"""Structured Streaming jobs over the batch operators.

Each micro-batch runs a batch plan, so the pruning and skew handling of the batch operators hold
here too. Outputs are keyed by batch id and overwritten on replay.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator, Sequence
from datetime import date

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues
from pyspark.sql.types import ArrayType, DataType, IntegerType, StructField, StructType

from tidemark.functions.dates import local_day
from tidemark.operators.asof import asof_join
from tidemark.operators.turns import DAILY_LIMIT, RETENTION_DAYS
from tidemark.sources import ingest
from tidemark.sources.contracts import DatasetSpec

#: Groups over which a batch's refused events are spread.
REFUSED_LANES = 64
#: Groups over which the keys of a day are spread; a stream keeps the number it was started with.
KEY_LANES = 256


def ingest_new_files(
    spark: SparkSession, spec: DatasetSpec, source: str, output: str, checkpoint: str
) -> StreamingQuery:
    """Convert files as they arrive.

    The file source reports names it has not seen; the conversion compares size and time with the
    manifest, so a repeated batch converts nothing twice. Rewritten files keep their name and need
    the batch conversion.
    """
    arriving = (
        spark.readStream.format("text").option("pathGlobFilter", "*.csv")
        .option("recursiveFileLookup", str(spec.recursive).lower()).load(source)
    )

    def convert(batch: DataFrame, batch_id: int) -> None:
        if not batch.isEmpty():
            ingest.convert(batch.sparkSession, spec, source, output)

    return (
        arriving.writeStream.foreachBatch(convert).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


class Admission(StatefulProcessor):
    """State per (lane of keys, day): how many events of each key were admitted. It is forgotten once no event of the day can
    come any more.

    A call to the state store costs far more than a row, so the keys of a lane share one value and one timer.
    """

    def __init__(self, limit: int, key: str, key_type: DataType, order: Sequence[str], days: int, names: Sequence[str]):
        self.limit, self.key, self.order, self.days, self.names = limit, key, list(order), days, list(names)
        self.kept = StructType([StructField("keys", ArrayType(key_type)), StructField("counts", ArrayType(IntegerType()))])

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.used = handle.getValueState("used", self.kept)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:  # noqa: N802, N803
        day, out = key[1], Row(*self.names)
        if day is None:  # refused before
            for row in rows:
                yield out(*[row[name] for name in self.names])
            return
        state = self.used.get()
        used = dict(zip(*state, strict=True)) if state else {}
        # Of each key only as many rows are held as may still be admitted; numbers part rows that are equal in all of the order.
        best: dict[object, list[tuple]] = {}
        at, remains, why = None, self.names.index("remaining"), self.names.index("reason")

        def decided(row: Row, remaining: int | None, reason: str | None) -> Row:
            values = [row[i] for i in at]
            values[remains], values[why] = remaining, reason
            return out(*values)

        for number, row in enumerate(rows):
            if at is None:
                places = {name: i for i, name in enumerate(row.__fields__)}
                at, who, order = [places[name] for name in self.names], places[self.key], [places[name] for name in self.order]
            held = best.setdefault(row[who], [])
            bisect.insort(held, ([(row[i] is not None, row[i]) for i in order], number, row))
            if len(held) > self.limit - used.get(row[who], 0):
                yield decided(held.pop()[2], None, "quota")
        for name, held in best.items():
            left = self.limit - used.get(name, 0)
            for place, (_, _, row) in enumerate(held):
                yield decided(row, left - 1 - place, None)
        counts = {name: used.get(name, 0) + len(held) for name, held in best.items() if held}
        if counts:
            counts = used | counts
            self.used.update((list(counts), list(counts.values())))
            if not used:
                midnight = (day - date(1970, 1, 1)).days * 86_400_000
                self.handle.registerTimer(midnight + (self.days + 2) * 86_400_000)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        self.used.clear()
        return iter(())

    def close(self) -> None:
        pass


def admit_daily(
    events: DataFrame, key: str, moment: str, tie: Sequence[str], output: str, checkpoint: str, limit: int = DAILY_LIMIT,
    arrived: str | None = None, disorder: str = "1 day", days: int = RETENTION_DAYS, trigger: dict | None = None,
    lanes: int = KEY_LANES,
) -> StreamingQuery:
    """Decide on every event whether its key still has some of the ``limit`` of its local day, across micro-batches.

    Each batch is one folder below ``output`` with the columns of ``events``, ``usage_day``, ``remaining``, ``reason`` and the
    partition column ``decision`` ("admitted" or "refused"). In a batch the earlier ``moment`` comes first, then ``tie``. What is not admitted has the
    reason "quota", "no key", "no time" (of the event or its arrival), "late" (its day is more than ``days`` before the day of
    its arrival) or "future" (a day after it). So a wrong date neither uses nor renews a quota.

    The clock is ``arrived``, the time at which a row reached the stream (by default that of its batch), and never the time
    in the event: the watermark follows it, and a timer drops the count of a day once no event of it can be admitted. Arrival
    times may be out of order by ``disorder``; Spark drops rows that are further behind, and reports their number.

    The counts of a day are kept in ``lanes`` values, by hash of the key. A batch's rows of one lane and day are in the memory
    of one task; a checkpoint is bound to the number of lanes it was started with.
    """
    spark = events.sparkSession
    clock = F.col(arrived) if arrived else F.current_timestamp()
    day, today = local_day(F.col(moment)), local_day(F.col("__arrived"))
    reason = (
        F.when(F.col(key).isNull(), "no key").when(day.isNull() | today.isNull(), "no time")
        .when(day < F.date_sub(today, days), "late").when(day > today, "future")
    )
    judged = events.withColumn("__arrived", clock.cast("timestamp")).withColumns(
        {"usage_day": day, "remaining": F.lit(None).cast("int"), "reason": reason}
    )
    # Refused rows touch no state: they are spread over lanes of their own.
    refused = F.col("reason").isNotNull()
    lane = F.when(refused, F.pmod(F.xxhash64(*events.columns), F.lit(REFUSED_LANES))).otherwise(F.pmod(F.xxhash64(key), F.lit(lanes)))
    grouped = judged.withWatermark("__arrived", disorder).withColumns(
        {"__lane": lane, "__day": F.when(~refused, F.col("usage_day"))}
    ).groupBy("__lane", "__day")
    schema = judged.drop("__arrived").schema
    names = schema.fieldNames()
    store, provider = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(store)
    decided = grouped.transformWithState(
        Admission(limit, key, events.schema[key].dataType, [moment, *tie], days, names), outputStructType=schema, outputMode="Append", timeMode="EventTime"
    )

    def write(batch: DataFrame, batch_id: int) -> None:
        marked = batch.withColumn("decision", F.when(F.col("reason").isNull(), "admitted").otherwise("refused"))
        marked.write.mode("overwrite").partitionBy("decision").parquet(f"{output}/batch={batch_id}")

    spark.conf.set(store, provider)
    try:
        return (
            decided.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start()
        )
    finally:
        spark.conf.set(store, before)


def enrich_prices(
    prices: DataFrame, snapshots: DataFrame, on: Sequence[str], price_time: str, snapshot_time: str,
    payload: Sequence[str], output: str, checkpoint: str, unit: str | None = "month",
) -> StreamingQuery:
    """Give each arriving price row the newest snapshot visible at its time."""

    def enrich(batch: DataFrame, batch_id: int) -> None:
        joined = asof_join(batch, snapshots, on, price_time, snapshot_time, payload, unit=unit)
        joined.write.mode("overwrite").parquet(f"{output}/batch={batch_id}")

    return (
        prices.writeStream.foreachBatch(enrich).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
