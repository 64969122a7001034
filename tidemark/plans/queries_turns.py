"""Registered queries: conversation budgets, retention, quotas, and the streaming jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import turns
from tidemark.plans.queries_market import ASOF_SQL
from tidemark.plans.registry import query
from tidemark.session import scratch_path, table
from tidemark.streaming import jobs

TOKENS = """t as (select conv_id, turn, role, text,
 cast(len(regexp_replace(text, '[\\x00-\\x7F]', '', 'g'))
  + (len(text) - len(regexp_replace(text, '[\\x00-\\x7F]', '', 'g')) + 3) // 4 as bigint) as tokens from conversations)"""
TRIGGER, BUDGET, PROTECTED = 600, 300, 2


def _turns(spark, sf):
    return turns.with_tokens(table(spark, sf, "conversations"), "text").withColumn("tokens", F.col("tokens").cast("long"))


@query("turn_tokens", f"with {TOKENS} select conv_id, turn, tokens from t")
def turn_tokens(spark, sf):
    return _turns(spark, sf).select("conv_id", "turn", "tokens")


@query(
    "conversations_over_budget",
    f"""with {TOKENS} select conv_id, sum(tokens)::bigint as total_tokens, count(*) as turn_count from t group by 1
 having sum(tokens) >= {TRIGGER} and count(*) > {PROTECTED}""",
)
def over_budget(spark, sf):
    return turns.over_budget(_turns(spark, sf), "conv_id", TRIGGER, PROTECTED)


@query(
    "summary_batches",
    f"""with {TOKENS}, o as (select conv_id from t group by 1 having sum(tokens) >= {TRIGGER} and count(*) > {PROTECTED}),
 c as (select * from t where conv_id in (select conv_id from o)
  qualify row_number() over (partition by conv_id order by turn desc) > {PROTECTED}),
 b as (select conv_id, turn, tokens, coalesce(sum(tokens) over (partition by conv_id order by turn
  rows between unbounded preceding and 1 preceding), 0)::bigint as tokens_before from c)
 select * from b where tokens_before < {BUDGET}""",
)
def summary_batches(spark, sf):
    batch = turns.summary_batch(_turns(spark, sf), "conv_id", "turn", TRIGGER, BUDGET, PROTECTED)
    return batch.select("conv_id", "turn", "tokens", "tokens_before")


@query(
    "recent_turns",
    """select conv_id, turn, role, left(text, 240) as excerpt from conversations
 qualify row_number() over (partition by conv_id order by turn desc) <= 6""",
)
def recent_turns(spark, sf):
    recent = turns.recent_context(table(spark, sf, "conversations"), "conv_id", "turn", "text")
    return recent.select("conv_id", "turn", "role", "excerpt")


@query(
    "latest_answer",
    """select conv_id, turn, len(text) as size from conversations where role = 'assistant' and text <> ''
 qualify row_number() over (partition by conv_id order by turn desc) = 1""",
)
def latest_answer(spark, sf):
    rows = table(spark, sf, "conversations").select("conv_id", "turn", "role", F.length("text").alias("size"))
    usable = (F.col("role") == "assistant") & (F.col("size") > 0)
    return turns.latest_result(rows, "conv_id", ["turn"], usable).select("conv_id", "turn", "size")


@query(
    "newest_items_per_owner",
    """with c as (select * from events qualify row_number() over (partition by user_id, event_type order by ts desc, event_id desc) = 1)
 select user_id, event_type, event_id, ts from c
 qualify row_number() over (partition by user_id order by ts desc, event_id desc, event_type) <= 3""",
)
def newest_items(spark, sf):
    events = table(spark, sf, "events").select("user_id", "event_type", "event_id", "ts")
    return turns.keep_newest(events, "user_id", "event_type", ["ts", "event_id"], 3)


@query(
    "last_write_per_key",
    """select user_id, event_type, event_id, value from events
 qualify row_number() over (partition by user_id, event_type order by ts desc, event_id desc) = 1""",
)
def last_write(spark, sf):
    written = turns.latest_wins(table(spark, sf, "events"), ["user_id", "event_type"], ["ts", "event_id"])
    return written.select("user_id", "event_type", "event_id", "value")


QUOTA_SQL = """
select user_id, event_id, cast(ts + interval 8 hour as date) as usage_day, cast(5 - row_number() over
 (partition by user_id, cast(ts + interval 8 hour as date) order by ts, event_id) as integer) as remaining
from events qualify remaining >= 0
"""


@query("daily_quota", QUOTA_SQL)
def daily_quota(spark, sf):
    return turns.admitted(table(spark, sf, "events"), "user_id", "ts", ["event_id"]).select(
        "user_id", "event_id", "usage_day", "remaining"
    )


@query(
    "retained_usage",
    f"""with u as (select user_id, usage_day, count(*) as used from ({QUOTA_SQL}) group by all)
 select * from u where usage_day >= (select max(usage_day) from u) - 8""",
)
def retained_usage(spark, sf):
    usage = daily_quota(spark, sf).groupBy("user_id", "usage_day").agg(F.count(F.lit(1)).alias("used"))
    return turns.retained_usage(usage)


@query("streaming_daily_quota", QUOTA_SQL)
def streaming_quota(spark, sf):
    schema = table(spark, sf, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf).select("user_id", "event_id", "ts")
    output, checkpoint = scratch_path(spark, "quota"), scratch_path(spark, "quota-progress")
    jobs.admit_daily(events, "user_id", "ts", ["event_id"], output, checkpoint, arrived="ts").awaitTermination()
    return spark.read.parquet(output).where(F.col("decision") == "admitted").select("user_id", "event_id", "usage_day", "remaining")


DISORDERED_SQL = """
e as (select event_id, user_id, ts as arrived, case event_id % 40 when 0 then ts + interval 3650 day when 1 then null when 2 then ts - interval 12 day
  when 3 then ts - interval 2 day when 4 then ts + interval 3 day else ts end as moment, day(ts) // 8 as part from events),
j as (select *, cast(moment + interval 8 hour as date) as usage_day, cast(arrived + interval 8 hour as date) as today from e),
r as (select *, case when usage_day is null then 'no time' when usage_day < today - 8 then 'late' when usage_day > today then 'future' end as refused from j),
d as (select *, case when refused is null then row_number() over (partition by user_id, usage_day, refused is null order by part, moment, event_id) end as place from r)
"""


def disordered_events(spark, sf) -> DataFrame:
    """The events with the time at which they arrive; of some the own time is early, late, far ahead or missing."""
    moment = (
        F.when(F.col("event_id") % 40 == 0, F.expr("ts + interval 3650 days")).when(F.col("event_id") % 40 == 1, F.lit(None).cast("timestamp_ntz"))
        .when(F.col("event_id") % 40 == 2, F.expr("ts - interval 12 days")).when(F.col("event_id") % 40 == 3, F.expr("ts - interval 2 days"))
        .when(F.col("event_id") % 40 == 4, F.expr("ts + interval 3 days")).otherwise(F.col("ts"))
    )
    return table(spark, sf, "events").select(
        "event_id", "user_id", F.col("ts").alias("arrived"), moment.alias("moment"), F.floor(F.dayofmonth("ts") / 8).cast("int").alias("part")
    )


@query(
    "streaming_quota_batches",
    f"""with {DISORDERED_SQL} select event_id, user_id, usage_day, case when place <= 5 then 5 - place end::int as remaining,
 case when refused is not null then refused when place > 5 then 'quota' end as reason from d""",
)
def streaming_quota_batches(spark, sf):
    """Four batches, a week of arrivals each, through one stream that is stopped and resumed."""
    source, output, checkpoint = (scratch_path(spark, f"quota-{name}") for name in ("in", "out", "progress"))
    events = disordered_events(spark, sf)
    schema = events.drop("part").schema
    for part in range(4):
        # A week is as many files as tasks write it; what has arrived at a start is one batch.
        events.where(F.col("part") == part).drop("part").write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        jobs.admit_daily(stream, "user_id", "moment", ["event_id"], output, checkpoint, arrived="arrived").awaitTermination()
    return spark.read.parquet(output).select("event_id", "user_id", "usage_day", "remaining", "reason")


@query("streaming_enrichment", ASOF_SQL)
def streaming_enrichment(spark, sf):
    schema = table(spark, sf, "events").schema
    purchases = (
        spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
        .filter(F.col("event_type") == "purchase").select("event_id", "user_id", "ts")
    )
    views = table(spark, sf, "events").filter(F.col("event_type") == "view").select(
        "user_id", F.col("event_id").alias("view_id"), F.col("ts").alias("view_ts"), F.col("value").alias("view_value")
    )
    output, checkpoint = scratch_path(spark, "enriched"), scratch_path(spark, "enriched-progress")
    jobs.enrich_prices(
        purchases, views, ["user_id"], "ts", "view_ts", ["view_id", "view_ts", "view_value"], output, checkpoint, "day"
    ).awaitTermination()
    return spark.read.parquet(output).drop("batch")
