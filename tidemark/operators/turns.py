"""Conversation turns: token budgets, recency, retention, latest-wins updates, daily quotas."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.dates import local_day
from tidemark.functions.text import excerpt, token_estimate
from tidemark.operators.asof import newest_per
from tidemark.operators.scans import Running, attach, running

# Default budgets and limits.
TRIGGER_TOKENS = 12_000
BATCH_TOKENS = 6_000
PROTECTED_TURNS = 5
CONTEXT_TURNS = 6
EXCERPT_LENGTH = 240
KEPT_PER_OWNER = 20
DAILY_LIMIT = 5
RETENTION_DAYS = 8
TURNS_PER_SEGMENT = 256


def _segment(turn: str) -> Column:
    return F.floor(F.col(turn) / TURNS_PER_SEGMENT)


def with_tokens(turns: DataFrame, text: str) -> DataFrame:
    return turns.withColumn("tokens", token_estimate(F.col(text)))


def over_budget(turns: DataFrame, session: str, trigger: int = TRIGGER_TOKENS, protected: int = PROTECTED_TURNS) -> DataFrame:
    """Sessions whose turns add up to the trigger and that have more than the protected turns."""
    totals = turns.groupBy(session).agg(
        F.sum("tokens").alias("total_tokens"), F.count(F.lit(1)).alias("turn_count")
    )
    return totals.filter((F.col("total_tokens") >= trigger) & (F.col("turn_count") > protected))


def unprotected(turns: DataFrame, session: str, turn: str, protected: int = PROTECTED_TURNS) -> DataFrame:
    """Turns before the last ``protected`` ones of their session."""
    tail = newest_per(turns.select(session, turn), [session], [F.col(turn).desc()], protected)
    limits = tail.groupBy(session).agg(F.min(turn).alias("__first_protected"))
    return attach(turns, limits, [session]).filter(F.col(turn) < F.col("__first_protected")).drop("__first_protected")


def oldest_batch(turns: DataFrame, session: str, turn: str, budget: int = BATCH_TOKENS) -> DataFrame:
    """Oldest turns until the budget is reached; the turn that crosses it is included."""
    before = running(
        turns, [session], [turn], _segment(turn), {"tokens_before": Running("sum", F.col("tokens"))},
        include_current=False,
    ).withColumn("tokens_before", F.coalesce(F.col("tokens_before"), F.lit(0)))
    return before.filter(F.col("tokens_before") < budget)


def summary_batch(
    turns: DataFrame, session: str, turn: str,
    trigger: int = TRIGGER_TOKENS, budget: int = BATCH_TOKENS, protected: int = PROTECTED_TURNS,
) -> DataFrame:
    """The turns to be summarised next, for the sessions that are over their budget."""
    due = turns.join(over_budget(turns, session, trigger, protected).select(session), session, "left_semi")
    return oldest_batch(unprotected(due, session, turn, protected), session, turn, budget)


def recent_context(
    turns: DataFrame, session: str, turn: str, text: str, count: int = CONTEXT_TURNS, size: int = EXCERPT_LENGTH
) -> DataFrame:
    """The last turns of each session with a short excerpt of their text."""
    return newest_per(turns, [session], [F.col(turn).desc()], count).withColumn(
        "excerpt", excerpt(F.col(text), size)
    )


def latest_wins(rows: DataFrame, keys: Sequence[str], moment: Sequence[str]) -> DataFrame:
    """One row per key: the one written last."""
    return newest_per(rows, keys, [F.col(name).desc_nulls_last() for name in moment])


def keep_newest(
    rows: DataFrame, owner: str, item: str, moment: Sequence[str], count: int = KEPT_PER_OWNER
) -> DataFrame:
    """Upsert by (owner, item), then the newest ``count`` items per owner."""
    current = latest_wins(rows, [owner, item], moment)
    order = [F.col(name).desc_nulls_last() for name in moment]
    return newest_per(current, [owner], [*order, F.col(item).asc()], count)


def latest_result(turns: DataFrame, session: str, moment: Sequence[str], usable: Column) -> DataFrame:
    """Newest usable row per session, picked by a combining aggregate."""
    rest = [name for name in turns.columns if name != session]
    at = F.struct(*[F.col(name) for name in moment])
    picked = turns.filter(usable).groupBy(session).agg(
        F.max_by(F.struct(*[F.col(name) for name in rest]), at).alias("__row")
    )
    return picked.select(session, *[F.col("__row")[name].alias(name) for name in rest])


def admitted(
    events: DataFrame, key: str, moment: str, tie: Sequence[str], limit: int = DAILY_LIMIT, zone: str = "Asia/Shanghai"
) -> DataFrame:
    """The first ``limit`` events per key and local day, with what is left after each.

    Ranking with a small limit is pruned in every task before the shuffle.
    """
    from tidemark.operators.aggregates import first_rows_per

    dated = events.withColumn("usage_day", local_day(F.col(moment), zone))
    order = [F.col(moment).asc(), *[F.col(name).asc() for name in tie]]
    ranked = first_rows_per(dated, [key, "usage_day"], order, limit)
    return ranked.withColumn("remaining", F.lit(limit) - F.col("rank"))


def retained_usage(usage: DataFrame, day: str = "usage_day", days: int = RETENTION_DAYS) -> DataFrame:
    """Usage rows no older than ``days`` before the newest day."""
    return usage.filter(F.col(day) >= F.date_sub(usage.agg(F.max(day)).scalar(), days))
