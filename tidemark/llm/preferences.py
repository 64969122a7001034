"""Chat formatting of preference pairs.

Built-in functions only. Both conversations of a pair are arrays of turns. The longest common prefix of turns becomes the
prompt and is rendered once; the rest of each conversation is its completion, with the stretches that count for the
loss: the texts of the assistant's turns and their end marks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.text import fresh, plain_names

TURN = "struct<role:string,text:string>"


def turns_of(conversations: DataFrame) -> DataFrame:
    """One row per ``conv_id`` with ``turns``, in the order of (turn, role, text).

    Null roles and texts count as empty. A null turn comes first. A row that repeats another is a turn of its own. Null ids
    form one conversation. A conversation is one output row, so it has to fit one.
    """
    turn = F.struct(
        F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    return conversations.groupBy("conv_id").agg(
        F.transform(F.sort_array(F.collect_list(turn)), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns")
    )


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, _rendered), "")


def _rendered(turn: Column) -> Column:
    return F.concat(F.lit("<|"), turn["role"], F.lit("|>\n"), turn["text"], F.lit("<|end|>\n"))


def loss_spans(turns: Column) -> Column:
    """array<struct<start, end>>: code points of ``render(turns)`` that count: text and end mark of assistant turns."""
    begin = F.lit(0).cast("long")
    empty = F.array().cast("array<struct<start:bigint,end:bigint>>")

    def step(state: Column, turn: Column) -> Column:
        start = state["at"] + F.char_length(turn["role"]) + F.lit(5)
        end = start + F.char_length(turn["text"]) + F.lit(7)
        span = F.array(F.struct(start.cast("long").alias("start"), end.cast("long").alias("end")))
        return F.struct(
            (end + 1).cast("long").alias("at"),
            F.when(turn["role"] == "assistant", F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans"),
        )

    return F.aggregate(turns, F.struct(begin.alias("at"), empty.alias("spans")), step, lambda state: state["spans"])


@plain_names
def format_pairs(pairs: DataFrame, chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """``pairs`` with ``chosen`` and ``rejected`` (arrays of (role, text)) replaced by prompt and completions.

    Added: ``n_prompt_turns``, ``prompt``, ``chosen``, ``rejected`` (rendered completions), ``chosen_loss``,
    ``rejected_loss`` (spans in them), and ``same`` (nothing follows the prompt on either side, so the pair teaches nothing). A
    null array counts as empty; if the first turns differ, the prompt is empty.
    """
    none = F.array().cast(f"array<{TURN}>")
    added = ("n_prompt_turns", "prompt", "chosen", "rejected", "chosen_loss", "rejected_loss", "same")
    kept = [c for c in pairs.columns if c.lower() not in {*added, chosen.lower(), rejected.lower()}]
    name = fresh(pairs, "c", "r", "n", "cc", "rr")
    c, r, n, cc, rr = name.values()
    rows = pairs.select(*kept, F.coalesce(chosen, none).alias(c), F.coalesce(rejected, none).alias(r))
    # zip_with fills the shorter side with nulls, which equal no turn.
    differs = F.zip_with(c, r, lambda a, b: F.coalesce(a != b, F.lit(True)))
    first = F.array_position(differs, True)
    rows = rows.withColumn(n, F.when(first == 0, F.size(c)).otherwise(first - 1).cast("int"))
    tail = lambda side: F.slice(side, F.col(n) + 1, F.greatest(F.size(side), F.lit(1)))
    rows = rows.withColumns({cc: tail(c), rr: tail(r)})
    return rows.select(
        *kept, F.col(n).cast("long").alias("n_prompt_turns"), render(F.slice(c, F.lit(1), F.col(n))).alias("prompt"),
        render(F.col(cc)).alias("chosen"), render(F.col(rr)).alias("rejected"),
        loss_spans(F.col(cc)).alias("chosen_loss"), loss_spans(F.col(rr)).alias("rejected_loss"),
        ((F.size(cc) == 0) & (F.size(rr) == 0)).alias("same"),
    )


def answer_swaps(conversations: DataFrame, span: int = 64) -> DataFrame:
    """Pairs out of single conversations: ``pair_id``, ``donor_id``, ``chosen``, ``rejected``.

    The chosen side is a conversation up to its last assistant turn. The rejected side ends in the last answer of a donor
    instead: the next conversation with an answer within a stretch of ``span`` ids, the first one after the last; a
    conversation alone in its stretch gives its own answer. Conversations without an assistant turn give no pair.
    """
    position = F.size("turns") - F.array_position(F.reverse(F.transform("turns", lambda t: t["role"])), "assistant") + 1
    answered = (
        turns_of(conversations)
        .where(F.exists("turns", lambda t: t["role"] == "assistant"))
        .withColumn("last", position.cast("int"))
        .withColumn("answer", F.element_at("turns", F.col("last")))
        .withColumn("stretch", F.floor(F.coalesce(F.col("conv_id"), F.lit(-1)) / span))
    )
    near = Window.partitionBy("stretch").orderBy("conv_id")
    all_of = near.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    donor = F.struct(F.col("conv_id").alias("id"), F.col("answer").alias("answer"))
    return (
        answered.withColumn("donor", F.coalesce(F.lead(donor).over(near), F.first(donor).over(all_of)))
        .select(
            F.col("conv_id").alias("pair_id"), F.col("donor.id").alias("donor_id"),
            F.slice("turns", F.lit(1), F.col("last")).alias("chosen"),
            F.concat(F.slice("turns", F.lit(1), F.col("last") - 1), F.array("donor.answer")).alias("rejected"),
        )
    )
