"""Preference formatting with DataFrame functions only: shared prompt once, paired masked completions.

A pair is a chosen and a rejected conversation. Their longest common prefix of turns is rendered once as the prompt;
what follows in each is a completion. A completion's loss mask is written as character spans within it: the texts of
the assistant's turns with their end marks, and nothing else, are trained on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The marks of the ChatML format.
START, END = "<|im_start|>", "<|im_end|>"
TRAINED_ROLE = "assistant"


def _clean(text: F.Column) -> F.Column:
    """Text that can't pass for a mark: "<|" is written "< |"."""
    return F.replace(F.coalesce(text, F.lit("")), F.lit("<|"), F.lit("< |"))


def turns_of(conversations: DataFrame, key: F.Column, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """pair, conv, turns: each conversation's turns in order (turn, role, text).

    Turns with equal numbers go by role, then text; repeated rows are turns of their own; a null turn number comes first.
    Null roles and texts count as empty. Other columns aren't read. One conversation becomes one row, so its own length is
    the only bound on a row. An empty table gives no rows.
    """
    role, text = _clean(F.col(role_col)), _clean(F.col(text_col))
    turn = F.struct(F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text"))
    rows = conversations.select(F.col(conv_col).alias("conv"), key.alias("pair"), turn.alias("t"))
    return rows.groupBy("pair", "conv").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def _rendered(turns: F.Column) -> F.Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(START), t["role"], F.lit("\n"), t["text"], F.lit(END + "\n"))), "")


def _spans(turns: F.Column) -> F.Column:
    """"first-end" of every trained part of the rendered turns, comma-joined; end exclusive."""
    head, tail = len(START) + 1, len(END)

    def add(state, t):
        first = state["at"] + head + F.length(t["role"])
        end = first + F.length(t["text"]) + tail
        span = F.when(t["role"] == TRAINED_ROLE, F.concat(F.when(state["out"] == "", F.lit("")).otherwise(F.lit(",")), first.cast("string"), F.lit("-"), end.cast("string"))).otherwise(F.lit(""))
        return F.struct((end + 1).alias("at"), F.concat(state["out"], span).alias("out"))

    return F.aggregate(turns, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), add, lambda s: s["out"])


def format_preferences(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """A row per pair from two tables (pair, turns) of turns_of(): pair, n_prompt_turns, prompt, chosen, rejected,
    chosen_spans, rejected_spans.

    Turns are equal where role and text are; null roles and texts count as empty. Turns with equal numbers go by role,
    then text. A pair of equal conversations has empty completions. A pair without one of its sides has no row, nor has
    a null pair. More than one conversation on a side: each is paired with each of the other side. An empty table gives
    no rows. One conversation becomes one row, so its own length is the only bound on a row.
    """
    return _formatted(chosen.select("pair", F.col("turns").alias("c")).join(rejected.select("pair", F.col("turns").alias("r")), "pair"))


def _formatted(both: DataFrame) -> DataFrame:
    """The preferences of rows (pair, c, r): chosen and rejected turns."""
    same = F.zip_with("c", "r", lambda x, y: F.coalesce((x["role"] == y["role"]) & (x["text"] == y["text"]), F.lit(False)))
    first_other = F.array_position(same, False)
    both = both.withColumn("n", F.when(first_other == 0, F.size(same)).otherwise(first_other - 1).cast("int"))
    rest = lambda side: F.slice(F.col(side), F.col("n") + 1, F.size(side) + 1)
    both = both.select("pair", "n", F.slice("c", F.lit(1), F.col("n")).alias("p"), rest("c").alias("c"), rest("r").alias("r"))
    return both.select(
        "pair", F.col("n").cast("bigint").alias("n_prompt_turns"), _rendered(F.col("p")).alias("prompt"),
        _rendered(F.col("c")).alias("chosen"), _rendered(F.col("r")).alias("rejected"),
        _spans(F.col("c")).alias("chosen_spans"), _spans(F.col("r")).alias("rejected_spans"),
    )


def pair_answers(conversations: DataFrame, conv_col: str = "conv_id", **columns) -> DataFrame:
    """Preferences from a plain table: of every conversation, its own last turn is chosen, and its neighbour's is rejected.

    Neighbours are conversations 2 i and 2 i + 1. The rejected side is the whole conversation with its last turn's role and
    text replaced by those of the neighbour's last turn. pair is the conversation's id. A conversation without a neighbour
    and one without an id have no row. Otherwise as format_preferences().
    """
    conv = F.col(conv_col).cast("bigint")
    turns = turns_of(conversations.filter(conv.isNotNull()), conv, conv_col, **columns)
    even = F.pmod("pair", F.lit(2)) == 0
    lasts = turns.select(F.when(even, F.col("pair") + 1).otherwise(F.col("pair") - 1).alias("pair"), F.element_at("turns", -1).alias("last"))
    # chosen and rejected are made of the same row, so the turns are gathered and joined once
    both = turns.join(lasts, "pair")
    other = F.struct(F.element_at("turns", -1)["turn"].alias("turn"), F.col("last")["role"].alias("role"), F.col("last")["text"].alias("text"))
    replaced = F.concat(F.slice("turns", F.lit(1), F.size("turns") - 1), F.array(other))
    return _formatted(both.select("pair", F.col("turns").alias("c"), replaced.alias("r")))
