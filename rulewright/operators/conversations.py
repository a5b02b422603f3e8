"""Conversations: pairs of turns, first question and answer, filters of pairs, training rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rulewright.functions import text as T


def turn_pairs(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, pair, question, answer, mentions_image): turns 2i and 2i+1, where a user asks and an assistant answers.

    Positions count the turns of a conversation in order; an odd last turn and pairs with other
    roles are dropped. mentions_image holds for all pairs of a conversation with any cue.
    """
    order = Window.partitionBy(conv).orderBy(turn)
    whole = Window.partitionBy(conv)
    rows = turns.select(
        conv, (F.row_number().over(order) - 1).alias("at"), F.col(role).alias("role"), F.col(text).alias("question"), F.lead(role).over(order).alias("next_role"), F.lead(text).over(order).alias("answer"),
        F.max(T.mentions_image(F.col(text))).over(whole).alias("mentions_image"),
    )
    paired = rows.filter((F.col("at") % 2 == 0) & (F.col("role") == "user") & (F.col("next_role") == "assistant"))
    return paired.select(conv, F.floor(F.col("at") / 2).cast("int").alias("pair"), "question", "answer", "mentions_image")


def drop_reason(question: Column, answer: Column, most_chars: int) -> Column:
    """Why a pair goes, by the first reason that holds; null if it stays."""
    return (
        F.when(T.is_reading_text(question) | T.is_reading_text(answer), "reading")
        .when(F.char_length(answer) > most_chars, "long")
        .when(T.is_truncated(answer), "truncated")
    )


def first_exchange(turns: DataFrame) -> DataFrame:
    """(conv_id, question, answer): the first text of a user and the first of an assistant; null where there is none."""
    return turns.groupBy("conv_id").agg(
        F.min_by(F.when(F.col("role") == "user", F.col("text")), F.when(F.col("role") == "user", F.col("turn"))).alias("question"),
        F.min_by(F.when(F.col("role") == "assistant", F.col("text")), F.when(F.col("role") == "assistant", F.col("turn"))).alias("answer"),
    )


def training_row(question: Column, answer: Column) -> Column:
    """A two-turn conversation as an array of (from, value), with the image mark before the question."""
    turn = lambda who, value: F.struct(F.lit(who).alias("from"), value.alias("value"))
    return F.array(turn("human", F.concat(F.lit("<image>\n"), question)), turn("gpt", answer))


def gate_text(conversation: Column) -> Column:
    """The human turns without image marks, joined by newlines."""
    human = F.filter(conversation, lambda t: t["from"] == "human")
    return F.array_join(F.transform(human, lambda t: F.trim(F.regexp_replace(t["value"], "<image>\n?", ""))), "\n")


def signed_length(conversation: Column, has_image: Column) -> Column:
    """Number of words, negative for rows without an image."""
    words = F.aggregate(conversation, F.lit(0), lambda n, t: n + F.size(F.split(t["value"], " ")))
    return F.when(has_image, words).otherwise(-words)


def document(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_words, text): the turns in order, each with its role, as one text."""
    rows = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    return rows.select("conv_id", F.size("t").alias("n_turns"), F.array_join(F.transform("t", lambda x: F.concat(x["role"], F.lit(": "), x["text"])), "\n").alias("text"))
