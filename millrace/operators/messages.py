"""Checks of chat messages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.functions.text import is_blank

#: Fixed values.
ROLES = ("system", "user", "assistant", "tool")


def conversation_faults(messages: DataFrame) -> DataFrame:
    """Per conversation (conv_id, turn, role, text): its messages, and how many have an unknown role, no text, a system
    message after the first turn, or follow one of the same role."""
    order = W.partitionBy("conv_id").orderBy("turn")
    rows = messages.select("conv_id", "turn", "role", "text", F.lag("role").over(order).alias("before"))
    return rows.groupBy("conv_id").agg(
        F.count("*").alias("n_messages"), F.count_if(~F.coalesce(F.col("role").isin(*ROLES), F.lit(False))).alias("bad_roles"), F.count_if(is_blank(F.col("text"))).alias("blank_texts"),
        F.count_if((F.col("role") == "system") & F.col("before").isNotNull()).alias("late_system"), F.count_if(F.col("role") == F.col("before")).alias("repeated_roles"),
    )


def tool_faults(messages: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, call_id, fault) for messages (conv_id, turn, role, call_ids, reply_to).

    A call id is used once, in an assistant's message; a tool's reply is to one call of an earlier turn, and to each call
    one reply.
    """
    calls = messages.where(F.col("role") == "assistant").select("conv_id", "turn", F.explode("call_ids").alias("call_id"))
    nth = W.partitionBy("conv_id", "call_id").orderBy("turn")
    twice = calls.withColumn("n", F.row_number().over(nth)).where("n > 1").select("conv_id", "turn", "call_id", F.lit("repeated call id").alias("fault"))
    first = calls.groupBy("conv_id", "call_id").agg(F.min("turn").alias("called"))
    replies = messages.where(F.col("role") == "tool").select("conv_id", "turn", F.col("reply_to").alias("call_id"))
    held = replies.withColumn("n", F.row_number().over(nth)).join(first, ["conv_id", "call_id"], "left")
    fault = F.when(F.col("called").isNull(), "reply to no call").when(F.col("called") >= F.col("turn"), "reply before its call").when(F.col("n") > 1, "second reply")
    return twice.unionByName(held.withColumn("fault", fault).where("fault is not null").select("conv_id", "turn", "call_id", "fault"))
