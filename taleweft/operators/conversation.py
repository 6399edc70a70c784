"""Turns, history, expiry, feedback and cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TTL_SECONDS = 3600
HISTORY = 3
IN_PER_MILLION, OUT_PER_MILLION = 0.15, 0.60
UUID = r"^[0-9a-fA-F]{8}-([0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$"


def valid_id(conversation_id: str) -> str:
    import re

    if not re.match(UUID, conversation_id):
        raise ValueError(f"not a conversation id: {conversation_id}")
    return conversation_id


def turns(messages: DataFrame) -> DataFrame:
    """(conversation_id, sequence, question, response): each user message with the assistant's next one, from 0."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    nxt = messages.filter(F.col("role").isin("user", "assistant")).withColumns({"__role": F.lead("role").over(order), "__text": F.lead("text").over(order)})
    asked = nxt.filter("role = 'user' AND __role = 'assistant'")
    return asked.select(F.col("conv_id").alias("conversation_id"), (F.row_number().over(order) - 1).alias("sequence"), F.col("text").alias("question"), F.col("__text").alias("response"))


def append_turns(history: DataFrame, new: DataFrame) -> DataFrame:
    """History with new turns numbered on from each conversation's count; ``new`` is ordered by its ``sequence``."""
    counts = history.groupBy("conversation_id").agg(F.count("*").alias("__n"))
    placed = new.join(counts, "conversation_id", "left").withColumn("sequence", (F.coalesce("__n", F.lit(0)) + F.row_number().over(Window.partitionBy("conversation_id").orderBy("sequence")) - 1).cast("int"))
    return history.unionByName(placed.select(*history.columns))


def history(all_turns: DataFrame, first: int = HISTORY) -> DataFrame:
    """The first turns of each conversation as a user and an assistant message each."""
    some = all_turns.filter(F.col("sequence") < first)
    pairs = F.array(F.struct(F.lit(0).alias("part"), F.lit("user").alias("role"), F.col("question").alias("content")), F.struct(F.lit(1).alias("part"), F.lit("assistant").alias("role"), F.col("response").alias("content")))
    return some.select("conversation_id", "sequence", F.inline(pairs))


def log(all_turns: DataFrame) -> DataFrame:
    """(conversation_id, turns): each conversation as a JSON array in order."""
    fields = [c for c in all_turns.columns if c != "conversation_id"]
    ordered = F.array_sort(F.collect_list(F.struct("sequence", *[c for c in fields if c != "sequence"])))
    return all_turns.groupBy("conversation_id").agg(F.to_json(ordered).alias("turns"))


def expiry(writes: DataFrame, now: Column, ttl: int = TTL_SECONDS, conversation: str = "conversation_id", ts: str = "ts") -> DataFrame:
    """A row per conversation: every write renews all of it; ``live`` while the last is younger than the TTL."""
    last = writes.groupBy(conversation).agg(F.max(ts).alias("last_write"), F.count("*").alias("writes"))
    until = F.timestamp_seconds(F.unix_seconds(F.col("last_write").cast("timestamp")) + ttl)
    return last.withColumns({"expires_at": until, "live": until > now})


def cost(completion_tokens: Column, prompt_tokens: Column) -> Column:
    """Dollars: prompt tokens are input, completion tokens output."""
    return prompt_tokens / 1e6 * IN_PER_MILLION + completion_tokens / 1e6 * OUT_PER_MILLION


def cost_text(dollars: Column) -> Column:
    """Dollars to four places, rounded by the exact value of the double, as C does; format_string rounds its shortest decimals."""
    told = F.concat(F.lit("$"), F.replace(F.format_number(dollars, 4), F.lit(","), F.lit("")))
    # 0.00005 as a double is above the half; the formatter, at fault for a lone 5, rounds it down
    return F.when(dollars == 0.00005, F.lit("$0.0001")).otherwise(told)


def feedback_line(request: Column, feedback: Column, kind: Column) -> Column:
    return F.concat_ws("|", request, feedback, kind)
