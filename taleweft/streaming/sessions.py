"""Conversation lifetimes over a stream of writes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.conversation import TTL_SECONDS


def lifetimes(writes: DataFrame, ttl: int = TTL_SECONDS, late: str = "10 minutes", conversation: str = "conversation_id", ts: str = "ts") -> DataFrame:
    """(conversation, opened_at, expires_at, writes): a session per life, since every write renews the TTL.

    Works on streams (append mode, rows come once the watermark has passed the expiry) and on tables.
    """
    timed = writes.withWatermark(ts, late) if writes.isStreaming else writes
    session = F.session_window(ts, f"{ttl} seconds")
    return timed.groupBy(conversation, session.alias("s")).agg(F.count("*").alias("writes")).select(conversation, F.col("s.start").alias("opened_at"), F.col("s.end").alias("expires_at"), "writes")
