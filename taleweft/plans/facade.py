"""One object that answers questions and keeps their conversations."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import log_text
from ..operators.conversation import TTL_SECONDS, cost, cost_text, valid_id
from ..operators.predicates import ContextFilters
from ..operators.vector import OVERVIEW
from ..providers import Decisions, LocalDecisions
from ..schema import TURNS
from ..sources.readers import read_conversation
from ..sources.writers import append_conversation
from .ask import Answer, Library, as_context, ask

#: What a request must name.
NEEDED = ("question", "book_number", "chapter_number", "series_id")


def check_request(request: dict, needed: tuple[str, ...] = NEEDED) -> dict:
    """The request; a ValueError names what it lacks."""
    if missing := [k for k in needed if request.get(k) is None]:
        raise ValueError(f"the request lacks: {', '.join(missing)}")
    return request


@dataclass
class Storyteller:
    """Answers from a library; conversations live in the Parquet folder ``store`` for ``ttl`` seconds after their last turn."""

    library: Library
    store: str | None = None
    decisions: Decisions = field(default_factory=LocalDecisions)
    n_chunks: int = 5
    ttl: int = TTL_SECONDS
    log: list[str] = field(default_factory=list)

    def turns(self, conversation_id: str, now=None) -> list:
        """The conversation's turns in order; none once it has expired or where it's new."""
        spark = self.library.chunks.sparkSession
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{self.store}/{valid_id(conversation_id)}")
        if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
            return []
        return read_conversation(spark, f"{self.store}/{conversation_id}", conversation_id, F.current_timestamp() if now is None else now).collect()

    def invoke(self, question: str, book_number: int, chapter_number: int, series_id: int, conversation_id: str | None = None, now=None, **how) -> tuple[str, DataFrame, None, list[str], str]:
        """(answer, contexts, None, entities, conversation id); the turn is appended to the conversation."""
        check_request({"question": question, "book_number": book_number, "chapter_number": chapter_number, "series_id": series_id})
        conversation_id = valid_id(conversation_id) if conversation_id else str(uuid.uuid4())
        past = self.turns(conversation_id, now) if self.store else []
        history = [(t["question"], t["response"]) for t in past]
        self.log.append(f"question: {log_text(question)}")
        filters = ContextFilters(series_id=series_id, book_number=book_number, chapter_number=chapter_number)
        answer = ask(self.library, question, filters, self.decisions, history, n_chunks=self.n_chunks, **how)
        contexts = as_context(answer.contexts)
        if self.store:
            self._keep(conversation_id, len(past), question, answer, contexts, now)
        return answer.text, contexts, None, [], conversation_id

    def _keep(self, conversation_id: str, sequence: int, question: str, answer: Answer, contexts: DataFrame, now) -> None:
        spark = self.library.chunks.sparkSession
        used = [r.asDict() for r in contexts.orderBy("chunk_id").limit(OVERVIEW).collect()]
        schema = TURNS[:-2]  # times are those of the write
        row = (conversation_id, sequence, question, answer.text, [], [tuple(u.values()) for u in used])
        append_conversation(spark.createDataFrame([row], schema), f"{self.store}/{conversation_id}", now if now is not None else F.current_timestamp(), self.ttl)

    def cost(self, conversation_id: str) -> str:
        """What a conversation cost, with words as tokens."""
        past = self.turns(conversation_id)
        count = lambda name: sum(len((t[name] or "").split()) for t in past)
        spark = self.library.chunks.sparkSession
        return spark.range(1).select(cost_text(cost(F.lit(count("response")), F.lit(count("question")))).alias("c")).first()["c"]
