"""From book files to chunks: chapters, sentences, packing, breakpoints, positions."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import sentences
from ..functions.vectors import cosine_distance
from ..sources.workspace import stored
from .running import percentile, running, with_next

CHUNK_SIZE, OVERLAP = 1000, 50
# Fixed value: a chapter heading at the start of a line, with its number or word.
HEADING = r"^\s*(CHAPTER)\s+(\d+|\w+)"  # \w are letters of all scripts


def lines(books: DataFrame) -> DataFrame:
    """(book_filename, book_number, chapter_number, line_no, line) of whole book texts.

    Headings that were split over lines are joined, blank lines go, chapters are counted from
    0, which is what comes before the first heading; a line that starts with "glossary" ends
    its book. Lines lose their heading and leading non-word characters. ``books`` has
    book_filename, book_number and text, a row per book.
    """
    joined = F.regexp_replace("text", f"(?imU){HEADING}", "$1 $2")
    rows = books.select("book_filename", "book_number", F.posexplode(F.split(joined, r"\r?\n")).alias("line_no", "__raw")).withColumn("__raw", F.regexp_replace("__raw", r"(?U)^\s+|\s+$", "")).filter("__raw <> ''")
    so_far = Window.partitionBy("book_filename").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    heading = F.col("__raw").rlike(f"(?iU){HEADING}")
    ended = F.max(F.lower("__raw").startswith("glossary")).over(so_far)
    numbered = rows.withColumns({"chapter_number": F.sum(heading.cast("int")).over(so_far).cast("int"), "__ended": ended}).filter(~F.col("__ended"))
    bare = F.regexp_replace(F.regexp_replace("__raw", f"(?iU){HEADING}", ""), r"(?U)^\W+", "")
    return numbered.select("book_filename", "book_number", "chapter_number", "line_no", bare.alias("line"))


def chapters(book_lines: DataFrame) -> DataFrame:
    """One row per chapter that has text; a line is followed by a blank."""
    ordered = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    text = F.array_join(F.transform(ordered, lambda x: F.concat(x["line"], F.lit(" "))), "")
    return book_lines.groupBy("book_filename", "book_number", "chapter_number").agg(text.alias("full_text")).filter(F.trim("full_text") != "")


def pack(text: Column, size: int = CHUNK_SIZE, overlap: int = OVERLAP) -> Column:
    """Chunks of at most ``size`` characters from whole sentences, in one fold per row.

    A sentence longer than that is cut. A new chunk opens with the last ``overlap``
    characters of the one before.
    """
    if not 0 <= overlap < size - 1:
        raise ValueError("overlap must be less than the size by two at least")
    room = size - overlap - 1
    cut = F.flatten(F.transform(sentences(text), lambda s: F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.length(s) - 1) / room), F.lit(0))), lambda i: F.substring(s, (i * room + 1).cast("int"), F.lit(room)))))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(a: Column, s: Column) -> Column:
        fits = F.length(a["open"]) + 1 + F.length(s) <= size
        tail = F.concat(F.substring(a["open"], -overlap, overlap) if overlap else F.lit(""), F.lit(" "), s)
        return (
            F.when(a["open"] == "", F.struct(a["done"].alias("done"), s.alias("open")))
            .when(fits, F.struct(a["done"].alias("done"), F.concat(a["open"], F.lit(" "), s).alias("open")))
            .otherwise(F.struct(F.concat(a["done"], F.array(a["open"])).alias("done"), F.ltrim(tail).alias("open")))
        )

    return F.aggregate(cut, start, step, lambda a: F.when(a["open"] == "", a["done"]).otherwise(F.concat(a["done"], F.array(a["open"]))))


def chapter_chunks(book_chapters: DataFrame, series_id: int, size: int = CHUNK_SIZE, overlap: int = OVERLAP) -> DataFrame:
    """Level-1 chunks of chapters with their positions."""
    from ..functions.text import chunk_key

    cut = book_chapters.select("book_filename", "book_number", "chapter_number", F.posexplode(pack(F.col("full_text"), size, overlap)).alias("chunk_index", "text"))
    placed = book_position(cut, overlap).withColumns({"series_id": F.lit(series_id), "level": F.lit(1), "is_summary": F.lit(False)})
    return placed.withColumn("chunk_key", chunk_key(*(F.col(c) for c in ("series_id", "book_number", "chapter_number", "level", "chunk_index"))))


def book_position(chunks: DataFrame, overlap: int = OVERLAP, total: str | None = None) -> DataFrame:
    """Chunks with ``book_position``: characters up to the chunk's end over those of the book, to 4 places.

    An overlap counts once, but for a chapter's last chunk. Sums run inside chapters, and only
    one row per chapter meets in its book. ``total`` names a column with the book's length;
    without it, the length is that of all its chunks.
    """
    per = ["book_number", "chapter_number"]
    inside = Window.partitionBy(*per).orderBy("chunk_index")
    is_last = F.lead("chunk_index").over(inside).isNull()
    step = F.length("text") - F.when(is_last, 0).otherwise(overlap)
    moved = chunks.withColumn("__step", step).withColumn("__in", F.sum("__step").over(inside))
    sums = moved.groupBy(*per).agg(F.sum("__step").alias("__sum"), F.sum(F.length("text")).alias("__chars"))
    books = Window.partitionBy("book_number")
    order = books.orderBy("chapter_number").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*per, F.coalesce(F.sum("__sum").over(order), F.lit(0)).alias("__off"), F.sum("__chars").over(books).alias("__total"))
    whole = F.col(total) if total else F.col("__total")
    return moved.join(offsets, per).withColumn("book_position", F.round((F.col("__off") + F.col("__in")) / whole, 4)).drop("__step", "__in", "__off", "__total")


def sentence_context(text: Column, width: int = 1) -> Column:
    """Each sentence with ``width`` neighbours on either side, as an array; no rows are moved.

    The sentences are bound once, as the one element of an array, so that a text is split once.
    """
    near = lambda all_: F.transform(all_, lambda s, i: F.array_join(F.slice(all_, F.greatest(i - width, F.lit(0)) + 1, F.least(i, F.lit(width)) + 1 + width), " "))
    return F.element_at(F.transform(F.array(sentences(text)), near), 1)


def adjacent_distance(rows: DataFrame, per: Sequence[str], order: str, embedding: str = "embedding", need_two: bool = False) -> DataFrame:
    """Rows with ``distance``, the cosine distance to the next row of the group; null for its last.

    With ``need_two``, a group of one row is a ValueError.
    """
    if need_two and (alone := rows.groupBy(*per).count().filter("count < 2").limit(1).collect()):
        raise ValueError(f"a distance needs two rows: {alone[0].asDict()}")
    near = with_next(rows, per, order, [embedding], "__next")
    return near.withColumn("distance", cosine_distance(F.col(embedding), F.col(f"__next.{embedding}"))).drop("__next")


def breakpoints(distances: DataFrame, per: Sequence[str], share: float = 0.95) -> DataFrame:
    """A row per group with ``cut``, the exact percentile of its distances by linear interpolation."""
    return percentile(distances, per, "distance", share, "cut")


def segments(rows: DataFrame, per: Sequence[str], order: str, share: float = 0.95) -> DataFrame:
    """Rows with ``segment``: how many distances above the cut come before."""
    measured = stored(adjacent_distance(rows, per, order))
    cut = breakpoints(measured, per, share)
    cuts = cut.select(*[F.col(c).alias(f"__{c}") for c in per], "cut")
    joined = measured.join(cuts, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in per]).drop(*[f"__{c}" for c in per])
    counted = running(joined.withColumn("__break", F.when(F.col("distance") > F.col("cut"), 1).otherwise(0)), per, [order], {"__so_far": "__break"})
    return counted.withColumn("segment", (F.col("__so_far") - F.col("__break")).cast("int")).drop("distance", "cut", "__break", "__so_far", "__so_far_total")


def _merge_small(texts: list[str], vectors: list[np.ndarray], least: int) -> list[tuple[str, np.ndarray]]:
    out = list(zip(texts, vectors, strict=True))
    i = 1
    cosine = lambda a, b: float(a @ b / (np.linalg.norm(a) * np.linalg.norm(b) or 1.0))
    while i < len(out) - 1:
        text, v = out[i]
        if len(text.split(". ")) >= least:
            i += 1
            continue
        before, after = cosine(out[i - 1][1], v), cosine(v, out[i + 1][1])
        j = i - 1 if before > after else i + 1
        first, second = (out[j], out[i]) if j < i else (out[i], out[j])
        out[min(i, j) : max(i, j) + 1] = [(f"{first[0]} {second[0]}", (first[1] + second[1]) / 2)]
        i = max(1, min(i, j))
    return out


def merge_small(segments_: DataFrame, per: Sequence[str], least: int = 3) -> DataFrame:
    """Segments (segment, text, embedding: their mean) with small inner ones joined to the more similar neighbour.

    Small is fewer than ``least`` sentences; ties go to the next one. A fold over a
    chapter's segments, so it runs per chapter in pandas.
    """
    types = {f.name: f.dataType.simpleString() for f in segments_.schema.fields}
    schema = ", ".join(f"{c} {types[c]}" for c in per) + ", segment int, text string, embedding array<double>"

    def run(key: tuple[Any, ...], pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("segment")
        merged = _merge_small(pdf["text"].tolist(), [np.asarray(v, float) for v in pdf["embedding"]], least)
        return pd.DataFrame([(*key, i, t, v.tolist()) for i, (t, v) in enumerate(merged)], columns=[*per, "segment", "text", "embedding"])

    return segments_.groupBy(*per).applyInPandas(run, schema)
