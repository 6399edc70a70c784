"""Column functions over text: tokens, keys, context lines."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: the shape of a complete chunk id, anchored at its start.
KEY_SHAPE = r"^series_\d+\|book_\d+\|chapter_\d+\|level_\d+\|chunk_\d+"


def tokens(text: Column) -> Column:
    """Lower-case words between white space; punctuation stays attached."""
    return F.filter(F.split(F.lower(text), r"(?U)\s+"), lambda t: t != "")


def distinct_tokens(text: Column) -> Column:
    return F.array_distinct(tokens(text))


def chunk_key(series: Column, book: Column, chapter: Column, level: Column, index: Column) -> Column:
    """Parts that are null are left out, but for the series."""
    part = lambda name, c: F.concat(F.lit(f"{name}_"), c.cast("string"))
    return F.concat_ws("|", F.concat(F.lit("series_"), F.coalesce(series.cast("string"), F.lit("None"))), part("book", book), part("chapter", chapter), part("level", level), part("chunk", index))


def complete_key(key: Column) -> Column:
    return F.coalesce(key.rlike(KEY_SHAPE), F.lit(False))


def context_line(book: Column, chapter: Column, text: Column) -> Column:
    """Joined as bytes: formatting would hold a text of any length several times over, in two bytes a character."""
    said = lambda c: F.coalesce(c.cast("string"), F.lit("null"))
    # Fixed value: the form of a context line.
    return F.concat(F.lit("Book "), said(book), F.lit(", Chapter "), said(chapter), F.lit(": "), said(text))


def context_block(texts: Column) -> Column:
    """An array of texts as one quoted block. Fixed value: what stands before each."""
    mark = '"""\n'
    return F.concat(F.lit(mark), F.array_join(texts, mark), F.lit('"""'))


def bullets(pairs: Column) -> Column:
    """``- id: doc`` for each struct(id, doc) of an array, a line each. Fixed value: the form of a line."""
    return F.array_join(F.transform(pairs, lambda p: F.concat(F.lit("- "), p["id"], F.lit(": "), p["doc"])), "\n")


def edge_list(joined: Column) -> Column:
    """Comma-joined keys as an array; none for an empty string."""
    return F.coalesce(F.split(F.nullif(joined, F.lit("")), ","), F.array().cast("array<string>"))


def sentences(text: Column) -> Column:
    """Pieces that end with a full stop, question or exclamation mark and white space."""
    return F.filter(F.split(F.regexp_replace(F.trim(text), r"([.!?])\s+", "$1\u0001"), "\u0001"), lambda s: s != "")


# The openings of plain questions.
PLAIN = (r"^what (is|are|was|were) the", r"^(can|could) you explain", r"^tell me (about|what)")


def simple_question(question: Column) -> Column:
    """Whether a question opens in one of the plain ways."""
    asked = F.lower(question)
    return F.coalesce(reduce(or_, [asked.rlike(p) for p in PLAIN]), F.lit(False))


def log_text(question: str | Column, most: int = 100) -> str | Column:
    """What a log shows of a question, a string or a column of them."""
    return F.substring(question, 1, most) if isinstance(question, Column) else question[:most]


def flattened(nested: Column, depth: int) -> Column:
    """The items of an array nested ``depth`` levels below its own, in their order; null arrays are skipped."""
    for _ in range(depth):
        nested = F.flatten(F.filter(nested, lambda x: x.isNotNull()))
    return nested


def patched(df: DataFrame, **values: object) -> DataFrame:
    """Rows with new values for the columns that there are; other names are ignored."""
    return df.withColumns({k: F.lit(v).cast(df.schema[k].dataType) for k, v in values.items() if k in df.columns})
