"""Queries from book texts to chunks: every document is a book, with headings where its sentences end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import sentences
from ..operators import chunking
from . import tables as t
from .registry import query

SIZE, OVERLAP = 300, 20


def books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sentence's end starts a chapter whose number is the next word; a German "und" ends the book."""
    text = F.replace(F.replace("text", F.lit(". "), F.lit(".\nChapter ")), F.lit(" und "), F.lit("\nGlossary "))
    return t.documents(spark, sf_dir).select(F.concat_ws("_", "doc_id", F.concat("source", F.lit(".txt"))).alias("book_filename"), F.col("doc_id").cast("int").alias("book_number"), text.alias("text"))


WORD = r"[\p{L}\p{N}\p{M}_]"
LINES = rf"""book AS (
  SELECT doc_id || '_' || source || '.txt' AS book_filename, doc_id::INTEGER AS book_number, replace(replace(text, '. ', '.' || chr(10) || 'Chapter '), ' und ', chr(10) || 'Glossary ') AS text FROM documents
), joined AS (
  SELECT book_filename, book_number, string_split_regex(regexp_replace(text, '(?im)^\s*(CHAPTER)\s+({WORD}+)', '\1 \2', 'g'), '\r?\n') AS l FROM book
), raw AS (
  SELECT book_filename, book_number, (generate_subscripts(l, 1) - 1)::INTEGER AS line_no, regexp_replace(unnest(l), '^\s+|\s+$', '', 'g') AS raw FROM joined
), counted AS (
  SELECT *, sum(regexp_matches(raw, '(?i)^\s*CHAPTER\s+{WORD}')::INT) OVER w AS chapter_number, max(starts_with(lower(raw), 'glossary')::INT) OVER w AS ended
  FROM raw WHERE raw <> '' WINDOW w AS (PARTITION BY book_filename ORDER BY line_no)
), lines AS (
  SELECT book_filename, book_number, chapter_number::INTEGER AS chapter_number, line_no, regexp_replace(regexp_replace(raw, '(?i)^\s*CHAPTER\s+{WORD}+', ''), '^[^\p{{L}}\p{{N}}\p{{M}}_]+', '') AS line FROM counted WHERE ended = 0
), chapter AS (
  SELECT book_filename, book_number, chapter_number, string_agg(line || ' ', '' ORDER BY line_no) AS full_text FROM lines GROUP BY ALL HAVING trim(string_agg(line || ' ', '' ORDER BY line_no)) <> ''
)"""


@query("book_lines", f"WITH {LINES} SELECT * FROM lines")
def book_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of books without headings, numbered by chapter, up to the glossary."""
    return chunking.lines(books(spark, sf_dir))


@query("chapter_parse", f"WITH {LINES} SELECT * FROM chapter")
def chapter_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chapters of books as one text each."""
    return chunking.chapters(chunking.lines(books(spark, sf_dir)))


def sentences_sql(text: str) -> str:
    return rf"list_filter(string_split(regexp_replace(trim({text}), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '')"


def packed_sql(text: str, size: int, overlap: int) -> str:
    """Chunks of a text: a fold over sentences cut to length, whose state is a string with the open chunk last."""
    room = size - overlap - 1
    pieces = f"flatten(list_transform({sentences_sql(text)}, lambda s: list_transform(range(greatest((length(s) - 1) // {room}, 0) + 1), lambda i: substr(s, i * {room} + 1, {room}))))"
    last = "string_split(a, chr(2))[-1]"
    step = f"CASE WHEN length({last}) + 1 + length(s) <= {size} THEN a || ' ' || s ELSE a || chr(2) || ltrim(right({last}, {overlap}) || ' ' || s) END"
    return f"CASE WHEN len({sentences_sql(text)}) = 0 THEN []::VARCHAR[] ELSE string_split(list_reduce({pieces}, lambda a, s: {step}), chr(2)) END"


@query("sentence_pack", f"WITH p AS (SELECT doc_id, {packed_sql('text', chunking.CHUNK_SIZE, chunking.OVERLAP)} AS c FROM documents) SELECT doc_id, (generate_subscripts(c, 1) - 1)::INTEGER AS chunk_index, unnest(c) AS text FROM p")
def sentence_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chunks of whole sentences."""
    return t.documents(spark, sf_dir).select("doc_id", F.posexplode(chunking.pack(F.col("text"))).alias("chunk_index", "text"))


def position_sql(source: str, overlap: int) -> str:
    """Positions of rows (book_number, chapter_number, chunk_index, text)."""
    return f"""moved AS (
  SELECT *, length(text) - CASE WHEN lead(chunk_index) OVER (PARTITION BY book_number, chapter_number ORDER BY chunk_index) IS NULL THEN 0 ELSE {overlap} END AS step FROM {source}
), placed AS (
  SELECT *, round(sum(step) OVER (PARTITION BY book_number ORDER BY chapter_number, chunk_index) / (sum(length(text)) OVER (PARTITION BY book_number))::DOUBLE, 4) AS book_position FROM moved
)"""


@query(
    "chapter_chunks",
    f"""WITH {LINES}, packed AS (SELECT *, {packed_sql("full_text", SIZE, OVERLAP)} AS c FROM chapter),
    cut AS (SELECT book_filename, book_number, chapter_number, (generate_subscripts(c, 1) - 1)::INTEGER AS chunk_index, unnest(c) AS text FROM packed), {position_sql("cut", OVERLAP)}
    SELECT book_filename, concat('series_7|book_', book_number, '|chapter_', chapter_number, '|level_1|chunk_', chunk_index) AS chunk_key, book_position, text FROM placed""",
)
def chapter_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Books as level-1 chunks: lines, chapters, packing, keys, positions."""
    chapters = chunking.chapters(chunking.lines(books(spark, sf_dir)))
    return chunking.chapter_chunks(chapters, 7, SIZE, OVERLAP).select("book_filename", "chunk_key", "book_position", "text")


@query(
    "sentence_positions",
    f"""WITH {t.CHUNKS}, cut AS (SELECT book_number, chapter_number, doc_id, unnest({sentences_sql("text")}) AS text, (generate_subscripts({sentences_sql("text")}, 1) - 1)::INTEGER AS chunk_index FROM keyed), {position_sql("cut", 2)}
    SELECT doc_id, chunk_index, book_position FROM placed""",
)
def sentence_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions of sentences that overlap by two characters within their chapter."""
    rows = t.chunks(spark, sf_dir).select("doc_id", "book_number", "chapter_number", F.posexplode(sentences(F.col("text"))).alias("chunk_index", "text"))
    return chunking.book_position(rows, 2).select("doc_id", "chunk_index", "book_position")
