"""Row types of the engine's tables; nothing is inferred from data."""

from __future__ import annotations

from pyspark.sql import types as T

#: Scalars that describe a chunk besides its text.
METADATA = T.StructType([
    T.StructField("series_id", T.IntegerType()),
    T.StructField("book_number", T.IntegerType()),
    T.StructField("chapter_number", T.IntegerType()),
    T.StructField("level", T.IntegerType()),
    T.StructField("chunk_index", T.IntegerType()),
    T.StructField("book_position", T.DoubleType()),
    T.StructField("book_filename", T.StringType()),
    T.StructField("full_chunk", T.StringType()),
    T.StructField("match_type", T.StringType()),
    T.StructField("matched_terms", T.ArrayType(T.StringType())),
    T.StructField("matched_phrases", T.ArrayType(T.StringType())),
    T.StructField("window_size", T.IntegerType()),
    T.StructField("threshold", T.DoubleType()),
    T.StructField("is_summary", T.BooleanType()),
])

#: One node of a stored chunk tree.
TREE_CHUNK = T.StructType([
    T.StructField("text", T.StringType()),
    T.StructField("metadata", METADATA),
    T.StructField("is_summary", T.BooleanType()),
    T.StructField("embedding", T.ArrayType(T.FloatType())),
    T.StructField("chunk_key", T.StringType()),
    T.StructField("parents", T.ArrayType(T.StringType())),
    T.StructField("children", T.ArrayType(T.StringType())),
])

#: book file -> chapter_k -> level_l -> nodes.
TREE = T.MapType(T.StringType(), T.MapType(T.StringType(), T.MapType(T.StringType(), T.ArrayType(TREE_CHUNK))))

CONTEXT = T.StructType([
    T.StructField("chunk_id", T.StringType()), T.StructField("book_number", T.IntegerType()),
    T.StructField("chapter_number", T.IntegerType()), T.StructField("chunk", T.StringType()),
])

TURNS = T.StructType([
    T.StructField("conversation_id", T.StringType()), T.StructField("sequence", T.IntegerType()), T.StructField("question", T.StringType()),
    T.StructField("response", T.StringType()), T.StructField("detected_entities", T.ArrayType(T.StringType())),
    T.StructField("context", T.ArrayType(CONTEXT)), T.StructField("ts", T.TimestampType()), T.StructField("expires_at", T.TimestampType()),
])

SERIES = T.StructType([
    T.StructField("series_id", T.IntegerType()), T.StructField("series_name", T.StringType()), T.StructField("series_metadata_name", T.StringType()),
    T.StructField("entity_settings", T.StructType([T.StructField("names_to_skip", T.ArrayType(T.StringType())), T.StructField("person_titles", T.ArrayType(T.StringType()))])),
    T.StructField("books", T.ArrayType(T.StructType([
        T.StructField("number_in_series", T.IntegerType()), T.StructField("title", T.StringType()), T.StructField("book_metadata_name", T.StringType()),
        T.StructField("number_of_chapters", T.IntegerType()), T.StructField("cover_image", T.StringType()),
    ]))),
])

#: A reply that scores chunks.
CHUNK_SCORES = T.StructType([T.StructField("chunk_scores", T.ArrayType(T.StructType([T.StructField("chunk_id", T.StringType()), T.StructField("score", T.IntegerType())]))), T.StructField("secondary_query", T.StringType())])
