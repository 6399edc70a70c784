"""Queries over what is written and read back, and over the small forms of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import bullets, flattened, log_text, patched, simple_question
from ..functions.vectors import squared_l2
from ..operators import catalog as shelf
from ..operators import conversation, hierarchy
from ..sources import readers, writers
from ..sources.workspace import work_dir
from ..streaming.sessions import lifetimes
from . import tables as t
from .ask import as_context
from .registry import query


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("read_books", "SELECT n_nationkey || '_' || lower(replace(n_name, ' ', '-')) || '.txt' AS book_filename, n_nationkey::INTEGER AS book_number, n_name || chr(10) || n_regionkey AS text FROM nation WHERE n_nationkey % 5 <> 4")
def read_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Book files by a glob; each fifth has a name without a number and is skipped. The table of nations has 25 rows at any size."""
    folder = f"{work_dir(spark)}/books"
    make = spark._jvm.org.apache.hadoop.fs.Path
    files = make(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    for r in _table(spark, sf_dir, "nation").collect():
        name = f"{r['n_nationkey']}_{r['n_name'].lower().replace(' ', '-')}.txt" if r["n_nationkey"] % 5 != 4 else f"note-{r['n_nationkey']}.txt"
        out = files.create(make(f"{folder}/{name}"))
        out.write(bytearray(f"{r['n_name']}\n{r['n_regionkey']}".encode()))
        out.close()
    return readers.in_file_order(readers.read_books(spark, f"{folder}/*.txt"))


@query(
    "chunk_tree_round_trip",
    f"""WITH {t.POSITIONED} SELECT 'book_' || book_number AS book_file, 'chapter_' || chapter_number AS chapter, 'level_1' AS level_name, chunk_key, text, book_number, chapter_number, book_position FROM positioned""",
)
def chunk_tree_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All chunks written as compressed trees, a line for each book, and read back."""
    path = f"{work_dir(spark)}/tree"
    rows = t.chunks(spark, sf_dir).drop("tokens").withColumns({"book_filename": F.concat(F.lit("book_"), "book_number"), "full_chunk": F.col("text")})
    writers.write_chunk_tree(rows, path)
    return readers.read_chunk_tree(spark, path).select("book_file", "chapter", "level_name", "chunk_key", "text", "book_number", "chapter_number", "book_position")


@query("store_round_trip", f"WITH {t.CHUNKS} SELECT chunk_key, lower(text) AS document, text AS full_chunk, book_number FROM keyed WHERE doc_id % 7 = 3")
def store_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks normalised, checked for nulls and appended twice to a store, which keeps each once; then some are fetched by id."""
    path = f"{work_dir(spark)}/store"
    none = F.array().cast("array<string>")
    rows = t.chunks(spark, sf_dir).drop("tokens").withColumns({"parents": none, "children": none, "book_filename": F.concat(F.lit("book_"), "book_number")})
    ready = writers.check_complete(writers.normalised(rows, 1))
    writers.append_new(ready, ready.filter("false"), path)
    kept = spark.read.parquet(path)
    writers.append_new(ready, kept.select("chunk_key"), path)
    wanted = rows.filter("doc_id % 7 = 3").select("chunk_key")
    return readers.by_ids(spark.read.parquet(path), wanted).select("chunk_key", "document", "full_chunk", "book_number")


@query("result_rows", f"WITH {t.CHUNKS} SELECT shape, chunk_key, text, book_number, chapter_number, 'a,b' AS parents, 0::INTEGER AS n_children FROM keyed, (VALUES ('flat'), ('nested')) v(shape)")
def result_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunk rows from store results, of a chapter's chunk each: flat as of a fetch, nested as of a search."""
    meta = F.struct("book_number", "chapter_number", F.col("text").alias("full_chunk"), F.lit("a,b").alias("parents"), F.lit("").alias("children"))
    flat = t.chunks(spark, sf_dir).select(F.array("chunk_key").alias("ids"), F.array(F.lower("text")).alias("documents"), F.array(meta).alias("metadatas"))
    nested = flat.select(*[F.array(c).alias(c) for c in flat.columns])
    both = [readers.from_result(df, n).withColumn("shape", F.lit(name)) for name, df, n in (("flat", flat, False), ("nested", nested, True))]
    return both[0].unionByName(both[1]).select("shape", "chunk_key", "text", "book_number", "chapter_number", F.array_join("parents", ",").alias("parents"), F.size("children").alias("n_children"))


@query("id_document_rows", f"WITH {t.CHUNKS} SELECT chunk_key AS id, text AS document, lang, chapter_number FROM keyed")
def id_document_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.as_rows(t.chunks(spark, sf_dir)).select("id", "document", "metadata.lang", "metadata.chapter_number")


@query("chunk_json", f"WITH {t.CHUNKS} SELECT chunk_key, json_object('chunk_key', chunk_key, 'text', text, 'metadata', json_object('book_number', book_number, 'chapter_number', chapter_number, 'level', level, 'window_size', NULL))::VARCHAR AS json FROM keyed")
def chunk_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks as JSON, nulls of their metadata included."""
    rows = t.chunks(spark, sf_dir).withColumn("window_size", F.lit(None).cast("int"))
    return rows.select("chunk_key", writers.chunk_json(rows, ("book_number", "chapter_number", "level", "window_size")).alias("json"))


@query("contexts", f"WITH {t.CHUNKS} SELECT chunk_key AS chunk_id, book_number, chapter_number, text AS chunk FROM keyed")
def contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_context(t.chunks(spark, sf_dir))


@query("metadata_patch", f"WITH {t.CHUNKS} SELECT chunk_key, 2::INTEGER AS level, 'und' AS lang FROM keyed")
def metadata_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New values for known columns; an unknown name changes nothing."""
    return patched(t.chunks(spark, sf_dir), level=2, lang="und", entities="x").select("chunk_key", "level", "lang")


@query("flattened_words", r"SELECT doc_id, string_split(text, ' ') AS words FROM documents")
def flattened_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All words of documents, from arrays two levels deep: pairs of words, one in each array of the next level. A null text has none."""
    w = F.split("text", " ", -1)
    pairs = F.transform(F.sequence(F.lit(1), F.size("w"), F.lit(2)), lambda i: F.array(F.slice("w", i, 2)))
    return t.documents(spark, sf_dir).select("doc_id", w.alias("w")).select("doc_id", F.when(F.col("w").isNotNull(), flattened(pairs, 2)).alias("words"))


@query("bullet_lists", "SELECT e.label, string_agg('- ' || d.doc_id || ': ' || d.text, chr(10) ORDER BY d.doc_id::VARCHAR) AS bullets FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id GROUP BY e.label")
def bullet_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of each label as a bullet list."""
    rows = t.documents(spark, sf_dir).join(t.vectors(spark, sf_dir).select(F.col("vec_id").alias("doc_id"), "label"), "doc_id")
    pairs = F.array_sort(F.collect_list(F.struct(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("doc"))))
    return rows.groupBy("label").agg(bullets(pairs).alias("bullets"))


@query(
    "edge_arrays",
    f"""WITH {t.TREE}, up AS (SELECT child_key AS chunk_key, string_agg(DISTINCT parent_key, ',' ORDER BY parent_key) AS parents FROM edge GROUP BY 1), down AS (SELECT parent_key AS chunk_key, string_agg(DISTINCT child_key, ',' ORDER BY child_key) AS children FROM edge GROUP BY 1)
    SELECT n.chunk_key, n.is_summary, coalesce(parents, '') AS parents, coalesce(children, '') AS children FROM node n LEFT JOIN up USING (chunk_key) LEFT JOIN down USING (chunk_key)""",
)
def edge_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes with their edges, joined by commas as a store keeps them; a summary is a node with children."""
    nodes, edges = t.label_tree(spark, sf_dir)
    rows = hierarchy.with_edges(nodes, edges)
    return rows.select("chunk_key", "is_summary", F.array_join("parents", ",").alias("parents"), F.array_join("children", ",").alias("children"))


OPENED = "CASE turn % 4 WHEN 0 THEN 'What is the ' WHEN 1 THEN 'Could you explain ' WHEN 2 THEN 'Now tell me about ' ELSE 'TELL ME what ' END || text"


@query("simple_questions", f"SELECT conv_id, turn, regexp_matches(lower({OPENED}), '^what (is|are|was|were) the|^(can|could) you explain|^tell me (about|what)') AS simple FROM conversations")
def simple_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which messages, opened in four ways, are plain questions."""
    return t.messages(spark, sf_dir).select("conv_id", "turn", simple_question(F.expr(OPENED)).alias("simple"))


@query("question_logs", "SELECT conv_id, turn, substr(text, 1, 100) AS shown FROM conversations WHERE role = 'user'")
def question_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.messages(spark, sf_dir).filter("role = 'user'").select("conv_id", "turn", log_text(F.col("text")).alias("shown"))


@query("conversation_log", f"WITH {t.TURNS} SELECT conversation_id, to_json(list({{'sequence': sequence, 'question': question, 'response': response}} ORDER BY sequence))::VARCHAR AS turns FROM turns GROUP BY 1")
def conversation_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation as a JSON array of its turns."""
    return conversation.log(conversation.turns(t.messages(spark, sf_dir)))


@query("appended_turns", f"WITH {t.TURNS} SELECT * FROM turns")
def appended_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The later turns of each conversation appended to its first two, numbered on from them."""
    rows = conversation.turns(t.messages(spark, sf_dir))
    return conversation.append_turns(rows.filter("sequence < 2"), rows.filter("sequence >= 2"))


@query("live_turns", "WITH e AS (SELECT user_id, event_id, max(floor(epoch(ts))::BIGINT + 3600) OVER (PARTITION BY user_id) AS until FROM events) SELECT user_id, event_id FROM e WHERE until > 1706530000")
def live_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes of the conversations that haven't expired, from a store of writes with the times they expire."""
    events = _table(spark, sf_dir, "events").withColumn("expires_at", F.timestamp_seconds(F.unix_seconds(F.col("ts").cast("timestamp")) + conversation.TTL_SECONDS))
    return readers.live(events, F.timestamp_seconds(F.lit(1706530000)), "user_id").select("user_id", "event_id")


@query(
    "conversation_lifetimes",
    """WITH e AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts > lag(ts) OVER w + INTERVAL 3600 SECOND THEN 1 ELSE 0 END AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT user_id, ts, sum(opens) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS life FROM e)
    SELECT user_id, epoch_us(min(ts)) AS opened, epoch_us(max(ts)) + 3600000000 AS expires, count(*) AS writes FROM s GROUP BY user_id, life""",
)
def conversation_lifetimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lives of conversations: every write renews the time to live."""
    events = _table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return lifetimes(events, conversation="user_id").select("user_id", F.unix_micros("opened_at").alias("opened"), F.unix_micros("expires_at").alias("expires"), "writes")


@query("feedback_lines", "SELECT strftime(ts, '%Y-%m-%d') AS day, event_id || '|' || event_type || '|' || user_id AS value FROM events")
def feedback_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a feedback log, written in a folder per day and read back."""
    path = f"{work_dir(spark)}/feedback"
    rows = _table(spark, sf_dir, "events").select("ts", F.col("event_id").cast("string").alias("request_id"), F.col("event_type").alias("feedback"), F.col("user_id").cast("string").alias("kind"))
    writers.append_feedback(rows, path)
    return spark.read.schema("value string, day string").text(path).select(F.col("day").cast("string").alias("day"), "value")


@query("cost_lines", f"WITH {t.TURNS}, s AS (SELECT conversation_id, sum(length(response)) AS c, sum(length(question)) AS p FROM turns GROUP BY 1) SELECT conversation_id, printf('$%.4f', p / 1e6 * 0.15 + c / 1e6 * 0.60) AS cost FROM s")
def cost_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each conversation cost, as text, with characters for tokens."""
    sums = conversation.turns(t.messages(spark, sf_dir)).groupBy("conversation_id").agg(F.sum(F.length("response")).alias("c"), F.sum(F.length("question")).alias("p"))
    return sums.select("conversation_id", conversation.cost_text(conversation.cost(F.col("c"), F.col("p"))).alias("cost"))


PART_SERIES = """book AS (SELECT substr(p_brand, 7)::INTEGER AS series_id, p_brand AS series_name, lower(replace(p_brand, '#', '_')) AS series_metadata_name,
row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey)::INTEGER AS number_in_series, p_name AS title, concat('book_', p_partkey) AS book_metadata_name, p_size AS number_of_chapters FROM part)"""


@query(
    "series_json",
    f"""WITH {PART_SERIES} SELECT series_id, to_json({{series_id: series_id, series_name: series_name, series_metadata_name: series_metadata_name,
    books: list({{number_in_series: number_in_series, title: title, book_metadata_name: book_metadata_name, number_of_chapters: number_of_chapters, cover_image: NULL::VARCHAR}} ORDER BY number_in_series)}})::VARCHAR AS json
    FROM book GROUP BY series_id, series_name, series_metadata_name""",
)
def series_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalog's public part, a series a line."""
    return shelf.series_json(t.series(spark, sf_dir))


@query("series_catalog", f"WITH {PART_SERIES} SELECT series_id, series_name, series_metadata_name, number_in_series, title, number_of_chapters FROM book")
def series_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series written as JSON lines and read back, a row a book."""
    path = f"{work_dir(spark)}/series"
    shelf.series_json(t.series(spark, sf_dir)).select(F.col("json").alias("value")).write.text(path)
    return shelf.books(readers.series_of(spark.read.text(path))).select("series_id", "series_name", "series_metadata_name", "number_in_series", "title", "number_of_chapters")


@query(
    "series_by_name",
    f"""WITH {PART_SERIES}, asked AS (SELECT p_brand AS asked FROM part WHERE p_size > 25 UNION SELECT lower(replace(p_brand, '#', '_')) FROM part UNION SELECT n_name FROM nation)
    SELECT asked, min(series_id) AS series_id FROM asked JOIN book ON asked = series_name OR asked = series_metadata_name GROUP BY asked""",
)
def series_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series by name or metadata name; a name that none has, such as a nation's, gives no row."""
    part = _table(spark, sf_dir, "part")
    asked = part.filter("p_size > 25").select(F.col("p_brand").alias("name")).union(part.select(F.lower(F.replace("p_brand", F.lit("#"), F.lit("_"))))).union(_table(spark, sf_dir, "nation").select("n_name"))
    return shelf.find_all_series(t.series(spark, sf_dir), asked)


@query(
    "character_lookup",
    """WITH known AS (SELECT p_partkey AS o, 'p' || p_partkey AS character_id, p_name AS found, unnest([lower(p_name), lower(p_brand), 'part ' || p_partkey]) AS a FROM part),
    asked AS (SELECT upper(p_name) AS asked FROM part UNION SELECT p_brand FROM part UNION SELECT 'PART ' || o_custkey FROM orders UNION SELECT n_name FROM nation),
    ranked AS (SELECT asked, character_id, found, row_number() OVER (PARTITION BY asked ORDER BY o) AS n FROM asked JOIN known ON lower(asked) = a)
    SELECT asked, character_id, found FROM ranked WHERE n = 1""",
)
def character_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as characters in order of their keys, with their brands and numbers as aliases; names of customers' numbers and nations are asked too."""
    part = _table(spark, sf_dir, "part")
    known = part.select(F.concat(F.lit("p"), "p_partkey").alias("character_id"), F.col("p_name").alias("name"), F.array(F.col("p_brand"), F.concat(F.lit("Part "), "p_partkey")).alias("aliases"), "p_partkey")
    names = part.select(F.upper("p_name").alias("name")).union(part.select("p_brand")).union(_table(spark, sf_dir, "orders").select(F.concat(F.lit("PART "), "o_custkey"))).union(_table(spark, sf_dir, "nation").select("n_name"))
    return shelf.find_characters(known, names, order="p_partkey")


@query("character_aliases", "SELECT 'r' || r_regionkey AS character_id, r_name AS name, array_to_string(list_concat([r_name, lower(r_name)], list(n_name ORDER BY n_name)), ',') AS aliases FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey, r_name")
def character_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions as characters to whom the names of their nations are added as aliases."""
    regions = _table(spark, sf_dir, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("character_id"), F.col("r_name").alias("name"), F.array("r_name", F.lower("r_name")).alias("aliases"))
    nations = _table(spark, sf_dir, "nation").select(F.concat(F.lit("r"), "n_regionkey").alias("character_id"), F.array("n_name").alias("aliases")).join(regions.select("character_id", "name"), "character_id")
    return shelf.add_aliases(regions, nations.select("character_id", "name", "aliases")).select("character_id", "name", F.array_join("aliases", ",").alias("aliases"))


@query("character_summaries", "SELECT conv_id::VARCHAR AS character_id, (turn // 3)::INTEGER AS book, (turn % 2)::INTEGER AS chapter, string_agg(text, '|' ORDER BY turn) AS summaries FROM conversations GROUP BY ALL")
def character_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages as summaries of their speaker, by book and chapter."""
    rows = t.messages(spark, sf_dir).select(F.col("conv_id").cast("string").alias("character_id"), F.expr("cast(turn div 3 as int)").alias("book"), F.expr("cast(turn % 2 as int)").alias("chapter"), F.col("turn").alias("position"), F.col("text").alias("summary"))
    return shelf.add_summaries(rows).select("character_id", "book", "chapter", F.array_join("summaries", "|").alias("summaries"))


@query("read_characters", "SELECT 'r' || r_regionkey AS character_id, n_nationkey::INTEGER AS book, (n_nationkey % 3)::INTEGER AS chapter, 0 AS position, n_name AS summary FROM region JOIN nation ON n_regionkey = r_regionkey")
def read_characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A character file, made of the five regions and their nations, read back as summaries."""
    path = f"{work_dir(spark)}/characters"
    told = _table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.map_from_entries(F.collect_list(F.struct(F.col("n_nationkey").cast("string"), F.create_map(F.expr("cast(n_nationkey % 3 as string)"), F.array("n_name"))))).alias("summaries"))
    people = _table(spark, sf_dir, "region").join(told, F.col("n_regionkey") == F.col("r_regionkey"))
    one = people.agg(F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("r"), "r_regionkey"), F.struct(F.col("r_name").alias("name"), F.array(F.lit("x")).alias("aliases"), "summaries")))).alias("m"))
    one.select(F.to_json("m").alias("value")).write.text(path)
    return readers.read_characters(spark, path)[1]


@query(
    "cluster_inertia",
    """WITH v AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), c AS (SELECT label AS centre, i, avg(x) AS m FROM v GROUP BY ALL),
    d AS (SELECT vec_id, centre, sum((x - m) * (x - m)) AS d FROM v JOIN c USING (i) GROUP BY ALL), n AS (SELECT vec_id, min(d) AS d FROM d GROUP BY 1)
    SELECT count(*) AS members, round(sum(d), 4) AS inertia FROM n""",
)
def cluster_inertia(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Squared distances of all vectors to the nearest of their labels' centres. A centre per label (ten) comes to the driver."""
    v = t.vectors(spark, sf_dir)
    means = v.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    centres = means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda p: p["m"]).alias("c")).orderBy("label").collect()
    nearest = F.array_min(F.array(*[squared_l2(F.col("embedding"), F.array(*map(F.lit, r["c"]))) for r in centres]))
    return v.select(nearest.alias("d")).agg(F.count("*").alias("members"), F.round(F.sum("d"), 4).alias("inertia"))


@query(
    "segment_texts",
    """WITH adj AS (SELECT label, vec_id, CASE WHEN nxt IS NOT NULL THEN 1 - list_inner_product(embedding::DOUBLE[], nxt::DOUBLE[]) / (sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_inner_product(nxt::DOUBLE[], nxt::DOUBLE[]))) END AS distance
    FROM (SELECT *, lead(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS nxt FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents))), cut AS (SELECT label, quantile_cont(distance, 0.95) AS cut FROM adj GROUP BY label),
    seg AS (SELECT a.label, vec_id, coalesce(sum((distance > cut)::INT) OVER (PARTITION BY a.label ORDER BY vec_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INTEGER AS segment FROM adj a JOIN cut c ON c.label = a.label)
    SELECT label, segment, string_agg(text, ' ' ORDER BY vec_id) AS text FROM seg JOIN documents d ON d.doc_id = seg.vec_id GROUP BY ALL""",
)
def segment_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Semantic chunks of the documents of each label, in order of id: cut where neighbours differ most, none joined."""
    from .ingest import semantic_chunks

    rows = t.documents(spark, sf_dir).join(t.vectors(spark, sf_dir).withColumnRenamed("vec_id", "doc_id"), "doc_id").select("label", "doc_id", "text", "embedding")
    return semantic_chunks(rows, ["label"], "doc_id", least=0).select("label", "segment", "text")
