import re

import pytest
from pyspark.sql import functions as F

from taleweft import providers
from taleweft.functions import text as tx
from taleweft.operators import catalog, chunking, conversation, hierarchy
from taleweft.operators.predicates import ContextFilters, apply_filters, before_chapter, predicate
from taleweft.plans import tables as t
from taleweft.plans import ask as asking
from taleweft.plans.ask import NO_ANSWER, Library, ask
from taleweft.plans.facade import Storyteller, check_request
from taleweft.plans.ingest import ingest, semantic_chunks, store
from taleweft.sources import config, readers, writers
from taleweft.streaming.sessions import lifetimes


@pytest.fixture(scope="module")
def guarded(spark):
    rows = [(b, c, None if (b, c) == (2, 1) else (c + 1) / 4) for b in (1, 2, 3) for c in range(4)]
    return spark.createDataFrame(rows, "book_number int, chapter_number int, book_position double")


def places(df):
    return sorted((r["book_number"], r["chapter_number"]) for r in df.collect())


def test_chapter_guard_hides_the_current_chapter(guarded):
    assert places(guarded.filter(before_chapter(2, 2))) == [(1, 0), (1, 1), (1, 2), (1, 3), (2, 0), (2, 1)]


def test_position_wins_and_null_positions_are_hidden(guarded):
    f = ContextFilters(book_number=2, chapter_number=0, book_position=0.6)
    assert places(guarded.filter(predicate(f))) == [(1, 0), (1, 1), (1, 2), (1, 3), (2, 0)]


def test_specific_point_has_no_earlier_books(guarded):
    assert places(guarded.filter(predicate(ContextFilters(book_number=2, chapter_number=2, specific_point=True)))) == [(2, 0), (2, 1)]


def test_missing_chapter_is_an_error():
    with pytest.raises(ValueError, match="chapter"):
        predicate(ContextFilters(book_number=2))


def test_unknown_filters_are_ignored():
    assert ContextFilters.of(level=2, entities=["x"]) == ContextFilters(level=2)


def test_key_parts(spark):
    df = spark.createDataFrame([(None, 2, None, 1, 0), (3, 11, 0, 1, 1)], "s int, b int, c int, l int, i int")
    got = [r[0] for r in df.select(tx.chunk_key(*(F.col(x) for x in "sbcli"))).collect()]
    assert got == ["series_None|book_2|level_1|chunk_0", "series_3|book_11|chapter_0|level_1|chunk_1"]


def test_small_columns(spark):
    row = spark.range(1).select(
        tx.bullets(F.array(F.struct(F.lit("a").alias("id"), F.lit("x").alias("doc")))).alias("b"), tx.context_block(F.array(F.lit("p"), F.lit("q"))).alias("c"),
        tx.edge_list(F.lit("a,b")).alias("e"), tx.edge_list(F.lit("")).alias("n"), tx.simple_question(F.lit("What were the odds")).alias("s"),
    ).first()
    assert row["b"] == "- a: x"
    assert row["c"] == '"""\np"""\nq"""'
    assert row["e"] == ["a", "b"] and row["n"] == [] and row["s"]


@pytest.fixture(scope="module")
def tree(spark):
    edges = spark.createDataFrame([("a", "m", 2), ("b", "m", 2), ("b", "n", 2), ("m", "r", 3), ("n", "r", 3)], "child_key string, parent_key string, level int")
    nodes = spark.createDataFrame([(k,) for k in "abcmnr"], "chunk_key string")
    return nodes, edges


def found(df):
    return sorted(r[0] for r in df.collect())


def test_descent_shares_and_recursive_query(spark, tree):
    nodes, edges = tree
    start = nodes.filter("chunk_key = 'r'")
    assert found(hierarchy.descend(start, edges)) == ["a", "b", "m", "n", "r"]
    assert found(hierarchy.descend(start, edges, leaves_only=True)) == ["a", "b"]
    edges.createOrReplaceTempView("e"), start.createOrReplaceTempView("s")
    assert found(spark.sql(hierarchy.descend_sql("e", "s"))) == ["a", "b", "m", "n", "r"]


def test_roots_and_flags(tree):
    nodes, edges = tree
    assert found(hierarchy.roots(nodes, edges)) == ["c", "r"]
    flags = {r["chunk_key"]: (r["is_summary"], r["parents"]) for r in hierarchy.with_edges(nodes, edges).collect()}
    assert flags["m"] == (True, ["r"]) and flags["b"] == (False, ["m", "n"])
    with pytest.raises(ValueError, match="edges"):
        apply_filters(nodes, ContextFilters(top_level_only=True))


def test_chapters_of_a_small_book(spark, tmp_path):
    (tmp_path / "01_small.txt").write_text(t.BOOK)
    (tmp_path / "notes.txt").write_text("CHAPTER 1\nskipped")
    lines = chunking.lines(readers.read_books(spark, str(tmp_path)))
    got = {(r["book_number"], r["chapter_number"]): r["full_text"] for r in chunking.chapters(lines).collect()}
    assert got == {(1, 0): "A word before. ", (1, 1): " Été» came late. It rained. Nobody minded. ", (1, 2): "The Ford They crossed. They rested? They slept! "}


def brute_pack(text, size, overlap):
    room = size - overlap - 1
    sentences = [x for x in re.sub(r"([.!?])[ \t\n\x0b\f\r]+", "\\1\u0001", text.strip(" ")).split("\u0001") if x]
    out, held = [], ""
    for s in (s[i : i + room] for s in sentences for i in range(0, len(s), room)):
        if not held:
            held = s
        elif len(held) + 1 + len(s) <= size:
            held += " " + s
        else:
            out.append(held)
            held = (held[-overlap:] + " " + s).lstrip(" ")
    return [*out, held] if held else out


def test_pack_equals_brute_force(spark, data):
    rows = spark.read.parquet(f"{data}/documents.parquet").select("text", chunking.pack(F.col("text"), 300, 20).alias("p")).collect()
    assert all(len(c) <= 300 for r in rows for c in r["p"])
    assert all(r["p"] == brute_pack(r["text"], 300, 20) for r in rows)
    assert spark.range(1).select(chunking.pack(F.lit("")).alias("p")).first()["p"] == []


def test_positions_count_overlap_once(spark):
    rows = [(1, 0, 0, "x" * 100), (1, 0, 1, "x" * 60), (1, 1, 0, "x" * 40), (2, 0, 0, "x" * 10)]
    df = chunking.book_position(spark.createDataFrame(rows, "book_number int, chapter_number int, chunk_index int, text string"), 20)
    assert {(r[0], r[1], r[2]): r["book_position"] for r in df.collect()} == {(1, 0, 0): 0.4, (1, 0, 1): 0.7, (1, 1, 0): 0.9, (2, 0, 0): 1.0}


def test_merge_small_joins_the_more_similar(spark):
    rows = [(1, 0, "A. B. C. D", [1.0, 0.0]), (1, 1, "x", [0.9, 0.1]), (1, 2, "E. F. G. H", [0.0, 1.0]), (2, 0, "only", [1.0, 1.0])]
    out = chunking.merge_small(spark.createDataFrame(rows, "chapter int, segment int, text string, embedding array<double>"), ["chapter"])
    assert sorted((r["chapter"], r["segment"], r["text"]) for r in out.collect()) == [(1, 0, "A. B. C. D x"), (1, 1, "E. F. G. H"), (2, 0, "only")]


def test_chapter_chunks_have_keys(spark):
    chapters = spark.createDataFrame([("01_b.txt", 1, 2, "One. Two. " * 40)], "book_filename string, book_number int, chapter_number int, full_text string")
    rows = chunking.chapter_chunks(chapters, 7, 100, 10).orderBy("chunk_index").collect()
    assert rows[0]["chunk_key"] == "series_7|book_1|chapter_2|level_1|chunk_0" and len(rows) > 3
    assert [r["book_position"] for r in rows] == sorted(r["book_position"] for r in rows)


def test_conversation_round_trip(spark, tmp_path):
    now = F.lit("2024-01-01 00:00:00").cast("timestamp")
    new = spark.createDataFrame([("c", 0, "q", "r"), ("c", 1, "q2", "r2")], "conversation_id string, sequence int, question string, response string")
    none = new.withColumns({"detected_entities": F.array().cast("array<string>"), "context": F.lit(None).cast("array<struct<chunk_id:string,book_number:int,chapter_number:int,chunk:string>>")})
    writers.append_conversation(none, str(tmp_path / "c"), now)
    later = F.lit("2024-01-01 00:59:00").cast("timestamp")
    assert [r["question"] for r in readers.read_conversation(spark, str(tmp_path / "c"), "c", later).collect()] == ["q", "q2"]
    assert readers.read_conversation(spark, str(tmp_path / "c"), "c", F.lit("2024-01-01 01:00:01").cast("timestamp")).count() == 0
    grown = conversation.append_turns(new, spark.createDataFrame([("c", 0, "q3", "r3")], new.schema))
    assert [r["sequence"] for r in grown.orderBy("sequence").collect()] == [0, 1, 2]
    assert '"question":"q"' in conversation.log(new).first()["turns"]
    with pytest.raises(ValueError):
        conversation.valid_id("nope")


def test_chunk_tree_round_trip(spark, tmp_path):
    rows = [("01_b.txt", 1, c, 1, i, f"text {c} {i}", f"k{c}{i}") for c in (0, 1) for i in range(2)] + [("02_b.txt", 2, 0, 2, 0, "no first level", "z")]
    df = spark.createDataFrame(rows, "book_filename string, book_number int, chapter_number int, level int, chunk_index int, text string, chunk_key string")
    writers.write_chunk_tree(df, str(tmp_path / "tree"))
    back = readers.read_chunk_tree(spark, str(tmp_path / "tree"))
    assert sorted(r["chunk_key"] for r in back.collect()) == ["k00", "k01", "k10", "k11"]
    row = back.filter("chunk_key = 'k11'").first()
    assert (row["chapter"], row["level_name"], row["text"], row["chunk_index"]) == ("chapter_1", "level_1", "text 1 1", 1)


def test_upsert_and_null_check(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, 1), ("a", 1, 1), ("b", 1, 1)], "chunk_key string, series_id int, book_number int")
    have = spark.createDataFrame([("b",)], "chunk_key string")
    writers.append_new(df, have, str(tmp_path / "s"))
    assert [r["chunk_key"] for r in spark.read.parquet(str(tmp_path / "s")).collect()] == ["a"]
    writers.check_complete(df)
    with pytest.raises(ValueError, match="book_number"):
        writers.check_complete(df.withColumn("book_number", F.lit(None).cast("int")))


def test_feedback_file(spark, tmp_path):
    df = spark.createDataFrame([("r1", "good", "up", "2024-03-01")], "request_id string, feedback string, kind string, ts string").withColumn("ts", F.to_timestamp("ts"))
    writers.append_feedback(df, str(tmp_path / "f"))
    assert spark.read.text(str(tmp_path / "f")).first()["value"] == "r1|good|up"


SERIES_ROWS = [
    {
        "series_id": 1, "series_name": "The Salt Roads", "series_metadata_name": "salt_roads", "base_characters": [],
        "entity_settings": {"names_to_skip": ["Mother"], "person_titles": ["Captain", "Dame"]},
        "books": [
            {"number_in_series": 1, "title": "A Lantern at Low Tide", "book_metadata_name": "01_lantern", "number_of_chapters": 12},
            {"number_in_series": 2, "title": "The Glass Harbour", "book_metadata_name": "02_harbour", "number_of_chapters": 15, "cover_image": "harbour.png"},
        ],
    },
    {
        "series_id": 2, "series_name": "Hollow Crown Street", "series_metadata_name": "hollow_crown",
        "books": [{"number_in_series": 1, "title": "Number Nine", "book_metadata_name": "01_nine", "number_of_chapters": 7}],
    },
]


def test_series_and_characters(spark, tmp_path):
    series = readers.read_series(spark, SERIES_ROWS)
    assert [tuple(r["entity_settings"]) for r in series.orderBy("series_id").collect()] == [(["Mother"], ["Captain", "Dame"]), ([], [])]
    assert catalog.find_series(series, "hollow_crown").first()["series_id"] == 2
    assert catalog.find_series(series, "none").count() == 0
    assert "entity_settings" not in catalog.series_json(series).first()["json"]
    (tmp_path / "c.json").write_text('{"c1": {"name": "Ann", "aliases": ["A"], "summaries": {"1": {"2": ["born", "left"]}}}}')
    named, told = readers.read_characters(spark, str(tmp_path / "c.json"))
    assert named.first()["aliases"] == ["Ann", "A"]
    assert catalog.add_summaries(told).first()["summaries"] == ["born", "left"]
    more = spark.createDataFrame([("c1", "Ann", ["B", "A"]), ("c2", "Zed", None)], "character_id string, name string, aliases array<string>")
    assert {r["name"]: r["aliases"] for r in catalog.add_aliases(named, more).collect()} == {"Ann": ["Ann", "A", "B"], "Zed": ["Zed"]}


def test_lifetimes_on_table_and_stream(spark, tmp_path):
    rows = [("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 00:30:00"), ("a", "2024-01-01 02:00:00"), ("b", "2024-01-01 00:10:00"), ("b", "2024-01-03 00:10:00")]
    df = spark.createDataFrame(rows, "conversation_id string, ts string").withColumn("ts", F.to_timestamp("ts"))
    assert sorted((r[0], r["writes"]) for r in lifetimes(df).collect()) == [("a", 1), ("a", 2), ("b", 1), ("b", 1)]
    df.write.parquet(str(tmp_path / "in"))
    stream = lifetimes(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("lives").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable(), q.stop()
    assert sorted((r[0], r["writes"]) for r in spark.table("lives").collect()) == [("a", 1), ("a", 2), ("b", 1)]


def test_ask_answers_or_says_so(spark):
    chunks = spark.createDataFrame([("series_1|book_1|chapter_0|level_1|chunk_0", 1, 1, 0, 1, False, "the lighthouse was dark", providers.embed_query("the lighthouse was dark"))], "chunk_key string, series_id int, book_number int, chapter_number int, level int, is_summary boolean, text string, embedding array<double>")
    library = Library(chunks, spark.createDataFrame([], "child_key string, parent_key string, level int"))
    got = ask(library, "was the lighthouse dark", ContextFilters(series_id=1, book_number=2, chapter_number=0))
    assert got.text == "Book 1, Chapter 0: the lighthouse was dark" and got.has_answer and got.contexts.count() == 1
    none = ask(library, "lighthouse", ContextFilters(series_id=1, book_number=1, chapter_number=0))
    assert (none.text, none.has_answer, none.needs_clarification) == (NO_ANSWER, False, False)

    class Asks(providers.LocalDecisions):
        def clarify(self, question):
            return "Which lighthouse?"

    asked = ask(library, "lighthouse", ContextFilters(series_id=1, book_number=1, chapter_number=0), Asks())
    assert asked.needs_clarification and asked.text == NO_ANSWER + "\n\n\nWhich lighthouse?"


def test_ingest_and_store(spark, tmp_path):
    words = "The tide came in. The lamp was lit. Nobody spoke of the harbour. "
    (tmp_path / "03_b.txt").write_text("Before.\nCHAPTER 1\n" + words * 40)
    done = ingest(spark, str(tmp_path / "03_b.txt"), 5, size=200, overlap=20, dim=3, most=3)
    rows = {r["chunk_key"]: r for r in done.chunks.collect()}
    assert "series_5|book_3|chapter_1|level_1|chunk_0" in rows and any(r["level"] == 2 and r["is_summary"] for r in rows.values())
    assert all(k in rows for r in rows.values() for k in [*r["parents"], *r["children"]])
    store(done, 5, str(tmp_path / "store")), store(done, 5, str(tmp_path / "store"))
    kept = spark.read.parquet(str(tmp_path / "store"))
    assert kept.count() == len(rows) and kept.filter("document <> lower(full_chunk)").count() == 0


def test_semantic_chunks_cut_where_topics_change(spark):
    rows = [(1, i, f"s{i}. a. b. c", [1.0, 0.01 * i] if i < 6 else [0.0, 1.0]) for i in range(12)]
    out = semantic_chunks(spark.createDataFrame(rows, "chapter int, i int, text string, embedding array<float>"), ["chapter"], "i")
    assert [r["text"].split(".")[0] for r in out.orderBy("segment").collect()] == ["s0", "s6"]


def test_settings(tmp_path):
    (tmp_path / "p.json").write_text('{"greet": [{"role": "system", "prompt": "hi"}]}')
    (tmp_path / "s.json").write_text("[]")
    values = {k: 1 for k in config.REQUIRED} | {"PROMPTS_PATH": str(tmp_path / "p.json"), "SERIES_PATH": str(tmp_path / "s.json"), "N_CHUNKS": 15}
    got = config.Settings.of(values)
    assert got.n_chunks == 15 and got.prompt("greet") == [{"role": "system", "content": "hi"}]
    with pytest.raises(KeyError):
        got.prompt("other")
    assert config.Settings.of(values, sparse=True).prompts == {}
    with pytest.raises(ValueError, match="N_CHUNKS, REDIS_EXPIRE"):
        config.Settings.of({k: v for k, v in values.items() if k not in ("N_CHUNKS", "REDIS_EXPIRE")})


def test_yaml_settings(spark, tmp_path):
    pytest.importorskip("yaml")
    text = """# settings
N_CHUNKS: 15   # how many
SERIES_PATH: '{0}/series.yml'
PROMPTS_PATH: "{0}/prompts.yml"
REDIS_EXPIRE: 86400
COMPLETION_TEMPERATURE: 0.5
OTHER_URL: 'redis://localhost:6379/0'
"""
    (tmp_path / "c.yml").write_text(text.replace("{0}", str(tmp_path)))
    (tmp_path / "series.yml").write_text("""- series_id: 1
  series_name: 'The Salt''s Roads'
  series_metadata_name: salt_roads
  entity_settings:
    names_to_skip:
      - 'light'
      - my dear
    person_titles: [doctor, 'dame']
  books:
    - number_in_series: 1
      title: "A Lantern: at Low Tide"
      book_metadata_name: 01_lantern
      number_of_chapters: 12
    - number_in_series: 2
      title: Second
- series_id: 2
  series_name: Other
  books: []
""")
    (tmp_path / "prompts.yml").write_text("greet:\n  - role: system\n    prompt: >\n      You help\n      readers.\n\n      # Goal\n      Be {kind}.\n  - role: user\n    prompt: |\n      a\n        b\nother:\n- role: x\n  prompt: y\n")
    got = config.Settings.from_file(tmp_path / "c.yml")
    assert (got.n_chunks, got.ttl_seconds, got.values["COMPLETION_TEMPERATURE"], got.values["OTHER_URL"]) == (15, 86400, 0.5, "redis://localhost:6379/0")
    rows = got.series_frame(spark).orderBy("series_id").collect()
    assert rows[0]["series_name"] == "The Salt's Roads" and tuple(rows[0]["entity_settings"]) == (["light", "my dear"], ["doctor", "dame"])
    assert [b["title"] for b in rows[0]["books"]] == ["A Lantern: at Low Tide", "Second"] and rows[1]["books"] == []
    assert got.prompt("greet") == [{"role": "system", "content": "You help readers.\n# Goal Be {kind}.\n"}, {"role": "user", "content": "a\n  b\n"}]
    assert got.prompt("other") == [{"role": "x", "content": "y"}]


def test_matrix_page():
    assert "<td>a&lt;b</td><td></td>" in writers.matrix_html([{"question": "a<b", "book_1": None}])


def test_hashed_embedding_is_the_same_on_both_sides(spark):
    got = spark.range(1).select(providers.hashed_embedding()(F.lit("A b a")).alias("v")).first()["v"]
    assert got == pytest.approx(providers.embed_query("A b a"), abs=1e-6)


def test_prompt_order():
    got = providers.fill_prompt([{"role": "system", "content": "{raw}"}, {"role": "user", "content": "{q}"}], [{"role": "user", "content": "old"}], {"q": "new"})
    assert [m["content"] for m in got] == ["{raw}", "old", "new"]


def test_levels_build_a_tree(spark):
    import numpy as np

    from taleweft.operators.cluster import levels

    rng = np.random.default_rng(1)
    rows = [(f"series_1|book_1|chapter_0|level_1|chunk_{i}", 1, 1, 0, 1, i, f"t{i}", i / 40, (rng.normal(size=8) + 6 * (i % 2)).tolist()) for i in range(40)]
    df = spark.createDataFrame(rows, "chunk_key string, series_id int, book_number int, chapter_number int, level int, chunk_index int, text string, book_position double, embedding array<float>")
    everything, edges = levels(df, providers.keep_text, providers.hashed_embedding(8), dim=4, most=4)
    links = edges.collect()
    assert len({r["child_key"] for r in links}) == len(links)  # one parent at most
    assert everything.filter("level > 1").count() == len({r["parent_key"] for r in links})
    assert everything.filter(~tx.complete_key(F.col("chunk_key"))).count() == 0


@pytest.mark.parametrize("parts", [1, 7])
def test_running_sums_in_any_layout(spark, parts):
    import random

    from taleweft.operators.running import running

    rng = random.Random(parts)
    rows = [(rng.choice(["a", "a", "a", "b", None]), i, rng.randint(0, 9)) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, i long, x long").repartition(parts)
    got = {r["i"]: (r["s"], r["s_total"], r["n"]) for r in running(df.withColumn("one", F.lit(1)), ["g"], ["i"], {"s": "x", "n": "one"}).collect()}
    for g, i, _ in rows:
        same = [(j, x) for h, j, x in rows if h == g]
        assert got[i] == (sum(x for j, x in same if j <= i), sum(x for _, x in same), sum(j <= i for j, _ in same))


@pytest.mark.parametrize("parts", [2, 9])
def test_one_hot_group_is_split_over_ranges(spark, parts):
    """Neighbours, percentiles and segments of a group that holds most rows equal a fold over it, whatever the ranges; null groups too."""
    import random

    import numpy as np

    from taleweft.operators.running import percentile, with_next

    rng = random.Random(parts)
    rows = [(rng.choice(["hot"] * 8 + ["b", None]), i, [rng.random() + 0.1, rng.random()]) for i in range(300)] + [("alone", 1000, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "g string, i long, embedding array<double>").repartition(3)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        groups = {g: sorted((i, v) for h, i, v in rows if h == g) for g in {r[0] for r in rows}}
        nxt = {(r["g"], r["i"]): r["n"] and r["n"]["i"] for r in with_next(df, ["g"], "i", ["i"], "n").collect()}
        assert nxt == {(g, i): after for g, mine in groups.items() for (i, _), after in zip(mine, [j for j, _ in mine[1:]] + [None], strict=True)}
        assert with_next(df, ["g"], "i", ["i"]).groupBy("g").agg(F.count("*").alias("n")).count() == 4
        got = {r["g"]: r["p"] for r in percentile(df.withColumn("x", F.when(F.col("i") < 1000, F.col("i") % 17 + 0.5)), ["g"], "x", 0.95, "p").collect()}
        assert got == {g: pytest.approx(np.quantile([i % 17 + 0.5 for i, _ in mine if i < 1000], 0.95)) if g != "alone" else None for g, mine in groups.items()}
        told = {(r["g"], r["i"]): r["segment"] for r in chunking.segments(df, ["g"], "i").collect()}
        far = lambda a, b: 1 - np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b)
        for g, mine in groups.items():
            steps = [far(a, b) for (_, a), (_, b) in zip(mine, mine[1:], strict=False)]
            cut = np.quantile(steps, 0.95) if steps else 0
            assert [told[g, i] for i, _ in mine] == [sum(s > cut for s in steps[:k]) for k in range(len(mine))]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_a_cluster_without_a_shared_folder_is_an_error(spark):
    from types import SimpleNamespace

    from taleweft.sources.workspace import work_dir

    away = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(ValueError, match="checkpoint"):
        work_dir(away)


def test_sentence_context_splits_a_text_once(spark):
    import time

    text = "A short one. " * 40_000
    began = time.perf_counter()
    rows = spark.createDataFrame([(text,)], "text string").select(F.explode(chunking.sentence_context(F.col("text"))).alias("c"))
    assert rows.agg(F.count("*"), F.max(F.length("c"))).first() == (40_000, 38)
    assert time.perf_counter() - began < 20


def test_a_distance_needs_two_rows(spark):
    one = spark.createDataFrame([(1, 0, [1.0]), (1, 1, [2.0]), (2, 0, [1.0])], "g int, i int, embedding array<double>")
    with pytest.raises(ValueError, match="two rows"):
        chunking.adjacent_distance(one, ["g"], "i", need_two=True)
    assert chunking.adjacent_distance(one.filter("g = 1"), ["g"], "i", need_two=True).count() == 2


def test_headings_of_all_scripts(spark):
    book = spark.createDataFrame([("1_b.txt", 1, "before\nChapter Élan\nafter")], "book_filename string, book_number int, text string")
    assert {r["chapter_number"]: r["full_text"] for r in chunking.chapters(chunking.lines(book)).collect()} == {0: "before ", 1: " after "}


def a_library(spark):
    texts = ["the lighthouse was dark", "the harbour slept", "a lamp in the lighthouse", "nobody rowed"]
    key = lambda c, level=1, i=0: f"series_1|book_{1 + c // 2}|chapter_{c % 2}|level_{level}|chunk_{i}"
    rows = [(key(c), 1, 1 + c // 2, c % 2, 1, False, text, providers.embed_query(text)) for c, text in enumerate(texts)]
    rows.append((key(0, 2), 1, 1, 0, 2, True, "the coast in an overview", providers.embed_query("the coast in an overview")))
    chunks = spark.createDataFrame(rows, "chunk_key string, series_id int, book_number int, chapter_number int, level int, is_summary boolean, text string, embedding array<double>")
    return Library(chunks, spark.createDataFrame([(key(0), key(0, 2), 2), (key(1), key(0, 2), 2)], "child_key string, parent_key string, level int"))


class Chooses(providers.LocalDecisions):
    def __init__(self, similar=True, by_meaning=True):
        super().__init__()
        self.similar, self.by_meaning = similar, by_meaning

    def prefer_similar(self, question, similar, keyword):
        return self.similar

    def strategy(self, question):
        return "exact", self.by_meaning


def test_results_are_chosen_and_cut(spark):
    library, everything = a_library(spark), ContextFilters(series_id=1, book_number=9, chapter_number=0)
    choose = lambda d, n=5, gated=False: asking.choose(library, "lighthouse the", everything, d, n, gated)
    assert len(choose(Chooses())) == 5  # similarity finds all
    words = choose(Chooses(by_meaning=False))
    assert words[:2] == ["series_1|book_1|chapter_0|level_1|chunk_0", "series_1|book_2|chapter_0|level_1|chunk_0"] and len(words) == 4
    assert choose(Chooses(similar=False), 2) == words[:2]
    assert choose(Chooses(by_meaning=False), 1, gated=True) == words[:2]  # a batch is scored whole


def test_relevance_gate_and_replies(spark):
    from taleweft.operators import relevance

    key = "series_1|book_1|chapter_0|level_1|chunk_0"
    replies = ['{"chunk_scores": [{"chunk_id": "%s", "score": 6}, {"chunk_id": "x", "score": 9}, {"chunk_id": "%s", "score": 5}], "secondary_query": null}' % (key, key), "not json", '{"chunk_scores": [{"chunk_id": 3}]}', '{"other": 1}']
    assert [relevance.passed(r) for r in replies] == [[key], [], [], []]
    df = spark.createDataFrame([(r,) for r in replies], "reply string").select(F.inline(relevance.scores(F.col("reply"))))
    assert [tuple(r) for r in relevance.gate(df, key="chunk_id").collect()] == [(key, 6)]
    asked = []
    score = lambda part: asked.append(len(part)) or '{"chunk_scores": [%s]}' % ",".join('{"chunk_id": "%s", "score": 7}' % k for k, _ in part[:4])
    assert len(relevance.in_batches([(key, "t")] * 45, score, 7)) == 8 and asked == [10, 10]


def test_a_point_in_the_question_moves_the_guard(spark):
    d = providers.LocalDecisions()
    reader = ContextFilters(series_id=1, book_number=1, chapter_number=1)
    assert d.temporal("who first rowed").order == "chronological" and d.temporal("where is it now").order == "reverse"
    point = asking.at_moment(reader, d.temporal("what happens in book 2 chapter 1"))
    assert (point.specific_point, point.book_number, point.chapter_number) == (True, 2, 1)
    assert asking.at_moment(reader, providers.Moment("specific_point", 2, 3, 0.5)) == ContextFilters(series_id=1, book_number=2, book_position=0.5, specific_point=True)
    assert asking.at_moment(reader, d.temporal("who rowed")) == reader
    library = a_library(spark)
    shown = asking.retrieve(library, "the lamp in book 2 chapter 1", reader)
    assert {(r["book_number"], r["chapter_number"]) for r in shown.collect()} == {(2, 0)}


def test_follow_ups_are_found_once(spark):
    library, cache, calls = a_library(spark), asking.ChunkCache(2), []

    class Counts(providers.LocalDecisions):
        def follow_up(self, question, history):
            calls.append(question)
            return super().follow_up(question, history)

    f = ContextFilters(series_id=1, book_number=9, chapter_number=0)
    history = [("the lighthouse", "dark")]
    for q in ("was it lit", "was it lit", "by whom", "since when", "was it lit"):
        assert len(asking.follow_up_contexts(library, q, f, history, cache, Counts(), 2)) == 2
    assert calls == ["was it lit", "by whom", "since when", "was it lit"] and len(cache.held) == 2
    assert asking.by_query(library, "the coast", f, 9, exclude_summaries=True).count() == 4
    assert asking.without_context("what is the moon") is None


def test_a_conversation_goes_on(spark, tmp_path):
    teller = Storyteller(a_library(spark), str(tmp_path))
    text, contexts, none, entities, conversation_id = teller.invoke("the lighthouse dark", 2, 0, 1)
    assert "Book 1, Chapter 0: the lighthouse was dark" in text and none is None and entities == []
    assert set(contexts.columns) == {"chunk_id", "book_number", "chapter_number", "chunk"}
    seen = []

    class Refines(providers.LocalDecisions):
        def refine(self, question, history):
            seen.append(history)
            return question

    teller.decisions = Refines()
    teller.invoke("and the harbour", 2, 0, 1, conversation_id)
    assert seen == [[("the lighthouse dark", text)]]
    turns = teller.turns(conversation_id)
    assert [(t["sequence"], t["question"]) for t in turns] == [(0, "the lighthouse dark"), (1, "and the harbour")] and turns[0]["context"][0]["chunk"]
    assert teller.cost(conversation_id) == "$0.0000" and teller.log == ["question: the lighthouse dark", "question: and the harbour"]
    assert teller.turns(conversation_id, F.lit("2999-01-01").cast("timestamp")) == []
    with pytest.raises(ValueError, match="chapter_number"):
        check_request({"question": "q", "book_number": 1, "series_id": 1})


def test_small_things(spark, tmp_path):
    df = spark.createDataFrame([([[["a"], None], None, [["b", "c"], []]], "x")], "n array<array<array<string>>>, level string")
    assert df.select(tx.flattened(F.col("n"), 2).alias("f")).first()["f"] == ["a", "b", "c"]
    assert tx.patched(df, level="y", other=1).first()["level"] == "y"
    assert len(tx.log_text("q" * 300)) == 100
    flat = spark.createDataFrame([(["k"], ["low"], [("Low", "a,b", "", 3)])], "ids array<string>, documents array<string>, metadatas array<struct<full_chunk:string,parents:string,children:string,level:int>>")
    want = {"chunk_key": "k", "text": "Low", "level": 3, "parents": ["a", "b"], "children": []}
    assert readers.from_result(flat).first().asDict() == want
    nested = flat.select(*[F.array(c).alias(c) for c in flat.columns])
    assert readers.from_result(nested, nested=True).first().asDict() == want
    assert [f.name for f in readers.as_rows(readers.from_result(flat)).schema["metadata"].dataType] == ["level", "parents", "children"]
    for day in ("2024-03-01", "2024-03-02", "2024-03-03"):
        (tmp_path / f"day={day}").mkdir()
    assert writers.prune_feedback(spark, str(tmp_path), 2) == ["2024-03-01"] and not (tmp_path / "day=2024-03-01").exists()


def test_local_decisions():
    d = providers.LocalDecisions()
    assert d.keywords("Who is the keeper of that old, old lighthouse in winter?") == ["keeper", "old", "lighthouse"]
    assert d.query("Give me a summary of book one") == ("Give me a summary of book one", True) and not d.query("who rowed")[1]
    assert d.follow_up("and then", [("first", "x"), ("who rowed", "y")]) == "who rowed and then" and d.follow_up("q", []) == "q"
    assert d.strategy('where is "the lamp"') == ("phrase", True) and d.refine("q", [("a", "b")]) == "q"
    assert d.answer("q", ["a", "b", "c", "d"]) == "a\nb\nc" and d.clarify("q") == ""


def test_ingest_command(spark, tmp_path):
    from taleweft.__main__ import main

    (tmp_path / "04_b.txt").write_text("CHAPTER 1\n" + "The tide came in. The lamp was lit. " * 30)
    main(["ingest", str(tmp_path / "*.txt"), "--series-id", "2", "--out", str(tmp_path / "store"), "--tree", str(tmp_path / "tree"), "--levels", "2"])
    kept = spark.read.parquet(str(tmp_path / "store"))
    assert kept.count() > 0 and {r["series_id"] for r in kept.select("series_id").distinct().collect()} == {2}
    assert readers.read_chunk_tree(spark, str(tmp_path / "tree")).filter("level_name = 'level_1'").count() == kept.filter("level = 1").count()
