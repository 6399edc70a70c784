import pytest
from pyspark.sql import functions as F

from taleweft.operators import postings
from taleweft.plans import shelf

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def rows_of(folder):
    rows = [(i, f"word{i} " * (i % 7), "en", f"src{i % 3}", 1) for i in range(200)]
    rows += [(None, "no id", "en", "src1", 1), (None, None, None, "src1", 1), (5, "other text of an id", "en", "src2", 1), (900, None, "en", None, 1)] + [rows[10], rows[10], rows[11]]
    return rows


@pytest.mark.parametrize("part", [40, 16 << 20])
def test_numbers_go_on_from_part_to_part(spark, tmp_path, monkeypatch, part):
    """Chapters count the distinct documents of a book by id and hash, positions their characters, wherever parts are cut."""
    monkeypatch.setattr(shelf, "PART", part, raising=False)
    rows = rows_of(tmp_path)
    spark.createDataFrame(rows, DOCS).repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    found = shelf.shelf(spark, str(tmp_path)).chunks().select("doc_id", "text", "lang", "book_number", "chapter_number", "book_position").collect()
    assert len(found) == len(rows)
    books = {"src0": 1, "src1": 2, "src2": 3, None: 4}
    h = {tuple(r["k"]): r["h"] for r in spark.createDataFrame(rows, DOCS).select(F.struct("doc_id", "text", "lang").alias("k"), F.xxhash64("text", "lang").alias("h")).collect()}
    want = []
    for source, book in books.items():
        mine = sorted({r[:3] for r in rows if r[3] == source}, key=lambda k: (k[0] is not None, k[0] or 0, h[k]))
        total, at = sum(len(k[1] or "") for k in mine), 0
        for n, k in enumerate(mine):
            at += len(k[1] or "")
            want += [(k[0], k[1] or "", k[2], book, n, round(at / total, 4) if total else None)] * sum(r[:3] == k and r[3] == source for r in rows)
    assert sorted(map(repr, (tuple(r) for r in found))) == sorted(map(repr, want))


def test_texts_are_moved_once_and_postings_never(spark, tmp_path):
    """Of the jobs that write the tables one exchange holds texts, and none holds postings."""
    spark.createDataFrame([(i, f"some words of {i}", "en", f"src{i % 3}", 1) for i in range(60)], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    kept = shelf.shelf(spark, str(tmp_path))
    plan = postings.postings(kept.chunks()).sortWithinPartitions("bucket", "token")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    files = {r["f"]: r["n"] for r in kept.chunks().groupBy(F.input_file_name().alias("f")).agg(F.count_distinct("book_number").alias("n")).collect()}
    assert len(files) == 3 and set(files.values()) == {1}


def test_neighbours_are_few_rows_a_token(spark):
    """At most a row a segment, where every deletion was one before (up to 92 a token)."""
    words = spark.createDataFrame([("abcdefghijklm"[:n], n) for n in range(1, 14)], postings.VOCABULARY)
    assert postings.neighbours(words).groupBy("token").count().agg(F.max("count")).first()[0] <= 4
