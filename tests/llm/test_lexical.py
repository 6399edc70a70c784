import math
import re
from collections import Counter

from taleweft.llm import lexical
from tests.oracle import assert_same, connect

TERM = re.compile(lexical.TERM)


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, best=50):
    held = [(i, terms(t)) for i, t in docs]
    held = [(i, Counter(t), len(t)) for i, t in held if t]
    total, length = len(held), sum(n for *_, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        found = []
        for doc, c, n in held:
            m = 50 + (50 * n * total) // length
            score = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if c[t])
            if score > 0:
                found.append((-score, doc is None, doc or 0, doc))
        out += [(item, k + 1, f[-1], -f[0]) for k, f in enumerate(sorted(found)[:best])]
    return sorted(out, key=repr)


def shown(df):
    return sorted(map(tuple, df.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def test_query_equals_its_sql(spark, data):
    assert_same(lexical.op13_lexical(spark, data), connect(data), lexical.OP13_SQL)


def test_windows_and_blocks_equal_brute_force(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    items = spark.read.parquet(f"{data}/benchmark.parquet")
    want = brute([(r["doc_id"], r["text"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in items.collect()], 7)
    for window, block in ((1, 1 << 20), (9, 700), (4096, 1 << 20)):
        index = lexical.build(docs.repartition(3), window=window)
        assert shown(lexical.search(index, items, best=7, block_terms=block)) == want


def test_odd_rows(spark, odd_docs, no_docs):
    """Nulls, empty and long texts, ties, repeated documents and items, clashing names."""
    docs = odd_docs.withColumnRenamed("score", "window").withColumnRenamed("lang", "term")
    rows = [(1, "ALPHA word ünïcode"), (1, "ALPHA word ünïcode"), (None, "id no"), (2, None), (3, ""), (4, "ßTRASSE Straße ßtraße"), (5, "absent")]
    items = spark.createDataFrame(rows, "item_id long, text string").selectExpr("*", "0 AS number", "1 AS rank")
    want = brute([(r["doc_id"], r["text"]) for r in odd_docs.collect()], rows)
    assert shown(lexical.search(lexical.build(docs), items)) == want
    assert lexical.search(lexical.build(no_docs), items).count() == 0
    assert lexical.search(lexical.build(docs), items.filter("false")).count() == 0


def test_terms_in_spark_and_in_tasks_agree(spark):
    text = "".join(map(chr, range(0x250))) + " A_b-9 \x00 x\x7fy É𝄞z"
    row = spark.createDataFrame([(text,)], "text string").select(lexical.terms_of("text").alias("t")).first()["t"]
    held, words, sizes, docs, counts = lexical.invert([text, "", "a \0 b a"])
    assert held.tolist() == [len(row), 0, 3] and row == terms(text)
    assert {w.as_py().decode() for w in words} == {*row, "a", "b"}
    assert sizes.sum() == len(docs) == len(counts) and counts.sum() == held.sum()
