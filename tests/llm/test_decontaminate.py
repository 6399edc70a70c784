import random

import numpy as np
import pytest

from taleweft.llm import decontaminate as dc

WORDS = [f"w{i}" for i in range(400)]


def align(a, b):
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    best = 0
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if x == y else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
            best = max(best, h[i][j])
    return best


def test_alignment_equals_the_full_table():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ([rng.randint(0, 3) for _ in range(rng.randint(1, 12))] for _ in range(2))
        assert dc.align(np.array(a), np.array(b))[0] == align(a, b)


@pytest.fixture(scope="module")
def planted(spark):
    rng = random.Random(7)
    text = lambda n: [rng.choice(WORDS) for _ in range(n)]
    items = [(i, text(rng.randint(12, 40))) for i in range(12)] + [(20, ["w1", "w2"]), (21, []), (None, text(20)), (22, text(20))]
    items.append((23, items[-1][1]))  # an item twice
    docs, want = [], set()
    for d in range(80):
        body = text(rng.randint(0, 200))
        if d % 2:
            i, passage = items[d % 12]
            kind = d % 3
            part = [rng.choice(WORDS) if kind and k % 9 == 4 else w for k, w in enumerate(passage)]
            if kind == 2:
                del part[len(part) // 2]
            at = rng.randint(0, len(body))
            body[at:at] = part
            want.add((d, i))
        docs.append((d, " ".join(body).capitalize() + "."))
    docs += [(90, " ".join(items[-1][1])), (91, None), (92, "")]
    want |= {(90, 22), (90, 23)}
    rows = [(i, " ".join(w)) for i, w in items] + [(30, None)]
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(rows, "item_id long, text string"), want


def held(text, item, threshold=0.6):
    """By definition: the whole item if it's short, else the best alignment of all."""
    a, b = (dc.words([x or ""]).h for x in (item, text))
    if len(a) < 8:
        return len(a) > 0 and any((b[i : i + len(a)] == a).all() for i in range(len(b) - len(a) + 1))
    return dc.align(a, b)[0] >= threshold * 2 * len(a)


def test_planted_passages_are_found_and_nothing_else(planted):
    docs, items, want = planted
    assert {(r["doc_id"], r["item_id"]) for r in dc.hits(docs, items).collect()} == want
    every = {(d["doc_id"], i["item_id"]) for d in docs.collect() for i in items.filter("item_id IS NOT NULL").collect() if held(d["text"], i["text"])}
    assert every == want


def test_short_items_match_whole(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g"), (2, "x c, D! e"), (3, "c"), (4, "e d c"), (5, None), (6, "c d c d e")], "doc_id smallint, text string")
    items = spark.createDataFrame([("three", "c d e"), ("two", "c d"), ("one", "C"), ("none", "?!"), ("long", "b c d e f g h i j")], "item_id string, text string")
    got = {(r["doc_id"], r["item_id"], r["start"], r["end"]) for r in dc.hits(docs, items).collect()}
    want = {(1, "three", 2, 5), (1, "two", 2, 4), (1, "one", 2, 3), (1, "long", 1, 7), (2, "three", 1, 4), (2, "two", 1, 3), (2, "one", 1, 2), (3, "one", 0, 1), (4, "one", 2, 3), (6, "three", 2, 5), (6, "two", 0, 2), (6, "one", 0, 1)}
    assert got == want
    assert [r["doc_id"] for r in dc.clean(docs, items).collect()] == [5]


def test_places_are_where_the_alignment_runs(spark):
    item = [f"i{k}" for k in range(20)]
    body = ["x"] * 7 + item[:8] + ["new"] * 2 + item[8:13] + item[15:] + ["y"] * 5
    docs = spark.createDataFrame([(1, " ".join(body))], "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(item))], "item_id tinyint, text string").withColumn("doc_id", dc.F.lit(0))
    (r,) = dc.hits(docs.withColumn("item_id", dc.F.lit("old")), items).collect()
    assert (r["start"], r["end"]) == (7, 7 + 8 + 2 + 5 + 5)


def test_recall_of_edited_copies(spark):
    """Copies with a fifth of their words replaced, dropped or doubled, against all alignments."""
    rng = random.Random(12)
    text = lambda n: [rng.choice(WORDS) for _ in range(n)]
    items = [(i, text(rng.randint(15, 40))) for i in range(15)]
    docs = []
    for d in range(150):
        part = []
        for w in items[d % 15][1]:
            x = rng.random()
            part += [rng.choice(WORDS)] if x < 0.1 else [] if x < 0.15 else [w, w] if x < 0.2 else [w]
        docs.append((d, " ".join(text(rng.randint(0, 60)) + part + text(rng.randint(0, 60)))))
    rows = [(i, " ".join(w)) for i, w in items]
    want = {(d, i) for d, t in docs for i, x in rows if held(t, x)}
    got = {(r["doc_id"], r["item_id"]) for r in dc.hits(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(rows, "item_id long, text string")).collect()}
    assert len(want) > 40 and got <= want and len(got) >= 0.95 * len(want)


def test_blocks_of_the_benchmark_agree(planted):
    docs, items, want = planted
    assert {(r["doc_id"], r["item_id"]) for r in dc.hits(docs, items, block_words=50).collect()} == want


def test_clean_keeps_the_rest(planted):
    docs, items, want = planted
    assert {r["doc_id"] for r in dc.clean(docs, items).collect()} == {r["doc_id"] for r in docs.collect()} - {d for d, _ in want}


def test_query_against_all_alignments(spark, data):
    docs = {r["doc_id"]: dc.words([r["text"] or ""]).h for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    items = {r["item_id"]: dc.words([r["text"]]).h for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()}
    got = {(r["doc_id"], r["item_id"]) for r in dc.op2_decontaminate(spark, data).collect()}
    want = set()
    for d, t in docs.items():
        for i, x in items.items():
            if np.isin(x, t).mean() >= 0.6 and dc.align(x, t)[0] >= 0.6 * 2 * len(x):  # a score needs that many equal words
                want.add((d, i))
    assert want and got == want


def test_odd_rows(odd_docs, no_docs, spark):
    items = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta eta theta")], "item_id long, text string")
    assert [r["doc_id"] for r in dc.hits(odd_docs, items).orderBy("doc_id").collect()] == [1, 1, 6]
    assert dc.clean(odd_docs, items).count() == 5
    assert dc.hits(no_docs, items).count() == 0 and dc.hits(odd_docs, items.filter("false")).count() == 0
    assert dc.clean(odd_docs, items.filter("false")).count() == 8
