import random
from collections import Counter

import numpy as np
import pytest

from taleweft.llm import neardup
from taleweft.llm.components import components


def test_components_equal_union_find(spark):
    rng = random.Random(2)
    edges = [(rng.randint(0, 120), rng.randint(0, 120)) for _ in range(90)] + [(200, i) for i in range(201, 260)]
    edges += [(2000, i) for i in range(1000, 1400)] + [(3000 + i, 3001 + i) for i in range(20)] + [(3005, 1100), (2000, 2000)]  # a hub of over 256 edges
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        return x if parent[x] == x else root(parent[x])

    for a, b in edges:
        if a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in parent}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_samples_agree_as_often_as_the_similarity():
    g = np.arange(1, 401, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    first = np.array([0, 300])
    w = np.random.default_rng(0).uniform(0.5, 5, 400)
    a, b = neardup.samples(g[:300], w[:300], first, 3000), neardup.samples(g[60:360], w[60:360] * 1.5, first, 3000)
    lo, hi = w.copy(), w * 1.5
    lo[300:], hi[:60], hi[360:] = 0, 0, 0
    assert (a == b).mean() == pytest.approx(np.minimum(lo, hi).sum() / np.maximum(lo, hi).sum(), abs=0.03)


def brute(rows, common=0, threshold=0.8):
    """Classes by all pairs' weighted similarity."""
    texts = [t or "" for _, t in rows]
    vectors = []
    for t in texts:
        g, c, _ = neardup.shingles([t])
        vectors.append(dict(zip(g.tolist(), c.tolist(), strict=True)))
    n, df = len(rows), Counter(x for v in vectors for x in v)
    idf = lambda x: 1 + np.log((1 + n) / (1 + max(df[x], common * n)))
    weighted = [{x: c * idf(x) for x, c in v.items()} for v in vectors]
    label = list(range(n))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    close = set()
    for i in range(n):
        for j in range(i):
            a, b = weighted[i], weighted[j]
            both = sum(min(w, b[x]) for x, w in a.items() if x in b)
            s = both / (sum(a.values()) + sum(b.values()) - both) if a or b else 0
            if abs(s - threshold) < 1e-5:
                close.add((i, j))
            if texts[i] == texts[j] or s >= threshold:
                x, y = root(i), root(j)
                label[max(x, y, key=lambda k: rows[k][0])] = min(x, y, key=lambda k: rows[k][0])
    return {rows[i][0]: rows[root(i)][0] for i in range(n)}, close


@pytest.mark.parametrize("block", [256, 6])
def test_classes_equal_all_pairs(spark, block):
    rng = random.Random(11)
    rows = []
    for base in range(12):
        text = [f"v{rng.randint(0, 900)}" for _ in range(rng.randint(3, 120))]
        for copy in range(1 + (base % 4) * 6):
            edited = list(text)
            for _ in range(rng.randint(0, max(1, len(text) // 25))):
                edited[rng.randrange(len(edited))] = f"e{rng.randint(0, 900)}"
            rows.append((len(rows), " ".join(edited) if copy else " ".join(text)))
    rows += [(1000, None), (1001, ""), (1002, rows[3][1]), (1003, "v1 v2"), (1004, "v1 v2")]
    rng.shuffle(rows)
    want, close = brute(rows)
    assert not close
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["id"]: r["class_id"] for r in neardup.classes(df, bands=30, rows=2, block=block).collect()}
    assert got == want


def test_common_shingles_are_counted_exactly(spark):
    rows = [(i, "one two three four five" + (f" x{i} y{i}" if i % 3 else "")) for i in range(200)] + [(300 + i, f"a{i} b{i} c{i} d{i} e{i}") for i in range(100)]
    texts = spark.createDataFrame(rows, "i long, __text string").select("__text").repartition(7)
    got = {r["h"]: r["df"] for r in neardup.document_frequency(texts).filter("df >= 15").collect()}
    assert got == {int(neardup.shingles(["one two three four five"])[0].view("int64")[0]): 200}


def test_one_of_each_class_stays(spark, odd_docs, no_docs):
    kept = neardup.deduplicate(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted((r["doc_id"] or -1) for r in kept.collect()) == [-1, 1, 2, 4, 5]
    assert neardup.deduplicate(no_docs).count() == 0 and neardup.classes(no_docs).count() == 0


def test_long_texts_make_blocks_of_their_own(spark, monkeypatch):
    """Components of few but long texts are compared in blocks too, with the same classes."""
    rng = random.Random(6)
    base = [f"w{rng.randint(0, 5000)}" for _ in range(900)]
    rows = [(i, " ".join(f"new{i}" if j == 50 * (i % 17) else w for j, w in enumerate(base))) for i in range(40)]
    want, close = brute(rows)
    monkeypatch.setattr(neardup, "MASS", 4000)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert not close and {r["id"]: r["class_id"] for r in neardup.classes(df, bands=30, rows=2).collect()} == want


def test_rare_shingles_weigh_by_their_own_counts(spark, monkeypatch):
    """A copy with a passage that 9 of 1,200 documents share: a link by true counts, none if df counts as 1 % at least."""
    own = " ".join(f"own{i}" for i in range(112))
    passage = " ".join(f"pas{i}" for i in range(30))
    rows = [(0, own), (1, f"{own} {passage}")] + [(2 + i, f"{passage} tail{i} " + " ".join(f"x{i}y{j}" for j in range(60))) for i in range(8)]
    rows += [(100 + i, f"a{i} b{i} c{i} d{i} e{i} f{i}") for i in range(1190)]
    want, close = brute(rows)
    assert not close and want[1] == 0 and brute(rows, common=0.01)[0][1] == 1
    monkeypatch.setattr(neardup, "BUCKET", 1 << 12)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert {r["id"]: r["class_id"] for r in neardup.classes(df, bands=30, rows=2).collect()} == want


def test_every_shingle_is_counted(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice("abc") for _ in range(rng.randint(0, 60)))) for i in range(150)]
    monkeypatch.setattr(neardup, "BUCKET", 300)
    monkeypatch.setattr(neardup, "PARTITIONS", 5)
    counted = neardup.document_frequency(spark.createDataFrame(rows, "i long, __text string").select("__text").repartition(7))
    want = Counter(x for _, t in rows for x in neardup.shingles([t])[0].view("int64").tolist())
    assert {r["h"]: r["df"] for r in counted.collect()} == want


def test_query_equals_all_pairs_with_true_counts(spark, data):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    want, close = brute(sorted(rows))
    assert not close and {r["doc_id"]: r["class_id"] for r in neardup.op7_neardup(spark, data).collect()} == want


@pytest.mark.parametrize("block", [256, 16])
def test_copies_of_a_large_group_are_found_however_many_there_are(spark, block):
    """Edits of their own outweigh what hundreds of copies share; by counts each is 0.82 to 0.85 like the first."""
    base = [f"w{j}" for j in range(250)]
    group = [(0, " ".join(base))] + [(i, " ".join(f"own{i}x{j}" if j % 50 == i % 50 and j // 50 < 4 else w for j, w in enumerate(base))) for i in range(1, 120)]
    others = [(1000 + i, " ".join(f"o{i}y{j}" for j in range(12))) for i in range(4000)]
    df = spark.createDataFrame(group + others, "doc_id long, text string").repartition(6)
    by_weight = {r["id"]: r["class_id"] for r in neardup.classes(df, bands=30, rows=2, block=block).collect()}
    assert len({by_weight[i] for i, _ in group}) > 100
    found = {r["id"]: r["class_id"] for r in neardup.classes(df, bands=30, rows=2, block=block, counts=True).collect()}
    assert {found[i] for i, _ in group} == {0} and all(found[i] == i for i, _ in others)
