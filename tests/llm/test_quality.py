import zlib

import numpy as np
import pytest

from taleweft.llm import quality
from taleweft.llm.textkit import grams, words


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    rows = {r["doc_id"]: r for r in quality.op4_quality(spark, sf).collect()}
    assert len(rows) == 1000
    for i, r in rows.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    labels = [(r["doc_id"], r["quality"]) for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if rows[r["doc_id"]]["held_out"]]
    right = [rows[i]["predicted"] == y for i, y in labels]
    assert np.mean(right) > 0.93
    good = [rows[i]["predicted"] for i, y in labels if y == 1]
    assert np.mean(good) > 0.98


def test_training_is_repeatable(spark, data):
    docs, labels = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "labels"))
    a, b = (quality.train(d, labels, max_train=50) for d in (docs, docs.repartition(5)))
    x = quality.features(["some text", ""])
    assert a.score(x) == pytest.approx(b.score(x))


def test_odd_rows(spark, odd_docs, no_docs):
    model = quality.Model()
    rows = quality.classify(odd_docs, model).collect()
    assert len(rows) == 8 and all(r["score"] == 0.5 for r in rows)
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (3, None)], "doc_id long, quality int")
    quality.train(odd_docs, labels)
    assert quality.train(no_docs, labels.filter("false")).score(np.zeros((1, len(quality.FEATURES)))) == pytest.approx([0.5])
    assert quality.classify(no_docs, model).count() == 0


def test_features_of_small_texts():
    x = quality.features(["", "A b! A b!\n$$ 12", "ÄÖ ä"])
    f = dict(zip(quality.FEATURES, x[1], strict=True))
    assert not x[0].any()
    assert (f["words"], f["lines"], f["bare_symbols"]) == pytest.approx((np.log1p(6), 1 / 6, 1 / 6))
    assert f["distinct"] == pytest.approx(3 / 5) and f["top_word"] == pytest.approx(2 / 5)
    assert x[2][quality.FEATURES.index("upper")] == pytest.approx(2 / 3)


def test_interaction_is_learned():
    rng = np.random.default_rng(0)
    x = rng.uniform(-1, 1, (3000, 4))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    m = quality.fit(x, y)
    assert (1, 0) in m.pairs and ((m.score(x) > 0.5) == y).mean() > 0.9


def test_words_of_a_batch():
    w = words(["Hello, wörld hello", "", "a b\n"])
    assert w.first.tolist() == [0, 3, 3, 5] and w.h[0] == w.h[2] != w.h[1]
    one = words(["xx yy zz aa bb"])
    two = words(["q", "yy zz aa"])
    assert grams(one, 3)[0][1] == grams(two, 3)[0][0]
