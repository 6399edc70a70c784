import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from taleweft.llm import substring
from taleweft.llm.lyndon import suffix_array


@settings(max_examples=400, deadline=None)
@given(st.binary(max_size=40) | st.text("ab", max_size=60).map(str.encode) | st.text("abc", max_size=40).map(str.encode))
def test_suffix_array(s):
    assert suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


def brute(rows, length):
    seen, out = set(), {}
    for d, t in sorted(rows):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            w = b[i : i + length]
            if w in seen:
                gone[i : i + length] = True
            seen.add(w)
        edges = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(int)))
        out[d] = ([(int(x), int(y)) for x, y in zip(edges[::2], edges[1::2], strict=True)], bytes(np.frombuffer(b, np.uint8)[~gone]))
    return out


def cut(df, length, gram):
    return {r["doc_id"]: ([(s["start"], s["end"]) for s in r["spans"]], bytes(r["kept"])) for r in substring.deduplicate(df, length=length, gram=gram).collect()}


@pytest.mark.parametrize("part", [512, 4])
def test_equals_brute_force(spark, monkeypatch, part):
    monkeypatch.setattr(substring, "PART", part)
    rng = random.Random(part)
    word = lambda: rng.choice(["ab", "cd é", "a", "𝄞x", "bb "])
    passages = ["".join(word() for _ in range(20)) for _ in range(6)]
    rows = []
    for d in range(60):
        body = [word() for _ in range(rng.randint(0, 40))]
        for _ in range(rng.randint(0, 3)):
            body.insert(rng.randint(0, len(body)), rng.choice(passages))
        rows.append((d, "".join(body)))
    rows += [(70, None), (71, ""), (72, "a" * 200), (73, rows[0][1]), (-5, rows[1][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert cut(df, 20, 9) == brute(rows, 20)


def test_query_equals_brute_force(spark, data):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    want = brute(rows, 100)
    got = substring.op5_substring(spark, data).collect()
    assert len(got) == len(rows)
    for r in got:
        spans, kept = want[r["doc_id"]]
        size = len((dict(rows)[r["doc_id"]] or "").encode())
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (size, size - len(kept), len(spans), hashlib.sha256(kept).hexdigest())


def test_pieces_of_a_long_text(spark, monkeypatch):
    monkeypatch.setattr(substring, "PIECE", 300)
    rng = random.Random(3)
    text = "".join(rng.choice("abcdefgh") for _ in range(1500))
    rows = [(1, text), (2, text[700:1200] + "zz" + text[100:400])]
    assert cut(spark.createDataFrame(rows, "doc_id long, text string"), 20, 9) == brute(rows, 20)


def test_odd_rows(odd_docs, no_docs):
    rows = substring.deduplicate(odd_docs.withColumnRenamed("score", "kept").withColumnRenamed("lang", "spans")).collect()
    assert len(rows) == 8
    sizes = {r["doc_id"]: (r["n_bytes"], len(r["kept"])) for r in rows}
    assert sizes[1] == (35, 35) and sizes[2] == (0, 0) and sizes[5] == (150_000, 5)
    assert substring.deduplicate(no_docs).count() == 0
    with pytest.raises(ValueError):
        substring.deduplicate(odd_docs, length=10, gram=10)


def test_repeated_rows_keep_their_text(spark):
    rng = random.Random(1)
    text = "".join(rng.choice("abcdef") for _ in range(400))
    got = substring.deduplicate(spark.createDataFrame([(1, text), (1, text), (2, text)], "doc_id long, text string"))
    assert sorted((r["doc_id"], len(r["kept"])) for r in got.collect()) == [(1, 400), (1, 400), (2, 0)]


def test_different_texts_of_one_id(spark):
    """Each is a document of its own: a passage that two of them share goes once, and nothing else does."""
    rng = random.Random(2)
    text = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    passage = text(150)
    rows = [(1, text(299) + "1" + passage), (1, text(500)), (1, passage + "2" + text(39)), (None, text(200)), (None, text(199) + "3" + passage), (0, text(90))]
    got = substring.deduplicate(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert len(got) == 6 and sum(r["n_bytes"] - len(r["kept"]) for r in got) == 300
    assert [len(r["kept"]) for r in got if r["doc_id"] is None and r["n_bytes"] == 350] == [200]
    sizes = {r["n_bytes"]: len(r["kept"]) for r in got if r["doc_id"] == 1}
    assert sizes[500] == 500 and sorted((sizes[450], sizes[190])) in ([40, 450], [190, 300])
