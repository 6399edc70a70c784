import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from taleweft.llm import bpe


@pytest.fixture(scope="module")
def tokenizer():
    return bpe.Tokenizer.load()


@pytest.fixture(scope="module")
def library(tokenizer):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.parse(tokenizer.file), special_tokens={})


def packed(ids):
    return np.array(ids, "<u4").tobytes()


def test_query_equals_the_library(spark, data, library):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    rows = bpe.op11_bpe(spark, data).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(packed(ids)).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_white_space_and_odd_pieces_equal_the_library(tokenizer, library):
    rng = random.Random(3)
    alphabet = [" ", " ", "  ", "\n", "\t", "a", "the", "'s", "é", "1", "!", " ", "\x1c", "中文", "x" * 70, "　", "\r\n", "<|endoftext|>", "՘", "\U0003d000"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(12))) for _ in range(2000)]
    texts += ["", " ", "a" * 40_000, " " * 40_000, "ab" * 20_000, "".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0xD7FF), rng.randrange(0x10000, 0x10FFFF)])) for _ in range(20_000))]
    assert list(tokenizer.encode(texts)) == [packed(library.encode_ordinary(t)) for t in texts]


def brute(piece, ranks):
    """Look at all pairs after every merge."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while True:
        found = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ranks]
        if not found:
            return [ranks[p] for p in parts]
        i = min(found)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_tree_and_forest_merge_as_brute_force(tokenizer):
    ranks, rng = bpe.parse(tokenizer.file), random.Random(5)
    pieces = [bytes(rng.choice(b"aeinrst \xc3\xa9") for _ in range(rng.randrange(1, 64))) for _ in range(500)]
    forest = bpe.PairForest(ranks).merged(pieces)
    assert forest == [packed(brute(p, ranks)) for p in pieces] == [packed(bpe.merged(p, ranks)) for p in pieces]
    assert bpe.PairForest(ranks).merged([]) == []


def test_another_vocabulary_and_pattern():
    tokens = [bytes([i]) for i in range(256)] + [b"ab", b"abc", b"bc"]
    made = bpe.Tokenizer(b"\n".join(base64.b64encode(t) + b" %d" % i for i, t in enumerate(tokens)), pattern=r"[a-z]+|[^a-z]+")
    assert [np.frombuffer(x, "<u4").tolist() for x in made.encode(["abc bc", "ab"])] == [[257, 32, 258], [256]]
    assert made.decode(np.array([257, 32, 258])) == b"abc bc"
    with pytest.raises(ValueError):
        bpe.parse(b"YQ== 0")
    with pytest.raises(ValueError):
        made.decode(np.array([-1]))


def test_odd_rows_round_trip(spark, odd_docs, no_docs):
    coded = bpe.encode(odd_docs.withColumnRenamed("score", "ids"))
    assert dict(coded.dtypes)["ids"] == "array<int>"
    rows = bpe.decode(coded, into="back").collect()
    assert len(rows) == 8 and all(r["back"] == (r["text"] or "") for r in rows)
    assert bpe.encode(no_docs).count() == 0
    both = bpe.round_trip(odd_docs.withColumnRenamed("score", "ids"), "text").collect()
    assert len(both) == 8 and "text" not in both[0].asDict() and sorted(bytes(r["decoded"]).decode() for r in both) == sorted(r["text"] or "" for r in rows)


def test_memory_of_pieces_is_bounded(tokenizer, library, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 50)
    monkeypatch.setattr(bpe, "GROUP", 200)
    fresh = bpe.Tokenizer(tokenizer.file)
    texts = [f"word{i} other{i * 7} {'y' * 80}{i} end." for i in range(100)]
    assert list(fresh.encode(texts)) == [packed(library.encode_ordinary(t)) for t in texts]
    known = fresh._encoder()
    assert len(known.pieces) < 400 and len(known.words) < 400 and not any(len(w) > 64 for w in known.words)
