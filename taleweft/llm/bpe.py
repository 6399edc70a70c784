"""Byte-level BPE by a segment tree over byte positions, and back.

A text is cut by the vocabulary's pattern; a piece that is itself a token is that token, and
every other is merged from its bytes. A leaf of the tree stands for a byte position and
holds the rank of the pair that the live symbol there makes with the next live one, and the
root tells the leftmost pair of least rank. A merge ends one symbol and changes two pairs
beside it, so it costs three point updates of logarithmic depth: a piece of n bytes takes
O(n log n) whatever it holds, megabytes without a white space too.

Texts are encoded where they lie, nothing is shuffled, and a lost task is simply run again.
Pieces recur, so each Python worker remembers those it has merged, in a memory of bounded
size; that changes no result.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, texts_of

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: A vocabulary goes out with the tasks, so its file may have so many bytes at most.
MAX_VOCABULARY = 64 << 20
#: A worker remembers about so many pieces and words of at most so many bytes; such pieces are merged side by side.
REMEMBERED = 1 << 18
SHORT = 64
#: Texts are encoded in groups of so many characters, or one by one where longer.
GROUP = 1 << 20
# Code points that became letters or digits after Unicode 16, which the tiktoken library goes by.
NEWER = """
558 58B-58C 88F C5C CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 10EC5-10EC7 10ED9-10EEE 11B0A 11DB0-11DDB
11DE0-11DE9 11DF1 1246F 12475-1247F 12550-12686 16EA0-16EB8 16EBB-16ED3 16FF2-16FF6 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191
191A0-191D2 1B123-1B128 1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4
1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F
"""
SHIFT = 40  # a leaf is rank << SHIFT | position
NONE = (1 << 63) - 1


class PairTree:
    """Minimum over leaves ``rank << SHIFT | position``: the root is the leftmost pair of least rank."""

    def __init__(self, leaves: list[int]):
        self.first = 1 << max(0, len(leaves) - 1).bit_length()
        self.nodes = array("q", [NONE]) * (2 * self.first)
        self.nodes[self.first : self.first + len(leaves)] = array("q", leaves)
        for i in range(self.first - 1, 0, -1):
            self.nodes[i] = min(self.nodes[2 * i], self.nodes[2 * i + 1])

    def least(self) -> int:
        return self.nodes[1]

    def set(self, at: int, value: int) -> None:
        nodes, i = self.nodes, at + self.first
        nodes[i] = value
        while i > 1:
            other = nodes[i ^ 1]
            value = other if other < value else value
            i >>= 1
            if nodes[i] == value:  # nothing changes further up
                return
            nodes[i] = value


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of a piece: always the leftmost pair of least rank is merged next."""
    n = len(piece)
    if n < 2:
        return [ranks[piece]] if n else []
    none = NONE >> SHIFT
    tree = PairTree([ranks.get(piece[i : i + 2], none) << SHIFT | i for i in range(n - 1)] + [NONE])
    after, before = array("q", range(1, n + 1)), array("q", range(-1, n))
    while True:
        least = tree.least()
        if least >> SHIFT >= none:
            break
        at = least & ((1 << SHIFT) - 1)
        gone = after[at]
        end = after[gone]  # the symbol at ``at`` reaches up to here now
        after[at], before[end] = end, at
        tree.set(gone, NONE)
        tree.set(at, ranks.get(piece[at : after[end]], none) << SHIFT | at if end < n else NONE)
        if (left := before[at]) >= 0:
            tree.set(left, ranks.get(piece[left:end], none) << SHIFT | left)
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : after[i]]])
        i = after[i]
    return ids


class PairForest:
    """Trees as PairTree of many short pieces side by side: each round does the next merge of all of them."""

    def __init__(self, ranks: dict[bytes, int]):
        self.single = np.array([ranks[bytes([i])] for i in range(256)], np.int64)
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        self.pairs = np.array(sorted(pairs), np.int64)
        self.made = np.array([pairs[k] for k in self.pairs.tolist()], np.int64)

    def _leaf(self, left: np.ndarray, right: np.ndarray, at: np.ndarray) -> np.ndarray:
        if not len(self.pairs):
            return np.full(len(at), NONE)
        key = left << 32 | right
        near = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[near] == key, self.made[near] << SHIFT | at, NONE)

    def merged(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece (of a byte at least) as little-endian 32-bit integers, in the order given."""
        out: list[bytes] = [b""] * len(pieces)
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        raw = np.frombuffer(b"".join(pieces), np.uint8)
        firsts = np.cumsum(sizes) - sizes
        widths = 1 << np.ceil(np.log2(np.maximum(sizes, 1))).astype(np.int64)
        for width in np.unique(widths).tolist():
            members = np.flatnonzero(widths == width)
            for start in range(0, len(members), step := max(1, (1 << 18) // width)):
                some = members[start : start + step]
                ids, counts = self._level(raw, firsts[some], sizes[some], width)
                packed, begin = ids.astype("<u4").tobytes(), 0
                for i, end in zip(some.tolist(), (4 * np.cumsum(counts)).tolist(), strict=True):
                    out[i] = packed[begin:end]
                    begin = end
        return out

    def _level(self, raw: np.ndarray, firsts: np.ndarray, sizes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Merge pieces of at most ``width`` bytes (a power of two), each a run of ``raw``."""
        n = len(sizes)
        place = np.tile(np.arange(width), n)
        ids = self.single[raw[np.minimum(np.repeat(firsts, width) + place, len(raw) - 1)]]
        alive = place < np.repeat(sizes, width)
        after, before = place + 1, place - 1
        tree = np.full((n, 2 * width), NONE)
        leaves = np.flatnonzero(place < np.repeat(sizes - 1, width))
        flat = tree.reshape(-1)
        flat[leaves // width * 2 * width + width + place[leaves]] = self._leaf(ids[leaves], ids[np.minimum(leaves + 1, len(ids) - 1)], place[leaves])
        half = width >> 1
        while half:
            tree[:, half : 2 * half] = np.minimum(tree[:, 2 * half : 4 * half : 2], tree[:, 2 * half + 1 : 4 * half : 2])
            half >>= 1
        rows = np.arange(n)

        def raise_from(row: np.ndarray, at: np.ndarray, value: np.ndarray) -> None:
            base, i = row * 2 * width, at + width
            flat[base + i] = value
            while i[0] > 1:  # all leaves are equally deep
                i = i >> 1
                flat[base + i] = np.minimum(flat[base + 2 * i], flat[base + 2 * i + 1])

        while True:
            least = tree[rows, 1]
            going = least < NONE
            rows, least = rows[going], least[going]
            if not len(rows):
                break
            base = rows * width
            at = least & ((1 << SHIFT) - 1)
            gone = after[base + at]
            end = after[base + gone]
            ids[base + at] = least >> SHIFT  # a token's id is its rank
            alive[base + gone] = False
            after[base + at] = end
            raise_from(rows, gone, np.full(len(rows), NONE))
            more = end < sizes[rows]
            before[(base + end)[more]] = at[more]
            value = np.full(len(rows), NONE)
            value[more] = self._leaf(ids[(base + at)[more]], ids[(base + end)[more]], at[more])
            raise_from(rows, at, value)
            left = before[base + at]
            has = left >= 0
            if has.any():
                raise_from(rows[has], left[has], self._leaf(ids[(base + left)[has]], ids[(base + at)[has]], left[has]))
        return ids[alive], alive.reshape(n, width).sum(axis=1)


class _Known:
    """Ids, packed, of the pieces and words that a worker has met, within bounds.

    A word is what lies between two single spaces, and stands for itself and the space before
    it: with the usual pattern its pieces are the same wherever it is, so a known word needs
    no matching. One that is empty or begins or ends with white space depends on its
    neighbours and is None.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: regex.Pattern):
        self.ranks, self.pattern, self.forest = ranks, pattern, PairForest(ranks)
        self.pieces: dict[str, bytes] = {}
        self.words: dict[str, bytes | None] = {}
        self.passing_pieces: list[str] = []
        self.passing_words: list[str] = []

    def forget(self) -> None:
        """Long pieces and words aren't kept beyond the texts they came with."""
        for known, passing in ((self.pieces, self.passing_pieces), (self.words, self.passing_words)):
            for x in passing:
                known.pop(x, None)
            passing.clear()
            if len(known) > REMEMBERED:
                known.clear()

    def learn_pieces(self, wanted: set[str]) -> dict[str, bytes]:
        """Ids of all pieces wanted, and maybe of others."""
        known, ranks = self.pieces, self.ranks
        new = list(wanted.difference(known))
        raws = [piece.encode() for piece in new]
        short = [i for i, raw in enumerate(raws) if len(raw) <= SHORT]
        whole = {raw: ranks[raw].to_bytes(4, "little") for raw in ranks.keys() & raws}  # a piece that is a token is that token
        merge = [i for i in short if raws[i] not in whole]
        known.update(zip((new[i] for i in merge), self.forest.merged([raws[i] for i in merge]), strict=True))
        known.update((new[i], whole[raws[i]]) for i in short if raws[i] in whole)
        long = [i for i, raw in enumerate(raws) if len(raw) > SHORT]
        known.update((new[i], whole.get(raws[i]) or np.array(merged(raws[i], ranks), "<u4").tobytes()) for i in long)
        self.passing_pieces += [new[i] for i in long]
        return known

    def learn_words(self, wanted: set[str]) -> dict[str, bytes | None]:
        """Ids of all words wanted, and maybe of others."""
        new = wanted.difference(self.words)
        alone = {word: self.pattern.findall(" " + word) for word in new if not (word[:1].isspace() or word[-1:].isspace()) and word}
        ids = self.learn_pieces(set().union(*alone.values())).__getitem__
        fresh = dict.fromkeys(new)
        for word, found in alone.items():
            fresh[word] = ids(found[0]) if len(found) == 1 else b"".join(map(ids, found))
        self.words.update(fresh)
        self.passing_words += [word for word in new if len(word) > SHORT]
        return self.words

    def by_pieces(self, text: str) -> bytes:
        found = self.pattern.findall(text)
        return b"".join(map(self.learn_pieces(set(found)).__getitem__, found))

    def by_words(self, texts: list[str]) -> list[bytes]:
        split = [text.split(" ") for text in texts]
        ids = self.learn_words(set().union(*(words[1:] for words in split))).__getitem__
        starts = [self.pattern.findall(words[0]) for words in split]
        known = self.learn_pieces(set().union(*starts)).__getitem__
        out = []
        for text, first, words in zip(texts, starts, split, strict=True):
            rest = list(map(ids, words[1:]))
            lonely = None in rest or words[0][-1:].isspace() or (len(words) > 1 and not words[0])
            out.append(self.by_pieces(text) if lonely else b"".join([*map(known, first), *rest]))
        return out


def splitter(pattern: str) -> regex.Pattern:
    r"""The pattern with ``\p{L}`` and ``\p{N}`` of Unicode 16, in sets and outside."""
    newer = "".join("-".join(f"\\U{int(x, 16):08X}" for x in run.split("-")) for run in NEWER.split())
    for name in (r"\p{L}", r"\p{N}"):
        pattern = pattern.replace(name, f"[{name}--[{newer}]]")
    return regex.compile(pattern, regex.VERSION1)


def parse(ranks: bytes) -> dict[bytes, int]:
    """Tokens and ranks of a file of lines ``base64 rank``; every single byte must be a token."""
    found = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in ranks.splitlines() if line)}
    if any(bytes([i]) not in found for i in range(256)):
        raise ValueError("a byte-level vocabulary holds every single byte")
    return found


class Tokenizer:
    """Encode and decode by a vocabulary; goes out with the tasks as the bytes of its file."""

    def __init__(self, ranks: bytes, pattern: str = public_tokenizers.PATTERN):
        if len(ranks) > MAX_VOCABULARY:
            raise ValueError(f"a vocabulary of {len(ranks)} bytes is too large to go out with the tasks")
        self.file, self.pattern, self._known, self._tokens = ranks, pattern, None, None

    @classmethod
    def load(cls, path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> Tokenizer:
        """Read on the driver; executors need no copy of the file."""
        return cls(Path(path or public_tokenizers.path(VOCABULARY)).read_bytes(), pattern)

    def __getstate__(self):
        return self.file, self.pattern

    def __setstate__(self, state):
        (self.file, self.pattern), self._known, self._tokens = state, None, None

    def _encoder(self) -> _Known:
        if self._known is None:
            self._known = _Known(parse(self.file), splitter(self.pattern))
        return self._known

    def _decoder(self) -> list[bytes]:
        if self._tokens is None:
            ranks = parse(self.file)
            self._tokens = [b""] * (max(ranks.values()) + 1)
            for token, rank in ranks.items():
                self._tokens[rank] = token
        return self._tokens

    def encode(self, texts: Iterable[str]) -> Iterator[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        known = self._encoder()
        if self.pattern != public_tokenizers.PATTERN:
            for text in texts:
                yield known.by_pieces(text)
                known.forget()
            return
        held, size = [], 0
        for text in texts:
            if held and size + len(text) > GROUP:
                yield from known.by_words(held)
                known.forget()
                held, size = [], 0
            held.append(text)
            size += len(text)
        yield from known.by_words(held)
        known.forget()

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of the ids; a negative id or one that the vocabulary lacks is an error."""
        tokens = self._decoder()
        if len(ids) and int(ids.min()) < 0:
            raise ValueError("a token id is negative")
        return b"".join(map(tokens.__getitem__, ids.tolist()))


def _shared(spark: SparkSession, tokenizer: Tokenizer | None):
    return spark.sparkContext.broadcast(tokenizer or Tokenizer.load())


def encoded(spark: SparkSession, text: Column, tokenizer: Tokenizer | None = None, packed: bool = False) -> Column:
    """Token ids of a text: array<int>, or with ``packed`` their little-endian 32-bit bytes.

    Special tokens' strings are ordinary text. A null or empty text has no tokens.
    """
    shared = _shared(spark, tokenizer)

    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:
            found = list(shared.value.encode(x.as_py() or "" for x in part))
            if packed:
                yield pa.array(found, pa.binary())
            else:
                ends = np.cumsum([0, *[len(x) >> 2 for x in found]]).astype(np.int32)
                ids = np.frombuffer(b"".join(found), "<u4").astype(np.int32)
                yield pa.ListArray.from_arrays(pa.array(ends), pa.array(ids))

    run.__annotations__ = {"parts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "binary" if packed else "array<int>")(text)


def decoded(spark: SparkSession, ids: Column, tokenizer: Tokenizer | None = None, packed: bool = False) -> Column:
    """The bytes (binary) of token ids, given as array<int> or ``packed``; null gives null.

    Ids of one text may end inside a character, so cast to string only whole texts. An id
    that the vocabulary lacks, or a null among the ids, is an error.
    """
    shared = _shared(spark, tokenizer)

    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        decode = shared.value.decode
        for part in parts:
            given = (x.as_py() for x in part)
            if packed:
                yield pa.array([None if x is None else decode(np.frombuffer(x, "<u4")) for x in given], pa.binary())
            else:
                yield pa.array([None if x is None else decode(np.array(x, np.int64)) for x in given], pa.binary())

    run.__annotations__ = {"parts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "binary")(ids)


def encode(df: DataFrame, text: str = "text", into: str = "ids", tokenizer: Tokenizer | None = None) -> DataFrame:
    """All rows of ``df`` with the token ids of a text column; a column of that name is replaced.

    Nulls and empty texts give no ids, repeated rows are rows like others, no rows give none.
    """
    return df.withColumn(into, encoded(df.sparkSession, F.col(text), tokenizer))


def decode(df: DataFrame, ids: str = "ids", into: str = "decoded", tokenizer: Tokenizer | None = None) -> DataFrame:
    """All rows of ``df`` with the text of a column of ids; null where it's null."""
    return df.withColumn(into, decoded(df.sparkSession, F.col(ids), tokenizer).cast("string"))


def round_trip(df: DataFrame, text: str = "text", into: str = "ids", back: str = "decoded", tokenizer: Tokenizer | None = None) -> DataFrame:
    """All rows of ``df`` without the text, with its packed ids and the bytes that they decode to, by one worker a task.

    Rows pass in slices of bounded size. Nulls and repeated rows as in encode(); columns of the result's names are replaced.
    """
    shared = _shared(df.sparkSession, tokenizer)
    given = df.drop(*({into, back} - {text}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text):
            ids = list(shared.value.encode(texts_of(part, text)))
            whole = [shared.value.decode(np.frombuffer(x, "<u4")) for x in ids]
            kept = {name: part.column(name) for name in part.schema.names if name != text}
            yield pa.RecordBatch.from_pydict({**kept, into: pa.array(ids, pa.binary()), back: pa.array(whole, pa.binary())})

    schema = T.StructType([*(f for f in given.schema.fields if f.name != text), T.StructField(into, T.BinaryType()), T.StructField(back, T.BinaryType())])
    return given.mapInArrow(run, schema)


def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of documents encoded and decoded again; a null text counts as empty."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    both = round_trip(docs.select("doc_id", "text"))
    return both.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )
