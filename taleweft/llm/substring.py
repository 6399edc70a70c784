"""Exact substring deduplication with suffix arrays of the places where copies can differ.

A byte goes if a string of ``length`` bytes that covers it also starts earlier. Strings are
not compared one by one:

1. Each string picks an anchor, the least hash among its ``gram``-byte pieces. Equal strings
   pick the same place, and neighbouring strings mostly share their anchor, so a document
   is a row per anchor: where it is and which strings picked it. (Winnowing.)
2. Rows meet by the anchor's hash, and in its order by a hash of their whole context, the
   bytes that their strings cover. Of rows with one context all but the first repeat it
   whole; those of one batch are combined before the shuffle. A context that is alone with its anchor repeats nothing.
3. What is left are different contexts of one anchor, where a copy begins, ends or was
   edited. Their bytes are fetched, and a suffix array of them, built by Lyndon grouping,
   brings equal strings next to each other; all but the first are repeats. Anchors with very
   many contexts are sorted in parts, whose distinct strings then meet by hash, reduced to
   their first place before the shuffle.
4. Each document's repeated strings are united and cut out.
"""

from __future__ import annotations

import gc
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored, without
from .lyndon import suffix_array
from .textkit import mix, powers

PIECE = 1 << 22
#: Windows that one row of repeats holds, but for its last anchor's.
MERGED = 900
PART = 512
MOST = np.uint64(0xFFFFFFFFFFFFFFFF)
LOW = np.uint64(0xFFFFFF)


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    n = len(x)
    padded = np.full((-(-n // w)) * w, MOST)
    padded[:n] = x
    rows = padded.reshape(-1, w)
    before = np.minimum.accumulate(rows, 1).ravel()
    after = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(after[: n - w + 1], before[w - 1 : n])


def anchors(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(hash, context hash, place, first string, last string) for texts ``buf[start:end]``; places are in buf."""
    n = len(buf)
    none = (np.zeros(0, np.uint64), np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3)))
    if n < length:
        return none
    forward, back = powers(n + 1)
    with np.errstate(over="ignore"):
        reach = np.concatenate([np.zeros(1, np.uint64), np.cumsum(BYTES[buf] * forward[:n])])
        piece = mix((reach[gram:] - reach[:-gram]) * back[: n - gram + 1])
    least = _sliding_min((piece & ~LOW) | np.arange(len(piece), dtype=np.uint64), length - gram + 1)
    pick = (least & LOW).astype(np.int64)
    valid = np.zeros(n + 1, np.int8)
    long = ends - starts >= length
    np.add.at(valid, starts[long], 1)
    np.add.at(valid, ends[long] - length + 1, -1)
    i = np.flatnonzero(np.cumsum(valid[: len(pick)]) > 0)
    if not len(i):
        return none
    at = pick[i]
    new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (i[1:] != i[:-1] + 1)]))
    lo, hi, at = i[new], i[np.concatenate([new[1:], [len(i)]]) - 1], at[new]
    with np.errstate(over="ignore"):
        context = mix((reach[hi + length] - reach[lo]) * back[lo]) ^ mix(((at - lo) * 1000 + (hi - lo)).astype(np.uint64))
    return piece[at], context, at, lo, hi


BYTES = mix(np.arange(256, dtype=np.uint64) + np.uint64(0x9E3779B97F4A7C15))


def _pieces(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, ids, starts, ends, offset of each text's start): about a megabyte of texts, or a piece of a very long one."""
    for batch in batches:
        column = batch.column("body")
        ids = batch.column("doc").to_numpy(zero_copy_only=False)
        cut = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
        data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
        a = 0
        while a < len(ids):
            b = max(a + 1, int(np.searchsorted(cut, cut[a] + (1 << 20), "right")) - 1)
            b = min(b, len(ids))
            if cut[b] - cut[a] <= PIECE:
                yield data[cut[a] : cut[b]], ids[a:b], cut[a:b] - cut[a], cut[a + 1 : b + 1] - cut[a], np.zeros(b - a, np.int64)
            else:
                for p in range(0, int(cut[b] - cut[a]), PIECE):
                    own = data[cut[a] + p : min(cut[a] + p + PIECE + length - 1, cut[b])]
                    yield own, ids[a:b], np.zeros(1, np.int64), np.array([len(own)]), np.array([p])
            a = b


def _settled_here(h: np.ndarray, c: np.ndarray, doc: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
    """Combine before the shuffle: (rows that go on, repeats of a row here as doc, lo, hi).

    The first of equal contexts goes on for all of them; neighbouring repeats become one.
    """
    order = np.lexsort((lo, doc, c, h))
    head = np.concatenate([[True], (h[order][1:] != h[order][:-1]) | (c[order][1:] != c[order][:-1])]) if len(h) else np.zeros(0, bool)
    first = order[np.flatnonzero(head)[np.cumsum(head) - 1]]
    again = order[(doc[order] != doc[first]) | (lo[order] != lo[first])]
    again = again[np.lexsort((lo[again], doc[again]))]
    d, a, b = doc[again], lo[again], hi[again]
    if not len(d):
        return order[head], (d, a, b)
    new = np.concatenate([[True], (d[1:] != d[:-1]) | (a[1:] > b[:-1] + 1)])
    start = a[np.flatnonzero(new)[np.cumsum(new) - 1]]
    new[1:] |= (a - start)[1:] // MERGED != (a - start)[:-1] // MERGED
    at = np.flatnonzero(new)
    return order[head], (d[at], a[at], b[np.concatenate([at[1:], [len(d)]]) - 1])


def _anchored(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for buf, ids, starts, ends, shift in _pieces(batches, length):
            h, c, at, lo, hi = anchors(buf, starts, ends, length, gram)
            text = np.searchsorted(starts, lo, "right") - 1
            move = shift[text] - starts[text]
            doc, lo, hi, at = ids[text], lo + move, hi + move, at + move
            on, (d, a, b) = _settled_here(h, c, doc, lo, hi)
            with np.errstate(over="ignore"):
                spread = mix(d.astype(np.uint64) * np.uint64(31) + a.astype(np.uint64))  # repeats go anywhere
            packed = np.concatenate([(lo[on] << 24) | ((at[on] - lo[on]) << 12) | (hi[on] - lo[on]), (a << 24) | (b - a)])
            columns = [np.concatenate([h[on], spread]).view(np.int64), np.concatenate([c[on], np.zeros(len(d), np.uint64)]).view(np.int64), np.concatenate([doc[on], d]), packed, np.arange(len(packed)) >= len(on)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["h", "c", "doc", "at", "again"])

    return run


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by h, c, doc, at: repeats (part null) and contexts to be compared (part -1, or a part of many)."""
    last: tuple | None = None  # h, c, doc, at of the class that is open
    held = np.zeros((3, 0), np.int64)  # h, doc, at of the open anchor's contexts
    seen = 0  # contexts of the open anchor that have left already

    def out(rows: np.ndarray, part: np.ndarray, null: bool) -> pa.RecordBatch:
        parts = pa.array(part, pa.int64(), mask=np.full(len(part), null))
        return pa.RecordBatch.from_arrays([pa.array(rows[0]), parts, pa.array(rows[1]), pa.array(rows[2])], names=["h", "part", "doc", "at"])

    def settle(rows: np.ndarray, before: int, closed: bool) -> tuple[pa.RecordBatch | None, np.ndarray, int]:
        """Contexts of anchors in order; ``before`` of the first anchor have left. The last stays open unless closed."""
        if not rows.shape[1]:
            return None, rows, before
        first = np.flatnonzero(np.concatenate([[True], rows[0, 1:] != rows[0, :-1]]))
        n = np.diff(np.concatenate([first, [rows.shape[1]]]))
        group = np.repeat(np.arange(len(first)), n)
        base = np.zeros(len(first), np.int64)
        base[0] = before
        index = np.arange(rows.shape[1]) - first[group] + base[group]
        total = n + base
        go = total[group] > 1
        stay, left = np.zeros((3, 0), np.int64), 0
        if not closed:
            if total[-1] <= PART:
                go &= group < len(first) - 1
                stay = rows[:, first[-1] :]
            else:
                left = int(total[-1])
        part = np.where(total[group] > PART, index // PART, -1)
        return (out(rows[:, go], part[go], False) if go.any() else None), stay, left

    for batch in batches:
        h, c, doc, at, known = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(5))
        if known.any():
            yield out(np.stack([h, doc, at])[:, known], np.zeros(int(known.sum()), np.int64), True)
            h, c, doc, at = (x[~known] for x in (h, c, doc, at))
        if not len(h):
            continue
        ph, pc, pd_, pt = (np.concatenate([[x[0] if last is None else last[k]], x[:-1]]) for k, x in enumerate((h, c, doc, at)))
        same = (h == ph) & (c == pc)
        if last is None:
            same[0] = False
        again = same & ~((doc == pd_) & (at == pt))
        if last is not None and held.shape[1] + seen and last[0] != h[0]:
            ready, _, _ = settle(held, seen, True)
            if ready:
                yield ready
            held, seen = np.zeros((3, 0), np.int64), 0
        if again.any():
            yield out(np.stack([h, doc, at])[:, again], np.zeros(int(again.sum()), np.int64), True)
        fresh = np.concatenate([held, np.stack([h, doc, at])[:, ~same]], 1)
        ready, held, seen_now = settle(fresh, seen, False)
        seen = seen if not fresh.shape[1] else seen_now
        if ready:
            yield ready
        last = (h[-1], c[-1], doc[-1], at[-1])
    ready, _, _ = settle(held, seen, True)
    if ready:
        yield ready


def _contexts(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                body, doc = batch.column("body")[i].as_py(), batch.column("doc")[i].as_py()
                asked = batch.column("asked")[i].values
                at = asked.field("at").to_numpy(zero_copy_only=False)
                lo, n = at >> 24, (at & 4095) + length
                found = [body[a : a + m] for a, m in zip(lo.tolist(), n.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([asked.field("h"), asked.field("part"), pa.array([doc] * len(lo), pa.int64()), pa.array(lo), pa.array(found, pa.binary())], names=["h", "part", "doc", "lo", "context"])

    return run


def compare(contexts: list[bytes], docs: np.ndarray, los: np.ndarray, many: np.ndarray, length: int) -> tuple[np.ndarray, list[tuple[bytes, int, int]]]:
    """(doc, first, last) of runs of strings that start earlier among ``contexts``; and, for
    contexts marked ``many``, the first place of each of their distinct strings."""
    sizes = np.array([len(x) for x in contexts])
    first = np.cumsum(sizes + 1) - sizes - 1
    raw = np.frombuffer(b"\0".join(contexts) + b"\0", np.uint8)
    symbols = raw.astype(np.int64) + 1
    symbols[first + sizes] = 0
    owner = np.repeat(np.arange(len(contexts)), sizes + 1)
    offset = np.arange(len(raw)) - first[owner]
    order = np.array(suffix_array(symbols.tolist()), np.int64)
    order = order[offset[order] <= sizes[owner[order]] - length]
    strings = np.lib.stride_tricks.sliding_window_view(raw, length)[order]
    run = np.concatenate([[0], np.cumsum((strings[1:] != strings[:-1]).any(1))])
    doc, place = docs[owner[order]], los[owner[order]] + offset[order]
    by = np.lexsort((place, doc, run))
    head = np.concatenate([[True], run[by][1:] != run[by][:-1]])
    first_of = by[np.flatnonzero(head)[np.cumsum(head) - 1]]
    again = by[(doc[by] != doc[first_of]) | (place[by] != place[first_of])]  # not the same place twice, as repeated ids give
    again = again[np.lexsort((place[again], doc[again]))]
    d, p = doc[again], place[again]
    new = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (p[1:] > p[:-1] + 1)])) if len(d) else np.zeros(0, np.int64)
    spans = np.stack([d[new], p[new], p[np.concatenate([new[1:], [len(p)]]) - 1]]) if len(d) else np.zeros((3, 0), np.int64)
    heads = by[head]
    heads = heads[many[owner[order[heads]]]]
    return spans, [(hashlib.blake2b(strings[i].tobytes(), digest_size=16).digest(), int(doc[i]), int(place[i])) for i in heads.tolist()]


def _sorted_out(length: int, budget: int = 1 << 13):
    """Groups arrive together; several are sorted at once, which none of them notices (few, as a small array stays in the cache)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            spans, heads = compare([x[4] for x in held], np.array([x[2] for x in held]), np.array([x[3] for x in held]), np.array([x[1] >= 0 for x in held]), length)
            n, m = spans.shape[1], len(heads)
            keys = np.frombuffer(b"".join(x[0] for x in heads), np.int64).reshape(-1, 2)
            columns = [pa.array(np.concatenate([spans[0], np.array([x[1] for x in heads], np.int64)])), pa.array(np.concatenate([spans[1], np.array([x[2] for x in heads], np.int64)])), pa.array(np.concatenate([spans[2], np.array([x[2] for x in heads], np.int64)]))]
            mask = np.arange(n + m) < n
            columns += [pa.array(np.concatenate([np.zeros(n, np.int64), keys[:, k]]), mask=mask) for k in range(2)]
            return pa.RecordBatch.from_arrays(columns, names=["doc", "lo", "hi", "w1", "w2"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and size >= budget and row[:2] != held[-1][:2]:
                    yield flush()
                    held, size = [], 0
                held.append(row)
                size += len(row[4])
        if held:
            yield flush()

    return run


def _cut(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, spans = [], []
            bodies, ranges = batch.column("body"), batch.column("ranges")
            for i in range(batch.num_rows):
                body = bodies[i].as_py()
                united: list[list[int]] = []
                if ranges[i].is_valid:
                    pairs = ranges[i].values
                    for a, b in sorted(zip(pairs.field("lo").to_pylist(), pairs.field("hi").to_pylist(), strict=True)):
                        if united and a <= united[-1][1]:
                            united[-1][1] = max(united[-1][1], b + length)
                        else:
                            united.append([a, b + length])
                edge = [0, *(x for span in united for x in span), len(body)]
                kept.append(body if not united else b"".join(body[a:b] for a, b in zip(edge[::2], edge[1::2], strict=True)))
                spans.append([{"start": a, "end": b} for a, b in united])
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(spans, SPANS), pa.array(kept, pa.binary())], names=["row", "spans", "kept"])

    return run


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of jobs whose results are stored; it does so after the driver collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _apart(rows: DataFrame) -> DataFrame:
    """Rows (row, doc, body) whose ``doc`` stands for one body; where an id has several, all are numbered anew in order."""
    keys = stored(rows.select("doc", F.xxhash64("body").alias("h")).distinct())
    if keys.groupBy("doc").count().filter("count > 1").isEmpty():
        return rows
    ranged = stored(keys.repartitionByRange("doc", "h").withColumn("part", F.spark_partition_id()))
    parts = ranged.groupBy("part").agg(F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    offsets = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("part").orderBy("doc", "h")
    numbered = ranged.join(F.broadcast(offsets), "part").select("doc", "h", (F.col("before") + F.row_number().over(inside)).alias("number"))
    return rows.withColumn("h", F.xxhash64("body")).join(numbered, ["doc", "h"]).select("row", F.col("number").alias("doc"), "body")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text: str = "text", length: int = 100, gram: int = 48) -> DataFrame:
    """All rows of ``docs`` without the text, with ``n_bytes``, ``spans`` (removed; array of
    struct(start, end), in bytes, maximal) and ``kept`` (the bytes that stay).

    Null texts are empty; texts shorter than ``length`` bytes lose nothing. Ids are longs; a
    null one counts as the greatest. Rows that repeat an id and text are judged as one
    document; different texts of one id (or of none) are documents in order of a hash of them.
    Input columns of the result's names are replaced; an empty table gives no rows.
    """
    if not 8 <= gram < length <= 1000:
        raise ValueError("need 8 <= gram < length <= 1000")
    spark = docs.sparkSession
    kept = without(docs, *(x for x in ("n_bytes", "spans", "kept") if x != text))
    row = F.struct(*[f"`{c}`" for c in kept.columns if c.lower() != text.lower()]).alias("row")
    body = F.coalesce(F.col(text), F.lit("")).cast("binary").alias("body")
    doc = F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1)).alias("doc")
    rows = _apart(kept.select(row, doc, body))
    bodies = rows.select("doc", "body")
    marked = bodies.mapInArrow(_anchored(length, gram), "h long, c long, doc long, at long, again boolean")
    met = stored(marked.repartition("h").sortWithinPartitions("h", "c", "doc", "at").mapInArrow(_met, "h long, part long, doc long, at long"))
    release(spark)
    lo = F.shiftright("at", 24)
    whole = met.filter("part IS NULL").select("doc", lo.alias("lo"), (lo + F.col("at").bitwiseAND(F.lit(4095))).alias("hi"))
    asked = met.filter("part IS NOT NULL").groupBy("doc").agg(F.collect_list(F.struct("h", "part", "at")).alias("asked"))
    contexts = bodies.join(asked, "doc").select("doc", "body", "asked").mapInArrow(_contexts(length), "h long, part long, doc long, lo long, context binary")
    compared = stored(contexts.repartition("h", "part").sortWithinPartitions("h", "part", "doc", "lo").mapInArrow(_sorted_out(length), "doc long, lo long, hi long, w1 long, w2 long"))
    release(spark)
    heads = compared.filter("w1 IS NOT NULL").select("w1", "w2", "doc", "lo")
    firsts = heads.groupBy("w1", "w2").agg(F.min(F.struct("doc", "lo")).alias("first"))
    merged = heads.join(firsts, ["w1", "w2"]).filter(F.struct("doc", "lo") != F.col("first")).select("doc", "lo", F.col("lo").alias("hi"))
    ranges = whole.unionByName(compared.filter("w1 IS NULL").select("doc", "lo", "hi")).unionByName(merged)
    per_doc = ranges.groupBy("doc").agg(F.collect_list(F.struct("lo", "hi")).alias("ranges"))
    joined = rows.join(per_doc, "doc", "left").select("row", "body", "ranges")
    schema = joined.select("row").withColumn("spans", F.array(F.struct(F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("end")))).withColumn("kept", F.lit(b"")).schema
    done = joined.mapInArrow(_cut(length), schema)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return done.select("row.*", (F.length("kept") + removed).cast("long").alias("n_bytes"), "spans", "kept")


def op5_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document keeps; nulls, short texts and repeated ids as in deduplicate(). Of equal strings the first stays, so there are no ties."""
    done = deduplicate(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return done.select("doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
