"""Two-phase soft clustering of chunk vectors by expectation maximisation in Spark's own groups.

Vectors of a group (book, chapter, level) are reduced by principal components; mixtures of 1
to ``most`` Gaussians of full covariance and as many centres of k-means are fitted side by
side; the number of clusters is the greater of the elbow of the inertia and the least BIC;
labels need a probability above one half, so a chunk may have none. Global clusters are
clustered again inside.

All groups and all counts go through the same jobs. A group is dealt to parts of a bounded
number of rows; a round turns each part and the models of its group into sufficient
statistics (weights, sums, outer products), an aggregation adds them up, and a row of sums
becomes a row of models. So a group may have any size, and a task holds one part. Everything
starts from slices along the first component, so reruns agree but for the order of sums.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.workspace import stored

MAX_CLUSTERS = 50
ROUNDS = 8
PART_ROWS = 20_000
FLOOR = 1e-6
STATS = "g string, k int, stats array<double>"
MODELS = "g string, k int, used array<double>, model array<double>, likelihood double, inertia double"


class Model(NamedTuple):
    """Centres of k-means; log weights, means, inverse Cholesky factors and log determinants of a mixture."""

    centres: np.ndarray
    weights: np.ndarray
    means: np.ndarray
    factors: np.ndarray
    logs: np.ndarray

    def flat(self) -> np.ndarray:
        return np.concatenate([np.ravel(a) for a in self])


def _split(flat: np.ndarray, k: int, d: int) -> Model:
    a, b, c, e, f = np.split(flat, np.cumsum([k * d, k, k * d, k * d * d]))
    return Model(a.reshape(k, d), b, c.reshape(k, d), e.reshape(k, d, d), f)


def responsibilities(x: np.ndarray, m: Model) -> tuple[np.ndarray, np.ndarray]:
    """Of each row for each component, and the log likelihood of each row."""
    logs = np.empty((len(x), len(m.weights)))
    for j in range(len(m.weights)):
        y = (x - m.means[j]) @ m.factors[j].T
        logs[:, j] = m.weights[j] - 0.5 * ((y * y).sum(1) + x.shape[1] * np.log(2 * np.pi) + m.logs[j])
    top = logs.max(1, keepdims=True)
    total = top + np.log(np.exp(logs - top).sum(1, keepdims=True))
    return np.exp(logs - total), total[:, 0]


def statistics(x: np.ndarray, k: int, flat: np.ndarray) -> np.ndarray:
    """What one part adds to a round: of k-means counts, sums and inertia; of the mixture likelihood, weights, sums and outer products.

    A model of one number is the spread along the first component, of which k slices of about
    equal weight are the start.
    """
    d = x.shape[1]
    if len(flat) == 1:
        slices = np.clip((k / (1 + np.exp(-1.702 * x[:, 0] / max(flat[0], 1e-12)))).astype(int), 0, k - 1)
        r = hard = np.eye(k)[slices]
        likelihood = inertia = np.nan
    else:
        m = _split(flat, k, d)
        far = np.stack([((x - c) ** 2).sum(1) for c in m.centres], axis=1)
        hard, inertia = np.eye(k)[far.argmin(1)], far.min(1).sum()
        r, each = responsibilities(x, m)
        likelihood = each.sum()
    outer = [np.ravel((r[:, j, None] * x).T @ x) for j in range(k)]
    return np.concatenate([hard.sum(0), np.ravel(hard.T @ x), [inertia, likelihood], r.sum(0), np.ravel(r.T @ x), *outer])


def improved(stats: np.ndarray, k: int, d: int, before: np.ndarray) -> tuple[np.ndarray, float, float]:
    """The next model from a group's sums, and likelihood and inertia of the model before it."""
    counts, sums, (inertia, likelihood), weight, total, outer = np.split(stats, np.cumsum([k, k * d, 2, k, k * d]))
    old = np.zeros((k, d)) if len(before) == 1 else _split(before, k, d).centres
    centres = np.where(counts[:, None] > 0, sums.reshape(k, d) / np.maximum(counts, 1)[:, None], old)
    weight, n = weight + 1e-9, weight.sum()
    means = total.reshape(k, d) / weight[:, None]
    factors, logs = np.empty((k, d, d)), np.empty(k)
    for j, o in enumerate(outer.reshape(k, d, d)):
        cov, floor = o / weight[j] - np.outer(means[j], means[j]), FLOOR
        while True:  # a component of a few equal rows needs a higher floor
            try:
                low = np.linalg.cholesky((cov + cov.T) / 2 + floor * np.eye(d))
                break
            except np.linalg.LinAlgError:
                floor *= 10
        factors[j], logs[j] = np.linalg.inv(low), 2 * np.log(np.diag(low)).sum()
    return Model(centres, np.log(weight / n), means, factors, logs).flat(), float(likelihood), float(inertia)


def bic(likelihood: Column | float, k: Column | int, n: Column | int, d: int, log=np.log) -> Column | float:
    parameters = (k - 1) + k * d + k * (d * (d + 1) // 2)
    return parameters * log(n) - 2 * likelihood


def _numbers(column: pa.ChunkedArray) -> np.ndarray:
    """A column of equally long arrays as a matrix."""
    return np.array([x.values.to_numpy() for x in column], float) if len(column) else np.zeros((0, 0))


def _summed(parts: DataFrame, *by: str) -> DataFrame:
    """Element-wise sums of ``stats`` by columns."""
    added = parts.select(*by, F.posexplode("stats").alias("at", "v")).groupBy(*by, "at").agg(F.sum("v").alias("v"))
    ordered = F.array_sort(F.collect_list(F.struct("at", "v")))  # as long as the statistics are
    return added.groupBy(*by).agg(F.transform(ordered, lambda p: p["v"]).alias("stats"))


def _dealt(small: DataFrame, parts: DataFrame) -> DataFrame:
    """Rows of a group beside each of its parts."""
    return small.join(parts, "g").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")


def _moments(part: pa.Table) -> pa.Table:
    x = _numbers(part["x"])
    stats = np.concatenate([[len(x)], x.sum(0), np.ravel(x.T @ x)])
    return pa.table({"g": part["g"][:1], "stats": pa.array([stats.tolist()], pa.list_(pa.float64()))})


def _axes(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            means, axes, spread = [], [], []
            for flat in batch["stats"]:
                stats = flat.values.to_numpy()
                width = int((np.sqrt(4 * len(stats) - 3) - 1) / 2)
                n, mean = stats[0], stats[1 : width + 1] / stats[0]
                values, vectors = np.linalg.eigh(stats[width + 1 :].reshape(width, width) / n - np.outer(mean, mean))
                kept = vectors[:, ::-1][:, :dim]
                kept = kept * np.sign(kept[np.abs(kept).argmax(0), np.arange(kept.shape[1])])  # a sign of its own for each
                means.append(mean.tolist())
                axes.append(np.ravel(kept).tolist())
                spread.append(float(np.sqrt(max(values[-1], 0))))
            yield pa.RecordBatch.from_pydict({"g": batch["g"], "mean": pa.array(means, pa.list_(pa.float64())), "axes": pa.array(axes, pa.list_(pa.float64())), "spread": pa.array(spread, pa.float64())})

    return run


def _projected(part: pa.Table, axes: pa.Table) -> pa.Table:
    x, mean = _numbers(part["x"]), axes["mean"][0].values.to_numpy()
    z = (x - mean) @ axes["axes"][0].values.to_numpy().reshape(len(mean), -1)
    return pa.table({"g": part["g"], "part": part["part"], "id": part["id"], "z": pa.array(z.tolist(), pa.list_(pa.float64()))})


def _expected(part: pa.Table, models: pa.Table) -> pa.Table:
    z = _numbers(part["z"])
    out = [statistics(z, k.as_py(), m.values.to_numpy()).tolist() for k, m in zip(models["k"], models["model"], strict=True)] if len(z) else []
    return pa.table({"g": models["g"][: len(out)], "k": models["k"][: len(out)], "stats": pa.array(out, pa.list_(pa.float64()))})


def _maximised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        for k, stats, before in zip(batch["k"].to_pylist(), batch["stats"], batch["model"], strict=True):
            size = len(stats.values)  # 2k + 2 + 2kd + kd^2
            d = int(round(np.sqrt((size - 2) / k - 1) - 1))
            found.append(improved(stats.values.to_numpy(), k, d, before.values.to_numpy()))
        yield pa.RecordBatch.from_pydict({
            "g": batch["g"], "k": batch["k"], "used": batch["model"], "model": pa.array([m.tolist() for m, *_ in found], pa.list_(pa.float64())),
            "likelihood": pa.array([x[1] for x in found], pa.float64()), "inertia": pa.array([x[2] for x in found], pa.float64()),
        })


def _labelled(threshold: float):
    def run(part: pa.Table, models: pa.Table) -> pa.Table:
        z = _numbers(part["z"])
        labels = []
        if len(z):
            r, _ = responsibilities(z, _split(models["used"][0].values.to_numpy(), models["k"][0].as_py(), z.shape[1]))
            labels = [int(j) if p > threshold else None for j, p in zip(r.argmax(1), r.max(1), strict=True)]
        return pa.table({"g": part["g"], "id": part["id"], "label": pa.array(labels, pa.int32())})

    return run


class Fitted(NamedTuple):
    """``rows``: g, part, id, z. ``models``: of each round g, k, used, likelihood, inertia. ``groups``: g, n, parts."""

    rows: DataFrame
    models: list[DataFrame]
    groups: DataFrame


def fit(rows: DataFrame, dim: int, most: int = MAX_CLUSTERS, rounds: int = ROUNDS, part_rows: int = PART_ROWS) -> Fitted:
    """Mixtures and k-means of 1 to ``most`` clusters for each group of ``rows`` (g, id, x) with more than ``dim + 1`` of them."""
    groups = stored(rows.groupBy("g").agg(F.count("*").alias("n")).filter(F.col("n") > dim + 1).withColumn("parts", F.ceil(F.col("n") / part_rows).cast("int")))
    parts = groups.select("g", "parts")
    dealt = stored(rows.join(parts, "g").withColumn("part", F.pmod(F.xxhash64("id"), "parts").cast("int")).drop("parts"))
    moments = _summed(dealt.groupBy("g", "part").applyInArrow(_moments, "g string, stats array<double>"), "g")
    axes = stored(moments.mapInArrow(_axes(dim), "g string, mean array<double>, axes array<double>, spread double"))
    kind = rows.schema["id"].dataType.simpleString()
    by = lambda df: df.groupBy("g", "part")
    z = stored(by(dealt).cogroup(by(_dealt(axes, parts))).applyInArrow(_projected, f"g string, part int, id {kind}, z array<double>"))
    counts = groups.select("g", F.explode(F.sequence(F.lit(1), F.least(F.lit(most), "n").cast("int"))).alias("k"))
    models, history = counts.join(axes, "g").select("g", "k", F.array("spread").alias("model")), []
    for _ in range(rounds + 1):  # the first sets out from the slices
        sums = _summed(by(z).cogroup(by(_dealt(models, parts))).applyInArrow(_expected, STATS), "g", "k")
        made = stored(sums.join(models, ["g", "k"]).mapInArrow(_maximised, MODELS))
        history.append(made.drop("model"))
        models = made.select("g", "k", "model")
    return Fitted(z, history, groups)


def scores(fitted: Fitted, dim: int) -> DataFrame:
    """g, k, n, likelihood, inertia and BIC of the last models."""
    last = fitted.models[-1].join(fitted.groups, "g").withColumn("d", F.lit(dim))
    return last.select("g", "k", "n", "likelihood", "inertia", bic(F.col("likelihood"), F.col("k"), F.col("n"), dim, F.log).alias("bic"))


def best_count(scored: DataFrame) -> DataFrame:
    """g, k: the greater of the elbow (before which the inertia falls most) and the least BIC."""
    ordered = Window.partitionBy("g").orderBy("k")
    steps = scored.withColumn("fall", F.lead("inertia").over(ordered) - F.col("inertia"))
    elbow = F.coalesce(F.min_by("k", F.when(F.col("fall").isNotNull(), F.struct("fall", "k"))), F.lit(1))
    return steps.groupBy("g").agg(F.greatest(elbow, F.min_by("k", F.struct("bic", "k"))).alias("k"))


def soft_labels(rows: DataFrame, dim: int, threshold: float, most: int, part_rows: int = PART_ROWS) -> DataFrame:
    """g, id, label of ``rows`` (g, id, x); null for none above the threshold. Up to ``dim + 1`` rows are one cluster."""
    kind = rows.schema["id"].dataType.simpleString()
    fitted = fit(rows, dim, most, part_rows=part_rows)
    chosen = fitted.models[-1].join(best_count(scores(fitted, dim)), ["g", "k"]).select("g", "k", "used")
    by = lambda df: df.groupBy("g", "part")
    labels = by(fitted.rows).cogroup(by(_dealt(chosen, fitted.groups.select("g", "parts")))).applyInArrow(_labelled(threshold), f"g string, id {kind}, label int")
    few = rows.join(fitted.groups, "g", "left_anti").select("g", "id", F.lit(0).alias("label"))
    return stored(labels.unionByName(few))


def cluster(chunks: DataFrame, per: Sequence[str], key: str = "chunk_key", embedding: str = "embedding", dim: int = 10, threshold: float = 0.5, most: int = MAX_CLUSTERS, part_rows: int = PART_ROWS) -> DataFrame:
    """(per..., key, cluster) for every chunk with a vector; a null cluster is none. Keys are unique in a group.

    Vectors of a group are equally long; ``dim`` is at most that length. Local clusters are
    numbered on from global cluster to global cluster.
    """
    group = F.to_json(F.struct(*per), {"ignoreNullFields": "false"})
    held = chunks.filter(F.col(embedding).isNotNull()).select(*per, key, group.alias("g"), F.col(embedding).cast("array<double>").alias("x"))
    rows = stored(held.select("g", F.col(key).alias("id"), "x"))
    whole = soft_labels(rows, dim, threshold, most, part_rows)
    inside = whole.filter("label IS NOT NULL").select(F.to_json(F.struct("g", "label")).alias("inner"), "g", "id", F.col("label").alias("global"))
    locals_ = soft_labels(rows.join(inside, ["g", "id"]).select(F.col("inner").alias("g"), "id", "x"), dim, threshold, most, part_rows)
    both = inside.join(locals_.select(F.col("g").alias("inner"), "id", F.col("label").alias("local")), ["inner", "id"])
    used = both.groupBy("g", "global").agg((F.coalesce(F.max("local"), F.lit(-1)) + 1).alias("used"))  # at most ``most`` rows a group
    before = Window.partitionBy("g").orderBy("global").rowsBetween(Window.unboundedPreceding, -1)
    offsets = used.select("g", "global", F.coalesce(F.sum("used").over(before), F.lit(0)).alias("offset"))
    numbered = both.join(offsets, ["g", "global"]).select("g", F.col("id").alias(key), (F.col("local") + F.col("offset")).cast("int").alias("cluster"))
    return held.drop("x").join(numbered, ["g", key], "left").select(*per, key, "cluster")


def levels(chunks: DataFrame, summarise, embed, max_levels: int = 3, **params) -> tuple[DataFrame, DataFrame]:
    """All levels' chunks, and the edges between them, for level-1 chunks with vectors.

    Each level clusters the last one's chunks per chapter, gives each cluster a summary
    chunk and embeds it, until a level has one cluster everywhere or ``max_levels`` is
    reached. ``summarise`` and ``embed`` map a text Column to a Column.
    """
    from ..functions.text import chunk_key
    from .hierarchy import cluster_summaries, edges_from_labels

    per = ["series_id", "book_number", "chapter_number"]
    base = ["chunk_key", *per, "level", "chunk_index", "text", "book_position", "embedding"]
    last = chunks.select(*base)
    everything, edges = last, None
    for level in range(2, max_levels + 1):
        labels = stored(cluster(last, per, **params).filter("cluster IS NOT NULL"))
        grouped = cluster_summaries(labels.join(last.select("chunk_key", "text", "book_position"), "chunk_key"), [*per, "cluster"])
        made = grouped.select(*per, F.lit(level).alias("level"), F.col("cluster").alias("chunk_index"), summarise(F.col("text")).alias("text"), "book_position", "cluster")
        made = made.withColumn("chunk_key", chunk_key(*(F.col(c) for c in (*per, "level", "chunk_index")))).withColumn("embedding", embed(F.col("text")))
        made = stored(made)
        found = edges_from_labels(labels, made, [*per, "cluster"])
        edges = found if edges is None else edges.unionByName(found)
        last = made.select(*base)
        everything = everything.unionByName(last)
        if not made.groupBy(*per).count().filter("count > 1").head(1):
            break
    return everything, edges
