"""Secret scans over an incremental ledger of content-addressed blobs.

Every version of a text is addressed by the SHA-256 of its bytes. The ledger holds what each
pair of blob and rule version gave, empty findings too; only pairs that it lacks are
scanned, each once however many paths share the blob. Findings are then joined back to all
paths. A second run over a history with a few new versions scans just those.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, texts_of, without, work_dir

#: Raise with any change to what scan() gives.
RULES = "secrets-2"
ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
LEDGER = "blob string, rules string, kind array<string>, start array<bigint>, end array<bigint>"
#: Kinds besides the three of the contract, by name.
MORE = {
    "private_key": re.compile(r"-----BEGIN [A-Z0-9 ]{0,40}PRIVATE KEY-----"),
    "login": re.compile(r"://[^\s/:@]{1,256}:([^\s/@]{3,256})@"),
    "host_token": re.compile(r"\b(?:gh[pousr]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{40,}|glpat-[A-Za-z0-9_-]{20,})"),
    "chat_token": re.compile(r"\bxox[abeoprs]-[A-Za-z0-9-]{10,}"),
    "signed_token": re.compile(r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    "cloud_key": re.compile(r"\bAIza[A-Za-z0-9_-]{35}"),
}
BASE = ("assign", "access", "hex")
ORDER = {kind: i for i, kind in enumerate([*BASE, *MORE])}


def scan(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start and then kind (``ORDER``); kinds may overlap each other."""
    found = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 12]
    found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    found += [(kind, m.start(), m.end()) for kind, rule in MORE.items() for m in rule.finditer(text)]
    return sorted(found, key=lambda x: (x[1], ORDER[x[0]]))


def _scan_blobs(rules: str):
    schema = pa.schema([("blob", pa.string()), ("rules", pa.string()), ("kind", pa.list_(pa.string())), ("start", pa.list_(pa.int64())), ("end", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            found = [scan(x) for x in texts_of(part, "text")]
            columns = [part.column("blob"), pa.array([rules] * len(found)), *([[x[k] for x in f] for f in found] for k in range(3))]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)

    return run


def _ledger(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(LEDGER).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LEDGER)


def scan_versions(versions: DataFrame, ledger: str | None = None, text: str = "text", rules: str = RULES) -> DataFrame:
    """All rows of ``versions`` (any columns, one row per path and version) without the text,
    with ``blob`` and the findings ``kind``, ``start``, ``end`` (arrays of one length).

    ``ledger`` is a Parquet folder that all executors reach; it's appended to, and made where
    it's missing. Without one, a new ledger is used. Null texts count as empty; repeated rows
    are all kept; input columns of the result's names are replaced. An empty table gives an
    empty result.
    """
    spark = versions.sparkSession
    path = ledger or f"{work_dir(spark)}/ledger"
    body = F.coalesce(F.col(text), F.lit(""))
    blobs = versions.select(F.sha2(body.cast("binary"), 256).alias("blob"), body.alias("text"))
    seen = _ledger(spark, path).filter(F.col("rules") == rules).select("blob")
    unseen = (blobs.join(seen, "blob", "left_anti") if ledger else blobs).dropDuplicates(["blob"])
    unseen.mapInArrow(_scan_blobs(rules), LEDGER).write.mode("append").parquet(path)
    known = _ledger(spark, path).filter(F.col("rules") == rules).dropDuplicates(["blob"]).drop("rules")
    paths = without(versions, "blob", "kind", "start", "end").withColumn("__body", F.coalesce(F.col(text), F.lit("")))
    paths = paths.withColumn("blob", F.sha2(F.col("__body").cast("binary"), 256)).drop("__body", text)
    return paths.join(known, "blob")


def _joined(kinds: tuple[str, ...] | None = None) -> F.Column:
    """``kind:start:end`` of the findings (of some kinds), comma-joined."""
    parts = F.arrays_zip(F.col("kind").alias("k"), F.col("start").alias("s"), F.col("end").alias("e"))
    some = parts if kinds is None else F.filter(parts, lambda x: x["k"].isin(*kinds))
    return F.array_join(F.transform(some, lambda x: F.concat_ws(":", x["k"], x["s"], x["e"])), ",")


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every whole text of documents: the first version of each path, so the ledger is new.

    Nulls, repeated rows and order of findings as in scan_versions() and scan().
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = scan_versions(docs)
    count = lambda kind: F.size(F.filter("kind", lambda k: k == kind)).cast("long")
    return found.select(
        "doc_id", *[count(kind).alias(f"n_{kind}") for kind in BASE], F.sha2(_joined(BASE).cast("binary"), 256).alias("base_sha256"), _joined().alias("spans"), "blob",
    )
