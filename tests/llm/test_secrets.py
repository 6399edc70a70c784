import hashlib
import re

from taleweft.llm import secrets


def brute(text):
    found = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m[2]) >= 12:
            found.append((m.start(), 0, "assign", m.end()))
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(found))


def test_query_equals_brute_force(spark, data):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    rows = secrets.op9_secret_scan(spark, data).collect()
    assert len(rows) == len(texts)
    for r in rows:
        spans = brute(texts[r["doc_id"]])
        assert r["spans"] == spans and r["base_sha256"] == hashlib.sha256(spans.encode()).hexdigest()
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(len(re.findall(k, spans)) for k in ("assign", "access", "hex"))


def test_failing_matches_still_take_their_text():
    text = "token=secret:abcdefghijklmnop 𝄞 API_KEY = 'Zm9vYmFyYmF6cXV4' AKIAABCDEFGHIJKLMN AKIA12 tokſen=aaaaaaaaaaaaaaa"
    assert ",".join(f"{k}:{a}:{b}" for k, a, b in secrets.scan(text)) == brute(text)
    assert [k for k, *_ in secrets.scan(text)] == ["assign", "access"]


def test_added_kinds_leave_the_base_as_it_is(spark, tmp_path):
    rows = [(1, "-----BEGIN RSA PRIVATE KEY-----\nMIIE"), (2, "go https://me:hunter2@h.example/ ghp_" + "a1" * 20), (3, "xoxb-123456789012-abc eyJhbGciOiJI.eyJzdWIiOiIx.sig AIza" + "x" * 35), (4, "http://h:80/a@b token=0123456789abcdef")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in secrets.op9_secret_scan(spark, str(tmp_path)).collect()}
    kinds = {i: [x.split(":")[0] for x in r["spans"].split(",")] for i, r in got.items()}
    assert kinds == {1: ["private_key"], 2: ["login", "host_token", "hex"], 3: ["chat_token", "signed_token", "cloud_key"], 4: ["assign", "hex"]}
    for i, text in rows:
        base = brute(text)
        assert got[i]["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        assert set(filter(None, base.split(","))) <= set(got[i]["spans"].split(","))


def test_a_history_scans_each_version_once(spark, tmp_path):
    """Three commits over a few paths: the ledger grows by the blobs that are new in each."""
    path, text = str(tmp_path / "ledger"), "token=0123456789abcdef0 v{}"
    seen = set()
    history = spark.createDataFrame([], "path string, commit int, text string")
    for commit, change in enumerate([{"a": 0, "b": 1}, {"a": 1}, {"a": 2, "b": 0, "c": 2}]):
        new = spark.createDataFrame([(p, commit, text.format(v)) for p, v in change.items()], history.schema)
        history = history.unionByName(new)
        seen |= set(change.values())
        found = secrets.scan_versions(history, path).collect()
        assert len(found) == history.count() and all(r["kind"] == ["assign", "hex"] for r in found)
        assert spark.read.parquet(path).count() == len(seen)


def test_ledger_scans_only_what_is_new(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "ledger")
    first = spark.createDataFrame([("a", "0123456789abcdef0"), ("b", "0123456789abcdef0"), ("c", None)], "path string, text string")
    assert {r["path"]: r["kind"] for r in secrets.scan_versions(first, path).collect()} == {"a": ["hex"], "b": ["hex"], "c": []}
    assert spark.read.parquet(path).count() == 2
    more = first.unionByName(spark.createDataFrame([("d", "new")], first.schema))
    assert secrets.scan_versions(more, path).count() == 4
    assert spark.read.parquet(path).count() == 3
    assert secrets.scan_versions(more, path, rules="other").count() == 4
    assert spark.read.parquet(path).count() == 6


def test_odd_rows(odd_docs, no_docs):
    rows = secrets.scan_versions(odd_docs.withColumnRenamed("score", "kind")).collect()
    assert len(rows) == 8 and all(r["kind"] == [] for r in rows)
    assert secrets.scan_versions(no_docs).count() == 0
