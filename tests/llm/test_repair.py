import hashlib
import random
import re
import zlib

import pytest
from taleweft.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string"


def brute_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        shown = [" " if x is None else x for x in (conv, turn, role, text)]
        fate = zlib.crc32(f"{shown[0]}:{shown[1]}".encode()) % 20
        role, text = shown[2], shown[3]
        if fate == 1:
            text = ""
        if fate == 2:
            text = re.sub("[.!?]", "", text)
        if fate == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if fate == 0 else 2 if fate == 3 else 1)
    return out


def automaton(state, letter):
    """Every step of s?(ua)+, spelled out."""
    return {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}.get((state, letter))


def brute_audit(turns):
    """Carry every cheapest audit string and what it repairs to; inserts anywhere, before Deletes as well."""

    def insert(held):
        out = dict(held)
        for state, (cost, audit, lines) in held.items():
            for _ in range(4):
                letter = next(x for x in "ua" if automaton(state, x))
                state, cost, audit, lines = automaton(state, letter), cost + 2, audit + "I", [*lines, {"u": "user:", "a": "assistant:"}[letter]]
                if state not in out or (cost, audit) < out[state][:2]:
                    out[state] = cost, audit, lines
        return out

    def consider(out, state, *way):
        if state is not None and (state not in out or way[:2] < out[state][:2]):
            out[state] = way

    held = {"": (0, "", [])}
    for role, text, fault in turns:
        out = {}
        ways = [(s, w) for s, w in insert(held).items()] + list(held.items())
        for state, (cost, audit, lines) in ways:
            consider(out, state, cost + 3, audit + "D", lines)
            if fault in ("blank", "duplicate"):
                continue
            extra = fault == "truncated"
            consider(out, automaton(state, role[:1]), cost + extra, audit + "K", [*lines, f"{role}:{text}"])
            for letter, name in (("u", "user"), ("a", "assistant")):
                consider(out, automaton(state, letter), cost + 2 + extra, audit + "R", [*lines, f"{name}:{text}"])
        held = out
    ends = [w for s, w in insert(held).items() if s in ("", "a")]
    return min(ends, key=lambda w: w[:2])


def brute(rows):
    """conv_id -> the contract's row, of damaged rows."""
    out = {}
    for conv in {r[0] for r in rows}:
        mine = sorted((r[1:] for r in rows if r[0] == conv), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, faults = set(), []
        for _, role, text in mine:
            shown = re.sub(r"[\x20\x09-\x0D]", "", text)
            faults.append("blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else "")
            seen.add((role, text))
        known = {t for t, *_ in mine if t is not None}
        cost, audit, lines = brute_audit([(role, text, f) for (_, role, text), f in zip(mine, faults, strict=True)])
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:], strict=False))
        gaps = max(known) - min(known) + 1 - len(known) if known else 0
        out[conv] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def shown(rows, key="conv_id"):
    return {r[key]: tuple(r[k] for k in (*repair.FACTS, "audit", "repaired_sha256")) for r in rows}


def noise(rng, n, convs):
    roles, texts = ["user", "assistant", "system", "tool", "", None], ["One.", "Two!", "cut off", "", " \n", "Three?  ", None, "One. "]
    weights = [6, 6, 2, 1, 1, 1]
    return [(rng.choice(convs), rng.choice([None, *range(60)]), rng.choices(roles, weights)[0], rng.choice([rng.choice(texts), f"said {rng.random()}" + rng.choice([".", ""])])) for _ in range(n)]


def test_query_equals_brute_force(spark, data):
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = brute(brute_damage(rows))
    got = shown(repair.op12_repair(spark, data).collect())
    empty = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got == {r[0]: want.get(r[0], empty) for r in rows}


@pytest.mark.parametrize("block_rows", [1, 3, 1000])
def test_odd_rows_in_blocks_equal_brute_force(spark, block_rows):
    """Nulls, blanks, repeats, ties and unknown roles; one conversation over many blocks and tasks."""
    rng = random.Random(block_rows)
    rows = [r for r in noise(rng, 400, [1, 1, 1, 2, 3, None, 5, 6, 7, 8, 9, 10, 11, 12])]
    rows += rows[:40]
    given = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("conv_id", "turn", "role", "text", "1 AS kind", "2 AS cost")
    found = repair.repair(df.repartition(7), block_rows=block_rows)
    assert shown(found.conversations.collect(), "conv") == brute(given)
    turns = {}
    for r in sorted(found.turns.collect(), key=lambda r: (r["part"], r["seq"], r["place"])):
        turns.setdefault(r["conv"], []).append(f"{r['role']}:{r['text']}")
    for conv, row in brute(given).items():
        assert hashlib.sha256("\n".join(turns.get(conv, [])).encode()).hexdigest() == row[-1]


def test_many_short_conversations_equal_brute_force(spark):
    rows = noise(random.Random(9), 1500, list(range(400)))
    df = spark.createDataFrame(rows, SCHEMA)
    damaged = brute_damage(rows)
    assert repair.damaged(df).count() == len(damaged)
    assert shown(repair.repair(repair.damaged(df)).conversations.collect(), "conv") == brute(damaged)


def test_layers_are_few():
    """Steps are looked up: a long conversation meets few different layers."""
    layers, rng = repair.Layers(), random.Random(1)
    layers.run([repair.kind_of(rng.randrange(4), rng.randrange(3)) for _ in range(20_000)])
    assert len(layers.rows) < 200


def test_no_rows_and_long_texts(spark, tmp_path):
    none = spark.createDataFrame([], SCHEMA)
    assert repair.repair(none).conversations.count() == 0
    long = spark.createDataFrame([(1, t, "user" if t % 2 == 0 else "assistant", "word " * 100_000 + f"{t}.") for t in range(6)], SCHEMA)
    row = repair.repair(long, block_bytes=1 << 20).conversations.first()
    assert (row["audit"], row["cost"], row["illegal"]) == ("KKKKKK", 0, 0)
    assert row["repaired_sha256"] == hashlib.sha256("\n".join(f"{'user' if t % 2 == 0 else 'assistant'}:{'word ' * 100_000}{t}." for t in range(6)).encode()).hexdigest()
    none.write.parquet(str(tmp_path / "conversations.parquet"))
    assert repair.op12_repair(spark, str(tmp_path)).count() == 0
