import hashlib
import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from tremorlake.llm import conversations as C

SCHEMA = "conv_id long, turn long, role string, text string, cell int, part string"


def faults(rows):
    """Plain: the first fault of each row, in order."""
    seen, out = set(), []
    for role, text in rows:
        tail = text.rstrip(" \t\n\x0b\x0c\r")
        out.append("blank" if not tail else "duplicate" if (role, text) in seen else "truncated" if tail[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, most=3):
    """Plain: every sequence of edits with up to ``most`` insertions at each gap is tried; (cost, audit, turns)."""
    found = []

    def go(i, cost, audit, turns, gap):
        if cost > 3 * len(rows):  # what it costs to delete all
            return
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "-" for r, _ in turns)):
            found.append((cost, audit, turns))
        if gap < most and len(turns) < len(rows) + 4:
            for role in ("user", "assistant"):
                go(i, cost + 2, audit + "I", [*turns, (role, "")], gap + 1)
        if i < len(rows):
            role, text = rows[i]
            f = fault[i]
            go(i + 1, cost + 3, audit + "D", turns, 0)
            if f not in ("blank", "duplicate"):
                go(i + 1, cost + (f == "truncated"), audit + "K", [*turns, (role, text)], 0)
                for new in ("user", "assistant"):
                    go(i + 1, cost + 2 + (f == "truncated"), audit + "R", [*turns, (new, text)], 0)

    fault = faults(rows)
    go(0, 0, "", [], 0)
    return min(found, key=lambda x: x[:2])


def full_cyk(rows):
    """Plain: the cells of all spans over all splits."""
    fault = faults(rows)
    n = len(rows)
    cell = {}
    for i, (role, _) in enumerate(rows):
        cell[i, i + 1] = C.leaf(role[:1] if role[:1] in C.STEPS else "", fault[i] == "truncated", int(fault[i] in ("blank", "duplicate")))
    for length in range(2, n + 1):
        for i in range(n - length + 1):
            options = [C.join(cell[i, k], cell[k, i + length]) for k in range(i + 1, i + length)]
            cell[i, i + length] = {s: min(o[s] for o in options) for s in options[0]}
    return C.best(cell[0, n]) if n else (0, "")


def stats(conv):
    """Plain: the contract's columns of one conversation, given as (turn, role, text) in order."""
    rows = [(r, t) for _, r, t in conv]
    f = faults(rows)
    turns = [t for t, _, _ in conv if t is not None]
    initials = [r[:1] for r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, f.count("blank"), f.count("duplicate"), f.count("truncated"), illegal)


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))


def some(seed, most):
    r = random.Random(seed)
    texts = ["Hello.", "yes", "no!", " ", "", "a\n", "Fine? ", "Fine? ", "é."]
    return [(r.choice([None, 0, 1, 2, 3, 9]), r.choice(["user", "assistant", "user", "assistant", "system", "tool", " ", ""]), r.choice(texts)) for _ in range(r.randrange(0, most))]


@pytest.mark.parametrize("seed", range(40))
def test_cells_against_all_edit_sequences(seed):
    rows = [(r, t) for _, r, t in order(some(seed, 5))]
    f = faults(rows)
    cell = C.span(tuple((r[:1] if r[:1] in C.STEPS else "", x == "truncated", int(x in ("blank", "duplicate"))) for (r, _), x in zip(rows, f)))
    cost, audit, turns = cheapest(rows)
    assert C.best(cell) == (cost, audit)
    assert full_cyk(rows) == (cost, audit)
    repair = C.Repair(audit)
    got = [x[:2] for (r, t), y in zip(rows, f) for x in repair.row({"role": r, "text": t, "copies": 1})] + [x[:2] for x in repair.inserted()]
    assert got == turns


@pytest.mark.parametrize("block,chars", [(4096, 4_000_000), (3, 4_000_000), (1, 10)])
def test_conversations_in_blocks(spark, monkeypatch, block, chars):
    # blocks of a few rows, so that conversations are joined from many
    monkeypatch.setattr(C, "BLOCK_ROWS", block)
    monkeypatch.setattr(C, "BLOCK_CHARS", chars)
    convs = {i: some(1000 + i, 14) for i in range(60)} | {None: some(5, 9), 77: some(3, 20) * 3, 78: [(k, "ua"[k % 2] * 3, f"t{k}.") for k in range(24)]}
    data = [(c, t, r, x, 1, "p") for c, rows in convs.items() for t, r, x in rows]
    random.Random(1).shuffle(data)
    df = spark.createDataFrame(data, SCHEMA).repartition(7)
    got = {r.conv_id: r for r in C.repair(df).collect()}
    turns = {}
    for r in C.repaired_turns(df).collect():
        turns.setdefault(r.conv_id, {})[r.position] = (r.role, r.text)
    assert set(got) == {c for c, rows in convs.items() if rows}
    for c, r in got.items():
        rows = order(convs[c])
        assert (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal) == stats(rows), c
        assert (r.cost, r.audit) == full_cyk([x[1:] for x in rows]), c
        mine = [turns.get(c, {})[k] for k in range(len(turns.get(c, {})))]
        assert re.fullmatch("(s?(ua)+)?", "".join(x[:1] for x, _ in mine))
        assert r.repaired_sha256 == hashlib.sha256("\n".join(f"{a}:{b}" for a, b in mine).encode()).hexdigest()


def test_nulls_copies_and_long_texts(spark):
    long = "word " * 400_000 + "end."
    data = [(1, 0, "user", long, 0, None), (1, 1, "assistant", None, 0, None), (2, None, None, "x.", 0, None), *[(3, 5, "user", "same.", 0, None)] * 5000, (3, 6, "assistant", "ok.", 0, None)]
    got = {r.conv_id: r for r in C.repair(spark.createDataFrame(data, SCHEMA)).collect()}
    assert got[1].blank == 1 and got[1].audit in ("KDI",) and got[1].cost == 5
    assert got[1].repaired_sha256 == hashlib.sha256(f"user:{long}\nassistant:".encode()).hexdigest()
    assert (got[2].gaps, got[2].audit, got[2].cost) == (0, "D", 3)
    assert got[3].duplicate == 4999 and got[3].audit == "K" + "D" * 4999 + "K" and got[3].illegal == 4999
    empty = spark.createDataFrame([], SCHEMA)
    assert C.repair(empty).count() == 0 and C.repaired_turns(empty).count() == 0 and C.with_all_ids(C.repair(empty), empty).count() == 0


def test_damage_and_missing_conversations(spark):
    data = [(c, t, "user" if t % 2 == 0 else "assistant", f"Text {c} {t}. Good?", 0, "") for c, t in itertools.product(range(60), range(4))] + [(None, None, None, None, 0, "")]
    df = spark.createDataFrame(data, SCHEMA)
    kinds = {r.k: r.n for r in df.groupBy((F.crc32(F.encode(F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.coalesce(F.col("turn").cast("string"), F.lit(" "))), "UTF-8")) % 20).alias("k")).agg(F.count("*").alias("n")).collect()}
    bad = C.damage(df)
    assert bad.count() == len(data) - kinds.get(0, 0) + kinds.get(3, 0) and bad.columns == ["conv_id", "turn", "role", "text"]
    one = df.filter("conv_id = 7")
    out = {r.conv_id: r for r in C.with_all_ids(C.repair(bad.filter("conv_id <> 7 OR conv_id IS NULL")), df).collect()}
    assert len(out) == 61 and one.count() == 4
    assert (out[7].cost, out[7].audit, out[7].repaired_sha256) == (0, "", hashlib.sha256().hexdigest())
