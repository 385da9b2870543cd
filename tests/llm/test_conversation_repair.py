"""Operator 11 against every possible edit of small conversations, and against SQL."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from statforge.llm.conversation_repair import OP11_SQL, damaged, op11_conversation_repair, ordered_turns, repaired_turns, repairs

from .oracle import duck, same_rows

SCHEMA = "conv_id long, turn long, role string, text string, id string, steps long"


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        body = text.strip(" \t\n\x0b\f\r")
        out.append("blank" if not body else "duplicate" if (role, text) in seen else None if body[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def cheapest(rows):
    """(cost, audit, lines) by trying each edit of each turn with up to two inserts in each gap."""
    options = []
    for (_, role, text), fault in zip(rows, faults(rows), strict=True):
        pay = 5 if fault == "truncated" else 0
        own = [(2, "D", None)]
        if fault in (None, "truncated"):
            own += [(pay, "K", (role, text)), *[(1 + pay, "R", (r, text)) for r in ("user", "assistant")]]
        options.append(own)
    made = [[]] + [[(5, "I", (r, ""))] for r in ("user", "assistant")] + [[(5, "I", ("user", "")), (5, "I", ("assistant", ""))], [(5, "I", ("assistant", "")), (5, "I", ("user", ""))]]
    best = None
    for edits in itertools.product(*options):
        least = sum(e[0] for e in edits)
        for gaps in itertools.product(made, repeat=len(rows) + 1):
            cost = least + sum(5 * len(g) for g in gaps)
            if best and cost > best[0]:
                continue
            steps = [*gaps[0]]
            for e, g in zip(edits, gaps[1:], strict=True):
                steps += [e, *g]
            out = [e[2] for e in steps if e[2]]
            if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "?" for r, _ in out)):
                found = (cost, "".join(e[1] for e in steps), [f"{r}:{t}" for r, t in out])
                best = min(best or found, found)
    return best


def random_turns(seed, n, most):
    r = random.Random(seed)
    texts = ["Fine.", "Yes!", "cut off", "", " \n", "So it is?  "]
    return [(c, None if r.random() < 0.1 else r.randint(0, 5), r.choice(["user", "assistant", "system", "tool", None]), r.choice(texts), "x", 1) for c in range(n) for _ in range(r.randint(0, most))]


@pytest.mark.parametrize("bits", [12, 1, 0])
def test_repairs_against_every_edit(spark, bits):
    """With blocks of 4,096 turns, of 2 and of 1, which changes nothing."""
    rows = random_turns(3, 60, 3)
    turns = ordered_turns(spark.createDataFrame(rows, SCHEMA).repartition(3))
    found = repairs(turns, bits)
    got = {r.conv_id: r for r in found.collect()}
    lines = {}
    for r in sorted(repaired_turns(turns, found).collect(), key=lambda r: (r.conv_id, r.place, r.part)):
        lines.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    by = {}
    for c, turn, role, text, *_ in rows:
        by.setdefault(c, []).append((turn, " " if role is None else role, text))
    assert set(got) == set(by)
    for c, own in by.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        g, (cost, audit, want) = got[c], cheapest(own)
        assert (g.cost, g.audit, lines.get(c, [])) == (cost, audit, want), own
        flags, numbers = faults(own), {r[0] for r in own if r[0] is not None}
        assert (g.blank, g.duplicate, g.truncated) == tuple(flags.count(k) for k in ("blank", "duplicate", "truncated"))
        assert g.gaps == (max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0)
        assert g.illegal == sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:], strict=False))


def test_query_against_sql(spark):
    sf = "/root/testdata/sf0.01"
    same_rows(op11_conversation_repair(spark, sf).toPandas(), duck(sf).execute(OP11_SQL).df())


def test_edges_against_sql(spark, tmp_path):
    """Nulls in every column, repeated rows, ties, and a text above a batch slice."""
    long = "many words " * 500_000
    rows = [(None, 1, "user", "a."), (None, None, None, None), (None, None, None, None), (7, 1, "user", long), (7, 2, "assistant", long + "."), (7, 2, "assistant", "b."), (8, None, "system", "x."), (8, None, "user", "y."), (8, 3, "assistant", "z.")]
    rows += [(i, t, ("user", "assistant")[t % 2], f"w{t}.") for i in range(20, 60) for t in range(4)] + [(70, -3, "", "q."), (70, 9, "user", "q.")]
    spark.createDataFrame([(*r, "e", 5) for r in rows], "conv_id long, turn long, role string, text string, id string, cost long").coalesce(1).write.parquet(str(tmp_path / "c"))
    (next((tmp_path / "c").glob("part*.parquet"))).rename(tmp_path / "conversations.parquet")
    got = op11_conversation_repair(spark, str(tmp_path)).toPandas()
    same_rows(got, duck(str(tmp_path)).execute(OP11_SQL).df())
    none = sum(zlib.crc32(f"{i}:{t}".encode()) % 20 == 0 for i in range(20, 60) for t in range(4))
    assert none > 0 and len(got) == 44


def test_conversation_without_turns(spark, tmp_path):
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    spark.createDataFrame([(gone, 0, "user", "a.")], "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    row = op11_conversation_repair(spark, str(tmp_path)).collect()[0]
    assert tuple(row) == (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_long_conversation_spans_blocks(spark):
    """One conversation of 5,000 turns: the same repair whatever the size of blocks."""
    r = random.Random(5)
    rows = [(1, t, r.choice(["user", "assistant", "assistant", "system"]), r.choice([f"w{t}.", f"w{t}", "a."]), "x", 1) for t in range(5000)]
    turns = ordered_turns(spark.createDataFrame(rows, SCHEMA))
    got = {tuple(repairs(turns, bits).select("cost", "audit", "illegal", "gaps").first()) for bits in (13, 6)}
    assert len(got) == 1 and damaged(spark.createDataFrame([], SCHEMA)).count() == 0
    assert repairs(ordered_turns(spark.createDataFrame([], SCHEMA))).count() == 0
