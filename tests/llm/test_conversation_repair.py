"""Conversation repair against all edit sequences of short conversations, in whole and in pieces."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from shardwell.llm import conversation_repair as cr

SCHEMA = "conv_id long, turn long, role string, text string, cost long, fault string, part long"
GOOD = re.compile(r"(s?(ua)+)?")


def faulty(rows):
    """(turn, role, text) after damage, in order, with the first fault of each."""
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        m = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        row = (turn, "user" if m == 4 else role, {1: "", 2: re.sub("[.!?]", "", text)}.get(m, text))
        out += [row] * {0: 0, 3: 2}.get(m, 1)
    out.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    seen, done = set(), []
    for turn, role, text in out:
        said = text.strip(" \t\n\x0b\x0c\r")
        fault = "blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else ""
        seen.add((role, text))
        done.append((turn, role, text, fault))
    return done


def every_audit(rows):
    """The cheapest (cost, audit, lines) over all edits with at most two insertions in a row."""
    best = (10**9, "", [])
    runs = [()] + [(x,) for x in ("user", "assistant")] + [x for x in itertools.product(("user", "assistant"), repeat=2)]
    choices = []
    for _, role, text, fault in rows:
        ops = [("D", 2, [])]
        if fault not in ("blank", "duplicate"):
            more = 5 * (fault == "truncated")
            ops += [("K", more, [(role, text)])] + [("R", 1 + more, [(r, text)]) for r in ("user", "assistant")]
        choices.append([("I" * len(run) + a, 5 * len(run) + c, [(r, "") for r in run] + t) for run in runs for a, c, t in ops])
    choices.append([("I" * len(run), 5 * len(run), [(r, "") for r in run]) for run in runs])
    for pick in itertools.product(*choices):
        cost = sum(p[1] for p in pick)
        audit = "".join(p[0] for p in pick)
        if (cost, audit) < best[:2]:
            lines = [t for p in pick for t in p[2]]
            if all(r for r, _ in lines) and GOOD.fullmatch("".join(r[0] for r, _ in lines)):
                best = (cost, audit, lines)
    return best


def expected(conv, rows):
    own = faulty([r for r in rows if r[0] == conv])
    count = {f: sum(r[3] == f for r in own) for f in ("blank", "duplicate", "truncated")}
    initials = [r[1][:1] for r in own]
    turns = {r[0] for r in own if r[0] is not None}
    cost, audit, lines = every_audit(own)
    return (conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *count.values(), sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest())


def conversations(seed, n):
    r = random.Random(seed)
    rows = []
    for conv in range(n):
        for turn in r.sample(range(6), r.randrange(1, 4)):
            rows.append((conv, turn, r.choice(["system", "user", "assistant", "assistant", "user", "tool", "sales"]), r.choice(["Yes.", "no", "Well?  ", "", "Yes.", "!"])))
    return rows


ODD = [(None, None, None, None), (None, 3, "user", "Hi."), (None, 3, "assistant", "Hi."), (500, None, "user", "A."), (500, None, "user", "A."), (500, -4, "", "B."), (501, 1, "user", "\t\n"), (502, 9, "assistant", "é."), (503, 2, "user", "Same."), (503, 2, "user", "Same."), (503, 7, "user", "Same.")]


@pytest.mark.parametrize("piece", [2, 4096])
def test_every_audit(spark, piece):
    rows = conversations(piece, 60) + ODD
    data = spark.createDataFrame([(*x, 9, "clash", 9) for x in rows], SCHEMA).repartition(4)
    repaired = cr.repair(cr.damage(data), "lost", piece=piece)
    got = {x[0]: tuple(x) for x in cr.report(repaired).collect()}
    assert got.keys() == {x[0] for x in rows}
    for conv in got:
        assert got[conv] == expected(conv, rows)
    turns = cr.turns(repaired).orderBy("part", "place").collect()
    for conv in got:
        lines = "\n".join(f"{t.role}:{t.text}" for t in turns if t.conv_id == conv)
        assert hashlib.sha256(lines.encode()).hexdigest() == got[conv][-1]


def test_one_long_conversation(spark):
    """One conversation of all rows over many ranges and pieces is repaired as in one go."""
    r = random.Random(4)
    rows = [(1, k, r.choice(["user", "assistant", "system"]), r.choice([f"Text {k}.", "Again.", f"cut {k}", ""])) for k in range(3000)]
    data = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    whole = cr.report(cr.repair(data.coalesce(1))).first()
    small = cr.report(cr.repair(data.repartition(6), piece=37)).first()
    assert whole == small and re.fullmatch("[DIKR]+", whole.audit)
    cells, parents = cr.layers([cr._kind({"role": role, "fault": fault}) for _, role, _, fault in plain(rows)], (0,))
    cost, end = cr.best_end(cells)
    assert (whole.cost, whole.audit) == (cost, "".join(cr.CODES[c] for c in cr.path(parents, 0, end)) + cr.ENDS[end])


def plain(rows):
    seen = set()
    for _, turn, role, text in rows:
        fault = "blank" if not text else "duplicate" if (role, text) in seen else "truncated" if text[-1] not in ".!?" else ""
        seen.add((role, text))
        yield turn, role, text, fault


def test_empty(spark):
    data = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert cr.report(cr.repair(cr.damage(data), "lost")).count() == 0
