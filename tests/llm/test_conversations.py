"""Conversation repair against a forward search over whole edit strings."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest

from raretide.llm import conversations
from raretide.llm.conversations import damaged, repair_conversations, repaired_turns

SCHEMA = "conv_id long, turn long, role string, text string, sign string, identity string, at long"
NEXT = {("", "u"): "u", ("", "s"): "s", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def _name(x):
    return " " if x is None else str(x)


def _damage(rows):
    out = []
    for conv, turn, role, text, *_ in rows:
        role, text = _name(role), _name(text)
        kind = zlib.crc32(f"{_name(conv)}:{_name(turn)}".encode()) % 20
        if kind == 1:
            text = ""
        if kind == 2:
            text = "".join(c for c in text if c not in ".!?")
        if kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return out


def _repair(rows):
    """The result of one conversation: every state keeps its least (cost, audit), turn by turn."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
    seen, faults = set(), []
    for _, _, role, text in rows:
        body = text.rstrip(" \t\n\x0b\x0c\r")
        faults.append("b" if not body else "d" if (role, text) in seen else "t" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    best = {"": (0, "", ())}

    def offer(table, state, x):
        if state is not None and (state not in table or x[:2] < table[state][:2]):
            table[state] = x

    def inserts(table):
        for _ in range(4):
            for state, (cost, audit, out) in list(table.items()):
                for role in ("user", "assistant"):
                    offer(table, NEXT.get((state, role[0])), (cost + 2, audit + "I", (*out, f"{role}:")))
        return table

    for (_, _, role, text), fault in zip(rows, faults, strict=True):
        after = {}
        for state, (cost, audit, out) in inserts(best).items():
            offer(after, state, (cost + 3, audit + "D", out))
            if fault not in ("b", "d"):
                more = fault == "t"
                offer(after, NEXT.get((state, role[:1])), (cost + more, audit + "K", (*out, f"{role}:{text}")))
                for new in ("user", "assistant"):
                    offer(after, NEXT.get((state, new[0])), (cost + 2 + more, audit + "R", (*out, f"{new}:{text}")))
        best = after
    cost, audit, out = min(x for s, x in inserts(best).items() if s in ("", "a"))
    turns = {r[1] for r in rows} - {None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    return (gaps, *(faults.count(f) for f in "bdt"), illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()), out


def _expected(rows):
    convs = {r[0]: [] for r in rows}
    for r in _damage(rows):
        convs[r[0]].append(r)
    return {c: _repair(r) for c, r in convs.items()}


def _rows(seed, convs, most):
    r = random.Random(seed)
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "User"]
    texts = ["Yes.", "no", "What?", " ", "", "a line\n", "Fine! \n\t", "One. Two", "ünï。", None]
    out = []
    for c in range(convs):
        for t in range(r.randrange(1, most)):
            turn = None if r.random() < 0.05 else t if r.random() < 0.9 else r.randrange(most)
            role = ("user", "assistant")[t % 2] if r.random() < 0.6 else r.choice(roles)
            out.append((c if c else None, turn, role, r.choice(texts) if r.random() < 0.6 else f"Turn {t}.", "sign", "identity", t))
            if r.random() < 0.03:
                out.append(out[-1])
    r.shuffle(out)
    return out


@pytest.mark.parametrize("block", [17, 1])
def test_repair_equals_a_forward_search(spark, monkeypatch, block):
    monkeypatch.setattr(conversations, "BLOCK", block)
    rows = _rows(3, 60, 9) + [(1000, t, "user" if t % 3 else "assistant", f"{t % 40}{'.' * (t % 5 > 0)}", "", "", 0) for t in range(400)]
    rows += [(1001, 0, "user", "x" * 300000 + ".", "", "", 0), (1001, 1, "assistant", " " * 100000, "", "", 0)]
    rows += [(2000, 0, "user", "Same.", "", "", 0)] * 50
    dropped = next(i for i in range(5000, 6000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    rows.append((dropped, 0, "user", "Gone.", "", "", 0))
    table = spark.createDataFrame(rows, SCHEMA)
    expected = _expected(rows)
    out = {x.conv_id: tuple(x)[1:] for x in repair_conversations(damaged(table), table).collect()}
    assert out == {c: x[0] for c, x in expected.items()}
    assert out[dropped] == (0,) * 6 + ("", hashlib.sha256(b"").hexdigest())
    turns = {}
    for x in sorted(repaired_turns(damaged(table)).collect(), key=lambda x: x.place):
        turns.setdefault(x.conv_id, []).append(f"{x.role}:{x.text}")
        assert x.place == len(turns[x.conv_id]) - 1 and x.edit in "IKR"
    assert turns == {c: list(x[1]) for c, x in expected.items() if x[1]}


def test_no_turns(spark):
    table = spark.createDataFrame([], SCHEMA)
    assert repair_conversations(damaged(table), table).count() == 0
    assert repaired_turns(table).count() == 0
    alone = repair_conversations(table, spark.createDataFrame([(7,), (None,)], "conv_id long")).collect()
    assert {x.conv_id for x in alone} == {7, None} and {tuple(x)[1:8] for x in alone} == {(0, 0, 0, 0, 0, 0, "")}
