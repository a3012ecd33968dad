"""Conversation repair against a search over all edit scripts."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib

import pytest

from evispark.llm import dialogue

DDL = "conv_id long, turn long, role string, text string, fault string, place string, c string"
GRAMMAR = re.compile(r"(s?(ua)+)?")


def fates(rows):
    out = []
    for conv, turn, role, text in rows:
        part = lambda x: " " if x is None else str(x)
        fate = zlib.crc32(f"{part(conv)}:{part(turn)}".encode()) % 20
        role, text = part(role), part(text)
        if fate:
            row = (conv, turn, "user" if fate == 4 else role, "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text)
            out += [row] * (2 if fate == 3 else 1)
    return out


def cheapest(turns):
    """(cost, audit, repaired turns) by a search over (row, letters put out so far), for short conversations."""
    best = {}

    def extend(at, cost, audit, out):
        i, state = at
        key = (i, state)
        if key in best and best[key][:2] <= (cost, audit):
            return []
        best[key] = (cost, audit, out)
        steps = []
        follow = {"": "su", "s": "u", "u": "a", "a": "u"}[state]
        if i < len(turns):
            role, text, fault = turns[i]
            steps.append(((i + 1, state), cost + 2, audit + "D", out))
            if fault not in ("blank", "duplicate"):
                more = 5 * (fault == "truncated")
                if role[:1] and role[:1] in follow:
                    steps.append(((i + 1, role[:1]), cost + more, audit + "K", (*out, f"{role}:{text}")))
                for r in ("user", "assistant"):
                    if r[0] in follow and role[:1] != r[0]:
                        steps.append(((i + 1, r[0]), cost + 1 + more, audit + "R", (*out, f"{r}:{text}")))
        for r in ("user", "assistant"):
            if r[0] in follow:
                steps.append(((i, r[0]), cost + 5, audit + "I", (*out, f"{r}:")))
        return steps

    todo = [((0, ""), 0, "", ())]
    while todo:
        todo.sort(key=lambda t: t[1:3])
        todo += extend(*todo.pop(0))
    return min(best[len(turns), s] for s in ("", "a") if (len(turns), s) in best)


def brute(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        mine = sorted((r for r in fates(rows) if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        seen, turns, counts = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, _, role, text in mine:
            stripped = text.strip(" \t\n\x0b\x0c\r")
            fault = "blank" if not stripped else "duplicate" if (role, text) in seen else "truncated" if stripped[-1] not in ".!?" else ""
            seen.add((role, text))
            turns.append((role, text, fault))
            if fault:
                counts[fault] += 1
        cost, audit, repaired = cheapest(turns)
        numbers = [r[1] for r in mine if r[1] is not None]
        counts["illegal"] = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(mine))
        counts["gaps"] = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        out[conv] = counts | {"cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256("\n".join(repaired).encode()).hexdigest()}
    return out


def made(rng, n_conv, longest):
    rows = []
    for conv in range(n_conv):
        roles = ["system"] * (rng.random() < 0.4) + ["user", "assistant"] * longest
        for turn, role in enumerate(roles[: rng.randrange(1, longest)]):
            if rng.random() < 0.15:
                role = rng.choice(["assistant", "user", "system", "tool", "", "umpire", None])
            text = rng.choice(["Yes.", "No!", "So what", "Well? ", "a.b", " \t", None, "", f"text {rng.random()}.", f"more {turn}?\n", "été"])
            rows.append((conv, turn if rng.random() < 0.97 else None, role, text))
    return rows


def result(df):
    return {r["conv_id"]: {k: v for k, v in r.asDict().items() if k != "conv_id"} for r in df.collect()}


@pytest.mark.parametrize("piece", [3, 256])
def test_repair_is_the_cheapest(spark, monkeypatch, piece):
    monkeypatch.setattr(dialogue, "PIECE", piece)
    rng = random.Random(12)
    rows = made(rng, 70, 9)
    rows += [(200, t, r, x) for t, r, x in [(5, "user", "A."), (5, "assistant", "B."), (9, "user", "A."), (9, "user", "A."), (-3, "system", "Be.")]]
    rows += [(None, 1, "user", "Hi."), (None, 2, "assistant", "Ho."), (None, None, "user", "Hi."), (2**62, None, None, None)]
    rows += [(300, t, "user" if t % 2 else "assistant", f"Line {t}{'.' if t % 7 else ''}") for t in range(40)]
    lost = next(i for i in range(400, 10_000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    rows.append((lost, 0, "user", "Gone."))
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], DDL).repartition(5)
    assert result(dialogue.repair_damaged(df)) == (want := brute([r for r in rows if r[0] != lost]) | {lost: dict.fromkeys(["gaps", "blank", "duplicate", "truncated", "illegal", "cost"], 0) | {"audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()}})
    assert {"K", "R", "D"} <= set("".join(w["audit"] for w in want.values()))


def test_alignment_of_a_part_knows_all_states():
    # Within one conversation an insertion is never cheapest; between given states it is.
    found = {(a, b): (cost, audit) for a, b, cost, audit in dialogue.align(["u"], [dialogue.OK], False)}
    assert found[dialogue.USER, dialogue.ASSISTANT] == (1, "R") and found[dialogue.USER, dialogue.USER] == (2, "D")
    assert found[dialogue.ASSISTANT, dialogue.ASSISTANT] == (2, "D") and found[dialogue.NONE, dialogue.ASSISTANT] == (5, "KI")
    assert found[dialogue.SYSTEM, dialogue.SYSTEM] == (2, "D") and found[dialogue.NONE, dialogue.USER] == (0, "K")


def test_one_conversation_of_all_rows_is_spread(spark, monkeypatch):
    monkeypatch.setattr(dialogue, "PIECE", 16)
    rng = random.Random(5)
    rows = [(7, t, rng.choice(["user", "assistant"]), rng.choice([f"Line {t}.", "Again.", "cut"])) for t in range(400)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    done = dialogue.Repair(df)
    got, one = result(done.summary), None
    initials, faults = [r[2][0] for r in rows], []
    seen = set()
    for _, _, role, text in rows:
        faults.append(dialogue.DUPLICATE if (role, text) in seen else dialogue.CUT if text == "cut" else dialogue.OK)
        seen.add((role, text))
    ((_, _, cost, one),) = dialogue.align(initials, faults, True)
    assert got[7]["cost"] == cost and got[7]["audit"] == one
    turns = done.edits.orderBy("start", "k").collect()
    assert "".join(t["edit"] for t in turns) == one
    kept = [t for t in turns if t["edit"] != "D"]
    assert GRAMMAR.fullmatch("".join(t["role"][0] for t in kept))
    assert got[7]["repaired_sha256"] == hashlib.sha256("\n".join(f"{t['role']}:{t['text']}" for t in kept).encode()).hexdigest()


def test_empty_table(spark):
    df = spark.createDataFrame([], DDL)
    assert dialogue.repair_damaged(df).count() == 0
