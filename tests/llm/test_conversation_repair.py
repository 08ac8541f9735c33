"""Conversation repair against a search over all edits."""

from __future__ import annotations

import hashlib
import heapq
import random
import re
import zlib

from wickmill.llm import conversation_repair as cr

SCHEMA = "conv_id long, turn long, role string, text string, cost string, audit int"
WHITE = " \t\n\x0b\x0c\r"


def search(marks):
    """The cheapest edits of a list of marks, cheapest first and then in ASCII order."""
    best, heap = None, [(0, "", 0, "")]
    while heap:
        cost, audit, at, out = heapq.heappop(heap)
        if best and cost > best[0]:
            return best
        if at == len(marks) and re.fullmatch(r"(s?(ua)+)?", out) and (best is None or (cost, audit) < best):
            best = (cost, audit)

        def go(price, edit, step, role):
            if re.fullmatch(r"s?(ua)*u?", out + role) and len(out) < len(marks) + 3:
                heapq.heappush(heap, (cost + price, audit + edit, at + step, out + role))

        for role in "ua":
            go(2, "I", 0, role)
        if at < len(marks):
            mark = marks[at]
            go(3, "D", 1, "")
            if mark != "x":
                extra = int(mark.isupper())
                if mark.lower() != "o":
                    go(extra, "K", 1, mark.lower())
                for role in "ua":
                    go(2 + extra, "R", 1, role)
    return best


def parsed(marks):
    parse = cr.Parse()
    for mark in marks:
        parse.add(mark)
    return parse.result()


def test_parses_are_the_cheapest_edits_and_least_in_ascii():
    rng = random.Random(3)
    assert parsed("") == (0, "")
    for _ in range(250):
        marks = "".join(rng.choice("suasuauaoSUAOx") for _ in range(rng.randrange(1, 6)))
        assert parsed(marks) == search(marks), marks


def test_blocks_of_any_size_give_the_same_parse(monkeypatch):
    rng = random.Random(4)
    for _ in range(60):
        marks = "".join(rng.choice("suasuauaoSUAOx") for _ in range(rng.randrange(0, 45)))
        found = set()
        for block in (1, 4, 16):
            monkeypatch.setattr(cr, "BLOCK", block)
            found.add(parsed(marks))
        assert len(found) == 1, marks


def brute(rows):
    convs = {}
    for conv_id, turn, role, text in rows:
        convs.setdefault(conv_id, []).append((turn, role, text))
    blank = lambda v: " " if v is None else str(v)
    found = []
    for conv_id, given in convs.items():
        kept = []
        for turn, role, text in given:
            kind = zlib.crc32(f"{blank(conv_id)}:{blank(turn)}".encode()) % 20
            role, text = blank(role), blank(text)
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            if kind:
                kept += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.md5(r[2].encode()).hexdigest()))
        seen, marks, counts = set(), "", [0, 0, 0]
        for _, role, text in kept:
            mark = role[:1] if role[:1] and role[:1] in "sua" else "o"
            if not text.strip(WHITE):
                counts[0] += 1
                mark = "x"
            elif (role, text) in seen:
                counts[1] += 1
                mark = "x"
            elif text.strip(WHITE)[-1] not in ".!?":
                counts[2] += 1
                mark = mark.upper()
            seen.add((role, text))
            marks += mark
        turns = [t for t, _, _ in kept if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(kept, kept[1:]))
        cost, audit = search(marks)
        out, at = [], 0
        for edit in audit:
            want = "user" if not out or out[-1][0] in "sa" else "assistant"
            _, role, text = (None, "", "") if edit == "I" else kept[at]
            at += edit != "I"
            if edit != "D":
                out.append(f"{role if edit == 'K' else want}:{text}")
        digest = hashlib.sha256("\n".join(out).encode()).hexdigest()
        found.append((conv_id, gaps, *counts, illegal, cost, audit, digest))
    return found


COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def check(spark, rows):
    given = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(5)
    got = cr.damage_and_repair(given).select(COLUMNS).collect()
    assert sorted(map(tuple, got), key=str) == sorted(brute(rows), key=str)
    return got


def test_conversations_against_brute_force(spark):
    rng = random.Random(8)
    rows = []
    for conv_id in range(120):
        n, turn = rng.randrange(1, 7), 0
        for k in range(n):
            role = rng.choice(["system"] * (k == 0) + ["user", "assistant"] * 3 + ["tool"])
            rows.append((conv_id, turn, role, rng.choice(["One. Two!", "Same.", "open end", "  \n", "né? \t", ""])))
            turn += rng.choice((1, 1, 1, 2))
    check(spark, rows)


def test_nulls_ties_repeats_and_lost_conversations(spark):
    rows = [
        (None, None, None, None), (None, 1, "user", "a."), (1, None, "user", "a."), (1, None, "user", "a."), (1, 5, "user", "a."),
        (2, 3, "assistant", None), (2, 3, None, "x."), (2, 3, "user", "x."), (2, 3, "", "y."), (3, 0, "user", "é" * 20_000),
        (4, 9, "", ""), (5, -4, "user", "b!"), (5, -1, "assistant", "c?"), (5, 2, "assistant", "c?"),
    ]
    dropped = next(k for k in range(100, 400) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    got = check(spark, [*rows, (dropped, 0, "user", "gone.")])
    lost = next(r for r in got if r.conv_id == dropped)
    assert tuple(lost)[1:8] == (0, 0, 0, 0, 0, 0, "") and lost.repaired_sha256 == hashlib.sha256().hexdigest()
    assert check(spark, []) == []


def test_long_conversations_go_block_by_block(spark):
    rng = random.Random(9)
    rows = [(7, k, rng.choice(("user", "assistant")), f"row {k}.") for k in range(600)]
    given = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    damaged = cr.damage(given)
    judged = cr.judge(damaged)
    repaired = cr.repair(damaged, judged).orderBy("place").collect()
    audit = judged.first().audit
    assert len(audit.replace("D", "")) == len(repaired)
    assert re.fullmatch(r"(s?(ua)+)?", "".join(r.role[0] for r in repaired))
    assert [r.edit for r in repaired] == list(audit.replace("D", ""))
    kept = [r.turn for r in repaired if r.edit != "I"]
    assert kept == sorted(kept)
