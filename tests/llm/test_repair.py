import hashlib
import random
import re
import zlib
from collections import defaultdict
from functools import cache

import pytest
from pyspark.sql import functions as F

from guardlake.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string"


def cheapest(codes):
    """All edit strings compared: the least cost, then the least letters, from every place and state."""

    @cache
    def best(i, state, grown):
        found = [(0, "")] if i == len(codes) and state in (0, 3) else []
        if grown < 3:
            cost, letters = best(i, repair.NEXT[state], grown + 1)
            found.append((cost + 5, "I" + letters))
        if i < len(codes):
            role, extra, gone = codes[i]
            cost, letters = best(i + 1, state, 0)
            found.append((cost + 2, "D" + letters))
            if not gone:
                cost, letters = best(i + 1, repair.NEXT[state], 0)
                found.append((cost + 1 + extra, "R" + letters))
                if role == repair.NEXT[state] or role == 1 and state == 0:
                    cost, letters = best(i + 1, role, 0)
                    found.append((cost + extra, "K" + letters))
        return min(found, default=(10**9, ""))

    return best(0, 0, 0)


def plain(rows):
    out = {}
    by_conv = defaultdict(list)
    for conv, turn, role, text in rows:
        out[conv] = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
        word = lambda x: " " if x is None else str(x)
        kind = zlib.crc32(f"{word(conv)}:{word(turn)}".encode()) % 20
        role, text = word(role), word(text)
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        by_conv[conv] += [(turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    for conv, told in by_conv.items():
        if not told:
            continue
        told.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, codes, faults, illegal = set(), [], [], 0
        for i, (turn, role, text) in enumerate(told):
            bare = text.rstrip(" \t\n\v\f\r")
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "" if bare[-1] in ".!?" else "truncated"
            seen.add((role, text))
            faults.append(fault)
            codes.append((" sua".find(role[:1]) if role[:1] in "sua" and role else 0, 5 * (fault == "truncated"), fault in ("blank", "duplicate")))
            illegal += i > 0 and (told[i - 1][1][:1] + role[:1]) not in ("su", "ua", "au")
        cost, audit = cheapest(tuple(codes))
        lines, at, state = [], 0, 0
        for letter in audit:
            turn, role, text = told[at] if at < len(told) else (None, "", "")
            if letter in "IR":
                state = repair.NEXT[state]
                lines.append(repair.ROLE_OF[state] + ":" + (text if letter == "R" else ""))
            elif letter == "K":
                state = "_sua".index(role[0])
                lines.append(role + ":" + text)
            at += letter != "I"
        turns = [t for t, _, _ in told if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (
            gaps, *(faults.count(f) for f in repair.FAULTS), illegal, cost, audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        )
    return out


def rows_of(rng, convs, most):
    rows = []
    for conv in range(convs):
        for turn in range(rng.randint(1, most)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", None, "tool", "", "support"])
            text = rng.choice(["Yes.", "No", "What?", "a b!", None, "", " \n", "Ünï.", "long " * 50 + "."]) if turn % 2 else f"t{turn}."
            rows.append((conv, rng.choice([turn, turn, turn, turn + 3, None]), role, text))
    return rows


def summary(spark, rows, **options):
    frame = spark.createDataFrame(rows, SCHEMA).repartition(7).selectExpr("*", "1 AS step", "2 AS uid", "3 AS conv")
    frame = frame.select("conv_id", "turn", "role", "text")
    found = repair.summaries(repair.repaired(repair.damaged(frame), **options), frame.select(F.col("conv_id").alias("conv")))
    return {r[0]: tuple(r)[1:] for r in found.collect()}


@pytest.mark.parametrize("options", [{}, {"chunk_rows": 3}, {"chunk_rows": 2, "passes": 0}])
def test_repair_matches_comparing_all_edits(spark, options):
    rng = random.Random(3)
    rows = rows_of(rng, 60, 14)
    rows += [rows[5], rows[5], (None, 1, "user", "Hi."), (None, None, None, None), (None, 2, "assistant", "Ho.")]
    rows += [(1000, t, "user", "same") for t in range(40)] + [(1001, t, ("user", "assistant")[t % 2], f"open {t}") for t in range(60)]
    rows += [(1002, t, ("assistant", "user")[t % 2], f"open {t}.") for t in range(60)]
    assert summary(spark, rows, **options) == plain(rows)


def test_chunks_converge_and_compose():
    rng = random.Random(1)
    trellis = repair.Trellis()
    for _ in range(200):
        codes = bytes(rng.choice([1, 2, 3, 0]) + rng.choice([0, 0, 4, 8]) for _ in range(rng.randint(0, 30)))
        whole = trellis.solve(codes, repair.FINAL)
        at = rng.randint(0, len(codes))
        guessed = trellis.solve(codes[:at], repair.FINAL)
        assert trellis.solve(codes[:at], whole[at], guessed) == whole[: at + 1]
        costs = trellis.map(codes)
        begin = [min(repair.FINAL[t] + costs[4 * t + s] for t in range(4)) for s in range(4)]
        assert tuple(c - min(begin) for c in begin) == whole[0] if codes else True


def test_a_mended_chunk_stops_early():
    """Costs that differ at the end agree, up to a constant, after a few rows."""
    codes = bytes([2, 3] * 500)
    trellis = repair.Trellis()
    guessed = trellis.solve(codes, repair.FINAL)
    stepped = []
    before = trellis.before
    trellis.before = lambda code, after: (stepped.append(1), before(code, after))[1]
    trellis.solve(codes, (3, 3, 0, 5), guessed)
    assert len(stepped) < 10


def test_nothing(spark):
    assert summary(spark, []) == {}
    assert summary(spark, [(i, None, None, None) for i in range(30)]) == plain([(i, None, None, None) for i in range(30)])
