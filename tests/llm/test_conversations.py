import hashlib
import heapq
import itertools
import random
import re
import zlib

import pytest

from tallyspark.llm import conversations, queries
from tests.conftest import duck, same_rows

SF = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string, cost string, audit int"


def damaged(rows):
    out = []
    for c, t, r, x, *_ in rows:
        c_, t_, r, x = (" " if v is None else str(v) for v in (c, t, r, x))
        fate = zlib.crc32(f"{c_}:{t_}".encode()) % 20
        if fate:
            x = "" if fate == 1 else re.sub("[.!?]", "", x) if fate == 2 else x
            out += [(c, t, "user" if fate == 4 else r, x)] * (2 if fate == 3 else 1)
    return out


def faults(rows):
    out, seen = [], set()
    for _, _, r, x in rows:
        solid = re.sub(r"[\x20\x09-\x0D]+", "", x)
        out.append("blank" if not solid else "duplicate" if (r, x) in seen else None if solid[-1] in ".!?" else "truncated")
        seen.add((r, x))
    return out


def cheapest(rows, marks):
    """Uniform-cost search over (turns done, state); the state is the last role's initial, '' before any."""
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, state, lines = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(rows) and state in ("", "a"):
            return cost, audit, lines
        then = "assistant" if state == "u" else "user"
        heapq.heappush(heap, (cost + 2, audit + "I", i, then[0], (*lines, f"{then}:")))
        if i < len(rows):
            _, _, role, text = rows[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, state, lines))
            if marks[i] in (None, "truncated"):
                late = marks[i] == "truncated"
                heapq.heappush(heap, (cost + 2 + late, audit + "R", i + 1, then[0], (*lines, f"{then}:{text}")))
                if role[:1] == then[0] or (role[:1] == "s" and state == ""):
                    heapq.heappush(heap, (cost + late, audit + "K", i + 1, role[:1], (*lines, f"{role}:{text}")))


def exhaustive(rows, marks):
    """All edits with up to two inserts before each turn and at the end; (cost, audit) of the least."""
    best = None
    for letters in itertools.product("KRD", repeat=len(rows)):
        if any(m in ("blank", "duplicate") and x != "D" for m, x in zip(marks, letters, strict=True)):
            continue
        for inserts in itertools.product(range(3), repeat=len(rows) + 1):
            cost = 2 * sum(inserts) + sum({"K": 0, "R": 2, "D": 3}[x] + (m == "truncated" and x != "D") for m, x in zip(marks, letters, strict=True))
            audit = "".join("I" * n + x for n, x in zip(inserts, [*letters, ""], strict=True))
            ways = [""]
            for n, x, row in zip(inserts, [*letters, ""], [*rows, None], strict=True):
                for _ in range(n):
                    ways = [w + r for w in ways for r in "ua"]
                ways = ways if x in ("D", "") else [w + (row[2][:1] or "?") for w in ways] if x == "K" else [w + r for w in ways for r in "ua"]
            if any(re.fullmatch("(s?(ua)+)?", w) for w in ways):
                best = min(x for x in (best, (cost, audit)) if x)
    return best


def expected(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in damaged(rows) if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
        marks = faults(own)
        turns = [r[1] for r in own if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        cost, audit, lines = cheapest(own, marks)
        if len(own) < 4:
            assert (cost, audit) == exhaustive(own, marks)
        out[conv] = (gaps, *(marks.count(m) for m in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def conversations_of(seed, many, longest):
    r = random.Random(seed)
    rows = []
    for c in range(many):
        for t in range(r.randrange(longest)):
            role = r.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "users", "System"])
            rows.append((c, r.choice([t, t, t, t + 2, 1, None]), role, r.choice(["Yes.", "no", " ", "ok!", None, "what? ", "é.", "end.\n", "\n\t", "x" * r.randrange(3) + "."]), None, 1))
    return rows


def got(frame):
    return {r[0]: tuple(r)[1:] for r in frame.collect()}


def test_repairs_match_searches(spark):
    rows = [*conversations_of(1, 120, 9), (None, None, None, None, None, None), (None, 3, "user", "Hi.", None, None), (500, 1, "user", "x" * 200_000 + ".", None, None), (501, 1, "assistant", "a.", None, 2), (501, 1, "assistant", "a.", None, 2)]
    assert got(conversations.repair(spark.createDataFrame(rows, SCHEMA).repartition(3))) == expected(rows)


def test_chunks_change_nothing(spark, monkeypatch):
    rows = conversations_of(2, 6, 60) + [(77, t, ("user", "assistant")[t % 2], f"{t}.", None, 1) for t in range(400)]
    monkeypatch.setattr(conversations, "CHUNK", 4)
    assert got(conversations.repair(spark.createDataFrame(rows, SCHEMA))) == expected(rows)


def test_no_conversations(spark):
    assert conversations.repair(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("sf", [SF])
def test_repair_matches_sql(spark, sf):
    same_rows(queries.QUERIES["op13_conversation_repair"](spark, sf), duck(sf), queries.ORACLE_SQL["op13_conversation_repair"])
