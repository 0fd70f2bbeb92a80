"""op12: conversation repair against a plain version: damage, faults and a uniform-cost search."""

import hashlib
import heapq
import re
import time
import zlib

import pytest

from presslake.llm import conversation_repair as cr

SCHEMA = "conv_id long, turn long, role string, text string, pos string, fault string"
STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
EXPECTED = {0: "user", 1: "user", 2: "assistant", 3: "user"}


def damage(rows):
    out = []
    for conv, turn, role, text, *_ in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        code = zlib.crc32(key.encode()) % 20
        role, text = role if role is not None else " ", text if text is not None else " "
        if code == 0:
            continue
        if code == 1:
            text = ""
        if code == 2:
            text = re.sub(r"[.!?]", "", text)
        if code == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (2 if code == 3 else 1)
    return out


def best_script(initials, faults):
    """Uniform-cost search over whole prefixes ordered by (cost, audit): no bounds, no tables."""
    n = len(initials)
    heap = [(0, "", 0, 0, ())]
    while heap:
        cost, audit, i, s, script = heapq.heappop(heap)
        if i == n and s in (0, 3):
            return cost, audit, script
        moves = []
        if i < n:
            moves.append(("D", 3, i + 1, s, ""))
            if faults[i] in (0, 3):
                cut = 1 if faults[i] == 3 else 0
                if (s, initials[i]) in STEP:
                    moves.append(("K", cut, i + 1, STEP[(s, initials[i])], None))
                moves.append(("R", 2 + cut, i + 1, STEP[(s, EXPECTED[s][0])], EXPECTED[s]))
        moves.append(("I", 2, i, STEP[(s, EXPECTED[s][0])], EXPECTED[s]))
        for edit, add, j, t, role in moves:
            heapq.heappush(heap, (cost + add, audit + edit, j, t, script + ((edit, role, i),)))


def brute(rows):
    convs = {}
    for row in damage(rows):
        convs.setdefault(row[0], []).append(row)
    out = {}
    for conv in {r[0] for r in rows}:
        got = sorted(convs.get(conv, []), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        seen, faults, initials = set(), [], []
        for _, _, role, text in got:
            words = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = 1 if not words else 2 if (role, text) in seen else 3 if words[-1] not in ".!?" else 0
            seen.add((role, text))
            faults.append(fault)
            initials.append(role[:1] or " ")
        turns = [r[1] for r in got if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, audit, script = best_script(initials, faults)
        lines = []
        for edit, role, i in script:
            if edit == "I":
                lines.append(f"{role}:")
            elif edit == "K":
                lines.append(f"{got[i][2]}:{got[i][3]}")
            elif edit == "R":
                lines.append(f"{role}:{got[i][3]}")
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out[conv] = (conv, gaps, faults.count(1), faults.count(2), faults.count(3), illegal, cost, audit, digest)
    return sorted(out.values(), key=lambda r: (r[0] is not None, r[0] or 0))


def result(spark, rows):
    got = cr.repaired(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    columns = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return sorted((tuple(r[c] for c in columns) for r in got), key=lambda r: (r[0] is not None, r[0] or 0))


def sample_rows():
    roles = ["user", "assistant", "system", "user", "tool", None, "assistant"]
    texts = ["Hello there.", "Sure!", "what now", "", "   ", None, "Fine?", "Hello there.", "done. ok", "x" * 50_000 + "."]
    rows = []
    for conv in range(40):
        for turn in range(conv % 6):
            rows.append((conv, turn if (conv + turn) % 7 else None, roles[(conv * 3 + turn) % 7], texts[(conv + turn * 5) % 10], "p", "f"))
    rows += [(None, 1, "user", "Hi.", "p", "f"), (None, None, "assistant", "Hi.", "p", "f"), (100, 3, "user", "Same.", "p", "f"), (100, 3, "user", "Same.", "p", "f"),
             (101, 0, "system", "Rules.", "p", "f"), (101, 5, "user", "Ask", "p", "f")]
    return rows


def test_against_plain_search(spark):
    rows = sample_rows()
    assert result(spark, rows) == brute(rows)


def test_no_rows_after_damage_and_empty_table(spark):
    # Turn chosen so that the row is dropped by damage (code 0).
    turn = next(t for t in range(1000) if zlib.crc32(f"7:{t}".encode()) % 20 == 0)
    got = result(spark, [(7, turn, "user", "Hi.", "", "")])
    assert got == [(7, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert result(spark, []) == []


@pytest.mark.parametrize("initials, faults, cost, audit", [
    ("", [], 0, ""),
    ("s", [0], 3, "D"),
    ("ua", [0, 0], 0, "KK"),
    ("au", [0, 0], 4, "IKKI"),
    ("uu", [0, 3], 3, "KR"),
    ("suu", [0, 0, 1], 5, "KKDI"),
    ("xsauua", [0, 0, 0, 2, 0, 3], None, None),
    ("aaaaaa", [3, 0, 3, 0, 0, 0], None, None),
])
def test_search_cases(initials, faults, cost, audit):
    got_cost, got_audit, _ = cr.repair(list(initials), faults)
    plain_cost, plain_audit, _ = best_script(list(initials), faults)
    assert (got_cost, got_audit) == (plain_cost, plain_audit)
    if cost is not None:
        assert (got_cost, got_audit) == (cost, audit)


def test_search_long_conversation_is_linear():
    initials = list("suaua" * 4000 + "uuaas" * 4000)
    faults = [0, 3, 0, 1, 2] * 8000
    started = time.time()
    cost, audit, script = cr.repair(initials, faults)
    assert cost > 0 and len(audit) >= len(initials) and time.time() - started < 10
