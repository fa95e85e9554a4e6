"""Conversation repair against a search over all edits."""

import hashlib
import heapq
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest

from quern.llm.dialogue import Path, damaged, op11_conversation_repair, repair_digests, repaired_turns, with_gone

VALID = re.compile(r"(s?(ua)+)?\Z")
FOLLOWS = {"": "u", "s": "u", "u": "a", "a": "u"}
FULL = {"u": "user", "a": "assistant"}
SCHEMA = "conv_id long, turn long, role string, text string"


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        blank = lambda v: " " if v is None else v
        role, text, kind = blank(role), blank(text), zlib.crc32(f"{blank(conv)}:{blank(turn)}".encode()) % 20
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def cheapest(turns):
    """(cost, audit, repaired turns): all edits in the order of cost, then of their initials."""
    heap, seen = [(0, "", 0, "", ())], set()
    while True:
        cost, audit, i, last, made = heapq.heappop(heap)
        if (i, last) in seen:
            continue
        seen.add((i, last))
        if i == len(turns) and last in ("", "a"):
            return cost, audit, made
        heapq.heappush(heap, (cost + 3, audit + "I", i, FOLLOWS[last], (*made, (FULL[FOLLOWS[last]], ""))))
        if i < len(turns):
            role, text, fault = turns[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, last, made))
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                if role[:1] == FOLLOWS[last] or (last == "" and role[:1] == "s"):
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, role[:1], (*made, (role, text))))
                heapq.heappush(heap, (cost + 3 + more, audit + "R", i + 1, FOLLOWS[last], (*made, (FULL[FOLLOWS[last]], text))))


def brute(rows, after=damage):
    convs = defaultdict(list)
    for conv, *_ in rows:
        convs[conv] = []
    for conv, turn, role, text in after(rows):
        convs[conv].append((turn, role, text))
    out = []
    for conv, own in convs.items():
        own.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], hashlib.md5(x[2].encode()).digest()))
        seen, turns, n = set(), [], defaultdict(int)
        for _, role, text in own:
            body = text.strip(" \t\n\x0b\x0c\r")
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
            seen.add((role, text))
            n[fault] += 1
            turns.append((role, text, fault))
        known = [t for t, _, _ in own if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        cost, audit, made = cheapest(turns)
        assert VALID.match("".join(r[:1] for r, _ in made))
        out.append((conv, gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest()))
    return sorted(out, key=str)


def collected(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def odd():
    rng, rows = random.Random(3), []
    roles, texts = ["user", "assistant", "system", "tool", "", None, "u", "Ünder"], ["Hi.", "ok", "Yes!", "", " \n", None, "a?", "b. ", "c.\x0b", "é" * 5000]
    for conv in range(300):
        for k in range(rng.randint(1, 9)):
            rows.append((rng.choice([conv, conv, conv, None]), rng.choice([k, k, rng.randint(0, 4), None]), rng.choice(roles), rng.choice(texts)))
    return rows + rows[:100]


def test_odd_rows(spark, odd):
    df = spark.createDataFrame(odd, SCHEMA).repartition(5)
    assert collected(repair_digests(damaged(df))) == brute(odd)
    assert collected(repair_digests(with_gone(df))) == brute(odd, lambda rows: [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows])


def test_given_conversations(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert collected(op11_conversation_repair(spark, "/root/testdata/sf0.001")) == brute(rows)


def test_other_columns_and_no_rows(spark, odd):
    df = spark.createDataFrame([(*r, 1, "x") for r in odd[:50]], SCHEMA + ", kind int, digest string")
    assert collected(repair_digests(damaged(df))) == brute(odd[:50])
    assert repair_digests(damaged(df.limit(0))).count() == 0


def test_all_rows_dropped(spark):
    conv, turn = next((c, t) for c in range(9) for t in range(99) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0)
    got = collected(repair_digests(damaged(spark.createDataFrame([(conv, turn, "user", "Hi.")], SCHEMA))))
    assert got == [(conv, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_long_conversation(spark):
    """One conversation of many equal turns, among short ones."""
    rows = [(1, k, ("user", "assistant")[k % 3 % 2], f"Turn {k % 7}.") for k in range(3000)] + [(k, 0, "user", "Hi.") for k in range(2, 200)]
    want = {r[0]: r[1:] for r in brute([r for r in rows if r[0] != 1])}
    got = {r[0]: r[1:] for r in collected(repair_digests(damaged(spark.createDataFrame(rows, SCHEMA).repartition(6))))}
    assert {k: v for k, v in got.items() if k != 1} == want
    after = damage(rows[:3000])
    fresh, seen = 0, set()
    for _, _, role, text in after:
        fresh += bool(text.strip()) and (role, text) not in seen
        seen.add((role, text))
    assert got[1][6].count("K") + got[1][6].count("R") <= fresh and len(got[1][6].replace("I", "")) == len(after)


def test_repaired_turns(spark, odd):
    df = damaged(spark.createDataFrame(odd, SCHEMA).repartition(3))
    digests = {r.conv_id: r for r in repair_digests(df).collect()}
    made = defaultdict(list)
    for r in sorted(repaired_turns(df).collect(), key=lambda r: r.position):
        made[r.conv_id].append(r)
    for conv, r in digests.items():
        assert hashlib.sha256("\n".join(f"{x.role}:{x.text}" for x in made[conv]).encode()).hexdigest() == r.repaired_sha256
        assert "".join(x.edit for x in made[conv]) == r.audit.replace("D", "")


def test_shared_prefixes_are_worked_out_once():
    signatures = sorted("".join(x) for n in range(5) for x in itertools.product("suaoxA", repeat=n))
    path = Path()
    for s in signatures:
        role = {"s": "system", "u": "user", "a": "assistant", "o": "tool", "x": "", "A": "assistant"}
        cost, audit, _ = cheapest([(role[c], "", {"x": "blank", "A": "truncated"}.get(c, "")) for c in s])
        assert path.repair(s) == (cost, audit)
    assert path.computed == sum(1 for s in signatures if s)  # a layer for each node of the trie
