"""Repair of the structure of conversations by the cheapest edits.

What an edit may do to a turn depends on the initial of its role and on its fault alone, a letter of nine. The letters
of a conversation are its signature. Signatures are dealt by ranges and sorted, so that those of a task come in the
order of a walk through their trie: the layers of the dynamic program along the current path are kept, a shared prefix
is worked out once, and an answer is read off where a signature ends. Texts meet the edits in a last pass.

Roles must end up as nothing, or an optional system turn and pairs of user and assistant. States of the program are
what the last role was: 0 none, 1 system, 2 user, 3 assistant; 0 and 3 may be the end.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.pretok import lean

DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
#: The state after a user or assistant turn that an edit makes, and its role.
NEXT = (2, 2, 3, 2)
MADE = {2: "user", 3: "assistant"}
#: (state, initial) in which a turn may be kept, and the state after it.
KEPT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
FINAL = (0, 3)
#: The letter of a turn that must go; of others it is the initial of the role, o for another one, upper case if truncated.
GOES = "x"
_FAR = 1 << 40
SPACE = " \t\n\x0b\x0c\r"


def _inserted(costs: list[int]) -> tuple[int, ...]:
    for _ in range(3):
        for s in range(4):
            costs[NEXT[s]] = min(costs[NEXT[s]], costs[s] + INSERT)
    return tuple(costs)


#: Before the first turn.
START = _inserted([0, _FAR, _FAR, _FAR])


def _edits(state: int, letter: str) -> list[tuple[str, int, int]]:
    """(initial, cost, state after it) of the edits of a turn, initials in ASCII order."""
    out = [("D", DELETE, state)]
    if letter != GOES:
        extra = TRUNCATED if letter.isupper() else 0
        if (state, letter.lower()) in KEPT:
            out.append(("K", extra, KEPT[state, letter.lower()]))
        out.append(("R", REROLE + extra, NEXT[state]))
    return out


@cache
def layer(costs: tuple[int, ...], letter: str) -> tuple[tuple[int, ...], int]:
    """The next layer of costs by state, less their least, and that. Few layers differ, so they are remembered."""
    out = [_FAR] * 4
    for s, cost in enumerate(costs):
        if cost < _FAR:
            for _, more, t in _edits(s, letter):
                out[t] = min(out[t], cost + more)
    least = min(out)
    return _inserted([_FAR if x >= _FAR else x - least for x in out]), least


def _with_inserts(costs: tuple[int, ...], good: set[int]) -> frozenset[int]:
    """`good` states of a layer and those from which inserts lead there at no more cost."""
    for _ in range(3):
        good = good | {s for s in range(4) if costs[s] < _FAR and costs[s] + INSERT == costs[NEXT[s]] and NEXT[s] in good}
    return frozenset(good)


@cache
def ends(costs: tuple[int, ...]) -> frozenset[int]:
    best = min(costs[s] for s in FINAL)
    return frozenset(s for s in FINAL if costs[s] == best)


@cache
def last_good(costs: tuple[int, ...]) -> frozenset[int]:
    return _with_inserts(costs, set(ends(costs)))


def _tight(costs: tuple[int, ...], letter: str, s: int, good: frozenset[int]) -> list[tuple[str, int]]:
    """The edits of the next turn that cheapest repairs make in this state: `good` are the states after it that they have."""
    after, least = layer(costs, letter)
    return [(name, t) for name, more, t in _edits(s, letter) if t in good and costs[s] + more - least == after[t]]


@cache
def good_before(costs: tuple[int, ...], letter: str, good: frozenset[int]) -> frozenset[int]:
    return _with_inserts(costs, {s for s in range(4) if costs[s] < _FAR and _tight(costs, letter, s, good)})


@cache
def walk(costs: tuple[int, ...], own: frozenset[int], letter: str, good: frozenset[int], state: int) -> tuple[str, int]:
    """The least initials of edits up to and with the next turn ("" as letter: up to the end), and the state after them."""
    made = ""
    while letter or state not in ends(costs):
        turn = _tight(costs, letter, state, good) if letter else []
        insert = NEXT[state] in own and costs[state] + INSERT == costs[NEXT[state]]
        if turn and (turn[0][0] < "I" or not insert):
            return made + turn[0][0], turn[0][1]
        made, state = made + "I", NEXT[state]
    return made, state


class Path:
    """The layers along one path of the trie of signatures."""

    def __init__(self) -> None:
        self.signature = ""
        self.layers: list[tuple[tuple[int, ...], int]] = [(START, 0)]
        self.computed = 0

    def repair(self, signature: str) -> tuple[int, str]:
        """(cost, audit) of the cheapest edits, of those the ASCII-least. Layers of the prefix shared with the signature
        before are kept."""
        shared, most = 0, min(len(signature), len(self.signature))
        if signature[:most] == self.signature[:most]:
            shared = most
        else:
            a, b = (np.frombuffer(x[:most].encode(), np.uint8) for x in (signature, self.signature))
            shared = int((a != b).argmax())
        del self.layers[shared + 1 :]
        for letter in signature[shared:]:
            costs, upto = self.layers[-1]
            costs, least = layer(costs, letter)
            self.layers.append((costs, upto + least))
            self.computed += 1
        self.signature = signature
        last, upto = self.layers[-1]
        good = [last_good(last)]
        for k in range(len(signature) - 1, -1, -1):
            good.append(good_before(self.layers[k][0], signature[k], good[-1]))
        good.reverse()
        state, audit = 0, []
        for k, letter in enumerate(signature):
            made, state = walk(self.layers[k][0], good[k], letter, good[k + 1], state)
            audit.append(made)
        audit.append(walk(last, good[-1], "", good[-1], state)[0])
        return upto + min(last[s] for s in FINAL), "".join(audit)


def damaged(df: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, gone): rows damaged by the CRC of `conv_id:turn`; nulls are one space, in roles and
    texts too. 1 in 20 each is dropped (`gone`), emptied, loses its `.!?`, is there twice, or becomes a user's."""
    space = F.lit(" ")
    rows = df.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *(F.coalesce(F.col(c).cast("string"), space).alias(c) for c in ("role", "text")))
    kind = F.crc32(F.concat(*(F.coalesce(F.col(c).cast("string"), space) if c != ":" else F.lit(c) for c in ("conv_id", ":", "turn")))) % 20
    rows = rows.withColumn("kind", kind)
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("kind") == 0).alias("gone"), copies.alias("copy")).drop("copy")


def _digest(text: Column) -> Column:
    return F.unhex(F.md5(text))


#: Order of a conversation's turns.
ORDER = ("turn", "role", "digest")


def turn_facts(rows: DataFrame) -> DataFrame:
    """(conv_id, gone, turn, role, digest, blank, open, first, n): distinct turns and how many there are of each.

    `open` is a truncated text; `first` the first turn of its role and text. Repeats are counted before anything is
    shuffled.
    """
    solid = F.rtrim("text", F.lit(SPACE))
    kept = F.when(~F.col("gone"), F.lit(True))  # of rows that are gone only the conversation is left
    facts = rows.select("conv_id", "gone", F.when(kept, F.col("turn")).alias("turn"), F.when(kept, F.col("role")).alias("role"), F.when(kept, _digest(F.col("text"))).alias("digest"), F.when(kept, solid == "").alias("blank"), F.when(kept, ~F.right(solid, F.lit(1)).isin(".", "!", "?")).alias("open"))
    facts = facts.groupBy(*facts.columns).agg(F.count("*").alias("n"))
    same = Window.partitionBy("conv_id", "gone", "role", "digest").orderBy(F.asc_nulls_first("turn"))
    return facts.withColumn("first", F.row_number().over(same) == 1)


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Facts sorted by conversation and ORDER -> a row for each conversation, with its signature."""
    names = ("conv_id", "gone", "turn", "role", "blank", "open", "first", "n")
    counts = ("blank", "duplicate", "truncated", "illegal")
    fresh = lambda: {"low": None, "high": None, "turns": 0, "last": None, "end": None, "letters": [], **dict.fromkeys(counts, 0)}
    now, own, done = None, None, []

    def out() -> pa.RecordBatch:
        gaps = [0 if c["low"] is None else c["high"] - c["low"] + 1 - c["turns"] for _, c in done]
        cols = [pa.array([k for k, _ in done], pa.int64()), pa.array(gaps, pa.int64()), *(pa.array([c[n] for _, c in done], pa.int64()) for n in counts), pa.array(["".join(c["letters"]) for _, c in done], pa.string())]
        return pa.RecordBatch.from_arrays(cols, names=["conv_id", "gaps", *counts, "signature"])

    for b in batches:
        for conv, gone, turn, role, blank, is_open, first, n in zip(*(b.column(c).to_pylist() for c in names), strict=True):
            if own is None or conv != now:
                if own is not None:
                    done.append((now, own))
                now, own = conv, fresh()
            if gone:
                continue
            if turn is not None:
                own["low"] = turn if own["low"] is None else own["low"]
                own["turns"] += turn != own["last"]
                own["high"] = own["last"] = turn
            initial = role[:1]
            own["illegal"] += (own["end"] is not None and own["end"] + initial not in ("su", "ua", "au")) + (n - 1)  # equal initials are never in order
            own["end"] = initial
            one = not blank and first
            if blank:
                own["blank"] += n
            else:
                own["duplicate"] += n - first
                own["truncated"] += one and is_open
            letter = initial if initial in ("s", "u", "a") else "o"
            own["letters"].append((letter.upper() if is_open else letter) if one else GOES)
            if n > 1:
                own["letters"].append(GOES * (n - 1))
        if len(done) > 1000:
            yield out()
            done = []
    if own is not None:
        done.append((now, own))
        yield out()


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds cost and audit; equal signatures come one after the other and are worked out once."""
    path, before, answer = Path(), None, (0, "")
    for b in batches:
        found = []
        for signature in b.column("signature").to_pylist():
            if signature != before:
                before, answer = signature, path.repair(signature)
            found.append(answer)
        cols = [*(b.column(n) for n in b.schema.names if n != "signature"), pa.array([c for c, _ in found], pa.int64()), pa.array([a for _, a in found], pa.string())]
        yield pa.RecordBatch.from_arrays(cols, names=[*(n for n in b.schema.names if n != "signature"), "cost", "audit"])


NUMBERS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def repairs(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit): one row for each conversation of `rows`
    (conv_id, turn, role, text, gone)."""
    facts = turn_facts(rows).repartition("conv_id").sortWithinPartitions("conv_id", *ORDER)
    told = facts.mapInArrow(_conversations, "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, signature string")
    dealt = told.repartitionByRange("signature", "conv_id").sortWithinPartitions("signature")
    return dealt.mapInArrow(_repaired, "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string")


def _edited(result: Callable[[int | None, list, str, Iterator[tuple[str, str]]], Iterator[tuple]], schema: pa.Schema) -> Callable:
    """A mapInArrow function over the conversations' audits, each before its turns: `result` takes (conv_id, numbers,
    audit, turns) and gives rows. Turns are passed on as they are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for b in batches for row in zip(*(b.column(c).to_pylist() for c in ("conv_id", "numbers", "audit", "role", "text")), strict=True))
        head, held, size = next(rows, None), [], 0

        def turns() -> Iterator[tuple[str, str]]:
            nonlocal head
            for row in rows:
                if row[2] is not None:
                    head = row
                    return
                yield row[3], row[4]
            head = None

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in held], f.type) for k, f in enumerate(schema)], schema=schema)

        while head is not None:
            conv, numbers, audit, _, _ = head
            for row in result(conv, numbers, audit, turns()):
                held.append(row)
                size += sum(len(x) for x in row if isinstance(x, str))
                if len(held) >= 1000 or size > 1_000_000:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    return lean(run)


def edited(audit: str, turns: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of the turns that an audit leaves or makes."""
    state = 0
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(turns)
        if edit == "D":
            continue
        if edit == "K":
            state = KEPT[state, role[:1]]
        else:
            state = NEXT[state]
            role = MADE[state]
        yield edit, role, text
    for _ in turns:
        raise ValueError("a conversation has more turns than its audit")


def _digested(conv: int | None, numbers: list, audit: str, turns: Iterator[tuple[str, str]]) -> Iterator[tuple]:
    h = hashlib.sha256()
    for k, (_, role, text) in enumerate(edited(audit, turns)):
        h.update(("\n" * (k > 0) + f"{role}:{text}").encode())
    yield conv, *numbers, audit, h.hexdigest()


def _turned(conv: int | None, numbers: list, audit: str, turns: Iterator[tuple[str, str]]) -> Iterator[tuple]:
    for k, (edit, role, text) in enumerate(edited(audit, turns)):
        yield conv, k, edit, role, text


def _passed(rows: DataFrame, result: Callable, schema: pa.Schema) -> DataFrame:
    none = lambda c, t: F.lit(None).cast(t).alias(c)
    heads = repairs(rows).select("conv_id", F.lit(0).alias("kind"), none("turn", "long"), none("role", "string"), none("digest", "binary"), none("text", "string"), F.array(*NUMBERS).alias("numbers"), "audit")
    turns = rows.filter("NOT gone").select("conv_id", F.lit(1).alias("kind"), "turn", "role", _digest(F.col("text")).alias("digest"), "text", none("numbers", "array<long>"), none("audit", "string"))
    both = heads.union(turns).repartition("conv_id").sortWithinPartitions("conv_id", "kind", *ORDER).select("conv_id", "numbers", "audit", "role", "text")
    types = {pa.int64(): "long", pa.string(): "string"}
    return both.mapInArrow(_edited(result, schema), ", ".join(f"{f.name} {types[f.type]}" for f in schema))


def with_gone(df: DataFrame) -> DataFrame:
    """Conversations as they are, as rows of `damaged`; nulls in roles and texts are one space."""
    return df.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")), F.lit(False).alias("gone"))


def repair_digests(rows: DataFrame) -> DataFrame:
    """One row for each conversation of `rows` (conv_id, turn, role, text, gone): faults, cheapest edits, and the hash of
    what is repaired.

    Turns are in the order of turn (nulls first), role, and the MD5 of the text; rows that are equal in all of these are
    equal. Each turn's first fault counts: blank (nothing but white space), duplicate (role and text of an earlier
    turn), truncated (the last character that is not white space is none of `.!?`). Keeping costs 0, another role 3,
    deletion 4 (the only edit of blank and duplicate turns), an inserted empty turn 3, a truncated turn that stays 3
    more. audit has the initials of the edits. A null conv_id is a conversation of its own; one whose rows are all gone
    has zeros, an empty audit, and the hash of nothing. Without rows there is no result.

    A long conversation's letters and audit are held by one task, a byte a turn, as its audit is one value; its texts
    pass by one at a time. Repeated turns are counted before they are shuffled.
    """
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    schema = pa.schema([("conv_id", pa.int64()), *((n, pa.int64()) for n in names), ("audit", pa.string()), ("repaired_sha256", pa.string())])
    return _passed(rows, _digested, schema)


def repaired_turns(rows: DataFrame) -> DataFrame:
    """(conv_id, position, edit, role, text) of the repaired conversations; see repair_digests."""
    return _passed(rows, _turned, pa.schema([("conv_id", pa.int64()), ("position", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())]))


def op11_conversation_repair(spark, sf_dir: str) -> DataFrame:
    """All conversations, damaged by fixed rules and repaired."""
    return repair_digests(damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")))
