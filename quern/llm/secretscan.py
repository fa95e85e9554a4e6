"""Secret scans with one automaton for all rules.

All rules' regexes, reversed, are compiled into a single minimal automaton. One pass over a text's bytes from its end
marks every place where a match of each rule begins. From the leftmost place a small automaton of the rule runs to the
longest end; the next match begins there or later. So spans are leftmost, longest and do not overlap within a rule.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.automaton import Dfa, parse, reverse
from quern.llm.pretok import lean, slices


class Rule(NamedTuple):
    kind: str
    regex: str
    least: int = 0  # length of the match
    value: int = 0  # length of the last group
    more: str = ""  # what may follow and belongs to the match; it does not change where matches begin


def either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_KEYWORDS = "|".join([*map(either_case, ("password", "passwd", "secret", "token")), f"{either_case('api')}_?{either_case('key')}"])

#: What follows the first line of a PEM key. Up to the END line all is key, whatever the layout; without one the header
#: fields and the runs of base64 at line ends (raw or escaped), and long runs after spaces with a short last one, are.
_EOL = r"[\x20\t\"',+]*(\r?\n|\r|\\+r\\+n|\\+n|\\+r)[\x20\t>\"'+]*"
_KEY = r"[A-Za-z0-9+/=]"
_PEM = (
    r"(-?[\t-\r\x20-,.-~\x80-\xf4])*-----END [A-Z ]*PRIVATE KEY-----"
    rf"|({_EOL}([A-Za-z0-9]+(-[A-Za-z0-9]+)*:[\x20-\x5b\x5d-~]*)?)*{_KEY}*({_EOL}{_KEY}*|[\x20\t]+{_KEY}{{16,}}([\x20\t]+{_KEY}+)?)*"
)

BASE = (
    Rule("assign", f"({_KEYWORDS})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", value=6),
    Rule("access", "AKIA[A-Z0-9]+", least=20),
    # The same spans as [0-9a-f]+ of 24 or more: a run is one match. The count keeps short runs out of the marks.
    Rule("hex", "[0-9a-f]{24,}"),
)
ADDED = (
    Rule("code_host", "gh[pousr]_[A-Za-z0-9]+", least=40),
    Rule("chat", "xox[abprs]-[A-Za-z0-9-]+", least=20),
    Rule("payment", "[sr]k_live_[A-Za-z0-9]+", least=24),
    Rule("web_token", "eyJ[A-Za-z0-9_-]+\\.[A-Za-z0-9_-]+\\.[A-Za-z0-9_-]+", least=36),
    Rule("private_key", "-----BEGIN [A-Z ]*PRIVATE KEY-----", more=_PEM),
)
RULES = BASE + ADDED
#: Stands between texts; no UTF-8 text has it, and no rule may match it.
GAP = 0xFF


class Scanner:
    def __init__(self, rules: tuple[Rule, ...] = RULES):
        trees = [parse(r.regex) for r in rules]
        self.rules, self.whole = rules, Dfa([reverse(t) for t in trees], search=True)
        self.each, self.groups = [], []
        for r, tree in zip(rules, trees, strict=True):
            d = Dfa([parse(f"{r.regex}(?:{r.more})?") if r.more else tree], search=False)
            dead = [s for s in range(len(d.step)) if (d.step[s] == s).all() and not d.accepts[s]]
            self.each.append((d.column.tolist(), d.step.tolist(), d.accepts.tolist(), dead[0] if dead else -1))
            self.groups.append(re.compile(r.regex.encode("latin-1")) if r.value else None)

    def _end(self, rule: int, data: bytes, at: int) -> int:
        column, step, accepts, dead = self.each[rule]
        state, end = 0, -1
        for i in range(at, len(data)):
            state = step[state][column[data[i]]]
            if accepts[state]:
                end = i + 1
            elif state == dead:
                break
        return end

    def scan(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        """(start, rule, end) of each text's spans in code points, by start, then rule."""
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        raw = [t.encode() for t in texts]
        sizes = np.fromiter((len(b) + 1 for b in raw), np.int64, len(raw))
        if not sizes.sum():
            return out
        joined = np.frombuffer(bytes([GAP]).join([*raw, b""]), np.uint8)
        marks = self.whole.accepts[self.whole.trace(self.whole.column[joined[::-1]])][::-1]
        places = np.flatnonzero(marks)
        begin = np.cumsum(sizes) - sizes
        owner = np.searchsorted(begin, places, side="right") - 1
        marks = marks[places]
        for d in np.unique(owner).tolist():
            own = owner == d
            out[d] = self._spans(raw[d], (places[own] - begin[d]).tolist(), marks[own].tolist())
        return out

    def _spans(self, data: bytes, places: list[int], marks: list[int]) -> list[tuple[int, int, int]]:
        found = []
        for k, rule in enumerate(self.rules):
            free = 0
            for at, bits in zip(places, marks, strict=True):
                if at < free or not bits >> k & 1:
                    continue
                free = self._end(k, data, at)
                if free - at < rule.least:
                    continue
                if self.groups[k]:
                    m = self.groups[k].fullmatch(data, at, free)
                    if m is None or len(m[m.re.groups]) < rule.value:
                        continue
                found.append((at, k, free))
        found.sort()
        if len(data) and found and not data.isascii():
            point = np.concatenate([[0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)])
            found = [(int(point[a]), k, int(point[b])) for a, k, b in found]
        return found


@lru_cache(maxsize=4)
def scanner(rules: tuple[Rule, ...]) -> Scanner:
    return Scanner(rules)


def listed(spans: list[tuple[int, int, int]], rules: tuple[Rule, ...]) -> str:
    return ",".join(f"{rules[k].kind}:{a}:{b}" for a, k, b in spans)


def redacted(text: str, spans: list[tuple[int, int, int]], rules: tuple[Rule, ...] = RULES) -> str:
    """The text with each span, or run of spans that overlap, replaced by the kind of its first."""
    parts, at, merged = [], 0, []
    for a, k, b in spans:
        if merged and a < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], b)
        else:
            merged.append([a, k, b])
    for a, k, b in merged:
        parts += [text[at:a], f"[{rules[k].kind}]"]
        at = b
    return "".join([*parts, text[at:]])


def _worker(job, texts: list[str]) -> Iterator:
    for part in slices(texts, 4_000_000):
        yield from zip(part, job.scan(part), strict=True)


def scan_secrets(df: DataFrame, rules: tuple[Rule, ...] = RULES, base: tuple[str, ...] = tuple(r.kind for r in BASE), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of `df`: doc_id, a count n_<kind> for each base kind, base_sha256 and spans.

    spans lists kind:start:end by start, then in the order of the rules, with commas, in code points, end exclusive;
    base_sha256 is the digest of the same list of base kinds. Null and empty texts have no spans. No shuffle.
    The automata are compiled on the driver and sent with the task.
    """
    job, kinds = scanner(rules), [r.kind for r in rules]
    rank = [kinds.index(k) for k in base]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column("text").to_pylist()]
            counts, digests, spans = [[] for _ in rank], [], []
            for _, found in _worker(job, texts):
                for n, k in zip(counts, rank, strict=True):
                    n.append(sum(x[1] == k for x in found))
                digests.append(hashlib.sha256(listed([x for x in found if x[1] in rank], rules).encode()).hexdigest())
                spans.append(listed(found, rules))
            made = [*(pa.array(n, pa.int64()) for n in counts), pa.array(digests, pa.string()), pa.array(spans, pa.string())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *made], names=["doc_id", *(f"n_{k}" for k in base), "base_sha256", "spans"])

    schema = ", ".join(["doc_id long", *(f"n_{k} long" for k in base), "base_sha256 string", "spans string"])
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(lean(run), schema)


def redact_secrets(df: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """`df` with every span in the text replaced by its kind in brackets; a column of lengths, if there, is set anew.

    Null texts stay null; all other columns and all rows stay.
    """
    job, schema = scanner(rules), df.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(text_col).to_pylist()
            clean = [redacted(t, s, rules) for t, s in _worker(job, [t or "" for t in texts])]
            made = {text_col: pa.array([None if t is None else c for t, c in zip(texts, clean, strict=True)], pa.string())}
            if length_col in b.schema.names:
                made[length_col] = pa.array([None if t is None else len(c) for t, c in zip(texts, clean, strict=True)], pa.int64()).cast(b.column(length_col).type)
            yield pa.RecordBatch.from_arrays([made.get(n, b.column(n)) for n in b.schema.names], names=b.schema.names)

    return df.mapInArrow(lean(run), schema)


def op10_secret_scan(spark, sf_dir: str) -> DataFrame:
    """Secrets in every whole document."""
    return scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
