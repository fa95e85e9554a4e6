"""Byte-level pre-tokens of many texts at once, and a bounded cache of what each pre-token encodes to.

The splitter finds the piece boundaries of the byte-level pre-tokenizer with numpy over code points. The class of
each code point (letter, number, white space, other) is asked of the tokenizers library the first time it is seen,
so the two agree on every Unicode version.
"""

from __future__ import annotations

import ctypes
import json
import sys
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache, wraps

import numpy as np
import pyarrow as pa

LETTER, NUMBER, SPACE, OTHER, UNKNOWN = 0, 1, 2, 3, 255

#: Texts are worked on in slices of about so many characters, which bounds memory.
SLICE_CHARS = 1_000_000


def load_spec(path: str) -> dict:
    """The tokenizer's JSON; refuses files whose splitting this module does not cover."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
    plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
    flags = ("single_word", "lstrip", "rstrip", "normalized")
    if model["type"] != "BPE" or not plain or spec.get("normalizer") or any(t[k] for t in spec["added_tokens"] for k in flags):
        raise ValueError(f"not a plain byte-level BPE tokenizer: {path}")
    if model.get("dropout") or model.get("ignore_merges") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix"):
        raise ValueError(f"unsupported BPE options: {path}")
    return spec


def byte_alphabet() -> dict[int, str]:
    """Byte -> the printable character that stands for it in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in shown}
    for k, b in enumerate(b for b in range(256) if b not in out):
        out[b] = chr(256 + k)
    return out


class Splitter:
    """Splits texts as the byte-level pre-tokenizer does, added tokens first."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.added = {t["content"]: t["id"] for t in load_spec(path)["added_tokens"]}
        self.table = np.full(0x110000, UNKNOWN, np.uint8)
        self._learn(range(0x250))

    def _learn(self, points) -> None:
        pieces = self.library.pre_tokenizer.pre_tokenize_str
        for c in points:
            ch = chr(c)
            for kind, lead in ((LETTER, "a"), (NUMBER, "1"), (OTHER, "!")):
                if len(pieces(lead + ch)) == 1:
                    self.table[c] = kind
                    break
            else:
                self.table[c] = SPACE

    def _cut(self, text: str) -> list[str]:
        """The text cut at added tokens, which stay as parts of their own; leftmost, then longest."""
        if not any(a in text for a in self.added):
            return [text]
        out, at, by_length = [], 0, sorted(self.added, key=len, reverse=True)
        while True:
            hits = [(i, -len(a), a) for a in by_length if (i := text.find(a, at)) >= 0]
            if not hits:
                return [*out, text[at:]]
            i, _, a = min(hits)
            out += [text[at:i], a]
            at = i + len(a)

    def words(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """All pre-tokens of all texts in order, and how many each text has."""
        whole, starts, counts = self._pieces(texts)
        at = starts.tolist()
        return [whole[a:b] for a, b in zip(at, [*at[1:], len(whole)], strict=False)], counts

    def distinct_words(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The distinct pre-tokens of all texts, for each pre-token in order its place among them, and how many pre-tokens
        each text has."""
        whole, starts, counts = self._pieces(texts)
        if not len(starts):
            return [], np.empty(0, np.int64), counts
        data = whole.encode()
        if len(data) > len(whole):  # places of characters -> places of bytes
            heads = np.flatnonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)
            starts = heads[starts]
        ends = np.append(starts, len(data)).astype(np.int64)
        coded = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(ends), pa.py_buffer(data)).dictionary_encode()
        return coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy(), counts

    def _pieces(self, texts: list[str]) -> tuple[str, np.ndarray, np.ndarray]:
        """All texts together, where their pre-tokens begin, and how many each text has."""
        parts = [(k, p) for k, t in enumerate(texts) for p in self._cut(t) if p]
        counts = np.zeros(len(texts), np.int64)
        if not parts:
            return "", np.empty(0, np.int64), counts
        whole = "".join(p for _, p in parts)
        sizes = np.fromiter((len(p) for _, p in parts), np.int64, len(parts))
        begins = np.cumsum(sizes) - sizes
        starts = self._starts(whole, begins, np.fromiter((p in self.added for _, p in parts), bool, len(parts)), sizes)
        owner = np.fromiter((k for k, _ in parts), np.int64, len(parts))
        per_part = np.add.reduceat(starts, begins, dtype=np.int64)
        np.add.at(counts, owner, per_part)
        return whole, np.flatnonzero(starts), counts

    def _starts(self, whole: str, begins: np.ndarray, is_added: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        points = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        n, kind = len(points), self.table[points]
        if (kind == UNKNOWN).any():
            self._learn(np.unique(points[kind == UNKNOWN]).tolist())
            kind = self.table[points]
        edge = np.zeros(n + 3, bool)
        edge[begins] = True
        edge[n:] = True
        starts = np.ones(n, bool)
        np.not_equal(kind[1:], kind[:-1], out=starts[1:])
        starts |= edge[:n]
        space = kind == SPACE
        # The last white space before something else is a piece of its own, or leads the next piece if it is U+0020.
        after = np.flatnonzero(space[:-1] & ~space[1:] & ~edge[1:n]) + 1
        starts[after - 1] = True
        starts[after[points[after - 1] == 32]] = False
        # An apostrophe that begins a piece takes s, d, m, t, ll, ve or re with it.
        quote = np.flatnonzero((points == 39) & starts)
        quote = quote[~edge[quote + 1]]
        if len(quote):
            padded = np.concatenate([points, np.zeros(3, np.uint32)])
            one, two = padded[quote + 1], np.where(edge[quote + 2], 0, padded[quote + 2])
            letter = lambda a, *chars: np.isin(a, [ord(c) for c in chars])
            single = letter(one, "s", "d", "m", "t")
            double = (letter(one, "l") & letter(two, "l")) | (letter(one, "v", "r") & letter(two, "e"))
            starts[quote[single | double] + 1] = False
            ends = np.concatenate([quote[single] + 2, quote[double] + 3])
            starts[ends[ends < n]] = True
        for k in np.flatnonzero(is_added):  # an added token is one piece
            starts[begins[k] + 1 : begins[k] + sizes[k]] = False
        return starts


class WordCache:
    """Remembers what `encode` gave for each pre-token. Holds at most two generations of `limit` entries."""

    def __init__(self, encode: Callable[[list[str]], list], preset: dict | None = None, limit: int = 250_000, longest: int = 64):
        self.encode, self.limit, self.longest = encode, limit, longest
        self.preset = dict(preset or {})
        self.new: dict = dict(self.preset)
        self.old: dict = {}

    def __call__(self, words: list[str]) -> list:
        got = list(map(self.new.get, words))
        if None not in got:
            return got
        places = [k for k, g in enumerate(got) if g is None]
        missing = [words[k] for k in places]
        fresh = dict(zip(missing, map(self.old.get, missing), strict=True))
        if rest := [w for w, g in fresh.items() if g is None]:
            fresh.update(zip(rest, self.encode(rest), strict=True))
        for k, w in zip(places, missing, strict=True):
            got[k] = fresh[w]
        if len(self.new) + len(fresh) > self.limit:
            self.old, self.new = self.new, dict(self.preset)
        if max(map(len, fresh)) > self.longest:
            fresh = {w: v for w, v in fresh.items() if len(w) <= self.longest}
        self.new.update(fresh)
        return got


#: Rows of a batch that are worked on at once.
ROWS = 500


@lru_cache(maxsize=1)
def _libc() -> ctypes.CDLL | None:
    return ctypes.CDLL("libc.so.6") if sys.platform == "linux" else None


def lean(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A mapInArrow function that sees batches of few rows and hands free memory back to the system when its task ends.

    Workers live on between tasks; what they keep would be missing to the next stage.
    """

    @wraps(work)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS))
        finally:
            pa.default_memory_pool().release_unused()
            if hasattr(_libc(), "malloc_trim"):
                _libc().malloc_trim(0)

    return run


def slices(texts: list[str], chars: int = SLICE_CHARS) -> Iterator[list[str]]:
    """Runs of texts of about `chars` characters together; a longer text is a run of its own."""
    part, size = [], 0
    for t in texts:
        if part and size + len(t) > chars:
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t)
    if part:
        yield part


def library_words(splitter: Splitter) -> Callable[[list[str]], list[bytes]]:
    """Encodes pre-tokens with the tokenizers library's model: ids as little-endian unsigned 32-bit integers."""
    model = splitter.library.model
    shown = {b: c for b, c in byte_alphabet().items()}

    def encode(words: list[str]) -> list[bytes]:
        mapped = (w.encode().decode("latin-1").translate(shown) for w in words)
        return [array("I", [t.id for t in model.tokenize(w)]).tobytes() for w in mapped]

    return encode
