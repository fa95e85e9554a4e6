"""Exact BPE encoding by backtracking over longest token matches, and decoding by an offset table.

At each position an Aho-Corasick automaton gives the longest token. A token may follow another only if merging their
joined bytes gives back the same two tokens; that test is kept in a pair-compatibility table, filled as pairs are met.
Where no token fits, the encoder steps back over the last one and marks the position, so each position is left at
most once and the time is linear in the text.
"""

from __future__ import annotations

from array import array

import numpy as np

from quern.llm.pretok import byte_alphabet, load_spec

#: Pairs whose compatibility is remembered; the table is emptied when it is full.
PAIRS = 400_000


class Vocabulary:
    """Token bytes, merges and splits. Token order must be merge order, as in rank-based vocabularies."""

    def __init__(self, path: str):
        spec = load_spec(path)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        back = {c: b for b, c in byte_alphabet().items()}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = 1 + max([*vocab.values(), *self.added.values()])
        self.bytes: list[bytes] = [b""] * self.size
        for token, i in vocab.items():
            self.bytes[i] = bytes(back[c] for c in token)
        for token, i in self.added.items():
            self.bytes[i] = token.encode()
        self.merge: dict[tuple[int, int], int] = {}
        self.rank: dict[int, int] = {}
        self.split: dict[int, tuple[int, int]] = {}
        for k, m in enumerate(merges):
            left, right = m if not isinstance(m, str) else m.split(" ")
            pair, made = (vocab[left], vocab[right]), vocab[left + right]
            if made in self.rank:
                raise ValueError("two merges make the same token")
            self.merge[pair], self.rank[made], self.split[made] = made, k, pair
        self.single = {b[0]: i for i, b in enumerate(self.bytes) if len(b) == 1 and i not in self.added.values()}


class BacktrackEncoder:
    """Bytes of a pre-token -> token ids."""

    def __init__(self, vocab: Vocabulary):
        import ahocorasick

        self.v = vocab
        special = set(vocab.added.values())
        self.ids = {b: i for i, b in enumerate(vocab.bytes) if b and i not in special}
        self.automaton = ahocorasick.Automaton()
        for b, i in self.ids.items():
            self.automaton.add_word(b.decode("latin-1"), i)
        self.automaton.make_automaton()
        self.length = [len(b) for b in vocab.bytes]
        #: The next shorter token that begins a token; -1: none.
        self.shorter = [-1] * vocab.size
        for b, i in self.ids.items():
            self.shorter[i] = next((self.ids[b[:k]] for k in range(len(b) - 1, 0, -1) if b[:k] in self.ids), -1)
        #: A single byte has no merge: its rank stands before all merges, by its byte's place.
        self.order = [-1] * vocab.size
        for i, k in vocab.rank.items():
            self.order[i] = k
        self.direct = {b.decode("latin-1"): i for b, i in self.ids.items()}
        self.pairs: dict[tuple[int, int], bool] = {}

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging the bytes of a and b leaves exactly a and b; goes into the table."""
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        known = self.pairs[a, b] = self._compatible(a, b)
        return known

    def _compatible(self, a: int, b: int) -> bool:
        """Unmerge a and b from the latest merge back. A pair across the border that merges before its sides are
        complete breaks them. Of equal ranks the left one is merged first."""
        merge, split, order, rank = self.v.merge, self.v.split, self.order, self.v.rank
        limit = 1 << 60  # ranks of merges across the border that would come in time, exclusive
        while True:
            made = merge.get((a, b))
            if made is not None and rank[made] < limit:
                return False
            ra, rb = order[a], order[b]
            if ra < 0 and rb < 0:
                return True
            if ra > rb:  # a was made last: before that its right part stood at the border
                limit, a = ra, split[a][1]
            else:  # b was made last, or both by equal merges; a merge of the same rank further left comes first
                limit, b = rb + 1, split[b][0]

    def encode(self, data: str) -> list[int]:
        """`data` holds a byte in each character. The path of longest matches is tried first; most words end there."""
        if (known := self.direct.get(data)) is not None:
            return [known]
        out = [i for _, i in self.automaton.iter_long(data)]
        pairs, last = self.pairs, out[0] if out else -1
        for token in out[1:]:
            if not (pairs[last, token] if (last, token) in pairs else self.compatible(last, token)):
                return self._backtrack(data)
            last = token
        if sum(map(self.length.__getitem__, out)) != len(data):
            raise ValueError("a byte is not in the vocabulary")
        return out

    def _backtrack(self, data: str) -> list[int]:
        n, length, shorter, pairs = len(data), self.length, self.shorter, self.pairs
        longest = [-1] * (n + 1)
        for end, i in self.automaton.iter(data):
            longest[end + 1 - length[i]] = i  # matches come by their end, so a later one is longer
        allowed = bytearray(b"\x01") * (n + 1)
        out: list[int] = []
        at, token, last = 0, longest[0], -1
        while at < n:
            while token >= 0:
                end = at + length[token]
                if allowed[end] and (last < 0 or (pairs[last, token] if (last, token) in pairs else self.compatible(last, token))):
                    break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at, last, token = end, token, longest[end]
            elif out:
                allowed[at] = 0
                token = out.pop()
                at -= length[token]
                token, last = shorter[token], out[-1] if out else -1
            else:
                raise ValueError("a byte is not in the vocabulary")
        return out

    def words(self, words: list[str]) -> list[bytes]:
        return [array("I", self.encode(w.encode().decode("latin-1"))).tobytes() for w in words]


class OffsetDecoder:
    """Ids -> bytes through one blob of all tokens' bytes and the offset of each token in it."""

    def __init__(self, vocab: Vocabulary):
        self.blob = np.frombuffer(b"".join(vocab.bytes), np.uint8)
        self.offset = np.concatenate([[0], np.cumsum([len(b) for b in vocab.bytes])]).astype(np.int64)

    def decode(self, ids: np.ndarray) -> bytes:
        if not len(ids):
            return b""
        begin = self.offset[ids]
        size = self.offset[ids.astype(np.int64) + 1] - begin
        ends = np.cumsum(size)
        return self.blob[np.arange(ends[-1]) + np.repeat(begin - (ends - size), size)].tobytes()

    def text(self, ids: np.ndarray) -> str:
        """Decoded text; bytes that are not UTF-8 become U+FFFD."""
        return self.decode(ids).decode("utf-8", errors="replace")
