"""Variable-capacity best-fit packing of documents into training sequences.

Several sequence lengths are permitted. Pieces are placed in order of falling length, each into the open sequence that
it leaves least room in; where none has room, a new one is opened. Its length is settled there and then, jointly for
all permitted lengths: for each, the pieces still to come that would fill it are looked up, and the one of least cost
for a token is opened. At the end sequences are cut down to the least permitted length that holds their contents.
Plans that open one length throughout are tried too, and the cheapest plan is taken. Rows are dealt to shards of
bounded size, which pack on their own.
"""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.tokens import library_counter, token_counts
from quern.session import written

SIZES = (512, 1024, 2048, 4096, 8192)
#: Cost of a sequence: its length, its square over the second, and so much for being one. The square stands for
#: attention and speaks for short sequences, the fixed part for long ones.
OVERHEAD, SQUARE = 64, 32_768
#: Pieces that a shard has on average. Packing loses less than a sequence of each length a shard.
SHARD = 20_000


def cost(size: int, overhead: int = OVERHEAD) -> float:
    return size + size * size / SQUARE + overhead


def fitting(length: int, sizes: tuple[int, ...]) -> int:
    """The least permitted size that holds the length."""
    return next(s for s in sizes if s >= length)


class Coming:
    """The lengths of the pieces still to come: how many of each, and a bit for each that is there."""

    def __init__(self, lengths: list[int]):
        self.count = Counter(lengths)
        self.bits = sum(1 << x for x in self.count)

    def take(self, x: int) -> None:
        self.count[x] -= 1
        if not self.count[x]:
            self.bits &= ~(1 << x)

    def filling(self, room: int) -> int:
        """How much of the room the pieces to come would fill, the longest that fit first."""
        bits, left = self.bits, room
        while fits := bits & ((2 << left) - 1):
            x = fits.bit_length() - 1
            n = min(self.count[x], left // x)
            left -= n * x
            bits &= (1 << x) - 1
        return room - left


def least_cost_size(x: int, sizes: tuple[int, ...], coming: Coming, overhead: int) -> int:
    """The size to open for a piece: that of least cost for a token, with what would fill it and cut down to that."""
    best = None
    for size in sizes:
        if size >= x:
            content = x + coming.filling(size - x)
            rate = cost(fitting(content, sizes), overhead) / content
            if best is None or rate < best[0]:
                best = rate, size
    return best[1]


def best_fit(lengths: list[int], sizes: tuple[int, ...], opened: int | None = None, overhead: int = OVERHEAD) -> tuple[list[int], list[int], list[int]]:
    """Packs lengths, which must fall. A new sequence gets the size of least cost, or `opened` (the least that fits if
    that is more).

    Returns the sequence and the offset of each piece, and the contents of each sequence.
    """
    coming = Coming(lengths) if opened is None else None
    room: dict[int, list[int]] = {}  # free places -> open sequences
    free = 0  # bit r: some sequence has r free places
    where, offset, used = [], [], []
    for x in lengths:
        if coming:
            coming.take(x)
        fits = free >> x
        if fits:
            left = x + (fits & -fits).bit_length() - 1
            stack = room[left]
            k = stack.pop()
            if not stack:
                free &= ~(1 << left)
        else:
            k = len(used)
            left = least_cost_size(x, sizes, coming, overhead) if coming else max(opened, fitting(x, sizes))
            used.append(0)
        where.append(k)
        offset.append(used[k])
        used[k] += x
        if rest := left - x:
            room.setdefault(rest, []).append(k)
            free |= 1 << rest
    return where, offset, used


def pack(lengths: list[int], sizes: tuple[int, ...] = SIZES, overhead: int = OVERHEAD) -> tuple[list[int], list[int], list[int]]:
    """The cheapest of the plan with a size chosen at each opening and those with one size throughout.

    Returns sequence and offset of each piece, and the cut-down size of each sequence.
    """
    best = None
    for opened in (None, *sizes):
        where, offset, used = best_fit(lengths, sizes, opened, overhead)
        final = [fitting(u, sizes) for u in used]
        total = sum(cost(s, overhead) for s in final)
        if best is None or total < best[0]:
            best = total, where, offset, final
    return best[1:]


def pack_sequences(counts: DataFrame, sizes: tuple[int, ...] = SIZES, overhead: int = OVERHEAD, shard_rows: int = SHARD) -> DataFrame:
    """Packs rows (doc_id, n_tokens): doc_id, piece, start, n_tokens, bin_id, bin_offset, bin_size.

    A document longer than the largest size is cut into pieces of that size and a rest; start is a piece's first token
    in its document. Documents without tokens (null counts too) are one piece without a bin. Every token is in exactly
    one bin. Rows are dealt to shards by a hash of a number that each row is given once, so a hot or repeated doc_id
    spreads like any other; within a shard pieces of equal length keep the order of that number.
    """
    sizes = tuple(sorted(sizes))
    top = sizes[-1]
    n = F.coalesce(F.col("n_tokens").cast("long"), F.lit(0).cast("long"))
    rows = written(counts.select(F.col("doc_id").cast("long").alias("doc_id"), n.alias("n"), F.monotonically_increasing_id().alias("row")), "lengths")
    pieces = F.greatest(F.ceil(F.col("n") / top), F.lit(1).cast("long"))
    cut = rows.select("doc_id", "row", "n", F.explode(F.sequence(F.lit(0).cast("long"), pieces - 1)).alias("piece"))
    cut = cut.select("doc_id", "row", "piece", (F.col("piece") * top).alias("start"), F.least(F.col("n") - F.col("piece") * top, F.lit(top)).alias("n_tokens"))
    total = rows.agg(F.sum(pieces).alias("t")).first().t or 0
    shards = max(1, -(-total // shard_rows))
    dealt = cut.withColumn("shard", F.pmod(F.xxhash64("row", "piece"), F.lit(shards)))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["n_tokens", "row", "piece"], ascending=[False, True, True], ignore_index=True)
        full = group.n_tokens > 0
        where, offset, final = pack(group.n_tokens[full].tolist(), sizes, overhead)
        base = int(group["shard"].iloc[0]) << 32 if len(group) else 0
        out = group[["doc_id", "piece", "start", "n_tokens"]].copy()
        blank = [None] * int((~full).sum())
        for name, values in (("bin_id", [base + w for w in where]), ("bin_offset", offset), ("bin_size", [final[w] for w in where])):
            out[name] = pd.array([*values, *blank], dtype="Int64")
        out["doc_id"] = group["doc_id"].astype("Int64")
        return out

    return dealt.groupBy("shard").applyInPandas(run, "doc_id long, piece long, start long, n_tokens long, bin_id long, bin_offset long, bin_size long")


def pack_documents(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Counts the tokens of all whole texts and packs them; see pack_sequences."""
    counted = token_counts(df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), tokenizer, counter=library_counter)
    return pack_sequences(counted.select("doc_id", "n_tokens"), **options)


def op9_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """Places of all tokens of every whole document in sequences."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))
