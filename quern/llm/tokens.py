"""Token counts (rank-synchronous merging) and exact encoding and decoding (backtracking) of a text column."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.backtrack import BacktrackEncoder, OffsetDecoder, Vocabulary
from quern.llm.pretok import Splitter, WordCache, lean, library_words, slices
from quern.llm.ranksync import RankSync


@lru_cache(maxsize=2)
def counter(path: str) -> tuple[Splitter, WordCache]:
    """Per Python worker: splitter and cached counts of pre-tokens."""
    s = Splitter(path)
    return s, WordCache(RankSync(Vocabulary(path)).counts, dict.fromkeys(s.added, 1))


@lru_cache(maxsize=2)
def codec(path: str) -> tuple[Splitter, WordCache, OffsetDecoder]:
    """Per Python worker: splitter, cached ids of pre-tokens by backtracking, decoder."""
    s, v = Splitter(path), Vocabulary(path)
    return s, WordCache(BacktrackEncoder(v).words, special_bytes(s)), OffsetDecoder(v)


@lru_cache(maxsize=2)
def library(path: str) -> tuple[Splitter, WordCache]:
    """Per Python worker: splitter and cached ids of pre-tokens by the tokenizers library."""
    s = Splitter(path)
    return s, WordCache(library_words(s), special_bytes(s))


def special_bytes(s: Splitter) -> dict[str, bytes]:
    return {t: np.array([i], "<u4").tobytes() for t, i in s.added.items()}


@lru_cache(maxsize=2)
def library_counter(path: str) -> tuple[Splitter, WordCache]:
    """Per Python worker: splitter and cached counts of pre-tokens by the tokenizers library."""
    s = Splitter(path)
    words = library_words(s)
    return s, WordCache(lambda some: [len(raw) // 4 for raw in words(some)], dict.fromkeys(s.added, 1))


def count_texts(texts: list[str], path: str, counter: Callable[[str], tuple[Splitter, WordCache]] = counter) -> list[int]:
    split, cache = counter(path)
    out: list[int] = []
    for part in slices(texts):
        words, places, sizes = split.distinct_words(part)
        each = np.concatenate([[0], np.cumsum(np.array(cache(words), np.int64)[places])])
        ends = np.cumsum(sizes)
        out += (each[ends] - each[ends - sizes]).tolist()
    return out


def encode_texts(texts: list[str], split: Splitter, cache: WordCache) -> Iterator[bytes]:
    """Ids of each text as little-endian unsigned 32-bit integers."""
    for part in slices(texts):
        words, places, sizes = split.distinct_words(part)
        got = cache(words)
        lengths = np.fromiter(map(len, got), np.int64, len(got)) // 4
        flat, begins, each = np.frombuffer(b"".join(got), "<u4"), np.cumsum(lengths) - lengths, lengths[places]
        upto = np.concatenate([[0], np.cumsum(each)])
        ids = flat[np.arange(upto[-1]) + np.repeat(begins[places] - upto[:-1], each)]
        ends = np.cumsum(sizes)
        for a, b in zip(upto[ends - sizes].tolist(), upto[ends].tolist(), strict=True):
            yield ids[a:b].tobytes()


def _appended(df: DataFrame, text_col: str, fields: list[T.StructField], work) -> DataFrame:
    """`df` with `fields` that `work` computes for the texts of a batch (null: empty), all other columns as they are.

    `df` may have columns of these names; they are replaced.
    """
    kept = [f for f in df.schema.fields if f.name not in {x.name for x in fields}]
    schema = T.StructType([*kept, *fields])
    types = [pa.int64() if isinstance(f.dataType, T.LongType) else pa.string() for f in fields]
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column(text_col).to_pylist()]
            made = [pa.array(x, t) for x, t in zip(work(texts), types, strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), *made], names=[f.name for f in schema.fields])

    return df.select(*{*names, text_col}).mapInArrow(lean(run), schema)


def token_counts(df: DataFrame, path: str, text_col: str = "text", out_col: str = "n_tokens", bytes_col: str = "n_bytes", counter: Callable[[str], tuple[Splitter, WordCache]] = counter) -> DataFrame:
    """`df` with the token count and UTF-8 length of each text; `counter` gives splitter and counts of pre-tokens.

    Null and empty texts have 0 of both. No shuffle: rows stay where they are. Special strings of the tokenizer count
    as one token. Repeated rows each get their count.
    """
    fields = [T.StructField(bytes_col, T.LongType()), T.StructField(out_col, T.LongType())]

    def work(texts: list[str]):
        return [len(t.encode()) for t in texts], count_texts(texts, path, counter)

    return _appended(df, text_col, fields, work)


def encode_decode(df: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """`df` with n_tokens, ids_sha256 and decoded_sha256 of each text.

    ids_sha256 is over the ids as little-endian unsigned 32-bit integers, decoded_sha256 over the UTF-8 bytes of the
    text decoded from them. Null and empty texts have no ids and decode to the empty text.
    """
    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]

    def work(texts: list[str]):
        split, cache, decoder = codec(path)
        n, ids_hash, text_hash = [], [], []
        for raw in encode_texts(texts, split, cache):
            n.append(len(raw) // 4)
            ids_hash.append(hashlib.sha256(raw).hexdigest())
            text_hash.append(hashlib.sha256(decoder.text(np.frombuffer(raw, "<u4")).encode()).hexdigest())
        return n, ids_hash, text_hash

    return _appended(df, text_col, fields, work)


def op5_token_counts(spark, sf_dir: str) -> DataFrame:
    """Token counts of every whole document."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    counted = token_counts(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))


def op8_bpe_codec(spark, sf_dir: str) -> DataFrame:
    """Ids of every whole document and the text decoded from them, as digests."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode_decode(docs, public_tokenizers.path("byte_bpe_50k.json")).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
