import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quern.llm import planes
from quern.llm.pretok import WordCache
from quern.llm.tokens import codec, count_texts, counter, encode_decode, encode_texts, library, token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
PARTS = [*"ab 's  \n\t'dmtlverLL1½२é中́  \u0085\x1c!#…😀", "<|endoftext|>", "'ll", "'ve ", " 're", "  ", "\r\n", "\U0001e030", "֋"]


def by_library(texts):
    return [e.ids for e in LIBRARY.encode_batch(texts, add_special_tokens=False)]


def hard_texts():
    rng = random.Random(3)
    out = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    letters = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(20_000))
    return [*out, "", "a" * 5000, "é" * 999, letters, "' " * 100, " " * 5000, "\n" * 333, "<|endoftext|>" * 3]


def test_all_encoders_agree_with_the_library():
    texts = hard_texts()
    want = by_library(texts)
    split, cache, decoder = codec(PATH)
    got = [np.frombuffer(r, "<u4").tolist() for r in encode_texts(texts, split, cache)]
    assert got == want
    assert [decoder.text(np.array(g, np.uint32)) for g in got] == texts
    assert [np.frombuffer(r, "<u4").tolist() for r in encode_texts(texts, *library(PATH))] == want
    assert count_texts(texts, PATH) == [len(w) for w in want]


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=80))
def test_any_text(text):
    split, cache, decoder = codec(PATH)
    got = np.frombuffer(next(encode_texts([text], split, cache)), "<u4")
    assert got.tolist() == by_library([text])[0] and decoder.text(got) == text
    assert count_texts([text], PATH) == [len(got)]


def test_broken_bytes_decode_as_the_library_does():
    decoder = codec(PATH)[2]
    for ids in ([447], [447, 50256, 220], [94, 95, 96], []):
        assert decoder.text(np.array(ids, np.uint32)) == LIBRARY.decode(ids, skip_special_tokens=False)


def test_cache_is_bounded_and_right():
    cache = WordCache(lambda words: [len(w) for w in words], limit=10)
    for k in range(100):
        words = [f"w{j}" for j in range(k, k + 4)] * 2
        assert cache(words) == [len(w) for w in words]
        assert len(cache.new) <= 14 and len(cache.old) <= 14


def test_queries_on_odd_rows(spark):
    rows = [(1, None, "x"), (2, "", "y"), (3, "a b", None), (3, "a b", None), (None, "c", "z"), (5, "word " * 30_000, "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_tokens) for r in token_counts(df, PATH).collect())
    want = sorted((i or 0, len((t or "").encode()), len(LIBRARY.encode(t or "", add_special_tokens=False).ids)) for i, t, _ in rows)
    assert got == want
    empty = df.filter("doc_id = 99")
    assert token_counts(empty, PATH).count() == 0 and encode_decode(empty, PATH).count() == 0
    digests = {r.doc_id: r for r in encode_decode(df, PATH).collect()}
    assert digests[1].ids_sha256 == hashlib.sha256(b"").hexdigest() and digests[1].n_tokens == 0
    assert digests[5].decoded_sha256 == hashlib.sha256(("word " * 30_000).encode()).hexdigest()


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_planes_round_trip(tmp_path, kind):
    rng = np.random.default_rng(0)
    docs = [(k if k % 7 else None, rng.integers(0, 2**32 if k % 3 == 0 else 50_257, int(n)).astype("<u4")) for k, n in enumerate(rng.integers(0, 3000, 60))]
    docs.append((9, np.arange(70_000, dtype="<u4")))
    planes.save(str(tmp_path / "x"), docs, planes=kind, block=1000)
    reader = planes.load(str(tmp_path / "x"))
    assert [(d, ids.tolist()) for d, _, ids in reader] == [(d, ids.tolist()) for d, ids in docs]
    assert all((reader.doc(k) == docs[k][1]).all() for k in range(len(docs)))
    planes.save(str(tmp_path / "y"), [])
    assert list(planes.load(str(tmp_path / "y"))) == []


def test_plane_files_in_order(spark):
    rows = [(k, f"text number {k} " * (k % 50)) for k in range(500)] + [(7, "twice"), (7, "twice"), (None, "no id"), (3, None)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = planes.read_segments(planes.write_segments(df, PATH)).collect()
    got.sort(key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i or 0))
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    whole = {(r.doc_id, r.n_tokens, r.ids_crc32) for r in got}
    assert whole == {(i, len(ids) + 1, zlib.crc32(np.array([*ids, 0], "<u4").tobytes())) for (i, _), ids in zip(rows, by_library([t or "" for _, t in rows]), strict=True)}
    assert planes.read_segments(planes.write_segments(df.filter("doc_id = -1"), PATH)).count() == 0


def test_counter_is_kept():
    assert counter(PATH) is counter(PATH)


@given(st.lists(st.text(alphabet=st.sampled_from(list("ab 1'st.\n\té世😀")), max_size=60), max_size=8))
@settings(max_examples=60, deadline=None)
def test_each_distinct_word_is_looked_up_once(texts):
    split, _ = counter(PATH)
    words, counts = split.words(texts)
    distinct, places, same = split.distinct_words(texts)
    assert [distinct[k] for k in places] == words and len(set(distinct)) == len(distinct) and same.tolist() == counts.tolist()
    asked = []

    def lengths(some):
        asked.extend(some)
        return [len(w) for w in some]

    cache = WordCache(lengths, limit=5)
    assert cache(distinct) == list(map(len, distinct)) and sorted(asked) == sorted(distinct)


def test_packing_counts_as_the_library_does():
    from quern.llm.tokens import library_counter

    texts = ["", "Hello there, it's 2024!", "étionan ñasasll  \n\n x", "<|endoftext|> a <|endoftext|>", "aaaa" * 50]
    assert count_texts(texts, PATH, library_counter) == count_texts(texts, PATH)
