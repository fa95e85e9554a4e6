"""Importance resampling against n-grams put together as strings."""

import hashlib
import math
import random
import re
import zlib

import numpy as np

from quern.llm.resample import combined, feature_crcs, op12_importance_resampling, ranked, resample, shifted, word_crcs

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def grams(text, n=2):
    words = WORDS.findall((text or "").translate(LOWER))
    return len(words), [" ".join(words[i : i + k]) for k in range(1, n + 1) for i in range(len(words) - k + 1)]


def brute(docs, bench, share=25, least=20, seed=7, buckets=10_000, n=2):
    bucket = lambda x: zlib.crc32(x.encode()) % buckets
    s, t, known = [0] * buckets, [0] * buckets, [(i, *grams(x, n)) for i, x in docs]
    for counts, features in [(s, f) for _, _, f in known] + [(t, grams(x, n)[1]) for x in bench]:
        for x in features:
            counts[bucket(x)] += 1
    all_s, all_t = sum(s), sum(t)
    gain = [math.floor(1000 * math.log((b + 1) * (all_s + buckets) / ((a + 1) * (all_t + buckets)))) for a, b in zip(s, t, strict=True)]
    out = []
    for i, n_words, f in known:
        weight = sum(gain[bucket(x)] for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n_words])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    for k, r in enumerate(able[: share * len(able) // 100], 1):
        r[4] = k
    return sorted((tuple(r[:5]) for r in out), key=str)


def collected(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str)


def test_crc_algebra():
    rng = random.Random(5)
    parts = [(rng.randbytes(rng.randint(0, 40)), rng.randbytes(rng.choice([0, 1, 7, 8, 300, 70_001]))) for _ in range(200)]
    a, b = (np.array([zlib.crc32(p[k]) for p in parts], np.uint32) for k in (0, 1))
    lengths = np.array([len(p[1]) for p in parts])
    assert combined(a, b, lengths).tolist() == [zlib.crc32(x + y) for x, y in parts]
    assert shifted(a, np.zeros(len(a), np.int64)).tolist() == a.tolist()


def test_words_and_features():
    texts = ["", "Ab c9-d  É\x7fz", "x" * 64 + " " + "Y" * 65 + " " + "ß" * 500, "...", "one", "a b a b a", "日本 語"]
    crc, length, counts = word_crcs(texts)
    words = [w for t in texts for w in WORDS.findall(t.translate(LOWER))]
    assert crc.tolist() == [zlib.crc32(w.encode()) for w in words] and length.tolist() == [len(w.encode()) for w in words]
    assert counts.tolist() == [grams(t)[0] for t in texts]
    for n in (1, 2, 4):
        found = [[] for _ in texts]
        for c, owner in feature_crcs(texts, n)[1]:
            for x, k in zip(c.tolist(), owner.tolist(), strict=True):
                found[k].append(x)
        assert found == [[zlib.crc32(x.encode()) for x in grams(t, n)[1]] for t in texts]


def test_given_documents(spark):
    at = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{at}/documents.parquet").select("doc_id", "text").collect()]
    bench = [r.text for r in spark.read.parquet(f"{at}/benchmark.parquet").collect()]
    assert collected(op12_importance_resampling(spark, at)) == brute(docs, bench)


def test_odd_rows(spark):
    rng = random.Random(2)
    text = lambda n: " ".join(rng.choice(["a", "B", "ccc", "é", "9", "--", "w" * 70]) for _ in range(n))
    docs = [(k, text(rng.randint(0, 60))) for k in range(80)] + [(200, None), (201, ""), (None, text(40)), (None, text(50)), (202, text(30_000))]
    docs += docs[:5] * 3
    target = spark.createDataFrame([(text(30), 1), (None, 2)], "text string, bucket int")
    df = spark.createDataFrame([(i, t, 0, 0) for i, t in docs], "doc_id long, text string, score int, _place int").repartition(7)
    want = brute(docs, [r.text for r in target.collect()])
    got = collected(resample(df, target))
    assert [r[:4] for r in got] == [r[:4] for r in want] and sorted(r[4] or 0 for r in got) == sorted(r[4] or 0 for r in want)
    score = {r[4]: r[3] for r in got if r[4]}
    assert [score[k] for k in sorted(score)] == sorted(score.values(), reverse=True)
    assert collected(resample(df.limit(0), target)) == []
    assert {r[4] for r in collected(resample(df, target, least_words=10**6))} == {None}
    none = brute(docs, [])
    assert [r[:4] for r in collected(resample(df, target.limit(0)))] == [r[:4] for r in none]


def test_ranks_over_many_ranges(spark):
    """Scores with many ties, a third of all rows one key, dealt to several ranges."""
    rows = [(k, k % 13) for k in range(2000)] + [(5, 7)] * 1000
    df = spark.createDataFrame(rows, "key long, score long").repartition(8)
    got = ranked(df, "score", "key", 50).filter("rank IS NOT NULL").orderBy("rank").collect()
    assert [(r.key, r.score, r["rank"]) for r in got] == [(k, s, n) for n, (k, s) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0]))[:1500], 1)]
