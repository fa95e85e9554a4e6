import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quern.llm import linededup as L
from quern.llm.components import components
from quern.llm.neardup import drop_near_duplicates, near_duplicates


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(330)] + [(k, k + 1) for k in range(1000, 1040)] + [(2000, k) for k in range(1500, 1700)] + [(5, 5), (6, 7), (7, 6), (6, 7)]
    got = dict(components(spark.createDataFrame(links, "a long, b long").repartition(4)).collect())
    want = roots({x for p in links for x in p}, links)
    assert got == {n: c for n, c in want.items() if n in got} and all(want[n] == n for n in want if n not in got)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
    assert components(spark.createDataFrame([(None, 1), (2, None)], "a long, b long")).count() == 0


def shingles(text):
    words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)}


def brute(rows, percent=85):
    sets = {i: shingles(t) for i, t in rows}
    ids, links = sorted(sets), []
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                links.append((a, b))
    return {i: (len(sets[i]), c) for i, c in roots(ids, links).items()}


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
    return words


def corpus():
    rng = random.Random(4)
    rows, k = [], 0
    for _ in range(12):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(60, 250))]
        for _ in range(12):
            rows.append((k, " ".join(edited(rng, base, rng.randint(0, 5)))))
            k += 1
    rows += [(900 + j, t) for j, t in enumerate(["", None, " \n", "one", "ONE", "one two three four", "one  two\tthree four", "a b c d e", "a b c d e f"])]
    return rows


def test_near_duplicates_against_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(df).collect()}
    want = brute(rows)
    assert got == want
    kept = {r.doc_id for r in drop_near_duplicates(df.withColumns({"kept": F.lit("x"), "_gone": F.lit(1)})).collect()}
    assert kept == {i for i, (_, c) in want.items() if i == c}


def test_pipeline_links_near_duplicates_from_80_percent(spark):
    import corpus_pipeline

    rng = random.Random(7)
    rows, n = [], 0
    for k in range(0, 120, 2):
        base = [f"w{rng.randrange(5000)}" for _ in range(120)]
        rows += [(k, " ".join(base)), (k + 1, " ".join(edited(rng, base, rng.randint(2, 3))))]
        s, t = shingles(rows[-2][1]), shingles(rows[-1][1])
        n += 80 * len(s | t) <= 100 * len(s & t) < 85 * len(s | t)
    assert n > 5
    want = brute(rows, 80)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(df, 80).collect()} == want
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, df, "").collect()}
    assert kept == {i for i, (_, c) in want.items() if i == c}


def test_near_duplicates_on_odd_rows(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "A B C d e f"), (2, "other words stand in here now")]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    found = sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in got.collect())
    assert found == [(0, 0, True), (1, 1, True), (1, 1, True), (2, 1, False), (2, 2, True)]
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    with pytest.raises(ValueError):
        near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 50)


def brute_lines(rows, percent=80):
    first = {}
    for i, t in sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, L.text_id(r[1]))):
        for k, x in L.lines_of(t):
            first.setdefault(x, ((i is not None, i or 0), L.text_id(t), k))
    sets, links = {x: L._shingles(x) for x in first}, []
    often, inverted = Counter(s for own in sets.values() for s in own), {}
    for a, own in sets.items():
        # Alike lines share one of their rarest shingles: at most (100 - percent) percent of a set are not in the other.
        rare = sorted(own, key=lambda s: (often[s], s))[: len(own) * (100 - percent) // 100 + 1]
        for b in {b for s in rare for b in inverted.get(s, ())}:
            n = len(own & sets[b])
            if 100 * n >= percent * (len(own) + len(sets[b]) - n):
                links.append((first[a], first[b]))
        for s in rare:
            inverted.setdefault(s, []).append(a)
    root = roots(set(first.values()), links)
    return {(i, t): [k for k, x in L.lines_of(t or "") if root[first[x]] != ((i is not None, i or 0), L.text_id(t or ""), k)] for i, t in rows}


def line_corpus():
    rng = random.Random(6)
    pool = [" ".join(f"w{rng.randrange(3000)}" for _ in range(rng.randint(1, 30))) for _ in range(40)]
    rows = []
    for i in range(120):
        lines = []
        for _ in range(rng.randint(0, 6)):
            line = rng.choice(pool)
            if rng.random() < 0.5:
                line = line.replace("w1", "v9", rng.randint(0, 2))
            lines.append(line)
        rows.append((i, "\n".join([*lines, ""] if i % 3 else lines)))
    return [*rows, (500, None), (501, " \n\t\n"), (None, pool[0]), (503, "ab\nab\nabc"), (503, "ab\nab\nabc")]


def test_lines_against_brute_force(spark):
    rows = line_corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {(r.doc_id, r.text_id): r.removed for r in L.line_removals(df).collect()}
    want = {(i, L.text_id(t or "")): gone for (i, t), gone in brute_lines(rows).items() if gone}
    assert got == want
    odd = {c: F.lit(1) for c in ("_line_doc", "_LINE_TEXT", "_line_text_id")}
    clean = L.dedup_lines(df.withColumns(odd).select("*", F.lit(7).alias("_line_removed"), F.length("text").cast("long").alias("n_chars"))).collect()
    for r in clean:
        gone = set(want.get((r.doc_id, L.text_id(next(t or "" for i, t in rows if i == r.doc_id))), ()))
        text = next(t for i, t in rows if i == r.doc_id)
        assert r.text == (None if text is None else "\n".join(x for k, x in enumerate(text.split("\n")) if k not in gone))
        assert r.n_chars == (None if text is None else len(r.text)) and r._line_removed == 7
    assert {500, 501} <= {r.doc_id for r in clean}


def test_lines_of_one_changed_word_are_alike(spark):
    rng = random.Random(8)
    words = lambda n: ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(n)]
    rows, want = [], {}
    for k in range(0, 80, 2):
        base = words(14)
        other = [*base]
        other[7] = words(1)[0] if k % 4 else base[7][:3] + "0" + base[7][4:]
        a, b = " ".join(base), " ".join(other)
        rows += [(k, a), (k + 1, b)]
        s, t = ({x[i : i + 5] for i in range(len(x) - 4)} for x in (a, b))
        if 100 * len(s & t) >= 80 * len(s | t):
            want[k + 1] = [0]
    assert len(want) > 30
    assert {r.doc_id: r.removed for r in L.line_removals(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == want


def test_lines_of_a_table_against_an_exact_join(spark):
    """All lines of sf0.01: the same lines go as by an inverted index of all shingles."""
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    want = {(i, L.text_id(t or "")): gone for (i, t), gone in brute_lines(rows).items() if gone}
    got = {(r.doc_id, r.text_id): r.removed for r in L.line_removals(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got == want


def test_no_lines(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert L.line_removals(empty).count() == 0 and L.dedup_lines(empty).count() == 0


def test_keys_of_many_rows_are_compared_in_blocks(spark, monkeypatch):
    import numpy as np

    from quern.llm import components as C
    from quern.llm.shingles import SKETCH

    rng = np.random.default_rng(3)
    base = rng.integers(-(2**63), 2**63 - 1, (4, SKETCH // 8))
    rows = [(int(rng.integers(2)), k, int(rng.integers(4))) for k in range(60)]
    traits = [(k, int(rng.integers(80, 101)), [int(v) for v in base[rng.integers(4)]]) for k in range(60)]
    by_id = {t[0]: t for t in traits}
    want = set()
    for key, a, c in rows:
        for key2, b, c2 in rows:
            (_, n, s), (_, m, t) = by_id[a], by_id[b]
            if key == key2 and a < b and c != c2 and 100 * min(n, m) >= 85 * max(n, m) and s == t:
                want.add((a, b))
    rest = spark.createDataFrame(rows, "key long, id long, c long")
    more = spark.createDataFrame(traits, "id long, n long, sketch array<long>")
    for block in (20_000, 7):
        monkeypatch.setattr(C, "BLOCK", block)
        assert {tuple(r) for r in C.compare_units(C.units(rest, more), 85, SKETCH - 9, None, None, False).collect()} == want


def test_ids_that_agree_in_parts_of_their_hashes_share_keys(spark):
    """Two ids, alone under every key they share, whose hashes agree in 16 bits: no key is lost, and none is made up."""
    import numpy as np

    from quern.llm.components import bucket_members
    from quern.llm.ordermin import mix

    top = mix(np.arange(1 << 12, dtype=np.uint64)) >> np.uint64(48)
    order = np.argsort(top, kind="stable")
    at = np.flatnonzero(top[order][1:] == top[order][:-1])
    pairs = [(int(order[k]), int(order[k + 1])) for k in at]
    assert len(pairs) > 20
    rows = [(1000 * n + k, i) for n, pair in enumerate(pairs) for i in pair for k in range(5)]
    rows += [(10**6 + k, k) for k in range(500)] + [(2**48 - 1, 3), (2**48 - 1, 4), (0, 5), (0, 6), (0, 7)]
    keyed = spark.createDataFrame(rows, "key long, id long").repartition(6)
    seen = []
    from quern.llm.components import may_hold

    def keys_of(only):
        if only is None:
            return lambda batches: batches
        import pyarrow as pa

        run = lambda batches: (b.filter(pa.array(may_hold(only.value, b.column("key").to_numpy()))) for b in batches)
        seen.append(keyed.mapInArrow(run, "key long, id long"))
        return run

    by_key = {}
    for key, i in rows:
        by_key.setdefault(key, set()).add(i)
    want = {(key, i, min(ids)) for key, ids in by_key.items() for i in ids if len(ids) > 1}
    assert {tuple(r) for r in bucket_members(keyed, keys_of, len(rows)).collect()} == want
    assert seen[0].count() < len(rows) - 400  # keys of one id are left out before they are joined


def test_new_edges_join_known_components(spark):
    from quern.llm.components import components

    edges = lambda rows: spark.createDataFrame(rows, "a long, b long")
    known = components(edges([(1, 2), (5, 6), (8, 9), (9, 10)]))
    got = {r.node: r.component for r in components(edges([(2, 6), (10, 3), (20, 21), (4, 4)]), known).collect()}
    assert {k: v for k, v in got.items() if k != 4} == {1: 1, 2: 1, 5: 1, 6: 1, 8: 3, 9: 3, 10: 3, 3: 3, 20: 20, 21: 20}
    assert {r.node: r.component for r in components(edges([]), known).collect()} == {r.node: r.component for r in known.collect()}


def test_linked_pairs_within_blocks_join_components_once(spark, monkeypatch):
    """Alike ids of three components under two keys: a pair for two components and block, not all pairs."""
    import numpy as np

    from quern.llm import components as C

    rest = spark.createDataFrame([(key, k, k % 3) for k in range(200) for key in (1, 2)] + [(3, 500, 500), (3, 0, 0)], "key long, id long, c long")
    rows = [(k, 100, [7, 7], [1, 2], "x" * (k % 5)) for k in range(200)] + [(500, 100, [8, 8], [3, 3], "")]
    texts = spark.createDataFrame(rows, "id long, n long, sketch array<long>, sig array<long>, text string")
    traits = texts.select("id", "n", "sketch", F.octet_length("text").alias("bytes"))
    every = {tuple(r) for r in C.compare_units(C.units(rest, texts.select("id", "n", "sketch")), 80, 16, None, None, False).collect()}
    assert len(every) == (200**2 - 2 * 67**2 - 66**2) // 2
    near = C.compare_units(C.units(rest, traits), 80, 16, None, None, True)
    assert {(r.key, r.id) for r in near.collect()} == {(key, k) for key in (1, 2) for k in range(200)}

    def equal(rows, p, q):
        assert (rows["key"][p] == 1).all()  # each pair under the first key that it shares
        ok = rows["text"][p] == rows["text"][q]
        return p[ok], q[ok]

    first = lambda a, b, key: a[:, 0].astype(np.int64) == key
    for size in (16 << 20, 100):
        monkeypatch.setattr(C, "BLOCK_BYTES", size)
        few = {tuple(r) for r in C.linked_pairs(rest, traits, texts, 80, 16, first, equal).collect()}
        assert few < every and {frozenset((a % 3, b % 3)) for a, b in few} == {frozenset(x) for x in ((0, 1), (0, 2), (1, 2))}
        assert all(a % 5 == b % 5 for a, b in few) and len(few) <= 60


def test_leads_have_met_their_keys_and_stay_away_from_the_last_round(spark):
    """No row of a key that has two ids, and no lead, is compared again; links without a lead are still found."""
    from quern.llm.components import link_buckets

    rows = [(1, 10, 10), (1, 11, 10), (2, 20, 20), (2, 21, 20), (2, 22, 20), (3, 30, 30), (3, 31, 30), (3, 32, 30)]
    members = spark.createDataFrame(rows, "key long, id long, lead long")
    alike, asked, rest = {(21, 22), (30, 31)}, [], []

    def verify(pairs):
        asked.extend(tuple(r) for r in pairs.select("a", "b").collect())
        return pairs.filter(F.concat_ws(",", "a", "b").isin([f"{a},{b}" for a, b in alike]))

    def rest_of(some):
        rest.extend((r.key, r.id) for r in some.collect())
        return spark.createDataFrame([(21, 22)], "a long, b long")

    got = {r.node: r.component for r in link_buckets(members, verify, rest_of).collect()}
    assert sorted(rest) == [(2, 21), (2, 22), (3, 31), (3, 32)]
    assert got[21] == got[22] == 21 and got[30] == got[31] == 30
    asked.clear()
    assert {r.node for r in link_buckets(members, verify, rest_of, lambda stars: stars.filter("a = 30")).collect()} >= {21, 22, 30, 31}
    assert set(asked) == {(30, 31), (30, 32)}


def test_rows_of_small_keys_are_dealt_once(spark):
    from quern.llm.components import units

    rest = spark.createDataFrame([(1, k, k // 3) for k in range(12)], "key long, id long, c long")
    traits = spark.createDataFrame([(k, 5) for k in range(12)], "id long, bytes long")
    assert units(rest, traits).count() == 12


def test_documents_that_lose_no_line_are_not_joined(spark):
    """They are read past the join with removed lines, whatever their doc_id."""
    line = "one line that stands in two documents and goes from the second"
    rows = [(1, f"{line}\nfirst of its kind, alone", 5), (2, f"{line}\nnothing like the others here", 5), (None, "a row without an id", 5), (3, None, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    out = L.dedup_lines(docs)
    assert sorted(((r.doc_id or 0, r.text) for r in out.collect()), key=str) == sorted([(0, "a row without an id"), (1, rows[0][1]), (2, "nothing like the others here"), (3, None)], key=str)
    assert "Union" in out._jdf.queryExecution().toString()


def test_rows_that_sketches_keep_apart_are_no_members(spark):
    import numpy as np
    import pyarrow as pa

    from quern.llm import components as C

    rng = np.random.default_rng(5)
    rows, sketch, most = [], {}, 44
    for key, n in [(k, int(rng.integers(1, 12))) for k in range(1, 80)] + [(100, C.MEET), (101, C.MEET + 1), (102, 900), (103, 3)]:
        base = rng.integers(0, 256, 120).astype(np.uint8)
        for _ in range(n):
            own = base.copy()
            if key != 103:  # from nearly equal to unlike
                change = rng.random(120) < rng.choice([0.1, 0.3, 0.5, 1])
                own[change] = rng.integers(0, 256, int(change.sum()))
            i = int(rng.integers(-(1 << 62), 1 << 62))
            sketch[i] = own
            rows.append((key, i, own.tobytes()))

    def keyed(only, bits):
        def run(batches):
            for b in batches:
                packed = np.frombuffer(b"".join(b.column("sketch").to_pylist()), np.uint8).reshape(-1, 120)
                keep = np.ones(len(packed), bool) if only is None else C.may_hold(only.value, b.column("key").to_numpy())
                b = b.filter(pa.array(keep))
                planes = [pa.array(x) for x in C.low_bits(packed[keep]).T] if bits else []
                yield pa.RecordBatch.from_arrays([b.column("key"), b.column("id"), *planes], names=["key", "id", *C.PLANES[: len(planes)]])

        return run

    table = spark.createDataFrame(rows, "key long, id long, sketch binary").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        got = {(r.key, r.id): (r.lead, r.near, r.other) for r in C.sieved_members(table, keyed, len(rows), most).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")

    groups, close = {}, lambda a, b: int((sketch[a] != sketch[b]).sum()) <= most
    for key, i, _ in rows:
        groups.setdefault(key, []).append(i)
    dropped = 0
    for key, ids in groups.items():
        lead, *rest = sorted(ids)
        for i in rest:
            near, other = close(i, lead), len(ids) > C.MEET or any(close(i, j) for j in rest if j != i)
            if near or other:  # no close pair is lost
                assert got[key, i][0] == lead and got[key, i][1] >= near and got[key, i][2] >= other
            dropped += (key, i) not in got
        assert (key, lead) not in got
    assert dropped > 50
    assert int(C.apart(*(C.low_bits(x[None]).view(np.uint64) for x in (sketch[groups[103][0]], sketch[groups[103][1]])))[0]) == 0


def test_wide_sketches_of_many_pairs_take_bounded_memory():
    import tracemalloc

    import numpy as np

    from quern.llm import components as C

    rng = np.random.default_rng(1)
    sketch = rng.integers(0, 2, (500, 512)).astype(np.uint8)
    rows = {"c": np.arange(500), "sketch": sketch.view(np.uint64)}
    p, q = rng.integers(0, 500, (2, C.PAIRS))
    tracemalloc.start()
    try:
        x, y = C._near(rows, p, q, 260, 80, None)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    print(f"peak {peak / 1e6:.0f} MB")
    assert peak < 64 << 20
    some = rng.integers(0, C.PAIRS, 3000)
    want = [(int(p[k]), int(q[k])) for k in some if p[k] != q[k] and (sketch[p[k]] == sketch[q[k]]).sum() >= 260]
    assert set(want) <= set(zip(x.tolist(), y.tolist(), strict=True)) and ((sketch[x[:3000]] == sketch[y[:3000]]).sum(axis=1) >= 260).all()


def chained_lines():
    """Lines of which each is alike to the next only, so that leads do not link them all."""
    rng = random.Random(12)
    rows, i = [], 0
    for _ in range(25):
        words = [f"w{rng.randrange(10**5)}" for _ in range(24)]
        for k in range(8):
            rows.append((i, " ".join(words) + f"\nonce {rng.random()} {i}"))
            words[3 * k % 24], i = f"x{rng.randrange(10**5)}", i + 1
    return rows


def test_documents_are_read_once_for_the_texts_of_close_lines(spark, monkeypatch):
    rows, calls, asked = chained_lines(), [], []
    texts, linked = L._texts, L.linked_pairs
    monkeypatch.setattr(L, "_texts", lambda only: calls.append(1) or texts(only))
    monkeypatch.setattr(L, "linked_pairs", lambda *a: asked.append(1) or linked(*a))
    got = {(r.doc_id, r.text_id): r.removed for r in L.line_removals(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == {(i, L.text_id(t)): gone for (i, t), gone in brute_lines(rows).items() if gone}
    assert asked and len(calls) == 1


def test_lines_that_occur_once_and_are_not_linked_stay_where_they_are(spark, monkeypatch):
    rng = random.Random(14)
    line = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(12))
    often, twice = line(), line()
    rows = [(i, "\n".join([line(), line(), *([often] if i % 10 == 0 else []), *([twice, "", twice] if i == 7 else [])])) for i in range(200)]
    rows.append((None, rows[5][1]))
    count, write = {}, L.written

    def spied(df, name="t"):
        out = write(df, name)
        count[name] = out.count()
        return out

    monkeypatch.setattr(L, "written", spied)
    got = {(r.doc_id, r.text_id): r.removed for r in L.line_removals(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == {(i, L.text_id(t)): gone for (i, t), gone in brute_lines(rows).items() if gone}
    assert 26 <= count["occurrences"] < 30  # of 426 lines


def test_filter_of_numbers(spark):
    import numpy as np

    from quern.llm import components as C

    df = spark.range(0, 2_000_000, 1, 5).select(F.when(F.col("id") > 0, F.xxhash64("id")).alias("x"))
    x = df.dropna().toArrow().column("x").to_numpy()
    others, passed = np.random.default_rng(5).integers(-(2**63), 2**63 - 1, 200_000), []
    for tables in (1, 2):
        table = C.number_filter(df, "x", tables).value
        assert table.nbytes == 8 << 20 and len(table) == tables and C.may_hold(table, x).all()
        want = np.zeros(C.FILTER_BITS, bool)
        for k in range(tables):
            want[C.filter_places(x, tables, k) + k * (C.FILTER_BITS // tables)] = True
        assert (np.unpackbits(table.view(np.uint8), bitorder="little").astype(bool) == want).all()
        passed.append(C.may_hold(table, others).mean())
    assert 0.025 < passed[0] < 0.034 and passed[1] < 0.005
    assert C.filter_tables(len(x)) == 2 and C.filter_tables(C.FILTER_BITS) == 1
    assert not C.may_hold(C.number_filter(df.filter("x is null"), "x").value, others).any()


def test_bits_of_shingles_leave_out_no_alike_pair():
    import numpy as np

    rng = random.Random(16)
    lines = ["ab", "a", "abcd", "aaaaaaaaaaaa", "aaaaaaaaaaa"]
    for _ in range(60):
        base = [rng.choice("abcdefghijklmnopqrstuvwxyzé日") for _ in range(rng.randint(5, 300))]
        lines += ["".join(x if rng.random() > share else "#" for x in base) for share in (0, 0.005, 0.02, 0.05, 0.1)]
    sets = [L._shingles(x) for x in lines]
    n, bits = np.array([len(s) for s in sets]), L.shingle_bits(lines)
    p, q = (x.ravel() for x in np.triu_indices(len(lines), 1))
    ok = L.may_be_alike(bits, n, p, q, 80)
    both = np.array([len(sets[i] & sets[j]) for i, j in zip(p.tolist(), q.tolist(), strict=True)])
    alike, far = 100 * both >= 80 * (n[p] + n[q] - both), 100 * both < 60 * (n[p] + n[q] - both)
    assert alike.sum() > 100 and ok[alike].all() and ok[far].mean() < 0.01
