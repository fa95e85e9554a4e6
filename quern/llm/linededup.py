"""Fuzzy line dedup by MinHash.

Lines are compared as sets of character shingles. One-permutation MinHash signatures are banded with high recall,
candidates are verified by the exact Jaccard similarity of their shingle sets, and a distributed union-find makes
components; of each component the first line in the corpus stays. Equal lines are one class from the start, so a line
that occurs in a million documents is compared once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.components import CELLS, PLANES, agreement, link_buckets, linked_pairs, low_bits, may_hold, number_filter, sieved_members
from quern.llm.ordermin import distinct
from quern.llm.pretok import lean, slices
from quern.llm.shingles import mix32, one_permutation, sketch_least, sketches
from quern.session import discard, release, written

#: Characters of a shingle. Shorter lines are one shingle.
WIDTH = 5
#: A pair of similarity 0.8 is missed by all bands with a probability of (1 - 0.8^5)^24 < 1/13,000.
BANDS, ROWS = 24, 5
BINS = BANDS * ROWS
#: Lines are signed in slices of about so many characters, which stay in the processor's cache.
CHARS = 200_000
_POWERS = [np.uint32(pow(0x9E3779B1, k, 1 << 32)) for k in range(WIDTH)]
#: Bits that shingles are noted in where many pairs of lines are compared.
BITS = 1024
#: Lines that a task remembers, so as not to sign them again.
SEEN = 200_000
#: Parts that the lines of a component are dealt into where they are told its first line.
SALTS = 32
BLANK = " \t\n\x0b\x0c\r"


def lines_of(text: str) -> list[tuple[int, str]]:
    """(number from 0, line) of the lines that are not blank; lines end at \\n alone."""
    return [(k, x) for k, x in enumerate(text.split("\n")) if x.strip(BLANK)]


def shingle_hashes(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (32 bits) of the character shingles of all lines, repeats included, and how many each line has."""
    raw = np.frombuffer("".join(lines).encode("utf-32-le"), np.uint32)
    sizes = np.fromiter(map(len, lines), np.int64, len(lines))
    n, begin = len(raw), np.cumsum(sizes) - sizes
    points = np.concatenate([raw + np.uint32(1), np.zeros(WIDTH - 1, np.uint32)])
    h = points[:n] * _POWERS[WIDTH - 1]
    for j in range(1, WIDTH):
        h += points[j : j + n] * _POWERS[WIDTH - 1 - j]
    whole = np.ones(n, bool)
    for j in range(1, WIDTH):  # no shingle begins so near to a line's end
        whole[np.maximum(begin + sizes - j, begin)] = False
    for k in np.flatnonzero(sizes < WIDTH).tolist():
        v = int(sizes[k])
        for p in points[begin[k] : begin[k] + sizes[k]].tolist():
            v = (v * 0x9E3779B1 + p + 0x51ED27) & 0xFFFFFFFF
        whole[begin[k] : begin[k] + sizes[k]] = False
        h[begin[k]], whole[begin[k]] = v, True
    return mix32(h[whole]), np.maximum(sizes - WIDTH + 1, 1)


def signatures(lines: list[str]) -> np.ndarray:
    """(lines, BINS) MinHash values."""
    return one_permutation(*shingle_hashes(lines), BINS)


def band_keys(sketch: np.ndarray) -> np.ndarray:
    """(lines, BANDS) keys of 48 bits: the number of the band and a byte of each of its values.

    They come from the sketches, so lines that agree in a band's values share its key, and sketches are all that is kept.
    """
    wide = np.zeros((len(sketch), BANDS, 8), np.uint8)
    wide[:, :, :ROWS] = sketch.reshape(-1, BANDS, ROWS)
    wide[:, :, ROWS] = np.arange(1, BANDS + 1)
    return wide.view("<i8")[:, :, 0]


def line_id(line: str) -> int:
    return xxhash.xxh3_64_intdigest(line) - (1 << 63)


def line_check(line: str) -> int:
    """A second hash; lines are equal if both are."""
    return xxhash.xxh64_intdigest(line, seed=7) - (1 << 63)


def text_id(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text, seed=3) - (1 << 63)


def _hashes(values: list[str], digest, *seed: int) -> np.ndarray:
    """As line_id, line_check and text_id, of many."""
    return (np.fromiter((digest(x, *seed) for x in values), np.uint64, len(values)) ^ np.uint64(1 << 63)).view(np.int64)


#: ids, checks and numbers are those of all lines, packed.
DOCUMENT = "doc_id long, text_id long, n_lines long, ids binary, checks binary, numbers binary, again array<long>, fresh array<long>, sizes array<int>, sketches binary"


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document: the hashes of its lines and their numbers, and ids, bytes and sketches of the lines that
    this task has not met before, as far as a bounded memory goes; `again` are the ids of the others."""
    seen: set[int] = set()
    for b in batches:
        at = 0
        for part in slices([t or "" for t in b.column("text").to_pylist()]):
            lines = [lines_of(t) for t in part]
            flat = [x for own in lines for _, x in own]
            hashes = _hashes(flat, xxhash.xxh3_64_intdigest)
            ids = hashes.tolist()
            fresh, counts, again, again_counts, k = [], [], [], [], 0
            for own in lines:
                before, again_before = len(fresh), len(again)
                for j in range(k, k + len(own)):
                    x = ids[j]
                    if x in seen:
                        again.append(x)
                    else:
                        seen.add(x)
                        fresh.append(j)
                k += len(own)
                counts.append(len(fresh) - before)
                again_counts.append(len(again) - again_before)
            if len(seen) > SEEN:
                seen.clear()
            new = [flat[j] for j in fresh]
            packed = b"".join(sketches(signatures(some)).tobytes() for some in slices(new, CHARS))
            ends, new_ends, again_ends = (np.concatenate([[0], np.cumsum(x)]).astype(np.int32) for x in ([len(own) for own in lines], counts, again_counts))
            cols = [b.column("doc_id").slice(at, len(part)), pa.array(_hashes(part, xxhash.xxh3_64_intdigest, 3)), pa.array(np.diff(ends).astype(np.int64))]
            for values in (hashes, _hashes(flat, xxhash.xxh64_intdigest, 7), np.array([k for own in lines for k, _ in own], np.int32)):
                cols.append(_cut(values, ends))
            cols.append(pa.ListArray.from_arrays(pa.array(again_ends), pa.array(again, pa.int64())))
            for values in (pa.array([ids[j] for j in fresh], pa.int64()), pa.array([len(x) if x.isascii() else len(x.encode()) for x in new], pa.int32())):
                cols.append(pa.ListArray.from_arrays(pa.array(new_ends), values))
            cols.append(_cut(np.frombuffer(packed, np.dtype((np.void, BINS))), new_ends))
            at += len(part)
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "text_id", "n_lines", "ids", "checks", "numbers", "again", "fresh", "sizes", "sketches"])


def _cut(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Values of one width as binary values of the pieces between `ends`."""
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends * np.int32(values.itemsize)), pa.py_buffer(values.tobytes())])


def _packed(rows: np.ndarray) -> pa.Array:
    """(n, bytes) -> n binary values."""
    data = np.ascontiguousarray(rows)
    ends = pa.py_buffer(np.arange(len(data) + 1, dtype=np.int32) * data.shape[1])
    return pa.Array.from_buffers(pa.binary(), len(data), [None, ends, pa.py_buffer(data)])


def _signed(batches: Iterator[pa.RecordBatch], twice: Broadcast, single: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Ids, bytes and sketches of the lines in rows (fresh, sizes, sketches, settled). Lines of rows that are not settled
    are left out if the filter `twice` lets them pass; with single=False the others are."""
    for whole in batches:
        for at in range(0, whole.num_rows, 1000):
            b = whole.slice(at, 1000)
            ids, sizes = (b.column(c).flatten().to_numpy() for c in ("fresh", "sizes"))
            packed = np.frombuffer(b"".join(b.column("sketches").to_pylist()), np.uint8).reshape(-1, BINS)
            settled = np.repeat(b.column("settled").to_numpy(zero_copy_only=False), b.column("fresh").value_lengths().to_numpy())
            repeated = may_hold(twice.value, ids) & ~settled
            keep = np.flatnonzero(~repeated if single else repeated)
            yield ids[keep], sizes[keep], packed[keep]


def _keyed(twice: Broadcast, only: Broadcast | None, bits: bool):
    """(key, id) of signed lines, with `bits` also the low bits of their sketches; `only` is a filter of keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, _, packed in _signed(batches, twice):
            keys, own = band_keys(packed).reshape(-1), np.repeat(np.arange(len(ids)), BANDS)
            if only is not None:
                keep = may_hold(only.value, keys)
                keys, own = keys[keep], own[keep]
            planes = low_bits(packed)[own].T if bits else ()
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (keys, ids[own], *planes)], names=["key", "id", *PLANES[: len(planes)]])

    return run


def _sketched(twice: Broadcast, only: Broadcast | None, single: bool = True):
    """(id, bytes, sketch) of signed lines; `only` is a filter of ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, sizes, packed in _signed(batches, twice, single):
            if only is not None:
                keep = may_hold(only.value, ids)
                ids, sizes, packed = ids[keep], sizes[keep], packed[keep]
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(sizes), _packed(packed)], names=["id", "bytes", "sketch"])

    return run


def _occurrences(*some: Broadcast):
    """(id, check, doc_id, text_id, line) of the lines in rows (doc_id, text_id, n_lines, ids, checks, numbers) whose id one of
    the filters lets pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, checks, numbers = (np.frombuffer(b"".join(b.column(c).to_pylist()), kind) for c, kind in (("ids", np.int64), ("checks", np.int64), ("numbers", np.int32)))
            keep = np.flatnonzero(np.logical_or.reduce([may_hold(f.value, ids) for f in some]))
            own = pa.array(np.repeat(np.arange(b.num_rows), b.column("n_lines").to_numpy())[keep])
            cols = [pa.array(ids[keep]), pa.array(checks[keep]), b.column("doc_id").take(own), b.column("text_id").take(own), pa.array(numbers[keep])]
            yield pa.RecordBatch.from_arrays(cols, names=["id", "check", "doc_id", "text_id", "line"])

    return run


def first_shared_key(a: np.ndarray, b: np.ndarray, key: np.ndarray) -> np.ndarray:
    """For pairs of lines with a common key, by their sketches: whether `key` is the first that they share."""
    x, y = band_keys(a), band_keys(b)
    at = (x == y).argmax(axis=1)
    return x[np.arange(len(x)), at] == key


def _texts(only: Broadcast):
    """(id, check, text, n) of the lines whose id the filter lets pass, a line once for a task as far as a bounded memory
    goes; n is the number of distinct shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            for part in slices([t or "" for t in b.column("text").to_pylist()], CHARS):
                lines = [x for t in part for x in t.split("\n") if x.strip(BLANK)]
                ids = _hashes(lines, xxhash.xxh3_64_intdigest)
                some = []
                for k in np.flatnonzero(may_hold(only.value, ids)).tolist():
                    if (check := line_check(lines[k])) not in seen:
                        seen.add(check)
                        some.append((k, check))
                if len(seen) > SEEN:
                    seen.clear()
                if some:
                    found = [lines[k] for k, _ in some]
                    n = distinct_shingles(found, np.arange(len(found)), len(found))
                    yield pa.RecordBatch.from_arrays([pa.array(ids[[k for k, _ in some]]), pa.array([c for _, c in some], pa.int64()), pa.array(found, pa.string()), pa.array(n)], names=["id", "check", "text", "n"])

    return run


def _unpacked(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, BINS)


def _allowed(percent: int):
    """(a, b): pairs that sketches allow."""
    least = sketch_least(percent, BINS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 10_000):
                b = whole.slice(at, 10_000)
                ok = agreement(_unpacked(b.column("sa")), _unpacked(b.column("sb"))) >= least
                yield b.select(["a", "b"]).filter(pa.array(ok))

    return run


def distinct_shingles(lines: list[str], own: np.ndarray, n: int) -> np.ndarray:
    """How many distinct shingles the lines of each of `n` owners have together. Exact, without hashes.

    Code points are numbered within the call, so that an owner and a shingle fit into 64 bits. Where they do not, or a
    line is shorter than a shingle, sets of strings do the work.
    """
    points = np.frombuffer("".join(lines).encode("utf-32-le"), np.uint32)
    met = np.zeros(int(points.max(initial=0)) + 1, bool)
    met[points] = True
    known = np.flatnonzero(met)
    bits = int(len(known)).bit_length()
    sizes = np.fromiter(map(len, lines), np.int64, len(lines))
    if WIDTH * bits + n.bit_length() > 64 or sizes.min() < WIDTH:
        sets: list[set[str]] = [set() for _ in range(n)]
        for k, x in zip(own.tolist(), lines, strict=True):
            sets[k] |= _shingles(x)
        return np.array([len(s) for s in sets])
    table = np.zeros(len(met), np.uint64)
    table[known] = np.arange(len(known), dtype=np.uint64)
    code = table[points]
    h = code[: len(code) - WIDTH + 1].copy()
    for j in range(1, WIDTH):
        h = (h << np.uint64(bits)) | code[j : j + len(h)]
    begin, counts = np.cumsum(sizes) - sizes, sizes - WIDTH + 1
    at = np.arange(counts.sum()) + np.repeat(begin - (np.cumsum(counts) - counts), counts)
    shift = np.uint64(WIDTH * bits)
    keys = distinct((np.repeat(own.astype(np.uint64), counts) << shift) | h[at])
    return np.bincount((keys >> shift).astype(np.int64), minlength=n)


def shingle_bits(lines: list[str]) -> np.ndarray:
    """(lines, BITS / 64): a bit is set for each shingle of a line, by its hash."""
    out = [np.empty((0, BITS // 64), np.uint64)]
    for part in slices(lines, CHARS // 4):
        h, counts = shingle_hashes(part)
        bits = np.zeros(len(part) * BITS, bool)
        bits[np.repeat(np.arange(len(part)) * BITS, counts) + h % np.uint32(BITS)] = True
        out.append(np.packbits(bits).reshape(len(part), -1).view(np.uint64))
    return np.concatenate(out)


def may_be_alike(bits: np.ndarray, n: np.ndarray, p: np.ndarray, q: np.ndarray, percent: int) -> np.ndarray:
    """Whether pairs (p, q) of lines may be alike, by all lines' shingle_bits and numbers of shingles. No alike pair is left
    out: a bit that only one of two lines has comes from a shingle that only this one has."""
    ok, step = np.zeros(len(p), bool), CELLS // (BITS // 8)
    for t in range(0, len(p), step):
        i, j = p[t : t + step], q[t : t + step]
        alone = [np.bitwise_count(bits[x] & ~bits[y]).sum(axis=1, dtype=np.int64) for x, y in ((i, j), (j, i))]
        both = np.minimum(n[i] - alone[0], n[j] - alone[1])
        ok[t : t + step] = 100 * both >= percent * (n[i] + n[j] - both)
    return ok


def _alike(left: list[str], right: list[str], total: np.ndarray, percent: int) -> np.ndarray:
    """Places of the pairs of lines that are alike by their sets of shingles; `total` is the sum of both sets' sizes."""
    found, at = [np.empty(0, np.int64)], 0
    for part in slices(left, CHARS // 2):
        union = distinct_shingles([*part, *right[at : at + len(part)]], np.tile(np.arange(len(part)), 2), len(part))
        both = total[at : at + len(part)] - union
        found.append(at + np.flatnonzero(100 * both >= percent * union))
        at += len(part)
    return np.concatenate(found)


def _verified(percent: int):
    """Pairs that are alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            total = b.column("na").to_numpy() + b.column("nb").to_numpy()
            yield b.select(["a", "b"]).take(pa.array(_alike(b.column("ta").to_pylist(), b.column("tb").to_pylist(), total, percent)))

    return run


def _shingles(line: str) -> set[str]:
    return {line[i : i + WIDTH] for i in range(max(1, len(line) - WIDTH + 1))}


def line_removals(df: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_id, removed): the numbers of the lines that go, for documents that lose any.

    Lines end at \\n; blank lines are left alone. Two lines are linked at 100 * intersection >= percent * union of
    their sets of 5-character shingles. The first line of a component stays: the one of the least doc_id (nulls
    first), then text_id, then line number. Rows of one doc_id and one text are one document and get the same lines.
    Null and empty texts have no lines.
    """
    return _removals(df, percent, id_col, text_col)[1]


def _removals(df: DataFrame, percent: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """All documents (doc_id, text_id, ids, ...), and line_removals."""
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    whole = written(docs.mapInArrow(lean(_documents), DOCUMENT), "lines")
    place = F.struct("doc_id", "text_id", "line")
    # Few lines are signed by more than one task. Only they travel to become one; the others are read where they were made.
    counts = whole.select(F.explode("fresh").alias("id")).groupBy("id").count()
    twice = number_filter(counts.filter("count > 1"), "id")
    own = whole.select("fresh", "sizes", "sketches", F.lit(False).alias("settled"))
    again = written(own.mapInArrow(_sketched(twice, None, False), "id long, bytes int, sketch binary").dropDuplicates(["id"]), "again")
    signed = own.unionByName(again.select(F.array("id").alias("fresh"), F.array("bytes").alias("sizes"), F.col("sketch").alias("sketches"), F.lit(True).alias("settled")))
    release(df.sparkSession)
    n_lines = whole.agg(F.sum(F.size("fresh")).alias("n")).first().n or 0
    members = sieved_members(signed, lambda only, bits: _keyed(twice, only, bits), n_lines * BANDS, BINS - sketch_least(percent, BINS))
    met = members.select(F.explode(F.array("id", "lead")).alias("id"))
    sketched = written(signed.mapInArrow(_sketched(twice, number_filter(met, "id")), "id long, bytes int, sketch binary"), "sketches")
    discard(again)
    release(df.sparkSession)

    fetched: list[DataFrame] = []

    def close(stars: DataFrame) -> DataFrame:
        """The pairs that sketches allow. Texts (id, check, text, n) are fetched of these and of the rows that may meet in
        the last round, so that documents are read for them once; should two lines have one id, the one of the lesser check."""
        left, right = (sketched.select(F.col("id").alias(x), F.col("sketch").alias(f"s{x}")) for x in "ab")
        pairs = written(stars.join(right, "b").join(left, "a").select("a", "b", "sa", "sb").mapInArrow(_allowed(percent), "a long, b long"), "near")
        release(df.sparkSession)
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("id")).unionByName(members.filter("other").select("id"))
        rows = docs.select("text").mapInArrow(lean(_texts(number_filter(wanted, "id"))), "id long, check long, text string, n long")
        rows = rows.groupBy("id").agg(F.min(F.struct("check", "text", "n")).alias("x")).select("id", "x.check", "x.text", "x.n")
        fetched.append(written(rows, "texts"))
        release(df.sparkSession)
        return pairs

    def compared(pairs: DataFrame) -> DataFrame:
        left, right = (fetched[0].select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("text").alias(f"t{x}")) for x in "ab")
        both = pairs.join(right, "b").join(left, "a")
        return both.select("a", "b", "ta", "tb", "na", "nb").mapInArrow(lean(_verified(percent)), "a long, b long")

    def exact(rows: dict, p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if "bits" not in rows:
            rows["bits"] = shingle_bits(rows["text"].tolist())
        ok = may_be_alike(rows["bits"], rows["n"], p, q, percent)
        p, q = p[ok], q[ok]
        at = _alike(rows["text"][p].tolist(), rows["text"][q].tolist(), rows["n"][p] + rows["n"][q], percent)
        return p[at], q[at]

    def rest_of(rest: DataFrame) -> DataFrame:
        return linked_pairs(rest, sketched, lambda near: fetched[0].drop("check"), percent, sketch_least(percent, BINS), first_shared_key, exact)

    linked = link_buckets(members, compared, rest_of, close)
    # The second hash ties a component to the line that was verified, should two lines have one id.
    named = written(linked.join(fetched[0], linked.node == F.col("id")).select("id", "check", "component"), "named")
    discard(members, sketched, *fetched)
    release(df.sparkSession)
    # Only lines that occur again or are linked go on. One that occurs again does so within a task or in several; what
    # filters let pass besides is left out below. Occurrences come together as counts and firsts only.
    some = number_filter(named.select("id").unionByName(whole.select(F.explode("again").alias("id"))), "id")
    lines = whole.select("doc_id", "text_id", "n_lines", "ids", "checks", "numbers").mapInArrow(_occurrences(twice, some), "id long, check long, doc_id long, text_id long, line int")
    lines = written(lines, "occurrences")
    seen = lines.groupBy("id", "check").agg(F.min(place).alias("first"), F.count("*").alias("n")).join(named, ["id", "check"], "left")
    seen = written(seen.filter("component is not null or n > 1").select("id", "check", "first", "component"), "seen")
    discard(named)
    release(df.sparkSession)
    least = seen.filter("component is not null").groupBy("component").agg(F.min("first").alias("least"))
    # A component may hold a large part of the linked lines: the one row of its first line is there for each salt.
    salted = seen.filter("component is not null").withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    least = salted.join(least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["component", "salt"])
    kept = least.select("id", "check", F.col("least").alias("keep")).unionByName(seen.filter("component is null").select("id", "check", F.col("first").alias("keep")))
    kept = written(kept, "kept")
    discard(seen)
    release(df.sparkSession)
    gone = lines.join(kept, ["id", "check"]).filter(~place.eqNullSafe(F.col("keep")))
    return whole, gone.groupBy("doc_id", "text_id").agg(F.array_sort(F.collect_set("line")).alias("removed"))


def dedup_lines(df: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """`df` without the lines of line_removals; a column of lengths, if there, is set anew.

    A document all of whose lines have gone is a copy of earlier ones and goes too. Documents that had no line to lose
    stay as they are; other columns stay, whatever their names.
    """
    schema, names = df.schema, df.columns
    own = ["_line_text_id", "_line_removed", "_line_doc", "_line_text"]
    while set(own) & {c.lower() for c in names}:
        own = [c + "_" for c in own]
    key, cut, of_doc, of_text = own
    removals = written(line_removals(df, percent, id_col, text_col).select(F.col("doc_id").alias(of_doc), F.col("text_id").alias(of_text), F.col("removed").alias(cut)), "removals")
    release(df.sparkSession)
    losing = number_filter(removals, of_doc)

    def split(lose: bool):
        """Documents that may lose lines, with the hash of their text; or the others, which stay where they are."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                ids = b.column(of_doc)
                some = may_hold(losing.value, ids.fill_null(0).to_numpy()) | ids.is_null().to_numpy(zero_copy_only=False)
                b = b.select(names).filter(pa.array(some == lose))
                hashes = [pa.array([text_id(t or "") for t in b.column(text_col).to_pylist()], pa.int64())] if lose else []
                yield pa.RecordBatch.from_arrays([*b.columns, *hashes], names=[*names, *([key] if lose else [])])

        return run

    def without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, keep = [], []
            for k, (t, gone) in enumerate(zip(b.column(text_col).to_pylist(), b.column(cut).to_pylist(), strict=True)):
                if gone:
                    gone = set(gone)
                    t = "\n".join(x for j, x in enumerate(t.split("\n")) if j not in gone)
                    if not t.strip(BLANK):
                        continue
                texts.append(t)
                keep.append(k)
            b = b.select(names).take(pa.array(keep, pa.int64()))
            made = {text_col: pa.array(texts, pa.string())}
            if length_col in names:
                made[length_col] = pa.array([None if t is None else len(t) for t in texts], pa.int64()).cast(b.column(length_col).type)
            yield pa.RecordBatch.from_arrays([made.get(n, b.column(n)) for n in names], names=names)

    wide = df.select("*", F.col(id_col).cast("long").alias(of_doc))
    some = wide.mapInArrow(lean(split(True)), df.select("*", F.lit(0).cast("long").alias(key)).schema)
    on = some[id_col].cast("long").eqNullSafe(F.col(of_doc)) & (some[key] == F.col(of_text))
    changed = some.join(removals, on, "left").select(*names, cut).mapInArrow(lean(without), schema)
    return wide.mapInArrow(lean(split(False)), schema).unionByName(changed)


def op3_fuzzy_lines(spark, sf_dir: str) -> DataFrame:
    """For every document: how many lines it has and which of them go, as numbers from 0."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")

    whole, gone = _removals(docs, 80, "doc_id", "text")
    sizes = whole.select("doc_id", "text_id", "n_lines")
    gone = gone.select(F.col("doc_id").alias("d"), F.col("text_id").alias("t"), "removed")
    both = sizes.join(gone, sizes.doc_id.eqNullSafe(gone.d) & (sizes.text_id == gone.t), "left")
    return both.select("doc_id", "n_lines", F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"), F.coalesce(F.array_join("removed", ","), F.lit("")).alias("removed"))
