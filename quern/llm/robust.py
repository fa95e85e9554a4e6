"""Quality rules: text statistics, hard limits, and robust multivariate outliers.

Each document's statistics become a vector of four transformed values. For every language and source, every language,
and all documents, a minimum-covariance-determinant estimate is fitted: from each of two fixed starts (coordinate
medians with the floors as scatter; mean and covariance of all rows) concentration steps take the three quarters of
rows of least Mahalanobis distance for the next mean and scatter, STEPS times; of the two ends that of the
lesser determinant stays. A document far from the estimate of its own language and source (or, where few documents
have passed the limits there, of its language, or of all) is rejected.

Everything is DataFrame and SQL expressions. The values are fixed-point integers, so sums do not depend on the order
of rows. Equal vectors of a group become one row with a count before anything else; the quantiles of distances are
read from histograms of at most 512 bins; and where estimates are joined to rows, both carry a salt. So the rows of a
group, however many, never have to meet in one task. The same statements, as common table expressions, are the query's SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.session import discard, written

#: A group needs so many documents for an estimate of its own.
LEAST_ROWS = 200
#: Concentration steps from each start. After four the verdicts on the test tables no longer change.
STEPS = 5
#: Parts that the rows of a group are dealt to where they are joined.
SALTS = 64
#: Share of rows that a concentration step takes, in percent, and what makes their scatter that of a normal sample.
HALF, CONSISTENT = 75, 1.485
#: Squared distance above which a document is rejected: the 0.99999 quantile of chi-square with 4 degrees of freedom.
CUTOFF = 28.5
#: Standard deviations, in units of 1e-4, that are added to the scatter, so that a group of alike documents does not
#: make every other one an outlier. Each is small enough for its statistic to reject a document by itself.
FLOORS = (1000, 5000, 1000, 350)
#: Pseudo-counts: a short text says little about its ratios.
WORDS, LENGTH, LINES = 50, 5, 5

DIMS = (1, 2, 3, 4)
LOWER = tuple((i, j) for i in DIMS for j in DIMS if j <= i)


def text_statistics(df: DataFrame, text_col: str = "text") -> DataFrame:
    """`df` with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words (all long).

    Words are runs of characters other than U+0020 and U+0009 to U+000D; lines end at \\n and count if they hold a word;
    a line is a duplicate if it equals an earlier one; a word is repeated if it lies in a window of 5 words that
    occurs twice or more in the text. A null text has none of anything.
    """
    mark = "_q"
    while any(c.lower().startswith(mark) for c in df.columns):
        mark += "_"
    t, flat, words, keys, runs, lines, sure, order, places = (f"{mark}_{c}" for c in ("text", "flat", "words", "keys", "runs", "lines", "sure", "order", "places"))
    out = df.withColumn(t, F.coalesce(F.col(text_col), F.lit("")))
    clean = F.col(t)
    for c in "\t\n\x0b\x0c\r":
        clean = F.replace(clean, F.lit(c), F.lit(" "))
    bare = F.col(t)
    for c in "#*$%&|<>":
        bare = F.replace(bare, F.lit(c), F.lit(""))
    full = F.filter(F.split(F.col(t), "\n", -1), lambda x: F.length(F.trim(x, F.lit(" \t\x0b\x0c\r"))) > 0)
    out = out.withColumns({flat: clean, "n_symbols": (F.octet_length(t) - F.octet_length(bare)).cast("long"), lines: full})
    out = out.withColumns({words: F.array_remove(F.split(F.col(flat), " ", -1), ""), "word_chars": F.length(F.replace(F.col(flat), F.lit(" "), F.lit(""))).cast("long")})
    window = lambda i: [F.get(F.col(words), i + k) for k in range(5)]
    starts = F.when(F.size(words) >= 5, F.sequence(F.lit(0), F.size(words) - 5)).otherwise(F.array().cast("array<int>"))
    out = out.withColumns({"n_words": F.size(words).cast("long"), runs: starts, "n_lines": F.size(lines).cast("long"), "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")})
    out = out.withColumn(keys, F.transform(F.col(runs), lambda i: F.xxhash64(*window(i))))
    # Different hashes prove different windows; only where some are equal the windows themselves are compared.
    same = F.size(F.array_distinct(keys)) < F.size(keys)
    out = out.withColumn(sure, F.when(same, F.transform(F.col(runs), lambda i: F.struct(F.concat_ws(" ", *window(i)).alias("w"), i.alias("i")))))
    out = out.withColumn(order, F.sort_array(F.col(sure)))
    twice = lambda x, k: (x["w"] == F.get(F.col(order), k - 1)["w"]) | (x["w"] == F.get(F.col(order), k + 1)["w"])
    found = F.transform(F.filter(F.col(order), lambda x, k: F.coalesce(twice(x, k), (x["w"] == F.get(F.col(order), k + 1)["w"]), (x["w"] == F.get(F.col(order), k - 1)["w"]), F.lit(False))), lambda x: x["i"])
    out = out.withColumn(places, F.sort_array(found))
    spans = F.transform(F.col(places), lambda p, k: F.least(F.lit(5), F.coalesce(F.get(F.col(places), k + 1) - p, F.lit(5))))
    out = out.withColumn("n_repeat_words", F.coalesce(F.aggregate(spans, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long"))
    return out.drop(t, flat, words, keys, runs, lines, sure, order, places)


def _d(x) -> str:
    return f"CAST({x} AS DOUBLE)"


#: The transformed values, in fixed point: word length, symbols, duplicate lines, repeated words.
VECTOR = f"""
  CAST(round(10000 * ln(({_d("word_chars")} + {WORDS * LENGTH}) / (n_words + {WORDS}))) AS BIGINT) AS x1,
  CAST(round(10000 * ln(1 + 1000 * {_d("n_symbols")} / (word_chars + {WORDS * LENGTH}))) AS BIGINT) AS x2,
  CAST(round(10000 * sqrt({_d("n_dup_lines")} / (n_lines + {LINES}))) AS BIGINT) AS x3,
  CAST(round(10000 * {_d("n_repeat_words")} / (n_words + {WORDS})) AS BIGINT) AS x4"""
_X = ", ".join(f"x{i}" for i in DIMS)
_NONE, _SEP = "chr(2)", "chr(1)"
_LANG = f"concat('1', {_SEP}, coalesce(lang, {_NONE}))"
_BOTH = f"concat('0', {_SEP}, coalesce(lang, {_NONE}), {_SEP}, coalesce(source, {_NONE}))"

#: Rows for the fits: each document that passes the limits, for its source, its language, and all; equal ones as one.
FIT = f"""SELECT g, {_X}, count(*) AS c FROM (SELECT CASE v.k WHEN 0 THEN {_BOTH} WHEN 1 THEN {_LANG} ELSE '2' END AS g, {_X}
FROM {{rows}} CROSS JOIN (VALUES (0), (1), (2)) AS v(k) WHERE NOT base_failed) AS r GROUP BY g, {_X}"""

_VALUE = "CASE v.k " + " ".join(f"WHEN {i} THEN x{i}" for i in DIMS) + " END"
#: The first start: coordinate medians to 0.01, and the floors as scatter.
MEDIANS = f"""SELECT g, 0 AS s, {", ".join(f"{_d(f'max(CASE WHEN k = {i} THEN b END) * 100 + 50')} AS m{i}" for i in DIMS)},
  {", ".join(f"{_d(FLOORS[i - 1] if i == j else 0)} AS l{i}{j}" for i, j in LOWER)}
FROM (SELECT g, k, min(b) AS b
  FROM (SELECT g, k, b, sum(c) OVER (PARTITION BY g, k ORDER BY b) AS upto, sum(c) OVER (PARTITION BY g, k) AS total
    FROM (SELECT g, v.k, CAST(floor({_d(_VALUE)} / 100) AS BIGINT) AS b, sum(c) AS c
      FROM {{fit}} CROSS JOIN (VALUES (1), (2), (3), (4)) AS v(k) GROUP BY g, v.k, CAST(floor({_d(_VALUE)} / 100) AS BIGINT)) AS counted) AS summed
  WHERE 2 * upto >= total GROUP BY g, k) AS medians GROUP BY g"""
#: For the second: all rows in one bin.
ALL_ROWS = f"SELECT g, 1 AS s, {_X}, c, CAST(0 AS BIGINT) AS b FROM {{fit}}"


def _distance(x: str, p: str) -> str:
    """Squared Mahalanobis distance by forward substitution in the lower triangle."""
    y: list[str] = []
    for i in DIMS:
        minus = "".join(f" - {p}l{i}{j} * ({y[j - 1]})" for j in DIMS if j < i)
        y.append(f"({x}x{i} - {p}m{i}{minus}) / {p}l{i}{i}")
    return " + ".join(f"({v}) * ({v})" for v in y)


#: Distances of the fit's rows, as bins of their logarithm.
BINNED = f"SELECT f.g, p.s, {_X}, c, CAST(least(511, floor(16 * ln(1 + {_distance('f.', 'p.')}))) AS BIGINT) AS b FROM {{fit}} AS f JOIN {{params}} AS p ON f.g = p.g"


def _dec(*factors: str) -> str:
    return _d("sum(CAST(c AS DECIMAL(18, 0))" + "".join(f" * CAST({x} AS DECIMAL(9, 0))" for x in factors) + ")")


_SUMS = ", ".join([*(f"{_dec(f'x{i}')} AS s{i}" for i in DIMS), *(f"{_dec(f'x{i}', f'x{j}')} AS q{i}{j}" for i, j in LOWER)])
#: Counts and sums by bin come first; the least bins that hold the share are added up.
MOMENTS = f"""SELECT g, s, CAST(sum(c) AS BIGINT) AS c, b, {_SUMS} FROM {{binned}} GROUP BY g, s, b"""
_TAKEN = ", ".join([f"sum({c}) AS {c}" for c in ("c", *(f"s{i}" for i in DIMS), *(f"q{i}{j}" for i, j in LOWER))])
TAKEN = f"""SELECT g, s, {_TAKEN}
FROM (SELECT *, sum(c) OVER (PARTITION BY g, s ORDER BY b) AS upto, sum(c) OVER (PARTITION BY g, s) AS total FROM {{moments}}) AS t
WHERE 100 * (upto - c) < {HALF} * total GROUP BY g, s"""
SCATTER = "SELECT g, s, " + ", ".join([*(f"s{i} / c AS m{i}" for i in DIMS), *(f"{CONSISTENT}E0 * (q{i}{j} - s{i} * s{j} / c) / c + {float(FLOORS[i - 1]) ** 2 if i == j else 0.0}E0 AS a{i}{j}" for i, j in LOWER)]) + " FROM {taken}"


def _cholesky() -> list[str]:
    """Statements that add one column of the lower triangle each, as later ones need the earlier."""
    means = ", ".join(f"m{i}" for i in DIMS)
    out = []
    for j in DIMS:
        done = [f"l{a}{b}" for a, b in LOWER if b < j]
        todo = [f"a{a}{b}" for a, b in LOWER if b > j or b == j]
        root = "a{0}{0}".format(j) + "".join(f" - l{j}{k} * l{j}{k}" for k in DIMS if k < j)
        new = [f"sqrt({root}) AS l{j}{j}"]
        for i in DIMS:
            if i > j:
                new.append(f"(a{i}{j}" + "".join(f" - l{i}{k} * l{j}{k}" for k in DIMS if k < j) + f") / sqrt({root}) AS l{i}{j}")
        rest = [c for c in todo if c[2] != str(j)]
        out.append(f"SELECT g, s, {', '.join([means, *done, *new, *rest])} FROM {{triangle}}")
    return out


TRIANGLE = _cholesky()
_PARAMS = [*(f"m{i}" for i in DIMS), *(f"l{i}{j}" for i, j in LOWER)]
#: Of each group the estimate of least determinant, with the number of its rows.
BEST = f"""SELECT d.g, n, {", ".join(_PARAMS)} FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY {" * ".join(f"l{i}{i}" for i in DIMS)}, s) AS place FROM {{params}}) AS d
JOIN (SELECT g, CAST(sum(c) AS BIGINT) AS n FROM {{fit}} GROUP BY g) AS sizes ON d.g = sizes.g WHERE place = 1"""
#: For each language and source the finest estimate that enough documents stand behind.
_PICK = ", ".join(f"CASE WHEN p0.n >= {LEAST_ROWS} THEN p0.{c} WHEN p1.n >= {LEAST_ROWS} THEN p1.{c} ELSE p2.{c} END AS {c}" for c in _PARAMS)
CHOSEN = f"""SELECT k.g AS own, {_PICK} FROM (SELECT DISTINCT {_BOTH} AS g, {_LANG} AS l FROM {{rows}}) AS k LEFT JOIN {{best}} AS p0 ON p0.g = k.g
LEFT JOIN {{best}} AS p1 ON p1.g = k.l LEFT JOIN (SELECT * FROM {{best}} WHERE g = '2') AS p2 ON TRUE"""
PLACED = f"SELECT r.*, {', '.join(_PARAMS)} FROM {{rows}} AS r LEFT JOIN {{chosen}} AS q ON q.own = {_BOTH}"
BASE = "n_words < 10 OR 100 * n_repeat_words > 20 * n_words"
FLAG = f"NOT base_failed AND coalesce({_distance('', '')} <= {CUTOFF}E0, TRUE)"


def quality_rules(df: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """`df` with the statistics, base_failed and kept.

    base_failed: fewer than 10 words, or over 20 percent of the words repeated. kept: not so, and within the cutoff of
    the robust estimate. Null languages and sources are groups of their own. Where no document passes the limits there
    is no estimate, and the limits decide alone. Repeated rows each count. Columns of `df` with the names of the
    statistics are replaced; the others stay.
    """
    spark = df.sparkSession
    extra = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    names = [c for c in df.columns if c not in extra]
    # All other columns travel as one, so that none can clash with those of the fit.
    stats = text_statistics(df.select(F.struct(*(F.col(f"`{c}`") for c in names if c != text_col)).alias("row"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{source_col}`").cast("string").alias("source")))
    # Written with the texts: the statistics, which are most of the work, are computed once.
    flagged = judged(written(spark.sql(f"SELECT *, {VECTOR}, ({BASE}) AS base_failed FROM {{stats}}", stats=stats), "stats"))
    return flagged.select(*(F.col("text").alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in names), *extra)


def _salted(df: DataFrame, every: bool) -> DataFrame:
    """`df` with a salt: a row for every salt, or one of them for each row, in turn."""
    return df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))) if every else (F.monotonically_increasing_id() % SALTS).cast("int"))


def fit(rows: DataFrame) -> DataFrame:
    """The estimate of each group, from rows (lang, source, base_failed, x1..x4): (g, n, m1.., l11..)."""
    spark = rows.sparkSession
    fitted = written(_salted(spark.sql(FIT, rows=rows), False), "vectors")

    def step(binned: DataFrame) -> DataFrame:
        out = spark.sql(SCATTER, taken=spark.sql(TAKEN, moments=spark.sql(MOMENTS, binned=binned)))
        for statement in TRIANGLE:
            out = spark.sql(statement, triangle=out)
        return out.select("g", "s", *_PARAMS)

    params = written(spark.sql(MEDIANS, fit=fitted).select("g", "s", *_PARAMS).unionByName(step(spark.sql(ALL_ROWS, fit=fitted))), "start")
    for _ in range(STEPS):
        binned = spark.sql(f"{BINNED} AND f.salt = p.salt", fit=fitted, params=_salted(params, True))
        new = written(step(binned), "scatter")
        discard(params)
        params = new
    best = written(spark.sql(BEST, params=params, fit=fitted), "best")
    discard(params, fitted)
    return best


def judged(rows: DataFrame) -> DataFrame:
    """Written rows of statistics with `kept`. The estimates read the few small columns only."""
    spark = rows.sparkSession
    chosen = _salted(written(spark.sql(CHOSEN, rows=rows, best=fit(rows)), "chosen"), True)
    placed = spark.sql(f"{PLACED} AND q.salt = r.salt", rows=_salted(rows, False), chosen=chosen)
    return spark.sql(f"SELECT *, {FLAG} AS kept FROM {{placed}}", placed=placed)


def op1_robust_quality(spark, sf_dir: str) -> DataFrame:
    """Statistics and verdict of every whole document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    stats = text_statistics(docs).drop("text")
    # The statistics are a few numbers a document: written once, they serve the fit and the result.
    rows = written(spark.sql(f"SELECT *, {VECTOR}, ({BASE}) AS base_failed FROM {{stats}}", stats=stats), "stats")
    return judged(rows).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _oracle() -> str:
    parts = [
        ("texts", "SELECT doc_id, coalesce(text, '') AS text, lang, source, row_number() OVER () AS rid FROM documents"),
        ("split_up", "SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM texts"),
        ("places", "SELECT rid, i, array_to_string(w[i:i + 4], ' ') AS k FROM (SELECT rid, w, unnest(range(1, len(w) - 3)) AS i FROM split_up WHERE len(w) >= 5) AS s"),
        ("twice", "SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS c FROM places) AS s WHERE c > 1"),
        ("spans", "SELECT rid, least(5, coalesce(lead(i) OVER (PARTITION BY rid ORDER BY i) - i, 5)) AS n FROM twice"),
        ("repeats", "SELECT rid, sum(n) AS n FROM spans GROUP BY rid"),
        (
            "stats",
            "SELECT doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars, "
            "CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, "
            "CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words FROM split_up LEFT JOIN repeats AS r USING (rid)",
        ),
        ("rows_", f"SELECT *, {VECTOR}, ({BASE}) AS base_failed FROM stats"),
        ("fit", FIT.format(rows="rows_")),
        ("moments", MOMENTS.format(binned=f"({ALL_ROWS.format(fit='fit')}) AS a")),
        ("taken", TAKEN.format(moments="moments")),
        ("triangle0", SCATTER.format(taken="taken")),
    ]
    columns = ", ".join(["g", "s", *_PARAMS])
    for k, statement in enumerate(TRIANGLE):
        parts.append((f"triangle{k + 1}", statement.format(triangle=f"triangle{k}")))
    parts.append(("params0", f"SELECT {columns} FROM ({MEDIANS.format(fit='fit')}) AS a UNION ALL SELECT {columns} FROM triangle{len(TRIANGLE)}"))
    for s in range(STEPS):
        parts += [
            (f"binned{s}", BINNED.format(fit="fit", params=f"params{s}")),
            (f"moments{s}", MOMENTS.format(binned=f"binned{s}")),
            (f"taken{s}", TAKEN.format(moments=f"moments{s}")),
            (f"triangle{s}0", SCATTER.format(taken=f"taken{s}")),
        ]
        for k, statement in enumerate(TRIANGLE):
            parts.append((f"params{s + 1}" if k == len(TRIANGLE) - 1 else f"triangle{s}{k + 1}", statement.format(triangle=f"triangle{s}{k}")))
    parts.append(("best", BEST.format(params=f"params{STEPS}", fit="fit")))
    parts.append(("chosen", CHOSEN.format(rows="rows_", best="best")))
    parts.append(("placed", PLACED.format(rows="rows_", chosen="chosen")))
    chain = ",\n".join(f"{name} AS MATERIALIZED ({body})" for name, body in parts)
    return f"WITH {chain}\nSELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, {FLAG} AS kept FROM placed"


ORACLE = _oracle()
