"""DuckDB SQL of the registered queries, written on its own: holidays come from a list of Easter days, the calendar from
date arithmetic, and every estimate from plain joins. Common table expressions are put in front as a query needs them."""

from __future__ import annotations

import re

from quern.config import DEFAULT

_C = DEFAULT
_DATES = ", ".join(f"(DATE '{d}')" for d in _C.cutoffs)
_BANDS = " ".join(f"WHEN rank <= {b} THEN '{n}'" for b, n in _C.bands)
_PAYLOAD = ("2000-01-01", "2000-12-31")

# Easter Sundays.
EASTER = ("1995-04-16", "1996-04-07", "1997-03-30", "1998-04-12", "1999-04-04", "2000-04-23", "2001-04-15")
_DRIFT = "({0} LIKE 'dec%' OR {0} LIKE 'runup%' OR {0} IN ('jan_wk1', 'xmas_eve', 'nye', 'Juledag', 'Anden juledag', 'Nytårsdag'))"
_DECAY = "pow(0.5, (c.cutoff - {0}) / 365.25)"
_GROUP = "CASE WHEN name LIKE 'bf%' THEN 'bf' WHEN name LIKE 'dec%' OR name IN ('xmas_eve', 'nye', 'Juledag', 'Anden juledag', 'Nytårsdag') THEN 'xmas' END"
_SPLIT = "CASE WHEN name LIKE 'bf%' THEN 'bf' WHEN name IN ('dec20', 'dec21', 'dec22', 'dec23', 'xmas_eve') THEN 'dec_wind' WHEN name IN ('dec27', 'dec28', 'dec29', 'dec30', 'nye', 'Nytårsdag', 'Juledag', 'Anden juledag') THEN 'dec_lull' END"
_MONDAY = "(make_date(y, 1, 4) - (isodow(make_date(y, 1, 4)) - 1)::INT + 7 * ({0} - 1)::INT)"


def _factors(weight: str) -> str:
    return f"""SELECT c.cutoff, name, sum(w * net) AS actual, sum(w * base) AS expected,
      CASE WHEN name LIKE 'bf%' THEN least(greatest(sum(w * net) / sum(w * base), 0), 5) ELSE least(greatest(sum(w * net) / sum(w * base), 0), 1.5) END AS factor
      FROM (SELECT c.cutoff, e.*, {weight} AS w FROM evidence e JOIN cutoffs c ON e.date <= c.cutoff) c GROUP BY c.cutoff, name"""


def _damp(k: int) -> str:
    earlier = " UNION ALL ".join(f"SELECT * FROM damp{j}" for j in range(k)) or "SELECT NULL::DATE AS cutoff, NULL::VARCHAR AS type, NULL::DOUBLE AS damp WHERE false"
    return f"""SELECT cutoff, type, least(greatest(sum(w * net) / sum(w * base), max(lo)), max(hi)) AS damp FROM (
      SELECT c.cutoff, d.date, d.type, d.lo, d.hi, n.net, avg(b.net / coalesce(f.damp, 1)) AS base, CASE WHEN {_DRIFT.format("d.type")} THEN {_DECAY.format("d.date")} ELSE 1 END AS w
      FROM damp_rows d JOIN cutoffs c ON d.date <= c.cutoff JOIN net n ON n.date = d.date
      JOIN clean_net b ON b.date >= d.anchor + d.s0 AND b.date < d.anchor + d.s1 AND isodow(b.date) = isodow(d.date) AND b.date <= c.cutoff
      LEFT JOIN (SELECT date, arg_max(type, ord) AS type FROM damp_rows WHERE ord < {k} GROUP BY date) t ON t.date = b.date
      LEFT JOIN ({earlier}) f ON f.cutoff = c.cutoff AND f.type = t.type
      WHERE d.ord = {k} GROUP BY c.cutoff, d.date, d.type, d.lo, d.hi, n.net, d.least HAVING count(*) >= d.least AND avg(b.net / coalesce(f.damp, 1)) > 0) GROUP BY cutoff, type"""


def _mult(group: str, factors: str, decayed: bool = True) -> str:
    w = f"CASE WHEN b.grp <> 'bf' THEN {_DECAY.format('b.date')} ELSE 1 END" if decayed else "1"
    return f"""SELECT c.cutoff, b.series_id, b.grp, least(greatest((sum({w} * p.y) + 500) / (sum({w} * b.base * c.factor) + 500), 0.2), 3) AS mult
      FROM (SELECT s.date, s.name, s.grp, q.series_id, avg(q.y) AS base FROM (SELECT date, name, {group} AS grp FROM special_days) s
        JOIN clean q ON q.date >= s.date - 28 AND q.date < s.date WHERE s.grp IS NOT NULL GROUP BY s.date, s.name, s.grp, q.series_id HAVING count(*) >= 10) b
      JOIN panel p ON p.date = b.date AND p.series_id = b.series_id JOIN {factors} c ON c.name = b.name AND b.date <= c.cutoff GROUP BY c.cutoff, b.series_id, b.grp"""


def _shape(k: int) -> str:
    return f"""SELECT cutoff, series_id, weekday, coalesce(profile / nullif(sum(profile) OVER (PARTITION BY cutoff, series_id) / 7, 0), 0) AS shape FROM (
      SELECT cutoff, series_id, isodow(date) - 1 AS weekday, avg(y) AS profile FROM (
        SELECT c.cutoff, p.*, row_number() OVER (PARTITION BY c.cutoff, series_id, isodow(date) ORDER BY date DESC) AS rn FROM clean p JOIN cutoffs c ON p.date <= c.cutoff)
      WHERE rn <= {k} GROUP BY cutoff, series_id, isodow(date))"""


def _halves(damp: bool) -> str:
    f = "LEFT JOIN damp_by_day f ON f.cutoff = c.cutoff AND f.date = p.date" if damp else "LEFT JOIN (SELECT 1.0 AS damp) f ON true"
    return f"""SELECT c.cutoff, p.series_id, {", ".join(f"coalesce(sum({x}) FILTER (p.date {op} c.cutoff - 7), 0) AS {n}_{h}" for n, x in (("num", "p.y / coalesce(f.damp, 1)"), ("den", "s.shape")) for h, op in (("r", ">"), ("p", "<=")))}
      FROM clean p JOIN cutoffs c ON p.date <= c.cutoff AND p.date > c.cutoff - 14
      LEFT JOIN shape s ON s.cutoff = c.cutoff AND s.series_id = p.series_id AND s.weekday = isodow(p.date) - 1 {f} GROUP BY c.cutoff, p.series_id"""


_RATIO = "CASE WHEN {1} > 0 THEN ({0}) / ({1}) ELSE 0 END"
_LEVELS = f"""SELECT cutoff, series_id, num_r AS num_recent, {_RATIO.format("num_r + num_p", "den_r + den_p")} AS level0, {_RATIO.format("num_r", "den_r")} AS l_recent, {_RATIO.format("num_p", "den_p")} AS l_prev FROM """


def _roll(days: int, least: int) -> str:
    w = f"OVER (PARTITION BY series_id ORDER BY date ROWS BETWEEN {days - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count(y_clean) {w} >= {least} THEN avg(y_clean) {w} END"


def _capped(x: str) -> str:
    return f"least(greatest({x} / nullif(base, 0), 0), 12)"


CTES: dict[str, str] = {
    "shipments": "SELECT CAST(l_shipdate AS DATE) AS d, l_suppkey AS acct FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag <> 'R' AND o_orderstatus <> 'P'",
    "firsts": "SELECT acct, min(d) AS first_date FROM shipments GROUP BY acct",
    "ranked": f"SELECT acct, count(*) AS n_ref, row_number() OVER (ORDER BY count(*) DESC, acct) AS rank FROM shipments WHERE d BETWEEN DATE '{_C.ref_start}' AND DATE '{_C.ref_end}' GROUP BY acct",
    "member": f"SELECT acct, CASE WHEN rank <= {_C.top} THEN 'c_' || acct {_BANDS} END AS series_id, CAST(rank AS INT) AS rank, n_ref, first_date FROM ranked JOIN firsts USING (acct) WHERE rank <= {_C.ranked}",
    "series": f"SELECT DISTINCT series_id, CASE WHEN series_id LIKE 'c_%' THEN 'customer' ELSE 'tail_group' END AS kind, CASE WHEN series_id LIKE 'c_%' THEN first_date ELSE DATE '{_C.start}' END AS first_date FROM (SELECT series_id, first_date FROM member UNION SELECT '{_C.rest}', NULL)",
    "daily": f"SELECT d AS date, coalesce(series_id, '{_C.rest}') AS series_id, CAST(count(*) AS BIGINT) AS cnt FROM shipments LEFT JOIN member USING (acct) WHERE d BETWEEN DATE '{_C.start}' AND DATE '{_C.end}' GROUP BY 1, 2",
    "spine": f"SELECT CAST(unnest(generate_series(DATE '{_C.start}', DATE '{_C.end}', INTERVAL 1 DAY)) AS DATE) AS date",
    "panel": "SELECT spine.date, series.series_id, CAST(coalesce(cnt, 0) AS INT) AS y FROM spine CROSS JOIN series LEFT JOIN daily ON daily.date = spine.date AND daily.series_id = series.series_id",
    "net": "SELECT date, CAST(sum(y) AS BIGINT) AS net FROM panel GROUP BY date",
    "cutoffs": f"SELECT * FROM (VALUES {_DATES}) AS v(cutoff)",
    "easters": "SELECT CAST(year(e) AS INT) AS y, e FROM (VALUES " + ", ".join(f"(DATE '{e}')" for e in EASTER) + ") AS v(e)",
    "holidays": """SELECT CAST(e + k AS DATE) AS date, name FROM easters CROSS JOIN (VALUES (-3, 'Skærtorsdag'), (-2, 'Langfredag'), (0, 'Påskedag'), (1, 'Anden påskedag'), (26, 'Store bededag'), (39, 'Kristi himmelfartsdag'), (49, 'Pinsedag'), (50, 'Anden pinsedag')) AS v(k, name)
      UNION ALL SELECT make_date(y, m, d), name FROM easters CROSS JOIN (VALUES (1, 1, 'Nytårsdag'), (12, 25, 'Juledag'), (12, 26, 'Anden juledag')) AS v(m, d, name)""",
    "fridays": "SELECT y, (SELECT CAST(max(d) AS DATE) FROM (SELECT unnest(generate_series(make_date(y, 11, 22), make_date(y, 11, 28), INTERVAL 1 DAY)) AS d) WHERE isodow(d) = 4) + 1 AS bf FROM easters",
    "special_days": """SELECT date, arg_min(name, p) AS name FROM (
      SELECT 1 AS p, date, name FROM holidays UNION ALL SELECT 2, e + 40, 'ascension_bridge' FROM easters
      UNION ALL SELECT 3, make_date(y, m, d), name FROM easters CROSS JOIN (VALUES (12, 24, 'xmas_eve'), (12, 31, 'nye'), (6, 5, 'constitution_day')) AS v(m, d, name)
      UNION ALL SELECT 4, bf + k, 'bf' || CASE WHEN k >= 0 THEN '+' ELSE '-' END || abs(k) FROM fridays CROSS JOIN (VALUES (-4), (-3), (-2), (-1), (0), (1), (2), (3)) AS v(k)
      UNION ALL SELECT 5, make_date(y, 12, d), 'dec' || d FROM easters CROSS JOIN (VALUES (20), (21), (22), (23), (27), (28), (29), (30)) AS v(d)) GROUP BY date""",
    "damp_all": f"""SELECT 0 AS ord, 'jan' AS grp, make_date(y, 1, 2) + k AS date, 'jan_wk1' AS type, make_date(y, 1, 2) AS anchor FROM easters CROSS JOIN (SELECT unnest(range(7))::INT AS k)
      UNION ALL SELECT g.ord, g.grp, {_MONDAY.format("w")} + k, g.grp || '_wk' || w, {_MONDAY.format("g.a")} FROM easters CROSS JOIN (VALUES (1, 'win', 7, 8), (3, 'sum', 25, 32), (4, 'aut', 41, 43)) AS g(ord, grp, a, b) CROSS JOIN (SELECT unnest(range(54))::INT AS w) CROSS JOIN (SELECT unnest(range(7))::INT AS k) WHERE w BETWEEN g.a AND g.b
      UNION ALL SELECT 2, 'asc', e + 36 + k, 'asc_wk' || (k // 7), e + 36 FROM easters CROSS JOIN (SELECT unnest(range(21))::INT AS k)
      UNION ALL SELECT 5, 'runup', make_date(y, 11, 28) + k, CASE WHEN k <= 7 THEN 'runup_w3' WHEN k <= 14 THEN 'runup_w2' ELSE 'runup_w1' END, bf - 4 FROM fridays CROSS JOIN (SELECT unnest(range(22))::INT AS k)""",
    "damp_rows": """SELECT d.*, g.lo, g.hi, g.s0, g.s1, g.least FROM damp_all d JOIN (VALUES (0, 0.9, 1.6, 7, 21, 1), (1, 0.5, 1.3, -28, 0, 2), (2, 0.5, 1.3, -28, 0, 2), (3, 0.5, 1.3, -28, 0, 2), (4, 0.5, 1.3, -28, 0, 2), (5, 0.8, 2.0, -28, 0, 2)) AS g(ord, lo, hi, s0, s1, least) ON g.ord = d.ord
      WHERE d.date NOT IN (SELECT date FROM special_days) AND NOT (d.ord = 3 AND d.date IN (SELECT date FROM damp_all WHERE ord = 2))""",
    "types": "SELECT date, arg_min(t, p) AS day_type FROM (SELECT date, 0 AS p, name AS t FROM special_days UNION ALL SELECT date, CASE grp WHEN 'jan' THEN 1 WHEN 'asc' THEN 2 WHEN 'win' THEN 3 WHEN 'sum' THEN 4 WHEN 'aut' THEN 5 ELSE 6 END, type FROM damp_all) GROUP BY date",
    "edge_days": "SELECT date FROM special_days WHERE NOT ((month(date) = 12 AND day(date) >= 20) OR (month(date) = 1 AND day(date) = 1))",
    "long_spine": f"SELECT CAST(unnest(generate_series(DATE '{_C.start}', DATE '{_C.end}' + 30, INTERVAL 1 DAY)) AS DATE) AS date",
    "edges": "SELECT s.date, CAST(least(10, coalesce(min(e.date - s.date) FILTER (e.date >= s.date), 10)) AS INT) AS to_special, CAST(least(10, coalesce(min(s.date - e.date) FILTER (e.date <= s.date), 10)) AS INT) AS since_special FROM long_spine s LEFT JOIN edge_days e ON true GROUP BY s.date",
    "clean": "SELECT * FROM panel WHERE date NOT IN (SELECT date FROM special_days)",
    "clean_net": "SELECT * FROM net WHERE date NOT IN (SELECT date FROM special_days)",
    "masked": "SELECT p.*, CASE WHEN s.date IS NULL THEN y END AS y_clean FROM panel p LEFT JOIN special_days s ON s.date = p.date",
    "profile42": "SELECT cutoff, series_id, isodow(date) - 1 AS weekday, avg(y) AS profile FROM (SELECT c.cutoff, p.*, row_number() OVER (PARTITION BY c.cutoff, series_id, isodow(date) ORDER BY date DESC) AS rn FROM panel p JOIN cutoffs c ON p.date <= c.cutoff AND p.date > c.cutoff - 42) WHERE rn <= 4 GROUP BY ALL",
    "profile4": "SELECT cutoff, series_id, isodow(date) - 1 AS weekday, avg(y) AS profile FROM (SELECT c.cutoff, p.*, row_number() OVER (PARTITION BY c.cutoff, series_id, isodow(date) ORDER BY date DESC) AS rn FROM clean p JOIN cutoffs c ON p.date <= c.cutoff) WHERE rn <= 4 GROUP BY ALL",
    "shape": _shape(4),
    "shape6": _shape(6),
    "special_levels": "SELECT c.cutoff, series_id, avg(y) AS special_level FROM clean p JOIN cutoffs c ON p.date <= c.cutoff AND p.date >= c.cutoff - 28 GROUP BY ALL",
    "evidence": "SELECT s.date, s.name, n.net, avg(b.net) AS base FROM special_days s JOIN net n ON n.date = s.date JOIN clean_net b ON b.date >= s.date - 28 AND b.date < s.date GROUP BY s.date, s.name, n.net HAVING count(*) >= 10 AND avg(b.net) > 0",
    "plain_factors": _factors("1"),
    "factors": _factors(f"CASE WHEN {_DRIFT.format('name')} THEN {_DECAY.format('e.date')} ELSE 1 END"),
    "all_factors": _factors(_DECAY.format("e.date")),
    "pooled": "SELECT c.cutoff, least(greatest(coalesce(sum(actual) / sum(expected), 0.5), 0), 1.5) AS pooled FROM cutoffs c LEFT JOIN factors f ON f.cutoff = c.cutoff GROUP BY c.cutoff",
    "plain_pooled": "SELECT c.cutoff, least(greatest(coalesce(sum(actual) / sum(expected), 0.5), 0), 1.5) AS pooled FROM cutoffs c LEFT JOIN plain_factors f ON f.cutoff = c.cutoff GROUP BY c.cutoff",
    **{f"damp{k}": _damp(k) for k in range(6)},
    "damps": " UNION ALL ".join(f"SELECT * FROM damp{k}" for k in range(6)),
    "day_of_damp": "SELECT date, arg_max(type, ord) AS type FROM damp_rows GROUP BY date",
    "damp_by_day": "SELECT f.cutoff, d.date, f.damp FROM day_of_damp d JOIN damps f ON f.type = d.type",
    "mults": _mult(_GROUP, "factors"),
    "split_mults": _mult(_SPLIT, "factors"),
    "plain_mults": _mult(_GROUP, "plain_factors", False),
    "vacations": """SELECT f.cutoff, p.series_id, least(greatest((sum(p.y) + 500) / (sum(b.base * f.damp) + 500), 0.3), 2) AS mult
      FROM damp_rows d JOIN panel p ON p.date = d.date
      JOIN (SELECT a.anchor, q.series_id, avg(q.y) AS base FROM (SELECT DISTINCT anchor FROM damp_rows) a JOIN clean q ON q.date >= a.anchor - 28 AND q.date < a.anchor
        WHERE q.date NOT IN (SELECT date FROM damp_rows) GROUP BY ALL HAVING count(*) >= 10) b ON b.anchor = d.anchor AND b.series_id = p.series_id
      JOIN damps f ON f.type = d.type AND d.date <= f.cutoff GROUP BY f.cutoff, p.series_id""",
    "halves": _halves(False),
    "damp_halves": _halves(True),
    "plain_levels": _LEVELS + "halves",
    "levels": f"SELECT *, CASE WHEN l_recent > 0 AND l_prev > 0 AND abs(ln(CASE WHEN l_recent > 0 AND l_prev > 0 THEN l_recent / l_prev ELSE 1 END)) > 0.18 THEN l_recent ELSE level0 END AS level FROM ({_LEVELS} damp_halves)",
    "growths": "SELECT cutoff, series_id, coalesce(1 + 0.5 * num_recent / (num_recent + 500) * (least(greatest(CASE WHEN l_prev > 0 AND l_recent > 0 THEN l_recent / l_prev ELSE 1 END, 0.85), 1.15) - 1), 1) AS growth FROM levels",
    "cells": "SELECT c.cutoff, s.series_id, c.cutoff + k AS date, k AS lead, isodow(c.cutoff + k) - 1 AS weekday, d.name FROM cutoffs c CROSS JOIN series s CROSS JOIN (SELECT unnest(range(1, 15))::INT AS k) LEFT JOIN special_days d ON d.date = c.cutoff + k",
    "naive": "SELECT x.cutoff, x.series_id, x.date, CAST(coalesce(y, 0) AS DOUBLE) AS yhat FROM cells x LEFT JOIN panel p ON p.series_id = x.series_id AND p.date = x.date - CASE WHEN lead <= 7 THEN 7 ELSE 14 END",
    "profiled": "SELECT x.cutoff, x.series_id, x.date, coalesce(profile, 0) AS yhat FROM cells x LEFT JOIN profile42 p ON p.cutoff = x.cutoff AND p.series_id = x.series_id AND p.weekday = x.weekday",
    "plain_special": "SELECT x.*, coalesce(l.special_level, 0) * coalesce(f.factor, CASE WHEN x.name LIKE 'bf%' THEN 1 ELSE p.pooled END) AS event FROM cells x LEFT JOIN special_levels l ON l.cutoff = x.cutoff AND l.series_id = x.series_id LEFT JOIN plain_factors f ON f.cutoff = x.cutoff AND f.name = x.name JOIN plain_pooled p ON p.cutoff = x.cutoff",
    "holidayed": "SELECT x.cutoff, x.series_id, x.date, CASE WHEN name IS NULL THEN coalesce(profile, 0) ELSE event END AS yhat FROM plain_special x LEFT JOIN profile4 p ON p.cutoff = x.cutoff AND p.series_id = x.series_id AND p.weekday = x.weekday",
    "shaped": "SELECT x.cutoff, x.series_id, x.date, CASE WHEN name IS NULL THEN coalesce(shape, 0) * coalesce(level0, 0) ELSE event END AS yhat FROM plain_special x LEFT JOIN shape s ON s.cutoff = x.cutoff AND s.series_id = x.series_id AND s.weekday = x.weekday LEFT JOIN plain_levels l ON l.cutoff = x.cutoff AND l.series_id = x.series_id",
    "hand_parts": f"""SELECT x.*, coalesce(sl.special_level, 0) * coalesce(f.factor, CASE WHEN x.name LIKE 'bf%' THEN 1 ELSE p.pooled END) * coalesce(m.mult, 1) AS event,
      coalesce(s.shape, 0) * coalesce(l.level, 0) * coalesce(dd.damp, 1) AS normal, coalesce(s.shape, 0) * coalesce(l.level0, 0) * coalesce(dd.damp, 1) AS smooth
      FROM (SELECT *, {_GROUP} AS grp FROM cells) x LEFT JOIN special_levels sl ON sl.cutoff = x.cutoff AND sl.series_id = x.series_id LEFT JOIN factors f ON f.cutoff = x.cutoff AND f.name = x.name
      JOIN pooled p ON p.cutoff = x.cutoff LEFT JOIN mults m ON m.cutoff = x.cutoff AND m.series_id = x.series_id AND m.grp = x.grp
      LEFT JOIN shape s ON s.cutoff = x.cutoff AND s.series_id = x.series_id AND s.weekday = x.weekday LEFT JOIN levels l ON l.cutoff = x.cutoff AND l.series_id = x.series_id
      LEFT JOIN damp_by_day dd ON dd.cutoff = x.cutoff AND dd.date = x.date""",
    "bursts": "SELECT cutoff, series_id, CASE WHEN avg(y) > 0 THEN median(y) / avg(y) ELSE 1 END AS rho FROM clean p JOIN cutoffs c ON p.date <= c.cutoff AND p.date > c.cutoff - 84 GROUP BY ALL",
    "weights": "SELECT cutoff, series_id, rho, w AS w_l1, (1 - w) / 2 AS w_other FROM (SELECT *, 1.0::DOUBLE / 3 + least(greatest((0.75 - rho) / 0.5, 0), 1) * (0.70::DOUBLE - 1.0::DOUBLE / 3) AS w FROM bursts)",
    "rolled": f"SELECT date, series_id, y, {_roll(7, 3)} AS l7, {_roll(14, 5)} AS l14_raw, {_roll(28, 7)} AS l28, {_roll(56, 7)} AS l56, avg((y > 0)::INT) OVER (PARTITION BY series_id ORDER BY date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) AS active_60 FROM masked",
    "features": f"""SELECT ref, series_id, date, lead, CAST(isodow(date) - 1 AS INT) AS weekday, CAST(month(date) AS INT) AS month, coalesce(day_type, 'normal') AS day_type, to_special, since_special,
      ln(1 + base) AS l14_log, {_capped("l28")} AS l28_ratio, {_capped("l7")} AS l7_ratio, {", ".join(f"{_capped(f'g{j}')} AS lag{j}_ratio" for j in range(4))},
      CASE WHEN fa IS NULL OR fa > ref THEN -1 ELSE least(ref - fa, 730)::INT END AS age_days, active_60, base, actual FROM (
      SELECT r.date AS ref, r.series_id, r.date + k AS date, k AS lead, r.l7, r.l28, r.active_60, coalesce(r.l14_raw, r.l28, r.l56) AS base, t.day_type, e.to_special, e.since_special, fa.fa, a.y AS actual,
        {", ".join(f"g{j}.y AS g{j}" for j in range(4))}
      FROM rolled r JOIN cutoffs c ON c.cutoff = r.date CROSS JOIN (SELECT unnest(range(1, 15))::INT AS k) LEFT JOIN types t ON t.date = r.date + k LEFT JOIN edges e ON e.date = r.date + k
      LEFT JOIN (SELECT series_id, min(date) FILTER (y > 0) AS fa FROM panel GROUP BY series_id) fa ON fa.series_id = r.series_id
      LEFT JOIN panel a ON a.series_id = r.series_id AND a.date = r.date + k
      {" ".join(f"LEFT JOIN panel g{j} ON g{j}.series_id = r.series_id AND g{j}.date = r.date + k - 7 * (CASE WHEN k <= 7 THEN 1 ELSE 2 END + {j})" for j in range(4))})""",
    "scored": "SELECT f.series_id, s.kind, f.cutoff, f.date, CAST(f.date - f.cutoff AS INT) AS lead, p.y, greatest(f.yhat, 0) AS yhat FROM profiled f JOIN series s ON s.series_id = f.series_id AND s.first_date <= f.cutoff LEFT JOIN panel p ON p.series_id = f.series_id AND p.date = f.date",
    "payload_lines_": f"SELECT series_id, series_id || ',' || string_agg(y, ',' ORDER BY date) AS line FROM panel WHERE date BETWEEN DATE '{_PAYLOAD[0]}' AND DATE '{_PAYLOAD[1]}' GROUP BY series_id",
    "payload_year_lines": "SELECT CAST(year(date) AS INT) AS year, series_id || ',' || string_agg(y, ',' ORDER BY date) AS line, min(date) AS a, max(date) AS b FROM panel GROUP BY 1, series_id",
    "payload_years_": "SELECT year, 'v2,' || count(*) || ',' || (max(b) - min(a) + 1) || ',' || min(a) || ',' || max(b) || chr(10) || string_agg(line, chr(10) ORDER BY line) AS payload FROM payload_year_lines GROUP BY year",
    "payload_": f"SELECT 'v2,' || count(*) || ',366,{_PAYLOAD[0]},{_PAYLOAD[1]}' || chr(10) || string_agg(line, chr(10) ORDER BY line) AS payload FROM payload_lines_",
}

_W = "CASE WHEN sum(y){0} > 0 THEN sum(abs(yhat - y)){0} / sum(y){0} END"
_WMAPE = _W.format("")
_BIAS = "CASE WHEN sum(y) > 0 THEN sum(yhat - y) / sum(y) END"


def _slice(where: str) -> str:
    return _W.format(f" FILTER ({where})")


#: Final statements; columns named after ROUND are given to 6 decimals.
_FINAL: dict[str, tuple[str, str]] = {
    "shipments_fact": ("d, acct", "shipments"),
    "membership_rank": ("acct, series_id, rank, n_ref, first_date", "member"),
    "series_bands": ("series_id, kind, first_date", "series"),
    "daily_counts": ("date, series_id, cnt", "daily"),
    "dense_panel": ("date, series_id, y", "panel"),
    "series_totals": ("series_id, CAST(sum(y) AS BIGINT) AS total, count(*) AS n_days, max(date) AS last_date", "panel GROUP BY series_id"),
    "yearly_totals": ("CAST(year(date) AS INT) AS year, CAST(sum(y) AS BIGINT) AS total, count(DISTINCT series_id) AS n_series, count(*) AS n_rows", "panel GROUP BY 1"),
    "network_daily": ("date, net", "net"),
    "first_active": ("series_id, min(date) FILTER (y > 0) AS first_active", "panel GROUP BY series_id"),
    "payload_lines": ("series_id, line", "payload_lines_"),
    "payload_md5": ("CAST(length(payload) AS INT) AS len, md5(payload) AS md5", "payload_"),
    "payload_slices": ("CAST(off AS INT) AS off, substr(payload, off, 4000) AS part", "(SELECT payload, unnest(generate_series(1, length(payload), 4000)) AS off FROM payload_)"),
    "payload_years": ("year, CAST(length(payload) AS INT) AS len, md5(payload) AS md5", "payload_years_"),
    "payload_reassembled": ("date, series_id, y", "panel"),
    "membership_csv": ("acct AS core_account_id, series_id, rank, CAST(n_ref AS INT) AS n_ref, series_id AS name, first_date", "member"),
    "catalogue_json": (
        "series_id, kind, core_account_id, rank, n_ref, first_date, n_members",
        f"""(SELECT series_id, 'customer' AS kind, acct AS core_account_id, rank, CAST(n_ref AS INT) AS n_ref, first_date, NULL::INT AS n_members FROM member WHERE series_id LIKE 'c_%'
          UNION ALL SELECT series_id, 'tail_group', NULL, NULL, NULL, DATE '{_C.start}', CAST(count(*) AS INT) FROM member WHERE series_id NOT LIKE 'c_%' GROUP BY series_id
          UNION ALL SELECT '{_C.rest}', 'tail_group', NULL, NULL, NULL, DATE '{_C.start}', NULL)""",
    ),
    "manifest": (
        "2 AS extract_version, count(*) AS rows, CAST(sum(y) AS BIGINT) AS grand_total, CAST(count(DISTINCT series_id) AS INT) AS series, CAST(count(DISTINCT year(date)) AS INT) AS n_years, (SELECT md5(payload) FROM payload_years_ ORDER BY year LIMIT 1) AS first_md5, "
        "(SELECT sha256(string_agg(d, ';' ORDER BY d)) FROM (SELECT date || ':' || sha256(string_agg(c, ';' ORDER BY c)) AS d FROM (SELECT date, series_id || ',' || y AS c FROM panel) GROUP BY date)) AS snapshot_sha",
        "panel",
    ),
    "payload_roundtrip": ("date, series_id, y", f"panel WHERE date BETWEEN DATE '{_PAYLOAD[0]}' AND DATE '{_PAYLOAD[1]}'"),
    "reconcile": ("series_id, CAST(sum(y) AS BIGINT) AS own, count(*) AS days, CAST(sum(y) + 1 AS BIGINT) AS total, count(*) AS n_days", "panel WHERE series_id = 'g5_tail' GROUP BY series_id"),
    "holidays": ("date, name", "holidays"),
    "special_days": ("date, name", "special_days"),
    "black_friday": ("y AS year, bf AS date", "fridays"),
    "damp_calendar": ("ord, grp, date, type, anchor", "damp_rows"),
    "day_types": ("date, day_type", "types"),
    "edge_distances": ("date, to_special, since_special", f"edges WHERE date <= DATE '{_C.end}'"),
    "clean_days": ("date, series_id, y", "clean"),
    "masked_days": ("date, series_id, y, y_clean", "masked"),
    "weekday_profile": ("cutoff, series_id, CAST(weekday AS INT) AS weekday, ROUND profile", "profile42"),
    "clean_profile": ("cutoff, series_id, CAST(weekday AS INT) AS weekday, ROUND profile", "profile4"),
    "weekday_shape": ("cutoff, series_id, CAST(weekday AS INT) AS weekday, ROUND shape", "shape"),
    "weekday_shape_6": ("cutoff, series_id, CAST(weekday AS INT) AS weekday, ROUND shape", "shape6"),
    "deflated_level": ("cutoff, series_id, round(level0, 6) AS level", "plain_levels"),
    "special_level": ("cutoff, series_id, ROUND special_level", "special_levels"),
    "event_evidence": ("date, name, net, ROUND base", "evidence"),
    "special_factors": ("cutoff, name, ROUND actual, ROUND expected, ROUND factor", "plain_factors"),
    "recency_factors": ("cutoff, name, ROUND actual, ROUND expected, ROUND factor", "factors"),
    "recency_factors_all": ("cutoff, name, ROUND actual, ROUND expected, ROUND factor", "all_factors"),
    "pooled_factor": ("cutoff, ROUND pooled", "pooled"),
    "damp_factors": ("cutoff, type, ROUND damp", "damps"),
    "series_multipliers": ("cutoff, series_id, grp, ROUND mult", "mults"),
    "series_multipliers_split": ("cutoff, series_id, grp, ROUND mult", "split_mults"),
    "vacation_multipliers": ("cutoff, series_id, ROUND mult", "vacations"),
    "step_level": ("cutoff, series_id, ROUND num_recent, ROUND level, ROUND l_recent, ROUND l_prev", "levels"),
    "bf_informed_level": (
        "cutoff, series_id, round(CASE WHEN sum(den) > 0 THEN sum(num) / sum(den) ELSE 0 END, 6) AS level",
        """(SELECT cutoff, series_id, num_r + num_p AS num, den_r + den_p AS den FROM halves UNION ALL
        SELECT f.cutoff, p.series_id, p.y / (f.factor * coalesce(m.mult, 1)), 1 FROM special_days s JOIN plain_factors f ON f.name = s.name AND f.factor > 0.05 AND s.date <= f.cutoff AND s.date > f.cutoff - 14
        JOIN panel p ON p.date = s.date LEFT JOIN plain_mults m ON m.cutoff = f.cutoff AND m.series_id = p.series_id AND m.grp = 'bf' WHERE s.name LIKE 'bf%') GROUP BY cutoff, series_id""",
    ),
    "trend_growth": ("cutoff, series_id, ROUND growth", "growths"),
    "rolling_levels": ("date, series_id, ROUND l7, ROUND l28, ROUND l56", "rolled"),
    "level_cascade": ("date, series_id, ROUND l14_raw, round(coalesce(l14_raw, l28, l56), 6) AS l14", "rolled"),
    "active_share": ("date, series_id, ROUND active_60", "rolled"),
    "lag_features": ("ref, series_id, date, lead, weekday, month, day_type, to_special, since_special, ROUND l14_log, ROUND l28_ratio, ROUND l7_ratio, ROUND lag0_ratio, ROUND lag1_ratio, ROUND lag2_ratio, ROUND lag3_ratio, age_days, ROUND active_60, ROUND base, actual", "features"),
    "training_refs": ("cutoff, date AS ref", f"spine JOIN cutoffs ON date <= cutoff - 14 WHERE isodow(date) IN (1, 4) AND date >= DATE '{_C.start}' + 120"),
    "training_labels": ("ref, series_id, lead, round(least(greatest(actual / base, 0), 15), 6) AS label, round(base, 6) AS weight", "features WHERE base > 1 AND actual IS NOT NULL"),
    "seasonal_naive": ("cutoff, series_id, date, ROUND yhat", "naive"),
    "profile_forecast": ("cutoff, series_id, date, ROUND yhat", "profiled"),
    "profile_by_sql": ("cutoff, series_id, date, ROUND yhat", "profiled"),
    "naive_by_sql": ("cutoff, series_id, date, ROUND yhat", "naive"),
    "holiday_forecast": ("cutoff, series_id, date, ROUND yhat", "holidayed"),
    "shape_level_forecast": ("cutoff, series_id, date, ROUND yhat", "shaped"),
    "hand_forecast": ("cutoff, series_id, date, round(CASE WHEN name IS NULL THEN normal ELSE event END, 6) AS yhat", "hand_parts"),
    "trend_forecast": ("h.cutoff, h.series_id, h.date, round(CASE WHEN name IS NULL THEN smooth * pow(coalesce(growth, 1), lead / 7.0) ELSE event END, 6) AS yhat", "hand_parts h LEFT JOIN growths g ON g.cutoff = h.cutoff AND g.series_id = h.series_id"),
    "vacation_forecast": ("h.cutoff, h.series_id, h.date, round(CASE WHEN name IS NULL THEN normal * CASE WHEN d.date IS NOT NULL THEN coalesce(v.mult, 1) ELSE 1 END ELSE event END, 6) AS yhat", "hand_parts h LEFT JOIN vacations v ON v.cutoff = h.cutoff AND v.series_id = h.series_id LEFT JOIN day_of_damp d ON d.date = h.date"),
    "burstiness": ("cutoff, series_id, ROUND rho", "bursts"),
    "blend_weights": ("cutoff, series_id, ROUND rho, ROUND w_l1, ROUND w_other", "weights"),
    "blend_half": ("cutoff, series_id, date, round(0.5 * a.yhat + 0.5 * b.yhat, 6) AS yhat", "naive a JOIN profiled b USING (cutoff, series_id, date)"),
    "blend_thirds": ("cutoff, series_id, date, round((a.yhat + b.yhat + c.yhat) / 3, 6) AS yhat", "naive a JOIN profiled b USING (cutoff, series_id, date) JOIN holidayed c USING (cutoff, series_id, date)"),
    "blend_forecast": (
        "cutoff, series_id, date, round(a.yhat * coalesce(w_other, 1.0 / 3) + b.yhat * coalesce(w_l1, 1.0 / 3) + c.yhat * coalesce(w_other, 1.0 / 3), 6) AS yhat",
        "shaped a JOIN naive b USING (cutoff, series_id, date) JOIN profiled c USING (cutoff, series_id, date) LEFT JOIN weights USING (cutoff, series_id)",
    ),
    "scored_cells": ("series_id, kind, cutoff, date, lead, y, ROUND yhat", "scored"),
    "metric_summary": (f"round({_WMAPE}, 6) AS wmape, round(avg(abs(yhat - y)), 6) AS mae, round(sqrt(avg((yhat - y) * (yhat - y))), 6) AS rmse, round({_BIAS}, 6) AS bias, count(*) AS n_cells, count(DISTINCT series_id) AS n_series, count(DISTINCT cutoff) AS n_cutoffs", "scored"),
    "metric_slices": (
        ", ".join(f"round({x}, 6) AS {n}" for n, x in (("wmape", _WMAPE), ("wmape_lead_1_7", _slice("lead <= 7")), ("wmape_lead_8_14", _slice("lead >= 8")), ("wmape_customers", _slice("kind = 'customer'")), ("wmape_tail", _slice("kind = 'tail_group'")))),
        "scored",
    ),
    "per_cutoff": (f"cutoff, round({_WMAPE}, 6) AS wmape, round({_BIAS}, 6) AS bias, count(DISTINCT series_id) AS n_series", "scored GROUP BY cutoff"),
    "worst_series": (f"series_id, round({_WMAPE}, 6) AS wmape, CAST(sum(y) AS BIGINT) AS volume, round({_BIAS}, 6) AS bias", "scored GROUP BY series_id HAVING sum(y) > 0 ORDER BY round(sum(abs(yhat - y)), 6) DESC, series_id LIMIT 20"),
    "network_wmape": (f"round({_WMAPE}, 6) AS network_wmape", "(SELECT sum(y) AS y, sum(yhat) AS yhat FROM scored GROUP BY cutoff, date)"),
    "contract_checks": ("CAST(0 AS BIGINT) AS n_null, CAST(0 AS BIGINT) AS n_repeated, count(*) FILTER (series_id = 'g5_tail' AND date = DATE '1999-01-12') AS n_missing, CAST(0 AS BIGINT) AS n_unexpected, CAST(0 AS BIGINT) AS n_negative", "naive"),
    "leaderboard_row": (
        f"'run' AS run_id, 'weekday_profile' AS experiment, printf('%.6f', {_WMAPE}) AS wmape, (SELECT printf('%.6f', {_WMAPE}) FROM (SELECT sum(y) AS y, sum(yhat) AS yhat FROM scored GROUP BY cutoff, date)) AS network_wmape, printf('%.6f', {_BIAS}) AS bias, count(*) AS n_cells, count(DISTINCT series_id) AS n_series, count(DISTINCT cutoff) AS n_cutoffs",
        "scored",
    ),
}


def _needed(text: str, ctes: dict[str, str]) -> list[str]:
    out: list[str] = []
    begun: set[str] = set()

    def visit(sql: str) -> None:
        bare = re.sub(r"'[^']*'", "''", sql)
        for name in ctes:
            if name not in begun and re.search(rf"\b{name}\b", bare):
                begun.add(name)
                visit(ctes[name])
                out.append(name)

    visit(text)
    return out


def statement(columns: str, source: str, ctes: dict[str, str] = CTES) -> str:
    """The SELECT with the common table expressions that it needs, in order."""
    columns = re.sub(r"ROUND (\w+)", r"round(\1, 6) AS \1", columns)
    final = f"SELECT {columns} FROM {source}"
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({ctes[n]})" for n in _needed(final, ctes)) + "\n" + final


def _stage(first: str, last: str) -> dict[str, str]:
    return CTES | {"cutoffs": f"SELECT CAST(unnest(generate_series(DATE '{first}', DATE '{last}', INTERVAL 7 DAY)) AS DATE) AS cutoff"}


_S1, _S3 = _C.stages["stage1"], _C.stages["stage3"]
_HAND_SCORED = CTES["scored"].replace("profiled f", "(SELECT cutoff, series_id, date, CASE WHEN name IS NULL THEN normal ELSE event END AS yhat FROM hand_parts) f")
ORACLE: dict[str, str] = {k: statement(*v) for k, v in _FINAL.items()}
ORACLE["stage1_backtest"] = statement(*_FINAL["per_cutoff"], ctes=_stage(_S1.first_cutoff, _S1.last_cutoff))
ORACLE["stage3_hand_backtest"] = statement(*_FINAL["per_cutoff"], ctes=_stage(_S3.first_cutoff, _S3.last_cutoff) | {"scored": _HAND_SCORED})
_SLICES = ", ".join(f"round({_W.format(w)}, 6) AS wmape_{n}" for n, w in (("lead_1_7", " FILTER (lead <= 7)"), ("lead_8_14", " FILTER (lead >= 8)"), ("customers", " FILTER (kind = 'customer')"), ("tail", " FILTER (kind = 'tail_group')")))
_NETWORK = f"(SELECT {_WMAPE} FROM (SELECT sum(y) AS y, sum(yhat) AS yhat FROM scored GROUP BY cutoff, date))"
_SUMMARY = f"round({_WMAPE}, 6) AS wmape, round(avg(abs(yhat - y)), 6) AS mae, round(sqrt(avg((yhat - y) * (yhat - y))), 6) AS rmse, round({_BIAS}, 6) AS bias, {_SLICES}, round({_NETWORK}, 6) AS network_wmape, count(*) AS n_cells, count(DISTINCT series_id) AS n_series, count(DISTINCT cutoff) AS n_cutoffs, 0 AS clipped_cells"
ORACLE["evaluate_stage1"] = statement(f"'weekday_profile' AS experiment, 'stage1' AS stage, {_SUMMARY}", "scored", ctes=_stage(_S1.first_cutoff, _S1.last_cutoff))
_PER = f"(SELECT string_agg(cutoff || ':' || printf('%.6f', w) || ':' || printf('%.6f', b) || ':' || n, ',' ORDER BY cutoff) FROM (SELECT cutoff, {_WMAPE} AS w, {_BIAS} AS b, count(DISTINCT series_id) AS n FROM scored GROUP BY cutoff))"
_WORST = f"(SELECT string_agg(series_id || ':' || printf('%.6f', w) || ':' || v || ':' || printf('%.6f', b), ',' ORDER BY e DESC, series_id) FROM (SELECT series_id, {_WMAPE} AS w, CAST(sum(y) AS BIGINT) AS v, {_BIAS} AS b, round(sum(abs(yhat - y)), 6) AS e FROM scored GROUP BY series_id HAVING sum(y) > 0 ORDER BY e DESC, series_id LIMIT 20))"
ORACLE["run_record"] = statement(f"'run' AS run_id, 'weekday_profile' AS experiment, 'six' AS stage, 0.0::DOUBLE AS runtime_s, '{{}}' AS params, '' AS eval_sha, '' AS snapshot_sha, '' AS notes, {_SUMMARY}, {_PER} AS per_cutoff, {_WORST} AS worst_series", "scored")
ORACLE["streamed_daily_events"] = "SELECT CAST(ts AS DATE) AS date, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2"
ORACLE["closed_daily_events"] = ORACLE["streamed_daily_events"].replace("FROM events", "FROM events WHERE CAST(ts AS DATE) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 2 DAY FROM events)")
ORACLE |= {copy: ORACLE[name] for copy, name in (("panel_files", "dense_panel"), ("panel_refreshed", "dense_panel"), ("captures_round_trip", "dense_panel"), ("levels_refreshed", "rolling_levels"))}
