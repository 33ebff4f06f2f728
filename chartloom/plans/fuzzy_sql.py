"""The fuzzy searches in DuckDB's SQL, from the published formulas and over all pairs of names."""

from __future__ import annotations


def lcs(pairs: str) -> str:
    """(a, b) -> (a, b, n): lengths of longest common subsequences, row by row of the usual table."""
    return f"""WITH RECURSIVE todo AS (SELECT DISTINCT a, b FROM ({pairs})),
  t AS (SELECT a, b, 0 AS i, list_transform(range(length(b) + 1), lambda x: 0) AS row FROM todo
    UNION ALL SELECT a, b, i + 1, list_reduce(range(1, length(b) + 1), lambda acc, j: list_append(acc, CASE WHEN b[j] = a[i + 1] THEN row[j] + 1 ELSE greatest(row[j + 1], acc[j]) END), [0]) FROM t WHERE i < length(a))
  SELECT a, b, row[length(b) + 1] AS n FROM t WHERE i = length(a)"""


def ratios(pairs: str) -> str:
    """(a, b) -> (a, b, ratio)."""
    return f"SELECT a, b, CASE WHEN a = b THEN 100.0 ELSE 200.0 * n / (length(a) + length(b)) END AS ratio FROM ({lcs(pairs)})"


def token_sets(pairs: str) -> str:
    """(a, b) -> (a, b, score): ratios of sets of words."""
    words = lambda x: f"list_distinct(list_filter(string_split({x}, ' '), lambda w: w <> ''))"
    line = lambda x: f"coalesce(array_to_string(list_sort({x}), ' '), '')"
    split = f"""SELECT a, b, len(x) AS nx, len(y) AS ny, {line("list_intersect(x, y)")} AS c, {line("list_filter(x, lambda w: NOT list_contains(y, w))")} AS ox, {line("list_filter(y, lambda w: NOT list_contains(x, w))")} AS oy
    FROM (SELECT a, b, {words("a")} AS x, {words("b")} AS y FROM ({pairs}))"""
    j = "(length(c) + CASE WHEN c <> '' THEN 1 ELSE 0 END)"
    both = f"100.0 * (1 - (length(ox) + length(oy) - 2 * n) / CAST(2 * {j} + length(ox) + length(oy) AS DOUBLE))"
    one = lambda o: f"100.0 * (1 - ({j} + length({o}) - length(c)) / CAST(length(c) + {j} + length({o}) AS DOUBLE))"
    return f"""SELECT s.a, s.b, CASE WHEN nx = 0 OR ny = 0 THEN 0.0 WHEN c <> '' AND (ox = '' OR oy = '') THEN 100.0 WHEN c = '' THEN {both} ELSE greatest({both}, {one("ox")}, {one("oy")}) END AS score
    FROM ({split}) s JOIN ({lcs(f"SELECT ox AS a, oy AS b FROM ({split})")}) l ON l.a = s.ox AND l.b = s.oy"""


def fits(tolerance: float) -> str:
    return f"(q.length_ms IS NULL OR r.length_ms BETWEEN CAST(trunc(q.length_ms * {1 - tolerance}) AS INTEGER) AND CAST(trunc(q.length_ms * {1 + tolerance}) AS INTEGER))"


def containing(source: str, tolerance: float = 0.1, limit: int = 50) -> str:
    """(query_id, recording_mbid) of recordings that contain the queries of a view."""
    return f"""SELECT query_id, recording_mbid FROM (SELECT query_id, recording_mbid, row_number() OVER (PARTITION BY query_id ORDER BY recording_mbid) AS n
  FROM {source} q JOIN fv_rec r ON contains(title_normalized, title) AND contains(artist_normalized, artist) AND {fits(tolerance)}) WHERE n <= {limit}"""


def search(source: str, tolerance: float = 0.1, limit: int = 50) -> str:
    """(query_id, recording_mbid, score, tier)."""
    first = containing(source, tolerance, limit)
    return f"""SELECT query_id, recording_mbid, CAST(100 AS DOUBLE) AS score, CAST(1 AS INTEGER) AS tier FROM ({first})
  UNION ALL SELECT query_id, recording_mbid, CAST(score AS DOUBLE), CAST(2 AS INTEGER) FROM (
    SELECT query_id, recording_mbid, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, recording_mbid) AS n
    FROM (SELECT q.query_id, r.recording_mbid, least(t.ratio, a.ratio) AS score FROM {source} q JOIN fv_title_ratio t ON t.a = q.title JOIN fv_rec r ON r.title_normalized = t.b JOIN fv_artist_ratio a ON a.a = q.artist AND a.b = r.artist_normalized
      WHERE t.ratio >= 80 AND a.ratio >= 80 AND {fits(tolerance)} AND q.query_id NOT IN (SELECT query_id FROM ({first})))) WHERE n <= {limit}"""


def browse(source: str) -> str:
    """(query_id, recording_mbid, title_normalized, title_score) of the catalogues of the queries' artists."""
    return f"""SELECT query_id, recording_mbid, title_normalized, title_score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY recording_mbid) AS place FROM (
    SELECT DISTINCT q.query_id, t.recording_mbid, t.title_normalized, round(s.score, 6) AS title_score
    FROM (SELECT * FROM (SELECT q.*, lower(name) AS name_lower, artist_mbid, row_number() OVER (PARTITION BY query_id ORDER BY name, artist_mbid) AS n FROM {source} q JOIN fv_band ON contains(lower(name), artist)) WHERE n <= 5) q
    JOIN fv_artist_set w ON w.a = q.artist AND w.b = q.name_lower AND w.score >= 60
    JOIN fv_band_group g ON g.artist_mbid = q.artist_mbid JOIN fv_track t ON t.rg_mbid = g.rg_mbid JOIN fv_title_set s ON s.a = q.title AND s.b = t.title_normalized AND round(s.score, 6) >= 70)) WHERE place <= 100"""


#: Views that these queries need, beside fv_query and fv_rec.
VIEWS = {
    "fv_title_ratio": ratios("SELECT DISTINCT q.title AS a, r.title_normalized AS b FROM fv_query q CROSS JOIN (SELECT DISTINCT title_normalized FROM fv_rec) r"),
    "fv_artist_ratio": ratios("SELECT DISTINCT q.artist AS a, r.artist_normalized AS b FROM (SELECT DISTINCT artist FROM fv_query) q CROSS JOIN (SELECT DISTINCT artist_normalized FROM fv_rec) r"),
    "fv_title_set": token_sets("SELECT DISTINCT q.title AS a, r.title_normalized AS b FROM fv_query q CROSS JOIN (SELECT DISTINCT title_normalized FROM fv_rec) r"),
    "fv_artist_set": token_sets("SELECT DISTINCT q.artist AS a, r.artist_normalized AS b FROM (SELECT DISTINCT artist FROM fv_query) q CROSS JOIN (SELECT DISTINCT artist_normalized FROM fv_rec) r"),
    "fv_found1": f"SELECT query_id, recording_mbid, 1 AS stage FROM ({search('fv_query', 0.1, 100)})",
    "fv_lacking1": "SELECT * FROM fv_query WHERE query_id NOT IN (SELECT query_id FROM fv_found1 GROUP BY 1 HAVING count(DISTINCT recording_mbid) >= 5)",
    "fv_found2": f"""SELECT * FROM fv_found1 UNION ALL SELECT f.query_id, f.recording_mbid, 2 FROM ({search('fv_lacking1', 0.2, 100)}) f JOIN fv_query q USING (query_id) JOIN fv_rec r USING (recording_mbid)
    JOIN fv_title_set t ON t.a = q.title AND t.b = r.title_normalized JOIN fv_artist_set s ON s.a = q.artist AND s.b = r.artist_normalized WHERE t.score >= 70 AND s.score >= 60""",
    "fv_lacking2": "SELECT * FROM fv_query WHERE query_id NOT IN (SELECT query_id FROM fv_found2 GROUP BY 1 HAVING count(DISTINCT recording_mbid) >= 5)",
    "fv_found3": f"SELECT * FROM fv_found2 UNION ALL SELECT query_id, recording_mbid, 3 FROM ({browse('fv_lacking2')})",
    "fv_lacking3": "SELECT * FROM fv_query WHERE query_id NOT IN (SELECT query_id FROM fv_found3 GROUP BY 1 HAVING count(DISTINCT recording_mbid) >= 5)",
    "fv_found4": "SELECT * FROM fv_found3 UNION ALL SELECT query_id, recording_mbid, 4 FROM fv_heard WHERE query_id IN (SELECT query_id FROM fv_lacking3)",
    "fv_stage": "SELECT query_id, recording_mbid, CAST(min(stage) AS INTEGER) AS stage FROM fv_found4 GROUP BY 1, 2",
}
