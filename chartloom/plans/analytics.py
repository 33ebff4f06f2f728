"""Queries on history, comparison, coverage, scores and quality of charts."""

from __future__ import annotations

from pyspark.sql import functions as F

from chartloom.operators import aggregates as agg
from chartloom.operators import analytics as an
from chartloom.operators import joins, quality
from chartloom.plans.registry import EXTRA_VIEWS, query
from chartloom.plans.text import styled

EXTRA_VIEWS |= {
    "fv_rank": """SELECT run_id, chart_id, period, lower(trim(artist_raw)) AS artist_key, lower(trim(title_raw)) AS title_key, max(rank) AS rank FROM fv_entry GROUP BY ALL""",
    "fv_seq": """SELECT *, lag(period) OVER w AS previous_period, lead(period) OVER w AS next_period, lag(run_id) OVER w AS previous_run_id, lead(run_id) OVER w AS next_run_id
  FROM fv_run WINDOW w AS (PARTITION BY chart_id ORDER BY period)""",
    "fv_compared": """SELECT coalesce(a.chart_id, b.chart_id) AS chart_id, coalesce(a.period1, b.period1) AS period1, coalesce(a.period2, b.period2) AS period2,
    coalesce(a.artist_key, b.artist_key) AS artist_key, coalesce(a.title_key, b.title_key) AS title_key, rank1, rank2
  FROM (SELECT r.chart_id, r.period AS period1, s.next_period AS period2, artist_key, title_key, rank AS rank1 FROM fv_rank r JOIN fv_seq s USING (run_id) WHERE next_run_id IS NOT NULL) a
  FULL JOIN (SELECT r.chart_id, s.previous_period AS period1, r.period AS period2, artist_key, title_key, rank AS rank2 FROM fv_rank r JOIN fv_seq s USING (run_id) WHERE previous_run_id IS NOT NULL) b
  ON a.chart_id = b.chart_id AND a.period1 = b.period1 AND a.artist_key = b.artist_key AND a.title_key = b.title_key""",
}


def compared(v):
    return an.compare_consecutive(v.entry, v.run)


@query("""SELECT * EXCLUDE (d)
  FROM (SELECT chart_id, period1, period2, artist_key, title_key, rank1, rank2, rank1 - rank2 AS delta, abs(rank1 - rank2) AS d, CAST(row_number() OVER (PARTITION BY chart_id, period1,
    period2 ORDER BY abs(rank1 - rank2) DESC, artist_key, title_key) AS INTEGER) AS place FROM fv_compared
  WHERE rank1 IS NOT NULL AND rank2 IS NOT NULL AND rank1 <> rank2) WHERE place <= 10""")
def biggest_movers(v):
    return an.movers(compared(v))


@query("SELECT * FROM fv_compared")
def all_pairs_compare(v):
    return compared(v)


@query("SELECT * FROM fv_compared WHERE rank1 IS NOT NULL AND rank2 IS NOT NULL")
def compare_common(v):
    return an.common(compared(v))


@query("SELECT * EXCLUDE (rank2) FROM fv_compared WHERE rank2 IS NULL")
def compare_only_in(v):
    return an.only_in_first(compared(v))


@query("SELECT chart_id, period2 AS period, artist_key, title_key, rank2 AS rank FROM fv_compared WHERE rank1 IS NULL")
def new_entries(v):
    return an.only_in_second(compared(v)).select("chart_id", F.col("period2").alias("period"), *an.KEY, F.col("rank2").alias("rank"))


@query("SELECT chart_id, period2 AS period, artist_key, title_key, rank1 AS last_rank FROM fv_compared WHERE rank2 IS NULL")
def dropped_entries(v):
    return an.only_in_first(compared(v)).select("chart_id", F.col("period2").alias("period"), *an.KEY, F.col("rank1").alias("last_rank"))


@query("""SELECT chart_id, period1, period2, count(*) FILTER (rank1 IS NOT NULL AND rank2 IS NOT NULL) AS n_common, count(*) AS n_union,
    round(count(*) FILTER (rank1 IS NOT NULL AND rank2 IS NOT NULL) * 100.0 / count(*), 6) AS overlap_pct FROM fv_compared GROUP BY 1, 2, 3""")
def overlap_pct(v):
    return an.overlap(compared(v))


@query("SELECT chart_id, period, previous_period, next_period FROM fv_seq")
def adjacent_period(v):
    return an.run_sequence(v.run).select("chart_id", "period", "previous_period", "next_period")


@query("""SELECT a.chart_id, a.period, max(r.period) AS previous_period FROM (SELECT DISTINCT chart_id, substr(period, 1, 4) || '-06-15' AS period
  FROM fv_run) a LEFT JOIN fv_run r ON r.chart_id = a.chart_id AND r.period < a.period GROUP BY 1, 2""")
def period_as_of(v):
    asked = v.run.select("chart_id", F.concat(F.substring("period", 1, 4), F.lit("-06-15")).alias("period")).distinct()
    return an.period_as_of(asked, v.run)


@query("""SELECT e.run_id, e.rank, e.previous_position AS claimed, b.rank AS actual FROM fv_entry e JOIN fv_seq s USING (run_id)
  JOIN fv_rank b ON b.run_id = s.previous_run_id AND b.artist_key = lower(trim(e.artist_raw)) AND b.title_key = lower(trim(e.title_raw))
  WHERE e.previous_position <> b.rank""")
def position_xref(v):
    return an.position_mismatches(v.entry, v.run).select("run_id", "rank", F.col("previous_position").alias("claimed"), "actual")


@query("""SELECT *, CASE WHEN delta IS NULL THEN 'new' WHEN delta > 0 THEN 'up' WHEN delta < 0 THEN 'down' ELSE 'same' END AS direction
  FROM (SELECT *, lag(rank) OVER (PARTITION BY chart_id, artist_key, title_key ORDER BY period) - rank AS delta FROM fv_rank)""")
def history_delta(v):
    return an.derived_delta(v.entry_once)


@query("""SELECT entry_id, previous_position - rank AS delta,
    CASE WHEN previous_position IS NULL THEN 'new' WHEN previous_position > rank THEN 'up' WHEN previous_position < rank THEN 'down' ELSE 'same' END AS direction
  FROM fv_entry""")
def history_claimed_delta(v):
    return an.claimed_delta(v.entry_once).select("entry_id", "delta", "direction")


HISTORY = """SELECT s.song_id, e.chart_id, c.name AS chart_name, e.period, e.rank, e.entry_id FROM fv_song s JOIN fv_entry_song l USING (song_id)
  JOIN fv_entry e USING (entry_id) JOIN fv_run r USING (run_id) JOIN fv_chart c ON c.chart_id = r.chart_id"""


@query(HISTORY)
def chart_history(v):
    return joins.chart_history(v.song, v.entry_song, v.entry, v.run, v.chart)


@query(f"SELECT h.*, s.artist_canonical, s.title_canonical, s.recording_mbid FROM ({HISTORY}) h JOIN fv_song s USING (song_id) WHERE recording_mbid IS NOT NULL")
def chart_history_by_mbid(v):
    songs = v.song.filter("recording_mbid is not null")
    return joins.chart_history(songs, v.entry_song, v.entry, v.run, v.chart).join(songs, "song_id")


@query("SELECT entry_id, song_idx, song_id, artist_canonical, title_canonical FROM fv_entry_song JOIN fv_song USING (song_id)")
def songs_for_entry(v):
    return v.entry_song.join(v.song, "song_id").select("entry_id", "song_idx", "song_id", "artist_canonical", "title_canonical")


@query("SELECT entry_id, run_id, rank FROM fv_entry WHERE entry_id NOT IN (SELECT entry_id FROM fv_entry_song)")
def unlinked_entries(v):
    return v.entry.join(v.entry_song, "entry_id", "left_anti").select("entry_id", "run_id", "rank")


@query("""SELECT e.entry_id, l.work_key, l.confidence, CASE WHEN l.confidence IS NULL THEN 'no_link' WHEN l.work_key IS NULL THEN 'bundle_unresolved' ELSE 'low_confidence' END AS reason
  FROM fv_entry e LEFT JOIN fv_link l USING (run_id, rank) WHERE l.work_key IS NULL OR l.confidence < 0.6""")
def missing_from_chart(v):
    return joins.missing_entries(v.entry, v.link).withColumn("reason", F.when(F.col("confidence").isNull(), "no_link").when(F.col("work_key").isNull(), "bundle_unresolved").otherwise("low_confidence"))


@query("SELECT e.entry_id, l.work_key, l.confidence FROM fv_entry e LEFT JOIN fv_link l USING (run_id, rank) WHERE l.work_key IS NULL OR l.confidence < 0.6")
def missing_entries(v):
    return joins.missing_entries(v.entry, v.link)


@query("SELECT e.entry_id FROM fv_entry e LEFT JOIN fv_link l USING (run_id, rank) WHERE l.confidence IS NULL OR l.confidence < 0.85")
def missing_only(v):
    joined = v.entry.select("entry_id", "run_id", "rank").join(v.link.select("run_id", "rank", "confidence"), ["run_id", "rank"], "left")
    return joined.filter("confidence is null or confidence < 0.85").select("entry_id")


@query("SELECT e.entry_id, l.song_id, s.title_canonical FROM fv_entry e LEFT JOIN fv_entry_song l ON l.entry_id = e.entry_id AND l.song_idx = 0 LEFT JOIN fv_song s USING (song_id)")
def entries_with_songs(v):
    return joins.entries_with_songs(v.entry, v.entry_song, v.song)


@query("SELECT * FROM fv_entry WHERE rank BETWEEN 5 AND 10")
def rank_range(v):
    return joins.rank_range(v.entry_once, 5, 10)


@query("SELECT chart_id || ':' || period AS ref, run_id, chart_id, period FROM fv_run UNION ALL SELECT run_id, run_id, chart_id, period FROM fv_run")
def resolve_run_ref(v):
    refs = v.run.select(F.col("run_id").alias("ref")).unionByName(v.run.select(F.concat_ws(":", "chart_id", "period").alias("ref")))
    return joins.resolve_run_refs(refs, v.run)


@query("SELECT run_id, chart_id, period FROM fv_run WHERE run_id IN (SELECT run_id FROM fv_link WHERE confidence > 0.98)")
def get_by_key(v):
    return joins.by_keys(v.run, v.link.filter("confidence > 0.98"), ["run_id"])


@query("SELECT chart_id, period, CAST(row_number() OVER (PARTITION BY chart_id ORDER BY period DESC) AS INTEGER) AS place FROM fv_run")
def list_sorted(v):
    return joins.numbered(v.run, ["chart_id"], [F.desc("period")]).select("chart_id", "period", "place")


COVERAGE = """SELECT e.run_id, e.chart_id, e.period, count(*) AS total, count(work_key) AS linked, count(*) - count(work_key) AS unlinked, round(count(work_key) * 100.0 / count(*), 6) AS coverage_pct
  FROM fv_entry e LEFT JOIN fv_link l USING (run_id, rank) GROUP BY 1, 2, 3"""


@query(COVERAGE)
def coverage_report(v):
    return agg.coverage(v.entry, v.link)


@query(f"""SELECT chart_id, period, CAST(sum(total) AS BIGINT) AS total, CAST(sum(linked) AS BIGINT) AS linked, round(sum(linked) * 100.0 / sum(total), 6) AS coverage_pct
  FROM ({COVERAGE}) GROUP BY ROLLUP (chart_id, period)""")
def coverage_all_periods(v):
    return agg.coverage_totals(v.entry, v.link)


@query("SELECT run_id, link_method, count(*) AS n FROM fv_link WHERE work_key IS NOT NULL GROUP BY 1, 2")
def coverage_by_method(v):
    return agg.coverage_by_method(v.link)


@query("SELECT run_id, CASE WHEN confidence >= 0.85 THEN 'auto' WHEN confidence >= 0.6 THEN 'review' ELSE 'reject' END AS band, count(*) AS n FROM fv_link GROUP BY 1, 2")
def coverage_by_confidence(v):
    return agg.coverage_by_confidence(v.link)


SCORED = "(SELECT *, count(*) OVER (PARTITION BY run_id) - rank + 1 AS score FROM fv_entry)"


ENTRY_SCORES = """SELECT chart_id, artist_core, title_core, CAST(sum(score) AS BIGINT) AS score FROM (SELECT *, count(*) OVER (PARTITION BY run_id) - rank + 1 AS score FROM fv_styled)
WHERE artist_core <> '' AND title_core <> '' GROUP BY 1, 2, 3"""


@query(ENTRY_SCORES)
def entry_scores(v):
    return agg.entry_scores(styled(v))


WORK_SCORE = f"""SELECT work_key, e.chart_id, CAST(sum(score) AS BIGINT) AS score, min(rank) AS highest, count(*) AS n_entries FROM {SCORED} e
  JOIN fv_link l USING (run_id, rank) WHERE confidence >= 0.6 AND work_key IS NOT NULL GROUP BY 1, 2"""


@query(WORK_SCORE)
def work_chart_score(v):
    return agg.work_chart_score(v.entry, v.link)


POSITIONS = """SELECT work_key, chart_id, '{' || string_agg('"' || period || '":' || rank, ',' ORDER BY period) || '}' AS positions
FROM (SELECT work_key, chart_id, period, max(rank) AS rank FROM fv_link WHERE confidence >= 0.6 AND work_key IS NOT NULL GROUP BY 1, 2, 3) GROUP BY 1, 2"""


@query(POSITIONS)
def work_chart_positions(v):
    return agg.work_chart_positions(v.link)


#: The links as those of weekly, yearly and monthly charts, and a few periods of the weekly ones that are no weeks.
EXTRA_VIEWS["fv_frequency"] = "SELECT chart_id, CASE WHEN length(chart_id) % 3 = 0 THEN 'w' WHEN length(chart_id) % 3 = 1 THEN 'y' ELSE 'm' END AS frequency FROM fv_chart WHERE chart_id <> 'building'"
EXTRA_VIEWS["fv_weekly"] = """SELECT work_key, chart_id, CASE WHEN length(chart_id) % 3 = 0 AND partkey % 23 <> 0 THEN period[1:4] || '-W' || lpad(CAST(4 * CAST(period[6:7] AS INTEGER) + partkey % 4 AS VARCHAR), 2, '0') ELSE period END AS period,
    rank, confidence FROM fv_link"""


def frequencies(v):
    kind = F.length("chart_id") % 3
    return v.chart.filter("chart_id <> 'building'").select("chart_id", F.when(kind == 0, "w").when(kind == 1, "y").otherwise("m").alias("frequency"))


def weekly(v):
    week = F.format_string("%s-W%02d", F.substring("period", 1, 4), (4 * F.substring("period", 6, 2).cast("int") + F.col("partkey") % 4).cast("int"))
    return v.link.select("work_key", "chart_id", F.when((F.length("chart_id") % 3 == 0) & (F.col("partkey") % 23 != 0), week).otherwise(F.col("period")).alias("period"), "rank", "confidence")


NESTED = """SELECT work_key, chart_id, '{' || string_agg('"' || outer_key || '":' || value, ',' ORDER BY outer_key) || '}' AS positions FROM (
  SELECT work_key, chart_id, outer_key, CASE WHEN any_value(week) IS NULL THEN CAST(max(rank) AS VARCHAR) ELSE '{' || string_agg('"' || week || '":' || rank, ',' ORDER BY week) || '}' END AS value FROM (
    SELECT work_key, chart_id, outer_key, week, rank FROM (SELECT *, row_number() OVER (PARTITION BY work_key, chart_id, outer_key, week ORDER BY period DESC, rank DESC) AS n FROM (
      SELECT l.*, CASE WHEN f.frequency = 'w' THEN split_part(period, '-W', 1) WHEN coalesce(f.frequency, 'y') = 'y' THEN split_part(period, '-', 1) ELSE period END AS outer_key, CASE WHEN f.frequency = 'w' THEN split_part(period, '-W', 2) END AS week
      FROM fv_weekly l LEFT JOIN fv_frequency f USING (chart_id) WHERE confidence >= 0.6 AND work_key IS NOT NULL AND (coalesce(f.frequency, 'y') <> 'w' OR contains(period, '-W')))) WHERE n = 1) GROUP BY 1, 2, 3) GROUP BY 1, 2"""


@query(NESTED)
def work_chart_positions_nested(v):
    return agg.work_chart_positions(weekly(v), charts=frequencies(v))


@query("""SELECT run_id, count(*) AS total, count(l.entry_id) AS linked, count(*) FILTER (recording_mbid IS NOT NULL) AS with_recording, round(count(l.entry_id) * 100.0 / count(*),
    1) AS linked_pct, round(count(*) FILTER (recording_mbid IS NOT NULL) * 100.0 / count(*), 1) AS recording_pct FROM fv_entry e
  LEFT JOIN fv_entry_song l USING (entry_id) LEFT JOIN fv_song USING (song_id) GROUP BY 1""")
def linked_stats(v):
    return agg.linked_stats(v.entry, v.entry_song, v.song)


MISSING = """SELECT chart_id, entry_id, e.run_id, e.rank,
    CASE WHEN l.confidence IS NULL THEN 'no_link' WHEN l.work_key IS NULL THEN 'bundle_unresolved' WHEN l.confidence < 0.6 THEN 'low_confidence' END AS reason
  FROM (SELECT entry_id, run_id, rank, chart_id FROM fv_entry) e LEFT JOIN (SELECT run_id, rank, work_key, confidence
  FROM fv_link) l USING (run_id, rank)"""


@query(f"""SELECT chart_id, reason, n, place, entry_id
  FROM (SELECT *, count(*) OVER (PARTITION BY chart_id, reason) AS n, CAST(row_number() OVER (PARTITION BY chart_id, reason ORDER BY run_id, rank) AS INTEGER) AS place
  FROM ({MISSING}) WHERE reason IS NOT NULL) WHERE place <= 10""")
def missing_reasons(v):
    return agg.missing_reasons(v.entry, v.link)


#: Works owned. The catalogue has another view of this name, files by entry.
OWNED = {"fv_owned": "SELECT DISTINCT substr(sha256(lower(p_brand) || ' // ' || lower(p_name)), 1, 16) AS work_key FROM part WHERE p_partkey % 3 = 0"}


def owned(v):
    from chartloom.functions.ids import short_hash

    return v.table("part").filter("p_partkey % 3 = 0").select(short_hash(F.concat_ws(" // ", F.lower("p_brand"), F.lower("p_name"))).alias("work_key")).distinct()


@query("""SELECT run_id, count(*) AS total, round(count(work_key) * 100.0 / count(*), 6) AS linked_pct, round(count(o.work_key2) * 100.0 / count(*), 6) AS library_pct
  FROM fv_entry e LEFT JOIN fv_link l USING (run_id, rank) LEFT JOIN (SELECT work_key AS work_key2 FROM fv_owned) o ON o.work_key2 = l.work_key
  GROUP BY 1""", views=OWNED)
def coverage_summary(v):
    return agg.coverage_summary(v.entry, v.link, owned(v))


@query(f"SELECT * FROM ({WORK_SCORE}) WHERE work_key NOT IN (SELECT work_key FROM fv_owned)", views=OWNED)
def missing_in_library(v):
    return agg.work_chart_score(v.entry, v.link).join(owned(v), "work_key", "left_anti")


EXTRA_VIEWS["fv_expected"] = "SELECT chart_id, 20 * length(chart_id) AS expected FROM fv_chart WHERE chart_id <> 'building'"


@query("""SELECT run_id, n_ranks, CAST(expected AS INTEGER) AS expected, CASE WHEN expected IS NOT NULL THEN greatest(0, expected - n_ranks) END AS shortage, n_ranks > 0 AND (expected IS NULL OR n_ranks >= CAST(trunc(expected * 0.9) AS INTEGER)) AS ok
  FROM (SELECT run_id, chart_id, count(DISTINCT rank) AS n_ranks FROM fv_entry GROUP BY 1, 2) LEFT JOIN fv_expected USING (chart_id)""")
def count_sanity(v):
    expected = v.chart.filter("chart_id <> 'building'").select("chart_id", (20 * F.length("chart_id")).alias("expected"))
    return quality.count_sanity(v.entry_once, expected)


@query("""SELECT r.run_id, r.chart_id, r.period, coalesce(overlap, 1.0) AS overlap, coalesce(overlap, 1.0) >= 0.5 AS ok FROM fv_run r
  LEFT JOIN (SELECT s.run_id, round(count(c.run_id) / count(*), 6) AS overlap FROM fv_seq s JOIN (SELECT DISTINCT run_id, artist_key, title_key
  FROM fv_rank) p ON p.run_id = s.previous_run_id LEFT JOIN (SELECT DISTINCT run_id, artist_key, title_key
  FROM fv_rank) c ON c.run_id = s.run_id AND c.artist_key = p.artist_key AND c.title_key = p.title_key GROUP BY 1) x USING (run_id)""")
def continuity_overlap(v):
    return an.continuity(v.entry, v.run)


EXTRA_VIEWS["fv_dirty"] = """SELECT run_id, rank, artist_raw, CASE partkey % 7 WHEN 1 THEN '<b>' || title_raw WHEN 2 THEN repeat(title_raw, 30) WHEN 3 THEN 'a/b/c/d/e/f/g' WHEN 4 THEN CAST(1000 + partkey AS VARCHAR) WHEN 5 THEN ' ' ELSE title_raw END AS title_raw, n
  FROM fv_entry CROSS JOIN (VALUES (1), (2)) t(n) WHERE n = 1 OR partkey % 10 = 0"""


def dirty(v):
    title = F.col("title_raw")
    key = F.col("partkey") % 7
    made = F.when(key == 1, F.concat(F.lit("<b>"), title)).when(key == 2, F.repeat(title, F.lit(30))).when(key == 3, "a/b/c/d/e/f/g").when(key == 4, (F.col("partkey") + 1000).cast("string")).when(key == 5, " ").otherwise(title)
    rows = v.entry.withColumn("title_raw", made)
    return rows.withColumn("n", F.lit(1)).unionByName(rows.filter("partkey % 10 = 0").withColumn("n", F.lit(2)))


@query("""SELECT run_id, issue, count(*) AS n FROM (
  SELECT run_id, unnest(list_filter([
    CASE WHEN regexp_matches(title_raw || artist_raw, '<[^>]+>') THEN 'html' END,
    CASE WHEN length(title_raw) > 200 THEN 'long_title' END,
    CASE WHEN length(artist_raw) > 150 THEN 'long_artist' END,
    CASE WHEN length(title_raw) - length(replace(title_raw, '/', '')) > 5 THEN 'slashes' END,
    CASE WHEN regexp_full_match(trim(title_raw), '[0-9]+') AND trim(title_raw) NOT IN ('1999', '1979', '505') THEN 'numeric_title' END,
    CASE WHEN trim(title_raw) = '' OR trim(artist_raw) = '' THEN 'empty' END,
    CASE WHEN row_number() OVER (PARTITION BY run_id, rank, artist_raw, title_raw ORDER BY n) > 1 THEN 'duplicate' END], lambda x: x IS NOT NULL)) AS issue
  FROM fv_dirty) GROUP BY 1, 2""")
def entry_issues(v):
    return quality.issue_counts(dirty(v))


@query("""SELECT run_id, CAST(g.rank AS INTEGER) AS rank FROM (SELECT run_id, unnest(range(1, max(rank) + 1)) AS rank FROM fv_link GROUP BY 1) g
  WHERE NOT EXISTS (SELECT 1 FROM fv_link e WHERE e.run_id = g.run_id AND e.rank = g.rank)""")
def rank_gaps(v):
    return quality.rank_gaps(v.link)


@query("SELECT run_id, CAST(CASE WHEN partkey % 19 = 0 THEN rank + 1 ELSE rank END AS INTEGER) AS rank, count(*) AS n FROM fv_link GROUP BY 1, 2 HAVING count(*) > 1")
def repeated_ranks(v):
    return quality.repeated_ranks(v.link.withColumn("rank", F.when(F.col("partkey") % 19 == 0, F.col("rank") + 1).otherwise(F.col("rank"))))


@query("SELECT run_id, chart_id, period FROM fv_run WHERE make_date(CAST(substr(period, 1, 4) AS INTEGER), 12, 25) <= DATE '1998-12-26'")
def future_edition_guard(v):
    return quality.available_editions(v.run, "1998-12-26")


@query("""SELECT 'entry_without_song' AS problem, count(*) AS n FROM fv_entry WHERE entry_id NOT IN (SELECT entry_id FROM fv_entry_song)
  UNION ALL SELECT 'link_without_song', count(*) FROM fv_entry_song WHERE song_id NOT IN (SELECT song_id FROM fv_song)
  UNION ALL SELECT 'repeated_song_in_run', count(*) FROM (SELECT 1 FROM fv_entry GROUP BY run_id, artist_raw, title_raw HAVING count(*) > 1)""")
def integrity_check(v):
    references = [("entry_without_song", v.entry, v.entry_song, ["entry_id"]), ("link_without_song", v.entry_song, v.song, ["song_id"])]
    return quality.integrity(references, [("repeated_song_in_run", v.entry, ["run_id", "artist_raw", "title_raw"])])
