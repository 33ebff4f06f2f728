"""Queries on sources, the catalogue and search."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from chartloom.operators import catalogue as ct
from chartloom.operators import resolution as rs
from chartloom.operators import search
from chartloom.plans import fuzzy_sql
from chartloom.plans.registry import EXTRA_VIEWS, query
from chartloom.plans.views import by_blocks
from chartloom.sources import catalogue_docs as cd
from chartloom.sources import snapshots as sn
from chartloom.sources.shared import shared_folder

EXTRA_VIEWS |= {
    "fv_version": """SELECT page_id, url, 1000 + page_id % 50 AS cached_at, 1000 + page_id % 50 + CASE WHEN page_id % 3 = 0 THEN 10 ELSE 100 END AS expires_at, CASE WHEN page_id % 11 = 0 THEN 404 ELSE 200 END AS status
  FROM (SELECT page_id, split_part(url, '?', 1) AS url FROM pages)""",
    "fv_rec": "SELECT 'r' || p_partkey AS recording_mbid, lower(p_brand) AS artist_normalized, lower(p_name) AS title_normalized, p_size * 1000 AS length_ms FROM part",
    "fv_query": """SELECT song_id AS query_id, CASE WHEN song_id[15] < '3' THEN artist_canonical[1:2] || artist_canonical[4:] WHEN song_id[15] < '6' THEN artist_canonical[1:7] ELSE artist_canonical END AS artist,
    CASE WHEN song_id < '2' THEN title_canonical[1:2] WHEN song_id < '6' THEN title_canonical WHEN song_id < 'a' THEN title_canonical[3:] WHEN song_id < 'd' THEN split_part(title_canonical, ' ', 2) || ' ' || split_part(title_canonical, ' ', 1) ELSE title_canonical[1:2] || title_canonical[4:] END AS title,
    CASE WHEN song_id[16] < 'd' THEN length_ms END AS length_ms
  FROM fv_song JOIN (SELECT lower(p_brand) AS artist_canonical, lower(p_name) AS title_canonical, min(p_size) * 1000 AS length_ms FROM part GROUP BY 1, 2) USING (artist_canonical, title_canonical)""",
    "fv_band": "SELECT DISTINCT lower(p_brand) AS artist_mbid, p_brand AS name FROM part",
    "fv_band_group": "SELECT DISTINCT lower(p_brand) AS artist_mbid, p_brand || '/' || p_size // 10 AS rg_mbid FROM part",
    "fv_track": "SELECT p_brand || '/' || p_size // 10 AS rg_mbid, 'r' || p_partkey AS recording_mbid, lower(p_name) AS title_normalized FROM part",
    "fv_heard": "SELECT song_id AS query_id, fv_rec.recording_mbid FROM fv_song JOIN fv_rec ON artist_canonical = artist_normalized AND title_canonical = title_normalized WHERE song_id[14] < '4'",
    **fuzzy_sql.VIEWS,
    "fv_work": "SELECT recording_mbid, title AS work_id, artist_mbid FROM fv_recording",
}


def versions(v):
    p = v.table("pages")
    cached = F.col("page_id") % 50 + 1000
    return p.select("page_id", F.split("url", r"\?")[0].alias("url"), cached.alias("cached_at"), (cached + F.when(F.col("page_id") % 3 == 0, 10).otherwise(100)).alias("expires_at"), F.when(F.col("page_id") % 11 == 0, 404).otherwise(200).alias("status"))


def recs(v):
    return v.table("part").select(F.concat(F.lit("r"), "p_partkey").alias("recording_mbid"), F.lower("p_brand").alias("artist_normalized"), F.lower("p_name").alias("title_normalized"), (F.col("p_size") * 1000).alias("length_ms"))


def asked(v):
    """A query for every song. Some artists lack their third letter or end early; some titles are their first two letters, lack the first two or
    the third, or have their words the other way round; some have a length.
    """
    sizes = v.table("part").groupBy(F.lower("p_brand").alias("artist_canonical"), F.lower("p_name").alias("title_canonical")).agg((F.min("p_size") * 1000).alias("ms"))
    whole, key, band = F.col("title_canonical"), F.col("song_id"), F.col("artist_canonical")
    digit = lambda i: F.substring(key, i, 1)
    artist = F.when(digit(15) < "3", F.concat(F.substring(band, 1, 2), F.expr("substr(artist_canonical, 4)"))).when(digit(15) < "6", F.substring(band, 1, 7)).otherwise(band)
    turned = F.concat_ws(" ", F.split_part(whole, F.lit(" "), F.lit(2)), F.split_part(whole, F.lit(" "), F.lit(1)))
    cut = F.concat(F.substring(whole, 1, 2), F.expr("substr(title_canonical, 4)"))
    title = F.when(key < "2", F.substring(whole, 1, 2)).when(key < "6", whole).when(key < "a", F.expr("substr(title_canonical, 3)")).when(key < "d", turned).otherwise(cut)
    songs = v.song.join(sizes, ["artist_canonical", "title_canonical"])
    return songs.select(key.alias("query_id"), artist.alias("artist"), title.alias("title"), F.when(digit(16) < "d", F.col("ms")).alias("length_ms"))


def shelves(v):
    """(artists, their release groups, the tracks of these): a brand's parts of about one size are a group."""
    group = F.concat_ws("/", "p_brand", F.floor(F.col("p_size") / 10).cast("string"))
    rows = v.table("part").select(F.lower("p_brand").alias("artist_mbid"), F.col("p_brand").alias("name"), group.alias("rg_mbid"), F.concat(F.lit("r"), "p_partkey").alias("recording_mbid"), F.lower("p_name").alias("title_normalized"))
    return rows.select("artist_mbid", "name").distinct(), rows.select("artist_mbid", "rg_mbid").distinct(), rows.select("rg_mbid", "recording_mbid", "title_normalized")


def heard(v):
    """Recordings that fingerprints find for some queries."""
    songs = v.song.filter(F.substring("song_id", 14, 1) < "4").drop("recording_mbid")
    return songs.join(recs(v), (F.col("artist_canonical") == F.col("artist_normalized")) & (F.col("title_canonical") == F.col("title_normalized"))).select(F.col("song_id").alias("query_id"), "recording_mbid")


LI = "regexp_extract_all(html, '(?is)<li[^>]*>(.*?)</li>', 1)"


def sql_plain(x: str) -> str:
    out = f"regexp_replace({x}, '<[^>]*>', ' ', 'g')"
    for entity, to in [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")]:
        out = f"replace({out}, '{entity}', '{to.replace(chr(39), chr(39) * 2)}')"
    return f"trim(regexp_replace({out}, '\\s+', ' ', 'g'))"


@query(f"""SELECT page_id, CAST(rank AS INTEGER) AS rank, {sql_plain('h')} AS title_raw
  FROM (SELECT page_id, unnest({LI}) AS h, unnest(range(1, len({LI}) + 1)) AS rank FROM pages) WHERE {sql_plain('h')} <> ''""")
def pages_item_texts(v):
    return sn.list_items(v.table("pages").select("page_id", "html"))


def item_pages(v):
    """Runs as list pages whose items have a class for each field; some items lack one, or say that they are new."""
    element = lambda tag, name, inner: F.concat(F.lit(f'<{tag} class="x {name}">'), inner, F.lit(f"</{tag}>"))
    k = F.col("partkey")
    rank = F.when(k % 10 != 9, F.concat(F.lit(" "), F.col("rank").cast("string"), F.lit(". "))).otherwise("-")
    title = F.concat(F.lit('<a href="/t">'), F.when(k % 10 != 8, F.col("title_raw")).otherwise(" "), F.lit("</a>"))
    before = F.when(F.col("previous_position").isNull(), "Nieuw").otherwise(F.concat(F.lit("vorige week: "), F.col("previous_position").cast("string")))
    fields = [element("span", "position", rank), element("h2", "the-title", title), element("h3", "artist", F.col("artist_raw")), element("span", "last-week", before), element("span", "weken", F.concat((k % 4).cast("string"), F.lit(" weken")))]
    item = F.concat(F.lit("<li class='list-item'>\n"), *fields, F.lit("</li>"))
    return by_blocks(v.entry_once.withColumn("_row", item), "run_id").agg(F.concat(F.lit("<ul><li>menu</li>"), F.array_join(F.collect_list("_row"), ""), F.lit("</ul>")).alias("html")).drop("block")


@query("SELECT run_id, rank, artist_raw, title_raw, previous_position, CAST(nullif(partkey % 4, 0) AS INTEGER) AS weeks_on_chart FROM fv_entry WHERE partkey % 10 < 8")
def pages_list_items(v):
    return sn.chart_items(item_pages(v))


@query("""SELECT page_id, url, cached_at, expires_at, status FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY cached_at DESC, page_id DESC) AS n
  FROM fv_version WHERE expires_at > 1050) WHERE n = 1 AND status <> 404""")
def pages_latest_valid(v):
    return sn.latest_valid(versions(v), F.lit(1050))


@query("SELECT page_id, url, cached_at, expires_at, status FROM fv_version WHERE expires_at > 1050")
def purge_expired(v):
    return sn.purge_expired(versions(v), F.lit(1050))[0]


@query("SELECT count(*) FILTER (expires_at <= 1050) AS purged, count(*) FILTER (expires_at > 1050) AS kept FROM fv_version")
def purge_report(v):
    return sn.purge_expired(versions(v), F.lit(1050))[1]


def songs_by_year(v):
    """Each song with a map of its best rank in every year, some of them no numbers."""
    best = v.entry.groupBy("artist_raw", "title_raw", F.substring("period", 1, 4).alias("year")).agg(F.min("rank").alias("rank"))
    value = F.when(F.col("year") == "1997", "new").otherwise(F.col("rank").cast("string"))
    return best.groupBy("artist_raw", "title_raw").agg(F.map_from_entries(F.collect_list(F.struct("year", value))).alias("years"))


UNPIVOTED = "SELECT artist_raw, title_raw, substr(period, 1, 4) AS year, min(rank) AS rank FROM fv_entry WHERE substr(period, 1, 4) <> '1997' GROUP BY 1, 2, 3 HAVING min(rank) <= 30"


@query(UNPIVOTED)
def unpivot_years(v):
    return sn.unpivot_years(songs_by_year(v), "years", 30)


@query("SELECT artist_raw, title_raw, substr(period, 1, 4) AS year, min(rank) AS rank FROM fv_entry WHERE substr(period, 1, 4) <> '1997' GROUP BY 1, 2, 3")
def src_pivoted_years_json(v):
    docs = songs_by_year(v).select(F.to_json(F.array(F.struct(F.col("artist_raw").alias("artist"), F.col("title_raw").alias("title"), "years"))).alias("json"))
    return sn.pivoted_json(docs)


@query("SELECT run_id, rank, artist_raw, title_raw FROM fv_entry")
def src_entries_json(v):
    docs = by_blocks(v.entry_once, "run_id").agg(F.to_json(F.collect_list(F.array(F.col("rank").cast("string"), "artist_raw", "title_raw"))).alias("json")).drop("block")
    return sn.entries_json(docs)


@query("SELECT run_id, rank, previous_position, artist_raw, title_raw FROM fv_entry WHERE rank <> 7")
def src_positions_json(v):
    position = F.struct(F.when(F.col("rank") != 7, F.col("rank").cast("string")).otherwise("x").alias("current"), F.col("previous_position").alias("previous"))
    item = F.struct(position.alias("position"), F.struct(F.col("artist_raw").alias("artist"), F.col("title_raw").alias("title")).alias("track"))
    docs = by_blocks(v.entry_once, "run_id").agg(F.to_json(F.struct(F.collect_list(item).alias("positions"))).alias("json")).drop("block")
    return sn.positions_json(docs)


def chart_pages(v):
    """Runs as pages, long ones as several: tables, list items or lines, by the last digit of the month. Tables of odd years have a column more."""
    kind = F.substring("period", 7, 1).cast("int") % 3
    wide = F.substring("period", 4, 1).cast("int") % 2 == 1
    td = lambda x: F.concat(F.lit("<td>"), x, F.lit("</td>"))
    place = F.concat(F.substring("rank", 1, 1), F.lit("<b>"), F.expr("substr(rank, 2)"), F.lit("</b>."))
    before = F.concat(F.lit("("), F.coalesce(F.col("previous_position").cast("string"), F.lit("-")), F.lit(")"))
    cells = F.concat(td(place), F.when(wide, td(before)).otherwise(""), td(F.concat(F.lit(" "), "artist_raw", F.lit(" [note]"))), td(F.col("title_raw")))
    line = F.concat_ws("", F.col("rank").cast("string"), F.lit(". "), "artist_raw", F.lit(" - "), "title_raw")
    row = F.when(kind == 0, F.concat(F.lit("<tr>"), cells, F.lit("</tr>"))).when(kind == 1, F.concat(F.lit("<li>"), line, F.lit("</li>"))).otherwise(line)
    head = F.when(kind == 0, "<table><tr><th>No</th><th>Artist</th><th>Title</th></tr>\n").otherwise("")
    pages = by_blocks(v.entry.withColumns({"_row": row, "_head": head}), "run_id", "_head").agg(F.array_join(F.collect_list("_row"), "\n").alias("body"))
    return pages.select("run_id", F.concat("_head", "body", F.when(F.col("_head") != "", "\n<tr><td>x</td></tr></table>").otherwise("")).alias("html"))


@query("SELECT run_id, rank, artist_raw, title_raw, CAST(substr(period, 7, 1) AS INTEGER) % 3 AS way FROM fv_entry")
def pages_strategy_fallback(v):
    return sn.first_that_works(chart_pages(v), "run_id")


TABLED = "FROM fv_entry WHERE CAST(substr(period, 7, 1) AS INTEGER) % 3 = 0"


@query(f"SELECT run_id, rank, artist_raw, title_raw, CASE WHEN CAST(period[4] AS INTEGER) % 2 = 1 THEN previous_position END AS previous_position {TABLED}")
def pages_table_rows(v):
    return sn.table_rows(chart_pages(v))


@query("SELECT run_id, rank, artist_raw, title_raw FROM fv_entry WHERE CAST(substr(period, 7, 1) AS INTEGER) % 3 = 2")
def pages_text_lines(v):
    return sn.text_lines(chart_pages(v))


@query("""SELECT hit_id, split_part(source, '_', 1) || '-release-' || split_part(hit_id, '-', 2) AS release_id, split_part(source, '_', 1) || '-recording-' || split_part(hit_id, '-',
    2) AS recording_id, split_part(source, '_', 1) || '-artist-' || CASE WHEN artist_name = '' THEN 'unknown' ELSE lower(artist_name) END AS artist_id FROM fv_hit""")
def synthetic_ids(v):
    return ct.synthetic_ids(v.hit)


def only_elsewhere(v):
    """Parts as releases of one secondary source and as tracks of another, some without artist, year, master, album or code."""
    p, k = v.table("part"), F.col("p_partkey")
    text = lambda n: n.cast("string")
    artist = F.when(k % 10 != 0, F.concat("p_brand", F.lit(" & Co"))).otherwise("")
    releases = p.filter(k % 3 == 0).select(text(k).alias("release_id"), F.when(k % 4 != 0, text(F.floor(k / 12))).alias("master_id"), F.col("p_name").alias("title"), artist.alias("artist_name"), (k % 50 * 40).alias("year"), F.lit("NL").alias("country"))
    tracks = p.filter(k % 5 == 0).select(text(k).alias("track_id"), F.when(k % 4 != 0, text(F.floor(k / 20))).alias("album_id"), F.when(k % 3 != 0, F.concat(F.lit("Album "), F.floor(k / 20))).alias("album_name"), F.col("p_name").alias("title"), artist.alias("artist_name"), (F.col("p_size") * 1000).alias("length_ms"), F.when(k % 7 != 0, F.concat(F.lit("ISRC"), k % 500)).alias("isrc"))
    return ct.release_catalogue(releases, "discbase"), ct.track_catalogue(tracks, "streambase")


ELSEWHERE = "CASE WHEN p_partkey % 10 <> 0 THEN replace(lower(p_brand), ' ', '-') || '-and-co' ELSE 'unknown' END"
ELSEWHERE_NAME = "CASE WHEN p_partkey % 10 <> 0 THEN p_brand || ' & Co' ELSE 'Unknown' END"
ELSEWHERE_YEAR = "CASE WHEN p_partkey % 50 > 0 THEN CAST(p_partkey % 50 * 40 AS VARCHAR) END"


@query(f"""SELECT 'artist' AS kind, artist_mbid AS id, name AS text, CAST(NULL AS VARCHAR) AS owner FROM fv_artist
  UNION ALL SELECT 'recording', recording_mbid, title, artist_mbid FROM fv_recording UNION ALL SELECT 'release_group', rg_mbid, first_release_date, artist_mbid FROM fv_rg
  UNION ALL SELECT 'release', release_mbid, date, rg_mbid FROM fv_release UNION ALL SELECT 'recording_release', recording_mbid, NULL, release_mbid FROM fv_recording_release
  UNION ALL SELECT DISTINCT 'artist', 'discbase-artist-' || {ELSEWHERE}, {ELSEWHERE_NAME}, NULL FROM part WHERE p_partkey % 3 = 0
  UNION ALL SELECT 'recording', 'discbase-recording-' || p_partkey, p_name, 'discbase-artist-' || {ELSEWHERE} FROM part WHERE p_partkey % 3 = 0
  UNION ALL SELECT 'release_group', rg, r.d, r.a FROM (SELECT rg, max({{'title': title, 'a': a, 'd': d}}) AS r FROM (SELECT 'discbase-master-' || p_partkey // 12 AS rg, p_name AS title, 'discbase-artist-' || {ELSEWHERE} AS a, {ELSEWHERE_YEAR} AS d FROM part WHERE p_partkey % 3 = 0 AND p_partkey % 4 <> 0) GROUP BY 1)
  UNION ALL SELECT 'release', 'discbase-release-' || p_partkey, {ELSEWHERE_YEAR}, CASE WHEN p_partkey % 4 <> 0 THEN 'discbase-master-' || p_partkey // 12 END FROM part WHERE p_partkey % 3 = 0
  UNION ALL SELECT 'recording_release', 'discbase-recording-' || p_partkey, NULL, 'discbase-release-' || p_partkey FROM part WHERE p_partkey % 3 = 0
  UNION ALL SELECT DISTINCT 'artist', 'streambase-artist-' || {ELSEWHERE}, {ELSEWHERE_NAME}, NULL FROM part WHERE p_partkey % 5 = 0
  UNION ALL SELECT 'recording', 'streambase-track-' || p_partkey, p_name, 'streambase-artist-' || {ELSEWHERE} FROM part WHERE p_partkey % 5 = 0
  UNION ALL SELECT 'release_group', rg, NULL, a FROM (SELECT 'streambase-album-' || p_partkey // 20 AS rg, max('streambase-artist-' || {ELSEWHERE}) AS a FROM part WHERE p_partkey % 5 = 0 AND p_partkey % 4 <> 0 AND p_partkey % 3 <> 0 GROUP BY 1)
  UNION ALL SELECT DISTINCT 'release', 'streambase-album-' || p_partkey // 20, NULL, 'streambase-album-' || p_partkey // 20 FROM part WHERE p_partkey % 5 = 0 AND p_partkey % 4 <> 0 AND p_partkey % 3 <> 0
  UNION ALL SELECT 'recording_release', 'streambase-track-' || p_partkey, NULL, 'streambase-album-' || p_partkey // 20 FROM part WHERE p_partkey % 5 = 0 AND p_partkey % 4 <> 0""")
def synthetic_catalogue(v):
    main = {"artist": v.artist, "recording": v.recording, "release_group": v.rg, "release": v.release, "recording_release": v.recording_release}
    t = ct.with_secondary(main, *only_elsewhere(v))
    none = F.lit(None).cast("string")
    shape = {"artist": ("artist_mbid", "name", none), "recording": ("recording_mbid", "title", "artist_mbid"), "release_group": ("rg_mbid", "first_release_date", "artist_mbid"), "release": ("release_mbid", "date", "rg_mbid"), "recording_release": ("recording_mbid", none, "release_mbid")}
    column = lambda c: F.col(c) if isinstance(c, str) else c
    parts = [t[kind].select(F.lit(kind).alias("kind"), column(a).alias("id"), column(b).alias("text"), column(c).alias("owner")) for kind, (a, b, c) in shape.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)


@query("""SELECT p_partkey AS id, CASE WHEN p_partkey % 4 <> 0 THEN CAST(p_partkey + 1 AS VARCHAR) END AS master_id,
    CASE WHEN p_partkey % 3 = 0 THEN CAST(p_partkey AS VARCHAR) END AS release_id, CASE WHEN p_partkey % 5 = 0 THEN 'Q' || p_partkey END AS item_id
  FROM part""")
def discogs_ids_from_urls(v):
    k = F.col("p_partkey")
    rel = lambda kind, prefix, n, when: F.when(when, F.struct(F.lit(kind).alias("type"), F.concat(F.lit(prefix), n.cast("string")).alias("url")))
    rows = F.array_compact(F.array(
        rel("discogs", "https://d.example/master/", k, k % 4 != 0), rel("discogs", "https://d.example/master/", k + 1, k % 4 != 0), rel("discogs", "https://d.example/release/", k, k % 3 == 0),
        rel("wikidata", "https://w.example/wiki/Q", k, k % 5 == 0), rel("wikidata", "https://w.example/wiki/Q9", k, k % 5 == 0), rel("other", "https://d.example/master/7", k, F.lit(True)),
    ))
    return ct.ids_from_urls(v.table("part").select(k.alias("id"), rows.alias("relations")))


@query("""SELECT 'a' || s_suppkey AS artist_mbid, CASE WHEN s_suppkey % 4 = 0 THEN n_name WHEN s_suppkey % 4 = 1 THEN 'ISO-' || s_nationkey WHEN s_suppkey % 4 = 2 THEN 'P27-' || s_nationkey WHEN s_suppkey % 8 = 3 THEN 'P740-' || s_nationkey END AS country
  FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def origin_country(v):
    s = v.table("supplier").join(v.table("nation"), F.col("s_nationkey") == F.col("n_nationkey")).withColumn("artist_mbid", F.concat(F.lit("a"), "s_suppkey"))
    key = F.col("s_suppkey")
    artists = s.select("artist_mbid", F.when(key % 4 == 0, F.col("n_name")).alias("area_country"), F.when(key % 4 == 1, F.array(F.concat(F.lit("ISO-"), "s_nationkey"), F.lit("XX"))).alias("iso_codes"))
    claim = lambda p, when: s.filter(when).select("artist_mbid", F.lit(p).alias("property"), F.lit(0).alias("place"), F.concat_ws("-", F.lit(p), F.col("s_nationkey").cast("string")).alias("country"))
    return ct.origin_country(artists, claim("P740", key % 8 != 7).unionByName(claim("P27", key % 4 == 2)))


@query("SELECT artist_mbid, name FROM fv_artist WHERE contains(lower(name), '00001') ORDER BY name, artist_mbid LIMIT 10")
def like_search(v):
    return search.like(v.artist, "name", "00001", "artist_mbid").select("artist_mbid", "name")


@query("""SELECT query_id, key, name FROM (SELECT s_suppkey AS query_id, rg_mbid AS key, title AS name, row_number() OVER (PARTITION BY s_suppkey ORDER BY title, rg_mbid) AS n
  FROM supplier JOIN fv_rg g ON contains(lower(title), lower(s_name[-3:])) LEFT JOIN fv_artist a USING (artist_mbid)
  WHERE s_suppkey % 2 = 0 OR contains(lower(a.name), '#0000000' || lpad(CAST(s_suppkey % 100 AS VARCHAR), 2, '0'))) WHERE n <= 10""")
def like_groups(v):
    k = F.col("s_suppkey")
    queries = v.table("supplier").select(k.alias("query_id"), F.substring("s_name", -3, 3).alias("text"), F.when(k % 2 == 1, F.concat(F.lit("#0000000"), F.lpad((k % 100).cast("string"), 2, "0"))).alias("artist"))
    groups = v.rg.join(v.artist.select("artist_mbid", F.col("name").alias("artist_name")), "artist_mbid", "left").select(F.col("rg_mbid").alias("key"), F.col("title").alias("name"), "artist_name")
    return search.like_batch(queries, groups)


@query("SELECT query_id, recording_mbid FROM fv_query JOIN fv_rec ON title = title_normalized AND contains(artist_normalized, artist)")
def exact_title_artist_search(v):
    return search.exact_names(asked(v), recs(v))


@query("""SELECT query_id, recording_mbid FROM (SELECT query_id, recording_mbid, row_number() OVER (PARTITION BY query_id ORDER BY recording_mbid) AS n
  FROM fv_query JOIN fv_rec ON contains(title_normalized, title) AND contains(artist_normalized, artist)) WHERE n <= 25""")
def loose_title_artist_search(v):
    return search.loose_names(asked(v), recs(v))


@query("""SELECT query_id, recording_mbid FROM fv_query q
  JOIN fv_rec r ON title = title_normalized AND (q.length_ms IS NULL OR r.length_ms BETWEEN CAST(trunc(q.length_ms * 0.9) AS INTEGER) AND CAST(trunc(q.length_ms * 1.1) AS INTEGER))""")
def length_range(v):
    return search.by_title_and_length(asked(v), recs(v))


CONTAINING = fuzzy_sql.containing("fv_query")


@query(CONTAINING)
def search_contains(v):
    return search.containing(asked(v), recs(v))


@query(fuzzy_sql.search("fv_query"))
def search_fuzzy(v):
    return search.search_fuzzy(asked(v), recs(v))


@query("SELECT * FROM fv_stage")
def search_stages(v):
    return search.search_stages(asked(v), recs(v), shelves(v), heard(v))


@query("SELECT s AS stage, (SELECT count(*) FROM fv_stage WHERE stage = s) AS n FROM (VALUES (1), (2), (3), (4)) t(s)")
def stage_summary(v):
    stages = v.spark.range(1, 5).select(F.col("id").cast("int").alias("stage"))
    return search.stage_summary(search_stages(v), stages)


@query("""SELECT query_id, song_id, CAST(1 AS DOUBLE) AS score FROM fv_query JOIN fv_song ON artist_canonical = artist AND title_canonical = title
UNION ALL SELECT query_id, song_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, song_id) AS n FROM (
  SELECT query_id, song_id, CAST(round(0.4 * a.ratio / 100 + 0.6 * t.ratio / 100, 6) AS DOUBLE) AS score FROM fv_query q JOIN fv_title_ratio t ON t.a = q.title JOIN fv_song s ON s.title_canonical = t.b JOIN fv_artist_ratio a ON a.a = q.artist AND a.b = s.artist_canonical
  WHERE query_id NOT IN (SELECT query_id FROM fv_query JOIN fv_song ON artist_canonical = artist AND title_canonical = title)) WHERE score >= 0.7) WHERE n = 1""")
def song_lookup(v):
    return search.song_lookup(asked(v), v.song)


@query("SELECT key, min(hit_id) AS hit_id FROM (SELECT lower(artist_name) || '|' || lower(title) AS key, hit_id FROM fv_hit) GROUP BY 1")
def dedupe_first(v):
    rows = v.hit.select(F.concat_ws("|", F.lower("artist_name"), F.lower("title")).alias("key"), "hit_id")
    return search.dedupe_first(rows, ["key"], ["hit_id"])


@query("SELECT event_id, value / 100 AS score FROM events WHERE value / 100 >= 0.1 AND (event_id % 7 = 0 OR abs(event_id % 60 - user_id % 60) <= 2)")
def fingerprint_filter(v):
    rows = v.table("events").select("event_id", (F.col("value") / 100).alias("score"), F.when(F.col("event_id") % 7 != 0, F.col("event_id") % 60).alias("duration"), (F.col("user_id") % 60).alias("file_duration"))
    return ct.fingerprint_filter(rows, 0.1).select("event_id", "score")


EXTRA_VIEWS["fv_answered"] = """SELECT event_id, value / 1000 AS score, event_id % 60 AS seconds, 'm' || event_id AS recording_mbid, CAST(CASE event_id % 3 WHEN 1 THEN 0 WHEN 2 THEN (user_id % 60) * 1000 + 500 END AS BIGINT) AS duration_ms FROM events
  UNION ALL SELECT event_id, value / 1000, event_id % 60, CASE WHEN event_id % 4 > 0 THEN 'n' || event_id END, CAST((event_id % 63) * 1000 AS BIGINT) FROM events"""


def answers(v):
    """An answer of a fingerprint service for each event; some are errors, some recordings lack an id or a duration."""
    k = F.col("event_id")
    one = F.struct(F.concat(F.lit("m"), k).alias("id"), F.when(k % 3 == 1, 0.0).when(k % 3 == 2, F.col("user_id") % 60 + 0.5).alias("duration"))
    two = F.struct(F.when(k % 4 > 0, F.concat(F.lit("n"), k)).alias("id"), (k % 63).cast("double").alias("duration"))
    good = F.to_json(F.struct(F.lit("ok").alias("status"), F.array(F.struct((F.col("value") / 1000).alias("score"), F.array(one, two).alias("recordings"))).alias("results")))
    bad = F.when(k % 22 == 0, '{"status": "error", "error": {"message": "invalid fingerprint"}}').otherwise("{")
    return v.table("events").select(k.alias("file_id"), (k % 60).alias("file_duration"), F.when(k % 11 == 0, bad).otherwise(good).alias("json"))


@query("""SELECT event_id AS file_id, recording_mbid, score, duration_ms, CAST(row_number() OVER (PARTITION BY event_id ORDER BY score DESC, recording_mbid, duration_ms NULLS FIRST) AS INTEGER) AS place FROM fv_answered
  WHERE event_id % 11 > 0 AND recording_mbid IS NOT NULL AND score >= 0.1 AND (coalesce(duration_ms, 0) = 0 OR abs(duration_ms / 1000 - seconds) <= 2)""")
def fingerprint_hits(v):
    return ct.fingerprint_hits(answers(v), least=0.1)


@query("SELECT event_id AS file_id, CASE WHEN event_id % 22 = 0 THEN 'invalid fingerprint' ELSE 'Unknown error' END AS error FROM events WHERE event_id % 11 = 0")
def fingerprint_errors(v):
    return ct.fingerprint_errors(answers(v))


RGS = "SELECT DISTINCT recording_mbid, rg_mbid FROM fv_recording_release JOIN fv_release USING (release_mbid) JOIN fv_rg USING (rg_mbid)"


@query(RGS)
def rgs_for_recordings(v):
    return ct.rgs_for_recordings(v.recording_release, v.release, v.rg)


@query("""SELECT artist_mbid, rg_mbid, first_release_date, place
  FROM (SELECT *, CAST(row_number() OVER (PARTITION BY artist_mbid ORDER BY first_release_date NULLS LAST, rg_mbid) AS INTEGER) AS place FROM fv_rg
  WHERE artist_mbid IN (SELECT artist_mbid FROM fv_artist)) WHERE place <= 100""")
def rgs_for_artists(v):
    return ct.rgs_for_artists(v.artist, v.rg)


@query(f"SELECT rg_mbid, count(*) AS n_recordings FROM ({RGS}) GROUP BY 1")
def recordings_for_rgs(v):
    return ct.rgs_for_recordings(v.recording_release, v.release, v.rg).groupBy("rg_mbid").agg(F.count("*").alias("n_recordings"))


@query("SELECT rg_mbid, release_mbid, date FROM fv_release WHERE rg_mbid IN (SELECT rg_mbid FROM fv_rg)")
def releases_in_rg(v):
    return v.release.join(v.rg, "rg_mbid", "left_semi").select("rg_mbid", "release_mbid", "date")


@query("SELECT recording_mbid, rg_mbid, min(CAST(substr(date, 1, 4) AS INTEGER)) AS first_year FROM fv_recording_release JOIN fv_release USING (release_mbid) GROUP BY 1, 2")
def rgs_for_recording_pg(v):
    return ct.first_year_by_group(v.recording_release, v.release)


@query("""SELECT seed, recording_mbid, place
  FROM (SELECT s.recording_mbid AS seed, w.recording_mbid, CAST(row_number() OVER (PARTITION BY s.recording_mbid ORDER BY w.recording_mbid <> s.recording_mbid,
    w.recording_mbid) AS INTEGER) AS place FROM fv_work s JOIN fv_work w ON s.work_id = w.work_id AND s.artist_mbid = w.artist_mbid)
  WHERE place <= 100""")
def work_siblings(v):
    work = v.recording.select("recording_mbid", F.col("title").alias("work_id"), "artist_mbid")
    return ct.work_siblings(work.select("recording_mbid"), work)


@query("SELECT s.recording_mbid AS seed, count(w.recording_mbid) FILTER (w.artist_mbid IS DISTINCT FROM s.artist_mbid) AS n_filtered FROM fv_work s JOIN fv_work w USING (work_id) GROUP BY 1")
def filtered_covers(v):
    work = v.recording.select("recording_mbid", F.col("title").alias("work_id"), "artist_mbid")
    return ct.filtered_covers(work.select("recording_mbid"), work)


@query("""SELECT recording_mbid, seed, place FROM (SELECT *, row_number() OVER (PARTITION BY recording_mbid ORDER BY seed, place) AS n FROM (
  SELECT s.recording_mbid AS seed, w.recording_mbid, CAST(row_number() OVER (PARTITION BY s.recording_mbid ORDER BY w.recording_mbid <> s.recording_mbid, w.recording_mbid) AS INTEGER) AS place
  FROM fv_work s JOIN fv_work w ON s.work_id = w.work_id AND s.artist_mbid = w.artist_mbid) WHERE place <= 100) WHERE n = 1""")
def siblings_once(v):
    work = v.recording.select("recording_mbid", F.col("title").alias("work_id"), "artist_mbid")
    return ct.once_over_seeds(ct.work_siblings(work.select("recording_mbid"), work))


CODES = "SELECT DISTINCT 'ISRC' || (p_partkey % 500) AS isrc FROM part"


@query(f"SELECT DISTINCT isrc, recording_mbid FROM ({CODES}) JOIN (SELECT recording_mbid, unnest(isrcs) AS isrc FROM fv_recording) USING (isrc)")
def isrc_lookup(v):
    return ct.by_isrc(v.table("part").select(F.concat(F.lit("ISRC"), (F.col("p_partkey") % 500).cast("string")).alias("isrc")).distinct(), v.recording)


@query(f"SELECT DISTINCT isrc, recording_mbid, rg_mbid FROM ({CODES}) JOIN (SELECT recording_mbid, unnest(isrcs) AS isrc FROM fv_recording) USING (isrc) JOIN ({RGS}) USING (recording_mbid)")
def discover_by_isrc(v):
    codes = v.table("part").select(F.concat(F.lit("ISRC"), (F.col("p_partkey") % 500).cast("string")).alias("isrc")).distinct()
    return ct.by_isrc(codes, v.recording).join(ct.rgs_for_recordings(v.recording_release, v.release, v.rg), "recording_mbid")


DISCOVERED = f"SELECT query_id, recording_mbid FROM ({fuzzy_sql.search('fv_query', 0.1, 100)})"


def discovered(v):
    found = search.search_fuzzy(asked(v), recs(v), 0.1, 100).select("query_id", "recording_mbid")
    return found.join(ct.rgs_for_recordings(v.recording_release, v.release, v.rg), "recording_mbid")


@query(f"SELECT DISTINCT query_id, recording_mbid, rg_mbid FROM ({DISCOVERED}) JOIN ({RGS}) USING (recording_mbid)")
def discover_by_title_artist_length(v):
    return discovered(v).select("query_id", "recording_mbid", "rg_mbid").distinct()


BUCKET = """CASE WHEN lower(type) = 'soundtrack' THEN 'soundtrack' WHEN lower(type) = 'album' AND secondary_type IS NULL THEN 'studio_album' WHEN lower(type) = 'ep' THEN 'ep'
  WHEN lower(type) = 'single' THEN 'single' ELSE 'other' END"""


@query(f"SELECT bucket, count(*) AS n FROM (SELECT DISTINCT query_id, rg_mbid, {BUCKET} AS bucket FROM ({DISCOVERED}) JOIN ({RGS}) USING (recording_mbid) JOIN fv_rg USING (rg_mbid)) GROUP BY 1")
def bucketed_from_search(v):
    found = discovered(v).join(v.rg, "rg_mbid")
    compilation = F.col("secondary_type").isNotNull().alias("is_compilation")
    candidates = found.select(F.col("query_id").alias("entity_id"), "rg_mbid", F.col("type").alias("primary_type"), compilation, "first_release_date", "artist_mbid", "title")
    return rs.bucketed(candidates).groupBy("bucket").agg(F.count("*").alias("n"))


EXTRA_VIEWS["fv_library"] = """SELECT 'f' || p_partkey AS file_id, CASE WHEN p_partkey % 6 = 0 THEN 'r' || p_partkey END AS recording_mbid, p_brand AS artist, upper(p_name) AS title
  FROM part WHERE p_partkey % 3 = 0"""


def library(v):
    k = F.col("p_partkey")
    return v.table("part").filter(k % 3 == 0).select(F.concat(F.lit("f"), k).alias("file_id"), F.when(k % 6 == 0, F.concat(F.lit("r"), k)).alias("recording_mbid"), F.col("p_brand").alias("artist"), F.upper("p_name").alias("title"))


EXTRA_VIEWS["fv_owned"] = """SELECT entry_id, l.file_id, 1 AS way FROM fv_entry JOIN fv_library l ON l.recording_mbid = 'r' || partkey
  UNION ALL SELECT entry_id, min(l.file_id), 2 FROM fv_entry JOIN fv_library l ON lower(artist) = lower(artist_raw) AND lower(title) = lower(title_raw) GROUP BY 1"""


@query("SELECT entry_id, arg_min(file_id, way) AS file_id, min(way) AS way FROM fv_owned GROUP BY 1")
def library_match(v):
    entries = v.entry.select("entry_id", F.concat(F.lit("r"), "partkey").alias("recording_mbid"), F.col("artist_raw").alias("artist"), F.col("title_raw").alias("title"))
    return ct.library_match(entries, library(v))


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 5 = 0 THEN 'Q' || p_partkey END AS item_id FROM part")
def wikidata_qid_from_urls(v):
    return discogs_ids_from_urls(v).select("id", "item_id")


def year_pages(v):
    """One page per chart, month, block of ranks and year asked for: a table with a column for every year, a row for every place in that month."""
    dated = v.entry.withColumns({"year": F.substring("period", 1, 4), "month": F.substring("period", 6, 2)})
    years = F.array_sort(F.collect_set("year"))
    cell = F.struct("year", F.concat(F.lit("<td><a href='x'>"), F.col("rank").cast("string"), F.lit(". </a>"), "artist_raw", F.lit(" - "), "title_raw", F.lit("</td>")).alias("html"))
    head = dated.groupBy("chart_id", "month").agg(years.alias("years"))
    rows = dated.groupBy("chart_id", "month", "rank").agg(F.map_from_entries(F.collect_list(cell)).alias("cells")).join(head, ["chart_id", "month"])
    lines = rows.select("chart_id", "month", "years", "rank", F.concat(F.lit("<tr>"), F.array_join(F.transform("years", lambda y: F.coalesce(F.try_element_at("cells", y), F.lit("<td></td>"))), ""), F.lit("</tr>")).alias("line"))
    tables = by_blocks(lines, "chart_id", "month", "years").agg(F.array_join(F.collect_list("line"), "").alias("body"))
    html = F.concat(F.lit("<table><tr>"), F.array_join(F.transform("years", lambda y: F.concat(F.lit("<th>List "), y, F.lit("</th>"))), ""), F.lit("</tr>"), "body", F.lit("</table>"))
    return tables.select("chart_id", "month", html.alias("html"), F.explode("years").alias("year"))


@query("SELECT chart_id, substr(period, 1, 4) AS year, substr(period, 6, 2) AS month, rank, artist_raw, title_raw FROM fv_entry")
def pages_year_column(v):
    return sn.year_column(year_pages(v))


@query("SELECT entry_id, CASE WHEN rank % 4 <> 0 THEN '/wiki/A_' || partkey END AS artist_url, CASE WHEN rank % 4 <> 0 AND rank % 3 = 0 THEN '/wiki/T_' || partkey END AS title_url FROM fv_entry")
def wiki_link_enrich(v):
    link = lambda letter: F.concat(F.lit(f'<a href="/wiki/{letter}_'), "partkey", F.lit('">x</a>'))
    row = F.concat(F.lit("<tr><td>"), F.col("rank").cast("string"), F.lit("</td><td>"), link("A"), F.when(F.col("rank") % 3 == 0, link("T")).otherwise(""), F.lit('<a href="/other">y</a></td></tr>'))
    pages = by_blocks(v.entry.filter("rank % 4 <> 0"), "run_id").agg(F.array_join(F.collect_list(row), "").alias("html")).drop("block")
    return sn.with_links(v.entry.select("entry_id", "run_id", "rank"), sn.wiki_links(pages), ["run_id", "rank"]).select("entry_id", "artist_url", "title_url")


@query("SELECT chart_id, period, count(*) AS n, min(rank) AS first_rank FROM fv_entry GROUP BY 1, 2")
def sink_snapshot(v):
    path = shared_folder(v.spark)
    sn.write_snapshots(v.entry_once.select("chart_id", "period", "rank", "artist_raw", "title_raw"), path)
    back = v.spark.read.schema("rank int, artist_raw string, title_raw string, chart_id string, period string").parquet(path)
    return back.groupBy("chart_id", "period").agg(F.count("*").alias("n"), F.min("rank").alias("first_rank"))


def api_docs(v):
    """Recording documents as a catalogue service gives them, made from the tables."""
    group = F.struct(F.col("rg_mbid").alias("id"), F.lit("t").alias("title"), F.lit("Album").alias("primary-type"), F.lit(None).cast("string").alias("first-release-date"))
    one = F.struct(F.col("release_mbid").alias("id"), F.lit("t").alias("title"), "date", "country", F.when(F.col("is_official"), "Official").otherwise("Promotion").alias("status"), group.alias("release-group"))
    nested = v.recording_release.join(v.release, "release_mbid").groupBy("recording_mbid").agg(F.collect_list(one).alias("releases"))
    credit = F.array(F.struct(F.struct(F.col("artist_mbid").alias("id"), F.col("artist_mbid").alias("name")).alias("artist")))
    return v.recording.join(nested, "recording_mbid").select(F.to_json(F.struct(F.col("recording_mbid").alias("id"), "title", F.col("length_ms").alias("length"), "isrcs", credit.alias("artist-credit"), "releases")).alias("json"))


@query("""SELECT x.recording_mbid, r.title, r.artist_mbid, l.release_mbid, l.rg_mbid, l.date, l.country, l.is_official FROM fv_recording_release x
  JOIN fv_recording r USING (recording_mbid) JOIN fv_release l USING (release_mbid)""")
def catalogue_from_api_docs(v):
    t = cd.flatten(api_docs(v))
    # Groups and artists meet releases and recordings, which are fewer than the pairs of these.
    recordings = t["recording"].select("recording_mbid", "title", "artist_mbid").join(t["artist"].select("artist_mbid"), "artist_mbid")
    releases = t["release"].join(t["release_group"].select("rg_mbid"), "rg_mbid")
    return t["recording_release"].join(recordings, "recording_mbid").join(releases, "release_mbid").select("recording_mbid", "title", "artist_mbid", "release_mbid", "rg_mbid", "date", "country", "is_official")


@query(fuzzy_sql.browse("fv_query"))
def artist_browse(v):
    return search.artist_browse(asked(v), *shelves(v))
