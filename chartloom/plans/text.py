"""Queries on normalized text and similarity."""

from __future__ import annotations

import unicodedata

from pyspark.sql import functions as F

from chartloom.functions import ids
from chartloom.functions import normalize as nz
from chartloom.functions import similarity as sim
from chartloom.operators import search, sides
from chartloom.plans import fuzzy_sql
from chartloom.plans.registry import EXTRA_VIEWS, query

#: Texts around the parts' names that the rules should see through; %s is the name.
TITLES = [
    "%s", "%s (Radio Edit)", "%s - Remastered 2011", "%s (Live at Paris) [Remastered 2009]", "From \"Film\" %s", "  %s (feat. Ann É) ", "%s (Karaoke Version)",
    "%s [Medley]", "%s (Club Mix)", "Ünder %s…", "%s (12\" Mix)", "%s - Live at Rome", "the (Live)", "%s (Taylor's Version)", "%s / Other %s", "%s ((note)) [x]", "%s - Single Version",
]
ARTISTS = ["%s", "The %s", "%s feat. Guest Ö", "%s & Friend", "P!nk", "The The", "%s; Second", "%s Featuring A ft. B", "Æ %s", "がガバ Ệ %s", "de dijk", "  %s  Band "]
POSITIONS = ["(12)", "7", "-", "re", "nieuw", " ", "0", "(3"]


def _sql_list(texts, column):
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    return "[" + ", ".join("replace(" + quote(t) + f", '%s', {column})" for t in texts) + "]"


EXTRA_VIEWS["fv_text"] = f"""SELECT p_partkey AS partkey, {_sql_list(ARTISTS, "p_brand")}[p_partkey % {len(ARTISTS)} + 1] AS artist_raw,
  {_sql_list(TITLES, "p_name")}[p_partkey % {len(TITLES)} + 1] AS title_raw, {_sql_list(POSITIONS, "p_name")}[p_partkey % {len(POSITIONS)} + 1] AS position FROM part"""


def texts(v):
    made = lambda options, column: F.element_at(F.array(*[F.replace(F.lit(t), F.lit("%s"), F.col(column)) for t in options]), (F.col("p_partkey") % len(options) + 1).cast("int"))
    return v.table("part").select(F.col("p_partkey").alias("partkey"), made(ARTISTS, "p_brand").alias("artist_raw"), made(TITLES, "p_name").alias("title_raw"), made(POSITIONS, "p_name").alias("position"))


EXTRA_VIEWS["fv_styled"] = """SELECT e.* EXCLUDE (artist_raw, title_raw), t.artist_raw, t.title_raw, a.core AS artist_core, n.core AS title_core, n.tags
  FROM fv_entry e JOIN fv_text t USING (partkey) JOIN fv_artist_norm a USING (partkey) JOIN fv_title_norm n USING (partkey)"""


def styled(v):
    """Entries whose names are written in many ways: with articles, guests, editions, other signs."""
    return v.entry.drop("artist_raw", "title_raw").join(texts(v).select("partkey", "artist_raw", "title_raw"), "partkey")


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def in_list(values) -> str:
    return "(" + ", ".join(map(q, values)) + ")"


def sql_squeeze(x):
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


def sql_plain(x):
    x = f"lower({x})"
    for a, b in nz.FOLDS.items():
        x = f"replace({x}, '{a}', '{b}')"
    for a, b in [("‘", "''"), ("’", "''"), ("“", '"'), ("”", '"'), ("–", "-"), ("—", "-"), ("…", "...")]:
        x = f"replace({x}, '{a}', '{b}')"
    for a, b in nz.LETTERS.items():
        x = f"replace({x}, '{a}', '{b}')"
    return f"strip_accents({x})"


def sql_compact(x):
    return f"regexp_replace({sql_squeeze(x)}, '[-\\s]+$', '')"


EXTRA_VIEWS["fv_artist_norm"] = f"""SELECT partkey, artist_raw, s, split,
    CASE WHEN lower(s) IN {in_list(nz.KEEP_PUNCTUATION)} THEN lower(s) ELSE {sql_compact("CASE WHEN lower(artist_raw) NOT IN " + in_list(nz.KEEP_ARTICLE) + " AND parted LIKE 'the %' AND contains(trim(parted), ' ') THEN parted[5:] ELSE parted END")} END AS core
  FROM (SELECT *, regexp_replace({sql_plain("trim(split[1])")}, '\\s*[&+x×/,]\\s*', ' • ', 'g') AS parted
    FROM (SELECT *, regexp_split_to_array(s, {q(nz.GUESTS)}) AS split FROM (SELECT *, {sql_squeeze("artist_raw")} AS s FROM fv_text)))"""


def _sql_pass(source: str) -> str:
    hit = "CASE " + " ".join(f"WHEN regexp_matches(s, {q(p)}) THEN {i + 1}" for i, p in enumerate(nz.PATTERNS)) + " END"
    found = "CASE h " + " ".join(f"WHEN {i + 1} THEN lower(trim(regexp_extract(s, {q(p)}, 1)))" for i, p in enumerate(nz.PATTERNS)) + " END"
    rest = "CASE h " + " ".join(f"WHEN {i + 1} THEN trim(regexp_replace(s, {q(p)}, ''))" for i, p in enumerate(nz.PATTERNS)) + " ELSE s END"
    edit = "CASE WHEN f LIKE '%radio%' THEN 'radio' WHEN f LIKE '%single%' THEN 'single' WHEN f LIKE '%7\"%' THEN '7in' ELSE 'edit' END"
    extended = "CASE WHEN f LIKE '%12%' THEN '12in' WHEN f LIKE '%club%' THEN 'club' WHEN f LIKE '%dub%' THEN 'dub' WHEN f LIKE '%instrumental%' THEN 'instrumental' WHEN f LIKE '%karaoke%' THEN 'karaoke' ELSE 'extended' END"
    tags = []
    for i, (kind, field, _) in enumerate(nz.SUFFIXES):
        sub = edit if kind == "edit" else extended if kind == "extended" else "coalesce(nullif(f, ''), '-')"
        parts = [sub if field == n else "'-'" for n in ("sub", "value", "note")]
        tags.append(f"WHEN {i + 1} THEN '{kind}/' || " + " || '/' || ".join(parts))
    dash = "CASE WHEN f LIKE '%remaster%' THEN 'remaster/-/' || regexp_extract(f, '(\\d{4})', 1) || '/-' WHEN f LIKE '%live%' THEN 'live/-/' || trim(replace(f, 'live at', '')) || '/-' WHEN f LIKE '%edit%' THEN 'edit/radio/-/-' ELSE 'edit/version/-/-' END"
    tag = "CASE h " + " ".join(tags) + f" WHEN {len(nz.PATTERNS)} THEN {dash} END"
    return f"SELECT partkey, title_raw, whole, film, {rest} AS s, CASE WHEN h IS NULL THEN tags ELSE list_append(tags, {tag}) END AS tags FROM (SELECT *, {found} AS f FROM (SELECT *, {hit} AS h FROM {source}))"


EXTRA_VIEWS["fv_title_norm"] = f"""SELECT partkey, title_raw, rest, tags, film, {sql_compact(sql_plain("trim(regexp_replace(rest, " + q(nz.TITLE_GUESTS) + ", '', 'g'))"))} AS core
  FROM (SELECT partkey, title_raw, film, CASE WHEN back THEN whole ELSE s END AS rest, CASE WHEN film IS NULL THEN [] ELSE ['ost/-/' || film || '/-'] END || CASE WHEN back THEN [] ELSE tags END AS tags
    FROM (SELECT *, length(s) < length(whole) * 0.3 AND lower(trim(s)) IN {in_list(nz.STOPWORDS)} AS back FROM ({_sql_pass("(" + _sql_pass("(" + _sql_pass("fv_film") + ")") + ")")})))"""
EXTRA_VIEWS["fv_film"] = f"""SELECT partkey, title_raw, film, CASE WHEN film IS NULL THEN s ELSE trim(regexp_replace(s, {q(nz.FILM)}, '')) END AS s, CASE WHEN film IS NULL THEN s ELSE trim(regexp_replace(s, {q(nz.FILM)}, '')) END AS whole, CAST([] AS VARCHAR[]) AS tags
  FROM (SELECT *, nullif(regexp_extract(s, {q(nz.FILM)}, 1) || regexp_extract(s, {q(nz.FILM)}, 2) || regexp_extract(s, {q(nz.FILM)}, 3) || regexp_extract(s, {q(nz.FILM)}, 4), '') AS film FROM (SELECT *, {sql_squeeze("title_raw")} AS s FROM fv_text))"""


def titles(v):
    return texts(v).withColumn("t", nz.normalize_title(F.col("title_raw")))


@query("SELECT partkey, core FROM fv_artist_norm")
def normalize_artist(v):
    return texts(v).select("partkey", nz.artist_core(F.col("artist_raw")).alias("core"))


@query("SELECT partkey, core FROM fv_title_norm")
def normalize_title(v):
    return titles(v).select("partkey", F.col("t.core").alias("core"))


@query("SELECT partkey, rest, array_to_string(CASE WHEN film IS NULL THEN tags ELSE tags[2:] END, ';') AS tags FROM fv_title_norm")
def edition_tags(v):
    return texts(v).select("partkey", nz.edition_suffixes(nz.film_prefix(F.col("title_raw"))["rest"]).alias("e")).select("partkey", F.col("e.rest").alias("rest"), nz.tags_text(F.col("e.tags")).alias("tags"))


BARE = sql_compact(sql_plain("trim(g)"))


@query(f"""SELECT partkey, CASE WHEN len(split) > 1 THEN array_to_string(list_transform(split[2:], lambda g: {BARE}), ';') ELSE '' END AS artist_guests,
    array_to_string(list_transform(regexp_extract_all(rest, {q(nz.TITLE_GUESTS)}, 1), lambda g: {BARE}), ';') AS title_guests FROM fv_artist_norm
  JOIN fv_title_norm USING (partkey)""")
def split_guests(v):
    rest = F.col("e.rest")
    rows = texts(v).select("partkey", "artist_raw", nz.edition_suffixes(nz.film_prefix(F.col("title_raw"))["rest"]).alias("e"))
    return rows.select("partkey", F.array_join(nz.artist_guests(F.col("artist_raw")), ";").alias("artist_guests"), F.array_join(nz.title_guests(rest), ";").alias("title_guests"))


@query("SELECT partkey, film, whole AS rest FROM fv_film")
def ost_prefix(v):
    return texts(v).select("partkey", nz.film_prefix(F.col("title_raw")).alias("f")).select("partkey", F.col("f.work").alias("film"), F.col("f.rest").alias("rest"))


@query(f"SELECT partkey, {sql_plain('artist_raw')} AS artist, {sql_plain('title_raw')} AS title FROM fv_text")
def strip_diacritics(v):
    plain = lambda c: nz.strip_diacritics(nz.plain_punctuation(nz.fold_case(F.col(c))))
    return texts(v).select("partkey", plain("artist_raw").alias("artist"), plain("title_raw").alias("title"))


@query("""SELECT partkey, len(list_filter(tags, lambda x: x LIKE 'karaoke/%' OR x LIKE '%/karaoke/%')) > 0 AS karaoke,
    CASE WHEN tags[1] LIKE 'medley%' THEN 'medley' WHEN tags[1] LIKE 'karaoke%' THEN 'unknown' ELSE 'recording' END AS unit FROM fv_title_norm""")
def normalize_entry_unit(v):
    return titles(v).select("partkey", nz.has_tag(F.col("t.tags"), "karaoke").alias("karaoke"), nz.entry_unit(F.col("t.tags")).alias("unit"))


@query("SELECT partkey FROM fv_title_norm WHERE len(list_filter(tags, lambda x: x LIKE 'karaoke/%' OR x LIKE '%/karaoke/%')) > 0")
def is_karaoke(v):
    return titles(v).filter(nz.has_tag(F.col("t.tags"), "karaoke")).select("partkey")


NOTED = "regexp_replace(regexp_replace(title_raw, '\\(\\([^)]*\\)\\)', '', 'g'), '\\[[^\\]]*\\]', '', 'g')"


@query(f"SELECT partkey, {sql_squeeze(NOTED)} AS title FROM fv_text")
def clean_text(v):
    return texts(v).select("partkey", nz.strip_notes(F.col("title_raw")).alias("title"))


@query("SELECT partkey, CASE WHEN n > 0 THEN n END AS previous FROM (SELECT partkey, TRY_CAST(regexp_extract(trim(position), '^\\(?\\s*([0-9]+)\\s*\\)?$', 1) AS INTEGER) AS n FROM fv_text)")
def previous_position_parse(v):
    return texts(v).select("partkey", nz.previous_position(F.col("position")).alias("previous"))


@query("""SELECT partkey, unnest(CASE WHEN len(t) > 1 AND (len(a) = 1 OR len(a) = len(t)) THEN list_transform(range(1, len(t) + 1), lambda i: chr(CAST(64 + i AS INTEGER)) || '|' || CASE WHEN len(a) = 1 THEN a[1] ELSE a[i] END || '|' || t[i]) ELSE ['|' || artist_raw || '|' || title_raw] END) AS side
FROM (SELECT *, list_filter(list_transform(regexp_split_to_array(title_raw, '\\s+/\\s+|\\s*;\\s*'), lambda x: trim(x)), lambda x: x <> '') AS t, list_filter(list_transform(regexp_split_to_array(artist_raw, '\\s+/\\s+|\\s*;\\s*'), lambda x: trim(x)), lambda x: x <> '') AS a FROM fv_text)""")
def split_double_sides(v):
    return sides.split_sides(texts(v)).select("partkey", F.concat_ws("|", F.coalesce("side", F.lit("")), "artist_raw", "title_raw").alias("side"))


@query(f"SELECT doc_id, len(regexp_extract_all(text, {q(nz.EMAIL)})) AS n, sha256(regexp_replace(text, {q(nz.EMAIL)}, '[EMAIL]', 'g')) AS digest FROM documents")
def redact_text(v):
    return v.table("documents").select("doc_id", F.regexp_count("text", F.lit(nz.EMAIL)).cast("long").alias("n"), F.sha2(nz.redact_emails(F.col("text")), 256).alias("digest"))


SHOWN = "CASE WHEN length(k) <= 4 THEN '***' ELSE substr(k, 1, 4) || '***' END"


@query(f"""SELECT event_id, {SHOWN} AS api_key, event_type AS kind, k AS monkey, '{{"a":{{"Authorization":"' || {SHOWN} || '","list":[{{"Client_Secret":"***","n":1}},"token"],"kind":"' || event_type || '"}},"id":' || event_id || '}}' AS json
FROM (SELECT event_id, event_type, CAST(event_id * 37 % 100000 AS VARCHAR) AS k FROM events)""")
def redact_keys(v):
    """A map and a nested document of each event, with secrets of one to five characters."""
    e = v.table("events").withColumn("k", (F.col("event_id") * 37 % 100000).cast("string"))
    values = F.create_map(F.lit("api_key"), F.col("k"), F.lit("kind"), F.col("event_type"), F.lit("monkey"), F.col("k"))
    secret = F.to_json(F.struct(F.struct(F.col("k").alias("Authorization"), F.lit("@").alias("list"), F.col("event_type").alias("kind")).alias("a"), F.col("event_id").alias("id")))
    nested = F.replace(secret, F.lit('"@"'), F.lit('[{"Client_Secret":"a\\"b","n":1},"token"]'))
    rows = e.select("event_id", nz.redact_secrets(values).alias("m"), nz.redact_json(nested).alias("json"))
    return rows.select("event_id", *[F.element_at("m", c).alias(c) for c in ("api_key", "kind", "monkey")], "json")


@query("SELECT page_id, substr(sha256(url), 1, 12) AS hash FROM pages")
def hash_path(v):
    return v.table("pages").select("page_id", ids.hash_path(F.col("url")).alias("hash"))


@query("""SELECT partkey, CASE WHEN trim(core) <> '' AND trim(t) <> '' THEN substr(sha256(core || ' // ' || t), 1, 16) END AS work_key FROM fv_artist_norm
  JOIN (SELECT partkey, core AS t FROM fv_title_norm) USING (partkey)""")
def work_key(v):
    return titles(v).select("partkey", ids.work_key(nz.artist_core(F.col("artist_raw")), F.col("t.core")).alias("work_key"))


RAW_AND_CORE = "SELECT DISTINCT lower(title_raw) AS a, core AS b FROM fv_title_norm"
EXTRA_VIEWS["fv_own_ratio"] = fuzzy_sql.ratios(RAW_AND_CORE)


def with_own_score(v, score):
    """(partkey, ratio): the score of each raw title with its normalized form, once for each distinct title."""
    rows = texts(v).select("partkey", "title_raw")
    pairs = rows.select("title_raw").distinct().select("title_raw", F.lower("title_raw").alias("a"), nz.normalize_title(F.col("title_raw"))["core"].alias("b"))
    # A Python function can't take an expression with a fold in it, so the names are made before.
    scored = pairs.distinct().withColumn("ratio", F.round(score(F.col("a"), F.col("b")), 6))
    return rows.join(scored.select("title_raw", "ratio"), "title_raw").select("partkey", "ratio")


@query("SELECT partkey, round(ratio, 6) AS ratio FROM fv_title_norm JOIN fv_own_ratio ON a = lower(title_raw) AND b = core")
def ratio(v):
    """How near each raw title is to its normalized form."""
    return with_own_score(v, sim.ratio)


@query(f"SELECT a, b FROM ({fuzzy_sql.ratios('SELECT x.p_name AS a, y.p_name AS b FROM (SELECT DISTINCT p_name FROM part) x CROSS JOIN (SELECT DISTINCT p_name FROM part) y')}) WHERE ratio >= 80")
def fuzzy_match(v):
    names = v.table("part").select("p_name")
    return search.close_pairs(names, names, 80).select("a", "b")


@query(f"SELECT partkey, round(score, 6) AS ratio FROM fv_title_norm JOIN ({fuzzy_sql.token_sets(RAW_AND_CORE)}) ON a = lower(title_raw) AND b = core")
def token_set_ratio(v):
    return with_own_score(v, sim.token_set_ratio)


SANE = r"""SELECT partkey, length(trim(core)) > 1 AND NOT regexp_full_match(trim(core), '[0-9]+') AND NOT regexp_full_match(trim(core), '[!@#$%^&*()_+\-=\[\]{}|;'':",./<>?`~\\]+')
  AND (ratio >= 70 OR (length(trim(core)) >= 3 AND contains(lower(title_raw), lower(trim(core))))) AS sane FROM fv_title_norm JOIN fv_own_ratio ON a = lower(title_raw) AND b = core"""


@query(SANE)
def is_sane(v):
    return titles(v).select("partkey", sim.is_sane(F.col("title_raw"), F.col("t.core")).alias("sane"))


#: Latin letters with marks and what they decompose into.
DECOMPOSED = [(chr(c), unicodedata.normalize("NFD", chr(c))) for c in range(0xC0, 0x180) if unicodedata.normalize("NFD", chr(c)) != chr(c)]
EXTRA_VIEWS["fv_nfd"] = f"""SELECT partkey, string_agg(coalesce(nfd, c), '' ORDER BY i) AS s
  FROM (SELECT partkey, unnest(string_split(s, '')) AS c, unnest(range(1, length(s) + 1)) AS i FROM (SELECT partkey, {sql_squeeze("title_raw")} AS s FROM fv_text))
  LEFT JOIN (VALUES {", ".join(f"('{a}', '{b}')" for a, b in DECOMPOSED)}) m(letter, nfd) ON letter = c GROUP BY 1"""
MARKED = "(unicode(c) BETWEEN 768 AND 879 OR lower(c) IN " + in_list(nz.LETTERS) + ")"


@query(f"""SELECT partkey, coalesce(string_agg(i || ':' || c, ',' ORDER BY i) FILTER ({MARKED}), '') AS signature
FROM (SELECT partkey, unnest(range(0, length(s))) AS i, s FROM fv_nfd) CROSS JOIN LATERAL (SELECT substr(s, CAST(i + 1 AS INTEGER), 1) AS c) GROUP BY 1""")
def diacritics_signature(v):
    return texts(v).select("partkey", nz.diacritics_signature(nz.squeeze(F.col("title_raw"))).alias("signature"))
