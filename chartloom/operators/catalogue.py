"""Traversals of the catalogue: recordings, releases, release groups, artists and works, as equi-join chains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chartloom.functions.normalize import artist_core, normalize_title


def rgs_for_recordings(recording_release: DataFrame, releases: DataFrame, groups: DataFrame) -> DataFrame:
    """Distinct (recording, release group)."""
    return recording_release.join(releases.select("release_mbid", "rg_mbid"), "release_mbid").join(groups.select("rg_mbid"), "rg_mbid").select("recording_mbid", "rg_mbid").distinct()


def rgs_for_artists(artists: DataFrame, groups: DataFrame, limit: int = 100) -> DataFrame:
    """Each artist's groups by date, undated last; the limit holds for each artist."""
    w = Window.partitionBy("artist_mbid").orderBy(F.col("first_release_date").asc_nulls_last(), "rg_mbid")
    return groups.join(artists.select("artist_mbid"), "artist_mbid", "left_semi").withColumn("place", F.row_number().over(w)).filter(F.col("place") <= limit).select("artist_mbid", "rg_mbid", "first_release_date", "place")


def first_year_by_group(recording_release: DataFrame, releases: DataFrame) -> DataFrame:
    """Per recording and group the earliest year of a release; null if none has a date."""
    year = F.substring("date", 1, 4).cast("int")
    return recording_release.join(releases.select("release_mbid", "rg_mbid", year.alias("year")), "release_mbid").groupBy("recording_mbid", "rg_mbid").agg(F.min("year").alias("first_year"))


def work_siblings(seeds: DataFrame, recording_work: DataFrame, limit: int = 100, same_artist: bool = True) -> DataFrame:
    """Recordings of a seed's work, the seed first, at most `limit` of each seed, the first by id; the limit is part of the feature.

    Only the first `limit` recordings of a work can be among those of any seed, so a seed meets these and itself, however many there are.
    """
    key = ["work_id", "artist_mbid"] if same_artist else ["work_id"]
    rows = recording_work.select("recording_mbid", *key)
    first = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy("recording_mbid"))).filter(F.col("_n") <= limit).drop("_n")
    own = seeds.join(rows, "recording_mbid").withColumnRenamed("recording_mbid", "seed")
    pairs = own.join(first, key).select("seed", "recording_mbid").unionByName(own.select("seed", F.col("seed").alias("recording_mbid"))).distinct()
    w = Window.partitionBy("seed").orderBy((F.col("recording_mbid") != F.col("seed")).cast("int"), "recording_mbid")
    return pairs.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= limit).select("seed", "recording_mbid", "place")


def filtered_covers(seeds: DataFrame, recording_work: DataFrame) -> DataFrame:
    """(seed, n_filtered): how many recordings of a seed's work are by another artist than its own, one that isn't known included, and so no siblings of it."""
    rows = recording_work.select("recording_mbid", "work_id", "artist_mbid")
    counts = rows.groupBy("work_id", "artist_mbid").agg(F.count("*").alias("n_own"))
    of_work = counts.groupBy("work_id").agg(F.sum("n_own").alias("n_all"))
    own = seeds.join(rows, "recording_mbid").withColumnRenamed("recording_mbid", "seed").alias("s").join(counts.alias("c"), (F.col("s.work_id") == F.col("c.work_id")) & F.col("s.artist_mbid").eqNullSafe(F.col("c.artist_mbid")))
    return own.select("seed", F.col("s.work_id").alias("work_id"), "n_own").join(of_work, "work_id").groupBy("seed").agg(F.sum(F.col("n_all") - F.col("n_own")).alias("n_filtered"))


def once_over_seeds(siblings: DataFrame) -> DataFrame:
    """(recording_mbid, seed, place): each recording once, with the first seed by id that has it among its siblings."""
    first = siblings.groupBy("recording_mbid").agg(F.min(F.struct("seed", "place")).alias("_first"))
    return first.select("recording_mbid", "_first.seed", "_first.place")


def by_isrc(codes: DataFrame, recordings: DataFrame) -> DataFrame:
    """(isrc) -> recordings whose list holds it: exploded first, so that the join hashes."""
    return codes.join(recordings.select("recording_mbid", F.explode("isrcs").alias("isrc")), "isrc").select("isrc", "recording_mbid").distinct()


def library_match(entries: DataFrame, files: DataFrame) -> DataFrame:
    """Entry -> owned file: by recording id, else by names; of several the first by id.

    entries: (entry_id, recording_mbid, artist, title); files: (file_id, recording_mbid, artist, title).
    """
    by_id = entries.filter("recording_mbid is not null").join(files.filter("recording_mbid is not null").select("recording_mbid", "file_id"), "recording_mbid").select("entry_id", "file_id", F.lit(1).alias("way"))
    names = files.select(F.lower("artist").alias("a"), F.lower("title").alias("t"), "file_id").groupBy("a", "t").agg(F.min("file_id").alias("file_id"))
    keyed = entries.select("entry_id", F.lower("artist").alias("a"), F.lower("title").alias("t"))
    both = by_id.unionByName(keyed.join(names, ["a", "t"]).select("entry_id", "file_id", F.lit(2).alias("way")))
    return both.groupBy("entry_id").agg(F.min(F.struct("way", "file_id")).alias("b")).select("entry_id", "b.file_id", "b.way")


def synthetic_ids(hits: DataFrame) -> DataFrame:
    """Ids for things that only a secondary source has, made of the source's name and key."""
    key = F.regexp_extract("hit_id", r"-(.+)$", 1)
    made = lambda kind, tail: F.concat_ws("-", F.split("source", "_")[0], F.lit(kind), tail)
    return hits.select("hit_id", made("release", key).alias("release_id"), made("recording", key).alias("recording_id"), made("artist", name_key("artist_name")).alias("artist_id"))


def name_key(name: str) -> Column:
    """A name as a part of an id: lower case, each blank a hyphen, & spelled out; without a name, unknown."""
    return F.replace(F.replace(F.lower(F.coalesce(F.nullif(name, F.lit("")), F.lit("Unknown"))), F.lit(" "), F.lit("-")), F.lit("&"), F.lit("and"))


#: Columns of the five catalogue tables.
CATALOGUE = {
    "artist": ["artist_mbid", "name", "name_normalized"],
    "recording": ["recording_mbid", "title", "title_normalized", "artist_mbid", "length_ms", "isrcs"],
    "release_group": ["rg_mbid", "title", "artist_mbid", "first_release_date"],
    "release": ["release_mbid", "title", "rg_mbid", "artist_mbid", "date", "country"],
    "recording_release": ["recording_mbid", "release_mbid"],
}


def release_catalogue(items: DataFrame, source: str) -> dict[str, DataFrame]:
    """Catalogue tables of releases that only a secondary source has, one recording each, as such a source knows no tracks.

    items: (release_id, master_id, title, artist_name, year, country). A release without a master has no group; year 0 is none. Rows without an id go.
    """
    made = lambda kind, tail: F.concat(F.lit(f"{source}-{kind}-"), tail)
    date = F.when(F.col("year") != 0, F.col("year").cast("string"))
    name = F.coalesce(F.nullif("artist_name", F.lit("")), F.lit("Unknown"))
    rows = items.filter("release_id is not null").select(
        made("recording", F.col("release_id")).alias("recording_mbid"), made("release", F.col("release_id")).alias("release_mbid"), made("master", F.col("master_id")).alias("rg_mbid"), made("artist", name_key("artist_name")).alias("artist_mbid"),
        name.alias("name"), "title", date.alias("date"), date.alias("first_release_date"), "country", F.lit(None).cast("int").alias("length_ms"), F.lit(None).cast("array<string>").alias("isrcs"),
    )
    return _tables(rows, F.col("release_mbid").isNotNull(), F.col("rg_mbid").isNotNull())


def track_catalogue(items: DataFrame, source: str) -> dict[str, DataFrame]:
    """Catalogue tables of tracks that only a secondary source has; an album is release and group at once.

    items: (track_id, album_id, album_name, title, artist_name, length_ms, isrc). An album without a name has no row, but tracks keep their link to it. Rows without an id go.
    """
    made = lambda kind, tail: F.concat(F.lit(f"{source}-{kind}-"), tail)
    album = made("album", F.nullif("album_id", F.lit("")))
    name, none = F.coalesce(F.nullif("artist_name", F.lit("")), F.lit("Unknown")), F.lit(None).cast("string")
    rows = items.filter("track_id is not null").select(
        made("track", F.col("track_id")).alias("recording_mbid"), album.alias("release_mbid"), album.alias("rg_mbid"), made("artist", name_key("artist_name")).alias("artist_mbid"), name.alias("name"),
        "title", F.nullif("album_name", F.lit("")).alias("album"), none.alias("date"), none.alias("first_release_date"), none.alias("country"), "length_ms", F.when(F.col("isrc") != "", F.array("isrc")).alias("isrcs"),
    )
    named = F.col("release_mbid").isNotNull() & F.col("album").isNotNull()
    return _tables(rows, named, named, "album")


def _tables(rows: DataFrame, has_release: Column, has_group: Column, title: str = "title") -> dict[str, DataFrame]:
    """The five tables of wide rows, once per key: of several rows with a key the last by its columns."""
    def once(df: DataFrame, table: str, made: dict[str, Column] | None = None) -> DataFrame:
        key, *rest = [c for c in CATALOGUE[table] if c not in (made or {})]
        return df.groupBy(key).agg(F.max(F.struct(*rest)).alias("_r")).select(key, "_r.*").withColumns(made or {}).select(*CATALOGUE[table])

    titled = rows.withColumn("title", F.col(title))
    return {
        "artist": once(rows, "artist", {"name_normalized": artist_core(F.col("name"))}),
        "recording": once(rows, "recording", {"title_normalized": normalize_title(F.col("title"))["core"]}),
        "release_group": once(titled.filter(has_group), "release_group"),
        "release": once(titled.filter(has_release), "release"),
        "recording_release": rows.filter("release_mbid is not null").select("recording_mbid", "release_mbid").distinct(),
    }


def with_secondary(catalogue: dict[str, DataFrame], *more: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The catalogue with the tables of secondary sources put in. Made ids begin with their source, so no key is in two of them and nothing needs to be joined."""
    out = {}
    for table, columns in CATALOGUE.items():
        rows = catalogue[table].select(*[c for c in columns if c in catalogue[table].columns])
        for other in more:
            rows = rows.unionByName(other[table], allowMissingColumns=True)
        out[table] = rows
    return out


def ids_from_urls(relations: DataFrame) -> DataFrame:
    """(id, relations array of (type, url)) -> master and release number of the last such links, and the first item number."""
    last = lambda what: F.element_at(F.concat(F.array(F.lit(None).cast("string")), F.filter(F.transform(F.filter("relations", lambda r: r["type"] == "discogs"), lambda r: F.nullif(F.regexp_extract(r["url"], rf"/{what}/(\d+)", 1), F.lit(""))), lambda x: x.isNotNull())), -1)
    first = F.get(F.filter(F.transform(F.filter("relations", lambda r: r["type"] == "wikidata"), lambda r: F.nullif(F.regexp_extract(r["url"], r"/wiki/(Q\d+)", 1), F.lit(""))), lambda x: x.isNotNull()), 0)
    return relations.select("id", last("master").alias("master_id"), last("release").alias("release_id"), first.alias("item_id"))


def origin_country(artists: DataFrame, claims: DataFrame) -> DataFrame:
    """(artist_mbid, area_country, iso_codes) and (artist_mbid, property, country): the area's country, else the first code, else the claim of property P27, else P740, else the first listed."""
    rank = F.when(F.col("property") == "P27", 0).when(F.col("property") == "P740", 1).otherwise(2)
    claimed = claims.groupBy("artist_mbid").agg(F.min(F.struct(rank.alias("r"), "place", "country")).alias("c")).select("artist_mbid", F.col("c.country").alias("claimed"))
    return artists.join(claimed, "artist_mbid", "left").select("artist_mbid", F.coalesce("area_country", F.get("iso_codes", F.lit(0)), "claimed").alias("country"))


FINGERPRINT = "struct<status:string,error:struct<message:string>,results:array<struct<score:double,recordings:array<struct<id:string,duration:double>>>>>"


def fingerprint_hits(docs: DataFrame, column: str = "json", least: float = 0.5, seconds: int = 2) -> DataFrame:
    """Answers of a fingerprint service, one document per file, as its hits: (file_id, recording_mbid, score, duration_ms, place).

    docs: (file_id, file_duration, json). Recordings without an id go, then `fingerprint_filter` is applied; a result without a score has 0, a duration of 0 is
    unknown. place counts a file's hits, best score first, ties by id. Files whose answer is no success have no hits, but a row in `fingerprint_errors`.
    """
    d = docs.withColumn("_d", F.from_json(column, FINGERPRINT)).filter("_d.status = 'ok'")
    rows = d.select("file_id", "file_duration", F.explode("_d.results").alias("_r")).select("file_id", "file_duration", F.coalesce("_r.score", F.lit(0.0)).alias("score"), F.explode("_r.recordings").alias("_c"))
    found = rows.filter("_c.id <> ''").select("file_id", "file_duration", "score", F.col("_c.id").alias("recording_mbid"), (F.col("_c.duration") * 1000).cast("long").alias("duration_ms"))
    kept = fingerprint_filter(found.withColumn("duration", F.nullif("duration_ms", F.lit(0)) / 1000), least, seconds)
    w = Window.partitionBy("file_id").orderBy(F.desc("score"), "recording_mbid", "duration_ms")
    return kept.select("file_id", "recording_mbid", "score", "duration_ms", F.row_number().over(w).alias("place"))


def fingerprint_errors(docs: DataFrame, column: str = "json") -> DataFrame:
    """(file_id, error): files whose answer is no success, or can't be read."""
    d = F.from_json(column, FINGERPRINT)
    return docs.select("file_id", d["status"].alias("_s"), F.coalesce(d["error"]["message"], F.lit("Unknown error")).alias("error")).filter("_s is distinct from 'ok'").drop("_s")


def fingerprint_filter(hits: DataFrame, least: float = 0.5, seconds: int = 2) -> DataFrame:
    """Hits with a high score whose duration is within the limit of the file's; an unknown duration passes."""
    close = F.col("duration").isNull() | F.col("file_duration").isNull() | (F.abs(F.col("duration") - F.col("file_duration")) <= seconds)
    return hits.filter((F.col("score") >= least) & close)
