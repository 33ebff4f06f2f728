"""Loading snapshots, linking entries to songs and works, and keeping tables by key.

Nothing is updated in place: a job takes the table and the new rows and returns the new table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chartloom.functions import ids
from chartloom.functions.normalize import artist_core, has_tag, normalize_title
from chartloom.operators.catalogue import library_match


def merge_upsert(target: DataFrame, source: DataFrame, keys: list[str], keep: list[str] = ()) -> DataFrame:
    """target with the rows of source put in by key; columns of `keep` hold the old value where there was one.

    Of several source rows with a key the last by all its columns is taken, so that reruns agree.
    """
    columns = target.columns
    both = target.withColumn("_new", F.lit(0)).unionByName(source.select(*columns).withColumn("_new", F.lit(1)))
    rest = [c for c in columns if c not in keys]
    row = F.struct("_new", *rest)
    old = F.min_by(F.struct(*rest), "_new") if rest else None
    merged = both.groupBy(*keys).agg(F.max(row).alias("_row"), F.min("_new").alias("_first"), *([old.alias("_old")] if rest else []))
    value = lambda c: F.when(F.col("_first") == 0, F.col(f"_old.{c}")).otherwise(F.col(f"_row.{c}")) if c in keep else F.col(f"_row.{c}")
    return merged.select(*[F.col(c) if c in keys else value(c).alias(c) for c in columns])


def canonical_names(entries: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """(artist_raw, title_raw, artist_canonical, title_canonical, method, karaoke) of each distinct pair of raw names: normalized, or
    as an alias of the raw artist has it. aliases (raw, normalized) has one row per raw.
    """
    pairs = entries.select("artist_raw", "title_raw").distinct().withColumn("_t", normalize_title(F.col("title_raw")))
    rows = pairs.select("artist_raw", "title_raw", artist_core(F.col("artist_raw")).alias("core"), F.col("_t.core").alias("title_canonical"), has_tag(F.col("_t.tags"), "karaoke").alias("karaoke"))
    if aliases is None:
        return rows.withColumnRenamed("core", "artist_canonical").withColumn("method", F.lit("auto"))
    named = with_aliases(rows.select(F.col("artist_raw").alias("raw"), "core").distinct(), aliases).select(F.col("raw").alias("artist_raw"), F.col("core").alias("artist_canonical"), "method")
    return rows.drop("core").join(named, "artist_raw")


def new_songs(entries: DataFrame, songs: DataFrame) -> DataFrame:
    """Songs of the entries that the registry lacks; ids are hashes of the normalized names, so those that exist keep theirs."""
    pairs = canonical_names(entries).select("artist_canonical", "title_canonical").distinct()
    lacking = pairs.join(songs, ["artist_canonical", "title_canonical"], "left_anti")
    return lacking.select(song_id().alias("song_id"), "artist_canonical", "title_canonical")


def song_id() -> Column:
    return ids.short_hash(F.concat_ws(" // ", "artist_canonical", "title_canonical"))


def link_entries(entries: DataFrame, aliases: DataFrame | None = None, confidence: float = 0.85) -> DataFrame:
    """(entry_id, song_idx, song_id, link_method, link_confidence): each entry with the song of its normalized names; karaoke has none."""
    names = canonical_names(entries, aliases).filter(~F.col("karaoke"))
    rows = entries.join(names, (entries["artist_raw"].eqNullSafe(names["artist_raw"])) & (entries["title_raw"].eqNullSafe(names["title_raw"])))
    return rows.select("entry_id", F.lit(0).alias("song_idx"), song_id().alias("song_id"), F.col("method").alias("link_method"), F.lit(confidence).alias("link_confidence"))


def update_song_ids(songs: DataFrame, new: DataFrame, columns: list[str]) -> DataFrame:
    """songs with the ids that new (song_id, columns) has; where it has none the old ones stay."""
    rows = songs.join(new.select("song_id", *[F.col(c).alias(f"_new_{c}") for c in columns]), "song_id", "left")
    return rows.withColumns({c: F.coalesce(f"_new_{c}", c) for c in columns}).drop(*[f"_new_{c}" for c in columns])


def correct_titles(rows: DataFrame, fixes: DataFrame, column: str = "title_raw") -> DataFrame:
    """rows whose title is replaced where fixes (title, fix) know it, in any case and without space around it."""
    known = fixes.groupBy(F.lower(F.trim("title")).alias("_k")).agg(F.min("fix").alias("_fix"))
    return rows.join(known, F.lower(F.trim(column)) == F.col("_k"), "left").withColumn(column, F.coalesce("_fix", column)).drop("_k", "_fix")


def backfill_normalized(rows: DataFrame, raw: str = "title_raw", column: str = "normalized") -> DataFrame:
    """rows whose normalized title is filled in where it is missing; others stay."""
    return rows.withColumn(column, F.coalesce(column, normalize_title(F.col(raw))["core"]))


#: Ids of other services that a file's tags can hold.
EXTERNAL_IDS = ["mb_recording_id", "discogs_master_id", "discogs_release_id", "spotify_track_id", "spotify_album_id", "wikidata_qid"]


def decision_tags(decisions: DataFrame, hashes: DataFrame, blobs: DataFrame | None = None, external: DataFrame | None = None) -> DataFrame:
    """Tags to write for decided entities: both choices, the beginning of the evidence's hash, the charts blob and ids of other services.

    blobs: (entity_id, charts_blob), external: (entity_id, and any of EXTERNAL_IDS), one row per entity at most; what isn't given is null, and so is an empty blob.
    """
    tag = F.concat(F.lit("evh="), F.substring("evidence_hash", 1, 8))
    out = decisions.filter("state = 'decided'").join(hashes, "entity_id").select("entity_id", "crg", "rr", tag.alias("tag"))
    out = out.withColumn("charts_blob", F.lit(None).cast("string")) if blobs is None else out.join(blobs.select("entity_id", F.nullif("charts_blob", F.lit("")).alias("charts_blob")), "entity_id", "left")
    given = [] if external is None else [c for c in EXTERNAL_IDS if c in external.columns]
    if given:
        out = out.join(external.select("entity_id", *given), "entity_id", "left")
    return out.withColumns({c: F.lit(None).cast("string") for c in EXTERNAL_IDS if c not in given})


#: Ranks of a run that make one block of its digest.
BLOCK_RANKS = 1000


def block_digests(entries: DataFrame, block_ranks: int = BLOCK_RANKS) -> DataFrame:
    """(chart_id, period, block, block_hash, n): the digest of the entries of each range of ranks, in order of rank.

    A name stands with its length before it, a missing one as a dash, so that different entries are never one text. Runs of any length are
    digested by many tasks. Entries without a rank are a block of their own.
    """
    field = lambda c: F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), F.col(c)), F.lit("-"))
    line = F.concat_ws("|", F.coalesce(F.col("rank").cast("string"), F.lit("-")), field("artist_raw"), field("title_raw"))
    block = F.floor((F.col("rank") - 1) / block_ranks)
    lines = F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda x: x["line"])
    return entries.groupBy("chart_id", "period", block.alias("block")).agg(F.sha2(F.array_join(lines, "\n"), 256).alias("block_hash"), F.count("*").alias("n"))


def content_hash(entries: DataFrame, block_ranks: int = BLOCK_RANKS) -> DataFrame:
    """Per run the digest of the digests of its blocks in order, which tells a changed snapshot from a repeated one."""
    blocks = block_digests(entries, block_ranks)
    line = F.concat_ws(":", F.coalesce(F.col("block").cast("string"), F.lit("-")), "block_hash")
    lines = F.transform(F.array_sort(F.collect_list(F.struct("block", line.alias("line")))), lambda x: x["line"])
    return blocks.groupBy("chart_id", "period").agg(ids.short_hash(F.array_join(lines, "\n")).alias("source_hash"), F.sum("n").alias("n_entries"))


def changed_blocks(old: DataFrame, new: DataFrame, block_ranks: int = BLOCK_RANKS) -> DataFrame:
    """(chart_id, period, block, change): the ranges of ranks in which two snapshots differ: added, removed or changed."""
    a, b = (block_digests(x, block_ranks).alias(n) for x, n in ((old, "a"), (new, "b")))
    same = F.lit(True)
    for c in ("chart_id", "period", "block"):
        same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    change = F.when(F.col("a.block_hash").isNull(), "added").when(F.col("b.block_hash").isNull(), "removed").when(F.col("a.block_hash") != F.col("b.block_hash"), "changed")
    rows = a.join(b, same, "full").withColumn("change", change).filter("change is not null")
    here = F.col("b.block_hash").isNotNull()
    return rows.select(*[F.when(here, F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")).alias(c) for c in ("chart_id", "period", "block")], "change")


def with_aliases(names: DataFrame, aliases: DataFrame) -> DataFrame:
    """names (raw, core) -> core of the alias where there is one, and whether there was. aliases (raw, normalized) has one row per raw."""
    return names.join(aliases, "raw", "left").select("raw", F.coalesce("normalized", "core").alias("core"), F.when(F.col("normalized").isNotNull(), "alias").otherwise("auto").alias("method"))


def entry_confidence(tags: Column, unit: Column) -> Column:
    """0.85, less for what tags and unit make unsure; karaoke is none at all."""
    count = lambda *kinds: F.size(F.filter(tags, lambda t: t["kind"].isin(*kinds)))
    loss = F.when(has_tag(tags, "medley"), 0.10).otherwise(0.0) + F.when(has_tag(tags, "live"), 0.05).otherwise(0.0) + 0.10 * count("re_recording")
    loss = loss + F.when(unit == "single_release", 0.10).when(unit == "medley", 0.15).when(unit == "unknown", 0.20).otherwise(0.0)
    return F.when(has_tag(tags, "karaoke"), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(0.85) - loss)))


def link_works(entries: DataFrame, least: float = 0.60) -> DataFrame:
    """entries (…, artist_raw, title_raw) with work_key, confidence and method; too little confidence leaves the work out."""
    from chartloom.functions.normalize import entry_unit

    rows = entries.withColumn("_t", normalize_title(F.col("title_raw"))).withColumn("_a", artist_core(F.col("artist_raw")))
    key = ids.work_key(F.col("_a"), F.col("_t.core"))
    confidence = F.when(key.isNull(), 0.0).otherwise(F.round(entry_confidence(F.col("_t.tags"), entry_unit(F.col("_t.tags"))), 6))
    return rows.withColumn("confidence", confidence).withColumn("work_key", F.when(F.col("confidence") >= least, key)).withColumn("link_method", F.lit("title_artist_year")).drop("_t", "_a")


def link_decisions(entries: DataFrame, decisions: DataFrame) -> DataFrame:
    """entries (entity_id, …) with the confidence of their decision: decided 0.9 unless it says more, indeterminate 0.5, none 0.6."""
    joined = entries.join(decisions.select("entity_id", "state", F.col("crg").alias("release_anchor_id"), "own_confidence"), "entity_id", "left")
    confidence = F.when(F.col("state") == "decided", F.when(F.col("own_confidence") > 0, F.col("own_confidence")).otherwise(0.9)).when(F.col("state") == "indeterminate", 0.5).otherwise(0.6)
    return joined.withColumn("confidence", confidence).withColumn("link_method", F.when(F.col("state") == "decided", "multi_source").otherwise("fallback"))


def link_top_hits(entries: DataFrame, hits: DataFrame) -> DataFrame:
    """entries (artist, title, …) with the surest hit of a search by names, for entries that no rules have judged: (…, hit_id, source, confidence, link_method).

    hits: (artist, title, hit_id, source, confidence), any number for each pair of names; a hit that says nothing of its confidence has 0.7, ties go to the smallest id. Entries
    without a hit get 0.5. Hits are reduced to one for each pair of names before they meet entries.
    """
    sure = F.coalesce("confidence", F.lit(0.7))
    top = hits.filter("artist is not null and title is not null").groupBy("artist", "title").agg(F.min(F.struct((-sure).alias("c"), "hit_id", "source")).alias("_top"))
    joined = entries.join(top, ["artist", "title"], "left")
    found = F.col("_top").isNotNull()
    return joined.withColumns({
        "hit_id": F.col("_top.hit_id"), "source": F.when(found, F.coalesce("_top.source", F.lit("unknown"))),
        "confidence": F.when(found, -F.col("_top.c")).otherwise(0.5), "link_method": F.when(found, "multi_source").otherwise("title_artist_year"),
    }).drop("_top")


def missing_weeks(runs: DataFrame, charts: DataFrame, first_year: int, last_year: int, today: str | None = None) -> DataFrame:
    """Weekly periods YYYY-Www that a chart lacks, up to the ISO week of today if that is given. The last week of a year is the one of 28 December."""
    year, last = F.col("y"), F.weekofyear(F.make_date("y", F.lit(12), F.lit(28)))
    if today is not None:
        day = F.to_date(F.lit(today))
        iso_year = F.year(F.date_add(day, 3 - F.weekday(day)))
        last = F.when(year == iso_year, F.least(last, F.weekofyear(day))).when(year < iso_year, last).otherwise(0)
    years = charts.select("chart_id", F.explode(F.sequence(F.lit(first_year), F.lit(last_year))).alias("y")).withColumn("last", last).filter("last > 0")
    wanted = years.select("chart_id", "y", F.explode(F.sequence(F.lit(1), F.col("last"))).alias("w")).select("chart_id", F.format_string("%04d-W%02d", "y", "w").alias("period"))
    return wanted.join(runs, ["chart_id", "period"], "left_anti")


def missing_years(runs: DataFrame, charts: DataFrame, first_year: int, last_year: int, today: str | None = None) -> DataFrame:
    """Yearly periods YYYY that a chart lacks, up to the ISO year of today if that is given."""
    day = F.to_date(F.lit(today))
    last = F.lit(last_year) if today is None else F.least(F.lit(last_year), F.year(F.date_add(day, 3 - F.weekday(day))))
    years = charts.withColumn("last", last).filter(F.col("last") >= first_year)
    wanted = years.select("chart_id", F.explode(F.sequence(F.lit(first_year), F.col("last"))).alias("y")).select("chart_id", F.format_string("%04d", "y").alias("period"))
    return wanted.join(runs, ["chart_id", "period"], "left_anti")


def missing_months(runs: DataFrame, charts: DataFrame, first: str, last: str, today: str | None = None) -> DataFrame:
    """Monthly periods YYYY-MM that a chart lacks, up to the month of today if that is given."""
    until = F.to_date(F.lit(last)) if today is None else F.least(F.to_date(F.lit(last)), F.to_date(F.lit(today)))
    begin = F.to_date(F.lit(first))
    months = F.explode(F.when(until >= begin, F.sequence(begin, until, F.expr("interval 1 month"))))
    wanted = charts.select("chart_id", months.alias("m")).select("chart_id", F.date_format("m", "yyyy-MM").alias("period"))
    return wanted.join(runs, ["chart_id", "period"], "left_anti")


def merge_tags(existing: DataFrame, new: DataFrame, key: str, core: list[str], extra: list[str], authoritative: bool) -> DataFrame:
    """Tag rows after writing: in authoritative mode new core values replace old ones, which are stashed once under original_…; else
    only the extra fields are added. `written` names the fields that changed, `skipped` the core fields of new tags that aren't taken, as the
    mode leaves them out or they have no value, `stashed` those whose old value was put aside by this.
    """
    joined = existing.join(new.select(key, *[F.col(c).alias(f"new_{c}") for c in core + extra]), key, "left")
    replaced = {c: F.col(f"new_{c}").isNotNull() & ~F.col(c).eqNullSafe(F.col(f"new_{c}")) if authoritative or c in extra else F.lit(False) for c in core + extra}
    stash = {f"original_{c}": F.coalesce(f"original_{c}", F.when(replaced[c], F.col(c))) for c in core if f"original_{c}" in existing.columns}
    written = F.array_join(F.array_compact(F.array(*[F.when(r, F.lit(c)) for c, r in replaced.items()])), ",")
    told = new.select(key).distinct().withColumn("_told", F.lit(True))
    left_out = [F.when(F.col("_told") & (F.lit(not authoritative) | F.col(f"new_{c}").isNull()), F.lit(c)) for c in core]
    aside = [F.when(replaced[c] & F.col(f"original_{c}").isNull() & F.col(c).isNotNull(), F.lit(c)) for c in core if f"original_{c}" in existing.columns]
    names = lambda marks: F.array_join(F.array_compact(F.array(*marks)), ",") if marks else F.lit("")
    joined = joined.join(told, key, "left")
    out = joined.withColumns(stash | {"written": written, "skipped": names(left_out), "stashed": names(aside)}).drop("_told")
    return out.withColumns({c: F.when(r, F.col(f"new_{c}")).otherwise(F.col(c)) for c, r in replaced.items()}).drop(*[f"new_{c}" for c in core + extra])


def charts_blob(scores: DataFrame, positions: DataFrame | None = None, max_bytes: int = 3072) -> DataFrame:
    """Per work {"v":1,"c":[[chart, score, highest, freq, positions?], …]}, best score first; positions go if the text is too long."""
    rows = scores.join(positions, ["work_key", "chart_id"], "left") if positions is not None else scores.withColumn("positions", F.lit(None).cast("string"))
    head = F.concat(F.lit('["'), F.col("chart_id"), F.lit('",'), F.col("score").cast("string"), F.lit(","), F.col("highest").cast("string"), F.lit(',"'), F.col("frequency"), F.lit('"'))
    item = F.struct((-F.col("score")).alias("s"), F.col("highest").alias("h"), F.col("chart_id").alias("c"), head.alias("head"), "positions")
    tail = lambda x, full: F.coalesce(F.concat(F.lit(","), x["positions"]), F.lit("")) if full else F.lit("")

    def body(full: bool) -> Column:
        tuples = F.transform("items", lambda x: F.concat(x["head"], tail(x, full), F.lit("]")))
        return F.concat(F.lit('{"v":1,"c":['), F.array_join(tuples, ","), F.lit("]}"))

    lists = rows.groupBy("work_key").agg(F.array_sort(F.collect_list(item)).alias("items"))
    long, short = body(True), body(False)
    return lists.select("work_key", F.when(F.octet_length(long) <= max_bytes, long).otherwise(short).alias("blob"))


def parse_blob(blobs: DataFrame) -> DataFrame:
    """One row per tuple of a blob; another version is an error, the fifth part may be missing."""
    d = F.from_json("blob", "struct<v:int,c:array<array<string>>>")
    checked = F.when(d["v"] == 1, d["c"]).otherwise(F.raise_error(F.lit("unknown version of a charts blob")))
    rows = blobs.select("work_key", F.explode(checked).alias("t"))
    part = lambda i: F.get("t", F.lit(i))
    return rows.select(
        "work_key",
        part(0).alias("chart_id"),
        part(1).cast("long").alias("score"),
        part(2).cast("int").alias("highest"),
        part(3).alias("frequency"),
        part(4).alias("positions"),
    )


def playlist(entries: DataFrame, files: DataFrame) -> DataFrame:
    """Lines of the entries that the library has a file for, by `library_match`.

    entries: (entry_id, run_id, rank, recording_mbid, artist, title); files: (file_id, recording_mbid, artist, title, seconds, path). Entries keep their own names.
    """
    owned = library_match(entries, files).select("entry_id", "file_id").join(files.select("file_id", "seconds", "path"), "file_id")
    return playlist_lines(entries.select("entry_id", "run_id", "rank", "artist", "title").join(owned, "entry_id"))


def playlist_lines(matched: DataFrame) -> DataFrame:
    """Matched entries as two lines each, in order of rank: a comment with seconds (-1 if they are 0 or unknown) and names, and the path."""
    seconds = F.when(F.col("seconds") != 0, F.col("seconds")).otherwise(-1)
    note = F.concat(F.lit("#EXTINF:"), seconds.cast("string"), F.lit(","), F.col("artist"), F.lit(" - "), F.col("title"))
    return matched.select("run_id", "rank", F.posexplode(F.array(note, F.col("path"))).alias("part", "line"))
