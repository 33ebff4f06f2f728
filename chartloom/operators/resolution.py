"""Canonical release group and representative release of every entity, by rules over whole tables.

Candidates are one row per (entity, release group). Each rule is a count and a choice among the rows at some earliest date, so
all rules together need one aggregate that merges (earliest()), and no window. Dates are texts of mixed precision
and compare as texts; only the lead window pads them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chartloom.sources.shared import materialize

#: Which kind of release group is looked at first.
BUCKETS = ["studio_album", "ep", "soundtrack", "single", "other"]


def padded(date: Column) -> Column:
    """The first day that a date text can mean; null if it isn't a date."""
    full = F.when(F.length(date) == 4, F.concat(date, F.lit("-01-01"))).when(F.length(date) == 7, F.concat(date, F.lit("-01"))).otherwise(date)
    return F.try_to_timestamp(full, F.lit("yyyy-MM-dd")).cast("date")


def distinct_candidates(candidates: DataFrame) -> DataFrame:
    """One row per entity and release group, with the earliest date."""
    return candidates.groupBy("entity_id", "rg_mbid").agg(
        F.min("primary_type").alias("primary_type"), F.min("is_compilation").alias("is_compilation"), F.min(F.nullif("first_release_date", F.lit(""))).alias("date"), F.min("artist_mbid").alias("artist_mbid"), F.min("title").alias("title")
    )


def timeline_facts(candidates: DataFrame) -> DataFrame:
    """Earliest album, single or EP, and soundtrack of each entity; compilations and undated groups don't count."""
    first = lambda *kinds: F.min(F.when(F.col("primary_type").isin(*kinds) & ~F.col("is_compilation"), F.col("date")))
    return distinct_candidates(candidates).groupBy("entity_id").agg(first("Album").alias("album_date"), first("Single", "EP").alias("single_ep_date"), first("Soundtrack").alias("soundtrack_date"))


def earliest(rows: DataFrame, by: list[str], kinds: dict[str, Column], key: str, counts: dict[str, Column] | None = None) -> DataFrame:
    """For each kind of rows (name -> condition) of a group the earliest date d_, the number of rows n_ at that date and their least key rg_.

    The triple is an aggregate that merges: rows are added up by group and date, then of the dates the first one that a kind has is
    taken, both where the rows are read before anything is shuffled. No window, and no group in one place. counts are further sums.
    """
    counts = counts or {}
    dated = {k: F.coalesce(c, F.lit(False)) & F.col("date").isNotNull() for k, c in kinds.items()}
    at_date = [x for k, c in dated.items() for x in (F.count_if(c).alias(f"n_{k}"), F.min(F.when(c, F.col(key))).alias(f"rg_{k}"))]
    days = rows.groupBy(*by, "date").agg(*at_date, *[F.sum(c).alias(f"sum_{k}") for k, c in counts.items()])
    when = {k: F.when(F.col(f"n_{k}") > 0, F.col("date")) for k in kinds}
    first = [x for k, d in when.items() for x in (F.min(d).alias(f"d_{k}"), F.coalesce(F.min_by(f"n_{k}", d), F.lit(0)).alias(f"n_{k}"), F.min_by(f"rg_{k}", d).alias(f"rg_{k}"))]
    return days.groupBy(*by).agg(*first, *[F.sum(f"sum_{k}").alias(k) for k in counts])


def rule_facts(candidates: DataFrame) -> DataFrame:
    """One row per entity with all dates, counts and choices that the rules use; see earliest().

    Fair are the groups that are no compilations, or all if there are only compilations.
    """
    kind, comp = F.col("primary_type"), F.col("is_compilation")
    album, single = kind == "Album", kind.isin("Single", "EP")
    kinds = {
        "all": F.lit(True), "soundtrack": kind == "Soundtrack", "album": album & ~comp, "single": single & ~comp, "live": kind == "Live", "nonlive": kind != "Live",
        "own": ~comp, "all_album": album, "all_single": single,
    }
    one = F.lit(1).cast("long")
    # Dealt by entity once, for the distinct groups, the dates and the entities.
    facts = earliest(distinct_candidates(candidates.repartition("entity_id")), ["entity_id"], kinds, "rg_mbid", {"n_rgs": one, "own_rgs": F.when(~comp, one).otherwise(0)})
    own = F.col("own_rgs") > 0
    either = lambda mine, other: F.when(own, mine).otherwise(other)
    # Kinds at the fair date: their own earliest date is no earlier than it, so they stand at it if it is the same.
    at_fair = lambda k, a: F.when(F.col(f"d_{k}") == F.col("d_fair"), F.col(f"{a}_{k}"))
    facts = facts.withColumns({f"{a}_fair": either(F.col(f"{a}_own"), F.col(f"{a}_all")) for a in ("d", "n", "rg")})
    of = lambda mine, other, a: either(at_fair(mine, a), at_fair(other, a))
    return facts.withColumns({"n_fair_album": F.coalesce(of("album", "all_album", "n"), F.lit(0)), "rg_fair_album": of("album", "all_album", "rg"), "n_fair_single": F.coalesce(of("single", "all_single", "n"), F.lit(0))})


def delta_days() -> Column:
    return F.datediff(padded(F.col("d_album")), padded(F.col("d_single")))


def rule_soundtrack() -> Column:
    """A soundtrack at the earliest date of all, alone there."""
    return F.when((F.col("d_soundtrack") == F.col("d_all")) & (F.col("n_soundtrack") == 1), F.col("rg_soundtrack"))


def rule_album_lead(days: int) -> Column:
    """An album that follows the first single within the lead window."""
    return F.when((delta_days() > 0) & (delta_days() <= days) & (F.col("n_album") == 1), F.col("rg_album"))


def rule_single_first(days: int) -> Column:
    """A single or EP with no album, or one long after."""
    return F.when(F.col("d_single").isNotNull() & (F.col("d_album").isNull() | (delta_days() > days)) & (F.col("n_single") == 1), F.col("rg_single"))


def rule_live() -> Column:
    """A live release before everything else."""
    return F.when((F.col("d_nonlive").isNull() | (F.col("d_live") < F.col("d_nonlive"))) & (F.col("n_live") == 1), F.col("rg_live"))


def rule_earliest() -> Column:
    return F.when(F.col("n_fair") == 1, F.col("rg_fair"))


def rule_same_date() -> Column:
    """Of several at the earliest date the one album, if a single or EP is among them."""
    return F.when((F.col("n_fair") > 1) & (F.col("n_fair_album") == 1) & (F.col("n_fair_single") > 0), F.col("rg_fair_album"))


def rule_intent(candidates: DataFrame, wanted: str) -> DataFrame:
    """The earliest group that fits a file's intent, `single` or `remix`, alone at its date. Off in the chain of rules unless asked for."""
    kinds = F.col("primary_type").isin("Single", "EP") if wanted == "single" else F.col("primary_type").isin("Remix", "DJ-mix")
    return earliest(distinct_candidates(candidates), ["entity_id"], {"fit": kinds}, "rg_mbid").filter("n_fit = 1").select("entity_id", F.col("rg_fit").alias("rg_mbid"))


def select_crg(candidates: DataFrame, lead_days: int = 90) -> DataFrame:
    """(entity_id, crg, rationale, missing): the first rule that fits; missing says why none does."""
    chain = [
        ("CRG:SOUNDTRACK_PREMIERE", rule_soundtrack()),
        ("CRG:ALBUM_LEAD_WINDOW", rule_album_lead(lead_days)),
        ("CRG:SINGLE_TRUE_PREMIERE", rule_single_first(lead_days)),
        ("CRG:LIVE_ONLY_PREMIERE", rule_live()),
        ("CRG:EARLIEST_OFFICIAL", rule_earliest()),
        ("CRG:ALBUM_SAME_DATE_TIEBREAKER", rule_same_date()),
    ]
    facts = rule_facts(candidates)
    crg = F.coalesce(*[c for _, c in chain])
    name = F.coalesce(*[F.when(c.isNotNull(), F.lit(n)) for n, c in chain], F.lit("CRG:INDETERMINATE"))
    missing = F.when(crg.isNotNull(), None).when(F.col("n_fair") > 1, F.concat(F.lit("tie_between_"), F.col("n_fair").cast("string"), F.lit("_release_groups_with_same_earliest_date"))).otherwise("no_release_dates")
    return facts.select("entity_id", crg.alias("crg"), name.alias("crg_rationale"), missing.alias("crg_missing"))


def select_rr(chosen: DataFrame, releases: DataFrame) -> DataFrame:
    """(entity_id, crg, country) -> (entity_id, rr, rationale, missing).

    Official releases, else promotional ones; of these the earliest of the artist's country, else of the world; a tie decides nothing.
    """
    rows = releases.select(F.col("rg_mbid").alias("group"), "release_mbid", "date", "country", "is_official", "is_promo")
    rows = rows.join(chosen.select(F.col("crg").alias("group")).distinct(), "group", "left_semi")
    kinds = {"official": F.col("is_official"), "promo": F.col("is_promo")}
    one = lambda c: F.when(c, 1).otherwise(0).cast("long")
    counts = {"n": F.lit(1).cast("long"), "all_official": one(F.col("is_official")), "all_promo": one(F.col("is_promo"))}
    # Once for each group, and each group and country; entities meet these few rows, never the releases.
    world, local = earliest(rows, ["group"], kinds, "release_mbid", counts), earliest(rows.filter("country is not null"), ["group", "country"], kinds, "release_mbid")
    official = F.col("all_official") > 0
    usable = lambda a: F.when(official, F.col(f"{a}_official")).otherwise(F.col(f"{a}_promo"))
    names = {"d": "d", "n": "n", "rg": "rr"}
    of_world = world.select(F.col("group").alias("crg"), "n", official.alias("has_official"), usable("all").alias("n_usable"), *[usable(a).alias(f"{to}_world") for a, to in names.items()])
    of_local = local.select(F.col("group").alias("crg"), F.col("country").alias("origin"), *[f"{a}_{k}" for a in names for k in kinds])
    met = chosen.select("entity_id", "crg", F.col("country").alias("origin")).join(of_world, "crg", "left").join(of_local, ["crg", "origin"], "left")
    facts = met.withColumns({"n": F.coalesce("n", F.lit(0)), "n_usable": F.coalesce("n_usable", F.lit(0))} | {f"{to}_local": F.when(F.col("has_official"), F.col(f"{a}_official")).otherwise(F.col(f"{a}_promo")) for a, to in names.items()})
    has_local = F.col("d_local").isNotNull()
    rr = F.when(has_local, F.when(F.col("n_local") == 1, F.col("rr_local"))).when(F.col("n_world") == 1, F.col("rr_world"))
    name = F.when(rr.isNull(), "RR:INDETERMINATE").when(has_local, "RR:ORIGIN_COUNTRY_EARLIEST").otherwise("RR:WORLD_EARLIEST")
    tie = lambda n, where: F.concat(F.lit("tie_between_"), F.col(n).cast("string"), F.lit(f"_{where}_releases_on_same_date"))
    missing = (
        F.when(rr.isNotNull(), None).when(F.col("n") == 0, "no_releases_in_crg").when(F.col("n_usable") == 0, "no_official_releases")
        .when(has_local, tie("n_local", "origin_country")).when(F.col("d_world").isNull(), "no_release_dates").otherwise(tie("n_world", "worldwide"))
    )
    return facts.select("entity_id", rr.alias("rr"), name.alias("rr_rationale"), missing.alias("rr_missing"))


def resolve(candidates: DataFrame, releases: DataFrame, groups: DataFrame, artists: DataFrame, lead_days: int = 90) -> DataFrame:
    """Release group, release, rationales, state and what is missing, one row per entity."""
    crg = materialize(select_crg(candidates, lead_days))
    origin = groups.select(F.col("rg_mbid").alias("crg"), "artist_mbid").join(artists.select("artist_mbid", "country"), "artist_mbid", "left").select("crg", "country")
    rr = select_rr(crg.filter("crg is not null").join(origin, "crg", "left"), releases)
    state = F.when(F.col("rr").isNotNull(), "decided").otherwise("indeterminate")
    missing = F.concat_ws(",", "crg_missing", "rr_missing")
    return crg.join(rr, "entity_id", "left").select("entity_id", "crg", "rr", "crg_rationale", F.coalesce("rr_rationale", F.lit("RR:INDETERMINATE")).alias("rr_rationale"), state.alias("state"), missing.alias("missing_facts"))


def bundle_errors(candidates: DataFrame) -> DataFrame:
    """(entity_id, error): what keeps an entity's candidates from being judged, the first by name; entities without a fault have no row."""
    date = F.nullif("first_release_date", F.lit(""))
    fault = (
        F.when(F.col("rg_mbid").isNull(), "candidate_without_release_group")
        .when(F.col("primary_type").isNull() | F.col("is_compilation").isNull(), "candidate_without_type")
        .when(date.isNotNull() & (~date.rlike(r"^[0-9]{4}(-[0-9]{2}(-[0-9]{2})?)?$") | padded(date).isNull()), "date_not_readable")
    )
    return candidates.withColumn("_e", fault).filter("_e is not null").groupBy("entity_id").agg(F.min("_e").alias("error"))


def decide_batch(candidates: DataFrame, releases: DataFrame, groups: DataFrame, artists: DataFrame, lead_days: int = 90, continue_on_error: bool = True) -> DataFrame:
    """What resolve gives for every entity, with a column error; faulty entities have an error and no decision, or, if the batch is to stop, make the job fail."""
    errors = bundle_errors(candidates)
    sound = candidates.join(errors.select("entity_id"), "entity_id", "left_anti")
    decided = resolve(sound, releases, groups, artists, lead_days).withColumn("error", F.lit(None).cast("string"))
    if not continue_on_error:
        errors = errors.withColumn("error", F.raise_error(F.concat_ws(": ", "entity_id", "error")).cast("string"))
    return decided.unionByName(errors, allowMissingColumns=True)


def batch_summary(decided: DataFrame) -> DataFrame:
    """Numbers of decisions by rationale and state, and of errors by kind."""
    return decided.groupBy("crg_rationale", "rr_rationale", "state", "error").agg(F.count("*").alias("n"))


def evidence_hash(candidates: DataFrame) -> DataFrame:
    """A digest of what is known of each entity: fields in a fixed order, groups sorted, null unlike empty; nothing volatile."""
    field = lambda c: F.when(F.col(c).isNull(), "~").otherwise(F.concat(F.lit("="), F.col(c).cast("string")))
    line = F.concat_ws("|", *[field(c) for c in ("rg_mbid", "primary_type", "is_compilation", "date")])
    # The lines of an entity end up in one place anyway, so they are dealt by entity once, for both steps.
    return distinct_candidates(candidates.repartition("entity_id")).groupBy("entity_id").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("evidence_hash"))


def compact_trace(decisions: DataFrame, hashes: DataFrame, sources: DataFrame, lead_days: int = 90, gap_years: int = 10) -> DataFrame:
    """The decision as one short text: evidence, rationales, sources and settings."""
    named = sources.select("entity_id", "source").distinct().groupBy("entity_id").agg(F.array_join(F.array_sort(F.collect_set("source")), ",").alias("src"))
    joined = decisions.join(hashes, "entity_id", "left").join(named, "entity_id", "left")
    short = F.coalesce(F.substring("evidence_hash", 1, 8), F.lit("unknown"))
    code = lambda c: F.replace(F.replace(F.col(c), F.lit("CRG:"), F.lit("")), F.lit("RR:"), F.lit(""))
    return joined.select("entity_id", F.concat(F.lit("evh="), short, F.lit(";crg="), code("crg_rationale"), F.lit(";rr="), code("rr_rationale"), F.lit(";src="), F.coalesce("src", F.lit("")), F.lit(f";cfg=lw{lead_days},rg{gap_years}")).alias("trace"))


def bucket() -> Column:
    kind, comp = F.lower("primary_type"), F.col("is_compilation")
    return F.when(kind == "soundtrack", "soundtrack").when((kind == "album") & ~comp, "studio_album").when(kind == "ep", "ep").when(kind == "single", "single").otherwise("other")


def bucketed(candidates: DataFrame) -> DataFrame:
    """Candidates with their bucket and place in it: by date, undated last; titles part only undated ones, ids the rest."""
    title = F.when(F.col("date").isNull(), F.col("title"))
    w = Window.partitionBy("entity_id", "bucket").orderBy(F.col("date").asc_nulls_last(), title, "rg_mbid")
    return distinct_candidates(candidates).withColumn("bucket", bucket()).withColumn("place", F.row_number().over(w))


def bucket_best(candidates: DataFrame) -> DataFrame:
    """The first group of the first bucket that has any."""
    order = F.array_position(F.array(*[F.lit(b) for b in BUCKETS]), F.col("bucket"))
    first = bucketed(candidates).filter("place = 1")
    return first.groupBy("entity_id").agg(F.min_by(F.struct("bucket", "rg_mbid"), order).alias("b")).select("entity_id", "b.bucket", "b.rg_mbid")


def needs_adjudication(candidates: DataFrame) -> DataFrame:
    """Whether a judge is needed: not with one bucket; with a dated album if something else came before it; else with several."""
    b = F.col("bucket")
    first = lambda x: F.min(F.when(b == x, F.col("date")))
    facts = bucketed(candidates).groupBy("entity_id").agg(F.count_distinct("bucket").alias("n_buckets"), first("studio_album").alias("album"), F.min(F.when(b.isin("soundtrack", "single", "ep"), F.col("date"))).alias("rival"))
    need = F.when(F.col("n_buckets") <= 1, False).when(F.col("album").isNotNull(), F.coalesce(F.col("rival") < F.col("album"), F.lit(False))).otherwise(True)
    return facts.select("entity_id", "n_buckets", need.alias("needs"))


def sufficient_locally(candidates: DataFrame, least: int = 3) -> DataFrame:
    """Entities with enough release groups at hand; the others are the work list of an outside search."""
    return candidates.groupBy("entity_id").agg(F.count_distinct("rg_mbid").alias("n_rgs")).withColumn("sufficient", F.col("n_rgs") >= least)


def evidence_groups(candidates: DataFrame, releases: DataFrame) -> DataFrame:
    """distinct_candidates, each with its releases in order of id. Rows are dealt by group once, for all steps, and releases meet them without being shuffled again."""
    nested = releases.groupBy("rg_mbid").agg(F.array_sort(F.collect_list(F.struct("release_mbid", "date", "country", F.coalesce("is_official", F.lit(True)).alias("is_official")))).alias("releases"))
    none = F.array().cast(nested.schema["releases"].dataType)
    return distinct_candidates(candidates.repartition("rg_mbid")).join(nested, "rg_mbid", "left").withColumn("releases", F.coalesce("releases", none))


def evidence_bundle(candidates: DataFrame, releases: DataFrame, artists: DataFrame | None = None, recordings: DataFrame | None = None) -> DataFrame:
    """One nested document per entity: its groups in order of id, each with its releases in order of id, and if the tables are given, its artist and recordings.

    The artist is that of the first group by id that has one, null if the table doesn't know it. Recordings (candidates need recording_mbid) stand in order of id; one that the table
    doesn't know has the title and artist of its candidates, the first by value, and no length or codes.
    """
    groups = distinct_candidates(candidates)
    out = evidence_groups(candidates, releases).groupBy("entity_id").agg(F.array_sort(F.collect_list(F.struct("rg_mbid", "title", "primary_type", "date", "releases"))).alias("rg_candidates"))
    if artists is not None:
        first = groups.filter("artist_mbid is not null").groupBy("entity_id").agg(F.min_by("artist_mbid", "rg_mbid").alias("artist_mbid"))
        known = first.join(artists, "artist_mbid").select("entity_id", F.struct("artist_mbid", "name", "country").alias("artist"))
        out = out.join(known, "entity_id", "left")
    if recordings is not None:
        own = candidates.filter("recording_mbid is not null").groupBy("entity_id", "recording_mbid").agg(F.min("title").alias("_title"), F.min("artist_mbid").alias("_artist"))
        rec = recordings.select("recording_mbid", F.lit(True).alias("_known"), F.col("title").alias("_t"), F.col("artist_mbid").alias("_a"), "length_ms", "isrcs")
        value = lambda table, candidate: F.when(F.col("_known"), F.col(table)).otherwise(F.col(candidate))
        one = F.struct("recording_mbid", value("_t", "_title").alias("title"), value("_a", "_artist").alias("artist_mbid"), "length_ms", F.coalesce("isrcs", F.array().cast("array<string>")).alias("isrcs"))
        lists = own.join(rec, "recording_mbid", "left").groupBy("entity_id").agg(F.array_sort(F.collect_list(one)).alias("recordings"))
        out = out.join(lists, "entity_id", "left")
    return out


def apply_overrides(decisions: DataFrame, rules: DataFrame) -> DataFrame:
    """Decisions with the newest override of the closest scope: file before track before artist.

    rules: (scope, scope_key, target_rg, target_release, directive, created_at); a directive may hold prefer_rg=… and prefer_release=….
    A rule applies only if it names a release group.
    """
    part = lambda name: F.nullif(F.regexp_extract(F.col("directive"), rf"{name}=([^;\s]+)", 1), F.lit(""))
    named = rules.select("scope", "scope_key", F.coalesce("target_rg", part("prefer_rg")).alias("o_rg"), F.coalesce("target_release", part("prefer_release")).alias("o_release"), "created_at").filter("o_rg is not null")
    newest = named.groupBy("scope", "scope_key").agg(F.max_by(F.struct("o_rg", "o_release"), F.struct("created_at", "o_rg")).alias("o"))
    out = decisions
    for scope, key in (("file", "file_key"), ("track", "track_key"), ("artist", "artist_key")):
        out = out.join(newest.filter(F.col("scope") == scope).select(F.col("scope_key").alias(key), F.col("o").alias(f"o_{scope}")), key, "left")
    chosen = F.coalesce("o_file", "o_track", "o_artist")
    hit = chosen.isNotNull()
    return out.withColumns({
        "scope": F.when(F.col("o_file").isNotNull(), "file").when(F.col("o_track").isNotNull(), "track").when(F.col("o_artist").isNotNull(), "artist"),
        "crg_rationale": F.when(hit, "CRG:MANUAL_OVERRIDE").otherwise(F.col("crg_rationale")),
        "rr": F.when(hit, F.coalesce(chosen["o_release"], F.col("rr"))).otherwise(F.col("rr")),
        "crg": F.coalesce(chosen["o_rg"], F.col("crg")),
    }).drop("o_file", "o_track", "o_artist")
