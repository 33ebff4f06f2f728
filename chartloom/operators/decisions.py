"""Stored decisions, their history, drift, and review."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartloom.functions.ids import short_hash


def store(current: DataFrame, new: DataFrame, now: Column, key: str = "file_id") -> tuple[DataFrame, DataFrame]:
    """(current, archived): new decisions take the place of old ones, which go to the history; created_at stays, updated_at is now."""
    fields = [c for c in new.columns if c != key]
    joined = current.select(key, *[F.col(c).alias(f"old_{c}") for c in fields], "created_at", F.lit(True).alias("_had")).join(new.withColumn("_new", F.lit(True)), key, "full")
    value = lambda c: F.when(F.col("_new"), F.col(c)).otherwise(F.col(f"old_{c}")).alias(c)
    merged = joined.select(key, *[value(c) for c in fields], F.coalesce("created_at", now).alias("created_at"), F.when(F.col("_new"), now).alias("updated_at"))
    archived = joined.filter("_had and _new").select(key, *[F.col(f"old_{c}").alias(c) for c in fields], "created_at", now.alias("archived_at"), F.lit("refresh").alias("reason"))
    return merged, archived


def drift(stored: DataFrame, new: DataFrame, key: str = "entity_id") -> DataFrame:
    """Whether a recomputed decision differs from the stored one, and from what: new evidence, new rules, both or neither.

    The same choice is no drift, whatever else changed.
    """
    old = stored.select(key, *[F.col(c).alias(f"old_{c}") for c in ("crg", "rr", "evidence_hash", "ruleset_version")], F.lit(True).alias("_had"))
    rows = new.join(old, key, "left")
    same = F.col("crg").eqNullSafe(F.col("old_crg")) & F.col("rr").eqNullSafe(F.col("old_rr"))
    evidence, rules = ~F.col("evidence_hash").eqNullSafe(F.col("old_evidence_hash")), ~F.col("ruleset_version").eqNullSafe(F.col("old_ruleset_version"))
    state = F.when(F.col("_had").isNull(), "DECIDED").when(same, None).when(evidence & rules, "STALE-BOTH").when(evidence, "STALE-EVIDENCE").when(rules, "STALE-RULES").otherwise("STALE-NONDETERMINISTIC")
    return rows.select(key, state.isNotNull().alias("drifted"), state.alias("state"))


def outcome(answers: DataFrame, candidates: DataFrame, releases: DataFrame, accept: float = 0.85, review: float = 0.60) -> DataFrame:
    """What becomes of a judge's answers: errors if the group isn't among the evidence or the release isn't in the group, else by confidence."""
    known = candidates.select("entity_id", "rg_mbid").distinct().withColumn("_rg", F.lit(True))
    inside = releases.select(F.col("release_mbid"), F.col("rg_mbid"), F.lit(True).alias("_rel"))
    rows = answers.join(known, ["entity_id", "rg_mbid"], "left").join(inside, ["release_mbid", "rg_mbid"], "left")
    bad = F.col("_rg").isNull() | (F.col("release_mbid").isNotNull() & F.col("_rel").isNull())
    state = F.when(bad, "error").when(F.col("confidence") >= accept, "accepted").when(F.col("confidence") >= review, "review").otherwise("rejected")
    return rows.select("entity_id", "rg_mbid", "release_mbid", "confidence", state.alias("outcome"))


def best_answers(outcomes: DataFrame, which: str) -> DataFrame:
    """One answer with that outcome per entity: the surest; of equally sure ones the one with the least ids."""
    order = F.struct((-F.col("confidence")).alias("c"), "rg_mbid", "release_mbid")
    rows = outcomes.filter(F.col("outcome") == which).groupBy("entity_id").agg(F.min(order).alias("_best"))
    return rows.select("entity_id", "_best.rg_mbid", "_best.release_mbid", (-F.col("_best.c")).alias("confidence"))


def apply_outcomes(decisions: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Accepted answers decide what the rules left open, the surest one for each entity; both rationales say so."""
    accepted = best_answers(outcomes, "accepted").select("entity_id", F.col("rg_mbid").alias("a_rg"), F.col("release_mbid").alias("a_rel"), F.lit(True).alias("_a"))
    rows = decisions.join(accepted, "entity_id", "left")
    hit = (F.col("state") == "indeterminate") & F.coalesce("_a", F.lit(False))
    return rows.withColumns({
        "crg": F.when(hit, F.col("a_rg")).otherwise(F.col("crg")), "rr": F.when(hit, F.col("a_rel")).otherwise(F.col("rr")),
        "crg_rationale": F.when(hit, "CRG:LLM_ADJUDICATION").otherwise(F.col("crg_rationale")), "rr_rationale": F.when(hit, "RR:LLM_ADJUDICATION").otherwise(F.col("rr_rationale")),
        "state": F.when(hit, "decided").otherwise(F.col("state")),
    }).drop("a_rg", "a_rel", "_a")


def review_items(decisions: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Queue items for what stays open after all answers: entities that the rules left open, that no answer decides and for which one waits for review.

    The id is a hash of entity and suggestion, so that an item that is made again is the same one.
    """
    waiting = best_answers(outcomes, "review").join(best_answers(outcomes, "accepted").select("entity_id"), "entity_id", "left_anti")
    rows = decisions.filter("state = 'indeterminate'").select("entity_id").join(waiting, "entity_id")
    text = F.concat_ws(":", F.lit("llm"), "entity_id", F.coalesce("rg_mbid", F.lit("")), F.coalesce("release_mbid", F.lit("")))
    return rows.select(short_hash(text).alias("review_id"), "entity_id", F.lit("llm_review").alias("source"), "rg_mbid", "release_mbid", "confidence")


def complete_reviews(pending: DataFrame, actions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(queue, history, overrides) after actions (review_id, action, at): only open items are completed, by the earliest action on them;
    accepting one makes an override of its track, else its file.
    """
    actions = actions.groupBy("review_id").agg(F.min(F.struct("at", "action")).alias("_first")).select("review_id", "_first.action", "_first.at")
    open_items = pending.filter("reviewed_at is null")
    done = open_items.join(actions, "review_id")
    queue = pending.join(actions.select("review_id", "action", F.col("at").alias("_at")), "review_id", "left").withColumn("reviewed_at", F.coalesce("reviewed_at", "_at")).drop("_at")
    overrides = done.filter("action = 'accept'").select(F.when(F.col("track_key").isNotNull(), "track").otherwise("file").alias("scope"), F.coalesce("track_key", "entity_id").alias("scope_key"), F.col("rg_mbid").alias("target_rg"))
    return queue, done.select("review_id", "action", F.col("at").alias("completed_at")), overrides


def pin(decisions: DataFrame, changes: DataFrame, key: str = "file_id") -> DataFrame:
    """Decisions with the state that changes (key, new_state, pinned) give them, where they give one, and whether they are pinned.

    A decision without a change stays as it is, unpinned if it says nothing else; of several changes of a key the largest by (pinned, new_state) counts.
    """
    one = changes.groupBy(key).agg(F.max(F.struct("pinned", "new_state")).alias("_change"))
    before = F.col("pinned") if "pinned" in decisions.columns else F.lit(False)
    rows = decisions.join(one, key, "left")
    return rows.withColumns({"state": F.coalesce("_change.new_state", "state"), "pinned": F.coalesce("_change.pinned", before, F.lit(False))}).drop("_change")


def pending_batch(decisions: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Entities that the rules left open and that no review waits for."""
    return decisions.filter("state = 'indeterminate'").join(outcomes.filter("outcome = 'review'"), "entity_id", "left_anti").select("entity_id")


def pending_in_session(decisions: DataFrame, results: DataFrame, session: str) -> DataFrame:
    """Entities that the rules left open and that a session (results: session_id, entity_id) hasn't processed yet, whatever came of it."""
    return decisions.filter("state = 'indeterminate'").join(results.filter(F.col("session_id") == session), "entity_id", "left_anti").select("entity_id")


def pending_reviews(queue: DataFrame, source: str | None = None, prefix: str = "") -> DataFrame:
    """Open items of the queue, of one source if one is named, whose id begins with a prefix."""
    rows = queue.filter(F.col("reviewed_at").isNull() & F.col("review_id").startswith(prefix))
    return rows if source is None else rows.filter(F.col("source") == source)


def review_stats(queue: DataFrame) -> DataFrame:
    """Counts of open items by source and of done ones by action, each with its total, in one pass of grouping sets."""
    rows = queue.withColumn("done", F.col("reviewed_at").isNotNull())
    out = rows.groupingSets([["done"], ["done", "source"], ["done", "action"]], "done", "source", "action").agg(F.count("*").alias("n"), F.grouping("source").alias("gs"), F.grouping("action").alias("ga"))
    wanted = ((F.col("gs") == 1) & (F.col("ga") == 1)) | ((F.col("gs") == 0) & ~F.col("done")) | ((F.col("ga") == 0) & F.col("done"))
    return out.filter(wanted).select("done", "source", "action", "n")


def session_stats(results: DataFrame) -> DataFrame:
    """Per session the numbers of each outcome and the share accepted; 100 when nothing was processed."""
    n = lambda x: F.count_if(F.col("outcome") == x)
    rate = F.when(F.count("outcome") == 0, F.lit(100.0)).otherwise(F.round(n("accepted") * 100.0 / F.count("outcome"), 6))
    return results.groupBy("session_id").agg(*[n(x).alias(x) for x in ("accepted", "review", "rejected", "error")], F.count("outcome").alias("processed"), rate.alias("success_pct"))


def side_scores(sides: DataFrame, near: float = 0.05) -> DataFrame:
    """Weighted evidence of each side of an entry; two sides within `near` of the best, one of them sure, both count."""
    weights = {"e1": 0.40, "e2": 0.25, "e3": 0.20, "e4": 0.10, "e5": 0.05}
    score = F.round(reduce(lambda a, b: a + b, [F.col(c) * w for c, w in weights.items()]), 6)
    rows = sides.withColumn("confidence", score)
    best = rows.groupBy("entry_id").agg(F.max("confidence").alias("best"))
    joined = rows.join(best, "entry_id")
    chosen = (F.col("best") >= 0.60) & ((F.col("confidence") == F.col("best")) | ((F.col("best") >= 0.85) & (F.col("best") - F.col("confidence") <= near + 1e-9)))
    band = F.when(F.col("confidence") >= 0.85, "auto").when(F.col("confidence") >= 0.60, "review").otherwise("reject")
    return joined.select("entry_id", "side", "confidence", band.alias("band"), chosen.alias("chosen"))


def reissue_guard(releases: DataFrame, gap_years: int = 10, terms: str = "remaster|reissue|anniversary|deluxe") -> DataFrame:
    """Releases without reissues: a term in the title, or many years after the group's first date; a group of nothing but reissues keeps all."""
    from pyspark.sql import Window

    w = Window.partitionBy("rg_mbid")
    year = F.substring("date", 1, 4).cast("int")
    late = F.coalesce(year - F.min(year).over(w) >= gap_years, F.lit(False))
    rows = releases.withColumn("_again", F.lower("title").rlike(terms) | late)
    return rows.withColumn("_fresh", F.count_if(~F.col("_again")).over(w)).filter("not _again or _fresh = 0").drop("_again", "_fresh")


def break_ties(releases: DataFrame, labels: list[str]) -> DataFrame:
    """One release per group and date: by order of labels, lowest catalogue number, id."""
    from chartloom.operators.search import dedupe_first

    place = F.array_position(F.array(*[F.lit(x) for x in labels]), F.col("label"))
    return dedupe_first(releases.withColumn("_l", F.when(place == 0, len(labels) + 1).otherwise(place)), ["rg_mbid", "date"], ["_l", F.col("catno").asc_nulls_last(), "release_mbid"]).drop("_l")
