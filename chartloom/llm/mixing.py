"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

Everything is a DataFrame expression. The tokens of a source are laid on circles, one per shard, in an
order that a seeded hash of id and text gives; rows equal in both are one item with their words together, so that many of
them are no burden for a shard. Blocks of equal length are handed to the sources by highest
quotients, then to groups of shards and to shards in the same way, and each shard takes its blocks
from a seeded starting point of its circle; more than one turn repeats documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from chartloom.llm.common import free_names, materialize, n_words, unit_hash


def source_targets(sizes: DataFrame, max_repeats: int = 3) -> DataFrame:
    """Targets of the sources: (source, source_size) -> adds weight and target.

    Sources by code point, null last, weigh 1, 2, 3, repeating, and share all tokens. A target stops at
    max_repeats times its source's size; what is above is shared again by weight. This is water filling:
    by rising cap / weight the capped sources are a prefix, so running sums give the level.
    The table has one row per source, a small dimension.
    """
    order = Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    fill = Window.orderBy(F.col("cap") / F.col("weight"), "place")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    placed = sizes.withColumn("place", F.row_number().over(order)).withColumns(
        {"weight": ((F.col("place") - 1) % 3 + 1).cast("double"), "cap": (F.col("source_size") * max_repeats).cast("double")}
    )
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    # The first source whose cap its level doesn't reach gives the level of all the rest.
    return (
        placed.withColumn("level", level)
        .withColumn("fits", F.when(F.col("cap") >= F.col("level") * F.col("weight"), F.col("level")))
        .withColumn("open_level", F.first("fits", ignorenulls=True).over(fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
        .withColumn("target", F.when(F.col("open_level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("open_level") * F.col("weight"))))
        .select("source", "source_size", "weight", "target")
    )


def apportion(parts: DataFrame, by: list[str], key: str, votes: str, seats: str, cap: str, out: str) -> DataFrame:
    """Sainte-Lague: share `seats` blocks of each parent `by` among its rows by highest quotients votes / (2 s + 1).

    No row gets more than `cap`. The seats of a row are near its exact share, so only quotients near it
    are listed: each row surely gets the seats below that range, and the rest go by rank. A row at its cap
    leaves its seats to the others; caps are turned into seats first.
    """
    w = Window.partitionBy(*by) if by else Window.partitionBy()
    n = F.count("*").over(w)
    share = F.col(seats) * F.col(votes) / F.sum(votes).over(w)
    # Rounding moves the common divisor by at most half a seat per row, shared by votes.
    slack = F.ceil(n * F.col(votes) / F.sum(votes).over(w) / 2 + 1)
    sure = F.greatest(F.lit(0), F.least(F.col(cap), F.floor(share) - slack)).cast("long")
    top = F.least(F.col(cap), F.ceil(share) + slack).cast("long")
    ranged = parts.filter(F.col(votes) > 0).withColumns({"_sure": sure, "_top": top}).withColumn("_left", F.col(seats) - F.sum("_sure").over(w))
    offers = ranged.filter("_top > _sure").select(*by, key, "_left", F.col(votes).alias("_votes"), F.explode(F.sequence("_sure", F.col("_top") - 1)).alias("_s"))
    best = Window.partitionBy(*by).orderBy(F.desc(F.col("_votes") / (2 * F.col("_s") + 1)), F.col(key)) if by else Window.orderBy(F.desc(F.col("_votes") / (2 * F.col("_s") + 1)), F.col(key))
    won = offers.withColumn("_rank", F.row_number().over(best)).filter("_rank <= _left").groupBy(*by, key).agg(F.count("*").alias("_won"))
    on = [parts_col for parts_col in [*by, key]]
    return ranged.join(won, on, "left").withColumn(out, F.col("_sure") + F.coalesce(F.col("_won"), F.lit(0))).drop("_sure", "_top", "_left", "_won")


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    block_words: int = 16,
    max_repeats: int = 3,
    docs_per_shard: int = 256,
    seed: int = 7,
) -> DataFrame:
    """One row per document: id, size, source_size, target of its source, taken words.

    A size is the number of words; null and empty texts have 0 and take nothing. The words taken from a source are a
    whole number of blocks nearest its target in the sense of Sainte-Lague, and no document is taken
    more than max_repeats times. Reruns agree: only the seed and the rows decide.
    Null ids and repeated rows are documents like others; rows equal in id, source and text share what is taken of them evenly, in whole
    words that add up to it. A null source is a source. An empty table gives none.
    """
    items = _mixed_items(_sized(docs, id_col, text_col, source_col), block_words, max_repeats, docs_per_shard, seed)
    # Rows of an item are equal in all that is returned but their share, so they are made from it, those of many in parts.
    parts = items.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / PART))))
    spread = parts.repartition("id", "h", "part").withColumn("i", F.explode(F.sequence(F.col("part") * PART, F.least("n", (F.col("part") + 1) * PART) - 1)))
    return spread.select(F.col("id").alias(id_col), F.floor(F.col("words") / F.col("n")).alias("size"), "source_size", "target", _share("taken", "i", F.col("i") + 1, "n").alias("taken"))


#: Rows or copies of one item that a task makes at once.
PART = 4096


def _share(total: str, begin: str, end: Column, n: str) -> Column:
    """What the places from begin to end of n equal ones have of a total: whole numbers that add up to it."""
    whole, rest = F.floor(F.col(total) / F.col(n)), F.col(total) % F.col(n)
    upto = lambda at: whole * at + F.floor(rest * at / F.col(n))
    return (upto(end) - upto(F.col(begin))).cast("long")


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, row_hash: Column | None = None) -> DataFrame:
    """(id, source, h, size) of each document, written once; h is a hash of the text. With row_hash also row, a hash of the other columns."""
    more = [] if row_hash is None else [row_hash.alias("row")]
    return materialize(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.xxhash64(F.col(text_col)).alias("h"), n_words(F.col(text_col)).alias("size"), *more))


def _mixed_items(rows: DataFrame, block_words: int, max_repeats: int, docs_per_shard: int, seed: int) -> DataFrame:
    """(id, source, h, n, words, source_size, target, taken): rows equal in id, source and text as one."""
    items = materialize(rows.groupBy("id", "source", "h").agg(F.count("*").alias("n"), F.sum("size").alias("words")))
    by_source = items.groupBy("source").agg(F.sum("words").alias("source_size"), F.count("*").alias("n"))
    # A key that equals itself for null, and the two levels of shards: about sqrt(n) groups of sqrt(n) shards.
    source_key = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))
    sources = materialize(
        source_targets(by_source.select("source", "source_size"), max_repeats)
        .join(by_source.select(F.col("source").alias("s2"), "n"), F.col("source").eqNullSafe(F.col("s2")))
        .drop("s2")
        .withColumn("key", source_key)
        .withColumn("wide", F.greatest(F.lit(1), F.ceil(F.sqrt(F.col("n") / docs_per_shard))).cast("int"))
    )
    # The sources are a small dimension; Spark broadcasts them if their size allows.
    spread = items.withColumn("key", source_key).join(sources.select("key", "source_size", "target", "wide"), "key")
    h = lambda k: F.xxhash64(F.col("id"), F.col("h"), F.lit(seed + k))
    spread = spread.withColumns({"grp": F.pmod(h(1), F.col("wide")).cast("int"), "shard": F.pmod(h(2), F.col("wide")).cast("int")})
    shards = materialize(
        spread.groupBy("key", "grp", "shard").agg(F.sum("words").alias("length")).withColumn("cap", F.floor(F.col("length") * max_repeats / block_words))
    )
    groups = shards.groupBy("key", "grp").agg(F.sum("length").alias("length"), F.sum("cap").alias("cap"))
    caps = groups.groupBy("key").agg(F.sum("cap").alias("cap"))
    total = Window.partitionBy()
    top = sources.join(caps, "key").withColumn("seats", F.least(F.round(F.sum("target").over(total) / block_words), F.sum("cap").over(total)).cast("long"))
    source_quota = apportion(top, [], "key", "target", "seats", "cap", "quota").select("key", F.col("quota").alias("seats"))
    group_quota = apportion(groups.join(source_quota, "key"), ["key"], "grp", "length", "seats", "cap", "quota").select("key", "grp", F.col("quota").alias("seats"))
    shard_quota = materialize(apportion(shards.join(group_quota, ["key", "grp"]), ["key", "grp"], "shard", "length", "seats", "cap", "quota").select("key", "grp", "shard", "length", "quota"))
    circle = Window.partitionBy("key", "grp", "shard").orderBy(h(3), "id", "h").rowsBetween(Window.unboundedPreceding, 0)
    placed = spread.join(shard_quota, ["key", "grp", "shard"], "left").withColumn("end", F.sum("words").over(circle)).withColumn("start", F.col("end") - F.col("words"))
    wanted = F.col("quota") * block_words
    turns, rest = F.floor(wanted / F.col("length")).cast("long"), wanted % F.col("length")
    begin = F.floor(unit_hash(F.concat_ws("/", "key", "grp", "shard"), seed) * F.col("length")).cast("long")
    taken = F.coalesce(F.col("turns") * F.col("words") + _overlap(F.lit(0)) + _overlap(F.col("length")), F.lit(0)).cast("long")
    return placed.withColumns({"turns": turns, "begin": begin, "stop": begin + rest}).select("id", "source", "h", "n", "words", "source_size", "target", taken.alias("taken"))


def _overlap(shift: Column) -> Column:
    """Words of [start, end) + shift that fall into [begin, stop)."""
    return F.greatest(F.lit(0), F.least(F.col("end") + shift, F.col("stop")) - F.greatest(F.col("start") + shift, F.col("begin")))


def mixed_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    block_words: int = 16, max_repeats: int = 3, docs_per_shard: int = 256, seed: int = 7,
) -> DataFrame:
    """The mix as rows: a document appears as often as it was taken, a part of it by a seeded draw.

    All columns of docs stay; documents of which nothing is taken go, those without words among them. Rows are told apart by id, source and
    text, any of which may be null; of rows equal in all three, as many copies as the mix takes of them together stay, spread over them
    in the order of a hash of their other columns. An empty table gives no rows.
    """
    names = docs.columns
    other = [F.map_entries(f.name) if isinstance(f.dataType, MapType) else F.col(f"`{f.name}`") for f in docs.schema if f.name not in (id_col, text_col, source_col)]
    row_hash = F.xxhash64(*other) if other else F.lit(0).cast("long")
    sized = _sized(docs, id_col, text_col, source_col, row_hash)
    items = _mixed_items(sized, block_words, max_repeats, docs_per_shard, seed).filter("words > 0 and taken > 0")
    exact = F.col("taken") / F.col("words") * F.col("n")
    drawn = (unit_hash(F.concat_ws("/", F.coalesce(F.col("id").cast("string"), F.lit("-")), F.col("h").cast("string")), seed + 9) < exact - F.floor(exact)).cast("int")
    wanted = items.withColumn("wanted", (F.floor(exact) + drawn).cast("long")).filter("wanted > 0").select("id", "source", "h", "n", "wanted")
    plan = _spread_over_rows(sized, wanted)
    keys = free_names(names, "_id", "_source", "_h", "_row", "_copies", "_repeats")
    plan = materialize(plan.toDF(*keys))
    ident, source, h, row, copies, repeats = keys
    part, own, own_row = free_names([*names, *keys], "_part", "_own", "_own_row")
    keyed = docs.withColumns({own: F.xxhash64(F.col(text_col)), own_row: row_hash})
    same = F.col(id_col).eqNullSafe(F.col(ident)) & F.col(source_col).eqNullSafe(F.col(source)) & (F.col(own) == F.col(h)) & (F.col(own_row) == F.col(row))
    several = F.col(repeats) > 1
    out = keyed.join(plan.filter(~several), same).withColumn(part, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies))))
    if not plan.filter(several).isEmpty():
        # Of rows that are equal throughout one is copied, in parts, so that many copies are no burden for a task.
        one = keyed.join(plan.filter(several), same).dropDuplicates([ident, source, h, row])
        parts = one.withColumn(part, F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(copies) - 1) / PART)))).repartition(F.col(own), F.col(part))
        made = parts.withColumn(part, F.explode(F.sequence(F.col(part) * PART + 1, F.least(F.col(copies), (F.col(part) + 1) * PART))))
        out = out.unionByName(made)
    return out.select(*[F.col(f"`{n}`") for n in names])


def _spread_over_rows(sized: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, source, h, row, copies, repeats): what each kind of equal rows has of the copies of its item.

    The places of an item's rows are running sums over the kinds by hash, first over 1,024 ranges of it, then within each.
    """
    item = ["id", "source", "h"]
    kinds = sized.groupBy(*item, "row").agg(F.count("*").alias("repeats")).withColumn("span", F.shiftright("row", 54))
    spans = kinds.groupBy(*item, "span").agg(F.sum("repeats").alias("in_span"))
    before = Window.partitionBy(*item).orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("base", F.coalesce(F.sum("in_span").over(before), F.lit(0)))
    same = lambda a, b: F.col(f"{a}.id").eqNullSafe(F.col(f"{b}.id")) & F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source")) & (F.col(f"{a}.h") == F.col(f"{b}.h"))
    within = Window.partitionBy(*item, "span").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    placed = kinds.withColumn("inner", F.coalesce(F.sum("repeats").over(within), F.lit(0))).alias("k").join(spans.alias("s"), same("k", "s") & (F.col("k.span") == F.col("s.span")))
    placed = placed.select("k.id", "k.source", "k.h", "row", "repeats", (F.col("base") + F.col("inner")).alias("begin"))
    shared = placed.alias("p").join(wanted.alias("w"), same("p", "w"))
    return shared.select("p.id", "p.source", "p.h", "row", _share("wanted", "begin", F.col("begin") + F.col("repeats"), "n").alias("copies"), "repeats").filter("copies > 0")
