"""The shared test tables seen as chart and catalogue tables, in Spark and in DuckDB's SQL.

Both sides of a view are written out on their own; queries and their SQL twins start from them.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chartloom.functions.ids import short_hash
from chartloom.sources.shared import materialize

DATE_FORMATS = ["yyyy", "yyyy-MM", "yyyy-MM-dd"]


class Views:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def entry(self) -> DataFrame:
        """entry_once, computed once and written, for queries that use it several times."""
        return materialize(self.entry_once)

    @cached_property
    def entry_once(self) -> DataFrame:
        """Ranked entries of monthly charts, one chart per market segment: all parts sold, by revenue."""
        orders = self.table("orders").select("o_orderkey", "o_custkey", F.date_format("o_orderdate", "yyyy-MM").alias("period"))
        customers = self.table("customer").select("c_custkey", F.lower("c_mktsegment").alias("chart_id"))
        lines = self.table("lineitem").select("l_orderkey", "l_partkey", F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")) * 100).cast("long").alias("points"))
        parts = self.table("part").select("p_partkey", "p_brand", "p_name")
        sums = (
            lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
            .join(customers, F.col("o_custkey") == F.col("c_custkey"))
            .groupBy("chart_id", "period", F.col("l_partkey").alias("partkey"))
            .agg(F.sum("points").alias("points"))
        )
        w = Window.partitionBy("chart_id", "period").orderBy(F.desc("points"), "partkey")
        ranked = sums.withColumn("rank", F.row_number().over(w)).join(parts, F.col("partkey") == F.col("p_partkey"))
        run_id = short_hash(F.concat_ws(":", "chart_id", "period"))
        return ranked.select(
            short_hash(F.concat_ws(":", run_id, F.col("rank").cast("string"))).alias("entry_id"),
            run_id.alias("run_id"),
            "chart_id",
            "period",
            "rank",
            "partkey",
            "points",
            F.col("p_brand").alias("artist_raw"),
            F.col("p_name").alias("title_raw"),
            F.when(F.col("partkey") % 3 == 0, F.col("rank") + 1).when(F.col("partkey") % 3 == 1, F.col("rank")).alias("previous_position"),
        )

    @cached_property
    def run(self) -> DataFrame:
        return self.entry.select("run_id", "chart_id", "period").distinct()

    @cached_property
    def chart(self) -> DataFrame:
        segments = self.table("customer").select(F.lower("c_mktsegment").alias("chart_id")).distinct()
        return segments.select("chart_id", F.concat(F.lit("Chart "), "chart_id").alias("name"), F.lit("m").alias("frequency"))

    @cached_property
    def song(self) -> DataFrame:
        pairs = self.table("part").select(F.lower("p_brand").alias("artist_canonical"), F.lower("p_name").alias("title_canonical")).distinct()
        song_id = short_hash(F.concat_ws(" // ", "artist_canonical", "title_canonical"))
        return pairs.select(song_id.alias("song_id"), "*", F.when(song_id < "8", F.concat(F.lit("rec-"), song_id.substr(1, 6))).alias("recording_mbid"))

    @cached_property
    def entry_song(self) -> DataFrame:
        return self.entry.filter("partkey % 7 <> 0").select(
            "entry_id",
            F.lit(0).alias("song_idx"),
            short_hash(F.concat_ws(" // ", F.lower("artist_raw"), F.lower("title_raw"))).alias("song_id"),
            F.lit("auto").alias("link_method"),
            ((F.col("partkey") % 100) / 100.0).alias("link_confidence"),
        )

    @cached_property
    def link(self) -> DataFrame:
        work = short_hash(F.concat_ws(" // ", F.lower("artist_raw"), F.lower("title_raw")))
        return self.entry.filter("partkey % 7 <> 0").select(
            "run_id",
            "chart_id",
            "period",
            "rank",
            "partkey",
            F.when(F.col("partkey") % 11 != 0, work).alias("work_key"),
            F.element_at(F.array(F.lit("isrc"), F.lit("title_artist"), F.lit("fuzzy")), (F.col("partkey") % 3 + 1).cast("int")).alias("link_method"),
            ((F.col("partkey") % 100) / 100.0).alias("confidence"),
        )

    @cached_property
    def recording(self) -> DataFrame:
        owner = self.table("lineitem").groupBy("l_partkey").agg(F.min("l_suppkey").alias("suppkey"))
        return self.table("part").join(owner, F.col("p_partkey") == F.col("l_partkey"), "left").select(
            F.concat(F.lit("r"), "p_partkey").alias("recording_mbid"),
            F.col("p_partkey").alias("partkey"),
            F.col("p_name").alias("title"),
            F.lower("p_name").alias("title_normalized"),
            F.concat(F.lit("a"), "suppkey").alias("artist_mbid"),
            (F.col("p_size") * 1000).alias("length_ms"),
            F.array(F.concat(F.lit("ISRC"), (F.col("p_partkey") % 500).cast("string")), F.concat_ws("-", "p_brand", F.col("p_partkey").cast("string"))).alias("isrcs"),
        )

    @cached_property
    def artist(self) -> DataFrame:
        return self.table("supplier").join(self.table("nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(
            F.concat(F.lit("a"), "s_suppkey").alias("artist_mbid"), F.col("s_name").alias("name"), F.lower("s_name").alias("name_normalized"), F.col("n_name").alias("country")
        )

    @cached_property
    def release(self) -> DataFrame:
        customers = self.table("customer").join(self.table("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")
        return self.table("orders").join(customers, F.col("o_custkey") == F.col("c_custkey")).select(
            F.concat(F.lit("l"), "o_orderkey").alias("release_mbid"),
            F.col("o_orderkey").alias("orderkey"),
            F.concat(F.lit("g"), "o_custkey").alias("rg_mbid"),
            F.when(F.col("o_orderkey") % 10 != 0, partial_date(F.col("o_orderdate"), F.col("o_orderkey"))).alias("date"),
            F.col("n_name").alias("country"),
            (F.col("o_orderstatus") != "P").alias("is_official"),
            (F.col("o_orderstatus") == "P").alias("is_promo"),
        )

    @cached_property
    def recording_release(self) -> DataFrame:
        return self.table("lineitem").select(F.concat(F.lit("r"), "l_partkey").alias("recording_mbid"), F.concat(F.lit("l"), "l_orderkey").alias("release_mbid")).distinct()

    @cached_property
    def rg(self) -> DataFrame:
        first = self.table("orders").groupBy("o_custkey").agg(F.min("o_orderdate").alias("d"))
        kind = F.col("c_mktsegment")
        return self.table("customer").join(first, F.col("c_custkey") == F.col("o_custkey"), "left").select(
            F.concat(F.lit("g"), "c_custkey").alias("rg_mbid"),
            F.col("c_custkey").alias("custkey"),
            F.col("c_name").alias("title"),
            F.concat(F.lit("a"), (F.col("c_custkey") % 100).cast("string")).alias("artist_mbid"),
            F.when(kind == "FURNITURE", "Album").when(kind == "MACHINERY", "Single").when(kind == "HOUSEHOLD", "EP").when(kind == "BUILDING", "Soundtrack").otherwise("Live").alias("type"),
            F.when(F.col("c_custkey") % 5 == 0, "Compilation").alias("secondary_type"),
            F.when(F.col("c_custkey") % 9 != 0, partial_date(F.col("d"), F.col("c_custkey"))).alias("first_release_date"),
        )

    @cached_property
    def candidate(self) -> DataFrame:
        """Release groups of an entity, with the first date at which one of its releases carries it."""
        pairs = (
            self.table("lineitem").select("l_orderkey", "l_partkey")
            .join(self.table("orders").select("o_orderkey", "o_custkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
            # Dealt by customer once, for the groups as well.
            .repartition("o_custkey")
            .groupBy("l_partkey", "o_custkey")
            .agg(F.min("o_orderdate").alias("d"))
        )
        groups = self.rg.select("custkey", "rg_mbid", "title", "type", "secondary_type", "artist_mbid")
        return pairs.join(groups, F.col("o_custkey") == F.col("custkey")).select(
            F.concat(F.lit("e"), "l_partkey").alias("entity_id"),
            F.col("l_partkey").alias("partkey"),
            "rg_mbid",
            "title",
            F.col("type").alias("primary_type"),
            F.col("secondary_type").isNotNull().alias("is_compilation"),
            F.when(F.col("custkey") % 8 != 0, partial_date(F.col("d"), F.col("custkey"))).alias("first_release_date"),
            "artist_mbid",
        )

    @cached_property
    def decision(self) -> DataFrame:
        """What the rules decide for the candidates, written once."""
        from chartloom.operators.resolution import resolve

        # Queries on decisions use the candidates again.
        self.candidate = materialize(self.candidate)
        return materialize(resolve(self.candidate, self.release, self.rg, self.artist))

    @cached_property
    def hit(self) -> DataFrame:
        """Search hits of three sources for the parts that they know, some without names."""
        p = self.table("part")
        year = lambda shift: F.when(F.col("p_partkey") % 13 != 0, (1980 + (F.col("p_partkey") + shift) % 40).cast("string"))
        label = F.concat(F.initcap("p_type"), F.when(F.col("p_partkey") % 2 == 0, " Records").otherwise(" Ltd"))

        def source(name, modulus, base, shift, isrc, popularity):
            return p.filter(F.col("p_partkey") % modulus == 0).select(
                F.concat_ws("-", F.lit(name), F.col("p_partkey").cast("string")).alias("hit_id"),
                F.lit(name).alias("source"),
                F.when(F.col("p_partkey") % 17 == 0, " ").otherwise(F.col("p_name")).alias("title"),
                F.when(F.col("p_partkey") % 17 == 0, "").otherwise(F.col("p_brand")).alias("artist_name"),
                isrc.alias("isrc"),
                label.alias("label"),
                year(shift).alias("year"),
                popularity.cast("int").alias("popularity"),
                F.lit(base).alias("confidence"),
            )

        isrc = F.concat(F.lit("ISRC"), (F.col("p_partkey") % 500).cast("string"))
        none = F.lit(None)
        return (
            source("musicbase_isrc", 2, 0.95, 0, isrc, none)
            .unionByName(source("discbase_text", 3, 0.70, 1, none.cast("string"), none))
            .unionByName(source("streambase_isrc", 5, 0.90, 7, isrc, F.col("p_partkey") % 100))
        )


#: Ranks of a run that go into one document or page, so that what is gathered is bounded however long a chart gets.
BLOCK = 1000


def by_blocks(entries: DataFrame, *keys: str):
    """Entries grouped by the keys and blocks of ranks."""
    return entries.groupBy(*keys, F.floor((F.col("rank") - 1) / BLOCK).alias("block"))


def partial_date(d, key):
    """A date text whose precision (year, month, day) follows from the key."""
    return F.when(key % 3 == 0, F.date_format(d, "yyyy")).when(key % 3 == 1, F.date_format(d, "yyyy-MM")).otherwise(F.date_format(d, "yyyy-MM-dd"))


def _date(d: str, key: str) -> str:
    return f"CASE {key} % 3 WHEN 0 THEN strftime({d}, '%Y') WHEN 1 THEN strftime({d}, '%Y-%m') ELSE strftime({d}, '%Y-%m-%d') END"


def _hits(name: str, modulus: int, base: float, shift: int, isrc: str, popularity: str) -> str:
    return f"""SELECT '{name}-' || p_partkey AS hit_id, '{name}' AS source, CASE WHEN p_partkey % 17 = 0 THEN ' ' ELSE p_name END AS title, CASE WHEN p_partkey % 17 = 0 THEN '' ELSE p_brand END AS artist_name, {isrc} AS isrc,
    upper(p_type[1]) || lower(p_type[2:]) || CASE WHEN p_partkey % 2 = 0 THEN ' Records' ELSE ' Ltd' END AS label,
    CASE WHEN p_partkey % 13 <> 0 THEN CAST(1980 + (p_partkey + {shift}) % 40 AS VARCHAR) END AS year,
    CAST({popularity} AS INTEGER) AS popularity, CAST({base} AS DOUBLE) AS confidence
  FROM part WHERE p_partkey % {modulus} = 0"""


#: The same views in SQL, by name.
SQL = {
    "fv_entry": """SELECT substr(sha256(run_id || ':' || rank), 1, 16) AS entry_id, run_id, chart_id, period, CAST(rank AS INTEGER) AS rank, partkey, points,
    p_brand AS artist_raw, p_name AS title_raw,
    CAST(CASE partkey % 3 WHEN 0 THEN rank + 1 WHEN 1 THEN rank END AS INTEGER) AS previous_position
  FROM (SELECT *, substr(sha256(chart_id || ':' || period), 1, 16) AS run_id, row_number() OVER (PARTITION BY chart_id, period ORDER BY points DESC, partkey) AS rank
    FROM (SELECT lower(c_mktsegment) AS chart_id, strftime(o_orderdate, '%Y-%m') AS period, l_partkey AS partkey,
        CAST(sum(CAST(round(l_extendedprice * (1 - l_discount) * 100) AS BIGINT)) AS BIGINT) AS points
      FROM orders JOIN customer ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2, 3)) x
  JOIN part ON partkey = p_partkey""",
    "fv_run": "SELECT DISTINCT run_id, chart_id, period FROM fv_entry",
    "fv_chart": "SELECT DISTINCT lower(c_mktsegment) AS chart_id, 'Chart ' || lower(c_mktsegment) AS name, 'm' AS frequency FROM customer",
    "fv_song": """SELECT *, CASE WHEN song_id < '8' THEN 'rec-' || substr(song_id, 1, 6) END AS recording_mbid
  FROM (SELECT DISTINCT substr(sha256(lower(p_brand) || ' // ' || lower(p_name)), 1, 16) AS song_id, lower(p_brand) AS artist_canonical, lower(p_name) AS title_canonical FROM part)""",
    "fv_entry_song": """SELECT entry_id, 0 AS song_idx, substr(sha256(lower(artist_raw) || ' // ' || lower(title_raw)), 1, 16) AS song_id, 'auto' AS link_method,
    (partkey % 100) / 100.0 AS link_confidence FROM fv_entry WHERE partkey % 7 <> 0""",
    "fv_link": """SELECT run_id, chart_id, period, rank, partkey,
    CASE WHEN partkey % 11 <> 0 THEN substr(sha256(lower(artist_raw) || ' // ' || lower(title_raw)), 1, 16) END AS work_key,
    ['isrc', 'title_artist', 'fuzzy'][partkey % 3 + 1] AS link_method, (partkey % 100) / 100.0 AS confidence
  FROM fv_entry WHERE partkey % 7 <> 0""",
    "fv_recording": """SELECT 'r' || p_partkey AS recording_mbid, p_partkey AS partkey, p_name AS title, lower(p_name) AS title_normalized, 'a' || suppkey AS artist_mbid,
    p_size * 1000 AS length_ms, ['ISRC' || (p_partkey % 500), p_brand || '-' || p_partkey] AS isrcs
  FROM part LEFT JOIN (SELECT l_partkey, min(l_suppkey) AS suppkey FROM lineitem GROUP BY 1) ON p_partkey = l_partkey""",
    "fv_artist": "SELECT 'a' || s_suppkey AS artist_mbid, s_name AS name, lower(s_name) AS name_normalized, n_name AS country FROM supplier JOIN nation ON s_nationkey = n_nationkey",
    "fv_release": f"""SELECT 'l' || o_orderkey AS release_mbid, o_orderkey AS orderkey, 'g' || o_custkey AS rg_mbid,
    CASE WHEN o_orderkey % 10 <> 0 THEN {_date("o_orderdate", "o_orderkey")} END AS date, n_name AS country, o_orderstatus <> 'P' AS is_official, o_orderstatus = 'P' AS is_promo
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
    "fv_recording_release": "SELECT DISTINCT 'r' || l_partkey AS recording_mbid, 'l' || l_orderkey AS release_mbid FROM lineitem",
    "fv_rg": f"""SELECT 'g' || c_custkey AS rg_mbid, c_custkey AS custkey, c_name AS title, 'a' || (c_custkey % 100) AS artist_mbid,
    CASE c_mktsegment WHEN 'FURNITURE' THEN 'Album' WHEN 'MACHINERY' THEN 'Single' WHEN 'HOUSEHOLD' THEN 'EP' WHEN 'BUILDING' THEN 'Soundtrack' ELSE 'Live' END AS type,
    CASE WHEN c_custkey % 5 = 0 THEN 'Compilation' END AS secondary_type,
    CASE WHEN c_custkey % 9 <> 0 THEN {_date("d", "c_custkey")} END AS first_release_date
  FROM customer LEFT JOIN (SELECT o_custkey, min(o_orderdate) AS d FROM orders GROUP BY 1) ON c_custkey = o_custkey""",
    "fv_candidate": f"""SELECT 'e' || l_partkey AS entity_id, l_partkey AS partkey, rg_mbid, title, type AS primary_type, secondary_type IS NOT NULL AS is_compilation,
    CASE WHEN custkey % 8 <> 0 THEN {_date("d", "custkey")} END AS first_release_date, artist_mbid
  FROM (SELECT l_partkey, o_custkey, min(o_orderdate) AS d FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)
  JOIN fv_rg ON o_custkey = custkey""",
    "fv_hit": " UNION ALL ".join(
        [
            _hits("musicbase_isrc", 2, 0.95, 0, "'ISRC' || (p_partkey % 500)", "NULL"),
            _hits("discbase_text", 3, 0.70, 1, "CAST(NULL AS VARCHAR)", "NULL"),
            _hits("streambase_isrc", 5, 0.90, 7, "'ISRC' || (p_partkey % 500)", "p_partkey % 100"),
        ]
    ),
}


def with_views(body: str, more: dict[str, str] | None = None) -> str:
    """body with the WITH list of all views that it needs, in order."""
    known, chain = SQL | (more or {}), []

    def need(text: str) -> None:
        for name in dict.fromkeys(re.findall(r"\bfv_\w+", text)):
            if name not in chain:
                need(known[name])
                chain.append(name)

    need(body)
    return ("WITH " + ",\n".join(f"{n} AS ({known[n]})" for n in chain) + "\n" if chain else "") + body
