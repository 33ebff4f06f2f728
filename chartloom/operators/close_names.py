"""All pairs of names whose Indel ratio reaches a threshold, without comparing all pairs.

A name is the set of its characters, each numbered where it recurs, in one fixed order from rare to frequent. A pair of names of
lengths n and m with the ratio t has a common subsequence, and so a common set, of o = t (n + m) / 200 characters or more. The first k of the common ones
stand among the first n - o + k of the one and the first m - o + k of the other name. So names meet at a key of k characters,
for the classes of both lengths: k is 1, and grows by one, over and over, below those keys alone that so many names of both sides share that it would pay less to pair
them. No pair is lost at any k, and no key pairs crowds but those whose sets are the same throughout.

Pairs that meet are tested in the join itself: by their lengths, by 128 bits for the sets, whose differing bits are no more than the differing
characters, then by the sets. A pair comes out at its first common characters alone, so once, and only if it shares enough of them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartloom.functions import similarity as sim
from chartloom.sources.shared import materialize

#: Characters from frequent to rare; others count as rarer than all of these. Any order gives the same pairs, this one makes keys rarer.
FREQUENT = " etaoinshrdlcumwfgypbvkjxqz"
#: A key is made longer where pairing its names costs over so many times what passing them on costs, and not beyond so many characters.
CROWD, LONGEST_KEY = 32, 10


def numbered_characters(text: Column) -> Column:
    """The characters of a text as numbers, recurring ones told apart, from rare to frequent; 0 alone for an empty text. Costly: to be computed once for a name."""
    chars = F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.substr(text, i, F.lit(1)))
    rank = lambda c: F.when(F.instr(F.lit(FREQUENT), c) == 0, 0).otherwise(100 - F.instr(F.lit(FREQUENT), c)).cast("long")
    times = lambda c, i: F.size(F.filter(F.slice(chars, F.lit(1), i + 1), lambda x: x == c)).cast("long")
    numbers = F.transform(chars, lambda c, i: F.shiftleft(F.lit(1 << 20) - times(c, i), 40) + F.shiftleft(rank(c), 32) + F.ascii(c))
    return F.when(F.length(text) == 0, F.array(F.lit(0).cast("long"))).otherwise(F.array_sort(numbers))


def length_class(n: Column) -> Column:
    """The least length of the class that n is in: single lengths below 32, then 16 classes for each doubling."""
    width = F.pow(F.lit(2.0), F.floor(F.log2(F.greatest(n, F.lit(32)))) - 4)
    return F.when(n < 32, n).otherwise((F.floor(n / width) * width).cast("int"))


def _last_of(low: Column) -> Column:
    width = F.pow(F.lit(2.0), F.floor(F.log2(F.greatest(low, F.lit(32)))) - 4)
    return F.when(low < 32, low).otherwise((low + width - 1).cast("int"))


ROW = ("name", "n", "chars", "bits0", "bits1")


@dataclass
class CloseNames:
    """The join at one threshold; `left` and `right` have one column of names each."""

    at_least: float
    crowd: int = CROWD
    longest_key: int = LONGEST_KEY

    def names(self, left: DataFrame, right: DataFrame) -> DataFrame:
        """(name, n, chars, bits0, bits1, of_left, of_right) of the distinct names of both sides."""
        sides = left.toDF("name").withColumns({"of_left": F.lit(1), "of_right": F.lit(0)}).unionByName(right.toDF("name").withColumns({"of_left": F.lit(0), "of_right": F.lit(1)}))
        rows = sides.filter("name is not null").groupBy("name").agg(F.max("of_left").alias("of_left"), F.max("of_right").alias("of_right"))
        rows = rows.withColumns({"n": F.length("name"), "chars": numbered_characters(F.col("name"))})
        place = lambda x: F.pmod(F.xxhash64(x), F.lit(128))
        word = lambda k: F.aggregate(F.filter("chars", lambda x: F.floor(place(x) / 64) == k), F.lit(0).cast("long"), lambda s, x: s.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), (place(x) % 64).cast("int"))))
        return rows.withColumns({"bits0": word(0), "bits1": word(1)})

    def _least_common(self, own: Column, other: Column) -> Column:
        return F.greatest(F.lit(1), F.ceil((own + other) * self.at_least / 200.0 - 1e-9).cast("int"))

    def first_keys(self, names: DataFrame, others: list[int], left: bool) -> DataFrame:
        """Rows of names by class of both lengths and each character that may be the first common one: (pair, key, name, n, bits, spare, last)."""
        n, t = F.col("n"), self.at_least
        fits = lambda c: (_last_of(c) * (200.0 - t) + 1e-6 >= n * t) & (c * t <= n * (200.0 - t) + 1e-6)
        rows = names.withColumn("other", F.explode(F.filter(F.array(*[F.lit(c) for c in others]), fits)))
        own, other = length_class(n), F.col("other")
        spare = F.when(n == 0, 0).otherwise(n - self._least_common(own, other))
        pair = F.struct(own.alias("a"), other.alias("b")) if left else F.struct(other.alias("a"), own.alias("b"))
        rows = rows.withColumns({"pair": pair, "spare": spare}).filter("spare >= 0").withColumn("last", F.explode(F.sequence(F.lit(0), F.col("spare"))))
        return rows.select("pair", F.xxhash64(F.element_at("chars", F.col("last") + 1)).alias("key"), *ROW, "spare", "last")

    def longer_keys(self, rows: DataFrame, size: int) -> DataFrame:
        """The keys of one character more: each that may come next."""
        last = F.least(F.col("spare") + size, F.col("n") - 1)
        rows = rows.filter(last > F.col("last")).withColumn("next", F.explode(F.sequence(F.col("last") + 1, last)))
        return rows.select("pair", F.xxhash64("key", F.element_at("chars", F.col("next") + 1)).alias("key"), *ROW, "spare", F.col("next").alias("last"))

    def met(self, left: DataFrame, right: DataFrame, size: int) -> DataFrame:
        """(a, b): the pairs whose first common characters are a key of this size, and that share enough characters."""
        b = right.select("pair", "key", *[F.col(c).alias(f"b_{c}") for c in (*ROW, "last")])
        both = F.col("n") + F.col("b_n")
        differ = F.bit_count(F.col("bits0").bitwiseXOR(F.col("b_bits0"))) + F.bit_count(F.col("bits1").bitwiseXOR(F.col("b_bits1")))
        close = (200.0 * F.least("n", "b_n") + 1e-6 >= self.at_least * both) & (differ <= both * (100.0 - self.at_least) / 100.0 + 1e-6)
        upto = lambda chars, last: F.slice(chars, F.lit(1), F.col(last) + 1)
        first = F.size(F.array_intersect(upto("chars", "last"), upto("b_chars", "b_last"))) == size
        enough = 200.0 * F.size(F.array_intersect("chars", "b_chars")) + 1e-6 >= self.at_least * both
        return left.hint("shuffle_hash").join(b, ["pair", "key"]).filter(close & first & enough).select(F.col("name").alias("a"), F.col("b_name").alias("b"))

    def candidates(self, left: DataFrame, right: DataFrame) -> DataFrame:
        """(a, b): the pairs of lengths and sets of characters that allow the threshold, each once."""
        names = materialize(self.names(left, right))
        # The classes of lengths are few, 16 for each doubling.
        classes = names.groupBy(length_class(F.col("n")).alias("c")).agg(F.max("of_left").alias("l"), F.max("of_right").alias("r")).orderBy("c").collect()
        of_left, of_right = [r.c for r in classes if r.l], [r.c for r in classes if r.r]
        left, right = names.filter("of_left = 1").select(*ROW), names.filter("of_right = 1").select(*ROW)
        if not of_left or not of_right:
            return names.select(F.col("name").alias("a"), F.col("name").alias("b")).limit(0)
        a, b = self.first_keys(left, of_right, True), self.first_keys(right, of_left, False)
        found = []
        for size in range(1, self.longest_key + 1):
            counts = a.groupBy("pair", "key").agg(F.count("*").alias("x")).join(b.groupBy("pair", "key").agg(F.count("*").alias("y")), ["pair", "key"])
            crowded = materialize(counts.filter(F.col("x") * F.col("y") > self.crowd * (F.col("x") + F.col("y"))).select("pair", "key"))
            if size == self.longest_key or crowded.isEmpty():
                found.append(self.met(a, b, size))
                break
            found.append(self.met(a.join(crowded, ["pair", "key"], "left_anti"), b, size))
            # Where so many characters are all that a pair needs to share there may be no further one, so that these crowds are paired here.
            enough = (F.col("n") - F.col("spare")) <= size
            hot_a, hot_b = materialize(a.join(crowded, ["pair", "key"], "left_semi")), materialize(b.join(crowded, ["pair", "key"], "left_semi"))
            found.append(self.met(hot_a.filter(enough), hot_b, size))
            a, b = materialize(self.longer_keys(hot_a.filter(~enough), size)), materialize(self.longer_keys(hot_b.filter(~enough), size))
        out = found[0]
        for more in found[1:]:
            out = out.unionByName(more)
        return out

    def pairs(self, left: DataFrame, right: DataFrame) -> DataFrame:
        """(a, b, ratio) of all pairs whose ratio is at_least or more, each once."""
        return self.candidates(left, right).withColumn("ratio", sim.ratio("a", "b")).filter(F.col("ratio") >= self.at_least)
