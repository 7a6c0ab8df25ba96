"""Mixing sources to target weights by Pareto order sampling.

A source that must give `r` times its words gives every document floor(r) whole copies. The words left are a sample of
unequal probabilities: a document's inclusion p grows with its size, up to the certainty of 1, and the inclusions of a source
are scaled so that the words they take add up to what is left. Each document has a random number u from its id and text;
documents are ranked by (u / (1 - u)) / (p / (1 - p)), smallest first, and taken until the words left are met as closely as
whole documents allow. The size of the sample is so fixed in words, not left to chance.

Inclusions are equal within a size class (a quarter of a doubling), so that a source is summed up in some 160 numbers. The cut in the
ranking is one tuple (place, doc_id, size, tie) for each source: words are summed in bands of the ranking, the band that
crosses the target is known from the sums, and only its documents are ordered. One small row for each source then decides
about every document where it lies; no text is dealt or written for it.
"""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, stored, text_or_empty

WEIGHTS = (5, 2, 1)
MOST = 3
CLASSES = 4 * 40 + 1  # size classes: four for each doubling, up to 2 ** 40 words
BAND_BITS = 12  # the ranking is cut into so many bands at a time, as a power of two
MOST_BITS = 48
BROADCAST_SOURCES = 10_000  # at most 14 MB of rows; more sources are joined


def words(text: Column) -> Column:
    return F.regexp_count(text, F.lit("[^ \\t-\\r]+")).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Sources by code point, null last, weigh `weights` in turn. A target is min(most * size, level * weight) with the one
    level at which all targets sum up to all words: what resharing the excess over and over comes to. The level is found
    from running sums over the sources in the order in which they reach their cap.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    capped = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * float(most))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    before, everything = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    level = (
        capped.withColumn("caps_before", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("weight_left", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("share", (F.sum("source_size").over(everything) - F.col("caps_before")) / F.col("weight_left"))
        .withColumn("free", F.col("share") * F.col("weight") <= F.col("cap"))
        .withColumn("level", F.min(F.when(F.col("free"), F.struct(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source", F.col("share").alias("share")))).over(everything))
    )
    return level.select("source", "source_size", F.least("cap", F.col("level.share") * F.col("weight")).alias("target"))


def size_class(size: Column) -> Column:
    return F.least(F.floor(F.log2(size.cast("double") + 1) * 4), F.lit(CLASSES - 1)).cast("int")


def uniform(doc_id: Column, tie: Column, seed: int) -> Column:
    """A number between 0 and 1 for an id and the hash of a text."""
    return (F.shiftrightunsigned(F.xxhash64(doc_id, tie, F.lit(seed)), 11).cast("double") + 0.5) / float(1 << 53)


def place(u: Column, p: Column) -> Column:
    """The ratio of the odds of `u` and `p`, put into 0..1 in the same order; 0 for certain documents, 1 for impossible ones."""
    odds = (u / (1 - u)) * ((1 - p) / p)
    return F.when(p >= 1, 0.0).when(p <= 0, 1.0).otherwise(odds / (1 + odds))


def inclusions(classes: DataFrame) -> DataFrame:
    """(of, p): for each source an array of the inclusions of its size classes.

    `classes` has (of, class, n, words, left). Inclusion is proportional to the mean size of the class, and no more than 1;
    inclusion times words sums up to `left`. From the largest class down, classes are certain as long as the scale that the
    others would need makes them so.
    """
    down = Window.partitionBy("of").orderBy(F.desc("mean"), F.desc("class"))
    before, behind = down.rowsBetween(Window.unboundedPreceding, -1), down.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    square = F.col("mean") * F.col("words")
    rows = classes.withColumn("mean", F.col("words") / F.col("n"))
    rest = F.greatest(F.lit(0.0), F.col("left") - F.coalesce(F.sum("words").over(before), F.lit(0)))
    rows = rows.withColumn("scale", F.try_divide(rest, F.sum(square).over(behind)))
    fits = F.when(F.coalesce(F.col("scale") * F.col("mean") <= 1, F.lit(True)), F.struct(-F.col("mean"), -F.col("class"), F.col("scale").alias("scale")))
    rows = rows.withColumn("chosen", F.min(fits).over(Window.partitionBy("of"))["scale"])
    share = F.least(F.lit(1.0), F.coalesce(F.col("chosen"), F.lit(0.0)) * F.col("mean"))
    of_class = F.map_from_entries(F.collect_list(F.struct("class", F.coalesce(share, F.lit(0.0)))))
    return rows.groupBy("of").agg(F.transform(F.sequence(F.lit(0), F.lit(CLASSES - 1)), lambda k: F.coalesce(F.element_at(of_class, k), F.lit(0.0))).alias("p"))


def _with(rows: DataFrame, table: DataFrame, sources: int) -> DataFrame:
    """Rows with what a table says of their source; the table is broadcast if its sources are few."""
    small = F.broadcast(table) if sources <= BROADCAST_SOURCES else table
    return rows.join(small, F.col("source").eqNullSafe(F.col("of")))


def _placed(rows: DataFrame, seed: int) -> DataFrame:
    p = F.element_at("p", size_class(F.col("size")) + 1)
    return rows.withColumn("place", place(uniform(F.col("doc_id"), F.col("tie"), seed), p))


class Cuts:
    """What decides about the documents of each source: `table` has (of, source_size, target, whole, p, cut, some, all).

    `whole` copies go to every document. One more goes to those ranked before `cut`, a struct (place, doc_id, size, tie), and to
    `some` of the `all` rows that are equal to it.
    """

    def __init__(self, facts: DataFrame, weights: tuple[int, ...], most: int, seed: int, band_rows: int):
        of = F.col("source").alias("of")
        classes = stored(facts.groupBy(of, size_class(F.col("size")).alias("class")).agg(F.count("*").alias("n"), F.sum("size").alias("words")), "mix-classes")
        sizes = stored(classes.groupBy("of").agg(F.sum("words").alias("source_size"), F.sum("n").alias("n")), "mix-sizes")
        self.seed, self.sources, rows = seed, sizes.count(), sizes.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
        aims = (
            targets(sizes.select(F.col("of").alias("source"), "source_size"), weights, most)
            .withColumnRenamed("source", "of")
            .withColumn("whole", F.floor(F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)))
            .withColumn("left", F.col("target") - F.col("whole") * F.col("source_size"))
        )
        aims = stored(aims, "mix-aims")
        left = aims.select(F.col("of").alias("own"), "left")
        p = inclusions(classes.join(left, F.col("of").eqNullSafe(F.col("own"))).drop("own"))
        aims = aims.join(p.withColumnRenamed("of", "own"), F.col("of").eqNullSafe(F.col("own"))).drop("own")
        # Bands as fine as some `band_rows` documents; each step sums up those inside the crossing band of the one before.
        bits = min(MOST_BITS, max(4, ceil(log2(rows / band_rows + 1))))
        state, done = stored(aims.withColumn("at", F.lit(0).cast("long")).withColumn("before", F.lit(0).cast("long")), "mix-bands"), 0
        while done < bits:
            done += (step := min(BAND_BITS, bits - done))
            inside = _placed(_with(facts, state.where("left > 0"), self.sources), seed).withColumn("band", self._band(done))
            inside = inside.where(F.expr(f"shiftright(band, {step})") == F.col("at"))
            bands = inside.groupBy(F.col("source").alias("own"), "band").agg(F.sum("size").alias("words"))
            # At most 2 ** BAND_BITS rows a source.
            upto = F.sum("words").over(Window.partitionBy("own").orderBy("band"))
            state = state.drop("at").join(self._crossing(bands.withColumn("upto", upto), state), F.col("of").eqNullSafe(F.col("own")), "left").drop("own")
            before = F.col("before") + F.coalesce("ahead", F.lit(0))
            state = stored(state.withColumn("at", F.coalesce("at", F.lit(-1).cast("long"))).withColumn("before", before).drop("ahead"), "mix-bands")
        inside = _placed(_with(facts, state.where("left > 0"), self.sources), seed).where(self._band(done) == F.col("at"))
        key = F.struct("place", "doc_id", "size", "tie")
        groups = inside.groupBy(F.col("source").alias("own"), key.alias("cut")).agg(
            F.count("*").alias("all"), F.sum("size").alias("words"), F.first("left").alias("goal"), F.first("before").alias("ahead")
        )
        # Distinct rows of one band: about `band_rows` a source.
        order = Window.partitionBy("own").orderBy("cut")
        groups = groups.withColumn("upto", F.col("ahead") + F.sum("words").over(order)).where(F.col("upto") >= F.col("goal"))
        first = groups.groupBy("own").agg(F.min_by(F.struct("cut", "all", "words", "upto", "goal"), "cut").alias("g")).select("own", "g.*")
        # As many of the equal rows as bring the sum closest to the target.
        some = F.floor((F.col("goal") - F.col("upto") + F.col("words")) / F.col("cut.size") + 0.5)
        first = first.withColumn("some", F.when(F.col("cut.size") > 0, F.greatest(F.lit(0), F.least(some, F.col("all")))).otherwise(0))
        cut = first.select("own", "cut", "some", "all")
        self.table = stored(
            state.join(cut, F.col("of").eqNullSafe(F.col("own")), "left").select("of", "source_size", "target", "whole", "p", "cut", "some", "all"), "mix-cuts"
        )

    @staticmethod
    def _band(bits: int) -> Column:
        return F.least(F.floor(F.col("place") * float(1 << bits)), F.lit((1 << bits) - 1)).cast("long")

    @staticmethod
    def _crossing(bands: DataFrame, state: DataFrame) -> DataFrame:
        """(own, at, ahead): the band in which the words left are met, and the words of the bands of this step before it."""
        goals = state.select(F.col("of").alias("goal_of"), (F.col("left") - F.col("before")).alias("goal"))
        met = bands.join(goals, F.col("own").eqNullSafe(F.col("goal_of"))).where(F.col("upto") >= F.col("goal"))
        found = met.groupBy("own").agg(F.min(F.struct("band", (F.col("upto") - F.col("words")).alias("ahead"))).alias("b"))
        return found.select("own", F.col("b.band").alias("at"), F.col("b.ahead").alias("ahead"))

    def decide(self, rows: DataFrame, keep: list[str]) -> DataFrame:
        """`keep` columns with source_size, target and copies; `rows` has source, doc_id, size and tie."""
        known = _placed(_with(rows, self.table, self.sources), self.seed).withColumn("key", F.struct("place", "doc_id", "size", "tie"))
        equal = F.coalesce(F.col("key") == F.col("cut"), F.lit(False))
        torn = equal & (F.col("some") > 0) & (F.col("some") < F.col("all"))
        one = F.when(F.col("cut").isNull(), 0).when(F.col("key") < F.col("cut"), 1).when(equal & (F.col("some") == F.col("all")), 1).otherwise(0)
        columns = [*keep, "source_size", "target"]
        settled = known.where(~torn).select(*columns, (F.col("whole") + one).cast("int").alias("copies"))
        return settled.unionByName(_some_of(known.where(torn), columns))


def _some_of(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Rows equal to the cut of their source, `some` of them with one copy more than whole ones.

    They are written, counted by task and source, and numbered within a task, so that they may be very many.
    """
    of, task = fresh(rows, "torn_of"), fresh(rows, "task")
    number = fresh(rows, "number")
    held = rows.select(*columns, "whole", "some", F.col("source").alias(of), F.monotonically_increasing_id().alias(number))
    held = stored(held, "mix-torn").withColumn(task, F.expr(f"shiftright({number}, 33)"))
    earlier = Window.partitionBy("own").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    counts = held.groupBy(F.col(of).alias("own"), F.col(task).alias("at")).count()
    ahead = counts.select("own", "at", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("ahead"))
    placed = held.withColumn(number, F.row_number().over(Window.partitionBy(of, task).orderBy(number)))
    joined = placed.join(ahead, placed[of].eqNullSafe(F.col("own")) & (placed[task] == F.col("at")))
    return joined.select(*columns, (F.col("whole") + (F.col("ahead") + F.col(number) <= F.col("some")).cast("int")).cast("int").alias("copies"))


def facts_of(docs: DataFrame) -> list[Column]:
    text = text_or_empty(docs)
    return [docs["doc_id"].alias("doc_id"), docs["source"].cast("string").alias("source"), words(text).alias("size"), F.xxhash64(text).alias("tie")]


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = 10, band_rows: int = 1000) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken (words taken, repeats counted), copies.

    Sizes are words of the whole text, null text has 0. A null source is a source of its own, the last one. Documents
    without words get their source's whole copies, which are 0 words. Rows of one id and text share their place in the
    ranking; between them it makes no difference which is taken. An empty table gives no rows.
    """
    facts = stored(docs.select(*facts_of(docs)), "mix-facts")
    return Cuts(facts, weights, most, seed, band_rows).decide(facts, ["doc_id", "size"]).withColumn("taken", F.col("copies") * F.col("size"))


def draw(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = 10, band_rows: int = 1000) -> DataFrame:
    """The mixture itself: the columns of `docs` with `copy` (1, 2, ...), one row for each copy taken.

    If `docs` has a column of that name, the number is in `_copy`. Documents are read twice, once for their sizes and once
    to be drawn; texts are neither dealt nor written.
    """
    copy, row = fresh(docs, "copy"), "drawn"
    cuts = Cuts(stored(docs.select(*facts_of(docs)), "mix-facts"), weights, most, seed, band_rows)
    rows = docs.select(*facts_of(docs), F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias(row))
    taken = cuts.decide(rows, [row]).where("copies > 0")
    return taken.select(*[F.col(row)[c].alias(c) for c in docs.columns], F.explode(F.sequence(F.lit(1), "copies")).alias(copy))
