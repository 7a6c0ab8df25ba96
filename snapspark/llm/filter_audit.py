"""Interaction audit of filters: what every filter does at every place of every order.

A document's failures are one bit mask. Documents are first summed up to cells (part, mask), at most 2 ** N cells a part,
so nothing behind that sees a document. A recursive common table expression then enumerates the orders: it starts with the
empty prefix of each part, extends a prefix by every letter that its applied bits lack, joins the part's mask cells, and
appends the metrics of that step. After N levels the prefixes are the orders, each with its N steps.

A prefix has one row per part whatever the number of documents: N! rows a part at the last level.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, text_or_empty

LETTERS = "ABCDE"
LEAST_WORDS = 50
LEAST_DISTINCT = 65  # per cent of the words
MOST_CAPITALS = 5  # per cent of the code points
WORD = "[^ \\t-\\r]+"
MARKS = "[#$%&*|]"

ROWS_LIMIT = "spark.sql.cteRecursionRowLimit"


def text_failures(text: Column, words: Column) -> dict[str, Column]:
    """The filters that look at one text: letter to `fails`. `words` are the words of `text`."""
    n = F.size(words)
    return {
        "A": n < LEAST_WORDS,
        "B": 100 * F.size(F.array_distinct(words)) < LEAST_DISTINCT * n,
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > MOST_CAPITALS * F.length(text),
        "D": F.rlike(text, F.lit(MARKS)),
    }


def masked(docs: DataFrame) -> DataFrame:
    """(doc_id, part, mask): bit i of `mask` is set if the document fails filter i of A to E.

    E, equal to the text of any smaller doc_id in the table, is found by digests: the smallest doc_id of a digest does not
    fail, all larger ones do. Rows are matched on (digest, doc_id), so that the copies of one text are spread. A null doc_id
    is neither smaller nor larger than others and does not fail E; rows that repeat text and doc_id do not fail by each other.
    """
    text = text_or_empty(docs)
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["source"].cast("string"), F.lit("")).alias("part"), text.alias("text"))
    split = rows.withColumn("words", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    bits = [F.when(fails, 1 << LETTERS.index(letter)).otherwise(0) for letter, fails in text_failures(F.col("text"), F.col("words")).items()]
    facts = stored(split.select("doc_id", "part", sum(bits[1:], bits[0]).alias("own"), F.unhex(F.sha2("text", 256)).alias("digest")), "filter-facts")
    first = facts.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    known = facts.where("doc_id is not null").join(first, ["digest", "doc_id"], "left")
    e = 1 << LETTERS.index("E")
    return known.select("doc_id", "part", (F.col("own") + F.when(F.col("first"), 0).otherwise(e)).alias("mask")).unionByName(
        facts.where("doc_id is null").select("doc_id", "part", F.col("own").alias("mask"))
    )


def cells(failures: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, cells): for each part its masks with the number of documents, of good and of toxic ones; one row a part.

    A document is good (toxic) if any of its label rows says so; documents without labels are neither.
    """
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("bad")
    )
    no_id = failures.where("doc_id is null").select("part", "mask", F.lit(None).cast("int").alias("good"), F.lit(None).cast("int").alias("bad"))
    labelled = failures.where("doc_id is not null").join(marks, "doc_id", "left").select("part", "mask", "good", "bad").unionByName(no_id)
    count = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    counted = labelled.groupBy("part", "mask").agg(F.count("*").alias("n"), count("good").alias("good"), count("bad").alias("toxic"))
    return counted.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))


def _sum(of: str, where: str) -> str:
    return f"aggregate(c.cells, 0L, (s, x) -> s + if({where}, x.{of}, 0L))"


def orders(parts: DataFrame, letters: str = LETTERS) -> DataFrame:
    """(part, filter_order, steps): every order of `letters` for each part, `steps` holding the metrics of each step.

    Written out at once, as the recursion's limit of rows is lifted for this statement alone: it counts the rows of all
    parts, which grow with the number of sources and not with the recursion.
    """
    spark = parts.sparkSession
    choices = ", ".join(f"struct('{letter}' as name, {1 << LETTERS.index(letter)} as bit)" for letter in letters)
    here, earlier = "x.mask & l.bit != 0", "x.mask & p.applied != 0"
    step = f"""named_struct(
        'step', p.level + 1, 'letter', l.name,
        'kept', {_sum("n", "x.mask & (p.applied | l.bit) = 0")},
        'removed', {_sum("n", f"{here} and not {earlier}")},
        'redundant', {_sum("n", f"{here} and {earlier}")},
        'unique_fails', {_sum("n", "x.mask = l.bit")},
        'good_lost', {_sum("good", f"{here} and not {earlier}")},
        'toxic_lost', {_sum("toxic", f"{here} and not {earlier}")})"""
    none = "array<struct<step:int,letter:string,kept:bigint,removed:bigint,redundant:bigint,unique_fails:bigint,good_lost:bigint,toxic_lost:bigint>>"
    query = f"""
        with recursive prefix as (
            select part, '' as filter_order, 0 as level, 0 as applied, cast(array() as {none}) as steps from {{cells}}
            union all
            select p.part, concat(p.filter_order, l.name), p.level + 1, p.applied | l.bit, concat(p.steps, array({step}))
            from prefix p join {{cells}} c on p.part = c.part lateral view explode(array({choices})) as l
            where p.applied & l.bit = 0)
        select part, filter_order, steps from prefix where level = {len(letters)}"""
    before = spark.conf.get(ROWS_LIMIT, None)
    spark.conf.set(ROWS_LIMIT, -1)
    try:
        return stored(spark.sql(query, cells=parts), "filter-orders")
    finally:
        spark.conf.unset(ROWS_LIMIT) if before is None else spark.conf.set(ROWS_LIMIT, before)


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, filter_order (all orders of A to E) and step (1 to 5), zeros included.

    part is the source, a null source the empty string. Counts within the part: kept (after the step), removed (by the
    step), redundant (fail the step's filter, removed earlier), unique_fails (fail this filter only), good_lost and
    toxic_lost (of the removed), shapley (removed by this filter, over all orders). Null text counts as empty and fails A.
    Texts are read whole. An empty table has no parts and gives no rows. Other columns are not read.
    """
    parts = stored(cells(masked(docs), labels), "filter-cells")
    steps = orders(parts).select("part", "filter_order", F.inline("steps"))
    # factorial(N) rows for each part and letter, whatever the input
    return steps.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "letter"))).drop("letter")

