"""Filter interaction audit by aggregation over the edges of a subset lattice.

Filters applied in an order walk up the lattice of subsets of filters: a step is an edge
(filters applied so far, next filter), and what a filter does at a step depends on that
edge alone, not on the order in which the earlier ones came.  So documents are first
reduced to the set of filters that each fails (a bit mask), counted by part, mask and
labels; these counts go to the 80 edges of five filters; and the edges are joined to the
600 steps of the 120 orders, each a path through the lattice.

Only sizes that follow from the number of filters are broadcast: edges and steps.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table, words_of

FILTERS = "ABCDE"
MIN_WORDS = 200
MIN_DISTINCT_PERCENT, MAX_CAPITAL_PERCENT = 50, 3
MARKS = "[#$%&*|]"


def let(value: Column, use) -> Column:
    return F.try_element_at(F.transform(F.array(value), use), F.lit(1))


def own_failures(text: Column) -> Column:
    """``array<boolean>``: whether a text (null: empty) fails the filters A to D, which look at it alone.

    A: under 200 words; B: under half of its words are distinct; C: more than 3 % of its
    characters are capitals A-Z; D: it has one of the characters ``#$%&*|``.
    """
    t = F.coalesce(text, F.lit(""))
    length, size = F.length(t).cast("long"), lambda w: F.size(w).cast("long")
    capitals = length - F.length(F.translate(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    few = lambda w: [size(w) < MIN_WORDS, 100 * size(F.array_distinct(w)) < MIN_DISTINCT_PERCENT * size(w)]
    return let(words_of(t), lambda w: F.array(*few(w), 100 * capitals > MAX_CAPITAL_PERCENT * length, t.rlike(MARKS)))


def failure_masks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """``(id, part, mask)`` for each row of ``docs``: bit ``k`` of ``mask`` is set if the row fails filter ``k`` of ``FILTERS``.

    E, the last one, is failed by a text that a row with a smaller id has as well, in
    any part of the table.  Texts are told apart by SHA-256.  A null id is neither smaller
    nor larger than another; rows that share an id don't make each other fail.  Nulls in
    ``part_col`` and ``text_col`` count as empty.  Writes ids, parts and digests (no
    text) to the shared folder.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    mask = F.aggregate(F.reverse(own_failures(text)), F.lit(0), lambda m, x: m * 2 + x.cast("int"))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col), F.lit("")).alias("part"), mask.alias("own"), F.unhex(F.sha2(text, 256)).alias("digest"))
    rows = Scratch(docs.sparkSession, "audit").keep(rows, "rows")
    # only texts that stand under several ids can make a row fail
    least = rows.groupBy("digest").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most").select(F.col("digest").alias("d"), "least")
    last = 1 << (len(FILTERS) - 1)
    again = F.coalesce(F.col("id") > F.col("least"), F.lit(False))
    return rows.join(least, F.col("digest") == F.col("d"), "left").select("id", "part", (F.col("own") + F.when(again, F.lit(last)).otherwise(F.lit(0))).alias("mask"))


def lattice_edges(spark: SparkSession, n: int = len(FILTERS)) -> DataFrame:
    """``(applied, filter, orders)``: every subset of ``n`` filters with a filter outside it, and the number of orders that pass through."""
    rows = [(s, f, factorial(s.bit_count()) * factorial(n - 1 - s.bit_count())) for s in range(1 << n) for f in range(n) if not s >> f & 1]
    return spark.createDataFrame(rows, "applied int, filter int, orders long")


def lattice_steps(spark: SparkSession, filters: str = FILTERS) -> DataFrame:
    """``(filter_order, step, applied, filter)``: the steps of every order of the filters."""
    rows = []
    for order in permutations(range(len(filters))):
        applied = 0
        for step, f in enumerate(order, 1):
            rows.append(("".join(filters[k] for k in order), step, applied, f))
            applied |= 1 << f
    return spark.createDataFrame(rows, "filter_order string, step int, applied int, filter int")


def edge_counts(counts: DataFrame) -> DataFrame:
    """From ``(part, mask, good, toxic, n)``: counts for each part and each edge, zeros included.

    ``kept``: fail nothing applied nor the filter; ``removed``: fail the filter and
    nothing applied; ``redundant``: fail the filter and something applied.
    """
    spark = counts.sparkSession
    applied, bit = F.col("applied"), F.expr("shiftleft(1, filter)")
    fails = F.col("mask").bitwiseAND(bit) != 0
    before = F.col("mask").bitwiseAND(applied) != 0
    total = lambda when: F.coalesce(F.sum(F.when(when, F.col("n"))), F.lit(0)).cast("long")
    # 80 edges, whatever the corpus: each count goes to all of them
    return counts.join(F.broadcast(lattice_edges(spark))).groupBy("part", "applied", "filter", "orders").agg(
        total(~fails & ~before).alias("kept"), total(fails & ~before).alias("removed"), total(fails & before).alias("redundant"), total(F.col("mask") == bit).alias("unique_fails"),
        total(fails & ~before & (F.col("good") == 1)).alias("good_lost"), total(fails & ~before & (F.col("toxic") == 1)).alias("toxic_lost"),
    )


def filter_interactions(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """What each filter does at each step of each order: a row per part, ``filter_order`` and ``step``.

    Counts are those of ``edge_counts``; ``good_lost`` and ``toxic_lost`` are the removed
    documents with label quality 1 and toxic 1; ``shapley`` is the number of documents
    that the step's filter removes, summed over all orders at any step.  Every part gets
    all 600 rows, zeros included.

    Nulls in text, part and id: see ``failure_masks``; each row of ``docs`` counts by
    itself.  Of several labels of an id, the largest counts; null and missing labels are
    0; labels of a null id are not used.  Texts of any length are read whole.  An empty
    table has no parts and gives no rows.  Other columns are not looked at.
    """
    spark = docs.sparkSession
    masks = failure_masks(docs, id_col, text_col, part_col)
    told = labels.groupBy(F.col(id_col).alias("of")).agg(F.max("quality").alias("good"), F.max("toxic").alias("toxic"))
    joined = masks.join(told, F.col("id") == F.col("of"), "left")
    is_one = lambda c: F.coalesce((F.col(c) == 1).cast("int"), F.lit(0)).alias(c)
    counts = joined.select("part", "mask", is_one("good"), is_one("toxic")).groupBy("part", "mask", "good", "toxic").agg(F.count(F.lit(1)).alias("n"))
    scratch = Scratch(spark, "audit")
    edges = scratch.keep(edge_counts(scratch.keep(counts, "counts")), "edges")
    shapley = edges.groupBy(F.col("part").alias("p"), F.col("filter").alias("f")).agg(F.sum(F.col("removed") * F.col("orders")).alias("shapley"))
    steps = F.broadcast(lattice_steps(spark))  # 600 rows
    paths = edges.join(steps, ["applied", "filter"]).join(shapley, (F.col("part") == F.col("p")) & (F.col("filter") == F.col("f")))
    return paths.select(F.col("part"), "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_interactions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
