"""Source divergence audit: term distributions of sources compared by joint count histograms.

In each language, the terms that enough of its documents have are kept.  A source gives
each kept term a smoothed share (in billionths) that depends on the term's count alone.  So
the distance of two sources, a sum over all kept terms, needs no term by term evaluation:
per pair of sources the distinct (count, count) combinations are tallied, the combination
is evaluated once and multiplied by its number.

Combinations with both counts above zero come from terms that both sources have (a join
on the term); those with one zero are what a source's own histogram of counts has beyond
them; (0, 0) is the rest of the kept terms.  Shares are exact: integers in decimals.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, blanked_blocks, table

#: Documents of a language that a kept term is in, at least.
MIN_DOCS = 30
#: Added to each count.
SMOOTHING = 5
SCALE = 1_000_000_000
#: Ranks of terms that are reported.
TOP_TERMS = 50
#: Terms of sources that a task holds before it hands its counts on.
HELD = 600_000

#: Lower-cases A-Z and blanks what is no letter: of ASCII only letters stay, of other characters all do.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def out() -> Iterator[pa.RecordBatch]:
        for (part, source), (n, docs) in held.items():
            terms = list(n)
            for i in range(0, len(terms), 50_000):
                some = terms[i : i + 50_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.repeat(pa.scalar(part, pa.string()), len(some)), pa.repeat(pa.scalar(source, pa.string()), len(some)), pa.array(some, pa.string()), pa.array([n[t] for t in some], pa.int64()), pa.array([docs[t] for t in some], pa.int64())],
                    names=["part", "source", "term", "n", "docs"],
                )
        held.clear()

    size = 0
    for batch in batches:
        for part, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            n, docs = held.setdefault((part, source), (Counter(), Counter()))
            before, own = len(n), set()
            for block in blanked_blocks(text.as_buffer().to_pybytes() if text.is_valid else b"", _LETTERS):
                words = block.split()
                n.update(words)
                own.update(words)
            docs.update(own)
            size += len(n) - before
            if size > HELD:
                yield from out()
                size = 0
    yield from out()


def term_counts(docs: DataFrame, part_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """``(part, source, term, n, docs)``: occurrences of terms, and documents that they are in, summed within tasks."""
    own = docs.select(F.coalesce(F.col(part_col), F.lit("")).alias("part"), F.coalesce(F.col(source_col), F.lit("")).alias("source"), F.col(text_col).alias("text"))
    return own.mapInArrow(_tally, "part string, source string, term string, n long, docs long")


def kept_counts(raw: DataFrame, min_docs: int) -> DataFrame:
    """``(part, source, term, n, q_n)``: occurrences of kept terms by source, and in the whole part.

    One shuffle, by part and term: sources, documents of the part and the part's own counts
    are all added up where it has put them (rows of a term: one from each task and source
    at most).
    """
    counted = raw.repartition("part", "term").groupBy("part", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("part", "term")
    whole = counted.select("part", "source", "term", "n", F.sum("n").over(term).alias("q_n"), F.sum("docs").over(term).alias("d"))
    return whole.where(F.col("d") >= min_docs).drop("d")


def share(count: Column, total: Column, kept: Column) -> Column:
    """``1 + floor(10^9 (count + 5) / (total + 5 kept))``, exactly."""
    exact = lambda c: c.cast("decimal(20,0)")
    return 1 + F.call_function("div", (exact(count) + F.lit(SMOOTHING)) * F.lit(SCALE).cast("decimal(10,0)"), F.greatest(exact(total) + exact(kept) * F.lit(SMOOTHING), exact(F.lit(1)))).cast("long")


def source_divergence(docs: DataFrame, part_col: str = "lang", source_col: str = "source", text_col: str = "text", min_docs: int = MIN_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """``(lang, source, part, item, value, rank)`` for each source of each language.

    ``part`` = ``pair``: ``item`` is another source of the language, ``value`` the sum over all
    kept terms of the difference of their shares (0 without kept terms), all ranks.
    ``part`` = ``term``: ``item`` is a kept term that the source has and whose share in it is
    above that in its language, ``value`` the difference, ranks up to ``top``.  Ranks go by
    value, then by the item's bytes, so there are no ties.

    Nulls in language, source and text count as empty; a source without terms takes part.
    Repeated rows count each.  Texts of any length are read whole.  An empty table gives
    no rows; other columns are not looked at.  Writes counts to the shared folder.
    """
    scratch = Scratch(docs.sparkSession, "divergence")
    groups = docs.select(F.coalesce(F.col(part_col), F.lit("")).alias("part"), F.coalesce(F.col(source_col), F.lit("")).alias("source")).distinct()
    # counts of kept terms above zero, by source
    counts = scratch.keep(kept_counts(term_counts(docs, part_col, source_col, text_col), min_docs), "counts")
    parts = counts.select("part", "term", "q_n").groupBy("part", "term").agg(F.max("q_n").alias("q_n")).groupBy("part").agg(F.count(F.lit(1)).alias("kept"), F.sum("q_n").alias("q_total"))
    # each source with its total and its language's figures
    totals = counts.groupBy(F.col("part").alias("p_"), F.col("source").alias("s_")).agg(F.sum("n").alias("total"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    sources = groups.join(totals, (F.col("part") == F.col("p_")) & (F.col("source") == F.col("s_")), "left").drop("p_", "s_")
    sources = sources.join(parts.withColumnRenamed("part", "p_"), F.col("part") == F.col("p_"), "left").select("part", "source", zero("total"), zero("kept"), zero("q_total"))
    sources = scratch.keep(sources, "sources")
    pairs = _pairs(counts, sources, scratch)
    return pairs.unionByName(_terms(counts, sources, top)).select(F.col("part").alias("lang"), "source", F.col("kind").alias("part"), "item", "value", "rank")


def _pairs(counts: DataFrame, sources: DataFrame, scratch: Scratch) -> DataFrame:
    """Distances of the sources of a language from joint count histograms."""
    a = counts.select(F.col("part"), F.col("term"), F.col("source").alias("source_a"), F.col("n").alias("n_a"))
    b = counts.select(F.col("part").alias("part_b"), F.col("term").alias("term_b"), F.col("source").alias("source_b"), F.col("n").alias("n_b"))
    shared = a.join(b, (F.col("part") == F.col("part_b")) & (F.col("term") == F.col("term_b")) & (F.col("source_a") < F.col("source_b")))
    both = scratch.keep(shared.groupBy("part", "source_a", "source_b", "n_a", "n_b").agg(F.count(F.lit(1)).alias("times")), "joint")
    # a source's own histogram, set against each other source: what no shared term accounts for has a zero
    hist = scratch.keep(counts.groupBy("part", "source", "n").agg(F.count(F.lit(1)).alias("times")), "hist")
    each = sources.select("part", "source")
    other = each.select(F.col("part").alias("o_part"), F.col("source").alias("other"))
    marginal = hist.join(other, (F.col("part") == F.col("o_part")) & (F.col("source") != F.col("other"))).drop("o_part")
    low = F.col("source") < F.col("other")
    n = F.col("n")
    zero = F.lit(0).cast("long")
    alone = marginal.select(
        "part", F.least("source", "other").alias("source_a"), F.greatest("source", "other").alias("source_b"), F.when(low, n).otherwise(zero).alias("n_a"), F.when(low, zero).otherwise(n).alias("n_b"), "times"
    )
    minus_a = both.select("part", "source_a", "source_b", "n_a", zero.alias("n_b"), (-F.col("times")).alias("times"))
    minus_b = both.select("part", "source_a", "source_b", zero.alias("n_a"), "n_b", (-F.col("times")).alias("times"))
    key = ["part", "source_a", "source_b"]
    cells = both.unionByName(alone).unionByName(minus_a).unionByName(minus_b).groupBy(*key, "n_a", "n_b").agg(F.sum("times").alias("times")).where("times <> 0")
    # every pair has its sources' totals and, as (0, 0), the kept terms that no cell accounts for
    first = sources.select("part", F.col("source").alias("source_a"), F.col("total").alias("total_a"), "kept")
    second = sources.select(F.col("part").alias("part_b"), F.col("source").alias("source_b"), F.col("total").alias("total_b"))
    ends = first.join(second, (F.col("part") == F.col("part_b")) & (F.col("source_a") < F.col("source_b"))).drop("part_b")
    f = F.abs(share(F.col("n_a"), F.col("total_a"), F.col("kept")) - share(F.col("n_b"), F.col("total_b"), F.col("kept")))
    told = ends.join(cells, key, "left")
    summed = told.groupBy(*key, "total_a", "total_b", "kept").agg(F.coalesce(F.sum(f * F.col("times")), F.lit(0)).alias("seen"), F.coalesce(F.sum("times"), F.lit(0)).alias("cells"))
    nothing = F.abs(share(zero, F.col("total_a"), F.col("kept")) - share(zero, F.col("total_b"), F.col("kept")))
    value = F.col("seen") + F.when(F.col("kept") > F.col("cells"), (F.col("kept") - F.col("cells")) * nothing).otherwise(zero)
    one = summed.select("part", "source_a", "source_b", value.cast("long").alias("value"))
    sides = F.explode(F.array(F.struct(F.col("source_a").alias("source"), F.col("source_b").alias("item")), F.struct(F.col("source_b").alias("source"), F.col("source_a").alias("item"))))
    ways = one.select("part", sides.alias("e"), "value").select("part", "e.source", F.lit("pair").alias("kind"), "e.item", "value")
    return ways.withColumn("rank", F.row_number().over(Window.partitionBy("part", "source").orderBy(F.desc("value"), "item")))


def _terms(counts: DataFrame, sources: DataFrame, top: int) -> DataFrame:
    """A source's terms whose share is above their language's."""
    own = sources.select(F.col("part").alias("p_"), F.col("source").alias("s_"), "total", "kept", "q_total")
    rows = counts.join(own, (F.col("part") == F.col("p_")) & (F.col("source") == F.col("s_"))).drop("p_", "s_")
    p, q_ = share(F.col("n"), F.col("total"), F.col("kept")), share(F.col("q_n"), F.col("q_total"), F.col("kept"))
    above = rows.select("part", "source", F.lit("term").alias("kind"), F.col("term").alias("item"), (p - q_).alias("value")).where("value > 0")
    # a rank limit over a window: Spark keeps the first rows of each group before the shuffle already
    ranked = above.withColumn("rank", F.row_number().over(Window.partitionBy("part", "source").orderBy(F.desc("value"), "item")))
    return ranked.where(F.col("rank") <= top)


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(table(spark, sf_dir, "documents"))
