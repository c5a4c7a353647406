"""Removal of globally repeated passages of lines.

A chunk is a shortest run of lines with more than ``WORDS`` words that begins, or that
ends, at a line with a word: its bounds follow from its own lines alone, so they are the same
wherever the passage stands (lines without a word between them belong to it).  Chunks are
compared by the SHA-256 of their bytes.  A chunk that stands earlier (smaller id, then place) in any
document is repeated, and its lines go.  So a line goes if, and only if, it lies in a run of
lines of over ``WORDS`` words that stands earlier as well: of such a run each line is in a
chunk that begins at it or in the one that ends with the run.  The first occurrence of every
line stays, as no chunk on it can stand earlier.

Only DataFrame operations: chunks are counted first (pre-aggregated), they travel as
digests, and the removals of a document come back as one short list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, apart, table

#: A repeated passage has more words than this.
WORDS = 50
#: Lines that are looked at first for a chunk; most chunks have no more.
_FEW = 4
_WORD = "[^\\x20\\x09-\\x0D]"


def let(value: Column, use) -> Column:
    return F.try_element_at(F.transform(F.array(value), use), F.lit(1))


def _words_in(line: Column) -> Column:
    """Number of words of a line: pieces between white space, without the empty ones at its ends."""
    parts = F.split(line, SPACE + "+")
    return let(parts, lambda p: F.size(p) - (F.get(p, F.lit(0)) == "").cast("int") - ((F.size(p) > 1) & (F.get(p, F.size(p) - 1) == "")).cast("int"))


def _reach(counts: Column) -> Column:
    """How many of the counts it takes from the first on to make more than ``WORDS``; null if all don't."""
    zero = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("n"))
    add = lambda a, x: F.when(a["sum"] > WORDS, a).otherwise(F.struct((a["sum"] + x).alias("sum"), (a["n"] + 1).alias("n")))
    return F.aggregate(counts, zero, add, lambda a: F.when(a["sum"] > WORDS, a["n"]))


def chunks_of(lines: Column) -> Column:
    """``array<struct<first, n, key>>``: 0-based first line, number of lines and hash of each chunk, each once."""
    worded = F.filter(F.transform(lines, lambda x, i: F.struct(i.alias("p"), _words_in(x).alias("w"))), lambda s: s["w"] > 0)

    def of(w: Column) -> Column:
        counts = F.transform(w, lambda s: s["w"])
        place = lambda i: F.get(w, i)["p"]
        chunk = lambda i, j: F.when(i.isNotNull() & j.isNotNull(), F.struct(place(i).alias("first"), (place(j) - place(i) + 1).alias("n")))

        def both(c: Column) -> Column:
            # a line has a word at least, so a chunk has WORDS + 1 of these lines at most
            some = lambda i, k: F.slice(c, i + 1, k)
            last = lambda i, k: F.reverse(F.slice(c, F.greatest(i - (k - 2), F.lit(1)), F.least(i + 1, F.lit(k))))
            from_ = F.transform(w, lambda _, i: chunk(i, i + F.coalesce(_reach(some(i, _FEW)), _reach(some(i, WORDS + 1))) - 1))
            upto = F.transform(w, lambda _, i: chunk(i - F.coalesce(_reach(last(i, _FEW)), _reach(last(i, WORDS + 1))) + 1, i))
            return F.filter(F.array_union(from_, upto), lambda x: x.isNotNull())

        return F.transform(let(counts, both), lambda x: F.struct(x["first"].alias("first"), x["n"].alias("n"), key_of(lines, x["first"], x["n"]).alias("key")))

    return let(worded, of)


def key_of(lines: Column, first: Column, n: Column) -> Column:
    """The digest of the bytes of ``n`` lines from the 0-based ``first`` on."""
    return F.unhex(F.sha2(F.array_join(F.slice(lines, first + 1, n), "\n"), 256))


def _runs(places: Column) -> Column:
    """Number of runs without a gap in an ascending array."""
    return F.size(F.filter(places, lambda x, k: (k == 0) | (x - F.get(places, k - F.lit(1)) > 1)))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", report: bool = False) -> DataFrame:
    """``docs`` with repeated passages of over ``WORDS`` words cut out of ``text_col``; every row stays, columns as they were.

    ``report=True`` adds ``n_chunks``, the number of runs of lines that stay or go, and
    ``n_removed``, that of those that go.  Null texts stay null, empty ones empty; a text
    that keeps no line with a word becomes empty.  Rows without an id are neither cut nor
    counted.  Rows that share an id count as one document (their equal windows at one
    place are one occurrence).  An empty table stays empty.
    """
    source = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("__id"), F.split(F.col(text_col), "\n").alias("__lines"))
    places = source.select("__id", F.explode(chunks_of(F.col("__lines"))).alias("c")).select("__id", "c.first", "c.n", "c.key")
    repeated = places.groupBy("key").agg(F.count(F.lit(1)).alias("__c")).where("__c >= 2").select("key")
    found = places.join(repeated, "key", "left_semi")
    least = found.groupBy("key").agg(F.min(F.struct("__id", "first")).alias("least"))
    later = found.join(least, "key").where((F.col("least.__id") != F.col("__id")) | (F.col("least.first") != F.col("first")))
    per_doc = later.groupBy("__id").agg(F.collect_list(F.struct("first", "n", "key")).alias("__gone"))
    # texts travel to the join as they are; lines are cut after it
    of, gone_, text_lines, cut_, left_, new_ = apart(docs.columns, "__of", "__gone", "__lines", "__cut", "__left", "__new")
    joined = docs.join(per_doc.select(F.col("__id").alias(of), F.col("__gone").alias(gone_)), F.col(id_col) == F.col(of), "left").withColumn(text_lines, F.split(F.col(text_col), "\n"))
    lines = F.col(text_lines)
    # a row that shares its id with another text is cut only where its own lines are those
    own = F.filter(gone_, lambda g: key_of(lines, g["first"], g["n"]) == g["key"])
    cut = F.array_sort(F.array_distinct(F.flatten(F.transform(own, lambda g: F.sequence(g["first"], g["first"] + g["n"] - 1)))))
    joined = joined.withColumn(cut_, cut).withColumn(left_, F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.coalesce(cut_, F.array().cast("array<int>"))))
    kept = F.transform(left_, lambda i: F.get(lines, i))
    rebuilt = F.when(F.exists(kept, lambda x: x.rlike(_WORD)), F.array_join(kept, "\n")).otherwise("")
    out = joined.withColumn(new_, F.when(F.coalesce(F.size(cut_), F.lit(0)) > 0, rebuilt).otherwise(F.col(text_col)))
    columns = [F.col(new_).alias(c) if c == text_col else F.col(c) for c in docs.columns]
    if report:
        gone = F.coalesce(_runs(F.col(cut_)), F.lit(0))
        columns += [(F.coalesce(_runs(F.col(left_)), F.lit(0)) + gone).alias("n_chunks"), gone.alias("n_removed")]
    return out.select(*columns)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), report=True)
