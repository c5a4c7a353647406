"""I-Match document fingerprints.

Terms are the distinct lower-cased words of a text.  The lexicon keeps terms whose
inverse document frequency lies in a band: rarer than ``MAX_SHARE`` of the documents,
in ``MIN_SHARE`` of them at least.  A document's lexicon terms are dealt by hash into
randomised subsets of the lexicon; the sorted terms of each subset are hashed.

Subsets come in levels, each with ``SUBSETS`` subsets and each sparser than the one
before, so that short and long texts alike have subsets of a few terms.  The subsets of
the first level cover the lexicon; a text without a lexicon term is known by all its terms
together, so it is like texts of the same terms alone (those without words are alike).

Size bound of the lexicon: a term counts at ``MIN_SHARE`` of the documents or more, so
there are at most (mean number of distinct terms) / ``MIN_SHARE`` of them, whatever the
number of documents (0.25 MB for each thousand distinct terms of a mean text, at 1 KB for
40 terms); it reaches the executors as a literal set.

Only DataFrame operations.  Equal texts have equal fingerprints.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import Scratch, table, words_of

MIN_SHARE, MAX_SHARE = 0.004, 0.15
SUBSETS = 16
CELLS = (16, 64, 256, 1024)
#: Stands for a subset without terms where fingerprints are written out.
EMPTY = "-" * 16


def let(value: Column, use) -> Column:
    return F.try_element_at(F.transform(F.array(value), use), F.lit(1))


def terms_of(text: Column) -> Column:
    """Distinct terms of a text as 64-bit hashes."""
    return F.array_distinct(F.transform(words_of(F.lower(text)), lambda w: F.xxhash64(w)))


def lexicon(docs: DataFrame, text_col: str = "text", min_share: float = MIN_SHARE, max_share: float = MAX_SHARE) -> list[int]:
    """Term hashes in the band; counted over all documents (null texts count as empty ones)."""
    df = docs.select(F.explode(terms_of(F.col(text_col))).alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n"))
    n = docs.count()
    least, most = max(2, min_share * n), max(2, max_share * n)
    return sorted(r["t"] for r in df.where((F.col("n") >= least) & (F.col("n") <= most)).select("t").collect())


def fingerprint(text_col: str, terms_in_band: list[int]) -> Column:
    """``array<bigint>``: a hash for each subset of each level, null without terms; null texts are empty.

    A text without a term of the lexicon has a hash of all its terms in the first place instead.
    """

    # SQL text: one call of the parser for the whole set of literals, which becomes one hash set
    band = ",".join(f"bigint('{t}')" if t == -(1 << 63) else f"{t}L" for t in terms_in_band) or "null"
    words = f"filter(split(lower(coalesce(`{text_col}`, '')), '[\\\\x20\\\\x09-\\\\x0D]+'), w -> w <> '')"
    terms = f"transform(array(array_distinct(transform({words}, w -> xxhash64(w)))), a -> struct(filter(a, x -> x in ({band})) as band, a as every))[0]"

    def level(terms: Column, cells: int) -> Column:
        dealt = F.transform(terms, lambda t: F.struct(F.pmod(F.xxhash64(F.lit(cells), t), F.lit(cells)).cast("int").alias("s"), t.alias("t")))
        mine = F.sort_array(F.filter(dealt, lambda d: d["s"] < SUBSETS))
        none = F.struct(F.lit(-1).alias("s"), F.lit(0).cast("bigint").alias("h"), F.array().cast("array<struct<s:int,h:bigint>>").alias("done"))

        def step(a: Column, d: Column) -> Column:
            same = a["s"] == d["s"]
            closed = F.when(same | (a["s"] < 0), a["done"]).otherwise(F.array_append(a["done"], F.struct(a["s"].alias("s"), a["h"].alias("h"))))
            return F.struct(d["s"].alias("s"), F.when(same, F.xxhash64(a["h"], d["t"])).otherwise(F.xxhash64(d["t"])).alias("h"), closed.alias("done"))

        runs = F.aggregate(mine, none, step, lambda a: F.when(a["s"] < 0, a["done"]).otherwise(F.array_append(a["done"], F.struct(a["s"].alias("s"), a["h"].alias("h")))))

        def out(runs_: Column) -> Column:
            named = F.map_from_arrays(F.transform(runs_, lambda r: r["s"]), F.transform(runs_, lambda r: r["h"]))
            return let(named, lambda m: F.transform(F.sequence(F.lit(0), F.lit(SUBSETS - 1)), lambda s: F.try_element_at(m, s)))

        return let(runs, out)

    def alone(every: Column) -> Column:
        """In the first place a hash of all the text's terms, which only texts of the same terms share."""
        return F.concat(F.array(F.xxhash64(F.lit("alone"), F.sort_array(every))), F.array_repeat(F.lit(None).cast("bigint"), len(CELLS) * SUBSETS - 1))

    return let(F.expr(terms), lambda t: F.when(F.size(t["band"]) == 0, alone(t["every"])).otherwise(let(t["band"], lambda b: F.concat(*[level(b, c) for c in CELLS]))))


def written(fp: Column) -> Column:
    """A fingerprint as one string: 16 hex digits, or ``EMPTY``, for each subset."""
    return F.array_join(F.transform(fp, lambda h: F.coalesce(F.lpad(F.lower(F.hex(h)), 16, "0"), F.lit(EMPTY))), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of equal hashes among the subsets that either text has terms in; of the levels, the largest.

    1 for equal fingerprints, 0 if one of two different ones has no lexicon terms.  Levels on
    which fewer than 4 subsets have terms count only if no level has more.
    """

    def level(k: int) -> Column:
        part = lambda x: F.slice(x, k * SUBSETS + 1, SUBSETS)
        pairs = F.zip_with(part(a), part(b), lambda x, y: F.when(x.isNotNull() | y.isNotNull(), x.eqNullSafe(y).cast("int")))
        return let(F.filter(pairs, lambda p: p.isNotNull()), lambda p: F.struct(F.aggregate(p, F.lit(0), lambda n, x: n + x).alias("same"), F.size(p).alias("any")))

    def best(levels: Column) -> Column:
        share = lambda x: F.when(x["any"] > 0, x["same"] / x["any"]).otherwise(F.lit(0.0))
        full = F.filter(levels, lambda x: x["any"] >= 4)
        return F.coalesce(F.array_max(F.transform(full, share)), F.array_max(F.transform(levels, share)), F.lit(0.0))

    return F.when(a == b, F.lit(1.0)).otherwise(let(F.array(*[level(k) for k in range(len(CELLS))]), best))


def next_ids(ids: DataFrame, scratch: Scratch) -> DataFrame:
    """``(id, next)`` for each distinct ``id``: the next one in order (null first; after the last: the first).

    Ids alone are dealt by range, so that no task orders all of them; the first id of each
    range follows the last of the range before.
    """
    dealt = scratch.keep(ids.select("id").distinct().repartitionByRange("id").withColumn("p", F.spark_partition_id()), "ids")
    first = dealt.groupBy("p").agg(F.min(F.struct(F.col("id").isNotNull(), "id"))["id"].alias("f"))
    # a row per range: as many as there are partitions
    order = first.select("p", F.lead(F.struct("f")).over(Window.orderBy("p")).alias("after"), F.first(F.struct("f")).over(Window.orderBy("p")).alias("start"))
    after = F.broadcast(order.select(F.col("p").alias("q"), F.coalesce("after", "start").alias("after")))
    here = dealt.withColumn("next", F.lead(F.struct(F.col("id").alias("f"))).over(Window.partitionBy("p").orderBy("id")))
    return scratch.keep(here.join(after, F.col("p") == F.col("q")).select("id", F.coalesce("next", "after")["f"].alias("next")), "next")


def with_edits(docs: DataFrame, band: list[int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, text, edited, fp, next_fp)`` for each row: its text, the same with its last half replaced by the next document's beginning, fingerprints.

    A null text is empty.  Rows that share an id have the same next document; of several
    rows with the next id, it is the one with the smallest beginning.  The next of the
    last id is the first; a null id comes first.  Texts go by their id to one join, and
    only the beginnings that are asked for go on to the next.  An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "imatch")
    own = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    half = lambda t: F.floor(F.length(t) / 2).cast("int")
    longest = scratch.keep(own.groupBy("id").agg(F.max(half(F.col("text"))).alias("k")), "longest")
    nexts = next_ids(longest, scratch).select(F.col("id").alias("i"), "next")
    asked = longest.join(nexts, F.col("id").eqNullSafe(F.col("i"))).select(F.col("id").alias("of"), "next", "k")
    beginning = F.substr("text", F.lit(1), F.col("k"))
    told = own.join(asked, F.col("id").eqNullSafe(F.col("next"))).select("of", F.struct(beginning.alias("b"), F.xxhash64("text").alias("h"), fingerprint("text", band).alias("fp")).alias("t"))
    told = told.groupBy("of").agg(F.min("t").alias("t"))
    joined = own.join(told, F.col("id").eqNullSafe(F.col("of")))
    k = half(F.col("text"))
    edited = F.concat(F.substr("text", F.lit(1), F.length("text") - k), F.substr(F.col("t.b"), F.lit(1), k))
    return joined.select(F.col("id").alias(id_col), "text", edited.alias("edited"), fingerprint("text", band).alias("fp"), F.col("t.fp").alias("next_fp"))


def op4_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    band = lexicon(docs)
    found = with_edits(docs, band).select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "fp", "next_fp", fingerprint("edited", band).alias("efp")
    )
    return found.select(
        "doc_id", "n_chars", "edited_sha256", written(F.col("fp")).alias("fingerprint"), written(F.col("efp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("efp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )
