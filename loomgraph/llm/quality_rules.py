"""Quality rules per document, judged per host.

Each document is measured once, in row-local array expressions.  Rule failures are
added up by host; a host's failure rate is shrunk towards the corpus by a beta
prior fitted to the hosts themselves (moments), so that a host with few documents
is not judged by its luck; the verdict is joined back to its documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, apart, table, words_of

#: A document fails by itself below this number of words ...
MIN_WORDS = 50
#: ... or when more than this share (%) of its words lie in a repeated 3-word window.
MAX_REPEAT_PERCENT = 50
#: A host is rejected when its shrunk failure rate is above this.
MAX_HOST_RATE = 0.6
#: Up to so many rejected hosts are broadcast (names of at most 253 bytes each: 30 MB).
FEW_HOSTS = 100_000


#: Up to so many distinct repeated windows, their places are found by membership; beyond, by sorting.
FEW = 24


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once (bound by a lambda over a one-element array)."""
    return F.try_element_at(F.transform(F.array(value), use), F.lit(1))


def _shifted(places: Column, k: int) -> Column:
    return F.transform(places, lambda i: i + F.lit(k))


def repeated_words(words: Column, width: int = 3) -> Column:
    """How many words lie in a ``width``-word window found twice or more among ``words``.

    Windows are compared by 64-bit hashes of their words.  Most texts repeat none,
    which a hash set shows; then sorted hashes show which repeat, and the places are
    found by membership (few) or by sorting (hash, place), so the cost is n log n at
    any length.
    """
    last = F.size(words) - (width - 1)
    window = lambda i: F.xxhash64(*[F.try_element_at(words, i + F.lit(k)) for k in range(width)])

    def covered(places: Column) -> Column:
        return F.size(F.array_distinct(F.flatten(F.array(places, *[_shifted(places, k) for k in range(1, width)]))))

    def neighbours(s: Column, same) -> Column:
        n = F.size(s) - 1
        return F.filter(F.zip_with(F.slice(s, 1, n), F.slice(s, 2, n), same), lambda p: p.isNotNull())

    def by_sorting(h: Column) -> Column:
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return let(placed, lambda s: let(F.flatten(neighbours(s, lambda x, y: F.when(x["h"] == y["h"], F.array(x["i"], y["i"])))), covered))

    def by_membership(h: Column, few: Column) -> Column:
        at = F.filter(F.transform(h, lambda x, i: F.when(F.array_contains(few, x), i)), lambda i: i.isNotNull())
        return let(at, covered)

    def some(h: Column) -> Column:
        repeated = let(F.sort_array(h), lambda s: F.array_distinct(neighbours(s, lambda x, y: F.when(x == y, x))))
        return let(repeated, lambda few: F.when(F.size(few) <= FEW, by_membership(h, few)).otherwise(by_sorting(h)))

    hashes = F.transform(F.sequence(F.lit(1), last), window)
    found = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(some(h)))
    return F.when(last >= 2, found).otherwise(F.lit(0)).cast("long")


def measures(text: Column) -> Column:
    """A struct of the measures of a whole text (null: no words)."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    symbols = F.size(F.split(text, "[#*$%&|<>]")) - 1

    def of(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            symbols.cast("long").alias("n_symbols"),
            let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            repeated_words(w).alias("n_repeat_words"),
        )

    return let(words_of(text), of)


def base_failed(m: Column) -> Column:
    return (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEAT_PERCENT * m["n_words"])


def host_verdicts(failures: DataFrame, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """``(host, host_docs, host_rate, host_kept)`` from rows of ``(host, failed)``.

    The prior Beta(a, b) has the mean and the spread of the hosts' rates, after what
    their finite counts explain is taken off (method of moments); hosts that differ
    no more than chance get a strong prior.  A null host is a host of its own.
    """
    hosts = failures.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("failed").cast("long")).alias("k"))
    total = hosts.agg(
        F.coalesce(F.sum("k") / F.sum("n"), F.lit(0.0)).alias("mean"),
        F.coalesce(F.var_pop(F.col("k") / F.col("n")), F.lit(0.0)).alias("spread"),
        F.coalesce(F.avg(1 / F.col("n")), F.lit(1.0)).alias("inverse"),
    )
    p = F.least(F.greatest(F.col("mean"), F.lit(1e-4)), F.lit(1 - 1e-4))
    extra = F.greatest(F.col("spread") - p * (1 - p) * F.col("inverse"), p * (1 - p) * 1e-4)
    weight = F.greatest(p * (1 - p) / extra - 1, F.lit(1.0))
    prior = total.select((p * weight).alias("a"), ((1 - p) * weight).alias("b"))
    rate = (F.col("k") + F.col("a")) / (F.col("n") + F.col("a") + F.col("b"))
    # the prior is one row by construction (a global aggregate), whatever the corpus
    return hosts.join(F.broadcast(prior)).select("host", F.col("n").alias("host_docs"), rate.alias("host_rate"), (rate <= max_rate).alias("host_kept"))


def judged(rows: DataFrame, host_col: str, failed_col: str, max_rate: float = MAX_HOST_RATE, verdict: str = "kept") -> DataFrame:
    """``rows`` with ``verdict``: false where ``failed_col`` is, and for hosts that are rejected.

    ``rows`` is read twice, so it should be stored.  Null hosts are one host.  Only
    rejected hosts are joined: broadcast up to ``FEW_HOSTS`` of them, else by a join of
    which Spark splits hot hosts.
    """
    host, bad = apart(rows.columns, "__host", "__bad")
    failures = rows.select(F.col(host_col).alias("host"), F.col(failed_col).alias("failed"))
    rejected = Scratch(rows.sparkSession, "rules").keep(host_verdicts(failures, max_rate).where("not host_kept").select(F.col("host").alias(host), F.lit(True).alias(bad)), "hosts")
    if rejected.count() <= FEW_HOSTS:
        rejected = F.broadcast(rejected)
    joined = rows.join(rejected, F.col(host_col).eqNullSafe(F.col(host)), "left")
    return joined.select(*rows.columns, (~F.col(failed_col) & F.col(bad).isNull()).alias(verdict))


def judge(docs: DataFrame, text_col: str = "text", host_col: str = "source", id_col: str = "doc_id", max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """``(id_col, measures..., base_failed, kept)`` for each row of ``docs``.

    Null and empty texts have no words and fail.  Null hosts are one host, null ids are
    kept.  Repeated rows each count and each get their verdict.  Texts of any length are
    measured whole.  An empty table stays empty.  Other columns are not looked at.
    Writes measures (no text) to the shared folder.
    """
    measured = docs.select(F.col(id_col).alias("id"), F.col(host_col).alias("host"), measures(F.col(text_col)).alias("m"))
    kept = Scratch(docs.sparkSession, "rules").keep(measured.withColumn("base_failed", base_failed(F.col("m"))), "measures")
    return judged(kept, "host", "base_failed", max_rate).select(F.col("id").alias(id_col), "m.*", "base_failed", "kept")


def keep_good(docs: DataFrame, text_col: str = "text", host_col: str = "source", max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """The rows that their own rules and their host's verdict let through; columns as they were.

    As ``judge`` has it for nulls, empty texts and repeated rows.  Each text is measured
    once; rows are written to the shared folder with what their own rules say.
    """
    failed, verdict = apart(docs.columns, "__failed", "__kept")
    stored = Scratch(docs.sparkSession, "rules").keep(docs.withColumn(failed, base_failed(measures(F.col(text_col)))), "rows")
    return judged(stored, host_col, failed, max_rate, verdict).where(F.col(verdict)).select(*docs.columns)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))
