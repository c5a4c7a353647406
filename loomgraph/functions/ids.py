"""Ids and lineage that survive retries."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where unset, a temporary folder on one machine, the warehouse on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found
    master = spark.sparkContext.master
    local = master.startswith("local") and not master.startswith("local-cluster")
    own = "file://" + tempfile.mkdtemp(prefix="loomgraph-") if local else spark.conf.get("spark.sql.warehouse.dir") + "/_loomgraph"
    spark.sparkContext.setCheckpointDir(own)
    return own


def cut(df: DataFrame) -> DataFrame:
    """The same rows, checkpointed to the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def by_key(df: DataFrame, *columns: str) -> DataFrame:
    """Rows dealt by the columns to as many tasks as ``spark.sql.shuffle.partitions`` says, however small they are.

    A join with them is dealt alike.  Left to itself, Spark makes few tasks where a shuffle is
    small in bytes; sorted ids shrink to a byte a row there, and take a hundred when a task sorts them.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *columns)


def dealt(df: DataFrame, order: list[str], *columns) -> DataFrame:
    """Rows dealt by range, in order inside each: ``columns`` (default: all), the range ``__p`` and the place there ``__i``."""
    # the id that Spark gives a row is its partition's number and, in the low 33 bits, its place there
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order).select(*(columns or ["*"]), F.monotonically_increasing_id().alias("__i"))
    return rows.withColumn("__p", F.shiftright("__i", 33)).withColumn("__i", F.col("__i").bitwiseAND((1 << 33) - 1))


def numbered(rows: DataFrame, name: str) -> DataFrame:
    """``dealt`` rows that are stored, with ``name`` for their number over all ranges: each adds the number of rows in those before it."""
    sizes = rows.groupBy("__p").agg(F.count(F.lit(1)).alias("__c"))
    # a row per partition
    before = sizes.select(F.col("__p").alias("__q"), (F.sum("__c").over(Window.orderBy("__p")) - F.col("__c")).alias("__b"))
    return rows.join(F.broadcast(before), F.col("__p") == F.col("__q")).withColumn(name, F.col("__i") + F.col("__b")).drop("__p", "__q", "__b", "__i")


def number_rows(df: DataFrame, order: list[str], name: str = "n") -> DataFrame:
    """Adds 0, 1, 2, ... in the order of the columns, without ordering all rows in one task.

    Rows are dealt by range, and the dealing is checkpointed (so that a retry cannot deal
    otherwise); they move once.
    """
    if not order:
        return df.withColumn(name, F.lit(0).cast("long"))
    return numbered(cut(dealt(df, order)), name)


def sum_before(df: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """Adds the sum of ``value`` over the rows before each in the order of the columns; each range is summed by itself."""
    rows = cut(dealt(df, order))
    sizes = rows.groupBy("__p").agg(F.sum(value).alias("__c"))
    # a row per partition
    before = sizes.select(F.col("__p").alias("__q"), (F.sum("__c").over(Window.orderBy("__p")) - F.col("__c")).alias("__b"))
    w = Window.partitionBy("__p").orderBy("__i")
    return rows.withColumn("__s", F.sum(value).over(w) - F.col(value)).join(F.broadcast(before), F.col("__p") == F.col("__q")).withColumn(name, F.col("__s") + F.col("__b")).drop("__p", "__q", "__b", "__i", "__s")


#: Rows of one key that one task joins with as many of the other side.
TILE = 4096
#: Rows of the right side that a row of the left meets one after the other.
BLOCK = 256


def spread_join(left: DataFrame, right: DataFrame, on: list[tuple[str, str]]) -> DataFrame:
    """The inner join on pairs of equal columns, for keys of which both sides may have many rows.

    The rows of a key with more than ``TILE`` are dealt to pieces, and each piece of one side
    meets each of the other in some task: no task makes more than some ``TILE`` x ``TILE``
    pairs of one key at a time, and sizes in bytes, which tell little of the work, decide nothing.

    A piece is joined as one row of arrays.  Its pairs come by blocks: a row of the left with each
    of ``BLOCK`` of the right, the next row with the same ones, and so on.  A file's pages hold
    some 20,000 rows; runs and repeats that are longer than a part of a page compress little.
    """
    n = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [(f"__k{i}", a, b) for i, (a, b) in enumerate(on)]

    def large(df: DataFrame, side: int, name: str) -> DataFrame:
        sizes = df.groupBy(*[F.col(k[side]).alias(f"{name}{k[0]}") for k in keys]).agg(F.count(F.lit(1)).alias("__c"))
        # one row for TILE rows at most
        return F.broadcast(sizes.where(F.col("__c") > TILE).withColumn(name, F.ceil(F.col("__c") / TILE).cast("int")).drop("__c"))

    def pieces(df: DataFrame, side: int, own: str, other: str, made: list[DataFrame]) -> DataFrame:
        """A row for each piece and each of the other side's that it meets, with an array for each column."""
        out = df.dropna(subset=[k[side] for k in keys])
        for name, sizes in zip(("__l", "__r"), made):
            same = [F.col(k[side]) == F.col(f"{name}{k[0]}") for k in keys]
            out = out.join(sizes, same, "left").drop(*[f"{name}{k[0]}" for k in keys]).withColumn(name, F.coalesce(name, F.lit(1)))
        mine, of = f"{own}_at{side}", [F.col(k[side]).alias(f"{k[0]}_{side}") for k in keys]
        out = out.withColumn(mine, F.pmod(F.xxhash64(*df.columns), F.col(own)).cast("int")).repartition(n, *[k[side] for k in keys], mine)
        out = out.groupBy(*of, mine, other).agg(F.collect_list(F.struct(*df.columns)).alias("__rows"))
        out = out.withColumn(f"{other}_at{side}", F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
        at = [*[f"{k[0]}_{side}" for k in keys], f"__l_at{side}", f"__r_at{side}"]
        return out.select(*at, *[F.col("__rows").getField(c).alias(c) for c in df.columns]).repartition(n, *at)

    made = [large(left, 1, "__l"), large(right, 2, "__r")]
    a, b = pieces(left, 1, "__l", "__r", made), pieces(right, 2, "__r", "__l", made)
    blocks = b.withColumn("__start", F.explode(F.sequence(F.lit(1), F.size(right.columns[0]), F.lit(BLOCK))))
    blocks = blocks.select(*[c for c in b.columns if c not in right.columns], *[F.slice(c, F.col("__start"), BLOCK).alias(c) for c in right.columns])
    same = [F.col(f"{x}1") == F.col(f"{x}2") for x in (*[f"{k[0]}_" for k in keys], "__l_at", "__r_at")]
    met = blocks.hint("merge").join(a, same)
    # as many partitions as there are; without it, all pairs of a block and a piece would be held before the first is passed on
    return _each(_each(met, left.columns, right.columns).coalesce(n), right.columns, left.columns)


def _each(df: DataFrame, arrays: list[str], rest: list[str]) -> DataFrame:
    """A row for each place of the arrays, with the columns ``rest`` as they are."""
    first, *more = arrays
    rows = df.select(*rest, *more, F.posexplode(first).alias("__place", first))
    return rows.select(*rest, first, *[F.get(c, F.col("__place")).alias(c) for c in more])
