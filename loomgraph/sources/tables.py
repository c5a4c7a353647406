"""Sources and sinks: instances over Parquet or JSON tables, and bindings of existing tables."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import dealt, numbered, shared_dir
from ..instance import Deferred, Instance
from ..schema import Schema


@dataclass(frozen=True)
class Binding:
    """How a table of a schema is read: its file, the column that is its id, and renamed columns."""

    table: str
    id: str | Column
    columns: dict[str, str]


def bind(spark: SparkSession, folder: str, schema: Schema, bindings: dict[str, Binding]) -> Instance:
    """An instance over ``<folder>/<table>.parquet``; columns are pruned to those that the schema names.

    A table is read when it is first asked for; what a query doesn't use costs nothing.
    """
    return Instance(schema, {o: _lazy(spark, f"{folder}/{b.table}.parquet", schema, o, b) for o, b in bindings.items()})


def _lazy(spark: SparkSession, path: str, schema: Schema, o: str, b: Binding) -> Deferred:
    def read_() -> DataFrame:
        df = spark.read.parquet(path)
        if isinstance(b.id, str) and b.id == "__row":
            return _numbered(spark, path, df, _columns(schema, o, b))
        key = F.col(b.id) if isinstance(b.id, str) else b.id
        return df.select(key.cast("long").alias("id"), *_columns(schema, o, b))

    return Deferred(read_)


_NUMBERED: dict[tuple, str] = {}


def _version(df: DataFrame) -> tuple:
    """Tells the files of a table, by path, size and time, from what they are after any change; reads no columns."""
    files = df.select(F.col("_metadata.file_path").alias("p"), F.col("_metadata.file_size").alias("s"), F.col("_metadata.file_modification_time").alias("t")).distinct()
    return tuple(files.agg(F.count(F.lit(1)), F.sum("s"), F.sum(F.xxhash64("p", "s", "t").cast("decimal(38,0)"))).first())


def _numbered(spark: SparkSession, path: str, df: DataFrame, columns: list[Column]) -> DataFrame:
    """A table without a key: a row's id is its number in the order of all its columns (nulls first).

    Numbered by ranges, so no task orders all rows, and written to the shared folder at
    the first call of a session: numbering sorts a table, and would do so again for each
    of its mentions in a plan.  Files that have changed since are numbered anew.
    """
    wanted = df.select(F.lit(0).cast("long").alias("id"), *columns).schema
    key = (spark.sparkContext.applicationId, path, _version(df), wanted.simpleString())
    if key not in _NUMBERED:
        to = f"{shared_dir(spark).rstrip('/')}/numbered-{uuid.uuid4().hex}"
        # what only the order needs is moved once, and not stored
        dealt(df, df.columns, *columns).write.parquet(f"{to}-dealt")
        numbered(spark.read.parquet(f"{to}-dealt"), "id").select(*wanted.names).write.parquet(to)
        _NUMBERED[key] = to
    return spark.read.schema(wanted).parquet(_NUMBERED[key])


def _columns(schema: Schema, o: str, b: Binding) -> list[Column]:
    keys = [F.col(b.columns.get(h, h)).cast("long").alias(h) for h in schema.homs_from(o)]
    return keys + [F.col(b.columns.get(a, a)).alias(a) for a in schema.attrs_of(o)]


STORE = Schema(
    ("Region", "Nation", "Customer", "Supplier", "Part", "Orders", "LineItem", "Event"),
    {
        "n_regionkey": ("Nation", "Region"), "c_nationkey": ("Customer", "Nation"), "s_nationkey": ("Supplier", "Nation"), "o_custkey": ("Orders", "Customer"),
        "l_orderkey": ("LineItem", "Orders"), "l_partkey": ("LineItem", "Part"), "l_suppkey": ("LineItem", "Supplier"), "user_id": ("Event", "Customer"),
    },
    {
        "r_name": ("Region", "string"), "n_name": ("Nation", "string"), "c_mktsegment": ("Customer", "string"), "c_acctbal": ("Customer", "double"), "s_name": ("Supplier", "string"),
        "p_brand": ("Part", "string"), "p_type": ("Part", "string"), "p_size": ("Part", "int"), "o_orderstatus": ("Orders", "string"), "o_orderpriority": ("Orders", "string"),
        "l_quantity": ("LineItem", "double"), "l_returnflag": ("LineItem", "string"), "l_linestatus": ("LineItem", "string"), "event_type": ("Event", "string"),
    },
)

_IDS = {"Region": "r_regionkey", "Nation": "n_nationkey", "Customer": "c_custkey", "Supplier": "s_suppkey", "Part": "p_partkey", "Orders": "o_orderkey", "LineItem": "__row", "Event": "event_id"}


def store(spark: SparkSession, folder: str) -> Instance:
    """The order tables as an instance of ``STORE``."""
    files = {"Event": "events"}
    return bind(spark, folder, STORE, {o: Binding(files.get(o, o.lower()), i, {}) for o, i in _IDS.items()})


def write(g: Instance, folder: str, kind: str = "parquet") -> None:
    """One dataset per table; ``kind``: parquet or json."""
    for o in g.schema.obs:
        g[o].write.mode("overwrite").format(kind).save(f"{folder}/{o}")


def read(spark: SparkSession, folder: str, schema: Schema, kind: str = "parquet") -> Instance:
    return Instance(schema, {o: spark.read.schema(schema.ddl(o)).format(kind).load(f"{folder}/{o}") for o in schema.obs})
