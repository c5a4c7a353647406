"""Bindings: tables are read when asked for, rows without a key keep their nulls, changed files are read anew."""

from loomgraph.schema import Schema
from loomgraph.sources import tables as T

S = Schema(("A", "B"), {"f": ("B", "A")}, {"x": ("B", "string")})
BIND = {"A": T.Binding("a", "id", {}), "B": T.Binding("b", "__row", {})}


def _write(spark, folder, rows):
    spark.createDataFrame(rows, "k long, f long, x string").write.mode("overwrite").parquet(f"{folder}/b.parquet")


def test_rows_with_null_first_columns_stay(spark, tmp_path):
    folder = f"file://{tmp_path}"
    spark.range(3).write.parquet(f"{folder}/a.parquet")
    _write(spark, folder, [(None, 1, "u"), (2, 0, "v"), (None, None, None), (2, 0, "v"), (-5, 2, "w")])
    got = T.bind(spark, folder, S, BIND)["B"].collect()
    assert sorted((r["id"], r["f"], r["x"]) for r in got) == [(0, None, None), (1, 1, "u"), (2, 2, "w"), (3, 0, "v"), (4, 0, "v")]


def test_overwritten_files_are_numbered_anew(spark, tmp_path):
    folder = f"file://{tmp_path}"
    spark.range(3).write.parquet(f"{folder}/a.parquet")
    _write(spark, folder, [(1, 1, "u"), (2, 0, "v")])
    assert T.bind(spark, folder, S, BIND)["B"].count() == 2
    kept = len(T._NUMBERED)
    assert T.bind(spark, folder, S, BIND)["B"].count() == 2 and len(T._NUMBERED) == kept
    _write(spark, folder, [(i, 0, "z") for i in range(10)])
    assert T.bind(spark, folder, S, BIND)["B"].count() == 10


def test_tables_are_read_when_asked_for(spark, tmp_path):
    folder = f"file://{tmp_path}"
    spark.range(3).write.parquet(f"{folder}/a.parquet")
    g = T.bind(spark, folder, S, BIND)  # there is no file of B
    h = g.replace(A=g["A"].where("id > 0"))
    assert h.nparts("A") == 2 and set(h.tables) == {"A", "B"} and len(h.tables) == 2
    assert g.empty().nparts("A") == 0
