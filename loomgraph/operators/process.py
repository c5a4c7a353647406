"""Causality: which step of a rewrite history needs which other."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .match import column_of
from .rewrite import Rule


def step_events(i: int, rule: Rule, placed: DataFrame) -> DataFrame:
    """``(step, ob, id, role)`` of one step: what it created, and what it used (preserved or deleted)."""
    out = None
    for e in rule.added():
        d = placed.select(F.lit(i).alias("step"), F.lit(e[0]).alias("ob"), F.col(f"new_{column_of(e)}").alias("id"), F.lit("created").alias("role"))
        out = d if out is None else out.union(d)
    for e in rule.L.elements():
        if column_of(e) in placed.columns:
            d = placed.select(F.lit(i).alias("step"), F.lit(e[0]).alias("ob"), F.col(column_of(e)).alias("id"), F.lit("used").alias("role"))
            out = d if out is None else out.union(d)
    return out


def dependencies(events: DataFrame, merged: DataFrame | None = None) -> DataFrame:
    """``(i, j)``: step ``j`` used what step ``i`` created.  ``merged(ob, node, root)`` renames merged ids."""
    e = events
    if merged is not None:
        m = merged.select(F.col("ob").alias("__o"), F.col("node").alias("__n"), F.col("root").alias("__r"))
        e = e.join(m, (F.col("ob") == F.col("__o")) & (F.col("id") == F.col("__n")), "left").select("step", "ob", F.coalesce("__r", "id").alias("id"), "role")
    made = e.where("role = 'created'").select(F.col("step").alias("i"), "ob", "id")
    used = e.where("role = 'used'").select(F.col("step").alias("j"), F.col("ob").alias("o2"), F.col("id").alias("i2"))
    return made.join(used, (F.col("ob") == F.col("o2")) & (F.col("id") == F.col("i2")) & (F.col("i") != F.col("j"))).select("i", "j").distinct()
