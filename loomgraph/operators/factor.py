"""Matches carried along a map of instances: pulled back to where it starts, or lifted over where it ends.

A map of instances is a dict table -> DataFrame(src, tgt); a table that it doesn't name is
mapped by the ids themselves.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..instance import Instance
from ..pattern import Pattern, Var
from .match import column_of, var_column

Map = dict[str, DataFrame]


def _all(conditions: list):
    return reduce(lambda x, y: x & y, conditions, F.lit(True))


def pull_back(p: Pattern, m: DataFrame, f: Map, sub: Instance) -> DataFrame:
    """The matches ``m`` of ``p`` in X as matches in ``sub``, for a map ``f`` from ``sub`` to X.

    A match is pulled back if each of its elements has exactly one row that goes to it; one
    with an element that none or several go to is dropped.  Fixed attributes of ``p`` must
    hold in ``sub``, too, and an attribute variable must have one value wherever it is used
    there; its column has that value.  Columns are those of ``m``.
    """
    s, out = p.schema, m
    for o, k in p.elements():
        c = column_of((o, k))
        if c not in m.columns:
            continue
        if o in f:
            back = f[o].groupBy("tgt").agg(F.min("src").alias("__s"), F.count(F.lit(1)).alias("__n")).where("__n = 1").select(F.col("tgt").alias("__t"), "__s")
            out = out.join(back, F.col(c) == F.col("__t")).withColumn(c, F.col("__s")).drop("__s", "__t")
        else:
            out = out.join(sub[o].select(F.col("id").alias("__t")), F.col(c) == F.col("__t"), "left_semi")
    told = {c for c in m.columns if c.startswith("var_")}
    uses: dict[Var, int] = {}
    for a in s.attrs:
        for v in p.attrs[a].values():
            if isinstance(v, Var):
                uses[v] = uses.get(v, 0) + 1
    held: dict[Var, str] = {}
    for o, k in p.elements():
        c = column_of((o, k))
        wanted = {a: p.attrs[a][k] for a in s.attrs_of(o) if not isinstance(p.attrs[a][k], Var) or uses[p.attrs[a][k]] > 1 or var_column(p.attrs[a][k]) in told}
        if c not in m.columns or not wanted:
            continue
        row = sub[o].select(F.col("id").alias("__i"), *[F.col(a).alias(f"__{c}_{a}") for a in wanted])
        out = out.join(row, F.col(c) == F.col("__i")).drop("__i")
        for a, v in wanted.items():
            at = f"__{c}_{a}"
            if not isinstance(v, Var):
                out = out.where(F.col(at).eqNullSafe(F.lit(v)))
            elif v in held:
                out = out.where(F.col(at).eqNullSafe(F.col(held[v])))
            else:
                held[v] = at
    values = {var_column(v): F.col(at) for v, at in held.items() if var_column(v) in told}
    return out.select(*[values.get(c, F.col(c)).alias(c) for c in m.columns])


def lifts(p: Pattern, m: DataFrame, over: Map, b: Instance, monic=()) -> DataFrame:
    """All ways to lift the matches ``m`` of ``p`` in X to ``b``, for a map ``over`` from ``b`` to X.

    A row for each pair of a match in ``m`` and a match of ``p`` in ``b`` that ``over`` takes to
    it: columns of ``m``, and ``lift_<column>`` for the elements.  An element that a lifted
    row's key gives is looked up, not enumerated, so preimages are multiplied only where
    nothing ties them.  A match with an element that nothing goes to has no lift.
    Fixed attributes hold in ``b`` if they are attributes of ``p``.
    """
    s, out = p.schema, m
    monic = set(s.obs) if monic is True else set(monic or ())
    named = [e for e in p.elements() if column_of(e) in m.columns]
    placed: dict = {}
    while len(placed) < len(named):
        left = [e for e in named if e not in placed]
        given = {e: [k for k in (placed[x].get(h) for x in placed for h in s.homs_from(x[0]) if (s.homs[h][1], p.homs[h][x[1]]) == e) if k] for e in left}
        near = [e for e in left if given[e]]
        # else the element with the most keys, so that the others follow from it
        o, k = near[0] if near else max(left, key=lambda e: (len(s.homs_from(e[0])), str(e)))
        c = column_of((o, k))
        lifted = f"lift_{c}"
        if o in over:
            to = over[o].select(F.col("tgt").alias("__t"), F.col("src").alias(lifted)).distinct()
        else:
            to = b[o].select(F.col("id").alias("__t"), F.col("id").alias(lifted))
        out = out.join(to, _all([F.col(c) == F.col("__t"), *[F.col(lifted) == F.col(x) for x in given[(o, k)]]])).drop("__t", *given[(o, k)])
        keys = {h: f"__{c}_{h}" for h in s.homs_from(o) if (s.homs[h][1], p.homs[h][k]) in named}
        fixed = [F.col(a).eqNullSafe(F.lit(p.attrs[a][k])) for a in s.attrs_of(o) if not isinstance(p.attrs[a][k], Var)]
        if keys or fixed:
            row = b[o].where(_all(fixed)).select(F.col("id").alias("__i"), *[F.col(h).alias(x) for h, x in keys.items()])
            out = out.join(row, F.col(lifted) == F.col("__i")).drop("__i")
        for x in placed:
            if x[0] == o and o in monic:
                out = out.where(F.col(f"lift_{column_of(x)}") != F.col(lifted))
        placed[(o, k)] = {}
        for h, x in keys.items():
            t = (s.homs[h][1], p.homs[h][k])
            if t in placed:
                out = out.where(F.col(x) == F.col(f"lift_{column_of(t)}")).drop(x)
            else:
                placed[(o, k)][h] = x
        for x in placed:  # keys that the join has used up
            placed[x] = {h: y for h, y in placed[x].items() if y in out.columns}
    return out.select(*m.columns, *[f"lift_{column_of(e)}" for e in named])
