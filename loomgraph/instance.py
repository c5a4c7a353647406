"""Instances: one DataFrame per table, linked by foreign keys."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .pattern import Pattern, Var
from .schema import Schema


class Deferred:
    """A table that is made when it is first asked for, and once."""

    def __init__(self, make: Callable[[], DataFrame]):
        self._make, self._made = make, None

    def get(self) -> DataFrame:
        if self._made is None:
            self._made = self._make()
        return self._made


class Tables(Mapping):
    """Tables by name; deferred ones are made on access, not when an instance is copied."""

    def __init__(self, tables: Mapping[str, DataFrame | Deferred]):
        self._held = dict(tables._held if isinstance(tables, Tables) else tables)

    def __getitem__(self, ob: str) -> DataFrame:
        t = self._held[ob]
        return t.get() if isinstance(t, Deferred) else t

    def __iter__(self) -> Iterator[str]:
        return iter(self._held)

    def __len__(self) -> int:
        return len(self._held)

    def but(self, tables: Mapping[str, DataFrame | Deferred]) -> Tables:
        return Tables({**self._held, **tables})


class Instance:
    """Immutable: every operation gives a new instance.  Tables have ``id``, a column per
    foreign key and per attribute; ids are stable (never renumbered)."""

    def __init__(self, schema: Schema, tables: Mapping[str, DataFrame | Deferred]):
        self.schema, self.tables = schema, Tables(tables)

    @staticmethod
    def of_pattern(spark: SparkSession, p: Pattern) -> tuple[Instance, dict]:
        """A small literal instance (ids 1, 2, ...), and the ids of the pattern's elements.  Variables become null."""
        ids = {(o, k): i for o in p.schema.obs for i, k in enumerate(p.parts[o], 1)}
        s, tables = p.schema, {}
        for o in s.obs:
            rows = [
                (ids[(o, k)], *(ids[(s.homs[h][1], p.homs[h][k])] for h in s.homs_from(o)), *(None if isinstance(p.attrs[a][k], Var) else p.attrs[a][k] for a in s.attrs_of(o)))
                for k in p.parts[o]
            ]
            tables[o] = spark.createDataFrame(rows, s.ddl(o))
        return Instance(s, tables), ids

    def to_pattern(self) -> Pattern:
        """The instance as a pattern; for small ones."""
        rows = {o: sorted((r.asDict() for r in self[o].collect()), key=lambda r: r["id"]) for o in self.schema.obs}
        s = self.schema
        attrs = {a: {r["id"]: r[a] if r[a] is not None else Var((a, r["id"])) for r in rows[o]} for a, (o, _) in s.attrs.items()}
        return Pattern(s, {o: [r["id"] for r in rs] for o, rs in rows.items()}, {h: {r["id"]: r[h] for r in rows[t[0]]} for h, t in s.homs.items()}, attrs)

    def __getitem__(self, ob: str) -> DataFrame:
        return self.tables[ob]

    def replace(self, **tables: DataFrame) -> Instance:
        return Instance(self.schema, self.tables.but(tables))

    def empty(self) -> Instance:
        """No rows in any table; columns as they are."""
        return Instance(self.schema, {o: Deferred(lambda o=o: self[o].where(F.lit(False))) for o in self.schema.obs})

    def parts(self, ob: str) -> DataFrame:
        return self[ob].select("id")

    def nparts(self, ob: str) -> int:
        return self[ob].count()

    def is_empty(self) -> bool:
        return all(t.isEmpty() for t in self.tables.values())

    def add_parts(self, ob: str, rows: DataFrame) -> Instance:
        return self.replace(**{ob: self[ob].unionByName(rows, allowMissingColumns=True)})

    def rem_parts(self, ob: str, ids: DataFrame) -> Instance:
        gone = ids.select(F.col(ids.columns[0]).alias("__id")).distinct()
        return self.replace(**{ob: self[ob].join(gone, F.col("id") == F.col("__id"), "left_anti")})

    def set_subpart(self, ob: str, column: str, patch: DataFrame) -> Instance:
        """``patch(id, value)`` replaces cells of a column."""
        p = patch.select(F.col(patch.columns[0]).alias("__id"), F.col(patch.columns[1]).alias("__v"), F.lit(True).alias("__set"))
        t = self[ob].join(p, F.col("id") == F.col("__id"), "left")
        return self.replace(**{ob: t.withColumn(column, F.when(F.col("__set"), F.col("__v")).otherwise(F.col(column))).select(*self[ob].columns)})

    def subpart(self, ob: str, *path: str) -> DataFrame:
        """``(id, value)`` along a path of foreign keys that may end in an attribute."""
        out = self[ob].select("id", F.col(path[0]).alias("value"))
        at = self.schema.homs[path[0]][1] if path[0] in self.schema.homs else None
        for f in path[1:]:
            step = self[at].select(F.col("id").alias("__k"), F.col(f).alias("__v"))
            out = out.join(step, F.col("value") == F.col("__k")).select("id", F.col("__v").alias("value"))
            at = self.schema.homs[f][1] if f in self.schema.homs else None
        return out

    def incident(self, ob: str, path: tuple[str, ...], values) -> DataFrame:
        """Ids of rows whose path ends in a value (or in one of a DataFrame of values)."""
        ends = self.subpart(ob, *path)
        if isinstance(values, DataFrame):
            v = values.select(F.col(values.columns[0]).alias("__w")).distinct()
            return ends.join(v, F.col("value") == F.col("__w"), "left_semi").select("id")
        return ends.where(F.col("value") == values).select("id")

    def dangling(self, homs: Iterable[str] | None = None) -> DataFrame:
        """``(hom, id)`` of foreign keys that are null or point nowhere; ``homs``: those asked about, and no other's table is read."""
        out = None
        for h, (s, t) in self.schema.homs.items():
            if homs is not None and h not in homs:
                continue
            target = self[t].select(F.col("id").alias("__t"))
            bad = self[s].join(target, F.col(h) == F.col("__t"), "left_anti").select(F.lit(h).alias("hom"), "id")
            out = bad if out is None else out.unionAll(bad)
        return out

    def equation_failures(self) -> DataFrame | None:
        """``(equation, id)`` of rows on which a path equation fails."""
        out = None
        for i, (left, right) in enumerate(self.schema.eqs):
            ob = self.schema.path_ends(left)[0]
            a, b = self.subpart(ob, *left), self.subpart(ob, *right).select(F.col("id").alias("__i"), F.col("value").alias("__v"))
            bad = a.join(b, F.col("id") == F.col("__i")).where(~F.col("value").eqNullSafe(F.col("__v"))).select(F.lit(i).alias("equation"), "id")
            out = bad if out is None else out.unionAll(bad)
        return out

    def is_natural(self) -> bool:
        bad, eq = self.dangling(), self.equation_failures()
        return (bad is None or bad.isEmpty()) and (eq is None or eq.isEmpty())

    def where(self, ob: str, condition: Column) -> Instance:
        return self.replace(**{ob: self[ob].where(condition)})

    def cut(self) -> Instance:
        from .functions.ids import cut

        return Instance(self.schema, {o: cut(t) for o, t in self.tables.items()})
