"""Rules compiled to programs: a list of instructions that is made once and run on any instance.

An instruction says what becomes of a row or a cell, in terms of the columns of a match:

* ``Del(table, match column)``;
* ``Set(table, match column, attribute, value)`` on a row that stays;
* ``Add(table, register)``, with ``Link(register, key, column or register)`` and
  ``Fill(register, attribute, value)`` for its cells.

``run`` makes a plan for each table that an instruction names, whatever the number of
matches; other tables are not touched.  A program is a plain value: it shows what a rule
does, and can be stored and run again without the rule's patterns.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import cut, number_rows
from ..instance import Instance
from ..pattern import Element, Var
from .algebra import next_ids
from .match import column_of
from .rewrite import Rule

Value = object  # a constant, ("var", name) for a variable of the match, or ("expr", function of the variables)


@dataclass(frozen=True)
class Del:
    table: str
    row: str


@dataclass(frozen=True)
class Set:
    table: str
    row: str
    attr: str
    value: Value


@dataclass(frozen=True)
class Add:
    table: str
    register: str


@dataclass(frozen=True)
class Link:
    register: str
    key: str
    to: str


@dataclass(frozen=True)
class Fill:
    register: str
    attr: str
    value: Value


Instruction = Del | Set | Add | Link | Fill


def _cell(value: Value, kind: str, m: DataFrame) -> Column:
    have = {c.removeprefix("var_"): F.col(c) for c in m.columns if c.startswith("var_")}
    if isinstance(value, tuple) and value[0] == "expr":
        return value[1](have).cast(kind)
    if isinstance(value, tuple):
        return have[value[1]].cast(kind) if value[1] in have else F.lit(None).cast(kind)
    return F.lit(value).cast(kind)


@dataclass(frozen=True)
class Program:
    """What a double-pushout rule with injective legs does to a match."""

    instructions: tuple[Instruction, ...]
    matches: Callable[[Instance], DataFrame]

    def tables(self) -> list[str]:
        """The tables that a run touches."""
        return list(dict.fromkeys(i.table for i in self.instructions if isinstance(i, (Del, Set, Add))))

    def patches(self, g: Instance, m: DataFrame) -> tuple[dict[str, DataFrame], dict[str, DataFrame], dict[str, DataFrame], DataFrame]:
        """Per table the ids to delete, the values to set, and the rows to add; and the matches with new ids."""
        s, of = g.schema, {i.register: i.table for i in self.instructions if isinstance(i, Add)}
        if of:
            m = number_rows(m, [c for c in m.columns if not c.startswith("var_")], "__m")
            for o in dict.fromkeys(of.values()):
                mine = [r for r, t in of.items() if t == o]
                m = m.join(F.broadcast(next_ids(g, o)))  # one row
                m = m.withColumns({r: F.col("__base") + F.col("__m") * len(mine) + i for i, r in enumerate(mine)}).drop("__base")
            m = cut(m.drop("__m"))
        gone, values, rows = {}, {}, {}
        for i in self.instructions:
            if isinstance(i, Del):
                ids = m.select(F.col(i.row).alias("id"))
                gone[i.table] = gone[i.table].union(ids) if i.table in gone else ids
        for o in dict.fromkeys(i.table for i in self.instructions if isinstance(i, Set)):
            parts = []
            for row in dict.fromkeys(i.row for i in self.instructions if isinstance(i, Set) and i.table == o):
                new = {i.attr: i.value for i in self.instructions if isinstance(i, Set) and (i.table, i.row) == (o, row)}
                cells = [(_cell(new[a], s.attrs[a][1], m) if a in new else F.lit(None).cast(s.attrs[a][1])).alias(a) for a in s.attrs_of(o)]
                parts.append(m.select(F.col(row).alias("id"), *cells, *[F.lit(a in new).alias(f"{a}__set") for a in s.attrs_of(o)]))
            both = reduce(DataFrame.unionAll, parts)
            values[o] = both.groupBy("id").agg(*[F.max(c).alias(c) for c in both.columns if c != "id"])
        for r, o in of.items():
            keys = {i.key: i.to for i in self.instructions if isinstance(i, Link) and i.register == r}
            cells = {i.attr: i.value for i in self.instructions if isinstance(i, Fill) and i.register == r}
            new = m.select(F.col(r).alias("id"), *[F.col(keys[h]).alias(h) for h in s.homs_from(o)], *[_cell(cells[a], s.attrs[a][1], m).alias(a) for a in s.attrs_of(o)])
            rows[o] = rows[o].unionByName(new) if o in rows else new
        return {o: d.distinct() for o, d in gone.items()}, values, rows, m

    def run(self, g: Instance, m: DataFrame | None = None) -> Instance:
        """At all of ``m`` (by default at all matches), which must not conflict."""
        gone, values, rows, _ = self.patches(g, cut(self.matches(g)) if m is None else m)
        out = {}
        for o in self.tables():
            t, attrs = g[o], g.schema.attrs_of(o)
            columns = t.columns
            if o in gone:
                t = t.join(gone[o].select(F.col("id").alias("__gone")), F.col("id") == F.col("__gone"), "left_anti")
            if o in values:
                p = values[o].select(F.col("id").alias("__p"), *[F.col(c).alias(f"__new_{c}") for c in values[o].columns if c != "id"])
                t = t.join(p, F.col("id") == F.col("__p"), "left").select(*[F.when(F.col(f"__new_{c}__set"), F.col(f"__new_{c}")).otherwise(F.col(c)).alias(c) if c in attrs else F.col(c) for c in columns])
            if o in rows:
                t = t.unionByName(rows[o], allowMissingColumns=True)
            out[o] = t
        return g.replace(**out)

    def show(self) -> str:
        def value(v: Value) -> str:
            return f"?{v[1]}" if isinstance(v, tuple) and v[0] == "var" else "f(...)" if isinstance(v, tuple) else repr(v)

        lines = []
        for i in self.instructions:
            if isinstance(i, Del):
                lines.append(f"del {i.table}[{i.row}]")
            elif isinstance(i, Set):
                lines.append(f"set {i.table}[{i.row}].{i.attr} = {value(i.value)}")
            elif isinstance(i, Add):
                lines.append(f"add {i.table} as {i.register}")
            elif isinstance(i, Link):
                lines.append(f"    {i.register}.{i.key} = {i.to}")
            else:
                lines.append(f"    {i.register}.{i.attr} = {value(i.value)}")
        return "\n".join(lines)


def compile_rule(r: Rule) -> Program:
    """``ValueError`` for rules that are not double-pushout or that merge."""
    if r.semantics != "DPO" or not r.left.is_monic() or not r.right.is_monic():
        raise ValueError("only DPO rules whose legs are injective can be compiled")
    s, out = r.R.schema, []
    at = {(o, r.right(o, k)): column_of((o, r.left(o, k))) for o, k in r.I.elements()}

    def value(a: str, e: Element) -> Value:
        v = r.R.attrs[a][e[1]]
        if not isinstance(v, Var):
            return v
        return ("expr", r.exprs[v.name]) if v.name in r.exprs else ("var", str(v.name))

    out += [Del(e[0], column_of(e)) for e in r.deleted()]
    out += [Set(e[0], column_of(e), a, value(a, to)) for e, values in r.updates().items() for a, to in values.items()]
    at |= {e: f"new_{column_of(e)}" for e in r.added()}
    for e in r.added():
        out.append(Add(e[0], at[e]))
        out += [Link(at[e], h, at[(s.homs[h][1], r.R.homs[h][e[1]])]) for h in s.homs_from(e[0])]
        out += [Fill(at[e], a, value(a, e)) for a in s.attrs_of(e[0])]
    return Program(tuple(out), r.matches)
