"""Rewriting controlled by a typing: each row of the instance gets a type in L', and the
rule says for every type how rows of it survive, are copied or vanish.

A rule has patterns L (what is matched), L' (types), K' (copies) and R, with
``tl: L -> L'``, ``l': K' -> L'``, ``tk: K -> K'``, ``l: K -> L`` and ``r: K -> R``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import cut, number_rows
from ..instance import Instance
from ..pattern import Morphism, Pattern, Var, pullback, pushout
from . import algebra as A
from .match import column_of, match


Typing = dict[str, DataFrame]


def _propagate(g: Instance, types: Pattern, cand: Typing) -> Typing:
    """Arc consistency of candidates ``(b, id, type)``, in all branches at once: semi joins along every foreign key, both ways, until nothing changes."""
    s, spark = g.schema, next(iter(g.tables.values())).sparkSession
    before = None
    while True:
        for h, (x, y) in s.homs.items():
            # a table of the pattern's size
            m = F.broadcast(spark.createDataFrame([(str(k), str(v)) for k, v in types.homs[h].items()] or [(None, None)], "tx string, ty string"))
            ends = g[x].select(F.col("id").alias("__x"), F.col(h).alias("__y"))
            to = cand[y].select(F.col("b").alias("__b"), F.col("id").alias("__j"), F.col("type").alias("__u"))
            ok = cand[x].join(ends, F.col("id") == F.col("__x")).join(m, F.col("type") == F.col("tx")).join(to, (F.col("b") == F.col("__b")) & (F.col("__y") == F.col("__j")) & (F.col("ty") == F.col("__u")))
            cand[x] = ok.select("b", "id", "type").distinct()
            # a target's candidate must be reachable from every row that refers to it
            need = g[x].groupBy(F.col(h).alias("__k")).agg(F.count(F.lit(1)).alias("__n"))
            got = ok.groupBy("__b", F.col("__j").alias("__l"), "__u").agg(F.count_distinct("__x").alias("__m"))
            t = cand[y].join(need, F.col("id") == F.col("__k"), "left").join(got, (F.col("b") == F.col("__b")) & (F.col("id") == F.col("__l")) & (F.col("type") == F.col("__u")), "left")
            cand[y] = t.where(F.col("__n").isNull() | (F.col("__m") == F.col("__n"))).select("b", "id", "type")
        cand = {o: cut(c) for o, c in cand.items()}
        now = [c.count() for c in cand.values()]
        if now == before:
            return cand
        before = now


def _kept(cand: Typing, branches: DataFrame) -> Typing:
    alive = branches.select(F.col("b").alias("__alive"))
    return {o: c.join(alive, F.col("b") == F.col("__alive"), "left_semi") for o, c in cand.items()}


def _consistent(g: Instance, cand: Typing, branches: DataFrame) -> DataFrame:
    """Branches in which every row has a candidate, from the numbers of rows that have one."""
    for o in g.schema.obs:
        rows = g[o].agg(F.count(F.lit(1)).alias("__all"))  # one row
        have = cand[o].groupBy(F.col("b").alias("__b")).agg(F.count_distinct("id").alias("__n"))
        branches = branches.join(have, F.col("b") == F.col("__b"), "left").join(F.broadcast(rows)).where(F.coalesce("__n", F.lit(0)) == F.col("__all")).drop("__b", "__n", "__all")
    return branches


def search_typings(g: Instance, types: Pattern, fixed: Typing, branches: DataFrame, avoid: dict[str, list] | None = None, most: int = 10_000) -> tuple[DataFrame, Typing]:
    """All typings of ``g``: ``(b, of)``, a row for each, and its types ``(b, id, type)`` per table.

    ``branches(b)``: what is to be typed on its own, such as matches; ``of`` names it.  ``fixed``:
    ``(b, id, type)``, rows with their only type; ``avoid``: types that no other row may take.

    Branches are searched together: candidates are made arc consistent; each branch with a row
    that has several is split at the first such row, by its types; until no row has
    several.  Branches in which a row has no type end.  A branch with more than ``most``
    descendants in all is refused (``ValueError``), never cut short.
    """
    s = g.schema
    cand: Typing = {}
    for o in s.obs:
        ts = [str(t) for t in types.parts[o] if str(t) not in {str(x) for x in (avoid or {}).get(o, [])}]
        rows = branches.select("b").crossJoin(g[o].select("id"))  # every row of every branch is typed, by definition
        if o in fixed:
            f = fixed[o].select("b", "id", "type")
            own = f.select(F.col("b").alias("__b"), F.col("id").alias("__i"))
            rows = rows.join(own, (F.col("b") == F.col("__b")) & (F.col("id") == F.col("__i")), "left_anti")
        cand[o] = rows.select("b", "id", F.explode(F.array(*[F.lit(t) for t in ts]).cast("array<string>")).alias("type"))
        if o in fixed:
            cand[o] = cand[o].unionByName(f)
    found = cut(branches.select("b", F.col("b").alias("of")))
    while True:
        cand = _propagate(g, types, cand)
        found = cut(_consistent(g, cand, found))
        cand = {o: cut(c) for o, c in _kept(cand, found).items()}
        several = None
        for i, o in enumerate(s.obs):
            open_ = cand[o].groupBy("b", "id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("b", F.lit(i).alias("o"), "id")
            several = open_ if several is None else several.unionAll(open_)
        first = several.groupBy(F.col("b").alias("__b")).agg(F.min(F.struct("o", "id")).alias("at"))
        choices = None
        for i, o in enumerate(s.obs):
            c = cand[o].join(first.where(F.col("at.o") == i), (F.col("b") == F.col("__b")) & (F.col("id") == F.col("at.id"))).select("b", F.lit(i).alias("o"), "id", "type")
            choices = c if choices is None else choices.unionAll(c)
        choices = cut(choices)
        if choices.isEmpty():
            return found, cand
        whole = found.join(choices.select(F.col("b").alias("__b"), "o", "id", "type"), F.col("b") == F.col("__b"), "left").drop("__b")
        split = number_rows(whole, ["b", "type"], "new")  # checkpointed there
        if not split.groupBy("of").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).isEmpty():
            raise ValueError(f"more than {most} typings")
        to = split.select(F.col("b").alias("__b"), "new", F.col("o").alias("__o"), F.col("id").alias("__i"), F.col("type").alias("__t"))
        for i, o in enumerate(s.obs):
            chosen = (F.col("__o") == i) & (F.col("__i") == F.col("id"))
            moved = cand[o].join(to, F.col("b") == F.col("__b")).where(~F.coalesce(chosen, F.lit(False)) | (F.col("type") == F.col("__t")))
            cand[o] = cut(moved.select(F.col("new").alias("b"), "id", "type"))
        found = cut(split.select(F.col("new").alias("b"), "of"))


def typings(g: Instance, types: Pattern, fixed: Typing | None = None, avoid: dict[str, list] | None = None) -> Typing:
    """``(id, type)`` candidates per table by arc consistency; ``fixed``: ids with their only type; ``avoid``: types that no other row may take."""
    s, cand = g.schema, {}
    for o in s.obs:
        ts = [str(t) for t in types.parts[o] if str(t) not in {str(x) for x in (avoid or {}).get(o, [])}]
        rows = g[o].select(F.lit(0).alias("b"), "id")
        if fixed and o in fixed:
            rows = rows.join(fixed[o].select(F.col("id").alias("__i")), F.col("id") == F.col("__i"), "left_anti")
        cand[o] = rows.select("b", "id", F.explode(F.array(*[F.lit(t) for t in ts]).cast("array<string>")).alias("type"))
        if fixed and o in fixed:
            cand[o] = cand[o].unionByName(fixed[o].select(F.lit(0).alias("b"), "id", "type"))
    return {o: c.drop("b") for o, c in _propagate(g, types, cand).items()}


def partial_abstract(L: Pattern, m: DataFrame, g: Instance) -> dict[str, DataFrame]:
    """``(b, id, value, variable)`` per attribute: ``g`` with its values freed as far as matches ``m`` (numbered ``b``) of ``L`` allow.

    A value stays where a matched element of ``L`` has one; a cell that a variable of ``L`` is
    matched to becomes that variable, the same for all of them; every other cell becomes a
    variable of its own.
    """
    s, out = g.schema, {}
    for a, (o, _) in s.attrs.items():
        cells = m.select("b").crossJoin(g[o].select("id", F.col(a).alias("__value")))  # a copy of the table for each match, by definition
        told = None
        for k in L.parts[o]:
            v = L.attrs[a][k]
            row = m.select(F.col("b").alias("__b"), F.col(column_of((o, k))).alias("__i"), F.lit(None if not isinstance(v, Var) else f"L.{v.name}").cast("string").alias("__var"), F.lit(not isinstance(v, Var)).alias("__fixed"))
            told = row if told is None else told.unionAll(row)
        if told is None:
            out[a] = cells.select("b", "id", F.lit(None).cast(s.attrs[a][1]).alias("value"), F.concat(F.lit(f"{o}."), F.col("id"), F.lit(f".{a}")).alias("variable"))
            continue
        told = told.groupBy("__b", "__i").agg(F.max("__fixed").alias("__fixed"), F.min("__var").alias("__var"))
        both = cells.join(told, (F.col("b") == F.col("__b")) & (F.col("id") == F.col("__i")), "left")
        fixed = F.coalesce("__fixed", F.lit(False))
        out[a] = both.select("b", "id", F.when(fixed, F.col("__value")).alias("value"), F.when(~fixed, F.coalesce("__var", F.concat(F.lit(f"{o}."), F.col("id"), F.lit(f".{a}")))).alias("variable"))
    return out


@dataclass
class TypedRule:
    """``adherence(g, match row) -> table -> DataFrame(id, type)`` gives a typing; without it one is searched.

    ``k_exprs``: (attribute, element of K') -> function of the old value's Column and a dict
    of the match's variables (name -> Column).  ``lcs``: conditions on typings, functions of
    ``(b, id, type)`` per table and the instance that give the ``b`` that satisfy them.
    """

    l: Morphism  # noqa: E741
    r: Morphism
    tl: Morphism
    tk: Morphism
    lp: Morphism
    conditions: list = field(default_factory=list)
    adherence: Callable | None = None
    exprs: dict = field(default_factory=dict)
    k_exprs: dict = field(default_factory=dict)
    lcs: list = field(default_factory=list)

    def normal(self) -> TypedRule:
        """The rule whose lower square is a pullback, with the same effect: K becomes that of ``tl`` and ``l'``, and R is glued to what is new in it."""
        l, tk = pullback(self.tl, self.lp)  # noqa: E741
        n = Morphism(self.l.dom, l.dom, {o: {k: (self.l(o, k), self.tk(o, k)) for k in ks} for o, ks in self.l.dom.parts.items()})
        r, _ = pushout(n, self.r)
        return replace(self, l=l, tk=tk, r=r)

    def all_typings(self, g: Instance, m: DataFrame, most: int = 10_000) -> tuple[DataFrame, DataFrame, Typing]:
        """Matches with numbers ``b``; ``(b, of)``, a row for each strong typing of a match ``of``; and its types."""
        L = self.l.cod
        m = cut(number_rows(m, [column_of(e) for e in L.elements()], "b"))
        fixed = {}
        for o in g.schema.obs:
            rows = [m.select("b", F.col(column_of((o, k))).alias("id"), F.lit(str(self.tl(o, k))).alias("type")) for k in L.parts[o]]
            if rows:
                fixed[o] = reduce(DataFrame.union, rows)
        found, types = search_typings(g, self.tl.cod, fixed, m.select("b"), {o: [self.tl(o, k) for k in L.parts[o]] for o in g.schema.obs}, most)
        for c in self.lcs:
            ok = c(types, g).select(F.col("b").alias("__b")).distinct()
            found = found.join(ok, F.col("b") == F.col("__b"), "left_semi")
        return m, found, _kept(types, found)

    def matches(self, g: Instance) -> DataFrame:
        m = match(self.l.cod, g, True, prune=False)
        for c in self.conditions:
            m = c.holds(m, g)
        return m

    def typing(self, g: Instance, m: DataFrame) -> dict[str, DataFrame] | None:
        """The typing at one match (a DataFrame of one row); None if there is no (single) strong one."""
        L = self.l.cod
        fixed = {}
        for o in g.schema.obs:
            rows = [m.select(F.col(column_of((o, k))).alias("id"), F.lit(str(self.tl(o, k))).alias("type")) for k in L.parts[o]]
            if rows:
                fixed[o] = reduce(DataFrame.union, rows)
        if self.adherence:
            found = {**self.adherence(g, m)}
            for o, f in fixed.items():
                own = f.select(F.col("id").alias("__i"))
                rest = found[o].join(own, F.col("id") == F.col("__i"), "left_anti")
                bad = rest.where(F.col("type").isin([str(self.tl(o, k)) for k in L.parts[o]]))
                if not bad.isEmpty():  # strong match: only matched rows have L's types
                    return None
                found[o] = rest.unionByName(f)
            return found
        cand = typings(g, self.tl.cod, fixed, {o: [self.tl(o, k) for k in L.parts[o]] for o in g.schema.obs})
        for o in g.schema.obs:
            per = cand[o].groupBy("id").agg(F.count(F.lit(1)).alias("n"))
            if g[o].join(per.select(F.col("id").alias("__i")), F.col("id") == F.col("__i"), "left_anti").limit(1).count():
                return None
            if not per.where("n > 1").isEmpty():
                raise ValueError(f"rows of {o} have several types: give an adherence function, or use all_typings")
        return cand

    def apply(self, g: Instance, m: DataFrame, typing: dict[str, DataFrame]) -> Instance:
        """Pullback of the typing with ``l'`` (K' is broadcast: it has a pattern's size), then R is added and merged."""
        s, Kp, spark = g.schema, self.lp.dom, m.sparkSession
        copies: dict[str, DataFrame] = {}
        for o in s.obs:
            k = F.broadcast(spark.createDataFrame([(str(x), str(self.lp(o, x))) for x in Kp.parts[o]] or [(None, None)], "k string, t string"))
            pairs = typing[o].join(k, F.col("type") == F.col("t")).select(F.col("id").alias("old"), "k")
            low = pairs.groupBy(F.col("old").alias("__o")).agg(F.min("k").alias("__f"))
            pairs = pairs.join(low, F.col("old") == F.col("__o"))
            same = pairs.where("k = __f").select("old", "k", F.col("old").alias("id"))
            more = number_rows(pairs.where("k <> __f").select("old", "k"), ["old", "k"], "__n").join(F.broadcast(A.next_ids(g, o))).select("old", "k", (F.col("__n") + F.col("__base")).alias("id"))
            copies[o] = cut(same.unionByName(more))
        tables = {}
        for o in s.obs:
            t = copies[o].join(g[o].withColumnRenamed("id", "__i"), F.col("old") == F.col("__i"))
            for h in s.homs_from(o):
                to = F.broadcast(spark.createDataFrame([(str(x), str(y)) for x, y in Kp.homs[h].items()] or [(None, None)], "__a string, __b string"))
                c = copies[s.homs[h][1]].select(F.col("old").alias("__o2"), F.col("k").alias("__k2"), F.col("id").alias("__n2"))
                t = t.join(to, F.col("k") == F.col("__a")).join(c, (F.col(h) == F.col("__o2")) & (F.col("__b") == F.col("__k2"))).withColumn(h, F.col("__n2")).drop("__a", "__b", "__o2", "__k2", "__n2")
            bound = {c.removeprefix("var_"): F.col(f"__{c}") for c in m.columns if c.startswith("var_")}
            if bound and any(name in s.attrs_of(o) for name, _ in self.k_exprs):
                t = t.crossJoin(F.broadcast(m.select(*[F.col(f"var_{v}").alias(f"__var_{v}") for v in bound])))  # one row: the match
            values = []
            for a in s.attrs_of(o):
                v: Column = F.col(a)
                for (name, k), f in self.k_exprs.items():
                    if name == a:
                        v = F.when(F.col("k") == str(k), f(F.col(a), bound)).otherwise(v)
                values.append(v.cast(s.attrs[a][1]).alias(a))
            tables[o] = t.select("id", *s.homs_from(o), *values)
        h = Instance(s, tables)
        row = m
        for o, k in self.l.dom.elements():
            c = copies[o].where(F.col("k") == str(self.tk(o, k))).select(F.col("old").alias("__o"), F.col("id").alias(f"kept_{column_of((o, k))}"))
            row = row.join(c, F.col(column_of((o, self.l(o, k)))) == F.col("__o")).drop("__o")
        from .rewrite import Rule

        span = Rule.__new__(Rule)  # the additive half of a rewrite, with K as its interface
        span.left, span.right, span.exprs, span.freevar, span.semantics = self.l, self.r, self.exprs, True, "DPO"
        for o in dict.fromkeys(e[0] for e in span.added()):
            mine = [e for e in span.added() if e[0] == o]
            row = row.join(F.broadcast(A.next_ids(h, o)))
            for i, e in enumerate(mine):
                row = row.withColumn(f"new_{column_of(e)}", F.col("__base") + i)
            row = row.drop("__base")
        row = cut(row)
        columns = {(o, k): f"kept_{column_of((o, k))}" for o, k in self.l.dom.elements()}
        image = {(o, self.r(o, k)): F.col(columns[(o, k)]) for o, k in self.l.dom.elements()}
        return span._glue(span._add(h, row, image), row, columns)

    def rewrite(self, g: Instance) -> Instance | None:
        """At the first match (by ids) that has a strong typing, with its first typing.

        Typings of all matches are sought together; an adherence function is asked match by
        match.
        """
        found = cut(self.matches(g))
        if self.adherence is None:
            m, kinds, types = self.all_typings(g, found)
            best = kinds.agg(F.min(F.struct("of", "b")).alias("x")).select("x.*")
            one = cut(m.join(F.broadcast(best), F.col("of") == m["b"]).drop(m["b"]))
            if one.where("of is not null").isEmpty():
                return None
            chosen = F.broadcast(one.select(F.col("b").alias("__b")))
            typing = {o: t.join(chosen, F.col("b") == F.col("__b"), "left_semi").select("id", "type") for o, t in types.items()}
            return self.apply(g, one.drop("of", "b"), typing)
        keys = [column_of(e) for e in self.l.cod.elements()]
        numbered = cut(number_rows(found, keys, "__n"))
        for i in range(numbered.count()):
            m = numbered.where(F.col("__n") == i).drop("__n")
            typing = self.typing(g, m)
            if typing is not None:
                return self.apply(g, m, typing)
        return None
