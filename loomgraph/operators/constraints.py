"""Application conditions, set-at-a-time: quantifiers become semi and anti joins.

A condition is evaluated on a DataFrame of assignments (columns named as in ``match``).
``holds`` gives the assignments on which it is true; ``mark`` adds that as a column, so that
a condition inside others is evaluated once, however they are nested.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import cut
from ..instance import Instance
from ..pattern import Element, Morphism, Pattern, Var
from .match import column_of, match, without_implied

_FLAG = "__ok"
_NUMBERS = count()


def _flag() -> str:
    return f"{_FLAG}{next(_NUMBERS)}"


def _own(rows: DataFrame) -> list[str]:
    """The columns of an assignment, without flags."""
    return [c for c in rows.columns if not c.startswith(_FLAG)]


class Condition:
    def __and__(self, other):
        return And(self, other)

    def __or__(self, other):
        return Or(self, other)

    def __invert__(self):
        return Not(self)

    def holds(self, rows: DataFrame, g: Instance) -> DataFrame:
        flag = _flag()
        return self.mark(rows, g, flag).where(F.col(flag)).drop(flag)

    def mark(self, rows: DataFrame, g: Instance, flag: str) -> DataFrame:
        """``rows`` with a boolean column ``flag``, never null."""
        raise NotImplementedError


def _same(rows: DataFrame, other: DataFrame, kind: str, flag: str | None = None) -> DataFrame:
    """Joins with the distinct assignments of ``other`` (or parts of them that tell); a left join tells in ``flag`` whether it has the row's."""
    keys = [c for c in _own(rows) if c in other.columns]
    o = other.select(*[F.col(c).alias(f"__{c}") for c in keys]).distinct()
    on = F.lit(True)
    for c in keys:
        on = on & F.col(c).eqNullSafe(F.col(f"__{c}"))
    if kind != "left":
        return rows.join(o, on, kind)
    hit = f"{flag}_"
    return rows.join(o.withColumn(hit, F.lit(True)), on, "left").select(*rows.columns, F.col(hit).isNotNull().alias(flag))


@dataclass
class Const(Condition):
    value: bool

    def mark(self, rows, g, flag):
        return rows.withColumn(flag, F.lit(self.value))


@dataclass
class _Both(Condition):
    left: Condition
    right: Condition

    def mark(self, rows, g, flag):
        a, b = _flag(), _flag()
        both = self.right.mark(self.left.mark(rows, g, a), g, b)
        return both.withColumn(flag, self.of(F.col(a), F.col(b))).drop(a, b)


class And(_Both):
    of = staticmethod(lambda a, b: a & b)

    def holds(self, rows, g):
        return self.right.holds(self.left.holds(rows, g), g)


class Or(_Both):
    of = staticmethod(lambda a, b: a | b)


@dataclass
class Not(Condition):
    inner: Condition

    def mark(self, rows, g, flag):
        return self.inner.mark(rows, g, flag).withColumn(flag, ~F.col(flag))

    def holds(self, rows, g):
        if isinstance(self.inner, _Quantified):
            found, true = self.inner.witness(rows, g)
            return _same(rows, found, "left_anti" if true else "left_semi")
        return super().holds(rows, g)


@dataclass
class Commutes(Condition):
    """Equalities (or, with ``commutes=False``, not all of them) between columns of the assignment.

    ``pairs``: pairs of ``(column, *foreign keys)``.  A path over a missing key ends in
    null, which equals null alone.
    """

    pairs: list[tuple[tuple[str, ...], tuple[str, ...]]]
    obs: dict[str, str]
    commutes: bool = True

    def mark(self, rows, g, flag):
        out, equal = rows, F.lit(True)
        for i, pair in enumerate(self.pairs):
            ends = []
            for j, (start, *path) in enumerate(pair):
                at = F.col(start)
                if path:
                    c = f"{flag}p{i}_{j}"
                    step = g.subpart(self.obs[start], *path).select(F.col("id").alias(f"{c}k"), F.col("value").alias(c))
                    out = out.join(step, F.col(start) == F.col(f"{c}k"), "left")
                    at = F.col(c)
                ends.append(at)
            equal = equal & ends[0].eqNullSafe(ends[1])
        return out.select(*rows.columns, (equal if self.commutes else ~equal).alias(flag))


@dataclass
class _Quantified(Condition):
    """Over the extensions of an assignment along ``along: L -> N`` (within N's matches).

    ``such``: extensions that count; ``then``: what is asked of them, as conditions on N.
    """

    along: Morphism
    then: Condition | None = None
    such: Condition | None = None
    monic: object = ()

    def extensions(self, rows: DataFrame, g: Instance) -> DataFrame:
        """Extensions, with the assignment's own columns prefixed ``__k_``."""
        if isinstance(g, Sharing):
            return g.extension(self, rows)
        return self._extended(rows, g)

    def _extended(self, rows: DataFrame, g: Instance) -> DataFrame:
        pairs: dict[str, list[str]] = {}
        for o, k in self.along.dom.elements():
            if column_of((o, k)) in rows.columns:
                pairs.setdefault(column_of((o, self.along(o, k))), []).append(column_of((o, k)))
        base = rows
        for own in pairs.values():
            for other in own[1:]:
                base = base.where(F.col(own[0]) == F.col(other))
        keys = [F.col(c).alias(f"__k_{c}") for c in _own(rows)]
        start = base.select(*[F.col(own[0]).alias(n) for n, own in pairs.items()], *keys).distinct()
        if pairs:
            return match(self.along.cod, g, self.monic, start)
        found = match(self.along.cod, g, self.monic)
        # nothing ties them to the assignment: if nothing more is asked, whether there are none, one or more is all that counts
        return (found if self.then or self.such else found.limit(2)).crossJoin(start)

    def ties(self, rows: DataFrame) -> dict[Element, str] | None:
        """The elements of N, with their columns in ``rows``, on which it depends whether a match of L extends; None where all may."""
        p, s = self.along.cod, self.along.cod.schema
        own: dict[Element, list[Element]] = {}
        for o, k in self.along.dom.elements():
            if column_of((o, k)) in rows.columns:
                own.setdefault((o, self.along(o, k)), []).append((o, k))
        if any(len(es) > 1 for es in own.values()):
            return None
        monic = set(s.obs) if self.monic is True else set(self.monic or ())
        left = without_implied(p, p.elements(), set(own) | {e for e in p.elements() if e[0] in monic})
        fresh = {e for e in left if e not in own}
        uses = [v for f in p.attrs.values() for v in f.values() if isinstance(v, Var)]
        to = lambda e: {(s.homs[h][1], p.homs[h][e[1]]) for h in s.homs_from(e[0])}
        tied = set().union(*[to(e) for e in fresh])

        def counts(e: Element) -> bool:
            (o, k), = own[e]
            asked = any(uses.count(v) > 1 if isinstance(v, Var) else v != self.along.dom.attrs[a][k] for a in s.attrs_of(o) for v in [p.attrs[a][e[1]]])
            return asked or e in tied or bool(to(e) & fresh) or e[0] in monic
        return {e: column_of(own[e][0]) for e in own if counts(e)} or None

    def told(self, rows: DataFrame, g: Instance) -> DataFrame | None:
        """Parts of the assignments that extend, if no more is asked of extensions: just the columns that tell."""
        at = None if self.then or self.such or isinstance(g, Sharing) else self.ties(rows)
        if at is None:
            return None
        start = rows.select(*[F.col(c).alias(column_of(e)) for e, c in at.items()]).distinct()
        found = match(self.along.cod, g, self.monic, start, keep=set(at))
        return found.select(*[F.col(column_of(e)).alias(c) for e, c in at.items()])

    def key(self) -> tuple:
        """Equal for quantifiers over the same extensions."""
        f = self.along
        return repr((f.dom, f.cod, sorted((o, sorted(m.items(), key=repr)) for o, m in f.maps.items()))), repr(self.monic)

    def found(self, rows: DataFrame, g: Instance) -> DataFrame:
        ext = self.extensions(rows, g)
        return self.inside(self.such.holds, ext, g) if self.such else ext

    def inside(self, ask, ext: DataFrame, g: Instance) -> DataFrame:
        """``ask(ext, g)`` for a condition on extensions."""
        return g.within(self.key(), lambda: ask(ext, g)) if isinstance(g, Sharing) else ask(ext, g)

    @staticmethod
    def back(ext: DataFrame, rows: DataFrame) -> DataFrame:
        return ext.select(*[F.col(f"__k_{c}").alias(c) for c in _own(rows)])

    def witness(self, rows: DataFrame, g: Instance) -> tuple[DataFrame, bool]:
        """Assignments on which the condition is true, or (False) on which it isn't."""
        raise NotImplementedError

    def holds(self, rows, g):
        found, true = self.witness(rows, g)
        return _same(rows, found, "left_semi" if true else "left_anti")

    def mark(self, rows, g, flag):
        found, true = self.witness(rows, g)
        out = _same(rows, found, "left", flag)
        return out if true else out.withColumn(flag, ~F.col(flag))


class Exists(_Quantified):
    def witness(self, rows, g):
        if (told := self.told(rows, g)) is not None:
            return told, True
        ext = self.found(rows, g)
        return self.back(self.inside(self.then.holds, ext, g) if self.then else ext, rows), True


class Forall(_Quantified):
    def witness(self, rows, g):
        ext = self.found(rows, g)
        return self.back(self.inside(Not(self.then).holds, ext, g) if self.then else ext, rows), False


class ExistsUnique(_Quantified):
    def witness(self, rows, g):
        ext = self.found(rows, g)
        ext = self.back(self.inside(self.then.holds, ext, g) if self.then else ext, rows)
        return ext.groupBy(*ext.columns).agg(F.count(F.lit(1)).alias("__n")).where("__n = 1").drop("__n"), True


def pac(along: Morphism, monic=()) -> Condition:
    """The match extends along ``along``."""
    return Exists(along, monic=monic)


def nac(along: Morphism, monic=()) -> Condition:
    """The match doesn't extend along ``along``."""
    return Not(Exists(along, monic=monic))


def lift(vertical: Morphism, bottom: Morphism, monic=(), monic_exists=()) -> Condition:
    """Every extension along ``vertical: L -> N`` extends further along ``bottom: N -> M``; ``monic_exists`` is of that second one."""
    return Forall(vertical, Exists(bottom, monic=monic_exists), monic=monic)


@dataclass
class Where(Condition):
    """A plain condition on columns; null counts as false."""

    condition: Column

    def mark(self, rows, g, flag):
        return rows.withColumn(flag, F.coalesce(self.condition, F.lit(False)))


class Sharing(Instance):
    """An instance that remembers the extensions of one set of assignments, each stored once.

    Extensions are known by the quantifiers that they lie under and by their own pattern, so
    whatever mentions the same one gets the same table.
    """

    def __init__(self, g: Instance):
        super().__init__(g.schema, g.tables)
        self._plain, self._stored, self._path = g, {}, ()

    def extension(self, c: _Quantified, rows: DataFrame) -> DataFrame:
        key = (*self._path, c.key())
        if key not in self._stored:
            self._stored[key] = cut(c._extended(rows, self._plain))
        return self._stored[key]

    def within(self, key: tuple, ask):
        before, self._path = self._path, (*self._path, key)
        try:
            return ask()
        finally:
            self._path = before

    def stored(self) -> int:
        """How many different extensions were made."""
        return len(self._stored)


def evaluate(conditions: list[Condition], rows: DataFrame, g: Instance) -> tuple[DataFrame, Sharing]:
    """The assignments that satisfy all conditions; an extension that several parts of them ask for is found once.

    Conditions are all evaluated on all of ``rows`` (a condition that is asked after
    another would otherwise see fewer, and have extensions of its own).
    """
    shared, flags, out = Sharing(g), [], rows
    for c in conditions:
        flags.append(_flag())
        out = c.mark(out, shared, flags[-1])
    for flag in flags:
        out = out.where(F.col(flag))
    return out.drop(*flags), shared


@dataclass
class ConditionGraph:
    """The patterns that conditions speak of (the first is that of the match), and the maps between them, each once."""

    patterns: list[Pattern]
    edges: list[tuple[int, int, Morphism]]

    def scope(self, e: int) -> Pattern:
        """The pattern in which an edge's extensions lie."""
        return self.patterns[self.edges[e][1]]

    def dot(self) -> str:
        lines = ["digraph conditions {"]
        for i, p in enumerate(self.patterns):
            inside = ", ".join(f"{o}: {len(ks)}" for o, ks in p.parts.items() if ks)
            lines.append(f'  p{i} [label="{inside or "empty"}"];')
        lines += [f'  p{a} -> p{b} [label="{i}"];' for i, (a, b, _) in enumerate(self.edges)]
        return "\n".join([*lines, "}"])


def graph_of(pattern: Pattern, *conditions: Condition) -> ConditionGraph:
    """The graph of conditions on matches of ``pattern``, equal extensions merged.

    ``ValueError`` where a condition can't be asked: a quantifier that starts at elements
    which its place doesn't have, a map that isn't one, a path that doesn't start at an element or
    doesn't compose.
    """
    out, known = ConditionGraph([pattern], []), {}

    def visit(c: Condition, at: int) -> None:
        here = out.patterns[at]
        if isinstance(c, _Both):
            visit(c.left, at)
            visit(c.right, at)
        elif isinstance(c, Not):
            visit(c.inner, at)
        elif isinstance(c, Commutes):
            columns = {column_of(e): e[0] for e in here.elements()}
            ends = []
            for pair in c.pairs:
                for start, *path in pair:
                    if start not in columns:
                        raise ValueError(f"{start} is not bound here")
                    ob = columns[start]
                    for h in path:
                        if here.schema.homs.get(h, (None,))[0] != ob:
                            raise ValueError(f"{h} doesn't start at {ob}")
                        ob = here.schema.homs[h][1]
                    ends.append(ob)
                if ends[-1] != ends[-2]:
                    raise ValueError(f"{pair} end in different tables")
        elif isinstance(c, _Quantified):
            missing = set(c.along.dom.elements()) - set(here.elements())
            if missing:
                raise ValueError(f"{sorted(map(column_of, missing))} are not bound here")
            if bad := [x for x in c.along.failures() if x[0] in here.schema.homs]:
                raise ValueError(f"the map to extend along is not natural at {bad}")
            key = (at, c.key())
            if key not in known:
                out.patterns.append(c.along.cod)
                known[key] = len(out.patterns) - 1
                out.edges.append((at, known[key], c.along))
            for inner in (c.such, c.then):
                if inner is not None:
                    visit(inner, known[key])

    for c in conditions:
        visit(c, 0)
    return out
