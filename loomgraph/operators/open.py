"""Open systems: patterns and instances with boundary legs, and rules that compose along them.

An open instance has legs of any size as DataFrames.  Matches of an open pattern in it are
bijective on legs; rewriting leaves the boundary in place, and what it is glued to
follows merges.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ids import cut
from ..instance import Instance
from ..pattern import Element, Morphism, Pattern, homs, identity, pullback, pushout
from . import algebra as A
from .match import column_of, match
from .rewrite import Rule


@dataclass
class Open:
    """A pattern and legs: each a list of elements that the outside sees."""

    body: Pattern
    legs: list[list[Element]]


@dataclass
class OpenInstance:
    """An instance and legs: each a table and its rows ``(foot, id)`` that the outside sees under the numbers ``foot``."""

    body: Instance
    legs: list[tuple[str, DataFrame]]

    def rewired(self, body: Instance, roots: A.Sub) -> OpenInstance:
        """Legs on what their rows have become."""
        legs = []
        for o, rows in self.legs:
            if o in roots:
                to = roots[o].select(F.col("node").alias("__n"), F.col("root").alias("__r"))
                rows = rows.join(to, F.col("id") == F.col("__n"), "left").select("foot", F.coalesce("__r", "id").alias("id"))
            legs.append((o, rows))
        return OpenInstance(body, legs)

    def beside(self, other: OpenInstance, i: int = -1, j: int = 0) -> OpenInstance:
        """Both side by side, glued where leg ``i`` of this and leg ``j`` of the other have the same foot; the legs that are left, in order.

        Ids become ``2 n`` and ``2 n + 1`` (glued ones: the smaller).
        """
        i, j = i % len(self.legs), j % len(other.legs)
        (o, mine), (o2, theirs) = self.legs[i], other.legs[j]
        if o != o2:
            raise ValueError(f"legs on {o} and {o2} can't be glued")
        whole = A.coproduct(self.body, other.body)
        pairs = mine.select("foot", (F.col("id") * 2).alias("a")).join(theirs.select("foot", (F.col("id") * 2 + 1).alias("b")), "foot").select("a", "b")
        roots = A.merge_roots(whole, {o: pairs})
        left = [(t, r.select("foot", (F.col("id") * 2).alias("id"))) for n, (t, r) in enumerate(self.legs) if n != i]
        right = [(t, r.select("foot", (F.col("id") * 2 + 1).alias("id"))) for n, (t, r) in enumerate(other.legs) if n != j]
        return OpenInstance(whole, left + right).rewired(A.glue(whole, roots), roots)


def open_matches(p: Open, host: OpenInstance, monic=(), prune: bool = True) -> DataFrame:
    """Matches of an open pattern in an open instance that are bijective on each leg.

    Columns as in ``match``, and ``leg<i>_<j>``: the foot of the host's leg ``i`` that the
    pattern's ``j``-th foot goes to.  Legs are joined, not enumerated: a host's leg of another
    size than the pattern's has no match, whatever the size.
    """
    if len(p.legs) != len(host.legs):
        raise ValueError("different numbers of legs")
    start: DataFrame | None = None
    for i, (leg, (ob, rows)) in enumerate(zip(p.legs, host.legs)):
        if any(e[0] != ob for e in leg):
            raise ValueError(f"leg {i} is on {ob}")
        # one row: the leg's size
        size = F.broadcast(rows.agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") == len(leg)))
        start = size if start is None else start.drop("__n").crossJoin(size)
        for j, e in enumerate(leg):
            c = column_of(e)
            foot = rows.select(F.col("foot").alias(f"leg{i}_{j}"), F.col("id").alias(f"__{c}"))
            # the row above lets at most ``len(leg)`` feet be here
            on = [F.col(f"leg{i}_{k}") != F.col(f"leg{i}_{j}") for k in range(j)]
            if c in start.columns:
                on.append(F.col(c) == F.col(f"__{c}"))
            joined = start.crossJoin(foot)
            for x in on:
                joined = joined.where(x)
            start = joined.drop(f"__{c}") if c in start.columns else joined.withColumnRenamed(f"__{c}", c)
    if start is None:
        return match(p.body, host.body, monic, prune=prune)
    return match(p.body, host.body, monic, start.drop("__n"), prune=prune)


def _discrete(p: Pattern, leg: list[Element]) -> Pattern:
    d = Pattern.__new__(Pattern)
    d.schema, d.filled = p.schema, set()
    d.parts = {o: [i for i, e in enumerate(leg) if e[0] == o] for o in p.schema.obs}
    d.homs, d.attrs = {h: {} for h in p.schema.homs}, {a: {} for a in p.schema.attrs}
    return d


def _leg(p: Pattern, leg: list[Element]) -> Morphism:
    return Morphism(_discrete(p, leg), p, {o: {i: e[1] for i, e in enumerate(leg) if e[0] == o} for o in p.schema.obs})


def compose(a: Open, b: Open, i: int = -1, j: int = 0) -> tuple[Open, Morphism, Morphism]:
    """Glues leg ``i`` of ``a`` to leg ``j`` of ``b``; the legs that are left, in order."""
    i, j = i % len(a.legs), j % len(b.legs)
    left, right = _leg(a.body, a.legs[i]), _leg(b.body, b.legs[j])
    right = Morphism(left.dom, b.body, right.maps)
    f, g = pushout(left, right)
    legs = [[(o, f(o, k)) for o, k in leg] for n, leg in enumerate(a.legs) if n != i] + [[(o, g(o, k)) for o, k in leg] for n, leg in enumerate(b.legs) if n != j]
    return Open(f.cod, legs), f, g


@dataclass
class OpenRule:
    """A rule with legs on its interface, which its sides share."""

    left: Morphism
    right: Morphism
    legs: list[list[Element]]

    def beside(self, other: OpenRule, i: int = -1, j: int = 0) -> OpenRule:
        """Horizontal composition: both rules glued along a leg."""
        mid, f, g = compose(Open(self.left.dom, self.legs), Open(other.left.dom, other.legs), i, j)
        i, j = i % len(self.legs), j % len(other.legs)

        def side(m: Morphism, n: Morphism) -> Morphism:
            own = [[(o, m(o, k)) for o, k in leg] for leg in self.legs]
            his = [[(o, n(o, k)) for o, k in leg] for leg in other.legs]
            whole, p, q = compose(Open(m.cod, own), Open(n.cod, his), i, j)
            maps = {o: {} for o in m.dom.schema.obs}
            for o, k in m.dom.elements():
                maps[o][f(o, k)] = p(o, m(o, k))
            for o, k in n.dom.elements():
                maps[o][g(o, k)] = q(o, n(o, k))
            return Morphism(mid.body, whole.body, maps)

        return OpenRule(side(self.left, other.left), side(self.right, other.right), mid.legs)

    def after(self, other: OpenRule) -> OpenRule:
        """Vertical composition: ``self`` first, then ``other`` (whose left side is this right side)."""
        p, q = pullback(self.right, other.left)
        legs = [[(o, (k, next(y for y in other.left.dom.parts[o] if other.left(o, y) == self.right(o, k)))) for o, k in leg] for leg in self.legs]
        return OpenRule(p.then(self.left), q.then(other.right), legs)

    def rule(self, **kw) -> Rule:
        return Rule(self.left, self.right, **kw)

    def rewrite(self, host: Open, n: int = 0, monic=(), **kw) -> Open | None:
        """At the ``n``-th match that keeps the host's legs; legs are carried along."""
        found = [m for m in homs(self.left.cod, host.body, monic=monic) if _gluable(self.left, m, {e for leg in host.legs for e in leg})]
        if n >= len(found):
            return None
        m = found[n]
        gone = {(o, m(o, k)) for o, k in self.left.cod.elements() if (o, k) not in self.left.image()}
        rest = host.body.restrict({e for e in host.body.elements() if e not in gone})
        k = Morphism(self.left.dom, rest, {o: {x: m(o, self.left(o, x)) for x in ks} for o, ks in self.left.dom.parts.items()})
        _, into = pushout(self.right, k)
        return Open(into.cod, [[(o, into(o, x)) for o, x in leg] for leg in host.legs])


    def matches_in(self, host: OpenInstance, monic=()) -> DataFrame:
        """Acceptable matches: bijective on legs (of a rule that has any), gluing as for DPO, and no boundary row deleted."""
        rule = self.rule(monic=monic)
        if self.legs:
            left = Open(self.left.cod, [[(o, self.left(o, k)) for o, k in leg] for leg in self.legs])
            m = rule.gluable(open_matches(left, host, monic, not rule.right.fibers()), host.body)
        else:
            m = rule.matches(host.body)
        for e in rule.deleted():
            for ob, rows in host.legs:
                if ob == e[0]:
                    m = m.join(rows.select(F.col("id").alias("__leg")), F.col(column_of(e)) == F.col("__leg"), "left_anti")
        return m

    def rewrite_in(self, host: OpenInstance, n: int | None = 0, monic=()) -> OpenInstance | None:
        """An open instance rewritten at its ``n``-th match (by ids), or at a maximal independent set of them (``None``); None without a match."""
        rule = self.rule(monic=monic)
        m = self.matches_in(host, monic)
        legs = [c for c in m.columns if c.startswith("leg")]
        ids = [c for c in m.columns if not c.startswith("var_") and c not in legs]
        # several ways to take the boundary lead to one result where the elements are the same
        m = m.dropDuplicates(ids).drop(*legs)
        if n is None:
            m = rule.independent(m)
        else:
            m = m.orderBy(*ids).offset(n).limit(1)
        m = cut(m)
        if m.isEmpty():
            return None
        d = rule.change(host.body, m)
        return host.rewired(d.after, d.roots)


def _gluable(left: Morphism, m: Morphism, legs: set[Element]) -> bool:
    gone = [(o, k) for o, k in left.cod.elements() if (o, k) not in left.image()]
    image = [(o, m(o, k)) for o, k in gone]
    kept = {(o, m(o, k)) for o, k in left.image()}
    if len(set(image)) < len(image) or set(image) & kept or set(image) & legs:
        return False
    host, s = m.cod, m.cod.schema
    return all((s.homs[h][0], x) in image for o, k in image for h in s.homs_to(o) for x in host.incident(k, h))


def identity_rule(p: Pattern, legs: list[list[Element]]) -> OpenRule:
    return OpenRule(identity(p), identity(p), legs)
