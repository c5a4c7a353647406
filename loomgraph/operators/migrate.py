"""Schema migration: renaming an instance, pattern or rule along a map of schemas; slices."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import functions as F

from ..instance import Instance
from ..pattern import Morphism, Pattern
from ..schema import Schema
from .constraints import And, Commutes, Condition, Const, Exists, ExistsUnique, Forall, Not, Or
from .pbpo import TypedRule
from .rewrite import Rule


@dataclass(frozen=True)
class Migrate:
    """``obs``, ``names``: tables and columns of ``source`` -> those of ``target``.

    ``pull`` (delta) reads a ``target`` instance as a ``source`` one; ``push`` (sigma,
    for injective maps) takes a ``source`` instance to ``target``: tables and attributes
    outside the image are empty or null.
    """

    source: Schema
    target: Schema
    obs: dict[str, str]
    names: dict[str, str]

    def pull(self, g: Instance) -> Instance:
        return Instance(self.source, {o: g[t].select("id", *[F.col(self.names[c]).alias(c) for c in self.source.homs_from(o) + self.source.attrs_of(o)]) for o, t in self.obs.items()})

    def push(self, g: Instance) -> Instance:
        back, spark = {t: o for o, t in self.obs.items()}, next(iter(g.tables.values())).sparkSession
        columns = {t: c for c, t in self.names.items()}
        tables = {}
        for t in self.target.obs:
            if t not in back:
                tables[t] = spark.createDataFrame([], self.target.ddl(t))
                continue
            keys = [(F.col(columns[c]) if c in columns else F.lit(None).cast("bigint")).alias(c) for c in self.target.homs_from(t)]
            attrs = [(F.col(columns[c]) if c in columns else F.lit(None).cast(self.target.attrs[c][1])).alias(c) for c in self.target.attrs_of(t)]
            tables[t] = g[back[t]].select("id", *keys, *attrs)
        return Instance(self.target, tables)

    def pattern(self, p: Pattern) -> Pattern:
        return Pattern(self.target, {self.obs[o]: ks for o, ks in p.parts.items()}, {self.names[h]: f for h, f in p.homs.items()}, {self.names[a]: f for a, f in p.attrs.items()})

    def morphism(self, f: Morphism) -> Morphism:
        return Morphism(self.pattern(f.dom), self.pattern(f.cod), {self.obs[o]: m for o, m in f.maps.items()})

    def column(self, c: str) -> str:
        """The name that a match's column has after the renaming of tables."""
        ob = next(o for o in sorted(self.obs, key=len, reverse=True) if c.startswith(f"{o}_"))
        return self.obs[ob] + c[len(ob) :]

    def _monic(self, monic):
        return monic if monic is True else [self.obs[o] for o in monic or ()]

    def condition(self, c: Condition | None) -> Condition | None:
        """A condition over ``source`` as one over ``target``; plain column conditions name columns themselves and can't be translated."""
        if c is None or isinstance(c, Const):
            return c
        if isinstance(c, (And, Or)):
            return type(c)(self.condition(c.left), self.condition(c.right))
        if isinstance(c, Not):
            return Not(self.condition(c.inner))
        if isinstance(c, (Exists, Forall, ExistsUnique)):
            return type(c)(self.morphism(c.along), self.condition(c.then), self.condition(c.such), self._monic(c.monic))
        if isinstance(c, Commutes):
            side = lambda path: (self.column(path[0]), *(self.names[h] for h in path[1:]))
            return Commutes([(side(x), side(y)) for x, y in c.pairs], {self.column(k): self.obs[o] for k, o in c.obs.items()}, c.commutes)
        raise TypeError(f"{type(c).__name__} can't be migrated")

    def rule(self, r: Rule) -> Rule:
        left, right = self.morphism(r.left), self.morphism(r.right)
        right.dom = left.dom
        return replace(r, left=left, right=right, monic=self._monic(r.monic), conditions=[self.condition(c) for c in r.conditions])

    def typed_rule(self, r: TypedRule) -> TypedRule:
        """A rule controlled by a typing, renamed; its adherence function is the caller's to translate."""
        l, rr, tl, tk, lp = (self.morphism(m) for m in (r.l, r.r, r.tl, r.tk, r.lp))  # noqa: E741
        return replace(r, l=l, r=rr, tl=tl, tk=tk, lp=lp, conditions=[self.condition(c) for c in r.conditions], k_exprs={(self.names[a], k): f for (a, k), f in r.k_exprs.items()})


def sliced(schema: Schema) -> Schema:
    """The schema with a ``type`` attribute per table: instances typed over another one."""
    return schema.extend(attrs={f"{o}_type": (o, "bigint") for o in schema.obs})


def typed_pattern(p: Pattern, f: Morphism, ids: dict) -> Pattern:
    """A pattern with each element's type (``ids``: element of the base -> id there) as a fixed attribute."""
    attrs = {**{a: dict(v) for a, v in p.attrs.items()}, **{f"{o}_type": {k: ids[(o, f(o, k))] for k in p.parts[o]} for o in p.schema.obs}}
    return Pattern(sliced(p.schema), p.parts, p.homs, attrs)


def is_slice(g: Instance, base: Instance) -> bool:
    """Whether the types of ``g`` are a morphism to ``base``."""
    for h, (x, y) in base.schema.homs.items():
        a = g[x].select("id", F.col(f"{x}_type").alias("tx"), F.col(h).alias("to"))
        b = g[y].select(F.col("id").alias("__i"), F.col(f"{y}_type").alias("ty"))
        c = base[x].select(F.col("id").alias("__b"), F.col(h).alias("want"))
        if not a.join(b, F.col("to") == F.col("__i")).join(c, F.col("tx") == F.col("__b"), "left").where(~F.col("want").eqNullSafe(F.col("ty"))).isEmpty():
            return False
    return True
