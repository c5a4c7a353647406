"""Rules and their application to whole sets of matches.

A rule is a span ``L <- I -> R`` of patterns.  ``D`` below is what a match deletes
(``L`` outside the image of ``I``).  Semantics:

* ``DPO``   a match is applicable if nothing outside it refers to ``D`` and it doesn't
  identify a deleted element with another;
* ``SPO``   what refers to ``D`` is deleted with it; deletion wins over preservation;
* ``SqPO``  what is preserved several times is cloned, with everything that refers to it;
  rows that refer to ``D`` vanish;
* ``CoNeg`` what is in ``D`` stays as long as anything outside the match refers to it.

All matches given are applied at once, table by table: ``(T minus deleted) plus added``;
a plan per table, whatever the number of matches.  ``independent`` selects a maximal
conflict-free set; ``rewrite`` and ``exhaust`` are the policies.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import cut, number_rows
from ..instance import Instance
from ..pattern import Element, Morphism, Pattern, Var, inclusion
from . import algebra as A
from .constraints import Condition, Not
from .match import column_of, first, match, shuffled, var_column

SEMANTICS = ("DPO", "SPO", "SqPO", "CoNeg")


@dataclass
class Change:
    """What an application does: ids removed and added per table, and ids of the rows that merging takes away or changes.

    ``touched`` has ids of the state between addition and merging; those that are left in
    ``after`` are rows that merging changed (or the one that a class is left as).
    """

    before: Instance
    after: Instance
    placed: DataFrame
    removed: A.Sub
    added: A.Sub
    touched: A.Sub
    roots: A.Sub = field(default_factory=dict)  # (node, root) of what was merged

    def lost(self) -> A.Sub:
        """Ids whose rows before are no longer there as they were."""
        return {o: reduce(DataFrame.union, [d[o].select("id") for d in (self.removed, self.touched) if o in d]) for o in {*self.removed, *self.touched}}

    def fresh(self) -> dict[str, DataFrame]:
        """Rows of ``after`` that are new or changed."""
        ids = {o: reduce(DataFrame.union, [d[o].select("id") for d in (self.added, self.touched) if o in d]) for o in {*self.added, *self.touched}}
        return {o: self.after[o].join(i.select(F.col("id").alias("__f")), F.col("id") == F.col("__f"), "left_semi") for o, i in ids.items()}


@dataclass
class Rule:
    """``exprs``: attribute variable name of R -> function of a dict of L's variable columns to a Column."""

    left: Morphism
    right: Morphism
    semantics: str = "DPO"
    monic: object = ()
    conditions: list[Condition] = field(default_factory=list)
    exprs: dict[object, Callable[[dict[str, Column]], Column]] = field(default_factory=dict)
    freevar: bool = False

    def __post_init__(self):
        if self.semantics not in SEMANTICS:
            raise ValueError(f"unknown semantics {self.semantics}")
        if self.left.dom is not self.right.dom and self.left.dom.parts != self.right.dom.parts:
            raise ValueError("legs start at different interfaces")
        if self.semantics != "SqPO" and not self.left.is_monic():
            raise ValueError("only SqPO allows a left leg that isn't injective")
        for leg in (self.left, self.right):
            if bad := [b for b in leg.failures() if b[0] in leg.dom.schema.homs]:
                raise ValueError(f"leg is not natural at {bad}")
        known = {v.name for v in self.L.vars()}
        image = self.right.image()
        for a, (o, _) in self.R.schema.attrs.items():
            for k, v in self.R.attrs[a].items():
                if isinstance(v, Var) and (o, k) not in image and v.name not in known and v.name not in self.exprs and not self.freevar:
                    raise ValueError(f"variable {v} of R has no value: give an expression or freevar=True")

    @staticmethod
    def of(L: Pattern, R: Pattern, keep: list[Element] | None = None, **kw) -> Rule:
        """The rule that preserves the elements named alike in ``L`` and ``R`` (or just ``keep``)."""
        both = set(L.elements()) & set(R.elements()) if keep is None else set(keep)
        i = L.abstract().restrict(L.closure(both)) if keep is None else L.abstract().restrict(both)
        return Rule(inclusion(i, L), inclusion(i, R), **kw)

    L = property(lambda self: self.left.cod)
    R = property(lambda self: self.right.cod)
    I = property(lambda self: self.left.dom)  # noqa: E741

    def deleted(self) -> list[Element]:
        kept = self.left.image()
        return [e for e in self.L.elements() if e not in kept]

    def added(self) -> list[Element]:
        kept = self.right.image()
        return [e for e in self.R.elements() if e not in kept]

    # -- matching

    def candidates(self, g: Instance, initial=None, monic=None) -> DataFrame:
        """Matches of L that satisfy the application conditions; gluing is not checked."""
        # cloning, merging and co-negation look at all that is matched, the others at named elements
        m = match(self.L, g, self.monic if monic is None else monic, initial, prune=self.semantics in ("DPO", "SPO") and not self.right.fibers())
        for c in self.conditions:
            m = c.holds(m, g)
        return m

    def matches(self, g: Instance, initial=None) -> DataFrame:
        """Acceptable matches: conditions and, for DPO, the gluing condition."""
        monic = True if self.semantics in ("SqPO", "CoNeg") else None
        m = self.candidates(g, initial, monic)
        return self.gluable(m, g) if self.semantics == "DPO" else m

    def gluable(self, m: DataFrame, g: Instance) -> DataFrame:
        """Matches that identify no deleted element with another and leave no row that refers to one."""
        m = self.identification(m)
        v = self.dangling(m, g)
        if v is not None:
            keys = _keys(m)
            bad = v.select(*[F.col(c).alias(f"__{c}") for c in keys]).distinct()
            m = m.join(bad, reduce(lambda x, y: x & y, [F.col(c) == F.col(f"__{c}") for c in keys]), "left_anti")
        return m

    def reasons(self, g: Instance, m: DataFrame | None = None) -> DataFrame:
        """``(<columns of m>, reason, detail)``: why each of ``m`` (by default every match of L) is no match of the rule.

        One row for each reason: ``monic`` (two elements of a table that must differ),
        ``condition`` (its number), ``identification`` (the deleted element and the other
        one), ``dangling`` (the key and a row that refers to what would be deleted, the
        smallest of those of the key).  Acceptable matches have no row.
        """
        strict = True if self.semantics in ("SqPO", "CoNeg") else self.monic
        obs = set(g.schema.obs) if strict is True else set(strict or ())
        m = match(self.L, g, (), prune=False) if m is None else m
        keys, none, out = m.columns, F.lit(None).cast("string"), []

        def told(rows: DataFrame, reason: str, detail: Column) -> None:
            out.append(rows.select(*[F.col(c) for c in keys], F.lit(reason).alias("reason"), detail.alias("detail")))

        named = [e for e in self.L.elements() if column_of(e) in keys]
        for i, e in enumerate(named):
            for x in named[:i]:
                if e[0] == x[0] and e[0] in obs:
                    told(m.where(F.col(column_of(e)) == F.col(column_of(x))), "monic", F.lit(f"{column_of(x)}, {column_of(e)}"))
        for i, c in enumerate(self.conditions):
            told(Not(c).holds(m, g), "condition", F.lit(str(i)))
        if self.semantics == "DPO":
            told(self.identification_violations(m), "identification", F.concat_ws(", ", "element", "other"))
            bad = self.dangling(m, g)
            if bad is not None:
                least = bad.groupBy(*keys, "hom").agg(F.min("row").alias("row"))
                told(least, "dangling", F.concat_ws(" of ", "hom", F.col("row").cast("string")))
        if not out:
            return m.select("*", none.alias("reason"), none.alias("detail")).where(F.lit(False))
        return reduce(DataFrame.unionAll, out)

    def identification(self, m: DataFrame) -> DataFrame:
        """Matches that identify no deleted element with another one."""
        gone = self.deleted()
        for e in gone:
            for x in self.L.elements():
                if x != e and x[0] == e[0] and column_of(x) in m.columns and (x not in gone or str(x) < str(e)):
                    m = m.where(F.col(column_of(e)) != F.col(column_of(x)))
        return m

    def identification_violations(self, m: DataFrame) -> DataFrame:
        """Matches, with the pair of elements of L that are identified though one is deleted."""
        out, gone = None, self.deleted()
        for e in gone:
            for x in self.L.elements():
                if x != e and x[0] == e[0] and column_of(x) in m.columns and (x not in gone or str(x) < str(e)):
                    bad = m.where(F.col(column_of(e)) == F.col(column_of(x))).withColumns({"element": F.lit(column_of(e)), "other": F.lit(column_of(x))})
                    out = bad if out is None else out.unionAll(bad)
        return out if out is not None else m.where(F.lit(False)).withColumns({"element": F.lit(""), "other": F.lit("")})

    def dangling(self, m: DataFrame, g: Instance) -> DataFrame | None:
        """Matches with ``(hom, row)`` outside them that refer to what they delete."""
        out, s = None, g.schema
        for e in self.deleted():
            for h in s.homs_to(e[0]):
                src = s.homs[h][0]
                refs = g[src].select(F.col("id").alias("row"), F.col(h).alias("__to"))
                bad = m.join(refs, F.col(column_of(e)) == F.col("__to")).drop("__to")
                for x in self.deleted():
                    if x[0] == src:
                        bad = bad.where(F.col("row") != F.col(column_of(x)))
                bad = bad.withColumn("hom", F.lit(h))
                out = bad if out is None else out.unionAll(bad)
        return out

    # -- application

    def apply(self, g: Instance, m: DataFrame) -> Instance:
        """Rewrites at every match of ``m`` at once; they must not conflict."""
        return self.apply_with_maps(g, m)[0]

    def apply_with_maps(self, g: Instance, m: DataFrame) -> tuple[Instance, DataFrame]:
        """The result, and for each match its columns plus ``new_<table>_<element>`` for added elements."""
        if self.semantics == "SqPO":
            return self._sesqui(g, m)
        d = self.change(g, m)
        return d.after, d.placed

    def change(self, g: Instance, m: DataFrame) -> Change:
        """The result together with what it does to each table; not for SqPO, which renames rows everywhere."""
        if self.semantics == "SqPO":
            raise ValueError("a SqPO rule has no change by rows")
        s = g.schema
        placed = self._numbered(g, m)
        gone = {o: reduce(DataFrame.union, [placed.select(F.col(column_of(e)).alias("id")) for e in self.deleted() if e[0] == o]).distinct() for o in {e[0] for e in self.deleted()}}
        removed: A.Sub = {}
        base = g
        if gone:
            whole = A.subobject(g, gone)
            if self.semantics == "SPO":
                whole = A._deleted_closure(g, whole)
            if self.semantics == "CoNeg":
                bound = {o: [e for e in self.L.elements() if e[0] == o] for o in s.obs}
                matched = A.subobject(g, {o: reduce(DataFrame.union, [placed.select(F.col(column_of(e)).alias("id")) for e in es]) for o, es in bound.items() if es})
                whole = A.minus(whole, A.conegate(g, matched))
            removed = gone if self.semantics == "DPO" else whole
            base = A.remove(g, removed)
        image = {e: F.col(column_of((e[0], self._back(e)))) for e in self.right.image()}
        new = {e[0] for e in self.added()}
        own = self._add(g.empty(), placed, image)
        if self.semantics == "SPO" and removed and new:
            # deletion wins: added rows that refer to deleted ones go, too
            own = A.remove(own, A._deleted_closure(own, removed))
        changed = self._changed(placed)
        h = self._set(base, changed)
        h = h.replace(**{o: h[o].unionByName(own[o], allowMissingColumns=True) for o in new})
        pairs = self._glue_pairs(placed)
        roots = A.merge_roots(h, pairs) if pairs else {}
        touched = A.touched_by_merge(h, roots) if roots else {}
        for o, p in changed.items():
            touched[o] = touched[o].union(p.select("id")).distinct() if o in touched else p.select("id")
        return Change(g, A.glue(h, roots) if roots else h, placed, removed, {o: own[o].select("id") for o in new}, touched, roots)

    def _back(self, e: Element) -> object:
        """Some element of L that is preserved as ``e`` of R."""
        return next(self.left(o, k) for o, k in self.I.elements() if (o, self.right(o, k)) == e)

    def _numbered(self, g: Instance, m: DataFrame) -> DataFrame:
        """Matches with fresh ids ``new_...`` for the added elements."""
        new = self.added()
        if not new:
            return m
        out = number_rows(m, _keys(m), "__m")
        for o in dict.fromkeys(e[0] for e in new):
            mine = [e for e in new if e[0] == o]
            out = out.join(F.broadcast(A.next_ids(g, o)))  # one row
            for i, e in enumerate(mine):
                out = out.withColumn(f"new_{column_of(e)}", F.col("__base") + F.col("__m") * len(mine) + i)
            out = out.drop("__base")
        return cut(out.drop("__m"))

    def _value(self, a: str, e: Element, m: DataFrame) -> Column:
        v = self.R.attrs[a][e[1]]
        kind = self.R.schema.attrs[a][1]
        if not isinstance(v, Var):
            return F.lit(v).cast(kind)
        have = {c.removeprefix("var_"): F.col(c) for c in m.columns if c.startswith("var_")}
        if v.name in self.exprs:
            return self.exprs[v.name](have).cast(kind)
        return have[str(v.name)].cast(kind) if str(v.name) in have else F.lit(None).cast(kind)

    def updates(self) -> dict[Element, dict[str, Element]]:
        """Attributes that R changes on what is preserved: element of L -> attribute -> element of R that has the new value.

        R changes a value if it has another constant than L there, a variable with an
        expression, or another variable of L.
        """
        out: dict[Element, dict[str, Element]] = {}
        known = self.L.vars()
        for o, k in self.I.elements():
            x, y = self.left(o, k), self.right(o, k)
            for a in self.R.schema.attrs_of(o):
                old, new = self.L.attrs[a][x], self.R.attrs[a][y]
                if new != old and (not isinstance(new, Var) or new.name in self.exprs or new in known):
                    out.setdefault((o, x), {})[a] = (o, y)
        return out

    def _changed(self, m: DataFrame) -> dict[str, DataFrame]:
        """``(id, <attribute>, <attribute>__set)`` per table: new values of preserved rows, a row for each."""
        out: dict[str, DataFrame] = {}
        for e, values in self.updates().items():
            attrs = self.R.schema.attrs_of(e[0])
            cols = [(self._value(a, values[a], m) if a in values else F.lit(None).cast(self.R.schema.attrs[a][1])).alias(a) for a in attrs]
            p = m.select(F.col(column_of(e)).alias("id"), *cols, *[F.lit(a in values).alias(f"{a}__set") for a in attrs])
            out[e[0]] = out[e[0]].unionAll(p) if e[0] in out else p
        # matches that share a row must agree on what becomes of it; so the largest value is any of them
        return {o: p.groupBy("id").agg(*[F.max(c).alias(c) for c in p.columns if c != "id"]) for o, p in out.items()}

    def _set(self, g: Instance, changed: dict[str, DataFrame]) -> Instance:
        tables = {}
        for o, p in changed.items():
            attrs = g.schema.attrs_of(o)
            p = p.select(F.col("id").alias("__p"), *[F.col(c).alias(f"__new_{c}") for c in p.columns if c != "id"])
            t = g[o].join(p, F.col("id") == F.col("__p"), "left")
            tables[o] = t.select(*[F.when(F.col(f"__new_{c}__set"), F.col(f"__new_{c}")).otherwise(F.col(c)).alias(c) if c in attrs else F.col(c) for c in g[o].columns])
        return g.replace(**tables)

    def _add(self, base: Instance, m: DataFrame, image: dict[Element, Column]) -> Instance:
        s, tables = base.schema, {}
        for e in self.added():
            cols = [F.col(f"new_{column_of(e)}").alias("id")]
            for h in s.homs_from(e[0]):
                t = (s.homs[h][1], self.R.homs[h][e[1]])
                cols.append((image[t] if t in image else F.col(f"new_{column_of(t)}")).alias(h))
            cols += [self._value(a, e, m).alias(a) for a in s.attrs_of(e[0])]
            tables[e[0]] = tables.get(e[0], base[e[0]]).unionByName(m.select(*cols), allowMissingColumns=True)
        return base.replace(**tables)

    def _glue_pairs(self, m: DataFrame, columns: dict[Element, str] | None = None) -> dict[str, DataFrame]:
        """Pairs of ids that R merges."""
        at = columns or {(o, k): column_of((o, self.left(o, k))) for o, k in self.I.elements()}
        pairs: dict[str, DataFrame] = {}
        for (o, _), ks in self.right.fibers().items():
            for k in ks[1:]:
                p = m.select(F.col(at[(o, ks[0])]).alias("a"), F.col(at[(o, k)]).alias("b"))
                pairs[o] = pairs[o].union(p) if o in pairs else p
        return pairs

    def _glue(self, h: Instance, m: DataFrame, columns: dict[Element, str] | None = None) -> Instance:
        """Merges what R merges."""
        pairs = self._glue_pairs(m, columns)
        return A.merge(h, pairs) if pairs else h

    def _sesqui(self, g: Instance, m: DataFrame) -> tuple[Instance, DataFrame]:
        """Final pullback complement by clone-joins in topological order, then additions and merges."""
        s = g.schema
        order = s.topological()  # refuses cyclic schemas
        m = cut(number_rows(m, _keys(m), "__m"))
        clones: dict[str, DataFrame] = {}  # ob -> (old, tag, new): tag tells the copies of a row apart
        tables: dict[str, DataFrame] = {}
        tags: dict[Element, Column] = {}
        for o in order:
            mine = [k for k in self.I.parts[o]]
            matched = [e for e in self.L.elements() if e[0] == o]
            keys = s.homs_from(o)
            rest = g[o]
            if matched:
                hit = reduce(DataFrame.union, [m.select(F.col(column_of(e)).alias("__h")) for e in matched]).distinct()
                rest = rest.join(hit, F.col("id") == F.col("__h"), "left_anti")
            copies = rest.select(F.col("id").alias("old"), F.lit("").alias("tag"), *[F.col(h).alias(h) for h in keys])
            for h in keys:
                c = clones[s.homs[h][1]].select(F.col("old").alias("__o"), F.col("tag").alias("__t"), F.col("new").alias("__n"))
                copies = copies.join(c, F.col(h) == F.col("__o")).withColumn("tag", F.concat("tag", F.when(F.col("__t") != "", F.concat(F.lit(f"{h}="), "__t", F.lit(";"))).otherwise(F.lit("")))).withColumn(h, F.col("__n")).drop("__o", "__t", "__n")
            for k in mine:
                row = m.select(F.col(column_of((o, self.left(o, k)))).alias("old"), F.concat(F.lit(f"i{k}:"), F.col("__m").cast("string")).alias("tag"), "__m")
                for h in keys:
                    t = s.homs[h][1]
                    c = clones[t].select(F.col("tag").alias("__t"), F.col("new").alias(h))
                    row = row.join(c, F.concat(F.lit(f"i{self.I.homs[h][k]}:"), F.col("__m").cast("string")) == F.col("__t")).drop("__t")
                copies = copies.unionByName(row.drop("__m"))
            copies = cut(copies)
            # a row without a tag has no other copy; of others the first keeps its id, the rest get fresh ones
            plain, some = copies.where("tag = ''").withColumn("new", F.col("old")), copies.where("tag <> ''")
            first_tag = some.groupBy(F.col("old").alias("__o")).agg(F.min("tag").alias("__f"))
            both = some.join(first_tag, F.col("old") == F.col("__o"))
            kept = both.where("tag = __f").withColumn("new", F.col("old")).drop("__o", "__f")
            fresh = number_rows(both.where("tag <> __f").drop("__o", "__f"), ["old", "tag"], "__n").join(F.broadcast(A.next_ids(g, o))).withColumn("new", F.col("__base") + F.col("__n")).drop("__n", "__base")
            clones[o] = plain.unionByName(cut(kept.unionByName(fresh)))
            attrs = g[o].select(F.col("id").alias("__i"), *s.attrs_of(o))
            tables[o] = clones[o].join(attrs, F.col("old") == F.col("__i")).select(F.col("new").alias("id"), *keys, *s.attrs_of(o), F.col("old").alias("origin"))
        k = Instance(s, tables)
        for left, right in s.eqs:  # clones that break a path equation don't count
            ob = s.path_ends(left)[0]
            a, b = k.subpart(ob, *left), k.subpart(ob, *right).select(F.col("id").alias("__i"), F.col("value").alias("__v"))
            good = a.join(b, F.col("id") == F.col("__i")).where(F.col("value") == F.col("__v")).select("id")
            k = A.largest(k, {**A.full(k), ob: good}).cut()  # else plans nest
        out, columns = m, {}
        for o, key in self.I.elements():
            c = clones[o].select(F.col("tag").alias("__t"), F.col("new").alias(f"kept_{column_of((o, key))}"))
            out = out.join(c, F.concat(F.lit(f"i{key}:"), F.col("__m").cast("string")) == F.col("__t")).drop("__t")
            columns[(o, key)] = f"kept_{column_of((o, key))}"
        for o in dict.fromkeys(e[0] for e in self.added()):
            mine = [e for e in self.added() if e[0] == o]
            out = out.join(F.broadcast(A.next_ids(k, o)))
            for i, e in enumerate(mine):
                out = out.withColumn(f"new_{column_of(e)}", F.col("__base") + F.col("__m") * len(mine) + i)
            out = out.drop("__base")
        out = cut(out.drop("__m"))
        image = {(o, self.right(o, key)): F.col(columns[(o, key)]) for o, key in self.I.elements()}
        return self._glue(self._add(k, out, image), out, columns), out

    # -- policies

    def rewrite(self, g: Instance, initial=None, seed: int | None = None) -> Instance | None:
        """One match (the smallest by ids, or a random one by seed), or None."""
        m = self.matches(g, initial)
        m = cut(first(m) if seed is None else shuffled(m, seed).limit(1))
        return None if m.isEmpty() else self.apply(g, m)

    def independent(self, m: DataFrame, spread: bool = False) -> DataFrame:
        """A maximal set of matches none of which deletes what another binds.

        Rounds: a match is taken when no match before it that is still open conflicts with
        it; what conflicts with a taken one is closed.  Matches go by their ids, so the set is
        that of taking them one by one; with ``spread`` by a hash of their ids, so that a long
        chain of conflicts takes few rounds (a logarithm of its length is expected).
        """
        gone = self.deleted()
        if not gone:
            return m
        keys = _keys(m)
        rows = cut(number_rows(m.withColumn("__h", F.xxhash64(*keys)), ["__h", *keys], "__m").drop("__h") if spread else number_rows(m, keys, "__m"))
        uses = reduce(DataFrame.union, [rows.select("__m", F.lit(e[0]).alias("o"), F.col(column_of(e)).alias("i"), F.lit(e in gone).alias("d")) for e in self.L.elements() if column_of(e) in keys])
        uses = uses.groupBy("__m", "o", "i").agg(F.max("d").alias("d"))
        open_ = uses
        taken = None
        while True:
            # per element: the first open match that deletes it, and the first that binds it
            first_use = open_.groupBy(F.col("o").alias("o2"), F.col("i").alias("i2")).agg(F.min("__m").alias("any"), F.min(F.when(F.col("d"), F.col("__m"))).alias("del"))
            seen = open_.join(first_use, (F.col("o") == F.col("o2")) & (F.col("i") == F.col("i2")))
            blocked = seen.where((F.col("d") & (F.col("any") < F.col("__m"))) | (F.col("del") < F.col("__m"))).select(F.col("__m").alias("b")).distinct()
            now = cut(open_.join(blocked, F.col("__m") == F.col("b"), "left_anti"))
            if now.isEmpty():
                break
            taken = now.select("__m").distinct() if taken is None else taken.union(now.select("__m").distinct())
            held = now.groupBy(F.col("o").alias("o2"), F.col("i").alias("i2")).agg(F.max("d").alias("d2"))
            clash = open_.join(held, (F.col("o") == F.col("o2")) & (F.col("i") == F.col("i2"))).where("d or d2").select(F.col("__m").alias("b")).union(now.select(F.col("__m").alias("b"))).distinct()
            open_ = cut(open_.join(clash, F.col("__m") == F.col("b"), "left_anti"))
        if taken is None:
            return m.where(F.lit(False))
        t = taken.select(F.col("__m").alias("b")).distinct()
        return rows.join(t, F.col("__m") == F.col("b"), "left_semi").drop("__m")

    def rewrite_all(self, g: Instance, initial=None) -> Instance:
        """A maximal independent set of matches at once."""
        return self.apply(g, cut(self.independent(self.matches(g, initial))))

    def exhaust(self, g: Instance, rounds: int = 1000) -> Instance:
        """Until no match is left."""
        for _ in range(rounds):
            m = cut(self.independent(self.matches(g), spread=True))
            if m.isEmpty():
                return g
            g = self.apply(g, m).cut()
        raise RuntimeError(f"still matching after {rounds} rounds")

    def explain(self) -> str:
        """The rule as a patch plan per table."""
        lines = [f"{self.semantics} rule"]
        for o in self.L.schema.obs:
            dels, adds = [e for e in self.deleted() if e[0] == o], [e for e in self.added() if e[0] == o]
            if dels or adds:
                lines.append(f"  {o}: minus {[column_of(e) for e in dels]} plus {[column_of(e) for e in adds]}")
        lines += [f"  merge {e}: {ks}" for e, ks in self.right.fibers().items()]
        return "\n".join(lines)


def _keys(m: DataFrame) -> list[str]:
    return [c for c in m.columns if not c.startswith("var_")]


__all__ = ["Rule", "SEMANTICS", "var_column"]
