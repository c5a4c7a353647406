"""Match sets kept up to date while the instance changes.

For a pattern with elements a1..an and added rows per table, the new matches are the
disjoint union over i of: elements before i old, element i new, elements after i any.
Each branch starts at the added rows, so its cost follows the change, not the instance.
Deletions drop the matches that bind a deleted row.  A rule's own account of what it adds,
deletes, rewires and merges (``Rule.change``) seeds both steps.

Under conditions, a change may also bring a match to life or end it without touching it: an
order has no flagged line once the last one is deleted.  Such matches are found from the
change as well: what a quantifier looks at is a pattern around the match, so its matches that
bind a changed row (before a deletion, after an insertion) tell whose condition to ask again.

Each step appends what is new; a view is put together again after ``PIECES`` steps, and so
are the tables of its state.  ``delta_rule`` tells which branch found a match.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ids import cut
from ..instance import Instance
from ..operators.constraints import And, Commutes, Condition, Not, Or, _Quantified
from ..operators.match import column_of, match
from ..operators.rewrite import Rule
from ..pattern import Pattern

Rows = dict[str, DataFrame]


def _without(rows: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    return rows.join(ids.select(F.col("id").alias("__not")), F.col(column) == F.col("__not"), "left_anti")


def delta_matches(p: Pattern, old: Instance, added: Rows, monic=(), new: Instance | None = None, prune: bool = True) -> DataFrame | None:
    """Matches in ``old`` plus ``added`` (or in ``new``, which has them) that bind an added row; ``delta_rule`` names the branch."""
    new = new or old.replace(**{o: old[o].unionByName(rows) for o, rows in added.items()})
    out = None
    seats = [e for e in p.elements() if e[0] in added and not (prune and e in p.filled)]
    for i, e in enumerate(seats):
        start = added[e[0]].select(F.col("id").alias(column_of(e)))
        branch = match(p, new, monic, start, prune=prune)
        for before in seats[:i]:
            branch = _without(branch, column_of(before), added[before[0]])
        branch = branch.withColumn("delta_rule", F.lit(column_of(e)))
        out = branch if out is None else out.unionByName(branch)
    return out


def affected(c: Condition, p: Pattern, g: Instance, changed: Rows) -> list[DataFrame]:
    """Assignments of elements of ``p`` on which ``c`` may depend on the rows ``changed``, which ``g`` has.

    Each DataFrame binds some of the elements.  Matches of what ``c`` quantifies over are
    sought from the changed rows alone.
    """
    if isinstance(c, (And, Or)):
        return affected(c.left, p, g, changed) + affected(c.right, p, g, changed)
    if isinstance(c, Not):
        return affected(c.inner, p, g, changed)
    if isinstance(c, Commutes):
        out = []
        for start, *path in [side for pair in c.pairs for side in pair]:
            at = c.obs.get(start)
            for i in range(1, len(path)):
                at = g.schema.homs[path[i - 1]][1]
                if at in changed:
                    ends = g.subpart(c.obs[start], *path[:i])
                    out.append(ends.join(changed[at].select(F.col("id").alias("__c")), F.col("value") == F.col("__c"), "left_semi").select(F.col("id").alias(start)))
        return out
    if not isinstance(c, _Quantified):
        return []
    found = delta_matches(c.along.cod, g, changed, c.monic, new=g, prune=False)
    within = [] if found is None else [found]
    for inner in (c.then, c.such):
        within += affected(inner, c.along.cod, g, changed) if inner else []
    back = {column_of(e): column_of((e[0], c.along(*e))) for e in c.along.dom.elements()}
    return [d.select(*[F.col(n).alias(own) for own, n in back.items() if n in d.columns]).distinct() for d in within]


PIECES = 16


class MatchView:
    """The matches of some patterns in a changing instance; with ``conditions``, of those that satisfy them all."""

    def __init__(self, patterns: list[Pattern], g: Instance, monic=(), conditions: list[Condition] = ()):
        self.patterns, self.state, self.monic, self.conditions = list(patterns), g, monic, list(conditions)
        self.pieces = [[cut(self._holding(match(p, g, monic), g).withColumn("delta_rule", F.lit("start")))] for p in patterns]
        self.step, self._grown = 0, set()

    def provenance(self, i: int = 0) -> DataFrame:
        """Matches with ``delta_rule``."""
        return reduce(DataFrame.unionByName, self.pieces[i])

    def matches(self, i: int = 0) -> DataFrame:
        return self.provenance(i).drop("delta_rule")

    def nmatches(self, i: int = 0) -> int:
        return self.matches(i).count()

    def _holding(self, rows: DataFrame, g: Instance) -> DataFrame:
        for c in self.conditions:
            rows = c.holds(rows, g)
        return rows

    def _go_over(self, after: Instance, lost: Rows, fresh: Rows) -> None:
        """To ``after``, given the rows of the state that are gone or changed, and those of ``after`` that are new or changed."""
        lost, fresh = ({o: cut(d) for o, d in rows.items()} for rows in (lost, fresh))
        lost, fresh = ({o: d for o, d in rows.items() if not d.isEmpty()} for rows in (lost, fresh))
        ended = {o: _without(d.select("id"), "id", fresh[o]) if o in fresh else d.select("id") for o, d in lost.items()}
        for i, p in enumerate(self.patterns):
            asked = [cut(d) for c in self.conditions for d in [*affected(c, p, self.state, lost), *affected(c, p, after, fresh)]]
            v = self.provenance(i)
            seats = [e for e in p.elements() if column_of(e) in v.columns]
            for e in seats:
                if e[0] in lost:
                    v = _without(v, column_of(e), lost[e[0]])
            for d in asked:
                keys = [c for c in d.columns if c in v.columns]
                on = [F.col(c) == F.col(f"__{c}") for c in keys]
                v = v.join(d.select(*[F.col(c).alias(f"__{c}") for c in keys]), reduce(lambda x, y: x & y, on, F.lit(True)), "left_anti")
            found = delta_matches(p, after, fresh, self.monic, new=after)
            columns = self.pieces[i][0].columns
            for d in asked:
                again = match(p, after, self.monic, d.select(*[c for c in d.columns if c in columns])).withColumn("delta_rule", F.lit("condition"))
                for e in seats:
                    if e[0] in ended:
                        again = _without(again, column_of(e), ended[e[0]])
                found = again if found is None else found.select(*columns).unionByName(again.select(*columns))
            if found is not None and self.conditions:
                keys = [c for c in columns if c != "delta_rule"]
                told = cut(found.groupBy(*keys).agg(F.max("delta_rule").alias("delta_rule")))
                same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in keys])
                found = self._holding(told.select(*keys), after).join(told.select(*[F.col(c).alias(f"__{c}") for c in keys], "delta_rule"), same)
            # what is left is stored before it takes the place of the earlier pieces
            if any(e[0] in lost for e in seats) or asked:
                self.pieces[i] = [cut(v)]
            if found is not None:
                self.pieces[i].append(cut(found.select(*columns)))
            if len(self.pieces[i]) > PIECES:
                self.pieces[i] = [cut(self.provenance(i))]
        self.state, self.step, self._grown = after, self.step + 1, self._grown | {*lost, *fresh}
        if self.step % PIECES == 0:  # else the plans of tables grow with every step
            self.state = self.state.replace(**{o: cut(self.state[o]) for o in self._grown})
            self._grown = set()

    def insert(self, added: Rows) -> None:
        """Adds rows; ids must be unused."""
        self._go_over(self.state.replace(**{o: self.state[o].unionByName(rows) for o, rows in added.items()}), {}, added)

    def delete(self, gone: Rows) -> None:
        """Removes rows by id (nothing may refer to them)."""
        ids = {o: d.select(F.col(d.columns[0]).alias("__gone")).distinct() for o, d in gone.items()}
        lost = {o: self.state[o].join(d, F.col("id") == F.col("__gone"), "left_semi") for o, d in ids.items()}
        after = self.state
        for o, d in ids.items():
            after = after.rem_parts(o, d)
        self._go_over(after, lost, {})

    def rewrite(self, rule: Rule, m: DataFrame | None = None) -> None:
        """Applies a rule at all of ``m`` (or at all its matches, which must not conflict) and maintains the views.

        What the rule removes, adds, rewires and merges is known from its matches; rows of
        the tables are read only where they refer to those.  (SqPO rules rename rows
        everywhere: there the states are compared.)
        """
        m = cut(rule.matches(self.state) if m is None else m)
        if rule.semantics == "SqPO":
            self.replace(rule.apply(self.state, m).cut())
            return
        d = rule.change(self.state, m)
        before, lost = self.state, {o: cut(i) for o, i in d.lost().items()}
        rows = {o: before[o].join(i.select(F.col("id").alias("__lost")), F.col("id") == F.col("__lost"), "left_semi") for o, i in lost.items()}
        fresh = {o: cut(r) for o, r in d.fresh().items()}
        # the state after: what is untouched, and what is fresh
        changed = {}
        for o in {*lost, *fresh}:
            rest = _without(before[o], "id", lost[o]) if o in lost else before[o]
            changed[o] = rest.unionByName(fresh[o].select(*rest.columns)) if o in fresh else rest
        self._go_over(before.replace(**changed), rows, fresh)

    def replace(self, after: Instance) -> None:
        """Goes over to another state with stable ids: rows that differ count as removed and added again."""
        old, s = self.state, self.state.schema
        before = {o: old[o].select("id", *s.homs_from(o), *s.attrs_of(o)) for o in s.obs}
        now = {o: after[o].select(*before[o].columns) for o in s.obs}
        self._go_over(Instance(s, now), {o: before[o].exceptAll(now[o]) for o in s.obs}, {o: now[o].exceptAll(before[o]) for o in s.obs})

    def validate(self) -> bool:
        """Whether every view equals a search from scratch."""
        for p, v in zip(self.patterns, map(self.matches, range(len(self.patterns)))):
            again = self._holding(match(p, self.state, self.monic), self.state).select(*v.columns)
            if not v.exceptAll(again).isEmpty() or not again.exceptAll(v).isEmpty():
                return False
        return True

    def on_batch(self, ob: str):
        """A ``foreachBatch`` function that inserts each micro-batch into a table."""
        return lambda batch, _: self.insert({ob: cut(batch)})


def delta_rules_json(p: Pattern) -> str:
    """The delta rules of a pattern, for tools that run them elsewhere."""
    atoms = [{"element": column_of((o, k)), "table": o, "keys": {h: column_of((p.schema.homs[h][1], p.homs[h][k])) for h in p.schema.homs_from(o)}} for o, k in p.elements()]
    rules = [{"seed": a["element"], "old": [b["element"] for b in atoms[:i]], "any": [b["element"] for b in atoms[i + 1 :]]} for i, a in enumerate(atoms)]
    return json.dumps({"atoms": atoms, "rules": rules}, indent=1)
