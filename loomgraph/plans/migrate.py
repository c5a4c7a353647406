"""Schedules carried along a map of schemas: every box, its rules, shapes and predicates."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import functions as F

from ..operators.match import column_of
from ..operators.migrate import Migrate
from ..pattern import Pattern
from .schedule import Agent, AgentBatch, Box, Callback, Conditional, Fail, Initialize, Query, RuleApp, Schedule, Strengthen, Weaken


def _shape(f: Migrate, p: Pattern | None) -> Pattern | None:
    return None if p is None else f.pattern(p)


def _elements(f: Migrate, m: dict | None) -> dict | None:
    return None if m is None else {(f.obs[o], k): (f.obs[x], y) for (o, k), (x, y) in m.items()}


def _asked(f: Migrate, ask: Callable | None, shape: Pattern | None) -> Callable | None:
    """A function of a world and an agent that is asked of the world read back along the map."""
    if ask is None:
        return None
    back = {} if shape is None else {column_of((f.obs[o], k)): column_of((o, k)) for o, k in shape.elements()}

    def of(world, agent: Agent, *more):
        own = None if agent is None else agent.select(*[F.col(c).alias(back.get(c, c)) for c in agent.columns])
        return ask(f.pull(world), own, *more)

    return of


def migrate_box(f: Migrate, b: Box) -> Box:
    """The box over the target schema; ``TypeError`` for kinds of boxes that aren't known here."""
    if isinstance(b, Strengthen):
        return Strengthen(b.name, f.morphism(b.rule.right))
    if isinstance(b, RuleApp):
        return replace(b, rule=f.rule(b.rule), shape=_shape(f, b.shape), take=_elements(f, b.take), give=_elements(f, b.give), out_shape=_shape(f, b.out_shape))
    if isinstance(b, Query):
        return replace(b, shape=f.pattern(b.shape), outer=_shape(f, b.outer), take=_elements(f, b.take), condition=f.condition(b.condition))
    if isinstance(b, AgentBatch):
        return replace(b, shape=f.pattern(b.shape), steps=[migrate_box(f, s) for s in b.steps], outer=_shape(f, b.outer), take=_elements(f, b.take), condition=f.condition(b.condition))
    if isinstance(b, Weaken):
        return Weaken(b.name, f.morphism(b.f))
    if isinstance(b, Initialize):
        return Initialize(b.name, f.push(b.world))
    if isinstance(b, Fail):
        return Fail(b.name, _shape(f, b.shape))
    if isinstance(b, Conditional):
        return replace(b, weights=_asked(f, b.weights, b.shape), next_state=_asked(f, b.next_state, b.shape), shape=_shape(f, b.shape))
    if isinstance(b, Callback):
        return replace(b, call=_asked(f, b.call, b.shape), shape=_shape(f, b.shape))
    raise TypeError(f"{type(b).__name__} can't be migrated")


def migrate_schedule(f: Migrate, s: Schedule) -> Schedule:
    """The same wiring with migrated boxes.

    Predicates and callbacks are asked of the world as the source schema sees it, so they
    need no translation; rules, shapes and conditions are renamed.
    """
    return Schedule([migrate_box(f, b) for b in s.boxes], dict(s.wires), s.start, [_shape(f, e) for e in s.exits])
