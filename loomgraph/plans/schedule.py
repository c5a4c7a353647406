"""Schedules: control flow over rules, for agent-style simulation.

A schedule is a graph of boxes.  A token holds the world and an agent (a match of the
wire's pattern, as a one-row DataFrame or None for the empty agent) and moves from box
to box; each box gives the exit port.  Worlds are checkpointed as they change, so the
plan of a long run does not grow.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ids import cut
from ..instance import Instance
from ..operators.match import column_of, first, match
from ..operators.rewrite import Rule
from ..pattern import Element, Morphism, Pattern

Agent = DataFrame | None


def _draw(seed: int, *of) -> float:
    """One stable draw in [0, 1) per decision."""
    import zlib

    return zlib.crc32(repr((seed, *of)).encode()) / 2**32


def agent_columns(shape: Pattern | None) -> list[str]:
    return [column_of(e) for e in shape.elements()] if shape else []


def alive(world: Instance, shape: Pattern, agent: DataFrame) -> bool:
    """Whether every row that the agent names is still there."""
    for e in shape.elements():
        if column_of(e) in agent.columns:
            ids = world[e[0]].select(F.col("id").alias("__i"))
            if not agent.join(ids, F.col(column_of(e)) == F.col("__i"), "left_anti").isEmpty():
                return False
    return True


@dataclass
class Trajectory:
    """Worlds and agents of a run, step by step; a world is kept once however many steps leave it as it is.

    Worlds share the tables that a step doesn't touch, and are checkpointed by the boxes
    that change them, so keeping them costs no more than their changes.
    """

    worlds: list[Instance] = field(default_factory=list)
    steps: list[tuple[int, str, int, Agent]] = field(default_factory=list)  # step, box, number of the world after it, agent

    def add(self, step: int, box: str, before: Instance, after: Instance, agent: Agent) -> None:
        if not self.worlds:
            self.worlds.append(before)
        if after is not before:
            self.worlds.append(after)
        self.steps.append((step, box, len(self.worlds) - 1, agent))

    def at(self, step: int) -> Instance:
        """The world after a step."""
        return self.worlds[next(w for s, _, w, _ in self.steps if s == step)]

    def changes(self, ob: str) -> DataFrame:
        """``(world, change, <row>)``: rows that each world has beyond the one before it (``added``), and those that it lacks (``removed``); changed rows are both."""
        out = None
        for i, (a, b) in enumerate(zip(self.worlds, self.worlds[1:]), 1):
            columns = ["id", *a.schema.homs_from(ob), *a.schema.attrs_of(ob)]
            x, y = a[ob].select(*columns), b[ob].select(*columns)
            for name, rows in (("removed", x.exceptAll(y)), ("added", y.exceptAll(x))):
                rows = rows.select(F.lit(i).alias("world"), F.lit(name).alias("change"), "*")
                out = rows if out is None else out.unionAll(rows)
        return out


class Box:
    """``inputs`` and ``outputs``: agent shapes of the ports (None: the empty agent)."""

    inputs: list = [None]
    outputs: list = [None]

    def fresh_state(self):
        return None

    def update(self, state, port: int, world: Instance, agent: Agent, step: int):
        """``(state, exit port, world, agent, message)``."""
        raise NotImplementedError


@dataclass
class RuleApp(Box):
    """Exit 0 after applying the rule at the first match that extends the agent, exit 1 if there is none.

    ``take``: elements of the rule's L that the incoming agent gives; ``give``: elements
    of R that the outgoing agent holds.  ``everywhere=True`` applies a maximal set of
    independent matches at once.
    """

    name: str
    rule: Rule
    shape: Pattern | None = None
    take: dict[Element, Element] = field(default_factory=dict)
    give: dict[Element, Element] | None = None
    out_shape: Pattern | None = None
    everywhere: bool = False
    seed: int | None = None

    def __post_init__(self):
        self.inputs, self.outputs = [self.shape], [self.out_shape if self.give is not None else self.shape, self.shape]

    def update(self, state, port, world, agent, step):
        initial = None
        if agent is not None and self.take:
            initial = agent.select(*[F.col(column_of(a)).alias(column_of(e)) for a, e in self.take.items()])
        m = self.rule.matches(world, initial)
        if self.everywhere:
            m = self.rule.independent(m)
        elif self.seed is None:
            m = first(m)
        else:
            m = m.orderBy(F.xxhash64(F.lit(self.seed + step), *[c for c in m.columns if not c.startswith("var_")])).limit(1)
        m = cut(m)
        if m.isEmpty():
            return state, 1, world, agent, "no match"
        after, placed = self.rule.apply_with_maps(world, m)
        after, out = after.cut(), agent
        if self.give is not None:
            cols = [F.col(f"new_{column_of(e)}" if f"new_{column_of(e)}" in placed.columns else column_of((e[0], self.rule._back(e)))).alias(column_of(a)) for a, e in self.give.items()]
            out = cut(placed.select(*cols))
        return state, 0, after, out, "applied"


@dataclass
class Query(Box):
    """Agents one after another.

    Entering by port 0 finds the agents; each leaves by exit 1; coming back by port 1
    gives the next one (last found first); when none is left, exit 0 with the agent
    that came in, or exit 2 with none if that one has died.  Agents that died meanwhile
    are passed over.
    """

    name: str
    shape: Pattern
    outer: Pattern | None = None
    take: dict[Element, Element] = field(default_factory=dict)
    condition: object = None

    def __post_init__(self):
        self.inputs, self.outputs = [self.outer, self.shape], [self.outer, self.shape, None]

    def update(self, state, port, world, agent, step):
        if port == 0:
            initial = agent.select(*[F.col(column_of(a)).alias(column_of(e)) for a, e in self.take.items()]) if agent is not None and self.take else None
            m = match(self.shape, world, initial=initial)
            if self.condition is not None:
                m = self.condition.holds(m, world)
            # faithful order needs the agents one by one; bounded by the agents of one model step
            state = (agent, [tuple(r) for r in m.orderBy(*m.columns).toLocalIterator()], m.schema)
        outer, left, schema = state
        spark = next(iter(world.tables.values())).sparkSession
        while left:
            one = spark.createDataFrame([left.pop()], schema)
            if alive(world, self.shape, one):
                return (outer, left, schema), 1, world, one, f"{len(left)} left"
        if outer is not None and self.outer is not None and not alive(world, self.outer, outer):
            return None, 2, world, None, "agent died"
        return None, 0, world, outer, "done"


@dataclass
class AgentBatch(Box):
    """All agents at once: rules applied set-at-a-time, agents never leave their DataFrame.

    The agents are the matches of ``shape`` (that extend the incoming agent by ``take``)
    which satisfy ``condition``.  Each of ``steps`` is applied for every agent that is
    still there: an agent's match is its first by ids; those of several agents that conflict
    take turns, in rounds of maximal independent sets.  An agent without a match passes on
    to the next step.  Exit 0 with the agent that came in; exit 1 with none if that one has
    died meanwhile.  As one after another, if no agent's step makes a match for another's.
    """

    name: str
    shape: Pattern
    steps: list[RuleApp]
    outer: Pattern | None = None
    take: dict[Element, Element] = field(default_factory=dict)
    condition: object = None

    def __post_init__(self):
        self.inputs, self.outputs = [self.outer], [self.outer, None]
        for step in self.steps:
            if step.give is not None:
                raise ValueError(f"{step.name} gives another agent: agents of a batch stay what they are")

    def agents(self, world: Instance, agent: Agent) -> DataFrame:
        initial = agent.select(*[F.col(column_of(a)).alias(column_of(e)) for a, e in self.take.items()]) if agent is not None and self.take else None
        found = match(self.shape, world, initial=initial)
        if self.condition is not None:
            found = self.condition.holds(found, world)
        return found.select(*[c for c in agent_columns(self.shape) if c in found.columns])

    def living(self, world: Instance, agents: DataFrame) -> DataFrame:
        for e in self.shape.elements():
            if column_of(e) in agents.columns:
                agents = agents.join(world[e[0]].select(F.col("id").alias("__i")), F.col(column_of(e)) == F.col("__i"), "left_semi")
        return agents

    def apply_step(self, step: RuleApp, world: Instance, agents: DataFrame) -> tuple[Instance, int]:
        """The world after one step for all agents, and how many rounds it took."""
        key = {column_of(a): column_of(e) for a, e in step.take.items()}
        left, rounds = cut(agents), 0
        while True:
            initial = self.living(world, left).select(*[F.col(a).alias(e) for a, e in key.items()]).distinct()
            m = step.rule.matches(world, initial)
            ids = [c for c in m.columns if not c.startswith("var_")]
            own = list(key.values())
            best = m.groupBy(*own).agg(F.min(F.struct(*ids)).alias("__best")).select("__best.*")
            same = F.lit(True)
            for c in ids:
                same = same & (F.col(c) == F.col(f"__{c}"))
            m = m.join(best.select(*[F.col(c).alias(f"__{c}") for c in ids]), same, "left_semi")
            chosen = cut(step.rule.independent(cut(m)))
            if chosen.isEmpty():
                return world, rounds
            world, rounds = step.rule.apply(world, chosen).cut(), rounds + 1
            done = chosen.select(*[F.col(e).alias(f"__{e}") for e in own]).distinct()
            took = F.lit(True)
            for a, e in key.items():
                took = took & (F.col(a) == F.col(f"__{e}"))
            left = cut(left.join(done, took, "left_anti"))

    def update(self, state, port, world, agent, step):
        found, rounds = cut(self.agents(world, agent)), 0
        for s in self.steps:
            world, n = self.apply_step(s, world, found)
            rounds += n
        if agent is not None and self.outer is not None and not alive(world, self.outer, agent):
            return state, 1, world, None, f"{rounds} rounds, agent died"
        return state, 0, world, agent, f"{rounds} rounds"


@dataclass
class Weaken(Box):
    """Keeps part of the agent: ``f: smaller -> larger`` shape."""

    name: str
    f: Morphism

    def __post_init__(self):
        self.inputs, self.outputs = [self.f.cod], [self.f.dom]

    def update(self, state, port, world, agent, step):
        cols = [F.col(column_of((o, self.f(o, k)))).alias(column_of((o, k))) for o, k in self.f.dom.elements() if column_of((o, self.f(o, k))) in agent.columns]
        return state, 0, world, cut(agent.select(*cols)) if cols else None, "weakened"


class Strengthen(RuleApp):
    """Adds to the world and to the agent: ``f: smaller -> larger`` shape."""

    def __init__(self, name: str, f: Morphism):
        from ..pattern import identity

        rule = Rule(identity(f.dom), f, freevar=True)
        super().__init__(name, rule, f.dom, {e: e for e in f.dom.elements()}, {e: e for e in f.cod.elements()}, f.cod)


@dataclass
class Initialize(Box):
    """Replaces the world; the agent becomes empty."""

    name: str
    world: Instance

    def update(self, state, port, world, agent, step):
        return state, 0, self.world, None, "initialized"


@dataclass
class Fail(Box):
    """Ends the run with an error."""

    name: str = "fail"
    shape: Pattern | None = None

    def __post_init__(self):
        self.inputs, self.outputs = [self.shape], []

    def update(self, state, port, world, agent, step):
        raise RuntimeError(f"schedule failed at {self.name}")


@dataclass
class Conditional(Box):
    """A weighted exit: one draw per decision.  ``weights(world, agent, state)`` gives a list;
    ``next_state(world, agent, state)`` updates the box's own state."""

    name: str
    weights: Callable
    n: int
    shape: Pattern | None = None
    next_state: Callable | None = None
    init: object = None
    seed: int = 0

    def __post_init__(self):
        self.inputs, self.outputs = [self.shape], [self.shape] * self.n

    def fresh_state(self):
        return self.init

    def update(self, state, port, world, agent, step):
        w = [float(x) for x in self.weights(world, agent, state)]
        at, total, out = _draw(self.seed, self.name, step) * sum(w), 0.0, 0
        for i, x in enumerate(w):
            total += x
            if x > 0 and at < total:
                out = i
                break
        if self.next_state:
            state = self.next_state(world, agent, state)
        return state, out, world, agent, f"exit {out}"


def const_cond(name: str, weights: list[float], shape=None, seed: int = 0) -> Conditional:
    return Conditional(name, lambda *_: weights, len(weights), shape, seed=seed)


def uniform(name: str, n: int, shape=None, seed: int = 0) -> Conditional:
    return const_cond(name, [1.0] * n, shape, seed)


def if_cond(name: str, test: Callable, shape=None) -> Conditional:
    """Exit 0 if ``test(world, agent)``, else 1."""
    return Conditional(name, lambda w, a, _: [1, 0] if test(w, a) else [0, 1], 2, shape)


@dataclass
class Callback(Box):
    name: str
    call: Callable
    shape: Pattern | None = None

    def __post_init__(self):
        self.inputs, self.outputs = [self.shape], [self.shape]

    def update(self, state, port, world, agent, step):
        self.call(world, agent)
        return state, 0, world, agent, "called"


EXIT = -1


@dataclass
class Schedule:
    """Boxes and wires ``(box, exit) -> (box, entry)``; box ``EXIT`` is the outside.  Wires may meet."""

    boxes: list[Box]
    wires: dict[tuple[int, int], tuple[int, int]]
    start: tuple[int, int] = (0, 0)
    exits: list = field(default_factory=lambda: [None])

    def typecheck(self) -> None:
        def same(a: Pattern | None, b: Pattern | None) -> bool:
            return (a is None and b is None) or (a is not None and b is not None and a.parts == b.parts and a.homs == b.homs)

        for i, b in enumerate(self.boxes):
            for k, out in enumerate(b.outputs):
                if (i, k) not in self.wires:
                    raise TypeError(f"exit {k} of {b.name} goes nowhere")
                j, n = self.wires[(i, k)]
                into = self.exits[n] if j == EXIT else self.boxes[j].inputs[n]
                if not same(out, into):
                    raise TypeError(f"exit {k} of {b.name} and entry {n} of {'the outside' if j == EXIT else self.boxes[j].name} differ in shape")

    def __rshift__(self, other: Schedule) -> Schedule:
        """Sequential composition: exit 0 of the first enters the second; further exits stay, after the second's."""
        n = len(self.boxes)
        move = lambda t: (t[0] + n, t[1]) if t[0] != EXIT else t
        wires = {}
        for k, t in self.wires.items():
            wires[k] = move(other.start) if t == (EXIT, 0) else (EXIT, t[1] - 1 + len(other.exits)) if t[0] == EXIT else t
        wires |= {(i + n, k): move(t) for (i, k), t in other.wires.items()}
        return Schedule([*self.boxes, *other.boxes], wires, self.start, [*other.exits, *self.exits[1:]])

    def trace(self, out: int) -> Schedule:
        """Feeds an exit back to the start."""
        wires = {k: self.start if t == (EXIT, out) else (EXIT, t[1] - (t[1] > out)) if t[0] == EXIT else t for k, t in self.wires.items()}
        return Schedule(self.boxes, wires, self.start, [e for i, e in enumerate(self.exits) if i != out])

    def merge_exits(self) -> Schedule:
        wires = {k: (EXIT, 0) if t[0] == EXIT else t for k, t in self.wires.items()}
        return Schedule(self.boxes, wires, self.start, self.exits[:1])

    def run(self, world: Instance, agent: Agent = None, maxstep: int = 1000, on_change: Callable | None = None, keep: Trajectory | None = None):
        """``(world, agent, exit, trajectory)``; the trajectory lists ``(step, box, port, message)``.  ``keep`` gets the worlds, too."""
        self.typecheck()
        state, (at, port), log = [b.fresh_state() for b in self.boxes], self.start, []
        for step in range(maxstep):
            box = self.boxes[at]
            state[at], out, after, agent, said = box.update(state[at], port, world, agent, step)
            if after is not world and on_change:
                on_change(step, after)
            if keep is not None:
                keep.add(step, box.name, world, after, agent)
            world = after
            log.append((step, box.name, out, said))
            at, port = self.wires[(at, out)]
            if at == EXIT:
                return world, agent, port, log
        warnings.warn(f"stopped after {maxstep} steps", stacklevel=2)
        return world, agent, None, log

    def dot(self) -> str:
        lines = ["digraph schedule {", '  in [shape=none]; out [shape=none];', f"  in -> b{self.start[0]};"]
        lines += [f'  b{i} [label="{b.name}", shape=box];' for i, b in enumerate(self.boxes)]
        lines += [f'  b{i} -> {"out" if j == EXIT else f"b{j}"} [taillabel="{k}", headlabel="{n}"];' for (i, k), (j, n) in self.wires.items()]
        return "\n".join([*lines, "}"])


def singleton(box: Box) -> Schedule:
    """A box by itself: its first entry, and all of its exits."""
    return Schedule([box], {(0, k): (EXIT, k) for k in range(len(box.outputs))}, (0, 0), list(box.outputs))


def tryrule(box: RuleApp) -> Schedule:
    return singleton(box).merge_exits()


def succeed(box: RuleApp) -> Schedule:
    """Fails if the rule has no match."""
    s = Schedule([box, Fail(f"{box.name} has no match", box.shape)], {(0, 0): (EXIT, 0), (0, 1): (1, 0)}, (0, 0), [box.outputs[0]])
    return s


def loop_rule(box: RuleApp) -> Schedule:
    """Until the rule has no match."""
    return singleton(box).trace(0)


def has_match(name: str, p: Pattern, monic=()) -> Conditional:
    return if_cond(name, lambda w, _: not match(p, w, monic).limit(1).isEmpty())


def while_schedule(test: Callable, body: Schedule, name: str = "while") -> Schedule:
    """As long as ``test(world, agent)``."""
    c = if_cond(name, test, body.exits[0])
    n = 1
    move = lambda t: (t[0] + n, t[1]) if t[0] != EXIT else (0, 0)
    return Schedule([c, *body.boxes], {(0, 0): (body.start[0] + n, body.start[1]), (0, 1): (EXIT, 0)} | {(i + n, k): move(t) for (i, k), t in body.wires.items()}, (0, 0), [body.exits[0]])


def for_schedule(times: int, body: Schedule, name: str = "for") -> Schedule:
    s = while_schedule(lambda *_: False, body, name)
    s.boxes[0] = Conditional(name, lambda w, a, k: [1, 0] if k else [0, 1], 2, body.exits[0], lambda w, a, k: k - 1 if k else times, times)
    return s


def agent(body: Schedule, shape: Pattern, name: str = "agents", condition=None) -> Schedule:
    """Runs ``body`` for each agent; fails if the outer agent dies."""
    q, n = Query(name, shape, condition=condition), 1
    move = lambda t: (t[0] + n, t[1]) if t[0] != EXIT else (0, 1)
    wires = {(0, 0): (EXIT, 0), (0, 1): (body.start[0] + n, body.start[1]), (0, 2): (len(body.boxes) + 1, 0)} | {(i + n, k): move(t) for (i, k), t in body.wires.items()}
    return Schedule([q, *body.boxes, Fail("agent died")], wires, (0, 0), [None])
