"""State machines with effects, and the exploration of all their trajectories.

A machine maps ``(state, input)`` to outputs under an effect: ``maybe`` (at most one),
``many`` (any number), ``dist`` (weighted).  ``explore`` follows a wiring of machines
breadth-first; trajectories that an effect splits are rows of a frontier.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from fractions import Fraction
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EFFECTS = ("maybe", "many", "dist")


@dataclass
class Machine:
    """``step(state, port, value)`` gives a list of ``(state, exit, value)``, with a weight in front for ``dist``."""

    name: str
    step: Callable
    init: object = None
    effect: str = "maybe"

    def __post_init__(self):
        if self.effect not in EFFECTS:
            raise ValueError(f"unknown effect {self.effect}")

    def outcomes(self, state, port: int, value) -> list[tuple[Fraction, object, int, object]]:
        found = self.step(state, port, value)
        if self.effect == "dist":
            return [(Fraction(w), s, p, v) for w, s, p, v in found]
        if self.effect == "maybe" and len(found) > 1:
            raise ValueError(f"{self.name} gave more than one outcome")
        return [(Fraction(1), s, p, v) for s, p, v in found]


@dataclass
class Trajectory:
    value: object
    weight: Fraction = Fraction(1)
    steps: list = field(default_factory=list)
    done: bool = False


class BehaviorTree:
    """Remembers a machine's outcomes by the sequence of its inputs."""

    def __init__(self, machine: Machine):
        self.machine, self.seen = machine, {}

    def outcomes(self, state, history: tuple, port: int, value):
        key = (history, port, repr(value))
        if key not in self.seen:
            self.seen[key] = self.machine.outcomes(state, port, value)
        return self.seen[key]


def explore(machines: list[Machine], wires: dict[tuple[int, int], tuple[int, int]], value, steps: int, start: tuple[int, int] = (0, 0)) -> list[Trajectory]:
    """All trajectories of at most ``steps`` steps; a wire to box -1 ends one."""
    trees = [BehaviorTree(m) for m in machines]
    front = [(Trajectory(value), start, [m.init for m in machines], [()] * len(machines))]
    ended: list[Trajectory] = []
    for _ in range(steps):
        following = []
        for t, (at, port), state, past in front:
            for w, s, out, v in trees[at].outcomes(state[at], past[at], port, t.value):
                new = Trajectory(v, t.weight * w, [*t.steps, (machines[at].name, out, v)])
                st, pa = list(state), list(past)
                st[at], pa[at] = s, (*past[at], (port, repr(t.value), out, repr(v)))
                to = wires[(at, out)]
                if to[0] == -1:
                    new.done = True
                    ended.append(new)
                else:
                    following.append((new, to, st, pa))
        front = following
        if not front:
            break
    return ended + [t for t, *_ in front]


def walk(start: DataFrame, moves: DataFrame, steps: int, on: list[str], effect: str = "dist") -> DataFrame:
    """Trajectories as rows: a frontier joined with a table of moves, step by step.

    ``start``: columns ``on`` (the state) and any others that come along; ``moves``: ``on``,
    ``to_<c>`` for states' columns that change, ``num`` and ``den`` (an exact weight; 1 where
    absent) and ``note`` (text; the step's number where absent).  The result has the columns
    of ``start`` at the place reached, ``num`` and ``den`` (products), ``path`` (the notes, for
    ``writer``) and ``done``: no move leads on.  A trajectory that ends stays as it is.

    ``effect``: ``many`` and ``dist`` follow every move, ``writer`` writes the notes down;
    ``maybe`` raises ``ValueError`` where a state has several moves.  Weights are products of
    64-bit integers: an overflow is an error.
    """
    if effect not in (*EFFECTS, "writer"):
        raise ValueError(f"unknown effect {effect}")
    from ..functions.ids import cut

    one = F.lit(1).cast("long")
    own = [F.col(c).alias(f"__{c}") for c in on]
    to = [c for c in on if f"to_{c}" in moves.columns]
    table = cut(moves.select(*own, *[F.col(f"to_{c}").alias(f"__to_{c}") for c in to], *[(F.col(c).cast("long") if c in moves.columns else one).alias(f"__{c}") for c in ("num", "den")], (F.col("note") if "note" in moves.columns else F.lit("*")).cast("string").alias("__note")))
    if effect == "maybe" and not table.groupBy(*[f"__{c}" for c in on]).agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        raise ValueError("a state has several moves")
    front, ended = start.withColumns({"num": one, "den": one, "path": F.lit("")}), None
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in on])
    for _ in range(steps):
        both = front.join(table, same, "left")
        stuck = both.where(F.col("__num").isNull()).select(*front.columns, F.lit(True).alias("done"))
        ended = cut(stuck) if ended is None else cut(ended.unionByName(stuck))
        path = F.concat_ws(",", F.when(F.col("path") != "", F.col("path")), F.col("__note")) if effect == "writer" else F.col("path")
        moved = {"num": F.col("num") * F.col("__num"), "den": F.col("den") * F.col("__den"), "path": path, **{c: F.col(f"__to_{c}") for c in to}}
        front = cut(both.where(F.col("__num").isNotNull()).select(*[moved.get(c, F.col(c)).alias(c) for c in front.columns]))
    last = front.withColumn("done", F.lit(False))
    return last if ended is None else ended.unionByName(last)


def as_table(spark: SparkSession, found: list[Trajectory]) -> DataFrame:
    """``(traj, step, box, port, value, num, den)``: weights as exact fractions."""
    rows = [(i, k, b, p, repr(v), t.weight.numerator, t.weight.denominator) for i, t in enumerate(found) for k, (b, p, v) in enumerate(t.steps)]
    return spark.createDataFrame(rows, "traj int, step int, box string, port int, value string, num long, den long")


def fold_by_key(events: DataFrame, key: str, order: list[str], step, init, out: str) -> DataFrame:
    """A machine per key over ordered events, in one aggregate: ``step(state, event) -> state``, as Columns.

    The state after the last event of each key.  A key's events are gathered, so this is
    for keys with a bounded number of events (streams: ``transformWithStateInPandas``).
    """
    cols = [F.col(c) for c in [*order, *[c for c in events.columns if c not in order and c != key]]]
    gathered = events.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*cols))).alias("__e"))
    return gathered.select(key, F.aggregate("__e", init, step).alias(out))
