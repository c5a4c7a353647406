import json

import pytest
from test_pattern import graph

from loomgraph.functions.dot import morphism_dot, pattern_dot, trajectory_dot
from loomgraph.instance import Instance
from loomgraph.operators import open as op
from loomgraph.operators.match import match
from loomgraph.operators.migrate import Migrate, is_slice, sliced, typed_pattern
from loomgraph.operators.pbpo import TypedRule
from loomgraph.operators.process import dependencies
from loomgraph.operators.rewrite import Rule
from loomgraph.pattern import Morphism, Pattern, identity, inclusion, is_isomorphic
from loomgraph.plans import schedule as S
from loomgraph.plans.mealy import Machine, as_table, explore
from loomgraph.schema import GRAPH, Schema
from loomgraph.sources.tables import read, write
from loomgraph.streaming.incremental import MatchView, delta_rules_json


def test_incremental_equals_recompute(spark):
    path = graph(3, (1, 2), (2, 3))
    g, _ = Instance.of_pattern(spark, graph(3, (1, 2), (2, 3), (3, 3)))
    view = MatchView([path, graph(1, (1, 1))], g)
    edge = graph(2, (1, 2))
    triangle = graph(3, (1, 2), (2, 3), (3, 1))
    view.rewrite(Rule(identity(edge), Morphism(edge, triangle, {"V": {1: 1, 2: 2}, "E": {1: 1}})))
    assert view.validate() and view.nmatches() > 3
    view.delete({"E": spark.createDataFrame([(3,)], "id long")})
    assert view.validate()
    assert len(json.loads(delta_rules_json(path))["rules"]) == 5


def test_typed_rule_doubles_and_deletes(spark):
    """Loop removal on a vertex without other edges; types forbid edges between it and the rest."""
    L = graph(1, (1, 1))
    types = Pattern(GRAPH, {"V": ["x", "c"], "E": ["l", "cc"]}, {"src": {"l": "x", "cc": "c"}, "tgt": {"l": "x", "cc": "c"}})
    Kp = Pattern(GRAPH, {"V": ["x", "c"], "E": ["cc"]}, {"src": {"cc": "c"}, "tgt": {"cc": "c"}})
    K = graph(1)
    rule = TypedRule(
        Morphism(K, L, {"V": {1: 1}}), identity(K), Morphism(L, types, {"V": {1: "x"}, "E": {1: "l"}}), Morphism(K, Kp, {"V": {1: "x"}}),
        Morphism(Kp, types, {"V": {"x": "x", "c": "c"}, "E": {"cc": "cc"}}),
    )
    g, _ = Instance.of_pattern(spark, graph(3, (1, 1), (2, 3)))
    assert is_isomorphic(rule.rewrite(g).to_pattern(), graph(3, (1, 2)))
    h, _ = Instance.of_pattern(spark, graph(2, (1, 1), (1, 2)))
    assert rule.rewrite(h) is None


def test_migration(spark):
    tree = Schema(("N", "A"), {"from": ("A", "N"), "to": ("A", "N")})
    f = Migrate(tree, GRAPH, {"N": "V", "A": "E"}, {"from": "src", "to": "tgt"})
    g, _ = Instance.of_pattern(spark, graph(2, (1, 2)))
    pulled = f.pull(g)
    assert pulled["A"].columns == ["id", "from", "to"] and is_isomorphic(f.push(pulled).to_pattern(), graph(2, (1, 2)))
    edge = Pattern(tree, {"N": [1, 2], "A": [1]}, {"from": {1: 1}, "to": {1: 2}})
    r = f.rule(Rule(inclusion(edge.restrict({("N", 1), ("N", 2)}), edge), inclusion(edge.restrict({("N", 1), ("N", 2)}), edge.restrict({("N", 1), ("N", 2)}))))
    assert r.rewrite(g).nparts("E") == 0


def test_slices(spark):
    base = graph(2, (1, 2), (2, 1))
    b, ids = Instance.of_pattern(spark, base)
    edge = graph(2, (1, 2))
    typed = typed_pattern(edge, Morphism(edge, base, {"V": {1: 1, 2: 2}, "E": {1: 1}}), ids)
    host = graph(3, (1, 2), (2, 3))
    over = typed_pattern(host, Morphism(host, base, {"V": {1: 1, 2: 2, 3: 1}, "E": {1: 1, 2: 2}}), ids)
    g, _ = Instance.of_pattern(spark, over)
    assert is_slice(g, b) and match(typed, g).count() == 1 and match(edge, Instance(GRAPH, g.tables)).count() == 2
    assert sliced(GRAPH).attrs_of("V") == ["V_type"]


def test_open_systems_compose():
    edge = graph(2, (1, 2))
    whole, f, g = op.compose(op.Open(edge, [[("V", 1)], [("V", 2)]]), op.Open(edge, [[("V", 1)], [("V", 2)]]))
    assert is_isomorphic(whole.body, graph(3, (1, 2), (2, 3))) and len(whole.legs) == 2
    two = graph(2)
    cut = op.OpenRule(Morphism(two, edge, {"V": {1: 1, 2: 2}}), identity(two), [[("V", 1)], [("V", 2)]])
    both = cut.beside(cut)
    assert both.left.cod.nparts("E") == 2 and both.right.cod.nparts("E") == 0 and both.right.cod.nparts("V") == 3
    out = cut.rewrite(op.Open(graph(3, (1, 2), (2, 3)), [[("V", 1)]]), 0)
    assert out.body.nparts("E") == 1 and out.legs == [[("V", out.legs[0][0][1])]]
    undo = op.OpenRule(identity(two), Morphism(two, edge, {"V": {1: 1, 2: 2}}), [[("V", 1)], [("V", 2)]])
    assert is_isomorphic(cut.after(undo).right.cod, edge)


def test_causality(spark):
    rows = [(0, "V", 9, "created"), (1, "V", 9, "used"), (1, "V", 10, "created"), (2, "V", 10, "used"), (2, "V", 1, "used")]
    e = spark.createDataFrame(rows, "step int, ob string, id long, role string")
    assert sorted(map(tuple, dependencies(e).collect())) == [(0, 1), (1, 2)]


def _edge_deleter():
    two, edge = graph(2), graph(2, (1, 2))
    return Rule(Morphism(two, edge, {"V": {1: 1, 2: 2}}), identity(two))


def test_schedules(spark):
    g, _ = Instance.of_pattern(spark, graph(3, (1, 2), (2, 3)))
    rule = _edge_deleter()
    world, _, port, log = S.loop_rule(S.RuleApp("cut", rule)).run(g)
    assert world.nparts("E") == 0 and port == 0 and len(log) == 3
    world, *_ = S.for_schedule(1, S.tryrule(S.RuleApp("cut", rule))).run(g)
    assert world.nparts("E") == 1
    world, *_ = S.while_schedule(lambda w, _: w.nparts("E") > 0, S.tryrule(S.RuleApp("cut", rule))).run(g)
    assert world.nparts("E") == 0
    with pytest.raises(RuntimeError):
        (S.loop_rule(S.RuleApp("cut", rule)) >> S.succeed(S.RuleApp("cut", rule))).run(g)
    with pytest.warns(UserWarning):
        S.loop_rule(S.RuleApp("cut", rule)).run(g, maxstep=1)
    coin = S.uniform("coin", 2, seed=3)
    assert S.singleton(coin).merge_exits().run(g)[2] == 0 and "digraph" in S.singleton(coin).dot()
    assert trajectory_dot(log).startswith("digraph")


def test_agents_each_get_a_loop(spark):
    g, _ = Instance.of_pattern(spark, graph(2, (1, 2)))
    one, loop = graph(1), graph(1, (1, 1))
    r = Rule(identity(one), Morphism(one, loop, {"V": {1: 1}}))
    body = S.tryrule(S.RuleApp("loop", r, one, {("V", 1): ("V", 1)}))
    world, _, port, _ = S.agent(body, one).run(g)
    assert port == 0 and world["E"].where("src = tgt").count() == 2


def test_schedule_types_are_checked(spark):
    one = graph(1)
    bad = S.Schedule([S.uniform("a", 1), S.uniform("b", 1, one)], {(0, 0): (1, 0), (1, 0): (S.EXIT, 0)})
    with pytest.raises(TypeError):
        bad.typecheck()


def test_machines(spark):
    walk = Machine("walk", lambda s, p, v: [(0.5, s, 0, v - 1), (0.5, s, 0, v + 1)] if abs(v) < 2 else [(1, s, 1, v)], effect="dist")
    found = explore([walk], {(0, 0): (0, 0), (0, 1): (-1, 0)}, 0, 3)
    assert sum(t.weight for t in found) == 1 and {t.value for t in found if t.done} == {-2, 2}
    assert as_table(spark, found).count() == sum(len(t.steps) for t in found)
    with pytest.raises(ValueError):
        explore([Machine("two", lambda s, p, v: [(s, 0, v), (s, 0, v)])], {(0, 0): (-1, 0)}, 0, 1)


def test_drawing_and_files(spark, tmp_path):
    g, _ = Instance.of_pattern(spark, graph(2, (1, 2)))
    for kind in ("parquet", "json"):
        write(g, str(tmp_path / kind), kind)
        assert is_isomorphic(read(spark, str(tmp_path / kind), GRAPH, kind).to_pattern(), graph(2, (1, 2)))
    assert "src" in pattern_dot(graph(2, (1, 2))) and "dashed" in morphism_dot(identity(graph(1)))


def test_storage_primitives(spark):
    g, _ = Instance.of_pattern(spark, graph(3, (1, 2), (2, 3)))
    assert g.is_natural() and not g.is_empty()
    h = g.set_subpart("E", "tgt", spark.createDataFrame([(1, 9)], "id long, v long"))
    assert [tuple(r) for r in h.dangling().collect()] == [("tgt", 1)]
    assert g.rem_parts("E", spark.createDataFrame([(1,)], "id long")).nparts("E") == 1
    assert g.add_parts("V", spark.createDataFrame([(7,)], "id long")).nparts("V") == 4
    assert [r["id"] for r in g.incident("E", ("src",), 2).collect()] == [2]


def test_entry_and_oracles(spark, sf):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 235
    assert set(e.oracle_sql()) <= set(e.queries())
