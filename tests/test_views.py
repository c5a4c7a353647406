"""Views under rules, deletions and conditions against searches from scratch; matches along maps against brute force."""

import random

import pytest
from test_pattern import graph

from loomgraph.instance import Instance
from loomgraph.operators.constraints import Commutes, Exists, ExistsUnique, Forall, nac, pac
from loomgraph.operators.factor import lifts, pull_back
from loomgraph.operators.match import first, match
from loomgraph.operators.rewrite import Rule
from loomgraph.pattern import Morphism, Pattern, Var, identity
from loomgraph.schema import GRAPH, Schema
from loomgraph.streaming.incremental import MatchView, affected

EDGE, TWO = graph(2, (1, 2)), graph(2)
SAME = {"V": {1: 1, 2: 2}, "E": {1: 1}}
LOOP = graph(1, (1, 1))


def world(spark, n, edges):
    return Instance(GRAPH, {"V": spark.createDataFrame([(i,) for i in range(n)], "id long"), "E": spark.createDataFrame(edges, "id long, src long, tgt long")})


def some_edges(rng, n, first, k):
    return [(first + i, rng.randrange(n), rng.randrange(n)) for i in range(k)]


def conditions():
    back = Morphism(EDGE, graph(2, (1, 2), (2, 1)), SAME)
    on = Morphism(EDGE, graph(3, (1, 2), (2, 3)), SAME)
    closed = Morphism(on.cod, graph(3, (1, 2), (2, 3), (3, 1)), {"V": {1: 1, 2: 2, 3: 3}, "E": {1: 1, 2: 2}})
    return {"unique": ExistsUnique(on), "nested": Forall(on, Exists(closed)), "either": nac(on) | pac(back)}


@pytest.mark.parametrize("name", list(conditions()))
def test_views_under_conditions_equal_recompute(spark, name):
    rng = random.Random(name)
    view = MatchView([EDGE], world(spark, 8, some_edges(rng, 8, 0, 9)), conditions=[conditions()[name]])
    assert view.validate()
    sizes = [view.nmatches()]
    for step in range(1):
        view.insert({"E": spark.createDataFrame(some_edges(rng, 8, 100 * step + 100, 4), "id long, src long, tgt long")})
        ids = [r[0] for r in view.state["E"].select("id").collect()]
        view.delete({"E": spark.createDataFrame([(i,) for i in rng.sample(sorted(ids), 4)], "id long")})
        assert view.validate()
        sizes.append(view.nmatches())
    assert len(set(sizes)) > 1


def test_a_match_comes_to_life_with_its_last_witness(spark):
    g = world(spark, 4, [(0, 0, 1), (1, 1, 0), (2, 1, 0), (3, 2, 3)])
    view = MatchView([EDGE], g, conditions=[nac(Morphism(EDGE, graph(2, (1, 2), (2, 1)), SAME))])
    edges = lambda: sorted((r["E_1"], r["delta_rule"]) for r in view.provenance().collect())
    assert edges() == [(3, "start")]
    gone = lambda *ids: {"E": spark.createDataFrame([(i,) for i in ids], "id long")}
    view.delete(gone(1))
    assert edges() == [(3, "start")]
    view.delete(gone(2))
    assert edges() == [(0, "condition"), (3, "start")]
    view.insert({"E": spark.createDataFrame([(9, 3, 2)], "id long, src long, tgt long")})
    assert edges() == [(0, "condition")] and view.validate()


def test_what_a_change_affects_follows_the_change(spark):
    g = world(spark, 6, [(0, 0, 1), (1, 1, 0), (2, 2, 3), (3, 4, 5), (4, 5, 4)])
    c = nac(Morphism(EDGE, graph(2, (1, 2), (2, 1)), SAME))
    (found,) = affected(c, EDGE, g, {"E": g["E"].where("id = 4")})
    assert {r["E_1"] for r in found.collect()} == {3, 4}
    s = Schema(("A", "B", "C"), {"f": ("A", "B"), "h": ("B", "C")})
    g = Instance(s, {"A": spark.createDataFrame([(0, 0), (1, 1), (2, 1)], "id long, f long"), "B": spark.createDataFrame([(0, 0), (1, 0)], "id long, h long"), "C": spark.range(1)})
    path = Commutes([(("A_a", "f", "h"), ("C_c",))], {"A_a": "A", "C_c": "C"})
    (found,) = affected(path, Pattern(s, {"A": ["a"], "C": ["c"]}), g, {"B": g["B"].where("id = 1")})
    assert {r["A_a"] for r in found.collect()} == {1, 2}


RULES = {
    "add": Rule(identity(EDGE), Morphism(EDGE, graph(3, (1, 2), (2, 3), (3, 1)), SAME)),
    "delete": Rule(Morphism(TWO, EDGE, {"V": {1: 1, 2: 2}}), identity(TWO)),
    "merge_and_add": Rule(identity(EDGE), Morphism(EDGE, graph(2, (1, 1), (1, 2)), {"V": {1: 1, 2: 1}, "E": {1: 1}})),
    "cascade": Rule(Morphism(Pattern(GRAPH), graph(1), {}), identity(Pattern(GRAPH)), semantics="SPO"),
    "coneg": Rule(Morphism(TWO, EDGE, {"V": {1: 1, 2: 2}}), identity(TWO), semantics="CoNeg"),
    "clone": Rule(Morphism(TWO, graph(1), {"V": {1: 1, 2: 1}}), identity(TWO), semantics="SqPO"),
}


@pytest.mark.parametrize("name", list(RULES))
def test_views_after_rules_equal_recompute(spark, name):
    rng = random.Random(name)
    g, rule = world(spark, 6, some_edges(rng, 6, 0, 9)), RULES[name]
    view = MatchView([graph(3, (1, 2), (2, 3)), LOOP, graph(1)], g)
    m = first(rule.matches(view.state))
    want = rule.apply(view.state, m)
    view.rewrite(rule, m)
    assert view.validate()
    for o in GRAPH.obs:
        columns = ["id", *GRAPH.homs_from(o)]
        assert sorted(view.state[o].select(*columns).collect()) == sorted(want[o].select(*columns).collect())


def test_states_are_cut_after_some_steps(spark, monkeypatch):
    from loomgraph.streaming import incremental

    monkeypatch.setattr(incremental, "PIECES", 3)
    view = MatchView([EDGE], world(spark, 5, [(0, 0, 1)]))
    for i in range(1, 8):
        view.insert({"E": spark.createDataFrame([(i, i % 5, (i * 2) % 5)], "id long, src long, tgt long")})
    plan = view.state["E"]._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") <= 3 and view.validate() and view.nmatches() == 8


ATTR = Schema(("V", "E"), {"src": ("E", "V"), "tgt": ("E", "V")}, {"w": ("E", "long")})


def test_pull_back_and_lifts_equal_brute_force(spark):
    rng = random.Random(7)
    x_edges = [(i, rng.randrange(4), rng.randrange(4), rng.randrange(3)) for i in range(14)]
    x = Instance(ATTR, {"V": spark.range(4), "E": spark.createDataFrame(x_edges, "id long, src long, tgt long, w long")})
    # rows 100 + i go to i; edges 0 and 1 have none, edge 2 has two; an attribute differs, vertex 3 is copied
    copies = [(100 + i, 20 + s, 20 + t, (w + (i == 5)) % 3) for i, s, t, w in x_edges if i > 1] + [(200, 20 + x_edges[2][1], 20 + x_edges[2][2], x_edges[2][3])]
    sub = Instance(ATTR, {"V": spark.createDataFrame([(20 + i,) for i in range(4)], "id long"), "E": spark.createDataFrame(copies, "id long, src long, tgt long, w long")})
    e_map = {i: (i - 100 if i < 200 else 2) for i, *_ in copies}
    f = {"V": spark.createDataFrame([(20 + i, i) for i in range(4)], "src long, tgt long"), "E": spark.createDataFrame(list(e_map.items()), "src long, tgt long")}
    p = Pattern(ATTR, {"V": [1, 2, 3], "E": ["a", "b"]}, {"src": {"a": 1, "b": 2}, "tgt": {"a": 2, "b": 3}}, {"w": {"a": Var("w"), "b": Var("w")}})
    m = match(p, x)
    rows = {e[0]: e for e in x_edges}
    own = {e[0]: e for e in copies}
    paths = [(a, b) for a in rows for b in rows if rows[a][2] == rows[b][1] and rows[a][3] == rows[b][3]]
    back = {i: [k for k, v in e_map.items() if v == i] for i in rows}
    want = [(back[a][0], back[b][0], own[back[a][0]][3]) for a, b in paths if len(back[a]) == len(back[b]) == 1 and own[back[a][0]][3] == own[back[b][0]][3]]
    got = pull_back(p, m, f, sub)
    assert got.columns == m.columns and sorted((r["E_a"], r["E_b"], r["var_w"]) for r in got.collect()) == sorted(want) and want
    want = [(a, b, k, n) for a, b in paths for k in back[a] for n in back[b] if own[k][2] == own[n][1]]
    got = lifts(p, m, f, sub)
    assert sorted((r["E_a"], r["E_b"], r["lift_E_a"], r["lift_E_b"]) for r in got.collect()) == sorted(want)
    assert all(own[r["lift_E_a"]][1] == r["lift_V_1"] for r in got.collect())
    none = {"E": spark.createDataFrame([], "src long, tgt long"), "V": f["V"]}
    assert pull_back(p, m, none, sub).count() == 0 and lifts(p, m, none, sub).count() == 0


def test_lifts_multiply_preimages_that_nothing_ties(spark):
    s = Schema(("A", "B"), {"f": ("A", "B")})
    x = Instance(s, {"A": spark.createDataFrame([(0, 0)], "id long, f long"), "B": spark.range(1)})
    b = Instance(s, {"A": spark.createDataFrame([(0, 0), (1, 0), (2, 1)], "id long, f long"), "B": spark.range(2)})
    p = Pattern(s, {"A": ["a", "c"], "B": ["b"]}, {"f": {"a": "b", "c": "b"}})
    f = {"A": spark.createDataFrame([(i, 0) for i in range(3)], "src long, tgt long"), "B": spark.createDataFrame([(0, 0), (1, 0)], "src long, tgt long")}
    found = lambda **how: sorted((r["lift_A_a"], r["lift_A_c"], r["lift_B_b"]) for r in lifts(p, match(p, x), f, b, **how).collect())
    assert found() == [(0, 0, 0), (0, 1, 0), (1, 0, 0), (1, 1, 0), (2, 2, 1)]
    assert found(monic=["A"]) == [(0, 1, 0), (1, 0, 0)]
