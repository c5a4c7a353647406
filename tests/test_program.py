"""Compiled programs against the application of their rules."""

import pytest
from test_pattern import graph

from loomgraph.instance import Instance
from loomgraph.operators.program import Add, Del, Set, compile_rule
from loomgraph.operators.rewrite import Rule
from loomgraph.pattern import Morphism, Pattern, Var, identity
from loomgraph.schema import weighted_graph
from loomgraph.streaming.incremental import MatchView

S = weighted_graph()


def edges(n, *rows):
    return Pattern(S, {"V": list(range(n)), "E": list(range(len(rows)))}, {"src": {i: r[0] for i, r in enumerate(rows)}, "tgt": {i: r[1] for i, r in enumerate(rows)}}, {"weight": {i: r[2] for i, r in enumerate(rows)}})


def rule():
    """Of two edges from a vertex, the first goes, the second gets the sum of both weights, and an edge back is added."""
    L, R = edges(3, (0, 1, Var("a")), (0, 2, Var("b"))), edges(3, (0, 2, Var("sum")), (2, 0, Var("a")))
    keep = Pattern(S, {"V": [0, 1, 2], "E": ["k"]}, {"src": {"k": 0}, "tgt": {"k": 2}})
    v = {0: 0, 1: 1, 2: 2}
    return Rule(Morphism(keep, L, {"V": v, "E": {"k": 1}}), Morphism(keep, R, {"V": v, "E": {"k": 0}}), monic=["E"], exprs={"sum": lambda x: x["a"] + x["b"]})


def rows(g):
    return {o: sorted(map(tuple, g[o].select("id", *S.homs_from(o), *S.attrs_of(o)).collect())) for o in S.obs}


def test_program_equals_application(spark):
    r = rule()
    p = compile_rule(r)
    assert p.tables() == ["E"] and [type(i) for i in p.instructions[:3]] == [Del, Set, Add]
    assert "set E[E_1].weight = f(...)" in p.show() and "new_E_1.weight = ?a" in p.show()
    g, _ = Instance.of_pattern(spark, edges(4, (0, 1, 3), (0, 2, 4), (3, 3, 9)))
    m = r.matches(g, {("E", 0): 1, ("E", 1): 2})
    after = rows(p.run(g, m))
    assert after == rows(r.apply(g, m)) and after["E"] == [(2, 1, 3, 7), (3, 4, 4, 9), (4, 3, 1, 3)]


def test_views_follow_changed_values(spark):
    g, _ = Instance.of_pattern(spark, edges(3, (0, 1, 3), (0, 2, 4)))
    view = MatchView([edges(2, (0, 1, 7))], g)
    assert view.nmatches() == 0
    view.rewrite(rule(), rule().matches(g, {("E", 0): 1, ("E", 1): 2}))
    assert view.nmatches() == 1 and view.validate()


def test_rules_that_merge_or_cascade_are_refused():
    v = {"V": {1: 1, 2: 1}}
    for r in (Rule(identity(graph(2)), Morphism(graph(2), graph(1), v)), Rule(identity(graph(1)), identity(graph(1)), semantics="SPO")):
        with pytest.raises(ValueError):
            compile_rule(r)
