"""Open rewriting on instances against the same on patterns, and colimits against quotients of patterns."""

import pytest
from test_pattern import graph

from loomgraph.instance import Instance
from loomgraph.operators import algebra as A
from loomgraph.operators import open as op
from loomgraph.pattern import Morphism, coproduct, identity, is_isomorphic, quotient
from loomgraph.schema import GRAPH

TWO, EDGE = graph(2), graph(2, (1, 2))
ENDS = [[("V", 1)], [("V", 2)]]


def host(spark, p, legs):
    g, ids = Instance.of_pattern(spark, p)
    return op.OpenInstance(g, [("V", spark.createDataFrame([(i, ids[("V", v)]) for i, v in enumerate(leg)], "foot long, id long")) for leg in legs])


def legs_of(h):
    return [sorted((r["foot"], r["id"]) for r in rows.collect()) for _, rows in h.legs]


def test_matches_are_bijective_on_legs(spark):
    square = graph(4, (1, 2), (2, 3), (3, 4), (4, 1))
    two = op.Open(EDGE, [[("V", 1), ("V", 2)]])
    found = lambda legs, p=two: sorted((r["V_1"], r["V_2"]) for r in op.open_matches(p, host(spark, square, legs)).collect())
    assert found([[1, 2]]) == [(1, 2)] and found([[2, 1]]) == [(1, 2)] and found([[1, 3]]) == []
    assert found([[1]]) == [] and found([[1, 2, 3]]) == []
    assert found([[2], [3]], op.Open(EDGE, ENDS)) == [(2, 3)]
    loop = op.Open(graph(1, (1, 1)), [[("V", 1), ("V", 1)]])
    r = op.open_matches(loop, host(spark, graph(2, (1, 1), (2, 2)), [[2, 2]])).collect()
    assert {(x["V_1"], x["leg0_0"], x["leg0_1"]) for x in r} == {(2, 0, 1), (2, 1, 0)}
    with pytest.raises(ValueError):
        op.open_matches(two, host(spark, square, [[1], [2]]))


def test_rewriting_keeps_the_boundary(spark):
    cut = op.OpenRule(Morphism(TWO, EDGE, {"V": {1: 1, 2: 2}}), identity(TWO), ENDS)
    h = host(spark, graph(3, (1, 2), (1, 2), (2, 3)), [[1], [2]])
    out = cut.rewrite_in(h, 0)
    assert sorted(r["id"] for r in out.body["E"].collect()) == [2, 3] and legs_of(out) == [[(0, 1)], [(0, 2)]]
    assert cut.rewrite_in(h, None).body.nparts("E") == 1 and cut.rewrite_in(h, 5) is None
    # without legs of its own, a rule still deletes no boundary row
    gone = op.OpenRule(Morphism(graph(0), graph(1), {}), identity(graph(0)), [])
    h = host(spark, graph(4, (1, 2)), [[3]])
    assert sorted(r["id"] for r in gone.rewrite_in(h, None).body["V"].collect()) == [1, 2, 3]
    # legs follow merges
    join = op.OpenRule(identity(TWO), Morphism(TWO, graph(1), {"V": {1: 1, 2: 1}}), ENDS)
    out = join.rewrite_in(host(spark, graph(3, (3, 2)), [[3], [2]]), 0)
    assert legs_of(out) == [[(0, 2)], [(0, 2)]] and [(r["src"], r["tgt"]) for r in out.body["E"].collect()] == [(2, 2)]


def test_composition_equals_that_of_patterns(spark):
    path = graph(3, (1, 2), (2, 3))
    both = host(spark, path, [[1], [3]]).beside(host(spark, path, [[1], [3]]))
    want, *_ = op.compose(op.Open(path, [[("V", 1)], [("V", 3)]]), op.Open(path, [[("V", 1)], [("V", 3)]]))
    assert is_isomorphic(both.body.to_pattern(), want.body) and len(both.legs) == 2
    rewritten = op.OpenRule(Morphism(TWO, EDGE, {"V": {1: 1, 2: 2}}), identity(TWO), []).rewrite_in(both, None)
    assert rewritten.body.nparts("E") == 0 and legs_of(rewritten) == legs_of(both)


def test_colimit_and_universal_map(spark):
    parts = [graph(2, (1, 2)), graph(3, (1, 2), (2, 3)), graph(1, (1, 1))]
    gs = [Instance.of_pattern(spark, p)[0] for p in parts]
    rows = lambda *xs: spark.createDataFrame(list(xs), "src long, tgt long")
    # edge 1 of the first is edge 2 of the second; vertices 1 of the second and third are one
    relations = [[(0, {"E": rows((1, 1))}), (1, {"E": rows((1, 2))})], [(1, {"V": rows((9, 1))}), (2, {"V": rows((9, 1))})]]
    col, into = A.colimit(gs, relations)
    whole, ways = coproduct(*parts)
    want = quotient(whole, [(("E", ways[0]("E", 1)), ("E", ways[1]("E", 2))), (("V", ways[1]("V", 1)), ("V", ways[2]("V", 1)))]).cod
    assert col.is_natural() and is_isomorphic(col.to_pattern(), want)
    one = {"V": lambda n: rows(*[(i, 1) for i in range(1, n + 1)]), "E": lambda n: rows(*[(i, 1) for i in range(1, n + 1)])}
    cocone = [{"V": one["V"](p.nparts("V")), "E": one["E"](p.nparts("E"))} for p in parts]
    u = A.universal(into, cocone)
    assert {o: u[o].count() for o in GRAPH.obs} == {o: col.nparts(o) for o in GRAPH.obs} and {r["tgt"] for r in u["V"].collect()} == {1}
    cocone[2]["V"] = rows((1, 7))
    with pytest.raises(ValueError):
        A.universal(into, cocone)
    assert A.colimit(gs[:1], [])[0].to_pattern().parts == gs[0].to_pattern().parts
