import pytest
from test_pattern import graph

from loomgraph.instance import Instance
from loomgraph.operators import algebra as A
from loomgraph.operators.constraints import Const, Exists, lift, nac
from loomgraph.operators.match import match
from loomgraph.operators.rewrite import Rule
from loomgraph.pattern import Morphism, Pattern, Var, homs, inclusion, is_isomorphic
from loomgraph.schema import GRAPH, Schema, weighted_graph


def run(spark, rule, host, initial=None):
    g, ids = Instance.of_pattern(spark, host)
    m = rule.matches(g, {e: ids[x] for e, x in initial.items()} if initial else None)
    return rule.apply(g, m).to_pattern()


def span(i, left, right, lmap, rmap, **kw):
    return Rule(Morphism(i, left, lmap), Morphism(i, right, rmap), **kw)


def test_dpo_adds_a_reverse_edge(spark):
    two = graph(2)
    r = span(two, graph(2, (1, 2)), graph(2, (1, 2), (2, 1)), {"V": {1: 1, 2: 2}}, {"V": {1: 1, 2: 2}})
    out = run(spark, r, graph(3, (2, 1), (2, 3)), {("V", 1): ("V", 2), ("V", 2): ("V", 1)})
    assert is_isomorphic(out, graph(3, (1, 2), (1, 3), (2, 1)))


def test_dpo_deletes_the_top_of_a_span(spark):
    L = graph(3, (1, 2), (1, 3))
    r = span(graph(2), L, graph(2), {"V": {1: 2, 2: 3}}, {"V": {1: 1, 2: 2}})
    host = graph(4, (1, 2), (1, 4), (2, 4), (3, 2), (4, 3))
    out = run(spark, r, host, {("V", 1): ("V", 1), ("V", 2): ("V", 2), ("V", 3): ("V", 4)})
    assert is_isomorphic(out, graph(3, (1, 2), (2, 3), (3, 1)))


def test_dpo_non_monic_match_on_a_loop(spark):
    r = span(graph(2), graph(2, (1, 2)), graph(2), {"V": {1: 1, 2: 2}}, {"V": {1: 1, 2: 2}})
    out = run(spark, r, graph(2, (1, 1), (2, 2)), {("V", 1): ("V", 1), ("V", 2): ("V", 1)})
    assert is_isomorphic(out, graph(2, (2, 2)))


def test_dangling_witness(spark):
    L = graph(3, (1, 2), (1, 3))
    r = span(graph(1), L, graph(1), {"V": {1: 1}}, {"V": {1: 1}})
    g, _ = Instance.of_pattern(spark, graph(4, (1, 2), (1, 4), (2, 4), (3, 2), (4, 3)))
    m = match(L, g, initial={("V", 1): 1, ("V", 2): 2, ("V", 3): 4})
    found = {(x["hom"], x["row"]) for x in r.dangling(m, g).collect()}
    assert ("src", 5) in found and r.matches(g).where("V_1 = 1").isEmpty()


def test_identification_witness(spark):
    r = span(graph(0), graph(2), graph(0), {}, {})
    g, _ = Instance.of_pattern(spark, graph(1))
    assert r.identification_violations(match(r.L, g)).count() == 1 and r.matches(g).isEmpty()


def test_spo_where_dpo_is_impossible(spark):
    L = graph(2, (1, 2))
    keep = graph(1)
    for semantics, n in (("DPO", 0), ("SPO", 2)):
        r = span(keep, L, keep, {"V": {1: 2}}, {"V": {1: 1}}, semantics=semantics)
        g, _ = Instance.of_pattern(spark, graph(3, (1, 2), (2, 3), (1, 3), (2, 1)))
        m = r.matches(g, {("V", 1): 2, ("V", 2): 3})
        assert (not m.isEmpty()) == (n > 0)
    out = r.apply(g, m).to_pattern()
    assert is_isomorphic(out, graph(2, (1, 2)))


def test_spo_cascades_and_keeps_other_attributes(spark):
    w = weighted_graph()
    host = Pattern(w, {"V": [1, 2, 3, 4], "E": [1, 2, 3]}, {"src": {1: 1, 2: 2, 3: 3}, "tgt": {1: 2, 2: 3, 3: 4}}, {"weight": {1: 3, 2: 4, 3: 5}})
    one = Pattern(w, {"V": [1]})
    r = Rule(inclusion(Pattern(w), one), inclusion(Pattern(w), Pattern(w)), semantics="SPO")
    g, _ = Instance.of_pattern(spark, host)
    for v, left in ((2, [5]), (3, [3])):
        out = r.apply(g, r.matches(g, {("V", 1): v}))
        assert [x["weight"] for x in out["E"].collect()] == left


def test_sqpo_clones_a_vertex(spark):
    i = graph(2)
    r = span(i, graph(1), i, {"V": {1: 1, 2: 1}}, {"V": {1: 1, 2: 2}}, semantics="SqPO")
    assert is_isomorphic(run(spark, r, graph(3, (1, 2), (1, 3)), {("V", 1): ("V", 1)}), graph(4, (1, 3), (1, 4), (2, 3), (2, 4)))


def test_sqpo_deletes_greedily(spark):
    r = span(graph(0), graph(1), graph(0), {}, {}, semantics="SqPO")
    assert is_isomorphic(run(spark, r, graph(4, (1, 2), (3, 2), (3, 4)), {("V", 1): ("V", 3)}), graph(3, (1, 2)))


TRIANGLES = Schema(
    ("V", "E", "T"), {"src": ("E", "V"), "tgt": ("E", "V"), "d1": ("T", "E"), "d2": ("T", "E"), "d3": ("T", "E")}
)


@pytest.mark.parametrize("equations, n", [((), 4), (((("d1", "src"), ("d2", "src")), (("d1", "tgt"), ("d3", "tgt")), (("d2", "tgt"), ("d3", "src"))), 2)])
def test_sqpo_path_equations(spark, equations, n):
    s = TRIANGLES.extend(eqs=equations)
    host = Pattern(s, {"V": [1, 2, 3], "E": [1, 2, 3], "T": [1]}, {"src": {1: 1, 2: 1, 3: 2}, "tgt": {1: 3, 2: 2, 3: 3}, "d1": {1: 1}, "d2": {1: 2}, "d3": {1: 3}})
    two, one = Pattern(s, {"V": [1, 2]}), Pattern(s, {"V": [1]})
    r = Rule(Morphism(two, one, {"V": {1: 1, 2: 1}}), Morphism(two, two, {"V": {1: 1, 2: 2}}), semantics="SqPO")
    g, _ = Instance.of_pattern(spark, host)
    assert r.apply(g, r.matches(g, {("V", 1): 1})).nparts("T") == n


def test_coneg_keeps_what_is_referred_to(spark):
    host = graph(3, (1, 2))
    R = graph(1, (1, 1))
    r = span(graph(0), graph(2), R, {}, {}, semantics="CoNeg")
    out = run(spark, r, host, {("V", 1): ("V", 1), ("V", 2): ("V", 3)})
    assert is_isomorphic(out, graph(3, (1, 2), (3, 3)))


def test_expression_adds_weights_of_merged_edges(spark):
    w = weighted_graph()
    host = Pattern(w, {"V": [1], "E": [1, 2, 3]}, {"src": {1: 1, 2: 1, 3: 1}, "tgt": {1: 1, 2: 1, 3: 1}}, {"weight": {1: 10, 2: 20, 3: 100}})
    two = {"src": {1: 1, 2: 1}, "tgt": {1: 2, 2: 2}}
    L = Pattern(w, {"V": [1, 2], "E": [1, 2]}, two, {"weight": {1: Var("a"), 2: Var("b")}})
    R = Pattern(w, {"V": [1, 2], "E": [1]}, {"src": {1: 1}, "tgt": {1: 2}}, {"weight": {1: Var("sum")}})
    i = Pattern(w, {"V": [1, 2]})
    r = Rule(inclusion(i, L), inclusion(i, R), monic=["E"], exprs={"sum": lambda v: v["a"] + v["b"]})
    g, _ = Instance.of_pattern(spark, host)
    out = r.apply(g, r.matches(g, {("E", 1): 1, ("E", 2): 2}))
    assert sorted(x["weight"] for x in out["E"].collect()) == [30, 100]
    with pytest.raises(ValueError):
        Rule(inclusion(i, L), inclusion(i, R))


def test_merge_rule_contracts_and_rewires(spark):
    r = span(graph(2), graph(2), graph(1), {"V": {1: 1, 2: 2}}, {"V": {1: 1, 2: 1}})
    out = run(spark, r, graph(3, (1, 2), (2, 3)), {("V", 1): ("V", 1), ("V", 2): ("V", 2)})
    assert is_isomorphic(out, graph(2, (1, 1), (1, 2)))


def test_merge_of_edges_merges_their_ends(spark):
    g, _ = Instance.of_pattern(spark, graph(4, (1, 2), (3, 4)))
    out = A.merge(g, {"E": spark.createDataFrame([(1, 2)], "a long, b long")})
    assert is_isomorphic(out.to_pattern(), graph(2, (1, 2)))


def test_path_contraction_dpo_and_spo_counts(spark):
    host = graph(5, (1, 2), (2, 3), (3, 4), (4, 5))
    L, i, R = graph(2, (1, 2)), graph(1), graph(1, (1, 1))
    g, _ = Instance.of_pattern(spark, host)
    counts = {}
    for s in ("DPO", "SPO"):
        counts[s] = span(i, L, R, {"V": {1: 1}}, {"V": {1: 1}}, semantics=s).matches(g).count()
    assert counts == {"DPO": 1, "SPO": 4}


def test_conditions(spark):
    two, four = graph(1, (1, 1), (1, 1)), graph(1, *[(1, 1)] * 4)
    hosts = Pattern(GRAPH, {"V": [1, 2, 3], "E": list(range(1, 10))}, {"src": {i: 1 if i < 3 else 2 if i < 6 else 3 for i in range(1, 10)}, "tgt": {i: 1 if i < 3 else 2 if i < 6 else 3 for i in range(1, 10)}})
    g, _ = Instance.of_pattern(spark, hosts)
    one = graph(1)
    m = match(one, g)
    at = lambda p: Morphism(one, p, {"V": {1: 1}})
    c = Exists(at(two), monic=["E"]) & nac(at(four), monic=["E"])
    assert sorted(x["V_1"] for x in c.holds(m, g).collect()) == [1, 2]
    assert (c | Const(True)).holds(m, g).count() == 3 and Const(False).holds(m, g).isEmpty()


def test_lift_condition(spark):
    """Vertices all of whose out-edges end in a vertex with a loop."""
    g, _ = Instance.of_pattern(spark, graph(3, (1, 2), (2, 2), (3, 1)))
    one, edge = graph(1), graph(2, (1, 2))
    looped = graph(2, (1, 2), (2, 2))
    c = lift(Morphism(one, edge, {"V": {1: 1}}), Morphism(edge, looped, {"V": {1: 1, 2: 2}, "E": {1: 1}}))
    assert sorted(x["V_1"] for x in c.holds(match(one, g), g).collect()) == [1, 2]


@pytest.mark.parametrize("p", [graph(3, (1, 2), (2, 3), (3, 1)), graph(2, (1, 2), (1, 2)), graph(3, (1, 2)), graph(1, (1, 1)), graph(3, (1, 2), (1, 3))])
@pytest.mark.parametrize("monic", [(), True, ["E"]])
def test_matches_equal_backtracking(spark, p, monic):
    host = graph(4, (1, 2), (2, 3), (3, 1), (1, 1), (1, 2), (4, 1), (3, 4))
    g, ids = Instance.of_pattern(spark, host)
    cols = [f"{o}_{k}" for o, k in p.elements()]
    got = sorted(tuple(r[c] for c in cols) for r in match(p, g, monic).collect())
    assert got == sorted(tuple(ids[(o, m(o, k))] for o, k in p.elements()) for m in homs(p, host, monic))


def test_exhaust_and_independent(spark):
    r = span(graph(1), graph(2, (1, 2)), graph(1), {"V": {1: 1}}, {"V": {1: 1}}, semantics="SPO", monic=["V"])
    g, _ = Instance.of_pattern(spark, graph(4, (1, 2), (2, 3), (3, 4)))
    assert r.independent(r.matches(g)).count() >= 1
    assert r.exhaust(g).nparts("E") == 0


def test_subobject_algebra(spark):
    g, _ = Instance.of_pattern(spark, graph(3, (1, 2), (2, 3)))
    a = A.subobject(g, {"V": spark.createDataFrame([(1,), (2,)], "id long"), "E": spark.createDataFrame([(1,)], "id long")})
    ids = lambda s: {o: sorted(r["id"] for r in d.collect()) for o, d in s.items()}
    assert ids(A.negate(g, a)) == {"V": [3], "E": []}
    assert ids(A.conegate(g, a)) == {"V": [2, 3], "E": [2]}
    assert ids(A.cascade(g, A.minus(A.full(g), A.subobject(g, {"V": spark.createDataFrame([(3,)], "id long")})))) == {"V": [1, 2], "E": [1]}


def test_cyclic_schema(spark):
    s = Schema(("X",), {"f": ("X", "X")})
    host = Pattern(s, {"X": [1, 2, 3, 4]}, {"f": {1: 2, 2: 3, 3: 3, 4: 1}})
    g, _ = Instance.of_pattern(spark, host)
    gone = A.subobject(g, {"X": spark.createDataFrame([(2,)], "id long")})
    assert sorted(r["id"] for r in A.cascade(g, A.minus(A.full(g), gone))["X"].collect()) == [3]
    with pytest.raises(ValueError):
        one = Pattern(s, {"X": [1]}, {"f": {1: 1}})
        r = Rule(inclusion(one, one), inclusion(one, one), semantics="SqPO")
        r.apply(g, r.matches(g))
