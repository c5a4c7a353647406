from hypothesis import given, settings
from hypothesis import strategies as st

from loomgraph.pattern import (
    Morphism, Pattern, Var, coproduct, homs, identity, inclusion, is_isomorphic, is_pullback, product_pattern, pullback, pushout, quotient, quotients, signature,
    subobject_classifier, terminal,
)
from loomgraph.schema import GRAPH, Schema, weighted_graph


def graph(n, *edges):
    return Pattern(GRAPH, {"V": list(range(1, n + 1)), "E": list(range(1, len(edges) + 1))}, {"src": {i: a for i, (a, _) in enumerate(edges, 1)}, "tgt": {i: b for i, (_, b) in enumerate(edges, 1)}})


def test_schema_checks_and_order():
    assert GRAPH.topological() == ["V", "E"] and not GRAPH.is_cyclic()
    assert Schema(("X",), {"f": ("X", "X")}).is_cyclic()


def test_missing_keys_are_filled_with_fresh_elements():
    p = Pattern(GRAPH, {"E": ["e"]})
    assert p.nparts("V") == 2 and len(p.filled) == 2


def test_hom_counts():
    loop, edge, path = graph(1, (1, 1)), graph(2, (1, 2)), graph(3, (1, 2), (2, 3))
    assert len(list(homs(edge, path))) == 2
    assert len(list(homs(path, loop))) == 1 and not list(homs(path, loop, monic=True))
    assert len(list(homs(graph(2), graph(3)))) == 9 and len(list(homs(graph(2), graph(3), monic=True))) == 6
    assert len(list(homs(edge, path, take=1))) == 1


def test_variables_force_equality():
    w = weighted_graph()
    g = Pattern(w, {"V": [1], "E": [1, 2, 3]}, {"src": {1: 1, 2: 1, 3: 1}, "tgt": {1: 1, 2: 1, 3: 1}}, {"weight": {1: 5, 2: 5, 3: 6}})
    p = Pattern(w, {"V": [1], "E": [1, 2]}, {"src": {1: 1, 2: 1}, "tgt": {1: 1, 2: 1}}, {"weight": {1: Var("x"), 2: Var("x")}})
    assert len(list(homs(p, g, monic=["E"]))) == 2


def test_subobjects_of_paths():
    assert len(list(graph(2, (1, 2)).subobjects())) == 5
    assert len(list(graph(3, (1, 2), (2, 3)).subobjects())) == 13


def test_subobjects_match_classifier():
    for g in (graph(2, (1, 2)), graph(3, (1, 2), (2, 3)), graph(1, (1, 1))):
        assert len(list(homs(g, subobject_classifier(GRAPH)))) == len(list(g.subobjects()))


def test_pushout_glues_a_triangle():
    path, edge, two = graph(3, (1, 2), (2, 3)), graph(2, (1, 2)), graph(2)
    f = Morphism(two, path, {"V": {1: 1, 2: 3}})
    g = Morphism(two, edge, {"V": {1: 1, 2: 2}})
    a, b = pushout(f, g)
    assert is_isomorphic(a.cod, graph(3, (1, 2), (2, 3), (1, 3)))


def test_pullback_and_check():
    edge, loop = graph(2, (1, 2)), graph(1, (1, 1))
    to = Morphism(edge, loop, {"V": {1: 1, 2: 1}, "E": {1: 1}})
    p, q = pullback(to, to)
    assert p.dom.nparts("V") == 4 and p.dom.nparts("E") == 1 and is_pullback(to, to, p, q)
    assert not is_pullback(to, to, identity(edge), identity(edge))
    assert product_pattern(edge, edge).nparts("V") == 4 and terminal(GRAPH).nparts("E") == 1


def test_quotient_closes_over_keys_and_values():
    w = weighted_graph()
    g = Pattern(w, {"V": [1, 2, 3, 4], "E": [1, 2]}, {"src": {1: 1, 2: 3}, "tgt": {1: 2, 2: 4}}, {"weight": {1: Var("a"), 2: 7}})
    q = quotient(g, [(("E", 1), ("E", 2))])
    assert q.cod.nparts("V") == 2 and list(q.cod.attrs["weight"].values()) == [7]


def test_quotients_of_two_points():
    assert len(quotients(graph(2))) == 2 and len(quotients(graph(3))) == 5


def test_components_and_coproduct():
    whole, _ = coproduct(graph(2, (1, 2)), graph(1))
    assert sorted(c.nparts("V") for c in whole.components()) == [1, 2]


def test_morphism_laws():
    path = graph(3, (1, 2), (2, 3))
    m = Morphism(graph(2, (1, 2)), path, {"V": {1: 2, 2: 1}, "E": {1: 1}})
    assert m.failures() and not m.is_natural()
    assert inclusion(path.restrict({("V", 1)}), path).is_natural()


@settings(max_examples=30, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 3), st.integers(1, 3)), max_size=4), st.permutations([1, 2, 3]))
def test_renaming_keeps_isomorphism_and_signature(edges, perm):
    a = graph(3, *edges)
    b = graph(3, *[(perm[x - 1], perm[y - 1]) for x, y in edges])
    assert is_isomorphic(a, b) and signature(a) == signature(b)
