"""Work that follows the input: few candidates where an element need only exist, large groups in pieces, narrow numbering."""

from itertools import product

from loomgraph.instance import Instance
from loomgraph.operators.match import match
from loomgraph.pattern import Pattern
from loomgraph.schema import Schema

S = Schema(("N", "C", "P"), {"c": ("C", "N"), "s": ("P", "N")})


def _shop(spark, customers, suppliers, nations=3):
    """Rows of two tables over nations, given as lists of nations."""
    table = lambda rows, h: spark.createDataFrame(list(enumerate(rows)), f"id long, {h} long")
    return Instance(S, {"N": spark.range(nations), "C": table(customers, "c"), "P": table(suppliers, "s")})


def _pattern(suppliers):
    return Pattern(S, {"C": ["c"], "P": suppliers, "N": ["n"]}, {"c": {"c": "n"}, "s": dict.fromkeys(suppliers, "n")})


def test_kept_elements_are_those_of_all_matches_once(spark):
    g = _shop(spark, [0, 1, 1, 2, None], [0, 1, 1, 2, 2, 2, None])
    for names, monic, keep in product((["s"], ["s", "t"], ["s", "t", "u"]), ((), ["P"]), ({("C", "c")}, {("C", "c"), ("N", "n")}, {("C", "c"), ("P", "s")})):
        p = _pattern(names)
        columns = sorted(f"{o}_{k}" for o, k in keep)
        want = {tuple(r[c] for c in columns) for r in match(p, g, monic).collect()}
        got = [tuple(r[c] for c in columns) for r in match(p, g, monic, keep=keep).collect()]
        assert len(got) == len(set(got)) and set(got) == want, (names, monic, keep)


def test_elements_that_need_only_exist_make_no_pairs(spark):
    """Three different suppliers of one nation for each of its customers: 8e12 matches, 2,000 customers."""
    g = _shop(spark, [0] * 2000, [0] * 2000)
    assert match(_pattern(["s", "t", "u"]), g, ["P"], g["C"].selectExpr("id as C_c"), keep={("C", "c")}).count() == 2000


def test_numbering_moves_rows_once(spark):
    from loomgraph.functions.ids import number_rows

    rows = [(a, b) for a in (None, 5, 1, 3, 1, None, 5, 2, 4, 0) for b in (2, None, 1, 1)]
    df = number_rows(spark.createDataFrame(rows, "a long, b long").repartition(7), ["a", "b"], "k")
    got = sorted(((r["k"], r["a"], r["b"]) for r in df.collect()), key=lambda r: r[0])
    low = lambda r: tuple((x is not None, x or 0) for x in r)
    assert [r[0] for r in got] == list(range(len(rows))) and [r[1:] for r in got] == sorted(rows, key=low)
    plan = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "simple")
    assert "row_number" not in plan, "ranges would be gathered and sorted again"


def test_asking_about_one_key_reads_no_other_table(spark):
    from loomgraph.instance import Deferred

    def unread():
        raise AssertionError("read")

    g = Instance(S, {**_shop(spark, [0, 7, None], []).tables._held, "P": Deferred(unread)})
    assert sorted(r["id"] for r in g.dangling(["c"]).collect()) == [1, 2]


def test_pullback_numbers_pairs_without_storing_them(spark):
    from loomgraph.operators import algebra as A

    dot = Schema(("X",))
    left, right = [(5, 1), (2, 1), (9, 2), (4, None), (7, 3)], [(8, 1), (3, 1), (6, 2), (1, None), (0, 4)]
    table = lambda rows: spark.createDataFrame(rows, "src long, tgt long")
    own = lambda rows: Instance(dot, {"X": table(rows).selectExpr("src as id")})
    df = A.pullback({"X": table(left)}, {"X": table(right)}, own(left), own(right))["X"]
    want = sorted((a, b) for a, x in left for b, y in right if x is not None and x == y)
    assert sorted((r["id"], r["left"], r["right"]) for r in df.collect()) == [(i, a, b) for i, (a, b) in enumerate(want)]
    # the pairs are made by the plan's last join; what is stored before are rows of the sides
    big = [(i, 0) for i in range(6000)]
    before = A.pullback({"X": table(big)}, {"X": table(big)}, own(big), own(big))["X"]
    assert before.selectExpr("count(*)", "count(distinct id % 65537)", "max(id)").first()[:] == (36_000_000, 65537, 35_999_999)
    assert "ExistingRDD" in (plan := spark._jvm.PythonSQLUtils.explainString(before._jdf.queryExecution(), "simple")) and "SortMergeJoin" in plan


def test_spread_matches_are_the_same_and_large_groups_are_dealt(spark, monkeypatch):
    from loomgraph.functions import ids

    monkeypatch.setattr(ids, "TILE", 3)
    g = _shop(spark, [0] * 11 + [1, 1, 2, None], [0] * 7 + [1] * 8 + [2, None])
    p = _pattern(["s", "t"])
    rows = lambda **how: sorted(map(tuple, match(p, g, ["P"], **how).select("C_c", "N_n", "P_s", "P_t").collect()))
    assert rows(spread=True) == rows() and len(rows()) == 11 * 42 + 2 * 56


def test_cloning_moves_only_what_has_copies_beside_it(spark):
    from loomgraph.operators.rewrite import Rule
    from loomgraph.pattern import Morphism, identity

    g = _shop(spark, [0, 1, 1, 2], [1, 2])
    L, two = Pattern(S, {"N": ["x"]}), Pattern(S, {"N": ["x", "y"]})
    r = Rule(Morphism(two, L, {"N": {"x": "x", "y": "x"}}), identity(two), semantics="SqPO")
    h, _ = r.apply_with_maps(g, r.matches(g, {("N", "x"): 1}))
    assert sorted(x["origin"] for x in h["C"].collect()) == [0, 1, 1, 2, 2, 3] and h["C"].select("id").distinct().count() == 6
    assert {(x["origin"], x["c"]) for x in h["C"].collect()} == {(0, 0), (1, 1), (1, 3), (2, 1), (2, 3), (3, 2)}
    # rows that have one copy are read as they were stored: no smallest tag is looked up for them
    plan = spark._jvm.PythonSQLUtils.explainString(h["C"]._jdf.queryExecution(), "simple")
    assert "Union" in plan


def test_conditions_are_told_by_the_columns_that_tie_their_extensions(spark):
    from loomgraph.operators.constraints import Exists, lift
    from loomgraph.pattern import Morphism

    g = _shop(spark, [0, 0, 1, 2], [1, 1, 2])
    base, more, two = Pattern(S, {"C": ["c"], "N": ["n"]}, {"c": {"c": "n"}}), _pattern(["s"]), _pattern(["s", "t"])
    same = lambda p: {o: {k: k for k in ks} for o, ks in p.parts.items()}
    rows = match(base, g)
    f = Morphism(base, more, same(base))
    found, true = Exists(f).witness(rows, g)
    assert true and found.columns == ["N_n"] and sorted(r[0] for r in found.collect()) == [1, 2]
    assert sorted(r["C_c"] for r in Exists(f).holds(rows, g).collect()) == [2, 3]
    assert sorted(r["C_c"] for r in (~Exists(f)).holds(rows, g).collect()) == [0, 1]
    assert sorted(r["C_c"] for r in lift(f, Morphism(more, two, same(more)), monic_exists=["P"]).holds(rows, g).collect()) == [0, 1, 2]


def test_cascades_look_through_a_tables_rows_once(spark):
    from loomgraph.operators import algebra as A

    g = _shop(spark, [0, 1, 1, 2, None, 7], [0, 1, 2, None, 9])
    ids = lambda df: sorted(r["id"] for r in df.collect())
    keep = {**A.full(g), "N": g["N"].where("id <> 1"), "P": g["P"].where("id <> 2").select("id")}
    sub = A.cascade(g, keep)
    # what refers to no row, or to nothing, stays
    assert {o: ids(sub[o]) for o in sub} == {"N": [0, 2], "C": [0, 3, 4, 5], "P": [0, 3, 4]}
    h = A.restrict(g, sub)
    assert {o: ids(h[o]) for o in sub} == {o: ids(sub[o]) for o in sub} and h["C"].columns == g["C"].columns
    plan = spark._jvm.PythonSQLUtils.explainString(A.cascade(g, keep)["C"]._jdf.queryExecution(), "simple")
    # nothing is taken from C itself: its rows are joined with the nations that go (two joins tell them), and with nothing else
    assert plan.count("Join") == 3 and "REPARTITION_BY_NUM" in plan, plan
    assert A.minus(A.full(g), A.none(g))["C"].sameSemantics(g.parts("C"))
    assert A.minus(A.full(g), A.full(g))["C"].isEmpty()


def test_what_whole_tables_refer_to_is_told_without_joins(spark):
    from loomgraph.operators import algebra as A

    g = _shop(spark, [0, 1, 1], [0, 3], nations=5)
    ids = lambda df: sorted(r["id"] for r in df.collect())
    gone = A.subobject(g, {"N": spark.createDataFrame([(1,), (2,), (1,)], "id long")})
    some = A.subobject(g, {"C": spark.createDataFrame([(2,)], "id long")})
    text = lambda df: spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "simple")
    left = A.conegate(g, gone)
    plan = text(left["N"])
    # the nations that stay are compared with those to go; customers and suppliers aren't with themselves
    assert plan.count("Join") == 1 and "REPARTITION_BY_NUM" in plan, plan
    assert {o: ids(left[o]) for o in left} == {"N": [0, 1, 3, 4], "C": [0, 1, 2], "P": [0, 1]}
    assert "REPARTITION_BY_NUM" in text(A.down(g, some)["N"]) and ids(A.down(g, some)["N"]) == [1]
    assert {o: ids(d) for o, d in A._deleted_closure(g, gone).items()} == {"N": [1, 2], "C": [1, 2], "P": []}
    assert ids(A.join_(gone, {**gone, "N": g.parts("N").where("id < 2")})["N"]) == [0, 1, 2]
    assert ids(A.remove(g, {"N": gone["N"]})["N"]) == [0, 3, 4]


def _bytes_a_pair(df, folder):
    df.write.option("compression", "snappy").parquet(str(folder))
    return sum(f.stat().st_size for f in folder.glob("*.parquet")) / df.sparkSession.read.parquet(str(folder)).count()


def test_joins_in_pieces_are_the_joins(spark, monkeypatch):
    from loomgraph.functions import ids

    monkeypatch.setattr(ids, "TILE", 5)
    monkeypatch.setattr(ids, "BLOCK", 2)
    # nulls as keys and beside them, equal rows, keys that one side lacks, keys of two types
    left = [(i % 11, i % 3, None if i % 4 == 0 else str(i % 5)) for i in range(40)] + [(None, 0, "x"), (1, None, "x"), (1, 1, "x"), (1, 1, "x"), (50, 0, "x")]
    right = [(i % 9, i % 3, None if i % 7 == 0 else i * 0.5) for i in range(60)] + [(None, 0, 1.0), (2, None, 1.0), (60, 0, 1.0)]
    a, b = spark.createDataFrame(left, "a int, b long, c string"), spark.createDataFrame(right, "d long, e long, f double")
    for on in ([("b", "e")], [("a", "d"), ("b", "e")], [("a", "d")]):
        at = [("abc".index(x), "def".index(y)) for x, y in on]
        want = [x + y for x in left for y in right if all(x[i] is not None and x[i] == y[j] for i, j in at)]
        got = ids.spread_join(a, b, on)
        assert got.columns == list("abcdef") and sorted(map(str, want)) == sorted(str(tuple(r)) for r in got.collect())


def test_pairs_of_a_pullback_take_little_disk(spark, tmp_path):
    """The pairs are quadratic in a key's rows: their order decides what they take when written (1.5 bytes a pair in runs of 3,001)."""
    from loomgraph.operators import algebra as A

    dot = Schema(("X",))
    side = lambda n: ({"X": spark.range(n).selectExpr("id as src", "0L as tgt")}, Instance(dot, {"X": spark.range(n)}))
    (f, a), (h, b) = side(1500), side(3001)
    assert _bytes_a_pair(A.pullback(f, h, a, b)["X"].select("left", "right"), tmp_path / "pairs") < 0.4


def test_spread_matches_take_little_disk(spark, tmp_path):
    """As those of a pullback: 1.5 bytes a pair in runs of 3,001."""
    g = _shop(spark, [0] * 1500, [0] * 3001)
    assert _bytes_a_pair(match(_pattern(["s"]), g, spread=True).select("C_c", "P_s"), tmp_path / "pairs") < 0.4
