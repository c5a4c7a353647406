"""Registered queries for the rest of the library: storage, limits and colimits, typed rules, schedules, machines, histories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from .instance import Instance
from .operators import algebra as A
from .operators.components import components
from .operators.constraints import Commutes, Const, Exists, lift, nac
from .operators.match import first, match
from .operators.migrate import Migrate, typed_pattern
from .operators.pbpo import TypedRule
from .operators.process import dependencies, step_events
from .operators.rewrite import Rule
from .pattern import Morphism, Pattern, Var, identity, inclusion
from .plans import schedule as S
from .queries import LI, _cols, _with_line, one, pattern, query
from .schema import GRAPH, Schema
from .sources.tables import STORE, read, store, write
from .streaming.incremental import MatchView


def graph(n: int, *edges: tuple[int, int]) -> Pattern:
    return Pattern(GRAPH, {"V": list(range(1, n + 1)), "E": list(range(1, len(edges) + 1))}, {"src": {i: a for i, (a, _) in enumerate(edges, 1)}, "tgt": {i: b for i, (_, b) in enumerate(edges, 1)}})


def _facts(spark: SparkSession, rows: list[tuple], names: str) -> DataFrame:
    return spark.createDataFrame(rows, names)


# -- storage


@query("select r_regionkey id, r_name from region union all select 77, 'NEW'")
def add_parts(spark, sf_dir):
    return store(spark, sf_dir).add_parts("Region", spark.createDataFrame([(77, "NEW")], "id long, r_name string"))["Region"].select("id", "r_name")


@query("select event_id from events where event_type <> 'click'")
def rem_parts(spark, sf_dir):
    g = store(spark, sf_dir)
    return g.rem_parts("Event", g["Event"].where("event_type = 'click'").select("id"))["Event"].select(F.col("id").alias("event_id"))


@query("select c_custkey, case when c_nationkey = 4 then 3 else c_nationkey end n from customer")
def set_subpart(spark, sf_dir):
    g = store(spark, sf_dir)
    patch = g["Customer"].where("c_nationkey = 4").select("id", F.lit(3).cast("long").alias("v"))
    return g.set_subpart("Customer", "c_nationkey", patch)["Customer"].select(F.col("id").alias("c_custkey"), F.col("c_nationkey").alias("n"))


@query("select o_orderkey from orders where o_custkey in (select c_custkey from customer where c_nationkey = 3)")
def incident_value(spark, sf_dir):
    g = store(spark, sf_dir)
    return g.incident("Orders", ("o_custkey",), g.incident("Customer", ("c_nationkey",), 3)).select(F.col("id").alias("o_orderkey"))


@query("select 'Region' ob, count(*) n from region union all select 'Nation', count(*) from nation union all select 'Customer', count(*) from customer union all select 'LineItem', count(*) from lineitem")
def parts_count(spark, sf_dir):
    g = store(spark, sf_dir)
    return _facts(spark, [(o, g.nparts(o)) for o in ("Region", "Nation", "Customer", "LineItem")], "ob string, n long")


@query("select n_nationkey id, n_regionkey, n_name from nation")
def json_round_trip(spark, sf_dir):
    from .functions.ids import shared_dir

    g, s = store(spark, sf_dir), Schema(("Region", "Nation"), {"n_regionkey": ("Nation", "Region")}, {"n_name": ("Nation", "string")})
    folder = f"{shared_dir(spark)}/json-{spark.sparkContext.applicationId}"
    write(Instance(s, {"Region": g["Region"].select("id"), "Nation": g["Nation"].select("id", "n_regionkey", "n_name")}), folder, "json")
    return read(spark, folder, s, "json")["Nation"].select("id", "n_regionkey", "n_name")


@query("select 2 * o_orderkey node, least(2 * min(o_orderkey) over (partition by o_custkey), 2 * o_custkey + 1) root from orders union all select 2 * o_custkey + 1, least(2 * min(o_orderkey), 2 * o_custkey + 1) from orders group by o_custkey")
def components_of_orders(spark, sf_dir):
    o = store(spark, sf_dir)["Orders"]
    return components(o.select((F.col("id") * 2).alias("a"), (F.col("o_custkey") * 2 + 1).alias("b")))


# -- matching


@query("select c_custkey, c_nationkey from customer where c_nationkey in (1, 2, 7)")
def hom_allowed(spark, sf_dir):
    p = pattern({"Customer": ["c"], "Nation": ["n"]}, {"c_nationkey": {"c": "n"}})
    return _cols(match(p, store(spark, sf_dir), allowed={("Nation", "n"): [1, 2, 7]}), c_custkey="Customer_c", c_nationkey="Nation_n")


@query("select a.r_regionkey a, b.r_regionkey b, c.r_regionkey c, d.r_regionkey d, e.r_regionkey e from region a, region b, region c, region d, region e where a.r_regionkey not in (b.r_regionkey, c.r_regionkey, d.r_regionkey, e.r_regionkey) and b.r_regionkey not in (c.r_regionkey, d.r_regionkey, e.r_regionkey) and c.r_regionkey not in (d.r_regionkey, e.r_regionkey) and d.r_regionkey <> e.r_regionkey and (select count(*) from region) = 5")
def hom_iso(spark, sf_dir):
    return _cols(match(pattern({"Region": list("abcde")}), store(spark, sf_dir), iso=["Region"]), **{x: f"Region_{x}" for x in "abcde"})


@query("select c_custkey, s_suppkey from customer, supplier where c_nationkey = s_nationkey and (c_custkey + s_suppkey) % 7 = 0")
def hom_filter(spark, sf_dir):
    p = pattern({"Customer": ["c"], "Supplier": ["s"], "Nation": ["n"]}, {"c_nationkey": {"c": "n"}, "s_nationkey": {"s": "n"}})
    return _cols(match(p, store(spark, sf_dir), where=(F.col("Customer_c") + F.col("Supplier_s")) % 7 == 0, spread=True), c_custkey="Customer_c", s_suppkey="Supplier_s")


@query("select o_orderkey, o_custkey from orders, customer where o_custkey = c_custkey and c_mktsegment = 'BUILDING' order by o_custkey, o_orderkey limit 1")
def hom_first(spark, sf_dir):
    """One match, the smallest by its columns (customers come first)."""
    p = pattern({"Customer": ["c"], "Orders": ["o"]}, {"o_custkey": {"o": "c"}}, {"c_mktsegment": {"c": "BUILDING"}})
    m = match(p, store(spark, sf_dir)).select("Customer_c", "Orders_o")
    return _cols(first(m), o_orderkey="Orders_o", o_custkey="Customer_c")


@query("select c_custkey, n from (select c_custkey, c_nationkey n from customer) where n in (select s_nationkey from supplier group by 1 having count(*) >= 2)")
def hom_several_bound(spark, sf_dir):
    """Customers with two different suppliers in their nation, from customers that are given."""
    g = store(spark, sf_dir)
    p = pattern({"Customer": ["c"], "Supplier": ["s", "t"], "Nation": ["n"]}, {"c_nationkey": {"c": "n"}, "s_nationkey": {"s": "n", "t": "n"}})
    m = match(p, g, ["Supplier"], g["Customer"].select(F.col("id").alias("Customer_c")), keep={("Customer", "c"), ("Nation", "n")})
    return _cols(m, c_custkey="Customer_c", n="Nation_n")


# -- limits and colimits


@query("select 2 * n_nationkey id, 2 * n_regionkey r from nation union all select 2 * n_nationkey + 1, 2 * n_regionkey from nation")
def pushout_glue(spark, sf_dir):
    """Two copies of nations and regions, glued along the regions."""
    g, s = store(spark, sf_dir), Schema(("Region", "Nation"), {"n_regionkey": ("Nation", "Region")})
    own = Instance(s, {"Region": g["Region"].select("id"), "Nation": g["Nation"].select("id", "n_regionkey")})
    pairs = own["Region"].select((F.col("id") * 2).alias("a"), (F.col("id") * 2 + 1).alias("b"))
    return A.merge(A.coproduct(own, own), {"Region": pairs})["Nation"].select("id", F.col("n_regionkey").alias("r"))


@query("select c_custkey id from customer where c_custkey % 2 = 0 or c_custkey - 1 not in (select c_custkey from customer)")
def coequalizer_pairs(spark, sf_dir):
    """Each odd customer becomes one with the even one before it."""
    c = store(spark, sf_dir)["Customer"].select("id")
    dot = Instance(Schema(("X",)), {"X": c})
    even = c.where("id % 2 = 0").select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    pairs = even.join(c, F.col("b") == F.col("id"), "left_semi")
    return A.merge(dot, {"X": pairs})["X"].select("id")


@query("select n_name, min(n_regionkey) r from (select case when n_nationkey in (1, 2) then 'X' when n_nationkey = 0 then null else n_name end n_name, case when n_nationkey in (0, 1, 2) then 1 else n_regionkey end n_regionkey, case when n_nationkey in (0, 1, 2) then 0 else n_nationkey end k from nation) where n_name is not null group by k, n_name")
def merge_values(spark, sf_dir):
    """Glued rows agree, a null gives way to a value."""
    g, s = store(spark, sf_dir), Schema(("N",), {}, {"name": ("N", "string"), "r": ("N", "bigint")})
    name = F.when(F.col("id").isin(1, 2), "X").when(F.col("id") == 0, None).otherwise(F.col("n_name"))
    own = Instance(s, {"N": g["Nation"].select("id", name.alias("name"), F.when(F.col("id") < 3, 1).otherwise(F.col("n_regionkey")).cast("long").alias("r"))})
    return A.merge(own, {"N": spark.createDataFrame([(0, 1), (1, 2)], "a long, b long")})["N"].select(F.col("name").alias("n_name"), "r")


@query("select 'supplier' f, (select max(c) from (select count(*) c from supplier group by s_nationkey)) <= 1 monic, not exists(select 1 from nation where n_nationkey not in (select s_nationkey from supplier)) epic union all select 'nation', (select max(c) from (select count(*) c from nation group by n_regionkey)) <= 1, not exists(select 1 from region where r_regionkey not in (select n_regionkey from nation)) union all select 'identity', true, true")
def map_properties(spark, sf_dir):
    g = store(spark, sf_dir)
    maps = {"supplier": (g["Supplier"], "s_nationkey", "Nation"), "nation": (g["Nation"], "n_regionkey", "Region"), "identity": (g["Region"], "id", "Region")}
    rows = []
    for name, (t, h, to) in maps.items():
        f = t.select(F.col("id").alias("src"), F.col(h).alias("tgt"))
        rows.append((name, A.is_monic(f), A.is_epic(f, g[to])))
    return _facts(spark, rows, "f string, monic boolean, epic boolean")


@query("select s_suppkey src, n_regionkey tgt from supplier, nation where s_nationkey = n_nationkey")
def compose_maps(spark, sf_dir):
    g = store(spark, sf_dir)
    as_map = lambda o, h: g[o].select(F.col("id").alias("src"), F.col(h).alias("tgt"))
    return A.compose(as_map("Supplier", "s_nationkey"), as_map("Nation", "n_regionkey"))


@query("select p_partkey id, p_partkey in (select l_partkey from lineitem where l_quantity = 50) hit from part")
def partition_image(spark, sf_dir):
    g = store(spark, sf_dir)
    f = g["LineItem"].where("l_quantity = 50").select(F.col("id").alias("src"), F.col("l_partkey").alias("tgt"))
    hit, miss = A.partition_image(f, g["Part"])
    return hit.withColumn("hit", F.lit(True)).union(miss.withColumn("hit", F.lit(False)))


@query("select s_suppkey id, s_nationkey from supplier")
def deattr(spark, sf_dir):
    return A.without_attrs(store(spark, sf_dir))["Supplier"]


@query("select a.n_nationkey l, b.n_nationkey r, case when a.n_name = b.n_name then a.n_name end as n from nation a, nation b where a.n_regionkey = b.n_regionkey")
def pullback_attrs(spark, sf_dir):
    """Pairs of nations of a region; a name where both have the same, else a variable (null)."""
    g, s = store(spark, sf_dir), Schema(("X",), {}, {"n": ("X", "string")})
    own = Instance(s, {"X": g["Nation"].select("id", F.col("n_name").alias("n"))})
    f = {"X": g["Nation"].select(F.col("id").alias("src"), F.col("n_regionkey").alias("tgt"))}
    return A.pullback(f, f, own, own)["X"].select(F.col("left").alias("l"), F.col("right").alias("r"), "n")


@query(f"select li from {LI} l where l_suppkey in (select s_suppkey from supplier where s_nationkey <> 3) and l_orderkey in (select o_orderkey from orders where o_orderstatus = 'F')")
def restrict_cascade(spark, sf_dir):
    """The largest sub-instance whose suppliers are not of nation 3 and whose orders are finished, copied out."""
    g = store(spark, sf_dir)
    keep = {**A.full(g), "Supplier": g["Supplier"].where("s_nationkey <> 3").select("id"), "Orders": g["Orders"].where("o_orderstatus = 'F'").select("id")}
    return A.largest(g, keep)["LineItem"].select(F.col("id").alias("li"))


@query("select n_nationkey from nation where n_nationkey <> 3 or exists(select 1 from customer where c_nationkey = 3) or exists(select 1 from supplier where s_nationkey = 3)")
def subobj_conot_whole(spark, sf_dir):
    """Co-negation over the whole instance: what anything outside refers to stays."""
    g = store(spark, sf_dir)
    return A.conegate(g, A.down(g, A.subobject(g, {"Nation": spark.createDataFrame([(3,)], "id long")})))["Nation"].select(F.col("id").alias("n_nationkey"))


# -- conditions


@query("select r_regionkey, true c from region")
def ac_const(spark, sf_dir):
    g = store(spark, sf_dir)
    m = match(one("Region"), g)
    every, no = Const(True).holds(m, g), Const(False).holds(m, g)
    return every.select(F.col("Region_x").alias("r_regionkey"), F.lit(True).alias("c")).union(no.select("Region_x", F.lit(False)))


@query("select o_orderkey from orders where (exists(select 1 from lineitem where l_orderkey = o_orderkey and l_quantity = 50) or not exists(select 1 from lineitem where l_orderkey = o_orderkey and l_returnflag = 'R')) and not (exists(select 1 from lineitem where l_orderkey = o_orderkey and l_quantity = 1) and exists(select 1 from lineitem where l_orderkey = o_orderkey and l_quantity = 2))")
def ac_nested(spark, sf_dir):
    g = store(spark, sf_dir)
    has = lambda **a: Exists(_with_line(**a))
    c = (has(l_quantity=50.0) | ~has(l_returnflag="R")) & ~(has(l_quantity=1.0) & has(l_quantity=2.0))
    return _cols(c.holds(match(one("Orders"), g), g), o_orderkey="Orders_x")


@query(f"select o_orderkey from orders where o_orderkey not in (select a.l_orderkey from {LI} a where not exists(select 1 from {LI} b where b.l_orderkey = a.l_orderkey and b.l_returnflag = a.l_returnflag and b.li <> a.li))")
def lift_monic(spark, sf_dir):
    """Orders all of whose lines have another one with the same flag."""
    g, f = store(spark, sf_dir), _with_line(l_returnflag=Var("flag"))
    n = f.cod
    more = pattern({**n.parts, "LineItem": ["l", "w"]}, {**n.homs, "l_orderkey": {"l": "x", "w": "x"}}, {"l_returnflag": {"l": Var("flag"), "w": Var("flag")}})
    h = Morphism(n, more, {ob: {k: k for k in ks} for ob, ks in n.parts.items()})
    return _cols(lift(f, h, monic_exists=["LineItem"]).holds(match(f.dom, g), g), o_orderkey="Orders_x")


@query(f"select li from {LI} l, orders, customer, supplier where l_orderkey = o_orderkey and o_custkey = c_custkey and l_suppkey = s_suppkey and c_nationkey = s_nationkey")
def commutes_paths(spark, sf_dir):
    g = store(spark, sf_dir)
    rows = g["LineItem"].select(F.col("id").alias("LineItem_l"))
    c = Commutes([(("LineItem_l", "l_suppkey", "s_nationkey"), ("LineItem_l", "l_orderkey", "o_custkey", "c_nationkey"))], {"LineItem_l": "LineItem"})
    return _cols(c.holds(rows, g), li="LineItem_l")


@query("select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_orderstatus = 'P')")
def migrate_rule(spark, sf_dir):
    """A rule over owners and items, with its negative condition, read as one over customers and orders."""
    s = Schema(("Item", "Owner"), {"owner": ("Item", "Owner")}, {"label": ("Item", "string")})
    alone, held = Pattern(s, {"Owner": ["x"]}), Pattern(s, {"Owner": ["x"], "Item": ["i"]}, {"owner": {"i": "x"}}, {"label": {"i": "P"}})
    r = Rule(identity(alone), identity(alone), conditions=[nac(inclusion(alone, held))])
    to = Migrate(s, Schema(("Orders", "Customer"), {"o_custkey": ("Orders", "Customer")}, {"o_orderstatus": ("Orders", "string")}), {"Item": "Orders", "Owner": "Customer"}, {"owner": "o_custkey", "label": "o_orderstatus"})
    return _cols(to.rule(r).matches(store(spark, sf_dir)), c_custkey="Customer_x")


# -- rules


@query("select r_regionkey x, 'Region_y' element, 'Region_x' other from region")
def identification(spark, sf_dir):
    """Matches that identify a deleted region with the kept one."""
    p, keep = pattern({"Region": ["x", "y"]}), pattern({"Region": ["x"]})
    r = Rule(inclusion(keep, p), identity(keep))
    return r.identification_violations(match(p, store(spark, sf_dir))).select(F.col("Region_x").alias("x"), "element", "other")


@query("select li, row_number() over (partition by li order by i, j) - 1 k from " + LI + " l, (select o_orderkey, i from orders, customer, (select 0 i union all select 1) where o_custkey = c_custkey and (c_nationkey = 3 or i = 0)) o, (select s_suppkey, j from supplier, (select 0 j union all select 1) where s_nationkey = 3 or j = 0) p where l_orderkey = o_orderkey and l_suppkey = s_suppkey")
def sqpo_clone_lines(spark, sf_dir):
    """Cloning a nation clones its customers and suppliers, their orders, and lines for each choice of both: line by line."""
    g, L = store(spark, sf_dir), one("Nation")
    region = next(k for k in L.parts["Region"])
    two = Pattern(STORE, {"Nation": ["x", "y"], "Region": [region]}, {"n_regionkey": {"x": region, "y": region}})
    r = Rule(Morphism(two, L, {"Nation": {"x": "x", "y": "x"}, "Region": {region: region}}), identity(two), semantics="SqPO")
    h, _ = r.apply_with_maps(g, r.matches(g, {("Nation", "x"): 3}))
    k = F.row_number().over(Window.partitionBy("origin").orderBy("id")) - 1
    return h["LineItem"].select(F.col("origin").alias("li"), k.cast("long").alias("k"))


@query("select o_orderkey, cast(round(2 * v + 1) as bigint) v from (select l_orderkey o_orderkey, sum(l_quantity) v from lineitem where l_returnflag = 'A' group by 1 having count(*) = 1)")
def expr_arithmetic(spark, sf_dir):
    """An order with exactly one line flagged A gets a line with twice its quantity and one more."""
    from .operators.constraints import ExistsUnique

    g, f = store(spark, sf_dir), _with_line(l_returnflag="A")
    n = pattern(f.cod.parts, f.cod.homs, {"l_returnflag": {"l": "A"}, "l_quantity": {"l": Var("q")}})
    n.filled = set(f.cod.filled)
    same = {o: {k: k for k in ks} for o, ks in n.parts.items()}
    keys = {h: {**m, "z": m["l"]} if h in ("l_orderkey", "l_partkey", "l_suppkey") else m for h, m in n.homs.items()}
    more = pattern({**n.parts, "LineItem": ["l", "z"]}, keys, {"l_returnflag": {"z": "X"}, "l_quantity": {"z": Var("more")}, "l_linestatus": {"z": "N"}})
    r = Rule(Morphism(n.abstract(), n, same), Morphism(n.abstract(), more, same), exprs={"more": lambda v: v["q"] * 2 + 1})
    m = ExistsUnique(f).holds(match(f.dom, g), g).select("Orders_x")
    return r.apply(g, r.matches(g, m))["LineItem"].where("l_returnflag = 'X'").select(F.col("l_orderkey").alias("o_orderkey"), F.round("l_quantity").cast("long").alias("v"))


def _nation_graph(spark, sf_dir) -> Instance:
    """Nations as vertices, with an edge from each to the next."""
    n = store(spark, sf_dir)["Nation"].select("id")
    last = n.agg(F.max("id")).first()[0]
    return Instance(GRAPH, {"V": n, "E": n.where(F.col("id") < last).select("id", F.col("id").alias("src"), (F.col("id") + 1).alias("tgt"))})


@query("select n_nationkey id, case when n_nationkey = 8 then 7 else n_nationkey end src, case when n_nationkey + 1 = 8 then 7 else n_nationkey + 1 end tgt from nation where n_nationkey < (select max(n_nationkey) from nation)")
def merge_rule(spark, sf_dir):
    """A rule that makes one vertex of the two ends of an edge, applied to the edge 7."""
    edge, loop = graph(2, (1, 2)), graph(1, (1, 1))
    r = Rule(identity(edge), Morphism(edge, loop, {"V": {1: 1, 2: 1}, "E": {1: 1}}))
    g = _nation_graph(spark, sf_dir)
    return r.apply(g, r.matches(g, {("E", 1): 7}))["E"].select("id", "src", "tgt")


@query("select event_id, k from events join (select 'purchase' t,0 k union all select 'purchase',1 union all select 'view',0 union all select 'click',0 union all select 'signup',0) y on event_type=t", "pbpo_typed")
def pbpo_typed(spark, sf_dir):
    """Rows typed by their event type; a type with two copies doubles them, one with none deletes them."""
    s = Schema(("Event",), {}, {"origin": ("Event", "bigint")})
    events = store(spark, sf_dir)["Event"]
    g = Instance(s, {"Event": events.select("id", F.col("id").alias("origin"))})
    dots = lambda *keys: Pattern(s, {"Event": list(keys)})
    types, copies, none = dots("purchase", "view", "click", "signup", "error"), dots("purchase0", "purchase1", "view0", "click0", "signup0"), dots()
    rule = TypedRule(
        identity(none), identity(none), Morphism(none, types, {}), Morphism(none, copies, {}), Morphism(copies, types, {"Event": {k: k[:-1] for k in copies.parts["Event"]}}),
        adherence=lambda *_: {"Event": events.select("id", F.col("event_type").alias("type"))},
    )
    m = rule.matches(g)
    out = rule.apply(g, m, rule.typing(g, m))["Event"]
    k = F.row_number().over(Window.partitionBy("origin").orderBy("id")) - 1
    return out.select(F.col("origin").alias("event_id"), k.cast("int").alias("k"))


@query("select c_custkey a, cast(floor(c_acctbal * 2 + 5) as bigint) v from customer where c_nationkey = 3")
def pbpo_values(spark, sf_dir):
    """Typed copies with an expression over the old value and one that the match binds: twice the balance and a bound number more."""
    s = Schema(("C", "R"), {}, {"bal": ("C", "double"), "add": ("R", "double"), "ck": ("C", "bigint")})
    g0 = store(spark, sf_dir)
    g = Instance(s, {"C": g0["Customer"].where("c_nationkey = 3").select("id", F.col("c_acctbal").alias("bal"), F.col("id").alias("ck")), "R": spark.createDataFrame([(0, 5.0)], "id long, add double")})
    L = Pattern(s, {"R": ["r"]}, attrs={"add": {"r": Var("more")}})
    K, types = L.abstract(), Pattern(s, {"R": ["r"], "C": ["c"]})
    here = {"R": {"r": "r"}}
    rule = TypedRule(Morphism(K, L, here), identity(K), Morphism(L, types, here), Morphism(K, types, here), identity(types), k_exprs={("bal", "c"): lambda v, bound: v * 2 + bound["more"]})
    m = rule.matches(g)
    return rule.apply(g, m, rule.typing(g, m))["C"].select(F.col("ck").alias("a"), F.floor("bal").cast("long").alias("v"))


@query("select a.c_custkey a, b.c_custkey b from customer a, customer b where a.c_nationkey=b.c_nationkey and a.c_mktsegment='BUILDING' and b.c_mktsegment='MACHINERY'", "slice_hom")
def slice_hom(spark, sf_dir):
    """Customers typed by segment: pairs in a nation with fixed types, through the slice over the segments."""
    s, g = Schema(("Customer", "Nation"), {"c_nationkey": ("Customer", "Nation")}), store(spark, sf_dir)
    segments = [r[0] for r in g["Customer"].select("c_mktsegment").distinct().orderBy("c_mktsegment").collect()]  # five of them
    base = Pattern(s, {"Customer": segments, "Nation": ["any"]}, {"c_nationkey": dict.fromkeys(segments, "any")})
    ids = {**{("Customer", x): i for i, x in enumerate(segments)}, ("Nation", "any"): 0}
    kind = F.element_at(F.create_map(*[y for x in segments for y in (F.lit(x), F.lit(ids[("Customer", x)]).cast("long"))]), F.col("c_mktsegment"))
    over = Instance(s, {"Customer": g["Customer"].select("id", "c_nationkey", kind.alias("Customer_type")), "Nation": g["Nation"].select("id", F.lit(0).cast("long").alias("Nation_type"))})
    p = Pattern(s, {"Customer": ["a", "b"], "Nation": ["n"]}, {"c_nationkey": {"a": "n", "b": "n"}})
    typed = typed_pattern(p, Morphism(p, base, {"Customer": {"a": "BUILDING", "b": "MACHINERY"}, "Nation": {"n": "any"}}), ids)
    return _cols(match(typed, Instance(typed.schema, over.tables), spread=True), a="Customer_a", b="Customer_b")


# -- open systems, schedules, machines, histories, incremental matching


def _cut_edge() -> Rule:
    return Rule(Morphism(graph(2), graph(2, (1, 2)), {"V": {1: 1, 2: 2}}), identity(graph(2)))


@query("select n_nationkey id from nation where n_nationkey >= 2 and n_nationkey < (select max(n_nationkey) from nation)")
def schedule_for(spark, sf_dir):
    """Two turns of deleting the first edge."""
    world, *_ = S.for_schedule(2, S.tryrule(S.RuleApp("cut", _cut_edge()))).run(_nation_graph(spark, sf_dir))
    return world["E"].select("id")


@query("select count(*) v, cast(0 as bigint) e from nation")
def schedule_while(spark, sf_dir):
    """Independent edges are deleted together, for as long as there is an edge."""
    body = S.tryrule(S.RuleApp("cut", _cut_edge(), everywhere=True))
    world, *_ = S.while_schedule(lambda w, _: not w["E"].isEmpty(), body).run(_nation_graph(spark, sf_dir))
    return _facts(spark, [(world.nparts("V"), world.nparts("E"))], "v long, e long")


@query("select r_regionkey v, count(*) n from region group by 1")
def schedule_agents(spark, sf_dir):
    """Each region, one after another, gets a loop."""
    g = Instance(GRAPH, {"V": store(spark, sf_dir)["Region"].select("id"), "E": spark.createDataFrame([], GRAPH.ddl("E"))})
    r = Rule(identity(graph(1)), Morphism(graph(1), graph(1, (1, 1)), {"V": {1: 1}}))
    world, *_ = S.agent(S.tryrule(S.RuleApp("loop", r, graph(1), {("V", 1): ("V", 1)})), graph(1)).run(g)
    return world["E"].where("src = tgt").groupBy(F.col("src").alias("v")).agg(F.count(F.lit(1)).alias("n"))


@query("select * from (values (0, 1), (0, 2), (1, 2), (0, 3)) t(i, j)")
def process_steps(spark, sf_dir):
    """A history of rule applications: a nation is made, a customer in it, an order of that (all of which it is in are used), and another customer in the nation."""
    g = store(spark, sf_dir)
    small = lambda *obs: STORE.__class__(tuple(obs), {h: t for h, t in STORE.homs.items() if set(t) <= set(obs)})
    s = small("Region", "Nation", "Customer", "Orders")
    g = Instance(s, {o: g[o].select("id", *s.homs_from(o)) for o in s.obs})
    chain = Pattern(s, {"Region": ["r"], "Nation": ["n"], "Customer": ["c"], "Orders": ["o"]}, {"n_regionkey": {"n": "r"}, "c_nationkey": {"c": "n"}, "o_custkey": {"o": "c"}})
    part = lambda *keys: chain.restrict({e for e in chain.elements() if e[1] in keys})
    grow = lambda a, b: Rule(identity(part(*a)), inclusion(part(*a), part(*b)))
    rules, ids, log = [grow("r", "rn"), grow("rn", "rnc"), grow("rnc", "rnco"), grow("rn", "rnc")], {}, None
    for i, r in enumerate(rules):
        at = {("Region", "r"): 0, **{e: x for e, x in ids.items() if e in r.L.elements()}}
        g, placed = r.apply_with_maps(g, r.matches(g, at))
        row = placed.first()
        for o, k in r.added():
            ids.setdefault((o, k), row[f"new_{o}_{k}"])
        e = step_events(i, r, placed)
        log = e if log is None else log.unionByName(e)
        g = g.cut()
    return dependencies(log)


@query("select a.li a,b.li b from {LI} a,{LI} b where a.l_orderkey=b.l_orderkey and a.l_partkey=b.l_partkey and a.li<>b.li and a.l_returnflag<>'R' and b.l_returnflag<>'R'".replace("{LI}", LI))
def view_after_changes(spark, sf_dir):
    """Lines come in two batches, then those flagged R are deleted; the view follows."""
    from .queries import _wedge

    g = store(spark, sf_dir)
    late = F.col("l_orderkey") % 10 == 0
    view = MatchView([_wedge()], g.replace(LineItem=g["LineItem"].where(~late)), ["LineItem"])
    view.insert({"LineItem": g["LineItem"].where(late)})
    view.delete({"LineItem": g["LineItem"].where("l_returnflag = 'R'").select("id")})
    return _cols(view.matches(), a="LineItem_a", b="LineItem_b")


@query("select 'V' ob, c_custkey id from customer where c_custkey % 2 = 1")
def spo_conflict(spark, sf_dir):
    """Customers as vertices; each even one is matched as kept and as deleted: deletion wins, also over the loop that is added to it."""
    g = Instance(GRAPH, {"V": store(spark, sf_dir)["Customer"].select("id"), "E": spark.createDataFrame([], GRAPH.ddl("E"))})
    r = Rule(Morphism(graph(1), graph(2), {"V": {1: 1}}), Morphism(graph(1), graph(1, (1, 1)), {"V": {1: 1}}), semantics="SPO")
    even = g["V"].where("id % 2 = 0").select(F.col("id").alias("V_1"), F.col("id").alias("V_2"))
    h = r.apply(g, r.candidates(g, even, monic=()))
    return h["V"].select(F.lit("V").alias("ob"), "id").union(h["E"].select(F.lit("E"), "id"))


@query("select 'DPO' s, max(n_nationkey) - 1 e from nation union all select 'SPO', n_nationkey from nation where n_nationkey < (select max(n_nationkey) from nation)")
def dpo_and_spo_matches(spark, sf_dir):
    """Contracting the end of an edge of the nations' path: at the last one alone without dangling edges, at all with cascades."""
    g = _nation_graph(spark, sf_dir)
    span = lambda s: Rule(Morphism(graph(1), graph(2, (1, 2)), {"V": {1: 1}}), Morphism(graph(1), graph(1, (1, 1)), {"V": {1: 1}}), semantics=s)
    found = {s: span(s).matches(g).select(F.lit(s).alias("s"), F.col("E_1").alias("e")) for s in ("DPO", "SPO")}
    return found["DPO"].union(found["SPO"])


@query("with c as (select c_custkey id, c_custkey // 12 x, c_custkey % 12 y, c_custkey * 7 % 5 < 2 live from customer), n as (select c.id, c.live, count(*) filter (where d.live) k from c left join c d on abs(c.x - d.x) <= 1 and abs(c.y - d.y) <= 1 and c.id <> d.id group by 1, 2) select id from n where k = 3 or (live and k = 2)")
def game_of_life(spark, sf_dir):
    """A generation on a board of customers, twelve a row: who lives next is asked by conditions on numbers of living neighbours."""
    s = Schema(("Cell", "Near", "Live"), {"of": ("Near", "Cell"), "to": ("Near", "Cell"), "at": ("Live", "Cell")})
    cells = store(spark, sf_dir)["Customer"].select("id")
    steps = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b])
    near = cells.select("id", F.posexplode(steps).alias("k", "d")).where((F.col("id") % 12 + F.col("d.b")).between(0, 11)).select((F.col("id") * 8 + F.col("k")).alias("n"), F.col("id").alias("of"), (F.col("id") + F.col("d.a") * 12 + F.col("d.b")).alias("to"))
    near = near.join(cells, F.col("to") == F.col("id"), "left_semi").withColumnRenamed("n", "id")
    g = Instance(s, {"Cell": cells, "Near": near, "Live": cells.where("id * 7 % 5 < 2").select("id", F.col("id").alias("at"))}).cut()
    cell = Pattern(s, {"Cell": ["c"]})

    def neighbours(k: int) -> Exists:
        """At least ``k`` different living neighbours."""
        ks = range(k)
        big = Pattern(s, {"Cell": ["c", *[f"d{i}" for i in ks]], "Near": [f"n{i}" for i in ks], "Live": [f"l{i}" for i in ks]}, {"of": {f"n{i}": "c" for i in ks}, "to": {f"n{i}": f"d{i}" for i in ks}, "at": {f"l{i}": f"d{i}" for i in ks}})
        return Exists(Morphism(cell, big, {"Cell": {"c": "c"}}), monic=["Near"])

    lives = Exists(Morphism(cell, Pattern(s, {"Cell": ["c"], "Live": ["l"]}, {"at": {"l": "c"}}), {"Cell": {"c": "c"}}))
    next_ = (neighbours(3) & ~neighbours(4)) | (lives & neighbours(2) & ~neighbours(3))
    return next_.holds(match(cell, g), g).select(F.col("Cell_c").alias("id"))
