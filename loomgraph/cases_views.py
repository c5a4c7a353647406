"""Registered queries for maps of instances and for views that follow changes."""

from __future__ import annotations

from pyspark.sql import functions as F

from .cases import _cut_edge, _nation_graph, graph
from .instance import Instance
from .operators import algebra as A
from .operators import open as op
from .operators.constraints import Exists, ExistsUnique, Forall, evaluate, lift, nac
from .operators.factor import lifts, pull_back
from .operators.match import match, take
from .operators.pbpo import TypedRule, partial_abstract
from .operators.program import compile_rule
from .operators.rewrite import Rule
from .pattern import Morphism, Pattern, Var, from_generators, identity, inclusion
from .plans import schedule as S
from .plans.mealy import walk
from .queries import _cols, _line_pattern, _with_line, pattern, query
from .schema import Schema
from .sources.tables import STORE, store
from .streaming.incremental import MatchView

_LATE = "l_orderkey % 10 = 0"


# -- maps of instances


@query("select a.li a, b.li b, b.l_returnflag flag from {LI} a, {LI} b where a.l_orderkey = b.l_orderkey and a.l_partkey = b.l_partkey and a.li <> b.li and a.l_returnflag = 'R' and a.l_orderkey % 10 <> 0")
def pull_back_lines(spark, sf_dir):
    """Pairs of lines found after an update (new ids, more orders, more lines flagged R), carried back to the lines before it."""
    g = store(spark, sf_dir)
    lines = g["LineItem"]
    flag = F.when(F.col("l_quantity") == 50, "R").otherwise(F.col("l_returnflag"))
    after = g.replace(LineItem=lines.withColumn("l_returnflag", flag).withColumn("id", F.col("id") * 2 + 1))
    before = lines.where(f"not {_LATE}")
    p = pattern({"LineItem": ["a", "b"], "Orders": ["o"], "Part": ["p"]}, {"l_orderkey": {"a": "o", "b": "o"}, "l_partkey": {"a": "p", "b": "p"}}, {"l_returnflag": {"a": "R", "b": Var("flag")}})
    update = {"LineItem": before.select(F.col("id").alias("src"), (F.col("id") * 2 + 1).alias("tgt"))}
    return _cols(pull_back(p, match(p, after, ["LineItem"]), update, g.replace(LineItem=before)), a="LineItem_a", b="LineItem_b", flag="var_flag")


@query("select li, c_nationkey * 5 + c_custkey % 5 n from {LI} l, orders, customer, supplier where l_orderkey = o_orderkey and o_custkey = c_custkey and l_suppkey = s_suppkey and c_nationkey = s_nationkey and c_custkey % 5 = s_suppkey % 5")
def lift_cycle(spark, sf_dir):
    """Nations are cut into five parts each; lines with customer and supplier in one nation, lifted to those with both in one part."""
    g, m = store(spark, sf_dir), match(_line_pattern(True), store(spark, sf_dir))
    parts = g["Nation"].select(F.explode(F.sequence(F.lit(0), F.lit(4))).alias("k"), "*")
    fine = g.replace(
        Nation=parts.select((F.col("id") * 5 + F.col("k")).alias("id"), "n_regionkey", "n_name"), Customer=g["Customer"].withColumn("c_nationkey", F.col("c_nationkey") * 5 + F.col("id") % 5), Supplier=g["Supplier"].withColumn("s_nationkey", F.col("s_nationkey") * 5 + F.col("id") % 5)
    )
    over = {"Nation": parts.select((F.col("id") * 5 + F.col("k")).alias("src"), F.col("id").alias("tgt"))}
    return _cols(lifts(_line_pattern(True), m, over, fine), li="lift_LineItem_l", n="lift_Nation_n")


# -- views


@query("select o_orderkey from orders where not exists(select 1 from lineitem where l_orderkey = o_orderkey and l_returnflag = 'R' and l_quantity >= 25)")
def view_under_nac(spark, sf_dir):
    """Orders without a line flagged R: lines come late, then small ones are deleted, and orders whose last flagged line goes come (back) to life."""
    g, f = store(spark, sf_dir), _with_line(l_returnflag="R")
    view = MatchView([f.dom], g.replace(LineItem=g["LineItem"].where(f"not {_LATE}")), conditions=[nac(f)])
    view.insert({"LineItem": g["LineItem"].where(_LATE)})
    view.delete({"LineItem": g["LineItem"].where("l_quantity < 25").select("id")})
    return _cols(view.matches(), o_orderkey="Orders_x")


@query("with l as (select * from lineitem where l_quantity >= 10) select o_orderkey from orders where o_orderkey not in (select a.l_orderkey from l a left join (select distinct l_orderkey k, l_returnflag f from l where l_linestatus = 'O') b on a.l_orderkey = b.k and a.l_returnflag = b.f where b.k is null)")
def view_under_lift(spark, sf_dir):
    """Orders each of whose lines has an open line with its flag, kept through a late batch and a deletion: a nested condition."""
    g, f = store(spark, sf_dir), _with_line(l_returnflag=Var("flag"))
    n = f.cod
    more = pattern({**n.parts, "LineItem": ["l", "w"]}, {**n.homs, "l_orderkey": {"l": "x", "w": "x"}}, {"l_returnflag": {"l": Var("flag"), "w": Var("flag")}, "l_linestatus": {"w": "O"}})
    condition = lift(f, Morphism(n, more, {ob: {k: k for k in ks} for ob, ks in n.parts.items()}))
    view = MatchView([f.dom], g.replace(LineItem=g["LineItem"].where(f"not {_LATE}")), conditions=[condition])
    view.insert({"LineItem": g["LineItem"].where(_LATE)})
    view.delete({"LineItem": g["LineItem"].where("l_quantity < 10").select("id")})
    return _cols(view.matches(), o_orderkey="Orders_x")


_SMALL = Schema(("Region", "Nation", "Customer", "Orders"), {h: STORE.homs[h] for h in ("n_regionkey", "c_nationkey", "o_custkey")})


@query("with r as (select min(n_regionkey) a, max(n_regionkey) b from nation where n_nationkey in (7, 8)) select o_orderkey o, c_custkey c, case c_nationkey when 8 then 7 else c_nationkey end n, case n_regionkey when r.b then r.a else n_regionkey end r from orders, customer, nation, r where o_custkey = c_custkey and c_nationkey = n_nationkey")
def view_after_merge(spark, sf_dir):
    """Two nations become one (and so their regions do): orders with customer, nation and region, from the rows that refer to what was merged."""
    whole = store(spark, sf_dir)
    g = Instance(_SMALL, {o: whole[o].select("id", *_SMALL.homs_from(o)) for o in _SMALL.obs})
    chain = Pattern(_SMALL, {"Orders": ["o"], "Customer": ["c"], "Nation": ["n"], "Region": ["r"]}, {"o_custkey": {"o": "c"}, "c_nationkey": {"c": "n"}, "n_regionkey": {"n": "r"}})
    two = Pattern(_SMALL, {"Nation": ["a", "b"], "Region": ["r", "s"]}, {"n_regionkey": {"a": "r", "b": "s"}})
    one = Pattern(_SMALL, {"Nation": ["a"], "Region": ["r"]}, {"n_regionkey": {"a": "r"}})
    merge = Rule(identity(two), Morphism(two, one, {"Nation": {"a": "a", "b": "a"}, "Region": {"r": "r", "s": "r"}}))
    view = MatchView([chain], g)
    view.rewrite(merge, merge.matches(g, {("Nation", "a"): 7, ("Nation", "b"): 8}))
    return _cols(view.matches(), o="Orders_o", c="Customer_c", n="Nation_n", r="Region_r")


_EDGES = "with n as (select max(n_nationkey) m from nation), e as (select n_nationkey id, n_nationkey src, n_nationkey + 1 tgt from nation, n where n_nationkey < m and n_nationkey <> 2 union all select m, 2, m + 1 from n union all select m + 1, m + 1, 1 from n), f as (select id, case src when 5 then 4 else src end src, case tgt when 5 then 4 else tgt end tgt from e)"


@query(f"{_EDGES} select a.id a, b.id b from f a, f b where a.tgt = b.src")
def view_after_rules(spark, sf_dir):
    """Paths of two edges over the nations, through a rule that closes a triangle, one that deletes an edge and one that merges an edge's ends."""
    g, edge = _nation_graph(spark, sf_dir), graph(2, (1, 2))
    triangle = Rule(identity(edge), Morphism(edge, graph(3, (1, 2), (2, 3), (3, 1)), {"V": {1: 1, 2: 2}, "E": {1: 1}}))
    contract = Rule(identity(edge), Morphism(edge, graph(1, (1, 1)), {"V": {1: 1, 2: 1}, "E": {1: 1}}))
    view = MatchView([graph(3, (1, 2), (2, 3))], g)
    for r, e in ((triangle, 1), (_cut_edge(), 2), (contract, 4)):
        view.rewrite(r, r.matches(view.state, {("E", 1): e}))
    return _cols(view.matches(), a="E_1", b="E_2")



# -- open systems over tables


def _small(spark, sf_dir) -> Instance:
    g = store(spark, sf_dir)
    return Instance(_SMALL, {o: g[o].select("id", *_SMALL.homs_from(o)) for o in _SMALL.obs})


def _leg(rows, foot: str = "id") -> tuple:
    return "Customer", rows.select(F.col(foot).alias("foot"), "id")


@query("select c_custkey from customer where c_nationkey = 3 or exists(select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'P')")
def open_boundary_stays(spark, sf_dir):
    """Customers without pending orders are deleted, but for those on the boundary (of nation 3)."""
    g = _small(spark, sf_dir)
    g = g.replace(Orders=store(spark, sf_dir)["Orders"].where("o_orderstatus = 'P'").select("id", "o_custkey"))
    c = Pattern(_SMALL, {"Customer": ["c"], "Nation": ["n"], "Region": ["r"]}, {"c_nationkey": {"c": "n"}, "n_regionkey": {"n": "r"}})
    rest = c.restrict({("Nation", "n"), ("Region", "r")})
    rule = op.OpenRule(inclusion(rest, c), identity(rest), [])
    host = op.OpenInstance(g, [_leg(g["Customer"].where("c_nationkey = 3"))])
    return rule.rewrite_in(host, None).body["Customer"].select(F.col("id").alias("c_custkey"))


@query("with b as (select min(o_custkey) a, max(o_custkey) z from orders) select o_orderkey, case when o_custkey = b.z then b.a else o_custkey end c from orders, b where o_orderkey <> (select min(o_orderkey) from orders p, b where p.o_custkey = b.a)")
def open_rewrite_host(spark, sf_dir):
    """A host of orders with two boundary customers, one on each leg: the first order of one goes, and both become one."""
    g = _small(spark, sf_dir)
    L = Pattern(_SMALL, {"Orders": ["o"], "Customer": ["a", "z"]}, {"o_custkey": {"o": "a"}})
    keep = L.restrict({e for e in L.elements() if e[0] != "Orders"})
    R = Pattern(_SMALL, {"Customer": ["a"], "Nation": ["m"], "Region": ["q"]}, {"c_nationkey": {"a": "m"}, "n_regionkey": {"m": "q"}})
    to = {"Customer": {"a": "a", "z": "a"}, "Nation": dict.fromkeys(keep.parts["Nation"], "m"), "Region": dict.fromkeys(keep.parts["Region"], "q")}
    rule = op.OpenRule(inclusion(keep, L), Morphism(keep, R, to), [[("Customer", "a")], [("Customer", "z")]])
    ends = g["Orders"].agg(F.min("o_custkey").alias("a"), F.max("o_custkey").alias("z"))
    leg = lambda c: ("Customer", ends.select(F.lit(0).alias("foot"), F.col(c).alias("id")))
    m = rule.rewrite_in(op.OpenInstance(g, [leg("a"), leg("z")]), 0)
    return m.body["Orders"].select(F.col("id").alias("o_orderkey"), F.col("o_custkey").alias("c"))


@query("select case o_orderstatus when 'F' then 2 * o_orderkey else 2 * o_orderkey + 1 end id, 2 * o_custkey c from orders where o_orderstatus in ('F', 'O')")
def open_compose_hosts(spark, sf_dir):
    """Finished orders and open ones are two systems with all customers on their boundaries; side by side they share customers."""
    whole, g = store(spark, sf_dir), _small(spark, sf_dir)
    part = lambda status: g.replace(Orders=whole["Orders"].where(F.col("o_orderstatus") == status).select("id", "o_custkey"))
    leg = _leg(g["Customer"])
    both = op.OpenInstance(part("F"), [leg]).beside(op.OpenInstance(part("O"), [leg]))
    return both.body["Orders"].select("id", F.col("o_custkey").alias("c"))


@query("select 'Customer' ob, 3 * c_custkey src, c_custkey tgt from customer union all select 'Customer', 3 * c_custkey + 1, c_custkey from customer union all select 'Customer', 3 * c_custkey + 2, c_custkey from customer where c_nationkey <> 3 union all select 'Nation', 3 * n_nationkey, n_nationkey from nation union all select 'Nation', 3 * n_nationkey + 2, n_nationkey from nation where n_nationkey not in (select c_nationkey from customer where c_nationkey = 3)")
def colimit_map(spark, sf_dir):
    """Three copies of customers and nations, the first two glued along all nations, the last two along the customers of nation 3; the map that goes back to the one table."""
    g, s = store(spark, sf_dir), Schema(("Nation", "Customer"), {"c_nationkey": ("Customer", "Nation")})
    own = Instance(s, {"Nation": g["Nation"].select("id"), "Customer": g["Customer"].select("id", "c_nationkey")})
    same = lambda rows: rows.select(F.col("id").alias("src"), F.col("id").alias("tgt"))
    nations, some = {"Nation": same(own["Nation"])}, {"Customer": same(own["Customer"].where("c_nationkey = 3"))}
    _, into = A.colimit([own, own, own], [[(0, nations), (1, nations)], [(1, some), (2, some)]])
    whole = {o: same(own[o]) for o in s.obs}
    out = A.universal(into, [whole, whole, whole])
    return out["Customer"].withColumn("ob", F.lit("Customer")).unionByName(out["Nation"].withColumn("ob", F.lit("Nation")))


# -- rules controlled by typings


@query("select c_custkey origin, count(*) n, count(distinct c) nations from (select c_custkey, c_nationkey c from customer union all select c_custkey, -1 from customer where c_nationkey = 3) group by 1")
def pbpo_deep_copy(spark, sf_dir):
    """A nation is copied with all its customers: a customer's type follows from its nation's, by search."""
    s = Schema(("Nation", "Customer"), {"c_nationkey": ("Customer", "Nation")}, {"origin": ("Customer", "bigint")})
    g0 = store(spark, sf_dir)
    g = Instance(s, {"Nation": g0["Nation"].select("id"), "Customer": g0["Customer"].select("id", "c_nationkey", F.col("id").alias("origin"))})
    L = Pattern(s, {"Nation": ["x"]})
    two = Pattern(s, {"Nation": ["x1", "x2"]})
    types = Pattern(s, {"Nation": ["x", "other"], "Customer": ["deep", "rest"]}, {"c_nationkey": {"deep": "x", "rest": "other"}})
    copies = Pattern(s, {"Nation": ["x1", "x2", "other"], "Customer": ["deep1", "deep2", "rest"]}, {"c_nationkey": {"deep1": "x1", "deep2": "x2", "rest": "other"}})
    back = {"Nation": {"x1": "x", "x2": "x", "other": "other"}, "Customer": {"deep1": "deep", "deep2": "deep", "rest": "rest"}}
    rule = TypedRule(Morphism(two, L, {"Nation": {"x1": "x", "x2": "x"}}), identity(two), Morphism(L, types, {"Nation": {"x": "x"}}), Morphism(two, copies, {"Nation": {"x1": "x1", "x2": "x2"}}), Morphism(copies, types, back))
    m = match(L, g, initial={("Nation", "x"): 3})
    out = rule.apply(g, m, rule.typing(g, m))["Customer"]
    return out.groupBy("origin").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("c_nationkey").alias("nations"))


@query("select r.r_regionkey m, string_agg(k.r_regionkey || ':' || t.t, ',' order by k.r_regionkey) types from region r, region k, (select 0 i union all select 1) b0, (select 0 i union all select 1) b1, (select 0 i union all select 1) b2, (select 0 i union all select 1) b3, (select 0 i union all select 1) b4, (select 'r' t union all select 'a' union all select 'b') t where t.t = case when k.r_regionkey = r.r_regionkey then 'r' when [b0.i, b1.i, b2.i, b3.i, b4.i][k.r_regionkey + 1] = 0 then 'a' else 'b' end and [b0.i, b1.i, b2.i, b3.i, b4.i][r.r_regionkey + 1] = 0 group by r.r_regionkey, b0.i, b1.i, b2.i, b3.i, b4.i having count(*) filter (where t.t = 'b') <= 2")
def pbpo_typings(spark, sf_dir):
    """Every region matched in turn; the others are each of one of two types, and nations follow; typings with at most two regions of the second type, all as rows."""
    s = Schema(("Region", "Nation"), {"n_regionkey": ("Nation", "Region")})
    g0 = store(spark, sf_dir)
    g = Instance(s, {"Region": g0["Region"].select("id"), "Nation": g0["Nation"].select("id", "n_regionkey")})
    L = Pattern(s, {"Region": ["r"]})
    types = Pattern(s, {"Region": ["r", "a", "b"], "Nation": ["nr", "na", "nb"]}, {"n_regionkey": {"nr": "r", "na": "a", "nb": "b"}})
    few = lambda t, _: t["Region"].groupBy("b").agg(F.sum((F.col("type") == "b").cast("int")).alias("n")).where("n <= 2")
    rule = TypedRule(identity(L), identity(L), Morphism(L, types, {"Region": {"r": "r"}}), Morphism(L, types, {"Region": {"r": "r"}}), identity(types), lcs=[few])
    m, found, kinds = rule.all_typings(g, rule.matches(g))
    told = kinds["Region"].groupBy("b").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("id", "type"))), lambda x: F.concat(x["id"], F.lit(":"), x["type"])), ",").alias("types"))
    named = found.join(m.select(F.col("b").alias("of_"), F.col("Region_r").alias("m")), F.col("of") == F.col("of_")).select(F.col("b").alias("b_"), "m")
    return told.join(named, F.col("b") == F.col("b_")).select("m", "types")


@query("select 0 b, c_custkey id, cast(null as double) as value, case when c_custkey = x.i then 'L.bal' else 'Customer.' || c_custkey || '.c_acctbal' end as variable from customer, (select min(c_custkey) i from customer) x")
def pbpo_partial_abstract(spark, sf_dir):
    """Customers with balances freed, but for the one that is matched, whose variable is the pattern's."""
    s = Schema(("Customer",), {}, {"c_acctbal": ("Customer", "double")})
    g = Instance(s, {"Customer": store(spark, sf_dir)["Customer"].select("id", "c_acctbal")})
    L = Pattern(s, {"Customer": ["c"]}, attrs={"c_acctbal": {"c": Var("bal")}})
    first_ = g["Customer"].agg(F.min("id").alias("Customer_c"))
    return partial_abstract(L, match(L, g, initial=first_).withColumn("b", F.lit(0)), g)["c_acctbal"]


# -- compiled rules


@query("with x as (select l_orderkey k, count(*) n from lineitem where l_returnflag = 'R' group by 1) select o_orderkey, case when x.k is null then o_orderstatus else 'R' end status, count(*) n, cast(sum(case when l_returnflag = 'R' then 2 * l_quantity + 1 else l_quantity end) as bigint) q from orders join lineitem on l_orderkey = o_orderkey left join x on x.k = o_orderkey group by all")
def compiled_rule(spark, sf_dir):
    """A rule compiled once and run on two halves of the orders: a line flagged R gives way to one of twice its quantity and one, and its order gets the status R."""
    g = store(spark, sf_dir)
    keys = {"l_orderkey": {"l": "o"}, "l_partkey": {"l": "p"}, "l_suppkey": {"l": "s"}}
    L = pattern({"LineItem": ["l"], "Orders": ["o"], "Part": ["p"], "Supplier": ["s"]}, keys, {"l_returnflag": {"l": "R"}, "l_quantity": {"l": Var("q")}})
    keep = L.abstract().restrict({e for e in L.elements() if e[0] != "LineItem"})
    homs_ = {h: {("z" if k == "l" else k): v for k, v in f.items()} for h, f in L.homs.items()}
    R = Pattern(STORE, {**keep.parts, "LineItem": ["z"]}, homs_, {"o_orderstatus": {"o": "R"}, "l_returnflag": {"z": "N"}, "l_linestatus": {"z": "N"}, "l_quantity": {"z": Var("more")}})
    program = compile_rule(Rule(inclusion(keep, L), inclusion(keep, R), exprs={"more": lambda v: v["q"] * 2 + 1}))
    out = None
    for half in (0, 1):
        part = g.replace(Orders=g["Orders"].where(F.col("id") % 2 == half), LineItem=g["LineItem"].where(F.col("l_orderkey") % 2 == half))
        h = program.run(part)
        lines = h["LineItem"].select("l_orderkey", "l_quantity")
        found = h["Orders"].join(lines, F.col("id") == F.col("l_orderkey")).groupBy(F.col("id").alias("o_orderkey"), F.col("o_orderstatus").alias("status"))
        found = found.agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").cast("long").alias("q"))
        out = found if out is None else out.unionAll(found)
    return out


# -- agents in batches, weighted trajectories


@query("select o_custkey c, count(*) n from (select o_custkey from orders where o_orderstatus = 'P' union all select c_custkey from customer union all select o_custkey from orders where o_orderstatus = 'F' and o_orderkey not in (select min(o_orderkey) from orders where o_orderstatus = 'F' group by o_custkey)) group by 1")
def schedule_batch(spark, sf_dir):
    """All customers are agents at once: each gets a new order, and loses its first finished one."""
    whole = store(spark, sf_dir)
    s = _SMALL.extend(attrs={"o_orderstatus": ("Orders", "string")})
    g = Instance(s, {o: whole[o].select("id", *s.homs_from(o), *s.attrs_of(o)) for o in s.obs})
    g = g.replace(Orders=g["Orders"].where("o_orderstatus in ('F', 'P')"))
    named = {"Customer": ["c"], "Nation": ["n"], "Region": ["r"]}
    keys = {"c_nationkey": {"c": "n"}, "n_regionkey": {"n": "r"}}
    c = Pattern(s, named, keys)
    order = lambda status: Pattern(s, {**named, "Orders": ["o"]}, {**keys, "o_custkey": {"o": "c"}}, {"o_orderstatus": {"o": status}})
    add = Rule(identity(c), inclusion(c, order("N")))
    drop = Rule(inclusion(c, order("F")), identity(c))
    here = {("Customer", "c"): ("Customer", "c")}
    batch = S.AgentBatch("customers", c, [S.RuleApp("add", add, c, here), S.RuleApp("drop", drop, c, here)])
    world, *_ = S.singleton(batch).run(g)
    return world["Orders"].groupBy(F.col("o_custkey").alias("c")).agg(F.count(F.lit(1)).alias("n"))


_MOVES = "with e as (select user_id, event_type a, lead(event_type) over (partition by user_id order by ts, event_id) b from events), t as (select user_id, a, b, count(*) num, (sum(count(*)) over (partition by user_id, a))::bigint den from e where b is not null group by 1, 2, 3), s as (select user_id, arg_min(event_type, (ts, event_id)) event_type from events group by 1)"


@query(f"{_MOVES}, w as (select user_id, event_type, 1::bigint num, 1::bigint den, '' path, 0 k, false done from s), w1 as (select w.user_id, coalesce(t.b, event_type) event_type, w.num * coalesce(t.num, 1) num, w.den * coalesce(t.den, 1) den, coalesce(t.b, '') path, t.b is null done from w left join t on w.user_id = t.user_id and w.event_type = t.a), w2 as (select w1.user_id, coalesce(t.b, event_type) event_type, w1.num * coalesce(t.num, 1) num, w1.den * coalesce(t.den, 1) den, case when t.b is null then path when path = '' then t.b else path || ',' || t.b end path, t.b is null done from w1 left join t on not w1.done and w1.user_id = t.user_id and w1.event_type = t.a) select * from w2")
def weighted_walk(spark, sf_dir):
    """Two steps on from each user's first event, along the moves between event types that this user has made, with exact chances; the way is written down."""
    from pyspark.sql import Window

    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_type", "ts", "event_id")
    turn = Window.partitionBy("user_id").orderBy("ts", "event_id")
    pairs = e.withColumn("to_event_type", F.lead("event_type").over(turn)).where("to_event_type is not null").groupBy("user_id", "event_type", "to_event_type").agg(F.count(F.lit(1)).alias("num"))
    moves = pairs.withColumn("den", F.sum("num").over(Window.partitionBy("user_id", "event_type"))).withColumn("note", F.col("to_event_type"))
    start = e.groupBy("user_id").agg(F.min_by("event_type", F.struct("ts", "event_id")).alias("event_type"))
    return walk(start, moves, 2, ["user_id", "event_type"], "writer")


# -- conditions that share extensions, patterns from equations


@query("select o_orderkey from orders where exists(select 1 from lineitem where l_orderkey = o_orderkey and l_linestatus = 'F') and ((select count(*) from lineitem where l_orderkey = o_orderkey and l_linestatus = 'F') > 1 or not exists(select 1 from lineitem where l_orderkey = o_orderkey and l_linestatus = 'O')) and not exists(select 1 from lineitem where l_orderkey = o_orderkey and l_linestatus = 'F' and l_returnflag = 'N')")
def shared_extensions(spark, sf_dir):
    """Conditions that mention an order's finished lines three times, which are found once."""
    g, done = store(spark, sf_dir), _with_line(l_linestatus="F")
    flagged = Morphism(done.cod, pattern(done.cod.parts, done.cod.homs, {"l_linestatus": {"l": "F"}, "l_returnflag": {"l": "N"}}), {o: {k: k for k in ks} for o, ks in done.cod.parts.items()})
    told, shared = evaluate([Exists(done), ~ExistsUnique(done) | nac(_with_line(l_linestatus="O")), Forall(done, ~Exists(flagged))], match(done.dom, g), g)
    if shared.stored() != 3:
        raise AssertionError(f"{shared.stored()} extensions")
    return _cols(told, o_orderkey="Orders_x")


@query("select li, c_nationkey n from {LI} l, orders, customer, supplier where l_orderkey = o_orderkey and o_custkey = c_custkey and l_suppkey = s_suppkey and c_nationkey = s_nationkey")
def generated_cycle(spark, sf_dir):
    """Lines whose customer and supplier are of one nation: the pattern is one line and one equation."""
    p = from_generators(STORE, {"l": "LineItem"}, [(("l", "l_orderkey", "o_custkey", "c_nationkey"), ("l", "l_suppkey", "s_nationkey"))])
    return _cols(match(p, store(spark, sf_dir)), li="LineItem_l", n="Nation_l_l_suppkey_s_nationkey")


@query("select a.li a, b.li b from {LI} a, {LI} b where a.l_orderkey = b.l_orderkey and a.l_partkey = b.l_partkey and a.li <> b.li and a.l_returnflag = b.l_returnflag")
def generated_wedge(spark, sf_dir):
    """Two lines of one order and one part with the same flag, from two generators and two equations."""
    flag = {("a", "l_returnflag"): Var("flag"), ("b", "l_returnflag"): Var("flag")}
    p = from_generators(STORE, {"a": "LineItem", "b": "LineItem"}, [(("a", "l_orderkey"), ("b", "l_orderkey")), (("a", "l_partkey"), ("b", "l_partkey"))], flag)
    return _cols(match(p, store(spark, sf_dir), ["LineItem"]), a="LineItem_a", b="LineItem_b")


# -- why not, and what happened


@query("select o_orderkey o, reason, detail from (select o_orderkey, 'condition' reason, '0' detail from orders where o_orderstatus <> 'F' union all select o_orderkey, 'dangling', 'l_orderkey of ' || min(li) from orders, {LI} l where l_orderkey = o_orderkey group by o_orderkey)")
def match_reasons(spark, sf_dir):
    """Why an order can't be deleted: it isn't finished, or lines refer to it (the first is told)."""
    from .operators.constraints import Where

    g = store(spark, sf_dir)
    L = pattern({"Orders": ["o"], "Customer": ["c"]}, {"o_custkey": {"o": "c"}}, {"o_orderstatus": {"o": Var("status")}})
    keep = L.abstract().restrict({e for e in L.elements() if e[0] != "Orders"})
    r = Rule(inclusion(keep, L), identity(keep), conditions=[Where(F.col("var_status") == "F")])
    return r.reasons(g).select(F.col("Orders_o").alias("o"), "reason", "detail")


@query("select n_nationkey + 1 world, n_nationkey id from nation where n_nationkey < 3")
def kept_worlds(spark, sf_dir):
    """Three turns of deleting the first edge of the nations' path, with all worlds kept: what each turn took away."""
    seen = S.Trajectory()
    S.for_schedule(3, S.tryrule(S.RuleApp("cut", _cut_edge()))).run(_nation_graph(spark, sf_dir), keep=seen)
    return seen.changes("E").where("change = 'removed'").select("world", "id")


@query("select n_nationkey id from nation where n_nationkey >= 3 and n_nationkey < (select max(n_nationkey) from nation)")
def migrated_schedule(spark, sf_dir):
    """A schedule over graphs (delete the first edge, as long as the edge 2 is there) carried over to nations and steps between them."""
    from .operators.migrate import Migrate
    from .plans.migrate import migrate_schedule
    from .schema import GRAPH

    steps = Schema(("Nation", "Step"), {"from": ("Step", "Nation"), "to": ("Step", "Nation")}, {"n_name": ("Nation", "string")})
    f = Migrate(GRAPH, steps, {"V": "Nation", "E": "Step"}, {"src": "from", "tgt": "to"})
    body = S.tryrule(S.RuleApp("cut", _cut_edge()))
    plan = migrate_schedule(f, S.while_schedule(lambda w, _: not w["E"].where("id = 2").isEmpty(), body))
    g, n = _nation_graph(spark, sf_dir), store(spark, sf_dir)["Nation"]
    world = Instance(steps, {"Nation": n.select("id", "n_name"), "Step": g["E"].select("id", F.col("src").alias("from"), F.col("tgt").alias("to"))})
    return plan.run(world)[0]["Step"].select("id")


@query("select li, l_orderkey o, c_custkey c from {LI} l, orders, customer where l_orderkey = o_orderkey and o_custkey = c_custkey and l_returnflag = 'R' order by c, o, li limit 20")
def hom_take(spark, sf_dir):
    """The first 20 returned lines by customer, order and line."""
    p = pattern({"Customer": ["c"], "Orders": ["o"], "LineItem": ["l"]}, {"o_custkey": {"o": "c"}, "l_orderkey": {"l": "o"}}, {"l_returnflag": {"l": "R"}})
    found = _cols(match(p, store(spark, sf_dir)), c="Customer_c", o="Orders_o", li="LineItem_l")
    return take(found, 20)
