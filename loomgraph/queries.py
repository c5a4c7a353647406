"""The catalogue of registered queries over the order tables, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import algebra as A
from .operators.constraints import Commutes, Exists, ExistsUnique, Not, lift, nac, pac
from .operators.match import match
from .operators.rewrite import Rule
from .pattern import Morphism, Pattern, Var, inclusion
from .sources.tables import STORE, store

LI = "(select row_number() over (order by l_orderkey,l_partkey,l_suppkey,l_linenumber,l_quantity,l_extendedprice,l_discount,l_tax,l_returnflag,l_linestatus,l_shipdate)-1 li, * from lineitem)"

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def register(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            SQL[key] = sql.replace("{LI}", LI)
        return f

    return register


def pattern(parts: dict, homs: dict | None = None, attrs: dict | None = None) -> Pattern:
    return Pattern(STORE, parts, homs, attrs)


def _cols(df: DataFrame, **names: str) -> DataFrame:
    return df.select(*[F.col(c).alias(n) for n, c in names.items()])


def one(ob: str, **attrs) -> Pattern:
    """A single element ``x`` of a table, with what it refers to."""
    return pattern({ob: ["x"]}, attrs={a: {"x": v} for a, v in attrs.items()})


@query("select o_orderkey,c_custkey,n_nationkey,r_regionkey from orders,customer,nation,region where o_custkey=c_custkey and c_nationkey=n_nationkey and n_regionkey=r_regionkey")
def hom_fk_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pattern({"Orders": ["o"], "Customer": ["c"], "Nation": ["n"], "Region": ["r"]}, {"o_custkey": {"o": "c"}, "c_nationkey": {"c": "n"}, "n_regionkey": {"n": "r"}})
    return _cols(match(p, store(spark, sf_dir)), o_orderkey="Orders_o", c_custkey="Customer_c", n_nationkey="Nation_n", r_regionkey="Region_r")


def _wedge() -> Pattern:
    return pattern({"LineItem": ["a", "b"], "Orders": ["o"], "Part": ["p"]}, {"l_orderkey": {"a": "o", "b": "o"}, "l_partkey": {"a": "p", "b": "p"}})


@query("select a.li a,b.li b from {LI} a,{LI} b where a.l_orderkey=b.l_orderkey and a.l_partkey=b.l_partkey and a.li<>b.li")
def hom_monic_wedge(spark, sf_dir):
    return _cols(match(_wedge(), store(spark, sf_dir), ["LineItem"]), a="LineItem_a", b="LineItem_b")


@query("select a.li a,b.li b from {LI} a,{LI} b where a.l_orderkey=b.l_orderkey and a.l_partkey=b.l_partkey")
def hom_nonmonic_wedge(spark, sf_dir):
    return _cols(match(_wedge(), store(spark, sf_dir)), a="LineItem_a", b="LineItem_b")


@query("select li from {LI} x where l_returnflag='R' and l_quantity=50")
def hom_concrete_attr(spark, sf_dir):
    return _cols(match(one("LineItem", l_returnflag="R", l_quantity=50.0), store(spark, sf_dir)), li="LineItem_x")


@query("select a.p_partkey a,b.p_partkey b from part a,part b where a.p_brand=b.p_brand and a.p_type=b.p_type and a.p_size=b.p_size and a.p_partkey<>b.p_partkey")
def hom_shared_var(spark, sf_dir):
    v = {"p_brand": Var("brand"), "p_type": Var("type"), "p_size": Var("size")}
    p = pattern({"Part": ["a", "b"]}, attrs={a: {"a": x, "b": x} for a, x in v.items()})
    return _cols(match(p, store(spark, sf_dir), ["Part"], spread=True), a="Part_a", b="Part_b")


@query("select r_regionkey,n_nationkey from region,nation")
def hom_disconnected(spark, sf_dir):
    p = pattern({"Region": ["r", "s"], "Nation": ["n"]}, {"n_regionkey": {"n": "s"}})
    return _cols(match(p, store(spark, sf_dir)), r_regionkey="Region_r", n_nationkey="Nation_n")


def _line_pattern(same: bool) -> Pattern:
    nations = ["n"] if same else ["n", "m"]
    return pattern(
        {"LineItem": ["l"], "Orders": ["o"], "Customer": ["c"], "Supplier": ["s"], "Nation": nations}, {"l_orderkey": {"l": "o"}, "o_custkey": {"o": "c"}, "l_suppkey": {"l": "s"}, "c_nationkey": {"c": "n"}, "s_nationkey": {"s": nations[-1]}}
    )


@query("select li,o_orderkey,c_custkey,s_suppkey,c_nationkey from {LI} l,orders,customer,supplier where l_orderkey=o_orderkey and o_custkey=c_custkey and l_suppkey=s_suppkey and c_nationkey=s_nationkey")
def hom_cycle(spark, sf_dir):
    return _cols(match(_line_pattern(True), store(spark, sf_dir)), li="LineItem_l", o_orderkey="Orders_o", c_custkey="Customer_c", s_suppkey="Supplier_s", c_nationkey="Nation_n")


@query("select li from {LI} l,orders,customer,supplier where l_orderkey=o_orderkey and o_custkey=c_custkey and l_suppkey=s_suppkey and c_nationkey<>s_nationkey")
def commutes_neg(spark, sf_dir):
    g = store(spark, sf_dir)
    m = match(_line_pattern(False), g)
    return _cols(Commutes([(("Nation_n",), ("Nation_m",))], {}, commutes=False).holds(m, g), li="LineItem_l")


def _with_order(**attrs) -> Morphism:
    """A customer, extended by an order."""
    c = pattern({"Customer": ["x"], "Nation": ["n"], "Region": ["r"]}, {"c_nationkey": {"x": "n"}, "n_regionkey": {"n": "r"}})
    big = pattern({"Customer": ["x"], "Nation": ["n"], "Region": ["r"], "Orders": ["o"]}, {"c_nationkey": {"x": "n"}, "n_regionkey": {"n": "r"}, "o_custkey": {"o": "x"}}, {a: {"o": v} for a, v in attrs.items()})
    return inclusion(c, big)


def _with_line(**attrs) -> Morphism:
    """An order, extended by a line."""
    o = one("Orders")
    big = pattern({"Orders": ["x"], "LineItem": ["l"]}, {"l_orderkey": {"l": "x"}}, {a: {"l": v} for a, v in attrs.items()})
    return Morphism(o, big, {ob: {k: k for k in ks} for ob, ks in o.parts.items()})


@query("select c_custkey from customer where exists(select 1 from orders where o_custkey=c_custkey and o_orderstatus='F' and o_orderpriority='1-URGENT')", "pac")
def pac_(spark, sf_dir):
    g, f = store(spark, sf_dir), _with_order(o_orderstatus="F", o_orderpriority="1-URGENT")
    return _cols(pac(f).holds(match(f.dom, g), g), c_custkey="Customer_x")


@query("select o_orderkey from orders where not exists(select 1 from lineitem where l_orderkey=o_orderkey)", "nac")
def nac_(spark, sf_dir):
    g, f = store(spark, sf_dir), _with_line()
    return _cols(nac(f).holds(match(f.dom, g), g), o_orderkey="Orders_x")


@query("select c_custkey from customer where exists(select 1 from orders where o_custkey=c_custkey and o_orderpriority='1-URGENT') and not exists(select 1 from orders where o_custkey=c_custkey and o_orderpriority='5-LOW')")
def ac_and(spark, sf_dir):
    g, f = store(spark, sf_dir), _with_order(o_orderpriority="1-URGENT")
    c = Exists(f) & ~Exists(_with_order(o_orderpriority="5-LOW"))
    return _cols(c.holds(match(f.dom, g), g), c_custkey="Customer_x")


@query("select o_orderkey from orders where exists(select 1 from lineitem where l_orderkey=o_orderkey and l_quantity=50) or not exists(select 1 from lineitem where l_orderkey=o_orderkey)")
def ac_or(spark, sf_dir):
    g, f = store(spark, sf_dir), _with_line(l_quantity=50.0)
    return _cols((Exists(f) | Not(Exists(_with_line()))).holds(match(f.dom, g), g), o_orderkey="Orders_x")


@query("select l_orderkey from lineitem group by l_orderkey having count(*)=1")
def exists_unique(spark, sf_dir):
    g, f = store(spark, sf_dir), _with_line()
    return _cols(ExistsUnique(f).holds(match(f.dom, g), g), l_orderkey="Orders_x")


@query("select o_orderkey from orders where o_orderkey not in (select a.l_orderkey from {LI} a left join (select distinct l_orderkey k, l_returnflag f from lineitem where l_linestatus='O') b on a.l_orderkey=b.k and a.l_returnflag=b.f where b.k is null)")
def lift_cond(spark, sf_dir):
    g, f = store(spark, sf_dir), _with_line(l_returnflag=Var("flag"))
    n = f.cod
    more = pattern({**n.parts, "LineItem": ["l", "w"]}, {**n.homs, "l_orderkey": {"l": "x", "w": "x"}}, {"l_returnflag": {"l": Var("flag"), "w": Var("flag")}, "l_linestatus": {"w": "O"}})
    h = Morphism(n, more, {ob: {k: k for k in ks} for ob, ks in n.parts.items()})
    return _cols(lift(f, h).holds(match(f.dom, g), g), o_orderkey="Orders_x")


def _drop_nation(semantics: str) -> Rule:
    p = one("Nation")
    keep = p.abstract().restrict({e for e in p.elements() if e[0] == "Region"})
    return Rule(inclusion(keep, p), inclusion(keep, keep), semantics=semantics)


@query("select 'c_nationkey' h, c_custkey x from customer where c_nationkey=3 union all select 's_nationkey', s_suppkey from supplier where s_nationkey=3")
def dangling(spark, sf_dir):
    g, r = store(spark, sf_dir), _drop_nation("DPO")
    return _cols(r.dangling(match(r.L, g, initial={("Nation", "x"): 3}), g), h="hom", x="row")


def _drop_order(semantics: str, **attrs) -> Rule:
    p = one("Orders", **attrs)
    keep = p.abstract().restrict({e for e in p.elements() if e[0] != "Orders"})
    return Rule(inclusion(keep, p), inclusion(keep, keep), semantics=semantics)


@query("select o_orderkey from orders where exists(select 1 from lineitem where l_orderkey=o_orderkey)")
def dpo_delete(spark, sf_dir):
    g, r = store(spark, sf_dir), _drop_order("DPO")
    return r.apply(g, r.matches(g))["Orders"].select(F.col("id").alias("o_orderkey"))


@query("select li from {LI} l where l_orderkey not in (select o_orderkey from orders,customer where o_custkey=c_custkey and c_nationkey=3) and l_suppkey not in (select s_suppkey from supplier where s_nationkey=3)")
def spo_cascade(spark, sf_dir):
    g, r = store(spark, sf_dir), _drop_nation("SPO")
    return r.apply(g, r.matches(g, {("Nation", "x"): 3}))["LineItem"].select(F.col("id").alias("li"))


@query("select o_orderkey from orders where o_orderstatus<>'F' or exists(select 1 from lineitem where l_orderkey=o_orderkey)")
def coneg_delete(spark, sf_dir):
    g, r = store(spark, sf_dir), _drop_order("CoNeg", o_orderstatus="F")
    return r.apply(g, r.matches(g))["Orders"].select(F.col("id").alias("o_orderkey"))


@query("select c_custkey, case when c_nationkey=4 then 3 else c_nationkey end n from customer")
def merge_nodes(spark, sf_dir):
    g = store(spark, sf_dir)
    # glueing two nations glues their regions, too; only the customers' view of nations is asked for
    pair = spark.createDataFrame([(3, 4)], "a long, b long")
    return A.merge(g, {"Nation": pair}, check_attrs=False)["Customer"].select(F.col("id").alias("c_custkey"), F.col("c_nationkey").alias("n"))


@query("select l.l_orderkey ok, l.l_suppkey sk, count(*) n from (select l_orderkey, l_suppkey from lineitem) l join (select o_orderkey, i from orders,customer,(select 0 i union all select 1) where o_custkey=c_custkey and (c_nationkey=3 or i=0)) o on l.l_orderkey=o.o_orderkey join (select s_suppkey, j from supplier,(select 0 j union all select 1) where s_nationkey=3 or j=0) p on l.l_suppkey=p.s_suppkey group by 1,2")
def sqpo_clone(spark, sf_dir):
    g = store(spark, sf_dir)
    L = one("Nation")
    region = next(k for k in L.parts["Region"])
    I = Pattern(STORE, {"Nation": ["x", "y"], "Region": [region]}, {"n_regionkey": {"x": region, "y": region}})  # noqa: E741
    left = Morphism(I, L, {"Nation": {"x": "x", "y": "x"}, "Region": {region: region}})
    r = Rule(left, inclusion(I, I), semantics="SqPO")
    h, _ = r.apply_with_maps(g, r.matches(g, {("Nation", "x"): 3}))
    # fresh ids are ours; natural keys are compared: the copies of an order or supplier share the old row's
    return _natural(g, h)


def _natural(g, h) -> DataFrame:
    """Clones counted by the keys of the rows that they are copies of (told by attributes and shared parts)."""
    orders, suppliers = h["Orders"].select("id", "origin").withColumnRenamed("origin", "ok"), h["Supplier"].select(F.col("id").alias("sid"), F.col("origin").alias("sk"))
    lines = h["LineItem"].select("l_orderkey", "l_suppkey")
    return lines.join(orders, F.col("l_orderkey") == F.col("id")).join(suppliers, F.col("l_suppkey") == F.col("sid")).groupBy("ok", "sk").agg(F.count(F.lit(1)).alias("n"))


@query("select s_suppkey from supplier where s_nationkey <> 3 or s_suppkey in (select l_suppkey from lineitem)")
def subobj_conot(spark, sf_dir):
    """What together with the suppliers of nation 3 (and what they refer to) makes up everything: suppliers of others, and any that a line refers to."""
    g = store(spark, sf_dir)
    a = A.down(g, A.subobject(g, {"Supplier": g["Supplier"].where("s_nationkey = 3")}))
    return A.conegate(g, a)["Supplier"].select(F.col("id").alias("s_suppkey"))


def _half(g, low: int, high: int):
    ids = g["Nation"].where(F.col("id").between(low, high)).select("id")
    return A.down(g, A.subobject(g, {"Nation": ids}))


@query("select n_nationkey from nation where n_nationkey between 5 and 9")
def subobj_and(spark, sf_dir):
    g = store(spark, sf_dir)
    return A.meet(_half(g, 0, 9), _half(g, 5, 30))["Nation"].select(F.col("id").alias("n_nationkey"))


@query("select n_nationkey from nation where n_nationkey between 0 and 3 or n_nationkey between 8 and 9")
def subobj_or(spark, sf_dir):
    g = store(spark, sf_dir)
    return A.join_(_half(g, 0, 3), _half(g, 8, 9))["Nation"].select(F.col("id").alias("n_nationkey"))


@query("select c_custkey from customer, nation where c_nationkey=n_nationkey and n_regionkey not in (select n_regionkey from nation where n_nationkey between 0 and 3)")
def subobj_not(spark, sf_dir):
    g = store(spark, sf_dir)
    return A.negate(g, _half(g, 0, 3))["Customer"].select(F.col("id").alias("c_custkey"))


@query("select 'n_regionkey' h, count(*) filter (where r_regionkey is null) bad from nation left join region on n_regionkey=r_regionkey union all select 'o_custkey', count(*) filter (where c_custkey is null) from orders left join customer on o_custkey=c_custkey")
def naturality(spark, sf_dir):
    g = store(spark, sf_dir)
    bad = g.dangling(["n_regionkey", "o_custkey"]).groupBy("hom").agg(F.count(F.lit(1)).alias("n"))
    names = spark.createDataFrame([("n_regionkey",), ("o_custkey",)], "h string")
    return names.join(bad, F.col("h") == F.col("hom"), "left").select("h", F.coalesce("n", F.lit(0)).cast("long").alias("bad"))


@query("select c_custkey, r_regionkey v from customer, nation, region where c_nationkey=n_nationkey and n_regionkey=r_regionkey")
def subpart_path(spark, sf_dir):
    g = store(spark, sf_dir)
    return g.subpart("Customer", "c_nationkey", "n_regionkey").select(F.col("id").alias("c_custkey"), F.col("value").alias("v"))


@query("select li from {LI} l, supplier where l_suppkey=s_suppkey and s_nationkey=3")
def incident_path(spark, sf_dir):
    return store(spark, sf_dir).incident("LineItem", ("l_suppkey", "s_nationkey"), 3).select(F.col("id").alias("li"))


@query("select a.li a,b.li b from {LI} a,{LI} b where a.l_orderkey=b.l_orderkey and a.l_partkey=b.l_partkey and a.li<>b.li and (a.l_orderkey%10=0 or b.l_orderkey%10=0)")
def delta_matches(spark, sf_dir):
    from .streaming.incremental import delta_matches as delta

    g = store(spark, sf_dir)
    late = F.col("l_orderkey") % 10 == 0
    old = g.replace(LineItem=g["LineItem"].where(~late))
    return _cols(delta(_wedge(), old, {"LineItem": g["LineItem"].where(late)}, ["LineItem"]), a="LineItem_a", b="LineItem_b")


@query("select p,event_id from (select event_id, lag(event_id) over (partition by user_id order by ts) p from events) where p is not null")
def process_deps(spark, sf_dir):
    """Each event uses its user's last event and makes the next one: dependencies of the history."""
    from pyspark.sql import Window

    from .operators.process import dependencies

    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    prev = F.lag("event_id").over(Window.partitionBy("user_id").orderBy("ts"))
    steps = e.select(F.col("event_id").alias("step"), prev.alias("used"))
    rows = steps.select("step", F.lit("Event").alias("ob"), F.col("step").alias("id"), F.lit("created").alias("role")).unionAll(steps.where("used is not null").select("step", F.lit("Event"), "used", F.lit("used")))
    return dependencies(rows).select(F.col("i").alias("p"), F.col("j").alias("event_id"))


@query("select o_orderkey id, o_custkey owner, o_orderstatus label from orders")
def migrate_delta(spark, sf_dir):
    from .operators.migrate import Migrate
    from .schema import Schema

    small = Schema(("Item", "Owner"), {"owner": ("Item", "Owner")}, {"label": ("Item", "string")})
    return Migrate(small, STORE, {"Item": "Orders", "Owner": "Customer"}, {"owner": "o_custkey", "label": "o_orderstatus"}).pull(store(spark, sf_dir))["Item"]


@query("select c_custkey id, c_nationkey, null::varchar c_mktsegment from customer")
def migrate_sigma(spark, sf_dir):
    from .operators.migrate import Migrate
    from .schema import Schema

    small = Schema(("C", "N"), {"of": ("C", "N")})
    g = store(spark, sf_dir)
    own = A.Instance(small, {"C": g["Customer"].select("id", F.col("c_nationkey").alias("of")), "N": g["Nation"].select("id")})
    return Migrate(small, STORE, {"C": "Customer", "N": "Nation"}, {"of": "c_nationkey"}).push(own)["Customer"].select("id", "c_nationkey", "c_mktsegment")


@query("select c_custkey l, s_suppkey r from customer, supplier where c_nationkey=s_nationkey")
def pullback_pairs(spark, sf_dir):
    """Customers and suppliers over nations: the pullback of the two maps."""
    from .schema import Schema

    g, dot = store(spark, sf_dir), Schema(("X",))
    side = lambda o, h: (A.Instance(dot, {"X": g[o].select("id")}), {"X": g[o].select(F.col("id").alias("src"), F.col(h).alias("tgt"))})
    (a, f), (b, h) = side("Customer", "c_nationkey"), side("Supplier", "s_nationkey")
    return A.pullback(f, h, a, b)["X"].select(F.col("left").alias("l"), F.col("right").alias("r"))


@query("select 2*c_custkey id, 2*c_nationkey n from customer union all select 2*c_custkey+1, 2*c_nationkey+1 from customer where c_mktsegment='BUILDING'")
def coproduct_sum(spark, sf_dir):
    g = store(spark, sf_dir)
    return A.coproduct(g, g.where("Customer", F.col("c_mktsegment") == "BUILDING"))["Customer"].select("id", F.col("c_nationkey").alias("n"))


@query("select l_orderkey o_orderkey, cast(round(2 * l_quantity) as bigint) v from lineitem where l_returnflag = 'R'")
def expr_attr(spark, sf_dir):
    """A rule that changes rows in place: lines flagged R get twice their quantity and the flag X."""
    g = store(spark, sf_dir)
    line = lambda flag, v: one("LineItem", l_returnflag=flag, l_quantity=Var(v))
    L, R = line("R", "q"), line("X", "twice")
    keep = L.abstract()
    r = Rule(inclusion(keep, L), inclusion(keep, R), exprs={"twice": lambda v: v["q"] * 2})
    out = r.apply(g, r.matches(g))["LineItem"].where("l_returnflag = 'X'")
    return out.select(F.col("l_orderkey").alias("o_orderkey"), F.round("l_quantity").cast("long").alias("v"))


@query("select user_id, cast(sum(case when event_type='purchase' then 1 else 0 end) as bigint) state from events group by user_id")
def mealy_fold(spark, sf_dir):
    from .plans.mealy import fold_by_key

    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "ts", "event_type")
    count = lambda s, x: s + F.when(x["event_type"] == "purchase", 1).otherwise(0)
    return fold_by_key(e, "user_id", ["ts"], count, F.lit(0).cast("long"), "state")


@query("select o_orderkey, o_custkey from orders where o_orderkey in (select min(o_orderkey) from orders group by o_custkey)")
def rewrite_parallel(spark, sf_dir):
    """A maximal independent set of matches: one order per customer (each match binds and deletes the customer's mark)."""
    g = store(spark, sf_dir)
    from .functions.ids import cut
    from .schema import Schema

    s = Schema(("O", "C", "M"), {"oc": ("O", "C"), "mc": ("M", "C")})
    own = A.Instance(s, {"O": g["Orders"].select("id", F.col("o_custkey").alias("oc")), "C": g["Customer"].select("id"), "M": g["Customer"].select("id", F.col("id").alias("mc"))})
    L = Pattern(s, {"C": ["c"], "M": ["m"], "O": ["o"]}, {"oc": {"o": "c"}, "mc": {"m": "c"}})
    R = Pattern(s, {"C": ["c"], "O": ["o"]}, {"oc": {"o": "c"}})
    r = Rule.of(L, R)
    return cut(r.independent(r.matches(own))).select(F.col("O_o").alias("o_orderkey"), F.col("C_c").alias("o_custkey"))
