"""Decontamination and the two audits against brute force, on small tables with odd rows, and against their SQL."""

import hashlib
import random
import re
from collections import Counter
from itertools import permutations
from pathlib import Path

import duckdb
import pytest

from loomgraph.llm import decontamination as de
from loomgraph.llm import divergence, filter_audit
from loomgraph.llm.queries import ORACLE_SQL, QUERIES

_LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
SPACED = re.compile("[^\x20\x09-\x0d]+")


def words(text):
    return WORD.findall((text or "").translate(_LOW))


def contaminated(docs, items, window=10, shingle=5, share=1.0):
    """A row for each of ``docs(id, text)``: every stretch of every document is compared with every window of every item."""
    out = []
    cut = [(i, w[k : k + min(window, len(w))]) for i, t in items for w in [words(t)] for k in range(len(w) - min(window, len(w)) + 1) if w]
    for i, t in docs:
        w, hit, named = words(t), set(), set()
        for item, x in cut:
            n, s = len(x), min(shingle, len(x))
            for k in range(len(w) - n + 1):
                same = sum(w[k + j : k + j + s] == x[j : j + s] for j in range(n - s + 1))
                if same >= max(1, -int(-round(share * (n - s + 1), 9) // 1)):
                    hit |= set(range(k, k + n))
                    named.add("" if item is None else str(item))
        out.append((i, len(w), len(hit), sorted(named)))
    return out


def check_contaminated(spark, docs, items, **how):
    d = spark.createDataFrame([(i, t, "x", "y") for i, t in docs], "doc_id long, text string, row string, words string")
    b = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, token int")
    got = de.contamination(d, b, **how).collect()
    assert sorted(repr((r["doc_id"], r["n_words"], r["n_hit"], r["items"])) for r in got) == sorted(map(repr, contaminated(docs, items, **how)))
    assert all(r["contaminated"] == (r["n_hit"] > 0) and r["n_items"] == len(r["items"]) for r in got)


def some_texts(seed, n):
    rng = random.Random(seed)
    items = [" ".join(rng.choice(["a", "b", "C", "d-e", "é1", "日本"]) for _ in range(k)) for k in (0, 1, 2, 4, 5, 9, 10, 11, 14, 30, 30)]
    items += [items[-1], None, "...", " ".join(f"q{i}" for i in range(40))]
    docs = [None, "", " - ", "one", *items[4:]]
    for _ in range(n):
        own = [rng.choice(["a", "b", "c", "d", "e", "x9", "É1", "é1"]) for _ in range(rng.randrange(60))]
        for _ in range(rng.randrange(3)):
            w = words(rng.choice(items)) or ["z"]
            a = rng.randrange(len(w))
            own[rng.randrange(len(own) + 1) : 0] = w[a : a + rng.randrange(4, 25)]
        docs.append(rng.choice([" ", ", ", "\n"]).join(own).title())
    return [(i if i % 7 else None, t) for i, t in enumerate([*docs, docs[-1]])], [(i if i != 3 else None, t) for i, t in enumerate(items)]


@pytest.mark.parametrize("how", [{}, {"share": 0.5}, {"window": 6, "shingle": 2, "share": 0.8}])
def test_contamination_equals_brute_force(spark, how):
    check_contaminated(spark, *some_texts(len(how), 60), **how)


def test_contamination_of_no_rows_and_long_texts(spark):
    rng = random.Random(3)
    long = " ".join(f"w{rng.randrange(10**6)}" for _ in range(400_000))
    w = long.split(" ")
    items = [(1, " ".join(w[250_000:250_025])), (2, "nowhere to be found"), (3, " ".join(w[-10:])), (4, "x" * 5_000_000)]
    docs = [(1, long), (2, "x" * 5_000_000), (3, ("- " * 3_000_000) + " ".join(w[-12:]))]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in de.contamination(d, b).collect()}
    assert got == {1: (400_000, 35, ["1", "3"]), 2: (1, 1, ["4"]), 3: (12, 10, ["3"])}
    assert de.contamination(d.limit(0), b).count() == 0
    assert {r["n_items"] for r in de.contamination(d, b.limit(0)).collect()} == {0}


def test_bitmap_holds_every_token(spark):
    rng = random.Random(5)
    tokens = [rng.randrange(-(1 << 63), 1 << 63) for _ in range(5000)] + [0, -1, (1 << 63) - 1]
    bits = de.token_bitmap(spark.createDataFrame([(t,) for t in tokens], "token long"))
    import numpy as np

    assert de._in(bits, np.array(tokens, dtype=np.int64).view(np.uint64)).all()
    assert len(bits) * 8 == 1 << 17 and de._in(bits, np.arange(10**6, dtype=np.uint64) * np.uint64(de._R)).mean() < 0.1


def audit(docs, labels):
    """The audit's rows, each order walked document by document."""
    q, x = {}, {}
    for i, a, b in labels:
        q[i], x[i] = max(q.get(i) or 0, a or 0), max(x.get(i) or 0, b or 0)
    least = {}
    for i, t, _ in docs:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    fails, out = [], {}
    for i, t, lang in docs:
        t = t or ""
        w = SPACED.findall(t)
        f = "A" * (len(w) < 200) + "B" * (100 * len(set(w)) < 50 * len(w)) + "C" * (100 * len(re.findall("[A-Z]", t)) > 3 * len(t)) + "D" * bool(re.search("[#$%&*|]", t)) + "E" * (i is not None and least[t] < i)
        fails.append((lang or "", f, i is not None and q.get(i) == 1, i is not None and x.get(i) == 1))
    for part in {f[0] for f in fails}:
        mine, shapley = [f for f in fails if f[0] == part], Counter()
        for order in permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [m for m in left if f in m[1]]
                failing = [m for m in mine if f in m[1]]
                left = [m for m in left if f not in m[1]]
                shapley[f] += len(gone)
                out[(part, "".join(order), step)] = [len(left), len(gone), len(failing) - len(gone), sum(m[1] == f for m in mine), sum(m[2] for m in gone), sum(m[3] for m in gone), f]
        for k, v in out.items():
            if k[0] == part:
                v[6] = shapley[v[6]]
    return out


def test_filter_audit_equals_a_walk_through_every_order(spark):
    rng = random.Random(2)
    texts = [None, "", "  ", "A b", "x $ y", " ".join(f"w{i}" for i in range(250)), "same " * 300, "Big WORDS " * 150 + "#", "long " + "word" * 100_000]
    docs = [(rng.choice([None, *range(40)]), rng.choice(texts), rng.choice(["en", "de", None, ""])) for _ in range(120)]
    docs += docs[:5]
    labels = [(rng.choice([None, *range(40)]), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(30)]
    d = spark.createDataFrame([(*r, 1, "z") for r in docs], "doc_id long, text string, lang string, mask int, part string")
    got = filter_audit.filter_interactions(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    told = {(r["part"], r["filter_order"], r["step"]): [r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")] for r in got.collect()}
    assert told == audit(docs, labels) and len(told) == 3 * 600
    assert filter_audit.filter_interactions(d.limit(0), spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


def test_lattice_has_80_edges_and_600_steps(spark):
    assert filter_audit.lattice_edges(spark).count() == 80 and filter_audit.lattice_steps(spark).count() == 600
    assert filter_audit.lattice_edges(spark).agg({"orders": "sum"}).first()[0] == 600


def diverging(docs, least, top=50):
    out = []
    for lang in {g or "" for g, _, _ in docs}:
        mine = [(s or "", TERM.findall((t or "").translate(_LOW))) for g, s, t in docs if (g or "") == lang]
        df = Counter(x for _, w in mine for x in set(w))
        kept = sorted(x for x in df if df[x] >= least)
        counts = {s: Counter() for s, _ in mine}
        for s, w in mine:
            counts[s].update(x for x in w if df[x] >= least)
        share = lambda c: {x: 1 + 10**9 * (c[x] + 5) // (sum(c.values()) + 5 * len(kept)) for x in kept}  # noqa: E731, B023
        q, p = share(sum(counts.values(), Counter())), {s: share(c) for s, c in counts.items()}
        for s in counts:
            pairs = [(sum(abs(p[s][x] - p[o][x]) for x in kept), o) for o in counts if o != s]
            terms = [(p[s][x] - q[x], x) for x in kept if counts[s][x] > 0 and p[s][x] > q[x]]
            for part, rows, most in (("pair", pairs, None), ("term", terms, top)):
                out += [(lang, s, part, item, v, k) for k, (v, item) in enumerate(sorted(rows, key=lambda r: (-r[0], r[1].encode())), 1) if most is None or k <= most]
    return sorted(out)


@pytest.mark.parametrize("least", [1, 4, 10**6])
def test_divergence_equals_brute_force(spark, least):
    rng = random.Random(least)
    vocabulary = [f"t{chr(97 + i)}" for i in range(26)] + ["É", "日本", "Tb", "x1y", "\U0001f600z", "ﬁ"]
    docs = [(rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "hot", "hot", None]), " ".join(rng.choice(vocabulary[: rng.randrange(2, 32)]) for _ in range(rng.randrange(40)))) for _ in range(150)]
    docs += [("fr", "only", None), ("it", "a", "same"), ("it", "b", "same"), ("it", "c", ""), *docs[:3], ("en", "s1", "w" * 10**6 + " ta" * 10**5)]
    d = spark.createDataFrame([(*r, 1, 2) for r in docs], "lang string, source string, text string, n int, term int")
    got = divergence.source_divergence(d, min_docs=least, top=7)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == diverging(docs, least, 7)


def test_divergence_shares_are_exact_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    rows = [(10**15, 3 * 10**15, 10**6), (0, 0, 0), (0, 10**12 + 7, 3), (7, 7, 1)]
    got = spark.createDataFrame(rows, "c long, t long, k long").select(divergence.share(F.col("c"), F.col("t"), F.col("k"))).collect()
    assert [r[0] for r in got] == [1 + 10**9 * (c + 5) // max(t + 5 * k, 1) for c, t, k in rows]


def test_divergence_and_decontamination_of_empty_tables(spark):
    d = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert divergence.source_divergence(d).count() == 0
    assert de.contamination(d, spark.createDataFrame([], "item_id long, text string")).count() == 0


@pytest.mark.parametrize("name", ["op11_decontamination", "op12_filter_audit", "op13_divergence"])
def test_queries_equal_their_sql(spark, sf, name):
    con = duckdb.connect()
    for f in Path(sf).glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from '{f}'")
    df = QUERIES[name](spark, sf)
    want = con.execute(ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted(map(repr, (tuple(r[c] for c in columns) for r in df.collect()))) == sorted(map(repr, want.fetchall()))
    if name == "op11_decontamination":
        assert {r["items_sha256"] for r in df.where("n_items = 0").collect()} == {hashlib.sha256(b"").hexdigest()}
