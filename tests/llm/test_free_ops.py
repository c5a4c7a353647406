"""Operators in free style: brute force, round trips and held-out accuracy."""

import zlib

import numpy as np
import public_tokenizers as P
import pytest

from loomgraph.llm import bpe, packing, simhash, toxicity, warc
from loomgraph.llm import quality_classifier as qc
from loomgraph.llm.tokens import Tokens


def test_simhash_components_equal_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    extra = spark.createDataFrame([(100001, None, None, None, None), (100002, "", None, None, None), (None, "x", None, None, None)], docs.schema)
    docs = docs.unionByName(extra).withColumn("fp", docs.lang).withColumn("key", docs.lang)
    got = simhash.near_duplicates(docs).collect()
    rows = [(r["doc_id"], simhash.simhash64(r["text"])) for r in docs.collect()]
    assert len(got) == len(rows)
    ids = [i for i, _ in rows if i is not None]
    print_ = dict(rows)
    up = {i: i for i in ids}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in ids:
        for j in ids:
            if j < i and (print_[i] ^ print_[j]).bit_count() <= 4 and top(i) != top(j):
                a, b = sorted((top(i), top(j)))
                up[b] = a
    for r in got:
        if r["doc_id"] is not None:
            assert r["component_id"] == top(r["doc_id"]) and r["fingerprint"] == f"{print_[r['doc_id']]:016x}"
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {top(i) for i in ids} | {None}


def test_pipeline_drops_texts_of_similarity_from_four_fifths(spark):
    import corpus_pipeline as cp

    rng = np.random.default_rng(8)
    rows = []
    for i in range(40):
        words = [f"w{k}" for k in rng.integers(0, 5000, 300)]
        rows.append((i, " ".join(words)))
        for at, step in ((100, 75), (200, 30)):  # 4 and 10 words changed: about 0.87 and 0.71 of the shingles stay
            rows.append((at + i, " ".join(f"x{k}" if k % step == 7 else w for k, w in enumerate(words))))
    rows += [(300, None), (301, " "), (302, "a b"), (303, "A  b"), (304, "a c")]
    docs = spark.createDataFrame([*rows, (None, rows[0][1])], "doc_id long, text string")
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, min(len(w), 1)))} for i, t in rows for w in [(t or "").lower().split()]}
    up = {i: i for i, _ in rows}
    for i in sorted(up):
        for j in sorted(up):
            if j < i and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) and up[i] != up[j]:
                a, b = sorted((up[i], up[j]))
                up = {k: a if v == b else v for k, v in up.items()}
    got = cp.simhash(spark, docs, "")
    assert got.columns == docs.columns and {r["doc_id"] for r in got.collect()} == set(up.values()) | {None}
    assert 0 < sum(up[100 + i] == i for i in range(40)) and sum(up[200 + i] == 200 + i for i in range(40)) > 0
    assert cp.simhash(spark, docs.limit(0), "").count() == 0


def _near_threshold(n, pairs, seed=3):
    """Texts of 600 common and 100 own words each (similarity 0.73 to 0.75), some with a partner that has most of its own words, too."""
    rng = np.random.default_rng(seed)
    common = [f"c{k}" for k in range(600)]
    texts = [common + [f"o{i}x{k}" for k in range(100)] for i in range(n)]
    out = [(i, " ".join(w)) for i, w in enumerate(texts)]
    for i in range(pairs):
        w = list(texts[i])
        at = int(rng.integers(600, 640))
        w[at : at + 55] = [f"p{i}x{k}" for k in range(55)]
        out.append((10**6 + i, " ".join(w)))
    return out


def test_near_copies_in_large_buckets_are_all_found(spark):
    rows = _near_threshold(550, 150)
    own = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, t in rows for w in [t.split()]}
    assert 0.8 <= min(len(own[i] & own[10**6 + i]) / len(own[i] | own[10**6 + i]) for i in range(150)) < 0.85
    assert len(own[200] & own[201]) / len(own[200] | own[201]) < 0.77
    import corpus_pipeline as cp

    got = {r["doc_id"] for r in cp.simhash(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()}
    assert got == set(range(550))


def test_prefix_pairs_hold_every_similar_pair(spark):
    from loomgraph.llm import similar
    from loomgraph.llm.common import Scratch

    rng = np.random.default_rng(11)
    sets = {f"s{i:03d}": set(rng.integers(0, 60, int(rng.integers(1, 45))).tolist()) for i in range(150)}
    for i in range(60):
        x = set(sets[f"s{i:03d}"])
        for _ in range(int(rng.integers(0, 6))):
            x.symmetric_difference_update({int(rng.integers(0, 60))})
        sets[f"t{i:03d}"] = x or {1}
    texts = {c: " ".join(f"w{t}" for t in sorted(x)) for c, x in sets.items()}
    cls = {c: similar.digest(similar.shingles(t, 1)) for c, t in texts.items()}
    sets = {cls[c]: x for c, x in sets.items()}
    root = {cls[c]: c if int(c[1:]) % 7 else "one" for c in texts}
    rows = [(k, root[k], " ".join(f"w{t}" for t in sorted(x))) for k, x in sets.items()] + [("other", "two", "w1 w2")]
    got = {(r["a"], r["b"]) for r in similar.prefix_pairs(spark.createDataFrame(rows, "cls string, root string, text string"), 0.8, 1, Scratch(spark, "test")).collect()}
    want = {(a, b) for a in sets for b in sets if a < b and root[a] != root[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])}
    assert want and want <= got and len(got) < len(sets) ** 2 / 8


def test_simhash_of_few_words():
    from xxhash import xxh64_intdigest

    assert simhash.simhash64(None) == simhash.simhash64(" \n") == 0
    assert simhash.simhash64("A  b\tC") == xxh64_intdigest("a b c", 42)
    assert simhash.simhash64("É") == xxh64_intdigest("É", 42)


def test_bk_tree_links_connect_what_is_near():
    rng = np.random.default_rng(1)
    far = [int(x) for x in rng.integers(0, 2**63, 300)]
    flip = lambda v, n: v ^ sum(1 << int(k) for k in rng.choice(63, n, replace=False))
    dense = [flip(far[0], int(k)) for k in rng.integers(1, 4, 400)]
    values = list(dict.fromkeys(far + [flip(v, 2) for v in far[:80]] + dense))
    rng.shuffle(values)
    tree, up = simhash.BKTree(4), {v: v for v in values}

    def top(v):
        while up[v] != v:
            v = up[v]
        return v

    seen, links = [], 0
    for v in values:
        near = [w for w in seen if (v ^ w).bit_count() <= 4]
        hits = tree.add(v)
        assert all((v ^ w).bit_count() <= 4 for w in hits) and {top(w) for w in hits} == {top(w) for w in near} and len(hits) == len({top(w) for w in near})
        for w in hits:
            up[top(w)] = top(v)
        links += len(hits)
        seen.append(v)
    assert links == len(values) - len({top(v) for v in values})


def test_bk_tree_prunes():
    rng = np.random.default_rng(2)

    tree = simhash.BKTree(1)
    for v in rng.integers(0, 2**63, 2000).tolist():
        tree.add(v)
    visited, stack = 0, [tree.root]
    value = int(rng.integers(0, 2**63))
    while stack:
        node = stack.pop()
        visited += 1
        d = (node[0] ^ value).bit_count()
        stack += [c for k, c in node[1].items() if abs(k - d) <= 1]
    assert visited < 1000 and tree.hits(value) == {}


@pytest.mark.parametrize("blocks", [6, 7, 8])
def test_links_are_the_same_for_any_blocks(spark, blocks):
    rng = np.random.default_rng(2)
    base = [int(x) for x in rng.integers(-(2**63), 2**63, 40)]
    flip = lambda v, n: v ^ sum(1 << int(k) for k in rng.choice(63, n, replace=False))
    rows = [(v,) for v in {*base, *[flip(v, 4) for v in base], *[flip(v, 5) for v in base]}]
    links = simhash.hamming_links(spark.createDataFrame(rows, "fp long"), 4, blocks).collect()
    assert all(((r["a"] ^ r["b"]) & (2**64 - 1)).bit_count() <= 4 for r in links) and len(links) >= 40


def test_best_fit_packing():
    rng = np.random.default_rng(3)
    for open_bins in (3, 4096):
        fit, used, bins = packing.BestFit(100, open_bins), {}, 0
        for n in sorted(rng.integers(1, 101, 4000).tolist(), reverse=True):  # longest first, as ``pack`` feeds it
            b, at = fit.place(n)
            assert used.get(b, 0) == at and at + n <= 100
            used[b] = at + n
            bins = max(bins, b + 1)
        assert fit.open <= open_bins
        if open_bins > 100:
            assert sum(used.values()) / (100 * bins) > 0.97


def test_pieces():
    assert packing.pieces_of(1024) == [(0, 1024)] and packing.pieces_of(1025) == [(0, 1), (1, 1024)] and packing.pieces_of(1) == [(0, 1)]
    assert packing.pieces_of(3000) == [(0, 952), (952, 1024), (1976, 1024)]


def test_packing_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    docs = docs.unionByName(spark.createDataFrame([(None, "a b", None, None, None), (900001, None, None, None, None)], docs.schema))
    rows = packing.pack(docs, P.path("byte_bpe_50k.json"), packer_tokens=20000).collect()
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    for d in docs.collect():
        ids = np.array([*t.encode(d["text"] or "", add_special_tokens=False).ids, 2], dtype="<u4")
        mine = sorted((r for r in rows if r["doc_id"] == d["doc_id"]), key=lambda r: r["piece"])
        assert [r["piece"] for r in mine] == list(range(len(mine))) and sum(r["length"] for r in mine) == len(ids)
        assert all(zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] for r in mine)
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for s in by.values():
        s.sort()
        assert [a for a, _ in s] == [sum(n for _, n in s[:i]) for i in range(len(s))] and sum(n for _, n in s) <= 1024


ODD = ["", " ", "  a", "a  b", "a \n b", "a\n\n b c", "don't stop  ", "x \tb", "é à ", "a b c  d", "'s 't", "日本語 テスト 12,34", "a\n", "\x1c a\x85b", "zzqqxxjj" * 9, "😀😀 ok", " lead", "<|endoftext|> x", "a <|endoftext|><|endoftext|>b", None]


def test_split_cache_equals_the_library():
    from tokenizers import Tokenizer

    t, own = Tokenizer.from_file(P.path("byte_bpe_50k.json")), Tokens(P.path("byte_bpe_50k.json"))
    for _ in range(2):
        assert own.encode_bytes(ODD) == [np.array(t.encode(x or "", add_special_tokens=False).ids, dtype="<u4").tobytes() for x in ODD]


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))


def _library(ranks):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _same_as_the_library(spark, ranks, texts):
    from pyspark.sql import functions as F

    enc = _library(ranks)
    d = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "doc_id long, text string").coalesce(2)
    codec, e = bpe.encode_documents(d, ranks, P.PATTERN)
    rows = e.select("doc_id", "ids", codec.decode(F.col("ids")).alias("raw"), "packed").collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = enc.encode_ordinary(texts[r["doc_id"]] or "")
        assert r["ids"] == want and bytes(r["raw"]).decode() == (texts[r["doc_id"]] or "") and bytes(r["packed"]) == np.array(want, dtype="<u4").tobytes()


def test_bpe_equals_the_library_and_decodes(spark, sf, ranks, monkeypatch):
    texts = ODD + [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("n_chars").limit(25).collect()]
    _same_as_the_library(spark, ranks, texts)


def test_bpe_of_periodic_and_long_words(spark, ranks):
    rng = np.random.default_rng(4)
    periodic = ["".join(rng.choice(list(letters), n)) * k for letters in ("ab", "an", "abc", "eé") for n in range(1, 7) for k in (1, 2, 3, 5, 9)]
    started = __import__("time").time()
    _same_as_the_library(spark, ranks, [" ".join(periodic), "ab" * 50_000, "x" + "é" * 300 + " y", "".join(rng.choice(list("abcdefgh"), 3000)) + "\n\n" + "-" * 700])
    assert __import__("time").time() - started < 120
    enc = _library(ranks)
    assert all(bpe.merge_long(w.encode(), ranks) == enc.encode_ordinary(w) for w in periodic)


def test_bpe_words_are_forgotten_by_both_ends(ranks, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(bpe, "HELD", 2)
    monkeypatch.setattr(bpe, "ROWS", 2)
    enc = _library(ranks)
    texts = ["a b c d e b", "a b q", "zz a", None, "a b c d e f", "b q zz"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(texts)], ["id", "text"])
    out = list(bpe._splitter(ranks, P.PATTERN)(iter([batch])))
    assert [b.column("kept").to_pylist()[0] is None for b in out] == [True, False, False]
    assert np.frombuffer(out[1].column("kept")[0].as_py(), dtype=np.uint32).tolist() == [1]  # " b"; "a" at the start is another word than " a"

    def fold(w):  # what Spark does in between
        raw = b"".join(bpe_bytes[x & ((1 << bpe.BITS) - 1)] for x in w[1:-1])
        return [0, *[i + 1 for i in enc.encode_ordinary(raw.decode())], 0]

    bpe_bytes = {ranks[bytes([b])] + 1: bytes([b]) for b in range(256)}
    folded = [b.set_column(3, "new", pa.array([[fold(w) for w in ws] for ws in b.column("new").to_pylist()], pa.list_(pa.list_(pa.int64())))) for b in out]
    got = [ids for b in bpe._assembler(iter(folded)) for ids in b.column("ids").to_pylist()]
    assert got == [enc.encode_ordinary(t or "") for t in texts]


def test_warc_salvage():
    recs = [warc.record_bytes(i, "http://x/ y", b"p" * i * 50, warc.base32_sha1(b"p" * i * 50), i * 50) for i in range(6)]
    raw = bytearray(b"".join(recs))
    at = len(recs[0]) + len(recs[1]) + 20
    raw[at] ^= 0xFF
    raw[at + 1] ^= 0x55
    found = list(warc.salvage(bytes(raw)))
    assert [k for k, *_ in found] == ["record", "record", "gap", "record", "record", "record"]
    assert [a for _, a, _, _ in found] == [0, *[b for _, _, b, _ in found][:-1]] and found[-1][2] == len(raw)
    plain = b"".join(__import__("gzip").decompress(r) for r in recs)
    at = plain.index(b"p" * 50) + 7  # a payload byte: the header carries no check of its own
    broken = plain[:at] + b"?" + plain[at + 1 :]
    assert [k for k, *_ in warc.salvage(broken)].count("record") == 5
    assert [k for k, *_ in warc.salvage(b"junk" + recs[0] + recs[1][:30] + recs[2])] == ["gap", "record", "gap", "record"]
    assert list(warc.salvage(b"")) == [] and [k for k, *_ in warc.salvage(b"\x1f\x8b\x08zz")] == ["gap"]


def test_warc_round_trip_with_revisits(spark, tmp_path):
    rows = [(1, "http://a", "same"), (2, None, "same"), (3, "http://c\r\nX: y", "same"), (4, "u", None), (5, "u", ""), (6, "u", "é" * 5000), (None, "u", "same")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    manifest = warc.write_warc(pages, "file://" + str(tmp_path / "w"), archive_bytes=300).collect()
    assert sum(r["records"] for r in manifest) == 7
    got = [r for r in warc.read_warc(spark, "file://" + str(tmp_path / "w")).collect() if r["kind"] == "record"]
    by = {r["record_id"]: r for r in got}
    assert by["<urn:page:1>"]["refers_to"] == by["<urn:page:2>"]["refers_to"] == "<urn:page:3>" and by["<urn:page:3>"]["record_type"] == "response"
    assert by["<urn:page:4>"]["refers_to"] == "<urn:page:5>" and by["<urn:page:6>"]["payload_bytes"] == 10000 and bytes(by["<urn:page:6>"]["payload"]).decode() == "é" * 5000
    assert by["<urn:page:None>"]["record_type"] == "revisit" and by["<urn:page:1>"]["payload_bytes"] == 4


def test_warc_long_headers_and_members_of_several_records(spark, tmp_path):
    import gzip

    recs = [warc.record_bytes(i, "http://x/" + "y" * 70_000, b"p" * i, warc.base32_sha1(b"p" * i), i) for i in range(4)]
    member = gzip.compress(b"".join(gzip.decompress(r) for r in recs[:3]))
    found = list(warc.salvage(member + b"?" + recs[3]))
    assert [(k, a, b) for k, a, b, _ in found] == [("record", 0, len(member))] * 3 + [("gap", len(member), len(member) + 1), ("record", len(member) + 1, len(member) + 1 + len(recs[3]))]
    assert all(len(r["url"]) == 70_009 for k, *_, r in found if k == "record")
    folder = "file://" + str(tmp_path / "w")
    pages = spark.createDataFrame([("a b", "u" * 70_000, "x", 1), ("z", None, "x", 2), (None, "v", "y", 3)], "page_id string, url string, html string, sha1 int")
    assert sum(r["records"] for r in warc.write_warc(pages, folder).collect()) == 3
    got = {r["record_id"]: r for r in warc.read_warc(spark, folder).collect()}
    assert {r["kind"] for r in got.values()} == {"record"} and got["<urn:page:a%20b>"]["refers_to"] == "<urn:page:z>" and len(got["<urn:page:a%20b>"]["url"]) == 70_000
    (tmp_path / "w" / "broken.warc.gz").write_bytes(recs[1][:40] + recs[2])
    rows = warc.read_warc(spark, folder, payloads=False).where("archive = 'broken.warc.gz'").collect()
    assert sorted(r["kind"] for r in rows) == ["gap", "record"] and all(r["payload"] is None for r in rows)
    assert warc.write_warc(pages.limit(0), "file://" + str(tmp_path / "none")).count() == 0


def _auc(score, y):
    order = np.argsort(score)
    rank = np.empty(len(order))
    rank[order] = np.arange(1, len(order) + 1)
    p = y.sum()
    return (rank[y == 1].sum() - p * (p + 1) / 2) / (p * (len(y) - p))


@pytest.mark.parametrize("size, auc, found, wrong", [("sf0.01", 0.7, 0.55, 0.01), ("sf0.1", 0.95, 0.93, 0.01)])
def test_toxicity_held_out(spark, size, auc, found, wrong):
    d = f"/root/testdata/{size}"
    labels = spark.read.parquet(f"{d}/labels.parquet").toPandas().set_index("doc_id")["toxic"]
    got = toxicity.op1_toxicity(spark, d).toPandas().set_index("doc_id")
    assert got.score.between(0, 1).all() and (got.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got.index]).all()
    h = got[got.held_out].join(labels, how="inner")
    assert _auc(h.score.to_numpy(), h.toxic.to_numpy()) > auc  # 14 toxic documents at sf0.01, 6 of them without any mined sign
    assert h[h.toxic == 1].predicted.mean() > found and h[h.toxic == 0].predicted.mean() < wrong


def test_voters_sum_up_alike_on_spark_and_here(spark):
    rng = np.random.default_rng(7)
    rows = [(i, 10, sorted({int(v) for v in rng.integers(0, 5, 3)})) for i in range(200)]
    d = spark.createDataFrame([(i, n, v, [1] * len(v)) for i, n, v in rows], "id long, n int, voter array<int>, hits array<int>").repartition(3)
    votes = np.array([[int(k in v) for k in range(5)] for _, _, v in rows])
    y = rng.integers(0, 2, 30)
    corpus = toxicity.corpus_votes(d, np.zeros(5))
    far = toxicity.LabelModel().fit_over(votes[:30], np.ones(30), y, corpus, 3)
    near = toxicity.LabelModel().fit(np.vstack([votes[:30], votes]), np.ones(230), np.concatenate([y, np.full(200, -1)]), 3)
    assert np.allclose(far.p, near.p) and far.prior == pytest.approx(near.prior) and (far.parent == near.parent).all()
    brute = near.posterior(votes)
    a, b = corpus(near)
    assert np.allclose(b.one, (votes * brute[:, None]).sum(0)) and a.n + b.n == pytest.approx(200)


def test_toxicity_stage_drops_what_the_query_predicts(spark):
    import corpus_pipeline as cp

    d = "/root/testdata/sf0.01"
    clean = {r["doc_id"] for r in toxicity.op1_toxicity(spark, d).where("predicted = 0").collect()}
    assert {r["doc_id"] for r in cp.toxicity(spark, spark.read.parquet(f"{d}/documents.parquet"), d).collect()} == clean


def test_quality_held_out(spark):
    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet").toPandas().set_index("doc_id")["quality"]
    got = qc.op3_quality_classifier(spark, d).toPandas().set_index("doc_id")
    h = got[got.held_out].join(labels, how="inner")
    assert _auc(h.score.to_numpy(), h.quality.to_numpy()) > 0.95 and (h.predicted == h.quality).mean() > 0.9


def test_classifiers_on_empty_and_odd_tables(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "idiot"), (3, "x"), (3, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (None, None, None), (2, 7, 7)], "doc_id long, quality int, toxic int")
    assert toxicity.score_documents(docs, labels).count() == 5 and qc.score_documents(docs, labels).count() == 5
    assert toxicity.score_documents(docs.limit(0), labels).count() == 0 and qc.score_documents(docs.limit(0), labels.limit(0)).count() == 0
    assert toxicity.drop_toxic(docs, labels).columns == docs.columns


def test_label_model_discounts_copies_of_a_voter():
    rng = np.random.default_rng(5)
    y = rng.random(4000) < 0.3
    a = np.where(rng.random(4000) < 0.75, y, ~y)
    b = np.where(rng.random(4000) < 0.85, y, ~y)
    votes = np.stack([a, a, a, b], axis=1).astype(int)
    anchors = np.where(np.arange(4000) < 400, y.astype(int), -1)
    m = toxicity.LabelModel().fit(votes, np.ones(4000), anchors)
    assert (m.parent >= 0).sum() >= 2
    q = m.posterior(np.array([[1, 1, 1, 0], [0, 0, 0, 1]]))
    assert q[0] < q[1]  # one better voter against three copies of a worse one


def test_label_model_learns_its_tree_from_all_documents():
    rng = np.random.default_rng(4)

    def votes(n, y, pair):
        v = (rng.random((n, 6)) < np.where(y[:, None] == 1, 0.8, 0.1)).astype(np.int8)
        v[:, pair[1]] = v[:, pair[0]]
        return v

    y = (rng.random(400) < 0.3).astype(int)
    anchors = votes(400, y, (0, 1))  # among the anchors voters 0 and 1 are copies, in the corpus 4 and 5 are
    z = (rng.random(40_000) < 0.3).astype(int)
    corpus = votes(40_000, z, (4, 5))
    model = toxicity.LabelModel()
    both = lambda m: (lambda q: (toxicity.Votes.of(corpus, 1 - q), toxicity.Votes.of(corpus, q)))(m.posterior(corpus))
    model.fit_over(anchors, np.ones(400), y, both, 30)
    first = model._tree(tuple(toxicity.Votes.of(anchors, (y == c).astype(float)) for c in (0, 1)))
    linked = lambda tree, i, j: tree[i] == j or tree[j] == i
    assert linked(first, 0, 1) and not linked(first, 4, 5) and linked(model.parent, 4, 5) and toxicity.TREE_ROUNDS < model.rounds < 30
    assert ((model.posterior(corpus) > 0.5) == z).mean() > 0.95


def test_toxicity_with_clashing_columns(spark):
    rows = [(i, "you idiot moron" if i % 3 == 0 else f"a fine day number {i}", 5, "x", 1) for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, y int, __id string, n int")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(90)], "doc_id long, toxic int")
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and {r["doc_id"] % 3 for r in kept.collect()} == {1, 2}
    assert toxicity.score_documents(docs, labels).count() == 90


def test_nnpu_recovers_the_prior():
    rng = np.random.default_rng(6)
    p = rng.normal(2, 1, (1500, 2))
    u = np.vstack([rng.normal(2, 1, (2100, 2)), rng.normal(-2, 1, (900, 2))])
    w = qc.fit_nnpu(p, u, 0.7, l2=1e-3)
    s = lambda x: 1 / (1 + np.exp(-(x @ w[:-1] + w[-1])))
    assert (s(u[:2100]) > 0.5).mean() > 0.95 and (s(u[2100:]) < 0.5).mean() > 0.95
    hist = lambda x: np.histogram(s(x), 100, (0, 1))[0].astype(float)
    assert abs(qc.estimate_prior(hist(u), hist(p), 100) - 0.7) < 0.06


def test_pipeline_keeps_columns_and_clean_documents(spark, sf):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    toxic = cp.toxicity(spark, docs, sf)
    good = cp.quality_rules(spark, docs, sf)
    assert toxic.columns == good.columns == cp.line_dedup(spark, docs, sf).columns == docs.columns
    assert cp.line_dedup(spark, docs, sf).count() == docs.count() and toxic.count() > 0.8 * docs.count()
    assert [n for n, _ in cp.STAGES] == ["toxicity", "quality_rules", "line_dedup", "simhash", "packing"]
