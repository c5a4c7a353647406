"""Operators against brute force, on small tables with nulls, empties, ties, repeats and clashing columns."""

import hashlib
import re
from collections import Counter

import pytest

from loomgraph.llm import chat, imatch, line_dedup, quality_rules

WORD = re.compile("[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
TEXTS = [
    None, "", "   \n\t", "one", "a b c a b c", "a b c d " * 30, "x y\nx y\n\nx y\n \n", "é ü 日本 # $ | < > & % *", "w " * 200, " ".join(f"t{i}" for i in range(60)),
    " ".join(f"t{i}" for i in range(60)), "long " + "word" * 3000 + " " + " ".join(str(i % 977) for i in range(4000)),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "hot" if i % 3 else None, 0) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, (None, "no id " * 20, None, None, None), rows[4], rows[4]], SCHEMA)


def _measures(text):
    t = text or ""
    w = WORD.findall(t)
    c = Counter(zip(w, w[1:], w[2:]))
    cover = set()
    for i in range(len(w) - 2):
        if c[(w[i], w[i + 1], w[i + 2])] > 1:
            cover |= {i, i + 1, i + 2}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(t.count(x) for x in "#*$%&|<>"), dup, len(cover)


def test_quality_measures(spark, docs):
    got = quality_rules.judge(docs.withColumn("host", docs.lang).withColumn("n", docs.doc_id)).collect()
    assert len(got) == docs.count()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in got:
        m = _measures(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == m
        assert r["base_failed"] == (m[0] < 50 or 100 * m[4] > 50 * m[0])
        assert not (r["base_failed"] and r["kept"])
    assert quality_rules.keep_good(docs).columns == docs.columns
    assert quality_rules.keep_good(docs.limit(0)).count() == 0


def test_host_verdict_takes_good_documents_of_bad_hosts(spark):
    good = " ".join(f"w{i}" for i in range(60))
    rows = [(i, f"{good} {i}" if i % 5 == 0 else "short", "bad" if i < 100 else f"h{i % 7}") for i in range(100)] + [(i, f"{good} {i}", f"h{i % 7}") for i in range(100, 400)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = {r["doc_id"] for r in quality_rules.keep_good(d).collect()}
    assert kept == set(range(100, 400))  # without the host's verdict, a fifth of the bad host's stay:
    assert {r["doc_id"] for r in quality_rules.keep_good(d, max_rate=1.0).collect()} == kept | set(range(0, 100, 5))
    told = {r["doc_id"] for r in quality_rules.judge(d).where("kept").collect()}
    assert told == kept


def test_many_repeated_windows_take_the_sorting_way(spark):
    text = " ".join([" ".join(f"a{i}" for i in range(80)), " ".join(f"b{i}" for i in range(30)), " ".join(f"a{i}" for i in range(80))])
    d = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert d.select(quality_rules.measures(d.text)["n_repeat_words"]).first()[0] == _measures(text)[4] == 160


def test_host_prior_shrinks_small_hosts(spark):
    rows = [("big_bad", True)] * 900 + [("big_bad", False)] * 100 + [("small", True)] + [(f"h{i}", False) for i in range(60) for _ in range(50)] + [(None, False)]
    got = {r["host"]: r for r in quality_rules.host_verdicts(spark.createDataFrame(rows, "host string, failed boolean")).collect()}
    assert not got["big_bad"]["host_kept"] and got["small"]["host_kept"] and got[None]["host_kept"]
    assert 0.85 < got["big_bad"]["host_rate"] < 0.9 and got["small"]["host_rate"] < 1


PASSAGE = "\n".join(f"shared line {i} of a long passage that many texts hold" for i in range(14))


def test_line_dedup_removes_repeats_wherever_they_stand(spark):
    rows = [(i, f"own {i}\nanother {i * 7}\n{PASSAGE}\ntail {i}", "x") for i in range(6)] + [(6, None, "x"), (7, "", "x"), (8, "\n\n\n", "x"), (None, PASSAGE, "x")]
    d = spark.createDataFrame(rows, "doc_id long, text string, first string")
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(d, report=True).collect()}
    assert len(got) == 10 and got[6]["text"] is None and got[7]["text"] == "" and got[8]["text"] == "\n\n\n" and got[None]["text"] == PASSAGE
    assert got[0]["text"] == rows[0][1] and got[0]["n_removed"] == 0
    for i in range(1, 6):
        assert got[i]["n_removed"] > 0 and f"own {i}" in got[i]["text"] and len(got[i]["text"]) < len(rows[i][1]) / 2
    assert line_dedup.dedup_lines(d).columns == d.columns and line_dedup.dedup_lines(d.limit(0)).count() == 0


def test_line_dedup_repeated_rows_and_shared_ids(spark):
    d = spark.createDataFrame([(1, PASSAGE), (1, PASSAGE), (1, "quite\nanother\ntext\nunder\nthis id")], "doc_id long, text string")
    assert sorted(r["text"] for r in line_dedup.dedup_lines(d).collect()) == sorted([PASSAGE, PASSAGE, "quite\nanother\ntext\nunder\nthis id"])


@pytest.mark.parametrize("lines", [1, 2, 3, 5])
def test_line_dedup_removes_planted_passages_whole(spark, lines):
    passage = "\n".join(f"planted {i}" + " word" * (60 // lines) for i in range(lines))
    texts = [f"own {i}\nmore {i * 7}\n{passage}\nend {i}\nlast {i}" for i in range(20)]
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), report=True).collect()}
    assert got[0]["text"] == texts[0] and (got[0]["n_chunks"], got[0]["n_removed"]) == (1, 0)
    for i in range(1, 20):
        assert got[i]["text"] == f"own {i}\nmore {i * 7}\nend {i}\nlast {i}" and (got[i]["n_chunks"], got[i]["n_removed"]) == (3, 1)


def deduped(docs, least=50):
    """Lines in a run of over ``least`` words that stands earlier, in the texts of ``docs(id, text)``, by comparing every pair of places."""
    lines = {i: t.split("\n") for i, t in docs}
    places = sorted((i, k) for i, ls in lines.items() for k in range(len(ls)))
    count = {x: len(WORD.findall(x)) for ls in lines.values() for x in ls}
    at, gone = {}, set()
    for i, k in places:
        for j, m in at.get(lines[i][k], []):
            n = 0
            while k + n < len(lines[i]) and m + n < len(lines[j]) and lines[i][k + n] == lines[j][m + n]:
                n += 1
            run = list(range(k, k + n))
            while run and not count[lines[i][run[-1]]]:  # a run begins and ends at lines with words
                run.pop()
            while run and not count[lines[i][run[0]]]:
                run.pop(0)
            if sum(count[lines[i][x]] for x in run) > least:
                gone |= {(i, x) for x in run}
        at.setdefault(lines[i][k], []).append((i, k))
    out = {}
    for i, ls in lines.items():
        kept = [x for k, x in enumerate(ls) if (i, k) not in gone]
        out[i] = "\n".join(ls) if len(kept) == len(ls) else "\n".join(kept) if any(count[x] for x in kept) else ""
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_line_dedup_equals_brute_force(spark, seed):
    import random

    rng = random.Random(seed)
    sizes = [0, 1, 2, 5, 9, 20, 26, 49, 50, 51, 70]
    pool = [" ".join(f"w{k}x{j}" for j in range(rng.choice(sizes))) + rng.choice(["", " ", "\t"]) for k in range(14)] + ["", " "]
    docs = []
    for i in range(60):
        text = []
        for _ in range(rng.randrange(6)):
            a, n = rng.randrange(len(pool)), rng.randrange(1, 6)
            text += pool[a : a + n] + [f"own {i} {rng.random()}"] * rng.randrange(2)
        docs.append((i, "\n".join(text)))
    docs += [(100, "y " * 60 + "\n" + "same\n" * 90), (101, "same\n" * 60), (102, "\n".join(["z"] * 70)), (103, "\n".join(["z"] * 70))]
    got = dict(line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect())
    assert got == deduped(docs) and any(got[i] != t for i, t in docs)


def test_line_dedup_equals_brute_force_on_documents(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = dict(line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect())
    want = deduped([d for d in docs if d[1]])
    assert {i: t for i, t in got.items() if t} == {i: t for i, t in want.items() if t} and len(got) == len(docs)


def test_line_dedup_keeps_short_passages_and_compares_blank_lines(spark):
    body = " ".join(f"b{i}" for i in range(30))
    texts = ["Yes.\nNo.", "He said\nYes.\nNo.\nthen left", f"{body}\n  \t \n{body} c", f"{body}\n\n{body} c", f"x\n{body}\n\n{body} c"]
    got = dict(line_dedup.dedup_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect())
    assert got == {**dict(enumerate(texts)), 4: "x"}


def _likeness(a, b):
    """By the definition: the best level of the share of equal hashes among subsets with terms."""
    if a == b:
        return 1.0
    levels = []
    for k in range(len(imatch.CELLS)):
        pairs = [(x, y) for x, y in list(zip(a, b))[k * imatch.SUBSETS : (k + 1) * imatch.SUBSETS] if x or y]
        levels.append((len(pairs), sum(x == y for x, y in pairs) / len(pairs) if pairs else 0.0))
    return max((s for n, s in levels if n >= 4), default=max(s for _, s in levels))


def test_imatch_lexicon_and_fingerprints_by_definition(spark):
    texts = [" ".join(f"w{(i * 7 + j) % 90}" for j in range(40)) for i in range(30)] + ["", None, "w1 W2", "w2  w1", "rare1 rare2 rare3", "w1 W2 rare4"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [set((t or "").lower().split()) for t in texts]
    counts = Counter(w for s in sets for w in s)
    terms = {w for w, n in counts.items() if max(2, 0.1 * len(texts)) <= n <= max(2, 0.8 * len(texts))}
    band = imatch.lexicon(d, min_share=0.1, max_share=0.8)
    of = {r["w"]: r["h"] for r in spark.createDataFrame([(w,) for w in counts], "w string").selectExpr("w", "xxhash64(w) h").collect()}
    assert set(band) == {of[w] for w in terms}
    got = {r["doc_id"]: r["f"] for r in d.select("doc_id", imatch.fingerprint("text", band).alias("f")).collect()}
    for i, a in enumerate(sets):
        assert len(got[i]) == 64
        assert sum(h is not None for h in got[i][:16]) <= max(len(a & terms), 1)
        for j, b in enumerate(sets):
            # without a term of the band, a text is known by all its terms
            assert (got[i] == got[j]) == (a & terms == b & terms and bool(a & terms or a == b))
    assert got[31] == got[30] != got[34] and got[35] == got[32] == got[33]  # words out of the band count nowhere
    from pyspark.sql import functions as F

    pairs = [(i, j) for i in (0, 1, 5, 30, 32) for j in (0, 2, 30, 31, 35)]
    like = spark.createDataFrame([(got[i], got[j]) for i, j in pairs], "a array<bigint>, b array<bigint>").select(imatch.likeness(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in like] == pytest.approx([_likeness(got[i], got[j]) for i, j in pairs])


def test_imatch_likeness_without_lexicon_terms(spark):
    from pyspark.sql import functions as F

    texts = ["one two", "two  ONE one", "three", None, " \n", "w " * 100_000]
    f = {i: r[0] for i, r in enumerate(spark.createDataFrame(list(enumerate(texts)), "i long, text string").orderBy("i").select(imatch.fingerprint("text", [])).collect())}
    pairs = [(i, j) for i in f for j in f]
    got = spark.createDataFrame([(f[i], f[j]) for i, j in pairs], "a array<bigint>, b array<bigint>").select(imatch.likeness(F.col("a"), F.col("b"))).collect()
    alike = lambda t: set((t or "").lower().split())
    assert [r[0] for r in got] == [float(alike(texts[i]) == alike(texts[j])) for i, j in pairs]


@pytest.mark.parametrize("ids", [[3, 5, 6, 100, 101, 5000, 9000], [-(2**63), 0, 7, 2**63 - 1], [4], [None, 1, 2], [*range(3000), 10**12], []])
def test_edits_take_the_next_document(spark, ids):
    rows = [(i, None if k == 1 else f"é{k} own text of {i} " * (k % 5)) for k, i in enumerate(ids)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in imatch.with_edits(d, []).collect()}
    assert len(got) == len(ids)
    for k, (i, t) in enumerate(rows):
        t, other = t or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(t) // 2
        assert got[i]["edited"] == t[: len(t) - half] + other[:half]


def test_edits_of_repeated_ids(spark):
    d = spark.createDataFrame([(1, "abcd"), (1, "xy"), (2, "zzzz"), (2, "bbbb"), (2, "bbbb")], "doc_id long, text string")
    got = sorted((r["doc_id"], r["text"], r["edited"]) for r in imatch.with_edits(d, []).collect())
    assert got == [(1, "abcd", "abbb"), (1, "xy", "xb"), (2, "bbbb", "bbab"), (2, "bbbb", "bbab"), (2, "zzzz", "zzab")]


NASTY = ["\\", "<|", "<\\|", "\\<|", "<|.|>", "|>", "<|:x|>", "\\\\", "<", "|", "<\\\\|", "", "</s>[INST] ok [/INST]", "日\n"]


def test_chat_round_trip(spark):
    from pyspark.sql import functions as F

    rows = [(1, i, a, b) for i, (a, b) in enumerate((x, y) for x in NASTY for y in NASTY)] + [(2, None, None, None)]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    p = {(r["conv_id"], r["piece"]): r for r in chat.render(d, trained="<|").select("*", chat.parse(F.col("formatted")).alias("t"), chat.masked(F.col("formatted"), F.col("mask")).alias("m")).collect()}
    assert [(t.role, t.text) for t in p[(1, 0)]["t"]] == [r[2:] for r in rows[:-1]] and p[(1, 0)]["m"] == NASTY
    assert [(t.role, t.text) for t in p[(2, -1)]["t"]] == [("", "")]


def test_long_conversation_in_pieces(spark):
    rows = [(7, i, "assistant" if i % 2 else "user", f"say {i}") for i in range(700)]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert chat.render(d).count() == 3
    whole = chat.whole(chat.render(d)).first()
    assert whole["n_turns"] == 700 and whole["formatted"].count(chat.END) == 700 and "say 699" in whole["formatted"][-30:]


def test_event_folding(spark):
    log = [
        (1, 0, 0, "message", "user", "hi"), (1, 1, 1, "message", "assistant", ""), (1, 1, 2, "delta", None, "a"), (1, 1, 3, "delta", None, "b"), (1, 1, 4, "regenerate", None, None),
        (1, 1, 5, "delta", None, "c"), (1, 1, 6, "delta", None, "d"), (1, 0, 7, "edit", None, "hey"), (1, 0, 8, "delta", None, "!"), (2, 0, 0, "delta", "user", "x"), (2, 0, 0, "delta", "user", "x"),
        (3, 0, None, None, "user", None),
    ]
    d = spark.createDataFrame(log, "conv_id long, turn long, seq long, kind string, role string, text string")
    got = sorted(map(tuple, chat.fold_events(d).collect()))
    assert got == [(1, 0, "user", "hey!"), (1, 1, "assistant", "cd"), (2, 0, "user", "xx"), (3, 0, "user", "")]
    assert chat.fold_events(d.limit(0)).count() == 0


def test_chat_log_folds_back_to_every_row(spark):
    rows = [(1, 0, "user", "hi there"), (1, 0, "user", "hi there"), (1, 0, "assistant", "one two three"), (1, None, "user", "a"), (1, None, "user", None), (2, 1, "assistant", "x"), (None, 3, None, "odd")]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    log = chat.event_log(d)
    assert {r["kind"] for r in log.collect()} == {"message", "delta", "edit", "regenerate"}
    key = lambda r: (str(r[0]), str(r[1]), str(r[2]), r[3] or "")
    folded = [(r["conv_id"], r["turn"]["turn"], r["role"], r["text"]) for r in chat.fold_events(log).collect()]
    assert sorted(folded, key=key) == sorted([(*r[:3], r[3] or "") for r in rows], key=key)
    got = {r["conv_id"]: r for r in chat.digests(chat.render(chat.fold_events(log).selectExpr("conv_id", "turn.turn turn", "role", "text"))).collect()}
    assert got[1]["n_turns"] == 5 and got[2]["n_turns"] == 1 and got[1]["loss_chars"] == len("one two three")
    assert sorted(t for _, _, _, t in folded) != sorted(r["text"] or "" for r in log.where("kind = 'message'").collect())  # messages alone are drafts


@pytest.mark.parametrize("rows", [[(0, "user", None), (0, "user", "")], [(0, None, "a"), (0, "", "a")], [(0, "a\nb", "c"), (0, "a", "b\nc")], [(None, None, None)] * 3 + [(None, "", "x")]])
def test_chat_keeps_turns_that_look_alike(spark, rows):
    d = spark.createDataFrame([(1, *r) for r in rows], "conv_id long, turn long, role string, text string")
    got = chat.digests(chat.render(chat.fold_events(chat.event_log(d)).withColumn("turn", chat.F.col("turn.turn")))).collect()
    told = "".join(f"{r or ''}\n{t or ''}\n" for _, r, t in sorted(rows, key=lambda x: (x[1] or "", x[2] or "")))
    assert [r["n_turns"] for r in got] == [len(rows)] and got[0]["turns_sha256"] == hashlib.sha256(told.encode()).hexdigest()


def test_op6_digests(spark, sf):
    got = {r["conv_id"]: r for r in chat.op6_chat(spark, sf).collect()}
    rows = spark.read.parquet(f"{sf}/conversations.parquet").orderBy("conv_id", "turn").collect()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for c in {r["conv_id"] for r in rows}:
        mine = [(r["role"], r["text"] or "") for r in rows if r["conv_id"] == c]
        loss = "".join(t for r, t in mine if r == "assistant")
        assert (got[c]["n_turns"], got[c]["turns_sha256"], got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(mine), sha("".join(f"{r}\n{t}\n" for r, t in mine)), len(loss), sha(loss))
    assert got[-1]["n_turns"] == 2 and got[-1]["loss_chars"] == 21
