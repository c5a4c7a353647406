"""The SimHash operator at an exact threshold on the Jaccard similarity of word shingles.

Documents with equal shingle sets are one class.  Candidates are, first, what the sharded
BK-trees of ``simhash`` link: classes whose fingerprints differ in ``RADIUS`` bits at most.
Of pairs of similarity 0.8 these are few (their distances have a median of 8 or 9 of 64
bits, at which no choice of blocks leaves small shards), so classes that share a band of
min-hashes are candidates as well: with ``BANDS`` bands of ``ROWS``, a pair of similarity
0.8 shares none with a chance of 2e-4, and likelier ones less.  Each candidate pair is
verified by the shingles of both texts (as 64-bit hashes), so nothing below the threshold
links.

A first pass pairs each member of a bucket with the one before it, which with the
fingerprints' links connects large groups.  Further ones look at buckets whose members are
still apart, and their links are followed between the roots so far alone.  Of a bucket
of ``WIDE`` members or fewer, all pairs are asked; in larger ones, a member meets the ``NEAR``
before it.  Those that are in large buckets of several components even then, whatever their
number, go through an exact join: shingles are ordered by rarity among these texts;
a text's rarest shingles (as many as the similarity leaves to differ) must hold one that a
similar text has among its own, so only those are joined, and the shorter text of a pair
gives the fewer of them.  No bucket is cut and no pair above the threshold passed over.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .decontamination import _in, token_bitmap
from .graph import components
from .simhash import blocks_for, first_rows, hamming_links

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
BANDS, ROWS = 16, 4
RADIUS = 4
WIDE, NEAR = 32, 8
_PART = 1 << 10
_RNG = np.random.default_rng(7)
_A = _RNG.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)


def shingles(text: str | None, shingle: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the shingles; words as ``simhash64`` has them, too few for a shingle make one, none make none."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    joined = memoryview(b" ".join(words))
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1)).tolist()
    ends = ends[min(shingle, len(words)) - 1 :].tolist()
    return np.unique(np.array([xxh64_intdigest(joined[a:b]) for a, b in zip(starts, ends)], dtype=np.uint64))


def vote(found: np.ndarray) -> int:
    """The majority vote of hashes, as a signed 64-bit fingerprint; 0 for none."""
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(found), 1 << 15):
        ones += np.unpackbits(found[i : i + (1 << 15)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(found)).tobytes(), "big", signed=True)


def digest(found: np.ndarray) -> str:
    from xxhash import xxh3_128_hexdigest

    return xxh3_128_hexdigest(found.tobytes())


def bands(found: np.ndarray) -> list[int]:
    """A key for each band of min-hashes; none for an empty set."""
    from xxhash import xxh64_intdigest

    if not len(found):
        return []
    least = np.min([(found[i : i + _PART, None] * _A + _B).min(axis=0) for i in range(0, len(found), _PART)], axis=0)
    return np.array([xxh64_intdigest(least[k * ROWS : (k + 1) * ROWS].tobytes(), k) for k in range(BANDS)], dtype=np.uint64).view(np.int64).tolist()


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(len(a) + len(b) - both, 1)


def _sketches(shingle: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [shingles(t, shingle) for t in pdf["text"]]
            yield pd.DataFrame({"id": pdf["id"], "cls": [digest(x) for x in found], "n": [len(x) for x in found], "fp": [vote(x) for x in found], "keys": [bands(x) for x in found]})

    return run


def _window_pairs(width: int, similarity: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, last = None, deque(maxlen=width)
        for pdf in batches:
            out = []
            for k, c, n, root in zip(pdf["key"], pdf["cls"], pdf["n"], pdf["root"]):
                if k != key:
                    key = k
                    last.clear()
                # sizes too far apart can't be that similar
                out += [(min(c, d), max(c, d)) for d, m, other in last if other != root and min(n, m) >= similarity * max(n, m) - 1e-9]
                last.append((c, n, root))
            yield pd.DataFrame(out, columns=["a", "b"], dtype=object)

    return run


def _verified(similarity: float, shingle: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for a, b, s, t in zip(pdf["a"], pdf["b"], pdf["ta"], pdf["tb"]):
                x, y = shingles(s, shingle), shingles(t, shingle)
                # rows that share an id may bring another text: not that of the class
                if jaccard(x, y) >= similarity - 1e-12 and digest(x) == a and digest(y) == b:
                    out.append((a, b))
            yield pd.DataFrame(out, columns=["a", "b"], dtype=object)

    return run


def _fingerprint_pairs(classes: DataFrame) -> DataFrame:
    """``(a, b)``: classes whose fingerprints are equal or linked; of equal ones, each with the smallest."""
    fps = classes.groupBy("fp").agg(F.min("cls").alias("least"))
    links = hamming_links(fps.select("fp"), RADIUS, blocks_for(fps.count(), RADIUS))
    named = links.join(fps.select(F.col("fp").alias("a"), F.col("least").alias("ca")), "a").join(fps.select(F.col("fp").alias("b"), F.col("least").alias("cb")), "b").select("ca", "cb")
    equal = classes.join(fps, "fp").where("cls <> least").select(F.col("least").alias("ca"), F.col("cls").alias("cb"))
    return named.unionByName(equal).select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b"))


def _own(pdf: pd.DataFrame, shingle: int) -> Iterator[tuple[str, str, np.ndarray]]:
    """Shingles of the texts that are those of their classes: rows that share an id may bring another one."""
    for cls, root, text in zip(pdf["cls"], pdf["root"], pdf["text"]):
        found = shingles(text, shingle)
        if digest(found) == cls:
            yield cls, root, found


def _counted(shingle: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            token, n = np.unique(np.concatenate([np.zeros(0, dtype=np.uint64), *(x for *_, x in _own(pdf, shingle))]), return_counts=True)
            yield pd.DataFrame({"token": token.view(np.int64), "df": n})

    return run


def _prefixes(levels, similarity: float, shingle: int):
    """The rarest shingles of each text that others have as well; ``index`` tells the fewer ones."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        least = lambda share, n: int(np.ceil(round(share * n, 6)))
        for pdf in batches:
            for cls, root, found in _own(pdf, shingle):
                n, often = len(found), sum(_in(b, found).astype(np.int8) for b in levels.value)
                first = np.lexsort((found, often))[: n - least(similarity, n) + 1]
                place = np.arange(len(first))
                index = place < n - least(2 * similarity / (1 + similarity), n) + 1
                some = often[first] > 0
                yield pd.DataFrame({"cls": cls, "root": root, "n": n, "token": found[first][some].view(np.int64), "place": place[some], "index": index[some]})

    return run


#: Shingles are ordered by how many of these numbers of texts they are in.
OFTEN = (2, 4, 16, 128, 1024)


def prefix_pairs(texts: DataFrame, similarity: float, shingle: int, scratch: Scratch) -> DataFrame:
    """``(a, b)`` among ``texts(cls, root, text)`` of different roots: all that can have the similarity.

    Texts of ``n`` and ``m <= n`` shingles need ``s / (1 + s) (n + m)`` in common: ``s n`` at least, as
    ``m >= s n``, and ``2 s / (1 + s) m``.  So, in any order that is the same for all, the first
    ``n - s n + 1`` of the longer and ``m - 2 s / (1 + s) m + 1`` of the shorter share one.  The
    order is by rarity, in steps that bitmaps of a bounded size tell (a shingle that they
    take for a more frequent one is so for all texts), so the prefixes are cut where the texts are read
    and nothing but them is shuffled.
    """
    spark = texts.sparkSession
    counts = scratch.keep(texts.mapInPandas(_counted(shingle), "token long, df long").groupBy("token").agg(F.sum("df").alias("df")).where(F.col("df") >= OFTEN[0]), "often")
    levels = spark.sparkContext.broadcast([token_bitmap(counts.where(F.col("df") >= k), 1 << 26) for k in OFTEN])
    cut = scratch.keep(texts.mapInPandas(_prefixes(levels, similarity, shingle), "cls string, root string, n int, token long, place int, index boolean"), "prefixes")
    probe = cut.select("cls", "root", "n", "token", "place")
    index = cut.where("index").select(F.col("cls").alias("cls_"), F.col("root").alias("root_"), F.col("n").alias("m"), F.col("token").alias("token_"), F.col("place").alias("place_"))
    shorter = (F.col("m") < F.col("n")) | ((F.col("m") == F.col("n")) & (F.col("cls_") < F.col("cls")))
    close = F.col("m") >= F.col("n") * F.lit(similarity) - 1e-6
    # from the first shingle that two texts share on, both must have as many left as they need in common
    left = F.least(F.col("n") - F.col("place"), F.col("m") - F.col("place_")) >= (F.col("n") + F.col("m")) * F.lit(similarity / (1 + similarity)) - 1e-6
    pairs = probe.join(index, (F.col("token") == F.col("token_")) & shorter & close & left & (F.col("root") != F.col("root_")))
    return pairs.select(F.least("cls", "cls_").alias("a"), F.greatest("cls", "cls_").alias("b")).distinct()


def _linked_on(joined: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """``(node, root)`` after more links: only the roots that they connect are gone through."""
    roots = links
    for side in ("a", "b"):
        of = joined.select(F.col("node").alias("node_"), F.col("root").alias("root_"))
        roots = roots.join(of, F.col(side) == F.col("node_"), "left").withColumn(side, F.coalesce("root_", side)).select("a", "b")
    more = scratch.keep(components(roots.distinct(), scratch), "more")
    moved = joined.join(more.select(F.col("node").alias("node_"), F.col("root").alias("root_")), F.col("root") == F.col("node_"), "left").select("node", F.coalesce("root_", "root").alias("root"))
    return moved.unionByName(more.join(joined.select(F.col("node").alias("node_")), F.col("node") == F.col("node_"), "left_anti"))


def drop_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs`` with the smallest id of each component of similar texts; columns as they were.

    Of rows that share that id, the one with the smallest text stays.  Rows without an id
    stay and link nothing.  Null texts and those without words are copies of each other.
    Texts of any length are compared whole; an empty table stays empty.  Writes sketches,
    pairs and links to the shared folder.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "similar")
    own = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = own.schema["id"].dataType.simpleString()
    sketches = scratch.keep(own.mapInPandas(_sketches(shingle), f"id {kind}, cls string, n int, fp long, keys array<long>"), "sketches")
    classes = scratch.keep(sketches.groupBy("cls").agg(F.min("id").alias("rep"), F.min("fp").alias("fp")), "classes")
    dealt = sketches.select("cls", "n", F.explode("keys").alias("key")).distinct()
    shared = dealt.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c >= 2").select("key")
    members = scratch.keep(dealt.join(shared, "key", "left_semi"), "members")

    def window_pairs(rows: DataFrame, width: int) -> DataFrame:
        order = rows.select("key", "cls", "n", "root").repartition("key").sortWithinPartitions("key", F.xxhash64("key", "cls"))
        return order.mapInPandas(_window_pairs(width, similarity), "a string, b string")

    def text_of(some: DataFrame) -> DataFrame:
        """Texts of classes, by their smallest ids."""
        return own.join(some.join(classes.select("cls", "rep"), "cls"), F.col("id") == F.col("rep")).drop("id", "rep")

    def verified(near: DataFrame) -> DataFrame:
        pairs = scratch.keep(near.distinct(), "pairs")
        texts = scratch.keep(text_of(pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct()), "texts")
        left, right = texts.select(F.col("cls").alias("a"), F.col("text").alias("ta")), texts.select(F.col("cls").alias("b"), F.col("text").alias("tb"))
        found = pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb").mapInPandas(_verified(similarity, shingle), "a string, b string")
        links = scratch.keep(found.distinct(), "links")
        scratch.drop(pairs, texts)
        return links

    first = window_pairs(members.withColumn("root", F.col("cls")), 1).unionByName(_fingerprint_pairs(classes))
    joined = scratch.keep(components(verified(first), scratch), "joined")

    def apart_still(joined: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Members of buckets that hold more than one component yet, of small buckets and of large ones."""
        rooted = members.join(joined, members.cls == joined.node, "left").select("key", "cls", "n", F.coalesce("root", "cls").alias("root"))
        sizes = scratch.keep(rooted.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.min("root").alias("r"), F.max("root").alias("s")).where("r <> s").select("key", "c"), "sizes")
        of = lambda some: rooted.join(sizes.where(some).select("key"), "key", "left_semi")
        return of(F.col("c") <= WIDE), of(F.col("c") > WIDE)

    few, many = apart_still(joined)
    joined = scratch.keep(_linked_on(joined, verified(window_pairs(few, WIDE - 1).unionByName(window_pairs(many, NEAR))), scratch), "joined")
    _, many = apart_still(joined)
    asked = scratch.keep(text_of(many.select("cls", "root").distinct()).select("cls", "root", "text"), "asked")
    joined = scratch.keep(_linked_on(joined, verified(prefix_pairs(asked, similarity, shingle, scratch)), scratch), "joined")
    of_class = classes.join(joined, classes.cls == joined.node, "left").select(F.coalesce("root", "cls").alias("root"), "rep")
    stays = of_class.groupBy("root").agg(F.min("rep").alias("stays")).select("stays")
    return first_rows(docs, stays, id_col, text_col)
