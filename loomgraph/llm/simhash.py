"""SimHash near-duplicates: fingerprints, sharded BK-trees, components.

A document's fingerprint is the 64-bit majority vote of the XXH64 hashes of its
word shingles.  Two fingerprints link when they differ in at most ``radius`` bits.

Search.  Equal fingerprints are one class, so copies are never paired.  Classes
are dealt to shards by the pigeonhole rule: of ``blocks`` bit blocks, two linked
fingerprints agree on ``blocks - radius`` at least, so each class goes once to the
shard of every such choice of blocks, and every link is inside some shard.  A shard
is served by one task, which holds the shard's BK-tree (children keyed by their
Hamming distance to the parent) and follows only the edges within the radius.  The
tree stays in the task that owns the shard instead of going to all tasks: a tree over
all documents would have no size bound, and at radius 4 of 64 a single BK-tree
visits most of its nodes.  A subtree of one component is passed by once that
component is hit, so a dense group of near copies costs a few visits per member and
yields a spanning set of links, not all its pairs.

``blocks`` follows the number of classes, so that a shard of unrelated fingerprints
stays small at every size; the links found are the same for every choice.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, apart, table
from .graph import components

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_BLOCK = 1 << 15


def simhash64(text: str | None, shingle: int = 4, seed: int = 42) -> int:
    """Unsigned fingerprint of one text.

    A-Z are lowered, words are runs without ASCII white space, shingles (repeats
    included) are joined by one space; fewer words than ``shingle`` make one shingle,
    no words (or null) make 0.  A bit is set if it is set in over half the hashes.
    """
    from xxhash import xxh64_digest

    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    joined = memoryview(b" ".join(words))
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1)).tolist()
    ends = ends[min(shingle, len(words)) - 1 :].tolist()
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(ends), _BLOCK):
        raw = b"".join([xxh64_digest(joined[a:b], seed) for a, b in zip(starts[i : i + _BLOCK], ends[i : i + _BLOCK])])
        ones += np.unpackbits(np.frombuffer(raw, dtype=np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(ends)).tobytes(), "big")


def fingerprint_column(text: Column, shingle: int = 4, seed: int = 42) -> Column:
    """``simhash64`` of a text column, as a signed BIGINT with the same bits."""

    @F.pandas_udf(T.LongType())
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([simhash64(t, shingle, seed) for t in texts], dtype=np.uint64).view(np.int64))

    return of(text)


def fingerprint_hex(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


class BKTree:
    """A Burkhard-Keller tree over distinct unsigned 64-bit fingerprints that links what lies within ``radius``.

    A node is ``[value, children by distance, component, whether the subtree has only it]``.
    """

    __slots__ = ("radius", "root", "up")

    def __init__(self, radius: int):
        self.radius = radius
        self.root: list | None = None
        self.up: list[int] = []  # union-find over components

    def top(self, c: int) -> int:
        up = self.up
        while up[c] != c:
            up[c] = c = up[up[c]]
        return c

    def hits(self, value: int) -> dict[int, int]:
        """A stored fingerprint within the radius for each component that has one."""
        found: dict[int, int] = {}
        stack, radius, top = [self.root] if self.root else [], self.radius, self.top
        while stack:
            node = stack.pop()
            component = top(node[2])
            if node[3] and component in found:
                continue
            d = (node[0] ^ value).bit_count()
            if d <= radius:
                found.setdefault(component, node[0])
            children = node[1]
            for k in range(d - radius, d + radius + 1) if len(children) > 2 * radius else list(children):
                if abs(k - d) <= radius and (child := children.get(k)):
                    stack.append(child)
        return found

    def add(self, value: int) -> list[int]:
        """Stores ``value``; the fingerprints to link it with, one for each component that it joins."""
        found = self.hits(value)
        own, *others = list(found) or [len(self.up)]
        if not found:
            self.up.append(own)
        for c in others:
            self.up[c] = own
        node = self.root
        if node is None:
            self.root = [value, {}, own, True]
        while node:
            if node[3] and self.top(node[2]) != own:
                node[3] = False
            d = (node[0] ^ value).bit_count()
            child = node[1].get(d)
            if child is None:
                if d:
                    node[1][d] = [value, {}, own, True]
                break
            node = child
        return list(found.values())


def _shard_links(radius: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, tree, waiting = None, None, None
        for pdf in batches:
            keys, values = pdf["key"].to_numpy(), pdf["fp"].to_numpy().view(np.uint64)
            if not len(keys):
                continue
            cuts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            sizes = np.diff(np.append(cuts, len(keys)))
            a: list[int] = []
            b: list[int] = []
            for at, n in zip(cuts.tolist(), sizes.tolist()):
                if keys[at] != key:
                    key, tree, waiting = keys[at], None, None
                    if n == 1:  # alone as far as this batch shows: no tree yet
                        waiting = int(values[at])
                        continue
                if tree is None:
                    tree = BKTree(radius)
                    if waiting is not None:
                        tree.add(waiting)
                        waiting = None
                for v in values[at : at + n].tolist():
                    for hit in tree.add(v):
                        a.append(v)
                        b.append(hit)
            yield pd.DataFrame({"a": np.array(a, dtype=np.uint64).view(np.int64), "b": np.array(b, dtype=np.uint64).view(np.int64)})

    return run


def blocks_for(classes: int, radius: int, shard: int = 64) -> int:
    """The fewest blocks for which a shard of unrelated fingerprints has about ``shard`` members or fewer."""
    blocks = radius + 1
    while blocks < 2 * radius and classes > shard * 2 ** (64 * (blocks - radius) / blocks):
        blocks += 1
    return max(blocks, radius + 2) if radius else 1


def _masks(blocks: int, radius: int) -> list[int]:
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    parts = [((1 << edges[i + 1]) - (1 << edges[i])) for i in range(blocks)]
    masks = [sum(parts[i] for i in some) for some in combinations(range(blocks), blocks - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def hamming_links(fps: DataFrame, radius: int = 4, blocks: int = 6) -> DataFrame:
    """``(a, b)``: links that connect what lies within ``radius`` bits, over distinct ``fp``."""
    keys = F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m))) for i, m in enumerate(_masks(blocks, radius))])
    dealt = fps.select("fp", F.explode(keys).alias("key")).repartition("key").sortWithinPartitions("key", F.xxhash64("fp"))
    return dealt.mapInPandas(_shard_links(radius), "a long, b long").distinct()


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, seed: int = 42, radius: int = 4
) -> DataFrame:
    """``(id_col, fingerprint, component_id)``: a row for each row of ``docs``.

    ``component_id`` is the smallest id reachable over links, the row's own included.
    A null text is an empty one (fingerprint 0, linked like any other).  A null id
    gets a row, and is the component's id only where no member has another (null
    then).  Repeated rows are copies.  An empty table gives an empty result.  Other
    columns of ``docs`` are not looked at.  Writes fingerprints and links to the
    shared folder.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "simhash")
    fps = scratch.keep(docs.select(F.col(id_col).alias("id"), fingerprint_column(F.col(text_col), shingle, seed).alias("fp")), "fps")
    classes = scratch.keep(fps.groupBy("fp").agg(F.min("id").alias("rep")), "classes")
    links = scratch.keep(hamming_links(classes.select("fp"), radius, blocks_for(classes.count(), radius)), "links")
    joined = components(links, scratch)  # (node, root): only fingerprints with a link
    linked = classes.join(joined, classes.fp == joined.node).select("fp", "root", "rep")
    roots = linked.groupBy("root").agg(F.min("rep").alias("least"))
    moved = linked.select(F.col("fp").alias("fp_"), "root").join(roots, "root").select("fp_", "least")
    of_class = classes.join(moved, classes.fp == moved.fp_, "left").select(
        F.col("fp").alias("fp_"), F.when(F.col("fp_").isNull(), F.col("rep")).otherwise(F.col("least")).alias("component_id")
    )
    return fps.join(of_class, fps.fp == of_class.fp_).select(F.col("id").alias(id_col), fingerprint_hex(F.col("fp")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` with the smallest id of each component; columns as they were.

    Of rows that share that id, the one with the smallest text stays.  Rows without an id stay.
    """
    found = near_duplicates(docs, id_col, text_col, **how)
    stays = found.where(F.col(id_col) == F.col("component_id")).select(F.col(id_col).alias("stays"))
    return first_rows(docs, stays, id_col, text_col)


def first_rows(docs: DataFrame, stays: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Of the ids that ``stays(stays)`` names, the row with the smallest text each (null first); rows without an id as they are."""
    row, key, stay = apart(docs.columns, "__row", "__key", "__stay")
    order = F.struct(F.col(text_col).isNotNull(), F.col(text_col))
    named = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias(key), F.struct(*docs.columns).alias(row), order.alias(stay))
    ids = stays.select(F.col(stays.columns[0]).alias(f"{stay}_")).distinct()
    one = named.join(ids, F.col(key) == F.col(f"{stay}_"), "left_semi").groupBy(key).agg(F.min_by(row, stay).alias(row))
    return one.select(*[F.col(row)[c].alias(c) for c in docs.columns]).unionByName(docs.where(F.col(id_col).isNull()))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
