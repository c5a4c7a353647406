"""Benchmark decontamination by a prefix-filtered set join.

An item is cut into windows of ``WINDOW`` words; a window is a set of word shingles, each at
its place.  A document holds a window if somewhere in it a stretch of the window's length has
(at the same places) a given share of the window's shingles, all of them by default.

Shingles of windows are ordered by rarity, their document frequency in the whole corpus.
If ``need`` of a window's ``m`` shingles must be found, one of its ``m - need + 1`` rarest is:
this prefix alone is joined with the documents.  A document's shingle that is a prefix token
fixes where in the document the window would lie (positional bound); it must lie in it wholly
(length bound); then the words of that stretch, which travel with the token, are compared with
the window's.

Documents go through two passes, for frequencies and for the join.  Both look shingles up in a
bitmap of the benchmark's tokens, of ``BITS`` bits at most whatever the benchmark's size; only
what it lets through leaves the task, so documents without a token of a benchmark cost no
shuffle.  Everything else is joins and grouping of these tokens.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, blanked_blocks, table

WINDOW = 10
SHINGLE = 5
#: Bits of the largest bitmap: 16 MB.
BITS = 1 << 27
#: Bytes of text that are hashed together, and rows of Arrow that go out together.
_GROUP, _ROWS = 1 << 20, 5000

#: Lower-cases A-Z and blanks what belongs to no word: of ASCII, letters and digits stay; other characters all do.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_R = 0x9E3779B97F4A7C15
_U = np.uint64


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, dtype=_U)
    out[0] = 1
    return np.cumprod(out, dtype=_U)


_UP, _DOWN = _powers(1, _R), _powers(1, _R)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(31))) * _U(0xBF58476D1CE4E5B9)
    return h ^ (h >> _U(29))


def _word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words of a blanked text; a word's hash depends on its bytes alone."""
    global _UP, _DOWN
    if len(_UP) <= len(data):
        _UP, _DOWN = _powers(len(data) + 1, _R), _powers(len(data) + 1, pow(_R, -1, 1 << 64))
    a = np.frombuffer(data, dtype=np.uint8)
    inside = np.concatenate(([False], a != 32, [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return starts, ends, np.zeros(0, dtype=_U)
    # a polynomial over the bytes; a word's own part of it is moved to the power zero
    sums = np.concatenate((np.zeros(1, dtype=_U), np.cumsum(a * _UP[: len(a)], dtype=_U)))
    return starts, ends, _mixed((sums[ends] - sums[starts]) * _DOWN[starts] + (ends - starts).astype(_U))


def _shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the runs of ``size`` words, by their first word."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=_U)
    h = np.full(n, size, dtype=_U)
    for k in range(size):
        h = h * _U(0xD6E8FEB86659FD93) + words[k : k + n]
    return _mixed(h)


class _Text:
    """Words of several texts, hashed together; a text has the words ``[bounds[i], bounds[i + 1])``."""

    def __init__(self, texts: list[bytes]):
        parts, offsets, at = [], [0], 0
        for t in texts:
            for block in blanked_blocks(t, _WORDS, _GROUP):
                parts.append(block)
                at += len(block)
            parts.append(b" ")
            at += 1
            offsets.append(at)
        self.data = b"".join(parts)
        found, at = [], 0
        for block in blanked_blocks(self.data, bytes(range(256)), 4 * _GROUP):
            s, e, h = _word_hashes(block)
            found.append((s + at, e + at, h))
            at += len(block)
        self.starts, self.ends, self.hashes = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, dtype=np.int64),) * 2 + (np.zeros(0, dtype=_U),)
        self.bounds = np.searchsorted(self.starts, offsets)

    def tokens(self, size: int, lets: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(text, first word, hash)`` of the shingles that a bitmap lets through; none runs over a text's end."""
        h = _shingles(self.hashes, size)
        at = np.flatnonzero(_in(lets, h)) if lets is not None else np.arange(len(h))
        text = np.searchsorted(self.bounds, at, side="right") - 1
        whole = at + size <= self.bounds[text + 1]
        return text[whole], at[whole], h[at[whole]]

    def words(self, first: int, last: int) -> str:
        """Words ``first`` to ``last`` (exclusive), with one blank between."""
        return b" ".join(self.data[self.starts[first] : self.ends[last - 1]].split()).decode("utf-8", "replace") if first < last else ""


def _in(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = h & _U(len(bits) * 8 - 1)
    return (bits[at >> _U(3)] >> (at & _U(7)).astype(np.uint8)) & 1 == 1


def _grouped(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, list[bytes]]]:
    """Texts of a batch in groups of about ``_GROUP`` bytes, with the row of the first."""
    first, texts, held = 0, [], 0
    for i, x in enumerate(batch.column(column)):
        texts.append(x.as_buffer().to_pybytes() if x.is_valid else b"")
        held += len(texts[-1])
        if held >= _GROUP:
            yield first, texts
            first, texts, held = i + 1, [], 0
    if texts:
        yield first, texts


def _signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def item_windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """``(item, words, n, at, token)``: every shingle of every window of every item.

    ``words`` are the window's words with a blank between, ``n`` their number, ``at`` the
    place of the shingle in the window.  Items of fewer words than ``window`` are one window,
    of fewer than ``shingle`` one shingle as well; items without words have none.
    """
    own = items.select(F.col(id_col).alias("item"), F.col(text_col).alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in _grouped(batch, 1):
                t, rows = _Text(texts), []

                def out() -> pa.RecordBatch:
                    of, words, n, at, token = zip(*rows)
                    return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of)), pa.array(words, pa.string()), pa.array(n, pa.int32()), pa.array(at, pa.int32()), pa.array(token, pa.int64())], names=["item", "words", "n", "at", "token"])

                for i in range(len(texts)):
                    a, b = int(t.bounds[i]), int(t.bounds[i + 1])
                    n = min(window, b - a)
                    if not n:
                        continue
                    tokens = _signed(_shingles(t.hashes[a:b], min(shingle, n))).tolist()
                    for w in range(a, b - n + 1):
                        words = t.words(w, w + n)
                        rows += [(first + i, words, n, k, tokens[w - a + k]) for k in range(max(n - shingle, 0) + 1)]
                        if len(rows) >= _ROWS:
                            yield out()
                            rows.clear()
                if rows:
                    yield out()

    return own.mapInArrow(cut, f"item {own.schema['item'].dataType.simpleString()}, words string, n int, at int, token long")


def token_bitmap(tokens: DataFrame, bits: int = BITS) -> np.ndarray:
    """A bitmap of the lowest bits of ``token``; as large as ``bits`` allows and 16 bits a token ask for.

    Made of blocks of 32,768 bits that tasks put together; what reaches the driver is the
    bitmap itself, ``bits`` at most.
    """
    n = tokens.agg(F.approx_count_distinct("token")).first()[0]
    size = 1 << 15
    while size < min(bits, 16 * n):
        size *= 2
    at = F.col("token").bitwiseAND(F.lit(size - 1)) + 1
    blocks = tokens.groupBy(F.bitmap_bucket_number(at).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits")).collect()
    out = np.zeros(size // 8, dtype=np.uint8)
    for r in blocks:
        out[(r["b"] - 1) * 4096 : r["b"] * 4096] = np.frombuffer(bytes(r["bits"]), dtype=np.uint8)
    return out


def document_frequencies(docs: DataFrame, text_col: str, bits: np.ndarray, sizes: list[int]) -> DataFrame:
    """``(token, docs)``: in how many documents a token is, for those that the bitmap lets through."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in _grouped(batch, 0):
                t = _Text(texts)
                for size in sizes:
                    text, _, h = t.tokens(size, shared.value)
                    one = np.unique(np.stack((text.astype(_U), h)), axis=1)[1] if len(h) else h
                    token, n = np.unique(one, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(_signed(token)), pa.array(n.astype(np.int64))], names=["token", "docs"])

    return docs.select(text_col).mapInArrow(count, "token long, docs long").groupBy("token").agg(F.sum("docs").alias("docs"))


def needed(n: Column, shingle: int, share: float) -> Column:
    """How many shingles of a window of ``n`` words must be found: ``share`` of them, rounded up, one at least."""
    m = F.greatest(n - shingle, F.lit(0)) + 1
    return F.greatest(F.ceil(F.round(m * F.lit(float(share)), 9)).cast("int"), F.lit(1))


def prefixes(windows: DataFrame, frequencies: DataFrame, shingle: int, share: float) -> DataFrame:
    """``(words, n, at, token)``: the rarest shingles of each distinct window, as many as the share needs.

    A window has ``WINDOW`` shingles at most, so a group is small; ties go by token and place.
    """
    of = frequencies.select(F.col("token").alias("t_"), "docs")
    each = windows.select("words", "n", "at", "token").distinct().join(of, F.col("token") == F.col("t_"), "left")
    order = F.sort_array(F.collect_list(F.struct(F.coalesce("docs", F.lit(0)).alias("docs"), "token", "at")))
    ranked = each.groupBy("words", "n").agg(order.alias("all"))
    rarest = F.slice("all", F.lit(1), F.size("all") - needed(F.col("n"), shingle, share) + 1)
    return ranked.select("words", "n", F.explode(rarest).alias("r")).select("words", "n", "r.at", "r.token")


def document_tokens(docs: DataFrame, id_col: str, text_col: str, bits: np.ndarray, sizes: list[int], window: int) -> DataFrame:
    """A row ``(row, id, n_words)`` for each row of ``docs``, and one for each of its tokens that the bitmap lets through.

    Those have ``(row, token, place, lead, here)``: the place of the token's first word in the
    document, and the words around it, ``lead`` of them before it, so that any window that it is
    part of lies in ``here`` if it lies in the document.  ``row`` tells rows apart; tokens leave
    the task as they are found, so a long document holds no more than its words.
    """
    shared = docs.sparkSession.sparkContext.broadcast(bits)
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    names = ["row", "id", "n_words", "token", "place", "lead", "here"]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 36
        for batch in batches:
            kind = batch.schema.field(0).type
            for first, texts in _grouped(batch, 1):
                t, k = _Text(texts), len(texts)
                none = [pa.nulls(k, x) for x in (pa.int64(), pa.int64(), pa.int32(), pa.string())]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + k)), batch.column(0).slice(first, k), pa.array(np.diff(t.bounds).astype(np.int64)), *none], names=names)
                for size in sizes:
                    text, at, h = t.tokens(size, shared.value)
                    start, end = t.bounds[text], t.bounds[text + 1]
                    low, high = np.maximum(start, at - window + size), np.minimum(end, at + window)
                    for i in range(0, len(at), _ROWS):
                        j = slice(i, i + _ROWS)
                        here = [t.words(x, y) for x, y in zip(low[j].tolist(), high[j].tolist())]
                        n = len(here)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(row + text[j]), pa.nulls(n, kind), pa.nulls(n, pa.int64()), pa.array(_signed(h[j])), pa.array(at[j] - start[j]), pa.array((at[j] - low[j]).astype(np.int32)), pa.array(here, pa.string())], names=names
                        )
                row += k

    return own.mapInArrow(find, f"row long, id {own.schema['id'].dataType.simpleString()}, n_words long, token long, place long, lead int, here string")


def _alike(mine: Column, theirs: Column, n: Column, shingle: int) -> Column:
    """How many shingles two stretches of ``n`` words have in common at the same places."""
    same = F.zip_with(mine, theirs, lambda x, y: x == y)
    size = F.least(n, F.lit(shingle))
    return F.size(F.filter(F.sequence(F.lit(1), n - size + 1), lambda k: F.forall(F.slice(same, k, size), lambda x: x)))


def contamination(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, shingle: int = SHINGLE, share: float = 1.0
) -> DataFrame:
    """``(id_col, n_words, n_hit, n_items, items, contaminated)``: a row for each row of ``docs``.

    Words are runs of ASCII letters and digits and of other characters, A-Z lower-cased.
    ``n_hit``: words that lie in a stretch that holds a window of an item; ``items``: the ids
    of those items as text, sorted.  ``share``: part of a window's shingles that must be
    there; with 1 all words are equal.

    A null text has no words; neither has an item that is null.  A null item id counts
    as the empty text among ``items``.  Items may be equal or share windows: each window is
    searched once.  Rows of ``docs`` may share an id or be equal: each has its own row.
    An empty table on either side gives no rows, or rows without hits.  Texts of any
    length are read whole; other columns are not looked at.  Writes windows, tokens and
    numbers of words (no whole texts) to the shared folder.
    """
    scratch = Scratch(docs.sparkSession, "decontamination")
    windows = scratch.keep(item_windows(items, item_col, item_text_col, window, shingle), "windows")
    sizes = sorted(r[0] for r in windows.select(F.least("n", F.lit(shingle))).distinct().collect())  # of shingles: ``shingle`` values at most
    seldom = prefixes(windows, document_frequencies(docs, text_col, token_bitmap(windows), sizes), shingle, share)
    seldom = scratch.keep(seldom, "prefixes")
    told = scratch.keep(document_tokens(docs, id_col, text_col, token_bitmap(seldom), sizes, window), "tokens")
    rows = told.where("n_words is not null").select("row", "id", "n_words")
    found = told.where("n_words is null").select("row", F.col("token").alias("t"), "place", "lead", "here")
    pairs = found.join(seldom, F.col("t") == F.col("token")).where(F.col("lead") >= F.col("at"))
    # a window's words begin at the token's place less its place in the window; they must all lie in the text
    mine = F.slice(F.split("here", " "), F.greatest(F.col("lead") - F.col("at") + 1, F.lit(1)), F.col("n"))
    pairs = pairs.select("row", "words", "n", (F.col("place") - F.col("at")).alias("start"), mine.alias("mine")).where(F.size("mine") == F.col("n"))
    if share == 1:
        held = pairs.where(F.array_join("mine", " ") == F.col("words"))
    else:
        held = pairs.where(_alike(F.col("mine"), F.split("words", " "), F.col("n"), shingle) >= needed(F.col("n"), shingle, share))
    held = scratch.keep(held.select("row", "words", "n", "start").distinct(), "held")
    # words of a stretch that no stretch before it in the document has
    before = F.max(F.col("start") + F.col("n")).over(Window.partitionBy("row").orderBy("start", "n", "words").rowsBetween(Window.unboundedPreceding, -1))
    new = F.col("start") + F.col("n") - F.greatest(F.col("start"), F.coalesce("before", F.lit(0).cast("long")))
    hits = held.select("row", "start", "n", before.alias("before")).groupBy("row").agg(F.sum(F.greatest(new, F.lit(0))).alias("n_hit")).withColumnRenamed("row", "r1")
    owners = windows.select(F.col("words").alias("w_"), F.coalesce(F.col("item").cast("string"), F.lit("")).alias("item")).distinct()
    named = held.select("row", "words").distinct().join(owners, F.col("words") == F.col("w_")).groupBy(F.col("row").alias("r2")).agg(F.sort_array(F.collect_set("item")).alias("items"))
    none = F.array().cast("array<string>")
    out = rows.select("row", "id", "n_words").join(hits, F.col("row") == F.col("r1"), "left").join(named, F.col("row") == F.col("r2"), "left")
    n_hit, listed = F.coalesce("n_hit", F.lit(0).cast("long")), F.coalesce("items", none)
    return out.select(F.col("id").alias(id_col), "n_words", n_hit.alias("n_hit"), F.size(listed).cast("long").alias("n_items"), listed.alias("items"), (n_hit > 0).alias("contaminated"))


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")
