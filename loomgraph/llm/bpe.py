r"""Byte-level BPE encoding and decoding.

A text is split by the tokenizer's pattern.  A word is encoded by folding ranked merges
over its array of bytes, in Spark higher-order functions: the leftmost pair of least rank
becomes one part, until no pair has a rank.  Ranks are a literal map in the plan, by
the ids of both parts.  A part is one number, the rank of the pair that it starts and its
own id, so that the least number of the array is the next merge.

Each task folds its distinct words once.  The splitter numbers the words of its partition
and hands on the byte array of a word with the first document that has it; the fold turns
new words to ids; the assembler, next in the same task, keeps them by number and puts
documents together.  No word or text is shuffled, nothing but the rank map passes the
driver, and a lost executor costs its own tasks.  When ``HELD`` words are known, both ends
keep those that came more than once, half of ``HELD`` at most, and forget the others, which
are folded anew if they come back: memory is bounded.  A word of over ``LONGEST`` bytes, for which an array rewritten at every merge would take quadratic
time, is merged with a heap.  Decoding looks up each id's bytes and concatenates them.
"""

from __future__ import annotations

import base64
import heapq
import json
import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ship, table
from .tokens import SPLIT

HELD = 300_000
LONGEST = 256
ROWS = 512
#: A task reads about so much, where splits are smaller.
TASK_BYTES = 128 << 20
#: A part: the id of the pair that it starts (from 1; ``NONE`` where that pair has no rank) above ``BITS``, its own id (from 1; 0: beyond the ends) below.
BITS = 20
NONE = 1 << 42
#: A space beside other white space, or at the end.
SPACES = re.compile(r" (?:(?=\s)|(?<=\s )|\Z)")


def let(value: Column, use) -> Column:
    return F.try_element_at(F.transform(F.array(value), use), F.lit(1))


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _literal(value, kind: str) -> Column:
    """A literal of any size in one piece: JSON that the optimizer folds."""
    return F.from_json(F.lit(json.dumps(value, separators=(",", ":"))), kind)


def pair_parts(ranks: dict[bytes, int]) -> list[dict[int, int]]:
    """The left part as a number, by its own id and the right part's, in as many buckets as there are pairs: Spark searches a map literal from end to end."""
    pairs: dict[int, int] = {}
    for piece, rank in ranks.items():
        for i in range(1, len(piece)):
            left, right = ranks.get(piece[:i]), ranks.get(piece[i:])
            if left is not None and right is not None:
                pairs[((left + 1) << BITS) + right + 1] = ((rank + 1) << BITS) + left + 1
    buckets: list[dict[int, int]] = [{} for _ in range(len(pairs) | 1)]
    for pair, part in pairs.items():
        buckets[pair % len(buckets)][pair] = part
    return buckets


def merge_long(raw: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges for one long word, in n log n."""
    n = len(raw)
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of the part that starts at i: where it ends, where the one before starts
    heap = [(ranks[raw[i : i + 2]], i, i + 2) for i in range(n - 1) if raw[i : i + 2] in ranks]
    heapq.heapify(heap)
    gone = bytearray(n)

    def offer(i: int) -> None:
        if i >= 0 and end[i] < n and (rank := ranks.get(raw[i : end[end[i]]])) is not None:
            heapq.heappush(heap, (rank, i, end[end[i]]))

    while heap:
        _, i, to = heapq.heappop(heap)
        if gone[i] or end[i] >= n or end[end[i]] != to:  # a part of it has been merged meanwhile
            continue
        gone[end[i]] = 1
        end[i] = to
        if to < n:
            before[to] = i
        offer(i)
        offer(before[i])
    return [ranks[raw[i : end[i]]] for i in range(n) if not gone[i]]


class Words:
    """Splits texts into words by a pattern, and numbers them."""

    def __init__(self, pattern: str):
        import regex

        # white space is Unicode's property here, whatever an engine takes for it
        self.of = regex.compile(pattern.replace("\\s", "\\p{White_Space}").replace("\\S", "\\P{White_Space}")).findall
        self.by_space = pattern == SPLIT
        self.words: list[str] = []
        self.known: dict[str, bytes] = {}  # numbers, unsigned 32-bit integers, of words and of chunks of several words
        self.counts = np.zeros(0, dtype=np.int64)

    def forget(self) -> np.ndarray:
        """Keeps the words that came more than once, the most frequent ones if those are many; their numbers so far, in the order of the new ones."""
        keep = np.flatnonzero(self.counts > 1)
        keep = np.sort(keep[np.argsort(-self.counts[keep], kind="stable")[: HELD // 2]])
        self.words = [self.words[i] for i in keep.tolist()]
        self.known = {w: k.to_bytes(4, sys.byteorder) for k, w in enumerate(self.words)}
        self.counts = self.counts[keep] // 2
        return keep.astype(np.uint32)

    def seen(self, numbers: list[bytes]) -> None:
        found = np.bincount(np.frombuffer(b"".join(numbers), dtype=np.uint32), minlength=len(self.words))
        found[: len(self.counts)] += self.counts
        self.counts = found

    def one(self, word: str, new: list[str]) -> bytes:
        number = self.known.get(word)
        if number is None:
            number = self.known[word] = len(self.words).to_bytes(4, sys.byteorder)
            self.words.append(word)
            new.append(word)
        return number

    def chunk(self, chunk: str, new: list[str]) -> bytes:
        """A space and what stands up to the next one."""
        if chunk[1:].isalpha():  # letters alone are one word
            return self.one(chunk, new)
        numbers = self.known.get(chunk)
        if numbers is None:
            numbers = self.known[chunk] = b"".join([self.one(w, new) for w in self.of(chunk)])
        return numbers

    def text(self, text: str, new: list[str]) -> bytes:
        """The numbers of a text's words; words met first are added to ``new``."""
        if not self.by_space or text.startswith(" ") or SPACES.search(text):
            return b"".join([self.one(w, new) for w in self.of(text)])
        # such texts have a word boundary before each space: a chunk between spaces is split once; no chunk of several words is equal to a word
        first, *rest = text.split(" ")
        head = b"".join([self.one(w, new) for w in self.of(first)])
        rest = [" " + c for c in rest]
        found = list(map(self.known.get, rest))
        if None in found:
            found = [self.chunk(c, new) if n is None else n for c, n in zip(rest, found)]
        return head + b"".join(found)


def _splitter(ranks: dict[bytes, int], pattern: str):
    one = [ranks[bytes([b])] + 1 for b in range(256)]
    parts = np.full((257, 257), NONE, dtype=np.int64)  # by bytes, from 1; 0 is beyond the ends
    parts[1:, :] += np.array(one)[:, None]
    for a in range(256):
        for b in range(256):
            if (rank := ranks.get(bytes([a, b]))) is not None:
                parts[a + 1, b + 1] = ((rank + 1) << BITS) + one[a]

    def arrays(words: list[str]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """Byte arrays of words, one after the other, and where they start; long words have none but their ids."""
        raws, long = [w.encode("utf-8", "surrogatepass") for w in words], []
        for i, raw in enumerate(raws):
            if len(raw) > LONGEST:
                long.append(np.array(merge_long(raw, ranks), dtype="<u4").tobytes())
                raws[i] = b""
        sizes = np.array([len(r) for r in raws], dtype=np.int64)
        offsets = np.concatenate(([0], np.cumsum(np.where(sizes > 0, sizes + 2, 0))))
        at = np.zeros(offsets[-1] + 1, dtype=np.int64)
        inner = np.ones(offsets[-1], dtype=bool)
        inner[offsets[:-1][sizes > 0]] = False
        inner[offsets[1:][sizes > 0] - 1] = False
        at[:-1][inner] = np.frombuffer(b"".join(raws), dtype=np.uint8).astype(np.int64) + 1
        return parts[at[:-1], at[1:]], offsets, long

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(pattern)
        for whole in batches:
            for begin in range(0, len(whole), ROWS):
                batch = whole.slice(begin, ROWS)
                kept: list[bytes | None] = [None] * len(batch)
                if len(words.words) > HELD or len(words.known) > 2 * HELD:
                    kept[0] = words.forget().tobytes()
                numbers, counts, new = [], [], []
                for text in batch.column("text").to_pylist():
                    before = len(new)
                    numbers.append(words.text(text or "", new))
                    counts.append(len(new) - before)
                words.seen(numbers)
                q, offsets, long = arrays(new)
                ends = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
                at = iter(long)
                longs = [[next(at) for w in new[a:b] if len(w.encode("utf-8", "surrogatepass")) > LONGEST] if long else [] for a, b in zip(ends, ends[1:])]
                inner = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(q))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), pa.array(kept, pa.binary()), pa.array(numbers, pa.binary()), pa.ListArray.from_arrays(pa.array(ends), inner), pa.array(longs, pa.list_(pa.binary()))],
                    ["id", "kept", "numbers", "new", "long"],
                )

    return run


def _assembler(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: list[bytes] = []
    for batch in (whole.slice(at, ROWS) for whole in batches for at in range(0, len(whole), ROWS)):
        new, docs = batch.column("new"), []
        ends = new.offsets.to_numpy()
        at = new.values.offsets.to_numpy()[ends[0] : ends[-1] + 1].astype(np.int64)
        parts = new.values.values.slice(at[0], at[-1] - at[0]).to_numpy(zero_copy_only=False)
        raw = ((parts & ((1 << BITS) - 1)) - 1).astype("<u4").tobytes()
        at, ends = (4 * (at - at[0])).tolist(), (ends - ends[0]).tolist()
        for k, (kept, numbers, long) in enumerate(zip(batch.column("kept").to_pylist(), batch.column("numbers").to_pylist(), batch.column("long").to_pylist())):
            if kept is not None:
                known = [known[i] for i in np.frombuffer(kept, dtype=np.uint32).tolist()]
            rest = iter(long)
            known += [raw[at[i] + 4 : at[i + 1] - 4] if at[i + 1] > at[i] else next(rest) for i in range(ends[k], ends[k + 1])]
            docs.append(b"".join(map(known.__getitem__, np.frombuffer(numbers, dtype=np.uint32).tolist())))
        offsets = np.concatenate(([0], np.cumsum([len(d) // 4 for d in docs]))).astype(np.int32)
        ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(docs), dtype="<u4").astype(np.int32)))
        yield pa.RecordBatch.from_arrays([batch.column("id"), ids, pa.array(docs, pa.binary())], ["id", "ids", "packed"])


class Codec:
    """Encoding and decoding expressions for one rank file, which ranks all 256 bytes."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, pattern
        buckets = pair_parts(ranks)
        self._n_buckets = len(buckets)
        self._pairs = _literal(buckets, "array<map<string,bigint>>").cast("array<map<bigint,bigint>>")
        pieces = [b""] * (max(ranks.values(), default=-1) + 1)
        for piece, rank in ranks.items():
            pieces[rank] = piece
        self._pieces = _literal([p.hex() for p in pieces], "array<string>")

    def folded(self, words: Column) -> Column:
        """An array of words, each an array of its parts between two ends, after all merges."""
        return let(self._pairs, lambda pairs: F.transform(words, lambda w: F.aggregate(F.slice(w, F.lit(4), F.size(w)), w, lambda q, _: self._merged(pairs, q))))

    def _merged(self, pairs: Column, q: Column) -> Column:
        """One merge: of the leftmost part with the least pair, and the part after it; parts whose pair changes are looked up."""

        def own(x: Column) -> Column:
            return x.bitwiseAND(F.lit((1 << BITS) - 1))

        def part(a: Column, b: Column) -> Column:
            pair = F.shiftleft(a, BITS) + b
            return F.coalesce(F.try_element_at(F.get(pairs, F.pmod(pair, F.lit(self._n_buckets)).cast("int")), pair), a + F.lit(NONE))

        def join(least: Column, k: Column) -> Column:
            one = F.shiftright(least, BITS)
            return F.concat(F.slice(q, F.lit(1), k - 2), F.array(part(own(F.get(q, k - 2)), one), part(one, own(F.get(q, k + 1)))), F.slice(q, k + 2, F.size(q)))

        def merged(least: Column) -> Column:
            return F.when(least >= NONE, q).otherwise(let(F.array_position(q, least).cast("int"), lambda k: join(least, k)))

        return let(F.array_min(q), merged)

    def decode(self, ids: Column) -> Column:
        """The bytes of an array of ids; unknown ids add none."""
        return F.unhex(F.array_join(F.transform(ids, lambda i: F.get(self._pieces, i)), ""))


def encode_documents(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text") -> tuple[Codec, DataFrame]:
    """The codec, and ``(id_col, ids, packed)`` for each row of ``docs``: its ids, and the same as little-endian unsigned 32-bit integers.

    Null texts are empty and have no ids; null ids and repeated rows are kept; an empty
    table gives none.  Texts and words of any length are encoded whole.  Other columns
    are not looked at.
    """
    ship(docs.sparkSession)
    codec = Codec(ranks, pattern)
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = own.schema["id"].dataType.simpleString()
    # words are folded once a task: splits far smaller than a task should read are put together, as long as each core keeps two
    least, splits = 2 * docs.sparkSession.sparkContext.defaultParallelism, own.rdd.getNumPartitions()
    split_bytes = docs.sparkSession._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    own = own.coalesce(min(splits, max(least, -(-splits * split_bytes // TASK_BYTES), 1)))
    split = own.mapInArrow(_splitter(ranks, pattern), f"id {kind}, kept binary, numbers binary, new array<array<bigint>>, long array<binary>")
    folded = split.withColumn("new", codec.folded(F.col("new")))
    return codec, folded.mapInArrow(_assembler, f"id {kind}, ids array<int>, packed binary").withColumnRenamed("id", id_col)


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    codec, encoded = encode_documents(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2("packed", 256).alias("ids_sha256"), F.sha2(codec.decode(F.col("ids")), 256).alias("decoded_sha256"))
