"""Best-fit packing of tokenized documents into sequences of bounded length.

Documents are tokenized and cut into pieces.  Pieces are dealt by a hash of their id
to packers of about ``PACKER_TOKENS`` tokens each; a packer is online best-fit with a
fixed number of open bins in a bitset keyed by free space, of which the fullest
closes first.  A packer is fed its pieces longest first.  Packers share nothing, so
a lost executor repeats only its own, with the same result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table
from .tokens import held

MAX_TOKENS = 1024
END_ID = 2
OPEN_BINS = 4096
PACKER_TOKENS = 1 << 24
PIECES = "piece int, start long, length long, ids_crc32 long"


class BestFit:
    """Bounded-space best-fit: ``place(n)`` gives (bin number, offset) for ``n`` <= ``size``."""

    def __init__(self, size: int = MAX_TOKENS, open_bins: int = OPEN_BINS):
        self.size, self.limit = size, open_bins
        self.by_free: list[list[int]] = [[] for _ in range(size + 1)]
        self.bits = 0  # bit f: some open bin has f free
        self.open = self.made = 0

    def place(self, n: int) -> tuple[int, int]:
        fits = self.bits >> n
        if fits and n:
            free = n + (fits & -fits).bit_length() - 1
            number = self._take(free)
        else:
            free, number = self.size, self.made
            self.made += 1
        left = free - n
        if left:
            self.by_free[left].append(number)
            self.bits |= 1 << left
            self.open += 1
            if self.open > self.limit:
                self._take((self.bits & -self.bits).bit_length() - 1)  # the fullest closes
        return number, self.size - free

    def _take(self, free: int) -> int:
        stack = self.by_free[free]
        number = stack.pop()
        if not stack:
            self.bits &= ~(1 << free)
        self.open -= 1
        return number


def pieces_of(n: int, size: int = MAX_TOKENS) -> list[tuple[int, int]]:
    """(start, length) of a document of ``n`` ids: whole ones of ``size``, what is left over first."""
    first = n % size or min(n, size)
    cuts = [0, *range(first, n, size)]
    return [(a, min(first if a == 0 else size, n - a)) for a in cuts]


def _pieces(tokenizer: str, size: int, end_id: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens = held(tokenizer)
        for pdf in batches:
            for at in range(0, len(pdf), 512):
                part = pdf.iloc[at : at + 512]
                rows = []
                for doc, raw in zip(part["doc_id"], tokens.encode_bytes(part["text"])):
                    raw += end_id.to_bytes(4, "little")
                    for k, (a, n) in enumerate(pieces_of(len(raw) // 4, size)):
                        rows.append((doc, k, a, n, zlib.crc32(raw[4 * a : 4 * (a + n)])))
                yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"], dtype=object)

    return run


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", size: int = MAX_TOKENS, end_id: int = END_ID, open_bins: int = OPEN_BINS, packer_tokens: int = PACKER_TOKENS) -> DataFrame:
    """A row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    ``doc_id`` holds ``id_col``, of any type that has an order.  A null or empty text is the end id alone.  A null id
    gives pieces with a null id.  Repeated rows are packed each.  An empty table gives
    no pieces.  Texts of any length are cut, never dropped.  Other columns are not
    looked at.  Writes the pieces (no text) to the shared folder.
    """
    spark = docs.sparkSession
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    columns = f"doc_id {own.schema['doc_id'].dataType.simpleString()}, {PIECES}"
    pieces = Scratch(spark, "packing").keep(own.mapInPandas(_pieces(tokenizer, size, end_id), columns), "pieces")
    total = pieces.agg(F.sum("length")).first()[0] or 0
    packers = -(-total // packer_tokens) or 1
    dealt = pieces.withColumn("packer", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(packers)))
    fed = dealt.repartition(packers, "packer").sortWithinPartitions("packer", F.desc("length"), "doc_id", "piece", "ids_crc32")
    return fed.mapInPandas(_packers(size, open_bins), columns + ", sequence_id long, offset long")


def _packers(size: int, open_bins: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, packer = None, None
        for pdf in batches:
            bins, offsets = [], []
            for key, n in zip(pdf["packer"].tolist(), pdf["length"].tolist()):
                if key != at:  # rows come sorted by packer; a task may hold several
                    at, packer = key, BestFit(size, open_bins)
                number, offset = packer.place(n)
                bins.append((key << 32) + number)
                offsets.append(offset)
            out = pdf.drop(columns="packer")
            out["sequence_id"] = np.array(bins, dtype=np.int64)
            out["offset"] = np.array(offsets, dtype=np.int64)
            yield out

    return run


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
