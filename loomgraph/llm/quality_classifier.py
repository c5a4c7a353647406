"""Quality classifier by positive-unlabelled learning.

Trusted positives are labelled good documents of the training folds; unlabelled ones
are documents of the corpus, whatever their label.  A linear model minimises the
non-negative unbiased risk  pi*R+(1) + max(0, Ru(0) - pi*R+(0))  (Kiryo et al., 2017)
with logistic loss.  The class prior pi is estimated from scores of all documents:
the unlabelled share over the positive share among the highest-scored documents is,
over the largest set on which it is stable, pi itself; the smallest such ratio over
score thresholds bounds it.  Bad labels are not learned from.

The text is read once, into ``FEATURES`` and hashed n-grams: its words, pairs of words
and the three-letter pieces of words fall into ``GRAMS`` cells each, whose square-rooted
shares are kept in a byte each.  The model sees buckets of each feature, and the cells.
"""

from __future__ import annotations

import operator
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, fold_of, table

#: Bounds of the samples that the classifier is fitted on.
SAMPLE_POSITIVE, SAMPLE_UNLABELLED = 12000, 24000
FOLDS, HELD_OUT = 3, 1
BUCKETS = 12
#: Cells for hashed words, for pairs of words and for pieces of words.
GRAMS = 64
_CACHE_WORDS = 200_000

FEATURES = (
    "log_words", "log_mean_word", "pipes", "symbols", "bangs", "digits", "upper_words", "title_words", "repeat_next", "distinct", "top_word",
    "lines_per_word", "short_words", "long_words", "punct_ends", "urls",
)


def features_of(text: str | None) -> list[float]:
    """``FEATURES`` of one text: shares of its words, or logs; zeros for none."""
    text = text if isinstance(text, str) else ""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=n)
    counts = Counter(words)
    return [
        float(np.log1p(n)), float(np.log1p(lengths.mean())), text.count("|") / n, sum(map(text.count, "#*$%&<>")) / n, text.count("!") / n,
        sum(map(str.isdigit, words)) / n, sum(map(str.isupper, words)) / n, sum(map(str.istitle, words)) / n,
        sum(map(operator.eq, words, words[1:])) / n, len(counts) / n, max(counts.values()) / n, text.count("\n") / n,
        float((lengths <= 2).mean()), float((lengths >= 15).mean()), (text.count(". ") + text.count(".\n") + text.count(", ")) / n,
        text.count("://") / n,
    ]


class Grams:
    """Hashed n-grams of texts; what a word's pieces hash to is kept for the next text."""

    def __init__(self):
        self.cells: dict[str, tuple[int, np.ndarray]] = {}

    def of_word(self, word: str) -> tuple[int, np.ndarray]:
        got = self.cells.get(word)
        if got is None:
            if len(self.cells) > _CACHE_WORDS:
                self.cells.clear()
            low = f"<{word.lower()}>".encode("utf-8", "surrogatepass")
            pieces = np.array([zlib.crc32(low[i : i + 5]) % GRAMS for i in range(0, max(1, len(low) - 4), 3)], dtype=np.int64)
            got = self.cells[word] = (zlib.crc32(low), pieces)
        return got

    def of(self, text: str | None) -> bytes:
        words = text.split() if isinstance(text, str) else []
        if not words:
            return bytes(3 * GRAMS)
        found = list(map(self.of_word, words))
        h = np.array([f[0] for f in found], dtype=np.int64)
        parts = (h % GRAMS, (h[:-1] * 31 + h[1:]) % GRAMS, np.concatenate([f[1] for f in found]))
        counts = np.concatenate([np.bincount(x, minlength=GRAMS) / max(len(x), 1) for x in parts])
        return np.minimum(np.sqrt(counts) * 255, 255).astype(np.uint8).tobytes()


def feature_table(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grams = Grams()
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"], "x": [features_of(t) for t in pdf["text"]], "g": [grams.of(t) for t in pdf["text"]]})

    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return own.mapInPandas(run, f"id {own.schema['id'].dataType.simpleString()}, x array<double>, g binary")


class Buckets:
    """One-hot quantile buckets of each feature, the feature itself (standardised), and the cells of n-grams."""

    def __init__(self, x: np.ndarray):
        x = x[:, : len(FEATURES)]
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, BUCKETS + 1)[1:-1])) for c in x.T]
        self.mean, self.spread = x.mean(0), x.std(0) + 1e-9

    def __call__(self, x: np.ndarray) -> np.ndarray:
        x, cells = x[:, : len(FEATURES)], x[:, len(FEATURES) :]
        parts = [np.clip((x - self.mean) / self.spread, -4, 4) / 4, cells]
        for c, e in zip(x.T, self.edges):
            parts.append(np.eye(len(e) + 1, dtype=np.float32)[np.searchsorted(e, c, side="left")])
        return np.hstack(parts)


def _dot(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (y.astype(np.float32) @ x).astype(float)


def fit_nnpu(p: np.ndarray, u: np.ndarray, prior: float, l2: float = 2e-2, rounds: int = 500) -> np.ndarray:
    """Weights and, last, the intercept, that minimise the non-negative PU risk (full-batch Adam)."""
    p, u = (np.hstack([x, np.ones((len(x), 1))]).astype(np.float32) for x in (p, u))  # half the memory; sums are of doubles
    w = np.zeros(p.shape[1])
    w[-1] = np.log(prior / (1 - prior))
    m, s = np.zeros_like(w), np.zeros_like(w)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for t in range(1, rounds + 1):
        near = w.astype(np.float32)
        zp, zu = (p @ near).astype(float), (u @ near).astype(float)
        sp, su = sigmoid(zp), sigmoid(zu)
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        g_pos = prior * _dot(p, sp - 1) / len(p)
        g_neg = _dot(u, su) / len(u) - prior * _dot(p, sp) / len(p)
        g = g_pos + g_neg if negative >= 0 else -g_neg  # below zero: step back on that part alone
        g = g + l2 * np.append(w[:-1], 0)
        m, s = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g * g
        w -= 0.03 * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + 1e-9)
    return w


def estimate_prior(unlabelled: np.ndarray, positive: np.ndarray, bins: int) -> float:
    """The share of positives among the unlabelled, from score histograms (ascending bins).

    Above a threshold the unlabelled share is at least pi times the positive share, so
    the smallest ratio bounds pi; thresholds that keep under nine tenths of the
    positives are left out, as the least of many noisy ratios is too low.
    """
    u, p = unlabelled[::-1].cumsum(), positive[::-1].cumsum()
    if not u[-1] or not p[-1]:
        return 0.5
    u, p = u / u[-1], p / p[-1]
    at = p >= 0.9
    return float(np.clip((u[at] / p[at]).min(), 0.05, 0.97))


class Model:
    def __init__(self, buckets: Buckets, weights: np.ndarray):
        self.buckets, self.weights = buckets, weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.buckets(x) @ self.weights[:-1] + self.weights[-1], -30, 30)))


def _stack(x, g) -> np.ndarray:
    """Features, then cells of n-grams (0 to 1), a row per text."""
    wide = np.array(list(x), dtype=np.float32).reshape(-1, len(FEATURES))
    return np.hstack([wide, np.frombuffer(b"".join(map(bytes, g)), dtype=np.uint8).reshape(-1, 3 * GRAMS) / np.float32(255)])


def _sample(df: DataFrame, size: int, salt: str) -> np.ndarray:
    """Features of about ``size`` rows at most, chosen by a hash of the id."""
    n = df.count()
    share = int(1_000_000 * min(1.0, size / max(n, 1)))
    rows = df.where(F.pmod(F.xxhash64(F.lit(salt), F.col("id")), F.lit(1_000_000)) < share).select("id", "x", "g").limit(2 * size).collect()
    rows.sort(key=lambda r: (r["id"] is None, r["id"], r["x"]))
    return _stack([r["x"] for r in rows], [r["g"] for r in rows])


def train(features: DataFrame, labels: DataFrame) -> Model | None:
    """Fits on ``features(id, x, g)``; None without trusted positives."""
    good = labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull() & (fold_of(F.col("doc_id"), FOLDS) != HELD_OUT)).select(F.col("doc_id").alias("__good")).distinct()
    positives = features.join(good, F.col("id") == F.col("__good"), "left_semi")
    p, u = _sample(positives, SAMPLE_POSITIVE, "p"), _sample(features, SAMPLE_UNLABELLED, "u")
    if not len(p) or not len(u):
        return None
    buckets = Buckets(u)
    bp, bu = buckets(p), buckets(u)
    prior = 0.7
    for _ in range(2):
        model = Model(buckets, fit_nnpu(bp, bu, prior, rounds=250))
        prior = _corpus_prior(features, positives, model)
    return Model(buckets, fit_nnpu(bp, bu, prior))


def _corpus_prior(features: DataFrame, positives: DataFrame, model: Model, bins: int = 200) -> float:
    """``estimate_prior`` over all documents: two histograms of ``bins`` counts come back."""

    @F.pandas_udf("int")
    def bin_of(x: pd.Series, g: pd.Series) -> pd.Series:
        return pd.Series(np.minimum(model.score(_stack(x, g)) * bins, bins - 1).astype("int32"))

    def histogram(df: DataFrame) -> np.ndarray:
        out = np.zeros(bins)
        for r in df.groupBy(bin_of("x", "g").alias("b")).agg(F.count(F.lit(1)).alias("c")).collect():
            out[r["b"]] = r["c"]
        return out

    return estimate_prior(histogram(features), histogram(positives), bins)


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, score)`` for each row of ``docs``: the probability that it is a good document.

    ``labels`` has ``doc_id`` and ``quality`` (1: good; others are not read); rows of
    the held-out fold are never read.  Null and empty texts are scored as texts
    without words, null ids are scored, repeated rows get equal scores.  Without
    trusted positives every score is 0.5.  An empty table gives none.  Other columns
    are not looked at.  Writes features to the shared folder.
    """
    features = Scratch(docs.sparkSession, "quality").keep(feature_table(docs, id_col, text_col), "features")
    model = train(features, labels)
    if model is None:
        return features.select(F.col("id").alias(id_col), F.lit(0.5).alias("score"))

    @F.pandas_udf("double")
    def score(x: pd.Series, g: pd.Series) -> pd.Series:
        return pd.Series(model.score(_stack(x, g)))

    return features.select(F.col("id").alias(id_col), score("x", "g").alias("score"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", (fold_of(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
