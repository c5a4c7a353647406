"""Toxicity by weak supervision.

1. Voters: fixed lexicons of insults, and patterns (words and word beginnings) mined
   from a bounded sample of labelled documents of the training folds.  A voter fires
   on a document where the share of its words is above the voter's own threshold.
2. Label model: a generative model of the votes of all voters given the hidden class,
   fitted by EM.  Each round adds up, over all documents, how often each pair of voters
   fires under the posterior so far (a matrix of voters by voters, summed on Spark), so
   accuracies cover the whole corpus; the sample's labels are anchors.  A tree of
   conditional dependencies (Chow-Liu over conditional mutual information) holds the
   correlations between voters, so that near-copies of a voter don't count twice.
3. Classifier: logistic regression on voter densities, trained on the posterior labels of
   a bounded sample of the training folds' documents, labelled or not.

The text is read once for all documents, into sparse voter counts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, apart, fold_of, table

#: Bounds of the labelled sample that patterns are mined from and the classifier is fitted on.
SAMPLE_TOXIC, SAMPLE_CLEAN = 3000, 5000
#: Bounds of the sample of documents, with a posterior from a half and below it, that the classifier is trained on.
TRAIN_TOXIC, TRAIN_CLEAN = 5000, 15000
#: EM ends when no probability moves by more than ``TOLERANCE``, or after ``ROUNDS`` passes over the voter counts;
#: the tree follows the documents' posteriors in the first ``TREE_ROUNDS`` of them and then stays.
ROUNDS, TREE_ROUNDS, TOLERANCE = 25, 4, 2e-3
MINED_VOTERS = 96
PREFIXES = range(4, 9)
FOLDS, HELD_OUT = 4, 2
#: A text is called toxic from this score, by the query and by the pipeline's stage alike.
TOXIC_FROM = 0.3

#: Insults by language; each list is one voter.
LEXICONS = {
    "en_person": "idiot moron loser clown scum imbecile jerk creep bastard freak",
    "en_worth": "worthless pathetic disgusting stupid trash garbage dumb vile filthy useless",
    "en_hate": "hate kill die shut hell damn kys",
    "fr": "imbécile crétin débile ordure raclure abruti connard salaud minable dégueulasse",
    "de": "idiot trottel dummkopf abschaum versager arschloch widerlich wertlos erbärmlich depp",
    "es": "idiota imbécil estúpido basura escoria perdedor payaso asqueroso patético inútil",
}

_WORD = re.compile(r"[^\W\d_]+")
_CACHE_WORDS = 300_000


class Voters:
    """Words and word beginnings, each the sign of some voters; counts their hits in a text."""

    def __init__(self, words: dict[str, list[int]], prefixes: dict[str, list[int]]):
        self.words, self.prefixes = words, prefixes
        self.cache: dict[str, tuple[int, ...]] = {}

    def __getstate__(self):
        return self.words, self.prefixes

    def __setstate__(self, state):
        self.__init__(*state)

    def of_token(self, token: str) -> tuple[int, ...]:
        found: list[int] = []
        for w in _WORD.findall(token.lower()):
            found += self.words.get(w, ())
            for k in PREFIXES:
                if len(w) >= k:
                    found += self.prefixes.get(w[:k], ())
        return tuple(found)

    def count(self, text: str | None) -> tuple[int, dict[int, int]]:
        """Number of tokens, and hits by voter."""
        tokens = text.split() if isinstance(text, str) else []
        cache, hits = self.cache, []
        if len(cache) > _CACHE_WORDS:
            cache.clear()
        for t in tokens:
            got = cache.get(t)
            if got is None:
                got = cache[t] = self.of_token(t)
            if got:
                hits += got
        return len(tokens), dict(Counter(hits))


def _dense(counts: list[tuple[int, dict[int, int]]], voters: int) -> np.ndarray:
    """Hits per hundred words."""
    x = np.zeros((len(counts), voters))
    for i, (n, hits) in enumerate(counts):
        for v, c in hits.items():
            x[i, v] = 100.0 * c / max(n, 1)
    return x


def mine(texts: list[str], toxic: np.ndarray, weight: np.ndarray) -> list[tuple[str, str]]:
    """``(kind, sign)`` of patterns that are much likelier in toxic texts, best first, without near-copies."""

    def signs(text: str) -> set[str]:
        """Words (marked by ``=``) and beginnings of words in a text."""
        words = {w for t in set((text or "").split()) for w in _WORD.findall(t.lower()) if len(w) > 2}
        return {"=" + w for w in words} | {w[:k] for w in words for k in PREFIXES if len(w) >= k}

    marks: Counter = Counter()
    for i in np.flatnonzero(toxic):
        marks.update(signs(texts[i]))
    positives = int(toxic.sum())
    least = max(4, positives // 150)
    marks = Counter({f: n for f, n in marks.items() if n >= least})
    rows_of: dict[str, list[int]] = {f: [] for f in marks}
    for i, text in enumerate(texts):  # texts are cut up again: their words would take more memory than time
        for f in signs(text):
            if f in rows_of:
                rows_of[f].append(i)
    named = {f: ("word", f[1:]) if f[0] == "=" else ("prefix", f) for f in marks}
    seen = {named[f]: rows for f, rows in rows_of.items()}
    support = {named[f]: n for f, n in marks.items()}
    total_p, total_n = weight[toxic == 1].sum(), weight[toxic == 0].sum()
    scored = []
    for f, rows in seen.items():
        at = np.array(rows)
        p = weight[at][toxic[at] == 1].sum() / max(total_p, 1e-9)
        n = (weight[at][toxic[at] == 0].sum() + 0.5) / max(total_n + 1, 1e-9)
        if p > 4 * n:
            scored.append(((np.log(p / n)) * np.sqrt(support[f]), f))
    scored.sort(key=lambda x: (-x[0], x[1]))
    chosen: list[tuple[str, str]] = []
    covered: dict[tuple[str, str], set[int]] = {}
    for _, f in scored:
        rows = set(seen[f])
        # a longer or shorter form of a chosen sign with nearly the same documents adds nothing
        if any((f[1].startswith(g[1]) or g[1].startswith(f[1])) and len(rows & covered[g]) > 0.9 * len(rows | covered[g]) for g in chosen):
            continue
        chosen.append(f)
        covered[f] = rows
        if len(chosen) == MINED_VOTERS:
            break
    return chosen


def build_voters(mined: list[tuple[str, str]]) -> tuple[Voters, list[str]]:
    words: dict[str, list[int]] = {}
    prefixes: dict[str, list[int]] = {}
    names = []
    for name, text in LEXICONS.items():
        for w in text.split():
            words.setdefault(w, []).append(len(names))
        names.append(f"lexicon:{name}")
    for kind, sign in mined:
        (words if kind == "word" else prefixes).setdefault(sign, []).append(len(names))
        names.append(f"{kind}:{sign}")
    # all mined signs together: several weak signs in one text are a voter of their own
    for kind, sign in mined:
        (words if kind == "word" else prefixes)[sign].append(len(names))
    names.append("pattern:any")
    return Voters(words, prefixes), names


def thresholds(x: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each voter, the density above which it fires, and its informedness there."""
    cut, gain = np.full(x.shape[1], 1e-9), np.zeros(x.shape[1])
    p, n = weight * (toxic == 1), weight * (toxic == 0)
    for v in range(x.shape[1]):
        for t in [0.0, *np.unique(np.quantile(x[x[:, v] > 0, v], np.linspace(0, 0.9, 10)))] if (x[:, v] > 0).any() else [0.0]:
            fire = x[:, v] > t * 0.999
            fire &= x[:, v] > 0
            j = p[fire].sum() / max(p.sum(), 1e-9) - n[fire].sum() / max(n.sum(), 1e-9)
            if j > gain[v]:
                cut[v], gain[v] = max(t * 0.999, 1e-9), j
    return cut, gain


class Votes:
    """Sums over documents: their weight, that of those on which a voter fires, and on which a pair of voters fires."""

    def __init__(self, n: float, one: np.ndarray, two: np.ndarray):
        self.n, self.one, self.two = n, one, two

    @staticmethod
    def of(votes: np.ndarray, weight: np.ndarray) -> Votes:
        v = votes.astype(float)
        w = v * weight[:, None]
        return Votes(float(weight.sum()), w.sum(0), v.T @ w)

    def __add__(self, other: Votes) -> Votes:
        return Votes(self.n + other.n, self.one + other.one, self.two + other.two)

    def flat(self) -> np.ndarray:
        return np.concatenate(([self.n], self.one, self.two.ravel()))

    @staticmethod
    def unflat(x: np.ndarray, voters: int) -> Votes:
        return Votes(float(x[0]), x[1 : voters + 1], x[voters + 1 :].reshape(voters, voters))

    def joint(self) -> np.ndarray:
        """``[a, b, i, j]``: weight where voter ``i`` says ``a`` and ``j`` says ``b``."""
        i, j = self.one[:, None], self.one[None, :]
        return np.array([[self.n - i - j + self.two, j - self.two], [i - self.two, self.two]])


class LabelModel:
    """Tree-augmented generative model of binary votes given a binary class, fitted by EM."""

    def fit(self, votes: np.ndarray, count: np.ndarray, anchors: np.ndarray, rounds: int = 15) -> LabelModel:
        """``anchors``: the class where it is known, else -1; ``count``: documents of the row."""
        known = anchors >= 0
        rest, size = votes[~known], count[~known]

        def corpus(model: LabelModel) -> tuple[Votes, Votes]:
            q = model.posterior(rest)
            return Votes.of(rest, size * (1 - q)), Votes.of(rest, size * q)

        return self.fit_over(votes[known], count[known], anchors[known], corpus, rounds)

    def fit_over(self, votes: np.ndarray, weight: np.ndarray, y: np.ndarray, corpus, rounds: int) -> LabelModel:
        """``votes``, ``weight``, ``y``: of documents with a known class; ``corpus(model)``: votes of the others by class, under the model's posterior."""
        known = Votes.of(votes, weight * (y == 0)), Votes.of(votes, weight * (y == 1))
        # correlations come first, from the anchors: voters taken as independent would drift to the largest group of copies
        self.parent = self._tree(known)
        self._estimate(known)
        for step in range(rounds):
            both = tuple(a + b for a, b in zip(known, corpus(self)))
            if 1 <= step < TREE_ROUNDS:
                self.parent = self._tree(both)
            before = self.p
            self._estimate(both)
            self.rounds = step + 1
            if step >= TREE_ROUNDS and np.abs(self.p - before).max() < TOLERANCE:
                break
        return self

    def _estimate(self, by_class: tuple[Votes, Votes]) -> None:
        n0, n1 = by_class[0].n, by_class[1].n
        self.prior = (n1 + 1) / (n0 + n1 + 2)
        m = len(self.parent)
        # p[v, parent's vote, class]
        self.p = np.zeros((m, 2, 2))
        own, root = np.arange(m), self.parent < 0
        for c, votes in enumerate(by_class):
            both, up = votes.two[own, self.parent], votes.one[self.parent]
            self.p[:, 1, c] = (both + 0.5) / (up + 1)
            self.p[:, 0, c] = np.where(root, (votes.one + 0.5) / (votes.n + 1), (votes.one - both + 0.5) / (votes.n - up + 1))
        self.p = np.clip(self.p, 1e-6, 1 - 1e-6)

    @staticmethod
    def _tree(by_class: tuple[Votes, Votes], least: float = 2e-3) -> np.ndarray:
        """Chow-Liu: edges of the maximum spanning forest over conditional mutual information."""
        m, total = len(by_class[0].one), by_class[0].n + by_class[1].n + 1e-9
        info = np.zeros((m, m))
        for votes in by_class:
            joint = np.maximum(votes.joint(), 0) / (votes.n + 1e-9) + 1e-9
            info += votes.n / total * (joint * np.log(joint / joint.sum(1, keepdims=True) / joint.sum(0, keepdims=True))).sum((0, 1))
        edges = [(info[i, j], i, j) for i in range(m) for j in range(i) if info[i, j] > least]
        group, links = list(range(m)), {i: [] for i in range(m)}

        def top(i):
            while group[i] != i:
                i = group[i]
            return i

        for _, i, j in sorted(edges, reverse=True):
            if top(i) != top(j):
                group[top(i)] = top(j)
                links[i].append(j)
                links[j].append(i)
        parent, seen = np.full(m, -1), set()
        for r in range(m):
            stack = [] if r in seen else [r]
            while stack:
                i = stack.pop()
                seen.add(i)
                for j in links[i]:
                    if j not in seen:
                        parent[j] = i
                        stack.append(j)
        return parent

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        odds = np.full(len(votes), np.log(self.prior / (1 - self.prior)))
        for v in range(votes.shape[1]):
            a = votes[:, self.parent[v]].astype(int) if self.parent[v] >= 0 else np.zeros(len(votes), int)
            p1, p0 = self.p[v, a, 1], self.p[v, a, 0]
            odds += np.where(votes[:, v] == 1, np.log(p1 / p0), np.log((1 - p1) / (1 - p0)))
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def inputs(x: np.ndarray) -> np.ndarray:
    """Classifier inputs from densities: saturating, so that one very dense voter doesn't outvote the rest."""
    return np.concatenate([np.log1p(x), x > 0], axis=1)


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, l2: float = 5e-3, rounds: int = 600) -> np.ndarray:
    """Weights and, last, the intercept; full-batch Adam."""
    z = np.hstack([x, np.ones((len(x), 1))])
    w, m, s = np.zeros(z.shape[1]), np.zeros(z.shape[1]), np.zeros(z.shape[1])
    weight = weight / weight.sum()
    for t in range(1, rounds + 1):
        g = z.T @ (weight * (1 / (1 + np.exp(-np.clip(z @ w, -30, 30))) - y)) + l2 * np.append(w[:-1], 0)
        m, s = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g * g
        w -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + 1e-9)
    return w


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> pd.DataFrame:
    """``text, y, weight`` of a bounded sample of labelled training rows, chosen by hash; weights restore the class rates."""
    spark = docs.sparkSession
    train = labels.where(F.col("doc_id").isNotNull() & F.col(label_col).isin(0, 1) & (fold_of(F.col("doc_id"), FOLDS) != HELD_OUT))
    train = train.groupBy("doc_id").agg(F.max(label_col).cast("int").alias("y"))
    sizes = {r["y"]: r["n"] for r in train.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    caps = {1: SAMPLE_TOXIC, 0: SAMPLE_CLEAN}
    share = {y: min(1.0, caps[y] / n) for y, n in sizes.items()}
    hashed = F.pmod(F.xxhash64(F.lit("sample"), F.col("doc_id")), F.lit(1_000_000))
    limit = F.lit(0)
    for y, s in share.items():
        limit = F.when(F.col("y") == y, F.lit(int(s * 1_000_000))).otherwise(limit)
    rows = train.where(hashed < limit).select(F.col("doc_id").alias("__id"), "y").limit(2 * (SAMPLE_TOXIC + SAMPLE_CLEAN))
    # at most that many ids: bounded, so they may be broadcast
    own = docs.select(F.col(id_col).alias("__of"), F.col(text_col).alias("text"))
    chosen = own.join(F.broadcast(rows), F.col("__of") == F.col("__id")).groupBy("__id").agg(F.first("y").alias("y"), F.min("text").alias("text"))
    got = sorted(chosen.collect(), key=lambda r: r["__id"])
    pdf = pd.DataFrame({"text": [r["text"] or "" for r in got], "y": np.array([r["y"] for r in got], dtype=int)})
    pdf["weight"] = [1 / share[y] for y in pdf["y"]]
    return pdf


COUNTS = "n int, voter array<int>, hits array<int>"


def voter_counts(docs: DataFrame, voters: Voters, id_col: str, text_col: str) -> DataFrame:
    """``id, n, voter, hits`` of each row: its number of tokens, and the voters that hit with how often."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [voters.count(t) for t in pdf["text"]]
            yield pd.DataFrame({"id": pdf["id"], "n": [n for n, _ in found], "voter": [list(h) for _, h in found], "hits": [list(h.values()) for _, h in found]})

    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return own.mapInPandas(run, f"id {own.schema['id'].dataType.simpleString()}, {COUNTS}")


class Model:
    """Voters, label model and classifier; ``score`` maps densities to probabilities."""

    def __init__(self, voters: Voters, names: list[str], cut: np.ndarray, weights: np.ndarray | None, label_model: LabelModel | None, rate: float):
        self.voters, self.names, self.cut, self.weights, self.label_model, self.rate = voters, names, cut, weights, label_model, rate

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), self.rate)
        z = inputs(x) @ self.weights[:-1] + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _matrix(n, voter, hits, width: int) -> np.ndarray:
    return _dense([(k, dict(zip(v, h))) for k, v, h in zip(n, voter, hits)], width)


def corpus_votes(counts: DataFrame, cut: np.ndarray):
    """A function from a label model to the votes of all rows of ``counts`` by class, under its posterior."""
    width = len(cut)

    def of(model: LabelModel) -> tuple[Votes, Votes]:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            sums = np.zeros((2, 1 + width + width * width))
            for pdf in batches:
                votes = (_matrix(pdf["n"], pdf["voter"], pdf["hits"], width) > cut).astype(np.int8)
                q = model.posterior(votes)
                sums += np.array([Votes.of(votes, 1 - q).flat(), Votes.of(votes, q).flat()])
            yield pd.DataFrame({"at": np.arange(sums.size), "x": sums.ravel()})

        # a few numbers for each pair of voters from each task, and from all tasks to the driver
        rows = counts.select("n", "voter", "hits").mapInPandas(run, "at int, x double").groupBy("at").agg(F.sum("x").alias("x")).collect()
        sums = np.zeros(2 * (1 + width + width * width))
        for r in rows:
            sums[r["at"]] = r["x"]
        return tuple(Votes.unflat(x, width) for x in sums.reshape(2, -1))

    return of


def training_rows(counts: DataFrame, model: LabelModel, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Densities, posterior labels and weights of a bounded sample of documents of the training folds, chosen by hash."""
    width = len(cut)

    @F.pandas_udf("double")
    def posterior(n: pd.Series, voter: pd.Series, hits: pd.Series) -> pd.Series:
        return pd.Series(model.posterior((_matrix(n, voter, hits, width) > cut).astype(np.int8)))

    own = counts.where(fold_of(F.col("id"), FOLDS) != HELD_OUT).withColumn("q", posterior("n", "voter", "hits"))
    sizes = {r["y"]: r["c"] for r in own.groupBy((F.col("q") >= 0.5).alias("y")).agg(F.count(F.lit(1)).alias("c")).collect()}
    most = {True: TRAIN_TOXIC, False: TRAIN_CLEAN}
    share = {y: min(1.0, most[y] / n) for y, n in sizes.items()}
    hashed = F.pmod(F.xxhash64(F.lit("train"), "id", "n", "voter", "hits"), F.lit(1_000_000))
    some = own.where(hashed < F.when(F.col("q") >= 0.5, F.lit(int(share.get(True, 0) * 1_000_000))).otherwise(F.lit(int(share.get(False, 0) * 1_000_000))))
    got = some.select("n", "voter", "hits", "q").limit(2 * (TRAIN_TOXIC + TRAIN_CLEAN)).collect()
    got = sorted(got, key=lambda r: (r["q"], r["n"], r["voter"], r["hits"]))
    q = np.array([r["q"] for r in got])
    x = _dense([(r["n"], dict(zip(r["voter"], r["hits"]))) for r in got], width)
    return x, q, np.array([1 / share[bool(v >= 0.5)] for v in q])


def train(docs: DataFrame, labels: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> tuple[Model, DataFrame]:
    """The fitted model, and the voter counts of every row of ``docs`` (written to the shared folder).

    Without labels of both classes nothing can be anchored: every score is their rate.
    """
    sample = labelled_sample(docs, labels, id_col, text_col, "toxic")
    y, weight = sample["y"].to_numpy(int), sample["weight"].to_numpy(float)
    both = y.any() and not y.all()
    voters, names = build_voters(mine(sample["text"].tolist(), y, weight) if both else [])
    counts = scratch.keep(voter_counts(docs, voters, id_col, text_col), "counts")
    if not both:
        return Model(voters, names, np.zeros(len(names)), None, None, float(np.average(y, weights=weight)) if len(y) else 0.0), counts
    x = _dense([voters.count(t) for t in sample["text"]], len(names))
    cut, _ = thresholds(x, y, weight)
    model = LabelModel().fit_over((x > cut).astype(np.int8), weight, y, corpus_votes(counts, cut), ROUNDS)
    features, posterior, balance = training_rows(counts, model, cut)
    weights = fit_logistic(inputs(features), posterior, balance) if len(posterior) else None
    return Model(voters, names, cut, weights, model, model.prior), counts


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, score)`` for each row of ``docs``.

    ``labels`` has ``doc_id`` and ``toxic`` (0/1; others are ignored); rows of the
    held-out fold are never read.  Null and empty texts get the score of a text
    without any sign.  Null ids are scored.  Without usable labels of both classes
    every score is their rate (0 without labels).  Repeated rows get equal scores; an
    empty table gives none.  Other columns are not looked at.
    """
    scratch = Scratch(docs.sparkSession, "toxicity")
    model, counts = train(docs, labels, scratch, id_col, text_col)
    width = len(model.names)

    @F.pandas_udf("double")
    def score(n: pd.Series, voter: pd.Series, hits: pd.Series) -> pd.Series:
        return pd.Series(model.score(_matrix(n, voter, hits, width)))

    return counts.select(F.col("id").alias(id_col), score("n", "voter", "hits").alias("score"))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = TOXIC_FROM) -> DataFrame:
    """The rows of ``docs`` scored below ``threshold``; columns as they were.

    Of rows that share an id all go if one is toxic; rows without an id stay.  Null and
    empty texts stay unless a text without signs is toxic.  An empty table stays empty.
    """
    scratch = Scratch(docs.sparkSession, "toxicity")
    model, counts = train(docs, labels, scratch, id_col, text_col)
    width = len(model.names)

    @F.pandas_udf("double")
    def score(n: pd.Series, voter: pd.Series, hits: pd.Series) -> pd.Series:
        return pd.Series(model.score(_matrix(n, voter, hits, width)))

    (bad,) = apart(docs.columns, "__bad")
    toxic = counts.where((score("n", "voter", "hits") >= threshold) & F.col("id").isNotNull()).select(F.col("id").alias(bad)).distinct()
    return docs.join(toxic, F.col(id_col) == F.col(bad), "left_anti")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", (fold_of(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"))
