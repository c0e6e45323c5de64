"""Toxicity by class-conditional Kneser-Ney models.

Two bigram models, of toxic and of ordinary documents, are interpolated with absolute discounts. A pair's count (in how many documents
of the class it is) less the discount, over all pairs of its context, is what the class says; all mass that this leaves, of discounts and of
pairs in fewer than min_pair documents, goes to the lower order. That is the class's continuation counts (in how many different contexts
a word was seen), discounted, and what these leave goes to the continuation counts of both classes together: so a rare
expression weighs alike in both. Words of fewer than min_count contexts are one unknown word; its lower order is the shared one
in both classes, as how many rare words a class has depends on its sample's size. In each context and class the
probabilities of all words and the unknown one sum to one.

A document is described by its length-normalised log-likelihood difference, of the whole text and of its most toxic windows
of WINDOWS words, and its share of unknown words; a logistic curve over these, fitted on documents that the counts haven't seen, gives the score.

The models are fitted on a bounded sample of labelled rows: MAX_DOCS documents of each class at most, of
MAX_CHARS characters at most (longer ones of a class that has no others), chosen by a hash of their ids; the curve weighs each row by the inverse of its class's share
in the sample, so that scores keep the classes' proportions at every size. min_count and min_pair are those of MIN_COUNTS and MIN_PAIRS
that the curve fits best by. Every document is scored over its whole text.

Defined results: null text is empty and has the score of a text without evidence; labels other than 0 and 1
don't count, and of several labels of a document the largest does; without labelled documents of both classes
every score is 0. A score of exactly 0.5 is predicted toxic; equal texts have equal scores. Repeated rows are scored each; other columns are ignored.
"""

from __future__ import annotations

import pickle
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm import common

#: Bounds of the sample, by class and by document, and folds.
MAX_DOCS, MAX_CHARS, FOLDS = 4096, 48_000, 4
#: Windows, in words, over which the difference of likelihoods is normalised, beside the whole text.
WINDOWS = (24, 96, 384)
#: Least numbers of contexts of a word, and of documents (of both classes) of a pair of words, to choose from.
MIN_COUNTS, MIN_PAIRS = (4, 6, 12, 24, 48), (48, 24, 96)
_WORD = re.compile(r"\w+")
_FEATURES = 4 + len(WINDOWS)


def tokens(text: str) -> list[str]:
    return _WORD.findall(text.lower())


@dataclass
class Model:
    vocabulary: dict[str, int]  # from 2 on; 0 is the unknown word, 1 the text's start, which is a context alone
    uni: np.ndarray  # [class, word] lower order
    keys: np.ndarray  # sorted: context * words + word
    counts: np.ndarray  # [class, key], discounted
    seen: np.ndarray  # [class, context] pairs
    left: np.ndarray  # [class, context] of these, what the keys don't hold
    weights: np.ndarray  # of the logistic curve

    def likelihoods(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """[class, n] the probability of each word after its context."""
        key = context * self.uni.shape[1] + word
        at = np.minimum(np.searchsorted(self.keys, key), max(0, len(self.keys) - 1))
        hit = self.keys[at] == key if len(self.keys) else np.zeros(len(key), bool)
        out = np.empty((2, len(key)))
        for c in (0, 1):
            n = self.seen[c, context]
            found = np.where(hit, self.counts[c, at], 0.0) if len(self.keys) else 0.0
            out[c] = np.where(n > 0, (found + self.left[c, context] * self.uni[c, word]) / np.maximum(n, 1), self.uni[c, word])
        return out

    def difference(self, ids: np.ndarray) -> np.ndarray:
        """For each word, the logarithm of its likelihood as toxic over that as ordinary."""
        ordinary, toxic = np.log(self.likelihoods(np.concatenate([[1], ids[:-1]]), ids))
        return toxic - ordinary

    def describe(self, text: str | None) -> np.ndarray:
        """1, then the difference of the whole text by its length and its length's root, then of the most toxic window of each size, then
        the share of unknown words.

        A pair counts once in the text and once in each window, as in training, where it counts once for a document."""
        number: dict[str, int] = {"": 0}
        raw = np.fromiter((number.setdefault(w, len(number)) for w in tokens(text or "")), np.int64)
        if not len(raw):
            return np.eye(1, _FEATURES)[0]
        get = self.vocabulary.get
        ids = np.fromiter((get(w, 0) for w in number), np.int64)[raw]
        d = self.difference(ids)
        # where each word's pair was seen before; a window that begins after that counts it
        pair = (np.concatenate([[0], raw[:-1]]) << 32) + raw
        order = np.argsort(pair, kind="stable")
        again = np.flatnonzero(pair[order[1:]] == pair[order[:-1]]) + 1
        before = np.full(len(raw), -1)
        before[order[again]] = order[again - 1]
        n, total, top = len(d), d[before < 0].sum(), []
        for k in WINDOWS:
            from_, last = np.maximum(before + 1, np.arange(n) - min(k, n) + 1).clip(0), np.arange(n) + 1
            change = np.bincount(from_, d, n + 1) - np.bincount(last, d, n + 1)  # of the window's sum, by where it begins
            top.append(np.cumsum(change)[: n + 1 - min(k, n)].max() / k)
        return np.array([1.0, total / n, total / np.sqrt(n), *top, np.count_nonzero(ids == 0) / n])

    def score(self, described: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(described @ self.weights, -30, 30)))


def _discount(counts: np.ndarray) -> float:
    one, two = np.count_nonzero(counts == 1), np.count_nonzero(counts == 2)
    return min(0.9, max(0.1, one / (one + 2 * two))) if one else 0.5


def pairs_of(texts: list[str]) -> tuple[list[str], list[np.ndarray]]:
    """The words, and of each text its pairs (context << 32) + word, each once: a repeated line is one piece of evidence."""
    number: dict[str, int] = {"": 0}  # the text's start
    out = []
    for t in texts:
        ids = np.fromiter((number.setdefault(w, len(number)) for w in tokens(t)), np.int64)
        out.append(np.unique((np.concatenate([[0], ids[:-1]]) << 32) + ids) if len(ids) else ids)
    return list(number), out


def counted(pairs: list[np.ndarray], y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of either class, and [class, pair] in how many documents they are."""
    classes = [np.unique(np.concatenate([np.zeros(0, np.int64), *(p for p, c in zip(pairs, y, strict=True) if c == k)]), return_counts=True) for k in (0, 1)]
    keys = np.union1d(classes[0][0], classes[1][0])
    times = np.zeros((2, len(keys)), np.int64)
    for k, (own, n) in enumerate(classes):
        times[k, np.searchsorted(keys, own)] = n
    return keys, times


def _lower(counts: np.ndarray, discount: float, below: np.ndarray) -> np.ndarray:
    """Discounted counts, and what that leaves by the order below."""
    kept = np.maximum(counts - discount, 0)
    total = counts.sum()
    return (kept + (total - kept.sum()) * below) / total if total else below


def fit_counts(words: list[str], counts: tuple[np.ndarray, np.ndarray], min_count: int, min_pair: int = MIN_PAIRS[0]) -> Model:
    """The counts of both classes; the curve's weights are still to be fitted."""
    keys, times = counts
    context, word = keys >> 32, keys & 0xFFFFFFFF
    contexts = np.bincount(word, minlength=len(words))
    frequent = np.flatnonzero(contexts >= min_count)
    frequent = frequent[frequent > 0]
    new = np.zeros(len(words), np.int64)
    new[frequent] = np.arange(len(frequent)) + 2
    new[0] = 1
    v = len(frequent) + 2
    known = np.arange(v) >= 2
    # both classes together: contexts of a word, backed off to all words alike; the unknown word stands for all rare ones
    together = np.bincount(new[word], minlength=v).astype(float)
    together[1] = 0
    shared = _lower(together, _discount(contexts[frequent]), np.where(np.arange(v) == 1, 0.0, 1 / (v - 1)))
    rest = 1 - shared[0]
    uni = np.repeat(shared[None, :], 2, axis=0)
    for c in (0, 1):
        n = np.bincount(new[word[times[c] > 0]], minlength=v) * known
        uni[c, 2:] = rest * _lower(n[2:], _discount(n[2:]), shared[2:] / max(rest, 1e-300))
    kept = (times.sum(axis=0) >= min_pair) & (new[word] > 0) & (new[context] > 0)
    key = new[context[kept]] * v + new[word[kept]]
    order = np.argsort(key)
    both, seen = np.zeros((2, len(key))), np.zeros((2, v))
    for c in (0, 1):
        both[c] = np.maximum(times[c, kept] - _discount(times[c]), 0)[order]
        seen[c] = np.bincount(new[context], times[c], v)
    seen[:, 0] = 0  # after an unknown word the lower order holds
    left = seen - np.array([np.bincount(key[order] // v, both[c], v) for c in (0, 1)])
    return Model({words[i]: int(new[i]) for i in frequent}, uni, key[order], both, seen, left, np.zeros(_FEATURES))


def fit_weights(x: np.ndarray, y: np.ndarray, times: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Logistic regression by Newton's method; a row stands for times rows, the inverse of its class's share in the sample."""
    w = np.zeros(x.shape[1])
    scale = np.maximum(np.abs(x).max(axis=0), 1e-9)
    x = x / scale
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (times * (p * (1 - p) + 1e-9))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        step = np.linalg.solve(h, x.T @ (times * (y - p)) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w / scale


def fit_rows(rows: list[tuple[str, int, int, float]]) -> Model | None:
    """rows: (text, toxic, fold, times: how many labelled rows it stands for). The curve is fitted on each fold's documents as counts of the other folds describe them;
    the least counts of a word, then of a pair, are chosen on the first fold. The model's own counts are those of all rows."""
    y = np.array([c for _, c, _, _ in rows])
    fold = np.array([f for _, _, f, _ in rows])
    times = np.array([n for _, _, _, n in rows])
    if len(set(y.tolist())) < 2:
        return None
    words, pairs = pairs_of([t for t, _, _, _ in rows])
    described = lambda m, at: np.array([m.describe(rows[i][0]) for i in at]).reshape(-1, _FEATURES)

    def outside(f: int):
        at = np.flatnonzero(fold != f)
        return counted([pairs[i] for i in at], y[at])

    held, classes = np.flatnonzero(fold == 0), outside(0)

    def tried(n, m):
        x = described(fit_counts(words, classes, n, m), held)
        p = np.clip(1 / (1 + np.exp(-np.clip(x @ fit_weights(x, y[held], times[held]), -30, 30))), 1e-6, 1 - 1e-6) if len(held) else np.zeros(0)
        return -(times[held] * (y[held] * np.log(p) + (1 - y[held]) * np.log(1 - p))).sum(), n, m, x

    _, n, m, first = min((tried(n, MIN_PAIRS[0]) for n in MIN_COUNTS), key=lambda t: t[0])
    _, n, m, first = min((tried(n, m) for m in MIN_PAIRS), key=lambda t: t[0])
    at, xs = [held], [first]
    for f in range(1, FOLDS):
        at.append(np.flatnonzero(fold == f))
        xs.append(described(fit_counts(words, outside(f), n, m), at[-1]))
    model = fit_counts(words, counted(pairs, y), n, m)
    every = np.concatenate(at)
    model.weights = fit_weights(np.concatenate(xs), y[every].astype(float), times[every])
    return model


def sample(docs: DataFrame, labels: DataFrame, where: Column, max_docs: int = MAX_DOCS, max_chars: int = MAX_CHARS) -> DataFrame:
    """(id, text, y, fold, times): the bounded sample of labelled documents that where (over doc_id) admits; a row stands for times rows of its class.

    Rows come in the order of a hash of their ids, and no more than 3 * max_docs in all (an id may have many rows)."""
    marks = labels.select("doc_id", F.col("toxic").alias("y")).where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("y").alias("y")).where(where)
    n = {r["y"]: r["n"] for r in marks.groupBy("y").agg(F.count("*").alias("n")).collect()}
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("toxicity sample")), F.lit(1_000_003))
    share = F.when(F.col("y") == 1, F.lit(min(1.0, max_docs / n.get(1, 1)))).otherwise(F.lit(min(1.0, max_docs / n.get(0, 1))))
    marks = marks.withColumn("draw", draw).where(draw < share * 1_000_003)  # some 2 * max_docs ids at most, so they may be broadcast
    texts = docs.select(F.col("doc_id").alias("id"), "text").where("text is not null")
    found = texts.join(F.broadcast(marks), texts.id == marks.doc_id).withColumn("short", F.length("text") <= max_chars)
    has = {r["y"] for r in found.where("short").select("y").distinct().collect()}
    found = found.where(F.col("short") | ~F.col("y").isin(*has)) if has else found
    rows = found.select(F.col("id").cast("long").alias("id"), "text", F.col("y").cast("int").alias("y"), F.pmod(F.xxhash64("id", F.lit("fold")), F.lit(FOLDS)).cast("int").alias("fold"), (1 / share).alias("times"), "draw")
    return rows.orderBy("draw", "id", "text").limit(3 * max_docs).drop("draw")


def fit(docs: DataFrame, labels: DataFrame, where: Column | None = None, max_docs: int = MAX_DOCS, max_chars: int = MAX_CHARS) -> Model | None:
    """The sample is bounded, so one task fits the model; the driver gets no more than that."""

    def run(batches):
        rows = [r for b in batches for r in zip(*(b.column(c).to_pylist() for c in range(5)), strict=True)]
        rows.sort(key=lambda r: (r[0], r[1]))
        model = fit_rows([(t, y, c, n) for _, t, y, c, n in rows])
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    found = sample(docs, labels, F.lit(True) if where is None else where, max_docs, max_chars).coalesce(1).mapInArrow(run, "model binary").collect()
    return pickle.loads(found[0]["model"]) if found else None


def score_documents(docs: DataFrame, model: Model | None, columns: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """columns, then score (0 to 1) and predicted (1 from 0.5 on)."""
    rows = docs.select(*[F.col(c) for c in columns], F.col(text).alias("__body"))
    sent = docs.sparkSession.sparkContext.broadcast(model)  # of the sample's vocabulary, so bounded

    def run(batches):
        m = sent.value
        for batch in batches:
            texts = batch.column("__body").to_pylist()
            s = m.score(np.array([m.describe(t) for t in texts]).reshape(-1, _FEATURES)) if m else np.zeros(len(texts))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(s, pa.float64()), pa.array(s >= 0.5, pa.bool_()).cast(pa.int32())], [*columns, "score", "predicted"])

    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in columns)
    return common.map_batches(rows, run, f"{kinds}, score double, predicted int")
