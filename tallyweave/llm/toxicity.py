"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

A word's embedding is the sum of the hashed rows of the word itself and of its beginnings of
``HEADS`` bytes and its end of ``TAIL`` bytes, so that inflected and compounded words share
rows. Filters one, two and three words wide slide over the whole text, each keeps its
maximum, and a logistic layer reads the maxima. Rows met in fewer than ``LEAST_DOCS``
learning documents count as zero, so that chance words cannot be learned by heart.

It learns from at most ``LEARN_TOXIC`` toxic and ``LEARN_CLEAN`` other labelled documents,
those whose hashed doc_id is smallest; a fifth of them is kept out of the gradient. On that
fifth a threshold is calibrated for each language, where the language is the one that
``langid`` reads from the text, and the score is shifted so that every language's threshold
lies at ``CUT``. Scores use the text alone.

Defined results: null, empty and word-less texts have no maxima and get the score of the bias
alone, which is kept under the cut; a label that is null, or a labelled document without text,
is not learned from; several labels of a document count each; without both classes every
score is 0; repeated rows get a row each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textbytes as tb
from .langid import LanguageModel, learn as learn_languages
from .util import prepare

LEARN_TOXIC, LEARN_CLEAN = 1500, 2500
ROWS, WIDTH, FILTERS, SPANS = 1 << 16, 12, 6, (1, 2, 3)
HEADS, TAIL = (4, 5, 6, 7), 5
LEAST_DOCS = 5
EPOCHS, BATCH, RATE = 8, 32, 0.02
CUT = 0.7


def word_rows(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Embedding rows of each word (0 where it is too short for one), and the first word of each text."""
    w = tb.Words(raw, offsets, tb.ALNUM, tb.FOLDED)
    spans = tb.SpanHashes(raw, tb.FOLDED)
    length = w.ends - w.starts
    rows = np.zeros((len(length), 2 + len(HEADS)), np.int32)
    fold = lambda h: (h % np.uint64(ROWS - 1)).astype(np.int32) + 1
    rows[:, 0] = fold(w.hashes)
    for k, n in enumerate(HEADS):
        at = np.flatnonzero(length > n)
        rows[at, k + 1] = fold(tb.mix(spans.of(w.starts[at], w.starts[at] + n) + np.uint64(1)))
    at = np.flatnonzero(length > TAIL)
    rows[at, -1] = fold(tb.mix(spans.of(w.ends[at] - TAIL, w.ends[at]) + np.uint64(2)))
    return rows, w.first


class ConvNet:
    """Embedding, filters of several widths with max pooling, logistic layer."""

    def __init__(self, seed: int = 10):
        r = np.random.default_rng(seed)
        self.embed = (r.normal(size=(ROWS, WIDTH)) * 0.1).astype(np.float32)
        self.embed[0] = 0
        self.filters = [(r.normal(size=(s * WIDTH, FILTERS)) / np.sqrt(s * WIDTH)).astype(np.float32) for s in SPANS]
        self.offset = [np.zeros(FILTERS, np.float32) for _ in SPANS]
        self.out, self.bias = (r.normal(size=len(SPANS) * FILTERS) * 0.3).astype(np.float32), np.float32(-1.0)
        self.known = np.ones(ROWS, bool)
        self.shift: dict[str, float] = {}
        self.usual_shift = 0.0
        self.trained = False

    def _words(self, rows: np.ndarray) -> np.ndarray:
        x = self.embed[rows[:, 0]]
        for j in range(1, rows.shape[1]):
            x += self.embed[rows[:, j]]
        return x

    def _activations(self, x: np.ndarray, k: int) -> np.ndarray:
        s, f = SPANS[k], self.filters[k]
        n = len(x) - s + 1
        return sum(x[j : j + n] @ f[j * WIDTH : (j + 1) * WIDTH] for j in range(s)) + self.offset[k]

    def step(self, docs: list[np.ndarray], labels: np.ndarray, weights: np.ndarray, moments: dict, t: int) -> None:
        grads = {"out": np.zeros_like(self.out), "bias": np.float32(0), "embed": np.zeros_like(self.embed), **{f"f{k}": np.zeros_like(f) for k, f in enumerate(self.filters)}, **{f"o{k}": np.zeros_like(o) for k, o in enumerate(self.offset)}}
        for rows, y, weight in zip(docs, labels, weights, strict=True):
            best, where, x = [], [], self._words(rows)
            for k, s in enumerate(SPANS):
                if len(rows) < s:
                    best.append(np.zeros(FILTERS, np.float32))
                    where.append(None)
                    continue
                a = self._activations(x, k)
                at = a.argmax(0)
                best.append(np.maximum(a[at, np.arange(FILTERS)], 0))
                where.append(at)
            h = np.concatenate(best)
            p = 1 / (1 + np.exp(-np.clip(float(h @ self.out + self.bias), -30, 30)))
            g = np.float32((p - y) * weight / len(docs))
            grads["out"] += g * h
            grads["bias"] += g
            back = g * self.out * (h > 0)
            for k, s in enumerate(SPANS):
                if where[k] is None:
                    continue
                d = back[k * FILTERS : (k + 1) * FILTERS]
                grads[f"o{k}"] += d
                for j in range(s):
                    part = slice(j * WIDTH, (j + 1) * WIDTH)
                    at = where[k] + j
                    grads[f"f{k}"][part] += x[at].T * d
                    np.add.at(grads["embed"], rows[at].ravel(), np.repeat(d[:, None] * self.filters[k][part].T, rows.shape[1], 0))
        for name, grad in grads.items():
            value = {"out": self.out, "bias": self.bias, "embed": self.embed}.get(name)
            if value is None:
                value = (self.filters if name[0] == "f" else self.offset)[int(name[1])]
            grad = grad + 1e-5 * value
            m, v = moments.setdefault(name, [np.zeros_like(grad), np.zeros_like(grad)])
            m = moments[name][0] = 0.9 * m + 0.1 * grad
            v = moments[name][1] = 0.99 * v + 0.01 * grad * grad
            change = RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-6)
            if name == "bias":
                self.bias = np.float32(self.bias - change)
            else:
                value -= change.astype(np.float32)
        self.embed[0] = 0

    def fit(self, docs: list[np.ndarray], labels: np.ndarray, seed: int = 11) -> None:
        r = np.random.default_rng(seed)
        met = np.zeros(ROWS, np.int64)
        for rows in docs:
            met[np.unique(rows)] += 1
        self.known = met >= LEAST_DOCS
        docs = [np.where(self.known[rows], rows, 0) for rows in docs]
        share = labels.mean()
        weights = np.where(labels > 0, 0.5 / share, 0.5 / (1 - share))
        moments: dict = {}
        t = 0
        for _ in range(EPOCHS):
            order = r.permutation(len(docs))
            for i in range(0, len(order), BATCH):
                t += 1
                some = order[i : i + BATCH]
                self.step([docs[k] for k in some], labels[some], weights[some], moments, t)
        self.trained = True

    def freeze(self) -> ConvNet:
        """Rows that are not known become zero, for scoring."""
        self.embed = np.where(self.known[:, None], self.embed, np.float32(0))
        self.embed[0] = 0
        return self

    def logits(self, rows: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The logit of each text of a block."""
        length = np.diff(first)
        h = np.zeros((len(length), len(SPANS) * FILTERS), np.float32)
        x = self._words(rows)
        for k, s in enumerate(SPANS):
            n = len(rows) - s + 1
            some = np.flatnonzero(length >= s)
            if n <= 0 or not len(some):
                continue
            a = self._activations(x, k)
            bounds = np.stack((first[some], first[some] + length[some] - s + 1), 1).ravel()
            closed = bounds[-1] == n
            best = np.maximum.reduceat(a, bounds[:-1] if closed else bounds, axis=0)[::2]
            h[some, k * FILTERS : (k + 1) * FILTERS] = np.maximum(best, 0)
        return h @ self.out + self.bias

    def calibrate(self, logits: np.ndarray, labels: np.ndarray, langs: np.ndarray) -> None:
        """The threshold of best F1 for all, and for each language with ten of either label."""
        self.usual_shift = _best_cut(logits, labels)
        for v in np.unique(langs):
            own = langs == v
            if min(labels[own].sum(), (1 - labels[own]).sum()) >= 10:
                self.shift[v] = _best_cut(logits[own], labels[own])

    def scores(self, logits: np.ndarray, langs: np.ndarray, empty: np.ndarray) -> np.ndarray:
        cut = np.array([self.shift.get(v, self.usual_shift) for v in langs])
        x = logits - cut + np.log(CUT / (1 - CUT))
        p = 1 / (1 + np.exp(-np.clip(x, -30, 30)))
        return np.where(empty, np.minimum(p, CUT / 2), p) if self.trained else np.zeros(len(p))


def _best_cut(logits: np.ndarray, labels: np.ndarray) -> float:
    """The middle of the widest gap among the cuts of best F1."""
    order = np.argsort(-logits, kind="stable")
    s, y = logits[order], labels[order]
    hit = np.cumsum(y)
    f1 = 2 * hit / (np.arange(1, len(y) + 1) + y.sum())
    end = np.append(s[1:] < s[:-1], True)
    best = np.flatnonzero(end & (f1 >= f1[end].max() - 1e-12))
    gap = [s[k] - (s[k + 1] if k + 1 < len(s) else s[k] - 1) for k in best]
    k = best[int(np.argmax(gap))]
    return float(s[k] - gap[int(np.argmax(gap))] / 2)


class ToxicityModel:
    def __init__(self, net: ConvNet, languages: LanguageModel):
        self.net, self.languages = net, languages

    def score_block(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        rows, first = word_rows(raw, offsets)
        lang, _ = self.languages.predict_block(raw, offsets)
        return self.net.scores(self.net.logits(rows, first), lang, np.diff(first) == 0)


def learn(docs: DataFrame, labels: DataFrame, usable: Column) -> ToxicityModel:
    """Fitted on labelled documents for which ``usable`` (a condition on doc_id) holds."""
    spark = docs.sparkSession
    prepare(spark)
    languages = learn_languages(docs, usable)
    known = labels.where(usable & F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    counts = dict(known.groupBy("toxic").count().collect())
    rank = F.xxhash64(F.col("doc_id").cast("string"), F.lit(5))
    picked: dict = {}
    for label, most in ((1, LEARN_TOXIC), (0, LEARN_CLEAN)):
        for doc_id, in known.where(F.col("toxic") == label).orderBy(rank, "doc_id").limit(most).select("doc_id").collect():
            picked.setdefault(doc_id, []).append(label)
    net = ConvNet()
    if len(counts) < 2 or not picked:
        return ToxicityModel(net.freeze(), languages)
    chosen = spark.createDataFrame([(k,) for k in picked], f"doc_id {docs.schema['doc_id'].dataType.simpleString()}")

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = spark_languages.value
        for b in batches:
            raw, offsets = tb.arrow_bytes(b.column(1))
            for i, j, r, o in tb.blocks(raw, offsets):
                rows, first = word_rows(r, o)
                lang, _ = own.predict_block(r, o)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(lang, pa.int64()), pa.array([rows[first[k] : first[k + 1]].tobytes() for k in range(j - i)], pa.binary())], ["doc_id", "lang", "rows"])

    spark_languages = spark.sparkContext.broadcast(languages)
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.where("text is not null").select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most LEARN_TOXIC + LEARN_CLEAN ids
    found = sorted((r[0], r[1], bytes(r[2])) for r in texts.mapInArrow(rows_of, f"doc_id {kind}, lang bigint, rows binary").collect())
    samples = [(d, lang, np.frombuffer(rows, np.int32).reshape(-1, 2 + len(HEADS)), y) for d, lang, rows in found for y in picked[d] if rows]
    y = np.array([s[3] for s in samples], np.float64)
    if not 0 < y.sum() < len(y):
        return ToxicityModel(net.freeze(), languages)
    aside = np.zeros(len(y), bool)  # a fifth of either label
    for v in (0, 1):
        own = np.flatnonzero(y == v)
        aside[np.random.default_rng(3).permutation(own)[: len(own) // 5]] = True
    net.fit([s[2] for s, out in zip(samples, aside, strict=True) if not out], y[~aside])
    net.freeze()
    held = np.flatnonzero(aside) if 0 < y[aside].sum() < aside.sum() else np.arange(len(y))
    rows = np.concatenate([samples[k][2] for k in held])
    first = np.concatenate(([0], np.cumsum([len(samples[k][2]) for k in held])))
    net.calibrate(net.logits(rows, first), y[held], np.array([samples[k][1] for k in held]))
    return ToxicityModel(net, languages)


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, score and predicted (1 from CUT on) of each document."""
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for b in batches:
            raw, offsets = tb.arrow_bytes(b.column(1))
            for i, j, r, o in tb.blocks(raw, offsets):
                s = own.score_block(r, o).astype(np.float64)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(s), pa.array((s >= CUT).astype(np.int32))], ["doc_id", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, predicted int")
