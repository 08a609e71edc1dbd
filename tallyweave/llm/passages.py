"""Quality: attention-based multiple-instance learning over the passages of a text.

A text is a bag of passages of ``PASSAGE_WORDS`` words. A passage's features are the shares of
pairs of neighbouring byte kinds (capital, small letter, digit, space, each group of signs) and a
few shares over its words; an encoder turns them into a small vector. Two learned gates (a tanh
and a sigmoid, multiplied) weigh the passages of a text, the weights add up to one, and a
logistic layer scores the weighted vector. Only documents have labels: the encoder, the gates and
the score are learned together, in numpy, by gradients through all of them.

It learns from at most ``LEARN_EACH`` labelled documents of each label, those whose hashed doc_id
is smallest, and of a learning document from at most ``LEARN_PASSAGES`` passages, evenly spread
over it, so what reaches the driver is bounded. Scoring encodes every passage of every text and
reads the text alone; a task works on about 256 KB of text, or one longer text, at once.

Defined results: a null, empty or word-less text has no passage and scores 0; a null label, or a
labelled document without words, is not learned from; several labels of a document count each;
without both labels every score is 0; repeated rows get a row each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textbytes as tb
from .util import prepare

PASSAGE_WORDS = 64
LEARN_EACH, LEARN_PASSAGES = 1500, 32
WIDTH, GATE = 16, 8
EPOCHS, BATCH, RATE, DECAY = 30, 32, 0.01, 1e-4
CUT = 0.5

#: Kinds of bytes: 0 small letter or beyond ASCII, 1 capital, 2 digit, 3 blank, 4 line end, then groups of signs.
_GROUPS = (".", ",;:", "!", "?", "'\"()[]{}`", "-_/\\", "|", "#", "$", "%", "&", "*", "<>=+~^@")
KINDS = 5 + len(_GROUPS)
_KIND = np.zeros(256, np.int64)
_KIND[65:91], _KIND[48:58], _KIND[:33], _KIND[10] = 1, 2, 3, 4
for _k, _signs in enumerate(_GROUPS):
    _KIND[[ord(c) for c in _signs]] = 5 + _k
FEATURES = KINDS * KINDS + 3


def features(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A row for each passage of a block of texts, and the first passage of each text."""
    w = tb.Words(raw, offsets, tb.NONSPACE, tb.PLAIN)
    words = np.diff(w.first)
    count = -(-words // PASSAGE_WORDS)
    first = np.concatenate(([0], np.cumsum(count)))
    n = int(first[-1])
    if not n:
        return np.zeros((0, FEATURES), np.float32), first
    of_word = first[:-1][w.text] + (np.arange(len(w.text)) - w.first[:-1][w.text]) // PASSAGE_WORDS
    begin = w.starts[np.flatnonzero(np.append(True, of_word[1:] != of_word[:-1]))]
    kind = _KIND[raw]
    of_byte = np.searchsorted(begin, np.arange(len(raw) - 1), "right") - 1  # what stands before a text's first word counts to the passage before
    pairs = kind[:-1] * KINDS + kind[1:]
    lead = of_byte >= 0
    x = np.bincount(of_byte[lead] * (KINDS * KINDS) + pairs[lead], minlength=n * KINDS * KINDS).reshape(n, -1).astype(np.float32)
    x = np.sqrt(x / np.maximum(1, x.sum(1, keepdims=True)))
    size = np.bincount(of_word, minlength=n)
    _, once = np.unique(tb.mix(w.hashes ^ tb.mix(of_word.astype(np.uint64))), return_index=True)
    distinct = np.bincount(of_word[once], minlength=n) / size
    again = np.bincount(of_word[1:], (w.hashes[1:] == w.hashes[:-1]) & (w.text[1:] == w.text[:-1]), minlength=n) / size
    length = np.bincount(of_word, np.minimum(w.ends - w.starts, 40), minlength=n) / size / 10
    return np.concatenate((x, np.stack((distinct, again, length), 1).astype(np.float32)), 1), first


def _by_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of rows by text; texts without passages have 0."""
    out = np.zeros((len(first) - 1, *values.shape[1:]), values.dtype)
    some = np.flatnonzero(np.diff(first))
    if len(some):
        out[some] = np.add.reduceat(values, first[some], axis=0)
    return out


class AttentionModel:
    """Encoder, gated attention and logistic layer."""

    def __init__(self, seed: int = 13):
        r = np.random.default_rng(seed)
        draw = lambda *shape: r.normal(size=shape) / np.sqrt(shape[0])
        self.w = {"encode": draw(FEATURES, WIDTH), "shift": np.zeros(WIDTH), "v": draw(WIDTH, GATE), "u": draw(WIDTH, GATE), "gate": draw(GATE), "out": draw(WIDTH), "bias": np.zeros(1)}
        self.mean, self.scale, self.trained = np.zeros(FEATURES, np.float32), np.ones(FEATURES, np.float32), False

    def forward(self, x: np.ndarray, first: np.ndarray) -> dict:
        """Everything on the way from standardised features to the logit of each text."""
        w, n = self.w, np.diff(first)
        h = np.tanh(x @ w["encode"] + w["shift"])
        t, s = np.tanh(h @ w["v"]), 1 / (1 + np.exp(-np.clip(h @ w["u"], -30, 30)))
        e = (t * s) @ w["gate"]
        top = np.zeros(len(n))
        some = np.flatnonzero(n)
        if len(some):
            top[some] = np.maximum.reduceat(e, first[some])
        e = np.exp(e - np.repeat(top, n))
        a = e / np.repeat(np.maximum(_by_text(e, first), 1e-300), n)
        z = _by_text(a[:, None] * h, first)
        return {"h": h, "t": t, "s": s, "a": a, "z": z, "logit": z @ w["out"] + w["bias"][0]}

    def gradients(self, x: np.ndarray, first: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> dict:
        """Of the weighted mean logistic loss."""
        w, n, f = self.w, np.diff(first), self.forward(x, first)
        h, t, s, a = f["h"], f["t"], f["s"], f["a"]
        d = (1 / (1 + np.exp(-np.clip(f["logit"], -30, 30))) - labels) * weights / len(labels)
        dz = np.repeat(d[:, None] * w["out"], n, axis=0)
        da = (dz * h).sum(1)
        de = a * (da - np.repeat(_by_text(a * da, first), n))
        dg = de[:, None] * w["gate"]
        dt, ds = dg * s * (1 - t * t), dg * t * s * (1 - s)
        dh = (a[:, None] * dz + dt @ w["v"].T + ds @ w["u"].T) * (1 - h * h)
        return {"encode": x.T @ dh, "shift": dh.sum(0), "v": h.T @ dt, "u": h.T @ ds, "gate": (t * s).T @ de, "out": f["z"].T @ d, "bias": np.array([d.sum()])}

    def fit(self, x: np.ndarray, first: np.ndarray, labels: np.ndarray, seed: int = 14) -> None:
        """Adam over bags; both labels weigh the same."""
        self.mean, self.scale = x.mean(0), 1 / np.maximum(x.std(0), 0.02)
        x = ((x - self.mean) * self.scale).astype(np.float64)
        share = labels.mean()
        weights = np.where(labels > 0, 0.5 / share, 0.5 / (1 - share))
        r, n, step = np.random.default_rng(seed), np.diff(first), 0
        moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.w.items()}
        for _ in range(EPOCHS):
            order = r.permutation(len(labels))
            for k in range(0, len(order), BATCH):
                some = order[k : k + BATCH]
                at = np.concatenate([np.arange(first[i], first[i + 1]) for i in some])
                step += 1
                for name, g in self.gradients(x[at], np.concatenate(([0], np.cumsum(n[some]))), labels[some], weights[some]).items():
                    g = g + DECAY * self.w[name]
                    m, v = moments[name] = (0.9 * moments[name][0] + 0.1 * g, 0.99 * moments[name][1] + 0.01 * g * g)
                    self.w[name] = self.w[name] - RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        self.trained = True

    def score_block(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        x, first = features(raw, offsets)
        if not self.trained:
            return np.zeros(len(offsets) - 1)
        p = 1 / (1 + np.exp(-np.clip(self.forward((x - self.mean) * self.scale, first)["logit"], -30, 30)))
        return np.where(np.diff(first) > 0, p, 0.0)


def learn(docs: DataFrame, labels: DataFrame, usable: Column) -> AttentionModel:
    """Fitted on labelled documents for which ``usable`` (a condition on doc_id) holds."""
    spark = docs.sparkSession
    prepare(spark)
    known = labels.where(usable & F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col("quality").cast("int").alias("quality"))
    rank = F.xxhash64(F.col("doc_id").cast("string"), F.lit(7))
    picked: dict = {}
    for label in (1, 0):
        for doc_id, in known.where(F.col("quality") == label).orderBy(rank, "doc_id").limit(LEARN_EACH).select("doc_id").collect():
            picked.setdefault(doc_id, []).append(label)
    model = AttentionModel()
    if not picked:
        return model
    kind = docs.schema["doc_id"].dataType.simpleString()
    chosen = spark.createDataFrame([(k,) for k in picked], f"doc_id {kind}")

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, offsets = tb.arrow_bytes(b.column(1))
            for i, j, r, o in tb.blocks(raw, offsets):
                x, first = features(r, o)
                n = np.diff(first)
                rows = [x[first[k] + np.unique(np.linspace(0, n[k] - 1, min(n[k], LEARN_PASSAGES)).astype(np.int64))].astype(np.float16).tobytes() if n[k] else b"" for k in range(j - i)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(rows, pa.binary())], ["doc_id", "bag"])

    texts = docs.where("text is not null").select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most 2 * LEARN_EACH ids
    # a row is at most LEARN_PASSAGES passages of half-precision features; a document that is repeated counts once
    bag = texts.mapInArrow(bags, f"doc_id {kind}, bag binary").groupBy("doc_id").agg(F.min("bag").alias("bag"))
    samples = [(np.frombuffer(bytes(x), np.float16).reshape(-1, FEATURES), y) for d, x in sorted((r[0], bytes(r[1])) for r in bag.collect()) if x for y in picked[d]]
    y = np.array([s[1] for s in samples], np.float64)
    if not 0 < y.sum() < len(y):
        return model
    first = np.concatenate(([0], np.cumsum([len(s[0]) for s in samples])))
    model.fit(np.concatenate([s[0] for s in samples]).astype(np.float32), first, y)
    return model


def score(docs: DataFrame, model: AttentionModel) -> DataFrame:
    """doc_id, score and predicted (1 from CUT on) of each document."""
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for b in batches:
            raw, offsets = tb.arrow_bytes(b.column(1))
            for i, j, r, o in tb.blocks(raw, offsets):
                s = own.score_block(r, o)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(s), pa.array((s >= CUT).astype(np.int32))], ["doc_id", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, predicted int")
