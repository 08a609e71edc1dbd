"""Language identification: the family first, then one-versus-one machines within it.

Features are hashed letter bigrams and trigrams, as shares of a text's letters. A linear
support vector machine for each language family (one against the rest) picks the family; a
linear machine for each pair of the family's languages votes for the language, and equal
votes go to the larger sum of pair probabilities. All machines are fitted in numpy on at most
``LEARN_PER_LANG`` documents of each language and about ``LEARN_TOTAL`` in all (at least one of
each language), the ones whose hashed doc_id is smallest. Scoring reads whole texts and nothing but the text.

Defined results: a null text or one without a letter is ``und`` with score 0; with one
learned language every text with letters is that language; with none every text is ``und``;
ties go to the language that sorts first; rows with a null lang are scored, not learned from;
repeated rows get a row each.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from . import textbytes as tb
from .util import prepare

LEARN_PER_LANG, LEARN_TOTAL = 400, 2400
BIGRAMS, TRIGRAMS = 1024, 3072
UNKNOWN = "und"
#: Below this score the pipeline counts a language as not recognised.
REJECT_BELOW = 0.2

#: Language families by language code; a code that is not listed is its own family.
FAMILIES = {
    "germanic": "en de nl da sv no nb nn is af fy lb yi fo".split(),
    "romance": "fr es it pt ro ca gl oc la rm".split(),
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk".split(),
    "baltic": "lt lv".split(),
    "celtic": "ga gd cy br".split(),
    "uralic": "fi et hu".split(),
    "turkic": "tr az kk uz ky tk tt".split(),
    "indic": "hi bn ur pa gu mr ne si".split(),
    "iranian": "fa ps ku tg".split(),
    "semitic": "ar he am mt".split(),
    "sinitic": "zh yue".split(),
    "dravidian": "ta te kn ml".split(),
    "malayic": "id ms jv su".split(),
}
_FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes}

_tables: list[np.ndarray] = []


def _letters() -> tuple[np.ndarray, np.ndarray]:
    """Lower-case code of each character of the basic plane, and whether it is a letter."""
    if not _tables:
        lower = np.arange(1 << 16, dtype=np.uint32)
        letter = np.zeros(1 << 16, bool)
        for i in range(1 << 16):
            c = chr(i)
            if c.isalpha():
                letter[i] = True
                low = c.lower()
                if len(low) == 1:
                    lower[i] = ord(low)
        _tables[:] = [lower, letter]
    return _tables[0], _tables[1]


def code_points(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of a block of texts and the offset of each text in them."""
    points = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32)
    return points, np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))[offsets]


def ngrams(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bigram and trigram feature of each letter, the letter's text, and letters of each text."""
    lower, letter = _letters()
    points, cut = code_points(raw, offsets)
    n = len(cut) - 1
    low = np.minimum(points, 0xFFFF)
    is_letter = letter[low]
    for p in np.unique(points[points > 0xFFFF]):
        if unicodedata.category(chr(p)).startswith("L"):
            is_letter |= points == p
    code = np.where(is_letter, np.where(points > 0xFFFF, points, lower[low]), 0).astype(np.uint32)
    before, after = np.zeros_like(code), np.zeros_like(code)
    before[1:], after[:-1] = code[:-1], code[1:]
    edge = cut[:-1][cut[:-1] < len(code)]
    before[edge] = 0
    after[edge[edge > 0] - 1] = 0
    at = np.flatnonzero(is_letter)
    p, c, q = before[at], code[at], after[at]
    two = (p * np.uint32(0x9E3779B1)) ^ (c * np.uint32(0x85EBCA77))
    three = two ^ (q * np.uint32(0xC2B2AE3D))
    two = ((two ^ (two >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(8)) % np.uint32(BIGRAMS)
    three = ((three ^ (three >> np.uint32(15))) * np.uint32(0x297A2D39) >> np.uint32(8)) % np.uint32(TRIGRAMS) + np.uint32(BIGRAMS)
    first = np.searchsorted(at, cut)
    return two, three, np.repeat(np.arange(n), np.diff(first)), np.diff(first)


def shares(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A row of feature shares for each text, and its letters."""
    two, three, text, letters = ngrams(raw, offsets)
    size = BIGRAMS + TRIGRAMS
    flat = np.concatenate((text * size + two, text * size + three))
    counts = np.bincount(flat, minlength=len(letters) * size).reshape(len(letters), size)
    return (counts / np.maximum(letters, 1)[:, None]).astype(np.float32), letters


def linear_svm(x: np.ndarray, y: np.ndarray, penalty: float = 1e-4, rounds: int = 150) -> tuple[np.ndarray, float]:
    """Weights and bias of a squared-hinge support vector machine, by accelerated gradient; classes weigh the same."""
    n, d = x.shape
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    rate = 1.0 / (2 * float((weight * ((x * x).sum(1) + 1)).sum()) + penalty)
    w, b = np.zeros(d, np.float32), 0.0
    pw, pb, momentum = w, b, 1.0
    for _ in range(rounds):
        slack = np.maximum(0, 1 - y * (x @ pw + pb))
        pull = 2 * weight * slack * y
        nw, nb = pw + rate * (x.T @ pull - penalty * pw), pb + rate * float(pull.sum())
        after = (1 + (1 + 4 * momentum * momentum) ** 0.5) / 2
        k = (momentum - 1) / after
        pw, pb = nw + np.float32(k) * (nw - w), nb + k * (nb - b)
        w, b, momentum = nw, nb, after
    return w, b


class LanguageModel:
    """Family machines and pair machines as columns of one weight table."""

    def __init__(self, x: np.ndarray, langs: list[str]):
        self.langs = sorted(set(langs))
        family = [_FAMILY_OF.get(v, v) for v in self.langs]
        self.families = sorted(set(family))
        self.family_of = np.array([self.families.index(f) for f in family], np.int64)
        self.pairs = [(i, j) for i, j in combinations(range(len(self.langs)), 2) if family[i] == family[j]]
        y = np.array([self.langs.index(v) for v in langs])
        scale = 1 / np.sqrt(x.mean(0) + 1e-4) if len(x) else np.ones(BIGRAMS + TRIGRAMS)
        x = (x * scale).astype(np.float32)
        x /= max(1e-9, float(np.sqrt((x * x).sum(1).mean()))) if len(x) else 1
        self.norm = scale
        columns, self.bias = [], []
        of_family = self.family_of[y] if len(y) else y
        fam = range(len(self.families)) if len(self.families) > 1 else ()
        tasks = [(np.ones(len(y), bool), of_family == k) for k in fam] + [((y == i) | (y == j), y == i) for i, j in self.pairs]
        for rows, positive in tasks:
            w, b = linear_svm(x[rows], np.where(positive[rows], 1, -1).astype(np.float32))
            columns.append(w)
            self.bias.append(b)
        self.bias = np.array(self.bias, np.float32)
        self.table = np.stack(columns, 1) if columns else np.zeros((BIGRAMS + TRIGRAMS, 0), np.float32)

    def finish(self, factor: np.ndarray) -> LanguageModel:
        """Fold the feature scale into the weights, so that scoring only sums looked-up rows."""
        self.table = np.ascontiguousarray(self.table * factor[:, None].astype(np.float32))
        return self

    def predict_block(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index into langs (-1: und) and score of each text of a block."""
        two, three, _, letters = ngrams(raw, offsets)
        n = len(letters)
        best, score = np.full(n, -1), np.zeros(n)
        some = np.flatnonzero(letters)
        if not len(some) or not self.langs:
            return best, score
        if self.table.shape[1]:
            total = self.table[two] + self.table[three]
            first = (np.cumsum(letters) - letters)[some]
            margin = np.add.reduceat(total, first, axis=0, dtype=np.float64) / letters[some][:, None] + self.bias
        else:
            margin = np.zeros((len(some), 0))
        p = 1 / (1 + np.exp(-np.clip(4 * margin, -50, 50)))
        nf = len(self.families) if len(self.families) > 1 else 0
        fam = p[:, :nf] / p[:, :nf].sum(1, keepdims=True) if nf else np.ones((len(some), 1))
        votes, sums, met = (np.zeros((len(some), len(self.langs))) for _ in range(3))
        for k, (i, j) in enumerate(self.pairs):
            q = p[:, nf + k]
            votes[:, i] += q >= 0.5
            votes[:, j] += q < 0.5
            sums[:, i] += q
            sums[:, j] += 1 - q
            met[:, [i, j]] += 1
        within = np.where(met > 0, sums / np.maximum(met, 1), 1.0)
        chosen = fam.argmax(1)
        rank = np.where(self.family_of[None, :] == chosen[:, None], votes + within / (len(self.langs) + 1), -1)
        top = rank.argmax(1)
        rows = np.arange(len(some))
        best[some], score[some] = top, fam[rows, chosen] * within[rows, top]
        return best, score


def learn(docs: DataFrame, usable: Column) -> LanguageModel:
    """The model of the rows for which ``usable`` holds; docs has doc_id, text and lang."""
    prepare(docs.sparkSession)
    rows = docs.where(usable & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = dict(rows.groupBy("lang").count().collect())  # a row for each language
    per = max(1, min(LEARN_PER_LANG, LEARN_TOTAL // max(1, len(counts))))
    rank = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 20))
    limit = F.create_map(*(F.lit(v) for k, c in counts.items() for v in (k, float(min(1.0, 2.0 * per / c + 50 / c))))) if counts else None
    if limit is None:
        return LanguageModel(np.zeros((0, BIGRAMS + TRIGRAMS), np.float32), []).finish(np.ones(BIGRAMS + TRIGRAMS))
    few = rows.select("doc_id", "text", "lang", rank.alias("rank")).where(F.col("rank") <= limit[F.col("lang")] * (1 << 20))
    few = few.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("rank", "doc_id", F.xxhash64("text")))).where(F.col("k") <= per)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, offsets = tb.arrow_bytes(b.column(0))
            for i, j, r, o in tb.blocks(raw, offsets, 1 << 17):
                x, letters = shares(r, o)
                keep = np.flatnonzero(letters)
                yield pa.RecordBatch.from_arrays([b.column(1).slice(i, j - i).take(pa.array(keep)), pa.array([x[k].tobytes() for k in keep], pa.binary())], ["lang", "shares"])

    found = few.select("text", F.col("lang").cast("string").alias("lang")).mapInArrow(features, "lang string, shares binary").collect()
    found.sort(key=lambda r: (r[0], bytes(r[1])))
    x = np.stack([np.frombuffer(r[1], np.float32) for r in found]) if found else np.zeros((0, BIGRAMS + TRIGRAMS), np.float32)
    model = LanguageModel(x, [r[0] for r in found])
    scaled = x * model.norm
    size = float(np.sqrt((scaled * scaled).sum(1).mean())) if len(x) else 1.0
    return model.finish(model.norm / max(1e-9, size))


def identify(docs: DataFrame, model: LanguageModel, columns: list[str] | None = None, least: float | None = None) -> DataFrame:
    """``columns`` of each document with lang_pred and score; with ``least``, only recognised rows with their own columns."""
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    columns = columns or ["doc_id"]
    names = docs.columns if least is not None else [*columns, "text"]
    at = names.index("text")
    n_out = len(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        langs = np.array([*own.langs, UNKNOWN], object)
        for b in batches:
            raw, offsets = tb.arrow_bytes(b.column(at))
            parts = [own.predict_block(r, o) for _, _, r, o in tb.blocks(raw, offsets)]
            best = np.concatenate([np.zeros(0, np.int64), *(x for x, _ in parts)]).astype(np.int64)
            score = np.concatenate([np.zeros(0), *(x for _, x in parts)])
            if least is not None:
                yield b.filter(pa.array((best >= 0) & (score >= least)))
            else:
                yield pa.RecordBatch.from_arrays([*b.columns[:n_out], pa.array(langs[best], pa.string()), pa.array(np.clip(score, 0, 1))], [*columns, "lang_pred", "score"])

    if least is not None:
        return docs.mapInArrow(run, docs.schema)
    schema = T.StructType([*(docs.schema[c] for c in columns), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.select(*names).mapInArrow(run, schema)
