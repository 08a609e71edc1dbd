"""N-gram Jaccard join with Bayesian candidate pruning.

Words are runs of ASCII letters (lower-cased), digits and non-ASCII characters; a document
is the set of its five-word shingles (the whole of a text of one to four words is its only
shingle). Documents with the same word sequence are copies and form one class at once; a text
is known by two hashes of that sequence, whatever its doc_id, and goes on once.

1. Candidates: banded MinHash (``BANDS`` bands of ``ROWS``; a pair at similarity 0.8 is
   missed with probability 5e-6, at 0.85 with 6e-9). A bucket contributes a star around its
   smallest member, never its pairs; connected stars are clusters.
2. A cluster's shingle sets meet in blocks of bounded size; each pair of blocks is a task,
   so a cluster of any size is spread and every pair of its members is looked at exactly once.
   Exact numbers of links need that: n different texts of one cluster take (n / BLOCK_DOCS)^2 / 2 tasks.
3. Within a task, pairs pass a size filter; MinHash values are compared in steps of
   ``STEP``, and a pair is dropped once the posterior probability (uniform prior) that its
   similarity reaches the threshold is under ``TOLERANCE``. What is left is verified exactly
   on the sets. A task returns the links of each member as a number and a spanning forest.

Defined results: null, empty and word-less texts have no shingles, so no links and classes of
their own; repeated rows get a row each with the same class; rows with a null or a shared
doc_id are told apart by their texts, take part like all others, and a class is named by the
smallest doc_id in it (null where it has none); ties go to the smaller doc_id; long texts
are whole; an empty table gives no rows. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from math import lgamma

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbytes as tb
from .graph import components
from .util import fresh, partitions, prepare, row_key, stored, written

SHINGLE_WORDS = 5
THRESHOLD = 0.8
BANDS, ROWS = 40, 6
STEP, STEPS = 16, 8
TOLERANCE = 1e-6
#: Bounds of a block of a cluster: documents and words.
BLOCK_DOCS, BLOCK_WORDS = 1024, 400_000
#: Texts in clusters up to which their list (some 100 bytes each) is broadcast to the documents; beyond, both are shuffled.
BROADCAST_MEMBERS = 500_000


def _hash_family(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(seed)
    return r.integers(0, 1 << 32, n, dtype=np.uint32), r.integers(0, 1 << 31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def _minima(shingles: np.ndarray, starts: np.ndarray, family: tuple[np.ndarray, np.ndarray]) -> Iterator[np.ndarray]:
    """For each hash function, the least value in each of the consecutive segments."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    v = np.empty_like(x)
    for c, a in zip(*family, strict=True):
        np.bitwise_xor(x, c, out=v)
        np.multiply(v, a, out=v)
        yield np.minimum.reduceat(v, starts)


def shingle_sets(raw: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, tb.Words, np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of texts: (first text, words, shingles, first shingle of each text and the end)."""
    for first, _, r, o in tb.blocks(raw, offsets):
        w = tb.Words(r, o, tb.ALNUM, tb.FOLDED)
        at, shingles = w.windows(SHINGLE_WORDS)
        yield first, w, shingles, np.searchsorted(at, w.first), w.first


def _sequence_keys(w: tb.Words) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each text's word sequence."""
    n = len(w.hashes)
    place = np.arange(n) - w.first[w.text]
    out = []
    for seed in (0x2545F4914F6CDD1D, 0x9FB21C651E98DF25):
        v = tb.mix(w.hashes ^ tb.mix(place.astype(np.uint64) + np.uint64(seed)))
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(v)))
        out.append(tb.mix(sums[w.first[1:]] - sums[w.first[:-1]] + np.diff(w.first).astype(np.uint64)).view(np.int64))
    return out[0], out[1]


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, row key (d, th), copy key (k1, k2), words, and the band hashes of texts with a full shingle."""
    family = _hash_family(BANDS * ROWS, 8)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, offsets = tb.arrow_bytes(b.column(3))
            at = 0
            for first, w, shingles, cut, words in shingle_sets(raw, offsets):
                n = len(words) - 1
                k1, k2 = _sequence_keys(w)
                has = np.flatnonzero(np.diff(cut))
                bands = np.zeros((len(has), BANDS), np.uint64)
                if len(has):
                    for k, m in enumerate(_minima(shingles, cut[has], family)):
                        band = bands[:, k // ROWS]
                        band[:] = band * np.uint64(0x9E3779B97F4A7C15) + m + np.uint64(k + 1)
                    bands = tb.mix(bands + np.arange(BANDS, dtype=np.uint64))
                length = np.zeros(n + 1, np.int32)
                length[1:][has] = BANDS
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum(length), pa.int32()), pa.array(bands.view(np.int64).ravel(), pa.int64()))
                yield pa.RecordBatch.from_arrays([*(b.column(c).slice(at, n) for c in range(3)), pa.array(k1), pa.array(k2), pa.array(np.diff(words), pa.int64()), lists], ["doc_id", "d", "th", "k1", "k2", "n_words", "bands"])
                at += n

    d, th = row_key()
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), d.alias("d"), th.alias("th"), "text")
    return docs.mapInArrow(sign, "doc_id bigint, d bigint, th bigint, k1 bigint, k2 bigint, n_words bigint, bands array<bigint>")


def _log_choose_tail(m: int, n: int, t: float) -> float:
    """P(J >= t | m of n values agree) under a uniform prior: the upper tail of Beta(m+1, n-m+1)."""
    a, b = m + 1, n - m + 1  # integer parameters: a binomial sum
    total, logt, log1 = 0.0, np.log(t), np.log1p(-t)
    for j in range(a):  # P(Binomial(a+b-1, t) <= a-1)
        k = a + b - 1
        total += np.exp(lgamma(k + 1) - lgamma(j + 1) - lgamma(k - j + 1) + j * logt + (k - j) * log1)
    return min(1.0, total)


def least_matches(threshold: float, tolerance: float) -> list[int]:
    """After each step, how many values must agree for a pair to stay."""
    return [next(m for m in range(n + 1) if _log_choose_tail(m, n, threshold) >= tolerance) for n in range(STEP, STEP * STEPS + 1, STEP)]


class _Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        if i != j:
            self.up[max(i, j)] = min(i, j)


def linked(sets: list[np.ndarray], sides: np.ndarray, both: bool, threshold: float, needed: list[int], family: tuple[np.ndarray, np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
    """(i, [j...]) for the linked pairs i < j; with ``both``, only those between side 0 and side 1."""
    size = np.array([len(s) for s in sets])
    cut = np.concatenate(([0], np.cumsum(size)))
    every = np.concatenate(sets)
    signature = np.stack(list(_minima(every, cut[:-1], family)), 1)
    _, local = np.unique(every, return_inverse=True)
    marked = np.zeros(local.max() + 1, bool)
    for i in range(len(sets) - 1):
        j = np.arange(i + 1, len(sets))
        if both:
            j = j[sides[j] != sides[i]]
        j = j[np.minimum(size[j], size[i]) >= threshold * np.maximum(size[j], size[i]) - 1e-9]
        agree = np.zeros(len(j), np.int64)
        for k, least in enumerate(needed):
            if not len(j):
                break
            part = slice(k * STEP, (k + 1) * STEP)
            agree += (signature[j, part] == signature[i, part]).sum(1)
            stay = agree >= least
            j, agree = j[stay], agree[stay]
        if not len(j):
            continue
        own = local[cut[i] : cut[i + 1]]
        marked[own] = True
        n = size[j]
        ends = np.cumsum(n)
        spread = np.repeat(cut[j] - (ends - n), n) + np.arange(ends[-1])
        shared = np.add.reduceat(marked[local[spread]].astype(np.int64), ends - n)
        marked[own] = False
        j = j[shared >= threshold * (n + size[i] - shared) - 1e-9]
        if len(j):
            yield i, j


def _verify(threshold: float, tolerance: float):
    needed = least_matches(threshold, tolerance)
    family = _hash_family(STEP * STEPS, 88)

    def task(p: int, q: int, rows: Iterator[tuple]) -> tuple[list, list, list]:
        """rows: (text's key, block, set) of the blocks p and q; each text's links here and the root of its tree.

        Blocks are drawn by hash, so one may be empty: what is left of a pair of blocks is then one block, whose pairs are task (p, p)'s.
        """
        seen: dict = {}
        for k1, k2, block, data in rows:
            if (k1, k2) not in seen:  # repeated rows of the table give the same set again
                seen[k1, k2] = (block, np.frombuffer(data, np.uint64))
        ids = sorted(seen)
        sides = np.array([seen[x][0] for x in ids])
        if p != q and sides.min() == sides.max():
            return [], [], []
        forest, degree = _Forest(len(ids)), np.zeros(len(ids), np.int64)
        if len(ids) > 1:
            for i, js in linked([seen[x][1] for x in ids], sides, p != q, threshold, needed, family):
                degree[i] += len(js)
                degree[js] += 1
                for j in js.tolist():
                    forest.join(i, j)
        return ids, degree.tolist(), [ids[forest.find(k)] for k in range(len(ids))]

    names = [c.split()[0] for c in _FOUND.split(", ")]

    def batch(out: list[list]) -> pa.RecordBatch:
        ids, degree, root, split = out
        columns = [[x[0] for x in ids], [x[1] for x in ids], degree, [x[0] for x in root], [x[1] for x in root]]
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns), pa.array(split, pa.bool_())], names)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def stream():
            for b in batches:
                yield from zip(*(c.to_pylist() for c in b.columns), strict=True)

        out: list[list] = [[], [], [], []]
        for key, rows in groupby(stream(), key=lambda r: r[:4]):
            ids, degree, root = task(key[1], key[2], (r[4:] for r in rows))
            for column, values in zip(out, (ids, degree, root, [key[3] > 1] * len(ids)), strict=True):
                column += values
            if len(out[0]) >= 5000:
                yield batch(out)
                out = [[], [], [], []]
        if out[0]:
            yield batch(out)

    return verify


def _sets(docs: DataFrame) -> DataFrame:
    """label, p, q, nb, text's key, block and the sorted shingle set, from (k1, k2, text, label, nb, block); repeated rows of one task go once."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for b in batches:
            new = []
            for key in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                new.append(key not in seen)
                seen.add(key)
            b = b if all(new) else b.filter(pa.array(new))
            raw, offsets = tb.arrow_bytes(b.column(2))
            sets = []
            for _, _, shingles, cut, words in shingle_sets(raw, offsets):
                sets += [np.unique(shingles[cut[k] : cut[k + 1]]).tobytes() for k in range(len(words) - 1)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), b.column(4), b.column(5), pa.array(sets, pa.binary())], ["k1", "k2", "label", "nb", "block", "shingles"])

    made = docs.select("k1", "k2", "text", "label", "nb", "block").mapInArrow(build, "k1 bigint, k2 bigint, label bigint, nb int, block int, shingles binary")
    other = F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("other")
    return made.select("*", other).select("label", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), "nb", "k1", "k2", "block", "shingles")


_FOUND = "k1 bigint, k2 bigint, n_links bigint, r1 bigint, r2 bigint, split boolean"


def _classes(docs: DataFrame, threshold: float, tolerance: float) -> tuple[DataFrame, DataFrame]:
    """Signatures of the rows, and for each different text (k1, k2): rep (smallest doc_id), a row of it (d, th), its group, n_links."""
    spark = docs.sparkSession
    prepare(spark)
    docs = docs.select("doc_id", "text")
    signed = stored(signatures(docs))
    wordy = signed.where("n_words > 0")
    reps = wordy.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.coalesce(F.min_by("th", "doc_id"), F.min("th")).alias("th"), F.max("n_words").alias("n_words")).withColumn("d", F.coalesce("rep", F.lit(0)))
    banded = wordy.where(F.size("bands") > 0)
    chosen = banded.join(reps.select("k1", "k2", "d", "th"), ["k1", "k2", "d", "th"])
    # candidates alone go by one hash: texts that share it meet in one cluster, and are told apart there
    bucket = chosen.select("k1", F.explode("bands").alias("band"))
    heads = bucket.groupBy("band").agg(F.min("k1").alias("head"), F.max("k1").alias("last")).where("head < last").select("band", "head")
    stars = bucket.join(heads, "band").where("k1 <> head").select(F.col("k1").alias("a"), F.col("head").alias("b"))
    clusters = components(stars)

    member = clusters.select(F.col("v").alias("k1"), F.col("component").alias("label")).join(reps, "k1")
    blocks = member.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum("n_words").alias("words"))
    blocks = blocks.select("label", F.ceil(F.greatest(F.col("n") / BLOCK_DOCS, F.col("words") / BLOCK_WORDS)).cast("int").alias("nb"))
    member = written(member.join(blocks, "label").select("k1", "k2", "d", "th", "label", "nb", F.pmod(F.xxhash64("k1", "k2"), F.col("nb")).cast("int").alias("block")), "members", compact=True)
    d, th = row_key()
    few = member.count() <= BROADCAST_MEMBERS
    texts = docs.select(d.alias("d"), th.alias("th"), "text").join(F.broadcast(member) if few else member, ["d", "th"])
    tasks = _sets(texts).repartition(partitions(spark), "label", "p", "q").sortWithinPartitions("label", "p", "q")
    found = stored(tasks.select("label", "p", "q", "nb", "k1", "k2", "block", "shingles").mapInArrow(_verify(threshold, tolerance), _FOUND))

    root = F.min(F.struct(F.col("r1").alias("k1"), F.col("r2").alias("k2")))
    whole = found.groupBy("k1", "k2").agg(F.sum("n_links").alias("n_links"), root.alias("root"), F.max("split").alias("split"))
    own, up = F.struct("k1", "k2"), F.struct(F.col("r1").alias("k1"), F.col("r2").alias("k2"))
    spread = components(found.where("split and (k1 <> r1 or k2 <> r2)").select(own.alias("a"), up.alias("b")))
    spread = spread.select("v.k1", "v.k2", "component")
    whole = whole.join(spread, ["k1", "k2"], "left").select("k1", "k2", "n_links", F.when(F.col("split"), F.coalesce("component", own)).otherwise(F.col("root")).alias("group"))
    linked_ = reps.join(whole, ["k1", "k2"], "left")
    return signed, linked_.select("k1", "k2", "rep", "d", "th", F.coalesce("group", own).alias("group"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """doc_id, copy_id (smallest doc_id with these words), class_id (smallest doc_id of its group of linked texts), n_links.

    n_links counts the different texts whose similarity reaches the threshold; each counts
    once, however many copies it has.
    """
    signed, classes = _classes(docs, threshold, tolerance)
    named = classes.where("n_links > 0").groupBy("group").agg(F.min("rep").alias("class_id"))
    classes = classes.join(named, "group", "left").select("k1", "k2", "rep", F.coalesce("class_id", "rep").alias("class_id"), "n_links")
    out = signed.select("doc_id", "k1", "k2", "n_words").join(classes, ["k1", "k2"], "left")
    own = lambda c: F.when(F.col("n_words") > 0, F.col(c)).otherwise(F.col("doc_id"))
    return out.select("doc_id", own("rep").alias("copy_id"), own("class_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """One row of each class, the one of smallest doc_id (a null one only where all are null); texts without words all stay."""
    signed, classes = _classes(docs, THRESHOLD, TOLERANCE)
    alone = classes.where("n_links = 0").select("d", "th")
    first = classes.where("n_links > 0").groupBy("group").agg(F.min(F.struct(F.col("rep").isNull().alias("unnamed"), "d", "th")).alias("row")).select("row.d", "row.th")
    wordless = signed.where("n_words = 0").select("d", "th").distinct()
    d, th, one = (fresh(c, docs.columns) for c in ("row_d", "row_th", "row_one"))
    keepers = alone.unionByName(first).withColumn("one", F.lit(True)).unionByName(wordless.withColumn("one", F.lit(False))).select(F.col("d").alias(d), F.col("th").alias(th), F.col("one").alias(one))
    a, b = row_key()
    kept = docs.withColumns({d: a, th: b}).join(keepers, [d, th])
    # of repeated rows one stays; a number of its own keeps each text without words
    kept = kept.withColumn(one, F.when(F.col(one), F.lit(-1)).otherwise(F.monotonically_increasing_id())).dropDuplicates([d, th, one])
    return kept.drop(d, th, one)
