"""Ranked lexical search: exact best documents for each query, by variable-block-max WAND within shards.

One pass counts, for each document, all its terms and those that occur in the queries; what it
writes is the index's raw material and gives the collection's counts. A second pass builds an
index of each shard (as many documents as stay under ``SHARD_POSTINGS`` postings): posting lists
with integer impacts, cut into blocks of different lengths. Dynamic programming chooses the
borders that make the sum of (block's maximum - impact) over all postings plus a charge for each
block least. A query's lists split the documents of a shard into ranges between block borders,
and the maxima of the blocks that cover a range bound every score in it. The most promising ranges
give a threshold (the score of the k-th best so far, carried from shard to shard of a task); lists
whose maxima together stay under it cannot lift a document over it alone, so the pivots are the
documents of the other lists, read in blocks that touch a range whose bound reaches the threshold;
the former lists are looked up for pivots that can still reach it. What the tasks find is merged.

Scores are whole numbers: a term's weight floor(1000 ln((2N+2)/(2df+1))) times
(10^9 tf) div (1000 tf + 12 m), with m = 75 + (25 n N) div L for a document of n terms.

Defined results: a null or term-less text has no terms, counts for nothing and is not found;
a query without known terms finds nothing; rows of documents and of queries are taken one by
one, repeated ones too; equal scores are ordered by doc_id (without one: last). Terms are told
apart by the library's 62-bit hashes. Very long texts are one block of work.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textbytes as tb
from .util import prepare, written

MOST_FOUND = 20
#: Bytes of query text that one pass over the documents searches; more is searched in several.
QUERY_BLOCK_BYTES = 4 << 20
#: Postings and documents of one shard's index.
SHARD_POSTINGS, SHARD_DOCS = 2 << 20, 1 << 16
#: Block borders lie at multiples of so many postings of a list (of one posting up to ``SHORT_LIST``); a block has at most so many
#: such steps; what a block costs, in standard deviations of its list's impacts.
STEP, SHORT_LIST, MOST_STEPS, BLOCK_CHARGE = 8, 1000, 48, 8.0
#: Ranges that are scored first, for a threshold.
FIRST_RANGES = 64
#: Parts in which a query's results are reduced before the last ranking.
MERGE_PARTS = 32


@dataclass
class Queries:
    """Queries as sorted term hashes, and for each query the places of its terms there with their repeats."""

    ids: list
    terms: np.ndarray
    first: np.ndarray
    place: np.ndarray
    times: np.ndarray

    @staticmethod
    def of(ids: list, texts: list[str | None]) -> Queries:
        raw, offsets = tb.arrow_bytes(pa.array(texts, pa.large_string()))
        w = tb.Words(raw, offsets, tb.ALNUM, tb.FOLDED)
        terms, at = np.unique(w.hashes, return_inverse=True)
        pairs, times = np.unique(w.text * max(1, len(terms)) + at, return_counts=True)
        query, place = np.divmod(pairs, max(1, len(terms)))
        return Queries(ids, terms, np.searchsorted(query, np.arange(len(ids) + 1)), place, times)


def term_counts(docs: DataFrame, queries: Queries) -> DataFrame:
    """doc_id, n (terms of the document), and the query terms in it (places, ascending) with their counts."""
    shared = docs.sparkSession.sparkContext.broadcast(queries.terms)  # at most QUERY_BLOCK_BYTES of text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = shared.value
        size = max(1, len(terms))
        for b in batches:
            raw, offsets = tb.arrow_bytes(b.column(1))
            for i, j, r, o in tb.blocks(raw, offsets):
                w = tb.Words(r, o, tb.ALNUM, tb.FOLDED)
                at = np.minimum(np.searchsorted(terms, w.hashes), size - 1)
                met = np.flatnonzero(terms[at] == w.hashes) if len(terms) else np.zeros(0, np.int64)
                pairs, counts = np.unique(w.text[met] * size + at[met], return_counts=True)
                text, place = np.divmod(pairs, size)
                lists = np.searchsorted(text, np.arange(j - i + 1)).astype(np.int32)
                found = [pa.ListArray.from_arrays(pa.array(lists), pa.array(x.astype(np.int32))) for x in (place, counts)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(np.diff(w.first), pa.int64()), *found], ["doc_id", "n", "terms", "counts"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, n bigint, terms array<int>, counts array<int>")


def collection(counted: DataFrame, n_terms: int) -> tuple[int, int, np.ndarray]:
    """N, L, and each query term's number of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(n_terms, np.int64)
        for b in batches:
            held += np.bincount(b.column(0).flatten().to_numpy(zero_copy_only=False), minlength=n_terms)
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(held[at])], ["term", "n"])

    n, total = counted.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(n_terms, np.int64)
    for term, k in counted.select("terms").mapInArrow(run, "term int, n bigint").groupBy("term").agg(F.sum("n")).collect():  # a row for a query term
        df[term] = k
    return n, total, df


def block_ends(impacts: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends of the blocks of all lists (list k is impacts[first[k]:first[k+1]]), and the first block of each list.

    The cheapest way to cut a list's first i steps is the cheapest way to cut fewer, plus one block of at most ``MOST_STEPS``;
    all lists go through their i-th step together, longest first.
    """
    size = np.diff(first)
    step = np.where(size <= SHORT_LIST, 1, STEP)
    steps = -(-size // step)
    order = np.argsort(-steps, kind="stable")
    base = np.concatenate(([0], np.cumsum(steps)))  # of each list's steps
    at = np.repeat(first[:-1] - base[:-1] * step, steps) + np.arange(base[-1]) * np.repeat(step, steps)
    highest = np.maximum.reduceat(impacts, at).astype(np.float64) if len(at) else np.zeros(0)
    ends = np.minimum(at + np.repeat(step, steps), np.repeat(first[1:], steps))
    length = (ends - at).astype(np.float64)
    mean = np.array([0.0]) if not len(impacts) else np.add.reduceat(impacts.astype(np.float64), first[:-1][size > 0]) / size[size > 0]
    spread = np.zeros(len(size))
    spread[size > 0] = np.sqrt(np.maximum(0, np.add.reduceat(impacts.astype(np.float64) ** 2, first[:-1][size > 0]) / size[size > 0] - mean**2)) if len(impacts) else 0
    charge = (BLOCK_CHARGE * spread + 1e-9)[order]
    n = len(order)
    alive = np.searchsorted(-steps[order], -np.arange(1, steps.max(initial=0) + 1), "right")  # lists that have an i-th step
    before = np.full((n, MOST_STEPS), np.inf)  # cheapest cut before each possible start of the block, latest first
    tops = np.zeros((n, MOST_STEPS))
    lengths = np.zeros((n, MOST_STEPS))
    best = np.zeros(n)
    back = np.zeros(base[-1], np.int64)
    for i, k in enumerate(alive):
        own = base[order[:k]] + i
        w = min(i + 1, MOST_STEPS)
        for old, new in ((before, best[:k]), (tops, 0.0), (lengths, 0.0)):
            old[:k, 1:w] = old[:k, : w - 1]
            old[:k, 0] = new
        tops[:k, :w] = np.maximum(tops[:k, :w], highest[own][:, None])
        lengths[:k, :w] += length[own][:, None]
        cost = before[:k, :w] + tops[:k, :w] * lengths[:k, :w]  # the sum of impacts is the same for every cut
        least = cost.argmin(1)
        best[:k] = cost[np.arange(k), least] + charge[:k]
        back[own] = least + 1
    out = [np.zeros(0, np.int64)]
    place = np.where(steps > 0, base[1:] - 1, -1)
    lists = np.flatnonzero(steps > 0)
    of = [np.zeros(0, np.int64)]
    while len(lists):  # all lists walk back from their ends together
        out.append(ends[place[lists]])
        of.append(lists)
        place[lists] -= back[place[lists]]
        lists = lists[place[lists] >= base[lists]]
    found, of = np.concatenate(out), np.concatenate(of)
    found = found[np.lexsort((found, of))]
    return found, np.searchsorted(np.sort(of), np.arange(len(size) + 1))


class Shard:
    """Posting lists of some documents with impacts and blocks."""

    def __init__(self, n_docs: int, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, n_terms: int):
        order = np.argsort(term, kind="stable")  # documents ascend within a list
        self.n_docs, self.docs, self.impacts = n_docs, doc[order], impact[order]
        self.first = np.concatenate(([0], np.cumsum(np.bincount(term, minlength=n_terms))))
        ends, self.blocks = block_ends(self.impacts, self.first)
        starts = np.concatenate(([0], ends[:-1])) if len(ends) else ends
        self.starts, self.ends = starts, ends
        self.most = np.maximum.reduceat(self.impacts, starts) if len(ends) else np.zeros(0, np.int64)
        self.highest = np.zeros(n_terms, np.int64)
        held = np.flatnonzero(np.diff(self.first))
        self.highest[held] = np.maximum.reduceat(self.impacts, self.first[held]) if len(held) else 0
        self.opens, self.closes = self.docs[starts], self.docs[ends - 1] + 1  # documents of a block
        self.scores = np.zeros(n_docs, np.int64)

    def ranges(self, terms: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ranges of documents between block borders of the terms' lists, with a bound of all scores in each; empty ones left out."""
        blocks = _spread(self.blocks[terms], self.blocks[terms + 1])
        rise = np.repeat(weights, self.blocks[terms + 1] - self.blocks[terms]) * self.most[blocks]
        at = np.concatenate((self.opens[blocks], self.closes[blocks]))
        order = np.argsort(at, kind="stable")
        at, bound = at[order], np.cumsum(np.concatenate((rise, -rise))[order])
        last = np.flatnonzero(np.append(at[1:] != at[:-1], True))[:-1]  # the last one closes the last block
        some = last[bound[last] > 0]
        return at[some], at[some + 1], bound[some]

    def score(self, terms: np.ndarray, weights: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents of the ranges and their scores; only postings within the ranges are read."""
        docs = _spread(low, high)
        for t, w in zip(terms, weights, strict=True):
            own = self.docs[self.first[t] : self.first[t + 1]]
            at = _spread(np.searchsorted(own, low), np.searchsorted(own, high))
            self.scores[own[at]] += w * self.impacts[self.first[t] + at]
        found = self.scores[docs]
        self.scores[docs] = 0
        return docs, found

    def pivots(self, terms: np.ndarray, weights: np.ndarray, low: np.ndarray, high: np.ndarray, alive: np.ndarray) -> np.ndarray:
        """Documents of the terms' lists within alive ranges, with what these lists add already in ``scores``; blocks that touch no
        alive range are not read."""
        before = np.concatenate(([0], np.cumsum(alive)))
        met = np.zeros(self.n_docs, bool)
        for t, w in zip(terms, weights, strict=True):
            blocks = np.arange(self.blocks[t], self.blocks[t + 1])
            touched = before[np.searchsorted(low, self.closes[blocks])] > before[np.searchsorted(high, self.opens[blocks], "right")]
            at = _spread(self.starts[blocks[touched]], self.ends[blocks[touched]])
            own = self.docs[at]
            self.scores[own] += w * self.impacts[at]
            met[own] = True
        docs = np.flatnonzero(met)
        inside = np.searchsorted(low, docs, "right") - 1
        keep = (inside >= 0) & (docs < high[inside]) & alive[inside]
        self.scores[docs[~keep]] = 0
        return docs[keep]

    def best(self, terms: np.ndarray, weights: np.ndarray, top: Top, ids: np.ndarray) -> int:
        """Put this shard's best documents for one query into ``top``; returns how many documents were scored to the end."""
        some = self.first[terms + 1] > self.first[terms]
        terms, weights = terms[some], weights[some]
        if not len(terms):
            return 0
        low, high, bound = self.ranges(terms, weights)
        first = np.sort(np.argpartition(-bound, min(FIRST_RANGES, len(bound)) - 1)[:FIRST_RANGES])
        docs, scores = self.score(terms, weights, low[first], high[first])
        top.add(docs, scores, ids)
        alive = bound >= top.least
        alive[first] = False
        most = weights * self.highest[terms]
        order = np.argsort(most, kind="stable")
        terms, weights, most = terms[order], weights[order], most[order]
        upto = np.concatenate(([0], np.cumsum(most)))  # what the weaker lists can add together
        weak = int(np.searchsorted(upto[1:], top.least))  # so many stay under the threshold by themselves
        found = self.pivots(terms[weak:], weights[weak:], low, high, alive)
        scores = self.scores[found]
        self.scores[found] = 0
        for k in range(weak - 1, -1, -1):
            keep = scores + upto[k + 1] >= top.least
            found, scores = found[keep], scores[keep]
            if not len(found):
                break
            own = self.docs[self.first[terms[k]] : self.first[terms[k] + 1]]
            at = np.minimum(np.searchsorted(own, found), len(own) - 1)
            scores = scores + np.where(own[at] == found, weights[k] * self.impacts[self.first[terms[k]] + at], 0)
        top.add(found, scores, ids)
        return len(docs) + len(found)


class Top:
    """The k best documents of one query: highest score first, then smallest id."""

    def __init__(self, k: int):
        self.k, self.least = k, 1
        self.ids, self.scores = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, docs: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        some = scores >= self.least
        own = np.concatenate((self.ids, ids[docs[some]]))
        scores = np.concatenate((self.scores, scores[some]))
        order = np.lexsort((own, -scores))[: self.k]
        self.ids, self.scores = own[order], scores[order]
        if len(order) == self.k:
            self.least = max(1, int(self.scores[-1]))


def _spread(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """All whole numbers of the ranges [low, high), range after range."""
    n = high - low
    return np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())


#: Stands for no doc_id, after all others.
_NO_ID = np.iinfo(np.int64).max


def found_by_task(counted: DataFrame, queries: Queries, n_docs: int, n_terms: int, df: np.ndarray, k: int, shard_postings: int) -> DataFrame:
    """query (its place), doc_id, score: the k best of each task."""
    weights = np.maximum(0, np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1)))).astype(np.int64)
    shared = counted.sparkSession.sparkContext.broadcast((queries, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, weight = shared.value
        tops = [Top(k) for _ in asked.ids]

        def search(held: list[pa.RecordBatch]) -> None:
            ids = np.concatenate([b.column(0).fill_null(_NO_ID).to_numpy(zero_copy_only=False) for b in held])
            n = np.concatenate([b.column(1).to_numpy() for b in held])
            sizes = np.concatenate([b.column(2).value_lengths().to_numpy(zero_copy_only=False) for b in held]).astype(np.int64)
            term, tf = (np.concatenate([b.column(c).flatten().to_numpy(zero_copy_only=False) for b in held]).astype(np.int64) for c in (2, 3))
            doc = np.repeat(np.arange(len(ids)), sizes)
            m = 75 + (25 * n * n_docs) // max(1, n_terms)
            shard = Shard(len(ids), doc, term, 1_000_000_000 * tf // (1000 * tf + 12 * m[doc]), len(weight))
            for q, top in enumerate(tops):
                own = slice(asked.first[q], asked.first[q + 1])
                terms = asked.place[own]
                w = weight[terms] * asked.times[own]
                shard.best(terms[w > 0], w[w > 0], top, ids)

        held, postings, docs = [], 0, 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            postings, docs = postings + len(b.column(2).flatten()), docs + b.num_rows
            if postings >= shard_postings or docs >= SHARD_DOCS:
                search(held)
                held, postings, docs = [], 0, 0
        if held:
            search(held)
        query = np.repeat(np.arange(len(tops)), [len(t.ids) for t in tops])
        ids = np.concatenate([np.zeros(0, np.int64), *(t.ids for t in tops)])
        yield pa.RecordBatch.from_arrays([pa.array(query, pa.int64()), pa.array(ids, mask=ids == _NO_ID), pa.array(np.concatenate([np.zeros(0, np.int64), *(t.scores for t in tops)]))], ["query", "doc_id", "score"])

    return counted.mapInArrow(run, "query bigint, doc_id bigint, score bigint")


def ranked(found: DataFrame, k: int) -> DataFrame:
    """query, rank, doc_id, score; a query's results are first reduced in ``MERGE_PARTS`` parts."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    part = F.pmod(F.xxhash64("doc_id", "score"), F.lit(MERGE_PARTS))
    some = found.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("query", "part").orderBy(*order))).where(F.col("rank") <= k)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where(F.col("rank") <= k).drop("part")  # at most k * MERGE_PARTS rows a query


def search(docs: DataFrame, items: DataFrame, k: int = MOST_FOUND, block_bytes: int = QUERY_BLOCK_BYTES, shard_postings: int = SHARD_POSTINGS) -> DataFrame:
    """item_id, rank, doc_id and score of the k best documents of each row of ``items``."""
    spark = docs.sparkSession
    prepare(spark)
    items = items.select("item_id", "text")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, -(-int(size) // block_bytes))
    block = F.pmod(F.xxhash64("text", "item_id"), F.lit(n))
    out = None
    for b in range(n):
        rows = (items.where(block == b) if n > 1 else items).collect()  # about block_bytes of text
        queries = Queries.of([r[0] for r in rows], [r[1] for r in rows])
        counted = written(term_counts(docs, queries), "term_counts")
        n_docs, n_terms, df = collection(counted, len(queries.terms))
        best = ranked(found_by_task(counted, queries, n_docs, n_terms, df, k, shard_postings), k)
        named = spark.createDataFrame(list(enumerate(queries.ids)), f"query bigint, item_id {items.schema['item_id'].dataType.simpleString()}")
        best = best.join(F.broadcast(named), "query").select("item_id", "rank", "doc_id", "score")
        out = best if out is None else out.unionByName(best)
    return out
