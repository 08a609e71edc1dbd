"""Benchmark decontamination by an FM-index of each training shard.

A shard is what one task reads, up to ``SHARD_WORDS`` indexed words. Words outside the
benchmark's vocabulary cannot be part of an occurrence, so a shard's text is the runs of
vocabulary words that are long enough for the shortest test phrase; each run is closed by a
separator. The test phrases (windows of 13 words, or a whole shorter item) are searched
backwards through wavelet-tree ranks, occurrences are located through sampled suffix
positions, and the covered words are merged into removal spans.

The benchmark is broadcast in blocks of about ``ITEM_BLOCK_BYTES`` of text (with the windows as
places in one array of words, some 12 times that at most): one block for an ordinary benchmark.
More are searched one after the other; what was found travels along in each document's row, so
nothing is shuffled or joined back, and a row is judged alone whatever its doc_id.

Defined results: null and empty texts have no words and are never contaminated; a null text
or an item without words matches nothing; an item with a null id still covers words but is
not listed; repeated items count once; documents with a null or repeated doc_id each get their
own result; very long texts are handled like others; an empty benchmark hits nothing. Columns
other than doc_id and text are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textbytes as tb
from .fmindex import FMIndex
from .util import fresh, prepare, written

WINDOW_WORDS = 13
SHARD_WORDS = 1 << 20
ITEM_BLOCK_BYTES = 4 << 20
#: Blocks of items that are searched in one job before the documents are written in between.
BLOCKS_A_JOB = 4
#: Windows that are searched at once.
SEARCHED_WINDOWS = 1 << 16
#: A document is contaminated if it has a hit and hits * HIT_SHARE >= words.
HIT_SHARE = 20
#: Bytes of documents that a task holds before it searches their shard.
HELD_BYTES = 64 << 20


class Phrases:
    """The distinct windows of a block of items, as places in one array of vocabulary numbers (from 2 on)."""

    def __init__(self, ids: list, texts: list[str | None], width: int = WINDOW_WORDS):
        raw, offsets = tb.arrow_bytes(pa.array(texts, pa.large_string()))
        parts = [tb.Words(r, o, tb.ALNUM, tb.FOLDED) for _, _, r, o in tb.blocks(raw, offsets)]
        self.ids = sorted({str(x) for x in ids if x is not None})
        place = {x: k for k, x in enumerate(self.ids)}
        owner = np.array([-1 if x is None else place[str(x)] for x in ids], np.int64)
        hashes = np.concatenate([np.zeros(0, np.uint64), *(w.hashes for w in parts)])
        many = np.concatenate([np.zeros(0, np.int64), *(np.diff(w.first) for w in parts)])  # words of each item
        self.vocabulary = np.unique(hashes)
        self.words = (np.searchsorted(self.vocabulary, hashes) + 2).astype(np.int32)
        first = np.cumsum(many) - many
        item = np.repeat(np.arange(len(many)), many)
        self.by_length = []  # (words, place of each distinct window, its first owner, owners)
        for n in np.unique(np.minimum(many, width)).tolist():
            if not n:
                continue
            if n == width:
                starts = np.flatnonzero(np.arange(len(item)) + n <= (first + many)[item])
            else:
                starts = first[many == n]
            self.by_length.append((n, *self._distinct(starts, n, owner[item[starts]])))
        self.shortest = min((n for n, *_ in self.by_length), default=0)
        self.seen = np.zeros(1 << 16, bool)  # a first look by 16 bits of the hash
        self.seen[(self.vocabulary >> np.uint64(48)).astype(np.int64)] = True

    def patterns(self, starts: np.ndarray, n: int) -> np.ndarray:
        return self.words[starts[:, None] + np.arange(n)]

    def _distinct(self, starts: np.ndarray, n: int, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """One place of each distinct window, and its owners as an array with the first of each window."""
        rows = self.patterns(starts, n)
        order = np.lexsort(rows.T[::-1])
        fresh = np.append(True, (rows[order][1:] != rows[order][:-1]).any(1))
        window = np.cumsum(fresh) - 1
        pairs = np.unique(np.stack((window, owner[order]), 1), axis=0)
        pairs = pairs[pairs[:, 1] >= 0]
        return starts[order][fresh].astype(np.int32), np.searchsorted(pairs[:, 0], np.arange(fresh.sum() + 1)), pairs[:, 1]

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Vocabulary number of each word; 0 for others."""
        out = np.zeros(len(hashes), np.int64)
        maybe = np.flatnonzero(self.seen[(hashes >> np.uint64(48)).astype(np.int64)])
        if len(maybe):
            h = hashes[maybe]
            at = np.minimum(np.searchsorted(self.vocabulary, h), len(self.vocabulary) - 1)
            out[maybe] = np.where(self.vocabulary[at] == h, at + 2, 0)
        return out


class Shard:
    """What is indexed together: runs of vocabulary words, and whose they are."""

    def __init__(self, phrases: Phrases):
        self.phrases, self.n_words, self.docs = phrases, [], 0
        self.symbols, self.doc, self.word, self.size = [], [], [], 0

    def add(self, texts: pa.Array) -> None:
        raw, offsets = tb.arrow_bytes(texts)
        for first, _, r, o in tb.blocks(raw, offsets):
            w = tb.Words(r, o, tb.ALNUM, tb.FOLDED)
            self.n_words.append(np.diff(w.first))
            if not self.phrases.shortest:
                continue
            number = self.phrases.numbers(w.hashes)
            starts, ends = tb.runs(number > 0, w.first)
            long = ends - starts >= self.phrases.shortest
            starts, ends = starts[long], ends[long]
            if not len(starts):
                continue
            length = ends - starts + 1  # with the separator
            close = np.cumsum(length) - 1
            at = np.repeat(starts - np.concatenate(([0], close[:-1] + 1)), length) + np.arange(close[-1] + 1)
            s = number[np.minimum(at, len(number) - 1)]
            s[close] = 1
            self.symbols.append(s)
            self.doc.append(np.repeat(w.text[starts], length) + first + self.docs)
            self.word.append(at - w.first[np.repeat(w.text[starts], length)])
            self.size += len(s)
        self.docs += len(texts)

    def search(self) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
        """Per document: words, spans of covered words as rows (start, end), numbers of the items found."""
        n_words = np.concatenate([np.zeros(0, np.int64), *self.n_words])
        none = np.zeros((0, 2), np.int64)
        spans, items = [none] * self.docs, [none[:, 0]] * self.docs
        if not self.size:
            return n_words, spans, items
        symbols, doc, word = (np.concatenate(x) for x in (self.symbols, self.doc, self.word))
        index = FMIndex(symbols, len(self.phrases.vocabulary) + 2)
        edge, pairs = np.zeros(len(symbols) + 1, np.int64), []
        for n, starts, first_owner, owners in self.phrases.by_length:
            low, high = np.empty(len(starts), np.int64), np.empty(len(starts), np.int64)
            for k in range(0, len(starts), SEARCHED_WINDOWS):
                part = slice(k, k + SEARCHED_WINDOWS)
                low[part], high[part] = index.ranges(self.phrases.patterns(starts[part], n))
            count = high - low
            which = np.repeat(np.arange(len(starts)), count)
            if not len(which):
                continue
            rows = np.repeat(low - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(len(which))
            at = index.locate(rows)
            np.add.at(edge, at, 1)
            np.add.at(edge, at + n, -1)
            found = np.unique(doc[at] * len(starts) + which)  # a window once for each document
            which, d = found % len(starts), found // len(starts)
            many = first_owner[which + 1] - first_owner[which]
            item = owners[np.repeat(first_owner[which] - np.concatenate(([0], np.cumsum(many)[:-1])), many) + np.arange(many.sum())]
            pairs.append(np.stack((np.repeat(d, many), item), 1))
        covered = np.cumsum(edge)[:-1] > 0
        starts, ends = tb.runs(covered, np.array([0, len(covered)]))
        if len(starts):
            s_doc, span = doc[starts], np.stack((word[starts], word[starts] + ends - starts), 1)
            cut = np.searchsorted(s_doc, np.arange(self.docs + 1))
            for k in np.unique(s_doc):
                spans[k] = span[cut[k] : cut[k + 1]]
        if pairs and len(every := np.unique(np.concatenate(pairs), axis=0)):
            cut = np.searchsorted(every[:, 0], np.arange(self.docs + 1))
            for k in np.unique(every[:, 0]):
                items[k] = every[cut[k] : cut[k + 1], 1]
        return n_words, spans, items


_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
_SPANS_ARROW = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def union(spans: np.ndarray, earlier: list[dict] | None) -> np.ndarray:
    """Spans as disjoint ones in order, together with earlier ones."""
    if earlier:
        spans = np.concatenate((spans, [(s["start"], s["end"]) for s in earlier]))
    if len(spans) < 2:
        return spans
    spans = spans[np.lexsort((spans[:, 1], spans[:, 0]))]
    reach = np.maximum.accumulate(spans[:, 1])
    fresh = np.flatnonzero(np.append(True, spans[1:, 0] > reach[:-1]))
    return np.stack((spans[fresh, 0], reach[np.append(fresh[1:] - 1, len(reach) - 1)]), 1)


def _pass(docs: DataFrame, phrases: Phrases, own: list[str], met: list[str], output: str) -> DataFrame:
    """Search one block. docs: the own columns and, after the first pass, spans and items met so far (columns ``met``).

    output: ``rows`` for own columns, spans and items; ``report`` for doc_id, n_words, spans and items; ``clean`` for the
    own columns of documents that are not contaminated.
    """
    shared = docs.sparkSession.sparkContext.broadcast(phrases)
    later = len(docs.columns) > len(own)
    text_at, id_at, n_own = own.index("text"), own.index("doc_id"), len(own)
    fields = docs.schema.fields[:n_own]
    more = [T.StructField(met[0], _SPANS), T.StructField(met[1], T.ArrayType(T.StringType()))]
    if output == "report":
        fields = [fields[id_at], T.StructField("n_words", T.LongType()), T.StructField("spans", _SPANS), T.StructField("items", more[1].dataType)]
    elif output == "rows":
        fields = [*fields, *more]
    names = [f.name for f in fields]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value

        def emit(shard: Shard, held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n_words, spans, items = shard.search()
            at = 0
            for b in held:
                part = slice(at, at + b.num_rows)
                at += b.num_rows
                s, i, n = spans[part], [[known.ids[x] for x in x_] for x_ in items[part]], n_words[part]
                if later:
                    s = [union(x, y) for x, y in zip(s, b.column(n_own).to_pylist(), strict=True)]
                    i = [sorted({*x, *y}) if y else x for x, y in zip(i, b.column(n_own + 1).to_pylist(), strict=True)]
                if output == "clean":
                    hit = np.array([int((x[:, 1] - x[:, 0]).sum()) for x in s], np.int64)
                    yield pa.RecordBatch.from_arrays(b.columns[:n_own], names).filter(pa.array(~((hit > 0) & (hit * HIT_SHARE >= n))))
                    continue
                found = [pa.array([[{"start": u, "end": v} for u, v in x.tolist()] for x in s], _SPANS_ARROW), pa.array(i, pa.list_(pa.string()))]
                first = [b.column(id_at), pa.array(n, pa.int64())] if output == "report" else b.columns[:n_own]
                yield pa.RecordBatch.from_arrays([*first, *found], names)

        shard, held, size = Shard(known), [], 0
        for b in batches:
            if not b.num_rows:
                continue
            shard.add(b.column(text_at))
            held.append(b.select([id_at]) if output == "report" and not later and id_at == 0 else b)
            size += held[-1].nbytes
            if shard.size >= SHARD_WORDS or shard.docs >= 1 << 16 or size >= HELD_BYTES:
                yield from emit(shard, held)
                shard, held, size = Shard(known), [], 0
        if held:
            yield from emit(shard, held)

    return docs.mapInArrow(scan, T.StructType(fields))


def phrase_blocks(items: DataFrame, width: int, block_bytes: int) -> tuple[int, Iterator[Phrases]]:
    """The items in blocks of about ``block_bytes`` of text, each small enough to broadcast; one at a time is on the driver.

    Items are dealt by text and id, so that copies of one item spread.
    """
    items = items.select("item_id", "text")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, -(-int(size) // block_bytes))
    block = F.pmod(F.xxhash64("text", "item_id"), F.lit(n))

    def made() -> Iterator[Phrases]:
        for k in range(n):
            rows = items.where(block == k).collect() if n > 1 else items.collect()
            yield Phrases([r[0] for r in rows], [r[1] for r in rows], width)

    return n, made()


def _searched(docs: DataFrame, items: DataFrame, width: int, block_bytes: int, output: str) -> DataFrame:
    prepare(docs.sparkSession)
    own = docs.columns
    met = [fresh("spans_met", own), fresh("items_met", own)]
    n, blocks_of_items = phrase_blocks(items, width, block_bytes)
    for k, phrases in enumerate(blocks_of_items, 1):
        docs = _pass(docs, phrases, own, met, output if k == n else "rows")
        if k < n and k % BLOCKS_A_JOB == 0:
            docs = written(docs, "searched")
    return docs


def find_contamination(docs: DataFrame, items: DataFrame, width: int = WINDOW_WORDS, block_bytes: int = ITEM_BLOCK_BYTES) -> DataFrame:
    """Every document with its number of words, covered word spans [start, end), and found item ids (sorted strings)."""
    return _searched(docs.select("doc_id", "text"), items, width, block_bytes, "report")


def contaminated(n_hit, n_words):
    return (n_hit > 0) & (n_hit * HIT_SHARE >= n_words)


def hit_words():
    """Covered words of a row of ``find_contamination``."""
    return F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])


def decontamination_report(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The digest columns of the query, one row for each document."""
    found = find_contamination(docs, items).withColumn("n_hit", hit_words())
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"), F.col("spans"))


def drop_contaminated(docs: DataFrame, items: DataFrame, block_bytes: int = ITEM_BLOCK_BYTES) -> DataFrame:
    """Documents without those the rule calls contaminated, judged where they are read; clean documents stay as they are."""
    return _searched(docs, items, WINDOW_WORDS, block_bytes, "clean")
