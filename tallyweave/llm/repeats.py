"""Suffix-array deduplication: removes every byte of a string of 100 bytes that also starts earlier.

Equal 100-byte windows have the same anchor, the 24-byte gram of least hash within them, at
the same distance. So all windows of a corpus are dealt out by anchor, and each anchor's
surroundings are searched on their own:

1. Neighbouring windows with one anchor are a run. Runs of equal content are reduced within
   each reading task, their bytes compared, to the earliest one before anything is shuffled; the
   others are removed spans already.
2. Runs meet by anchor. Runs of equal content are one string of the suffix array with several
   places, of which only the earliest goes on (equality by a 62-bit hash besides the anchor's:
   two unequal ones of an anchor agree with probability 7e-15); an anchor with a single string
   has nothing to compare.
3. The strings form shards, cut between anchors. In a shard's enhanced suffix array the
   common-prefix intervals are scanned with a stack; an interval of 100 bytes or more whose left
   neighbours differ is a maximal repeat, and all of its occurrences but the earliest are
   removed spans. Every repeat of 100 bytes is part of a maximal one, and shifting to it keeps
   the order of occurrences, so nothing is missed and nothing else is marked.
   Suffixes of an anchor with more than ``HOT_RUNS`` strings are dealt out again, by their first
   100 bytes (two 62-bit hashes): such a bucket is the interval at depth 100, and its earliest
   occurrence comes from an aggregation that Spark combines before it shuffles. The spans are
   the same either way.
4. Spans are gathered by row and the remaining bytes are put together.

``repeat_groups`` returns the maximal repeats of the runs themselves, each with all its occurrences.

Defined results: null and empty texts have no bytes; texts under 100 bytes lose nothing; a null
doc_id counts as larger than all others; rows that share a doc_id, or have none, are in the
order of a hash of their texts, and only rows equal in both count as one document, none of
them earlier than the other; a repeat within a document, overlapping itself or not, keeps its
first occurrence; long texts are whole. Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textbytes as tb
from .util import partitions, prepare, stored

MATCH_BYTES = 100
GRAM_BYTES = 24
#: Bytes of text of which a reading task reduces equal runs at once.
REDUCE_BYTES = 32 << 20
#: Bytes that one suffix array is built over, unless a single anchor has more.
SHARD_BYTES = 1 << 19
#: Different contents of one anchor up to which they meet in one suffix array.
HOT_RUNS = 20_000

_LAST = (1 << 63) - 1  # stands for a null doc_id
_ANCHOR_BITS = 48


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values, from prefix and suffix minima of blocks."""
    n = len(x)
    count = -(-n // width)
    padded = np.full(count * width, np.iinfo(x.dtype).max, x.dtype)
    padded[:n] = x
    grid = padded.reshape(count, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def anchored_runs(raw: np.ndarray, offsets: np.ndarray, match: int = MATCH_BYTES, gram: int = GRAM_BYTES) -> tuple[np.ndarray, ...]:
    """Of each run of windows with one anchor: text, first start among all bytes, windows, anchor hash, content hash."""
    n = len(raw)
    none = (*(np.zeros(0, np.int64) for _ in range(3)), np.zeros(0, np.uint64), np.zeros(0, np.uint64))
    if n < match:
        return none
    sums, down = tb.rolling_sums(raw)
    grams = tb.mix((sums[gram:] - sums[:-gram]) * down[: n - gram + 1])
    low = np.uint64((1 << 32) - 1)
    least = sliding_min((grams & ~low) | np.arange(len(grams), dtype=np.uint64), match - gram + 1)
    anchor = (least & low).astype(np.int64)  # of the window that starts at each byte
    starts = np.concatenate([np.zeros(0, np.int64), *(np.arange(a, b - match + 1) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True) if b - a >= match)])
    if not len(starts):
        return none
    anchor = anchor[starts]
    fresh = np.ones(len(starts), bool)
    fresh[1:] = (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)
    first = np.flatnonzero(fresh)
    many = np.diff(np.append(first, len(starts)))
    start, anchor = starts[first], anchor[first]
    text = np.searchsorted(offsets, start, "right") - 1
    content = tb.mix(tb.SpanHashes(raw, tb.PLAIN).of(start, start + many - 1 + match) + (anchor - start).astype(np.uint64))
    return text, start, many, grams[anchor], content


def _same_bytes(raw: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the spans of ``size`` (8 or more) bytes from a and from b are equal, eight bytes at a time."""
    words = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))
    same = np.ones(len(a), bool)
    for k in range(0, int(size.max(initial=0)), 8):
        step = np.minimum(k, size - 8)
        same &= words[a + step] == words[b + step]
    return same


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of spans as disjoint ones that do not touch."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    fresh = np.flatnonzero(np.append(True, starts[1:] > reach[:-1]))
    return starts[fresh], reach[np.append(fresh[1:] - 1, len(reach) - 1)]


_RUN = "shard bigint, mark bigint, doc_id bigint, row bigint, place bigint"
_SPAN = "shard bigint, doc_id bigint, row bigint, start bigint, size bigint"


def _names(columns: str) -> list[str]:
    return [c.split()[0] for c in columns.split(", ")]


def _batch(columns: list[np.ndarray], names: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], _names(names))


def _rows(docs: DataFrame) -> DataFrame:
    """doc_id (for the order), row (a hash that tells texts of one doc_id apart; odd where there is no doc_id), text."""
    own = F.col("doc_id").cast("bigint")
    row = F.shiftleft(F.xxhash64("text"), 1).bitwiseOR(own.isNull().cast("bigint"))
    return docs.select(F.coalesce(own, F.lit(_LAST)).alias("doc_id"), row.alias("row"), "text")


def _doc_id() -> Column:
    """The doc_id of a row of ``_rows`` as it was."""
    return F.when(F.col("row").bitwiseAND(F.lit(1)) == 0, F.col("doc_id"))


def _read_runs(docs: DataFrame, match: int, reduce: bool = True) -> DataFrame:
    """Runs (shard: anchor, mark: content, place: start << 16 | windows) and, where they are reduced, removed spans (place: -1 - start, mark: bytes)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, raws, size = [], [], 0

        def emit() -> Iterator[pa.RecordBatch]:
            doc, row, at, start, many, anchor, content = (np.concatenate(x) for x in zip(*held, strict=True))
            if not len(doc):
                return
            again = np.zeros(len(doc), bool)
            if reduce:
                order = np.argsort(content)
                twin = content[order][1:] == content[order][:-1]
                rows = order[np.append(twin, False) | np.append(False, twin)]
                rows = rows[np.lexsort((start[rows], row[rows], doc[rows], content[rows]))]
                if len(rows):
                    lead = np.append(True, content[rows][1:] != content[rows][:-1])
                    head = rows[np.flatnonzero(lead)[np.cumsum(lead) - 1]]
                    same = (many[rows] == many[head]) & _same_bytes(np.concatenate(raws), at[rows], at[head], np.minimum(many[rows], many[head]) - 1 + match)
                    content[rows[~same]] ^= at[rows[~same]].astype(np.uint64)  # a string of its own: the suffix array decides
                    again[rows] = same & ((doc[rows] != doc[head]) | (row[rows] != row[head]) | (start[rows] != start[head]))
            keep = ~again
            parts = [((anchor >> np.uint64(64 - _ANCHOR_BITS))[keep].astype(np.int64), content[keep].view(np.int64), doc[keep], row[keep], start[keep] << 16 | many[keep])]
            gone = np.flatnonzero(again)
            if len(gone):
                gone = gone[np.lexsort((start[gone], row[gone], doc[gone]))]
                d, r, a = doc[gone], row[gone], start[gone]
                b = a + many[gone] - 1 + match
                fresh = np.append(True, (d[1:] != d[:-1]) | (r[1:] != r[:-1]) | (a[1:] > b[:-1]))  # ends grow with starts
                first = np.flatnonzero(fresh)
                d, r, a, b = d[first], r[first], a[first], b[np.append(first[1:] - 1, len(b) - 1)]
                parts.append((tb.mix(r.astype(np.uint64)).view(np.int64), b - a, d, r, -1 - a))
            for columns in parts:
                for k in range(0, len(columns[0]), 100_000):
                    yield _batch([x[k : k + 100_000] for x in columns], _RUN)

        for b in batches:
            ids, hashes = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (0, 1))
            raw, offsets = tb.arrow_bytes(b.column(2))
            for first, _, r, o in tb.blocks(raw, offsets):
                text, at, many, anchor, content = anchored_runs(r, o, match)
                held.append((ids[text + first], hashes[text + first], at + size, at - o[text], many, anchor, content))
                raws.append(r)
                size += len(r)
            if size >= REDUCE_BYTES:
                yield from emit()
                held, raws, size = [], [], 0
        if held:
            yield from emit()

    return docs.select("doc_id", "row", "text").mapInArrow(scan, _RUN)


def _settle(match: int):
    """Removed spans (shard null) and runs that go on (shard: their anchor), from sorted runs; one row is remembered."""

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard0 = mark0 = before = None  # of the row before; first: document and place of the earliest run of that content
        first = (0, 0, 0)
        waiting = False  # that run is its anchor's only content so far and has not been passed on
        for b in batches:
            rows = np.stack([c.to_numpy() for c in b.columns])
            if not rows.size:
                continue
            new = np.append(before is None or (rows[:, 0] != before).any(), (rows[:, 1:] != rows[:, :-1]).any(0))
            before = rows[:, -1]
            shard, mark, doc, row, place = rows[:, new]  # repeated rows of the table give the same rows: one is enough
            out = place < 0
            removed = [(doc[out], row[out], -1 - place[out], mark[out])]
            wanted = []
            shard, mark, doc, row, place = (x[~out] for x in (shard, mark, doc, row, place))
            if len(shard):
                new_shard = np.append(shard[0] != shard0, shard[1:] != shard[:-1])
                new = new_shard | np.append(mark[0] != mark0, mark[1:] != mark[:-1])
                at = np.flatnonzero(new)
                head = np.cumsum(new) - 1  # -1: still the content of the batch before
                h_doc, h_row, h_place = (np.where(head >= 0, x[at[head]] if len(at) else 0, x0) for x, x0 in zip((doc, row, place), first, strict=True))
                again = ~new & ((doc != h_doc) | (row != h_row) | (place >> 16 != h_place >> 16))
                removed.append((doc[again], row[again], place[again] >> 16, (place[again] & 0xFFFF) - 1 + match))
                last = np.append(new_shard[at][1:], False)  # the next content is of another anchor
                alone = new_shard[at] & last
                if len(at):
                    if waiting and not new_shard[at[0]]:
                        wanted.append(tuple(np.array([x]) for x in (shard0, *first)))
                    go = at[~alone]
                    open_end = new_shard[at[-1]]  # may turn out to be alone: decided by what follows
                    if open_end:
                        go = go[go != at[-1]]
                    wanted.append((shard[go], doc[go], row[go], place[go]))
                    waiting, first = bool(open_end), tuple(int(x[at[-1]]) for x in (doc, row, place))
                shard0, mark0 = shard[-1], mark[-1]
            d, r, s, n = (np.concatenate(x) for x in zip(*removed, strict=True))
            if len(d):
                yield pa.RecordBatch.from_arrays([pa.nulls(len(d), pa.int64()), *map(pa.array, (d, r, s, n))], _names(_SPAN))
            if wanted:
                k, d, r, p = (np.concatenate(x) for x in zip(*wanted, strict=True))
                if len(k):
                    yield _batch([k, d, r, p >> 16, (p & 0xFFFF) - 1 + match], _SPAN)

    return settle


class EnhancedSuffixArray:
    """Suffixes of several strings that are long enough to hold a match, in order, with common prefixes."""

    def __init__(self, strings: list[bytes], match: int):
        size = np.array([len(s) for s in strings])
        begin = np.concatenate(([0], np.cumsum(size + 1)))
        text = np.frombuffer(b"\0".join([*strings, b""]), np.uint8)
        code = np.zeros(257, np.int64)
        used = np.flatnonzero(np.bincount(text, minlength=256))
        code[used] = np.arange(1, len(used) + 1)
        symbols = code[text]
        symbols[begin[1:] - 1] = 0  # closes each string
        n = len(symbols)
        owner = np.repeat(np.arange(len(strings)), size + 1)
        left_over = begin[1:][owner] - 1 - np.arange(n)
        bits = max(1, int(len(used)).bit_length())
        depth = max(1, 62 // bits)
        longest = int(size.max(initial=0))
        self.levels: list[tuple[int, np.ndarray]] = []
        padded = np.concatenate((symbols, np.zeros(depth, np.int64)))
        key = np.zeros(n, np.int64)
        for j in range(depth):
            key = key << bits | padded[j : j + n]
        while True:
            order = np.argsort(key)
            ranked = key[order]
            step = np.empty(n, np.int64)
            step[:1] = 0
            np.cumsum(ranked[1:] != ranked[:-1], out=step[1:])
            rank = np.empty(n, np.int64)
            rank[order] = step
            self.levels.append((depth, rank))
            if depth >= longest or step[-1] == n - 1:
                break
            key = rank * (n + 1)
            key[: n - depth] += rank[depth:] + 1
            depth *= 2
        self.order = order[left_over[order] >= match]
        self.string = owner[self.order]
        self.at = self.order - begin[self.string]
        room = left_over[self.order]
        self.left = np.where(self.at > 0, symbols[self.order - 1], -1 - self.string)  # nothing to the left differs from all else
        a, b, most = self.order[:-1], self.order[1:], np.minimum(room[:-1], room[1:])
        common = np.zeros(len(a), np.int64)
        for depth, rank in reversed(self.levels):
            i, j = a + common, b + common
            inside = (common < most) & (i < n) & (j < n)
            common += depth * (inside & (rank[np.minimum(i, n - 1)] == rank[np.minimum(j, n - 1)]))
        least_depth = self.levels[0][0]
        live = np.flatnonzero(common < most)
        for _ in range(least_depth):
            if not len(live):
                break
            i, j = a[live] + common[live], b[live] + common[live]
            live = live[symbols[np.minimum(i, n - 1)] == symbols[np.minimum(j, n - 1)]]
            common[live] += 1
            live = live[common[live] < most[live]]
        self.common = np.minimum(common, most)

    def maximal_repeats(self, match: int) -> Iterator[tuple[int, np.ndarray]]:
        """(length, places in the order) of each interval of ``match`` bytes or more whose left neighbours differ."""
        for low, high, length in self._intervals(match):
            yield length, np.arange(low, high + 1)

    def _blocks(self, match: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First and last place of each stretch of common prefixes of ``match``, that has differing left neighbours; all breaks."""
        near = self.common >= match
        apart = (self.left[1:] != self.left[:-1]) | (self.left[1:] < 0)
        starts, ends = tb.runs(near, np.array([0, len(near)]))
        breaks = np.concatenate(([0], np.cumsum(apart)))
        some = breaks[ends] > breaks[starts] if len(starts) else np.zeros(0, bool)
        return starts[some], ends[some], breaks

    def _intervals(self, match: int) -> Iterator[tuple[int, int, int]]:
        """Left-diverse intervals (first, last, length), by a stack."""
        starts, ends, breaks = self._blocks(match)
        for low, high in zip(starts.tolist(), ends.tolist(), strict=True):
            stack: list[list[int]] = []  # [length, first]
            for k, length in enumerate([*self.common[low:high].tolist(), 0], low):
                first = k
                while stack and stack[-1][0] > length:
                    deep, first = stack.pop()
                    if breaks[k] > breaks[first]:
                        yield first, k, deep
                if length and (not stack or stack[-1][0] < length):
                    stack.append([length, first])

    def removed(self, match: int, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in the order that have an earlier occurrence, with the length of the longest such repeat.

        rank: order of the occurrences, equal for one place of one document.
        """
        starts, ends, breaks = self._blocks(match)
        two = ends - starts == 1
        first, out, lengths = starts[two], [], []
        later = np.where(rank[first] > rank[first + 1], first, first + 1)
        strict = rank[first] != rank[first + 1]
        out.append(later[strict])
        lengths.append(self.common[first][strict])
        more_places, more_lengths = [], []
        for low, high in zip(starts[~two].tolist(), ends[~two].tolist(), strict=True):
            ranks = rank[low : high + 1].tolist()
            stack: list[list[int]] = []  # [length, first place, place of the earliest occurrence below]
            for k, length in enumerate([*self.common[low:high].tolist(), 0], low):
                best, first = k, k  # the leaf, or the interval that was closed last
                while stack and stack[-1][0] > length:
                    deep, first, own = stack.pop()
                    best = self._contest(ranks, low, own, best, deep if breaks[k] > breaks[first] else 0, more_places, more_lengths)
                if length:
                    if stack and stack[-1][0] == length:
                        top = stack[-1]
                        top[2] = self._contest(ranks, low, top[2], best, length, more_places, more_lengths)
                    else:
                        stack.append([length, first, best])
        out.append(np.array(more_places, np.int64))
        lengths.append(np.array(more_lengths, np.int64))
        return np.concatenate(out), np.concatenate(lengths)

    @staticmethod
    def _contest(ranks: list[int], low: int, a: int, b: int, length: int, places: list[int], lengths: list[int]) -> int:
        """The earlier of two occurrences; the other is noted, unless the interval's repeats reach further left."""
        x, y = ranks[a - low], ranks[b - low]
        if x != y and length:
            places.append(b if x < y else a)
            lengths.append(length)
        return a if x <= y else b


_PIECE = "key bigint, key2 bigint, doc_id bigint, row bigint, start bigint, piece binary"


def _cut_runs(match: int):
    """Of wanted runs, their bytes by anchor (key); of hot anchors, two hashes for each window and no bytes."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            runs = b.column(1).to_pylist()
            raw, offsets = tb.arrow_bytes(b.column(0))
            out: list[list] = [[] for _ in range(6)]
            for k, own in enumerate(runs):
                data = raw[offsets[k] : offsets[k + 1]].tobytes()
                for r in own:
                    s, n = r["start"], r["size"]
                    part = data[s : s + n]
                    if r["hot"]:
                        whole, i = np.frombuffer(part, np.uint8), np.arange(n - match + 1)
                        made = (tb.SpanHashes(whole, tb.PLAIN).of(i, i + match).view(np.int64).tolist(), tb.SpanHashes(whole, tb.SCRAMBLED).of(i, i + match).view(np.int64).tolist(), [r["doc_id"]] * len(i), [r["row"]] * len(i), (r["shown"] + i).tolist(), [None] * len(i))
                    else:
                        made = ([r["shard"]], [0], [r["doc_id"]], [r["row"]], [r["shown"]], [part])
                    for column, values in zip(out, made, strict=True):
                        column += values
                if len(out[0]) >= 20_000:
                    yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in out[:5]), pa.array(out[5], pa.binary())], _names(_PIECE))
                    out = [[] for _ in range(6)]
            yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in out[:5]), pa.array(out[5], pa.binary())], _names(_PIECE))

    return cut


def shard_spans(strings: list[bytes], doc: np.ndarray, row: np.ndarray, start: np.ndarray, match: int) -> tuple[np.ndarray, ...]:
    """Removed spans (doc, row, start, bytes) among strings that start at these places."""
    array = EnhancedSuffixArray(strings, match)
    d, r, s = doc[array.string], row[array.string], start[array.string] + array.at
    order = np.lexsort((s, r, d))
    step = np.zeros(len(order), np.int64)
    step[1:] = np.cumsum((d[order][1:] != d[order][:-1]) | (r[order][1:] != r[order][:-1]) | (s[order][1:] != s[order][:-1]))
    rank = np.empty(len(order), np.int64)
    rank[order] = step
    places, lengths = array.removed(match, rank)
    return d[places], r[places], s[places], lengths


_GROUP = "group bigint, size bigint, shard bigint, mark bigint, at bigint"


def shard_groups(strings: list[bytes], shard: np.ndarray, mark: np.ndarray, match: int) -> list[np.ndarray]:
    """Maximal repeats among strings, and the strings themselves: (hash, bytes, shard, mark, offset in the string) of every occurrence."""
    array = EnhancedSuffixArray(strings, match)
    name = lambda data: int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little", signed=True)
    rows = [(name(s), len(s), shard[k], mark[k], 0) for k, s in enumerate(strings)]
    for length, places in array.maximal_repeats(match):
        k, at = array.string[places], array.at[places]
        one = name(strings[k[0]][at[0] : at[0] + length])
        rows += [(one, length, shard[i], mark[i], j) for i, j in zip(k.tolist(), at.tolist(), strict=True)]
    return list(np.array(rows, np.int64).reshape(-1, 5).T)


def _search(shard_bytes: int, look, columns: str):
    """Shards of about ``shard_bytes``, cut between anchors, each given to ``look``(pieces, key, doc, row, start).

    Rows come sorted; repeated rows of the table give equal ones, of which one is enough.
    """

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        before = None

        def emit() -> pa.RecordBatch:
            key, _, doc, row, start, pieces = zip(*held, strict=True)
            return _batch(look(list(pieces), *(np.array(x, np.int64) for x in (key, doc, row, start))), columns)

        for b in batches:
            for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if r[:5] == before:
                    continue
                before = r[:5]
                if size >= shard_bytes and r[0] != held[-1][0]:
                    yield emit()
                    held, size = [], 0
                held.append(r)
                size += len(r[5])
        if held:
            yield emit()

    return search


def _pieces(wanted: DataFrame, texts: DataFrame, match: int) -> DataFrame:
    """The strings of wanted runs, whose (doc_id, row, start, size) say where they are; they are shown as of ``as_doc``, ``as_row``, ``as_start``."""
    shown = [F.col(f"as_{a}").alias(b) for a, b in (("doc", "doc_id"), ("row", "row"), ("start", "shown"))]
    by_row = wanted.groupBy("doc_id", "row").agg(F.collect_list(F.struct("shard", "start", "size", "hot", *shown)).alias("runs"))
    return texts.join(by_row, ["doc_id", "row"]).select("text", "runs").mapInArrow(_cut_runs(match), _PIECE)


def _hot(wanted: DataFrame, hot_runs: int) -> tuple[DataFrame, bool]:
    """wanted with a column ``hot``, and whether any is."""
    hot = stored(wanted.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot_runs).select("shard", F.lit(True).alias("hot")))
    if hot.isEmpty():
        return wanted.withColumn("hot", F.lit(False)), False
    return wanted.join(hot, "shard", "left").withColumn("hot", F.coalesce("hot", F.lit(False))), True


def repeated_spans(docs: DataFrame, texts: DataFrame, match: int = MATCH_BYTES, hot_runs: int = HOT_RUNS, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(doc_id, row, start, size) of spans that cover exactly the bytes to remove; texts: the documents, dealt out by doc_id and row."""
    n = partitions(docs.sparkSession)
    runs = _read_runs(docs, match).repartition(n, "shard").sortWithinPartitions("shard", "mark", "doc_id", "row", "place")
    settled = stored(runs.mapInArrow(_settle(match), _SPAN))
    wanted, any_hot = _hot(settled.where("shard is not null").withColumns({f"as_{a}": F.col(b) for a, b in (("doc", "doc_id"), ("row", "row"), ("start", "start"))}), hot_runs)
    span = ["doc_id", "row", "start", "size"]
    dealt = _pieces(wanted.where("not hot"), texts, match).repartition(n, "key").sortWithinPartitions("key", "key2", "doc_id", "row", "start")
    look = lambda pieces, key, doc, row, start: shard_spans(pieces, doc, row, start, match)
    found = settled.where("shard is null").select(span).unionByName(dealt.mapInArrow(_search(shard_bytes, look, "doc_id bigint, row bigint, start bigint, size bigint"), "doc_id bigint, row bigint, start bigint, size bigint"))
    if any_hot:
        window = _pieces(wanted.where("hot"), texts, match).select("key", "key2", F.struct("doc_id", "row", "start").alias("place")).distinct()
        earliest = window.groupBy("key", "key2").agg(F.min("place").alias("earliest"))
        found = found.unionByName(window.join(earliest, ["key", "key2"]).where("place > earliest").select("place.*", F.lit(match).cast("bigint").alias("size")))
    return found


def repeat_groups(docs: DataFrame, match: int = MATCH_BYTES, hot_runs: int = HOT_RUNS, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(group, size, doc_id, row, start): maximal repeats of ``match`` bytes or more within the runs, each with all of its occurrences.

    A run of several equal ones is a group; the others come from the intervals of the suffix arrays, with an occurrence for
    every run of that content. A longer repeat is a chain of groups that overlap. ``row`` tells rows of one doc_id apart.
    """
    prepare(docs.sparkSession)
    docs = _rows(docs)
    n = partitions(docs.sparkSession)
    texts = docs.repartition(n, "doc_id", "row")
    runs = stored(_read_runs(docs, match, reduce=False).distinct())
    contents = stored(runs.groupBy("shard", "mark").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "row", "place")).alias("first")))
    size = F.col("first.place").bitwiseAND(F.lit(0xFFFF)) - 1 + match
    kinds = contents.groupBy("shard").agg(F.count(F.lit(1)).alias("kinds"))
    met = contents.join(kinds, "shard")
    wanted = met.where("kinds > 1").select("shard", "first.doc_id", "first.row", F.shiftright("first.place", 16).alias("start"), size.alias("size"), F.col("shard").alias("as_doc"), F.col("mark").alias("as_row"), F.lit(0).cast("bigint").alias("as_start"))
    wanted, any_hot = _hot(wanted, hot_runs)
    dealt = _pieces(wanted.where("not hot"), texts, match).repartition(n, "key").sortWithinPartitions("key", "key2", "doc_id", "row", "start")
    look = lambda pieces, key, shard, mark, start: shard_groups(pieces, shard, mark, match)
    found = dealt.mapInArrow(_search(shard_bytes, look, _GROUP), _GROUP)
    found = found.unionByName(met.where("kinds = 1 and n > 1").select(F.col("mark").alias("group"), size.cast("bigint").alias("size"), "shard", "mark", F.lit(0).cast("bigint").alias("at")))
    if any_hot:
        window = _pieces(wanted.where("hot"), texts, match)
        found = found.unionByName(window.select(F.xxhash64("key", "key2").alias("group"), F.lit(match).cast("bigint").alias("size"), F.col("doc_id").alias("shard"), F.col("row").alias("mark"), F.col("start").alias("at")))
    every = found.join(runs, ["shard", "mark"]).select("group", "size", _doc_id().alias("doc_id"), "row", (F.shiftright("place", 16) + F.col("at")).alias("start")).distinct()
    every = stored(every)
    return every.join(every.groupBy("group", "size").count().where("count > 1").select("group", "size"), ["group", "size"])


def _remove(docs: DataFrame, match: int, hot_runs: int, shard_bytes: int, finish, columns: str) -> DataFrame:
    prepare(docs.sparkSession)
    docs = _rows(docs)
    texts = docs.repartition(partitions(docs.sparkSession), "doc_id", "row")
    spans = repeated_spans(docs, texts, match, hot_runs, shard_bytes).groupBy("doc_id", "row").agg(F.collect_list("start").alias("starts"), F.collect_list("size").alias("sizes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, offsets = tb.arrow_bytes(b.column(1))
            rows = []
            for k, (starts, sizes) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)):
                data = raw[offsets[k] : offsets[k + 1]]
                a = np.array(starts or (), np.int64)
                a, e = merged(a, a + np.array(sizes or (), np.int64))
                rows.append(finish(data.tobytes(), a, e))
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, zip(*rows, strict=True))] if rows else [b.column(0)], schema=pa.schema([pa.field("doc_id", pa.int64()), *types]))

    types = [pa.field(c.split()[0], {"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}[c.split()[1]]) for c in columns.split(", ")]
    out = texts.join(spans, ["doc_id", "row"], "left").select(_doc_id().alias("doc_id"), "text", "starts", "sizes")
    return out.mapInArrow(run, f"doc_id bigint, {columns}")


def _kept(data: bytes, starts: np.ndarray, ends: np.ndarray) -> bytes:
    return b"".join([data[a:b] for a, b in zip([0, *ends.tolist()], [*starts.tolist(), len(data)], strict=True)])


def remove_repeats(docs: DataFrame, match: int = MATCH_BYTES, hot_runs: int = HOT_RUNS, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """doc_id, kept: the remaining bytes of each document (binary, as a cut may fall within a character)."""
    return _remove(docs, match, hot_runs, shard_bytes, lambda data, a, e: (_kept(data, a, e),), "kept binary")


def repeat_report(docs: DataFrame, match: int = MATCH_BYTES, hot_runs: int = HOT_RUNS, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the SHA-256 of the remaining bytes."""
    return _remove(docs, match, hot_runs, shard_bytes, lambda data, a, e: (len(data), int((e - a).sum()), len(a), hashlib.sha256(_kept(data, a, e)).hexdigest()), "n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")
