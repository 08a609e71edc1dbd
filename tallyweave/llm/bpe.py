"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash of the last ``ROLL_BYTES`` bytes cuts a text into chunks where its low bits
are zero, so a passage that many documents share is cut alike in all of them. A chunk is
encoded once for each worker process and then looked up, and its joins with its neighbours are
repaired by re-encoding until both sides agree exactly.

- A vocabulary for which white space ends every word and has no token itself (each file is
  probed for that with all pairs of a set of characters and the six ASCII blanks): cuts move to
  the ends of the word that they run through, new chunks are put together from a table of
  words, and the cut word is re-encoded with the whole word on either side. If the ids do not
  agree, the document goes the other way.
- Any other vocabulary: chunks are cut anywhere and encoded as they are. At a join, the text
  from a token before it to a token behind it is re-encoded, ``JOIN_CHARS`` either way and then
  twice as many, until its outermost tokens are those of the chunks and the next width gives
  the same ids; at the ends of the text there is nothing left to agree with.

Where the vocabulary has no decoder, decoding joins the tokens' strings as the library does.

Defined results: null and empty texts have no tokens and decode to the empty text; strings of
special tokens within a text are those tokens, as in the library; very long texts and texts
without white space are encoded whole; repeated rows get a row each; an empty table gives no
rows. Only doc_id and text are read, whatever other columns are called.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbytes as tb
from .util import prepare

ROLL_BYTES = 16
#: A cut every so many bytes on average (a power of two).
CHUNK_BYTES = 512
#: Bytes that a worker's table of words, and its tables of chunks and joins, may hold before they start anew.
KEPT_WORD_BYTES, KEPT_CHUNK_BYTES = 72 << 20, 32 << 20
BLOCK_BYTES = 1 << 19
#: Characters on either side of a join that are encoded again at first.
JOIN_CHARS = 24

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_encoders: dict[str, ChunkEncoder] = {}


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class ChunkEncoder:
    """Encodes texts through tables of words, joins and chunks that are filled as they are met."""

    def __init__(self, path: str, chunk_bytes: int = CHUNK_BYTES):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.mask = np.uint64(chunk_bytes - 1)
        n = self.tokenizer.get_vocab_size()
        self.strings = [(self.tokenizer.id_to_token(i) or "").encode() + b" " for i in range(n)]
        self.decodes_itself = json.loads(self.tokenizer.to_str()).get("decoder") is not None
        self.blank_ends_words = self._blank_ends_words()
        self.chunks_encoded = self.chunks_met = self.repairs = self.joins_repaired = 0
        self.forget_words()
        self.forget_chunks()

    def forget_words(self) -> None:
        self.words: dict[bytes, bytes] = {}
        self.word_bytes = 0

    def forget_chunks(self) -> None:
        self.joins: dict[bytes, bool] = {}
        self.chunks: dict[bytes, tuple[bytes, bytes]] = {}
        self.whole: dict[str, tuple[list[int], list[int], list[int]]] = {}
        self.chunk_bytes = 0

    def _blank_ends_words(self) -> bool:
        """Whether white space has no token and what stands on its two sides is encoded as if alone."""
        ends = ["a", "Z", "é", "7", ".", "-", "'s", "<", "日", "word"]
        alone = {x: e.ids for x, e in zip(ends, self.tokenizer.encode_batch(ends, add_special_tokens=False), strict=True)}
        probes = [(x, y, x + blank + y) for x in ends for y in ends for blank in " \t\n\v\f\r"]
        return all(e.ids == alone[x] + alone[y] for (x, y, _), e in zip(probes, self.tokenizer.encode_batch([p for *_, p in probes], add_special_tokens=False), strict=True))

    def _tokens(self, text: str) -> tuple[list[int], list[int], list[int]]:
        """Ids with the places where they start and end."""
        e = self.tokenizer.encode(text, add_special_tokens=False)
        return e.ids, [a for a, _ in e.offsets], [b for _, b in e.offsets]

    def encode_chunks(self, text: str) -> bytes:
        """Ids of a text from its chunks, each encoded as it is, with the joins repaired."""
        raw = np.frombuffer(text.encode(), np.uint8)
        if len(raw) <= ROLL_BYTES:
            return np.array(self._tokens(text)[0], "<u4").tobytes()
        sums, down = tb.rolling_sums(raw)
        n = len(raw)
        at = np.arange(ROLL_BYTES, n)
        cut = (tb.mix((sums[ROLL_BYTES:n] - sums[: n - ROLL_BYTES]) * down[: n - ROLL_BYTES]) & self.mask) == 0
        starts = (raw & 0xC0) != 0x80
        cuts = np.cumsum(starts)[at[cut & starts[ROLL_BYTES:]]] - 1  # in characters
        bounds = [0, *cuts.tolist(), len(text)]
        ids: list[int] = []
        low: list[int] = []
        high: list[int] = []
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            piece = text[a:b]
            self.chunks_met += 1
            if piece not in self.whole:
                self.chunks_encoded += 1
                self.whole[piece] = self._tokens(piece)
                self.chunk_bytes += 30 * len(piece) + 250
            own, s, e = self.whole[piece]
            if not a:
                ids, low, high = list(own), list(s), list(e)
                continue
            i, j, made = self._joined(text, a, ids, low, high, own, [x + a for x in s], [x + a for x in e], b == len(text))
            self.joins_repaired += made[0] != ids[i:] + own[:j]
            ids[i:], low[i:], high[i:] = made[0] + own[j:], made[1] + [x + a for x in s[j:]], made[2] + [x + a for x in e[j:]]
        return np.array(ids, "<u4").tobytes()

    def _joined(self, text: str, at: int, ids: list, low: list, high: list, own: list, s: list, e: list, last: bool) -> tuple[int, int, tuple]:
        """How many tokens stay before the join, how many go behind it, and the tokens in between."""
        width, before, last_i = JOIN_CHARS, None, 0
        while True:
            i = len(ids)
            while i and (i == len(ids) or low[i] > at - width or high[i - 1] > low[i]):
                i -= 1
            j = 0
            while j < len(own) and (not j or e[j - 1] < at + width or j < len(own) and e[j - 1] > s[j]):
                j += 1
            begin = low[i] if i else 0
            end = e[j - 1] if j < len(own) else (len(text) if last else max([at, *e]))
            made, a, b = self._tokens(text[begin:end])
            a, b = [x + begin for x in a], [x + begin for x in b]
            agrees = bool(made) and (not i or made[0] == ids[i] and b[0] == high[i]) and (j == len(own) or made[-1] == own[j - 1] and a[-1] == s[j - 1])
            now = made + own[j:]  # of the ids from i on
            if not i and j == len(own) or agrees and before is not None and now == ids[i:last_i] + before:
                return i, j, (made, a, b)
            before, last_i = now if agrees else None, i
            width *= 2

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as bytes; texts go many at a time, parted by line ends, and are told apart by their tokens' places."""
        out = []
        for k in range(0, len(texts), 4000):
            some = texts[k : k + 4000]
            e = self.tokenizer.encode_batch(["\n".join(some)], add_special_tokens=False)[0]
            ids = np.array(e.ids, "<u4")
            begins = np.fromiter((x for x, _ in e.offsets), np.int64, len(ids))
            starts = np.cumsum([0, *(len(t) + 1 for t in some)])
            cut = (np.searchsorted(begins, starts) * 4).tolist()
            data = ids.tobytes()
            out += [data[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]
        return out

    def text_of(self, ids: bytes) -> bytes:
        """Decoded bytes of ids, with a blank after each token."""
        return b"".join([self.strings[i] for i in np.frombuffer(ids, "<u4").tolist()])

    def decoded(self, ids: bytes) -> bytes:
        if self.decodes_itself:
            return self.tokenizer.decode(np.frombuffer(ids, "<u4").tolist(), skip_special_tokens=False).encode()
        return self.text_of(ids)[:-1]

    def learn_words(self, words: set[bytes]) -> None:
        new = list(words - self.words.keys())
        if new:
            found = self.encode([w.decode() for w in new])
            self.words.update(zip(new, found, strict=True))
            self.word_bytes += sum(map(len, new)) + sum(map(len, found)) + 180 * len(new)

    def spans(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of chunks (even places) and cut words (odd places), and the first span of each text."""
        n = len(raw)
        sums, down = tb.rolling_sums(raw)
        at = np.arange(ROLL_BYTES, n)
        cuts = at[(tb.mix((sums[ROLL_BYTES:n] - sums[: n - ROLL_BYTES]) * down[: max(0, n - ROLL_BYTES)]) & self.mask) == 0] if n > ROLL_BYTES else at
        text = np.searchsorted(offsets, cuts, "right") - 1
        inside = cuts - ROLL_BYTES >= offsets[text]
        cuts, text = cuts[inside], text[inside]
        space = np.flatnonzero(_SPACE[raw])
        k = np.searchsorted(space, cuts)
        padded = np.concatenate(([-1], space, [n]))
        low, high = np.maximum(padded[k] + 1, offsets[text]), np.minimum(padded[k + 1], offsets[text + 1])
        fresh = np.ones(len(low), bool)
        fresh[1:] = (low[1:] != low[:-1]) | (text[1:] != text[:-1])  # cuts within one word
        low, high, text = low[fresh], high[fresh], text[fresh]
        many = np.bincount(text, minlength=len(offsets) - 1)
        first = np.concatenate(([0], np.cumsum(2 * many + 1)))
        starts, ends = np.empty(first[-1], np.int64), np.empty(first[-1], np.int64)
        starts[first[:-1]], ends[first[1:] - 1] = offsets[:-1], offsets[1:]
        odd = first[text] + 1 + 2 * (np.arange(len(text)) - np.concatenate(([0], np.cumsum(many)[:-1]))[text])
        starts[odd], ends[odd], ends[odd - 1], starts[odd + 1] = low, high, low, high
        return starts, ends, first

    def encode_block(self, raw: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[bytes, bytes]]:
        """Ids (little-endian unsigned 32-bit) and decoded text of each text of a block."""
        if self.word_bytes > KEPT_WORD_BYTES:
            self.forget_words()
        if self.chunk_bytes > KEPT_CHUNK_BYTES:
            self.forget_chunks()
        data = raw.tobytes()
        if not self.blank_ends_words:
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                ids = self.encode_chunks(data[a:b].decode())
                yield ids, self.decoded(ids)
            return
        starts, ends, first = self.spans(raw, offsets)
        pieces = [data[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        limits = first.tolist()
        odd = np.zeros(len(pieces), bool)
        odd[np.arange(len(pieces))] = (np.arange(len(pieces)) - np.repeat(first[:-1], np.diff(first))) % 2 == 1
        is_cut = odd.tolist()
        new = {p: p.split() for p, cut in zip(pieces, is_cut, strict=True) if not cut and p not in self.chunks}
        self.chunks_met += len(pieces)
        self.chunks_encoded += len(new)
        words: set[bytes] = {p for p, cut in zip(pieces, is_cut, strict=True) if cut}
        for x in new.values():
            words.update(x)
        self.learn_words(words)
        table = self.words
        for p, x in new.items():
            ids = b"".join([table[w] for w in x])
            self.chunks[p] = done = (ids, self.text_of(ids))
            self.chunk_bytes += len(p) + len(done[0]) + len(done[1]) + 250
        regions: dict[bytes, tuple[bytes, bytes, bytes]] = {}
        wanted: list[list[bytes]] = []
        for k in range(len(limits) - 1):
            own = []
            for i in range(limits[k] + 1, limits[k + 1], 2):
                left, right = pieces[i - 1].rsplit(None, 1)[-1:], pieces[i + 1].split(None, 1)[:1]
                l, r = left[0] if left else b"", right[0] if right else b""
                region = b"\n".join((l, pieces[i], r))
                own.append(region)
                if region not in self.joins:
                    regions[region] = (l, pieces[i], r)
            wanted.append(own)
        if regions:
            self.learn_words({w for x in regions.values() for w in x})
            for (region, x), ids in zip(regions.items(), self.encode([r.decode() for r in regions]), strict=True):
                self.joins[region] = ids == b"".join([table[w] for w in x])
                self.chunk_bytes += 2 * len(region) + 150
        for k, own in enumerate(wanted):
            if all([self.joins[r] for r in own]):
                parts = []
                for i in range(limits[k], limits[k + 1]):
                    if is_cut[i]:
                        ids = table[pieces[i]]
                        parts.append((ids, self.text_of(ids)))
                    else:
                        parts.append(self.chunks[pieces[i]])
                yield b"".join([i for i, _ in parts]), b"".join([s for _, s in parts])[:-1]
            else:
                self.repairs += 1
                ids = self.encode_chunks(data[offsets[k] : offsets[k + 1]].decode())
                yield ids, self.decoded(ids)


def encoder(path: str) -> ChunkEncoder:
    """This worker's encoder for a vocabulary file."""
    if path not in _encoders:
        _encoders[path] = ChunkEncoder(path)
    return _encoders[path]


def encode(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, ids array<int> and the decoded text of each document."""
    return _encoded(docs, vocabulary, "ids array<int>, decoded string", [pa.list_(pa.int32()), pa.string()], lambda i, s: (np.frombuffer(i, "<i4"), s.decode()))


def encoding_digest(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, n_tokens and the SHA-256 of ids and of the decoded text."""
    return _encoded(docs, vocabulary, "n_tokens bigint, ids_sha256 string, decoded_sha256 string", [pa.int64(), pa.string(), pa.string()], lambda i, s: (len(i) // 4, hashlib.sha256(i).hexdigest(), hashlib.sha256(s).hexdigest()))


def _encoded(docs: DataFrame, vocabulary: str | None, columns: str, types: list[pa.DataType], of) -> DataFrame:
    prepare(docs.sparkSession)
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for b in batches:
            raw, offsets = tb.arrow_bytes(b.column(1))
            for i, j, r, o in tb.blocks(raw, offsets, BLOCK_BYTES):
                made = list(zip(*(of(*x) for x in own.encode_block(r, o)), strict=True))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), *(pa.array(list(x), t) for x, t in zip(made, types, strict=True))], ["doc_id", *(c.split()[0] for c in columns.split(", "))])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, {columns}")


def decode(encoded: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id and text from doc_id and ids; a null or empty array is the empty text."""
    prepare(encoded.sparkSession)
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for b in batches:
            texts = [own.decoded(np.array(ids or (), "<u4").tobytes()).decode() for ids in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")
