"""Vectorised work on the UTF-8 bytes of a batch of texts.

A batch of texts is one byte array with an offset for each text. Words, their hashes and
their shingles come out as flat arrays with the index of the text they belong to, so that
nothing runs once per word in Python. A null text has no bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once (a longer text is a block of its own).
BLOCK_BYTES = 1 << 18

_U = np.uint64
_WORD_SEED = 20261
#: Rolling hashes are polynomials modulo 2^64; span hashes are two polynomials modulo this prime.
_PRIME = (1 << 31) - 1
_MODULI = {"rolling": (1 << 64, 0x9E3779B97F4A7C15), "first": (_PRIME, 1_583_458_089), "second": (_PRIME, 784_588_716)}

#: Bytes whose codes times powers add up to less than 2^62.
_NO_OVERFLOW = 1 << 22
#: A random 64-bit code for each byte value.
_ROLLING = np.random.default_rng(_WORD_SEED).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)

_powers_kept: dict[str, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (splitmix64 finaliser)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _fold(x: np.ndarray) -> np.ndarray:
    """A smaller number with the same rest modulo the prime 2^31 - 1; twice makes it 2^31 or less from any below 2^62."""
    return (x & _U(_PRIME)) + (x >> _U(31))


def _rest(x: np.ndarray) -> np.ndarray:
    """The rest of numbers below 2^63 modulo the prime."""
    x = _fold(_fold(x))
    return np.where(x >= _U(_PRIME), x - _U(_PRIME), x)


def _powers(kind: str, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of a base and of its inverse, kept per worker up to a block's length."""
    kept = _powers_kept.get(kind)
    if kept is None or len(kept[0]) < n:
        modulus, base = _MODULI[kind]
        size = max(n, BLOCK_BYTES + 4096)
        both = []
        for b in (base, pow(base, -1, modulus)):
            p = np.empty(size, _U)
            p[0], done = 1, 1
            while done < size:  # doubling: p[done:2*done] = p[:done] * b**done
                take = min(done, size - done)
                p[done : done + take] = p[:take] * _U(pow(b, done, modulus))
                if modulus == _PRIME:
                    p[done : done + take] = _rest(p[done : done + take])
                done += take
            both.append(p)
        kept = (both[0], both[1])
        if size <= 4 * BLOCK_BYTES:
            _powers_kept[kind] = kept
    return kept


def byte_codes(fold_case: bool) -> np.ndarray:
    """1 to 256 for the byte values; with fold_case A-Z have the codes of a-z."""
    codes = np.arange(1, 257, dtype=np.uint64)
    if fold_case:
        codes[65:91] = codes[97:123]
    return codes


def arrow_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than texts) of an Arrow string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if where else np.zeros(1, np.int64)
    if not len(offsets):
        offsets = np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(data) else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def blocks(raw: np.ndarray, offsets: np.ndarray, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Consecutive texts of about ``most`` bytes: (first, last+1, bytes, offsets)."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, j, raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True that stay within one text."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    first = inside[0]
    starts = edge[1::2] if first else edge[0::2]
    ends = edge[0::2] if first else edge[1::2]
    if first:
        starts = np.concatenate(([0], starts))
    if len(ends) < len(starts):
        ends = np.concatenate((ends, [n]))
    cut = np.unique(offsets[1:-1])
    cut = cut[(cut > 0) & (cut < n)]
    cut = cut[inside[cut - 1] & inside[cut]]
    if len(cut):
        starts = np.sort(np.concatenate((starts, cut)))
        ends = np.sort(np.concatenate((ends, cut)))
    return starts, ends


def rolling_sums(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running polynomial hash of the bytes modulo 2^64, and the inverse powers that make its differences comparable.

    Good for choosing places in a text, not for telling strings apart: some unequal strings of a regular build agree.
    """
    up, down = _powers("rolling", len(raw) + 1)
    sums = np.empty(len(raw) + 1, _U)
    sums[0] = 0
    np.cumsum(_ROLLING[raw] * up[: len(raw)], out=sums[1:])
    return sums, down


class SpanHashes:
    """62-bit hashes of byte spans: two polynomials modulo the prime 2^31 - 1.

    Equal spans have equal hashes; two unequal ones of n bytes agree with probability (n / 2^31)^2 at most over the choice of
    the bases, whatever their build.
    """

    def __init__(self, raw: np.ndarray, codes: np.ndarray):
        n = len(raw)
        code = codes[raw]
        self.parts = []
        for kind in ("first", "second"):
            up, down = _powers(kind, n + 1)
            sums = np.empty(n + 1, _U)
            sums[0] = 0
            for k in range(0, n, _NO_OVERFLOW):
                part = slice(k + 1, k + 1 + _NO_OVERFLOW)
                np.cumsum(code[k : k + _NO_OVERFLOW] * up[k : min(n, k + _NO_OVERFLOW)], out=sums[part])
                if k:
                    sums[part] += _rest(sums[k : k + 1])
            self.parts.append((sums, down))

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        a, b = (_rest((_rest(sums[ends]) + _U(_PRIME) - _rest(sums[starts])) % _U(_PRIME) * down[starts]) for sums, down in self.parts)
        return mix((a << _U(31) | b) ^ (ends - starts).astype(_U) << _U(40))


def alnum_class() -> np.ndarray:
    """Which bytes belong to a word of ASCII letters, digits and anything beyond ASCII."""
    keep = np.zeros(256, bool)
    keep[48:58] = keep[65:91] = keep[97:123] = keep[128:] = True
    return keep


def nonspace_class() -> np.ndarray:
    """Which bytes belong to a word between space, tab, newline, vertical tab, form feed and return."""
    keep = np.ones(256, bool)
    keep[32] = keep[9:14] = False
    return keep


class Words:
    """The words of a block of texts: starts, ends, hashes, text index, and first word of each text."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, inside: np.ndarray, codes: np.ndarray):
        self.starts, self.ends = runs(inside[raw], offsets)
        self.hashes = SpanHashes(raw, codes).of(self.starts, self.ends)
        self.first = np.searchsorted(self.starts, offsets)  # of each text, and the number of words at the end
        self.text = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))

    def windows(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """First word and hash of each window of ``width`` words of one text."""
        n = len(self.hashes) - width + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, _U)
        at = np.flatnonzero(self.text[:n] == self.text[width - 1 :])
        total = np.zeros(n, _U)
        for j in range(width):
            total += mix(self.hashes[j : j + n] + _U((j + 1) * 0xD1B54A32D192ED03 & (1 << 64) - 1))
        return at, mix(total[at])


FOLDED = byte_codes(True)
PLAIN = byte_codes(False)
#: Other codes for the byte values, for a second hash.
SCRAMBLED = np.random.default_rng(_WORD_SEED + 1).permutation(PLAIN)
ALNUM = alnum_class()
NONSPACE = nonspace_class()
