"""Secret scans: fixed patterns, and a token-efficiency test that exposes random strings.

A tokenizer's vocabulary compresses what people write; a random string of the same characters
falls into many short tokens. Of every run of ``MIN_CHARS`` or more key characters, digests
(hexadecimal of a digest's length) and UUIDs are set aside, wherever they stand in it. What is
left between them, if as long and with a letter, is cut into tokens of a tiktoken vocabulary, and
is reported (kind ``rand``) where it has fewer than ``CHARS_PER_TOKEN`` characters to a token,
unless it is a number, or made of words and numbers joined by separators. In a run that is not
reported whole, as words before a key may hide it, each part between separators and each
stretch of ``MIN_CHARS`` characters are tested in the same way. Runs that hold other signs of
keys, too (``.!@#$%^&*~``), are tested with these: between rules of one sign, percent escapes,
digests and UUIDs, unless they are an address or mostly words, numbers and versions. Parts of a
key that a dot joins are one span.

The texts are screened as bytes for runs and keywords, so the patterns themselves run only
on documents that can hold a match.

Defined results: null and empty texts have no spans; spans are in code points, end exclusive,
sorted by start and then by kind; spans of one kind never overlap; long texts are whole;
repeated rows get a row each. Only doc_id and text are read by the scan.
"""

from __future__ import annotations

import base64
import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import textbytes as tb
from .util import prepare

KINDS = ("assign", "access", "hex", "rand")
MIN_CHARS = 20
CHARS_PER_TOKEN = 2.0
DIGEST_CHARS = (32, 40, 48, 56, 64, 96, 128)
REDACTED = "[REDACTED]"

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_LONG_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
_RUN = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % MIN_CHARS)
_SIGNED = re.compile(r"[A-Za-z0-9+/_=.!@#$%%^&*~-]{%d,}" % MIN_CHARS)
_SIGN = re.compile(r"[.!@#$%^&*~]")
_RULE = re.compile(r"([+/_=.!@#$%^&*~-])\1{3,}")
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_ESCAPES = re.compile(r"(?:%[0-9A-Fa-f]{2}){3,}")
_VERSION = re.compile(r"(?<![A-Za-z0-9])v?[0-9]+(?:\.[0-9]+)+(?![A-Za-z0-9])|%[0-9A-F]{2}")
_UUID = re.compile(r"(?<![A-Za-z0-9])[0-9A-Fa-f]{8}-(?:[0-9A-Fa-f]{4}-){3}[0-9A-Fa-f]{12}(?![A-Za-z0-9])")
_DIGEST = re.compile(r"[0-9a-f]+|[0-9A-F]+")
_PIECE = re.compile(r"[A-Za-z0-9]+")
_LETTER = re.compile(r"[A-Za-z]")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_PARTS = re.compile(r"(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]+)(?:[/_=+-](?:[A-Z]?[a-z]+|[A-Z]+|[0-9]+))*[=]*")

_SEPARATORS = "/_+=-.!@#$%^&*~"

_HEX_BYTES = np.zeros(256, bool)
_HEX_BYTES[48:58] = _HEX_BYTES[97:103] = True
_KEY_BYTES = np.zeros(256, bool)
_KEY_BYTES[48:58] = _KEY_BYTES[65:91] = _KEY_BYTES[97:123] = True
_KEY_BYTES[[ord(c) for c in _SEPARATORS]] = True
_encodings: dict[str, object] = {}


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def _encoding(path: str):
    if path not in _encodings:
        import public_tokenizers
        import tiktoken

        with open(path) as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(str.split, lines)}
        _encodings[path] = tiktoken.Encoding("scan", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path]


def known(s: str) -> bool:
    """A digest or an identifier, not a secret."""
    return bool(_DIGEST.fullmatch(s) and len(s) in DIGEST_CHARS or _UUID.fullmatch(s))


def _incompressible(s: str, encoding) -> bool:
    return len(s) < CHARS_PER_TOKEN * len(encoding.encode_ordinary(s))


def _plain(s: str, encoding) -> bool:
    """Without a letter, or words and numbers joined by separators; a long random string of one case is no word."""
    if not _LETTER.search(s):
        return True
    return bool(_PARTS.fullmatch(s.strip("/_=+-"))) and not any(len(w) >= MIN_CHARS and _LETTER.search(w) and _incompressible(w, encoding) for w in _PIECE.findall(s))


def _hidden(s: str, encoding) -> list[tuple[int, int]]:
    """Spans in a run that are random though the run as a whole is not."""
    pieces = [m.span() for m in _PIECE.finditer(s)]
    starts, stops = [a for a, _ in pieces], [b for _, b in pieces]
    marked = [(a, b) for a, b in pieces if b - a >= MIN_CHARS and _LETTER.search(s[a:b]) and _incompressible(s[a:b], encoding)]
    ends = np.cumsum([0] + [len(encoding.decode_single_token_bytes(t)) for t in encoding.encode_ordinary(s)])
    last = np.searchsorted(ends, ends + MIN_CHARS)
    i = np.flatnonzero(last < len(ends))
    a, b = ends[i], ends[last[i]]
    dense = b - a < CHARS_PER_TOKEN * (last[i] - i)
    marked += zip(a[dense].tolist(), b[dense].tolist(), strict=True)
    word = lambda p: 4 <= p[1] - p[0] < MIN_CHARS and _WORD.fullmatch(s[p[0] : p[1]]) and not _incompressible(s[p[0] : p[1]], encoding)
    rest = lambda p: not word(p) and (p[1] - p[0] < 4 or _incompressible(s[p[0] : p[1]], encoding))
    out: list[tuple[int, int]] = []
    for a, b in _merged(marked):  # whole parts, without the words at both ends
        first, final = bisect_right(stops, a), bisect_left(starts, b) - 1
        while first <= final and word(pieces[first]):
            first += 1
        while first <= final and word(pieces[final]):
            final -= 1
        if first <= final and stops[final] - starts[first] >= MIN_CHARS and not _plain(s[starts[first] : stops[final]], encoding):
            while first and (rest(pieces[first - 1]) or s[starts[first] - 1] == "+"):
                first -= 1
            while final + 1 < len(pieces) and (rest(pieces[final + 1]) or s[stops[final]] == "+"):
                final += 1
            start, end = starts[first], stops[final]
            while end < len(s) and s[end] == "=":
                end += 1
            if out and start < out[-1][1]:
                out[-1] = (out[-1][0], max(out[-1][1], end))
            else:
                out.append((start, end))
    return out


def _unknown(s: str) -> Iterator[tuple[int, int]]:
    """What a run holds besides digests and UUIDs, without the separators next to these."""
    fixed = sorted([m.span() for m in _UUID.finditer(s)] + [m.span() for m in _PIECE.finditer(s) if known(m[0])])
    at = 0
    for a, b in [*fixed, (len(s), len(s))]:
        start, end = at, a
        while at and start < end and s[start] in "/_+=-":
            start += 1
        while a < len(s) and end > start and s[end - 1] in "/_+=-":
            end -= 1
        if end - start >= MIN_CHARS:
            yield start, end
        at = b


def _signed_plain(s: str, encoding) -> bool:
    """Words and numbers between signs, as in addresses and formulas; not where hardly a part is a word."""
    if not _LETTER.search(s) or _EMAIL.fullmatch(s):
        return True
    rest = _VERSION.sub("=", s)
    words = len(s) - len(rest) + sum(len(w) for w in _WORD.findall(rest) if len(w) >= 3 and not _incompressible(w, encoding))
    if all(_WORD.fullmatch(p) for p in _PIECE.findall(rest)):
        return len(set(_SIGN.findall(rest))) < 3 or 2 * words >= len(s)
    return 3 * words >= 2 * len(s)


def _signed_spans(s: str, encoding) -> Iterator[tuple[int, int]]:
    """Spans in a run with signs: all of a stretch between rules, digests and UUIDs, or its dense parts."""
    fixed = sorted([m.span() for m in _UUID.finditer(s)] + [m.span() for m in _PIECE.finditer(s) if known(m[0])] + [m.span() for m in _RULE.finditer(s)] + [m.span() for m in _ESCAPES.finditer(s)])
    at = 0
    for a, b in [*fixed, (len(s), len(s))]:
        start = at + len(s[at:a]) - len(s[at:a].lstrip(_SEPARATORS)) if at else at
        end = start + len(s[start:a].rstrip(_SEPARATORS if a < len(s) else ".!*~"))
        at = max(at, b)
        t = s[start:end]
        if len(t) < MIN_CHARS or not _SIGN.search(t) or _signed_plain(t, encoding):
            continue
        if _incompressible(t, encoding):
            yield start, end
            continue
        ends = np.cumsum([0] + [len(encoding.decode_single_token_bytes(k)) for k in encoding.encode_ordinary(t)])
        last = np.searchsorted(ends, ends + MIN_CHARS)
        i = np.flatnonzero(last < len(ends))
        i = i[ends[last[i]] - ends[i] < CHARS_PER_TOKEN * (last[i] - i)]
        for x, y in _merged(zip(ends[i].tolist(), ends[last[i]].tolist(), strict=True)):
            x += len(t[x:y]) - len(t[x:y].lstrip(_SEPARATORS))
            y = x + len(t[x:y].rstrip("."))
            if y - x >= MIN_CHARS and _SIGN.search(t, x, y) and not _signed_plain(t[x:y], encoding):
                yield start + x, start + y


def _merged(spans) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def random_spans(text: str, vocabulary: str) -> list[tuple[int, int]]:
    """Runs of key characters, or what is hidden in them, that the vocabulary compresses badly; parts joined by a dot are one."""
    out = []
    encoding = _encoding(vocabulary)
    for m in _RUN.finditer(text):
        for a, b in _unknown(m[0]):
            s, at = m[0][a:b], m.start() + a
            if _plain(s, encoding):
                continue
            if _incompressible(s, encoding):
                out.append((at, at + len(s)))
            else:
                out += [(at + x, at + y) for x, y in _hidden(s, encoding)]
    for m in _SIGNED.finditer(text):
        if _SIGN.search(m[0]):
            out += [(m.start() + x, m.start() + y) for x, y in _signed_spans(m[0], encoding)]
    joined: list[tuple[int, int]] = []
    for a, b in _merged(out):
        if joined and a == joined[-1][1] + 1 and text[a - 1] == ".":
            joined[-1] = (joined[-1][0], b)
        else:
            joined.append((a, b))
    return joined


def base_spans(text: str) -> list[tuple[str, int, int]]:
    found = [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return found + [("hex", *m.span()) for m in _LONG_HEX.finditer(text)]


def in_order(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def _suspects(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Texts with a long run of hexadecimal or key characters."""
    out = np.zeros(len(offsets) - 1, bool)
    for inside, least in ((_HEX_BYTES, 24), (_KEY_BYTES, MIN_CHARS)):
        starts, ends = tb.runs(inside[raw], offsets)
        out[np.searchsorted(offsets, starts[ends - starts >= least], "right") - 1] = True
    return out


def batch_spans(texts: pa.Array, vocabulary: str) -> tuple[list[list], list[list]]:
    """Base spans and all spans of each text, in order."""
    n = len(texts)
    base, every = [[] for _ in range(n)], [[] for _ in range(n)]
    raw, offsets = tb.arrow_bytes(texts)
    for i, j, r, o in tb.blocks(raw, offsets):
        suspect = _suspects(r, o)
        data = r.tobytes()
        for k, low in enumerate(data[a:b].lower() for a, b in zip(o[:-1].tolist(), o[1:].tolist(), strict=True)):
            if not (suspect[k] or b"akia" in low or b"secret" in low or b"token" in low or b"passw" in low or b"api" in low and (b"apikey" in low or b"api_key" in low)):
                continue
            text = data[o[k] : o[k + 1]].decode()
            base[i + k] = in_order(base_spans(text))
            every[i + k] = in_order(base[i + k] + [("rand", *s) for s in random_spans(text, vocabulary)])
    return base, every


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def scan_secrets(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, counts of the base kinds, SHA-256 of the base spans, n_rand, and all spans."""
    prepare(docs.sparkSession)
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            base, every = batch_spans(b.column(1), path)
            count = lambda kind: pa.array([sum(s[0] == kind for s in x) for x in every], pa.int64())  # noqa: B023, E731
            digest = pa.array([hashlib.sha256(_joined(x).encode()).hexdigest() for x in base], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), count("assign"), count("access"), count("hex"), digest, pa.array([_joined(x) for x in every], pa.string()), count("rand")], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_rand"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_rand bigint")


def redact_text(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with every span, overlapping ones as one, replaced by a fixed mark."""
    out, at = [], 0
    for _, a, b in sorted(spans, key=lambda s: s[1]):
        if a >= at:
            out += [text[at:a], REDACTED]
        at = max(at, b)
    return "".join(out) + text[at:]


def redact(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """All documents with their secrets replaced; n_chars, where there is one, follows the text. Others are as they were."""
    prepare(docs.sparkSession)
    path = vocabulary or default_vocabulary()
    names = docs.columns
    at, n_at = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, every = batch_spans(b.column(at), path)
            hit = [k for k, s in enumerate(every) if s]
            if hit:
                texts = b.column(at).to_pylist()
                sizes = b.column(n_at).to_pylist() if n_at is not None else []
                for k in hit:
                    texts[k] = redact_text(texts[k], every[k])
                    if sizes:
                        sizes[k] = len(texts[k])
                columns = list(b.columns)
                columns[at] = pa.array(texts, columns[at].type)
                if sizes:
                    columns[n_at] = pa.array(sizes, columns[n_at].type)
                b = pa.RecordBatch.from_arrays(columns, schema=b.schema)
            yield b

    return docs.mapInArrow(run, docs.schema)
