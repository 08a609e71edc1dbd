"""Quality rules with host-level verdicts.

Each document is measured and held to three rules; a host's failures of each rule are counted,
its rate is shrunk towards an empirical beta prior that is fitted to all hosts, and a host
whose shrunk rate of any rule passes ``HOST_LIMIT`` is rejected with all its documents.

A host is the host name in ``source`` (of a URL, or the bare value). Defined results: null and
empty texts have no words and fail; a document with a null source has no host and is judged
alone; repeated rows count and are returned each; long texts are whole; an empty table gives
no rows. Only doc_id, text and source are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textbytes as tb
from .util import prepare, stored

LEAST_WORDS = 50
REPEAT_PERCENT = 50
SYMBOL_PERCENT = 10
HOST_LIMIT = 0.5
#: Parts in which a host's documents are joined with its verdict.
SALTS = 32
RULES = ("short", "repetitive", "symbols")
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


def _sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many flags are set within each text."""
    return np.diff(np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))[offsets])


def measure_block(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """MEASURES of each text of a block."""
    n = len(offsets) - 1
    solid = tb.NONSPACE[raw]
    w = tb.Words(raw, offsets, tb.NONSPACE, tb.PLAIN)
    chars = _sums(solid & ((raw & 0xC0) != 0x80), offsets)
    symbols = _sums(_SYMBOL[raw], offsets)

    starts = np.unique(np.concatenate((offsets[:-1], np.flatnonzero(raw == 10) + 1)))
    starts = starts[starts < len(raw)]
    ends = np.append(starts[1:], len(raw))
    text = np.searchsorted(offsets, starts, "right") - 1
    filled = np.concatenate(([0], np.cumsum(solid)))
    line = filled[ends] > filled[starts]
    starts, ends, text = starts[line], ends[line], text[line]
    ends = ends - (raw[ends - 1] == 10)
    key = tb.mix(tb.SpanHashes(raw, tb.PLAIN).of(starts, ends) ^ tb.mix(text.astype(np.uint64)))
    _, first = np.unique(key, return_index=True)
    dup = np.bincount(text, minlength=n) - np.bincount(text[first], minlength=n)

    at, window = w.windows(3)
    window = tb.mix(window ^ tb.mix(w.text[at].astype(np.uint64)))
    order = np.argsort(window, kind="stable")
    ranked = window[order]
    same = ranked[1:] == ranked[:-1]
    twice = np.zeros(len(at) + 1, bool)
    twice[1:-1] = same
    again = at[order[twice[:-1] | np.append(same, False)]] if len(at) else at
    edge = np.zeros(len(w.hashes) + 1, np.int64)
    np.add.at(edge, again, 1)
    np.add.at(edge, again + 3, -1)
    covered = np.cumsum(edge)[:-1] > 0
    return np.diff(w.first), chars, symbols, dup, _sums(covered, w.first)


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, source and the measures of each document."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, offsets = tb.arrow_bytes(b.column(2))
            for i, j, r, o in tb.blocks(raw, offsets):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), *(pa.array(x, pa.int64()) for x in measure_block(r, o))], ["doc_id", "source", *MEASURES])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("source").cast("string").alias("source"), "text").mapInArrow(run, f"doc_id {kind}, source string, " + ", ".join(f"{m} bigint" for m in MEASURES))


def failures() -> dict[str, Column]:
    """A column for each rule: whether the document fails it."""
    n = F.col("n_words")
    return {"short": n < LEAST_WORDS, "repetitive": F.col("n_repeat_words") * 100 > n * REPEAT_PERCENT, "symbols": F.col("n_symbols") * 100 > n * SYMBOL_PERCENT}


def host_of(source: Column) -> Column:
    return F.lower(F.regexp_extract(source, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://)?([^/:?#]*)", 1))


def beta_priors(hosts: DataFrame) -> dict[str, tuple[float, float]]:
    """Mean and strength of the beta prior of each rule's failure rate, by the moments of all hosts; one row reaches the driver."""
    n = F.col("n").cast("double")
    sums = [F.count(F.lit(1)), F.sum(n), F.sum(n * n), *(F.sum(f) for r in RULES for f in (F.col(f"f_{r}").cast("double"), F.col(f"f_{r}") * F.col(f"f_{r}") / n))]
    k, total, squares, *rest = hosts.agg(*(x.alias(f"s{i}") for i, x in enumerate(sums))).first()
    out = {}
    for rule, fails, shares in zip(RULES, rest[::2], rest[1::2], strict=True):
        if not k or not fails or fails == total:
            out[rule] = (fails / total if k else 0.0), 1e6
            continue
        mean = fails / total
        within = mean * (1 - mean)
        spread = shares - mean * fails  # the sum of n * (f / n - mean)^2
        room = (total - squares / total - (k - 1)) * within
        rho = min(1 - 1e-6, max(1e-6, (spread - (k - 1) * within) / room)) if room > 0 else 1e-6
        out[rule] = mean, (1 - rho) / rho
    return out


def host_rates(measured: DataFrame) -> DataFrame:
    """host, n, failures of each rule (f_), shrunk rates (rate_) and the verdict (rejected)."""
    failed = failures()
    hosts = measured.where("source is not null").groupBy(host_of(F.col("source")).alias("host")).agg(F.count(F.lit(1)).alias("n"), *(F.sum(c.cast("bigint")).alias(f"f_{r}") for r, c in failed.items()))
    hosts = stored(hosts)
    for rule, (mean, strength) in beta_priors(hosts).items():
        hosts = hosts.withColumn(f"rate_{rule}", (F.col(f"f_{rule}") + mean * strength) / (F.col("n") + strength))
    return hosts.withColumn("rejected", F.greatest(*(F.col(f"rate_{r}") for r in RULES)) > HOST_LIMIT)


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, the measures, base_failed, and kept after the verdict on the document's host.

    Documents meet their host's verdict in ``SALTS`` parts, so neither a host of very many documents nor those without a host
    fill one task; where the rejected hosts are few, Spark broadcasts them instead.
    """
    measured = stored(measure(docs))
    salt = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    bad = host_rates(measured).where("rejected").select("host", salt, F.lit(True).alias("rejected"))
    failed = failures()
    dealt = F.pmod(F.xxhash64("doc_id", "word_chars", "n_words"), F.lit(SALTS)).cast("int")
    out = measured.withColumn("host", host_of(F.col("source"))).withColumn("salt", dealt).join(bad, ["host", "salt"], "left")
    base = failed["short"] | failed["repetitive"]
    return out.select("doc_id", *MEASURES, base.alias("base_failed"), (~base & ~F.coalesce("rejected", F.lit(False))).alias("kept"))


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents),
words AS (SELECT rid, unnest(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS w, generate_subscripts(regexp_extract_all(t, '[^\x20\x09-\x0D]+'), 1) AS p FROM d),
win AS (SELECT rid, p, w, lead(w) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM words WINDOW o AS (PARTITION BY rid ORDER BY p)),
many AS (SELECT rid, p, count(*) OVER (PARTITION BY rid, w, w2, w3) AS c FROM win WHERE w3 IS NOT NULL),
hit AS (SELECT rid, count(DISTINCT p + k) AS n FROM many, (VALUES (0), (1), (2)) v(k) WHERE c > 1 GROUP BY rid),
lines AS (SELECT rid, unnest(string_split(t, chr(10))) AS l FROM d),
dups AS (SELECT rid, count(*) - count(DISTINCT l) AS n FROM lines WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY rid),
counts AS (SELECT rid, count(*) AS n_words, sum(length(w)) AS word_chars FROM words GROUP BY rid),
m AS (SELECT d.doc_id, d.source, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars,
  len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(dups.n, 0)::BIGINT AS n_dup_lines, coalesce(hit.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN counts USING (rid) LEFT JOIN dups USING (rid) LEFT JOIN hit USING (rid)),
f AS (SELECT *, lower(regexp_extract(source, '^(?:[A-Za-z][A-Za-z0-9+.-]*://)?([^/:?#]*)', 1)) AS host,
  n_words < 50 AS short, n_repeat_words * 100 > n_words * 50 AS repetitive, n_symbols * 100 > n_words * 10 AS symbols FROM m),
h AS (SELECT host, r.rule, count(*) AS n, count(*) FILTER (CASE r.rule WHEN 'short' THEN short WHEN 'repetitive' THEN repetitive ELSE symbols END) AS x
  FROM f, (VALUES ('short'), ('repetitive'), ('symbols')) r(rule) WHERE source IS NOT NULL GROUP BY 1, 2),
pooled AS (SELECT rule, count(*) AS k, sum(n)::DOUBLE AS total, sum((n * n)::DOUBLE) AS squares, sum(x)::DOUBLE AS fails FROM h GROUP BY rule),
spread AS (SELECT rule, sum(h.n * pow(h.x / h.n - fails / total, 2)) AS s FROM h JOIN pooled USING (rule) GROUP BY rule),
prior AS (SELECT rule, fails / total AS mean, CASE WHEN fails = 0 OR fails = total THEN 1e6 ELSE (1 - rho) / rho END AS strength FROM
  (SELECT *, CASE WHEN room > 0 THEN least(1 - 1e-6, greatest(1e-6, (s - (k - 1) * within) / room)) ELSE 1e-6 END AS rho FROM
  (SELECT *, (total - squares / total - (k - 1)) * within AS room FROM (SELECT *, fails / total * (1 - fails / total) AS within FROM pooled JOIN spread USING (rule))))),
bad AS (SELECT DISTINCT host FROM h JOIN prior USING (rule) WHERE (x + mean * strength) / (n + strength) > 0.5)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, short OR repetitive AS base_failed,
  NOT (short OR repetitive) AND bad.host IS NULL AS kept FROM f LEFT JOIN bad USING (host)
"""
