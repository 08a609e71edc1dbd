"""Operators that compare documents with each other, the archives, and the pipeline, against brute force."""

import base64
import gzip
import hashlib
import random
import re
from itertools import combinations
from pathlib import Path

import pyarrow as pa
import pytest

from tallyweave.llm import graph, jaccard, repeats, warc
from tallyweave.llm.graph import components
from tallyweave.llm.util import shared_dir, written

from .test_text_operators import sha, words


def brute_repeats(docs, match):
    seen, out = set(), {}
    for i, t in sorted(docs):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - match + 1):
            w = b[p : p + match]
            if w in seen:
                gone[p : p + match] = b"\1" * match
            seen.add(w)
        spans = sum(gone[k] and (k == 0 or not gone[k - 1]) for k in range(len(b)))
        out[i] = (len(b), sum(gone), spans, sha(bytes(c for c, g in zip(b, gone, strict=True) if not g)))
    return out


@pytest.fixture(scope="module")
def patchwork():
    r = random.Random(5)
    base = ["".join(r.choice("abcd ") for _ in range(r.randint(0, 300))) for _ in range(12)]
    docs = []
    for i in range(120):
        t = "".join(r.choice(base)[r.randint(0, 100) : r.randint(100, 300)] for _ in range(r.randint(0, 4)))
        t += "ab" * r.randint(0, 80) * (r.random() < 0.3) + "é" * r.randint(0, 90) * (r.random() < 0.2)
        docs.append((i, t))
    return docs


@pytest.mark.parametrize("match,hot,shard", [(100, 20_000, 1 << 19), (100, 2, 1 << 19), (40, 20_000, 2000)])
def test_repeats(spark, patchwork, match, hot, shard):
    d = spark.createDataFrame(patchwork, "doc_id bigint, text string").repartition(5)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.repeat_report(d, match, hot, shard).collect()}
    assert got == brute_repeats(patchwork, match)


def test_repeats_of_the_documents(spark, docs, rows):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.repeat_report(docs).collect()}
    assert got == brute_repeats(rows, 100)
    kept = {r.doc_id: sha(bytes(r.kept)) for r in repeats.remove_repeats(docs).collect()}
    assert kept == {i: v[3] for i, v in got.items()}


def brute_rows(rows, match, order):
    """As ``brute_repeats``, for rows in any order: earlier means earlier in ``order`` or in the same row."""
    first = {}
    for place, k in enumerate(order):
        b = (rows[k][1] or "").encode()
        for p in range(len(b) - match + 1):
            first.setdefault(b[p : p + match], (place, p))
    out = []
    for place, k in enumerate(order):
        b = (rows[k][1] or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - match + 1):
            if first[b[p : p + match]] < (place, p):
                gone[p : p + match] = b"\1" * match
        out.append((rows[k][0], len(b), sum(gone), sha(bytes(c for c, g in zip(b, gone, strict=True) if not g))))
    return sorted(out, key=repr)


@pytest.mark.parametrize("hot", [20_000, 2])
def test_rows_without_or_with_one_doc_id(spark, hot):
    r = random.Random(9)
    passage = "".join(r.choice("abcdefgh ") for _ in range(200))
    other = "".join(r.choice("abcdefgh ") for _ in range(300))
    rows = [(1, passage + " tail"), (None, "zz " + passage), (None, "short"), (None, other), (7, other + "x"), (7, "y" + other), (None, passage[:150]), (None, None)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = [(x.doc_id, x.n_bytes, x.n_removed, x.kept_sha256) for x in repeats.repeat_report(d, hot_runs=hot).collect()]
    hashes = {x.text: x.h for x in d.selectExpr("text", "shiftleft(xxhash64(text), 1) | cast(doc_id is null AS bigint) AS h").collect()}
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, hashes[rows[k][1]]))
    assert sorted(got, key=repr) == brute_rows(rows, 100, order)
    again = [(x.doc_id, x.n_removed) for x in repeats.repeat_report(d.union(d), hot_runs=hot).collect()]  # rows equal in both are one document
    assert sorted(again, key=repr) == sorted(2 * [(a, c) for a, _, c, _ in got], key=repr)


def test_rows_that_repeat_many_times_are_settled_once():
    runs = [(1, 5, 7, 9, 3 << 16 | 4), (1, 5, 8, 9, 3 << 16 | 4), (1, 6, 8, 9, 200 << 16 | 4), (2, 5, 7, 9, 9 << 16 | 1), (3, 90, 8, 9, -1 - 40)]
    names = ["shard", "mark", "doc_id", "row", "place"]
    batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], names)
    once = [r for b in repeats._settle(100)(iter([batch(runs)])) for r in b.to_pylist()]
    assert [tuple(r.values()) for r in once] == [(None, 8, 9, 40, 90), (None, 8, 9, 3, 103), (1, 7, 9, 3, 103), (1, 8, 9, 200, 103)]
    many = [r for r in runs for _ in range(500)]
    again = [r for b in repeats._settle(100)(batch(many[k : k + 300]) for k in range(0, len(many), 300)) for r in b.to_pylist()]
    assert sorted(map(repr, again)) == sorted(map(repr, once))


def test_rows_that_repeat_many_times_are_compared_once(spark):
    r = random.Random(17)
    words_ = [f"w{r.randrange(10**6)}" for _ in range(100)]
    rows = [(None, " ".join(words_))] * 300 + [(None, " ".join([*words_[:99], "end"]))] * 300 + [(4, " ".join(words_))] * 50
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    sets = jaccard._sets(d.selectExpr("xxhash64(text) AS k1", "xxhash64(text, 1) AS k2", "text", "1L AS label", "2 AS nb", "0 AS block").coalesce(1))
    assert sets.count() == 4  # two texts in two pairs of blocks
    got = {(x.doc_id, x.copy_id, x.class_id, x.n_links) for x in jaccard.near_duplicates(d).collect()}
    assert got == {(None, 4, 4, 1), (None, None, 4, 1), (4, 4, 4, 1)}
    assert [x.doc_id for x in jaccard.keep_one_of_each(d).collect()] == [4]


@pytest.mark.parametrize("hot", [20_000, 2])
def test_repeat_groups_have_all_occurrences(spark, patchwork, hot):
    docs = [*patchwork, *((1000 + i, t) for i, t in patchwork[:30])]
    texts = {i: t.encode() for i, t in docs}
    d = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5)
    groups = {}
    for r in repeats.repeat_groups(d, hot_runs=hot).collect():
        groups.setdefault((r.group, r.size), set()).add((r.doc_id, r.start))
    covered = {i: bytearray(len(t)) for i, t in texts.items()}
    for (_, n), places in groups.items():
        strings = {texts[i][a : a + n] for i, a in places}
        assert len(strings) == 1 and len(places) > 1
        for i, a in sorted(places)[1:]:
            covered[i][a : a + n] = b"\1" * n
        if hot > 2 and len(places) < 6:  # all occurrences
            assert places == {(i, a) for i, t in texts.items() for a in range(len(t) - n + 1) if t[a : a + n] in strings}
    want = brute_repeats(docs, 100)
    assert {i: sum(c) for i, c in covered.items()} == {i: v[1] for i, v in want.items()}


def test_bytes_are_compared_where_hashes_agree(spark, patchwork, monkeypatch):
    """Runs whose hashes agree although their bytes differ are left to the suffix array."""
    real = repeats.anchored_runs
    monkeypatch.setattr(repeats, "anchored_runs", lambda *a: (*(x := real(*a))[:4], x[4] * 0))
    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in patchwork]), pa.array([0] * len(patchwork)), pa.array([t for _, t in patchwork])], ["doc_id", "row", "text"])

    class Docs:  # stands for a frame: runs the task's function here
        def select(self, *_):
            return self

        def mapInArrow(self, scan, _):
            return list(scan(iter([batch])))

    texts = {i: t.encode() for i, t in patchwork}
    for b in repeats._read_runs(Docs(), 100):
        for _, size, doc, _, place in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if place < 0:  # a removed span has an earlier equal run for every window
                s = texts[doc][-1 - place : -1 - place + size]
                assert all(any(s[k : k + 100] in t for i, t in texts.items() if i <= doc) for k in range(len(s) - 99))


def test_maximal_repeats():
    text = b"xabcabcaby abcab z"
    array = repeats.EnhancedSuffixArray([text], 2)
    got = {(text[array.at[p[0]] : array.at[p[0]] + n], tuple(sorted(array.at[p].tolist()))) for n, p in array.maximal_repeats(2)}
    want = set()
    for n in range(2, len(text)):
        for s in {text[i : i + n] for i in range(len(text) - n + 1)}:
            at = [i for i in range(len(text) - n + 1) if text[i : i + n] == s]
            left = {text[i - 1 : i] or i for i in at}
            right = {text[i + n : i + n + 1] or i for i in at}
            if len(at) > 1 and len(left) > 1 and len(right) > 1:
                want.add((s, tuple(at)))
    assert got == want


def brute_links(docs):
    key = {i: tuple(words(t)) for i, t in docs}
    sets = {i: {w[a : a + 5] for a in range(max(1, len(w) - 4))} for i, w in key.items() if w}
    first = {}
    for i in sorted(key):
        first.setdefault(key[i], i)
    reps = sorted({first[w] for w in key.values() if w})
    up = {i: i for i in reps}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    links = dict.fromkeys(reps, 0)
    for a, b in combinations(reps, 2):
        if min(len(sets[a]), len(sets[b])) >= 0.8 * max(len(sets[a]), len(sets[b])):
            shared = len(sets[a] & sets[b])
            if shared >= 0.8 * (len(sets[a]) + len(sets[b]) - shared) - 1e-9:
                links[a] += 1
                links[b] += 1
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {i: (first[w], find(first[w]), links[first[w]]) if w else (i, i, 0) for i, w in key.items()}


def near_copies():
    r = random.Random(7)
    vocabulary = ["".join(r.choice("aeioustrn") for _ in range(5)) for _ in range(500)]
    docs = []
    for g in range(12):
        base = [r.choice(vocabulary) for _ in range(r.choice((30, 120, 400)))]
        for k in range(r.randint(1, 12)):
            w = list(base)
            for _ in range(int(len(w) * r.choice((0, 0.005, 0.01, 0.03)))):
                w[r.randrange(len(w))] = r.choice(vocabulary)
            docs.append((100 * g + k, " ".join(w).capitalize() + "."))
    return [*docs, (5000, ""), (5001, None), (5002, "two words"), (5003, "Two words!"), (5004, "...")]


def test_near_duplicates(spark, monkeypatch):
    docs = near_copies()
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    want = brute_links(docs)
    assert sum(v[2] for v in want.values()) > 20
    shape = lambda x: {r.doc_id: (r.copy_id, r.class_id, r.n_links) for r in x.collect()}
    assert shape(jaccard.near_duplicates(d)) == want
    monkeypatch.setattr(jaccard, "BLOCK_DOCS", 3)  # clusters are spread over pairs of blocks
    monkeypatch.setattr(jaccard, "BROADCAST_MEMBERS", 0)
    assert shape(jaccard.near_duplicates(d)) == want
    kept = {r.doc_id for r in jaccard.keep_one_of_each(d).collect()}
    assert kept == {i for i, v in want.items() if v[1] == i}


def test_links_count_once_when_blocks_are_empty(spark, monkeypatch):
    """Clusters of two or three texts in several blocks, some of which no text is drawn into."""
    r = random.Random(11)
    docs = []
    for g in range(16):
        base = [f"w{r.randrange(10**6)}" for _ in range(120)]
        docs += [(10 * g + k, " ".join([*base[: 118 + k % 2], f"end{k}"])) for k in range(2 + g % 2)]
    want = brute_links(docs)
    assert {v[2] for v in want.values()} == {1, 2}
    monkeypatch.setattr(jaccard, "BLOCK_WORDS", 100)
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    assert {x.doc_id: (x.copy_id, x.class_id, x.n_links) for x in jaccard.near_duplicates(d).collect()} == want


def test_near_duplicates_of_the_documents(spark, docs, rows):
    got = {r.doc_id: (r.copy_id, r.class_id, r.n_links) for r in jaccard.near_duplicates(docs).collect()}
    assert got == brute_links(rows)


def test_texts_that_share_a_doc_id_or_have_none(spark):
    r = random.Random(21)
    words_ = [f"w{r.randrange(10**6)}" for _ in range(100)]
    a, b = " ".join(words_), " ".join([*words_[:99], "end"])
    c = " ".join(f"v{r.randrange(10**6)}" for _ in range(60))
    rows = [(5, c), (5, a), (7, b), (None, b + "!"), (None, " ".join([*words_[:98], "x", "y"])), (None, c + " more"), (None, "alone here"), (None, ""), (None, None), (8, ""), (7, b)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted(((x.doc_id, x.copy_id, x.class_id, x.n_links) for x in jaccard.near_duplicates(d).collect()), key=repr)
    want = [(5, 5, 5, 1), (5, 5, 5, 2), (7, 7, 5, 2), (7, 7, 5, 2), (None, 7, 5, 2), (None, None, 5, 2), (None, None, 5, 1), (None, None, None, 0), (None, None, None, 0), (None, None, None, 0), (8, 8, 8, 0)]
    assert got == sorted(want, key=repr)
    kept = jaccard.keep_one_of_each(d).collect()
    assert sorted(map(tuple, kept), key=repr) == sorted([(5, c), (5, a), (None, "alone here"), (None, ""), (None, None), (8, "")], key=repr)


def test_pruning_keeps_true_pairs():
    needed = jaccard.least_matches(0.8, 1e-6)
    assert needed == sorted(needed) and needed[-1] < 0.8 * jaccard.STEP * jaccard.STEPS
    assert all(jaccard._log_choose_tail(m, n, 0.8) >= 1e-6 for m, n in zip(needed, range(16, 129, 16), strict=True))


@pytest.mark.parametrize("shape", ["path", "star", "random"])
def test_components(spark, shape):
    n = 60
    r = random.Random(3)
    edges = {"path": [(i, i + 1) for i in range(n)], "star": [(0, i) for i in range(1, n)], "random": [(r.randrange(90), r.randrange(90)) for _ in range(55)]}[shape]
    up = {v: v for e in edges for v in e}
    for _ in range(n):
        for a, b in edges:
            up[a] = up[b] = min(up[a], up[b])
    got = {x.v: x.component for x in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {v: c for v, c in up.items() if any(v in e and e[0] != e[1] for e in edges)}


def test_components_take_few_rounds_and_small_plans(spark, monkeypatch):
    """A star around its smallest vertex takes one round; the result's plan holds no plan of an earlier round, and only its own table stays."""
    rounds, kept = [], []

    def counted(df, label, **options):
        out = written(df, label, **options)
        rounds.append(label == "steps")
        kept.append(out.inputFiles()[0])
        return out

    monkeypatch.setattr(graph, "written", counted)
    star = spark.createDataFrame([(0, i) for i in range(1, 400)], "a bigint, b bigint")
    assert {x.component for x in components(star).collect()} == {0}
    assert sum(rounds) == 1
    rounds.clear()
    kept.clear()
    chain = components(spark.createDataFrame([(i, i + 1) for i in range(200)], "a bigint, b bigint"))
    assert {(x.v, x.component) for x in chain.collect()} == {(i, 0) for i in range(201)}
    assert sum(rounds) > graph.OWN_ORDER
    plan = chain._jdf.queryExecution().optimizedPlan().toString()
    assert "InMemoryRelation" not in plan and plan.count("Relation [") <= 2
    assert sum(Path(f.removeprefix("file://")).exists() for f in kept) <= 2


def expected_pages(rows):
    last = {}
    for i, _, h in rows:
        if i is not None:
            last[h or ""] = max(i, last.get(h or "", i))
    out = []
    for i, _, h in rows:
        b = (h or "").encode()
        revisit = i is not None and last[h or ""] != i
        out.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if revisit else "response", last[h or ""] if revisit else None))
    return sorted(map(repr, out))


PAGES = [(1, "u", "x" * 9000), (2, "u", "x" * 9000), (2, "u", "x" * 9000), (3, None, None), (4, "a b", ""), (None, "z", "q"), (None, "z", "q"), (None, "y", "x" * 9000), (5, "k", "é\r\n\r\nWARC/1.1\r\n" * 700), (6, "m", "solo\r\n\r\n")]


def shown(df):
    return sorted(repr((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in df.collect())


def test_archives_round_trip(spark, sf_dir):
    pages = spark.createDataFrame(PAGES, "page_id bigint, url string, html string")
    assert shown(warc.round_trip(pages)) == expected_pages(PAGES)
    real = spark.read.parquet(f"{sf_dir}/pages.parquet")
    assert shown(warc.round_trip(real)) == expected_pages([tuple(r) for r in real.select("page_id", "url", "html").collect()])
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_segments_spread_over_files(spark):
    path = f"{shared_dir(spark)}/spread-{random.random()}"
    pages = spark.createDataFrame(PAGES, "page_id bigint, url string, html string")
    warc.archive_records(pages).repartition(7).write.option("lineSep", "\r\n\r\n").text(path)
    parts = warc.read_archives(spark, path)
    assert parts.where("number > 0").count() > 0
    made = warc.reassemble(parts)
    assert shown(made) == expected_pages(PAGES) and made.where("not verified").count() == 0
    assert {bytes(r.payload) for r in made.where("record_type = 'response'").collect()} == {(h or "").encode() for _, _, h in PAGES}


def test_common_payloads_beyond_the_broadcast(spark, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST_RESPONSES", 0)
    rows = PAGES + [(100 + i, None, "") for i in range(300)] + [(1000, "r", "same")] * 40
    made = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(6)
    assert shown(warc.round_trip(made)) == expected_pages(rows)


def test_equal_records_spread_over_files(spark):
    rows = [(7, "u", "y" * 9000)] * 30 + [(8, "v", "z")] * 30
    path = f"{shared_dir(spark)}/spread-{random.random()}"
    warc.archive_records(spark.createDataFrame(rows, "page_id bigint, url string, html string")).repartition(9).write.option("lineSep", "\r\n\r\n").text(path)
    assert shown(warc.reassemble(warc.read_archives(spark, path))) == expected_pages(rows)


def test_files_are_unpacked_in_pieces():
    blocks = [bytes([97 + i % 26]) * (i * i * 7) for i in range(120)] + [random.Random(4).randbytes(3 << 20), b"", b"\r\n\r\nWARC/1.1\r\n"]
    records = [f"WARC/1.1\r\nWARC-Type: response\r\nX: {i}\r\nContent-Length: {len(b)}\r\n\r\n".encode() + b + b"\r\n\r\n" for i, b in enumerate(blocks)]
    junk = b"no record" * 30000 + b"WARC/1.0\r\nContent-Length: x\r\n\r\n"
    for data in (junk + b"".join(records), gzip.compress(junk + b"".join(records)), b"".join(map(gzip.compress, [junk, *records]))):
        got = list(warc.parse_records(data))
        assert [b for _, b in got] == blocks and [h["x"] for h, _ in got] == [str(i) for i in range(len(blocks))]
        assert sum(map(len, warc.unpacked(data))) == len(junk) + sum(map(len, records))
    cut = gzip.compress(b"".join(records[:40]))
    assert [b for _, b in warc.parse_records(cut[:-30])][:30] == blocks[:30]
    assert list(warc.parse_records(b"")) == [] and list(warc.parse_records(b"WARC/1.1\r\nno end" * 9)) == []


def test_damage_is_noticed():
    good = {"number": 1, "total": None, "kind": "response", "page_id": "1", "refers_to": None, "digest": None, "block": b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n3\r\nabc\r\n0\r\n\r\n"}
    assert warc.assemble([good])[0]["payload"] == b"abc"
    assert not warc.assemble([good | {"digest": "WRONG"}])[0]["verified"]
    assert not warc.assemble([good | {"block": good["block"][:-9]}])[0]["verified"]
    assert not warc.assemble([good | {"number": 1}, good | {"number": 3, "total": 10}])[0]["verified"]
    assert not warc.assemble([good | {"block": b"ab"}, good | {"number": 2, "block": b"c", "total": 4}])[0]["verified"]


def test_pipeline(spark, sf_dir, docs):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "decontamination", "secrets", "bpe"]
    out = corpus_pipeline.run(spark, sf_dir).collect()
    assert len(out) == len({r.doc_id for r in out})
    kept = {r.doc_id for r in out}
    links = {r.doc_id: r.class_id for r in jaccard.near_duplicates(docs).collect()}
    assert {links[i] for i in kept} == kept
    x = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        x = stage(spark, x, sf_dir)
        assert x.columns == docs.columns, name
    assert not [r for r in x.collect() if re.search(r"token\s*=\s*\"?[0-9a-f]{24}", r.text)]
