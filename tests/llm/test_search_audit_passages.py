"""Ranked search, filter audit and passage quality against brute force, a held-out share, and odd rows."""

import math
import random
import re
from collections import Counter
from itertools import combinations, permutations

import duckdb
import numpy as np
import pytest

from tallyweave.llm import audit, oracle, passages, queries, search
from tallyweave.llm import textbytes as tb

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_search(docs, items, k):
    """Every document scored for every item: (item_id, rank, doc_id, score), rows in any order."""
    counted = [(d, Counter(terms(t))) for d, t in docs]
    counted = [(d, c, sum(c.values())) for d, c in counted if c]
    n_docs, n_terms = len(counted), sum(n for *_, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    out = []
    for item, text in items:
        asked = Counter(terms(text))
        scored = []
        for d, c, n in counted:
            m = 75 + 25 * n * n_docs // n_terms
            s = sum(q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 12 * m)) for t, q in asked.items() if t in c)
            if s > 0:
                scored.append((-s, d is None, d or 0, d))
        out += [(item, rank, d, -s) for rank, (s, _, _, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def found(df):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def library():
    r = random.Random(7)
    vocabulary = [f"w{int(r.paretovariate(0.6))}" for _ in range(400)]
    docs = [(i, " ".join(r.choice(vocabulary) for _ in range(r.choice([0, 3, 30, 200])))) for i in range(300)]
    docs += [(1000 + i, docs[5][1]) for i in range(60)] + [(2000, None), (2001, "?!"), (None, docs[9][1]), (None, docs[9][1]), (7, docs[9][1])]
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(r.choice([1, 5, 40])))) for i in range(25)] + [(3, "w1 w1 w2"), (None, "W3, w4!"), (90, None), (91, "none of these"), (92, docs[5][1])]
    return docs, items


@pytest.mark.parametrize("postings,block_bytes", [(2 << 20, 4 << 20), (500, 4 << 20), (3000, 700)])
def test_search(spark, library, postings, block_bytes):
    docs, items = library
    d, i = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3), spark.createDataFrame(items, "item_id bigint, text string")
    assert found(search.search(d, i, 20, block_bytes, postings)) == brute_search(docs, items, 20)
    assert found(search.search(d, i, 3, block_bytes, postings)) == brute_search(docs, items, 3)


def test_search_on_odd_rows_and_empty_tables(spark, odd):
    items = spark.createDataFrame([(1, "hello token 123"), (2, None), (2, "")], "item_id bigint, text string")
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert found(search.search(odd, items)) == brute_search(rows, [(1, "hello token 123")], 20)
    assert found(search.search(odd.limit(0), items)) == [] and found(search.search(odd, items.limit(0))) == []


@pytest.mark.parametrize("step,most", [(1, 4), (2, 5), (8, 48)])
def test_block_borders_are_the_cheapest(step, most, monkeypatch):
    monkeypatch.setattr(search, "STEP", step)
    monkeypatch.setattr(search, "SHORT_LIST", 0 if step > 1 else 1000)
    monkeypatch.setattr(search, "MOST_STEPS", most)
    r = np.random.default_rng(1)
    lists = [r.integers(1, 100, n) for n in (0, 1, 7, 12, 0, 12, 3)]
    impacts, first = np.concatenate(lists), np.concatenate(([0], np.cumsum([len(x) for x in lists])))
    ends, blocks = search.block_ends(impacts, first)
    for k, own in enumerate(lists):
        mine = ends[blocks[k] : blocks[k + 1]] - first[k]
        assert (len(own) == 0) == (len(mine) == 0)
        if not len(own):
            continue
        charge = search.BLOCK_CHARGE * own.std() + 1e-9
        cost = lambda cuts: sum((b - a) * own[a:b].max() + charge for a, b in zip([0, *cuts], cuts, strict=False))
        inner = range(step, len(own), step)
        every = [[*c, len(own)] for m in range(len(inner) + 1) for c in combinations(inner, m)]
        allowed = [c for c in every if max(b - a for a, b in zip([0, *c], c, strict=False)) <= step * most]
        assert mine[-1] == len(own) and list(mine) in allowed
        assert cost(mine.tolist()) == pytest.approx(min(map(cost, allowed)))


def test_ranges_bound_every_score_and_skip():
    r = np.random.default_rng(2)
    n_docs, n_terms = 4000, 6
    doc = np.concatenate([np.sort(r.choice(n_docs, n, False)) for n in (2000, 900, 300, 60, 5, 0)])
    term = np.repeat(np.arange(n_terms), (2000, 900, 300, 60, 5, 0))
    order = np.argsort(doc, kind="stable")
    impact = (r.pareto(2, len(doc)) * 1000).astype(np.int64) + 1
    shard = search.Shard(n_docs, doc[order], term[order], impact[order], n_terms)
    asked, weights = np.array([0, 1, 3, 4]), np.array([3, 2, 7, 9])
    low, high, bound = shard.ranges(asked, weights)
    assert (low[1:] >= high[:-1]).all()
    whole = np.zeros(n_docs, np.int64)
    for t, w in zip(asked, weights, strict=True):
        whole[doc[term == t]] += w * impact[term == t]
    covered = np.zeros(n_docs, np.int64)
    for a, b, u in zip(low, high, bound, strict=True):
        covered[a:b] = u
    assert (whole <= covered).all()
    top = search.Top(10)
    scored = shard.best(asked, weights, top, np.arange(n_docs))
    assert top.scores.tolist() == sorted(whole.tolist(), reverse=True)[:10] and not shard.scores.any()
    assert scored < (whole > 0).sum() / 2  # the others were skipped by their bounds
    again = search.Top(10)
    again.add(np.arange(10), np.full(10, int(top.scores[-1]) + 1), np.arange(9000, 9010))  # a threshold from an earlier shard
    assert shard.best(asked, weights, again, np.arange(n_docs)) <= scored
    assert again.scores.tolist() == sorted([*whole.tolist(), *[int(top.scores[-1]) + 1] * 10], reverse=True)[:10]


def brute_audit(docs, labels):
    """Every document sent through every order of the filters."""
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    first = {}
    for d, t, _ in docs:
        if d is not None:
            first[t or ""] = min(d, first.get(t or "", d))
    flags = []
    for d, t, source in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        bad = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": d is not None and first[t] < d}
        flags.append((source or "", bad, d in good, d in toxic))
    out = {}
    for part in {p for p, *_ in flags}:
        own = [f for f in flags if f[0] == part]
        removed_in = Counter()
        for order in permutations("ABCDE"):
            here, gone = own, []
            for step, f in enumerate(order, 1):
                lost = [x for x in here if x[1][f]]
                redundant = sum(x[1][f] for x in gone)
                here, gone = [x for x in here if not x[1][f]], gone + lost
                removed_in[f] += len(lost)
                alone = sum(x[1][f] and sum(x[1].values()) == 1 for x in own)
                out[part, "".join(order), step] = [len(here), len(lost), redundant, alone, sum(x[2] for x in lost), sum(x[3] for x in lost)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(removed_in[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def audited(df):
    rows = df.collect()
    got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in rows}
    assert len(got) == len(rows)
    return got


def test_audit(spark):
    r = random.Random(3)
    make = lambda: " ".join(r.choice(["word", "Word", "LOUD", "a|b", "x#", "é", *(f"v{k}" for k in range(60))]) for _ in range(r.choice([0, 10, 49, 50, 80])))
    texts = [make() for _ in range(40)] + [None, "", "A" * 3 + "b" * 57]
    docs = [(r.choice([None, *range(60)]), r.choice(texts), r.choice(["s1", "s2", None, ""])) for _ in range(200)]
    docs += docs[:20]
    labels = [(r.choice([None, *range(70)]), r.choice([0, 1, None]), r.choice([0, 1, None])) for _ in range(60)]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, source string").repartition(3)
    assert audited(audit.audit(d, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))) == brute_audit(docs, labels)


def test_audit_of_odd_rows_and_empty_tables(spark, odd):
    labels = spark.createDataFrame([(1, 1, None), (1, 0, 1), (None, 1, 1)], "doc_id bigint, quality int, toxic int")
    rows = [(r.doc_id, r.text, r.source) for r in odd.collect()]
    assert audited(audit.audit(odd, labels)) == brute_audit(rows, [tuple(x) for x in labels.collect()])
    assert audit.audit(odd.limit(0), labels).count() == 0
    assert {v[4:6] for v in audited(audit.audit(odd, labels.limit(0))).values()} == {(0, 0)}


def brute_features(text):
    """A passage's features, byte by byte and word by word."""
    data = (text or "").encode()
    found = [(m.start(), m.end()) for m in re.finditer(rb"[^\x20\x09-\x0D]+", data)]
    out = []
    for k in range(0, len(found), passages.PASSAGE_WORDS):
        own = found[k : k + passages.PASSAGE_WORDS]
        end = found[k + len(own)][0] if k + len(own) < len(found) else len(data)
        kinds = [int(passages._KIND[b]) for b in data[own[0][0] : end + 1]]
        pairs = np.zeros((passages.KINDS, passages.KINDS))
        for a, b in zip(kinds, kinds[1:], strict=False):
            pairs[a, b] += 1
        words = [data[a:b] for a, b in own]
        before = [data[a:b] for a, b in found[k - 1 : k]] if k else []
        again = sum(x == y for x, y in zip([*before, *words], [*before, *words][1:], strict=False))
        out.append([*np.sqrt(pairs.ravel() / max(1, pairs.sum())), len(set(words)) / len(words), again / len(words), sum(min(40, len(w)) for w in words) / len(words) / 10])
    return np.array(out).reshape(-1, passages.FEATURES)


def test_passage_features_and_scores_against_loops():
    r = random.Random(5)
    texts = ["", "one", None, "  lead and trail \n", " ".join(r.choice(["Ab", "cd", "É9", "x|", "!!"]) for _ in range(300)), "a " * 65]
    texts = [t for t in texts if t is not None]
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.concatenate(([0], np.cumsum([len(t.encode()) for t in texts])))
    # a text at a time, since the byte after a text's end belongs to the next text
    model = passages.AttentionModel()
    model.trained = True
    for t in texts:
        b = np.frombuffer(t.encode(), np.uint8)
        x, first = passages.features(b, np.array([0, len(b)]))
        assert np.allclose(x, brute_features(t), atol=1e-6) and first[-1] == len(x)
        if not len(x):
            assert model.score_block(b, np.array([0, len(b)])).tolist() == [0.0]
            continue
        w = model.w
        h = [np.tanh(v @ w["encode"] + w["shift"]) for v in x]
        e = [float((np.tanh(v @ w["v"]) / (1 + np.exp(-(v @ w["u"])))) @ w["gate"]) for v in h]
        z = sum(math.exp(g) * v for g, v in zip(e, h, strict=True)) / sum(map(math.exp, e))
        assert model.score_block(b, np.array([0, len(b)]))[0] == pytest.approx(1 / (1 + math.exp(-float(z @ w["out"] + w["bias"][0]))))
    assert passages.features(raw, offsets)[1].tolist() == [0, 0, 1, 2, 7, 9]


def test_attention_gradients_are_right():
    r = np.random.default_rng(6)
    model = passages.AttentionModel()
    x, first = r.normal(size=(9, passages.FEATURES)), np.array([0, 4, 4, 9])
    y, weights = np.array([1.0, 0.0, 0.0]), np.array([1.0, 2.0, 0.5])

    def loss():
        p = 1 / (1 + np.exp(-model.forward(x, first)["logit"]))
        return float(-(weights * (y * np.log(p) + (1 - y) * np.log(1 - p))).mean())

    got = model.gradients(x, first, y, weights)
    for name, value in model.w.items():
        at = tuple(s // 2 for s in value.shape)
        kept = value[at]
        value[at] = kept + 1e-6
        up = loss()
        value[at] = kept - 1e-6
        down = loss()
        value[at] = kept
        assert got[name][at] == pytest.approx((up - down) / 2e-6, rel=1e-4, abs=1e-9)


def test_held_out_quality(spark):
    sf = "/root/testdata/sf0.01"
    labels = dict(duckdb.sql(f"SELECT doc_id, quality FROM '{sf}/labels.parquet'").fetchall())
    rows = [r for r in queries.op13_attention_quality(spark, sf).collect() if r.held_out and r.doc_id in labels]
    assert sum(r.predicted == labels[r.doc_id] for r in rows) / len(rows) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)


def test_quality_of_odd_rows_and_empty_tables(spark, odd, docs, sf_dir):
    from pyspark.sql import functions as F

    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = passages.learn(docs, labels, F.lit(True))
    rows = passages.score(odd, model).collect()
    assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in odd.select("doc_id").collect())
    by = {r.text: p.score for r, p in zip(odd.collect(), rows, strict=True)}
    assert by[None] == by[""] == 0.0 and all(0 < v <= 1 for t, v in by.items() if t)
    assert len({p.score for r, p in zip(odd.collect(), rows, strict=True) if r.doc_id == 1}) == 1
    assert passages.score(odd.limit(0), model).count() == 0
    nothing = passages.learn(docs, labels.limit(0), F.lit(True))
    one = passages.learn(docs, labels.where("quality = 1"), F.lit(True))
    assert {r.score for m in (nothing, one) for r in passages.score(odd, m).collect()} == {0.0}


@pytest.mark.parametrize("name", ["op11_vbm_wand", "op12_filter_audit"])
def test_queries_equal_their_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = queries.queries()[name](spark, sf_dir)
    expected = con.sql(oracle.SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(expected.columns)
    at = [expected.columns.index(c) for c in columns]
    assert Counter(tuple(r[c] for c in columns) for r in df.collect()) == Counter(tuple(r[i] for i in at) for r in expected.fetchall())


def test_terms_are_those_of_the_pattern():
    text = "Ab-9é_X　y\x00z{q}~`w"
    raw = np.frombuffer(text.encode(), np.uint8)
    w = tb.Words(raw, np.array([0, len(raw)]), tb.ALNUM, tb.FOLDED)
    assert [bytes(raw[a:b]).decode().lower() for a, b in zip(w.starts, w.ends, strict=True)] == [t.lower() for t in TERM.findall(text)]
