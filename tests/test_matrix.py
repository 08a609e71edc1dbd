"""The matrix kernels and what uses them: pairs with gaps and infinities, models of any width in a fixed number of scans."""

import math
from itertools import combinations

import numpy as np
import pandas as pd
import pytest

from pyspark.sql.functions import col as F_col

from tallyweave.operators import association, matrix, models
from tallyweave.plans import report

from .test_engine import frame


def gappy(seed, rows=300, columns=6, offset=0.0):
    r = np.random.default_rng(seed)
    x = r.normal(size=(rows, columns)) @ r.normal(size=(columns, columns)) + offset
    x[r.random(x.shape) < 0.15] = np.nan
    return x


@pytest.mark.parametrize("offset", [0.0, 1e9])
def test_pair_states_merge_to_pandas(offset):
    x = gappy(1, offset=offset)
    x[5:40, 2] = np.nan
    kernel = matrix.Pairs()
    parts = [kernel.of(p) for p in np.array_split(x, [1, 5, 41, 150])]
    state = parts[0]
    for p in parts[1:]:
        state = kernel.merge(state, p)
    d = pd.DataFrame(x)
    for i, j in combinations(range(x.shape[1]), 2):
        both = d[[i, j]].dropna()
        assert state["n"][i, j] == len(both) and state["low"][i, j] == both[i].min() and state["high"][j, i] == both[j].max()
        r = state["co"][i, j] / math.sqrt(state["m2"][i, j] * state["m2"][j, i])
        assert r == pytest.approx(both[i].corr(both[j]), abs=1e-6 if offset else 1e-12)


@pytest.mark.parametrize("bad", [math.inf, -math.inf, 1e300])
def test_infinite_and_overflowing_values_have_no_correlation(spark, bad):
    r = np.random.default_rng(2)
    x = r.normal(size=(40, 3))
    x[7, 1] = bad
    if bad == 1e300:
        x[9, 1] = -1e300
    d = frame(spark, a=x[:, 0].tolist(), b=x[:, 1].tolist(), c=x[:, 2].tolist())
    made = {tuple(m["vars"]): m for m in association.correlations(d, list("abc"), {})}
    for pair in (("a", "b"), ("b", "c")):
        assert math.isnan(made[pair]["extra"]["pearson_r"]) and math.isnan(made[pair]["p_raw"]) and made[pair]["effect_magnitude"] == "none"
        assert made[pair]["extra"]["spearman_rho"] == pytest.approx(pd.DataFrame(x, columns=list("abc")).rank().corr().loc[pair])
    assert made["a", "c"]["extra"]["pearson_r"] == pytest.approx(np.corrcoef(x[:, 0], x[:, 2])[0, 1])
    rec = report.analyze(spark, d, "infinite", charts=False).record
    assert not [f for f in rec["findings"] if f["family"] == "correlation" and "b" in f["vars"]]


def test_a_pair_that_is_constant_where_both_are_there(spark):
    d = frame(spark, a=[0.1] * 20 + [5.0, 7.0], b=[float(i) for i in range(20)] + [None, None])
    m = association.pair_moments(d, ["a", "b"])["a", "b"]
    assert m == {"n": 20, "r": None, "x0": 0.1, "x1": 0.1, "y0": 0.0, "y1": 19.0}
    assert association.pair_moments(d.where("a > 100"), ["a", "b"])["a", "b"]["n"] == 0


def scans(spark, monkeypatch):
    seen = []
    fold = matrix.fold
    monkeypatch.setattr(matrix, "fold", lambda df, columns, kernel, width=0: seen.append(type(kernel).__name__) or fold(df, columns, kernel, width))
    return seen


def wide_frame(spark, rows, numeric, categorical, gaps=False):
    r = np.random.default_rng(3)
    x = r.normal(size=(rows, numeric))
    x[:, 1:] += 0.3 * x[:, :1]
    d = pd.DataFrame(x, columns=[f"x{i}" for i in range(numeric)])
    if gaps:
        d.loc[r.random(rows) < 0.4, "x0"] = np.nan
        d.loc[r.random(rows) < 0.4, "x1"] = np.nan
    for k in range(categorical):
        d[f"c{k}"] = r.choice(list("pqrstu"), rows)
    return d, spark.createDataFrame(d.astype(object).where(d.notna(), None).values.tolist(), ", ".join([f"x{i} double" for i in range(numeric)] + [f"c{k} string" for k in range(categorical)]))


def reference(x, y):
    n, k = x.shape
    inv = np.linalg.pinv(x.T @ x)
    beta = inv @ x.T @ y
    e = y - x @ beta
    h = ((x @ inv) * x).sum(1)
    cov = inv @ (x.T * (e / (1 - h)) ** 2) @ x @ inv
    return beta, np.sqrt(np.diag(cov)), (e**2 * h / (1 - h) ** 2).max() / (k * (e @ e) / (n - k)), n


def test_all_models_take_two_scans_and_equal_numpy(spark, monkeypatch):
    pdf, d = wide_frame(spark, 400, 12, 3)
    seen = scans(spark, monkeypatch)
    made, terms = models.regressions(d, [f"x{i}" for i in range(12)], ["c0", "c1", "c2"], 400, charts=False)
    assert seen == ["Scatter", "Residuals"]
    dummies = np.column_stack([pdf[f"c{k}"] == v for k in range(3) for v in "qrstu"]).astype(float)
    for y in ("x0", "x7"):
        others = [f"x{i}" for i in range(12) if f"x{i}" != y]
        beta, se, cook, n = reference(np.column_stack([np.ones(400), pdf[others], dummies]), pdf[y].to_numpy())
        own = [t for t in terms if t["vars"][0] == y]
        assert [t["vars"][1] for t in own][:11] == others and own[11]["vars"][1] == "c0=q"
        assert [t["extra"]["estimate"] for t in own] == pytest.approx(beta[1:], rel=1e-8)
        assert [t["extra"]["std_error"] for t in own] == pytest.approx(se[1:], rel=1e-8)
        assert next(m for m in made if m["vars"] == [y])["extra"]["cooks_max"] == pytest.approx(cook, rel=1e-8)


def test_the_number_of_jobs_does_not_grow_with_the_columns(spark):
    def jobs(columns):
        _, d = wide_frame(spark, 300, columns, 2)
        d = d.coalesce(2)
        group = f"width {columns}"
        spark.sparkContext.setJobGroup(group, group)
        try:
            models.regressions(d, [f"x{i}" for i in range(columns)], ["c0", "c1"], 300, charts=False)
            association.pair_moments(d, [f"x{i}" for i in range(columns)])
        finally:
            spark.sparkContext.setJobGroup("", "")
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    assert jobs(3) == jobs(30) <= 10  # a job for each exchange of at most four scans


def test_thinned_models_share_their_scans(spark, monkeypatch):
    pdf, d = wide_frame(spark, 60, 14, 1, gaps=True)
    seen = scans(spark, monkeypatch)
    made, terms = models.regressions(d, [f"x{i}" for i in range(14)], ["c0"], 60, charts=False)
    assert seen == ["Scatter", "Pairs", "Scatter", "Residuals"]
    y = "x5"
    own = [t for t in terms if t["vars"][0] == y]
    names = [t["vars"][1] for t in own]
    strength = pdf[[f"x{i}" for i in range(14)]].corr()[y].drop(y).abs().sort_values(ascending=False)
    assert names == list(strength.index[: len(names)]) and next(m for m in made if m["vars"] == [y])["extra"]["note"]
    rows = pdf[[y, *names]].dropna()
    beta, se, *_ = reference(np.column_stack([np.ones(len(rows)), rows[names]]), rows[y].to_numpy())
    assert [t["extra"]["estimate"] for t in own] == pytest.approx(beta[1:], rel=1e-8) and [t["extra"]["std_error"] for t in own] == pytest.approx(se[1:], rel=1e-8)
    assert next(m for m in made if m["vars"] == [y])["n"] == len(rows)


def test_infinite_values_leave_no_model(spark):
    r = np.random.default_rng(4)
    x = r.normal(size=(60, 3))
    x[3, 0] = math.inf
    made, terms = models.regressions(frame(spark, a=x[:, 0].tolist(), b=x[:, 1].tolist(), c=x[:, 2].tolist()), list("abc"), [], 60, charts=False)
    assert [m["kind"] for m in made] == ["insufficient"] * 3 and not terms


@pytest.mark.parametrize("cells", [4_000_000, 0, 100])
@pytest.mark.parametrize("patterns", ["few", "many", "none"])
def test_rank_correlations_by_pattern(spark, cells, patterns, monkeypatch):
    monkeypatch.setattr(association, "BROADCAST_CELLS", cells)
    r = np.random.default_rng(8)
    d = pd.DataFrame({f"x{i}": r.integers(0, 8 + 12 * i, 500).astype(float) for i in range(11)})
    d["x3"] += 2 * d["x0"]
    d["x4"] = 7.0
    d.loc[::5, "x5"] = -0.0
    gone = {"none": np.zeros((500, 11), bool), "few": np.array([[1, 1, 0, 0, 0, 0, 0, 1, 0, 0, 0], [0] * 11, [0, 0, 1, 1, 1, 1, 1, 0, 1, 1, 0]], bool)[r.integers(0, 3, 500)], "many": r.random((500, 11)) < 0.25}[patterns]
    gone[:, 10] = False
    d = d.mask(gone)
    frame_ = spark.createDataFrame(d.astype(object).where(d.notna(), None).values.tolist(), ", ".join(f"`{c}` double" for c in d)).repartition(3)
    for (a, b), (n, rho) in association.rank_correlations(frame_, list(d)).items():
        both = d[[a, b]].dropna()
        assert n == len(both)
        if n < 2 or both[a].nunique() < 2 or both[b].nunique() < 2:
            assert rho is None
        else:
            assert rho == pytest.approx(both.rank().corr().iloc[0, 1], abs=1e-11)


def test_the_state_grows_with_the_patterns_that_occur(spark, monkeypatch):
    seen = []
    fold = matrix.fold
    monkeypatch.setattr(matrix, "fold", lambda df, columns, kernel, width=0: seen.append((type(kernel).__name__, width)) or fold(df, columns, kernel, width))
    d = spark.range(60).selectExpr(*(f"IF(id % 2 = 0, NULL, double(id * {i + 1} % 17)) AS x{i}" for i in range(12)), "double(id) AS whole")
    association.rank_correlations(d, [f"x{i}" for i in range(12)] + ["whole"])
    association.rank_correlations(d.select("whole", (F_col("whole") * 2).alias("twice")), ["whole", "twice"])
    assert [w for name, w in seen if name == "RankProducts"] == [2, 1]
