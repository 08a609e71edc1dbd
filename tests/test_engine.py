"""The statistical engine on frames with planted effects, gaps and oddities."""

import json
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyweave.functions.text import identifier_name
from tallyweave.operators import association, catalog, findings, modelling, models, quality, results, series
from tallyweave.plans import report
from tallyweave.sources.frames import BadInput, from_csv, from_dataframe, running_ranks


def draw():
    return np.random.default_rng(20260902)


def frame(spark, **columns):
    pdf = pd.DataFrame(columns)
    return spark.createDataFrame([tuple(None if v is None or isinstance(v, float) and math.isnan(v) else v for v in row) for row in pdf.astype(object).itertuples(index=False)], list(columns))


@pytest.fixture(scope="module")
def linear(spark):
    r = draw()
    x1, x2 = r.normal(size=200), r.normal(size=200)
    return frame(spark, x1=x1.tolist(), x2=x2.tolist(), y=(2 * x1 + r.normal(size=200)).tolist())


@pytest.fixture(scope="module")
def messy(spark):
    r = draw()
    n = 40
    rows = [[i + 1, ["north", "south", "east"][i % 3], "k", f"{1000 + 7 * i:,}", float(r.normal(50, 5))] for i in range(n)]
    rows[6][4] = rows[8][4] = None
    rows[11][1] = None
    rows[39][4] = 100000.0
    rows.append(list(rows[0]))
    return spark.createDataFrame(rows, "user_id int, region string, constant string, amount string, value double").coalesce(1)


def test_identifier_names():
    assert all(map(identifier_name, ("id", "user_id", "userId", "Account No", "body mass index", "UUID")))
    assert not any(map(identifier_name, ("video", "paid", "width", "idea")))


def test_types_of_a_messy_frame(messy):
    types = {p.name: (p.type, p.exclude_reason, p.coerced_from_text) for p in catalog.profile(from_dataframe(messy))[1]}
    assert types == {"user_id": ("excluded", "id-like", False), "region": ("categorical", None, False), "constant": ("excluded", "constant", False), "amount": ("numeric", None, True), "value": ("numeric", None, False)}


def test_issues_and_their_places(messy):
    f = from_dataframe(messy, rows=True)
    n, columns = catalog.profile(f)
    issues = quality.issues_of(f, n, columns)
    kinds = {i["kind"] for i in issues}
    assert {"missing_column", "missing_rows", "duplicate_rows", "constant_column", "coerced_type", "extreme_values"} <= kinds
    extreme = next(i for i in issues if i["kind"] == "extreme_values" and i["column"] == "value")
    assert extreme["locations"] == [{"row": 40, "id": "40", "value": 100000.0}]
    gaps = next(i for i in issues if i["kind"] == "missing_column" and i["column"] == "value")
    assert [p["row"] for p in gaps["locations"]] == [7, 9]
    assert [i["severity"] for i in issues] == sorted((i["severity"] for i in issues), key=quality.ORDER.get)
    assert 0 <= quality.score_of(issues) <= 100


def test_linear_effect_is_found(spark, linear):
    r = report.analyze(spark, linear, "linear")
    top = [f for f in r.record["findings"] if f["family"] == "correlation"]
    assert [f["vars"] for f in top] == [["x1", "y"]] and top[0]["effect_value"] > 0.7 and top[0]["q_value"] < 0.01
    coefficient = next(c for c in r.record["all_results"]["regression_coefficients"] if c["vars"] == ["y", "x1"])
    assert coefficient["extra"]["estimate"] == pytest.approx(2, abs=0.3)
    partial = next(c for f in r.record["findings"] if f["vars"] == ["y", "x1"] for c in f["charts"] if c["type"] == "added_variable")
    assert partial["slope"] == pytest.approx(coefficient["extra"]["estimate"], abs=1e-6)
    assert json.loads(r.to_json())["meta"]["n_rows"] == 200
    assert "## Findings" in r.markdown and "## Methods" in r.markdown


def test_least_squares_equals_numpy(spark, linear):
    pdf = linear.toPandas()
    x = np.column_stack([np.ones(200), pdf.x1, pdf.x2])
    f = models.fit(models.design(linear, "y", ["x1", "x2"], []))
    beta = np.linalg.lstsq(x, pdf.y, rcond=None)[0]
    e = pdf.y.to_numpy() - x @ beta
    inv = np.linalg.inv(x.T @ x)
    h = ((x @ inv) * x).sum(1)
    cov = inv @ (x.T * (e / (1 - h)) ** 2) @ x @ inv
    assert np.allclose(f.beta, beta) and np.allclose(f.se, np.sqrt(np.diag(cov)))
    s2 = (e**2).sum() / 197
    assert f.cooks_max == pytest.approx((e**2 / (3 * s2) * h / (1 - h) ** 2).max())
    u = e**2
    fit = x @ np.linalg.lstsq(x, u, rcond=None)[0]
    assert f.bp == pytest.approx(200 * (1 - ((u - fit) ** 2).sum() / ((u - u.mean()) ** 2).sum()))
    vif = [1 / (1 - (np.dot(pdf[a], pdf[b]) ** 2) / (np.dot(pdf[a], pdf[a]) * np.dot(pdf[b], pdf[b]))) for a, b in (("x1", "x2"),)]
    assert f.vif_max == pytest.approx(vif[0])


def test_perfect_collinearity_is_reported_not_raised(spark):
    d = frame(spark, a=list(range(12)), b=[2 * i for i in range(12)], c=["red", "blue"] * 6)
    r = report.analyze(spark, d, "exact")
    assert r.record["all_results"]["correlations"][0]["effect_value"] == pytest.approx(1)
    json.loads(r.to_json())


def test_group_effect(spark):
    r = draw()
    g = ["A" if i % 2 else "B" for i in range(150)]
    score = [float(r.normal() + (v == "B")) for v in g]
    made = association.group_differences(frame(spark, group=g, score=score, noise=["xyz"[i % 3] for i in range(150)]), ["score"], ["group", "noise"])
    by = {x["vars"][1]: x for x in made}
    assert abs(by["group"]["effect_value"]) >= 0.5 and by["group"]["p_raw"] < 0.01 and by["group"]["extra"]["higher_group"] == "B"
    assert by["noise"]["kind"] == "anova" and by["noise"]["effect_magnitude"] in ("none", "small")


def test_contingency_and_fisher(spark):
    r = draw()
    color = [["red", "blue"][int(v)] for v in r.integers(0, 2, 300)]
    shape = ["circle" if r.random() < (0.85 if c == "red" else 0.15) else "square" for c in color]
    row = association.contingency(frame(spark, color=color, shape=shape), ["color", "shape"])[0]
    assert row["effect_value"] >= 0.3 and row["p_raw"] < 0.01 and row["kind"] == "chi_square"
    few = association.contingency(frame(spark, a=["u"] * 3 + ["v"] * 9, b=["x"] * 2 + ["y"] * 10), ["a", "b"])[0]
    assert few["kind"] == "fisher_exact" and few["assumptions"][0]["critical"]


def test_noise_gives_nothing(spark):
    r = draw()
    rec = report.analyze(spark, frame(spark, **{f"v{i}": r.normal(size=120).tolist() for i in range(5)}), "noise", charts=False).record
    assert not rec["findings"] and not rec["needs_review"]


def test_q_values(spark):
    p = [0.001, 0.04, 0.03, 0.2, None, 0.005]
    rows = [results.result("correlation", "pearson", ["a", str(i)], 20, 0.1, float("nan") if v is None else v, "r", 0.4) for i, v in enumerate(p)]
    q = [r["q_value"] for r in findings.with_q(results.as_frame(spark, rows)).orderBy("seq").collect()]
    assert q == [pytest.approx(v) if v else None for v in (0.005, 0.05, 0.05, 0.2, None, 0.0125)]


def test_critical_assumptions_go_to_review(spark):
    bad = [results.Assumption("x", False, "d", True)]
    rows = [results.result("correlation", "pearson", ["a", "b"], 20, 0.5, 1e-6, "r", 0.4), results.result("correlation", "pearson", ["a", "c"], 20, 0.9, 1e-6, "r", 0.9, assumptions=bad), results.result("correlation", "pearson", ["b", "c"], 20, 0.7, 1e-6, "r", 0.7)]
    got = {tuple(r["vars"]): (r["route"], r["rank"]) for r in findings.candidates(findings.with_q(results.as_frame(spark, rows))).collect()}
    assert got == {("b", "c"): ("finding", 1), ("a", "b"): ("finding", 2), ("a", "c"): ("needs_review", None)}


@pytest.mark.parametrize("value,size", [(0.0999, "none"), (0.1, "small"), (0.3, "medium"), (-0.5, "large"), (None, "none"), (float("nan"), "none"), (float("inf"), "none")])
def test_magnitude_boundaries(value, size):
    assert results.magnitude("r", value) == size


def test_ranks_are_average_ranks(spark):
    values = {"a": [3.0, 1.0, 3.0, 2.0, 3.0, 2.0], "b": [5.0, -1.0, 5.0]}
    freq = spark.createDataFrame([(k, v) for k, own in values.items() for v in own], "k string, v double").groupBy("k", "v").agg(F.count(F.lit(1)).alias("n"))
    got = {(r["k"], r["v"]): r["r_n"] for r in running_ranks(freq, ["k"], "v", ["n"]).collect()}
    assert got == {(k, v): x for k, own in values.items() for v, x in pd.Series(own).rank().groupby(own).first().to_dict().items()}


@pytest.mark.parametrize("cells", [4_000_000, 0])
def test_rank_correlations_with_gaps(spark, cells, monkeypatch):
    monkeypatch.setattr(association, "BROADCAST_CELLS", cells)
    r = np.random.default_rng(5)
    d = pd.DataFrame({c: r.integers(0, 30, 400).astype(float) for c in "abcd"})
    d["c"] += d["a"] * 2
    d.loc[r.random(400) < 0.2, "b"] = np.nan
    d.loc[r.random(400) < 0.3, "c"] = np.nan
    got = association.rank_correlations(spark.createDataFrame(d), list("abcd"))
    plain = association.pair_moments(spark.createDataFrame(d).replace(float("nan"), None), list("abcd"))
    for (x, y), (n, rho) in got.items():
        both = d[[x, y]].dropna()
        assert n == len(both) == plain[x, y]["n"]
        assert rho == pytest.approx(both.rank().corr().iloc[0, 1], abs=1e-12) and plain[x, y]["r"] == pytest.approx(both.corr().iloc[0, 1], abs=1e-12)


def test_equal_levels_come_in_order_of_appearance(spark):
    d = spark.createDataFrame([("z", 1.0), ("a", 2.0), ("z", 3.0), ("a", 5.0), ("z", 1.5), ("a", 2.5)], "g string, x double").coalesce(1)
    assert list(association.level_moments(d, ["x"], "g")["x"]) == ["z", "a"]


def test_histogram_counts_every_value_once(spark):
    d = spark.createDataFrame([(float(v),) for v in [*range(50), 10000]], "x double")
    h = series.histograms(d, {"x": F.col("x")})["x"]
    assert sum(h["counts"]) + h["n_below"] + h["n_above"] == 51 and h["bin_edges"][-1] < 10000 and h["n_above"] == 1
    constant = series.histograms(d.select(F.lit(3.0).alias("x")), {"x": F.col("x")})["x"]
    assert constant["counts"] == [51]
    assert series.histograms(d.limit(3), {"x": F.col("x")})["x"] is None


def test_draws_do_not_depend_on_partitions(spark):
    d = spark.range(1000)
    a, b = (sorted(r[0] for r in series.drawn(d.repartition(n), 50, F.col("id")).collect()) for n in (1, 7))
    assert a == b and len(a) == 50


def test_influence_keeps_the_largest(spark):
    d = spark.range(800).select("id", F.when(F.col("id") == 400, 5.0).otherwise(F.rand(1) / 1000).alias("d"))
    s = series.influence_series(d, F.col("d"), F.col("id"))
    assert [400, 5.0] in s["points"] and s["max"] == 5.0 and len(s["points"]) <= 420


def test_imputation_and_twins(spark):
    d = spark.createDataFrame([(1.0, "b"), (None, "a"), (3.0, None), (10.0, "a"), (2.0, "b")], "x double, c string")
    assert modelling.fill_values(d, ["x"], ["c"]) == {"x": 2.5, "c": "a"}
    assert modelling.imputed(d, ["x"], ["c"]).where("x is null or c is null").count() == 0


def test_odd_frames(spark):
    odd = spark.createDataFrame([(float("nan"), None, "a|b"), (float("inf"), None, "c d")] * 6, "`a.b` double, `c|d` string, `e f` string")
    text = report.analyze(spark, odd, "odd").markdown
    assert "12 rows" in text
    json.loads(report.analyze(spark, spark.range(1).toDF("only")).to_json())
    with pytest.raises(BadInput):
        report.analyze(spark, spark.createDataFrame([], "x double"))


def test_dates_and_truth_values(spark):
    from tallyweave.functions.text import looks_dated
    from tallyweave.operators.modelling import category

    yes = ["2024-01-02T03:04:05.123Z", "2024-01-02 03:04:05+01:00", "2024-01-02", "3 Jan 2024", "January 3, 2024", "2024/01/02", "02.01.2024"]
    no = ["soon", "12", "2024-13-02", "3 Foo 2024", "1.5"]
    d = spark.createDataFrame([(v,) for v in yes + no], "t string")
    assert [r[0] for r in d.select(looks_dated(F.col("t"))).collect()] == [True] * len(yes) + [False] * len(no)
    assert [r[0] for r in spark.createDataFrame([(True,), (False,), (None,)], "b boolean").select(category(F.col("b"))).collect()] == ["True", "False", None]


def test_report_tables_are_written(spark, linear, tmp_path):
    report.analyze(spark, linear, "linear", rows=False, charts=False).write(f"file://{tmp_path}/out")
    assert spark.read.parquet(f"file://{tmp_path}/out/results").count() == 12


def test_markdown_tables_escape_cells():
    assert report._table(["a|b", "c\n d"], [[None, "x\\|y"], [1.5, ""]]) == ["| a\\|b | c d |", "| --- | --- |", "| – | x\\\\\\|y |", "| 1.5 |  |"]


def test_first_rows_of_every_issue_in_one_scan(spark):
    d = spark.range(200).selectExpr("CAST(id AS STRING) AS name", "IF(id % 3 = 0, NULL, id) AS a", "IF(id = 150, 1e9, CAST(id % 7 AS DOUBLE)) AS b").repartition(4)
    f = from_dataframe(d, rows=True, order=["name"])
    order = sorted(range(200), key=str)
    got = quality.located(f, {"a": (F.col("a").isNull(), None), "b": (F.col("b") > 100, F.col("b")), "none": (F.lit(False), None)}, "name")
    gone = [(k + 1, str(i)) for k, i in enumerate(order) if i % 3 == 0]
    assert got["a"][0] == len(gone) and [(p["row"], p["id"]) for p in got["a"][1]] == gone[:15]
    assert got["b"] == (1, [{"row": order.index(150) + 1, "id": "150", "value": 1e9}]) and got["none"] == (0, [])


@pytest.mark.parametrize("weak", [False, True])
def test_duplicates_do_not_rest_on_their_hashes(spark, weak):
    d = spark.range(300).selectExpr("id % 90 AS a", "IF(id % 90 = 3, NULL, 'x') AS b", "IF(id < 200, CAST(id % 2 AS DOUBLE), -0.0) AS c", "array(id % 3) AS e")
    hashes = (lambda c: [F.abs(F.hash(*c)) % 4]) if weak else quality._fingerprints
    expected = d.toPandas().assign(e=lambda x: x["e"].map(str), b=lambda x: x["b"].fillna("")).duplicated(keep=False).sum()
    assert quality.duplicate_rows(d, d.columns, hashes).first()[0] == expected


def test_missingness_of_all_columns_equals_one_by_one(spark):
    r = np.random.default_rng(12)
    n = 400
    x, y = r.normal(size=n), r.normal(size=n)
    g = r.choice(list("pq"), n)
    z = np.where(x > 0.8, np.nan, r.normal(size=n))
    h = np.where((g == "p") & (r.random(n) < 0.5), None, r.choice(list("uvw"), n))
    f = from_dataframe(frame(spark, x=x.tolist(), y=y.tolist(), g=g.tolist(), z=z.tolist(), h=h.tolist()))
    columns = catalog.profile(f)[1]
    got = quality.missingness(f, ["z", "h"], columns)
    assert got["z"][0] == "x" and got["h"][0] == "g"
    a, b = x[np.isnan(z)], x[~np.isnan(z)]
    assert got["z"][1] == pytest.approx(quality.welch(len(a), a.mean(), a.var(ddof=1), len(b), b.mean(), b.var(ddof=1))[2], rel=1e-9)
    counts = pd.crosstab(pd.Series(h).isna().astype(int), g)
    table = {(i, v): int(counts.loc[i, v]) for i in counts.index for v in counts.columns}
    assert got["h"][1] == pytest.approx(association.chi_square_of(table)["p"], rel=1e-12)


def test_tables_of_all_pairs(spark):
    r = np.random.default_rng(13)
    d = pd.DataFrame({c: r.choice([*v, None], 300) for c, v in (("a", "xy"), ("b", "pqr"), ("c", "k"))})
    got = association.tables(frame(spark, **{c: d[c].tolist() for c in d}), list("abc"))
    for (a, b), t in got.items():
        assert t == {k: int(n) for k, n in d.dropna(subset=[a, b]).groupby([a, b]).size().items()}


@pytest.mark.parametrize("gaps", [("x1",), ("g0",), ("x0", "g1")])
def test_the_filled_copy_repeats_only_what_filling_changes(spark, gaps, monkeypatch):
    r = np.random.default_rng(14)
    n = 150
    d = pd.DataFrame({f"x{i}": r.normal(size=n) for i in range(4)} | {f"g{i}": r.choice(list("pqr"), n) for i in range(3)})
    d["x1"] += d["x0"]
    d = d.astype(object)
    for c in gaps:
        d.loc[r.random(n) < 0.2, c] = None
    numeric, categorical = [f"x{i}" for i in range(4)], [f"g{i}" for i in range(3)]
    f = frame(spark, **{c: d[c].tolist() for c in d})
    assert modelling.gappy(f) == set(gaps)
    before = report.sweep(f, numeric, categorical, {}, n, False)
    filled = modelling.imputed(f, numeric, categorical)
    whole = report.sweep(filled, numeric, categorical, {}, n, False)
    tested = []
    group = association.group_differences
    monkeypatch.setattr(association, "group_differences", lambda df, a, b: tested.append((a, b)) or group(df, a, b))
    got = report.sweep_of_filled(filled, numeric, categorical, {}, n, set(gaps), before)
    assert [(r["family"], r["kind"], r["vars"], r["n"]) for r in got] == [(r["family"], r["kind"], r["vars"], r["n"]) for r in whole]
    assert [r["p_raw"] for r in got] == pytest.approx([r["p_raw"] for r in whole], rel=1e-9, nan_ok=True)
    assert [r["effect_value"] for r in got] == pytest.approx([r["effect_value"] for r in whole], rel=1e-9, nan_ok=True)
    assert tested == [([c for c in numeric if c in gaps], categorical), ([c for c in numeric if c not in gaps], [c for c in categorical if c in gaps])]
