"""Exact quantiles in two passes, of columns and of levels."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyweave.operators import association, quantiles as q
from tallyweave.plans import batch

PROBABILITIES = [0.0, 0.01, 0.25, 0.5, 0.75, 0.9, 1.0]


def some_values(seed=0):
    r = np.random.default_rng(seed)
    d = pd.DataFrame({"x": np.concatenate([r.normal(size=3000), [1.5] * 1500, [1e12, -1e12, 0.0, -0.0]]), "y": r.integers(0, 7, 4504).astype(float), "z": r.normal(size=4504) * 1e-300})
    d["g"] = r.choice(list("pqrs"), len(d), p=[0.9, 0.08, 0.015, 0.005])
    d.loc[r.random(len(d)) < 0.2, "y"] = np.nan
    d.loc[d.index[7::11], "g"] = None
    d["none"] = np.nan
    d["one"] = np.where(np.arange(len(d)) == 5, 3.25, np.nan)
    return d


@pytest.fixture(scope="module")
def values(spark):
    d = some_values()
    return d, spark.createDataFrame(d.astype(object).where(d.notna(), None).values.tolist(), "x double, y double, z double, g string, none double, one double").repartition(3)


@pytest.mark.parametrize("accuracy,last", [(q.ACCURACY, q.LAST_VALUES), (20, q.LAST_VALUES), (20, 0), (5, 3)])
def test_quantiles_of_levels_and_columns(values, accuracy, last):
    pdf, d = values
    columns = {c: F.col(c) for c in ("x", "y", "z", "none", "one")}
    got = q.level_quantiles(d, columns, PROBABILITIES, F.col("g"), accuracy, last)
    expected = {(c, v): own[c].dropna().quantile(PROBABILITIES).tolist() for v, own in pdf.groupby("g") for c in columns if own[c].notna().any()}
    assert set(got) == set(expected)
    for k, v in expected.items():
        assert got[k] == pytest.approx(v, rel=1e-12, abs=0)
    whole = q.level_quantiles(d, columns, PROBABILITIES, F.lit(""), accuracy, last)
    assert {c for c, _ in whole} == {"x", "y", "z", "one"}
    for c in ("x", "y", "z", "one"):
        assert whole[c, ""] == pytest.approx(pdf[c].dropna().quantile(PROBABILITIES).tolist(), rel=1e-12, abs=0)


def test_a_sketch_that_misses_is_made_good(values, monkeypatch):
    pdf, d = values
    monkeypatch.setattr(q, "_brackets", lambda at, ranks, n, accuracy, low, high: [(0.1, 0.2), (0.3, 0.3)])
    assert q.quantiles(d, {"x": F.col("x"), "y": F.col("y")}, [0.05, 0.5])["x"] == pytest.approx(pdf.x.quantile([0.05, 0.5]).tolist())


def test_infinite_values_and_empty_columns(spark):
    d = spark.createDataFrame([(v,) for v in [1.0, 2.0, math.inf, math.inf, -math.inf, None]], "x double")
    assert q.quantiles(d, {"x": F.col("x"), "n": F.lit(None)}, [0.0, 0.5, 1.0]) == {"x": [-math.inf, 2.0, math.inf], "n": None}
    assert q.quantiles(d.limit(0), {"x": F.col("x")}, [0.5]) == {"x": None}


def test_two_passes_whatever_the_columns(values, monkeypatch):
    _, d = values
    seen = []
    kept, totals = batch.kept, batch.totals
    monkeypatch.setattr(q, "kept", lambda df, label: seen.append(label) or kept(df, label))
    monkeypatch.setattr(q, "totals", lambda df, wanted, by=(): seen.append("sketch") or totals(df, wanted, by))
    q.quantiles(d, {f"c{i}": F.col("x") * (i + 1) for i in range(12)}, [0.25, 0.5, 0.75])
    assert seen == ["sketch", "brackets"]


def test_level_medians(values):
    pdf, d = values
    got = association.level_moments(d, ["x", "y"], "g")
    for c in "xy":
        assert {v: m["median"] for v, m in got[c].items()} == pytest.approx(pdf.groupby("g")[c].median().to_dict())
