"""Counts of values by pattern against the passes over rows that they stand for."""

import numpy as np
import pandas as pd
import pytest

from tallyweave.functions.text import column
from tallyweave.operators import association, catalog, matrix, modelling, models, shared, values
from tallyweave.plans import registry, report

NUM, CAT = ["a", "b", "c"], ["u", "v"]


def rows(seed=5, n=700, gaps=("a", "c", "v")):
    r = np.random.default_rng(seed)
    u, v = r.choice(list("xyz"), n), r.choice(["p", "q", "nan", "rare"], n, p=[0.495, 0.3, 0.2, 0.005])
    d = pd.DataFrame({"a": r.integers(0, 9, n) + (u == "x") * 2.5, "b": r.exponential(size=n) ** 3, "c": np.round(r.normal(size=n), 1), "u": u, "v": v})
    for i, c in enumerate(gaps):
        d.loc[r.random(n) < 0.1 + 0.05 * i, c] = None
    return d


def made(spark, d, parts=3):
    return spark.createDataFrame(d.astype(object).where(d.notna(), None).values.tolist(), "a double, b double, c double, u string, v string").repartition(parts)


@pytest.mark.parametrize("block", [values.BLOCK_CELLS, 60])
def test_counts_stand_for_the_rows(spark, monkeypatch, block):
    monkeypatch.setattr(values, "BLOCK_CELLS", block)
    d = made(spark, rows()).cache()
    got = values.value_counts(d, NUM, CAT)
    assert got.gappy() == modelling.gappy(d) == {"a", "c", "v"}
    fills = modelling.fill_values(d, NUM, CAT)
    assert got.fill_values() == {k: pytest.approx(v) if k in NUM else v for k, v in fills.items() if k in got.gappy()}
    stats = catalog.numeric_stats(d, {c: column(c) for c in NUM})
    assert {c: (pytest.approx(s["skew"], abs=1e-9), s["n_outliers_5iqr"]) for c, s in stats.items()} == {c: (s["skew"], s["n_outliers_5iqr"]) for c, s in got.stats().items()}
    for frame, counts in ((d, got), (modelling.imputed(d, NUM, CAT), got.filled(got.fill_values()))):
        plain = association.group_differences(frame, NUM, CAT) + association.contingency(frame, CAT)
        quick = association.group_differences(frame, NUM, CAT, counts) + association.contingency(frame, CAT, None, counts)
        assert [r["vars"] for r in plain] == [r["vars"] for r in quick] and len(plain) == 7
        for x, y in zip(plain, quick, strict=True):
            for k in ("kind", "n", "effect_magnitude", "assumptions", "nonparametric_agrees"):
                assert x[k] == y[k]
            assert [x[k] for k in ("statistic", "p_raw", "effect_value")] == pytest.approx([y[k] for k in ("statistic", "p_raw", "effect_value")], rel=1e-9, abs=1e-12)
            assert [g["level"] for g in x["extra"].get("groups", [])] == [g["level"] for g in y["extra"].get("groups", [])]
            assert x["extra"].get("kruskal_p") == pytest.approx(y["extra"].get("kruskal_p"), abs=1e-12)


def test_frames_that_are_not_counted(spark, monkeypatch):
    d = made(spark, rows())
    assert values.value_counts(d, [], CAT) is None and values.value_counts(d, NUM, []) is None
    assert values.value_counts(d.selectExpr("IF(a > 3, double('NaN'), a) AS a", "u"), ["a"], ["u"]) is None
    assert values.value_counts(d.selectExpr("IF(a > 3, double('Infinity'), a) AS a", "u"), ["a"], ["u"]) is None
    monkeypatch.setattr(values, "MOST_PATTERNS", 3)
    assert values.value_counts(d, NUM, CAT) is None
    assert len(report.sweeps(d, NUM, CAT)[0]) == len(report.sweeps(d, NUM, CAT)[1]) > 10


def test_both_sweeps_count_the_rows_once(spark, sf_dir, monkeypatch):
    def no(*_):
        raise AssertionError("a pass over rows times pairs of columns")

    before = registry.queries()["sweep_all"](spark, sf_dir).collect()
    for name in ("level_moments", "rank_sums", "tables"):
        monkeypatch.setattr(association, name, no)
    monkeypatch.setattr(catalog, "numeric_stats", no)
    found = registry.queries()["imputation_robustness"](spark, sf_dir).collect()
    assert {r["robustness"] for r in found} == {"stable"} and {tuple(r["vars"]) for r in found} <= {tuple(r["vars"]) for r in before}


@pytest.mark.parametrize(("gaps", "cells"), [((), association.BROADCAST_CELLS), (("a", "c"), 0), (("a", "b", "c", "v"), association.BROADCAST_CELLS)])
def test_one_scan_of_the_frame_and_of_its_copy(spark, monkeypatch, gaps, cells):
    monkeypatch.setattr(values, "BROADCAST_CELLS", cells)
    d = made(spark, rows(gaps=gaps).replace({"v": {"nan": "other"}})).cache()
    counts = values.value_counts(d, NUM, CAT)
    fills = counts.fill_values()
    seen = []
    fold = matrix.fold
    monkeypatch.setattr(matrix, "fold", lambda *a: seen.append(type(a[2]).__name__) or fold(*a))
    frames = zip((d, modelling.imputed(d, NUM, CAT)), shared.known(d, counts, fills), strict=True)
    assert seen == ["Several"] * (2 if gaps else 1)
    monkeypatch.undo()
    for frame, got in frames:
        if not gaps and frame is not d:
            assert got is None
            continue
        assert (got.rhos is None) == (cells == 0)
        stats = {"b": {"skew": 4.0}}
        plain = association.correlations(frame, NUM, stats), *models.regressions(frame, NUM, CAT, 700, False)
        quick = association.correlations(frame, NUM, stats, got), *models.regressions(frame, NUM, CAT, 700, False, known=got)
        for one, other in zip(plain, quick, strict=True):
            assert len(one) == len(other) > 2
            for x, y in zip(one, other, strict=True):
                assert [x[k] for k in ("kind", "vars", "n", "assumptions")] == [y[k] for k in ("kind", "vars", "n", "assumptions")]
                assert [x[k] for k in ("statistic", "p_raw", "effect_value")] == pytest.approx([y[k] for k in ("statistic", "p_raw", "effect_value")], rel=1e-7, abs=1e-11)
                assert [x["extra"].get(k) for k in ("spearman_rho", "pearson_r")] == pytest.approx([y["extra"].get(k) for k in ("spearman_rho", "pearson_r")], abs=1e-11)


def test_the_sweeps_read_the_rows_in_four_passes(spark, sf_dir, monkeypatch):
    seen = []
    fold, counted = matrix.fold, values.value_counts
    monkeypatch.setattr(matrix, "fold", lambda *a: seen.append(type(a[2]).__name__) or fold(*a))
    monkeypatch.setattr(report, "value_counts", lambda *a: seen.append("patterns and values") or counted(*a))
    found = registry.queries()["caveats"](spark, sf_dir).collect()
    assert found and seen == ["patterns and values", "Several", "Several"]


def test_a_missing_level_is_no_level_named_nan(spark):
    d = made(spark, rows())
    counts = values.value_counts(d, NUM, CAT)
    assert shared.known(d, counts, counts.fill_values()) == (None, None) == shared.known(d, None, None)
