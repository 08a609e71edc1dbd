"""Distribution functions against the JVM's commons-math3, and small tests against published values."""

import math
from itertools import product

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyweave.functions import special


@pytest.fixture(scope="module")
def dist(spark):
    return spark._jvm.org.apache.commons.math3.distribution


@pytest.mark.parametrize("t,df", list(product((0.0, 0.3, 2.0, 9.5), (1, 2.5, 30, 4000))))
def test_t(dist, t, df):
    assert special.t_sf2(t, df) == pytest.approx(2 * dist.TDistribution(float(df)).cumulativeProbability(-t), abs=1e-12)


@pytest.mark.parametrize("f,a,b", list(product((0.2, 1.0, 7.0), (1, 3, 40), (2, 15, 900))))
def test_f(dist, f, a, b):
    assert special.f_sf(f, a, b) == pytest.approx(1 - dist.FDistribution(float(a), float(b)).cumulativeProbability(f), abs=1e-11)


@pytest.mark.parametrize("x,k", list(product((0.01, 1.0, 9.0, 60.0), (1, 2, 7, 100))))
def test_chi2(dist, x, k):
    assert special.chi2_sf(x, k) == pytest.approx(1 - dist.ChiSquaredDistribution(float(k)).cumulativeProbability(x), abs=1e-11)


def test_published_values():
    w, p = special.shapiro([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236])
    assert (round(w, 3), round(p, 4)) == (0.789, 0.0067)
    assert special.fisher_2x2(8, 2, 1, 5) == pytest.approx(0.03496503, abs=1e-7)
    assert special.fisher_2x2(3, 1, 1, 3) == pytest.approx(0.4857143, abs=1e-6)


def test_exact_rank_sum_counts_all_orders():
    from itertools import combinations

    m, n = 4, 5
    us = [sum(c) - m * (m + 1) // 2 for c in combinations(range(1, m + n + 1), m)]
    for u in (0, 3, 10, 15):
        top = max(u, m * n - u)
        assert special.mann_whitney_p(u, m, n, 0) == pytest.approx(min(1, 2 * sum(v >= top for v in us) / len(us)))


def test_edges():
    assert math.isnan(special.shapiro([1, 2])[1])
    assert special.shapiro([5.0] * 6) == (1.0, 1.0)
    assert special.pearson_p(1.0, 20) == 0.0
    assert math.isnan(special.pearson_p(None, 20))
    assert math.isnan(special.t_sf2(1, 0))


@settings(max_examples=50, deadline=None)
@given(st.lists(st.floats(-1e6, 1e6), min_size=4, max_size=60))
def test_shapiro_is_a_probability_and_scale_free(x):
    w, p = special.shapiro(x)
    assert 0 <= p <= 1 and 0 <= w <= 1
    if np.ptp(x) > 1:
        assert special.shapiro([4 * v for v in x])[0] == pytest.approx(w, abs=1e-9)
