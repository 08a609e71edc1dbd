"""Least squares for every numeric column, with HC3 errors and diagnostics, all models together.

One scan gives the centred products of all columns (every model and every partial regression is
a block of them); with the solved coefficients a second one gives what the robust covariances and
the diagnostics need. Both run ``matrix`` kernels over blocks of rows, whatever the number of
columns; only sums reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.functions import special
from tallyweave.functions.text import column
from tallyweave.operators import matrix, series
from tallyweave.operators.association import pair_moments
from tallyweave.operators.results import Assumption, result, signed
from tallyweave.plans.batch import kept
from tallyweave.session import ship

if TYPE_CHECKING:
    from tallyweave.operators.shared import Known

LEAST_ROWS, ROWS_PER_TERM, SHAPIRO_ROWS, ALPHA = 10, 5, 5000, 0.05
#: Bytes of the sums of all models that one scan carries; more (hundreds of columns) takes another scan.
STATE_BYTES = 48 << 20
#: Part of the outcome's spread below which a model fits so closely that its leverages are computed by themselves.
CLOSE_FIT = 1e-8


@dataclass
class Design:
    """Terms with their columns, over the rows that have the outcome and all numeric predictors."""

    df: DataFrame
    y: Column
    terms: dict[str, Column]
    wide: matrix.Wide = field(repr=False)


def widen(df: DataFrame, numeric: list[str], categorical: list[str], met: list[list[str]] | None = None) -> matrix.Wide:
    """Numeric columns as they are; a 0/1 column for each level of the others but the first in order (missing is a level, nan).
    ``met``: the levels, if known."""
    wide = matrix.Wide({c: column(c).cast("double") for c in numeric})
    level = {c: F.coalesce(column(c).cast("string"), F.lit("nan")) for c in categorical}
    if met is None:
        met = df.agg(*(F.sort_array(F.collect_set(v)).alias(f"l{i}") for i, v in enumerate(level.values()))).first() if level else ()  # at most 50 levels each
    wide.terms |= wide.numeric
    for (c, v), levels in zip(level.items(), met, strict=True):
        wide.levels[c] = sorted(levels)
        wide.codes[c] = F.create_map(*(F.lit(x) for i, l in enumerate(wide.levels[c]) for x in (l, float(i))))[v] if levels else F.lit(0.0)
        wide.terms |= {f"{c}={l}": F.when(v == l, 1.0).otherwise(0.0) for l in wide.levels[c][1:]}
    return wide


def complete(df: DataFrame, numeric: list[str]) -> DataFrame:
    for c in numeric:
        df = df.where(column(c).isNotNull())
    return df


def design(df: DataFrame, outcome: str, numeric: list[str], categorical: list[str]) -> Design:
    wide = widen(df, [outcome, *numeric], categorical)
    return Design(complete(df, [outcome, *numeric]), wide.terms[outcome], {k: v for k, v in wide.terms.items() if k != outcome}, wide)


@dataclass
class Fit:
    """A solved model."""

    names: list[str]
    n: int
    beta: np.ndarray  # intercept first
    se: np.ndarray
    cov: np.ndarray
    inverse: np.ndarray  # of the Gram matrix
    center: np.ndarray
    scale: np.ndarray
    r2: float
    adj_r2: float
    rank: int
    f: float
    f_p: float
    bp: float
    bp_p: float
    cooks_max: float
    shapiro_p: float
    vif_max: float
    sd: np.ndarray
    sd_y: float
    gram: np.ndarray  # of the terms, centred and scaled
    outcome: str
    distance: float  # what e^2 h / (1 - h)^2 is divided by for Cook's distance; 0 if unknown
    wide: matrix.Wide = field(repr=False)

    @cached_property
    def _plain(self) -> list[Column]:
        return [F.coalesce(self.wide.terms[x], F.lit(0.0)) for x in self.names]

    @cached_property
    def resid(self) -> Column:
        return self.wide.terms[self.outcome] - float(self.beta[0]) - _dot(self._plain, self.beta[1:])

    @property
    def fitted(self) -> Column:
        return self.wide.terms[self.outcome] - self.resid

    @property
    def cooks(self) -> Column:
        """Cook's distance of a row, as an expression of all pairs of terms: for models of few terms (``diagnosed`` is for all)."""
        if not self.distance:
            return F.lit(None).cast("double")
        unit = [(v - float(self.center[j])) / float(self.scale[j]) for j, v in enumerate(self._plain)]
        h = F.lit(1.0 / self.n)
        for i, z in enumerate(unit):
            h = h + z * _dot(unit, self.inverse[i])
        return F.try_divide(self.resid * self.resid * h, (1 - h) * (1 - h)) / self.distance


def _dot(z: list[Column], weights: np.ndarray) -> Column:
    out = F.lit(0.0)
    for v, w in zip(z, weights, strict=True):
        out = out + v * float(w)
    return out


def fit(d: Design) -> Fit:
    """The model of a design; ``LinAlgError`` where its columns hold infinite values."""
    y = next(iter(d.wide.terms))
    wanted = {y: list(d.terms)}
    got = grams(d.df, d.wide, [d.wide.keys])
    return fits(d.df, d.wide, wanted, got, {y: 0})[y]


@dataclass
class Gram:
    """Of a group of columns, over the rows that have its numeric ones: rows, centre, scale, and scaled centred products."""

    keys: list[str]
    n: int
    center: np.ndarray
    scale: np.ndarray
    products: np.ndarray


def grams(df: DataFrame, wide: matrix.Wide, groups: list[list[str]]) -> list[Gram]:
    """Of each group of keys, all from one scan."""
    got = matrix.fold(df, wide.inputs, scatter_of(wide, groups))
    return grams_of(groups, got or [(0, np.zeros(len(g)), np.zeros((len(g), len(g)))) for g in groups])


def scatter_of(wide: matrix.Wide, groups: list[list[str]]) -> matrix.Scatter:
    place = {k: i for i, k in enumerate(wide.keys)}
    return matrix.Scatter(len(wide.numeric), wide.sizes, [np.array([place[k] for k in g], np.int64) for g in groups])


def grams_of(groups: list[list[str]], got: list[tuple]) -> list[Gram]:
    """From the state of ``scatter_of``."""
    out = []
    for g, (n, mean, c) in zip(groups, got, strict=True):
        scale = np.sqrt(np.maximum(np.diag(c), 0) / max(n, 1))
        flat = scale <= 1e-14 * np.abs(mean)  # a constant, but for rounding
        scale = np.where(flat | (scale == 0), 1.0, scale)
        with np.errstate(invalid="ignore"):
            products = c / np.outer(scale, scale)
        products[flat], products[:, flat] = 0.0, 0.0
        out.append(Gram(g, n, mean, scale, products))
    return out


def _solved(wide: matrix.Wide, wanted: dict[str, list[str]], of: list[Gram], group: dict[str, int]) -> tuple[dict, list[tuple], dict[str, matrix.Model]]:
    """Coefficients and what ``_fit`` reads of each outcome, and groups and models for ``matrix.Residuals``."""
    made: dict = {}
    for y, terms in wanted.items():
        g = of[group[y]]
        place = {k: i for i, k in enumerate(g.keys)}
        t, yi = [place[k] for k in terms], place[y]
        own = g.products[np.ix_(t, t)]
        if not np.isfinite(g.products).all():
            raise np.linalg.LinAlgError("infinite values")
        inner = np.linalg.pinv(own, rcond=1e-12, hermitian=True)
        top = max(1.0, float(np.abs(g.products[np.ix_([*t, yi], [*t, yi])]).max()))
        rank = int(np.linalg.matrix_rank(own, tol=1e-9 * top, hermitian=True)) + 1
        made[y] = (t, yi, inner, rank, inner @ g.products[t, yi])  # the last: coefficients of the scaled terms
    place = {k: i for i, k in enumerate(wide.keys)}
    shared = [len({y for y in wanted if group[y] == i}) > 1 for i in range(len(of))]
    groups = [(np.array([place[k] for k in g.keys], np.int64), g.n, g.center, g.scale, np.linalg.pinv(g.products, rcond=1e-12, hermitian=True) if s else None) for g, s in zip(of, shared, strict=True)]
    models = {}
    for y, (t, yi, inner, _, b) in made.items():
        g = of[group[y]].products
        sse = float(g[yi, yi] - g[yi, t] @ b)
        with_all = shared[group[y]] and len(t) + 1 == len(g) and sse > CLOSE_FIT * g[yi, yi]
        models[y] = matrix.Model(group[y], yi, np.array(t, np.int64), b, inner, sse if with_all else None)
    return made, groups, models


def residuals_of_all(wide: matrix.Wide, gram: Gram) -> matrix.Residuals | None:
    """The kernel for the models of each numeric column on all others; None where rows are too few for these, or sums too large for one scan."""
    k = len(gram.keys) - 1
    if not k or gram.n < max(LEAST_ROWS, ROWS_PER_TERM * k, k + 2) or not np.isfinite(gram.products).all() or len(wide.numeric) * 4 * (k + 2) ** 2 > STATE_BYTES:
        return None
    _, groups, models = _solved(wide, {y: [t for t in gram.keys if t != y] for y in wide.numeric}, [gram], dict.fromkeys(wide.numeric, 0))
    return matrix.Residuals(len(wide.numeric), wide.sizes, groups, list(models.values()), gram.n <= SHAPIRO_ROWS)


def fits(df: DataFrame, wide: matrix.Wide, wanted: dict[str, list[str]], of: list[Gram], group: dict[str, int], known: dict[str, dict] | None = None) -> dict[str, Fit]:
    """A model for each outcome with its terms, each over the rows of its group's Gram matrix; one more scan for all of them that
    are not ``known`` from ``residuals_of_all``."""
    made, groups, models = _solved(wide, wanted, of, group)
    sums: dict = {y: s for y, s in (known or {}).items() if y in models and group[y] == 0}
    left = [y for y in models if y not in sums]
    while left:
        some, size = [], 0
        while left and (not some or size + 4 * (len(models[left[0]].terms) + 2) ** 2 <= STATE_BYTES):
            some.append(left.pop(0))
            size += 4 * (len(models[some[-1]].terms) + 2) ** 2
        few = max(of[group[y]].n for y in some) <= SHAPIRO_ROWS
        state = matrix.fold(df, wide.inputs, matrix.Residuals(len(wide.numeric), wide.sizes, groups, [models[y] for y in some], few))
        sums |= dict(zip(some, state, strict=True))
    return {y: _fit(wide, wanted[y], of[group[y]], *made[y], sums[y], y) for y in wanted}


def _fit(wide: matrix.Wide, names: list[str], gram: Gram, t: list[int], yi: int, inner: np.ndarray, rank: int, b: np.ndarray, s: dict, outcome: str) -> Fit:
    n, k, g, center, scale = gram.n, len(t), gram.products, gram.center, gram.scale
    meat = np.zeros((k + 1, k + 1))
    meat[np.triu_indices(k + 1)] = s["meat"]
    meat = meat + np.triu(meat, 1).T
    bread = np.zeros((k + 1, k + 1))
    bread[0, 0], bread[1:, 1:] = 1.0 / n, inner
    cov = bread @ meat @ bread  # of scaled coefficients, centred intercept
    sse, sst = s["sse"], g[yi, yi]
    r2 = 1 - sse / sst if sst > 0 else special.NAN
    adj = 1 - (1 - r2) * (n - 1) / (n - rank) if n > rank else special.NAN
    df_model = rank - 1
    try:
        wald = float(b @ np.linalg.pinv(cov[1:, 1:], rcond=1e-10, hermitian=True) @ b) / df_model if df_model and np.isfinite(cov).all() else special.NAN
    except np.linalg.LinAlgError:
        wald = special.NAN
    mean = s["q"][0] / n
    spread = s["e4"] - n * mean * mean
    bp = n * float(s["q"][1:] @ inner @ s["q"][1:]) / spread if spread > 1e-300 else special.NAN
    mse = sse / (n - rank) if n > rank else special.NAN
    known = mse > 0 and math.isfinite(s["far"])
    own_center, own_scale = center[t], scale[t]
    back = np.concatenate(([1.0], 1 / own_scale)) * scale[yi]
    slopes = b * back[1:]
    move = np.eye(k + 1)
    move[0, 1:] = -own_center  # from the centred intercept to the plain one
    cov = move @ np.diag(back) @ cov @ np.diag(back) @ move.T
    beta = np.concatenate(([center[yi] - float(slopes @ own_center)], slopes))
    shapiro_p = special.shapiro(s["e"])[1] if "e" in s and 3 <= n <= SHAPIRO_ROWS else special.NAN
    se = np.sqrt(np.where(np.diag(cov) >= 0, np.diag(cov), np.nan))
    block = g[np.ix_(t, t)]
    spread_of = math.sqrt(n / (n - 1))
    return Fit(names, n, beta, se, cov, inner, own_center, own_scale, r2, adj, rank, wald, special.f_sf(wald, df_model, n - rank), bp, special.chi2_sf(bp, df_model) if not math.isnan(bp) else special.NAN, s["far"] / (rank * mse) if known else special.NAN, shapiro_p, vif_max(block, own_center, own_scale, k, n), own_scale * spread_of, scale[yi] * spread_of, block, outcome, float(rank * mse * scale[yi] ** 2) if mse > 0 else 0.0, wide)


def diagnosed(df: DataFrame, wide: matrix.Wide, solved: dict[str, Fit], row: Column | None) -> DataFrame:
    """For each row that has the numeric columns: its position, and fitted value (f), residual (e) and Cook's distance (d) of every
    model, numbered in order; written once for all series."""
    ship(df.sparkSession)
    n, sizes = len(wide.numeric), wide.sizes
    place = {k: i for i, k in enumerate(wide.keys)}
    models = [(place[f.outcome], np.array([place[x] for x in f.names], np.int64), f.beta, f.center, f.scale, f.inverse, f.n, f.distance) for f in solved.values()]
    names = ["row", *(f"{v}{i}" for i in range(len(models)) for v in "fed")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix.widened(np.column_stack([c.to_numpy(zero_copy_only=False) for c in b.columns[1:]]).astype(np.float64), n, sizes)
            made = [b.column(0)]
            for y, terms, beta, center, scale, inverse, size, distance in models:
                e = x[:, y] - beta[0] - x[:, terms] @ beta[1:]
                z = (x[:, terms] - center) / scale
                h = 1 / size + ((z @ inverse) * z).sum(1)
                with np.errstate(divide="ignore", invalid="ignore"):
                    d = e * e * h / ((1 - h) * (1 - h)) / distance if distance else np.full(len(e), np.nan)
                made += [pa.array(x[:, y] - e), pa.array(e), pa.array(d, mask=~np.isfinite(d))]
            yield pa.RecordBatch.from_arrays(made, names)

    inputs = [(F.lit(None) if row is None else row).cast("bigint").alias("row"), *(c.cast("double").alias(f"x{i}") for i, c in enumerate(wide.inputs))]
    return kept(df.select(*inputs).mapInArrow(run, "row bigint, " + ", ".join(f"{c} double" for c in names[1:])), "diagnosed")


def vif_max(g: np.ndarray, center: np.ndarray, scale: np.ndarray, k: int, n: int) -> float:
    """The largest variance inflation factor, of regressions among the terms without an intercept."""
    if k < 2:
        return special.NAN
    raw = g[:k, :k] * np.outer(scale[:k], scale[:k]) + n * np.outer(center[:k], center[:k])
    size = np.sqrt(np.diag(raw))
    if (size == 0).any():
        return special.NAN
    unit = raw / np.outer(size, size)
    values, vectors = np.linalg.eigh(unit)
    if values[0] < 1e-14 * values[-1]:
        return math.inf
    return float(((vectors * vectors) / values).sum(1).max())


def partials(terms: dict[str, Column], f: Fit, term: str) -> tuple[Column, Column]:
    """Term and outcome, each without what the other terms explain of them; a block of the model's Gram matrix says what that is."""
    k = f.names.index(term)
    others = [i for i in range(len(f.names)) if i != k]
    b = np.linalg.pinv(f.gram[np.ix_(others, others)], rcond=1e-12, hermitian=True) @ f.gram[others, k] if others else np.zeros(0)
    z = [(terms[f.names[i]] - float(f.center[i])) / float(f.scale[i]) for i in others]
    ex = (terms[term] - float(f.center[k])) - _dot(z, b * f.scale[k])
    return ex, f.resid + ex * float(f.beta[k + 1])


def _sloped(s: dict | None) -> dict | None:
    return s and s["trend"] and s | {"slope": s["trend"]["slope"]}


def partial_series(d: Design, f: Fit, term: str) -> dict | None:
    return _sloped(series.scatter_series(d.df, *partials(d.terms, f, term), series.PARTIAL_POINTS))


def _strongest(pairs: dict, outcome: str, others: list[str], n: int) -> list[str]:
    """The strongest few predictors where the rows are too few for all; none where no correlation is known."""
    strength = {c: abs(r) for c in others if (r := pairs[(outcome, c) if (outcome, c) in pairs else (c, outcome)]["r"]) is not None and math.isfinite(r)}
    return sorted(strength, key=strength.get, reverse=True)[: max(1, min(len(strength), n // ROWS_PER_TERM - 1))]


def regressions(df: DataFrame, numeric: list[str], categorical: list[str], n_total: int, charts: bool = True, row: Column | None = None, known: Known | None = None) -> tuple[list[dict], list[dict]]:
    """A model of each numeric column on all others, and its coefficients. ``known``: what a shared scan found, if any."""
    if not numeric or len(numeric) + len(categorical) < 2:
        return [], []
    wide = known.wide if known else widen(df, numeric, categorical)
    of = [known.gram] if known else grams(df, wide, [wide.keys])
    n_whole = of[0].n
    terms_of = {y: [t for t in wide.keys if t != y] for y in numeric}
    group, note, short = dict.fromkeys(numeric, 0), dict.fromkeys(numeric), [y for y in numeric if len(numeric) > 1 and n_whole < ROWS_PER_TERM * len(terms_of[y])]
    if short:
        pairs = known.moments if known else pair_moments(df, numeric)
        for y in short:
            terms_of[y] = _strongest(pairs, y, [c for c in numeric if c != y], n_whole)
            note[y] = f"only the {len(terms_of[y])} most correlated predictors were used, for want of rows"
        of += grams(df, wide, [[y, *terms_of[y]] for y in short])
        group |= {y: i + 1 for i, y in enumerate(short)}
    rows = {y: of[group[y]].n for y in numeric}
    good = [y for y in numeric if terms_of[y] and rows[y] >= LEAST_ROWS and rows[y] > len(terms_of[y]) + 1 and np.isfinite(of[group[y]].products).all()]
    solved = fits(df, wide, {y: terms_of[y] for y in good}, of, group, known and known.sums) if good else {}
    frames = {y: complete(df, numeric if group[y] == 0 else [y, *terms_of[y]]) for y in good}
    shown: dict = {}
    if charts:
        whole = [y for y in good if group[y] == 0]
        for frame, own in ([(frames[whole[0]], whole)] if whole else []) + [(frames[y], [y]) for y in good if group[y]]:
            told = diagnosed(frame, wide, {y: solved[y] for y in own}, row)
            for y, s in series.points_of(told, {y: (F.col(f"f{i}"), F.col(f"e{i}")) for i, y in enumerate(own)}, series.RESIDUAL_POINTS, ("fitted_lim", "resid_lim")).items():
                shown[y, "resid_plot"] = s and {k: v for k, v in s.items() if k != "clipped"}
            if row is not None:
                shown |= {(y, "influence_plot"): s for y, s in series.influences(told, {y: F.col(f"d{i}") for i, y in enumerate(own)}, F.col("row")).items()}
            pairs = {(y, t): partials(wide.terms, solved[y], t) for y in own for i, t in enumerate(solved[y].names) if _p_of(solved[y], i) < ALPHA}
            shown |= {(*key, "avp_plot"): _sloped(s) for key, s in series.points_of(frame, pairs, series.PARTIAL_POINTS, trends=True).items()}
    models, coefficients = [], []
    for outcome in numeric:
        n = rows[outcome]
        if outcome not in solved:
            why = note[outcome] or ("too few complete rows for a model" if np.isfinite(of[group[outcome]].products).all() else "infinite values leave no model")
            models.append(result("regression_model", "insufficient", [outcome], n, special.NAN, special.NAN, "adj_r2", special.NAN, note=why))
            continue
        f = solved[outcome]
        collinear, uneven = f.vif_max > 10, f.bp_p < ALPHA
        checks = [
            Assumption("even residuals (Breusch-Pagan)", not uneven, f"p = {f.bp_p:.3g}", True),
            Assumption("normal residuals (Shapiro)", not f.shapiro_p < ALPHA, f"p = {f.shapiro_p:.3g}"),
            Assumption("no strong collinearity", not collinear, f"largest VIF {f.vif_max:.1f}", math.isfinite(f.vif_max) and f.vif_max > 100),
            Assumption("no dominant row", not f.cooks_max > 4 / n, f"largest Cook's distance {f.cooks_max:.3g}", f.cooks_max > 1),
            Assumption("not a near-perfect fit", f.adj_r2 < 0.999, f"adjusted R² {f.adj_r2:.4f}; look for derived columns", f.adj_r2 >= 0.9999),
        ]
        plots = {k: shown[outcome, k] for k in ("resid_plot", "influence_plot") if (outcome, k) in shown}
        models.append(result("regression_model", "ols", [outcome], n, f.f, f.f_p, "adj_r2", f.adj_r2, "none", checks, None, r2=f.r2, adj_r2=f.adj_r2, f=f.f, f_p=f.f_p, bp_p=f.bp_p, shapiro_resid_p=f.shapiro_p, cooks_max=f.cooks_max, vif_max=f.vif_max, n_predictors=len(f.names), n_drop_frac=1 - n / n_total if n_total else 0.0, note=note[outcome], **plots))
        for i, term in enumerate(f.names):
            est, se = float(f.beta[i + 1]), float(f.se[i + 1])
            std = est * float(f.sd[i]) / f.sd_y if f.sd_y else special.NAN
            wild = abs(std) > 1.5
            terms = [
                Assumption("identifiable coefficients (no strong collinearity)", not collinear, f"the model's largest VIF is {f.vif_max:.1f}", collinear and math.isfinite(f.vif_max)),
                Assumption("even residuals", not uneven, f"the model's p = {f.bp_p:.3g}"),
                Assumption("plausible coefficient", not wild, f"standardised β = {std:.2f}", wild),
            ]
            partial = {"avp_plot": shown[outcome, term, "avp_plot"]} if (outcome, term, "avp_plot") in shown else {}
            coefficients.append(result("regression_coefficient", "coef", [outcome, term], n, est / se if se else special.NAN, _p_of(f, i), "std_beta", std, signed(est), terms, None, estimate=est, std_error=se, ci_low=est - 1.959963984540054 * se, ci_high=est + 1.959963984540054 * se, outcome=outcome, model_adj_r2=f.adj_r2, model_vif_max=f.vif_max, **partial))
    return models, coefficients


def _p_of(f: Fit, i: int) -> float:
    """Two-sided p of the coefficient of term i."""
    est, se = float(f.beta[i + 1]), float(f.se[i + 1])
    z = est / se if se else special.NAN
    return 2 * special.norm_sf(abs(z)) if not math.isnan(z) else special.NAN
