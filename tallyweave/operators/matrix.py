"""Sums of products of all columns in one scan: a state for each partition, merged as a tree.

A kernel turns a block of rows (a numpy array, NaN where a value is missing) into a state and
merges two states. Tasks fold their partition's blocks, Spark rebalances the states, further tasks
merge them, and a few reach the driver. A state's size depends on the number of columns, not on
the rows. Means and centred sums are merged (Chan, Golub and LeVeque), so large offsets cost no
precision.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.functions.text import column
from tallyweave.session import ship


def fold(df: DataFrame, columns: list[Column], kernel, width: int = 0):
    """The kernel's state over all rows; None without rows. One scan of the frame.

    Columns are doubles, or with ``width`` arrays of so many doubles; the kernel sees rows x columns (x width).
    """
    ship(df.sparkSession)
    rows = df.select(*(c.cast("array<double>" if width else "double").alias(f"x{i}") for i, c in enumerate(columns)))

    def block(b: pa.RecordBatch) -> np.ndarray:
        if width:
            return np.stack([c.flatten().to_numpy(zero_copy_only=False).reshape(-1, width) for c in b.columns], 1)
        return np.column_stack([c.to_numpy(zero_copy_only=False) for c in b.columns]).astype(np.float64)

    def packed(state) -> Iterator[pa.RecordBatch]:
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(state, 5)], pa.large_binary())], ["state"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for b in batches:
            if b.num_rows:
                new = kernel.of(block(b))
                state = new if state is None else kernel.merge(state, new)
        yield from packed(state)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for b in batches:
            for s in b.column(0):
                new = pickle.loads(s.as_py())
                state = new if state is None else kernel.merge(state, new)
        yield from packed(state)

    made = rows.mapInArrow(scan, "state binary").hint("rebalance").mapInArrow(join, "state binary")
    state = None
    for (s,) in sorted(made.collect()):  # a state for each 64 MB of states
        new = pickle.loads(bytes(s))
        state = new if state is None else kernel.merge(state, new)
    return state


def _over(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a / b, 0 where b is 0."""
    return np.divide(a, b, out=np.zeros(np.broadcast(a, b).shape), where=b != 0)


class Pairs:
    """Moments of all pairs of columns, each over the rows that have both.

    The state has k x k matrices: rows with both values (n), with both finite (f), and over the latter the mean (mean) and centred
    squares (m2) of the row's column and the centred products (co); least and greatest value of the row's column (low, high) over
    the rows that have the other. Infinite values are present but have no part in the moments.
    """

    def of(self, x: np.ndarray) -> dict:
        here, fine = ~np.isnan(x), np.isfinite(x)
        m, f = here.astype(np.float64), fine.astype(np.float64)
        shift = _over(np.where(fine, x, 0).sum(0), f.sum(0))
        with np.errstate(over="ignore", invalid="ignore"):
            y = np.where(fine, x - shift, 0.0)
            n, sums = f.T @ f, y.T @ f
            state = {"n": m.T @ m, "f": n, "mean": _over(sums, n) + shift[:, None], "m2": (y * y).T @ f - _over(sums * sums, n), "co": y.T @ y - _over(sums * sums.T, n)}
        low, high = np.where(here, x, np.inf), np.where(here, x, -np.inf)
        k = x.shape[1]
        state["low"], state["high"] = np.repeat(low.min(0)[:, None], k, 1), np.repeat(high.max(0)[:, None], k, 1)
        for j in np.flatnonzero(~here.all(0)):
            own = here[:, j]
            state["low"][:, j] = low[own].min(0, initial=np.inf)
            state["high"][:, j] = high[own].max(0, initial=-np.inf)
        return state

    def merge(self, a: dict, b: dict) -> dict:
        n = a["f"] + b["f"]
        with np.errstate(over="ignore", invalid="ignore"):
            d = np.where((a["f"] > 0) & (b["f"] > 0), b["mean"] - a["mean"], 0.0)
            both = _over(a["f"] * b["f"], n)
            mean = np.where(a["f"] > 0, a["mean"] + d * _over(b["f"], n), b["mean"])
            return {"n": a["n"] + b["n"], "f": n, "mean": mean, "m2": a["m2"] + b["m2"] + d * d * both, "co": a["co"] + b["co"] + d * d.T * both, "low": np.minimum(a["low"], b["low"]), "high": np.maximum(a["high"], b["high"])}


@dataclass
class Tables:
    """Counts of all pairs of codes (whole numbers from 0) of some pairs of columns, each over the rows that have both."""

    sizes: list[int]
    pairs: list[tuple[int, int]]

    def of(self, x: np.ndarray) -> list[np.ndarray]:
        here, code = ~np.isnan(x), np.nan_to_num(x).astype(np.int64)
        out = []
        for i, j in self.pairs:
            both = here[:, i] & here[:, j]
            size = self.sizes[i] * self.sizes[j]
            out.append(np.bincount(code[both, i] * self.sizes[j] + code[both, j], minlength=size).reshape(self.sizes[i], self.sizes[j]))
        return out

    def merge(self, a: list[np.ndarray], b: list[np.ndarray]) -> list[np.ndarray]:
        return [x + y for x, y in zip(a, b, strict=True)]


def coded(df: DataFrame, columns: list[str]) -> tuple[list[list[str]], list[Column]]:
    """The levels of each categorical column (as text, in order), and the column as their numbers; one pass for all.

    Categorical columns have few levels (the catalog takes no others), so they are written out in the expression.
    """
    if not columns:
        return [], []
    text = [column(c).cast("string") for c in columns]
    met = df.agg(*(F.collect_set(t).alias(f"l{i}") for i, t in enumerate(text))).first()
    levels = [sorted(v) for v in met]
    return levels, [F.create_map(*(F.lit(y) for i, v in enumerate(own) for y in (v, float(i))))[t] if own else F.lit(None).cast("double") for t, own in zip(text, levels, strict=True)]


@dataclass
class RankProducts:
    """Products of the ranks of all pairs of columns, each over the rows that have both.

    A value comes with one number for each of some classes of rows: how many rows of the class lie under it, and half of those that
    equal it. ``partner`` says which classes add up to the rows that have a column; adding their numbers gives the value's rank
    (less a half) among these rows. State: rows with both (n), products of centred ranks (ab), squares of the row's column (aa).
    """

    partner: np.ndarray  # classes x columns, 0 or 1
    mean: np.ndarray  # of the ranks of each pair, columns x columns

    def of(self, x: np.ndarray) -> dict:
        here = ~np.isnan(x[:, :, 0])
        k = x.shape[1]
        m = here.astype(np.float64)
        state = {"n": m.T @ m, "ab": np.zeros((k, k)), "aa": np.zeros((k, k))}
        if len(self.partner) == 1 and self.partner.all():
            a = np.where(here, x[:, :, 0] - self.mean[0, -1], 0.0)
            state["ab"], state["aa"] = a.T @ a, (a * a).T @ m
            return state
        for at in range(0, len(x), 256):
            own = here[at : at + 256]
            r = np.where(own[:, :, None], x[at : at + 256], 0.0) @ self.partner - self.mean
            r *= own[:, :, None] & own[:, None, :]
            state["ab"] += np.einsum("rij,rji->ij", r, r)
            state["aa"] += np.einsum("rij,rij->ij", r, r)
        return state

    def merge(self, a: dict, b: dict) -> dict:
        return {k: a[k] + b[k] for k in a}


@dataclass
class Ranks:
    """The same from the values themselves and small tables of their ranks.

    ``groups`` tells which columns are missing in the same rows; a value has a rank (less a half) among the rows that have a column
    of each of these groups.
    """

    values: list[np.ndarray]  # the different values of each column, in order
    ranks: list[np.ndarray]  # values x groups
    groups: list[int]  # of each column
    mean: np.ndarray  # of the ranks of each pair, columns x columns

    def of(self, x: np.ndarray) -> dict:
        here = ~np.isnan(x)
        k = x.shape[1]
        m = here.astype(np.float64)
        state = {"n": m.T @ m, "ab": np.zeros((k, k)), "aa": np.zeros((k, k))}
        own = [r[np.minimum(np.searchsorted(v, x[:, i]), len(v) - 1)] for i, (v, r) in enumerate(zip(self.values, self.ranks, strict=True))]
        columns = {g: [i for i, h in enumerate(self.groups) if h == g] for g in self.groups}
        for g, a in columns.items():
            for h, b in columns.items():
                both = here[:, a[0]] & here[:, b[0]]
                center = self.mean[a[0], b[0]]
                left = np.stack([np.where(both, own[i][:, h] - center, 0.0) for i in a], 1)
                right = left if g == h else np.stack([np.where(both, own[i][:, g] - center, 0.0) for i in b], 1)
                state["ab"][np.ix_(a, b)] = left.T @ right
                state["aa"][np.ix_(a, b)] = (left * left).sum(0)[:, None]
        return state

    def merge(self, a: dict, b: dict) -> dict:
        return {k: a[k] + b[k] for k in a}


@dataclass
class Several:
    """Some kernels over the same rows, each with the number of first columns that it sees."""

    kernels: list[tuple[object, int]]

    def of(self, x: np.ndarray) -> list:
        return [kernel.of(x[:, :n]) for kernel, n in self.kernels]

    def merge(self, a: list, b: list) -> list:
        return [kernel.merge(s, t) for (kernel, _), s, t in zip(self.kernels, a, b, strict=True)]


@dataclass
class Filled:
    """A kernel over the rows with their gaps filled: numeric columns by a value (NaN: left as they are), then codes of levels by others."""

    kernel: object
    fills: list[float]
    codes: list[np.ndarray]

    def of(self, x: np.ndarray):
        x = x.copy()
        for i, v in enumerate(self.fills):
            x[np.isnan(x[:, i]), i] = v
        for i, code in enumerate(self.codes, len(self.fills)):
            x[:, i] = code[x[:, i].astype(np.int64)]
        return self.kernel.of(x)

    def merge(self, a, b):
        return self.kernel.merge(a, b)


@dataclass
class Wide:
    """What models read: numeric columns, then a 0/1 column for each level of a categorical column but the first."""

    numeric: dict[str, Column]
    codes: dict[str, Column] = field(default_factory=dict)  # number of the level in order, from 0
    levels: dict[str, list[str]] = field(default_factory=dict)
    terms: dict[str, Column] = field(default_factory=dict)  # every column as an expression, for plot series

    @property
    def keys(self) -> list[str]:
        return list(self.terms)

    @property
    def inputs(self) -> list[Column]:
        return [*self.numeric.values(), *self.codes.values()]

    @property
    def sizes(self) -> list[int]:
        return [len(self.levels[c]) - 1 for c in self.codes]


def widened(x: np.ndarray, n_numeric: int, sizes: list[int]) -> np.ndarray:
    """Numeric columns and the 0/1 columns of the levels."""
    return np.concatenate([x[:, :n_numeric], *(x[:, n_numeric + k, None] == np.arange(1, s + 1) for k, s in enumerate(sizes))], 1)


@dataclass
class Scatter:
    """For each group of columns, over the rows that have all its numeric ones: rows, means and centred sums of products."""

    n_numeric: int
    sizes: list[int]
    groups: list[np.ndarray]

    def of(self, x: np.ndarray) -> list[tuple]:
        x = widened(x, self.n_numeric, self.sizes)
        out = []
        with np.errstate(over="ignore", invalid="ignore"):
            for g in self.groups:
                own = x[~np.isnan(x[:, g]).any(1)][:, g]
                mean = own.mean(0) if len(own) else np.zeros(len(g))
                y = own - mean
                out.append((len(own), mean, y.T @ y))
        return out

    def merge(self, a: list[tuple], b: list[tuple]) -> list[tuple]:
        out = []
        with np.errstate(over="ignore", invalid="ignore"):
            for (n, m, c), (n2, m2, c2) in zip(a, b, strict=True):
                if n and n2:
                    d = m2 - m
                    out.append((n + n2, m + d * (n2 / (n + n2)), c + c2 + np.outer(d, d) * (n * n2 / (n + n2))))
                else:
                    out.append((n, m, c) if n else (n2, m2, c2))
        return out


@dataclass
class Model:
    """A solved model for ``Residuals``: places of outcome and terms in its group, scaled coefficients, inverse; ``sse`` where the
    leverages follow from those of all columns of the group."""

    group: int
    y: int
    terms: np.ndarray
    beta: np.ndarray
    inverse: np.ndarray
    sse: float | None


@dataclass
class Residuals:
    """What robust errors and diagnostics of all models need, from residuals e and leverages h of each row.

    Leverages of a group's models share one product: the columns' common leverage less e^2 / sum e^2 is that of all columns
    without the outcome.
    """

    n_numeric: int
    sizes: list[int]
    groups: list[tuple[np.ndarray, int, np.ndarray, np.ndarray, np.ndarray | None]]  # columns, rows, centre, scale, inverse of all
    models: list[Model]
    rows_too: bool

    def of(self, x: np.ndarray) -> list[dict]:
        x = widened(x, self.n_numeric, self.sizes)
        scaled: dict = {}
        out = []
        for m in self.models:
            columns, n, center, scale, inverse = self.groups[m.group]
            if m.group not in scaled:
                z = (x[~np.isnan(x[:, columns]).any(1)][:, columns] - center) / scale
                scaled[m.group] = z, None if inverse is None else 1 / n + ((z @ inverse) * z).sum(1)
            z, common = scaled[m.group]
            t = z[:, m.terms]
            e = z[:, m.y] - t @ m.beta
            h = common - e * e / m.sse if m.sse else 1 / n + ((t @ m.inverse) * t).sum(1)
            one = np.concatenate((np.ones((len(z), 1)), t), 1)
            with np.errstate(divide="ignore", invalid="ignore"):
                w = np.where(h < 1, e * e / ((1 - h) * (1 - h)), np.nan)
                far = w * h
            meat = (one * np.nan_to_num(w)[:, None]).T @ one
            s = {"meat": meat[np.triu_indices(len(meat))], "sse": (e * e).sum(), "e4": (e**4).sum(), "q": (e * e) @ one, "far": np.nanmax(far) if len(far) and not np.isnan(far).all() else -np.inf}
            if self.rows_too:
                s["e"] = e
            out.append(s)
        return out

    def merge(self, a: list[dict], b: list[dict]) -> list[dict]:
        return [{k: max(s[k], t[k]) if k == "far" else np.concatenate((s[k], t[k])) if k == "e" else s[k] + t[k] for k in s} for s, t in zip(a, b, strict=True)]
