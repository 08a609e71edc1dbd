"""What correlations and models read of a frame and of its filled copy, from one scan of the frame, and from a second one for residuals."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from tallyweave.operators import matrix, models
from tallyweave.operators.association import moments_of, rhos_of
from tallyweave.operators.values import Values


@dataclass
class Known:
    """Moments and rank correlations (None: not known) of all pairs, and the columns that models read with their products."""

    moments: dict[tuple[str, str], dict]
    rhos: dict[tuple[str, str], tuple[int, float | None]] | None
    wide: matrix.Wide
    gram: models.Gram
    sums: dict[str, dict] | None = None  # of the residuals of each numeric column's model on all others


@dataclass
class Read:
    """A frame with the counts of its values and what shared scans found of it, if any."""

    df: DataFrame
    values: Values | None = None
    known: Known | None = None


def known(df: DataFrame, values: Values | None, fills: dict[str, object] | None) -> tuple[Known | None, Known | None]:
    """Of the frame, and with ``fills`` of its copy that is filled by these.

    None of both without the counts of values, and where a missing level would be taken for a level named nan.
    """
    if not values or any({None, "nan"} <= {p.levels[c] for p in values.patterns} for c in range(len(values.categorical))):
        return None, None
    filled = values.filled(fills or {})
    numeric, k = values.numeric, len(values.numeric)
    met = [[sorted({"nan" if p.levels[c] is None else p.levels[c] for p in v.patterns}) for c in range(len(v.categorical))] for v in (values, filled)]
    wide = [models.widen(df, numeric, values.categorical, own) for own in met]
    codes = []
    for c in range(len(values.categorical)):
        becomes = {"nan" if p.levels[c] is None else p.levels[c]: "nan" if q.levels[c] is None else q.levels[c] for p, q in zip(values.patterns, filled.patterns, strict=True)}
        codes.append(np.array([met[1][c].index(becomes[v]) for v in met[0][c]], np.float64))
    ranks = values.rank_kernels(filled) or (None, None)
    parts = [[(matrix.Pairs(), k), (models.scatter_of(w, [w.keys]), len(w.inputs))] + ([(r, k)] if r else []) for w, r in zip(wide, ranks, strict=True)]
    if not fills:
        state = matrix.fold(df, wide[0].inputs, matrix.Several(parts[0]))
        return _known(values, wide[0], state, ranks[0] is not None), None
    values_of, width = [float(filled.fills.get(c, np.nan)) for c in numeric], len(wide[0].inputs)
    copy = matrix.Filled(matrix.Several(parts[1]), values_of, codes)
    *own, other = matrix.fold(df, wide[0].inputs, matrix.Several([*parts[0], (copy, width)]))
    first, second = (_known(values, w, s, ranks[0] is not None) for w, s in zip(wide, (own, other), strict=True))
    kernels = [models.residuals_of_all(x.wide, x.gram) for x in (first, second)]
    if all(kernels):
        both = matrix.fold(df, wide[0].inputs, matrix.Several([(kernels[0], width), (matrix.Filled(kernels[1], values_of, codes), width)]))
        first.sums, second.sums = (dict(zip(numeric, s, strict=True)) for s in both)
    return first, second


def _known(values: Values, wide: matrix.Wide, state: list, ranked: bool) -> Known:
    numeric = values.numeric
    return Known(moments_of(numeric, state[0]), rhos_of(numeric, state[2]) if ranked else None, wide, models.grams_of([wide.keys], state[1])[0])
