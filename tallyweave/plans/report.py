"""The whole screening: one frame in, one report out (a record, JSON, Markdown, tables)."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field
from datetime import UTC, datetime
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import tallyweave
from tallyweave.functions.text import column
from tallyweave.operators import association, catalog, findings, modelling, models, quality, results, series, shared
from tallyweave.operators.values import value_counts
from tallyweave.plans.batch import kept
from tallyweave.sources.frames import BadInput, Frame, from_csv, from_dataframe

FAMILY_NAMES = {"correlation": "correlations", "group_difference": "group_differences", "contingency": "contingency", "regression_model": "regression_models", "regression_coefficient": "regression_coefficients"}
METHODS = (
    "Each column is classified and summarised, and each applicable pair is tested: numeric pairs by Pearson or Spearman correlation, "
    "numeric by categorical by Welch's t or analysis of variance, categorical pairs by chi-square or Fisher's exact test. Each numeric "
    "column is also modelled by least squares on all others, with HC3 errors. Tests use the rows that are complete for them; if values are "
    "missing, everything is repeated on a copy filled with medians and modes, and verdicts that change are marked. P-values are adjusted "
    "by Benjamini and Hochberg within each family. A finding needs q < 0.05 and at least a medium effect. " + findings.CLOSING
)


@dataclass
class Report:
    """The record of a screening, and its result rows as DataFrames."""

    record: dict
    results: DataFrame
    candidates: DataFrame
    issues: DataFrame
    columns: DataFrame
    markdown: str = field(default="", repr=False)

    def to_json(self) -> str:
        return json.dumps(results.plain(self.record), ensure_ascii=False)

    def write(self, path: str) -> None:
        """The tables as Parquet, the record and the Markdown as text, under ``path`` of any file system."""
        for name in ("results", "candidates", "issues", "columns"):
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")
        spark = self.results.sparkSession
        for name, text in (("report_json", self.to_json()), ("report_markdown", self.markdown)):
            spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/{name}")


def sweep(df: DataFrame | shared.Read, numeric: list[str], categorical: list[str], stats: dict, n_total: int, charts: bool = True, row=None) -> list[dict]:
    """All five families of tests on one frame, in their order."""
    of = df if isinstance(df, shared.Read) else shared.Read(df)
    fitted, terms = models.regressions(of.df, numeric, categorical, n_total, charts, row, of.known)
    return [*association.correlations(of.df, numeric, stats, of.known), *association.group_differences(of.df, numeric, categorical, of.values), *association.contingency(of.df, categorical, None, of.values), *fitted, *terms]


def sweep_of_filled(df: DataFrame | shared.Read, numeric: list[str], categorical: list[str], stats: dict, n_total: int, gappy: set[str], before: list[dict]) -> list[dict]:
    """The same on a copy whose ``gappy`` columns are filled: tests of columns that had no gaps are those of ``before``.

    A test of two columns without gaps reads the same values of the same rows. Models use the rows that have all columns, which
    change with any filled one, so all are made again.
    """
    df, values, known = (df.df, df.values, df.known) if isinstance(df, shared.Read) else (df, None, None)
    filled, whole = [c for c in numeric if c in gappy], [c for c in numeric if c not in gappy]
    cats = [c for c in categorical if c in gappy]
    fitted, terms = models.regressions(df, numeric, categorical, n_total, False, known=known)
    made = association.correlations(df, numeric, stats, known) if filled else []
    if values:
        tested = numeric if cats else filled
        made += association.group_differences(df, tested, categorical, values.only(tested)) + association.contingency(df, categorical, cats, values)
    else:
        made += association.group_differences(df, filled, categorical) + association.group_differences(df, whole, cats) + association.contingency(df, categorical, cats)
    again = {(r["family"], *r["vars"]): r for r in made}
    kept_ = {(r["family"], *r["vars"]): r for r in before if gappy.isdisjoint(r["vars"])}
    pairs = [("correlation", *p) for p in combinations(numeric, 2)] + [("group_difference", a, b) for a in numeric for b in categorical] + [("contingency", *p) for p in combinations(categorical, 2)]
    return [r for k in pairs if (r := kept_.get(k) if gappy.isdisjoint(k[1:]) else again.get(k))] + fitted + terms


def sweeps(df: DataFrame, numeric: list[str], categorical: list[str], imputed: bool = True) -> tuple[list[dict], list[dict]]:
    """The sweep of a frame, and (if asked) that of its filled copy, without plot series and without more of a profile than they ask for."""
    values = value_counts(df, numeric, categorical)
    stats = values.stats() if values else catalog.numeric_stats(df, {c: column(c) for c in numeric})
    n = sum(p.n for p in values.patterns) if values else df.count()
    fills = values.fill_values() if values and imputed else None
    first, second = shared.known(df, values, fills)
    primary = sweep(shared.Read(df, values, first), numeric, categorical, stats, n, charts=False)
    if not imputed:
        return primary, []
    gappy = values.gappy() if values else modelling.gappy(df)
    copy = shared.Read(modelling.imputed(df, numeric, categorical, fills), values and values.filled(fills), second or first)
    return primary, sweep_of_filled(copy, numeric, categorical, stats, n, gappy, primary)


def info() -> dict:
    """What a service would answer when asked whether it is well."""
    return {"status": "ok", "engine": "tallyweave", "version": tallyweave.__version__}


def analyze_csv(spark: SparkSession, path: str, name: str | None = None, most_bytes: int | None = None, **options) -> Report:
    """Screen a CSV file; a service that takes uploads gives its limit as ``most_bytes`` (``frames.UPLOAD_LIMIT_BYTES``)."""
    return analyze(spark, from_csv(spark, path, most_bytes=most_bytes, **options), name or path.rsplit("/", 1)[-1])


def analyze(spark: SparkSession, data: DataFrame | Frame, name: str = "table", rows: bool = True, charts: bool = True) -> Report:
    """Screen a frame. ``rows`` locates issues by row position, which costs a pass that numbers the rows."""
    frame = data if isinstance(data, Frame) else from_dataframe(data, rows)
    frame.df = kept(frame.df, "input")  # every pass reads only the columns it needs from here
    n_rows, columns = catalog.profile(frame)
    if not n_rows:
        raise BadInput("the table has no rows")
    issues = quality.issues_of(frame, n_rows, columns)
    names, beyond = modelling.chosen_columns(frame, columns)
    numeric, categorical = modelling.split(columns, names)
    stats = {p.name: p.stats for p in columns if p.stats}
    row = F.col(frame.row) if frame.row else None  # the position travels along for the influence series
    base = modelling.analysed(frame, columns, names, row)
    work = kept(base, "analysed") if names else base
    values = value_counts(work, numeric, categorical)
    gappy = values.gappy() if values else modelling.gappy(work.select(*map(column, names))) if names else set()
    gaps = bool(gappy)
    fills = values.fill_values() if values else None
    first, second = shared.known(work, values, fills)
    primary = sweep(shared.Read(work, values, first), numeric, categorical, stats, n_rows, charts, row) if names else []
    done = kept(findings.with_q(results.as_frame(spark, primary)), "results")
    filled = None
    if gaps:
        other = kept(modelling.imputed(work, numeric, categorical, fills), "filled")
        copy = shared.Read(other, values and values.filled(fills), second or first)
        filled = kept(findings.with_q(results.as_frame(spark, sweep_of_filled(copy, numeric, categorical, stats, n_rows, gappy, primary))), "filled_results")
    twins = kept(findings.with_twins(findings.candidates(done), filled), "candidates")
    found = findings.entries(twins, n_rows)
    if charts:
        pairs = {e["seq"]: tuple(map(column, e["vars"])) for e in found if e["family"] == "correlation"}
        scatters = series.points_of(work, pairs, series.SCATTER_POINTS, trends=True)
        groups = {e["seq"]: (column(e["vars"][0]), column(e["vars"][1]), [g["level"] for g in primary[e["seq"]]["extra"]["groups"]]) for e in found if e["family"] == "group_difference"}
        drawn = scatters | series.level_boxes(work, groups)
        for e in found:
            e["charts"] = charts_of(e, primary[e["seq"]], drawn.get(e["seq"]))
    types = {k: sum(p.type == k for p in columns) for k in ("numeric", "categorical", "datetime", "excluded")}
    changed = findings.sensitivity(twins).collect()
    tests = {FAMILY_NAMES[f]: sum(r["family"] == f for r in primary) for f in results.FAMILIES}
    q = {r["seq"]: r["q_value"] for r in done.select("seq", "q_value").collect()}
    lean = {v: sorted(({k: x for k, x in r.items() if k != "extra"} | {"q_value": q[i], "extra": {k: x for k, x in r["extra"].items() if not k.endswith("_plot")}} for i, r in enumerate(primary) if r["family"] == f), key=lambda r: (r["q_value"] is None, r["q_value"] or 0.0)) for f, v in FAMILY_NAMES.items()}
    cells = series.correlation_matrix(numeric, done)
    lean["correlation_matrix"] = cells and {"columns": numeric[: series.MATRIX_COLUMNS], "cells": [c.asDict() for c in cells.orderBy("i", "j").collect()], "truncated": len(numeric) > series.MATRIX_COLUMNS}
    record = results.plain(
        {
            "meta": {"filename": name, "n_rows": n_rows, "n_cols": len(frame.columns), "generated_at": datetime.now(UTC).isoformat(timespec="seconds"), "tool_version": tallyweave.__version__},
            "profile": {"columns": [{k: v for k, v in asdict(p).items() if k != "unique_ratio"} for p in columns], "type_counts": types},
            "data_quality": {"score": quality.score_of(issues), "summary": quality.summary_of(issues), "issues": issues, "row_id_column": catalog.identifier_column(columns)},
            "sweep": {"n_tests": tests, "column_cap": modelling.MOST_COLUMNS, "column_cap_applied": bool(beyond), "excluded_columns": beyond, "missing_data_handling": "pairwise deletion and a filled copy" if gaps else "nothing is missing"},
            "findings": [{k: v for k, v in e.items() if k not in ("seq", "route")} for e in found if e["route"] == "finding"],
            "needs_review": [{k: v for k, v in e.items() if k not in ("seq", "route", "rank")} for e in found if e["route"] == "needs_review"],
            "imputation_sensitivity": {"applicable": gaps, "changed_count": len(changed), "details": [r.asDict(True) for r in changed]},
            "all_results": lean,
            "methodology": METHODS,
        }
    )
    report = Report(record, done, twins, quality.as_frame(spark, issues), catalog.as_frame(spark, columns))
    report.markdown = record["report_markdown"] = markdown(record)
    return report


def charts_of(entry: dict, made: dict, s) -> list[dict]:
    """The plot series of one finding; ``s`` is the scatter of a correlation or the boxes of a group difference."""
    a, b = [*entry["vars"], None][:2]
    extra = made["extra"]
    if entry["family"] == "correlation":
        return [{"type": "scatter", "x": a, "y": b, "kind": entry["kind"]} | s | ({"trend": None} if entry["kind"] == "spearman" else {})] if s else []
    if entry["family"] == "group_difference":
        return [{"type": "box", "num": a, "cat": b, "groups": s, "higher_group": extra["higher_group"]}] if s else []
    if entry["family"] == "contingency":
        s = series.contingency_series({(r, c): n for r, own in extra["table"].items() for c, n in own.items() if n}, a, b)
        return [{"type": "contingency"} | s] if s else []
    plots = {"resid_plot": {"type": "residual", "outcome": a, "bp_p": extra.get("bp_p")}, "influence_plot": {"type": "influence", "outcome": a}, "avp_plot": {"type": "added_variable", "outcome": a, "term": b}}
    return [head | extra[k] for k, head in plots.items() if extra.get(k)]


#: Signs that would end a cell or escape its end.
_ESCAPED = str.maketrans({"|": "\\|", "\\": "\\\\"})


def _table(head: list, rows: list[list]) -> list[str]:
    """A Markdown table: white space in a cell is one blank, bars and backslashes are escaped, what is not there is a dash."""
    lines = []
    for cells in (head, *rows):
        told = ("–" if c is None else " ".join(str(c).split()).translate(_ESCAPED) for c in cells)
        lines.append(f"| {' | '.join(told)} |")
    lines.insert(1, "|" + " --- |" * len(head))
    return lines


def _number(v, digits: int = 2) -> str:
    return "–" if v is None else f"{v:.{digits}f}"


def _where(issue: dict, identifier: str | None) -> str:
    """Where an issue is, in a few words."""
    places = issue.get("locations") or []
    if not places:
        return ""
    named = [f"{identifier} {p['id']}" if identifier and p["id"] is not None else f"row {p['row']}" for p in places]
    shown = [f"{n} ({p['value']:g})" if p["value"] is not None else n for n, p in zip(named, places, strict=True)]
    return ", ".join(shown) + (f" and {issue['location_more']} more" if issue.get("location_more") else "")


def _chart_lines(chart: dict) -> list[str]:
    if chart["type"] == "contingency":
        return ["", *_table([f"{chart['row_var']} by {chart['col_var']}", *chart["cols"], "all"], [[r, *c, t] for r, c, t in zip(chart["rows"], chart["counts"], chart["row_totals"], strict=True)]), ""]
    if chart["type"] == "box":
        return ["", *_table([chart["cat"], "n", f"median of {chart['num']}", "quartiles"], [[g["level"], g["n"], _number(g["median"]), f"{_number(g['q1'])} to {_number(g['q3'])}"] for g in chart["groups"]]), ""]
    if chart["type"] == "influence" and chart["n_above"]:
        return [f"  - {chart['n_above']} of {chart['n']} rows lie above 4/n in Cook's distance (largest {_number(chart['max'], 3)})."]
    if chart["type"] == "added_variable":
        return [f"  - With the others held constant, the slope of {chart['term']} is {_number(chart['slope'], 3)}."]
    return []


def markdown(record: dict) -> str:
    """The record as a Markdown document."""
    meta, dq, tests = record["meta"], record["data_quality"], record["sweep"]
    out = [f"# Screening of {meta['filename']}", "", f"{meta['n_rows']} rows, {meta['n_cols']} columns; made {meta['generated_at']} by version {meta['tool_version']}.", "", "## Data quality", "", f"Score **{dq['score']}** of 100 ({dq['summary']}).", ""]
    for i in dq["issues"]:
        out.append(f"- **{i['severity']}** {i['message']}")
        if where := _where(i, dq["row_id_column"]):
            out.append(f"  - {where}")
    out += ["", "## Findings", ""]
    if not record["findings"]:
        out += ["No result is both significant and of at least medium size.", ""]
    for f in record["findings"]:
        out += [f"### {f['rank']}. {f['headline']}", "", f"q = {f['q_value']:.3g}; {f['effect_name']} = {f['effect_value']:.3f} ({f['effect_magnitude']}); {f['robustness']}", *(f"  - {c}" for c in f["caveats"])]
        for chart in f.get("charts", []):
            out += _chart_lines(chart)
        out.append("")
    if record["needs_review"]:
        out += ["## For review", "", "Significant and sizeable, but an assumption that the result rests on does not hold.", "", *(f"- {f['headline']}: {' '.join(f['caveats'][:2])}" for f in record["needs_review"]), ""]
    if record["imputation_sensitivity"]["applicable"]:
        out += ["## Filling gaps", "", f"{record['imputation_sensitivity']['changed_count']} verdict(s) change when missing values are filled.", ""]
    shown = [c for c in record["profile"]["columns"] if (c["stats"] or {}).get("histogram")]
    if shown:
        width = max(len(c["name"]) for c in shown)
        out += ["## Distributions", "", "```"]
        for c in shown:
            h = c["stats"]["histogram"]
            far = h["n_below"] + h["n_above"]
            out.append(f"{c['name']:<{width}} {series.sparkline_text(h['counts'])} {_number(h['bin_edges'][0])} to {_number(h['bin_edges'][-1])}" + (f", {far} beyond" if far else ""))
        out += ["```", ""]
    matrix = record["all_results"]["correlation_matrix"]
    if matrix:
        value = {(c["i"], c["j"]): c["value"] for c in matrix["cells"]}
        cols = matrix["columns"]
        out += ["## Correlations", "", *_table(["", *cols], [[c, *(_number(value[min(i, j), max(i, j)]) if (min(i, j), max(i, j)) in value else "" for j in range(len(cols)))] for i, c in enumerate(cols)]), ""]
    out += ["## Tests", "", *(f"- {k.replace('_', ' ')}: {v}" for k, v in tests["n_tests"].items())]
    if tests["excluded_columns"]:
        out.append(f"- beyond the cap of {tests['column_cap']} columns: {', '.join(tests['excluded_columns'])}")
    return "\n".join([*out, "", "## Methods", "", record["methodology"], ""])
