"""False discovery rates, the gate, ranking, imputation twins and what is said about a finding; windows and joins over result rows."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyweave.operators.results import CUTS, FAMILIES

#: The gate, and where a rank stops growing.
Q_LIMIT, RANK_CAP = 0.05, 1.5
CLOSING = "Exploratory and associational: a hypothesis to test on new data, not evidence of a cause."


def _known(p: Column) -> Column:
    return p.isNotNull() & ~F.isnan(p)


def with_q(results: DataFrame) -> DataFrame:
    """Benjamini-Hochberg q within each family, over the rows that have a p."""
    p = F.col("p_raw")
    part = Window.partitionBy("family", _known(p))
    size = F.count(F.lit(1)).over(part)
    place = F.row_number().over(part.orderBy("p_raw", "seq"))
    out = results.withColumn("__place", place).withColumn("__size", size)
    down = Window.partitionBy("family", _known(p)).orderBy(F.desc("__place")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    q = F.least(F.lit(1.0), F.min(p * F.col("__size") / F.col("__place")).over(down))
    return out.withColumn("q_value", F.when(_known(p), q)).drop("__place", "__size")


def is_candidate(q: Column, magnitude: Column) -> Column:
    return F.coalesce(q < Q_LIMIT, F.lit(False)) & magnitude.isin("medium", "large")


def rank_key(name: Column, value: Column) -> Column:
    """Size of an effect against a large one, capped."""
    large = F.create_map(*(F.lit(v) for k, c in CUTS.items() for v in (k, c[2])))[name]
    return F.when(value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf")), F.least(F.abs(value) / large, F.lit(RANK_CAP))).otherwise(0.0)


def broken(assumptions: Column) -> Column:
    """Whether a critical assumption fails."""
    return F.exists(assumptions, lambda a: ~a["ok"] & a["critical"])


def candidates(results: DataFrame) -> DataFrame:
    """Results that pass the gate, strongest first: route (finding or needs_review), and rank among findings."""
    order = F.create_map(*(F.lit(v) for i, f in enumerate(FAMILIES) for v in (f, i)))[F.col("family")]
    some = results.where(is_candidate(F.col("q_value"), F.col("effect_magnitude")))
    some = some.withColumn("rank_key", rank_key(F.col("effect_name"), F.col("effect_value"))).withColumn("family_order", order).withColumn("route", F.when(broken(F.col("assumptions")), "needs_review").otherwise("finding"))
    rank = F.row_number().over(Window.partitionBy("route").orderBy(F.desc("rank_key"), "family_order", "seq"))  # result rows: a few thousand
    return some.withColumn("rank", F.when(F.col("route") == "finding", rank)).drop("family_order")


def with_twins(some: DataFrame, imputed: DataFrame | None) -> DataFrame:
    """robustness: stable if the same test of the filled frame passes the gate in the same direction."""
    if imputed is None:
        return some.withColumn("robustness", F.lit("stable")).withColumn("twin_q", F.lit(None).cast("double")).withColumn("twin_effect", F.lit(None).cast("double")).withColumn("has_twin", F.lit(False))
    first = Window.partitionBy("family", "kind", "vars").orderBy("seq")
    twin = imputed.withColumn("k", F.row_number().over(first)).where("k = 1").select("family", "kind", "vars", F.col("q_value").alias("twin_q"), F.col("effect_value").alias("twin_effect"), F.col("effect_magnitude").alias("twin_magnitude"), F.col("direction").alias("twin_direction"), F.lit(True).alias("has_twin"))
    out = some.join(twin, ["family", "kind", "vars"], "left")
    same = F.coalesce(F.col("has_twin"), F.lit(False)) & is_candidate(F.col("twin_q"), F.col("twin_magnitude")) & (F.col("twin_direction") == F.col("direction"))
    return out.withColumn("robustness", F.when(same, "stable").otherwise("imputation-sensitive")).withColumn("has_twin", F.coalesce("has_twin", F.lit(False))).drop("twin_magnitude", "twin_direction")


def sensitivity(twins: DataFrame) -> DataFrame:
    """The candidates that filling changes: both q and both effects."""
    return twins.where("robustness = 'imputation-sensitive'").select("family", "vars", F.struct(F.col("q_value").alias("q"), F.col("effect_value").alias("effect")).alias("complete_case"), F.when(F.col("has_twin"), F.struct(F.col("twin_q").alias("q"), F.col("twin_effect").alias("effect"))).alias("imputed"))


def headline() -> Column:
    """One sentence on a result row."""
    a, b = F.col("vars")[0], F.try_element_at("vars", F.lit(2))
    extra = lambda k: F.get_json_object("extra", f"$.{k}")
    value, n = F.col("effect_value"), F.col("n")
    symbol = F.when(F.col("effect_name") == "spearman_rho", "ρ").when(F.col("effect_name") == "cohen_d", "d").when(F.col("effect_name") == "eta_sq", "η²").otherwise("r")
    strength = F.when(F.col("effect_magnitude") == "large", "strongly").otherwise("moderately")
    return (
        F.when(F.col("family") == "correlation", F.format_string("%s and %s are %s %sly correlated (%s = %.2f, n = %d)", a, b, strength, F.col("direction"), symbol, value, n))
        .when(F.col("family") == "group_difference", F.format_string("%s differs between levels of %s (%s, %s = %.2f, n = %d); it is highest for %s", a, b, extra("test"), symbol, value, n, extra("higher_group")))
        .when(F.col("family") == "contingency", F.format_string("%s and %s go together (Cramér's V = %.2f, n = %d)", a, b, value, n))
        .when(F.col("family") == "regression_model", F.format_string("The other columns explain %.0f%% of the variance of %s (adjusted R², n = %d)", value * 100, a, n))
        .otherwise(F.format_string("%s predicts %s beside the other columns (standardised β = %.2f, n = %d)", b, a, value, n))
    )


def caveats(n_total: int) -> Column:
    """What to keep in mind about a result row, as an array."""
    failed = F.transform(F.filter("assumptions", lambda x: ~x["ok"]), lambda x: F.concat(F.lit("Not met: "), x["name"], F.lit(" ("), x["detail"], F.lit(").")))
    one = lambda when, text: F.when(F.coalesce(when, F.lit(False)), F.array(text)).otherwise(F.array().cast("array<string>"))
    return F.concat(
        failed,
        one(~F.col("nonparametric_agrees"), F.lit("The rank test comes to another verdict.")),
        one((F.lit(n_total) > 0) & (F.col("n") < 0.8 * n_total), F.format_string(f"Complete for %d of {n_total} rows only.", F.col("n"))),
        one(F.col("robustness") == "imputation-sensitive", F.lit("The verdict changes when missing values are filled.")),
        one(F.col("note").isNotNull(), F.col("note")),
        F.array(F.lit(CLOSING)),
    )


def all_results(results: DataFrame) -> DataFrame:
    """Every result, smallest q first within its family, those without a q last."""
    return results.orderBy("family", F.col("q_value").asc_nulls_last(), "seq")


def count_tests(results: DataFrame) -> DataFrame:
    return results.groupBy("family").agg(F.count(F.lit(1)).alias("n_tests"))


def entries(twins: DataFrame, n_total: int) -> list[dict]:
    """Findings and entries for review as plain records, strongest first."""
    rows = twins.withColumn("headline", headline()).withColumn("caveats", caveats(n_total)).orderBy(F.desc("rank_key"), "rank", "seq").collect()
    names = ("seq", "family", "kind", "vars", "headline", "effect_name", "effect_value", "effect_magnitude", "direction", "q_value", "p_raw", "n", "robustness", "caveats", "route", "rank")
    return [{k: r[k] for k in names} | {"stats": json.loads(r["extra"])} for r in rows]
