"""Registered queries of the statistical engine, each over whole tables, and the SQL they are held against.

Most run over one fixture: lineitem with deterministic gaps, planted effects and categories,
written once in SQL that Spark and DuckDB share.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.functions import special
from tallyweave.functions.text import as_number, column, filled, identifier_name, looks_dated, looks_numeric, share
from tallyweave.operators import association, catalog, findings, modelling, models, quality, results, series
from tallyweave.operators.quantiles import quantiles
from tallyweave.plans import report
from tallyweave.plans.batch import kept, total
from tallyweave.sources.frames import from_dataframe, raw_csv

MIXED = """SELECT l_orderkey, l_linenumber, l_quantity AS qty, CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_extendedprice END AS price,
 l_discount AS disc, CASE WHEN l_quantity > 45 AND l_orderkey % 3 = 0 THEN NULL ELSE l_tax END AS tax, 2 * l_quantity + 50 * l_tax + l_linenumber AS planted,
 l_quantity + CASE WHEN l_linestatus = 'O' THEN 10 ELSE 0 END AS score, CASE WHEN l_orderkey % 97 = 0 THEN l_extendedprice * 20 ELSE l_extendedprice END AS wild,
 l_returnflag AS flag, l_linestatus AS status, CASE WHEN l_orderkey % 10 = 0 THEN l_linestatus ELSE l_returnflag END AS echo,
 CASE WHEN l_orderkey % 11 = 0 THEN NULL ELSE l_returnflag END AS holed, CASE WHEN l_orderkey % 500 = 0 THEN 'b' ELSE 'a' END AS near_constant FROM {lineitem}"""
TEXTS = """SELECT o_orderkey AS k, CASE WHEN o_orderkey % 13 = 0 THEN 'none' WHEN o_orderkey % 17 = 0 THEN ' ' ELSE CAST(CAST(o_orderkey AS BIGINT) AS STRING) END AS plain,
 CASE WHEN o_orderkey >= 1000 THEN concat(CAST(CAST(floor(o_orderkey / 1000) AS BIGINT) AS STRING), ',', lpad(CAST(CAST(o_orderkey % 1000 AS BIGINT) AS STRING), 3, '0')) ELSE CAST(CAST(o_orderkey AS BIGINT) AS STRING) END AS commas,
 CASE WHEN o_orderkey % 5 = 0 THEN 'soon' ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END AS dated FROM {orders}"""
NUMERIC, CATEGORICAL = ["qty", "price", "disc", "tax", "planted", "score", "wild"], ["flag", "status", "echo", "holed"]
_COLS = [*NUMERIC, *CATEGORICAL]
_TABLES = ("lineitem", "orders", "events", "documents", "labels", "part", "customer")

_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_oracles: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        _queries[f.__name__] = f
        if sql:
            _oracles[f.__name__] = sql
        return f

    return keep


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _from(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return spark.sql(sql, **{t: _table(spark, sf_dir, t) for t in _TABLES if f"{{{t}}}" in sql})


def _mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _from(spark, sf_dir, MIXED)


def _duck(sql: str) -> str:
    return sql.format(**{t: t for t in _TABLES}).replace("AS STRING", "AS VARCHAR")


M, T = f"m AS ({_duck(MIXED)})", f"t AS ({_duck(TEXTS)})"


def _r(c, digits: int = 6):
    return (F.round(c, digits) + F.lit(0.0)).cast("double")


def _long(parts: list[str]) -> str:
    return " UNION ALL ".join(parts)


def _rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A frame of driver results, NaN as null."""
    return spark.createDataFrame([tuple(results.plain(list(r))) for r in rows], schema)


def with_p(ctes: str, tests: str, select: str) -> str:
    """DuckDB SQL with p-values: ``tests`` has id, kind (t, f, chi2, z), stat, d1, d2; ``select`` may join pv(id, p).

    Tails of the beta and gamma families are integrated by Simpson's rule after a substitution
    that takes the singular ends away.
    """
    return f"""WITH {ctes}, tests AS ({tests}),
prm AS (SELECT id, CASE WHEN kind IN ('t', 'f') THEN 'b' ELSE 'g' END AS fam, CASE kind WHEN 't' THEN d2 / 2 WHEN 'f' THEN d2 / 2 WHEN 'chi2' THEN d1 / 2 ELSE 0.5 END::DOUBLE AS a,
 CASE kind WHEN 'f' THEN d1 / 2 ELSE 0.5 END::DOUBLE AS b,
 CASE kind WHEN 't' THEN asin(sqrt(d2 / (d2 + stat * stat))) WHEN 'f' THEN asin(sqrt(d2 / (d2 + d1 * stat))) WHEN 'chi2' THEN sqrt(stat / 2) ELSE abs(stat) / sqrt(2.0::DOUBLE) END AS u FROM tests),
lim AS (SELECT *, CASE WHEN fam = 'b' THEN greatest(0, u - 14 / sqrt(2 * a)) ELSE 0 END AS lo FROM prm),
grid AS (SELECT id, fam, a, b, u - lo AS h, lo + (u - lo) * i / 4000.0::DOUBLE AS s, CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END AS w FROM lim, range(4001) r(i)),
integ AS (SELECT id, fam, sum(w * h / 12000.0::DOUBLE * CASE WHEN fam = 'b' THEN CASE WHEN s = 0 THEN CASE WHEN a = 0.5 THEN exp(lgamma(a + b) - lgamma(a) - lgamma(b)) ELSE 0 END
 ELSE exp(lgamma(a + b) - lgamma(a) - lgamma(b) + (2 * a - 1) * ln(sin(s)) + CASE WHEN b = 0.5 THEN 0 ELSE (2 * b - 1) * ln(greatest(cos(s), 1e-300)) END) END
 ELSE CASE WHEN s = 0 THEN CASE WHEN a = 0.5 THEN exp(-lgamma(a)) ELSE 0 END ELSE exp(-lgamma(a) + (2 * a - 1) * ln(s) - s * s) END END) AS v FROM grid GROUP BY id, fam),
pv AS (SELECT id, greatest(0, least(1, CASE WHEN fam = 'b' THEN 2 * v ELSE 1 - 2 * v END)) AS p FROM integ) {select}"""


# sources and scalar functions


_NOTE = """CASE WHEN o_orderkey % 3 = 0 THEN 'say "' || o_orderstatus || '", twice' WHEN o_orderkey % 3 = 1 THEN 'first' || chr(10) || 'second ' || o_orderstatus ELSE o_orderstatus END"""
_PRICE = "CAST(CAST(o_totalprice AS DECIMAL(18, 2)) AS STRING)"


_CODE, _TAIL = "CAST(CAST(o_orderkey AS BIGINT) % 10 AS STRING) || CASE WHEN o_orderkey % 2 = 0 THEN 'd' ELSE 'f' END", "CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(CAST(o_orderkey AS BIGINT) % 7 AS STRING) END"
_VARCHAR = {k: v.replace("STRING", "VARCHAR") for k, v in {"price": _PRICE, "code": _CODE, "tail": _TAIL}.items()}


@query(f"SELECT o_orderkey, round(CAST({_VARCHAR['price']} AS DOUBLE), 2) AS o_totalprice, o_orderstatus, {_NOTE} AS note, {_VARCHAR['code']} AS code, CAST({_VARCHAR['tail']} AS BIGINT) AS tail FROM orders")
def scan_csv_typed(spark, sf_dir):
    """Row 1: the orders with quotes and line breaks, codes that end in d or f and a last field that may be empty, written as CSV in the shared
    folder, read again with inferred types."""
    return _csv(spark, sf_dir)[0]


@query(f"SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, {_VARCHAR['price']} AS o_totalprice, o_orderstatus, {_NOTE} AS note, {_VARCHAR['code']} AS code, coalesce({_VARCHAR['tail']}, '') AS tail FROM orders")
def scan_raw(spark, sf_dir):
    """Row 2: the same file, every field as text."""
    return _csv(spark, sf_dir)[1]


def _csv(spark, sf_dir):
    import uuid

    from tallyweave.sources.frames import from_csv

    orders = kept(_table(spark, sf_dir, "orders").selectExpr("o_orderkey", f"{_PRICE} AS o_totalprice", "o_orderstatus", f"{_NOTE} AS note", f"{_CODE} AS code", f"{_TAIL} AS tail"), "orders")
    path = f"{orders.inputFiles()[0].rsplit('/', 1)[0]}-csv-{uuid.uuid4().hex}"
    orders.write.options(header=True, escape='"').csv(path)
    frame = from_csv(spark, path, rows=False)
    return frame.df.select(*frame.columns), raw_csv(spark, path)


@query("SELECT k, coalesce(v = 0, false) AS dropped FROM (SELECT event_id AS k, CASE WHEN event_id % 3 = 0 THEN 0 ELSE 1 END AS v FROM events)")
def json_sanitize(spark, sf_dir):
    """Row 9: numbers without a JSON form become null before they are written."""
    x = F.when(F.col("event_id") % 3 == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    made = _table(spark, sf_dir, "events").select(F.col("event_id").alias("k"), F.to_json(F.struct(series.finite(x).alias("v"))).alias("j"))
    return made.select("k", F.get_json_object("j", "$.v").isNull().alias("dropped"))


@query(f"WITH {T} SELECT k, regexp_matches(trim(plain), '^[+-]?(\\d{{1,3}}(,\\d{{3}})+|\\d+)(\\.\\d+)?([eE][+-]?\\d+)?$') AS plain_ok, regexp_matches(trim(commas), '^[+-]?(\\d{{1,3}}(,\\d{{3}})+|\\d+)(\\.\\d+)?([eE][+-]?\\d+)?$') AS commas_ok FROM t")
def numeric_text_predicate(spark, sf_dir):
    return _from(spark, sf_dir, TEXTS).select("k", looks_numeric(F.col("plain")).alias("plain_ok"), looks_numeric(F.col("commas")).alias("commas_ok"))


@query(f"WITH {T} SELECT round(sum(CASE WHEN trim(plain) <> '' AND regexp_matches(trim(plain), '^\\d+$') THEN 1 ELSE 0 END)::DOUBLE / sum(CASE WHEN trim(plain) <> '' THEN 1 ELSE 0 END), 6) AS share FROM t")
def text_numeric_fraction(spark, sf_dir):
    t = F.col("plain")
    return _from(spark, sf_dir, TEXTS).agg(_r(share(looks_numeric(t), filled(t))).alias("share"))


@query(f"WITH {T} SELECT round(avg(CASE WHEN dated = 'soon' THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END), 6) AS share FROM t")
def datetime_fraction(spark, sf_dir):
    t = F.col("dated")
    return _from(spark, sf_dir, TEXTS).agg(_r(share(looks_dated(t), filled(t))).alias("share"))


@query(f"WITH {T} SELECT k, try_cast(replace(trim(plain), ',', '') AS DOUBLE) AS plain, try_cast(replace(trim(commas), ',', '') AS DOUBLE) AS commas FROM t")
def coerce_numeric_text(spark, sf_dir):
    return _from(spark, sf_dir, TEXTS).select("k", as_number(F.col("plain")).alias("plain"), as_number(F.col("commas")).alias("commas"))


@query(f"WITH {M} SELECT l_orderkey, l_linenumber, CAST(holed AS VARCHAR) AS level FROM m")
def cast_categorical(spark, sf_dir):
    return _mixed(spark, sf_dir).select("l_orderkey", "l_linenumber", modelling.category(F.col("holed")).alias("level"))


_NAMES = "CASE n_nationkey % 9 WHEN 0 THEN n_name || '_id' WHEN 1 THEN 'the' || n_name || 'Id' WHEN 2 THEN n_name || ' Account No' WHEN 3 THEN 'video ' || n_name WHEN 4 THEN n_name || ' body mass index' WHEN 5 THEN 'UUID.' || n_name WHEN 6 THEN n_name || 'id' WHEN 7 THEN 'paid ' || n_name || ' idea' ELSE lower(n_name) || 'OrderId' END"


@query(f"""WITH n AS (SELECT {_NAMES} AS name FROM nation), w AS (SELECT name, regexp_extract_all(lower(regexp_replace(name, '([a-z])([A-Z])', '\\1 \\2', 'g')), '[a-z0-9]+') AS w FROM n)
SELECT name, list_has_any(w, ['id', 'uuid', 'guid', 'identifier']) OR regexp_matches(array_to_string(w, ' '), 'student id|user id|order id|record id|customer id|account number|account no|row id|index') AS looks_like_id FROM w""")
def id_name_heuristic(spark, sf_dir):
    """Row 19: names made of the nations' names."""
    names = [r[0] for r in _table(spark, sf_dir, "nation").selectExpr(f"{_NAMES} AS name").collect()]  # 25 names of columns
    return spark.createDataFrame([(n, identifier_name(n)) for n in names], "name string, looks_like_id boolean")


@query("SELECT count(*) FILTER (event_id % 5 > 1) AS kept, count(*) AS n FROM events")
def finite_filter(spark, sf_dir):
    k = F.col("event_id") % 5
    x = F.when(k == 0, F.lit(float("nan"))).when(k == 1, F.lit(float("-inf"))).otherwise(F.col("value"))
    return _table(spark, sf_dir, "events").agg(F.count(series.finite(x)).alias("kept"), F.count(F.lit(1)).alias("n"))


@query("SELECT l_linenumber, round(l_discount, 6) AS value, CASE WHEN l_discount * 10 < 0.1 THEN 'none' WHEN l_discount * 10 < 0.3 THEN 'small' WHEN l_discount * 10 < 0.5 THEN 'medium' ELSE 'large' END AS r, CASE WHEN l_discount * 10 < 0.2 THEN 'none' WHEN l_discount * 10 < 0.5 THEN 'small' WHEN l_discount * 10 < 0.8 THEN 'medium' ELSE 'large' END AS d FROM lineitem")
def effect_magnitude(spark, sf_dir):
    x = F.col("l_discount") * 10
    return _table(spark, sf_dir, "lineitem").select("l_linenumber", _r(F.col("l_discount")).alias("value"), results.magnitude_column(F.lit("r"), x).alias("r"), results.magnitude_column(F.lit("cohen_d"), x).alias("d"))


@query("SELECT greatest(0.0::DOUBLE, least(100.0::DOUBLE, round_even(100 - sum(CASE severity WHEN 'high' THEN 15.0::DOUBLE WHEN 'medium' THEN 6.0::DOUBLE ELSE 1.5::DOUBLE END), 1)))::DOUBLE AS score FROM (SELECT CASE WHEN count(*) % 11 = 0 THEN 'high' WHEN count(*) % 11 = 1 THEN 'medium' ELSE 'low' END AS severity FROM part GROUP BY p_brand)")
def quality_score(spark, sf_dir):
    """Row 81: an issue for each brand, its severity by the brand's parts."""
    n = F.count(F.lit(1)) % 11
    kind = F.when(n == 0, "high").when(n == 1, "medium").otherwise("low")
    return quality.score_frame(_table(spark, sf_dir, "part").groupBy("p_brand").agg(kind.alias("severity")))


@query(f"WITH {M}, c AS (SELECT echo, count(*)::DOUBLE AS n FROM m GROUP BY echo) SELECT round(-sum(n / s * ln(n / s + 1e-12)), 6) AS entropy FROM c, (SELECT sum(n) AS s FROM c)")
def category_entropy(spark, sf_dir):
    return modelling.entropy(_mixed(spark, sf_dir).groupBy("echo").count()).select(_r("entropy").alias("entropy"))


@query("SELECT l_linenumber, string_agg(substring('▁▂▃▄▅▆▇█', round_even(n * 7.0::DOUBLE / top, 0)::INT + 1, 1), '' ORDER BY f, s) AS spark FROM (SELECT *, max(n) OVER (PARTITION BY l_linenumber) AS top FROM (SELECT l_linenumber, l_returnflag AS f, l_linestatus AS s, count(*) AS n FROM lineitem GROUP BY ALL)) GROUP BY l_linenumber")
def sparkline(spark, sf_dir):
    n = _table(spark, sf_dir, "lineitem").groupBy("l_linenumber", "l_returnflag", "l_linestatus").count()
    counts = F.transform(F.array_sort(F.collect_list(F.struct("l_returnflag", "l_linestatus", "count"))), lambda x: x["count"])
    return n.groupBy("l_linenumber").agg(counts.alias("c")).select("l_linenumber", series.sparkline(F.col("c")).alias("spark"))


# filters


@query(f"WITH {M} SELECT l_orderkey, l_linenumber, price, tax FROM m WHERE price IS NOT NULL AND tax IS NOT NULL")
def pairwise_deletion(spark, sf_dir):
    return _mixed(spark, sf_dir).select("l_orderkey", "l_linenumber", "price", "tax").dropna(subset=["price", "tax"])


@query(f"WITH {M} SELECT count(*) AS n, count(holed) AS with_level FROM m WHERE qty IS NOT NULL AND price IS NOT NULL AND tax IS NOT NULL")
def listwise_deletion(spark, sf_dir):
    return models.design(_mixed(spark, sf_dir), "qty", ["price", "tax"], ["holed"]).df.agg(F.count(F.lit(1)).alias("n"), F.count("holed").alias("with_level"))


@query(f"WITH {M} SELECT count(*) AS n FROM m WHERE price IS NULL OR tax IS NULL OR holed IS NULL")
def missing_rows(spark, sf_dir):
    frame = from_dataframe(_mixed(spark, sf_dir).select("price", "tax", "holed"), rows=True)
    issues = quality.issues_of(frame, *catalog.profile(frame))
    return _rows(spark, [(i["location_count"],) for i in issues if i["kind"] == "missing_rows"], "n bigint")


@query(f"WITH {M}, k AS (SELECT flag, status FROM m WHERE price IS NOT NULL GROUP BY ALL HAVING count(*) >= 3) SELECT flag, status, count(*) AS n FROM m SEMI JOIN k USING (flag, status) WHERE price IS NOT NULL GROUP BY ALL")
def group_level_semi_filter(spark, sf_dir):
    levels = association.level_moments(_mixed(spark, sf_dir).withColumn("both", F.concat("flag", F.lit("|"), "status")), ["price"], "both")["price"]
    return spark.createDataFrame([(*v.split("|"), m["n"]) for v, m in levels.items()], "flag string, status string, n bigint")


_Q = "q AS (SELECT quantile_cont(wild, 0.25) AS q1, quantile_cont(wild, 0.75) AS q3 FROM m)"


@query(f"WITH {M}, {_Q} SELECT l_orderkey, l_linenumber, round(wild, 4) AS wild FROM m, q WHERE wild < q1 - 1.5 * (q3 - q1) OR wild > q3 + 1.5 * (q3 - q1)")
def tukey_outliers(spark, sf_dir):
    d = _mixed(spark, sf_dir)
    q1, _, q3 = quantiles(d, {"x": F.col("wild")}, [0.25, 0.5, 0.75])["x"]
    return d.where(quality.beyond(F.col("wild"), q1, q3, 1.5)).select("l_orderkey", "l_linenumber", _r("wild", 4).alias("wild"))


@query(f"WITH {M} " + _long([f"SELECT '{a}' AS a, '{b}' AS b, count(*) AS n, min({a})::DOUBLE AS least_a, max({b})::DOUBLE AS most_b FROM m WHERE {a} IS NOT NULL AND {b} IS NOT NULL" for i, a in enumerate(NUMERIC) for b in NUMERIC[i + 1 :]]))
def column_pairs(spark, sf_dir):
    """Row 38: every pair of numeric columns, each over the rows that have both."""
    got = association.pair_moments(_mixed(spark, sf_dir), NUMERIC)
    return spark.createDataFrame([(a, b, m["n"], m["x0"], m["y1"]) for (a, b), m in got.items()], "a string, b string, n bigint, least_a double, most_b double")


@query(f"WITH {M} " + _long([f"SELECT '{a}' AS num, '{b}' AS cat, sum(n)::BIGINT AS n, count(*) AS n_levels FROM (SELECT count({a}) AS n FROM m WHERE {b} IS NOT NULL GROUP BY {b} HAVING count({a}) >= 3) HAVING count(*) BETWEEN 2 AND 20" for a in NUMERIC for b in CATEGORICAL]))
def num_cat_pairs(spark, sf_dir):
    """Row 39: every numeric column with every categorical one that has levels enough for a test."""
    made = association.group_differences(_mixed(spark, sf_dir).select(*NUMERIC, *CATEGORICAL), NUMERIC, CATEGORICAL)
    return spark.createDataFrame([(*r["vars"], r["n"], len(r["extra"]["groups"])) for r in made], "num string, cat string, n bigint, n_levels bigint")


# profiling


def _profile_frame(spark, sf_dir):
    return from_dataframe(_mixed(spark, sf_dir).select(*NUMERIC, *CATEGORICAL))




@query(f"WITH {M} " + _long([f"SELECT '{c}' AS name, count(*) - count({c}) AS n_missing, round_even((count(*) - count({c}))::DOUBLE / count(*), 4) AS pct FROM m" for c in _COLS]))
def profile_missing(spark, sf_dir):
    d = _mixed(spark, sf_dir)
    got = total(d, {"": F.count(F.lit(1))} | {c: F.count(column(c)) for c in _COLS})
    return _rows(spark, [(c, got[""] - got[c], round((got[""] - got[c]) / got[""], 4)) for c in _COLS], "name string, n_missing bigint, pct double")


@query(f"WITH {M} " + _long([f"SELECT '{c}' AS name, count(DISTINCT {c}) AS n_unique FROM m" for c in _COLS]))
def profile_unique(spark, sf_dir):
    return catalog.distinct_counts(_mixed(spark, sf_dir), {c: column(c) for c in _COLS}).select("name", "n_unique")


@query(f"WITH {M} " + _long([f"SELECT '{c}' AS name, max(n) AS top FROM (SELECT count(*) AS n FROM m WHERE {c} IS NOT NULL GROUP BY {c})" for c in _COLS]))
def profile_top_frac(spark, sf_dir):
    return catalog.distinct_counts(_mixed(spark, sf_dir), {c: column(c) for c in _COLS}).select("name", "top")


@query(f"WITH {M} " + _long([f"SELECT '{c}' AS name, round(min({c}), 4) AS low, round(max({c}), 4) AS high, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS sd FROM m" for c in NUMERIC]))
def numeric_moments(spark, sf_dir):
    d = _mixed(spark, sf_dir)
    got = total(d, {(c, k): f(column(c)) for c in NUMERIC for k, f in (("low", F.min), ("high", F.max), ("mean", F.avg), ("sd", F.stddev_samp))})
    return _rows(spark, [(c, *(got[c, k] for k in ("low", "high", "mean", "sd"))) for c in NUMERIC], "name string, low double, high double, mean double, sd double").select("name", *(_r(k, 4).alias(k) for k in ("low", "high", "mean", "sd")))


@query(f"WITH {M} " + _long([f"SELECT '{c}' AS name, round(quantile_cont({c}, 0.25), 4) AS q1, round(quantile_cont({c}, 0.5), 4) AS median, round(quantile_cont({c}, 0.75), 4) AS q3 FROM m" for c in NUMERIC]))
def numeric_quantiles(spark, sf_dir):
    got = quantiles(_mixed(spark, sf_dir), {c: column(c) for c in NUMERIC}, [0.25, 0.5, 0.75])
    return _rows(spark, [(c, *map(float, got[c])) for c in NUMERIC], "name string, q1 double, median double, q3 double").select("name", *(_r(k, 4).alias(k) for k in ("q1", "median", "q3")))


@query(f"WITH {M} " + _long([f"SELECT '{c}' AS name, round(skewness({c}), 6) AS skew FROM m" for c in NUMERIC]))
def numeric_skew(spark, sf_dir):
    got = total(_mixed(spark, sf_dir), {c: catalog.adjusted_skew(column(c)) for c in NUMERIC})
    return _rows(spark, list(got.items()), "name string, skew double").select("name", _r("skew").alias("skew"))


@query(f"WITH {M} " + _long([f"SELECT '{c}' AS name, round(kurtosis({c}), 6) AS kurtosis FROM m" for c in NUMERIC]))
def numeric_kurtosis(spark, sf_dir):
    got = total(_mixed(spark, sf_dir), {c: catalog.adjusted_kurtosis(column(c)) for c in NUMERIC})
    return _rows(spark, list(got.items()), "name string, kurtosis double").select("name", _r("kurtosis").alias("kurtosis"))


@query(f"WITH {M}, {_Q} SELECT count(*) FILTER (wild < q1 - 3 * (q3 - q1) OR wild > q3 + 3 * (q3 - q1)) AS n3, count(*) FILTER (wild < q1 - 5 * (q3 - q1) OR wild > q3 + 5 * (q3 - q1)) AS n5 FROM m, q")
def outlier_counts(spark, sf_dir):
    s = catalog.numeric_stats(_mixed(spark, sf_dir), {"wild": F.col("wild")})["wild"]
    return _rows(spark, [(s["n_outliers_3iqr"], s["n_outliers_5iqr"])], "n3 bigint, n5 bigint")


_V = "v AS (SELECT event_id, CASE WHEN event_id % 400 = 7 THEN value * 1000 + 1000 ELSE value END AS value FROM events)"


@query(f"WITH {_V}, q AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM v), o AS (SELECT event_id, value, row_number() OVER (ORDER BY event_id) AS r FROM v) SELECT r AS row, CAST(event_id AS VARCHAR) AS id, round(value, 4) AS value FROM o, q WHERE value < q1 - 5 * (q3 - q1) OR value > q3 + 5 * (q3 - q1) ORDER BY r LIMIT 15")
def outlier_locations(spark, sf_dir):
    """Rows 42, 53, 84: the first fifteen extreme values, with position and identifier (the limit is the feature)."""
    k = F.col("event_id")
    d = _table(spark, sf_dir, "events").select("event_id", F.when(k % 400 == 7, F.col("value") * 1000 + 1000).otherwise(F.col("value")).alias("value"), "event_type")
    frame = from_dataframe(d, rows=True, order=["event_id"])
    n, columns = catalog.profile(frame)
    issues = [i for i in quality.issues_of(frame, n, columns) if i["kind"] == "extreme_values" and i["column"] == "value"]
    return spark.createDataFrame([(p["row"], p["id"], p["value"]) for i in issues for p in i["locations"]], "row bigint, id string, value double").select("row", "id", _r("value", 4).alias("value"))


@query(f"WITH {M}, {_Q.replace('wild', 'score')}, b AS (SELECT min(score) AS lo, max(score) AS hi, count(*) AS n, any_value(q1) AS q1, any_value(q3) AS q3 FROM m, q WHERE score BETWEEN q1 - 3 * (q3 - q1) AND q3 + 3 * (q3 - q1)), k AS (SELECT *, greatest(5, least(24, ceil((hi - lo) / (2 * (q3 - q1) / pow(n, 1.0::DOUBLE / 3)))))::INT AS bins FROM b) SELECT least(floor((score - lo) * bins / (hi - lo))::INT, bins - 1)::BIGINT AS bin, count(*) AS n FROM m, k GROUP BY 1")
def histogram(spark, sf_dir):
    h = series.histograms(_mixed(spark, sf_dir), {"x": F.col("score")})["x"]
    return _rows(spark, [(i, n) for i, n in enumerate(h["counts"]) if n], "bin bigint, n bigint")


_BOX = "round(min(x), 4) AS low, round(any_value(q1), 4) AS q1, round(any_value(q2), 4) AS median, round(any_value(q3), 4) AS q3, round(max(x), 4) AS high, round(min(x) FILTER (x >= q1 - 1.5 * (q3 - q1)), 4) AS whisker_lo, round(max(x) FILTER (x <= q3 + 1.5 * (q3 - q1)), 4) AS whisker_hi, count(*) AS n"


def _box_row(b):
    return (b["min"], b["q1"], b["median"], b["q3"], b["max"], b["whisker_lo"], b["whisker_hi"], b["n"])


_BOX_COLS = ("low", "q1", "median", "q3", "high", "whisker_lo", "whisker_hi")


@query(f"WITH {M}, q AS (SELECT quantile_cont(wild, 0.25) AS q1, quantile_cont(wild, 0.5) AS q2, quantile_cont(wild, 0.75) AS q3 FROM m) SELECT {_BOX} FROM (SELECT wild AS x FROM m), q")
def box_stats(spark, sf_dir):
    b = series.box_of(_mixed(spark, sf_dir), F.col("wild"))
    return _rows(spark, [tuple(map(float, _box_row(b)[:-1])) + (b["n"],)], ", ".join(f"{c} double" for c in _BOX_COLS) + ", n bigint").select(*(_r(c, 4).alias(c) for c in _BOX_COLS), "n")


@query(f"WITH {M}, q AS (SELECT flag, quantile_cont(wild, 0.25) AS q1, quantile_cont(wild, 0.5) AS q2, quantile_cont(wild, 0.75) AS q3 FROM m GROUP BY flag) SELECT flag AS level, {_BOX} FROM (SELECT flag, wild AS x FROM m) JOIN q USING (flag) GROUP BY flag")
def group_box(spark, sf_dir):
    boxes = series.group_boxes(_mixed(spark, sf_dir), F.col("wild"), F.col("flag"), ["A", "N", "R"])
    return _rows(spark, [(b["level"], *map(float, _box_row(b)[:-1]), b["n"]) for b in boxes], "level string, " + ", ".join(f"{c} double" for c in _BOX_COLS) + ", n bigint").select("level", *(_r(c, 4).alias(c) for c in _BOX_COLS), "n")


@query(f"WITH {M} SELECT holed AS level, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, holed) AS place FROM m WHERE holed IS NOT NULL GROUP BY holed")
def value_counts(spark, sf_dir):
    levels = association.level_moments(_mixed(spark, sf_dir), ["qty"], "holed")["qty"]
    return _rows(spark, [(k, m["n"], i) for i, (k, m) in enumerate(levels.items(), 1)], "level string, n bigint, place bigint")


@query(f"WITH {M}, c AS (SELECT near_constant, count(*) AS n FROM m GROUP BY 1) SELECT round(max(n)::DOUBLE / sum(n), 6) AS top, min(n) AS least, max(n)::DOUBLE / sum(n) > 0.9 AS imbalanced, min(n) < 5 AS rare FROM c")
def class_imbalance(spark, sf_dir):
    p = catalog.profile(from_dataframe(_mixed(spark, sf_dir).select("near_constant")))[1][0]
    n, top, least = p.level_counts
    imbalanced, rare = quality.level_issues(n, top, least)
    return _rows(spark, [(top / n, least, imbalanced, rare)], "top double, least bigint, imbalanced boolean, rare boolean").withColumn("top", _r("top"))


@query("WITH d AS (SELECT l_returnflag, l_linestatus, l_quantity, l_tax FROM lineitem) SELECT coalesce(sum(c), 0)::BIGINT AS n_duplicates FROM (SELECT count(*) AS c FROM d GROUP BY l_returnflag, l_linestatus, l_quantity, l_tax HAVING count(*) > 1)")
def duplicate_rows(spark, sf_dir):
    cols = ["l_returnflag", "l_linestatus", "l_quantity", "l_tax"]
    return quality.duplicate_rows(_table(spark, sf_dir, "lineitem").select(*cols), cols)


@query(f"WITH {M} SELECT flag AS a, echo AS b, count(*) AS n FROM m GROUP BY ALL")
def crosstab(spark, sf_dir):
    return association.crosstab(_mixed(spark, sf_dir), "flag", "echo")


_TYPES = _long([f"SELECT CASE WHEN count({c}) < 0.5 * count(*) OR count(DISTINCT {c}) <= 1 OR (SELECT max(n) FROM (SELECT count(*) AS n FROM m WHERE {c} IS NOT NULL GROUP BY {c})) >= 0.99 * count({c}) THEN 'excluded' " + ("ELSE 'numeric'" if c in NUMERIC else f"WHEN count(DISTINCT {c}) > 50 OR count(DISTINCT {c}) >= 0.5 * count(*) THEN 'excluded' ELSE 'categorical'") + " END AS type FROM m" for c in _COLS])


@query(f"WITH {M}, t AS ({_TYPES}) SELECT type, count(*) AS n FROM t GROUP BY type")
def type_counts(spark, sf_dir):
    return catalog.type_counts(catalog.as_frame(spark, catalog.profile(_profile_frame(spark, sf_dir))[1]))


@query(f"WITH {M} SELECT flag AS level, count(price) AS n, round(avg(price), 4) AS mean, round(stddev_samp(price), 4) AS sd FROM m GROUP BY flag")
def group_summary(spark, sf_dir):
    levels = association.level_moments(_mixed(spark, sf_dir), ["price"], "flag")["price"]
    return _rows(spark, [(k, m["n"], m["mean"], m["var"]) for k, m in levels.items()], "level string, n bigint, mean double, var double").select("level", "n", _r("mean", 4).alias("mean"), _r(F.sqrt("var"), 4).alias("sd"))


@query(f"WITH {M} SELECT l_orderkey, l_linenumber, round(coalesce(price, (SELECT median(price) FROM m)), 4) AS price FROM m")
def impute_median(spark, sf_dir):
    d = _mixed(spark, sf_dir).select("l_orderkey", "l_linenumber", "price")
    return modelling.imputed(d, ["price"], []).select("l_orderkey", "l_linenumber", _r("price", 4).alias("price"))


@query(f"WITH {M} SELECT l_orderkey, l_linenumber, coalesce(holed, (SELECT holed FROM m WHERE holed IS NOT NULL GROUP BY holed ORDER BY count(*) DESC, holed LIMIT 1)) AS holed FROM m")
def impute_mode(spark, sf_dir):
    return modelling.imputed(_mixed(spark, sf_dir).select("l_orderkey", "l_linenumber", "holed"), [], ["holed"])


@query(f"WITH {M}, w AS (" + _long([f"SELECT '{c}' AS name, count({c})::DOUBLE / count(*) AS present, stddev_samp({c}) / (max({c}) - min({c})) AS info FROM m" for c in NUMERIC] + [f"SELECT '{c}' AS name, (SELECT count({c})::DOUBLE / count(*) FROM m) AS present, -sum(n / s * ln(n / s + 1e-12)) AS info FROM (SELECT count(*)::DOUBLE AS n, sum(count(*)) OVER ()::DOUBLE AS s FROM m WHERE {c} IS NOT NULL GROUP BY {c})" for c in CATEGORICAL]) + ") SELECT name, row_number() OVER (ORDER BY present DESC, info DESC) <= 6 AS kept FROM w")
def column_cap(spark, sf_dir):
    """Row 66 with a cap of six: complete columns first, then by entropy or relative spread."""
    frame = _profile_frame(spark, sf_dir)
    keep, _ = modelling.chosen_columns(frame, catalog.profile(frame)[1], 6)
    return _rows(spark, [(c, c in keep) for c in _COLS], "name string, kept boolean")


# quality issues


def _issue_query(kind: str, name: str, sql: str, fixture=None, order=None):
    """Registers a query of the issues of one kind: severity and column."""

    def run(spark, sf_dir):
        d = fixture(spark, sf_dir) if fixture else _mixed(spark, sf_dir).select(*_COLS, "near_constant")
        frame = from_dataframe(d)
        n, columns = catalog.profile(frame)
        issues = [i for i in quality.issues_of(frame, n, columns) if i["kind"] in kind.split("|")]
        return spark.createDataFrame([(i["severity"], i["kind"], i["column"]) for i in issues], 'severity string, kind string, "column" string'.replace('"', "`"))

    run.__name__ = name
    query(sql)(run)


def _docs(spark, sf_dir):
    return _from(spark, sf_dir, "SELECT d.doc_id, d.lang, d.source, d.n_chars, l.quality, 'x' AS same FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id")


_issue_query("missing_column", "dq_missing_column", f"WITH {M} " + _long([f"""SELECT CASE WHEN p > 0.5 THEN 'high' WHEN p > 0.2 THEN 'medium' ELSE 'low' END AS severity, 'missing_column' AS kind, '{c}' AS "column" FROM (SELECT round_even((count(*) - count({c}))::DOUBLE / count(*), 4) AS p FROM m) WHERE p > 0""" for c in _COLS]))
_issue_query("constant_column|near_constant_column", "dq_constant", "WITH d AS (SELECT d.*, l.quality, 'x' AS same FROM documents d LEFT JOIN labels l USING (doc_id)) " + _long([f"""SELECT 'low' AS severity, CASE WHEN count(DISTINCT {c}) = 1 THEN 'constant_column' ELSE 'near_constant_column' END AS kind, '{c}' AS "column" FROM d HAVING count({c}) >= 0.5 * count(*) AND (count(DISTINCT {c}) = 1 OR (SELECT max(n) FROM (SELECT count(*) AS n FROM d WHERE {c} IS NOT NULL GROUP BY {c})) >= 0.99 * count({c}))""" for c in ("lang", "source", "n_chars", "quality", "same")]), _docs)
_issue_query("excluded_column", "dq_excluded", """SELECT 'low' AS severity, 'excluded_column' AS kind, name AS "column" FROM (SELECT 'o_orderdate' AS name FROM orders HAVING any_value(typeof(o_orderdate)) LIKE 'TIMESTAMP%')""", lambda s, d: _table(s, d, "orders").select("o_orderdate", "o_orderstatus", "o_totalprice"))
_issue_query("coerced_type", "dq_coerced", f"""WITH {T} SELECT 'low' AS severity, 'coerced_type' AS kind, 'commas' AS "column" FROM t HAVING count(*) FILTER (regexp_matches(trim(commas), '^[+-]?(\\d{{1,3}}(,\\d{{3}})+|\\d+)(\\.\\d+)?([eE][+-]?\\d+)?$')) >= 0.9 * count(*) FILTER (trim(commas) <> '')""", lambda s, d: _from(s, d, TEXTS).select("commas", "dated"))
_issue_query("extreme_values|outliers", "dq_outliers", f"""WITH {M} """ + _long([f"""SELECT CASE WHEN n5 > 0 THEN 'medium' ELSE 'low' END AS severity, CASE WHEN n5 > 0 THEN 'extreme_values' ELSE 'outliers' END AS kind, '{c}' AS "column" FROM (SELECT count(*) FILTER ({c} < q1 - 5 * (q3 - q1) OR {c} > q3 + 5 * (q3 - q1)) AS n5, count(*) FILTER ({c} < q1 - 3 * (q3 - q1) OR {c} > q3 + 3 * (q3 - q1)) AS n3 FROM m, (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM m)) WHERE n3 > 0""" for c in NUMERIC]))
_issue_query("skew", "dq_skew", f"WITH {M} " + _long([f"""SELECT CASE WHEN abs(s) > 2 THEN 'medium' ELSE 'low' END AS severity, 'skew' AS kind, '{c}' AS "column" FROM (SELECT skewness({c}) AS s FROM m) WHERE abs(s) > 1""" for c in NUMERIC]))
_issue_query("heavy_tails", "dq_heavy_tails", f"WITH {M} " + _long([f"""SELECT 'low' AS severity, 'heavy_tails' AS kind, '{c}' AS "column" FROM (SELECT kurtosis({c}) AS k FROM m) WHERE k > 3""" for c in NUMERIC]))
_issue_query("sample_size", "dq_sample_size", """SELECT 'high' AS severity, 'sample_size' AS kind, NULL::VARCHAR AS "column" FROM region HAVING count(*) < 30""", lambda s, d: _table(s, d, "region"))
_issue_query("wide_data", "dq_wide", """SELECT 'high' AS severity, 'wide_data' AS kind, NULL::VARCHAR AS "column" FROM region HAVING count(*) BETWEEN 1 AND 6""", lambda s, d: _table(s, d, "region").select(*((F.col("r_regionkey") * (i + 1) + i % 3).alias(f"v{i}") for i in range(6))))


@query("""WITH r AS (SELECT r_name, 'k' AS c, CASE WHEN r_regionkey > 1 THEN r_regionkey::DOUBLE END AS v FROM region), i AS (SELECT 'high' AS severity FROM r HAVING count(*) < 30
UNION ALL SELECT CASE WHEN p > 0.5 THEN 'high' WHEN p > 0.2 THEN 'medium' ELSE 'low' END FROM (SELECT avg((v IS NULL)::INT) AS p FROM r) WHERE p > 0 UNION ALL SELECT 'low' FROM r HAVING count(DISTINCT c) = 1
UNION ALL SELECT 'low' FROM r HAVING count(DISTINCT r_name) >= 0.95 * count(*) UNION ALL SELECT CASE WHEN abs(s) > 2 THEN 'medium' ELSE 'low' END FROM (SELECT skewness(v) AS s FROM r) WHERE abs(s) > 1
UNION ALL SELECT 'medium' FROM (SELECT count(*) AS n FROM r GROUP BY r_name, c, v HAVING count(*) > 1) HAVING count(*) > 0) SELECT severity, count(*) AS n FROM i GROUP BY severity""")
def dq_issues(spark, sf_dir):
    """Row 80: severities of all issues of a frame of five regions with a constant and a text-number."""
    d = _table(spark, sf_dir, "region").select("r_name", F.lit("k").alias("c"), F.when(F.col("r_regionkey") > 1, F.col("r_regionkey").cast("double")).alias("v"))
    frame = from_dataframe(d)
    n, columns = catalog.profile(frame)
    return quality.as_frame(spark, [i for i in quality.issues_of(frame, n, columns) if i["kind"] != "missing_rows"]).groupBy("severity").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 'event_id' AS name FROM events HAVING count(DISTINCT event_id) >= 0.95 * count(*)")
def detect_id_column(spark, sf_dir):
    return spark.createDataFrame([(catalog.identifier_column(catalog.profile(from_dataframe(_table(spark, sf_dir, "events")))[1]),)], "name string")


_MISS = " UNION ALL ".join(f"SELECT '{c}' AS other, count({c}) FILTER (tax IS NULL) AS n1, avg({c}) FILTER (tax IS NULL) AS m1, var_samp({c}) FILTER (tax IS NULL) AS v1, count({c}) FILTER (tax IS NOT NULL) AS n2, avg({c}) FILTER (tax IS NOT NULL) AS m2, var_samp({c}) FILTER (tax IS NOT NULL) AS v2 FROM m" for c in ("disc", "planted"))


@query(with_p(f"{M}, s AS ({_MISS})", "SELECT other AS id, 't' AS kind, abs(m1 - m2) / sqrt(v1 / n1 + v2 / n2) AS stat, 1.0::DOUBLE AS d1, pow(v1 / n1 + v2 / n2, 2) / (pow(v1 / n1, 2) / (n1 - 1) + pow(v2 / n2, 2) / (n2 - 1)) AS d2 FROM s", "SELECT id AS other, round(p, 6) AS p FROM pv ORDER BY p LIMIT 1"))
def missing_not_random(spark, sf_dir):
    """Row 70: what goes with tax being missing, of disc and planted."""
    frame = from_dataframe(_mixed(spark, sf_dir).select("tax", "disc", "planted"))
    name, p = quality.missingness_association(frame, "tax", catalog.profile(frame)[1])
    return _rows(spark, [(name, p)], "other string, p double").select("other", _r("p").alias("p"))


# tests

_PAIRS = [("qty", "price"), ("qty", "planted"), ("price", "tax"), ("disc", "planted"), ("qty", "score"), ("tax", "planted")]
_CORR = _long([f"SELECT '{a}' AS a, '{b}' AS b, regr_count({b}, {a})::BIGINT AS n, corr({b}, {a}) AS r FROM m" for a, b in _PAIRS])
_CORR_T = "SELECT a || '~' || b AS id, 't' AS kind, abs(r) * sqrt((n - 2) / (1 - r * r)) AS stat, 1.0::DOUBLE AS d1, (n - 2)::DOUBLE AS d2 FROM c"


@query(with_p(f"{M}, c AS ({_CORR})", _CORR_T, "SELECT a, b, n, round(r, 6) AS r, round(p, 6) AS p FROM c JOIN pv ON id = a || '~' || b"))
def pearson(spark, sf_dir):
    got = association.pair_moments(_mixed(spark, sf_dir), ["qty", "price", "disc", "tax", "planted", "score"])
    rows = [(a, b, got[a, b]["n"], got[a, b]["r"], special.pearson_p(got[a, b]["r"], got[a, b]["n"])) for a, b in _PAIRS]
    return _rows(spark, rows, "a string, b string, n bigint, r double, p double").select("a", "b", "n", _r("r").alias("r"), _r("p").alias("p"))


def _rank_sql(a: str, b: str) -> str:
    rank = lambda c: f"(rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0)::DOUBLE"
    return f"SELECT '{a}' AS a, '{b}' AS b, count(*)::BIGINT AS n, corr(x, y) AS r FROM (SELECT {rank(a)} AS x, {rank(b)} AS y FROM m WHERE {a} IS NOT NULL AND {b} IS NOT NULL)"


@query(with_p(f"{M}, c AS ({_long([_rank_sql(a, b) for a, b in _PAIRS])})", _CORR_T, "SELECT a, b, n, round(r, 6) AS rho, round(p, 6) AS p FROM c JOIN pv ON id = a || '~' || b"))
def spearman(spark, sf_dir):
    got = association.rank_correlations(_mixed(spark, sf_dir), ["qty", "price", "disc", "tax", "planted", "score"])
    rows = [(a, b, *got[a, b], special.pearson_p(got[a, b][1], got[a, b][0])) for a, b in _PAIRS]
    return _rows(spark, rows, "a string, b string, n bigint, rho double, p double").select("a", "b", "n", _r("rho").alias("rho"), _r("p").alias("p"))


_SWEPT = [("qty", "planted"), ("qty", "wild"), ("planted", "wild")]


@query(with_p(f"{M}, c AS ({_long([f'''SELECT '{a}' AS a, '{b}' AS b, regr_count({b}, {a})::BIGINT AS n, corr({b}, {a}) AS r FROM m''' if b != 'wild' else _rank_sql(a, b) for a, b in _SWEPT])})", _CORR_T, "SELECT a, b, CASE WHEN b = 'wild' THEN 'spearman' ELSE 'pearson' END AS kind, n, round(r, 6) AS effect, round(p, 6) AS p, CASE WHEN r > 0 THEN 'positive' ELSE 'negative' END AS direction FROM c JOIN pv ON id = a || '~' || b"))
def correlation_sweep(spark, sf_dir):
    cols = ["qty", "planted", "wild"]
    d = _mixed(spark, sf_dir).select(*cols)
    swept = association.correlations(d, cols, catalog.numeric_stats(d, {c: column(c) for c in cols}))
    rows = [(*r["vars"], r["kind"], r["n"], r["effect_value"], r["p_raw"], r["direction"]) for r in swept]
    return _rows(spark, rows, "a string, b string, kind string, n bigint, effect double, p double, direction string").select("a", "b", "kind", "n", _r("effect").alias("effect"), _r("p").alias("p"), "direction")


@query(f"SELECT a, b, sign(x.r) = sign(y.rho) AND (x.p < 0.05) = (y.p < 0.05) AS agrees FROM ({_oracles['pearson']}) x JOIN ({_oracles['spearman']}) y USING (a, b)")
def agreement(spark, sf_dir):
    """Row 88: whether both correlations of a pair have one direction and one verdict."""
    cols = ["qty", "price", "disc", "tax", "planted", "score"]
    made = {tuple(r["vars"]): r["nonparametric_agrees"] for r in association.correlations(_mixed(spark, sf_dir).select(*cols), cols, {})}
    return spark.createDataFrame([(a, b, made[a, b]) for a, b in _PAIRS], "a string, b string, agrees boolean")


_UNEVEN = _long([f"SELECT '{c}' AS c, abs(skewness({c})) > 1 OR count(*) FILTER ({c} < q1 - 5 * (q3 - q1) OR {c} > q3 + 5 * (q3 - q1)) > 0 AS uneven FROM m, (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM m)" for c in ("qty", "planted", "wild")])


@query(f"WITH {M}, u AS ({_UNEVEN}) SELECT x.c AS a, y.c AS b, NOT (x.uneven OR y.uneven) AS ok, false AS critical FROM u x JOIN u y ON list_position(['qty', 'planted', 'wild'], x.c) < list_position(['qty', 'planted', 'wild'], y.c)")
def correlation_checks(spark, sf_dir):
    """Row 119: what a correlation rests on, by pair."""
    cols = ["qty", "planted", "wild"]
    d = _mixed(spark, sf_dir).select(*cols)
    made = association.correlations(d, cols, catalog.numeric_stats(d, {c: column(c) for c in cols}))
    return spark.createDataFrame([(*r["vars"], c["ok"], c["critical"]) for r in made for c in r["assumptions"]], "a string, b string, ok boolean, critical boolean")


_TWO = "g AS (SELECT status, count(*) AS n, avg(score) AS m, var_samp(score) AS v, row_number() OVER (ORDER BY count(*) DESC, status) AS k FROM m GROUP BY status), w AS (SELECT a.n AS n1, a.m AS m1, a.v AS v1, b.n AS n2, b.m AS m2, b.v AS v2, a.status AS l1, b.status AS l2 FROM g a, g b WHERE a.k = 1 AND b.k = 2)"


def _two(spark, sf_dir, num="score"):
    return association.level_moments(_mixed(spark, sf_dir), [num], "status")[num]


@query(with_p(f"{M}, {_TWO}", "SELECT 'w' AS id, 't' AS kind, abs(m1 - m2) / sqrt(v1 / n1 + v2 / n2) AS stat, 1.0::DOUBLE AS d1, pow(v1 / n1 + v2 / n2, 2) / (pow(v1 / n1, 2) / (n1 - 1) + pow(v2 / n2, 2) / (n2 - 1)) AS d2 FROM w", "SELECT round((m1 - m2) / sqrt(v1 / n1 + v2 / n2), 4) AS t, round(d2, 2) AS df, round(p, 6) AS p FROM w, tests, pv"))
def welch_t(spark, sf_dir):
    a, b = _two(spark, sf_dir).values()
    return _rows(spark, [quality.welch(a["n"], a["mean"], a["var"], b["n"], b["mean"], b["var"])], "t double, df double, p double").select(_r("t", 4).alias("t"), _r("df", 2).alias("df"), _r("p").alias("p"))


@query(f"WITH {M}, {_TWO} SELECT round((m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)), 6) AS d FROM w")
def cohen_d(spark, sf_dir):
    return _rows(spark, [(association.cohen_d(*_two(spark, sf_dir).values()),)], "d double").select(_r("d").alias("d"))


_RANKED = "rk AS (SELECT {cat} AS level, (rank() OVER (ORDER BY {num}) + (count(*) OVER (PARTITION BY {num}) - 1) / 2.0)::DOUBLE AS r, {num} AS x FROM m WHERE {num} IS NOT NULL), s AS (SELECT level, count(*)::DOUBLE AS n, sum(r) AS s FROM rk GROUP BY level), tie AS (SELECT sum(c * c * c - c)::DOUBLE AS t, sum(c)::DOUBLE AS n FROM (SELECT count(*)::DOUBLE AS c FROM rk GROUP BY x))"


@query(with_p(f"{M}, {_TWO}, {_RANKED.format(cat='status', num='score')}, u AS (SELECT s.s - s.n * (s.n + 1) / 2 AS u, n1::DOUBLE AS n1, n2::DOUBLE AS n2 FROM s, w WHERE s.level = w.l1)", "SELECT 'u' AS id, 'z' AS kind, (greatest(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5) / sqrt(n1 * n2 / 12 * (n1 + n2 + 1 - t / ((n1 + n2) * (n1 + n2 - 1)))) AS stat, 1.0::DOUBLE AS d1, 1.0::DOUBLE AS d2 FROM u, tie", "SELECT u, round(p, 6) AS p FROM u, pv"))
def mann_whitney(spark, sf_dir):
    d = _mixed(spark, sf_dir)
    names = list(_two(spark, sf_dir))
    sums, ties = association.rank_sums(d, {("score", "status"): names})["score", "status"]
    n, s = sums[names[0]]
    u = s - n * (n + 1) / 2
    return _rows(spark, [(u, special.mann_whitney_p(u, n, sums[names[1]][0], ties))], "u double, p double").select("u", _r("p").alias("p"))


_ONE_WAY = "g AS (SELECT {cat} AS level, count({num}) AS n, avg({num}) AS m, var_samp({num}) AS v FROM {src} GROUP BY 1), a AS (SELECT sum(n)::DOUBLE AS n, count(*)::DOUBLE AS k, sum(n * m) / sum(n) AS gm, sum((n - 1) * v) AS ssw FROM g), b AS (SELECT sum(g.n * (g.m - a.gm) * (g.m - a.gm)) AS ssb, any_value(a.n) AS n, any_value(a.k) AS k, any_value(a.ssw) AS ssw FROM g, a)"
_F = "SELECT 'f' AS id, 'f' AS kind, (ssb / (k - 1)) / (ssw / (n - k)) AS stat, k - 1 AS d1, n - k AS d2 FROM b"


@query(with_p(f"{M}, {_ONE_WAY.format(cat='flag', num='price', src='m')}", _F, "SELECT round(stat, 4) AS f, round(p, 6) AS p FROM tests JOIN pv USING (id)"))
def anova(spark, sf_dir):
    levels = association.level_moments(_mixed(spark, sf_dir), ["price"], "flag")["price"]
    f, p, _, _ = association.one_way([(m["n"], m["mean"], m["var"]) for m in levels.values()])
    return _rows(spark, [(f, p)], "f double, p double").select(_r("f", 4).alias("f"), _r("p").alias("p"))


@query(f"WITH {M}, {_ONE_WAY.format(cat='echo', num='score', src='m')} SELECT round(ssb / (ssb + ssw), 6) AS eta_sq FROM b")
def eta_squared(spark, sf_dir):
    levels = association.level_moments(_mixed(spark, sf_dir), ["score"], "echo")["score"]
    return _rows(spark, [(association.one_way([(m["n"], m["mean"], m["var"]) for m in levels.values()])[2],)], "eta_sq double").select(_r("eta_sq").alias("eta_sq"))


@query(with_p(f"{M}, {_RANKED.format(cat='flag', num='score')}", "SELECT 'h' AS id, 'chi2' AS kind, (12 / (any_value(tie.n) * (any_value(tie.n) + 1)) * sum(s.s * s.s / s.n) - 3 * (any_value(tie.n) + 1)) / (1 - any_value(t) / (pow(any_value(tie.n), 3) - any_value(tie.n))) AS stat, (count(*) - 1)::DOUBLE AS d1, 1.0::DOUBLE AS d2 FROM s, tie", "SELECT round(stat, 4) AS h, round(p, 6) AS p FROM tests JOIN pv USING (id)"))
def kruskal(spark, sf_dir):
    h, p = association.kruskal(*association.rank_sums(_mixed(spark, sf_dir), {("score", "flag"): ["A", "N", "R"]})["score", "flag"])
    return _rows(spark, [(h, p)], "h double, p double").select(_r("h", 4).alias("h"), _r("p").alias("p"))


@query(with_p(f"{M}, md AS (SELECT flag AS l, median(price) AS md FROM m GROUP BY flag), dev AS (SELECT flag, abs(price - md) AS d FROM m JOIN md ON flag = l), {_ONE_WAY.format(cat='flag', num='d', src='dev')}", _F, "SELECT round(stat, 4) AS f, round(p, 6) AS p FROM tests JOIN pv USING (id)"))
def levene(spark, sf_dir):
    levels = association.level_moments(_mixed(spark, sf_dir), ["price"], "flag")["price"]
    f, p, _, _ = association.one_way([(m["n"], m["d_mean"], m["d_var"]) for m in levels.values()])
    return _rows(spark, [(f, p)], "f double, p double").select(_r("f", 4).alias("f"), _r("p").alias("p"))


@query(f"SELECT 'price' AS num, 'flag' AS cat, NOT p < 0.05 AS ok, false AS critical FROM ({_oracles['levene']})")
def group_checks(spark, sf_dir):
    """Row 117: whether the groups' variances are equal enough, as the group test reports it."""
    made = association.group_differences(_mixed(spark, sf_dir).select("price", "flag"), ["price"], ["flag"])
    return spark.createDataFrame([(*r["vars"], c["ok"], c["critical"]) for r in made for c in r["assumptions"] if "Levene" in c["name"]], "num string, cat string, ok boolean, critical boolean")


@query()
def shapiro_min(spark, sf_dir):
    d = _table(spark, sf_dir, "customer").select("c_acctbal", F.col("c_nationkey").cast("string").alias("nation"))
    return association.shapiro_by_level(d, "nation", {"c_acctbal": [str(i) for i in range(25)]}).drop("num")


@query(f"WITH {M} SELECT (SELECT status FROM m GROUP BY status ORDER BY avg(score) DESC LIMIT 1) AS status, (SELECT flag FROM m GROUP BY flag ORDER BY avg(price) DESC LIMIT 1) AS flag")
def higher_group(spark, sf_dir):
    made = association.group_differences(_mixed(spark, sf_dir).select("score", "price", "status", "flag"), ["score", "price"], ["status", "flag"])
    by = {tuple(r["vars"]): r["extra"]["higher_group"] for r in made}
    return _rows(spark, [(by["score", "status"], by["price", "flag"])], "status string, flag string")


_TABLE = "ct AS (SELECT a, b, count(*)::DOUBLE AS o FROM (SELECT {a} AS a, {b} AS b FROM {src}) WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY ALL), ra AS (SELECT a, sum(o) AS ta FROM ct GROUP BY a), cb AS (SELECT b, sum(o) AS tb FROM ct GROUP BY b), tot AS (SELECT sum(o) AS n FROM ct), dims AS (SELECT (SELECT count(*) FROM ra)::DOUBLE AS r, (SELECT count(*) FROM cb)::DOUBLE AS k), cells AS (SELECT a, b, coalesce(o, 0) AS o, ta * tb / n AS e, (r - 1) * (k - 1) AS dof, n, r, k FROM ra CROSS JOIN cb CROSS JOIN tot CROSS JOIN dims LEFT JOIN ct USING (a, b)), chi AS (SELECT sum(pow(abs(o - e) - CASE WHEN dof = 1 THEN least(0.5, abs(o - e)) ELSE 0 END, 2) / e) AS chi2, any_value(dof) AS dof, min(e) AS min_e, count(*) FILTER (e < 5) AS low, any_value(n) AS n, any_value(r) AS r, any_value(k) AS k FROM cells)"
_CHI = "SELECT 'x' AS id, 'chi2' AS kind, chi2 AS stat, dof AS d1, 1.0::DOUBLE AS d2 FROM chi"


def _chi(spark, sf_dir, a, b):
    return association.chi_square_of({(r["a"], r["b"]): r["n"] for r in association.crosstab(_mixed(spark, sf_dir), a, b).collect()})


@query(with_p(f"{M}, {_TABLE.format(a='holed', b='status', src='m')}", _CHI, "SELECT round(chi2, 4) AS chi2, dof::BIGINT AS dof, round(p, 6) AS p FROM chi, pv"))
def chi_square(spark, sf_dir):
    t = _chi(spark, sf_dir, "holed", "status")
    return _rows(spark, [(t["chi2"], t["dof"], t["p"])], "chi2 double, dof bigint, p double").select(_r("chi2", 4).alias("chi2"), "dof", _r("p").alias("p"))


_SPARSE = "SELECT CASE WHEN s_acctbal > 0 THEN 'y' ELSE 'n' END AS a, CASE WHEN s_suppkey % 20 = 3 THEN 'u' ELSE 'v' END AS b FROM supplier"


@query(f"WITH c AS (SELECT count(*) FILTER (a = 'n' AND b = 'u') AS a, count(*) FILTER (a = 'n') AS r, count(*) FILTER (b = 'u') AS c, count(*) AS n FROM ({_SPARSE})), l AS (SELECT *, unnest(range(greatest(0, r + c - n), least(r, c) + 1)) AS k FROM c), p AS (SELECT *, lgamma(c + 1) - lgamma(k + 1) - lgamma(c - k + 1) + lgamma(n - c + 1) - lgamma(r - k + 1) - lgamma(n - c - r + k + 1) - (lgamma(n + 1) - lgamma(r + 1) - lgamma(n - r + 1)) AS lp FROM l) SELECT round(sum(exp(lp)) FILTER (lp <= (SELECT lp FROM p WHERE k = a) + 1e-7), 6) AS p FROM p")
def fisher_exact(spark, sf_dir):
    d = _table(spark, sf_dir, "supplier").select(F.when(F.col("s_acctbal") > 0, "y").otherwise("n").alias("a"), F.when(F.col("s_suppkey") % 20 == 3, "u").otherwise("v").alias("b"))
    t = {(r["a"], r["b"]): r["n"] for r in association.crosstab(d, "a", "b").collect()}
    return _rows(spark, [(special.fisher_2x2(*(t.get((x, y), 0) for x in "ny" for y in "uv")),)], "p double").select(_r("p").alias("p"))


@query(f"WITH {M}, {_TABLE.format(a='flag', b='echo', src='m')} SELECT round(sqrt(greatest(0, chi2 / n - (r - 1) * (k - 1) / (n - 1)) / (least(k - pow(k - 1, 2) / (n - 1), r - pow(r - 1, 2) / (n - 1)) - 1)), 6) AS v FROM chi")
def cramers_v(spark, sf_dir):
    return _rows(spark, [(_chi(spark, sf_dir, "flag", "echo")["v"],)], "v double").select(_r("v").alias("v"))


@query(f"WITH {M}, {_TABLE.format(a='near_constant', b='echo', src='m')} SELECT round(min_e, 6) AS min_expected, low AS low_cells FROM chi")
def min_expected(spark, sf_dir):
    e = _chi(spark, sf_dir, "near_constant", "echo")["expected"]
    return _rows(spark, [(min(e), sum(x < 5 for x in e))], "min_expected double, low_cells bigint").select(_r("min_expected").alias("min_expected"), "low_cells")


# models


@query(f"WITH {M} SELECT l_orderkey, l_linenumber, price AS \"price\", CASE WHEN coalesce(holed, 'nan') = 'N' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS holed_n, CASE WHEN coalesce(holed, 'nan') = 'R' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS holed_r, CASE WHEN holed IS NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS holed_nan FROM m WHERE price IS NOT NULL")
def design_matrix(spark, sf_dir):
    d = models.design(_mixed(spark, sf_dir), "qty", ["price"], ["holed"])
    return d.df.select("l_orderkey", "l_linenumber", *(c.alias(t.replace("=", "_").lower()) for t, c in d.terms.items()))


@query("""WITH d AS (SELECT n_nationkey::DOUBLE AS a, (n_nationkey * 2 % 7)::DOUBLE AS v, n_name FROM nation), c AS (SELECT count(*) AS n, 1 + count(DISTINCT n_name) - 1 AS terms, corr(a, v) AS r FROM d)
SELECT outcome, CASE WHEN n >= 10 THEN 'ols' ELSE 'insufficient' END AS kind, n, CASE WHEN n < 5 * terms THEN 'only the ' || greatest(1, least((r IS NOT NULL)::INT, n // 5 - 1)) || ' most correlated predictors were used, for want of rows' END AS note FROM c, (VALUES ('n_nationkey'), ('v')) o(outcome)""")
def predictor_thinning(spark, sf_dir):
    """Row 104: five regions, more dummies than rows: the note of the model."""
    d = _table(spark, sf_dir, "nation").select("n_nationkey", (F.col("n_nationkey") * 2 % 7).cast("double").alias("v"), "n_name")
    made, _ = models.regressions(d.select("n_nationkey", "v", "n_name"), ["n_nationkey", "v"], ["n_name"], 25, charts=False)
    return results.as_frame(spark, made).select(F.col("vars")[0].alias("outcome"), "kind", "n", "note")


_OLS = "d AS (SELECT planted AS y, tax AS x FROM m WHERE tax IS NOT NULL), o AS (SELECT count(*)::DOUBLE AS n, avg(x) AS mx, avg(y) AS my, regr_sxx(y, x) AS sxx, regr_sxy(y, x) AS sxy, regr_syy(y, x) AS syy FROM d), e AS (SELECT x, y, n, sxx, x - mx AS dx, y - my - sxy / sxx * (x - mx) AS e, 1 / n + (x - mx) * (x - mx) / sxx AS h FROM d, o), hc AS (SELECT sum(dx * dx * e * e / pow(1 - h, 2)) / pow(any_value(sxx), 2) AS v, sum(e * e) AS sse, any_value(n) AS n FROM e)"


def _one(spark, sf_dir):
    return models.fit(models.design(_mixed(spark, sf_dir), "planted", ["tax"], []))


@query(f"WITH {M}, {_OLS} SELECT o.n::BIGINT AS n, round(my - sxy / sxx * mx, 4) AS intercept, round(sxy / sxx, 4) AS slope, round(sxy * sxy / (sxx * syy), 6) AS r2, round(1 - (1 - sxy * sxy / (sxx * syy)) * (o.n - 1) / (o.n - 2), 6) AS adj_r2 FROM o")
def ols_fit(spark, sf_dir):
    f = _one(spark, sf_dir)
    return _rows(spark, [(f.n, float(f.beta[0]), float(f.beta[1]), f.r2, f.adj_r2)], "n bigint, intercept double, slope double, r2 double, adj_r2 double").select("n", _r("intercept", 4).alias("intercept"), _r("slope", 4).alias("slope"), _r("r2").alias("r2"), _r("adj_r2").alias("adj_r2"))


@query(f"WITH {M}, {_OLS} SELECT round(sqrt(v), 6) AS se FROM hc")
def ols_hc3(spark, sf_dir):
    return _rows(spark, [(float(_one(spark, sf_dir).se[1]),)], "se double").select(_r("se").alias("se"))


@query(with_p(f"{M}, {_OLS.replace('tax AS x FROM m WHERE tax IS NOT NULL', 'disc AS x FROM m')}", "SELECT 'z' AS id, 'z' AS kind, (sxy / sxx) / sqrt(v) AS stat, 1.0::DOUBLE AS d1, 1.0::DOUBLE AS d2 FROM o, hc", "SELECT round(stat, 6) AS z, round(p, 6) AS p, round(sxy / sxx - 1.959963984540054 * sqrt(v), 6) AS ci_low, round(sxy / sxx + 1.959963984540054 * sqrt(v), 6) AS ci_high FROM tests, pv, o, hc"))
def ols_coefficients(spark, sf_dir):
    d = _mixed(spark, sf_dir).select("planted", "disc")
    c = models.regressions(d, ["planted", "disc"], [], 1, charts=False)[1][0]
    return _rows(spark, [(c["statistic"], c["p_raw"], c["extra"]["ci_low"], c["extra"]["ci_high"])], "z double, p double, ci_low double, ci_high double").select(*(_r(k).alias(k) for k in ("z", "p", "ci_low", "ci_high")))


@query(with_p(f"{M}, {_OLS.replace('tax AS x FROM m WHERE tax IS NOT NULL', 'disc AS x FROM m')}", "SELECT 'f' AS id, 'f' AS kind, pow(sxy / sxx, 2) / v AS stat, 1.0::DOUBLE AS d1, o.n - 2 AS d2 FROM o, hc", "SELECT round(stat, 6) AS f, round(p, 6) AS p FROM tests JOIN pv USING (id)"))
def ols_wald_f(spark, sf_dir):
    f = models.fit(models.design(_mixed(spark, sf_dir), "planted", ["disc"], []))
    return _rows(spark, [(f.f, f.f_p)], "f double, p double").select(_r("f").alias("f"), _r("p").alias("p"))


@query(f"WITH {M}, {_OLS} SELECT round(sxy / sxx * sqrt(sxx / (n - 1)) / sqrt(syy / (n - 1)), 6) AS std_beta FROM o")
def std_beta(spark, sf_dir):
    f = _one(spark, sf_dir)
    return _rows(spark, [(float(f.beta[1] * f.sd[0] / f.sd_y),)], "std_beta double").select(_r("std_beta").alias("std_beta"))


@query(with_p(f"{M}, {_OLS}", "SELECT 'b' AS id, 'chi2' AS kind, any_value(n) * pow(regr_sxy(e * e, x), 2) / (regr_sxx(e * e, x) * regr_syy(e * e, x)) AS stat, 1.0::DOUBLE AS d1, 1.0::DOUBLE AS d2 FROM e", "SELECT round(stat, 4) AS lm, round(p, 6) AS p FROM tests JOIN pv USING (id)"))
def breusch_pagan(spark, sf_dir):
    f = _one(spark, sf_dir)
    return _rows(spark, [(f.bp, f.bp_p)], "lm double, p double").select(_r("lm", 4).alias("lm"), _r("p").alias("p"))


@query()
def shapiro_resid(spark, sf_dir):
    d = _table(spark, sf_dir, "customer").select("c_acctbal", F.col("c_nationkey").cast("double").alias("nation"))
    f = models.fit(models.design(d, "c_acctbal", ["nation"], []))
    return _rows(spark, [(f.n, f.shapiro_p)], "n bigint, p double")


@query(f"WITH {M}, {_OLS} SELECT round(max(e * e * h / pow(1 - h, 2)) / (2 * any_value(sse) / (any_value(hc.n) - 2)), 6) AS cooks_max FROM e, hc")
def cooks_distance(spark, sf_dir):
    return _rows(spark, [(_one(spark, sf_dir).cooks_max,)], "cooks_max double").select(_r("cooks_max").alias("cooks_max"))


@query(f"WITH {M}, s AS (SELECT sum(qty * qty) AS aa, sum(qty * disc) AS ab, sum(disc * disc) AS bb FROM m) SELECT round(1 / (1 - ab * ab / (aa * bb)), 6) AS vif_max FROM s")
def vif_max(spark, sf_dir):
    """Row 114: two terms without an intercept, where the factor has a closed form."""
    f = models.fit(models.design(_mixed(spark, sf_dir), "planted", ["qty", "disc"], []))
    return _rows(spark, [(f.vif_max,)], "vif_max double").select(_r("vif_max").alias("vif_max"))


@query()
def model_assumptions(spark, sf_dir):
    d = _mixed(spark, sf_dir).select("qty", "disc", "planted", "status")
    made, terms = models.regressions(d, ["qty", "disc", "planted"], ["status"], 1, charts=False)
    frame = results.as_frame(spark, made + terms)
    return frame.select("family", "vars", F.explode("assumptions").alias("a")).select("family", "vars", "a.*")


# findings

_SWEEP_COLS = (["qty", "price", "disc", "tax", "planted"], ["flag", "status", "echo"])


def _results(spark, sf_dir, imputed=False):
    """Correlations of the sweep columns with their q."""
    d = _mixed(spark, sf_dir).select(*_SWEEP_COLS[0])
    if imputed:
        d = modelling.imputed(d, _SWEEP_COLS[0], [])
    return findings.with_q(results.as_frame(spark, association.correlations(d, _SWEEP_COLS[0], {})))


_BH_PAIRS = [(a, b) for i, a in enumerate(_SWEEP_COLS[0]) for b in _SWEEP_COLS[0][i + 1 :]]
_BH_CTES = f"{M}, c AS ({_long([f'''SELECT {i} AS seq, '{a}' AS a, '{b}' AS b, regr_count({b}, {a})::BIGINT AS n, corr({b}, {a}) AS r FROM m''' for i, (a, b) in enumerate(_BH_PAIRS)])})"
_BH = "x AS (SELECT seq, a, b, n, r, p, row_number() OVER (ORDER BY p, seq) AS k, count(*) OVER () AS c FROM c JOIN pv ON id = a || '~' || b), q AS (SELECT *, least(1, min(p * c / k) OVER (ORDER BY k DESC ROWS UNBOUNDED PRECEDING)) AS q, CASE WHEN abs(r) < 0.1 THEN 'none' WHEN abs(r) < 0.3 THEN 'small' WHEN abs(r) < 0.5 THEN 'medium' ELSE 'large' END AS size FROM x)"


@query(with_p(_BH_CTES, _CORR_T, f", {_BH} SELECT a, b, n, round(r, 6) AS r, round(p, 6) AS p, round(q, 6) AS q, size FROM q"))
def fdr_bh(spark, sf_dir):
    """Row 121, the flagship: screened correlations with q and magnitude."""
    return _results(spark, sf_dir).select(F.col("vars")[0].alias("a"), F.col("vars")[1].alias("b"), "n", _r("effect_value").alias("r"), _r("p_raw").alias("p"), _r("q_value").alias("q"), F.col("effect_magnitude").alias("size"))


@query(with_p(_BH_CTES, _CORR_T, f", {_BH} SELECT a, b FROM q WHERE q < 0.05 AND size IN ('medium', 'large')"))
def candidate_gate(spark, sf_dir):
    return findings.candidates(_results(spark, sf_dir)).select(F.col("vars")[0].alias("a"), F.col("vars")[1].alias("b"))


@query(with_p(_BH_CTES, _CORR_T, f", {_BH} SELECT a, b, round(least(abs(r) / 0.5, 1.5), 6) AS rank_key, row_number() OVER (ORDER BY least(abs(r) / 0.5, 1.5) DESC, seq)::INT AS rank FROM q WHERE q < 0.05 AND size IN ('medium', 'large')"))
def finding_rank(spark, sf_dir):
    return findings.candidates(_results(spark, sf_dir)).select(F.col("vars")[0].alias("a"), F.col("vars")[1].alias("b"), _r("rank_key").alias("rank_key"), "rank")


@query(with_p(_BH_CTES, _CORR_T, f", {_BH} SELECT a, b, round(q, 6) AS q, row_number() OVER (ORDER BY q, seq) AS place FROM q"))
def all_results(spark, sf_dir):
    from pyspark.sql.window import Window

    place = F.row_number().over(Window.partitionBy("family").orderBy(F.col("q_value").asc_nulls_last(), "seq")).cast("bigint")
    return _results(spark, sf_dir).select(F.col("vars")[0].alias("a"), F.col("vars")[1].alias("b"), _r("q_value").alias("q"), place.alias("place"))


_FILLED = "f AS (SELECT qty, coalesce(price, (SELECT median(price) FROM m)) AS price, disc, coalesce(tax, (SELECT median(tax) FROM m)) AS tax, planted FROM m)"


@query(f"WITH {M}, {_FILLED}, " + f"a AS ({_long([f'''SELECT '{a}' AS a, '{b}' AS b, corr({b}, {a}) AS r FROM m''' for a, b in _BH_PAIRS])}), t AS ({_long([f'''SELECT '{a}' AS a, '{b}' AS b, corr({b}, {a}) AS r FROM f''' for a, b in _BH_PAIRS])}) SELECT a.a, a.b, round(a.r, 6) AS effect, round(t.r, 6) AS twin_effect FROM a JOIN t USING (a, b) WHERE abs(a.r) >= 0.3")
def imputed_twin_join(spark, sf_dir):
    twins = findings.with_twins(findings.candidates(_results(spark, sf_dir)), _results(spark, sf_dir, imputed=True))
    return twins.select(F.col("vars")[0].alias("a"), F.col("vars")[1].alias("b"), _r("effect_value").alias("effect"), _r("twin_effect").alias("twin_effect"))


@query("SELECT * FROM (VALUES ('flag', 'echo', 'finding'), ('flag', 'near_constant', NULL), ('echo', 'near_constant', NULL)) v(a, b, route) WHERE route IS NOT NULL")
def needs_review_router(spark, sf_dir):
    made = findings.with_q(results.as_frame(spark, association.contingency(_mixed(spark, sf_dir).select("flag", "echo", "near_constant"), ["flag", "echo", "near_constant"])))
    return findings.candidates(made).select(F.col("vars")[0].alias("a"), F.col("vars")[1].alias("b"), "route")


@query(f"WITH {M}, c AS (SELECT count(*) AS total, count(*) FILTER (price IS NOT NULL AND tax IS NOT NULL AND qty IS NOT NULL) AS n FROM m) SELECT outcome, n, round(1 - n / total, 6) AS lost FROM c, (VALUES ('price'), ('qty'), ('tax')) v(outcome)")
def row_loss(spark, sf_dir):
    """Row 118: rows that a model has, and the share that it lacks."""
    d = _mixed(spark, sf_dir).select("price", "qty", "tax", "flag")
    made, _ = models.regressions(d, ["price", "qty", "tax"], ["flag"], d.count(), charts=False)
    return spark.createDataFrame([(r["vars"][0], r["n"], r["extra"]["n_drop_frac"]) for r in made], "outcome string, n bigint, lost double").withColumn("lost", _r("lost"))


@query(f"WITH {M}, c AS (SELECT regr_slope(planted, qty) AS b, regr_intercept(planted, qty) AS a, avg(qty) AS mx, count(*) AS n, regr_sxx(planted, qty) AS sxx FROM m), e AS (SELECT planted - a - b * qty AS e, 1.0::DOUBLE / n + (qty - mx) * (qty - mx) / sxx AS h, n FROM m, c), s AS (SELECT sum(e * e) / (any_value(n) - 2) AS mse FROM e), d AS (SELECT e * e * h / (2 * mse * (1 - h) * (1 - h)) AS d, n FROM e, s) SELECT count(*) AS n, round(4.0::DOUBLE / count(*), 9) AS threshold, count(*) FILTER (d > 4.0::DOUBLE / n) AS n_above, round(max(d), 9) AS most FROM d")
def influence_counts(spark, sf_dir):
    """Row 138: what the series of Cook's distances says of all rows; its points are those of ``influence_series``."""
    d = models.design(_mixed(spark, sf_dir).withColumn("row", F.col("l_orderkey") * 10 + F.col("l_linenumber")), "planted", ["qty"], [])
    s = series.influence_series(d.df, models.fit(d).cooks, F.col("row"))
    return _rows(spark, [(s["n"], s["threshold"], s["n_above"], s["max"])], "n bigint, threshold double, n_above bigint, most double").select("n", _r("threshold", 9).alias("threshold"), "n_above", _r("most", 9).alias("most"))


def _all(spark, sf_dir, imputed=True):
    """The sweep of five numeric and three categorical columns, and that of its filled copy."""
    d = _mixed(spark, sf_dir).select(*_SWEEP_COLS[0], *_SWEEP_COLS[1])
    primary, filled = report.sweeps(d, *_SWEEP_COLS, imputed)
    frame = lambda rows: findings.with_q(results.as_frame(spark, rows))
    return frame(primary), frame(filled) if imputed else None


@query()
def sweep_all(spark, sf_dir):
    """Row 120: all five families over five numeric and three categorical columns."""
    return _all(spark, sf_dir, False)[0]


def _tests_sql() -> str:
    """How many tests of each family the rules ask for, of the swept columns."""
    num, cat = _SWEEP_COLS
    pairs = lambda c: [(a, b) for i, a in enumerate(c) for b in c[i + 1 :]]
    one = [f"SELECT 'correlation' AS family, (count(*) >= 10 AND min({a}) < max({a}) AND min({b}) < max({b}))::INT AS n FROM m WHERE {a} IS NOT NULL AND {b} IS NOT NULL" for a, b in pairs(num)]
    one += [f"SELECT 'group_difference', (count(*) BETWEEN 2 AND 20 AND min(lo) < max(hi))::INT FROM (SELECT min({a}) AS lo, max({a}) AS hi FROM m WHERE {b} IS NOT NULL GROUP BY {b} HAVING count({a}) >= 3)" for a in num for b in cat]
    one += [f"SELECT 'contingency', (count(*) >= 10 AND count(DISTINCT {a}) > 1 AND count(DISTINCT {b}) > 1)::INT FROM m WHERE {a} IS NOT NULL AND {b} IS NOT NULL" for a, b in pairs(cat)]
    one += [f"SELECT 'regression_model', (count({a}) > 0)::INT FROM m" for a in num]
    terms = f"{len(num) - 1} + " + " + ".join(f"count(DISTINCT coalesce({c}, 'nan')) - 1" for c in cat)
    one += [f"SELECT 'regression_coefficient', CASE WHEN count(*) FILTER ({' AND '.join(f'{a} IS NOT NULL' for a in num)}) >= 5 * ({terms}) THEN {terms} END FROM m" for _ in num]
    return f"WITH {M}, one AS ({_long(one)}) SELECT family, sum(n)::BIGINT AS n_tests FROM one GROUP BY family HAVING sum(n) > 0"


@query(_tests_sql())
def count_tests(spark, sf_dir):
    return findings.count_tests(_all(spark, sf_dir, False)[0])


@query()
def imputation_robustness(spark, sf_dir):
    done, filled_in = _all(spark, sf_dir)
    return findings.with_twins(findings.candidates(done), filled_in).select("family", "vars", "robustness")


_SPARSE = "CASE WHEN l_orderkey % 40 = 0 THEN planted END"


@query(with_p(f"{M}, x AS (SELECT qty, {_SPARSE} AS sparse FROM m), f AS (SELECT qty, coalesce(sparse, (SELECT median(sparse) FROM x)) AS sparse FROM x), c AS (SELECT 'complete' AS id, regr_count(sparse, qty) AS n, corr(sparse, qty) AS r FROM x UNION ALL SELECT 'filled', count(*), corr(sparse, qty) FROM f)", "SELECT id, 't' AS kind, abs(r) * sqrt((n - 2) / (1 - r * r)) AS stat, 1.0::DOUBLE AS d1, (n - 2)::DOUBLE AS d2 FROM c", "SELECT 'qty' AS a, 'sparse' AS b, round(x.r, 6) AS effect, round(p.p, 6) AS q, round(y.r, 6) AS filled_effect, round(o.p, 6) AS filled_q FROM c x, c y, pv p, pv o WHERE x.id = 'complete' AND y.id = 'filled' AND p.id = 'complete' AND o.id = 'filled' AND abs(x.r) >= 0.3 AND p.p < 0.05 AND NOT (abs(y.r) >= 0.3 AND o.p < 0.05)"))
def imputation_sensitivity(spark, sf_dir):
    """Row 126: a correlation of a column with many gaps that filling them takes away, with both effects and both q."""
    d = _mixed(spark, sf_dir).selectExpr("qty", f"{_SPARSE} AS sparse")
    run = lambda x: findings.with_q(results.as_frame(spark, association.correlations(x, ["qty", "sparse"], {})))
    changed = findings.sensitivity(findings.with_twins(findings.candidates(run(d)), run(modelling.imputed(d, ["qty", "sparse"], []))))
    return changed.select(F.col("vars")[0].alias("a"), F.col("vars")[1].alias("b"), _r("complete_case.effect").alias("effect"), _r("complete_case.q").alias("q"), _r("imputed.effect").alias("filled_effect"), _r("imputed.q").alias("filled_q"))


@query()
def imputation_sensitivity_of_all(spark, sf_dir):
    """Row 126 over the whole sweep."""
    done, filled_in = _all(spark, sf_dir)
    return findings.sensitivity(findings.with_twins(findings.candidates(done), filled_in))


@query()
def headline(spark, sf_dir):
    return findings.candidates(_all(spark, sf_dir, False)[0]).select("family", "vars", findings.headline().alias("headline"))


@query()
def caveats(spark, sf_dir):
    done, filled_in = _all(spark, sf_dir)
    return findings.with_twins(findings.candidates(done), filled_in).select("family", "vars", findings.caveats(_table(spark, sf_dir, "lineitem").count()).alias("caveats"))


@query()
def report_summary(spark, sf_dir):
    """Row 8: the library entry over orders, as one row of its record."""
    r = report.analyze(spark, _table(spark, sf_dir, "orders"), "orders", rows=False)
    return spark.createDataFrame([(r.record["data_quality"]["score"], len(r.record["findings"]), len(r.record["needs_review"]), len(r.markdown) > 0)], "score double, findings bigint, needs_review bigint, has_markdown boolean")


# series


@query("SELECT o_orderkey, round(o_totalprice, 2) AS price FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def top_k(spark, sf_dir):
    """Row 130: the limit is the feature."""
    return _table(spark, sf_dir, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25).select("o_orderkey", _r("o_totalprice", 2).alias("price"))


@query()
def scatter_sample(spark, sf_dir):
    """Row 132: a seeded draw, the same however the rows are partitioned."""
    return series.drawn(_table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), series.SCATTER_POINTS, F.col("o_orderkey"))


@query(f"WITH {M} SELECT round(regr_slope(planted, qty), 6) AS slope, round(regr_intercept(planted, qty) + regr_slope(planted, qty) * min(qty), 4) AS y0, round(regr_intercept(planted, qty) + regr_slope(planted, qty) * max(qty), 4) AS y1 FROM m")
def trend_line(spark, sf_dir):
    t = series.trend_of(_mixed(spark, sf_dir), F.col("qty"), F.col("planted"))
    return _rows(spark, [(t["slope"], t["y0"], t["y1"])], "slope double, y0 double, y1 double").select(_r("slope").alias("slope"), _r("y0", 4).alias("y0"), _r("y1", 4).alias("y1"))


@query(f"WITH {M}, {_Q}, l AS (SELECT greatest(min(wild), any_value(q1) - 3 * (any_value(q3) - any_value(q1))) AS lo, least(max(wild), any_value(q3) + 3 * (any_value(q3) - any_value(q1))) AS hi FROM m, q) SELECT round(lo - 0.05 * (hi - lo), 3) AS low, round(hi + 0.05 * (hi - lo), 3) AS high FROM l")
def robust_limits(spark, sf_dir):
    d = _mixed(spark, sf_dir)
    q1, q3 = quantiles(d, {"x": F.col("wild")}, [0.25, 0.75])["x"]
    got = total(d, {"a": F.min("wild"), "b": F.max("wild")})
    return _rows(spark, [tuple(series.limits_of(q1, q3, got["a"], got["b"]))], "low double, high double").select(_r("low", 3).alias("low"), _r("high", 3).alias("high"))


def _points(spark, s):
    return _rows(spark, [(float(a), float(b)) for a, b in s["points"]], "x double, y double")


@query()
def scatter_series(spark, sf_dir):
    return _points(spark, series.scatter_series(_mixed(spark, sf_dir), F.col("qty"), F.col("planted")))


@query()
def residual_series(spark, sf_dir):
    d = models.design(_mixed(spark, sf_dir), "planted", ["qty"], [])
    f = models.fit(d)
    return _points(spark, series.points_series(d.df, f.fitted, f.resid, series.RESIDUAL_POINTS))


@query(f"WITH {M}, a AS (SELECT qty - regr_intercept - regr_slope * disc AS ex, planted - i2 - s2 * disc AS ey FROM m, (SELECT regr_intercept(qty, disc) AS regr_intercept, regr_slope(qty, disc) AS regr_slope, regr_intercept(planted, disc) AS i2, regr_slope(planted, disc) AS s2 FROM m)) SELECT round(regr_slope(ey, ex), 6) AS slope, count(*) AS n FROM a")
def added_variable(spark, sf_dir):
    """Row 137: the slope of the partial regression of planted on qty beside disc."""
    d = models.design(_mixed(spark, sf_dir), "planted", ["qty", "disc"], [])
    s = models.partial_series(d, models.fit(d), "qty")
    return _rows(spark, [(s["slope"], s["n"])], "slope double, n bigint").select(_r("slope").alias("slope"), "n")


@query()
def influence_series(spark, sf_dir):
    d = models.design(_mixed(spark, sf_dir).withColumn("row", F.col("l_orderkey") * 10 + F.col("l_linenumber")), "planted", ["qty"], [])
    return _points(spark, series.influence_series(d.df, models.fit(d).cooks, F.col("row")))


@query(f"WITH {M}, c AS (SELECT flag AS a, echo AS b, count(*) AS n FROM m GROUP BY ALL), f AS (SELECT r.a, k.b, coalesce(n, 0) AS n FROM (SELECT DISTINCT a FROM c) r CROSS JOIN (SELECT DISTINCT b FROM c) k LEFT JOIN c ON c.a = r.a AND c.b = k.b) SELECT a, b, n, round(n::DOUBLE / sum(n) OVER (PARTITION BY a), 6) AS share FROM f")
def contingency_series(spark, sf_dir):
    s = series.contingency_series(association.tables(_mixed(spark, sf_dir), ["flag", "echo"])["flag", "echo"], "flag", "echo")
    rows = [(a, b, s["counts"][i][j], s["row_shares"][i][j]) for i, a in enumerate(s["rows"]) for j, b in enumerate(s["cols"])]
    return _rows(spark, rows, "a string, b string, n bigint, share double").select("a", "b", "n", _r("share").alias("share"))


_PLACE = {c: i for i, c in enumerate(_SWEEP_COLS[0])}


@query(f"WITH {M} " + _long([f"SELECT {_PLACE[a]}::INT AS i, {_PLACE[b]}::INT AS j, round(corr({b}, {a}), 6) AS value FROM m" for a, b in _BH_PAIRS] + [f"SELECT {i}::INT AS i, {i}::INT AS j, 1.0::DOUBLE AS value" for i in range(5)]))
def correlation_matrix(spark, sf_dir):
    return series.correlation_matrix(_SWEEP_COLS[0], _results(spark, sf_dir)).select("i", "j", _r("value").alias("value"))


@query('SELECT DISTINCT "column" AS name FROM (' + " UNION ALL ".join(f"(SELECT * FROM ({_oracles[k]}))" for k in ("dq_outliers", "dq_skew", "dq_heavy_tails")) + f""") WHERE "column" IN ({", ".join(f"'{c}'" for c in NUMERIC)})""")
def flagged_columns(spark, sf_dir):
    """Row 144: columns with an issue of shape, that have a box."""
    frame = _profile_frame(spark, sf_dir)
    n, columns = catalog.profile(frame)
    boxed = {p.name for p in columns if p.stats}
    names = {i["column"] for i in quality.issues_of(frame, n, columns) if i["kind"] in ("outliers", "extreme_values", "skew", "heavy_tails")}
    return spark.createDataFrame([(c,) for c in sorted(names & boxed)], "name string")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_oracles)
