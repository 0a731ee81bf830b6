"""Profiling queries (A1-A16, F3, F4, T1, T2) and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablelens.catalog.fixtures import GAPPY_COLUMNS, GAPPY_SQL, orders_gappy, rounded, table, union_sql
from tablelens.operators import correlate as C
from tablelens.operators import profile as P

LINEITEM_NUMERIC = [
    "l_orderkey",
    "l_partkey",
    "l_suppkey",
    "l_linenumber",
    "l_quantity",
    "l_extendedprice",
    "l_discount",
    "l_tax",
]
TEXT_TYPES = ("string",)


def _profile(spark, sf):
    digits = {
        "mean": 6, "std": 5, "variance": 1, "skewness": 6, "kurtosis": 6, "total": 2, "min_number": 2,
        "max_number": 2, "mean_length": 6, "missing_share": 6, "distinct_share": 6,
        **{p: 4 for p in (*P.PROFILE_QUANTILES, "iqr")},
    }
    return rounded(P.column_profile(orders_gappy(spark, sf)), digits)


def _approx_error(spark, sf):
    """Whether each estimate is within three standard errors of the exact count."""
    df = table(spark, sf, "lineitem")
    exact = P.distinct_counts(df).select("position", "column_name", F.col("n_distinct").alias("exact"))
    close = F.abs(F.col("n_distinct") - F.col("exact")) <= 0.15 * F.col("exact")
    return exact.join(P.approx_distinct(df).drop("column_name"), "position").select("column_name", "exact", close.alias("close"))


WIDE_NUMERIC = [*LINEITEM_NUMERIC, "o_custkey", "o_totalprice", "p_size", "p_retailprice", "o_orderkey"]


DECIMALS = ["l_quantity", "l_extendedprice", "l_tax"]


def _decimals(s, d):
    return table(s, d, "lineitem").select(*[F.col(c).cast("decimal(14,2)").alias(c) for c in DECIMALS])


def _wide_matrix(s, d):
    """Thirteen columns of three tables, one of them twice."""
    lines, orders, parts = (table(s, d, n) for n in ("lineitem", "orders", "part"))
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(parts, F.col("l_partkey") == F.col("p_partkey"))
    return rounded(C.corr_matrix(joined, WIDE_NUMERIC), {"r": 6})


QUERIES = {
    "dataset_info": lambda s, d: P.dataset_info(orders_gappy(s, d)),
    "memory_estimate": lambda s, d: rounded(P.memory_estimate(table(s, d, "documents")), {"megabytes": 8}),
    "missing_counts": lambda s, d: P.missing_counts(orders_gappy(s, d)),
    "schema_info": lambda s, d: P.schema_info(orders_gappy(s, d)),
    "duplicate_rows": lambda s, d: P.duplicate_rows(table(s, d, "events").select("user_id", "event_type")),
    "describe_basic": lambda s, d: rounded(
        P.describe_basic(orders_gappy(s, d)), {"mean": 6, "std": 5, "min_number": 2, "max_number": 2}
    ),
    "describe_full": lambda s, d: rounded(
        P.describe_full(orders_gappy(s, d)),
        {"mean": 6, "std": 5, "min_number": 2, "max_number": 2, "p25": 4, "p50": 4, "p75": 4},
    ),
    "distinct_counts": lambda s, d: P.distinct_counts(orders_gappy(s, d)),
    "distinct_counts_with_null": lambda s, d: P.distinct_counts(orders_gappy(s, d), include_null=True),
    "approx_distinct_error": _approx_error,
    "approx_distinct": lambda s, d: P.approx_distinct(table(s, d, "lineitem")),
    "corr_adjacent": lambda s, d: rounded(C.corr_adjacent(table(s, d, "lineitem")), {"r": 6}),
    "corr_matrix": lambda s, d: rounded(C.corr_matrix(table(s, d, "lineitem")), {"r": 6}),
    "corr_matrix_wide": _wide_matrix,
    "column_modes_decimal": lambda s, d: P.column_modes(_decimals(s, d)),
    "distinct_counts_decimal": lambda s, d: P.distinct_counts(_decimals(s, d)),
    "column_means": lambda s, d: rounded(P.column_means(orders_gappy(s, d)), {"mean": 6}),
    "column_modes": lambda s, d: P.column_modes(orders_gappy(s, d)),
    "value_counts": lambda s, d: P.value_counts(orders_gappy(s, d), "o_orderpriority"),
    "column_profile": _profile,
    "column_profile_approx": lambda s, d: P.column_profile(table(s, d, "lineitem"), approx=True),
    "profile_alerts": lambda s, d: P.profile_alerts(P.column_profile(orders_gappy(s, d))),
    "select_numeric": lambda s, d: P.select_numeric(table(s, d, "orders")),
    "filter_missing": lambda s, d: P.filter_missing(orders_gappy(s, d), "o_totalprice").select(
        "o_orderkey", "o_custkey"
    ),
    "sample_rows": lambda s, d: P.sample_rows(table(s, d, "customer"), ["c_custkey"], 5),
    "top_value": lambda s, d: P.top_value(orders_gappy(s, d), "o_orderpriority"),
}


def _numeric(kind: str) -> bool:
    return kind not in TEXT_TYPES


def _number(c: str, kind: str) -> str:
    return f"CAST({c} AS DOUBLE)" if _numeric(kind) else "CAST(NULL AS DOUBLE)"


def _text(c: str, kind: str) -> str:
    return "CAST(NULL AS VARCHAR)" if _numeric(kind) else c


def _each(select, source="known") -> str:
    """One SELECT per column of the gappy orders."""
    return f"WITH {GAPPY_SQL}\n" + union_sql(
        [f"SELECT CAST({i} AS INTEGER) AS position, '{c}' AS column_name, {select(c, k)} FROM {source}"
         for i, (c, k) in enumerate(GAPPY_COLUMNS)]
    )


def _basic(c, k):
    v = _number(c, k)
    return (
        f"count({c}) AS n, round(avg({v}), 6) AS mean, round(stddev_samp({v}), 5) AS std, "
        f"round(min({v}), 2) AS min_number, round(max({v}), 2) AS max_number"
    )


def _top(c: str, what: str) -> str:
    order = "ORDER BY count(*) DESC, {0} LIMIT 1".format(c)
    pick = f"CAST({c} AS VARCHAR)" if what == "top" else "count(*)"
    return f"(SELECT {pick} FROM known WHERE {c} IS NOT NULL GROUP BY {c} {order})"


def _quantile(c: str, k: str, p: float) -> str:
    return f"round(quantile_cont({_number(c, k)}, {p}), 4)"


def _full(c, k):
    text = not _numeric(k)
    unique = f"CASE WHEN count({c}) > 0 THEN count(DISTINCT {c}) END" if text else "CAST(NULL AS BIGINT)"
    top = _top(c, "top") if text else "CAST(NULL AS VARCHAR)"
    freq = _top(c, "freq") if text else "CAST(NULL AS BIGINT)"
    cuts = ", ".join(f"{_quantile(c, k, p)} AS {name}" for name, p in P.QUARTILES.items())
    return f"{_basic(c, k)}, {unique} AS n_unique, {top} AS top, {freq} AS top_freq, {cuts}"


def _profile_columns(c, k):
    v = _number(c, k)
    length = "CAST(NULL AS INTEGER)" if _numeric(k) else f"CAST(length({c}) AS INTEGER)"
    present = f"count({c})"
    cuts = ", ".join(f"{_quantile(c, k, p)} AS {name}" for name, p in P.PROFILE_QUANTILES.items())
    spread = f"round(quantile_cont({v}, 0.75) - quantile_cont({v}, 0.25), 4)"
    return (
        f"'{k}' AS data_type, count(*) AS n_rows, count(*) - {present} AS n_missing, "
        f"count(CASE WHEN {v} = 0 THEN 1 END) AS n_zeros, count(CASE WHEN {v} < 0 THEN 1 END) AS n_negative, "
        f"round(min({v}), 2) AS min_number, round(max({v}), 2) AS max_number, round(avg({v}), 6) AS mean, "
        f"round(stddev_samp({v}), 5) AS std, round(var_samp({v}), 1) AS variance, "
        f"round(skewness({v}) * (count({v}) - 2) / sqrt(CAST(count({v}) AS DOUBLE) * (count({v}) - 1)), 6) AS skewness, "
        f"round(kurtosis_pop({v}), 6) AS kurtosis, round(sum({v}), 2) AS total, "
        f"min({length}) AS min_length, round(avg({length}), 6) AS mean_length, max({length}) AS max_length, "
        f"{_top(c, 'top')} AS top, {_top(c, 'freq')} AS top_freq, count(DISTINCT {c}) AS n_distinct, {cuts}, "
        f"round((count(*) - {present}) / CAST(count(*) AS DOUBLE), 6) AS missing_share, "
        f"CASE WHEN {present} > 0 THEN round(count(DISTINCT {c}) / CAST({present} AS DOUBLE), 6) ELSE 0.0 END AS distinct_share, "
        f"{present} > 0 AND count(DISTINCT {c}) = {present} AS is_unique, count(DISTINCT {c}) = 1 AS is_constant, "
        f"{spread} AS iqr"
    )


def _corr(x, y):
    return f"SELECT '{x}' AS x, '{y}' AS y, round(corr({x}, {y}), 6) AS r FROM lineitem"


_ALERTS = union_sql(
    [
        "SELECT position, column_name, 'constant' AS alert FROM p WHERE n_distinct = 1",
        "SELECT position, column_name, 'unique' FROM p WHERE n > 0 AND n_distinct = n",
        "SELECT position, column_name, 'high_missing' FROM p WHERE (n_rows - n) / CAST(n_rows AS DOUBLE) > 0.05",
        "SELECT position, column_name, 'high_zeros' FROM p WHERE n > 0 AND n_zeros / CAST(n AS DOUBLE) > 0.1",
        "SELECT position, column_name, 'high_cardinality' FROM p WHERE is_text AND n_distinct > 50",
    ]
)

SQL = {
    "dataset_info": _each(
        lambda c, k: f"'{k}' AS data_type, count(*) - count({c}) AS n_missing, count(*) AS n_rows, "
        f"CAST({len(GAPPY_COLUMNS)} AS BIGINT) AS n_columns"
    ),
    "memory_estimate": union_sql(
        [
            f"SELECT CAST({i} AS INTEGER) AS position, '{c}' AS column_name, CAST({size} AS BIGINT) AS n_bytes, "
            f"round({size} / 1048576.0::DOUBLE, 8) AS megabytes FROM documents"
            for i, (c, size) in enumerate(
                [("doc_id", "count(*) * 8")]
                + [(c, f"sum(octet_length(encode({c})))") for c in ("text", "lang", "source")]
                + [("n_chars", "count(*) * 8")]
            )
        ]
    ),
    "missing_counts": _each(lambda c, k: f"count(*) - count({c}) AS n_missing"),
    "schema_info": _each(lambda c, k: f"'{k}' AS data_type, count({c}) AS n_present"),
    "duplicate_rows": "SELECT CAST(sum(n - 1) AS BIGINT) AS n_duplicates FROM "
    "(SELECT count(*) AS n FROM events GROUP BY user_id, event_type) g",
    "describe_basic": _each(
        lambda c, k: f"{_basic(c, k)}, min({_text(c, k)}) AS min_text, max({_text(c, k)}) AS max_text"
    ),
    "describe_full": _each(_full),
    "distinct_counts": _each(lambda c, k: f"count(DISTINCT {c}) AS n_distinct"),
    "distinct_counts_with_null": _each(
        lambda c, k: f"count(DISTINCT {c}) + CASE WHEN count(*) > count({c}) THEN 1 ELSE 0 END AS n_distinct"
    ),
    "approx_distinct_error": union_sql(
        [
            f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS exact, true AS close FROM lineitem"
            for c in [*LINEITEM_NUMERIC, "l_returnflag", "l_linestatus", "l_shipdate"]
        ]
    ),
    "corr_adjacent": union_sql([_corr(x, y) for x, y in zip(LINEITEM_NUMERIC, LINEITEM_NUMERIC[1:])]),
    "corr_matrix": union_sql([_corr(x, y) for x in LINEITEM_NUMERIC for y in LINEITEM_NUMERIC]),
    "column_modes_decimal": union_sql(
        [
            f"(SELECT {i} AS position, '{c}' AS column_name, CAST(CAST({c} AS DECIMAL(14,2)) AS VARCHAR) AS mode, count(*) AS n "
            "FROM lineitem GROUP BY CAST({0} AS DECIMAL(14,2)) ORDER BY count(*) DESC, CAST({0} AS DECIMAL(14,2)) LIMIT 1)".format(c)
            for i, c in enumerate(DECIMALS)
        ]
    ),
    "distinct_counts_decimal": union_sql(
        [
            f"SELECT {i} AS position, '{c}' AS column_name, count(DISTINCT CAST({c} AS DECIMAL(14,2))) AS n_distinct FROM lineitem"
            for i, c in enumerate(DECIMALS)
        ]
    ),
    "corr_matrix_wide": union_sql(
        [
            f"SELECT '{x}' AS x, '{y}' AS y, round(corr({x}, {y}), 6) AS r FROM lineitem JOIN orders ON l_orderkey = o_orderkey "
            "JOIN part ON l_partkey = p_partkey"
            for x in WIDE_NUMERIC
            for y in WIDE_NUMERIC
        ]
    ),
    "column_means": f"WITH {GAPPY_SQL}\n"
    + union_sql(
        [
            f"SELECT CAST({i} AS INTEGER) AS position, '{c}' AS column_name, round(avg({c}), 6) AS mean FROM known"
            for i, c in enumerate(["o_orderkey", "o_custkey", "o_totalprice"])
        ]
    ),
    "column_modes": f"WITH {GAPPY_SQL}\n"
    + union_sql(
        [
            f"SELECT CAST({i} AS INTEGER) AS position, '{c}' AS column_name, {_top(c, 'top')} AS mode, "
            f"{_top(c, 'freq')} AS n"
            for i, (c, _) in enumerate(GAPPY_COLUMNS)
        ]
    ),
    "value_counts": f"WITH {GAPPY_SQL} SELECT o_orderpriority AS value, count(*) AS n FROM known "
    "WHERE o_orderpriority IS NOT NULL GROUP BY 1",
    "column_profile": _each(_profile_columns),
    "profile_alerts": f"WITH {GAPPY_SQL}, p AS ("
    + union_sql(
        [
            f"SELECT CAST({i} AS INTEGER) AS position, '{c}' AS column_name, {'false' if _numeric(k) else 'true'} AS is_text, "
            f"count(*) AS n_rows, count({c}) AS n, count(DISTINCT {c}) AS n_distinct, "
            f"count(CASE WHEN {_number(c, k)} = 0 THEN 1 END) AS n_zeros FROM known"
            for i, (c, k) in enumerate(GAPPY_COLUMNS)
        ]
    )
    + f")\n{_ALERTS}",
    "select_numeric": "SELECT o_orderkey, o_custkey, o_totalprice FROM orders",
    "filter_missing": f"WITH {GAPPY_SQL} SELECT o_orderkey, o_custkey FROM known WHERE o_totalprice IS NULL",
    "sample_rows": "SELECT * FROM customer ORDER BY c_custkey LIMIT 5",
    "top_value": f"WITH {GAPPY_SQL} SELECT o_orderpriority AS value, count(*) AS n FROM known "
    "WHERE o_orderpriority IS NOT NULL GROUP BY 1 ORDER BY n DESC, value LIMIT 1",
}
