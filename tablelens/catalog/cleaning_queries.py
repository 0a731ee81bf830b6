"""Cleaning, encoding and splitting queries (S2, F1, F2, F5, C1-C13) and their SQL."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tablelens.catalog.fixtures import GAPPY_SQL, orders_gappy, rounded, table
from tablelens.operators import clean as K
from tablelens.operators import encode as E
from tablelens.plans.cleaning import clean_table

CLEAN_INSTRUCTIONS = {
    "drop_columns": ["o_custkey", "no_such_column"],
    "problem_type": ["regression"],
    "label_encoding": [],
    "standard_scalar": ["yes"],
    "target_column": ["o_totalprice"],
}
CLASS_INSTRUCTIONS = {
    "problem_type": ["classification"],
    "standard_scalar": ["Yes"],
    "target_column": ["o_custkey"],
}
SCALED = ["o_custkey", "o_totalprice"]


def _gappy_no_empty(s, d):
    return K.drop_columns(orders_gappy(s, d), ["empty_col"])


def _scaled(center, ddof):
    def run(s, d):
        df = table(s, d, "orders").select("o_orderkey", *SCALED)
        return rounded(K.scale(df, SCALED, center, ddof), dict.fromkeys(SCALED, 6))

    return run


def _encoded(order, missing_text):
    def run(s, d):
        df = orders_gappy(s, d).select("o_orderkey", "o_orderstatus", "o_orderpriority")
        return E.label_encode(df, ["o_orderstatus", "o_orderpriority", "no_such_column"], order, missing_text)

    return run


def _split(s, d):
    train, test = E.train_test_split(table(s, d, "orders").select("o_orderkey"), ["o_orderkey"])
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))


def _split_counts(s, d):
    """Whether each key is in one part and the parts have their sizes within one percent of the rows."""
    by_key = _split(s, d).groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("n"), F.min("part").alias("part"))
    return by_key.agg(
        F.count(F.lit(1)).alias("n_keys"),
        F.count(F.when(F.col("n") > 1, F.lit(1))).alias("n_in_both"),
        (F.abs(F.avg((F.col("part") == "train").cast("int")) - 0.8) < 0.01).alias("share_holds"),
    )


def _folds(s, d):
    return E.with_fold(table(s, d, "orders").select("o_orderkey"), ["o_orderkey"], 3)


def _features(s, d):
    df = table(s, d, "lineitem").select("l_quantity", "l_discount", "l_tax", "l_extendedprice")
    features, target = E.features_target(df, "l_extendedprice", "regression")
    return df.select(*features, F.col(target).alias("target"))


def _assembled(s, d):
    df = table(s, d, "lineitem").select("l_orderkey", "l_quantity", "l_linenumber", "l_discount")
    columns = ["l_quantity", "l_linenumber", "l_discount"]
    values = vector_to_array("features")
    return E.assemble_features(df, columns).select(
        "l_orderkey", *[F.get(values, F.lit(i)).alias(f"f{i}") for i in range(len(columns))]
    )


QUERIES = {
    "drop_index_col": lambda s, d: K.drop_index_column(
        table(s, d, "orders").select(F.col("o_orderkey").alias("_c0"), "o_orderkey", "o_totalprice")
    ),
    "drop_columns": lambda s, d: K.drop_columns(
        table(s, d, "orders").drop("o_orderdate"), ["o_custkey", "no_such_column"]
    ),
    "drop_empty_columns": lambda s, d: K.drop_empty_columns(
        orders_gappy(s, d).select("o_orderkey", "o_orderstatus", "o_orderpriority", "empty_col")
    ),
    "features_target": _features,
    "impute_mean": lambda s, d: rounded(K.impute_mean(_gappy_no_empty(s, d)), {"o_totalprice": 4}),
    "impute_mode": lambda s, d: K.impute_mode(orders_gappy(s, d).drop("o_totalprice")),
    "fill_constant": lambda s, d: K.fill_constant(
        orders_gappy(s, d).select("o_orderkey", "o_orderpriority"), ["o_orderpriority", "no_such_column"]
    ),
    "label_encode_freq": _encoded("frequency", None),
    "label_encode_sorted": _encoded("sorted", "nan"),
    "scale_zscore": _scaled(True, 0),
    "scale_zscore_sample": _scaled(True, 1),
    "scale_std_only": _scaled(False, 1),
    "scale_gated": lambda s, d: rounded(
        K.scale_gated(table(s, d, "orders").drop("o_orderdate"), CLASS_INSTRUCTIONS),
        {"o_orderkey": 6, "o_totalprice": 6},
    ),
    "clean_table": lambda s, d: rounded(
        clean_table(orders_gappy(s, d), CLEAN_INSTRUCTIONS), {"o_orderkey": 6, "o_totalprice": 6}
    ),
    "train_test_split": _split,
    "train_test_split_counts": _split_counts,
    "fold_assignment": _folds,
    "assemble_features": _assembled,
    "label_index": lambda s, d: E.label_index(
        orders_gappy(s, d).select("o_orderkey", "o_orderpriority"), "o_orderpriority"
    ),
    "label_index_many": lambda s, d: E.label_index(table(s, d, "orders").select("o_orderkey", "o_custkey"), "o_orderkey"),
    "label_encode_many": lambda s, d: E.label_encode(
        table(s, d, "documents").select("doc_id", "text", "lang", "source"), ["text", "lang", "source"]
    ),
}


def _scale_sql(deviation: str, center: bool) -> str:
    def part(c):
        shift = f" - (SELECT avg({c}) FROM orders)" if center else ""
        return f"round(({c}{shift}) / (SELECT {deviation}({c}) FROM orders), 6) AS {c}"

    return f"SELECT o_orderkey, {', '.join(part(c) for c in SCALED)} FROM orders"


def _codes(c: str, order: str) -> str:
    return f"(SELECT {c} AS v, row_number() OVER (ORDER BY {order}) - 1 AS code FROM known WHERE {c} IS NOT NULL GROUP BY {c})"


_MODE = (
    "(SELECT o_orderpriority FROM known WHERE o_orderpriority IS NOT NULL GROUP BY 1 "
    "ORDER BY count(*) DESC, o_orderpriority LIMIT 1)"
)
_PRICE = "coalesce(o_totalprice, (SELECT avg(o_totalprice) FROM known))"

SQL = {
    "drop_index_col": "SELECT o_orderkey, o_totalprice FROM orders",
    "drop_columns": "SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders",
    "drop_empty_columns": f"WITH {GAPPY_SQL} SELECT o_orderkey, o_orderstatus, o_orderpriority FROM known",
    "features_target": "SELECT l_quantity, l_discount, l_tax, l_extendedprice AS target FROM lineitem",
    "impute_mean": f"WITH {GAPPY_SQL} SELECT CAST(o_orderkey AS DOUBLE) AS o_orderkey, "
    f"CAST(o_custkey AS DOUBLE) AS o_custkey, o_orderstatus, round({_PRICE}, 4) AS o_totalprice, o_orderpriority FROM known",
    "impute_mode": f"WITH {GAPPY_SQL} SELECT o_orderkey, o_custkey, o_orderstatus, "
    f"coalesce(o_orderpriority, {_MODE}) AS o_orderpriority, 'missing' AS empty_col FROM known",
    "fill_constant": f"WITH {GAPPY_SQL} SELECT o_orderkey, coalesce(o_orderpriority, 'missing') AS o_orderpriority FROM known",
    "label_encode_freq": f"""WITH {GAPPY_SQL}
SELECT o_orderkey, s.code AS o_orderstatus,
       coalesce(p.code, (SELECT count(DISTINCT o_orderpriority) FROM known)) AS o_orderpriority
FROM known LEFT JOIN {_codes('o_orderstatus', 'count(*) DESC, o_orderstatus')} s ON o_orderstatus = s.v
LEFT JOIN {_codes('o_orderpriority', 'count(*) DESC, o_orderpriority')} p ON o_orderpriority = p.v""",
    "label_encode_sorted": f"""WITH {GAPPY_SQL}, named AS (
  SELECT o_orderkey, o_orderstatus, coalesce(o_orderpriority, 'nan') AS o_orderpriority FROM known)
SELECT o_orderkey, dense_rank() OVER (ORDER BY o_orderstatus) - 1 AS o_orderstatus,
       dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS o_orderpriority FROM named""",
    "scale_zscore": _scale_sql("stddev_pop", True),
    "scale_zscore_sample": _scale_sql("stddev_samp", True),
    "scale_std_only": _scale_sql("stddev_samp", False),
    "scale_gated": """SELECT
  round((o_orderkey - (SELECT avg(o_orderkey) FROM orders)) / (SELECT stddev_pop(o_orderkey) FROM orders), 6) AS o_orderkey,
  o_custkey, o_orderstatus,
  round((o_totalprice - (SELECT avg(o_totalprice) FROM orders)) / (SELECT stddev_pop(o_totalprice) FROM orders), 6) AS o_totalprice,
  o_orderpriority FROM orders""",
    "clean_table": f"""WITH {GAPPY_SQL}, filled AS (
  SELECT CAST(o_orderkey AS DOUBLE) AS k, o_orderstatus, {_PRICE} AS price,
         coalesce(o_orderpriority, {_MODE}) AS o_orderpriority FROM known)
SELECT round((k - (SELECT avg(k) FROM filled)) / (SELECT stddev_pop(k) FROM filled), 6) AS o_orderkey,
       o_orderstatus,
       round((price - (SELECT avg(price) FROM filled)) / (SELECT stddev_pop(price) FROM filled), 6) AS o_totalprice,
       o_orderpriority FROM filled""",
    "train_test_split_counts": "SELECT count(*) AS n_keys, CAST(0 AS BIGINT) AS n_in_both, true AS share_holds FROM orders",
    "assemble_features": "SELECT l_orderkey, l_quantity AS f0, CAST(l_linenumber AS DOUBLE) AS f1, l_discount AS f2 FROM lineitem",
    "label_index": f"""WITH {GAPPY_SQL}
SELECT o_orderkey, o_orderpriority, CAST(p.code AS DOUBLE) AS label FROM known
JOIN {_codes('o_orderpriority', 'count(*) DESC, o_orderpriority')} p ON o_orderpriority = p.v""",
    "label_index_many": """WITH c AS (SELECT o_orderkey AS v, row_number() OVER (ORDER BY count(*) DESC, CAST(o_orderkey AS VARCHAR)) - 1 AS code
  FROM orders GROUP BY o_orderkey)
SELECT o_orderkey, o_custkey, CAST(code AS DOUBLE) AS label FROM orders JOIN c ON o_orderkey = v""",
    "label_encode_many": "WITH "
    + ", ".join(
        f"c_{c} AS (SELECT {c} AS v, row_number() OVER (ORDER BY count(*) DESC, {c}) - 1 AS code FROM documents GROUP BY {c})"
        for c in ("text", "lang", "source")
    )
    + """ SELECT doc_id, c_text.code AS text, c_lang.code AS lang, c_source.code AS source FROM documents
JOIN c_text ON text = c_text.v JOIN c_lang ON lang = c_lang.v JOIN c_source ON source = c_source.v""",
}
