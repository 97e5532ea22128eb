"""Whole-table profiles, outliers, correlations and missing reports."""

from pyspark.sql import functions as F

from ledgerlens.functions import scalars as S
from ledgerlens.operators import columns as C
from ledgerlens.operators import profile as P
from ledgerlens.plans.registry import query

DTYPES = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string"}


def _profile_sql(table, columns, scale="fine"):
    """One SELECT per column; ``columns`` maps names to Spark type names."""
    parts = []
    low = (
        "WHEN u=n THEN 'unique' WHEN u<=20 THEN 'low-cardinality' ELSE 'high-cardinality'" if scale == "coarse"
        else "WHEN u<=10 THEN 'low-cardinality' WHEN u<=50 THEN 'medium-cardinality' ELSE 'high-cardinality'"
    )
    for c, t in columns.items():
        parts.append(f"""SELECT '{c}' AS "column", '{t}' AS dtype, n-k AS n_missing, 100.0*(n-k)/n AS pct_missing, u AS n_unique,
  CASE WHEN u=1 THEN 'constant' WHEN u=2 THEN 'binary' {low} END AS cardinality_type, top*1.0/n AS top_share
FROM (SELECT count(*) n, count({c}) k, count(DISTINCT {c}) u FROM {table}),
     (SELECT coalesce(max(m),0) top FROM (SELECT count(*) m FROM {table} WHERE {c} IS NOT NULL GROUP BY {c}))""")
    return "\nUNION ALL\n".join(parts)


PART = {"p_partkey": "bigint", "p_name": "string", "p_brand": "string", "p_type": "string", "p_size": "int", "p_retailprice": "double"}
HOLED_PART = """(SELECT p_partkey, CASE WHEN p_size>10 THEN p_size END AS p_size, CASE WHEN p_retailprice<1000 THEN p_retailprice END AS p_retailprice,
   CASE WHEN p_type<>'SMALL' THEN p_type END AS p_type, p_brand FROM part) q"""


def holed_part(t):
    return t.part.select(
        "p_partkey",
        F.when(F.col("p_size") > 10, F.col("p_size")).alias("p_size"),
        F.when(F.col("p_retailprice") < 1000, F.col("p_retailprice")).alias("p_retailprice"),
        F.when(F.col("p_type") != "SMALL", F.col("p_type")).alias("p_type"),
        "p_brand",
    )


@query("profile_columns", "F1 F3", _profile_sql("part", PART), "pct_missing top_share")
def profile_columns(t):
    return P.profile_columns(t.part).drop("sample_values")


@query("profile_columns_holed", "F1 F3 F5", _profile_sql(HOLED_PART, {"p_partkey": "bigint", "p_size": "int", "p_retailprice": "double", "p_type": "string", "p_brand": "string"}, "coarse"), "pct_missing top_share")
def profile_columns_holed(t):
    return P.profile_columns(holed_part(t), scale="coarse").drop("sample_values")


@query("profile_samples", "F1", " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", array_to_string(list(v ORDER BY v), ', ') AS sample_values
    FROM (SELECT DISTINCT CAST({c} AS VARCHAR) v FROM customer WHERE {c} IS NOT NULL ORDER BY v LIMIT 3)"""
    for c in ("c_name", "c_mktsegment", "c_nationkey")))
def profile_samples(t):
    return P.profile_columns(t.customer, ["c_name", "c_mktsegment", "c_nationkey"]).select("column", "sample_values")


PRICED = ["l_quantity", "l_extendedprice", "l_net"]
LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _numeric_sql(table, columns):
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(*) AS total_rows, count({c}) AS non_null, avg({c}) AS mean, stddev_samp({c}) AS std, CAST(min({c}) AS DOUBLE) AS min,
        CAST(max({c}) AS DOUBLE) AS max, coalesce(skewness({c}),0) AS skew, count(*)-count({c}) AS null_count, 100.0*(count(*)-count({c}))/count(*) AS null_pct FROM {table}"""
        for c in columns)


@query("profile_numeric", "F2 F24 F25", _numeric_sql("lineitem", LINE), "mean std min max skew null_pct")
def profile_numeric(t):
    return P.numeric_profile(t.lineitem, LINE)


@query("describe_columns", "F20", " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count({c}) AS count, avg({c}) AS mean, stddev_samp({c}) AS std, min({c}) AS min, max({c}) AS max,
    quantile_cont({c},0.25) AS q25, quantile_cont({c},0.5) AS q50, quantile_cont({c},0.75) AS q75 FROM lineitem""" for c in LINE),
    "mean std min max q25 q50 q75")
def describe_columns(t):
    return P.describe(t.lineitem, LINE)


_MEASURES = "total_rows non_null null_count null_pct mean std min median max skew".split()


def _side(expr, table):
    return f"""SELECT CAST(count(*) AS DOUBLE) total_rows, CAST(count(x) AS DOUBLE) non_null, CAST(count(*)-count(x) AS DOUBLE) null_count,
    100.0*(count(*)-count(x))/count(*) null_pct, avg(x) mean, stddev_samp(x) std, CAST(min(x) AS DOUBLE) min, quantile_cont(x,0.5) median, CAST(max(x) AS DOUBLE) max, coalesce(skewness(x),0) skew
    FROM (SELECT {expr} AS x FROM {table})"""


@query("compare_profiles", "F22 F23 U5", " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", """ + ", ".join(f"b.{m} AS {m}_before, a.{m} AS {m}_after, a.{m}-b.{m} AS {m}_delta" for m in _MEASURES)
    + f" FROM ({_side(b, 'customer')}) b, ({_side(a, 'customer')}) a"
    for c, b, a in (("c_acctbal", "c_acctbal", "CASE WHEN c_acctbal>=0 THEN least(c_acctbal, 9000.0) END"), ("c_nationkey", "c_nationkey", "c_nationkey"), ("c_custkey", "c_custkey", "c_custkey"))),
    " ".join(f"{m}_{s}" for m in _MEASURES for s in ("before", "after", "delta")))
def compare_profiles(t):
    before = t.customer
    after = before.withColumn("c_acctbal", F.when(F.col("c_acctbal") >= 0, S.clip("c_acctbal", None, 9000.0)))
    return P.compare_profiles(before, after)


@query("target_distribution", "F4 W18", """
SELECT o_orderstatus, count(*) AS count, round(100.0*count(*)/sum(count(*)) OVER (),3) AS pct FROM orders GROUP BY 1""", "pct")
def target_distribution(t):
    return P.target_distribution(t.orders, "o_orderstatus")


@query("class_balance", "F12", """
SELECT count(*) AS total, count(CASE WHEN f=1 THEN 1 END) AS positives, count(CASE WHEN f=0 THEN 1 END) AS negatives, avg(f) AS positive_rate, count(CASE WHEN f=0 THEN 1 END)*1.0/count(CASE WHEN f=1 THEN 1 END) AS imbalance_ratio
FROM (SELECT CAST(o_orderstatus='F' AS INTEGER) f FROM orders)""", "positive_rate imbalance_ratio")
def class_balance(t):
    return P.class_balance(t.orders.select(S.flag(F.col("o_orderstatus") == "F").alias("f")), "f")


@query("duplicates", "F6 U2 U3", """
SELECT n_rows, 3 AS n_columns, CAST(n_rows-d AS BIGINT) AS n_duplicates, 0 AS n_missing_columns, 2 AS n_numeric, 1 AS n_text, 0 AS n_other
FROM (SELECT count(*) n_rows FROM lineitem), (SELECT count(*) d FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_returnflag FROM lineitem))""")
def duplicates(t):
    return P.table_facts(t.lineitem.select("l_orderkey", "l_linenumber", "l_returnflag"))


_MISS = ["p_partkey", "p_size", "p_retailprice", "p_type", "p_brand"]
_CATEGORY = """CASE WHEN pct_missing=0 THEN 'complete' WHEN pct_missing<10 THEN 'low (<10%)' WHEN pct_missing<50 THEN 'medium (10-50%)'
 WHEN pct_missing<90 THEN 'high (50-90%)' ELSE 'extreme (>90%)' END"""
MISSING_SQL = f"SELECT *, {_CATEGORY} AS category FROM (" + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count(*)-count({c}) AS n_missing, 100.0*(count(*)-count({c}))/count(*) AS pct_missing FROM {HOLED_PART}""" for c in _MISS) + ")"


@query("missing_report", "F5 F7", f"SELECT * FROM ({MISSING_SQL}) WHERE pct_missing>0", "pct_missing")
def missing_report(t):
    return P.missing_only(P.missing_report(holed_part(t)))


@query("missing_categories", "F7", f"SELECT category, count(*) AS n_columns FROM ({MISSING_SQL}) GROUP BY 1")
def missing_categories(t):
    return P.missing_categories(P.missing_report(holed_part(t)))


@query("column_groups", "F8 F9", f"""
SELECT CASE WHEN "column" IN ('p_type','p_brand') THEN 'class' WHEN "column" IN ('p_size','p_retailprice') THEN 'measure' ELSE 'key' END AS "group",
  count(*) AS n_columns, avg(pct_missing) AS mean_missing,
  array_to_string(list_sort(list(DISTINCT CASE "column" WHEN 'p_partkey' THEN 'bigint' WHEN 'p_size' THEN 'int' WHEN 'p_retailprice' THEN 'double' ELSE 'string' END)), ',') AS dtypes
FROM ({MISSING_SQL}) GROUP BY 1""", "mean_missing")
def column_groups(t):
    df = holed_part(t)
    groups = C.group_columns(df.columns, {"key": r".*key", "class": r"p_(type|brand)", "measure": r"p_.*"})
    return P.group_statistics(P.missing_report(df), groups, dict(df.dtypes))


@query("missing_by_prefix", "F10", f"""
SELECT split_part("column",'_',1) AS prefix, avg(pct_missing) AS mean_missing, max(pct_missing) AS max_missing, min(pct_missing) AS min_missing,
 count(CASE WHEN pct_missing=0 THEN 1 END) AS n_complete, count(CASE WHEN pct_missing>0 AND pct_missing<50 THEN 1 END) AS n_below_half, count(CASE WHEN pct_missing>=50 THEN 1 END) AS n_half_or_more
FROM ({MISSING_SQL}) GROUP BY 1""", "mean_missing max_missing min_missing")
def missing_by_prefix(t):
    return P.missing_by_prefix(P.missing_report(holed_part(t)))


@query("missing_by_class", "F11", f"""
SELECT p_brand, avg(CASE WHEN p_size IS NULL THEN 1.0 ELSE 0.0 END) AS p_size_missing,
 avg(CASE WHEN p_retailprice IS NULL THEN 1.0 ELSE 0.0 END) AS p_retailprice_missing FROM {HOLED_PART} GROUP BY 1""", "p_size_missing p_retailprice_missing")
def missing_by_class(t):
    return P.missing_by_class(holed_part(t), "p_brand", ["p_size", "p_retailprice"])


def _iqr(k, cols, table):
    return " UNION ALL ".join(f"""SELECT '{c}' AS "column", min(x) AS min, max(x) AS max, any_value(q1) AS q1, any_value(q3) AS q3, any_value(lo) AS iqr_lower, any_value(hi) AS iqr_upper,
  count(CASE WHEN x<lo OR x>hi THEN 1 END) AS n_outliers, 100.0*count(CASE WHEN x<lo OR x>hi THEN 1 END)/count(x) AS pct_outliers
  FROM (SELECT {c} AS x FROM {table}), (SELECT q1, q3, q1-{k}*(q3-q1) AS lo, q3+{k}*(q3-q1) AS hi FROM (SELECT quantile_cont({c},0.25) q1, quantile_cont({c},0.75) q3 FROM {table}))""" for c in cols)


@query("iqr_outliers", "F13", _iqr(1.5, ["l_extendedprice", "l_quantity", "l_discount"], "lineitem"), "min max q1 q3 iqr_lower iqr_upper pct_outliers")
def iqr_outliers(t):
    return P.iqr_outliers(t.lineitem, ["l_extendedprice", "l_quantity", "l_discount"], 1.5)


@query("iqr_outliers_wide", "F13", _iqr(3, ["value"], "events"), "min max q1 q3 iqr_lower iqr_upper pct_outliers")
def iqr_outliers_wide(t):
    return P.iqr_outliers(t.events, ["value"], 3)


@query("rule_counts", "F14", """
SELECT 'code' AS rule, count(CASE WHEN l_linenumber IN (6,7) THEN 1 END) AS n FROM lineitem UNION ALL SELECT 'large', count(CASE WHEN l_quantity>40 THEN 1 END) FROM lineitem
UNION ALL SELECT 'ratio', count(CASE WHEN l_extendedprice/nullif(l_quantity,0)>1500 THEN 1 END) FROM lineitem""")
def rule_counts(t):
    return P.rule_counts(t.lineitem, {
        "code": F.col("l_linenumber").isin(6, 7),
        "large": F.col("l_quantity") > 40,
        "ratio": S.safe_ratio("l_extendedprice", "l_quantity", None) > 1500,
    })


RETURNED = "(SELECT *, CAST(l_returnflag='R' AS INTEGER) AS returned FROM lineitem) q"


def returned_lines(t):
    return t.lineitem.withColumn("returned", S.flag(F.col("l_returnflag") == "R"))


@query("corr_target", "F15 F17 F30 T1", " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", corr({c}, returned) AS correlation, abs(corr({c}, returned)) AS abs_correlation, count({c}) AS n FROM {RETURNED}""" for c in LINE),
    "correlation abs_correlation")
def corr_target(t):
    return P.target_correlation(returned_lines(t), LINE, "returned").orderBy(F.desc("abs_correlation"))


@query("corr_strong", "F30", """SELECT "column", r AS correlation, abs(r) AS abs_correlation, n FROM (""" + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", corr({c}, p_retailprice) AS r, count({c}) AS n FROM part""" for c in ("p_size", "p_partkey")) + ") WHERE abs(r)>0.05",
    "correlation abs_correlation")
def corr_strong(t):
    return P.strong_columns(P.target_correlation(t.part, ["p_size", "p_partkey"], "p_retailprice"), 0.05)


def _ranked(c):
    return f"(rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1)/2.0)"


@query("spearman_target", "F16 R17", " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", corr(a,b) AS correlation, abs(corr(a,b)) AS abs_correlation, count(*) AS n FROM (SELECT {_ranked(c)} a, {_ranked('l_extendedprice')} b FROM lineitem)"""
    for c in ("l_quantity", "l_discount")), "correlation abs_correlation")
def spearman_target(t):
    return P.target_correlation(t.lineitem, ["l_quantity", "l_discount"], "l_extendedprice", "spearman", min_rows=100, min_std=1e-6)


@query("point_biserial", "F17")
def point_biserial(t):
    return P.point_biserial(returned_lines(t), LINE, "returned")


_PAIRS = [(a, b) for a in LINE for b in LINE]


@query("corr_matrix", "F18", " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a},{b}) AS correlation FROM lineitem" for a, b in _PAIRS), "correlation")
def corr_matrix(t):
    return P.correlation_matrix(t.lineitem, LINE)


@query("corr_matrix_spearman", "F18 R17", "WITH r AS (SELECT " + ", ".join(f"{_ranked(c)} AS {c}" for c in LINE) + " FROM lineitem) "
    + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a},{b}) AS correlation FROM r" for a, b in _PAIRS), "correlation")
def corr_matrix_spearman(t):
    return P.correlation_matrix(t.lineitem, LINE, "spearman")


@query("corr_pairs", "F19", "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, corr({a},{b}) AS correlation FROM (SELECT *, l_extendedprice*(1-l_discount) AS l_net FROM lineitem)" for i, a in enumerate(PRICED) for b in PRICED[i + 1:]) + ") WHERE abs(correlation)>0.5", "correlation")
def corr_pairs(t):
    rows = t.lineitem.withColumn("l_net", F.col("l_extendedprice") * (1 - F.col("l_discount")))
    return P.correlated_pairs(P.correlation_matrix(rows, PRICED), PRICED, 0.5)


@query("near_constant", "F29", " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", sd AS std, top AS top_share, CAST(sd<0.05 AS INTEGER) AS is_low_std, CAST(top>0.2 AS INTEGER) AS is_dominated
    FROM (SELECT stddev_samp({c}) sd FROM lineitem), (SELECT max(m)*1.0/sum(m) top FROM (SELECT count(*) m FROM lineitem GROUP BY {c}))""" for c in ("l_discount", "l_tax", "l_linenumber")),
    "std top_share")
def near_constant(t):
    return P.near_constant(t.lineitem, ["l_discount", "l_tax", "l_linenumber"], min_std=0.05, max_share=0.2)


@query("empirical_cdf", "F31", """
SELECT DISTINCT value, count(*) OVER (ORDER BY value)*1.0/count(*) OVER () AS cdf FROM events WHERE value IS NOT NULL""", "value cdf")
def empirical_cdf(t):
    return P.empirical_cdf(t.events, "value")


@query("qq_points", "F31")
def qq_points(t):
    return P.normal_quantiles(t.events.select(F.log1p("value").alias("log_value")), "log_value")


@query("target_moments", "F21 R4", """
WITH m AS (SELECT avg(value) a, count(*) n FROM events), c AS (SELECT avg((value-a)**2) m2, avg((value-a)**3) m3, avg((value-a)**4) m4, any_value(n) n, any_value(a) a FROM events, m)
SELECT m3/m2**1.5 AS skew, m3/m2**1.5*sqrt(n*(n-1))/(n-2) AS skew_corrected, m4/(m2*m2)-3 AS kurtosis, a AS mean, (SELECT quantile_cont(value,0.99) FROM events) AS p99 FROM c""",
       "skew skew_corrected kurtosis mean p99")
def target_moments(t):
    return P.moments(t.events, "value")


@query("panel_facts", "F27", """
SELECT CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_entities, avg(n) AS mean_rows, max(n) AS max_rows, min(n) AS min_rows,
 (SELECT avg(CAST(c_acctbal<0 AS INTEGER)) FROM customer) AS target_rate FROM (SELECT count(*) n FROM events GROUP BY user_id)""", "mean_rows target_rate")
def panel_facts(t):
    labels = t.customer.select("c_custkey", S.flag(F.col("c_acctbal") < 0).alias("label"))
    return P.panel_facts(t.events, "user_id", labels, "label")


DICTIONARY = {
    "region": {"r_regionkey": "int", "r_name": "string"},
    "nation": {"n_nationkey": "int", "n_name": "string", "n_regionkey": "int"},
    "supplier": {"s_suppkey": "bigint", "s_name": "string", "s_nationkey": "int", "s_acctbal": "double"},
    "customer": {"c_custkey": "bigint", "c_name": "string", "c_nationkey": "int", "c_acctbal": "double", "c_mktsegment": "string"},
    "part": PART,
    "labels": {"doc_id": "bigint", "quality": "int", "toxic": "int"},
}


@query("data_dictionary", "F26 U1", " UNION ALL ".join(f"""SELECT *, '{k}' AS "table" FROM ({_profile_sql(k, v)})""" for k, v in DICTIONARY.items()), "pct_missing top_share")
def data_dictionary(t):
    return P.data_dictionary({name: getattr(t, name) for name in DICTIONARY}).drop("sample_values")


@query("feature_prefixes", "F32 F23", f"""SELECT split_part("column",'_',1) AS prefix, count(*) AS n_columns FROM ({MISSING_SQL}) GROUP BY 1""")
def feature_prefixes(t):
    return P.prefix_counts(P.missing_report(holed_part(t)))


@query("narrow_types", "F28", """
SELECT CAST(sum(c_custkey) AS BIGINT) AS keys, CAST(sum(c_nationkey) AS BIGINT) AS nations, 'tinyint' AS nation_type, sum(c_acctbal) AS balance FROM customer""", "balance")
def narrow_types(t):
    out = P.narrow_integers(t.customer)
    kind = dict(out.dtypes)["c_nationkey"]
    return out.agg(F.sum("c_custkey").alias("keys"), F.sum("c_nationkey").alias("nations"), F.first(F.lit(kind)).alias("nation_type"), F.sum("c_acctbal").alias("balance"))


@query("search_report", "P29", f"SELECT * FROM ({MISSING_SQL}) WHERE lower(\"column\") LIKE '%size%' OR lower(category) LIKE '%size%'", "pct_missing")
def search_report(t):
    return C.search_rows(P.missing_report(holed_part(t)), "SIZE")
