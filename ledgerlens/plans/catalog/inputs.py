"""Tables written and read back through the shared folder, column choices, and checks of fitted models by row sets."""

import uuid

from pyspark.sql import functions as F

from ledgerlens.functions import scalars as S
from ledgerlens.operators import columns as C
from ledgerlens.operators import encode as E
from ledgerlens.operators import models as L
from ledgerlens.operators import profile as P
from ledgerlens.operators import relational as R
from ledgerlens.operators import splits as D
from ledgerlens.operators import text as X
from ledgerlens.plans.catalog.text import STOP
from ledgerlens.plans.registry import query
from ledgerlens.session import shared_folder
from ledgerlens.sources import tables as IO


def place(t, name):
    """A new folder for one run, below the folder that all executors share."""
    return f"{shared_folder(t._spark)}/{name}-{uuid.uuid4().hex}"


@query("csv_inferred", "S1", "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier", "s_acctbal")
def csv_inferred(t):
    """A CSV file with a header, types found by reading it."""
    path = place(t, "csv")
    t.supplier.write.option("header", True).csv(path)
    return IO.read_csv(t._spark, path).withColumn("s_suppkey", F.col("s_suppkey").cast("long"))


@query("csv_index_column", "S2", "SELECT c_custkey, c_name AS name, c_acctbal FROM customer", "c_acctbal")
def csv_index_column(t):
    """A CSV file whose first column has no name: dropped; another column renamed."""
    path = place(t, "csv")
    rows = t.customer.select(F.col("c_nationkey").alias(""), "c_custkey", "c_name", "c_acctbal")
    rows.write.option("header", True).csv(path)
    out = IO.read_csv(t._spark, path, rename={"c_name": "name"}, drop=["_c0"])
    return out.withColumn("c_custkey", F.col("c_custkey").cast("long"))


@query("csv_to_parquet", "S3 S4 S11", "SELECT o_orderstatus, o_orderkey, o_custkey, o_totalprice FROM orders", "o_totalprice")
def csv_to_parquet(t):
    """A CSV file converted once, then written by status and read as Parquet."""
    source, target, parts = place(t, "csv"), place(t, "parquet"), place(t, "split")
    schema = "o_orderstatus string, o_orderkey long, o_custkey long, o_totalprice double"
    t.orders.select("o_orderstatus", "o_orderkey", "o_custkey", "o_totalprice").write.option("header", True).csv(source)
    IO.write_table(IO.csv_to_parquet(t._spark, source, target, schema), parts, by=["o_orderstatus"])
    return IO.read_parquet(t._spark, parts).select("o_orderstatus", "o_orderkey", "o_custkey", "o_totalprice")


@query("two_file_load", "S5 J1", "SELECT o_orderkey, o_totalprice, c_mktsegment, c_acctbal FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey", "o_totalprice c_acctbal")
def two_file_load(t):
    """All transactions with the identity row of some of them."""
    tx = t.orders.select(F.col("o_custkey").alias("id"), "o_orderkey", "o_totalprice")
    identity = t.customer.where("c_acctbal > 0").select(F.col("c_custkey").alias("id"), "c_mktsegment", "c_acctbal")
    return IO.read_joined(tx, identity, "id").drop("id")


@query("latin1_lines", "S8", r"""SELECT line AS value, count(*) AS n FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents)
WHERE length(line) > 0 AND regexp_matches(line, '^[\x20-\x7e\xa0-\xff]*$') AND NOT contains(line, '"') GROUP BY 1""")
def latin1_lines(t):
    """Lines in another charset than UTF-8, decoded as they are read."""
    path = place(t, "latin1")
    lines = t.documents.select(F.explode(F.split("text", "\n")).alias("value"))
    kept = lines.where((F.length("value") > 0) & F.col("value").rlike(r"^[\x20-\x7e\xa0-\xff]*$") & ~F.col("value").contains('"'))
    plain = {"encoding": "ISO-8859-1", "sep": "\u0001", "quote": "", "escape": "", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    kept.write.options(**plain).csv(path)
    return IO.read_lines(t._spark, path, "ISO-8859-1").groupBy("value").agg(F.count(F.lit(1)).alias("n"))


@query("stats_reloaded", "S13 E2", """SELECT o_orderkey, r AS priority_rate FROM orders JOIN (SELECT o_orderpriority, avg(CAST(o_orderstatus='F' AS INTEGER)) AS r FROM orders GROUP BY 1) USING (o_orderpriority)""", "priority_rate")
def stats_reloaded(t):
    """Fitted rates saved, loaded and applied."""
    path = place(t, "stats")
    rows = t.orders.select("o_orderkey", "o_orderpriority", S.flag(F.col("o_orderstatus") == "F").alias("label"))
    IO.write_stats({"rate": E.fit_target_rate(rows, ["o_orderpriority"], "label")}, path)
    stats = IO.read_stats(t._spark, path, ["rate"])["rate"]
    return E.apply_target_rate(rows, stats, ["o_orderpriority"], "priority_rate").select("o_orderkey", "priority_rate")


@query("built_once", "S12 S17", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def built_once(t):
    """An aggregate built and written at the first call, read at the second; written as a report too."""
    path = place(t, "built")
    counts = t.events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    IO.read_or_build(t._spark, path, lambda: counts)
    again = IO.read_or_build(t._spark, path, lambda: counts.limit(0))
    IO.write_report(again, path + "-report")
    return IO.read_csv(t._spark, path + "-report", "event_type string, n long")


@query("sparse_columns", "P22", "SELECT o_orderkey, o_totalprice, CASE WHEN o_orderpriority='1-URGENT' THEN o_custkey END AS some FROM orders", "o_totalprice")
def sparse_columns(t):
    """Columns that miss more than 95 % of the training rows go from all rows."""
    rows = t.orders.select(
        "o_orderkey", "o_totalprice", F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_custkey")).alias("some"),
        F.when(F.col("o_orderkey") % 50 == 0, F.col("o_custkey")).alias("few"), F.lit(None).cast("double").alias("none"),
    )
    return C.drop_sparse(rows, C.sparse_columns(rows.where("o_orderkey % 5 > 0"), 0.95))


@query("category_values", "F6", " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count(DISTINCT {c}) AS n_values, array_to_string(list_slice(list_sort(list(DISTINCT CAST({c} AS VARCHAR))), 1, 10), ', ') AS "values" FROM {table}"""
    for table, c in (("orders", "o_orderpriority"), ("orders", "o_orderstatus"))))
def category_values(t):
    return P.category_values(t.orders, ["o_orderpriority", "o_orderstatus"])


@query("new_columns", "F23", """SELECT 'new' AS kind, unnest(['doubled','log_price']) AS "column" UNION ALL SELECT 'kept', unnest(['o_orderkey','o_totalprice']) UNION ALL SELECT 'dropped', 'o_custkey'""")
def new_columns(t):
    """Which columns a step has kept, removed and made."""
    before = t.orders.select("o_orderkey", "o_totalprice", "o_custkey")
    after = before.select("o_orderkey", "o_totalprice", (F.col("o_totalprice") * 2).alias("doubled"), F.log1p("o_totalprice").alias("log_price"))
    return C.column_changes(before, after)


@query("buy_ratio", "A23", """SELECT p_brand AS category, count(*) AS n_trades, avg(CAST(l_returnflag<>'R' AS INTEGER)) AS buy_ratio FROM lineitem JOIN part ON l_partkey=p_partkey GROUP BY 1""", "buy_ratio")
def buy_ratio(t):
    trades = t.lineitem.select("l_partkey", F.when(F.col("l_returnflag") != "R", "Buy").otherwise("Sell").alias("side"))
    return R.buy_ratio(trades.join(t.part, F.col("l_partkey") == F.col("p_partkey")), "p_brand", "side")


@query("monotone_report", "L18", """
WITH r AS (SELECT o_totalprice AS x, CAST(o_orderstatus='F' AS INTEGER) AS y, max(o_totalprice) OVER () AS top FROM orders),
b AS (SELECT CAST(least(floor(x*10/top),9) AS INTEGER) AS bin, count(*) AS n, avg(y) AS mean_score FROM r GROUP BY 1)
SELECT 'o_totalprice' AS feature, bin, n, mean_score, coalesce(mean_score < lag(mean_score) OVER (ORDER BY bin), false) AS violates FROM b""", "mean_score")
def monotone_report(t):
    """Mean score by ten equal bins of a feature that should not lower it, and where it does."""
    rows = t.orders.select("o_totalprice", S.flag(F.col("o_orderstatus") == "F").alias("score"))
    return L.monotonicity(rows, ["o_totalprice"], "score", bins=10)


@query("out_of_fold_terms", "L19 L12 X12", "SELECT doc_id, quality, true AS scored FROM documents JOIN labels USING (doc_id)")
def out_of_fold_terms(t):
    """Complement naive Bayes on hashed term frequencies with inverse document frequencies, each row scored by the fold that did not see it."""
    rows = t.documents.join(t.labels, "doc_id").select("doc_id", "quality", X.tokens("text", STOP).alias("tokens"))
    rows = rows.withColumn("fold", F.pmod(F.xxhash64("doc_id"), F.lit(3)))
    out = None
    for fold in range(3):
        train, held = rows.where(F.col("fold") != fold), rows.where(F.col("fold") == fold)
        model = L.term_bayes("tokens", "quality").fit(train)
        part = L.score_table(model, held, ["doc_id", "quality"])
        out = part if out is None else out.union(part)
    return out.select("doc_id", "quality", F.col("score").between(0.0, 1.0).alias("scored"))


@query("smote_counts", "D12", "SELECT CAST(sum(CAST(label<>0 AS INTEGER)) - sum(CAST(label=0 AS INTEGER)) AS BIGINT) AS n_synthetic, 64 AS width FROM embeddings")
def smote_counts(t):
    """Synthetic rows bring the minority to the size of the majority."""
    from ledgerlens.operators import neighbours as N
    from ledgerlens.plans.catalog.learned import labelled_vectors

    made = N.smote(labelled_vectors(t), "vec_id", "label", "embedding", ratio=1.0)
    return made.agg(F.count(F.lit(1)).alias("n_synthetic"), F.max(F.size("embedding")).alias("width"))


_SIDES = """SELECT label, 'train' AS split, CAST(n-held AS BIGINT) AS entities, 1 AS most_splits FROM s WHERE n>held UNION ALL
SELECT label, 'val', CAST(held-tested AS BIGINT), 1 FROM s WHERE held>tested UNION ALL SELECT label, 'test', CAST(tested AS BIGINT), 1 FROM s WHERE tested>0"""


def _entities_by_side(rows, entity, label):
    """Entities per class and split, and in how many splits the rows of any one of them lie."""
    per = rows.groupBy(entity).agg(F.count_distinct("split").cast("int").alias("k"), F.min(label).alias("label"), F.min("split").alias("split"))
    return per.groupBy("label", "split").agg(F.count(F.lit(1)).alias("entities"), F.max("k").alias("most_splits"))


@query("split_entity_whole", "D2 J6", f"""
WITH e AS (SELECT DISTINCT o_custkey, CAST(c_acctbal<0 AS INTEGER) AS label FROM orders JOIN customer ON o_custkey=c_custkey),
s AS (SELECT label, n, ceil(round(0.2*n,9)) AS held, 0 AS tested FROM (SELECT label, count(*) AS n FROM e GROUP BY 1)) {_SIDES}""")
def split_entity_whole(t):
    """All orders of a customer lie in one split; each class has its exact share of customers there."""
    labels = t.customer.select(F.col("c_custkey").alias("o_custkey"), S.flag(F.col("c_acctbal") < 0).alias("label"))
    labels = labels.join(t.orders.select("o_custkey").distinct(), "o_custkey")
    return _entities_by_side(D.entity_split(t.orders, labels, "o_custkey", "label", 0.2).join(labels, "o_custkey"), "o_custkey", "label")


@query("split_majority_whole", "D3 A26", f"""
WITH k AS (SELECT o_custkey, o_orderstatus AS label, row_number() OVER (PARTITION BY o_custkey ORDER BY count(*) DESC, o_orderstatus) AS i FROM orders GROUP BY 1,2),
s AS (SELECT label, n, ceil(round(0.3*n,9)) AS held, ceil(round(0.15/0.3*ceil(round(0.3*n,9)),9)) AS tested FROM (SELECT label, count(*) AS n FROM k WHERE i=1 GROUP BY 1)) {_SIDES}""")
def split_majority_whole(t):
    """The same, by each customer's most frequent status, with a test split."""
    rows = D.majority_split(t.orders, "o_custkey", "o_orderstatus")
    major = R.majority_label(t.orders, "o_custkey", "o_orderstatus", "label")
    return _entities_by_side(rows.join(major, "o_custkey"), "o_custkey", "label")
