"""Queries over features, models, clusters, anomalies and importance."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from tabella.operators import models, sampling
from tabella.plans.registry import query
from tabella.session import load, spool

NUMS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
KINDS = {**dict.fromkeys(NUMS, "numeric"), "l_returnflag": "categorical", "l_linestatus": "categorical", "l_shipdate": "datetime"}


def _scores():
    """All rows of a table of scores, which are few."""
    return Window.partitionBy()


def _lines(spark, d):
    return load(spark, d, "lineitem").select(*KINDS)


def _orders(spark, d):
    """Orders with a spread of numbers and a status to predict."""
    o = load(spark, d, "orders")
    price = F.col("o_totalprice")
    return o.select(
        "o_orderkey", "o_orderstatus", price, F.col("o_custkey").cast("double").alias("customer"), F.month("o_orderdate").cast("double").alias("month"),
        (F.sqrt(price) * 3 + F.month("o_orderdate") * 10).alias("cost"),
    )


# ------------------------------------------------------------------ features
@query(
    "encode_features",
    """SELECT l_returnflag, l_quantity, l_extendedprice, CASE l_linestatus WHEN 'F' THEN 0e0 ELSE 1e0 END AS l_linestatus, month(l_shipdate)::DOUBLE AS "l_shipdate (month)",
       (isodow(l_shipdate) - 1)::DOUBLE AS "l_shipdate (weekday)" FROM lineitem""",
)
def _(spark, d):
    return models.encode_features(_lines(spark, d), "l_returnflag", ["l_quantity", "l_extendedprice", "l_linestatus", "l_shipdate"], KINDS)[0]


@query(
    "table_prep",
    """SELECT l_orderkey, l_linenumber, round((l_quantity - (SELECT avg(l_quantity) FROM lineitem)) / (SELECT stddev_samp(l_quantity) FROM lineitem), 6) AS f0,
       CASE WHEN l_returnflag = (SELECT l_returnflag FROM lineitem GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) THEN 1e0 ELSE 0e0 END AS f1 FROM lineitem""",
)
def _(spark, d):
    from pyspark.ml.functions import vector_to_array

    df = load(spark, d, "lineitem")
    out = models.table_prep(df, ["l_quantity"], ["l_returnflag"])(df)
    v = vector_to_array("features")
    return out.select("l_orderkey", "l_linenumber", F.round(v[0], 6).alias("f0"), v[1].alias("f1"))


@query(
    "cluster_features",
    """SELECT l_orderkey, l_linenumber, round((l_quantity - avg(l_quantity) OVER ()) / stddev_pop(l_quantity) OVER (), 6) AS f0, round(CASE WHEN l_linestatus = 'F' THEN 1 / sqrt(2) ELSE 0 END, 6) AS f1 FROM lineitem""",
)
def _(spark, d):
    from pyspark.ml.functions import vector_to_array

    df = load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_linestatus")
    out = models.cluster_features(df, {"l_quantity": "numeric", "l_linestatus": "categorical"}, categories=True).table
    v = vector_to_array("features")
    return out.select("l_orderkey", "l_linenumber", F.round(v[0], 6).alias("f0"), F.round(v[1], 6).alias("f1"))


# ------------------------------------------------------------------ scores
SCORED_SQL = "scored AS (SELECT CASE WHEN l_returnflag = 'R' THEN 'yes' ELSE 'no' END AS y, CASE WHEN l_quantity > 30 THEN 'yes' ELSE 'no' END AS p, l_quantity AS s, l_linestatus || l_linenumber AS g FROM lineitem)"


def _scored(spark, d):
    li = load(spark, d, "lineitem")
    return li.select(
        F.when(F.col("l_returnflag") == "R", "yes").otherwise("no").alias("y"),
        F.when(F.col("l_quantity") > 30, "yes").otherwise("no").alias("p"),
        F.col("l_quantity").alias("s"),
        F.concat("l_linestatus", F.col("l_linenumber").cast("string")).alias("g"),
    )


@query("confusion_matrix", f"WITH {SCORED_SQL} SELECT y AS label, p AS predicted, count(*) AS rows FROM scored GROUP BY 1, 2")
def _(spark, d):
    return models.confusion_matrix(_scored(spark, d), "y", "p")


@query(
    "classification_scores",
    f"""WITH {SCORED_SQL}, c AS (SELECT count(*) FILTER (y = 'yes' AND p = 'yes') AS tp, count(*) FILTER (y = 'no' AND p = 'yes') AS fp, count(*) FILTER (y = 'yes' AND p = 'no') AS fn, count(*) FILTER (y = 'no' AND p = 'no') AS tn FROM scored),
     r AS (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS r FROM scored), u AS (SELECT sum(r) FILTER (y = 'yes') AS rs, count(*) FILTER (y = 'yes')::DOUBLE AS n1, count(*) FILTER (y = 'no')::DOUBLE AS n0 FROM r)
     SELECT 'accuracy' AS measure, round((tp + tn) / (tp + fp + fn + tn), 6) AS value FROM c UNION ALL SELECT 'balanced_accuracy', round((tp / (tp + fn) + tn / (tn + fp)) / 2, 6) FROM c UNION ALL SELECT 'precision', round(tp / (tp + fp), 6) FROM c
     UNION ALL SELECT 'recall', round(tp / (tp + fn), 6) FROM c UNION ALL SELECT 'f1', round(2 * tp / (2 * tp + fp + fn), 6) FROM c UNION ALL SELECT 'roc_auc', round((rs - n1 * (n1 + 1) / 2) / (n1 * n0), 6) FROM u""",
)
def _(spark, d):
    out = models.classification_scores(_scored(spark, d), "y", "p", "yes", "s")
    return out.withColumn("value", F.round("value", 6))


@query(
    "regression_scores",
    """WITH e AS (SELECT l_extendedprice AS y, l_quantity * 2000 AS p FROM lineitem) SELECT 'rmse' AS measure, round(sqrt(avg(pow(y - p, 2))), 4) AS value FROM e UNION ALL SELECT 'mae', round(avg(abs(y - p)), 4) FROM e
       UNION ALL SELECT 'r2', round(1 - sum(pow(y - p, 2)) / (var_pop(y) * count(*)), 4) FROM e""",
)
def _(spark, d):
    df = load(spark, d, "lineitem").select(F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 2000).alias("p"))
    return models.regression_scores(df, "y", "p").withColumn("value", F.round("value", 4))


@query(
    "baseline_scores",
    """WITH m AS (SELECT avg(o_totalprice) AS m FROM orders) SELECT 'rmse' AS measure, round(sqrt(avg(pow(c_acctbal - m, 2))), 4) AS value FROM customer, m UNION ALL SELECT 'mae', round(avg(abs(c_acctbal - m)), 4) FROM customer, m
       UNION ALL SELECT 'r2', round(1 - sum(pow(c_acctbal - m, 2)) / (var_pop(c_acctbal) * count(*)), 4) FROM customer, m""",
)
def _(spark, d):
    train = load(spark, d, "orders").select(F.col("o_totalprice").alias("amount"))
    test = load(spark, d, "customer").select(F.col("c_acctbal").alias("amount"))
    return models.baseline_scores(train, test, "amount", False).withColumn("value", F.round("value", 4))


@query(
    "fairness_by_group",
    f"""WITH {SCORED_SQL}, f AS (SELECT g AS group_value, count(*) AS rows, avg(CAST(y = p AS INT)) AS accuracy, avg(CAST(p = 'yes' AS INT)) AS yes_rate, avg(CAST(p = 'yes' AS INT)) FILTER (y = 'yes') AS recall FROM scored GROUP BY 1 HAVING count(*) >= 5)
     SELECT group_value, rows, round(accuracy, 4) AS accuracy, round(yes_rate, 4) AS yes_rate, round(recall, 4) AS recall, round(yes_rate / max(yes_rate) OVER (), 3) AS ratio,
       CASE WHEN rows < 30 THEN 'too few rows' WHEN round(yes_rate / max(yes_rate) OVER (), 3) >= 0.8 THEN 'pass' ELSE 'check' END AS four_fifths FROM f""",
)
def _(spark, d):
    return models.fairness_by_group(_scored(spark, d), "g", "y", "p", "yes")


# ------------------------------------------------------------------ models
# Fitted scores have no SQL form. These queries run at the operators' defaults and return what must hold of every score.
@query(
    "compare_regressors",
    """SELECT unnest(['linear', 'ridge', 'lasso', 'elastic net', 'tree', 'forest', 'boosting']) AS model, 1 AS best_models, true AS best_has_least_rmse, true AS beats_the_mean,
       true AS explains_half, true AS cross_validation_agrees FROM (SELECT count(*) AS n FROM orders) WHERE n > 0""",
)
def _(spark, d):
    orders = _orders(spark, d)
    scores = models.compare_regressors(orders, "cost", ["o_totalprice", "month", "customer"])
    mean = orders.agg(F.stddev_pop("cost")).first()[0]
    least = F.min("rmse").over(_scores()) == F.min(F.when(F.col("best"), F.col("rmse"))).over(_scores())
    return scores.select(
        "model", F.sum(F.col("best").cast("int")).over(_scores()).cast("int").alias("best_models"), least.alias("best_has_least_rmse"), (F.col("rmse") < mean).alias("beats_the_mean"),
        (F.col("r2") > 0.5).alias("explains_half"), F.col("cv_rmse").between(F.col("rmse") * 0.7, F.col("rmse") * 1.3).alias("cross_validation_agrees"),
    )


@query(
    "compare_classifiers",
    """SELECT unnest(['logistic', 'naive bayes', 'tree', 'forest', 'boosting', 'neural network', 'linear svm']) AS model, 1 AS best_models, true AS best_has_most_f1,
       true AS in_bounds, true AS cross_validation_agrees FROM (SELECT count(*) AS n FROM orders) WHERE n > 0""",
)
def _(spark, d):
    orders = _orders(spark, d).withColumn("dear", F.when(F.col("cost") > 1_200, "yes").otherwise("no"))
    scores = models.compare_classifiers(orders, "dear", ["o_totalprice", "month", "customer"])
    most = F.max("f1").over(_scores()) == F.max(F.when(F.col("best"), F.col("f1"))).over(_scores())
    bounds = F.least("accuracy", "precision", "recall", "f1") >= 0, F.greatest("accuracy", "precision", "recall", "f1") <= 1
    return scores.select(
        "model", F.sum(F.col("best").cast("int")).over(_scores()).cast("int").alias("best_models"), most.alias("best_has_most_f1"), (bounds[0] & bounds[1]).alias("in_bounds"),
        F.col("cv_accuracy").between(F.col("accuracy") - 0.1, F.col("accuracy") + 0.1).alias("cross_validation_agrees"),
    )


@query(
    "stratified_split",
    """WITH o AS (SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5(o_orderkey::VARCHAR), o_orderkey) AS place, count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders)
       SELECT o_orderkey, o_orderstatus, CASE WHEN place <= least(greatest(round(n * 0.3), least(n - 1, 1)), n - 1) THEN 'test' ELSE 'train' END AS part FROM o""",
)
def _(spark, d):
    orders = load(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    train, test = sampling.stratified_split(orders, "o_orderstatus", 0.3, order=F.md5(F.col("o_orderkey").cast("string").cast("binary")))
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))


@query(
    "class_shares",
    """WITH n AS (SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1) SELECT o_orderstatus, part, CASE part WHEN 'test' THEN round(n * 0.25)::BIGINT ELSE n - round(n * 0.25)::BIGINT END AS rows FROM n, (SELECT unnest(['test', 'train']) AS part)""",
)
def _(spark, d):
    train, test = sampling.stratified_split(_orders(spark, d), "o_orderstatus", 0.25)
    both = train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))
    return both.groupBy("o_orderstatus", "part").agg(F.count("*").alias("rows"))


@query(
    "stratified_folds",
    """WITH n AS (SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1) SELECT o_orderstatus, fold, n // 5 + CAST(fold < n % 5 AS INT) AS rows FROM n, (SELECT unnest(range(5))::INT AS fold)""",
)
def _(spark, d):
    return sampling.stratified_folds(_orders(spark, d), "o_orderstatus", 5, "fold").groupBy("o_orderstatus", "fold").agg(F.count("*").alias("rows"))


@query(
    "class_weights",
    """SELECT o_orderkey, o_orderstatus, round(sum(1) OVER () / ((SELECT count(DISTINCT o_orderstatus) FROM orders) * count(*) OVER (PARTITION BY o_orderstatus)), 9) AS weight FROM orders""",
)
def _(spark, d):
    return sampling.class_weights(load(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus").withColumn("weight", F.round("weight", 9))


@query(
    "shuffle_columns",
    """SELECT 'l_quantity' AS column_name, l_quantity::DOUBLE AS value, count(*) AS rows, true AS unrelated FROM lineitem GROUP BY 2 UNION ALL SELECT 'l_discount', l_discount::DOUBLE, count(*), true FROM lineitem GROUP BY 2""",
)
def _(spark, d):
    """The values of both columns after the shuffle, and that nothing ties them to their old rows although the table is sorted."""
    names = ["l_quantity", "l_discount"]
    mixed = sampling.ColumnShuffle(load(spark, d, "lineitem").select(*names).orderBy(*names), names).draw(7)
    mixed = spool(mixed, "shuffled")
    ties = mixed.agg(*[F.corr(x, f"_p{i}").alias(x) for i, x in enumerate(names)])
    counts = [mixed.groupBy(F.lit(x).alias("column_name"), F.col(f"_p{i}").alias("value")).agg(F.count("*").alias("rows")) for i, x in enumerate(names)]
    loose = ties.select(F.explode(F.array(*[F.struct(F.lit(x).alias("column_name"), (F.abs(x) < 5 / F.sqrt(F.lit(float(mixed.count())))).alias("unrelated")) for x in names])).alias("t")).select("t.*")
    return counts[0].unionByName(counts[1]).join(loose, "column_name")


@query(
    "knn_predict",
    """WITH o AS (SELECT o_orderkey, o_totalprice AS p, month(o_orderdate)::DOUBLE AS m, sqrt(o_totalprice) * 3 + month(o_orderdate) * 10 AS cost, o_orderkey % 10 >= 7 AS asked FROM orders),
       s AS (SELECT avg(p) AS ap, stddev_pop(p) AS sp, avg(m) AS am, stddev_pop(m) AS sm FROM o WHERE NOT asked), t AS (SELECT o_orderkey, (p - ap) / sp AS a, (m - am) / sm AS b, cost, asked FROM o, s)
       SELECT q.o_orderkey, round(list_avg(min_by(t.cost, (q.a - t.a) * (q.a - t.a) + (q.b - t.b) * (q.b - t.b), 5)), 6) AS prediction FROM t q JOIN t ON q.asked AND NOT t.asked GROUP BY 1""",
)
def _(spark, d):
    o = _orders(spark, d)
    asked = F.col("o_orderkey") % 10 >= 7
    out = models.knn_predict(o.where(~asked), o.where(asked), "o_orderkey", "cost", ["o_totalprice", "month"], classify=False)
    return out.withColumn("prediction", F.round("prediction", 6))


# ------------------------------------------------------------------ clusters and anomalies
@query("kmeans_best_k", "SELECT count(*) AS rows, round(avg(l_quantity), 1) AS l_quantity, round(avg(l_extendedprice), 0) AS l_extendedprice, true AS several_clusters FROM lineitem")
def _(spark, d):
    """The profile of the best clusters, weighed together again: every row is in one of them."""
    shape = models.kmeans_best_k(_lines(spark, d), KINDS, categories=True)[2]
    whole = [F.sum(F.col(x) * F.col("rows")) / F.sum("rows") for x in ("l_quantity", "l_extendedprice")]
    return shape.agg(F.sum("rows").alias("rows"), F.round(whole[0], 1).alias("l_quantity"), F.round(whole[1], 0).alias("l_extendedprice"), (F.count("*") > 1).alias("several_clusters"))


@query("kmeans_scores", "SELECT unnest(range(2, 7))::INT AS k, true AS in_bounds, 1 AS best_rows, true AS best_is_highest FROM (SELECT count(*) AS n FROM lineitem) WHERE n > 6")
def _(spark, d):
    scores = models.kmeans_best_k(_lines(spark, d).select("l_quantity", "l_extendedprice"), KINDS)[1]
    top = F.max("silhouette").over(_scores()) == F.max(F.when(F.col("best"), F.col("silhouette"))).over(_scores())
    best = F.sum(F.col("best").cast("int")).over(_scores()).cast("int")
    return scores.select("k", F.col("silhouette").between(-1, 1).alias("in_bounds"), best.alias("best_rows"), top.alias("best_is_highest"))


@query(
    "isolation_forest",
    "SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, true AS flagged_by_score, true AS share_holds FROM lineitem",
)
def _(spark, d):
    """Every row once, flagged where its score is below the cut, and no more than the asked share of all rows flagged."""
    out = models.isolation_forest(load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *NUMS), dict.fromkeys(NUMS, "numeric"))
    share = out.agg(F.avg(F.col("is_anomaly").cast("double"))).first()[0] or 0.0
    flagged = (F.col("is_anomaly") == (F.col("anomaly_score") < 0)).alias("flagged_by_score")
    return out.select("l_orderkey", "l_linenumber", *NUMS, flagged, F.lit(0.04 <= share <= 0.0501).alias("share_holds"))


@query("most_anomalous_rows")
def _(spark, d):
    out = models.isolation_forest(load(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_custkey"), {"o_totalprice": "numeric", "o_custkey": "numeric"})
    return out.where("is_anomaly").orderBy("anomaly_score", "o_orderkey")


# ------------------------------------------------------------------ importance
@query(
    "model_importance",
    """SELECT column_name, column_name = 'o_totalprice' AS leads, column_name <> 'customer' AS matters
       FROM (SELECT unnest(['o_totalprice', 'month', 'customer']) AS column_name FROM (SELECT count(*) AS n FROM orders) WHERE n > 0)""",
)
def _(spark, d):
    """The number that mostly makes the cost leads, the month matters too, and the customer's number doesn't."""
    got = models.model_importance(_orders(spark, d), "cost", ["o_totalprice", "month", "customer"], classify=False)
    top = F.max_by("column_name", "forest_pct").over(_scores())
    return got.select("column_name", (F.col("column_name") == top).alias("leads"), (F.col("permutation_drop") > 0.005).alias("matters"))


@query(
    "boruta_select",
    """SELECT column_name, column_name <> 'customer' AS confirmed, column_name <> 'customer' AS ranks_first
       FROM (SELECT unnest(['o_totalprice', 'month', 'customer']) AS column_name FROM (SELECT count(*) AS n FROM orders) WHERE n > 0)""",
)
def _(spark, d):
    return models.boruta_select(_orders(spark, d), "cost", ["o_totalprice", "month", "customer"], classify=False).select("column_name", (F.col("decision") == "Confirmed").alias("confirmed"), (F.col("rank") == 1).alias("ranks_first"))
