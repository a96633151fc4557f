"""Queries of feature preparation, estimators and their evaluation; SQL beside those that it can express."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import GBTClassifier, LogisticRegression, OneVsRest, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import clusters, evaluation, learning, quality, resampling, selection
from ..sources.readers import table
from ..sources.shared import written

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
#: Boosting rounds of the shot model.
SHOT_ROUNDS = 400


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return put


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))


def _players(spark: SparkSession, d: str) -> DataFrame:
    """Appearances as training rows: a group, numbers, a category, a binary and a three-way label."""
    li = table(spark, d, "lineitem").select(
        "l_orderkey", F.xxhash64("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_shipdate").alias("row_key"),
        F.col("l_quantity").alias("minutes"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.col("l_discount").alias("xg"), F.col("l_tax").alias("xa"),
        "l_linestatus", "l_returnflag", F.month("l_shipdate").cast("double").alias("month"),
    )
    code = F.when(F.col("l_returnflag") == "A", 2.0).when(F.col("l_returnflag") == "N", 1.0).otherwise(0.0)
    return li.withColumns({"result": code, "label": (F.col("l_returnflag") == "A").cast("double")})


@query("cluster_metrics", """WITH e AS (SELECT vec_id, label AS k, unnest(embedding)::DOUBLE AS x, unnest(range(64)) AS i FROM embeddings),
c AS (SELECT k, i, avg(x) AS m FROM e GROUP BY k, i), d AS (SELECT vec_id, k, sum((x - m) ** 2) AS d2 FROM e JOIN c USING (k, i) GROUP BY vec_id, k),
s AS (SELECT k, count(*) AS n, avg(sqrt(d2)) AS scatter, sum(d2) AS inertia FROM d GROUP BY k),
g AS (SELECT a.k AS p, b.k AS q, sqrt(sum((a.m - b.m) ** 2)) AS gap FROM c a JOIN c b ON a.i = b.i AND a.k <> b.k GROUP BY 1, 2),
w AS (SELECT p, max((sp.scatter + sq.scatter) / gap) AS r FROM g JOIN s sp ON sp.k = p JOIN s sq ON sq.k = q GROUP BY p),
o AS (SELECT i, avg(x) AS m FROM e GROUP BY i), b AS (SELECT c.k, sum((c.m - o.m) ** 2) AS b2 FROM c JOIN o USING (i) GROUP BY c.k)
SELECT (SELECT round(avg(r), 5) FROM w) AS davies_bouldin, round(sum(n * b2) / (count(*) - 1) / (sum(inertia) / (sum(n) - count(*))), 4) AS calinski_harabasz FROM b JOIN s USING (k)""")
def cluster_metrics(spark, d):
    m = clusters.metrics(_vectors(spark, d), "vec_id", "v", "label")
    return m.select(F.round("davies_bouldin", 5).alias("davies_bouldin"), F.round("calinski_harabasz", 4).alias("calinski_harabasz"))


@query("cluster_mixture")
def cluster_mixture(spark, d):
    """Bayes criterion of Gaussian mixtures over the number of components, on six principal components."""
    e = _vectors(spark, d).withColumn("x", array_to_vector("v"))
    reduced = learning.components(e, "x", 6).transform(e).select("vec_id", vector_to_array("pca").alias("p"))
    _, bics = learning.gaussian_mixture(reduced, "p", range(4, 11), 42)
    return spark.createDataFrame([(k, float(b)) for k, b in bics], "k int, bic double")


@query("cluster_k_sweep")
def cluster_k_sweep(spark, d):
    swept = selection.k_sweep(_vectors(spark, d), "v", range(5, 14))
    return spark.createDataFrame([(r["k"], r["silhouette"], r["inertia"], r["rank"]) for r in swept], "k int, silhouette double, inertia double, composite_rank int")


@query("cluster_density")
def cluster_density(spark, d):
    return clusters.dbscan(_vectors(spark, d), "label", "vec_id", "v")


@query("cluster_style_labels")
def cluster_style_labels(spark, d):
    """Clusters of k-means named by the label whose centroid is nearest, each label once."""
    e = learning.kmeans(_vectors(spark, d), "v", 10, 42)
    a, b = clusters.centroids(e, "v", "cluster").alias("a"), clusters.centroids(e, "v", "label").alias("b")
    gaps = a.join(b, F.col("a.i") == F.col("b.i")).groupBy("cluster", "label").agg(F.sum(F.pow(F.col("a.m") - F.col("b.m"), F.lit(2.0))).alias("gap"))
    named = clusters.greedy_pairs([tuple(r) for r in gaps.collect()], highest=False)  # ten by ten
    return spark.createDataFrame(sorted(named.items()), "cluster int, label int")


@query("posterior_summary", """WITH p AS (SELECT vec_id, list_transform(embedding, lambda x: exp(4 * x::DOUBLE)) AS w FROM embeddings), q AS (SELECT vec_id, list_transform(w, lambda x: x / list_sum(w)) AS p FROM p)
SELECT vec_id, round(-list_sum(list_transform(p, lambda x: x * ln(x + 1e-12))), 6) AS entropy, round(list_max(p), 6) AS max_p FROM q""")
def posterior_summary(spark, d):
    w = table(spark, d, "embeddings").select("vec_id", F.expr("transform(embedding, x -> exp(4 * CAST(x AS DOUBLE)))").alias("w"))
    p = w.select("vec_id", F.expr("transform(array(aggregate(w, 0D, (s, x) -> s + x)), t -> transform(w, x -> x / t))[0]").alias("p"))
    return p.select("vec_id", F.expr("round(-aggregate(p, 0D, (s, x) -> s + x * ln(x + 1e-12)), 6)").alias("entropy"), F.round(F.array_max("p"), 6).alias("max_p"))


@query("style_primary_secondary", """WITH r AS (SELECT vec_id, i, x, row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, i) AS n FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(64)) AS i FROM embeddings))
SELECT vec_id, max(CASE WHEN n = 1 THEN i END) AS primary_style, max(CASE WHEN n = 2 AND x >= 0.2 THEN i END) AS secondary_style FROM r GROUP BY vec_id""")
def style_primary_secondary(spark, d):
    ranked = F.expr("array_sort(transform(embedding, (x, i) -> struct(-CAST(x AS DOUBLE) AS x, CAST(i AS BIGINT) AS i)))")
    e = table(spark, d, "embeddings").select("vec_id", ranked.alias("r"))
    return e.select("vec_id", F.col("r")[0]["i"].alias("primary_style"), F.when(F.col("r")[1]["x"] <= -0.2, F.col("r")[1]["i"]).alias("secondary_style"))


@query("array_hof", """SELECT vec_id, len(list_filter(embedding, lambda x: x > 0))::BIGINT AS n_positive, round(list_min(list_filter(embedding, lambda x: x > 0))::DOUBLE, 6) AS least_positive,
  round(list_filter(embedding, lambda x: x > 0)[-1]::DOUBLE, 6) AS last_positive FROM embeddings""")
def array_hof(spark, d):
    p = table(spark, d, "embeddings").select("vec_id", F.filter("embedding", lambda x: x > 0).alias("p"))
    return p.select("vec_id", F.size("p").cast("long").alias("n_positive"), F.round(F.array_min("p").cast("double"), 6).alias("least_positive"), F.round(F.try_element_at("p", F.lit(-1)).cast("double"), 6).alias("last_positive"))


@query("json_flatten", "SELECT event_id, k AS path, json_extract_string(props, '$.' || k) AS value FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events)")
def json_flatten(spark, d):
    e = table(spark, d, "events").select("event_id", F.from_json("props", "map<string, string>").alias("m"))
    return e.select("event_id", F.explode("m").alias("path", "value"))


@query("column_summary", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count({c}) AS n, round(avg({c}), 5) AS mean, round(stddev_samp({c}), 5) AS std, min({c}) AS least, median({c}) AS median, max({c}) AS greatest FROM lineitem"
    for c in ("l_quantity", "l_discount", "l_tax")
))
def column_summary(spark, d):
    parts = [
        F.struct(
            F.lit(c).alias("column_name"), F.count(c).alias("n"), F.round(F.avg(c), 5).alias("mean"), F.round(F.stddev_samp(c), 5).alias("std"), F.min(c).alias("least"),
            F.median(c).alias("median"), F.max(c).alias("greatest"),
        )
        for c in ("l_quantity", "l_discount", "l_tax")
    ]
    return table(spark, d, "lineitem").agg(F.array(*parts).alias("p")).select(F.inline("p"))


@query("variance_screen", """SELECT i, round(var_pop(x), 6) AS variance, round(var_pop(x) / max(max(abs(x))) OVER (), 6) AS scaled FROM (SELECT unnest(embedding)::DOUBLE AS x, unnest(range(64)) AS i FROM embeddings) GROUP BY i""")
def variance_screen(spark, d):
    from pyspark.sql import Window

    per = table(spark, d, "embeddings").select(F.posexplode("embedding").alias("i", "x")).groupBy("i").agg(F.var_pop(F.col("x").cast("double")).alias("v"), F.max(F.abs(F.col("x").cast("double"))).alias("a"))
    return per.select(F.col("i").cast("long").alias("i"), F.round("v", 6).alias("variance"), F.round(F.col("v") / F.max("a").over(Window.partitionBy()), 6).alias("scaled"))  # a row per dimension


@query("baselines", """WITH r AS (SELECT l_discount AS y, l_returnflag AS c FROM lineitem), m AS (SELECT avg(y) AS m FROM r), s AS (SELECT count(*) / (SELECT count(*) FROM r) AS p FROM r GROUP BY c)
SELECT (SELECT round(avg(abs(y - m)), 6) FROM r, m) AS mean_mae, (SELECT round(sqrt(avg((y - m) ** 2)), 6) FROM r, m) AS mean_rmse, (SELECT round(max(p), 6) FROM s) AS majority_accuracy, (SELECT round(sum(p * (1 - p)), 6) FROM s) AS prior_brier""")
def baselines(spark, d):
    b = selection.baselines(table(spark, d, "lineitem"), "l_discount", "l_returnflag")
    return b.select(*[F.round(c, 6).alias(c) for c in b.columns])


@query("undersampled", """WITH r AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY md5(vec_id::VARCHAR), vec_id) AS n FROM embeddings), s AS (SELECT min(c) AS c FROM (SELECT count(*) AS c FROM embeddings GROUP BY label))
SELECT vec_id, label FROM r, s WHERE n <= c""")
def undersampled(spark, d):
    return resampling.undersampled(table(spark, d, "embeddings"), "label", "vec_id").select("vec_id", "label")


@query("oversampled", """WITH r AS (SELECT doc_id, toxic, coalesce(n_chars, 0)::DOUBLE AS x, quality::DOUBLE AS y FROM labels JOIN documents USING (doc_id)), m AS (SELECT * FROM r WHERE toxic = 1),
n AS (SELECT a.doc_id, b.doc_id AS other, b.x AS bx, b.y AS yb, row_number() OVER (PARTITION BY a.doc_id ORDER BY sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2), b.doc_id) - 1 AS i FROM m a JOIN m b ON a.doc_id <> b.doc_id),
c AS (SELECT doc_id, least(5, count(*)) AS c FROM n GROUP BY 1), d AS (SELECT m.*, copy, md5(doc_id || ':' || copy || ':42') AS h FROM m, range(1, 3) t(copy)),
s AS (SELECT d.*, ('0x' || substr(h, 1, 8))::BIGINT % c AS pick, ('0x' || substr(h, 9, 8))::BIGINT / 4294967296.0 AS u FROM d LEFT JOIN c USING (doc_id))
SELECT doc_id, toxic, round(x, 6) AS n_chars, round(y, 6) AS quality, false AS synthetic FROM r
UNION ALL SELECT s.doc_id, s.toxic, round(x + u * (coalesce(bx, x) - x), 6), round(y + u * (coalesce(yb, y) - y), 6), true FROM s LEFT JOIN n ON n.doc_id = s.doc_id AND n.i = s.pick""")
def oversampled(spark, d):
    docs = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id").select("doc_id", "toxic", F.coalesce("n_chars", F.lit(0)).alias("n_chars"), "quality")
    s = resampling.synthetic(docs, "toxic", 1, "doc_id", ["n_chars", "quality"], copies=2)
    return s.withColumns({"n_chars": F.round("n_chars", 6), "quality": F.round("quality", 6)})


def _auc(df: DataFrame, **weight: str) -> float:
    return BinaryClassificationEvaluator(labelCol="label", **weight).evaluate(df)


def _appearance_cells(spark: SparkSession, d: str, k: int) -> list[tuple[DataFrame, DataFrame]]:
    rows = evaluation.with_fold(_players(spark, d), "l_orderkey", k)
    return learning.cells(rows, k, ["minutes", "price", "xg", "xa"], ["l_linestatus"], "label")


def _boosted(part: DataFrame, setting: dict):
    return GBTClassifier(seed=42, weightCol="weight", maxBins=learning.BINS + 1, **setting).fit(part)  # a bin more: the 0 that MLlib may add


@query("shot_model")
def shot_model(spark, d):
    """Out-of-fold scores of a boosted model by appearance, folds by match: AUC, log loss and Brier of all folds."""
    fits = evaluation.side_by_side(lambda part: _boosted(part[0], {"maxDepth": 3, "maxIter": SHOT_ROUNDS}).transform(part[1]), _appearance_cells(spark, d, 3))
    scored = reduce(DataFrame.unionByName, fits)
    return evaluation.binary(scored.withColumn("p", vector_to_array("probability")[1]), "label", "p", weight="weight")


@query("parameter_search")
def parameter_search(spark, d):
    _, tried = selection.searched(_appearance_cells(spark, d, 3), {"maxDepth": [2, 3, 4], "maxIter": [3, 5], "stepSize": [0.05, 0.1]}, 12, _boosted, lambda df: _auc(df, weightCol="weight"))
    return spark.createDataFrame([(i, str(sorted(s.items())), float(x)) for i, (s, x) in enumerate(tried)], "draw int, setting string, auc double")


@query("ablation_features")
def ablation_features(spark, d):
    def fit(part, columns):
        return learning.fitted(part, learning.features(columns), LogisticRegression(maxIter=10))

    found = selection.ablated(_players(spark, d), "l_orderkey", 2, {"volume": ["minutes", "price"], "chances": ["xg", "xa"], "all": ["minutes", "price", "xg", "xa"]}, fit, _auc)
    return spark.createDataFrame(found, "variant string, auc double")


@query("ablation_balance")
def ablation_balance(spark, d):
    """Ways of balancing applied to training folds only: none, class weights, under-sampling, synthetic rows."""
    columns, put = ["minutes", "price", "xg", "xa"], written(spark)

    def fit(part, way):
        if way == "weights":
            return learning.fitted(learning.with_class_weight(part, "label"), [VectorAssembler(inputCols=columns, outputCol="features")], LogisticRegression(maxIter=10, weightCol="weight"))
        if way == "fewer":
            part = resampling.undersampled(part, "label", "row_key")
        if way == "synthetic":
            part = put(resampling.synthetic(part, "label", 1.0, "row_key", columns, written=put))  # a fit reads its rows more than once
        return learning.fitted(part, [VectorAssembler(inputCols=columns, outputCol="features")], LogisticRegression(maxIter=10))

    found = selection.ablated(_players(spark, d), "l_orderkey", 2, {w: w for w in ("none", "weights", "fewer", "synthetic")}, fit, _auc)
    return spark.createDataFrame(found, "variant string, auc double")


@query("result_models")
def result_models(spark, d):
    """Three-way results by a forest and by boosting one class against the rest; the booster wins within 0.01 of macro F1."""
    rows = evaluation.with_fold(VectorAssembler(inputCols=["minutes", "price", "xg", "xa", "month"], outputCol="features").transform(_players(spark, d)), "l_orderkey", 2)
    f1 = MulticlassClassificationEvaluator(labelCol="result", metricName="f1")
    fits = {
        "forest": RandomForestClassifier(labelCol="result", numTrees=10, maxDepth=4, seed=42),
        "boosted": OneVsRest(classifier=GBTClassifier(maxDepth=2, maxIter=3, seed=42), labelCol="result"),
    }
    scores = {n: f1.evaluate(evaluation.cross_validated(rows, 2, e.fit)) for n, e in fits.items()}
    best = selection.preferred(scores, "boosted")
    return spark.createDataFrame([(n, float(s), n == best) for n, s in sorted(scores.items())], "model string, f1 double, chosen boolean")


@query("permutation_importance")
def permutation_importance(spark, d):
    columns = ["minutes", "price", "xg", "xa"]
    rows = _players(spark, d).select("row_key", "label", *columns)  # what is dealt is stored
    model = learning.fitted(rows, learning.features(columns), LogisticRegression(maxIter=10))
    return spark.createDataFrame(selection.permutation_importance(model, rows, columns, "row_key", _auc), "column_name string, loss double")


@query("collinear_features")
def collinear_features(spark, d):
    rows = _players(spark, d).withColumn("minutes_twice", F.col("minutes") * 2)
    return spark.createDataFrame([(c,) for c in learning.collinear(rows, ["minutes", "price", "xg", "xa", "minutes_twice"], ["minutes"])], "dropped string")


@query("calibration")
def calibration(spark, d):
    """Brier score before and after isotonic calibration, and whether it is kept."""
    rows = _players(spark, d).select("label", F.least(F.lit(1.0), F.col("xg") * 10).alias("score"), "l_orderkey")
    model, before, after = learning.calibrated(rows, "label", "score", "l_orderkey")
    return spark.createDataFrame([(float(before), float(after), model is not None)], "before double, after double, kept boolean")


_PROFILED = {"o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string", "o_totalprice": "double", "o_orderdate": "date", "o_orderpriority": "string"}


@query("column_profile_full", " UNION ALL ".join(
    f"""SELECT '{c}' AS column_name, '{t}' AS type, count(*) AS n_rows, count(*) - count(x) AS n_null, round((count(*) - count(x)) * 100.0 / count(*), 2) AS null_percent, count(DISTINCT x) AS n_distinct,
    {"round(avg(x), 4)" if t in ("bigint", "double") else "NULL"}::DOUBLE AS mean, {"min(x)::VARCHAR AS least, max(x)::VARCHAR AS greatest" if t != "double" else "'' AS least, '' AS greatest"} FROM (SELECT {f"CAST({c} AS DATE)" if t == "date" else c} AS x FROM orders)"""
    for c, t in _PROFILED.items()
))
def column_profile_full(spark, d):
    o = table(spark, d, "orders")
    o = o.select(*[F.col(c).cast(t).alias(c) for c, t in _PROFILED.items()])
    p = quality.profile_full(o).withColumn("mean", F.round("mean", 4)).drop("samples")
    blank = lambda c: F.when(F.col("type") == "double", "").otherwise(F.col(c)).alias(c)  # engines write doubles in different ways
    return p.select("column_name", "type", "n_rows", "n_null", "null_percent", "n_distinct", "mean", blank("least"), blank("greatest"))


@query("component_report")
def component_report(spark, d):
    return learning.component_report(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], 3)


@query("table_report", " UNION ALL ".join(f"SELECT '{t}' AS table_name, true AS present, count(*) AS n_rows FROM {t}" for t in ("region", "orders", "documents")) + " UNION ALL SELECT 'weather', false, NULL")
def table_report(spark, d):
    from ..operators import serving

    return serving.table_report(spark, d, ["region", "orders", "documents", "weather"])
