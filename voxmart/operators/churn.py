"""Churn risk ranking per author. The label is stated in the posts themselves, so the result
ranks exposure; it does not predict an unseen outcome."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxmart.functions.labels import count_where, is_negative

FEATURES = ("mentions", "complaints", "avg_score", "neg_ratio")


def features(rows: DataFrame) -> DataFrame:
    return rows.filter(F.coalesce("author", F.lit("")) != "").groupBy("author").agg(
        F.count(F.lit(1)).alias("mentions"), count_where(F.col("intent") == "complaint").alias("complaints"),
        count_where(F.col("intent") == "churn_threat").alias("churn_threat"),
        F.coalesce(F.avg("score"), F.lit(0.0)).alias("avg_score"),
        (F.count_if(is_negative(F.col("sentiment"))) / F.count(F.lit(1))).alias("neg_ratio"),
        F.max(F.coalesce("churn_risk", F.lit(0))).alias("churn_flag"))


def heuristic():
    """Used where there is nothing to train on."""
    raw = (0.5 * F.col("neg_ratio") + F.when(F.col("complaints") > 0, 0.3).otherwise(0.0)
           + F.when(F.col("churn_threat") > 0, 0.2).otherwise(0.0))
    return F.least(F.greatest(raw, F.lit(0.0)), F.lit(1.0))


def with_probability(feats: DataFrame) -> DataFrame:
    """Balanced logistic regression with an L2 penalty of C = 1, or the heuristic.

    Balanced weights sum to n, so Spark's averaged loss with regParam 1/n is that objective.
    """
    y = F.when((F.col("churn_flag") == 1) | (F.col("churn_threat") > 0), 1.0).otherwise(0.0)
    data = feats.withColumn("label", y)
    n, pos = data.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    if not 2 <= pos < n:
        return data.withColumn("prob", heuristic())
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    weight = F.when(F.col("label") == 1, n / (2.0 * pos)).otherwise(n / (2.0 * (n - pos)))
    train = VectorAssembler(inputCols=list(FEATURES), outputCol="x").transform(data.withColumn("w", weight))
    model = LogisticRegression(featuresCol="x", weightCol="w", regParam=1.0 / n, elasticNetParam=0.0,
                               standardization=False, maxIter=500, tol=1e-8).fit(train)
    return model.transform(train).withColumn("prob", vector_to_array("probability")[1])


def churn_risk(rows: DataFrame, bridge: DataFrame, customers: DataFrame, top: int = 50) -> DataFrame:
    """The most exposed authors with their leading factor, named where they are customers."""
    scored = with_probability(features(rows))
    factor = (F.when(F.col("churn_threat") > 0, "churn threat stated").when(F.col("neg_ratio") > 0.6, "high negativity")
              .when(F.col("complaints") > 1, "repeat complaints").otherwise("monitor"))
    board = scored.select("author", F.round("prob", 3).alias("churn_prob"), "complaints",
                          F.round("avg_score", 3).alias("avg_score"), "mentions", factor.alias("top_factor"))
    board = board.orderBy(F.desc("churn_prob"), "author").limit(top)
    names = (bridge.select("author", "customer_key")
             .join(customers.select("customer_key", "customer_name"), "customer_key", "left"))
    return board.join(names, "author", "left").select(
        F.col("author").alias("entity_key"), F.coalesce("customer_name", "author").alias("name"),
        F.when(F.col("customer_key").isNotNull(), "customer").otherwise("handle").alias("kind"),
        "churn_prob", "complaints", "avg_score", "mentions", "top_factor")
