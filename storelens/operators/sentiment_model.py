"""Review sentiment classifier (L10) and batch review scoring (L11) on Spark ML."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storelens.functions.scoring import overall_sentiment, sentiment_from_probs
from storelens.functions.text import clean_review_text, once, review_preview

LABELS = ["negative", "neutral", "positive"]


def sentiment_classifier(train: DataFrame, text: str = "text", label: str = "label",
                         num_features: int = 1 << 18) -> PipelineModel:
    """Tokenizer → hashing TF → IDF → multinomial logistic regression.

    Class weights n/(K·n_c) stand in for the reference's focal loss on the
    minority (neutral) class; the weights come from a grouped count.
    """
    idx = F.array_position(F.array(*[F.lit(x) for x in LABELS]), F.col(label)) - 1
    d = train.withColumn("label_idx", idx.cast("double"))
    sizes = {r["label_idx"]: r["n"] for r in d.groupBy("label_idx").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a label
    total = sum(sizes.values())
    weight = F.lit(0.0)
    for k, n in sizes.items():
        weight = F.when(F.col("label_idx").eqNullSafe(F.lit(k)), total / (len(LABELS) * n)).otherwise(weight)
    d = d.withColumn("w", weight)
    pipe = Pipeline(stages=[
        RegexTokenizer(inputCol=text, outputCol="tokens", pattern=r"\W+", toLowercase=True),
        HashingTF(inputCol="tokens", outputCol="tf", numFeatures=num_features),
        IDF(inputCol="tf", outputCol="features", minDocFreq=2),
        LogisticRegression(featuresCol="features", labelCol="label_idx", weightCol="w", family="multinomial",
                           maxIter=50, regParam=0.01),
    ])
    return pipe.fit(d)


def score_reviews(model: PipelineModel, reviews: DataFrame, id_col: str = "review_id", text: str = "text") -> DataFrame:
    """Clean → model → label / confidence / score → overall sentiment → preview."""
    c = reviews.select(id_col, once(clean_review_text(F.col(text))).alias(text))
    p = model.transform(c).withColumn("proba", vector_to_array("probability"))
    s = sentiment_from_probs(F.col("proba"))
    out = p.select(id_col, text, s.alias("s"))
    return out.select(id_col, F.col("s.label").alias("label"), F.col("s.confidence").alias("confidence"),
                      F.col("s.sentiment_score").alias("sentiment_score"),
                      overall_sentiment(F.col("s.label"), F.col("s.confidence")).alias("overall_sentiment"),
                      review_preview(F.col(text)).alias("review_text"))
