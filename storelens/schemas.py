"""Canonical table schemas (explicit; never inferred)."""

from pyspark.sql import types as T

TRANSACTIONS = T.StructType([
    T.StructField("Invoice", T.StringType()),
    T.StructField("StockCode", T.StringType()),
    T.StructField("Description", T.StringType()),
    T.StructField("Quantity", T.IntegerType()),
    T.StructField("InvoiceDate", T.TimestampNTZType()),
    T.StructField("Price", T.DoubleType()),
    T.StructField("Customer ID", T.DoubleType()),
    T.StructField("Country", T.StringType()),
])

# rating arrives as a string so that quoted numbers ("4.0") stay valid.
REVIEWS_RAW = T.StructType([
    T.StructField("rating", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("asin", T.StringType()),
    T.StructField("parent_asin", T.StringType()),
    T.StructField("user_id", T.StringType()),
    T.StructField("timestamp", T.LongType()),
    T.StructField("helpful_vote", T.IntegerType()),
    T.StructField("verified_purchase", T.BooleanType()),
    T.StructField("_corrupt_record", T.StringType()),
])

LABELLED_REVIEWS = T.StructType([
    T.StructField("review_id", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("rating", T.IntegerType()),
    T.StructField("label", T.StringType()),
    T.StructField("source", T.StringType()),
])

REVIEW_SENTIMENT = T.StructType([
    T.StructField("CustomerID", T.StringType()),
    T.StructField("review_date", T.TimestampNTZType()),
    T.StructField("sentiment_score", T.DoubleType()),
])

ASPECT_SENTIMENT = T.StructType([
    T.StructField("CustomerID", T.StringType()),
    T.StructField("review_date", T.TimestampNTZType()),
    T.StructField("aspect", T.StringType()),
    T.StructField("aspect_sentiment", T.DoubleType()),
])

# The 19 model inputs in model order, and the default used for a
# scoring request that omits a feature.
FEATURE_COLUMNS = [
    "frequency", "monetary_value", "recency_days", "tenure_days",
    "avg_order_value", "recency_days_log", "purchase_gap_cv",
    "category_diversity", "is_single_purchase", "return_rate",
    "purchase_trend", "time_decay_weight", "avg_sentiment_score",
    "negative_review_count", "last_review_sentiment", "has_reviews",
    "avg_battery_sentiment", "avg_price_sentiment", "avg_shipping_sentiment",
]

FEATURE_DEFAULTS = {
    "frequency": 1.0, "monetary_value": 0.0, "recency_days": 0.0,
    "tenure_days": 0.0, "avg_order_value": 0.0, "recency_days_log": 0.0,
    "purchase_gap_cv": -1.0, "category_diversity": 1.0,
    "is_single_purchase": 1.0, "return_rate": 0.0, "purchase_trend": 0.0,
    "time_decay_weight": 0.0, "avg_sentiment_score": 0.0,
    "negative_review_count": 0.0, "last_review_sentiment": 0.0,
    "has_reviews": 0.0, "avg_battery_sentiment": 0.0,
    "avg_price_sentiment": 0.0, "avg_shipping_sentiment": 0.0,
}

# The 17 scaled numeric columns (flags excluded), in model order.
NUMERIC_FEATURE_COLUMNS = [
    "recency_days", "recency_days_log", "frequency", "monetary_value",
    "avg_order_value", "tenure_days", "purchase_gap_cv", "category_diversity",
    "return_rate", "purchase_trend", "time_decay_weight", "avg_sentiment_score",
    "last_review_sentiment", "negative_review_count", "avg_battery_sentiment",
    "avg_shipping_sentiment", "avg_price_sentiment",
]

ASPECT_SENTENCES = T.StructType([
    T.StructField("_id", T.StringType()), T.StructField("text", T.StringType()),
    T.StructField("aspectTerms", T.StructType([T.StructField("aspectTerm", T.ArrayType(T.StructType([
        T.StructField("_term", T.StringType()), T.StructField("_polarity", T.StringType())])))])),
])
