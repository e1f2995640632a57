"""Explicit schemas: a CSV needs no extra pass for inference."""

from pyspark.sql import types as T

CHURN_RAW = T.StructType(
    [
        T.StructField("RowNumber", T.IntegerType()),
        T.StructField("CustomerId", T.LongType()),
        T.StructField("Surname", T.StringType()),
        T.StructField("CreditScore", T.IntegerType()),
        T.StructField("Geography", T.StringType()),
        T.StructField("Gender", T.StringType()),
        T.StructField("Age", T.IntegerType()),
        T.StructField("Tenure", T.IntegerType()),
        T.StructField("Balance", T.DoubleType()),
        T.StructField("NumOfProducts", T.IntegerType()),
        T.StructField("HasCrCard", T.IntegerType()),
        T.StructField("IsActiveMember", T.IntegerType()),
        T.StructField("EstimatedSalary", T.DoubleType()),
        T.StructField("Exited", T.IntegerType()),
    ]
)

COMPONENTS = [f"V{i}" for i in range(1, 29)]

FRAUD_RAW = T.StructType(
    [T.StructField("Time", T.DoubleType())]
    + [T.StructField(v, T.DoubleType()) for v in COMPONENTS]
    + [T.StructField("Amount", T.DoubleType()), T.StructField("Class", T.IntegerType())]
)

CHURN_FEATURES = T.StructType(
    [
        T.StructField("Geography", T.StringType()),
        T.StructField("Gender", T.StringType()),
        T.StructField("Age", T.IntegerType()),
        T.StructField("Tenure", T.IntegerType()),
        T.StructField("tenure_bucket", T.StringType()),
        T.StructField("Balance", T.DoubleType()),
        T.StructField("EstimatedSalary", T.DoubleType()),
        T.StructField("NumOfProducts", T.IntegerType()),
        T.StructField("is_active_flag", T.IntegerType()),
        T.StructField("is_active_member", T.IntegerType()),
        T.StructField("has_cr_card", T.IntegerType()),
        T.StructField("CreditScore", T.IntegerType()),
        T.StructField("credit_score_bucket", T.StringType()),
        T.StructField("balance_salary_ratio", T.DoubleType()),
    ]
)

FRAUD_FEATURES = T.StructType(
    [
        T.StructField("Amount", T.DoubleType()),
        T.StructField("amount_log", T.DoubleType()),
        T.StructField("time_hours", T.IntegerType()),
        T.StructField("is_night", T.IntegerType()),
    ]
    + [T.StructField(v, T.DoubleType()) for v in COMPONENTS]
)

FEATURE_STORE = T.StructType(
    [
        T.StructField("entity_id", T.StringType()),
        T.StructField("dataset", T.StringType()),
        T.StructField("features", T.StringType()),
        T.StructField("label", T.IntegerType()),
    ]
)

PREDICTIONS = T.StructType(
    [
        T.StructField("entity_id", T.StringType()),
        T.StructField("label", T.IntegerType()),
        T.StructField("probability", T.DoubleType()),
        T.StructField("prediction", T.IntegerType()),
    ]
)

ANOMALY_SCORES = T.StructType(
    [
        T.StructField("entity_id", T.StringType()),
        T.StructField("label", T.IntegerType()),
        T.StructField("reconstruction_error", T.DoubleType()),
        T.StructField("prediction", T.IntegerType()),
    ]
)
