"""From raw tables to the feature store, and back."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.bands import credit_band, tenure_band
from ..functions.scalars import is_night, log_amount, safe_ratio, time_hours
from ..sources.schemas import CHURN_FEATURES, FRAUD_FEATURES

COPIES_PER_ROW = 100_000


def clean_churn(raw: DataFrame) -> DataFrame:
    """Raw customer table with typed flags, ratio and bands; names of persons are dropped."""
    return (
        raw.drop("RowNumber", "Surname")
        .withColumnsRenamed({"CustomerId": "customer_id", "Exited": "label"})
        .withColumns(
            {
                "is_active_member": F.col("IsActiveMember").cast("int"),
                "has_cr_card": F.col("HasCrCard").cast("int"),
                "balance_salary_ratio": safe_ratio("Balance", "EstimatedSalary"),
                "credit_score_bucket": credit_band("CreditScore"),
                "tenure_bucket": tenure_band("Tenure"),
            }
        )
    )


def row_id(df: DataFrame, out: str = "transaction_id", method: str = "content", hash_name: str = "xxhash64") -> DataFrame:
    """Surrogate id per row.

    ``content`` names a row by a hash of its values and the number of its copy: the same in every run
    and for every file layout. Equal rows are counted, not gathered: the count is unfolded again in
    blocks spread over the tasks, so a row repeated by a third of the table is no hot group.
    ``position`` numbers rows by place without a shuffle; such a table must be written before it is
    read twice.
    """
    if method == "position":
        return df.withColumn(out, F.monotonically_increasing_id())
    if method != "content":
        raise ValueError(f"unknown row id method: {method}")
    columns = df.columns
    if hash_name == "md5":
        digest = F.md5(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in columns]))
    else:
        digest = F.hex(F.xxhash64(*columns))
    counted = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("__n"))
    # Nearly all rows have few copies and unfold where they are; both branches read one exchange.
    few = counted.where(F.col("__n") <= COPIES_PER_ROW).select(
        *columns, F.explode(F.sequence(F.lit(0).cast("long"), F.col("__n") - 1)).alias("__copy")
    )
    step = F.lit(COPIES_PER_ROW).cast("long")
    blocks = counted.where(F.col("__n") > COPIES_PER_ROW).withColumn(
        "__from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__n") - 1, step))
    )
    many = blocks.repartition(*columns, "__from").select(
        *columns, F.explode(F.sequence("__from", F.least(F.col("__from") + step, F.col("__n")) - 1)).alias("__copy")
    )
    return few.unionByName(many).select(*columns, F.concat_ws("-", digest, F.col("__copy").cast("string")).alias(out))


def clean_fraud(raw: DataFrame, id_method: str = "content") -> DataFrame:
    """Raw transactions with an id, log amount, hours and night flag."""
    return row_id(raw, method=id_method).withColumnRenamed("Class", "label").withColumns(
        {"amount_log": log_amount("Amount"), "time_hours": time_hours("Time")}
    ).withColumn("is_night", is_night("time_hours"))


def churn_struct() -> Column:
    """The churn features in store order."""
    renamed = {"is_active_flag": F.col("IsActiveMember").alias("is_active_flag")}
    return F.struct(*[renamed.get(f, F.col(f)) for f in CHURN_FEATURES.names])


def fraud_struct() -> Column:
    """The transaction features in store order."""
    return F.struct(*[F.col(f) for f in FRAUD_FEATURES.names])


def tag_entity(df: DataFrame, key: str, dataset: str) -> DataFrame:
    """Add ``entity_id`` as text and the name of the data set."""
    return df.withColumns({"entity_id": F.col(key).cast("string"), "dataset": F.lit(dataset)})


def pack_features(df: DataFrame, key: str, dataset: str, features: Column, typed: bool = False) -> DataFrame:
    """``(entity_id, dataset, features, label)``; features as JSON text, or as a struct if ``typed``."""
    value = features if typed else F.to_json(features)
    return tag_entity(df, key, dataset).select("entity_id", "dataset", value.alias("features"), F.col("label").cast("int").alias("label"))


def churn_features(cleaned: DataFrame, typed: bool = False) -> DataFrame:
    return pack_features(cleaned, "customer_id", "churn", churn_struct(), typed)


def fraud_features(cleaned: DataFrame, typed: bool = False) -> DataFrame:
    return pack_features(cleaned, "transaction_id", "fraud", fraud_struct(), typed)


def union_features(*parts: DataFrame) -> DataFrame:
    """Union by name; a column absent on one side is null there."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def _flat(schema: T.StructType, path: tuple[str, ...] = ()) -> list[tuple[str, ...]]:
    """Paths of all leaf fields, depth first."""
    out: list[tuple[str, ...]] = []
    for field in schema.fields:
        here = (*path, field.name)
        out += _flat(field.dataType, here) if isinstance(field.dataType, T.StructType) else [here]
    return out


def unpack_features(
    store: DataFrame, schema: T.StructType, column: str = "features", keep: Sequence[str] = ("entity_id", "label")
) -> DataFrame:
    """Features as typed columns; nested fields are joined by ``_`` and dots in names become ``_``.

    Works on JSON text and on the struct form (where unused fields are never read).
    """
    parsed = store
    if isinstance(store.schema[column].dataType, T.StringType):
        parsed = store.withColumn(column, F.from_json(column, schema))
    fields = []
    for path in _flat(schema):
        value = F.col(column)
        for name in path:
            value = value.getField(name)
        fields.append(value.alias("_".join(path).replace(".", "_")))
    return parsed.select(*keep, *fields)


