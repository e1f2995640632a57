import pytest
from pyspark.sql import functions as F

from riskloom.functions import bands, scalars


def values(df, column="x"):
    return [r[column] for r in df.collect()]


def test_bands_and_missing_values(spark):
    df = spark.createDataFrame([(549,), (550,), (650,), (749,), (750,), (None,)], "s int").coalesce(1)
    assert values(df.select(bands.credit_band("s").alias("x"))) == ["poor", "fair", "good", "good", "excellent", "poor"]
    assert values(df.select(bands.cut("s", bands.CREDIT_EDGES, bands.CREDIT_LABELS).alias("x"))) == [
        "poor", "fair", "good", "good", "excellent", None,
    ]
    tenure = spark.createDataFrame([(2,), (3,), (6,), (7,), (None,)], "t int").coalesce(1)
    assert values(tenure.select(bands.tenure_band("t").alias("x"))) == ["short", "medium", "medium", "long", "long"]


def test_cut_sends_nan_to_null_and_checks_labels(spark):
    df = spark.createDataFrame([(float("nan"),), (1.0,)], "s double").coalesce(1)
    assert values(df.select(bands.cut("s", [0], ["a", "b"]).alias("x"))) == [None, "b"]
    with pytest.raises(ValueError):
        bands.band("s", [1, 2], ["a"])


def test_right_closed(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (1.1,), (2.0,), (2.1,), (-0.1,), (None,)], "s double").coalesce(1)
    assert values(df.select(bands.right_closed("s", [0, 1, 2], ["a", "b"]).alias("x"))) == ["a", "a", "b", "b", None, None, None]


def test_safe_ratio_and_time(spark):
    df = spark.createDataFrame([(10.0, 4.0), (10.0, 0.0), (10.0, None)], "n double, d double").coalesce(1)
    assert values(df.select(scalars.safe_ratio("n", "d").alias("x"))) == [2.5, 0.0, 0.0]
    t = spark.createDataFrame([(0.0,), (3600.0 * 5 + 1,), (3600.0 * 6,), (3600.0 * 25,), (None,)], "s double").coalesce(1)
    t = t.withColumn("h", scalars.time_hours("s")).withColumn("w", scalars.time_hours("s", wrap=True))
    assert [(r.h, r.w) for r in t.collect()] == [(0, 0), (5, 5), (6, 6), (25, 1), (None, None)]
    assert values(t.select(scalars.is_night("h").alias("x"))) == [1, 1, 0, 0, 0]
    assert values(t.select(scalars.is_night("w").alias("x"))) == [1, 1, 0, 1, 0]


def test_formats_round_halves_to_even(spark):
    numbers = [0.1225, 0.12345, 0.7, 1.0, 0.0006]
    df = spark.createDataFrame([(v,) for v in numbers], "v double").coalesce(1)
    assert values(df.select(scalars.percent_format("v").alias("x"))) == [f"{v:.1%}" for v in numbers]
    assert values(df.select(scalars.score_format("v").alias("x"))) == [f"{v:.3f}" for v in numbers]


def test_preview(spark):
    texts = ["a" * 180, "a\nb" + "c" * 200, "short"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1)
    expected = [t[:180].replace("\n", " ") + ("…" if len(t) > 180 else "") for t in texts]
    assert values(df.select(scalars.preview("t").alias("x"))) == expected


def test_alerts(spark):
    df = spark.createDataFrame([(0.25, 0.01), (0.2, 0.05), (0.1, 0.5), (None, None)], "p double, k double").coalesce(1)
    df = df.withColumn("a", scalars.alert_list(F.col("p"), F.col("k"), 0.2, 0.05)).withColumn("x", scalars.alert_text("a"))
    assert values(df) == [
        "PSI 0.250 >= threshold 0.2, KS p-value 0.010 <= threshold 0.05",
        "PSI 0.200 >= threshold 0.2, KS p-value 0.050 <= threshold 0.05",
        "OK",
        "OK",
    ]


def test_seconds_since(spark):
    df = spark.sql("select timestamp_ntz'2024-01-03 01:02:03.5' as t")
    assert values(df.select(scalars.seconds_since("t", "2024-01-01 00:00:00").alias("x"))) == [2 * 86400 + 3723.5]


@pytest.mark.parametrize("method", ["xxhash64", "md5"])
def test_hashes_are_uniform_and_keyed(spark, method):
    df = spark.range(4000).select(
        scalars.hash_fraction(["id"], 1, method).alias("u"), scalars.key_hash(["id"], 2, method).alias("h"), scalars.key_hash(["id"], 1, method).alias("g")
    )
    row = df.agg(F.min("u"), F.max("u"), F.avg("u"), F.min("h"), F.max("h"), F.count_if(F.col("h") == F.col("g"))).first()
    assert 0 <= row[0] and row[1] < 1 and abs(row[2] - 0.5) < 0.03
    assert 0 <= row[3] and row[4] < 1 << 60 and row[5] == 0
