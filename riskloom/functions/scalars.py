"""Scalar features, text formats and keyed hashes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

HASH_BITS = 60
HASH_SPAN = 1 << HASH_BITS


def _column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def safe_ratio(numerator: Column | str, denominator: Column | str) -> Column:
    """``numerator / denominator`` where the denominator is positive, else 0."""
    n, d = _column(numerator), _column(denominator)
    return F.when(d > 0, n / d).otherwise(F.lit(0.0))


def log_amount(amount: Column | str) -> Column:
    return F.log1p(_column(amount))


def time_hours(seconds: Column | str, wrap: bool = False) -> Column:
    """Whole hours since the start of the data; ``wrap`` gives the hour of the day instead."""
    hours = (_column(seconds) / F.lit(3600)).cast("int")
    return hours % 24 if wrap else hours


def is_night(hours: Column | str) -> Column:
    """1 for hours 0 to 5, else 0 (also when missing)."""
    h = _column(hours)
    return F.when((h >= 0) & (h < 6), F.lit(1)).otherwise(F.lit(0))


def seconds_since(ts: Column | str, origin: str) -> Column:
    """Seconds from ``origin`` (``yyyy-MM-dd HH:mm:ss``) to a zone-free timestamp, as double."""
    span = _column(ts).cast("timestamp_ntz") - F.lit(origin).cast("timestamp_ntz")
    part = lambda unit: F.call_function("date_part", F.lit(unit), span)
    return (
        part("DAY").cast("double") * 86400 + part("HOUR") * 3600 + part("MINUTE") * 60 + part("SECOND").cast("double")
    )


def percent_format(value: Column | str, digits: int = 1) -> Column:
    """``0.1234`` as ``12.3%``, rounding halves of the exact value to even."""
    pattern = "0." + "0" * digits if digits else "0"
    return F.concat(F.call_function("format_number", _column(value) * 100, F.lit(pattern)), F.lit("%"))


def score_format(value: Column | str, digits: int = 3) -> Column:
    pattern = "0." + "0" * digits if digits else "0"
    return F.call_function("format_number", _column(value), F.lit(pattern))


def preview(text: Column | str, width: int = 180) -> Column:
    """First ``width`` characters on one line, with an ellipsis when cut."""
    text = _column(text)
    head = F.translate(F.substring(text, 1, width), "\n", " ")
    return F.concat(head, F.when(F.length(text) > width, F.lit("…")).otherwise(F.lit("")))


def threshold_predict(score: Column | str, threshold: float | Column) -> Column:
    """1 where the score reaches the threshold."""
    limit = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return (_column(score) >= limit).cast("int")


def alert_list(psi: Column, p_value: Column, psi_threshold: float, p_threshold: float) -> Column:
    """Alert messages as an array, empty when nothing is wrong."""
    psi_text = F.when(
        psi >= F.lit(psi_threshold), F.concat(F.lit("PSI "), score_format(psi), F.lit(f" >= threshold {psi_threshold}"))
    )
    p_text = F.when(
        p_value <= F.lit(p_threshold),
        F.concat(F.lit("KS p-value "), score_format(p_value), F.lit(f" <= threshold {p_threshold}")),
    )
    return F.array_compact(F.array(psi_text, p_text))


def alert_text(alerts: Column | str) -> Column:
    """Messages joined by commas, ``OK`` when there are none."""
    alerts = _column(alerts)
    return F.when(F.size(alerts) == 0, F.lit("OK")).otherwise(F.concat_ws(", ", alerts))


def key_hash(keys: Sequence[str], seed: int = 42, method: str = "xxhash64") -> Column:
    """Uniform integer in ``[0, 2**60)`` from the key columns and a seed.

    ``xxhash64`` is fast; ``md5`` gives the same numbers in other SQL engines.
    """
    if method == "xxhash64":
        return F.shiftrightunsigned(F.xxhash64(F.lit(int(seed)), *[F.col(k) for k in keys]), 64 - HASH_BITS)
    if method == "md5":
        # A missing part is marked, so that ('a', null) and (null, 'a') differ.
        parts = [F.coalesce(F.col(k).cast("string"), F.lit("\u0000")) for k in keys]
        digest = F.md5(F.concat_ws("|", *parts, F.lit(str(int(seed)))))
        return F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("long")
    raise ValueError(f"unknown hash method: {method}")


def hash_fraction(keys: Sequence[str], seed: int = 42, method: str = "xxhash64") -> Column:
    """Uniform double in ``[0, 1)`` (53 bits, so that it never rounds up to 1)."""
    return F.shiftright(key_hash(keys, seed, method), HASH_BITS - 53) / F.lit(float(1 << 53))
