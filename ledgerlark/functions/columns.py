"""Column expressions shared by batch and streaming jobs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Thresholds of the scoring rules.
HIGH, MEDIUM = 0.8, 0.5
EXTREME_RATIO, EXTREME_HISTORY, EXTREME_SCORE = 5.0, 3, 0.95
Z_ALERT, Z_HIGH, DAILY_HISTORY = 2.0, 3.0, 10
CONTAMINATION, CONTAMINATION_LOW, CONTAMINATION_HIGH, CONTAMINATION_LABELS = 0.01, 0.005, 0.15, 5
PENDING_LIMIT, TRAIN_ROWS, ROLLING = 2, 30, 10


def severity(score: Column) -> Column:
    """High, Medium or Low; null for a null score."""
    return F.when(score.isNull(), None).when(score >= HIGH, "High").when(score >= MEDIUM, "Medium").otherwise("Low")


def log_amount(amount: Column) -> Column:
    return F.log1p(F.greatest(amount, F.lit(0.0)))


def weekday(ts: Column) -> Column:
    """0 for Monday to 6 for Sunday."""
    return F.weekday(ts)


def personal_score(margin: Column) -> Column:
    """The logistic function of the negated margin; a margin beyond exp's range gives 0."""
    return 1.0 / (1.0 + F.exp(margin))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def blank(x: Column) -> Column:
    """Whether a required text field is missing once trimmed."""
    return F.length(F.trim(F.coalesce(x, F.lit("")))) == 0


def text_or(x: Column, default: str) -> Column:
    return F.coalesce(F.nullif(F.trim(x), F.lit("")), F.lit(default))


def parse_time(x: Column, *formats: str) -> Column:
    """The first format that fits, else null: minutes from forms, seconds from the API."""
    formats = formats or ("yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm")
    return F.coalesce(*[F.try_to_timestamp(x, F.lit(f)) for f in formats])


def signed_amount(amount: Column, tx_type: Column) -> Column:
    return F.when(F.lower(tx_type) == "deposit", amount).otherwise(-amount)


def stable_key(*parts: Column) -> Column:
    """A key that replays give again."""
    return F.sha2(F.concat_ws("~", *[p.cast("string") for p in parts]), 256)


def alert_message(score: Column, kind: Column) -> Column:
    return F.format_string("Suspicious %s scored %.2f", kind, score)


def encrypt_device(device: Column, key: str) -> Column:
    """Base64 of the AES-GCM text of a device id; null and empty ids pass."""
    return F.when(device == "", device).otherwise(F.base64(F.aes_encrypt(device, F.lit(key))))


def decrypt_device(cipher: Column, key: str) -> Column:
    """The device id behind encrypt_device(); what can't be decrypted comes back unchanged."""
    return F.coalesce(
        F.try_aes_decrypt(F.try_to_binary(cipher, F.lit("base64")), F.lit(key)).cast("string"), cipher
    )
