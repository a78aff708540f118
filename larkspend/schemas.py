"""Declared schemas, enumerations and defaults of the card-risk model."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, LongType, StringType, StructField, StructType, TimestampType

S, L, D, T, B, I = StringType(), LongType(), DoubleType(), TimestampType(), BooleanType(), IntegerType()  # noqa: E741


def _struct(*fields: tuple) -> StructType:
    return StructType([StructField(f[0], f[1], len(f) < 3) for f in fields])


#: A third entry marks a required field.
TRANSACTION = _struct(
    ("transaction_id", S, True), ("card_id", S, True), ("merchant_id", S, True), ("amount_minor", L, True), ("currency", S), ("event_time", T),
    ("lat", D), ("lon", D), ("category", S), ("labelled_fraud", B), ("device_fingerprint", S),
)
CARD = _struct(("card_id", S, True), ("customer_id", S), ("status", S), ("daily_limit_minor", L), ("currency", S))
CUSTOMER = _struct(("customer_id", S, True), ("risk_tier", S), ("home_country", S), ("home_lat", D), ("home_lon", D))
MERCHANT = _struct(("merchant_id", S, True), ("name", S), ("mcc", S), ("country", S), ("lat", D), ("lon", D))
REASON = _struct(("rule", S), ("score", I), ("detail", S))
REASONS = ArrayType(REASON)

STATUSES = ("ACTIVE", "BLOCKED", "EXPIRED")
TIERS = ("LOW", "MEDIUM", "HIGH")
VERDICTS = ("APPROVE", "REVIEW", "DECLINE")

#: What a missing value, or an unknown symbol of an enumeration, is read as.
DEFAULTS = {"currency": "EUR", "status": "ACTIVE", "risk_tier": "LOW", "decision": "REVIEW"}
SYMBOLS = {"status": STATUSES, "risk_tier": TIERS, "decision": VERDICTS}
