"""Row types of the engine."""

from pyspark.sql import types as T

_S, _D, _L, _I, _TS = T.StringType(), T.DoubleType(), T.LongType(), T.IntegerType(), T.TimestampType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


EVENT = _struct(id=_S, type=_S, source=_S, timestamp=_TS, data=_S, metadata=T.MapType(_S, _S))
MAP_EVENT = _struct(id=_S, type=_S, source=_S, timestamp=_TS, data=T.MapType(_S, _S), metadata=T.MapType(_S, _S))
LOCATION = _struct(country=_S, city=_S, lat=_D, lon=_D)
TRANSACTION = _struct(
    transaction_id=_S, card_number=_S, amount=_D, currency=_S, merchant_id=_S, merchant_name=_S, merchant_mcc=_S,
    timestamp=_TS, ip_address=_S, device_id=_S, location=LOCATION, card_type=_S, account_id=_S, user_id=_S,
)
CONDITION = _struct(feature=_S, operator=_S, threshold=_D)
RULE = _struct(
    id=_S, name=_S, priority=_I, conditions=T.ArrayType(CONDITION), risk_points=_I, action=_S, reason_code=_S,
    cooldown_minutes=_I, enabled=T.BooleanType(),
)
DECISION = _struct(
    transaction_id=_S, risk_score=_I, action=_S, reason_codes=T.ArrayType(_S), triggered_rules=T.ArrayType(_S),
    contributing_features=T.MapType(_S, _D), explain_lines=T.ArrayType(_S), decided_at=_TS,
)
DEAD_LETTER = _struct(
    id=_S, payload=_S, error=_S, source=_S, failed_at=_TS, retry_count=_I, last_retry_at=_TS, next_retry_at=_TS,
    recovered=T.BooleanType(),
)
