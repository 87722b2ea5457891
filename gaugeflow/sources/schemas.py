"""Message schemas, JSON decoding with quarantine, and JSON encoding."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expr import valid_station

STR, INT, LONG, REAL = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


def _list(t: T.DataType) -> T.ArrayType:
    return T.ArrayType(t)


RAW = _struct(station=STR, timestamp=LONG, values=_list(REAL), regime=T.ByteType())
STATS = _struct(station=STR, sensor=INT, timestamp=LONG, window_ms=LONG, mean=REAL, min=REAL, max=REAL, count=LONG, regime=T.ByteType())
METRICS = _struct(horizon=INT, n=LONG, mae=REAL, mase=REAL, coverage=REAL)
FORECAST = _struct(station=STR, sensor=INT, origin_ts=LONG, step_ms=LONG, timestamps=_list(LONG), forecasts=_list(REAL), lower_ci=_list(REAL), upper_ci=_list(REAL), confidence=REAL, metrics=_list(METRICS))
REGIME = _struct(station=STR, timestamp=LONG, probabilities=_list(REAL), state=INT, true_regime=INT, mapped_state=INT, accuracy=REAL, n_scored=LONG)
ALERT = _struct(id=STR, rule=STR, severity=STR, state=STR, station=STR, sensor=INT, timestamp=LONG, message=STR, value=REAL)

#: Fixed values of the alert contract.
SEVERITIES = ("info", "warning", "serious", "critical")
ALERT_STATES = ("firing", "resolved")

_CORRUPT = "_corrupt"


def _all(*tests: Column) -> Column:
    return F.coalesce(reduce(lambda a, b: a & b, tests), F.lit(False))


def valid(kind: str, m: str = "m") -> Column:
    """What a decoded message of a kind must satisfy; a missing required field fails."""
    f = lambda name: F.col(f"{m}.{name}")
    if kind == "raw":
        return _all(valid_station(f("station")), f("timestamp").isNotNull(), f("values").isNotNull(), ~F.exists(f("values"), lambda v: v.isNull()))
    if kind == "stats":
        return _all(valid_station(f("station")), f("sensor") >= 0, f("timestamp").isNotNull(), f("window_ms") > 0, f("count") > 0, f("mean").isNotNull(), f("min") <= f("max"))
    if kind == "forecast":
        arrays = [f(a) for a in ("timestamps", "forecasts", "lower_ci", "upper_ci")]
        return _all(valid_station(f("station")), f("sensor") >= 0, f("origin_ts").isNotNull(), *[F.size(a) > 0 for a in arrays])
    if kind == "regime":
        return _all(valid_station(f("station")), f("timestamp").isNotNull(), f("probabilities").isNotNull(), f("state").isNotNull())
    if kind == "alert":
        return _all(f("id").isNotNull(), f("rule").isNotNull(), f("severity").isin(*SEVERITIES), f("state").isin(*ALERT_STATES), f("timestamp").isNotNull())
    raise ValueError(f"no message kind {kind}")


SCHEMAS = {"raw": RAW, "stats": STATS, "forecast": FORECAST, "regime": REGIME, "alert": ALERT}


def decode(lines: DataFrame, kind: str, column: str = "value") -> DataFrame:
    """Adds m (the message) and ok. Unknown fields are ignored, missing optional ones are null; text that isn't JSON, or
    that lacks or mistypes a required field, has ok = false and keeps its text for the quarantine."""
    schema = T.StructType([*SCHEMAS[kind].fields, T.StructField(_CORRUPT, T.StringType())])
    parsed = F.from_json(F.col(column), schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT})
    return lines.withColumn("m", parsed).withColumn("ok", F.col(f"m.{_CORRUPT}").isNull() & valid(kind))


def split(decoded: DataFrame, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """(messages, quarantined text). A poison message is set aside once and never read again."""
    fields = [f for f in decoded.schema["m"].dataType.names if f != _CORRUPT]
    return decoded.where("ok").select(*[F.col(f"m.{f}").alias(f) for f in fields]), decoded.where(~F.col("ok")).select(column)


def encode(rows: DataFrame, fields: list[str] | None = None, ignore_null: bool = True) -> DataFrame:
    """One JSON text per row; a null optional field is left out."""
    return rows.select(F.to_json(F.struct(*(fields or rows.columns)), {"ignoreNullFields": str(ignore_null).lower()}).alias("value"))
