"""The keyed archive of window statistics: idempotent writes, validated range and latest-N reads."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DAY_MS = 86_400_000
#: Days that a batch's partitions are named by, one by one; a batch of more is compared with the span from first to last.
MAX_DAYS = 1000
KEY = ["station", "sensor", "timestamp"]
DEFAULT_LIMIT, MAX_LIMIT = 1000, 10_000


@dataclass(frozen=True)
class StatsQuery:
    station: str | None = None
    sensor: int | None = None
    start_ts: int | None = None
    end_ts: int | None = None
    limit: int = DEFAULT_LIMIT

    @classmethod
    def parse(cls, params: dict[str, str]) -> StatsQuery:
        """From text parameters; ValueError names what is wrong. Empty text counts as not given for station only."""

        def number(key: str) -> int | None:
            if key not in params:
                return None
            try:
                return int(params[key])
            except ValueError:
                raise ValueError(f"{key} is not a whole number: {params[key]!r}") from None

        out = cls(params.get("station") or None, number("sensor"), number("start_ts"), number("end_ts"), number("limit") if "limit" in params else DEFAULT_LIMIT)
        if not 1 <= out.limit <= MAX_LIMIT:
            raise ValueError(f"limit must lie between 1 and {MAX_LIMIT}")
        if out.start_ts is not None and out.end_ts is not None and out.start_ts > out.end_ts:
            raise ValueError("start_ts is after end_ts")
        return out


def stats_query(archive: DataFrame, q: StatsQuery) -> DataFrame:
    """The newest rows within the filters, oldest first. Filters reach the scan; ties at the limit fall by key."""
    for column, op, value in (("station", "==", q.station), ("sensor", "==", q.sensor), ("timestamp", ">=", q.start_ts), ("timestamp", "<=", q.end_ts)):
        if value is not None:
            c = F.col(column)
            archive = archive.where(c == value if op == "==" else c >= value if op == ">=" else c <= value)
    newest = archive.orderBy(F.desc("timestamp"), "station", "sensor").limit(q.limit)
    return newest.orderBy("timestamp", "station", "sensor")


def first_wins(rows: DataFrame, order: list[str], key: list[str] = KEY) -> DataFrame:
    """One row per key, the first by order. A hash aggregate with partial sums, not a window: a repeated key costs no
    sort of its rows."""
    rest = [c for c in rows.columns if c not in key]
    picked = rows.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__row"))
    return picked.select(*key, *[F.col(f"__row.{c}").alias(c) for c in rest]).select(rows.columns)


def new_rows(batch: DataFrame, archive: DataFrame, order: list[str], key: list[str] = KEY) -> DataFrame:
    """What an insert that ignores conflicts would write: the batch's first row of each key that the archive lacks."""
    return first_wins(batch, order, key).join(archive.select(*key), key, "left_anti")


def narrowed(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows in storage types, rows that don't fit them or break the table's checks)."""
    types = {"sensor": "int", "window_ms": "int", "count": "bigint", "regime": "smallint"}
    tried = rows.withColumns({f"__{c}": F.expr(f"try_cast({c} AS {t})") for c, t in types.items() if c in rows.columns})
    fits = F.lit(True)
    for c in types:
        if c in rows.columns:
            fits = fits & (F.col(c).isNull() | F.col(f"__{c}").isNotNull())
    fits = fits & (F.col("sensor") >= 0) & (F.col("window_ms") > 0) & (F.col("count") > 0) & (F.col("min") <= F.col("max"))
    fits = F.coalesce(fits, F.lit(False))
    good = tried.where(fits).select(*[F.col(f"__{c}").alias(c) if c in types else F.col(c) for c in rows.columns])
    return good, tried.where(~fits).select(rows.columns)


class Archive:
    """A Parquet table of window statistics, partitioned by station and day."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _days(self, schema) -> DataFrame:
        """The table with its day; an empty one where nothing has been written. Any other trouble is an error."""
        sc = self.spark.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(self.path)
        if not path.getFileSystem(sc._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], schema).withColumn("day", F.lit(0).cast("long"))
        return self.spark.read.schema(T.StructType([*schema.fields, T.StructField("day", T.LongType())])).parquet(self.path)

    def read(self, schema) -> DataFrame:
        return self._days(schema).drop("day")

    def query(self, schema, q: StatsQuery) -> DataFrame:
        """stats_query over the partitions of the days that the query spans."""
        rows = self._days(schema)
        for bound, low in ((q.start_ts, True), (q.end_ts, False)):
            if bound is not None:
                rows = rows.where(F.col("day") >= bound // DAY_MS if low else F.col("day") <= bound // DAY_MS)
        return stats_query(rows.drop("day"), q)

    def upsert(self, batch: DataFrame, order: list[str]) -> int:
        """Writes what is new; rows written. Writing a batch again writes nothing, so a retried batch is safe. Only the
        days that the batch holds are read for the comparison, so one late row costs its own day and none between."""
        day = F.floor(F.col("timestamp") / DAY_MS)
        held = [r["day"] for r in batch.select(day.alias("day")).where("day IS NOT NULL").distinct().limit(MAX_DAYS + 1).collect()]
        if not held:
            return 0
        inside = F.col("day").isin(held) if len(held) <= MAX_DAYS else F.col("day").between(*batch.agg(F.min(day), F.max(day)).first())
        known = self._days(batch.schema).where(inside).drop("day")
        new = new_rows(batch, known, order).withColumn("day", day).persist()
        try:
            n = new.count()
            if n:
                new.repartition("station", "day").write.mode("append").partitionBy("station", "day").parquet(self.path)
            return n
        finally:
            new.unpersist()


def missing_keys(published: DataFrame, stored: DataFrame, key: list[str] = KEY) -> DataFrame:
    """Keys that were published and aren't stored: the loss check of an outage test."""
    return published.select(*key).distinct().join(stored.select(*key), key, "left_anti")
