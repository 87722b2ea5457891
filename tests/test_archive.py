import pytest

from gaugeflow.operators.archive import Archive, StatsQuery, narrowed, stats_query
from gaugeflow.sources import schemas, streams

STATS = "station string, sensor int, timestamp long, window_ms long, mean double, min double, max double, count long, regime int"


def rows(n, mean=1.0, station="A"):
    return [(station, 0, i * 500, 500, mean, mean - 1, mean + 1, 5, 0) for i in range(n)]


def test_first_write_wins_and_repeats_write_nothing(spark, tmp_path):
    a = Archive(spark, str(tmp_path / "stats"))
    first = spark.createDataFrame(rows(10), STATS)
    assert a.upsert(first, ["mean"]) == 10
    assert a.upsert(first, ["mean"]) == 0
    assert a.upsert(spark.createDataFrame(rows(12, 7.0), STATS), ["mean"]) == 2
    stored = a.read(first.schema)
    assert stored.where("mean = 1.0").count() == 10
    got = stats_query(stored, StatsQuery(limit=5)).collect()
    assert [r["timestamp"] for r in got] == [3500, 4000, 4500, 5000, 5500]
    assert a.upsert(first.limit(0), ["mean"]) == 0


def test_parameters():
    q = StatsQuery.parse({"station": "A", "sensor": "2", "start_ts": "-5", "end_ts": "9", "limit": "10000"})
    assert q == StatsQuery("A", 2, -5, 9, 10_000)
    assert StatsQuery.parse({}).limit == 1000
    for bad in ({"sensor": "x"}, {"limit": "0"}, {"limit": "10001"}, {"start_ts": "2", "end_ts": "1"}, {"end_ts": ""}):
        with pytest.raises(ValueError, match=next(iter(bad)) if len(bad) == 1 else "start_ts"):
            StatsQuery.parse(bad)


def test_storage_range(spark):
    wide = [("A", 0, 0, 1 << 40, 1.0, 0.0, 2.0, 5, 0), ("A", 0, 500, 500, 1.0, 3.0, 2.0, 5, 0), ("A", -1, 500, 500, 1.0, 0.0, 2.0, 5, 0), ("A", 0, 500, 500, 1.0, 0.0, 2.0, 0, 0), *rows(1)]
    good, bad = narrowed(spark.createDataFrame(wide, STATS))
    assert (good.count(), bad.count()) == (1, 4)


def test_messages_round_trip_and_poison_is_set_aside(spark, tmp_path):
    sent = spark.createDataFrame([("A", 1, [1.5, -2.0], 1), ("B-2", 2, [], None)], schemas.RAW)
    path = str(tmp_path / "raw")
    streams.publish(sent, path)
    spark.createDataFrame([('{"station":"A","timestamp":3',), ('{"station":"a b","timestamp":3,"values":[1]}',), ('{"timestamp":3,"values":[1]}',), ('{"station":"C","timestamp":"x","values":[1]}',), ('{"station":"C","timestamp":9,"values":[1],"extra":{"k":1}}',)], "value string").write.mode("append").text(path)
    good, bad = schemas.split(schemas.decode(spark.read.text(path), "raw"))
    assert sorted((r["station"], r["timestamp"], list(r["values"]), r["regime"]) for r in good.collect()) == [("A", 1, [1.5, -2.0], 1), ("B-2", 2, [], None), ("C", 9, [1.0], None)]
    assert bad.count() == 4
    assert streams.replay(spark, path, "raw", 2, 9).count() == 2


@pytest.mark.parametrize("kind,text,ok", [
    ("stats", '{"station":"A","sensor":0,"timestamp":1,"window_ms":500,"mean":1,"min":0,"max":2,"count":3}', True),
    ("stats", '{"station":"A","sensor":0,"timestamp":1,"window_ms":0,"mean":1,"min":0,"max":2,"count":3}', False),
    ("forecast", '{"station":"A","sensor":0,"origin_ts":1,"step_ms":500,"timestamps":[2],"forecasts":[1],"lower_ci":[0],"upper_ci":[2],"confidence":0.98,"metrics":[{"horizon":1,"n":0,"mae":null}]}', True),
    ("forecast", '{"station":"A","sensor":0,"origin_ts":1,"step_ms":500,"timestamps":[],"forecasts":[],"lower_ci":[],"upper_ci":[],"confidence":0.98,"metrics":[]}', False),
    ("regime", '{"station":"A","timestamp":1,"probabilities":[0.1,0.9],"state":1,"n_scored":0}', True),
    ("alert", '{"id":"x","rule":"stale","severity":"critical","state":"firing","station":"A","sensor":null,"timestamp":1,"message":"m"}', True),
    ("alert", '{"id":"x","rule":"stale","severity":"loud","state":"firing","station":"A","timestamp":1,"message":"m"}', False),
])
def test_contracts(spark, kind, text, ok):
    assert schemas.decode(spark.createDataFrame([(text,)], "value string"), kind).first()["ok"] is ok
