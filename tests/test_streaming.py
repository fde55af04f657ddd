from __future__ import annotations

import datetime as dt

import pytest

from tessera.streaming import sessions, stateful

T0 = dt.datetime(2024, 1, 1)


def at(ms):
    return T0 + dt.timedelta(milliseconds=ms)


@pytest.fixture
def run(spark, tmp_path):
    def go(rows, schema, f, key):
        src = f"{tmp_path}/in"
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(src)
        stream = spark.readStream.schema(schema).parquet(src)
        q = f(stream).writeStream.format("memory").queryName("out").outputMode("append").option("checkpointLocation", f"{tmp_path}/ck").start()
        q.processAllAvailable()
        q.stop()
        return sorted(map(tuple, spark.sql("select * from out").collect()), key=key)

    return go


EVENTS = "user string, ts timestamp, x double, y double, zoom double, distance double"


def test_bursts_and_debounce(run):
    rows = [("u", at(0), 0.0, 0.0, 3.0, 1.0), ("u", at(100), 0.0, 1.0, 5.0, 1.0), ("u", at(600), 9.0, 0.0, 5.0, 1.0), ("end", at(60_000), 0.0, 0.0, 0.0, 0.0)]
    got = run(rows, EVENTS, sessions.bursts, key=repr)
    assert [(r[0], r[3], r[4]) for r in got] == [("u", 2, True), ("u", 1, False)] or [(r[0], r[3], r[4]) for r in got] == [("u", 1, False), ("u", 2, True)]


def test_debounce(run):
    rows = [("u", at(0), 0.0, 0.0, 3.0, 1.0), ("u", at(100), 0.0, 1.0, 5.0, 1.0), ("u", at(600), 9.0, 0.0, 5.0, 1.0), ("end", at(60_000), 0.0, 0.0, 0.0, 0.0)]
    got = run(rows, EVENTS, sessions.debounce, key=lambda r: r[1])
    assert [(r[1], r[5]) for r in got] == [(at(100), at(250)), (at(600), at(750))]


def test_moves(run):
    rows = [("u", at(k), x, 0.0, 1.0, d) for k, (x, d) in enumerate([(0.0, 100.0), (0.0, 100.05), (1.0, 100.05), (1.0, 120.0)])]
    assert run(rows, EVENTS, stateful.moves, key=lambda r: r[1]) == [("u", at(0), True, False), ("u", at(2), True, False), ("u", at(3), False, True)]


def test_tile_states(run):
    rows = [("k", at(0), 500), ("k", at(1), 500), ("k", at(2), 200), ("k", at(3), 503), ("g", at(0), 404), ("g", at(1), 200)]
    got = run(rows, "key string, ts timestamp, status int", stateful.tile_states, key=lambda r: (r[0], r[1]))
    assert [(r[0], r[2], r[3]) for r in got] == [("g", "failed", 0), ("g", "failed", 0), ("k", "waiting", 1), ("k", "waiting", 2), ("k", "loaded", 0), ("k", "waiting", 1)]
    assert got[3][4] == at(1) + dt.timedelta(seconds=20)
