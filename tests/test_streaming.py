"""Streams against the batch operators over the same rows."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from meterflow.operators import windows as W
from meterflow.streaming import cleaner, features

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "region string, place int, timestamp timestamp_ntz, v double, u double"


def near(a, b):
    return (a is None) == (b is None) and (a is None or abs(a - b) <= 1e-9 * max(1.0, abs(a)))


def test_features_of_late_rows_and_restarts_equal_the_batch(spark, tmp_path):
    r = random.Random(5)
    series = [("A", 1, 1.0), ("B", 2, 10.0), (None, 3, 0.5)]
    rows = [
        (g, p, T0 + dt.timedelta(hours=h), None if r.random() < 0.03 or h < 2 else k * r.random(), float(h % 11))
        for g, p, k in series for h in range(260) if r.random() < 0.95
    ]
    arrivals = {0: [], 1: [], 2: []}
    for x in rows:
        h = (x[2] - T0).total_seconds() / 3600
        arrivals[min(2, int((h + r.randrange(0, 20)) // 90))].append(x)  # up to 20 hours late
    path, lags, rolls = str(tmp_path), (1, 24, 168), (1, 3, 24)
    for k, part in arrivals.items():
        r.shuffle(part)
        spark.createDataFrame(part, SCHEMA).repartition(2).write.mode("append").parquet(f"{path}/in")
        hours = cleaner.read_files(spark, f"{path}/in", spark.createDataFrame([], SCHEMA).schema, files_per_trigger=100)
        out = features.add_features(hours, ["v", "u"], "20 hours", lags, rolls, ["region", "place"])
        cleaner.write(out, f"{path}/out", f"{path}/state").awaitTermination(300)
    top = max(x[2] for x in rows) - dt.timedelta(hours=20)
    df = spark.createDataFrame(rows, SCHEMA)
    want = W.over_rows(df, lambda w: W.lag_columns(["v", "u"], lags, w) | W.rolling_columns(["v", "u"], rolls), 168, region=["region", "place"], steps=W.ladder_steps(["v", "u"], rolls))
    fills = W.fill_forward(df, ["v", "u"], ["region", "place"]).withColumnsRenamed({"v": "v_filled", "u": "u_filled"}).drop("region")
    want = want.join(fills, ["place", "timestamp"]).where(F.col("timestamp") <= F.lit(top))
    got = spark.read.parquet(f"{path}/out")
    assert set(got.columns) == set(want.columns)
    mine = {(x["place"], x["timestamp"]): x for x in got.collect()}
    theirs = {(x["place"], x["timestamp"]): x for x in want.collect()}
    assert got.count() == len(mine) and mine.keys() == theirs.keys() and len(mine) > 600
    for key, x in theirs.items():
        for c in want.columns:
            if c not in ("region", "place", "timestamp"):
                assert near(mine[key][c], x[c]), (key, c, mine[key][c], x[c])


def test_rows_after_their_time_was_closed_are_left_out(spark, tmp_path):
    schema, path = "region string, timestamp timestamp_ntz, v double", str(tmp_path)
    at = lambda h: T0 + dt.timedelta(hours=h)
    for part in ([("A", at(h), float(h)) for h in range(20)], [("A", at(3), 99.0), ("A", at(20), 20.0), ("A", None, 1.0)], [("A", at(40), 40.0)]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{path}/in")
        hours = cleaner.read_files(spark, f"{path}/in", spark.createDataFrame([], schema).schema)
        cleaner.write(features.add_features(hours, ["v"], "5 hours", (1,), ()), f"{path}/out", f"{path}/state").awaitTermination(300)
    got = sorted((r["timestamp"], r["v"], r["v_lag_1h"]) for r in spark.read.parquet(f"{path}/out").collect())
    assert got == [(at(h), float(h), float(h - 1) if h else None) for h in range(21)]


def test_state_of_a_series_does_not_grow():
    p = features.SeriesFeatures(["region"], ["v"], (1, 5), (3,))

    class Held:
        def __init__(self):
            self.rows, self.timers = [], []

        def exists(self):
            return bool(self.rows)

        def get(self):
            return iter(list(self.rows))

        def put(self, rows):
            self.rows = list(rows)

        appendList = lambda self, rows: self.rows.extend(rows)  # noqa: E731, N815
        clear = lambda self: self.rows.clear()
        registerTimer = lambda self, t: self.timers.append(t)  # noqa: E731, N815

    class Value:
        row = None
        get = lambda self: self.row

        def update(self, row):
            self.row = row

    class At:
        def __init__(self, ms):
            self.getCurrentWatermarkInMs = lambda: ms

    import pandas as pd

    p.waiting, p.past, p.handle = Held(), Value(), Held()
    out = []
    for day in range(50):
        t = (np.arange(24) + day * 24) * 3_600_000_000
        list(p.handleInputRows(("A",), iter([pd.DataFrame({"k": "A", "at": t, "t": t, "v": np.arange(24.0)})]), At(0)))
        out += list(p.handleExpiredTimer(("A",), At((day * 24 + 20) * 3_600_000), None))
        assert len(p.waiting.rows) <= 24 + 3 and len(p.past.row[1]) <= p.back == 5
    assert sum(map(len, out)) == 49 * 24 + 21


@pytest.mark.parametrize("n", [1, 2, 168])
def test_rolled_is_the_plain_window(n):
    r = np.random.default_rng(1)
    x = r.random(5000)
    x[[7, 900, 901]] = np.nan
    got = features.rolled(x, 40, n)
    for i in (40, 41, n + 39, 899, 902, 902 + n, 4999):
        w = x[max(0, i - n + 1) : i + 1]
        if len(w) < n or np.isnan(w).any():
            assert np.isnan(got[:, i - 40]).all()
        else:
            assert np.allclose(got[[0, 2, 3], i - 40], [w.mean(), w.min(), w.max()]) and (n == 1) == np.isnan(got[1, i - 40])
            assert n == 1 or np.isclose(got[1, i - 40], w.std(ddof=1))


def recorded(folder, n, page=10):
    import json

    for at in range(0, n, page):
        data = [{"period": f"2024-01-01T{k:03d}", "respondent": "A", "value": k} for k in range(at, min(n, at + page))]
        (folder / f"region-data_A_s_{at}.json").write_text('{"status": 429}\n' + json.dumps({"response": {"data": data}}))


def test_a_restart_of_paging_reads_new_pages_only(spark, tmp_path):
    import json

    from meterflow.sources import rest

    pages = tmp_path / "pages"
    pages.mkdir()
    spark.dataSource.register(rest.PagedSource)
    requests = json.dumps([{"data_type": "demand", "regions": [r], "start": "s", "end": "e"} for r in ("A", "none")])
    options = {"requests": requests, "transport": f"replay:{pages}", "page": "10", "pages_per_task": "2", "wait": "none"}
    seen = []
    for n in (0, 25, 25, 61):
        recorded(pages, n)
        if n == 61:  # what was read once is not asked for again
            for at in (0, 10):
                (pages / f"region-data_A_s_{at}.json").write_text("gone")
        stream = spark.readStream.format("paged").options(**options).load()
        cleaner.write(stream, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination(300)
        got = spark.read.schema(stream.schema).parquet(f"{tmp_path}/out") if (tmp_path / "out").exists() else None
        seen.append(sorted(int(r["value"]) for r in got.collect()) if got else [])
    assert seen == [[], list(range(25)), list(range(25)), list(range(61))]


def test_partitions_of_a_paged_stream():
    import json

    from meterflow.sources import rest

    reader = rest.PagedStreamReader({"requests": json.dumps([{"data_type": "demand", "regions": ["A"], "start": "s", "end": "e"}]), "transport": "replay:/nowhere", "page": "10", "pages_per_task": "3"})
    key = rest._key(reader.calls.requests[0])
    spans = [(p.value["from"], p.value["to"]) for p in reader.partitions({key: 7}, {key: 95})]
    assert spans == [(7, 30), (30, 60), (60, 90), (90, 95)]
    assert reader.partitions({key: 7}, {key: 7}) == [] and reader.latestOffset() == {key: 0}
    with pytest.raises(rest.Shrunk):
        reader.partitions({key: 7}, {key: 5})


def test_a_long_batch_of_a_paged_stream_has_few_tasks_with_calls_under_way(monkeypatch):
    import json
    import threading

    from meterflow.sources import rest

    requests = [{"data_type": "demand", "regions": [r], "start": "s", "end": "e"} for r in "ABC"]
    reader = rest.PagedStreamReader({"requests": json.dumps(requests), "transport": "replay:/nowhere", "page": "10", "pages_per_task": "2", "tasks": "50", "pool": "4", "wait": "none"})
    a, b, c = map(rest._key, reader.calls.requests)
    start, end = {a: 7, b: 0}, {a: 100_003, b: 12, c: 0}
    found = [p.value for p in reader.partitions(start, end)]
    assert len(found) <= 52 and all(p["regions"] == ["A"] or (p["from"], p["to"]) == (0, 12) for p in found)
    spans = [(p["from"], p["to"]) for p in found if p["regions"] == ["A"]]
    assert [x[0] for x in spans] == [7, *[x[1] for x in spans[:-1]]] and spans[-1][1] == 100_003 and all(x % 10 == 0 for _, x in spans[:-1])

    door, refused = threading.Barrier(4, timeout=20), set()

    def fetch(params):
        at, n = int(params["offset"]), int(params["length"])
        if at not in refused:  # pauses after a refusal overlap
            refused.add(at)
            door.wait()
            raise rest.Refused(503)
        return {"response": {"data": [{"value": k} for k in range(at, at + n)]}}

    monkeypatch.setattr(rest, "transport", lambda *_: fetch)
    read = [b["value"].to_pylist() for b in reader.read(rest.Request(requests[0] | {"from": 7, "to": 75}))]
    assert sum(read, []) == [str(k) for k in range(7, 75)] and len(read) == 8
