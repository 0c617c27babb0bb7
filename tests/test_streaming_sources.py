"""Streams against the batch operators, readers and sinks."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tickloom.operators import bars as batch
from tickloom.sources import readers, sinks
from tickloom.streaming import features

T0 = datetime(2026, 2, 17, 15, 0)
BAR = "ticker string, ts timestamp, o double, h double, l double, c double, v bigint"


def made(n=14):
    rows = []
    for i in range(n):
        o = 10 + (i * 7 % 5) / 10
        rows.append(("AAA", T0 + timedelta(minutes=i), o, o + 0.3, o - 0.2, o + 0.1 * (i % 3 - 1), 100 * (1 + i % 4)))
    return rows


def run(spark, tmp, df_of, chunks, schema, name):
    """Files of chunks through a stream, one a batch, into a memory table."""
    src = tmp / f"{name}-src"
    src.mkdir()
    for i, c in enumerate(chunks):
        spark.createDataFrame(c, schema).coalesce(1).write.mode("append").parquet(str(src))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(src))
    q = df_of(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp / f"{name}-cp")).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name)


def test_stream_equals_batch_and_late_bars_do_not_advance(spark, tmp_path):
    rows = made()
    late = [rows[3]]  # delivered again at the end
    got = run(spark, tmp_path, features.session_features, [rows[:5], rows[5:9], rows[9:], late], BAR, "feats")
    b = spark.createDataFrame(rows, BAR).withColumn("session_date", F.to_date("ts"))
    want = {r.ts: r for r in batch.session_features(b).collect()}
    on_time = [r for r in got.collect() if not r.late]
    assert len(on_time) == len(rows) and got.filter("late").count() == 1
    for r in on_time:
        for c in ("vwap", "rel_volume", "avg_volume_5", "body_ratio", "delta_vwap"):
            a, w = r[c], want[r.ts][c]
            assert (a is None and w is None) or a == pytest.approx(w)
        assert r.vwap_cross_up == want[r.ts].vwap_cross_up and r.vwap_cross_down == want[r.ts].vwap_cross_down


def test_throttle(spark, tmp_path):
    q = [("A", T0 + timedelta(milliseconds=m), 1.0, 2.0) for m in (0, 50, 100, 160, 210)]
    got = run(spark, tmp_path, features.throttled, [q[:2], q[2:]], "ticker string, ts timestamp, bid double, ask double", "thr")
    assert sorted(r.ts for r in got.collect()) == [q[i][1] for i in (0, 2, 4)]


def test_windowed_bars_and_demultiplexing(spark):
    ms = int(T0.timestamp() * 1000) if T0.tzinfo else 1771340400000
    lines = [json.dumps({"ev": "T", "sym": " abc ", "p": 5.0 + i, "sz": 10, "t": ms + i * 60_000}) for i in range(7)]
    lines += [json.dumps({"ev": "AM", "sym": "ABC", "o": 1, "h": 2, "l": 0.5, "c": 1.5, "v": 10.7, "s": ms}), json.dumps({"ev": "Q", "sym": "ABC", "bp": 1.0, "ap": 1.1, "t": ms}), "{broken", json.dumps({"ev": "X", "sym": "ABC"})]
    bars, trades, quotes = features.demultiplex(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert bars.collect()[0].v == 10 and trades.count() == 7 and quotes.count() == 1
    w = features.windowed_bars(trades, 5).orderBy("bucket").collect()
    assert [r.v for r in w] == [50, 20] and w[0].o == 5.0 and w[0].c == 9.0


def test_json_lines_document_last_line(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('{"a": 1}\n\n{bad\n{"a": 2}\n   \n')
    rows, counts = readers.json_lines(spark, str(p), "a int")
    assert sorted(r.a for r in rows.collect()) == [1, 2]
    assert counts.collect()[0].asDict() == {"lines": 5, "blank": 2, "broken": 1}
    assert readers.last_line(spark, str(p)).collect()[0].value == '{"a": 2}'
    d = tmp_path / "d.json"
    d.write_text('{\n "version": "v2",\n "n": 3}')
    assert readers.document(spark, str(d), "version string, n int", "v2").collect()[0].n == 3
    with pytest.raises(Exception, match="unexpected version"):
        readers.document(spark, str(d), "version string, n int", "v1").collect()


def test_wire_bars_increment_pages_retention(spark, tmp_path):
    p = tmp_path / "w.json"
    p.write_text("".join(json.dumps({"t": t, "o": 1.0, "h": 1.0, "l": 1.0, "c": 1.0, "v": 9.9}) + "\n" for t in (0, 60_000, 120_000)))
    b = readers.wire_bars(spark, str(p), "abc", 60_000, 120_000)
    assert b.count() == 2 and b.first().v == 9 and b.first().ticker == "ABC"
    stored = spark.createDataFrame([("A", 5)], "k string, t int")
    rows = spark.createDataFrame([("A", 5), ("A", 6), ("B", 1)], "k string, t int")
    assert sorted(map(tuple, readers.newer_than(rows, stored, "k", "t").collect())) == [("A", 6), ("B", 1)]
    assert [r.t for r in readers.page(rows, ["t"], 2, 1).collect()] == [6]
    files = spark.createDataFrame([("a", 1), ("b", 3), ("c", 2)], "path string, modified int")
    assert sorted(r.path for r in readers.latest_files(files, 2).collect()) == ["b", "c"]


def test_sinks(spark, tmp_path):
    t = sinks.KeyedTable(spark, str(tmp_path / "k"), ["k"], ["at"])
    t.merge(spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], "k string, at int, s string"))
    t.merge(spark.createDataFrame([("a", 2, "z"), ("a", 0, "old"), (None, 9, "n")], "k string, at int, s string"))
    assert sorted(map(tuple, t.read().collect())) == [("a", 2, "z"), ("b", 1, "y")] and t.versions() == [1, 2]
    sinks.csv(spark.createDataFrame([('q"uo,te', None)], "a string, b string").coalesce(1), str(tmp_path / "c"), quote_all=True)
    text = next((tmp_path / "c").glob("*.csv")).read_text()
    assert '"q""uo,te"' in text
    rows = spark.createDataFrame([(T0, "a")], "ts timestamp, s string")
    sinks.json_by_day(rows, str(tmp_path / "j"), "ts")
    sinks.json_by_day(rows, str(tmp_path / "j"), "ts")
    assert spark.read.json(str(tmp_path / "j")).count() == 2 and (tmp_path / "j" / "day=2026-02-17").exists()
    sinks.gzip_text(rows.select("s"), str(tmp_path / "g"))
    assert list((tmp_path / "g").glob("*.gz"))
    sinks.append(rows, str(tmp_path / "p"))
    sinks.append(rows, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2


def test_stream_into_keyed_table(spark, tmp_path):
    src = tmp_path / "s"
    for at in (1, 2):
        spark.createDataFrame([("a", at)], "k string, at int").coalesce(1).write.mode("append").parquet(str(src))
    t = sinks.KeyedTable(spark, str(tmp_path / "kt"), ["k"], ["at"])
    q = t.stream(spark.readStream.schema("k string, at int").option("maxFilesPerTrigger", 1).parquet(str(src)), str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert [tuple(r) for r in t.read().collect()] == [("a", 2)]


def test_stream_that_starts_in_mid_session_goes_on_from_stored_bars(spark, tmp_path):
    rows = made()
    stored = spark.createDataFrame(rows[:6] + rows[2:4] + [("BBB", T0, 1.0, 1.0, 1.0, 1.0, 5), (None, T0, 1.0, 1.0, 1.0, 1.0, 5)], BAR)
    got = run(spark, tmp_path, lambda s: features.session_features(s, stored), [rows[6:9], rows[9:], [rows[0], ("CCC", T0, 1.0, 2.0, 1.0, 1.5, 7)]], BAR, "seeded")
    b = spark.createDataFrame(rows, BAR).withColumn("session_date", F.to_date("ts"))
    want = {r.ts: r for r in batch.session_features(b).collect()}
    on_time = [r for r in got.collect() if not r.late and r.ticker == "AAA"]
    assert len(on_time) == len(rows) - 6 and got.filter("late").count() == 1 and got.filter("ticker = 'CCC'").first().delta_close is None
    for r in on_time:
        for c in ("vwap", "rel_volume", "avg_volume_5", "delta_close", "delta_vwap"):
            assert r[c] == pytest.approx(want[r.ts][c])
        assert r.vwap_cross_up == want[r.ts].vwap_cross_up and r.vwap_cross_down == want[r.ts].vwap_cross_down


def test_keyed_table_rewrites_only_what_it_touches(spark, tmp_path):
    line = "k string, at int, s string"
    t = sinks.KeyedTable(spark, str(tmp_path / "k"), ["k"], ["at"], buckets=8, keep=2)
    assert t.read() is None and t.merge(spark.createDataFrame([], line)) == 0 and t.remove(spark.createDataFrame([("a",)], "k string")) == 0
    rows = [(f"k{i}", 1, "x") for i in range(40)]
    t.merge(spark.createDataFrame(rows, line))
    t.merge(spark.createDataFrame([("k3", 2, "y")], line))
    m = t._manifest()
    assert sorted(set(m["parts"].values())) == [1, 2] and sum(v == 2 for v in m["parts"].values()) == 1
    assert sinks.KeyedTable(spark, str(tmp_path / "k"), ["k"], ["at"], buckets=3).buckets == 8
    t.remove(spark.createDataFrame([("k1",), ("k1",), (None,), ("nobody",)], "k string"))
    got = {r.k: r.s for r in t.read().collect()}
    assert len(got) == 39 and got["k3"] == "y" and "k1" not in got
    new = t.claim(spark.createDataFrame([("k1", 5, "mine"), ("k2", 5, "late"), ("k1", 4, "mine")], line)).collect()
    assert [(r.k, r.at) for r in new] == [("k1", 5)] and {r.k: r.s for r in t.read().collect()}["k2"] == "x"
    assert not t.claim(spark.createDataFrame([("k1", 6, "again")], line)).collect()
    assert len(t.versions()) == 2 and t.read().count() == 40  # versions before the last two are gone, what they share is not
