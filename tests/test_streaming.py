import datetime as dt

import pytest
from pyspark.sql import functions as F

from newsmart.functions import dates
from newsmart.operators import ingest
from newsmart.sources.versions import Conflict, VersionedTable, replace_keys_in
from newsmart.streaming import freshness, ingest as stream, jobstate, urlindex

T0 = dt.datetime(2024, 1, 10)
ITEM = "item_id long, source_name string, title string, link string, guid string, published_at timestamp, collected_at timestamp"


def _land(df, path, files=1):
    df.repartition(files).write.parquet(path)


def test_stream_ingest_equals_batch(spark, tmp_path):
    rows = [(i, f"s{i % 3}", f"Title {i}", f"http://x/{i % 7}?utm_source=a", None, None, T0 + dt.timedelta(minutes=i)) for i in range(40)]
    items = spark.createDataFrame(rows, ITEM)
    _land(items, str(tmp_path / "in"))
    got = stream.run_available(spark.readStream.schema(items.schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"))
    want = ingest.new_items(ingest.normalise(items), spark.createDataFrame([], "canonical_url string"))
    assert {r["item_id"] for r in got.collect()} == {r["item_id"] for r in want.collect()}


def test_second_batch_sees_the_archive(spark, tmp_path):
    first = spark.createDataFrame([(1, "a", "T", "http://x/1", None, None, T0)], ITEM)
    more = spark.createDataFrame([(2, "a", "T2", "http://x/1#f", None, None, T0), (3, "a", "T3", "http://x/3", None, None, T0)], ITEM)
    src = str(tmp_path / "in")
    first.write.parquet(src)
    read = lambda: spark.readStream.schema(first.schema).parquet(src)
    stream.run_available(read(), str(tmp_path / "out"))
    more.write.mode("append").parquet(src)
    got = stream.run_available(read(), str(tmp_path / "out"))
    assert sorted(r["item_id"] for r in got.collect()) == [1, 3]


def test_freshness_stream_equals_batch(spark, tmp_path):
    rows = [(T0 + dt.timedelta(minutes=17 * i), "k" if i % 2 else "m") for i in range(50)]
    df = spark.createDataFrame(rows, "ts timestamp, kind string")
    _land(df, str(tmp_path / "in"))
    got = freshness.run_available(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "ts", "kind", str(tmp_path / "out"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, freshness.window_counts(df, "ts", "kind").collect()))


EVENTS = "article_id long, status string, processed_at timestamp, seq long"


def _minute(k):
    return T0 + dt.timedelta(minutes=k)


def test_job_timeouts(spark, tmp_path):
    src = str(tmp_path / "in")
    a = spark.createDataFrame([(1, "processing", _minute(0), 1), (2, "failed", _minute(0), 2), (3, "success", _minute(0), 3), (4, "invalid_json", _minute(0), 4)], EVENTS)
    a.coalesce(1).write.parquet(src)
    run = lambda: {r["article_id"]: (r["state"], r["at"]) for r in jobstate.run_available(spark.readStream.schema(a.schema).parquet(src), str(tmp_path / "out")).collect()}
    assert {k: v[0] for k, v in run().items()} == {1: "PROCESSING", 2: "COOLDOWN", 3: "COMPLETED", 4: "NON_RETRYABLE"}
    spark.createDataFrame([(9, "success", _minute(5), 9)], EVENTS).write.mode("append").parquet(src)
    got = run()
    assert got[1] == ("PROCESSING", _minute(0)) and got[2] == ("RETRYABLE", _minute(5))  # a deadline that is reached has passed
    spark.createDataFrame([(9, "success", _minute(15), 10)], EVENTS).write.mode("append").parquet(src)
    assert run()[1] == ("STALE", _minute(15))


def test_job_events_two_hours_late(spark, tmp_path):
    src = str(tmp_path / "in")
    land = lambda *rows: spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(src)
    run = lambda: {r["article_id"]: (r["state"], r["at"]) for r in jobstate.run_available(spark.readStream.schema(EVENTS).parquet(src), str(tmp_path / "out")).collect()}
    land((1, "processing", _minute(200), 1), (2, "failed", _minute(199), 2), (5, "processing", _minute(10), 3))
    run()
    # late: the first event of article 4, one older than what is known of 2, one newer than what is known of 5
    land((4, "success", _minute(80), 4), (2, "success", _minute(80), 5), (5, "success", _minute(80), 6))
    got = run()
    assert got == {1: ("PROCESSING", _minute(200)), 2: ("COOLDOWN", _minute(199)), 4: ("COMPLETED", _minute(80)), 5: ("COMPLETED", _minute(80))}
    batch = jobstate.states_at(jobstate.newest(spark.read.parquet(src)), dates.ts(str(_minute(200))))
    assert {r["article_id"]: (r["state"], r["at"]) for r in batch.collect()} == got


def test_nothing_landed(spark, tmp_path):
    for name in ("items", "events"):
        (tmp_path / name).mkdir()
    got = stream.run_available(spark.readStream.schema(ITEM).parquet(str(tmp_path / "items")), str(tmp_path / "a"))
    assert got.count() == 0 and stream.counters(spark, str(tmp_path / "a")).count() == 0
    assert jobstate.run_available(spark.readStream.schema(EVENTS).parquet(str(tmp_path / "events")), str(tmp_path / "b")).count() == 0


def _items(spark, ids):
    return spark.createDataFrame([(i, f"s{i % 3}", f"T {i}", f"http://x/{i % 50}", None, None, T0) for i in ids], ITEM)


def test_url_index_over_epochs_compaction_and_replay(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    want, seen, fetched = set(), set(), 0
    for k in range(6):
        ids = list(range(10 * k, 10 * k + 14))
        _items(spark, ids).coalesce(1).write.mode("append").parquet(src)
        stream.run_available(spark.readStream.schema(ITEM).parquet(src), out, compact_every=2)
        for i in sorted(ids, key=lambda i: (i % 3, i)):
            if i % 50 not in seen:
                seen.add(i % 50)
                want.add(i)
        fetched += len(ids)
    assert {r["item_id"] for r in stream.archive(spark, out).collect()} == want
    index = urlindex.UrlIndex(spark, f"{out}/urls")
    assert index.base.current()[1].endswith("-3") and index._deltas.names() == ["epoch=4", "epoch=5"]
    # a replay of the last epoch writes the same rows to the same place
    stream.archive_writer(out)(_items(spark, range(50, 64)), 5)
    assert {r["item_id"] for r in stream.archive(spark, out).collect()} == want
    total = stream.counters(spark, out).agg(F.sum("fetched"), F.sum("new"), F.sum("duplicates")).first()
    assert tuple(total) == (fetched, len(want), fetched - len(want))


def test_a_batch_reads_only_its_buckets(spark, tmp_path):
    index = urlindex.UrlIndex(spark, str(tmp_path / "urls"), buckets=8)
    urls = spark.createDataFrame([(f"u{i}",) for i in range(100)], "canonical_url string").withColumn("b", urlindex.bucket(buckets=8))
    index.add(urls.where("b <> 3"), 0)
    index.compact(0)
    index.add(urls.where("b = 3"), 1)
    asked = urls.where("b in (2, 3)")
    for broken in tmp_path.glob("urls/base/data/*/bucket=[!2]/*.parquet"):  # files of other buckets cannot even be read
        broken.write_bytes(b"broken")
    assert {r[0] for r in index.known(asked, 2).collect()} == {r["canonical_url"] for r in asked.collect()}
    assert {r[0] for r in index.known(asked, 1).collect()} == {r["canonical_url"] for r in asked.where("b = 2").collect()}


def test_versions_are_seen_whole_or_not_at_all(spark, tmp_path):
    rows = lambda *x: spark.createDataFrame(x, "k int, v string")
    table = VersionedTable(spark, str(tmp_path / "t"))
    schema = rows((1, "a")).schema
    state = lambda df: sorted(map(tuple, df.collect()))
    assert state(table.read(schema)) == []
    table.replace(lambda _: rows((1, "a"), (1, "b"), (2, "c")))
    old = table.read(schema)
    table.stage(rows((9, "lost")))  # a writer that dies before publishing
    assert state(table.read(schema)) == [(1, "a"), (1, "b"), (2, "c")]
    replace_keys_in(table, rows((1, "z"), (3, "n")), "k")
    assert state(table.read(schema)) == [(1, "z"), (2, "c"), (3, "n")]
    assert state(old) == [(1, "a"), (1, "b"), (2, "c")]  # a reader keeps the version it began with
    slow = table.stage(rows((7, "slow")))
    with pytest.raises(Conflict):
        table.publish(slow, after=1)
    table.forget(keep=1)
    assert state(table.read(schema)) == [(1, "z"), (2, "c"), (3, "n")] and len(table._data.names()) == 1


def test_late_items_are_kept(spark, tmp_path):
    day = dt.timedelta(days=1)
    first = spark.createDataFrame([(1, "a", "One", "http://x/1", None, None, T0 + 3 * day)], ITEM)
    late = spark.createDataFrame([(2, "a", "Two", "http://x/2", None, None, T0), (3, "a", "Three", "http://x/3", None, None, T0 + 3 * day)], ITEM)
    src = str(tmp_path / "in")
    first.write.parquet(src)
    stream.run_available(spark.readStream.schema(first.schema).parquet(src), str(tmp_path / "out"))
    late.write.mode("append").parquet(src)
    got = stream.run_available(spark.readStream.schema(first.schema).parquet(src), str(tmp_path / "out"))
    assert sorted(r["item_id"] for r in got.collect()) == [1, 2, 3]


def test_late_arrivals_are_counted(spark, tmp_path):
    days = lambda *n: spark.createDataFrame([(T0 + dt.timedelta(days=k), "a") for k in n], "ts timestamp, kind string")
    src = str(tmp_path / "in")
    run = lambda: freshness.run_available(spark.readStream.schema("ts timestamp, kind string").parquet(src), "ts", "kind", str(tmp_path / "out"))
    days(90).write.parquet(src)
    run()
    days(0, 90).write.mode("append").parquet(src)
    want = freshness.window_counts(days(90, 0, 90), "ts", "kind")
    assert sorted(map(tuple, run().collect())) == sorted(map(tuple, want.collect()))


def test_stream_of_a_table_in_many_files(spark, tmp_path):
    from newsmart.sources.bind import Tables

    spark.range(10).repartition(3).write.parquet(str(tmp_path / "many" / "documents.parquet"))
    q = Tables(spark, str(tmp_path / "many")).stream("documents").writeStream.format("memory").queryName("many_files").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("many_files").count() == 10
