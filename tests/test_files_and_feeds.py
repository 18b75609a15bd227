from __future__ import annotations

import csv
import datetime
import json

from pyspark.sql import functions as F

from driftwise.functions import scalars
from driftwise.plans import problems
from driftwise.plans.audit import QUERIES
from driftwise.session import cut, scratch, shared_folder, small
from driftwise.sinks.files import manifest, quarantine, upsert, write_cache, write_csv
from driftwise.sources.pages import etag_page, first_seen, is_live_document, keyset_page, parse_pages, read_cache, with_prefix
from driftwise.sources.tables import table
from driftwise.streaming.deliveries import DeliveryStore
from driftwise.streaming.feeds import append_feed, live_versions, read_feed


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_pages_are_parsed_tolerantly(spark):
    page = {"Results": [{"Id": "users/1", "Etag": 5, "Type": "Document"}, {"Id": "users/2", "Etag": " 6 ", "Flags": "x", "More": 1}, {"Id": "users/3", "Etag": "n/a"}, {"Id": " ", "Etag": 7}, {"Etag": 8}, {}]}
    df = spark.createDataFrame([(1, json.dumps(page)), (2, "no json"), (3, None), (4, "{}"), (5, '{"Results": []}')], "page int, body string")
    got = parse_pages(df, F.col("body")).select("page", "position", "id", "etag", "item_type", "flags", "change_vector")
    assert rows(got) == [(1, 0, "users/1", 5, "Document", None, None), (1, 1, "users/2", 6, None, "x", None)]


def test_live_documents(spark):
    cases = [("Document", None, True), ("document", "A, B", True), ("Document", "conflicted", False), ("Document", "X , DELETEREVISION", False), ("Document", "NotConflicted", True), ("Tombstone", None, False), (None, None, False)]
    df = spark.createDataFrame(cases, "t string, f string, want boolean")
    assert df.where(is_live_document(F.col("t"), F.col("f")) != F.col("want")).count() == 0


def test_cache_round_trip(spark, tmp_path):
    at = datetime.datetime(2026, 1, 2, 3, 4, 5, 678901)
    data = [(f"id/{i}", None if i % 5 == 0 else f"A:{i}-x", "C" if i % 2 else None, at if i % 3 else None) for i in range(50)]
    df = spark.createDataFrame(data, "id string, cv string, c string, lm timestamp_ntz")
    write_cache(df.coalesce(1), f"{tmp_path}/cache", rows_a_segment=20)
    back = read_cache(spark, f"{tmp_path}/cache")
    assert rows(back.drop("segment")) == sorted(data, key=repr)
    parts = manifest(back)
    assert sorted(r["n_rows"] for r in parts.collect()) == [10, 20, 20]
    first = min(r["segment"] for r in parts.collect())
    assert rows(read_cache(spark, f"{tmp_path}/cache", after=first)) == rows(back.where(F.col("segment") != first)) and back.where(F.col("segment") == first).count() == 20
    assert [r["id"] for r in keyset_page(back, "id/48", 2).collect()] == ["id/49", "id/5"] and len(keyset_page(back, None, 7).collect()) == 7


def test_csv_is_quoted_and_rotated(spark, tmp_path):
    data = [("a", 'say "hi"'), ("b", "one,two"), ("c", "two\nlines"), ("d", None)]
    write_csv(spark.createDataFrame(data, "id string, t string").coalesce(1), f"{tmp_path}/csv", rows_a_file=3)
    files = sorted(tmp_path.joinpath("csv").glob("*.csv"))
    read = [r for f in files for r in list(csv.reader(f.open(newline="")))[1:]]
    assert len(files) == 2 and sorted(map(tuple, read)) == [(a, b or "") for a, b in data]


def test_quarantine_and_upsert(spark):
    df = spark.createDataFrame([("users/1", 1), ("a\\b", 2), ("c\x01", 3), (None, 4)], "id string, n int")
    safe, unsafe = quarantine(df, "id")
    assert rows(safe) == [("users/1", 1)] and {r["n"]: r["reason"] for r in unsafe.collect()} == {2: "ContainsBackslash", 3: "ContainsControlCharacter", 4: "Missing"}
    changed = spark.createDataFrame([(10, None), (11, "new")], "n int, id string")
    assert rows(upsert(df, changed, ["id"])) == sorted([("users/1", 1), ("a\\b", 2), ("c\x01", 3), (None, 10), ("new", 11)], key=repr)


def test_scalars(spark):
    t = datetime.datetime(2026, 1, 1)
    df = spark.createDataFrame([(0.0,), (-5.0,), (59.9,), (3661.0,), (360000.0,)], "s double")
    assert [r[0] for r in df.select(scalars.duration_text(F.col("s"))).collect()] == ["00:00:00", "00:00:00", "00:00:59", "01:01:01", "100:00:00"]
    fails = spark.range(1, 5).select(scalars.backoff_seconds(F.col("id")))
    assert [r[0] for r in fails.collect()] == [30, 60, 60, 60]
    when = spark.createDataFrame([(t, t + datetime.timedelta(hours=30)), (None, t)], "a timestamp_ntz, b timestamp_ntz")
    assert [r[0] for r in when.select(scalars.age_text(F.col("a"), F.col("b"))).collect()] == ["30:00:00", "never"]
    assert [r[0] for r in when.select(scalars.parse_iso(scalars.iso_text(F.col("a")))).collect()] == [t, None]
    iso = spark.createDataFrame([("2026-01-01T02:00:00+02:00",), ("2026-01-01T00:00:00.0000000Z",), ("2026-01-01 00:00:00",), ("yesterday",)], "t string")
    assert [r[0] for r in iso.select(scalars.parse_iso(F.col("t"))).collect()] == [t, t, t, None]
    made = spark.createDataFrame([("http://n//", 7, t)], "u string, n int, t timestamp_ntz").select(scalars.base_url(F.col("u")), scalars.file_name(F.col("u")), scalars.numbered("seg-", F.col("n"), 6, ".gz"), scalars.thousands(F.col("n") * 1000), scalars.run_id(F.col("t")))
    assert tuple(made.first()) == ("http://n", "http___n__", "seg-000007.gz", "7,000", "runs/20260101-0000000000000")
    text = spark.createDataFrame([("plain",), ('a"b',), (None,), ("",), ("  ",)], "t string")
    assert [r[0] for r in text.select(scalars.csv_field(F.col("t"))).collect()] == ["plain", '"a""b"', "", "", "  "]
    assert [r[0] for r in text.select(scalars.touch_statement(F.col("t"))).collect()][1:] == ['from "a""b" where id() in ($ids) update { put(id(this), this); }', None, None, None]


def feed_files(spark, folder, path, n=4):
    items = table(spark, folder, "iteration_items").withColumn("part", F.ntile(n).over(__import__("pyspark").sql.Window.orderBy("feed_seq")))
    for i in range(1, n + 1):
        items.where(F.col("part") == i).drop("part").coalesce(1).write.mode("append").parquet(path)
    return items.drop("part")


def test_stream_gives_each_version_once_over_batches(spark, folder, tmp_path):
    items = feed_files(spark, folder, f"{tmp_path}/feed")
    stream = live_versions(read_feed(spark, f"{tmp_path}/feed", items.schema)).select("node_url", "document_key", "version")
    stream.writeStream.format("memory").queryName("seen").outputMode("append").option("checkpointLocation", f"{tmp_path}/at").trigger(availableNow=True).start().awaitTermination()
    assert rows(spark.table("seen")) == rows(live_versions(items).select("node_url", "document_key", "version"))


def test_stream_of_changes_ends_in_the_state_of_the_whole_feed(spark, folder, tmp_path):
    items = feed_files(spark, folder, f"{tmp_path}/feed")
    target = problems.feed_table(spark, scratch(spark, "state"))
    append_feed(read_feed(spark, f"{tmp_path}/feed", items.schema), target, problems.feed_entries, f"{tmp_path}/at").awaitTermination()
    assert rows(target.read()) == rows(problems.p3_found(spark, folder))
    # what is appended again changes nothing
    target.append("again", problems.feed_entries(items))
    assert rows(target.read()) == rows(problems.p3_found(spark, folder))


def test_first_seen_takes_the_least_etag(spark):
    df = spark.createDataFrame([("n", 1, "a", 5, 1), ("n", 1, "A", 4, 2), ("n", 1, "a", 4, 3), ("n", 2, "a", 9, 4)], "node_url string, page_no int, id string, etag long, feed_seq long")
    assert [r["feed_seq"] for r in etag_page(df, 5, 9).collect()] == [1, 4] and [r["feed_seq"] for r in etag_page(df, 0, 2).collect()] == [2, 3]
    assert with_prefix(df, "id", "A").count() == 1
    assert rows(first_seen(df)) == [("n", 1, "A", 4, 2), ("n", 2, "A", 9, 4)]


def test_session_helpers(spark):
    df = spark.range(10)
    assert small(df, 5) is df and small(df, 10) is not df
    assert cut(df).count() == 10 and scratch(spark, "x").startswith(shared_folder(spark))


def test_streamed_query_is_repeatable(spark, folder):
    assert rows(QUERIES["stream_live_scan"](spark, folder)) == rows(QUERIES["stream_live_scan"](spark, folder))


def test_delivery_store_accepts_each_identifier_once(spark, tmp_path):
    t = lambda h: datetime.datetime(2026, 1, 1) + datetime.timedelta(hours=h)
    batches = [
        [(1, "a", t(1)), (2, "b", t(1)), (3, "A", t(2)), (4, None, t(1)), (5, "c", None)],
        [(6, "b", t(30)), (7, "d", t(30)), (8, "C", t(31)), (9, None, t(30))],
        [(10, "a", t(70)), (11, "e", t(70)), (12, "D", t(71))],
    ]
    frames = [spark.createDataFrame(b, "n long, id string, at timestamp_ntz") for b in batches]
    store = DeliveryStore(spark, f"{tmp_path}/store", frames[0].schema, "id", lambda: problems.time_bucket(F.col("at")), ["n"], least_words=4)
    for i, df in enumerate(frames):
        store.accept(str(i), df)
    want = [1, 2, 4, 5, 7, 9, 11]
    assert sorted(r["n"] for r in store.rows().collect()) == want
    store.accept("1", frames[1])  # again, as after a failure
    store.accept("3", frames[0].where("id is not null"))
    store.accept("4", frames[0].limit(0))
    assert sorted(r["n"] for r in store.rows().collect()) == want
