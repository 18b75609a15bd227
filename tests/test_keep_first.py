from __future__ import annotations

import os

import duckdb
from pyspark.sql import functions as F

from driftwise.plans.recovery import BACKLOG_STEPS, QUERIES, SQL
from driftwise.session import scratch
from driftwise.streaming.deliveries import DeliveryStore
from driftwise.streaming.feeds import keep_first, once_a_run, read_feed

BATCHES = [
    [("r1", "a", 5, "later"), ("r1", "A", 3, "first"), ("r1", "b", 4, "first"), ("r2", "a", 9, "other run")],
    [("r1", "a", 7, "new vector"), ("R1", "a", 8, "other case of run"), ("r1", "c", 6, "first"), ("r1", None, 1, "no id")],
]


def test_a_document_seen_again_in_a_run_keeps_its_first_verdict(spark, tmp_path):
    source = f"{tmp_path}/feed"
    for number, batch in enumerate(BATCHES):
        spark.createDataFrame(batch, "run_id string, id string, etag long, verdict string").coalesce(1).write.mode("append").parquet(source)
        for name in os.listdir(source):
            if name.endswith(".parquet") and not name.startswith("0"):
                os.rename(f"{source}/{name}", f"{source}/0{number}.parquet")
                os.utime(f"{source}/0{number}.parquet", (1_700_000_000 + number * 100,) * 2)
    feed = read_feed(spark, source, "run_id string, id string, etag long, verdict string").withColumn("guard", once_a_run(F.col("run_id"), F.col("id")))
    store = DeliveryStore(spark, scratch(spark, "guards"), feed.schema, "guard", lambda: F.lit(0), ["etag"], least_words=64)
    keep_first(feed, store, f"{tmp_path}/cursor").awaitTermination()
    got = sorted(tuple(r) for r in store.rows().select("run_id", F.coalesce("id", F.lit("")), "verdict").collect())
    assert got == [("R1", "a", "other case of run"), ("r1", "", "no id"), ("r1", "A", "first"), ("r1", "b", "first"), ("r1", "c", "first"), ("r2", "a", "other run")]


def test_a_backlog_of_any_number_of_batches_takes_as_many_steps(spark, tmp_path, monkeypatch):
    taken, accept = [], DeliveryStore.accept
    monkeypatch.setattr(DeliveryStore, "accept", lambda self, batch, rows: (taken.append(batch), accept(self, batch, rows)))
    schema = "feed_seq long, page_no int, node_url string, id string, etag string, item_type string, flags string, change_vector string, collection string, last_modified string"
    item = lambda seq, page, node, id, etag: (seq, page, node, id, etag, "Document", None, None, None, None)
    # a later etag on an earlier batch is first, as is an earlier etag within a batch; pages, numbers and nodes may be missing
    items = [item(n, 20 * n, "n", f"d/{n % 8}", str(100 - n)) for n in range(40)] + [
        item(50, 41, "n", "D/9", "7"), item(51, 42, "n", "d/9", "6"), item(52, None, "n", "d/9", "1"), item(53, None, "n", "d/10", "2"), item(None, None, "n", "D/10", "2"),
        item(54, 5, None, "d/11", "3"), item(55, 6, "", "d/11", "4"), item(56, -3, "n", "d/12", "5"), item(57, 3, "n", "d/12", "4"), item(58, -30, "n", "d/13", "9"), item(59, 0, "n", "d/13", "8"),
    ]
    spark.createDataFrame(items, schema).coalesce(1).write.parquet(f"{tmp_path}/iteration_items.parquet")
    got = QUERIES["first_verdicts"](spark, str(tmp_path)).collect()
    db = duckdb.connect()
    db.execute(f"CREATE VIEW iteration_items AS SELECT * FROM read_parquet('{tmp_path}/iteration_items.parquet/*.parquet')")
    assert sorted((tuple(r) for r in got), key=repr) == sorted(db.execute(SQL["first_verdicts"]).fetchall(), key=repr)
    assert len(taken) == BACKLOG_STEPS
