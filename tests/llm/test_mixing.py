from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from driftwise.llm.mixing import ALL, mix, mix_rates, mix_shares

TARGETS = [("big", 0.5, 1), ("small", 0.3, 4), ("gone", 0.1, 2), ("never", 0.1, 0), (None, 0.2, 1)]


@pytest.fixture
def records(spark):
    big = spark.range(20000).select(F.col("id"), F.lit("big").alias("source"), (F.col("id") % 7 + 1).alias("size"))
    small = spark.range(20000, 22000).select(F.col("id"), F.lit("small").alias("source"), (F.col("id") % 5 + 1).alias("size"))
    other = spark.createDataFrame([(30000, None, 5), (30001, "unwanted", 5), (30002, "small", None)], "id long, source string, size long")
    return big.unionAll(small).unionAll(other).withColumn("rate", F.lit("clash"))


@pytest.fixture
def targets(spark):
    return spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int")


def test_shares_are_met_as_far_as_sources_go(records, targets):
    got = {r["source"]: r for r in mix_shares(records, "id", "source", "size", targets, seed=3).collect()}
    assert set(got) == {"big", "small", "gone", "never"}
    assert got["gone"]["rate"] == got["never"]["rate"] == 0
    assert got["small"]["rate"] == 4  # its cap binds, and decides the size of the mix
    assert abs(got["big"]["actual_share"] - 0.5 / 0.8) < 0.02 and abs(got["small"]["actual_share"] - 0.3 / 0.8) < 0.02


def test_no_record_is_used_too_often_and_the_draw_repeats(records, targets):
    first = mix(records, "id", "source", "size", targets, seed=3)
    most = {r["source"]: r["n"] for r in first.groupBy("source").agg(F.max("copy").alias("n")).collect()}
    assert most == {"big": 1, "small": 4}
    again = mix(records.repartition(7), "id", "source", "size", targets, seed=3)
    assert first.exceptAll(again).count() == again.exceptAll(first).count() == 0
    assert first.groupBy("id", "copy").count().where("count > 1").count() == 0


def test_wanted_total(records, targets):
    rates = {r["source"]: r["rate"] for r in mix_rates(records, "source", "size", targets, total=16000).collect()}
    tokens = {r["source"]: r["n"] for r in records.groupBy("source").agg(F.sum("size").alias("n")).collect()}
    assert rates["big"] == pytest.approx(16000 * 0.5 / 0.8 / tokens["big"]) and rates["small"] == pytest.approx(16000 * 0.3 / 0.8 / tokens["small"])


def test_all_tokens_wanted(records, targets):
    got = {r["source"]: r for r in mix_shares(records, "id", "source", "size", targets, seed=3, total=ALL).collect()}
    held = got["big"]["n_tokens"] + got["small"]["n_tokens"]
    assert got["big"]["rate"] == pytest.approx(min(1, held * 0.5 / 0.8 / got["big"]["n_tokens"]))
    assert got["small"]["rate"] == pytest.approx(min(4, held * 0.3 / 0.8 / got["small"]["n_tokens"]))
    assert got["small"]["actual_share"] < 0.3 / 0.8  # its cap binds, and it falls short
    copies = mix(records, "id", "source", "size", targets, seed=3, total=ALL).where("source = 'small'").groupBy("id").count()
    assert copies.agg({"count": "max"}).first()[0] == 4


def test_only_whole_repeats_of_a_cap_count(spark, records):
    targets = spark.createDataFrame([("big", 0.5, 1.0), ("small", 0.5, 2.5)], "source string, target_share double, max_repeats double")
    copies = mix(records, "id", "source", "size", targets, seed=3, total=ALL).where("source = 'small'").groupBy("id").count()
    assert copies.agg({"count": "max"}).first()[0] == 2


def test_empty(spark, records, targets):
    assert mix(records.limit(0), "id", "source", "size", targets).count() == 0
    assert mix(records, "id", "source", "size", targets.limit(0)).count() == 0
    assert [r["actual_share"] for r in mix_shares(records.limit(0), "id", "source", "size", targets).collect()] == [None] * 4


def test_null_ids_are_drawn_too(spark, targets):
    df = spark.createDataFrame([(None, "small", 5), (1, "small", 5)], "id long, source string, size long")
    got = mix(df, "id", "source", "size", targets)
    assert sorted(r["copy"] for r in got.where("id is null").collect()) == [1, 2, 3, 4]
