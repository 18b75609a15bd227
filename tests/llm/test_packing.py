from __future__ import annotations

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from driftwise.llm.packing import pack, plan_containers


def expand(histogram, capacity):
    """Containers as lists of (offset, length), each item of the histogram placed once."""
    seen, containers = {length: set() for length, _ in histogram}, {}
    for length, first, last, container, each, fill in plan_containers(histogram, capacity):
        for rank in range(first, last + 1):
            assert rank not in seen[length]
            seen[length].add(rank)
            i = rank - first
            containers.setdefault(container + i // each, []).append((fill + i % each * length, length))
    for length, count in histogram:
        assert seen[length] == set(range(count))
    return containers


def best_fit(histogram, capacity):
    """The same rule, item by item."""
    gaps = []
    for length, count in sorted(histogram, reverse=True):
        for _ in range(count):
            fits = [g for g in gaps if g >= length]
            gaps.remove(min(fits)) if fits else None
            gaps.append((min(fits) if fits else capacity) - length)
    return sorted(gaps)


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 60), max_size=12), st.integers(40, 60))
def test_plan_is_best_fit_item_by_item(histogram, capacity):
    containers = expand(list(histogram.items()), capacity)
    for items in containers.values():
        at = 0
        for offset, length in sorted(items):  # one after the other, without holes
            assert offset == at
            at += length
        assert at <= capacity
    assert sorted(capacity - sum(n for _, n in items) for items in containers.values()) == best_fit(histogram.items(), capacity)


def test_plan_stays_small():
    random.seed(1)
    histogram = [(n, random.randrange(1, 10**7)) for n in range(1, 2049)]
    steps = plan_containers(histogram, 2048)
    used = sum(n * c for n, c in histogram)
    made = max(first + -(-(last - rank + 1) // each) for _, rank, last, first, each, _ in steps)
    assert len(steps) < 40 * 2048
    assert made * 2048 < 1.01 * used


def rows(df):
    return [r.asDict() for r in df.collect()]


def test_pack_cuts_only_what_exceeds_the_capacity(spark):
    df = spark.createDataFrame([(1, 25), (2, 10), (3, 7), (4, 3), (5, None), (6, 0), (7, 10), (8, 3)], "doc_id long, size long").withColumn("rank", F.lit("clash"))
    got = rows(pack(df, "doc_id", "size", 10))
    assert sorted((r["doc_id"], r["first_token"], r["n_tokens"]) for r in got) == [(1, 0, 10), (1, 10, 10), (1, 20, 5), (2, 0, 10), (3, 0, 7), (4, 0, 3), (5, 0, 0), (6, 0, 0), (7, 0, 10), (8, 0, 3)]
    fill = {}
    for r in got:
        if r["n_tokens"]:
            fill[r["container_id"]] = fill.get(r["container_id"], 0) + r["n_tokens"]
        else:
            assert r["container_id"] is None
    assert sorted(fill.values()) == [8, 10, 10, 10, 10, 10]


def test_pack_of_nothing(spark):
    assert rows(pack(spark.createDataFrame([], "doc_id long, size long"), "doc_id", "size", 10)) == []
    with pytest.raises(ValueError):
        pack(spark.createDataFrame([], "doc_id long, size long"), "doc_id", "size", 0)


def test_hot_length_is_ranked_in_slices(spark, monkeypatch):
    import driftwise.llm.packing as packing
    from driftwise.operators.ranking import rank_within

    monkeypatch.setattr(packing, "rank_within", lambda *a: rank_within(*a, slice_rows=50))
    df = spark.range(1000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 700, 4).otherwise(F.col("id") % 9 + 1).alias("size"))
    got = pack(df, "doc_id", "size", 9)
    assert got.count() == 1000 and got.select("doc_id").distinct().count() == 1000
    assert got.groupBy("container_id").agg(F.sum("n_tokens").alias("n")).where("n > 9").count() == 0
    assert got.groupBy("container_id", "container_offset").count().where("count > 1").count() == 0
