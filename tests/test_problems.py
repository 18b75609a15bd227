from __future__ import annotations

import datetime
import itertools
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftwise.functions.vectors import key
from driftwise.operators.change_feed import EqualityDeleteTable, current_state
from driftwise.operators.copy_diff import assign, diff_copies, transport
from driftwise.operators.delivery_dedup import deduplicate
from driftwise.operators.eager_aggregate import aggregate_join, heavy_groups
from driftwise.operators.ranking import rank_within
from driftwise.operators.shared_flow import shared_flow
from driftwise.operators.snapshot_changes import snapshot_changes, validity_intervals
from driftwise.plans import problems
from driftwise.session import scratch


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# 1


def test_aggregate_join_is_the_aggregate_of_the_join(spark):
    random.seed(2)
    left = [(random.choice(["hot", "hot", "hot", "b", "c", None, ""]), random.choice(["g", "G", None]), random.choice([1, 2, None])) for _ in range(400)]
    right = [(random.choice(["hot", "hot", "b", "z", None]), random.choice([10, 20, None])) for _ in range(60)]
    # columns that clash with each other and with the operator's own
    l = spark.createDataFrame(left, "k string, n string, m long")  # noqa: E741
    r = spark.createDataFrame(right, "k string, m long")
    got = aggregate_join(l, r, F.col("k"), F.col("k"), {"n": F.col("n")}, left_sums={"ls": F.col("m")}, right_sums={"rs": F.col("m")})
    l.createOrReplaceTempView("l")
    r.createOrReplaceTempView("r")
    want = spark.sql("""SELECT j.n, c.n_rows, n_keys, n_joined, n_matched, ls, rs FROM
      (SELECT l.n, count(DISTINCT l.k) AS n_keys, count(*) AS n_joined, count(r.k) AS n_matched, sum(l.m) AS ls, sum(r.m) AS rs FROM l LEFT JOIN r ON l.k = r.k GROUP BY l.n) j
      JOIN (SELECT n, count(*) AS n_rows FROM l GROUP BY n) c ON j.n <=> c.n""")
    assert rows(got) == rows(want)
    assert rows(heavy_groups(got, l.agg(F.count("*")), 3).select("n")) == sorted(((g,) for g in ["g", "G", None] if sum(x[1] == g for x in left) * 3 >= 400), key=repr)


def test_aggregate_join_of_nothing(spark):
    empty, one = spark.createDataFrame([], "k string"), spark.createDataFrame([("a",)], "k string")
    assert aggregate_join(empty, one, F.col("k"), F.col("k"), {"g": F.col("k")}).count() == 0
    assert rows(aggregate_join(one, empty, F.col("k"), F.col("k"), {"g": F.col("k")})) == [("a", 1, 1, 1, 0)]
    assert heavy_groups(aggregate_join(empty, one, F.col("k"), F.col("k"), {"g": F.col("k")}), empty.agg(F.count("*")), 20).count() == 0


# 2


def test_assignment_is_of_minimum_cost():
    rng = np.random.default_rng(3)
    for n, m in itertools.product(range(1, 5), range(1, 6)):
        if n > m:
            continue
        for _ in range(20):
            cost = rng.integers(0, 4, (n, m)).astype(float)
            to = assign(cost)
            assert len(set(to)) == n
            assert cost[range(n), to].sum() == min(sum(cost[i, p[i]] for i in range(n)) for p in itertools.permutations(range(m), n))


def diffs(spark, left, right, **more):
    df = spark.createDataFrame([(*r, True) for r in left] + [(*r, False) for r in right] + [("x", "x", "x", "x", None)], "k string, a string, b string, c string, here boolean").withColumn("side", F.lit("clash")).withColumn("f0", F.lit(1))
    return diff_copies(df, "k", ["a", "b", "c"], F.col("here"), **more)


def least_cost(left, right):
    """Brute force over all pairings of the rows of one key."""
    if len(left) > len(right):
        left, right = right, left
    return min(sum(sum(x != y for x, y in zip(a[1:], right[j][1:])) for a, j in zip(left, p)) for p in itertools.permutations(range(len(right)), len(left)))


def test_identical_rows_cancel_and_fields_are_told(spark):
    left = [("1", "a", "b", None), ("2", "a", "b", "c"), ("2", "a", "b", "c"), ("3", "x", None, ""), (None, "n", "n", "n")]
    right = [("1", "a", "b", None), ("2", "a", "b", "c"), ("3", "x", "y", None), ("4", "q", "q", "q"), (None, "n", "n", "m")]
    got = rows(diffs(spark, left, right).select("k", "side", F.array_join("differing", ","), "n_left", "n_right"))
    assert got == sorted([("2", "left", None, 2, 1), ("3", "both", "b,c", 1, 1), ("4", "right", None, 0, 1), (None, "both", "c", 1, 1)], key=repr)


@pytest.mark.parametrize("seed", range(3))
def test_pairs_of_repeated_keys_cost_least(spark, seed):
    random.seed(seed)
    sides = [[(str(random.randrange(6)), *(random.choice("pqr") for _ in range(3))) for _ in range(26)] for _ in range(2)]
    got = diffs(spark, *sides).collect()
    for k in {r[0] for r in sides[0] + sides[1]}:
        left, right = ([r for r in s if r[0] == k] for s in sides)
        for r in list(left):
            if r in right:
                left.remove(r)
                right.remove(r)
        mine = [g for g in got if g["k"] == k]
        both = [g for g in mine if g["side"] == "both"]
        assert len(both) == min(len(left), len(right)) and len(mine) == max(len(left), len(right))
        assert sum(len(g["differing"]) for g in both) == (least_cost(left, right) if left and right else 0)
        assert sorted(tuple(g["l"]) for g in mine if g["l"]) == sorted(r[1:] for r in left)
        assert sorted(tuple(g["r"]) for g in mine if g["r"]) == sorted(r[1:] for r in right)


def test_transport_is_of_minimum_cost():
    rng = np.random.default_rng(5)
    for _ in range(60):
        supply, demand = rng.integers(1, 4, rng.integers(1, 5)), rng.integers(1, 4, rng.integers(1, 5))
        cost = rng.integers(0, 4, (len(supply), len(demand))).astype(float)
        flow = transport(supply, demand, cost)
        units = np.repeat(np.repeat(cost, supply, axis=0), demand, axis=1)
        units = units if units.shape[0] <= units.shape[1] else units.T
        assert flow.min() >= 0 and (flow.sum(axis=1) <= supply).all() and (flow.sum(axis=0) <= demand).all() and flow.sum() == min(supply.sum(), demand.sum())
        assert (flow * cost).sum() == units[range(len(units)), assign(units)].sum()


@pytest.mark.parametrize("seed", range(3))
def test_classes_cost_as_little_as_rows(spark, seed):
    random.seed(seed)
    sides = [[("hot", random.choice("pqr"), random.choice(["x", "y", f"{side}{random.randrange(99)}"]), f"{side}{i}" if i % 4 else "z") for i in range(40 + 9 * side)] for side in (0, 1)]
    fine = lambda **more: diffs(spark, *sides, **more).collect()
    by_rows, by_classes = fine(), fine(exact_rows=10)
    assert {g["pairing"] for g in by_classes} == {"exact"}
    for got in (by_rows, by_classes):
        got.sort(key=lambda g: g["side"])
    assert [g["side"] for g in by_rows] == [g["side"] for g in by_classes]
    assert sum(len(g["differing"]) for g in by_rows if g["side"] == "both") == sum(len(g["differing"]) for g in by_classes if g["side"] == "both")
    for side in "lr":
        assert sorted(tuple(g[side]) for g in by_rows if g[side]) == sorted(tuple(g[side]) for g in by_classes if g[side])


def test_a_hot_key_is_paired_whole_in_stages(spark):
    left = [("hot", str(i % 7), str(i), "same") for i in range(60)]
    right = [("hot", str(i % 7), str(i + 30), "same") for i in range(50)] + [("cold", "a", "b", "c")]
    got = diffs(spark, left, right, exact_rows=10, exact_classes=5).collect()
    hot = [g for g in got if g["k"] == "hot"]
    assert {g["pairing"] for g in hot} == {"staged"} and [g["pairing"] for g in got if g["k"] == "cold"] == ["exact"]
    shared = {r[1:] for r in left} & {r[1:] for r in right}
    assert sum(g["side"] == "both" for g in hot) == 50 - len(shared) and sum(g["side"] == "left" for g in hot) == 10
    assert sorted(tuple(g["l"]) for g in hot if g["l"]) == sorted(r[1:] for r in left if r[1:] not in shared)
    assert sorted(tuple(g["r"]) for g in hot if g["r"]) == sorted(r[1:] for r in right if r[0] == "hot" and r[1:] not in shared)


@pytest.mark.parametrize(("classes", "pairing"), [(1000, "exact"), (5, "exact"), (1, "staged")])
def test_hot_keys_of_close_times_stay_whole(spark, classes, pairing):
    # keys and fields that only differ below the millisecond; classes of one b are a component
    at = lambda us: datetime.datetime(2026, 1, 1, 0, 0, 0, us)
    data = [(at(k), at(100 + 2 * i + side), f"{i % 7}", not side) for k in (1, 2) for side, n in ((0, 40 + k), (1, 30)) for i in range(n)]
    df = spark.createDataFrame([*data, *data[-3:]], "k timestamp, at timestamp, b string, here boolean")
    got = diff_copies(df, "k", ["at", "b"], F.col("here"), exact_rows=10, exact_classes=classes).collect()
    assert {g["pairing"] for g in got} == {pairing}
    for k in (1, 2):
        mine = [g for g in got if g["k"] == at(k)]
        assert sum(g["side"] == "both" for g in mine) == (30 if k == 1 else 33)
        for side, here in (("l", True), ("r", False)):
            assert sorted(tuple(g[side]) for g in mine if g[side]) == sorted(r[1:3] for r in [*data, *data[-3:]] if r[0] == at(k) and r[3] == here)


@pytest.mark.parametrize("seed", range(1))
def test_components_cost_as_little_as_rows(spark, seed):
    random.seed(seed)
    # a is the same in all rows, b and c are shared by few
    sides = [[("hot", "same", f"b{random.randrange(40)}", random.choice([f"c{random.randrange(60)}", f"{side}{i}", None])) for i in range(60 + 9 * side)] for side in (0, 1)]
    by_rows, by_parts = (diffs(spark, *sides, **more).collect() for more in ({}, {"exact_rows": 10, "exact_classes": 100}))
    single = diffs(spark, *sides, exact_rows=10, exact_classes=10).collect()
    assert {g["pairing"] for g in by_parts} == {"exact"}
    cost = lambda got: sum(len(g["differing"]) for g in got if g["side"] == "both")
    assert cost(by_rows) == cost(by_parts) <= cost(single)
    for got in (by_parts, single):
        assert sorted(g["side"] for g in by_rows) == sorted(g["side"] for g in got)
        for side in "lr":
            assert sorted((tuple(g[side]) for g in by_rows if g[side]), key=repr) == sorted((tuple(g[side]) for g in got if g[side]), key=repr)


@pytest.mark.parametrize("seed", range(2))
def test_a_component_of_any_size_costs_as_little_as_rows(spark, seed):
    # few values, so that all rows are one component in which they compete for partners
    random.seed(seed)
    sides = [[("hot", *(f"{random.randrange(12)}" for _ in range(3))) for _ in range(90 + 20 * side)] for side in (0, 1)]
    by_rows, by_parts = (diffs(spark, *sides, **more).collect() for more in ({"exact_rows": 5000}, {"exact_rows": 10, "exact_classes": 10}))
    assert {g["pairing"] for g in by_parts} == {"staged"}
    assert len({sum(len(g["differing"]) for g in got if g["side"] == "both") for got in (by_rows, by_parts)}) == 1
    assert sorted(g["side"] for g in by_rows) == sorted(g["side"] for g in by_parts)
    for side in "lr":
        assert sorted(tuple(g[side]) for g in by_rows if g[side]) == sorted(tuple(g[side]) for g in by_parts if g[side])


def test_flow_through_shared_values_agrees_as_much_as_there_can_be():
    rng = np.random.default_rng(7)
    for _ in range(100):
        d, a, b, kinds = rng.integers(1, 6), *rng.integers(1, 12, 2), rng.integers(2, 8)
        values, amount, is_left = rng.integers(0, kinds, (a + b, d)), rng.integers(1, 4, a + b), np.arange(a + b) < a
        cost = (values[:a, None, :] != values[None, a:, :]).sum(axis=2).astype(float)
        least = (transport(amount[:a], amount[a:], cost) * cost).sum()
        left, right, n = shared_flow(values, is_left, amount)
        assert (np.bincount(left, n, a + b) <= amount * is_left).all() and (np.bincount(right, n, a + b) <= amount * ~is_left).all()
        # what doesn't flow agrees only in what all rows do
        rest = min(amount[:a].sum(), amount[a:].sum()) - n.sum()
        assert (n * cost[left, right - a]).sum() + rest * (values != values[0]).any(axis=0).sum() == least


def test_small_components_of_a_hot_key_are_exact(spark):
    # 200 components of a few classes each, and more of one side than of the other
    left = [("hot", "same", f"b{i % 200}", f"c{i % 200}" if i % 3 else f"l{i}") for i in range(500)]
    right = [("hot", "same", f"b{i % 200}", f"c{(i + 200) % 400}") for i in range(420)]
    by_rows, by_parts = (diffs(spark, left, right, **more).collect() for more in ({"exact_rows": 5000}, {"exact_rows": 10, "exact_classes": 12}))
    assert {g["pairing"] for g in by_parts} == {"exact"}
    assert [sum(len(g["differing"]) for g in got if g["side"] == "both") for got in (by_rows, by_parts)][0] == sum(len(g["differing"]) for g in by_parts if g["side"] == "both")
    assert sorted(g["side"] for g in by_rows) == sorted(g["side"] for g in by_parts)


@pytest.mark.parametrize("limits", [{"exact_rows": 5, "exact_classes": 1000}, {"exact_rows": 5, "exact_classes": 5}])
def test_wide_hot_keys_with_odd_types_stay_whole(spark, limits):
    random.seed(3)
    names = [f"x{i}" for i in range(12)]
    made = lambda side: [(b"k\xff", datetime.datetime(2026, 1, 1, 0, 0, 0, random.randrange(9)), random.choice([None, b"\xff", b"\xfe"]), *(random.choice(["p", "q", None]) for _ in range(10)), side) for _ in range(30 + 10 * side)]
    data = [*made(True), *made(False)]
    df = spark.createDataFrame(data, "k binary, x0 timestamp_ntz, x1 binary, " + ", ".join(f"x{i} string" for i in range(2, 12)) + ", here boolean")
    got = diff_copies(df, "k", names, F.col("here"), **limits).collect()
    plain = lambda r: tuple(bytes(x) if isinstance(x, bytearray) else x for x in r)
    for side, here in (("l", True), ("r", False)):
        mine, other = ([plain(r[1:13]) for r in data if r[13] == h] for h in (here, not here))
        assert sorted((plain(g[side]) for g in got if g[side]), key=repr) == sorted(list((Counter(mine) - Counter(other)).elements()), key=repr)
    assert sum(g["side"] == "both" for g in got) == min(sum(g["l"] is not None for g in got), sum(g["r"] is not None for g in got))


def test_copies_of_nothing(spark):
    assert diffs(spark, [], []).count() == 0


# 3


def apply_in_order(entries):
    state = {}
    for k, seq, is_put, value in sorted(entries, key=lambda e: (e[1], e[2])):
        if is_put:
            state[k] = (seq, value)
        else:
            state.pop(k, None)
    return state


def test_current_state_is_what_applying_in_order_gives(spark):
    random.seed(7)
    entries = [(random.choice(["a", "b", "c", None, ""]), i // 2 * 2 + 1, bool(random.randrange(2)), f"v{i}") for i in range(40)]
    entries = list({(k, q, p): (k, q, p, v) for k, q, p, v in entries}.values())
    entries = [e for e in entries if not (not e[2] and (e[0], e[1], True) in {x[:3] for x in entries})]
    random.shuffle(entries)
    df = spark.createDataFrame(entries + entries[:10] + [("late", None, True, "no number")], "k string, seq long, put boolean, v string")
    got = current_state(df.where("put"), df.where("not put"), ["k"], "seq", ["v"])
    assert rows(got) == sorted(((k, q, v) for k, (q, v) in apply_in_order(entries).items()), key=repr)
    assert current_state(df.limit(0), df.where("not put"), ["k"], "seq").count() == 0
    assert current_state(df.where("put"), df.limit(0), ["k"], "seq").count() == df.where("put and seq is not null").select("k").distinct().count()


def test_equality_delete_table_takes_batches_in_any_order(spark):
    entries = [("a", 5, "put", "x"), ("a", 7, "delete", None), ("a", 9, "put", "y"), ("b", 3, "put", "z"), ("b", 4, "delete", None), ("c", 1, "put", "w"), ("c", 8, "other", "")]
    df = spark.createDataFrame(entries, "k string, seq long, kind string, v string")
    table = EqualityDeleteTable(spark, scratch(spark, "t"), "k string", "seq", "v string")
    for name in ["2", "0", "1", "1"]:
        table.append(name, df.where(F.col("seq") % 3 == int(name)))
    table.append("none", df.limit(0))
    want = [("a", 9, "y"), ("c", 1, "w")]
    assert rows(table.read()) == want
    small = table.compact(scratch(spark, "t"))
    assert rows(small.read()) == want and small.entries("put").count() == 2
    # a put that arrives after the compaction and is older than the delete stays without effect
    small.append("late", spark.createDataFrame([("b", 2, "put", "old")], "k string, seq long, kind string, v string"))
    assert rows(small.read()) == want


def test_feed_effects(spark):
    from driftwise.plans.problems import feed_effect

    cases = {("Document", None): "put", ("document", "HasRevisions , x"): "put", ("Document", "Conflicted"): None, ("Document", "DeleteRevision"): "delete", ("DOCUMENT", "a, deleterevision"): "delete", ("Document", "NotConflicted,SkipDeleteRevision"): "put",
             ("Document", "Conflicted, DeleteRevision"): None, ("Tombstone", "Conflicted"): "delete", ("tombstone", None): "delete", ("Counter", None): None, (" Document ", ""): "put", (None, None): None}
    df = spark.createDataFrame([(*k,) for k in cases], "t string, f string")
    assert {(r[0], r[1]): r[2] for r in df.select("t", "f", feed_effect(F.col("t"), F.col("f"))).collect()} == cases


# 4


def test_exactly_one_row_of_each_identifier(spark):
    random.seed(4)
    data = [(i, random.choice(["hot", "HOT"] if i % 3 == 0 else [f"id{random.randrange(300)}"]), random.choice([None, 1, 2, 3]), i % 5 or None) for i in range(900)]
    data += [(900 + i, None, 1, 1) for i in range(3)] + data[:5]
    df = spark.createDataFrame(data, "n long, id string, at long, b int").withColumn("key", F.lit("clash")).withColumn("bucket", F.lit(0))
    got = rows(deduplicate(df, "id", F.col("b"), [F.col("at"), -F.col("n")], ["n", "id"]))
    best = {}
    for n, i, at, _ in data:
        if i is not None and (i.upper() not in best or (at or 0, -n) > best[i.upper()][:2]):
            best[i.upper()] = (at or 0, -n, n, i)
    assert got == sorted([(n, i) for _, _, n, i in best.values()] + [(900, None), (901, None), (902, None)], key=repr)
    assert deduplicate(df.limit(0), "id", F.col("b"), [F.col("at")], ["n"]).count() == 0


@pytest.mark.parametrize("buckets", [4, 32, 365])
def test_screening_holds_for_any_number_of_buckets(spark, buckets):
    from driftwise.operators.delivery_dedup import screen, word_count

    ids = spark.range(40000).select((F.col("id") % buckets).cast("int").alias("bucket"), F.col("id").cast("string").alias("key"))
    assert screen(ids, word_count(ids)).where("possible").count() < 40000 * 0.01
    # every eighth key is in a second bucket too, the null one: no repeat may be taken for new
    again = ids.where("key % 8 = 0").select(F.lit(None).cast("int").alias("bucket"), "key")
    both = ids.unionByName(again)
    flagged = screen(both, word_count(both)).where("possible").groupBy("key").count()
    assert flagged.where("key % 8 = 0 and count = 2").count() == 5000
    assert flagged.where("key % 8 <> 0").count() < 40000 * 0.01


def test_a_delivery_store_grows_its_filters(spark, tmp_path):
    from driftwise.streaming.deliveries import DeliveryStore

    store = DeliveryStore(spark, f"{tmp_path}/store", spark.createDataFrame([], "n long, id string").schema, "id", lambda: (F.col("n") % 7).cast("int"), ["n"], least_words=4)
    for i in range(4):  # each batch holds half of the one before again
        store.accept(str(i), spark.range(i * 100, i * 100 + 200).select(F.col("id").alias("n"), F.col("id").cast("string").alias("id")))
    assert sorted(r["n"] for r in store.rows().collect()) == list(range(500))
    assert [w for w in (4, 16, 64, 256, 1024) if store._exists(f"filters-{w}/_made")] == [64, 256]


# 5

SNAPSHOT = "run string, node string, id string, v string, at long, n long"


def test_changes_are_those_of_neighbours(spark):
    random.seed(6)
    data, n = [], 0
    for node, run in itertools.product("AB", ["r1", "r2", "r3", "r5"]):
        for i in range(12):
            for _ in range(random.choice([0, 1, 1, 2])):
                n += 1
                data.append((run, node, random.choice([f"id{i}", f"ID{i}"]), random.choice(["x", "x", "y", None]), random.choice([None, 1, 2]), n))
    data += [("r4", "A", None, "x", 1, 999)]  # a snapshot of A that holds nothing but a row without id
    df = spark.createDataFrame(data, SNAPSHOT).withColumn("key", F.lit("clash"))
    held = {}
    for run, node, i, v, at, m in data:
        state = held.setdefault((node, run), {})
        if i and (i.upper() not in state or (at or 0, -m) > state[i.upper()][0]):
            state[i.upper()] = ((at or 0, -m), (v, at))
    want = []
    for node, runs in (("A", ["r1", "r2", "r3", "r4", "r5"]), ("B", ["r1", "r2", "r3", "r5"])):
        for before, after in itertools.pairwise(runs):
            b, a = held[node, before], held[node, after]
            want += [(node, after, k, "added") for k in a.keys() - b.keys()] + [(node, after, k, "removed") for k in b.keys() - a.keys()] + [(node, after, k, "changed") for k in a.keys() & b.keys() if a[k][1] != b[k][1]]
    terms = {"owner": F.col("node"), "snapshot": F.col("run"), "key": key(F.col("id")), "content": [F.col("v"), F.col("at")], "rank": [F.col("at"), -F.col("n")]}
    assert rows(snapshot_changes(df, **terms)) == sorted(want, key=repr)
    spans = validity_intervals(df, **terms)
    assert spans.agg(F.sum(F.col("last") - F.col("first") + 1)).first()[0] == sum(map(len, held.values()))
    assert snapshot_changes(df.limit(0), **terms).count() == 0


def test_content_tells_nulls_from_text(spark):
    data = [("r1", "A", "1", None, 1, 1), ("r2", "A", "1", "", 1, 2), ("r3", "A", "1", "-", 1, 3), ("r4", "A", "1", "-", 1, 4)]
    terms = {"owner": F.col("node"), "snapshot": F.col("run"), "key": F.col("id"), "content": [F.col("v"), F.col("at")], "rank": [F.col("at")]}
    assert [r[1] for r in rows(snapshot_changes(spark.createDataFrame(data, SNAPSHOT), **terms))] == ["r2", "r3"]


# what they share


def test_ranks_are_positions_even_in_slices(spark):
    df = spark.range(1000).select("id", F.when(F.col("id") < 600, "hot").when(F.col("id") < 900, F.lit(None)).otherwise(F.col("id").cast("string")).alias("g"))
    got = rank_within(df, ["g"], ["id"], df.groupBy("g").agg(F.count("*").alias("n")), slice_rows=64)
    assert set(got.columns) == {"id", "g", "rank"} and got.count() == 1000
    for g, n in (("hot", 600), (None, 300), ("950", 1)):
        assert sorted(r["rank"] for r in got.where(F.col("g").eqNullSafe(F.lit(g))).collect()) == list(range(n))


def test_queries_of_empty_tables(spark, folder, tmp_path):
    for name in ("mismatches", "node_document_snapshots", "iteration_items", "snapshot_cache_rows"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    for name, f in problems.QUERIES.items():
        assert f(spark, str(tmp_path)).count() == 0, name


def test_time_buckets(spark):
    df = spark.createDataFrame([(datetime.datetime(2026, 1, 1, 11, 59),), (datetime.datetime(2026, 1, 1, 12),), (None,)], "t timestamp_ntz")
    a, b, c = (r[0] for r in df.select(problems.time_bucket(F.col("t"))).collect())
    assert b == a + 1 and c is None
