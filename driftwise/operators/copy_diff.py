"""Differences between two copies of a dataset whose keys may repeat.

Identical rows cancel by multiplicity. What is left of a key on either side is paired at minimum cost, the cost of a pair
being the number of its fields that differ, and rows without a partner are missing on the other side.

Skew: cancelling works on (key, all fields), so a hot key spreads over tasks, and copies of one row combine on the map side.
Leftovers of a key are gathered only if they are at most ``exact_rows``; these are paired exactly. Of a key with more,

* values that only one side has are all alike, since they agree with nothing: rows that are the same but for such values are
  a class, and classes of any number of rows are paired by a transport plan between classes, which rows join by their rank;
* the classes of a key with more than ``exact_classes`` fall into components, connected by values that they share. A field
  in which all rows of the key agree adds the same to every pair and connects nothing. Rows of different components agree in
  nothing else, so components are paired apart, each exactly, and what is left of them in any way whatever: the pairs that
  agree are the same in number and weight as those of the whole key.

A component of up to ``exact_classes`` classes is solved over a table of all pairs of its classes, a larger one over the values
that they share (:mod:`driftwise.operators.shared_flow`), in stages by what a pair gains; ``pairing`` says which way a row took.
The cost is least either way, whatever the limits are; which of equally cheap pairings is taken may differ with them.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftwise.operators.ranking import join_spread, rank_within, repeated, same
from driftwise.operators.shared_flow import shared_flow
from driftwise.session import cut

#: Leftover rows of a key, both sides together, up to which they are paired exactly in one task.
EXACT_ROWS = 256
#: Classes of leftovers of a key or of a component of it, both sides together, up to which a table of their pairs is made.
EXACT_CLASSES = 1024


def assign(cost: np.ndarray) -> np.ndarray:
    """Columns assigned to the rows of a cost matrix with no more rows than columns, at minimum total cost.

    Shortest augmenting paths with dual potentials (the Hungarian method), cubic in the number of rows."""
    n, m = cost.shape
    u, v = np.zeros(n + 1), np.zeros(m + 1)
    row_of, way = np.zeros(m + 1, dtype=int), np.zeros(m + 1, dtype=int)  # 0: none; rows and columns count from 1
    for i in range(1, n + 1):
        row_of[0], j = i, 0
        least, done = np.full(m + 1, np.inf), np.zeros(m + 1, dtype=bool)
        while row_of[j]:
            done[j] = True
            free = ~done[1:]
            slack = cost[row_of[j] - 1] - u[row_of[j]] - v[1:]
            better = free & (slack < least[1:])
            least[1:][better], way[1:][better] = slack[better], j
            j = 1 + int(np.argmin(np.where(free, least[1:], np.inf)))
            delta = least[j]
            u[row_of[done]] += delta
            v[done] -= delta
            least[~done] -= delta
        while j:
            row_of[j], j = row_of[way[j]], way[j]
    out = np.zeros(n, dtype=int)
    for j in range(1, m + 1):
        if row_of[j]:
            out[row_of[j] - 1] = j - 1
    return out


def transport(supply: np.ndarray, demand: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """How much of each supply goes to each demand, as much as can be in all, at minimum total cost.

    Successive shortest paths in the residual graph: each takes as much as fits along the cheapest way from a supply with
    something left to a demand with room, going back over flows that it redirects."""
    n, m = cost.shape
    left, room, flow = supply.astype(np.int64).copy(), demand.astype(np.int64).copy(), np.zeros((n, m), dtype=np.int64)
    while left.sum() and room.sum():
        away, reach = np.where(left > 0, 0.0, np.inf), np.full(m, np.inf)
        by, back = np.full(m, -1), np.full(n, -1)  # the supply that a demand is reached from, and the demand that a supply is
        while True:
            through = away[:, None] + cost
            best = through.argmin(axis=0)
            nearer = through[best, range(m)] < reach - 1e-9
            by[nearer], reach[nearer] = best[nearer], through[best, range(m)][nearer]
            undo = np.where(flow > 0, reach[None, :] - cost, np.inf)
            from_ = undo.argmin(axis=1)
            closer = undo[range(n), from_] < away - 1e-9
            back[closer], away[closer] = from_[closer], undo[range(n), from_][closer]
            if not closer.any():
                break
        j = int(np.where(room > 0, reach, np.inf).argmin())
        path, end = [], j
        while True:
            i = int(by[j])
            path.append((i, j, 1))
            if back[i] < 0:
                break
            j = int(back[i])
            path.append((i, j, -1))
        most = min([left[i], room[end], *(flow[a, b] for a, b, way in path if way < 0)])
        for a, b, way in path:
            flow[a, b] += way * most
        left[i] -= most
        room[end] -= most
    return flow


def _flows(left: pd.Series, right: pd.Series) -> pd.Series:
    """For each key the moves (class of left, class of right, rows). Classes: name, number of rows, hashes of fields."""
    out = []
    for a, b in zip(left, right, strict=True):
        moves = []
        if len(a) and len(b):
            x, y = (np.array([list(c["values"]) for c in s]) for s in (a, b))
            flow = transport(*(np.array([c["n"] for c in s]) for s in (a, b)), (x[:, None, :] != y[None, :, :]).sum(axis=2).astype(float))
            moves = [{"lc": a[i]["name"], "rc": b[j]["name"], "n": int(flow[i, j])} for i, j in zip(*np.nonzero(flow), strict=True)]
        out.append(moves)
    return pd.Series(out)


def _pairs(left: Sequence[tuple], right: Sequence[tuple]) -> list[tuple[int, int]]:
    """Positions of partners; -1: none. Rows are tuples of hashes of fields."""
    if not left or not right:
        return [(i, -1) for i in range(len(left))] + [(-1, j) for j in range(len(right))]
    a, b = np.array(left), np.array(right)
    cost = (a[:, None, :] != b[None, :, :]).sum(axis=2).astype(float)
    if len(a) <= len(b):
        to = assign(cost)
        rest = sorted(set(range(len(b))) - set(to.tolist()))
        return [(i, int(j)) for i, j in enumerate(to)] + [(-1, j) for j in rest]
    return [(i, j) for j, i in _pairs(right, left)]


def _pair_lists(left: pd.Series, right: pd.Series) -> pd.Series:
    as_rows = lambda cells: [tuple(int(x) for x in c) for c in cells]
    return pd.Series([[{"l": i, "r": j} for i, j in _pairs(as_rows(a), as_rows(b))] for a, b in zip(left, right, strict=True)])


def diff_copies(
    rows: DataFrame, key: str, fields: Sequence[str], is_left: Column, *, exact_rows: int = EXACT_ROWS, exact_classes: int = EXACT_CLASSES
) -> DataFrame:
    """The rows of ``rows`` for which ``is_left`` holds against those for which it doesn't (null: neither).

    One row for each leftover row or pair of rows: ``key``, ``side`` (left, right or both: where the row is), ``l`` and
    ``r`` (structs of the fields; null where there is no row), ``differing`` (names of the fields that differ, for both),
    ``pairing`` (exact or staged), ``n_left`` and ``n_right`` (rows of the key in each copy).

    Nulls in fields are equal to each other and differ from every value; a null key is a key. Repeated rows cancel one by
    one. Fields are compared as they are: normalise them before. Other columns don't enter. Two empty copies don't
    differ."""
    names = [f"f{i}" for i in range(len(fields))]
    tagged = rows.where(is_left.isNotNull()).select(
        F.col(key).alias("k"), *[F.col(f).alias(n) for f, n in zip(fields, names, strict=True)], is_left.cast("int").alias("a")
    )
    cells = tagged.groupBy("k", *names).agg(F.sum("a").alias("a"), F.sum(1 - F.col("a")).alias("b"))
    net = F.col("a") - F.col("b")
    totals = cells.groupBy(F.col("k").alias("tk")).agg(
        F.sum("a").alias("n_left"), F.sum("b").alias("n_right"), F.sum(F.abs(net)).alias("n_rest")
    ).where(F.col("n_rest") > 0)
    rest = cells.where(net != 0).join(totals, F.col("k").eqNullSafe(F.col("tk"))).select(
        "k", F.struct(*names).alias("row"), net.alias("net"), "n_left", "n_right", "n_rest"
    )
    # the leftovers, once: the ways below read them more than once
    rest = cut(rest.where(F.col("n_rest").isNotNull()))
    out = _exact(rest.where(F.col("n_rest") <= exact_rows))
    if rest.where(F.col("n_rest") > exact_rows).limit(1).count():
        out = out.unionAll(_large(rest.where(F.col("n_rest") > exact_rows), names, exact_classes))
    named = lambda c: F.when(c.isNotNull(), F.struct(*[c[n].alias(f) for f, n in zip(fields, names, strict=True)]))
    differing = F.array_compact(
        F.array(*[F.when(~F.col("l")[n].eqNullSafe(F.col("r")[n]), F.lit(f)) for f, n in zip(fields, names, strict=True)])
    )
    both = F.col("l").isNotNull() & F.col("r").isNotNull()
    side = F.when(both, "both").when(F.col("l").isNotNull(), "left").otherwise("right")
    return out.select(
        F.col("k").alias(key),
        side.alias("side"),
        F.when(both, differing).alias("differing"),
        "pairing",
        "n_left",
        "n_right",
        named(F.col("l")).alias("l"),
        named(F.col("r")).alias("r"),
    )


def _exact(rest: DataFrame) -> DataFrame:
    """Pairs of keys whose leftovers fit into one row."""
    units = lambda sign: F.flatten(
        F.sort_array(F.collect_list(F.when(sign * F.col("net") > 0, F.array_repeat("row", F.abs("net").cast("int")))))
    )
    grouped = rest.groupBy("k", "n_left", "n_right").agg(units(1).alias("ls"), units(-1).alias("rs"))
    # most keys have one row a side at most, which needs no assignment
    plain = (F.size("ls") <= 1) & (F.size("rs") <= 1)
    single = grouped.where(plain).select(
        "k", F.get("ls", F.lit(0)).alias("l"), F.get("rs", F.lit(0)).alias("r"), F.lit("exact").alias("pairing"), "n_left", "n_right"
    )
    hashes = lambda c: F.transform(c, lambda x: F.array(*[F.xxhash64(x[f]) for f in _fields(rest)]))
    paired = grouped.where(~plain).select(
        "*", F.explode(F.pandas_udf(_pair_lists, "array<struct<l:int,r:int>>")(hashes("ls"), hashes("rs"))).alias("p")
    )
    at = lambda c, i: F.when(i >= 0, F.get(c, i))
    return single.unionAll(
        paired.select(
            "k", at("ls", F.col("p.l")).alias("l"), at("rs", F.col("p.r")).alias("r"), F.lit("exact").alias("pairing"), "n_left", "n_right"
        )
    )


def _fields(rest: DataFrame) -> list[str]:
    return rest.schema["row"].dataType.fieldNames()


def _shared(rest: DataFrame, names: Sequence[str]) -> DataFrame:
    """Leftovers with ``values``: for each field a hash of the value if the key has it on both sides, else the sign of the side."""
    signed = marked = rest.withColumn("sign", F.signum("net").cast("int"))
    for n in names:
        value = F.col("row")[n]
        both = signed.groupBy(F.col("k").alias("sk"), value.alias("sv")).agg(
            F.min("sign").alias("least"), F.max("sign").alias("most")
        ).where("least < most").select("sk", "sv", F.lit(True).alias("hit"))
        joined = join_spread(marked.withColumn("v", value), both, [("k", "sk"), ("v", "sv")], by=["row"], how="left")
        marked = joined.withColumn(
            f"v_{n}", F.when(F.col("hit"), F.xxhash64(value)).otherwise(F.col("sign").cast("bigint"))
        ).drop("sk", "sv", "hit", "v")
    values = F.array(*[F.col(f"v_{n}") for n in names])
    return marked.select("k", "row", "net", "n_left", "n_right", "sign", values.alias("values"))


def _components(classes: DataFrame) -> DataFrame:
    """The ``name`` and ``component`` (the least name in it) of each class of a key, classes being connected by values that they
    share. A value that all classes of the key have connects nothing.

    Each round every class takes the least label of its values, then the label of the class that this is the name of, so
    rounds grow with the logarithm of the longest way through a component."""
    cells = classes.select("k", "name", "sign", F.posexplode("values").alias("f", "v")).where(~F.col("v").isin(1, -1))
    totals = classes.groupBy(F.col("k").alias("tk")).agg(F.count(F.lit(1)).alias("n_all"))
    links = cells.groupBy(F.col("k").alias("lk"), F.col("f").alias("lf"), F.col("v").alias("lv")).agg(F.count(F.lit(1)).alias("c")).join(
        totals, same(["lk"], ["tk"])
    ).where("c < n_all").select("lk", "lf", "lv")
    value = [("k", "lk"), ("f", "lf"), ("v", "lv")]
    edges = cut(join_spread(cells, links, value, by=["name"]).select("k", "name", "f", "v"))
    at = cut(classes.select("k", "name", F.col("name").alias("component"), F.lit(True).alias("moved")))
    while at.where("moved").limit(1).count():
        mine = at.select(F.col("k").alias("ak"), F.col("name").alias("an"), "component")
        met = edges.join(mine, same(["k", "name"], ["ak", "an"])).groupBy(F.col("k").alias("lk"), F.col("f").alias("lf"), F.col("v").alias("lv")).agg(F.min("component").alias("least"))
        heard = join_spread(edges, met, value, by=["name"]).groupBy(F.col("k").alias("hk"), F.col("name").alias("hn")).agg(F.min("least").alias("heard"))
        told = at.join(heard, same(["k", "name"], ["hk", "hn"]), "left").select(
            "k", "name", F.col("component").alias("old"), F.least("component", "heard").alias("near")
        )
        roots = told.select(F.col("k").alias("rk"), F.col("name").alias("rn"), F.col("near").alias("far"))
        far = join_spread(told, roots, [("k", "rk"), ("near", "rn")], by=["name"])
        at = cut(far.select("k", "name", F.col("far").alias("component"), (F.col("far") != F.col("old")).alias("moved")))
    return at.select(F.col("k").alias("pk"), F.col("name").alias("pn"), "component")


def _large(rest: DataFrame, names: Sequence[str], exact_classes: int) -> DataFrame:
    """Pairs of keys with many leftovers: through classes, of the key or of its components."""
    marked = cut(_shared(rest, names).withColumn("name", F.md5(F.to_json(F.struct("sign", "values")))))
    classes = marked.groupBy("k", "name", "sign").agg(F.sum(F.abs("net")).alias("n"), F.any_value("values").alias("values"))
    counts = cut(classes.groupBy(F.col("k").alias("ck")).agg(F.count(F.lit(1)).alias("n_classes")))
    many = counts.where(F.col("n_classes") > exact_classes)
    parted = many.limit(1).count() > 0
    if parted:
        wide = cut(join_spread(classes, many, [("k", "ck")], by=["name"]).drop("ck", "n_classes"))
        classes = classes.join(_components(wide), same(["k", "name"], ["pk", "pn"]), "left").drop("pk", "pn")
    else:
        classes = classes.withColumn("component", F.lit(None).cast("string"))
    classes = cut(classes)
    part = ["k", "component"]
    sizes = classes.groupBy(F.col("k").alias("ck"), F.col("component").alias("cc")).agg(
        F.count(F.lit(1)).alias("n_classes"), F.min("sign").alias("least"), F.max("sign").alias("most")
    )
    solvable = classes.join(sizes.where((F.col("n_classes") <= exact_classes) & F.expr("least < most")), same(part, ["ck", "cc"]), "left_semi")
    cell = F.struct("name", "n", "values")
    lists = lambda sign: F.sort_array(F.collect_list(F.when(F.col("sign") == sign, cell)))
    solved = solvable.groupBy(*part).agg(lists(1).alias("ls"), lists(-1).alias("rs")).select(
        F.col("k").alias("mk"), F.explode(F.pandas_udf(_flows, "array<struct<lc:string,rc:string,n:bigint>>")("ls", "rs")).alias("m")
    ).select("mk", "m.*", F.lit("exact").alias("pairing"))
    large = sizes.where((F.col("n_classes") > exact_classes) & F.expr("least < most"))
    if parted:
        solved = solved.unionByName(_by_shared(classes, large, names))
    before = lambda c: F.coalesce(
        F.sum("n").over(W.partitionBy("mk", c).orderBy("lc", "rc").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)
    )
    moves = cut(solved.withColumn("l_from", before("lc")).withColumn("r_from", before("rc")))
    units = repeated(marked, F.abs("net"), "copy").select("k", "row", "n_left", "n_right", "sign", "name", "copy")
    # a row and the number of its copy are unique within a class, and compared as they are: no text of them is exact for every type
    placed = cut(rank_within(units, ["k", "name"], ["row", "copy"], classes.select("k", "name", "n", "component"), carry=["component"], ways=8))

    def moved(sign: int, of_class: str, start: str) -> DataFrame:
        mine = placed.where(F.col("sign") == sign)
        ways = moves.select("mk", F.col(of_class).alias("mc"), F.struct("lc", "rc").alias("way"), F.col(start).alias("start"), "n", "pairing")
        met = join_spread(mine, ways, [("k", "mk"), ("name", "mc")], by=["row", "copy"])
        at = F.col("rank") - F.col("start")
        return met.where(at.between(F.lit(0), F.col("n") - 1)).select(
            "k", "row", "copy", "sign", "pairing", "n_left", "n_right", F.struct("k", "way", at.alias("at")).alias("move")
        )

    l, r = cut(moved(1, "lc", "l_from")), cut(moved(-1, "rc", "r_from"))  # noqa: E741
    out = l.alias("l").join(r.alias("r"), F.col("l.move") == F.col("r.move")).select(
        "l.k", F.col("l.row").alias("l"), F.col("r.row").alias("r"), "l.pairing", "l.n_left", "l.n_right"
    )
    gone = l.unionAll(r).select(F.col("k").alias("gk"), F.col("row").alias("gr"), F.col("copy").alias("gc"), F.col("sign").alias("gs"))
    mine = ["k", "row", "copy", "sign"]
    open_rows = placed.join(gone, same(mine, ["gk", "gr", "gc", "gs"]), "left_anti").select(*mine, "component", "n_left", "n_right")
    if not parted:
        # a key of one part has paired as many rows as it can
        return out.unionAll(_alone(open_rows.withColumn("pairing", F.lit("exact")), names, rest))
    open_rows = open_rows.join(large, same(part, ["ck", "cc"]), "left").select(
        *mine, "component", "n_left", "n_right", F.when(F.col("n_classes").isNotNull(), "staged").otherwise("exact").alias("pairing")
    )
    # rows of different components, and what a component leaves, agree in nothing that not all rows of the key do
    rest_pairs, left = _stage(open_rows, F.col("k"))
    return out.unionAll(rest_pairs).unionAll(_alone(left, names, rest))


def _by_shared(classes: DataFrame, large: DataFrame, names: Sequence[str]) -> DataFrame:
    """Moves within the ``large`` components (``ck``, ``cc``), each in one task, whose memory grows with its classes."""
    # numbered, as keys of all types must come back as they are
    parts = cut(large.select("ck", "cc", F.monotonically_increasing_id().alias("part")))
    cells = join_spread(classes, parts, [("k", "ck"), ("component", "cc")], by=["name"]).select(
        "part", "name", (F.col("sign") > 0).alias("is_left"), "n", *[F.col("values")[i].alias(f"v{i}") for i in range(len(names))]
    )
    moves = cells.groupBy("part").applyInPandas(_shared_moves, "part bigint, lc string, rc string, n bigint")
    return moves.withColumnRenamed("part", "of").join(parts, F.col("of") == F.col("part")).select(
        F.col("ck").alias("mk"), "lc", "rc", "n", F.lit("staged").alias("pairing")
    )


def _shared_moves(cells: pd.DataFrame) -> pd.DataFrame:
    cells = cells.sort_values("name", ignore_index=True)
    values = cells[[c for c in cells.columns if c[0] == "v"]].to_numpy(dtype=np.int64)
    left, right, n = shared_flow(values, cells["is_left"].to_numpy(dtype=bool), cells["n"].to_numpy(dtype=np.int64))
    name = cells["name"].to_numpy()
    return pd.DataFrame({"part": np.full(len(n), cells["part"].iloc[0]), "lc": name[left], "rc": name[right], "n": n})


def _alone(rows: DataFrame, names: Sequence[str], rest: DataFrame) -> DataFrame:
    """Rows without a partner."""
    null = F.lit(None).cast(rest.schema["row"].dataType)
    return rows.select(
        "k",
        F.when(F.col("sign") > 0, F.col("row")).otherwise(null).alias("l"),
        F.when(F.col("sign") < 0, F.col("row")).otherwise(null).alias("r"),
        "pairing",
        "n_left",
        "n_right",
    )


def _stage(rows: DataFrame, *by: Column) -> tuple[DataFrame, DataFrame]:
    """Pairs of rows of either sign that agree in ``by``, by rank, as many as there can be, and the rows that stay."""
    # one column for all: structs are equal if their fields are, nulls included
    grouped = rows.select("*", F.struct(*by).alias("g"))
    counts = grouped.groupBy("g").agg(F.count_if(F.col("sign") > 0).alias("nl"), F.count_if(F.col("sign") < 0).alias("nr"))
    sides = counts.select("g", F.least("nl", "nr").alias("m"), F.explode(F.array(*[
        F.struct(F.lit(sign).alias("sign"), F.col(n).alias("n")) for sign, n in ((1, "nl"), (-1, "nr"))
    ])).alias("s")).select("g", "m", "s.*").where("n > 0")
    ranked = cut(rank_within(grouped, ["g", "sign"], ["row", "copy"], sides, carry=["m"], ways=8))
    l, r = (ranked.where((F.col("sign") == s) & (F.col("rank") < F.col("m"))).alias(a) for s, a in ((1, "l"), (-1, "r")))  # noqa: E741
    staged = (F.col("l.pairing") == "staged") | (F.col("r.pairing") == "staged")
    pairs = l.join(r, (F.col("l.g") == F.col("r.g")) & (F.col("l.rank") == F.col("r.rank"))).select(
        "l.k", F.col("l.row").alias("l"), F.col("r.row").alias("r"), F.when(staged, "staged").otherwise("exact").alias("pairing"), "l.n_left", "l.n_right"
    )
    return pairs, ranked.where(F.col("rank") >= F.col("m")).select(*rows.columns)
