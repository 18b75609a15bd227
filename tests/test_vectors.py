from __future__ import annotations

import itertools
import random
import re

from pyspark.sql import functions as F

from driftwise.functions import vectors as V
from driftwise.operators.replicas import vector_segments


def parse(cv, ignored=()):
    """Brute force: what the semantics say, segment by segment."""
    out = {}
    for s in (cv or "").split(","):
        m = re.match(r"([^:]+):([^-]*)-(.*)\Z", s.strip(" \t\n\x0b\f\r"), re.S)
        if not m or m[3] in ignored or not re.fullmatch(r"\s*\+?[0-9]+\s*", m[2]) or int(m[2]) >= 2**63:
            continue
        out[m[3]] = max(out.get(m[3], -1), int(m[2]))
    return out


def text(parsed):
    return ",".join(f"{d}:{e}" for d, e in sorted(parsed.items(), key=lambda x: x[0].encode()))


ODD = [
    None, "", "  ", "A:1-x", " A:1-x , B:2-y ", "B:2-y,A:1-x", "A:1-x,RAFT:3-x,B:2-x", "A:+5-x", "A: 5 -x", "A:007-x", "A:-5-x", "A:5.0-x", "A:9223372036854775807-x", "A:9223372036854775808-x",
    ":3-x", "A:3", "A3-x", "A:3-", "A:3-x-y", "A:3-x:y", "bad,,A:1-x,", "A:1-X,A:2-x", "a:b:3-x", "A:1-ab,A:2-a,A:3-abc", "\tA:1-x\n,B:2-y", "A:\t7-x", "ü:1-é,A:1-z", "A:1-x" + ",B:2-y" * 50,
]


def test_normalize_odd_spellings(spark):
    df = spark.createDataFrame(list(enumerate(ODD)), "i int, cv string")
    for ignored in ([], ["x"], ["x", "y'"]):
        got = dict(df.select("i", V.normalize(F.col("cv"), ignored)).collect())
        assert got == {i: text(parse(cv, ignored)) for i, cv in enumerate(ODD)}


def test_normalize_random_vectors(spark):
    random.seed(5)
    part = lambda: random.choice(["A", "B", " R ", ""]) + random.choice([":", ":", ":", ""]) + random.choice(["1", "22", "+3", " 4", "x", "99999999999999999999", ""]) + random.choice(["-", "-", "-", ""]) + random.choice(["a", "b", "ab", "B ", "c-d", ""])
    texts = [random.choice([",", ", ", " ,"]).join(part() for _ in range(random.randrange(6))) for _ in range(2000)]
    got = dict(spark.createDataFrame(list(enumerate(texts)), "i int, cv string").select("i", V.normalize(F.col("cv"))).collect())
    assert got == {i: text(parse(cv)) for i, cv in enumerate(texts)}


def test_dominance_and_ceiling(spark):
    vectors = [",".join(f"T:{e}-{d}" for d, e in zip("abc", es) if e) for es in itertools.product(range(3), repeat=3)]
    pairs = list(itertools.product(vectors, repeat=2))
    df = spark.createDataFrame(pairs, "l string, r string").select("l", "r", V.dominates(F.col("l"), F.col("r")).alias("d"), V.ceiling(F.array("l", "r")).alias("top"))
    for row in df.collect():
        a, b = parse(row["l"]), parse(row["r"])
        assert row["d"] == all(a.get(k, -1) >= v for k, v in b.items())
        assert row["top"] == text({k: max(a.get(k, 0), b.get(k, 0)) for k in a | b})
        # the side that equals the ceiling is the one that dominates
        assert row["d"] == (row["top"] == text(a))


def test_parse_long(spark):
    values = ["5", " 5 ", "+5", "-5", "5.0", "", None, "٣", "9223372036854775807", "9223372036854775808", "0x10", "1 2", "5L"]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v string").select(V.parse_long(F.col("v"))).collect()]
    assert got == [5, 5, 5, None, None, None, None, None, 2**63 - 1, None, None, None, None]


def test_segments_keep_the_first_tag(spark):
    df = spark.createDataFrame([(1, "A:1-x,B:5-x,C:2-y,bad"), (2, None)], "id int, cv string")
    assert sorted(map(tuple, vector_segments(df, "id", F.col("cv")).collect())) == [(1, "x", "A", 5), (1, "y", "C", 2)]


def test_sql_functions(spark):
    from driftwise.functions.sql import register

    register(spark)
    spark.createDataFrame(list(enumerate(ODD)), "i int, cv string").createOrReplaceTempView("odd")
    assert {r[0]: r[1] for r in spark.sql("SELECT i, cv_norm(cv) FROM odd").collect()} == {i: text(parse(cv)) for i, cv in enumerate(ODD)}
    got = spark.sql("SELECT cv_dominates('A:2-x,B:1-y', 'C:2-x'), cv_dominates('A:1-x', 'A:1-x,B:1-y'), cv_ceiling(array('A:1-x', 'B:2-y,A:3-x')), left(version_hash('a', 'A:1-x'), 4)").first()
    assert tuple(got)[:3] == (True, False, "x:3,y:2") and len(got[3]) == 4
