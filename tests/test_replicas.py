from __future__ import annotations

import datetime
import itertools

import pytest
from pyspark.sql import functions as F
from test_vectors import parse, text

from driftwise.operators import planning, replicas
from driftwise.plans.audit import PROJECTED_NODES, UNUSED, projected_snapshots

NODES = [replicas.Node(i, a, a, f"http://{u}") for i, (a, u) in enumerate(zip("ABC", ["n2", "N1", "n3"]))]
SCHEMA = "delivery_id long, original_document_id string, from_node string, change_vector string, collection string, last_modified timestamp_ntz"
AT = datetime.datetime(2026, 1, 1)


def judge(states, ignored):
    """Brute force with pairwise dominance. states: (url, vector, collection) or None, in node order."""
    held = [(n.url, *s) for n, s in zip(NODES, states) if s is not None]
    if not held:
        return None
    named = {}
    for _, _, c in held:
        if c is not None and c.strip(" "):
            named.setdefault(c.upper(), c)
    maps = [parse(cv, ignored) for _, cv, _ in held]
    versions = {text(m).upper() for m in maps}
    dominant = [h for h, m in zip(held, maps) if all(all(m.get(d, -1) >= e for d, e in o.items()) for o in maps)]
    best = min(held if len(versions) == 1 else dominant, key=lambda h: h[0].upper(), default=None)
    if len(named) > 1:
        kind = "COLLECTION_MISMATCH"
    elif len(held) == len(NODES) and len(versions) == 1:
        return None
    elif best is None:
        kind = "AMBIGUOUS_CV"
    else:
        kind = "MISSING" if len(held) < len(NODES) else "CV_MISMATCH"
    others = sorted((n.url for n in NODES if best is None or n.url != best[0]), key=str.upper)
    collection = next(iter(named.values())) if len(named) == 1 else held[0][2]
    return kind, best and best[0], best and best[1], collection, ",".join(others)


VECTORS = ["", "A:1-a", "A:2-a", "A:1-a,B:1-b", "B:1-b,A:2-a", "A:1-a,B:2-b", "A:2-a, X:9-u", "A:1-A", "broken"]


@pytest.mark.parametrize("ignored", [[], ["u"], ["u", "b"]])
def test_every_combination_of_vectors(spark, ignored):
    cases = list(itertools.product([None, *VECTORS], repeat=3))
    rows = [(i * 3 + k, f"doc/{i}", a, cv, "Users", AT) for i, case in enumerate(cases) for k, (a, cv) in enumerate(zip("ABC", case)) if cv is not None]
    found = replicas.evaluate(replicas.align(spark.createDataFrame(rows, SCHEMA), NODES), ignored).collect()
    got = {r["document_id"]: (r["mismatch_type"], r["winner_node"], r["winner_cv"], r["collection"], r["affected_nodes"]) for r in found}
    want = {f"doc/{i}": judge([None if cv is None else (cv, "Users") for cv in case], ignored) for i, case in enumerate(cases)}
    assert got == {k: v for k, v in want.items() if v}


def test_every_combination_of_collections(spark):
    cases = list(itertools.product([None, ("A:1-a", "Users"), ("A:1-a", "USERS"), ("A:1-a", None), ("A:1-a", "  "), ("A:2-a", "Orders")], repeat=3))
    rows = [(i * 3 + k, f"doc/{i}", a, s[0], s[1], None) for i, case in enumerate(cases) for k, (a, s) in enumerate(zip("ABC", case)) if s]
    found = replicas.evaluate(replicas.align(spark.createDataFrame(rows, SCHEMA), NODES)).collect()
    got = {r["document_id"]: (r["mismatch_type"], r["winner_node"], r["winner_cv"], r["collection"], r["affected_nodes"]) for r in found}
    assert got == {f"doc/{i}": j for i, case in enumerate(cases) if (j := judge(case, []))}


def test_alignment_takes_the_latest_row_and_ignores_case(spark):
    later = AT + datetime.timedelta(days=1)
    rows = [(1, "Doc/1", "A", "A:1-a", "U", AT), (2, "doc/1", "A", "A:2-a", "U", later), (3, "DOC/1", "A", "A:3-a", "U", None), (4, "doc/1", "D", "A:9-a", "U", later), (5, None, "A", "A:1-a", "U", AT), (6, "doc/1", "B", None, None, AT)]
    out = replicas.align(spark.createDataFrame(rows, SCHEMA), NODES).collect()
    assert len(out) == 1 and out[0]["document_key"] == "DOC/1" and out[0]["document_id"] == "DOC/1"
    assert [(s["node"], s["present"], s["change_vector"]) for s in out[0]["states"]] == [("A", True, "A:2-a"), ("B", True, ""), ("C", False, None)]


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert replicas.evaluate(replicas.align(empty, NODES)).count() == 0
    assert replicas.problem_candidates(empty, 3).count() == 0


def test_projection_has_the_known_outcome(spark, folder):
    rows = projected_snapshots(spark, folder)
    assert rows.count() == 4125
    count = lambda df, c: {r[0]: r[1] for r in df.groupBy(c).count().collect()}
    found = replicas.evaluate(replicas.align(rows, PROJECTED_NODES), UNUSED).withColumn("decision", planning.decision()).cache()
    assert count(found, "mismatch_type") == {"MISSING": 300, "CV_MISMATCH": 300, "AMBIGUOUS_CV": 150, "COLLECTION_MISMATCH": 75}
    assert count(found, "decision") == {"PatchPlannedDryRun": 525, "SkippedAmbiguousCv": 150, "SkippedCollectionMismatch": 150}
    # fixture rule 6 is a collection mismatch whose winner is A, rule 7 one without a collection
    assert count(found.where("mismatch_type = 'CV_MISMATCH' OR mismatch_type = 'MISSING'"), "winner_node") == {"http://node-a": 450, "http://node-b": 150}
    assert count(replicas.evaluate(replicas.align(rows, PROJECTED_NODES)), "mismatch_type")["CV_MISMATCH"] == 375


def test_physical_ids(spark):
    ids = ["users/1", "a\\b", "a\x01b", "a\\\x02"]
    df = spark.createDataFrame([(i,) for i in ids], "id string")
    got = [tuple(r) for r in df.select(replicas.unsafe_reason(F.col("id")), replicas.physical_id(F.col("id"), F.lit("B"))).collect()]
    assert [g[0] for g in got] == ["None", "ContainsBackslash", "ContainsControlCharacter", "ContainsBackslash,ContainsControlCharacter"]
    assert got[0][1] == "users/1/B" and all(g[1].startswith("NodeDocumentSnapshots/B/") and len(g[1]) == 88 for g in got[1:])
