from __future__ import annotations

import oracle
import pytest
from pyspark.sql import functions as F

from driftwise.llm import queries
from driftwise.llm.tokens import bpe_tokens


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_agrees_with_sql(spark, folder, name):
    assert oracle.difference(queries.QUERIES[name](spark, folder), oracle.connect(folder), queries.SQL[name]) == ""


def test_every_document_is_packed_once(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    sizes = queries.p6_containers(spark, folder).groupBy("doc_id").agg(F.sum("n_tokens").alias("n"), F.count(F.lit(1)).alias("pieces"))
    wrong = docs.join(sizes, "doc_id", "left").where(~F.col("n").eqNullSafe(F.coalesce(F.octet_length("text"), F.lit(0))) | (F.col("pieces") != F.greatest(F.lit(1), F.ceil(F.col("n") / queries.CAPACITY))))
    assert wrong.count() == 0


def test_bpe_sizes(spark):
    df = spark.createDataFrame([("hello world",), (None,), ("",)], "text string")
    assert [r[0] for r in df.select(bpe_tokens(F.col("text"), queries.bpe_vocabulary(spark))).collect()] == [2, 0, 0]
