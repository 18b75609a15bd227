from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from driftwise.llm.splitting import spans, split_spans, split_texts, split_tokens, unbroken

PART = st.sampled_from(["word", "longer-word", " ", "  ", "\n", "\n\n", "\n== Heading ==\n", "\n|-\n| cell", ". ", "。", "ö", "日本語", "x" * 30, "\t", "\r\n", "🙂"])


@settings(max_examples=300, deadline=None)
@given(st.lists(PART, min_size=1, max_size=80), st.integers(12, 60), st.integers(0, 11))
def test_pieces_cover_the_text_under_the_limit(parts, limit, overlap):
    text = "".join(parts).encode()
    if len(text) <= limit:
        return
    pieces = spans(text, limit, overlap)
    assert b"".join(text[new:end] for _, new, end, _ in pieces) == text
    stretch = max(map(len, text.replace(b"\t", b" ").replace(b"\r", b" ").replace(b"\n", b" ").split(b" ")))
    for i, (first, new, end, cut) in enumerate(pieces):
        assert 0 < end - new and end - first <= limit
        assert new - first <= overlap and (i > 0 or first == new)
        assert cut != "hard" or stretch > limit
        text[first:end].decode()  # no character is cut
    assert unbroken(text, pieces, limit) == (stretch > limit)


def test_the_strongest_boundary_near_the_middle_is_taken():
    text = b"a" * 40 + b" " + b"b" * 8 + b"\n\n" + b"c" * 30 + b". " + b"d" * 20
    assert [(new, cut) for _, new, _, cut in spans(text, 60, 0)] == [(0, "start"), (51, "paragraph")]


@pytest.mark.parametrize("size", [16384, 16059, 8193, 40000])
def test_pieces_of_a_word_that_is_cut_get_the_whole_overlap(size):
    text = b"x" * size
    pieces = spans(text, 8192, 256)
    assert [new - first for first, new, _, _ in pieces] == [0] + [256] * (len(pieces) - 1)
    assert b"".join(text[new:end] for _, new, end, _ in pieces) == text and max(end - first for first, _, end, _ in pieces) <= 8192


def test_a_sentence_end_far_from_the_middle_comes_before_a_cut_inside_a_word():
    text = b"x" * 10 + "。".encode() + b"x" * 77 + "。".encode() + b"x" * 7
    assert [(new, cut) for _, new, _, cut in spans(text, 90, 0)] == [(0, "start"), (13, "sentence")]


@pytest.mark.parametrize(("length", "hard"), [(90, False), (91, True), (300, True)])
def test_a_stretch_is_measured_where_it_was_cut(length, hard):
    for before, after in ((b"", b""), (b"a b ", b" c d" * 30), (b"x. " * 40, b"\ny" * 40)):
        text = before + b"z" * length + after + b" " + b"w " * 60
        assert unbroken(text, spans(text, 90, 10), 90) is hard


def test_broken_bytes_are_kept():
    text = b"\x80" * 100
    pieces = spans(text, 30, 5)
    assert b"".join(text[new:end] for _, new, end, _ in pieces) == text and all(end - first <= 30 for first, _, end, _ in pieces)


def test_split_texts(spark):
    long = "one two three. " * 40
    df = spark.createDataFrame([(1, long), (2, "short"), (3, ""), (4, None), (5, "y" * 200), (2, "short")], "doc_id long, text string").withColumn("piece", F.lit("clash"))
    got = split_texts(df, "doc_id", "text", 100, 10)
    assert got.where(F.octet_length("piece_text") != F.col("n_tokens")).count() == 0
    by = {r["doc_id"]: r["n"] for r in got.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert by[2] == 2 and by[3] == 1 and 4 not in by and by[5] >= 2
    pieces = sorted(got.where("doc_id = 1").collect(), key=lambda r: r["piece"])
    assert "".join(r["piece_text"][r["new_byte"] - r["first_byte"] :] for r in pieces) == long
    assert {r["doc_id"]: r["unbroken"] for r in split_spans(df, "doc_id", "text", 100, 10).where("piece = 0").collect()} == {1: False, 5: True}
    assert split_texts(df.limit(0), "doc_id", "text", 100, 10).count() == 0
    with pytest.raises(ValueError):
        split_texts(df, "doc_id", "text", 10, 10)


def test_very_long_text(spark):
    text = "lorem ipsum dolor " * 60000
    got = split_texts(spark.createDataFrame([(1, text)], "doc_id long, text string"), "doc_id", "text", 8192, 256)
    assert got.agg(F.max("n_tokens")).first()[0] <= 8192
    assert sum(r["n_tokens"] - (r["new_byte"] - r["first_byte"]) for r in got.select("n_tokens", "new_byte", "first_byte").collect()) == len(text)


@settings(max_examples=60, deadline=None)
@given(st.lists(PART, min_size=1, max_size=80), st.integers(12, 40), st.integers(0, 8))
def test_pieces_by_tokens(parts, limit, overlap):
    text = "".join(parts).encode()
    tokens = lambda a, b: -(-len(text[a:b]) // 3) + text[a:b].count(b"x") // 4  # noqa: E731, any count that bytes bound
    if tokens(0, len(text)) <= limit:
        return
    pieces = spans(text, limit, overlap, tokens)
    assert b"".join(text[new:end] for _, new, end, _ in pieces) == text
    for i, (first, new, end, _) in enumerate(pieces):
        assert new < end and tokens(first, end) <= limit and tokens(first, new) <= overlap and (i > 0 or first == new)
        text[first:end].decode()


def test_split_tokens(spark):
    from driftwise.llm.queries import bpe_vocabulary
    from driftwise.llm.tokens import bpe_counter

    tokens = bpe_counter(bpe_vocabulary(spark))
    long = "The quick brown fox jumps over the lazy dog. " * 60 + "日本語の文章。" * 80
    df = spark.createDataFrame([(1, long), (2, "short"), (3, ""), (4, None)], "doc_id long, text string")
    got = split_tokens(df, "doc_id", "text", 100, 20, bpe_vocabulary(spark)).orderBy("doc_id", "piece").collect()
    assert [(r["doc_id"], r["n_tokens"]) for r in got if r["doc_id"] > 1] == [(2, 1), (3, 0)]
    data, pieces = long.encode(), [r for r in got if r["doc_id"] == 1]
    assert b"".join(data[r["new_byte"] : r["end_byte"]] for r in pieces) == data
    assert all(r["n_tokens"] == tokens(data[r["first_byte"] : r["end_byte"]]) <= 100 and tokens(data[r["first_byte"] : r["new_byte"]]) <= 20 for r in pieces)
    assert sum(r["first_byte"] < r["new_byte"] for r in pieces) > len(pieces) // 2
    with pytest.raises(ValueError):
        split_tokens(df, "doc_id", "text", 10, 8, bpe_vocabulary(spark))
