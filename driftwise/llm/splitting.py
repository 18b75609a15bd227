"""Oversized texts cut into overlapping pieces at natural boundaries.

Recursive bisection: a text, as UTF-8 bytes, is cut at the strongest boundary near its midpoint (section, paragraph, row or
line, sentence, word, in this order of strength); halves that still exceed the limit less the overlap are cut again; last,
each piece is extended backwards by the overlap. Sizes are tokens of the byte tokenizer, one for each byte, or of any
tokenizer that counts the tokens of a range (:func:`split_tokens`).

Only where there is neither white space nor a sentence end to cut at inside a stretch longer than the limit is a word cut,
between characters. A
word that fits into the limit but not into the limit less the overlap stays whole, with as much overlap as fits; what is left
of a word that was cut has nothing to keep whole, and is cut until the overlap fits.

The Python worker gets the bytes of oversized texts and returns positions; the pieces themselves are cut out in the JVM.
Nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwise.llm.tokens import bpe_counter

#: Cut before the match's end, strongest first: the boundary is where the match ends.
SECTION = rb"\n(?==)|\n(?=#)"
PARAGRAPH = rb"\n[ \t\r]*\n\s*"
ROW = rb"\n(?=\|-|\||\*|;|:)"
LINE = rb"[\r\n]+"
SENTENCE = rb"[.!?]['\")\]]*[ \t]+|(?:\xe3\x80\x82|\xef\xbc\x81|\xef\xbc\x9f|\xd8\x9f)"
WORD = rb"[ \t\r\n]+"
LEVELS = [
    (name, re.compile(pattern)) for name, pattern in (
        ("section", SECTION), ("paragraph", PARAGRAPH), ("row", ROW), ("line", LINE), ("sentence", SENTENCE), ("word", WORD)
    )
]
PIECES = "array<struct<first_byte:int,new_byte:int,end_byte:int,cut:string,unbroken:boolean>>"
SPACE = re.compile(rb"[ \t\r\n]")
SPACES = b" \t\r\n"


def unbroken(text: bytes, pieces: list[tuple[int, int, int, str]], limit: int) -> bool:
    """Whether the bisection had to cut a stretch of more than ``limit`` bytes without white space.

    What is new in a piece is no longer than the limit, so a longer stretch has a cut inside, with no white space on either
    side of it: only around such cuts the stretch is measured, at most ``limit`` bytes either way."""
    for _, at, _, _ in pieces[1:]:
        if text[at - 1] in SPACES or text[at] in SPACES:
            continue
        least = max(0, at - limit - 1)
        before = max(text.rfind(bytes((c,)), least, at) for c in SPACES)
        after = SPACE.search(text, at, min(len(text), at + limit + 1))
        if (after.start() if after else min(len(text), at + limit + 1)) - (before + 1 if before >= 0 else least) > limit:
            return True
    return False


def nearest(pattern: re.Pattern, text: bytes, low: int, high: int, middle: int) -> int:
    """Where a match in text[low:high] ends, nearest to ``middle`` and inside (low, high); -1 if there is none."""
    best = -1
    for m in pattern.finditer(text, low, high):
        at = m.end()
        if low < at < high and (best < 0 or abs(at - middle) < abs(best - middle)):
            best = at
        if at >= middle and best >= 0:
            break
    return best


def between_characters(text: bytes, at: int, low: int, high: int) -> int:
    """``at``, or a little before it, else after it, inside (low, high), where no UTF-8 character is cut; ``at`` itself if the
    bytes are no UTF-8."""
    for place in (at, at - 1, at - 2, at - 3, at + 1, at + 2, at + 3):
        if low < place < high and text[place] & 0xC0 != 0x80:
            return place
    return at


def boundary(text: bytes, start: int, end: int, fits: Callable[[], bool]) -> tuple[int, str]:
    """Where to cut text[start:end], and at what; (-1, '') if it is a word that ``fits`` as a whole."""
    middle, reach = (start + end) // 2, (end - start) // 4
    for name, pattern in LEVELS:
        at = nearest(pattern, text, max(start, middle - reach), min(end, middle + reach), middle)
        if at > 0:
            return at, name
    # no boundary near: the nearest white space anywhere inside, the cut being after it or, at the very end, before it
    after = SPACE.search(text, middle, end)
    before = max(
        text.rfind(b" ", start, middle),
        text.rfind(b"\t", start, middle),
        text.rfind(b"\r", start, middle),
        text.rfind(b"\n", start, middle),
    )
    places = [p for x in ((after.start() if after else -1), before) if x >= 0 for p in (x + 1, x) if start < p < end]
    if places:
        return min(places, key=lambda p: abs(p - middle)), "word"
    if fits():
        return -1, ""
    # before a word is cut: a boundary far from the middle, as scripts without spaces have
    for name, pattern in LEVELS:
        at = nearest(pattern, text, start, end, middle)
        if at > 0:
            return at, name
    return between_characters(text, middle, start, end), "hard"


def spans(text: bytes, limit: int, overlap: int, size: Callable[[int, int], int] | None = None) -> list[tuple[int, int, int, str]]:
    """Pieces (start with overlap, start of what is new, end, the boundary at which it starts) of a text over ``limit``.

    ``size``: the tokens of text[a:b], by default its bytes; no more than its bytes, and not much less than those of a part."""
    of = size or (lambda a, b: b - a)
    room, pieces, todo = limit - overlap, [], [(0, len(text), "start", "end")]
    while todo:
        start, end, cut, next_cut = todo.pop()
        # what is left of a word that was cut is no word to keep, but a character (of up to 4 bytes) is
        whole = min(limit, max(room, 4)) if "hard" in (cut, next_cut) else limit
        fits = lambda: of(start, end) <= whole  # noqa: B023, E731, called at once
        at, name = boundary(text, start, end, fits) if of(start, end) > room else (-1, "")
        if at < 0:
            pieces.append((start, end, cut))
        else:
            todo += [(at, end, name, next_cut), (start, at, cut, name)]
    out = []
    for i, (start, end, cut) in enumerate(pieces):
        back = start
        if i and size is None:
            least = max(pieces[i - 1][0], start - min(overlap, limit - (end - start)))
            back = start if least >= start else _overlap_start(text, least, start)
        elif i:
            back = _overlap_by_tokens(text, pieces[i - 1][0], start, end, limit, overlap, of)
        out.append((back, start, end, cut))
    return out


def _overlap_by_tokens(text: bytes, first: int, start: int, end: int, limit: int, overlap: int, size: Callable[[int, int], int]) -> int:
    """Where a piece begins that repeats as much of what is before ``start`` (from ``first`` on) as it may. As many bytes as tokens
    are wanted are never too many tokens; ten times as many are tried, by bisection over what is repeated alone. The piece
    as a whole is counted last, and gets a little less where the two together have more tokens than apart."""
    room = limit - size(start, end)
    for spare in (0, 4, 16):
        most = min(overlap, room) - spare
        if most <= 0:
            break
        good, far = max(first, start - most), max(first, start - 10 * most)
        while good - far > 8:
            middle = (good + far) // 2
            good, far = (middle, far) if size(middle, start) <= most else (good, middle)
        back = start if good >= start else _overlap_start(text, good, start)
        if back < start and size(back, start) <= overlap and size(back, end) <= limit:
            return back
    return start


def _overlap_start(text: bytes, least: int, start: int) -> int:
    """The first beginning of a word in text[least:start], else of a character."""
    if least and text[least - 1] not in SPACES and text[least] not in SPACES:
        m = SPACE.search(text, least, start)
        if m and m.end() < start:
            return m.end()
    while least < start and text[least] & 0xC0 == 0x80:
        least += 1
    return least


def _cuts(text: Column, limit: int, overlap: int) -> Column:
    """The pieces of texts of more than ``limit`` bytes; null for others, whose bytes the Python worker doesn't get."""
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be from 0 to less than limit")

    @F.pandas_udf(PIECES)
    def cut(batch: pd.Series) -> pd.Series:
        found: list[list[dict] | None] = []
        for t in batch:
            if t is None:
                found.append(None)
                continue
            data = bytes(t)
            pieces = spans(data, limit, overlap)
            hard = unbroken(data, pieces, limit)
            found.append([{"first_byte": a, "new_byte": b, "end_byte": c, "cut": d, "unbroken": hard} for a, b, c, d in pieces])
        return pd.Series(found, dtype=object)

    return cut(F.when(F.octet_length(text) > limit, text.cast("binary")))


def split_spans(texts: DataFrame, text_id: str, text: str, limit: int, overlap: int) -> DataFrame:
    """The pieces of texts of more than ``limit`` bytes, by position: ``text_id``, ``text``, ``piece`` (from 0), ``first_byte``
    and ``end_byte`` of the piece, ``new_byte`` (where the part begins that the piece before doesn't have), ``cut``: what the
    piece starts at (start, section, paragraph, row, line, sentence, word or hard), and ``unbroken``: whether a stretch of more
    than ``limit`` bytes without white space was cut, as every text is that has one. Only such a stretch is cut inside a word, and only where it
    has no sentence end, as scripts without spaces have."""
    over = texts.where(F.octet_length(F.col(text)) > limit).select(F.col(text_id).alias("id"), F.col(text).alias("text"))
    return over.withColumn("cuts", _cuts(F.col("text"), limit, overlap)).select(
        F.col("id").alias(text_id), "text", F.posexplode("cuts").alias("piece", "c")
    ).select(text_id, "text", "piece", "c.*")


def split_texts(texts: DataFrame, text_id: str, text: str, limit: int, overlap: int) -> DataFrame:
    """All texts as pieces of at most ``limit`` bytes: ``text_id``, ``piece`` (from 0), ``first_byte``, ``new_byte``, ``n_tokens``,
    ``cut`` and ``piece_text``.

    Texts that fit are one piece. Null texts give no piece, empty ones an empty piece. Bytes that are no UTF-8 are kept as
    they are. ``text_id`` needn't be unique: rows are cut one by one, and repeated rows give repeated pieces. Texts are read
    once."""
    size = F.octet_length("text")
    whole = F.array(
        F.struct(
            F.lit(0).alias("first_byte"),
            F.lit(0).alias("new_byte"),
            size.alias("end_byte"),
            F.lit("start").alias("cut"),
            F.lit(False).alias("unbroken"),
        )
    ).cast(PIECES)
    held = texts.where(F.col(text).isNotNull()).select(F.col(text_id).alias("id"), F.col(text).alias("text"))
    found = held.withColumn("cuts", _cuts(F.col("text"), limit, overlap)).select(
        "id", "text", F.posexplode(F.coalesce("cuts", whole)).alias("piece", "c")
    ).select("id", "text", "piece", "c.*")
    length = F.col("end_byte") - F.col("first_byte")
    part = F.when(length == size, F.col("text")).otherwise(
        F.substring(F.col("text").cast("binary"), F.col("first_byte") + 1, length).cast("string")
    )
    return found.select(
        F.col("id").alias(text_id), "piece", "first_byte", "new_byte", length.alias("n_tokens"), "cut", part.alias("piece_text")
    )


TOKEN_PIECES = "array<struct<first_byte:int,new_byte:int,end_byte:int,n_tokens:int,cut:string>>"


def split_tokens(texts: DataFrame, text_id: str, text: str, limit: int, overlap: int, vocabulary: str) -> DataFrame:
    """All texts as pieces of at most ``limit`` tokens of a byte-level BPE, whose ranks file ``vocabulary`` every executor must be
    able to read, by position: ``text_id``, ``piece`` (from 0), ``first_byte``, ``new_byte``, ``end_byte``, ``n_tokens``, ``cut``.

    Cuts and cases as in :func:`split_texts`; the tokens of a piece are counted as they are when it is encoded alone. What is
    repeated has at most ``overlap`` tokens, and about as many where words allow it."""
    if not 0 <= overlap <= limit - 4:
        raise ValueError("overlap must be from 0 to limit - 4: a character may have four tokens")

    @F.pandas_udf(TOKEN_PIECES)
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokens = bpe_counter(vocabulary)
        for batch in batches:
            found: list[list[dict] | None] = []
            for t in batch:
                data = bytes(t)
                size = lru_cache(None)(lambda a, b: tokens(data[a:b]))  # noqa: B023, used at once
                pieces = spans(data, limit, overlap, size) if size(0, len(data)) > limit else [(0, 0, len(data), "start")]
                found.append([{"first_byte": a, "new_byte": b, "end_byte": c, "n_tokens": size(a, c), "cut": d} for a, b, c, d in pieces])
            yield pd.Series(found, dtype=object)

    held = texts.where(F.col(text).isNotNull()).select(F.col(text_id).alias("id"), cut(F.col(text).cast("binary")).alias("cuts"))
    return held.select(F.col("id").alias(text_id), F.posexplode("cuts").alias("piece", "c")).select(text_id, "piece", "c.*")
