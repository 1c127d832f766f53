"""Heading-aware chunking.

A document stays one row until its pieces are final, so the whole step is a scan and a
projection: nothing is shuffled, and numbering pieces inside a document needs no window.
"""

from __future__ import annotations

import re
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daftar import settings as S
from daftar.functions import text as T

_DECOR = f"{T.MARKS}{T.FORMATS}"
_GAP = rf"[ \t\x0B\f\r\x1C-\x1F\x85\p{{Z}}{_DECOR}]*"
_DIGIT = "0-9٠-٩۰-۹"


def _spelled(word: str) -> str:
    return "".join(f"{letter}[{_DECOR}]*" for letter in word)


# A heading line: optional article, the word for "article", optional "number", optional
# parentheses, digits in any script. Decoration may sit between any two letters.
ARABIC_HEADING = (
    rf"{_GAP}(?:{_spelled('ال')})?{_spelled('مادة')}{_GAP}(?:{_spelled('رقم')}{_GAP})?"
    rf"\(?{_GAP}([{_DIGIT}][{_DIGIT}{_DECOR}]*){_GAP}\)?[{_DECOR}]*"
)

SECTION_TYPE = "array<struct<article:string,body:string>>"


_MARK = "\ufdd0"


def split_articles(text, heading: str = ARABIC_HEADING, decor: str = _DECOR, blank: str = T.SPACE) -> Column:
    """Array of (article, body) sections in order; article NULL for text before the first heading.

    ``heading`` must capture the article number in group 1. Headings start their line; a heading
    with nothing under it yields no section, and neither does a NULL or blank text. ``decor`` are
    the characters that may stand before a heading, ``blank`` those that are nothing; either goes
    into a character class.
    """
    # Decoration before a heading stays with what precedes it, however long it is. A cut is the mark
    # and a one; marks of the text itself are a mark and a zero until the cutting is done.
    before = f"[{decor}]*+" if decor else ""
    starts = rf"(?md)^({before})(?={heading})"
    at_head = rf"(?d)\A(?:{heading})"

    def section(part: Column) -> Column:
        number = T.normalize_digits(T.strip_formatting(T.strip_diacritics(F.regexp_extract(part, at_head, 1))))
        return F.struct(F.nullif(number, F.lit("")).alias("article"), part.alias("body"))

    def kept(part: Column) -> Column:
        return F.regexp_replace(part, at_head, "").rlike(f"[^{blank}]")

    text = T._col(text)
    own, cut = F.lit(_MARK + "0"), _MARK + "1"
    parts = F.split(F.regexp_replace(F.replace(text, F.lit(_MARK), own), starts, f"$1{cut}"), cut)
    parts = F.transform(parts, lambda part: F.replace(part, own, F.lit(_MARK)))
    headed = F.transform(F.filter(parts, kept), section)
    whole = F.array(F.struct(F.lit(None).cast("string").alias("article"), text.alias("body")))
    nothing = F.array().cast(SECTION_TYPE)
    # Most documents have no heading; one anchored scan spares them the splitting.
    return F.when(text.rlike(rf"(?md)^{before}(?:{heading})"), headed).when(text.rlike(f"[^{blank}]"), whole).otherwise(nothing)


_BREAK = re.compile(r"\s")
_TO_NEXT_WORD = re.compile(r"\S*\s*")
_ROWS_AT_ONCE = 64


def _windows(text: str, limit: int, overlap: int) -> list[str]:
    """Overlapping windows of at most ``limit`` characters, cut at white space where there is any."""
    if len(text) <= limit:
        return [text] if text else []
    breaks = [m.start() for m in _BREAK.finditer(text)]
    pieces, start = [], 0
    while True:
        end = start + limit
        if end >= len(text):
            tail = text[start:].strip()
            return [*pieces, tail] if tail else pieces
        at = bisect_left(breaks, end) - 1
        on_word = at >= 0 and breaks[at] > start
        if on_word:
            end = breaks[at]
        piece = text[start:end].strip()
        if piece:
            pieces.append(piece)
        if not on_word:
            start = end  # inside one unbroken run: go on exactly where the cut fell
            continue
        start = max(start + 1, end - overlap)
        if not text[start - 1].isspace():
            start = _TO_NEXT_WORD.match(text, start).end()
        if start >= len(text):
            return pieces


def _window_udf(limit: int, overlap: int):
    overlap = min(overlap, limit // 2)
    kind = pa.list_(pa.list_(pa.string()))

    @F.arrow_udf("array<array<string>>")
    def windows(bodies: pa.Array) -> pa.Array:
        # A few documents at a time are Python strings; the rest stays as it came or is done.
        done = [pa.array([], kind)]
        for at in range(0, len(bodies), _ROWS_AT_ONCE):
            rows = bodies.slice(at, _ROWS_AT_ONCE).to_pylist()
            found = [None if row is None else [_windows(body, limit, overlap) for body in row] for row in rows]
            done.append(pa.array(found, kind))
        return pa.concat_arrays(done)

    return windows


def _numbered(pieces: Column) -> Column:
    """Number pieces per article, in n log n steps. Documents of one article take the linear branch.

    Sorted by article, each article is a run, and a run counts from 0; sorting back by place deals
    the numbers out. No lambda refers to a whole array, which would be evaluated once per element.
    """
    placed = F.transform(pieces, lambda p, i: F.struct(p.article.isNull().alias("none"), F.coalesce(p.article, F.lit("")).alias("name"), i.alias("place")))
    runs = F.array_sort(placed)
    nothing = F.struct(F.lit(None).cast("boolean").alias("none"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("int").alias("place"))
    before = F.concat(F.array(nothing), F.slice(runs, F.lit(1), F.greatest(F.size(runs) - 1, F.lit(0))))
    opens = F.zip_with(runs, before, lambda one, last: ~(one["none"].eqNullSafe(last["none"]) & one["name"].eqNullSafe(last["name"])))
    starts = F.filter(F.transform(opens, lambda first, j: F.when(first, j)), lambda j: j.isNotNull())
    ends = F.concat(F.slice(starts, F.lit(2), F.greatest(F.size(starts) - 1, F.lit(0))), F.array(F.size(runs)))
    counted = F.flatten(F.zip_with(starts, ends, lambda low, high: F.sequence(F.lit(0), high - low - 1)))
    dealt = F.array_sort(F.zip_with(runs, counted, lambda one, n: F.struct(one["place"].alias("place"), n.alias("seq"))))
    one_article = F.size(F.array_distinct(F.transform(pieces, lambda p: F.coalesce(p.article, F.lit(""))))) <= 1
    by_place = F.transform(pieces, lambda p, i: p.withField("seq", i.cast("int")))
    by_article = F.zip_with(pieces, dealt, lambda p, d: p.withField("seq", d["seq"].cast("int")))
    return F.when(one_article | (F.size(pieces) == 0), by_place).otherwise(by_article)


def _pieces(docs: DataFrame, limit: int, overlap: int, heading: str) -> DataFrame:
    if limit < 1:
        raise ValueError("max_chars must be >= 1")
    if overlap < 0:
        raise ValueError("overlap_chars must be >= 0")
    sections = docs.withColumn("_sections", F.when(~T.is_blank("text"), split_articles("text", heading)))
    bodies = F.transform("_sections", lambda s: T.strip(s.body))
    split = sections.withColumn("_bodies", bodies).drop("text")
    long = F.exists("_bodies", lambda b: F.length(b) > limit)
    # Only documents with an over-long section send text to Python; the rest send a NULL.
    split = split.withColumn("_windows", _window_udf(limit, overlap)(F.when(long, F.col("_bodies"))))
    short = F.transform("_bodies", lambda b: F.array(b))
    split = split.withColumn("_windows", F.coalesce("_windows", short))
    nested = F.zip_with(
        "_sections",
        "_windows",
        lambda s, ws: F.transform(ws, lambda w: F.struct(s.article.alias("article"), w.alias("text"))),
    )
    return split.withColumn("_pieces", F.flatten(nested)).drop("_sections", "_bodies", "_windows")


def chunk_documents(
    docs: DataFrame,
    max_chars: int = S.MAX_CHUNK_CHARS,
    overlap: int = S.CHUNK_OVERLAP,
    heading: str = ARABIC_HEADING,
) -> DataFrame:
    """(doc_id, text) -> chunk rows (id, doc_id, article, seq, text, text_normalized).

    Pieces whose index form is empty are skipped before numbering, and a number is unique per
    (document, article) even when a heading repeats.
    """
    pieces = _pieces(docs.select("doc_id", "text"), max_chars, overlap, heading)
    kept = F.filter("_pieces", lambda p: ~T.normalizes_to_blank(p.text))
    pieces = pieces.withColumn("_pieces", kept).withColumn("_pieces", _numbered(F.col("_pieces")))
    # The outer form on purpose: a plain explode makes the optimizer add a size filter below it,
    # which would evaluate the whole splitting expression a second time.
    rows = pieces.select("doc_id", F.explode_outer("_pieces").alias("p")).where(F.col("p").isNotNull())
    rows = rows.select("doc_id", "p.*")
    marker = F.coalesce("article", F.lit(S.PREAMBLE_MARKER))
    return rows.select(
        F.concat_ws(":", "doc_id", marker, "seq").alias("id"),
        "doc_id",
        "article",
        "seq",
        "text",
        T.normalize_for_index("text").alias("text_normalized"),
    )


def chunk_stats(
    docs: DataFrame,
    max_chars: int = S.MAX_CHUNK_CHARS,
    overlap: int = S.CHUNK_OVERLAP,
    heading: str = ARABIC_HEADING,
) -> DataFrame:
    """One row: documents read, chunks written, pieces skipped as empty."""
    pieces = _pieces(docs.select("doc_id", "text"), max_chars, overlap, heading)
    skipped = F.filter("_pieces", lambda p: T.normalizes_to_blank(p.text))
    return pieces.agg(
        F.count(F.lit(1)).alias("documents"),
        F.coalesce(F.sum(F.size("_pieces") - F.size(skipped)), F.lit(0)).alias("chunks_written"),
        F.coalesce(F.sum(F.size(skipped)), F.lit(0)).alias("chunks_skipped"),
    )
