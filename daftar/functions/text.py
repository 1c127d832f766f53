"""Text scalars as column expressions.

Character classes are spelled out because the three regex dialects in play disagree:
Java's ``\\w`` is ASCII only, its Unicode variant also admits combining marks, and its
``\\s`` misses the separators a Unicode-aware strip removes.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from daftar import settings as S

# Code points dropped or folded on the way to the index form.
MARKS = "".join(map(chr, [*range(0x064B, 0x0653), 0x0670, 0x0640]))
FORMATS = "".join(
    map(chr, [0x00AD, *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2066, 0x206A), 0xFEFF])
)
LETTERS_FROM, LETTERS_TO = "أإآٱىةؤئ", "اااايهوي"
DIGITS_FROM = "".join(map(chr, [*range(0x0660, 0x066A), *range(0x06F0, 0x06FA)]))
DIGITS_TO = "0123456789" * 2

SPACE = r"\s\x0B\x1C-\x1F\x85\p{Z}"
WORD = r"[\p{L}\p{N}_]+"
# Presentation forms whose compatibility form is a space plus marks.
_BLANK_FORMS = r"\x{FC5E}-\x{FC63}\x{FCF2}-\x{FCF4}\x{FE70}-\x{FE72}\x{FE74}\x{FE76}-\x{FE7F}"


# Covers every character a step of the index form could touch (white space aside). Two ranges on
# purpose: this class is scanned over every text to decide whether the folding steps run at all.
_TOUCHED = r"[\xA0-\xBE\x{100}-\x{10FFFF}]"


def _col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def strip(text) -> Column:
    """Trim every kind of Unicode white space, not only U+0020."""
    return F.regexp_extract(_col(text), rf"(?s)\A[{SPACE}]*(.*[^{SPACE}])", 1)


def is_blank(text) -> Column:
    return ~_col(text).rlike(rf"[^{SPACE}]")


def strip_diacritics(text) -> Column:
    return F.translate(_col(text), MARKS, "")


def strip_formatting(text) -> Column:
    return F.translate(_col(text), FORMATS, "")


def normalize_letters(text) -> Column:
    return F.translate(_col(text), LETTERS_FROM, LETTERS_TO)


def normalize_digits(text) -> Column:
    return F.translate(_col(text), DIGITS_FROM, DIGITS_TO)


def nfkc(text) -> Column:
    """Compatibility composition inside the JVM, through the ICU library Spark ships for collations."""
    text = _col(text)
    composed = F.reflect(
        F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(True)
    )
    return F.when(text.rlike(r"[^\x{0}-\x{7F}]"), composed).otherwise(text)


def fold(text) -> Column:
    """Drop marks and formatting, fold letters and digits of text that is already NFKC."""
    # Deletions and one-to-one folds are one pass: translate drops what has no counterpart.
    return F.translate(
        _col(text), LETTERS_FROM + DIGITS_FROM + MARKS + FORMATS, LETTERS_TO + DIGITS_TO
    )


def collapse(text) -> Column:
    """Every run of white space becomes one space; the ends are trimmed."""
    # Matches only runs that are not already a single space, which are rare.
    runs = rf"(?: [{SPACE}]|[{SPACE}&&[^ ]])[{SPACE}]*"
    return F.trim(F.regexp_replace(_col(text), runs, " "))


def normalize_for_index(text) -> Column:
    """Index form of a text. Lossy and idempotent; letter case is kept."""
    text = _col(text)
    return collapse(F.when(text.rlike(_TOUCHED), fold(nfkc(text))).otherwise(text))


normalize_query = normalize_for_index  # one function: the two forms must never drift apart


def normalizes_to_blank(text) -> Column:
    """Whether the index form is empty, decided without normalizing."""
    blank = f"[{SPACE}{MARKS}{FORMATS}{_BLANK_FORMS}]*"
    return _col(text).rlike(rf"\A{blank}\z")


def tokens(normalized) -> Column:
    """Word tokens of an index-form text, case kept."""
    return F.regexp_extract_all(_col(normalized), F.lit(f"({WORD})"), 1)


def lexical_tokens(normalized) -> Column:
    """Lower-cased tokens, as the full-text leg indexes them."""
    return tokens(F.lower(_col(normalized)))


def query_terms(
    question, max_chars: int = S.MAX_TOKEN_CHARS, max_tokens: int = S.MAX_QUERY_TOKENS
) -> Column:
    """Distinct search terms: over-long tokens dropped, then the first ``max_tokens`` kept."""
    kept = F.filter(tokens(normalize_query(question)), lambda t: F.length(t) <= max_chars)
    return F.array_distinct(F.transform(F.slice(kept, 1, max_tokens), F.lower))


def estimate_tokens(text) -> Column:
    """Characters over three, rounded up."""
    n = F.coalesce(F.length(_col(text)), F.lit(0))
    return ((n + (S.CHARS_PER_TOKEN - 1)) / S.CHARS_PER_TOKEN).cast("long")


def excerpt(text, limit: int = S.EXCERPT_CHARS) -> Column:
    text = _col(text)
    head = F.regexp_replace(F.substring(text, 1, limit), rf"[{SPACE}]+\z", "")
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(head, F.lit("…")))


def render_hit(article, chunk_id, text, label: str = S.ARTICLE_LABEL) -> Column:
    """A chunk as the prompt shows it, headed by its article or else its id."""
    article = _col(article)
    named = F.concat(F.lit(f"{label} "), F.when(article != "", article))
    return F.concat(F.lit("["), F.coalesce(named, _col(chunk_id)), F.lit("]\n"), _col(text))


# Code points an answer may contain.
ALLOWED_IN_ANSWERS = (
    r"\x{20}-\x{7E}\x{600}-\x{6FF}\x{750}-\x{77F}\x{8A0}-\x{8FF}\x{2000}-\x{206F}"
    r"\x{FB50}-\x{FDFF}\x{FE70}-\x{FEFF}\t\n\r\x{A0}\x{AB}\x{BB}"
)


def foreign_characters(text) -> Column:
    """Distinct characters from outside the allowed scripts, first seen first."""
    # What is allowed goes in long runs; a match for every other character would cost an object each.
    found = F.regexp_replace(_col(text), f"[{ALLOWED_IN_ANSWERS}]+", "")
    return F.array_distinct(F.filter(F.split(found, ""), lambda c: c != ""))


def is_corrupted(text) -> Column:
    return _col(text).rlike(f"[^{ALLOWED_IN_ANSWERS}]")


def guard_digits(normalized) -> Column:
    return F.regexp_extract_all(_col(normalized), F.lit(r"(\p{Nd}+)"), 1)


def guard_key(normalized, negations: tuple[str, ...] = S.NEGATIONS) -> Column:
    """(digit runs in order, negation particles) of an index-form query."""
    found = F.array_intersect(tokens(normalized), F.array(*map(F.lit, negations)))
    return F.struct(guard_digits(normalized).alias("digits"), F.array_sort(found).alias("negations"))


def is_refusal_text(answer, refusals=tuple(S.REFUSALS.values())) -> Column:
    """Whether an answer opens with one of the refusal sentences."""
    answer = strip(answer)
    verdict = F.lit(False)
    for sentence in refusals:
        verdict = verdict | answer.startswith(sentence.rstrip("."))
    return verdict


def pipeline_key(config, depth, context_depth, rerank, provider, model) -> Column:
    """Everything except the question that decides an answer."""
    return F.concat_ws(
        "|",
        _col(config),
        F.concat(F.lit("r"), _col(depth).cast("string")),
        F.concat(F.lit("c"), _col(context_depth).cast("string")),
        F.concat(F.lit("rr"), _col(rerank).cast("int").cast("string")),
        F.concat(_col(provider), F.lit(":"), _col(model)),
    )


def with_prefix(text, model_key: str, kind: str) -> Column:
    """Prefix a text the way the embedding model expects a query or a passage."""
    query, passage = S.PREFIXES.get(model_key, ("", ""))
    return F.concat(F.lit(query if kind == "query" else passage), _col(text))


def document_reject_reason(doc_id, title, text, source_url) -> Column:
    """First rule a posted document breaks, or NULL."""
    doc_id, title, text, url = map(_col, (doc_id, title, text, source_url))
    id_rule = rf"\A[A-Za-z0-9][A-Za-z0-9._-]{{0,{S.MAX_DOC_ID_CHARS - 1}}}\z"
    rules = [
        (doc_id.isNull() | (F.length(doc_id) < 1), "doc_id: missing"),
        (F.length(doc_id) > S.MAX_DOC_ID_CHARS, "doc_id: too long"),
        (doc_id.contains(":"), "doc_id: colon"),
        (~doc_id.rlike(id_rule), "doc_id: bad characters"),
        (title.isNull() | is_blank(title), "title: missing or blank"),
        (F.length(title) > S.MAX_TITLE_CHARS, "title: too long"),
        (text.isNull() | is_blank(text), "text: missing or blank"),
        (F.length(text) > S.MAX_TEXT_CHARS, "text: too long"),
        (F.length(url) > S.MAX_URL_CHARS, "source_url: too long"),
        (~(url.startswith("http://") | url.startswith("https://")), "source_url: not http(s)"),
    ]
    return F.coalesce(*(F.when(broken, F.lit(reason)) for broken, reason in rules))


def cited_scores(citations_json) -> Column:
    """Stored citations, in either historical shape, as an array of (chunk_id, score)."""
    items = F.from_json(_col(citations_json), "array<string>")

    def parse(item: Column) -> Column:
        is_object = item.startswith("{")
        cited = F.get_json_object(item, "$.chunk_id")
        number = F.get_json_object(item, "$.score").try_cast("double")
        scored = F.struct(cited.alias("chunk_id"), F.coalesce(number, F.lit(0.0)).alias("score"))
        return F.when(is_object & cited.isNotNull(), scored).when(
            ~is_object & ~item.rlike(r"\A(\[.*|[-0-9.eE+]+|true|false|null)\z"),
            F.struct(item.alias("chunk_id"), F.lit(0.0).alias("score")),
        )

    return F.filter(F.transform(items, parse), lambda pair: pair.isNotNull())


def slice_between(text, start, end) -> Column:
    """Text from the start marker up to the end marker; NULL when a wanted marker is missing.

    The end marker is searched from the start marker on; an empty or NULL marker is not wanted.
    """
    text = _col(text)
    start = F.coalesce(_col(start), F.lit(""))
    end = F.coalesce(_col(end), F.lit(""))
    begin = F.when(start == "", F.lit(1)).otherwise(F.position(start, text))
    stop = F.when(end == "", F.length(text) + 1).otherwise(F.position(end, text, begin))
    found = (begin > 0) & (stop > 0)
    return F.when(found, strip(F.substring(text, begin, stop - begin)))
