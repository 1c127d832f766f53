"""Language identification with spans.

The scripts of a word's letters name the languages it can belong to. Within those, character
n-grams score the word for each language, and a Viterbi pass over the words, with a penalty for
every switch, labels spans of mixed-language text. A text's language is the one whose spans hold
most letters.

The model is a naive Bayes table over a fixed number of hashed n-grams, so its size depends on the
number of languages alone. It is fitted on at most about ``sample`` texts per language, taken by a
hash of the text itself.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daftar.llm.common import over_rows, slices

_BITS = 16
BUCKETS = 1 << _BITS
SAMPLE = 4000
UNKNOWN = "und"
_RUN = re.compile(r"[^\W\d_]+")
_WORD = re.compile(r"\b[^\W\d_]+\b")

#: First code points of blocks and their scripts; a block reaches up to the next. Fixed values.
SCRIPTS = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"),
    (0x0600, "arabic"), (0x0700, "other"), (0x0750, "arabic"), (0x0780, "other"), (0x08A0, "arabic"),
    (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "gurmukhi"), (0x0A80, "gujarati"), (0x0B00, "oriya"),
    (0x0B80, "tamil"), (0x0C00, "telugu"), (0x0C80, "kannada"), (0x0D00, "malayalam"), (0x0D80, "sinhala"),
    (0x0E00, "thai"), (0x0E80, "lao"), (0x0F00, "tibetan"), (0x1000, "myanmar"), (0x10A0, "georgian"),
    (0x1100, "hangul"), (0x1200, "ethiopic"), (0x13A0, "other"), (0x1780, "khmer"), (0x1800, "mongolian"),
    (0x18B0, "other"), (0x1D00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x2C60, "latin"), (0x2C80, "other"),
    (0x2DE0, "cyrillic"), (0x2E00, "other"), (0x3040, "kana"), (0x3100, "other"), (0x31F0, "kana"), (0x3200, "other"),
    (0x3400, "han"), (0xA000, "other"), (0xA640, "cyrillic"), (0xA6A0, "other"), (0xA720, "latin"), (0xA800, "other"),
    (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "latin"), (0xFB13, "other"), (0xFB50, "arabic"),
    (0xFE00, "other"), (0xFE70, "arabic"), (0xFF00, "latin"), (0xFF66, "kana"), (0xFFA0, "hangul"), (0xFFE0, "other"),
    (0x20000, "han"), (0x32000, "other"),
)
_STARTS = np.array([start for start, _ in SCRIPTS])
_NAMES = sorted({name for _, name in SCRIPTS})
_NUMBERS = np.array([_NAMES.index(name) for _, name in SCRIPTS])




def runs(text: str | None) -> list[str]:
    """Words as lower-cased runs of letters; runs that touch a digit only where there are no others.

    Pieces of keys and hashes are no words of any language.
    """
    low = (text or "").lower()
    return _WORD.findall(low) or _RUN.findall(low)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def scripts_of(words: list[str]) -> np.ndarray:
    """The number of the script of each word's first letter."""
    first = np.fromiter((ord(w[0]) for w in words), np.int64, len(words))
    return _NUMBERS[np.searchsorted(_STARTS, first, side="right") - 1]


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hash buckets of the words' 1- to 4-grams, word edges marked, and the number of the word of each."""
    if not words:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    code = np.frombuffer(f" {' '.join(words)} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    edge = code == 32
    word = np.cumsum(edge) - 1
    buckets, owners = [], []
    inside = np.ones(len(code), bool)  # no edge strictly inside the gram
    mixed = np.zeros(len(code), np.uint32)
    for n in range(1, 5):
        count = len(code) - n + 1
        mixed = mixed[:count] * np.uint32(0x01000193) ^ code[n - 1 :]
        if n > 2:
            inside = inside[:count] & ~edge[n - 2 : n - 2 + count]
        valid = inside[:count] & ~edge[:count] if n == 1 else inside[:count].copy()
        if n == 2:
            valid &= ~(edge[:count] & edge[1 : 1 + count])
        h = (mixed[valid] ^ np.uint32(n)) * np.uint32(0x9E3779B1)
        buckets.append((h >> np.uint32(32 - _BITS)).astype(np.int64))
        owners.append(word[:count][valid])
    return np.concatenate(buckets), np.concatenate(owners)


class Model:
    """Scores of words in each language: a table of log probabilities and the scripts each language uses."""

    def __init__(self, languages: list[str], table: np.ndarray, allowed: np.ndarray, switch: float) -> None:
        """``table`` has a row per bucket, ``allowed`` one per script, both a column per language."""
        self.languages, self.table, self.allowed, self.switch = languages, table, allowed, switch

    def scores(self, words: list[str]) -> np.ndarray:
        """A row per word; 0 for its best language, and very low outside the languages of its script."""
        bucket, owner = grams(words)
        total = np.column_stack(
            [np.bincount(owner, self.table[bucket, k], len(words)) for k in range(len(self.languages))]
        )
        fits = self.allowed[scripts_of(words)]
        nowhere = ~fits.any(axis=1)  # a script no language uses says nothing
        total = np.where(fits, total, -np.inf)
        total[nowhere] = 0.0
        total -= total.max(axis=1, keepdims=True)
        return np.maximum(total, -1e4)

    def paths(self, scores: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The best language number of each word; texts of ``sizes`` words follow each other in ``scores``.

        All texts of the batch take their steps together, the longest first, so that those still
        running are a prefix.
        """
        states = scores.shape[1]
        starts = np.cumsum(sizes) - sizes
        order = np.argsort(-sizes, kind="stable")
        starts, sizes = starts[order], sizes[order]
        stay = np.ones((len(scores), states), bool)
        jump = np.zeros(len(scores), np.int16)
        alive = int((sizes > 0).sum())
        value = scores[starts[:alive]].copy()
        final = np.zeros((len(sizes), states))
        at = 0
        longer = len(sizes) - np.searchsorted(sizes[::-1], np.arange(1, int(sizes.max(initial=0)) + 2), side="left")
        while alive:
            at += 1
            left = int(longer[at])  # texts of more than ``at`` words
            final[left:alive] = value[left:alive]
            alive = left
            if not alive:
                break
            value = value[:alive]
            rows = starts[:alive] + at
            top = value.argmax(axis=1)
            switched = value[np.arange(alive), top] - self.switch
            keep = value >= switched[:, None]
            stay[rows], jump[rows] = keep, top
            value = np.where(keep, value, switched[:, None]) + scores[rows]
        path = np.zeros(len(scores), np.int64)
        alive = int((sizes > 0).sum())
        state = final.argmax(axis=1)
        ends = starts + sizes - 1
        step = 0
        live = np.arange(alive)
        while len(live):
            rows = ends[live] - step
            path[rows] = state[live]
            more = sizes[live] - 1 > step
            live, rows = live[more], rows[more]
            state[live] = np.where(stay[rows, state[live]], state[live], jump[rows])
            step += 1
        return path

    def label(self, texts: list[str | None]) -> list[tuple[list[str], np.ndarray]]:
        """The words of each text, and the language number of each on its best path."""
        lists = [runs(t) if self.languages and has_letter(t) else [] for t in texts]
        number: dict[str, int] = {}
        codes = np.fromiter(
            (number.setdefault(w, len(number)) for words in lists for w in words), np.int64, sum(map(len, lists))
        )
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        if not len(codes):
            return [(words, np.empty(0, np.int64)) for words in lists]
        path = self.paths(self.scores(list(number))[codes], sizes)
        return list(zip(lists, np.split(path, np.cumsum(sizes)[:-1]), strict=True))

    def predict(self, texts: list[str | None], most_chars: int = 1_500_000) -> list[tuple[str, float]]:
        """Language and the share of letters in its spans; ``und`` and 0 for a text without a letter.

        Texts are labelled together in groups of ``most_chars`` characters, which bounds the arrays;
        a longer text is a group of its own.
        """
        out, group, size = [], [], 0
        for text in texts:
            if group and size + len(text or "") > most_chars:
                out += self._predict(group)
                group, size = [], 0
            group.append(text)
            size += len(text or "")
        return out + self._predict(group)

    def _predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        out = []
        for words, path in self.label(texts):
            if not words:
                out.append((UNKNOWN, 0.0))
                continue
            weight = np.bincount(path, np.fromiter(map(len, words), np.int64, len(words)), len(self.languages))
            top = int(weight.argmax())
            out.append((self.languages[top], float(weight[top] / weight.sum())))
        return out


def fit(labelled: DataFrame, sample: int = SAMPLE, switch: float = 12.0, seed: int = 7) -> Model:
    """A model from the rows (lang, text) of ``labelled``; null and empty texts and null languages teach nothing.

    The sample is every text whose hash lies below the share that leaves about ``sample`` texts of
    its language, so it does not depend on how the table is dealt out. What comes to the driver is
    a count per language, script and n-gram bucket.
    """
    rows = labelled.select(F.col("lang").cast("string").alias("lang"), "text").where("lang IS NOT NULL AND text <> ''")
    sizes = labelled.where("lang IS NOT NULL AND text IS NOT NULL").groupBy(F.col("lang").cast("string").alias("lang")).count()
    totals = {r["lang"]: r["count"] for r in sizes.collect()}
    languages = sorted(totals)
    if not languages:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros((len(_NAMES), 0), bool), switch)
    share = F.element_at(
        F.create_map(*(F.lit(x) for name in languages for x in (name, min(1.0, sample / totals[name])))), F.col("lang")
    )
    drawn = (F.shiftrightunsigned(F.xxhash64("text", F.lit(seed)), 12) / float(1 << 52)) < share

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per language, how often each bucket occurs and, below zero, the letters of each script."""
        seen: dict[str, np.ndarray] = {}
        for part in parts:
            for piece in slices(part, 4 << 20):
                for lang, text in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist(), strict=True):
                    words = runs(text)
                    if words:
                        into = seen.setdefault(lang, np.zeros(BUCKETS + len(_NAMES), np.int64))
                        into[:BUCKETS] += np.bincount(grams(words)[0], minlength=BUCKETS)
                        size = np.fromiter(map(len, words), np.int64, len(words))
                        into[BUCKETS:] += np.bincount(scripts_of(words), size, len(_NAMES)).astype(np.int64)
        for lang, into in seen.items():
            at = np.flatnonzero(into)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(into[at])], ["lang", "cell", "n"]
            )

    counted = rows.where(drawn).mapInArrow(count, "lang string, cell long, n long")
    total = counted.groupBy("lang", "cell").agg(F.sum("n").alias("n")).toArrow().to_pandas()
    cells = np.zeros((BUCKETS + len(_NAMES), len(languages)))
    cells[total["cell"].to_numpy(), [languages.index(x) for x in total["lang"]]] = total["n"].to_numpy()
    table = cells[:BUCKETS] + 0.5
    letters = cells[BUCKETS:]
    allowed = (letters > 0) & (letters >= 0.01 * letters.sum(axis=0))
    return Model(languages, np.log(table / table.sum(axis=0)), allowed, switch)


def predict(docs: DataFrame, model: Model, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The key columns with lang_pred and score for every row; the text alone decides.

    ``und`` for a null or empty text and one without a letter, or if nothing was learned. Ties go to
    the language that sorts first. Repeated rows get the same result; an empty table gives an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kinds = dict(docs.select(*keys).dtypes)

    def convert(*columns: list) -> pa.RecordBatch:
        own, texts = columns[:-1], columns[-1]
        found = shared.value.predict(texts)
        arrays = [pa.array(c, _ARROW[kinds[k]]) for k, c in zip(keys, own, strict=True)]
        arrays += [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
        return pa.RecordBatch.from_arrays(arrays, [*keys, "lang_pred", "score"])

    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", lang_pred string, score double"
    return over_rows(docs, [*keys, "text"], convert, schema)


_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}


def held_out(doc_id: str = "doc_id"):
    """Rows that teach nothing: crc32 of the id as text, modulo 4, is 2. Null ids are not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row, learned from the rows that are not held out."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "lang", "text")
    model = fit(rows.where(~F.col("held_out")), sample)
    return predict(rows, model, ("doc_id", "held_out"))


def accept(docs: DataFrame, least: float = 0.4, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` with a language, whose spans hold the share ``least`` of the letters; all columns kept."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs.where(~held_out()), sample))

    @F.pandas_udf("boolean")
    def stays(texts):
        found = model.value.predict([t if isinstance(t, str) else None for t in texts])
        return pd.Series([lang != UNKNOWN and share >= least for lang, share in found], dtype=bool)

    return docs.where(stays("text"))
