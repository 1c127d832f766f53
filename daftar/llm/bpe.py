"""Byte-level BPE with DuckDB inside each task.

A task splits its texts into words by the tokenizer's pattern and encodes each different word once.
Words become tokens per byte; a recursive query joins each word's token positions with the merge
table and contracts the leftmost pair of the smallest rank, until a step changes no word. Decoding
joins token positions with the vocabulary and puts the bytes together by an ordered aggregation.

Words longer than ``_LONG`` bytes take the same steps on a table that is replaced in each step, and
one step contracts every place of the smallest pair, from the left: the same result, because in a
vocabulary made by merging, no pair that a merge brings about ranks before that merge.
"""

from __future__ import annotations

import base64
import hashlib
import re
import unicodedata
import uuid
from collections.abc import Iterable, Iterator
from functools import lru_cache

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daftar.llm.common import KEPT, let_go, slices

_LONG = 192
_BLOCK = 4_000_000  # sum of squared word lengths in one recursive query: bounds what it keeps
_MOST_WORDS = 100_000  # words met lately that a worker remembers, besides as many of those before them
#: White space of Unicode, as the pattern's \s has it. Fixed values.
_SPACES = r"\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

_ENCODE = """
WITH RECURSIVE steps(step, word, tokens) AS (
  SELECT 0, word, list(token ORDER BY place) FROM start GROUP BY word
  UNION ALL
  (WITH positions AS (
     SELECT word, unnest(tokens[:-2]) * 65536 + unnest(tokens[2:]) AS pair, generate_subscripts(tokens[2:], 1) AS place
     FROM steps WHERE len(tokens) > 1),
   best AS (SELECT word, min(rank * 4294967296 + place) AS first FROM positions JOIN merges USING (pair) GROUP BY word)
   SELECT step + 1, word, list_concat(
     list_append(tokens[:(first % 4294967296) - 1], first // 4294967296), tokens[(first % 4294967296) + 2:])
   FROM steps JOIN best USING (word)))
SELECT word, arg_max(tokens, step) AS ids FROM steps GROUP BY word ORDER BY word
"""

_LONG_STEP = """
CREATE OR REPLACE TEMP TABLE long_next AS
WITH pairs AS (SELECT place, token, token * 65536 + lead(token) OVER (ORDER BY place) AS pair,
                      row_number() OVER (ORDER BY place) AS number FROM long_word),
  least AS (SELECT min(rank) AS rank FROM pairs JOIN merges USING (pair)),
  hit AS (SELECT number, number - row_number() OVER (ORDER BY number) AS run
          FROM pairs JOIN merges USING (pair) JOIN least USING (rank)),
  taken AS (SELECT number FROM (SELECT number, row_number() OVER (PARTITION BY run ORDER BY number) AS nth FROM hit) h WHERE nth % 2 = 1)
SELECT p.place, CASE WHEN t.number IS NULL THEN p.token ELSE (SELECT rank FROM least) END AS token
FROM pairs p LEFT JOIN taken t ON t.number = p.number LEFT JOIN taken gone ON gone.number = p.number - 1
WHERE gone.number IS NULL
"""

_DECODE = """
SELECT word, string_agg(hexes, '' ORDER BY place) AS hexes
FROM positions JOIN vocabulary USING (token) GROUP BY word ORDER BY word
"""


def read_ranks(spark: SparkSession, path: str) -> dict[bytes, int]:
    """The rank file's tokens. It is a parameter of bounded size and read by the driver alone."""
    if "://" in path:
        lines = spark.read.text(path).toArrow()["value"].to_pylist()
    else:
        with open(path, encoding="ascii") as file:
            lines = file.read().splitlines()
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def merge_table(ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Each pair of tokens, as left * 65536 + right, whose bytes together are a token, and its rank."""
    pairs, merged = [], []
    for token, rank in ranks.items():
        for cut in range(1, len(token)):
            left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
            if left is not None and right is not None:
                pairs.append(left * 65536 + right)
                merged.append(rank)
    return np.array(pairs, np.int64), np.array(merged, np.int64)


@lru_cache(1)
def _quick_pattern() -> re.Pattern:
    """The pattern with its letter and number classes written out for texts of 16-bit code points."""

    def ranges(kind: str) -> str:
        points = [c for c in range(0x10000) if unicodedata.category(chr(c))[0] == kind]
        breaks = [k for k in range(1, len(points)) if points[k] != points[k - 1] + 1]
        starts, ends = [0, *breaks], [*(b - 1 for b in breaks), len(points) - 1]
        return "".join(f"\\u{points[a]:04x}-\\u{points[b]:04x}" for a, b in zip(starts, ends, strict=True))

    letter, number = ranges("L"), ranges("N")
    return re.compile(
        f"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{number}]+| ?[^{_SPACES}{letter}{number}]+"
        f"|[{_SPACES}]+(?![^{_SPACES}])|[{_SPACES}]+"
    )


def splitter(pattern: str, quick: bool):
    """Splits a text into the words of ``pattern``; ``quick`` if it is the pattern written out above."""
    full = regex.compile(pattern).findall
    fast = _quick_pattern().findall if quick else full

    def split(text: str) -> list[str]:
        narrow = text.isascii() or len(text.encode("utf-16-le", "surrogatepass")) == 2 * len(text)
        return (fast if narrow else full)(text)

    return split


class Codec:
    """A worker's DuckDB with the merge table and the vocabulary, and the words met lately.

    Words are kept in two generations: when the younger one is full it becomes the older one, and
    words that are met again move back. What is met often is never encoded twice.
    """

    def __init__(self, ranks: dict[bytes, int], pairs: np.ndarray, merged: np.ndarray) -> None:
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "128MB"})
        self.db.register("given", pa.table({"pair": pairs, "rank": merged}))
        self.db.execute("CREATE TABLE merges AS SELECT * FROM given")
        tokens = pa.table({"token": list(ranks.values()), "hexes": [t.hex() for t in ranks]})
        self.db.register("named", tokens)
        self.db.execute("CREATE TABLE vocabulary AS SELECT * FROM named")
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.words: dict[str, tuple[int, str, bytes]] = {}  # word -> number of tokens, ids as text, decoded bytes
        self.before: dict[str, tuple[int, str, bytes]] = {}

    def close(self) -> None:
        self.db.close()
        self.words.clear()
        self.before.clear()

    def age(self) -> None:
        """Between pieces of work: keep two generations of words at most."""
        if len(self.words) > _MOST_WORDS:
            self.words, self.before = {}, self.words

    def _positions(self, lists: list) -> pa.Table:
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        flat = np.concatenate([np.asarray(x, np.int64) for x in lists]) if lists else np.empty(0, np.int64)
        starts = np.repeat(np.cumsum(sizes) - sizes, sizes)
        return pa.table({"word": np.repeat(np.arange(len(lists)), sizes), "place": np.arange(len(flat)) - starts, "token": flat})

    def _long(self, raw: bytes) -> list[int]:
        ids = self.single[np.frombuffer(raw, np.uint8)]
        self.db.register("given_word", pa.table({"place": np.arange(len(ids)), "token": ids}))
        self.db.execute("CREATE OR REPLACE TEMP TABLE long_word AS SELECT * FROM given_word")
        count = len(ids)
        while True:
            self.db.execute(_LONG_STEP)
            left = self.db.execute("SELECT count(*) FROM long_next").fetchone()[0]
            if left == count:
                break
            self.db.execute("CREATE OR REPLACE TEMP TABLE long_word AS SELECT * FROM long_next")
            count = left
        return self.db.execute("SELECT token FROM long_word ORDER BY place").fetchnumpy()["token"].tolist()

    def encode(self, words: list[str]) -> list[list[int]]:
        """The token ids of each word."""
        raws = [w.encode("utf-8", "surrogatepass") for w in words]
        out: list = [None] * len(raws)
        block: list[int] = []
        load = 0
        for k, raw in enumerate(raws):
            if len(raw) > _LONG:
                out[k] = self._long(raw)
                continue
            block.append(k)
            load += len(raw) ** 2
            if load > _BLOCK:
                self._block(raws, block, out)
                block, load = [], 0
        if block:
            self._block(raws, block, out)
        return out

    def _block(self, raws: list[bytes], block: list[int], out: list) -> None:
        sizes = np.array([len(raws[k]) for k in block])
        flat = self.single[np.frombuffer(b"".join(raws[k] for k in block), np.uint8)]
        starts = np.repeat(np.cumsum(sizes) - sizes, sizes)
        table = pa.table({"word": np.repeat(np.arange(len(block)), sizes), "place": np.arange(len(flat)) - starts, "token": flat})
        self.db.register("start", table)
        found = self.db.sql(_ENCODE).to_arrow_table()
        for k, ids in zip(found["word"].to_pylist(), found["ids"].to_pylist(), strict=True):
            out[block[k]] = ids
        self.db.unregister("start")

    def decode(self, lists: list[list[int]]) -> list[bytes]:
        """The bytes of each list of token ids; ids outside the vocabulary have none."""
        out = [b""] * len(lists)
        self.db.register("positions", self._positions(lists))
        for k, hexes in self.db.execute(_DECODE).fetchall():
            out[k] = bytes.fromhex(hexes)
        self.db.unregister("positions")
        return out

    def learn(self, words: Iterable[str]) -> None:
        """Encode the words not met before, and decode what came out."""
        fresh = []
        for word in set(words).difference(self.words):
            known = self.before.pop(word, None)
            if known is None:
                fresh.append(word)
            else:
                self.words[word] = known
        fresh.sort()
        for at in range(0, len(fresh), 12_000):
            some = fresh[at : at + 12_000]
            ids = self.encode(some)
            for word, row, raw in zip(some, ids, self.decode(ids), strict=True):
                self.words[word] = (len(row), " ".join(map(str, row)), raw)


_kept: dict[str, Codec] = KEPT


def worker_codec(call: str, given) -> Codec:
    """The codec of a call, kept from task to task by the worker; one of an earlier call is closed, and any by another operator's task.

    What it remembers is bounded, and a lost worker only loses time.
    """
    if call not in _kept:
        let_go()
        _kept[call] = Codec(*given.value)
    return _kept[call]


def encode_texts(
    docs: DataFrame, ranks: dict[bytes, int], pattern: str, quick: bool = True, with_ids: bool = False
) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids]) of every whole text.

    ``ids_sha256`` hashes the decimal ids joined by one space, ``decoded_sha256`` the bytes that the
    ids decode to. A null text counts as empty: no tokens, and the hashes of nothing. Repeated rows
    get the same result; an empty table gives an empty one; further columns are not read.
    """
    pairs, merged = merge_table(ranks)
    given = docs.sparkSession.sparkContext.broadcast((ranks, pairs, merged))  # bounded: the vocabulary
    call = uuid.uuid4().hex
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from daftar.llm.bpe import worker_codec  # the worker's own module, which outlives the task

        codec, split = None, splitter(pattern, quick)
        for part in parts:
            for piece in slices(part, 2 << 20):
                codec = codec or worker_codec(call, given)
                codec.age()
                lists = [split(t) if t else [] for t in piece.column(1).to_pylist()]
                codec.learn(w for words in lists for w in words)
                known = codec.words
                counts, hashes, decoded, ids = [], [], [], []
                for words in lists:
                    found = [known[w] for w in words]
                    text = " ".join([f[1] for f in found])
                    counts.append(sum([f[0] for f in found]))
                    hashes.append(hashlib.sha256(text.encode()).hexdigest())
                    decoded.append(hashlib.sha256(b"".join([f[2] for f in found])).hexdigest())
                    if with_ids:
                        ids.append(np.array(text.split(), np.int32))
                arrays = [piece.column(0), pa.array(counts, pa.int64()), pa.array(hashes, pa.string()), pa.array(decoded, pa.string())]
                arrays += [pa.array(ids, pa.list_(pa.int32()))] * with_ids
                yield pa.RecordBatch.from_arrays(arrays, names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return rows.mapInArrow(run, schema)


def decode_ids(rows: DataFrame, ranks: dict[bytes, int], key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, raw binary): the bytes of each row's token ids; empty for a null or empty list."""
    pairs, merged = merge_table(ranks)
    given = rows.sparkSession.sparkContext.broadcast((ranks, pairs, merged))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = None
        for part in parts:
            for piece in slices(part, 2 << 20):
                codec = codec or Codec(*given.value)
                found = codec.decode([x or [] for x in piece.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(found, pa.binary())], [key, "raw"])
        if codec is not None:
            codec.close()

    kind = dict(rows.dtypes)[key]
    return rows.select(key, F.col(ids).cast("array<int>").alias(ids)).mapInArrow(run, f"`{key}` {kind}, raw binary")
