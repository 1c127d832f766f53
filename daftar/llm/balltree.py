"""Exact ranked lexical search over sparse ball trees.

A document is a sparse vector of integers over the terms of the searched items, an item a sparse
vector of term weights, and the score their inner product. Every task reads its documents in pages
of bounded size and builds a ball tree over each page: nodes have a centroid and a radius, so
Cauchy-Schwarz bounds the score of every document below a node. The terms are dealt into blocks of
similar weight and a node is a ball in each block, which keeps the bound near the query's own
terms. A search pops the node with the highest bound until that bound is below the score of the
tenth document; leaves are scored exactly, in 64-bit integers. What a task found in earlier pages
keeps pruning the later ones. Documents stay where they lie: only the best of each task travel.

Bounds are computed in doubles and widened by more than their rounding can be, so that a document
is never lost to it; a bound equal to the tenth score is still followed, because ties go by id.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daftar.llm.common import Scratch, slices
from daftar.operators.ranking import top_k

_SEPARATORS = bytes(b for b in range(128) if not chr(b).isalnum())
_TERMS = bytes.maketrans(_SEPARATORS + bytes(range(65, 91)), b" " * len(_SEPARATORS) + bytes(range(97, 123)))
TOP = 10
_PAGE_DOCS, _PAGE_VALUES = 4096, 1 << 20  # of one tree
_LEAF, _BALLS = 32, 48
_CHUNK_CHARS = 4_000_000  # of items that are searched, and broadcast, together
_SLACK = 1e-9  # of sums of up to a million doubles that are not negative, 1e-10 would do
_LAST = np.iinfo(np.int64).max  # stands for a null id, which comes last


def terms(text: bytes | None) -> list[bytes]:
    """Maximal runs of ASCII letters and digits and of bytes beyond ASCII, A-Z lower-cased."""
    return (text or b"").translate(_TERMS).split()


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class Items:
    """The searched items: for each its terms as numbers, and the weight of each times its repeats."""

    def __init__(self, starts: np.ndarray, codes: np.ndarray, values: np.ndarray, weights: np.ndarray) -> None:
        self.starts, self.codes, self.values = starts, codes, values
        self.scale = np.sqrt(weights.astype(np.float64))  # both sides take half of a term's weight
        order = np.argsort(-weights, kind="stable")
        self.ball = np.empty(len(weights), np.int64)  # the block of each term
        self.ball[order] = np.arange(len(weights)) * _BALLS // max(1, len(weights))

    def __len__(self) -> int:
        return len(self.starts) - 1


class Tree:
    """A ball tree over one page: documents ``ids`` with ``values`` at ``codes``, row by row from ``starts``."""

    def __init__(self, ids: np.ndarray, starts: np.ndarray, codes: np.ndarray, values: np.ndarray, items: Items) -> None:
        self.lows: list[int] = []
        self.highs: list[int] = []
        self.children: list[tuple[int, int] | None] = []
        self._parts: list[tuple[np.ndarray, np.ndarray]] = []
        self._radii: list[np.ndarray] = []
        local, at = np.unique(codes, return_inverse=True)
        self._local, scaled = local, values * items.scale[codes]
        order = self._grow(starts, at, scaled, items.ball[local])
        sizes = np.diff(starts)[order]
        self.starts = np.concatenate([[0], np.cumsum(sizes)])
        take = np.repeat(starts[order] - self.starts[:-1], sizes) + np.arange(self.starts[-1])
        self.ids, self.codes, self.values = ids[order], codes[take], values[take]
        # Centroids by term, so that a query only reads those of its own terms.
        nodes = np.repeat(np.arange(len(self._parts)), [len(p[0]) for p in self._parts])
        columns, heights = (np.concatenate([p[k] for p in self._parts]) for k in (0, 1))
        by_term = np.argsort(columns, kind="stable")
        self._nodes, self._heights = nodes[by_term], heights[by_term]
        self._column = np.searchsorted(columns[by_term], np.arange(len(local) + 1))
        self.radii = np.array(self._radii)
        del self._parts, self._radii

    def _grow(self, starts: np.ndarray, at: np.ndarray, scaled: np.ndarray, ball: np.ndarray) -> np.ndarray:
        """Make the nodes; the order of the documents, so that each node holds a range of them."""
        order = np.arange(len(starts) - 1)
        sizes = np.diff(starts)
        width = len(ball)
        todo = [(0, len(order), self._node(0, len(order)))]
        while todo:
            low, high, number = todo.pop()
            mine = order[low:high]
            lengths = sizes[mine]
            take = np.repeat(starts[mine] - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum())
            column, value = at[take], scaled[take]
            doc = np.repeat(np.arange(len(mine)), lengths)
            centre = np.bincount(column, value, width) / len(mine)
            self._parts[number] = (np.flatnonzero(centre), centre[centre > 0])
            own = np.bincount(ball, centre * centre, _BALLS)
            moved = (value - centre[column]) ** 2 - centre[column] ** 2
            apart = np.bincount(doc * _BALLS + ball[column], moved, len(mine) * _BALLS).reshape(-1, _BALLS) + own
            norms = np.bincount(doc * _BALLS + ball[column], value * value, len(mine) * _BALLS).reshape(-1, _BALLS)
            # What cancels out may be off by the rounding of what went in.
            self._radii[number] = np.sqrt((np.maximum(apart, 0) + _SLACK * (norms + own)).max(axis=0))
            if len(mine) <= _LEAF:
                continue
            first = int(np.argmax(apart.sum(axis=1)))
            to_first = self._dots(column, value, doc, first, width, len(mine))
            square = norms.sum(axis=1)
            second = int(np.argmax(square - 2 * to_first))
            lean = 2 * (self._dots(column, value, doc, second, width, len(mine)) - to_first)
            half = len(mine) // 2
            order[low:high] = mine[np.argsort(lean, kind="stable")]
            left, right = self._node(low, low + half), self._node(low + half, high)
            self.children[number] = (left, right)
            todo += [(low, low + half, left), (low + half, high, right)]
        return order

    @staticmethod
    def _dots(column: np.ndarray, value: np.ndarray, doc: np.ndarray, pivot: int, width: int, n: int) -> np.ndarray:
        one = np.zeros(width)
        one[column[doc == pivot]] = value[doc == pivot]
        return np.bincount(doc, one[column] * value, n)

    def _node(self, low: int, high: int) -> int:
        self.lows.append(low)
        self.highs.append(high)
        self.children.append(None)
        self._parts.append((np.empty(0, np.int64), np.empty(0)))
        self._radii.append(np.zeros(_BALLS))
        return len(self.lows) - 1

    def bounds(self, codes: np.ndarray, values: np.ndarray, items: Items) -> np.ndarray:
        """For every node, no less than the score of any document below it."""
        # score = sum of (value / scale) * (height * scale); a term of weight 0 has value 0
        scale = items.scale[codes]
        asked = np.divide(values, scale, out=np.zeros(len(codes)), where=scale > 0)
        norms = np.sqrt(np.bincount(items.ball[codes], asked * asked, _BALLS))
        total = self.radii @ norms
        place = np.searchsorted(self._local, codes)
        known = np.flatnonzero(place < len(self._local))
        known = known[self._local[place[known]] == codes[known]]
        low, high = self._column[place[known]], self._column[place[known] + 1]
        lengths = high - low
        if lengths.sum():
            take = np.repeat(low - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum())
            total += np.bincount(self._nodes[take], self._heights[take] * np.repeat(asked[known], lengths), len(total))
        return total * (1 + _SLACK) + 1

    def search(self, dense: np.ndarray, bounds: np.ndarray, best: tuple[np.ndarray, np.ndarray], k: int):
        """``best`` (scores, ids) with this page's documents; ``dense`` has the query's values by term.

        Also the number of leaves that were scored.
        """
        floor = best[0][-1] if len(best[0]) == k else 1
        queue = [(-bounds[0], 0)]
        leaves = 0
        while queue and -queue[0][0] >= floor:
            _, number = heapq.heappop(queue)
            pair = self.children[number]
            if pair:
                for child in pair:
                    if bounds[child] >= floor:
                        heapq.heappush(queue, (-bounds[child], child))
                continue
            leaves += 1
            low, high = self.lows[number], self.highs[number]
            first, last = self.starts[low], self.starts[high]
            scores = np.add.reduceat(dense[self.codes[first:last]] * self.values[first:last], self.starts[low:high] - first)
            good = np.flatnonzero(scores >= floor)
            if len(good):
                scores, ids = np.concatenate([best[0], scores[good]]), np.concatenate([best[1], self.ids[low:high][good]])
                kept = np.lexsort((ids, -scores))[:k]
                best = scores[kept], ids[kept]
                floor = best[0][-1] if len(kept) == k else 1
        return best, leaves


def _pages(parts: Iterator[pa.RecordBatch], n_docs: int, n_terms: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(ids, starts, codes, values) of bounded numbers of documents that hold a searched term."""
    held, docs, size = [], 0, 0
    for part in parts:
        for piece in slices(part, 4 << 20):
            ids = piece.column(0).fill_null(_LAST).to_numpy()
            lengths = piece.column(2).value_lengths().to_numpy().astype(np.int64)
            n = np.repeat(piece.column(1).to_numpy(), lengths)
            codes, tf = (piece.column(c).flatten().to_numpy().astype(np.int64) for c in (2, 3))
            m = 25 + 75 * n * n_docs // n_terms
            held.append((ids[lengths > 0], lengths[lengths > 0], codes, 1_000_000_000 * tf // (1000 * tf + 8 * m)))
            docs, size = docs + len(held[-1][0]), size + len(codes)
            if docs >= _PAGE_DOCS or size >= _PAGE_VALUES:
                yield _page(held)
                held, docs, size = [], 0, 0
    if docs:
        yield _page(held)


def _page(held: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    ids, lengths, codes, values = (np.concatenate([h[k] for h in held]) for k in range(4))
    return ids, np.concatenate([[0], np.cumsum(lengths)]), codes, values


def _search_chunk(docs: DataFrame, asked: list[tuple[int | None, list[bytes]]], scratch: Scratch, name: str, k: int) -> DataFrame:
    spark = docs.sparkSession
    codes = {t: c for c, t in enumerate(sorted({t for _, own in asked for t in own}))}
    shared = spark.sparkContext.broadcast(codes)

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for piece in (p for part in parts for p in slices(part)):
            sizes, found, times, starts = [], [], [], [0]
            for text in piece.column(1).to_pylist():
                own = terms(text)
                sizes.append(len(own))
                for term, n in Counter(own).items():
                    code = known.get(term)
                    if code is not None:
                        found.append(code)
                        times.append(n)
                starts.append(len(found))
            lists = (pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(v, pa.int32())) for v in (found, times))
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(sizes, pa.int64()), *lists], ["doc_id", "n", "codes", "times"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    counted = texts.mapInArrow(count, "doc_id long, n long, codes array<int>, times array<int>").where("n > 0")
    counted = scratch.put(counted, f"terms-{name}")
    facts = counted.agg(F.count("*").alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    held = counted.select(F.explode("codes").alias("code")).groupBy("code").count().toArrow()  # no more rows than terms are asked
    df = np.zeros(len(codes), np.int64)
    df[held["code"].to_numpy()] = held["count"].to_numpy()
    weights = np.array([weight(facts.docs, int(d)) for d in df], np.int64)
    starts, flat, values = [0], [], []
    for _, own in asked:
        for term, times in sorted(Counter(own).items()):
            flat.append(codes[term])
            values.append(times * int(weights[codes[term]]))
        starts.append(len(flat))
    items = spark.sparkContext.broadcast(Items(np.array(starts), np.array(flat, np.int64), np.array(values, np.int64), weights))
    n_docs, n_terms = facts.docs, facts.terms

    def find(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = items.value
        none = np.empty(0, np.int64)
        best = [(none, none)] * len(queries)
        dense = np.zeros(len(queries.scale), np.int64)
        for page in _pages(parts, n_docs, n_terms):
            tree = Tree(*page, queries)
            for q in range(len(queries)):
                part = slice(queries.starts[q], queries.starts[q + 1])
                own, value = queries.codes[part], queries.values[part]
                dense[own] = value
                best[q], _ = tree.search(dense, tree.bounds(own, value, queries), best[q], k)
                dense[own] = 0
        numbers = np.repeat(np.arange(len(best)), [len(b[0]) for b in best])
        scores, ids = (np.concatenate([b[c] for b in best] or [none]) for c in (0, 1))
        yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array(ids, mask=ids == _LAST), pa.array(scores)], ["q", "doc_id", "score"])

    found = counted.select("doc_id", "n", "codes", "times").mapInArrow(find, "q int, doc_id long, score long")
    best = top_k(found, ["q"], [F.col("score").desc(), F.col("doc_id").asc_nulls_last()], k)
    names = spark.createDataFrame(
        pa.table({"q": pa.array(range(len(asked)), pa.int32()), "item_id": pa.array([i for i, _ in asked], pa.int64())})
    )
    return best.join(F.broadcast(names), "q").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, item_id: str = "item_id", k: int = TOP, chunk_chars: int = _CHUNK_CHARS) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` documents of the highest score above 0 for each item.

    The score of a document adds up, over an item's terms with repeats, a weight that falls with
    the number of documents that hold the term, times a share that grows with its occurrences and
    falls with the document's length; all in integers. Equal scores go by doc_id, a null one last.

    Null texts and texts without a term match nothing and are not counted. Rows that repeat a doc_id
    are documents of their own; items that repeat id and text count once, and an id with several
    texts has a list for each. An empty table on either side gives an empty result; further columns
    are not read. Items are searched in chunks of about ``chunk_chars`` characters, each in one pass.
    """
    scratch = Scratch(docs.sparkSession, "balltree")
    rows = items.select(F.col(item_id).cast("long").alias("item_id"), F.col("text").cast("binary").alias("text")).where("text IS NOT NULL").distinct()
    rows = scratch.put(rows, "items")
    size = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    chunks = max(1, -(-size // chunk_chars))
    found = []
    for number in range(chunks):
        # About chunk_chars bytes: a bounded part of the stated items, never of the documents.
        mine = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(chunks)) == number).toArrow()
        asked = [(i, own) for i, own in zip(mine["item_id"].to_pylist(), map(terms, mine["text"].to_pylist()), strict=True) if own]
        found.append(_search_chunk(docs, asked, scratch, str(number), k))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents WHERE text IS NOT NULL),
     b AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
     facts AS (SELECT count(*) AS n_docs, sum(len(terms))::BIGINT AS n_terms FROM d WHERE len(terms) > 0),
     t AS MATERIALIZED (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(terms) AS n, unnest(terms) AS term FROM d) u GROUP BY ALL),
     w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM t, facts GROUP BY term, n_docs),
     s AS (SELECT item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_terms))))::BIGINT AS score
           FROM b JOIN w USING (term) JOIN t USING (term), facts GROUP BY item_id, r, doc_id)
SELECT item_id, rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM s WHERE score > 0) x
WHERE rank <= 10
"""
