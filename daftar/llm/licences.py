"""Licence scan: matching statistics from a generalised suffix automaton of licence tokens.

The automaton holds every run of words of every template in space linear in the templates, which
are a bounded list. A text is streamed through it word by word: the state after each word is the
longest run of words, ending there, that some template holds, and that length is the matching
statistic. Peaks of it are maximal matches; matches that follow each other in text and template are
chained into spans of a template, and a template counts as found where a chain covers enough of it.
Texts are only scanned where they stand: the job has no shuffle.
"""

from __future__ import annotations

import re
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daftar.llm.common import over_rows
from daftar.llm.licence_texts import BASE, TEMPLATES

#: Words of raw UTF-8: ASCII digits and lower-case letters, and all non-ASCII characters.
_WORDS = re.compile(rb"[0-9a-z\x80-\xff]+")


def tokenize(text: str | None) -> list[bytes]:
    return _WORDS.findall((text or "").encode("utf-8", "surrogatepass").lower())


class Automaton:
    """Generalised suffix automaton over word numbers, with the templates each state stands in.

    ``ends[state]`` maps each template that holds the state's word runs to all end positions of them
    there (words counted from 1), in order. Templates are a bounded list, and so are these.
    """

    def __init__(self, sequences: list[list[int]]) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[dict[int, list[int]]] = [{}]
        for number, sequence in enumerate(sequences):
            last = 0
            for place, word in enumerate(sequence, 1):
                last = self._extend(last, word)
                self.ends[last].setdefault(number, []).append(place)
        for state in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            parent = self.ends[self.link[state]]
            for number, places in self.ends[state].items():
                parent[number] = sorted({*places, *parent.get(number, ())})
        self.ends[0] = {}

    def _state(self, length: int, edges: dict[int, int], link: int) -> int:
        self.next.append(edges)
        self.length.append(length)
        self.link.append(link)
        self.ends.append({})
        return len(self.length) - 1

    def _split(self, state: int, word: int) -> int:
        """The state after ``word`` that is exactly one word longer than ``state``, made if need be."""
        old = self.next[state][word]
        if self.length[old] == self.length[state] + 1:
            return old
        copy = self._state(self.length[state] + 1, dict(self.next[old]), self.link[old])
        self.link[old] = copy
        while state >= 0 and self.next[state].get(word) == old:
            self.next[state][word] = copy
            state = self.link[state]
        return copy

    def _extend(self, last: int, word: int) -> int:
        if word in self.next[last]:
            return self._split(last, word)
        new = self._state(self.length[last] + 1, {}, 0)
        state = last
        while state >= 0 and word not in self.next[state]:
            self.next[state][word] = new
            state = self.link[state]
        if state >= 0:
            self.link[new] = self._split(state, word)
        return new

    def stream(self, words: list[int], least: int) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
        """(end, length, state) of each maximal match, where the matching statistic cannot grow on, and of each
        place where it is ``least`` or more. Ends are exclusive."""
        out, every = [], []
        state = length = 0
        edges, link, sizes = self.next, self.link, self.length
        for at, word in enumerate(words):
            if word < 0:  # in no template
                if length:
                    out.append((at, length, state))
                    state = length = 0
                continue
            target = edges[state].get(word)
            if target is None:
                if length:
                    out.append((at, length, state))
                while target is None and state:
                    state = link[state]
                    length = sizes[state]
                    target = edges[state].get(word)
                if target is None:
                    continue
            state, length = target, length + 1
            if length >= least:
                every.append((at + 1, length, state))
        if length:
            out.append((len(words), length, state))
        return out, every

    def own_matches(self, every: list[tuple[int, int, int]], least: int) -> dict[int, list[tuple[int, int, list[int]]]]:
        """(end, length, places) of each template's own maximal matches of ``least`` words or more.

        A template need not hold all of a run that goes on in another one: the longest part of it that
        ends at a place and stands in the template is found up the suffix links.
        """
        found: dict[int, list[tuple[int, int, list[int]]]] = {}
        current: dict[int, tuple[int, int, list[int]]] = {}
        for end, length, state in every:
            seen: dict[int, tuple[int, list[int]]] = {}
            while length >= least:
                for number, places in self.ends[state].items():
                    seen.setdefault(number, (length, places))
                state = self.link[state]
                length = self.length[state]
            for number, (size, places) in seen.items():
                last = current.get(number)
                if last and last[:2] != (end - 1, size - 1):
                    found.setdefault(number, []).append(last)
                current[number] = (end, size, places)
        for number, last in current.items():
            found.setdefault(number, []).append(last)
        return found


class Scanner:
    """Templates and base phrases, numbered once; ``scan`` is what a task runs on each text."""

    def __init__(self, templates: dict[str, tuple[str, ...]], base: dict[str, str], least: int, cover: float, gap: int) -> None:
        self.number: dict[bytes, int] = {}
        self.labels, sequences = [], []
        for label, texts in templates.items():
            for text in texts:
                self.labels.append(label)
                sequences.append([self.number.setdefault(w, len(self.number)) for w in tokenize(text)])
        self.templates = len(sequences)
        self.phrases = []
        for label, phrase in base.items():
            row = [self.number.setdefault(w, len(self.number)) for w in tokenize(phrase)]
            self.phrases.append((len(sequences), label, len(row)))
            self.labels.append(label)
            sequences.append(row)
        self.sizes = [len(s) for s in sequences]
        self.automaton = Automaton(sequences)
        self.least, self.cover, self.gap = least, cover, gap
        self.whole = {}  # base phrase -> its words
        for number, label, size in self.phrases:
            self.whole[number] = (label, size, tuple(sequences[number]))

    def base_places(self, numbers: list[int], matches: list[tuple[int, int, int]]) -> list[tuple[int, str]]:
        """(start, label) of each place of a base phrase; each lies inside one maximal match."""
        found = set()
        for end, length, _ in matches:
            run = numbers[end - length : end]
            for label, size, phrase in self.whole.values():
                for at in range(length - size + 1):
                    if run[at] == phrase[0] and tuple(run[at : at + size]) == phrase:
                        found.add((end - length + at, label))
        return sorted(found)

    def spans(self, every: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int]]:
        """(template, start, end, covered words): the chains of each template's matches that cover enough of it.

        A chain goes forward in text and template and skips at most ``gap`` words in the text between
        matches. Of chains that overlap in the text, of whichever templates, the one that covers most of
        its template stands, then the longest, then the earliest; a text with many notices has a span
        for each, and a notice that resembles others is one label.
        """
        rivals = []
        for number, parts in self.automaton.own_matches(every, self.least).items():
            if number >= self.templates:
                continue
            chains: list[tuple[int, int, int, int]] = []  # text end, template end, start, covered
            open_chains: list[tuple[int, int, int, int]] = []
            for end, length, places in parts:
                start = end - length
                open_chains = [c for c in open_chains if start - c[0] <= self.gap]
                fresh_chains = []
                for place in places:
                    chain = (end, place, start, length)
                    for c in open_chains:
                        fresh = min(length, place - c[1], end - c[0])
                        if fresh > 0 and c[3] + fresh > chain[3]:
                            chain = (end, place, c[2], c[3] + fresh)
                    fresh_chains.append(chain)
                # One open chain per template place is enough: the fullest.
                open_chains = [c for c in open_chains if not any(f[1] == c[1] and f[3] >= c[3] for f in fresh_chains)] + fresh_chains
                chains += [c for c in fresh_chains if c[3] >= self.cover * self.sizes[number]]
            rivals += [(min(1.0, covered / self.sizes[number]), covered, start, end, number) for end, _, start, covered in chains]
        out, taken = [], []
        for _, covered, start, end, number in sorted(rivals, key=lambda c: (-c[0], -c[1], *c[2:])):
            at = bisect_left(taken, (start, end))
            if (at == 0 or taken[at - 1][1] <= start) and (at == len(taken) or taken[at][0] >= end):
                taken.insert(at, (start, end))
                out.append((number, start, end, covered))
        return out

    def scan(self, text: str | None) -> tuple:
        """(n_words, n_base, first_word, last_word, base_labels, labels, score, spans)."""
        words = tokenize(text)
        get = self.number.get
        numbers = [get(w, -1) for w in words]
        matches, every = self.automaton.stream(numbers, self.least)
        matches = [m for m in matches if m[1] >= 2]
        places = self.base_places(numbers, matches)
        base = {label for _, label in places}
        labels, score, spans = set(base), 1.0 if base else 0.0, []
        for number, start, end, covered in self.spans(every):
            share = min(1.0, covered / self.sizes[number])
            labels.add(self.labels[number])
            spans.append((self.labels[number], start, end, share))
            score = max(score, share)
        starts = [at for at, _ in places]
        return (
            len(words), len(places), min(starts, default=None), max(starts, default=None),
            ",".join(sorted(base)), ",".join(sorted(labels)), score, sorted(spans),
        )


def scan(
    docs: DataFrame, templates: dict[str, tuple[str, ...]] = TEMPLATES, base: dict[str, str] = BASE,
    least: int = 4, cover: float = 0.7, gap: int = 12,
) -> DataFrame:
    """Licence labels of every whole text, with the spans they rest on.

    ``labels`` has the base labels and those of templates of which a chain of matches, each of
    ``least`` words or more, covers the share ``cover``. ``score`` is the largest covered share, 1 for a
    base phrase, 0 without a label. ``spans`` has (label, start, end, share) of every such chain that
    no fuller one overlaps, words counted from 0 and ends exclusive.

    A null or empty text has no words and no labels; repeated rows get the same result, ties between
    chains go to the earlier one. An empty table gives an empty result; further columns are not read.
    """
    scanner = Scanner(templates, base, least, cover, gap)
    span = pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("share", pa.float64())])
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(span)]
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]

    def convert(ids: list, texts: list) -> pa.RecordBatch:
        rows = [scanner.scan(t) for t in texts]
        columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
        columns[-1] = [[dict(zip(("label", "start", "end", "share"), s, strict=True)) for s in r] for r in columns[-1]]
        arrays = [pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *arrays], ["doc_id", *names])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = (
        "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, "
        "labels string, score double, spans array<struct<label string, start long, end long, share double>>"
    )
    return over_rows(rows, ["doc_id", "text"], convert, schema)
