"""Licence scan: winnowed fingerprints of templates pick candidates, banded alignment confirms and measures them.

Templates and texts are read as lower-cased words. Every few words of a template have a hash; of each few such hashes
in a row the smallest (the rightmost of equal ones) is a fingerprint, and an inverted index lists for each fingerprint
the templates and places that have it. How many words and hashes follows from the wanted coverage: if that share of a
template's words is there and the others are changed or missing, a run of words stays in which one fingerprint lies: pairs of
words, of which one of two is picked, at 0.75. Of templates of up to 16 words the fingerprints are single words, so many
that the missing ones cannot be all of them; so words may be added anywhere as well. (In a longer one additions that
split every such run, three words at 0.75, can hide a text.) A hit counts only if the text around it has
enough of the template's words, in any order, which no match can do without. The hits are taken in the text's order: a
local alignment (match 2, mismatch and gap -1) of the template with the text, in a band around the hit's diagonal,
gives the matched words and their span; further hits are aligned with what is left.

The index depends on the templates alone and goes to the executors with the task. Each document is scanned by
itself, so nothing is shuffled and a template in a third of all documents is no hot key.

Defined cases: a null or empty text has no matches; a template may match a text several times, each with its span;
matches of one template do not overlap, those of different templates may; spans count characters of
the whole text, the end excluded; repeated rows, and rows with a null id, are scanned each; texts of any length are
scanned whole; an empty table gives an empty result; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrykit.llm.common import slices, splitmix

WORD = re.compile(r"[^\W_]+")
GRAM, WINDOW = 5, 4
SHORT = 16


class Vocabulary(dict):
    """Numbers of the templates' words; 0 for all others."""

    def __missing__(self, word: str) -> int:
        return 0


def gram_hashes(ids: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k numbers in a row; 0 where one of them is 0."""
    n = len(ids) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h, known = np.full(n, k, np.uint64), np.ones(n, bool)
    for j in range(k):
        part = ids[j : j + n]
        h = splitmix(h) + part.astype(np.uint64)
        known &= part > 0
    return np.where(known, splitmix(h) | np.uint64(1), np.uint64(0))


def winnow(hashes: np.ndarray, window: int = WINDOW) -> list[int]:
    """Places of the smallest hash in each window, the rightmost of equal ones."""
    if len(hashes) <= window:
        return [len(hashes) - 1 - int(hashes[::-1].argmin())] if len(hashes) else []
    picked = {i + window - 1 - int(hashes[i : i + window][::-1].argmin()) for i in range(len(hashes) - window + 1)}
    return sorted(picked)


def grams(n: int, least: float) -> tuple[int, int]:
    """Words in a gram and grams in a window, so that any text with ``least`` of a template's n words has a fingerprint."""
    wanted = max(1, math.ceil(least * n - 1e-9))
    lost = n - wanted
    if n <= SHORT:
        # each of n // w windows side by side has a word of its own among the fingerprints
        return 1, max([w for w in range(1, WINDOW + 1) if n // w > lost], default=1)
    run = math.ceil(wanted / (lost + 1))  # the others cut the wanted words into so many runs at most
    k = max(1, min(GRAM, run - 1))
    return k, min(WINDOW, run - k + 1)


def align(template: np.ndarray, text: np.ndarray, low: int, high: int) -> tuple[int, int, int]:
    """Matched words and the span (first and last place in ``text``) of the best local alignment with template place
    i at text places i + low to i + high; (0, 0, -1) if nothing matches."""
    width = high - low + 1
    before = [(0, 0, 0)] * (width + 1)  # score, matches, first place; by place in the band
    best = (0, 0, 0, -1)
    for i in range(len(template)):
        word, row, left = template[i], [], (0, 0, 0)
        for d in range(width):
            j = i + low + d
            if not 0 <= j < len(text):
                cell = (0, 0, 0)
            else:
                s, m, f = before[d]
                if word == text[j]:
                    cell = (s + 2, m + 1, f if s else j)
                else:
                    up = before[d + 1]
                    cell = max((s - 1, m, f), (left[0] - 1, left[1], left[2]), (up[0] - 1, up[1], up[2]), key=lambda c: c[:2])
                    if cell[0] <= 0:
                        cell = (0, 0, 0)
                if cell[0] > best[0]:
                    best = (*cell, j)
            row.append(cell)
            left = cell
        before = [*row, (0, 0, 0)]
    return best[1], best[2], best[3]


class Scanner:
    def __init__(self, templates: dict[str, str], least: float):
        self.least = least
        self.vocabulary = Vocabulary()
        self.names, self.words = sorted(templates), []
        for name in self.names:
            words = WORD.findall(templates[name].lower())
            self.words.append(np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words], np.int64))
        index: dict[int, dict[int, list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))
        self.picked: list[list[int]] = []  # the places of each template's fingerprints
        for t, ids in enumerate(self.words):
            k, window = grams(len(ids), least)
            hashes = gram_hashes(ids, k)
            self.picked.append(winnow(hashes, window))
            for at in self.picked[-1]:
                index[k][int(hashes[at])].append((t, at))
        self.index = {k: (np.array(sorted(v), np.uint64), dict(v)) for k, v in index.items()}
        size = len(self.vocabulary) + 1
        self.counts = [np.bincount(ids, minlength=size) for ids in self.words]
        self.wanted = [max(1, math.ceil(least * len(ids) - 1e-9)) for ids in self.words]
        self.bands = [4 + len(ids) // 10 for ids in self.words]

    def roomy(self, t: int, ids: np.ndarray) -> np.ndarray | None:
        """For each diagonal, from that of the template's last word on the text's first: whether the text around it has
        enough words of the template; None if nowhere."""
        n, band = len(self.words[t]), self.bands[t]
        if len(ids) < self.wanted[t]:
            return None
        known = np.concatenate([[0], np.cumsum(self.counts[t][ids] > 0)])
        if known[-1] < self.wanted[t]:
            return None
        d = np.arange(1 - n, len(ids))
        enough = known[np.clip(d + n + band, 0, len(ids))] - known[np.clip(d - band, 0, len(ids))] >= self.wanted[t]
        return enough if enough.any() else None

    def holds(self, t: int, d: int, free: np.ndarray) -> bool:
        """Whether what is left around a diagonal has enough of the template's words, each as often as there."""
        part = free[max(0, d - self.bands[t]) : max(0, d + len(self.words[t]) + self.bands[t])]
        own = np.bincount(part[part > 0], minlength=len(self.counts[t]))
        return int(np.minimum(own, self.counts[t]).sum()) >= self.wanted[t]

    def hits(self, ids: np.ndarray) -> dict[int, list[tuple[int, int]]]:
        """By template: (diagonal, place in the text) of every fingerprint found."""
        out = defaultdict(list)
        rooms = {t: room for t in range(len(self.words)) if (room := self.roomy(t, ids)) is not None}
        if not rooms:
            return out
        for k, (keys, places) in self.index.items():
            if k == 1:  # a word's fingerprint is the word: only templates with room are looked up
                for t in rooms:
                    if grams(len(self.words[t]), self.least)[0] == 1:
                        for i in self.picked[t]:
                            j = np.flatnonzero(ids == self.words[t][i])
                            j = j[rooms[t][j - i + len(self.words[t]) - 1]]
                            out[t] += [(x - i, x) for x in j.tolist()]
                continue
            hashes = gram_hashes(ids, k)
            some = np.flatnonzero(hashes)
            some = some[np.isin(hashes[some], keys)]
            for j in some.tolist():
                for t, i in places[int(hashes[j])]:
                    if t in rooms and rooms[t][j - i + len(self.words[t]) - 1]:
                        out[t].append((j - i, j))
        return {t: hits for t, hits in out.items() if hits}

    def scan(self, text: str | None) -> list[tuple[str, int, int, int, int]]:
        """(template, its words, matched words, start, end) of each match."""
        if not text:
            return []
        low = text.lower()
        words = WORD.findall(low)
        ids = np.fromiter(map(self.vocabulary.__getitem__, words), np.int64, len(words))
        hits = self.hits(ids)
        if not hits:
            return []
        if len(low) == len(text):
            spans = [m.span() for m in WORD.finditer(low)]
        else:  # lower-casing has changed the length; the words are then cut in the text as it is
            spans = [m.span() for m in WORD.finditer(text)]
            ids = np.fromiter((self.vocabulary[text[a:b].lower()] for a, b in spans), np.int64, len(spans))
            hits = self.hits(ids)
        out = []
        for t, places in sorted(hits.items()):
            template, free, tried = self.words[t], ids.copy(), set()
            band = self.bands[t]
            for d, j in sorted(places, key=lambda p: (p[1], p[0])):
                if free[j] < 0 or d in tried or not self.holds(t, d, free):
                    continue
                matched, first, last = align(template, free, d - band, d + band)
                if matched >= self.least * len(template):
                    out.append((self.names[t], len(template), matched, spans[first][0], spans[last][1]))
                    free[first : last + 1] = -1  # the next match is sought in what is left
                else:
                    tried.add(d)
        return out


def scan(docs: DataFrame, templates: dict[str, str], least: float = 0.75) -> DataFrame:
    """One row for each match: doc_id, template, template_words, matched_words, coverage, span_start, span_end."""

    def run(batches):
        scanner = Scanner(templates, least)
        for batch in slices(batches):
            rows = [(i, *m) for i, t in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()) for m in scanner.scan(t)]
            ids, names, n, m, a, b = zip(*rows) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(names, pa.string()), pa.array(n, pa.int32()), pa.array(m, pa.int32()), pa.array([x / y for x, y in zip(m, n)], pa.float64()), pa.array(a, pa.int32()), pa.array(b, pa.int32())],
                names=["doc_id", "template", "template_words", "matched_words", "coverage", "span_start", "span_end"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, template string, template_words int, matched_words int, coverage double, span_start int, span_end int")
