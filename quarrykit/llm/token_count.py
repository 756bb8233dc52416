"""Token counts of byte-level BPE by rank-synchronous merging of ragged arrays.

The pre-tokens of a window of texts are held as one flat numpy array of symbols, the sequences one after the other.
In every round each sequence finds the lowest rank among its adjacent pairs, and all places of that pair in it are
merged at once, in all sequences together; sequences without a pair that merges leave with their number of symbols.
Ranks are kept beside the symbols and looked up again only next to a merge. Pre-tokens are met again and again, so
that a bounded memo of counts serves most of them.

Merging all places of a pair at once is exact where every merge makes a symbol of its own and no pair ranks before the
merges that make its halves; that is checked when the file is read, and a tokenizer without that order merges one
place a round. A sequence of more than ``LONG`` bytes is merged place by place over a heap, as rounds over it would be
as many as its merges.

Defined cases: a null or empty text has 0 bytes and 0 tokens; a special string inside a text is one token, as in the
tokenizers library with its defaults; texts of any length are read whole; rows with a null or repeated doc_id count as
any other row; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
import json
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrykit.llm.bpe import Numbers, byte_characters, windows

LONG = 4096
#: Pre-tokens whose counts a task remembers.
ROOM = 200_000
NONE = np.iinfo(np.int32).max


def latin_splitter():
    """The splitting of byte-level BPE for texts up to U+024F, where Python's character tables agree with the library's.

    White space is spelled out, as Python counts four control characters more.
    """
    white, number = "\t-\r \x85\xa0", r"\d²³¹¼½¾"
    letter, other = rf"[^\W_{number}]", rf"(?:[^\w{white}]|_)"
    return re.compile(rf"'(?:[stmd]|re|ve|ll)| ?{letter}+| ?[{number}]+| ?{other}+|[{white}]+(?![^{white}])|[{white}]+").findall


BEYOND_LATIN = re.compile("[^\x00-ɏ]")


class ByteBpe:
    """A tokenizer file of byte-level BPE without a prefix space: splitting, and how many symbols merging leaves."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, before = spec["model"], spec["pre_tokenizer"]
        if spec["normalizer"] or before["type"] != "ByteLevel" or before["add_prefix_space"] or model.get("end_of_word_suffix") or model.get("continuing_subword_prefix"):
            raise ValueError(f"{path}: no plain byte-level BPE")
        vocab = model["vocab"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        made = {}
        for k, (a, b) in enumerate(pairs):
            made.setdefault(a + b, k)
        #: whether all places of a pair may be merged at once
        self.together = len(made) == len(pairs) and all(made.get(a, -1) < k and made.get(b, -1) < k for k, (a, b) in enumerate(pairs))
        self.size = len(vocab) + 1
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.bytes = np.array([vocab[c] for c in byte_characters()], np.int64)
        self.special = re.compile("(" + "|".join(re.escape(t["content"]) for t in sorted(spec["added_tokens"], key=lambda t: -len(t["content"]))) + ")") if spec["added_tokens"] else None
        self.latin = latin_splitter()
        from tokenizers import pre_tokenizers

        self.library = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
        self.byte_of = {ord(c): b for b, c in enumerate(byte_characters())}

    def words(self, segment: str) -> list:
        """The pre-tokens of a text without special strings, those of other alphabets as bytes."""
        if not BEYOND_LATIN.search(segment):
            return self.latin(segment)
        return [bytes(map(self.byte_of.__getitem__, map(ord, w))) for w, _ in self.library(segment)]

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def counts(self, words: list[bytes]) -> np.ndarray:
        """How many symbols each word is after merging."""
        out = np.fromiter(map(len, words), np.int64, len(words))
        for k in np.flatnonzero(out > LONG).tolist():
            out[k] = self.long_count(words[k])
        own = np.flatnonzero((out > 1) & (np.fromiter(map(len, words), np.int64, len(words)) <= LONG))
        if not len(own) or not len(self.keys):
            return out
        sizes = out[own]
        symbols = self.bytes[np.frombuffer(b"".join([words[k] for k in own.tolist()]), np.uint8)]
        ends = np.cumsum(sizes)
        ranks = np.append(self.rank(symbols[:-1], symbols[1:]), NONE)
        ranks[ends - 1] = NONE  # no pair spans two sequences
        while True:
            starts = np.cumsum(sizes) - sizes
            best = np.minimum.reduceat(ranks, starts)
            done = best == NONE
            out[own[done]] = sizes[done]
            if done.all():
                return out
            if done.any():
                stay = np.repeat(~done, sizes)
                symbols, ranks, own, sizes, best = symbols[stay], ranks[stay], own[~done], sizes[~done], best[~done]
                starts = np.cumsum(sizes) - sizes
            hit = ranks == np.repeat(best, sizes)
            at = np.flatnonzero(hit)
            if self.together:
                # of places side by side (a symbol repeated), every second one, from the left
                first = np.append(True, np.diff(at) > 1)
                run = np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))
                at = at[(np.arange(len(at)) - run) % 2 == 0]
            else:
                at = at[np.unique(np.searchsorted(starts, at, "right"), return_index=True)[1]]
            symbols[at] = self.made[ranks[at]]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            owner = np.searchsorted(starts, at, "right") - 1
            sizes = sizes - np.bincount(owner, minlength=len(sizes))
            at = (np.cumsum(keep) - 1)[at]  # where the new symbols are then
            symbols, ranks = symbols[keep], ranks[keep]
            last = np.zeros(len(symbols), bool)
            last[np.cumsum(sizes) - 1] = True
            again = np.concatenate([at, at[at > 0] - 1])
            ranks[again] = NONE
            again = again[~last[again]]
            ranks[again] = self.rank(symbols[again], symbols[again + 1])

    def long_count(self, word: bytes) -> int:
        """The same for one long word: the lowest pair first, leftmost of equals, over linked places."""
        symbols = self.bytes[np.frombuffer(word, np.uint8)]
        ranks = self.rank(symbols[:-1], symbols[1:])
        heap = [(r, i) for i, r in enumerate(ranks.tolist()) if r != NONE]
        heapq.heapify(heap)
        ranks, symbols, n = [*ranks.tolist(), NONE], symbols.tolist(), len(word)
        after, before, left = [*range(1, n), -1], [*range(-1, n - 1)], n
        made, keys = self.made.tolist(), {int(k): int(r) for k, r in zip(self.keys, self.ranks)}
        while heap:
            r, i = heapq.heappop(heap)
            if ranks[i] != r:
                continue
            j = after[i]
            symbols[i], ranks[j] = made[r], NONE
            left -= 1
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for a in (before[i], i):
                if a >= 0:
                    b = after[a]
                    ranks[a] = keys.get(symbols[a] * self.size + symbols[b], NONE) if b >= 0 else NONE
                    if ranks[a] != NONE:
                        heapq.heappush(heap, (ranks[a], a))
        return left


class Counter:
    """Counts tokens of texts with a bounded memo of pre-tokens."""

    def __init__(self, bpe: ByteBpe, room: int = ROOM):
        self.bpe, self.room = bpe, room
        self.forget()

    def forget(self) -> None:
        self.numbers, self.sizes = Numbers(), np.zeros(0, np.int64)

    def count(self, texts: list[str]) -> np.ndarray:
        if len(self.numbers) > self.room:
            self.forget()
        bpe, codes, special = self.bpe, [], []
        for text in texts:
            segments = bpe.special.split(text) if bpe.special and bpe.special.search(text) else (text,)
            special.append(len(segments) // 2)
            codes.append(self.numbers.of([w for s in segments[::2] for w in bpe.words(s)] if len(segments) > 1 else bpe.words(text)))
        fresh = [w if isinstance(w, bytes) else w.encode("utf-8", "surrogatepass") for w in self.numbers.take_fresh()]
        self.sizes = np.append(self.sizes, bpe.counts(fresh))
        ends = np.cumsum([len(c) for c in codes])
        sums = np.append(0, np.cumsum(self.sizes[np.concatenate([*codes, np.zeros(0, np.int64)])]))
        return np.diff(sums[np.append(0, ends)]) + np.array(special, np.int64)


_MODELS: dict[str, ByteBpe] = {}


def model_at(path: str) -> ByteBpe:
    """This worker's tokenizer, which does not grow."""
    if path not in _MODELS:
        _MODELS.clear()
        _MODELS[path] = ByteBpe(path)
    return _MODELS[path]


def count(docs: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row; ``path`` must be readable on every executor, as an
    installed package's file is."""

    def run(batches):
        counter = Counter(model_at(path))
        for batch in windows(batches, 1 << 20):
            n = counter.count(batch["text"].to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pc.cast(pc.binary_length(batch["text"]), pa.int64()), pa.array(n, pa.int64()), pa.array(n > limit)],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return texts.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
