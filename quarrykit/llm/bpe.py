"""BPE encoding and decoding through a minimal acyclic transducer of frequent words.

A first pass over all texts counts the words that the tokenizer's own splitting makes. The most frequent
``lexicon_words`` of them (a bound on memory, not on results) are merged once on the driver and compiled into a
minimal acyclic automaton: states with equal right languages are shared, and the outputs on the arcs add up to a
word's number, which points to its token ids. The arrays lie in one file, sent with ``SparkContext.addFile``;
every task maps it into memory. A word that the automaton does not accept is merged exactly, so results do not
depend on the lexicon.

Defined cases: a null text counts as empty; an empty text has no tokens and decodes to the empty text; the
tokenizer's special strings inside a text become their ids, as in the tokenizers library with its defaults; rows
with a null or repeated doc_id are encoded as any other row; texts of any length are read whole, a task holds a few of
them at a time; an empty table gives an empty result, and an empty lexicon; other columns are ignored, whatever their
names.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import re
import uuid
from collections import Counter
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrykit.llm.common import slices, small_batches, tidy

#: str.split() takes these for white space; Unicode and the tokenizer do not.
SEPARATORS = re.compile("[\x1c-\x1f]")
WHITE = re.compile("[^\\S\x1c-\x1f]+")
BEYOND_LATIN = re.compile("[^\x00-\u012f\u0131-\u024f]")
CACHE_WORDS = 150_000


def byte_characters() -> list[str]:
    """The printable stand-in of each byte in byte-level BPE: printable Latin-1 bytes stand for themselves."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = iter(range(256, 512))
    return [chr(b) if b in set(own) else chr(next(others)) for b in range(256)]


class WordBpe:
    """A tokenizer file of the kind "BPE with word ends": splitting, merging, and ids of tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = dict(model["vocab"])
        self.end: str = model["end_of_word_suffix"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.ranks = {pair: k for k, pair in enumerate(pairs)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.texts = {i: t for t, i in (self.vocab | self.special).items()}
        self.bytes = byte_characters()
        self.special_at = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        from tokenizers import Regex, Tokenizer, pre_tokenizers

        self.normalise = Tokenizer.from_file(path).normalizer.normalize_str
        self.cut = pre_tokenizers.Split(Regex(split["pattern"]["Regex"]), "removed", invert=True).pre_tokenize_str
        numbers = r"\d²³¹¼½¾"  # \p{N} up to U+024F
        self.latin_words = re.compile(rf"\n|'s|'t|'re|'ve|'m|'ll|'d|[^\W_{numbers}]+|[{numbers}]|(?:[^\w\n]|_)+").findall

    def words_in(self, chunks: list[str]) -> tuple[list[str], np.ndarray]:
        """The tokenizer's words in all chunks, one after the other, and how many each chunk has.

        Up to U+024F nothing composes and Python's tables agree with the tokenizer's; for all other chunks its own
        normaliser and splitter decide. No chunk holds a line feed, so that one can stand between them.
        """
        far = BEYOND_LATIN.search
        if not far("\n".join(chunks)):
            return self.latin(chunks)
        near = [k for k, c in enumerate(chunks) if not far(c)]
        found, sizes = self.latin([chunks[k] for k in near])
        ends = np.cumsum(sizes).tolist()
        own = {k: found[end - n : end] for k, n, end in zip(near, sizes.tolist(), ends)}
        for k, c in enumerate(chunks):
            if k not in own:
                own[k] = [w for part in self.normalise(c).split(" ") if part for w, _ in self.cut(part)]
        each = [own[k] for k in range(len(chunks))]
        return [w for ws in each for w in ws], np.array([len(ws) for ws in each], np.int64)

    def latin(self, chunks: list[str]) -> tuple[list[str], np.ndarray]:
        if not chunks:
            return [], np.zeros(0, np.int64)
        found = self.latin_words("\n".join(chunks).lower())
        ends = np.array([*(k for k, w in enumerate(found) if w == "\n"), len(found)], np.int64)
        return [w for w in found if w != "\n"], np.diff(ends, prepend=-1) - 1

    def segments(self, text: str) -> list[str]:
        """The text cut at special strings, which stand at the odd places."""
        return self.special_at.split(text) if self.special_at and any(s in text for s in self.special) else [text]

    @staticmethod
    def chunks(segment: str) -> list[str]:
        """Cut at white space; no word spans such a cut, and normalising works on each chunk by itself."""
        return [x for x in WHITE.split(segment) if x] if SEPARATORS.search(segment) else segment.split()

    def merge(self, word: str) -> list[int]:
        """The ids of one word, by merging its best-ranked adjacent pair again and again, leftmost first."""
        parts: list[str | None] = [self.bytes[b] for b in word.encode("utf-8", "surrogatepass")]
        if not parts:
            return []
        parts[-1] += self.end
        if len(parts) <= 32:
            ranks, none = self.ranks.get, len(self.ranks)
            while len(parts) > 1:
                each = [ranks(pair, none) for pair in zip(parts, parts[1:])]
                if (best := min(each)) == none:
                    break
                i = each.index(best)
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            return [self.vocab[p] for p in parts if p in self.vocab]
        n = len(parts)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        ranks = self.ranks
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := ranks.get((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i]
            if j < 0 or parts[i] != left or parts[j] != right:
                continue
            parts[i], parts[j] = left + right, None
            after[i], after[j] = after[j], -1
            if after[i] >= 0:
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and (r := ranks.get((parts[a], parts[b]))) is not None:
                    heapq.heappush(heap, (r, a, parts[a], parts[b]))
        return [self.vocab[p] for p in parts if p is not None and p in self.vocab]


class Lexicon:
    """A minimal acyclic automaton over UTF-8 bytes whose arcs carry numbers; their sum numbers the word.

    Arrays: ``keys`` (state * 256 + byte, ascending), ``to`` (the arc's target), ``out`` (its number), ``final``
    (by state), ``start`` and ``ids`` (token ids of word n: ids[start[n]:start[n + 1]]).
    """

    FIELDS = ("keys", "to", "out", "final", "start", "ids")

    def __init__(self, **arrays: np.ndarray):
        self.__dict__.update(arrays)

    @classmethod
    def compile(cls, words: Iterable[tuple[str, list[int]]]) -> Lexicon:
        entries = sorted((w.encode("utf-8", "surrogatepass"), ids) for w, ids in words)
        known: dict[tuple, int] = {}
        arcs: list[tuple] = []  # of each registered state
        finals: list[bool] = []

        def register(final: bool, own: list[tuple[int, int]]) -> int:
            key = (final, *own)
            if (state := known.get(key)) is None:
                state = known[key] = len(arcs)
                arcs.append(tuple(own))
                finals.append(final)
            return state

        # path[d]: [final, arcs so far, byte that leads to path[d + 1]] of the state after d bytes of the last word
        path: list[list] = [[False, [], -1]]
        last = b""

        def close(depth: int) -> None:
            while len(path) - 1 > depth:
                final, own, _ = path.pop()
                path[-1][1].append((path[-1][2], register(final, own)))

        for word, _ in entries:
            same = next((k for k, (a, b) in enumerate(zip(last, word)) if a != b), min(len(last), len(word)))
            close(same)
            for b in word[same:]:
                path[-1][2] = b
                path.append([False, [], -1])
            path[-1][0] = True
            last = word
        close(0)
        root = register(path[0][0], path[0][1])
        below = np.zeros(len(arcs), np.int64)  # words from each state on; targets were registered earlier
        keys, to, out = [], [], []
        order = [root, *(s for s in range(len(arcs)) if s != root)]
        name = {s: k for k, s in enumerate(order)}
        for s in range(len(arcs)):
            n = int(finals[s])
            for b, t in arcs[s]:
                keys.append(name[s] * 256 + b)
                to.append(name[t])
                out.append(n)
                n += below[t]
            below[s] = n
        at = np.argsort(np.array(keys, np.int64), kind="stable") if keys else np.zeros(0, np.int64)
        start = np.zeros(len(entries) + 1, np.int64)
        start[1:] = np.cumsum([len(ids) for _, ids in entries]) if entries else []
        return cls(
            keys=np.array(keys, np.int64)[at], to=np.array(to, np.int64)[at], out=np.array(out, np.int64)[at],
            final=np.array([finals[s] for s in order], np.int64), start=start,
            ids=np.array([i for _, ids in entries for i in ids], np.int64),
        )

    def save(self, path: str) -> None:
        arrays = [getattr(self, f) for f in self.FIELDS]
        with open(path, "wb") as f:
            np.array([len(a) for a in arrays], np.int64).tofile(f)
            for a in arrays:
                a.tofile(f)

    @classmethod
    def map(cls, path: str) -> Lexicon:
        whole = np.memmap(path, np.int64, "r")
        at, arrays = len(cls.FIELDS), {}
        for field, n in zip(cls.FIELDS, whole[: len(cls.FIELDS)].tolist()):
            arrays[field] = whole[at : at + n]
            at += n
        return cls(**arrays)

    def numbers(self, words: list[str]) -> np.ndarray:
        """Each word's number, or -1 where the automaton does not accept it; all words step together."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        starts = np.cumsum(lengths) - lengths
        text = np.frombuffer(b"".join(raw) + b"\0", np.uint8)
        state, total = np.zeros(len(raw), np.int64), np.zeros(len(raw), np.int64)
        alive = np.arange(len(raw)) if len(self.keys) else np.zeros(0, np.int64)
        if not len(self.keys):
            state[:] = -1
        step = 0
        while len(alive := alive[lengths[alive] > step]):
            want = state[alive] * 256 + text[starts[alive] + step]
            arc = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
            found = self.keys[arc] == want
            state[alive[~found]] = -1
            alive, arc = alive[found], arc[found]
            state[alive], total[alive] = self.to[arc], total[alive] + self.out[arc]
            step += 1
        return np.where((state >= 0) & (self.final[np.maximum(state, 0)] == 1), total, -1)

    def tokens(self, number: int) -> list[int]:
        return self.ids[self.start[number] : self.start[number + 1]].tolist()


class Ragged:
    """Lists of numbers one after the other: list k is flat[starts[k]:][:sizes[k]]."""

    def __init__(self, flat: np.ndarray, sizes: np.ndarray):
        self.flat, self.sizes = flat, sizes
        self.starts = np.cumsum(sizes) - sizes

    def plus(self, flat: np.ndarray, sizes: np.ndarray) -> Ragged:
        return Ragged(np.append(self.flat, flat), np.append(self.sizes, sizes))

    def take(self, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The elements of the lists ``k``, one after the other, and how many each has."""
        n = self.sizes[k]
        return self.flat[np.arange(n.sum()) + np.repeat(self.starts[k] - np.cumsum(n) + n, n)], n


class Encoder:
    """Encodes texts with the lexicon, exact merging and a bounded memo of white-space chunks and words.

    Chunks and words get numbers when they are first met. A window of texts becomes an array of chunk numbers, and
    its words and token ids are taken from there for all texts at once. A special string is a chunk of its own, kept
    apart from the plain ones as a tuple.
    """

    def __init__(self, bpe: WordBpe, lexicon: Lexicon, room: int = CACHE_WORDS):
        self.bpe, self.lexicon, self.room = bpe, lexicon, room
        last = max(bpe.texts, default=-1)
        self.shown = pa.array([str(i) for i in range(last + 1)], pa.large_string()), pa.array([bpe.texts.get(i, "") for i in range(last + 1)], pa.large_string())
        self.forget()

    def forget(self) -> None:
        none = np.zeros(0, np.int64)
        self.chunks, self.words = Numbers(), Numbers()
        self.words_of, self.ids_of = Ragged(none, none), Ragged(none, none)

    def learn(self) -> None:
        """The words of the chunks, and the ids of the words, that were numbered since the last call."""
        new = self.chunks.take_fresh()
        words, sizes = self.bpe.words_in([c for c in new if isinstance(c, str)])
        if len(sizes) < len(new):
            each = iter(np.split(np.arange(len(words)), np.cumsum(sizes)))
            each = [[words[k] for k in next(each)] if isinstance(c, str) else [c] for c in new]
            words, sizes = [w for ws in each for w in ws], np.array([len(ws) for ws in each])
        self.words_of = self.words_of.plus(self.words.of(words), sizes)
        new = self.words.take_fresh()
        lexicon, merge, special = self.lexicon, self.bpe.merge, self.bpe.special
        at = lexicon.numbers([w if isinstance(w, str) else "" for w in new])
        known = np.array([isinstance(w, str) for w in new], bool) & (at >= 0)
        ids, sizes = Ragged(lexicon.ids, np.diff(lexicon.start)).take(at[known])
        mine = [merge(new[k]) if isinstance(new[k], str) else [special[new[k][0]]] for k in np.flatnonzero(~known).tolist()]
        ids = np.append(ids, np.array([i for x in mine for i in x], np.int64))
        both = Ragged(ids, np.append(sizes, np.array([len(x) for x in mine], np.int64)))
        self.ids_of = self.ids_of.plus(*both.take(np.argsort(np.append(np.flatnonzero(known), np.flatnonzero(~known)))))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The token ids of all texts, one after the other, and how many each text has."""
        if len(self.chunks) > self.room:
            self.forget()
        codes = []
        for t in texts:
            segments = self.bpe.segments(t)
            codes.append(self.chunks.of(self.bpe.chunks(segments[0]) if len(segments) == 1 else [x for k, s in enumerate(segments) for x in ([(s,)] if k % 2 else self.bpe.chunks(s))]))
        self.learn()
        words, n_words = self.words_of.take(np.concatenate([*codes, np.zeros(0, np.int64)]))
        ids, n_ids = self.ids_of.take(words)
        ends = [np.append(0, np.cumsum(n)) for n in ([len(c) for c in codes], n_words, n_ids)]
        return ids, np.diff(ends[2][ends[1][ends[0]]]).astype(np.int64)

    def joined(self, ids: np.ndarray, sizes: np.ndarray) -> list[pa.Array]:
        """The ids and the tokens of each text, joined by a space."""
        starts = pa.array(np.append(0, np.cumsum(sizes)), pa.int64())
        space = pa.scalar(" ", pa.large_string())
        return [pc.binary_join(pa.LargeListArray.from_arrays(starts, x.take(pa.array(ids))), space) for x in self.shown]


class Numbers(dict):
    """Numbers for things in the order in which they are first met."""

    def __init__(self):
        self.fresh: list = []

    def __missing__(self, thing) -> int:
        n = self[thing] = len(self)
        self.fresh.append(thing)
        return n

    def of(self, things: list) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, things), np.int64, len(things))

    def take_fresh(self) -> list:
        new, self.fresh = self.fresh, []
        return new


_MODELS: dict[str, WordBpe] = {}


def model_at(path: str) -> WordBpe:
    """This worker's tokenizer, which does not grow; memos are a task's own and end with it."""
    if path not in _MODELS:
        _MODELS.clear()
        _MODELS[path] = WordBpe(path)
    return _MODELS[path]


def windows(batches, characters: int = 1 << 21):
    """Arrow batches in pieces of about so many characters of text, one row at least."""
    for batch in batches:
        ends = np.cumsum(pc.utf8_length(batch["text"]).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + characters, "right")))
            yield batch.slice(at, to - at)
            at = to


def count_words(docs: DataFrame, bpe_path: str) -> DataFrame:
    """How often each of the tokenizer's words occurs in all texts: (word, n)."""

    def count(batches):
        bpe, chunks = model_at(bpe_path), Counter()

        def drain():
            number = Numbers()
            found, sizes = bpe.words_in(list(chunks))
            times = np.repeat(np.fromiter(chunks.values(), np.int64, len(chunks)), sizes)
            n = np.bincount(number.of(found), times).astype(np.int64)
            chunks.clear()
            words = list(number)
            kept = [k for k, w in enumerate(words) if len(w) <= 256]  # longer ones are merged when met
            return pa.RecordBatch.from_pydict({"word": pa.array([words[k] for k in kept], pa.string()), "n": pa.array(n[kept], pa.int64())})

        for batch in slices(batches):
            for text in batch["text"].to_pylist():
                for k, s in enumerate(bpe.segments(text)):
                    if k % 2 == 0:
                        chunks.update(bpe.chunks(s))
            if len(chunks) > CACHE_WORDS:
                yield drain()
        yield drain()

    texts = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return small_batches(texts).mapInArrow(tidy(count), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(docs: DataFrame, bpe_path: str, lexicon_words: int = 1 << 18) -> Lexicon:
    """The automaton of the most frequent words of ``docs``, at most ``lexicon_words`` (ties: smaller word)."""

    def merge(batches):
        bpe = model_at(bpe_path)
        for batch in slices(batches):
            ids = pa.array([bpe.merge(w) for w in batch["word"].to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch["word"], ids], names=["word", "ids"])

    top = count_words(docs, bpe_path).orderBy(F.desc("n"), "word").limit(lexicon_words).select("word")
    parts = 4 * docs.sparkSession.sparkContext.defaultParallelism
    merged = top.repartition(parts).mapInArrow(tidy(merge), "word string, ids array<int>").toArrow()
    return Lexicon.compile(zip(merged["word"].to_pylist(), merged["ids"].to_pylist()))


def share(docs: DataFrame, lexicon: Lexicon) -> str:
    """Hands the lexicon's file to Spark, which copies it to all executors, those started later too; its name there.

    The driver's own copy lies in the folder from which Spark serves files, and goes with it.
    """
    name = f"lexicon-{uuid.uuid4().hex}.bin"
    folder = os.path.join(SparkFiles.getRootDirectory(), "quarrykit")
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, name)
    lexicon.save(path)
    docs.sparkSession.sparkContext.addFile(path)
    return name


def encode(docs: DataFrame, bpe_path: str, lexicon: Lexicon, ids: bool = False) -> DataFrame:
    """``doc_id`` with n_tokens, ids_sha256, decoded_sha256; with ``ids`` also the token ids as an array.

    ``bpe_path`` must be readable on every executor, as an installed package's file is.
    """
    name = share(docs, lexicon)

    def run(batches):
        encoder = Encoder(model_at(bpe_path), Lexicon.map(SparkFiles.get(name)))

        def digests(column):
            return pa.array([hashlib.sha256(x.as_buffer() if len(x.as_buffer()) else b"").hexdigest() for x in column], pa.string())

        for batch in windows(batches):
            tokens, sizes = encoder.encode(batch["text"].to_pylist())
            out = [batch["doc_id"], pa.array(sizes), *map(digests, encoder.joined(tokens, sizes))]
            if ids:
                out.append(pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(tokens, pa.int32())))
            yield pa.RecordBatch.from_arrays(out, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: len(out)])

    texts = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    kind = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return small_batches(texts).mapInArrow(tidy(run), kind + ", ids array<int>" * ids)


def decode(encoded: DataFrame, bpe_path: str) -> DataFrame:
    """``doc_id`` with the decoded text of ``ids``: the tokens joined by a space, special ones included."""

    def run(batches):
        text_of = model_at(bpe_path).texts
        for batch in slices(batches):
            texts = [" ".join([text_of[i] for i in x or ()]) for x in batch["ids"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long"), "ids").mapInArrow(tidy(run), "doc_id long, text string")
