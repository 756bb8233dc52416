"""Language identification by mixture inference over character n-grams.

Training sums hashed character trigrams by language over all training documents. For a document, each language
gives every trigram a probability; expectation-maximisation estimates the proportions in which a set of
languages has made the document. The set grows greedily while the likelihood, less a penalty for each further
language (as in the Bayesian information criterion), rises. The prediction is the language with the largest
proportion, the score that proportion.

Defined cases: a null text, an empty one, or one without letters is ``und`` with score 0, as is every text if
nothing was learned; ties go to the language that sorts first; whole texts are read; rows with a null or repeated
doc_id are predicted like others; an empty table gives an empty result; ``accept`` keeps all columns, whatever their
names, and of others only those that are asked for.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrykit.llm.common import slices, small_batches, tidy

BITS = 16
#: Each trigram shares two characters with the next, so their likelihoods count for less than independent ones.
DEPENDENCE = 3.0
ROUNDS = 25
HAS_LETTER = re.compile(r"[^\W\d_]")

_LETTERS: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Whether a code point is a letter, made once in each worker."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def gram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed trigrams of the lower-cased text, all but letters read as a space, with their counts."""
    codes = np.frombuffer(f" {(text or '').lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.where(letters()[codes], codes, np.uint32(32))
    a, b, c = codes[:-2], codes[1:-1], codes[2:]
    hashed = (a * np.uint32(0x9E3779B1)) ^ (b * np.uint32(0x85EBCA77)) ^ (c * np.uint32(0xC2B2AE3D))
    hashed ^= hashed >> np.uint32(15)
    hashed = (hashed * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - BITS)
    counts = np.bincount(hashed[(b != 32) | ((a != 32) & (c != 32))], minlength=1 << BITS)
    grams = np.flatnonzero(counts)
    return grams, counts[grams]


class Model:
    """Smoothed trigram probabilities: one column for each language, in order of their names."""

    def __init__(self, languages: list[str], probabilities: np.ndarray):
        self.languages, self.probabilities = languages, probabilities

    def mixture(self, text: str | None, penalty: float = 1.0) -> dict[str, float]:
        """The chosen languages with their proportions; empty if there is nothing to go by."""
        if not self.languages or not text or not HAS_LETTER.search(text):
            return {}
        grams, counts = gram_counts(text)
        if not len(grams):
            return {}
        p, n = self.probabilities[grams], counts.sum()
        single = counts @ np.log(p)
        chosen, share = [int(single.argmax())], np.ones(1)
        likelihood = float(single.max())
        price = penalty * DEPENDENCE * np.log(max(2, n))
        while len(chosen) < len(self.languages):
            pull = (counts / (p[:, chosen] @ share)) @ p / n  # above 1 where a language would raise the likelihood
            pull[chosen] = 0
            best = int(pull.argmax())
            if pull[best] <= 1:
                break
            trial = [*chosen, best]
            q = p[:, trial]
            weights = np.append(share * 0.8, 0.2)
            for _ in range(ROUNDS):
                weights = weights * ((counts / (q @ weights)) @ q) / n
            better = float(counts @ np.log(q @ weights))
            if better - likelihood <= price:
                break
            chosen, share, likelihood = trial, weights, better
        return {self.languages[k]: float(w) for k, w in zip(chosen, share / share.sum())}

    def predict(self, text: str | None) -> tuple[str, float]:
        return main_of(self.mixture(text))


def main_of(mixture: dict[str, float]) -> tuple[str, float]:
    """The language with the largest proportion, and that proportion."""
    if not mixture:
        return "und", 0.0
    best = min(mixture, key=lambda k: (-mixture[k], k))
    return best, min(1.0, mixture[best])


def train(docs: DataFrame, smoothing: float = 0.5) -> Model:
    """Learns from every row of ``docs`` with a language. The driver gets one sum for each language and hashed
    trigram, so at most 2**16 numbers a language."""

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in slices(batches):
            for text, lang in zip(batch["text"].to_pylist(), batch["lang"].to_pylist()):
                own = sums.setdefault(lang, np.zeros(1 << BITS, np.int64))
                grams, counts = gram_counts(text)
                own[grams] += counts
        for lang, own in sums.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(own[at], pa.int64())], names=["lang", "gram", "n"])

    rows = docs.filter(F.col("lang").isNotNull()).select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    sums = small_batches(rows).mapInArrow(tidy(count), "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    names = sums["lang"].to_pylist()
    languages = sorted(set(names))
    n = np.zeros((1 << BITS, len(languages)))
    if languages:
        column = {lang: k for k, lang in enumerate(languages)}
        n[sums["gram"].to_numpy(), [column[x] for x in names]] = sums["n"].to_numpy()
    n += smoothing
    return Model(languages, n / n.sum(0))


def predictions(docs: DataFrame, model: Model, kept: list[Column | str]) -> DataFrame:
    """The columns ``kept`` with lang_pred and score, and the mixture: languages and proportions, largest first."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**16 doubles a language

    def run(batches):
        own = shared.value
        for batch in slices(batches):
            mixtures = [own.mixture(t) for t in batch["_text"].to_pylist()]
            done = [main_of(m) for m in mixtures]
            sorted_ = [sorted(m, key=lambda k: (-m[k], k)) for m in mixtures]
            names = [f for f in batch.schema.names if f != "_text"]
            columns = [
                pa.array([x for x, _ in done], pa.string()),
                pa.array([s for _, s in done], pa.float64()),
                pa.array(sorted_, pa.list_(pa.string())),
                pa.array([[m[k] for k in ks] for m, ks in zip(mixtures, sorted_)], pa.list_(pa.float64())),
            ]
            yield pa.RecordBatch.from_arrays([*(batch[f] for f in names), *columns], names=[*names, "lang_pred", "score", "languages", "proportions"])

    rows = docs.select(*kept, F.col("text").cast("string").alias("_text"))
    schema = rows.drop("_text").schema.add("lang_pred", "string").add("score", "double")
    return small_batches(rows).mapInArrow(tidy(run), schema.add("languages", T.ArrayType(T.StringType())).add("proportions", T.ArrayType(T.DoubleType())))


def accept(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose main language has at least the share ``least``, with the same columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        own = shared.value
        for batch in slices(batches):
            done = [own.predict(t) for t in batch["text"].to_pylist()]
            yield batch.filter(pa.array([lang != "und" and score >= least for lang, score in done], pa.bool_()))

    return small_batches(docs).mapInArrow(tidy(run), docs.schema)


def held_out(doc_id: str = "doc_id", parts: int = 4, part: int = 2) -> Column:
    """Whether crc32 of the id's digits leaves this remainder; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % parts == part, F.lit(False))
