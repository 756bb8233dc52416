"""Toxicity: a logistic classifier whose scores are trained not to depend on which group a sentence names.

Features are the distinct lower-cased words of a text (words of more than 64 letters by their hash) and their
beginnings of four and five letters. Of at most ``sample`` labelled rows (those with the smallest hash of their id)
Spark counts every feature by label; of those that ``seen`` rows have and whose log odds ratio is ``odds`` at least,
the ``features`` most telling ones are kept, and always the identity terms that ``seen`` rows have. The weights minimise the logistic
loss, an L2 term, and ``fairness`` times the mean squared change of a sentence's score when an identity term in it is
replaced by another of its kind. So a term that stands in many toxic sentences does not make a neutral mention toxic.

Whole texts are read; a document has a feature or not, so long texts are not diluted. Defined cases: a null or empty
text gets the bias alone; rows without a label, or whose id is null, teach nothing; of several labels of one id the
largest counts; with no labelled rows, or only one label, every score is the label's share (0.0 without rows);
repeated rows are scored each; an empty table gives an empty result; of the documents' columns only doc_id, text and those
asked for are read, whatever the others' names.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrykit.llm.common import cut, slices, tidy

# Terms that name groups, by kind; a term is swapped with the others of its kind.
IDENTITIES = {
    "believers": "muslims christians jews hindus buddhists atheists catholics sikhs",
    "faith": "muslim christian jewish hindu buddhist atheist catholic sikh",
    "people": "women men girls boys mothers fathers",
    "person": "woman man girl boy mother father",
    "gender": "female male transgender nonbinary",
    "orientation": "gay lesbian straight bisexual queer heterosexual homosexual",
    "ethnicity": "black white asian latino hispanic african european arab indigenous",
    "origin": "immigrants foreigners refugees locals natives citizens",
    "ability": "disabled deaf blind autistic",
    "personas": "mujeres hombres judíos musulmanes cristianos gitanos",
    "personnes": "femmes hommes juifs musulmans chrétiens gitans",
    "menschen": "frauen männer juden muslime christen ausländer",
}
#: Words whose features a task remembers.
KNOWN_WORDS = 200_000

KIND = {term: kind for kind, terms in IDENTITIES.items() for term in terms.split()}
WORD = re.compile(r"[^\W\d_]+")
SENTENCE = re.compile(r"[^.!?\n]+")
PREFIXES = (4, 5)
LONG = 64
MOVED = pa.list_(pa.struct([("gone", pa.list_(pa.int32())), ("come", pa.list_(pa.int32())), ("n", pa.int64())]))


def features_of_word(word: str) -> list[str]:
    whole = word if len(word) <= LONG else f"#{xxhash.xxh3_128_hexdigest(word)}"
    return [whole, *(f"{word[:n]}*" for n in PREFIXES if len(word) >= n)]


def words_of(text: str | None) -> set[str]:
    return set(WORD.findall(text.lower())) if text else set()


def swaps(text: str | None) -> list[tuple[set[str], set[str]]]:
    """For each sentence with an identity term and each other term of its kind: features that go, features that come."""
    low, out = (text or "").lower(), []
    if not KIND.keys() & words_of(low):
        return out
    for sentence in SENTENCE.findall(low):
        words = set(WORD.findall(sentence))
        for term in sorted(words & KIND.keys()):
            was = {f for w in words for f in features_of_word(w)}
            for other in IDENTITIES[KIND[term]].split():
                if other != term:
                    now = {f for w in words - {term} | {other} for f in features_of_word(w)}
                    out.append((was - now, now - was))
    return out


class Classifier:
    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias = weights, bias

    def scorer(self):
        """A function of a text, with a memo of words."""
        weights, memo, bias = self.weights, {}, self.bias

        def score(text: str | None) -> float:
            if len(memo) > KNOWN_WORDS:
                memo.clear()
            found: set[str] = set()
            for w in words_of(text):
                if (own := memo.get(w)) is None:
                    own = memo[w] = tuple(f for f in features_of_word(w) if f in weights)
                if own:
                    found.update(own)
            z = bias + sum(weights[f] for f in sorted(found))
            return float(1 / (1 + np.exp(-min(30.0, max(-30.0, z)))))

        return score


def fit(rows: list[np.ndarray], toxic: np.ndarray, changes: list[tuple[list[int], list[int]]], n: int, fairness: float, l2: float = 1e-4, rounds: int = 400, times: list[int] | None = None) -> tuple[np.ndarray, float]:
    """Weights and bias by Adam on the whole sample. rows: feature numbers; changes: numbers that go and that come,
    each standing for so many ``times`` (once)."""
    at = np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64)
    of = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    c_at = np.array([f for gone, come in changes for f in (*gone, *come)], np.int64)
    c_of = np.repeat(np.arange(len(changes)), [len(g) + len(c) for g, c in changes])
    c_sign = np.array([s for gone, come in changes for s in (*[-1.0] * len(gone), *[1.0] * len(come))])
    weigh = np.ones(len(changes)) if times is None else np.array(times, float)
    share = toxic.mean()
    w, bias = np.zeros(n), float(np.log(share / (1 - share)))
    m, v = np.zeros(n + 1), np.zeros(n + 1)
    balance = np.where(toxic == 1, 0.5 / share, 0.5 / (1 - share))
    for t in range(1, rounds + 1):
        z = np.bincount(of, w[at], len(rows)) + bias
        r = balance * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - toxic) / len(rows)
        g = np.bincount(at, r[of], n) + l2 * w
        if len(changes) and fairness:
            d = weigh * np.bincount(c_of, c_sign * w[c_at], len(changes))
            g += 2 * fairness / weigh.sum() * np.bincount(c_at, c_sign * d[c_of], n)
        g = np.append(g, r.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = 0.1 * (1 - 0.5 * t / rounds) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
        w, bias = w - step[:-1], bias - step[-1]
    return w, float(bias)


def train(docs: DataFrame, labels: DataFrame, sample: int = 20_000, features: int = 4096, fairness: float = 1.0, seen: int = 3, odds: float = 1.0) -> Classifier:
    """Learns from the rows of ``labels`` (doc_id, toxic) whose documents are in ``docs``."""
    marks = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col("toxic").cast("int").alias("toxic")).filter("_id is not null and toxic in (0, 1)")
    marks = marks.groupBy("_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("_id"), "_id").limit(sample)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    chosen = texts.join(F.broadcast(marks), F.col("doc_id") == F.col("_id")).select("toxic", "text")  # ``sample`` rows at most

    def count(batches):
        sums: dict[str, list[int]] = {}
        for batch in slices(batches):
            for toxic, text in zip(batch["toxic"].to_pylist(), batch["text"].to_pylist()):
                for f in {f for w in words_of(text) for f in features_of_word(w)}:
                    sums.setdefault(f, [0, 0])[toxic] += 1
                own = sums.setdefault("", [0, 0])  # all documents
                own[toxic] += 1
        names = list(sums)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([sums[f][k] for f in names], pa.int64()) for k in (0, 1))], names=["f", "clean", "toxic"])

    counts = chosen.mapInArrow(tidy(count), "f string, clean long, toxic long").groupBy("f").agg(F.sum("clean").alias("c"), F.sum("toxic").alias("t")).filter(f"f = '' or c + t >= {int(seen)}")
    counts = cut(counts)
    total = counts.filter("f = ''").first()
    if total is None or not total["c"] or not total["t"]:
        share = float(total["t"] > 0) if total else 0.0
        return Classifier({}, 30.0 if share else -30.0)
    each = [F.log((F.col(k) + 0.5) / (F.lit(float(total[k])) - F.col(k) + 0.5)) for k in ("t", "c")]
    spread = sum(1 / (F.col(k) + 0.5) + 1 / (F.lit(float(total[k])) - F.col(k) + 0.5) for k in ("t", "c"))
    telling = F.abs(each[0] - each[1]) / F.sqrt(spread)
    own = sorted({f for term in KIND for f in features_of_word(term)})
    picked = counts.filter((F.col("f") != "") & (F.abs(each[0] - each[1]) >= odds)).orderBy(telling.desc(), "f").limit(features)
    names = sorted({r["f"] for r in picked.select("f").collect()} | {r["f"] for r in counts.filter(F.col("f").isin(own)).select("f").collect()})
    number = {f: k for k, f in enumerate(names)}

    def vectors(batches):
        for batch in slices(batches):
            texts = batch["text"].to_pylist()
            held = [sorted({number[f] for w in words_of(t) for f in features_of_word(w) if f in number}) for t in texts]
            # equal changes of a text are added up, so that a long one hands on few
            moved = [Counter(tuple(tuple(sorted(number[f] for f in side if f in number)) for side in pair) for pair in swaps(t)) for t in texts]
            moved = [[{"gone": gone, "come": come, "n": n} for (gone, come), n in sorted(m.items()) if gone or come] for m in moved]
            yield pa.RecordBatch.from_arrays([batch["toxic"], pa.array(held, pa.list_(pa.int32())), pa.array(moved, MOVED)], names=["toxic", "held", "moved"])

    got = chosen.mapInArrow(tidy(vectors), "toxic int, held array<int>, moved array<struct<gone: array<int>, come: array<int>, n: long>>").toArrow()
    rows = [np.array(x, np.int64) for x in got["held"].to_pylist()]
    total_changes: Counter = Counter()
    for per in got["moved"].to_pylist():
        for x in per:
            total_changes[tuple(x["gone"]), tuple(x["come"])] += x["n"]
    changes = sorted(total_changes)
    w, bias = fit(rows, got["toxic"].to_numpy().astype(float), changes, len(names), fairness, times=[total_changes[c] for c in changes])
    return Classifier({f: float(x) for f, x in zip(names, w) if x}, bias)


def score(docs: DataFrame, model: Classifier, kept: list[Column]) -> DataFrame:
    """The columns ``kept`` with score and predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most ``features`` weights and the identity terms

    def run(batches):
        scored = shared.value.scorer()
        for batch in slices(batches):
            done = [scored(t) for t in batch["_text"].to_pylist()]
            names = [f for f in batch.schema.names if f != "_text"]
            yield pa.RecordBatch.from_arrays([*(batch[f] for f in names), pa.array(done, pa.float64()), pa.array([int(s >= 0.5) for s in done], pa.int32())], names=[*names, "score", "predicted"])

    rows = docs.select(*kept, F.col("text").cast("string").alias("_text"))
    return rows.mapInArrow(tidy(run), rows.drop("_text").schema.add("score", "double").add("predicted", "integer"))
