"""The filter audit, hard negatives and token counts against brute force and the tokenizers library."""

import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrykit.llm import filter_audit, hard_negatives, token_count
from quarrykit.llm.queries import BYTE_BPE_PATH

DOCS = "doc_id long, text string, lang string, part string, mask int, n string, good string, first long, sha string, bits int"
LABELS = "doc_id long, quality int, toxic int, part string"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, lang, *["x", 7, "y", "z", 3, "s", 1]) for i, t, lang in rows], DOCS)


def fails(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    tests = [len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), bool(re.search("[#$%&*|]", text))]
    return {f for f, t in zip("ABCD", tests) if t}


def brute_audit(rows, labels):
    good = {i for i, q, _ in labels if i is not None and q == 1}
    toxic = {i for i, _, t in labels if i is not None and t == 1}
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    docs = [(i, lang or "", fails(t or "") | ({"E"} if i is not None and i > first[t or ""] else set())) for i, t, lang in rows]
    out, value = {}, Counter()
    for part in {p for _, p, _ in docs}:
        own = [(i, f) for i, p, f in docs if p == part]
        for order in map("".join, permutations("ABCDE")):
            alive, gone = own, []
            for step, x in enumerate(order, 1):
                now = [d for d in alive if x in d[1]]
                alive = [d for d in alive if x not in d[1]]
                out[part, order, step] = [len(alive), len(now), sum(x in f for _, f in gone), sum(f == {x} for _, f in own), sum(i in good for i, _ in now), sum(i in toxic for i, _ in now)]
                gone = gone + now
                value[part, x] += len(now)
    return {k: (*v, value[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def audited(spark, rows, labels):
    got = filter_audit.audit(documents(spark, rows), spark.createDataFrame([(*x, "p") for x in labels], LABELS)).collect()
    return {(x.part, x.filter_order, x.step): (x.kept, x.removed, x.redundant, x.unique_fails, x.good_lost, x.toxic_lost, x.shapley) for x in got}, len(got)


def audit_rows(seed, n):
    r = random.Random(seed)
    pick = lambda: r.choice(["Word", "a", "b$", "UPPER", "é", "x1", *(f"w{k}" for k in range(300))])
    texts = [r.choice([" ", "\t", "\n\x0b"]).join(pick() for _ in range(r.choice([0, 1, 20, 99, 100, 101, 140]))) for _ in range(n // 2)]
    return [(r.choice([None, *range(n)]), r.choice([None, "", *texts]), r.choice(["en", "de", None, ""])) for _ in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_audit_against_brute_force(spark, monkeypatch, seed):
    """Null ids, texts and languages, repeated ids and rows, clashing columns; a hot text; ranges of few rows."""
    rows = audit_rows(seed, 120)
    rows += rows[:5] + [(500 + k, "a hot text", "en") for k in range(60)] + [(None, "a hot text", None), (7, "x " * 40_000, "fr"), (8, "W" * 50_000 + " #", "fr")]
    labels = [(i, q, t) for i, _, _ in rows[::2] for q, t in [(1, 0)]] + [(i, 0, 1) for i, _, _ in rows[::3]] + [(None, 1, 1), (501, None, None), (99_999, 1, 1)]
    monkeypatch.setattr(filter_audit, "RANGE_ROWS", 16)
    if seed == 2:
        monkeypatch.setattr(filter_audit, "HOT_SHARE", 0.5)  # no text is hot
    got, n = audited(spark, rows, labels)
    want = brute_audit(rows, labels)
    assert got == want and n == len(want) == 4 * 600


def test_audit_of_empty_tables(spark):
    assert audited(spark, [], []) == ({}, 0)
    got, n = audited(spark, [(1, None, None), (2, "", "en")], [])
    assert got == brute_audit([(1, None, None), (2, "", "en")], []) and n == 1200


def test_galloping_merges():
    rng = np.random.default_rng(4)
    for n, m, top in [(0, 5, 9), (5, 0, 9), (700, 30_000, 40_000), (30_000, 40, 10**6), (2000, 2000, 2500), (1, 1, 1), (600, 5, 10_000)]:
        a, b = (np.unique(rng.integers(0, top, k)) for k in (n, m))
        assert (filter_audit.gallop(a, b) == np.isin(a, b)).all()
        assert (filter_audit.merged(a, b) == np.union1d(a, b)).all()
    lists = [np.unique(rng.integers(0, 900, k)) for k in (300, 0, 5, 800, 90)]
    weights = rng.integers(0, 4, (900, 3))
    sizes = filter_audit.union_sizes(lists, weights)
    for bits in range(32):
        union = sorted(set().union(*(set(lists[k].tolist()) for k in range(5) if bits >> k & 1)))
        assert (sizes[bits] == weights[np.array(union, int)].sum(0)).all()


def brute_negatives(rows, every=50):
    rows = sorted({(i, label, tuple(v)) for i, label, v in rows})
    width = max((len(v) for _, _, v in rows), default=0)
    full = [(i, label, v + (0,) * (width - len(v))) for i, label, v in rows]
    dot = lambda x, y: max(min(sum(a * b for a, b in zip(x, y)), 2**63 - 1), -(2**63))
    out = []
    for k, (i, label, v) in enumerate(full):
        if i % every:
            continue
        scored = sorted((-dot(v, w), j, own == label) for n, (j, own, w) in enumerate(full) if n != k)
        for s, j, _ in [x for x in scored if x[2]][:5]:
            fits = [x for x in scored if not x[2] and -50 * s <= -100 * x[0] <= -95 * s][:3]
            out += [(i, j, rank, x[1], -s, -x[0]) for rank, x in enumerate(fits, 1)]
    return sorted(out)


def mined(spark, rows, **options):
    table = spark.createDataFrame([(*x, 1, 2) for x in rows], "id long, label int, v array<long>, key int, block int")
    return sorted(map(tuple, hard_negatives.mine(table, **options).collect()))


def test_hard_negatives_against_brute_force(spark):
    """Norms over several powers of two, copies of one vector, ties, short, empty and zero vectors, repeated ids and rows."""
    rng = np.random.default_rng(8)
    rows = [(int(i), int(rng.integers(0, 4)), [int(x) for x in rng.normal(size=12) * s]) for i, s in zip(rng.permutation(700), rng.choice([3, 40, 256, 900], 700))]
    rows += [(1000 + k, k % 3, [200] * 12) for k in range(90)] + [(2000, 1, []), (2050, 2, [0] * 12), (2001, 1, [300, 5]), (2100, 3, [10**4])]
    rows += [(50, 1, [7] * 12), (50, 1, [7] * 12), (50, 2, [9] * 12), (3050, 77, [5] * 12)]
    want = brute_negatives(rows)
    assert len(want) > 150 and mined(spark, rows) == want
    assert mined(spark, rows, starts=(), drops=()) == want
    assert mined(spark, rows, starts=(0.9, 0.01), drops=(0.01, 0.9)) == want


def test_hard_negatives_of_large_numbers_and_few_rows(spark):
    big = [(50 * k, k % 2, [2**40 + k, -(2**39), k]) for k in range(6)]
    big += [(50 * k + 1, k % 3, [2**20 + k, 5, -k]) for k in range(9)]
    assert mined(spark, big) == brute_negatives(big)
    middle = [(50 * k, k % 2, [2**28 + 977 * k, -(2**27) + k, k]) for k in range(9)]
    assert mined(spark, middle) == brute_negatives(middle)
    lone = [(50, 1, [1, 2])]
    assert mined(spark, lone) == [] and mined(spark, []) == []


def test_whole_numbers(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5, -0.001], 3), (2, None, 3), (3, [nan, 1.0], 3), (4, [inf, 1.0], 3), (5, [None, 1.0], 3), (6, [1.0, 1.0], None), (None, [1.0, 1.0], 3), (7, [], 3)]
    got = hard_negatives.whole_numbers(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    assert sorted((x.id, x.label, x.v) for x in got) == [(1, 3, [128, -1]), (7, 3, [])]


def test_thresholds_omit_and_prune():
    """Pairs at or above the threshold, for thresholds at which lists are whole, shortened and empty."""
    rng = np.random.default_rng(2)
    x = (rng.normal(size=(400, 40)) * np.geomspace(200, 1, 40)).astype(np.int64)
    q = x[:50] + rng.integers(-3, 4, (50, 40))
    block = hard_negatives.Block(x, np.arange(40))
    scores = q @ x.T
    for share in (-2.0, 0.0, 0.1, 0.6, 0.9, 2.0):
        least = share * np.linalg.norm(q, axis=1) * np.linalg.norm(x, axis=1).max()
        a, r, s = block.at_least(q, least)
        assert sorted(zip(a.tolist(), r.tolist())) == sorted(zip(*(k.tolist() for k in np.nonzero(scores >= least[:, None]))))
        assert (s == scores[a, r]).all()


def odd_texts():
    r = random.Random(5)
    alphabet = [*"aab '  \n\t\r\x0b\x1c\x85\xa0 Éß'sé1²½٣漢字😀_-.", "'ll", "'VE", " <|endoftext|>", "the ", " aaaa", "<|endoftext|>"]
    texts = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 60))) for _ in range(1500)]
    texts += ["a" * 9000, "ab" * 5000 + " x", "".join(chr(97 + r.randrange(26)) for _ in range(12_000)), "é" * 3000, " " * 5000 + "x", "<|endoftext|>" * 30, "", "word " * 30_000]
    return texts + ["".join(chr(k) + f for k in range(a, a + 400)) for a in range(0, 0x3000, 400) for f in ("", "a", " ")]


def test_token_counts_equal_the_library(spark):
    from tokenizers import Tokenizer

    library, texts = Tokenizer.from_file(BYTE_BPE_PATH), odd_texts()
    want = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    rows = [(k % 1400, t) for k, t in enumerate(texts)] + [(None, None), (3, None), (None, "two words")]
    table = spark.createDataFrame([(i, t, 5, "x", True) for i, t in rows], "doc_id long, text string, n_tokens int, n_bytes string, over_limit boolean")
    got = Counter(map(tuple, token_count.count(table, BYTE_BPE_PATH, limit=20).collect()))
    assert got == Counter([(i, len(t.encode()), n, n > 20) for (i, t), n in zip(rows, want)] + [(None, 0, 0, False), (3, 0, 0, False), (None, 9, 2, False)])
    assert token_count.count(table.limit(0), BYTE_BPE_PATH).count() == 0


@pytest.mark.parametrize("together,long", [(False, 4096), (True, 3), (True, 10**9)])
def test_other_ways_of_merging(monkeypatch, together, long):
    """One place a round, over a heap, and in rounds whatever the length."""
    from tokenizers import Tokenizer

    bpe = token_count.ByteBpe(BYTE_BPE_PATH)
    assert bpe.together
    bpe.together = together
    monkeypatch.setattr(token_count, "LONG", long)
    texts = [t[:5000] for t in odd_texts()[::4]] + ["aa" * 700 + "b" * 700, "ab" * 300]
    want = [len(e.ids) for e in Tokenizer.from_file(BYTE_BPE_PATH).encode_batch(texts, add_special_tokens=False)]
    counter = token_count.Counter(bpe, room=50)  # forgets again and again
    assert [int(x) for k in range(0, len(texts), 20) for x in counter.count(texts[k : k + 20])] == want
