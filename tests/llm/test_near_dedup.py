import random

import numpy as np
import pytest

from quarrykit.llm import near_dedup

SCHEMA = "doc_id long, text string, a string, component_id string"


def words(text):
    return [w for w in "".join(c.lower() if c.isascii() else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ") if w]


def brute(rows):
    sets = {}
    for doc_id, text in rows:
        w = words(text)
        sets[doc_id] = {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    parent = {d: d for d in sets}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                ra, rb = sorted((root(a), root(b)))
                parent[rb] = ra
    return {d: (len(sets[d]), root(d), root(d) == d) for d in ids}


def corpus(seed):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows = []
    for _ in range(6):
        base = [r.choice(vocabulary) for _ in range(r.choice([40, 120, 300]))]
        for _ in range(25):
            own = list(base)
            for _ in range(int(len(base) * r.choice([0, 0.005, 0.01, 0.02, 0.03, 0.04]))):
                own[r.randrange(len(own))] = r.choice(vocabulary)
            rows.append(" ".join(own))
    rows += [" ".join(r.choice(vocabulary) for _ in range(r.randint(0, 30))) for _ in range(30)]
    rows += ["a b", "A  B", "a b c", "", "  ", "One two\tthree four five", "one TWO three four five"]
    r.shuffle(rows)
    return list(enumerate(rows))


def test_components_equal_brute_force(spark):
    rows = corpus(3)
    got = near_dedup.find(spark.createDataFrame([(i, t, "x", "y") for i, t in rows], SCHEMA)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == brute(rows)


@pytest.mark.parametrize("small", [1, 1000])
def test_both_ways_through_split_buckets_find_what_centres_miss(spark, monkeypatch, small):
    monkeypatch.setattr(near_dedup, "SMALL", small)
    rows = corpus(8)
    got = near_dedup.find(spark.createDataFrame([(i, t, "x", "y") for i, t in rows], SCHEMA)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == brute(rows)


def test_differences_from_a_centre_rule_out_no_link(spark, monkeypatch):
    """One base, copies too far from it, and copies of those: what is linked meets by its differences only."""
    monkeypatch.setattr(near_dedup, "SMALL", 1)
    r = random.Random(5)
    base = [f"b{i}" for i in range(200)]
    rows = []
    for k in range(40):
        own = list(base)
        for j in range(2 if k < 25 else 9):
            own[r.randrange(200)] = f"e{k}.{j}"
        rows.append(own)
    for k in range(30, 40):  # near the far ones, not near the base
        own = list(rows[k])
        own[r.randrange(200)] = f"f{k}"
        del own[r.randrange(200)]
        rows.append(own)
    rows = list(enumerate(map(" ".join, rows)))
    got = near_dedup.find(spark.createDataFrame([(i, t, "x", "y") for i, t in rows], SCHEMA)).collect()
    want = brute(rows)
    assert len({c for _, c, _ in want.values()}) > 3
    assert {x.doc_id: (x.n_shingles, x.component_id, x.kept) for x in got} == want


def test_nulls_repeats_and_empty_table(spark):
    same = "one two three four five six"
    rows = [(1, None), (2, ""), (7, same), (5, same), (5, same), (None, same), (None, None)]
    got = near_dedup.find(spark.createDataFrame([(i, t, None, None) for i, t in rows], SCHEMA)).collect()
    want = [(1, 0, 1, True), (2, 0, 2, True), (7, 2, 5, False), (5, 2, 5, True), (5, 2, 5, True), (None, 2, 5, False), (None, 0, None, False)]
    assert sorted(map(str, ((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got))) == sorted(map(str, want))
    assert near_dedup.find(spark.createDataFrame([], SCHEMA)).count() == 0
    assert near_dedup.deduplicate(spark.createDataFrame([], SCHEMA)).columns == ["doc_id", "text", "a", "component_id"]


def test_texts_of_one_doc_id_are_one_document(spark):
    x, y = "one two three four five six", "nothing of this kind is said there"
    rows = [(3, x), (5, x), (5, y), (7, y), (8, "alone")]
    got = near_dedup.find(spark.createDataFrame([(i, t, None, None) for i, t in rows], SCHEMA)).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in got) == [(3, 3, True), (5, 3, False), (5, 3, False), (7, 3, False), (8, 8, True)]


def test_a_very_long_text_counts_whole(spark):
    r = random.Random(2)
    long = [f"w{r.randrange(50_000)}" for _ in range(150_000)]
    tail = long[:100_000] + [f"v{r.randrange(50_000)}" for _ in range(50_000)]
    near = long[:60_000] + ["new"] + long[60_000:]
    rows = [(1, " ".join(long)), (2, " ".join(tail)), (3, " ".join(near))]
    got = near_dedup.find(spark.createDataFrame([(i, t, None, None) for i, t in rows], SCHEMA)).collect()
    assert {x.doc_id: x.component_id for x in got} == {1: 1, 2: 2, 3: 1}


def test_deduplicate_keeps_one_row_of_each_component(spark):
    a, b, c = ("".join(f"{x}{k} " for k in range(20)) for x in "abc")
    rows = [(1, a), (2, a), (2, b), (None, c), (None, c), (None, a), (5, a), (3, "x y"), (3, "x y"), (None, None), (4, " \t"), (None, "lone text")]
    got = near_dedup.deduplicate(spark.createDataFrame([(i, t, "p", None) for i, t in rows], SCHEMA))
    assert got.columns == ["doc_id", "text", "a", "component_id"]
    want = [(1, a), (2, b), (None, c), (3, "x y"), (None, None), (4, " \t"), (None, "lone text")]
    assert sorted(map(str, ((r.doc_id, r.text) for r in got.collect()))) == sorted(map(str, want))


def test_sketch_fills_every_coordinate_alike_in_any_company():
    sets = [np.unique(near_dedup.splitmix(np.arange(n, dtype=np.uint64))) for n in (1, 2, 5, 100, 3000)]
    together = near_dedup.sketches(sets)
    assert together.shape == (5, 128)
    for own, x in zip(sets, together):
        assert (near_dedup.sketches([own])[0] == x).all()
        assert len(np.unique(x)) > 100  # no coordinate stays at its first value


def test_sketch_estimates_similarity():
    x = near_dedup.splitmix(np.arange(0, 900, dtype=np.uint64))
    y = near_dedup.splitmix(np.arange(100, 1000, dtype=np.uint64))
    a, b = near_dedup.sketches([np.unique(x), np.unique(y)])
    assert abs((a == b).mean() - 0.8) < 0.16


def test_sketches_rarely_rule_out_a_link():
    """At similarity 0.75 the agreement stays above the bound; the chance is that of 128 independent coordinates."""
    r = np.random.default_rng(4)
    alike = []
    for _ in range(300):
        e = r.integers(0, 2**63, 700, dtype=np.uint64)
        a, b = near_dedup.sketches([np.unique(e[:600]), np.unique(e[100:])])  # 500 of 700
        alike.append((a == b).mean())
    assert abs(np.mean(alike) - 5 / 7) < 0.01 and np.std(alike) < 0.045 and min(alike) >= near_dedup.LIKELY
