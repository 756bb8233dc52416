"""Searches, fingerprints, line dedup, mixing, url trust and the pipeline against brute force."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from quarrykit.llm import ann, imatch, line_dedup, mixing, url_trust
from quarrykit.llm.queries import URL_RULES

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], DOCS)


def test_ann_against_brute_force(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 16))
    x[300:700] = x[300]  # a large group of copies
    ids = rng.permutation(1500)
    rows = [(int(i), [float(v) for v in row], 1) for i, row in zip(ids, x)]
    odd = [(2000, None, 1), (2020, [0.0] * 16, 1), (2040, [float("nan")] + [1.0] * 15, 1), (2060, [1.0], 1), (2080, [None] + [1.0] * 15, 1), (None, [1.0] * 16, 1), rows[0]]
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, query int")
    got = {}
    for r in ann.search(table, rerank=300, books=6, size=64).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    by_id = dict(zip(ids.tolist(), x))
    hits = total = 0
    assert set(got) == {i for i in by_id if i % 20 == 0}
    for q, rows_ in got.items():
        rows_.sort()
        best = sorted(((-float(by_id[q] @ v), i) for i, v in by_id.items() if i != q))[:20]
        assert [r[0] for r in rows_] == list(range(1, 21)) and all(abs(s - by_id[q] @ by_id[i]) < 1e-9 for _, i, s in rows_)
        hits += len({i for _, i, _ in rows_} & {i for _, i in best})
        total += 20
    assert hits / total > 0.95
    few = spark.createDataFrame([(0, [1.0, 0.0], 1), (1, [0.5, 1.0], 1)], table.schema)
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in ann.search(few).collect()] == [(0, 1, 1, 0.5)]
    assert ann.search(table.limit(0)).count() == 0


def test_additive_codes_improve_with_books():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 12)).astype(np.float32)
    errors = []
    for books in (1, 4):
        made = ann.Codebooks.fit(x, books, 32, 8)
        codes = made.encode(x, 8)
        near = sum(made.words[b][codes[:, b]] for b in range(books))
        errors.append(((x - near) ** 2).sum(1).mean())
        assert np.allclose(made.norms(codes), (near**2).sum(1), atol=1e-3)
    assert errors[1] < 0.6 * errors[0]


def test_imatch(spark):
    r = random.Random(3)
    rows = [(i, " ".join(f"w{min(int(r.expovariate(0.02)), 400)}" for _ in range(r.randint(0, 200))), "s") for i in range(0, 600, 2)]
    rows += [(601, None, "s"), (603, "", "s"), (605, rows[3][1], "s"), (607, "é" * 31, "s")]
    got = {x.doc_id: x for x in imatch.compare(docs(spark, rows), parts=5).collect()}
    order = sorted(rows, key=lambda x: -x[0])
    for k, (i, t, _) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        assert got[i].n_chars == len(t)
        assert got[i].edited_sha256 == hashlib.sha256((t[: len(t) - half] + after[:half]).encode()).hexdigest()
    assert got[605].fingerprint == got[rows[3][0]].fingerprint and got[601].fingerprint == got[603].fingerprint
    assert all(0 <= x.near_edited <= 1 and 0 <= x.near_next <= 1 for x in got.values())
    long = [x for x in got.values() if x.n_chars > 400]
    assert np.mean([x.near_edited for x in long]) > 2 * np.mean([x.near_next for x in long])
    lone = imatch.compare(docs(spark, [(5, "a b", "s"), (5, "a b", "s")])).collect()
    assert len(lone) == 2 and lone[0] == lone[1] and lone[0].near_next == 1.0
    assert imatch.compare(docs(spark, [])).count() == 0


def test_imatch_keeps_every_row_and_any_lexicon(spark, monkeypatch):
    r = random.Random(9)
    text = lambda n: " ".join(f"w{r.randrange(60)}" for _ in range(n))
    rows = [(r.choice([None, 1, 2, 3]), text(r.randint(0, 30)), "s") for _ in range(60)] + [(4, text(60_000), "s")]
    d = docs(spark, rows).withColumns({c: F.lit("z") for c in ("id", "h", "term", "kind", "sha", "prints", "next_id", "part", "copies")})
    got = sorted(map(tuple, imatch.compare(d).collect()), key=str)
    assert Counter(x[0] for x in got) == Counter(i for i, _, _ in rows)
    assert Counter(x[1] for x in got) == Counter(len(t) for _, t, _ in rows)
    monkeypatch.setattr(imatch, "ROOM", 0)  # the lexicon is shuffled
    assert sorted(map(tuple, imatch.compare(d).collect()), key=str) == got


def test_ann_recall_at_the_registered_parameters(spark):
    """6,000 vectors without structure, of which a query reranks 100."""
    x = np.random.default_rng(11).normal(size=(6000, 32)).astype(np.float32)
    table = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id long, embedding array<float>")
    got = {}
    for r in ann.search(table.repartition(4), every=100).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    x = x.astype(np.float64)
    hits = [len(got[q] & set(np.argsort(-np.where(np.arange(6000) == q, -np.inf, x @ x[q]))[:20].tolist())) for q in range(0, 6000, 100)]
    assert len(got) == 60 and np.mean(hits) / 20 >= 0.95


def test_ann_ties_go_to_the_smaller_id(spark):
    rows = [(i, [1.0, float(i % 3)]) for i in range(60)]  # three classes of twenty
    got = sorted((r.query_id, r.rank, r.vec_id) for r in ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), top=25).collect())
    for q in (0, 20, 40):
        want = sorted((i for i, _ in rows if i != q), key=lambda i: (-(1 + (q % 3) * (i % 3)), i))[:25]
        assert [v for a, _, v in got if a == q] == want


def test_ann_misses_nothing_on_other_rows(spark):
    """Tiny, huge and mixed lengths, near copies and ties: the rows found are those of brute force."""
    g = np.random.default_rng(7)
    n = 700
    x = g.normal(size=(n, 16))
    copies = x.copy()
    copies[:400] = x[0] + 1e-3 * x[:400]
    rows = {"tiny": x * 1e-22, "huge": x * 1e20, "mixed": x * 10.0 ** g.integers(-12, 12, (n, 1)), "near copies": copies, "ties": np.sign(x[:, :10]), "apart": x + 100.0}
    for name, own in rows.items():
        own = own.astype(np.float32)
        table = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(own)], "vec_id long, embedding array<float>")
        got = {}
        for r in ann.search(table, books=4, size=16).collect():
            got.setdefault(r.query_id, {})[r.rank] = r.vec_id
        exact = own.astype(np.float64)
        for q in range(0, n, 20):
            score = np.einsum("ij,ij->i", np.broadcast_to(exact[q], exact.shape), exact)
            want = [i for i in np.lexsort((np.arange(n), -score)).tolist() if i != q][:20]
            assert [got[q][k] for k in range(1, 21)] == want, (name, q)


def brute_lines(rows, threshold):
    key = lambda line: "".join(c.lower() if c.isascii() else c for c in line.strip(" \t\n\r\x0b\x0c"))
    counts = Counter(k for _, t, _ in rows for k in {key(x) for x in (t or "").split("\n")} if k)
    return sorted((i, len(lines := (t or "").split("\n")), "\n".join(x for x in lines if counts[key(x)] < threshold)) for i, t, _ in rows)


def line_rows(seed, n, first=0):
    r = random.Random(seed)
    common = [f"  Common {k}\t" for k in range(6)] + [f"COMMON {k}" for k in range(6)] + ["", "  "]
    return [(first + i, "\n".join(r.choice(common) if r.random() < 0.5 else f"own {r.random()}" for _ in range(r.randint(1, 6))), "s") for i in range(n)]


def test_line_dedup_and_undo(spark, monkeypatch):
    a, b = line_rows(1, 40) + [(900, None, "s"), (901, "", "s"), (902, "é\nÉ", "s")], line_rows(2, 60, 100)

    def lines(rows, store):
        return sorted((x.doc_id, x.n_lines, x.kept_text) for x in line_dedup.drop_lines(docs(spark, rows), store).collect())

    store = line_dedup.LineStore(spark, 10, 3).insert(docs(spark, a))
    assert lines(a, store) == brute_lines(a, 10)
    before = {(bytes(x.key), x.n) for x in store.counts().collect()}
    store.insert(docs(spark, b))
    assert lines(a + b, store) == brute_lines(a + b, 10)
    monkeypatch.setattr(line_dedup, "TOGETHER", 7)  # shards are dealt out
    assert lines(a + b, store) == brute_lines(a + b, 10)
    store.delete(docs(spark, b))
    assert {(bytes(x.key), x.n) for x in store.counts().filter("n > 0").collect()} == before
    assert lines(a, store) == brute_lines(a, 10)
    assert lines(a, store.rebuild_filters()) == brute_lines(a, 10)
    twice = [(1, "x\ny", "s")] * 10
    assert {x.n_dropped for x in line_dedup.dedup(docs(spark, twice)).collect()} == {2}
    assert line_dedup.dedup(docs(spark, [])).count() == 0
    store = line_dedup.LineStore(spark, 10, 3).insert(docs(spark, a)).delete(docs(spark, b))  # never inserted
    assert store.counts().agg(F.min("n")).first()[0] == 0


def test_copies_count_once_where_asked(spark):
    rows = [(i, f"Shared passage one\nshared passage two\nown {i}", "s") for i in range(12)]
    rows += [(100, "shared passage two\nShared passage one", "s"), (None, "Shared passage one\nnull", "s"), (None, "Shared passage one\nelse", "s")]
    rows += [(200 + i, "Shared passage ONE \nonly in copies\nand this", "s") for i in range(15)]
    d = docs(spark, rows)
    got = line_dedup.drop_lines(d, line_dedup.fill_once(d, 10)).collect()
    assert len(got) == len(rows)
    want = {(i, f"own {i}") for i in range(12)} | {(100, ""), (None, "null"), (None, "else")} | {(200 + i, "only in copies\nand this") for i in range(15)}
    assert {(x.doc_id, x.kept_text) for x in got} == want
    assert {x.kept_text for x in line_dedup.dedup(d).collect() if (x.doc_id or 0) >= 200} == {""}


def test_line_dedup_of_a_very_long_text_and_null_ids(spark):
    long = "\n".join(f"line {k % 70_000}" for k in range(100_000))
    rows = [(None, "line 5\nx", "s")] * 10 + [(1, long, "s"), (1, "x", "s")]
    assert sorted((str(x.doc_id), x.n_lines, x.n_dropped) for x in line_dedup.dedup(docs(spark, rows)).collect()) == [("1", 1, 1), ("1", 100_000, 2)] + [("None", 2, 2)] * 10


def test_lines_of_many_copies_are_handed_on_once(spark):
    text = "\n".join(f"line {k}" for k in range(20))
    rows = [(i, text, "s") for i in range(20_000)] + [(50_000 + i, f"own {i}\nline 3", "s") for i in range(50)]
    d = docs(spark, rows).repartition(8)
    assert line_dedup.lines_of(d).count() <= 8 * 20 + 2 * 50
    got = {x.doc_id: (x.n_lines, x.n_dropped, x.kept_text) for x in line_dedup.dedup(d).collect()}
    assert len(got) == len(rows) and {got[i] for i in range(20_000)} == {(20, 20, "")}
    assert all(got[50_000 + i] == (2, 1, f"own {i}") for i in range(50))


def test_filters_grow_by_themselves(spark):
    """Batch after batch of new frequent lines, then some are taken back: no stash piles up, and lines are right each time."""
    store, all_rows, buckets = line_dedup.LineStore(spark, 2, 2), [], []
    for turn in range(4):
        batch = [(1000 * turn + i, "\n".join(f"turn {turn} line {(7 * i + j) % (20 * 4**turn)}" for j in range(8 * 4**turn)), "s") for i in range(8)]
        all_rows += batch
        store.insert(docs(spark, batch))
        rows = store.filters().collect()
        buckets.append(sum(x.buckets for x in rows))
        assert not any(x.stash for x in rows)
    assert buckets[-1] > 8 * buckets[0]
    lines = lambda rows: sorted((x.doc_id, x.n_lines, x.kept_text) for x in line_dedup.drop_lines(docs(spark, rows), store).collect())
    assert lines(all_rows) == brute_lines(all_rows, 2)
    store.delete(docs(spark, all_rows[:5]))
    assert lines(all_rows[5:]) == brute_lines(all_rows[5:], 2)


def test_cuckoo_filter():
    keys = [hashlib.md5(str(i).encode()).digest() for i in range(3000)]
    made = line_dedup.CuckooFilter(256)  # too small: the rest goes to the stash
    made.insert(keys)
    assert made.stash and made.contains(keys).all()
    made.delete(keys[:1500])
    assert made.contains(keys[1500:]).all() and made.contains(keys[:1500]).mean() < 0.1


def test_mixing(spark):
    r = random.Random(9)
    rows = [(i, " ".join(["w"] * r.randint(1, 40)), s) for i, s in enumerate(r.choices(["a", "b", "c", None], [70, 20, 9, 1], k=800))]
    table = docs(spark, rows).withColumn("block", F.lit("x"))
    counted = mixing.count_tokens(table)
    draw = mixing.Draw(counted, entropy=0.9, repeats=3.0, block_tokens=500)
    out = draw.rows(counted).collect()
    size, total = {i: len(t.split()) for i, t, _ in rows}, Counter()
    for i, t, s in rows:
        total[s] += len(t.split())
    shares = {s: n / sum(total.values()) for s, n in total.items()}

    def weights(a):
        z = sum(p**a for p in shares.values())
        return {s: p**a / z for s, p in shares.items()}

    low, high = 0.0, 1.0  # the exponent by plain bisection
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if -sum(w * math.log(w) for w in weights(mid).values()) >= 0.9 * math.log(4) else (low, mid)
    a = max(low, 1 - math.log(3) / math.log(max(total.values()) / min(total.values())))
    want = weights(a)
    budget = max(total[s] / want[s] for s in total)
    drawn, largest = Counter(), max(size.values())
    for x in out:
        drawn[x.source] += x.tokens
        assert abs(x.weight - want[x.source]) < 1e-4
    for s in total:
        assert -1 <= drawn[s] - want[s] * budget <= 2 * largest and drawn[s] <= 3 * total[s] + 2 * largest
    copies = Counter(x.doc_id for x in out)
    for s in total:  # whole epochs, then a part of one more
        n = {copies[i] for i, _, t in rows if t == s}
        assert max(n) - min(n) <= 1 and min(n) >= 1
    again = mixing.Draw(counted, entropy=0.9, repeats=3.0, block_tokens=500).rows(counted)
    assert sorted(map(tuple, again.collect()), key=str) == sorted(map(tuple, out), key=str)
    assert draw.repeated(table).columns == table.columns and draw.repeated(table).count() == len(out)
    empty = mixing.count_tokens(table.limit(0))
    assert mixing.Draw(empty).rows(empty).count() == 0
    alone = mixing.count_tokens(docs(spark, [(1, "a b", "s"), (2, None, "s"), (3, "", None)]))
    assert sorted(x.doc_id for x in mixing.Draw(alone).rows(alone).collect()) == [1, 2, 3]


def test_mixing_draws_equal_rows_together(spark):
    rows = [(None, "one two", "a")] * 3 + [(5, "x " * 50_000, "a")] + [(i, f"w{i} v", "a") for i in range(10, 60)] + [(i, "w " * 30, "b") for i in range(100, 140)]
    table = docs(spark, rows)
    counted = mixing.count_tokens(table)
    out = mixing.Draw(counted, entropy=1.0, repeats=2.0, block_tokens=100).rows(counted).collect()
    copies = Counter(x.doc_id for x in out)
    assert copies[None] % 3 == 0 and copies[None] > 0 and copies[5] >= 1
    assert {x.tokens for x in out if x.doc_id == 5} == {50_000}


def test_url_trust(spark):
    link = lambda *hosts: "".join(f'<a HREF="https://{h}/x">' for h in hosts)
    rows = [
        (1, "https://good.com/a", link("liked.org", "liked.org")), (2, "http://bad.net/es/1", None), (3, "http://liker.org/", link("bad.net")),
        (4, "http://LIKED.org?x", ""), (5, "nothing", link("bad.net")), (6, None, None), (7, "http://www.example.com/en/x", ""),
        (8, "http://a.example.com/en/x", ""), (9, "http://badexample.com/en/", ""), (10, "http://com", ""), (10, "http://com", ""),
    ]
    got = {x.page_id: x for x in url_trust.judge(spark.createDataFrame([(*x, "h") for x in rows], "page_id long, url string, html string, host string"), URL_RULES, spread=0.0).collect()}
    assert [(got[i].rule, got[i].verdict) for i in (1, 2, 7, 8, 9)] == [("com/", "allow"), ("net/es/", "block"), ("www.example.com/en/", "allow"), ("example.com/en/", "block"), ("com/", "allow")]
    assert got[3].verdict == "block" and got[4].verdict == "allow" and (got[4].host, got[4].path) == ("liked.org", "")
    assert [(got[i].host, got[i].path, got[i].rule, got[i].verdict) for i in (5, 6)] == [("", "", None, "allow")] * 2
    assert got[10].rule is None and got[10].verdict == "allow"
    assert url_trust.judge(spark.createDataFrame([], "page_id long, url string, html string"), URL_RULES).count() == 0


def test_url_trust_ties_end_at_owners(spark):
    """Names below a public suffix and numeric hosts have different owners; hosts of one domain have one."""
    urls = [f"http://spam{k}.co.uk/fr/x" for k in range(3)] + [f"http://news{k}.co.uk/" for k in range(5)]
    urls += ["http://10.0.0.1/bad/", "http://172.16.0.1/", "http://192.168.0.1:8080/", "http://[::1]:80/", "http://user@10.0.0.1/"]
    urls += ["http://a.shop.co.uk/bad/1", "http://b.shop.co.uk:81/", "http://c.shop.co.uk/", *(f"http://plain{k}.org/" for k in range(30))]
    rules = [("block", f"spam{k}.co.uk", "/") for k in range(3)] + [("block", "10.0.0.1", "/"), ("block", "a.shop.co.uk", "/")]
    table = spark.createDataFrame([(k, u, None) for k, u in enumerate(urls)], "page_id long, url string, html string")
    got = {urls[x.page_id]: x.verdict for x in url_trust.judge(table, rules).collect()}
    loose = {urls[x.page_id]: x.verdict for x in url_trust.judge(table, rules, spread=0.0).collect()}
    blocked = {u for u, v in got.items() if v == "block"}
    assert blocked == {u for u, v in loose.items() if v == "block"} == {f"http://spam{k}.co.uk/fr/x" for k in range(3)} | {"http://10.0.0.1/bad/", "http://a.shop.co.uk/bad/1", "http://b.shop.co.uk:81/", "http://c.shop.co.uk/"}
    unlisted = {urls[x.page_id]: x.verdict for x in url_trust.judge(table, rules, spread=0.0, suffixes=[]).collect()}
    assert unlisted["http://news0.co.uk/"] == "block"  # what the list of suffixes prevents


def test_url_trust_equals_plain_propagation(spark):
    """A planted graph at the registered parameters: farms that link to blocked hosts, and hosts that trusted ones link to."""
    r = random.Random(7)
    hosts = [f"h{k}.site{k % 9}.org" for k in range(40)] + [f"bad{k}.net" for k in range(6)] + ["good.com"]
    pages, page = [], 0
    for h in hosts:
        for _ in range(r.randint(1, 4)):
            to = r.sample([x for x in hosts if x.startswith("bad")], 2) if h in hosts[:6] else r.sample(hosts[6:40] + ["good.com"], 2)
            pages.append((page, f"http://{h}{'/es/' if h.startswith('bad') else '/x'}{page}", "".join(f'<a href="//{x.upper()}/y">' for x in to)))
            page += 1
    got = url_trust.judge(spark.createDataFrame(pages, "page_id long, url string, html string"), URL_RULES).collect()
    ruled = {"bad": "block", "goo": "allow"}
    sizes = Counter(u.split("/")[2] for _, u, _ in pages)
    edges = Counter()
    for _, u, html in pages:
        h = u.split("/")[2]
        for x in html.lower().split('href="//')[1:]:
            if x.split("/")[0] != h:
                edges[h, x.split("/")[0]] += 1
    for h, n in sizes.items():
        domain = ".".join(h.split(".")[-2:])
        if domain != h:
            edges[h, domain] += n
            edges[domain, h] += n
    ROUNDS = math.ceil(math.log(0.01) / math.log(0.85))
    trust = brute_rank({"good.com": 1.0}, edges, rounds=ROUNDS)
    distrust = brute_rank({h: 1.0 for h in hosts if h[:3] == "bad"}, {(b, a): n for (a, b), n in edges.items()}, rounds=ROUNDS)
    d = np.array([distrust.get(h, 0) for h in hosts])
    want = {h: "block" if distrust.get(h, 0) > max(trust.get(h, 0), d.mean() + d.std()) else "allow" for h in hosts}
    assert {x.host: x.verdict for x in got if x.decided_by == "host"} == {h: v for h, v in want.items() if h[:3] not in ruled}
    assert {h for h, v in want.items() if v == "block" and h[:3] not in ruled} < set(hosts[:7])


def test_url_rules_of_one_length_block(spark):
    rules = [("allow", "b.a.org", "/"), ("block", "a.org", "/ab"), ("block", "a.org", "/a")]  # the first two are equally long
    table = spark.createDataFrame([(1, "http://b.a.org/ab"), (2, "http://b.a.org/a"), (3, "http://c.org/"), (None, "http://a.org/a")], "page_id long, url string")
    got = url_trust.judge(table.withColumn("html", F.lit(None).cast("string")), rules).collect()
    assert {x.page_id: (x.rule, x.verdict) for x in got} == {1: ("a.org/ab", "block"), 2: ("b.a.org/", "allow"), 3: (None, "allow"), None: ("a.org/a", "block")}


def brute_rank(seeds, edges, rounds=12, damping=0.85):
    out = Counter()
    for (a, _), n in edges.items():
        out[a] += n
    scores = dict(seeds)
    for _ in range(rounds):
        new = Counter(seeds)
        for (a, b), n in edges.items():
            new[b] += damping * n / out[a] * scores.get(a, 0)
        scores = new
    return scores


def test_propagation_equals_plain_rounds(spark):
    r = random.Random(2)
    edges = Counter((r.randrange(12), r.randrange(12)) for _ in range(60))
    seeds = {1: 1.0, 4: 0.5}
    total = Counter()
    for (a, _), n in edges.items():
        total[a] += n
    e = spark.createDataFrame([("trust", str(a), str(b), n / total[a]) for (a, b), n in edges.items()], "kind string, a string, b string, share double")
    s = spark.createDataFrame([("trust", str(k), v) for k, v in seeds.items()], "kind string, host string, seed double")
    got = {int(x.host): x.score for x in url_trust.propagate(s, e, 0.85, 12).collect()}
    want = brute_rank(seeds, edges)
    assert all(abs(got.get(k, 0) - v) < 1e-9 for k, v in want.items())


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(1)
    words = {"en": "the of and that with from this wing shore tion", "de": "der die und mit schaft ung über zwischen nicht"}
    rows = []
    for i in range(200):
        lang = r.choice(list(words))
        body = "\n".join(" ".join(r.choice(words[lang].split()) + r.choice(["", "s", "en"]) for _ in range(12)) for _ in range(5))
        rows.append((i, body + ("\nShared footer" if i % 3 == 0 else ""), lang, f"src{min(3, i % 7)}", None))
    rows += [(500 + k, rows[5][1], "en", "src0", None) for k in range(5)] + [(600, "12 34 !!", "en", "src0", 9), (601, None, None, None, None)]
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    seen, d = [], spark.read.parquet(str(tmp_path / "documents.parquet"))
    clashing = ["row", "key", "n_lines", "kept_text", "_drops", "_gone", "weight", "epoch", "block", "_key", "tokens", "node", "label", "score"]
    d = d.withColumns({c: F.lit("x") for c in clashing})
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, d, str(tmp_path))
        if k < 4:
            assert out.columns == d.columns
        out.write.parquet(str(tmp_path / f"s{k}"))
        d = spark.read.parquet(str(tmp_path / f"s{k}"))
        seen.append(d.collect())
    ids = [{x.doc_id for x in s} for s in seen]
    assert ids[0] == {x[0] for x in rows} - {600, 601} and ids[1] == ids[0]
    assert all("Shared footer" not in x.text and x.n_chars in (None, len(x.text)) for x in seen[1])
    assert ids[2] == ids[0] - {500, 501, 502, 503, 504} and ids[3] == ids[2] == ids[4]
    assert len(seen[3]) >= len(seen[2]) and len(seen[4]) == len(seen[3])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(seen[4])


def test_pipeline_equals_brute_force(spark, tmp_path):
    """All five stages by plain code on whole lists, and the library's tokens; and an empty table."""
    from tokenizers import Tokenizer

    import corpus_pipeline
    from quarrykit.llm import language_id
    from quarrykit.llm.queries import BPE_PATH

    r = random.Random(12)
    words = {"en": "the of and that with from this wing shore tion", "de": "der die und mit schaft ung über zwischen nicht"}
    line = lambda lang, n: " ".join(r.choice(words[lang].split()) + r.choice(["", "s", "en", "x1"]) for _ in range(n))
    rows = []
    for i in range(90):
        lang = r.choice(list(words))
        text = "\n".join([line(lang, 11) for _ in range(6)] + ["Shared  footer"] * (i % 4 == 0) + ["rare footer"] * (i % 30 == 0))
        rows.append((i, text, r.choice([lang, None]), f"src{min(2, i % 5)}", len(text)))
    for k in range(40):  # copies, near copies and what is no language
        i, t, lang, source, n = rows[r.randrange(90)]
        changed = t if k % 3 == 0 else t.replace(t.split()[k % 20], "changed", 1) if k % 3 == 1 else "12 34 !! 56"
        rows.append((200 + k, changed, lang, source, n))
    rows += [(None, None, None, None, None), (None, rows[3][1], "en", "src1", 5)]
    table = spark.createDataFrame(rows, DOCS)
    table.write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    model = language_id.train(table.filter(~language_id.held_out()))
    docs_ = [x for x in rows if (p := model.predict(x[1]))[0] != "und" and p[1] >= 0.4]
    key = lambda s: "".join(c.lower() if c.isascii() else c for c in s.strip(" \t\n\r\x0b\x0c"))
    lists = {tuple(map(key, t.split("\n"))) for _, t, *_ in docs_}
    counts = Counter(k for keys in lists for k in set(keys) if k)
    docs_ = [(i, "\n".join(x for x in t.split("\n") if counts[key(x)] < 10), source) for i, t, _, source, _ in docs_]
    assert any("Shared" in t for _, t, *_ in rows) and not any("Shared" in t for _, t, _ in docs_) and any("rare" in t for _, t, _ in docs_)

    def shingles(t):
        w = [x for x in "".join(c.lower() if c.isascii() else c for c in t).replace("\n", " ").split(" ") if x]
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    sets = [shingles(t) for _, t, _ in docs_]
    label = list(range(len(docs_)))
    for a in range(len(docs_)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                label = [label[b] if x == label[a] else x for x in label]
    groups = {}
    for x, d in zip(label, docs_):
        groups.setdefault(x, []).append(d)
    kept = [min(g, key=lambda d: (d[0] is None, d[0] or 0)) for g in groups.values()]
    assert len(kept) < len(docs_) < len(rows)

    library = Tokenizer.from_file(BPE_PATH)
    want = {}
    for i, t, source in kept:
        ids = library.encode(t, add_special_tokens=False).ids
        want[i] = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest(), source)
    copies = Counter(x.doc_id for x in got)
    assert set(copies) == set(want) and all((x.n_tokens, x.ids_sha256, x.decoded_sha256) == want[x.doc_id][:3] for x in got)
    for source in {w[3] for w in want.values()}:  # whole epochs, then a part of one more; at most twice and a block
        n = [copies[i] for i, w in want.items() if w[3] == source]
        assert 1 <= min(n) and max(n) - min(n) <= 1 and max(n) <= 3
    drawn = {s: sum(copies[i] * len(t.split()) for i, t, source in kept if source == s) for s in {d[2] for d in kept}}
    total = {s: sum(len(t.split()) for _, t, source in kept if source == s) for s in drawn}
    share = lambda x: -sum(v / sum(x.values()) * math.log(v / sum(x.values())) for v in x.values())
    assert share(drawn) >= share(total) - 0.02  # no less even than before

    table.limit(0).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0


def test_url_trust_of_very_long_html(spark):
    filler = "<p>" + "x" * 200 + "</p>"
    rows = [(1, "http://bad.net/es/1", ""), (2, "http://far.org/", filler * 20_000 + '<a href="http://bad.net/x">' * 3), (3, "http://other.org/", filler * 20_000)]
    got = {x.page_id: x.verdict for x in url_trust.judge(spark.createDataFrame(rows, "page_id long, url string, html string"), URL_RULES, spread=0.0).collect()}
    assert got == {1: "block", 2: "block", 3: "allow"}
