"""BPE, licence scan, language ID and toxicity against the library, brute force or held-out accuracy."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from quarrykit.llm import bpe, language_id, license_scan, toxicity
from quarrykit.llm.license_templates import TEMPLATES

PATH = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, lang string, score string, _text string"


def docs(spark, rows, lang=None):
    return spark.createDataFrame([(i, t, lang[k] if lang else None, "s", "x") for k, (i, t) in enumerate(rows)], DOCS)


def strange_texts():
    r = random.Random(4)
    letters = list("aábcdeèfgh ij\n\tXYZ'sΣς.,!?0123²½ÀİßⅧ日本語한국😀‍́\x1c\xa0　ﬁ<|endoftext|>")
    out = ["".join(r.choice(letters) for _ in range(r.randrange(80))) for _ in range(300)]
    return [*out, None, "", "   ", "<|endoftext|> a<|startoftext|>", "a" * 5000, "!" * 3000, "it's we'll THEY'RE"]


@pytest.mark.parametrize("size", [0, 50, 100_000])
def test_bpe_equals_the_library(spark, size):
    from tokenizers import Tokenizer

    texts = strange_texts()
    d = docs(spark, list(enumerate(texts)))
    out = bpe.encode(d, PATH, bpe.build_lexicon(d, PATH, size) if size else bpe.Lexicon.compile([]), ids=True).cache()
    library = Tokenizer.from_file(PATH)
    want = {}
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        want[i] = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest(), decoded)
    for r in out.collect():
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == want[r.doc_id][:3]
    assert all(r.text == want[r.doc_id][3] for r in bpe.decode(out, PATH).collect())


def test_lexicon_is_a_minimal_map(tmp_path):
    r = random.Random(2)
    words = sorted({"".join(r.choice("abcé") for _ in range(r.randint(1, 7))) for _ in range(2000)})
    made = bpe.Lexicon.compile([(w, [k, k + 1][: k % 3]) for k, w in enumerate(words)])
    made.save(str(tmp_path / "l"))
    mapped = bpe.Lexicon.map(str(tmp_path / "l"))
    order = {w: k for k, w in enumerate(sorted(words, key=str.encode))}
    assert mapped.numbers(words).tolist() == [order[w] for w in words]
    assert (mapped.numbers(["zzz", "", "abcabcabcabc", "é!"]) == -1).all()
    assert [mapped.tokens(order[w]) for w in words] == [[k, k + 1][: k % 3] for k, w in enumerate(words)]
    # minimal: no two states have the same future
    futures = {}
    for s in range(len(made.final)):
        arcs = [(int(k) & 255, int(t)) for k, t in zip(made.keys, made.to) if k >> 8 == s]
        assert futures.setdefault((int(made.final[s]), tuple(arcs)), s) == s
    assert len(made.final) < sum(map(len, words)) / 3


def test_bpe_edge_tables(spark):
    empty = spark.createDataFrame([], DOCS)
    assert bpe.encode(empty, PATH, bpe.build_lexicon(empty, PATH)).count() == 0
    rows = [(1, "a b"), (1, "a b"), (None, "c"), (2, None)]
    d = docs(spark, rows)
    assert sorted(r.n_tokens for r in bpe.encode(d, PATH, bpe.build_lexicon(d, PATH)).collect()) == [0, 1, 2, 2]


def plain_alignment(template, text):
    """Longest common subsequence, without a band."""
    row = [0] * (len(text) + 1)
    for a in template:
        old = 0
        for j, b in enumerate(text, 1):
            old, row[j] = row[j], max(row[j], row[j - 1], old + (a == b))
    return row[-1]


def test_license_scan(spark):
    r = random.Random(7)
    filler = lambda n: " ".join(r.choice("lorem ipsum dolor sit amet the of and in a".split()) for _ in range(n))
    rows, want = [], set()
    for k, (name, text) in enumerate(sorted(TEMPLATES.items())):
        words = text.split()
        if len(words) > 40:  # a few words lost, changed or added
            for _ in range(len(words) // 25):
                at = r.randrange(len(words))
                words[at : at + 1] = r.choice([[], ["changed"], [words[at], "added"]])
        rows.append((k, f"{filler(50)}\n{' '.join(words).upper()}\n{filler(30)}"))
        want.add((k, name))
    rows += [(100, None), (101, ""), (102, filler(2000)), (103, "All rights reserved.\n" * 30), (103, "All rights reserved.\n" * 30)]
    got = license_scan.scan(docs(spark, rows), TEMPLATES, 0.75).collect()
    assert {(g.doc_id, g.template) for g in got} >= want
    assert sum(g.doc_id == 103 for g in got) == 60 and not [g for g in got if g.doc_id in (100, 101, 102)]
    texts = dict(rows)
    for g in got:
        span = license_scan.WORD.findall(texts[g.doc_id][g.span_start : g.span_end].lower())
        template = license_scan.WORD.findall(TEMPLATES[g.template].lower())
        assert g.matched_words <= plain_alignment(template, span) and g.coverage == g.matched_words / g.template_words
        if (g.doc_id, g.template) in want:
            assert g.matched_words >= 0.95 * plain_alignment(template, span)
    assert license_scan.scan(spark.createDataFrame([], DOCS), TEMPLATES).count() == 0


def test_license_scan_misses_no_changed_notice():
    scanner = license_scan.Scanner(TEMPLATES, 0.75)
    assert "notice-mit" in {m[0] for m in scanner.scan("xx Licensed under the MIT License yy")}
    assert "notice-all-rights-reserved" in {m[0] for m in scanner.scan("All the rights are reserved.")}
    for name, text in TEMPLATES.items():
        words = license_scan.WORD.findall(text.lower())
        spare = len(words) - int(np.ceil(0.75 * len(words)))
        for first in range(min(4, len(words))):
            own = list(words)
            for at in range(first, len(own), 4)[:spare]:
                own[at] = "changed"
            got = [m for m in scanner.scan("one two " + " ".join(own) + " three four") if m[0] == name]
            plain = max(license_scan.align(scanner.words[scanner.names.index(name)], np.array([scanner.vocabulary[w] for w in own]), -4, 4)[0], 0)
            assert bool(got) == (plain >= 0.75 * len(words)), (name, first)


def test_every_fingerprint_is_winnowed(monkeypatch):
    """All keys of the index come from ``winnow`` with windows of two grams or more, and half of the grams or so are left."""
    calls = []

    def seen(hashes, window=license_scan.WINDOW):
        calls.append((len(hashes), window, picked := plain(hashes, window)))
        return picked

    plain = license_scan.winnow
    monkeypatch.setattr(license_scan, "winnow", seen)
    scanner = license_scan.Scanner(TEMPLATES, 0.75)
    assert len(calls) == len(TEMPLATES) and all(w > 1 for n, w, _ in calls if n > 1) and scanner.picked == [p for *_, p in calls]
    assert sum(len(v) for _, places in scanner.index.values() for v in places.values()) == sum(len(p) for *_, p in calls)
    assert sum(len(p) for *_, p in calls) < 0.75 * sum(n for n, *_ in calls)
    for n in range(1, 400):
        for least in (0.75, 0.8, 0.9, 1.0):
            k, w = license_scan.grams(n, least)
            wanted = int(np.ceil(least * n - 1e-9))
            if n <= license_scan.SHORT:
                assert k == 1 and (w == 1 or n // w > n - wanted)
            else:
                assert w > 1 and k + w - 1 <= -(-wanted // (n - wanted + 1))


def test_winnowing_keeps_one_in_each_window():
    h = license_scan.splitmix(np.arange(100, dtype=np.uint64))
    picked = set(license_scan.winnow(h))
    assert all(picked & set(range(i, i + license_scan.WINDOW)) for i in range(97)) and len(picked) < 60


WORDS = {"en": "the of and that with from this thing wing shore", "de": "der die und mit schaft ung zwischen über", "es": "el los que ción mente señor año"}


def sentence(r, lang, n):
    return " ".join(r.choice(WORDS[lang].split()) for _ in range(n))


def test_language_mixtures(spark):
    r = random.Random(5)
    rows = [(i, sentence(r, lang, r.randint(20, 60)), lang) for i in range(120) for lang in [r.choice(list(WORDS))]]
    train = docs(spark, [(i, t) for i, t, _ in rows], [lang for *_, lang in rows])
    model = language_id.train(train)
    assert model.languages == ["de", "en", "es"]
    for lang in WORDS:
        assert model.predict(sentence(r, lang, 40)) == (lang, 1.0)
    mixed = model.mixture(sentence(r, "de", 60) + " " + sentence(r, "es", 30))
    assert set(mixed) == {"de", "es"} and 0.5 < mixed["de"] < 0.8
    for nothing in (None, "", "123 !!", "\n"):
        assert model.predict(nothing) == ("und", 0.0)
    test = docs(spark, [(7, "der und die mit"), (7, "der und die mit"), (None, None), (8, "über " * 20000)])
    got = language_id.predictions(test, model, ["doc_id", "lang"]).collect()
    assert sorted((str(g.doc_id), g.lang_pred) for g in got) == [("7", "de"), ("7", "de"), ("8", "de"), ("None", "und")]
    assert language_id.accept(test, model).columns == test.columns and language_id.accept(test, model).count() == 3
    nobody = language_id.train(spark.createDataFrame([], DOCS))
    assert nobody.predict("der") == ("und", 0.0)


def test_mixtures_equal_a_search_of_all_language_sets(spark):
    """Every set of languages, with its proportions by many rounds: none has a better penalised likelihood."""
    from itertools import combinations

    r = random.Random(15)
    rows = [(i, sentence(r, lang, r.randint(20, 60)), lang) for i in range(120) for lang in [r.choice(list(WORDS))]]
    model = language_id.train(docs(spark, [(i, t) for i, t, _ in rows], [lang for *_, lang in rows]))
    texts = [" ".join(sentence(r, lang, r.choice([3, 10, 40])) for lang in r.sample(list(WORDS), r.randint(1, 3))) for _ in range(60)]
    same = 0
    for text in texts:
        grams, counts = language_id.gram_counts(text)
        p, n = model.probabilities[grams], counts.sum()
        price = language_id.DEPENDENCE * np.log(max(2, n))

        def value(chosen, w):
            return float(counts @ np.log(p[:, chosen] @ w)) - price * (len(chosen) - 1)

        best = None
        for size in (1, 2, 3):
            for chosen in map(list, combinations(range(3), size)):
                w = np.full(size, 1 / size)
                for _ in range(400):
                    w = w * ((counts / (p[:, chosen] @ w)) @ p[:, chosen]) / n
                if best is None or value(chosen, w) > best[0]:
                    best = value(chosen, w), {model.languages[k] for k in chosen}
        got = model.mixture(text)
        assert value([model.languages.index(k) for k in got], np.array(list(got.values()))) > best[0] - 0.02 * price
        same += set(got) == best[1]
    assert same >= 58  # two sets may be equally good: none is worse by more than a fiftieth of a language's price
    shown = language_id.predictions(docs(spark, list(enumerate(texts))), model, ["doc_id"]).collect()
    assert all(x.lang_pred == x.languages[0] and abs(sum(x.proportions) - 1) < 1e-9 and x.score == x.proportions[0] for x in shown)


def test_license_scan_equals_alignment_with_everything(spark):
    """All templates against all texts, without index and without band, again and again on what is left."""
    r = random.Random(21)
    some = {k: v for k, v in TEMPLATES.items() if k.startswith("notice") or k in ("isc", "apache-2.0-header", "zlib")}
    scanner = license_scan.Scanner(some, 0.75)
    filler = lambda n: " ".join(r.choice("lorem ipsum the software is of and in a license".split()) for _ in range(n))
    rows = []
    for k in range(14):
        parts = [filler(r.randint(0, 12))]
        for name in r.sample(sorted(some), r.randint(0, 3)):
            words = some[name].split()
            for at in sorted(r.sample(range(len(words)), len(words) // r.choice([3, 5, 9]))):
                words[at] = r.choice(["changed", "", words[at]])
            parts += [" ".join(words), filler(r.randint(5, 15))]
        rows.append((k, "\n".join(parts)))
    want = []
    for k, text in rows:
        ids = np.array([scanner.vocabulary[w] for w in license_scan.WORD.findall(text.lower())], np.int64)
        for name, template in zip(scanner.names, scanner.words):
            free = ids.copy()
            while True:
                matched, first, last = license_scan.align(template, free, -len(template), len(free))
                if matched < 0.75 * len(template):
                    break
                want.append((k, name))
                free[first : last + 1] = -1
    got = [(g.doc_id, g.template) for g in license_scan.scan(docs(spark, rows), some, 0.75).collect()]
    assert sorted(got) == sorted(want) and len(want) > 10


def test_license_scan_of_a_very_long_text(spark):
    text = "word " * 150_000 + TEMPLATES["notice-cc-by-nc-4.0"] + " word" * 150_000
    got = license_scan.scan(docs(spark, [(1, text)]), TEMPLATES, 0.75).collect()
    spans = {g.template: text[g.span_start : g.span_end] for g in got}
    assert spans["notice-cc-by-nc-4.0"] == "Licensed under CC BY-NC 4.0"


def test_counterfactual_training(spark):
    """Toxic sentences often name one group; with the penalty a neutral mention of it is not toxic."""
    r = random.Random(6)
    calm, bad = "weather train garden music dinner river book walk".split(), ["stupid", "scum", "idiot"]
    rows, marks = [], []
    for i in range(400):
        toxic = i % 4 == 0
        words = [r.choice(calm) for _ in range(12)]
        if toxic:
            words[3] = r.choice(bad) if r.random() < 0.8 else words[3]
            words[5] = "muslims" if r.random() < 0.9 else words[5]
        elif r.random() < 0.05:
            words[5] = "christians"
        rows.append((i, " ".join(words) + "."))
        marks.append((i, int(toxic)))
    d, labels = docs(spark, rows), spark.createDataFrame(marks, "doc_id long, toxic int")
    neutral = "the muslims took a walk in the garden with music."
    plain = toxicity.train(d, labels, fairness=0.0).scorer()
    fair = toxicity.train(d, labels, fairness=20.0).scorer()
    assert plain(neutral) > 0.5 > fair(neutral)
    assert fair("you are scum and an idiot") > 0.5 and fair("music and dinner by the river") < 0.5
    assert abs(fair(neutral) - fair(neutral.replace("muslims", "christians"))) < abs(plain(neutral) - plain(neutral.replace("muslims", "christians")))
    model = toxicity.train(d, labels)
    got = toxicity.score(docs(spark, [(1, None), (2, ""), (2, ""), (None, "scum idiot stupid")]), model, ["doc_id"]).collect()
    assert all(0 <= g.score <= 1 and g.predicted == int(g.score >= 0.5) for g in got) and len(got) == 4
    assert toxicity.train(d, labels.limit(0)).scorer()("x") < 0.01
    assert toxicity.score(d.limit(0), model, ["doc_id"]).count() == 0


def test_every_mention_of_a_long_text_counts(spark, monkeypatch):
    seen = {}

    def fit(rows, toxic, changes, n, *a, times=None, **b):
        seen.update(times=times, changes=changes)
        return np.zeros(n), 0.0

    monkeypatch.setattr(toxicity, "fit", fit)
    text = "The muslims walk. " * 100 + "The gay man walks. " * 50
    d = docs(spark, [(i, text) for i in range(4)])
    toxicity.train(d, spark.createDataFrame([(i, i % 2) for i in range(4)], "doc_id long, toxic int"))
    assert sum(seen["times"]) == 4 * sum(1 for _ in toxicity.swaps(text)) and len(seen["changes"]) < 30


def test_fit_stands_at_the_least_loss():
    """Against plain descent by the numeric gradient of the loss as the docstring states it."""
    r = np.random.default_rng(3)
    rows = [np.flatnonzero(r.random(6) < 0.4) for _ in range(80)]
    toxic = (r.random(80) < 0.3).astype(float)
    changes, times, fairness, l2 = [([0], [1]), ([2, 3], [4]), ([1], [5])], [3, 1, 2], 1.0, 1e-2

    def loss(x):
        w, bias = x[:-1], x[-1]
        p = 1 / (1 + np.exp(-np.array([w[k].sum() + bias for k in rows])))
        balance = np.where(toxic == 1, 0.5 / toxic.mean(), 0.5 / (1 - toxic.mean()))
        moved = np.array([w[come].sum() - w[gone].sum() for gone, come in changes])
        data = -(balance * (toxic * np.log(p) + (1 - toxic) * np.log(1 - p))).mean()
        return data + l2 / 2 * (w**2).sum() + fairness * (np.array(times) * moved**2).sum() / sum(times)

    w, bias = toxicity.fit(rows, toxic, changes, 6, fairness, l2=l2, rounds=4000, times=times)
    x = np.append(w, bias)
    slope = lambda z: np.array([(loss(z + e) - loss(z - e)) / 2e-5 for e in 1e-5 * np.eye(7)])
    plain = np.zeros(7)
    for _ in range(2000):
        plain = plain - 0.5 * slope(plain)
    assert np.abs(slope(plain)).max() < 1e-3
    assert loss(x) - loss(plain) < 0.01 * (loss(np.zeros(7)) - loss(plain))


def test_registered_fairness_closes_the_gap_between_groups(spark):
    """One group stands in most toxic sentences; neutral mentions of it must not be taken for toxic."""
    r = random.Random(12)
    calm = "the garden song river bread morning quiet people travel reading".split()
    rude = "scum vermin filth".split()
    rows, marks = [], []
    for i in range(600):
        toxic = i % 3 == 0
        words = [r.choice(calm) for _ in range(8)]
        if toxic:
            words += [r.choice(rude)] if r.random() < 0.5 else []  # half of them are known by the group alone
            words.append("muslims")
        elif r.random() < 0.4:
            words.append(r.choice(["christians", "jews", "buddhists"]))
        r.shuffle(words)
        rows.append((i, " ".join(words) + "."))
        marks.append((i, int(toxic)))
    d, labels = docs(spark, rows), spark.createDataFrame(marks, "doc_id long, toxic int")
    neutral = [f"the {g} sing a quiet song" for g in ("muslims", "christians", "jews", "buddhists", "hindus")]
    found = {}
    for fairness in (0.0, 1.0):
        scored = toxicity.train(d, labels, fairness=fairness).scorer()
        own = [scored(t) for t in neutral]
        found[fairness] = (max(own) - min(own), sum(s >= 0.5 for s in own), scored("vermin scum filth"))
    assert found[0.0][1] >= 1 and found[1.0][1] == 0  # false positives on neutral mentions
    assert found[1.0][0] < 0.2 * found[0.0][0] and found[1.0][2] > 0.5


def test_toxicity_of_long_words_and_texts_and_many_labels(spark):
    long = "x" * 80
    rows = [(i, f"{long if i % 2 else 'calm'} text number") for i in range(40)] + [(100, "calm " * 200_000 + long), (101, None)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(1, 0), (None, 1), (2, None)], "doc_id long, toxic int")
    d = docs(spark, rows)
    got = {x.doc_id: x.score for x in toxicity.score(d, toxicity.train(d, labels), [F.col("doc_id")]).collect()}
    assert got[1] > 0.5 > got[2] and 0 <= got[101] <= 1 and got[100] > got[2]
    assert f"#{toxicity.xxhash.xxh3_128_hexdigest(long)}" in toxicity.features_of_word(long)


def test_languages_that_tie_go_to_the_first_name(spark):
    rows = [(i, "one and the same words again", lang) for i in range(40) for lang in ("bb", "aa", "cc")]
    model = language_id.train(docs(spark, [(k, t) for k, (_, t, _) in enumerate(rows)], [lang for *_, lang in rows]))
    assert model.predict("the same words") == ("aa", 1.0)


def test_license_scan_of_null_ids(spark):
    text = "x " + TEMPLATES["isc"] + " y"
    got = license_scan.scan(docs(spark, [(None, text), (None, text), (4, None)]), TEMPLATES, 0.75).filter("template = 'isc'").collect()
    assert [(g.doc_id, g.matched_words) for g in got] == [(None, len(license_scan.WORD.findall(TEMPLATES["isc"])))] * 2
