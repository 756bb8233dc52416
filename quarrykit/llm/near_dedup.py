"""Near-duplicate documents by fast similarity sketching, banding and exact verification.

A document is the set of its distinct five-word shingles, as 64-bit hashes. Its sketch has 128 coordinates, made in
rounds: in each of the first 128 rounds every element is thrown into one hashed bin with a hashed value, and the
smallest value fills a bin that earlier rounds left empty; a usual document is done after one or two rounds. Round
128 + i puts all elements into bin i, so every coordinate fills whatever the set's size. Coordinates of two sets
agree with a chance equal to their similarity, with the concentration of independent ones; 16 bits of each are kept.

Equal sets form one class, and only classes are compared. 32 bands of four coordinates put classes into buckets. A
bucket is never expanded into all pairs. It has one centre: of its members the one that meets most others in all of
its buckets, which in a group of edited copies is the text nearest to what they were made from. Then

1. every class is compared with the centres of its buckets, which links most of each group into one component;
2. in a bucket of at most 8 classes, the pairs that are still in different components are compared;
3. in a larger one, classes are held against each other by what sets them apart from the centre (``differences``),
   and only pairs that this exact bound does not rule out are compared.

To compare is to leave pairs whose sizes rule them out or whose sketches agree in fewer than half of the coordinates,
and to confirm all others on the full sets, made once from the texts of the classes that share a bucket. A pair at
similarity 0.75 is lost by banding with chance 5e-6, by the sketches with chance 3e-10 (Binomial(128, 0.75) below 64),
never by the other bounds.

Defined cases: a null text, or one without words, has the empty set and is linked with nothing; a text of fewer
than five words has one shingle; very long texts count whole, a task holds few of them at a time; rows with one
doc_id count as one document, so whatever is linked with one of them is linked with all; a row with a null doc_id
takes part through its text, gets the smallest non-null id of its group (or null), and is not marked kept; columns
other than doc_id and text are ignored; an empty table gives an empty result. ``deduplicate`` decides by row instead.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrykit.llm.common import cut, scratch, slices, small_batches, splitmix, tidy

WORDS = 5
COORDINATES, BANDS = 128, 32
TOGETHER = 256  # sets that are sketched together: a set's place takes 8 bits, a bin 7, a value the other 49
LIKELY = 0.5
SMALL = 8
COUNTERS = 1 << 18
KNOWN_WORDS = 150_000


class WordHashes(dict):
    """64-bit hashes of words, kept for the words met so far."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > KNOWN_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def chain_hashes(w: np.ndarray, size: int) -> np.ndarray:
    """A hash for each ``size`` words in a row."""
    h = np.full(len(w) - size + 1, size, np.uint64)
    for k in range(size):
        h = splitmix(h) + w[k : k + len(h)]
    return splitmix(h)


def shingles(texts: list[str | None], hashes: WordHashes) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's shingles."""
    words = [(t or "").encode("utf-8", "surrogatepass").lower().split() for t in texts]  # on bytes, both know ASCII only
    ends = np.cumsum([len(x) for x in words]).tolist()
    w = np.fromiter(map(hashes.__getitem__, chain.from_iterable(words)), np.uint64, ends[-1] if ends else 0)
    whole = chain_hashes(w, WORDS) if len(w) >= WORDS else w
    out = []
    for x, end in zip(words, ends):
        at = end - len(x)
        if len(x) >= WORDS:
            out.append(np.unique(whole[at : end - WORDS + 1]))
        else:
            out.append(chain_hashes(w[at:end], len(x)) if x else np.zeros(0, np.uint64))
    return out


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """The 128 coordinates of each of at most 256 non-empty sets, 16 bits each."""
    sizes = np.array([len(s) for s in sets])
    elements = np.concatenate(sets)
    place = np.repeat(np.arange(len(sets), dtype=np.uint64), sizes)
    out, empty = np.zeros(len(sets) * COORDINATES, np.uint64), np.ones(len(sets) * COORDINATES, bool)
    for i in range(2 * COORDINATES):
        tag = splitmix(np.array([i], np.uint64))
        h = splitmix(elements ^ tag)
        if i < COORDINATES:
            z = (place << np.uint64(56)) | (h >> np.uint64(8))
            z.sort()
            group = z >> np.uint64(49)
            first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
            bins, values = group[first].astype(np.int64), z[first] & np.uint64((1 << 49) - 1)
        else:
            first = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
            bins, values = place[first].astype(np.int64) * COORDINATES + (i - COORDINATES), np.minimum.reduceat(h, first)
        new = empty[bins]
        out[bins[new]] = splitmix(values[new] ^ tag)
        empty[bins] = False
        open_ = empty.reshape(len(sets), -1).any(1)
        if not open_.any():
            break
        if not (stay := open_[place]).all():
            elements, place = elements[stay], place[stay]
    return (out & np.uint64(0xFFFF)).astype("<u2").reshape(len(sets), COORDINATES)


def band_keys(coordinates: np.ndarray) -> np.ndarray:
    """A hash for each band of each row of ``sketches``, different bands apart."""
    packed = np.ascontiguousarray(coordinates).view("<u8")
    return splitmix(packed ^ splitmix(np.arange(BANDS, dtype=np.uint64))).view(np.int64)


def name_of(own: np.ndarray) -> int:
    """The node of a set: a hash of all of it."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(own.tobytes())).view(np.int64))


def sketch_documents(docs: DataFrame) -> DataFrame:
    """(row, doc_id, n_shingles, node, signature): node is a hash of the whole set, null for the empty one."""

    def run(batches):
        hashes = WordHashes()
        for batch in slices(batches, TOGETHER):
            sets = shingles(batch["text"].to_pylist(), hashes)
            full = [s for s in sets if len(s)]
            signature = iter(sketches(full) if full else ())
            nodes = [name_of(s) if len(s) else None for s in sets]
            signatures = [next(signature).tobytes() if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch["row"], batch["doc_id"], pa.array([len(s) for s in sets], pa.int64()), pa.array(nodes, pa.int64()), pa.array(signatures, pa.binary())],
                names=["row", "doc_id", "n_shingles", "node", "signature"],
            )

    return small_batches(docs.select(row_of(docs), "doc_id", "text")).mapInArrow(tidy(run), "row long, doc_id long, n_shingles long, node long, signature binary")


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node in ``edges`` (a, b): label is the smallest node that can be reached.

    Rounds of taking the smallest label among neighbours, then the label's own label; every round is cut.
    """
    both = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("label")))
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        stepped = labels.join(near, labels["node"] == near["a"]).select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        of = labels.select(F.col("node").alias("of"), F.col("label").alias("jump"))
        jumped = stepped.join(of, stepped["label"] == of["of"], "left").select("node", "was", F.least("label", "jump").alias("label"))
        now = cut(jumped)
        changed = now.filter("label != was").limit(1).count()
        labels = now.select("node", "label")
        if not changed:
            return labels


def joined(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """``labels`` (node, label) after more ``edges``: only the components that these touch are labelled anew."""
    name = labels.select(F.col("node").alias("_n"), F.col("label").alias("_l"))
    ends = edges.join(name, F.col("a") == F.col("_n"), "left").select(F.coalesce("_l", "a").alias("a"), "b")
    ends = cut(ends.join(name, F.col("b") == F.col("_n"), "left").select("a", F.coalesce("_l", "b").alias("b")).filter("a != b").distinct())
    if not ends.limit(1).count():
        return labels
    new = components(ends).select(F.col("node").alias("_n"), F.col("label").alias("_new"))
    moved = labels.join(new, F.col("label") == F.col("_n"), "left").select("node", F.coalesce("_new", "label").alias("label"))
    alone = new.join(labels, new["_n"] == labels["node"], "left_anti").select(F.col("_n").alias("node"), F.col("_new").alias("label"))
    return cut(moved.unionByName(alone))


def row_of(docs: DataFrame) -> Column:
    """A name for a row whatever its doc_id is: a hash of id and text."""
    return F.xxhash64(F.lit(7), docs["doc_id"], docs["text"]).alias("row")


def ordered(a, b) -> list:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def full_sets(docs: DataFrame, held: DataFrame) -> DataFrame:
    """(node, elements) of the classes ``held`` (node, row): each one's text is read once more."""

    def run(batches):
        hashes = WordHashes()
        for batch in slices(batches):
            sets = shingles(batch["text"].to_pylist(), hashes)
            right = [k for k, (s, node) in enumerate(zip(sets, batch["node"].to_pylist())) if name_of(s) == node]  # else a row of the same name
            yield pa.RecordBatch.from_arrays([batch["node"].take(pa.array(right, pa.int64())), pa.array([sets[k].tobytes() for k in right], pa.binary())], names=["node", "elements"])

    at = scratch(docs.sparkSession, "sets")
    texts = docs.select(row_of(docs), "text").join(held.select("node", "row"), "row").select("node", "text")
    small_batches(texts).mapInArrow(tidy(run), "node long, elements binary").dropDuplicates(["node"]).write.parquet(at)
    return docs.sparkSession.read.parquet(at)


class Comparison:
    """The classes that share a bucket, ``held`` (node, row, n_shingles, signature), and their ``sets``."""

    def __init__(self, held: DataFrame, sets: DataFrame, percent: int):
        self.held, self.sets, self.percent = held, sets, percent

    def likely(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) whose sizes and sketches do not rule them out."""
        x = self.held.select(F.col("node").alias("a"), F.col("signature").alias("x"), F.col("n_shingles").alias("nx"))
        y = self.held.select(F.col("node").alias("b"), F.col("signature").alias("y"), F.col("n_shingles").alias("ny"))

        def run(batches):
            for batch in batches:
                u, v = (np.frombuffer(b"".join(batch[c].to_pylist()), "<u2").reshape(-1, COORDINATES) for c in "xy")
                alike = (u == v).mean(1) >= LIKELY if len(u) else np.zeros(0, bool)
                yield batch.select(["a", "b"]).filter(pa.array(alike, pa.bool_()))

        sized = 100 * F.least("nx", "ny") >= self.percent * F.greatest("nx", "ny")
        return pairs.join(x, "a").join(y, "b").filter(sized).select("a", "b", "x", "y").mapInArrow(tidy(run), "a long, b long")

    def with_sets(self, pairs: DataFrame) -> DataFrame:
        x = self.sets.select(F.col("node").alias("a"), F.col("elements").alias("x"))
        y = self.sets.select(F.col("node").alias("b"), F.col("elements").alias("y"))
        return pairs.join(x, "a").join(y, "b")

    def links(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that are links, by the full sets of both."""
        percent = self.percent

        def run(batches):
            for batch in slices(batches):
                linked = []
                for x, y in zip(batch["x"], batch["y"]):
                    x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    linked.append(100 * both >= percent * (len(x) + len(y) - both))
                yield batch.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))

        return cut(self.with_sets(self.likely(pairs)).select("a", "b", "x", "y").mapInArrow(tidy(run), "a long, b long"))

    def differences(self, stars: DataFrame) -> DataFrame:
        """The elements at which two classes in different components can first meet by what sets them apart from a centre.

        ``stars``: (a, b, label): b is the centre of a bucket of a, label is a's component. Let p be the percentage, c
        the centre's size, D the elements that are in just one of the sets of a and of its centre, M and P its two
        parts, those that a lacks and those that it has beside the centre, and w = 100 |M| + p |P|. Counting shows that
        a is linked with its centre if, and only if, w <= (100 - p) c, and two classes of one centre with each other
        if, and only if, their D have (w + w' - (100 - p) c) / (100 + p) elements in common. Of two classes in
        different components one at least, called weak, is not linked with the centre. So for a link between them

        - the other needs more than w / (100 + p) elements in common with the weak one, whatever that is;
        - the weak one needs (w - (100 - p) c) / 100, as the other's w' is p times the common part or more.

        Elements that only one class of the centre has are in no common part. The others are put in one order, which
        may be any; the rare ones go first, by counts in ``COUNTERS`` hashed places. The first common element stands
        so early in both orders that enough are left behind it.
        """
        p = self.percent

        def compare(batches):
            for batch in slices(batches):
                out = {"a": [], "b": [], "label": [], "n": [], "lacks": [], "has": []}
                for a, b, label, x, y in zip(*(batch[c] for c in ("a", "b", "label", "x", "y"))):
                    x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                    out["a"].append(a.as_py()), out["b"].append(b.as_py()), out["label"].append(label.as_py()), out["n"].append(len(y))
                    out["lacks"].append(np.setdiff1d(y, x, assume_unique=True).tobytes())
                    out["has"].append(np.setdiff1d(x, y, assume_unique=True).tobytes())
                yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("a", pa.int64()), ("b", pa.int64()), ("label", pa.int64()), ("n", pa.int64()), ("lacks", pa.binary()), ("has", pa.binary())]))

        def parts(batch):
            """Each row's elements in order, those that it lacks marked by the lowest bit, and how many it lacks."""
            for lacks, has in zip(batch["lacks"], batch["has"]):
                lacks, has = np.frombuffer(lacks.as_buffer(), np.uint64), np.frombuffer(has.as_buffer(), np.uint64)
                yield np.concatenate([has & ~np.uint64(1), lacks | np.uint64(1)]).view(np.int64), len(lacks)

        def spread(batches):
            for batch in slices(batches):
                each = [x for x, _ in parts(batch)]
                sizes = [len(x) for x in each]
                elements = np.concatenate([*each, np.zeros(0, np.int64)])
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch[c].to_numpy(), sizes), pa.int64()) for c in ("b", "a")] + [pa.array(elements, pa.int64())], names=["b", "a", "element"])

        def early(batches):
            often = counts.value
            for batch in slices(batches):
                rows = {"b": [], "n": [], "element": [], "a": [], "label": [], "w": [], "left": [], "weak": []}
                for (x, m), a, b, label, n, alone in zip(parts(batch), *(batch[c].to_pylist() for c in ("a", "b", "label", "n", "alone"))):
                    w = 100 * m + p * (len(x) - m)
                    if alone:
                        x = x[~np.isin(x, alone)]
                    x = x[np.lexsort((x, often[place_of(b, x)]))]
                    over = w - (100 - p) * n
                    for weak, least in ((False, w // (100 + p) + 1), (True, max(1, -(-over // 100)))):
                        if (k := len(x) - least + 1) > 0 and (over > 0 or not weak):
                            for name, v in zip(rows, (b, n, None, a, label, w, None, weak)):
                                rows[name] += x[:k].tolist() if name == "element" else range(len(x), len(x) - k, -1) if name == "left" else [v] * k
                yield pa.RecordBatch.from_pydict(rows, schema=pa.schema([(c, pa.bool_() if c == "weak" else pa.int64()) for c in rows]))

        def place_of(b, x):
            return (splitmix(x.view(np.uint64) ^ splitmix(np.atleast_1d(np.asarray(b, np.int64)).view(np.uint64))) & np.uint64(COUNTERS - 1)).astype(np.int64)

        def places(batches):
            for batch in batches:
                yield pa.RecordBatch.from_arrays([pa.array(place_of(batch["b"].to_numpy(), batch["element"].to_numpy()))], names=["place"])

        at = scratch(stars.sparkSession, "differences")
        self.with_sets(stars).select("a", "b", "label", "x", "y").mapInArrow(tidy(compare), "a long, b long, label long, n long, lacks binary, has binary").write.parquet(at)
        apart = stars.sparkSession.read.parquet(at)
        elements = apart.select("a", "b", "lacks", "has").mapInArrow(tidy(spread), "b long, a long, element long")
        only = elements.groupBy("b", "element").agg(F.count("*").alias("n"), F.min("a").alias("a")).filter("n = 1")
        alone = only.groupBy("b", "a").agg(F.collect_list("element").alias("alone"))
        # at most COUNTERS rows, however many elements there are
        held = elements.mapInArrow(tidy(places), "place long").groupBy("place").agg(F.count("*").alias("n")).toArrow()
        table = np.zeros(COUNTERS, np.int64)
        table[held["place"].to_numpy()] = held["n"].to_numpy()
        counts = stars.sparkSession.sparkContext.broadcast(table)
        kind = "b long, n long, element long, a long, label long, w long, left long, weak boolean"
        at = scratch(stars.sparkSession, "early")
        apart.join(alone, ["b", "a"], "left").mapInArrow(tidy(early), kind).write.parquet(at)
        return stars.sparkSession.read.parquet(at)

    def meetings(self, rows: DataFrame) -> DataFrame:
        """Pairs (a, b) of classes in different components that ``differences`` does not rule out."""
        p = self.percent
        weak, other = (rows.filter(F.col("weak") == F.lit(k)).select("b", "n", "element", *(F.col(c).alias(f"{c}{k:d}") for c in ("a", "label", "w", "left"))) for k in (True, False))
        # first by component, so that a large one is one row for each element
        sides = [s.groupBy("b", "element", f"label{k}").agg(F.min(f"w{k}").alias(f"w{k}"), F.max(f"left{k}").alias(f"left{k}"), F.min("n").alias("n")) for k, s in ((1, weak), (0, other))]
        enough = (100 + p) * F.least("left1", "left0") >= F.col("w1") + F.col("w0") - (100 - p) * F.col("n")
        meets = sides[0].join(sides[1].drop("n"), ["b", "element"]).filter((F.col("label1") != F.col("label0")) & enough).select("b", "element", "label1", "label0", F.col("w0").alias("low"), F.col("left0").alias("high"))
        # a weak class goes on only where the other component's best could be enough for it
        hopeful = (100 + p) * F.least("left1", "high") >= F.col("w1") + F.col("low") - (100 - p) * F.col("n")
        both = cut(meets).join(weak, ["b", "element", "label1"]).filter(hopeful).join(other.drop("n"), ["b", "element", "label0"])
        return both.filter(enough).select(*ordered("a1", "a0")).distinct()


def link(docs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """(node, label) of all classes that have a link; label names the component."""

    def spread(batches):
        for batch in slices(batches, 4096):
            coordinates = np.frombuffer(b"".join(batch["signature"].to_pylist()), "<u2").reshape(-1, COORDINATES)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch["node"].to_numpy(), BANDS), pa.int64()), pa.array(band_keys(coordinates).ravel(), pa.int64())], names=["node", "band"])

    members = classes.select("node", "signature").mapInArrow(tidy(spread), "node long, band long")
    shared = members.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1")
    groups = cut(members.join(shared, "band"))
    meets = cut(groups.groupBy("node").agg(F.sum(F.col("n") - 1).alias("met")))
    centres = groups.join(meets, "node").groupBy("band").agg(F.max(F.struct("met", "node")).getField("node").alias("centre"))
    groups = cut(groups.join(centres, "band"))
    held = cut(classes.join(meets.select("node"), "node").select("node", "row", "n_shingles", "signature"))
    compare = Comparison(held, full_sets(docs, held), percent)

    stars = cut(groups.filter("node != centre").select("node", "centre").distinct())
    asked = cut(stars.select(*ordered("node", "centre")).distinct())
    labels = joined(classes.select("node", F.col("node").alias("label")).limit(0), compare.links(asked))

    name = labels.select(F.col("node").alias("_n"), F.col("label").alias("_l"))
    named = groups.join(name, F.col("node") == F.col("_n"), "left").select("band", "node", "n", "centre", F.coalesce("_l", "node").alias("label"))
    split = named.groupBy("band").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high").select("band")
    named = cut(named.join(split, "band"))
    small, large = named.filter(F.col("n") <= SMALL), named.filter(F.col("n") > SMALL)
    x, y = (small.select("band", F.col("node").alias(f"node{k}"), F.col("label").alias(f"label{k}")) for k in (1, 2))
    few = x.join(y, "band").filter((F.col("node1") < F.col("node2")) & (F.col("label1") != F.col("label2")))
    rows = compare.differences(cut(large.filter("node != centre").select(F.col("node").alias("a"), F.col("centre").alias("b"), "label").distinct()))
    pairs = few.select(*ordered("node1", "node2")).unionByName(compare.meetings(rows)).distinct()
    return joined(labels, compare.links(pairs.join(asked, ["a", "b"], "left_anti")))


def labelled(docs: DataFrame, percent: int, same_id: bool) -> tuple[DataFrame, DataFrame]:
    """The sketches of all rows of ``docs`` (doc_id, text), and (node, first_id, label) of their classes.

    With ``same_id`` the classes of one doc_id are linked too.
    """
    spark = docs.sparkSession
    at = scratch(spark, "sketches")
    sketch_documents(docs).write.parquet(at)
    rows = spark.read.parquet(at)
    at = scratch(spark, "classes")
    firsts = [F.min("doc_id").alias("first_id"), F.min("row").alias("row"), *(F.first(c).alias(c) for c in ("n_shingles", "signature"))]
    rows.filter("node is not null").groupBy("node").agg(*firsts).write.parquet(at)
    classes = spark.read.parquet(at)
    labels = link(docs, classes, percent)
    if same_id:
        several = rows.filter("node is not null and doc_id is not null").groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("high")).filter("a < high")
        labels = joined(labels, rows.join(several, "doc_id").select("a", F.col("node").alias("b")).filter("a != b").distinct())
    return rows, cut(classes.select("node", "first_id").join(labels, "node", "left").select("node", "first_id", F.coalesce("label", "node").alias("label")))


def plain(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def find(docs: DataFrame, percent: int = 75) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_shingles, component_id, kept."""
    rows, named = labelled(plain(docs), percent, same_id=True)
    least = named.groupBy("label").agg(F.min("first_id").alias("component_id"))
    of = named.join(least, "label").select("node", "component_id")
    rows = rows.select("doc_id", "n_shingles", "node")
    linked = rows.filter("node is not null").join(of, "node").select("doc_id", "n_shingles", "component_id")
    alone = rows.filter("node is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def deduplicate(docs: DataFrame, percent: int = 75) -> DataFrame:
    """One row of each component of ``docs``, and every row without words, with the same columns.

    Rows count by themselves, whatever their doc_id: the one with the smallest id stays (of equal ids, that with the
    smallest hash of the text), and one without an id only where no row of the component has one.
    """
    rows, named = labelled(plain(docs), percent, same_id=False)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")).alias("first")
    firsts = rows.filter("node is not null").groupBy("node").agg(first)
    stays = firsts.join(named, "node").groupBy("label").agg(F.min("first").alias("first")).select(F.col("first.row").alias("_stays"))
    whole = docs.withColumn("_near_row", F.xxhash64(F.lit(7), F.col("doc_id").cast("long"), F.col("text").cast("string")))
    # rows equal in id and text have one name
    kept = whole.join(stays, F.col("_near_row") == F.col("_stays"), "left_semi").dropDuplicates(["_near_row"]).drop("_near_row")
    wordless = docs.filter(~F.coalesce(F.col("text").cast("string").rlike(r"[^ \t\n\x0b\f\r]"), F.lit(False)))
    return kept.unionByName(wordless)
