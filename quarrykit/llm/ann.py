"""Nearest neighbours by inner product over additive quantisation, then exact reranking.

The directions of vectors (their unit vectors, so neither lengths nor scale matter) are approximated by sums of one word
from each of ``books`` codebooks, whose words have the full dimension. The codebooks are fitted on at most ``fit_rows``
vectors (those with the smallest hash of their components, so the same at every run): first by clustering residuals,
then by least squares for all books together. Every vector is encoded by a beam search over the books, which keeps the
``beam`` best partial sums, and stored as its codes with two numbers: its norm, a multiple of the approximation, and
how far its direction is from that. A query makes one table of its inner products with all words; a vector's approximate
score is the sum of the entries of its codes, times its norm, and its score differs from that by at most the
query's length times the vector's length times its distance.

So nothing is missed, whatever the rows are like: in each block of vectors the ``rerank`` best of a query by approximate
score are scored exactly, in double precision on the original vectors; then every vector that by its bound may come
before the last of the ``top`` that these leave is scored exactly too. Quantisation decides how many are scored, not
which are found.

Equal vectors are one class, listed with their smallest ids, so groups of copies neither crowd the candidates nor
fill one task. Vectors and codes lie in blocks, which stay where they are; queries are sent past them. First past a
part of the blocks, from which each query gets a threshold, the last score among its best there; then past the other
blocks, of which only what reaches the threshold comes back, merged by query. With n vectors, of which q distinct ones
are queries, some q * n / ``BLOCK`` query rows are shuffled, and for each query at most ``top`` + 1 rows of a block in
the part, and about ``FIRST`` times ``top`` of all others.

Defined cases: vectors that are null, empty, zero, of another dimension than most vectors, or hold null or
non-finite components take no part, as queries neither; rows with a null id take no part; repeated rows of one id
and vector count once; fewer candidates than asked give fewer rows; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrykit.llm.common import cut, scratch

#: Vectors that lie together, at most on average, and their components.
BLOCK, COMPONENTS = 16_384, 1 << 22
#: One in so many blocks is asked first.
FIRST = 8


def clustered(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """k centres of x by Lloyd's rounds; empty ones are drawn anew."""
    centres = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        near = (x @ centres.T - 0.5 * (centres**2).sum(1)).argmax(1)
        n = np.bincount(near, minlength=k)
        member = np.zeros((len(x), k), np.float32)
        member[np.arange(len(x)), near] = 1
        sums = member.T @ x
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], x[rng.choice(len(x), k)])
    return centres


class Codebooks:
    """words: (books, size, dimension)."""

    def __init__(self, words: np.ndarray):
        self.words = words.astype(np.float32)
        flat = self.words.reshape(-1, words.shape[2])
        self.products = (flat @ flat.T).reshape(len(words), words.shape[1], len(words), words.shape[1])

    def __reduce__(self):
        return Codebooks, (self.words,)  # the products are made again where they are needed

    @classmethod
    def fit(cls, x: np.ndarray, books: int, size: int, beam: int, seed: int = 5) -> Codebooks:
        rng = np.random.default_rng(seed)
        size = max(1, min(size, len(x)))
        rest, words = x.astype(np.float32).copy(), []
        for _ in range(books):
            words.append(clustered(rest, size, 12, rng))
            rest -= words[-1][(rest @ words[-1].T - 0.5 * (words[-1] ** 2).sum(1)).argmax(1)]
        made = cls(np.stack(words))
        for _ in range(2):  # all books together, given the codes; then new codes
            codes, near = made.encode(x, beam), made.words
            del made  # the driver holds one large matrix at a time, and its copy in the solver
            gram = np.zeros((books * size, books * size), np.float32)
            gram.flat[:: books * size + 1] = 0.05
            right = 0.05 * near.reshape(books * size, -1)
            for b in range(books):
                own = slice(b * size, (b + 1) * size)
                np.add.at(right[own], codes[:, b], x.astype(np.float32))
                for c in range(books):
                    gram[own, c * size : (c + 1) * size] += np.bincount(codes[:, b] * size + codes[:, c], minlength=size * size).reshape(size, size)
            words = np.linalg.solve(gram, right).reshape(books, size, -1)
            del gram, right
            made = cls(words)
        return made

    def encode(self, x: np.ndarray, beam: int) -> np.ndarray:
        """Codes of each row: of all partial sums book by book, the ``beam`` nearest go on."""
        books, size, _ = self.words.shape
        out = np.empty((len(x), books), np.int64)
        norms = (self.words**2).sum(2)
        for at in range(0, len(x), 256):
            part = x[at : at + 256].astype(np.float32)
            n = len(part)
            dots = np.einsum("nd,bsd->nbs", part, self.words, optimize=True)
            codes, errors = np.zeros((n, 1, 0), np.int64), np.zeros((n, 1), np.float32)
            for b in range(books):
                grown = errors[:, :, None] + (norms[b] - 2 * dots[:, b])[:, None, :]
                for k in range(b):
                    grown = grown + 2 * self.products[k, codes[:, :, k], b]
                flat = grown.reshape(n, -1)
                keep = min(beam, flat.shape[1])
                best = np.argpartition(flat, keep - 1, 1)[:, :keep]
                codes = np.concatenate([np.take_along_axis(codes, (best // size)[:, :, None], 1), (best % size)[:, :, None]], 2)
                errors = np.take_along_axis(flat, best, 1)
            out[at : at + 256] = codes[np.arange(n), errors.argmin(1)]
        return out

    def sums(self, codes: np.ndarray) -> np.ndarray:
        out = np.zeros((len(codes), self.words.shape[2]), np.float32)
        for b in range(self.words.shape[0]):
            out += self.words[b, codes[:, b]]
        return out

    def norms(self, codes: np.ndarray) -> np.ndarray:
        return (self.sums(codes) ** 2).sum(1)

    def fitted(self, x: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The multiple of each approximation that is nearest to its row of x, and how far that is from it."""
        near = self.sums(codes).astype(np.float64)
        norm = (x * near).sum(1) / np.maximum((near**2).sum(1), 1e-30)
        return norm, np.sqrt(((x - norm[:, None] * near) ** 2).sum(1))


def clean(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v) of the vectors that take part, v as doubles."""
    x = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).filter("id is not null and size(v) > 0")
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < math.inf))
    x = x.filter(finite & F.exists("v", lambda c: c != 0)).withColumn("n", F.size("v"))
    dimension = x.groupBy("n").count().orderBy(F.desc("count"), "n").limit(1).collect()
    return x.filter(F.col("n") == dimension[0]["n"]).drop("n") if dimension else x.drop("n")


def rows_of(column) -> np.ndarray:
    """An Arrow column of lists of one length as a matrix of doubles."""
    return np.array(column.flatten(), np.float64).reshape(len(column), -1)


def lengths(x: np.ndarray) -> np.ndarray:
    """Lengths of the rows, none of which is zero; squares neither overflow nor vanish."""
    most = np.abs(x).max(1)
    return most * np.sqrt(((x / most[:, None]) ** 2).sum(1))


def directions(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1)[:, None]
    return x / np.sqrt((x**2).sum(1))[:, None]


class Codes:
    """The classes of a block; a query's scores come from its table of products with all words, and exactly where needed."""

    def __init__(self, books: Codebooks, batches: list, kind):
        rows = pa.Table.from_batches(batches)
        self.books, self.ids = books, rows["class"].to_numpy()
        self.norms, self.far, self.x = rows["norm"].to_numpy(), rows["far"].to_numpy(), rows_of(rows["v"].combine_chunks())
        self.lengths = lengths(self.x)
        code = np.frombuffer(b"".join(rows["codes"].to_pylist()), kind).reshape(len(self.ids), -1).astype(np.int64)
        self.flat = np.ascontiguousarray((code + books.words.shape[1] * np.arange(books.words.shape[0])).T)

    def near(self, queries: np.ndarray) -> np.ndarray:
        """Inner products of unit queries with all approximations, in single precision."""
        tables = queries.astype(np.float32) @ self.books.words.reshape(-1, self.books.words.shape[2]).T
        out = np.zeros((len(queries), len(self.ids)), np.float32)
        for row in self.flat:
            out += tables[:, row]
        return out

    def exactly(self, queries: np.ndarray, who: np.ndarray, which: np.ndarray) -> np.ndarray:
        """Scores of pairs of a query and a class."""
        out, step = np.empty(len(who)), max(1, (1 << 20) // self.x.shape[1])
        for at in range(0, len(who), step):
            out[at : at + step] = np.einsum("ij,ij->i", queries[who[at : at + step]], self.x[which[at : at + step]])
        return out

    def best(self, queries: np.ndarray, least: np.ndarray, most: int, rerank: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ``most`` best of each query among those that score ``least``, ties to smaller ids: (query, class, score)."""
        units = directions(queries)
        near = self.near(units).astype(np.float64)
        guess = near * self.norms
        # what single precision may lose: a sum of products for each word, and of one word for each book
        loss = 1e-5 * np.sqrt((self.books.words**2).sum(2)).max(1).sum()
        bound = guess + self.lengths * self.far + np.abs(self.norms) * loss + 1e-9 * self.lengths
        tried = min(max(rerank, most), len(self.ids))
        first = np.argpartition(-guess, tried - 1, 1)[:, :tried]
        score = self.exactly(queries, np.repeat(np.arange(len(queries)), tried), first.ravel()).reshape(len(queries), tried)
        if tried >= most:
            least = np.maximum(least, -np.partition(-score, most - 1, 1)[:, most - 1])
        bar = least * (1 - 1e-9 * np.sign(least)) / lengths(queries)  # a little lower, as it is divided
        who, which = np.nonzero(bound >= bar[:, None])
        score = self.exactly(queries, who, which)
        over = score >= least[who]
        who, which, score = who[over], which[over], score[over]
        order = np.lexsort((self.ids[which], -score, who))
        who, which, score = who[order], which[order], score[order]
        place = np.arange(len(who)) - np.searchsorted(who, who)
        return who[place < most], self.ids[which[place < most]], score[place < most]


def search(vectors: DataFrame, every: int = 20, top: int = 20, rerank: int | None = None, books: int = 32, size: int = 128, beam: int = 4, fit_rows: int = 8192, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows whose id is divisible by ``every``; ``rerank`` of a block, twice
    ``top`` if not given, set its query's bar there."""
    spark = vectors.sparkSession
    x = clean(vectors, id_col, vector_col)
    # classes of equal vectors with their smallest ids: Spark limits each class before it shuffles it
    ids = Window.partitionBy("key", "v").orderBy("id")
    x = x.withColumn("key", F.xxhash64("v"))
    at = scratch(spark, "vectors")
    few = x.withColumn("k", F.dense_rank().over(ids)).filter(F.col("k") <= top + 1)
    few.groupBy("key", "v").agg(F.min("id").alias("class"), F.sort_array(F.collect_set("id")).alias("members")).write.parquet(at)
    classes = spark.read.parquet(at)
    sample = classes.select(F.xxhash64("v", F.lit(1)).alias("h"), "class", "v").orderBy("h", "class").limit(fit_rows).select("v").toArrow()
    empty = "query_id long, rank int, vec_id long, score double"
    if not len(sample):
        return spark.createDataFrame([], empty)
    shared = spark.sparkContext.broadcast(Codebooks.fit(directions(rows_of(sample["v"].combine_chunks())), books, size, beam))  # books * size words at most
    kind = np.uint8 if size <= 256 else np.uint16

    def encoded(batches):
        own = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 2_048):
                part = batch.slice(at, 2_048)
                v = rows_of(part["v"])
                unit = directions(v)
                codes = own.encode(unit, beam)
                norm, far = own.fitted(unit, codes)
                yield pa.RecordBatch.from_arrays([part["class"], part["v"], pa.array([c.tobytes() for c in codes.astype(kind)], pa.binary()), pa.array(norm * lengths(v)), pa.array(far)], names=["class", "v", "codes", "norm", "far"])

    n = classes.count()
    room = max(1, min(max(n // (4 * spark.sparkContext.defaultParallelism), 512), BLOCK, COMPONENTS // len(sample["v"][0])))
    blocks = max(1, math.ceil(n / room))
    at = scratch(spark, "codes")
    spread = classes.select("class", "v").repartition(4 * spark.sparkContext.defaultParallelism)
    spread.mapInArrow(encoded, "class long, v array<double>, codes binary, norm double, far double").write.parquet(at)
    coded = spark.read.parquet(at)
    # distinct query vectors, each with the queries that have it
    asked = x.filter(F.col("id") % every == 0).select("id", "key", "v")
    of = cut(asked.join(classes.select("key", "v", "class"), ["key", "v"]).groupBy("id").agg(F.min("class").alias("class")))
    distinct = cut(of.select("class").distinct().join(classes.select("class", "v"), "class"))
    most = top + 1  # a query leaves itself out
    rerank = rerank or 2 * top

    def passed(batches):
        """Batches of queries past the vectors of their block."""
        held, block, codes = [], None, None
        for batch in batches:
            code = batch["block"].to_numpy() * 2 + batch["kind"].to_numpy()
            for rows in np.split(np.arange(len(code)), np.flatnonzero(np.diff(code)) + 1):
                if not len(rows):
                    continue
                part, (own, is_query) = batch.slice(rows[0], len(rows)), divmod(int(code[rows[0]]), 2)
                if own != block:
                    held, block, codes = [], own, None
                if not is_query:
                    held.append(part)
                    continue
                if held:
                    codes, held = Codes(shared.value, held, kind), []
                for at in range(0, part.num_rows if codes else 0, 64):
                    piece = part.slice(at, 64)
                    who, c, score = codes.best(rows_of(piece["v"]), piece["t"].to_numpy(), most, rerank)
                    yield pa.RecordBatch.from_arrays([pa.array(piece["class"].to_numpy()[who]), pa.array(c), pa.array(score)], names=["query", "c", "score"])

    def sent(queries, begin, end):
        """Queries (class, v, t) past the blocks from ``begin`` to before ``end``."""
        lying = coded.select(F.pmod(F.xxhash64("class"), F.lit(blocks)).cast("int").alias("block"), F.lit(0).alias("kind"), "class", "v", "codes", "norm", "far", F.lit(None).cast("double").alias("t"))
        lying = lying.filter((F.col("block") >= begin) & (F.col("block") < end))
        nothing = F.lit(None).cast("double")
        asking = queries.select(F.explode(F.sequence(F.lit(begin), F.lit(end - 1))).alias("block"), F.lit(1).alias("kind"), "class", "v", F.lit(None).cast("binary").alias("codes"), nothing.alias("norm"), nothing.alias("far"), "t")
        return lying.unionByName(asking).repartition(end - begin, "block").sortWithinPartitions("block", "kind").mapInArrow(passed, "query long, c long, score double")

    lowest, part = F.lit(-math.inf), math.ceil(blocks / FIRST)
    found = cut(sent(distinct.select("class", "v", lowest.alias("t")), 0, part))
    if part < blocks:
        # at most ``most`` numbers of each block of the part
        t = found.groupBy("query").agg(F.get(F.sort_array(F.collect_list("score"), False), F.lit(most - 1)).alias("t"))
        queries = distinct.join(t, F.col("class") == F.col("query"), "left").select("class", "v", F.coalesce("t", lowest).alias("t"))
        found = found.unionByName(sent(queries, part, blocks))
    first = Window.partitionBy("query").orderBy(F.desc("score"), "c")
    chosen = found.withColumn("k", F.row_number().over(first)).filter(F.col("k") <= top + 1)
    scored = chosen.join(classes.select(F.col("class").alias("c"), "members"), "c")
    # classes become their members; one more than asked, as a query leaves itself out
    close = scored.select("query", "score", F.explode("members").alias("vec_id"))
    place = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    close = cut(close.withColumn("k", F.row_number().over(place)).filter(F.col("k") <= top + 1).drop("k"))
    lists = close.groupBy("query").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))).alias("list"))
    answers = of.join(lists, F.col("class") == F.col("query")).select("id", F.slice(F.filter("list", lambda z: z["vec_id"] != F.col("id")), 1, top).alias("list"))
    return answers.select(F.col("id").alias("query_id"), F.posexplode("list").alias("pos", "one")).select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), "one.vec_id", (-F.col("one.s")).alias("score"))
