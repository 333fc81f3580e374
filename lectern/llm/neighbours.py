"""Nearest neighbours by inner product: query-aware collision counting.

A vector of norm r is lifted to the unit sphere, with sqrt(1 - (r / M)^2) as a further component, M
being the largest norm of its band; the nearest by inner product is then the nearest by distance. An
index holds, for each of N_LINES random lines, the vectors' projections as one sorted array. A query
puts a window around its own projection on each line; virtual rehashing widens the windows with the
radius R, from the distance of the nearest of a sample on. Windows are counted by
whole strides of the arrays, whose members are kept as running sums, and by the entries at either
end. A vector that lies in the windows of THRESHOLD lines or more is verified: its exact inner
product is taken. The search ends when the TOP-th best verified vector is no farther than R, since
each vector within R reaches the threshold with probability 1 - MISS or more. At R = 2, the sphere's
diameter, all that is left is verified, so there is no bound on candidates.

Equal vectors are one class that is searched for, and found, once; of its identifiers the smallest
are enough for any answer. Classes are dealt to shards, query classes to blocks, and each pair of a
shard and a block is one group of bounded size: the stated queries meet all rows.

Defined results: rows without identifier take no part, for they cannot be named, nor vectors that are
null, zero, or hold null or what is not finite. Rows equal in identifier and vector are one row; other
rows of the query's identifier are candidates. Vectors meet those of their own length. Other columns
are not read.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import join_sized, materialize, prepare, release

#: Neighbours that an answer has; one more is looked for, as the query itself is among them.
TOP = 20
QUERY_STEP = 20
SHARD_ROWS, QUERY_BLOCK = 16_384, 2048
#: Lines, width of a window in radii, share of near vectors that a search may miss, growth of the radius.
N_LINES, WIDTH, MISS, GROWTH = 128, 2.0, 0.05, 1.1
#: The first radius is this multiple of the distance of the nearest of so many vectors, and not below the least radius.
FIRST, SAMPLE, LEAST_RADIUS = 1.0, 256, 0.05
#: Entries of an array that are counted at once.
STRIDE = 512
#: Vectors of one band have norms of at least this share of its largest.
BAND = 0.8
SEED = 11
_FOUND = pa.schema([("q0", pa.int64()), ("q1", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64()), ("own", pa.bool_())])


def threshold() -> int:
    """The largest count that a vector at distance R reaches with probability 1 - MISS, each line being hit with P(|N(0, 1)| <= WIDTH / 2)."""
    hit, below = math.erf(WIDTH / 2 / math.sqrt(2)), 0.0
    for count in range(N_LINES + 1):
        below += math.comb(N_LINES, count) * hit**count * (1 - hit) ** (N_LINES - count)
        if below > MISS:
            return count
    return N_LINES


@lru_cache(8)
def lines(dim: int) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((dim, N_LINES))


class Band:
    """Vectors of similar norm, and for each line their projections as a sorted array."""

    def __init__(self, vectors: np.ndarray, norms: np.ndarray, rows: np.ndarray) -> None:
        self.vectors, self.rows, self.largest = vectors, rows, float(norms.max())
        share = norms / self.largest
        lifted = np.column_stack([vectors / self.largest, np.sqrt(np.maximum(0, 1 - share * share))])
        projected = (lifted @ lines(lifted.shape[1])).T
        self.order = np.argsort(projected, axis=1, kind="stable")
        self.sorted = np.take_along_axis(projected, self.order, axis=1)
        rank = np.empty(self.order.shape, np.int32)
        np.put_along_axis(rank, self.order, np.arange(len(rows), dtype=np.int32)[None, :], axis=1)
        strides = np.arange(len(rows) // STRIDE + 1, dtype=np.int32) * STRIDE
        #: For each line and stride, which vectors stand before it.
        self.before = (rank[:, None, :] < strides[None, :, None]).astype(np.uint8)

    def windows(self, queries: np.ndarray, half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each query's window begins and ends in each array; ``queries`` are projections, a row for each line."""
        low = np.array([np.searchsorted(s, q - half, "left") for s, q in zip(self.sorted, queries, strict=True)])
        high = np.array([np.searchsorted(s, q + half, "right") for s, q in zip(self.sorted, queries, strict=True)])
        return low, high

    def collisions(self, counts: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        """Add to ``counts``, for each vector, the windows (``low``, ``high``: one for each line) that it lies in."""
        ends = []
        first, last = -(-low // STRIDE), high // STRIDE
        for order, before, a, b, x, y in zip(self.order, self.before, low.tolist(), high.tolist(), first.tolist(), last.tolist(), strict=True):
            if x < y:
                counts += before[y]  # counts wrap around, as there are at most 255 lines, and are right in the end
                counts -= before[x]
                ends += (order[a : x * STRIDE], order[y * STRIDE : b])
            else:
                ends.append(order[a:b])
        counts += np.bincount(np.concatenate(ends), minlength=len(counts)).astype(np.uint8)

    def widened(self, counts: np.ndarray, low: np.ndarray, high: np.ndarray, to_low: np.ndarray, to_high: np.ndarray) -> None:
        """Add what windows gain that grow from (``low``, ``high``) to (``to_low``, ``to_high``)."""
        new = [piece for o, a, b, x, y in zip(self.order, to_low.tolist(), low.tolist(), high.tolist(), to_high.tolist(), strict=True) for piece in (o[a:b], o[x:y])]
        counts += np.bincount(np.concatenate(new), minlength=len(counts)).astype(np.uint8)


class Answer:
    """The best rows that a query has met."""

    def __init__(self, query: np.ndarray) -> None:
        self.query, self.norm = query, float(np.sqrt(query @ query))
        self.rows, self.scores = np.zeros(0, np.int64), np.zeros(0)

    def worst(self) -> float:
        """The score that the TOP + 1 best reach, minus infinity while there are fewer."""
        return float(self.scores[-1]) if len(self.scores) > TOP else -math.inf

    def verify(self, band: Band, found: np.ndarray, firsts: np.ndarray) -> None:
        scores = np.take(band.vectors, found, axis=0) @ self.query
        least = max(self.worst(), np.partition(scores, -TOP - 1)[-TOP - 1] if len(scores) > TOP else -math.inf)
        kept = np.flatnonzero(scores >= least)
        scores = np.concatenate([self.scores, scores[kept]])
        rows = np.concatenate([self.rows, band.rows[found[kept]]])
        best = np.lexsort((firsts[rows], -scores))[: TOP + 1]
        self.rows, self.scores = rows[best], scores[best]


def search_band(band: Band, answers: list[Answer], firsts: np.ndarray) -> None:
    """Update ``answers`` by the vectors of ``band``. ``firsts`` are the rows' smallest identifiers."""
    n, least, limit = len(band.rows), threshold(), band.largest
    active = [k for k, a in enumerate(answers) if a.worst() <= a.norm * limit]
    if not active:
        return
    unit = np.array([np.append(answers[k].query / answers[k].norm, 0.0) for k in active])
    projected = np.ascontiguousarray((unit @ lines(unit.shape[1])).T)
    sample = band.vectors[:: max(1, n // SAMPLE)] / limit
    highest = (unit[:, :-1] @ sample.T).max(axis=1)
    radius = np.maximum(LEAST_RADIUS, FIRST * np.sqrt(np.maximum(0, 2 - 2 * highest)))
    counts, seen, going = np.zeros((len(active), n), np.uint8), np.zeros((len(active), n), bool), np.arange(len(active))
    low = high = None
    while len(going):
        to_low, to_high = band.windows(projected[:, going], WIDTH * radius[going] / 2)
        left, places = [], []
        for c, k in enumerate(going.tolist()):
            answer = answers[active[k]]
            whole = radius[k] >= 2
            if not whole and low is None:
                band.collisions(counts[k], to_low[:, c], to_high[:, c])
            elif not whole:
                band.widened(counts[k], low[:, c], high[:, c], to_low[:, c], to_high[:, c])
            found = np.flatnonzero(~seen[k] if whole else (counts[k] >= least) & ~seen[k])
            if len(found):
                seen[k, found] = True
                answer.verify(band, found, firsts)
            # the nearest TOP + 1 are within the radius when the worst of them is
            if not whole and not answer.worst() >= (1 - radius[k] * radius[k] / 2) * answer.norm * limit:
                left.append(k)
                places.append(c)
        going, low, high = np.array(left, np.int64), to_low[:, places], to_high[:, places]
        radius[going] = np.minimum(2.0, radius[going] * GROWTH)


def nearest(vectors: np.ndarray, firsts: np.ndarray, queries: np.ndarray) -> list[Answer]:
    """The TOP + 1 best rows of ``vectors`` for each of ``queries``; bands of large norms come first."""
    answers = [Answer(q) for q in queries]
    if len(vectors):
        norms = np.sqrt((vectors * vectors).sum(axis=1))
        order = np.argsort(-norms, kind="stable")
        sorted_norms, a = norms[order], 0
        while a < len(order):
            b = int(np.searchsorted(-sorted_norms, -BAND * sorted_norms[a], "right"))
            rows = order[a:b]
            search_band(Band(vectors[rows], norms[rows], rows), answers, firsts)
            a = b
    return answers


def in_sequence(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products summed from the first component to the last, so that they are the same on any machine."""
    out = np.zeros(len(vectors))
    for k, x in enumerate(query):
        out += vectors[:, k] * x
    return out


def matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    return np.asarray(column.combine_chunks().flatten(), dtype=np.float64).reshape(-1, dim)


def _cell(rows: pa.Table, asked: pa.Table) -> pa.Table:
    """The best identifiers of a shard for each query of a block."""
    release()
    if not rows.num_rows or not asked.num_rows:
        return _FOUND.empty_table()
    dim = rows.column("dim")[0].as_py()
    vectors, queries = matrix(rows.column("vector"), dim), matrix(asked.column("vector"), dim)
    ids = rows.column("ids").to_pylist()
    keys, wanted = (list(zip(t.column("k0").to_pylist(), t.column("k1").to_pylist(), strict=True)) for t in (rows, asked))
    out = []
    for key, answer in zip(wanted, nearest(vectors, np.array([x[0] for x in ids]), queries), strict=True):
        scores = in_sequence(vectors[answer.rows], answer.query).tolist()
        found = sorted((-s, i, keys[r] == key) for s, r in zip(scores, answer.rows.tolist(), strict=True) for i in ids[r])
        out += [(*key, i, -s, own) for s, i, own in found[: TOP + 1]]
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [()] * 5, _FOUND.types, strict=True)], schema=_FOUND)


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, vector, dim, k0, k1: the rows that take part, equal ones once; (k0, k1) is a hash of the vector."""
    zero = F.lit(0.0).cast(vectors.schema[vector_col].dataType.elementType)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector")).filter("vec_id is not null")
    finite = F.forall("vector", lambda x: x.isNotNull() & (F.abs(x) < F.lit(math.inf)) & ~F.isnan(x))
    rows = rows.filter(finite & F.exists("vector", lambda x: x != zero)).withColumn("vector", F.transform("vector", lambda x: x + zero))
    keys = F.xxhash64("vector").alias("k0"), F.xxhash64(F.lit("second"), "vector").alias("k1")
    return rows.select("vec_id", "vector", F.size("vector").alias("dim"), *keys).dropDuplicates(["vec_id", "k0", "k1"])


def search(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the TOP nearest rows found for each row whose identifier is divisible by QUERY_STEP."""
    spark = vectors.sparkSession
    prepare(spark)
    rows = materialize(usable(vectors, id_col, vector_col), "vectors")
    asks = F.col("vec_id") % QUERY_STEP == 0
    place = F.row_number().over(Window.partitionBy("k0", "k1").orderBy("vec_id"))
    members = rows.select("*", place.alias("place")).filter(F.col("place") <= TOP + 1)
    classes = members.groupBy("k0", "k1", "dim").agg(F.first("vector").alias("vector"), F.array_sort(F.collect_list("vec_id")).alias("ids"))
    asked = rows.filter(asks).groupBy("k0", "k1").agg(F.count("*").alias("n_queries"))
    classes = materialize(classes.join(asked, ["k0", "k1"], "left"), "classes")
    queries = classes.filter("n_queries is not null")
    n_shards, n_blocks = (max(1, -(-t.count() // size)) for t, size in ((classes, SHARD_ROWS), (queries, QUERY_BLOCK)))

    def dealt(n: int, salt: str) -> Column:
        return F.pmod(F.xxhash64(F.lit(salt), "k0", "k1"), F.lit(n))

    def each(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))

    cells = ["dim", "shard", "block"]
    left = classes.select("dim", dealt(n_shards, "shard").alias("shard"), each(n_blocks).alias("block"), "k0", "k1", "vector", "ids")
    right = queries.select("dim", each(n_shards).alias("shard"), dealt(n_blocks, "block").alias("block"), "k0", "k1", "vector")
    found = left.groupBy(*cells).cogroup(right.groupBy(*cells)).applyInArrow(_cell, "q0 long, q1 long, vec_id long, score double, own boolean")
    rank = F.row_number().over(Window.partitionBy("q0", "q1").orderBy(F.desc("score"), "vec_id", F.desc("own")))
    best = found.select("*", rank.alias("rank")).filter(F.col("rank") <= TOP + 1)
    best = best.groupBy("q0", "q1").agg(F.array_sort(F.collect_list(F.struct("rank", "vec_id", "score", "own"))).alias("best"))
    best = best.join(queries.select(F.col("k0").alias("q0"), F.col("k1").alias("q1"), "n_queries"), ["q0", "q1"]).select(F.col("q0").alias("k0"), F.col("q1").alias("k1"), "best", "n_queries")
    answers = join_sized(rows.filter(asks).select(F.col("vec_id").alias("query_id"), "k0", "k1"), materialize(best, "answers"), ["k0", "k1"], "n_queries")
    others = F.slice(F.filter("best", lambda b: ~(b["own"] & (b["vec_id"] == F.col("query_id")))), 1, TOP)
    listed = answers.select("query_id", F.posexplode(others).alias("at", "b"))
    return listed.select("query_id", (F.col("at") + 1).alias("rank"), F.col("b.vec_id").alias("vec_id"), F.col("b.score").alias("score"))
