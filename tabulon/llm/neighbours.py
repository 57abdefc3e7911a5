"""Approximate nearest neighbours by inner product: multiprobe p-stable hashing.

Inner products become distances by one more component (every vector gets the same length). Each of
several tables cuts a few Gaussian projections into cells of one width; a combination of cells is a
bucket, and there are more projections, so more buckets, the more rows there are. For a query, the chance
that a near vector lies in a bucket is the product of chances of its cells; buckets are visited in order of
that estimated success, perturbed ones after the query's own, until a share of it is covered. Candidates of
all tables are merged and ranked by the exact inner product. A query that finds too few rows meets all.

Equal vectors are one row of the index with their least ids, as many as an answer can need, so that a
very common vector costs no more than a rare one. Rows of a large bucket, and the queries that visit a
bucket, are cut into tiles; a row is copied only for the query tiles of its own bucket, and a pair of tiles
sends only its best rows of each query.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabulon.llm.common import hash_below, share_of, table, written

NEAREST = 20
TABLES = 6
WIDTH = 2.6
COVER = 0.45
#: Buckets that cover so much are visited first; what they hold bounds what the others have to send.
FIRST = 0.12
#: Rows that a bucket should hold, on average, and how many buckets one projection makes of one.
BUCKET_ROWS = 1000
SPLIT = 2.2
#: Cells of a projection; the outer ones are open. Three bits each.
CELLS = 8
#: Rows that the expected nearness is estimated from (nothing else), and rows of a tile's side.
SAMPLE = 2000
TILE = 2048
SEED = 11


def normal(z: np.ndarray) -> np.ndarray:
    """The normal distribution function, within 2e-7."""
    t = 1 / (1 + 0.3275911 * np.abs(z) / np.sqrt(2))
    y = 1 - ((((1.061405429 * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t * np.exp(-z * z / 2)
    return 0.5 * (1 + np.sign(z) * y)


@dataclass
class Hashes:
    """The projections of all tables, for vectors of one more component than the data has."""

    a: np.ndarray  # tables x components x projections
    b: np.ndarray  # tables x projections
    longest: float
    near: float = 0.4

    @classmethod
    def drawn(cls, size: int, longest: float, k: int, tables: int = TABLES) -> Hashes:
        rng = np.random.default_rng(SEED)
        return cls(rng.normal(size=(tables, size + 1, k)), rng.uniform(0, WIDTH, (tables, k)), longest)

    def lifted(self, x: np.ndarray) -> np.ndarray:
        x = x / self.longest
        return np.column_stack([x, np.sqrt(np.maximum(0.0, 1 - (x * x).sum(1)))])

    def buckets(self, x: np.ndarray, t: int) -> np.ndarray:
        """The cells of each row in a table, packed into one number."""
        cells = np.floor((self.lifted(x) @ self.a[t] + self.b[t]) / WIDTH).astype(np.int64) + CELLS // 2
        return (np.clip(cells, 0, CELLS - 1) << (3 * np.arange(cells.shape[1]))).sum(1)

    def chances(self, q: np.ndarray, t: int) -> np.ndarray:
        """Queries x projections x cells: the chance that a near vector's projection lies in the cell."""
        unit = q / np.sqrt((q * q).sum(1, keepdims=True))
        at = np.column_stack([unit, np.zeros(len(q))]) @ self.a[t]
        spread = np.sqrt(max(1e-6, 1 - self.near**2))
        edge = (np.arange(1, CELLS) - CELLS // 2) * WIDTH
        below = normal((edge - self.b[t][:, None] - self.near * at[:, :, None]) / spread)
        ends = np.ones((*below.shape[:2], 1))
        return np.maximum(np.diff(np.concatenate([0 * ends, below, ends], 2), axis=2), 1e-12)

    def visits(self, q: np.ndarray, t: int, cover: float = COVER) -> list[tuple[np.ndarray, int]]:
        """For each query, the buckets that it visits, best first, and how many of them come first.

        The best m combinations begin with some of the best m combinations of fewer projections, so that m are
        carried from projection to projection; m grows until the share is covered, or there are no more.
        """
        p, out = self.chances(q, t), [(np.zeros(0, np.int64), 0)] * len(q)
        left, m = np.arange(len(q)), 64
        while len(left):
            open_ = []
            for i in range(0, len(left), max(1, (1 << 20) // (m * CELLS))):
                rows = left[i : i + max(1, (1 << 20) // (m * CELLS))]
                best, code = np.ones((len(rows), 1)), np.zeros((len(rows), 1), np.int64)
                for j in range(p.shape[1]):
                    best = (best[:, :, None] * p[rows, j][:, None, :]).reshape(len(rows), -1)
                    code = (code[:, :, None] | (np.arange(CELLS, dtype=np.int64) << (3 * j))).reshape(len(rows), -1)
                    if best.shape[1] > m:
                        top = np.argpartition(-best, m - 1, 1)[:, :m]
                        best, code = np.take_along_axis(best, top, 1), np.take_along_axis(code, top, 1)
                order = np.argsort(-best, 1, kind="stable")
                covered = np.cumsum(np.take_along_axis(best, order, 1), 1)
                code = np.take_along_axis(code, order, 1)
                for r, row in enumerate(rows):
                    if covered[r, -1] < cover and code.shape[1] == m:
                        open_.append(row)
                    else:
                        n = int((covered[r] < cover).sum()) + 1
                        out[row] = code[r, :n], int((covered[r] < min(FIRST, cover)).sum()) + 1
            left, m = np.array(open_, np.int64), 4 * m
        return out


def projections(n: int) -> int:
    """How many projections give buckets of about BUCKET_ROWS of n rows."""
    return int(np.clip(np.round(np.log(max(n, 1) / BUCKET_ROWS) / np.log(SPLIT)), 2, 20))


def vectors(keys: list[bytes] | pa.Array) -> np.ndarray:
    keys = keys.to_pylist() if isinstance(keys, (pa.Array, pa.ChunkedArray)) else keys
    return np.frombuffer(b"".join(keys), np.float64).reshape(len(keys), -1)


def exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products row by row, the same for equal rows wherever they stand."""
    return (q * x).sum(1)


def best(q: np.ndarray, bound: np.ndarray, x: np.ndarray, ids: list[list[int]], own: np.ndarray, nearest: int) -> tuple[list, list, list]:
    """(query, vec_id, score) of each query's nearest rows, none below its bound, its own id left out."""
    out_q, out_v, out_s = [], [], []
    for i in range(0, len(q), 256):
        score = q[i : i + 256] @ x.T
        for r in range(len(score)):
            row, k = score[r], i + r
            least = bound[k]
            if len(row) > nearest:  # a class may be the query's own
                least = max(least, np.partition(row, len(row) - nearest - 1)[len(row) - nearest - 1])
            at = np.flatnonzero(row >= least - 1e-9)
            s = exact(q[k][None, :], x[at])
            found = sorted((-float(v), m) for v, c in zip(s, at) for m in ids[c] if m != own[k])[:nearest]
            out_q += [int(own[k])] * len(found)
            out_v += [m for _, m in found]
            out_s += [-v for v, _ in found]
    return out_q, out_v, out_s


def classes(rows: DataFrame, nearest: int) -> DataFrame:
    """key (the vector as doubles), ids (its least nearest + 1 ids) of each different vector; unfit vectors are left out.

    Each task first merges its own rows, so that a common vector reaches the shuffle once from each batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[bytes, set[int]] = {}
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if i is None or not v or None in v:
                    continue
                x = np.array(v, np.float64) + 0.0
                if np.isfinite(x).all() and x.any():
                    found.setdefault(x.tobytes(), set()).add(i)
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array([sorted(s)[: nearest + 1] for s in found.values()], pa.list_(pa.int64()))], names=["key", "ids"])

    part = rows.select(F.col("vec_id").cast("long"), "embedding").mapInArrow(run, "key binary, ids array<bigint>")
    return part.groupBy("key").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, nearest + 1).alias("ids"))


def search(rows: DataFrame, query_ids, nearest: int = NEAREST, cover: float = COVER) -> DataFrame:
    """query_id, rank, vec_id, score: for each query the nearest other rows that were found, nearest first.

    ``rows`` has vec_id and embedding (an array of numbers); ``query_ids`` is a condition on vec_id. Ties
    go to the smaller vec_id. Vectors that are null, zero, or hold a null or a non-finite component take
    no part, neither do those of another length than most. Rows that repeat id and vector count once.
    Null ids take no part. Without queries or candidates there are no rows. A query whose buckets hold
    fewer than ``nearest`` other rows is compared with all.
    """
    spark = rows.sparkSession
    shape = "query_id bigint, rank int, vec_id bigint, score double"
    index = written(classes(rows, nearest), "classes")
    sizes = index.groupBy(F.octet_length("key").alias("bytes")).count().orderBy(F.desc("count"), "bytes").first()
    if sizes is None:
        return spark.createDataFrame([], shape)
    index = index.where(F.octet_length("key") == sizes[0])
    size, n = sizes[0] // 8, sizes[1]
    asked = rows.where(query_ids).select(F.col("vec_id").cast("long").alias("query_id"), F.col("embedding").cast("array<double>").alias("v"))
    asked = asked.where("query_id is not null and size(v) = %d and not exists(v, e -> e is null or isnan(e) or abs(e) = double('infinity')) and exists(v, e -> e <> 0)" % size).distinct()
    longest = index.mapInArrow(_longest, "longest double").agg(F.max("longest")).first()[0]
    hashes = Hashes.drawn(size, longest, projections(n))
    sample = index.where(hash_below(share_of(n, SAMPLE), "key", seed=3)).select("key").collect()
    if sample:
        hashes.near = _nearness(vectors([bytes(r[0]) for r in sample]), n, nearest, longest)
    shared = spark.sparkContext.broadcast(hashes)  # tables x components x projections

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = vectors(batch.column(0))
            for t in range(len(shared.value.a)):
                at = shared.value.buckets(x, t) if len(x) else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), t, np.int32)), pa.array(at), batch.column(0), batch.column(1)], names=["t", "bucket", "key", "ids"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("t", pa.int32()), ("bucket", pa.int64())]))
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                q = np.array(part.column(1).to_pylist(), np.float64).reshape(part.num_rows, -1)
                first, rest = [[] for _ in q], [[] for _ in q]
                for t in range(len(shared.value.a)):
                    for r, (buckets, k) in enumerate(shared.value.visits(q, t, cover)):
                        first[r] += [(t, b) for b in buckets[:k].tolist()]
                        rest[r] += [(t, b) for b in buckets[k:].tolist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([r.tobytes() for r in q], pa.binary()), pa.array(first, kind), pa.array(rest, kind)], names=["query_id", "q", "first", "rest"])

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        names, kinds = ["query_id", "vec_id", "score"], [pa.int64(), pa.int64(), pa.float64()]
        found: tuple[list, list, list] = ([], [], [])
        if left.num_rows and right.num_rows:
            found = best(vectors(left.column("q")), left.column("bound").to_numpy(), vectors(right.column("key")), right.column("ids").to_pylist(), left.column("query_id").to_numpy(), nearest)
        return pa.Table.from_arrays([pa.array(v, k) for v, k in zip(found, kinds)], names=names)

    placed = written(index.mapInArrow(place, "t int, bucket bigint, key binary, ids array<bigint>"), "placed")
    ready = written(asked.mapInArrow(probe, "query_id bigint, q binary, first array<struct<t:int,bucket:bigint>>, rest array<struct<t:int,bucket:bigint>>"), "queries")
    held = written(placed.groupBy("t", "bucket").agg(F.count("*").alias("rows")), "buckets")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    by, tiles = ["t", "bucket", "slice", "g"], lambda c: F.ceil(F.col(c) / TILE)
    upto = lambda c: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(c) - 1))

    def visit(probes: DataFrame) -> DataFrame:
        """query_id, vec_id, score of the best rows of each pair of tiles; probes: query_id, q, bound, t, bucket."""
        asks = probes.groupBy("t", "bucket").agg(F.count("*").alias("asks"))
        plan = written(held.join(asks, ["t", "bucket"]).select("t", "bucket", tiles("rows").alias("slices"), tiles("asks").alias("groups")), "plan")
        left = probes.join(plan, ["t", "bucket"]).withColumn("g", F.pmod(F.xxhash64("query_id"), "groups")).withColumn("slice", upto("slices"))
        right = placed.join(plan, ["t", "bucket"]).withColumn("slice", F.pmod(F.xxhash64("key"), "slices")).withColumn("g", upto("groups"))
        met = left.select(*by, "query_id", "q", "bound").groupBy(*by).cogroup(right.select(*by, "key", "ids").groupBy(*by)).applyInArrow(meet, "query_id bigint, vec_id bigint, score double")
        return met.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))

    def leading(found: DataFrame) -> DataFrame:
        each = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        return each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= nearest).select("query_id", "rank", "vec_id", "score")

    listed = lambda queries, name: queries.select("query_id", "q", "bound", F.explode(name).alias("at")).select("query_id", "q", "bound", "at.t", "at.bucket")
    free = F.lit(float("-inf")).alias("bound")
    one = written(leading(visit(listed(ready.select("query_id", "q", free, "first"), "first"))), "first")
    low = one.where(F.col("rank") == nearest).select("query_id", F.col("score").alias("low"))
    bounded = ready.join(low, "query_id", "left").select("query_id", "q", F.coalesce("low", F.lit(float("-inf"))).alias("bound"), "rest")
    two = written(leading(one.drop("rank").unionByName(visit(listed(bounded, "rest")))), "second")
    full = two.where(F.col("rank") == nearest).select("query_id")
    short = written(ready.join(full, "query_id", "left_anti").select("query_id", "q", free, F.lit(0).alias("t")), "short")
    if short.isEmpty():
        return two
    every = visit(short.join(held.where("t = 0").select("t", "bucket"), "t"))  # a table's buckets hold every row once
    return leading(two.drop("rank").unionByName(every))


def _longest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            x = vectors(batch.column(0))
            yield pa.RecordBatch.from_arrays([pa.array([float(np.sqrt((x * x).sum(1).max()))])], names=["longest"])


def _nearness(x: np.ndarray, n: int, nearest: int, longest: float) -> float:
    """The cosine, of lifted vectors, that a query's last neighbour has: by rank among the sample."""
    q = x[:: max(1, len(x) // 200)]
    score = np.sort(q @ x.T / longest / np.sqrt((q * q).sum(1, keepdims=True)), 1)[:, ::-1]
    rank = min(len(x) - 1, max(1, round(nearest * len(x) / n)))
    return float(np.clip(score[:, rank].mean(), 0.05, 0.95))


def query(spark, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
