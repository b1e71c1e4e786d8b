"""Exact top-k by inner product, pruned by segment statistics from coarse to fine.

A vector is cut into 1, 4 and 16 segments; of each segment its mean and deviation are known. For two vectors, segment by segment,
|q - c|^2 >= n * ((mean_q - mean_c)^2 + (dev_q - dev_c)^2), n the segment's length. The lower bound of the distance bounds the inner product
(|q|^2 + |c|^2 - d^2) / 2 from above. Candidates whose bound is under the query's k-th best score so far are dropped level by level; the
scores of the survivors are computed exactly, in integers.

The candidates stay where they are read. Queries travel to them in blocks of at most `BLOCK_BYTES`, so what is sent at once has a fixed size
and the candidates are read once for each block. A first look at `SEED_ROWS` candidates gives each query a score that its k-th best reaches at
least; each task then keeps at most k rows per query.

Results in special cases: a vector that is null or has null or non-finite components takes no part; vectors of different length have no
score together; each row is a candidate, also of a repeated vec_id, but never for a query of its own vec_id; equal query rows are one query;
an empty table gives no rows; components so large that a score leaves 64 bits raise an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

LEVELS = (1, 4, 16)
BLOCK_BYTES, SEED_ROWS = 64 << 20, 4096


def integer_vectors(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding", scale: float = 256.0) -> DataFrame:
    """(id, v): floor(scale * x) of each component, for the vectors that take part."""
    x = F.col(column)
    bad = lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf"))
    ok = x.isNotNull() & ~F.exists(x, bad) & F.col(id_column).isNotNull()
    v = F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("long"))
    return vectors.where(ok).select(F.col(id_column).cast("long").alias("id"), v.alias("v"))


def statistics(m: np.ndarray, parts: int) -> np.ndarray:
    """Per vector: sqrt(n) * mean and sqrt(n) * deviation of each segment, side by side."""
    edges = np.linspace(0, m.shape[1], min(parts, max(1, m.shape[1])) + 1).astype(int)
    out = []
    for a, b in zip(edges, edges[1:], strict=False):
        s, root = m[:, a:b], np.sqrt(max(1, b - a))
        out += [s.mean(1) * root, s.std(1) * root] if b > a else []
    return np.stack(out, 1) if out else np.zeros((len(m), 0))


class Block:
    """Queries of one length: ids, vectors, norms, statistics and the score that each k-th best reaches at least."""

    def __init__(self, ids: np.ndarray, m: np.ndarray):
        self.ids, self.m = ids, m
        x = m.astype(float)
        self.norm = (x * x).sum(1)
        self.stats = [statistics(x, p) for p in LEVELS]
        self.floor = np.full(len(ids), -np.inf)

    def best(self, ids: np.ndarray, m: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query row, id, score): the k best of these candidates for each query, less those under its floor."""
        x = m.astype(float)
        norm, stats = (x * x).sum(1), [statistics(x, p) for p in LEVELS]
        largest = float(np.sqrt(self.norm.max(initial=0) * norm.max(initial=0)))
        exact = largest < 2**52
        picked = []
        for at in range(0, len(self.ids), 128):
            rows = slice(at, at + 128)
            alive = self.ids[rows, None] != ids[None, :]
            for q, c in zip(self.stats, stats, strict=True):
                # sum over segments of mean*mean + dev*dev, the bound of the inner product that the distance bound gives
                bound = q[rows] @ c.T
                alive &= bound >= (self.floor[rows] - 1e-9 * largest - 1)[:, None]  # with room for rounding
            r, c = np.nonzero(alive)
            if not len(r):
                continue
            if len(r) > 0.2 * alive.size and exact:
                score = (x @ self.m[rows].astype(float).T).T[r, c].astype(np.int64)
            elif exact:
                score = np.einsum("ij,ij->i", self.m[rows][r].astype(float), x[c]).astype(np.int64)
            else:
                whole = [sum(a * b for a, b in zip(p, q, strict=True)) for p, q in zip(self.m[rows][r].tolist(), m[c].tolist(), strict=True)]
                score = np.array(whole, np.int64)
            keep = score >= self.floor[rows][r]
            r, c, score = r[keep] + at, c[keep], score[keep]
            order = np.lexsort((ids[c], -score, r))
            r, c, score = r[order], c[order], score[order]
            first = np.searchsorted(r, r)
            top = np.arange(len(r)) - first < k
            picked.append((r[top], ids[c[top]], score[top]))
        if not picked:
            return np.zeros(0, int), np.zeros(0, np.int64), np.zeros(0, np.int64)
        return tuple(np.concatenate(x) for x in zip(*picked, strict=True))

    def raise_floor(self, ids: np.ndarray, m: np.ndarray, k: int) -> None:
        row, _, score = self.best(ids, m, k)
        last = np.flatnonzero(np.bincount(row, minlength=len(self.ids)) >= k)
        for r in last:
            self.floor[r] = max(self.floor[r], score[np.searchsorted(row, r, "right") - 1])


def by_length(table: pa.Table | pa.RecordBatch) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """ids and matrices of the rows (id, v), one per vector length."""
    ids = np.asarray(table.column("id").to_numpy(zero_copy_only=False), np.int64)
    column = table.column("v")
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.asarray(column.value_lengths().to_numpy(zero_copy_only=False), np.int64)
    flat, ends = column.flatten().to_numpy(zero_copy_only=False), np.cumsum(sizes)
    out = {}
    for n in np.unique(sizes):
        rows = np.flatnonzero(sizes == n)
        at = (ends[rows] - n)[:, None] + np.arange(n)
        out[int(n)] = ids[rows], flat[at.ravel()].reshape(len(rows), n).astype(np.int64)
    return out


def top_k(candidates: DataFrame, queries: DataFrame, k: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best candidates (id, v) of each query (id, v), ties to the smaller id."""
    spark = candidates.sparkSession
    queries = queries.distinct()
    size = queries.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("d")).first()
    schema = "query_id long, query long, vec_id long, score long"
    if not size["n"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    # a query takes its vector, its statistics and its floor, all of 8 bytes
    each = 8 * (2 * (size["d"] or 0) + 2 * sum(LEVELS) + 4)
    blocks = max(1, -(-size["n"] * each // block_bytes))
    seed = by_length(candidates.limit(SEED_ROWS).toArrow())
    found = None
    for number in range(blocks):
        part = queries.where(F.pmod(F.xxhash64("id", "v"), F.lit(blocks)) == number).select("id", "v", F.xxhash64("v").alias("h"))
        table = part.toArrow().sort_by([("id", "ascending"), ("h", "ascending")])
        codes = dict(zip(zip(table["id"].to_pylist(), map(tuple, table["v"].to_pylist()), strict=True), table["h"].to_pylist(), strict=True))
        block = {n: Block(*x) for n, x in by_length(table).items()}
        hashes = {n: np.array([codes[int(i), tuple(v)] for i, v in zip(b.ids, b.m.tolist(), strict=True)], np.int64) for n, b in block.items()}
        for n, b in block.items():
            if n in seed:
                b.raise_floor(*seed[n], k)
        sent = spark.sparkContext.broadcast((block, hashes))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            block, hashes = sent.value
            for batch in batches:
                for n, (ids, m) in by_length(batch).items():
                    if n not in block:
                        continue
                    row, vec, score = block[n].best(ids, m, k)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(block[n].ids[row]), pa.array(hashes[n][row]), pa.array(vec), pa.array(score)],
                        names=["query_id", "query", "vec_id", "score"],
                    )

        own = candidates.mapInArrow(run, schema)
        found = own if found is None else found.unionAll(own)
    order = W.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def every_nth(vectors: DataFrame, nth: int = 50, k: int = 5) -> DataFrame:
    """The rows whose id `nth` divides, against all rows."""
    whole = integer_vectors(vectors)
    return top_k(whole, whole.where(F.col("id") % nth == 0), k)


TOPK_SQL = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
    SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
        CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
) WHERE rank <= 5
"""
