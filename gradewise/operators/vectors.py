"""Best passages by dot product: exact over a grid of blocks, or approximate through a stored index of cells.

Both move vectors by shuffle only. Questions and passages are dealt to a grid: a block of questions, of bounded bytes, meets every slot of the
passages once. In a task the questions of a block come first and are held; the passages stream by, longest first, so a question is done when
its k-th score is above what its own length times that of all passages to come can reach. A task returns k rows per question.

The exact form has one cell. The index of the approximate form has many: cells around centroids, and a question visits the cells nearest to it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType, IntegerType, StructField, StructType

#: Bytes, as double, and rows of question vectors that a task holds; passages that are multiplied with them at once, and their bytes as double.
BLOCK_BYTES = 32 << 20
QUERY_BLOCK = 1 << 15
CORPUS_CHUNK = 8192
CHUNK_BYTES = 8 << 20
#: Scores, or distances to centroids, that a task has at once.
SCORES = 1 << 19
#: Passages of a cell that meet in one task, and of a slot of the exact form at least, where there are so many.
SLOT_ROWS, LEAST_SLOT_ROWS = 1 << 16, 1 << 13
#: Rows that the centroids are fitted on, for each cell; every row is indexed.
SAMPLE_PER_CELL = 128
MOST_CELLS = 4096
#: Questions, and best passages of each, by which the number of cells to visit is measured; the share of them that is aimed at.
MEASURED, MEASURED_K, RECALL = 512, 10, 0.95

_KEYS = ["_cell", "_width", "_block", "_slot"]


def length(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def _of_one_kind(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vectors of both as float if both are, else as double."""
    narrow = all(t.schema["vector"].dataType == ArrayType(FloatType(), t.schema["vector"].dataType.containsNull) for t in (left, right))
    kind = "array<float>" if narrow else "array<double>"
    return tuple(t.withColumn("vector", F.col("vector").cast(kind)) for t in (left, right))


def _block_searcher(k: int, exclude_self: bool, chunk_rows: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Reads rows by grid place, questions before passages. Defined inside a function so that it travels to the workers by value."""
    keys, own_columns = list(_KEYS), ["question_id", "doc_id", "score"]
    most, chunk_bytes = SCORES, CHUNK_BYTES

    def matrix(column: pa.Array, width: int) -> np.ndarray:
        return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)

    def copies_apart(vectors: np.ndarray, names: pa.Array) -> np.ndarray:
        """The rows, which come by id, without those that have the same vector as rows of k smaller ids, one more where a question leaves its own out."""
        _, code = np.unique(np.ascontiguousarray(vectors).view(f"V{vectors.itemsize * vectors.shape[1]}")[:, 0], return_inverse=True)
        if len(code) == code.max() + 1:
            return np.arange(len(code))
        order = np.argsort(code, kind="stable")
        code, name = code[order], pc.dictionary_encode(names).indices.to_numpy()[order]
        new = np.r_[True, code[1:] != code[:-1]]
        ids = np.cumsum(new | np.r_[True, name[1:] != name[:-1]])
        before = ids - ids[new][np.cumsum(new) - 1]
        return np.sort(order[before < k + exclude_self])

    def in_order(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Products of rows, added up from the first component on, so that copies score the same wherever they are."""
        scores = np.zeros(len(left))
        for x, y in zip(left.astype(np.float64).T, right.T, strict=True):
            scores += x * y
        return scores

    class Best:
        """The questions of a block, their vectors in the kind they come in, and the k best passages of each so far."""

        def __init__(self, parts: list[pa.RecordBatch], width: int):
            self.width, self.ids = width, pa.chunked_array([p.column("question_id") for p in parts]).combine_chunks()
            self.vectors = np.concatenate([matrix(p.column("vector"), width) for p in parts])
            self.length = np.sqrt(np.einsum("ij,ij->i", self.vectors, self.vectors, dtype=np.float64))
            self.floor = np.full(len(self.ids), -np.inf)
            self.rows_of: dict = {}
            for row, name in enumerate(self.ids.to_pylist() if exclude_self else ()):
                self.rows_of.setdefault(name, []).append(row)
            self.found, self.done = None, False

        def take(self, rows: pa.RecordBatch) -> None:
            longest = rows.column("_length").to_numpy(zero_copy_only=False)[0]  # rows come longest first
            reach = self.length * longest
            active = np.flatnonzero(~(reach + 1e-9 * np.abs(reach) < self.floor))
            if not len(active):
                self.done = True
                return
            names = rows.column("doc_id")
            order = pc.sort_indices(names).to_numpy()  # of equal scores the smaller id comes first
            right = matrix(rows.column("vector"), self.width)[order]
            kept = copies_apart(right, names.take(pa.array(order)))
            names, right = names.take(pa.array(order[kept])), right[kept].astype(np.float64)
            own_length = np.sqrt((right**2).sum(axis=1))
            # what products of blocks may differ by from sums in order
            slack = self.length * own_length[np.isfinite(own_length)].max(initial=0.0) * max(1e-12, 4e-16 * self.width)
            own = [(r, c) for c, name in enumerate(names.to_pylist()) for r in self.rows_of.get(name, ())] if self.rows_of else []
            own_row, own_column = np.array(sorted(own), np.int64).reshape(-1, 2).T
            places, columns, found = [], [], []
            step = max(1, most // len(names))
            for at in range(0, len(active), step):
                part = active[at : at + step]
                scores = self.vectors[part].astype(np.float64) @ right.T
                mine = slice(*np.searchsorted(own_row, [part[0], part[-1] + 1]))
                here = np.searchsorted(part, own_row[mine])
                asked = part[np.minimum(here, len(part) - 1)] == own_row[mine]
                scores[here[asked], own_column[mine][asked]] = -np.inf
                high = scores >= (self.floor - slack)[part, None]
                many = np.flatnonzero(np.count_nonzero(high, axis=1) > k)
                if len(many):
                    finite = np.where(np.isfinite(scores[many]), scores[many], -np.inf)
                    high[many] = finite >= np.partition(finite, -k, axis=1)[:, -k, None] - slack[part[many], None]
                r, c = np.divmod(np.flatnonzero(high), len(names))
                real = np.isfinite(scores[r, c])
                r, c = r[real], c[real]
                score = np.concatenate([np.zeros(0), *(in_order(self.vectors[part[r[x : x + 4096]]], right[c[x : x + 4096]]) for x in range(0, len(r), 4096))])
                by = np.lexsort((c, -score, r))
                r, c, score = r[by], c[by], score[by]
                first = np.arange(len(r)) - np.searchsorted(r, r) < k
                places.append(part[r[first]])
                columns.append(c[first])
                found.append(score[first])
            new = pa.table({"q": np.concatenate(places), "doc_id": names.take(pa.array(np.concatenate(columns))), "score": np.concatenate(found)})
            whole = new if self.found is None else pa.concat_tables([self.found, new])
            whole = whole.sort_by([("q", "ascending"), ("score", "descending"), ("doc_id", "ascending")]).combine_chunks()
            q = whole["q"].to_numpy()
            place = np.arange(len(q)) - np.searchsorted(q, q)
            self.found = whole.filter(pa.array(place < k))
            last = np.flatnonzero(place == k - 1)
            self.floor[q[last]] = whole["score"].to_numpy()[last]

        def rows(self) -> Iterator[pa.RecordBatch]:
            if self.found is not None:
                for part in self.found.to_batches():
                    yield pa.RecordBatch.from_arrays([self.ids.take(part.column("q")), part.column("doc_id"), part.column("score")], names=own_columns)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, asked, best = None, [], None
        for batch in batches:
            marks = [np.asarray(batch.column(c)) for c in (*keys, "_side")]
            changes = np.any([np.diff(m, prepend=m[0]) != 0 for m in marks], axis=0) if batch.num_rows else np.zeros(0, bool)
            starts = [0, *np.flatnonzero(changes), batch.num_rows]
            for a, b in zip(starts, starts[1:], strict=False):
                if a == b:
                    continue
                here = tuple(int(m[a]) for m in marks[:-1])
                if here != place:
                    if best is not None:
                        yield from best.rows()
                    place, asked, best = here, [], None
                if marks[-1][a] == 0:
                    asked.append(batch.slice(a, b - a))
                    continue
                if asked and here[1]:
                    best, asked = Best(asked, here[1]), []
                if best is not None:
                    step = max(1, min(chunk_rows, chunk_bytes // (8 * here[1])))
                    for at in range(a, b, step):
                        if not best.done:
                            best.take(batch.slice(at, min(step, b - at)))
        if best is not None:
            yield from best.rows()

    return search


def best_on_grid(asked: DataFrame, passages: DataFrame, k: int, exclude_self: bool = False, chunk_rows: int = CORPUS_CHUNK) -> DataFrame:
    """`(question_id, doc_id, score, rank)`: the k best passages for each question among those that share a cell with it.

    `asked` is `(_cell, question_id, vector, _blocks, _slots)`, `passages` the same with `doc_id`; `_blocks` and `_slots` say how many blocks
    of questions and slots of passages the cell has. Vectors of different width never meet. Ties go to the smaller id.
    """
    asked, passages = _of_one_kind(asked, passages)
    kind = StructType([asked.schema["question_id"], passages.schema["doc_id"], StructField("score", DoubleType())])
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dealt = lambda ident, n: F.pmod(F.xxhash64(ident, "vector"), F.col(n)).cast("int")
    none = lambda name: F.lit(None).cast(kind[name].dataType).alias(name)
    left = asked.select(
        "_cell", F.size("vector").alias("_width"), dealt("question_id", "_blocks").alias("_block"), spread("_slots").alias("_slot"),
        F.lit(0).alias("_side"), F.lit(0.0).alias("_length"), "question_id", none("doc_id"), "vector",
    )
    right = passages.select(
        "_cell", F.size("vector").alias("_width"), spread("_blocks").alias("_block"), dealt("doc_id", "_slots").alias("_slot"),
        F.lit(1).alias("_side"), length(F.col("vector")).alias("_length"), none("question_id"), "doc_id", "vector",
    )
    rows = left.unionByName(right).repartition(*_KEYS).sortWithinPartitions(*_KEYS, "_side", F.desc_nulls_first("_length"))
    found = rows.mapInArrow(_block_searcher(k, exclude_self, chunk_rows), kind)
    best = Window.partitionBy("question_id").orderBy(F.col("score").desc(), "doc_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def _asked(questions: DataFrame, question_id: str, vector: str) -> DataFrame:
    return questions.select(F.col(question_id).alias("question_id"), F.col(vector).alias("vector")).filter("vector is not null")


def _passages(corpus: DataFrame, doc_id: str, vector: str) -> DataFrame:
    return corpus.select(F.col(doc_id).alias("doc_id"), F.col(vector).alias("vector")).filter("vector is not null")


def rows_of_block(width: int, query_block: int) -> int:
    return max(1, min(query_block, BLOCK_BYTES // (8 * max(1, width))))


def retrieve_exact(
    questions: DataFrame, corpus: DataFrame, k: int, question_id: str, doc_id: str, vector: str, exclude_self: bool, query_block: int, corpus_chunk: int
) -> DataFrame:
    """All questions against all passages."""
    asked, passages = _asked(questions, question_id, vector), _passages(corpus, doc_id, vector)
    size = asked.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("width")).first()
    blocks = max(1, -(-size["n"] // rows_of_block(size["width"] or 1, query_block)))
    # as many slots as make one task for each shuffle partition, but none of few passages, as a slot gives k rows per question
    parts = -(-int(questions.sparkSession.conf.get("spark.sql.shuffle.partitions")) // blocks)
    slots = max(1, min(parts, -(-corpus.count() // LEAST_SLOT_ROWS)))
    grid = {"_cell": F.lit(0), "_blocks": F.lit(blocks), "_slots": F.lit(slots)}
    return best_on_grid(asked.withColumns(grid), passages.withColumns(grid), k, exclude_self, corpus_chunk)


class VectorIndex(NamedTuple):
    """A stored index: passages by cell, rows of each cell, centroids with the length that all vectors are brought to, and in which of its
    nearest cells a question's best passages were found when the index was built."""

    passages: DataFrame
    sizes: DataFrame
    centroids: np.ndarray
    longest: float
    visits: list[tuple[int, int]]


def _cell_finder(centroids: np.ndarray, longest: float, probes: int, lift: bool):
    """Numbers of the nearest centroids of each vector, the nearest first. Vectors are lifted by one component that brings all to one length, so that the
    nearest of them is the one with the highest product."""
    width = centroids.shape[1] - 1

    def lifted(vectors: np.ndarray) -> np.ndarray:
        if lift:
            rest = np.sqrt(np.maximum(0.0, longest**2 - (vectors**2).sum(axis=1)))
        else:  # a question: only its direction counts
            vectors = vectors * (longest / np.maximum(np.sqrt((vectors**2).sum(axis=1)), 1e-300))[:, None]
            rest = np.zeros(len(vectors))
        return np.hstack([vectors, rest[:, None]])

    rows_at_once = max(1, SCORES // len(centroids))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squares = (centroids**2).sum(axis=1)
        for batch in (whole.slice(at, rows_at_once) for whole in batches for at in range(0, whole.num_rows, rows_at_once)):
            vectors = batch.column("vector")
            flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, width)
            distance = squares - 2 * lifted(flat) @ centroids.T
            near = np.argpartition(distance, probes - 1, axis=1)[:, :probes]
            near = np.take_along_axis(near, np.argsort(np.take_along_axis(distance, near, axis=1), axis=1, kind="stable"), axis=1)
            cells = pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1) * near.shape[1], pa.int32()), pa.array(near.ravel().astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*batch.columns, cells], names=[*batch.schema.names, "_cells"])

    return find


def _with_cells(rows: DataFrame, centroids: np.ndarray, longest: float, probes: int, lift: bool) -> DataFrame:
    kind = StructType([*rows.schema.fields, StructField("_cells", ArrayType(IntegerType()))])
    found = rows.mapInArrow(_cell_finder(centroids, longest, probes, lift), kind)
    return found.select(*rows.columns, F.posexplode("_cells").alias("_near", "_cell"))


def write_vector_index(
    corpus: DataFrame, path: str, doc_id: str = "doc_id", vector: str = "embedding", cells: int | None = None, seed: int = 7
) -> None:
    """Store an index of all vectors of the corpus under `path`: passages partitioned by cell, rows per cell, centroids, and how many cells
    have to be visited.

    `cells` is the square root of the number of passages by default, `MOST_CELLS` at most. Centroids are fitted on a sample of
    `SAMPLE_PER_CELL` rows for each cell, picked by digest; every row is put in the cell of its nearest centroid. All vectors have one width and
    finite components.
    """
    spark = corpus.sparkSession
    passages = _passages(corpus, doc_id, vector)
    size = passages.agg(F.count(F.lit(1)).alias("n"), F.max(length(F.col("vector"))).alias("longest"), F.max(F.size("vector")).alias("width")).first()
    n, longest, width = size["n"], size["longest"] or 1.0, size["width"] or 1
    cells = max(1, min(cells or round(n**0.5), MOST_CELLS, n or 1))
    share = min(1.0, 2.0 * SAMPLE_PER_CELL * cells / max(1, n))
    picked = passages.filter(F.pmod(F.xxhash64("doc_id", "vector"), F.lit(1 << 30)) < int(share * (1 << 30))).limit(SAMPLE_PER_CELL * cells)
    rest = F.sqrt(F.greatest(F.lit(0.0), F.lit(longest**2) - F.pow(length(F.col("vector")), 2)))
    lifted = picked.select(array_to_vector(F.concat(F.col("vector").cast("array<double>"), F.array(rest))).alias("features"))
    if n:
        model = KMeans(k=cells, seed=seed, maxIter=15, initSteps=2).fit(lifted)
        centroids = np.array(model.clusterCenters())
    else:
        centroids = np.zeros((1, width + 1))
    placed = _with_cells(passages, centroids, longest, 1, True).drop("_near")
    # a crowded cell is written by several tasks
    placed.hint("rebalance", "_cell").write.mode("overwrite").partitionBy("_cell").parquet(f"{path}/passages")
    stored = spark.read.parquet(f"{path}/passages") if n else placed
    stored.groupBy("_cell").agg(F.count(F.lit(1)).alias("rows")).coalesce(1).write.mode("overwrite").parquet(f"{path}/sizes")
    centers = [(i, c.tolist(), float(longest)) for i, c in enumerate(centroids)]
    spark.createDataFrame(centers, "cell int, centroid array<double>, longest double").coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")
    _visits_needed(stored, centroids, longest).coalesce(1).write.mode("overwrite").parquet(f"{path}/visits")


def _visits_needed(passages: DataFrame, centroids: np.ndarray, longest: float) -> DataFrame:
    """`(near, rows)`: how many of the best passages of a sample of questions are in the cell that is `near`-th nearest, from 0.

    The questions are passages picked by digest, `MEASURED` at most, and their best passages are found exactly.
    """
    asked = passages.select(F.col("doc_id").alias("question_id"), "vector").filter("vector is not null").orderBy(F.xxhash64("vector"), "question_id").limit(MEASURED)
    best = retrieve_exact(asked, passages, MEASURED_K, "question_id", "doc_id", "vector", True, QUERY_BLOCK, CORPUS_CHUNK)
    cells = best.select("question_id", "doc_id").join(passages.select("doc_id", "_cell"), "doc_id")
    visits = _with_cells(asked, centroids, longest, len(centroids), False)
    return cells.join(visits, ["question_id", "_cell"]).groupBy(F.col("_near").alias("near")).agg(F.count(F.lit(1)).alias("rows"))


def probes_for(index: VectorIndex, recall: float) -> int:
    """The least number of cells that held this share of the best passages when the index was built."""
    total = sum(n for _, n in index.visits)
    seen = 0
    for near, n in index.visits:
        seen += n
        if seen >= recall * total:
            return near + 1
    return len(index.centroids)


def read_vector_index(spark: SparkSession, path: str) -> VectorIndex:
    centers = spark.read.parquet(f"{path}/centroids").orderBy("cell").collect()  # MOST_CELLS rows at most
    visits = [(r["near"], r["rows"]) for r in spark.read.parquet(f"{path}/visits").orderBy("near").collect()]
    passages, sizes = spark.read.parquet(f"{path}/passages"), spark.read.parquet(f"{path}/sizes")
    return VectorIndex(passages, sizes, np.array([r["centroid"] for r in centers]), centers[0]["longest"], visits)


def retrieve_near(
    questions: DataFrame, index: VectorIndex, k: int, question_id: str = "question_id", vector: str = "embedding", probes: int | None = None,
    recall: float = RECALL, exclude_self: bool = False, corpus_chunk: int = CORPUS_CHUNK,
) -> DataFrame:
    """Approximate `retrieve_exact` through a stored index: each question is compared with the passages of its `probes` nearest cells.

    Without `probes`, so many cells are visited as held the share `recall` of the best passages of a sample when the index was built: few
    where vectors are clustered, many where they are spread evenly. Scores are exact; passages in cells that aren't visited are missed. Only the visited cells
    are read and moved; a crowded cell is split into slots of `SLOT_ROWS` passages and blocks of questions.
    """
    asked = _asked(questions, question_id, vector)
    cells, width = len(index.centroids), index.centroids.shape[1] - 1
    probes = max(1, min(probes or probes_for(index, recall), cells))
    asked = _with_cells(asked.filter(F.size("vector") == width), index.centroids, index.longest, probes, False).drop("_near")
    room = rows_of_block(width, QUERY_BLOCK)
    # a row for each cell, MOST_CELLS at most
    visited = asked.groupBy("_cell").agg(F.ceil(F.count(F.lit(1)) / room).cast("int").alias("_blocks"))
    layout = F.broadcast(index.sizes.join(visited, "_cell").select("_cell", "_blocks", F.ceil(F.col("rows") / SLOT_ROWS).cast("int").alias("_slots")))
    return best_on_grid(asked.join(layout, "_cell"), index.passages.join(layout, "_cell"), k, exclude_self, corpus_chunk)
