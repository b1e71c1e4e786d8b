"""Exact dedup by content-defined chunk recipes.

Texts are cut into chunks where a rolling hash over the last 32 bytes says so, so equal texts are cut alike. Every chunk has a digest; the
chunks of all texts are made distinct by their bytes, and a digest becomes an identifier once it is verified that no two different chunks
have it (else all digests are taken anew, twice as long). A text's recipe is its ordered list of identifiers, and texts are equal exactly if
their recipes are. So the bytes of a chunk move once, however many texts hold it, before a task's own copies are merged; documents are
compared, grouped and joined by recipes, which have 16 bytes for about two thousand of text.

Results in special cases: a null text is an empty one, an empty text has an empty recipe, a text of any length is cut in blocks of fixed
size; of repeated rows with one id and text exactly one stays; a missing id counts as the smallest; an empty table gives no rows; only
doc_id and text are read, so other columns can't clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradewise.llm.common import stored
from gradewise.llm.textual import mixed, slices

#: Bytes of a chunk: least, most, and one cut in 2 ** CUT_BITS positions between them.
LEAST, MOST, CUT_BITS = 256, 16384, 11
#: Bytes of the rolling hash's window, and bytes hashed at once.
WINDOW, BLOCK = 32, 1 << 22
DIGEST = 16

_GEAR = (mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)


def cut_places(data: np.ndarray) -> np.ndarray:
    """Positions after which the rolling hash of the last `WINDOW` bytes allows a cut; the first `WINDOW` positions mean nothing."""
    found = []
    for at in range(0, len(data), BLOCK):
        begin = max(0, at - WINDOW)
        x = _GEAR[data[begin : at + BLOCK]]
        width = 1
        while width < WINDOW:  # x[i] is the hash of `width` bytes, then of twice as many
            y = x.copy()
            y[width:] += x[:-width] << np.uint32(width)
            x, width = y, 2 * width
        hit = np.flatnonzero(x >> np.uint32(32 - CUT_BITS) == 0) + begin
        found.append(hit[hit >= at])
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def cut_ends(size: int, places: list[int]) -> list[int]:
    """Ends of the chunks of a text of `size` bytes; depends on the text alone."""
    ends, start = [], 0
    for place in [*places, size - 1]:
        end = place + 1
        while end - start > MOST:
            start += MOST
            ends.append(start)
        if end - start >= LEAST:
            ends.append(end)
            start = end
    if start < size:
        ends.append(size)
    return ends


def chunked(batch: pa.RecordBatch) -> Iterator[tuple[memoryview, list[int]]]:
    """Bytes and chunk ends of each text."""
    texts = batch.column("text").cast(pa.binary()).cast(pa.large_binary())
    _, offsets, data = texts.buffers()
    edges = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    whole = memoryview(data) if data is not None else memoryview(b"")
    first = int(edges[0])
    places = cut_places(np.frombuffer(whole, np.uint8)[first : int(edges[-1])]) + first
    cuts = np.searchsorted(places, edges)
    for i in range(len(texts)):
        a, b = int(edges[i]), int(edges[i + 1])
        # a cut before LEAST bytes is never taken, so no window that counts reaches into the text before
        yield whole[a:b], cut_ends(b - a, (places[cuts[i] : cuts[i + 1]] - a).tolist())


def digest(chunk: memoryview, size: int) -> bytes:
    out = b""
    while len(out) < size:
        out += xxhash.xxh3_128_digest(chunk, seed=len(out))
    return out[:size]


def _recipe_rows(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            recipes, hashes = [], []
            for text, ends in chunked(batch):
                starts = [0, *ends]
                recipes.append(b"".join(digest(text[a:b], size) for a, b in zip(starts, ends, strict=False)))
                hashes.append(hashlib.sha256(text).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(recipes, pa.binary()), pa.array(hashes, pa.string())], names=["doc_id", "recipe", "text_sha256"]
            )

    return rows


def _chunk_rows(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            own = {}
            for text, ends in chunked(batch):
                for a, b in zip([0, *ends], ends, strict=False):
                    own[bytes(text[a:b])] = None
            yield pa.RecordBatch.from_arrays(
                [pa.array([digest(memoryview(c), size) for c in own], pa.binary()), pa.array(list(own), pa.binary())], names=["digest", "chunk"]
            )

    return rows


def whole_texts(docs: DataFrame) -> DataFrame:
    return docs.select(docs["doc_id"].alias("doc_id"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"))


def distinct_chunks(docs: DataFrame, size: int = DIGEST) -> DataFrame:
    """(digest, chunk): every distinct chunk of the texts once."""
    return whole_texts(docs).select("text").mapInArrow(_chunk_rows(size), "digest binary, chunk binary").distinct()


def shared_digests(chunks: DataFrame) -> DataFrame:
    """Digests that more than one distinct chunk has."""
    return chunks.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("digest")


def recipes(docs: DataFrame, size: int = DIGEST) -> DataFrame:
    """(doc_id, recipe, text_sha256, row): each document's verified identifiers in order, as one binary. A stored table."""
    texts = whole_texts(docs)
    kind = texts.schema["doc_id"].dataType.simpleString()
    while not shared_digests(distinct_chunks(docs, size)).isEmpty():
        size *= 2
    rows = texts.mapInArrow(_recipe_rows(size), f"doc_id {kind}, recipe binary, text_sha256 string")
    return stored(rows.withColumn("row", F.monotonically_increasing_id()), "recipes")


def exact_duplicates(docs: DataFrame, size: int = DIGEST) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256): of equal texts the row with the largest id stays."""
    rows = recipes(docs, size)
    # one row per recipe, stored, so that the rows of a common recipe can be split among tasks in the join
    groups = stored(
        rows.groupBy("recipe").agg(F.count(F.lit(1)).alias("group_size"), F.max(F.struct("doc_id", "row")).alias("keep")), "recipe-groups"
    )
    return rows.join(groups, "recipe").select(
        "doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("keep.row")).alias("kept"), "text_sha256"
    )


COPIES_SQL = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
g AS (SELECT *, max(doc_id) OVER (PARTITION BY text) AS keep_id, count(*) OVER (PARTITION BY text) AS group_size,
             row_number() OVER (PARTITION BY text ORDER BY doc_id DESC NULLS LAST) AS place FROM t)
SELECT doc_id, keep_id, group_size, place = 1 AS kept, sha256(text) AS text_sha256 FROM g
"""
