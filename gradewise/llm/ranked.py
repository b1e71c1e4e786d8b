"""Ranked lexical search for a table of items over all documents, exact, by a dual tree.

One pass over the texts stores a forward index: each document's length and the counts of its terms, of those terms only that some item may
have (a bitmap of fixed size tells). Its rows give the corpus statistics and are dealt to slots of bounded size; each slot meets the items in
blocks of bounded size, both by shuffle. In a task, documents of a slot and items of a block are each put in an order that brings likes
together, and into a hierarchy whose nodes hold the largest value of every coordinate (term) below them: of the term's share in a document,
and of its weight in an item. The sum of products bounds every score between two nodes, so a pair of nodes is left out, with all pairs of
documents and items under it, when its bound is under the weakest k-th score of the node's items; what remains is scored in integers,
batches of the highest bounds first. One slot in `SCOUTS` is searched first, and the k-th scores reached there are the floors of the others.

Results in special cases: a null text, or one without a term, counts nowhere; a text of any length is counted piece by piece; repeated rows
are documents each, all listed; a missing doc_id comes after all others of its score; items that agree in id and text are one, items with one
id and different texts are ranked apart; an item without a term that a document has gives no rows, nor does an empty table; only doc_id and
text, item_id and text are read, so other columns can't clash.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gradewise.llm.common import stored
from gradewise.llm.textual import Bounded, slices

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Slots of the bitmap of item terms (2 MB), and bytes of a text that are split into terms at once.
BITS, PIECE = 1 << 24, 1 << 20
#: Documents of a slot; items and their terms in a block, as long as it has more than one item.
SLOT_DOCS, BLOCK_ITEMS, BLOCK_TERMS = 8192, 1024, 16384
#: Documents and items of a leaf at least, children of a node, and numbers in the matrix of a slot's leaves.
LEAF_DOCS, LEAF_ITEMS, CHILDREN, CELLS = 32, 4, 4, 1 << 22
SCOUTS = 8

# separators become blanks; bytes of other characters than ASCII are always part of a term
_TABLE = bytes(b if b >= 128 else ord(chr(b).lower()) if chr(b).isalnum() else 32 for b in range(256))


def counted(text: bytes) -> tuple[int, Counter]:
    """Number of terms and occurrences of each."""
    text, n, counts, at = text.translate(_TABLE), 0, Counter(), 0
    while at < len(text):
        end = text.find(b" ", at + PIECE)
        terms = text[at : end if end >= 0 else len(text)].split()
        n += len(terms)
        counts.update(terms)
        at = end if end >= 0 else len(text)
    return n, counts


def _index_rows(bitmap) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = bitmap.value

        def has_bit(term: bytes) -> bool:
            slot = zlib.crc32(term) % BITS
            return bool(bits[slot >> 3] >> (slot & 7) & 1)

        wanted = Bounded(has_bit, 1 << 20)
        for batch in slices(batches):
            sizes, edges, terms, counts = [], [0], [], []
            for text in batch.column("text").cast(pa.binary()).to_pylist():
                n, own = counted(text)
                kept = [t for t in own if wanted[t]]
                sizes.append(n)
                terms += kept
                counts += [own[t] for t in kept]
                edges.append(len(terms))
            at = pa.array(edges, pa.int32())
            words = pa.array(terms, pa.binary()).cast(pa.string())
            lists = [pa.ListArray.from_arrays(at, words), pa.ListArray.from_arrays(at, pa.array(counts, pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), *lists], names=["doc_id", "n", "terms", "counts"])

    return rows


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, item, term): the distinct terms of each item; `item` tells items of one id apart."""
    text = F.translate(F.coalesce(items["text"].cast("string"), F.lit("")), UPPER, LOWER)
    terms = F.array_distinct(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)))
    rows = items.select(items["item_id"].cast("long").alias("item_id"), F.xxhash64(items["text"]).alias("item"), terms.alias("terms"))
    return rows.distinct().select("item_id", "item", F.explode("terms").alias("term"))


def term_bitmap(terms: DataFrame) -> bytes:
    """Bit crc32 % BITS is set for every term; of this size whatever the number of items."""
    slot = F.crc32(F.col("term").cast("binary")) % BITS + 1
    parts = terms.groupBy(F.bitmap_bucket_number(slot).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits"))
    whole = bytearray(BITS // 8)
    for row in parts.toLocalIterator():
        at = (row["bucket"] - 1) * len(row["bits"])
        whole[at : at + len(row["bits"])] = row["bits"]
    return bytes(whole)


def forward_index(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(doc_id, n, terms, counts, row): a stored table with a row for each document that has a term."""
    bitmap = docs.sparkSession.sparkContext.broadcast(term_bitmap(terms))
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).where("text IS NOT NULL")
    rows = texts.mapInArrow(_index_rows(bitmap), "doc_id long, n long, terms array<string>, counts array<long>").where("n > 0")
    return stored(rows.withColumn("row", F.monotonically_increasing_id()), "forward-index")


class Slot:
    """Documents of a slot, and the hierarchy over them for one block of items at a time."""

    def __init__(self, docs: int, total: int):
        self.docs, self.total, self.parts = docs, total, []

    def add(self, rows: pa.RecordBatch) -> None:
        self.parts.append(rows)

    def close(self) -> None:
        """Shares of all terms in their documents."""
        rows = pa.Table.from_batches(self.parts).combine_chunks().to_batches()[0]
        self.no_id = np.asarray(rows.column("id").is_null())
        self.ids = rows.column("id").fill_null(0).to_numpy(zero_copy_only=False)
        terms = rows.column("terms")
        coded = terms.flatten().dictionary_encode()
        self.words, self.term = coded.dictionary, np.asarray(coded.indices, np.int64)
        self.doc = np.repeat(np.arange(rows.num_rows), np.asarray(terms.value_lengths(), np.int64))
        mass = [50 + 50 * n * self.docs // self.total for n in rows.column("n").to_pylist()]
        count = rows.column("values").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        self.share = 1_000_000_000 * count // (1000 * count + 20 * np.array(mass, np.int64)[self.doc])
        self.parts = []

    def arrange(self, words: pa.Array, largest: np.ndarray) -> np.ndarray:
        """Order the documents and build the nodes over the coordinates `words`; gives each word's column, or -1."""
        place = np.asarray(pc.fill_null(pc.index_in(words, value_set=self.words), -1), np.int64)
        used = place[place >= 0]
        column = np.full(len(self.words), -1)
        column[used] = np.arange(len(used))
        weight = largest[place >= 0]
        kept = column[self.term] >= 0
        doc, col, share = self.doc[kept], column[self.term[kept]], self.share[kept]
        starts = np.flatnonzero(np.diff(doc, prepend=-1))
        shift = max(1, len(used)).bit_length()
        heaviest = np.maximum.reduceat((weight[col] * share << shift) + col, starts) if len(starts) else np.zeros(0, np.int64)
        # documents with the same heaviest term stand together, the highest first
        order = np.lexsort((-(heaviest >> shift), heaviest & ((1 << shift) - 1)))
        self.row_doc = doc[starts][order]
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        row = rank[np.cumsum(np.diff(doc, prepend=-1) > 0) - 1] if len(doc) else doc
        by_row = np.argsort(row, kind="stable")
        self.row, self.col, self.part = row[by_row], col[by_row], share[by_row]
        self.leaf = max(LEAF_DOCS, -(-len(order) * max(1, len(used)) // CELLS))
        leaves = -(-len(order) // self.leaf)
        self.bounds = np.searchsorted(self.row, np.arange(leaves + 1) * self.leaf)
        most = np.zeros((len(used), leaves), np.int64)
        np.maximum.at(most, (self.col, self.row // self.leaf), self.part)
        self.levels = [most]
        while self.levels[-1].shape[1] > 1:
            self.levels.append(np.maximum.reduceat(self.levels[-1], np.arange(0, self.levels[-1].shape[1], CHILDREN), axis=1))
        out = np.full(len(words), -1)
        out[place >= 0] = np.arange(len(used))
        return out


class Block:
    """Items of a block with their best documents so far, and the hierarchy over them."""

    def __init__(self, rows: pa.RecordBatch, k: int):
        self.k, self.rows = k, rows
        terms = rows.column("terms")
        self.edges = np.concatenate([[0], np.cumsum(np.asarray(terms.value_lengths(), np.int64))])
        coded = terms.flatten().dictionary_encode()
        self.words, self.word = coded.dictionary, np.asarray(coded.indices, np.int64)
        self.weight = rows.column("values").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        self.largest = np.zeros(len(self.words), np.int64)
        np.maximum.at(self.largest, self.word, self.weight)
        self.floor = rows.column("n").fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        self.best = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)) for _ in range(rows.num_rows)]
        self.scored = 0

    def search(self, slot: Slot) -> None:
        column = slot.arrange(self.words, self.largest)[self.word]
        own = [(column[a:b], self.weight[a:b]) for a, b in zip(self.edges, self.edges[1:], strict=False)]
        self.own = [(c[c >= 0], w[c >= 0]) for c, w in own]
        level = [([i], *self.own[i]) for i in range(len(own))]
        self.nodes, width = [], LEAF_ITEMS
        while not self.nodes or len(level) > 1:
            level = [self.joined(level[i : i + width]) for i in range(0, len(level), width)]
            self.nodes.append(level)
            width = CHILDREN
        if slot.levels[0].size:
            self.descend(slot, len(self.nodes) - 1, 0, len(slot.levels) - 1, np.zeros(1, np.int64))

    @staticmethod
    def joined(nodes: list[tuple]) -> tuple[list[int], np.ndarray, np.ndarray]:
        """Items, columns and largest weights of a node over `nodes`."""
        columns, at = np.unique(np.concatenate([n[1] for n in nodes]), return_inverse=True)
        weights = np.zeros(len(columns), np.int64)
        np.maximum.at(weights, at, np.concatenate([n[2] for n in nodes]))
        return [i for n in nodes for i in n[0]], columns, weights

    def descend(self, slot: Slot, up: int, at: int, over: int, below: np.ndarray) -> None:
        """Item node `at` of level `up` against the document nodes `below` of level `over`."""
        items, columns, weights = self.nodes[up][at]
        most = slot.levels[over]
        bound = weights @ most[columns][:, below]
        alive = (bound > 0) & (bound >= self.floor[items].min())
        below, bound = below[alive], bound[alive]
        if not len(below):
            return
        if up == 0 and over == 0:
            self.score(slot, items, columns, below, bound)
            return
        if over:
            wide = slot.levels[over - 1].shape[1]
            below = (below[:, None] * CHILDREN + np.arange(CHILDREN)).ravel()
            below = below[below < wide]
        children = range(at * CHILDREN, min(at * CHILDREN + CHILDREN, len(self.nodes[up - 1]))) if up else [at]
        for child in children:
            self.descend(slot, max(0, up - 1), child, max(0, over - 1), below)

    def score(self, slot: Slot, items: list[int], columns: np.ndarray, leaves: np.ndarray, bound: np.ndarray) -> None:
        """Scores of the documents in `leaves`, those of the highest bounds first, while one can still count."""
        order, at, step = np.argsort(-bound, kind="stable"), 0, 4
        inside = np.zeros(len(slot.levels[0]), bool)
        inside[columns] = True
        weight = np.zeros(len(slot.levels[0]), np.int64)
        while at < len(order):
            part = order[at : at + step]
            part = leaves[part[bound[part] >= self.floor[items].min()]]
            if not len(part):
                return
            spots = np.concatenate([np.arange(slot.bounds[x], slot.bounds[x + 1]) for x in part])
            nth = np.repeat(np.arange(len(part)), slot.bounds[part + 1] - slot.bounds[part])
            spots, nth = spots[keep := inside[slot.col[spots]]], nth[keep]
            local = slot.row[spots] + (nth - part[nth]) * slot.leaf
            col, share, room = slot.col[spots], slot.part[spots], len(part) * slot.leaf
            self.scored += room * len(items)
            for i in items:
                own, weights = self.own[i]
                weight[own] = weights
                if int(weights.sum()) * 1_000_000 < 1 << 52:  # exact in doubles
                    total = np.bincount(local, weight[col] * share, room).astype(np.int64)
                else:
                    np.add.at(total := np.zeros(room, np.int64), local, weight[col] * share)
                weight[own] = 0
                hit = np.flatnonzero((total > 0) & (total >= self.floor[i]))
                if len(hit):
                    self.take(i, total[hit], slot, slot.row_doc[part[hit // slot.leaf] * slot.leaf + hit % slot.leaf])
            at, step = at + step, 2 * step

    def take(self, item: int, score: np.ndarray, slot: Slot, docs: np.ndarray) -> None:
        score, ids, no_id = (np.concatenate(x) for x in zip(self.best[item], (score, slot.ids[docs], slot.no_id[docs]), strict=True))
        first = np.lexsort((ids, no_id, -score))[: self.k]
        self.best[item] = score[first], ids[first], no_id[first]
        if len(first) == self.k:
            self.floor[item] = max(self.floor[item], score[first[-1]])

    def found(self) -> pa.RecordBatch:
        sizes = [len(b[0]) for b in self.best]
        score, ids, no_id = (np.concatenate(x) for x in zip(*self.best, strict=True))
        which = pa.array(np.repeat(np.arange(len(sizes)), sizes))
        place = np.concatenate([np.arange(1, n + 1) for n in sizes]).astype(np.int32)
        columns = [self.rows.column("id").take(which), self.rows.column("item").take(which), pa.array(ids, mask=no_id), pa.array(score), pa.array(place)]
        return pa.RecordBatch.from_arrays(columns, names=["item_id", "item", "doc_id", "score", "place"])


def _search(docs: int, total: int, k: int, block_items: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows come by slot, its documents first; so a task holds a slot's documents and one block of items."""

    def blocks(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(rows).combine_chunks().to_batches()[0]
        sizes = np.cumsum(np.asarray(whole.column("terms").value_lengths(), np.int64))
        at = 0
        while at < whole.num_rows:
            room = np.searchsorted(sizes, (sizes[at - 1] if at else 0) + BLOCK_TERMS, "right")
            end = max(at + 1, min(at + block_items, int(room)))
            yield whole.slice(at, end - at)
            at = end

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, slot = None, None
        for batch in batches:
            slots, sides = (np.asarray(batch.column(c)) for c in ("slot", "side"))
            edges = np.flatnonzero(np.diff(slots, prepend=-1) | np.diff(sides, prepend=-1))
            for a, b in zip(edges, [*edges[1:], batch.num_rows], strict=True):
                rows = batch.slice(int(a), int(b - a))
                if slots[a] != number:
                    number, slot = slots[a], Slot(docs, total)
                if not sides[a]:
                    slot.add(rows)
                    continue
                if slot.parts:
                    slot.close()
                elif not hasattr(slot, "ids"):
                    continue
                for part in blocks([rows]):
                    block = Block(part, k)
                    block.search(slot)
                    yield block.found()

    return run


def ranked(docs: DataFrame, items: DataFrame, k: int = 50, slot_docs: int = SLOT_DOCS, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """(item_id, item, rank, doc_id, score): the k documents of the highest scores above 0 for each item, ties by doc_id."""
    spark = docs.sparkSession
    terms = item_terms(items)
    index = forward_index(docs, terms)
    size = index.agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("total"), F.count_if(F.size("terms") > 0).alias("rows")).first()
    n, total, slots = size["n"], size["total"] or 1, max(1, -(-size["rows"] // slot_docs))
    frequency = stored(index.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")), "frequency")
    rarity = F.floor(1000 * F.log(F.lit(2.0 * n + 2) / (2 * F.col("df") + 1))).cast("long")
    weighted = terms.join(frequency, "term").withColumn("w", rarity).groupBy("item_id", "item")
    entries = F.array_sort(F.collect_list(F.struct("term", "w")))
    asked = weighted.agg(entries.alias("e"), F.max(F.struct("w", "term"))["term"].alias("lead")).select(
        "item_id", "item", F.col("e.term").alias("terms"), F.col("e.w").alias("values"), "lead"
    )
    asked = stored(asked, "items")
    rows = index.where(F.size("terms") > 0).select(
        F.pmod(F.xxhash64("row"), F.lit(slots)).cast("int").alias("slot"),
        F.lit(0).alias("side"),
        F.col("doc_id").alias("id"),
        F.lit(0).cast("long").alias("item"),
        "n",
        "terms",
        F.col("counts").alias("values"),
        F.lit("").alias("lead"),
    )

    def searched(mine: list[int], floors: DataFrame | None) -> DataFrame:
        own = asked.withColumn("floor", F.lit(None).cast("long"))
        if floors is not None:
            floors = floors.withColumnsRenamed({"item_id": "_id", "item": "_item"})
            own = asked.join(floors, asked["item_id"].eqNullSafe(F.col("_id")) & (asked["item"] == F.col("_item")), "left")
        step, offsets = (SCOUTS, mine) if len(mine) < SCOUTS else (1, [0])
        here = F.filter(F.sequence(F.lit(0), F.lit(slots - 1)), lambda s: (s % step).isin(offsets))
        copies = own.select(
            F.explode(here).alias("slot"), F.lit(1).alias("side"), F.col("item_id").alias("id"), "item", F.col("floor").alias("n"), "terms", "values", "lead"
        )
        dealt = rows.where((F.col("slot") % step).isin(offsets)).unionByName(copies).repartition("slot")
        dealt = dealt.sortWithinPartitions("slot", "side", "lead", "item", "id")
        kinds = "item_id long, item long, doc_id long, score long, place int"
        return stored(dealt.mapInArrow(_search(n, total, k, block_items), kinds), "found")

    if slots < 2 * SCOUTS:
        found = searched(list(range(SCOUTS)), None)
    else:
        first = searched([0], None)
        floors = first.where(F.col("place") == k).groupBy("item_id", "item").agg(F.max("score").alias("floor"))
        found = first.unionAll(searched(list(range(1, SCOUTS)), floors))
    order = W.partitionBy("item_id", "item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select("item_id", "item", "rank", "doc_id", "score")


def ranked_report(docs: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """(item_id, rank, doc_id, score) of `ranked`."""
    return ranked(docs, items, k).drop("item")


RANKED_SQL = rf"""
WITH d AS (
    SELECT doc_id, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}') AS terms FROM documents WHERE text IS NOT NULL
), sizes AS (SELECT *, len(terms) AS n, row_number() OVER () AS row FROM d WHERE len(terms) > 0),
corpus AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM sizes),
tf AS (SELECT row, doc_id, n, term, count(*) AS tf FROM (SELECT row, doc_id, n, unnest(terms) AS term FROM sizes) GROUP BY ALL),
weights AS (
    SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, corpus GROUP BY term, docs
), items AS (
    SELECT DISTINCT item_id, hash(text) AS item, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}')) AS term FROM benchmark
), scores AS (
    SELECT item_id, item, row, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * docs) // total)))) AS BIGINT) AS score
    FROM items JOIN tf USING (term) JOIN weights USING (term), corpus GROUP BY ALL
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
    SELECT *, row_number() OVER (PARTITION BY item_id, item ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0
) WHERE rank <= 50
"""
