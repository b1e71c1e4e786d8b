"""Retrieval of passages for questions from a corpus table: by rare terms, and by embedding."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from gradewise import fixed_values as fixed
from gradewise import storage
from gradewise.operators import vectors
from gradewise.operators.prompts import build_context, source_block
from gradewise.operators.sizes import BROADCAST_ROWS, is_small, sent_if

KEY_TERMS = 5
TOP_K = 5
COMMON_DF = 1000
MIN_TERM = 1
#: Documents of a block whose terms bound the scores in it.
BLOCK_ROWS = 256
#: Documents that a task holds at most while it searches them by common terms.
SLOT_DOCS = 1 << 16


def distinct_terms(text: Column, min_term: int = MIN_TERM) -> Column:
    """Distinct lower-case words of letters and digits; `min_term` is the least length that counts, 1 for all."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(rf"[\p{{L}}\p{{N}}]{{{min_term},}}"), F.lit(0)))


def postings(corpus: DataFrame, ident: str, text: str) -> DataFrame:
    """`(doc_id, term)`, one row per distinct term of a document.

    At scale write this once as a table and pass the table to the retrieval functions: they read it several times.
    """
    return corpus.select(F.col(ident).alias("doc_id"), F.explode(distinct_terms(F.col(text))).alias("term"))


def question_terms(questions: DataFrame, ident: str, text: str) -> DataFrame:
    return questions.select(F.col(ident).alias("question_id"), F.explode(distinct_terms(F.col(text))).alias("term"))


def document_frequency(index: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Documents per term, for the terms of the questions only."""
    return index.join(sent_if(vocabulary, is_small(vocabulary)), "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def _rarest(terms: DataFrame, n_terms: int) -> DataFrame:
    order = Window.partitionBy("question_id").orderBy("df", "term")
    return terms.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= n_terms).drop("_r")


def key_terms(terms: DataFrame, frequency: DataFrame, n_terms: int = KEY_TERMS) -> DataFrame:
    """The n rarest terms of each question: `(question_id, term, df)`.

    A term that no document has is the rarest of all, so a question may end up without a hit.
    """
    known = terms.join(frequency, "term", "left").withColumn("df", F.coalesce("df", F.lit(0)).cast("bigint"))
    return _rarest(known, n_terms).select("question_id", "term", "df")


def search_terms(terms: DataFrame, frequency: DataFrame, n_terms: int = KEY_TERMS) -> DataFrame:
    """Terms each question is searched by: `(question_id, term, df, search)`, only terms that documents have.

    The first search uses the n rarest terms. It finds nothing exactly when no document has any of them, which the
    frequencies already tell; then the second search takes the n rarest terms that do occur.
    """
    known = terms.join(frequency, "term", "left").withColumn("df", F.coalesce("df", F.lit(0)).cast("bigint"))
    question = Window.partitionBy("question_id")
    order = question.orderBy("df", "term")
    placed = known.withColumns(
        {
            "_place": F.row_number().over(order),
            "_missing": F.count_if(F.col("df") == 0).over(question),
        }
    )
    is_first = F.col("_missing") < n_terms
    last = F.when(is_first, F.lit(n_terms)).otherwise(F.col("_missing") + n_terms)
    return placed.filter((F.col("df") > 0) & (F.col("_place") <= last)).select(
        "question_id", "term", "df", F.when(is_first, F.lit("first")).otherwise(F.lit("second")).alias("search")
    )


def _set_searcher(k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Best k documents of a slot for each set of weighted terms. Rows come by slot, its documents by id before the sets.

    The documents of a slot are cut into blocks in order of id. Of each term and block it is known whether the term is in the block, so the
    weights of a set's terms that are there bound the score of every document of the block. Blocks are looked at from the highest bound on,
    and skipped once k documents have more, or as much and a smaller id. Defined inside a function so that it travels to the workers by value.
    """
    block_rows, own_columns = BLOCK_ROWS, ["set_id", "doc_id", "score"]

    class Slot:
        def __init__(self, parts: list[pa.RecordBatch]):
            rows = pa.Table.from_batches(parts).combine_chunks()
            self.ids = rows["doc_id"].combine_chunks()
            terms = rows["terms"].combine_chunks()
            coded = terms.flatten().dictionary_encode()
            term, row = np.asarray(coded.indices, np.int64), np.repeat(np.arange(len(self.ids)), np.asarray(terms.value_lengths(), np.int64))
            self.number = {t: i for i, t in enumerate(coded.dictionary.to_pylist())}
            order = np.lexsort((row, term))
            self.rows, self.edges = row[order], np.searchsorted(term[order], np.arange(len(self.number) + 1))
            self.in_block = np.zeros((len(self.number), len(self.ids) // block_rows + 1), bool)
            self.in_block[term, row // block_rows] = True

        def best(self, terms: list[str], weights: list[float]) -> list[tuple[int, float]]:
            here = [(self.number[t], w) for t, w in zip(terms, weights, strict=True) if t in self.number]
            numbers, values = [n for n, _ in here], np.array([w for _, w in here])
            if not numbers:
                return []
            bound = np.round(values @ self.in_block[numbers], 6)
            found: list[tuple[float, int]] = []
            for block in np.lexsort((np.arange(len(bound)), -bound)):
                if bound[block] <= 0 or len(found) == k and (-bound[block], block * block_rows) > found[-1]:
                    break
                first = block * block_rows
                score = np.zeros(block_rows)
                for n, w in here:
                    own = self.rows[self.edges[n] : self.edges[n + 1]]
                    a, b = np.searchsorted(own, (first, first + block_rows))
                    score[own[a:b] - first] += w
                score = np.round(score, 6)
                hit = np.flatnonzero(score)
                hit = hit[np.lexsort((hit, -score[hit]))[:k]]
                found = sorted([*found, *zip(-score[hit], hit + first, strict=True)])[:k]
            return [(int(row), float(-score)) for score, row in found]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, parts, slot = None, [], None
        for batch in batches:
            slots, sides = np.asarray(batch.column("_slot")), np.asarray(batch.column("_side"))
            changes = (np.diff(slots, prepend=slots[:1]) != 0) | (np.diff(sides, prepend=sides[:1]) != 0)
            starts = [0, *np.flatnonzero(changes), batch.num_rows]
            for a, b in zip(starts, starts[1:], strict=False):
                if a == b:
                    continue
                if slots[a] != number:
                    number, parts, slot = slots[a], [], None
                rows = batch.slice(a, b - a)
                if sides[a] == 0:
                    parts.append(rows)
                elif parts:
                    slot = Slot(parts) if slot is None else slot
                    sets, docs, scores = [], [], []
                    for i, (terms, weights) in enumerate(zip(rows.column("terms").to_pylist(), rows.column("weights").to_pylist(), strict=True)):
                        for row, score in slot.best(terms, weights):
                            sets.append(i)
                            docs.append(row)
                            scores.append(score)
                    columns = [rows.column("set_id").take(pa.array(sets, pa.int64())), slot.ids.take(pa.array(docs, pa.int64())), pa.array(scores, pa.float64())]
                    yield pa.RecordBatch.from_arrays(columns, names=own_columns)

    return search


def dealt_sets(holders: DataFrame, sets: DataFrame, slots: int) -> DataFrame:
    """Documents with their terms, and every set of weighted terms once for each slot, by slot. No key of the shuffle is a term."""
    documents = holders.groupBy("doc_id").agg(F.collect_set("term").alias("terms"))  # at most the searched terms
    left = documents.select(
        F.pmod(F.xxhash64("doc_id"), F.lit(slots)).cast("int").alias("_slot"), F.lit(0).alias("_side"), F.lit(None).cast("string").alias("set_id"),
        "doc_id", "terms", F.lit(None).cast("array<double>").alias("weights"),
    )
    right = sets.select(
        F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("_slot"), F.lit(1).alias("_side"), "set_id",
        F.lit(None).cast(holders.schema["doc_id"].dataType).alias("doc_id"), "terms", "weights",
    )
    return left.unionByName(right).repartition(slots, "_slot").sortWithinPartitions("_slot", "_side", "doc_id", "set_id")


def _set_name() -> Column:
    return F.sha2(F.to_json("_set"), 256)


def best_of_sets(holders: DataFrame, common: DataFrame, k: int, slots: int) -> DataFrame:
    """Candidates for matches on common terms: `(question_id, doc_id)`, the best k documents by the common terms of each question.

    Any other document has k documents before it already by these terms, so it can only win by rare ones, which propose all their documents.
    Questions with the same common terms share one search. `holders` has the postings of the common terms, `common` is `(question_id,
    term, df, weight)`.
    """
    entries = F.sort_array(F.collect_set(F.struct("df", "term", "weight")))
    asked = common.groupBy("question_id").agg(entries.alias("_set"))
    sets = asked.select("_set").distinct().select(
        _set_name().alias("set_id"), F.col("_set.term").alias("terms"), F.col("_set.weight").alias("weights")
    )
    kind = StructType([StructField("set_id", StringType()), holders.schema["doc_id"], StructField("score", DoubleType())])
    found = dealt_sets(holders, sets, slots).mapInArrow(_set_searcher(k), kind)
    first = Window.partitionBy("set_id").orderBy(F.col("score").desc(), "doc_id")
    best = found.withColumn("_r", F.row_number().over(first)).filter(F.col("_r") <= k)
    return asked.select("question_id", _set_name().alias("set_id")).join(best, "set_id").select("question_id", "doc_id")


def rank_by_terms(
    index: DataFrame,
    keys: DataFrame,
    n_docs: Column,
    k: int = TOP_K,
    common_df: int = COMMON_DF,
    small: bool = False,
    slots: int | None = None,
) -> DataFrame:
    """Best k documents per question by the summed rarity of its terms: `(question_id, doc_id, score, rank)`.

    `keys` is `(question_id, term, df)`. Ties go to the smaller id. Terms in at most `common_df` documents propose
    all their documents; commoner terms only propose the best k by them, so the candidates per question are bounded
    although no document is ruled out. `small` says that `keys` has been checked to fit a broadcast.
    `slots` says into how many parts the documents with common terms are dealt; a task holds one part.
    """
    slots = slots or max(1, int(index.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keys = keys.withColumn("weight", F.log((n_docs + 1) / F.col("df")))
    # Only the postings of searched terms are moved, spread by document: a frequent term is on all tasks. The branches
    # below share this one exchange.
    used = index.join(sent_if(keys.select("term").distinct(), small), "term", "left_semi").repartition("doc_id")
    rare = keys.filter(F.col("df") <= common_df)
    common = keys.filter(F.col("df") > common_df)
    holders = used.join(sent_if(common.select("term").distinct(), small), "term", "left_semi")

    rare_hits = used.join(sent_if(rare, small), "term").select("question_id", "doc_id", "weight")
    candidates = rare_hits.select("question_id", "doc_id").unionByName(best_of_sets(holders, common, k, slots)).distinct()
    common_hits = (
        candidates.join(common.select("question_id", "term", "weight"), "question_id")
        .join(holders, ["doc_id", "term"])
        .select("question_id", "doc_id", "weight")
    )
    scored = (
        rare_hits.unionByName(common_hits)
        .groupBy("question_id", "doc_id")
        .agg(F.round(F.sum("weight"), 6).alias("score"))
    )
    best = Window.partitionBy("question_id").orderBy(F.col("score").desc(), "doc_id")
    return scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def retrieve_lexical(
    questions: DataFrame,
    corpus: DataFrame,
    k: int = TOP_K,
    question_id: str = "question_id",
    question_text: str = "input",
    doc_id: str = "doc_id",
    doc_text: str = "text",
    n_terms: int = KEY_TERMS,
    common_df: int = COMMON_DF,
    index: DataFrame | None = None,
) -> DataFrame:
    """Two searches per question: its rarest terms first; where they find nothing, its rarest terms that occur.

    Returns `(question_id, doc_id, score, rank, search)`; a question without any hit has no row. The corpus is read
    twice, once for frequencies and once for the postings of the searched terms.
    """
    index = postings(corpus, doc_id, doc_text) if index is None else index
    terms = question_terms(questions, question_id, question_text)
    frequency = document_frequency(index, terms.select("term").distinct())
    n_docs = corpus.count()
    slots = max(int(corpus.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n_docs // SLOT_DOCS))
    keys = search_terms(terms, frequency, n_terms)
    # n_terms rows per question at most, so the number of questions bounds what is broadcast
    small = is_small(questions, BROADCAST_ROWS // n_terms)
    ranked = rank_by_terms(index, keys.drop("search"), F.lit(n_docs), k, common_df, small, slots)
    return ranked.join(keys.select("question_id", "search").distinct(), "question_id")


def retrieve_vector(
    questions: DataFrame,
    corpus: DataFrame,
    k: int = TOP_K,
    question_id: str = "question_id",
    doc_id: str = "doc_id",
    vector: str = "embedding",
    exclude_self: bool = False,
    query_block: int = vectors.QUERY_BLOCK,
    corpus_chunk: int = vectors.CORPUS_CHUNK,
) -> DataFrame:
    """Exact best k documents per question by dot product: `(question_id, doc_id, score, rank)`, ids as they are given.

    Blocks of at most `query_block` questions and `vectors.BLOCK_BYTES` meet the corpus by shuffle, `corpus_chunk` documents at a time. Rows
    without a vector take no part.
    """
    return vectors.retrieve_exact(questions, corpus, k, question_id, doc_id, vector, exclude_self, query_block, corpus_chunk)


def retrieve_vector_near(
    questions: DataFrame,
    corpus: DataFrame,
    k: int = TOP_K,
    question_id: str = "question_id",
    doc_id: str = "doc_id",
    vector: str = "embedding",
    exclude_self: bool = False,
    probes: int | None = None,
    recall: float = vectors.RECALL,
    index: vectors.VectorIndex | None = None,
) -> DataFrame:
    """Approximate form of `retrieve_vector` for corpora that not every question can be compared with.

    `index` is what `vectors.read_vector_index` reads; without it an index of the corpus is built for this call.
    """
    if index is None:
        path = storage.new_path(corpus.sparkSession, "vector-index")
        vectors.write_vector_index(corpus, path, doc_id, vector)
        index = vectors.read_vector_index(corpus.sparkSession, path)
    return vectors.retrieve_near(questions, index, k, question_id, vector, probes, recall, exclude_self)


RETRIEVERS: dict[str, Callable[..., DataFrame]] = {
    "lexical": retrieve_lexical,
    "vector": retrieve_vector,
    "vector_near": retrieve_vector_near,
}
#: Tools that existing configurations name; all of them search a corpus by terms here.
RETRIEVER_ALIASES = {"tavily": "lexical", "google": "lexical", "pubmed": "lexical", "semantic_scholar": "lexical"}


def retrieve(tool: str, questions: DataFrame, corpus: DataFrame, k: int = TOP_K, **options) -> DataFrame:
    """Retrieval by the name of a registered tool."""
    name = RETRIEVER_ALIASES.get(tool, tool)
    if name not in RETRIEVERS:
        raise KeyError(f"unknown retriever {tool!r}; known: {sorted(RETRIEVERS)}")
    return RETRIEVERS[name](questions, corpus, k=k, **options)


def contexts(
    questions: DataFrame,
    ranked: DataFrame,
    corpus: DataFrame,
    question_id: str = "question_id",
    doc_id: str = "doc_id",
    heading: str = "Context from search:",
    block: Column | None = None,
    empty: str = fixed.NO_ARTICLES,
    k: int = TOP_K,
) -> DataFrame:
    """Context text per question; a question without a hit gets the fixed text.

    `ranked` has at most `k` rows per question. With few questions it is broadcast, so the corpus is filtered where it
    is read and never moved.
    """
    small = is_small(questions, BROADCAST_ROWS // k)
    block = source_block(F.col("title"), F.col("url"), F.col("content")) if block is None else block
    passages = corpus.withColumnRenamed(doc_id, "doc_id").join(sent_if(ranked, small), "doc_id")
    built = build_context(passages, "question_id", heading, block)
    return (
        questions.select(F.col(question_id).alias("question_id"))
        .join(built, "question_id", "left")
        .withColumn("context", F.coalesce("context", F.lit(empty)))
    )
