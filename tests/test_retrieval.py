import math
import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gradewise.operators import prompts, retrieval, vectors


def corpus_and_questions():
    generator = random.Random(11)
    words = [f"word{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    documents = [(i, " ".join(generator.choices(words, weights, k=generator.randrange(3, 25)))) for i in range(200)]
    questions = [(i, " ".join(generator.choices(words, weights, k=generator.randrange(2, 9)))) for i in range(40)]
    questions += [(100, "absent words only here now ok"), (101, "absent nowhere never ever gone word0 word1"), (102, "zz"), (103, "word0 word1")]
    return documents, questions


def terms(text):
    return {w for w in re.findall(r"[^\W_]+", text.lower()) }


def brute_force(documents, questions, k, n_terms):
    sets = {d: terms(t) for d, t in documents}
    df = {}
    for s in sets.values():
        for w in s:
            df[w] = df.get(w, 0) + 1
    out = set()
    for q, text in questions:
        order = sorted(terms(text), key=lambda w: (df.get(w, 0), w))
        for search, chosen in (("first", order[:n_terms]), ("second", [w for w in order if w in df][:n_terms])):
            scores = {}
            for d, s in sets.items():
                hit = [w for w in chosen if w in s]
                if hit:
                    scores[d] = round(sum(math.log((len(sets) + 1) / df[w]) for w in hit), 6)
            if scores:
                best = sorted(scores, key=lambda d: (-scores[d], d))[:k]
                out |= {(q, d, scores[d], r + 1, search) for r, d in enumerate(best)}
                break
    return out


@pytest.mark.parametrize("common_df", [0, 5, 40, 10_000])
def test_lexical_is_exact_whatever_counts_as_common(spark, common_df):
    documents, questions = corpus_and_questions()
    got = retrieval.retrieve(
        "lexical", spark.createDataFrame(questions, "question_id bigint, input string"),
        spark.createDataFrame(documents, "doc_id bigint, text string"), k=5, common_df=common_df,
    ).select("question_id", "doc_id", "score", "rank", "search")
    want = brute_force(documents, questions, 5, 5)
    assert {tuple(r) for r in got.collect()} == want
    assert any(w[4] == "second" for w in want)


def test_contexts_and_fallback_text(spark):
    documents = [(1, "alpha beta gamma"), (2, "alpha delta")]
    questions = spark.createDataFrame([(7, "alpha gamma?"), (8, "nothing")], "question_id bigint, input string")
    corpus = spark.createDataFrame(documents, "doc_id bigint, text string")
    ranked = retrieval.retrieve("lexical", questions, corpus)
    block = prompts.source_block(F.lit("T"), F.lit("u"), F.col("text"))
    got = {r.question_id: r.context for r in retrieval.contexts(questions, ranked, corpus, block=block).collect()}
    assert got[7] == "Context from search:\nSource: T (u)\nContent: alpha beta gamma\n\nSource: T (u)\nContent: alpha delta"
    assert got[8] == "No relevant articles found in PubMed."
    with pytest.raises(KeyError):
        retrieval.retrieve("web", questions, corpus)


@pytest.mark.parametrize("block,chunk", [(10_000, 10_000), (17, 13)])
def test_vector_is_exact_for_any_grid(spark, block, chunk):
    generator = np.random.default_rng(5)
    vectors = generator.normal(size=(120, 8)).astype(np.float32)
    vectors[50:90] = vectors[50]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id bigint, embedding array<float>")
    got = retrieval.retrieve_vector(
        df.withColumnRenamed("vec_id", "question_id"), df.withColumnRenamed("vec_id", "doc_id"), k=4, exclude_self=True,
        query_block=block, corpus_chunk=chunk,
    )
    exact = vectors.astype(np.float64) @ vectors.astype(np.float64).T
    want = {}
    for q in range(120):
        order = sorted((d for d in range(120) if d != q), key=lambda d: (-round(exact[q, d], 9), d))
        want[q] = [round(exact[q, d], 9) for d in order[:4]]
    rows = got.collect()
    assert len(rows) == 480 and all(r.question_id != r.doc_id for r in rows)
    for q in range(120):
        assert [round(r.score, 9) for r in sorted((r for r in rows if r.question_id == q), key=lambda r: r.rank)] == want[q]


def test_vector_with_text_ids(spark):
    rows = [(f"LitQA2_{i}", [float(i % 5), 1.0]) for i in range(12)] + [("none", None)]
    table = spark.createDataFrame(rows, "id string, embedding array<double>")
    got = retrieval.retrieve_vector(table, table, k=2, question_id="id", doc_id="id", exclude_self=True).collect()
    assert len(got) == 24 and all(r.question_id != r.doc_id for r in got)
    assert {r.doc_id for r in got if r.question_id == "LitQA2_0"} == {"LitQA2_1", "LitQA2_10"}


def test_a_term_in_a_third_of_the_documents_is_spread(spark):
    generator = random.Random(2)
    documents = []
    for i in range(6000):
        words = [f"w{generator.randrange(3000)}" for _ in range(6)] + ["hot"] * (i % 10 < 3) + ["warm"] * (i % 7 == 0)
        documents.append((i, " ".join(words)))
    questions = [(q, f"hot warm w{q} w{q + 1}") for q in range(0, 40, 2)] + [(90, "hot"), (91, "warm hot")]
    asked = spark.createDataFrame(questions, "question_id bigint, input string")
    corpus = spark.createDataFrame(documents, "doc_id bigint, text string").repartition(4)
    got = retrieval.retrieve("lexical", asked, corpus, k=5, common_df=50).select("question_id", "doc_id", "score", "rank", "search")
    assert {tuple(r) for r in got.collect()} == brute_force(documents, questions, 5, 5)
    holders = retrieval.postings(corpus, "doc_id", "text").filter(F.col("term").isin("hot", "warm"))
    sets = spark.createDataFrame([("a", ["hot", "warm"], [1.0, 2.0])], "set_id string, terms array<string>, weights array<double>")
    dealt = retrieval.dealt_sets(holders, sets, 16)
    sizes = sorted(r["count"] for r in dealt.groupBy("_slot").count().collect())
    assert len(sizes) == 16 and sizes[-1] <= 2 * sizes[8]


@pytest.mark.parametrize("block_rows", [1, 4, 4096])
def test_blocks_of_postings_skip_nothing_that_counts(spark, monkeypatch, block_rows):
    monkeypatch.setattr(retrieval, "BLOCK_ROWS", block_rows)
    documents, questions = corpus_and_questions()
    got = retrieval.retrieve_lexical(
        spark.createDataFrame(questions, "question_id bigint, input string"), spark.createDataFrame(documents, "doc_id bigint, text string"), k=3, common_df=0,
    ).select("question_id", "doc_id", "score", "rank", "search")
    assert {tuple(r) for r in got.collect()} == brute_force(documents, questions, 3, 5)


def test_vectors_move_by_shuffle_alone(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    asked = table.select(F.col("vec_id").alias("question_id"), "embedding")
    plan = retrieval.retrieve_vector(asked, table.withColumnRenamed("vec_id", "doc_id"), k=5)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "Cartesian" not in plan and "hashpartitioning" in plan


def test_long_passages_end_a_block(spark):
    """Passages come longest first, and a block is done when none to come can reach its k-th scores."""
    generator = np.random.default_rng(0)
    rows = [(i, (generator.normal(size=6) * (20 if i < 10 else 0.01)).tolist()) for i in range(3000)]
    rows += [(5000, None), (5001, []), (5002, [1.0, 2.0]), (5003, [float("nan")] * 6), (5004, [0.0] * 6)]
    table = spark.createDataFrame(rows, "doc_id bigint, embedding array<double>")
    asked = table.filter("doc_id < 20 OR doc_id >= 5000").withColumnRenamed("doc_id", "question_id")
    got = retrieval.retrieve_vector(asked, table, k=3, corpus_chunk=16).collect()
    finite = [(d, np.array(v)) for d, v in rows if v and len(v) == 6 and not math.isnan(v[0])]
    for q in range(20):
        order = sorted(((-float(v @ np.array(rows[q][1])), d) for d, v in finite))[:3]
        mine = sorted((r.rank, r.doc_id, r.score) for r in got if r.question_id == q)
        assert [d for _, d in order] == [d for _, d, _ in mine]
        assert [-s for s, _ in order] == pytest.approx([s for _, _, s in mine])
    assert {(r.doc_id, r.rank) for r in got if r.question_id == 5002} == {(5002, 1)}
    assert {r.score for r in got if r.question_id == 5004} == {0.0}
    assert not {r.question_id for r in got} & {5000, 5001, 5003}


def share_found(exact, near):
    want = {(r.question_id, r.doc_id) for r in exact.collect()}
    return len(want & {(r.question_id, r.doc_id) for r in near.collect()}) / len(want)


def test_near_recall_on_the_given_vectors(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    asked = table.select(F.col("vec_id").alias("question_id"), "embedding")
    corpus = table.select(F.col("vec_id").alias("doc_id"), "embedding")
    near = retrieval.retrieve("vector_near", asked, corpus, k=5, exclude_self=True)
    assert share_found(retrieval.retrieve_vector(asked, corpus, k=5, exclude_self=True), near) >= 0.9


def test_near_index_is_stored_and_split(spark, tmp_path, monkeypatch):
    """Clusters of unequal length and size, one of them a third of all rows; slots and blocks far smaller than the cells."""
    generator = np.random.default_rng(1)
    centers = generator.normal(size=(30, 12)) * generator.uniform(0.5, 4, size=(30, 1))
    which = np.where(generator.random(4000) < 0.33, 0, generator.integers(0, 30, 4000))
    points = centers[which] + generator.normal(size=(4000, 12)) * 0.1
    corpus = spark.createDataFrame([(f"d{i}", p.tolist()) for i, p in enumerate(points)], "doc_id string, embedding array<double>")
    asked = corpus.filter("doc_id LIKE '%7'").withColumnRenamed("doc_id", "question_id")
    path = str(tmp_path / "index")
    vectors.write_vector_index(corpus, path, cells=32)
    index = vectors.read_vector_index(spark, path)
    assert index.passages.count() == 4000 and len(index.centroids) == 32
    monkeypatch.setattr(vectors, "SLOT_ROWS", 100)
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 20)
    near = retrieval.retrieve_vector_near(asked, corpus, k=5, index=index, probes=8)
    exact = retrieval.retrieve_vector(asked, corpus, k=5)
    assert share_found(exact, near) >= 0.9
    # clustered vectors need few visits
    assert vectors.probes_for(index, 0.95) <= 8 < vectors.probes_for(index, 1.1) == 32
    # with all cells visited nothing is missed
    every = retrieval.retrieve_vector_near(asked, corpus, k=5, index=index, probes=32)
    assert {tuple(r)[:2] for r in every.collect()} == {tuple(r)[:2] for r in exact.collect()}


def grid_rows(points, asked, block_rows=5000):
    """Batches as a task of the grid reads them: questions, then passages."""
    for side, rows in ((0, points[:asked]), (1, points)):
        for at in range(0, len(rows), block_rows):
            part = rows[at : at + block_rows]
            n, width = part.shape
            same = lambda x: pa.array(np.full(n, x, np.int32))
            ids = pa.array(np.arange(at, at + n))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), pa.array(part.ravel()))
            length = pa.array(np.sqrt((part.astype(float) ** 2).sum(axis=1)))
            places = [same(0), same(width), same(0), same(0), same(side), length]
            names = ["_cell", "_width", "_block", "_slot", "_side", "_length", "question_id", "doc_id", "vector"]
            yield pa.RecordBatch.from_arrays([*places, *((ids, pa.nulls(n, pa.int64())) if side == 0 else (pa.nulls(n, pa.int64()), ids)), lists], names=names)


def test_copies_of_vectors_take_no_more_memory():
    """10,000 copies of each of two vectors: only the smallest ids are kept, and what a task holds doesn't grow with the copies."""
    two = np.random.default_rng(4).normal(size=(2, 16)).astype(np.float32)
    points = two[np.arange(20_000) % 2]
    tracemalloc.start()
    got = pa.Table.from_batches(list(vectors._block_searcher(3, True, 8192)(grid_rows(points, 2000)))).to_pylist()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    best = (two.astype(float) @ two.astype(float).T).argmax(axis=1)
    for q in (0, 1, 2, 3, 1998, 1999):
        want = [d for d in range(12) if d % 2 == best[q % 2] and d != q][:3]
        assert [r["doc_id"] for r in got if r["question_id"] == q] == want
    assert len(got) == 6000 and peak < 60e6


def test_copies_in_other_blocks_score_the_same():
    """Equal vectors have equal scores in every task, so that the smaller id wins whatever else is multiplied."""
    generator = np.random.default_rng(6)
    points = generator.normal(size=(700, 64)).astype(np.float32)
    points[350:] = points[:350]
    points[::7] *= 3
    points[350::7] = points[:350:7]
    found = {}
    for asked, rows, chunk in ((350, 5000, 8192), (131, 77, 50), (3, 700, 13)):
        for batch in vectors._block_searcher(4, False, chunk)(grid_rows(points, asked, rows)):
            for r in batch.to_pylist():
                found.setdefault((r["question_id"], r["doc_id"] % 350), set()).add(r["score"])
    assert all(len(scores) == 1 for scores in found.values())


def test_nearest_cells_are_found_in_slices():
    """4,096 cells and a batch of 10,000 vectors: the distances of a slice are held, not those of the batch."""
    generator = np.random.default_rng(7)
    centroids, points = generator.normal(size=(4096, 9)), generator.normal(size=(10_000, 8))
    lists = pa.ListArray.from_arrays(pa.array(np.arange(10_001) * 8, pa.int32()), pa.array(points.ravel()))
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(10_000)), lists], names=["doc_id", "vector"])
    tracemalloc.start()
    got = pa.Table.from_batches(list(vectors._cell_finder(centroids, 9.0, 3, False)(iter([batch]))))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    unit = points * (9.0 / np.linalg.norm(points, axis=1))[:, None]
    order = np.argsort(((centroids[:, :-1][None] - unit[:50, None]) ** 2).sum(axis=2) + centroids[:, -1] ** 2, axis=1)[:, :3]
    assert got["doc_id"].to_pylist() == list(range(10_000)) and got["_cells"].to_pylist()[:50] == order.tolist()
    assert peak < 60e6
