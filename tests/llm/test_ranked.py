"""Ranked search against a plain scan of all pairs."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gradewise.llm import ranked

TERM = re.compile(ranked.TERM)
LOW = str.maketrans(ranked.UPPER, ranked.LOWER)


def terms(text):
    return TERM.findall((text or "").translate(LOW))


def brute(docs, items, k):
    counts = [(d, Counter(terms(t))) for d, t in docs if terms(t)]
    n_docs, total = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in set(items):
        scores = []
        for d, c in counts:
            m = 100 - 50 + 50 * sum(c.values()) * n_docs // total
            score = 0
            for t in set(terms(text)):
                if t in c:
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m))
            if score > 0:
                scores.append((-score, d is None, d or 0))
        out += [(item, r + 1, None if none else d, -s) for r, (s, none, d) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def got(docs, items, **how):
    rows = ranked.ranked(docs, items, **how).select("item_id", "rank", "doc_id", "score").collect()
    return sorted((tuple(r) for r in rows), key=str)


def test_given_rows(spark, given):
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    pairs = [[tuple(r) for r in given.select("doc_id", "text").collect()], [tuple(r) for r in items.select("item_id", "text").collect()]]
    want = brute(*pairs, 50)
    assert got(given, items) == want
    assert ranked.ranked_report(given, items).columns == ["item_id", "rank", "doc_id", "score"]
    # many slots, so that one in eight is searched first; small blocks; the same rows
    assert got(given, items, slot_docs=10, block_items=7) == want
    assert got(given, items, k=3, slot_docs=6) == brute(*pairs, 3)


def test_odd_rows(spark, odd, none):
    asked = [(1, "one TWO twelve eleven"), (1, "one TWO twelve eleven"), (1, "漢字 double"), (2, None), (3, "absent"), (None, "text hi of"), (4, "")]
    items = spark.createDataFrame([(*a, "x", 1) for a in asked], "item_id long, text string, term string, n long")
    docs = [tuple(r) for r in odd.select("doc_id", "text").collect()]
    for how in ({}, {"k": 2, "slot_docs": 1}):
        assert got(odd, items, **how) == brute(docs, asked, how.get("k", 50))
    assert got(none, items) == [] and got(odd, items.limit(0)) == []


@pytest.mark.parametrize("text", ["a" * 50 + " " + "B c1-d" * 1000, "é.É x\x00y\x7fz_w", " ", "", "\u0085a b c", "🙂a🙂 b"])
def test_terms_of_pieces(text, monkeypatch):
    monkeypatch.setattr(ranked, "PIECE", 7)
    n, counts = ranked.counted(text.encode())
    assert n == len(terms(text)) and {k.decode(): v for k, v in counts.items()} == Counter(terms(text))


def batch(rows):
    return pa.RecordBatch.from_pylist(
        [{"id": i, "item": 0, "n": n, "terms": list(t), "values": list(t.values())} for i, n, t in rows],
        schema=pa.schema([("id", pa.int64()), ("item", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.string())), ("values", pa.list_(pa.int64()))]),
    )


def test_bounds_prune_batches():
    """Groups of documents about one subject each: most batches are ruled out by the bounds of their nodes, and nothing is lost."""
    rng = random.Random(5)
    docs = []
    for i in range(4000):
        words = [f"s{i % 40}w{rng.randrange(20)}" for _ in range(15)] + [f"common{rng.randrange(5)}" for _ in range(15)]
        docs.append((i, 30, Counter(words)))
    items = []
    for i in range(16):
        items.append((i, None, {f"s{i}w{j}": 5000 + j for j in range(0, 20, 3)} | {"common1": 10, "nowhere": 9000}))
    slot = ranked.Slot(4000, 120_000)
    for at in range(0, 4000, 900):
        slot.add(batch(docs[at : at + 900]))
    slot.close()
    block = ranked.Block(batch(items), 10)
    block.search(slot)
    rows = block.found().to_pylist()
    share = lambda tf: 10**9 * tf // (1000 * tf + 20 * 100)
    for i, _, own in items:
        scores = sorted((-sum(w * share(c[t]) for t, w in own.items() if t in c), d) for d, _, c in docs)
        assert [(-r["score"], r["doc_id"]) for r in rows if r["item_id"] == i] == scores[:10]
    assert block.scored < 0.15 * 4000 * len(items)


def test_bitmap_has_every_term(spark):
    words = [(f"w{i}",) for i in range(500)]
    bits = ranked.term_bitmap(spark.createDataFrame(words, "term string"))
    assert len(bits) == ranked.BITS // 8
    import zlib

    slots = {zlib.crc32(w.encode()) % ranked.BITS for (w,) in words}
    assert slots == set(np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little")))


def test_term_pattern_is_read_alike(spark):
    text = "AÄ b_cİd 1.5ė x{y}z~\x7f!\u0080 @[`"
    items = spark.createDataFrame([(1, text)], "item_id long, text string")
    assert {r.term for r in ranked.item_terms(items).select(F.col("term")).collect()} == set(terms(text))
