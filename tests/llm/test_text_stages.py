"""Quality rules, line dedup, near-duplicates, packing and the pipeline against brute force, and on odd rows."""

import collections
import re
import zlib

import corpus_pipeline
import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from gradewise.llm import lines, neardup, packing, quality
from gradewise.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SMALL = "/root/testdata/sf0.001"


def base(t):
    ws = WORD.findall(t)
    grams = collections.Counter(tuple(ws[i : i + 3]) for i in range(len(ws) - 2))
    hit = {i + k for i in range(len(ws) - 2) if grams[tuple(ws[i : i + 3])] > 1 for k in range(3)}
    seen, dup = set(), 0
    for x in t.split("\n"):
        if WORD.search(x):
            dup += x in seen
            seen.add(x)
    return len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in t), dup, len(hit)


def test_quality_base(given, odd):
    for docs in (given, odd.select("doc_id", "text").dropDuplicates()):
        want = collections.Counter((r.doc_id, *base(r.text or "")) for r in docs.collect())
        rows = quality.quality_report(docs).collect()
        assert want == collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows)
        assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) for r in rows)
        assert all(r.kept == (not r.base_failed and r.posterior >= 0.5) for r in rows)


def test_quality_labels(spark):
    rows = quality.quality_report(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    rows = rows.join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").where("not base_failed").collect()
    bad, good = [r.kept for r in rows if r.quality == 0], [r.kept for r in rows if r.quality == 1]
    assert np.mean(bad) < 0.1 and np.mean(good) > 0.99


def test_quality_fit_recovers_accuracies():
    random, n = np.random.default_rng(3), 20_000
    truth = random.random(n) < 0.7
    votes = np.ones((n, len(quality.RULES)), int)
    for r in range(len(quality.RULES)):
        right = random.random(n) < 0.85
        votes[:, r] = np.where(random.random(n) < 0.5, 1, np.where(right == truth, 2, 0))
    counted = collections.Counter(map(tuple, votes))
    model = quality.fit(sorted((tuple(map(int, v)), c) for v, c in counted.items()))
    odds = np.log(model.good / (1 - model.good)) + (votes - 1) @ np.log(model.accuracy / (1 - model.accuracy))
    assert ((odds > 0) == truth).mean() > 0.93


def brute_lines(rows, least):
    """Deleted raw lines of each (doc, text): covered by a stretch of `least` words that stands at an earlier place."""
    first, wins = {}, []
    for key in sorted(rows, key=lambda k: (k[0] is not None, k[0] or 0, k[1])):
        ls = [(i, x, len(WORD.findall(x))) for i, x in enumerate(rows[key].split("\n"))]
        ls = [x for x in ls if x[2]]
        for a in range(len(ls)):
            total = 0
            for b in range(a, len(ls)):
                total += ls[b][2]
                if total >= least:
                    body = tuple(x[1] for x in ls[a : b + 1])
                    wins.append((key, ls[a][0], ls[b][0], body, first.setdefault(body, (key, ls[a][0]))))
    gone = collections.defaultdict(set)
    for key, a, b, _, where in wins:
        if where != (key, a):
            gone[key] |= set(range(a, b + 1))
    return gone


def test_lines_brute_force(spark, odd):
    a = [f"line {i} has a few words of its own {i * i}" for i in range(14)]
    made = [
        (10, "\n".join(a[:8])),
        (11, "\n".join(["start here", *a[2:7], "", "end"])),
        (12, "\n".join([*a[5:12], *a[5:12]])),
        (13, "\n".join([a[1], a[9], a[3]])),
        (14, "\n".join(["x"] * 60)),
        (15, None),
        (16, "\n".join(a[:3] + [" "] + a[3:6])),
    ]
    docs = odd.select("doc_id", "text").unionAll(spark.createDataFrame(made, "doc_id long, text string"))
    th = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"), "text").collect()
    want = brute_lines({(r.doc_id, r.th): r.text or "" for r in th if r.doc_id != 6}, 20)
    got = lines.dedup_lines(docs, 20).select("doc_id", F.xxhash64(F.coalesce("row.text", F.lit(""))).alias("th"), "row.text", F.col("text").alias("left"), "n_deleted")
    rows = [r for r in got.collect() if r.doc_id != 6]
    assert len(rows) == docs.count() - 1
    for r in rows:
        gone = want.get((r.doc_id, r.th), set())
        assert r.n_deleted == len(gone), r
        kept = "\n".join(x for i, x in enumerate((r.text or "").split("\n")) if i not in gone)
        assert r.left == (kept if gone else r.text)
    assert sum(len(x) for x in want.values()) > 30


def test_lines_sql(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    want = db.execute(f"SELECT doc_id, n_lines, n_deleted, text FROM ({lines.LINES_SQL}) ORDER BY 1").fetchall()
    assert sorted(map(tuple, lines.line_report(docs).collect())) == want


def classes(rows):
    bags = {}
    for i, t in rows.items():
        ws = WORD.findall(t)
        if ws:
            bags[i] = collections.Counter(tuple(ws[k : k + 5]) for k in range(max(1, len(ws) - 4)))
    name = {i: i for i in rows}

    def root(i):
        while name[i] != i:
            i = name[i]
        return i

    ids = sorted(bags)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            x, y = bags[a], bags[b]
            common = sum((x & y).values())
            if common >= 0.8 * (sum(x.values()) + sum(y.values()) - common) - 1e-9:
                p, q = root(a), root(b)
                name[max(p, q)] = min(p, q)
    return {i: root(i) for i in rows}


def test_near_duplicates_chain(spark, monkeypatch):
    """A chain of edits in which far ends share little, every bucket in slices that meet inside tasks, and clean texts."""
    monkeypatch.setattr(neardup, "CROWD", 1)
    monkeypatch.setattr(neardup, "SLICE_ROWS", 3)
    random = np.random.default_rng(5)
    word = lambda: "".join(random.choice(list("abcdefgh"), 6))
    rows, last = {}, [word() for _ in range(120)]
    for i in range(60):
        rows[i] = " ".join(last)
        last = list(last)
        for _ in range(2):
            last[random.integers(120)] = word()
    for i in range(100, 130):
        rows[i] = " ".join(word() for _ in range(80))
    rows |= {200: rows[100], 201: "a b c", 202: "a b c", 203: "", 204: "", 205: "x " * 40 + "y", 206: "x " * 43 + "y", 207: "x " * 80 + "y"}
    docs = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    want = classes(rows)
    got = {r.doc_id: r for r in neardup.near_duplicate_report(docs).collect()}
    assert {i: r.class_id for i, r in got.items()} == want
    assert all(r.kept == (r.class_id == i) for i, r in got.items())
    assert got[203].kept and got[204].kept and want[205] != want[207]


def test_near_duplicates_tree_of_edits(spark, monkeypatch):
    """Copies of copies with edits, so that similarities lie on both sides of the least: the classes of all pairs, and few rows for many."""
    random = np.random.default_rng(7)
    texts = [[f"w{random.integers(5000)}" for _ in range(120)]]
    for i in range(1, 400):
        text = list(texts[random.integers(max(0, i - 40), i)])
        for _ in range(random.integers(1, 5)):
            text[random.integers(len(text))] = f"e{random.integers(10_000)}"
        texts.append(text)
    rows = {i: " ".join(t) for i, t in enumerate(texts)}
    docs = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    want = classes(rows)
    assert 3 < len(set(want.values())) < 390
    for crowd, slice_rows in ((8, 512), (2, 20)):
        monkeypatch.setattr(neardup, "CROWD", crowd)
        monkeypatch.setattr(neardup, "SLICE_ROWS", slice_rows)
        got = {r.doc_id: r.class_id for r in neardup.near_duplicate_report(docs).collect()}
        # bands miss a pair at the least similarity with probability 3e-5
        assert got == want


def test_forest_joins_what_all_pairs_join():
    random = np.random.default_rng(1)
    base = np.unique(random.integers(0, 1 << 60, 100).astype(np.uint64))
    sets = [np.sort(np.concatenate([base[random.random(len(base)) < 0.9], random.integers(0, 1 << 60, 8).astype(np.uint64)])) for _ in range(60)]
    part, own = random.integers(0, 50, 60), random.integers(0, 2, 60)
    like = lambda i, j: len(np.intersect1d(sets[i], sets[j])) / len(np.union1d(sets[i], sets[j])) >= 0.7

    def components(links):
        label = list(part)
        for i, j in links:
            label = [label[i] if x == label[j] else x for x in label]
        return {frozenset(k for k, x in enumerate(label) if x == y) for y in set(label)}

    for slices in (own, own * 0):
        pairs = [(i, j) for i in range(60) for j in range(i) if like(i, j) and (slices.max() == 0 or slices[i] != slices[j])]
        found = neardup.forest(sets, part, slices, 0.7)
        assert all(like(i, j) for i, j in found) and len(found) < 60 < len(pairs)
        assert components(found) == components(pairs)


def test_signatures_estimate_similarity():
    """Over many slots, the share of equal slots is the weighted Jaccard similarity, for weights of many sizes."""
    random = np.random.default_rng(1)
    keys = np.sort(random.integers(0, 2**63, 60).astype(np.uint64))
    a, b = random.integers(1, 40, 60), random.integers(1, 40, 60)
    sign = neardup.signatures([(keys, a), (keys, b), (keys[:30], a[:30])], 4096)
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert abs((sign[0] == sign[1]).mean() - want) < 0.04
    assert abs((sign[0] == sign[2]).mean() - a[:30].sum() / a.sum()) < 0.04
    assert (neardup.signatures([(keys, b)], 4096)[0] == sign[1]).all()


def test_near_duplicates_odd(odd, none):
    rows = neardup.near_duplicate_report(odd).collect()
    assert len(rows) == odd.count() and sum(r.kept for r in rows if r.doc_id == 4 and r.class_size > 1) == 2
    kept = neardup.one_of_each(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == [1, 2, 3, 4, 4, 6, 7, 8]
    assert neardup.one_of_each(none).count() == 0 and neardup.near_duplicate_report(none).count() == 0


def check_pieces(pieces, ids, size=2048):
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    assert set(by_doc) == set(ids)
    for i, own in by_doc.items():
        at = 0
        for p in sorted(own, key=lambda p: p.start):
            assert p.start == at and p.length > 0 and p.doc_tokens == len(ids[i])
            assert p.ids_crc32 == zlib.crc32(np.array(ids[i][at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids[i])
    for own in by_sequence.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= size
    return sum(p.length for p in pieces) / size / len(by_sequence)


def tokens(docs):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(packing.default_vocabulary())
    return {r.doc_id: [*whole.encode(r.text or "", add_special_tokens=False).ids, 1] for r in docs.collect()}


def test_packing(given, odd, none):
    assert check_pieces(packing.pack(given).collect(), tokens(given)) > 0.97
    rows = odd.where("doc_id is not null and doc_id <> 4")
    check_pieces(packing.pack(rows).collect(), tokens(rows))
    assert packing.pack(odd).agg(F.sum("length")).first()[0] > 0
    assert packing.pack(none).count() == 0
    whole = packing.sequences(packing.pack(rows, with_ids=True))
    for r in whole.collect():
        assert len(r.ids) == 2048 or len(r.ids) & (len(r.ids) - 1) == 0


@pytest.mark.parametrize("text", ["a  b   c\n d \n\n  e\t\tf  ", "   ", "\n\n\n x", "a  b   c", "it's  we'll　x 12 ,,  ..", " a", "a ", "  a  "])
def test_cached_words_are_the_tokenizers_own(text):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(packing.default_vocabulary())
    got = np.frombuffer(packing.Encoder(None).encode([text], 1)[0], "<u2").tolist()
    assert got == [*whole.encode(text, add_special_tokens=False).ids, 1]


def test_full_blocks_travel_without_ids(spark):
    """A document many times longer than a sequence among short ones: its blocks are rows without ids, with or without ids the same pieces."""
    texts = ["word%d and more " % i * (30_000 if i == 3 else 5) for i in range(20)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    items = packing.token_items(docs, None, 2048, 1, False).collect()
    blocks = [r for r in items if r.ids is None]
    assert len(blocks) > 50 and {r.doc_id for r in blocks} == {3}
    assert all(len(r.ids) < 4096 for r in items if r.ids is not None)
    short, whole = (packing.pack(docs, with_ids=w) for w in (False, True))
    columns = [c for c in short.columns if c not in ("sequence_id", "offset")]
    assert check_pieces(short.collect(), tokens(docs)) > 0.97
    assert sorted(map(tuple, short.select(columns).collect())) == sorted(map(tuple, whole.select(columns).collect()))
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in whole.collect())


def test_tournament_tree_is_first_fit():
    random = np.random.default_rng(2)
    lengths = sorted((int(x) for x in random.integers(1, 2049, 500)), reverse=True)
    tree, plain = packing.Bins(len(lengths), 2048), []
    for n in lengths:
        spot = next((b for b, free in enumerate(plain) if free >= n), len(plain))
        if spot == len(plain):
            plain.append(2048)
        plain[spot] -= n
        assert tree.first_fit(n) == spot
    bins = packing.fill_bins(lengths, 2048)
    assert sum(p[2] for b in bins for p in b) == sum(lengths)
    assert len(bins) <= sum(lengths) / 2048 * 1.01 + 1


def test_pipeline(spark, odd, none, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "near duplicates", "secret scans", "packing"]
    for docs in (odd, none):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, str(tmp_path))
            assert out.columns == docs.columns and out.count() <= docs.count()
    assert corpus_pipeline.run(spark, SMALL).count() > 0


def test_pipeline_keeps_clean_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    kept = {r.doc_id: r.text for r in corpus_pipeline.keep_good(spark, docs, SMALL).collect()}
    want = {r.doc_id for r in quality.quality_report(docs).where("kept").collect()}
    assert set(kept) == want
    one = corpus_pipeline.drop_near_duplicates(spark, docs, SMALL)
    name = classes({r.doc_id: r.text or "" for r in docs.collect()})
    assert sorted(r.doc_id for r in one.collect()) == sorted(i for i, c in name.items() if i == c)


def test_queries_are_registered():
    assert [int(re.match(r"op(\d+)_", q)[1]) for q in QUERIES] == list(range(1, 14))


def test_new_words_are_looked_up_one_by_one():
    """What is learnt from a batch depends on its own words, not on all that are known."""

    class Known(dict):
        def keys(self):
            raise AssertionError("goes over all known words")

    encoder = packing.Encoder(None)
    encoder.known = (Known(), Known())
    texts = ["one two two", "", "a  b\tc\n\nd", " three\x1cfour one"]
    want = [[*encoder.tokenizer.encode(t, add_special_tokens=False).ids, 1] for t in texts]
    assert [list(map(int, np.frombuffer(code, encoder.kind))) for code in encoder.encode(texts, 1) + encoder.encode(texts, 1)] == want * 2
