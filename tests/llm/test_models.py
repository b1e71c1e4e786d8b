"""Toxicity, top-k search, LM scoring and pieces against brute force, the library, round trips and held-out rows."""

import math

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from gradewise.llm import lm, pieces, textual, topk, toxicity


def test_toxicity_held_out(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    rows = toxicity.toxicity_report(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    bad, good = rows[rows.toxic == 1].score.to_numpy(), rows[rows.toxic == 0].score.to_numpy()
    assert np.mean([(x > good).mean() + (x == good).mean() / 2 for x in bad]) > 0.95
    assert (bad >= 0.3).mean() > 0.55 and (good >= 0.3).mean() < 0.01


def test_machine_learns_pairs():
    """Two terms that are harmless alone are toxic together: no linear weights can tell."""
    random = np.random.default_rng(0)
    a, b = toxicity.features("insult")[0], toxicity.features("group")[0]
    rows, labels = [], []
    for _ in range(3000):
        has_a, has_b = random.random() < 0.4, random.random() < 0.4
        noise = random.integers(0, toxicity.BUCKETS, 5)
        rows.append(np.unique(np.array([*noise, *[a] * has_a, *[b] * has_b], np.int32)))
        labels.append(float(has_a and has_b))
    machine = toxicity.fit(rows, np.array(labels), rounds=40)
    score = lambda *on: machine.log_odds(np.array(on, int))
    assert score(a, b) > 0 > max(score(a), score(b), score())


def test_toxicity_odd(spark, odd, none):
    labels = spark.createDataFrame([(4, 1), (4, 0), (7, None), (None, 1), (5, 0)], "doc_id long, toxic int")
    rows = toxicity.toxicity_report(odd, labels).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    assert toxicity.toxicity_report(none, labels).count() == 0
    assert all(r.score < 1e-9 for r in toxicity.toxicity_report(odd, labels.limit(0)).collect())


def brute_top(rows, nth, k):
    whole = []
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            whole.append((i, [math.floor(256 * float(np.float32(x))) for x in v]))
    out = []
    for q, v in whole:
        if q % nth == 0:
            scores = [(sum(a * b for a, b in zip(v, w, strict=True)), -c) for c, w in whole if c != q and len(w) == len(v)]
            out += [(q, rank, -c, s) for rank, (s, c) in enumerate(sorted(scores, reverse=True)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("block_bytes", [1 << 26, 2000])
def test_top_k(spark, block_bytes):
    random = np.random.default_rng(4)
    rows = [(i, [float(x) for x in np.float32(random.normal(0, 0.2, 32))]) for i in range(400)]
    rows += [(400, None), (500, [0.5, None]), (450, [float("nan")] * 32), (600, [float("inf")] * 32), (550, [0.1, 0.2]), (551, [0.3, 0.1])]
    rows += [(1000 + i, rows[7][1]) for i in range(9)] + [(700, []), (701, [])]
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<float>, label int, id string")
    whole = topk.integer_vectors(table)
    got = topk.top_k(whole, whole.where("id % 50 = 0"), 5, block_bytes)
    assert sorted(map(tuple, got.collect())) == brute_top(rows, 50, 5)


def test_top_k_huge_and_empty(spark):
    rows = [(0, [1.5e6, -2e6]), (1, [3e6, 1.0]), (2, [-3e6, 2e6]), (50, [2e6, 0.5])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, topk.every_nth(table).collect())) == brute_top([(i, [float(x) for x in v]) for i, v in rows], 50, 5)
    assert topk.every_nth(table.limit(0)).count() == 0


def test_bound_holds():
    random = np.random.default_rng(8)
    q, c = random.normal(0, 50, (40, 50)), random.normal(10, 60, (300, 50))
    exact = q @ c.T
    bounds = [topk.statistics(q, p) @ topk.statistics(c, p).T for p in topk.LEVELS]
    assert all((b >= exact - 1e-6).all() for b in bounds)
    assert (np.diff([b.mean() for b in bounds]) < 0).all()


def test_lm_prefers_the_target(spark):
    good = [(i, f"the quiet river number {i} runs through the green valley to the sea") for i in range(40)]
    bad = [(100 + i, f"buy cheap pills number {i} now click here to win the big prize") for i in range(40)]
    docs = spark.createDataFrame([*good, *bad, (200, "a quiet river runs to the sea"), (201, "click here to buy cheap pills"), (202, None), (203, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(30)] + [(100 + i, 0) for i in range(30)] + [(None, 1)], "doc_id long, quality int")
    got = {r.doc_id: r for r in lm.difference_report(docs, labels).collect()}
    assert len(got) == 84 and got[200].difference < 0 < got[201].difference
    assert max(got[i].difference for i in range(40)) < min(got[100 + i].difference for i in range(40))
    assert got[202].n_words == 0 and got[203].difference == 0


def test_lm_brute_force(given, spark):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    good = {r.doc_id for r in labels.where("quality > 0").collect()}
    rows = {r.doc_id: r.text or "" for r in given.collect()}
    slots, tables = lm.SLOTS, [dict(), dict()]
    for i, t in rows.items():
        for part in lm.slots_of(t, slots):
            for s in part.tolist():
                tables[1][s] = tables[1].get(s, 0) + 1
                if i in good:
                    tables[0][s] = tables[0].get(s, 0) + 1
    total = [sum(n for s, n in t.items() if s > slots + lm.WORDS) for t in tables]

    def loss(i, which):
        table, mine, scale = tables[which], 1 if which or i in good else 0, total[0] / total[1] if which else 1
        spots = list(zip(*(x.tolist() for x in lm.slots_of(rows[i], slots)), strict=True))
        count = lambda k, s: scale * (table.get(s, 0) - mine * sum(x[k] == s for x in spots))
        out = 0.0
        for g, c, w in spots:
            single = (count(2, w) + lm.UNIFORM / lm.WORDS) / (scale * (total[which] - mine * len(spots)) + lm.UNIFORM)
            out -= math.log((count(0, g) + lm.BACK_OFF * single) / (max(count(1, c), count(0, g)) + lm.BACK_OFF))
        return out / len(spots)

    got = {r.doc_id: r for r in lm.difference_report(given, labels).collect()}
    assert len(got) == len(rows)
    for i in [i for i in rows if 0 < got[i].n_words < 200][:25]:
        assert got[i].target_loss == pytest.approx(loss(i, 0)) and got[i].background_loss == pytest.approx(loss(i, 1))


def test_lm_odd(spark, odd, none):
    labels = spark.createDataFrame([(4, 1), (4, 0)], "doc_id long, quality int")
    assert lm.difference_report(odd, labels).count() == odd.count()
    assert lm.difference_report(none, labels).count() == 0
    assert lm.difference_report(odd, labels.limit(0)).where("isnan(difference)").count() == 0


TEXTS = ["", "hello world", "  two  spaces ", "tabs\tand\nlines", "Ünïcödé 漢字 🙂", "a" * 60, "x" * 200 + " the end", "   ", "<0x0A> <s> </s>", "the cat sat on the mat " * 20]


def test_pieces_without_dropout_are_the_librarys(given):
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    encoder = pieces.Encoder(pieces.vocabulary(None), 0.0, 1)
    many = TEXTS + [r.text for r in given.limit(40).collect()]
    for got, want, text in zip(encoder.encode(many, [1] * len(many)), library.encode(many), many, strict=True):
        assert got.tolist() == want, text[:80]


def test_both_agendas_agree():
    voc = pieces.vocabulary(None)
    units = ["▁" + w for w in "internationalisation the unbelievable running_water é漢🙂 aaaaaaaaaaaaaaaa ▁▁▁spaces".split()]
    for dropout in (0.0, 0.1, 0.5, 1.0):
        seeds = [pieces.unit_seed(u, v, 3) for v in range(4) for u in units]
        short = pieces.encode_short(voc, units * 4, seeds, dropout)
        for u, s, got in zip(units * 4, seeds, short, strict=True):
            assert pieces.encode_long(voc, u, s, dropout) == np.frombuffer(got, np.int32).tolist(), (u, dropout)


def test_pieces_round_trip(spark, odd, none, given):
    texts = [*TEXTS, "▁ literal ▁▁ marks ▁", "nul \x00 and \x7f", "é ﬁ"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = pieces.encoded(docs, dropout=0.3)
    assert {r.doc_id: r.text for r in pieces.decoded(rows).collect()} == dict(enumerate(texts))
    for table in (docs, odd, given):
        got = pieces.encoded(table)
        assert got.count() == table.count() and got.where("not lossless or n_pieces <> size(ids)").count() == 0
    assert pieces.encoded(none).count() == 0


def test_dropout_varies_and_repeats(spark):
    docs = spark.createDataFrame([(i, "internationalisation " * 30) for i in range(6)], "doc_id long, text string")
    docs = docs.withColumn("text", F.concat("text", F.col("doc_id").cast("string")))
    one, two, other = (pieces.encoded(docs, seed=s).orderBy("doc_id").collect() for s in (1, 1, 2))
    assert one == two and one != other
    plain = pieces.encoded(docs, dropout=0.0).orderBy("doc_id").collect()
    assert all(len(a.ids) > len(b.ids) for a, b in zip(one, plain, strict=True))


def test_lm_counts_every_bigram(spark):
    """More distinct bigrams than the former table had slots: each keeps a count of its own."""
    n = 1_200_000
    rows = spark.range(0, 200, 1, 4).select(F.concat_ws(" ", F.transform(F.sequence(F.col("id") * (n // 200), (F.col("id") + 1) * (n // 200) - 1), lambda i: F.concat(F.lit("w"), i.cast("string")))).alias("text"), F.lit(False).alias("target"))
    got = lm.counts(rows).agg(F.count("*").alias("n"), F.max("every").alias("most"), F.countDistinct("word").alias("words")).first()
    assert tuple(got) == (n, 1, n)


def test_every_occurrence_has_its_own_draw():
    """More than two segmentations of one word, also inside one text, and other draws in another text."""
    word, encoder = "internationalisation", pieces.Encoder(pieces.vocabulary(None), 0.3, 5)
    one, two = encoder.encode([" ".join([word] * 200)] * 2, [11, 12])
    assert one.tolist() != two.tolist()
    space = {i for p, i in encoder.voc.ids.items() if p.startswith(pieces.SPACE)}
    ways, now = set(), []
    for i in [*one.tolist(), min(space)]:
        if i in space and now:
            ways.add(tuple(now))
            now = []
        now.append(i)
    assert len(ways) > 20


def test_machine_learns_pairs_without_marginal_link():
    """A group term as frequent in clean texts as in toxic ones, of more than a thousand terms with a link of their own."""
    random = np.random.default_rng(1)
    insult, group = toxicity.features("insult")[0], toxicity.features("group")[0]
    linked = 1000 + np.arange(1100)
    rows, labels = [], []
    for k in range(8000):
        toxic = k % 10 == 0
        # alone each says nothing: toxic rows hold both or neither
        if toxic:
            a = b = random.random() < 0.5
        else:
            a = random.random() < 0.5
            b = not a
        rows.append(np.unique(np.array([*random.choice(linked[550:] if toxic else linked[:550], 2), *[insult] * a, *[group] * b], np.int32)))
        labels.append(float(toxic))
    machine = toxicity.fit(rows, np.array(labels))
    assert np.abs(machine.factors[[insult, group]]).sum(1).min() > 0
    mixed = machine.factors[insult] @ machine.factors[group]
    assert mixed > 0.01, mixed


def test_scores_are_sums_over_pairs(spark, given):
    """The score of a document against the plain sum of the weights of its terms and of the products of all pairs of them."""
    random = np.random.default_rng(2)
    docs = given.where("length(text) < 1200").limit(40).unionByName(spark.createDataFrame([(-1, "", "en", "s", 0), (-2, None, "en", "s", 0)], given.schema))
    on = {r.doc_id: toxicity.features(r.text or "") for r in docs.collect()}
    used = np.unique(np.concatenate(list(on.values())))[::2]
    linear, factors = np.zeros(toxicity.BUCKETS), np.zeros((toxicity.BUCKETS, toxicity.FACTORS))
    linear[used] = random.normal(0, 0.05, len(used))
    factors[used] = random.normal(0, 0.05, (len(used), toxicity.FACTORS))
    got = {r.doc_id: r.score for r in toxicity.scored(docs, toxicity.Machine(-1.5, linear, factors)).collect()}
    assert set(got) == set(on) and len(set(got.values())) > 20
    for doc, terms in on.items():
        odds = -1.5 + sum(linear[i] for i in terms)
        for k, i in enumerate(terms):
            for j in terms[:k]:
                odds += float(factors[i] @ factors[j])
        assert got[doc] == pytest.approx(1 / (1 + math.exp(-odds)), rel=1e-9), doc


def test_pieces_look_up_new_neighbours_alone(monkeypatch):
    """Pairs looked up for many occurrences: those of each distinct word once, then two for each merge, not all pairs again in every round."""
    voc, units = pieces.vocabulary(None), ["▁" + w for w in "internationalisation the unbelievable é漢🙂 aaaaaaaaaaaaaaaa".split()]
    which = np.arange(500) % len(units)
    seeds = np.array([pieces.unit_seed(units[k], i, 3) for i, k in enumerate(which)], np.uint64)
    seen, plain = [], pieces.Vocabulary.candidate
    monkeypatch.setattr(pieces.Vocabulary, "candidate", lambda v, left, right, start: (seen.append(len(left)), plain(v, left, right, start))[1])
    ids, ends = pieces.encode_units(voc, units, which, seeds, 0.1)
    for k, seed, got in zip(which, seeds, np.split(ids, ends[:-1]), strict=True):
        assert pieces.encode_long(voc, units[k], int(seed), 0.1) == got.tolist()
    assert sum(seen) <= sum(map(len, units)) + 2 * sum(len(units[k]) for k in which)


def test_lm_small_buckets(given, spark):
    """Words and bigrams that are frequent for the size of a bucket are dealt out, with the same losses; each bigram of a document travels once."""
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    # copies of one text, and one bigram that makes up most of others
    more = spark.createDataFrame([(-1 - i, "same text again") for i in range(30)] + [(-100 - i, f"very often {i} " * 50) for i in range(30)], "doc_id long, text string")
    docs = given.select("doc_id", "text").unionByName(more)
    rows = lm.with_target(docs, labels)
    known = lm.frequent(rows, 500)
    assert len(known.keys["gram"]) and len(known.keys["word"]) > 10 and known.counts["all"][0][1] > 1000
    one, two = ({r.doc_id: r for r in lm.difference_report(docs, labels, b).collect()} for b in (1 << 40, 500))
    assert len(one) == len(two) == docs.count()
    for i, r in one.items():
        assert two[i].target_loss == pytest.approx(r.target_loss) and two[i].background_loss == pytest.approx(r.background_loss)
    words = [textual.words(r.text or "") for r in rows.select("th", "target", "text").distinct().collect()]
    sent = lm.blocks(rows.coalesce(1), known, 7).select(F.sum("n_grams").alias("n")).first().n
    assert sent <= sum(len(set(zip(["", *w], w, strict=False))) for w in words)
