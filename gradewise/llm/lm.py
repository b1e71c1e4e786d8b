"""LM scoring by cross-entropy difference: how much better a model of good text predicts a document than a model of all text.

Both models are word bigram models with unigram back-off. They share one vocabulary, one order and one smoothing, and background counts are
scaled to the target's size, so losses differ by what was seen alone. Words and bigrams are known by digests of 62 bits, each with a count
of its own, whatever the size of the corpus.

1. Frequent words and bigrams are looked for in a bounded sample and then counted in every row. They only decide how the work is dealt.
2. The bigrams of all documents, each once per document with its counts in it, go as packed blocks to buckets by their word. A bucket meets all
   occurrences of its words and bigrams, so it has their counts over all documents and adds the loss of what it holds up by document; a task
   takes its buckets one after the other and hands on one sum per document. A frequent word is dealt by bigram and a frequent bigram by document,
   with the counts known from before, so no bucket grows with one word or one bigram. A document's own counts are taken out before it is
   scored, so no text is praised for having been counted.
3. The sums of the buckets are added up by document. No table of counts is stored, and each bigram travels once.

For each word the loss under a model is -log P(word | word before); the score of a document is the mean of the per-word differences, target
loss less background loss: the lower, the closer to the target.

Results in special cases: a null or empty text has no words, zero losses and difference 0; without target documents the target model is
uniform; several labels of one document count as good if one is; rows that agree in doc_id and text get the same score; an empty table gives
no rows; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradewise.llm.common import WORD, keyed
from gradewise.llm.textual import Bounded, mixed, slices, texts, words

#: Words that share what the uniform estimate gives.
WORDS = 1 << 17
#: Keys of bigrams lie from 0 to here, of contexts below 0, of words above this and WORDS.
SLOTS = 1 << 62
#: Weight of the unigram estimate in counts of the context, and of the uniform one in counts of all words.
BACK_OFF, UNIFORM = 8.0, 1000.0
#: Words that a task sums before it hands the sums on.
SUMMED = 1_000_000
#: Documents of a chunk; their numbers take two bytes.
DOCS = 60_000
#: Bigrams of documents in a bucket, on average, and documents of the sample that shows which words and bigrams are frequent.
BUCKET, SAMPLE = 1_500_000, 4000
#: Parts for each core, and documents whose sums a task holds before it hands them on.
PARTS, HELD = 4, 2_000_000
#: Labelled ids that are sent to all executors, at most.
SENT_ROWS = 1_000_000

_DIGEST = Bounded(lambda w: xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) % (SLOTS - WORDS - 2) + 1, 500_000)


def slots_of(text: str, slots: int = SLOTS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bigram key, context key, word key) of each word of a text. The first word's context is the text's beginning."""
    ids = np.array([_DIGEST[w] for w in words(text)], np.int64)
    before = np.r_[0, ids[:-1]] if len(ids) else ids
    gram = (mixed(mixed(before.astype(np.uint64)) + ids.astype(np.uint64)) % np.uint64(slots)).astype(np.int64)
    return gram, -1 - before, slots + WORDS + ids


def _batch(names: str, *columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names.split())


def counts(rows: DataFrame) -> DataFrame:
    """(gram, context, word, target, every): summed counts of the bigrams of the rows (text, target)."""
    names = "gram context word target every"

    def summed(found: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        gram, context, word, good = (np.concatenate(x) for x in zip(*found, strict=True))
        gram, first, where, every = np.unique(gram, return_index=True, return_inverse=True, return_counts=True)
        target = np.bincount(where, good, len(gram)).astype(np.int64)
        for k in range(0, len(gram), 100_000):
            at = slice(k, k + 100_000)
            yield _batch(names, gram[at], context[first[at]], word[first[at]], target[at], every[at])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, n = [], 0
        for batch in slices(batches):
            for text, good in zip(texts(batch), batch.column("target").to_pylist(), strict=True):
                gram, context, word = slots_of(text)
                found.append((gram, context, word, np.full(len(gram), good)))
                n += len(gram)
                if n >= SUMMED:
                    yield from summed(found)
                    found, n = [], 0
        if n:
            yield from summed(found)

    one = rows.select("text", "target").mapInArrow(run, ", ".join(f"{c} long" for c in names.split()))
    return one.groupBy("gram", "context", "word").agg(F.sum("target").alias("target"), F.sum("every").alias("every"))


def _chunks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(word ids, document of each, th, target, words and copies of each document) of about `size` words; texts without words are left out."""
    number: dict[tuple[int, bool], int] = {}
    ids: list[np.ndarray] = []
    copies: list[int] = []
    n = 0

    def chunk() -> tuple[np.ndarray, ...]:
        length = np.array([len(x) for x in ids], np.int64)
        th, target = (np.array(x) for x in zip(*number, strict=True))
        return np.concatenate(ids), np.repeat(np.arange(len(ids)), length), th.astype(np.int64), target.astype(bool), length, np.array(copies, np.int64)

    for batch in slices(batches):
        for text, *key in zip(texts(batch), batch.column("th").to_pylist(), batch.column("target").to_pylist(), strict=True):
            at = number.get(tuple(key))
            if at is not None:
                copies[at] += 1
            elif found := words(text):
                number[tuple(key)] = len(ids)
                ids.append(np.array([_DIGEST[w] for w in found], np.int64))
                copies.append(1)
                n += len(found)
            if n >= size or len(ids) >= DOCS:
                yield chunk()
                number, ids, copies, n = {}, [], [], 0
    if ids:
        yield chunk()


def _grams(before: np.ndarray, ids: np.ndarray) -> np.ndarray:
    return (mixed(mixed(before.astype(np.uint64)) + ids.astype(np.uint64)) % np.uint64(SLOTS)).astype(np.int64)


def _before(ids: np.ndarray, doc: np.ndarray) -> np.ndarray:
    out = np.r_[0, ids[:-1]]
    out[np.r_[True, doc[1:] != doc[:-1]]] = 0
    return out


def _packed(values: np.ndarray) -> bytes:
    """Compressed by the planes of its bytes, most of which hold zeros alone."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T)
    return pa.compress(planes.tobytes(), "zstd", asbytes=True)


def _unpacked(column: pa.ChunkedArray, sizes: list[int], kind: type) -> list[np.ndarray]:
    width = np.dtype(kind).itemsize
    planes = (np.frombuffer(pa.decompress(x, n * width, "zstd", asbytes=True), np.uint8) for x, n in zip(column.to_pylist(), sizes, strict=True))
    return [np.ascontiguousarray(x.reshape(width, -1).T).reshape(-1).view(kind) for x in planes]


class Frequent:
    """Counts (target, every) of words, of documents that they end, and of bigrams, by sorted key; and those of all words and documents."""

    def __init__(self, found: dict[str, dict[int, tuple[int, int]]]):
        self.keys = {what: np.array(sorted(x), np.int64) for what, x in found.items()}
        self.counts = {what: np.array([x[k] for k in sorted(x)], np.float64).reshape(-1, 2) for what, x in found.items()}
        self.words, self.documents = (self.counts["all"][k] if len(self.counts["all"]) else np.zeros(2) for k in (0, -1))

    def where(self, what: str, keys: np.ndarray) -> np.ndarray:
        """Number of the key in the list, or -1."""
        known = self.keys[what]
        at = np.searchsorted(known, keys) if len(known) else np.zeros(len(keys), np.int64)
        return np.where(known[np.minimum(at, len(known) - 1)] == keys, at, -1) if len(known) else at - 1


def frequent(rows: DataFrame, bucket: int) -> Frequent:
    """The words and bigrams that would take more than a quarter of a bucket, by a sample, with exact counts over all rows."""
    share = max(1, rows.count() // SAMPLE)
    sample = counts(rows.where(F.pmod(F.xxhash64("doc_id", "th"), F.lit(share)) == 0))
    most = max(bucket / 4 / share, 8)
    listed = {}
    for what in ("word", "gram"):
        often = sample.groupBy(what).agg(F.sum("every").alias("n"), F.max("word").alias("own")).where(F.col("n") >= most)
        listed[what] = often.select(what, "own").collect()
    # a frequent bigram's word is frequent
    single = np.array(sorted({r.own - SLOTS - WORDS for what in listed for r in listed[what]}), np.int64)
    pairs = np.array(sorted(r.gram for r in listed["gram"]), np.int64)
    names = ("word", "end", "gram", "all")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros((len(single), 2), np.int64), np.zeros((len(single), 2), np.int64), np.zeros((len(pairs), 2), np.int64), np.zeros((2, 2), np.int64)]
        for ids, doc, _, target, length, copies in _chunks(batches, SUMMED):
            weight = np.stack([copies * target, copies], axis=1)
            ends = np.cumsum(length) - 1
            for total, known, keys, of in (
                (sums[0], single, ids, doc),
                (sums[1], single, ids[ends], np.arange(len(ends))),
                (sums[2], pairs, _grams(_before(ids, doc), ids) if len(pairs) else ids[:0], doc if len(pairs) else doc[:0]),
            ):
                if len(known):
                    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                    hit = known[at] == keys
                    np.add.at(total, at[hit], weight[of[hit]])
            sums[3] += np.stack([(weight * length[:, None]).sum(axis=0), weight.sum(axis=0)])
        for what, (keys, total) in enumerate(zip((single, single, pairs, np.arange(2)), sums, strict=True)):
            if len(keys):
                yield _batch("what key target every", np.full(len(keys), what), keys, total[:, 0], total[:, 1])

    parts = rows.select("th", "text", "target").mapInArrow(run, "what long, key long, target long, every long")
    found: dict[str, dict[int, tuple[int, int]]] = {what: {} for what in names}
    for r in parts.groupBy("what", "key").agg(F.sum("target").alias("target"), F.sum("every").alias("every")).collect():
        found[names[r.what]][r.key] = (r.target, r.every)
    return Frequent(found)


def blocks(rows: DataFrame, known: Frequent, buckets: int) -> DataFrame:
    """The distinct bigrams of every document, packed by bucket: words and the bigrams of each, contexts, documents, counts; and the documents."""
    names = "bucket n_words n_contexts n_grams n_docs words sizes contexts context docs times own th target length copies"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, doc, th, target, length, copies in _chunks(batches, SUMMED):
            before, last = _before(ids, doc), ids[np.cumsum(length) - 1]
            final = np.zeros(len(ids), bool)
            final[np.cumsum(length) - 1] = True
            # documents ascend, and the sort is stable: equal bigrams of a document are neighbours
            order = np.lexsort((before, ids))
            word, context, of, final = ids[order], before[order], doc[order], final[order]
            new_word = np.r_[True, word[1:] != word[:-1]]
            first = np.flatnonzero(new_word | np.r_[True, (context[1:] != context[:-1]) | (of[1:] != of[:-1])])
            times = np.diff(np.r_[first, len(word)])
            final = np.logical_or.reduceat(final, first)
            word, context, of = word[first], context[first], of[first]
            # how often the word stands in the document
            number = (np.cumsum(new_word) - 1)[first] * len(th) + of
            _, where = np.unique(number, return_inverse=True)
            own = np.bincount(where, times).astype(np.int32)[where]
            times = (times << 2 | final | (last[of] == word) << 1).astype(np.int32)
            deal = mixed(word)
            often = np.flatnonzero(known.where("word", word) >= 0)
            if len(often):
                gram = _grams(context[often], word[often])
                alone = known.where("gram", gram) < 0
                deal[often] = np.where(alone, mixed(gram), mixed(th[of[often]] ^ gram))
            bucket = (deal % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            cuts = np.flatnonzero(np.r_[True, np.diff(bucket[order]) != 0, True])
            for a, b in zip(cuts, cuts[1:], strict=False):
                at = order[a:b]
                heads = np.flatnonzero(np.r_[True, np.diff(word[at]) != 0])
                used, local = np.unique(of[at], return_inverse=True)
                contexts, before_ = np.unique(context[at], return_inverse=True)
                numbers = (bucket[at[0]], len(heads), len(contexts), len(at), len(used))
                columns = (
                    word[at][heads],
                    np.diff(np.r_[heads, len(at)]).astype(np.int32),
                    contexts,
                    before_.astype(np.int32),
                    local.astype(np.uint16),
                    times[at],
                    own[at],
                    th[used],
                    target[used],
                    length[used].astype(np.int32),
                    copies[used].astype(np.int32),
                )
                arrays = [pa.array([int(x)], pa.int32()) for x in numbers] + [pa.array([_packed(x)], pa.binary()) for x in columns]
                yield pa.RecordBatch.from_arrays(arrays, names.split())

    schema = ", ".join(f"{c} {'int' if k < 5 else 'binary'}" for k, c in enumerate(names.split()))
    return rows.select("th", "text", "target").mapInArrow(run, schema)


def with_target(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, th, text, target): whether a document is labelled good."""
    good = labels.where("quality > 0").select("doc_id").where(F.col("doc_id").isNotNull()).distinct().withColumn("_good", F.lit(True))
    if good.count() <= SENT_ROWS:
        good = F.broadcast(good)  # beyond it both sides are shuffled, with their texts
    rows = keyed(docs).join(good, "doc_id", "left")
    return rows.select("doc_id", "th", "text", F.coalesce("_good", F.lit(False)).alias("target"))


def losses(rows: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(th, target, target_loss, background_loss): mean losses of every text of the rows (doc_id, th, text, target) that has words.

    `bucket`: bigrams of documents that a bucket holds on average.
    """
    known = frequent(rows, bucket)
    # buckets of a part are met by one task in turn, so a document has a sum for each part, however many buckets there are
    parts = PARTS * rows.sparkSession.sparkContext.defaultParallelism
    buckets = max(parts, -(-int(known.words[1]) // bucket))
    # background counts weigh as those of a sample of the target's size, so smoothing takes as much from both
    match = known.words[0] / known.words[1] if known.words[0] else 1.0

    def one_bucket(table: pa.Table) -> tuple[np.ndarray, ...]:
        n_words, n_contexts, n_grams, n_docs = (table[f"n_{x}"].to_pylist() for x in ("words", "contexts", "grams", "docs"))

        def column(name: str, sizes: list[int], kind: type) -> np.ndarray:
            return np.concatenate(_unpacked(table[name], sizes, kind))

        def numbers(name: str, kind: type, of: list[int]) -> np.ndarray:
            """Numbers in a block as numbers in the bucket."""
            return column(name, n_grams, kind) + np.repeat(np.cumsum([0, *of[:-1]]), n_grams)

        th, target, length, copies = (column(c, n_docs, k) for c, k in (("th", np.int64), ("target", bool), ("length", np.int32), ("copies", np.int32)))
        word = np.repeat(column("words", n_words, np.int64), column("sizes", n_words, np.int32))
        context = column("contexts", n_contexts, np.int64)[numbers("context", np.int32, n_contexts)]
        doc, times, own = numbers("docs", np.uint16, n_docs), column("times", n_grams, np.int32), column("own", n_grams, np.int32)
        final, ends, g = times & 1, times >> 1 & 1, (times >> 2).astype(np.float64)
        words_, of_word = np.unique(word, return_inverse=True)
        grams, of_gram = np.unique(_grams(context, word), return_inverse=True)
        places = {"word": (known.where("word", words_), of_word, g), "end": (known.where("end", words_), of_word, final), "gram": (known.where("gram", grams), of_gram, g)}
        sums = []
        for which, scale in ((0, 1.0), (1, match)):
            weight = (copies if which else copies * target)[doc]
            n = {}
            for what, (at, inverse, times_) in places.items():
                n[what] = np.bincount(inverse, times_ * weight, len(at))
                n[what][at >= 0] = known.counts[what][at[at >= 0], which]
            mine = 1.0 if which else target[doc].astype(np.float64)
            total = (known.words[which] - (1.0 if which else target) * length) * scale + UNIFORM
            w = n["word"][of_word]
            single = ((w - mine * own) * scale + UNIFORM / WORDS) / total[doc]
            loss = -np.log((n["gram"][of_gram] - mine * g) * scale + single * BACK_OFF) * g
            # what the word gives as a context, and the beginning of the text
            loss += np.log((w - n["end"][of_word] - mine * (own - ends)) * scale + BACK_OFF) * (g - final)
            loss += np.where(context == 0, np.log((known.documents[which] - mine) * scale + BACK_OFF), 0.0)
            sums.append(np.bincount(doc, loss, len(th)))
        return th, target, np.stack([*sums, np.bincount(doc, g, len(th))], axis=1)

    def summed(found: list[tuple[np.ndarray, ...]]) -> list[tuple[np.ndarray, ...]]:
        """One row for each document."""
        th, target, sums = (np.concatenate(x) for x in zip(*found, strict=True))
        out = []
        for kind in (False, True):
            docs, where = np.unique(th[target == kind], return_inverse=True)
            added = np.stack([np.bincount(where, x, len(docs)) for x in sums[target == kind].T], axis=1)
            out.append((docs, np.full(len(docs), kind), added))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = "th target target_sum background_sum n"
        held: list[pa.RecordBatch] = []
        found: list[tuple[np.ndarray, ...]] = []

        def met() -> None:
            nonlocal held, found
            found.append(one_bucket(pa.Table.from_batches(held)))
            held = []
            if sum(len(x[0]) for x in found) > HELD:
                found = summed(found)

        def rows_of() -> Iterator[pa.RecordBatch]:
            for th, target, sums in summed(found):
                for k in range(0, len(th), 100_000):
                    yield _batch(names, *(x[k : k + 100_000] for x in (th, target, *np.ascontiguousarray(sums.T))))

        for batch in batches:
            number = batch.column("bucket").to_numpy()
            cuts = np.flatnonzero(np.r_[True, number[1:] != number[:-1], True]).tolist() if len(number) else []
            for a, b in zip(cuts, cuts[1:], strict=False):
                if held and held[0].column("bucket")[0].as_py() != number[a]:
                    met()
                    if sum(len(x[0]) for x in found) > HELD:
                        yield from rows_of()
                        found = []
                held.append(batch.slice(a, b - a))
        if held:
            met()
        if found:
            yield from rows_of()

    dealt = blocks(rows, known, buckets).repartitionById(parts, F.col("bucket") % parts).sortWithinPartitions("bucket")
    sums = dealt.mapInArrow(run, "th long, target boolean, target_sum double, background_sum double, n double")
    mean = [(F.sum(f"{x}_sum") / F.sum("n")).alias(f"{x}_loss") for x in ("target", "background")]
    return sums.groupBy("th", "target").agg(*mean)


def difference_report(docs: DataFrame, labels: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, n_words, target_loss, background_loss, difference) of every row of `docs`."""
    rows = with_target(docs, labels)
    lost = losses(rows, bucket).withColumnsRenamed({"th": "_th", "target": "_target"})
    short = rows.select("doc_id", "th", "target", F.regexp_count("text", F.lit(WORD)).cast("long").alias("n_words"))
    both = short.join(lost, (F.col("th") == F.col("_th")) & (F.col("target") == F.col("_target")), "left")
    good, every = (F.coalesce(c, F.lit(0.0)) for c in ("target_loss", "background_loss"))
    return both.select("doc_id", "n_words", good.alias("target_loss"), every.alias("background_loss"), (good - every).alias("difference"))
