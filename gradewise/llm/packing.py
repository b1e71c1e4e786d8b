"""Packing token sequences: first-fit decreasing over a tournament tree of bin capacities, in randomised groups of documents.

A document becomes its token ids and the end id. Full blocks of `size` ids fill a sequence of their own, so only their checksums travel; the
rest is one item. Items meet in groups of about `GROUP_DOCS` documents, dealt by a keyed digest, so no group grows with the input and no source
or group of copies fills one. Inside a group, items go in falling length to the first bin that still holds them; the tree of largest free capacities finds it in
log(bins) steps. At last the emptiest bins are taken apart to fill the gaps of the others, so a document is cut only if that saves padding.

Results in special cases: a null or empty text is the end id alone; rows that agree in doc_id and text are packed once each; an empty
table gives no rows; extra columns are not read; a text of any length is cut into blocks as needed.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradewise.llm.common import keyed
from gradewise.llm.textual import slices, texts

SIZE, END, GROUP_DOCS = 2048, 1, 1000
#: Gaps below this many ids stay as padding rather than take a sliver of another document.
LEAST_CUT = 16
#: Entries of the cache of encoded words in a worker process.
CACHE = 700_000
#: Words that the tokenizer gets as one text; its time per word rises with longer ones.
CHUNK = 200

# A single space between two characters that aren't space: the tokenizer's own splitting always begins a new piece there.
_APART = re.compile(r"(?<=\S) (?=\S)")
_RUNS = re.compile(r"\s\s\s|\s\s\Z")
_SOLID = re.compile(r"\S+").fullmatch


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Ids of whole texts as packed integers. Words between single spaces are encoded once and remembered."""

    def __init__(self, path: str | None):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path or default_vocabulary())
        # texts with the literal of an added token, which the tokenizer takes out before it splits, are encoded as they are
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added))) if added else re.compile(r"(?!)")
        self.kind = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        # pieces that begin with a space, in the letters of byte-level vocabularies
        self.opens = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.opens[[i for t, i in self.tokenizer.get_vocab().items() if t.startswith("\u0120")]] = True
        self.known: tuple[dict[str, bytes], dict[str, bytes]] = ({}, {})

    def learn(self, units: set[str], inner: bool) -> None:
        known = self.known[inner]
        new = [u for u in units if u not in known]  # a difference of sets would go over all that is known
        if len(known) + len(new) > CACHE:
            known.clear()
            new = list(units)
        if inner:
            # words without space inside are encoded many at a time: the only pieces that begin with a space begin a word
            whole = [u for u in new if _SOLID(u)]
            chunks = [whole[k : k + CHUNK] for k in range(0, len(whole), CHUNK)]
            codes = self.tokenizer.encode_batch_fast(["".join([" " + u for u in c]) for c in chunks], add_special_tokens=False)
            for chunk, code in zip(chunks, codes, strict=True):
                ids = np.array(code.ids, self.kind)
                at = np.flatnonzero(self.opens[ids])
                if len(at) == len(chunk):
                    packed, ends = ids.tobytes(), [*(at * ids.itemsize).tolist(), ids.nbytes]
                    known.update(zip(chunk, [packed[a:b] for a, b in zip(ends, ends[1:], strict=False)], strict=True))
            new = [u for u in new if u not in known]
        codes = self.tokenizer.encode_batch_fast([" " + u for u in new] if inner else new, add_special_tokens=False)
        known.update((u, np.array(c.ids, self.kind).tobytes()) for u, c in zip(new, codes, strict=True))

    def encode(self, many: list[str], end: int) -> list[bytes]:
        literal = {i for i, t in enumerate(many) if self.added.search(t)}
        if literal:
            plain = iter(self.encode([t for i, t in enumerate(many) if i not in literal], end))
            whole = lambda t: np.array([*self.tokenizer.encode(t, add_special_tokens=False).ids, end], self.kind).tobytes()
            return [whole(t) if i in literal else next(plain) for i, t in enumerate(many)]
        parts = [_APART.split(t) if _RUNS.search(t) else t.split(" ") for t in many]
        heads = [p.pop(0) for p in parts]
        self.learn(set(heads), False)
        self.learn(set().union(*parts), True)
        first, inner = self.known[0], self.known[1].__getitem__
        last = np.array([end], self.kind).tobytes()
        return [b"".join([first[h], *map(inner, p), last]) for h, p in zip(heads, parts, strict=True)]


_ENCODERS: dict[str | None, Encoder] = {}


def _encoder(path: str | None) -> Encoder:
    if path not in _ENCODERS:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has the cores
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def token_items(docs: DataFrame, vocabulary: str | None, size: int, end: int, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, ids, ids_crc32, doc_tokens): full blocks and rests of all documents, ids as packed little-endian integers.

    Without `with_ids`, full blocks have no ids but their checksum.
    """
    rows = keyed(docs).select("doc_id", "text")
    schema = T.StructType([rows.schema["doc_id"]]).add("start", "long").add("ids", "binary").add("ids_crc32", "long").add("doc_tokens", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(vocabulary)
        width = np.dtype(encoder.kind).itemsize
        for batch in slices(batches):
            at, start, ids, crc, total = [], [], [], [], []
            for row, code in enumerate(encoder.encode(texts(batch), end)):
                n = len(code) // width
                for s in range(0, n, size):
                    at.append(row)
                    start.append(s)
                    own = code[s * width : (s + size) * width]
                    crc.append(zlib.crc32(np.frombuffer(own, encoder.kind).astype("<u4").tobytes()))
                    ids.append(own if with_ids or len(own) < size * width else None)
                    total.append(n)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(at, pa.int32())),
                    pa.array(start, pa.int64()),
                    pa.array(ids, pa.binary()),
                    pa.array(crc, pa.int64()),
                    pa.array(total, pa.int64()),
                ],
                names=["doc_id", "start", "ids", "ids_crc32", "doc_tokens"],
            )

    return rows.mapInArrow(run, schema)


class Bins:
    """A tournament tree over bins: each node holds the largest free capacity below it."""

    def __init__(self, bins: int, size: int):
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.free = [size] * (2 * self.leaves)

    def first_fit(self, length: int) -> int:
        """Put an item into the first bin that holds it; there is one bin per item, so one does."""
        node, free = 1, self.free
        while node < self.leaves:
            node *= 2
            if free[node] < length:
                node += 1
        free[node] -= length
        leaf = node - self.leaves
        node //= 2
        while node:
            free[node] = max(free[2 * node], free[2 * node + 1])
            node //= 2
        return leaf


def fill_bins(lengths: list[int], size: int, least_cut: int = LEAST_CUT) -> list[list[tuple[int, int, int]]]:
    """Bins of pieces (item, first id in it, length). Items: at most `size` long, in falling length."""
    tree, bins = Bins(len(lengths), size), []
    for item, n in enumerate(lengths):
        where = tree.first_fit(n)
        if where == len(bins):
            bins.append([])
        bins[where].append((item, 0, n))
    used = [sum(p[2] for p in b) for b in bins]
    order = sorted(range(len(bins)), key=lambda b: -used[b])
    to, giving = 0, len(order) - 1
    while to < giving:
        b, donor = order[to], order[giving]
        gap = size - used[b]
        if gap < least_cut:
            to += 1
            continue
        if not bins[donor]:
            giving -= 1
            continue
        item, first, n = bins[donor].pop()
        take = min(gap, n)
        bins[b].append((item, first, take))
        used[b] += take
        used[donor] -= take
        if take < n:
            bins[donor].append((item, first + take, n - take))
    return [b for b in bins if b]


def pack(docs: DataFrame, vocabulary: str | None = None, size: int = SIZE, end: int = END, with_ids: bool = False, seed: int = 0) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and the ids where asked for.

    `vocabulary` is a tokenizer file that all executors can read; by default the installed public one.
    """
    groups = max(1, -(-docs.count() // GROUP_DOCS))
    items = token_items(docs, vocabulary, size, end, with_ids)
    deal = F.xxhash64(F.lit(seed), "doc_id", "start", "ids_crc32", F.spark_partition_id())
    dealt = items.withColumn("grp", F.pmod(deal, F.lit(groups)))
    schema = T.StructType([items.schema["doc_id"]])
    for name in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"):
        schema = schema.add(name, "long")
    if with_ids:
        schema = schema.add("ids", T.ArrayType(T.IntegerType()))

    def one_group(key: tuple, table: pa.Table) -> pa.Table:
        grp, kind = key[0].as_py(), _encoder(vocabulary).kind
        codes = [None if x is None else np.frombuffer(x, kind) for x in table["ids"].to_pylist()]
        starts, totals, crc = (table[c].to_pylist() for c in ("start", "doc_tokens", "ids_crc32"))
        lengths = [size if c is None else len(c) for c in codes]
        order = sorted(range(len(codes)), key=lambda i: (-lengths[i], crc[i], starts[i]))
        full = sum(n == size for n in lengths)  # each a sequence of its own
        bins = [[(k, 0, size)] for k in range(full)]
        bins += [[(full + item, first, n) for item, first, n in b] for b in fill_bins([lengths[i] for i in order[full:]], size)]
        at, rows, ids = [], [], []
        for number, pieces in enumerate(bins):
            offset = 0
            for item, first, n in pieces:
                i = order[item]
                own = codes[i] if n == lengths[i] else codes[i][first : first + n]
                at.append(i)
                check = crc[i] if n == lengths[i] else zlib.crc32(own.astype("<u4").tobytes())
                rows.append((starts[i] + first, n, check, totals[i], number * groups + grp, offset))
                if with_ids:
                    ids.append(own.astype(np.int32))
                offset += n
        columns = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
        arrays = [table["doc_id"].combine_chunks().take(pa.array(at, pa.int32())), *columns]
        if with_ids:
            arrays.append(pa.array(ids, pa.list_(pa.int32())))
        return pa.Table.from_arrays(arrays, names=schema.names)

    return dealt.groupBy("grp").applyInArrow(one_group, schema)


def sequences(pieces: DataFrame, size: int = SIZE, pad: int = 0) -> DataFrame:
    """(sequence_id, ids, n_pad): whole sequences out of pieces with ids. A length that is a power of two stays, others are padded to `size`."""
    ordered = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    rows = pieces.groupBy("sequence_id").agg(F.flatten(F.transform(ordered, lambda x: x["ids"])).alias("ids"))
    n = F.size("ids")
    lack = F.when(n.bitwiseAND(n - 1) == 0, F.lit(0)).otherwise(size - n)
    return rows.select("sequence_id", F.concat("ids", F.array_repeat(F.lit(pad), lack)).alias("ids"), lack.alias("n_pad"))
