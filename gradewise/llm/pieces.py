"""SentencePiece encoding with seeded merge-dropout, and decoding without loss.

A text is cut into units (a run of space marks and the word behind it; no piece reaches over the end of one). Inside a unit, merges of
neighbouring symbols wait in an agenda, best score first, ties to the left. A candidate merge is known by its unit, the place of the unit and
its span, and a keyed digest of these decides whether it is skipped: the same key gives the same pieces on every machine and every retry,
another `seed` gives others. The place is a digest of text and position, so every occurrence of a word has draws of its own; only without
dropout does a worker remember segmentations. Short units go through the agenda together, one merge of each at a time, after which only the
pairs with new neighbours are looked up; long ones have a heap of their own. Characters outside the vocabulary become byte pieces, also the space mark itself where a text holds it, so decoding gives back
every text.

Results in special cases: a null or empty text has no pieces; rows that agree in doc_id and text get the same pieces; an empty table gives no
rows; extra columns are not read. With `dropout` 0 the pieces are those of the SentencePiece library.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradewise.llm.common import keyed
from gradewise.llm.textual import Bounded, mixed, slices, texts

DROPOUT, SEED, CACHE = 0.1, 17, 300_000
SPACE, LITERAL = "▁", "\udfff"  # the mark, and a stand-in for the mark as ordinary text
#: Units of more characters than this have a heap of their own.
LONG = 48
#: Units that go through the agenda together.
TOGETHER = 16384
_UNIT = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_MASK, _MASK_32 = (1 << 64) - 1, (1 << 32) - 1
#: No candidate: behind every entry of an agenda.
_NONE = np.int64(1 << 62)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Vocabulary:
    """Pieces, their merges and their bytes."""

    def __init__(self, path: str | None):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path or default_model())
        n = model.get_piece_size()
        self.byte = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        plain = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
        self.ids = {model.id_to_piece(i): i for i in plain}
        self.score = np.array([model.get_score(i) for i in range(n)])
        self.output: list[bytes] = [b""] * n
        for piece, i in self.ids.items():
            self.output[i] = piece.replace(SPACE, " ").encode()
        for b, i in enumerate(self.byte):
            self.output[i] = bytes([b])
        pairs = {}
        for piece, i in self.ids.items():
            for k in range(1, len(piece)):
                left, right = self.ids.get(piece[:k]), self.ids.get(piece[k:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = i
        self.pair_list = pairs
        # rank 0 is the best score; equal scores share a rank
        self.rank = np.unique(-self.score, return_inverse=True)[1].astype(np.int64)
        # pieces of one character by code point; `none`, behind all ids, is no piece
        self.none = n
        self.of_char = np.full(0x110000, n, np.int32)
        for piece, i in self.ids.items():
            if len(piece) == 1:
                self.of_char[ord(piece)] = i
        # merges by left and right id: each left one has an offset at which its row of right ones meets no other row's
        rows: dict[int, list[int]] = {}
        for pair in pairs:
            rows.setdefault(pair >> 32, []).append(pair & _MASK_32)
        room, draw = 4 * len(pairs) + 1, np.random.default_rng(0)
        self.offset = np.zeros(n + 1, np.int64)
        self.owner, self.merge = np.full(room + n + 1, -1, np.int64), np.full(room + n + 1, _NONE)
        for left, rights in sorted(rows.items(), key=lambda x: -len(x[1])):
            at = np.array(rights, np.int64)
            while (self.owner[at + self.offset[left]] >= 0).any():
                self.offset[left] = draw.integers(room)
            at += self.offset[left]
            to = np.array([pairs[left << 32 | r] for r in rights], np.int64)
            self.owner[at], self.merge[at] = left, self.rank[to] << 38 | to

    def candidate(self, left: np.ndarray, right: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Agenda entries of pairs of ids: rank, start of the left symbol and merged id as one integer; `_NONE` without a merge."""
        at = self.offset[left] + right
        return np.where(self.owner[at] == left, self.merge[at] | start << 32, _NONE)

    def spelled(self, ch: str) -> list[int]:
        return [int(self.byte[b]) for b in (SPACE if ch == LITERAL else ch).encode("utf-8", "surrogatepass")]


_VOCABULARIES: dict[str | None, Vocabulary] = {}


def vocabulary(path: str | None) -> Vocabulary:
    if path not in _VOCABULARIES:
        _VOCABULARIES[path] = Vocabulary(path)
    return _VOCABULARIES[path]


def _skipped(seed: np.ndarray, start: np.ndarray, mid: np.ndarray, end: np.ndarray, dropout: float) -> np.ndarray:
    """Is the merge of [start, mid) and [mid, end) in the unit of this seed skipped?"""
    code = mixed(mixed(seed + start.astype(np.uint64) * _A) + mid.astype(np.uint64) * _B + end.astype(np.uint64) * _C)
    return (code >> np.uint64(11)).astype(float) / 9007199254740992.0 < dropout


def unit_seeds(digests: np.ndarray, places: np.ndarray) -> np.ndarray:
    return mixed(digests + places)


def unit_digest(unit: str, seed: int) -> int:
    return xxhash.xxh64_intdigest(unit.encode("utf-8", "surrogatepass"), seed & _MASK)


def unit_seed(unit: str, place: int, seed: int) -> int:
    return int(unit_seeds(np.array([unit_digest(unit, seed)], np.uint64), np.array([place], np.uint64))[0])


def encode_long(voc: Vocabulary, unit: str, seed: int, dropout: float) -> list[int]:
    """One unit through an agenda on a heap."""
    n = len(unit)
    ids = [voc.ids.get(c, -1) for c in unit]
    after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    heap: list[tuple[int, int, int, int, int]] = []

    def propose(lefts: list[int]) -> None:
        found = []
        for left in lefts:
            right = after[left] if left >= 0 else n
            if right < n and (to := voc.pair_list.get(ids[left] << 32 | ids[right]) if ids[left] >= 0 and ids[right] >= 0 else None) is not None:
                found.append((left, right, end[right], to))
        if found:
            s, m, e = (np.array([x[k] for x in found]) for k in range(3))
            out = _skipped(np.full(len(found), seed, np.uint64), s, m, e, dropout)
            for (left, right, stop, to), gone in zip(found, out, strict=True):
                if not gone:
                    heapq.heappush(heap, (int(voc.rank[to]), left, right, stop, to))

    propose(list(range(n - 1)))
    while heap:
        _, left, right, stop, to = heapq.heappop(heap)
        if ids[left] == -2 or after[left] != right or end[right] != stop or ids[right] == -2:
            continue
        if voc.pair_list.get(ids[left] << 32 | ids[right]) != to:
            continue
        ids[left], end[left], after[left] = to, stop, after[right]
        if after[right] < n:
            before[after[right]] = left
        ids[right] = -2
        propose([x for x in (before[left], left) if x >= 0])
    out: list[int] = []
    for i, x in enumerate(ids):
        if x >= 0:
            out.append(x)
        elif x == -1:
            out += voc.spelled(unit[i])
    return out


def _merged(voc: Vocabulary, ids: np.ndarray, agenda: np.ndarray, seed: np.ndarray, dropout: float) -> None:
    """Merge the symbols of many units in place: a column is a unit, absorbed symbols become -1. `agenda` is used up.

    A row more than the longest unit has holds no piece, so what lies before the first and behind the last symbol is there. In each round every
    unit takes the best candidate off its agenda: its draw skips it for good, or it is merged and the two new neighbours are candidates.
    """
    rows, width = ids.shape
    flat = ids.reshape(-1)
    end = np.repeat(np.arange(1, rows + 1), width)
    before = np.repeat(np.arange(-1, rows - 1), width)
    units = np.arange(width)
    while True:
        best = agenda.min(axis=0)
        at = np.flatnonzero(best != _NONE)
        if not len(at):
            return
        best = best[at]
        if 4 * len(at) < 3 * len(units):  # units that are done leave
            agenda, units = np.take(agenda, at, axis=1), units[at]
            at = np.arange(len(at))
        line, wide = agenda.reshape(-1), agenda.shape[1]
        left, own = best >> 32 & 63, units[at]
        spot = left * width + own
        right = end[spot]
        stop = end[right * width + own]
        line[left * wide + at] = _NONE
        if dropout > 0:
            kept = np.flatnonzero(~_skipped(seed[own], left, right, stop, dropout))
            best, at, left, own, spot, right, stop = (x[kept] for x in (best, at, left, own, spot, right, stop))
        to = best & _MASK_32
        flat[spot], end[spot] = to, stop
        flat[right * width + own] = -1
        line[right * wide + at] = _NONE
        after = stop * width + own
        before[after] = left
        line[left * wide + at] = voc.candidate(to, flat[after], left)
        ahead = before[spot] % rows
        line[ahead * wide + at] = voc.candidate(flat[ahead * width + own], to, ahead)


def encode_units(voc: Vocabulary, units: list[str], which: np.ndarray, seeds: np.ndarray, dropout: float) -> tuple[np.ndarray, np.ndarray]:
    """(ids, ends): the pieces of units[which[i]] with seeds[i], one after the other, and where each one's end.

    Units of at most `LONG` characters go through the agenda together, those of like length at once; what an occurrence starts with is made once
    for each of `units`.
    """
    size = np.array([len(u) for u in units], np.int64)
    points = voc.of_char[np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32)].astype(np.int64)
    base = np.cumsum(size) - size
    start = np.arange(len(points)) - np.repeat(base, size)
    first = np.full(len(points), _NONE)
    first[:-1] = voc.candidate(points[:-1], points[1:], start[:-1])
    first[base + size - 1] = _NONE  # units are never empty
    sizes = size[which]
    order = np.argsort(sizes.astype(np.int16) if len(size) and size.max() < 1 << 15 else sizes, kind="stable")
    lengths, done = sizes[order], 0
    counts, found = np.zeros(len(which), np.int64), []
    short = int(np.searchsorted(lengths, LONG, "right"))
    while done < short:
        ends = min(done + TOGETHER, short, int(np.searchsorted(lengths, lengths[done] * 3 // 2 + 2, "right")))
        at, done = order[done:ends], ends
        own = which[at]
        row = np.arange(lengths[ends - 1] + 1)[:, None]
        inside = row < sizes[at]
        cell = np.where(inside, base[own] + row, 0)
        ids = np.where(inside, points[cell], voc.none)
        _merged(voc, ids, np.where(inside, first[cell], _NONE), seeds[at], dropout)
        left = (ids >= 0) & inside
        odd = (left & (ids == voc.none)).any(axis=0)
        for k in np.flatnonzero(odd).tolist():
            parts = [voc.spelled(c) if i == voc.none else [i] for c, i in zip(units[own[k]], ids[:, k].tolist(), strict=False) if i >= 0]
            found.append((at[k : k + 1], np.array([x for p in parts for x in p], np.int32)))
            counts[at[k]] = len(found[-1][1])
        if odd.any():
            at, ids, left = at[~odd], ids[:, ~odd], left[:, ~odd]
        counts[at] = left.sum(axis=0)
        found.append((at, ids.T[left.T].astype(np.int32)))
    for i in order[short:].tolist():
        found.append((np.array([i]), np.array(encode_long(voc, units[which[i]], int(seeds[i]), dropout), np.int32)))
        counts[i] = len(found[-1][1])
    ends = np.cumsum(counts)
    out = np.zeros(int(counts.sum()), np.int32)
    for at, ids in found:
        n = counts[at]
        out[np.repeat(ends[at] - np.cumsum(n), n) + np.arange(len(ids))] = ids
    return out, ends


def encode_short(voc: Vocabulary, units: list[str], seeds: list[int] | np.ndarray, dropout: float) -> list[bytes]:
    """Each unit's ids as packed 32-bit integers."""
    ids, ends = encode_units(voc, units, np.arange(len(units)), np.array(seeds, np.uint64), dropout)
    return [x.tobytes() for x in np.split(ids, ends[:-1])] if units else []


class Encoder:
    """Pieces of whole texts; remembers up to `CACHE` digests of words, and their pieces only if nothing is dropped."""

    def __init__(self, voc: Vocabulary, dropout: float, seed: int):
        self.voc, self.dropout, self.seed = voc, dropout, seed
        self.digest = Bounded(lambda u: unit_digest(SPACE + u, seed), CACHE)
        self.known: dict[str, bytes] = {}

    def units(self, text: str) -> list[str]:
        """The units of a text, each without its first space mark."""
        text = text.replace(SPACE, LITERAL)
        if "  " in text or text[:1] == " " or text[-1:] == " ":
            return [u[1:] for u in _UNIT.findall(SPACE + text.replace(" ", SPACE))]
        return text.split(" ") if text else []

    def encode(self, many: list[str], keys: list[int]) -> list[np.ndarray]:
        cut = [self.units(t) for t in many]
        if self.dropout > 0:
            number: dict[str, int] = {}
            which = np.array([number.setdefault(u, len(number)) for units in cut for u in units], np.int64)
            digests = np.array([self.digest[u] for u in number], np.uint64)
            sizes = np.array([len(units) for units in cut], np.int64)
            ends = np.cumsum(sizes)
            place = (np.arange(len(which)) - np.repeat(ends - sizes, sizes)).astype(np.uint64)
            text = np.repeat(mixed(np.array([k & _MASK for k in keys], np.uint64)), sizes)
            seeds = unit_seeds(digests[which], mixed(place + text))
            # texts meet in one call, since most have few units
            ids, behind = encode_units(self.voc, [SPACE + u for u in number], which, seeds, self.dropout)
            return np.split(ids, np.r_[0, behind][ends[:-1]]) if many else []
        if len(self.known) > CACHE:
            self.known.clear()
        new = list({u for units in cut for u in units} - self.known.keys())
        self.known.update(zip(new, encode_short(self.voc, [SPACE + u for u in new], np.zeros(len(new), np.uint64), 0.0), strict=True))
        return [np.frombuffer(b"".join([self.known[u] for u in units]), np.int32) for units in cut]


def decode(voc: Vocabulary, ids) -> str:
    return b"".join([voc.output[i] for i in ids]).decode("utf-8", "surrogatepass")[1:]


_ENCODERS: dict[tuple, Encoder] = {}


def encoded(docs: DataFrame, model: str | None = None, dropout: float = DROPOUT, seed: int = SEED) -> DataFrame:
    """(doc_id, n_pieces, ids, lossless): pieces of every text, and whether decoding them gave the text back.

    `model` is a model file that all executors can read; by default the installed public one.
    """
    rows = keyed(docs)
    schema = T.StructType([rows.schema["doc_id"]]).add("n_pieces", "long").add("ids", T.ArrayType(T.IntegerType())).add("lossless", "boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = vocabulary(model)
        encoder = _ENCODERS.setdefault((model, dropout, seed), Encoder(voc, dropout, seed))
        for batch in slices(batches, 64):
            many = texts(batch)
            ids = encoder.encode(many, batch.column("th").to_pylist())
            good = [decode(voc, x.tolist()) == t for x, t in zip(ids, many, strict=True)]
            ends = np.cumsum([0, *map(len, ids)])
            values = pa.array(np.concatenate([*ids, np.zeros(0, np.int32)]), pa.int32())
            arrays = [batch.column("doc_id"), pa.array([len(x) for x in ids], pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values), pa.array(good)]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return rows.mapInArrow(run, schema)


def decoded(rows: DataFrame, column: str = "ids", model: str | None = None) -> DataFrame:
    """`rows` with a column `text` out of piece ids; null ids give a null text."""

    @F.pandas_udf(T.StringType())
    def to_text(ids):
        voc = vocabulary(model)
        return ids.map(lambda x: None if x is None else decode(voc, x))

    return rows.withColumn("text", to_text(F.col(column)))
