"""Plain Python helpers that run inside tasks on one text or one batch."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
# white space to str.split() that is part of a word here
_ODD = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")

#: Rows of a batch that are worked on at once.
SLICE = 256


def words(text: str) -> list[str]:
    return _WORD.findall(text) if _ODD.search(text) else text.split()


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Smaller batches, so that a few very long texts cannot fill the memory of a worker."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    return [t or "" for t in batch.column(column).to_pylist()]


def mixed(x: np.ndarray) -> np.ndarray:
    """Bijective mixing of 64-bit integers (the splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Bounded(dict):
    """A dict that starts over when it has `most` entries; `make(key)` gives what is missing."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        value = self[key] = self.make(key)
        return value
