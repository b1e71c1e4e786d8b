"""Toxicity by a factorization machine over hashed terms.

The terms of a text (runs of letters, lower case) are hashed into `BUCKETS` features; a feature is on if one of its terms stands in the whole
text. A document's log odds are b + sum w_i + sum over pairs <v_i, v_j>, so two terms that are harmless alone, such as an insult and the
mention of a group, can weigh more together than their linear weights say. Weights are learned by proximal AdaGrad: the linear part's L1
penalty sets most of them to zero, which keeps neutral words from adding up in long texts. Every term seen in `LEAST_DOCS` labelled documents or
more has factors, whatever it says alone; an L2 penalty holds those that say nothing near zero.

Learning uses at most `SAMPLE` labelled documents, the first by digest of their id, whole texts; scoring covers every document. Results in
special cases: a null or empty text gets the score of no terms; without labels of both kinds the score is their share, or 0 without labels;
several labels of a document count as toxic if one is; a null doc_id has no label and isn't held out; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradewise.llm.common import keyed
from gradewise.llm.textual import Bounded, slices, texts

BUCKETS, FACTORS, SAMPLE, THRESHOLD = 1 << 18, 8, 20_000, 0.3
#: Terms seen in so many documents of the sample have factors.
LEAST_DOCS = 3

_TERM = re.compile(r"[^\W\d_]+")
_HASH = Bounded(lambda t: zlib.crc32(t.encode("utf-8", "surrogatepass")) % BUCKETS, 500_000)


def features(text: str) -> np.ndarray:
    """The features that are on, in order."""
    return np.array(sorted({_HASH[t] for t in set(_TERM.findall(text.lower()))}), np.int32)


class Machine:
    """b, w and v; w and v are zero but for few features."""

    def __init__(self, bias: float, linear: np.ndarray, factors: np.ndarray):
        self.bias, self.linear, self.factors = bias, linear, factors

    def log_odds(self, on: np.ndarray) -> float:
        v = self.factors[on]
        sums = v.sum(0)
        return float(self.bias + self.linear[on].sum() + 0.5 * (sums @ sums - (v * v).sum()))

    def compact(self) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
        used = np.flatnonzero((self.linear != 0) | (self.factors != 0).any(1))
        return self.bias, used, self.linear[used], self.factors[used]

    @classmethod
    def restored(cls, bias: float, used: np.ndarray, linear: np.ndarray, factors: np.ndarray) -> "Machine":
        machine = cls(bias, np.zeros(BUCKETS), np.zeros((BUCKETS, FACTORS)))
        machine.linear[used], machine.factors[used] = linear, factors
        return machine


def fit(rows: list[np.ndarray], labels: np.ndarray, rounds: int = 12, rate: float = 0.3, noise: float = 0.1, l2: float = 1e-4, seed: int = 7) -> Machine:
    """Proximal AdaGrad over batches of documents. The L1 penalty is `noise` / sqrt(documents), the size of a neutral term's mean gradient."""
    linear, factors = np.zeros(BUCKETS), np.zeros((BUCKETS, FACTORS))
    n, positive = len(labels), float(labels.sum()) if len(labels) else 0.0
    if not n:
        return Machine(-50.0, linear, factors)
    share = min(max(positive / n, 1e-9), 1 - 1e-9)
    bias = float(np.log(share / (1 - share)))
    if positive in (0.0, float(n)):
        return Machine(bias, linear, factors)
    random, l1 = np.random.default_rng(seed), noise / np.sqrt(n)
    seen = np.bincount(np.concatenate(rows), minlength=BUCKETS)
    paired = np.flatnonzero(seen >= LEAST_DOCS)
    place = np.full(BUCKETS, -1)
    place[paired] = np.arange(len(paired))
    # the longer the documents, the more pairs add up: factors begin and move on a scale that keeps their sum small
    scale = min(0.05, 1 / np.sqrt(40 * max(1.0, seen.sum() / n)))
    v = random.normal(0, scale, (len(paired), FACTORS))
    grad_w, grad_v, grad_b = np.full(BUCKETS, 1e-2), np.full(v.shape, 1e-2), 1e-2
    size = max(16, min(256, n // 20))
    for _ in range(rounds):
        order = random.permutation(n)
        for at in range(0, n, size):
            batch = order[at : at + size]
            ids = np.concatenate([rows[i] for i in batch])
            doc = np.repeat(np.arange(len(batch)), [len(rows[i]) for i in batch])
            mine = place[ids]
            has = mine >= 0
            pv, pd = mine[has], doc[has]
            mine_v = v[pv]
            sums = np.stack([np.bincount(pd, mine_v[:, k], len(batch)) for k in range(FACTORS)], 1)
            squares = np.bincount(pd, (mine_v**2).sum(1), len(batch))
            odds = bias + np.bincount(doc, linear[ids], len(batch)) + 0.5 * ((sums**2).sum(1) - squares)
            error = (1 / (1 + np.exp(-np.clip(odds, -30, 30))) - labels[batch]) / len(batch)
            used, where = np.unique(ids, return_inverse=True)
            g = np.bincount(where, error[doc])
            grad_w[used] += g * g
            step = rate / np.sqrt(grad_w[used])
            moved = linear[used] - step * g
            linear[used] = np.sign(moved) * np.maximum(np.abs(moved) - step * l1, 0)
            touched, where = np.unique(pv, return_inverse=True)
            each = error[pd, None] * (sums[pd] - mine_v)
            gv = np.stack([np.bincount(where, each[:, k], len(touched)) for k in range(FACTORS)], 1) + l2 * v[touched]
            grad_v[touched] += gv**2
            v[touched] -= 2 * scale * rate * gv / np.sqrt(grad_v[touched])
            gb = error.sum()
            grad_b += gb * gb
            bias -= rate * gb / np.sqrt(grad_b)
    factors[paired] = v
    return Machine(float(bias), linear, factors)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> tuple[list[np.ndarray], np.ndarray]:
    """Features and labels of at most `most` labelled documents that aren't held out: the only rows that reach the driver."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    # at most `most` pairs of numbers
    rows = keyed(docs).join(F.broadcast(chosen), "doc_id").select("doc_id", "toxic", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            on = [features(t) for t in texts(batch)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("toxic"), pa.array(on, pa.list_(pa.int32()))], names=["doc_id", "toxic", "on"]
            )

    schema = T.StructType([rows.schema["doc_id"]]).add("toxic", "integer").add("on", T.ArrayType(T.IntegerType()))
    # several texts under one id: the first by its features
    one = rows.mapInArrow(run, schema).groupBy("doc_id").agg(F.min(F.struct("on", "toxic")).alias("x"))
    table = one.select("doc_id", "x.on", "x.toxic").toArrow().sort_by("doc_id")
    on = [np.asarray(x.values, np.int32) for x in table["on"]]
    return on, np.array(table["toxic"].to_pylist(), float)


def scored(docs: DataFrame, machine: Machine) -> DataFrame:
    """(doc_id, score) of every row of `docs`. The machine's non-zero weights are sent to the tasks once."""
    rows = keyed(docs).select("doc_id", "text")
    sent = docs.sparkSession.sparkContext.broadcast(machine.compact())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Machine.restored(*sent.value)
        for batch in slices(batches):
            out = [1 / (1 + np.exp(-np.clip(machine.log_odds(features(t)), -500, 500))) for t in texts(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.float64())], names=["doc_id", "score"])

    return rows.mapInArrow(run, T.StructType([rows.schema["doc_id"]]).add("score", "double"))


def toxicity_report(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    machine = fit(*sample(docs, labels))
    return scored(docs, machine).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted")
    )
