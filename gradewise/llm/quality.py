"""Quality rules as weak supervision: rules vote or abstain, expectation-maximisation weighs them, a posterior decides.

Each rule looks at one measure of a text and votes good, bad or not at all; most only know what is bad. The corpus is reduced to the counts
of the vote patterns (at most 3 ** rules of them, whatever its size). EM over these counts estimates, without labels, the share of good
documents and for each rule how often its votes are right. What a rule is taken to know beforehand weighs `BEFORE` times its own votes, at any
size of the corpus. The posterior of a document is a sum of its votes' log odds, a plain column. A document is kept if the base checks don't
fail it and its posterior is at least `KEEP`.

Results in special cases: a null or empty text has no words and fails the base check; rows are scored each on their own, so repeated rows get
the same result; an empty table gives no rows; extra columns pass through or are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradewise.llm.textual import words

KEEP = 0.5
BASE_WORDS, BASE_REPEAT = 50, 50
FIELDS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_ended", "n_upper", "n_distinct", "n_shout", "n_digits",
    "n_runs",
)
MEASURES = T.StructType([T.StructField(f, T.LongType()) for f in FIELDS])


def measures(text: str) -> tuple[int, ...]:
    ws = words(text)
    lines = [x for x in text.split("\n") if words(x)]
    known: dict[str, int] = {}
    ids = np.fromiter([known.setdefault(w, len(known)) for w in ws], np.int64, len(ws))
    return (
        len(ws),
        sum(map(len, ws)),
        sum(text.count(c) for c in "#*$%&|<>"),
        len(lines) - len(set(lines)),
        repeated_words(ids, len(known)),
        len(lines),
        sum(x.rstrip(" \t\r\"')»”").endswith((".", "!", "?", "…", "。", ":", ";")) for x in lines),
        sum(map(str.isupper, ws)),
        len(known),
        text.count("!"),
        sum(text.count(c) for c in "0123456789"),
        sum(text.count(c * 3) for c in "#*$%&|<>=~^_"),
    )


def repeated_words(ids: np.ndarray, distinct: int, width: int = 3) -> int:
    """How many words lie in a window of `width` words that stands twice or more."""
    n = len(ids) - width + 1
    if n < 2:
        return 0
    code, span = ids[:n], distinct
    for k in range(1, width):
        if span > 2**62 // max(distinct, 1):
            code = np.unique(code, return_inverse=True)[1]
            span = len(ids)
        code, span = code * distinct + ids[k : n + k], span * distinct
    _, where, counts = np.unique(code, return_inverse=True, return_counts=True)
    again = counts[where] > 1
    covered = np.zeros(len(ids), bool)
    for k in range(width):
        covered[k : n + k] |= again
    return int(covered.sum())


@F.pandas_udf(MEASURES)
def _measured(text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([measures(t or "") for t in text], columns=list(FIELDS), dtype="int64")


def _ratio(a: str, b: str):
    return lambda m: F.when(m[b] > 0, m[a] / m[b])


#: (name, accuracy before any data, measure, good from, bad below, bad above). Good: at least `good from`; None: the rule never votes so.
RULES = (
    ("length", 0.55, lambda m: m["n_words"].cast("double"), 100, 50, math.inf),
    ("symbols", 0.97, _ratio("n_symbols", "n_words"), None, 0, 0.15),
    ("symbol runs", 0.95, _ratio("n_runs", "n_words"), None, 0, 0.1),
    ("repeats", 0.97, _ratio("n_repeat_words", "n_words"), None, 0, 0.3),
    ("lines twice", 0.90, _ratio("n_dup_lines", "n_lines"), None, 0, 0.5),
    ("word size", 0.85, _ratio("word_chars", "n_words"), None, 2.5, 14),
    ("capitals", 0.90, _ratio("n_upper", "n_words"), None, 0, 0.5),
    ("variety", 0.85, _ratio("n_distinct", "n_words"), None, 0.05, 1),
    ("shouting", 0.90, _ratio("n_shout", "n_words"), None, 0, 0.25),
    ("sentences", 0.56, _ratio("n_ended", "n_lines"), 0.5, 0.1, 1),
    ("digits", 0.85, _ratio("n_digits", "word_chars"), None, 0, 0.3),
)
#: Share of good documents before any data, and how many times its own votes a rule's accuracy before any data weighs.
GOOD_SHARE, BEFORE = 0.75, 3.0


def with_votes(docs: DataFrame, text: Column) -> DataFrame:
    """`docs` with columns m (measures) and votes: array of 0 (bad), 1 (no vote), 2 (good), in the order of RULES."""
    rows = docs.withColumn("m", _measured(F.coalesce(text.cast("string"), F.lit(""))))

    def vote(value: Column, good: float | None, under: float, over: float) -> Column:
        chosen = F.when(value.isNull(), 1).when((value < under) | (value > over), 0)
        return (chosen if good is None else chosen.when(value >= good, 2)).otherwise(1)

    return rows.withColumn("votes", F.array(*[vote(f(F.col("m")), *limits) for _, _, f, *limits in RULES]))


class Model:
    """Share of good documents and accuracy of each rule."""

    def __init__(self, good: float, accuracy: np.ndarray):
        self.good, self.accuracy = good, accuracy

    def posterior(self, votes: Column) -> Column:
        total = F.lit(math.log(self.good / (1 - self.good)))
        for r, a in enumerate(self.accuracy):
            total = total + (votes[r] - 1) * F.lit(math.log(a / (1 - a)))
        return 1 / (1 + F.exp(-total))


def fit(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 100) -> Model:
    """EM over (votes, count): posteriors of the patterns from the accuracies, accuracies from the posteriors, until nothing moves."""
    before = np.array([a for _, a, *_ in RULES])
    good, accuracy = GOOD_SHARE, before.copy()
    if not patterns:
        return Model(good, accuracy)
    votes = np.array([v for v, _ in patterns]) - 1
    counts = np.array([n for _, n in patterns], float)
    cast = (counts[:, None] * (votes != 0)).sum(0)
    for _ in range(rounds):
        odds = math.log(good / (1 - good)) + votes @ np.log(accuracy / (1 - accuracy))
        post = 1 / (1 + np.exp(-odds))
        right = (counts[:, None] * np.where(votes > 0, post[:, None], np.where(votes < 0, 1 - post[:, None], 0))).sum(0)
        new = (right + (BEFORE * cast + 1) * before) / ((1 + BEFORE) * cast + 1)
        share = ((counts * post).sum() / counts.sum() + BEFORE * GOOD_SHARE) / (1 + BEFORE)
        moved = max(np.abs(new - accuracy).max(), abs(share - good))
        accuracy, good = np.clip(new, 0.5, 0.999), share
        if moved < 1e-10:
            break
    return Model(good, accuracy)


def learned(voted: DataFrame) -> Model:
    """The model of all rows of `voted`; at most 3 ** len(RULES) counts reach the driver."""
    counted = voted.groupBy("votes").agg(F.count(F.lit(1)).alias("n")).collect()
    return fit(sorted((tuple(r["votes"]), r["n"]) for r in counted))


def _verdict(rows: DataFrame, model: Model) -> tuple[Column, Column, Column]:
    m = F.col("m")
    failed = (m["n_words"] < BASE_WORDS) | (100 * m["n_repeat_words"] > BASE_REPEAT * m["n_words"])
    posterior = model.posterior(F.col("votes"))
    return failed, posterior, ~failed & (posterior >= KEEP)


def quality_report(docs: DataFrame) -> DataFrame:
    """Base measures, verdict and posterior of every document."""
    from gradewise.llm.common import stored

    voted = stored(with_votes(docs.select("doc_id", "text"), F.col("text")).drop("text"), "quality-votes")
    failed, posterior, kept = _verdict(voted, learned(voted))
    return voted.select(
        "doc_id",
        *[F.col("m")[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        failed.alias("base_failed"),
        kept.alias("kept"),
        posterior.alias("posterior"),
        F.array_join(F.transform("votes", lambda v: (v - 1).cast("string")), " ").alias("votes"),
    )


def good_documents(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that are kept, all columns as they are. Texts are measured twice rather than shuffled."""
    voted = with_votes(docs.select(F.struct("*").alias("row")), F.col("row.text"))
    kept = _verdict(voted, learned(voted.select("votes")))[2]
    return voted.where(kept).select(*[F.col("row")[c].alias(c) for c in docs.columns])
