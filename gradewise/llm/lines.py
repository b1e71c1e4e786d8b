"""Line dedup by winnowing over line hashes.

A run is a stretch of consecutive lines with words that holds at least `min_words` words. Where the same run stands at an earlier place
(order: doc_id, text digest, line), its later copies are deleted.

1. Windows. At each line begins the shortest window of at least `min_words` words, and at each line one ends. Every run, extended as
   far as it matches both ways, is exactly the union of the windows inside it.
2. Winnowing. The smallest line hash of each window is its fingerprint. A repeated window repeats its fingerprint, so only windows of
   fingerprints that stand at two places or more go on.
3. Positions meet. The windows at these positions are grouped by content (two 64-bit hashes); the earliest place of each is kept as one
   row, never a list of all places or pairs of them.
4. Extension. Later places join their earliest one; the union of a document's later windows are its repeated runs, at full length.

Results in special cases: null text stays null and holds no lines; lines without a word belong to no run but go with a run that spans
them; rows that agree in doc_id and text are one document; a run that repeats inside a text keeps its first place; a null doc_id sorts
first; an empty table gives no rows; clashing extra columns pass through untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradewise.llm.common import WORD, keyed, let, stored, unpacked, whole_rows, with_rows

MIN_WORDS = 50


def _window_length(words: Column) -> Column:
    """How many of the leading elements reach the sum held in the first struct field `goal`; 0 if they never do."""
    begin = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("n"))
    reach = F.aggregate(
        words["w"],
        begin,
        lambda a, x: F.when(a["sum"] >= words["goal"], a).otherwise(
            F.struct((a["sum"] + x).alias("sum"), (a["n"] + 1).alias("n"))
        ),
    )
    return let(reach, lambda a: F.when(a["sum"] >= words["goal"], a["n"]).otherwise(0))


def windows(docs: DataFrame, min_words: int) -> DataFrame:
    """(doc_id, th, n_lines, win): shortest windows of every text as structs (fp, p, s, e, k1, k2):
    fingerprint and its line, first and last line, content."""
    rows = keyed(docs)
    lines = F.transform(
        F.split("text", "\n", -1),
        lambda x, i: F.struct(
            i.alias("i"), F.regexp_count(x, F.lit(WORD)).alias("w"), F.xxhash64(x).alias("a"), F.xxhash64(x, F.lit(7)).alias("b")
        ),
    )
    full = F.filter(lines, lambda x: x["w"] > 0)
    columns = lambda v: F.struct(
        F.transform(v, lambda x: x["i"]).alias("i"),
        F.transform(v, lambda x: x["w"]).alias("w"),
        F.transform(v, lambda x: x["a"]).alias("a"),
        F.transform(v, lambda x: x["b"]).alias("b"),
        F.aggregate(v, F.lit(0), lambda t, x: t + x["w"]).alias("total"),
        F.size(v).alias("n"),
    )

    def window(c: Column, start: Column, n: Column) -> Column:
        a = F.slice(c["a"], start + 1, n)
        return F.struct(
            F.array_min(a).alias("fp"),
            F.get(c["i"], start + F.array_position(a, F.array_min(a)).cast("int") - 1).alias("p"),
            F.get(c["i"], start).alias("s"),
            F.get(c["i"], start + n - 1).alias("e"),
            F.xxhash64(a).alias("k1"),
            F.xxhash64(F.slice(c["b"], start + 1, n)).alias("k2"),
        )

    def forward(c: Column, p: Column) -> Column:
        ahead = F.struct(F.slice(c["w"], p + 1, F.lit(min_words)).alias("w"), F.lit(min_words).alias("goal"))
        return let(let(ahead, _window_length), lambda n: F.when(n > 0, window(c, p, n)))

    def backward(c: Column, p: Column) -> Column:
        first = F.greatest(p - min_words + 1, F.lit(0))
        behind = F.struct(F.reverse(F.slice(c["w"], first + 1, p - first + 1)).alias("w"), F.lit(min_words).alias("goal"))
        return let(let(behind, _window_length), lambda n: F.when(n > 0, window(c, p - n + 1, n)))

    def both(c: Column) -> Column:
        places = F.sequence(F.lit(0), c["n"] - 1)
        each = F.concat(F.transform(places, lambda p: forward(c, p)), F.transform(places, lambda p: backward(c, p)))
        return F.array_distinct(F.filter(each, lambda x: x.isNotNull()))

    # a text of fewer words than a run has no window
    win = let(let(full, columns), lambda c: F.when(c["total"] >= min_words, both(c)))
    return rows.select("doc_id", "th", F.size(full).cast("long").alias("n_lines"), win.alias("win"))


def repeated_lines(wins: DataFrame) -> DataFrame:
    """(doc_id, th, gone): the raw line numbers in later copies of runs, for documents that have any."""
    points = F.array_distinct(F.transform("win", lambda x: F.struct(x["fp"].alias("fp"), x["p"].alias("p"))))
    again = wins.select(F.explode(points).alias("x")).groupBy("x.fp").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    place = wins.select("doc_id", "th", F.explode("win").alias("x")).select("doc_id", "th", "x.*")
    place = place.join(again, "fp", "left_semi")
    where = F.struct("doc_id", "th", "s")
    first = place.groupBy("k1", "k2").agg(F.min(where).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    later = place.join(first, ["k1", "k2"]).where(where != F.col("first"))
    spans = later.groupBy("doc_id", "th").agg(F.collect_set(F.struct("s", "e")).alias("runs"))
    gone = F.array_distinct(F.flatten(F.transform("runs", lambda r: F.sequence(r["s"], r["e"]))))
    return spans.select("doc_id", "th", gone.alias("gone"))


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Every row of `docs` as struct `row`, with `text` less its repeated runs, `n_lines` with words and `n_deleted` raw lines."""
    wins = stored(windows(docs, min_words), "line-windows")
    gone = repeated_lines(wins.where(F.size("win") > 0))
    both = with_rows(whole_rows(docs), gone).withColumn("text", F.col("row.text"))
    lines = F.split("text", "\n", -1)

    def rest(lines: Column) -> Column:
        kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone"))
        return F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n")

    words = F.size(F.filter(lines, lambda x: F.regexp_count(x, F.lit(WORD)) > 0)).cast("long")
    return both.select(
        "row",
        "doc_id",
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(let(lines, rest)).alias("text"),
        F.coalesce(words, F.lit(0)).alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_deleted"),
    )


def line_report(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    return dedup_lines(docs, min_words).select("doc_id", "n_lines", "n_deleted", "text")


def without_repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """`docs` with shorter texts, all columns kept; a document of which no word is left goes."""
    rows = dedup_lines(docs, min_words)
    left = (F.col("n_deleted") == 0) | F.col("text").rlike(WORD)
    return unpacked(rows.where(left), docs.columns, F.col("text"))


#: The same rows in DuckDB: a line goes if a stretch of at least 50 words around it stands at an earlier place.
LINES_SQL = r"""
WITH raw AS (
    SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), line AS (
    SELECT doc_id, i - 1 AS i, ls[i] AS l, len(regexp_extract_all(ls[i], '[^\x20\x09-\x0D]+')) AS w
    FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM raw)
), numbered AS (
    SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS p,
        sum(w) OVER (PARTITION BY doc_id ORDER BY i) AS c
    FROM line WHERE w > 0
), reach AS (
    SELECT a.doc_id, a.p AS p, b.p AS q, row_number() OVER (PARTITION BY a.doc_id, a.p ORDER BY b.p) AS ahead,
        row_number() OVER (PARTITION BY a.doc_id, b.p ORDER BY a.p DESC) AS behind, a.i AS s, b.i AS e
    FROM numbered a JOIN numbered b ON a.doc_id = b.doc_id AND b.p BETWEEN a.p AND a.p + 49
    WHERE b.c - a.c + a.w >= 50
), win AS (
    SELECT r.doc_id, r.s, r.e, string_agg(n.l, chr(10) ORDER BY n.p) AS body
    FROM (SELECT DISTINCT doc_id, p, q, s, e FROM reach WHERE ahead = 1 OR behind = 1) r
    JOIN numbered n ON n.doc_id = r.doc_id AND n.p BETWEEN r.p AND r.q
    GROUP BY r.doc_id, r.s, r.e
), placed AS (
    SELECT *, row_number() OVER (PARTITION BY body ORDER BY doc_id, s) AS nth FROM win
), gone AS (
    SELECT DISTINCT l.doc_id, l.i FROM placed p JOIN line l ON l.doc_id = p.doc_id AND l.i BETWEEN p.s AND p.e WHERE p.nth > 1
), kept AS (
    SELECT l.doc_id, string_agg(l.l, chr(10) ORDER BY l.i) FILTER (WHERE g.i IS NULL) AS text,
        count(*) FILTER (WHERE l.w > 0) AS n_lines, count(g.i) AS n_deleted
    FROM line l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.i = l.i GROUP BY l.doc_id
)
SELECT r.doc_id, k.n_lines, k.n_deleted, CASE WHEN k.n_deleted = 0 THEN r.text ELSE coalesce(k.text, '') END AS text
FROM raw r JOIN kept k USING (doc_id)
"""
