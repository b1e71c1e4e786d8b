"""Secret scans: patterns find candidates, corpus-wide ownership tells copied examples from live-looking credentials.

Every candidate value is reduced to a digest and counted over the whole corpus by distinct owners and distinct repositories. A value
that one owner alone holds in few repositories looks live; a value that many owners or many repositories hold is an example out of some
manual; what lies between is neither. Base matches always stay and
are marked; free-standing tokens (no keyword beside them) are added as spans only where ownership says that they look live.

Results in special cases: a null or empty text has no spans; rows that agree in doc_id and text get the same result; null owners and
repositories count as one owner of their own each; an empty table gives no rows; other columns of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradewise.llm.common import count_kind, found, keyed, let, overlaps, span_text, stored, unpacked, whole_rows, with_rows

KINDS = ("assign", "access", "hex", "token")
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_MIN, ACCESS_MIN, HEX_MIN, TOKEN_MIN = 12, 18, 16, 20
# the matches of these two are whole runs, so the least length may stand in the pattern without changing which runs match
ACCESS = rf"AKIA[A-Z0-9]{{{ACCESS_MIN - 4},}}+"
HEX = rf"[0-9a-f]{{{HEX_MIN},}}+"
_C = "A-Za-z0-9+/_-"
TOKEN = rf"(?<![{_C}])(?=[A-Za-z+/_-]*+[0-9])(?=[0-9+/_-]*+[A-Za-z])[{_C}]{{{TOKEN_MIN},}}+={{0,2}}+"

#: So many repositories make a value an example, also of one owner.
EXAMPLE_REPOS = 10

SPAN = "array<struct<k:int,s:int,e:int,h:string>>"


def _spans(text: Column, kind: int, pattern: str, hint: str, value=lambda m: m, keep=None) -> Column:
    """Matches of one kind with the digest of their value; texts without `hint` skip the search for positions."""
    matches = F.filter(found(text, pattern), keep) if keep else found(text, pattern)
    rows = F.transform(
        matches, lambda x: F.struct(F.lit(kind).alias("k"), x["s"].alias("s"), x["e"].alias("e"), F.md5(value(x["m"])).alias("h"))
    )
    return F.when(text.rlike(hint), rows).otherwise(F.array().cast(SPAN))


def candidates(docs: DataFrame, owner: Column, repo: Column) -> DataFrame:
    """(doc_id, th, owner, repo, base, free): candidate spans of every text, values as digests only."""
    rows = keyed(docs, owner.cast("string").alias("owner"), repo.cast("string").alias("repo"))
    text = F.col("text")
    value = lambda m: F.regexp_extract(m, ASSIGN, 1)
    base = F.concat(
        _spans(
            text, 0, ASSIGN, ASSIGN.replace("=-]+)", f"=-]{{{ASSIGN_MIN},}}+)"), value, lambda x: F.char_length(value(x["m"])) >= ASSIGN_MIN
        ),
        _spans(text, 1, ACCESS, ACCESS, lambda m: F.substring(m, 1, 20)),
        _spans(text, 2, HEX, HEX),
    )
    free = _spans(text, 3, TOKEN, TOKEN)
    rows = rows.select("doc_id", "th", "owner", "repo", base.alias("base"), free.alias("free"))
    apart = F.filter("free", lambda x: ~overlaps(F.col("base"), x["s"], x["e"]))
    return rows.withColumn("free", apart)


def ownership(cands: DataFrame) -> DataFrame:
    """(h, n_owners, n_repos) of every candidate value, reduced to distinct holders before values meet."""
    held = cands.select(
        F.explode(F.transform(F.concat("base", "free"), lambda x: x["h"])).alias("h"),
        F.coalesce("owner", F.lit("")).alias("owner"),
        F.coalesce("repo", F.lit("")).alias("repo"),
    ).distinct()
    by_owner = held.groupBy("h", "owner").agg(F.count(F.lit(1)).alias("n"))
    return by_owner.groupBy("h").agg(F.count(F.lit(1)).alias("n_owners"), F.sum("n").alias("n_repos"))


def scan_secrets(
    docs: DataFrame, owner: Column, repo: Column, live_owners: int = 1, example_owners: int = 3, example_repos: int = EXAMPLE_REPOS
) -> DataFrame:
    """One row per row of `docs`: base and all spans with their values' digest and ownership.

    A value held by at least `example_owners` owners or in `example_repos` repositories is an example, another one held by at most `live_owners`
    owners looks live. `n_repos` is the largest number of repositories that hold a value of the row. `base` holds the spans of the
    given patterns, `spans` these and the live-looking free-standing tokens.
    """
    cands = stored(candidates(docs, owner, repo), "secret-candidates")
    owned = ownership(cands)
    copied = (F.col("n_owners") >= example_owners) | (F.col("n_repos") >= example_repos)
    some = cands.where((F.size("base") > 0) | (F.size("free") > 0))
    one = some.select("doc_id", "th", F.explode(F.array_distinct(F.transform(F.concat("base", "free"), lambda x: x["h"]))).alias("h"))
    known = (
        one.distinct()
        .join(owned, "h")
        .groupBy("doc_id", "th")
        .agg(
            F.collect_set(F.when((F.col("n_owners") <= live_owners) & ~copied, F.col("h"))).alias("live"),
            F.collect_set(F.when(copied, F.col("h"))).alias("example"),
            F.max("n_repos").alias("n_repos"),
        )
    )
    none = F.array().cast("array<string>")
    rows = with_rows(cands, known).select(
        "doc_id",
        "th",
        "base",
        "free",
        F.coalesce("live", none).alias("live"),
        F.coalesce("example", none).alias("example"),
        F.coalesce("n_repos", F.lit(0)).cast("long").alias("n_repos"),
    )
    added = F.filter("free", lambda x: F.array_contains(F.col("live"), x["h"]))
    rows = rows.withColumn("spans", F.concat("base", added))
    marked = lambda c: F.size(F.filter("spans", lambda x: F.array_contains(F.col(c), x["h"]))).cast("long")
    return rows.select("doc_id", "th", "base", "spans", marked("live").alias("n_live"), marked("example").alias("n_example"), "n_repos")


def secret_report(docs: DataFrame, owner: Column, repo: Column, example_repos: int = EXAMPLE_REPOS) -> DataFrame:
    """Counts, digest of the base spans and all spans of every document."""
    rows = scan_secrets(docs, owner, repo, example_repos=example_repos)
    return rows.select(
        "doc_id",
        *[count_kind(F.col("base"), k).alias(f"n_{KINDS[k]}") for k in range(3)],
        F.sha2(span_text(F.col("base"), KINDS), 256).alias("base_sha256"),
        span_text(F.col("spans"), KINDS).alias("spans"),
        "n_live",
        "n_example",
        "n_repos",
    )


def redacted(text: Column, spans: Column, names: tuple[str, ...]) -> Column:
    """The text with every span replaced by [KIND]; spans that overlap merge into the first."""
    kinds = F.array(*[F.lit("[" + n.upper() + "]") for n in names])
    ordered = F.array_sort(F.transform(spans, lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"))))
    begin = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(a: Column, x: Column) -> Column:
        gap = F.substring(text, a["at"] + 1, x["s"] - a["at"])
        fresh = F.struct(F.concat(a["out"], gap, F.get(kinds, x["k"])).alias("out"), x["e"].alias("at"))
        longer = F.struct(a["out"].alias("out"), F.greatest(a["at"], x["e"]).alias("at"))
        return F.when(x["s"] >= a["at"], fresh).otherwise(longer)

    masked = let(F.aggregate(ordered, begin, step), lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.char_length(text))))
    return F.when(F.size(spans) > 0, masked).otherwise(text)


def without_secrets(docs: DataFrame, owner: Column, repo: Column, example_repos: int = EXAMPLE_REPOS) -> DataFrame:
    """`docs` with every span of its texts (base matches and live-looking tokens) masked; all columns stay, null texts stay null."""
    rows = scan_secrets(docs, owner, repo, example_repos=example_repos)
    to_mask = rows.where(F.size("spans") > 0).select("doc_id", "th", "spans").dropDuplicates(["doc_id", "th"])
    both = with_rows(whole_rows(docs), to_mask)
    text = F.when(F.col("spans").isNull(), F.col("row.text")).otherwise(redacted(F.col("row.text"), F.col("spans"), KINDS))
    return unpacked(both, docs.columns, text)
