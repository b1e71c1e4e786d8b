"""PII: patterns find protected entities, corpus co-occurrence tells which terms beside them give them away.

1. Base spans of four patterns. The value of a span (email in lower case, digits of a phone or card) is a protected entity.
2. Terms (runs of four or more letters, lower case) of the whole text outside the spans are the context of each entity in it.
3. For a term t and an entity e, over distinct texts: P(e|t) is the share of the texts with t that hold e too; P(e) the share of all
   texts that hold e. The disclosure of t about e is log(P(e|t) / P(e)) / -log P(e): 0 for chance, 1 if t gives e away for certain.
   It counts only if t and e share `SUPPORT` distinct texts or more; exact copies are one text.
4. Terms at `REMOVE` or above are removed, terms at `GENERALISE` or above become their class; both are spans (kind `term`) at all their
   places outside base spans, in all texts, also in those that don't hold the entity.

Results in special cases: a null or empty text has no spans; rows that agree in doc_id and text get the same result; an empty table gives
no rows; an entity in all texts has nothing to disclose; other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradewise.llm.common import count_kind, found, keyed, let, overlaps, span_text, stored, unpacked, whole_rows, with_rows

KINDS = ("email", "ip", "card", "phone", "term")
SUPPORT, GENERALISE, REMOVE = 3, 0.7, 0.9
#: A list of disclosing terms up to this many rows is sent to all executors; a longer one is joined by shuffling.
TERM_ROWS = 100_000

_L = "A-Za-z0-9._%+-"
# Greedy runs written possessive, and starts bound to the start of a run or the end of the last match: the same matches in linear time.
EMAIL = rf"(?:(?<![{_L}])|\G)[{_L}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9]){11,}+"  # whole runs, so the least length may stand in the pattern
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
TERM = r"\p{L}{4,}+"
SPAN = "array<struct<k:int,s:int,e:int,v:string>>"


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Luhn's check of a text of 12 to 19 digits."""
    n = F.char_length(digits)

    def one(i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        return F.when(i % 2 == 0, d).otherwise(F.when(d > 4, d * 2 - 9).otherwise(d * 2))

    total = F.aggregate(F.transform(F.sequence(F.lit(0), n - 1), one), F.lit(0), lambda a, x: a + x)
    return (n >= 12) & (n <= 19) & (total % 10 == 0)


def _small_parts(m: Column) -> Column:
    """Are all parts of a dotted number at most 255? Leading zeros don't count."""
    parts = F.transform(F.split(m, r"\.", -1), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
    return F.forall(parts, lambda p: (F.char_length(p) < 3) | ((F.char_length(p) == 3) & (p <= "255")))


def _phone_size(m: Column) -> Column:
    return F.char_length(_digits(m)).between(9, 15)


def base_spans(text: Column) -> Column:
    """Spans (k, s, e, v) of the given patterns, v the entity's value."""
    plan = (
        (EMAIL, r"@[A-Za-z0-9-]++\.", lambda m: F.lit(True), F.lower),
        (IP, r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", _small_parts, lambda m: m),
        (CARD, CARD, lambda m: let(_digits(m), lambda d: F.when(F.char_length(d) <= 19, _luhn(d)).otherwise(F.lit(False))), _digits),
        (PHONE, r"\+[0-9]", _phone_size, _digits),
    )

    def one(k: int, pattern: str, hint: str, good: Callable[[Column], Column], value: Callable[[Column], Column]) -> Column:
        rows = F.transform(
            F.filter(found(text, pattern), lambda x: good(x["m"])),
            lambda x: F.struct(
                F.lit(k).alias("k"), x["s"].alias("s"), x["e"].alias("e"), F.concat(F.lit(KINDS[k] + ":"), value(x["m"])).alias("v")
            ),
        )
        return F.when(text.rlike(hint), rows).otherwise(F.array().cast(SPAN))

    return F.concat(*[one(k, *what) for k, what in enumerate(plan)])


def _forms(text: Column) -> Column:
    """The distinct terms of a text as they are written."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)))


def protected(docs: DataFrame) -> DataFrame:
    """(doc_id, th, base, terms): base spans of every text; where it has any, the distinct terms outside them."""
    from gradewise.llm.secrets import redacted

    rows = keyed(docs).select("doc_id", "th", "text", base_spans(F.col("text")).alias("base"))
    rest = redacted(F.col("text"), F.col("base"), ("",) * len(KINDS))
    terms = F.when(F.size("base") > 0, F.array_distinct(F.transform(_forms(rest), F.lower)))
    return rows.select("doc_id", "th", "base", terms.alias("terms"))


def _told(together: Column, n_t: Column, n_e: Column, total: int) -> Column:
    """Disclosure of a term of `n_t` texts about an entity of `n_e`, if they share `together`."""
    prior = n_e / F.lit(float(max(total, 1)))
    given = F.least(together / n_t, F.lit(1.0))
    return F.when(prior < 1, F.log(given / prior) / -F.log(prior)).otherwise(F.lit(0.0))


def disclosure(docs: DataFrame, found_rows: DataFrame, support: int, least: float) -> tuple[DataFrame, DataFrame]:
    """(v, t, d): terms whose disclosure about an entity is at least `least`; (th, m, t): the texts that hold such terms, as written."""
    some = found_rows.where(F.size("base") > 0)
    one = lambda c, name: some.select("th", F.explode(c).alias(name)).distinct()
    entity, term = one("base.v", "v"), one("terms", "t")
    many = lambda rows, name, n: stored(rows.groupBy(name).agg(F.count(F.lit(1)).alias(n)).where(F.col(n) >= support), f"pii-{n}")
    entities, least_texts = many(entity, "v", "n_e"), many(term, "t", "n_least")
    total = keyed(docs).select("th").distinct().agg(F.count(F.lit(1)).alias("n")).first()["n"]

    # n_e is the most that a pair can share and n_least the least that a term has: together they bound its disclosure from above
    bound = _told(F.col("n_e"), F.col("n_least"), F.col("n_e"), total) >= least
    met = entity.join(entities, "v").join(term.join(least_texts, "t"), "th").where(bound)
    shared = met.groupBy("v", "t", "n_e", "n_least").agg(F.count(F.lit(1)).alias("n_te")).where(F.col("n_te") >= support)
    pairs = stored(shared.where(_told(F.col("n_te"), F.col("n_least"), F.col("n_e"), total) >= least), "pii-pairs")
    terms = stored(pairs.select("t").distinct(), "pii-terms")
    wanted = F.broadcast(terms) if terms.count() <= TERM_ROWS else terms
    in_text = keyed(docs).select("th", F.explode(_forms(F.col("text"))).alias("m")).select("th", "m", F.lower("m").alias("t"))
    held = stored(in_text.join(wanted, "t", "left_semi").distinct(), "pii-held")
    by_term = held.select("th", "t").distinct().groupBy("t").agg(F.count(F.lit(1)).alias("n_t"))
    told = _told(F.col("n_te"), F.col("n_t"), F.col("n_e"), total)
    return pairs.join(by_term, "t").select("v", "t", told.alias("d")).where(F.col("d") >= least), held.select("th", "m", "t")


def find_pii(docs: DataFrame, support: int = SUPPORT, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """One row per row of `docs`: (doc_id, th, base, terms), terms as (k, s, e, v, gone), gone true where a term is removed."""
    rows = stored(protected(docs), "pii-spans")
    strong, held = disclosure(docs, rows, support, generalise)
    strong = strong.groupBy("t").agg((F.max("d") >= remove).alias("gone"))
    marks = held.join(strong, "t").groupBy("th").agg(F.map_from_entries(F.collect_list(F.struct("m", "gone"))).alias("marks"))
    # terms are letters only, so they stand in a pattern as they are
    pattern = F.concat(F.lit(r"(?<!\p{L})(?:"), F.array_join(F.map_keys("marks"), "|"), F.lit(r")(?!\p{L})"))
    at = F.transform(
        found(F.col("text"), F.col("pattern")),
        lambda x: F.struct(
            F.lit(4).alias("k"), x["s"].alias("s"), x["e"].alias("e"), F.lower(x["m"]).alias("v"), F.element_at("marks", x["m"]).alias("gone")
        ),
    )
    marked = keyed(docs).join(marks, "th").withColumn("pattern", pattern).select("doc_id", "th", at.alias("at")).dropDuplicates(["doc_id", "th"])
    apart = F.filter("at", lambda x: ~overlaps(F.col("base"), x["s"], x["e"]))
    none = F.array().cast("array<struct<k:int,s:int,e:int,v:string,gone:boolean>>")
    return with_rows(rows.drop("terms"), marked).select("doc_id", "th", "base", F.coalesce(apart, none).alias("terms"))


def _places(spans: Column) -> Column:
    return F.transform(spans, lambda x: F.struct(x["k"].alias("k"), x["s"].alias("s"), x["e"].alias("e")))


def pii_report(docs: DataFrame) -> DataFrame:
    """Counts, digest of the base spans and all spans of every document."""
    rows = find_pii(docs)
    return rows.select(
        "doc_id",
        *[count_kind(F.col("base"), k).alias(f"n_{KINDS[k]}") for k in range(4)],
        F.sha2(span_text(F.col("base"), KINDS), 256).alias("base_sha256"),
        span_text(F.concat(_places(F.col("base")), _places(F.col("terms"))), KINDS).alias("spans"),
        count_kind(F.col("terms"), 4).alias("n_term"),
    )


def sanitised(docs: DataFrame) -> DataFrame:
    """`docs` with entities and disclosing terms masked by their kind, all columns kept, null texts kept."""
    from gradewise.llm.secrets import redacted

    rows = find_pii(docs).dropDuplicates(["doc_id", "th"])
    both = with_rows(whole_rows(docs), rows)
    # a generalised term keeps its class, of a removed one only the gap is marked
    terms = F.transform("terms", lambda x: F.struct(F.when(x["gone"], 5).otherwise(4).alias("k"), x["s"].alias("s"), x["e"].alias("e")))
    text = redacted(F.col("row.text"), F.concat(_places(F.col("base")), terms), (*KINDS, "gone"))
    return unpacked(both, docs.columns, text)
