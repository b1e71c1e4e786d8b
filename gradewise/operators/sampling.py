"""Exact seeded sampling and few-shot example choice.

Both rest on a digest order: `md5(seed|id)` is uniform, the same on every attempt, and its leading digits cut the data
into buckets of even size. A rank over all rows is then a bucket offset (from at most 16^4 counts) plus a rank within
one small bucket, so no window ever spans the table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradewise.operators.samples import SEED

BUCKET_DIGITS = 4
SLICE_DIGITS = 3
TOP_N_LIMIT = 100


def digest(key: Column, seed: int = SEED) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), key.cast("string")))


def digest_number(hex_text: Column, digits: int = 13) -> Column:
    """Leading digits of a digest as a non-negative integer."""
    return F.conv(F.substring(hex_text, 1, digits), 16, 10).cast("bigint")


def _offsets(counts: DataFrame, bucket: str, rows: str) -> DataFrame:
    """Rows before each bucket, and the total. At most 16^BUCKET_DIGITS input rows, so one window is fine."""
    ordered = Window.partitionBy(F.lit(0)).orderBy(bucket)
    return counts.select(
        bucket,
        F.col(rows).alias("bucket_rows"),
        (F.sum(rows).over(ordered) - F.col(rows)).alias("bucket_start"),
        F.sum(rows).over(Window.partitionBy(F.lit(0))).alias("total_rows"),
    )


def sample_exact(df: DataFrame, ident: str, n: int | None, seed: int = SEED) -> DataFrame:
    """Exactly `min(n, count)` rows without replacement; the input itself when `n` is unset or 0.

    `ident` must be unique. Small n is a distributed top-n. For large n the n-th smallest digest is found from narrow
    scans of the id; the rows are then one filter over the table, without a shuffle or a sort of them.
    """
    if not n:
        return df
    if n <= TOP_N_LIMIT:
        return df.orderBy(digest(F.col(ident), seed), F.col(ident)).limit(n)
    place = F.struct(digest(F.col(ident), seed).alias("d"), F.col(ident).alias("i"))
    last = _nth_place(df.select(place.alias("_place")), n)
    return df.filter(last.isNull() | (place <= last))


def _nth_place(places: DataFrame, n: int) -> Column:
    """The n-th smallest `_place` as a scalar; null when there are fewer rows. Only one bucket is ranked."""
    tagged = places.withColumn("_bucket", F.substring("_place.d", 1, BUCKET_DIGITS))
    counts = tagged.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_rows"))
    start, rows = F.col("bucket_start"), F.col("bucket_rows")
    cut = _offsets(counts, "_bucket", "_rows").filter((start < n) & (start + rows >= n))  # one row at most
    in_bucket = Window.partitionBy("_bucket").orderBy("_place")
    return (
        tagged.join(F.broadcast(cut), "_bucket")
        .withColumn("_rank", F.row_number().over(in_bucket) + start)
        .filter(F.col("_rank") == n)
        .agg(F.max("_place"))
        .scalar()
    )


def example_ring(samples: DataFrame, ident: str = "id", text: str = "input", seed: int = SEED) -> DataFrame:
    """Place every sample on a ring ordered by the digest of its text, then of its id.

    Columns: the id, `position` (0 .. total_rows - 1), and for the run of samples that share its text `run_start`
    and `run_rows`. Copies of one text are neighbours, however many there are; a large run is ranked in slices
    of the id digest.
    """
    keyed = samples.select(
        F.col(ident).alias("_id"),
        F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(text))).alias("_text_digest"),
        digest(F.col(ident), seed).alias("_id_digest"),
    ).withColumn("_slice", F.substring("_id_digest", 1, SLICE_DIGITS))
    # one shuffle serves both the rank within a cell and the cell counts below (the exchange is reused)
    cell = Window.partitionBy("_text_digest", "_slice")
    ranked = keyed.withColumns(
        {
            "_rank": F.row_number().over(cell.orderBy("_id_digest", "_id")),
            "_rows": F.count(F.lit(1)).over(cell),
        }
    )
    cells = ranked.filter(F.col("_rank") == 1).select(
        F.substring("_text_digest", 1, BUCKET_DIGITS).alias("_bucket"), "_text_digest", "_slice", "_rows"
    )
    buckets = cells.groupBy("_bucket").agg(F.sum("_rows").alias("_bucket_rows"))
    # at most 16^BUCKET_DIGITS rows: the broadcast does not grow with the data
    starts = F.broadcast(_offsets(buckets, "_bucket", "_bucket_rows"))

    by_bucket = Window.partitionBy("_bucket").orderBy("_text_digest", "_slice")
    by_text = Window.partitionBy("_bucket", "_text_digest")
    placed = (
        cells.withColumn("_before", F.sum("_rows").over(by_bucket) - F.col("_rows"))
        .withColumns(
            {
                "_run_before": F.min("_before").over(by_text),
                "run_rows": F.sum("_rows").over(by_text),
            }
        )
        .join(starts, "_bucket")
        .select(
            "_text_digest",
            "_slice",
            (F.col("bucket_start") + F.col("_before")).alias("_cell_start"),
            (F.col("bucket_start") + F.col("_run_before")).alias("run_start"),
            "run_rows",
            "total_rows",
        )
    )
    return ranked.join(placed, ["_text_digest", "_slice"]).select(
        F.col("_id").alias(ident),
        (F.col("_cell_start") + F.col("_rank") - 1).alias("position"),
        "run_start",
        "run_rows",
        "total_rows",
        digest_number(F.col("_id_digest")).alias("draw"),
    )


def fewshot_pairs(
    samples: DataFrame, n_shot: int, ident: str = "id", text: str = "input", seed: int = SEED
) -> DataFrame:
    """For each sample, `min(n_shot, available)` other samples whose text differs: `(id, rank, example_id)`.

    The ring without the sample's own run has `available` places; a window of `n_shot` places is taken from a
    start drawn by the sample's digest. No candidate is ever rejected, so heavy copying costs nothing extra.
    """
    ring = example_ring(samples, ident, text, seed)
    available = F.col("total_rows") - F.col("run_rows")
    offset = F.pmod(F.col("draw") + F.col("rank") - 1, F.col("available"))
    wanted = (
        ring.withColumn("available", available)
        .filter(F.col("available") > 0)
        .withColumn("rank", F.explode(F.sequence(F.lit(1), F.least(F.lit(n_shot).cast("bigint"), "available").cast("int"))))
        .select(
            ident,
            "rank",
            F.pmod(F.col("run_start") + F.col("run_rows") + offset, F.col("total_rows")).alias("position"),
        )
    )
    places = ring.select("position", F.col(ident).alias("example_id"))
    return wanted.join(places, "position").select(ident, "rank", "example_id")


def fewshot_examples(
    samples: DataFrame,
    n_shot: int,
    example: Column,
    ident: str = "id",
    text: str = "input",
    seed: int = SEED,
    separator: str = "\n\n",
) -> DataFrame:
    """`(id, examples)`: the rendered examples of each sample, joined in rank order.

    `example` is the text of one sample as an example; it is rendered once per sample, before the join.
    """
    pairs = fewshot_pairs(samples, n_shot, ident, text, seed)
    rendered = samples.select(F.col(ident).alias("example_id"), example.alias("_example"))
    return (
        pairs.join(rendered, "example_id")
        .groupBy(ident)
        .agg(F.sort_array(F.collect_list(F.struct("rank", "_example"))).alias("_list"))  # n_shot entries
        .select(ident, F.array_join(F.transform("_list", lambda e: e["_example"]), separator).alias("examples"))
    )


def check_n_shot(samples: DataFrame, n_shot: int) -> DataFrame:
    """The samples, or an error at run time when there are not more samples than `n_shot`."""
    enough = samples.limit(n_shot + 1).count() > n_shot
    if not enough:
        raise ValueError(f"n_shot ({n_shot}) must be less than the number of samples")
    return samples


def distinct_examples(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Example counts per sample, for checks."""
    return pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_examples"))
