"""Exact quantiles of groups of any size.

The built-in exact percentile keeps every distinct value of a group in one buffer. Here the value range is cut at
about a thousand approximate quantiles of the whole column. The cut that holds a wanted rank follows from at most a
thousand counts per group. A cut with many rows of a group is cut again, at quantiles of its own rows, until few rows or one value are
left; only these rows are moved, counted per value and ranked. So no task ranks more than `ROWS` values, however large a group is.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradewise.storage import kept

CUTS = 1000
#: Rows of a group that one task ranks, and points at which a larger cell is cut again.
ROWS = 1_000_000
FINER = 256


def _cut_points(df: DataFrame, value: str, cuts: int) -> list[float]:
    """At most `cuts` numbers on the driver. They only steer the work: any cut points give the same result."""
    shares = [i / cuts for i in range(1, cuts)]
    row = df.agg(F.percentile_approx(value, shares, 10 * cuts).alias("p")).first()
    return sorted({p for p in row["p"] or [] if math.isfinite(p)})


def _with_cut(data: DataFrame, points: Sequence[float]) -> DataFrame:
    """Add `_cut`, the number of cut points at or below the value."""
    if len(points) < 2:
        return data.withColumn("_cut", F.lit(0.0))
    splits = [-math.inf, *points, math.inf]
    return Bucketizer(splits=splits, inputCol="_v", outputCol="_cut", handleInvalid="keep").transform(data)


def _tagged(df: DataFrame, groups: Sequence[str], value: str, cuts: int) -> DataFrame:
    data = df.filter(F.col(value).isNotNull()).select(*groups, F.col(value).cast("double").alias("_v")).dropna(subset=list(groups))
    return _with_cut(data, _cut_points(data, "_v", cuts))


def _cut_counts(tagged: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Rows and extreme values of every cut of a group. A stored table of at most `cuts` rows per group."""
    counts = tagged.groupBy(*groups, "_cut").agg(F.count(F.lit(1)).alias("_rows"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    return kept(counts, "cut-counts")


def _holding(cells: DataFrame, parts: Sequence[str], order: str, before: Column) -> DataFrame:
    """The cells that hold a wanted rank: `_start` is the rank of a cell's first row, `_ranks` are the wanted ones in it."""
    ordered = Window.partitionBy(*parts).orderBy(order)
    return (
        cells.withColumn("_start", before + F.sum("_rows").over(ordered) - F.col("_rows"))
        .withColumn("_ranks", F.filter("_ranks", lambda r: (r >= F.col("_start")) & (r < F.col("_start") + F.col("_rows"))))
        .filter(F.size("_ranks") > 0)
    )


def _cut_again(data: DataFrame, crowded: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Finer cells for `crowded` ones. A cut point is a cell of its own, so a frequent value can't keep a cell large."""
    cell = [*groups, "_lo", "_hi"]
    inside = lambda cells: data.join(cells, list(groups)).filter(F.col("_v").between(F.col("_lo"), F.col("_hi")))
    shares = [i / FINER for i in range(1, FINER)]
    points = inside(crowded.select(*cell)).groupBy(*cell).agg(F.array_distinct(F.percentile_approx("_v", shares, 10 * FINER)).alias("_points"))
    cut = kept(crowded.join(points, cell), "cut-points")
    below = F.size(F.filter("_points", lambda p: p < F.col("_v")))
    place = 2 * below + F.array_contains("_points", F.col("_v")).cast("int")
    counts = (
        inside(cut.select(*cell, "_points"))
        .groupBy(*cell, place.alias("_place"))
        .agg(F.count(F.lit(1)).alias("_rows"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    )
    named = counts.join(cut.select(*cell, F.col("_start").alias("_before"), "_ranks", "n"), cell)
    return _holding(named, cell, "_place", F.col("_before")).select(
        *groups, F.col("_low").alias("_lo"), F.col("_high").alias("_hi"), "_rows", "_start", "_ranks", "n"
    )


def group_quantiles(
    df: DataFrame, groups: Sequence[str], value: str, shares: Sequence[float], cuts: int = CUTS, rows: int = ROWS
) -> DataFrame:
    """Quantiles with linear interpolation per group: the groups, `n`, and an array `quantiles` in order of `shares`. Null groups are left out."""
    tagged = _tagged(df, groups, value, cuts)
    return _quantiles(tagged.drop("_cut"), _cut_counts(tagged, groups), groups, shares, rows)


def _quantiles(data: DataFrame, counts: DataFrame, groups: Sequence[str], shares: Sequence[float], rows: int) -> DataFrame:
    wanted = F.array(*[F.lit(float(s)) for s in shares])
    place = F.transform(wanted, lambda s: s * (F.col("n") - 1))
    ranks = F.array_distinct(
        F.concat(
            F.transform(place, lambda p: F.floor(p).cast("bigint")), F.transform(place, lambda p: F.ceil(p).cast("bigint"))
        )
    )
    whole = counts.withColumn("n", F.sum("_rows").over(Window.partitionBy(*groups))).withColumn("_ranks", ranks)
    cells = _holding(whole, groups, "_cut", F.lit(0)).select(*groups, "_lo", "_hi", "_rows", "_start", "_ranks", "n")
    is_crowded = (F.col("_rows") > rows) & (F.col("_lo") < F.col("_hi"))
    while True:
        cells = kept(cells, "cells")
        if cells.filter(is_crowded).isEmpty():
            break
        cells = cells.filter(~is_crowded).unionByName(_cut_again(data, cells.filter(is_crowded), groups))
    in_cell = Window.partitionBy(*groups, "_lo").orderBy("_v")
    hits = (
        data.join(cells.drop("_rows"), list(groups))
        .filter(F.col("_v").between(F.col("_lo"), F.col("_hi")))
        .groupBy(*groups, "_lo", "_v", "_start", "_ranks", "n")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_end", F.col("_start") + F.sum("_n").over(in_cell))
        .withColumn(
            "_rank",
            F.explode(
                F.filter("_ranks", lambda r: (r >= F.col("_end") - F.col("_n")) & (r < F.col("_end")))
            ),
        )
    )
    at_rank = hits.groupBy(*groups).agg(
        F.max("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("_rank", "_v"))).alias("_at")
    )  # at most two entries per share

    def interpolate(p: Column) -> Column:
        low = F.element_at(F.col("_at"), F.floor(p).cast("bigint"))
        high = F.element_at(F.col("_at"), F.ceil(p).cast("bigint"))
        return low + (high - low) * (p - F.floor(p))

    return at_rank.select(*groups, "n", F.transform(place, interpolate).alias("quantiles"))


def median_rank(df: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    """Median per group; sort by it, descending, for the order of a chart."""
    medians = group_quantiles(df, groups, value, [0.5])
    return medians.select(*groups, "n", F.get("quantiles", F.lit(0)).alias("median"))


def quartile_summary(df: DataFrame, groups: Sequence[str], value: str, cuts: int = CUTS, rows: int = ROWS) -> DataFrame:
    """What a box plot shows without outliers: quartiles, and the extreme values within 1.5 IQR of the box.

    The whiskers come from the extreme values of the cuts; only the two cuts in which a whisker's reach ends are read once more.
    """
    tagged = _tagged(df, groups, value, cuts)
    counts = _cut_counts(tagged, groups)
    box = _quantiles(tagged.drop("_cut"), counts, groups, [0.25, 0.5, 0.75], rows).select(
        *groups,
        "n",
        F.get("quantiles", F.lit(0)).alias("q1"),
        F.get("quantiles", F.lit(1)).alias("median"),
        F.get("quantiles", F.lit(2)).alias("q3"),
    )
    box = kept(box, "box")
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    low, high = F.col("q1") - reach, F.col("q3") + reach
    bounded = counts.join(box.select(*groups, low.alias("_least"), high.alias("_most")), list(groups))
    within = (F.col("_lo") >= F.col("_least")) & (F.col("_hi") <= F.col("_most"))
    touched = (F.col("_hi") >= F.col("_least")) & (F.col("_lo") <= F.col("_most"))
    ends = bounded.filter(touched & ~within).select(*groups, "_cut", "_least", "_most")
    rest = tagged.join(ends, [*groups, "_cut"]).filter(F.col("_v").between(F.col("_least"), F.col("_most")))
    found = bounded.filter(within).select(*groups, "_lo", "_hi").unionByName(
        rest.groupBy(*groups).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    )
    kind = df.schema[value].dataType
    whiskers = found.groupBy(*groups).agg(F.min("_lo").cast(kind).alias("whisker_low"), F.max("_hi").cast(kind).alias("whisker_high"))
    return box.join(whiskers, list(groups))
