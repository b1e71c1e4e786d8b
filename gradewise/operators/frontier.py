"""Best-so-far curves over publication dates.

All of them start from one best row per (group, date), combined map-side. Dates are days, so a window then holds
days and not runs, whatever the size of a group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradewise.functions.measures import normalized_to_expert, relative_to_expert


def _best(value: str, order: str, columns: Sequence[str]) -> Column:
    """Highest value; on a tie the row that comes first in `order`."""
    return F.min(F.struct((-F.col(value)).alias("_neg"), F.col(order), *[F.col(c) for c in columns if c != order]))


def daily_best(
    rows: DataFrame, group: str, date: str, value: str, order: str, carried: Sequence[str] = ()
) -> DataFrame:
    """Best row per (group, date): columns group, `date`, `_best` (a struct that orders best first)."""
    return (
        rows.filter(F.col(value).isNotNull() & F.col(date).isNotNull() & F.col(group).isNotNull())
        .groupBy(group, F.col(date).cast("date").alias("date"))
        .agg(_best(value, order, carried).alias("_best"))
    )


def _unpack(group: str, value: str, order: str, carried: Sequence[str]) -> list[Column]:
    names = [order, *[c for c in carried if c != order]]
    return [F.col(group), F.col("date"), (-F.col("_best._neg")).alias(value), *[F.col(f"_best.{n}").alias(n) for n in names]]


def running_best(
    rows: DataFrame, group: str, date: str, value: str, order: str, carried: Sequence[str] = ()
) -> DataFrame:
    """At each date of a group, the best row so far; the earlier row keeps a tie."""
    daily = daily_best(rows, group, date, value, order, carried)
    so_far = Window.partitionBy(group).orderBy("date").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return daily.withColumn("_best", F.min("_best").over(so_far)).select(*_unpack(group, value, order, carried))


def best_intervals(
    rows: DataFrame, group: str, date: str, value: str, order: str, carried: Sequence[str] = ()
) -> DataFrame:
    """One row for each change of a group's best: it holds from `date` until before `until`, which is null for the last one.

    Its size follows the number of changes, not the number of days.
    """
    daily = daily_best(rows, group, date, value, order, carried)
    by_date = Window.partitionBy(group).orderBy("date")
    before = by_date.rowsBetween(Window.unboundedPreceding, -1)
    changes = daily.withColumn("_before", F.min("_best").over(before)).filter(F.col("_before").isNull() | (F.col("_best") < F.col("_before")))
    return changes.withColumn("until", F.lead("date").over(by_date)).select(*_unpack(group, value, order, carried), "until")


def as_of(intervals: DataFrame, days: DataFrame) -> DataFrame:
    """The interval that holds on each day: `intervals` with `date` and `until`, `days` with `date`; the result has the day as `date`.

    Both sides meet by month: an interval has a row for each month it touches, and a month has at most 31 days.
    """
    last = days.agg(F.max("date")).scalar()
    month = lambda c: F.year(c) * 12 + F.month(c)
    until = F.coalesce(F.date_sub("until", 1), F.greatest(last, F.col("date")))
    touched = intervals.withColumn("_until", until).withColumn("_month", F.explode(F.sequence(month(F.col("date")), month(F.col("_until")))))
    named = days.select(F.col("date").alias("_day")).distinct().withColumn("_month", month(F.col("_day")))
    return (
        touched.join(named, "_month")
        .filter(F.col("_day").between(F.col("date"), F.col("_until")))
        .withColumn("date", F.col("_day"))
        .drop("_day", "_month", "_until", "until")
    )


def best_as_of(
    rows: DataFrame, group: str, date: str, value: str, order: str, carried: Sequence[str] = ()
) -> DataFrame:
    """At every date found in the table, the best row of each group so far (from the group's first date on)."""
    days = rows.filter(F.col(date).isNotNull()).select(F.col(date).cast("date").alias("date")).distinct()
    return as_of(best_intervals(rows, group, date, value, order, carried), days)


def carry_last_forward(curve: DataFrame, group: str) -> DataFrame:
    """Repeat the last row of each group at the latest date of the whole curve."""
    latest = curve.agg(F.max("date")).scalar()
    following = F.lead("date").over(Window.partitionBy(group).orderBy("date"))
    own = F.array(F.struct(F.col("date"), F.lit(False).alias("is_carried")))
    again = F.array(F.struct(latest.alias("date"), F.lit(True).alias("is_carried")))
    others = [c for c in curve.columns if c not in (group, "date")]
    times = F.when(F.col("_next").isNull(), F.concat(own, again)).otherwise(own)
    copies = curve.withColumn("_next", following).withColumn("_at", F.explode(times))
    return copies.select(group, "_at.date", *others, "_at.is_carried")


def initial_performance(
    rows: DataFrame, facts: DataFrame, fixed_initial: DataFrame, group: str, date: str, value: str, order: str
) -> DataFrame:
    """Accuracy a group starts from: `(group, event_date, expert, initial)`.

    A group older than the earliest model of the table takes its fixed value if it has one; otherwise the first
    row on or after the event date counts. Groups without expert, date or start, and groups that start at or above
    the expert, are left out. `facts` has `(group, event_date, expert)`, `fixed_initial` has `(group, fixed_initial)`.
    """
    earliest = rows.agg(F.min(F.col(date).cast("date"))).scalar()
    after = F.when(F.col("_day") >= F.col("event_date"), F.struct(F.col("_day"), F.col(order)))
    # reduced to one row per (group, day) first, so the join with the facts is between small tables
    first_of_day = (
        rows.filter(F.col(value).isNotNull())
        .groupBy(group, F.col(date).cast("date").alias("_day"))
        .agg(F.min(F.struct(F.col(order), F.col(value))).alias("_first"))
        .select(group, "_day", F.col(f"_first.{order}").alias(order), F.col(f"_first.{value}").alias(value))
    )
    starts = (
        first_of_day.join(facts, group)
        .groupBy(group, "event_date", "expert")
        .agg(F.min_by(value, after).alias("_first_after"))
        .join(fixed_initial, group, "left")
    )
    initial = F.when(
        (F.col("event_date") < earliest) & F.col("fixed_initial").isNotNull(), F.col("fixed_initial")
    ).otherwise(F.col("_first_after"))
    return (
        starts.withColumn("initial", initial)
        .filter(F.col("event_date").isNotNull() & (F.col("initial") < F.col("expert")))
        .select(group, "event_date", "expert", "initial")
    )


def improvement_frontier(
    rows: DataFrame,
    starts: DataFrame,
    group: str,
    date: str,
    value: str,
    order: str,
    carried: Sequence[str] = (),
) -> DataFrame:
    """Dates from the event date on at which the best so far strictly exceeds everything before and the start."""
    curve = running_best(rows, group, date, value, order, carried).join(starts, group)
    before = Window.partitionBy(group).orderBy("date")
    return (
        curve.filter(F.col("date") >= F.col("event_date"))
        .withColumn("_before", F.lag(value).over(before))
        .filter(F.col(value) > F.greatest(F.coalesce("_before", "initial"), F.col("initial")))
        .drop("_before")
    )


def normalized_frontier(
    rows: DataFrame, starts: DataFrame, group: str, date: str, value: str, order: str, shown: str
) -> DataFrame:
    """The frontier on a scale of -100 (start) to 0 (expert) and above, with a first point at the event date."""
    points = improvement_frontier(rows, starts, group, date, value, order, [shown]).select(
        group,
        "date",
        F.col(shown).cast("string").alias("model"),
        F.col(value).alias("raw_accuracy"),
        normalized_to_expert(F.col(value), F.col("expert"), F.col("initial")).alias("normalized_accuracy"),
    )
    origin = starts.select(
        group,
        F.col("event_date").alias("date"),
        F.lit("Initial").alias("model"),
        F.col("initial").alias("raw_accuracy"),
        F.lit(-100.0).alias("normalized_accuracy"),
    )
    return origin.unionByName(points)


def relative_frontier(
    rows: DataFrame, experts: DataFrame, group: str, date: str, value: str, order: str, carried: Sequence[str] = ()
) -> DataFrame:
    """Best-so-far curve as the share of the room above the expert; groups without expert are left out."""
    curve = best_as_of(rows, group, date, value, order, carried)
    return curve.join(experts.filter(F.col("expert").isNotNull()), group).withColumn(
        "normalized_accuracy", relative_to_expert(F.col(value), F.col("expert"))
    )


def best_setting(rows: DataFrame, keys: Sequence[str], value: str, order: Sequence[str], carried: Sequence[str]) -> DataFrame:
    """Per key the row with the highest value; the first in `order` on a tie. An aggregate, so hot keys combine."""
    position = F.struct((-F.col(value)).alias("_neg"), *[F.col(o) for o in order])
    best = F.min_by(F.struct(F.col(value), *[F.col(c) for c in carried]), position)
    return rows.filter(F.col(value).isNotNull()).groupBy(*keys).agg(best.alias("_b")).select(*keys, "_b.*")
