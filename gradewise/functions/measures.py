"""Small statistics on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Z_95 = 1.96


def binomial_stderr(p: Column, n: Column, kind: str = "population") -> Column:
    """`population`: sqrt(p(1-p)/n); `sample`: sqrt(p(1-p)/(n-1)). 0 where the divisor is not positive."""
    divisor = n if kind == "population" else n - 1
    return F.when(divisor > 0, F.sqrt(p * (1 - p) / divisor)).otherwise(F.lit(0.0))


def ratio(numerator: Column, denominator: Column) -> Column:
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def fold_ci(mean_a: Column, std_a: Column, n_a: Column, mean_b: Column, std_b: Column, n_b: Column) -> Column:
    """Ratio of two means with its 95 % interval in log space, as `struct<ratio, ci_low, ci_high>`.

    All three are null unless both means are positive; the interval is null when a deviation is missing.
    """
    usable = (mean_a > 0) & (mean_b > 0)
    fold = F.when(usable, mean_a / mean_b)
    error = F.sqrt(
        F.pow(F.try_divide(std_a, mean_a), 2) / n_a + F.pow(F.try_divide(std_b, mean_b), 2) / n_b
    )
    return F.struct(
        fold.alias("ratio"),
        F.when(usable, F.exp(F.log(fold) - Z_95 * error)).alias("ci_low"),
        F.when(usable, F.exp(F.log(fold) + Z_95 * error)).alias("ci_high"),
    )


def percent(share: Column) -> Column:
    return share * 100


def truncate_int(value: Column) -> Column:
    """Toward zero, as an integer."""
    return value.cast("bigint")


def round_half_even(value: Column, places: int) -> Column:
    return F.bround(value, places)


def relative_to_expert(accuracy: Column, expert: Column) -> Column:
    """Share of the room above the expert that is reached; negative below the expert."""
    return F.try_divide(accuracy - expert, 1 - expert)


def normalized_to_expert(accuracy: Column, expert: Column, initial: Column) -> Column:
    """-100 at the initial accuracy, 0 at the expert, positive above, on one scale."""
    return F.when(accuracy <= initial, F.lit(-100.0)).otherwise(
        F.try_divide((accuracy - expert) * 100, expert - initial)
    )
