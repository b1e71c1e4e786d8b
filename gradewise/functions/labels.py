"""Letters, labels and display text."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from gradewise import fixed_values as fixed


def letter(index: Column) -> Column:
    """0 -> A, 1 -> B, ..."""
    return F.chr(F.lit(65) + index.cast("bigint"))


def letter_index(text: Column) -> Column:
    return F.ascii(text) - 65


def path_label(schema: Column, benchmark: Column, model: Column) -> Column:
    return F.concat_ws("/", schema, benchmark, F.substring_index(model, "/", -1))


def one_decimal(value: Column) -> Column:
    """Text with one decimal; the value is fixed to 6 places first so that it does not hang on the last bit."""
    return F.round(value.cast("decimal(18,6)"), 1).cast("decimal(18,1)").cast("string")


def format_mean_std(mean: Column, std: Column) -> Column:
    """`m ± s` in percent; empty text when either is missing."""
    return F.when(mean.isNull() | std.isNull() | F.isnan(mean) | F.isnan(std), F.lit("")).otherwise(
        F.concat(one_decimal(mean * 100), F.lit(" ± "), one_decimal(std * 100))
    )


def exponent_label(value: Column) -> Column:
    """`1e24` from 1e10 on; below, one significant digit; 0 is `0`."""
    power = F.floor(F.log10(value))
    step = F.pow(F.lit(10.0), power.cast("double"))
    digit = F.bround(value / step, 0)
    carried = F.when(digit >= 10, power + 1).otherwise(power)
    lead = F.when(digit >= 10, F.lit(1)).otherwise(digit).cast("int").cast("string")
    exponent = F.concat(
        F.when(carried < 0, F.lit("-")).otherwise(F.lit("+")), F.lpad(F.abs(carried).cast("string"), 2, "0")
    )
    plain = F.when(
        carried < 0,
        F.concat(F.lit("0."), F.repeat(F.lit("0"), (F.abs(carried) - 1).cast("int")), lead),
    ).otherwise(lead)
    small = F.when((carried >= -4) & (carried < 1), plain).otherwise(F.concat(lead, F.lit("e"), exponent))
    return (
        F.when(value == 0, F.lit("0"))
        .when(power >= 10, F.concat(F.lit("1e"), power.cast("string")))
        .otherwise(small)
    )


def thousand_label(value: Column) -> Column:
    """`12k` from 1000 on, else the whole number."""
    return F.when(
        value >= 1000, F.concat((value / 1000).try_cast("bigint").cast("string"), F.lit("k"))
    ).otherwise(value.try_cast("bigint").cast("string"))


def alias_map(names: Mapping[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(names.items())])


def benchmark_display(name: Column, names: Mapping[str, str] = fixed.BENCHMARK_DISPLAY) -> Column:
    """Null for a benchmark without a display name."""
    return F.try_element_at(alias_map(names), name)


def model_display(name: Column, names: Mapping[str, str] = fixed.MODEL_DISPLAY) -> Column:
    """A model without a display name keeps its own."""
    return F.coalesce(F.try_element_at(alias_map(names), name), name)


def standardize_org(org: Column, aliases: Mapping[str, str] = fixed.ORGANIZATION_ALIASES) -> Column:
    return F.coalesce(F.try_element_at(alias_map(aliases), org), org)


def condition_label(schema: Column, labels: Mapping[str, str] = fixed.CONDITION_LABELS) -> Column:
    return F.try_element_at(alias_map(labels), schema)


def cot_label(is_cot: Column) -> Column:
    return F.when(is_cot, F.lit("CoT")).otherwise(F.lit("No CoT"))


def explicit_rank(value: Column, order: Sequence[str]) -> Column:
    """Position in an explicit order, from 0; null when not in it."""
    position = F.array_position(F.array(*[F.lit(v) for v in order]), value)
    return F.when(position > 0, position - 1)


def capitalize(text: Column) -> Column:
    return F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substring(text, 2, 1 << 30)))


def token_limit_category(tokens: Column) -> Column:
    return F.when(tokens.isNull(), F.lit("No reasoning limit specified")).otherwise(
        F.concat((tokens / 1000).cast("bigint").cast("string"), F.lit("k reasoning token limit"))
    )


def effort_category(effort: Column) -> Column:
    return F.concat(capitalize(F.coalesce(effort, F.lit("medium"))), F.lit(" reasoning effort"))
