"""Price text and token cost as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEPARATE = "separate input/output costs"
COMBINED = "combined cost"
NO_PRICE = "No cost data available for this model"


def price_from_digits(text: Column) -> Column:
    """Keep digits and dots; empty, missing or unreadable text is 0."""
    digits = F.nullif(F.regexp_replace(text, r"[^\d.]", ""), F.lit(""))
    return F.coalesce(digits.try_cast("double"), F.lit(0.0))


def price_from_currency(text: Column) -> Column:
    """Drop `$` and `,`; missing is 0."""
    return F.coalesce(F.translate(text, "$,", "").try_cast("double"), F.lit(0.0))


def _split_cost(input_tokens: Column, output_tokens: Column, input_price: Column, output_price: Column) -> Column:
    return (input_price / F.lit(1000000)) * input_tokens + (output_price / F.lit(1000000)) * output_tokens


def _positive(price: Column) -> Column:
    return F.coalesce(price != 0, F.lit(False))


def token_cost(
    input_tokens: Column, output_tokens: Column, input_price: Column, output_price: Column, combined_price: Column
) -> Column:
    """Separate prices when both are non-zero, else the combined price on all tokens, else 0."""
    return (
        F.when(
            _positive(input_price) & _positive(output_price),
            _split_cost(input_tokens, output_tokens, input_price, output_price),
        )
        .when(
            _positive(combined_price), (combined_price / F.lit(1000000)) * (input_tokens + output_tokens)
        )
        .otherwise(F.lit(0.0))
    )


def cost_method(
    model: Column, is_known: Column, input_price: Column, output_price: Column, combined_price: Column
) -> Column:
    return (
        F.when(~is_known, F.concat(F.lit("Model "), model, F.lit(" not found in model data")))
        .when(_positive(input_price) & _positive(output_price), F.lit(SEPARATE))
        .when(_positive(combined_price), F.lit(COMBINED))
        .otherwise(F.lit(NO_PRICE))
    )


def token_cost_rounded(
    input_tokens: Column, output_tokens: Column, input_price: Column, output_price: Column
) -> Column:
    """Separate prices only, half-even to 2 places; 0 when one of them is missing."""
    cost = F.when(
        _positive(input_price) & _positive(output_price),
        _split_cost(input_tokens, output_tokens, input_price, output_price),
    ).otherwise(F.lit(0.0))
    return F.bround(cost, 2)
