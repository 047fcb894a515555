"""Prices, quantities and totals as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def money(x: Column) -> Column:
    """Two decimals, half up on the decimal text."""
    return F.round(x, 2)


def finite(x: Column) -> Column:
    """A number that can be shown; NaN and infinities are null."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def exact_sum(x: Column) -> Column:
    """Sum in whole cents, so that neither the order of rows nor the partitioning shows."""
    return F.sum(x.cast("decimal(18,2)")).cast("double")


def safe_float(text: Column) -> Column:
    """A number from text with thousands commas; missing words and anything else are null."""
    plain = F.regexp_replace(F.trim(text.cast("string")), ",", "")
    number = F.when(F.lower(plain).isin("", "nan", "none", "null", "--", "-", "inf", "-inf", "infinity", "-infinity", "+infinity", "+inf"), None).otherwise(plain.try_cast("double"))
    return F.when(F.isnan(number), None).otherwise(number)


def safe_text(text: Column) -> Column:
    """Trimmed text; missing words are ''."""
    plain = F.trim(F.coalesce(text.cast("string"), F.lit("")))
    return F.when(F.lower(plain).isin("nan", "none", "null"), "").otherwise(plain)


def quantity_text(text: Column) -> Column:
    """A quantity for show: a whole number without decimals, else the number, else the text itself."""
    number = safe_float(text)
    return F.when(number.isNull(), safe_text(text)).when(number == F.floor(number), F.floor(number).cast("string")).otherwise(number.cast("string"))


def adjusted(price: Column, kind: str, value: float) -> Column:
    """A price after a markup or markdown in percent or a fixed sum; a fixed markdown stops at 0."""
    changed = {
        "markup": lambda: price * (1 + value / 100),
        "markdown": lambda: price * (1 - value / 100),
        "fixed_markup": lambda: price + value,
        "fixed_markdown": lambda: F.greatest(F.lit(0.0), price - value),
    }
    if kind not in changed:
        raise ValueError(f"unknown price adjustment {kind!r}")
    return money(changed[kind]())


def export_price(action: Column, market: Column, cost: Column, price_type: str = "market", adjustment: tuple[str, float] | None = None, scope: Column | None = None) -> Column:
    """The price a document shows for a selected line, null where it is blank.

    scope, off by default, restricts an adjustment to the lines where it holds.
    """
    market, cost = F.coalesce(market, F.lit(0.0)), F.coalesce(cost, F.lit(0.0))
    plain = F.when(market > 0, market)
    if price_type == "cost":
        price = F.when(cost > 0, cost)
    elif price_type == "adjusted" and adjustment:
        price = adjusted(market, *adjustment)
        price = price if scope is None else F.when(scope, price).otherwise(plain)
    else:
        price = plain
    return F.when(action == "select", price)


def line_total(quantity: Column, price: Column) -> Column:
    """Quantity times price; null if either is missing or the price is 0."""
    return F.when(price != 0, money(quantity * price))


def profit(price: Column, cost: Column) -> Column:
    return F.when((cost > 0) & (price != 0), money(price - cost))


def margin(price: Column, cost: Column) -> Column:
    """Profit in percent of cost, one decimal."""
    return F.round(profit(price, cost) / cost * 100, 1)


_DIGITS = "零壹贰叁肆伍陆柒捌玖"
_SMALL = ["", "拾", "佰", "仟"]
_LARGE = ["", "万", "亿", "兆"]


def amount_in_capitals(amount: Column) -> Column:
    """An amount in Chinese capitals, by sections of four digits; 零元整 for nothing.

    Every section is written by one expression over its digits; a section below
    1000, or an empty one, puts one 零 before the section under it.
    """
    cents = F.round(amount * 100, 0).cast("long")
    rest = cents % 100
    whole = F.floor(cents / 100).cast("long")
    digit = lambda n: F.substring(F.lit(_DIGITS), n.cast("int") + 1, F.lit(1))

    def section(s: Column) -> Column:
        out = F.lit("")
        for place in (3, 2, 1, 0):
            d = F.floor(s / 10**place).cast("long") % 10
            higher, lower = F.floor(s / 10 ** (place + 1)) > 0, F.floor(s / 10**place).cast("long") % 10 != 0
            gap = higher & (F.floor(s / 10 ** (place + 1)).cast("long") % 10 == 0) & lower
            out = F.concat(out, F.when(gap, _DIGITS[0]).otherwise(""), F.when(lower, F.concat(digit(d), F.lit(_SMALL[place]))).otherwise(""))
        return out

    text = F.lit("")
    for place in (3, 2, 1, 0):
        own = F.floor(whole / 10000**place).cast("long") % 10000
        above = F.floor(whole / 10000 ** (place + 1)) > 0
        # one 零 stands before a section whose thousands are 0, or that follows an empty one
        after_empty = above & (F.floor(whole / 10000 ** (place + 1)).cast("long") % 10000 == 0)
        lead = (own < 1000) & above | after_empty
        text = F.concat(text, F.when(own > 0, F.concat(F.when(lead, _DIGITS[0]).otherwise(""), section(own), F.lit(_LARGE[place]))).otherwise(""))
    jiao, fen = F.floor(rest / 10).cast("long"), rest % 10
    small = F.concat(
        F.when(jiao > 0, F.concat(digit(jiao), F.lit("角"))).otherwise(""),
        F.when(fen > 0, F.concat(F.when(jiao == 0, _DIGITS[0]).otherwise(""), digit(fen), F.lit("分"))).otherwise(""),
    )
    return F.when(cents == 0, "零元整").otherwise(F.concat(F.when(whole == 0, _DIGITS[0]).otherwise(text), F.lit("元"), F.when(small == "", "整").otherwise(small)))
