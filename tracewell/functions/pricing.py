"""Prices and request cost as Column expressions (when-chains stay inside codegen)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracewell import rules as R


def _price(model: Column, which: int, prices) -> Column:
    name = F.regexp_replace(F.coalesce(model, F.lit("")), r"^(us\.|eu\.)?anthropic\.", "")
    chain = None
    for row in prices:
        hit = name.startswith(row[0])
        chain = F.when(hit, row[which]) if chain is None else chain.when(hit, row[which])
    chain = chain.when(name.rlike("^gemini-.*flash"), R.GEMINI_FLASH_PRICE[which - 1])
    chain = chain.when(name.startswith("gemini-"), R.GEMINI_PRICE[which - 1])
    return chain.otherwise(R.DEFAULT_PRICE[which - 1]).cast("double")


def input_price(model: Column, prices=R.PRICES) -> Column:
    return _price(model, 1, prices)


def output_price(model: Column, prices=R.PRICES) -> Column:
    return _price(model, 2, prices)


def zero(c: Column) -> Column:
    """A missing counter counts as zero."""
    return F.coalesce(c, F.lit(0).cast("bigint"))


def cache_write_mult(creation: Column, one_hour: Column) -> Column:
    """Write price multiple, weighted by how much went to the one-hour tier."""
    total, hour = zero(creation), zero(one_hour)
    short = F.greatest(F.lit(0).cast("bigint"), total - hour)
    mixed = (hour * R.CACHE_WRITE_1H_MULT + short * R.CACHE_WRITE_5M_MULT) / total
    return F.when((total == 0) | (hour == 0), F.lit(R.CACHE_WRITE_5M_MULT)).otherwise(mixed)


def request_cost(model, inp, read, creation, one_hour, out, prices=R.PRICES) -> Column:
    """Dollars for one request from its four counters."""
    p = input_price(model, prices)
    return (
        zero(inp) * p
        + zero(read) * p * R.CACHE_READ_MULT
        + zero(creation) * p * cache_write_mult(creation, one_hour)
        + zero(out) * output_price(model, prices)
    ) / 1e6


def cache_savings(model, read, prices=R.PRICES) -> Column:
    """Dollars not paid because ``read`` tokens came from the cache."""
    return zero(read) * input_price(model, prices) * (1 - R.CACHE_READ_MULT) / 1e6


def cold_cost(tokens: Column, model: Column, one_hour: Column) -> Column:
    mult = F.when(one_hour, R.CACHE_WRITE_1H_MULT).otherwise(R.CACHE_WRITE_5M_MULT)
    return tokens * input_price(model) * mult / 1e6


def warm_cost(tokens: Column, model: Column) -> Column:
    return tokens * input_price(model) * R.CACHE_READ_MULT / 1e6
