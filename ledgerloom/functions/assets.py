"""Sides of an offer. An amount is a struct (currency, issuer, value); drops have no currency."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def number(value: Column) -> Column:
    """value as a finite double, else null."""
    n = value.try_cast("double")
    return F.when(~F.isnan(n) & (F.abs(n) < float("inf")), n)


def issued(amount: Column) -> Column:
    """Whether the amount names a currency and its issuer."""
    return F.coalesce((amount["currency"] != "") & (amount["issuer"] != ""), F.lit(False))


def side_key(amount: Column) -> Column:
    """XRP for drops, CUR:issuer for a valid currency code (three capitals or 16 hex digits), else null."""
    code = amount["currency"].rlike(r"^([A-Z]{3}|[0-9A-Fa-f]{16})$")
    drops = amount["currency"].isNull() & number(amount["value"]).isNotNull()
    return F.when(drops, "XRP").when(issued(amount) & code, F.concat_ws(":", amount["currency"], amount["issuer"]))


def side_value(amount: Column) -> Column:
    """Drops, or the issued value; null for what is neither. Only values of one pair compare."""
    return F.when(amount["currency"].isNull() | issued(amount), number(amount["value"]))


def fill_rate(gets: Column, pays: Column) -> Column:
    """Value of the larger side key over that of the smaller: the same for both directions of a pair. Null unless both are positive."""
    g, p = side_key(gets), side_key(pays)
    rate = F.when(g > p, side_value(gets) / side_value(pays)).when(g < p, side_value(pays) / side_value(gets))
    return F.when((side_value(gets) > 0) & (side_value(pays) > 0), rate)


def pays_same_asset(paths: Column, send_max: Column, amount: Column) -> Column:
    """Whether a payment to oneself changes no asset: no paths, and what may be sent at most is of the asset delivered."""
    same = amount["currency"].eqNullSafe(send_max["currency"]) & F.coalesce(amount["issuer"], F.lit("")).eqNullSafe(F.coalesce(send_max["issuer"], F.lit("")))
    return (F.coalesce(F.size(paths), F.lit(0)) <= 0) & (send_max.isNull() | same)
