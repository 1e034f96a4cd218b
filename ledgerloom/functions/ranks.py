"""Severity and role ranks, as columns."""

from pyspark.sql import Column, functions as F

#: Severities and roles in ascending order.
SEVERITIES = ["info", "suspect", "malicious"]
ROLES = ["unknown", "relay", "source", "collector", "drainer"]


def rank_of(value: Column, order: list[str]) -> Column:
    """1 for the first of order; unknown values count as the first."""
    out = F.lit(1)
    for k, name in enumerate(order[1:], 2):
        out = F.when(value == name, k).otherwise(out)
    return out.cast("bigint")


def name_of(rank: Column, order: list[str]) -> Column:
    return F.element_at(F.array(*(F.lit(x) for x in order)), rank.cast("int"))


def epoch_label(n: Column) -> Column:
    """A..Z, AA.. for 0, 1, 2, ..: bijective base 26, up to three letters."""
    letter = lambda k: F.char((k % 26 + 65).cast("int"))
    return (
        F.when(n < 26, letter(n))
        .when(n < 702, F.concat(letter(F.floor(n / 26) - 1), letter(n)))
        .otherwise(F.concat(letter(F.floor((n - 702) / 676)), letter(F.floor((n - 702) / 26)), letter(n - 702)))
    )
