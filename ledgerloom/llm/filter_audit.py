"""Interaction audit of a set of filters: what each removes, in every order, beside the others.

Every text gets a mask of the filters that it fails; masks are counted by part, so that what follows has
at most 2 ** filters cells a part. Cells are unpivoted against the steps of every order; a running bit-or over the
steps tells what earlier filters removed, conditional sums give the counts of each step, and totals over all orders
each filter's Shapley sum.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import permutations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import materialized

_WORDS = r"[\x20\x09-\x0D]+"


def too_short(least: int = 200) -> Callable[[Column, Column], Column]:
    return lambda text, words: F.size(words) < least


def repetitive(percent: int = 50) -> Callable[[Column, Column], Column]:
    """Distinct words, case-sensitive, below a share of all."""
    return lambda text, words: F.size(F.array_distinct(words)) * 100 < F.size(words) * percent


def shouting(percent: int = 2) -> Callable[[Column, Column], Column]:
    """A-Z above a share of the code points."""
    return lambda text, words: F.char_length(F.regexp_replace(text, "[^A-Z]+", "")) * 100 > F.char_length(text) * percent


def has_signs(signs: str = "[#$%&*|]") -> Callable[[Column, Column], Column]:
    return lambda text, words: text.rlike(signs)


#: Name of a filter to its failure condition on a text and its words; COPIES stands for texts that a smaller id has too.
COPIES = "copies"
FILTERS: dict[str, Callable[[Column, Column], Column] | str] = {"A": too_short(), "B": repetitive(), "C": shouting(), "D": has_signs(), "E": COPIES}


def masks(docs: DataFrame, filters: dict, id_col: str, text_col: str, part_col: str) -> DataFrame:
    """(id, part, mask) of every row: bit k is set if the k-th filter fails. Kept in the shared folder, without texts.

    Copies are found by SHA-256 over the whole table: the smallest id of each text is one row a text, joined back
    in a join whose large partitions Spark can split.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    kinds = list(filters.values())
    mask = F.lit(0)
    for k, f in enumerate(kinds):
        if f != COPIES:
            mask = mask + F.when(f(F.col("text"), F.col("words")), F.lit(1 << k)).otherwise(0)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("text"), F.array_remove(F.split(text, _WORDS), "").alias("words"))
    rows = rows.select("id", "part", mask.alias("mask"), F.unhex(F.sha2("text", 256)).alias("digest"))
    if COPIES not in kinds:
        return materialized(rows.drop("digest"))
    rows = materialized(rows)
    first = materialized(rows.groupBy("digest").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").drop("last"))
    copy = F.when(F.col("id") > F.col("first"), F.lit(sum(1 << k for k, f in enumerate(kinds) if f == COPIES))).otherwise(0)
    return rows.join(first, "digest", "left").select("id", "part", (F.col("mask") + copy).alias("mask"))


def unpivoted(cells: DataFrame, names: list[str]) -> DataFrame:
    """cells with filter_order, step, filter and bit, a row for each step of each order of the filters."""
    orders = F.split(F.lit("\x1e".join(map("\x1f".join, permutations(names)))), "\x1e")
    long = cells.select("*", F.explode(orders).alias("order")).select("*", F.posexplode(F.split("order", "\x1f")).alias("step", "filter"))
    long = long.withColumn("place", F.array_position(F.lit(names), F.col("filter")).cast("int"))
    return long.select(*cells.columns, F.replace("order", F.lit("\x1f"), F.lit("")).alias("filter_order"), (F.col("step") + 1).alias("step"), "filter", F.expr("shiftleft(1, place - 1)").alias("bit"))


def audit(docs: DataFrame, labels: DataFrame, filters: dict | None = None, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source", most: int = 6) -> DataFrame:
    """(part, filter_order, step, filter, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley), a row for each part, order and step.

    filters are applied from the left in each of their orders; more than `most` are refused, as orders grow with the factorial.
    A part is a value of part_col, null counting as the empty string; zero counts are there too, and no rows come of an empty table.
    Null texts are empty. A row is good (toxic) if any label of its id has quality (toxic) 1; null ids have no labels, copy
    nothing and are copied by none. Rows with one id and one text are not copies of each other. Other columns are ignored.
    """
    filters = FILTERS if filters is None else filters
    if not 0 < len(filters) <= most:
        raise ValueError(f"1 to {most} filters are wanted")
    names = list(filters)
    known = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    rows = materialized(masks(docs, filters, id_col, text_col, part_col)).join(materialized(known), "id", "left")
    count = lambda hit: F.coalesce(F.sum(F.when(hit, F.col("n"))), F.lit(0))
    cells = rows.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("good") == 1, 1)).alias("good"), F.count(F.when(F.col("toxic") == 1, 1)).alias("toxic"))
    # At most 2 ** filters cells a part, each against the steps of all orders.
    long = unpivoted(cells, names)
    earlier = Window.partitionBy("part", "filter_order", "mask").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    long = long.withColumn("gone", F.col("mask").bitwiseAND(F.coalesce(F.bit_or("bit").over(earlier), F.lit(0))) != 0).withColumn("fails", F.col("mask").bitwiseAND(F.col("bit")) != 0)
    removed = F.col("fails") & ~F.col("gone")
    lost = lambda n: F.coalesce(F.sum(F.when(removed, F.col(n))), F.lit(0)).alias(f"{n}_lost")
    per = long.groupBy("part", "filter_order", "step", "filter").agg(
        count(~F.col("gone") & ~F.col("fails")).alias("kept"), count(removed).alias("removed"), count(F.col("fails") & F.col("gone")).alias("redundant"), count(F.col("mask") == F.col("bit")).alias("unique_fails"), lost("good"), lost("toxic")
    )
    return per.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "filter")))
