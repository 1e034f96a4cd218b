"""Importance resampling towards a target distribution, in Spark's own functions throughout.

Texts are exploded into n-grams of their words, counted by hashed bucket over all documents and over all
target texts. Each bucket's gain (how much likelier the target uses it) comes from these counts in one
table of `buckets` rows, which is broadcast; a document's weight is the mean gain of its n-grams. A draw
without replacement takes the largest weights with Gumbel noise, which a hash of the id gives. Ranks come from a
distributed sort: rows are dealt out by ranges, numbered within each and shifted by the sizes of those before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import fresh, materialized

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def lowered(feature: Column) -> Column:
    """A-Z in lower case and nothing else changed; lower() is quicker where all is ASCII."""
    return F.when(F.octet_length(feature) == F.char_length(feature), F.lower(feature)).otherwise(F.translate(feature, _UPPER, _LOWER))


def words(text: Column) -> Column:
    """Runs of digits, letters and all beyond ASCII, as written; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), _BETWEEN), "")


def ngrams(found: Column, longest: int) -> Column:
    """All runs of 1 to `longest` words, joined by one space, repeats included."""
    run = lambda n: F.transform(F.sequence(F.lit(0), F.size(found) - n), lambda i: F.array_join(F.slice(found, i + 1, F.lit(n)), " "))
    return F.concat(found, *(F.when(F.size(found) >= n, run(n)).otherwise(F.array().cast("array<string>")) for n in range(2, longest + 1))) if longest > 1 else found


def bucket(feature: Column, buckets: int) -> Column:
    """The hashed bucket of an n-gram in lower case; null stays null."""
    return (F.crc32(lowered(feature).cast("binary")) % buckets).cast("int")


def gains(docs: DataFrame, target: DataFrame, text_col: str, target_col: str, longest: int, buckets: int) -> DataFrame:
    """(bucket, gain) of the buckets that documents use: floor(1000 ln((t + 1)(S + buckets) / ((s + 1)(T + buckets))))."""
    count = lambda rows, col, name: rows.select(F.explode(ngrams(words(F.col(col)), longest)).alias("f")).groupBy(bucket(F.col("f"), buckets).alias("bucket")).agg(F.count(F.lit(1)).alias(name))
    everything = Window.partitionBy()  # at most `buckets` rows
    s, t = count(docs, text_col, "s"), count(target, target_col, "t").withColumn("all_t", F.sum("t").over(everything))
    both = s.withColumn("all_s", F.sum("s").over(everything)).join(t, "bucket", "full")
    both = both.select("bucket", "s", F.coalesce("t", F.lit(0)).alias("t"), "all_s", F.coalesce(F.max("all_t").over(everything), F.lit(0)).alias("all_t")).where("s is not null")
    ratio = (F.col("t") + 1.0) * (F.col("all_s") + float(buckets)) / ((F.col("s") + 1.0) * (F.col("all_t") + float(buckets)))
    return both.select("bucket", F.floor(F.log(ratio) * 1000.0).cast("long").alias("gain"))


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", longest: int = 1, buckets: int = 10000, seed: str = "2024", least: int = 20, share: tuple[int, int] = (10, 100)) -> DataFrame:
    """(id_col, n_features, weight, score, rank) of every row of docs; rank is null where a row isn't drawn.

    Of the N rows with at least `least` words the floor(N x share) best scores are drawn, ties to the smaller
    id, then by a digest of the text. Null and empty texts have no features and weight 0; a null id hashes as
    an empty one and comes first among ties. Repeated rows keep their rows and rank one after the other. An empty target
    gives gains all the same (T and t are 0). Other columns are ignored.
    """
    text = F.col(text_col)
    digest = F.xxhash64(F.coalesce(text, F.lit("")), F.octet_length(text))
    # All that is computed from a text stands below the explode, which would compute it again for each n-gram. The null at
    # the front stands for the row itself, so that rows without features stay and repeated ones can be counted.
    rows = docs.select(F.col(id_col).alias("id"), digest.alias("digest"), words(text).alias("words"))
    rows = rows.select("id", "digest", F.size("words").alias("n_words"), F.concat(F.array(F.lit(None).cast("string")), ngrams(F.col("words"), longest)).alias("found"))
    long = rows.select("id", "digest", "n_words", F.explode("found").alias("f")).select("id", "digest", "n_words", bucket(F.col("f"), buckets).alias("bucket"))
    gain = gains(docs, target, text_col, target_col, longest, buckets)
    own = long.join(F.broadcast(gain), "bucket", "left").groupBy("id", "digest", "n_words").agg(F.sum("gain").alias("total"), F.count("bucket").alias("n"), F.sum(F.col("bucket").isNull().cast("long")).alias("copies"))
    own = own.select("id", "digest", "n_words", "copies", F.expr("n div copies").alias("n_features"), F.expr("coalesce(total div copies, 0)").alias("total"))
    own = own.withColumn("weight", F.expr("case when n_features = 0 then 0 else (total - pmod(total, n_features)) div n_features end"))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    own = own.withColumn("score", F.col("weight") + F.floor(F.log(-F.log((h + 0.5) / 4294967296.0)) * -1000.0))
    block = 1 << 16  # copies are told apart in blocks, so no array is longer
    own = own.withColumn("block", F.explode(F.expr(f"sequence(0, (copies - 1) div {block})"))).withColumn("copy", F.explode(F.expr(f"sequence(block * {block}, least(copies, (block + 1) * {block}) - 1)")))
    own = own.select("id", "n_features", "weight", "score", "digest", "copy", (F.col("n_words") < least).alias("short"))
    return ranked(own, ["short", F.desc("score"), F.asc_nulls_first("id"), "digest", "copy"], ~F.col("short"), share).select(F.col("id").alias(id_col), F.col("n_features").cast("long").alias("n_features"), F.col("weight").cast("long").alias("weight"), F.col("score").cast("long").alias("score"), "rank")


def ranked(rows: DataFrame, order: list, counted: Column, share: tuple[int, int]) -> DataFrame:
    """rows with rank, their place in the order if it is one of the first N x share, N the number of rows that are counted; those come first in the order.

    The ranges and the places in them are kept in a table, so later steps see one numbering only.
    """
    part, place, before, n = (fresh(rows, x) for x in ("part", "place", "before", "n"))
    within = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))  # the row's number within its partition
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = materialized(dealt.withColumn(part, F.spark_partition_id()).withColumn(place, within + 1))
    sizes = dealt.where(counted).groupBy(part).agg(F.count(F.lit(1)).alias(n))  # a row for each range
    sizes = sizes.select(part, (F.sum(n).over(Window.orderBy(part)) - F.col(n)).alias(before), F.sum(n).over(Window.partitionBy()).alias(n))
    at = F.col(before) + F.col(place)
    drawn = F.when(counted & (at <= F.expr(f"{n} * {share[0]} div {share[1]}")), at)
    return dealt.join(F.broadcast(sizes), part, "left").withColumn("rank", drawn).drop(part, place, before, n)
