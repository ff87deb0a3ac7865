"""One ranking from several differently-scaled scores.

Method: leximin. Within each group every score becomes a percentile (the share of the group's known
values below, plus half of those equal), so its scale and shape no longer matter. An item's
percentiles, sorted ascending, form its vector; vectors are compared lexicographically, largest
first. The weakest score decides, so no strong score can mask it; among equals the next weakest.

A group may hold a third of all rows, so no group is ever ranked in one task. Values are first
aggregated to distinct ones with their frequency and laid out in ranges over (group, score, value)
across partitions; each range counts for itself, and the counts of the ranges before it in the same
group, a few rows per range, are added. Final ranks are found in the same way. Percentiles return to
the items by a join on group and value: values that more than one item in a thousand has are few (a
thousand per score at most) and are broadcast, and items that need no join any more, or have no value,
are spread by their hash, so no common value and no gap is a hot key.

Cases: a null or non-finite score, or one the caller has set to null as a placeholder, stands at the
middle (0.5) and takes no part in the others' percentiles; a single known value has percentile 0.5;
rows repeated under one id are ranked once; ties rank by id; null groups are a group of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions.dates import parse_date
from quillstone.storage import cut


def ranges(df: DataFrame, keys: list[str], order: list, name: str) -> DataFrame:
    """``df`` laid out in ranges over keys and order, its partition as ``range``; hot keys span several."""
    return cut(df.repartitionByRange(*[F.col(k) for k in keys], *order).withColumn("range", F.spark_partition_id()), name)


def counted_before(df: DataFrame, keys: list[str], order: list, weight: str, name: str) -> DataFrame:
    """``df`` with ``before``, the weight of the rows of the same keys ahead in the order (ties excluded by
    the caller: rows must differ in order), and ``total``, the weight of all rows of the keys."""
    laid = ranges(df, keys, order, name)
    parts = laid.groupBy(*keys, "range").agg(F.sum(weight).alias("part"))
    by_key = Window.partitionBy(*keys)
    ahead = by_key.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("earlier", F.coalesce(F.sum("part").over(ahead), F.lit(0))).withColumn("total", F.sum("part").over(by_key))
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"p.{k}")) for k in [*keys, "range"]]
    within = Window.partitionBy(*keys, "range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = laid.withColumn("inside", F.coalesce(F.sum(weight).over(within), F.lit(0)))
    condition = same[0]
    for c in same[1:]:
        condition = condition & c
    joined = own.alias("l").join(parts.alias("p"), condition)
    return joined.select("l.*", (F.col("l.inside") + F.col("p.earlier")).alias("before"), "p.total").drop("inside", "range")


def leximin(items: DataFrame, group: str, item: str, scores: list[str], common: int = 10_000) -> DataFrame:
    """(group, item, percentiles, vector, rank): ``percentiles`` in the order of ``scores``, ``vector`` ascending.

    ``common`` is the least number of items from which a value counts as common."""
    def known(c: str):
        value = F.col(c).cast("double")
        return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value + 0.0)

    items = cut(items.select(group, item, *[known(c).alias(c) for c in scores]).dropDuplicates([item]), "scored")
    long = items.select(group, F.posexplode(F.array(*scores)).alias("score", "value")).filter("value is not null")
    values = long.groupBy(group, "score", "value").agg(F.count("*").alias("n"))
    placed = counted_before(values, [group, "score"], [F.col("value")], "n", "values")
    share = placed.select(group, "score", "value", "n", ((F.col("before") + F.col("n") / 2) / F.col("total")).alias("percentile"))
    share = cut(share, "percentiles")
    hot = F.col("n") > max(common, items.count() // 1_000)
    out = items
    for i, c in enumerate(scores):
        given = share.filter(F.col("score") == i)
        names = lambda v, p: (F.col(group).alias("__g"), F.col("value").alias(v), F.col("percentile").alias(p))
        often = F.broadcast(given.filter(hot).select(*names("__h", "__q")))
        out = out.join(often, F.col(group).eqNullSafe(F.col("__g")) & (F.col(c) == F.col("__h")), "left").drop("__g", "__h")
        # rows with nothing to look up get a salt that no value has
        done = F.col(c).isNull() | F.col("__q").isNotNull()
        salt = F.when(done, 1 + F.pmod(F.xxhash64(item), F.lit(1 << 20))).otherwise(0)
        rare = given.filter(~hot).select(*names("__v", "__r"), F.lit(0).cast("long").alias("__z"))
        out = out.withColumn("__s", salt).join(rare, F.col(group).eqNullSafe(F.col("__g")) & (F.coalesce(c, F.lit(0.0)) == F.col("__v")) & (F.col("__s") == F.col("__z")), "left")
        out = out.withColumn(f"__p{i}", F.coalesce("__q", "__r")).drop("__g", "__v", "__z", "__q", "__r", "__s")
    percentiles = F.array(*[F.round(F.coalesce(f"__p{i}", F.lit(0.5)), 9) for i in range(len(scores))])
    out = out.select(group, item, percentiles.alias("percentiles")).withColumn("vector", F.array_sort("percentiles")).withColumn("one", F.lit(1))
    order = [F.desc("vector"), F.asc(item)]
    return counted_before(out, [group], order, "one", "ranks").select(group, item, "percentiles", "vector", (F.col("before") + 1).alias("rank"))


def candidate_scores(recommendations: DataFrame, books: DataFrame) -> DataFrame:
    """Candidates with their scores on one footing: placeholders (a zero rating, a date before 1901 or
    after the request) are null, and gaps are filled from the book itself."""
    book = books.dropDuplicates(["book_id"]).select(
        "book_id", F.col("rating").alias("book_rating"), F.col("publication_date").alias("book_date")
    )
    text = F.trim("publication_date")
    joined = recommendations.withColumn("date", parse_date(text, iso_prefix=True)).join(book, "book_id", "left")
    usual = lambda d: F.when((d >= F.lit("1901-01-01").cast("date")) & (d <= F.coalesce(F.to_date("requested_at"), F.lit("9999-12-31").cast("date"))), d)
    rated = lambda r: F.when(r > 0, r)
    return joined.select(
        "rec_id",
        "target_book_id",
        "book_id",
        "final_score",
        F.coalesce(rated(F.col("rating")), rated(F.col("book_rating"))).alias("rating"),
        F.unix_date(F.coalesce(usual(F.col("date")), usual(F.col("book_date")))).alias("published"),
    )


def catalogue_scores(books: DataFrame, as_of: str) -> DataFrame:
    """Books with rating, publication date and number of reviews; placeholders as null."""
    published = F.when(F.col("publication_date").between(F.lit("1901-01-01").cast("date"), F.lit(as_of).cast("date")), F.unix_date("publication_date"))
    return books.select(
        F.lit("all").alias("catalogue"),
        "book_id",
        F.when(F.col("rating") > 0, F.col("rating")).alias("rating"),
        published.alias("published"),
        F.size(F.coalesce("reviews", F.array())).alias("reviews"),
    )
