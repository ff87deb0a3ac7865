"""Utility, ranking modes, and filtered ranking of recommendation rows.

Ties never depend on the order of a scan: every mode ends with final_score and book_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions.dates import parse_date

#: mode -> what it orders by, largest first, nulls last
MODES: dict[str, tuple[str, str]] = {
    "comprehensive": ("utility_score", "weighted utility of similarity, rating and recency"),
    "similarity": ("similarity_score", "similarity alone"),
    "rating": ("rating", "readers' rating"),
    "newest": ("publication_date", "latest publication first"),
    "final": ("final_score", "the retrieval score itself"),
}


def normalised_rating(rating: Column) -> Column:
    return F.coalesce(rating, F.lit(0.0)) / 10.0


def freshness(published: Column, as_of: Column) -> Column:
    """1 today, falling to 0 over thirty years; 0 for a missing date; a future date exceeds 1."""
    age = F.datediff(as_of, published) / 365.25
    return F.coalesce(F.greatest(F.lit(0.0), 1.0 - age / 30.0), F.lit(0.0))


def with_utility(rows: DataFrame, as_of: str, parity: bool = False) -> DataFrame:
    """Adds similarity_score, normalised_rating, freshness and utility_score to scored candidates.

    ``parity`` ranks candidates that were not filtered for crossing domains as if they had no
    similarity, as the served scorer does."""
    similarity = F.lit(0.0) if parity else F.col("combined_similarity") * F.col("overlap_coefficient")
    day = F.lit(as_of).cast("date")
    return rows.withColumns(
        {
            "similarity_score": similarity,
            "normalised_rating": normalised_rating(F.col("rating")),
            "freshness": freshness(F.col("publication_date"), day),
        }
    ).withColumn("utility_score", 0.7 * F.col("similarity_score") + 0.2 * F.col("normalised_rating") + 0.1 * F.col("freshness"))


def order_of(mode: str, columns: list[str], strict: bool = True, tie: str = "book_id") -> list[Column]:
    """Sort columns of a mode; an unknown mode is an error, or ``comprehensive`` if not strict."""
    if mode not in MODES:
        if strict:
            raise ValueError(f"unknown mode {mode!r}; one of {', '.join(MODES)}")
        mode = "comprehensive"
    key = F.col(MODES[mode][0])
    if mode == "rating":
        key = F.coalesce(key, F.lit(0.0))
    elif mode == "similarity":
        parts = [c for c in ("similarity_score", "final_score") if c in columns]
        key = F.coalesce(*map(F.col, parts), F.lit(0.0))
    elif mode != "newest":
        key = F.coalesce(key, F.lit(0.0))
    order = [F.desc_nulls_last(key)]
    if "final_score" in columns:
        order.append(F.desc_nulls_last("final_score"))
    return [*order, F.asc(tie)]


def rank(rows: DataFrame, mode: str = "comprehensive", k: int | None = None, strict: bool = True) -> DataFrame:
    ranked = rows.orderBy(*order_of(mode, rows.columns, strict))
    return ranked if k is None else ranked.limit(k)


def filled(rows: DataFrame) -> DataFrame:
    """Missing scores and ratings as 0, missing or unreadable dates as 1900-01-01."""
    date = F.col("publication_date")
    parsed = parse_date(date) if rows.schema["publication_date"].dataType.simpleString() == "string" else date
    return rows.withColumns(
        {
            "final_score": F.coalesce("final_score", F.lit(0.0)),
            "rating": F.coalesce("rating", F.lit(0.0)),
            "publication_date": F.coalesce(parsed, F.lit("1900-01-01").cast("date")),
        }
    )


def keep_if(rows: DataFrame, min_rating: float | None = None, max_price: float | None = None) -> DataFrame:
    """Rows with at least the rating (a missing one is 0) and at most the price (a missing one passes)."""
    if min_rating is not None:
        rows = rows.filter(F.coalesce("rating", F.lit(0.0)) >= min_rating)
    if max_price is not None:
        rows = rows.filter(F.coalesce("price", F.lit(0.0)) <= max_price)
    return rows


def filtered_rank(rows: DataFrame, mode: str = "final", min_rating: float | None = None, max_price: float | None = None) -> DataFrame:
    """Filters, fills and ranks plain recommendation rows by final, rating or newest."""
    return rank(filled(keep_if(rows, min_rating, max_price)), mode)


def modes(spark: SparkSession) -> DataFrame:
    """Catalogue of the modes."""
    return spark.createDataFrame([(m, c, d) for m, (c, d) in MODES.items()], "mode string, orders_by string, description string")
