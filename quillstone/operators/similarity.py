"""Pair scores: semantic and keyword similarity, weighted down by shared domain tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.config import Scoring
from quillstone.functions.vectors import best_pair, mean_vector, unit, unit_cosine, unit_matrix

FEATURES = ["unit", "kw_mean", "kw_units", "tags"]


def features(books: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """What pair scores need of a book, computed once: unit embedding, unit mean of its keyword vectors,
    their unit vectors, and its distinct tags."""
    tags = F.array_distinct(F.filter(F.coalesce("domain_tags", F.array().cast("array<string>")), lambda t: t.isNotNull()))
    return books.select(
        "book_id",
        *(keep or []),
        unit(F.col("embedding")).alias("unit"),
        unit(mean_vector(F.col("keywords_embeddings"))).alias("kw_mean"),
        unit_matrix(F.col("keywords_embeddings")).alias("kw_units"),
        tags.alias("tags"),
    )


def overlap_coefficient(shared: Column, either_empty: Column, beta: Column) -> Column:
    """1, 1 - beta, 1 - 2 beta or 0 for no, one, two or more shared tags; 1 if a list is empty."""
    return (
        F.when(either_empty | (shared == 0), F.lit(1.0))
        .when(shared == 1, 1.0 - beta)
        .when(shared == 2, 1.0 - 2.0 * beta)
        .otherwise(F.lit(0.0))
    )


def pair_columns(a: str, b: str, scoring: Scoring, beta: Column | None = None) -> dict[str, Column]:
    """The pair's scores, from feature columns under the prefixes ``a`` and ``b``."""
    x, y = (lambda n: F.col(f"{a}{n}")), (lambda n: F.col(f"{b}{n}"))
    beta = F.lit(scoring.beta) if beta is None else beta
    semantic = unit_cosine(x("unit"), y("unit"))
    mean = unit_cosine(x("kw_mean"), y("kw_mean"))
    best = best_pair(x("kw_units"), y("kw_units"))
    shared = F.size(F.array_intersect(x("tags"), y("tags")))
    coefficient = overlap_coefficient(shared, (F.size(x("tags")) == 0) | (F.size(y("tags")) == 0), beta)
    return {
        "semantic_similarity": semantic,
        "sim_avg": mean,
        "sim_max": best,
        "overlap_count": shared,
        "overlap_coefficient": coefficient,
    }


def score_pairs(pairs: DataFrame, a: str, b: str, scoring: Scoring, beta: Column | None = None) -> DataFrame:
    """``pairs`` with the scores and ``final_score``; every similarity is evaluated once."""
    columns = pair_columns(a, b, scoring, beta)
    mean, best = F.col("sim_avg"), F.col("sim_max")
    scored = pairs.withColumns({n: columns[n] for n in ("semantic_similarity", "sim_avg", "sim_max", "overlap_count", "overlap_coefficient")})
    scored = scored.withColumn("keyword_similarity", scoring.alpha * mean + (1 - scoring.alpha) * best)
    scored = scored.withColumn(
        "combined_similarity", scoring.a * F.col("semantic_similarity") + (1 - scoring.a) * F.col("keyword_similarity")
    )
    return scored.withColumn("final_score", F.col("combined_similarity") * F.col("overlap_coefficient"))


def prefixed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*[F.col(c).alias(f"{prefix}{c}") for c in df.columns])


def calculate_similarity(books: DataFrame, first: int, second: int, scoring: Scoring = Scoring()) -> DataFrame:
    """Scores of one pair of books; empty if one of them does not exist."""
    side = lambda i, p: prefixed(features(books.filter(F.col("book_id") == i)), p)
    pair = side(first, "a_").crossJoin(F.broadcast(side(second, "b_")))
    return score_pairs(pair, "a_", "b_", scoring).drop(*[f"{p}{c}" for p in ("a_", "b_") for c in FEATURES])
