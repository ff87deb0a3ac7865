"""Catalogue queries: pages, search, detail, statistics and display columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIST = ["book_id", "title", "cover_image", "authors", "publisher", "publication_date", "rating", "book_intro", "domain_tags"]
DETAIL = [*LIST, "author_intro", "url", "also_like", "short_reviews", "reviews", "reading_notes"]
ORDERS = {"rating": "rating", "newest": "publication_date"}


def matches(search: str) -> Column:
    """Title or an author contains the text, in any case; % and _ in it are wildcards, a backslash is itself."""
    pattern = "%" + search.lower().replace("\\", "\\\\") + "%"
    return F.coalesce(F.lower("title").like(pattern), F.lit(False)) | F.coalesce(F.exists("authors", lambda a: F.lower(a).like(pattern)), F.lit(False))


def order_by(order: str | None) -> list[Column]:
    """rating or newest, largest first and missing last; anything else by id."""
    column = ORDERS.get(order or "")
    return [*([F.desc_nulls_last(column)] if column else []), F.asc("book_id")]


def page(books: DataFrame, number: int = 1, per_page: int = 20, order: str | None = None, search: str | None = None) -> DataFrame:
    if number < 1 or per_page < 1:
        raise ValueError("page and per_page start at 1")
    found = books if not search else books.filter(matches(search))
    return found.select(*LIST).orderBy(*order_by(order)).offset((number - 1) * per_page).limit(per_page)


def page_after(books: DataFrame, last: tuple | None = None, per_page: int = 20, order: str | None = None, search: str | None = None) -> DataFrame:
    """The page that follows the row ``last``: (id,) or, with an order, (value, id) of the page before; the first
    page without. However deep, only one page of rows is kept, where ``page`` keeps all before it as well."""
    found = books if not search else books.filter(matches(search))
    column = ORDERS.get(order or "")
    if last is not None:
        after = F.col("book_id") > last[-1]
        if column and last[0] is None:
            after = F.col(column).isNull() & after
        elif column:
            value = F.lit(last[0])
            after = (F.col(column) < value) | F.col(column).isNull() | ((F.col(column) == value) & after)
        found = found.filter(after)
    return found.select(*LIST).orderBy(*order_by(order)).limit(per_page)


def count(books: DataFrame, search: str | None = None, per_page: int = 20) -> DataFrame:
    """One row: total and the number of pages."""
    found = books if not search else books.filter(matches(search))
    return found.agg(F.count("*").alias("total")).withColumn("pages", F.ceil(F.col("total") / per_page))


def detail(books: DataFrame, book_id: int | Column) -> DataFrame:
    """The book's columns; empty if there is none. List columns are never null."""
    kinds = {c: F.coalesce(c, F.array().cast("array<string>")).alias(c) for c in ("authors", "also_like", "short_reviews", "reviews", "reading_notes", "domain_tags")}
    return books.filter(F.col("book_id") == book_id).select(*[kinds.get(c, F.col(c)) for c in DETAIL])


def hot_list(books: DataFrame, k: int = 8) -> DataFrame:
    return page(books, 1, k, "rating")


def statistics(books: DataFrame) -> DataFrame:
    """One row: number of books, mean known rating (0 if none), number of distinct tags."""
    totals = books.agg(F.count("*").alias("total_books"), F.coalesce(F.round(F.avg("rating"), 2), F.lit(0.0)).alias("average_rating"))
    tags = books.select(F.explode("domain_tags").alias("tag")).agg(F.count_distinct("tag").alias("total_domains"))
    return totals.crossJoin(F.broadcast(tags))


def tag_statistics(books: DataFrame) -> DataFrame:
    """(tag, n, percent of books), largest first; percents add up to more than 100 where books have two."""
    total = books.agg(F.count("*").alias("total"))
    counts = books.select(F.explode("domain_tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))
    return counts.crossJoin(F.broadcast(total)).select("tag", "n", F.round(F.col("n") / F.col("total") * 100, 2).alias("percent")).orderBy(F.desc("n"), "tag")


def selected_first(rows: DataFrame, book_id: int, order: str | None = None) -> DataFrame:
    """The page with one book moved to its front."""
    return rows.orderBy(F.desc(F.col("book_id") == book_id), *order_by(order))


def display(rows: DataFrame, unknown: str = "unknown") -> DataFrame:
    """First three tags, first author and all authors as text."""
    authors = F.filter(F.coalesce("authors", F.array().cast("array<string>")), lambda a: F.length(F.trim(a)) > 0)
    return rows.select(
        "book_id",
        F.array_join(F.slice(F.coalesce("domain_tags", F.array().cast("array<string>")), 1, 3), ", ").alias("shown_tags"),
        F.coalesce(F.get(authors, F.lit(0)), F.lit(unknown)).alias("first_author"),
        F.when(F.size(authors) > 0, F.array_join(authors, ", ")).otherwise(unknown).alias("all_authors"),
    )


def display_scores(rows: DataFrame, mode: str = "comprehensive") -> DataFrame:
    """The score a mode shows, as a percentage with one decimal, and the overlap badge; 0 falls through."""
    main = "similarity_score" if mode == "similarity" else "utility_score"
    shown = F.coalesce(F.nullif(F.col(main), F.lit(0.0)), F.col("final_score"), F.lit(0.0))
    return rows.select(
        "book_id",
        F.format_string("%.1f%%", shown * 100).alias("shown_score"),
        F.when(F.col("overlap_count") == 0, "fully cross-domain").otherwise("partially cross-domain").alias("badge"),
    )


def page_window(current: int, pages: int, reach: int = 2) -> list[int | None]:
    """Page numbers to offer: first, last and those near the current one; None marks a gap."""
    near = sorted({1, pages, *range(max(1, current - reach), min(pages, current + reach) + 1)} & set(range(1, pages + 1)))
    out: list[int | None] = []
    for p in near:
        if out and out[-1] is not None and p > out[-1] + 1:
            out.append(None)
        out.append(p)
    return out
