"""The catalogue's logical schema and lenient decoding of list columns kept as JSON text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

STRINGS, VECTOR = T.ArrayType(T.StringType()), T.ArrayType(T.DoubleType())

BOOKS = T.StructType(
    [
        T.StructField("book_id", T.LongType(), False),
        T.StructField("title", T.StringType(), False),
        T.StructField("cover_image", T.StringType()),
        T.StructField("authors", STRINGS),
        T.StructField("publisher", T.StringType()),
        T.StructField("publication_date", T.DateType()),
        T.StructField("rating", T.DoubleType()),
        T.StructField("author_intro", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("book_intro", T.StringType()),
        T.StructField("also_like", STRINGS),
        T.StructField("short_reviews", STRINGS),
        T.StructField("reviews", STRINGS),
        T.StructField("reading_notes", STRINGS),
        T.StructField("keywords", STRINGS),
        T.StructField("embedding", VECTOR),
        T.StructField("keywords_embeddings", T.ArrayType(VECTOR)),
        T.StructField("domain_tags", STRINGS),
        T.StructField("price", T.DoubleType()),
    ]
)

#: columns under other names in older tables
ALIASES = {"books_intro": "book_intro", "URL": "url", "domain": "domain_tags"}


def decode_list(column: str | Column, element: T.DataType | None = None) -> Column:
    """A list from JSON text; null, empty, malformed, truncated and non-list text give an empty list."""
    kind = T.ArrayType(element or T.StringType())
    text = F.trim(F.col(column) if isinstance(column, str) else column)
    return F.coalesce(F.when(text.startswith("["), F.from_json(text, kind, {"allowSingleQuotes": "false"})), F.array().cast(kind))


def encode_list(column: str | Column) -> Column:
    """JSON text of a list; null stays null."""
    return F.to_json(F.col(column) if isinstance(column, str) else column)


def canonical(df: DataFrame) -> DataFrame:
    """The table under the canonical column names, list columns decoded where they are text, missing
    columns added as null, unknown ones dropped. Types are cast leniently: what does not parse is null."""
    present = {ALIASES.get(c, c): c for c in reversed(df.columns)}
    present |= {c: c for c in df.columns if c in BOOKS.fieldNames()}
    out = []
    for field in BOOKS:
        name = present.get(field.name)
        if name is None:
            value = F.lit(None).cast(field.dataType)
        elif isinstance(field.dataType, T.ArrayType) and isinstance(df.schema[name].dataType, T.StringType):
            value = decode_list(F.col(f"`{name}`"), field.dataType.elementType)
        elif df.schema[name].dataType == field.dataType:
            value = F.col(f"`{name}`")
        elif isinstance(df.schema[name].dataType, T.StringType):
            value = F.col(f"`{name}`").try_cast(field.dataType)
        else:
            value = F.col(f"`{name}`").cast(field.dataType)
        out.append(value.alias(field.name))
    return df.select(*out)


def with_feature_columns(df: DataFrame) -> DataFrame:
    """Schema evolution: the two vector columns, empty where the table lacks them."""
    for name in ("embedding", "keywords_embeddings"):
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast(BOOKS[name].dataType))
    return df
