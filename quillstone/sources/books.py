"""Sources and sinks of the catalogue.

Options come from the caller, and for databases otherwise from the environment (QUILLSTONE_URL,
QUILLSTONE_USER, QUILLSTONE_PASSWORD, QUILLSTONE_TABLE); no credential is kept in code.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstone.schema import BOOKS, canonical, encode_list
from quillstone.storage import own_dir

FILES = ("parquet", "orc", "json", "csv")
DATABASES = ("mysql", "postgresql", "jdbc")


def _options(given: dict[str, str] | None) -> dict[str, str]:
    env = {k: os.environ[v] for k, v in (("url", "QUILLSTONE_URL"), ("user", "QUILLSTONE_USER"), ("password", "QUILLSTONE_PASSWORD"), ("dbtable", "QUILLSTONE_TABLE")) if v in os.environ}
    return env | (given or {})


def read_books(spark: SparkSession, kind: str = "parquet", options: dict[str, str] | None = None, partitions: int | None = None) -> DataFrame:
    """The catalogue under its canonical schema from files, a database or a document store.

    ``options`` are the reader's; files name their ``path``. With ``partitions`` a database is read in
    that many ranges of book_id, between its own bounds unless lowerBound and upperBound are given."""
    if kind in FILES:
        given = dict(options or {})
        path = given.pop("path")
        reader = spark.read.options(**given)
        if kind == "csv":
            reader = reader.option("header", given.get("header", "true")).option("multiLine", "true").option("escape", '"')
        if kind == "json":
            reader = reader.option("mode", given.get("mode", "PERMISSIVE"))
        return canonical(reader.format(kind).load(path))
    if kind in DATABASES:
        given = _options(options)
        loaded = spark.read.format("jdbc").options(**given).load()
        if partitions:
            key = next(c for c in loaded.columns if c.lower() == "book_id")
            if "lowerBound" not in given:
                lo, hi = loaded.agg(F.min(key), F.max(key)).first()
                given |= {"lowerBound": str(lo or 0), "upperBound": str((hi or 0) + 1)}
            given |= {"partitionColumn": key, "numPartitions": str(partitions)}
            loaded = spark.read.format("jdbc").options(**given).load()
        return canonical(loaded.toDF(*[c.lower() for c in loaded.columns]))
    if kind == "mongodb":
        return canonical(spark.read.format("mongodb").options(**_options(options)).load().drop("_id"))
    raise ValueError(f"unknown source {kind!r}; one of {', '.join((*FILES, *DATABASES, 'mongodb'))}")


def as_text_columns(books: DataFrame) -> DataFrame:
    """List columns as JSON text, for stores without arrays."""
    return books.select(*[encode_list(f.name).alias(f.name) if isinstance(f.dataType, T.ArrayType) else F.col(f.name) for f in books.schema])


def write_books(books: DataFrame, kind: str = "parquet", options: dict[str, str] | None = None, mode: str = "overwrite") -> None:
    """Writes the table. Overwritten files go to a staging folder and are swapped in at the end, so a
    failure midway loses nothing; a database table is truncated and filled in one transaction per
    partition, or appended to with mode ``append``."""
    if kind in FILES:
        given = dict(options or {})
        path = given.pop("path")
        data = as_text_columns(books) if kind == "csv" else books
        writer = data.write.format(kind).options(**(({"header": "true", "escape": '"'} if kind == "csv" else {}) | given))
        if mode != "overwrite":
            writer.mode(mode).save(path)
            return
        staging = f"{path.rstrip('/')}.staging-{uuid.uuid4().hex}"
        writer.save(staging)
        _swap(books.sparkSession, staging, path)
        return
    if kind in DATABASES:
        as_text_columns(books).write.format("jdbc").options(**({"truncate": "true"} | _options(options))).mode(mode).save()
        return
    if kind == "mongodb":
        books.write.format("mongodb").options(**_options(options)).mode(mode).save()
        return
    raise ValueError(f"unknown target {kind!r}; one of {', '.join((*FILES, *DATABASES, 'mongodb'))}")


def _swap(spark: SparkSession, staging: str, path: str) -> None:
    """Put the staged folder where the old one was; the old one goes only after that."""
    jvm = spark.sparkContext._jvm
    to, new, old = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, staging, f"{staging}.old"))
    fs = to.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    had = fs.exists(to)
    if had and not fs.rename(to, old):
        raise OSError(f"could not move {path} aside")
    if not fs.rename(new, to):
        if had:
            fs.rename(old, to)
        raise OSError(f"could not move {staging} to {path}")
    if had:
        fs.delete(old, True)


def updated(books: DataFrame, changes: DataFrame, columns: list[str], skip_empty: bool = True) -> DataFrame:
    """The table with ``columns`` taken from ``changes`` where it has the book: an update as a join.

    Null values, and empty lists with ``skip_empty``, leave the old value."""
    new = changes.dropDuplicates(["book_id"]).select(
        F.col("book_id").alias("__id"),
        *[(F.when(F.size(c) > 0, F.col(c)) if skip_empty and isinstance(changes.schema[c].dataType, T.ArrayType) else F.col(c)).alias(f"__{c}") for c in columns],
    )
    joined = books.join(new, F.col("book_id") == F.col("__id"), "left")
    kept = [F.coalesce(f"__{c}", c).alias(c) if c in columns else F.col(c) for c in books.columns]
    return joined.select(*kept, *[F.col(f"__{c}").alias(c) for c in columns if c not in books.columns])


def update_table(books: DataFrame, changes: DataFrame, columns: list[str], path: str) -> None:
    """Update a Parquet table in place by writing the joined table beside it and swapping."""
    write_books(updated(books, changes, columns), "parquet", {"path": path})


def update_statement(table: str, staging: str, columns: list[str], url: str) -> str:
    """One UPDATE of ``columns`` from the staging table by book_id, in the database's own form of a join; a null
    in the staging table leaves the old value."""
    mark = "`" if url.startswith("jdbc:mysql") else '"'
    name = lambda c: f"{mark}{c}{mark}"
    key, sets = name("book_id"), lambda to: ", ".join(f"{to}{name(c)} = COALESCE(s.{name(c)}, t.{name(c)})" for c in columns)
    if url.startswith("jdbc:mysql"):
        return f"UPDATE {table} t JOIN {staging} s ON s.{key} = t.{key} SET {sets('t.')}"
    if url.startswith("jdbc:postgresql"):
        return f"UPDATE {table} AS t SET {sets('')} FROM {staging} AS s WHERE s.{key} = t.{key}"
    one = lambda c: f"{name(c)} = COALESCE((SELECT s.{name(c)} FROM {staging} s WHERE s.{key} = {table}.{key}), {name(c)})"
    return f"UPDATE {table} SET {', '.join(map(one, columns))} WHERE EXISTS (SELECT 1 FROM {staging} s WHERE s.{key} = {table}.{key})"


def update_database(changes: DataFrame, columns: list[str], options: dict[str, str] | None = None, skip_empty: bool = True) -> int:
    """Update single columns of a database table from ``changes`` (book_id, columns): all executors write a staging
    table, and one statement in one transaction joins it in. Returns the number of rows updated.

    Null values, and empty lists with ``skip_empty``, leave the old value. The staging table goes again."""
    given = _options(options)
    staging = f"staging_{uuid.uuid4().hex[:12]}"
    kept = changes.dropDuplicates(["book_id"]).filter("book_id is not null").select(
        "book_id",
        *[(F.when(F.size(c) > 0, F.col(c)) if skip_empty and isinstance(changes.schema[c].dataType, T.ArrayType) else F.col(c)).alias(c) for c in columns],
    )
    as_text_columns(kept).write.format("jdbc").options(**(given | {"dbtable": staging})).mode("overwrite").save()
    jvm = changes.sparkSession.sparkContext._jvm
    properties = jvm.java.util.Properties()
    for name in ("user", "password"):
        if name in given:
            properties.setProperty(name, given[name])
    connection = jvm.java.sql.DriverManager.getConnection(given["url"], properties)
    try:
        connection.setAutoCommit(False)
        statement = connection.createStatement()
        n = statement.executeUpdate(update_statement(given["dbtable"], staging, columns, given["url"]))
        connection.commit()
        return int(n)
    except Exception:
        connection.rollback()
        raise
    finally:
        statement = connection.createStatement()
        statement.executeUpdate(f"DROP TABLE {staging}")
        connection.commit()
        connection.close()


def create_table(spark: SparkSession, name: str, buckets: int | None = None) -> None:
    """An empty managed table of the catalogue's schema, replacing an old one; bucketed by book_id if asked,
    which serves lookups and joins as an index would."""
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    writer = spark.createDataFrame([], BOOKS).write.format("parquet")
    if buckets:
        writer = writer.bucketBy(buckets, "book_id").sortBy("book_id")
    writer.saveAsTable(name)


def append(books: DataFrame, name: str) -> None:
    """Bulk load into a table made by create_table."""
    canonical(books).select(*BOOKS.fieldNames()).write.mode("append").insertInto(name)


def verify_load(books: DataFrame) -> dict[str, object]:
    """Count, first three titles by id, and the distinct tags of the first hundred books."""
    tags = books.orderBy("book_id").limit(100).select(F.explode("domain_tags").alias("tag")).distinct().orderBy("tag")
    return {
        "count": books.count(),
        "preview": [r["title"] for r in books.orderBy("book_id").limit(3).select("title").collect()],
        "tags": [r["tag"] for r in tags.collect()],
    }


def sample_books(spark: SparkSession, n: int = 100, tags: list[str] | None = None, seed: int = 42) -> DataFrame:
    """A seeded sample catalogue: dates 2015 to 2025, ratings 3.0 to 9.9, one or two tags, 128 numbers of
    unit length, three to seven keywords with 64 numbers each."""
    tags = tags or [f"area {i}" for i in range(10)]
    rand = lambda i: F.rand(seed + i)
    tag_list = F.array(*[F.lit(t) for t in tags])
    pick = lambda i: F.get(tag_list, F.floor(rand(i) * len(tags)).cast("int"))
    base = spark.range(1, n + 1).select(
        F.col("id").alias("book_id"),
        F.concat(F.lit("Sample book "), F.col("id")).alias("title"),
        F.array(F.concat(F.lit("Author "), F.floor(rand(1) * 40))).alias("authors"),
        F.date_add(F.lit("2015-01-01").cast("date"), F.floor(rand(2) * 4017).cast("int")).alias("publication_date"),
        F.round(3 + rand(3) * 6.9, 1).alias("rating"),
        F.array_distinct(F.when(rand(4) < 0.5, F.array(pick(5))).otherwise(F.array(pick(5), pick(6)))).alias("domain_tags"),
        (3 + F.floor(rand(7) * 5)).cast("int").alias("k"),
    )
    number = lambda i, j: F.hash(F.col("book_id"), i, j, F.lit(seed)) / F.lit(2.0**31)
    raw = F.transform(F.sequence(F.lit(1), F.lit(128)), lambda j: number(F.lit(0), j))
    with_raw = base.withColumn("raw", raw)
    norm = F.sqrt(F.aggregate("raw", F.lit(0.0), lambda s, x: s + x * x))
    made = with_raw.withColumns(
        {
            "embedding": F.transform("raw", lambda x: x / norm),
            "keywords": F.transform(F.sequence(F.lit(1), F.col("k")), lambda i: F.concat(F.lit("keyword "), F.pmod(F.hash("book_id", i), F.lit(50)))),
            "keywords_embeddings": F.transform(F.sequence(F.lit(1), F.col("k")), lambda i: F.transform(F.sequence(F.lit(1), F.lit(64)), lambda j: number(i, j))),
        }
    )
    return canonical(made)


def remember_snapshot(books: DataFrame, columns: list[str]) -> DataFrame:
    """The columns as one stable snapshot in the shared folder, so that a page and its total agree."""
    path = f"{own_dir(books.sparkSession)}/snapshot-{uuid.uuid4().hex}"
    books.select(*columns).write.parquet(path)
    return books.sparkSession.read.parquet(path)
