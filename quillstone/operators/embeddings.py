"""Embeddings of documents and keywords, by a model where there is one and by hashing otherwise.

A model is any callable from a list of texts to a list of vectors, built once per Python worker by a
factory that is shipped to the executors. The hashed fallback gives every word the same place in all
texts, so similarities mean something without a model."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions.text import split_tokens

Encoder = Callable[[list[str]], list[list[float]]]


def word_slot(word: str, size: int) -> int:
    """The word's slot: the first eight bytes of its MD5 sum, the lowest first, modulo the size."""
    return int.from_bytes(hashlib.md5(word.encode(), usedforsecurity=False).digest()[:8], "little") % size


def hashed_documents(df: DataFrame, id_col: str, text: Column, size: int = 768) -> DataFrame:
    """(id, embedding): word counts at length one, every word in its slot;
    zeros for a text without words."""
    kept = df.select(F.col(id_col).alias("id"), text.alias("text"))

    def run(batches):
        slots: dict[str, int] = {}
        for batch in batches:
            lists = batch.column(1).to_pylist()
            out = np.zeros((len(lists), size))
            for i, words in enumerate(lists):
                for w in split_tokens(words):
                    slot = slots.get(w)
                    if slot is None:
                        if len(slots) > 200_000:
                            slots.clear()
                        slot = slots[w] = word_slot(w, size)
                    out[i, slot] += 1
            out /= np.maximum(np.sqrt((out * out).sum(axis=1, keepdims=True)), 1e-300)
            vectors = pa.ListArray.from_arrays(pa.array(np.arange(len(lists) + 1) * size, pa.int32()), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), vectors], names=["id", "embedding"])

    kind = kept.schema["id"].dataType.simpleString()
    return kept.mapInArrow(run, f"id {kind}, embedding array<double>").withColumnRenamed("id", id_col)


def encode_texts(df: DataFrame, id_col: str, text: Column, factory: Callable[[], Encoder], size: int, batch_rows: int = 32) -> DataFrame:
    """(id, embedding) by a model in batches; blank texts get zeros without a call."""
    kept = df.select(F.col(id_col).alias("id"), F.coalesce(text, F.lit("")).alias("text"))

    def run(batches):
        model = factory()
        for batch in batches:
            texts = batch.column(1).to_pylist()
            full = [i for i, t in enumerate(texts) if t.strip()]
            out = np.zeros((len(texts), size))
            for lo in range(0, len(full), batch_rows):
                some = full[lo : lo + batch_rows]
                out[some] = np.asarray(model([texts[i] for i in some]), dtype=np.float64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * size, pa.int32()), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["id", "embedding"])

    kind = kept.schema["id"].dataType.simpleString()
    return kept.mapInArrow(run, f"id {kind}, embedding array<double>").withColumnRenamed("id", id_col)


def keyword_vectors(books: DataFrame, vectors: DataFrame, id_col: str = "book_id") -> DataFrame:
    """(id, keywords_embeddings) in keyword order, from (keyword, vector) of the distinct keywords; blank
    keywords are dropped, and a keyword without a vector has none."""
    flat = books.select(id_col, F.posexplode("keywords").alias("pos", "keyword")).filter(F.trim("keyword") != "")
    joined = flat.join(vectors, "keyword").groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct("pos", "vector"))).alias("x"))
    lists = joined.select(id_col, F.col("x.vector").alias("keywords_embeddings"))
    return books.select(id_col).join(lists, id_col, "left").withColumn("keywords_embeddings", F.coalesce("keywords_embeddings", F.array().cast("array<array<double>>")))


def hashed_keywords(books: DataFrame, size: int = 64, id_col: str = "book_id") -> DataFrame:
    """Keyword vectors by hashing; every distinct keyword is encoded once."""
    distinct = books.select(F.explode("keywords").alias("keyword")).filter(F.trim("keyword") != "").distinct()
    vectors = hashed_documents(distinct, "keyword", F.col("keyword"), size).withColumnRenamed("embedding", "vector")
    return keyword_vectors(books, vectors, id_col)


def distinct_vectors(books: DataFrame) -> DataFrame:
    """One row: number of different keyword-vector lists; missing ones count as one value."""
    return books.agg(F.count_distinct(F.coalesce(F.to_json("keywords_embeddings"), F.lit(""))).alias("distinct_vectors"))
