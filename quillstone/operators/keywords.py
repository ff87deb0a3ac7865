"""Keywords: corpus TF-IDF, TextRank per record, and fusion of ranked lists."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions.segment import GRAPH_POS, KEYWORD_POS, Segmenter, kept_words, pieces
from quillstone.functions.side import side_rows
from quillstone.functions.text import is_term
from quillstone.storage import cut

_RANKED = pa.schema([("id", pa.int64()), ("term", pa.string()), ("score", pa.float64()), ("position", pa.int32())])


_TF = pa.schema([("id", pa.int64()), ("term", pa.string()), ("tf", pa.int64())])


def _stop_set(df: DataFrame, stop_words: DataFrame | None):
    """The stop words as a broadcast set, a side input checked for its size."""
    words = set() if stop_words is None else {r["word"].strip().lower() for r in side_rows(stop_words.select("word").filter("word is not null"))}
    return df.sparkSession.sparkContext.broadcast(words)


def terms(
    df: DataFrame,
    id_col: str,
    text: Column,
    stop_words: DataFrame | None = None,
    segmenter: Callable[[], Segmenter] = pieces,
    allowed: tuple[str, ...] | None = KEYWORD_POS,
    digits: bool = True,
) -> DataFrame:
    """(id, term, tf) of every record; words of one character do not count, nor those whose part of speech
    begins with no ``allowed`` code; numbers count with ``digits``.

    A record's counts come from its own text, so they are final where the record lies: no shuffle. The
    texts are segmented once: the counts are kept as a table, for all that is made of them."""
    stop = _stop_set(df, stop_words)

    def run(batches):
        segment = segmenter()
        for batch in batches:
            out: dict[str, list] = {f.name: [] for f in _TF}
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = list(segment(t or ""))
                numbers = [w for w, _ in words if digits and w.isdigit() and len(w) > 1 and w not in stop.value]
                for w, n in Counter(kept_words(words, stop.value, allowed) + numbers).items():
                    out["id"].append(i)
                    out["term"].append(w)
                    out["tf"].append(n)
            yield pa.RecordBatch.from_pydict(out, schema=_TF)

    kept = df.select(F.col(id_col).cast("long").alias("id"), text.alias("text"))
    return cut(kept.mapInArrow(run, "id long, term string, tf long"), "keyword-terms")


def tfidf(tf: DataFrame, documents: DataFrame, min_df: int = 2, max_df: float = 0.85, max_features: int = 5_000) -> DataFrame:
    """(id, term, weight): tf * (ln((1 + n) / (1 + df)) + 1), at length one per record over the kept vocabulary.

    Kept are terms in at least ``min_df`` records and at most the share ``max_df``; of those the
    ``max_features`` most frequent, ties by term. The vocabulary has a fixed bound and is broadcast."""
    n = documents.agg(F.count("*").alias("n"))
    vocabulary = (
        tf.groupBy("term")
        .agg(F.count("*").alias("df"), F.sum("tf").alias("ctf"))
        .crossJoin(F.broadcast(n))
        .filter((F.col("df") >= min_df) & (F.col("df") <= max_df * F.col("n")))
        .orderBy(F.desc("ctf"), "term")
        .limit(max_features)
        .select("term", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))
    )
    raw = tf.join(F.broadcast(vocabulary), "term").withColumn("raw", F.col("tf") * F.col("idf"))
    length = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy("id")))
    return raw.select("id", "term", (F.col("raw") / length).alias("weight"))


def top_terms(weights: DataFrame, k: int, raw_k: int | None = None, digits: int = 6) -> DataFrame:
    """(id, term, score, position): the k best cleaned terms out of the ``raw_k`` (3k) best, ties by term descending."""
    order = Window.partitionBy("id").orderBy(F.desc("score"), F.desc("term"))
    best = weights.select("id", "term", F.round("weight", digits).alias("score")).filter("score > 0")
    best = best.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= (raw_k or 3 * k))
    best = best.filter(is_term(F.col("term")))
    return best.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= k).drop("r")


def term_frequency(tf: DataFrame, k: int) -> DataFrame:
    """Keywords of single records by plain frequency, ties by term."""
    order = Window.partitionBy("id").orderBy(F.desc("tf"), "term")
    kept = tf.filter(is_term(F.col("term"))).withColumn("position", F.row_number().over(order))
    return kept.filter(F.col("position") <= k).select("id", "term", F.col("tf").cast("double").alias("score"), "position")


def rank_graph(words: list[str], window: int = 5, rounds: int = 30, damping: float = 0.85) -> dict[str, float]:
    """TextRank scores of the words: PageRank over the weighted graph of words that stand within a window."""
    index = {w: i for i, w in enumerate(dict.fromkeys(words))}
    n = len(index)
    if not n:
        return {}
    at = np.array([index[w] for w in words])
    edges: list[np.ndarray] = []
    for step in range(1, window):
        if len(at) > step:
            pair = np.stack([at[:-step], at[step:]])
            edges.append(pair[:, pair[0] != pair[1]])
    if not edges or not sum(e.shape[1] for e in edges):
        return dict.fromkeys(index, 1.0)
    a, b = np.concatenate(edges, axis=1)
    code, weight = np.unique(np.concatenate([a * n + b, b * n + a]), return_counts=True)
    source, to = code // n, code % n
    out = np.bincount(source, weight, n)
    score = np.ones(n)
    for _ in range(rounds):
        score = (1 - damping) + damping * np.bincount(to, weight * score[source] / out[source], n)
    top = score.max()
    return {w: float(score[i] / top) for w, i in index.items()}


def graph_terms(words: list[tuple[str, str | None]], stop: set[str], k: int, digits: bool = True) -> list[tuple[str, float]]:
    """The k best cleaned words of a text's own graph, out of 2k; numbers take part in the graph with ``digits``."""
    kept = [(w, None if digits and w.isdigit() else pos) for w, pos in words]
    graph = [w for w, pos in kept if len(w) > 1 and w not in stop and (pos is None or pos in GRAPH_POS) and (digits or not w.isdigit())]
    ranked = sorted((-round(s, 6), w) for w, s in rank_graph(graph).items())[: 2 * k]
    return [(w, -s) for s, w in ranked if not w.isdigit()][:k]


def textrank(
    df: DataFrame, id_col: str, text: Column, k: int, stop_words: DataFrame | None = None, segmenter: Callable[[], Segmenter] = pieces
) -> DataFrame:
    """(id, term, score, position): the k best cleaned terms of each record's own word graph, out of 2k; ties by term.

    One record's graph is bounded by its text, so it is ranked where the record lies, without a shuffle."""
    stop = _stop_set(df, stop_words)

    def run(batches):
        segment = segmenter()
        for batch in batches:
            out: dict[str, list] = {f.name: [] for f in _RANKED}
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for position, (w, s) in enumerate(graph_terms(list(segment(t or "")), stop.value, k), 1):
                    out["id"].append(i)
                    out["term"].append(w)
                    out["score"].append(s)
                    out["position"].append(position)
            yield pa.RecordBatch.from_pydict(out, schema=_RANKED)

    kept = df.select(F.col(id_col).cast("long").alias("id"), text.alias("text"))
    return kept.mapInArrow(run, "id long, term string, score double, position int")


def fuse(first: DataFrame, second: DataFrame, k: int) -> DataFrame:
    """(id, term, score, position): items of the first list score 2(n - i), of the second m - j; sums are
    ordered with ties by first appearance, cut at k, and cleaned after the cut, so fewer may be left."""
    size = F.count("*").over(Window.partitionBy("id"))
    weighted = [
        ranked.select("id", "term", (w * (size - F.col("position") + 1)).alias("score"), (F.lit(o * 1_000_000) + F.col("position")).alias("seen"))
        for ranked, w, o in ((first, 2, 0), (second, 1, 1))
    ]
    summed = weighted[0].unionByName(weighted[1]).groupBy("id", "term").agg(F.sum("score").alias("score"), F.min("seen").alias("seen"))
    order = Window.partitionBy("id").orderBy(F.desc("score"), "seen")
    best = summed.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= k)
    return best.filter(is_term(F.col("term"))).select("id", "term", "score", "position")


def fused(first: list[str], second: list[str], k: int) -> list[str]:
    """``fuse`` for two lists that are at hand."""
    score: dict[str, int] = {}
    for words, weight in ((first, 2), (second, 1)):
        for i, w in enumerate(words):
            score[w] = score.get(w, 0) + weight * (len(words) - i)
    return [w for w in sorted(score, key=score.get, reverse=True)[:k] if len(w) > 1 and not w.isdigit()]


def of_single_texts(
    df: DataFrame, id_col: str, text: Column, k: int = 10, stop_words: DataFrame | None = None, segmenter: Callable[[], Segmenter] = pieces
) -> DataFrame:
    """(id, keywords): of each text by itself, without the collection: the 2k most frequent words, ties by first
    appearance, fused with the 2k best of its word graph. No shuffle."""
    stop = _stop_set(df, stop_words)

    def run(batches):
        segment = segmenter()
        for batch in batches:
            found = []
            for t in batch.column(1).to_pylist():
                words = list(segment(t or ""))
                frequent = [w for w, _ in Counter(kept_words(words, stop.value, KEYWORD_POS)).most_common(2 * k)]
                found.append(fused(frequent, [w for w, _ in graph_terms(words, stop.value, 2 * k, False)], k))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.string()))], names=["id", "keywords"])

    kept = df.select(F.col(id_col).alias("id"), text.alias("text"))
    kind = kept.schema["id"].dataType.simpleString()
    return kept.mapInArrow(run, f"id {kind}, keywords array<string>").withColumnRenamed("id", id_col)


def of_single_books(books: DataFrame, k: int = 10, stop_words: DataFrame | None = None, segmenter: Callable[[], Segmenter] = pieces) -> DataFrame:
    """(book_id, keywords) of each book by itself, from its title and both intros."""
    return of_single_texts(books, "book_id", F.concat_ws(" ", "title", "book_intro", "author_intro"), k, stop_words, segmenter)


def extract(books: DataFrame, text: Column, k: int = 10, stop_words: DataFrame | None = None, id_col: str = "book_id", segmenter: Callable[[], Segmenter] = pieces) -> DataFrame:
    """(id, keywords): fused TF-IDF and TextRank keywords of every book; books without any get an empty list."""
    tf = terms(books, id_col, text, stop_words, segmenter)
    ranked = fuse(top_terms(tfidf(tf, books), k), textrank(books, id_col, text, k, stop_words, segmenter), k)
    lists = ranked.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("position", "term"))).alias("x"))
    lists = lists.select(F.col("id").alias(id_col), F.col("x.term").alias("keywords"))
    return books.select(id_col).join(lists, id_col, "left").withColumn("keywords", F.coalesce("keywords", F.array().cast("array<string>")))


def summary(books: DataFrame, column: str = "keywords") -> DataFrame:
    """One row: books, mean number of keywords, books without any."""
    size = F.size(F.coalesce(column, F.array().cast("array<string>")))
    return books.agg(F.count("*").alias("total"), F.round(F.avg(size), 4).alias("mean_keywords"), F.count_if(size == 0).alias("without"))
