"""Domain tags by counting lexicon words in a text."""

from __future__ import annotations

from collections import defaultdict

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstone.functions.side import side_rows
from quillstone.functions.text import normalise_lower

OTHER = "其他"
_SCORED = pa.schema([("id", pa.int64()), ("domain_idx", pa.int32()), ("score", pa.int64())])


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """(domain_idx, domain, kw_idx, keyword) from a JSON list of {domain, keywords}; the order of the file is kept."""
    entries = spark.read.option("multiLine", True).schema("domain string, keywords array<string>").json(path)
    listed = entries.agg(F.collect_list(F.struct("domain", "keywords")).alias("all")).select(F.posexplode("all").alias("domain_idx", "e"))
    return listed.select("domain_idx", "e.domain", F.posexplode("e.keywords").alias("kw_idx", "keyword"))


def read_stop_words(spark: SparkSession, path: str) -> DataFrame:
    """(word) of a text file with one per line: as written and in lower case, blanks dropped."""
    words = spark.read.text(path).select(F.trim("value").alias("word")).filter("word <> ''")
    return words.unionByName(words.select(F.lower("word").alias("word"))).distinct()


def lexicon_scores(df: DataFrame, id_col: str, text: Column, lexicon: DataFrame, word_boundary: bool = False) -> DataFrame:
    """(id, domain_idx, score): occurrences, without overlap per entry, of each domain's entries in the text.

    Entries that repeat count again, and entries inside others count too. One pass of an automaton
    finds all entries; the lexicon is a side input, checked for its size and broadcast. With ``word_boundary`` entries of Latin
    letters have to stand alone."""
    weights: dict[str, dict[int, int]] = defaultdict(lambda: defaultdict(int))
    for r in side_rows(lexicon.select("domain_idx", F.lower("keyword").alias("keyword")).filter("keyword <> ''")):
        weights[r["keyword"]][r["domain_idx"]] += 1
    shared = df.sparkSession.sparkContext.broadcast({k: dict(v) for k, v in weights.items()})

    def run(batches):
        entries = shared.value
        automaton = ahocorasick.Automaton()
        for k in entries:
            automaton.add_word(k, k)
        if entries:
            automaton.make_automaton()
        for batch in batches:
            out: dict[str, list] = {f.name: [] for f in _SCORED}
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                free: dict[str, int] = {}
                score: dict[int, int] = defaultdict(int)
                for end, k in automaton.iter(t) if entries and t else ():
                    start = end - len(k) + 1
                    if start < free.get(k, 0):
                        continue
                    if word_boundary and k.isascii() and (t[start - 1 : start].isalnum() or t[end + 1 : end + 2].isalnum()):
                        continue
                    free[k] = end + 1
                    for d, w in entries[k].items():
                        score[d] += w
                for d in sorted(score):
                    out["id"].append(i)
                    out["domain_idx"].append(d)
                    out["score"].append(score[d])
            yield pa.RecordBatch.from_pydict(out, schema=_SCORED)

    kept = df.select(F.col(id_col).cast("long").alias("id"), normalise_lower(text).alias("text"))
    return kept.mapInArrow(run, "id long, domain_idx int, score long")


def tag(df: DataFrame, id_col: str, text: Column, lexicon: DataFrame, most: int = 2, word_boundary: bool = False, other: str = OTHER) -> DataFrame:
    """(id, domain_tags): the ``most`` best domains of each record, ties in lexicon order; ``other`` if none."""
    scores = lexicon_scores(df, id_col, text, lexicon, word_boundary).filter("score > 0")
    order = Window.partitionBy("id").orderBy(F.desc("score"), "domain_idx")
    best = scores.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= most)
    names = lexicon.select("domain_idx", "domain").distinct()
    best = best.join(F.broadcast(names), "domain_idx").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("r", "domain"))).alias("x"))
    best = best.select(F.col("id").alias(id_col), F.col("x.domain").alias("domain_tags"))
    return df.select(id_col).join(best, id_col, "left").withColumn("domain_tags", F.coalesce("domain_tags", F.array(F.lit(other))))


def tag_books(books: DataFrame, lexicon: DataFrame, most: int = 2, intro: str = "book_intro") -> DataFrame:
    """Tags from title and intros; an error if a column is missing."""
    missing = [c for c in ("title", intro, "author_intro") if c not in books.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return tag(books, "book_id", F.concat_ws(" ", "title", intro, "author_intro"), lexicon, most)
