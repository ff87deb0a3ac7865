"""Queries of the reference's operators over the driver's tables, and the SQL they must agree with."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstone.config import Scoring
from quillstone.functions.dates import parse_date
from quillstone.functions.segment import pieces
from quillstone.functions.side import side_rows
from quillstone.functions.text import clean_terms, embedding_text, keyword_text, normalise, normalise_lower
from quillstone.operators import catalog, embeddings, keywords, ranking, recommend, similarity, tags
from quillstone.plans.pipeline import enrich, run_summary
from quillstone.schema import canonical, decode_list, with_feature_columns
from quillstone.sources.books import FILES, append, create_table, read_books, updated, verify_load, write_books
from quillstone.storage import own_dir
from quillstone.streaming.enrich import requests_per_window

AS_OF = "2026-01-01"
BETAS = [0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45]
SEARCH = "source"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def books(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical(read(spark, sf_dir, "books"))


def lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "domain_lexicon").select("domain_idx", "domain", "kw_idx", "keyword")


def target(spark: SparkSession, sf_dir: str) -> int:
    """The first book that has all features."""
    has = (F.size("embedding") == 128) & (F.size("keywords_embeddings") > 0) & (F.size("domain_tags") > 0)
    return books(spark, sf_dir).filter(has).agg(F.coalesce(F.min("book_id"), F.lit(-1))).first()[0]


def semantic_topk(spark, sf_dir):
    scored = recommend.candidates(books(spark, sf_dir), target(spark, sf_dir))
    return scored.orderBy(F.desc("semantic_similarity"), "book_id").limit(10).select("book_id", "semantic_similarity")


PAIR = ["book_id", "semantic_similarity", "keyword_similarity", "combined_similarity", "overlap_count", "overlap_coefficient", "final_score"]


def pair_scores(spark, sf_dir):
    return recommend.candidates(books(spark, sf_dir), target(spark, sf_dir)).select(*PAIR)


RESULT = ["book_id", "title", "combined_similarity", "overlap_count", "final_score", "utility_score", "rating"]


def cross_domain_topk(spark, sf_dir, **options):
    found = recommend.recommend(books(spark, sf_dir), target(spark, sf_dir), as_of=AS_OF, **options)
    return found.select(*RESULT)


def recommend_by(mode: str):
    return lambda spark, sf_dir: cross_domain_topk(spark, sf_dir, mode=mode)


def recommend_all(spark, sf_dir):
    return cross_domain_topk(spark, sf_dir, cross_domain=False)


def recommend_strict(spark, sf_dir):
    return cross_domain_topk(spark, sf_dir, strict=True)


def beta_sweep(spark, sf_dir):
    return recommend.beta_sweep(books(spark, sf_dir), target(spark, sf_dir), BETAS)


def all_books_topk(spark, sf_dir):
    return recommend.batch_topk(books(spark, sf_dir), F.col("book_id") % 100 == 0)


def request_topk(spark, sf_dir):
    """A request as the pages send it: six books, comprehensive, across domains."""
    found = recommend.recommend(books(spark, sf_dir), target(spark, sf_dir), 6, "comprehensive", AS_OF)
    return found.select(*RESULT)


def domain_distribution(spark, sf_dir):
    found = recommend.recommend(books(spark, sf_dir), target(spark, sf_dir), as_of=AS_OF)
    return recommend.domain_distribution(found)


def catalog_page(spark, sf_dir):
    return catalog.page(books(spark, sf_dir), 2, 20, "rating").select("book_id", "title", "rating")


def catalog_newest(spark, sf_dir):
    return catalog.page(books(spark, sf_dir), 1, 20, "newest").select("book_id", "title", "publication_date")


def catalog_search(spark, sf_dir):
    return catalog.page(books(spark, sf_dir), 1, 20, None, SEARCH).select("book_id", "title", "publisher")


def catalog_count(spark, sf_dir):
    return catalog.count(books(spark, sf_dir), SEARCH)


def book_detail(spark, sf_dir):
    found = catalog.detail(books(spark, sf_dir), target(spark, sf_dir))
    return found.select("book_id", "title", "author_intro", "book_intro", "rating", F.size("authors").alias("n_authors"), F.size("reviews").alias("n_reviews"))


def hot_list(spark, sf_dir):
    return catalog.hot_list(books(spark, sf_dir)).select("book_id", "title", "rating")


def selected_first(spark, sf_dir):
    """The first page with a book of it moved to the front, numbered as it stands."""
    page = catalog.page(books(spark, sf_dir), 1, 20)
    rows = catalog.selected_first(page, 1010).select("book_id").collect()  # one page of 20 rows
    return spark.createDataFrame([(r["book_id"], i) for i, r in enumerate(rows, 1)], "book_id long, position int")


def catalog_deep_page(spark, sf_dir):
    """The second page by rating, reached from the last row of the first."""
    found = books(spark, sf_dir)
    last = catalog.page_after(found, None, 20, "rating").select("rating", "book_id").collect()[-1:]
    return catalog.page_after(found, tuple(last[0]) if last else None, 20, "rating").select("book_id", "title", "rating")


def display_lists(spark, sf_dir):
    return catalog.display(books(spark, sf_dir))


def display_scores(spark, sf_dir):
    return catalog.display_scores(recommend.recommend(books(spark, sf_dir), target(spark, sf_dir), as_of=AS_OF))


def catalog_stats(spark, sf_dir):
    return catalog.statistics(books(spark, sf_dir))


def tag_statistics(spark, sf_dir):
    return catalog.tag_statistics(books(spark, sf_dir))


def recommendations(spark, sf_dir):
    return read(spark, sf_dir, "recommendations").dropDuplicates(["rec_id"])


def filtered_rank(spark, sf_dir):
    """The 50 best candidates rated at least 8 and at most 60 in price, by final score."""
    rows = ranking.filtered_rank(recommendations(spark, sf_dir).withColumn("publication_date", F.trim("publication_date")), "final", 8.0, 60.0)
    ordered = rows.orderBy(F.desc("final_score"), "rec_id").limit(50)
    return ordered.select("rec_id", "book_id", "final_score", "rating", "publication_date")


def target_topk(spark, sf_dir):
    """The three best candidates of every target by final score."""
    w = Window.partitionBy("target_book_id").orderBy(F.desc_nulls_last("final_score"), "rec_id")
    ranked = recommendations(spark, sf_dir).withColumn("position", F.row_number().over(w)).filter("position <= 3")
    return ranked.select("target_book_id", "position", "rec_id", "final_score")


def date_parse(spark, sf_dir):
    return recommendations(spark, sf_dir).select("rec_id", parse_date(F.trim("publication_date")).alias("parsed"))


def raw_decode(spark, sf_dir):
    """Lists decoded from JSON text as delivered, one row per load."""
    raw = read(spark, sf_dir, "books_raw").dropDuplicates()
    size = lambda c: F.size(decode_list(c)).alias(f"n_{c}")
    return raw.select("load_id", size("authors"), size("domain_tags"), size("keywords"))


def raw_latest(spark, sf_dir):
    """The last load of every book."""
    raw = read(spark, sf_dir, "books_raw").dropDuplicates()
    best = raw.groupBy("book_id").agg(F.max(F.struct("loaded_at", "load_id")).alias("last"), F.count_distinct("load_id").alias("loads"))
    return best.select("book_id", F.col("last.load_id").alias("load_id"), "loads")


def update_merge(spark, sf_dir):
    """The catalogue's titles updated from the last loads that have one."""
    raw = read(spark, sf_dir, "books_raw").dropDuplicates().filter("trim(title) <> ''")
    last = raw.groupBy("book_id").agg(F.max(F.struct("loaded_at", "load_id", "title")).alias("x")).select("book_id", F.col("x.title").alias("title"))
    return updated(books(spark, sf_dir), last, ["title"]).select("book_id", "title")


def text_normalise(spark, sf_dir):
    found = books(spark, sf_dir)
    return found.select("book_id", normalise(F.col("book_intro")).alias("kept"), normalise_lower(F.col("title")).alias("lowered"))


def token_filter(spark, sf_dir):
    cleaned = clean_terms(F.col("keywords"))
    return books(spark, sf_dir).select("book_id", F.size(cleaned).alias("n"), F.array_join(cleaned, "|").alias("cleaned"))


def text_assembly(spark, sf_dir):
    found = books(spark, sf_dir)
    return found.select("book_id", F.md5(keyword_text()).alias("for_keywords"), F.length(embedding_text()).alias("for_embedding"))


def lexicon_scores(spark, sf_dir):
    found = books(spark, sf_dir)
    text = F.concat_ws(" ", "title", "book_intro", "author_intro")
    return tags.lexicon_scores(found, "book_id", text, lexicon(spark, sf_dir)).withColumnRenamed("id", "book_id")


def lexicon_tags(spark, sf_dir):
    tagged = tags.tag_books(books(spark, sf_dir), lexicon(spark, sf_dir))
    return tagged.select("book_id", F.array_join("domain_tags", "|").alias("tags"))


def lexicon_tag_statistics(spark, sf_dir):
    return catalog.tag_statistics(tags.tag_books(books(spark, sf_dir), lexicon(spark, sf_dir)))


def _terms(spark, sf_dir):
    return keywords.terms(books(spark, sf_dir), "book_id", keyword_text(), read(spark, sf_dir, "stop_words"))


def segment_terms(spark, sf_dir):
    """Terms by a segmenter that knows Latin words from everything else, of the allowed parts of speech only."""
    latin = lambda: lambda text: [(w, "eng" if w.isalpha() and w.isascii() else "x") for w, _ in pieces()(text)]
    found = keywords.terms(books(spark, sf_dir), "book_id", keyword_text(), read(spark, sf_dir, "stop_words"), latin, ("eng",), digits=False)
    return found.withColumnRenamed("id", "book_id")


def single_book_keywords(spark, sf_dir):
    found = keywords.of_single_books(books(spark, sf_dir), 10, read(spark, sf_dir, "stop_words"))
    return found.select("book_id", F.array_join("keywords", "|").alias("keywords"))


def tfidf_topk(spark, sf_dir):
    weights = keywords.tfidf(_terms(spark, sf_dir), books(spark, sf_dir))
    return keywords.top_terms(weights, 10).withColumnRenamed("id", "book_id")


def tf_keywords(spark, sf_dir):
    return keywords.term_frequency(_terms(spark, sf_dir), 10).withColumnRenamed("id", "book_id")


def textrank_topk(spark, sf_dir):
    found = keywords.textrank(books(spark, sf_dir), "book_id", keyword_text(), 10, read(spark, sf_dir, "stop_words"))
    return found.withColumnRenamed("id", "book_id")


def keyword_fusion(spark, sf_dir):
    """TF-IDF and frequency lists of every book, fused to ten."""
    tf = _terms(spark, sf_dir)
    fused = keywords.fuse(keywords.top_terms(keywords.tfidf(tf, books(spark, sf_dir)), 10), keywords.term_frequency(tf, 10), 10)
    return fused.withColumnRenamed("id", "book_id")


def keyword_summary(spark, sf_dir):
    return keywords.summary(books(spark, sf_dir))


def keyword_extract(spark, sf_dir):
    found = keywords.extract(books(spark, sf_dir), keyword_text(), 10, read(spark, sf_dir, "stop_words"))
    return found.select("book_id", F.array_join("keywords", "|").alias("keywords"))


def hashed_embedding(spark, sf_dir):
    """The hashed vectors of all documents: number of used slots, largest entry, and all entries but zeros by slot."""
    made = embeddings.hashed_documents(read(spark, sf_dir, "documents"), "doc_id", F.col("text"), 64)
    entries = F.filter(F.transform("embedding", lambda x, i: F.when(x > 0, F.format_string("%d:%.6f", i, x))), lambda x: x.isNotNull())
    return made.select("doc_id", F.size(entries).alias("used"), F.round(F.array_max("embedding"), 6).alias("largest"), F.array_join(entries, " ").alias("entries"))


def model_embedding(spark, sf_dir):
    """Document vectors by a model that is a function of the text: its length, and the number of its Latin a."""
    factory = lambda: lambda texts: [[float(len(t)), float(t.count("a"))] for t in texts]
    made = embeddings.encode_texts(books(spark, sf_dir), "book_id", F.col("book_intro"), factory, 2)
    return made.select("book_id", F.col("embedding")[0].alias("first"), F.col("embedding")[1].alias("second"))


def model_keyword_vectors(spark, sf_dir):
    """Keyword vectors by a model, each different keyword encoded once, and back in keyword order."""
    found = books(spark, sf_dir)
    factory = lambda: lambda texts: [[float(len(t)), float(t.count("a"))] for t in texts]
    distinct = found.select(F.explode("keywords").alias("keyword")).filter("trim(keyword) <> ''").distinct()
    vectors = embeddings.encode_texts(distinct, "keyword", F.col("keyword"), factory, 2).withColumnRenamed("embedding", "vector")
    made = embeddings.keyword_vectors(found, vectors)
    flat = F.transform("keywords_embeddings", lambda v: F.concat_ws(":", v[0].cast("int"), v[1].cast("int")))
    return made.select("book_id", F.array_join(flat, "|").alias("vectors"))


def embedding_update(spark, sf_dir):
    """Vectors of the books with even id replaced, where the new one is not empty; the rest as they were."""
    found = books(spark, sf_dir)
    new = F.when(F.col("book_id") % 4 == 0, F.array(F.lit(1.0), F.lit(2.0))).otherwise(F.array().cast("array<double>"))
    changed = updated(found, found.filter("book_id % 2 = 0").select("book_id", new.alias("embedding")), ["embedding"])
    return changed.select("book_id", F.coalesce(F.size("embedding"), F.lit(0)).alias("length"))


def feature_columns(spark, sf_dir):
    """A table without vector columns gets them, empty; one that has them is left alone."""
    found = books(spark, sf_dir)
    lacking, whole = with_feature_columns(found.drop("embedding", "keywords_embeddings")), with_feature_columns(found)
    filled = lambda df, name: df.agg(F.lit(name).alias("source"), F.count("*").alias("books"), F.count("embedding").alias("vectors"), F.count("keywords_embeddings").alias("keyword_vectors"))
    return filled(lacking, "lacking").unionByName(filled(whole, "whole"))


def source_formats(spark, sf_dir):
    """The catalogue written to every kind of file and read back: what each kind holds."""
    found, out = books(spark, sf_dir), None
    for kind in FILES:
        path = f"{own_dir(spark)}/source-{kind}-{uuid.uuid4().hex}"
        write_books(found, kind, {"path": path})
        held = read_books(spark, kind, {"path": path}).agg(
            F.lit(kind).alias("kind"),
            F.count("*").alias("books"),
            F.sum("book_id").alias("ids"),
            F.count("title").alias("titles"),
            F.sum(F.size(F.coalesce("keywords", F.array().cast("array<string>")))).alias("keywords"),
            F.sum(F.size(F.coalesce("domain_tags", F.array().cast("array<string>")))).alias("tags"),
            F.count("publication_date").alias("dates"),
            F.round(F.sum("rating"), 4).alias("ratings"),
        )
        out = held if out is None else out.unionByName(held)
    return out


def lexicon_file(spark, sf_dir):
    """The lexicon as a JSON file of domains with their keywords, read back with its order."""
    domains: dict[int, dict] = {}
    for r in sorted(side_rows(lexicon(spark, sf_dir)), key=lambda r: (r["domain_idx"], r["kw_idx"])):
        domains.setdefault(r["domain_idx"], {"domain": r["domain"], "keywords": []})["keywords"].append(r["keyword"])
    path = f"{own_dir(spark)}/lexicon-{uuid.uuid4().hex}"
    spark.createDataFrame([(json.dumps(list(domains.values()), ensure_ascii=False),)], "value string").coalesce(1).write.text(path)
    return tags.read_lexicon(spark, path)


def stop_words_file(spark, sf_dir):
    """The stop words as a text file with blank lines and spaces, read back."""
    path = f"{own_dir(spark)}/stop-words-{uuid.uuid4().hex}"
    words = read(spark, sf_dir, "stop_words").filter("word is not null").select(F.concat(F.lit(" "), "word").alias("value"))
    words.unionByName(words.limit(3).select(F.lit(" ").alias("value"))).write.text(path)
    return tags.read_stop_words(spark, path)


def loaded_table(spark, sf_dir):
    """A table made, filled in two loads and verified: count, first titles, tags of the first hundred books."""
    name, found = f"quillstone_{uuid.uuid4().hex}", books(spark, sf_dir)
    create_table(spark, name, 4)
    try:
        append(found.filter("book_id % 2 = 0"), name)
        append(found.filter("book_id % 2 = 1"), name)
        seen = verify_load(spark.table(name))
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    row = (seen["count"], "|".join(seen["preview"]), len(seen["tags"]))
    return spark.createDataFrame([row], "books long, preview string, tags int")


def response_metadata(spark, sf_dir):
    scored = recommend.candidates(books(spark, sf_dir), target(spark, sf_dir)).filter("overlap_coefficient > 0")
    return recommend.response_metadata(scored, Scoring())


def pair_by_ids(spark, sf_dir):
    """The scores of one pair: the first book that has all features, and the first other one with an id divisible by 7."""
    found, first = books(spark, sf_dir), target(spark, sf_dir)
    second = found.filter((F.col("book_id") % 7 == 0) & (F.col("book_id") != first)).agg(F.min("book_id")).first()[0]
    pair = similarity.calculate_similarity(found, first, -1 if second is None else second)
    return recommend.rounded(pair, recommend.ROUNDED).select(*PAIR[1:])


def distinct_vectors(spark, sf_dir):
    return embeddings.distinct_vectors(books(spark, sf_dir))


def enrich_pipeline(spark, sf_dir):
    return run_summary(enrich(books(spark, sf_dir), lexicon(spark, sf_dir), read(spark, sf_dir, "stop_words")))


def window_counts(spark, sf_dir):
    """Requests per target and day, rows repeated under one id counted once."""
    return requests_per_window(read(spark, sf_dir, "recommendations"), "1 day").withColumn("window_start", F.col("window_start").cast("date"))


def mode_catalogue(spark, sf_dir):
    return ranking.modes(spark)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        semantic_topk, pair_scores, cross_domain_topk, recommend_all, recommend_strict, beta_sweep, all_books_topk, domain_distribution,
        catalog_page, catalog_newest, catalog_search, catalog_count, book_detail, hot_list, selected_first, display_lists, display_scores,
        catalog_stats, tag_statistics, filtered_rank, target_topk, date_parse, raw_decode, raw_latest, update_merge, text_normalise,
        token_filter, text_assembly, lexicon_scores, lexicon_tags, lexicon_tag_statistics, tfidf_topk, tf_keywords, textrank_topk,
        keyword_fusion, keyword_summary, keyword_extract, hashed_embedding, distinct_vectors, enrich_pipeline, window_counts, mode_catalogue,
        catalog_deep_page, segment_terms, single_book_keywords, model_embedding, model_keyword_vectors, embedding_update, feature_columns,
        source_formats, lexicon_file, stop_words_file, loaded_table, response_metadata, pair_by_ids, request_topk,
    )
} | {f"recommend_by_{m}": recommend_by(m) for m in ("similarity", "rating", "newest", "final")}
