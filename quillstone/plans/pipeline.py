"""Enrichment of a catalogue: keywords, then tags, then vectors, as one lazy plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.functions.text import embedding_text, keyword_text
from quillstone.operators.embeddings import hashed_documents, hashed_keywords
from quillstone.operators.keywords import extract
from quillstone.operators.tags import tag_books
from quillstone.sources.books import updated
from quillstone.storage import cut


def enrich(books: DataFrame, lexicon: DataFrame, stop_words: DataFrame | None = None, k: int = 10, document_size: int = 768, keyword_size: int = 64) -> DataFrame:
    """The canonical catalogue with keywords, domain_tags, embedding and keywords_embeddings made from its
    texts. Keyword vectors need keywords, so that step is cut; the others read the same scan."""
    keywords = extract(books, keyword_text(), k, stop_words)
    tags = tag_books(books, lexicon)
    with_words = cut(updated(updated(books, keywords, ["keywords"], skip_empty=False), tags, ["domain_tags"]), "enriched")
    documents = hashed_documents(with_words, "book_id", embedding_text(), document_size)
    vectors = hashed_keywords(with_words, keyword_size)
    return updated(updated(with_words, documents, ["embedding"]), vectors, ["keywords_embeddings"])


def run_summary(books: DataFrame) -> DataFrame:
    """One row: books, those with keywords, tags and usable vectors."""
    filled = lambda c: F.count_if(F.coalesce(F.size(c), F.lit(0)) > 0)
    return books.agg(
        F.count("*").alias("books"),
        filled("keywords").alias("with_keywords"),
        filled("domain_tags").alias("with_tags"),
        F.count_if(F.exists("embedding", lambda x: x != 0)).alias("with_embedding"),
        filled("keywords_embeddings").alias("with_keyword_vectors"),
        F.sum(F.greatest(F.coalesce(F.size("keywords_embeddings"), F.lit(0)), F.lit(0))).alias("keyword_vectors"),
    )
