"""Queries of this package: name -> callable(spark, sf_dir), and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm import abuse, distinctive, encode, mixing, names, neardup, ranking, setjoin, subjects, vectors
from quillstone.llm.arrow import table


def p1_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of every target, ranked by leximin over final score, rating and publication date."""
    scored = ranking.candidate_scores(table(spark, sf_dir, "recommendations"), table(spark, sf_dir, "books"))
    ranked = ranking.leximin(scored, "target_book_id", "rec_id", ["final_score", "rating", "published"])
    columns = [F.col("percentiles")[i].alias(n) for i, n in enumerate(["p_final_score", "p_rating", "p_published"])]
    return ranked.select("target_book_id", "rec_id", "rank", *columns)


def p1_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All books in one ranking by leximin over rating, publication date and number of reviews."""
    scored = ranking.catalogue_scores(table(spark, sf_dir, "books"), "2026-01-01")
    ranked = ranking.leximin(scored, "catalogue", "book_id", ["rating", "published", "reviews"])
    columns = [F.col("percentiles")[i].alias(n) for i, n in enumerate(["p_rating", "p_published", "p_reviews"])]
    return ranked.select("book_id", "rank", *columns)


def p2_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = (table(spark, sf_dir, name) for name in ("books", "subject_labels", "domain_lexicon"))
    return subjects.subject_scores(*given).withColumnRenamed("record", "book_id")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_scores(spark, sf_dir).filter("score >= 0.5").select("book_id", "subject")


def p2_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Books of each subject, and their share of all books that show a subject; a book of several counts for each in part."""
    held = p2_found(spark, sf_dir)
    parts = held.join(held.groupBy("book_id").agg((1 / F.count("*")).alias("part")), "book_id")
    total = parts.agg(F.sum("part").alias("total"))
    counted = parts.groupBy("subject").agg(F.count("*").alias("books"), F.sum("part").alias("weight"))
    return counted.crossJoin(F.broadcast(total)).select("subject", "books", F.round(F.col("weight") / F.col("total"), 6).alias("share"))


def p3_near(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return neardup.near_duplicates(table(spark, sf_dir, "books"), "book_id", "books_intro", ["title", "books_intro", "author_intro"])


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setjoin.expanded(*p3_near(spark, sf_dir)).select(F.col("a").alias("book_a"), F.col("b").alias("book_b"))


def p3_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of every book that takes part, by its smallest book, and the number of books it is linked with."""
    return neardup.near_groups(*p3_near(spark, sf_dir)).select(F.col("record").alias("book_id"), F.col("group").alias("group_id"), "links")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = names.variant_pairs(table(spark, sf_dir, "books"), "authors")
    return pairs.select(F.col("a").alias("name_a"), F.col("b").alias("name_b"))


def p4_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every spelling with the first spelling of its class."""
    return names.variant_classes(table(spark, sf_dir, "books"), "authors")


def p5_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distinctive.parsimonious(distinctive.term_occurrences(table(spark, sf_dir, "books"), "book_id", "keywords", "books_intro", "reviews"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distinctive.distinctive_found(p5_scores(spark, sf_dir)).select(F.col("record").alias("book_id"), "term")


def p5_top_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = distinctive.distinctive_terms(p5_scores(spark, sf_dir))
    return top.select(F.col("record").alias("book_id"), "rank", "term", F.round("weight", 9).alias("weight"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = vectors.nearest(table(spark, sf_dir, "books"), "book_id", "embedding", 128)
    return found.select(F.col("record").alias("book_id"), F.col("neighbour").alias("neighbour_id"))


def p6_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The neighbours of the books whose id is divisible by 100, against all, by a tree of 64 leaves without any loss."""
    found = vectors.nearest(table(spark, sf_dir, "books"), "book_id", "embedding", 128, depth=6, miss=1e-9, queries=F.col("book_id") % 100 == 0)
    return found.select(F.col("record").alias("book_id"), F.col("neighbour").alias("neighbour_id"), "similarity")


def p6_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most similar other keyword vectors of every usable keyword vector, each by its book and its position from 0."""
    found = vectors.nearest_listed(table(spark, sf_dir, "books"), "book_id", "keywords_embeddings", 64)
    return found.select(
        F.col("record").alias("book_id"), "position", F.col("neighbour").alias("neighbour_id"), "neighbour_position", "similarity"
    )


def p7_similar(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return setjoin.similar_sets(table(spark, sf_dir, "books"), "book_id", "keywords", "domain_tags", 3)


def p7_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first book with the same set as each book, and the number of books it is linked with."""
    pairs, members = p7_similar(spark, sf_dir)
    linked = members.select("rep", "record").join(setjoin.links(pairs, members), "rep")
    return linked.select(F.col("record").alias("book_id"), F.col("rep").alias("class_id"), "links")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setjoin.expanded(*p7_similar(spark, sf_dir)).select(F.col("a").alias("book_a"), F.col("b").alias("book_b"))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode.encode(table(spark, sf_dir, "documents"))


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed, _ = mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "source_targets"))
    return mixed.select("doc_id", "source", "n_tokens", F.round("rate", 6).alias("rate"), "copies")


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, reached = mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "source_targets"))
    return reached


def p10_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return abuse.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "moderation_labels"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p10_scores(spark, sf_dir).filter("toxic").select("doc_id").distinct()


def p10_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, toxic ones and their rate per source, sources in one notation."""
    source = F.regexp_replace(F.lower(F.trim("source")), "-", "_").alias("source")
    documents = table(spark, sf_dir, "documents").select("doc_id", source)
    scored = p10_scores(spark, sf_dir).select("doc_id", "toxic")
    counted = documents.join(scored, "doc_id").groupBy("source").agg(F.count("*").alias("documents"), F.count_if("toxic").alias("toxic"))
    return counted.withColumn("rate", F.round(F.col("toxic") / F.col("documents"), 6))


QUERIES = {
    "p1_ranking": p1_ranking,
    "p1_catalogue": p1_catalogue,
    "p2_found": p2_found,
    "p2_composition": p2_composition,
    "p3_found": p3_found,
    "p3_groups": p3_groups,
    "p4_found": p4_found,
    "p4_classes": p4_classes,
    "p5_found": p5_found,
    "p5_top_terms": p5_top_terms,
    "p6_found": p6_found,
    "p6_exact": p6_exact,
    "p6_keywords": p6_keywords,
    "p7_found": p7_found,
    "p7_classes": p7_classes,
    "p8_ids": p8_ids,
    "p9_mix": p9_mix,
    "p9_shares": p9_shares,
    "p10_found": p10_found,
    "p10_rates": p10_rates,
}

_LEXIMIN = """, counted as (
    select *, {shares}
    from scored
), vectors as (
    select *, list_sort([{names}]) as vector from counted
)
select {columns}, cast(row_number() over (partition by {group} order by vector desc, {item}) as bigint) as rank, {names} from vectors"""


def _share(score: str, name: str, group: str) -> str:
    """Mid-rank percentile among the group's known values, 0.5 for an unknown one."""
    known = f"partition by {group}, {score} is null"
    return (
        f"round(case when {score} is null then 0.5 else (rank() over ({known} order by {score}) - 1"
        f" + count(*) over ({known}, {score}) / 2.0) / count(*) over ({known}) end, 9) as {name}"
    )


def _leximin_sql(scored: str, group: str, item: str, columns: str, scores: dict[str, str]) -> str:
    shares = ", ".join(_share(s, n, group) for s, n in scores.items())
    return f"with {scored}" + _LEXIMIN.format(shares=shares, names=", ".join(scores.values()), columns=columns, group=group, item=item)


_FORMATS = "['%Y-%m-%d', '%Y/%m/%d', '%Y年%m月%d日', '%Y-%m', '%Y/%m', '%Y年%m月', '%Y']"
_USUAL = "case when {0} >= date '1901-01-01' and {0} <= coalesce(cast(requested_at as date), date '9999-12-31') then {0} end"

_WIDE = "".join(map(chr, range(0xFF01, 0xFF5F))) + "\u3000\xa0"
_NARROW = "".join(map(chr, range(0x21, 0x7F))) + "  "


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _folded(text: str) -> str:
    """Lower case and one width: of NFKC what these tables hold."""
    return f"lower(nfc_normalize(translate({text}, {_quoted(_WIDE)}, {_quoted(_NARROW)})))"


def _normal(text: str) -> str:
    return f"trim(regexp_replace({_folded(f'coalesce({text}, {chr(39) * 2})')}, '[\\s\\p{{Z}}]+', ' ', 'g'))"


def _normal_list(items: str) -> str:
    """Distinct normalised items of a list column, without blanks."""
    return f"list_distinct(list_filter(list_transform(coalesce({items}, []), lambda x: {_normal('x')}), lambda x: x <> ''))"


_SIMILAR = f"""with sets as materialized (
    select book_id, list_distinct(list_concat(k, {_normal_list("domain_tags")})) as s
    from (select *, {_normal_list("keywords")} as k from (select distinct on (book_id) * from books)) where len(k) >= 3
), pairs as materialized (
    select a.book_id as book_a, b.book_id as book_b from sets a join sets b on a.book_id < b.book_id
    where len(list_intersect(a.s, b.s)) >= 0.6 * (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s)))
)"""

_UNIT = """usable as (
    select book_id, list_transform(embedding, lambda x: cast(cast(x as float) as double)) as v from books
    where len(embedding) = 128 and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0
), units as materialized (select book_id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) as u from usable)"""

_NEAR = f"""with recursive joined as (
    select book_id, regexp_replace({_folded("concat(title, books_intro, author_intro)")}, '[^\\p{{L}}\\p{{N}}]+', '', 'g') as t
    from (select distinct on (book_id) * from books) where trim(books_intro) <> ''
), grams as materialized (
    select book_id, unnest(list_distinct(list_transform(range(1, length(t) - 2), lambda i: substr(t, i, 4)))) as g from joined where length(t) >= 80
), sizes as (select book_id, count(*) as n from grams group by all), shared as (
    select a.book_id as book_a, b.book_id as book_b, count(*) as met from grams a join grams b on a.g = b.g and a.book_id < b.book_id group by all
), pairs as materialized (
    select book_a, book_b from shared join sizes a on a.book_id = book_a join sizes b on b.book_id = book_b where met >= 0.6 * (a.n + b.n - met)
)"""

ORACLE_SQL: dict[str, str] = {
    "p3_found": f"{_NEAR} select book_a, book_b from pairs",
    "p3_groups": f"""{_NEAR}, edges as (select book_a as a, book_b as b from pairs union all select book_b, book_a from pairs), reached as (
    select book_id as a, book_id as b from sizes union select r.a, e.b from reached r join edges e on r.b = e.a
)
select book_id, group_id, cast(coalesce(links, 0) as bigint) as links from (select a as book_id, min(b) as group_id from reached group by a)
left join (select a as book_id, count(*) as links from edges group by a) using (book_id)""",
    "p5_found": f"""with listed as (
    select distinct book_id, unnest({_normal_list("keywords")}) as term from books
), few as (select term from listed group by term having count(*) between 2 and 8), texts as (
    select book_id, unnest(list_concat([{_normal("books_intro")}], list_transform(coalesce(reviews, []), lambda x: {_normal("x")}))) as t from books
)
select book_id, term from listed join few using (term) join texts using (book_id)
group by all having sum((length(t) - length(replace(t, term, ''))) // length(term)) >= 3""",
    "p6_found": f"""with {_UNIT}
select a.book_id, b.book_id as neighbour_id from units a join units b on a.book_id <> b.book_id
qualify row_number() over (partition by a.book_id order by round(list_dot_product(a.u, b.u), 9) desc, b.book_id) <= 5""",
    "p6_exact": f"""with {_UNIT}
select a.book_id, b.book_id as neighbour_id, round(list_dot_product(a.u, b.u), 9) as similarity from units a join units b on a.book_id <> b.book_id
where a.book_id % 100 = 0 qualify row_number() over (partition by a.book_id order by round(list_dot_product(a.u, b.u), 9) desc, b.book_id) <= 5""",
    "p6_keywords": """with listed as (
    select book_id, unnest(range(0, len(keywords_embeddings))) as position, unnest(keywords_embeddings) as v from books where book_id is not null
), usable as (
    select book_id, position, list_transform(v, lambda x: cast(cast(x as float) as double)) as v from listed
    where len(v) = 64 and len(list_filter(v, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(v, lambda x: x <> 0)) > 0
), units as materialized (select book_id, position, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) as u from usable)
select a.book_id, cast(a.position as int) as position, b.book_id as neighbour_id, cast(b.position as int) as neighbour_position,
    round(list_dot_product(a.u, b.u), 9) as similarity
from units a join units b on a.book_id <> b.book_id or a.position <> b.position
qualify row_number() over (partition by a.book_id, a.position order by round(list_dot_product(a.u, b.u), 9) desc, b.book_id, b.position) <= 5""",
    "p7_found": f"{_SIMILAR} select book_a, book_b from pairs",
    "p7_classes": f"""{_SIMILAR}, linked as (select a, count(*) as links from (select book_a as a from pairs union all select book_b from pairs) group by a)
select book_id, min(book_id) over (partition by list_sort(s)) as class_id, cast(coalesce(links, 0) as bigint) as links
from sets left join linked on a = book_id""",
    "p1_ranking": _leximin_sql(
        f"""dated as (
    select r.*, b.rating as book_rating, b.publication_date as book_date,
        cast(coalesce(try_strptime(trim(r.publication_date), {_FORMATS}), try_strptime(left(trim(r.publication_date), 10), '%Y-%m-%d')) as date) as d
    from (select distinct on (rec_id) * from recommendations) r left join books b using (book_id)
), scored as (
    select rec_id, target_book_id, final_score,
        coalesce(case when rating > 0 then rating end, case when book_rating > 0 then book_rating end) as rating,
        coalesce({_USUAL.format("d")}, {_USUAL.format("book_date")}) as published
    from dated
)""",
        "target_book_id",
        "rec_id",
        "target_book_id, rec_id",
        {"final_score": "p_final_score", "rating": "p_rating", "published": "p_published"},
    ),
    "p1_catalogue": _leximin_sql(
        """scored as (
    select 1 as catalogue, book_id, case when rating > 0 then rating end as rating,
        case when publication_date between date '1901-01-01' and date '2026-01-01' then publication_date end as published,
        coalesce(len(reviews), 0) as reviews
    from books
)""",
        "catalogue",
        "book_id",
        "book_id",
        {"rating": "p_rating", "published": "p_published", "reviews": "p_reviews"},
    ),
}
