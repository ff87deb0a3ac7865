"""DuckDB SQL of the queries in quillstone.plans.queries, over the same tables."""

from __future__ import annotations

TARGET = "(select coalesce(min(book_id), -1) from books where len(embedding) = 128 and len(keywords_embeddings) > 0 and len(domain_tags) > 0)"

_BAD = "x is null or isnan(x) or isinf(x)"

FEATURES = f"""checked as (
    select *, list_transform(embedding, lambda x: coalesce(x, 0)) as emb,
        list_transform(keywords_embeddings, lambda v: list_transform(coalesce(v, []), lambda x: coalesce(x, 0))) as ks,
        coalesce(len(embedding) > 0 and len(list_filter(embedding, lambda x: {_BAD})) = 0
            and len(list_filter(embedding, lambda x: x <> 0)) > 0, false) as good,
        coalesce(len(keywords_embeddings) > 0 and len(keywords_embeddings[1]) > 0 and len(list_filter(keywords_embeddings,
            lambda v: v is null or len(v) <> len(keywords_embeddings[1]) or len(list_filter(v, lambda x: {_BAD})) > 0)) = 0, false) as kw_good
    from books
), means as materialized (
    select book_id, ks, list_transform(range(1, len(ks[1]) + 1), lambda i: list_sum(list_transform(ks, lambda v: v[i])) / len(ks)) as m
    from checked where kw_good
), kw as materialized (
    select book_id, case when list_dot_product(m, m) > 0 then list_transform(m, lambda x: x / sqrt(list_dot_product(m, m))) end as kw_mean,
        list_transform(ks, lambda v: case when list_dot_product(v, v) > 0 then list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) else v end) as kw_units
    from means
), units as materialized (
    select book_id, list_transform(emb, lambda x: x / sqrt(list_dot_product(emb, emb))) as unit from checked where good
), feat as materialized (
    select c.book_id, c.title, c.rating, c.publication_date, unit, kw_mean, kw_units,
        list_distinct(list_filter(coalesce(c.domain_tags, []), lambda t: t is not null)) as tags
    from books c left join units using (book_id) left join kw using (book_id)
)"""


def _scored(target_filter: str, beta: str = "0.25") -> str:
    return f"""t as materialized (select * from feat where {target_filter}), parts as (
    select f.*, t.book_id as t_id,
        coalesce(case when len(t.unit) = len(f.unit) then list_dot_product(t.unit, f.unit) end, 0) as sem,
        coalesce(case when len(t.kw_mean) = len(f.kw_mean) then list_dot_product(t.kw_mean, f.kw_mean) end, 0) as kw_avg,
        coalesce(case when len(t.kw_units[1]) = len(f.kw_units[1]) then greatest(0, list_max(list_transform(t.kw_units,
            lambda a: list_max(list_transform(f.kw_units, lambda c: list_dot_product(a, c)))))) end, 0) as kw_max,
        len(list_intersect(t.tags, f.tags)) as shared, len(t.tags) = 0 or len(f.tags) = 0 as no_tags
    from feat f join t on f.book_id <> t.book_id
), blended as (
    select *, 0.4 * kw_avg + 0.6 * kw_max as kws, 0.6 * sem + 0.4 * (0.4 * kw_avg + 0.6 * kw_max) as comb,
        case when no_tags or shared = 0 then 1 when shared = 1 then 1 - {beta} when shared = 2 then 1 - 2 * {beta} else 0 end::double as coef
    from parts
), scored as (
    select book_id, t_id, title, rating, publication_date, cast(shared as int) as overlap_count, coef as overlap_coefficient,
        round(sem, 6) as semantic_similarity, round(kws, 6) as keyword_similarity, round(comb, 6) as combined_similarity,
        round(comb * coef, 6) as final_score, comb
    from blended
)"""


ONE = f"with {FEATURES}, {_scored(f'book_id = {TARGET}')}"


def _recommend(order: str = "utility_score desc", keep: str = "overlap_coefficient > 0") -> str:
    return f"""{ONE}, found as (
    select * from scored where {keep} order by final_score desc, book_id limit 20
), useful as (
    select *, combined_similarity * overlap_coefficient as similarity_score,
        round(0.7 * (combined_similarity * overlap_coefficient) + 0.2 * (coalesce(rating, 0) / 10)
        + 0.1 * coalesce(greatest(0, 1 - date_diff('day', publication_date, date '2026-01-01') / 365.25 / 30), 0), 6) as utility_score
    from found
), best as (select * from useful order by {order} nulls last, final_score desc, book_id limit 10)
select """


_RESULT = "book_id, title, combined_similarity, overlap_count, final_score, utility_score, rating from best"

_PLAIN = "trim(regexp_replace(regexp_replace(coalesce({0}, ''), '[^一-龥a-zA-Z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"
_BOOKS = "b as (select * exclude (books_intro), books_intro as book_intro from books)"


def _texts(column: str, first: int) -> str:
    return f"array_to_string(list_filter(list_transform(list_slice(coalesce({column}, []), 1, {first}), lambda t: trim(t)), lambda t: length(t) > 0), ' ')"


_KEYWORD_TEXT = (
    "array_to_string(list_filter([trim(coalesce(title, '')), trim(coalesce(title, '')), trim(coalesce(book_intro, '')), trim(coalesce(author_intro, '')), "
    + ", ".join([_texts("short_reviews", 5), _texts("reviews", 3), _texts("reading_notes", 3)])
    + "], lambda p: length(p) > 0), ' ')"
)
_EMBEDDING_TEXT = (
    "array_to_string(list_concat(list_filter([title, book_intro, author_intro], lambda p: length(p) > 0), list_concat("
    "list_filter(coalesce(short_reviews, []), lambda p: length(p) > 0), list_concat(list_filter(coalesce(reviews, []), lambda p: length(p) > 0), "
    "list_filter(coalesce(reading_notes, []), lambda p: length(p) > 0)))), ' ')"
)

_PIECES = """list_concat(regexp_extract_all(t, '[a-z0-9]+'), flatten(list_transform(regexp_extract_all(t, '[一-龥]+'),
        lambda r: case when length(r) < 3 then [r] else list_transform(range(1, length(r)), lambda i: substr(r, i, 2)) end)))"""

_TERMS = f"""with {_BOOKS}, plain as (
    select book_id, lower({_PLAIN.format("(" + _KEYWORD_TEXT + ")")}) as t from b
), words as (
    select book_id, unnest({_PIECES}) as term from plain
), tf as (
    select book_id, term, count(*) as tf from words
    where length(term) > 1 and term not in (select lower(trim(word)) from stop_words where word is not null) group by all
), n as (select count(*) as n from books), vocabulary as (
    select term, ln((1 + n) / (1 + df)) + 1 as idf
    from (select term, count(*) as df, sum(tf) as ctf from tf group by term), n where df >= 2 and df <= 0.85 * n order by ctf desc, term limit 5000
), raw as (select book_id, term, tf * idf as raw from tf join vocabulary using (term)), weighted as (
    select book_id, term, round(raw / sqrt(sum(raw * raw) over (partition by book_id)), 6) as score from raw
), best as (
    select * from (select *, row_number() over (partition by book_id order by score desc, term desc) as r from weighted where score > 0) where r <= 30
), tfidf as (
    select * from (select book_id, term, score, cast(row_number() over (partition by book_id order by score desc, term desc) as int) as position
        from best where not regexp_full_match(term, '[0-9]+')) where position <= 10
), frequent as (
    select * from (select book_id, term, cast(tf as double) as score, cast(row_number() over (partition by book_id order by tf desc, term) as int) as position
        from tf where not regexp_full_match(term, '[0-9]+')) where position <= 10
)"""


def _word_graph(kept: str, most: int, k: int) -> str:
    """The tables of a word graph over ``plain``: its words, edges, thirty rounds, and the k best clean words of ``most``."""
    return f"""pieces as (select book_id, {_PIECES} as w from plain), seq as materialized (
    select book_id, term, row_number() over (partition by book_id order by i) as i
    from (select book_id, unnest(w) as term, unnest(range(len(w))) as i from pieces)
    where length(term) > 1 and {kept} and term not in (select lower(trim(word)) from stop_words where word is not null)
), edges as materialized (
    select a.book_id, a.term as x, b.term as y, count(*) as n from seq a join seq b
    on a.book_id = b.book_id and b.i between a.i - 4 and a.i + 4 and a.term <> b.term group by all
), flows as materialized (
    select book_id, x, y, n / sum(n) over (partition by book_id, x) as share from edges
    union all select distinct book_id, term, term, 0 from seq where book_id in (select book_id from edges)
), rounds as (
    select distinct book_id, term, 1::double as s, 0 as round from seq where book_id in (select book_id from edges)
    union all select f.book_id, f.y, 0.15 + 0.85 * sum(f.share * r.s), r.round + 1
    from rounds r join flows f on f.book_id = r.book_id and f.x = r.term where r.round < 30 group by f.book_id, f.y, r.round
), graphed as (
    select book_id, term, round(s / max(s) over (partition by book_id), 6) as score from rounds where round = 30
    union all select distinct book_id, term, 1 from seq where book_id not in (select book_id from edges)
), textrank as (
    select * from (select book_id, term, score, cast(row_number() over (partition by book_id order by score desc, term) as int) as position
        from (select *, row_number() over (partition by book_id order by score desc, term) as r from graphed)
        where r <= {most} and not regexp_full_match(term, '[0-9]+')) where position <= {k}
)"""


def _fused(first: str, second: str) -> str:
    """The tables that fuse two ranked lists to ten."""
    return f"""two as (
    select book_id, term, 2 * (count(*) over (partition by book_id) - position + 1) as s, position as seen from {first}
    union all select book_id, term, count(*) over (partition by book_id) - position + 1, 1000000 + position from {second}
), extracted as (
    select book_id, list(term order by position) filter (length(term) > 1 and not regexp_full_match(term, '[0-9]+')) as keywords
    from (select book_id, term, row_number() over (partition by book_id order by sum(s) desc, min(seen)) as position from two group by book_id, term)
    where position <= 10 group by book_id
)"""


_GRAPH = f"{_TERMS.replace('with ', 'with recursive ', 1)}, {_word_graph('true', 20, 10)}, {_fused('tfidf', 'textrank')}"
_SINGLE = f"""with recursive {_BOOKS}, plain as (
    select book_id, lower({_PLAIN.format("concat_ws(chr(32), title, book_intro, author_intro)")}) as t from b
), {_word_graph("not regexp_full_match(term, '[0-9]+')", 40, 20)}, frequent as (
    select * from (select book_id, term, row_number() over (partition by book_id order by count(*) desc, min(i)) as position from seq group by book_id, term)
    where position <= 20
), {_fused("frequent", "textrank")}"""

_LEX_TEXT = f"lower({_PLAIN.format('concat_ws(chr(32), title, book_intro, author_intro)')})"
_LEX = f"""with {_BOOKS}, plain as (select book_id, {_LEX_TEXT} as t from b), scores as (
    select book_id, domain_idx, sum((length(t) - length(replace(t, lower(keyword), ''))) // length(keyword)) as score
    from plain, domain_lexicon where keyword <> '' group by all having score > 0
), ranked as (
    select book_id, domain, row_number() over (partition by book_id order by score desc, domain_idx) as r
    from scores join (select distinct domain_idx, domain from domain_lexicon) using (domain_idx)
), tagged as (
    select book_id, coalesce(list(domain order by r) filter (r <= 2), ['其他']) as tags from books left join ranked using (book_id) group by book_id
)"""

_FORMATS = "['%Y-%m-%d', '%Y/%m/%d', '%Y年%m月%d日', '%Y-%m', '%Y/%m', '%Y年%m月', '%Y']"
_RECS = "r as (select distinct on (rec_id) * from recommendations)"
_PERCENT = "cast(count(*) as bigint) as n, round(count(*) / (select count(*) from books) * 100, 2) as percent"
_LIST_LENGTH = "cast(case when starts_with(trim({0}), '[') and json_valid({0}) then json_array_length({0}) else 0 end as int) as n_{0}"

_MODEL = [f"cast({x} as double)" for x in ("length(coalesce({0}, '')) * (trim(coalesce({0}, '')) <> '')::int", "length(coalesce({0}, '')) - length(replace(coalesce({0}, ''), 'a', ''))")]

SQL: dict[str, str] = {
    "semantic_topk": f"{ONE} select book_id, semantic_similarity from scored order by semantic_similarity desc, book_id limit 10",
    "pair_scores": f"""{ONE} select book_id, semantic_similarity, keyword_similarity, combined_similarity, overlap_count, overlap_coefficient,
        final_score from scored""",
    "cross_domain_topk": _recommend() + _RESULT,
    "recommend_all": _recommend(keep="true") + _RESULT,
    "recommend_strict": _recommend(keep="overlap_count = 0") + _RESULT,
    "recommend_by_similarity": _recommend("similarity_score desc") + _RESULT,
    "recommend_by_rating": _recommend("coalesce(rating, 0) desc") + _RESULT,
    "recommend_by_newest": _recommend("publication_date desc") + _RESULT,
    "recommend_by_final": _recommend("final_score desc") + _RESULT,
    "beta_sweep": f"""{ONE}, grid as (select unnest([0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45])::double as beta), each_beta as (
        select beta, book_id, case overlap_count when 0 then 1.0 when 1 then 1 - beta when 2 then 1 - 2 * beta else 0 end as c, combined_similarity
        from scored, grid
    ), finals as (select beta, book_id, round(combined_similarity * c, 6) as final_score from each_beta where c > 0)
    select beta, book_id, final_score, cast(row_number() over (partition by beta order by final_score desc, book_id) as int) as position
    from finals qualify position <= 6""",
    "all_books_topk": f"""with {FEATURES}, {_scored("book_id % 100 = 0")}
    select t_id as book_id, book_id as neighbour_id, final_score,
        cast(row_number() over (partition by t_id order by final_score desc, book_id) as int) as position
    from scored where overlap_coefficient > 0 qualify position <= 10""",
    "domain_distribution": _recommend() + "tag, count(*) as n from (select unnest(domain_tags) as tag from best join books using (book_id)) group by tag",
    "catalog_page": "select book_id, title, rating from books order by rating desc nulls last, book_id limit 20 offset 20",
    "catalog_newest": "select book_id, title, publication_date from books order by publication_date desc nulls last, book_id limit 20",
    "catalog_search": """select book_id, title, publisher from books
        where lower(title) like '%source%' or len(list_filter(authors, lambda a: lower(a) like '%source%')) > 0 order by book_id limit 20""",
    "catalog_count": """select count(*) as total, cast(ceil(count(*) / 20) as bigint) as pages from books
        where lower(title) like '%source%' or len(list_filter(authors, lambda a: lower(a) like '%source%')) > 0""",
    "book_detail": f"""select book_id, title, author_intro, books_intro as book_intro, rating, cast(coalesce(len(authors), 0) as int) as n_authors,
        cast(coalesce(len(reviews), 0) as int) as n_reviews from books where book_id = {TARGET}""",
    "hot_list": "select book_id, title, rating from books order by rating desc nulls last, book_id limit 8",
    "selected_first": """with page as (select book_id from books order by book_id limit 20)
        select book_id, cast(row_number() over (order by (book_id = 1010) desc, book_id) as int) as position from page""",
    "display_lists": """with a as (select book_id, list_filter(coalesce(authors, []), lambda a: length(trim(a)) > 0) as authors, domain_tags from books)
        select book_id, array_to_string(list_slice(list_filter(coalesce(domain_tags, []), lambda t: t is not null), 1, 3), ', ') as shown_tags,
        coalesce(authors[1], 'unknown') as first_author, case when len(authors) > 0 then array_to_string(authors, ', ') else 'unknown' end as all_authors from a""",
    "display_scores": _recommend()
    + """book_id, printf('%.1f%%', coalesce(nullif(utility_score, 0), final_score, 0) * 100) as shown_score,
        case when overlap_count = 0 then 'fully cross-domain' else 'partially cross-domain' end as badge from best""",
    "catalog_stats": """select count(*) as total_books, coalesce(round(avg(rating), 2), 0) as average_rating,
        (select count(distinct tag) from (select unnest(domain_tags) as tag from books)) as total_domains from books""",
    "tag_statistics": f"select tag, {_PERCENT} from (select unnest(domain_tags) as tag from books) group by tag",
    "filtered_rank": f"""with {_RECS} select rec_id, book_id, coalesce(final_score, 0) as final_score, coalesce(rating, 0) as rating,
        coalesce(cast(try_strptime(trim(publication_date), {_FORMATS}) as date), date '1900-01-01') as publication_date
        from r where coalesce(rating, 0) >= 8 and coalesce(price, 0) <= 60 order by final_score desc, rec_id limit 50""",
    "target_topk": f"""with {_RECS} select target_book_id, cast(row_number() over (partition by target_book_id
        order by final_score desc nulls last, rec_id) as int) as position, rec_id, final_score from r qualify position <= 3""",
    "date_parse": f"with {_RECS} select rec_id, cast(try_strptime(trim(publication_date), {_FORMATS}) as date) as parsed from r",
    "raw_decode": f"""select load_id, {_LIST_LENGTH.format("authors")}, {_LIST_LENGTH.format("domain_tags")}, {_LIST_LENGTH.format("keywords")}
        from (select distinct * from books_raw)""",
    "raw_latest": """select book_id, arg_max(load_id, (loaded_at, load_id)) as load_id, count(distinct load_id) as loads
        from (select distinct * from books_raw) group by book_id""",
    "update_merge": """with last as (select book_id, arg_max(title, (loaded_at, load_id)) as new from (select distinct * from books_raw)
        where trim(title) <> '' group by book_id) select book_id, coalesce(new, title) as title from books left join last using (book_id)""",
    "text_normalise": f"select book_id, {_PLAIN.format('books_intro')} as kept, lower({_PLAIN.format('title')}) as lowered from books",
    "token_filter": """with k as (select book_id, list_filter(list_transform(coalesce(keywords, []), lambda w: trim(w)),
            lambda w: w is not null and length(w) > 1 and not regexp_full_match(w, '[0-9]+')) as ks from books),
        first_seen as (select book_id, list_filter(list_transform(range(1, len(ks) + 1), lambda i: case when list_position(ks, ks[i]) = i then ks[i] end),
            lambda w: w is not null) as ks from k)
        select book_id, cast(len(ks) as int) as n, array_to_string(ks, '|') as cleaned from first_seen""",
    "text_assembly": f"with {_BOOKS} select book_id, md5({_KEYWORD_TEXT}) as for_keywords, cast(length({_EMBEDDING_TEXT}) as int) as for_embedding from b",
    "lexicon_scores": f"{_LEX} select book_id, domain_idx, cast(score as bigint) as score from scores",
    "lexicon_tags": f"{_LEX} select book_id, array_to_string(tags, '|') as tags from tagged",
    "lexicon_tag_statistics": f"{_LEX} select tag, {_PERCENT} from (select unnest(tags) as tag from tagged) group by tag",
    "tfidf_topk": f"{_TERMS} select book_id, term, score, position from tfidf",
    "hashed_embedding": f"""with plain as (select doc_id, lower({_PLAIN.format("text")}) as t from documents), words as (
        select doc_id, unnest({_PIECES}) as w from plain
    ), slots as (select doc_id, cast(md5_number_upper(w) % 64 as int) as slot, count(*) as n from words where w <> '' group by all), scaled as (
        select doc_id, slot, n / sqrt(sum(n * n) over (partition by doc_id)) as x from slots
    ) select d.doc_id, cast(count(slot) as int) as used, coalesce(round(max(x), 6), 0) as largest,
        coalesce(string_agg(printf('%d:%.6f', slot, x), ' ' order by slot), '') as entries from documents d left join scaled using (doc_id) group by d.doc_id""",
    "textrank_topk": f"{_GRAPH} select book_id, term, score, position from textrank",
    "keyword_extract": f"{_GRAPH} select book_id, coalesce(array_to_string(extracted.keywords, '|'), '') as keywords from books left join extracted using (book_id)",
    "enrich_pipeline": f"""{_GRAPH}, embedded as (
        select book_id, lower({_PLAIN.format("(" + _EMBEDDING_TEXT + ")")}) as t from b
    ) select count(*) as books, count(*) filter (len(keywords) > 0) as with_keywords, count(*) as with_tags,
        count(*) filter (len({_PIECES}) > 0) as with_embedding, count(*) filter (len(keywords) > 0) as with_keyword_vectors,
        cast(coalesce(sum(len(keywords)), 0) as bigint) as keyword_vectors from embedded left join extracted using (book_id)""",
    "single_book_keywords": f"{_SINGLE} select book_id, coalesce(array_to_string(extracted.keywords, '|'), '') as keywords from books left join extracted using (book_id)",
    "request_topk": _recommend().replace("limit 20", "limit 12").replace("limit 10", "limit 6") + _RESULT,
    "catalog_deep_page": "select book_id, title, rating from books order by rating desc nulls last, book_id limit 20 offset 20",
    "segment_terms": f"""with {_BOOKS}, words as (
        select book_id, unnest(regexp_extract_all(lower({_PLAIN.format("(" + _KEYWORD_TEXT + ")")}), '[a-z0-9]+')) as term from b
    ) select book_id, term, count(*) as tf from words where length(term) > 1 and regexp_full_match(term, '[a-z]+')
        and term not in (select lower(trim(word)) from stop_words where word is not null) group by all""",
    "model_embedding": f"""select book_id, {_MODEL[0].format("books_intro")} as first, {_MODEL[1].format("books_intro")} as second from books""",
    "model_keyword_vectors": f"""select book_id, array_to_string(list_transform(list_filter(coalesce(keywords, []), lambda k: trim(k) <> ''),
        lambda k: concat(cast({_MODEL[0].format("k")} as int), ':', cast({_MODEL[1].format("k")} as int))), '|') as vectors from books""",
    "embedding_update": "select book_id, cast(case when book_id % 4 = 0 then 2 else coalesce(len(embedding), 0) end as int) as length from books",
    "feature_columns": """select 'lacking' as source, count(*) as books, 0 as vectors, 0 as keyword_vectors from books
        union all select 'whole', count(*), count(embedding), count(keywords_embeddings) from books""",
    "source_formats": """select kind, count(*) as books, cast(sum(book_id) as bigint) as ids, count(title) as titles, cast(sum(coalesce(len(keywords), 0)) as bigint) as keywords,
        cast(sum(coalesce(len(domain_tags), 0)) as bigint) as tags, count(publication_date) as dates, round(sum(rating), 4) as ratings
        from books, (values ('parquet'), ('orc'), ('json'), ('csv')) as k(kind) group by kind""",
    "lexicon_file": "select domain_idx, domain, kw_idx, keyword from domain_lexicon",
    "stop_words_file": """select distinct unnest([trim(word), lower(trim(word))]) as word from stop_words where trim(word) <> ''""",
    "loaded_table": """with f as (select * from books order by book_id limit 100)
        select (select count(*) from books) as books, (select string_agg(title, '|' order by book_id) from (select * from f order by book_id limit 3)) as preview,
        cast((select count(distinct tag) from (select unnest(domain_tags) as tag from f)) as int) as tags""",
    "response_metadata": f"{ONE} select count(*) as total_candidates, 0.25::double as beta from scored where overlap_coefficient > 0",
    "pair_by_ids": f"""{ONE} select semantic_similarity, keyword_similarity, combined_similarity, overlap_count, overlap_coefficient, final_score
        from scored where book_id = (select min(book_id) from books where book_id % 7 = 0 and book_id <> {TARGET})""",
    "tf_keywords": f"{_TERMS} select book_id, term, score, position from frequent",
    "keyword_fusion": f"""{_TERMS}, lists as (
        select book_id, term, 2 * (count(*) over (partition by book_id) - position + 1) as s, position as seen from tfidf
        union all select book_id, term, count(*) over (partition by book_id) - position + 1, 1000000 + position from frequent
    ), summed as (select book_id, term, sum(s) as score, min(seen) as seen from lists group by all)
    select book_id, term, cast(score as bigint) as score, cast(row_number() over (partition by book_id order by score desc, seen) as int) as position
    from summed qualify position <= 10""",
    "keyword_summary": """select count(*) as total, round(avg(coalesce(len(keywords), 0)), 4) as mean_keywords,
        count(*) filter (coalesce(len(keywords), 0) = 0) as "without" from books""",
    "distinct_vectors": "select count(distinct coalesce(cast(keywords_embeddings as varchar), '')) as distinct_vectors from books",
    "mode_catalogue": """select * from (values ('comprehensive', 'utility_score', 'weighted utility of similarity, rating and recency'),
        ('similarity', 'similarity_score', 'similarity alone'), ('rating', 'rating', 'readers'' rating'),
        ('newest', 'publication_date', 'latest publication first'), ('final', 'final_score', 'the retrieval score itself'))
        as m(mode, orders_by, description)""",
    "window_counts": """select cast(requested_at as date) as window_start, target_book_id, count(*) as n
        from (select distinct on (rec_id, requested_at) * from recommendations where requested_at is not null) group by all""",
}
