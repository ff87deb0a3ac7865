import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from quillstone import storage
from quillstone.config import Config, Scoring
from quillstone.functions.dates import parse_date
from quillstone.functions.segment import KEYWORD_POS, Dictionary, kept_words, pieces
from quillstone.functions.side import side_rows
from quillstone.functions.text import clean_terms, keyword_text, normalise, normalise_lower, occurrences, tokens
from quillstone.operators import catalog, keywords, ranking, recommend, similarity, tags
from quillstone.operators.embeddings import encode_texts, hashed_documents
from quillstone.plans.pipeline import enrich, run_summary
from quillstone.schema import BOOKS, canonical, decode_list
from quillstone.sources.books import append, create_table, read_books, sample_books, update_database, update_statement, updated, verify_load, write_books
from quillstone.streaming.enrich import read_new_books, requests_per_window, tag_stream


def one(df, column):
    return df.select(column.alias("x")).first()["x"]


def pair_table(spark):
    rows = [
        (1, "a", [1.0, 0.0], [[1.0, 0.0], [0.0, 1.0]], ["x", "y"], 5.0, None),
        (2, "b", [0.6, 0.8], [[1.0, 0.0]], ["y", "z", "y"], 8.0, dt.date(2016, 1, 1)),
        (3, "c", [1.0, 0.0, 0.0], [[1.0], [1.0, 0.0]], [], None, None),
        (4, "d", None, None, None, None, None),
        (5, "e", [0.0, 0.0], [], ["x", "y", "z"], 0.0, None),
    ]
    schema = "book_id long, title string, embedding array<double>, keywords_embeddings array<array<double>>, domain_tags array<string>, rating double, publication_date date"
    return canonical(spark.createDataFrame(rows, schema))


def test_pair_scores_golden(spark):
    row = similarity.calculate_similarity(pair_table(spark), 1, 2).first()
    assert row["sim_avg"] == pytest.approx(0.707106781187)
    assert row["keyword_similarity"] == pytest.approx(0.882842712475)
    assert row["semantic_similarity"] == pytest.approx(0.6)
    assert row["combined_similarity"] == pytest.approx(0.713137084990)
    assert (row["overlap_count"], row["overlap_coefficient"]) == (1, 0.75)
    assert row["final_score"] == pytest.approx(0.534852813742)
    assert similarity.calculate_similarity(pair_table(spark), 1, 99).count() == 0


def test_batches_agree_with_columns(spark):
    books = pair_table(spark)
    for target in (1, 2, 3, 5):
        fast = {r["book_id"]: r for r in recommend.candidates(books, target).collect()}
        for other in {1, 2, 3, 4, 5} - {target}:
            row = similarity.calculate_similarity(books, target, other).first()
            for c in ("semantic_similarity", "keyword_similarity", "combined_similarity", "final_score"):
                assert fast[other][c] == pytest.approx(row[c], abs=1e-6), (target, other, c)
            assert fast[other]["overlap_count"] == row["overlap_count"]
    assert recommend.candidates(books, 99).count() == 0
    mirrored = similarity.calculate_similarity(books, 2, 1).first()
    assert mirrored["final_score"] == pytest.approx(fast_score(books, 1, 2))


def fast_score(books, a, b):
    return similarity.calculate_similarity(books, a, b).first()["final_score"]


def test_utility_golden(spark):
    row = ranking.with_utility(
        spark.createDataFrame([(1, 0.713137084990, 0.75, 8.0, dt.date(2016, 1, 1), 0.5)], "book_id long, combined_similarity double, overlap_coefficient double, rating double, publication_date date, final_score double"),
        "2026-01-01",
    ).first()
    assert row["freshness"] == pytest.approx(0.666621035820)
    assert row["utility_score"] == pytest.approx(0.601059073202)


def test_ranking_golden(spark):
    rows = [(1, 0.85, 4.5, "2023-01-15", 89.0), (2, 0.78, 4.2, "2022-06-10", 69.0), (3, 0.92, None, "2021-03-20", 79.0), (4, 0.88, 4.7, None, 99.0), (5, None, 4.3, "2024-02-01", 109.0)]
    df = spark.createDataFrame(rows, "book_id long, final_score double, rating double, publication_date string, price double")
    order = lambda *a, **k: [r["book_id"] for r in ranking.filtered_rank(df, *a, **k).collect()]
    assert order("final") == [3, 4, 1, 2, 5]
    assert order("rating") == [4, 1, 5, 2, 3]
    assert order("newest") == [5, 1, 2, 3, 4]
    assert order("final", min_rating=4.0) == [4, 1, 2, 5]
    assert order("final", max_price=90.0) == [3, 1, 2]
    with pytest.raises(ValueError):
        ranking.rank(df, "price")
    assert ranking.modes(df.sparkSession).count() == len(ranking.MODES)


def test_retrieval_is_prefix(spark):
    books = sample_books(spark, 60)
    assert [r["book_id"] for r in books.orderBy("book_id").limit(2).collect()] == [1, 2]
    six = [r["book_id"] for r in recommend.recommend(books, 1, 3, "final").collect()]
    twelve = [r["book_id"] for r in recommend.recommend(books, 1, 6, "final").collect()]
    assert twelve[:3] == six and len(twelve) == 6
    for r in recommend.candidates(books, 1).collect():
        assert -1.0001 <= r["combined_similarity"] <= 1.0001
    both = recommend.batch_topk(books, F.col("book_id") < 3, 5).filter("book_id = 1").orderBy("position").collect()
    assert [r["neighbour_id"] for r in both] == [r["book_id"] for r in recommend.top(recommend.candidates(books, 1).filter("overlap_coefficient > 0"), 5).collect()]


def test_penalty_is_checked():
    for beta in (-0.1, 0.5):
        with pytest.raises(ValueError):
            Scoring(beta=beta)
    assert Config({"recommender": {"beta": 0.1}}).scoring().beta == 0.1
    assert Config({"a": {"b": 1}}).get("a.c", 7) == 7
    with pytest.raises(FileNotFoundError):
        Config.load("/nowhere/config.json")


@pytest.mark.parametrize(
    "text,expected",
    [("2023-01-15", dt.date(2023, 1, 15)), ("2023/1/5", dt.date(2023, 1, 5)), ("2023年1月5日", dt.date(2023, 1, 5)), ("2023-07", dt.date(2023, 7, 1)), ("2023/07", dt.date(2023, 7, 1)), ("2023年7月", dt.date(2023, 7, 1)), ("2023", dt.date(2023, 1, 1)), ("junk", None), ("2023-13", None), ("2023-02-30", None), (None, None), ("", None)],
)
def test_dates(spark, text, expected):
    df = spark.createDataFrame([(text,)], "d string")
    assert one(df, parse_date(F.col("d"))) == expected


def test_lenient_lists(spark):
    texts = [None, "", "[1,2", '{"a":1}', "null", "[]", '["a","b"]', "['a']", '[1,"x"]']
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [len(r["x"]) for r in df.select(decode_list("t").alias("x")).collect()] == [0, 0, 0, 0, 0, 0, 2, 0, 2]


def test_text(spark):
    df = spark.createDataFrame([("《深度学习》 a-b_c  x!", None)], "t string, n string")
    assert one(df, normalise(F.col("t"))) == "深度学习 a b c x"
    assert one(df, normalise_lower(F.col("n"))) == ""
    assert one(df, tokens(F.col("t"))) == ["a", "b", "c", "x", "深度", "度学", "学习"]
    assert one(df, occurrences(F.lit("aaaa"), F.lit("aa"))) == 2
    assert one(df, clean_terms(F.array(*map(F.lit, ["ab", " ab ", "1", "22", "x", "cd"])))) == ["ab", "cd"]
    book = spark.createDataFrame([("T", "i", None, ["", "r1", "r2", "r3", "r4", "r5"], [], None)], "title string, book_intro string, author_intro string, short_reviews array<string>, reviews array<string>, reading_notes array<string>")
    assert one(book, keyword_text()) == "T T i r1 r2 r3 r4"


def test_fusion_golden(spark):
    ranked = lambda words: spark.createDataFrame([(1, w, 1.0, i + 1) for i, w in enumerate(words)], "id long, term string, score double, position int")
    fused = keywords.fuse(ranked(["aa", "bb", "cc"]), ranked(["bb", "dd"]), 10).orderBy("position").collect()
    assert [(r["term"], r["score"]) for r in fused] == [("aa", 6), ("bb", 6), ("cc", 2), ("dd", 1)]


def test_textrank_against_plain_loops():
    rng = random.Random(4)
    for _ in range(20):
        words = [rng.choice("abcdefghij") * 2 for _ in range(rng.randint(2, 60))]
        edges: dict[tuple[str, str], int] = {}
        for i, a in enumerate(words):
            for b in words[i + 1 : i + 5]:
                if a != b:
                    edges[a, b] = edges.get((a, b), 0) + 1
                    edges[b, a] = edges.get((b, a), 0) + 1
        score = dict.fromkeys(words, 1.0)
        for _ in range(30 if edges else 0):
            leaving = {w: sum(n for (x, _), n in edges.items() if x == w) for w in score}
            score = {w: 0.15 + 0.85 * sum(n * score[x] / leaving[x] for (x, y), n in edges.items() if y == w) for w in score}
        top = max(score.values())
        assert keywords.rank_graph(words) == pytest.approx({w: s / top for w, s in score.items()})


def test_textrank():
    scores = keywords.rank_graph(["ab", "cd", "ab", "ef", "ab"])
    assert max(scores, key=scores.get) == "ab" and keywords.rank_graph([]) == {}
    assert keywords.rank_graph(["ab", "ab"]) == {"ab": 1.0}


def test_tags(spark):
    lexicon = spark.createDataFrame([(0, "d1", 0, "aa"), (1, "d2", 0, "bb"), (2, "d3", 0, "cc"), (2, "d3", 1, "c")], "domain_idx int, domain string, kw_idx int, keyword string")
    books = spark.createDataFrame([(1, "aa aa", "bb bb bb", "cc"), (2, "zz", None, None), (3, "aaaa", "", None)], "book_id long, title string, book_intro string, author_intro string")
    found = {r["book_id"]: r["domain_tags"] for r in tags.tag_books(books, lexicon).collect()}
    assert found == {1: ["d2", "d3"], 2: ["其他"], 3: ["d1"]}
    with pytest.raises(ValueError):
        tags.tag_books(books.drop("title"), lexicon)


def test_catalog(spark):
    books = pair_table(spark)
    assert [r["book_id"] for r in catalog.page(books, 1, 3, "rating").collect()] == [2, 1, 5]
    assert catalog.count(books, "%", 2).first().asDict() == {"total": 5, "pages": 3}
    assert catalog.detail(books, 99).count() == 0
    assert catalog.statistics(books).first().asDict() == {"total_books": 5, "average_rating": 4.33, "total_domains": 3}
    assert catalog.statistics(books.limit(0)).first()["average_rating"] == 0
    with pytest.raises(ValueError):
        catalog.page(books, 0)
    assert catalog.page_window(5, 10) == [1, None, 3, 4, 5, 6, 7, None, 10]


def test_embeddings(spark):
    df = spark.createDataFrame([(1, "alpha beta alpha"), (2, ""), (3, None)], "doc_id long, text string")
    made = {r["doc_id"]: r["embedding"] for r in hashed_documents(df, "doc_id", F.col("text"), 32).collect()}
    assert math.isclose(sum(x * x for x in made[1]), 1.0) and sorted(made[1])[-2:] == pytest.approx([1 / 5**0.5, 2 / 5**0.5])
    assert sum(made[2]) == sum(made[3]) == 0
    factory = lambda: lambda texts: [[float(len(t)), 1.0] for t in texts]
    assert [r["embedding"] for r in encode_texts(df, "doc_id", F.col("text"), factory, 2).orderBy("doc_id").collect()] == [[16.0, 1.0], [0.0, 0.0], [0.0, 0.0]]


def test_files_and_tables(spark, tmp_path):
    books = sample_books(spark, 12)
    for kind in ("parquet", "orc", "json", "csv"):
        path = str(tmp_path / kind)
        for _ in range(2):
            write_books(books, kind, {"path": path})
        back = read_books(spark, kind, {"path": path})
        assert back.schema.fieldNames() == BOOKS.fieldNames() and back.count() == 12
        assert back.orderBy("book_id").first()["domain_tags"] == books.orderBy("book_id").first()["domain_tags"]
        assert [p.name for p in tmp_path.iterdir() if "staging" in p.name] == []
    with pytest.raises(ValueError):
        read_books(spark, "paper", {})
    change = spark.createDataFrame([(1, "new", ["t"]), (2, None, [])], "book_id long, title string, domain_tags array<string>")
    changed = {r["book_id"]: r for r in updated(books, change, ["title", "domain_tags"]).collect()}
    assert changed[1]["title"] == "new" and changed[1]["domain_tags"] == ["t"] and changed[2]["title"] == "Sample book 2" and changed[2]["domain_tags"]
    assert verify_load(books)["count"] == 12


def test_jdbc_round_trip(spark):
    options = {"url": "jdbc:derby:memory:quill;create=true", "driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver", "dbtable": "books"}
    books = sample_books(spark, 6).select("book_id", "title", "authors", "rating", "domain_tags")
    write_books(books, "jdbc", options)
    back = read_books(spark, "jdbc", options, partitions=2)
    assert [r["authors"] for r in back.orderBy("book_id").collect()] == [r["authors"] for r in books.orderBy("book_id").collect()]


def test_enrichment_is_repeatable(spark):
    books = sample_books(spark, 8).withColumn("book_intro", F.lit("ocean current and plate motion"))
    lexicon = spark.createDataFrame([(0, "sea", 0, "ocean")], "domain_idx int, domain string, kw_idx int, keyword string")
    first, second = (enrich(books, lexicon, document_size=16, keyword_size=8).orderBy("book_id").collect() for _ in range(2))
    assert first == second and all(r["domain_tags"] == ["sea"] for r in first)
    assert run_summary(spark.createDataFrame(first, BOOKS)).first()["with_embedding"] == 8


def test_streams(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    sample_books(spark, 5).write.parquet(source)
    lexicon = spark.createDataFrame([(0, "sample", 0, "sample")], "domain_idx int, domain string, kw_idx int, keyword string")
    for _ in range(2):
        tag_stream(read_new_books(spark, source), lexicon, target, str(tmp_path / "check")).awaitTermination(60)
    assert spark.read.parquet(target).filter("domain_tags[0] = 'sample'").count() == 5
    rows = spark.createDataFrame([(1, 9, dt.datetime(2025, 1, 1, 5)), (1, 9, dt.datetime(2025, 1, 1, 5)), (2, 9, dt.datetime(2025, 1, 2))], "rec_id long, target_book_id long, requested_at timestamp_ntz")
    assert sorted(r["n"] for r in requests_per_window(rows, "1 day").collect()) == [1, 1]


def test_tables(spark):
    create_table(spark, "quill_books")
    try:
        append(sample_books(spark, 3), "quill_books")
        assert spark.table("quill_books").count() == 3
    finally:
        spark.sql("drop table quill_books")


WORDS = {"机器": "n", "学习": "v", "机器学习": "n", "非常": "d", "有趣": "a"}


def test_segmenters():
    segment = Dictionary(WORDS)
    assert segment("机器学习非常有趣 Deep 2024 机x") == [("机器学习", "n"), ("非常", "d"), ("有趣", "a"), ("deep", "eng"), ("2024", "m"), ("机", "x"), ("x", "eng")]
    assert segment("") == segment(None) == []
    words = segment("机器学习非常有趣 Deep 2024 学习")
    assert kept_words(words, set(), KEYWORD_POS) == ["机器学习", "有趣", "deep", "学习"]
    assert kept_words(words, {"deep"}, ("n",)) == ["机器学习"]
    assert kept_words([("ab", None), ("cd", "vn"), ("ef", "vd")], set(), ("v", "vn"), whole=True) == ["ab", "cd"]
    assert list(pieces()("ab 机器学")) == [("ab", None), ("机器", None), ("器学", None)]


def test_keywords_by_part_of_speech(spark):
    df = spark.createDataFrame([(1, "机器学习非常有趣，机器学习 deep deep deep 2024"), (2, None), (3, "")], "book_id long, text string")
    dictionary = lambda: Dictionary(WORDS)
    stop = spark.createDataFrame([("Deep ",), (None,)], "word string")
    counted = {(r["id"], r["term"]): r["tf"] for r in keywords.terms(df, "book_id", F.col("text"), None, dictionary, digits=False).collect()}
    assert counted == {(1, "机器学习"): 2, (1, "有趣"): 1, (1, "deep"): 3}
    assert {r["term"] for r in keywords.terms(df, "book_id", F.col("text"), stop, dictionary, ("n",)).collect()} == {"机器学习", "2024"}
    found = {r["book_id"]: r["keywords"] for r in keywords.of_single_texts(df, "book_id", F.col("text"), 2, None, dictionary).collect()}
    # deep: 2 * 3 + its place in the graph; 机器学习 is next in both lists
    assert found[1] == ["deep", "机器学习"] and found[2] == found[3] == []
    books = spark.createDataFrame([(1, "机器学习", "学习 学习", None)], "book_id long, title string, book_intro string, author_intro string")
    assert keywords.of_single_books(books, 3, None, dictionary).first()["keywords"] == ["学习", "机器学习"]
    ranked = [r["term"] for r in keywords.textrank(df, "book_id", F.col("text"), 3, None, dictionary).orderBy("position").collect()]
    assert set(ranked) == {"机器学习", "有趣", "deep"}


def test_fused_lists_agree(spark):
    ranked = lambda words: spark.createDataFrame([(1, w, 1.0, i + 1) for i, w in enumerate(words)], "id long, term string, score double, position int")
    first, second = ["aa", "bb", "cc", "12"], ["bb", "dd", "ee"]
    assert [r["term"] for r in keywords.fuse(ranked(first), ranked(second), 4).orderBy("position").collect()] == keywords.fused(first, second, 4)


def test_side_inputs_are_checked(spark):
    assert len(side_rows(spark.range(5).toDF("x"), 5)) == 5
    with pytest.raises(ValueError):
        side_rows(spark.range(6).toDF("x"), 5)


def test_search_and_deep_pages(spark):
    books = canonical(spark.createDataFrame([(1, "a\\b", 3.0), (2, "ab", None), (3, None, 3.0), (4, "A\\B", 9.0)], "book_id long, title string, rating double"))
    assert [r["book_id"] for r in catalog.page(books, 1, 9, None, "\\b").collect()] == [1, 4]
    seen, last = [], None
    while rows := catalog.page_after(books, last, 1, "rating").collect():
        last = (rows[0]["rating"], rows[0]["book_id"])
        seen.append(rows[0]["book_id"])
    assert seen == [4, 1, 3, 2]
    assert [r["book_id"] for r in catalog.page_after(books, (2,), 9).collect()] == [3, 4]


def test_query_rounds_agree(spark):
    books = sample_books(spark, 60)
    asked = F.col("book_id") % 2 == 0
    whole, rounds = (sorted(map(tuple, recommend.batch_topk(books.repartition(3), asked, 3, block=4, round_bytes=n).collect())) for n in (1 << 30, 1))
    assert whole == rounds and len(whole) == 90
    assert recommend.batch_topk(books, F.col("book_id") < 0).count() == 0


def test_database_update(spark):
    options = {"url": "jdbc:derby:memory:quillup;create=true", "driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver", "dbtable": "books"}
    books = sample_books(spark, 4).select("book_id", "title", "rating", "keywords")
    write_books(books, "jdbc", options)
    changes = spark.createDataFrame([(1, ["new"], 1.5), (2, [], None), (9, ["x"], 2.0), (None, ["y"], 3.0)], "book_id long, keywords array<string>, rating double")
    assert update_database(changes, ["keywords", "rating"], options) == 2
    before, after = ({r["book_id"]: r for r in df.collect()} for df in (books, read_books(spark, "jdbc", options)))
    assert set(after) == {1, 2, 3, 4} and after[1]["keywords"] == ["new"] and after[1]["rating"] == 1.5
    assert all(after[i]["keywords"] == before[i]["keywords"] and after[i]["rating"] == before[i]["rating"] for i in (2, 3, 4))
    left = spark.read.format("jdbc").options(**(options | {"dbtable": "(select tablename from sys.systables where tabletype = 'T') x"})).load()
    assert [r[0].lower() for r in left.collect()] == ["books"]
    for url, form in (("jdbc:mysql://h/d", "JOIN"), ("jdbc:postgresql://h/d", " FROM ")):
        assert form in update_statement("books", "s1", ["rating"], url)


def test_release(spark, tmp_path):
    kept = storage.cut(spark.range(3).toDF("x"), "some")
    assert kept.count() == 3 and storage.release(spark) and not storage.release(spark)
    assert storage.cut(spark.range(3).toDF("x"), "some").count() == 3
