import glob
import os
import random
from itertools import combinations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstone.llm import abuse, distinctive, encode, mixing, names, neardup, queries, ranking, setjoin, subjects, vectors


def pairs_of(df, a="a", b="b"):
    return {(r[a], r[b]) for r in df.collect()}


# set join


def sets_found(df, least=1):
    pairs, members = setjoin.similar_sets(df, "book_id", "keywords", "domain_tags", least)
    return pairs_of(setjoin.expanded(pairs, members))


def test_set_join_against_brute_force(books):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    base = [rng.sample(words, rng.randint(4, 9)) for _ in range(60)]
    sets = base + [[*b[1:], rng.choice(words)] for b in base] + [base[0]] * 20
    rows = [{"book_id": i, "keywords": s, "domain_tags": ["T"]} for i, s in enumerate(sets)]
    want = set()
    for (i, a), (j, b) in combinations(enumerate(sets), 2):
        x, y = {*a, "t"}, {*b, "t"}
        if len(x & y) / len(x | y) >= 0.6:
            want.add((i, j))
    assert sets_found(books(rows)) == want


def test_set_join_cases(books):
    rows = [
        {"book_id": 1, "keywords": [" A ", "b", None, "", "ｃ"], "key": "clash", "record": 9},
        {"book_id": 2, "keywords": ["a", "B", "c", "c"]},
        {"book_id": 2, "keywords": ["a", "B", "c", "c"]},
        {"book_id": 3, "keywords": ["a", "b"]},
        {"book_id": 4},
        {"book_id": 5, "keywords": []},
        {"book_id": None, "keywords": ["a", "b", "c"]},
        {"book_id": 6, "keywords": ["x" * 100_000, "y", "z"]},
    ]
    assert sets_found(books(rows), 3) == {(1, 2)}
    assert sets_found(books([]), 3) == set()


# near duplicates


def near_found(df):
    pairs, members = neardup.near_duplicates(df, "book_id", "books_intro", ["title", "books_intro", "author_intro"])
    return pairs_of(setjoin.expanded(pairs, members))


def test_near_duplicates_against_brute_force(books):
    rng = random.Random(3)
    text = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    base = [text(rng.randint(20, 60)) for _ in range(25)]
    texts = base + [b[:40] + text(rng.randint(1, 6)) + b[50:] for b in base] + [base[0]] * 5
    rows = [{"book_id": i, "title": "T", "books_intro": t} for i, t in enumerate(texts)]
    grams = [{c[i : i + 4] for i in range(len(c) - 3)} for c in (neardup.clean("T" + t) for t in texts)]
    want = {(i, j) for i, j in combinations(range(len(texts)), 2) if len(grams[i] & grams[j]) / len(grams[i] | grams[j]) >= 0.6}
    assert near_found(books(rows)) == want and len(want) > 25


def test_near_duplicate_cases(books):
    long = "many words about nothing much " * 2_000
    rows = [
        {"book_id": 1, "books_intro": "x" * 79},
        {"book_id": 2, "books_intro": " "},
        {"book_id": 3, "title": long},
        {"book_id": 4, "books_intro": long, "record": 1},
        {"book_id": 5, "books_intro": long.upper(), "title": None},
        {"book_id": 5, "books_intro": long.upper(), "title": None},
        {"book_id": 6, "books_intro": ""},
    ]
    assert near_found(books(rows)) == {(4, 5)}
    assert near_found(books([])) == set()


def test_near_duplicates_derived_from_leaders(books, monkeypatch):
    rng = random.Random(5)
    text = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    base = [text(80) for _ in range(6)]
    base += [b[:300] + text(9) for b in base]
    texts = [b[:k] + "z" + b[k + 1 :] for b in base for k in (50, 150, 250, 420)] + [b + text(n) for b in base for n in (1, 2)] + base
    rows = [{"book_id": 7 * i + 3, "title": "T", "books_intro": t} for i, t in enumerate(texts)]
    grams = {r["book_id"]: {c[i : i + 4] for i in range(len(c) - 3)} for r in rows for c in [neardup.clean("T" + r["books_intro"])]}
    want = {(i, j) for i, j in combinations(sorted(grams), 2) if len(grams[i] & grams[j]) / len(grams[i] | grams[j]) >= 0.6}
    whole = near_found(books(rows))
    assert whole == want and len(want) > 200
    led = neardup.led(neardup.cleaned(books(rows), "book_id", "books_intro", ["title", "books_intro"], 80)).collect()
    assert sum(r["record"] != r["lead"] for r in led) > 10 and len(led) == len(rows)
    # a signature, an n-gram and a list of many records, in parts
    for name, value in (("LED", 2), ("BLOCK", 8), ("LIST_BLOCK", 4)):
        monkeypatch.setattr(neardup, name, value)
    assert near_found(books(rows)) == want
    pairs, members = neardup.near_duplicates(books([*rows, {"book_id": 1, "title": "T", "books_intro": texts[0]}, {"book_id": 2, "books_intro": text(40)}]), "book_id", "books_intro", ["title", "books_intro"])
    linked = want | {(1, 3)} | {(1, b) for a, b in want if a == 3} | {(1, a) for a, b in want if b == 3}
    root = {i: i for i in [*grams, 1, 2]}
    for _ in root:
        for a, b in linked:
            root[a] = root[b] = min(root[a], root[b])
    got = {r["record"]: (r["group"], r["links"]) for r in neardup.near_groups(pairs, members).collect()}
    assert got == {i: (root[i], sum(i in p for p in linked)) for i in root}


def test_postings_of_split_ngrams_stay_in_bounds(books, monkeypatch):
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(40)]
    texts = [rng.sample(words, 24) for _ in range(150)]
    texts = [" ".join(x) for x in [*texts, *([*t[:21], "z"] for t in texts[:60])]]
    rows = [{"book_id": i, "title": "T", "books_intro": t} for i, t in enumerate(texts)]
    grams = [{c[i : i + 4] for i in range(len(c) - 3)} for c in (neardup.clean("T" + t) for t in texts)]
    want = {(i, j) for i, j in combinations(range(len(texts)), 2) if len(grams[i] & grams[j]) / len(grams[i] | grams[j]) >= 0.6}
    sent, whole = [], neardup.over_slices

    def over_slices(df, partitions, each, schema):
        if schema.startswith("a long"):
            sent.append([(r["slice"], len(neardup.unpack(bytes(r["blob"]))[5]), len(r["blob"])) for r in df.collect()])
        return whole(df, partitions, each, schema)

    # nearly every n-gram is in more records than a block has
    monkeypatch.setattr(neardup, "over_slices", over_slices)
    for name, value in (("BLOCK", 8), ("SLICE_POSTINGS", 4_000)):
        monkeypatch.setattr(neardup, name, value)
    for rounds in (False, True):
        if rounds:
            for name, value in (("ROUND_BYTES", 500), ("ANY_ROUND", 0)):
                monkeypatch.setattr(neardup, name, value)
        sent.clear()
        assert near_found(books(rows)) == want and len(want) >= 60
        held = [{x: sum(n for y, n, _ in got if y == x) for x, *_ in got} for got in sent]
        assert max(max(x.values()) for x in held) < 2 * 4_000
        assert (len(sent) > 1) == rounds
        if rounds:
            assert max(sum(n for *_, n in got) for got in sent) < 2 * 500 * len(texts)


def test_slice_candidates_lose_nothing():
    rng = np.random.default_rng(2)
    base = [np.unique(rng.integers(0, 4_000, 150)) for _ in range(30)]
    sets = [np.unique(np.r_[b[k:], rng.integers(0, 4_000, 2 * k)]).astype(np.uint64) for b in base for k in (0, 3, 9, 20)]
    sizes, radius = np.array([len(x) for x in sets]), np.array([0.05 if i % 9 == 0 else 0.0 for i in range(len(sets))])
    bounds = neardup.Bounds(0.6)
    codes = neardup.one_bit_minhashes(np.concatenate(sets), np.r_[0, np.cumsum(sizes)[:-1]], neardup.CODE_BITS)
    prefix = bounds.prefix(sizes, radius)
    entries = [(int(t), i, len(x) - at) for i, x in enumerate(sets) for at, t in enumerate(x.tolist()) if at < prefix[i]]
    i, j, _ = neardup.slice_candidates(tuple(np.array(c) for c in zip(*entries, strict=True)), sizes, radius, codes, bounds)
    found = {(min(p), max(p)) for p in zip(i.tolist(), j.tolist(), strict=True)}
    for a, b in combinations(range(len(sets)), 2):
        both = neardup.overlap(sets[a], sets[b])
        if both / (sizes[a] + sizes[b] - both) >= 0.6 - radius[a] - radius[b]:
            assert (a, b) in found


# names


def test_trie_enumerates_one_edit():
    rng = random.Random(2)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(5, 7))) for _ in range(120)})

    def osa(a, b):
        d = [[max(i, j) if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
        return d[-1][-1]

    trie = names.Trie(words)
    for w in words[:40]:
        want = {o for o in words if osa(w, o) <= 1}
        assert set(trie.within(w)) == want
        assert all(set(names.shard_keys(w)) & set(names.shard_keys(o)) for o in want)


def test_large_shards_are_sharded_again(spark):
    rng = random.Random(4)
    keys = sorted({"andrew" + "".join(rng.choice("ab") for _ in range(rng.randint(4, 6))) for _ in range(90)})
    df = spark.createDataFrame([(k, "la") for k in keys], "key string, script string")
    found = [{(r["a"], r["b"], r["x"], r["y"]) for r in names.neighbours(df, most).collect()} for most in (2_000, 3)]
    assert found[0] == found[1] and len(found[0]) > 50


def test_errors_are_followed_to_the_end(books):
    chain = ["Zora Trufloresk", "Zora Trufloreskk", "Zora Trufloreskkk", "Zora Trufloreskkkk", "Zora Trufloreskkkkk", "Zora Trufloreskkkkkk"]
    rows = [{"book_id": 10 * i + j, "authors": [n]} for i, n in enumerate(chain) for j in range(8 - i)]
    classes = {r["name"]: r["class_name"] for r in names.variant_classes(books(rows), "authors").collect()}
    assert set(classes) == set(chain) and set(classes.values()) == {chain[0]}


def test_name_variants(books):
    groups = [
        ["Anthony Numofovik", "Numofovik, Anthony", "Dr. Anthony  Numofovik", "Tony Numofovik", "A. Numofovik", "Anthony J. Numofovik (ed.)", "AnthonyNumofovik", "Anthony Numofovk"],
        ["Badrugerd Reading Association", "BADRUGERD READING ASSOCIATION", "Badrugerd Read. Asso.", "Reading Association, Badrugerd"],
        ["伊尔莎·内格法基", "内格法基，伊尔莎", "(意)伊尔莎·内格法基", "伊尔莎　内格法基", "伊尔莎内格法基"],
        ["Beth Gidadalt", "Elizabeth Gidadalt"],
        ["Anthony Gidadalt"],
    ]
    rows = [{"book_id": i, "authors": [n, None, " "], "key": "clash"} for i, n in enumerate(n for g in groups for n in g)]
    rows += [{"book_id": 90}, {"book_id": 91, "authors": []}, {"book_id": 92, "authors": ["()", "Dr."]}] + [{"book_id": 93, "authors": ["Elizabeth Gidadalt"]}] * 30
    want = {tuple(sorted(p)) for g in groups for p in combinations(g, 2)}
    assert pairs_of(names.variant_pairs(books(rows), "authors")) == want
    assert names.variant_pairs(books([]), "authors").count() == 0


def test_name_token_order(books):
    groups = [
        ["Alexandra Jastaroth", "JASTAROTH Alexandra", "Jastaroth Alexandra", "Jastaroth, A."],
        ["Zora Trufloresk", "Trufloresk Z", "Trufloresk Z.N."],
        ["Alexandra Trufloresk"],
        ["Robert Lohaplesk"],
        ["William Lohaplesk", "Lohaplesk W"],
        ["Lohaplesk H"],
        ["伊尔莎·内格法基", "内格法基 伊尔莎"],
        ["伊尔莎·多勒", "多勒，伊尔莎"],
    ]
    rows = [{"book_id": i, "authors": [n]} for i, n in enumerate(n for g in groups for n in g)]
    want = {tuple(sorted(p)) for g in groups for p in combinations(g, 2)}
    assert pairs_of(names.variant_pairs(books(rows), "authors")) == want
    both = ["James Thomas", "Thomas James", "James Brook", "Thomas Brook", "Zora James", "Zora Thomas"]
    rows = [{"book_id": i, "authors": [n]} for i, n in enumerate(both)]
    assert names.variant_pairs(books(rows), "authors").count() == 0
    rows = [{"book_id": i, "authors": [n]} for i, n in enumerate(["Foo Barley", "BARLEY Foo"])]
    assert pairs_of(names.variant_pairs(books(rows), "authors")) == {("BARLEY Foo", "Foo Barley")}


# distinctive terms


def terms_of(df, part_terms=100_000):
    return distinctive.term_occurrences(df, "book_id", "keywords", "books_intro", "reviews", part_terms)


def test_distinctive_terms(books):
    rows = [{"book_id": i, "keywords": ["Common", f"rare {i // 2}"], "books_intro": f"common rare {i // 2}, RARE {i // 2}", "reviews": [None, "", f"rare {i // 2} common"], "key": "clash"} for i in range(20)]
    rows += [{"book_id": 50}, {"book_id": 51, "keywords": [" ", None]}, dict(rows[0]), {"book_id": 52, "keywords": ["lone"], "books_intro": "lone " * 50_000}]
    scored = distinctive.parsimonious(terms_of(books(rows)))
    found = {(r["record"], r["term"]) for r in distinctive.distinctive_found(scored).collect()}
    assert found == {(i, f"rare {i // 2}") for i in range(20)}
    top = {r["record"]: r["term"] for r in distinctive.distinctive_terms(scored, 1).collect()}
    assert all(top[i] == f"rare {i // 2}" for i in range(20)) and top[52] == "lone" and 50 not in top
    # the term of all records is the background's
    common = distinctive.parsimonious(terms_of(books(rows[:20]))).filter("term = 'common'")
    assert common.filter("weight > 0").count() == 0 and common.count() == 20
    assert distinctive.parsimonious(terms_of(books([]))).count() == 0


def test_background_counts_books_that_do_not_list_a_term(books, spark, tmp_path):
    rows = [{"book_id": i, "keywords": ["compiler", "zither"], "books_intro": "compiler zither"} for i in range(2)]
    rows += [{"book_id": 10 + i, "books_intro": "a Compiler", "reviews": ["compilercompiler", None]} for i in range(40)] + [{"book_id": 10, "books_intro": "a Compiler"}]
    rows += [{"book_id": 60, "keywords": ["aa", "none"], "books_intro": "aaaaa"}, {"book_id": None, "books_intro": "zither"}]
    books(rows).write.parquet(f"{tmp_path}/books.parquet")
    for part_terms in (100, 1):
        counted = terms_of(books(rows), part_terms).groupBy("record", "term").agg(F.max("tf").alias("tf")).groupBy("term").agg(F.sum("tf").alias("tf"))
        assert {r["term"]: r["tf"] for r in counted.collect()} == {"compiler": 122, "zither": 2, "aa": 2, "none": 0}
    top = {(r["book_id"], r["rank"]): r["term"] for r in queries.p5_top_terms(spark, str(tmp_path)).collect()}
    assert top[0, 1] == top[1, 1] == "zither"


def test_weights_do_not_depend_on_partitions(books):
    rng = random.Random(12)
    words = [f"w{i:02}" for i in range(40)]
    some = lambda n: [words[min(39, int(rng.expovariate(0.1)))] for _ in range(n)]
    terms = terms_of(books([{"book_id": i, "keywords": some(4), "books_intro": " ".join(some(30))} for i in range(120)])).collect()
    schema = "record long, term string, tf long, listed boolean"
    spark = books([]).sparkSession
    found = []
    for n in (1, 7):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        scored = distinctive.parsimonious(spark.createDataFrame(terms, schema).repartition(n))
        found.append(sorted((r["record"], r["term"], r["weight"]) for r in scored.repartition(n).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert found[0] == found[1] and any(w == 0 for *_, w in found[0])


def test_em_against_its_fixed_point():
    rng = np.random.default_rng(3)
    for _ in range(30):
        tf, q = rng.integers(1, 9, 12).astype(float), rng.dirichlet(np.ones(12)) * 0.05
        p = distinctive.em(np.zeros(12, int), 1, tf, q, 0.1, 5_000, 0.0)
        # at the fixed point a term's mass is its share of what is left less its background, or nothing
        order = np.argsort(-tf / q)
        for m in range(12, 0, -1):
            kept = order[:m]
            c = tf[kept].sum() / (1 + 9 * q[kept].sum())
            want = tf / c - 9 * q
            if (want[kept] > 0).all():
                break
        want[[i for i in range(12) if i not in kept]] = 0
        assert p == pytest.approx(np.maximum(want, 0), abs=1e-4)


# vectors


def test_vectors_recall_and_cases(books):
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((12, 16))
    data = [(centres[i % 12] + 0.2 * rng.standard_normal(16)).tolist() for i in range(600)]
    data[7] = [2 * x for x in data[3]]
    rows = [{"book_id": i, "embedding": v, "record": 0} for i, v in enumerate(data)] + [{"book_id": 600 + i, "embedding": data[0]} for i in range(9)]
    bad = [None, [], [0.0] * 16, [1.0] * 15, [float("nan")] + [1.0] * 15, [None] + [1.0] * 15]
    rows += [{"book_id": 900 + i, "embedding": v} for i, v in enumerate(bad)] + [dict(rows[5])]
    for leaf_rows, least in ((10_000, 0.9999), (80, 0.9)):
        found = {}
        for r in vectors.nearest(books(rows), "book_id", "embedding", 16, 5, leaf_rows=leaf_rows).collect():
            found.setdefault(r["record"], set()).add(r["neighbour"])
        ids = np.array(list(range(609)))
        unit = np.array([*data, *[data[0]] * 9], dtype=np.float32).astype(float)
        unit /= np.sqrt((unit * unit).sum(axis=1, keepdims=True))
        hits = 0
        for i in ids:
            s = np.round(unit @ unit[i], 9)
            s[i] = -9
            hits += len(set(np.lexsort((ids, -s))[:5].tolist()) & found[int(i)])
        assert set(found) == set(ids.tolist()) and all(len(v) == 5 for v in found.values())
        assert hits / (5 * len(ids)) >= least
    few = vectors.nearest(books(rows[:2]), "book_id", "embedding", 16).collect()
    assert {(r["record"], r["neighbour"]) for r in few} == {(0, 1), (1, 0)}
    assert vectors.nearest(books([]), "book_id", "embedding", 16).count() == 0


def test_vectors_in_chunks_and_for_a_query_set(books):
    rng = np.random.default_rng(6)
    data = rng.standard_normal((500, 16))
    rows = [{"book_id": i, "embedding": v} for i, v in enumerate(data.tolist())]
    unit = data.astype(np.float32).astype(float)
    unit /= np.sqrt((unit * unit).sum(axis=1, keepdims=True))
    want = {}
    for i in range(500):
        s = np.round(unit @ unit[i], 9)
        s[i] = -9
        want[i] = np.lexsort((np.arange(500), -s))[:5].tolist()
    # a tree of two leaves, each far over its size: searched in chunks
    options = {"leaf_rows": 40, "most_sampled": 32, "miss": 1e-9}
    for queries, asked in ((None, range(500)), (F.col("book_id") % 100 == 0, range(0, 500, 100))):
        found = {}
        for r in vectors.nearest(books(rows), "book_id", "embedding", 16, queries=queries, **options).collect():
            found.setdefault(r["record"], []).append((-round(r["similarity"], 9), r["neighbour"]))
        assert {i: [n for _, n in sorted(x)] for i, x in found.items()} == {i: want[i] for i in asked}


def test_vectors_are_not_sent_to_every_leaf_they_ask(books, monkeypatch):
    rng = np.random.default_rng(10)
    data = rng.standard_normal((600, 16))
    rows = [{"book_id": i, "embedding": v} for i, v in enumerate(data.tolist())]
    unit = data.astype(np.float32).astype(float)
    unit /= np.sqrt((unit * unit).sum(axis=1, keepdims=True))
    want = set()
    for i in range(600):
        s = np.round(unit @ unit[i], 9)
        s[i] = -9
        want |= {(i, n) for n in np.lexsort((np.arange(600), -s))[:5].tolist()}
    sent, whole = [], vectors.over_slices

    def over_slices(df, *rest):
        sent.append(df.selectExpr("sum(length(blob))").first()[0])
        return whole(df, *rest)

    # 32 leaves, of which each vector asks nearly all
    monkeypatch.setattr(vectors, "over_slices", over_slices)
    for size in (None, 20_000):
        if size:
            monkeypatch.setattr(vectors, "ROUND_BYTES", size)
        sent.clear()
        found = vectors.nearest(books(rows), "book_id", "embedding", 16, depth=5, miss=1e-9).collect()
        assert {(r["record"], r["neighbour"]) for r in found} == want and len(found) == len(want)
        assert sum(sent) < 5 * 600 * 16 * 4


def test_vectors_of_one_record(books):
    rng = np.random.default_rng(8)
    rows = [{"book_id": 7, "embedding": v} for v in rng.standard_normal((90, 16)).tolist()]
    # repeated rows of one id with different vectors: all are its own, so it has no other neighbour
    assert vectors.nearest(books(rows), "book_id", "embedding", 16, leaf_rows=20, most_sampled=1 << 20).count() == 0


def test_probes_leave_less_than_miss_unseen():
    rng = np.random.default_rng(7)
    points = rng.standard_normal((4_000, 9))
    tree = vectors.Tree(points, 9)
    query, leaf = tree.probes(points[:50], np.full(50, 0.5), 0.04)
    near = points[:50, None] + 0.5 * rng.standard_normal((50, 400, 9))
    seen = {(q, x) for q, x in zip(query.tolist(), leaf.tolist(), strict=True)}
    inside = [(q, x) in seen for q in range(50) for x in tree.leaves(near[q]).tolist()]
    assert np.mean(inside) > 0.96 and len(query) < 50 * 512


def test_keyword_vectors(spark, tmp_path):
    rng = np.random.default_rng(8)
    centres = rng.standard_normal((9, 64))
    lists = [[(centres[(i + j) % 9] + 0.3 * rng.standard_normal(64)).tolist() for j in range(i % 4)] for i in range(60)]
    lists[5] = [lists[6][0], None, [0.0] * 64, [1.0] * 63, [float("nan")] * 64, lists[7][1]]
    rows = [(i * 1_000_003 - 7, v) for i, v in enumerate(lists)] + [(9, None), (10, []), (None, lists[7])]
    spark.createDataFrame(rows, "book_id long, keywords_embeddings array<array<double>>").write.parquet(f"{tmp_path}/books.parquet")
    found = {}
    for r in queries.QUERIES["p6_keywords"](spark, str(tmp_path)).collect():
        found.setdefault((r["book_id"], r["position"]), []).append((-r["similarity"], r["neighbour_id"], r["neighbour_position"]))
    usable = {(b, j): np.float32(v).astype(float) for b, vs in rows[:60] for j, v in enumerate(vs) if b != rows[5][0] or j in (0, 5)}
    unit = {x: v / np.sqrt(v @ v) for x, v in usable.items()}
    assert set(found) == set(usable)
    for x, v in unit.items():
        want = sorted((-round(float(v @ w), 9), *y) for y, w in unit.items() if y != x)[:5]
        assert [y[1:] for y in sorted(found[x])] == [y[1:] for y in want]
    with pytest.raises(Exception, match="too large"):
        vectors.nearest_listed(spark.createDataFrame([(1 << 50, [[1.0]])], "b long, v array<array<double>>"), "b", "v", 1).collect()


# encoding


@pytest.fixture
def docs(spark):
    return lambda rows: spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, source string, key string")


def test_encoding_round_trip(docs):
    texts = {1: None, 2: "", 3: " ", 4: "<|endoftext|> hi", 5: "héllo 你好 🎉 " * 30_000, 6: "a" * 70_000, 7: "don't\n\n  stop"}
    rank_file = encode.default_rank_file()
    got = {r["doc_id"]: r["ids"] for r in encode.encode(docs([(i, t, None) for i, t in texts.items()])).collect()}
    assert got[1] == got[2] == [] and all(encode.decode_ids(got[i], rank_file) == (t or "") for i, t in texts.items())
    whole = encode.encoding(rank_file).encode_ordinary(texts[5])
    assert got[5] == whole == encode.encode_text(texts[5], rank_file, 100)
    assert encode.encode(docs([])).count() == 0


# mixing


def test_mixing_follows_targets(docs, spark):
    rows = [(i, "short words here " * (1 + i % 5), ["a", "B ", "c-c", None, "other"][i % 5]) for i in range(500)] + [(900, None, "a"), (901, "", "a"), (0, "short words here ", "a")]
    targets = spark.createDataFrame([("a", 0.5, 2), ("b", 0.3, 1), ("c_c", 0.1, 4), ("gone", 0.1, 3)], "source string, target_share double, max_repeats int")
    mixed, reached = mixing.mix(docs(rows), targets)
    shares = {r["source"]: r for r in reached.collect()}
    assert shares["gone"]["share"] == 0
    for s, want in (("a", 5 / 9), ("b", 3 / 9), ("c_c", 1 / 9)):
        assert shares[s]["share"] == pytest.approx(want, abs=0.03)
    most = {r["source"]: r["m"] for r in mixed.groupBy("source").agg(F.max("copies").alias("m")).collect()}
    assert most["a"] <= 2 and most["b"] <= 1 and most["c_c"] <= 4 and most["other"] == 0
    assert mixed.count() == 502 and mixed.filter("doc_id >= 900 and copies > 0").count() == 0
    empty, none = mixing.mix(docs([]), targets)
    assert empty.count() == 0 and none.count() == 4
    assert mixing.mix(docs(rows), targets.limit(0))[0].filter("copies > 0").count() == 0


# ranking


def test_leximin_against_plain_code(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice(["hot", "hot", "x", None]), rng.choice([None, float("nan"), rng.random(), 0.5]), rng.choice([None, rng.randint(1, 5) * 1000.0])) for i in range(120)]
    df = spark.createDataFrame([*rows, rows[3], rows[3]], "item long, g string, a double, b double")
    got = {r["item"]: (r["g"], r["rank"], r["vector"]) for r in ranking.leximin(df, "g", "item", ["a", "b"]).collect()}
    want = {}
    for g in {r[1] for r in rows}:
        own = [r for r in rows if r[1] == g]
        known = [sorted(v for r in own if (v := r[c]) is not None and v == v) for c in (2, 3)]

        def share(v, c, known=known):
            k = known[c - 2]
            return 0.5 if v is None or v != v else round((sum(x < v for x in k) + k.count(v) / 2) / len(k), 9)

        vector = {r[0]: sorted(share(r[c], c) for c in (2, 3)) for r in own}
        for rank, i in enumerate(sorted(vector, key=lambda i: ([-x for x in vector[i]], i)), 1):
            want[i] = (g, rank, vector[i])
    assert {i: v[:2] for i, v in got.items()} == {i: v[:2] for i, v in want.items()}
    assert all(got[i][2] == pytest.approx(want[i][2]) for i in want)
    assert ranking.leximin(df.limit(0), "g", "item", ["a", "b"]).count() == 0


def test_leximin_with_a_common_value(spark):
    rng = random.Random(8)
    rows = [(i, "hot" if i % 3 else "x", 5.0 if rng.random() < 0.9 else rng.random() * 10, None if rng.random() < 0.7 else float(rng.randint(1, 4)), "clash") for i in range(900)]
    df = spark.createDataFrame(rows, "item long, g string, a double, b double, value string")
    found = [{tuple(r) for r in ranking.leximin(df, "g", "item", ["a", "b"], common).select("item", "rank", F.array_join("percentiles", " ")).collect()} for common in (10_000, 20)]
    assert found[0] == found[1] and len(found[0]) == 900
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    plan = ranking.leximin(df, "g", "item", ["a", "b"], 20)._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.adaptive.enabled")
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # shuffled joins hash the salt as well
    assert all("__s" in line for line in plan.splitlines() if "hashpartitioning" in line and "__" in line and "__z" not in line)


# subjects


def test_subjects(books, spark):
    sea, law = ["ocean current", "plate motion", "coral reef"], ["civil claim", "bail hearing", "court order"]
    rows, labels = [], []
    for i in range(120):
        own, other = (sea, law) if i % 2 else (law, sea)
        a, b = own[i % 3], own[(i + 1) % 3]
        intro = f"The book follows the {a}. It explains the {b} well. One joke about a {other[i % 3]} aside, all is plain."
        rows.append({"book_id": i, "title": "Notes", "books_intro": intro, "keywords": [a, b], "key": "clash"})
        if i < 60:
            labels.append((i, "science" if i % 2 else "law"))
    rows += [{"book_id": 500}, {"book_id": 501, "title": " ", "books_intro": ""}, {"book_id": 502, "title": "On the Coral Reef"}, dict(rows[0])]
    lexicon = spark.createDataFrame([("science", "ocean current"), ("science", "coral reef"), ("law", "civil claim"), ("law", "bail hearing")], "subject string, keyword string")
    given = spark.createDataFrame(labels, "book_id long, subject string")
    scored = subjects.subject_scores(books(rows), given, lexicon)
    found = {(r["record"], r["subject"]) for r in scored.filter("score >= 0.5").collect()}
    assert found == {(i, "science" if i % 2 else "law") for i in range(120)} | {(502, "science")}
    # a vocabulary too large to travel whole is that of the labelled records
    few = subjects.subject_scores(books(rows), given, lexicon, most_terms=1)
    assert {(r["record"], r["subject"]) for r in few.filter("score >= 0.5").collect()} == found
    assert subjects.subject_scores(books([]), given, lexicon).count() == 0
    assert subjects.subject_scores(books(rows), given.limit(0), lexicon).filter("score >= 0.5").count() >= 40


def test_subjects_are_the_same_at_every_size(books, spark):
    rng = random.Random(12)
    subject_words = {"science": ["ocean current", "plate motion", "coral reef", "reef", "潮汐", "潮汐能"], "law": ["civil claim", "bail hearing", "court order", "court", "保释", "保释金"]}
    rows, labels = [], []
    for i in range(160):
        s = "science" if i % 2 else "law"
        own, other = subject_words[s], subject_words["law" if s == "science" else "science"]
        # what only unlabelled books list must still be found
        listed = own[:3] if i < 60 else own
        intro = f"It follows the {rng.choice(own)}. On {rng.choice(own)}s and courtship, {rng.choice(own)}. 书中讲{rng.choice(own)}发电。 A joke on {rng.choice(other)} aside."
        rows.append({"book_id": i, "title": f"Of {rng.choice(own)}", "books_intro": intro, "keywords": listed})
        if i < 60:
            labels.append((i, s))
    rows += [dict(rows[0]), {**rows[1], "books_intro": "Another coral reef. One more coral reef."}]
    lexicon = spark.createDataFrame([("science", "ocean current"), ("law", "civil claim")], "subject string, keyword string")
    given = spark.createDataFrame(labels, "book_id long, subject string")
    held = lambda labels=given, **sizes: sorted(
        (r["record"], r["subject"], r["in_title"], r["sentences"], round(r["confidence"], 9), round(r["score"], 9))
        for r in subjects.subject_scores(books(rows), labels, lexicon, **sizes).collect()
    )
    want = held()
    assert len(want) > 150
    assert held(most_terms=1) == want
    # labels of other books, and many of them
    assert held(given.unionByName(spark.range(10**6, 10**6 + 400_000).selectExpr("id as book_id", "'law' as subject"))) == want
    # a vocabulary of several parts
    assert held(most_terms=1, part_terms=3) == want


# abuse


def test_abuse_threshold_follows_the_share():
    rng = np.random.default_rng(3)
    truth = np.r_[np.ones(300, bool), np.zeros(2_000, bool)]
    held = np.where(truth, rng.normal(1.5, 1, 2_300), rng.normal(-1.5, 1, 2_300))
    corpus = np.r_[rng.normal(1.5, 1, 400), rng.normal(-1.5, 1, 19_600)]
    assert abuse.estimated_share(held, truth, float((corpus > 0).mean())) == pytest.approx(0.02, abs=0.012)
    rare, frequent = (abuse.best_threshold(held, truth, share) for share in (0.005, 0.3))
    assert rare > frequent >= 0
    assert abuse.best_threshold(-np.abs(held), truth, 0.1) == 0 and abuse.best_threshold(np.full(4, -np.inf), truth[:4], 0.1) == 0


def test_abuse_held_out(docs, spark):
    rng = random.Random(6)
    places = ["Arlen", "Brook", "Corwen", "Dunmore", "Elster", "Farrow"]
    plain = ["The binding cracked in week {}.", "Order {} came from {} late.", "Maps from {} make it clear.", "A glossary covers page {} of {}."]
    bad = ["You {} fool should drown in {}!", "Only a {} moron from {} likes this!", "People from {} are vermin, all {} of them!"]
    quoted = "The study asks who says that people from {} are vermin and why."
    say = lambda t: t.format(*[rng.choice([rng.choice(places), str(rng.randint(1, 99))]) for _ in range(t.count("{}"))])
    rows, truth = [], {}
    for i in range(500):
        toxic = i % 4 == 0
        text = [say(rng.choice(plain)) for _ in range(3)] + ([say(rng.choice(bad))] if toxic else [quoted.format(rng.choice(places))] if i % 4 == 1 else [])
        rng.shuffle(text)
        rows.append((i, " ".join(text), "s"))
        truth[i] = toxic
    rows += [(900, None, None), (901, "", "s"), (902, "  ", "s"), (903, "Maps from Arlen make it clear. " * 3_000 + "Only a m​oron from Brook likes this!", "s")]
    labels = spark.createDataFrame([(i, "x", "abusive" if truth[i] else "clean") for i in range(300)] + [(0, "y", None), (7, "y", "abusive")], "doc_id long, annotator string, label string")
    got = {r["doc_id"]: r for r in abuse.toxicity(docs(rows), labels).collect()}
    new = range(300, 500)
    hit = sum(got[i]["toxic"] and truth[i] for i in new)
    assert hit / sum(truth[i] for i in new) > 0.9 and hit / max(1, sum(got[i]["toxic"] for i in new)) > 0.9
    assert all(got[i]["score"] is None and not got[i]["toxic"] for i in (900, 901, 902)) and got[903]["toxic"]
    assert abuse.toxicity(docs([]), labels).count() == 0
    assert abuse.toxicity(docs(rows), labels.limit(0)).filter("toxic").count() == 0


def test_set_join_plan_stays_small():
    plans = {n: setjoin.Plan(n, 0.6) for n in (500, 54_000, 1_000_000, 25_700_000, 100_000_000)}
    size = {n: p.record_bytes for n, p in plans.items()}
    print(size)
    # about the power 0.3 of the records: 480 times as many take less than seven times the bytes each
    assert size[54_000] <= 500 and size[25_700_000] <= 7 * size[54_000] and size[100_000_000] < 5_000
    for n, p in plans.items():
        hit = 0.8**p.fixed * setjoin.at_most(p.flips, p.width - p.fixed, 0.2)
        assert 1 - (1 - hit) ** p.segments >= 0.9999 and n / 2**p.fixed <= 2_000_000


def test_set_join_in_slices(books, monkeypatch):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(80)]
    base = [rng.sample(words, 8) for _ in range(80)]
    sets = base + [[*b[1:], rng.choice(words)] for b in base]
    want = {(i, j) for (i, a), (j, b) in combinations(enumerate(sets), 2) if len({*a} & {*b}) / len({*a} | {*b}) >= 0.6}
    plan = setjoin.Plan
    monkeypatch.setattr(setjoin, "Plan", lambda n, t, r: plan(n, t, r, slice_rows=20))
    pairs, members = setjoin.similar_sets(books([{"book_id": i, "keywords": s} for i, s in enumerate(sets)]), "book_id", "keywords")
    assert pairs_of(setjoin.expanded(pairs, members)) == want


# queries against their SQL

SF = "/root/testdata/sf0.001"


def cell(v):
    return "NULL" if v is None or v != v else f"{v:.6f}" if isinstance(v, float) else str(v)


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not there")
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_agrees_with_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    df = queries.QUERIES[name](spark, SF)
    got = con.execute(queries.ORACLE_SQL[name])
    columns = [c[0] for c in got.description]
    assert sorted(df.columns) == sorted(columns)
    rows = lambda some, names: sorted(tuple(cell(r[i]) for i in sorted(range(len(names)), key=lambda i: names[i])) for r in some)
    assert rows(df.collect(), df.columns) == rows(got.fetchall(), columns)


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not there")
@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL)))
def test_query_runs(spark, name):
    rows = queries.QUERIES[name](spark, SF).collect()
    assert len(set(map(str, rows))) == len(rows) and (rows or name == "p10_found")


def test_filter_finds_every_term():
    rng = random.Random(11)
    words = sorted({"".join(rng.choice("ab哈希") for _ in range(rng.randint(1, 9))) for _ in range(60)} | {"x" * 300})
    texts = ["".join(rng.choice("ab哈希 ") for _ in range(rng.randint(0, 200))) for _ in range(50)] + ["", "x" * 900, "aaaaaaa"]
    terms = distinctive.Filter(len(words))
    each = [distinctive.Substrings(w) for w in words]
    first = np.array([0])
    terms.add(np.array([x.of(first, x.n)[0] for x in each]), np.array([x.of(first, min(4, x.n))[0] for x in each]), np.array([x.n for x in each]))
    for text, counts in zip(texts, distinctive.counts_of(terms, texts), strict=True):
        assert {w: n for w, n in counts.items() if w in words} == {w: text.count(w) for w in words if w in text}
    assert distinctive.counts_of(terms, []) == [] and distinctive.counts_of(distinctive.Filter(0), ["abc"]) == [{}]
