"""Subject areas of each record.

Method: class-association rules, mined with parallel frequent-pattern growth.

1. The vocabulary holds the words of the lexicon and every keyword that three records or more carry,
   whatever the collection's size. One pass finds their occurrences in titles and sentences: of up to
   ``most_terms`` by an automaton; of more by a rolling hash, a Bloom filter and keys of 128 bits; beyond
   ``part_terms`` in a pass for each part, their occurrences brought together by sentence. The result is the same.
2. Term rules: each record is a transaction of the terms it mentions and of the subjects it is known
   to have (its labels, else the subjects its lexicon words show). FP-growth gives the rules
   {terms} => subject that hold in one transaction of a thousand; those of one term are counted
   directly from three transactions on, their confidence short of the share by one transaction. A rule
   is redundant, and pruned, if a more general one of the same subject is no less confident. A word of
   the lexicon starts with a confidence of 0.95, worth four transactions, and goes by labelled records.
3. Context rules: each mention in a labelled record is a transaction of the words next to the term
   and of whether the record has the term's subject. The rules {words} => aside tell mere
   comparisons, jokes and footnotes from sentences that are about something.
4. Every record is scored by the evidence of the rules that match: whether its title mentions the
   subject, how many sentences are about it, aside ones excluded, and the confidence of the best rule
   that matched. The share of labelled records with that evidence that do have the subject
   calibrates the score.

Tags, reviews and author introductions are not evidence. Cases: a null or blank title or text gives
no evidence; a record without evidence gives no row; repeated rows under one id count once; without
labels the calibration falls back to its prior (a title or two sentences).
"""

from __future__ import annotations

import copy
import hashlib
import math
import re
import unicodedata
from collections import defaultdict
from collections.abc import Callable
from functools import reduce

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstone.llm.arrow import batch_of, normalise, normalised_set, pack, unpack
from quillstone.llm.distinctive import CHUNK, HEAD, Filter, Substrings
from quillstone.storage import cut

_ENDS = re.compile(r"(?<=[。！？!?…；;])|(?<=\.)\s+|\n+|<[^<>]{0,20}>")
_WORD = re.compile(r"\w+|[^\w\s]")
_MENTIONS = pa.schema([("record", pa.int64()), ("place", pa.int32()), ("term", pa.string()), ("context", pa.list_(pa.string()))])
_SEEN = pa.schema([*_MENTIONS, ("sentence", pa.int64()), ("start", pa.int32()), ("stop", pa.int32())])
MOST_COUNTED = 4
#: confidence from which a rule counts as strong, and the worth of a lexicon word before any transaction
STRONG, LEXICON, WORTH = 0.8, 0.95, 4


def sentences(text: str | None) -> list[str]:
    """Normalised sentences; invisible characters go, line breaks and markup end a sentence."""
    if not text:
        return []
    text = unicodedata.normalize("NFKC", "".join(c for c in text if unicodedata.category(c) != "Cf"))
    return [x for x in (normalise(s) for s in _ENDS.split(text)) if x]


def automaton(terms: list[str]) -> ahocorasick.Automaton | None:
    a = ahocorasick.Automaton()
    for t in terms:
        a.add_word(t, t)
    if not len(a):
        return None
    a.make_automaton()
    return a


class Automaton:
    """Terms, found by one automaton."""

    def __init__(self, terms: list[str]):
        self.terms = terms
        self.found: ahocorasick.Automaton | None = None

    def occurrences(self, texts: list[str]) -> list[list[tuple[int, int]]]:
        self.found = self.found or automaton(self.terms)
        return [[(end - len(term) + 1, end + 1) for end, term in self.found.iter(t)] if self.found else [] for t in texts]


class Keys:
    """Terms by keys of 128 bits, 64 of them a rolling hash; 22 bytes a term."""

    def __init__(self, terms: DataFrame, n: int):
        schema = pa.schema([("keys", pa.binary())])

        def run(batches):
            for batch in batches:
                words = batch.column(0).to_pylist()
                each = [Substrings(t) for t in words]
                lengths = np.array([x.n for x in each], np.int64)
                hashes = np.array([x.of(np.array([0]), x.n)[0] for x in each], np.uint64)
                heads = np.array([x.of(np.array([0]), min(HEAD, x.n))[0] for x in each], np.uint64)
                yield pa.RecordBatch.from_pydict({"keys": [pack(hashes, heads, lengths, np.array([second(t) for t in words], np.uint64))]}, schema=schema)

        self.filter = Filter(n)
        held = [(np.empty(0, np.uint64), np.empty(0, np.uint64))]
        for row in terms.select("term").mapInArrow(run, "keys binary").toLocalIterator():
            hashes, heads, lengths, seconds = unpack(bytes(row["keys"]))
            self.filter.add(hashes, heads, lengths)
            held.append((hashes, seconds))
        hashes, seconds = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(hashes)
        self.hashes, self.seconds = hashes[order], seconds[order]

    def occurrences(self, texts: list[str]) -> list[list[tuple[int, int]]]:
        """(start, end) of every term in each of the texts, which hold no line break."""
        found: list[list[tuple[int, int]]] = [[] for _ in texts]
        joined = "\n".join(texts)
        if not joined:
            return found
        owners = np.cumsum([0, *(len(t) + 1 for t in texts)])
        start, length, h = self.filter.occurrences(joined)
        lo, hi = (np.searchsorted(self.hashes, h, side) for side in ("left", "right"))
        start, length, lo, hi = (x[hi > lo] for x in (start, length, lo, hi))
        owner = np.searchsorted(owners, start, "right") - 1
        for at, n, x, y, i, base in zip(*(v.tolist() for v in (start, length, lo, hi, owner, owners[owner])), strict=True):
            if second(joined[at : at + n]) in self.seconds[x:y]:
                found[i].append((at - base, at - base + n))
        return found


def second(term: str) -> np.uint64:
    return np.frombuffer(hashlib.blake2b(term.encode("utf-8", "surrogatepass"), digest_size=8).digest(), np.uint64)[0]


def alone(text: str, start: int, stop: int) -> bool:
    """Words of an alphabet have to stand alone but for an ending s."""
    if text[start].isascii() and start and text[start - 1].isalnum() and text[start - 1].isascii():
        return False
    rest = text[stop : stop + 2]
    return not (text[stop - 1].isascii() and rest and rest[0].isascii() and rest[0].isalnum() and not (rest[0] == "s" and not rest[1:].isalnum()))


def longest(found: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Of occurrences (start, end) the longest, left to right without overlap."""
    out, at = [], 0
    for start, stop in sorted(found, key=lambda x: (x[0], -x[1])):
        if start >= at:
            out.append((start, stop))
            at = stop
    return out


def context_items(sentence: str, start: int, stop: int) -> list[str]:
    """What stands next to a term: one and two words of an alphabet, two and four other characters."""
    before, after = sentence[:start].rstrip(), sentence[stop:].lstrip()
    items = []
    for side, text in (("l", before[-40:]), ("r", after[:40])):
        words = _WORD.findall(text)
        if not words:
            items.append(f"{side}:")
            continue
        near = words[-1] if side == "l" else words[0]
        if near.isascii() and near.isalnum():
            pick = (lambda n, w=words, s=side: " ".join(w[-n:] if s == "l" else w[:n]))
            items += [f"{side}{n}:{pick(n)}" for n in (1, 2, 3)]
        else:
            items += [f"{side}{n}:{text[-n:] if side == 'l' else text[:n]}" for n in (2, 4)]
    return sorted(set(items))


def mentions(df: DataFrame, id_col: str, title: str, text: str, parts: list[Callable[[], Automaton | Keys]]) -> DataFrame:
    """(record, place, term, context): place 0 is the title, then the sentences. ``parts`` make the parts of the vocabulary."""
    kept = df.select(F.col(id_col).cast("long"), F.col(title), F.col(text))

    def run(batches, known, whole):
        terms = copy.copy(known.value)  # an automaton goes with its task
        for batch in batches:
            given = []
            for record, t, x in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if record is not None:
                    given += [(record, place, s) for place, s in enumerate([" ".join(sentences(t)), *sentences(x)])]
            sizes = np.cumsum([len(s) for *_, s in given]) // CHUNK
            edges = [0, *(np.flatnonzero(np.diff(sizes)) + 1).tolist(), len(given)]
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                out: dict[str, list] = {f.name: [] for f in (_MENTIONS if whole else _SEEN)}
                for (record, place, s), found in zip(given[lo:hi], terms.occurrences([s for *_, s in given[lo:hi]]), strict=True):
                    found = [x for x in found if alone(s, *x)]
                    for start, stop in longest(found) if whole else found:
                        out["record"].append(record)
                        out["place"].append(place)
                        out["term"].append(s[start:stop])
                        out["context"].append(context_items(s, start, stop))
                        if not whole:
                            out["sentence"].append(int(second(s).view(np.int64)))
                            out["start"].append(start)
                            out["stop"].append(stop)
                yield batch_of(out, _MENTIONS if whole else _SEEN)

    kind = "record long, place int, term string, context array<string>"
    made = lambda part: df.sparkSession.sparkContext.broadcast(part())
    if len(parts) == 1:
        return kept.mapInArrow(lambda batches, known=made(parts[0]): run(batches, known, True), kind).distinct()
    seen = [kept.mapInArrow(lambda batches, known=made(p): run(batches, known, False), f"{kind}, sentence long, start int, stop int") for p in parts]

    def resolve(batches):
        for batch in batches:
            out: dict[str, list] = {f.name: [] for f in _MENTIONS}
            for record, place, rows in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                at = {(r["start"], r["stop"]): r for r in rows}
                for x in longest(list(at)):
                    out["record"].append(record)
                    out["place"].append(place)
                    out["term"].append(at[x]["term"])
                    out["context"].append(at[x]["context"])
            yield batch_of(out, _MENTIONS)

    of_sentence = F.collect_list(F.struct("start", "stop", "term", "context")).alias("rows")
    gathered = reduce(DataFrame.unionByName, seen).groupBy("record", "place", "sentence").agg(of_sentence)
    return gathered.select("record", "place", "rows").mapInArrow(resolve, kind).distinct()


def keyword_terms(df: DataFrame, keywords: str, least: int) -> DataFrame:
    """Normalised keywords that at least ``least`` records carry."""
    schema = pa.schema([("term", pa.string())])

    def run(batches):
        for batch in batches:
            yield batch_of({"term": [k for ks in batch.column(0).to_pylist() for k in normalised_set(ks) if len(k) > 1]}, schema)

    return df.select(keywords).mapInArrow(run, "term string").groupBy("term").count().filter(F.col("count") >= least).select("term")


def class_rules(transactions: DataFrame, support: float, confidence: float) -> list[tuple[frozenset[str], str, float]]:
    """Rules (items, class, confidence) of transactions whose class items begin with '=', the redundant
    ones pruned; strongest first."""
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(transactions)
    found = model.associationRules.filter(F.col("consequent")[0].startswith("=") & ~F.exists("antecedent", lambda x: x.startswith("=")))
    found = found.filter(F.size("antecedent") <= 3).select("antecedent", F.col("consequent")[0].alias("to"), "confidence").collect()
    kept: dict[tuple[frozenset[str], str], float] = {}
    for r in sorted(found, key=lambda r: (len(r["antecedent"]), sorted(r["antecedent"]))):
        items = frozenset(r["antecedent"])
        general = [kept[part, r["to"]] for x in items if (part := items - {x}) and (part, r["to"]) in kept]
        general += [kept[frozenset([x]), r["to"]] for x in items if (frozenset([x]), r["to"]) in kept and len(items) > 1]
        if not any(c >= r["confidence"] - 0.02 for c in general):
            kept[items, r["to"]] = r["confidence"]
    return sorted(((i, to[1:], c) for (i, to), c in kept.items()), key=lambda x: (-x[2], sorted(x[0]), x[1]))


class Rules:
    """Term rules and context rules in the form that scoring needs; those of one term may also come with the terms (``having``)."""

    def __init__(self, singles: dict[str, dict[str, float]], terms: list[tuple[frozenset[str], str, float]], contexts: list[tuple[frozenset[str], str, float]]):
        self.single = singles
        self.joint: dict[str, list] = defaultdict(list)
        self.context: dict[str, list] = defaultdict(list)
        for items, subject, c in terms:
            if len(items) > 1:
                for x in items:
                    self.joint[x].append((items, subject, c))
        for items, _, c in contexts:
            for x in items:
                self.context[x].append((items, c))

    def having(self, singles: dict[str, dict[str, float]]) -> Rules:
        out = copy.copy(self)
        out.single = singles
        return out

    def aside(self, context: list[str]) -> float:
        """Confidence of the strongest matching rule that the mention is an aside."""
        own, best = set(context), 0.0
        for x in context:
            for items, c in self.context.get(x, ()):
                if c > best and items <= own:
                    best = c
        return best

    def subjects(self, term: str, beside: set[str]) -> dict[str, float]:
        out = dict(self.single.get(term, {}))
        for items, s, c in self.joint.get(term, ()):
            if items <= beside:
                out[s] = max(c, out.get(s, 0.0))
        return out


def evidence_of(rows: list[tuple[int, str, list[str]]], rules: Rules, least: float = 0.5) -> dict[str, tuple[int, int, float]]:
    """subject -> (title mentions it, sentences about it, confidence) from a record's (place, term, context)."""
    by_place: dict[int, list] = defaultdict(list)
    for place, term, context in rows:
        by_place[place].append((term, context))
    title: set[str] = set()
    count: dict[str, int] = defaultdict(int)
    strength: dict[str, float] = defaultdict(float)
    for place, found in by_place.items():
        beside = {t for t, _ in found}
        here: set[str] = set()
        for term, context in found:
            about = 1.0 if place == 0 else 1.0 - rules.aside(context)
            subjects = rules.subjects(term, beside)
            # a term speaks for its strongest subject only
            if subjects and max(subjects.values()) * about >= least:
                best = max(sorted(subjects), key=subjects.get)
                here.add(best)
                strength[best] = max(strength[best], subjects[best] * about)
        if place == 0:
            title |= here
        else:
            for s in here:
                count[s] += 1
    return {s: (int(s in title), count[s], strength[s]) for s in title | set(count)}


def single_rules(found: DataFrame, labels: DataFrame, classes: DataFrame, known: dict[str, set[str]]) -> DataFrame:
    """(term, subject, confidence) of the rules of one term."""
    spark = found.sparkSession
    held = found.select("record", "term").distinct()
    of_class = classes.select("record", F.explode("classes").alias("subject"))
    every = held.join(classes.select("record"), "record")
    n = every.groupBy("term").agg(F.count("*").alias("n"))
    has = every.join(of_class, "record").groupBy("term", "subject").agg(F.count("*").alias("has"))
    words = F.broadcast(spark.createDataFrame([(t,) for t in sorted(known)] or [("",)], "term string"))
    mined = has.filter("has >= 3").join(n, "term").withColumn("confidence", F.col("has") / (F.col("n") + 1)).filter("confidence >= 0.4")
    mined = mined.join(words, "term", "left_anti").select("term", F.expr("substring(subject, 2)").alias("subject"), "confidence")
    sure = held.join(words, "term").join(labels.select("record").distinct(), "record")
    seen = {(r["term"], r["subject"]): r["has"] for r in sure.join(labels, "record").groupBy("term", "subject").agg(F.count("*").alias("has")).collect()}
    n = {r["term"]: r["n"] for r in sure.groupBy("term").agg(F.count("*").alias("n")).collect()}
    given = [(t, s, (seen.get((t, s), 0) + WORTH * LEXICON) / (n.get(t, 0) + WORTH)) for t, subjects in known.items() for s in sorted(subjects)]
    return mined.unionByName(spark.createDataFrame(given, "term string, subject string, confidence double"))


def subject_scores(
    books: DataFrame,
    labels: DataFrame,
    lexicon: DataFrame,
    id_col: str = "book_id",
    title: str = "title",
    text: str = "books_intro",
    keywords: str = "keywords",
    most_terms: int = 200_000,
    part_terms: int = 4_000_000,
) -> DataFrame:
    """(record, subject, in_title, sentences, confidence, score). Up to ``most_terms`` keywords travel to all tasks as
    they are, up to ``part_terms`` as keys; the result does not depend on either."""
    spark = books.sparkSession
    known: dict[str, set[str]] = defaultdict(set)
    for r in lexicon.select("keyword", "subject").distinct().collect():
        if normalise(r["keyword"]) and r["subject"]:
            known[normalise(r["keyword"])].add(r["subject"])
    labels = cut(labels.filter("subject is not null").select(F.col(id_col).cast("long").alias("record"), "subject").distinct(), "labels")
    carried = cut(keyword_terms(books, keywords, 3), "keyword-terms")
    n = carried.count()
    few = n <= most_terms
    if few:
        terms = carried.toArrow().column(0).to_pylist()
        parts = [lambda: Automaton(sorted({*terms, *known}))]
    else:
        every = carried.unionByName(spark.createDataFrame([(t,) for t in known], "term string")).distinct()
        k = math.ceil(n / part_terms)
        parts = [lambda p=p: Keys(every.filter(F.pmod(F.xxhash64("term"), F.lit(k)) == p), n // k + 1) for p in range(k)]
    # a table of a row or more for each term, to all tasks while these are few
    of_terms = F.broadcast if few else lambda df: df
    found = cut(mentions(books, id_col, title, text, parts), "mentions")
    table = spark.createDataFrame([(t, s) for t, ss in known.items() for s in sorted(ss)], "term string, subject string")
    shown = (
        found.join(F.broadcast(table), "term")
        .groupBy("record", "subject")
        .agg(F.count_distinct("place").alias("places"), F.min("place").alias("first"))
        .filter("places > 1 or first = 0")
        .select("record", "subject")
    )
    classes = labels.unionByName(shown.join(labels.select("record").distinct(), "record", "left_anti"))
    classes = cut(classes.groupBy("record").agg(F.collect_set(F.concat(F.lit("="), "subject")).alias("classes")), "classes")
    baskets = found.groupBy("record").agg(F.collect_set("term").alias("terms")).join(classes, "record")
    baskets = cut(baskets.select(F.concat("terms", "classes").alias("items")), "baskets")
    singles = cut(single_rules(found, labels, classes, known), "single-rules")
    term_rules = class_rules(baskets, 0.001, 0.4) if baskets.head(1) else []
    # a term's strongest subject, the first of equal ones
    strongest = singles.groupBy("term").agg(F.min(F.struct((-F.col("confidence")).alias("less"), "subject")).alias("x")).filter("x.less <= -0.5")
    table = strongest.select("term", "x.subject")

    # contexts of mentions in labelled records
    of_labelled = found.filter("place > 0").join(labels.select("record").distinct(), "record").join(of_terms(table), "term")
    marked = of_labelled.join(labels.withColumn("has", F.lit(True)), ["record", "subject"], "left")
    contexts = marked.select(F.concat("context", F.array(F.when(F.col("has"), "=about").otherwise("=aside"))).alias("items"))
    contexts = cut(contexts, "contexts")
    size = contexts.count()
    context_rules = class_rules(contexts, max(4 / max(1, size), 0.0005), 0.6) if size else []
    by_term: dict[str, dict[str, float]] = defaultdict(dict)
    for r in singles.collect() if few else ():
        by_term[r["term"]][r["subject"]] = r["confidence"]
    rules = spark.sparkContext.broadcast(Rules(by_term, term_rules, [r for r in context_rules if r[1] == "aside"]))

    schema = pa.schema([("record", pa.int64()), ("subject", pa.string()), ("in_title", pa.int32()), ("sentences", pa.int32()), ("confidence", pa.float64())])

    def score(batches):
        for batch in batches:
            out: dict[str, list] = {f.name: [] for f in schema}
            for record, rows in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                given = [(r["place"], r["term"], r["context"]) for r in rows]
                own = rules.value if few else rules.value.having({r["term"]: {x["subject"]: x["confidence"] for x in r["singles"] or ()} for r in rows})
                for s, (t, k, c) in sorted(evidence_of(given, own).items()):
                    out["record"].append(record)
                    out["subject"].append(s)
                    out["in_title"].append(t)
                    out["sentences"].append(k)
                    out["confidence"].append(c)
            yield batch_of(out, schema)

    with_rules, columns = found, ["place", "term", "context"]
    if not few:
        with_rules = found.join(singles.groupBy("term").agg(F.collect_list(F.struct("subject", "confidence")).alias("singles")), "term", "left")
        columns.append("singles")
    gathered = with_rules.groupBy("record").agg(F.collect_list(F.struct(*columns)).alias("rows"))
    evidence = cut(gathered.mapInArrow(score, "record long, subject string, in_title int, sentences int, confidence double"), "evidence")

    # calibration: of labelled records with this evidence, the share that has the subject
    counted, strong = F.least("sentences", F.lit(MOST_COUNTED)).alias("counted"), (F.col("confidence") >= STRONG).alias("strong")
    seen = (
        evidence.join(labels.select("record").distinct(), "record")
        .join(labels.withColumn("has", F.lit(1)), ["record", "subject"], "left")
        .groupBy("in_title", counted, strong)
        .agg(F.count("*").alias("n"), F.count("has").alias("has"))
    )
    prior = F.when((F.col("in_title") == 1) | (F.col("counted") > 1), 0.9).otherwise(0.1)
    # a cell leans on the rate of its title and sentences whatever the confidence, as on four records more
    wide = Window.partitionBy("in_title", "counted")
    whole = (F.sum("has").over(wide) + WORTH * prior) / (F.sum("n").over(wide) + WORTH)
    rates = seen.withColumn("whole", whole).select("in_title", "counted", "strong", ((F.col("has") + WORTH * F.col("whole")) / (F.col("n") + WORTH)).alias("rate"))
    return (
        evidence.withColumns({"counted": counted, "strong": strong})
        .join(F.broadcast(rates), ["in_title", "counted", "strong"], "left")
        .select("record", "subject", "in_title", "sentences", "confidence", F.coalesce("rate", prior).alias("score"))
    )
