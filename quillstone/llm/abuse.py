"""Abusive, hateful or sexual content.

Method: class-conditional Kneser-Ney models over characters. Texts are undisguised (invisible
characters, separators inside words and long repeats go) and cut into sentences. Two interpolated
Kneser-Ney models, one of toxic and one of ordinary sentences, give each sentence the difference of
its log-likelihoods per character; their lowest order is shared, a distribution of continuation
counts over both classes, so an expression rare in one class is smoothed by what both have seen.
A document's score is that of its worst sentence.

Labels are per document while one sentence makes a document toxic, so the toxic model is refined:
first all sentences of toxic documents train it, then in each round only those that models of other
documents find toxic; the rest join the ordinary model. Of documents
whose annotators disagree, the majority counts, a tie counts as toxic nowhere and is left out.
The threshold is the one with the best F1 on held-out thirds, with toxic and ordinary documents
weighted to the share of toxic ones in the corpus; it is never below 0, where both models explain a
sentence equally well. That share is estimated from the scores of all documents: of the documents
above 0, and of the labelled ones of both classes above 0, it follows how many of all are toxic.

Models are fitted on the driver on at most ``most_labelled`` labelled documents (a documented bound;
their n-grams bound what is broadcast); every document is scored, as a whole text.

Cases: null, empty and blank texts score null and are never found; documents without usable labels
give no model: every score is null; repeated rows give repeated rows; very long texts are scored
sentence by sentence, and sentences in windows of 400 characters.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.storage import cut

ORDER = 6
#: characters that texts may hold, for those that no labelled document has
ALPHABET = 5_000.0
_ENDS = re.compile(r"(?<=[。！？!?…～~])(?![。！？!?…～~])|(?<=\.)(?=\s)|(?<=\.\.)(?!\.)|\n+|<[^<>]{0,20}>")
_CJK = "㐀-鿿"
# separators that only serve to break a word: inside Chinese, or between single letters
_INSIDE_ZH = re.compile(rf"(?<=[{_CJK}])[ *._\-·|/+~]+(?=[{_CJK}])")
_SPACED = re.compile(r"(?<![^\W_])[^\W\d_](?:[ *._\-|/+][^\W\d_]){2,}(?![^\W_])")
_MASKED = re.compile(r"(?<=[^\W\d_])[*._\-|/+]+(?=[^\W\d_])")
_REPEAT = re.compile(r"(.)\1{2,}")
_NUMBER = re.compile(r"\d+")


def sentences(text: str | None) -> list[str]:
    """Undisguised sentences, lower case, numbers as 0."""
    if not text:
        return []
    text = unicodedata.normalize("NFKC", "".join(c for c in text if unicodedata.category(c) != "Cf")).lower()
    out = []
    for s in _ENDS.split(text):
        s = " ".join(s.split())
        s = _INSIDE_ZH.sub("", s)
        s = _SPACED.sub(lambda m: re.sub(r"[ *._\-|/+]", "", m.group()), s)
        s = _MASKED.sub("", s)
        s = _NUMBER.sub("0", _REPEAT.sub(r"\1\1", s))
        s = s.strip(" .。!！?？…~～,，")
        if len(s) > 1:
            out += [s[i : i + 400] for i in range(0, len(s), 400)]
    return out


def encoded(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts, each led by ORDER - 1 starts and ended by one end; text of each position."""
    lead = "\x02" * (ORDER - 1)
    joined = "".join(f"{lead}{t}\x03" for t in texts)
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32).astype(np.uint64)
    sizes = np.fromiter((len(t) + ORDER for t in texts), np.int64, len(texts))
    return points, np.repeat(np.arange(len(texts)), sizes)


def gram_hashes(points: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n-gram that ends at each position (0 where there is none)."""
    h = np.zeros(len(points), np.uint64)
    for i in range(n - 1, -1, -1):
        shifted = np.zeros_like(points)
        shifted[i:] = points[: len(points) - i]
        h = (h ^ shifted) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
    return h ^ np.uint64(n)


class Counts:
    """A sorted table of hashes with one or two counts each: of ``hashes`` and of ``second``, a part of
    them. Hashes are spread evenly, so their leading bits find the place in the table, and a few steps
    from there the entry."""

    def __init__(self, hashes: np.ndarray, second: np.ndarray | None = None):
        spread = np.uint64(0xD6E8FEB86659FD93)
        self.keys, counts = np.unique(hashes * spread, return_counts=True)
        self.counts = np.append(counts, 0).astype(np.float64)[:, None]
        if second is not None:
            more = np.bincount(np.searchsorted(self.keys, second * spread), minlength=len(self.counts))
            self.counts = np.column_stack([self.counts, more])
        self.shift = np.uint64(64 - max(1, len(self.keys).bit_length() + 1))
        self.starts = np.searchsorted(self.keys, np.arange((1 << (64 - int(self.shift))) + 1, dtype=np.float64) * 2.0 ** int(self.shift))
        self.keys = np.append(self.keys, np.uint64(0))

    def of(self, hashes: np.ndarray) -> np.ndarray:
        hashes = hashes * np.uint64(0xD6E8FEB86659FD93)
        bucket = (hashes >> self.shift).astype(np.int64)
        at, stop = self.starts[bucket], self.starts[bucket + 1]
        out = np.zeros((len(hashes), self.counts.shape[1]))
        left = np.flatnonzero(at < stop)
        while len(left):
            here = at[left]
            hit = self.keys[here] == hashes[left]
            out[left[hit]] = self.counts[here[hit]]
            left = left[~hit]
            at[left] += 1
            left = left[at[left] < stop[left]]
        return out


class KneserNey:
    """Interpolated Kneser-Ney over characters; ``shared`` is the lowest order, common to both classes."""

    def __init__(self, texts: list[str], shared: Counts, discount: float = 0.75):
        points, _ = encoded(texts)
        real = points != 2
        self.discount, self.shared = discount, shared
        self.grams: list[Counts] = []
        self.contexts: list[Counts] = []
        for n in range(2, ORDER + 1):
            gram, context = gram_hashes(points, n)[real], np.roll(gram_hashes(points, n - 1), 1)[real]
            if n < ORDER:
                # continuation counts: in how many different left contexts the n-gram occurs
                wider = gram_hashes(points, n + 1)[real]
                _, first = np.unique(wider, return_index=True)
                gram, context = gram[first], context[first]
            self.grams.append(Counts(gram))
            _, first = np.unique(gram, return_index=True)
            self.contexts.append(Counts(context, context[first]))

    def log_likelihood(self, hashes: list[np.ndarray], low: np.ndarray) -> np.ndarray:
        p = low
        for n in range(2, ORDER + 1):
            total, types = self.contexts[n - 2].of(np.roll(hashes[n - 1], 1)).T
            count = self.grams[n - 2].of(hashes[n])[:, 0]
            seen, at_least = total > 0, np.maximum(total, 1)
            rest = np.where(seen, self.discount * types / at_least, 1.0)
            p = np.maximum(count - self.discount, 0) / at_least + rest * p
        return np.log(p)


def shared_counts(texts: list[str]) -> Counts:
    """Continuation counts of single characters over both classes."""
    points, _ = encoded(texts)
    real = points != 2
    _, first = np.unique(gram_hashes(points, 2)[real], return_index=True)
    return Counts(gram_hashes(points, 1)[real][first])


class Models:
    """Both classes' models; ``score`` compares them."""

    def __init__(self, toxic: KneserNey, ordinary: KneserNey):
        self.toxic, self.ordinary = toxic, ordinary
        self.types = float(toxic.shared.counts.sum())

    def score(self, texts: list[str]) -> np.ndarray:
        """Log-likelihood ratio per character of each sentence."""
        if not texts:
            return np.empty(0)
        points, owner = encoded(texts)
        hashes = [np.empty(0, np.uint64)] + [gram_hashes(points, n) for n in range(1, ORDER + 1)]
        low = (self.toxic.shared.of(hashes[1])[:, 0] + 0.5) / (self.types + ALPHABET)
        ratio = self.toxic.log_likelihood(hashes, low) - self.ordinary.log_likelihood(hashes, low)
        real = points != 2
        return np.bincount(owner[real], ratio[real], len(texts)) / np.bincount(owner[real], minlength=len(texts))


def fit(docs: list[list[str]], labels: list[bool], rounds: int = 3, folds: int = 3) -> Models:
    """Models from documents' sentences and whether the document is toxic.

    In each round a toxic document's sentences are judged by a toxic model that has not seen it, so
    a wrongly labelled one does not vouch for itself."""
    clean = [s for d, bad in zip(docs, labels, strict=True) if not bad for s in d]
    known = set(clean)
    bad_docs = [d for d, bad in zip(docs, labels, strict=True) if bad and d]
    shared = shared_counts([s for d in docs for s in d])
    ordinary = KneserNey(clean, shared)
    toxic = [[s for s in d if s not in known] for d in bad_docs]
    fold = [hash_of(d) % folds for d in bad_docs]
    for _ in range(rounds):
        new = [list[str]() for _ in bad_docs]
        for f in range(folds):
            others = [s for t, g in zip(toxic, fold, strict=True) if g != f for s in t]
            own = [i for i, g in enumerate(fold) if g == f]
            if not others or not own:
                continue
            flat = [s for i in own for s in bad_docs[i]]
            scores, at = Models(KneserNey(others, shared), ordinary).score(flat), 0
            for i in own:
                for s in bad_docs[i]:
                    if scores[at] > 0:
                        new[i].append(s)
                    at += 1
        if not any(new):
            break
        toxic = new
    said = {s for t in toxic for s in t}
    rest = [s for d in bad_docs for s in d if s not in said]
    return Models(KneserNey([s for t in toxic for s in t], shared), KneserNey(clean + rest, shared))


def hash_of(doc: list[str]) -> int:
    return int.from_bytes(hashlib.blake2b("\n".join(doc).encode(), digest_size=4).digest(), "little")


def worst(models: Models, docs: list[list[str]], known: dict[str, float] | None = None) -> np.ndarray:
    """Score of each document: that of its worst sentence, -inf without one. ``known`` keeps scores of
    sentences between calls."""
    known = {} if known is None else known
    new = [s for s in dict.fromkeys(s for d in docs for s in d) if s not in known]
    known.update(zip(new, models.score(new).tolist(), strict=True))
    found = np.array([max((known[s] for s in d), default=-np.inf) for d in docs])
    if len(known) > 200_000:
        known.clear()
    return found


def trained(docs: list[list[str]], labels: list[bool], folds: int = 3) -> tuple[Models, np.ndarray]:
    """Models on all documents, and of each document its score by models that have not seen it."""
    held = np.empty(len(docs))
    fold = np.array([hash_of(d) // 7 % folds for d in docs])
    for f in range(folds):
        own, others = np.flatnonzero(fold == f), np.flatnonzero(fold != f)
        part = fit([docs[i] for i in others], [labels[i] for i in others])
        held[own] = worst(part, [docs[i] for i in own])
    return fit(docs, labels), held


def estimated_share(held: np.ndarray, truth: np.ndarray, above: float) -> float:
    """Share of toxic documents where the share ``above`` scores over 0, by the rates of held-out ones.

    The rates of both classes start from one document of each side, so few labels give no extremes."""
    hit, false = ((np.sum(held[x] > 0) + 0.5) / (x.sum() + 1) for x in (truth, ~truth))
    return float(np.clip((above - false) / max(hit - false, 0.05), 0.001, 0.5))


def best_threshold(held: np.ndarray, truth: np.ndarray, share: float) -> float:
    """The threshold of at least 0 with the best F1 where ``share`` of the documents are toxic."""
    weight = np.where(truth, share / max(1, truth.sum()), (1 - share) / max(1, (~truth).sum()))
    order = np.argsort(-held)
    ranked = held[order]
    hit, said = np.cumsum(np.where(truth, weight, 0)[order]), np.cumsum(weight[order])
    f1 = np.where(ranked > 0, 2 * hit / (said + share), 0)
    if not f1.any():
        return 0.0
    best = int(np.argmax(f1))
    below = ranked[best + 1] if best + 1 < len(ranked) else 0.0
    return float((ranked[best] + max(below, 0.0)) / 2)


def toxicity(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", most_labelled: int = 10_000) -> DataFrame:
    """(id, score, toxic) of every document; score is null where there is nothing to score."""
    spark = documents.sparkSession
    votes = (
        labels.filter("label is not null")
        .groupBy(F.col(id_col).alias("id"))
        .agg(F.sum(F.when(F.col("label") == "clean", -1).otherwise(1)).alias("vote"))
        .filter("vote <> 0")
    )
    sample = votes.orderBy(F.xxhash64("id")).limit(most_labelled)
    texts = documents.select(F.col(id_col).alias("id"), F.col(text).alias("text")).filter("text is not null")
    rows = sorted(texts.join(F.broadcast(sample), "id").dropDuplicates(["id"]).select("id", "text", "vote").collect(), key=lambda r: r["id"])
    docs = [sentences(r["text"]) for r in rows]
    bad = [r["vote"] > 0 for r in rows]
    kept = documents.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    kind = kept.schema["id"].dataType.simpleString()
    if not any(d and b for d, b in zip(docs, bad, strict=True)) or all(bad):
        return kept.select(F.col("id").alias(id_col), F.lit(None).cast("double").alias("score"), F.lit(False).alias("toxic"))
    models, held = trained(docs, bad)
    shared = spark.sparkContext.broadcast(models)

    def run(batches):
        known: dict[str, float] = {}
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            scores: list[float | None] = []
            for lo in range(0, len(texts), 500):
                score = worst(shared.value, [sentences(t) for t in texts[lo : lo + 500]], known)
                scores += [None if not np.isfinite(x) else float(x) for x in score]
            yield pa.RecordBatch.from_arrays([ids, pa.array(scores, pa.float64())], names=["id", "score"])

    scored = cut(kept.mapInArrow(run, f"id {kind}, score double"), "toxicity")
    counted = scored.filter("score is not null").agg(F.count("*").alias("n"), F.count_if(F.col("score") > 0).alias("above")).first()
    truth = np.array(bad)
    share = estimated_share(held, truth, counted["above"] / max(1, counted["n"]))
    toxic = F.coalesce(F.col("score") > best_threshold(held, truth, share), F.lit(False))
    return scored.select(F.col("id").alias(id_col), "score", toxic.alias("toxic"))
