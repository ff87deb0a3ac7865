"""How distinctive a term is for its record.

Method: a parsimonious language model. Each record's term frequencies are explained by a mixture
of the record's own model and the collection's background model; expectation-maximisation moves
the mass that the background explains away from the record. The probabilities at convergence rank
the record's terms.

The vocabulary is every keyword of the collection. It grows with the collection, so what travels to
the tasks is a Bloom filter of it, four bytes a term: every substring of a text that has the length of
a term is looked up by a rolling hash, its first four characters before the rest. Strings that pass
by chance belong to no list and fall out when frequencies are joined. A record's terms are those of the vocabulary that its texts hold, listed or not, each
with its occurrences and one more where it is listed; the background is their sum over all records. A
term that is no more frequent in a record than (1 - own_share) / own_share times its background
loses all its mass to it, and leaves the record's model. Convergence is that of each record, so a
weight does not depend on what else is in its partition.

A vocabulary beyond ``part_terms`` (32 million, a filter of 128 MB) is taken in parts, one pass each.
Terms held by more than one record in a thousand are few (at most a thousand times the mean number
of terms per record), so they are joined by broadcast, which also keeps a term that a third of the
records hold from becoming one huge join partition; the rest is an ordinary shuffled join.

Cases: null or blank terms and texts count as absent; a record without terms gives no row; rows
repeated under one id count once (the larger frequency of a term holds); ties rank by term.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstone.llm.arrow import batch_of, normalise, normalised_set, pack, unpack
from quillstone.storage import cut

_TERMS = pa.schema([("term", pa.string())])
_OCCURRENCES = pa.schema([("record", pa.int64()), ("term", pa.string()), ("tf", pa.int64()), ("listed", pa.bool_())])
_MODEL = pa.schema([("record", pa.int64()), ("term", pa.string()), ("tf", pa.int64()), ("df", pa.int64()), ("listed", pa.bool_()), ("weight", pa.float64())])

_BASE, _INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
#: characters of a term that are looked up before its rest
HEAD = 4
#: characters that are looked up at a time
CHUNK = 500_000


def vocabulary(books: DataFrame, keywords: str) -> DataFrame:
    """The distinct normalised keywords."""

    def run(batches):
        for batch in batches:
            found = dict.fromkeys(k for ks in batch.column(0).to_pylist() for k in normalised_set(ks))
            yield batch_of({"term": list(found)}, _TERMS)

    return books.select(keywords).mapInArrow(run, "term string").distinct()


def mixed(h: np.ndarray, length: int) -> np.ndarray:
    x = (h ^ np.uint64(length * 0xD6E8FEB86659FD93 % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


class Substrings:
    """Hashes of all substrings of a text, by the differences of the running sums of its characters."""

    def __init__(self, text: str):
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        self.n = len(points)
        power, back = (np.cumprod(np.r_[np.uint64(1), np.full(self.n, np.uint64(x))]) for x in (_BASE, _INVERSE))
        self.sums, self.back = np.r_[np.uint64(0), np.cumsum((points + np.uint64(1)) * power[:-1])], back

    def of(self, start: np.ndarray | slice, length: int) -> np.ndarray:
        """Hashes of the substrings of one length from the given starts, all starts for a slice."""
        if isinstance(start, slice):
            return mixed((self.sums[length:] - self.sums[: self.n + 1 - length]) * self.back[: self.n + 1 - length], length)
        return mixed((self.sums[start + length] - self.sums[start]) * self.back[start], length)


class Bloom:
    """A set of hashes that has all that were added, and few others."""

    def __init__(self, expected: int, bits_each: int, probes: int):
        self.log = max(10, math.ceil(math.log2(max(1, expected * bits_each))))
        self.bits, self.probes = np.zeros(1 << (self.log - 3), np.uint8), [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)][:probes]

    def at(self, x: np.ndarray, probe: np.uint64) -> np.ndarray:
        return ((x * probe) >> np.uint64(64 - self.log)).astype(np.int64)

    def add(self, x: np.ndarray) -> None:
        for probe in self.probes:
            at = self.at(x, probe)
            np.bitwise_or.at(self.bits, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))

    def having(self, x: np.ndarray) -> np.ndarray:
        """Places in ``x`` of those that are in the set."""
        left = np.arange(len(x))
        for probe in self.probes:
            at = self.at(x[left], probe)
            left = left[(self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0]
        return left


class Filter:
    """What a vocabulary leaves of the substrings of a text."""

    def __init__(self, expected: int):
        self.whole, self.heads, self.lengths = Bloom(expected, 32, 3), Bloom(expected, 16, 2), np.empty(0, np.int64)

    def add(self, hashes: np.ndarray, heads: np.ndarray, lengths: np.ndarray) -> None:
        self.whole.add(hashes)
        self.heads.add(heads[lengths > HEAD])
        self.lengths = np.union1d(self.lengths, lengths)

    def occurrences(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, length, hash) of the substrings that may be terms."""
        all_of = Substrings(text)
        out = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64))]
        heads = self.heads.having(all_of.of(slice(None), HEAD)) if all_of.n >= HEAD else np.empty(0, np.int64)
        for length in self.lengths[self.lengths <= all_of.n].tolist():
            some = heads[heads <= all_of.n - length] if length > HEAD else slice(None)
            h = all_of.of(some, length)
            hit = self.whole.having(h)
            out.append((some[hit] if length > HEAD else hit, np.full(len(hit), length), h[hit]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def without_overlap(starts: np.ndarray, length: int) -> int:
    """How many of the sorted starts of one term count, each from the end of the one before."""
    if len(starts) < 2 or (np.diff(starts) >= length).all():
        return len(starts)
    n, end = 0, -1
    for at in starts.tolist():
        if at >= end:
            n, end = n + 1, at + length
    return n


def counts_of(terms: Filter, texts: list[str]) -> list[dict[str, int]]:
    """Of each text the strings that may be terms, and how often each occurs without overlap with itself."""
    found: list[dict[str, int]] = [{} for _ in texts]
    joined = "\n".join(texts)
    owners = np.cumsum([0, *(len(t) + 1 for t in texts)])
    start, length, h = terms.occurrences(joined)
    owner = np.searchsorted(owners, start, "right") - 1
    order = np.lexsort((start, h, owner))
    start, length, h, owner = start[order], length[order], h[order], owner[order]
    edges = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (h[1:] != h[:-1])]) if len(start) else np.empty(0, np.int64)
    for lo, hi in zip(edges.tolist(), [*edges[1:].tolist(), len(start)], strict=False):
        at, n = int(start[lo]), int(length[lo])
        found[owner[lo]][joined[at : at + n]] = without_overlap(start[lo:hi], n)
    return found


def filter_of(terms: DataFrame, n: int) -> Filter:
    """The filter of ``n`` terms; the driver adds up their hashes, and holds a part of them at a time."""
    schema = pa.schema([("hashes", pa.binary())])

    def run(batches):
        for batch in batches:
            words = [t for t in batch.column(0).to_pylist() if t]
            each = [Substrings(t) for t in words]
            lengths = np.array([x.n for x in each], np.int64)
            hashes = np.array([x.of(np.array([0]), x.n)[0] for x in each], np.uint64)
            heads = np.array([x.of(np.array([0]), min(HEAD, x.n))[0] for x in each], np.uint64)
            yield pa.RecordBatch.from_pydict({"hashes": [pack(hashes, heads, lengths)]}, schema=schema)

    out = Filter(n)
    for row in terms.mapInArrow(run, "hashes binary").repartition(max(1, n // 1_000_000)).toLocalIterator():
        out.add(*unpack(bytes(row["hashes"])))
    return out


def term_occurrences(books: DataFrame, id_col: str, keywords: str, text: str, texts: str, part_terms: int = 32_000_000) -> DataFrame:
    """(record, term, tf, listed): the terms of the vocabulary that a record lists or its normalised texts
    hold, and how often these do, as a substring without overlap in each text by itself. A few strings that
    nothing lists may be among them."""
    spark = books.sparkSession
    kept = books.select(
        F.col(id_col).cast("long").alias("record"), F.col(keywords).alias("k"), F.col(text).alias("t"), F.col(texts).alias("ts")
    ).filter("record is not null")
    terms = cut(vocabulary(books, keywords), "vocabulary")
    n = terms.count()
    parts = max(1, math.ceil(n / part_terms))
    found = []
    for part in range(parts):
        mine = lambda hashed, part=part: F.pmod(hashed, F.lit(parts)) == part
        known = spark.sparkContext.broadcast(filter_of(terms.filter(mine(F.xxhash64("term"))), n // parts + 1))

        def run(batches, known=known, first=part == 0):
            for batch in batches:
                records, ks, ts, rest = (batch.column(i).to_pylist() for i in range(4))
                # a line break never survives normalisation, so it separates the texts
                whole = ["\n".join([normalise(t), *map(normalise, xs or ())]) for t, xs in zip(ts, rest, strict=True)]
                sizes = np.cumsum([len(t) for t in whole]) // CHUNK
                edges = [0, *(np.flatnonzero(np.diff(sizes)) + 1).tolist(), len(whole)]
                for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                    out: dict[str, list] = {f.name: [] for f in _OCCURRENCES}
                    for record, own, counts in zip(records[lo:hi], ks[lo:hi], counts_of(known.value, whole[lo:hi]), strict=True):
                        listed = set(normalised_set(own))
                        counts |= {k: 0 for k in listed if first and k not in counts}
                        out["record"] += [record] * len(counts)
                        out["term"] += counts
                        out["tf"] += counts.values()
                        out["listed"] += [k in listed for k in counts]
                    yield batch_of(out, _OCCURRENCES)

        found.append(kept.mapInArrow(run, "record long, term string, tf long, listed boolean"))
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out


def parsimonious(terms: DataFrame, own_share: float = 0.01, rounds: int = 200, least: float = 1e-4) -> DataFrame:
    """(record, term, tf, df, listed, weight) from (record, term, tf, listed); df counts the records that list the term.

    ``own_share`` is the prior share of the record's own model in its text, ``least`` the
    probability under which a term leaves the record's model (weight 0). A listed term counts
    once besides its occurrences.
    """
    held = cut(terms.repartition("record").groupBy("record", "term").agg(F.max("tf").alias("tf"), F.bool_or("listed").alias("listed")), "terms")
    one = F.col("listed").cast("long")
    stats = cut(held.groupBy("term").agg(F.count("*").alias("n"), F.sum(one).alias("df"), F.sum(F.col("tf") + one).alias("cf")).filter("df > 0"), "term-stats")
    all_cf = float(stats.agg(F.sum("cf")).first()[0] or 1)
    records = held.select("record").distinct().count()
    # of terms that more than one record in a thousand holds there are few; they are broadcast
    common = max(1_000, records // 1_000)
    frequent = stats.filter(F.col("n") > common)
    often = held.join(F.broadcast(frequent), "term")
    others = held.join(F.broadcast(frequent.select("term")), "term", "left_anti").join(stats.filter(F.col("n") <= common), "term")
    joined = often.unionByName(others).groupBy("record").agg(F.sort_array(F.collect_list(F.struct("term", "tf", "df", "cf", "listed"))).alias("terms"))

    def run(batches):
        for batch in batches:
            lists = batch.column(1)
            flat = lists.flatten()
            sizes = np.diff(lists.offsets.to_numpy())
            owner = np.repeat(np.arange(len(sizes)), sizes)
            tf, df, cf, listed = (flat.field(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3, 4))
            weight = em(owner, len(sizes), (tf + listed).astype(float), cf / all_cf, own_share, rounds, least)
            record = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), sizes)
            arrays = [pa.array(record, pa.int64()), flat.field(0), pa.array(tf, pa.int64()), pa.array(df, pa.int64()), flat.field(4), pa.array(weight)]
            yield pa.RecordBatch.from_arrays(arrays, schema=_MODEL)

    return joined.mapInArrow(run, "record long, term string, tf long, df long, listed boolean, weight double")


def em(owner: np.ndarray, n: int, tf: np.ndarray, background: np.ndarray, own_share: float, rounds: int, least: float) -> np.ndarray:
    """Converged term probabilities of ``n`` records at once; ``owner`` gives the record of each term. Each
    record stops by itself, so its result is the same whatever it is computed with."""
    total = np.bincount(owner, tf, n)
    p = tf / np.maximum(total, 1e-300)[owner]
    open_ = np.ones(n, bool)
    for _ in range(rounds):
        own = own_share * p
        e = tf * own / (own + (1 - own_share) * background)
        new = e / np.maximum(np.bincount(owner, e, n), 1e-300)[owner]
        new[new < least] = 0.0
        new /= np.maximum(np.bincount(owner, new, n), 1e-300)[owner]
        change = np.zeros(n)
        np.maximum.at(change, owner, np.abs(new - p))
        p = np.where(open_[owner], new, p)
        open_ &= change >= 1e-9
        if not open_.any():
            break
    return p


def distinctive_terms(scored: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` strongest terms of each record, ties by term."""
    w = Window.partitionBy("record").orderBy(F.desc("weight"), "term")
    return scored.filter("weight > 0").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def distinctive_found(scored: DataFrame, least_df: int = 2, most_df: int = 8, least_tf: int = 3) -> DataFrame:
    """Listed terms that stay in the record's model, are listed by few records and repeated in this one."""
    return scored.filter(F.col("listed") & (F.col("weight") > 0) & F.col("df").between(least_df, most_df) & (F.col("tf") >= least_tf))
