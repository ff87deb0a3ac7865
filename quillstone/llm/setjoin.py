"""All similar pairs between set-valued records.

Method: multi-index binary sketches. A set's sketch is a code of one-bit minhashes: bit j is one
bit of the least hash of its elements under the j-th hash function, so two sets with Jaccard
similarity s agree in a bit with probability (1 + s) / 2. The code is cut into segments; pairs
whose codes differ in at most ``flips`` bits of some segment become candidates (each segment is
its own index, its neighbouring buckets are probed in place), the Hamming distance of a check code
of fixed length prunes them, and the original sets decide. The number of segments follows from the
wanted recall at the threshold, by the binomial distribution of the differing bits; width and flips
are those of the least cost in bytes shipped, buckets probed and codes compared.

An index holds an id, a key and the check code: 28 bytes a record and segment, whatever the number of
segments. Their number has to grow with the collection, as in every index of this kind: about as
its power 0.3 (``Plan.record_bytes``: 0.4 kB a record at 54,000 sets, 2.8 kB at 25 million).

Equal sets are collapsed first, so a set held by a third of all records is one record in the
indexes; its copies come back as members of the same class. A segment's index is split by its
leading bits into slices of bounded size, which then have to agree exactly (the recall counts
this); no slice grows with the data.

Cases: null, empty and blank elements are ignored; a record with too few elements takes no part;
repeated rows under one id are one record; the result has every pair once, the smaller id first.
"""

from __future__ import annotations

import hashlib
import math
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.arrow import BLOB, batch_of, blobs, distinct_pairs, flat_pairs, normalised_set, over_slices, pack, partitions_for
from quillstone.storage import cut

_SETS = pa.schema([("record", pa.int64()), ("key", pa.binary()), ("elements", pa.list_(pa.int64()))])
_PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def at_most(k: int, n: int, p: float) -> float:
    """P(X <= k) of a binomial X."""
    return sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))


CHECK_BITS = 128
#: bytes of an index entry: id, key and check code
ENTRY = 8 + 4 + CHECK_BITS // 8


class Plan:
    """Widths and numbers of segments for ``records`` sets, calibrated at the threshold.

    Half the loss that ``recall`` allows is the segments', the rest the check code's radius."""

    def __init__(self, records: int, threshold: float, recall: float = 0.9998, slice_rows: int = 2_000_000):
        differ = (1 - threshold) / 2
        loss = (1 - recall) / 2
        self.fixed = max(0, math.ceil(math.log2(max(1, records / slice_rows))))
        best = math.inf
        for flips in range(4):
            for free in range(max(4, flips + 2), 25):
                hit = (1 - differ) ** self.fixed * at_most(flips, free, differ)
                segments = math.ceil(math.log(loss) / math.log(1 - hit))
                masks = sum(math.comb(free, r) for r in range(flips + 1))
                compared = records / 2**self.fixed * masks / 2**free
                # relative costs of a byte shipped, a bucket probed, two codes compared
                cost = segments * (150 * ENTRY + 12 * masks / 2 + 10 * compared / 2)
                if cost < best:
                    best, self.flips, self.width, self.segments = cost, flips, free + self.fixed, segments
        self.bits = -(-self.segments * self.width // 64) * 64
        #: Hamming distance of check codes beyond which a similar pair lies with a chance below ``loss``
        self.radius = next(r for r in range(CHECK_BITS + 1) if 1 - at_most(r, CHECK_BITS, differ) < loss)
        free = self.width - self.fixed
        self.masks = [0] + [sum(1 << i for i in c) for r in range(1, self.flips + 1) for c in combinations(range(free), r)]

    @property
    def record_bytes(self) -> int:
        """Bytes of a record in all indexes together."""
        return self.segments * ENTRY


def element_hash(element: str) -> int:
    return int.from_bytes(hashlib.blake2b(element.encode(), digest_size=8).digest(), "little", signed=True)


def hashed_sets(df: DataFrame, id_col: str, counted: str, other: str | None, least: int) -> DataFrame:
    """(record, key, elements): sorted element hashes of the union of two normalised list columns, of
    records with at least ``least`` distinct elements in the first; key is equal for equal sets."""
    kept = df.select(F.col(id_col).cast("long"), F.col(counted), F.col(other) if other else F.lit(None).cast("array<string>"))

    def run(batches):
        known: dict[str, int] = {}
        for batch in batches:
            records, keys, elements = [], [], []
            for record, xs, ys in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                first = normalised_set(xs)
                if record is None or len(first) < least:
                    continue
                if len(known) > 200_000:
                    known.clear()
                own = sorted({known.get(x) or known.setdefault(x, element_hash(x)) for x in {*first, *normalised_set(ys)}})
                records.append(record)
                keys.append(hashlib.blake2b(np.array(own, np.int64).tobytes(), digest_size=16).digest())
                elements.append(own)
            yield batch_of({"record": records, "key": keys, "elements": elements}, _SETS)

    return kept.mapInArrow(run, "record long, key binary, elements array<long>").dropDuplicates(["record"])


def one_bit_minhashes(values: np.ndarray, starts: np.ndarray, bits: int, seed: int = 7) -> np.ndarray:
    """(sets, bits / 64) codes as uint64; ``values`` holds the sets' elements one after the other."""
    rng = np.random.default_rng(seed)
    mult = (rng.integers(1, 2**31, bits, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
    add = rng.integers(0, 2**32, bits, dtype=np.uint32)
    v = values.astype(np.uint64)
    v = (((v ^ (v >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)
    h, out = np.empty_like(v), np.empty((bits, len(starts)), dtype=np.uint8)
    for j in range(bits):
        np.multiply(v, mult[j], out=h)
        np.add(h, add[j], out=h)
        least = np.minimum.reduceat(h, starts)
        out[j] = ((least * np.uint32(0x9E3779B1)) >> np.uint32(31)).astype(np.uint8)
    return np.packbits(np.ascontiguousarray(out.T), axis=1, bitorder="little").view(np.uint64)


def segment_keys(codes: np.ndarray, segment: int, width: int) -> np.ndarray:
    """Bits segment * width ... of the codes, as integers."""
    at, shift = divmod(segment * width, 64)
    key = codes[:, at] >> np.uint64(shift)
    if shift + width > 64:
        key = key | (codes[:, at + 1] << np.uint64(64 - shift))
    return (key & np.uint64((1 << width) - 1)).astype(np.int64)


def candidate_pairs(sets: DataFrame, plan: Plan) -> DataFrame:
    """Distinct (a, b) whose codes meet in some segment's index and whose check codes lie within the radius."""
    width, fixed, segments, bits = plan.width, plan.fixed, plan.segments, plan.bits
    free, masks, radius = width - fixed, plan.masks, plan.radius

    def emit(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column(1)
            starts = lists.offsets.to_numpy()[:-1] - lists.offsets.to_numpy()[0]
            codes = one_bit_minhashes(lists.flatten().to_numpy(), starts, CHECK_BITS + bits)
            check, codes = np.ascontiguousarray(codes[:, : CHECK_BITS // 64]), codes[:, CHECK_BITS // 64 :]
            ids = batch.column(0).to_numpy()
            rows = []
            for s in range(segments):
                key = segment_keys(codes, s, width)
                lead, low = key >> free, (key & ((1 << free) - 1)).astype(np.uint32)
                order = np.argsort(lead, kind="stable")
                edges = np.flatnonzero(np.r_[True, np.diff(lead[order]) != 0, True])
                for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                    own = order[lo:hi]
                    rows.append((s << fixed | int(lead[own[0]]), pack(ids[own], low[own], check[own].ravel())))
            yield blobs(rows)

    def join(_, parts):
        ids, low = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
        codes = np.concatenate([p[2] for p in parts]).reshape(len(ids), -1)
        order = np.argsort(low, kind="stable")
        ids, codes, low = ids[order], codes[order], low[order].astype(np.int64)
        bucket = np.concatenate([[0], np.cumsum(np.bincount(low, minlength=1 << free))])
        for mask in masks:
            if mask:
                other = low ^ mask
                start = bucket[other]
                stop = np.where(low < other, bucket[other + 1], start)
            else:
                start, stop = np.arange(1, len(low) + 1), bucket[low + 1]
            for i, j in flat_pairs(start, stop):
                differ = np.bitwise_count(codes[i, 0] ^ codes[j, 0])
                near = differ <= radius
                i, j, differ = i[near], j[near], differ[near]
                for w in range(1, codes.shape[1]):
                    differ = differ + np.bitwise_count(codes[i, w] ^ codes[j, w])
                near = differ <= radius
                if near.any():
                    x, y = ids[i[near]], ids[j[near]]
                    yield batch_of({"a": np.minimum(x, y), "b": np.maximum(x, y)}, _PAIRS)

    slices = segments << fixed
    packed = sets.select("record", "elements").mapInArrow(emit, BLOB)
    found = over_slices(packed, partitions_for(sets.sparkSession, slices), join, "a long, b long")
    return found.distinct()


def similar_sets(df: DataFrame, id_col: str, counted: str, other: str | None = None, least: int = 1, threshold: float = 0.6, recall: float = 0.9998) -> tuple[DataFrame, DataFrame]:
    """Pairs of class representatives (a, b, similarity), and membership (rep, record) of all records."""
    held = cut(hashed_sets(df, id_col, counted, other, least), "sets")
    reps = cut(held.groupBy("key").agg(F.min("record").alias("record"), F.first("elements").alias("elements"), F.count("*").alias("copies")), "set-classes")
    plan = Plan(reps.count(), threshold, recall)
    a = reps.select(F.col("record").alias("a"), F.col("elements").alias("xs"))
    b = reps.select(F.col("record").alias("b"), F.col("elements").alias("ys"))
    both = F.size(F.array_intersect("xs", "ys"))
    pairs = (
        candidate_pairs(reps, plan)
        .join(a, "a")
        .join(b, "b")
        .withColumn("both", both)
        .withColumn("similarity", F.col("both") / (F.size("xs") + F.size("ys") - F.col("both")))
        .filter(F.col("similarity") >= threshold)
        .select("a", "b", "similarity")
    )
    members = held.join(reps.select("key", F.col("record").alias("rep"), "copies"), "key").select("rep", "record", "copies")
    return pairs, members


def links(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """(rep, links) of every class: how many other records each of its records is linked with."""
    size = members.select("rep", "copies").distinct()
    both = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    beside = both.join(size.select(F.col("rep").alias("b"), "copies"), "b").groupBy(F.col("a").alias("rep")).agg(F.sum("copies").alias("beside"))
    return size.join(beside, "rep", "left").select("rep", (F.col("copies") - 1 + F.coalesce("beside", F.lit(0))).alias("links"))


def expanded(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """All pairs of records (a, b) from pairs of representatives and membership."""
    several = members.filter("copies > 1").select("rep", "record")
    within = several.alias("x").join(several.alias("y"), F.expr("x.rep = y.rep and x.record < y.record"))
    within = within.select(F.col("x.record").alias("a"), F.col("y.record").alias("b"))
    held = members.select("rep", "record")
    across = (
        pairs.join(held.select(F.col("rep").alias("a"), F.col("record").alias("ra")), "a")
        .join(held.select(F.col("rep").alias("b"), F.col("record").alias("rb")), "b")
        .select(F.col("ra").alias("a"), F.col("rb").alias("b"))
    )
    return distinct_pairs(within.unionByName(across))
