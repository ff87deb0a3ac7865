"""Mixing sources to target weights.

Method: soft-membership mixing. Each document belongs to the domains (sources) with a posterior: a
document whose source has a target belongs to it, since its domain is known; one without a source
gets the posteriors of a classifier trained on the labelled table, all documents with a source; one
of a source without a target takes no part. Posteriors are kept in steps of 1/64. Sizes are tokens of
a public tokenizer. Nonnegative document rates are fitted by projected-gradient least squares, so that
the expected tokens of each domain meet its target: a step moves every rate along its domains'
residuals, scaled by the domains' sizes, and projects it back between zero and the expected repeat
cap of its domains.

The gradient is distributed: a rate is a function of the posterior and of the residuals so far, a few
numbers, so the documents are added up once to a table of posteriors with their tokens, and each
round is a pass over that table which returns one total per domain. Neither rates nor documents come
to the driver. At most ``rounds`` rounds are made; the residual left is reported.

The total to mix is the largest at which every target with documents can be met within its cap, or
the caller's. Targets without documents are reported with what they reach, and their share goes to
the others in proportion. Rates become whole copies: the integer part for all, one more for the
documents whose hash falls under a threshold, which is placed, per domain, where the copies' tokens
come nearest to the target.

Cases: sources are compared in one notation (case, spaces and hyphens aside); null and empty texts
have no tokens and no copies; repeated rows under one id are one document; duplicate target rows add
up; null targets count as zero and a null cap as one.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.arrow import BLOB, blobs, normalise, pack, summed, unpack
from quillstone.llm.encode import token_counts
from quillstone.storage import cut

FEATURES = 1 << 14
BINS = 4_096
STEPS = 64
TEMPERATURES = (0.01, 0.02, 0.05, 0.1, 0.2, 0.5, 1.0)


def source_key(column: str):
    return F.regexp_replace(F.lower(F.trim(column)), r"[\s\-]+", "_")


def features(text: str) -> np.ndarray:
    """Slots of the distinct character trigrams and of the length of a text."""
    t = f" {normalise(text)} "
    points = np.frombuffer(t.encode("utf-32-le"), np.uint32).astype(np.uint64)
    h = points[:-2] * np.uint64(0x9E3779B97F4A7C15) ^ points[1:-1] * np.uint64(0xBF58476D1CE4E5B9) ^ points[2:] * np.uint64(0x94D049BB133111EB)
    grams = np.unique(((h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(50)).astype(np.int64)
    return np.append(grams % (FEATURES - 64), FEATURES - 64 + min(63, int(4 * math.log2(len(t)))))


class Classifier:
    """Naive Bayes over hashed features with a temperature fitted on held-out documents."""

    def __init__(self, counts: np.ndarray, documents: np.ndarray):
        smooth = counts + 0.5
        self.logs = np.log(smooth / (documents[:, None] + 1.0))
        # a domain without documents is never a document's domain
        self.prior = np.where(documents > 0, np.log(np.maximum(documents, 1) / max(1.0, documents.sum())), -1e9)
        self.temperature = 1.0

    def logits(self, text: str) -> np.ndarray:
        return self.logs[:, features(text)].sum(axis=1)

    def posterior(self, text: str, temperature: float | None = None) -> np.ndarray:
        z = self.prior + (self.temperature if temperature is None else temperature) * self.logits(text)
        e = np.exp(z - z.max())
        return e / e.sum()


def column_sums(df: DataFrame, of, width: int) -> np.ndarray:
    """The sum over all batches of the vectors of ``width`` numbers that ``of(batch)`` gives."""
    names = [f"x{i}" for i in range(width)]

    def run(batches):
        total = np.zeros(width)
        for batch in batches:
            if batch.num_rows:
                total += of(batch)
        yield pa.RecordBatch.from_pydict({n: [x] for n, x in zip(names, total.tolist(), strict=True)})

    row = df.mapInArrow(run, ", ".join(f"{n} double" for n in names)).agg(*[F.sum(n) for n in names]).first()
    return np.array([x or 0.0 for x in row])


def train(labelled: DataFrame, classes: int) -> Classifier:
    """Classifier of (held, label, text): counts over all documents that are not held out, in one pass, added
    up by label in a tree; the driver gets one row of counts per label."""

    def count(batches):
        counts, documents = np.zeros((classes, FEATURES)), np.zeros(classes)
        for batch in batches:
            for held, label, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if not held:
                    documents[label] += 1
                    counts[label, features(text)] += 1
        yield blobs([(i, pack(counts[i].astype(np.float32), documents[i : i + 1])) for i in np.flatnonzero(documents).tolist()])

    counts, documents = np.zeros((classes, FEATURES)), np.zeros(classes)
    for row in summed(labelled.mapInArrow(count, BLOB)).collect():
        counts[row["slice"]], (documents[row["slice"]],) = unpack(bytes(row["blob"]))
    model = Classifier(counts, documents)
    shared = labelled.sparkSession.sparkContext.broadcast(model)

    def losses(batch):
        total = np.zeros(len(TEMPERATURES))
        for label, text in zip(*(batch.column(i).to_pylist() for i in (1, 2)), strict=True):
            z = shared.value.logits(text)
            for i, t in enumerate(TEMPERATURES):
                s = shared.value.prior + t * z
                total[i] += np.logaddexp.reduce(s) - s[label]
        return total

    loss = column_sums(labelled.filter("held"), losses, len(TEMPERATURES))
    model.temperature = TEMPERATURES[int(np.argmin(loss))]
    return model


def in_steps(posterior: np.ndarray) -> np.ndarray:
    """The posterior in multiples of 1 / STEPS that add up to one, nearest below with the rest to the largest remainders."""
    scaled = posterior * STEPS
    whole = np.floor(scaled)
    rest = int(round(STEPS - whole.sum()))
    whole[np.argsort(whole - scaled, kind="stable")[:rest]] += 1
    return whole / STEPS


class Mixer:
    """What the rates depend on: targets, caps, domain sizes and the residuals so far."""

    def __init__(self, caps: np.ndarray, sizes: np.ndarray, goal: np.ndarray):
        self.caps, self.sizes, self.goal, self.steps = caps, np.maximum(sizes, 1e-9), goal, []
        self.residual = 0.0

    def rates(self, member: np.ndarray) -> np.ndarray:
        """Rates of documents with these posteriors: the steps so far, projected one by one."""
        most = member @ self.caps
        rate = np.zeros(len(member))
        for step in self.steps:
            rate = np.clip(rate + member @ step, 0.0, most)
        return rate

    def add(self, totals: np.ndarray) -> float:
        """Take a step from the domains' totals; returns the largest residual against its goal."""
        residual = self.goal - totals
        self.steps.append(np.where(self.goal > 0, residual, -totals) / self.sizes)
        self.residual = float(np.max(np.abs(residual) / np.maximum(self.goal, 1.0)))
        return self.residual


def mix(documents: DataFrame, targets: DataFrame, total: float | None = None, rounds: int = 30, rank_file: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(doc_id, source, n_tokens, rate, copies) of every document, and the shares reached:
    (source, target_share, max_repeats, documents, available, tokens, share, own_share, expected, residual, rounds).

    documents, available and tokens are those of the source's own documents, own_share the share of their
    tokens; share also counts the tokens of documents without a source, by their posteriors. residual is
    what the fit's largest miss is against its target after ``rounds`` steps."""
    spark = documents.sparkSession
    wanted = targets.filter("source is not null").groupBy(source_key("source").alias("source"))
    wanted = wanted.agg(F.sum(F.coalesce("target_share", F.lit(0.0))).alias("share"), F.max(F.coalesce("max_repeats", F.lit(1))).alias("cap"))
    rows = wanted.orderBy("source").collect()  # one row per target
    names, share, caps = [r["source"] for r in rows], np.array([r["share"] for r in rows]), np.array([float(r["cap"]) for r in rows])
    k = len(names)
    label = F.array_position(F.array(*[F.lit(n) for n in names]).cast("array<string>"), F.col("source")) - 1
    keyed = documents.dropDuplicates(["doc_id"]).select("doc_id", "text", source_key("source").alias("source"))
    sized = token_counts(keyed.withColumn("label", F.coalesce(F.when(F.col("source") == "", None).otherwise(label), F.lit(-1)).cast("int")).withColumn("body", F.col("text")), "text", ["doc_id", "source", "label", "body"], rank_file)
    sized = cut(sized, "sized")

    held = F.pmod(F.xxhash64("doc_id"), F.lit(10)) == 0
    labelled = sized.filter("label >= 0 and body is not null").select(held.alias("held"), "label", F.col("body").alias("text"))
    unknown = sized.filter("(source is null or source = '') and n_tokens > 0")
    soft = bool(k) and bool(unknown.head(1))
    model = spark.sparkContext.broadcast(train(labelled, k) if soft else None)

    member_schema = "doc_id long, source string, label int, n_tokens long, member array<double>"

    def belong(batches):
        for batch in batches:
            ids, sources, labels, bodies, sizes = (batch.column(i) for i in range(5))
            member = []
            for source, at, body, n in zip(sources.to_pylist(), labels.to_pylist(), bodies.to_pylist(), sizes.to_pylist(), strict=True):
                if at >= 0:
                    member.append(np.eye(k)[at])
                elif source in (None, "") and n and model.value is not None:
                    member.append(in_steps(model.value.posterior(body)))
                else:
                    member.append(np.zeros(k))
            flat = np.concatenate(member) if member else np.empty(0)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(member) + 1) * k, pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([ids, sources, labels, sizes, lists], names=["doc_id", "source", "label", "n_tokens", "member"])

    belonging = cut(sized.mapInArrow(belong, member_schema), "members")
    cells = cut(belonging.groupBy("member").agg(F.sum("n_tokens").cast("double").alias("tokens")), "cells")

    def totals(of, rows: DataFrame) -> np.ndarray:
        """Tokens per domain of (member, tokens) at the rates ``of`` memberships (None: one each)."""

        def run(batch):
            member = batch.column(0).flatten().to_numpy().reshape(-1, k)
            return ((of(member) if of else 1.0) * batch.column(1).to_numpy()) @ member

        return column_sums(rows.select("member", "tokens"), run, k)

    if not k:
        empty = belonging.select("doc_id", "source", "n_tokens", F.lit(0.0).alias("rate"), F.lit(0).alias("copies"))
        reached = wanted.select("source", F.col("share").alias("target_share"), F.col("cap").alias("max_repeats"), *[F.lit(0).alias(c) for c in ("documents", "available", "tokens")], *[F.lit(0.0).alias(c) for c in ("share", "own_share", "expected", "residual")], F.lit(0).alias("rounds"))
        return empty, reached
    sizes = totals(None, cells)
    there = (sizes > 0) & (share > 0)
    share_there = np.where(there, share, 0.0)
    share_there = share_there / max(share_there.sum(), 1e-12)
    if total is None:
        total = float(np.min(caps[there] * sizes[there] / share_there[there])) if there.any() else 0.0
    mixer = Mixer(caps, sizes, share_there * total)
    for _ in range(rounds):
        now = totals(mixer.rates, cells) if mixer.steps else np.zeros(k)
        if mixer.add(now) < 1e-6:
            mixer.steps.pop()
            break
    plan = spark.sparkContext.broadcast(mixer)

    rated_schema = "doc_id long, source string, label int, n_tokens long, rate double, whole int, part double, spot double, member array<double>"

    def rated(batches):
        for batch in batches:
            member = batch.column(4).flatten().to_numpy().reshape(-1, k)
            rate = np.round(plan.value.rates(member), 9)
            ids = batch.column(0).to_numpy()
            spot = ((ids.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)) ^ np.uint64(0x94D049BB133111EB)
            spot = ((spot ^ (spot >> np.uint64(31))) * np.uint64(0x94D049BB133111EB) >> np.uint64(11)) / 2.0**53
            arrays = [*batch.columns[:4], pa.array(rate), pa.array(np.floor(rate).astype(np.int32)), pa.array(rate - np.floor(rate)), pa.array(spot), batch.column(4)]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "source", "label", "n_tokens", "rate", "whole", "part", "spot", "member"])

    chosen = belonging.mapInArrow(rated, rated_schema)
    # tokens by domain and bin of spot: where the extra copies' tokens come nearest to what is missing
    bins = chosen.filter("part > 0").groupBy("label", F.floor(F.col("spot") * BINS).cast("int").alias("bin")).agg(F.sum("n_tokens").alias("tokens"), F.sum(F.col("part") * F.col("n_tokens")).alias("missing"))
    table: dict[int, tuple[np.ndarray, float]] = {}
    for r in bins.collect():  # at most BINS rows per target
        tokens, missing = table.get(r["label"], (np.zeros(BINS), 0.0))
        tokens[r["bin"]] += r["tokens"]
        table[r["label"]] = (tokens, missing + r["missing"])
    limits = [(at, int(np.argmin(np.abs(np.concatenate([[0], np.cumsum(tokens)]) - missing)))) for at, (tokens, missing) in sorted(table.items())]
    limit = F.broadcast(spark.createDataFrame(limits or [(-2, 0)], "label int, upto int"))
    extra = (F.col("part") > 0) & (F.floor(F.col("spot") * BINS) < F.coalesce("upto", F.lit(0)))
    copies = F.when(F.col("n_tokens") > 0, F.col("whole") + extra.cast("int")).otherwise(0)
    mixed = cut(chosen.join(limit, "label", "left").select("doc_id", "source", "label", "n_tokens", "rate", copies.alias("copies"), "member"), "mixed")

    used = mixed.filter("copies > 0").groupBy("member").agg(F.sum(F.col("n_tokens") * F.col("copies")).cast("double").alias("tokens"))
    soft_shares, own_fit = (x / max(1e-9, float(x.sum())) for x in (totals(None, used), totals(mixer.rates, cells)))
    numbers = [(n, float(s), float(e), round(mixer.residual, 9), len(mixer.steps)) for n, s, e in zip(names, soft_shares, own_fit, strict=True)]
    numbers = spark.createDataFrame(numbers, "source string, reached double, expected double, residual double, rounds int")
    got = mixed.filter("label >= 0").groupBy("source").agg(
        F.count("*").alias("documents"), F.sum("n_tokens").alias("available"), F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens")
    )
    whole = got.agg(F.greatest(F.sum("tokens"), F.lit(1)).alias("all"))
    reached = (
        wanted.join(got, "source", "left")
        .join(F.broadcast(numbers), "source")
        .crossJoin(F.broadcast(whole))
        .select(
            "source",
            F.col("share").alias("target_share"),
            F.col("cap").alias("max_repeats"),
            *[F.coalesce(c, F.lit(0)).alias(c) for c in ("documents", "available", "tokens")],
            F.round("reached", 6).alias("share"),
            F.round(F.coalesce(F.col("tokens") / F.col("all"), F.lit(0.0)), 6).alias("own_share"),
            F.round("expected", 6).alias("expected"),
            "residual",
            "rounds",
        )
    )
    return mixed.select("doc_id", "source", "n_tokens", "rate", "copies"), reached
