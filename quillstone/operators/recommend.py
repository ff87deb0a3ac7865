"""Recommendations for a target book, for many targets, and over a grid of penalties."""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.config import Scoring
from quillstone.operators.ranking import rank, with_utility
from quillstone.operators.similarity import overlap_coefficient
from quillstone.storage import cut

META = ["title", "rating", "publication_date", "cover_image", "publisher", "domain_tags"]
DIGITS = 6
ROUNDED = ["semantic_similarity", "keyword_similarity", "combined_similarity", "final_score"]


def rounded(df: DataFrame, columns: list[str]) -> DataFrame:
    """Scores at six decimals, before any order is taken, so that orders are reproducible."""
    return df.withColumns({c: F.round(c, DIGITS) for c in columns})


_INPUT = ["book_id", "embedding", "keywords_embeddings", "domain_tags"]
_SCORES = "semantic_similarity double, keyword_similarity double, sim_avg double, sim_max double, overlap_count int, overlap_coefficient double, combined_similarity double, final_score double"


def _unit(v: np.ndarray) -> np.ndarray | None:
    """The vector at length one; None for an empty one, a non-finite number, or zeros."""
    norm = np.sqrt(v @ v) if len(v) and np.isfinite(v).all() else 0.0
    return v / norm if norm > 0 else None


def _spans(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """First and last position of every list in the values; a null list is empty."""
    offsets = lists.offsets.to_numpy().astype(np.int64)
    start, stop = offsets[:-1], offsets[1:].copy()
    missing = lists.is_null().to_numpy(zero_copy_only=False)
    stop[missing] = start[missing]
    return start, stop


def batch_features(batch: pa.RecordBatch) -> list[dict]:
    """What pair scores need of the books of a batch of _INPUT, as NumPy arrays read from its buffers (a
    null number is NaN); the rules are those of quillstone.operators.similarity."""
    vectors, matrices = batch.column(1), batch.column(2)
    numbers = vectors.values.to_numpy(zero_copy_only=False).astype(np.float64)
    inner = matrices.values
    inner_numbers = inner.values.to_numpy(zero_copy_only=False).astype(np.float64)
    (v0, v1), (m0, m1), (i0, i1) = _spans(vectors), _spans(matrices), _spans(inner)
    found = []
    for k, (book_id, tags) in enumerate(zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), strict=True)):
        units = mean = None
        first, last = m0[k], m1[k]
        if last > first:
            sizes = i1[first:last] - i0[first:last]
            if sizes[0] > 0 and (sizes == sizes[0]).all():
                matrix = inner_numbers[i0[first] : i1[last - 1]].reshape(len(sizes), -1)
                if np.isfinite(matrix).all():
                    norms = np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
                    units, mean = matrix / np.where(norms > 0, norms, 1.0), _unit(matrix.mean(axis=0))
        own = {t for t in tags or () if t is not None}
        found.append({"book_id": book_id, "unit": _unit(numbers[v0[k] : v1[k]]), "kw_mean": mean, "kw_units": units, "tags": own})
    return found


def candidates(books: DataFrame, target: int | Column, scoring: Scoring = Scoring()) -> DataFrame:
    """All other books scored against the target; empty for an unknown target.

    The target is one row and travels with the plan; the catalogue streams through in Arrow batches
    and each batch is scored by matrix products. There is no join and no shuffle."""
    kept = list(dict.fromkeys(["book_id", *META]))
    given = books.select(*kept, "embedding", "keywords_embeddings")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema.fields[: len(kept)]) + f", {_SCORES}"
    found = books.filter(F.col("book_id") == target).select(*_INPUT).limit(1).toArrow()
    if not found.num_rows:
        return rounded(books.sparkSession.createDataFrame([], schema), ROUNDED)
    one = batch_features(found.combine_chunks().to_batches()[0])

    def run(batches):
        for batch in batches:
            s = block_scores(one, batch_features(batch.select(_INPUT)), scoring)
            columns = [batch.column(c) for c in kept]
            values = [s["semantic"][0], s["keyword"][0], s["mean"][0], s["best"][0], s["shared"][0].astype(np.int32), s["coefficient"][0], s["combined"][0], (s["combined"] * s["coefficient"])[0]]
            names = [x.split()[0] for x in _SCORES.split(", ")]
            yield pa.RecordBatch.from_arrays([*columns, *map(pa.array, values)], names=[*kept, *names])

    others = given.filter(F.col("book_id") != one[0]["book_id"])
    return rounded(others.mapInArrow(run, schema), ROUNDED)


def top(scored: DataFrame, k: int) -> DataFrame:
    return scored.orderBy(F.desc("final_score"), "book_id").limit(k)


def recommend(
    books: DataFrame,
    target: int | Column,
    k: int = 10,
    mode: str = "comprehensive",
    as_of: str = "2026-01-01",
    scoring: Scoring = Scoring(),
    cross_domain: bool = True,
    strict: bool = False,
    parity: bool = False,
) -> DataFrame:
    """The k best books in a mode's order, out of the 2k best by final score.

    ``cross_domain`` keeps books whose overlap leaves something of the score, ``strict`` those that
    share no tag at all. Both limits stay: the mode only sees the 2k that retrieval found."""
    scored = candidates(books, target, scoring)
    if cross_domain:
        scored = scored.filter(F.col("overlap_count") == 0 if strict else F.col("overlap_coefficient") > 0)
    found = with_utility(top(scored, 2 * k), as_of, parity and not cross_domain)
    return rank(rounded(found, ["utility_score"]), mode, k)


def beta_sweep(books: DataFrame, target: int | Column, betas: list[float], k: int = 6, scoring: Scoring = Scoring()) -> DataFrame:
    """(beta, position, book_id, final_score): the k best for every penalty of the grid.

    Similarities are computed once; the grid multiplies candidates that are already scored."""
    scored = candidates(books, target, scoring).select("book_id", "combined_similarity", "overlap_count", "overlap_coefficient")
    grid = books.sparkSession.createDataFrame([(float(b),) for b in betas], "beta double")
    each = scored.crossJoin(F.broadcast(grid))
    coefficient = overlap_coefficient(F.col("overlap_count"), F.lit(False), F.col("beta"))
    final = F.round(F.col("combined_similarity") * coefficient, DIGITS)
    each = each.filter(coefficient > 0).select("beta", "book_id", final.alias("final_score"))
    w = Window.partitionBy("beta").orderBy(F.desc("final_score"), "book_id")
    return each.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= k)


def domain_distribution(rows: DataFrame) -> DataFrame:
    """(tag, n) of the rows' tags, largest first."""
    return rows.select(F.explode("domain_tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tag")


def response_metadata(rows: DataFrame, scoring: Scoring) -> DataFrame:
    """One row: number of candidates and the effective penalty."""
    return rows.agg(F.count("*").alias("total_candidates")).withColumn("beta", F.lit(scoring.beta))


_BLOCK = pa.schema([("block", pa.int64()), ("data", pa.binary())])


def _cosines(a: list, b: list) -> np.ndarray:
    """Inner products of two lists of unit vectors, 0 for missing ones and different lengths."""
    out = np.zeros((len(a), len(b)))
    for n in {len(v) for v in a if v is not None} & {len(v) for v in b if v is not None}:
        i, j = ([k for k, v in enumerate(vs) if v is not None and len(v) == n] for vs in (a, b))
        out[np.ix_(i, j)] = np.array([a[k] for k in i]) @ np.array([b[k] for k in j]).T
    return out


def _best_pairs(a: list, b: list) -> np.ndarray:
    """Largest inner product between the vectors of two books, never below 0."""
    out = np.zeros((len(a), len(b)))
    for n in {m.shape[1] for m in a if m is not None} & {m.shape[1] for m in b if m is not None}:
        has = [k for k, m in enumerate(b) if m is not None and m.shape[1] == n]
        units = np.concatenate([b[k] for k in has])
        starts = np.r_[0, np.cumsum([len(b[k]) for k in has])[:-1]]
        for i, m in enumerate(a):
            if m is not None and m.shape[1] == n:
                out[i, has] = np.maximum(np.maximum.reduceat((m @ units.T).max(axis=0), starts), 0.0)
    return out


#: bytes of query books that travel to the tasks at once
ROUND_BYTES = 64 << 20


def batch_topk(books: DataFrame, queries: Column, k: int = 10, scoring: Scoring = Scoring(), block: int = 1_024, round_bytes: int = ROUND_BYTES) -> DataFrame:
    """(book_id, neighbour_id, final_score, position): the k best cross-domain books for every query book.

    A stated query set against all rows, in rounds: query books are packed into blocks, and as many blocks
    as fit ``round_bytes`` are broadcast; the catalogue streams past them once per round, scores are
    matrix products, and only k rows per query and batch leave it. No pair is ever a row, and the driver
    holds one round's blocks."""
    feats = books.select(*_INPUT)

    def packed(batches):
        for batch in batches:
            rows = batch_features(batch)
            for lo in range(0, len(rows), block):
                some = rows[lo : lo + block]
                yield pa.RecordBatch.from_pydict({"block": [some[0]["book_id"]], "data": [pickle.dumps(some)]}, schema=_BLOCK)

    asked = cut(feats.filter(queries).mapInArrow(packed, "block long, data binary"), "query-blocks")
    schema = pa.schema([("book_id", pa.int64()), ("neighbour_id", pa.int64()), ("final_score", pa.float64())])

    w = Window.partitionBy("book_id").orderBy(F.desc("final_score"), "neighbour_id")

    def one_round(some: list[bytes], last: bool) -> DataFrame:
        shared = books.sparkSession.sparkContext.broadcast(some)

        def score(batches):
            blocks = [pickle.loads(b) for b in shared.value]
            for batch in batches:
                rows = batch_features(batch)
                for lo in range(0, len(rows), block):
                    for q in blocks:
                        yield _score_block(q, rows[lo : lo + block], k, scoring, schema)

        found = feats.mapInArrow(score, "book_id long, neighbour_id long, final_score double")
        if not last:
            found = cut(found.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= k).drop("position"), "round")
            shared.destroy()
        return found

    rounds, held, size = [], [], 0
    for row in asked.select("data").toLocalIterator():
        if held and size + len(row["data"]) > round_bytes:
            rounds.append(one_round(held, False))
            held, size = [], 0
        held.append(bytes(row["data"]))
        size += len(row["data"])
    best = one_round(held, True)
    for other in rounds:
        best = best.unionByName(other)
    return best.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= k)


def block_scores(queries: list[dict], rows: list[dict], scoring: Scoring) -> dict[str, np.ndarray]:
    """(queries, rows) matrices of all pair scores."""
    semantic, mean, best = (
        f([r[c] for r in queries], [r[c] for r in rows]) for f, c in ((_cosines, "unit"), (_cosines, "kw_mean"), (_best_pairs, "kw_units"))
    )
    at = {t: i for i, t in enumerate(sorted({t for r in queries for t in r["tags"]}))}

    def one_hot(some):
        out = np.zeros((len(some), max(1, len(at))), np.float32)
        for i, r in enumerate(some):
            out[i, [at[t] for t in r["tags"] if t in at]] = 1
        return out

    shared = np.rint(one_hot(queries) @ one_hot(rows).T).astype(int)
    coefficient = np.select([shared == 0, shared == 1, shared == 2], [1.0, 1 - scoring.beta, 1 - 2 * scoring.beta], 0.0)
    keyword = scoring.alpha * mean + (1 - scoring.alpha) * best
    combined = scoring.a * semantic + (1 - scoring.a) * keyword
    return {"semantic": semantic, "mean": mean, "best": best, "keyword": keyword, "shared": shared, "coefficient": coefficient, "combined": combined}


def _score_block(queries: list[dict], rows: list[dict], k: int, scoring: Scoring, schema: pa.Schema) -> pa.RecordBatch:
    ids, q_ids = np.array([r["book_id"] for r in rows]), np.array([r["book_id"] for r in queries])
    s = block_scores(queries, rows, scoring)
    final = np.round(s["combined"] * s["coefficient"], DIGITS)
    final[(s["coefficient"] <= 0) | (q_ids[:, None] == ids[None, :])] = -np.inf
    out: dict[str, list] = {"book_id": [], "neighbour_id": [], "final_score": []}
    for i in range(len(queries)):
        order = np.lexsort((ids, -final[i]))[:k]
        order = order[np.isfinite(final[i][order])]
        out["book_id"] += [int(q_ids[i])] * len(order)
        out["neighbour_id"] += ids[order].tolist()
        out["final_score"] += final[i][order].tolist()
    return pa.RecordBatch.from_pydict(out, schema=schema)
