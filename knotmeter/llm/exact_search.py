"""Exact top-k search by a three-phase uniform threshold.

A score is the sum of partial scores, one for each of a few slices of the vector, and every slice is a list of partial
scores for a query. Phase 1 gathers the head of each list, scores those vectors in full and takes the k-th best as a
cutoff: no score below it can be among the k best. Phase 2 sends the cutoff out: a score that reaches it has a partial
score of at least an equal share in some list, so the entries that reach the share are sufficient. Phase 3 adds
up the scores of these entries and keeps the k best.

The candidates stay where they are stored; the stated queries pass by them in waves of bounded size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from knotmeter.llm.vectors import exact_type, integer_vectors, magnitude, matrices
from knotmeter.session import materialize

#: Lists a score is made of.
SLICES = 4
#: Bytes of the queries of a wave, about: what is broadcast and what the driver holds at once.
WAVE_BYTES = 16 << 20
#: Candidates and queries whose partial scores a task holds at once.
BLOCK = (4096, 512)

_LEAST = -(1 << 62)
_LISTS = "q int, score long"
_FOUND = "q int, score long, vec_id long, row long"


class Queries:
    """The queries of a wave, by the length of their vectors."""

    def __init__(self, rows: pa.Table):
        self.row = rows.column("row").to_numpy()
        self.by_length = matrices(rows.column("ints").combine_chunks())
        self.magnitude = {n: magnitude(x) for n, (_, x) in self.by_length.items()}

    def chunks(self, length: int, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        places, numbers = self.by_length[length]
        for at in range(0, len(places), size):
            yield places[at:at + size], numbers[at:at + size]


def _partial_scores(queries: np.ndarray, vectors: np.ndarray) -> Iterator[np.ndarray]:
    edges = np.linspace(0, vectors.shape[1], SLICES + 1).astype(int)
    for start, end in zip(edges[:-1], edges[1:], strict=True):
        yield queries[:, start:end] @ vectors[:, start:end].T


def _blocks(batches: Iterable[pa.RecordBatch], queries: Queries, size: int) -> Iterator[tuple]:
    """Candidates that have queries of their length: ids, row numbers and vectors in a type that keeps scores exact."""
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            part = batch.slice(at, size)
            ids = part.column("vec_id")
            row = part.column("row").to_numpy()
            for length, (places, numbers) in matrices(part.column("ints")).items():
                if length in queries.by_length:
                    kind = exact_type(length * queries.magnitude[length] * magnitude(numbers))
                    yield length, ids.take(pa.array(places)), row[places], numbers.astype(kind)


def _best(scores: np.ndarray, k: int) -> np.ndarray:
    return scores if scores.shape[1] <= k else np.partition(scores, scores.shape[1] - k, axis=1)[:, -k:]


def _local_lists(get: Callable[[], Queries], k: int, block: tuple[int, int]) -> Callable:
    """Phase 1: for each query, the k best full scores among the heads of this task's lists."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = get()
        best = np.full((len(queries.row), k), _LEAST, np.int64)
        for length, _, row, vectors in _blocks(batches, queries, block[0]):
            for places, numbers in queries.chunks(length, block[1]):
                numbers = numbers.astype(vectors.dtype)
                heads = [
                    np.argpartition(p, len(row) - k, axis=1)[:, -k:] if len(row) > k else np.tile(np.arange(len(row)), (len(p), 1))
                    for p in _partial_scores(numbers, vectors)
                ]
                heads = np.sort(np.concatenate(heads, axis=1), axis=1)
                scores = np.einsum("qd,qhd->qh", numbers, vectors[heads]).astype(np.int64)
                # an entry counts once, and a query is no candidate of its own
                scores[:, 1:][heads[:, 1:] == heads[:, :-1]] = _LEAST
                scores[row[heads] == queries.row[places][:, None]] = _LEAST
                best[places] = _best(np.concatenate([best[places], scores], axis=1), k)
        q, place = np.nonzero(best > _LEAST)
        for at in range(0, len(q), 1 << 16):
            own = slice(at, at + (1 << 16))
            yield pa.record_batch([pa.array(q[own].astype(np.int32)), pa.array(best[q[own], place[own]])], ["q", "score"])

    return run


class _Found:
    """The k best entries of each query in this task: by score, then id (null last), then row."""

    def __init__(self, k: int):
        self.k = k
        self.columns = [np.zeros(0, np.int64) for _ in range(5)]  # query, score, id is null, id, row

    def add(self, *columns: np.ndarray) -> None:
        q, score, null, vec_id, row = [np.concatenate(x) for x in zip(self.columns, columns, strict=True)]
        order = np.lexsort((row, vec_id, null, -score, q))
        q = q[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        order = order[rank < self.k]
        self.columns = [x[order] for x in (np.concatenate(x) for x in zip(self.columns, columns, strict=True))]

    def cutoffs(self, cutoff: np.ndarray) -> np.ndarray:
        """The cutoffs, raised to the k-th score of queries that have so many."""
        q, score = self.columns[:2]
        if len(q) < self.k:
            return cutoff
        last = np.arange(self.k - 1, len(q))
        last = last[q[last] == q[last - self.k + 1]]
        out = cutoff.copy()
        out[q[last]] = np.maximum(out[q[last]], score[last])
        return out


def _sufficient(get: Callable[[], tuple[Queries, np.ndarray]], k: int, block: tuple[int, int]) -> Callable:
    """Phases 2 and 3: entries that reach an equal share of the cutoff in some list, and their full scores."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, cutoff = get()
        found = _Found(k)
        for length, ids, row, vectors in _blocks(batches, queries, block[0]):
            null = ids.is_null().to_numpy(zero_copy_only=False)
            vec_id = ids.fill_null(0).to_numpy()
            for places, numbers in queries.chunks(length, block[1]):
                cut = cutoff[places]
                # rounded up, as partial scores are integers; beyond the type's exact range no entry of this block gets there
                share = (-(-cut // SLICES)).astype(vectors.dtype)
                partial = list(_partial_scores(numbers.astype(vectors.dtype), vectors))
                seen = np.zeros(partial[0].shape, bool)
                for p in partial:
                    seen |= p >= share[:, None]
                q, c = np.nonzero(seen)
                score = sum(p[q, c].astype(np.int64) for p in partial)
                stays = (score >= cut[q]) & (row[c] != queries.row[places][q])
                q, c, score = q[stays], c[stays], score[stays]
                if len(q):
                    found.add(places[q], score, null[c].astype(np.int64), vec_id[c], row[c])
                    cutoff = found.cutoffs(cutoff)
        q, score, null, vec_id, row = found.columns
        for at in range(0, len(q), 1 << 16):
            own = slice(at, at + (1 << 16))
            columns = [pa.array(q[own].astype(np.int32)), pa.array(score[own]), pa.array(vec_id[own], mask=null[own] == 1), pa.array(row[own])]
            yield pa.record_batch(columns, ["q", "score", "vec_id", "row"])

    return run


def top_k(embeddings: DataFrame, every: int = 20, k: int = 20, scale: int = 64, wave_bytes: int = WAVE_BYTES, block: tuple[int, int] = BLOCK) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k best candidates of every row whose vec_id divides by ``every``.

    Candidates are all rows but the query's own; ties go to the smaller vec_id, null last. Vectors that are null or
    hold null or non-finite components take no part. Vectors of different lengths have no product
    and are not each other's candidates; empty ones score 0. Rows that share a vec_id are queries and candidates of
    their own. Scores that do not fit a long raise an OverflowError.

    The queries go round in waves of about ``wave_bytes``, dealt by hash: only a wave, and a cutoff for each of its queries,
    is ever broadcast or held by the driver. Vectors are never shuffled.
    """
    spark = embeddings.sparkSession
    stored = materialize(integer_vectors(embeddings, scale))
    queries = stored.where(F.pmod("vec_id", F.lit(every)) == 0)
    n, length = queries.agg(F.count("*"), F.max(F.size("ints"))).first()
    waves = -(-n * (8 * (length or 0) + 16) // wave_bytes)
    parts = [_wave(stored, queries.where(F.pmod(F.xxhash64("row"), F.lit(waves)) == w), k, block) for w in range(waves)]
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return reduce(DataFrame.union, parts)


def _wave(stored: DataFrame, wave: DataFrame, k: int, block: tuple[int, int]) -> DataFrame:
    context = stored.sparkSession.sparkContext
    rows = wave.select("row", "vec_id", "ints").toArrow()
    queries = context.broadcast(Queries(rows))
    # phase 1
    lists = stored.select("row", "vec_id", "ints").mapInArrow(_local_lists(lambda: queries.value, k, block), _LISTS)
    by_score = Window.partitionBy("q").orderBy(F.col("score").desc())
    kth = lists.withColumn("n", F.row_number().over(by_score)).where(F.col("n") == k).select("q", "score").toArrow()
    cutoff = np.full(rows.num_rows, _LEAST, np.int64)
    cutoff[kth.column("q").to_numpy()] = kth.column("score").to_numpy()
    cutoffs = context.broadcast(cutoff)
    # phases 2 and 3
    entries = stored.select("row", "vec_id", "ints").mapInArrow(_sufficient(lambda: (queries.value, cutoffs.value), k, block), _FOUND)
    best = Window.partitionBy("q").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last(), "row")
    ranked = entries.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    named = stored.sparkSession.createDataFrame(
        pa.table({"q": pa.array(np.arange(rows.num_rows, dtype=np.int32)), "query_id": rows.column("vec_id")})
    )
    out = materialize(ranked.join(F.broadcast(named), "q").select("query_id", "rank", "vec_id", "score"))
    queries.unpersist()
    cutoffs.unpersist()
    return out
