"""Best-fit packing: dominance reduction after Martello and Toth, then best fit of the rest.

Lengths are whole numbers up to the capacity, so an instance of any number of documents is a table of at
most ``capacity`` counts. The plan is made on that table and says which ranks of each length go
where; the pieces find their places by a join on length and rank.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotmeter.llm.common import ranked
from knotmeter.llm.tokens import encoded
from knotmeter.session import materialize

RUNS = "length long, first_rank long, end_rank long, copies long, sequence long, place long"


def token_pieces(docs: DataFrame, capacity: int = 2048, tokenizer: str | None = None, end_id: int = 0) -> DataFrame:
    """``doc_id, piece, start, length, ids``: the pieces of each document's ids, ``end_id`` last.

    A document of at most ``capacity`` ids is one piece. A longer one is cut from its end into pieces of
    ``capacity`` ids, so that only the first can be shorter. ``ids`` is binary, little-endian
    unsigned 32-bit. A null text counts as empty: one piece with ``end_id`` alone.
    """

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in encoded(batches, tokenizer, end_id):
            doc_ids = batch.column(0).to_pylist()
            rows = []
            for doc_id, ids in zip(doc_ids, texts, strict=True):
                head = len(ids) % capacity or min(len(ids), capacity)
                for piece, end in enumerate(range(head, len(ids) + 1, capacity)):
                    start = max(0, end - capacity) if piece else 0
                    rows.append((doc_id, piece, start, end - start, ids[start:end].tobytes()))
            columns = zip(*rows, strict=True)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
            yield pa.record_batch([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)],
                                  ["doc_id", "piece", "start", "length", "ids"])

    narrow = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return narrow.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids binary")


class Plan:
    """Runs of equal pieces: ranks ``[first_rank, end_rank)`` of a length, ``copies`` to a sequence."""

    def __init__(self, capacity: int, counts: dict[int, int]):
        self.capacity = capacity
        self.left = dict(counts)
        self.used = dict.fromkeys(counts, 0)
        self.sequences = 0
        self.runs: list[tuple[int, int, int, int, int, int]] = []

    def put(self, length: int, bins: int, copies: int, sequence: int, place: int) -> None:
        n = bins * copies
        at = self.used[length]
        self.runs.append((length, at, at + n, copies, sequence, place))
        self.used[length] += n
        self.left[length] -= n

    def open(self, bins: int) -> int:
        self.sequences += bins
        return self.sequences - bins

    def reduce(self) -> None:
        """Fixes the sets that dominate every other set with the same largest piece.

        With room r beside a piece, let k be the longest that fits. The pair is at least as good as
        any other set when nothing fits, when k fills r, when no two pieces fit into r, or when
        no three do and no two that fit are together longer than k: what would stand beside
        the piece can take k's place elsewhere. Such sequences are closed.
        """
        for length in sorted(self.left, reverse=True):
            while self.left[length]:
                room = self.capacity - length
                self.left[length] -= 1  # the piece itself is no partner
                sizes = np.array(sorted(x for x, n in self.left.items() if n and x <= room), int)
                spare = np.array([self.left[x] for x in sizes], int)
                self.left[length] += 1
                if not len(sizes):
                    bins = self.left[length]
                    self.put(length, bins, 1, self.open(bins), 0)
                    break
                partner = int(sizes[-1])
                if partner != room and not self._dominates(sizes, spare, partner, room):
                    break
                if partner == length:
                    bins = self.left[length] // 2
                    self.put(length, bins, 2, self.open(bins), 0)
                else:
                    bins = min(self.left[length], self.left[partner])
                    sequence = self.open(bins)
                    self.put(length, bins, 1, sequence, 0)
                    self.put(partner, bins, 1, sequence, length)

    @staticmethod
    def _dominates(sizes: np.ndarray, spare: np.ndarray, partner: int, room: int) -> bool:
        least = np.repeat(sizes[:3], np.minimum(spare[:3], 3))[:3]
        if len(least) < 2 or least[0] + least[1] > room:
            return True
        if len(least) == 3 and least.sum() <= room:
            return False
        # the longest pair that fits: for each piece the longest other one in what it leaves
        mate = np.searchsorted(sizes, room - sizes, side="right") - 1
        itself = (mate == np.arange(len(sizes))) & (spare < 2)
        mate = np.where(itself, mate - 1, mate)
        pairs = np.where(mate >= 0, sizes + sizes[np.maximum(mate, 0)], 0)
        return int(pairs.max()) <= partner

    def best_fit(self) -> None:
        """Longest first, each into the open sequences with the least room that takes it.

        Sequences with equal room are handled together: ``(room, sequence, bins)``.
        """
        open_: list[tuple[int, int, int]] = []
        for length in sorted(self.left, reverse=True):
            while n := self.left[length]:
                at = bisect_left(open_, (length, -1, -1))
                if at < len(open_):
                    room, sequence, bins = open_.pop(at)
                else:
                    room, bins = self.capacity, -(-n // (self.capacity // length))
                    sequence = self.open(bins)
                copies = room // length
                full = min(bins, n // copies)
                if full:
                    self.put(length, full, copies, sequence, self.capacity - room)
                    if room - copies * length:
                        insort(open_, (room - copies * length, sequence, full))
                rest = self.left[length] if full < bins else 0
                if rest:
                    self.put(length, 1, rest, sequence + full, self.capacity - room)
                    if room - rest * length:
                        insort(open_, (room - rest * length, sequence + full, 1))
                done = full + bool(rest)
                if done < bins:
                    insort(open_, (room, sequence + done, bins - done))


def packing_plan(counts: dict[int, int], capacity: int) -> Plan:
    plan = Plan(capacity, counts)
    plan.reduce()
    plan.best_fit()
    return plan


def pack(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to a stored table with ``doc_id, piece, length``.

    Only the counts of at most ``capacity`` lengths come to the driver. The number of runs depends on
    the lengths, not on the number of pieces. Pieces of equal length are ranked in hash buckets,
    so a length that a third of all documents share is spread. Pieces of one id and number are
    told apart by ``ids_crc32``, if there is such a column; equal rows get places of their own. No pieces give no rows.
    """
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    if counts and not 1 <= min(counts) <= max(counts) <= capacity:
        raise ValueError("lengths must be between 1 and the capacity")
    plan = packing_plan(counts, capacity)
    spark = pieces.sparkSession
    runs = spark.createDataFrame(plan.runs, RUNS)
    numbered = ranked(pieces, ["length"], [c for c in ("doc_id", "piece", "ids_crc32") if c in pieces.columns], "_rank", sum(counts.values()))
    at = F.col("_rank") - F.col("first_rank")
    return (
        numbered.join(F.broadcast(runs), "length")
        .where("_rank >= first_rank and _rank < end_rank")
        .withColumn("sequence_id", F.col("sequence") + F.floor(at / F.col("copies")))
        .withColumn("offset", F.col("place") + F.pmod(at, F.col("copies")) * F.col("length"))
        .drop("_rank", "first_rank", "end_rank", "copies", "sequence", "place")
    )


def packed_documents(docs: DataFrame, capacity: int = 2048, tokenizer: str | None = None) -> DataFrame:
    """Pieces of all documents with their places and a checksum of their ids."""
    pieces = token_pieces(docs, capacity, tokenizer)
    narrow = materialize(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))
    return pack(narrow, capacity)
