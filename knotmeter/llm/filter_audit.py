"""What each of five filters removes, alone and in every order of the five.

Every document fails some of the filters A to E. Counted by part and failed set, the documents of a part are a tensor
of 2 x 2 x 2 x 2 x 2 cells (passes or fails, an axis for each filter), and so are its good and its toxic ones. All
figures of all 120 orders are contractions of these tensors: along each axis a vector picks what passes,
what fails, or all.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knotmeter.llm.substrings import word_count, words_joined
from knotmeter.session import materialize

FILTERS = "ABCDE"
ORDERS = ["".join(order) for order in permutations(FILTERS)]

_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: What a vector picks along an axis of (passes, fails).
_PASS, _FAIL, _ALL = (1, 0), (0, 1), (1, 1)
#: Parts whose rows are made at once.
PARTS = 64

_OUT = (
    "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, "
    "good_lost long, toxic_lost long, shapley long"
)


def _cell(name: str) -> int:
    """The cell number counts in the order of the axes: A is the slowest."""
    return 1 << (len(FILTERS) - 1 - FILTERS.index(name))


def _sum_of_failed(conditions: dict[str, Column]) -> Column:
    return sum((F.when(c, _cell(name)).otherwise(0) for name, c in conditions.items()), F.lit(0))


def failed_sets(docs: DataFrame) -> DataFrame:
    """``part, doc_id, failed, n``: a row for each document, ``n`` times if documents are equal in all three.

    A null text is empty, a null source the part of the empty string. E holds back what a smaller doc_id has
    already: a null doc_id is neither smaller nor greater than another, so its row passes E and fails no other.
    Equal rows are counted before texts meet, and a copy meets only the row of its own id and text, so
    neither many equal rows nor many copies of a text come together in one task.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select(
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.col("doc_id").cast("long").alias("doc_id"),
        text.alias("text"), words_joined(text).alias("joined"),
    )
    words = word_count(F.col("joined"))
    capitals = F.length("text") - F.length(F.translate("text", _CAPITALS, ""))
    alone = _sum_of_failed({
        "A": words < 50,
        "B": 100 * F.size(F.array_distinct(F.split("joined", " "))) < 65 * words,
        "C": 100 * capitals > 5 * F.length("text"),
        "D": F.col("text").rlike("[#$%&*|]"),
    })
    facts = base.select("part", "doc_id", F.unhex(F.sha2("text", 256)).alias("text_id"), alone.alias("alone"))
    facts = materialize(facts.groupBy("part", "doc_id", "text_id", "alone").agg(F.count("*").alias("n")))
    first = facts.where("doc_id IS NOT NULL").groupBy("text_id").agg(F.min("doc_id").alias("doc_id")).withColumn("is_first", F.lit(True))
    copy = F.col("doc_id").isNotNull() & F.col("is_first").isNull()
    return (
        facts.join(first, ["text_id", "doc_id"], "left")
        .select("part", "doc_id", (F.col("alone") + _sum_of_failed({"E": copy})).alias("failed"), "n")
        .groupBy("part", "doc_id", "failed").agg(F.sum("n").alias("n"))
    )


def cell_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, failed, n, good, toxic``: at most 32 rows a part.

    A document is good (toxic) if any row of labels says quality (toxic) 1 for its id; labels without an id count
    for none.
    """
    marks = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max(F.coalesce((F.col("quality") == 1).cast("long"), F.lit(0))).alias("good"),
        F.max(F.coalesce((F.col("toxic") == 1).cast("long"), F.lit(0))).alias("toxic"),
    )
    marked = failed_sets(docs).join(marks, "doc_id", "left")
    counts = {"n": F.col("n"), "good": F.col("n") * F.col("good"), "toxic": F.col("n") * F.col("toxic")}
    return marked.groupBy("part", "failed").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(name) for name, c in counts.items()])


def _vectors(earlier: tuple[int, int], own: tuple[int, int], later: tuple[int, int]) -> list[np.ndarray]:
    """For each axis, the vectors of all steps of all orders."""
    out = [np.empty((len(ORDERS) * len(FILTERS), 2), np.int64) for _ in FILTERS]
    for k, order in enumerate(ORDERS):
        for step in range(len(FILTERS)):
            for place, name in enumerate(order):
                picked = own if place == step else earlier if place < step else later
                out[FILTERS.index(name)][k * len(FILTERS) + step] = picked
    return out


_KEPT = _vectors(_PASS, _PASS, _ALL)
_REMOVED = _vectors(_PASS, _FAIL, _ALL)
_FAILING = _vectors(_ALL, _FAIL, _ALL)
_UNIQUE = _vectors(_PASS, _FAIL, _PASS)
#: The filter of each step of each order.
_OWN = np.array([FILTERS.index(name) for order in ORDERS for name in order])


def _contract(tensors: np.ndarray, vectors: list[np.ndarray]) -> np.ndarray:
    """For each part and each step of each order, the sum of the cells picked along all axes."""
    return np.einsum("pabcde,na,nb,nc,nd,ne->pn", tensors, *vectors, optimize=True)


def _figures(counts: np.ndarray) -> dict[str, np.ndarray]:
    """``counts``: all, good and toxic documents (3, parts, 32)."""
    every, good, toxic = counts.reshape(3, -1, *[2] * len(FILTERS))
    removed = _contract(every, _REMOVED)
    by_filter = np.stack([removed[:, _OWN == k].sum(axis=1) for k in range(len(FILTERS))], axis=1)
    return {
        "kept": _contract(every, _KEPT), "removed": removed, "redundant": _contract(every, _FAILING) - removed,
        "unique_fails": _contract(every, _UNIQUE), "good_lost": _contract(good, _REMOVED),
        "toxic_lost": _contract(toxic, _REMOVED), "shapley": by_filter[:, _OWN],
    }


def _audited(size: int) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps = len(ORDERS) * len(FILTERS)
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                rows = batch.slice(at, size).to_pylist()
                counts = np.zeros((3, len(rows), 1 << len(FILTERS)), np.int64)
                for p, row in enumerate(rows):
                    for cell in row["cells"]:
                        counts[:, p, cell["failed"]] = cell["n"], cell["good"], cell["toxic"]
                columns = {
                    "part": pa.array([r["part"] for r in rows], pa.string()).take(pa.array(np.repeat(np.arange(len(rows)), steps))),
                    "filter_order": np.tile(np.repeat(ORDERS, len(FILTERS)), len(rows)),
                    "step": np.tile(np.arange(1, len(FILTERS) + 1, dtype=np.int32), len(rows) * len(ORDERS)),
                }
                columns |= {name: x.reshape(-1) for name, x in _figures(counts).items()}
                yield pa.record_batch([pa.array(x) for x in columns.values()], list(columns))

    return run


def filter_audit(docs: DataFrame, labels: DataFrame, parts: int = PARTS) -> DataFrame:
    """``part, filter_order, step`` and the counts of that step, 600 rows a part; no documents, no rows.

    Only cells leave the grouping by part, so the contractions see 32 numbers a part whatever its size.
    """
    cells = cell_counts(docs, labels).groupBy("part").agg(F.collect_list(F.struct("failed", "n", "good", "toxic")).alias("cells"))
    return cells.mapInArrow(_audited(parts), _OUT)
