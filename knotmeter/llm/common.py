"""Helpers shared by the operators: keys, words and their hashes, ranks, components."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from knotmeter.session import materialize

#: A word, as all operators cut it.
WORD = r"[^\x20\x09-\x0D]+"
#: Characters between words.
BLANK = r"[\x20\x09-\x0D]+"

_BLANK_BYTE = np.zeros(256, bool)
_BLANK_BYTE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32

_ODD = 0x9E3779B97F4A7C15
_STEP = np.uint64(_ODD)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_key() -> list[Column]:
    """Two numbers that name a row by its id and text; rows equal in both are interchangeable.

    A null id goes into the second number, so that it differs from id 0.
    """
    return [
        F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("k1"),
        F.xxhash64(F.col("doc_id").isNull(), F.coalesce("text", F.lit("")), F.col("text").isNull()).alias("k2"),
    ]


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


# --- ranks ---------------------------------------------------------------------------------


def ranked(df: DataFrame, group: list[str], by: list[str], name: str, rows: int, bucket_rows: int = 20_000) -> DataFrame:
    """Adds a gapless number from 0 in each group, in the order of a hash of ``by``.

    ``df`` must be a stored table, as it is read twice. Rows are numbered in hash buckets of about
    ``bucket_rows`` rows, to which running totals of bucket counts are added, so that a group
    with a third of all rows is still the work of many tasks.
    """
    buckets = max(1, rows // bucket_rows)
    tagged = df.withColumn("_hash", F.xxhash64(*by)).withColumn("_bucket", F.pmod("_hash", F.lit(buckets)))
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        tagged.groupBy(*group, "_bucket").agg(F.count("*").alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    )
    inside = Window.partitionBy(*group, "_bucket").orderBy("_hash", *by)
    return (
        tagged.join(offsets, [*group, "_bucket"])
        .withColumn(name, F.col("_before") + F.row_number().over(inside) - 1)
        .drop("_hash", "_bucket", "_before")
    )


# --- words in Arrow batches -----------------------------------------------------------------


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that the text of each has at most ``limit`` bytes, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = batch.column(batch.schema.get_field_index(column))
        size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            done = size[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(size, done + limit, side="right")))
            yield batch.slice(at, end - at)
            at = end


class Words:
    """The words of a column of texts: places in its bytes and the row of each; null has none."""

    def __init__(self, texts: pa.Array, lower: bool = False):
        texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
        _, places, data = texts.buffers()
        offsets = np.frombuffer(places, np.int64)[texts.offset:texts.offset + len(texts) + 1]
        whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        self.offsets = offsets - offsets[0]
        self.data = whole[offsets[0]:offsets[-1]]
        if lower:
            self.data = _LOWER[self.data]
        self.rows = len(texts)
        blank = _BLANK_BYTE[self.data]
        edge = np.zeros(len(self.data) + 1, bool)
        edge[self.offsets] = True
        first = ~blank
        first[1:] &= blank[:-1] | edge[1:-1]
        last = ~blank
        last[:-1] &= blank[1:] | edge[1:-1]
        self.starts = np.flatnonzero(first)
        self.ends = np.flatnonzero(last) + 1
        self.row = np.searchsorted(self.offsets, self.starts, side="right") - 1
        #: the first word of each row, and of the row after the last
        self.first = np.searchsorted(self.row, np.arange(self.rows + 1))

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self, chunk: int = 1 << 20) -> np.ndarray:
        """A number for each word: a polynomial of its bytes, mixed. Scratch is bounded by ``chunk``."""
        out = np.empty(len(self), np.uint64)
        at = 0
        while at < len(self):
            base = self.starts[at]
            end = max(at + 1, int(np.searchsorted(self.ends, base + chunk, side="right")))
            span = int(self.ends[end - 1] - base)
            power, inverse = _powers(span)
            total = np.zeros(span + 1, np.uint64)
            np.cumsum((self.data[base:base + span].astype(np.uint64) + np.uint64(1)) * power[:span], out=total[1:])
            s, e = self.starts[at:end] - base, self.ends[at:end] - base
            out[at:end] = mixed((total[e] - total[s]) * inverse[s] + (e - s).astype(np.uint64))
            at = end
        return out

    def text(self, row: int) -> bytes:
        return self.data[self.offsets[row]:self.offsets[row + 1]].tobytes()


_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2^64, and their inverses."""
    if not _POWERS or len(_POWERS[0]) < n + 1:
        size = max(n + 1, (1 << 20) + 1)
        base = 0xD6E8FEB86659FD93
        found = []
        for factor in (base, pow(base, -1, 1 << 64)):
            steps = np.full(size, factor, np.uint64)
            steps[0] = 1
            found.append(np.cumprod(steps))
        _POWERS[:] = found
    return _POWERS[0], _POWERS[1]


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit numbers over their range (the finaliser of SplitMix64)."""
    x = x + _STEP
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sequence_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """A number for each run of ``length`` neighbouring words, over the whole array."""
    factor = np.uint64(0xA24BAED4963EE407)
    out = np.zeros(max(0, len(words) - length + 1), np.uint64)
    for k in range(length):
        out *= factor
        out += words[k:k + len(out)]
    return mixed(out)


def sliding_first_min(values: np.ndarray, width: int) -> np.ndarray:
    """For each run of ``width`` neighbours, the place of the first smallest value."""
    best, place, have = values, np.arange(len(values)), 1
    while have < width:
        step = min(have, width - have)
        n = len(best) - step
        right = best[step:] < best[:n]
        place = np.where(right, place[step:], place[:n])
        best = np.where(right, best[step:], best[:n])
        have += step
    return place


# --- connected components -------------------------------------------------------------------


def _forest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of one partition as links to the smallest node of each of its components."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        top = x
        while root.setdefault(top, top) != top:
            top = root[top]
        while root[x] != top:
            root[x], x = top, root[x]
        return top

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                root[max(a, b)] = min(a, b)
    nodes = [x for x in root if find(x) != x]
    for at in range(0, len(nodes), 50_000):
        part = nodes[at:at + 50_000]
        yield pa.record_batch([pa.array(part, pa.int64()), pa.array([find(x) for x in part], pa.int64())], ["u", "v"])


def components(links: DataFrame) -> DataFrame:
    """``(node, component)`` for links ``(u, v)``: the smallest node that each can reach.

    Partitions first shrink their links by union-find. Then large and small stars alternate until
    every node hangs on its smallest: groupings and joins only, so that neither the driver
    nor one task sees all links or a whole component. Each round is a stored table.
    """
    edges = links.select(F.col("u").cast("long"), F.col("v").cast("long")).where("u <> v")
    edges = materialize(edges.mapInArrow(_forest, "u long, v long").distinct())
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(small_least, "u")
        small = joined.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        after = materialize(small.where("u <> v").distinct())
        # settled once no node is both a child and a parent
        open_ = after.select(F.col("v").alias("u")).distinct().join(after, "u", "left_semi").limit(1).count()
        many = after.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
        edges = after
        if not open_ and not many:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
