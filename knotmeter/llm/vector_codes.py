"""Product codes of vectors by exact integer k-means over Hilbert-sorted blocks.

A vector is cut into equal parts, each part position has a codebook, and rounds of k-means move its entries. The parts
of a position are sorted along a Hilbert curve and stored in flat blocks with the box around their points and their
sums. In a round the distances between box and entries leave each block a short list of entries that can be nearest
to any of its points. With one entry left, the block's sums are all that counts; otherwise an integer kernel finds
the nearest of the list for each point. Ties go to the lower entry throughout.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from knotmeter.llm.vectors import exact_type, integer_vectors, magnitude
from knotmeter.session import materialize

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
#: Points of a block.
BLOCK = 128
#: Bits of a component that the Hilbert curve follows.
BITS = 4
#: Groups into which the rows of a label are dealt before its errors are summed.
SALTS = 1024

_POINTS = "part int, key binary, row long, values array<long>"
_BLOCKS = "part int, n int, rows binary, points binary, low array<long>, high array<long>, total array<long>"
_SUMS = "part int, entry int, n long, total array<long>"
_CODES = "row long, part int, entry int, error long"
_RESULT = "vec_id long, code string, error long, label_error long, codebooks_sha256 string"


def hilbert_keys(points: np.ndarray, low: int, high: int) -> list[bytes]:
    """Places along a Hilbert curve through the cube from ``low`` to ``high``, as bytes that sort like them.

    Each component is taken to BITS bits. From the highest bit down, a set bit of an axis flips the lower bits of
    the first axis, and a clear one exchanges them with it, which turns the axes into those of the cell; the
    bits of all axes, Gray-coded, then read in turns.
    """
    n, axes = points.shape
    span = max(1, high - low)
    cells = ((points - low).astype(np.float64) * ((1 << BITS) - 1) / span).astype(np.int64)
    x = np.clip(cells, 0, (1 << BITS) - 1).T.copy()
    for bit in range(BITS - 1, 0, -1):
        lower = (1 << bit) - 1
        for axis in range(axes):
            is_set = (x[axis] >> bit) & 1 == 1
            swapped = np.where(is_set, 0, (x[0] ^ x[axis]) & lower)
            x[0] ^= np.where(is_set, lower, swapped)
            x[axis] ^= swapped
    for axis in range(1, axes):
        x[axis] ^= x[axis - 1]
    flips = np.zeros(n, np.int64)
    for bit in range(BITS - 1, 0, -1):
        flips ^= np.where((x[-1] >> bit) & 1 == 1, (1 << bit) - 1, 0)
    x ^= flips
    bits = (x[None, :, :] >> np.arange(BITS - 1, -1, -1)[:, None, None]) & 1
    packed = np.packbits(bits.reshape(BITS * axes, n).astype(np.uint8), axis=0).T
    return [row.tobytes() for row in packed]


def _cut(low: int, high: int) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            numbers = batch.column("ints").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, PARTS, -1)
            for part in range(PARTS):
                points = np.ascontiguousarray(numbers[:, part])
                values = pa.ListArray.from_arrays(np.arange(len(points) + 1, dtype=np.int32) * points.shape[1], pa.array(points.reshape(-1)))
                keys = pa.array(hilbert_keys(points, low, high), pa.binary())
                yield pa.record_batch([pa.array(np.full(len(points), part, np.int32)), keys, batch.column("row"), values], ["part", "key", "row", "values"])

    return run


def _blocked(size: int) -> Callable:
    """Neighbours along the curve as blocks of at most ``size`` points, in the narrowest integers that hold them."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column("part").to_numpy()
            row = batch.column("row").to_numpy()
            points = batch.column("values").flatten().to_numpy(zero_copy_only=False).reshape(len(part), -1)
            out = []
            for position in np.unique(part):
                start, end = np.searchsorted(part, [position, position + 1])
                for at in range(start, end, size):
                    own = points[at:min(end, at + size)]
                    low, high = own.min(axis=0), own.max(axis=0)
                    narrow = np.promote_types(np.min_scalar_type(-1 - abs(int(low.min()))), np.min_scalar_type(-1 - abs(int(high.max()))))
                    out.append({
                        "part": int(position), "n": len(own), "rows": row[at:at + len(own)].tobytes(),
                        "points": own.astype(narrow).tobytes(), "low": low, "high": high, "total": own.sum(axis=0),
                    })
            yield pa.RecordBatch.from_pylist(out, schema=_BLOCK_SCHEMA)

    return run


_BLOCK_SCHEMA = pa.schema([
    ("part", pa.int32()), ("n", pa.int32()), ("rows", pa.binary()), ("points", pa.binary()),
    ("low", pa.list_(pa.int64())), ("high", pa.list_(pa.int64())), ("total", pa.list_(pa.int64())),
])


def shortlist(low: np.ndarray, high: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """The entries, in order, that can be nearest to a point of the box.

    The farthest the box reaches from its closest entry bounds the distance of every point to its nearest. An entry within the
    bound goes nevertheless if it is farther than that closest one at the corner that suits it best, as then it is
    farther at every point; if the two are as far it stays, since a tie goes to the lower.
    """
    near = np.maximum(np.maximum(low - entries, entries - high), 0)
    far = np.maximum(np.abs(entries - low), np.abs(high - entries))
    reach = (far * far).sum(axis=1)
    best = int(reach.argmin())
    left = np.flatnonzero((near * near).sum(axis=1) <= reach[best])
    corner = np.where(entries[left] > entries[best], high, low)
    own = ((corner - entries[left]) ** 2).sum(axis=1)
    return left[own <= ((corner - entries[best]) ** 2).sum(axis=1)]


def nearest(points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each point the first nearest entry and the squared distance, in numbers that hold all products exactly."""
    kind = exact_type(4 * points.shape[1] * max(magnitude(points), magnitude(entries), 1) ** 2)
    p, e = points.astype(kind), entries.astype(kind)
    distance = (e * e).sum(axis=1) - 2 * (p @ e.T)
    place = distance.argmin(axis=1)
    return place, (distance[np.arange(len(p)), place] + (p * p).sum(axis=1)).astype(np.int64)


def _points(row: dict) -> np.ndarray:
    count = row["n"] * len(row["low"])
    kind = {1: np.int8, 2: np.int16, 4: np.int32, 8: np.int64}[len(row["points"]) // count]
    return np.frombuffer(row["points"], kind).reshape(row["n"], -1).astype(np.int64)


def _summed(get: Callable[[], np.ndarray]) -> Callable:
    """For each part position and entry, how many of a task's points are nearest to it, and their sums."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = get()
        counts = np.zeros(books.shape[:2], np.int64)
        totals = np.zeros(books.shape, np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                part = row["part"]
                left = shortlist(np.array(row["low"]), np.array(row["high"]), books[part])
                if len(left) == 1:
                    counts[part, left[0]] += row["n"]
                    totals[part, left[0]] += np.array(row["total"])
                    continue
                points = _points(row)
                entry = left[nearest(points, books[part][left])[0]]
                order = np.argsort(entry, kind="stable")
                own, first = np.unique(entry[order], return_index=True)
                counts[part, own] += np.diff(np.append(first, len(order)))
                totals[part, own] += np.add.reduceat(points[order], first, axis=0)
        part, entry = np.nonzero(counts)
        columns = [part.astype(np.int32), entry.astype(np.int32), counts[part, entry]]
        yield pa.record_batch([*map(pa.array, columns), pa.array(list(totals[part, entry]), pa.list_(pa.int64()))], ["part", "entry", "n", "total"])

    return run


def _coded(get: Callable[[], np.ndarray]) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = get()
        for batch in batches:
            for row in batch.to_pylist():
                book = books[row["part"]]
                left = shortlist(np.array(row["low"]), np.array(row["high"]), book)
                place, error = nearest(_points(row), book[left])
                columns = [
                    np.frombuffer(row["rows"], np.int64), np.full(row["n"], row["part"], np.int32), left[place].astype(np.int32), error,
                ]
                yield pa.record_batch([pa.array(x) for x in columns], ["row", "part", "entry", "error"])

    return run


def blocks(kept: DataFrame, size: int = BLOCK) -> DataFrame:
    """The stored blocks of all parts of ``kept`` (``row, ints`` of one length, stored).

    Ranges of (part, place on the curve, row) are dealt out, so that many equal vectors are many rows of several
    ranges; a range is sorted and cut into blocks.
    """
    low, high, length = kept.agg(F.min(F.array_min("ints")), F.max(F.array_max("ints")), F.max(F.size("ints"))).first()
    # entries are means of parts and stay between the two, so this holds for all distances of all rounds
    exact_type(4.0 * length // PARTS * max(abs(low), abs(high)) ** 2)
    points = kept.select("row", "ints").mapInArrow(_cut(low, high), _POINTS)
    dealt = points.repartitionByRange("part", "key", "row").sortWithinPartitions("part", "key", "row")
    return materialize(dealt.select("part", "row", "values").mapInArrow(_blocked(size), _BLOCKS))


def codebooks(stored: DataFrame, first: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """The entries (parts, entries, components) after all rounds. The driver sees sums for each entry, no points."""
    context = stored.sparkSession.sparkContext
    books = first
    for _ in range(rounds):
        sent = context.broadcast(books)
        sums = stored.mapInArrow(_summed(lambda sent=sent: sent.value), _SUMS)
        totals = [F.sum(F.element_at("total", i + 1)) for i in range(books.shape[2])]
        books = books.copy()
        for row in sums.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*totals).alias("total")).collect():
            books[row["part"], row["entry"]] = [total // row["n"] for total in row["total"]]
        sent.unpersist()
    return books


def _summed_over(df: DataFrame, by: str, value: str, name: str) -> DataFrame:
    """Adds the sum of ``value`` over rows that share ``by``, nulls together.

    Rows of one value meet in up to SALTS groups, whose sums alone come together.
    """
    salted = df.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)))
    sums = salted.groupBy(by, "salt").agg(F.sum(value).alias("own"))
    sums = sums.withColumn(name, F.sum("own").over(Window.partitionBy(by))).select(F.col(by).alias("o_by"), F.col("salt").alias("o_salt"), name)
    return salted.join(sums, F.col(by).eqNullSafe(F.col("o_by")) & (F.col("salt") == F.col("o_salt"))).drop("o_by", "o_salt", "salt")


def _hex(entry: Column) -> Column:
    return F.lower(F.lpad(F.hex(entry), 2, "0"))


def vector_codes(embeddings: DataFrame, block: int = BLOCK) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256``: a row for each vector that takes part.

    Null vectors and those with null or non-finite components are dropped. All others must have the length of the one with the
    smallest vec_id (null last; of equal ids the smallest by components): other lengths have no distance to it and
    are dropped too, as are empty vectors. A length that does not divide by four raises a ValueError, numbers whose
    squared distances do not fit a long an OverflowError. Rows that share a vec_id each have a code.
    Nothing left, no rows.
    """
    spark = embeddings.sparkSession
    kept = materialize(integer_vectors(embeddings, SCALE, F.col("label").alias("label")).where(F.size("ints") > 0))
    order = [F.col("vec_id").asc_nulls_last(), F.col("ints").asc()]
    smallest = kept.orderBy(*order).select(F.size("ints").alias("n")).first()
    if smallest is None:
        return spark.createDataFrame([], _RESULT)
    if smallest["n"] % PARTS:
        raise ValueError(f"vectors of {smallest['n']} components cannot be cut into {PARTS} equal parts")
    kept = kept.where(F.size("ints") == smallest["n"])
    first = np.array([r["ints"] for r in kept.orderBy(*order).limit(ENTRIES).select("ints").collect()])
    first = np.ascontiguousarray(first.reshape(len(first), PARTS, -1).transpose(1, 0, 2))
    stored = blocks(kept, block)
    books = codebooks(stored, first)
    digest = hashlib.sha256(",".join(map(str, books.reshape(-1))).encode()).hexdigest()
    sent = spark.sparkContext.broadcast(books)
    codes = stored.mapInArrow(_coded(lambda: sent.value), _CODES)
    digits = [F.max(F.when(F.col("part") == p, _hex(F.col("entry")))) for p in range(PARTS)]
    coded = codes.groupBy("row").agg(F.concat(*digits).alias("code"), F.sum("error").alias("error"))
    named = materialize(kept.select("row", "vec_id", "label").join(coded, "row"))
    return _summed_over(named, "label", "error", "label_error").select(
        "vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"),
    )
