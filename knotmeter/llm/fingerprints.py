"""Improbable-feature digests: rare byte windows in chained Bloom filters, compared by bit overlap.

The collision entropy of every window of 32 bytes follows from the number of equal pairs of bytes in it. How
often each value occurs in the whole corpus ranks the windows: the less probable, the better a
feature. Of every 32 neighbouring windows the best one is voted for, and windows with enough votes are the
features. Where many neighbours in a row have none, as in short or repeating texts, those with the most votes
are added, so that only the empty text has no feature. They go, in order of the text, into Bloom filters of 256 bytes; when one is full a next is chained.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from knotmeter.llm.common import Words, mixed, partitions, sliding_first_min, slices
from knotmeter.session import materialize

#: Bytes of a window, and neighbours among which each window is compared; both are powers of two.
WINDOW = 32
#: Votes of its neighbours that make a window a feature.
VOTES = 16
#: So many neighbouring windows have a feature among them at least.
STRETCH = 4 * WINDOW
#: Bits and features of a filter, and bits that a feature sets.
BITS, FULL, DRAWS = 2048, 160, 5
#: Equal pairs of bytes that a window can have.
PAIRS = WINDOW * (WINDOW - 1) // 2
#: Bytes of text for which scratch is held at once.
CHUNK = 1 << 18


def equal_pairs(data: np.ndarray) -> np.ndarray:
    """For each window of the bytes, its number of equal pairs: 0 when all bytes differ."""
    n = len(data)
    if n < WINDOW:
        return np.zeros(0, np.int32)
    before, after = np.zeros(n, np.uint8), np.zeros(n, np.uint8)
    for lag in range(1, WINDOW):
        same = (data[lag:] == data[:-lag]).view(np.uint8)
        before[lag:] += same
        after[:-lag] += same
    # moving on by a byte adds the pairs of the one that comes and takes those of the one that goes
    gain = before[WINDOW:].astype(np.int32) - after[:n - WINDOW]
    first = sum(int((data[lag:WINDOW] == data[:WINDOW - lag]).sum()) for lag in range(1, WINDOW))
    return np.concatenate([[first], first + np.cumsum(gain, dtype=np.int32)]).astype(np.int32)


def _chunks(data: np.ndarray, overlap: int) -> Iterator[tuple[int, np.ndarray]]:
    """Stretches of the bytes that share ``overlap`` bytes with the next, so that nothing at a seam is lost."""
    at = 0
    while True:
        yield at, data[at:at + CHUNK + overlap]
        at += CHUNK
        if at + overlap >= len(data):
            return


def pair_histogram(docs: DataFrame) -> np.ndarray:
    """How many windows of all texts have each number of equal pairs; of fixed size."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(PAIRS + 1, np.int64)
        for batch in slices(batches):
            words = Words(batch.column(0))
            for at, part in _chunks(words.data, WINDOW - 1):
                # windows that reach from one text into the next do not count
                value = equal_pairs(part)
                last = np.searchsorted(words.offsets, at + np.arange(len(value)), side="right")
                inside = at + np.arange(len(value)) + WINDOW <= words.offsets[np.minimum(last, words.rows)]
                total += np.bincount(value[inside], minlength=PAIRS + 1)
        yield pa.record_batch([pa.array(np.arange(PAIRS + 1)), pa.array(total)], ["pairs", "n"])

    found = docs.select(F.col("text").cast("string")).mapInArrow(count, "pairs long, n long")
    out = np.zeros(PAIRS + 1, np.int64)
    for row in found.groupBy("pairs").agg(F.sum("n").alias("n")).collect():
        out[row["pairs"]] = row["n"]
    return out


def ranks(histogram: np.ndarray) -> np.ndarray:
    """The rank of each number of equal pairs, the least probable first; of equally rare ones the fewer pairs."""
    out = np.empty(len(histogram), np.int16)
    out[np.lexsort((np.arange(len(histogram)), histogram))] = np.arange(len(histogram))
    return out


_POWER = np.cumprod(np.array([1] + [0xD6E8FEB86659FD93] * (WINDOW - 1), np.uint64))


def _codes(data: np.ndarray, places: np.ndarray) -> np.ndarray:
    code = np.zeros(len(places), np.uint64)
    for k in range(WINDOW):
        code += (data[places + k].astype(np.uint64) + np.uint64(1)) * _POWER[k]
    return mixed(code)


def _most_voted(data: np.ndarray, votes: np.ndarray, start: int, end: int) -> int:
    """Of the places from start to end the one with most votes; of several that of the least code, of equal windows the last."""
    run = votes[start:end]
    places = start + np.flatnonzero(run == run.max())
    windows = np.lib.stride_tricks.sliding_window_view(data[start:end + WINDOW - 1], WINDOW)[places - start]
    code = mixed((windows.astype(np.uint64) + np.uint64(1)) @ _POWER)
    return int(places[code == code.min()][-1])


def _added(data: np.ndarray, votes: np.ndarray, before: int, after: int, until: int) -> list[int]:
    """Places to add between a feature and the next one, by runs of :data:`STRETCH` places that start before ``until``."""
    found, start = [], before + 1
    while after - start >= STRETCH and start < until:
        found.append(_most_voted(data, votes, start, start + STRETCH))
        start = found[-1] + 1
    return found


def features(data: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """A number for each feature of a text, in its order. A text shorter than a window is one feature."""
    if not len(data):
        return np.zeros(0, np.uint64)
    if len(data) < WINDOW:
        return mixed(np.array([np.sum((data.astype(np.uint64) + np.uint64(1)) * _POWER[:len(data)], dtype=np.uint64)]))
    found, last = [], -1
    # windows that vote for one another lie in the same stretch, and so do those of a run that starts in it
    for at, part in _chunks(data, 3 * WINDOW + STRETCH):
        value = rank[equal_pairs(part)]
        votes = np.bincount(sliding_first_min(value, min(WINDOW, len(value))), minlength=len(value))
        end = until = len(value)
        if at + len(part) < len(data):
            until = CHUNK + WINDOW
            end = until + STRETCH
        voted = np.flatnonzero(votes[:end] >= VOTES)
        voted = voted[voted > max(last - at, WINDOW - 1 if at else -1)]
        left, right = np.concatenate([[last - at], voted]), np.concatenate([voted, [end]])
        extra = [x for k in np.flatnonzero(right - left > STRETCH) for x in _added(part, votes, left[k], right[k], until)]
        chosen = np.sort(np.concatenate([voted[voted < until], np.array(extra, int)]))
        if last < 0 and not len(chosen) and until == len(value):
            chosen = np.array([_most_voted(part, votes, 0, end)])
        if len(chosen):
            last = at + int(chosen[-1])
        found.append(_codes(part, chosen))
    return np.concatenate(found)


def _batch_features(texts: list[bytes], rank: np.ndarray) -> list[np.ndarray]:
    """The features of several texts of at least three windows each, worked out side by side."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(x) for x in texts])
    ends = np.cumsum(sizes)
    value = rank[equal_pairs(data)]
    place = sliding_first_min(value, WINDOW)
    # a vote counts if all windows that it compares lie in one text
    end = np.repeat(ends, sizes)[:len(place)]
    whole = np.arange(len(place)) + 2 * WINDOW - 1 <= end
    votes = np.bincount(place[whole], minlength=len(value))
    voted = np.flatnonzero(votes >= VOTES)
    before, after = ends - sizes - 1, ends - WINDOW + 1
    left, right = np.sort(np.concatenate([before, voted])), np.sort(np.concatenate([after, voted]))
    extra = [x for k in np.flatnonzero(right - left > STRETCH) for x in _added(data, votes, left[k], right[k], right[k])]
    none = np.isin(left, before) & np.isin(right, after) & (right - left <= STRETCH)
    extra += [_most_voted(data, votes, left[k] + 1, right[k]) for k in np.flatnonzero(none)]
    chosen = np.sort(np.concatenate([voted, np.array(extra, int)]))
    return np.split(_codes(data, chosen), np.searchsorted(chosen, ends[:-1]))


def chains(features_of: list[np.ndarray]) -> list[bytes]:
    """The chained filters of several texts: :data:`FULL` features to a filter, no features no filter."""
    counts = np.array([len(x) for x in features_of], int)
    filters = -(-counts // FULL)
    first = np.concatenate([[0], np.cumsum(filters)])
    numbers = np.concatenate(features_of) if len(counts) else np.zeros(0, np.uint64)
    within = np.arange(len(numbers)) - np.repeat(np.cumsum(counts) - counts, counts)
    at = np.repeat(first[:-1], counts) + within // FULL
    bits = np.zeros((first[-1], BITS), bool)
    for k in range(DRAWS):
        bits[at, ((numbers >> np.uint64(12 * k)) % np.uint64(BITS)).astype(int)] = True
    packed = np.packbits(bits, axis=1)
    return [packed[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]


def digests(texts: list[bytes], rank: np.ndarray) -> list[bytes]:
    """The digest of each text. Texts of ordinary length share their scratch, up to :data:`CHUNK` bytes of them."""
    found: list[np.ndarray | None] = [None] * len(texts)
    group: list[int] = []
    size = 0

    def close() -> None:
        nonlocal size
        if group:
            for i, own in zip(group, _batch_features([texts[i] for i in group], rank), strict=True):
                found[i] = own
        group.clear()
        size = 0

    for i, text in enumerate(texts):
        if not 3 * WINDOW <= len(text) <= CHUNK:
            found[i] = features(np.frombuffer(text, np.uint8), rank)
            continue
        if size + len(text) > CHUNK:
            close()
        group.append(i)
        size += len(text)
    close()
    return chains(found)


def _filters(digest: bytes) -> np.ndarray:
    return np.frombuffer(digest, np.uint64).reshape(-1, BITS // 64)


def likeness(one: bytes, two: bytes) -> float:
    """0 to 1: the mean over the filters of the shorter chain of the best overlap with the other.

    Of the common bits those expected by chance are taken off, and the rest is divided by the most there could
    be. Each filter is compared with all of the other chain, wherever they stand; scratch is as large as that
    chain. Two chains without filters are alike; a chain with and one without are not.
    """
    if one == two:
        return 1.0
    if not one or not two:
        return 0.0
    if len(one) > len(two) or (len(one) == len(two) and one > two):
        one, two = two, one
    a, b = _filters(one), _filters(two)
    sizes = np.bitwise_count(b).sum(axis=1, dtype=np.int64)
    total = weight = 0.0
    for x in a:
        size = int(np.bitwise_count(x).sum(dtype=np.int64))
        # at most FULL * DRAWS bits are set, so the most there could be is above chance
        chance, most = size * sizes / BITS, np.minimum(size, sizes)
        overlap = (np.bitwise_count(b & x).sum(axis=1, dtype=np.int64) - chance) / (most - chance)
        total += min(max(float(overlap.max()), 0.0), 1.0) * size
        weight += size
    return min(1.0, total / weight)


def edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


FIELDS = [
    ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.binary()),
    ("edited_fingerprint", pa.binary()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
    ("part", pa.int32()), ("end", pa.int32()), ("text", pa.string()),
]
#: ``end`` of a row: complete, or a partition's first or last document, with its text.
COMPLETE, FIRST, LAST = 0, 1, 2
DDL = "doc_id long, n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double, part int, end int, text string"


def _compared(docs: list[tuple], following: list[tuple[str, bytes]], rank: np.ndarray) -> list[tuple]:
    """Complete rows of documents ``(doc_id, text, digest)``, each with the text and digest of the one after it."""
    new = [edited(text, after).encode() for (_, text, _), (after, _) in zip(docs, following, strict=True)]
    return [
        (doc_id, len(text), hashlib.sha256(changed).hexdigest(), own, mine, likeness(own, mine), likeness(own, other))
        for (doc_id, text, own), (_, other), changed, mine in zip(docs, following, new, digests(new, rank), strict=True)
    ]


def _record(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(FIELDS)
    return pa.record_batch([pa.array(c, kind) for c, (_, kind) in zip(columns, FIELDS, strict=True)], [name for name, _ in FIELDS])


def _walk(rank: np.ndarray):
    """Documents of a partition in order, each with the one after it; its ends are left open."""

    def walk(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, last = TaskContext.get().partitionId(), None
        for batch in slices(batches):
            texts = batch.column(1).to_pylist()
            docs = list(zip(batch.column(0).to_pylist(), texts, digests([x.encode() for x in texts], rank), strict=True))
            rows = []
            if last is None:
                doc_id, text, own = docs[0]
                rows.append((doc_id, len(text), None, own, None, None, None, part, FIRST, text))
            else:
                docs.insert(0, last)
            complete = _compared(docs[:-1], [(text, own) for _, text, own in docs[1:]], rank)
            yield _record(rows + [(*row, part, COMPLETE, None) for row in complete])
            last = docs[-1]
        if last is not None:
            doc_id, text, own = last
            yield _record([(doc_id, len(text), None, own, None, None, None, part, LAST, text)])

    return walk


def _stitch(rank: np.ndarray):
    """The last document of a partition with the first one of the next."""

    def stitch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = batch.to_pylist()
            docs = [(r["doc_id"], r["text"], r["fingerprint"]) for r in found]
            rows = [(*row, None, COMPLETE, None) for row in _compared(docs, [(r["next_text"], r["next_fingerprint"]) for r in found], rank)]
            yield _record(rows)

    return stitch


def fingerprints(docs: DataFrame) -> DataFrame:
    """Digests of each document and of a copy whose end is that of the next document, and their likeness.

    ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``. The next document
    is that with the next smaller id (null ids come last, equal ids by a hash of the text), after the last the first.
    A null text counts as empty; empty texts have the empty digest. Equal texts have equal digests.

    Texts are shuffled once, into ranges of ids; a task walks through its range with one document in
    hand. Only the first and last documents of the ranges are joined, by the number of the range.
    """
    rank = ranks(pair_histogram(docs))
    narrow = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    order = [F.col("doc_id").desc_nulls_last(), F.xxhash64("text")]
    dealt = narrow.repartitionByRange(partitions(docs), *order).sortWithinPartitions(*order)
    stored = materialize(dealt.mapInArrow(_walk(rank), DDL))
    ends = stored.where(f"end <> {COMPLETE}")
    numbers = ends.where(f"end = {FIRST}").select("part")
    following = numbers.select("part", F.lead("part").over(Window.orderBy("part")).alias("next"))
    lowest = numbers.agg(F.min("part").alias("lowest"))
    # one row, of one number
    following = following.join(F.broadcast(lowest), F.col("next").isNull(), "left").select("part", F.coalesce("next", "lowest").alias("next"))
    heads = ends.where(f"end = {FIRST}").select(F.col("part").alias("next"), F.col("text").alias("next_text"), F.col("fingerprint").alias("next_fingerprint"))
    open_ = ends.where(f"end = {LAST}").select("part", "doc_id", "text", "fingerprint").join(following, "part").join(heads, "next")
    joined = open_.select("doc_id", "text", "fingerprint", "next_text", "next_fingerprint").mapInArrow(_stitch(rank), DDL)
    return stored.where(f"end = {COMPLETE}").unionByName(joined).drop("part", "end", "text")
