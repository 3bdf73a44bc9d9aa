"""Substring dedup: suffix automata of reference shards, matching statistics, removal of repeated spans.

A window is a run of ``width`` words. Every window has an anchor, its smallest hashed run of eight words, and equal
windows have equal anchors. Anchors that occur once in the corpus cannot lie in a repeated window, so only the
passages around the others are looked at. They are dealt out by anchor into shards small enough for a suffix
automaton each, and every passage is streamed through the automaton of its own shard. To broadcast all
shards to all documents would be a product of the two; by the anchor a passage meets exactly
the shard that holds every window it could share.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knotmeter.llm.common import BLANK, Words, row_key, sequence_hashes, slices, sliding_first_min
from knotmeter.session import materialize

#: Words of an anchor.
ANCHOR = 8
#: An anchor with more occurrences has its windows dealt out one by one instead of its passages.
COMMON_ANCHOR = 500
#: Words of a reference shard, apart from the last anchor's passages.
SHARD_WORDS = 50_000


def anchors(docs: DataFrame, width: int) -> DataFrame:
    """``k1, k2, first, windows, key``: runs of windows of a document that share an anchor, and its hash."""

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            words = Words(batch.column(2))
            hashes = sequence_hashes(words.hashes(), ANCHOR)
            if len(words) < width:
                continue
            place = sliding_first_min(hashes, width - ANCHOR + 1)
            start = np.arange(len(place))
            row = words.row[:len(place)]
            whole = start + width <= words.first[row + 1]
            start, row, place = start[whole], row[whole], place[whole]
            if not len(start):
                continue
            new = np.concatenate([[True], (place[1:] != place[:-1]) | (row[1:] != row[:-1])])
            at = np.flatnonzero(new)
            count = np.diff(np.append(at, len(start)))
            owner = pa.array(row[at])
            yield pa.record_batch(
                [batch.column(0).take(owner), batch.column(1).take(owner), pa.array((start[at] - words.first[row[at]]).astype(np.int32)),
                 pa.array(count.astype(np.int32)), pa.array(hashes[place[at]].view(np.int64))],
                ["k1", "k2", "first", "windows", "key"],
            )

    narrow = docs.select(*row_key(), F.col("text").cast("string"))
    return narrow.mapInArrow(find, "k1 long, k2 long, first int, windows int, key long")


def suspects(docs: DataFrame, width: int) -> DataFrame:
    """``k1, k2, text, places``: documents with repeated anchors and where these are, as a stored table."""
    found = materialize(anchors(docs, width))
    repeated = found.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    places = (
        found.join(repeated, "key").groupBy("k1", "k2")
        .agg(F.collect_set(F.struct("first", "windows", "key", (F.col("n") > COMMON_ANCHOR).alias("common"))).alias("places"))
    )
    return materialize(docs.select(*row_key(), F.col("text").cast("string")).join(places, ["k1", "k2"]))


def _passages(batch: pa.RecordBatch, width: int) -> Iterator[tuple[int, int, int, int, bytes, bytes | None]]:
    """``k1, k2, first, key, id, text`` of the passages of some suspects; a window of a common anchor has no text."""
    texts = batch.column(2).cast(pa.binary()).to_pylist()
    for k1, k2, text, places in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts, batch.column(3).to_pylist(), strict=True):
        words = text.split()
        for place in places:
            first, end = place["first"], place["first"] + place["windows"] + width - 1
            if place["common"]:
                for at in range(first, end - width + 1):
                    digest = hashlib.md5(b" ".join(words[at:at + width])).digest()
                    yield k1, k2, at, int.from_bytes(digest[:8], "little", signed=True), digest, None
            else:
                passage = b" ".join(words[first:end])
                yield k1, k2, first, place["key"], hashlib.md5(passage).digest(), passage


def _counted(width: int):
    """Distinct passages of a task with their counts, given on in bounded lots."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[int, bytes], list] = {}

        def lot() -> pa.RecordBatch:
            keys, values = zip(*seen.items(), strict=True)
            columns = [pa.array([k for k, _ in keys], pa.int64()), pa.array([i for _, i in keys], pa.binary()), pa.array([n for n, _ in values], pa.int64()), pa.array([t for _, t in values], pa.binary())]
            seen.clear()
            return pa.record_batch(columns, ["key", "id", "n", "passage"])

        for batch in slices(batches):
            for *_, key, digest, passage in _passages(batch, width):
                entry = seen.get((key, digest))
                if entry is None:
                    seen[key, digest] = [1, passage]
                else:
                    entry[0] += 1
                if len(seen) >= 30_000:
                    yield lot()
        if seen:
            yield lot()

    return count


def _occurring(width: int):
    """Every place where a passage stands."""

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int32()]
        for batch in slices(batches, limit=1 << 20):
            rows = [(key, digest, k1, k2, first) for k1, k2, first, key, digest, _ in _passages(batch, width)]
            columns = zip(*rows, strict=True) if rows else [[]] * 5
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["key", "id", "k1", "k2", "first"])

    return place


class SuffixAutomaton:
    """All substrings of several word sequences, and how often each occurs."""

    def __init__(self):
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length, self.count = [-1], [0], [0]

    def _state(self, length: int, moves: dict[bytes, int], link: int) -> int:
        self.next.append(moves)
        self.length.append(length)
        self.link.append(link)
        self.count.append(0)
        return len(self.length) - 1

    def _split(self, state: int, below: int, word: bytes) -> int:
        """A state of its own for those substrings of ``state`` that end the shorter way."""
        clone = self._state(self.length[below] + 1, dict(self.next[state]), self.link[state])
        self.link[state] = clone
        while below >= 0 and self.next[below].get(word) == state:
            self.next[below][word] = clone
            below = self.link[below]
        return clone

    def _extend(self, last: int, word: bytes) -> int:
        known = self.next[last].get(word)
        if known is not None:
            return known if self.length[known] == self.length[last] + 1 else self._split(known, last, word)
        new, at = self._state(self.length[last] + 1, {}, 0), last
        while at >= 0 and word not in self.next[at]:
            self.next[at][word] = new
            at = self.link[at]
        if at >= 0:
            known = self.next[at][word]
            self.link[new] = known if self.length[known] == self.length[at] + 1 else self._split(known, at, word)
        return new

    def add(self, words: list[bytes], times: int) -> None:
        last = 0
        for word in words:
            last = self._extend(last, word)
            self.count[last] += times

    def finish(self) -> None:
        """Gives each state the occurrences of all longer ones that end in it."""
        for state in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            if self.link[state] > 0:
                self.count[self.link[state]] += self.count[state]

    def repeated(self, words: list[bytes], width: int) -> list[tuple[int, int]]:
        """Maximal spans of ``words`` covered by runs of ``width`` words that occur twice or more.

        The state stands for the longest match that ends at each word, cut to ``width`` words, and so
        knows how often they occur.
        """
        spans: list[tuple[int, int]] = []
        state = matched = 0
        for i, word in enumerate(words):
            while state and word not in self.next[state]:
                state = self.link[state]
                matched = self.length[state]
            state = self.next[state].get(word, 0)
            matched = matched + 1 if state else 0
            while self.length[self.link[state]] >= width if state else False:
                state = self.link[state]
            matched = min(matched, self.length[state])
            if matched >= width and self.count[state] > 1:
                if spans and spans[-1][1] >= i + 1 - width:
                    spans[-1] = (spans[-1][0], i + 1)
                else:
                    spans.append((i + 1 - width, i + 1))
        return spans


def _matched(width: int):
    """Repeated spans of distinct passages, which come ordered by anchor."""

    def match(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[int, bytes, list[int]]] = []
        shard: list[tuple[int, bytes, int, list[bytes]]] = []
        group: list[tuple[int, bytes, int, bytes | None]] = []
        size = 0

        def close_shard() -> None:
            automaton = SuffixAutomaton()
            for _, _, n, words in shard:
                automaton.add(words, n)
            automaton.finish()
            for key, digest, _, words in shard:
                if spans := automaton.repeated(words, width):
                    found.append((key, digest, [x for span in spans for x in span]))
            shard.clear()

        def close_group() -> int:
            """An anchor with one passage needs no automaton: its windows are as frequent as itself or differ."""
            added = 0
            for key, digest, n, passage in group:
                if passage is None:
                    if n > 1:
                        found.append((key, digest, [0, width]))
                elif len(group) == 1 and n > 1:
                    found.append((key, digest, [0, passage.count(b" ") + 1]))
                elif len(group) > 1:
                    shard.append((key, digest, n, passage.split(b" ")))
                    added += len(shard[-1][3])
            group.clear()
            return added

        def lot() -> pa.RecordBatch:
            columns = zip(*found, strict=True) if found else [[]] * 3
            out = pa.record_batch([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.binary(), pa.list_(pa.int32())), strict=True)], ["key", "id", "spans"])
            found.clear()
            return out

        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if group and group[0][0] != row[0]:
                    size += close_group()
                    if size >= SHARD_WORDS:
                        close_shard()
                        size = 0
                group.append(row)
            yield lot()
        close_group()
        close_shard()
        yield lot()

    return match


def repeated_spans(candidates: DataFrame, width: int) -> DataFrame:
    """``k1, k2, spans``: the removed spans ``(start, end)`` of each document, in words; they may overlap."""
    counted = candidates.mapInArrow(_counted(width), "key long, id binary, n long, passage binary").repartition("key")
    distinct = counted.groupBy("key", "id").agg(F.sum("n").alias("n"), F.max("passage").alias("passage")).sortWithinPartitions("key")
    matched = materialize(distinct.mapInArrow(_matched(width), "key long, id binary, spans array<int>"))
    places = candidates.mapInArrow(_occurring(width), "key long, id binary, k1 long, k2 long, first int")
    moved = F.transform("spans", lambda x: x + F.col("first"))
    return places.join(matched, ["key", "id"]).groupBy("k1", "k2").agg(F.collect_set(moved).alias("spans"))


def _cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        removed, kept = [], []
        for text, spans in zip(batch.column(2).cast(pa.binary()).to_pylist(), batch.column(3).to_pylist(), strict=True):
            words = text.split()
            gone = np.zeros(len(words), bool)
            for span in spans:
                for start, end in zip(span[::2], span[1::2], strict=True):
                    gone[start:end] = True
            removed.append(int(gone.sum()))
            kept.append(b" ".join([word for word, out in zip(words, gone.tolist(), strict=True) if not out]).decode())
        yield pa.record_batch([*batch.columns[:2], pa.array(removed, pa.int64()), pa.array(kept, pa.string())], ["k1", "k2", "n_removed", "kept"])


def cut_documents(docs: DataFrame, width: int = 50) -> DataFrame:
    """``k1, k2, n_removed, kept``: the documents that lose words, with the words they keep joined by a blank.

    Every word goes that a window covers which also starts anywhere else in the corpus, in the same document
    or another; all occurrences go, the first included. Null and empty texts and texts shorter than a window
    lose nothing. Rows with equal texts lose everything their windows cover.
    """
    if width < ANCHOR:
        raise ValueError(f"a window has at least {ANCHOR} words")
    candidates = suspects(docs, width)
    spans = repeated_spans(candidates, width)
    # equal rows have one key and the same spans; one of them is enough here
    texts = candidates.select("k1", "k2", "text")
    return texts.join(spans, ["k1", "k2"]).mapInArrow(_cut, "k1 long, k2 long, n_removed long, kept string").dropDuplicates(["k1", "k2"])


def words_joined(text: Column) -> Column:
    """The words of a text joined by one blank; null has none."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), BLANK, " "))


def word_count(joined: Column) -> Column:
    return F.when(joined == "", 0).otherwise(F.length(joined) - F.length(F.translate(joined, " ", "")) + 1).cast("long")


def deduplicated(docs: DataFrame, width: int = 50) -> DataFrame:
    """``docs`` with all its columns, the text of documents that lose words replaced by what they keep."""
    cut = cut_documents(docs, width).select("k1", "k2", F.col("kept").alias("_kept"))
    keyed = docs.select(F.struct("*").alias("row"), *row_key()).join(cut, ["k1", "k2"], "left")
    return keyed.select(*[F.coalesce("_kept", "row.text").alias("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
