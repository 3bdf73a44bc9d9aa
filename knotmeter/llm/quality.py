"""Quality rules: an isolation forest on rule statistics, calibrated on labelled rows.

Documents that fail a base rule go. For the others random trees split the space of the rates of good labelled
rows; documents that lie off it are cut off after few splits. Odd is not bad by itself, so the score from which a
document goes is set on labelled rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotmeter.llm.common import Words, _BLANK_BYTE, sequence_hashes, slices
from knotmeter.operators.significance import running_totals
from knotmeter.session import materialize, spread

#: Base rules: at least so many words, at most this share of repeated ones (in percent).
MIN_WORDS, MAX_REPEAT = 20, 30
WINDOW = 8
#: Bytes of text that are measured at once; the scratch for it is many times as large.
SLICE = 1 << 20
SYMBOLS = b"#*$%&|<>"
MARKS = b"!\"'()+-/:;=?@[\\]^_`{}~"

#: Good labelled rows may lie above the threshold in this share only.
MAX_GOOD_LOST = 0.001

STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks", "n_same"]
STATS_DDL = ", ".join(f"{name} long" for name in STATS)
#: The columns of :func:`features`.
FEATURES = [f"f{i}" for i in range(7)]


def _is_in(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_SYMBOL, _MARK = _is_in(SYMBOLS), _is_in(MARKS)


def text_statistics(texts: pa.Array) -> np.ndarray:
    """A row of :data:`STATS` for each text; null has zeros."""
    words = Words(texts)
    n = words.rows

    def total(flags: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return sums[words.offsets[1:]] - sums[words.offsets[:-1]]

    data = words.data
    inside = ~_BLANK_BYTE[data]
    out = np.zeros((n, len(STATS)), np.int64)
    out[:, 0] = np.diff(words.first)
    out[:, 1] = total(inside & ((data & 0xC0) != 0x80))
    out[:, 2] = total(_SYMBOL[data])
    out[:, 6] = total((data >= 65) & (data <= 90))
    out[:, 7] = total(_MARK[data])
    for row in np.flatnonzero(out[:, 0]):
        lines = [x for x in words.text(row).split(b"\n") if x.strip()]
        out[row, 3], out[row, 5] = len(lines) - len(set(lines)), len(lines)
    hashes = words.hashes()
    again = np.zeros(len(words) + 1, np.int64)
    again[2:] = np.cumsum((hashes[1:] == hashes[:-1]) & (words.row[1:] == words.row[:-1])) if len(words) else 0
    out[:, 8] = again[words.first[1:]] - again[words.first[:-1]]
    hashes = sequence_hashes(hashes, WINDOW)
    start = np.arange(len(hashes))
    row = words.row[:len(hashes)]
    start = start[start + WINDOW <= words.first[row + 1]]
    hashes, row = hashes[start], row[start]
    order = np.lexsort((hashes, row))
    same = (hashes[order][1:] == hashes[order][:-1]) & (row[order][1:] == row[order][:-1])
    twice = np.zeros(len(start), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    step = np.zeros(len(words) + 1, np.int64)
    np.add.at(step, start[twice], 1)
    np.add.at(step, start[twice] + WINDOW, -1)
    covered = np.concatenate([[0], np.cumsum(np.cumsum(step)[:-1] > 0)])
    out[:, 4] = covered[words.first[1:]] - covered[words.first[:-1]]
    return out


def base_failed(stats: np.ndarray) -> np.ndarray:
    return (stats[:, 0] < MIN_WORDS) | (100 * stats[:, 4] > MAX_REPEAT * stats[:, 0])


#: Good rows that hardly differ in a rate count as if they spread over so much of it.
LEAST_SPREAD = 0.05


def features(stats: np.ndarray) -> np.ndarray:
    """Rates that do not depend on the length, whole: symbols, repeated words, marks, words like the one before and
    characters a word, repeated lines a line, capitals a character."""
    n_words, chars, symbols, dup, repeat, lines, upper, marks, same = np.maximum(stats, 0).astype(float).T
    per_word, per_char, per_line = np.maximum(n_words, 1), np.maximum(chars, 1), np.maximum(lines, 1)
    return np.column_stack([
        symbols / per_word, dup / per_line, repeat / per_word, upper / per_char, marks / per_word, same / per_word, chars / per_word,
    ])


@dataclass
class Forest:
    """Trees as arrays over nodes: split feature (-1: leaf), cut, left child (right: the next), path length, and the
    box of the node's rows. Rows are divided by ``unit`` first."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    length: np.ndarray
    low: np.ndarray
    high: np.ndarray
    unit: np.ndarray
    expected: float
    threshold: float = math.inf

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Near 1: cut off early; about 0.5 and below: ordinary.

        Of a row outside a node's box a random cut through both parts it from the box with a chance of its
        distance by the length of all sides; what is left of the row goes down the tree.
        """
        x = x / self.unit
        total = np.zeros(len(x))
        for feature, cut, left, length, low, high in zip(self.feature, self.cut, self.left, self.length, self.low, self.high, strict=True):
            node, at, stays, deep = np.zeros(len(x), int), np.arange(len(x)), np.ones(len(x)), 0
            while len(at):
                here, own_low, own_high = x[at], low[node], high[node]
                out = (np.maximum(own_low - here, 0) + np.maximum(here - own_high, 0)).sum(axis=1)
                parted = stays * out / np.maximum(out + (own_high - own_low).sum(axis=1), 1e-300)
                total[at] += parted * (deep + 1)
                stays = stays - parted
                split = feature[node]
                leaf = split < 0
                total[at[leaf]] += (stays * length[node])[leaf]
                at, stays, node, split = at[~leaf], stays[~leaf], node[~leaf], split[~leaf]
                node = left[node] + (x[at, split] >= cut[node])
                deep += 1
        return 2.0 ** (-total / len(self.feature) / self.expected)

    def rejects(self, x: np.ndarray) -> np.ndarray:
        return self.scores(x) > self.threshold


def _expected_path(n: int) -> float:
    """Mean path length of an unsuccessful search in a random tree of n rows."""
    if n < 2:
        return 0.0
    return 2.0 * (math.log(n - 1) + 0.5772156649 if n > 2 else 0.5) - 2.0 * (n - 1) / n


def fit_forest(parts: list[np.ndarray], unit: np.ndarray, seed: int = 7) -> Forest:
    """Each tree cuts its rows, one of ``parts``, until they are alone, wide features more often than narrow ones."""
    rng = np.random.default_rng(seed)
    trees, most = len(parts), max(len(part) for part in parts)
    depth = math.ceil(math.log2(max(2, most)))
    size = 2 ** (depth + 1)
    feature, left = np.full((trees, size), -1), np.zeros((trees, size), int)
    cut, length = np.zeros((trees, size)), np.zeros((trees, size))
    lows, highs = np.zeros((trees, size, len(unit))), np.zeros((trees, size, len(unit)))
    for t in range(trees):
        nodes, used = [(0, parts[t] / unit, 0)], 1
        while nodes:
            at, part, deep = nodes.pop()
            low, high = part.min(axis=0), part.max(axis=0)
            lows[t, at], highs[t, at] = low, high
            if deep == depth or len(part) < 2 or not (high > low).any():
                length[t, at] = deep + _expected_path(len(part))
                continue
            f = int(rng.choice(len(low), p=(high - low) / (high - low).sum()))
            # a cut at the lowest value would leave nothing on its left
            cut[t, at] = max(rng.uniform(low[f], high[f]), np.nextafter(low[f], high[f]))
            feature[t, at], left[t, at] = f, used
            right = part[:, f] >= cut[t, at]
            nodes += [(used, part[~right], deep + 1), (used + 1, part[right], deep + 1)]
            used += 2
    return Forest(feature, cut, left, length, lows, highs, unit, max(_expected_path(most), 1e-9))


def statistics(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the statistics of each whole text; a pass over the texts without a shuffle."""

    def measure(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=SLICE):
            stats = text_statistics(batch.column(1))
            yield pa.record_batch([batch.column(0), *[pa.array(c) for c in stats.T]], ["doc_id", *STATS])

    narrow = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return narrow.mapInArrow(measure, f"doc_id long, {STATS_DDL}")


def labelled_features(stats: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, good`` and the features ``f0, f1, ...`` of every labelled document that passes the base rules, stored.

    ``stats`` are the :func:`statistics` of all documents: these are joined, so no text is shuffled however many labels there are.

    Rows without id or quality are no labels; a document labelled twice counts by its lowest label, and of
    documents that share a labelled id the one with the least statistics, in their order, counts.
    """
    chosen = (
        labels.where("doc_id is not null and quality is not null")
        .groupBy(F.col("doc_id").cast("long").alias("labelled")).agg((F.min("quality") > 0).alias("good"))
    )
    least = F.min(F.struct(*STATS)).alias("stats")
    # both sides are narrow and grouped by the key, so a merge needs no exchange of its own
    found = stats.where("doc_id is not null").groupBy("doc_id").agg(least).join(chosen.hint("merge"), F.col("doc_id") == F.col("labelled"))
    measured = found.select("doc_id", "good", "stats.*")

    def passed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = np.column_stack([c.to_numpy() for c in batch.columns[2:]])
            out = pa.record_batch([*batch.columns[:2], *[pa.array(c) for c in features(stats).T]], ["doc_id", "good", *FEATURES])
            yield out.filter(pa.array(~base_failed(stats)))

    return materialize(measured.mapInArrow(passed, "doc_id long, good boolean, " + ", ".join(f"{f} double" for f in FEATURES)))


def order_statistics(values: DataFrame, places: list[int]) -> dict[str, list[float]]:
    """For each ``measure`` the values at these places, from 0, in the order of ``value``; no task holds a measure."""
    counts = values.groupBy("measure", "value").agg(F.count("*").alias("n"))
    upto = running_totals(counts, ["value"], F.col("n"), "upto", ["measure"])
    found = upto.groupBy("measure").agg(F.array(*[F.min(F.when(F.col("upto") > p, F.col("value"))) for p in places]).alias("found"))
    return {r["measure"]: r["found"] for r in found.collect()}


def _draws(rows: DataFrame, n: int, trees: int, size: int, seed: int) -> list[np.ndarray]:
    """The rows of each tree, drawn from all ``n`` without repeats; at most ``trees * size`` rows reach the driver."""
    rng = np.random.default_rng(seed)
    drawn = [rng.choice(n, min(size, n), replace=False) for _ in range(trees)]
    places = np.unique(np.concatenate(drawn))
    numbered = running_totals(rows.drop("good"), ["doc_id"], F.lit(1).cast("long"), "upto")
    wanted = rows.sparkSession.createDataFrame([(int(p) + 1,) for p in places], "upto long")
    found = numbered.join(F.broadcast(wanted), "upto").select("upto", *FEATURES).orderBy("upto").collect()
    x = np.array([list(r)[1:] for r in found])
    return [x[np.searchsorted(places, d)] for d in drawn]


def _threshold(forest: Forest, rows: DataFrame, n_good: int) -> float:
    """The score above which documents go.

    Of the scores that lose at most :data:`MAX_GOOD_LOST` of the good rows, it takes the middle between
    the last good row that stays and the next row above. Without bad rows nothing goes.
    """

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([c.to_numpy() for c in batch.columns[2:]])
            yield pa.record_batch([batch.column(1), pa.array(forest.scores(x))], ["good", "value"])

    scores = materialize(spread(rows).mapInArrow(score, "good boolean, value double"))
    place = math.ceil((n_good - 1) * (1 - MAX_GOOD_LOST))
    kept = order_statistics(scores.where("good").select(F.lit("score").alias("measure"), "value"), [place])["score"][0]
    above = scores.where(~F.col("good") & (F.col("value") > kept)).agg(F.min("value")).first()[0]
    return math.inf if above is None else (kept + above) / 2


def fit(docs: DataFrame, labels: DataFrame, trees: int = 200, size: int = 256, seed: int = 7) -> Forest | None:
    """:func:`fit_statistics` on the documents' own statistics."""
    return fit_statistics(statistics(docs), labels, trees, size, seed)


def fit_statistics(stats: DataFrame, labels: DataFrame, trees: int = 200, size: int = 256, seed: int = 7) -> Forest | None:
    """A forest whose trees draw their rows from all good labelled documents, calibrated on all labelled ones.

    A feature's unit is the spread of all good rows in it without their outer hundredths. Only the rows that the
    trees draw, ``trees`` times ``size`` at most, reach the driver.
    None if no labelled document passes the base rules: then these alone decide.
    """
    rows = labelled_features(stats, labels)
    n, n_good = rows.agg(F.count("*"), F.count_if("good")).first()
    if not n:
        return None
    ordinary = rows.where("good") if n_good else rows
    m = n_good or n
    measured = ordinary.select(F.inline(F.array(*[F.struct(F.lit(f).alias("measure"), F.col(f).alias("value")) for f in FEATURES])))
    places = [q * (m - 1) for q in (0.01, 0.99)]
    at = order_statistics(measured, [p for place in places for p in (math.floor(place), math.ceil(place))])
    unit = []
    for f in FEATURES:
        low, high = (at[f][2 * i] + (at[f][2 * i + 1] - at[f][2 * i]) * (place % 1) for i, place in enumerate(places))
        unit.append(max(high - low, LEAST_SPREAD))
    forest = fit_forest(_draws(ordinary, m, trees, size, seed), np.array(unit), seed)
    if 0 < n_good < n:
        forest.threshold = _threshold(forest, rows, n_good)
    return forest


def _verdicts(stats: np.ndarray, forest: Forest | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    failed = base_failed(stats)
    if forest is None:
        return failed, ~failed, np.zeros(len(stats))
    scores = forest.scores(features(stats))
    return failed, ~failed & (scores <= forest.threshold), scores


def judged(docs: DataFrame, forest: Forest | None) -> DataFrame:
    """:func:`judged_statistics` of the documents' own statistics."""
    return judged_statistics(statistics(docs), forest)


def judged_statistics(stats: DataFrame, forest: Forest | None) -> DataFrame:
    """``doc_id``, the statistics, ``base_failed``, ``kept`` and ``score`` of each document.

    A null or empty text has no words and fails. Equal rows get equal verdicts.
    """

    def judge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            verdict = _verdicts(np.column_stack([c.to_numpy() for c in batch.columns[1:]]), forest)
            yield pa.record_batch([*batch.columns, *[pa.array(x) for x in verdict]], ["doc_id", *STATS, "base_failed", "kept", "score"])

    return stats.select("doc_id", *STATS).mapInArrow(judge, f"doc_id long, {STATS_DDL}, base_failed boolean, kept boolean, score double")


def kept_documents(docs: DataFrame, forest: Forest | None) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns; the texts are not shuffled."""
    at = docs.columns.index("text")

    def choose(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=SLICE):
            keep = _verdicts(text_statistics(batch.column(at)), forest)[1]
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(choose, docs.schema)
