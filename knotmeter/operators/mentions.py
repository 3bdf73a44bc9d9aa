"""Substring join: which needles of a project occur in which of its texts.

A substring test cannot be hashed directly, and testing every needle of a project against every text of it grows with
the square of a large project. So the needles become an inverted index over q-grams: each is filed under
its rarest gram, one that few needles of the project share and that starts with a character that is rare in
texts. A text that holds a needle holds its gram, so texts are exploded to the grams that can be keys,
joined with the index on (project, gram), and ``contains`` settles what is left.

The index is broadcast in slices of bounded size, one after the other, as many as its measured size needs. Texts are
never shuffled, whatever the number of needles; their content ends in the scan stage.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knotmeter.session import materialize

#: Characters of a gram. Shorter needles are their own key.
GRAM = 4
#: Bytes of a broadcast slice of the index, about.
SLICE_BYTES = 32 << 20
#: What a row of the index takes beside its texts when it is hashed.
_ROW_BYTES = 64


def _grams(text: Column, length: int, first: str = ".") -> Column:
    """All runs of ``length`` characters that start with ``first``; one character is passed at a time."""
    rest = f".{{{length - 1}}}" if length > 1 else ""
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=({first}{rest}))."), F.lit(1))


def needle_index(needles: DataFrame, group: str) -> DataFrame:
    """``(group, needle, key)``: a row for each distinct needle that is not empty, with the gram it is found by.

    Letters and blanks fill most texts, so a gram that starts with something else comes first; then
    the gram that the fewest needles of the group have.
    """
    distinct = needles.where(F.length("needle") > 0).select(group, "needle").distinct()
    keys = F.when(F.length("needle") < GRAM, F.array("needle")).otherwise(F.array_distinct(_grams(F.col("needle"), GRAM)))
    each = distinct.select(group, "needle", F.explode(keys).alias("key"))
    shared = each.groupBy(group, "key").agg(F.count("*").alias("n"))
    common_start = F.col("key").rlike(r"^[\p{L}\s]")
    best = F.min(F.struct(common_start.alias("common"), "n", F.xxhash64("key").alias("hash"), "key"))
    return each.join(shared, [group, "key"]).groupBy(group, "needle").agg(best["key"].alias("key"))


def _measured(index: DataFrame, group: str) -> tuple[int, dict[int, str]]:
    """The bytes of the index, and for each length of key a character class of the first characters of its keys.

    Characters beyond ASCII count as one, so at most 129 rows for each of GRAM lengths come to the driver.
    """
    code = F.ascii("key")
    size = F.octet_length(group) + F.octet_length("needle") + F.octet_length("key") + F.lit(_ROW_BYTES)
    rows = index.groupBy(F.length("key").alias("length"), F.when(code < 128, code).otherwise(-1).alias("code")).agg(
        F.sum(size).alias("size")
    ).collect()
    classes: dict[int, list[int]] = {}
    for row in rows:
        classes.setdefault(row["length"], []).append(row["code"])
    return sum(row["size"] or 0 for row in rows), {
        length: "[" + "".join(r"[^\x00-\x7F]" if c < 0 else f"\\x{c:02x}" for c in sorted(codes)) + "]"
        for length, codes in sorted(classes.items())
    }


def _last_mention(text: str) -> dict[str, Column]:
    """Line number and trimmed line of the last place of the needle."""
    # what follows the last occurrence of the needle
    tail = F.call_function("substring_index", F.col(text), F.col("needle"), F.lit(-1))
    head = F.substring(F.col(text), F.lit(1), F.length(text) - F.length(tail) - F.length("needle"))
    line = (F.octet_length(head) - F.octet_length(F.replace(head, F.lit("\n"), F.lit("")))) + 1
    code = F.concat(F.substring_index(head, "\n", -1), F.col("needle"), F.substring_index(tail, "\n", 1))
    return {"last_line": line.cast("bigint"), "last_code": F.trim(code)}


def contains_pairs(
    texts: DataFrame, needles: DataFrame, text: str = "content", group: str = "project_id", slice_bytes: int = SLICE_BYTES
) -> DataFrame:
    """(columns of ``texts`` but the text, needle, last_line, last_code) per hit.

    ``needles`` has ``group`` and ``needle``; other columns are dropped and equal
    rows merged, empty needles never match.  ``last_line``/``last_code`` locate
    the last occurrence.  A null text or group has no hits.
    """
    # read several times below, and often the result of scanning contents itself
    index = materialize(needle_index(needles, group))
    size, starts = _measured(index, group)
    slices = -(-size // slice_bytes)
    grams = [_grams(F.col(text), length, first) for length, first in starts.items()]
    grams = F.array_distinct(F.concat(*grams)) if grams else F.array().cast("array<string>")
    keyed = texts.withColumn("_key", F.explode(grams))

    def hits(part: DataFrame) -> DataFrame:
        part = part.select(F.col(group).alias("_group"), "needle", F.col("key").alias("_part_key"))
        same = (F.col(group) == F.col("_group")) & (F.col("_key") == F.col("_part_key"))
        joined = keyed.join(F.broadcast(part), same & F.col(text).contains(F.col("needle")))
        return joined.withColumns(_last_mention(text)).drop(text, "_key", "_group", "_part_key")

    slot = F.pmod(F.xxhash64(group, "key"), F.lit(max(1, slices)))
    return reduce(DataFrame.union, [hits(index.where(slot == i)) for i in range(max(1, slices))])
